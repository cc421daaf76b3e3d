"""A table of what was made from files, kept by their contents: a run makes only what isn't there yet.

The table is a log in folders by batch and by a hash of the key. A lookup reads the buckets that the wanted keys are in; a run appends what it made as one batch, so nothing is written twice.
`pruned` writes the table anew without what no file has any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from glosswork.sources.tables import settled

BUCKETS = 64


def key_of(path: Column, text: Column) -> Column:
    """What is made of a file depends on its path, for its language and ids, and on its text."""
    return F.sha2(F.concat(path, F.lit("\0"), text), 256)


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _table(spark, table: str, schema: S.StructType) -> DataFrame:
    fields = S.StructType([S.StructField("key", S.StringType()), S.StructField("made", S.ArrayType(schema)), S.StructField("batch", S.LongType()), S.StructField("bucket", S.IntegerType())])
    try:
        return spark.read.schema(fields).parquet(table)
    except Exception as e:  # the table isn't there before the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], fields)


def made(files: DataFrame, make: Callable[[DataFrame], DataFrame], schema: S.StructType, table: str) -> tuple[DataFrame, DataFrame]:
    """All rows that `make` makes of files (path, text), from the table as far as it has them, and the files (path, key) that had to be made now.

    make: from files (path, text) rows of schema, with a column path. A file of which nothing is made is remembered too.
    """
    spark = files.sparkSession
    keyed = files.select("path", "text", key_of(F.col("path"), F.col("text")).alias("key"))
    keys = settled(keyed.select("path", "key"))
    buckets = [r["b"] for r in keys.select(_bucket(F.col("key")).alias("b")).distinct().collect()]  # no more than BUCKETS
    known = _table(spark, table, schema).where(F.col("bucket").isin(buckets))
    last = known.agg(F.max("batch")).first()[0]
    fresh = settled(keys.join(known.select("key"), "key", "left_anti"))
    if fresh.limit(1).count():
        number = -1 if last is None else last
        todo = keyed.join(fresh.select("key"), "key", "left_semi")
        each = make(todo.select("path", "text")).groupBy("path").agg(F.collect_list(F.struct(*schema.names)).alias("made"))
        rows = fresh.join(each, "path", "left").select("key", F.coalesce("made", F.array().cast(S.ArrayType(schema))).alias("made"), _bucket(F.col("key")).alias("bucket"))
        rows.dropDuplicates(["key"]).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={_next(spark, table, number)}")
    found = _table(spark, table, schema).where(F.col("bucket").isin(buckets)).join(keys.select("key"), "key", "left_semi")
    return found.select(F.explode("made").alias("m")).select("m.*"), fresh


def _next(spark, table: str, least: int) -> int:
    """A batch number that the whole table hasn't."""
    try:
        last = spark.read.schema("batch long").parquet(table).agg(F.max("batch")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    return max(least, -1 if last is None else last) + 1


def pruned(files: DataFrame, schema: S.StructType, table: str, to: str) -> None:
    """Write the table anew, with what files (path, text) have and nothing else."""
    keys = files.select(key_of(F.col("path"), F.col("text")).alias("key")).distinct()
    rows = _table(files.sparkSession, table, schema).join(keys, "key", "left_semi")
    rows.dropDuplicates(["key"]).select("key", "made", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{to}/batch=0")
