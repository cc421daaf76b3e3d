"""The sync loop as a stream: symbols of files that changed arrive, and each batch is merged into the state records.

The table of records is a log: a batch writes `batch=N`, what it changed and nothing else, records that are gone as such, in folders by a hash of their file. A batch reads
the folders of its files alone, of batches before it, so one that is tried again after a failure writes the same again, and a restart goes on where the log ends.
The newest row of an id counts. `compact` puts a log together in a new place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glosswork.operators import state
from glosswork.sources.tables import scratch, settled

SYMBOLS = "id string, path string, sig string, doc string, body string, zh string, translatable boolean, at timestamp"
RECORDS = ", ".join(f"{c} string" for c in state.RECORD)
LOG = f"{RECORDS}, gone boolean, batch long, bucket int"
BUCKETS = 256


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def records(spark: SparkSession, table: str, before: int | None = None, paths: DataFrame | None = None) -> DataFrame:
    """The records, or those before a batch, or of some files (path); empty without a log."""
    try:
        log = spark.read.schema(LOG).parquet(table)
    except Exception as e:  # the table isn't there before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORDS)
    if before is not None:
        log = log.where(F.col("batch") < before)
    if paths is not None:
        buckets = [r["b"] for r in paths.select(bucket_of(F.col("path")).alias("b")).distinct().collect()]  # no more than BUCKETS; other folders aren't read
        log = log.where(F.col("bucket").isin(buckets)).withColumn("path", state.path_of(F.col("id"))).join(paths.select("path").distinct(), "path", "left_semi")
    last = log.groupBy("id").agg(F.max_by(F.struct(*state.RECORD[1:], "gone"), "batch").alias("r"))
    return last.where("NOT r.gone").select("id", *(f"r.{c}" for c in state.RECORD[1:]))


def _logged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", bucket_of(state.path_of(F.col("id"))))


def merge_batch(batch: DataFrame, number: int, table: str, by: str = "stream") -> None:
    """Write what a batch of SYMBOLS changes. Of a file that it has twice the later snapshot counts."""
    spark = batch.sparkSession
    with scratch():
        newest = batch.groupBy("path").agg(F.max("at").alias("at"))
        symbols = settled(batch.join(newest, ["path", "at"]).dropDuplicates(["path", "id"]))
        paths = symbols.select("path").distinct()
        merged = settled(state.merge(records(spark, table, number, paths), symbols.where("id IS NOT NULL"), by).where("action != 'kept'"))
        new = merged.where("action != 'dropped'").select(*state.RECORD, F.lit(False).alias("gone"))
        gone = merged.select(F.when(F.col("action") == "dropped", F.col("id")).otherwise(F.col("old_id")).alias("id")).where("id IS NOT NULL")
        gone = gone.join(new.select("id"), "id", "left_anti").select("id", *(F.lit(None).cast("string").alias(c) for c in state.RECORD[1:]), F.lit(True).alias("gone"))
        _logged(new.unionByName(gone)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={number}")


def follow(spark: SparkSession, incoming: str, table: str, checkpoint: str, by: str = "stream") -> StreamingQuery:
    """Start a stream over Parquet files of SYMBOLS in `incoming`: all symbols of each file that changed, or one row without an id for a file that is gone."""
    stream = spark.readStream.schema(SYMBOLS).parquet(incoming)
    return stream.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, table, by)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, table: str, to: str) -> None:
    """The records of a log as one batch of a new one, numbered as its last, so that a stream can go on there."""
    last = spark.read.schema(LOG).parquet(table).agg(F.max("batch")).first()[0]
    _logged(records(spark, table).withColumn("gone", F.lit(False))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{to}/batch={last or 0}")


def changes_per_window(symbols: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Annotated and other symbols that arrived in each window, later ones than `late` left out; for streams and tables alike."""
    return symbols.withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count("*").alias("n"), F.count_if(F.col("zh").isNotNull()).alias("annotated")).select(F.col("window.start").alias("begins"), "n", "annotated")
