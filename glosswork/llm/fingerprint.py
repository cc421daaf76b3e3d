"""Document fingerprints: a bottom-k sketch of the hashes of word shingles, in DataFrame functions only.

A sketch is k and the ascending array of the k smallest distinct 64-bit shingle hashes, or of all if there are fewer. Sketches of parts merge
into the sketch of the whole; two of them estimate resemblance, containment and numbers of distinct shingles. Of two with different k the
smaller one counts.

Shingles are `words` consecutive words [^\\x20\\x09-\\x0D]+; a text with fewer words has one, of all of them; a text without words
has none, and its sketch is empty. Two empty sketches are alike (1.0), an empty one and another are not (0.0).

Null text counts as empty. The next document is that of the next greater doc_id (repeated rows: in order of text); after the last
comes the first. Null doc_ids come before all, in order of text. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm._base import cut, parts

K = 256
WORDS = 5
#: Ids that one task orders; documents of a range of so many ids are dealt out together.
RANGE = 128
#: Ranges whose order one task finds.
RANGES = 4096

BLANKS = r"[\x20\x09-\x0D]+"


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """struct<k: int, hashes: array<bigint>>: the bottom-k sketch of a text."""
    hashes = F.transform(F.filter(F.split(text, BLANKS, -1), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        return F.when(F.size(h) >= words, F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return bottom(_let(hashes, shingles), F.lit(k))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bottom(hashes: Column, k: Column) -> Column:
    return F.struct(k.cast("int").alias("k"), F.slice(F.sort_array(F.array_distinct(hashes)), F.lit(1), k).alias("hashes"))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two parts together."""
    return bottom(F.concat(a["hashes"], b["hashes"]), F.least(a["k"], b["k"]))


def merge_all(sketches: DataFrame, *by: str, column: str = "sketch") -> DataFrame:
    """by, column: one sketch for each group of sketches. Spark keeps a task's k smallest hashes of a group before it sends any, so no group is gathered whole."""
    least = sketches.groupBy(*by).agg(F.min(F.col(column)["k"]).alias("_k"))
    each = sketches.select(*by, F.explode(F.col(column)["hashes"]).alias("_h"))
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy("_h"))
    most = least.agg(F.max("_k")).first()[0] or 0
    few = each.withColumn("_n", rank).where(F.col("_n") <= most).groupBy(*by).agg(F.collect_set("_h").alias("_all"))
    none = F.array().cast("array<bigint>")
    return least.join(few, list(by), "left").select(*by, bottom(F.coalesce("_all", none), F.col("_k")).alias(column))


def _whole(a: Column) -> Column:
    """Whether a sketch has all hashes of its text."""
    return F.size(a["hashes"]) < a["k"]


def distinct_shingles(a: Column) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a["hashes"], -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)  # of all hash values, those up to the sketch's greatest
    return F.when(_whole(a), F.size(a["hashes"]).cast("double")).otherwise((a["k"] - 1) / share)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of shingles in either that are in both; exact if both sketches are whole."""
    x, y = a["hashes"], b["hashes"]
    union = F.sort_array(F.array_union(x, y))
    exact = F.size(F.array_intersect(x, y)) / F.size(union)
    seen = _let(F.slice(union, F.lit(1), F.least(a["k"], b["k"])), lambda u: F.size(F.array_intersect(F.array_intersect(x, y), u)) / F.size(u))
    none = (F.size(x) == 0) | (F.size(y) == 0)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).when(none, F.lit(0.0)).when(x == y, F.lit(1.0)).when(_whole(a) & _whole(b), exact).otherwise(seen)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that are in b."""
    return F.when(F.size(a["hashes"]) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b) * distinct_shingles(merge(a, b)) / distinct_shingles(a)))


def shown(a: Column) -> Column:
    """A sketch's hashes as a string."""
    return F.array_join(F.transform(a["hashes"], F.hex), ",")


def with_next(docs: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """doc_id, text and extra columns of each document, and next_... of the text and each of these in the next document.

    Ids are dealt out in ranges of RANGE. Which range is next is found among RANGES of them at a time, and only the first range of each of these
    lots meets in one place: a row for every RANGE * RANGES ids.
    """
    names = ["text", *extra]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("_range", F.coalesce(F.floor(F.col("doc_id") / RANGE), F.lit(-(1 << 62))))
    first = F.struct(F.lit(True).alias("there"), F.min("doc_id").alias("id"))  # null ids are a range of their own
    least = base.groupBy("_range").agg(first.alias("_least")).withColumn("_lot", F.floor(F.col("_range") / RANGES))
    lots = least.groupBy("_lot").agg(F.min_by("_least", "_range").alias("_least"))
    ordered = Window.orderBy("_lot")
    lots = lots.select("_lot", F.coalesce(F.lead("_least").over(ordered), F.first("_least").over(ordered)).alias("_then"))
    after = least.withColumn("_next", F.lead("_least").over(Window.partitionBy("_lot").orderBy("_range"))).join(lots, "_lot")
    after = cut(after.select("_range", F.coalesce("_next", "_then")["id"].alias("_head")))  # so that its size is known, and texts stay where they are if it is small
    head = base.select("doc_id", "text").join(after, F.col("doc_id").eqNullSafe(F.col("_head"))).groupBy("_range").agg(F.min("text").alias("text"))
    head = head.select("_range", F.col("text").alias("_head_text"), *(c.alias(f"_head_{n}") for n, c in extra.items()))
    within = Window.partitionBy("_range").orderBy("doc_id", "text")
    rows = base.repartition(parts(docs.sparkSession), "_range").select("*", *(c.alias(n) for n, c in extra.items())).select("*", *(F.lead(n).over(within).alias(f"next_{n}") for n in names), F.lead(F.lit(True)).over(within).alias("_has"))
    rows = rows.join(head, "_range", "left")
    return rows.select("doc_id", *names, *(F.when(F.col("_has"), F.col(f"next_{n}")).otherwise(F.coalesce(F.col(f"_head_{n}"), F.col(n))).alias(f"next_{n}") for n in names))


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_distinct of docs (doc_id, text)."""
    rows = with_next(docs, {"own": sketch(F.col("text"), k, words)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"), "own", "next_own")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", sketch(F.col("edited"), k, words).alias("other"))
    return rows.select("doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("other")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("other")).alias("near_edited"), resemblance(F.col("own"), F.col("next_own")).alias("near_next"), distinct_shingles(F.col("own")).alias("n_distinct"))


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
