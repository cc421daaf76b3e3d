"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Spans of three base kinds are found in every text. The hashes of all candidates' values are then aggregated over the whole corpus by
distinct repositories and owners: a value of several owners, or in more than `REPOSITORIES` repositories of one, is a widely copied
example; a value of one owner in few repositories looks live. Strings in well-known credential formats, of kind `known`, are added to
the spans where the corpus shows them to be live-looking.

Positions are code points, ends exclusive. They come from splitting a text at the matches and adding up lengths, so Java's engine
walks a text once to see whether there is a match at all, and again only in texts that have one.

Defined cases: null text counts as empty; repeated rows each get their spans and count once in the aggregates; a null owner is an owner of
its own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm._base import cut

# The kinds in order, their patterns, the group that is the value, its least length.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("known", r"gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[sr]k_live_[A-Za-z0-9]{24,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 16),
)
#: A value of more owners than this, or in more repositories, is a copied example.
OWNERS, REPOSITORIES = 1, 16

SPAN = "struct<start: int, rank: int, stop: int, value: bigint>"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, rank: int) -> Column:
    """array of SPAN: the leftmost non-overlapping matches of a kind, those whose value is too short left out."""
    _, pattern, group, least = KINDS[rank]
    none = F.array().cast(f"array<{SPAN}>")
    p = F.lit(pattern)

    def spans(parts: Column) -> Column:
        found, values = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
        rows = F.arrays_zip(F.slice(F.transform(parts, F.length), 1, F.size(parts) - 1).alias("gap"), F.transform(found, F.length).alias("size"), values.alias("value"))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + x["size"]).alias("stop"), F.xxhash64(x["value"]).alias("value")).cast(SPAN)
            return F.struct((begin + x["size"]).alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(rows, start, step, lambda acc: acc["out"])

    return F.when(text.rlike(pattern), _let(F.split(text, pattern, -1), spans)).otherwise(none)


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, same (a hash of the text), owner, repository, base and known spans of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"))
    base = F.sort_array(F.concat(*(matches(F.col("text"), i) for i in range(3))))
    return rows.select("doc_id", F.xxhash64("text").alias("same"), "owner", "repository", base.alias("base"), matches(F.col("text"), 3).alias("known"))


def ownership(found: DataFrame) -> DataFrame:
    """value, n_owners, n_repositories over the corpus. Distinct pairs come first, so a value in a third of all rows is summed up in every task before it travels."""
    every = found.select("owner", "repository", F.explode(F.concat("base", "known")).alias("s")).select(F.col("s.value").alias("value"), "owner", "repository")
    return every.groupBy("value").agg(F.count_distinct(F.coalesce("owner", F.lit("\0"))).alias("n_owners"), F.count_distinct(F.coalesce("repository", F.lit("\0"))).alias("n_repositories"))


def shown(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """One row for each of docs (doc_id, text and the owner's and repository's columns).

    doc_id, same (a hash of the text), n_assign, n_access, n_hex, base_sha256, spans (string), all (array of SPAN), n_live and n_copied: of its spans, those whose value
    looks live and those that are copied examples.
    """
    found = cut(candidates(docs, owner, repository))
    shared = ownership(found)
    marks = found.select("doc_id", "same", F.explode(F.concat("base", "known")).alias("s")).distinct()
    live = (F.col("n_owners") <= owners) & (F.col("n_repositories") <= repositories)
    judged = (
        marks.withColumn("value", F.col("s.value"))
        .join(shared, "value")
        .groupBy(F.col("doc_id").alias("_doc"), F.col("same").alias("_same"))
        .agg(
            F.count_if(live).alias("n_live"),
            F.count_if(~live).alias("n_copied"),
            F.collect_set(F.when((F.col("s.rank") == 3) & live, F.col("s"))).alias("added"),
        )
    )
    none = F.array().cast(f"array<{SPAN}>")
    rows = found.join(judged, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("same") == F.col("_same")), "left")
    rows = rows.select("doc_id", "same", "base", F.sort_array(F.concat("base", F.coalesce("added", none))).alias("all"), "n_live", "n_copied")

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return rows.select(
        "doc_id",
        "same",
        *(count(i).alias(f"n_{KINDS[i][0]}") for i in range(3)),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.col("all")).alias("spans"),
        "all",
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id", with_: str = "[SECRET]") -> DataFrame:
    """docs with all found spans replaced in text; n_chars, if there, set anew. Columns of any names go through."""
    found = scan(docs, owner, repository).where(F.size("all") > 0).select("doc_id", "same", "all").dropDuplicates(["doc_id", "same"])
    keys = (F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("same"))
    rows = docs.select(*keys, F.col("text").alias("text"), F.struct(*docs.columns).alias("own")).alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.same") == F.col("f.same")), "left").select("d.text", "d.own", "f.all")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]  # spans of two kinds may overlap
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(with_))).alias("out"))

    clean = F.aggregate("all", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    rows = rows.select("own", F.col("all").isNotNull().alias("changed"), F.when(F.col("all").isNotNull(), clean).otherwise(text).alias("clean"))
    new = {"text": F.col("clean")} | ({"n_chars": F.when(F.col("changed"), F.length("clean").cast("long")).otherwise(F.col("own.n_chars"))} if "n_chars" in docs.columns else {})
    return rows.select(*(new.get(c, F.col("own").getField(c)).alias(c) for c in docs.columns))


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("same", "all")
