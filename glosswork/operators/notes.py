"""Analysis documents and their anchors in code.

docs: path, body_sha, anchors array<string>. hashes: anchor, hash. records: path, sha, anchors map<string, string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import text as T

# The statuses, in the order of a summary.
STATUSES = ("current", "stale", "broken", "unanchored", "new")


def parse(files: DataFrame) -> DataFrame:
    """docs from (path, text): title and anchors of the front matter, and the hash of the rest, white space included."""
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "")
    listed = F.regexp_extract(front, r"(?m)^anchors:[ \t]*(?:#.*)?\n((?:[ \t]*(?:-[ \t]+.*|#.*)?(?:\n|\z))*)", 1)
    items = F.regexp_extract_all(listed, F.lit(r"(?m)^[ \t]*-[ \t]+(.*?)[ \t]*$"), F.lit(1))
    flow = F.regexp_extract(front, r"(?m)^anchors:[ \t]*\[([^\]]*)\]", 1)
    items = F.when(flow != "", F.regexp_extract_all(flow, F.lit(r"[ \t\n]*(\"[^\"]*\"|'[^']*'|[^,]+)[ \t\n]*"), F.lit(1))).otherwise(items)

    def scalar(value: Column) -> Column:
        """A plain or quoted YAML scalar; a comment begins at a # after white space."""
        quoted = F.regexp_extract(value, r"^(?:\"([^\"]*)\"|'([^']*)')", 0)
        return F.when(quoted != "", F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(F.trim(F.regexp_replace(value, r"(?:^|[ \t])#.*$", "")))

    anchors = F.filter(F.transform(items, lambda a: scalar(F.trim(a))), lambda a: a != "")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    title = F.coalesce(F.nullif(scalar(F.trim(F.regexp_extract(front, r"(?m)^title:[ \t]*(.*)$", 1))), F.lit("")), stem)
    return files.select("path", title.alias("title"), anchors.alias("anchors"), T.short_sha(body).alias("body_sha"))


def anchor_hashes(anchors: DataFrame, symbols: DataFrame) -> DataFrame:
    """anchor, hash (null if it is gone) of anchors (anchor) `path#symbol` or `path`; symbols: id, path, sig, doc, body."""
    own = symbols.select("id", "path", T.short_sha(F.concat_ws("|", "sig", "doc", "body")).alias("h"))
    whole = own.groupBy("path").agg(T.short_sha(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "h"))), lambda x: F.concat_ws(":", x["id"], x["h"])), "\n")).alias("whole"))
    rows = anchors.select("anchor").distinct()
    return rows.join(own.select(F.col("id").alias("anchor"), "h"), "anchor", "left").join(whole.select(F.col("path").alias("anchor"), "whole"), "anchor", "left").select("anchor", F.coalesce("h", "whole").alias("hash"))


def derive(docs: DataFrame, hashes: DataFrame, records: DataFrame) -> DataFrame:
    """docs with status, and `at` (anchor to hash)."""
    each = docs.select("path", F.explode(F.array_distinct("anchors")).alias("anchor")).join(hashes, "anchor", "left")
    now = each.groupBy("path").agg(F.count_if(F.col("hash").isNull()).alias("missing"), F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("anchor", "hash"))))).alias("at"))
    rows = docs.join(now, "path", "left").join(records.select("path", "sha", F.col("anchors").alias("was")), "path", "left")
    keys = F.sort_array(F.map_keys("was")) == F.sort_array(F.array_distinct("anchors"))
    moved = F.exists(F.array_distinct("anchors"), lambda a: F.coalesce(F.try_element_at("was", a) != F.try_element_at("at", a), F.lit(True)))
    status = F.when(F.size("anchors") == 0, "unanchored").when(F.col("missing") > 0, "broken").when(F.col("sha").isNull() | (F.col("sha") != F.col("body_sha")) | ~keys, "new").when(moved, "stale").otherwise("current")
    return rows.select(*docs.columns, "at", status.alias("status"))


def summary(rows: DataFrame) -> DataFrame:
    """status, n for every status, also where there is none."""
    every = rows.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(rows.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def merge(rows: DataFrame, records: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """path, action, sha, anchors: recorded (new), approved, kept and dropped records. rows: from derive(); approved: path."""
    ok = approved.select("path", F.lit(True).alias("ok")) if approved is not None else rows.sparkSession.createDataFrame([], "path string, ok boolean")
    both = rows.join(ok, "path", "left").alias("d").join(records.alias("r"), "path", "full_outer")
    sound = ~F.col("status").isin("broken", "unanchored")
    action = F.when(F.col("status").isNull(), "dropped").when(F.coalesce("ok", F.lit(False)) & sound, "approved").when(F.col("status") == "new", "recorded").when(F.col("sha").isNotNull(), "kept")
    fresh = action.isin("approved", "recorded")
    return both.select("path", action.alias("action"), F.when(fresh, F.col("body_sha")).otherwise(F.col("sha")).alias("sha"), F.when(fresh, F.col("at")).otherwise(F.col("r.anchors")).alias("anchors")).where(F.col("action").isNotNull())
