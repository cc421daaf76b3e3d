"""Annotation states: derived by comparing records with the current symbols, never stored.

symbols: id, path, sig, doc, body, zh (null without an annotation), translatable. records: id, at_sig, at_doc, at_body, zh, by, and
review_sig, review_doc, review_body, review_zh (null without a review).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.sources.tables import settled

KINDS = ("sig", "doc", "body")
RECORD = ("id", "at_sig", "at_doc", "at_body", "zh", "by", "review_sig", "review_doc", "review_body", "review_zh")


def _changed() -> Column:
    parts = [F.when(~F.col(f"r.at_{k}").eqNullSafe(F.col(f"s.{k}")), F.lit(k)) for k in KINDS]
    return F.array_compact(F.array(*parts))


def derive(symbols: DataFrame, records: DataFrame) -> DataFrame:
    """symbols with status, changed (which of sig, doc, body) and priority (P0 to P2, empty if not stale)."""
    edited = F.col("r.id").isNull() | ~F.col("r.zh").eqNullSafe(F.col("s.zh"))
    approved = (F.col("r.review_zh") == F.col("s.zh")) & (F.col("r.review_sig") == F.col("s.sig")) & (F.col("r.review_doc") == F.col("s.doc")) & (F.col("r.review_body") == F.col("s.body"))
    changed = _changed()
    status = F.when(F.col("s.zh").isNull(), "pending").when(edited, "translated").when(F.size(changed) > 0, "stale").when(approved, "reviewed").otherwise("translated")
    rows = symbols.alias("s").join(records.alias("r"), F.col("s.id") == F.col("r.id"), "left").select("s.*", status.alias("status"), changed.alias("_changed"))
    rows = rows.withColumn("changed", F.when(F.col("status") == "stale", F.col("_changed")).otherwise(F.array().cast("array<string>"))).drop("_changed")
    first = F.get("changed", F.lit(0))
    return rows.withColumn("priority", F.when(first == "sig", "P0").when(first == "doc", "P1").when(first == "body", "P2").otherwise(""))


def orphans(records: DataFrame, symbols: DataFrame) -> DataFrame:
    """Records whose symbol is gone."""
    return records.join(symbols.select("id"), "id", "left_anti")


def counted(rows: DataFrame) -> DataFrame:
    """What coverage counts: translatable symbols and all annotated ones."""
    return rows.where(F.col("translatable") | (F.col("status") != "pending"))


def coverage(rows: DataFrame) -> DataFrame:
    """One row: counts by status, and the ratios of annotated, of fresh and of reviewed symbols."""
    n = {s: F.count_if(F.col("status") == s) for s in ("reviewed", "translated", "stale", "pending")}
    total = F.count("*")
    return counted(rows).agg(
        total.alias("in_scope"),
        *(c.alias(s) for s, c in n.items()),
        T.safe_ratio(total - n["pending"], total).alias("coverage"),
        T.safe_ratio(n["translated"] + n["reviewed"], total).alias("fresh"),
        T.safe_ratio(n["reviewed"], total).alias("reviewed_ratio"),
    )


def file_status(rows: DataFrame) -> DataFrame:
    """path, status: stale if any counted symbol is, else translated if any isn't pending, else pending."""
    seen = F.col("translatable") | (F.col("status") != "pending")
    return rows.groupBy("path").agg(F.when(F.bool_or(seen & (F.col("status") == "stale")), "stale").when(F.bool_or(seen & (F.col("status") != "pending")), "translated").otherwise("pending").alias("status"))


def stale_kinds(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'stale'").select(F.explode("changed").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def group_coverage(rows: DataFrame, depth: int) -> DataFrame:
    """Counts by folder of a depth."""
    s = F.col("status")
    return counted(rows).groupBy(T.group_of(F.col("path"), depth).alias("grp")).agg(F.count_if(~s.isin("pending", "stale")).alias("done"), F.count_if(s == "stale").alias("stale"), F.count("*").alias("n"))


def queue(rows: DataFrame, which: str = "stale", prefix: str | None = None) -> DataFrame:
    """Symbols of a status with their place in the queue: by priority, then id."""
    picked = rows.where((F.col("status") == which) & (F.col("translatable") | F.lit(which != "pending")))
    if prefix:
        picked = picked.where(F.col("id").startswith(prefix))
    return picked.orderBy("priority", "id") if which == "stale" else picked.orderBy("id")


def path_of(id_: Column) -> Column:
    """The file of a symbol's id."""
    return F.substring_index(id_, "#", 1)


def merge(records: DataFrame, symbols: DataFrame, by: str, paths: DataFrame | None = None) -> DataFrame:
    """The records after an update, and dropped ones, each with its action and old_id. With paths (path), only of these files: all other records and symbols count for nothing and have no row.

    created: a new annotation, at the current hashes. refreshed: an edited one, its review gone. migrated: the record of a vanished
    symbol, by an equal annotation; each vanished record goes to one symbol, the first by path, then ord or start, as far as symbols have these, then id; of vanished records with equal annotations
    the one of the highest id is used. kept, dropped.
    """
    if paths is not None:
        records = records.withColumn("path", path_of(F.col("id"))).join(paths.select("path"), "path", "left_semi").select(*records.columns)
        symbols = symbols.join(paths.select("path"), "path", "left_semi")
    order = [c for c in ("path", "ord", "start") if c in symbols.columns]
    s, r = F.struct("id", *KINDS, "zh", *order).alias("s"), F.struct(*RECORD).alias("r")
    both = settled(symbols.select(F.col("id").alias("_id"), s).join(records.select(F.col("id").alias("_id"), r), "_id", "full_outer").select("s", "r"))  # every step below reads it
    gone, unowned = both.where("s IS NULL"), both.where("r IS NULL AND s.zh IS NOT NULL")
    heirs = gone.groupBy("r.zh").agg(F.max_by("r", "r.id").alias("heir"))
    first = F.min_by("s.id", F.struct(*(F.col(f"s.{c}") for c in order), "s.id"))
    moved = unowned.groupBy("s.zh").agg(first.alias("new_id")).join(heirs, "zh").select("new_id", "heir")
    rows = both.join(moved, F.col("s.id") == F.col("new_id"), "left").join(moved.select(F.col("heir.id").alias("taken")), F.col("r.id") == F.col("taken"), "left")

    inherits, annotated = F.col("new_id").isNotNull(), F.col("s.zh").isNotNull()
    action = (
        F.when(F.col("s").isNull(), F.when(F.col("taken").isNull(), "dropped"))
        .when(F.col("r").isNull(), F.when(inherits, "migrated").when(annotated, "created"))
        .when(~annotated, "dropped")
        .when(F.col("s.zh") == F.col("r.zh"), "kept")
        .otherwise("refreshed")
    )
    null = F.lit(None).cast("string")
    now = {"id": F.col("s.id"), **{f"at_{k}": F.col(f"s.{k}") for k in KINDS}, "zh": F.col("s.zh"), "by": F.lit(by)}
    inherited = {"id": F.col("s.id"), **{c: F.col(f"heir.{c}") for c in RECORD[1:]}}
    rows = rows.withColumn("action", action).where("action IS NOT NULL")
    fields = [F.when(F.col("action").isin("created", "refreshed"), now.get(c, null)).when(F.col("action") == "migrated", inherited[c]).otherwise(F.col(f"r.{c}")).alias(c) for c in RECORD]
    return rows.select(*fields, "action", F.when(inherits & (F.col("action") == "migrated"), F.col("heir.id")).alias("old_id"))


def approve(records: DataFrame, symbols: DataFrame, by: str) -> DataFrame:
    """The records after approving the annotated ones of symbols: confirmed at the current code, written by whom they were."""
    s = symbols.where(F.col("zh").isNotNull()).alias("s").join(records.alias("r"), F.col("s.id") == F.col("r.id"), "left")
    done = s.select("s.id", F.col("s.sig").alias("at_sig"), F.col("s.doc").alias("at_doc"), F.col("s.body").alias("at_body"), F.col("s.zh").alias("zh"), F.coalesce("r.by", F.lit(by)).alias("by"), F.col("s.sig").alias("review_sig"), F.col("s.doc").alias("review_doc"), F.col("s.body").alias("review_body"), F.col("s.zh").alias("review_zh"))
    return records.join(done.select("id"), "id", "left_anti").select(*RECORD).unionByName(done)


def chosen(symbols: DataFrame, ids: DataFrame, folders: list[str]) -> DataFrame:
    """The symbols of some ids (id) and of all files in some folders, each once: what to approve."""
    inside = F.lit(False)
    for folder in folders:
        inside = inside | F.col("path").startswith(folder.rstrip("/") + "/")
    return symbols.join(ids.select("id"), "id", "left_semi").unionByName(symbols.where(inside)).distinct()


def first_of(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in an order, each with `total`, how many there are."""
    return rows.orderBy(*order).limit(n).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row
