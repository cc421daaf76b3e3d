"""Differences between two snapshots, of files and of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (A, M, D) of files (path, text) that differ; only hashes are joined."""
    a, b = (x.select("path", F.xxhash64("text").alias(h), F.sha2(F.col("text"), 256).alias(f"{h}_")) for x, h in ((old, "a"), (new, "b")))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("a").isNull(), "A").when(F.col("b").isNull(), "D").when(F.col("a_") != F.col("b_"), "M")
    return both.select("path", change.alias("change")).where(F.col("change").isNotNull())


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change_type (added, removed, modified) and changed (kinds, comma-joined) of symbols (id, sig, doc, body)."""
    both = old.alias("a").join(new.alias("b"), F.col("a.id") == F.col("b.id"), "full_outer")
    kinds = F.array_compact(F.array(*(F.when(F.col(f"a.{k}") != F.col(f"b.{k}"), F.lit(k)) for k in ("sig", "doc", "body"))))
    kind = F.when(F.col("a.id").isNull(), "added").when(F.col("b.id").isNull(), "removed").when(F.size(kinds) > 0, "modified")
    return both.select(F.coalesce("a.id", "b.id").alias("id"), kind.alias("change_type"), F.when(kind == "modified", F.array_join(kinds, ",")).otherwise("").alias("changed")).where(F.col("change_type").isNotNull())


def rename_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id, new_id: removed and added symbols of equal kind and non-empty body, paired first with first.

    Both: id, kind, body, body_lines, ord.
    """
    key = Window.partitionBy("kind", "body").orderBy("ord")
    some = (F.col("kind") != "module") & (F.col("body_lines") > 0)
    removed = old.where(some).join(new.select("id"), "id", "left_anti").withColumn("rn", F.row_number().over(key))
    added = new.where(some).join(old.select("id"), "id", "left_anti").withColumn("rn", F.row_number().over(key))
    return removed.select("kind", "body", "rn", F.col("id").alias("old_id")).join(added.select("kind", "body", "rn", F.col("id").alias("new_id")), ["kind", "body", "rn"]).select("old_id", "new_id")


def diff_stats(diff: DataFrame, renames: DataFrame) -> DataFrame:
    """One row: symbols added, removed, modified and renamed; a rename is neither an addition nor a removal."""
    n = renames.agg(F.count("*").alias("renamed"))
    c = diff.agg(*(F.count_if(F.col("change_type") == t).alias(t) for t in ("added", "removed", "modified")))
    return c.crossJoin(F.broadcast(n)).select((F.col("added") - F.col("renamed")).alias("added"), (F.col("removed") - F.col("renamed")).alias("removed"), "modified", "renamed")


def numstat(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, added, deleted: lines that a file (path, text) has more or fewer of; moved lines count as neither. Files that don't differ are left out before any line is looked at."""
    from glosswork.operators.lines import explode_lines

    changed = snapshot_diff(old, new).select("path")
    sides = [explode_lines(x.select("path", "text").join(changed, "path", "left_semi")).select("path", "line", F.lit(n).alias("d")) for x, n in ((old, -1), (new, 1))]
    each = sides[0].unionByName(sides[1]).groupBy("path", "line").agg(F.sum("d").alias("d"))
    return each.groupBy("path").agg(F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("deleted"))
