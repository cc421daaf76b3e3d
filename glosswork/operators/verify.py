"""Invariant checks: a study text is its upstream text and whole-line annotations, nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators.lines import first_divergence
from glosswork.operators.placement import misplaced

# Folders and files of the overlay, and what only the study may add.
OVERLAY = r"^(?:\.study/|study/|\.github/workflows/study[^/]*$)"
DEPENDENCY = r"(?:^|/)(?:Cargo\.toml|Cargo\.lock|pyproject\.toml|package\.json|go\.mod|requirements[^/]*\.txt)$"


def path_class(path: Column, overlay: str = OVERLAY, generated: str = r"(?!)", dependency: str = DEPENDENCY) -> Column:
    return F.when(path.rlike(overlay), "overlay").when(path.rlike(generated), "generated").when(path.rlike(dependency), "dependency").otherwise("code")


def without_import(text: Column, line: str) -> Column:
    """text without its last line, if that is `line`, and the blank lines before that; without line feeds at the end."""
    plain = F.regexp_replace(text, r"\n*\z", "")
    told = F.regexp_replace(plain, rf"(?:(?:^|\n){T.WS_LINE}*)*(?:^|\n){T.WS_LINE}*\Q{line}\E{T.WS_LINE}*\z", "")
    return F.when(F.substring_index(plain, "\n", -1).rlike(rf"^{T.WS_LINE}*\Q{line}\E{T.WS_LINE}*\z"), told).otherwise(plain)


def issues(
    study: DataFrame,
    upstream: DataFrame,
    changed: DataFrame | None = None,
    overlay: str = OVERLAY,
    generated: str | None = None,
    tokens: tuple[str, ...] | None = None,
    added: str | None = None,
    imports: tuple[str, str] | None = None,
    placement: Callable[[DataFrame], DataFrame] | None = misplaced,
    elsewhere: DataFrame | None = None,
) -> DataFrame:
    """path, code, line, others of each file that breaks the invariant, by path: its first problem, where that is, and how many more there are.

    Both: path, text. changed: paths to look at, all if None. Only hashes are joined; texts are fetched for the paths on both sides whose hashes differ. In this order:
    new-file, deleted; generated (a path of that pattern differs); import-line (imports: a pattern of paths that may only gain one line at their end, and that line); unsupported (no comments);
    binary; code-modified (differs beside annotations); and, only where nothing does, what `placement` finds in a text (path, row, code), by row.
    added: a pattern of paths that only the study may have. tokens: comment tokens of all files; by their paths if None. elsewhere: more issues (path, code).
    """
    a, b = (x.select("path", F.xxhash64("text").alias(h), F.sha2("text", 256).alias(f"{h}_")) for x, h in ((study, "a"), (upstream, "b")))
    both = a.join(b, "path", "full_outer").where(~F.col("path").rlike(overlay))
    if changed is not None:
        both = both.join(changed.select("path"), "path", "left_semi")
    code = F.when(F.col("b_").isNull() & (~F.col("path").rlike(added) if added else F.lit(True)), "new-file").when(F.col("a_").isNull(), "deleted")
    nowhere, no_more = F.lit(None).cast("long").alias("line"), F.lit(0).cast("long").alias("others")
    alone = both.withColumn("code", code).where("code IS NOT NULL").select("path", "code", nowhere, no_more)
    differ = both.where((F.col("a") != F.col("b")) | (F.col("a_") != F.col("b_"))).select("path")
    texts = differ.join(study.select("path", F.col("text").alias("mine")), "path").join(upstream.select("path", F.col("text").alias("theirs")), "path")
    bare = T.strip_annotations(F.col("mine"), tokens) if tokens else T.by_path(F.col("path"), lambda t: T.strip_annotations(F.col("mine"), t))
    only_import = F.col("path").rlike(imports[0]) if imports else F.lit(False)
    code = (
        F.when(F.col("path").rlike(generated) if generated else F.lit(False), "generated")
        .when(only_import, F.when(without_import(F.col("mine"), imports[1] if imports else "") == F.regexp_replace("theirs", r"\n*\z", ""), "equal").otherwise("import-line"))
        .when(T.comment_pattern(F.col("path")).isNull(), "unsupported")
        .when(F.contains("mine", F.lit("\0")) | F.contains("theirs", F.lit("\0")), "binary")
        .when(bare == F.col("theirs"), "placed")
        .otherwise("code-modified")
    )
    judged = texts.withColumn("code", code)
    out = alone.unionByName(judged.where("code NOT IN ('equal', 'placed', 'code-modified')").select("path", "code", nowhere, no_more))
    bad = judged.where("code = 'code-modified'")
    where = first_divergence(bad.select("path", F.col("mine").alias("text")), bad.select("path", F.col("theirs").alias("text")), tokens)
    out = out.unionByName(bad.select("path", "code").join(where.select("path", "line"), "path", "left").select("path", "code", "line", no_more))
    if placement is not None:
        found = placement(judged.where("code = 'placed'").select("path", F.col("mine").alias("text")))
        out = out.unionByName(rolled_up(found.select("path", "code", (F.col("row") + 1).cast("long").alias("line"))))
    if elsewhere is not None:
        out = out.unionByName(elsewhere.select("path", "code", nowhere, no_more))
    return out.orderBy("path", "code")


def rolled_up(issues: DataFrame) -> DataFrame:
    """path, code, line of a file's first problem, by line, then code, and others, the number of its other ones. issues: path, code, line."""
    first = F.min_by(F.struct("code", "line"), F.struct(F.col("line").isNull(), "line", "code"))
    return issues.groupBy("path").agg(first.alias("f"), (F.count("*") - 1).alias("others")).select("path", "f.code", "f.line", "others")
