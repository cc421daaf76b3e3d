"""Roll-ups over many projects, and the commit graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.sources.tables import settled


def behind(tags: DataFrame, anchors: DataFrame, pattern: str = r"^v\d+\.\d+\.\d+$") -> DataFrame:
    """project, ref, latest, behind: of a project's tags (project, tag) that fit the pattern, the newest and the number newer than ref."""
    fit = tags.where(F.col("tag").rlike(pattern)).withColumn("_k", T.version_key(F.col("tag")))
    rows = anchors.join(fit, "project", "left")
    return rows.groupBy("project", "ref").agg(F.max_by("tag", F.struct("_k", "tag")).alias("latest"), F.count_if(F.col("_k") > T.version_key(F.col("ref"))).alias("behind"))


def version_rank(tags: DataFrame) -> DataFrame:
    """tag, rank by version; equal versions share one."""
    k = tags.select("tag").distinct().withColumn("_k", T.version_key(F.col("tag")))
    return k.withColumn("major", F.get("_k", F.lit(0))).withColumn("rank", F.dense_rank().over(Window.partitionBy("major").orderBy("_k")).cast("long")).select("tag", "major", "rank")


def tree(projects: DataFrame, categories: DataFrame) -> DataFrame:
    """category, pos, project: projects (project, categories array) under their categories (id, name, pos); an unknown category keeps its key and comes last."""
    rows = projects.select("project", F.explode("categories").alias("id")).join(categories, "id", "left")
    return rows.select(F.coalesce("name", "id").alias("category"), "pos", "project").orderBy(F.asc_nulls_last("pos"), "category", "project")


def lifted(parents: DataFrame) -> list[DataFrame]:
    """Tables (sha, up): one parent of each commit that has any, then the parent's parent, then 4, 8, ... steps up. A line of n commits takes log n tables; they can be kept and used again."""
    first = parents.groupBy("sha").agg(F.min("parent").alias("up"))
    levels = [settled(first)]
    while True:
        last = levels[-1]
        above = last.select(F.col("sha").alias("up"), F.col("up").alias("_up"))
        more = settled(last.join(above, "up").select("sha", F.col("_up").alias("up")))
        if not more.limit(1).count():
            return levels
        levels.append(more)


def ancestors(parents: DataFrame, of: DataFrame, levels: list[DataFrame] | None = None) -> DataFrame:
    """sha, ancestor for each commit of `of` (sha), itself included; parents: sha, parent. levels: from lifted(parents).

    From what is new, the line of single parents above it is taken whole, by steps of 1, 2, 4, ...; then the other parents of all on it are what is new. So rounds follow how deep side branches
    nest, and joins in a round the logarithm of the longest line, not the number of commits.
    """
    levels = levels if levels is not None else lifted(parents)
    first = levels[0].withColumnRenamed("up", "parent")
    others = settled(parents.select("sha", "parent").distinct().join(first, ["sha", "parent"], "left_anti").select(F.col("sha").alias("ancestor"), "parent"))
    known, new = None, settled(of.select("sha", F.col("sha").alias("ancestor")).distinct())
    while new.limit(1).count():
        line = new
        for level in levels:
            further = line.join(level.select(F.col("sha").alias("ancestor"), "up"), "ancestor").select("sha", F.col("up").alias("ancestor"))
            if known is not None:
                further = further.join(known, ["sha", "ancestor"], "left_anti")
            line = settled(line.unionByName(further).distinct())
        known = line if known is None else settled(known.unionByName(line).distinct())
        beside = line.join(others, "ancestor").select("sha", F.col("parent").alias("ancestor")).distinct()
        new = settled(beside.join(known, ["sha", "ancestor"], "left_anti"))
    return known if known is not None else new


def is_ancestor(parents: DataFrame, pairs: DataFrame, levels: list[DataFrame] | None = None) -> DataFrame:
    """old, new, yes: whether the first of each pair of commits (old, new) can be reached from the second."""
    reached = ancestors(parents, pairs.select(F.col("new").alias("sha")), levels).select(F.col("sha").alias("new"), F.col("ancestor").alias("old"), F.lit(True).alias("yes"))
    return pairs.join(reached, ["old", "new"], "left").select("old", "new", F.coalesce("yes", F.lit(False)).alias("yes"))


def commit_range(parents: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """sha of the commits that new (sha) has and old (sha) hasn't, merges left out."""
    step = settled(parents.select("sha", "parent").distinct())
    levels = lifted(step)
    merges = step.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select("sha")
    mine, theirs = (ancestors(step, x, levels).select(F.col("ancestor").alias("sha")).distinct() for x in (new, old))
    return mine.join(theirs, "sha", "left_anti").join(merges, "sha", "left_anti")


def status_rows(projects: DataFrame, status: DataFrame) -> DataFrame:
    """Registry rows in order: priority (99 if none), then project; coverage as a percentage, a dash where there is none."""
    percent = F.when(F.col("coverage").isNull(), "—").otherwise(F.format_string("%.1f%%", F.col("coverage") * 100))
    return projects.join(status, "project", "left").select("project", F.coalesce("priority", F.lit(99)).alias("priority"), percent.alias("coverage"), "zh_lines").orderBy("priority", "project")


def remote_status(landed: DataFrame) -> DataFrame:
    """project, coverage, zh_lines, ok of status files that were fetched (project, attempt, body): the first attempt that is JSON with a coverage counts, else none."""
    told = F.from_json("body", "coverage double, zh_lines long")
    good = landed.select("project", "attempt", told.alias("t"))
    best = F.min_by("t", F.when(F.col("t.coverage").isNotNull(), F.col("attempt")))
    return good.groupBy("project").agg(best.alias("t")).select("project", "t.coverage", "t.zh_lines", F.col("t.coverage").isNotNull().alias("ok"))


def onboard(projects: DataFrame, entry: DataFrame) -> DataFrame:
    """projects with the entries whose id is new; those that are there stay as they are."""
    return projects.unionByName(entry.join(projects.select("project"), "project", "left_anti"), allowMissingColumns=True)
