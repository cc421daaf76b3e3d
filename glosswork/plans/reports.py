"""Reports: one-row status, the sync report's rows, the registry table, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators import notes, state
from glosswork.operators.verify import DEPENDENCY


def status_report(rows: DataFrame, docs: DataFrame | None = None, project: str = "", counts: DataFrame | None = None, orphaned: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """One row `report`: a status as JSON. rows: from state.derive(); docs: from notes.derive(); counts: lines.annotation_counts() of all files in scope, those without symbols too, which
    count as files by whether they have annotations; orphaned: records without a symbol; at: when it was made.
    """
    symbols = state.coverage(rows).select(F.struct("in_scope", "reviewed", "translated", "stale", "pending").alias("symbols"), *(F.round(c, 4).alias(c) for c in ("coverage", "fresh", "reviewed_ratio")))
    status = state.file_status(rows)
    if counts is not None:
        others = counts.join(status.select("path"), "path", "left_anti").select("path", F.when(F.col("n") > 0, "translated").otherwise("pending").alias("status"))
        status = status.unionByName(others)
    files = status.agg(F.struct(F.count("*").alias("in_scope"), *(F.count_if(F.col("status") == s).alias(s) for s in ("translated", "stale", "pending"))).alias("files"))
    kinds = state.stale_kinds(rows).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("stale_by_kind"))
    out = symbols.crossJoin(F.broadcast(files)).crossJoin(F.broadcast(kinds))  # one row each
    fields = ["symbols", "files", "stale_by_kind", "coverage", "fresh", "reviewed_ratio"]
    if docs is not None:
        out = out.crossJoin(F.broadcast(notes.summary(docs).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("docs"))))
        fields.append("docs")
    if counts is not None:
        out = out.crossJoin(F.broadcast(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("zh_lines"))))
        fields.append("zh_lines")
    if orphaned is not None:
        out = out.crossJoin(F.broadcast(orphaned.agg(F.count("*").alias("orphaned"))))
        fields.append("orphaned")
    made = [at.cast("string").alias("generated_at")] if at is not None else []
    return out.select(F.to_json(F.struct(F.lit(project).alias("project"), *made, *fields)).alias("report"))


# The sections of a sync report, in order.
SECTIONS = ("stale", "orphaned", "resolved", "relocated", "documents", "unsupported", "migrated", "modified", "added", "removed", "renamed", "dependencies", "commits")


def sync_report(
    diff: DataFrame,
    renames: DataFrame,
    rows: DataFrame,
    docs: DataFrame,
    commits: DataFrame,
    merged: DataFrame | None = None,
    placed: DataFrame | None = None,
    counts: DataFrame | None = None,
    most_commits: int = 500,
    dependency: str = DEPENDENCY,
) -> DataFrame:
    """section, key, text of a sync report, in the order of SECTIONS, then of keys.

    commits: pos, sha, title, path; the first `most_commits` are listed, and how many more there are. merged: from state.merge(), for dropped and migrated records. placed: from
    reattach.place(), for orphaned and relocated blocks and each file's counts of reattached, relocated and orphaned ones. counts: annotation_counts() of changed files that have no symbols.
    """
    line = lambda name, df, key, text: df.select(F.lit(name).alias("section"), key.alias("key"), text.cast("string").alias("text"))
    none = F.lit("")
    parts = [
        line("stale", rows.where("status = 'stale'"), F.concat_ws(" ", "priority", "id"), F.array_join("changed", ",")),
        line("documents", docs.where("status IN ('stale', 'broken')"), F.col("path"), F.col("status")),
        *(line(kind, diff.where(F.col("change_type") == kind), F.col("id"), F.col("changed")) for kind in ("modified", "added", "removed")),
        line("renamed", renames, F.col("old_id"), F.col("new_id")),
        line("dependencies", commits.where(F.col("path").rlike(dependency)).select("path").distinct(), F.col("path"), none),
    ]
    if merged is not None:
        parts += [line("orphaned", merged.where("action = 'dropped'"), F.col("id"), none), line("migrated", merged.where("action = 'migrated'"), F.col("old_id"), F.col("id"))]
    if placed is not None:
        lost = placed.where("outcome = 'orphaned'")
        parts.append(line("orphaned", lost, F.concat("id", F.lit(" @"), F.col("first")), F.col("n")))
        parts.append(line("relocated", placed.where("outcome = 'relocated'"), F.concat("id", F.lit(" @"), F.col("first")), F.col("at")))
        each = placed.groupBy("path").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("reattached", "relocated", "orphaned")))
        parts.append(line("resolved", each, F.col("path"), F.concat_ws(" ", "reattached", "relocated", "orphaned")))
    if counts is not None:
        parts.append(line("unsupported", counts.where("n > 0"), F.col("path"), F.col("n")))
    log = commits.select("pos", "sha", "title").distinct()
    parts.append(line("commits", log.orderBy("pos").limit(most_commits), F.format_string("%09d %s", F.col("pos").cast("int"), F.substring("sha", 1, 9)), F.col("title")))
    parts.append(line("commits", log.agg((F.count("*") - most_commits).alias("more")).where("more > 0"), F.lit("~"), F.col("more")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.orderBy(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")), "key", "text")


def markdown(report: DataFrame, title: str) -> DataFrame:
    """section, pos, line: a sync report as lines of Markdown, each section after a head with its number of entries; a reader sorts by section, then pos.

    pos counts within a section. Sections are numbered from 1, the title is section 0.
    """
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")).cast("int")
    entry = F.concat(F.lit("- `"), "key", F.lit("`"), F.when(F.col("text") != "", F.concat(F.lit(" "), "text")).otherwise(""))
    pos = F.row_number().over(Window.partitionBy("section").orderBy("key", "text")).cast("long")
    lines = report.select(place.alias("place"), pos.alias("pos"), entry.alias("line"))
    heads = report.groupBy("section").agg(F.count("*").alias("n")).select(place.alias("place"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("\n## "), "section", F.lit(" ("), "n", F.lit(")\n")).alias("line"))
    top = report.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(0).cast("long").alias("pos"), F.lit(f"# {title}").alias("line"))
    return top.unionByName(heads).unionByName(lines).withColumnRenamed("place", "section").orderBy("section", "pos")


def site_index(rows: DataFrame, depth: int = 3) -> DataFrame:
    """grp, files, html: for each folder of a depth a table of its annotated files, each with its progress, annotated and all symbols, reviewed and stale ones. rows: from state.derive()."""
    s = F.col("status")
    each = state.counted(rows).groupBy("path").agg(F.count("*").alias("n"), F.count_if(s != "pending").alias("done"), F.count_if(s == "reviewed").alias("reviewed"), F.count_if(s == "stale").alias("stale"))
    each = each.where("done > 0").withColumn("grp", T.group_of(F.col("path"), depth))
    name = F.when(F.startswith("path", F.concat("grp", F.lit("/"))), F.substring("path", F.length("grp") + 2, F.length("path"))).otherwise(F.col("path"))
    number = lambda c: F.when(F.col(c) > 0, F.col(c).cast("string")).otherwise("")
    share = F.round(F.col("done") * 100 / F.col("n")).cast("int").cast("string")
    cells = F.concat(
        F.lit("<tr><td><a href='src/"), T.escape_html(F.col("path")), F.lit(".html'>"), T.escape_html(name), F.lit("</a></td><td><i style='width:"), share, F.lit("%'></i></td><td>"),
        "done", F.lit(" / "), "n", F.lit("</td><td>"), number("reviewed"), F.lit("</td><td>"), number("stale"), F.lit("</td></tr>"),
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", cells.alias("row")))), lambda x: x["row"]), "\n")
    out = each.groupBy("grp").agg(F.count("*").alias("files"), listed.alias("rows"))
    return out.select("grp", "files", F.concat(F.lit("<h3>"), T.escape_html(F.col("grp")), F.lit("</h3><table>\n"), "rows", F.lit("\n</table>")).alias("html"))


def registry_table(rows: DataFrame) -> DataFrame:
    """One Markdown row a project of registry.status_rows()."""
    return rows.select("priority", "project", F.concat(F.lit("| "), F.concat_ws(" | ", "project", F.coalesce(F.col("coverage"), F.lit("—")), F.coalesce(F.col("zh_lines").cast("string"), F.lit("—"))), F.lit(" |")).alias("line")).orderBy("priority", "project")


def pages(files: DataFrame) -> DataFrame:
    """path, html of files (path, text): numbered rows, annotations marked."""
    row = F.transform(T.lines(F.col("text")), lambda l, i: F.concat(F.lit("<tr id='L"), i + 1, F.lit("'><td>"), i + 1, F.lit("</td><td class='"), F.when(T.is_annotation(l), "zh").otherwise("code"), F.lit("'>"), T.escape_html(l), F.lit("</td></tr>")))
    return files.select("path", F.concat(F.lit("<table>"), F.array_join(row, "\n"), F.lit("</table>")).alias("html"))
