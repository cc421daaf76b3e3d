"""Planning annotation work, and taking in what came back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as T


def identifiers(texts: DataFrame, key: str) -> DataFrame:
    """key, name, n, first: how often each CamelCase identifier is in a text, and where among all it is first."""
    found = texts.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(f"({T.IDENTIFIER})"), F.lit(1))).alias("pos", "name"))
    return found.groupBy(key, "name").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first"))


def type_refs(uses: DataFrame, types: DataFrame, most: int = 12) -> DataFrame:
    """path, name, defined_in, n: the most used foreign types of a file, `most` of them; a name that several files define, or the file itself, is left out.
    Of names used as often the one that is used first comes first.

    uses: path, name, n, first. types: name, path.
    """
    one = types.groupBy("name").agg(F.min("path").alias("lo"), F.max("path").alias("hi")).where("lo = hi").select("name", F.col("lo").alias("defined_in"))
    local = types.select("name", "path").distinct()
    rows = uses.join(one, "name").join(local, ["name", "path"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "first"))
    return rows.withColumn("_n", rank).where(F.col("_n") <= most).select("path", "name", "defined_in", "n")


def requests(targets: DataFrame, size: int = 20, files: int | None = None) -> DataFrame:
    """path, id, chunk: targets (path, id, status, start) dealt into requests of `size`, stale ones first; of the first `files` files only."""
    order = Window.partitionBy("path").orderBy(F.col("status") != "stale", "start", "id")
    rows = targets.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / size).cast("long"))
    if files:
        chosen = targets.select("path").distinct().orderBy("path").limit(files)
        rows = rows.join(chosen, "path", "left_semi")
    return rows.select("path", "id", "chunk")


def token_estimate(chunks: DataFrame) -> DataFrame:
    """path, fresh, cached: a file's tokens (a third of its bytes) for its first request, and again for each later one. chunks: path, text, chunk."""
    size = F.floor(F.octet_length("text") / 3)
    return chunks.groupBy("path").agg(F.sum(F.when(F.col("chunk") == 0, size).otherwise(0)).alias("fresh"), F.sum(F.when(F.col("chunk") > 0, size).otherwise(0)).alias("cached"))


def collect_responses(responses: DataFrame, sent: DataFrame, current: DataFrame) -> DataFrame:
    """path, outcome of each response (path, body): ok, unknown (never sent), changed (the file is another now), unreadable (no JSON)."""
    read = F.try_parse_json("body").isNotNull()
    rows = responses.join(sent.select("path", F.col("sha").alias("was")), "path", "left").join(current.select("path", F.col("sha").alias("now")), "path", "left")
    outcome = F.when(F.col("was").isNull(), "unknown").when(~read, "unreadable").when(~F.col("was").eqNullSafe(F.col("now")), "changed").otherwise("ok")
    return rows.select("path", outcome.alias("outcome"))


def apply_patch(files: DataFrame, edits: DataFrame, tokens: tuple[str, ...] = T.HASH, symbols: DataFrame | None = None) -> DataFrame:
    """path, outcome (applied, rejected), text: files (path, text) with the lines of edits (path, row, seq, line) inserted before rows.

    All or nothing for a file: an edit at a blank line, an annotation or no line at all rejects it, and so does a result that isn't the old text after stripping.
    With symbols (path, id, start, end, zh_rows), edits have a column symbol and a bad edit, also one outside its symbol, rejects that symbol only;
    the old annotations of accepted symbols, their zh_rows, go, and a column rejected lists the other symbols. A file none of whose symbols is accepted is rejected.
    """
    lines = files.select("path", F.posexplode(T.lines(F.col("text"))).alias("row", "there"))
    aimed = (edits if symbols is not None else edits.withColumn("symbol", F.lit(""))).join(lines, ["path", "row"], "left")
    bad = F.col("there").isNull() | (T.strip(F.col("there")) == "") | T.is_annotation(F.col("there"), tokens) | ~T.is_annotation(F.col("line"), tokens)
    if symbols is not None:
        own = symbols.select("path", F.col("id").alias("symbol"), F.col("start").alias("_start"), F.col("end").alias("_end"))
        aimed = aimed.join(own, ["path", "symbol"], "left")
        bad = F.coalesce(bad | ~F.col("row").between(F.col("_start"), F.col("_end")), F.lit(True))
    judged = aimed.groupBy("path", "symbol").agg(F.bool_or(bad).alias("bad"))
    accepted = judged.where("NOT bad").select("path", "symbol")
    good = aimed.join(accepted, ["path", "symbol"], "left_semi").select("path", F.struct(F.col("row").cast("long").alias("a"), F.col("seq").cast("long").alias("b")).alias("k"), F.concat(T.indent(F.col("there")), "line").alias("line"))
    rows = lines.join(accepted.select("path"), "path", "left_semi")
    if symbols is not None:
        old = symbols.withColumnRenamed("id", "symbol").join(accepted, ["path", "symbol"], "left_semi").select("path", F.explode("zh_rows").alias("row"))
        rows = rows.join(old, ["path", "row"], "left_anti")
    rows = rows.select("path", F.struct(F.col("row").cast("long").alias("a"), F.lit((1 << 62)).alias("b")).alias("k"), F.col("there").alias("line")).unionByName(good)
    made = rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("made"))
    told = judged.groupBy("path").agg(F.bool_and("bad").alias("bad"), F.sort_array(F.collect_set("symbol")).alias("every"), F.sort_array(F.collect_set(F.when(F.col("bad"), F.col("symbol")))).alias("lost"))
    out = files.join(told, "path").join(made, "path", "left")
    ok = ~F.col("bad") & (T.strip_annotations(F.col("made"), tokens) == T.strip_annotations(F.col("text"), tokens))
    more = [F.when(ok, F.col("lost")).otherwise(F.col("every")).alias("rejected")] if symbols is not None else []
    return out.select("path", F.when(ok, "applied").otherwise("rejected").alias("outcome"), F.when(ok, F.col("made")).otherwise(F.col("text")).alias("text"), *more)


def heads(definitions: DataFrame, most: int = 30, mark: str = "…") -> DataFrame:
    """definitions with text cut to its first lines, and a mark where there are more."""
    ls = T.lines(F.col("text"))
    cut = F.concat(F.array_join(F.slice(ls, 1, most), "\n"), F.lit(f"\n{mark}"))
    return definitions.withColumn("text", F.when(F.size(ls) > most, cut).otherwise(F.col("text")))


def clipped(rows: DataFrame, column: str, most: int) -> DataFrame:
    """rows with a text cut to its first `most` characters: what of a long text or difference goes into a request."""
    return rows.withColumn(column, F.left(column, F.lit(most)))


def merged_chunks(answers: DataFrame) -> DataFrame:
    """path, annotations: of a file's answers (path, chunk, annotations array) all annotations, in order of the chunks."""
    each = F.sort_array(F.collect_list(F.struct("chunk", "annotations")))
    return answers.groupBy("path").agg(F.flatten(F.transform(each, lambda x: x["annotations"])).alias("annotations"))


def hook_paths(payloads: DataFrame) -> DataFrame:
    """tool, path (relative to the working folder) of hook payloads (body: JSON); null for a file elsewhere, no row for one without a file."""
    told = F.from_json("body", "tool_name string, tool_input struct<file_path: string>, cwd string")
    rows = payloads.select(told.alias("p")).where("p.tool_input.file_path IS NOT NULL")
    folder = F.concat(F.regexp_replace(F.coalesce("p.cwd", F.lit("")), "/+$", ""), F.lit("/"))
    file = F.col("p.tool_input.file_path")
    path = F.when(~file.startswith("/"), file).when(F.startswith(file, folder), F.substring(file, F.length(folder) + 1, F.length(file)))
    return rows.select(F.col("p.tool_name").alias("tool"), path.alias("path"))
