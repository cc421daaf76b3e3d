"""Texts as relations of lines. Windows run within one file, so no task sees more than a file's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as T


def explode_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """files with (row, line) instead of text; rows from 0."""
    others = [c for c in files.columns if c != text]
    return files.select(*others, F.posexplode(T.lines(F.col(text))).alias("pos", "line")).select(*others, F.col("pos").cast("long").alias("row"), "line")


def lines_with_above(files: DataFrame, text: str = "text") -> DataFrame:
    """explode_lines() with above, the line before (null in the first row), from the text itself, so that no rows travel."""
    others = [c for c in files.columns if c != text]
    both = F.transform("_lines", lambda line, i: F.struct(line.alias("line"), F.get("_lines", i - 1).alias("above")))
    rows = files.select(*others, T.lines(F.col(text)).alias("_lines")).select(*others, F.posexplode(both).alias("pos", "_l"))
    return rows.select(*others, F.col("pos").cast("long").alias("row"), "_l.line", "_l.above")


def annotation_rows(lines: DataFrame, tokens: tuple[str, ...] = T.HASH) -> DataFrame:
    return lines.where(T.is_annotation(F.col("line"), tokens))


def annotation_counts(files: DataFrame, marker: str = T.MARKER) -> DataFrame:
    """path, n: how many rows of each file (path, text) are annotations, by the comment tokens its path allows; files without such have no row."""
    found = T.by_path(F.col("path"), lambda t: F.regexp_count("text", F.lit(rf"(?dm)^{T.marker_pattern(t, marker)}")))
    return files.select("path", found.cast("long").alias("n")).where("n IS NOT NULL")


def blocks(rows: DataFrame, *key: str) -> DataFrame:
    """Runs of consecutive rows: key, first, last, n."""
    island = F.col("row") - F.row_number().over(Window.partitionBy(*key).orderBy("row"))
    return rows.withColumn("_island", island).groupBy(*key, "_island").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.count("*").alias("n")).drop("_island")


def dyadic(start: Column, end: Column) -> Column:
    """array<struct<level, block>>: the fewest aligned blocks of 2**level rows that make up the rows start to end."""
    levels = F.sequence(F.lit(0), F.ceil(F.log2((end - start + 2).cast("double"))).cast("int"))

    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        low, high = F.call_function("shiftright", start + size - 1, k), F.call_function("shiftright", end + 1, k)
        inside = low < high
        left = F.when(inside & (low % 2 == 1), F.struct(k.alias("level"), low.alias("block")))
        right = F.when(inside & (high % 2 == 1), F.struct(k.alias("level"), (high - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(levels, at))


def innermost(symbols: DataFrame) -> DataFrame:
    """path, row, id: from each row on, up to the path's next one, the innermost symbol (path, id, start, end, ord), or null where none is.

    Innermost is the shortest, of equals the one with the lowest ord. Symbols are cut into aligned blocks, at most two a size, of which each keeps its innermost symbol; a row looks
    into the one block of each size that it lies in. So nothing grows with rows times symbols, and the parts of a long file lie under many keys. Symbols may cross.
    """
    own = symbols.select("path", "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "ord").where("start <= end")
    rank = F.struct((F.col("end") - F.col("start")).alias("size"), "ord", "id")
    blocks = own.select("path", rank.alias("rank"), F.explode(dyadic(F.col("start"), F.col("end"))).alias("b")).groupBy("path", "b.level", "b.block").agg(F.min("rank").alias("rank"))
    deep = own.groupBy("path").agg(F.ceil(F.log2(F.max(F.col("end") - F.col("start") + 2).cast("double"))).cast("int").alias("deep"))
    changes = own.select("path", F.explode(F.array(F.col("start"), F.col("end") + 1)).alias("row")).distinct().join(deep, "path")
    looks = changes.select("path", "row", F.explode(F.sequence(F.lit(0), F.col("deep"))).alias("level")).withColumn("block", F.call_function("shiftright", F.col("row"), F.col("level")))
    return looks.join(blocks, ["path", "level", "block"], "left").groupBy("path", "row").agg(F.min("rank")["id"].alias("id"))


def nearest(asked: DataFrame, points: DataFrame, key: list[str], ident: list[str]) -> DataFrame:
    """ident, found: of the points (key, row) with the key of an asked row (ident, key, low, high, want), the one nearest to `want` from low to high; of two as near the lower.

    An as-of search in both directions: points and asked rows lie in one order, each takes the last point before it, and in the other order the next one. Time is that of a sort,
    however many points share a key. Asked rows without such a point have no row.
    """
    asked = asked.select(*dict.fromkeys([*ident, *key]), *(F.col(c).cast("long").alias(c) for c in ("low", "high", "want")))
    down = asked.withColumn("_at", F.least("want", "high")).withColumn("_way", F.lit(1))
    up = asked.withColumn("_at", F.greatest("want", "low")).withColumn("_way", F.lit(2))
    there = points.select(*key, F.col("row").cast("long").alias("_at"), F.lit(0).alias("_way"))
    both = down.unionByName(up).unionByName(there, allowMissingColumns=True)
    point = F.when(F.col("_way") == 0, F.col("_at"))
    before = F.last(point, True).over(Window.partitionBy(*key).orderBy("_at", "_way").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(point, True).over(Window.partitionBy(*key).orderBy(F.desc("_at"), "_way").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("_before", before).withColumn("_after", after).withColumn("_met", F.when(F.col("_way") == 1, F.col("_before")).when(F.col("_way") == 2, F.col("_after")))
    met = met.where(F.col("_met").between(F.col("low"), F.col("high")))
    return met.groupBy(*ident).agg(F.min_by("_met", F.struct(F.abs(F.col("_met") - F.col("want")), "_met")).alias("found"))


def owner_join(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, row, id of the innermost symbol (path, id, start, end, ord) around each row (path, row); the file's own symbol if none.

    Rows take the last change of owner before them, in one sorted pass over a file's rows and changes.
    """
    changes = innermost(symbols).select("path", F.col("row").cast("long").alias("row"), F.struct("id").alias("owner"), F.lit(0).alias("asks"))
    both = changes.unionByName(rows.select("path", F.col("row").cast("long").alias("row"), F.lit(None).cast("struct<id: string>").alias("owner"), F.lit(1).alias("asks")))
    last = F.last("owner", True).over(Window.partitionBy("path").orderBy("row", "asks").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("id", last["id"]).where("asks = 1")
    return found.select("path", "row", F.coalesce("id", F.concat("path", F.lit("#<module>"))).alias("id"))


def fingerprint(lines: DataFrame, *key: str) -> DataFrame:
    """key, n_lines and the hash of a file's lines put together again in order."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(*key).agg(F.count("*").alias("n_lines"), T.short_sha(whole).alias("sha"))


def first_divergence(study: DataFrame, upstream: DataFrame, tokens: tuple[str, ...] | None = None) -> DataFrame:
    """path, line (from 1, of the study text), study_line, upstream_line of the first difference beside annotations; equal files have no row.

    Both: path, text. tokens: comment tokens of all files; by their paths if None.
    """

    def note(line: Column) -> Column:
        return T.is_annotation(line, tokens) if tokens else F.coalesce(T.by_path(F.col("path"), lambda t: T.is_annotation(line, t)), F.lit(False))

    def kept(files: DataFrame) -> DataFrame:
        ends = F.transform(T.lines(F.col("text")), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), (i < F.size(T.lines(F.col("text"))) - 1).alias("ended")))
        return files.select("path", F.filter(ends, lambda x: x["ended"] | (x["line"] != "")).alias("ls"))

    a = kept(study).select("path", F.size("ls").alias("size"), F.filter("ls", lambda x: ~note(x["line"])).alias("ls"))
    b = kept(upstream).select("path", F.col("ls").alias("up"))
    pairs = a.join(b, "path").select("path", "size", F.explode(F.arrays_zip("ls", "up")).alias("p")).select("path", F.col("size"), F.col("p.ls").alias("s"), F.col("p.up").alias("u"))
    ordered = pairs.where(~F.struct("s.line", "s.ended").eqNullSafe(F.struct("u.line", "u.ended")))
    place = F.coalesce(F.col("s.line_no"), F.col("size") + 1)
    first = ordered.groupBy("path").agg(F.min_by(F.struct(place.alias("line"), F.coalesce("s.line", F.lit("<EOF>")).alias("study_line"), F.coalesce("u.line", F.lit("<EOF>")).alias("upstream_line")), F.struct(place, F.coalesce("u.line_no", F.lit(1 << 30)))).alias("d"))
    return first.select("path", F.col("d.line").cast("long").alias("line"), "d.study_line", "d.upstream_line")


def paragraphs(lines: DataFrame, *key: str) -> DataFrame:
    """Wrapped lines joined: key, number, text. A blank line or a list item begins a new one; a space goes only between two ASCII word ends."""
    item = F.col("line").rlike(r"^(?:[-*•]|\d+[.、)])[ \t]")
    own = Window.partitionBy(*key).orderBy("row")
    rows = lines.withColumn("_new", ((F.col("line") == "") | item | (F.coalesce(F.lag("line").over(own), F.lit("")) == "")).cast("int"))
    rows = rows.withColumn("_group", F.sum("_new").over(own)).where(F.col("line") != "")
    rows = rows.withColumn("_gap", F.when((F.col("_new") == 0) & F.coalesce(F.lag("line").over(own), F.lit("")).rlike("[A-Za-z0-9`]$") & F.col("line").rlike("^[A-Za-z0-9`]"), " ").otherwise(""))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", F.concat("_gap", "line").alias("t")))), lambda x: x["t"]), "")
    out = rows.groupBy(*key, "_group").agg(F.min("row").alias("_row"), text.alias("text"))
    return out.withColumn("number", F.row_number().over(Window.partitionBy(*key).orderBy("_row")).cast("long")).select(*key, "number", "text")
