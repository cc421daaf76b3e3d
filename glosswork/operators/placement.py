"""Where annotations may not stand, told from rows alone: inside strings, in code blocks of documentation. All of it stays in the JVM.

Whether a string is open where a row begins depends on all rows before. Each row is a function from the state before it to the state after it, written as the list of its results, and
functions compose in any grouping. So rows are put together by blocks of `BLOCK`, blocks by blocks, and the states come back down the same way: no list is longer than a
block, but for one entry each `BLOCK * BLOCK` rows of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as T

#: Rows of a block, as a power of two.
BITS = 8
# How a string that may go on over the end of a row opens; the states are none of them and each of them in order.
OPENERS = ("'''", '"""', "'", '"')
_TRIPLE = r"""{q}{q}{q}[^{q}\\]*+(?:(?:\\.|{q}(?!{q}{q}))[^{q}\\]*+)*+(?:{q}{q}{q}|\\?\z)"""
_SINGLE = r"""{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+(?:{q}|\\?\z)"""
_TOKENS = "(?s)#.*|" + "|".join(p.format(q=q) for p in (_TRIPLE, _SINGLE) for q in "'\"")
_CLOSED = "(?s)^(?:" + "|".join(p.format(q=q).replace(r"|\\?\z)", ")") for p in (_TRIPLE, _SINGLE) for q in "'\"") + r")\z"


def string_state(line: Column) -> Column:
    """The state after a line of Python that begins in none: what its last string or comment leaves open. A string in single quotes goes on after a backslash only."""
    last = F.try_element_at(F.regexp_extract_all(line, F.lit(_TOKENS), F.lit(0)), F.lit(-1))
    open_ = F.when(last.startswith("'''"), 1).when(last.startswith('"""'), 2).when(last.rlike(r"(?s)^'.*(?<!\\)(?:\\\\)*\\\z"), 3).when(last.rlike(r'(?s)^".*(?<!\\)(?:\\\\)*\\\z'), 4)
    return F.when(last.isNull() | last.startswith("#") | last.rlike(_CLOSED), 0).otherwise(F.coalesce(open_, F.lit(0)))


def transitions(line: Column) -> Column:
    """array<int>: the state after a line for each state before it."""
    plain = F.array(*(F.lit(s) for s in (0, 1, 2, 0, 0)))
    each = F.array(*(string_state(F.concat(F.lit(o), line)) for o in ("", *(f"{o}_" for o in OPENERS))))
    return F.when(line.rlike(r"""['"\\]"""), each).otherwise(plain)


def _composed(entries: Column) -> Column:
    """The function of entries (struct of place and f) one after another."""
    return F.transform(F.sequence(F.lit(0), F.lit(len(OPENERS))), lambda s: F.aggregate(entries, s, lambda state, x: F.get(x["f"], state)))


def _before(entries: Column, state: Column) -> Column:
    """array<struct<place, state>>: the state before each entry."""
    none = F.array().cast("array<struct<place: bigint, state: int>>")
    step = lambda acc, x: F.struct(F.get(x["f"], acc["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(x["place"].alias("place"), acc["at"].alias("state")))).alias("out"))
    return F.aggregate(entries, F.struct(state.alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def scanned(rows: DataFrame, key: str = "path") -> DataFrame:
    """key, row, state before each row (key, row, f), f being a row's function; the first row of a key begins in state 0."""
    entry = F.array_sort(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "f"))).alias("entries")
    up = lambda level: level.select(key, F.shiftright("place", BITS).alias("over"), "place", "f").groupBy(key, "over").agg(entry)
    blocks = up(rows.select(key, F.col("row").cast("long").alias("place"), "f"))
    wider = up(blocks.select(key, F.col("over").alias("place"), _composed(F.col("entries")).alias("f")))
    whole = wider.select(key, F.col("over").alias("place"), _composed(F.col("entries")).alias("f")).groupBy(key).agg(entry)
    states = whole.select(key, F.explode(_before(F.col("entries"), F.lit(0))).alias("s"))
    for level in (wider, blocks):
        states = states.select(key, F.col("s.place").alias("over"), F.col("s.state").alias("state")).join(level, [key, "over"]).select(key, F.explode(_before(F.col("entries"), F.col("state"))).alias("s"))
    return states.select(key, F.col("s.place").alias("row"), F.col("s.state").alias("state"))


def open_strings(lines: DataFrame) -> DataFrame:
    """path, row of the rows of Python files (path, row, line) that begin inside a string."""
    return scanned(lines.select("path", "row", transitions(F.col("line")).alias("f"))).where("state > 0").select("path", "row")


def comment_runs(lines: DataFrame, tokens: tuple[str, ...] = ("///", "//!")) -> DataFrame:
    """lines (path, row, line) with token (the comment token a row begins with, or null), run (the rows of one token that stand together; null without one)
    and fenced: whether a code fence is open above it in its run."""
    head = F.substring(F.regexp_replace("line", r"^[ \t]+", ""), 1, 3)
    own = Window.partitionBy("path").orderBy("row")
    rows = lines.withColumn("token", F.when(head.isin(*tokens), head))
    rows = rows.withColumn("_new", (~F.col("token").eqNullSafe(F.lag("token").over(own))).cast("int"))
    rows = rows.withColumn("run", F.when(F.col("token").isNotNull(), F.sum("_new").over(own)))
    fence = F.col("line").rlike(r"^[ \t]*" + f"(?:{'|'.join(tokens)})" + rf"{T.WS}*```").cast("int")
    above = F.sum(fence).over(Window.partitionBy("path", "run").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("fenced", F.col("run").isNotNull() & (F.coalesce(above, F.lit(0)) % 2 == 1)).drop("_new")


def leading_comments(lines: DataFrame, items: DataFrame, tokens: tuple[str, ...] = T.HASH) -> DataFrame:
    """path, row, first: the first row of the whole-line comments right above each item (path, row), or the item's row if there are none. Blank rows end them."""
    comment = T.strip(F.col("line")).rlike("^(?:" + "|".join(tokens) + ")")
    rows = lines.select("path", "row", comment.alias("comment"))
    last = F.last(F.when(~F.col("comment"), F.col("row")), True).over(Window.partitionBy("path").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("first", F.coalesce(last + 1, F.lit(0))).join(items.select("path", "row"), ["path", "row"]).select("path", "row", F.col("first").cast("long").alias("first"))


def misplaced(files: DataFrame, bodies: DataFrame | None = None, marker: str = T.MARKER) -> DataFrame:
    """path, row, code of annotations that change something: zh-in-string in Python, zh-in-code-block and doc-in-body in Rust.

    files: path, text. bodies: path, start, end, the rows inside Rust functions; without them doc-in-body isn't looked for. Only files with an annotation are parted into rows.
    """
    some = files.where(F.contains("text", F.lit(marker)))
    python, rust = F.col("path").rlike(r"\.pyi?$"), F.col("path").endswith(".rs")
    rows = lambda which: some.where(which).select("path", F.posexplode(T.lines(F.col("text"))).alias("row", "line"))
    lines = rows(python)
    notes = lines.where(T.is_annotation(F.col("line"), T.HASH, marker)).select("path", F.col("row").cast("long").alias("row"))
    found = notes.join(open_strings(lines), ["path", "row"]).select("path", "row", F.lit("zh-in-string").alias("code"))
    docs = comment_runs(rows(rust)).where(F.col("token").isNotNull() & T.is_annotation(F.col("line"), T.SLASH, marker)).select("path", F.col("row").cast("long").alias("row"), "fenced")
    found = found.unionByName(docs.where("fenced").select("path", "row", F.lit("zh-in-code-block").alias("code")))
    if bodies is not None:
        inside = docs.alias("d").join(bodies.alias("b"), (F.col("d.path") == F.col("b.path")) & F.col("d.row").between(F.col("b.start"), F.col("b.end")), "left_semi")
        found = found.unionByName(inside.select("path", "row", F.lit("doc-in-body").alias("code")))
    return found
