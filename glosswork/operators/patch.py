"""Annotations put into files, a file at a time: all that a symbol gets, or none of it, and nothing at all where the result breaks an invariant.

Slots, tokens and margins are told from rows joined by (path, row); the file's own documentation slot from its rows as an array, once a file. What several steps
read, rows, judged annotations and made texts, is written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators import verify
from glosswork.operators.lines import explode_lines
from glosswork.sources.tables import settled

MODULE = "#<module>"
ANSWERS = "path string, sha string, n int, symbol string, placement string, line int, text array<string>"


def cleaned(text: Column, marker: str = T.MARKER) -> Column:
    """What an answer's line says, without a comment token and a marker before it."""
    bare = T.strip(F.regexp_replace(T.strip(text), "^(?:///|//!|//|#)", ""))
    return F.when(F.startswith(bare, F.lit(marker)), T.strip(F.substring(bare, F.lit(len(marker) + 1), F.length(bare)))).otherwise(bare)


def _first(rows: Column, test, start: Column) -> Column:
    """The first place from start on whose row passes a test (row, place); the number of rows if none does."""
    found = F.array_min(F.transform(rows, lambda x, i: F.when((i >= start) & test(x, i), i)))
    return F.coalesce(found, F.size(rows))


def module_slots(files: DataFrame, marker: str = T.MARKER) -> DataFrame:
    """path, row, token of the slot for a file's own documentation; row is -1 where text would attach to what follows, or the docstring isn't closed. files: path, text.

    Rust: after the last inner documentation line, else after the licence. Others: after the leading comments and, in Python, the docstring, and only before a blank row or the end.
    """
    rows = files.select("path", T.lines(F.col("text")).alias("ls"), F.col("path").endswith(".rs").alias("rust"), (T.comment_pattern(F.col("path")) == "#").alias("hash"))
    ls, bare = F.col("ls"), lambda x: F.regexp_replace(x, f"^{T.WS}+", "")
    note = lambda x: F.when(F.col("hash"), T.is_annotation(x, T.HASH, marker)).otherwise(T.is_annotation(x, T.SLASH, marker))
    inner = F.array_max(F.transform(ls, lambda x, i: F.when(F.startswith(x, F.lit("//!")) & ~note(x), i)))
    licence = _first(ls, lambda x, _: ~x.rlike(r"^//(?![/!])"), F.lit(0))
    rust = F.coalesce(inner + 1, licence)
    head = _first(ls, lambda x, _: ~bare(x).rlike(r"^#") & F.col("hash") | ~F.col("hash") & ~bare(x).rlike(r"^(?://|/\*|\*)"), F.lit(0))
    rows = rows.withColumn("rust_row", rust).withColumn("head", head)
    there = F.coalesce(F.get("ls", F.col("head")), F.lit(""))
    quote = F.when(F.contains(there, F.lit('"""')), '"""').otherwise("'''")
    opens = F.col("hash") & bare(there).rlike("""^(?:\"\"\"|'''|r\"\"\")""")
    rows = rows.withColumn("quote", quote).withColumn("opens", opens).withColumn("whole", F.size(F.split(there, quote)) > 2)
    closed = _first(F.col("ls"), lambda x, _: F.contains(x, F.col("quote")), F.col("head") + 1) + 1
    rows = rows.withColumn("after", F.when(~F.col("opens"), F.col("head")).when(F.col("whole"), F.col("head") + 1).otherwise(closed))
    rows = rows.withColumn("slot", _first(F.col("ls"), lambda x, _: ~note(x), F.col("after")))
    blank = T.strip(F.coalesce(F.get("ls", F.col("slot")), F.lit(""))) == ""
    slot = F.when(F.col("rust"), F.col("rust_row")).when(blank & (F.col("after") <= F.size("ls")), F.col("slot")).otherwise(-1)
    return rows.select("path", slot.cast("long").alias("row"), F.when(F.col("rust"), "//!").when(F.col("hash"), "#").otherwise("//").alias("token"))


def _rows(files: DataFrame, marker: str) -> DataFrame:
    """path, row, line, zh, blank, before (the nearest row above that is no annotation), doc (the last outer documentation row down to here)."""
    own = Window.partitionBy("path").orderBy("row")
    rows = explode_lines(files).withColumn("zh", F.coalesce(T.by_path(F.col("path"), lambda t: T.is_annotation(F.col("line"), t, marker)), F.lit(False)))
    bare = F.regexp_replace("line", f"^{T.WS}+", "")
    doc = F.when(bare.startswith("///") & ~bare.startswith("////") & ~F.col("zh"), F.col("row"))
    return rows.select(
        "path", "row", "line", "zh", (T.strip(F.col("line")) == "").alias("blank"), bare.alias("bare"),
        F.last(F.when(~F.col("zh"), bare), True).over(own.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.last(doc, True).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("doc"),
    )


def apply(files: DataFrame, answers: DataFrame, symbols: DataFrame, upstream: DataFrame, targets: DataFrame | None = None, marker: str = T.MARKER, placement=verify.misplaced) -> DataFrame:
    """path, outcome, applied, rejected (array<struct<symbol, reason>>), text of each file that has answers (ANSWERS: an annotation each, n their order).

    files, upstream: path, text. symbols: path, id, start, end, item_row, zh_rows; the file's own id ends in #<module>. targets: path, id of symbols that were asked for; all if None.
    placement `doc` puts text into the symbol's documentation slot, anything else before a line (from 1) of its own.

    outcome: changed (the file isn't what the answer's sha was of), unsupported (no comments or no symbols), applied, unchanged (no symbol was taken), rolled-back (the result isn't the
    upstream text beside annotations, or an annotation stands where it changes something: the text stays as it was). reasons: not-a-target, no-such-symbol, no-slot, not-a-code-line, rolled-back.
    A symbol with one bad annotation is rejected whole; a taken one loses its old annotations.
    """
    now = files.select("path", F.sha1("text").alias("now"), T.comment_pattern(F.col("path")).isNotNull().alias("commented"))
    known = symbols.select("path").distinct().withColumn("known", F.lit(True))
    state = answers.select("path", "sha").distinct().join(now, "path").join(known, "path", "left")
    fate = F.when(F.col("sha") != F.col("now"), "changed").when(~F.col("commented") | F.col("known").isNull(), "unsupported").otherwise("open")
    state = state.select("path", fate.alias("fate")).groupBy("path").agg(F.min("fate").alias("fate"))  # a file whose answers name several versions is changed
    open_ = state.where("fate = 'open'").select("path")
    some = files.join(open_, "path", "left_semi").select("path", "text")
    rows = settled(_rows(some, marker))

    said = F.filter(F.transform("text", lambda t: cleaned(t, marker)), lambda t: t != "")
    asked = answers.join(open_, "path", "left_semi").select("path", "n", "symbol", F.coalesce(F.col("placement") == "doc", F.lit(False)).alias("doc"), (F.coalesce("line", F.lit(0)) - 1).cast("long").alias("line"), said.alias("said"))
    own = symbols.select("path", F.col("id").alias("symbol"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("item_row").cast("long").alias("item_row"), F.lit(True).alias("there"))
    asked = asked.join(own, ["path", "symbol"], "left")
    wanted = targets.select("path", F.col("id").alias("symbol")).distinct().withColumn("wanted", F.lit(True)) if targets is not None else None
    asked = asked.join(wanted, ["path", "symbol"], "left") if wanted is not None else asked.withColumn("wanted", F.lit(True))
    module, rust = F.col("symbol").endswith(MODULE), F.col("path").endswith(".rs")

    slots = module_slots(some, marker).select("path", F.col("row").alias("module_row"), F.col("token").alias("module_token"))
    item = rows.select("path", F.col("row").alias("item_row"), T.indent(F.col("line")).alias("item_margin"))
    above = rows.select("path", (F.col("row") + 1).alias("item_row"), F.col("doc").alias("last_doc"))
    asked = asked.join(slots, "path", "left").join(item, ["path", "item_row"], "left").join(above, ["path", "item_row"], "left")
    documented = F.col("last_doc") >= F.col("start")
    doc_row = F.when(module, F.col("module_row")).when(~rust, F.col("item_row")).when(documented, F.col("last_doc") + 1).otherwise(F.col("start"))
    plain = T.by_path(F.col("path"), lambda t: F.lit(t[-1]))
    doc_token = F.when(module, F.col("module_token")).when(rust & documented, "///").otherwise(plain)
    asked = asked.withColumn("row", F.when(F.col("doc"), doc_row).otherwise(F.col("line")))
    here = rows.select("path", "row", F.col("zh"), "blank", "bare", "before", T.indent(F.col("line")).alias("margin"))
    asked = asked.join(here, ["path", "row"], "left")
    line_token = F.when(~rust, plain).when(F.col("bare").startswith("//!"), "//!").when(F.col("bare").startswith("///") & F.coalesce(F.col("before").startswith("///"), F.lit(False)), "///").otherwise("//")
    inside = module | F.col("row").between(F.col("start"), F.col("end"))
    code_line = inside & F.col("blank").isNotNull() & ~F.coalesce("blank", F.lit(True)) & ~F.coalesce("zh", F.lit(True))
    empty = F.size("said") == 0
    reason = F.when(F.col("wanted").isNull(), "not-a-target").when(F.col("there").isNull(), "no-such-symbol").when(empty, None).when(F.col("doc") & (F.coalesce("row", F.lit(-1)) < 0), "no-slot").when(~F.col("doc") & ~code_line, "not-a-code-line")
    token = F.when(F.col("doc"), doc_token).otherwise(line_token)
    margin = F.when(~F.col("doc"), F.col("margin")).when(module, "").otherwise(F.col("item_margin"))
    rendered = F.transform("said", lambda t: F.concat(margin, token, F.lit(f" {marker} "), t))
    asked = settled(asked.select("path", "n", "symbol", "row", reason.alias("reason"), F.when(~empty, rendered).alias("rendered")))

    judged = asked.groupBy("path", "symbol").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("n"))).alias("reason"), F.count("rendered").alias("planned"))
    taken = judged.where("reason IS NULL AND planned > 0").select("path", "symbol")
    order = F.struct(F.col("row").alias("a"), F.lit(0).alias("b"), F.col("n").alias("c"), F.col("k").alias("d"))
    new = asked.join(taken, ["path", "symbol"], "left_semi").where("rendered IS NOT NULL").select("path", "row", "n", F.posexplode("rendered").alias("k", "line")).select("path", order.alias("at"), "line")
    gone = symbols.select("path", F.col("id").alias("symbol"), F.explode("zh_rows").alias("row")).join(taken, ["path", "symbol"], "left_semi").select("path", F.col("row").cast("long").alias("row")).distinct()
    old = rows.join(taken.select("path").distinct(), "path", "left_semi").select("path", "row", "line").join(gone, ["path", "row"], "left_anti")
    old = old.select("path", F.struct(F.col("row").alias("a"), F.lit(1).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d")).alias("at"), "line")
    made = settled(old.unionByName(new).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text")))

    broken = verify.issues(made, upstream, changed=made.select("path"), overlay=r"(?!)", placement=placement).select("path").distinct().withColumn("broken", F.lit(True))
    fates = judged.withColumn("taken", F.col("reason").isNull() & (F.col("planned") > 0)).groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("taken"), F.col("symbol")))).alias("taken"),
        F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("symbol", "reason")))).alias("lost"),
    )
    out = state.join(fates, "path", "left").join(made.withColumnRenamed("text", "made"), "path", "left").join(broken, "path", "left").join(files.select("path", "text"), "path")
    none, nobody = F.array().cast("array<string>"), F.array().cast("array<struct<symbol: string, reason: string>>")
    outcome = F.when(F.col("fate") != "open", F.col("fate")).when(F.col("made").isNull(), "unchanged").when(F.col("broken"), "rolled-back").otherwise("applied")
    back = F.transform("taken", lambda s: F.struct(s.alias("symbol"), F.lit("rolled-back").alias("reason")))
    lost = F.coalesce("lost", nobody)
    return out.select("path", outcome.alias("outcome"), "taken", lost.alias("lost"), back.alias("back"), "made", "text").select(
        "path",
        "outcome",
        F.when(F.col("outcome") == "applied", F.col("taken")).otherwise(none).alias("applied"),
        F.when(F.col("outcome") == "rolled-back", F.array_sort(F.concat("lost", "back"))).otherwise(F.col("lost")).alias("rejected"),
        F.when(F.col("outcome") == "applied", F.col("made")).otherwise(F.col("text")).alias("text"),
    )


def responses(bodies: DataFrame) -> DataFrame:
    """ANSWERS of model responses (path, sha, body: JSON with annotations [{symbol, placement, line, text []}]), in their order; unreadable bodies have no rows."""
    told = F.from_json("body", "annotations array<struct<symbol: string, placement: string, line: int, text: array<string>>>")
    rows = bodies.select("path", "sha", F.posexplode(told["annotations"]).alias("n", "a"))
    return rows.select("path", "sha", "n", F.coalesce("a.symbol", F.lit("")).alias("symbol"), "a.placement", "a.line", F.coalesce("a.text", F.array().cast("array<string>")).alias("text"))
