"""Annotation blocks of one text put into another: next to the code line they stood by, inside the symbol they belonged to.

Both texts of a file meet once, with its symbols; what follows looks at one file at a time and takes the time of a sort of its rows, however many of them are equal. Rows don't travel.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.functions import text as T

#: What `place` tells of each block.
PLACED = "path string, first long, n long, id string, outcome string, at long"
#: Characters or rows that a task gives out at once, about.
SENT = 1 << 22


def _each(files: DataFrame, rows: Callable[[dict], list[tuple]], told: str) -> DataFrame:
    """What rows() gives for each row of files."""
    names = [x.split()[0] for x in told.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in told.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        out: list[tuple] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                made = rows({c: batch.column(c)[k].as_py() for c in batch.schema.names})
                out += made
                size += sum(64 + len(x) for row in made for x in row if isinstance(x, str))
                if size > SENT:
                    yield sent()
                    out, size = [], 0
        yield sent()

    return files.mapInArrow(run, told)


def _indent(line: str) -> str:
    return line[: len(line) - len(line.lstrip(" \t"))]


def _blocks(lines: list[str], note: Callable) -> list[tuple[int, int, str | None, str | None, int]]:
    """first, n, the other lines before and after, and the row without annotations of each run of annotations."""
    out, code, prv, first = [], 0, None, None
    for row, line in enumerate(lines):
        if note(line):
            first = row if first is None else first
            continue
        if first is not None:
            out.append((first, row - first, prv, line, code))
        first, prv, code = None, line, code + 1
    return out if first is None else [*out, (first, len(lines) - first, prv, None, code)]


def _owners(rows: list[int], symbols: list[dict]) -> list[dict | None]:
    """The innermost symbol around each of ascending rows: the shortest, of equals the one with the lowest ord."""
    todo, open_, out = sorted((s for s in symbols if s["start"] <= s["end"]), key=lambda s: -s["start"]), [], []
    for row in rows:
        while todo and todo[-1]["start"] <= row:
            s = todo.pop()
            heappush(open_, (s["end"] - s["start"], s["ord"] is not None, s["ord"] or 0, s["id"], s["end"], s["start"]))
        while open_ and open_[0][4] < row:
            heappop(open_)
        out.append({"id": open_[0][3], "start": open_[0][5]} if open_ else None)
    return out


def _near(points: list[int], low: int, high: int | None, want: int) -> int | None:
    """The point from low to high nearest to want, of two as near the lower."""
    a, z = bisect_left(points, low), bisect_right(points, high) if high is not None else 0
    k = bisect_left(points, want, a, max(a, z))
    return min(points[max(a, k - 1) : min(z, k + 1)], key=lambda p: (abs(p - want), p), default=None)


def _placed(path: str, ours: list[str], theirs: list[str] | None, mine: list[dict] | None, other: list[dict] | None, note: Callable) -> list[tuple]:
    """PLACED of a file's blocks, without its path."""
    found = _blocks(ours, note)
    if not found:
        return []
    own = {"id": f"{path}#<module>", "start": 0}
    owners = [o or own for o in _owners([b[0] for b in found], mine or [])]
    code = [0]  # rows without annotations before each row
    for line in ours:
        code.append(code[-1] + (not note(line)))
    extents = {s["id"]: (s["start"], s["end"], s["item_row"]) for s in other or []}

    asked = {x.strip() for _, _, prv, nxt, _ in found for x in (prv, nxt) if x is not None} - {""}
    at_line, at_both = defaultdict(list), defaultdict(list)
    above = None
    for row, line in enumerate(theirs or []):
        said = line.strip()
        if said in asked:
            at_line[said].append(row)
            at_both[above, said].append(row)
        above = said

    out = []
    for (first, n, prv, nxt, at_code), owner in zip(found, owners, strict=True):
        low, high, head = extents.get(owner["id"], (None, None, None))
        if owner["id"].endswith("#<module>"):
            low, high, head = (low, None, head) if theirs is None else (0, len(theirs) - 1, 0)
        if low is None:
            out.append((first, n, owner["id"], "orphaned", None))
            continue
        want, at = low + at_code - code[owner["start"]], None
        before, after = (None if x is None else x.strip() for x in (prv, nxt))
        if after and before is not None:
            at = _near(at_both.get((before, after), []), low, high, want)
        if after and at is None:
            at = _near(at_line.get(after, []), low, high, want)
        if before and at is None:
            at = _near(at_line.get(before, []), low, high, want - 1)
            at = None if at is None else at + 1
        out.append((first, n, owner["id"], "relocated" if at is None else "reattached", head if at is None else at))
    return out


def _rebuilt(ours: list[str], theirs: list[str], placed: dict[int, tuple[str, int | None]], note: Callable) -> str:
    """theirs with the blocks of ours at their places: outcome and at by first row."""
    moved = []
    for first, n, _, nxt, _ in _blocks(ours, note):
        outcome, at = placed.get(first, ("", None))
        if at is not None:
            there = theirs[at] if at < len(theirs) else ""
            margin = _indent((nxt or "") if outcome == "reattached" and not there.strip() else there)
            moved.append((at, first, [margin + x.lstrip(" \t") for x in ours[first : first + n]]))
    out, done = [], 0
    for at, _, lines in sorted(moved):
        out += theirs[done:at] + lines
        done = max(done, at)
    return "\n".join(out + theirs[done:])


def _note(tokens: tuple[str, ...]) -> Callable:
    return re.compile(T.marker_pattern(tokens)).match


def _with_symbols(files: DataFrame, our_symbols: DataFrame, their_symbols: DataFrame) -> DataFrame:
    """files (path) with the symbols of each on both sides as lists."""
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    mine = our_symbols.groupBy("path").agg(F.collect_list(F.struct("id", *long("start", "end", "ord"))).alias("mine"))
    other = their_symbols.groupBy("path").agg(F.collect_list(F.struct("id", *long("start", "end", "item_row"))).alias("other"))
    return files.join(mine, "path", "left").join(other, "path", "left")


def place(ours: DataFrame, theirs: DataFrame, our_symbols: DataFrame, their_symbols: DataFrame, tokens: tuple[str, ...] = T.HASH) -> DataFrame:
    """path, first, n, id, outcome (reattached, relocated, orphaned) and at (the row of the other text it goes before; null for an orphan) of each block.

    ours, theirs: path, text. Symbols: path, id, start, end, item_row, ord; what lies in none belongs to the file's own, `path#<module>`.
    """
    files = ours.where("path IS NOT NULL AND text IS NOT NULL").select("path", F.col("text").alias("ours")).join(theirs.select("path", F.col("text").alias("theirs")), "path", "left")

    def rows(f: dict) -> list[tuple]:
        note = _note(tokens)
        return [(f["path"], *x) for x in _placed(f["path"], f["ours"].split("\n"), None if f["theirs"] is None else f["theirs"].split("\n"), f["mine"], f["other"], note)]

    return _each(_with_symbols(files, our_symbols, their_symbols), rows, PLACED)


def rebuild(ours: DataFrame, theirs: DataFrame, placed: DataFrame, tokens: tuple[str, ...] = T.HASH) -> DataFrame:
    """path, text: theirs with the placed blocks inserted. A block that stands by its line again is indented as the line it goes before, or, where that is blank or there is none, as
    the line it stood before; one moved to its symbol's head as the line there. Equal places keep the blocks' order.
    """
    spots = placed.where("at IS NOT NULL").groupBy("path").agg(F.collect_list(F.struct("first", "at", "outcome")).alias("spots"))
    files = theirs.where("text IS NOT NULL").select("path", F.col("text").alias("theirs")).join(ours.select("path", F.col("text").alias("ours")), "path", "left").join(spots, "path", "left")

    def rows(f: dict) -> list[tuple]:
        spots = {s["first"]: (s["outcome"], s["at"]) for s in f["spots"] or []}
        return [(f["path"], _rebuilt((f["ours"] or "").split("\n"), f["theirs"].split("\n"), spots, _note(tokens)) if spots else f["theirs"])]

    return _each(files, rows, "path string, text string")


def resolve(stages: DataFrame, our_symbols: DataFrame, their_symbols: DataFrame, tokens: tuple[str, ...] = T.HASH) -> DataFrame:
    """path, outcome, text of each conflicted file (path, base, ours, theirs; or path, changed, ours, theirs), whose code becomes theirs.

    merged: our annotations are placed in their text; deleted: they have none, so all of ours are orphans; taken: a kind of file that has no annotations, unchanged by us; unsupported: the
    same but changed by us, or ours is gone, so that somebody must look (text is null).
    """
    changed = F.col("changed") if "changed" in stages.columns else F.col("base") != F.col("ours")
    kind = F.when(F.col("ours").isNull(), "unsupported").when(F.col("theirs").isNull(), "deleted")
    kind = kind.when(T.comment_pattern(F.col("path")).isNull(), F.when(changed, "unsupported").otherwise("taken")).otherwise("merged")
    read = {"ours": F.col("outcome") == "merged", "theirs": F.col("outcome").isin("merged", "taken")}
    files = stages.select("path", kind.alias("outcome"), "ours", "theirs").withColumns({c: F.when(use, F.col(c)) for c, use in read.items()})

    def rows(f: dict) -> list[tuple]:
        if f["outcome"] != "merged":
            return [(f["path"], f["outcome"], f["theirs"])]
        note, ours, theirs = _note(tokens), f["ours"].split("\n"), f["theirs"].split("\n")
        placed = {first: (outcome, at) for first, _, _, outcome, at in _placed(f["path"], ours, theirs, f["mine"], f["other"], note)}
        return [(f["path"], "merged", _rebuilt(ours, theirs, placed, note))]

    return _each(_with_symbols(files, our_symbols, their_symbols), rows, "path string, outcome string, text string")
