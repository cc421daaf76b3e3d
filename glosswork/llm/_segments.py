"""Repeated windows by their minimisers.

Units are the bytes or the words of a document. Each window of `window` units has a leftmost smallest `gram`-unit hash, its anchor;
consecutive windows with one anchor make a segment. Equal windows have equal anchors at equal places, so they always meet in
the bucket of their anchor:

1. `segments` cuts every document into segments, as (anchor, digest, document, place); equal segments of one task are settled there,
   so that a frequent passage sends one row a task.
2. `settle` meets the rows of an anchor. All but one row of an equal segment need no more. Where an anchor has several different
   segments, one of each is asked for.
3. Where an anchor has more than `hot` different segments, more of what is around it decides the bucket: the windows that begin up to half as far
   before the anchor as any can are parted from the others, and either half goes by the units that all its windows have in common, cut to what
   they cover. This goes on while a bucket is hot; in the end its windows have all units in common.
4. `fetch` joins the asked segments with their texts and packs them as strings; the operator's own bucket step sorts and compares these.

Equal segments are told by 128-bit BLAKE2 digests of their bytes, or of their words with one space after each. Anchors' hashes only deal out; two anchors
of one hash share a bucket, where their strings differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm._base import U, chunks, cut, mix, packed_words, parts, prefix_hashes, span_hash, text_buffer, text_bytes, trimmed, word_hashes, word_spans

ROWS = "key long, digest long, more long, doc long, sub long, start int, n int, anchor_at int, copies int, low int, high int"
FETCHED = "key long, doc long, sub long, start int, anchor_at int, packed binary"
#: Rows of a table go by two numbers: their order, or one hash of what they are, and another hash, so that neither shared ids nor equal hashes mix them up.
ROW = ["doc", "sub"]
#: In copies: a segment of a hot anchor.
HOT = -2
#: Ids of documents, 8 bytes each, that are broadcast to pick their texts; more of them are joined by a shuffle.
FEW = 1 << 20
#: Segments a task gathers before it settles equal ones among them and sends the rest.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Plan:
    window: int
    gram: int
    words: bool
    #: The first of equal windows stays (by document, then place); else all of them are marked.
    keep_first: bool
    #: Different segments of one anchor that one task compares.
    hot: int = 4096
    #: Segments of whole anchors that are compared at a time.
    batch: int = 5_000


def cut_windows(units: np.ndarray, rel: np.ndarray, window: int, gram: int):
    """Segments of rows whose units lie one after another, row i from rel[i] to rel[i + 1]: row, first start, end, anchor's place and hash."""
    n, w = len(units), window - gram + 1
    if n < window:
        return None
    prefix = prefix_hashes(units)
    at = np.arange(n - gram + 1)
    grams = mix(span_hash(prefix, at, at + gram))
    low = U((1 << 31) - 1)
    keys = (grams & ~low) | at.astype(U)  # the leftmost of equal ones is the smallest
    padded = np.full(-(-len(keys) // w) * w, ~U(0))
    padded[: len(keys)] = keys
    padded = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - window + 1
    place = (np.minimum(back[:count], ahead[w - 1 : w - 1 + count]) & low).astype(np.int64)
    lengths = np.diff(rel)
    row = np.repeat(np.arange(len(lengths)), lengths)[:count]
    valid = np.arange(count) + window <= rel[row + 1]
    change = np.ones(count + 1, bool)
    change[1:count] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(valid & change[:-1])
    end = np.flatnonzero(valid & change[1:]) + window
    return row[first], first, end, place[first], grams[place[first]]


def _digests(view: memoryview, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of spans of bytes, as rows of two."""
    return np.frombuffer(b"".join([blake2b(view[s:e], digest_size=16).digest() for s, e in zip(begin.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def batch_segments(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, subs: np.ndarray, plan: Plan) -> Iterator[dict[str, np.ndarray]]:
    for i, j in chunks(offsets):
        a, z = offsets[i], offsets[j]
        own, rel = data[a:z], offsets[i : j + 1] - a
        if plan.words:
            starts, ends, rel = word_spans(own, rel)
            units = word_hashes(own, starts, ends)
        else:
            units = own.astype(U) + U(1)
        if (cutted := cut_windows(units, rel, plan.window, plan.gram)) is None or not len(cutted[0]):
            continue
        row, first, end, place, key = cutted
        n = len(row)
        if plan.words:
            own, begin = packed_words(own, starts, ends)
            digest = _digests(memoryview(own), begin[first], begin[end])
        else:
            digest = _digests(memoryview(np.ascontiguousarray(own)), first, end)
        yield {"key": key.view(np.int64), "digest": digest[:, 0], "more": digest[:, 1], "doc": docs[i:j][row], "sub": subs[i:j][row], "start": (first - rel[row]).astype(np.int32), "n": (end - first).astype(np.int32), "anchor_at": (place - first).astype(np.int32), "low": np.zeros(n, np.int32), "high": np.full(n, plan.window - plan.gram, np.int32)}


def _groups(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """x by key, digest, doc, sub, start; which rows begin an equal segment, and which begin a key."""
    order = np.lexsort((x["start"], x["sub"], x["doc"], x["more"], x["digest"], x["key"]))
    x = {k: v[order] for k, v in x.items()}
    key = np.ones(len(order), bool)
    key[1:] = x["key"][1:] != x["key"][:-1]
    equal = key.copy()
    equal[1:] |= (x["digest"][1:] != x["digest"][:-1]) | (x["more"][1:] != x["more"][:-1])
    return x, equal, key


def _later(x: dict[str, np.ndarray], equal: np.ndarray) -> np.ndarray:
    """Which rows of _groups come after an equal one; the same place of a repeated row doesn't."""
    head = np.maximum.accumulate(np.where(equal, np.arange(len(equal)), 0))
    return ~equal & np.any([x[c] != x[c][head] for c in (*ROW, "start")], axis=0)


def merged(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals of each row."""
    if not len(doc):
        return doc, sub, start, end
    order = np.lexsort((start, sub, doc))
    doc, sub, start, end = doc[order], sub[order], start[order].astype(np.int64), end[order].astype(np.int64)
    rank = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])]))
    lift = rank * (int(end.max()) + 2)  # rows one after another, apart
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    return doc[at], sub[at], start[at], reach[last] - lift[at]


def _table(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(x[c]) for c in (f.split(" ")[0] for f in ROWS.split(", "))})


def _marks(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    doc, sub, start, end = merged(doc, sub, start, end)
    wide, narrow = np.zeros(len(doc), np.int64), np.full(len(doc), -1, np.int32)
    return {"key": doc, "digest": wide, "more": wide, "doc": doc, "sub": sub, "start": start.astype(np.int32), "n": (end - start).astype(np.int32), "anchor_at": narrow, "copies": narrow, "low": narrow, "high": narrow}


def _sent(each: Iterator[dict[str, np.ndarray]], plan: Plan) -> Iterator[pa.RecordBatch]:
    """ROWS for the buckets: of equal segments among `BLOCK` one, and spans that this settles."""

    def send(gathered: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x = {k: np.concatenate([g[k] for g in gathered]) for k in gathered[0]}
        x, equal, _ = _groups(x)
        at = np.flatnonzero(equal)
        copies = np.diff(np.concatenate([at, [len(equal)]])).astype(np.int32)
        settled = _later(x, equal) if plan.keep_first else np.repeat(copies > 1, copies)
        if settled.any():
            yield _table(_marks(x["doc"][settled], x["sub"][settled], x["start"][settled], (x["start"] + x["n"])[settled]))
        yield _table({k: v[at] for k, v in x.items()} | {"copies": copies})

    held: list[dict[str, np.ndarray]] = []
    for x in each:
        held.append(x)
        if sum(len(h["key"]) for h in held) >= BLOCK:
            yield from send(held)
            held = []
    if held:
        yield from send(held)


def segments(docs: DataFrame, plan: Plan) -> DataFrame:
    """Rows for an anchor's bucket; rows with copies = -1 are already settled spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent((x for batch in batches for x in batch_segments(*text_buffer(batch.column("text")), batch.column("doc").to_numpy(), batch.column("sub").to_numpy(), plan)), plan)

    return docs.select(*ROW, "text").mapInArrow(trimmed(run), ROWS)


def narrower(docs: DataFrame, hot: DataFrame, plan: Plan, n_parts: int) -> DataFrame:
    """Segments of hot anchors as two: the windows with at most half as many units before the anchor, and those with more, by what they have in common."""

    def halves(own: bytes | list[bytes], key: int, anchor: int, low: int, high: int) -> Iterator[tuple]:
        half = (low + high) // 2
        for lo, hi in ((low, half), (half + 1, high)):
            begin, end = max(0, anchor - hi), min(len(own), anchor + plan.window - lo)
            if lo > hi or end - begin < plan.window or anchor < lo:
                continue
            common, all_ = own[anchor - lo : anchor + plan.window - hi], own[begin:end]
            if plan.words:
                common, all_ = b" ".join(common), b" ".join(all_)
            place = blake2b(common, digest_size=8, key=b"%d %d %d" % (key, lo, hi)).digest()
            yield place + blake2b(all_, digest_size=16).digest(), begin, end - begin, anchor - begin, lo, hi

    def parted(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        hashes, rest = [], []
        for row, own, s in _asked(batch, plan):
            for h, *x in halves(own, s["key"], s["anchor_at"], s["low"], s["high"]):
                hashes.append(h)
                rest.append((*row, s["start"] + x[0], *x[1:]))
        if rest:
            h, x = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 3), np.array(rest, np.int64)
            yield {"key": h[:, 0], "digest": h[:, 1], "more": h[:, 2], "doc": x[:, 0], "sub": x[:, 1]} | {c: x[:, k].astype(np.int32) for k, c in enumerate(("start", "n", "anchor_at", "low", "high"), 2)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent((x for batch in batches for x in parted(batch)), plan)

    return docs.repartition(n_parts, *ROW).join(_lists(hot, n_parts), ROW).mapInArrow(trimmed(run), ROWS)


def settle(rows: DataFrame, plan: Plan, n_parts: int) -> DataFrame:
    """Spans that are settled (anchor_at = -1) and segments to fetch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [{n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names} for b in batches]
        if not held:
            return
        x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        held.clear()
        done = x["copies"] < 0
        doc, sub, start, end = x["doc"][done], x["sub"][done], x["start"][done], (x["start"] + x["n"])[done]
        x, equal, key = _groups({k: v[~done] for k, v in x.items()})
        if len(equal):
            at = np.flatnonzero(equal)
            seen = np.add.reduceat(x["copies"], at)
            rows_of = np.diff(np.concatenate([at, [len(equal)]]))
            full = _later(x, equal) if plan.keep_first else np.repeat(seen > 1, rows_of)
            doc, sub, start, end = (np.concatenate(y) for y in ((doc, x["doc"][full]), (sub, x["sub"][full]), (start, x["start"][full]), (end, (x["start"] + x["n"])[full])))
            group = np.cumsum(key) - 1
            several = np.bincount(group, weights=equal)[group]
            ask = equal & (several > 1)
            if ask.any():
                yield _table({k: v[ask] for k, v in x.items()} | {"copies": np.where((several > plan.hot) & (x["low"] < x["high"]), HOT, 1)[ask].astype(np.int32)})
        if len(doc):
            yield _table(_marks(doc, sub, start, end))

    return rows.repartition(n_parts, "key").mapInArrow(trimmed(run), ROWS)


def _lists(asked: DataFrame, n_parts: int) -> DataFrame:
    return _by_row(asked, n_parts, F.struct("start", "n", "anchor_at", "key", "low", "high"), "asked")


def _by_row(rows: DataFrame, n_parts: int, what: Column, name: str) -> DataFrame:
    """A list a row, in as many partitions as the texts. These hold a bounded number of bytes, and lists are smaller than their texts, so they may be the side that a join keeps in memory."""
    return rows.repartition(n_parts, *ROW).groupBy(*ROW).agg(F.collect_list(what).alias(name)).hint("shuffle_hash")


def _asked(batch: pa.RecordBatch, plan: Plan) -> Iterator[tuple[tuple[int, int], bytes | list[bytes], dict[str, int]]]:
    """Row (doc, sub), units and values of each asked segment of texts with their lists."""
    data, offsets = text_buffer(batch.column("text"))
    rows, column = list(zip(*(batch.column(c).to_pylist() for c in ROW), strict=True)), batch.column("asked")
    for i in range(batch.num_rows):
        if column[i].is_valid:
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            units = text.split() if plan.words else text  # bytes split at 0x20 and 0x09-0x0D
            for s in column[i].as_py():
                yield rows[i], units[s["start"] : s["start"] + s["n"]], s


def fetch(docs: DataFrame, asked: DataFrame, plan: Plan, n_parts: int) -> DataFrame:
    """The asked segments as FETCHED rows, packed: bytes of the text, or its words with one space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s["key"], *row, s["start"], s["anchor_at"], b" ".join(own) if plan.words else own) for row, own, s in _asked(batch, plan)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split(" ")[0] for f in FETCHED.split(", ")])

    return docs.join(_lists(asked, n_parts), ROW).mapInArrow(trimmed(run), FETCHED)


def texts_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """doc, sub, text of the rows that have asked segments; all others stay where they are if these are few."""
    ids = cut(asked.select(*ROW).distinct())
    return docs.select(*ROW, "text").join(F.broadcast(ids) if ids.count() <= FEW else ids, ROW, "left_semi")


def marked(docs: DataFrame, plan: Plan, bucket: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """doc, sub, text, _row of docs with their spans to remove: spans array<struct<start, n>> in units; null where there are none.

    bucket gets the fetched segments of whole anchors and tells the windows (places in the table, starts) to mark. Texts with all their columns are dealt out once, for
    the segments to fetch and for the spans.
    """
    spark = docs.sparkSession
    docs = docs.select(*ROW, F.col("text").cast("string").alias("text"), "_row")

    def spans(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        doc, sub, start, end = merged(doc, sub, start, end)
        return pa.RecordBatch.from_pydict({"doc": pa.array(doc, pa.int64()), "sub": pa.array(sub, pa.int64()), "start": pa.array(start, pa.int32()), "n": pa.array(end - start, pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(list(batches), plan.batch):
            item, start = bucket(table)
            yield spans(*(table.column(c).to_numpy()[item] for c in ROW), start, start + plan.window)

    n_parts = parts(spark, text_bytes(docs))
    level = cut(settle(segments(docs, plan), plan, n_parts))
    levels = [level]
    few = None
    while (hot := level.where(F.col("copies") == HOT)).limit(1).count():
        few = few if few is not None else cut(texts_of(docs, hot))
        level = cut(settle(narrower(few, hot, plan, parts(spark, text_bytes(few))), plan, parts(spark)))
        levels.append(level)
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    asked = every.where(f"anchor_at >= 0 AND copies != {HOT}")
    size = (asked.agg(F.sum("n")).first()[0] or 0) * (8 if plan.words else 1)
    docs = docs.repartition(n_parts, *ROW)
    more = fetch(docs, asked, plan, n_parts).repartition(parts(spark, size), "key").mapInArrow(trimmed(run), "doc long, sub long, start int, n int")
    found = every.where("anchor_at < 0").select(*ROW, "start", "n").unionByName(more)
    return docs.join(_by_row(found, n_parts, F.struct("start", "n"), "spans"), ROW, "left")


def by_key(batches: list[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of whole keys, of about `most` rows each."""
    table = pa.Table.from_batches(batches) if batches else None
    if table is None or not table.num_rows:
        return
    table = table.combine_chunks()
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    at = 0
    while at < len(key):
        later = begins[np.searchsorted(begins, at + most) :]
        end = int(later[0]) if len(later) else len(key)
        yield table.take(pa.array(order[at:end]))
        at = end
