"""Suffix-array dedup: bytes covered by a string of `window` bytes that also starts anywhere else go.

Documents are cut into segments by minimisers (`_segments`), so that all places where two documents can share such a string meet at
an anchor. For the segments of an anchor that differ, the suffixes that start at the anchor, and the reversed ones that end there,
are sorted by a mergesort whose comparisons find the common extension by binary search over prefix polynomial hashes, in
logarithmic time. Neighbours' common extensions are compared byte by byte, so a hash collision can't do harm. In sorted order a run
of common extensions of at least k is a class of suffixes that agree in k units; two windows `left` bytes before the anchor are
equal if both their sides are in one class.

Defined cases: null text counts as empty; a document shorter than the window keeps everything; identical rows are copies of each
other, even with the same doc_id; matches never cross documents; other columns are ignored; an empty table gives an empty result.
Rows are told apart by a 64-bit hash of doc_id and text, so rows that share a doc_id, or have none, each get their own spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm._base import U, prefix_hashes, row_keys, span_hash, text_buffer, trimmed
from glosswork.llm._segments import Plan, marked

WINDOW = 200
GRAM = 40
#: Different strings of one anchor beyond which more of what is around it decides the bucket.
HOT = 4096


class Suffixes:
    """Some suffixes of a buffer, each of a group, sorted within it."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray):
        """group is ascending: members of a group are adjacent."""
        self.data, self.begin, self.size = data, begin, end - begin
        self.prefix = prefix_hashes(data.astype(U) + U(1))
        self.new = np.ones(len(begin), bool)
        self.new[1:] = group[1:] != group[:-1]
        self.order = np.arange(len(begin))
        self._sort()
        self.common = self._neighbours()

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes x and y: a binary search, each step one hash comparison."""
        a, b = self.begin[x], self.begin[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = span_hash(self.prefix, a, a + mid) == span_hash(self.prefix, b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y; equal ones by their number."""
        k = self.extension(x, y)
        ends_x, ends_y = k >= self.size[x], k >= self.size[y]
        top = len(self.data) - 1
        a, b = self.data[np.minimum(self.begin[x] + k, top)], self.data[np.minimum(self.begin[y] + k, top)]
        return np.where(ends_x & ends_y, x < y, np.where(ends_x, True, np.where(ends_y, False, a < b)))

    def _sort(self) -> None:
        n = len(self.order)
        first = np.flatnonzero(self.new)
        size = np.diff(np.concatenate([first, [n]]))
        start, end = np.repeat(first, size), np.repeat(first + size, size)
        slot = np.arange(n) - start
        width = 1
        while width < size.max(initial=0):  # a pass of mergesort over all groups at once
            block = slot // width
            pair = start + block // 2 * 2 * width
            left = block % 2 == 0
            low = np.where(left, np.minimum(pair + width, end), pair)
            high = np.where(left, np.minimum(pair + 2 * width, end), pair + width)
            at = np.flatnonzero(low < high)
            item, lo, hi = self.order[at], low[at], high[at]
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                right = self.less(self.order[mid], item[open_])
                lo[open_] = np.where(right, mid + 1, lo[open_])
                hi[open_] = np.where(right, hi[open_], mid)
            order = self.order.copy()
            order[pair[at] + slot[at] % width + lo - low[at]] = item
            self.order, width = order, 2 * width

    def _neighbours(self) -> np.ndarray:
        """Common extension of each sorted suffix and the one before it, -1 at a group's first; checked byte by byte."""
        out = np.full(len(self.order), -1)
        at = np.flatnonzero(~self.new)
        x, y = self.order[at - 1], self.order[at]
        k = self.extension(x, y)
        if k.sum():
            pair = np.repeat(np.arange(len(at)), k)
            step = np.arange(len(pair)) - np.repeat(np.cumsum(k) - k, k)
            wrong = self.data[self.begin[x][pair] + step] != self.data[self.begin[y][pair] + step]
            if wrong.any():
                return self._exactly()
        out[at] = k
        return out

    def _exactly(self) -> np.ndarray:
        """The same from the bytes alone, after a collision."""
        text = [self.data[b : b + s].tobytes() for b, s in zip(self.begin, self.size, strict=True)]
        group = np.cumsum(self.new)
        self.order = np.array(sorted(range(len(text)), key=lambda i: (group[i], text[i], i)), np.int64)
        out = np.full(len(text), -1)
        for j in np.flatnonzero(~self.new):
            a, b = text[self.order[j - 1]], text[self.order[j]]
            k = min(len(a), len(b))
            differ = np.flatnonzero(np.frombuffer(a[:k], np.uint8) != np.frombuffer(b[:k], np.uint8))
            out[j] = differ[0] if len(differ) else k
        return out

    def classes(self, k: int) -> np.ndarray:
        """A number for each suffix; those of a group that agree in their first k units have the same. Only for suffixes of k units at least."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < k)
        return out


def repeated_windows(packed: pa.Array, anchor_at: np.ndarray, key: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (string, start in it) over an anchor whose bytes are also those of another window of that anchor."""
    data, offsets = text_buffer(packed)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    begin, end = offsets[:-1], offsets[1:]
    anchor, n = begin + anchor_at, len(data)
    right = Suffixes(data, anchor, end, key)
    left = Suffixes(data[::-1].copy(), n - anchor, n - begin, key)
    items, starts = [], []
    room = end - anchor
    for k in range(int(anchor_at.max(initial=-1)) + 1):
        at = np.flatnonzero((anchor_at >= k) & (room >= window - k))
        if len(at) < 2:
            continue
        value = (right.classes(window - k) * (len(key) + 1) + left.classes(k))[at]
        order = np.argsort(value, kind="stable")
        same = value[order[1:]] == value[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        items.append(at[again])
        starts.append((anchor_at[at] - k)[again])
    if not items:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(items), np.concatenate(starts)


def _bucket(window: int):
    def run(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        item, at = repeated_windows(table.column("packed").combine_chunks(), table.column("anchor_at").to_numpy().astype(np.int64), table.column("key").to_numpy(), window)
        return item, table.column("start").to_numpy()[item] + at

    return run


def spans_of(column: pa.Array, i: int, size: int) -> list[tuple[int, int]]:
    """Maximal spans (start, end) of row i, within size."""
    value = column[i]
    if not value.is_valid:
        return []
    found: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], min(x["start"] + x["n"], size)) for x in value.as_py()):
        if s >= e:
            continue
        if found and s <= found[-1][1]:
            found[-1] = (found[-1][0], max(e, found[-1][1]))
        else:
            found.append((s, e))
    return found


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """text, _row (a struct of all other columns), spans: byte ranges of each text that repeated strings cover; spans may touch or overlap."""
    others = F.struct(*(F.col(c) for c in docs.columns if c != "text"))
    rows = docs.select(*row_keys(), "text", others.alias("_row"))
    return marked(rows, Plan(window, gram, words=False, keep_first=False, hot=hot), _bucket(window)).select("text", "_row", "spans")


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int]]:
    """The bytes of each text, what is left of them, and the number of spans that went."""
    data, offsets = text_buffer(batch.column("text"))
    column = batch.column("spans")
    for i in range(batch.num_rows):
        own = data[offsets[i] : offsets[i + 1]].tobytes()
        spans = spans_of(column, i, len(own))
        kept, at = [], 0
        for s, e in spans:
            kept.append(own[at:s])
            at = e
        yield own, b"".join([*kept, own[at:]]), len(spans)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(own), len(own) - len(left), n, sha256(left).hexdigest(), left) for own, left, n in _kept(batch)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = repeated_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, gram, hot)
    return found.select(F.col("_row.doc_id").alias("doc_id"), "text", "spans").mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with repeated spans cut from text, and n_chars set anew. A character of which a span covers a part goes whole. Each row keeps its own columns."""
    found = repeated_spans(docs, window, gram)
    schema = f"_row {found.schema['_row'].dataType.simpleString()}, text string, changed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, texts, changed = batch.column("text").is_valid().to_pylist(), [], []
            for there, (own, left, n) in zip(valid, _kept(batch), strict=True):
                texts.append((own if not n else left).decode("utf-8", "ignore") if there else None)
                changed.append(n > 0)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), pa.array(changed, pa.bool_())], names=["_row", "text", "changed"])

    out = found.mapInArrow(trimmed(run), schema)
    own = {"text": F.col("text")} | ({"n_chars": F.when(F.col("changed"), F.length("text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(own.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
