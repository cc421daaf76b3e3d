"""Substring dedup over windows of `window` words: words go if a window over them also starts earlier.

Consecutive windows with one minimiser travel as one packed string to the bucket of that minimiser, where sorting the windows, as rows
of word numbers, counts them exactly (`_segments` does the cutting; equal packed strings are settled by 128-bit digests before they
travel, so a passage in a million documents sends one string).

Defined cases: null text has no words; fewer words than a window: all stay; "earlier" is a smaller doc_id, or in the same document
an earlier start; a null doc_id comes before all; of rows that share a doc_id, or have none, the order is that of a hash of their text, and equal ones, being
one document twice, don't remove each other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm._base import key_of, row_keys, text_buffer, trimmed, word_spans
from glosswork.llm._segments import ROW, Plan, marked
from glosswork.llm.suffix_dedup import HOT, spans_of

WINDOW = 20
GRAM = 6


def later_windows(packed: pa.Array, doc: np.ndarray, sub: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (place of their packed string, start) of the packed strings whose words are also those of an earlier one, by doc, sub, start."""
    data, offsets = text_buffer(packed)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    s, e, first = word_spans(data, offsets)
    words = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[np.repeat(s, e - s) + (np.arange((e - s).sum()) - np.repeat(np.cumsum(e - s) - (e - s), e - s))]))])
    number = words.dictionary_encode().indices.to_numpy().astype(np.int32)
    counts = np.maximum(np.diff(first) - window + 1, 0)
    item = np.repeat(np.arange(len(doc)), counts)
    step = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
    doc, sub, start = doc[item], sub[item], start[item] + step
    order = np.lexsort((start, sub, doc))
    rows = np.ascontiguousarray(number[(first[item] + step)[order, None] + np.arange(window)])
    rows = rows.view(np.dtype((np.void, 4 * window))).ravel()
    by = np.argsort(rows, kind="stable")  # equal windows stay in order of document and start
    again = np.zeros(len(by), bool)
    again[1:] = rows[by[1:]] == rows[by[:-1]]
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(by))))  # the first of each window
    item, doc, sub, start = (x[order][by] for x in (item, doc, sub, start))
    later = again & ((doc != doc[head]) | (sub != sub[head]) | (start != start[head]))
    return item[later], start[later]


def _bucket(window: int):
    def run(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return later_windows(table.column("packed").combine_chunks(), *(table.column(c).to_numpy() for c in ROW), table.column("start").to_numpy().astype(np.int64), window)

    return run


def remove_later(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            column, rows = batch.column("spans"), []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                words = own.tobytes().split()  # at 0x20 and 0x09-0x0D, for bytes
                kept, at = [], 0
                for s, e in spans_of(column, i, len(words)):
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                left = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), sha256(left).hexdigest(), left))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"))
    rows = docs.select(key_of("doc_id").alias("doc"), row_keys()[1], "text", own.alias("_row"))
    spans = marked(rows, Plan(window, gram, words=True, keep_first=True, hot=hot), _bucket(window)).select("_row.doc_id", "text", "spans")
    return spans.mapInArrow(trimmed(run), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary").withColumn("kept", F.col("kept").cast("string"))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_later(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
