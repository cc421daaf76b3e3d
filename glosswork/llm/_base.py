"""What the operators of this package share: lineage cuts, Arrow text buffers and hashing in numpy."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from hashlib import blake2b
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.sources.tables import cleaning, scratch, shared_dir
from glosswork.sources.tables import settled as cut

__all__ = ["cleaning", "cut", "scratch", "shared_dir"]

U = np.uint64
#: Odd multiplier of the polynomial hashes (mod 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Stands for a null document id inside an operator.
NULL_ID = -(1 << 63)
#: Bytes that one task of a shuffle gets, about.
TASK_BYTES = 64 << 20


def parts(spark: SparkSession, size: int = 0) -> int:
    """Partitions for `size` bytes: the session's number, or more where that would give a task too much."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / TASK_BYTES))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: a scan of one column that sends one number."""
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def trim() -> None:
    """Give freed memory back to the system: a worker lives on with what its largest task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a worker process keeps from task to task, by the name that its tasks give to trimmed().
kept: dict[str, dict] = {}


def keeping(name: str) -> dict:
    """What this worker keeps by a name, until a task that doesn't keep it runs here."""
    return kept.setdefault(name, {})


def release(keeps: str = "") -> None:
    """Drop all that is kept by other names: workers outlive the stages that they served."""
    for name in [n for n in kept if n != keeps]:
        del kept[name]


def trimmed(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """run, with only what it keeps by name, and trim() after it."""

    def wrapped(batches: Iterator) -> Iterator:
        release(keeps)
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def key_of(column: str) -> Column:
    """An integer id as a long; null becomes NULL_ID."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def row_keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """doc, sub: 128 bits that tell a row's id and text; repeated rows share them, other rows of a null or shared id don't."""
    own = (F.col(doc_id).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.xxhash64(*own).alias("doc"), F.xxhash64(*own[::-1], F.lit(BASE >> 1)).alias("sub")


def one_key(rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of a row's id and text that no two different rows share.

    Keys that two rows with different row_keys() share are found first; as good as none are, and of 10**11 rows some hundred. Their rows get another key.
    """
    doc, sub = row_keys(doc_id, text)
    key, other = doc, F.xxhash64(doc, sub)
    shared = rows.select(doc, sub).groupBy("doc").agg(F.min("sub").alias("lo"), F.max("sub").alias("hi")).where("lo != hi").select("doc")
    twice = [r["doc"] for r in shared.collect()]
    return F.when(key.isin(twice), other).otherwise(key) if twice else key


def text_buffer(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls count as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buffer, offsets


def chunks(offsets: np.ndarray, most: int = 1 << 19):
    """Runs (i, j) of rows with about `most` bytes at least one row each, so that work arrays stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i in 0..n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            steps = np.full(size, U(base))
            steps[0] = U(1)
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def prefix_hashes(units: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of units[:i]; span_hash() takes any span's hash from it."""
    up, _ = powers(len(units))
    out = np.zeros(len(units) + 1, U)
    np.cumsum(units * up[: len(units)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any bits of them order and deal as random ones."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


#: Bytes of a word beyond which it is digested whole.
LONG = 256
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^ space, 0x09-0x0D]+ of rows that lie one after another in data, and each row's first word.

    data begins at offsets[0]; the results are relative to it.
    """
    n, rel = len(data), offsets - offsets[0]
    word = ~SPACE[data]
    inner = np.zeros(n + 1, bool)
    inner[1:n] = word[1:] & word[:-1]
    inner[rel] = False  # a row's end ends a word
    starts = np.flatnonzero(word & ~inner[:n])
    ends = np.flatnonzero(word & ~inner[1:]) + 1
    return starts, ends, np.searchsorted(starts, rel)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, mixed in blocks of eight bytes; of long ones a BLAKE2 digest."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U)
    size = ends - starts
    out = mix(size.astype(U) * U(BASE))
    at, k = np.flatnonzero(size <= LONG), 0
    while len(at):
        rest = size[at] - k
        out[at] = mix(out[at] * U(BASE) + (blocks[starts[at] + k] & masks[np.minimum(rest, 8)]))
        at, k = at[rest > 8], k + 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def packed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins; one more place is the end."""
    size = ends - starts
    begin = np.append(0, np.cumsum(size + 1))
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    letters = data[~SPACE[data]]
    out[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    return out, begin


def folded_hash(units: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` units from each place: each is mixed into that of those before, so that order counts and no sums cancel."""
    out = np.full(len(at), U(size))
    for k in range(size):
        out = mix(out * U(BASE) + units[at + k])
    return out
