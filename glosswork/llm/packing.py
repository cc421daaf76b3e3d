"""Best-fit packing of tokenised documents into sequences of at most `capacity` tokens.

Hierarchical residual packing: each task tokenises its documents and packs their pieces best-fit, largest first. Nearly full bins are
final. Underfull bins are items of the next round, in which fewer tasks pack the bins of several; rounds go on until one task, or
one for each `TASK_BINS` bins, has what is left. Only 28 bytes a piece travel, never texts or ids.

Defined cases: null text is an empty document, which is the one separator token; longer documents are cut into pieces of the
capacity, the first of which may be shorter; repeated rows are packed like any others; a null doc_id stays null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm._base import NULL_ID, chunks, cut, keeping, key_of, text_buffer, trimmed
from glosswork.llm._units import Units

CAPACITY = 2048
#: A bin is final with so few tokens free.
SLACK = 4
#: Tasks whose bins meet in one task of the next round.
FAN_IN = 16
#: Different units whose ids a worker remembers.
REMEMBERED = 600_000
#: Bins that one task takes at most on average.
TASK_BINS = 200_000

PIECE = np.dtype([("doc", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])

#: Texts that can't be cut at single spaces and line feeds without changing their tokens: other white space, runs of it, and special tokens.
_BLANK = "".join(map(chr, (0x01, 0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_ODD = f"[{re.escape(_BLANK)}]|[ \\n][ \\n]"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Tasks that tokenise keep their encoders in the worker by this name.
KEPT = "packing"


def encoder(path: str) -> Units:
    """Ids by the tokenizers library, add_special_tokens=False; one for each worker process, as long as it tokenises.

    If the file's pre-tokeniser allows it, a text is cut before single spaces and around line feeds, where no token can cross, and a worker
    remembers the ids of these units. Texts with other white space or the strings of special tokens are units as they are.
    """
    encoders = keeping(KEPT)
    if path not in encoders:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        plain = not told.get("normalizer") and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        odd, special = re.compile(_ODD), [t["content"] for t in told["added_tokens"]]
        library = Tokenizer.from_file(path)

        def split(text: str) -> list[str]:
            if not plain or any(t in text for t in special):
                return [text]
            flat = text.replace("\n", " ")
            # what is printable has no white space but spaces; only what isn't is searched letter by letter
            if "  " in flat or not flat.isprintable() and odd.search(text):
                return [text]
            return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

        def learn(units: list[str]) -> tuple[list[list[int]], list[int]]:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # every core has a task already
            return [e.ids for e in library.encode_batch_fast(units, add_special_tokens=False)], [0] * len(units)

        encoders[path] = Units(split, learn, REMEMBERED)
    return encoders[path]


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest item first, each into the fullest bin that takes it.

    Bins are kept by their free space; a bit for each space that some bin has finds the smallest sufficient one at once.
    """
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := spaces >> size:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                spaces ^= 1 << free
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if left := free - size:
            by_free[left].append(b)
            spaces |= 1 << left
    return bins


BINS = "fill int, members binary"


def _packed(fills: np.ndarray, members: list[bytes], capacity: int) -> pa.RecordBatch:
    found = best_fit(fills, capacity)
    return pa.RecordBatch.from_pydict({"fill": pa.array([int(fills[b].sum()) for b in found], pa.int32()), "members": pa.array([b"".join([members[i] for i in b]) for b in found], pa.binary())})


def pieces_of(docs: np.ndarray, ids: np.ndarray, offsets: np.ndarray, capacity: int, separator: int = 0) -> np.ndarray:
    """The pieces of documents, each of its ids and the separator."""
    out = []
    for doc, a, z in zip(docs.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = np.append(ids[a:z], np.uint32(separator)).astype("<u4")
        end = len(own) - (ceil(len(own) / capacity) - 1) * capacity
        start, k = 0, 0
        while start < len(own):
            out.append((doc, k, start, end - start, zlib.crc32(own[start:end].tobytes())))
            start, end, k = end, end + capacity, k + 1
    return np.array(out, PIECE)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of docs (doc_id, text)."""
    path = path or tokenizer_path()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held = encoder(path).encode, []
        for batch in batches:
            column, numbers = batch.column("text"), batch.column("doc").to_numpy()
            _, offsets = text_buffer(column)
            for i, j in chunks(offsets):
                ids, at, *_ = encode(column.slice(i, j - i).to_pylist())
                held.append(pieces_of(numbers[i:j], ids, at, capacity))
                if sum(map(len, held)) > TASK_BINS:
                    yield bins(held)
                    held = []
        if held:
            yield bins(held)

    def bins(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(held)
        raw, k = x.tobytes(), PIECE.itemsize
        return _packed(x["length"], [raw[i : i + k] for i in range(0, len(raw), k)], capacity)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            yield _packed(table.column("fill").to_numpy(), table.column("members").to_pylist(), capacity)

    packed = cut(docs.select(key_of("doc_id").alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(local, KEPT), BINS))
    final = [packed.where(F.col("fill") >= capacity - slack)]
    tasks, left = len(packed.inputFiles()), packed.where(F.col("fill") < capacity - slack)
    while True:
        n = left.count()
        before, tasks = tasks, max(1, ceil(tasks / FAN_IN), ceil(n / TASK_BINS))
        packed = cut(left.repartition(tasks, F.xxhash64("members")).mapInArrow(trimmed(again), BINS))
        if tasks == 1 or tasks >= before:
            final.append(packed)
            break
        final.append(packed.where(F.col("fill") >= capacity - slack))
        left = packed.where(F.col("fill") < capacity - slack)
    every = final[0]
    for more in final[1:]:
        every = every.unionByName(more)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("members"))
            x = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), PIECE)
            counts = np.diff(offsets) // PIECE.itemsize
            length = x["length"].astype(np.int64)
            before = np.cumsum(length) - length
            first = np.cumsum(counts) - counts
            offset = before - np.repeat(before[first], counts) if len(x) else before
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(x["doc"], mask=x["doc"] == NULL_ID), "piece": pa.array(x["piece"]), "start": pa.array(x["start"]), "length": pa.array(length), "ids_crc32": pa.array(x["crc"].astype(np.int64)), "sequence_id": pa.array(np.repeat(batch.column("sequence_id").to_numpy(), counts)), "offset": pa.array(offset)})

    return every.select(F.monotonically_increasing_id().alias("sequence_id"), "members").mapInArrow(trimmed(rows), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
