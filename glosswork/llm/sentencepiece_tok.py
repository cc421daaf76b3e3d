"""SentencePiece encoding and decoding with the tokenizers library as the backend.

The model's protobuf is parsed, and its normaliser, white space marks, pieces with their scores and byte fallback are rebuilt as a
tokenizers model: unigram from the scores themselves, BPE from the merges that the scores order. Batches of units, between which no piece
can stand, are encoded by the library's threads, and a worker remembers their ids and what the library decodes these to. Ids and texts
are the library's. SentencePiece itself only verifies parity: of every unit, or of whole texts where the model's normaliser isn't
simple; a document counts in n_differ what the two encode differently.

Defined cases: null text counts as empty and has no ids; repeated rows each get a result; a null doc_id stays null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, normalizers

from glosswork.llm._base import NULL_ID, chunks, keeping, key_of, text_buffer, trimmed
from glosswork.llm._units import Units

MARK = chr(0x2581)
#: Different units whose ids a worker remembers.
REMEMBERED = 500_000
#: No character of any text.
NEVER = chr(0x10FFFF)
_BYTE = re.compile("(?<=<)(?=0x[0-9A-F]{2}>)")
_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Backend:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self.pieces = [p.piece for p in proto.pieces]
        #: Where to cut text that reads like the name of a byte's piece, which would be taken for it.
        self.parted: re.Pattern[str] | None = None
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        unk, fallback = trainer.unk_id, trainer.byte_fallback
        if trainer.model_type == trainer.UNIGRAM:
            # control and unknown pieces never stand for text, so they get names that no text has
            self.model = models.Unigram([(p.piece if p.type in (p.NORMAL, p.USER_DEFINED, p.BYTE) else NEVER + p.piece, p.score) for p in proto.pieces], unk, fallback)
            normal = [p.piece for p in proto.pieces if p.type in (p.NORMAL, p.USER_DEFINED)]
            self.parted = _BYTE if not any("<0" in p for p in normal) else None
        elif trainer.model_type == trainer.BPE:
            vocab = {p: i for i, p in enumerate(self.pieces)}
            self.model = models.BPE(vocab, self._merges(proto, vocab), unk_token=self.pieces[unk], fuse_unk=True, byte_fallback=fallback)
        else:
            raise ValueError("only unigram and BPE models can be rebuilt")
        steps: list = []
        if norm.precompiled_charsmap:
            steps.append(normalizers.Precompiled(norm.precompiled_charsmap))
        if norm.remove_extra_whitespaces:
            steps += [normalizers.Replace(re_(" {2,}"), " "), normalizers.Replace(re_(r"\A | \z"), "")]
        if norm.add_dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        if norm.escape_whitespaces:
            steps.append(normalizers.Replace(" ", MARK))
        self.normalizer = normalizers.Sequence(steps)
        self.prefix = norm.add_dummy_prefix
        #: Identity but for the prefix and the marks: what most texts need can be done by str.replace.
        self.simple = self.prefix and norm.escape_whitespaces and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        #: No piece has a mark after something else, so texts can be cut there.
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.units = Tokenizer(self.model)
        self.units.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.whole = Tokenizer(self.model)
        self.whole.normalizer = self.normalizer
        self.remembered = Units(self.split, self.learn, REMEMBERED, self.units.decode_batch)

    @staticmethod
    def _merges(proto, vocab: dict[str, int]) -> list[tuple[str, str]]:
        """All pairs of pieces that make a piece, best score first: SentencePiece merges the pair whose piece has the best score."""
        found = []
        for i, p in enumerate(proto.pieces):
            if p.type == p.NORMAL or p.type == p.USER_DEFINED:
                found += [(-p.score, i, p.piece[:k], p.piece[k:]) for k in range(1, len(p.piece)) if p.piece[:k] in vocab and p.piece[k:] in vocab]
        found.sort(key=lambda x: x[:2])
        return [x[2:] for x in found]

    def split(self, text: str) -> list[str]:
        units = self._units(text)
        return [v for u in units for v in self.parted.split(u)] if self.parted and "<0x" in text else units

    def _units(self, text: str) -> list[str]:
        if self.simple and MARK not in text and "\x01" not in text and "  " not in text and text[0] != " ":
            return f"{MARK}{text.replace(' ', chr(1) + MARK)}".split("\x01") if self.cut else [MARK + text.replace(" ", MARK)]
        normal = self.normalizer.normalize_str(text)
        return _RUNS.findall(normal) if self.cut else [normal]

    def learn(self, units: list[str]) -> tuple[list[list[int]], list[int]]:
        """Ids of normalised units; flags: 1 where SentencePiece has others."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        found = [e.ids for e in self.units.encode_batch(units, add_special_tokens=False)]
        if not self.simple:
            return found, [0] * len(units)
        told = self.own.encode([u[1:].replace(MARK, " ") for u in units], num_threads=1)
        # a mark alone, or what begins without one, can't be asked for
        return found, [int(a != b and u != MARK and u.startswith(MARK)) for a, b, u in zip(found, told, units, strict=True)]

    def differ(self, texts: list[str], ids: np.ndarray, at: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """n_differ of texts with these ids, from their units' flags, or from the texts where units can't tell."""
        if self.simple:
            return flags
        return np.array([int(told != ids[a:z].tolist()) for told, a, z in zip(self.own.encode(texts, num_threads=1), at[:-1], at[1:], strict=True)], np.int64)

    def unmarked(self, text: str) -> str:
        """What decoding gives, without the space that the prefix makes."""
        return text[1:] if self.prefix and text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        return self.unmarked(self.units.decode(ids))


def re_(pattern: str):
    from tokenizers import Regex

    return Regex(pattern)


#: Tasks that tokenise keep their backends in the worker by this name.
KEPT = "sentencepiece"


def backend(path: str) -> Backend:
    """One for each worker process, as long as it tokenises."""
    backends = keeping(KEPT)
    if path not in backends:
        backends[path] = Backend(path)
    return backends[path]


ENCODED = "doc_id long, ids array<int>, decoded string, n_differ long"
DIGESTS = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, n_differ long"


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    b = backend(path)
    for batch in batches:
        column, numbers = batch.column("text"), batch.column("doc").to_numpy()
        _, offsets = text_buffer(column)
        for i, j in chunks(offsets):
            texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
            ids, at, flags, back = b.remembered.encode(texts)
            differ = b.differ(texts, ids, at, flags)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[i:j], mask=numbers[i:j] == NULL_ID), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array([b.unmarked(t) for t in back], pa.string()), pa.array(differ)], names=["doc_id", "ids", "decoded", "n_differ"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("ids")
        ids, at = column.values.to_numpy().astype("<u4"), column.offsets.to_numpy()
        texts = batch.column("decoded").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array([zlib.crc32(ids[a:z].tobytes()) for a, z in zip(at[:-1], at[1:], strict=True)], pa.int64()), pa.array([sha256(t.encode()).hexdigest() for t in texts], pa.string()), batch.column("n_differ")], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "n_differ"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(key_of("doc_id").alias("doc"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>), decoded (string), n_differ of docs (doc_id, text)."""
    path = path or model_path()
    return _texts(docs).mapInArrow(trimmed(lambda batches: _encoded(path, batches), KEPT), ENCODED)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, n_differ: of what encode() gives, in the same workers, so that ids don't go through the JVM."""
    path = path or model_path()
    return _texts(docs).mapInArrow(trimmed(lambda batches: _digested(_encoded(path, batches)), KEPT), DIGESTS)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
