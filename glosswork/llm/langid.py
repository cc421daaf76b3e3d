"""Language ID by nearest centroids: normalised TF-IDF vectors of letter n-grams against several clustered centroids a language.

A text's vector counts the hashed 3-byte grams of its lower-cased UTF-8, with all ASCII but letters read as one space; counts go in as
square roots, times the inverse document frequency over all training documents, scaled to length 1. For each language spherical
k-means finds `clusters` centroids in the `sample` different texts of the smallest hashes, or all if there are fewer. A text gets the
language of the centroid with the greatest cosine, which is the score.

Rejection is by distance: rejected is true where the cosine is below the language's floor for texts of that many grams, or where there
is no letter. The floor falls with the number of grams, as short clean texts are far from any centroid.

Texts are worked on `ROWS` at a time, so a vector of all features for each takes little memory however short they are.

Defined cases: a null text or one without letters is `und` with score 0 and rejected; training rows with a null lang are left out; without
any training row every text is `und`; repeated rows each get a result; a null doc_id is not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from glosswork.llm._base import NULL_ID, chunks, key_of, text_buffer, trimmed

#: Features that grams are hashed to.
FEATURES = 1 << 13
CLUSTERS = 4
#: Texts, and bytes of texts, whose vectors a worker holds.
ROWS, BYTES = 256, 1 << 18
#: Texts of one language, and of all, that centroids are clustered from.
SAMPLE, SAMPLE_ALL = 400, 4000
#: Share of the cosine to be expected for so many grams that a text needs.
FLOOR = 0.2

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Gram counts (documents x FEATURES) of lower-cased texts that lie one after another."""
    rel = offsets - offsets[0]
    b = _FOLD[data[offsets[0] : offsets[-1]]].astype(np.uint32)
    n, rows = len(b), len(offsets) - 1
    if n < 3:
        return np.zeros((rows, FEATURES), np.float32)
    grams = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    row = np.repeat(np.arange(rows), np.diff(rel))[: n - 2]
    keep = (np.arange(n - 2) + 3 <= rel[row + 1]) & (grams != 0x202020)
    feature = ((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int64)
    return np.bincount((row * FEATURES + feature)[keep], minlength=rows * FEATURES).reshape(rows, FEATURES).astype(np.float32)


def few(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs (i, j) of at most ROWS rows and about BYTES bytes."""
    for i, j in chunks(offsets, BYTES):
        for k in range(i, j, ROWS):
            yield k, min(k + ROWS, j)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(count) * idf
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    #: The language of each centroid.
    of: np.ndarray
    idf: np.ndarray
    #: Grams that halve the expected cosine, and that expected of a long text, by language.
    half: np.ndarray
    long: np.ndarray

    def predict(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, cosines, rejections."""
        near = vectors(count, self.idf) @ self.centroids.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(best)), best], 0, 1).astype(np.float64)
        lang, grams = self.of[best], count.sum(1)
        expected = self.long[lang] * np.sqrt(grams / (grams + self.half[lang]))
        return lang, score, score < FLOOR * expected


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other."""
    picked = [0]
    near = x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def _counted(rows: DataFrame) -> DataFrame:
    """lang, at, n of each text (lang, text): the features it has, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(pc.utf8_lower(batch.column("text")))
            for i, j in few(offsets):
                x = counts(data, offsets[i : j + 1])
                row, at = np.nonzero(x)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=j - i))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (at, x[row, at])]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), *lists], names=["lang", "at", "n"])

    return rows.select("lang", "text").mapInArrow(trimmed(run), "lang string, at array<int>, n array<int>")


def fit(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model | None:
    """A model from docs (text, lang). Document frequencies come from all rows; what reaches the driver is bounded by SAMPLE_ALL and FEATURES."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            data, offsets = text_buffer(pc.utf8_lower(batch.column("text")))
            for i, j in few(offsets):
                total += (counts(data, offsets[i : j + 1]) > 0).sum(0)
                n += j - i
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(at, -1).astype(np.int32)), "n": pa.array(np.append(total[at], n))})

    df = np.zeros(FEATURES + 1)
    for r in known.select("text").mapInArrow(trimmed(frequency), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r["feature"]] = r["n"]
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return None
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(0.1)
    each = max(1, min(sample, SAMPLE_ALL // len(sizes)))
    # the texts of the smallest hashes, copies left out; every task keeps only so many of a language
    hashed = known.select("lang", F.xxhash64("text").alias("_h")).distinct()
    first = hashed.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_n") <= each).select("lang", "_h")
    texts = known.withColumn("_h", F.xxhash64("text")).join(F.broadcast(first), ["lang", "_h"], "left_semi").groupBy("lang", "_h").agg(F.min("text").alias("text"))
    rows = _counted(texts).orderBy("lang").collect()
    languages = sorted(sizes)
    centroids, of, half, long = [], [], np.full(len(languages), 150.0), np.full(len(languages), 0.5)
    for i, lang in enumerate(languages):
        own = [r for r in rows if r["lang"] == lang]
        count = np.zeros((len(own), FEATURES), np.float32)
        for k, r in enumerate(own):
            count[k, r["at"]] = r["n"]
        count = np.unique(count, axis=0)
        c = kmeans(vectors(count, idf), clusters)
        centroids.append(c)
        of += [i] * len(c)
        near_, grams = (vectors(count, idf) @ c.T).max(1), count.sum(1)
        long[i] = np.median(near_ / np.sqrt(np.maximum(grams, 1) / (grams + half[i])))
    return Model(languages, np.concatenate(centroids), np.array(of), idf, half, long)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row of docs (doc_id, text)."""
    names = np.array([*(model.languages if model else []), "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, doc = batch.column("text"), batch.column("doc").to_numpy()
            data, offsets = text_buffer(pc.utf8_lower(column))
            lower = batch.column("text")
            for i, j in few(offsets):
                lettered = np.array([has_letter(t) for t in lower.slice(i, j - i).to_pylist()], bool)
                if model is None:
                    lang, score, rejected = np.zeros(j - i, int), np.zeros(j - i), np.ones(j - i, bool)
                else:
                    lang, score, rejected = model.predict(counts(data, offsets[i : j + 1]))
                yield pa.RecordBatch.from_arrays([pa.array(doc[i:j], mask=doc[i:j] == NULL_ID), pa.array(np.where(lettered, names[lang], "und"), pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(rejected | ~lettered)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(key_of("doc_id").alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose text isn't rejected, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            data, offsets = text_buffer(pc.utf8_lower(batch.column("text")))
            for i, j in few(offsets):
                lettered = np.array([has_letter(t) for t in batch.column("text").slice(i, j - i).to_pylist()], bool)
                keep.append(lettered & ~model.predict(counts(data, offsets[i : j + 1]))[2] if model else lettered & False)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(trimmed(run), docs.schema)


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out()).select("text", "lang")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(train_rows(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
