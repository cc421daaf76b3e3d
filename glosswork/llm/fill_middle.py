"""Fill-in-the-middle transformation by a two-pass matcher that keeps no units.

A text's units are the matches of a pattern. The first pass over a lazy match iterator counts them; two hashes of the document's id give the ranks at
which prefix and middle end; the second pass advances another lazy iterator to both ranks and notes the two places there. Memory beside the text is
constant, however long it is. What is made of the three parts is put together, and taken apart again, by column functions.

Defined cases: null text counts as empty; an empty text, or one that holds a mark, stays plain, so an output can always be read back; a null id hashes as
an empty string; repeated rows get equal results; other columns are kept by `transform` and may have any names; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.llm._base import trimmed

# Units, marks of prefix, suffix and middle, the share of texts that are transformed and of those the share that begin with the suffix, in hundredths.
UNITS = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = "1"

CUT = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())])


def draws(seed: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """The four numbers that decide on a document."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12))


def count_units(pattern: re.Pattern, text: str) -> int:
    n = 0
    for _ in pattern.finditer(text):
        n += 1
    return n


def places(pattern: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Where the first `low` and the first `high` units end; low is at most high."""
    units = pattern.finditer(text)
    first = last = 0
    if low:
        first = last = next(islice(units, low - 1, None)).end()
    if high > low:
        last = next(islice(units, high - low - 1, None)).end()
    return first, last


def cuts(text: str, draw: tuple[int, int, int, int], pattern: re.Pattern, marks: tuple[str, ...], transformed: int, suffix_first: int) -> tuple[int, str, int | None, int | None]:
    """Number of units, form, code points of prefix and middle."""
    n = count_units(pattern, text)
    if not text or draw[2] % 100 >= transformed or any(m in text for m in marks):
        return n, "plain", None, None
    a, b = draw[0] % (n + 1), draw[1] % (n + 1)
    first, last = places(pattern, text, min(a, b), max(a, b))
    return n, "spm" if draw[3] % 100 < suffix_first else "psm", first, last - first


def assembled(text: Column, form: Column, prefix: Column, middle: Column) -> Column:
    """The output of a text by its form."""
    p, m, s = F.substring(text, F.lit(1), prefix), F.substring(text, prefix + 1, middle), F.substring(text, prefix + middle + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)
    spm = F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: the three marks part it, as no transformed text holds one."""
    parts = F.split(output, "|".join(re.escape(m) for m in (PREFIX, SUFFIX, MIDDLE)), 4)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def transform(docs: DataFrame, units: str = UNITS, seed: str = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without their text, with fim: struct<n, form (plain, psm, spm), prefix_chars, middle_chars, output>, which takes the place of a column of that name.

    units: a Python pattern whose matches make up every text.
    """
    marks = (PREFIX, SUFFIX, MIDDLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(units)
        for batch in batches:
            ids, texts = batch.column("_id").to_pylist(), batch.column("_text")
            rows = [cuts(texts[i].as_py(), draws(seed, ids[i]), pattern, marks, transformed, suffix_first) for i in range(batch.num_rows)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            cut = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=CUT.names)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_text"), cut], names=["_row", "_text", "_cut"])

    others = [c for c in docs.columns if c not in (text, "fim")]
    rows = docs.select(F.struct(*(F.col(c) for c in others)).alias("_row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), F.col(doc_id).cast("long").alias("_id"))
    out = rows.mapInArrow(trimmed(run), T.StructType([rows.schema["_row"], rows.schema["_text"], T.StructField("_cut", CUT)]))
    c = lambda name: F.col(f"_cut.{name}")
    made = assembled(F.col("_text"), c("form"), c("prefix_chars").cast("int"), c("middle_chars").cast("int"))
    return out.select(*(F.col("_row").getField(x).alias(x) for x in others), F.struct("_cut.*", made.alias("output")).alias("fim"))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = restored(F.col("fim.output"), F.col("fim.form"))
    rows = transform(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "fim", back.alias("back"))
    return rows.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2("back", 256).alias("restored_sha256"))
