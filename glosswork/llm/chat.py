"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Successive prefixes of a conversation are rendered; where an output
begins with the one before it, what is new is the turn's span. Rendering the same prefix with a probe in place of the last text
shows where in that span the text stands, which gives the loss mask. A template that changes what it wrote for earlier turns is
found by the comparison and reported for that turn.

Rendering all prefixes of a conversation of n turns costs n**2. Only a template that is declared stateless, which writes every turn by
itself, goes in segments of `SEGMENT` turns, each rendered alone: its turns stream through a task in order. The declaration is held against every conversation:
its segments one after another must be what the template renders for all of it at once, or an error is raised. For this a task holds a conversation's turns
until they make `VERIFIED` characters; what comes after those, in a conversation longer than that, is only held against the turn before each segment, so that
no conversation is too long for a task. Any other template renders whole prefixes; its task holds one conversation, and the result is one segment, the output for all turns.

Defined cases: null text and null role count as empty; turns with the same number go in order of role, then text; a null conv_id is
a conversation of its own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm._base import parts, text_bytes

SEGMENT = 16
#: Characters of a conversation's output that a declared template is held against.
VERIFIED = 1 << 24
PROBE = "\x1aprobe\x1a"

OPEN, CLOSE = "<|turn|>", "<|end|>\n"

Turn = tuple[str, str]


def escape(text: str) -> str:
    """One backslash more between any < and | that only backslashes part, so that no text holds a control string."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def marked_turns(turns: list[Turn]) -> str:
    """The template used here: every turn in marks, its role on the first line."""
    return "".join(f"{OPEN}{_role(role)}\n{escape(text)}{CLOSE}" for role, text in turns)


#: It writes every turn by itself, so a conversation may be rendered in segments.
marked_turns.stateless = True


def read_turns(formatted: str) -> Iterator[Turn]:
    """The turns in an output of marked_turns."""
    for turn in formatted.split(OPEN)[1:]:
        role, _, text = turn.removesuffix(CLOSE).partition("\n")
        yield _unrole(role), unescape(text)


def spans(turns: list[Turn], render: Callable[[list[Turn]], str]) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """The output for turns; for each its span and its text's span, (-1, -1) where that can't be told; the turns at which earlier output was rewritten.

    All count in the output for all turns: after a rewriting, the texts before it are looked for once more, what is left of them.
    """
    before, probe = render([]), PROBE
    while any(probe in text for _, text in turns):
        probe += PROBE[-1]
    found, rewritten = [], []

    def inner(i: int, end: int, out: str) -> tuple[int, int]:
        """Where the text of turn i stands in out, the output for turns[:end]."""
        probed = render([*turns[:i], (turns[i][0], probe), *turns[i + 1 : end]])
        at = probed.rfind(probe)
        tail = len(probed) - at - len(probe)
        sure = at >= 0 and out[:at] == probed[:at] and len(out) - tail >= at and out[len(out) - tail :] == probed[len(probed) - tail :]
        return (at, len(out) - tail) if sure else (-1, -1)

    for i in range(len(turns)):
        out = render(turns[: i + 1])
        start = len(before)
        if not out.startswith(before):
            rewritten.append(i)
            start = next((k for k, (a, b) in enumerate(zip(before, out, strict=False)) if a != b), min(len(before), len(out)))
        span = inner(i, i + 1, out)
        found.append((start, len(out), *(span if span[0] >= start else (-1, -1))))
        before = out
    for i in range(max(rewritten, default=0)):  # what came before the last rewriting may stand elsewhere now, or be gone
        found[i] = (-1, -1, *inner(i, len(turns), before))
    return before, found, rewritten


FORMATTED = "conv_id long, segment int, n_turns int, formatted string, loss array<struct<start: int, stop: int>>, rewritten array<int>"


def format_chats(chats: DataFrame, render: Callable[[list[Turn]], str] = marked_turns, learn: str = "assistant", segment: int = SEGMENT) -> DataFrame:
    """Segments of the formatted conversations of chats (conv_id, turn, role, text), those of one in order within one partition.

    A render without a true attribute `stateless` gets whole conversations, each one segment; one that has it wrongly is an error.
    loss: spans of the texts of role `learn`, in code points of `formatted`; rewritten: turns at which the template changed what it had written before.
    """

    stateless = getattr(render, "stateless", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, turns, number, any_ = None, [], [], 0, False
        rows: list[tuple] = []
        whole: list[Turn] = []
        told: list[str] = []
        size = 0

        def verify() -> None:
            """The conversation so far, at once."""
            nonlocal whole, told
            if len(told) > 1 and render(whole) != "".join(told):
                raise ValueError("the template is declared stateless, but what it writes for a turn depends on others")
            whole, told = [], []

        def flush() -> None:
            nonlocal last, turns, number, size
            if turns:
                text, found, rewritten = spans(turns, render)
                if stateless and (rewritten or render([]) or (last and render([*last, *turns]) != render(last) + text)):
                    raise ValueError("the template is declared stateless, but what it writes for a turn depends on others")
                loss = [{"start": a, "stop": b} for (role, _), (_, _, a, b) in zip(turns, found, strict=True) if role == learn and a >= 0]
                rows.append((conv, number, len(turns), text, loss, rewritten))
                if stateless and size <= VERIFIED:
                    whole.extend(turns)
                    told.append(text)
                    size += len(text)
                    if size > VERIFIED:
                        verify()
                last, turns, number = turns[-1:], [], number + 1

        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if not any_ or c != conv:
                    flush()
                    verify()
                    conv, last, turns, number, any_, size = c, [], [], 0, True, 0
                turns.append((role or "", text or ""))
                if stateless and len(turns) == segment:
                    flush()
            yield _batch(rows)
            rows.clear()
        flush()
        verify()
        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "segment", "n_turns", "formatted", "loss", "rewritten"])

    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition(parts(chats.sparkSession, text_bytes(rows)), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from the segments that format_chats made with its own template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv, state = None, None

        def flush() -> None:
            if state:
                n, turns, chars, loss, size = state
                rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for c, text, loss in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss")), strict=True):
                if state is None or c != conv:
                    flush()
                    conv, state = c, [0, sha256(), 0, sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    learnt = unescape(text[span["start"] : span["stop"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            yield _batch(rows)
            rows.clear()
        flush()
        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(chats.unionByName(more)))
