"""What a scanner tells about a file, and how comments and strings are told from code.

Scanners work on a copy of the text in which comments and the insides of strings are spaces, so a brace or a keyword in them is none. They are not
grammars: what a macro or a preprocessor hides from them isn't found, and no error is recovered from.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate


@dataclass
class Found:
    kind: str
    qualname: str
    start: int
    item_row: int
    end: int
    sig: list[tuple[int, str]] = field(default_factory=list)
    doc: list[tuple[int, str]] = field(default_factory=list)
    body: list[tuple[int, str]] = field(default_factory=list)
    parent: int | None = None
    container: bool = False


class Masked:
    """A text with its comments and strings told apart from code. All questions about a row are settled in one pass over the spans."""

    def __init__(self, text: str, code: str, comments: list[tuple[int, int]], strings: list[tuple[int, int]]):
        self.text, self.code, self.comments, self.strings = text, code, comments, strings
        self.lines, self.code_lines = text.split("\n"), code.split("\n")
        #: Offset of each row.
        self.rows = [0, *accumulate(len(line) + 1 for line in self.lines[:-1])]
        self._string_at = [a for a, _ in strings]
        self._commented = {r for a, z in comments for r in range(self.row(a), self.row(max(a, z - 1)) + 1)}
        #: Rows that begin inside a string.
        self.inside = {r for a, z in strings for r in range(self.row(a) + 1, self.row(max(a, z - 1)) + 1)}

    def row(self, at: int) -> int:
        return bisect_right(self.rows, at) - 1

    def parts(self, a: int, z: int) -> list[tuple[int, str]]:
        """The text from a to z as (row, text)."""
        return list(enumerate(self.text[a:z].split("\n"), self.row(a)))

    def whole_rows(self, rows: Iterable[int]) -> list[tuple[int, str]]:
        return [(r, self.lines[r]) for r in rows]

    def string_from(self, at: int) -> tuple[int, int] | None:
        """The string that begins at or is nearest before an offset."""
        k = bisect_right(self._string_at, at) - 1
        return self.strings[k] if k >= 0 else None

    def in_string(self, row: int) -> bool:
        at = self.rows[row] + width(self.lines[row])
        found = self.string_from(at)
        return found is not None and found[0] < at < found[1]

    def comment_row(self, row: int) -> bool:
        """A row that holds a comment and nothing else."""
        return row in self._commented and not self.code_lines[row].strip() and bool(self.lines[row].strip())


# How comments and strings begin and end, by family.
_HASH = r"(?P<c>#[^\n]*)|(?P<s>[rRbBuUfF]{0,2}(?:'''(?:\\.|[^\\])*?(?:'''|\Z)|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?))"
_SLASH = r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>"
_STRINGS = {
    "go": r"`[^`]*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])+')",
    "ts": r"`(?:\\.|[^`\\])*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)",
    "rust": r"b?r#*\".*?\"#*|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|b?'(?:\\[^\n]{1,8}?|[^'\\\n])')",
    "c": r"R\"\(.*?\)\"|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])+')",
}


@cache
def _pattern(family: str) -> re.Pattern[str]:
    return re.compile(_HASH if family == "hash" else _SLASH + _STRINGS[family], re.S)


def mask(text: str, family: str) -> Masked:
    comments, strings, out, at = [], [], [], 0
    for m in _pattern(family).finditer(text):
        a, z = m.span()
        out.append(text[at:a])
        is_comment = m["c"] is not None
        (comments if is_comment else strings).append((a, z))
        inner = re.sub(r"[^\n]", " ", m[0])
        out.append(inner if is_comment or len(inner) < 2 else f'"{inner[1:-1]}"')
        at = z
    out.append(text[at:])
    return Masked(text, "".join(out), comments, strings)


def width(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))
