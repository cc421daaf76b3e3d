"""Rust, Go, TypeScript, JavaScript, C and C++: statements up to a semicolon or a pair of braces, told apart by how they begin."""

from __future__ import annotations

import re
from dataclasses import dataclass

from glosswork.extract.scan import Found, Masked, mask


@dataclass(frozen=True)
class Language:
    family: str
    sep: str
    #: (kind, pattern of a statement's head with a group `name`, does it hold symbols); the first that fits counts.
    items: tuple[tuple[str, str, bool], ...]
    #: Heads whose insides belong to what is around them.
    through: str = r"(?!)"
    line_ends: bool = False
    #: Heads of these begin a definition only with a body.
    needs_body: tuple[str, ...] = ()


_VIS = r"(?:pub(?:\([^)]*\))?\s+)?"
_EXPORT = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_TYPED = r"(?P<name>[A-Za-z_]\w*)"

# The kinds of symbols of each language.
RUST = Language("rust", "::", (
    ("fn", _VIS + r"(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"\s*\"\s+)?fn\s+" + _TYPED, False),
    ("struct", _VIS + r"struct\s+" + _TYPED, False), ("enum", _VIS + r"enum\s+" + _TYPED, False), ("union", _VIS + r"union\s+" + _TYPED, False),
    ("trait", _VIS + r"(?:unsafe\s+)?trait\s+" + _TYPED, True), ("impl", r"(?:unsafe\s+)?(?P<name>impl\b[^{]*)", True), ("mod", _VIS + r"mod\s+" + _TYPED, True),
    ("type", _VIS + r"type\s+" + _TYPED, False), ("const", _VIS + r"const\s+" + _TYPED, False), ("static", _VIS + r"static\s+(?:mut\s+)?" + _TYPED, False), ("macro", r"macro_rules!\s*" + _TYPED, False),
), needs_body=("mod", "impl"))
GO = Language("go", ".", (("fn", r"func\s+(?:\((?P<recv>[^)]*)\)\s*)?" + _TYPED, False), ("type", r"type\s+" + _TYPED, False)), line_ends=True)
TYPESCRIPT = Language("ts", ".", (
    ("fn", _EXPORT + r"(?:async\s+)?function\s*\*?\s*" + _TYPED, False), ("class", _EXPORT + r"(?:abstract\s+)?class\s+" + _TYPED, True), ("interface", _EXPORT + r"interface\s+" + _TYPED, False),
    ("enum", _EXPORT + r"(?:const\s+)?enum\s+" + _TYPED, False), ("mod", _EXPORT + r"(?:namespace|module)\s+(?P<name>[\w.]+)", True), ("type", _EXPORT + r"type\s+" + _TYPED, False),
    ("fn", _EXPORT + r"(?:const|let)\s+" + _TYPED + r"[^=]*=\s*(?:async\s+)?(?:function\b|(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>)", False),
))
_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?" + _TYPED + r"\s*(?:<[^>]*>)?\s*\(")
CPP = Language("c", "::", (
    ("mod", r"(?:inline\s+)?namespace\s+(?P<name>[\w:]+)", True), ("class", r"(?:template\s*<[^{;]*?>\s*)?(?:typedef\s+)?class\s+(?:\w+\([^)]*\)\s*)?" + _TYPED, True), ("struct", r"(?:template\s*<[^{;]*?>\s*)?(?:typedef\s+)?struct\s+" + _TYPED, True),
    ("union", r"(?:typedef\s+)?union\s+" + _TYPED, False), ("enum", r"(?:typedef\s+)?enum\s+(?:class\s+)?" + _TYPED, False),
    ("fn", r"(?:template\s*<[^{;]*?>\s*)?[^=;{}()]*?(?P<name>(?:[A-Za-z_]\w*::)*(?:~?[A-Za-z_]\w*|operator[^\s(]+))\s*\(", False),
), through=r"extern\s+\"\s*\"", needs_body=("mod", "class", "struct", "union", "enum", "fn"))

LANGUAGES = {"rs": RUST, "go": GO} | dict.fromkeys(("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"), TYPESCRIPT) | dict.fromkeys(("c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx"), CPP)
_WORDS = {"if", "for", "while", "switch", "return", "catch", "else", "do", "namespace", "class", "struct", "template", "typedef"}


def _closings(code: str) -> dict[int, int]:
    """Where each brace that is closed is closed."""
    found, open_ = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            found[open_.pop()] = m.start()
    return found


def _statements(code: str, closings: dict[int, int], lo: int, hi: int, line_ends: bool):
    """(begin, head's end, body's brace or None, end) of each statement."""
    at, stops = lo, re.compile(r"[;{}()\[\]\n]")
    while True:
        while at < hi and (code[at].isspace() or code[at] in ";}"):
            at += 1
        if at >= hi:
            return
        depth, k, end, body = 0, hi, hi, None
        for m in stops.finditer(code, at, hi):
            c = m[0]
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif depth <= 0 and c == "{":
                k, body = m.start(), m.start()
                end = min(closings.get(k, hi - 1), hi - 1) + 1
                break
            elif depth <= 0 and (c in ";}" or c == "\n" and line_ends):
                k, end = m.start(), m.start() + (c == ";")
                break
        yield at, k, body, max(end, at + 1)
        at = max(end, at + 1)


def extract(text: str, suffix: str) -> tuple[list[Found], list[tuple[int, str]]]:
    lang = LANGUAGES[suffix.lstrip(".").lower()]
    m = mask(text, lang.family)
    out: list[Found] = []
    closings = _closings(m.code)
    patterns = [(k, re.compile(p, re.S), c) for k, p, c in lang.items]

    def leading(at: int) -> int:
        row = m.row(at)
        while row and m.comment_row(row - 1) and not m.lines[row - 1].lstrip().startswith("//!"):
            row -= 1
        return row

    def named(head: str, body: int | None, in_class: bool):
        for kind, pattern, holds in patterns:
            if (x := pattern.match(head)) and not (body is None and kind in lang.needs_body):
                name = " ".join(x["name"].split())
                if lang is GO and x.groupdict().get("recv"):
                    name = re.findall(r"[A-Za-z_]\w*", re.sub(r"\[.*", "", x["recv"]))[-1] + "." + name
                if lang is RUST and kind == "impl":
                    name = "impl " + re.sub(r"^impl\s*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>)?\s*|\s+where\b.*", "", name)
                if name.split("::")[-1] not in _WORDS and len(name) <= 120:
                    return kind, name, holds
        if in_class and lang is TYPESCRIPT and body is not None and (x := _METHOD.match(head)) and x["name"] not in _WORDS:
            return "method", x["name"], False
        return None

    def walk(lo: int, hi: int, prefix: str, parent: int | None, in_class: bool) -> None:
        for begin, k, body, end in _statements(m.code, closings, lo, hi, lang.line_ends):
            head = m.code[begin:k]
            if x := re.match(r"(?:#!?\[[^\]]*\]\s*|#[^\n]*\n\s*|(?:public|private|protected)\s*:\s*)+", head) if lang in (RUST, CPP) else None:
                attributes, at = head[: x.end()], begin + x.end()
            else:
                attributes, at = "", begin
            if lang is CPP:
                begin = at
            first = leading(begin)
            if body is not None and re.match(lang.through, m.code[at:k]):
                walk(body + 1, end - 1, prefix, parent, in_class)
                continue
            if not (found := named(m.code[at:k], body, in_class)):
                continue
            kind, name, holds = found
            if lang is RUST and ("cfg(test)" in attributes.replace(" ", "") or kind == "mod" and name == "tests"):
                continue
            above = range(first, m.row(begin))
            sig = m.parts(begin, body if body is not None else end)
            out.append(Found(kind, f"{prefix}{lang.sep}{name}" if prefix else name, first, m.row(at), m.row(max(begin, end - 1)), sig, m.whole_rows(above), m.parts(body, end) if body is not None else [], parent, holds))
            if holds and body is not None:
                walk(body + 1, end - 1, out[-1].qualname, len(out) - 1, kind in ("class", "struct"))

    walk(0, len(m.code), "", None, False)
    top = []
    for r in range(len(m.rows)):
        if not m.comment_row(r):
            break
        top.append(r)
    if lang is RUST:
        top = [r for r, line in enumerate(m.lines) if line.lstrip().startswith("//!")]
    return out, m.whole_rows(top)
