"""Column functions over texts, paths and tags. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker, comment tokens by suffix and by file name, generated paths, dependency files, identifiers.
MARKER = "【zh】"
SLASH, HASH, DASH = ("///", "//!", "//"), ("#",), ("--",)
SLASH_SUFFIXES = ".rs .go .c .h .cc .cpp .cxx .hpp .hh .java .kt .scala .swift .js .jsx .mjs .cjs .ts .tsx .mts .cts .cs .zig .hxx .proto .dart .fbs .capnp".split()
HASH_SUFFIXES = ".py .pyi .pyx .pxd .pxi .sh .bash .zsh .rb .pl .r .toml .yaml .yml .mk .cmake .nix .tf".split()
DASH_SUFFIXES = ".sql .lua .hs".split()
HASH_NAMES = "Makefile Dockerfile CMakeLists.txt Justfile".split()
IDENTIFIER = r"\b[A-Z][A-Za-z0-9_]*[a-z][A-Za-z0-9_]*\b"
#: What counts as white space: the same characters as for Python's str.split(), unlike Java's \s.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The same within a line.
WS_LINE = WS.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def norm_ws(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def short_sha(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def digest(text: Column) -> Column:
    """Content hash that pure reformatting doesn't change."""
    return short_sha(norm_ws(text))


def lines(text: Column) -> Column:
    """array<string>, split at line feeds only; what ends in one has an empty last line."""
    return F.split(text, "\n", -1)


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def comment_pattern(path: Column) -> Column:
    """Alternatives of the comment tokens a path allows, the longest first; null if it allows none."""
    name, suffix = F.substring_index(path, "/", -1), suffix_of(path)
    return F.when(name.isin(HASH_NAMES), "#").when(suffix.isin(SLASH_SUFFIXES), "///|//!|//").when(suffix.isin(HASH_SUFFIXES), "#").when(suffix.isin(DASH_SUFFIXES), "--")


def marker_pattern(tokens: tuple[str, ...], marker: str = MARKER) -> str:
    """A Java pattern for the begin of a whole-line annotation."""
    return rf"[ \t]*(?:{'|'.join(re.escape(t) for t in sorted(tokens, key=len, reverse=True))})[ \t]*{marker}"


def is_annotation(line: Column, tokens: tuple[str, ...] = HASH, marker: str = MARKER) -> Column:
    return line.rlike("^" + marker_pattern(tokens, marker))


def strip_annotations(text: Column, tokens: tuple[str, ...] = HASH, marker: str = MARKER) -> Column:
    """text without its annotation lines; line ends are line feeds alone."""
    return F.regexp_replace(text, rf"(?dm)^{marker_pattern(tokens, marker)}[^\n]*(?:\n|\z)", "")


def by_path(path: Column, f: Callable[[tuple[str, ...]], Column]) -> Column:
    """f of the comment tokens a path allows; null if it allows none."""
    pattern = comment_pattern(path)
    return F.when(pattern == "#", f(HASH)).when(pattern == "--", f(DASH)).when(pattern.isNotNull(), f(SLASH))


def annotation_body(line: Column, marker: str = MARKER) -> Column:
    """What an annotation line says."""
    return F.when(F.contains(line, F.lit(marker)), strip(F.regexp_replace(line, f"(?s)^.*?{marker}", ""))).otherwise(strip(line))


def indent(line: Column) -> Column:
    return F.regexp_extract(line, r"^[ \t]*", 0)


def group_of(path: Column, depth: int) -> Column:
    """The first `depth` folders of a path; . if it has none."""
    parts = F.split(path, "/", -1)
    group = F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/")
    return F.when(group == "", ".").otherwise(group)


def version_key(tag: Column) -> Column:
    """array<bigint> of a tag's numbers; arrays order as versions do."""
    return F.transform(F.regexp_extract_all(tag, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))


def repository_of(url: Column) -> Column:
    """owner/name of a repository's address; null for another address."""
    return F.nullif(F.regexp_extract(url, r"^(?:(?:https?|ssh|git)://(?:[^@/]+@)?github\.com(?::\d+)?/|(?:[^@/]+@)?github\.com:)([^/]+/[^/]+?)(?:\.git)?/?$", 1), F.lit(""))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def inline_markdown(text: Column) -> Column:
    """Escaped text with `code` as a code element."""
    return F.regexp_replace(escape_html(text), "`([^`]+)`", "<code>$1</code>")


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def glob_pattern(glob: str) -> str:
    """A Java and Python pattern for the paths that one ignore-file glob takes."""
    told, anchored = glob.strip(), "/" in glob.strip().rstrip("/")
    folder, told = told.endswith("/"), told.strip("/")
    out, i = "", 0
    while i < len(told):
        if told.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif told.startswith("/**", i) and i + 3 == len(told):
            out, i = out + "/.+", i + 3
        elif told.startswith("**", i):
            out, i = out + ".*", i + 2
        elif told[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif told[i] == "?":
            out, i = out + "[^/]", i + 1
        elif told[i] == "[" and "]" in told[i + 2 :]:
            end = told.index("]", i + 2)
            inner = told[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(told[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.+$" if folder else "(?:/.+)?$")


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Whether a path is taken; later globs win and ! takes back."""
    taken = F.lit(False)
    for glob in globs:
        back = glob.startswith("!")
        taken = F.when(path.rlike(glob_pattern(glob.removeprefix("!"))), F.lit(not back)).otherwise(taken)
    return taken


def in_scope(path: Column, include: list[str], exclude: list[str], generated: list[str] = ()) -> Column:
    inside = matches_globs(path, include) if include else F.lit(True)
    return inside & ~matches_globs(path, list(exclude)) & ~matches_globs(path, list(generated))
