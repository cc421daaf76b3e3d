"""Behaviour of the library's own operators on small inputs."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswork.extract import index
from glosswork.functions import text as T
from glosswork.operators import diff, lines, notes, reattach, registry, state, terms, verify, work
from glosswork.plans import reports
from glosswork.sources import files, tables
from glosswork.streaming import follow

M = T.MARKER
CODE = f"/** Weighs a parcel. */\n// {M} 称重\nexport function weigh(boxes: Box[], tare = 0): number {{\n  const gross = boxes.reduce((sum, box) => sum + box.kg, 0);\n  return gross - tare;\n}}\n"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "tokens", "want"),
    [
        (f"/// d\n/// {M} x\nfn f() {{\n    // {M} y\n    //! {M} z\n    x // {M} trailing\n}}\n", T.SLASH, f"/// d\nfn f() {{\n    x // {M} trailing\n}}\n"),
        (f"# {M} no\nfn f() {{}}\n", T.SLASH, f"# {M} no\nfn f() {{}}\n"),
        (f"// {M} a\nfn f() {{}}", T.SLASH, "fn f() {}"),
        (f"# {M} a\ndef g():\n    #{M}b\n    pass\n", T.HASH, "def g():\n    pass\n"),
        ("/// [zh] a\nfn f() {}\n", T.SLASH, "/// [zh] a\nfn f() {}\n"),
        (f"a\r# {M} b\n", T.HASH, f"a\r# {M} b\n"),
    ],
)
def test_strip(spark, text, tokens, want):
    assert one(spark, T.strip_annotations(F.col("t"), tokens), t=text) == want


def test_comment_tokens(spark):
    for path, want in (("x/y.pyx", "#"), ("Makefile", "#"), ("README.md", None), ("a.RS", "///|//!|//"), ("q.sql", "--")):
        assert one(spark, T.comment_pattern(F.col("p")), p=path) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=6))
def test_norm_ws_is_pythons(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.norm_ws(F.col("t")).alias("n"), T.digest(F.col("t")).alias("d")).collect()
    assert all(r.n == " ".join(r.t.split()) and r.d == index.digest(r.t) for r in got)


@pytest.mark.parametrize(("glob", "yes", "no"), [("src/**", ["src/a/b.rs"], ["x/src/a"]), ("**/tests/**", ["a/tests/b", "tests/x"], ["a/test/b"]), ("*.py", ["a.py", "x/a.py"], ["a.pyc"]), ("/a?c", ["abc"], ["x/abc"]), ("gen/", ["gen/x", "y/gen/x"], ["gen"]), ("[!a].c", ["b.c"], ["a.c"])])
def test_globs(spark, glob, yes, no):
    rows = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert {r.p for r in rows.where(T.matches_globs(F.col("p"), [glob])).collect()} == set(yes)


def test_divergence(spark):
    a = spark.createDataFrame([("x.rs", f"// {M} a\nfn f() {{\n    y\n}}\n"), ("same.rs", f"q\n// {M} z\n"), ("short.rs", "a\n"), ("long.rs", "a\nb\n")], "path string, text string")
    b = spark.createDataFrame([("x.rs", "fn f() {\n    x\n}\n"), ("same.rs", "q\n"), ("short.rs", "a\nb\n"), ("long.rs", "a\n")], "path string, text string")
    got = {r.path: (r.line, r.study_line, r.upstream_line) for r in lines.first_divergence(a, b, T.SLASH).collect()}
    assert got == {"x.rs": (3, "    y", "    x"), "short.rs": (2, "<EOF>", "b"), "long.rs": (2, "b", "<EOF>")}


def test_paragraphs(spark):
    text = "one\ntwo\n- item\nmore\n\n中\n文\n1. x"
    rows = lines.explode_lines(spark.createDataFrame([("p", text)], "path string, text string"))
    assert [r.text for r in lines.paragraphs(rows, "path").orderBy("number").collect()] == ["one two", "- item more", "中文", "1. x"]


def symbols(spark, text, path="depot.ts"):
    return index.symbols(spark.createDataFrame([(path, text)], "path string, text string"))


def flat(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in state.RECORD))


def status(spark, records, text, name="weigh"):
    r = state.derive(symbols(spark, text), records).where(F.col("id") == f"depot.ts#{name}").first()
    return r.status, ",".join(r.changed), r.priority


def recorded(merged):
    return tables.settled(merged.where("action != 'dropped'").select(*state.RECORD))


def test_what_changes_in_the_code_shows(spark):
    """Each part of a symbol by itself, after a record of the whole."""
    rec = recorded(state.merge(flat(spark, []), symbols(spark, CODE), "ann"))
    edits = {"gross - tare": "gross", "tare = 0": "tare = 1", "Weighs a": "Weighs one", "  return": "   return", "weigh(": "weigh (", "称重": "过秤"}
    got = {old: status(spark, rec, CODE.replace(old, new)) for old, new in edits.items()}
    assert got["gross - tare"] == ("stale", "body", "P2") and got["tare = 0"] == ("stale", "sig", "P0")
    assert got["Weighs a"] == ("stale", "doc", "P1") and got["  return"] == ("translated", "", "")
    assert got["weigh ("[:-2] + "("][0] == "stale" and got["称重"][0] == "translated"
    assert status(spark, flat(spark, []), CODE)[0] == "translated" and status(spark, rec, CODE.replace(f"// {M} 称重\n", ""))[0] == "pending"


def test_records_follow_the_notes(spark):
    """A sync keeps what was said of older code, takes up what is said anew, follows a renamed symbol, and drops what is gone."""
    rec = recorded(state.merge(flat(spark, []), symbols(spark, CODE), "ann"))
    lighter = CODE.replace("gross - tare", "Math.max(0, gross - tare)")
    kept = state.merge(rec, symbols(spark, lighter), "bob")
    assert [(r.id, r.action, r.by) for r in kept.collect()] == [("depot.ts#weigh", "kept", "ann")]
    assert status(spark, recorded(kept), lighter)[0] == "stale"
    said = lighter.replace("称重", "净重，不为负")
    fresh = recorded(state.merge(rec, symbols(spark, said), "bob"))
    assert status(spark, fresh, said)[0] == "translated" and fresh.first().by == "bob"
    seen = tables.settled(state.approve(fresh, symbols(spark, said), "cy"))
    assert (status(spark, seen, said)[0], seen.first().by) == ("reviewed", "bob")
    assert status(spark, seen, said.replace("kg", "grams"))[0] == "stale"
    other = CODE.replace("weigh(", "grossWeight(")
    (moved,) = state.merge(rec, symbols(spark, other), "bob").collect()
    assert (moved.id, moved.action, moved.old_id) == ("depot.ts#grossWeight", "migrated", "depot.ts#weigh")
    assert status(spark, flat(spark, [tuple(moved[c] for c in state.RECORD)]), other, "grossWeight")[1] == "sig"
    assert [r.action for r in state.merge(rec, symbols(spark, "export const none = 1;\n"), "bob").collect()] == ["dropped"]


RUST = f"""//! Kitchen timers.
//! {M} 计时

use std::time::Duration;

/// How loud a timer rings.
/// {M} 音量
#[repr(u8)]
pub enum Ring {{
    Soft = 1,
    // {M} 响
    Loud,
}}

// {M} 行为
impl Ring {{
    /// Seconds until it stops.
    pub const fn lasts(&self) -> u64 {{
        // {M} 秒
        match self {{ Ring::Soft => 3, Ring::Loud => 30 }}
    }}

    fn id(&self) {{}}
}}

#[cfg(test)]
mod checks {{
    fn rings() {{}}
}}
"""


def found(path, text):
    return {r["qualname"]: r for r in (dict(zip(index.NAMES, row, strict=True)) for row in index.rows_of(path, text))}


def test_rust():
    s = found("timer.rs", RUST)
    assert {k: len(v["zh_rows"]) for k, v in s.items()} == {"<module>": 1, "Ring": 2, "impl Ring": 1, "impl Ring::lasts": 1, "impl Ring::id": 0}
    assert [k for k, v in s.items() if v["translatable"]] == ["<module>", "Ring", "impl Ring::lasts"]
    bare = found("timer.rs", "".join(line for line in RUST.splitlines(True) if M not in line))
    assert {(k, h): s[k][h] for k in s for h in ("sig", "doc", "body")} == {(k, h): bare[k][h] for k in s for h in ("sig", "doc", "body")}
    for before, after, want in (("=> 30", "=> 45", {("impl Ring::lasts", "body")}), ("Seconds until", "How long before", {("impl Ring::lasts", "doc")}), ("-> u64", "-> u32", {("impl Ring::lasts", "sig")}), ("Soft = 1", "Soft = 2", {("Ring", "body")})):
        other = found("timer.rs", RUST.replace(before, after))
        assert {(k, h) for k in s for h in ("sig", "doc", "body") if s[k][h] != other[k][h]} == want


def test_a_containers_body_has_a_line_for_each_child():
    text = "class Jar:\n    size = 3\n\n    # fills\n    def fill(self):\n        return 1\n\n    lid = True\n"
    s = found("jar.py", text)
    assert s["Jar"]["body"] == index.digest("    size = 3\n\n⟨method Jar.fill⟩\n\n    lid = True")
    assert s["<module>"]["body"] == index.digest("class Jar")


GO = f"""package depot

// {M} 箱
// Crate holds parts.
type Crate[T any] struct {{
\tparts []T
}}

// Weight is in grams; "}}" is no end.
func (c Crate[T]) Weight(each int) (int, error) {{
\tif each < 0 {{
\t\treturn 0, errors.New(`{{`)
\t}}
\treturn each * len(c.parts), nil
}}

func open() {{}}
"""
TYPESCRIPT = """// Draws a map.
export abstract class Atlas<K> implements Book {
  private readonly scale = 4;
  static async load(url: string): Promise<Atlas<string>> {
    if (url) { return fetch(`${url}{`); }
    return null;
  }
}
interface Legend { icons: string[] }
export const zoom = async (by: number): Promise<void> => { await by; };
const zones = [1, 2];
export enum Tone { Dark, Light }
"""
CPP = """#include <map>
namespace ship {
template <class K, class V>
class Hold final : private std::map<K, V> {
 public:
  ~Hold() {}
  bool full() const noexcept { return size() > 9; } // }
};
union Tag { int n; char c[4]; };
}  // namespace ship
static long ship_sum(const long *p, int n)
{
  long s = 0;
  while (n--) s += *p++;
  return s;
}
extern "C" {
int dock(void) { return 0; }
}
struct Crew;
"""
PYTHON = '''"""Weather."""
import math

class Station:
    """Measures."""

    unit = "C"

    @property
    # rounded
    def warm(self):
        def half(x):
            return x / 2
        return half(3)

async def report(*args, sep=", "): return sep.join(args)
'''
CYTHON = """cdef struct Point:
    double x, y

cdef class Track:
    cdef list points

    cpdef double length(self,
                        bint closed=False) except -1:
        # sums
        return 0

    def __len__(self):
        return 1

cdef inline double far(double a, double b) nogil:
    return a - b
"""


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("depot.go", GO, {"Crate": "type", "Crate.Weight": "fn", "open": "fn"}),
        ("atlas.ts", TYPESCRIPT, {"Atlas": "class", "Atlas.load": "method", "Legend": "interface", "zoom": "fn", "Tone": "enum"}),
        ("hold.cpp", CPP, {"ship": "mod", "ship::Hold": "class", "ship::Hold::~Hold": "fn", "ship::Hold::full": "fn", "ship::Tag": "union", "ship_sum": "fn", "dock": "fn"}),
        ("weather.py", PYTHON, {"Station": "class", "Station.warm": "method", "report": "fn"}),
        ("track.pyx", CYTHON, {"Point": "struct", "Track": "class", "Track.length": "method", "Track.__len__": "method", "far": "fn"}),
    ],
)
def test_other_languages(path, text, want):
    s = found(path, text)
    assert {k: v["kind"] for k, v in s.items() if v["kind"] != "module"} == want
    if M in text:
        bare = found(path, "".join(line for line in text.splitlines(True) if M not in line))
        assert all(s[k][h] == bare[k][h] for k in s for h in ("sig", "doc", "body"))


def test_marker_and_policy_can_be_set(spark):
    files = spark.createDataFrame([("a.py", "# @ar x\ndef f():\n    pass\n")], "path string, text string")
    got = {r.qualname: (r.translatable, r.zh_rows) for r in index.symbols(files, "@ar", index.Policy(least_lines=1)).collect()}
    assert got == {"<module>": (True, []), "f": (True, [0])}
    index.register(spark)
    files.createOrReplaceTempView("some_files")
    rows = spark.sql("SELECT s.id FROM some_files f, LATERAL glosswork_symbols(f.path, f.text, '@ar') s WHERE s.zh IS NOT NULL").collect()
    assert [r.id for r in rows] == ["a.py#f"]


def test_long_files_take_linear_time():
    import time

    def seconds(n):
        text = "".join(f'# about {i}\ndef f{i}(x):\n    """Doc {i}."""\n    s = "a"\n    return x\n\n' for i in range(n))
        began = time.perf_counter()
        assert len(list(index.rows_of("a.py", text))) == n + 1
        return time.perf_counter() - began

    seconds(500)
    assert seconds(8000) < 40 * max(seconds(500), 0.005)


def test_same_names_are_numbered():
    assert [r[0] for r in index.rows_of("a.py", "def f(): pass\ndef f(): pass\n")][1:] == ["a.py#f", "a.py#f~2"]


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("oven.rs", f"/// Bakes.\n///\n/// ```text\n/// tray\n/// {M} 盘\n/// ```\n/// {M} 好\npub fn bake() {{}}\n", ["zh-in-code-block"]),
        ("oven.rs", f"fn label() -> &'static str {{\n    /// {M} 此处\n    let hot = 200;\n    \"heat\n    // {M} 热\n    on\"\n}}\n", ["doc-in-body", "zh-in-string"]),
        ("menu.py", f"MENU = (\n    'soup'\n    # {M} 汤\n)\nNOTE = f\'\'\'daily\n# {M} 每日\n\'\'\'\n", ["zh-in-string"]),
        ("till.go", f"const receipt = `total\n\t// {M} 合计\n`\n\n// {M} 税\nvar tax = 19\n", ["zh-in-string"]),
        ("shop.ts", f"// {M} 店\nexport const sign = `open ${{hours}}\n// {M} 营业\n`;\n", ["zh-in-string"]),
    ],
)
def test_lint(path, text, want):
    assert [c for _, c in index.lint(path, text)] == want


def test_reattach(spark):
    ours = f"fn brew(cups: u8) {{\n    // {M} 烧水\n    heat();\n    // {M} 倒\n    pour(cups);\n}}\n\n/// Cleans.\n/// {M} 清洗\nfn rinse() {{\n    water();\n}}\n\n/// {M} 不再\nfn grind() {{}}\n"
    theirs = "mod beans;\n\n/// Cleans all.\nfn rinse() {\n    water();\n}\n\nfn brew(cups: u8) {\n    fill();\n    heat();\n    serve(cups);\n}\n"
    a, b = (spark.createDataFrame([("x.rs", t)], "path string, text string") for t in (ours, theirs))
    sa, sb = (index.symbols(t).where("kind != 'module'").select("path", "id", "start", "end", "item_row", F.col("start").alias("ord")) for t in (a, b))
    placed = tables.settled(reattach.place(a, b, tables.settled(sa), tables.settled(sb), T.SLASH))
    assert {(r.id, r["first"]): (r.outcome, r["at"]) for r in placed.collect()} == {("x.rs#brew", 1): ("reattached", 9), ("x.rs#brew", 3): ("reattached", 10), ("x.rs#rinse", 8): ("reattached", 3), ("x.rs#grind", 13): ("orphaned", None)}
    want = f"mod beans;\n\n/// Cleans all.\n/// {M} 清洗\nfn rinse() {{\n    water();\n}}\n\nfn brew(cups: u8) {{\n    fill();\n    // {M} 烧水\n    heat();\n    // {M} 倒\n    serve(cups);\n}}\n"
    assert reattach.rebuild(a, b, placed, T.SLASH).first().text == want


def test_reattached_past_the_end_keeps_its_margin(spark):
    ours, theirs = f"class A:\n    x = 1\n    # {M} 注\n    y = 2\n", "class A:\n    x = 1"
    a, b = (spark.createDataFrame([("x.py", t)], "path string, text string") for t in (ours, theirs))
    none = spark.createDataFrame([], "path string, id string, start long, end long, item_row long, ord int")
    placed = tables.settled(reattach.place(a, b, none, none))
    assert reattach.rebuild(a, b, placed).first().text == f"class A:\n    x = 1\n    # {M} 注"


def test_verify(spark):
    up = [("a.py", "x\n"), ("gone.py", "x\n"), ("t.txt", "a"), ("g.py", "1\n"), ("b.py", "b")]
    mine = [("a.py", f"# {M} n\nx\n"), ("new.py", ""), ("t.txt", "b"), ("g.py", "2\n"), ("b.py", "b\0"), (".study/x", "")]
    a, b = (spark.createDataFrame(x, "path string, text string") for x in (mine, up))
    got = {r.path: r.code for r in verify.issues(a, b, generated="^g").collect()}
    assert got == {"gone.py": "deleted", "new.py": "new-file", "t.txt": "unsupported", "g.py": "generated", "b.py": "binary"}


def test_documents(spark):
    text = "---\ntitle: 模块\nanchors:\n  - a.rs#add\n  - b.py\n---\n\nbody\n"
    docs = notes.parse(spark.createDataFrame([("n/x.md", text), ("n/y.md", "plain")], "path string, text string"))
    rows = {r.path: r for r in docs.collect()}
    assert rows["n/x.md"].anchors == ["a.rs#add", "b.py"] and rows["n/x.md"].title == "模块" and rows["n/y.md"].title == "y"
    hashes = spark.createDataFrame([("a.rs#add", "1"), ("b.py", "2")], "anchor string, hash string")
    none = spark.createDataFrame([], "path string, sha string, anchors map<string,string>")
    first = notes.derive(docs, hashes, none)
    assert {r.path: r.status for r in first.collect()} == {"n/x.md": "new", "n/y.md": "unanchored"}
    rec = tables.settled(notes.merge(first, none).where("action = 'recorded'").select("path", "sha", "anchors"))
    assert notes.derive(docs, hashes, rec).where("path = 'n/x.md'").first().status == "current"
    moved = spark.createDataFrame([("a.rs#add", "9"), ("b.py", "2")], "anchor string, hash string")
    stale = notes.derive(docs, moved, rec)
    assert stale.where("path = 'n/x.md'").first().status == "stale"
    assert {r.path: r.action for r in notes.merge(stale, rec).collect()} == {"n/x.md": "kept"}
    assert {r.path: r.action for r in notes.merge(stale, rec, docs.select("path")).collect()} == {"n/x.md": "approved"}
    assert notes.derive(docs, moved.where("hash = '9'"), rec).where("path = 'n/x.md'").first().status == "broken"
    assert {r.status: r.n for r in notes.summary(first).collect()} == {"current": 0, "stale": 0, "broken": 0, "unanchored": 1, "new": 1}


def test_glossary(spark):
    first, second = "terms:\n  parcel: {en: Parcel, zh: 包裹, avoid: [封包]}\n  lane: {en: Lane, zh: 航线}\n", "terms:\n  parcel: {en: Parcel, zh: 封包}\n  2nd-leg: {en: leg, zh: 段, avoid: [段]}\n"
    g = tables.glossary(spark, [("freight", first), ("post", second)])
    assert {(r.key, r.domain, r.problem) for r in terms.validate(g).collect()} == {("parcel", "post", "conflict"), ("2nd-leg", "post", "bad-key"), ("2nd-leg", "post", "avoids-itself")}
    assert {r.key: r.zh for r in terms.merge(g).collect()} == {"parcel": "封包", "lane": "航线", "2nd-leg": "段"}
    glossary = spark.createDataFrame([("parcel", "Parcel", ["封包"], ["box"])], "key string, en string, avoid array<string>, aliases array<string>")
    rows = [("m.rs", 3, "一个封包", "struct Sled;"), ("m.rs", 5, "称封包", "fn weigh(parcel: &P)"), ("m.rs", 7, "封包", "parcels sandbox"), ("m.rs", 9, "封包", "// a Box"), ("m.rs", 11, "包裹", "parcel")]
    assert sorted(r.row for r in terms.lint(spark.createDataFrame(rows, "path string, row int, text string, context string"), glossary).collect()) == [5, 9]


def test_many_terms(spark):
    """5,000 terms from a table, among them forms of several words, of signs, and with what means something in patterns."""
    import random
    import re

    r = random.Random(4)
    word = lambda: "".join(r.choices("abc", k=r.randint(1, 4)))
    rows = [(f"k{i}_{word()}", r.choice([word(), f"{word()} {word()}", f"{word()}-{word()}", f"{word()}+", f"4{word()}", f".{word()}", "\\E", "é", None, ""]), [], r.choice([None, [], [word().upper()], [f"{word()}  {word()}", ""]])) for i in range(5000)]
    texts = [(i, " ".join(r.choice([word(), word().upper(), f"{word()}-{word()}", f"4{word()}.", "\\E", "é", f"x.{word()}", "\n"]) for _ in range(r.randrange(12)))) for i in range(40)]
    want = set()
    for key, en, _, aliases in rows:
        forms = {f.lower() for f in (en, key.replace("_", " "), key.replace("_", ""), *(aliases or [])) if f}
        pattern = re.compile("|".join(f"(?<![a-z]){re.escape(f)}(?![a-z])" for f in forms))
        want |= {(i, key) for i, t in texts if pattern.search(t.lower())}
    table = spark.createDataFrame(rows, "key string, en string, avoid array<string>, aliases array<string>")
    got = terms.relevant(spark.createDataFrame(texts, "doc int, text string"), table, "doc").collect()
    assert len(want) > 1000 and len(got) == len(want) and {tuple(x) for x in got} == want
    assert terms.relevant(spark.createDataFrame(texts, "doc int, text string"), table.limit(0), "doc").collect() == []


@pytest.mark.parametrize("few", [terms.FEW, 0])
def test_linted_rows(spark, few, monkeypatch):
    """Each word once, however many forms of its term stand there and forms hold forms; the rows themselves don't travel while forms are few."""
    import random
    import re

    monkeypatch.setattr(terms, "FEW", few)
    r = random.Random(7)
    word = lambda: "".join(r.choices("ab", k=r.randint(1, 3)))
    form = lambda: r.choice([word(), f"{word()} {word()}", f"4 {word()}", f"{word()}+{word()}", " ", "4 5"])
    glossary = [(f"k{i}_{word()}", form(), r.sample(["a", "bb", "4", " ", "", "b"], 3) + ["a"], [form().upper() for _ in range(r.randrange(6))]) for i in range(120)]
    lines_ = [" ".join(r.choice([form(), word().upper(), "5", "\t"]) for _ in range(r.randrange(9))) for _ in range(60)]
    files = spark.createDataFrame([("p.py", "\n".join(lines_)), ("q.py", ""), ("r.py", None)], "path string, text string")
    want = set()
    for key, en, avoid, aliases in glossary:
        own = {f.lower() for f in (en, key.replace("_", " "), key.replace("_", ""), *aliases) if f.strip()}
        pattern = re.compile("|".join(f"(?<![a-z]){re.escape(f)}(?![a-z])" for f in own))
        want |= {("p.py", i, b, key) for i, line in enumerate(lines_) for b in set(avoid) if b and b in line and pattern.search("\n".join(lines_[max(0, i - 1) : i + 1]).lower())}
    rows = lines.lines_with_above(files).select("path", "row", F.col("line").alias("text"), F.col("above").alias("context"))
    made = terms.lint(rows, tables.settled(spark.createDataFrame(glossary, "key string, en string, avoid array<string>, aliases array<string>")))
    got = [tuple(x) for x in made.collect()]
    assert len(want) > 1000 and len(got) == len(set(got)) and set(got) == want
    if few:
        plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert not any("Exchange hashpartitioning(path" in line for line in plan.splitlines())


def test_front_matter(spark):
    texts = {"flow": "---\ntitle: 'Ways # 1'\nanchors: [a.rs#x, \"b c.py\", 'd.go#T.M']\n---\nx", "block": "---\nanchors: # all\n- a.rs#x # here\n\n  # none\n- \"b.py\"\nother: 1\n---\n", "none": "---\nanchors: []\n---\n", "plain": "anchors: [a]\n"}
    rows = {r.path: (r.title, r.anchors) for r in notes.parse(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()}
    assert rows == {"flow": ("Ways # 1", ["a.rs#x", "b c.py", "d.go#T.M"]), "block": ("block", ["a.rs#x", "b.py"]), "none": ("none", []), "plain": ("plain", [])}


def test_whole_file_anchors_hash_by_id(spark):
    s = spark.createDataFrame([("A.b", "A", "1", "2", "3"), ("A", "A", "4", "5", "6")], "id string, path string, sig string, doc string, body string").withColumn("id", F.concat(F.lit("f#"), "id")).withColumn("path", F.lit("f"))
    got = notes.anchor_hashes(spark.createDataFrame([("f",)], "anchor string"), s).first().hash
    import hashlib

    short = lambda x: hashlib.sha256(x.encode()).hexdigest()[:12]
    assert got == short("\n".join(f"{i}:{short(h)}" for i, h in sorted([("f#A.b", "1|2|3"), ("f#A", "4|5|6")])))


def test_addresses(spark):
    for url, want in (("http://github.com/o/n.git", "o/n"), ("ssh://git@github.com:22/o/n", "o/n"), ("git@github.com:o/n.git", "o/n"), ("https://github.com/o/n/", "o/n"), ("https://example.com/o/n", None)):
        assert one(spark, T.repository_of(F.col("u")), u=url) == want


def test_ancestors_of_a_long_history(spark):
    """2,000 commits, every other a merge, and a branch of a branch of a branch; all that some commits reach, and what lies between two."""
    import random

    r = random.Random(6)
    parents = {}
    for n in range(1, 2_000):
        parents[n] = {n - 1} | ({max(0, n - r.randrange(2, 9))} if n % 2 else set())
    for n in range(2_000, 2_030):  # a branch of a branch of a branch
        parents[n] = {n - 1 if n % 10 else r.randrange(1_500)}
    parents[1_999] |= {2_029}

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            if (k := todo.pop()) not in seen:
                seen.add(k)
                todo += parents.get(k, ())
        return seen

    step = spark.createDataFrame([(n, p) for n, ps in parents.items() for p in ps], "sha long, parent long")
    levels = registry.lifted(step)
    assert len(levels) <= 12
    one = lambda *n: spark.createDataFrame([(k,) for k in n], "sha long")
    got = registry.ancestors(step, one(1_999, 2_015, 0), levels).collect()
    want = {(n, k) for n in (1_999, 2_015, 0) for k in reach(n)}
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    merges = {n for n, ps in parents.items() if len(ps) > 1}
    assert {x.sha for x in registry.commit_range(step, one(1_950), one(1_999)).collect()} == reach(1_999) - reach(1_950) - merges
    pairs = spark.createDataFrame([(3, 1_900), (1_900, 3), (2_029, 1_998), (2_029, 1_999), (5, 5)], "old long, new long")
    assert {(x.old, x.new): x.yes for x in registry.is_ancestor(step, pairs, levels).collect()} == {(3, 1_900): 3 in reach(1_900), (1_900, 3): False, (2_029, 1_998): False, (2_029, 1_999): True, (5, 5): True}
    assert registry.ancestors(step, one(1).limit(0)).collect() == []


def test_versions(spark):
    tags = spark.createDataFrame([("p", t) for t in ("v1.9.0", "v1.10.0", "v1.10.0-rc1", "x", "v1.2.0")], "project string, tag string")
    r = registry.behind(tags, spark.createDataFrame([("p", "v1.2.0"), ("q", "v1.0.0")], "project string, ref string"))
    assert {x.project: (x.latest, x.behind) for x in r.collect()} == {"p": ("v1.10.0", 2), "q": (None, 0)}


def test_renames_pair_first_with_first(spark):
    s = "id string, kind string, body string, body_lines int, ord int"
    old = spark.createDataFrame([("a", "fn", "h", 2, 0), ("b", "fn", "h", 2, 1), ("c", "fn", "e", 0, 2), ("k", "fn", "k", 1, 3)], s)
    new = spark.createDataFrame([("y", "fn", "h", 2, 5), ("x", "fn", "h", 2, 4), ("z", "fn", "e", 0, 6), ("k", "fn", "k", 1, 3)], s)
    assert {(r.old_id, r.new_id) for r in diff.rename_pairs(old, new).collect()} == {("a", "x"), ("b", "y")}


def test_patch(spark):
    files = spark.createDataFrame([("a.py", "x\n  y\n"), ("b.py", "x\n\n")], "path string, text string")
    edits = spark.createDataFrame([("a.py", 1, 0, f"# {M} p"), ("a.py", 1, 1, f"# {M} q"), ("b.py", 1, 0, f"# {M} p")], "path string, row int, seq int, line string")
    got = {r.path: (r.outcome, r.text) for r in work.apply_patch(files, edits).collect()}
    assert got == {"a.py": ("applied", f"x\n  # {M} p\n  # {M} q\n  y\n"), "b.py": ("rejected", "x\n\n")}


def test_patch_by_symbol(spark):
    text = f"# {M} old\nf\n  # {M} older\n  y\ng\n# {M} stays\nh\n"
    files = spark.createDataFrame([("a.py", text), ("b.py", "x\n")], "path string, text string")
    symbols = spark.createDataFrame([("a.py", "f", 1, 3, [0, 2]), ("a.py", "g", 4, 4, []), ("a.py", "h", 6, 6, [5]), ("b.py", "x", 0, 0, None)], "path string, id string, start int, end int, zh_rows array<int>")
    new = f"# {M} new"
    edits = [("a.py", "f", 3, 0, new), ("a.py", "g", 4, 0, new), ("a.py", "h", 6, 0, new), ("a.py", "h", 1, 1, new), ("a.py", "gone", 4, 2, new), ("b.py", "x", 1, 0, new)]
    got = {r.path: (r.outcome, r.text, r.rejected) for r in work.apply_patch(files, spark.createDataFrame(edits, "path string, symbol string, row int, seq int, line string"), symbols=symbols).collect()}
    assert got == {"a.py": ("applied", f"f\n  {new}\n  y\n{new}\ng\n# {M} stays\nh\n", ["gone", "h"]), "b.py": ("rejected", "x\n", ["x"])}


def test_reports_and_files(spark, tmp_path):
    rows = tables.settled(state.derive(symbols(spark, CODE), flat(spark, [])))
    told = json.loads(reports.status_report(rows, project="p").first().report)
    assert told["symbols"]["translated"] == 1 and told["files"]["in_scope"] == 1 and told["coverage"] == 0.5
    more = spark.createDataFrame([("depot.ts", 1), ("notes.sql", 2), ("none.sql", 0)], "path string, n long")
    told = json.loads(reports.status_report(rows, counts=more, orphaned=spark.createDataFrame([("x",)], "id string"), at=F.lit("2024-05-01T00:00:00")).first().report)
    assert told["files"] == {"in_scope": 3, "translated": 2, "stale": 0, "pending": 1} and (told["zh_lines"], told["orphaned"], told["generated_at"]) == (3, 1, "2024-05-01T00:00:00")
    rec = state.merge(flat(spark, []), symbols(spark, CODE), "me").select(*state.RECORD)
    tables.write_records(rec, str(tmp_path / "state"))
    assert tables.read_records(spark, str(tmp_path / "state")).first().asDict() == rec.first().asDict()
    docs = spark.createDataFrame([("n/b.md", "1", {"a.rs#x": "h"}), ("n/a.md", "2", {})], tables.DOC_RECORDS)
    tables.write_doc_records(docs, str(tmp_path / "docs"))
    assert sorted(map(tuple, tables.read_doc_records(spark, str(tmp_path / "docs")).collect())) == sorted(map(tuple, docs.collect()))
    assert tables.sync_anchor("anchor: {upstream_commit: abc, upstream_ref: v1}\n") == {"commit": "abc", "ref": "v1"} and tables.sync_anchor("")["commit"] is None
    listed = tables.registry(spark, ["id: p\nname: P\nupstream: {url: u}\npriority: 2\ncategories: [x]\n", "id: q\n"]).collect()
    assert [tuple(r) for r in listed] == [("p", "P", "u", 2, ["x"]), ("q", None, None, None, [])]
    assert tables.replaced_between("a<b>x<e>c", "y", "<b>", "<e>") == "a<b>\ny\n<e>c"
    assert tables.replaced_between("a<b>\ny 1\n<e>c", "y 2", "<b>", "<e>", r"\d") is None
    (tmp_path / "w" / "src").mkdir(parents=True)
    (tmp_path / "w" / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "w" / "src" / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "w" / "b.py").write_text("y")
    assert [(r.path, r.text) for r in files.worktree(spark, str(tmp_path / "w"), ["src/**"]).collect()] == [("src/a.py", "x = 1\n")]
    assert tables.project("project: p\nscope: {include: [src/**]}\n")["marker"] == M
    assert "class='zh'" in reports.pages(spark.createDataFrame([("a.py", f"# {M} <b>")], "path string, text string")).first().html


def snapshot(spark, tmp_path, n, *files):
    """Land the symbols of some files; a file without text is gone."""
    names = ("id", "path", "sig", "doc", "body", "zh", "translatable")
    for path, text in files:
        rows = symbols(spark, text, path).select(*names) if text is not None else spark.createDataFrame([(None, path, None, None, None, None, None)], follow.SYMBOLS.replace(", at timestamp", ""))
        rows.withColumn("at", F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def run_stream(spark, tmp_path):
    follow.follow(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    return {r.id: r for r in follow.records(spark, str(tmp_path / "table")).collect()}


def test_stream(spark, tmp_path):
    snapshot(spark, tmp_path, 1, ("depot.ts", CODE), ("till.go", f"package till\n\n// {M} 税\nfunc tax() int {{\n\treturn 19\n}}\n"), ("quiet.ts", "export const q = 1;\n"))
    first = run_stream(spark, tmp_path)
    assert set(first) == {"depot.ts#weigh", "till.go#tax"}
    snapshot(spark, tmp_path, 2, ("depot.ts", CODE.replace("weigh(", "lift(")))
    second = run_stream(spark, tmp_path)
    assert set(second) == {"depot.ts#lift", "till.go#tax"} and second["depot.ts#lift"].at_sig == first["depot.ts#weigh"].at_sig
    snapshot(spark, tmp_path, 3, ("till.go", None))
    assert set(run_stream(spark, tmp_path)) == {"depot.ts#lift"}
    n = follow.changes_per_window(spark.read.parquet(str(tmp_path / "in")).where("id IS NOT NULL"), "1 day").collect()
    assert sorted((r.n, r.annotated) for r in n) == [(2, 1), (5, 2)]


def test_a_batch_of_the_stream_writes_what_it_changed(spark, tmp_path):
    """Many records, then a batch that touches one; a batch that is tried again; a table put together anew."""
    table = str(tmp_path / "table")
    many = "package a\n\n" + "".join(f"// {M} n{i}\nfunc F{i}() {{\n\treturn\n}}\n\n" for i in range(300))
    snapshot(spark, tmp_path, 1, ("a.go", many), ("b.go", f"package b\n\n// {M} b\nfunc B() {{}}\n"))
    assert len(run_stream(spark, tmp_path)) == 301
    snapshot(spark, tmp_path, 2, ("a.go", many.replace("n7\n", "seven\n")))
    after = run_stream(spark, tmp_path)
    assert len(after) == 301 and after["a.go#F7"].zh != after["a.go#F8"].zh
    written = spark.read.parquet(table).where("batch = 1")
    assert [r.id for r in written.collect()] == ["a.go#F7"]
    assert written.select("bucket").distinct().count() == 1
    again = spark.read.parquet(str(tmp_path / "in")).where("at = '2024-01-02 00:00:00'")
    follow.merge_batch(again, 1, table)
    assert {r.id: r for r in follow.records(spark, table).collect()} == after
    follow.compact(spark, table, str(tmp_path / "anew"))
    assert {r.id: r for r in follow.records(spark, str(tmp_path / "anew")).collect()} == after and spark.read.parquet(str(tmp_path / "anew")).count() == 301
