"""Owners, nearest lines and resolved files, against brute force and at sizes where a product of rows would show."""

import random
import time

from pyspark.sql import functions as F

from glosswork.extract import braced, index
from glosswork.functions import text as T
from glosswork.operators import lines, placement, reattach, verify
from glosswork.sources import tables

M = T.MARKER
SYMBOLS = "path string, id string, start long, end long, ord int"


def test_owners_are_the_innermost(spark):
    r = random.Random(3)
    symbols = []
    for p in range(12):
        for n in range(r.choice([0, 1, 5, 30])):
            a = r.randrange(60)
            symbols.append((f"f{p}", f"f{p}#{n}", a, a + r.choice([0, 1, 2, 7, 8, 31, 50]), r.randrange(4)))
    symbols.append(("f1", "f1#empty", 9, 8, 0))
    rows = [(f"f{p}", k) for p in range(13) for k in range(80)]
    want = {}
    for path, k in rows:
        around = [(e - s, o, i) for q, i, s, e, o in symbols if q == path and s <= k <= e]
        want[path, k] = min(around)[2] if around else f"{path}#<module>"
    got = lines.owner_join(spark.createDataFrame(rows, "path string, row long"), spark.createDataFrame(symbols, SYMBOLS)).collect()
    assert len(got) == len(rows) and {(x.path, x.row): x.id for x in got} == want


def test_owners_of_nothing(spark):
    none, rows = spark.createDataFrame([], SYMBOLS), spark.createDataFrame([("a", 0)], "path string, row long")
    assert lines.owner_join(rows, none).collect() == [("a", 0, "a#<module>")]
    assert lines.owner_join(rows.limit(0), none).collect() == []


def test_blocks_of_a_span_make_it_up(spark):
    spans = [(a, b) for a in range(0, 40, 3) for b in range(a, 70, 5)]
    for x in spark.createDataFrame(spans, "a long, b long").select("a", "b", lines.dyadic(F.col("a"), F.col("b")).alias("d")).collect():
        rows = [k for level, block in x.d for k in range(block << level, (block + 1) << level)]
        assert sorted(rows) == list(range(x.a, x.b + 1)) and len(x.d) <= 2 * 7


def test_many_symbols_of_a_long_file_are_no_product(spark):
    """20,000 rows and 2,000 nested symbols of one file: 40 million pairs, or some 100,000 blocks."""
    n = 2000
    symbols = spark.range(n).select(F.lit("a").alias("path"), F.concat(F.lit("a#"), "id").alias("id"), F.col("id").alias("start"), (20_000 - F.col("id")).alias("end"), F.lit(0).alias("ord"))
    rows = spark.range(20_000).select(F.lit("a").alias("path"), F.col("id").alias("row"))
    blocks = symbols.select(F.explode(lines.dyadic(F.col("start"), F.col("end")))).count()
    assert blocks < 2 * 15 * n
    got = {x.row: x.id for x in lines.owner_join(rows, symbols).collect()}
    assert all(got[k] == f"a#{min(k, 20_000 - k, n - 1)}" for k in range(20_000))


def test_nearest(spark):
    r = random.Random(8)
    points = sorted({(r.choice("xyz"), r.randrange(50)) for _ in range(60)})
    asked = [(n, r.choice("xyzw"), *sorted((r.randrange(50), r.randrange(50))), r.randrange(-10, 60)) for n in range(300)]
    got = lines.nearest(spark.createDataFrame(asked, "n int, key string, low int, high int, want int"), spark.createDataFrame(points, "key string, row int"), ["key"], ["n"])
    want = {}
    for n, key, low, high, near in asked:
        if found := [(abs(p - near), p) for k, p in points if k == key and low <= p <= high]:
            want[n] = min(found)[1]
    assert {x.n: x.found for x in got.collect()} == want


def brute_merge(ours, theirs, mine, other):
    """Their text with our blocks, block by block; symbols: id -> (start, end); both nested properly."""
    mark = [line.strip().startswith(f"# {M}") for line in ours]
    inserts, outcomes, k = [], {}, 0
    while k < len(ours):
        if not mark[k]:
            k += 1
            continue
        first = k
        while k < len(ours) and mark[k]:
            k += 1
        around = [(e - s, i) for i, (s, e) in mine.items() if s <= first <= e]
        owner = min(around)[1] if around else "m"
        if owner != "m" and owner not in other:
            outcomes[first] = ("orphaned", None)
            continue
        nxt = next((x for x, z in zip(ours[k:], mark[k:], strict=True) if not z), None)
        prv = next((x for x, z in zip(ours[:first][::-1], mark[:first][::-1], strict=True) if not z), None)
        begin = mine[owner][0] if owner != "m" else 0
        offset = sum(not z for z in mark[begin:first])
        low, high = other[owner] if owner != "m" else (0, len(theirs) - 1)
        inside = [r for r in range(low, high + 1) if r < len(theirs)]
        at = None
        if nxt is not None and nxt.strip():
            same = [r for r in inside if theirs[r].strip() == nxt.strip()]
            exact = [r for r in same if prv is not None and r and theirs[r - 1].strip() == prv.strip()]
            at = min(exact or same, key=lambda r: (abs(r - low - offset), r), default=None)
        if at is None and prv is not None and prv.strip():
            at = min((r + 1 for r in inside if theirs[r].strip() == prv.strip()), key=lambda r: (abs(r - low - offset), r), default=None)
        margin = lambda line: line[: len(line) - len(line.lstrip())]
        if at is not None:
            outcomes[first] = ("reattached", at)
            space = margin(theirs[at]) if at < len(theirs) and theirs[at].strip() else margin(nxt or "")
        else:
            at = low
            outcomes[first] = ("relocated", at)
            space = margin(theirs[at])
        inserts.append((at, first, [space + x.strip() for x in ours[first:k]]))
    out = []
    for r in range(len(theirs) + 1):
        for _, _, new in sorted(x for x in inserts if x[0] == r):
            out += new
        out += theirs[r : r + 1]
    return outcomes, "\n".join(out)


def test_files_are_merged_as_block_by_block(spark):
    r = random.Random(21)
    say = ["}", "a", "b", "  a", "    c", "", "  ", "d", "{"]
    files, mine, other, want = [], [], [], {}
    for n in range(60):
        path, size = f"f{n}.py", r.randrange(1, 25)
        code = [r.choice(say) for _ in range(size)]
        ours, at = [], []
        for k, line in enumerate(code):
            for _ in range(r.choice([0, 0, 1, 2])):
                ours.append(f"{' ' * r.randrange(4)}# {M} {n} {k}")
            at.append(len(ours))
            ours.append(line)
        ours += [f"# {M} end"] * r.choice([0, 1])
        theirs = [x for x in code if r.random() < 0.8] + [r.choice(say) for _ in range(r.randrange(4))]
        r.random() < 0.3 and r.shuffle(theirs)
        theirs = theirs or ["x"]
        a, b = {}, {}
        if size > 3:
            s, e = sorted(r.sample(range(size), 2))
            a["s"] = (at[s], at[e])
            if r.random() < 0.8:
                b["s"] = (min(s, len(theirs) - 1), min(e + r.randrange(2), len(theirs) - 1))
        want[path] = brute_merge(ours, theirs, a, b)
        files.append((path, "\n".join(ours), "\n".join(theirs)))
        mine += [(path, f"{path}#{i}", s, e, s, 0) for i, (s, e) in a.items()]
        other += [(path, f"{path}#{i}", s, e, s, 0) for i, (s, e) in b.items()]
    schema = "path string, id string, start long, end long, item_row long, ord int"
    df = spark.createDataFrame(files, "path string, a string, b string")
    sides = [df.select("path", F.col(c).alias("text")) for c in "ab"]
    sa, sb = spark.createDataFrame(mine, schema), spark.createDataFrame(other, schema)
    placed = reattach.place(*sides, sa, sb)
    got = {}
    for x in placed.collect():
        got.setdefault(x.path, {})[x["first"]] = (x.outcome, x["at"])
    assert {p: got.get(p, {}) for p in want} == {p: o for p, (o, _) in want.items()}
    assert {x.path: x.text for x in reattach.rebuild(*sides, placed).collect()} == {p: t for p, (_, t) in want.items()}


def test_twenty_thousand_equal_lines(spark):
    """Every block stands by a line that all others stand by too: pairs would be 400 million."""
    n = 20_000
    ours, theirs = "\n".join([f"# {M} x\n}}"] * n), "\n".join(["}"] * n)
    a, b = (spark.createDataFrame([("x.py", t)], "path string, text string") for t in (ours, theirs))
    none = spark.createDataFrame([], "path string, id string, start long, end long, item_row long, ord int")
    began = time.perf_counter()
    placed = reattach.place(a, b, none, none)
    assert placed.where("outcome = 'reattached' AND at * 2 = first").count() == n
    assert time.perf_counter() - began < 60


def test_resolved_files(spark):
    rows = [("a.py", "x\n", f"# {M} n\nx\n", "y\nx\n"), ("b.bin", "1", "1", "2"), ("c.bin", "1", "3", "2"), ("d.py", "x", f"# {M} n\nx", None), ("e.py", "x", None, "y"), ("f.bin", None, "3", "2")]
    none = spark.createDataFrame([], "path string, id string, start long, end long, item_row long, ord int")
    got = reattach.resolve(spark.createDataFrame(rows, "path string, base string, ours string, theirs string"), none, none).collect()
    assert {x.path: (x.outcome, x.text) for x in got} == {"a.py": ("merged", f"y\n# {M} n\nx\n"), "b.bin": ("taken", "2"), "c.bin": ("unsupported", None), "d.py": ("deleted", None), "e.py": ("unsupported", None), "f.bin": ("taken", "2")}


def test_texts_of_conflicts_travel_once(spark):
    """Rows of files don't travel, nor does the base: one exchange of both sides, one of each side's symbols."""
    rows = [("a.py", 1, "x\n"), ("a.py", 2, f"# {M} n\nx\n"), ("a.py", 3, "y\nx\n"), ("b.bin", 1, "1"), ("b.bin", 2, "1"), ("b.bin", 3, "2"), ("c.bin", 1, "1"), ("c.bin", 2, "3"), ("c.bin", 3, "2"), ("e.py", 1, "x"), ("e.py", 3, "y"), ("f.bin", 2, "3"), ("f.bin", 3, "2")]
    schema = "path string, id string, start long, end long, item_row long, ord int"
    a, b = spark.createDataFrame([("a.py", "a.py#s", 1, 1, 1, 0)], schema), spark.createDataFrame([("a.py", "a.py#s", 0, 1, 0, 0)], schema)
    stages = tables.changed_stages(spark.createDataFrame(rows, "path string, stage int, text string"))
    made = reattach.resolve(stages, a, b)
    assert {x.path: (x.outcome, x.text) for x in made.collect()} == {"a.py": ("merged", f"y\n# {M} n\nx\n"), "b.bin": ("taken", "2"), "c.bin": ("unsupported", None), "e.py": ("unsupported", None), "f.bin": ("taken", "2")}
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 3 and "Generate" not in plan and "Window" not in plan


# --- where annotations may not stand ---


def test_open_strings_are_the_scanners(spark):
    r = random.Random(1)
    bits = ["'", '"', "'''", '"""', "\\", "#", " ", "a", "\n", "\n", f"\n# {M} x\n", "r'", 'f"', "\\\n", "''", '""', "\r", "é"]
    files = [(f"f{i}.py", "".join(r.choice(bits) for _ in range(r.randrange(40))) + "\n") for i in range(600)]
    files.append(("long.py", ("x = '''\n" + f"# {M} y\n" * 3 + "'''\n") * 15_000))  # more rows than a block of blocks has
    files.append(("wide.py", "'''" + "ab'" * 100_000 + f"\n# {M} q\n'''\n"))
    want = sorted((p, row) for p, t in files for row, c in index.lint(p, t) if c == "zh-in-string")
    got = sorted((x.path, x.row) for x in placement.misplaced(spark.createDataFrame(files, "path string, text string")).collect())
    assert len(want) > 45_000 and got == want


def test_fences_are_the_scanners(spark):
    r = random.Random(2)
    bits = ["/// ```", "//! ```", "/// a", "//! b", "fn f() {", "}", "    let x = 1;", "  /// ```rust", f"/// {M} n", f"//! {M} n", f"    /// {M} n", f"// {M} n", "", "///", "//// x"]
    files = [(f"f{i}.rs", "\n".join(r.choice(bits) for _ in range(r.randrange(30)))) for i in range(400)]
    bodies = [(p, s.item_row + 1, s.end - 1) for p, t in files for s in braced.extract(t, "rs")[0] if s.kind in ("fn", "method")]
    want = sorted((p, row, c) for p, t in files for row, c in index.lint(p, t))
    got = placement.misplaced(spark.createDataFrame(files, "path string, text string"), spark.createDataFrame(bodies, "path string, start int, end int"))
    assert {c for _, _, c in want} == {"zh-in-code-block", "doc-in-body"} and sorted((x.path, x.row, x.code) for x in got.collect()) == want


def test_files_without_annotations_are_not_read_by_rows(spark):
    files = spark.createDataFrame([("a.py", "x"), ("b.rs", ""), ("c.py", None)], "path string, text string")
    assert placement.misplaced(files).collect() == [] and placement.misplaced(files.limit(0)).collect() == []


def test_what_may_be_imported(spark):
    cases = [("a", "a\n@i\n", "a\n", True), ("b", "a\n\n \n  @i \n\n", "a", True), ("c", "a\n@i\nb", "a\nb", False), ("d", "@i", "", True), ("e", "a\nb @i", "a\nb ", False), ("f", "a\n", "a\n\n", True), ("g", "a\n@i\n@i", "a\n@i", True)]
    df = spark.createDataFrame(cases, "k string, mine string, theirs string, ok boolean")
    for x in df.select("*", (verify.without_import(F.col("mine"), "@i") == F.regexp_replace("theirs", r"\n*\z", "")).alias("got")).collect():
        assert x.got == x.ok, x


def test_the_ladder_tells_the_first_problem_and_how_many_more(spark):
    up = [("a.py", 's = """\nx\n"""\n'), ("b.rs", "/// ```\n/// x\nfn f() {}\n"), ("c.go", "package c\n"), ("d.py", "x\n"), ("same.py", "x")]
    mine = [("a.py", f's = """\n# {M} 1\nx\n# {M} 2\n"""\n# {M} 3\n'), ("b.rs", f"/// ```\n/// {M} 1\n/// x\nfn f() {{}}\n"), ("c.go", f"// {M} 1\npackage c\n"), ("d.py", f"# {M} 1\ny\n"), ("same.py", "x")]
    a, b = (spark.createDataFrame(x, "path string, text string") for x in (mine, up))
    got = [tuple(x) for x in verify.issues(a, b, elsewhere=spark.createDataFrame([("z.md", "ignored")], "path string, code string")).collect()]
    assert got == [("a.py", "zh-in-string", 2, 1), ("b.rs", "zh-in-code-block", 2, 0), ("d.py", "code-modified", 2, 0), ("z.md", "ignored", None, 0)]
    assert verify.issues(a.limit(0), b.limit(0)).collect() == []


def test_comments_above_an_item(spark):
    text = ["# a", "# b", "def f(): pass", "", "# c", "", "x = 1", "  # d", "  y = 2"]
    rows = spark.createDataFrame([("p", k, t) for k, t in enumerate(text)], "path string, row int, line string")
    got = {x.row: x["first"] for x in placement.leading_comments(rows, rows.where("row IN (2, 6, 8)")).collect()}
    assert got == {2: 0, 6: 6, 8: 7}
