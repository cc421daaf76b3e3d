"""Folders of files, tables by contents."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from glosswork.plans import reports
from glosswork.sources import cache, files, tables


TREE = {"src/a b.py": "x = 1\n", "src/c+d%41é.py": "y", "src/gen/e.py": "z", "src/huge.bin": "0" * 5000, "top.py": "no", "src/bad.py": b"\xff", "src/deep/er/still/__init__.py": "", "src/deep/f.py": "f"}


def tree(folder):
    for path, text in TREE.items():
        place = folder / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def test_files_of_a_folder(spark, tmp_path):
    root = tree(tmp_path / "w")
    got = files.worktree(spark, root, ["src/**"], ["*.bin"], generated=["gen/"])
    want = {"src/a b.py": "x = 1\n", "src/c+d%41é.py": "y", "src/deep/er/still/__init__.py": "", "src/deep/f.py": "f"}
    assert {r.path: r.text for r in got.collect()} == want and got.count() == len(want)
    every = {r.path: r.text for r in files.worktree(spark, "file://" + root, ["**"], ["*.bin"], "replace", parts=1).collect()}
    assert every["src/bad.py"] == "�" and set(every) == set(TREE) - {"src/huge.bin"}
    assert files.worktree(spark, str(tmp_path / "nowhere"), ["**"]).collect() == []


def test_path_filters_are_pushed_to_the_listing(spark, tmp_path):
    root = tree(tmp_path / "w")
    one = files.worktree(spark, root, ["**"]).where("path = 'src/deep/f.py'")
    assert [tuple(r) for r in one.collect()] == [("src/deep/f.py", "f")]
    assert [r.path for r in files.worktree(spark, root, ["**"]).where("path LIKE 'src/deep/%' AND length(text) = 0").collect()] == ["src/deep/er/still/__init__.py"]
    assert sorted(r.path for r in files.worktree(spark, root, ["**"]).where("path IN ('top.py', 'src/gen/e.py', 'none')").collect()) == ["src/gen/e.py", "top.py"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan, plan  # nothing is left to do above the scan
    reader = files._Reader({"path": root, "parts": "1"})
    assert list(reader.pushFilters([files.EqualTo(("path",), "src/deep/f.py")])) == [] and [p.path for p in reader.partitions()] == ["", "src", "src/deep"]


def test_spark_opens_no_files_out_of_scope(spark, tmp_path):
    root = tree(tmp_path / "w")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # a larger file that is opened is an error
    try:
        got = files.worktree_by_spark(spark, root, ["src/**"], ["*.bin"], generated=["gen/"])
        assert sorted(map(tuple, got.collect())) == [("src/a b.py", "x = 1\n"), ("src/c+d%41é.py", "y"), ("src/deep/f.py", "f")]
        with pytest.raises(Exception, match="5000"):
            files.worktree_by_spark(spark, root, ["src/**"]).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_files_are_written_one_a_path(spark, tmp_path):
    rows = [(f"d{i % 7}/f {i}é.py", f"text {i}\n" * (i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "path string, text string")
    root = str(tmp_path / "out")
    files.write_files(df, root)
    assert (tmp_path / "out" / "_WRITTEN").read_text().split()[1] == "200"
    files.write_files(df.where("path LIKE 'd1/%'").withColumn("text", F.lit("anew")), root)  # again over what is there
    want = {p: "anew" if p.startswith("d1/") else t for p, t in rows}
    assert {r.path: r.text for r in files.worktree(spark, root, ["d*/**"]).collect()} == want
    assert not list((tmp_path / "out").rglob("*.new"))


def test_a_failing_write_leaves_whole_files_and_no_mark(spark, tmp_path):
    root = tmp_path / "out"
    files.write_files(spark.createDataFrame([("a.py", "old")], "path string, text string"), str(root))
    (root / "b.py").mkdir()  # a folder where a file should go
    with pytest.raises(Exception):
        files.write_files(spark.createDataFrame([("a.py", "new"), ("b.py", "x")], "path string, text string").coalesce(1), str(root))
    assert (root / "a.py").read_text() in ("old", "new") and not (root / "_WRITTEN").exists() and not list(root.rglob("*.new"))
    with pytest.raises(Exception, match="leads out"):
        files.write_files(spark.createDataFrame([("../x.py", "x")], "path string, text string"), str(root))


def test_a_site_is_written_and_read_back(spark, tmp_path):
    pages = reports.pages(spark.createDataFrame([("a.py", "x\n# y"), ("sub/b.py", "z")], "path string, text string"))
    files.write_files(pages.select(F.concat("path", F.lit(".html")).alias("path"), F.col("html").alias("text")), str(tmp_path / "site"))
    got = {r.path: r.text for r in files.worktree(spark, str(tmp_path / "site"), ["*.html"]).collect()}
    assert got == {f"{r.path}.html": r.html for r in pages.collect()} and len(got) == 2


def test_only_changed_files_are_made_again(spark, tmp_path):
    schema, asked = S.StructType.fromDDL("path string, word string"), []

    def make(some):
        asked.append(sorted(r.path for r in some.select("path").collect()))
        return some.select("path", F.explode(F.filter(F.split("text", " "), lambda w: w != "")).alias("word"))

    def run(rows, table="cache"):
        found, fresh = cache.made(spark.createDataFrame(rows, "path string, text string"), make, schema, str(tmp_path / table))
        return sorted(map(tuple, found.collect())), sorted(r.path for r in fresh.collect())

    first = [(f"f{i}", f"a{i} b{i}") for i in range(30)] + [("empty", "")]
    want = sorted((p, w) for p, t in first for w in t.split())
    assert run(first) == (want, sorted(p for p, _ in first))
    assert run(first) == (want, []) and len(asked) == 1
    second = [("f0", "new words"), *first[1:20], ("moved", "a3 b3")]
    assert run(second) == (sorted((p, w) for p, t in second for w in t.split()), ["f0", "moved"]) and asked[-1] == ["f0", "moved"]
    assert run(first)[1] == [] and run([]) == ([], [])
    cache.pruned(spark.createDataFrame(second, "path string, text string"), schema, str(tmp_path / "cache"), str(tmp_path / "less"))
    assert spark.read.parquet(str(tmp_path / "less")).count() == len(second) and run(second, "less")[1] == []
    assert run(first, "less")[1] == sorted(["f0", "empty", *(f"f{i}" for i in range(20, 30))])


def test_a_revision_reads_its_folder(spark, tmp_path):
    blobs = spark.createDataFrame([("r1", "a.py", b"1"), ("r2", "a.py", b"2"), ("r2", "b.py", b"\xff")], "rev string, path string, content binary")
    blobs.write.partitionBy("rev").parquet(str(tmp_path / "blobs"))
    got = tables.at_revision(spark.read.parquet(str(tmp_path / "blobs")), "r2")
    assert sorted(map(tuple, got.collect())) == [("a.py", "2"), ("b.py", "�")]
    assert "PartitionFilters: [isnotnull(rev" in got._jdf.queryExecution().executedPlan().toString()
