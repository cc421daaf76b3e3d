"""Reading and writing tables: snapshots of files, JSON lines, YAML, and tables that end a lineage."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import text as T

RECORDS = "id string, at struct<sig: string, doc: string, body: string>, zh string, by string, review struct<by: string, at: string, hashes: struct<sig: string, doc: string, body: string, zh: string>>"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of this machine's only where the session names none and all runs on this machine, as in tests."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        told = getattr(shared_dir, "own", None)
        if not told:
            told = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="glosswork-")
    return told.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may be gone when Python ends
        pass


#: Tables of the scratch scopes that are open, the innermost last.
_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that `settled` writes inside go when the scope ends, but for those with keep, which belong to the scope around it, or stay."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _drop(spark, path)


def own_folder(spark: SparkSession, keep: bool = False) -> str:
    """A new folder in the shared one. It goes at the end of the scratch scope, with keep of the one around that; outside of any, when the Python process ends."""
    path = f"{shared_dir(spark)}/glosswork/{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if keep else _scopes
    scopes[-1].append((spark, path)) if scopes else atexit.register(_drop, spark, path)
    return path


#: Whether Spark deletes a query's shuffle files when it has run; otherwise they stay until the driver's JVM happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """What is written or collected inside leaves no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settled(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and lost executors cost no recomputation.

    The table goes as own_folder() says, and the shuffle files that made it as soon as it is written.
    """
    spark = df.sparkSession
    path = own_folder(spark, keep)
    with cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_revision(blobs: DataFrame, rev: str) -> DataFrame:
    """path, text of blobs (rev, path, content) at a revision; a table partitioned by rev reads that partition alone."""
    return blobs.where(F.col("rev") == rev).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def overridden(diff: DataFrame, untracked: DataFrame) -> DataFrame:
    """path, change: untracked paths (path) count as added, whatever the diff says."""
    return diff.join(untracked.select("path"), "path", "left_anti").unionByName(untracked.select("path", F.lit("A").alias("change")))


def merge_stages(stages: DataFrame) -> DataFrame:
    """path, base, ours, theirs of conflicted files (path, stage 1 to 3, text)."""
    return stages.groupBy("path").agg(*(F.max(F.when(F.col("stage") == n, F.col("text"))).alias(name) for n, name in ((1, "base"), (2, "ours"), (3, "theirs"))))


def changed_stages(stages: DataFrame) -> DataFrame:
    """path, changed, ours, theirs of conflicted files (path, stage 1 to 3, text). changed: whether ours differs from the base, of which only a digest travels; null without one of them."""
    text = lambda n: F.max(F.when(F.col("stage") == n, F.col("text")))
    base = F.max(F.when(F.col("stage") == 1, F.sha2("text", 256)))
    rows = stages.groupBy("path").agg(base.alias("base"), text(2).alias("ours"), text(3).alias("theirs"))
    return rows.select("path", (F.col("base") != F.sha2("ours", 256)).alias("changed"), "ours", "theirs")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """State records in JSON lines, as the flat table that operators.state takes."""
    r = spark.read.schema(RECORDS).json(path)
    flat = {"at_sig": "at.sig", "at_doc": "at.doc", "at_body": "at.body", "zh": "zh", "by": "by", "review_sig": "review.hashes.sig", "review_doc": "review.hashes.doc", "review_body": "review.hashes.body", "review_zh": "review.hashes.zh"}
    return r.select("id", *(F.col(v).alias(k) for k, v in flat.items()))


def write_records(records: DataFrame, path: str, today: str | None = None) -> None:
    """Sorted JSON lines; sorting is by range, so no one task gets all."""
    review = F.when(F.col("review_zh").isNotNull(), F.struct("by", F.lit(today).alias("at"), F.struct(F.col("review_sig").alias("sig"), F.col("review_doc").alias("doc"), F.col("review_body").alias("body"), F.col("review_zh").alias("zh")).alias("hashes")))
    records.select("id", F.struct(F.col("at_sig").alias("sig"), F.col("at_doc").alias("doc"), F.col("at_body").alias("body")).alias("at"), "zh", "by", review.alias("review")).orderBy("id").write.mode("overwrite").json(path)


DOC_RECORDS = "path string, sha string, anchors map<string,string>"


def read_doc_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of analysis documents in JSON lines, as operators.notes takes them."""
    return spark.read.schema(DOC_RECORDS).json(path)


def write_doc_records(records: DataFrame, path: str) -> None:
    """Sorted JSON lines."""
    records.select("path", "sha", "anchors").orderBy("path").write.mode("overwrite").json(path)


def sync_anchor(text: str) -> dict:
    """The upstream commit that a project stands at, and its name."""
    import yaml

    anchor = (yaml.safe_load(text) or {}).get("anchor") or {}
    return {"commit": anchor.get("upstream_commit"), "ref": anchor.get("upstream_ref")}


def registry(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Projects of registry files in YAML: project, name, url, priority, categories. A list of driver-side texts, a project each."""
    import yaml

    rows = []
    for text in texts:
        t = yaml.safe_load(text) or {}
        url = (t.get("upstream") or {}).get("url") if isinstance(t.get("upstream"), dict) else t.get("upstream")
        rows.append((t.get("id") or t.get("project"), t.get("name"), url, t.get("priority"), list(t.get("categories") or [])))
    return spark.createDataFrame(rows, "project string, name string, url string, priority long, categories array<string>")


def write_status(report: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def append_history(spark: SparkSession, path: str, row: dict) -> None:
    """One sync more; the anchor is the last row."""
    spark.read.json(spark.sparkContext.parallelize([json.dumps(row)])).write.mode("append").parquet(path)


def glossary(spark: SparkSession, domains: list[tuple[str, str]]) -> DataFrame:
    """Terms of YAML texts (domain, text), in the order in which later ones win."""
    import yaml

    rows = []
    for pos, (domain, text) in enumerate(domains):
        for key, t in ((yaml.safe_load(text) or {}).get("terms") or {}).items():
            rows.append((domain, pos, key, t.get("en"), t.get("zh"), list(t.get("avoid") or []), list(t.get("aliases") or [])))
    return spark.createDataFrame(rows, "domain string, domain_pos int, key string, en string, zh string, avoid array<string>, aliases array<string>")


def project(text: str) -> dict:
    """A project's settings with defaults for what is left out."""
    import yaml

    told = yaml.safe_load(text) or {}
    scope = told.get("scope") or {}
    return {"project": told.get("project"), "include": scope.get("include") or ["**"], "exclude": scope.get("exclude") or [], "generated": told.get("generated") or [], "marker": told.get("marker") or T.MARKER, "tag_pattern": (told.get("upstream") or {}).get("tag_pattern") or r"^v\d+\.\d+\.\d+$"}


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (sha, ...) that a content-addressed cache (sha, ...) lacks."""
    return files.join(cache.select("sha").distinct(), "sha", "left_anti")


def replaced_between(text: str, table: str, begin: str, end: str, volatile: str | None = None) -> str | None:
    """text with a table between two marks; None if nothing but what `volatile` matches would change."""
    import re

    a, b = text.index(begin) + len(begin), text.index(end)
    new = f"{text[:a]}\n{table}\n{text[b:]}"
    plain = (lambda s: re.sub(volatile, "", s)) if volatile else (lambda s: s)
    return None if plain(new) == plain(text) else new


def freshest(landed: DataFrame, now, hours: int = 24) -> DataFrame:
    """Of each source's copies (source, fetched, body) the newest, with stale: whether it is older than so many hours, and so stands in for one that couldn't be fetched."""
    newest = landed.groupBy("source").agg(F.max_by(F.struct("fetched", "body"), F.struct("fetched", "body")).alias("n"))
    age = F.unix_timestamp(now) - F.unix_timestamp("n.fetched")
    return newest.select("source", "n.fetched", "n.body", (age > hours * 3600).alias("stale"))
