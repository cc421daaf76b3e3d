"""Folders of text files as a source and a sink: many small files, each a row (path, text)."""

from __future__ import annotations

import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from glosswork.functions import text as T


def worktree(spark: SparkSession, folder: str, include: list[str], exclude: list[str] = (), bad_bytes: str = "skip", generated: list[str] = (), parts: int = 4) -> DataFrame:
    """path, text of the files under a folder that are in scope. bad_bytes: skip files that aren't UTF-8, or replace what isn't.

    Executors list the folders, each dealt out `parts` times, and open only files in scope; filters on path are pushed to the listing.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TextFiles)
    told = {"include": list(include), "exclude": list(exclude), "generated": list(generated)}
    return spark.read.format("glosswork_files").option("path", folder).option("scope", json.dumps(told)).option("bad_bytes", bad_bytes).option("parts", parts).load()


def worktree_by_spark(spark: SparkSession, folder: str, include: list[str], exclude: list[str] = (), bad_bytes: str = "skip", generated: list[str] = ()) -> DataFrame:
    """worktree() for stores that only Spark's own readers reach. These list all files on the driver, apply the scope to that listing, and leave empty files out."""
    top = re.sub("^[a-z0-9]+:/*", "/", folder).rstrip("/") + "/"

    def relative(path: Column) -> Column:
        return F.replace(F.regexp_replace(path, "^[a-z0-9]+:/*", "/"), F.lit(top), F.lit(""))

    listed = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # there names are encoded as in addresses
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(T.in_scope(relative(listed), list(include), list(exclude), list(generated)))
    rows = rows.select(relative(F.col("path")).alias("path"), "content")
    if bad_bytes == "skip":
        rows = rows.where(F.is_valid_utf8("content"))
    return rows.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


@dataclass
class Folder(InputPartition):
    """A share of a folder's files; of all below it, if deep."""

    path: str
    deep: bool
    share: int


def taken(path: str, globs: list[str]) -> bool:
    """functions.text.matches_globs for one path: later globs win and ! takes back."""
    out = False
    for glob in globs:
        if re.search(T.glob_pattern(glob.removeprefix("!")), path):
            out = not glob.startswith("!")
    return out


class _Reader(DataSourceReader):
    """Folders down to `DEPTH` are listed on the driver, for the partitions; files by the tasks."""

    DEPTH, BATCH = 2, 8 << 20

    def __init__(self, options: dict):
        self.root, self.scope = options["path"], json.loads(options.get("scope", "{}"))
        self.skip, self.parts = options.get("bad_bytes", "skip") == "skip", int(options.get("parts", 1))
        self.tests: list[tuple[str, str | tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("path",):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append(("is", f.value))
            elif isinstance(f, In):
                self.tests.append(("in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append(("begins", f.value))
            elif not isinstance(f, IsNotNull):
                yield f

    def wanted(self, path: str) -> bool:
        for kind, value in self.tests:
            if not (path == value if kind == "is" else path in value if kind == "in" else path.startswith(value)):
                return False
        include = self.scope.get("include")
        return (not include or taken(path, include)) and not taken(path, self.scope.get("exclude", [])) and not taken(path, self.scope.get("generated", []))

    def leads(self, folder: str) -> bool:
        """Whether wanted files may lie below a folder."""
        way = f"{folder}/" if folder else ""
        goal = lambda v: v.startswith(way) or way.startswith(v)
        return all(value.startswith(way) if kind == "is" else any(v.startswith(way) for v in value) if kind == "in" else goal(value) for kind, value in self.tests)

    def _entries(self, folder: str, deep: bool):
        from pyarrow import fs

        system, root = _file_system(self.root)
        root = root.rstrip("/")
        for info in system.get_file_info(fs.FileSelector(posixpath.join(root, folder), recursive=deep, allow_not_found=True)):
            yield info.path[len(root) :].lstrip("/"), info

    def partitions(self) -> list[Folder]:
        out, level = [], [""]
        for depth in range(self.DEPTH + 1):
            deep = depth == self.DEPTH
            out += [Folder(f, deep, k) for f in level for k in range(self.parts)]
            if not deep:
                level = [path for f in level for path, info in self._entries(f, False) if info.type.name == "Directory" and self.leads(path)]
        return out

    def read(self, partition: Folder) -> Iterator:
        import pyarrow as pa

        system, _ = _file_system(self.root)
        paths, texts, size = [], [], 0
        for path, info in self._entries(partition.path, partition.deep):
            if not info.is_file or zlib.crc32(path.encode()) % self.parts != partition.share or not self.wanted(path):
                continue
            with system.open_input_stream(info.path) as file:
                content = file.read()
            try:
                text = content.decode()
            except UnicodeDecodeError:
                if self.skip:
                    continue
                text = content.decode(errors="replace")
            paths.append(path)
            texts.append(text)
            size += len(content)
            if size > self.BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])
                paths, texts, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])


@dataclass
class Written(WriterCommitMessage):
    files: int


def _file_system(address: str):
    """The file system of an address, and the path in it."""
    from pyarrow import fs

    if urlsplit(address).scheme:
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), address


class _Writer(DataSourceArrowWriter):
    """Each file is written beside its place under another name and then put there, so a reader sees the old text or the new one, and a task that is tried again writes the same once more."""

    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def write(self, iterator: Iterator) -> Written:
        system, root = _file_system(self.root)
        n, known = 0, set()
        for batch in iterator:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                clean = posixpath.normpath(path)
                if clean.startswith(("/", "../")) or clean in ("..", "."):
                    raise ValueError(f"a path that leads out of the folder: {path}")
                place = posixpath.join(root, clean)
                folder = posixpath.dirname(place)
                if folder not in known:
                    system.create_dir(folder, recursive=True)
                    known.add(folder)
                new = posixpath.join(folder, f".{posixpath.basename(place)}.{uuid.uuid4().hex}.new")
                try:
                    with system.open_output_stream(new) as out:
                        out.write((text or "").encode())
                    system.move(new, place)
                except BaseException:
                    if system.get_file_info(new).is_file:
                        system.delete_file(new)
                    raise
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        """A mark of how many files the run wrote, only when all are there."""
        system, root = _file_system(self.root)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(posixpath.join(root, "_WRITTEN")) as out:
            out.write(f"{self.run} {sum(m.files for m in messages if m)}\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        """No mark: files that were put in place stay, whole, and the next run writes them again."""
        system, root = _file_system(self.root)
        mark = posixpath.join(root, "_WRITTEN")
        if system.get_file_info(mark).is_file:
            system.delete_file(mark)


class TextFiles(DataSource):
    """Rows (path, text) of the files under the option `path`, as a source and as a sink."""

    @classmethod
    def name(cls) -> str:
        return "glosswork_files"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], uuid.uuid4().hex)


def write_files(files: DataFrame, folder: str) -> None:
    """Write files (path, text; each path once) under a folder that all executors reach, as themselves; what else is there stays."""
    spark = files.sparkSession
    spark.dataSource.register(TextFiles)
    files.select("path", "text").write.format("glosswork_files").option("path", folder).mode("append").save()
