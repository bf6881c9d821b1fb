"""A data source for trees of landed JSON files: <root>/<round>/<entrant>.json, and <root>/<round>/failures/<entrant>.json.

    register(spark)
    spark.read.format("augur_tree").load(root).where("round_id = 'r1'")
    spark.readStream.format("augur_tree").load(root)
    rows.write.format("augur_tree").mode("append").save(root)

A read is planned in partitions of FILES_A_TASK files; filters on round_id, entrant and failed reach the source, so a folder
that no filter wants is never listed, nor is a file that none wants opened. A write is once only: a file that is there with other bytes fails the
job, the same bytes are left as they are, and each file appears whole (a name of its own first, then moved). The root is a path or URI of
any file system that Arrow knows (file, hdfs, s3, gs) and that driver and executors share.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

FORMAT, FAILURES, FILES_A_TASK = "augur_tree", "failures", 200
SCHEMA = "round_id string, entrant string, failed boolean, path string, modified timestamp, body string"
ARROW = pa.schema([("round_id", pa.string()), ("entrant", pa.string()), ("failed", pa.bool_()), ("path", pa.string()), ("modified", pa.timestamp("us", tz="UTC")), ("body", pa.string())])


def register(spark: SparkSession) -> None:
    """The format for a session, with filters handed to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)


def opened(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a root and the path in it."""
    if ":/" not in root:
        return arrow_fs.LocalFileSystem(), root.rstrip("/")
    scheme, rest = root.split(":", 1)
    found, path = arrow_fs.FileSystem.from_uri(root if rest.startswith("//") else f"{scheme}://{rest}")
    return found, path.rstrip("/")


def listed(found: arrow_fs.FileSystem, folder: str) -> list[arrow_fs.FileInfo]:
    return sorted(found.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path)


@dataclass(frozen=True)
class Leaf:
    """One file of a tree."""

    round_id: str
    entrant: str
    failed: bool
    path: str
    modified: int


def leaves(root: str, rounds: set[str] | None = None, entrants: set[str] | None = None, failed: set[bool] | None = None) -> Iterator[Leaf]:
    """The files of a tree in order of their paths; of wanted rounds only the folders are listed that are wanted."""
    found, top = opened(root)
    folders = [i.path for i in listed(found, top) if i.type == arrow_fs.FileType.Directory] if rounds is None else [posixpath.join(top, r) for r in sorted(rounds) if r and "/" not in r]
    for folder in folders:
        for bad, place in ((False, folder), (True, posixpath.join(folder, FAILURES))):
            if failed is not None and bad not in failed:
                continue
            for i in listed(found, place):
                name = posixpath.basename(i.path)
                if i.type == arrow_fs.FileType.File and name.endswith(".json") and not name.startswith((".", "_")) and (entrants is None or name.split(".")[0] in entrants):
                    yield Leaf(posixpath.basename(folder), name.split(".")[0], bad, i.path, i.mtime_ns // 1000)


class Chunk(InputPartition):
    def __init__(self, files: list[Leaf]) -> None:
        super().__init__(len(files))
        self.files = files


def chunks(files: Iterable[Leaf]) -> list[Chunk]:
    every = list(files)
    return [Chunk(every[i : i + FILES_A_TASK]) for i in range(0, len(every), FILES_A_TASK)]


def contents(root: str, part: Chunk) -> Iterator[pa.RecordBatch]:
    """The files of a partition, a batch for each few megabytes. A file that has gone since the plan was made is no row."""
    found, _ = opened(root)
    rows, size = [], 0
    for leaf in part.files:
        try:
            with found.open_input_stream(leaf.path) as stream:
                body = stream.read().decode("utf-8", "replace")
        except FileNotFoundError:
            continue
        rows.append((leaf.round_id, leaf.entrant, leaf.failed, leaf.path, leaf.modified, body))
        size += len(body)
        if size > 4_000_000:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class TreeReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root, self.wanted = root, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("round_id",), ("entrant",), ("failed",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return chunks(leaves(self.root, self.wanted.get("round_id"), self.wanted.get("entrant"), self.wanted.get("failed"))) or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        return contents(self.root, partition)


class TreeStream(DataSourceStreamReader):
    """New files in order of their times, then paths. A file that lands with an older time than one that was read is not seen: files are written once, when they are made."""

    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:  # noqa: N802
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        modified, path = max(((leaf.modified, leaf.path) for leaf in leaves(self.root)), default=(-1, ""))
        return {"modified": modified, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((o["modified"], o["path"]) for o in (start, end))
        return chunks(leaf for leaf in leaves(self.root) if low < (leaf.modified, leaf.path) <= high) or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        return contents(self.root, partition)


@dataclass
class Written(WriterCommitMessage):
    files: int


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator: Iterator[Row]) -> Written:
        found, top = opened(self.root)
        n = 0
        for row in iterator:
            named = row.asDict()
            if any(not named[c] or "/" in named[c] for c in ("round_id", "entrant")):
                raise ValueError(f"no file name in {named['round_id']!r}, {named['entrant']!r}")
            folder = posixpath.join(top, named["round_id"], *([FAILURES] if named.get("failed") else []))
            path, body = posixpath.join(folder, f"{named['entrant']}.json"), named["body"].encode()
            if found.get_file_info(path).type == arrow_fs.FileType.File:
                with found.open_input_stream(path) as stream:
                    if stream.read() != body:
                        raise ValueError(f"{path} is there with other bytes: files are written once")
                continue
            found.create_dir(folder, recursive=True)
            own = posixpath.join(folder, f".{uuid.uuid4().hex}")
            with found.open_output_stream(own) as stream:
                stream.write(body)
            found.move(own, path)
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        """Every file is whole already."""

    def abort(self, messages: list[Written | None]) -> None:
        """Files that were written stay: a second run finds the same bytes."""


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(self.options["path"])

    def streamReader(self, schema: object) -> TreeStream:  # noqa: N802
        return TreeStream(self.options["path"])

    def writer(self, schema: object, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("a tree is only added to")
        return TreeWriter(self.options["path"])
