"""Source trees as a Spark data source: ``spark.read.format("source_tree")`` and ``df.write.format("source_tree")``.

Below the path of the source stands a folder for each project. A scan is planned from directory listings: the folders are
opened level by level until there are as many pieces as partitions are wanted, a large folder is split by
its files, and what an ignore rule matches is neither opened nor listed any further. Tasks then walk their
pieces. The path may be any URI that ``pyarrow.fs`` opens, in a store that the driver and all executors reach.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from knotmeter.functions.paths import globs_regex

TREE_SCHEMA = (
    "project_id string, path string, size bigint, created timestamp, modified timestamp, "
    "accessed timestamp, content string"
)
TEXT_EXTENSIONS = {
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rb", ".php", ".r", ".ipynb",
    ".sql", ".sh", ".scala", ".json", ".txt", ".md", ".yml", ".yaml", ".xml", ".toml",
    ".mod", ".cfg", ".ini", ".html", ".gradle",
}
#: Bytes of contents in a batch, and files of one folder that a piece has at most.
_BATCH_BYTES, _PIECE_FILES = 32 << 20, 10_000

_UTC = pa.timestamp("us", tz="UTC")
_ARROW = pa.schema([
    ("project_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("created", _UTC), ("modified", _UTC),
    ("accessed", _UTC), ("content", pa.string()),
])


def is_text(name: str) -> bool:
    ext = os.path.splitext(name)[1].lower()
    return ext in TEXT_EXTENSIONS or ext == ""


def decode(data: bytes) -> str:
    """UTF-8 without the undecodable bytes, newlines as '\\n'."""
    return data.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, which Hadoop may write with one slash, and the path in it."""
    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri.removeprefix("file:"))
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def _children(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder and whether they are folders, in order.

    Links that lead to no file are left out: those to folders may run in circles, others are broken.
    """
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            found = [(e.name, e.is_dir(follow_symlinks=False)) for e in entries if e.is_file() or not e.is_symlink()]
    else:
        found = [(i.base_name, i.type == fs.FileType.Directory) for i in system.get_file_info(fs.FileSelector(folder))]
    return iter(sorted(found))


def _stamps(system: fs.FileSystem, full: str) -> tuple[int, list[datetime | None]]:
    """Size, and times of creation, change and access as far as the store has them."""
    if isinstance(system, fs.LocalFileSystem):
        stat = os.stat(full)
        return stat.st_size, [datetime.fromtimestamp(t, tz=timezone.utc) for t in (stat.st_ctime, stat.st_mtime, stat.st_atime)]
    info = system.get_file_info(full)
    return info.size, [None, info.mtime, None]


@dataclass
class Piece(InputPartition):
    """What a task reads: for each folder the project, the path in it, whether to go below, and which of its files."""

    folders: list[tuple[str, str, bool, int, int]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.wanted = int(options.get("partitions", "32"))
        self.contents = options.get("contents", "true").lower() == "true"
        globs = json.loads(options.get("ignore", "[]"))
        self.ignored = re.compile(globs_regex(globs) + r"\Z") if globs else None

    def _kept(self, system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
        return ((name, is_dir) for name, is_dir in _children(system, folder) if not (self.ignored and self.ignored.match(name)))

    def partitions(self) -> list[Piece]:
        system, root = _opened(self.root)
        waiting = deque((name, "") for name, is_dir in _children(system, root) if is_dir)
        pieces: list[tuple[str, str, bool, int, int]] = []
        while waiting and len(waiting) + len(pieces) < self.wanted:
            project, folder = waiting.popleft()
            files = 0
            for name, is_dir in self._kept(system, "/".join(filter(None, (root, project, folder)))):
                if is_dir:
                    waiting.append((project, f"{folder}/{name}".lstrip("/")))
                else:
                    files += 1
            parts = -(-files // _PIECE_FILES)
            pieces += [(project, folder, False, i, parts) for i in range(parts)]
        pieces += [(project, folder, True, 0, 1) for project, folder in waiting]
        n = max(1, min(self.wanted, len(pieces)))
        return [Piece(pieces[i::n]) for i in range(n)]

    def _files(self, system: fs.FileSystem, root: str, piece: Piece) -> Iterator[tuple[str, str]]:
        for project, start, below, part, parts in piece.folders:
            open_ = [start]
            while open_:
                folder = open_.pop()
                at = 0
                for name, is_dir in self._kept(system, "/".join(filter(None, (root, project, folder)))):
                    path = f"{folder}/{name}".lstrip("/")
                    if is_dir:
                        if below:
                            open_.append(path)
                    else:
                        if at % parts == part:
                            yield project, path
                        at += 1

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, root = _opened(self.root)
        rows, held = [], 0
        for project, path in self._files(system, root, partition):
            full = f"{root}/{project}/{path}"
            size, times = _stamps(system, full)
            content = None
            if self.contents and is_text(path.rpartition("/")[2]):
                with system.open_input_stream(full) as f:
                    content = decode(f.read())
                held += size
            rows.append((project, path, size, *times, content))
            if held > _BATCH_BYTES or len(rows) == _PIECE_FILES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types, strict=True)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: int


class TreeWriter(DataSourceArrowWriter):
    """Rows (project_id, path, content) as files. A file appears by rename, so a task that runs again does no harm."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.parts = f"{self.root.rstrip('/')}.parts-{uuid4().hex}"

    def write(self, iterator: Iterable[pa.RecordBatch]) -> Written:
        system, root = _opened(self.root)
        _, parts = _opened(self.parts)
        system.create_dir(parts, recursive=True)
        made: set[str] = set()
        count = 0
        for batch in iterator:
            for project, path, content in zip(*(batch.column(c).to_pylist() for c in ("project_id", "path", "content")), strict=True):
                if not project or not path or "/" in project or {"", ".", ".."} & {project, *path.split("/")}:
                    raise ValueError(f"not a place below the tree: {project!r}, {path!r}")
                target = f"{root}/{project}/{path}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{parts}/{uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write((content or "").encode())
                system.move(part, target)
                count += 1
        return Written(count)

    def _clean(self) -> None:
        system, parts = _opened(self.parts)
        if system.get_file_info(parts).type == fs.FileType.Directory:
            system.delete_dir(parts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _opened(self.root)
        system.create_dir(root, recursive=True)
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()


class TreeSource(DataSource):
    """Options: ``path``; for reads also ``ignore`` (a JSON list of globs over names), ``contents`` and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return TREE_SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("a tree is added to, not replaced: use mode('append')")
        return TreeWriter(self.options)


def scan_files(spark: SparkSession, root: str, ignore: Iterable[str] = (), contents: bool = True, partitions: int | None = None) -> DataFrame:
    """All files of the projects below ``root``, hidden and underscored names too (``binaryFile`` skips these).

    What ``ignore`` matches, files and whole folders, is left out when the scan is planned or walked, at no cost for what lies
    below. Texts have their content, other files a null; no projects, no rows.
    """
    spark.dataSource.register(TreeSource)
    n = partitions or 4 * spark.sparkContext.defaultParallelism
    options = {"ignore": json.dumps(list(ignore)), "contents": str(contents).lower(), "partitions": str(n)}
    return spark.read.format("source_tree").options(**options).load(root)


def write_files(files: DataFrame, root: str) -> None:
    """Write (project_id, path, content) as a tree that ``scan_files`` reads; a null content is an empty file."""
    files.sparkSession.dataSource.register(TreeSource)
    files.select("project_id", "path", "content").write.format("source_tree").mode("append").save(root)
