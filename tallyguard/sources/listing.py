"""A complete listing of a directory tree, and reading the files that it found.

Spark's own listing leaves out names that begin with ``_`` or ``.`` and reads no file above 2 GB as one
row. This source lists every name: the driver opens directories until there are enough of them, each
of these is a partition, and tasks walk down from there. Directories that are never audited are not
entered. Listing and reading are separate steps, so a file out of scope is never opened.

Paths are those that ``pyarrow.fs`` can open from driver and executors alike: shared folders and object
stores. For others, Spark's listing remains (``scan_directory(..., listing="spark")``).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyguard.constants import SKIPPED_DIRECTORIES

LISTED = "path string, relative_path string, length long, problem string"
READ = "path string, relative_path string, content binary, problem string"
# Spark holds a row below 2 GB; the content of larger files is read by ranges.
MOST_BYTES = 1 << 30
PARTITIONS = 64
_BATCH_BYTES = 32 << 20
_LOCAL = re.compile(r"^file:(?://)?(?=/)")


def opened_system(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    plain = _LOCAL.sub("", root)
    if "://" in plain:
        return arrow_fs.FileSystem.from_uri(plain)
    return arrow_fs.LocalFileSystem(), os.path.abspath(plain)


def _children(system: arrow_fs.FileSystem, folder: str) -> list[arrow_fs.FileInfo]:
    found = system.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
    return sorted(found, key=lambda info: info.path)


def _is_link(system: arrow_fs.FileSystem, path: str) -> bool:
    """Linked directories are not entered, so that a walk ends."""
    return isinstance(system, arrow_fs.LocalFileSystem) and os.path.islink(path)


@dataclass
class _Folder(InputPartition):
    """A directory to list, alone or with all that is below it; or a single file."""

    path: str
    below: bool

    def __init__(self, path: str, below: bool):
        self.path, self.below = path, below


class _Listing(DataSourceReader):
    def __init__(self, root: str, skipped: Sequence[str], partitions: int):
        self.system, self.root = opened_system(root)
        self.root = self.root.rstrip("/") or "/"
        self.skipped, self.wanted = frozenset(skipped), partitions

    def _enters(self, info: arrow_fs.FileInfo) -> bool:
        return (
            info.type == arrow_fs.FileType.Directory
            and info.base_name not in self.skipped
            and not _is_link(self.system, info.path)
        )

    def partitions(self) -> Sequence[InputPartition]:
        if self.system.get_file_info(self.root).type == arrow_fs.FileType.File:
            return [_Folder(self.root, False)]
        opened, waiting = [], [self.root]
        while waiting and len(waiting) < self.wanted:
            level, waiting = waiting, []
            for folder in level:
                opened.append(_Folder(folder, False))
                waiting += [i.path for i in _children(self.system, folder) if self._enters(i)]
        return opened + [_Folder(folder, True) for folder in waiting]

    def _row(self, info: arrow_fs.FileInfo) -> tuple:
        below = info.path[len(self.root) :].lstrip("/") or info.base_name
        return info.path, below, info.size, None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        info = self.system.get_file_info(partition.path)
        if info.type == arrow_fs.FileType.File:
            yield self._row(info)
            return
        folders = [partition.path]
        while folders:
            folder = folders.pop()
            try:
                found = _children(self.system, folder)
            except OSError as error:
                below = folder[len(self.root) :].lstrip("/")
                yield folder, below, None, f"unreadable directory: {type(error).__name__}"
                continue
            yield from (self._row(i) for i in found if i.type == arrow_fs.FileType.File)
            if partition.below:
                folders += [i.path for i in found if self._enters(i)]


class FileListing(DataSource):
    """``spark.read.format("file_listing").load(root)``: one row per file, hidden names included."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        skipped = self.options.get("skipped")
        names = SKIPPED_DIRECTORIES if skipped is None else [n for n in skipped.split("/") if n]
        return _Listing(self.options["path"], names, int(self.options.get("partitions", PARTITIONS)))


def list_files(
    spark: SparkSession,
    root: str,
    skipped: Sequence[str] = SKIPPED_DIRECTORIES,
    partitions: int = PARTITIONS,
) -> DataFrame:
    """(path, relative_path, length, problem) of every file below ``root``, or of ``root`` itself.

    A directory that cannot be opened gives a row with its problem and no length. A root that does not
    exist or is empty gives no rows.
    """
    spark.dataSource.register(FileListing)
    # a directory's name has no slash, so slashes stand between the names
    return (
        spark.read.format("file_listing")
        .option("skipped", "/".join(skipped))
        .option("partitions", str(partitions))
        .load(root)
    )


def read_contents(listed: DataFrame, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, relative_path, content, problem) of listed files; what cannot be read has no content.

    The files are dealt anew, since a directory may hold any number of them.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened_system(root)
        rows, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                content, problem = None, row["problem"]
                if problem is None and row["length"] > most_bytes:
                    problem = f"larger than {most_bytes} bytes"
                elif problem is None:
                    try:
                        with system.open_input_stream(row["path"]) as stream:
                            content = stream.read()
                    except OSError as error:
                        problem = f"unreadable file: {type(error).__name__}"
                rows.append((row["path"], row["relative_path"], content, problem))
                size += len(content or b"")
                if size > _BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    return listed.repartition("path").mapInArrow(read, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, below, content, problem = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(path), pa.array(below), pa.array(content, pa.binary()), pa.array(problem, pa.string())],
        names=["path", "relative_path", "content", "problem"],
    )
