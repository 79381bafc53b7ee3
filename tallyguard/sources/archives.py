"""Archive corpora: every member of a .zip, .tar.gz or .tgz becomes a file row."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from typing import IO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.constants import MAX_ARCHIVE_BYTES
from tallyguard.sources.files import from_bytes

TOO_LARGE = "archive exceeds the size limit"
TOO_LARGE_UNPACKED = "archive exceeds the size limit when unpacked"
MAX_UNPACKED_BYTES = 4 * MAX_ARCHIVE_BYTES
UNSUPPORTED = "unsupported archive format"


def _escapes(member: str) -> bool:
    """True when the member would land outside the directory it is unpacked into."""
    if member.startswith("/"):
        return True
    depth = 0
    for part in member.split("/"):
        if part == "..":
            depth -= 1
        elif part not in ("", "."):
            depth += 1
        if depth < 0:
            return True
    return False


def _zip_members(data: bytes) -> Iterator[tuple[str, str, Callable[[], IO[bytes] | None]]]:
    """(name, path it is unpacked to, opener) of every file; unpacking leaves out dots."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    for info in archive.infolist():
        parts = [p for p in info.filename.split("/") if p not in ("", ".", "..")]
        if info.is_dir():
            yield info.filename, "", lambda: None
        else:
            yield info.filename, "/".join(parts), lambda info=info: archive.open(info)


def _tar_members(data: bytes) -> Iterator[tuple[str, str, Callable[[], IO[bytes] | None]]]:
    """The same for a tar, whose unpacking resolves dots. Links stand for the member they name."""
    archive = tarfile.open(fileobj=io.BytesIO(data), mode="r:*")
    for info in archive.getmembers():
        is_text = info.isfile() or info.islnk()
        path = posixpath.normpath(info.name) if is_text else ""
        yield info.name, path, lambda info=info: archive.extractfile(info)


_CHUNK = 1 << 20


def _checked(name: str, data: bytes, max_unpacked: int) -> tuple[dict[str, Callable], str | None]:
    """The openers of the last member of every path, and what is wrong with the archive.

    Every member is read to its end, a chunk at a time, so damage anywhere, a password or a missing
    link refuses the archive as a whole, before any of its texts is passed on.
    """
    openers: dict[str, Callable] = {}
    try:
        members = list((_zip_members if name.lower().endswith(".zip") else _tar_members)(data))
        unsafe = next((member for member, *_ in members if _escapes(member)), None)
        if unsafe is not None:
            return {}, f"unsafe member: {unsafe}"
        unpacked = 0
        for _, path, opener in members:
            if not path:
                continue
            openers[path] = opener
            with opener() as stream:
                while chunk := stream.read(_CHUNK):
                    unpacked += len(chunk)
                    if unpacked > max_unpacked:
                        return {}, TOO_LARGE_UNPACKED
    except Exception as error:  # any damage means the whole archive is refused
        return {}, f"unreadable archive: {type(error).__name__}"
    return openers, None


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """(archive, length, content) of the files at ``root``; content is read only where used."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(F.col("path").alias("archive"), "length", "content")
    )


def opened_archives(
    archives: DataFrame,
    max_bytes: int = MAX_ARCHIVE_BYTES,
    max_unpacked: int = MAX_UNPACKED_BYTES,
) -> DataFrame:
    """(archive, relative_path, content, reason): the members of every archive, in one pass.

    A refused archive gives a single row, with the reason; an accepted one a row per member, where
    the last of several members with one path counts. One archive is one unit of work. Its files
    may have ``max_bytes`` packed and ``max_unpacked`` unpacked; members are held one at a time.
    """

    def open_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data, reason in zip(
                batch["archive"], batch["content"], batch["reason"], strict=True
            ):
                openers = {}
                if reason is None:
                    openers, reason = _checked(name, data, max_unpacked)
                if reason is not None:
                    yield pd.DataFrame(
                        {"archive": [name], "relative_path": [None], "content": [None], "reason": [reason]}
                    )
                for path, opener in openers.items():
                    with opener() as stream:
                        content = stream.read()
                    yield pd.DataFrame(
                        {"archive": [name], "relative_path": [path], "content": [content], "reason": [None]}
                    )

    known = F.lower("archive").rlike(r"\.(?:zip|tar\.gz|tgz)\z")
    reason = F.when(F.col("length") > max_bytes, F.lit(TOO_LARGE)).when(~known, F.lit(UNSUPPORTED))
    # the content of a refused archive is not read
    listed = archives.select(
        "archive", F.when(reason.isNull(), F.col("content")).alias("content"), reason.alias("reason")
    )
    return listed.mapInPandas(
        open_all, "archive string, relative_path string, content binary, reason string"
    )


def archive_members(
    archives: DataFrame,
    max_bytes: int = MAX_ARCHIVE_BYTES,
    max_unpacked: int = MAX_UNPACKED_BYTES,
) -> DataFrame:
    """(archive, relative_path, content text) of all members in scope of accepted archives.

    The scope and UTF-8 tests are those of a directory scan.
    """
    opened = opened_archives(archives, max_bytes, max_unpacked)
    return from_bytes(opened.filter("reason IS NULL").drop("reason"))


def rejected_archives(
    archives: DataFrame,
    max_bytes: int = MAX_ARCHIVE_BYTES,
    max_unpacked: int = MAX_UNPACKED_BYTES,
) -> DataFrame:
    """(archive, reason) of the archives that are refused as a whole."""
    opened = opened_archives(archives, max_bytes, max_unpacked)
    return opened.filter("reason IS NOT NULL").select("archive", "reason")
