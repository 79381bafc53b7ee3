"""File corpora: a directory tree, or any DataFrame that already holds the texts."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.constants import SCANNED_EXTENSIONS, SKIPPED_DIRECTORIES
from tallyguard.functions.ddl import engine_type
from tallyguard.sources.listing import MOST_BYTES, list_files, read_contents

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?(?=/)"


def has_scanned_extension(path: Column, extensions: list[str] = SCANNED_EXTENSIONS) -> Column:
    """Extension test, ignoring case; a bare ``.sql`` is a name without an extension."""
    return F.lower(path).rlike(rf"[^/]\.(?:{'|'.join(extensions)})\z")


def in_skipped_directory(
    relative_path: Column, directories: list[str] = SKIPPED_DIRECTORIES
) -> Column:
    """True when a directory of the path (not the file name) is one of the skipped ones."""
    parts = F.split(relative_path, "/", -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(d) for d in directories]))


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def with_engine(files: DataFrame) -> DataFrame:
    """(relative_path, content [, path, ...]) -> the files frame of the engine.

    Adds ``path`` when missing, ``engine_type``, and renames the text to ``raw_content``. Other
    columns, such as a database name, are kept.
    """
    if "path" not in files.columns:
        files = files.withColumn("path", F.col("relative_path"))
    return files.withColumnRenamed("content", "raw_content").withColumn(
        "engine_type", engine_type(F.col("relative_path"), F.col("raw_content"))
    )


def from_bytes(files: DataFrame) -> DataFrame:
    """(relative_path, content binary, ...) -> files whose path is in scope and text is UTF-8.

    Path tests come first and need no content; files that are not valid UTF-8 are left out.
    """
    text = F.col("content").cast("string")
    return (
        files.filter(in_scope(F.col("relative_path")))
        .filter(F.is_valid_utf8(text))
        .withColumn("content", normalise_newlines(text))
    )


def relative_to(path: Column, root: str) -> Column:
    """``path`` below ``root``; both may carry a file system scheme. A root that is itself the
    file gives the file name."""
    base = re.sub(_SCHEME, "", root)
    if base == root and not root.startswith("/"):
        base = os.path.abspath(root)
    base = base.rstrip("/")
    plain = F.regexp_replace(path, _SCHEME, "")
    below = F.substring(plain, F.lit(len(base) + 2), F.length(plain))
    return F.when(plain == base, F.element_at(F.split(plain, "/"), -1)).otherwise(below)


def in_scope(relative_path: Column) -> Column:
    return has_scanned_extension(relative_path) & ~in_skipped_directory(relative_path)


def scan_directory(spark: SparkSession, root: str, listing: str = "complete") -> DataFrame:
    """All schema, migration and configuration files below ``root``.

    The complete listing has every name and needs a path that ``pyarrow.fs`` can open. The other one,
    ``"spark"``, reads any store that Spark reads, but leaves out empty files and names that begin with
    ``_`` or ``.``,
    and it fails on files above 2 GB. What is in scope but cannot be read whole is in
    :func:`rejected_files`; :func:`tallyguard.sources.ranges.scan_lines` reads files of any size.
    """
    if listing == "spark":
        listed = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(root)
            .select(
                F.regexp_replace("path", r"^file:(?://)?(?=/)", "").alias("path"),
                relative_to(F.col("path"), root).alias("relative_path"),
                "content",
            )
        )
        return with_engine(from_bytes(listed))
    read = _contents(spark, root, MOST_BYTES)
    return with_engine(from_bytes(read.filter(F.col("problem").isNull()).drop("problem")))


def rejected_files(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(relative_path, reason) of the files in scope that :func:`scan_directory` does not give."""
    read = _contents(spark, root, most_bytes)
    invalid = F.when(~F.is_valid_utf8(F.col("content").cast("string")), F.lit("not valid UTF-8"))
    return read.select("relative_path", F.coalesce("problem", invalid).alias("reason")).filter(
        F.col("reason").isNotNull()
    )


def _contents(spark: SparkSession, root: str, most_bytes: int) -> DataFrame:
    listed = list_files(spark, root)
    wanted = F.col("problem").isNotNull() | in_scope(F.col("relative_path"))
    return read_contents(listed.filter(wanted), root, most_bytes)
