"""Lines of files of any size, read by byte ranges.

A file is cut into ranges of bytes. A range owns the lines that begin in it: it skips what is left of the
line before and reads on behind its end until its last line is complete, so the borders fall anywhere and
no line is lost or cut. Lines are counted per range first; sums over the ranges before give every range
the number of its first line, and the second reading gives the lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyguard.operators.materialise import materialise
from tallyguard.sources.files import in_scope
from tallyguard.sources.listing import list_files, opened_system

RANGE_BYTES = 64 << 20
_BLOCK = 1 << 20
_LINES_PER_BATCH = 10_000
_BREAK = re.compile(rb"\r\n|\n|\r")
INVALID = "not valid UTF-8"


def owned_bytes(stream, start: int, end: int, length: int) -> bytes:
    """The lines that begin in the range from ``start`` to ``end`` of a file of ``length`` bytes."""
    before = max(start - 1, 0)
    stream.seek(before)
    # a byte more at both ends tells whether a carriage return and a line feed belong together
    data = stream.read(min(end + 1, length) - before)
    first = 0
    if start:
        found = _BREAK.search(data)
        if found is None or before + found.end() >= end:
            return b""
        first = found.end()
    at = end - 1 - before
    while True:
        found = _BREAK.search(data, at)
        whole = before + len(data) >= length
        # a carriage return that ends what was read may go on with a line feed
        if found and (whole or found.end() < len(data) or found.group().endswith(b"\n")):
            return data[first : found.end()]
        if whole:
            return data[first:]
        at = found.start() if found else len(data)
        data += stream.read(_BLOCK)


def _lines(owned: bytes) -> list[str]:
    """As ``functions.text.lines`` gives them for the text of the whole file."""
    return owned.decode("utf-8").splitlines()


def file_ranges(listed: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, relative_path, length, start): the ranges of listed files. An empty file has one."""
    last = F.greatest(F.col("length") - 1, F.lit(0))
    starts = F.sequence(F.lit(0).cast("long"), last, F.lit(range_bytes).cast("long"))
    return listed.select("path", "relative_path", "length", F.explode(starts).alias("start"))


def _numbered_ranges(ranges: DataFrame, root: str, range_bytes: int) -> DataFrame:
    """Adds ``lines``, ``first_line`` (from 1) and ``invalid``, whether any range of the file is not UTF-8."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened_system(root)
        for batch in batches:
            lines, invalid = [], []
            for row in batch.to_pylist():
                end = min(row["start"] + range_bytes, row["length"])
                with system.open_input_file(row["path"]) as stream:
                    owned = owned_bytes(stream, row["start"], end, row["length"])
                try:
                    lines.append(len(_lines(owned)))
                    invalid.append(False)
                except UnicodeDecodeError:
                    lines.append(0)
                    invalid.append(True)
            columns = [*batch.columns, pa.array(lines, pa.int64()), pa.array(invalid, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lines", "bad"])

    kind = "path string, relative_path string, length long, start long, lines long, bad boolean"
    counted = materialise(ranges.repartition("path", "start").mapInArrow(count, kind))
    # a row per range, so a window over a file is as long as the file has ranges
    of_file = Window.partitionBy("path")
    earlier = of_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumns(
        {
            "first_line": F.coalesce(F.sum("lines").over(earlier), F.lit(0)) + 1,
            "invalid": F.max("bad").over(of_file),
        }
    ).drop("bad")


def lines_of_files(
    listed: DataFrame, root: str, range_bytes: int = RANGE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(relative_path, line_number, line) of listed files, and (relative_path, problem) of those left out.

    The lines are those of the whole text, whatever the range: terminators of all kinds, and texts
    that are not UTF-8 are left out as files. Every file is read twice, a range per row; a task holds
    one range and its last line. An empty file has no lines.
    """
    problem = F.col("problem").isNotNull()
    ranges = file_ranges(listed.filter(~problem), range_bytes)
    numbered = materialise(_numbered_ranges(ranges, root, range_bytes))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened_system(root)
        for batch in batches:
            for row in batch.to_pylist():
                end = min(row["start"] + range_bytes, row["length"])
                with system.open_input_file(row["path"]) as stream:
                    lines = _lines(owned_bytes(stream, row["start"], end, row["length"]))
                for at in range(0, len(lines), _LINES_PER_BATCH):
                    some = lines[at : at + _LINES_PER_BATCH]
                    first = row["first_line"] + at
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["relative_path"]] * len(some)),
                            pa.array(range(first, first + len(some)), pa.int64()),
                            pa.array(some, pa.string()),
                        ],
                        names=["relative_path", "line_number", "line"],
                    )

    wanted = numbered.filter("NOT invalid AND lines > 0").drop("lines", "invalid")
    lines = wanted.repartition("path", "start").mapInArrow(
        read, "relative_path string, line_number long, line string"
    )
    rejected = (
        numbered.filter("invalid AND start = 0")
        .select("relative_path", F.lit(INVALID).alias("problem"))
        .unionByName(listed.filter(problem).select("relative_path", "problem"))
    )
    return lines, rejected


def scan_lines(
    spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """The same for all files in scope below ``root``; hidden names and files of any size included."""
    listed = list_files(spark, root)
    wanted = F.col("problem").isNotNull() | in_scope(F.col("relative_path"))
    return lines_of_files(listed.filter(wanted), root, range_bytes)
