"""Cutting the lineage of an intermediate frame that several later steps read."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Spark then removes what an execution has shuffled as soon as it has ended.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Types that a Parquet file cannot hold.
_NOT_IN_FILES = re.compile(r"\b(void|interval|variant)\b")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir``; a session without that setting uses a folder
    of its warehouse, which is shared as well. The rule is the same for every master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return named or f"{warehouse}/_intermediate"


@contextmanager
def _for_one_execution(df: DataFrame) -> Iterator[DataFrame]:
    """The same frame, whose shuffle files go when it has been computed."""
    spark = df.sparkSession
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        # a frame of its own: the caller's keeps its shuffle files
        yield df.select("*")
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)


def materialise(df: DataFrame) -> DataFrame:
    """The same rows, read back from the checkpoint folder; survives the loss of executors.

    What was shuffled for them is removed at once, as nothing reads it again.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with _for_one_execution(df) as own:
        return own.checkpoint()


def _folder(path: str, spark: SparkSession) -> tuple[JavaObject, JavaObject]:
    """(file system, path) for whatever store Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _in_files(df: DataFrame, path: str) -> DataFrame:
    """The rows, written to files and read back."""
    # names that differ in case only may stand side by side in a frame
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    with _for_one_execution(plain) as own:
        own.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def stored(df: DataFrame) -> DataFrame:
    """The same for large frames: columns in compressed files, of which a later step reads those it needs.

    The rows come back in any order. The files stay as long as the driver runs.
    """
    if _NOT_IN_FILES.search(df.schema.simpleString()):
        return materialise(df)
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4()}"
    rows = _in_files(df, path)
    system, folder = _folder(path, spark)
    system.deleteOnExit(folder)
    return rows


@contextmanager
def stored_meanwhile(df: DataFrame) -> Iterator[DataFrame]:
    """The same for frames that are read only inside the block: the files go with it."""
    if _NOT_IN_FILES.search(df.schema.simpleString()):
        yield materialise(df)
        return
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    try:
        yield _in_files(df, path)
    finally:
        system, folder = _folder(path, df.sparkSession)
        system.delete(folder, True)


def materialise_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Stored, with the number of rows, which is counted while they are written."""
    seen = Observation()
    rows = stored(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return rows, seen.get["n"]
