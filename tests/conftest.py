from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    """{path: text} -> files frame."""
    from tallyguard.sources.files import with_engine

    def build(texts: dict[str, str], **extra: str):
        rows = [(*extra.values(), path, text) for path, text in texts.items()]
        names = [*extra, "relative_path", "content"]
        return with_engine(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)))

    return build


@pytest.fixture(scope="session")
def sql_schema():
    return (ROOT / "tests" / "fixture.sql").read_text()


@pytest.fixture(scope="session")
def prisma_schema():
    return (ROOT / "tests" / "fixture.prisma").read_text()
