"""What the operators of this folder share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from medweave.session import new_folder

# White space in the contracts of these operators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"

BATCH_ROWS = 1000  # whole texts that a Python worker of the pipeline gets at a time

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SHIPPED: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``f(spark, folder)`` under ``name``; ``sql`` computes the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return f

    return register


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python finds it by itself."""
    root = Path(__file__).resolve().parents[2]
    local = spark.sparkContext.master.startswith("local[") and Path.cwd() == root
    if local or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or SHIPPED.get("to") == spark.sparkContext.applicationId:
        return
    zipped = Path(tempfile.mkdtemp(), "medweave.zip")  # on the driver, from where Spark hands it to the executors
    with zipfile.ZipFile(zipped, "w") as out:
        for path in sorted(root.joinpath("medweave").rglob("*.py")):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(zipped))
    SHIPPED["to"] = spark.sparkContext.applicationId


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python at most ``BATCH_ROWS`` at a time: more whole texts at once take tens of MB in the JVM and again in the worker."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:  # 0 and less are no limit
        spark.conf.set(setting, str(BATCH_ROWS))


def settle_texts(df: DataFrame, row_group: int = 16 << 20) -> DataFrame:
    """``session.settle`` for rows with whole texts: small row groups, since each writer holds one in memory."""
    path = new_folder(df.sparkSession, "texts")
    df.write.option("parquet.block.size", row_group).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores put before them until none is a column of ``df`` (whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
