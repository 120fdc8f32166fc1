"""Session, shared work folder and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "medweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here expects; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    A machine-local folder is made only when the setting is missing and Spark runs in local mode.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root is None:
        root = context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="medweave-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path (not yet created) below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of a copy that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# Whether Spark deletes a query's shuffle files when it has ended, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writers: Counter[int] = Counter()  # by session, where it is switched on for them
_switching = Lock()


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here take their shuffle files with them; the last of several threads puts the setting back."""
    session = spark._jsparkSession.hashCode()
    with _switching:
        ours = _writers[session] > 0 or spark.conf.get(CLEANUP, None) is None  # one that is set by hand stays
        if ours:
            _writers[session] += 1
            spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _switching:
            if ours:
                _writers[session] -= 1
                if not _writers[session]:
                    spark.conf.unset(CLEANUP)


def settle(df: DataFrame, by: str | None = None, compression: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: the lineage ends here.

    With ``by``, a folder per value of that column, so that readers of one value open no other's files. ``compression``
    is the session's unless given; zstd suits wide rows of text. ``path`` is a fresh folder unless given.

    The copy survives the loss of executors, values that depend on the partition a row landed in
    stay what they were, and later readers take only the columns and row groups they need. The shuffle files behind it
    are deleted once it is written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = path or new_folder(spark, "settled")
    with shuffles_deleted(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


# What a core goes through in at least this many pieces, each sorted on its own.
PIECES_PER_CORE = 16


def pieces(spark: SparkSession) -> int:
    """Partitions to ask for where adaptive execution shall not merge what a task then sorts or holds."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), PIECES_PER_CORE * spark.sparkContext.defaultParallelism)


def together(spark: SparkSession, **jobs: Callable[[], Any]) -> dict[str, Any]:
    """Run independent steps at the same time, so that the tail of one does not leave the cluster idle."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        started = {name: pool.submit(inheritable_thread_target(spark)(job)) for name, job in jobs.items()}
        return {name: future.result() for name, future in started.items()}
