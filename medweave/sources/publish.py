"""Publishing a folder of files: all of them or none.

A publish is written down before it begins. Its manifest, a folder ``_publish-<id>`` in the target that readers pass
over, lists every file to be moved with its size; a marker in it tells that the list is whole. Only then are files
moved, by several threads, each with one rename. When all are there the manifest goes, which ends the publish.

* A move that fails: everything that was moved goes back and the manifest goes; the target is as it was.
* A driver that is lost: the manifest stays, and the next publish to this target, or ``recover``, goes on where it was left
  or takes it back. A file is at its old place or at its new one, so each can be told apart and either way may be repeated.
* A manifest without its marker: nothing was moved yet; it is dropped.

The files' names come to the driver a few at a time; the files themselves never do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from medweave.operators.combine import clashes
from medweave.sources.files import list_files

MAX_LISTED = 5
PREFIX, FILES, READY = "_publish-", "files", "READY"
ENTRY = "source string, target string, size long"


class _Store:
    """The file system a folder lies in."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def size(self, file: str) -> int | None:
        """None where there is no such file."""
        at = self.path(file)
        return self.fs.getFileStatus(at).getLen() if self.fs.exists(at) else None

    def rename(self, source: str, target: str) -> None:
        to = self.path(target)
        self.fs.mkdirs(to.getParent())
        if not self.fs.rename(self.path(source), to):
            raise OSError(f"could not move {source}")

    def remove(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)

    def folders(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [str(s.getPath()) for s in self.fs.listStatus(at) if s.isDirectory()] if self.fs.exists(at) else []


def nonempty_output(spark: SparkSession, folder: str) -> bool:
    """Whether a folder exists and holds a file with something in it."""
    store = _Store(spark, folder)
    return store.fs.exists(store.path(folder)) and not list_files(spark, folder, True).where(F.col("size") > 0).isEmpty()


def _spread(entries: Iterator[Row], step: Callable[[Row], bool], threads: int) -> int:
    """Run ``step`` for all entries on ``threads`` threads, with few of them waiting; how many gave True. The first error ends it."""
    done, running = 0, set()
    with ThreadPoolExecutor(max_workers=threads) as pool:
        for entry in entries:
            running.add(pool.submit(step, entry))
            if len(running) >= 4 * threads:
                ended, running = wait(running, return_when=FIRST_COMPLETED)
                done += sum(f.result() for f in ended)
        done += sum(f.result() for f in running)
    return done


def _forward(store: _Store) -> Callable[[Row], bool]:
    """Moves a file to its new place unless it is there; refuses a name that something else has taken."""

    def step(entry: Row) -> bool:
        source, target = store.size(entry["source"]), store.size(entry["target"])
        if source is None and target == entry["size"]:
            return False
        if source is None:
            raise FileNotFoundError(entry["source"])
        if target is not None:
            raise FileExistsError(f"{entry['target']} is there already. Nothing was overwritten.")
        store.rename(entry["source"], entry["target"])
        return True

    return step


def _back(store: _Store) -> Callable[[Row], bool]:
    """Moves a file back to its old place if it left it."""

    def step(entry: Row) -> bool:
        if store.size(entry["source"]) is not None or store.size(entry["target"]) is None:
            return False
        store.rename(entry["target"], entry["source"])
        return True

    return step


def _entries(spark: SparkSession, manifest: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(f"{manifest}/{FILES}")


def roll_back(spark: SparkSession, manifest: str, threads: int = 8) -> int:
    """Take back what a publish has moved, and its manifest; the number of files that went back."""
    store = _Store(spark, manifest)
    n = _spread(_entries(spark, manifest).toLocalIterator(), _back(store), threads)
    store.remove(manifest)
    return n


def unfinished(spark: SparkSession, out: str) -> list[str]:
    """Manifests of publishes to ``out`` that did not end."""
    return sorted(f for f in _Store(spark, out).folders(out) if f.rsplit("/", 1)[-1].startswith(PREFIX))


def recover(spark: SparkSession, out: str, forward: bool = True, threads: int = 8) -> int:
    """Finish the publishes to ``out`` that a lost driver left behind, or with ``forward=False`` take them back.

    The number of files moved. One that cannot be finished, because a name was taken or a file is gone, is taken back.
    """
    moved, store = 0, _Store(spark, out)
    for manifest in unfinished(spark, out):
        if not store.fs.exists(store.path(f"{manifest}/{READY}")):
            store.remove(manifest)
        elif forward:
            moved += _move(spark, manifest, threads)
        else:
            moved += roll_back(spark, manifest, threads)
    return moved


def _move(spark: SparkSession, manifest: str, threads: int) -> int:
    store = _Store(spark, manifest)
    try:
        n = _spread(_entries(spark, manifest).toLocalIterator(), _forward(store), threads)
    except Exception:
        roll_back(spark, manifest, threads)
        raise
    store.remove(manifest)
    return n


def publish_no_clobber(spark: SparkSession, staged: str, out: str, threads: int = 8) -> int:
    """Move all files from ``staged`` to ``out``, or none: refuse when nothing was written or a name is taken.

    Both lie in one file system. What an earlier publish to ``out`` left unfinished is finished first.
    """
    recover(spark, out, threads=threads)
    if not nonempty_output(spark, staged):
        raise ValueError(f"nothing was written for {out}")
    store, out = _Store(spark, out), out.rstrip("/")
    new = list_files(spark, staged, True)
    if store.fs.exists(store.path(out)):
        taken = clashes(new, list_files(spark, out, True), "relative")
        n = taken.count()
        if n:
            shown = ", ".join(r["relative"] for r in taken.orderBy("relative").limit(MAX_LISTED).collect())
            more = f" and {n - MAX_LISTED} more" if n > MAX_LISTED else ""
            raise FileExistsError(f"{n} file(s) already in {out}: {shown}{more}. Nothing was overwritten.")
    manifest = f"{out}/{PREFIX}{uuid.uuid4().hex}"
    listed = new.select(F.col("path").alias("source"), F.concat(F.lit(f"{out}/"), "relative").alias("target"), "size")
    listed.write.parquet(f"{manifest}/{FILES}")
    store.fs.create(store.path(f"{manifest}/{READY}"), False).close()
    return _move(spark, manifest, threads)
