"""Line dedup over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by line key: ``key``, ``n_docs`` (documents of one batch, or of several
after compaction, that hold the line) and ``keeper`` (the document that keeps it, named by the first batch
that holds the line; NULL where an older run names it). A new batch is merge-joined with the runs, which are
neither shuffled nor sorted again; what the anti-join leaves over is new and names its keeper. When a level
has ``fanout`` runs they are compacted into one run of the next level.

Batches are taken from the largest doc_id downwards, so that the first batch with a line holds its keeper.

NULL and empty texts are one empty line. Rows with one doc_id are one document; so are all rows without a
doc_id, which counts as the smallest. Ties therefore cannot occur: a keeper keeps every copy of its line.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from medweave.llm.common import SPACES, query, table, unused
from medweave.session import new_folder, settle

WHITE = SPACES.encode()
PAIRS = "key binary, doc_id long"
RUN = "key binary, n_docs long, keeper long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the line without white space around it and with A-Z in lower case; None below ``min_chars``."""
    line = line.strip(WHITE).lower()  # of bytes: ASCII only
    if len(line) < min_chars or (not line.isascii() and len(line.decode()) < min_chars):
        return None
    return blake2b(line, digest_size=16).digest()


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """The distinct keys of each text."""

    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found, owners = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                own = {line_key(line, min_chars) for line in (text.as_py() or b"").split(b"\n")}
                own.discard(None)
                found.extend(own)
                owners.extend([doc_id] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(owners, pa.int64())], ["key", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(keys, PAIRS)


class LineRuns:
    """The runs, by level. ``buckets`` must stay what it was when the first run was written."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 3, buckets: int | None = None) -> None:
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        """``run`` comes partitioned by key, so that every bucket becomes one sorted file."""
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def add(self, pairs: DataFrame) -> DataFrame:
        """Add a batch of (key, doc_id) and return its run; rows with a keeper are lines no run had."""
        counted = pairs.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("_largest"))
        counted, marks = counted.repartition(self.buckets, "key"), []
        for k, run in enumerate(self.runs()):
            known = self.spark.table(run).select("key", F.lit(True).alias(f"_in{k}"))
            counted = counted.join(known.hint("merge"), "key", "left")
            marks.append(F.col(f"_in{k}").isNull())
        fresh = reduce(Column.__and__, marks, F.lit(True))
        run = self._write(counted.select("key", "n_docs", F.when(fresh, F.col("_largest")).alias("keeper")))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        self._compact()
        return self.spark.table(run) if run in self.runs() else self.spark.read.parquet(f"{self.folder}/{run}")

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self._write(self._merged(level))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)
                for run in level:
                    self.spark.sql(f"DROP TABLE {run}")  # the name only; the files go with the folder
                level.clear()

    def _merged(self, runs: list[str]) -> DataFrame:
        # read as plain files: a union of bucketed scans is taken to be grouped by key already, and is not
        rows = self.spark.read.schema(RUN).parquet(*[f"{self.folder}/{run}" for run in runs])
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def lines(self) -> DataFrame:
        """Every line key once: in how many documents it is, and which one keeps it."""
        return self._merged(self.runs())

    def close(self) -> None:
        """Forget the tables' names."""
        for run in self.runs():
            self.spark.sql(f"DROP TABLE {run}")
        self.levels = []


def in_batches(docs: DataFrame, pairs: DataFrame, batches: int) -> list[DataFrame]:
    """``pairs`` in written folders, one per range of doc_id, the largest first."""
    cuts = [k / batches for k in range(1, batches)]
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), cuts, 10_000)).first()[0] if cuts else None
    at = F.lit(0)
    for bound in sorted(set(bounds or [])):
        at = at + F.when(F.col("doc_id") > bound, 1).otherwise(0)
    folder = new_folder(docs.sparkSession, "line-keys")
    pairs.withColumn("batch", F.coalesce(at, F.lit(0))).write.partitionBy("batch").parquet(folder)
    written = docs.sparkSession.read.schema(f"{PAIRS}, batch int").parquet(folder)
    return [written.where(F.col("batch") == k).drop("batch") for k in range(len(set(bounds or [])), -1, -1)]


def repeated_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Per document the keys of the lines it loses: ``doc_id``, ``drops``."""
    spark = docs.sparkSession
    runs = LineRuns(spark, new_folder(spark, "line-runs"), fanout)
    parts = in_batches(docs, line_keys(docs, min_chars), batches)
    for part in parts:
        runs.add(part)
    frequent = settle(runs.lines().where(F.col("n_docs") >= min_docs).select("key", "keeper"))
    runs.close()
    pairs = reduce(DataFrame.unionByName, parts)
    lost = pairs.join(frequent, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drops"))


def _rewriter(min_chars: int):
    @F.arrow_udf("struct<text string, n_lines long, n_dropped long>")
    def rewrite(texts, drops):
        import pyarrow as pa

        out = []
        for text, lost in zip(texts.cast(pa.binary()), drops, strict=True):
            lines, lost = (text.as_py() or b"").split(b"\n"), set(lost.as_py() or ())
            kept = [x for x in lines if line_key(x, min_chars) not in lost] if lost else lines
            out.append({"text": b"\n".join(kept).decode(), "n_lines": len(lines), "n_dropped": len(lines) - len(kept)})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]))

    return rewrite


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 4, fanout: int = 3, result: str = "deduped") -> DataFrame:
    """``docs`` and a struct ``result``: the text that is left, its lines before and how many of them went."""
    lost = repeated_lines(docs, min_docs, min_chars, batches, fanout)
    (own,) = unused(docs, "_drops")
    lost = lost.select(F.col("doc_id").alias("_doc_id"), F.col("drops").alias(own))
    joined = docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(lost["_doc_id"]), "left").drop(lost["_doc_id"])
    return joined.withColumn(result, _rewriter(min_chars)(F.col("text").cast("string"), F.col(own))).drop(own)


SQL = """
WITH line AS (
  SELECT doc_id, k, x, lower_az(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM line WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY k) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM (SELECT line.*, coalesce(keeper <> doc_id, false) AS lost FROM line LEFT JOIN frequent USING (key)) GROUP BY doc_id
""".replace("lower_az(", "translate(").replace("chr(13))) AS key", "chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key")


@query("op1_line_dedup", SQL)
def op1(spark, folder):
    done = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "deduped.n_lines", "deduped.n_dropped", F.sha2("deduped.text", 256).alias("kept_sha256"))
