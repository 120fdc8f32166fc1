"""Nearest neighbours by cosine over vantage-point trees, one per shard of the rows.

Unit vectors under the Euclidean distance are a metric whose order is that of the cosine. A tree takes a vantage
point, halves the rest by distance to it, and goes on in both halves. A half is left out if the triangle inequality
puts it further away than ``factor`` times the fifth nearest found so far: factor one is exact, less prunes more.
Queries go through a tree in blocks, every query into its own near half first. Scores are computed from the
original vectors in double precision, ties go to the smaller vec_id.

Vectors that are NULL, zero, hold a NULL or non-finite component, or are not of the most common length take no part,
nor do rows without a vec_id. Rows that share the query's vec_id are its own; other repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from medweave.llm.common import query, table
from medweave.session import settle

LEAF, QUERY_BLOCK, SHARD_ROWS = 64, 512, 100_000
SLACK = 1e-7  # above the rounding of distances, so that ties are never pruned
INDEX = "shard int, kind int, ids binary, vectors binary, inner binary, outer binary"
FOUND = "query_id long, vec_id long, score double"


def usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def build(ids, vectors):
    """Rows in the order of an implicit tree: a range's first row is its vantage point, its near half comes before its far half."""
    import numpy as np

    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    order, inner, outer = np.lexsort((ids,)), np.zeros(len(ids)), np.zeros(len(ids))
    ranges = [(0, len(ids))]
    while ranges:
        lo, hi = ranges.pop()
        if hi - lo <= LEAF:
            continue
        rest = order[lo + 1 : hi]
        away = distance(unit[rest] @ unit[order[lo]])
        by = np.argsort(away, kind="stable")
        order[lo + 1 : hi], away, half = rest[by], away[by], (hi - lo - 1) // 2
        inner[lo], outer[lo] = away[half - 1], away[half]
        ranges += [(lo + 1, lo + 1 + half), (lo + 1 + half, hi)]
    return ids[order], vectors[order], inner, outer


def distance(cosine):
    import numpy as np

    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class Search:
    """The ``k`` nearest rows of one tree for a block of queries."""

    def __init__(self, tree, query_ids, queries, k: int, factor: float) -> None:
        import numpy as np

        self.ids, self.vectors, self.inner, self.outer = tree
        self.norms, self.q_norms = np.linalg.norm(self.vectors, axis=1), np.linalg.norm(queries, axis=1)
        self.unit, self.q_unit = self.vectors / self.norms[:, None], queries / self.q_norms[:, None]
        self.query_ids, self.queries, self.k, self.factor = query_ids, queries, k, factor
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.visit(0, len(self.ids), np.arange(len(queries)))

    def offer(self, lo: int, hi: int, active, cosine) -> None:
        """Rows lo to hi to the queries ``active``; those near enough by ``cosine`` are scored in full and merged."""
        import numpy as np

        near = (cosine >= self.scores[active, -1][:, None] - SLACK) & (self.ids[lo:hi][None, :] != self.query_ids[active][:, None])
        hit = np.flatnonzero(near.any(axis=1))
        if not len(hit):
            return
        i, j = np.nonzero(near[hit])
        scores, ids = np.full((len(hit), self.k + hi - lo), -np.inf), np.full((len(hit), self.k + hi - lo), np.iinfo(np.int64).max)
        own = active[hit]
        scores[:, : self.k], ids[:, : self.k] = self.scores[own], self.found[own]
        scores[i, self.k + j] = (self.queries[own[i]] * self.vectors[lo + j]).sum(axis=1) / (self.q_norms[own[i]] * self.norms[lo + j])
        ids[i, self.k + j] = self.ids[lo + j]
        best = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores[own], self.found[own] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)

    def visit(self, lo: int, hi: int, active) -> None:
        """Depth is the logarithm of the shard's size."""
        if not len(active) or lo == hi:
            return
        if hi - lo <= LEAF:
            self.offer(lo, hi, active, self.q_unit[active] @ self.unit[lo:hi].T)
            return
        cosine = self.q_unit[active] @ self.unit[lo]
        self.offer(lo, lo + 1, active, cosine[:, None])
        away, mid = distance(cosine), lo + 1 + (hi - lo - 1) // 2
        near_first = away <= (self.inner[lo] + self.outer[lo]) / 2
        self.visit(lo + 1, mid, active[near_first])
        self.visit(mid, hi, active[~near_first])
        reach = self.factor * distance(self.scores[active, -1]) + SLACK  # infinite until k rows are found
        self.visit(mid, hi, active[near_first & (self.outer[lo] - away <= reach)])
        self.visit(lo + 1, mid, active[~near_first & (away - self.inner[lo] <= reach)])


def packed(ids, vectors, *bounds):
    return [ids.astype("<i8").tobytes(), vectors.astype("<f8").tobytes(), *[b.astype("<f8").tobytes() for b in bounds]]


def unpacked(ids: bytes, vectors: bytes):
    import numpy as np

    own = np.frombuffer(ids, "<i8")
    return own, np.frombuffer(vectors, "<f8").reshape(len(own), -1)


def arrays(rows):
    import numpy as np

    ids = rows.column("vec_id").to_numpy()
    return ids, np.array(rows.column("v").to_pylist(), np.float64).reshape(len(ids), -1)


def index(rows: DataFrame, shards: int) -> DataFrame:
    """One tree per shard; rows are dealt out by where they are read, so equal rows spread as well."""

    def one(key, own):
        import pyarrow as pa

        made = packed(*build(*arrays(own)))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), *[pa.array([m], pa.binary()) for m in made]], [c.split()[0] for c in INDEX.split(", ")])

    dealt = rows.withColumn("shard", F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(shards)).cast("int"))
    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(one, INDEX)


def query_blocks(queries: DataFrame) -> DataFrame:
    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                ids, vectors = arrays(batch.slice(at, QUERY_BLOCK))
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.binary()) for m in packed(ids, vectors)], ["ids", "vectors"])

    return queries.mapInArrow(blocks, "ids binary, vectors binary")


def nearest(rows: DataFrame, queries: Column, k: int = 5, factor: float = 0.8, vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest rows of every row for which ``queries`` holds."""
    spark = rows.sparkSession
    clean = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    clean = settle(clean.where(F.col("vec_id").isNotNull() & usable(F.col("v"))))
    lengths = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same = clean.where(F.size("v") == lengths["d"])
    n = lengths["count"]
    shards = max(ceil(sqrt(n) / 4), ceil(n / SHARD_ROWS))  # trees and copies of the queries both grow with the square root
    trees = index(same.select("vec_id", "v"), shards)
    asked = same.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = query_blocks(asked).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "ids", "vectors", F.lit(None).cast("binary").alias("inner"), F.lit(None).cast("binary").alias("outer"))

    def search(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tree = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    tree = (*unpacked(r["ids"], r["vectors"]), np.frombuffer(r["inner"], "<f8"), np.frombuffer(r["outer"], "<f8")), r["shard"]
                elif tree is not None and tree[1] == r["shard"]:
                    ids, vectors = unpacked(r["ids"], r["vectors"])
                    done = Search(tree[0], ids, vectors, k, factor)
                    got = np.isfinite(done.scores)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, got.sum(axis=1))), pa.array(done.found[got]), pa.array(done.scores[got])], ["query_id", "vec_id", "score"])

    met = trees.unionByName(blocks).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.mapInArrow(search, FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op4_nearest")
def op4(spark, folder):
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
