"""Hard negatives by a secondary sort of packed keys.

The score of two rows is the integer inner product of their vectors, each component x taken as floor(256 * x). For
every anchor and each of its first ``k`` rows of the same label (its positives), the result holds the first ``k`` rows
of another label whose score lies between ``low`` and ``high`` percent of the positive's: higher scores first, ties
by smaller vec_id.

Rows are dealt to shards of bounded size, anchors to blocks that meet every shard. A shard keeps of an anchor's scores
what can still be among the first ``k``: first of its label; then, when the positives are known, of each positive's
window. That leaves no row out, since the first ``k`` of all are among the first ``k`` of their own shards. What is
kept is packed into keys (anchor, descending score, positives before negatives, vec_id) whose byte order is the
order wanted. ``repartitionAndSortWithinPartitions`` brings each anchor's keys together in that order, and an
iterator goes through them once: a positive opens a window, a negative is emitted for every open window that holds
it, and a window closes with its last negative or below its range. At most ``k`` windows are open at a time; no
anchor's rows are held.

Rows without a vec_id or label, and vectors that are NULL or hold a NULL or non-finite component, take no part.
Vectors of different lengths have no inner product and do not meet. Rows that share the anchor's vec_id are its own;
other repeated rows are rows of their own, and every anchor row asks for itself. Scores beyond 64 bits are held at
their ends.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from medweave.llm.common import query, table
from medweave.session import settle

SHARD_ROWS, ANCHOR_BLOCK = 50_000, 256
POSITIVE, NEGATIVE = 0, 1
KEY = struct.Struct(">QQBQ")  # anchor, descending score, positive or negative, vec_id
SIGN, END = 1 << 63, (1 << 63) - 1
ROWS = "d int, shard int, kind int, part long, uids binary, ids binary, labels binary, comps binary, windows binary"
FOUND = "uid long, anchor_id long, kind int, score long, vec_id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def pack_key(uid: int, kind: int, score: int, vec_id: int) -> bytes:
    """A key whose order as bytes is: anchor, higher score first, positives first, smaller vec_id first."""
    return KEY.pack(uid, END - score, kind, vec_id + SIGN)


def unpack_key(key: bytes) -> tuple[int, int, int, int]:
    uid, score, kind, vec_id = KEY.unpack(key)
    return uid, kind, END - score, vec_id - SIGN


def mined(keys: Iterable[tuple[bytes, int]], k: int, low: int, high: int) -> Iterator[tuple]:
    """Rows of the result from sorted keys; the value of a key is the anchor's vec_id."""
    last, opened, positives = None, [], 0
    for key, anchor_id in keys:
        uid, kind, score, vec_id = unpack_key(key)
        if uid != last:
            last, opened, positives = uid, [], 0
        if kind == POSITIVE:
            positives += 1
            if positives <= k and score >= 0:  # below zero the window's floor is above its ceiling
                opened.append([vec_id, score, 0])
            continue
        opened = [w for w in opened if w[2] < k and low * w[1] <= 100 * score]
        for w in opened:
            if 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor_id, w[0], w[2], vec_id, w[1], score


def whole_numbers(vectors):
    """floor(256 * x): exact doubles where all inner products are exact, Python integers elsewhere."""
    import numpy as np

    scaled = np.floor(vectors.astype(np.float64) * 256.0)
    if not np.isfinite(scaled).all():
        scaled = np.array([[int(x) * 256 if abs(x) > 1e300 else int(np.floor(x * 256.0)) for x in v] for v in vectors.tolist()], object).reshape(vectors.shape)
    return scaled


def products(left, right):
    """All inner products of two blocks, as 64-bit integers."""
    import numpy as np

    bound = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if bound < 2.0**53:
        return (left @ right.T).astype(np.int64)
    whole = lambda block: np.array([[int(x) for x in row] for row in block.tolist()], object).reshape(block.shape)
    exact = whole(left) @ whole(right).T
    return np.clip(exact, -END, END).astype(np.int64)


def first(scores, ids, fits, k: int):
    """Per row of ``scores`` the columns of its first ``k`` that fit; -1 where there are fewer. ``ids`` ascend."""
    import numpy as np

    held = np.where(fits, scores, np.iinfo(np.int64).min)
    n = held.shape[1]
    if n > 4 * k:  # the k-th highest score of a row, then all that reach it: ties are settled by the sort below
        least = np.partition(held, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero((held >= least[:, None]) & fits)
    else:
        rows, cols = np.nonzero(fits)
    order = np.lexsort((cols, -held[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    begin = np.searchsorted(rows, np.arange(len(held)))
    place = np.arange(len(rows)) - begin[rows]
    out = np.full((len(held), k), -1)
    out[rows[place < k], place[place < k]] = cols[place < k]
    return out


class Shard:
    """Some rows, in the order of their vec_ids, against blocks of anchors."""

    def __init__(self, ids, labels, comps, k: int, low: int, high: int) -> None:
        import numpy as np

        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.comps, self.k, self.low, self.high = ids[order], labels[order], comps[order], k, low, high

    def positives(self, ids, labels, comps):
        scores = products(comps, self.comps)
        return scores, [first(scores, self.ids, (labels[:, None] == self.labels) & (ids[:, None] != self.ids), self.k)]

    def negatives(self, ids, labels, comps, windows):
        """``windows``: the scores of each anchor's positives, below zero where it has fewer."""
        import numpy as np

        scores = products(comps, self.comps)
        other, found = labels[:, None] != self.labels, []
        for w in windows.T:
            least, most = [[-(-self.low * int(p) // 100) for p in w], [self.high * int(p) // 100 for p in w]]
            least, most = (np.minimum(np.array(b, object), END).astype(np.int64) for b in (least, most))
            found.append(first(scores, self.ids, other & (scores >= least[:, None]) & (scores <= most[:, None]) & (w >= 0)[:, None], self.k))
        return scores, found


def usable(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def blocks(rows: DataFrame, kind: int, size: int, windows: bool = False) -> DataFrame:
    """Rows of one length packed into blocks of at most ``size``; with ``windows``, one column more."""

    def made(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        number = 0
        for batch in batches:
            lengths = batch.column("d").to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                own = pa.Table.from_batches([batch]).filter(pa.array(lengths == d))
                for at in range(0, own.num_rows, size):
                    part, number = own.slice(at, size).combine_chunks(), number + 1
                    column = lambda c: pa.array([part[c].to_numpy().astype("<i8").tobytes()], pa.binary())  # noqa: B023, E731
                    flat = lambda c, t: pa.array([np.concatenate([np.zeros(0, t), *part[c].to_numpy()]).astype(t).tobytes()], pa.binary())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([
                        pa.array([d], pa.int32()), pa.array([part["shard"][0].as_py()], pa.int32()), pa.array([kind], pa.int32()), pa.array([number], pa.int64()), column("uid"), column("vec_id"),
                        column("label"), flat("v", "<f8"), flat("windows", "<i8") if windows else pa.nulls(1, pa.binary()),
                    ], [c.split()[0] for c in ROWS.split(", ")])

    return rows.mapInArrow(made, ROWS)


def score(shards: DataFrame, anchors: DataFrame, n_shards: int, k: int, low: int, high: int) -> DataFrame:
    """What every shard keeps of every anchor: positives, or negatives where the anchors bring their windows."""

    def meet(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own, at, parts = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels, uids = (np.frombuffer(r[c], "<i8") for c in ("ids", "labels", "uids"))
                comps = np.frombuffer(r["comps"], "<f8").reshape(len(ids), r["d"])
                if r["kind"] == 0:
                    if at != (r["d"], r["shard"]):
                        at, parts = (r["d"], r["shard"]), []
                    parts.append((ids, labels, comps))
                    own = None
                    continue
                if at != (r["d"], r["shard"]):
                    continue  # no row of this length lies in this shard
                if own is None:
                    ids_, labels_, comps_ = (np.concatenate(c) for c in zip(*parts, strict=True))
                    own = Shard(ids_, labels_, whole_numbers(comps_), k, low, high)
                kind = POSITIVE if r["windows"] is None else NEGATIVE
                asked = ids, labels, whole_numbers(comps)
                scores, found = own.positives(*asked) if kind == POSITIVE else own.negatives(*asked, np.frombuffer(r["windows"], "<i8").reshape(len(ids), k))
                # A row within several windows of its anchor is kept once.
                pairs = np.unique(np.concatenate([(np.arange(len(ids))[:, None] * len(own.ids) + f)[f >= 0] for f in found]))
                row, col = pairs // len(own.ids), pairs % len(own.ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids[row]), pa.array(ids[row]), pa.array(np.full(len(row), kind, np.int32)), pa.array(scores[row, col]), pa.array(own.ids[col])], [c.split()[0] for c in FOUND.split(", ")]
                )

    copies = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    met = shards.unionByName(copies).repartitionById(n_shards, "shard")
    return met.sortWithinPartitions("d", "shard", "kind", "part").mapInArrow(meet, FOUND)


def mine(rows: DataFrame, anchors: Column, label: Column, k: int = 5, low: int = 80, high: int = 100, vector: str = "embedding") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores for every row for which ``anchors`` holds."""
    spark = rows.sparkSession
    clean = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    clean = clean.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).withColumn("d", F.size("v"))
    clean = settle(clean.withColumn("uid", F.monotonically_increasing_id()))
    n_shards = max(1, ceil(clean.count() / SHARD_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Dealt by number, so that shards are of one size whatever the rows hold.
    dealt = clean.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(n_shards)).cast("int"))
    shards = settle(blocks(dealt.repartitionById(n_shards, "shard"), 0, SHARD_ROWS))
    asked = clean.where("asks").withColumn("shard", F.lit(0))
    first_of_shards = score(shards, blocks(asked, 1, ANCHOR_BLOCK), n_shards, k, low, high)

    keys = lambda found: found.rdd.map(lambda r: (pack_key(r[0], r[2], r[3], r[4]), r[1]))
    in_order = lambda pairs: pairs.repartitionAndSortWithinPartitions(n_shards, partitionFunc=lambda key: zlib.crc32(key[:8]))

    def first_positives(pairs: Iterator) -> Iterator[tuple]:
        last, n = None, 0
        for key, anchor_id in pairs:
            uid, kind, score, vec_id = unpack_key(key)
            last, n = uid, n + 1 if uid == last else 1
            if n <= k:
                yield uid, anchor_id, kind, score, vec_id

    positives = settle(spark.createDataFrame(in_order(keys(first_of_shards)).mapPartitions(first_positives), FOUND))
    windows = positives.groupBy("uid").agg(F.sort_array(F.collect_list("score"), False).alias("windows"))  # at most k
    filled = F.concat("windows", F.array_repeat(F.lit(-1).cast("long"), F.lit(k) - F.size("windows")))
    known = blocks(asked.join(windows, "uid").withColumn("windows", filled), 1, ANCHOR_BLOCK, windows=True)
    both = score(shards, known, n_shards, k, low, high).unionByName(positives)
    return spark.createDataFrame(in_order(keys(both)).mapPartitions(lambda pairs: mined(pairs, k, low, high)), RESULT)


SQL = """
WITH row AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM row a JOIN row r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


@query("op11_hard_negatives", SQL)
def op11(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)
