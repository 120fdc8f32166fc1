"""Best-fit packing of token pieces into sequences by minimum bin slack.

Which lengths share a sequence depends only on how many pieces each length has, so it is decided from
one number per length: the longest piece left opens a bin, a subset-sum table over the lengths that are
left (one bit per sum) finds the fullest combination, and that combination is taken out as many times as
its pieces last. Pieces then find their place by their rank among those of their length.

NULL and empty texts are documents of one piece that holds the end id alone. Rows that repeat a doc_id
are documents of their own; their pieces carry that doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from medweave.llm.common import query, table
from medweave.llm.tokens import WORDS_KEPT
from medweave.session import settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long"


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = True, words_kept: int = WORDS_KEPT) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): ids of the whole text and ``end_id``, longer ones cut every ``capacity`` ids.

    ``nth`` counts the pieces of one length in the partition ``part``: settle the result before using both.
    ``ids`` are unsigned little-endian 32-bit integers (NULL unless ``keep_ids``). A worker remembers the ids of ``words_kept`` words.
    """

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from medweave.llm.tokens import encoder, pack

        encode, end, part, seen = encoder(tokenizer, words_kept).encode, pack([end_id]), TaskContext.get().partitionId(), {}
        names = [c.split()[0] for c in PIECES.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(map(as_bytes, texts)), strict=True):
                ids += end
                for at in range(0, len(ids), 4 * capacity):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc_id, at // (4 * capacity), at // 4, n, zlib.crc32(own), own if keep_ids else None, part, seen.get(n, 0)))
                    seen[n] = seen.get(n, 0) + 1
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


def as_bytes(value) -> bytes | None:
    return value.as_py()


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length fill ``room`` best, by subset sums in the bits of one number."""
    mask, reach, stages = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        copies = min(counts[length], room // length)
        stages.append((length, copies, reach))
        step = 1
        while copies:  # 1, 2, 4, ... copies and the rest give every number of copies
            step = min(step, copies)
            reach |= (reach << (step * length)) & mask
            copies, step = copies - step, 2 * step
        if reach >> room:
            break
    left, taken = reach.bit_length() - 1, {}
    for length, copies, before in reversed(stages):
        k = next(k for k in range(copies + 1) if left >= k * length and before >> (left - k * length) & 1)
        if k:
            taken[length] = k
            left -= k * length
    return taken


def combinations(counts: dict[int, int], capacity: int) -> Iterator[tuple[int, dict[int, int]]]:
    """(how often, copies of each length) until no piece is left.

    Taken as often as it can be, a combination leaves fewer pieces of some length than it holds: at most
    sum(capacity / length) combinations, about 17,000 for a capacity of 2,048, whatever the input's size.
    """
    left = dict(counts)
    while left:
        opens = max(left)
        left[opens] -= 1
        chosen = fullest({n: c for n, c in left.items() if c}, capacity - opens)
        left[opens] += 1
        chosen[opens] = chosen.get(opens, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        yield times, chosen
        for n, k in chosen.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]


def places(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, copies, first sequence, offset of the first copy)."""
    ranks, sequence, out = dict.fromkeys(counts, 0), 0, []
    for times, chosen in combinations(counts, capacity):
        offset = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            out.append((length, ranks[length], ranks[length] + times * copies, copies, sequence, offset))
            ranks[length] += times * copies
            offset += copies * length
        sequence += times
    return out


def assign(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Settled pieces of ``cut`` with ``sequence_id`` and ``offset``.

    One row per length goes to the driver (at most ``capacity``), and the table of places that comes back
    is bounded as ``combinations`` says; both are the same size for any input.
    """
    spark = pieces.sparkSession
    sizes = settle(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n")))
    counts = {r["length"]: r["_n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    table_of = spark.createDataFrame(places(counts, capacity), "length long, _from long, _to long, _copies long, _first long, _at long")
    ranked = pieces.join(starts, ["part", "length"]).withColumn("_rank", F.col("_before") + F.col("nth"))
    placed = ranked.join(F.broadcast(table_of), "length").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    inside = F.col("_rank") - F.col("_from")
    return placed.select(
        *pieces.columns,
        (F.col("_first") + F.floor(inside / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_at") + inside % F.col("_copies") * F.col("length")).alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = True, words_kept: int = WORDS_KEPT
) -> DataFrame:
    """Every piece of every document with its sequence and place in it."""
    return assign(settle(cut(docs, tokenizer, capacity, end_id, keep_ids, words_kept)), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``length`` and ``ids``, no longer than the capacity each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_parts")).select(
        "sequence_id", "length", F.aggregate("_parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids")
    )


@query("op3_best_fit_packing")
def op3(spark, folder):
    from public_tokenizers import path

    placed = pack_documents(table(spark, folder, "documents"), path("word_bpe_49k.json"), keep_ids=False)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
