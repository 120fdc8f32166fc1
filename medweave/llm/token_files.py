"""Files of token ids in a length-limited canonical Huffman code.

A folder holds ``codebook`` (id, bits: at most one row per id of the vocabulary) and ``blocks``, in folders
``part=0, 1, ...`` that follow each other in doc_id order. A block holds the ids of whole documents, can be
read without any other, and says where every 256th code begins, so that a reader can start inside it.

Rows with a NULL doc_id come first. Rows that repeat a doc_id follow each other in text order. NULL and empty
texts are documents of the end id alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from medweave.llm.common import query, table
from medweave.session import new_folder

BLOCK_IDS, EVERY, MAX_BITS = 1 << 18, 256, 20
IDS = "part int, place long, doc_id long, before long, n_tokens long, ids binary"
BLOCKS = "part int, place long, doc_ids array<long>, lengths array<long>, before long, n_ids long, begins array<long>, packed binary"
READ = "part int, place long, doc_id long, before long, n_tokens long, ids_crc32 long, ids binary"


def batch_of(rows: list[tuple], types: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], [f"c{i}" for i in range(len(types))])


def token_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of each text in doc_id order, with their place in their partition and what is before them there.

    Ids are kept in 16 bits where the vocabulary allows. Write the result before using it.
    """

    def ids(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from medweave.llm.tokens import encoder, library, pack

        narrow = library(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        encode, end, part, place, before = encoder(tokenizer).encode, pack([end_id]), TaskContext.get().partitionId(), 0, 0
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            texts = (v.as_py() for v in batch.column("text").cast(pa.binary()))
            rows, size = [], 0
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                own += end
                n = len(own) // 4
                rows.append((part, place, doc_id, before, n, np.frombuffer(own, "<u4").astype("<u2").tobytes() if narrow else own))
                place, before, size = place + 1, before + n, size + n
                if size > 1 << 21:
                    yield batch_of(rows, types)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows, types)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(ids, IDS)


def _unpacked(own: bytes, n: int):
    import numpy as np

    return np.frombuffer(own, "<u2" if len(own) == 2 * n else "<u4")


def counted(ids, lengths):
    """How often each id occurs in a batch: counted for all documents of one width at a time."""
    import numpy as np
    import pyarrow.compute as pc

    narrow = pc.equal(pc.binary_length(ids), pc.multiply(lengths, 2))
    both = [np.bincount(np.frombuffer(b"".join(ids.filter(k).to_pylist()), t)) for k, t in ((narrow, "<u2"), (pc.invert(narrow), "<u4"))]
    total = np.zeros(max(map(len, both)), np.int64)
    for own in both:
        total[: len(own)] += own
    return total


def id_counts(settled: DataFrame) -> DataFrame:
    """How often each id occurs: ``id``, ``n``."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen = np.zeros(0, np.int64)
        for batch in batches:
            got = counted(batch.column("ids"), batch.column("n_tokens"))
            if len(got) > len(seen):
                seen = np.concatenate([seen, np.zeros(len(got) - len(seen), np.int64)])
            seen[: len(got)] += got
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], ["id", "n"])

    return settled.select("ids", "n_tokens").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def to_blocks(settled: DataFrame, ids: list[int], bits: list[int], block_ids: int, every: int) -> DataFrame:
    def blocks(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from medweave.llm.huffman import Code

        code = Code(ids, bits)
        longs = pa.list_(pa.int64())
        types = [pa.int32(), pa.int64(), longs, longs, pa.int64(), pa.int64(), longs, pa.binary()]

        def block(rows: list[tuple]):
            flat = np.concatenate([_unpacked(r[5], r[4]) for r in rows])
            packed, begins = code.encode(flat, every)
            part, place, _, before, _, _ = rows[0]
            return batch_of([(part, place, [r[2] for r in rows], [r[4] for r in rows], before, len(flat), begins, packed)], types)

        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                follows = held and row[0] == held[-1][0] and row[1] == held[-1][1] + 1
                if held and (not follows or size >= block_ids):
                    yield block(held)
                    held, size = [], 0
                held.append(row)
                size += row[4]
        if held:
            yield block(held)

    return settled.mapInArrow(blocks, BLOCKS)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS, every: int = EVERY, max_bits: int = MAX_BITS
) -> None:
    """Write the ids of ``docs`` (doc_id, text), ``end_id`` behind each text, to the new folder ``path``."""
    import numpy as np

    from medweave.llm.huffman import code_lengths

    spark = docs.sparkSession
    raw = new_folder(spark, "ids")
    token_ids(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(raw)
    settled = spark.read.schema(IDS).parquet(raw)
    counted = id_counts(settled).orderBy("id").collect()  # at most one row per id of the vocabulary
    ids, weights = [r["id"] for r in counted], np.array([r["n"] for r in counted], np.int64)
    bits = [int(b) for b in code_lengths(weights, max_bits)]
    spark.createDataFrame(list(zip(ids, bits)), "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    to_blocks(settled, ids, bits, block_ids, every).write.partitionBy("part").option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, every: int = EVERY) -> DataFrame:
    """Per document: its place in the files, the ids before it, its ids (unsigned little-endian 32-bit) and their crc32."""
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").collect()  # at most one row per id of the vocabulary
    ids, bits = [r["id"] for r in book], [r["bits"] for r in book]

    def documents(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from medweave.llm.huffman import Code

        code = Code(ids, bits)
        lookup = code.table()
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for part, place, doc_ids, lengths, before, n, begins, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flat = code.decode(packed, np.array(begins, np.int64), n, every, lookup).astype("<u4")
                rows, at = [], 0
                for k, (doc_id, size) in enumerate(zip(doc_ids, lengths, strict=True)):
                    own = flat[at : at + size].tobytes()
                    rows.append((part, place + k, doc_id, before + at, size, zlib.crc32(own), own))
                    at += size
                yield batch_of(rows, types)

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one row per part file, as many as the writing job had tasks
    sizes = sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts = accumulate((r["n"] for r in sizes), initial=0)
    offsets = spark.createDataFrame([(r["part"], s) for r, s in zip(sizes, starts)], "part int, _start long")
    columns = [c.split()[0] for c in BLOCKS.split(", ")]
    decoded = blocks.select(*columns).mapInArrow(documents, READ)
    return decoded.join(F.broadcast(offsets), "part").select(
        "part", "place", "doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )


@query("op10_token_files")
def op10(spark, folder):
    from public_tokenizers import path

    out = new_folder(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), out, path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")
