"""Token counts of whole texts: each distinct pre-token is counted once, and documents sum what they hold of each.

Documents are taken in blocks of bounded size. A block names each of its pre-tokens once and keeps which document holds which
how often. Both are written once: the frequencies as numbers, the pre-tokens dealt by hash into ranges, one compressed row for each
range of a block. Only the pre-tokens are shuffled, to the task of their range, where those that several blocks name
are counted once; their counts go back to the block as small numbers in the same order. A pre-token that all documents hold
is one entry per block, so none is hot; no ids are kept.

Pre-tokens are those of the tokenizer: words, where it parts at ASCII white space (``tokens.ids_per_word`` tries it), else what its
normalizer and pre-tokenizer make of a text. A text that holds the string of one of its added tokens is a pre-token as a whole there.
A range has room for ``tokens.WORDS_KEPT`` pre-tokens; ranges go with ``spark.sql.shuffle.partitions``, and one that holds more
counts some of them again. Files of other libraries (``.model``) are an error.

NULL and empty texts have no tokens. Every row, repeated or without a doc_id, has a row in the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from medweave.llm.common import query, settle_texts, table

BLOCK_BYTES, BLOCK_DOCS = 32 << 20, 1 << 16  # a block is closed when it reaches either
RANGES_PER_TASK = 4
BLOCKS = "block long, range int, data binary, ids array<long>, sizes array<long>"
RESULT = "doc_id long, n_bytes long, n_tokens long"


def packed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack_words(words: list[bytes]) -> bytes:
    import numpy as np

    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return packed(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    import numpy as np
    import pyarrow as pa

    data = unpacked(data)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint32, n, 4))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data[4 + 4 * n :])]).to_pylist()


@cache
def pre_tokens(path: str) -> tuple[Callable[[bytes], list[bytes]], Callable[[list[bytes]], list[int]]]:
    """For a tokenizer: what parts a text, and what counts the tokens of distinct parts."""
    from medweave.llm.tokens import WORDS_KEPT, encoder

    if not path.endswith(".json"):
        raise ValueError("only tokenizers of the tokenizers library (.json) are counted")
    own = encoder(path)
    if own.by_word:
        return bytes.split, lambda words: [len(ids) >> 2 for ids in own.encode(words)]
    library, known = own.tokenizer, {}
    added = [t.content for t in library.get_added_tokens_decoder().values()]

    def parts(text: bytes) -> list[bytes]:
        plain = text.decode()
        if not plain:
            return []
        shaped = library.normalizer.normalize_str(plain) if library.normalizer else plain
        if library.pre_tokenizer is None or any(a in plain or a in shaped for a in added):
            return [b"\x01" + text]
        return [b"\x02" + p.encode() for p, _ in library.pre_tokenizer.pre_tokenize_str(shaped)]

    def one(part: bytes) -> int:
        text = part[1:].decode()
        return len(library.encode(text, add_special_tokens=False).ids if part[0] == 1 else library.model.tokenize(text))

    def count(words: list[bytes]) -> list[int]:
        if len(known) + len(words) > WORDS_KEPT:
            known.clear()
        known.update((w, one(w)) for w in words if w not in known)
        return [known[w] for w in words]

    return parts, count


class Block:
    """Frequencies of the pre-tokens of some documents."""

    def __init__(self) -> None:
        self.words, self.ids, self.sizes, self.n_bytes, self.found = {}, [], [], 0, []

    def add(self, doc_id: int | None, text: bytes, parts: Callable[[bytes], list[bytes]]) -> None:
        import numpy as np

        words, held = self.words, parts(text)
        at, n = np.unique(np.fromiter((words.setdefault(w, len(words)) for w in held), np.uint32, len(held)), return_counts=True)
        over = -(-n // 255)  # a count is written in one byte; greater ones take several entries
        times = np.full(int(over.sum()), 255, np.uint8)
        times[np.cumsum(over) - 1] = n - 255 * (over - 1)
        self.found.append((np.repeat(at, over), times))
        self.ids.append(doc_id)
        self.sizes.append(len(text))
        self.n_bytes += len(text)

    def full(self) -> bool:
        return self.n_bytes >= BLOCK_BYTES or len(self.ids) >= BLOCK_DOCS

    def rows(self, block: int, ranges: int) -> Iterator[dict]:
        """One row with the pre-tokens of each range; one, without a range, with the documents and what they hold, by place among all these."""
        import numpy as np

        words = list(self.words)
        of = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(ranges)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(ranges + 1))
        for k in range(ranges):
            own = order[cuts[k] : cuts[k + 1]]
            if len(own):
                yield {"block": block, "range": k, "data": pack_words([words[i] for i in own])}
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        at, times = (np.concatenate(c) for c in zip(*self.found, strict=True))
        lengths = np.array([len(t) for _, t in self.found], np.uint32)
        bytewise = np.ascontiguousarray(place[at].view(np.uint8).reshape(-1, 4).T)  # equal high bytes side by side
        yield {"block": block, "range": None, "data": packed(lengths.tobytes() + times.tobytes() + bytewise.tobytes()), "ids": self.ids, "sizes": self.sizes}


def blocks(docs: DataFrame, tokenizer: str, ranges: int) -> DataFrame:
    """The blocks of ``docs``, written once, so that a block is the same for all who read it."""

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
        parts, _ = pre_tokens(tokenizer)
        block, number = Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                block.add(doc_id, text.as_py() or b"", parts)
                if block.full():
                    for row in block.rows(number, ranges):
                        yield pa.RecordBatch.from_pylist([row], schema)
                    block, number = Block(), number + 1
        if block.ids:
            for row in block.rows(number, ranges):
                yield pa.RecordBatch.from_pylist([row], schema)

    return settle_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(made, BLOCKS))


def counted(words: DataFrame, tokenizer: str, tasks: int) -> DataFrame:
    """Rows of pre-tokens with their numbers of tokens instead; a range's rows meet in one task."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        _, sizes = pre_tokens(tokenizer)
        for batch in batches:
            data = [packed(np.array(sizes(unpack_words(d.as_py())), np.uint32).tobytes()) for d in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("range"), pa.array(data, pa.binary())], ["block", "range", "data"])

    spread = words.select("block", "range", "data").repartition(tasks, "range").sortWithinPartitions("range")
    return spread.mapInArrow(count, "block long, range int, data binary")


def sum_block(rows):
    """Token counts of the documents of one block; its size is bounded by BLOCK_BYTES and its longest text."""
    import numpy as np
    import pyarrow as pa

    own = rows.to_pylist()
    head = next(r for r in own if r["range"] is None)
    counts = [np.frombuffer(unpacked(r["data"]), np.uint32) for r in sorted((r for r in own if r["range"] is not None), key=lambda r: r["range"])]
    data, docs = unpacked(head["data"]), len(head["ids"])
    lengths = np.frombuffer(data, np.uint32, docs)
    n = int(lengths.sum())
    times = np.frombuffer(data, np.uint8, n, 4 * docs)
    at = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, 4 * docs + n).reshape(4, n).T).view(np.uint32).reshape(-1)
    tokens = np.concatenate(counts).astype(np.int64)[at] * times if n else np.empty(0, np.int64)
    ends = np.cumsum(np.concatenate([[0], tokens]))[np.cumsum(np.concatenate([[0], lengths])).astype(np.int64)]
    return pa.table([pa.array(head["ids"], pa.int64()), pa.array(head["sizes"], pa.int64()), pa.array(np.diff(ends))], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row of ``docs``."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: learning words takes time, not bytes
    made = blocks(docs, tokenizer, RANGES_PER_TASK * tasks)
    counts = counted(made.where(F.col("range").isNotNull()), tokenizer, tasks).withColumns({c: F.lit(None).cast("array<long>") for c in ("ids", "sizes")})
    return made.where(F.col("range").isNull()).unionByName(counts).groupBy("block").applyInArrow(sum_block, RESULT)


@query("op8_token_counts")
def op8(spark, folder):
    from public_tokenizers import path

    return count_tokens(table(spark, folder, "documents"), path("word_bpe_49k.json")).withColumn("over_limit", F.col("n_tokens") > 2048)
