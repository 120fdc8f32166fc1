"""Byte-level BPE over a segment tree of adjacent pair ranks, and its decoding.

A pre-token starts as its bytes. A segment tree has one leaf per position, worth (rank of the pair that begins there,
position), and every node the least of its children: the root names the leftmost pair of the lowest rank. That pair
is merged, the leaves of at most three positions change, and only their paths to the root are made anew; a pre-token
is done when the root holds no rank. Short pre-tokens of equal tree size are merged in step with numpy, one merge of
each at a time; long ones (a text without spaces is one pre-token) one by one, in n log n steps.

A worker merges each distinct pre-token once and keeps it in a table bounded in entries and bytes. Texts are cut at
the tokenizer's added tokens, then into pre-tokens: by one pattern where all characters are below U+0250, by the
library's own pre-tokenizer elsewhere, whose character classes are those of another Unicode version.

NULL and empty texts have no ids and decode to the empty text. Rows without a doc_id and repeated rows stay rows.
Ids that are not of the vocabulary decode to nothing, bytes that are not UTF-8 to U+FFFD.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

from pyspark.sql import DataFrame, functions as F

from medweave.llm.common import query, table

SHORT = 64  # bytes of a pre-token that is merged in step with others
STEP_BYTES = 2 << 20  # bytes of pre-tokens that are merged in step
KEPT_WORDS, KEPT_BYTES = 250_000, 16 << 20  # a worker's table is emptied at either
RUN_CHARS = 1 << 20  # characters of texts whose new pre-tokens are merged together
OUT_BYTES = 4 << 20  # bytes of ids in one batch of results
NO_RANK = 1 << 40
ENCODED, DECODED = "doc_id long, ids array<int>", "doc_id long, ids array<int>, text string"


def word_pattern(below: int = 0x250) -> re.Pattern:
    """Contractions, words, numbers, other signs with a space before them, and runs of white space, for characters ``below``."""
    chars = [chr(c) for c in range(below)]
    # Python's \s has the four separators U+001C to U+001F besides the characters with the White_Space property.
    space = [c for c in chars if c.isspace() and not "\x1c" <= c <= "\x1f"]
    kind = lambda first: "".join(map(re.escape, (c for c in chars if unicodedata.category(c)[0] == first)))
    s, letters, numbers = "".join(map(re.escape, space)), kind("L"), kind("N")
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{s}{letters}{numbers}]+|[{s}]+(?![^{s}])|[{s}]+")


class Bpe:
    """Encoder and decoder of a byte-level BPE file."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS, kept_bytes: int = KEPT_BYTES) -> None:
        import numpy as np

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.path, self.kept_words, self.kept_bytes = path, kept_words, kept_bytes
        vocab = model["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        pieces = {i: bytes(byte_of[c] for c in piece) for piece, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.byte_ids = [vocab[c] for c in byte_letters()]
        self.words = word_pattern()
        keys = np.array(list(self.ranks), np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks, self.made_ids = keys[order], order.astype(np.int64), np.array(self.made, np.int32)
        self.first = np.array([[self.ranks.get(a << 20 | b, NO_RANK) for b in self.byte_ids] for a in self.byte_ids], np.int64)
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or not re.search("[^\0-ɏ]", text):
            return self.words.findall(text)
        from medweave.llm.tokens import library

        return [text[a:b] for _, (a, b) in library(self.path).pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, as 32-bit integers of this machine."""
        run, size = [], 0
        for text in texts:
            run.append(text or "")
            size += len(run[-1])
            if size >= RUN_CHARS:
                yield from self._run(run)
                run, size = [], 0
        yield from self._run(run)

    def _run(self, run: list[str]) -> Iterator[bytes]:
        import numpy as np

        split = []
        for text in run:
            words = []
            for part in self.specials.split(text) if self.specials else [text]:
                if part in self.added:
                    words.append(part)
                elif part:
                    words += self.pre_tokens(part)
            split.append(words)
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > self.kept_words or self.known_bytes > self.kept_bytes:
            self.known, self.known_bytes = {}, 0
            new = set().union(*split)
        for s in new & self.added.keys():
            self.known[s] = np.int32(self.added[s]).tobytes()
        new = list(new - self.added.keys())
        for word, ids in zip(new, self.merge([w.encode() for w in new]), strict=True):
            self.known[word] = ids
            self.known_bytes += len(word) + len(ids)
        known = self.known.__getitem__
        for words in split:
            yield b"".join(map(known, words))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, in their order."""
        import numpy as np

        out: list[bytes] = [b""] * len(words)
        sizes: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if len(word) > SHORT:
                out[k] = np.array(self.merge_long(word), np.int32).tobytes()
            elif word:
                sizes.setdefault(1 << max(1, (len(word) - 1).bit_length()), []).append(k)
        for width, own in sizes.items():
            step = max(1, STEP_BYTES // (width * 8))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                for k, ids in zip(part, self.merge_short([words[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def rank_of(self, left, right):
        import numpy as np

        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NO_RANK)

    def merge_short(self, words: list[bytes], width: int) -> list[bytes]:
        """Pre-tokens of at most ``width`` bytes (a power of two), all one merge further at a time."""
        import numpy as np

        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = np.array(self.byte_ids, np.int32)[text]
        place = np.arange(width)
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        alive = place < length[:, None]
        tree = np.full((n, 2 * width), NO_RANK * width, np.int64)
        rank = self.first[text[:, :-1], text[:, 1:]]
        rank[place[1:] >= length[:, None]] = NO_RANK
        tree[:, width : 2 * width - 1] = rank * width + place[:-1]
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        active = np.flatnonzero(tree[:, 1] < NO_RANK * width)
        while len(active):
            root = tree[active, 1]
            at = root % width  # leftmost place of the lowest rank
            made = self.made_ids[root // width]
            gone = after[active, at]
            then = after[active, gone]
            ids[active, at] = made
            after[active, at], alive[active, gone] = then, False
            inside = then < length[active]
            before[active[inside], then[inside]] = at[inside]
            tree[active, width + gone] = NO_RANK * width
            right = np.where(inside, self.rank_of(made, ids[active, np.minimum(then, width - 1)]), NO_RANK)
            tree[active, width + at] = right * width + at
            prior = before[active, at]
            has = prior >= 0
            prior = np.maximum(prior, 0)
            left = self.rank_of(ids[active, prior], made)
            tree[active[has], width + prior[has]] = left[has] * width + prior[has]
            row, path = active[:, None], np.stack([at, gone, np.where(has, prior, at)], 1) + width
            while path[0, 0] > 1:
                path >>= 1
                tree[row, path] = np.minimum(tree[row, 2 * path], tree[row, 2 * path + 1])
            active = active[tree[active, 1] < NO_RANK * width]
        flat, ends = ids[alive].tobytes(), np.concatenate([[0], np.cumsum(alive.sum(axis=1))]) * 4
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def merge_long(self, word: bytes) -> list[int]:
        n = len(word)
        width = 1 << (n - 1).bit_length()
        ids, ranks = [self.byte_ids[b] for b in word], self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = NO_RANK * width
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = ranks.get(ids[i] << 20 | ids[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, j: int) -> None:
            """The leaf of place ``i``, whose right neighbour is ``j`` (``n`` or beyond: none), and its path."""
            r = ranks.get(ids[i] << 20 | ids[j]) if j < n else None
            node, value = width + i, none if r is None else r * width + i
            while node and tree[node] != value:
                tree[node] = value
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1]) if node else 0

        while tree[1] < none:
            i = tree[1] % width
            j = after[i]
            ids[i] = self.made[tree[1] // width]
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, n)
            put(i, after[i])
            if before[i] >= 0:
                put(before[i], i)
            ids[j] = -1
        return [i for i in ids if i >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids if 0 <= i < len(pieces)]).decode(errors="replace")


def byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in own else chr(next(others)) for b in range(256))


@cache
def bpe(path: str) -> Bpe:
    """The one of this Python process."""
    return Bpe(path)


def encode_documents(docs: DataFrame, tokenizer: str, decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` of the whole ``text`` of every row of ``docs``; with ``decoded`` also the ``text`` that the ids stand for."""

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = bpe(tokenizer)

        def made(doc_ids, packed):
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            flat = np.frombuffer(b"".join(packed), np.int32)
            columns = [doc_ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            if decoded:
                columns.append(pa.array((own.decode(np.frombuffer(p, np.int32).tolist()) for p in packed), pa.string(), size=len(packed)))
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

        for batch in batches:
            doc_ids, packed, size, done = batch.column("doc_id"), [], 0, 0
            for ids in own.encode(t.as_py() for t in batch.column("text")):
                packed.append(ids)
                size += len(ids)
                if size >= OUT_BYTES:
                    yield made(doc_ids.slice(done, len(packed)), packed)
                    packed, size, done = [], 0, done + len(packed)
            yield made(doc_ids.slice(done), packed)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, DECODED if decoded else ENCODED)


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id``, ``ids`` and the ``text`` they stand for; NULL ids are none."""

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = bpe(tokenizer)
        for batch in batches:
            texts = [own.decode(ids.values.to_pylist() if ids.is_valid else ()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(decode, DECODED)


@query("op13_bpe")
def op13(spark, folder):
    from public_tokenizers import path

    tokenizer = path("byte_bpe_50k.json")
    back = encode_documents(table(spark, folder, "documents"), tokenizer, decoded=True)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )
