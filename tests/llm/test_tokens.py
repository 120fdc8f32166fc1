"""Packing and token files against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from public_tokenizers import path

from medweave.llm import huffman, packing, token_files
from medweave.llm.tokens import Encoder, library, pack
from medweave.session import new_folder, settle

WORD = path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


def plain(text, tokenizer=WORD):
    return library(tokenizer).encode(text or "", add_special_tokens=False).ids


ENCODERS = {name: Encoder(path(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAé'.,1 \n\t\x1c\x85<|>endoftextstar"))), max_size=4))
def test_encoder(texts):
    for name, own in ENCODERS.items():
        assert list(own.encode([t.encode() for t in texts])) == [pack(plain(t, path(name))) for t in texts]


def test_encoder_forgets():
    small = Encoder(WORD, words_kept=3)
    texts = ["one two three four", "five, six", "one's five", "", None, "<|endoftext|>x one"]
    assert list(small.encode([t and t.encode() for t in texts], 8)) == [pack(plain(t)) for t in texts]


def brute_pieces(rows, capacity):
    out = []
    for r in rows:
        ids = [*plain(r["text"]), 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            out.append((r["doc_id"], k, at, len(own), zlib.crc32(pack(own))))
    return Counter(out)


def check_packed(rows, capacity):
    spans = defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, odd, capacity):
    for docs in (odd, spark.read.parquet(f"{FOLDER}/documents.parquet")):
        got = settle(packing.pack_documents(docs, WORD, capacity))
        rows = got.collect()
        assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == brute_pieces(docs.collect(), capacity)
        used, least = check_packed(rows, capacity), -(-sum(r["length"] for r in rows) // capacity)
        assert used <= least * 1.02 + 1
        whole = packing.sequences(got).collect()
        assert len(whole) == used and all(len(r["ids"]) == 4 * r["length"] <= 4 * capacity for r in whole)


def test_packing_nothing(none):
    assert packing.pack_documents(none, WORD).collect() == []


def test_fullest():
    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 60)
        items, sums = [n for n, c in counts.items() for _ in range(c)], {0}
        for n in items:
            sums |= {s + n for s in sums if s + n <= room}
        got = packing.fullest(counts, room)
        assert all(k <= counts[n] for n, k in got.items())
        assert sum(n * k for n, k in got.items()) == max(sums)


def test_code():
    rng = np.random.default_rng(3)
    for n, limit in ((1, 4), (2, 1), (30, 5), (500, 20), (3000, 12)):
        ids = np.sort(rng.choice(60_000, n, replace=False))
        weights = (rng.pareto(0.4, n) * 10 + 1).astype(np.int64)
        bits = huffman.code_lengths(weights, limit)
        assert bits.max() <= limit and bits.min() >= 1 and sum(2.0**-b for b in bits) <= 1
        code = huffman.Code(ids, bits)
        for size in (0, 1, 255, 256, 5000):
            text = rng.choice(ids, size)
            packed, begins = code.encode(text, 256)
            assert (code.decode(packed, begins, size, 256) == text).all()
            for k in range(1, len(begins)):  # a reader may start at any checkpoint
                assert (code.decode(packed, begins[k:], size - 256 * k, 256) == text[256 * k :]).all()


def test_code_is_optimal():
    """Without a tight limit the mean length is that of the plain Huffman tree."""
    import heapq

    weights = np.random.default_rng(1).integers(1, 1000, 200)
    heap, total = list(map(int, weights)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert int((huffman.code_lengths(weights, 20) * weights).sum()) == total
    with pytest.raises(ValueError):
        huffman.code_lengths(weights, 7)


def test_files(spark, odd):
    for docs, block in ((odd, 40), (spark.read.parquet(f"{FOLDER}/documents.parquet"), 1 << 18)):
        out = new_folder(spark, "tokens")
        token_files.write_tokens(docs, out, WORD, end_id=2, block_ids=block)
        got = token_files.read_tokens(spark, out).orderBy("part", "place").collect()
        want = sorted(((r["doc_id"], [*plain(r["text"]), 2]) for r in docs.collect()), key=lambda w: (w[0] is not None, w[0] or 0))
        assert [r["doc_id"] for r in got] == [w[0] for w in want]
        assert Counter((r["doc_id"], r["ids"]) for r in got) == Counter((w[0], pack(w[1])) for w in want)
        at = 0
        for r in got:
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]) // 4, zlib.crc32(r["ids"]))
            at += r["n_tokens"]


def test_files_of_nothing(spark, none):
    out = new_folder(spark, "tokens")
    token_files.write_tokens(none, out, WORD, end_id=2)
    assert token_files.read_tokens(spark, out).collect() == []


def test_ids_of_a_batch_are_counted_together():
    import numpy as np
    import pyarrow as pa

    from medweave.llm.token_files import counted

    ids = pa.array([np.array(x, t).tobytes() for x, t in (([2, 5, 5], "<u2"), ([], "<u2"), ([70_000, 2], "<u4"), ([2], "<u2"))], pa.binary())
    got = counted(ids, pa.array([3, 0, 2, 1], pa.int64()))
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == {2: 3, 5: 2, 70_000: 1}
    assert not len(np.flatnonzero(counted(ids[:0], pa.array([], pa.int64()))))


def test_encoder_looks_at_known_words_once(monkeypatch):
    """Words that are in the table are not gathered into sets again; a full table is emptied and filled with all words of the run."""
    from public_tokenizers import path

    from medweave.llm import tokens

    own, texts = tokens.Encoder(path("word_bpe_49k.json"), words_kept=6), [b"one two two", None, b"three one, four", b"five six seven one"]
    asked, learn = [], own._learn
    monkeypatch.setattr(own, "_learn", lambda words: (asked.append(sorted(words)), learn(words)))
    plain = [tokens.pack(own.tokenizer.encode((t or b"").decode(), add_special_tokens=False).ids) for t in texts]
    for run_bytes in (1, 1, 1000):
        assert list(own.encode(texts, run_bytes)) == plain
    assert asked[0] == [b"one", b"two"] and len(own.known) <= 10


def test_encoder_asks_the_table_once_a_run():
    """Each distinct word of a run is looked up once, however often and in how many texts it stands; a word of this run outlives a full table."""

    class Counting(dict):
        asked = 0

        def get(self, *key):
            Counting.asked += 1
            return super().get(*key)

    own, texts = Encoder(WORD, words_kept=4), [b"one two " * 500, None, b"", b"  two\tone\x0bthree ", b" \n", b"\x1cone two"]
    own.known = Counting()
    expected = [pack(plain((t or b"").decode())) for t in texts]
    assert list(own.encode(texts)) == expected and Counting.asked <= 6
    own = Encoder(WORD, words_kept=4)
    assert list(own.encode([b"one two three"])) == [pack(plain("one two three"))]
    assert list(own.encode([b"one four five"])) == [pack(plain("one four five"))] and set(own.known) == {b"one", b"four", b"five"}
    assert list(own.encode([])) == [] and list(own.encode([None])) == [b""]
