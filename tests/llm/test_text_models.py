"""Near duplicates, nearest neighbours, token counts, sampled pieces, language and the pipeline against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

import corpus_pipeline
from medweave.llm import language_id, line_dedup, near_dedup, packing, piece_sampling, quality_rules, token_counts, vp_tree
from medweave.llm.common import BATCH_ROWS, small_batches
from medweave.llm.queries import QUERIES
from medweave.llm.tokens import library
from medweave.session import settle

FOLDER = "/root/testdata/sf0.001"
WORD, PIECE = path("word_bpe_49k.json"), path("piece_bpe_32k.model")


def documents(spark, folder=FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet")


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows, width):
    """component of each (doc_id, text); rows without a doc_id have none."""
    sets = {}
    for r in rows:
        if r["doc_id"] is not None:
            sets[r["doc_id"]] = shingle_set(r["text"], width)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    for d in sorted(sets):
        shared = Counter(o for s in sets[d] for o in holders[s] if o > d)
        for o, n in shared.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[o]) - n):
                a, b = sorted((find(d), find(o)))
                parent[b] = a
    return {d: find(d) for d in sets}


def check_near(docs, width):
    rows = docs.collect()
    got, want = near_dedup.near_duplicates(docs, width).collect(), brute_components(rows, width)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])
    sizes = Counter((r["doc_id"], len(shingle_set(r["text"], width))) for r in rows)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    return got


@pytest.mark.parametrize("width", [4, 5])
def test_near(spark, width):
    check_near(documents(spark), width)


def test_near_groups(spark):
    """A group of near copies whose members are not all alike, and a chain of which only neighbours are."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(60):
        words = list(base)
        words[int(rng.integers(0, 60))] = f"new{d}"
        words[60 + int(rng.integers(0, 60))] = f"other{d}"
        rows.append((d, " ".join(words)))
    rows += [(100 + k, " ".join(f"c{j}" for j in range(3 * k, 3 * k + 60))) for k in range(30)]
    rows += [(200, "one two"), (201, "ONE\ttwo"), (202, "two one"), (203, ""), (204, None), (205, " ")]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), 4)


def test_near_odd(spark, odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count() and all(r["kept"] for r in got if r["doc_id"] is None)
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert near_dedup.near_duplicates(none).collect() == [] and near_dedup.drop_near_duplicates(none).collect() == []


def test_near_two_texts_of_an_id(spark):
    """Two equally long texts under one doc_id, one of common shingles and one of rare ones: what is like the first meets it in the last comparison."""
    first, rare = list(range(100)), list(range(1000, 1100))
    like, others = [*range(90), *range(2000, 2010)], [[*range(100), *range(3000 + 100 * k, 3090 + 100 * k)] for k in range(4)]
    sets = spark.createDataFrame([(1, first), (1, rare), (2, like), *[(10 + k, o) for k, o in enumerate(others)]], "rep long, shingles array<long>")
    # the bucket's main component is that of the four others
    opened = spark.createDataFrame([(7, 1, 1), (7, 2, 2), *[(7, 10 + k, 10) for k in range(4)]], "key long, rep long, label long")
    pairs = near_dedup.across(opened, sets, 80)
    assert (1, 2) in {tuple(r) for r in pairs.collect()}
    assert {tuple(r) for r in near_dedup.confirmed(pairs, sets, 80).collect()} == {(1, 2)}


def test_near_group_proposes_few_pairs(spark):
    """Classes of one bucket that lack different shingles of a common text: only pairs that can be similar enough are proposed, and all that are."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, 200)
    held = {k: set(np.delete(base, rng.choice(200, 30, replace=False)).tolist()) for k in range(60)}
    held |= {60 + k: set(sorted(held[k])[3:]) for k in range(5)}  # much like one of them
    sets = spark.createDataFrame([(k, sorted(s)) for k, s in held.items()], "rep long, shingles array<long>")
    opened = spark.createDataFrame([(7, k, k) for k in held], "key long, rep long, label long")
    got = {tuple(r) for r in near_dedup.across(opened, sets, 80).collect()}
    alike = {(a, b) for a in held for b in held if a < b and 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b])}
    # the bucket's main component is one of the classes; its pairs are met from the other side
    assert len(alike) >= 5 and alike <= got and len(got) < 300


def brute_nearest(rows, k):
    rows = [r for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    if not rows:
        return set()
    d = max(Counter(len(v) for _, v in rows).items(), key=lambda c: (c[1], c[0]))[0]
    rows = [(i, np.array(v, np.float64)) for i, v in rows if len(v) == d]
    out = set()
    for q, v in rows:
        if q % 50 == 0:
            scored = sorted((-((v * w).sum() / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in rows if i != q)
            out |= {(q, n + 1, i) for n, (_, i) in enumerate(scored[:k])}
    return out


VECTORS = "vec_id long, embedding array<float>, label int, shard int, v int, score double"


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(700)] + [(i, [1.0, 2.0, 0.0, 1.0, 0.0, 0.0]) for i in range(700, 1100)]
    rows += [(1150, None), (1200, [0.0] * 6), (1250, [1.0] * 5 + [None]), (1300, [float("nan")] * 6), (1350, [float("inf")] + [1.0] * 5), (1400, [1.0] * 3), (None, [1.0] * 6), (1450, [])]
    df = spark.createDataFrame([(*r, 1, 1, 1, 1.0) for r in rows], VECTORS)
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in vp_tree.nearest(df, F.col("vec_id") % 50 == 0, factor=1.0).collect()}
    assert got == brute_nearest(rows, 5)
    few = df.where("vec_id in (0, 1, 2)")
    assert len(vp_tree.nearest(few, F.col("vec_id") == 0).collect()) == 2
    assert vp_tree.nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in df.collect()], 5)
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in vp_tree.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    assert len(got & want) >= 0.9 * len(want)


def brute_counts(docs, tokenizer):
    ids = lambda text: library(tokenizer).encode(text or "", add_special_tokens=False).ids
    return Counter((r["doc_id"], len((r["text"] or "").encode()), len(ids(r["text"]))) for r in docs.collect())


@pytest.mark.parametrize("tokenizer", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts(spark, odd, none, tokenizer):
    for docs in (odd, documents(spark)):
        assert Counter(map(tuple, token_counts.count_tokens(docs, path(tokenizer)).collect())) == brute_counts(docs, path(tokenizer))
    assert token_counts.count_tokens(none, path(tokenizer)).collect() == []


def test_counts_of_words_in_all_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 2000)  # local tasks are forked with it
    docs = spark.range(0, 3000, 1, 4).selectExpr("id AS doc_id", "concat('the the ', repeat('again ', cast(id % 600 AS int)), 'w', id, if(id % 7 = 0, '', ' ünd')) AS text")
    assert Counter(map(tuple, token_counts.count_tokens(docs, WORD).collect())) == brute_counts(docs, WORD)
    made = token_counts.blocks(docs, WORD, 8)
    assert made.select("block", "range").distinct().count() == made.count()
    with pytest.raises(ValueError):
        token_counts.pre_tokens("other.model")


def test_counts_as_registered(spark):
    got = QUERIES["op8_token_counts"](spark, FOLDER)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert Counter(map(tuple, got.collect())) == Counter({(*k, k[2] > 2048): n for k, n in brute_counts(documents(spark), WORD).items()})


def test_pieces(spark, odd, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    made = settle(piece_sampling.encode_sampled(odd, PIECE, F.col("doc_id"), result="drawn"))
    rows = made.withColumn("back", piece_sampling.decode(F.col("drawn"), PIECE)).collect()
    assert all(r["back"] == (r["text"] or "") for r in rows) and len(rows) == odd.count()
    for r in rows:
        if r["text"] and r["text"].strip(" ") == r["text"]:
            assert model.decode(np.frombuffer(r["drawn"], "<u4").tolist()) == r["text"]
    again = piece_sampling.encode_sampled(odd.repartition(5), PIECE, F.col("doc_id"), result="drawn")
    assert Counter((r["doc_id"], bytes(r["drawn"])) for r in again.collect()) == Counter((r["doc_id"], bytes(r["drawn"])) for r in rows)
    assert piece_sampling.encode_sampled(none, PIECE, F.col("doc_id")).collect() == []


def test_odd_texts_stay_whole():
    own = piece_sampling.lattices(PIECE, piece_sampling.WEIGHT)
    texts = ["a  b\n c ▁ x é語😀  ", " ", "", "▁", "￾<0x41><s> </s>", "x" * 3000]
    for ids, text in zip(piece_sampling.sample(own, [1] * len(texts), texts), texts, strict=True):
        assert b"".join(own.bytes_of[i] for i in ids)[1:].decode() == text


def all_paths(own, text):
    """Every segmentation of ``text`` into pieces, with the sum of its scores."""
    if not text:
        return {(): 0.0}
    out = {}
    for k in range(1, min(len(text), own.longest) + 1):
        if text[:k] in own.pieces:
            piece, score = own.pieces[text[:k]]
            for rest, weight in all_paths(own, text[k:]).items():
                out[(piece, *rest)] = weight + score
    return out


def lattice_paths(own, node):
    """Every way back from ``node`` to the start, with its probability."""
    if node < 0:
        return {(): 1.0}
    cumulative, out, so_far = np.array(own.cumulative), {}, 0.0
    begin = np.searchsorted(cumulative, node, side="right")
    for edge in range(begin, np.searchsorted(cumulative, node + 1) + 1):  # what is less likely than a sum can hold is not met
        p, so_far = cumulative[edge] - node - so_far, cumulative[edge] - node
        for before, q in lattice_paths(own, own.back[edge]).items():
            out[(*before, own.piece[edge])] = p * q
    return out


@pytest.mark.parametrize("weight", [0.0, 0.00001, 0.001])
def test_words_filtered_together_have_all_their_segmentations(weight):
    own, one = (piece_sampling.Lattices(PIECE, weight) for _ in range(2))
    words = [" the", " abc", "x", " zzzz", "the s", " lower", " flower", "  a", " Straße", " été", "語 a", "a▁b", "b😀c", " tower", " a\nbc\t", " " * 70]
    ends = own.ends(words)
    for word, node in list(zip(words, ends, strict=True))[:-1]:
        got, alone = lattice_paths(own, node), lattice_paths(one, one.add(word))
        assert all(abs(alone.get(k, 0) - got.get(k, 0)) < 1e-9 for k in alone | got)
        if all(c in own.pieces for c in word.replace(" ", "▁")) and "▁" not in word:
            want = all_paths(own, word.replace(" ", "▁"))
            want = {k: np.exp(v - max(want.values())) for k, v in want.items()}
            whole = sum(want.values())
            assert all(abs(got.get(k, 0) - want.get(k, 0) / whole) < 1e-9 for k in want | got)
            assert weight or got.keys() == want.keys()
    assert own.ends(words) == ends  # kept, not filtered again


def test_words_of_all_lengths_are_filtered_in_one_go(monkeypatch):
    """Batches go by characters, not by the length of words; every node knows its first edge, and the draws are those of a search over all."""
    own, one = (piece_sampling.Lattices(PIECE, 0.0002) for _ in range(2))
    calls, together = [], own.add_together
    monkeypatch.setattr(own, "add_together", lambda codes, sizes: calls.append(len(sizes)) or together(codes, sizes))
    words = [" " + "thenéabc"[k % 7 :] * (k // 8) + "x" * (k % 5) + f"w{k}" for k in range(200)]
    distinct = {w for w in words if len(w) <= piece_sampling.LONGEST_TOGETHER}
    node = own.ends(words)
    assert calls == [len(distinct)]
    cumulative = np.array(own.cumulative)
    assert len(own.first) == own.nodes and (cumulative[np.array(own.first)[1:] - 1] == np.arange(1, own.nodes)).all()  # where the one before ends
    for word, end in [(w, e) for w, e in zip(words, node, strict=True) if len(w) <= 12]:
        got, alone = lattice_paths(own, end), lattice_paths(one, one.add(word))
        assert all(abs(alone.get(k, 0) - got.get(k, 0)) < 1e-9 for k in alone | got)

    def searched(key, text):
        """Pieces by bisection over the edges of all nodes."""
        ids = []
        for place, word in enumerate(piece_sampling.units(text)):
            at, step, drawn = own.ends([word])[0], 0, []
            start = piece_sampling.mixed(np.array([key], np.uint64) + piece_sampling.mixed(np.array([place], np.uint64)))
            while at >= 0:
                u = float(piece_sampling.mixed(start + np.uint64(step))[0] >> np.uint64(34)) / (1 << 30)
                edge = np.searchsorted(np.array(own.cumulative), at + u, side="right")
                drawn.append(own.piece[edge])
                at, step = own.back[edge], step + 1
            ids += drawn[::-1]
        return ids

    texts = ["".join(words[k : k + 6])[1:] for k in range(0, 60, 6)]
    keys = [3 * k + 1 for k in range(len(texts))]
    assert [i.tolist() for i in piece_sampling.sample(own, keys, texts)] == [searched(k, t) for k, t in zip(keys, texts, strict=True)]


def test_draws_follow_the_lattice():
    """Shares of each segmentation of a word are those of the exponential of its summed scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    own, n = piece_sampling.Lattices(PIECE, 0.0002), 20_000
    got = Counter(tuple(ids.tolist()) for ids in piece_sampling.sample(own, list(range(n)), ["then"] * n))
    weight = {ids: np.exp(0.0002 * sum(model.get_score(i) for i in ids)) for ids in got}
    whole = sum(weight.values())
    for ids, w in weight.items():
        assert abs(got[ids] / n - w / whole) < 5 * np.sqrt(w / whole / n) + 1 / n


def test_language(spark, odd, none):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = language_id.learn(docs)
    told = language_id.identify(docs, model).where(language_id.held_out(F.col("doc_id"))).select("doc_id", "lang", "text", "language").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in told)
    sure = [r for r in told if r["language"]["lang"] != "und"]
    assert sum(r["language"]["lang"] == r["lang"] for r in sure) >= 0.97 * len(sure)
    kept = language_id.keep_known(odd, model)
    assert kept.columns == odd.columns
    for r in language_id.identify(odd, model).collect():
        assert (r["language"]["lang"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["language"]["score"] <= 1
    empty = language_id.learn(none)
    assert {r["language"]["lang"] for r in language_id.identify(odd, empty).collect()} == {"und"}
    assert language_id.identify(none, model).collect() == []


def test_language_not_known(spark):
    """Texts in languages that were not learned, letter noise, half and half, and numbers with a letter go; clean ones stay."""
    docs, rng = documents(spark, "/root/testdata/sf0.01"), np.random.default_rng(7)
    noise = lambda n: " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 10)))) for _ in range(n))
    fr, es = ((docs.where((F.col("lang") == lang) & (F.length("text") > 1000)).orderBy("doc_id").first()["text"])[:500] for lang in ("fr", "es"))
    texts = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        noise(5), noise(50), noise(500), "12 34 a 56 78 " * 30, f"{fr}\n{es}",
    ]
    planted = spark.createDataFrame([(10_000_000 + k, text) for k, text in enumerate(texts)], "doc_id long, text string")
    all_of = docs.unionByName(planted, allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, all_of, FOLDER).collect()}
    assert not {d for d in kept if d >= 10_000_000}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    two = docs.where("lang in ('de', 'en')")
    assert {language_id.learn(two).predict(t)[1] < 0.5 for t in (*texts[:-1], fr)} == {True}
    one = language_id.learn(docs.where("lang = 'fr'"))
    assert one.predict(fr)[1] >= 0.5 > one.predict(noise(50))[1] and one.predict(texts[0])[0] == "fr"


def test_pipeline_hands_out_small_batches(spark):
    """Python workers get few whole texts at a time, and an encoder with little room gives the same pieces."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    try:
        for wide in ("10000", "0"):
            spark.conf.set(setting, wide)
            corpus_pipeline.without_near_copies(spark, documents(spark).limit(3), FOLDER)
            assert max(r["n"] for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()) <= BATCH_ROWS
        spark.conf.set(setting, "7")
        small_batches(spark)
        assert spark.conf.get(setting) == "7"  # what is less stays
    finally:
        spark.conf.set(setting, before)
    rows = lambda kept: {tuple(r) for r in packing.cut(documents(spark), WORD, keep_ids=False, words_kept=kept).drop("part", "nth").collect()}
    assert rows(50) == rows(1_000_000)


def test_pipeline(spark):
    docs, kept = documents(spark), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, FOLDER))
        kept.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == before.columns
        if name == "language_id":
            model = language_id.learn(before)
            want = {r["doc_id"] for r in before.collect() if (m := model.predict(r["text"]))[0] != "und" and m[1] >= 0.5}
            assert {r["doc_id"] for r in docs.collect()} == want
        elif name == "quality_rules":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
            want = quality_rules.rule_verdicts(before, labels)[0].where("kept")
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in want.collect()}
        elif name == "line_dedup":
            rows, holders = before.collect(), defaultdict(set)
            key = lambda x: line_dedup.line_key(x.encode(), 40)
            for r in rows:
                for x in (r["text"] or "").split("\n"):
                    holders[key(x)].add(r["doc_id"])
            lost = {k: max(v) for k, v in holders.items() if k is not None and len(v) >= 5}
            want = {r["doc_id"]: "\n".join(x for x in (r["text"] or "").split("\n") if lost.get(key(x), r["doc_id"]) == r["doc_id"]) for r in rows}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        elif name == "near_dedup":
            want = brute_components(before.collect(), 5)
            assert {r["doc_id"] for r in docs.collect()} == {d for d, c in want.items() if d == c}
        else:
            rows = docs.collect()
            assert sum(r["length"] for r in rows) == sum(len(library(WORD).encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.collect())
            spans = defaultdict(int)
            for r in rows:
                spans[r["sequence_id"]] += r["length"]
            assert max(spans.values()) <= 2048 and len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) == packing.pack_documents(before, WORD).count()
    assert 0 < kept[3] <= kept[1] <= kept[0] and kept[2] == kept[1]


def test_draws_are_made_once_a_row(spark):
    """Spark copied the call that draws into the call that decodes, so that every row was drawn twice."""
    calls = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "ArrowEvalPython" in line]
    (line,) = calls(QUERIES["op9_sampled_pieces"](spark, FOLDER))
    assert line.count("encode(") == 1
    odd = spark.createDataFrame([(1, "once  upon a time\n", 5), (2, None, 6), (None, "", 7), (2, "é\u2581中 x", 8)], "doc_id long, text string, _drawn long")
    made = piece_sampling.encode_sampled(odd, PIECE, F.col("doc_id"), decoded="back")
    chained = piece_sampling.encode_sampled(odd, PIECE, F.col("doc_id")).withColumn("back", piece_sampling.decode(F.col("ids"), PIECE))
    assert sum(line.count(" encode(") + line.count("[encode(") for line in calls(chained)) == 1
    assert made.columns == chained.columns == ["doc_id", "text", "_drawn", "ids", "back"]
    rows = made.collect()
    assert Counter(rows) == Counter(chained.collect()) and all(r["back"] == (r["text"] or "") for r in rows)


def test_text_that_fills_a_run_may_end_its_batch(spark):
    """The empty run behind it was drawn as one row more than the batch had."""
    text = "as many words as fill a run " * (piece_sampling.BATCH_BYTES // 28 + 1)
    docs = spark.createDataFrame([(1, "a few words"), (2, text)], "doc_id long, text string").coalesce(1)
    rows = piece_sampling.encode_sampled(docs, PIECE, F.col("doc_id"), decoded="back").select("doc_id", "text", "back").collect()
    assert [r["doc_id"] for r in rows] == [1, 2] and all(r["back"] == r["text"] for r in rows)
    own = piece_sampling.lattices(PIECE, piece_sampling.WEIGHT)
    assert piece_sampling.sample(own, [], []) == [] and list(piece_sampling.in_runs([], [])) == []
