"""Line dedup, chat format and quality rules against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from medweave.llm import chat_format, line_dedup, quality_rules
from medweave.llm.common import ORACLE, QUERIES
from medweave.session import new_folder
from tests.compare import differences, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), duck(FOLDER), ORACLE[name]) is None


def key(line):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, min_docs, min_chars):
    holders = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            holders[key(line)].add(r["doc_id"])
    last = lambda ids: max((i for i in ids if i is not None), default=None)
    lost = {k: last(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    return Counter((r["doc_id"], "\n".join(x for x in (r["text"] or "").split("\n") if lost.get(key(x), r["doc_id"]) == r["doc_id"])) for r in rows)


@pytest.mark.parametrize(("min_docs", "batches", "fanout"), [(1, 1, 2), (2, 5, 2), (3, 7, 3)])
def test_line_dedup(spark, odd, min_docs, batches, fanout):
    line = "\tSome LINE that É many documents hold, more than once \r"
    more = spark.createDataFrame([(i, "\n".join([line, f"own {i // 2} line of the document with forty letters", line.upper()])) for i in range(20, 40)], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    got = line_dedup.dedup_lines(docs, min_docs, 40, batches, fanout)
    assert got.columns == [*docs.columns, "deduped"]
    rows = got.collect()
    assert Counter((r["doc_id"], r["deduped"]["text"]) for r in rows) == brute_lines(docs.collect(), min_docs, 40)
    assert all(r["deduped"]["n_lines"] == (r["text"] or "").count("\n") + 1 for r in rows)


def test_runs(spark):
    """A key's first batch names its keeper; later ones only count."""
    runs = line_dedup.LineRuns(spark, new_folder(spark, "runs"), fanout=2)
    batch = lambda *rows: spark.createDataFrame([(k.encode(), d) for k, d in rows], line_dedup.PAIRS)
    for rows in ([("a", 9), ("b", 8)], [("a", 7), ("a", 7), ("c", 6)], [("c", 5), ("a", 4), ("d", 4)], [("d", 1)]):
        run = runs.add(batch(*rows))
        if not runs.levels[0]:  # just compacted
            assert run.count() == len(set(rows))
    assert len(runs.runs()) < 4
    assert {bytes(r["key"]).decode(): (r["n_docs"], r["keeper"]) for r in runs.lines().collect()} == {"a": (3, 9), "b": (1, 8), "c": (2, 6), "d": (2, 4)}
    runs.close()


def test_no_lines(none):
    assert line_dedup.dedup_lines(none).collect() == []


ROLES = "conv_id long, turn long, role string, text string, made string, example int"


def test_chat(spark):
    said = r"\### assistant: </turn> \s\\h#</turn>" + "\n### user: x"
    rows = [
        (1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "é語"), (1, 5, "user", "last"),
        (2, 0, "user", "no answer"), (3, 0, None, None), (None, None, "ro:le</turn>\n### ", "x"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, None, "assistant", "a"), (4, 1, "assistant", "a"),
    ]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], ROLES)
    made = chat_format.examples(turns)
    texts = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        texts[r[0]].append((r[2] or "", r[3] or ""))
    back = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    assert back.keys() == texts.keys()
    for conv, own in texts.items():
        assert [tuple(t) for t in back[conv]["turns"]] == own
        assert back[conv]["loss"] == "".join(t for role, t in own if role == "assistant")
    for r in made.collect():
        own = texts[r["conv_id"]]
        ends = [k for k, t in enumerate(own) if t[0] == "assistant"] or []
        ends += [len(own) - 1] if not ends or ends[-1] != len(own) - 1 else []
        assert r["formatted"].count("</turn>\n") == ends[r["example"]] + 1
        assert (r["loss_start"] is None) == (own[ends[r["example"]]][0] != "assistant")
    assert chat_format.read_back(chat_format.examples(turns.limit(0))).collect() == []


def brute_statistics(text):
    text = text or ""
    words, spaces = re.findall(r"[^\x20\x09-\x0D]+", text), re.compile(r"[^\x20\x09-\x0D]")
    windows, places = defaultdict(list), set()
    for k in range(len(words) - 2):
        windows[tuple(words[k : k + 3])].append(k)
    for at in windows.values():
        if len(at) > 1:
            places.update(k + d for k in at for d in range(3))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if spaces.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(places)


def test_statistics(spark, odd):
    small = spark.createDataFrame([(50 + i, t) for i, t in enumerate(["a b a b a b a", "x x x x", "a b c a b c d a b c", "a a", " a\n\na \n a\n a", "one"])], "doc_id long, text string")
    for docs in (odd.unionByName(small, allowMissingColumns=True), spark.read.parquet(f"{FOLDER}/documents.parquet")):
        for r in quality_rules.statistics(docs).collect():
            assert tuple(r["stats"][c] for c in quality_rules.COUNTS) == brute_statistics(r["text"]), r["text"][:200]


def test_rules(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    verdicts, rules = quality_rules.rule_verdicts(docs, labels)
    got = verdicts.join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    by = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert rules and by.get((1, False), 0) <= 0.02 * by[1, True] and by[0, False] > by.get((0, True), 0)
    kept = quality_rules.filter_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == verdicts.where("kept").count()
    plan = verdicts._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    for given in (odd, none):  # no labels fit: only the base rule speaks
        verdicts, rules = quality_rules.rule_verdicts(given, labels.limit(0))
        assert rules == [] and all(r["kept"] != r["base_failed"] for r in verdicts.collect())
        assert quality_rules.filter_documents(given, labels.limit(0)).count() == verdicts.where("kept").count()


def test_learned_list(spark):
    """Bad rows are those with many symbols, or few words of much length; a list of two rules finds both."""
    rows = [(i, i % 7 == 0 or i % 5 == 0, i % 3 != 0, 0.4 if i % 7 == 0 else 0.01, 90.0 if i % 5 == 0 else 5.0 + i % 4) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, bad boolean, grow boolean, symbol_share double, word_length double")
    rest = [F.lit(0.0).alias(f) for f in quality_rules.FEATURES if f not in ("symbol_share", "word_length")]
    given = df.select("bad", "grow", F.struct("symbol_share", "word_length", *rest).alias("stats"))
    rules = quality_rules.learn(given)
    assert {str(r[0]).split()[0] for r in rules} == {"symbol_share", "word_length"}
    assert given.where(quality_rules.verdict(rules, F.col("stats")) == F.col("bad")).count() == 0


def test_hash():
    assert line_dedup.line_key(b"A" * 40, 40) == hashlib.blake2b(b"a" * 40, digest_size=16).digest()
    assert line_dedup.line_key("é".encode() * 20, 40) is None
