"""The prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from medweave.llm import prefix_trie
from medweave.llm.common import ORACLE, QUERIES
from tests.compare import differences, duck, type_differences

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    return {c: [x[2] for x in sorted(own)] for c, own in convs.items()}


def brute(convs, rebuild=True):
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        whole[c] = tuple(base[:h] + own[h:])
    members, below = defaultdict(list), defaultdict(set)
    for c, own in whole.items():
        for d in range(len(own) + 1):
            members[own[:d]].append(c)
            for e in range(d, len(own) + 1):
                below[own[:d]].add(own[:e])
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    words = lambda p: len([w for w in p[-1][1].translate(str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))).split(" ") if w]) if p else 0
    out = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(whole[c]) == len(p))))
        out.append((
            min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children[p]), sum(not children[q] for q in below[p]),
            sum((len(members[q]) - 1) * words(q) for q in below[p]), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "turn AS part", "text AS key", "role AS words", "turn AS depth")
    return sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df))).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("parts", [1, 8, 40])
def test_random(spark, seed, parts):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-300, 3000), 150):
        hot = rng.random() < 0.4  # copies of one conversation, and its continuations
        for t in range(rng.randrange(0, 6)):
            rows.append((c, t, "user", f"w{t} same\twords") if hot else (c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b  c", "", None])))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert got(spark, rows) == brute(ordered(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_runs_over_borders(spark, monkeypatch):
    """One conversation many times, its ids in several pieces of several ranges."""
    monkeypatch.setattr(prefix_trie, "ENDS_PIECE", 7)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 4000, 20) for t in range(3)] + [(c + 1, t, "user", f"t{t}") for c in range(0, 400, 20) for t in range(5)]
    assert got(spark, rows) == brute(ordered(rows))


def test_odd(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "x"), (20, 0, "", ""), (20, 1, "user", " \t"), (21, 0, "u", "ser"), (22, 0, "us", "er"),
        (-7, 3, "user", "long " * 30_000), (-8, 1, "user", "long " * 30_000), *[(5, t, "user", "t") for t in range(1500)],
    ]
    convs = ordered(rows)
    deep = [c for c in convs if len(convs[c]) > 100]
    assert deep == [5]
    shallow = [r for r in rows if r[0] != 5]
    assert got(spark, shallow) == brute(ordered(shallow))
    assert len(got(spark, rows)) > 1500
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []


def test_turnless(spark):
    """A conversation whose own turns all give way to a base that is not there."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    assert got(spark, [(c, 0, "user", "x")]) == brute(ordered([(c, 0, "user", "x")]))
    assert got(spark, [(c, 0, "user", "x")])[0][:5] == (c, 0, None, 1, 0)


def test_query(spark):
    con, df = duck(FOLDER), QUERIES["op12_prefix_trie"](spark, FOLDER)
    assert differences(df, con, ORACLE["op12_prefix_trie"]) is None
    assert not type_differences(df, con, ORACLE["op12_prefix_trie"])
