"""Hard negatives against plain Python."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from medweave.llm import hard_negatives as hn
from medweave.llm.common import ORACLE, QUERIES
from tests.compare import differences, duck, type_differences

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, low=80, high=100):
    fine = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, va, ya in fine:
        if a % 100:
            continue
        scored = sorted((-sum(x * z for x, z in zip(va, v, strict=True)), i, y == ya) for i, v, y in fine if i != a and len(v) == len(va))
        for p, i, _ in [s for s in scored if s[2]][:k]:
            near = [(j, -q) for q, j, same in scored if not same and low * -p <= 100 * -q <= high * -p][:k]
            out += [(a, i, n, j, -p, q) for n, (j, q) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("uid", F.lit(None))
    return sorted(map(tuple, hn.mine(df, F.col("vec_id") % 100 == 0, F.col("label"), **options).collect()))


def test_keys():
    rng = random.Random(5)
    keys = [(rng.randrange(3), rng.randrange(2), rng.choice([-hn.END, -5, 0, 5, hn.END]), rng.choice([-(2**63), -1, 0, 9, 2**63 - 1])) for _ in range(500)]
    assert sorted(keys, key=lambda k: hn.pack_key(*k)) == sorted(keys, key=lambda k: (k[0], -k[2], k[1], k[3]))
    assert [hn.unpack_key(hn.pack_key(*k)) for k in keys] == keys


def test_first():
    rng = np.random.default_rng(3)
    for n in (1, 3, 40):
        scores, fits = rng.integers(-3, 4, (7, n)), rng.random((7, n)) < 0.6
        want = [(sorted((j for j in range(n) if fits[i, j]), key=lambda j: (-scores[i, j], j)) + [-1] * 5)[:5] for i in range(7)]
        assert hn.first(scores, np.arange(n), fits, 5).tolist() == want


def test_exact_products():
    big = np.array([[2.0**40, 3.0, -(2.0**40)]])
    assert hn.products(big, big).tolist() == [[hn.END]]
    assert hn.products(big, np.array([[1.0, 1.0, 1.0]])).tolist() == [[3]]
    assert hn.products(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0]])).tolist() == [[2**60 + 1]]


def test_ties_copies_and_hot_labels(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([0.0, 0.01, 0.02, -0.01]) for _ in range(4)], 1 if i % 3 else rng.randrange(4)) for i in range(600)]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50
    assert mined(spark, rows, k=2, low=50, high=90) == brute(rows, 2, 50, 90)


def test_odd_rows(spark):
    v = [0.5, 0.25]
    rows = [
        (0, v, 1), (0, v, 1), (1, v, 1), (2, v, 2), (2, v, 2), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 1), (7, v, None), (None, v, 1),
        (8, [0.5], 1), (9, [0.5], 2), (100, [0.5], 1), (200, [], 1), (201, [], 1), (202, [], 2), (300, [-0.5, 0.1], 1), (301, [0.5, 0.1], 1), (302, [1e30, 0.1], 1), (303, [1e30, 0.1], 3), (400, [1e30, 0.2], 3), (500, [0.0, 0.0], 2),
    ]
    clip = lambda x: max(-hn.END, min(hn.END, x))
    want = sorted((*r[:4], clip(r[4]), clip(r[5])) for r in brute([(i, v and [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]) if abs(r[4]) < 2**63 and abs(r[5]) < 2**63)
    got = [r for r in mined(spark, rows) if r[4] < hn.END and r[5] < hn.END]
    assert got == want
    assert mined(spark, []) == [] and mined(spark, [(1, v, 1)]) == [] and mined(spark, [(100, v, 1)]) == []


def test_query(spark):
    con, df = duck(FOLDER), QUERIES["op11_hard_negatives"](spark, FOLDER)
    assert differences(df, con, ORACLE["op11_hard_negatives"]) is None
    assert not type_differences(df, con, ORACLE["op11_hard_negatives"])
