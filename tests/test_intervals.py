"""Eras: edges of the gap, both forms against each other, events that end before they start."""

import datetime as dt
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from medweave.operators import intervals
from medweave.operators.intervals import merge_intervals
from medweave.plans import eras

DAY0 = dt.date(2008, 1, 1)


def d(n):
    return None if n is None else DAY0 + dt.timedelta(days=n)


def frame(spark, rows):
    return spark.createDataFrame([(k, d(a), d(b)) for k, a, b in rows], "k string, s date, e date")


def merged(spark, rows, **kw):
    got = merge_intervals(frame(spark, rows), ["k"], "s", "e", **kw).collect()
    return sorted((r["k"], (r["era_start"] - DAY0).days, (r["era_end"] - DAY0).days, r["n"]) for r in got)


def by_balance(rows, gap):
    """Day by day: how many intervals are open, and which days close an era because that number passes zero."""
    out = []
    for key in {r[0] for r in rows}:
        spans = [(a, b) for k, a, b in rows if k == key]
        closes, still_open = [], 0
        for day in sorted({a for a, _ in spans} | {b + gap for _, b in spans}):
            steps = [1] * sum(a == day for a, _ in spans) + [-1] * sum(b + gap == day for _, b in spans)
            levels = list(accumulate(steps, initial=still_open))
            if 0 in levels[1:]:
                closes.append(day - gap)
            still_open = levels[-1]
        members = {}
        for a, _ in spans:
            end = min((c for c in closes if c >= a), default=None)
            if end is not None:
                members.setdefault(end, []).append(a)
        out += [(key, min(starts), end, len(starts)) for end, starts in members.items()]
    return sorted(out)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("start, eras_found", [(39, 1), (40, 1), (41, 2)])
def test_gap_edges(spark, strict, start, eras_found):
    assert len(merged(spark, [("a", 0, 10), ("a", start, start + 1)], strict=strict)) == eras_found


@pytest.mark.parametrize("strict", [False, True])
def test_identical_starts_and_nesting(spark, strict):
    rows = [("a", 0, 100), ("a", 0, 5), ("a", 10, 20), ("a", 90, 95), ("b", 0, 0)]
    assert merged(spark, rows, strict=strict) == [("a", 0, 100, 4), ("b", 0, 0, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_both_forms_agree_on_clean_intervals(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abcdef"), a, a + rng.choice([0, 1, 5, 40, 120])) for a in (rng.randrange(2000) for _ in range(400))]
    want = by_balance(rows, 30)
    assert merged(spark, rows) == want
    assert merged(spark, rows, strict=True) == want


@pytest.mark.parametrize("seed", range(3))
def test_strict_follows_the_events_when_ends_precede_starts(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), a, a + rng.randrange(-50, 50)) for a in rng.sample(range(3000), 200)]
    assert merged(spark, rows, strict=True) == by_balance(rows, 30)


def test_hot_key_keeps_one_row_per_day(spark):
    """A third of all rows in one key: the windows see one row per day of it."""
    hot = spark.range(200_000).select(F.lit("hot").alias("k"), F.date_add(F.lit(DAY0), (F.col("id") % 1000).cast("int")).alias("s"))
    rest = spark.range(400_000).select((F.col("id") % 5000).cast("string").alias("k"), F.date_add(F.lit(DAY0), (F.col("id") % 900).cast("int")).alias("s"))
    got = merge_intervals(hot.unionByName(rest).withColumn("e", F.date_add("s", 1)), ["k"], "s", "e")
    assert got.where("k = 'hot'").collect()[0]["n"] == 200_000
    assert got.agg(F.sum("n")).first()[0] == 600_000


def test_rows_without_key_or_date_are_left_out(spark):
    assert merged(spark, [(None, 0, 1), ("a", None, 1), ("a", 5, 6)]) == [("a", 5, 6, 1)]


def test_condition_end_defaults_to_the_next_day(spark):
    df = spark.createDataFrame([(1, 7, d(0), None), (1, 7, d(31), d(40))], "person_id long, condition_concept_id long, condition_start_date date, condition_end_date date")
    assert [(r[2], r[3], r[4]) for r in eras.condition_era(df).collect()] == [(d(0), d(40), 2)]


def test_drug_eras(spark):
    exposure = spark.createDataFrame(
        [
            (1, 10, d(0), None, 30), (1, 10, d(20), None, 30),  # overlap: one sub-exposure of 50 days
            (1, 10, d(70), None, 0),  # no supply counts as one day, 20 days after
            (1, 10, d(200), d(210), 5),  # a given end wins over the supply
            (1, 10, d(300), None, -1), (1, 10, d(300), None, None), (1, 0, d(300), None, 5),  # not eligible
            (2, 11, d(0), None, 10),  # two ingredients
            (2, 12, d(0), None, 10),  # class is not Ingredient
        ],
        "person_id long, drug_concept_id long, drug_exposure_start_date date, drug_exposure_end_date date, days_supply long",
    )
    ancestor = spark.createDataFrame([(100, 10), (100, 10), (100, 11), (101, 11), (102, 12)], "ancestor_concept_id long, descendant_concept_id long")
    concept = spark.createDataFrame(
        [(100, "RxNorm", "Ingredient"), (101, "RxNorm", "Ingredient"), (102, "RxNorm", "Clinical Drug")], "concept_id long, vocabulary_id string, concept_class_id string"
    )
    got = sorted(tuple(r) for r in eras.drug_era(exposure, ancestor, concept).collect())
    assert got == [
        (1, 100, d(0), d(71), 3, 20), (1, 100, d(200), d(210), 1, 0), (2, 100, d(0), d(10), 1, 0), (2, 101, d(0), d(10), 1, 0),
    ]
    numbered = eras.number_eras(eras.drug_era(exposure, ancestor, concept), "drug_era_id", 5).orderBy("drug_era_id").collect()
    assert [r["drug_era_id"] for r in numbered] == [5, 6, 7, 8]


def test_strict_merge_reads_and_shuffles_once(spark, tmp_path):
    frame(spark, [("a", 0, 3), ("b", 5, 1)]).write.parquet(f"{tmp_path}/spans")
    out = merge_intervals(spark.read.parquet(f"{tmp_path}/spans"), ["k"], "s", "e", strict=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    # one shuffle for the counts per key and day, one that deals those day rows out by key
    assert plan.count("Exchange ") <= 2 and plan.count("Sort [") == 1


def test_eras_are_sorted_in_small_pieces(spark):
    """What one task sorts is a small share of a core's rows, however well they compress on their way."""
    rows = spark.range(4000).selectExpr("id % 400 AS k", "date_add(DATE'2020-01-01', CAST(id DIV 400 * 40 AS INT)) AS s", "date_add(DATE'2020-01-02', CAST(id DIV 400 * 40 AS INT)) AS e")
    merged = intervals.merge_intervals(rows, ["k"], "s", "e")
    pieces = intervals.PIECES_PER_CORE * spark.sparkContext.defaultParallelism
    assert merged.count() == 4000 and merged.rdd.getNumPartitions() >= pieces


def test_events_are_counted_in_small_pieces(spark):
    """No task counts a merged share of the events; equal spans, NULL keys and NULL days are counted as groups of their own."""
    rows = spark.range(4000).selectExpr("IF(id % 400 = 0, NULL, id % 400) AS k", "IF(id % 7 = 0, NULL, date_add(DATE'2020-01-01', CAST(id DIV 800 AS INT))) AS s", "date_add(s, 3) AS e")
    pieces = intervals.PIECES_PER_CORE * spark.sparkContext.defaultParallelism
    events = intervals.era_events(rows, ["k"], "s", "e", 30)
    assert events.columns == ["k", "day", "n", "kind"]
    assert events.rdd.getNumPartitions() >= pieces
    starts = rows.groupBy("k", "s").count().selectExpr("k", "s", "count", "-1")
    ends = rows.groupBy("k", "e").count().selectExpr("k", "date_add(e, 30)", "count", "1")
    assert sorted(map(repr, map(tuple, events.collect()))) == sorted(map(repr, map(tuple, starts.union(ends).collect())))
