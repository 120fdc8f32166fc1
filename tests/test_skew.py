"""Hot keys: same results when every partition is split and nothing is broadcast."""

import pytest
from pyspark.sql import functions as F

from medweave.operators import skew
from medweave.operators import combine
from medweave.operators.combine import join_tables
from medweave.operators.ids import assign_ids, upsert_dim
from tests.compare import differences, duck

FOLDER = "/root/testdata/sf0.001"


SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def split_everything(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", [
    "cdm_person", "cdm_visit_occurrence", "cdm_condition_occurrence", "cdm_procedure_cost", "cdm_drug_exposure", "cdm_drug_cost", "cdm_provider",
    "cdm_unmapped", "lookup_codes", "drug_era", "steward_queue", "export_decision_all", "my_requests", "download_gate", "submit_blocked",
    "consent_filter", "gold_join", "merge_insert", "lookup_dim", "upsert_dim", "fk_orphan_rows", "visit_by_date", "unmapped_codes", "sync_role",
])
def test_results_do_not_depend_on_the_split(spark, split_everything, name):
    from medweave.bindings import feeds
    from __spark_entry__ import oracle_sql, queries

    if name == "cdm_person":
        feeds._done.clear()
    assert differences(queries()[name](spark, FOLDER), duck(FOLDER), oracle_sql()[name]) in (None, "no rows")
    if name == "cdm_unmapped":
        feeds._done.clear()


def sides(spark):
    left = spark.range(1000).select(F.when(F.col("id") % 3 != 0, (F.col("id") % 7)).alias("k"), F.col("id").alias("v"))
    left = left.withColumn("k", F.when(F.col("v") < 400, 1).otherwise(F.col("k")))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k long, w string")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_kinds(spark, how):
    left, right = sides(spark)
    want = sorted(map(repr, left.join(right, ["k"], how).collect()))
    assert len(want) > 0
    for got in (skew.salted_join(left, right, ["k"], how, ["v"], hot_rows=10), skew.skew_join(left, right, ["k"], how)):
        assert sorted(map(repr, got.collect())) == want


def test_equal_rows_of_a_hot_key_are_split(spark, split_everything, tmp_path):
    """Half of all rows are one row again and again: the join reads its partition in pieces, and the left side once."""
    spark.range(0, 60_000, 1, 12).select(F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"), F.lit("x" * 20).alias("v")).write.parquet(f"{tmp_path}/l")
    left, right = spark.read.parquet(f"{tmp_path}/l"), spark.range(5_000).select(F.col("id").alias("k"), F.lit("w").alias("w"))
    got = skew.skew_join(left, right, ["k"], "left").groupBy("w").count()
    assert {r["w"]: r["count"] for r in got.collect()} == {"w": 32_500, None: 27_500}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan and plan.split("== Initial Plan ==")[0].count("FileScan parquet") == 1


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("nulls_equal", [False, True])
def test_table_joins_with_hot_keys_on_both_sides(spark, split_everything, how, nulls_equal):
    def rows(n, tag):
        return [(None if i % 5 == 0 else 1 if i % 5 < 3 else i, None if i % 7 == 0 else "a", f"{tag}{i}", i) for i in range(n)]

    a, b = rows(90, "l"), [(*r[:2], r[2], -r[3]) for r in rows(60, "r")]
    left, right = spark.createDataFrame(a, "k long, j string, v string, same long"), spark.createDataFrame(b, "k long, j string, w string, same long")
    fits = lambda x, y: x[:2] == y[:2] and (nulls_equal or None not in x[:2])
    want = [(*x, y[2]) for x in a for y in b if fits(x, y)]
    if how in ("left", "outer"):
        want += [(*x, None) for x in a if not any(fits(x, y) for y in b)]
    if how in ("right", "outer"):
        want += [(*y[:2], None, None, y[2]) for y in b if not any(fits(x, y) for x in a)]
    got = join_tables(left, right, ["k", "j"], how, nulls_equal)
    assert got.columns == ["k", "j", "v", "same", "w"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_many_right_rows_of_a_hot_key_count_once(spark, how, monkeypatch):
    left, right = sides(spark)
    many, seen = right.crossJoin(spark.range(1000)).drop("id"), []
    pieces = skew._with_pieces
    monkeypatch.setattr(skew, "_with_pieces", lambda df, hot, keys: seen.append(df.count()) or pieces(df, hot, keys))
    got = skew.salted_join(left, many, ["k"], how, ["v"], hot_rows=10)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(right, ["k"], how).collect()))
    assert seen == [1000, 3]


@pytest.mark.parametrize("columns", [["k", "v", "m"], ["k", "m"]])
def test_columns_that_hold_maps(spark, columns):
    left, right = sides(spark)
    left = left.withColumn("m", F.create_map(F.lit("x"), F.array(F.create_map(F.lit("y"), F.col("v"))))).select(*columns)
    assert skew.salted_join(left, right, ["k"], "left", hot_rows=10).count() == left.join(right, ["k"], "left").count()


def test_other_kinds_are_refused(spark):
    left, right = sides(spark)
    with pytest.raises(ValueError):
        skew.salted_join(left, right, ["k"], "outer")


def test_hot_key_is_spread_and_nulls_too(spark):
    left, _ = sides(spark)
    hot = {r["_hot_k"]: r["_pieces"] for r in skew.hot_keys(left, ["k"], 100).collect()}
    assert hot == {1: 5, None: 2}


def test_null_keys_match_in_table_joins(spark):
    left = spark.createDataFrame([(None, 1), (1, 2)], "k long, v long")
    right = spark.createDataFrame([(None, "n"), (1, "a")], "k long, w string")
    assert sorted(map(tuple, join_tables(left, right, "k", nulls_equal=True).collect()), key=repr) == [(1, 2, "a"), (None, 1, "n")]
    assert sorted(map(tuple, join_tables(left, right, "k").collect()), key=repr) == [(1, 2, "a"), (None, 1, None)]


def test_ids_are_dense_over_many_partitions(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_000).alias("x"))
    got = assign_ids(df, "id", ["x"], 5, partitions=13)
    assert got.where("id <> x + 5").count() == 0 and got.count() == 10_000
    assert assign_ids(df.where("x < 0"), "id", ["x"]).count() == 0


def test_new_keys_continue_after_known_ones(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2)], "k string, id long")
    keys = spark.createDataFrame([("b", 9), ("d", 5), ("c", 7)], "k string, seen long")
    got = upsert_dim(known, keys, ["k"], "id", ["seen"], 3)
    assert sorted((r["k"], r["id"], r["is_new"]) for r in got.collect()) == [("a", 1, False), ("b", 2, False), ("c", 4, True), ("d", 3, True)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_copies_on_both_sides_do_not_make_pairs(spark, how, monkeypatch):
    joined, join = [], combine.skew_join
    monkeypatch.setattr(combine, "skew_join", lambda *args: joined.append(join(*args)) or joined[-1])
    left = spark.createDataFrame([(1, "a")] * 200 + [(1, "b"), (2, "c"), (None, None), (None, None)], "k int, v string")
    right = spark.createDataFrame([(1, 7)] * 300 + [(1, 8), (3, 9), (None, None)], "k int, w int")
    got = join_tables(left, right, "k", how)
    pairs = {(1, v, w) for v in "ab" for w in (7, 8)}
    alone = {(2, "c", None), (None, None, None)} if how in ("left", "outer") else set()
    late = {(3, None, 9), (None, None, None)} if how in ("right", "outer") else set()
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == pairs | alone | late
    assert joined[0].count() == len(pairs | alone)
