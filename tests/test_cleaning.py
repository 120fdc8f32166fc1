"""Silver cleaning, nested extraction and layer checks."""

import json

import pytest
from pyspark.sql import functions as F

from medweave.functions.nested import flatten_default, json_leaf
from medweave.operators.combine import NULL_PLACEHOLDERS, join_tables
from medweave.operators.quality import check_row_count
from medweave.plans import medallion as m
from medweave.sources.files import read_hits
from medweave.sources.tables import mapping_schema


def cleaned(spark, rows, schema="id int, stage string"):
    return sorted(map(tuple, m.transform_silver(spark.createDataFrame(rows, schema)).collect()), key=repr)


def test_clean_rows_stay(spark):
    assert cleaned(spark, [(1, "I"), (2, "II")]) == [(1, "I"), (2, "II")]


def test_repeated_rows_go(spark):
    assert cleaned(spark, [(1, "I")] * 5) == [(1, "I")]


@pytest.mark.parametrize("value", NULL_PLACEHOLDERS)
def test_each_placeholder(spark, value):
    assert cleaned(spark, [(1, value)]) == [(1, None)]


@pytest.mark.parametrize("value", ["NOT REPORTED", "UNKNOWN", " Not Reported", "Unknown ", "n/a", "-", "", "'; DROP TABLE x; --", "héllo 日本"])
def test_other_texts_stay(spark, value):
    assert cleaned(spark, [(1, value)]) == [(1, value)]


def test_null_stays_and_numbers_are_untouched(spark):
    assert cleaned(spark, [(None, None), (3, "NA")]) == [(3, None), (None, None)]


def test_rows_that_differ_only_in_placeholders_both_stay(spark):
    assert cleaned(spark, [(1, "Unknown"), (1, "unknown")]) == [(1, None), (1, None)]


def test_empty_frame_keeps_its_columns(spark):
    df = m.transform_silver(spark.createDataFrame([], "a string, b int"))
    assert df.columns == ["a", "b"] and df.count() == 0


def test_many_rows(spark):
    df = spark.range(100_000).select("id", F.when(F.col("id") % 2 == 0, "NA").otherwise("x").alias("s"))
    got = m.transform_silver(df)
    assert got.count() == 100_000 and got.where("s is null").count() == 50_000


def test_many_columns(spark):
    df = spark.range(3).select("id", *[F.lit("--").alias(f"c{i}") for i in range(500)])
    assert m.transform_silver(df).first()["c499"] is None


HITS = [
    {"case_id": "c1", "submitter_id": "s1", "disease_type": "d", "project": {"project_id": "p"}, "diagnoses": [{"morphology": "m1"}, {"morphology": "m2"}],
     "samples": [{"sample_id": "x1", "submitter_id": "sx", "tissue_type": "Unknown", "initial_weight": 1.5,
                  "portions": [{"slides": [{"slide_id": "l1", "percent_necrosis": 5.0}, {"slide_id": "l2"}]}, {"slides": []}]}, {"sample_id": "x2", "portions": []}]},
    {"case_id": "c2", "submitter_id": "s2", "disease_type": "NA", "project": None, "diagnoses": [], "samples": []},
    {"case_id": "c3", "submitter_id": "s3", "disease_type": "d"},
]


@pytest.fixture(scope="module")
def hits(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("hits") / "r.json"
    path.write_text(json.dumps({"data": {"hits": HITS, "pagination": {}}}, indent=1))
    return read_hits(spark, str(path))


def test_cases(hits):
    got = sorted(map(tuple, m.extract_cases(hits).collect()))
    assert got == [("c1", "s1", "d", "p", "m1"), ("c2", "s2", "NA", None, None), ("c3", "s3", "d", None, None)]


def test_samples_repeat_the_case_and_keep_declared_types(hits):
    df = m.extract_samples(hits)
    assert df.columns == [c for _, c, _ in m.SAMPLE_FIELDS]
    assert df.schema["initial_weight"].dataType.simpleString() == "double"
    assert [(r["case_id"], r["sample_id"], r["initial_weight"], r["state"]) for r in df.orderBy("sample_id").collect()] == [("c1", "x1", 1.5, None), ("c1", "x2", None, None)]


def test_slides(hits):
    got = [(r["case_id"], r["sample_id"], r["slide_id"], r["percent_necrosis"]) for r in m.extract_slides(hits).orderBy("slide_id").collect()]
    assert got == [("c1", "x1", "l1", 5.0), ("c1", "x1", "l2", None)]


def test_all_layers(hits):
    layers = m.medallion(hits, lambda _, df: df)
    assert set(layers) == {*m.BRONZE, *m.SILVER, *m.GOLD}
    gold = {r["sample_id"]: r for r in layers["gold_mastertable"].collect()}
    assert gold["x1"]["submitter_id"] == "sx" and gold["x1"]["project_id"] == "p" and gold["x1"]["tissue_type"] is None
    assert layers["silver_cases"].where("case_id = 'c2'").first()["disease_type"] is None


def test_a_layer_without_its_key_is_refused(spark):
    df = spark.createDataFrame([("s", None)], "case_id string, sample_id string")
    with pytest.raises(ValueError, match="null_in_key"):
        m.validate(df, mapping_schema([("a", "case_id", "String"), ("b", "sample_id", "String")], "sample_id"), "x")
    with pytest.raises(ValueError, match="at least 5"):
        check_row_count(df, 5)


def test_leaf_of_missing_and_listed_paths(spark):
    df = spark.createDataFrame([([],), ([(7,)],), (None,)], "a array<struct<b:int>>")
    assert [r[0] for r in df.select(json_leaf(df.schema, "a.b")).collect()] == [None, 7, None]
    assert df.select(json_leaf(df.schema, "a.zz")).first()[0] is None


def test_flatten(spark):
    df = spark.createDataFrame([(["a", "b"], [1, None], (1,), "x")], "l array<string>, n array<int>, s struct<k:int>, t string")
    assert tuple(flatten_default(df).first()) == ("a, b", "1, None", '{"k":1}', "x")


def test_join_keeps_the_left_copy_and_drops_repeats(spark):
    left = spark.createDataFrame([(1, "l"), (1, "l"), (2, "m")], "k int, s string")
    right = spark.createDataFrame([(1, "r", 9)], "k int, s string, z int")
    assert sorted(map(tuple, join_tables(left, right, ["k"]).collect()), key=repr) == [(1, "l", 9), (2, "m", None)]
    assert sorted(map(tuple, join_tables(left, right, "k", "right").collect())) == [(1, "l", 9)]


def test_repeated_mapping_entries_collapse():
    twice = m.SLIDE_FIELDS + [("samples.portions.slides.slide_id", "slide_id", "String")]
    assert len(m.dedupe_mapping(twice)) == len(m.SLIDE_FIELDS)
