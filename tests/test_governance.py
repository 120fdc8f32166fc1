"""Decisions, row filters, cohort definitions and request state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from medweave.functions import access as fa
from medweave.plans import export, governance as g
from medweave.sources import tables

NOW = 1000
CATALOG = "dataset_id string, study_name string, access_tier string, consent_group string, dbgap_status string, volume_location string"
PERMS = "user_id string, dataset_id string, consent_group string, role string, expiration_ts long, poc_role string"


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([
        ("open", "Open", "open_access", "c0", "s", "/x/"), ("un", "Un", "unregistered", "c0", "s", None), ("con", "Con", "controlled_access", "c1", "s", " "), ("con2", "Con2", "controlled_access", "c2", "s", "/y"),
    ], CATALOG)


@pytest.fixture(scope="module")
def perms(spark):
    return spark.createDataFrame([
        ("ann", "con", "c1", "pi", None, "steward"), ("bob", "con", "c1", None, NOW, "x"), ("cat", "con", "c1", "pi", NOW + 1, None),
        ("dan", "con", "other", "pi", None, "x"), ("eve", "con", "c1", "pi", 1, "x"), ("eve", "con", "c1", "pi", None, "x"),
    ], PERMS)


@pytest.mark.parametrize("user, want", [
    ("ann", ["granted"]), ("bob", ["denied"]), ("cat", ["granted"]), ("dan", ["denied"]), ("zed", ["denied"]), ("eve", ["denied", "granted"]),
])
def test_decision_for_a_controlled_dataset(catalog, perms, user, want):
    got = g.export_decision(catalog, perms, user, NOW).collect()
    assert sorted(r["decision"] for r in got if r["dataset_id"] == "con") == want
    assert {r["dataset_id"]: r["decision"] for r in got if r["dataset_id"] in ("open", "un")} == {"open": "granted", "un": "flagged_for_review"}


def test_basis_and_defaults(catalog, perms):
    rows = {r["user_id"]: r for r in g.export_decision_all(catalog, perms, NOW, True).where("dataset_id = 'con'").collect()}
    assert rows["bob"]["decision_basis"] == fa.BASIS["expired"] and rows["bob"]["role"] == ""
    assert rows["ann"]["expiration_ts"] == 0 and rows["ann"]["decision_basis"] == fa.BASIS["valid"]
    assert "dan" not in rows
    bare = g.export_decision_all(catalog, perms, NOW, True).where("dataset_id = 'con2'").collect()
    assert [(r["user_id"], r["decision_basis"]) for r in bare] == [("", fa.BASIS["missing"])]
    assert g.export_decision_all(catalog, perms, NOW, False).count() == 0


COHORT = "subject_id string, sex string, age int, sysbp double, _consents_ string"
TAG, OTHER = "tutorial-study", "another-study"


def test_row_filter(spark):
    grants = spark.createDataFrame([
        ("alice", TAG, None), ("bob", TAG, None), ("carol", TAG, dt.datetime(2026, 7, 10)), ("dave", OTHER, None),
    ], "user_email string, consent_tag string, revoked_at timestamp")
    cohort = spark.createDataFrame([(f"F{i}", "F", 40 + i, 120.0, TAG) for i in range(8)] + [(f"O{i}", "M", 50, 130.0, OTHER) for i in range(2)], COHORT)
    now = F.lit("2026-08-01").cast("timestamp")
    seen = {u: g.consent_filter(cohort, grants, u, now).count() for u in ("alice", "bob", "carol", "dave")}
    assert seen == {"alice": 8, "bob": 8, "carol": 0, "dave": 2}
    before = F.lit("2026-07-01").cast("timestamp")
    assert g.consent_filter(cohort, grants, "carol", before).count() == 8
    grants.createOrReplaceTempView("g_view")
    g.register_active_consent(spark, "g_view", "may_see")
    sql = "SELECT * FROM {c} WHERE may_see('dave', _consents_, TIMESTAMP '2026-08-01')"
    assert spark.sql(sql, c=cohort).count() == 2


@pytest.mark.parametrize("text, want", [('["a","b"]', ["a", "b"]), ('["a",1,null,["x"]]', ["a"]), ("{}", []), ("nope", []), ("", []), (None, [])])
def test_selected_columns(spark, text, want):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(fa.parse_selected_columns(F.col("c"))).first()[0] == want


@pytest.mark.parametrize("text, want", [
    ('{"column":"a","op":"eq","value":"x"}', ("a", "eq", "x")), ('{"column":"a","op":"gt","value":5}', ("a", "gt", "5")), ('{"column":"a","op":"eq"}', ("a", "eq", "")),
    ('{"column":1,"op":"eq"}', None), ('{"op":"eq"}', None), ("nope", None), (None, None),
])
def test_stored_filter(spark, text, want):
    got = spark.createDataFrame([(text,)], "c string").select(fa.parse_cohort_filter(F.col("c"))).first()[0]
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("op, value, want", [
    ("eq", "1.5", ["a"]), ("ne", "1.5", ["B%"]), ("lt", "2", ["a"]), ("gte", "2.0", ["B%"]), ("gt", "", ["B%", "a"]), ("lt", "Infinity", ["B%", "a", "c"]), ("lt", "1_000", ["B%", "a", "c"]),
    ("like", "x", ["B%", "a", "c"]), ("lte", "0b10", ["B%", "a"]),
])
def test_cohort_operators(spark, op, value, want):
    df = spark.createDataFrame([("a", 1.5), ("B%", 2.0), ("c", None)], "name string, n double")
    assert sorted(r["name"] for r in export.cohort_filter(df, {"column": " N ", "op": op, "value": value}).collect()) == want


def test_contains_ignores_case_and_keeps_wildcards(spark):
    df = spark.createDataFrame([("abc",), ("ABD",), ("x%",)], "name string")
    assert export.cohort_filter(df, {"column": "NAME", "op": "contains", "value": "ab"}).count() == 2
    assert export.cohort_filter(df, {"column": "NAME", "op": "contains", "value": "%"}).count() == 3


def test_whitelist(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, `b c` int, _rescued_data int")
    assert export.project_whitelist(df, [" B C ", "zz", "a", "A", "_rescued_data"]).columns == ["b c", "a"]
    assert export.project_whitelist(df, ["zz"]).columns == df.columns


REQUESTS = (
    "request_id string, submitter string, dataset string, format string, status string, created_at timestamp, steward string, steward_comment string, "
    "approved_at timestamp, rejected_at timestamp, output_url string, output_table string, expires_at timestamp"
)


def request(rid, who="ann", dataset="con", status="approved", table="t", expires=None):
    return (rid, who, dataset, "csv", status, dt.datetime(2025, 1, 1), None, None, None, None, None, table, expires)


def test_download_gates_in_order(spark, catalog, perms):
    past, later = dt.datetime(2024, 1, 1), dt.datetime(2026, 1, 1)
    rows = [
        request("pending", status="pending"), request("no-table", table=None), request("other", who="bob", expires=past), request("expired", expires=past),
        request("revoked", dataset="con2", expires=later), request("gone", dataset="nowhere"), request("fine", expires=later), request("no-expiry"),
    ]
    df = spark.createDataFrame(rows, REQUESTS)
    decisions = g.export_decision(catalog, perms, "ann", NOW)
    now = F.lit("2025-06-01").cast("timestamp")
    got = {r["request_id"]: r["gate"] for r in g.download_decisions(df, decisions, "ann", True, now).collect()}
    assert got == {"pending": "not_found", "no-table": "not_found", "other": "not_your_request", "expired": "export_expired", "revoked": "access_revoked",
                   "gone": "access_revoked", "fine": "allowed", "no-expiry": "allowed"}
    off = {r["request_id"]: r["gate"] for r in g.download_decisions(df, decisions, "ann", False, now).collect()}
    assert off["fine"] == "downloads_disabled" and off["expired"] == "export_expired"


def test_transitions(spark):
    df = spark.createDataFrame([request("a", status="pending", table=None), request("b", status="pending", table=None), request("c", status="pending", table=None), request("d", status="pending", table=None)], REQUESTS)
    at = dt.datetime(2025, 3, 1, 12)
    actions = spark.createDataFrame([("a", "approve", "s", "ok", at, "req_a"), ("b", "approve", "s", None, at, None), ("c", "reject", "s", "no", at, None)],
                                    "request_id string, kind string, steward string, steward_comment string, acted_at timestamp, output_table string")
    got = {r["request_id"]: r for r in g.transition(df, actions).collect()}
    assert (got["a"]["status"], got["a"]["output_url"], got["a"]["expires_at"]) == ("approved", "/api/exports/a/download", dt.datetime(2025, 3, 8, 12))
    assert (got["b"]["status"], got["b"]["output_url"], got["b"]["expires_at"], got["b"]["approved_at"]) == ("approved", None, None, at)
    assert (got["c"]["status"], got["c"]["rejected_at"], got["c"]["approved_at"]) == ("rejected", at, None)
    assert got["d"]["status"] == "pending"


def test_submit(spark, catalog, perms):
    df = spark.createDataFrame([request("1"), request("2", who="bob"), request("3", dataset="un"), request("4", dataset="nowhere"), request("5", who="eve")], REQUESTS)
    pending, blocked = g.submit(df, catalog, perms, NOW)
    assert sorted((r["request_id"], r["status"]) for r in pending.collect()) == [("1", "pending"), ("5", "pending")]
    assert sorted(r["details"] for r in blocked.collect()) == [
        '{"reason":"export_decision","decision":"denied"}', '{"reason":"export_decision","decision":"flagged_for_review"}', '{"reason":"export_decision","decision":"no_record"}',
    ]


def test_roles(spark, perms):
    group = lambda *u: spark.createDataFrame([(x,) for x in u], "user_id string")
    got = {r["user_id"]: r["poc_role"] for r in g.sync_role(perms, group("bob", "cat"), group("bob", "ann")).collect()}
    assert got == {"ann": "analyst", "bob": "steward", "cat": None, "dan": "x", "eve": "x"}


def test_artifact_end_to_end(spark, tmp_path, perms):
    source, out = tmp_path / "study", tmp_path / "out"
    source.mkdir()
    (source / "a.csv").write_text('id,name,v\n1,"x, ""y""",5\n2,plain,7\n3,,9\n')
    catalog = spark.createDataFrame([("ds", "S", "open_access", "c1", "s", f" {source}// "), ("none", "N", "open_access", "c1", "s", None)], CATALOG)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS exports LOCATION '{tmp_path}/db'")
    asked = {"request_id": "r-1/x", "dataset": "ds", "submitter": "o'neil", "selected_columns": ["name", "ID"], "cohort_filter": {"column": "v", "op": "lt", "value": "8"}}
    made = export.export_artifact(spark, catalog, "exports", asked, "boss", "2026-01-01")
    assert made == {"table": "exports.req_r_1_x", "row_count": 2, "projected": True, "filtered": True}
    properties = {r["key"]: r["value"] for r in spark.sql("SHOW TBLPROPERTIES exports.req_r_1_x").collect()}
    assert properties["submitter"] == "o'neil" and properties["cohort_filtered"] == "true"
    assert spark.table(made["table"]).columns[:3] == ["name", "id", "_consent_group"]
    tables.to_csv_rfc4180(spark.table(made["table"]).select("name", "id").coalesce(1), str(out))
    assert next(out.glob("part-*")).read_bytes() == b'name,id\r\n"x, ""y""",1\r\nplain,2\r\n'
    assert export.export_artifact(spark, catalog, "exports", {**asked, "dataset": "none"}, "boss", "x") is None
    assert export.export_artifact(spark, catalog, "exports", {**asked, "dataset": "zz"}, "boss", "x") is None


def test_artifacts_hold_all_rows(spark, tmp_path):
    source = tmp_path / "large"
    spark.range(150_000).write.parquet(str(source))
    catalog = spark.createDataFrame([("ds", "S", "open_access", "c1", "s", str(source))], CATALOG)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS whole LOCATION '{tmp_path}/db'")
    asked = {"request_id": "r1", "dataset": "ds", "submitter": "a"}
    rows = spark.read.parquet(str(source))
    assert export.export_rows(rows, [], None, asked).count() == 150_000
    with pytest.raises(ValueError):
        export.export_rows(rows, [], None, asked, cap=10)
    made = export.export_artifact(spark, catalog, "whole", asked, "boss", "2026-01-01", cap=10, order=["id"])
    properties = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {made['table']}").collect()}
    assert made["row_count"] == 10 and spark.table(made["table"]).agg(F.max("id")).first()[0] == 9
    assert (properties["capped"], properties["row_count_before_cap"]) == ("true", "150000")


def test_request_from_submission_to_download(spark, tmp_path, perms):
    source = tmp_path / "study"
    source.mkdir()
    (source / "a.csv").write_text("id,v\n1,5\n2,9\n")
    catalog = spark.createDataFrame([("con", "C", "controlled_access", "c1", "s", str(source))], CATALOG)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS flow LOCATION '{tmp_path}/db'")
    stored = ", selected_columns string, cohort_filter string"
    asked = spark.createDataFrame([(*request("r1", status="new", table=None), '["id"]', '{"column":"v","op":"gt","value":6}')], REQUESTS + stored)
    pending, blocked = g.submit(asked, catalog, perms, NOW)
    assert blocked.count() == 0
    same, event = export.approve(spark, pending, catalog, "flow", "r1", "zed", None, "2025-03-01", False)
    assert same.first()["status"] == "pending" and event.first()["outcome"] == "blocked"
    after, event = export.approve(spark, pending, catalog, "flow", "r1", "boss", "ok", "2025-03-01", True)
    row = after.first()
    assert (row["status"], row["output_table"], row["expires_at"]) == ("approved", "flow.req_r1", dt.datetime(2025, 3, 8))
    assert '"row_count":1,"cohort_projected":true,"cohort_filtered":true' in event.first()["details"]
    decisions = g.export_decision(catalog, perms, "ann", NOW)
    gate, event = export.download(spark, after, decisions, "r1", "ann", True, "2025-03-02", str(tmp_path / "got"))
    assert gate == "allowed" and event.first()["outcome"] == "allowed"
    assert spark.read.option("header", True).csv(str(tmp_path / "got")).first()["id"] == "2"
    assert export.download(spark, after, decisions, "r1", "ann", True, "2025-04-02", "unused")[0] == "export_expired"
    assert export.download(spark, after, decisions, "zz", "ann", True, "2025-04-02", "unused")[0] == "not_found"


def test_seed_replaces(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS seeds LOCATION '{tmp_path}/db'")
    for rows in ([("a", 1)], [("b", 2), ("c", 3)]):
        g.seed(spark, rows, "u string, n int", "seeds.grants")
    assert sorted(r["u"] for r in spark.table("seeds.grants").collect()) == ["b", "c"]
