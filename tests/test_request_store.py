"""The versioned store of requests: steps that meet, steps that are lost, artifacts against plain Python."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from medweave.plans import export, request_store as rs

NOW = 1000
CATALOG = "dataset_id string, study_name string, access_tier string, consent_group string, dbgap_status string, volume_location string"
PERMS = "user_id string, dataset_id string, consent_group string, role string, expiration_ts long"
ASKED = "request_id string, submitter string, dataset string, format string, created_at timestamp, selected_columns string, cohort_filter string"
ACTIONS = "request_id string, kind string, steward string, is_steward boolean, steward_comment string, acted_at timestamp"
DAY = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def world(spark):
    catalog = spark.createDataFrame([("a", "A", "open_access", "c", "s", "/x"), ("b", "B", "controlled_access", "c", "s", None)], CATALOG)
    perms = spark.createDataFrame([("ann", "b", "c", "pi", None), ("bob", "b", "c", "pi", NOW)], PERMS)
    rows = [("a", 1, "x", 1.5), ("a", 2, "Y%", None), ("a", 3, None, 16.0), ("z", 4, "x", 2.0)]
    return catalog, perms, spark.createDataFrame(rows, "dataset_id string, id int, `my name` string, v double")


def asked(spark, *rows):
    return spark.createDataFrame([(r, who, d, "csv", DAY, sel, flt) for r, who, d, sel, flt in rows], ASKED)


def acts(spark, *rows):
    return spark.createDataFrame([(r, kind, who, who == "boss", "c", DAY + dt.timedelta(days=1)) for r, kind, who in rows], ACTIONS)


def states(store, version=None):
    return {r["request_id"]: r["status"] for r in store.requests(version).collect()}


def outcomes(store, version=None):
    return sorted((r["action_type"], r["outcome"]) for r in store.events(version).collect())


def test_submission_to_download(spark, tmp_path, world):
    catalog, perms, sources = world
    store = rs.RequestStore(spark, str(tmp_path))
    assert store.version() == 0 and states(store) == {} and outcomes(store) == []
    rows = [("1", "eve", "a", '["ID"]', None), ("2", "ann", "b", None, None), ("3", "bob", "b", None, None), ("4", "eve", "nowhere", None, None)]
    assert rs.submit(store, asked(spark, *rows), catalog, perms, NOW) == 1
    assert states(store) == {"1": "pending", "2": "pending"}
    rs.submit(store, asked(spark, *rows[:1]), catalog, perms, NOW)
    assert states(store) == {"1": "pending", "2": "pending"}
    assert rs.decide(store, acts(spark, ("1", "approve", "boss"), ("2", "approve", "boss"), ("2", "reject", "eve"), ("9", "approve", "boss")), catalog, sources) == 3
    assert states(store) == {"1": "approved", "2": "approved"} and states(store, 2) == {"1": "pending", "2": "pending"}
    one, two = store.requests().orderBy("request_id").collect()
    assert (one["output_table"], one["row_count"], one["output_url"], one["expires_at"]) == ("req_1", 3, "/api/exports/1/download", DAY + dt.timedelta(days=8))
    assert (two["output_table"], two["row_count"], two["artifact_in"]) == (None, None, None)
    got = store.artifact(one)
    assert got.columns == ["id", *rs.CONSENT] and sorted(r["id"] for r in got.collect()) == [1, 2, 3]
    tries = [("t1", "1", "eve", True, 3), ("t2", "1", "ann", True, 3), ("t3", "1", "eve", True, 30), ("t4", "1", "eve", False, 3), ("t5", "2", "ann", True, 3), ("t6", "77", "ann", True, 3)]
    given = spark.createDataFrame([(a, r, u, e, DAY + dt.timedelta(days=n)) for a, r, u, e, n in tries], "attempt_id string, request_id string, user string, enabled boolean, at timestamp")
    rs.record_downloads(store, given, catalog, perms)
    got = sorted(json.loads(r["details"]).get("reason", "allowed") for r in store.events().where("action_type = 'download_export'").collect())
    assert got == ["allowed", "downloads_disabled", "export_expired", "not_found", "not_found", "not_your_request"]
    assert outcomes(store, 3) == [
        ("approve_export", "approved"), ("approve_export", "approved"), ("reject_export", "blocked"), ("submit_export", "blocked"), ("submit_export", "blocked"),
        ("submit_export", "submitted"), ("submit_export", "submitted"),
    ]
    with pytest.raises(ValueError):
        rs.decide(store, acts(spark, ("1", "approve", "boss"), ("1", "reject", "boss")), catalog, sources)


def test_a_lost_step_leaves_nothing(spark, tmp_path, world, monkeypatch):
    catalog, perms, sources = world
    store = rs.RequestStore(spark, str(tmp_path))
    rs.submit(store, asked(spark, ("1", "eve", "a", None, None)), catalog, perms, NOW)

    def lost(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(store, "claim", lost)
    with pytest.raises(RuntimeError):
        rs.decide(store, acts(spark, ("1", "approve", "boss")), catalog, sources)
    monkeypatch.undo()
    again = rs.RequestStore(spark, str(tmp_path))
    assert states(again) == {"1": "pending"} and len(outcomes(again)) == 1
    rs.decide(again, acts(spark, ("1", "reject", "boss")), catalog, sources)
    assert states(again) == {"1": "rejected"} and len(outcomes(again)) == 2


def test_a_version_is_taken_once(spark, tmp_path, world):
    catalog, perms, _ = world
    store = rs.RequestStore(spark, str(tmp_path))
    step = rs.Step(store, 0)
    step.write("requests", spark.createDataFrame([], rs.REQUESTS))
    rs.submit(store, asked(spark, ("1", "eve", "a", None, None)), catalog, perms, NOW)
    with pytest.raises(rs.Conflict):
        step.commit()
    assert store.version() == 1 and states(store) == {"1": "pending"}


def test_steps_that_meet_are_worked_out_anew(spark, tmp_path, world, monkeypatch):
    catalog, perms, _ = world
    monkeypatch.setattr(rs, "SNAPSHOT_EVERY", 3)
    store, other = rs.RequestStore(spark, str(tmp_path)), rs.RequestStore(spark, str(tmp_path))
    seen, both = [], threading.Event()

    def meet(step, requests):
        seen.append(requests.count())
        if not both.is_set():
            both.set()
            rs.submit(other, asked(spark, ("first", "eve", "a", None, None)), catalog, perms, NOW)
        step.write("requests", rs._fitted(asked(spark, ("second", "eve", "a", None, None)).withColumn("status", F.lit("pending"))))

    assert store.update(meet) == 2 and seen == [0, 1]
    for k in range(5):
        rs.submit(store, asked(spark, (str(k), "eve", "a", None, None)), catalog, perms, NOW)
    assert any(e["snapshot"] for e in store.log())
    assert set(states(store)) == {"first", "second", "0", "1", "2", "3", "4"} and set(states(store, 2)) == {"first", "second"}


FILTERS = [
    None, '{"column":" V ","op":"lt","value":"2"}', '{"column":"v","op":"gte","value":"0x10"}', '{"column":"v","op":"gt","value":""}', '{"column":"v","op":"lte","value":"1_000"}',
    '{"column":"my name","op":"eq","value":"x"}', '{"column":"MY NAME","op":"ne","value":"x"}', '{"column":"my name","op":"contains","value":"%"}', '{"column":"no","op":"eq","value":"x"}',
    '{"column":"v","op":"like","value":"x"}', '{"column":"v","op":"lte","value":"0b10"}', '{"column":"v","op":"lt","value":"1e999"}', "nope",
]


def test_artifacts_in_bulk_are_those_of_single_requests(spark, tmp_path, world):
    catalog, perms, sources = world
    choices = [None, '["v","ID","zz"]', '["zz"]', '["_rescued_data"," my NAME "]']
    rows = [(f"r{i}", "eve", "a", choices[i % len(choices)], f) for i, f in enumerate(FILTERS)]
    store = rs.RequestStore(spark, str(tmp_path))
    rs.submit(store, asked(spark, *rows), catalog, perms, NOW)
    rs.decide(store, acts(spark, *[(r[0], "approve", "boss") for r in rows]), catalog, sources)
    one = sources.where("dataset_id = 'a'").drop("dataset_id")
    for r in store.requests().collect():
        want_cols = json.loads(r["selected_columns"] or "[]")
        try:
            definition = json.loads(r["cohort_filter"] or "null")
        except ValueError:
            definition = None
        want = export.project_whitelist(export.cohort_filter(one, definition), want_cols)
        got = store.artifact(r)
        assert got.columns == [*want.columns, *rs.CONSENT]
        plain = sorted(map(repr, (tuple(x) for x in want.collect())))
        assert sorted(map(repr, (tuple(x) for x in got.drop(*rs.CONSENT).collect()))) == plain, r
        assert r["row_count"] == len(plain)


def test_equal_artifacts_are_written_once_with_stamps_of_their_own(spark, tmp_path, world):
    catalog, perms, sources = world
    store = rs.RequestStore(spark, str(tmp_path))
    rows = [(f"r{i}", who, "a", columns, '{"column":"v","op":"gt","value":"1"}') for i, (who, columns) in enumerate([("eve", '["v","id"]'), ("ann", '[" ID","V"]'), ("bob", '["v"]')])]
    rs.submit(store, asked(spark, *rows), catalog, perms, NOW)
    rs.decide(store, acts(spark, *[(r[0], "approve", "boss") for r in rows]), catalog, sources)
    asked_for = store.requests().orderBy("request_id").collect()
    assert [r["row_count"] for r in asked_for] == [2, 2, 2]
    written = spark.read.parquet(store.part(asked_for[0]["artifact_in"], "artifacts"))
    assert written.count() == 4  # two different artifacts of two rows each, for three requests
    one, two, three = (store.artifact(r).collect() for r in asked_for)
    assert sorted((r["v"], r["id"], r["_exported_for"], r["_request_id"]) for r in one) == [(1.5, 1, "eve", "r0"), (16.0, 3, "eve", "r0")]
    assert sorted((r["id"], r["v"], r["_exported_for"], r["_request_id"]) for r in two) == [(1, 1.5, "ann", "r1"), (3, 16.0, "ann", "r1")]
    assert sorted((r["v"], r["_exported_for"], r["_dbgap_accession"]) for r in three) == [(1.5, "bob", "a"), (16.0, "bob", "a")]
