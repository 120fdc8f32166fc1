"""The claims conversion on a few hand-written records, read from files."""

import os
import time
from dataclasses import replace

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from medweave import schemas as S
from medweave.bindings import feeds
from medweave.bindings.common import Tables
from medweave.functions import claims as fc
from medweave.functions.coverage import coverage_window, payer_plan_periods
from medweave.operators import vocab
from medweave.plans import claims as C
from medweave.session import CLEANUP, settle, shuffles_deleted, together
from medweave.sources import files, tables


def write(folder, name, kind, rows, sep=","):
    names = S.LAYOUTS[kind] if isinstance(kind, str) else kind
    lines = [sep.join(names)] + [sep.join(str(r.get(n, "")) for n in names) for r in rows]
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder / name)


def person(pid, **kw):
    base = {
        "DESYNPUF_ID": pid, "BENE_BIRTH_DT": "19360901", "BENE_SEX_IDENT_CD": 1, "BENE_RACE_CD": 5, "SP_STATE_CODE": "10", "BENE_COUNTY_CD": "60",
        "BENE_HI_CVRAGE_TOT_MONS": 12, "BENE_SMI_CVRAGE_TOT_MONS": 12, "BENE_HMO_CVRAGE_TOT_MONS": 0, "PLAN_CVRG_MOS_NUM": 3,
    }
    return {**base, **kw}


CONCEPT = S.cdm_schema("concept").fieldNames()
RELATION = S.cdm_schema("concept_relationship").fieldNames()


def concept(cid, vocab, code, domain):
    return {"concept_id": cid, "concept_name": "x", "domain_id": domain, "vocabulary_id": vocab, "concept_class_id": "c", "concept_code": code,
            "valid_start_date": "19700101", "valid_end_date": "20991231"}


def maps(a, b, kind="Maps to", bad=""):
    return {"concept_id_1": a, "concept_id_2": b, "relationship_id": kind, "valid_start_date": "19700101", "valid_end_date": "20991231", "invalid_reason": bad}


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("claims")
    bene = {
        "2008": write(f, "b8.csv", S.LAYOUTS["beneficiary"][1:], [person("A"), person("A", SP_STATE_CODE="99"), person("B", SP_STATE_CODE="1", BENE_COUNTY_CD="5")]),
        "2009": write(f, "b9.csv", S.LAYOUTS["beneficiary"][1:], [person("A", SP_STATE_CODE="11", BENE_HI_CVRAGE_TOT_MONS=6)]),
        "2010": write(f, "b10.csv", S.LAYOUTS["beneficiary"][1:], [person("A", BENE_SEX_IDENT_CD=2, BENE_DEATH_DT="20101231", BENE_HI_CVRAGE_TOT_MONS=13), person("D", BENE_RACE_CD=3)]),
    }
    inpatient = write(f, "in.csv", "inpatient", [
        {"DESYNPUF_ID": "A", "CLM_ID": "1", "CLM_FROM_DT": "20080301", "CLM_THRU_DT": "20080305", "PRVDR_NUM": "H1", "AT_PHYSN_NPI": "N1", "OP_PHYSN_NPI": "N2",
         "ADMTNG_ICD9_DGNS_CD": "0010", "ICD9_DGNS_CD_1": "0010", "ICD9_DGNS_CD_2": "0020", "ICD9_PRCDR_CD_1": "9999", "HCPCS_CD_1": "J1"},
        {"DESYNPUF_ID": "A", "CLM_ID": "2", "CLM_FROM_DT": "", "CLM_THRU_DT": "20080305", "PRVDR_NUM": "H9", "ICD9_DGNS_CD_1": "0010"},
        {"DESYNPUF_ID": "ZZ", "CLM_ID": "3", "CLM_FROM_DT": "20080301", "CLM_THRU_DT": "20080305", "PRVDR_NUM": "H8", "ICD9_DGNS_CD_1": "0010"},
        {"DESYNPUF_ID": "D", "CLM_ID": "4", "CLM_FROM_DT": "20090101", "CLM_THRU_DT": "20090101", "ICD9_DGNS_CD_1": "7777"},
    ])
    outpatient = write(f, "out.csv", "outpatient", [
        {"DESYNPUF_ID": "A", "CLM_ID": "5", "CLM_FROM_DT": "20080301", "CLM_THRU_DT": "20080305", "PRVDR_NUM": "H1", "AT_PHYSN_NPI": "N3", "ADMTNG_ICD9_DGNS_CD": "0010"},
        {"DESYNPUF_ID": "B", "CLM_ID": "6", "CLM_FROM_DT": "20090601", "CLM_THRU_DT": "20090602", "PRVDR_NUM": "H2", "ICD9_DGNS_CD_1": "0030"},
    ])
    line = {"TAX_NUM": "T", "HCPCS_CD": "J1"}
    carrier_a = write(f, "ca.csv", "carrier", [
        {"DESYNPUF_ID": "B", "CLM_ID": "7", "CLM_FROM_DT": "20100101", "CLM_THRU_DT": "20100101", "PRF_PHYSN_NPI_1": "N9", "TAX_NUM_1": "T1", "HCPCS_CD_1": "J1",
         "LINE_NCH_PMT_AMT_1": "0.00", "LINE_BENE_PTB_DDCTBL_AMT_1": "10.5", "LINE_COINSRNC_AMT_1": "2", "LINE_ALOWD_CHRG_AMT_1": "80",
         "PRF_PHYSN_NPI_13": "N8", "TAX_NUM_13": "", "LINE_COINSRNC_AMT_13": "x", "PRF_PHYSN_NPI_2": "", "TAX_NUM_2": "T2", "LINE_COINSRNC_AMT_2": "9"},
    ])
    carrier_b = write(f, "cb.csv", "carrier", [{"DESYNPUF_ID": "B", "CLM_ID": "8", "CLM_FROM_DT": "20100201", "CLM_THRU_DT": "20100201", "LINE_ICD9_DGNS_CD_4": "0010", **{f"{k}_1": "" for k in line}}])
    rx = write(f, "rx.csv", "prescription", [
        {"DESYNPUF_ID": "A", "PDE_ID": "P1", "SRVC_DT": "20080401", "PROD_SRVC_ID": "111", "QTY_DSPNSD_NUM": "30.000", "DAYS_SUPLY_NUM": "30", "PTNT_PAY_AMT": "5", "TOT_RX_CST_AMT": "50"},
        {"DESYNPUF_ID": "A", "PDE_ID": "P2", "SRVC_DT": "20080402", "PROD_SRVC_ID": "OTHER", "QTY_DSPNSD_NUM": "1", "DAYS_SUPLY_NUM": "2", "PTNT_PAY_AMT": "1", "TOT_RX_CST_AMT": "2"},
        {"DESYNPUF_ID": "A", "PDE_ID": "P3", "SRVC_DT": "", "PROD_SRVC_ID": "111"},
        {"DESYNPUF_ID": "A", "PDE_ID": "P4", "SRVC_DT": "20080403", "PROD_SRVC_ID": "333", "PTNT_PAY_AMT": "7", "TOT_RX_CST_AMT": "8"},
    ])
    vocab_rows = [
        concept(1, "ICD9CM", "00.10", "Condition"), concept(2, "ICD9CM", "00.20", "Condition"), concept(3, "ICD9CM", "00.30", "Condition"), concept(4, "HCPCS", "J1", "Procedure"),
        concept(5, "CPT4", "J1", "Metadata"), concept(6, "NDC", "111", "Drug"), concept(7, "ICD9CM", "00.20", "Observation"), concept(8, "NDC", "333", "Drug"),
        concept(100, "SNOMED", "a", "Condition"), concept(101, "SNOMED", "b", "Measurement"), concept(102, "RxNorm", "c", "Device"), concept(103, "SNOMED", "d", "Metadata"),
    ]
    cpath = write(f, "CONCEPT.csv", CONCEPT, vocab_rows, "\t")
    with open(cpath, "a") as out:
        out.write("9\ttoo\tfew\n")
    rpath = write(f, "CONCEPT_RELATIONSHIP.csv", RELATION, [
        maps(1, 101), maps(1, 100), maps(1, 999), maps(2, 100, bad="D"), maps(3, 103), maps(6, 102), maps(4, 100, kind="Is a"), maps(8, 12345),
    ], "\t")
    return C.ClaimsInput(
        files.read_beneficiary(spark, bene), files.read_claims(spark, "inpatient", inpatient), files.read_claims(spark, "outpatient", outpatient),
        files.read_claim_parts(spark, [carrier_a, carrier_b]), files.read_claims(spark, "prescription", rx),
        files.read_vocabulary(spark, cpath, "concept"), files.read_vocabulary(spark, rpath, "concept_relationship"),
    )


@pytest.fixture(scope="module")
def out(inputs):
    return C.claims_to_cdm(inputs)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_concept_map(inputs):
    from medweave.operators.vocab import concept_map

    got = rows(concept_map(inputs.concept, inputs.relationship), "vocab", "code", "source_id", "target_id", "destination")
    assert got == sorted([
        ("ICD9", "0010", 1, 101, "measurement"), ("ICD9", "0010", 1, 100, "condition"),
        ("ICD9", "0020", 7, 0, "observation"),  # a later row of the same code replaces the earlier one
        ("ICD9", "0030", 3, None, None),  # mapped, but the target routes nowhere
        ("HCPCS", "J1", 4, 0, "procedure"),  # the later unmapped concept without a destination leaves it alone
        ("NDC", "111", 6, 102, "device"), ("NDC", "333", 8, None, None),
    ], key=repr)


def test_person_and_location(out):
    t = out.tables
    assert rows(t["person"], "person_id", "gender_concept_id", "race_concept_id", "ethnicity_concept_id", "location_id", "person_source_value") == [
        (1, 8532, 0, 38003563, 1, "A"), (2, 8507, 0, 38003563, 2, "B"), (3, 8507, 0, 38003564, 1, "D"),
    ]
    assert rows(t["location"], "location_id", "state", "county", "location_source_value") == [(1, "FL", "10060", "10-60"), (2, "1", "01005", "1-5")]
    assert [str(r[0]) for r in rows(t["death"], "death_date")] == ["2010-12-31"]


def test_plan_periods(out):
    got = [(r[0], r[1], str(r[2]), str(r[3])) for r in rows(out.tables["payer_plan_period"], "person_id", "plan_source_value", "payer_plan_period_start_date", "payer_plan_period_end_date")]
    assert (1, "Medicare Part B", "2008-01-01", "2010-12-31") in got
    assert not [g for g in got if g[0] == 1 and g[1] == "Medicare Part A"]  # 13 months fit no rule
    assert (2, "Medicare Part D", "2008-01-01", "2008-04-01") in got


def test_visits_care_sites_providers(out):
    t = out.tables
    visit = rows(t["visit_occurrence"], "visit_occurrence_id", "person_id", "visit_concept_id", "provider_id", "care_site_id", "visit_source_value")
    # one visit for claims 1 and 5; claim 4 has no known code and writes none, but uses up an id
    assert visit == [(1, 1, 9201, 2, 1, "1"), (2, 2, 9202, None, 2, "6"), (3, 2, 0, 5, None, "7"), (4, 2, 0, None, None, "8")]
    assert rows(t["care_site"], "care_site_id", "place_of_service_concept_id", "care_site_source_value") == [(1, 8717, "H1"), (2, 8756, "H2"), (3, 8940, "T1")]
    assert rows(t["provider"], "provider_id", "NPI", "care_site_id", "provider_source_value") == [
        (1, "N1", 1, "N1"), (2, "N2", 1, "N1"), (3, "N3", 1, "N3"), (4, "N9", 3, "N9"), (5, "N8", None, "N8"),
    ]


def test_facts(out):
    t = out.tables
    assert rows(t["condition_occurrence"], "condition_occurrence_id", "person_id", "condition_concept_id", "condition_type_concept_id", "visit_occurrence_id") == [
        (1, 1, 100, 38000200, 1), (2, 1, 100, 38000230, 1), (3, 2, 100, 38000230, 4),
    ]
    assert rows(t["measurement_occurrence"], "measurement_id", "measurement_concept_id", "value_as_concept_id") == [(1, 101, 0), (2, 101, 0), (3, 101, 0)]
    assert rows(t["observation"], "observation_concept_id", "observation_source_concept_id") == [(0, 7)]
    assert rows(t["procedure_occurrence"], "procedure_occurrence_id", "person_id", "procedure_type_concept_id", "provider_id") == [(1, 1, 38000251, 2), (2, 2, 38000269, 5)]


def test_costs(out):
    cost = rows(out.tables["procedure_cost"], "procedure_cost_id", "procedure_occurrence_id", "paid_coinsurance", "paid_toward_deductible", "total_out_of_pocket", "total_paid")
    as_numbers = [tuple(None if v is None else float(v) for v in r) for r in cost]
    # lines 1 and 13 of the claim; line 2 has no physician, line 13 an amount that is no number
    assert as_numbers == [(1, 2, 2, 10.5, 12.5, 80), (2, 2, None, None, 0, None)]


def test_drugs(out):
    t = out.tables
    drugs = rows(t["drug_exposure"], "drug_exposure_id", "drug_concept_id", "drug_source_value", "days_supply")
    assert drugs == [(1, 102, "111", 30), (2, 0, "OTHER", 2)]  # whatever the destination; unknown codes with concept 0
    cost = rows(t["drug_cost"], "drug_cost_id", "drug_exposure_id")
    assert cost == [(1, 1), (2, 2), (3, None)]  # a code that maps to nothing has a cost but no exposure


def test_observation_period(out):
    got = rows(out.tables["observation_period"], "person_id", "observation_period_start_date", "observation_period_end_date")
    assert [(p, str(a), str(b)) for p, a, b in got] == [(1, "2008-03-01", "2010-12-31"), (2, "2009-06-01", "2010-02-01"), (3, "2009-01-01", "2009-01-01")]


def test_unmapped(out):
    assert rows(out.unmapped, "feed", "vocab", "code", "person_id") == [("inpatient", "ICD9", "7777", 3), ("inpatient", "ICD9", "9999", 1), ("prescription", "NDC", "OTHER", 1)]


def test_output_files_round_trip(spark, out, tmp_path):
    tables.write_cdm_csv(out.tables, str(tmp_path), 1)
    assert {p.name for p in tmp_path.iterdir()} == {f"{t}_1.csv" for t in S.OUTPUT_TABLES}
    head = next((tmp_path / "death_1.csv").glob("part-*")).read_text().splitlines()
    assert head[0] == "person_id,death_date,death_type_concept_id,cause_concept_id,cause_source_value,cause_source_concept_id"
    assert head[1] == "1,2010-12-31,38003565,,,0"
    assert next((tmp_path / "specimen_1.csv").glob("part-*")).read_text().startswith("specimen_id,person_id")


def test_second_sample_continues(inputs, out):
    again = C.claims_to_cdm(inputs, out.carried())
    assert rows(again.tables["person"], "person_id", "location_id") == [(4, 1), (5, 2), (6, 1)]
    assert again.tables["location"].count() == again.tables["care_site"].count() == again.tables["provider"].count() == 0
    assert again.tables["condition_occurrence"].agg(F.min("condition_occurrence_id")).first()[0] == 4
    assert rows(again.tables["visit_occurrence"], "provider_id")[0] in [(2,), (5,), (None,)]


@pytest.mark.parametrize("months, want", [
    ((12, 12, 12), ["2008-01-01..2010-12-31"]), ((12, 12, 2), ["2008-01-01..2010-02-28"]), ((12, 12, 0), ["2008-01-01..2009-12-31"]),
    ((12, 0, 12), ["2008-01-01..2008-12-31", "2010-01-01..2010-12-31"]), ((12, 5, 7), ["2008-01-01..2008-12-31", "2009-01-01..2009-06-01", "2010-01-01..2010-08-01"]),
    ((1, 12, 12), ["2008-11-30..2010-12-31"]), ((0, 12, 12), ["2009-01-01..2010-12-31"]), ((3, 12, 2), ["2008-09-30..2010-02-28"]),
    ((4, 0, 12), ["2008-01-01..2008-05-01", "2010-01-01..2010-12-31"]), ((0, 0, 0), []), ((13, 0, 0), []), ((1, 2, 3), ["2008-01-01..2008-02-01", "2009-01-01..2009-03-01", "2010-01-01..2010-04-01"]),
])
def test_payer_rules(spark, months, want):
    got = spark.range(1).select(payer_plan_periods(*[F.lit(m) for m in months]).alias("p")).first()["p"]
    assert [f"{p['start']}..{p['end']}" for p in got] == want


@pytest.mark.parametrize("months, want", [(0, None), (12, "2008-01-01..2008-12-31"), (1, "2008-12-01..2008-12-31"), (7, "2008-06-01..2008-12-31")])
def test_coverage_window(spark, months, want):
    got = spark.range(1).select(coverage_window(F.lit(2008), F.lit(months)).alias("w")).first()["w"]
    assert (f"{got['start']}..{got['end']}" if got else None) == want


@pytest.mark.parametrize("state, county, want", [("1", "5", ("1", "1-5", "01005")), ("40", "12", ("40", "40-12", "40012")), ("54", "123", ("54", "54-123", "54123")), ("05", "", ("CA", "05-", "05"))])
def test_locations(spark, state, county, want):
    s, c = F.lit(state), F.lit(county)
    assert tuple(spark.range(1).select(fc.ssa_state(s), fc.location_key(s, c), fc.county_code(s, c)).first()) == want


def test_ids_of_many_groups_from_one_sort(spark):
    """Each group is numbered by itself; one range shuffle for all, whatever share a group has."""
    from medweave.operators.ids import assign_ids_by

    df = spark.range(0, 20_000, 1, 13).selectExpr(
        "id % 997 AS a", "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 101 = 0 THEN 'rare' WHEN id % 7 = 1 THEN NULL WHEN id % 7 = 2 THEN 'none' ELSE 'x' END AS kind"
    )
    bases = {"hot": 1, "rare": 100, "x": 7, "absent": 3}
    out = assign_ids_by(df, "kind", "number", ["a", "id"], bases)
    rows = sorted((r.kind, r.a, r.id, r.number) for r in out.collect())
    at, want = dict(bases), []
    for r in sorted(df.collect(), key=lambda r: (r.a, r.id)):
        if r.kind in at:
            want.append((r.kind, r.a, r.id, at[r.kind]))
            at[r.kind] += 1
    assert rows == sorted(want)
    assert out.columns == ["number", "a", "id", "kind"]
    one = out.where("kind = 'rare'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in one and "Exchange range" not in one


def test_concept_map_groups_once(spark, tmp_path):
    """At most five scans and six shuffles, from files to the finished map."""
    concept = [(i, ["Condition", "Drug", "none"][i % 3], ["ICD9CM", "NDC", "SNOMED"][i % 3], f"c{i % 40}", i) for i in range(200)]
    links = [(i, (i * 7) % 230, "Maps to", "", i) for i in range(0, 200, 2)]
    spark.createDataFrame(concept, "concept_id long, domain_id string, vocabulary_id string, concept_code string, ordinal long").write.parquet(f"{tmp_path}/c")
    spark.createDataFrame(links, "concept_id_1 long, concept_id_2 long, relationship_id string, invalid_reason string, ordinal long").write.parquet(f"{tmp_path}/r")
    found = vocab.concept_map(spark.read.parquet(f"{tmp_path}/c"), spark.read.parquet(f"{tmp_path}/r"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 5 and plan.count("Exchange ") + plan.count("BroadcastExchange") <= 6
    assert found.count() > 0


def test_conversion_writes_only_what_is_read_again(inputs, monkeypatch):
    """One copy of the coded rows, no copy of the prescriptions' lookup, and a numbered copy in many ranges without the columns of the order."""
    from medweave import session
    from medweave.operators import ids

    written, settle = [], session.settle

    def noted(df, *args, **kw):
        written.append(df)
        return settle(df, *args, **kw)

    monkeypatch.setattr(C, "settle", noted)
    monkeypatch.setattr(ids, "settle", noted)
    C.claims_to_cdm(inputs)
    assert sum("known" in df.columns for df in written) == 1
    numbered = [df for df in written if {"destination", "_place"} <= set(df.columns)]
    assert len(numbered) == 1 and not {"claim_id", "segment", "target_order"} & set(numbered[0].columns)
    context = numbered[0].sparkSession.sparkContext
    assert numbered[0].rdd.getNumPartitions() > context.defaultParallelism
    assert not any("visit_occurrence_id" in df.columns and "codes" not in df.columns and "row_id" in df.columns and "code" not in df.columns for df in written)


def test_ids_keep_only_the_columns_asked_for(spark):
    from medweave.operators.ids import assign_ids

    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", None)], "x string, y int")
    out = assign_ids(df, "id", ["x"], 5, keep=["y"])
    assert out.columns == ["id", "y"] and sorted(map(tuple, out.collect())) == [(5, 2), (6, 1), (7, None)]


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def test_settled_copies_leave_no_shuffle_files(spark, monkeypatch):
    """They stayed until the driver happened to collect its garbage: all shuffles of a conversion lay on the disk at once."""
    before, seen, parquet = shuffle_files(spark), [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *args, **kw: seen.append(spark.conf.get(CLEANUP, None)) or parquet(self, *args, **kw))
    jobs = {f"job{k}": lambda k=k: settle(spark.range(1000).repartition(3 + k, "id").groupBy((F.col("id") % 7).alias("r")).count()) for k in range(3)}
    for made in together(spark, **jobs).values():
        assert sorted(r["count"] for r in made.collect()) == [142] + [143] * 6
    for _ in range(100):  # Spark deletes them in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert seen == ["true"] * 3 and spark.conf.get(CLEANUP, None) is None


def test_cleanup_is_put_back(spark):
    with pytest.raises(ValueError), shuffles_deleted(spark):
        assert spark.conf.get(CLEANUP) == "true"
        raise ValueError
    assert spark.conf.get(CLEANUP, None) is None
    spark.conf.set(CLEANUP, "false")
    try:
        with shuffles_deleted(spark):
            assert spark.conf.get(CLEANUP) == "false"  # as it was set by hand
        assert spark.conf.get(CLEANUP) == "false"
    finally:
        spark.conf.unset(CLEANUP)


def test_joined_feed_is_deleted_when_it_is_read(spark, inputs):
    given = feeds.given(Tables(spark, "/root/testdata/sf0.001"))
    file = given.prescription.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(file) and given.prescription.count() > 0
    given.prescription_read()
    assert not os.path.exists(os.path.dirname(file))
    calls = []
    again = C.claims_to_cdm(replace(inputs, prescription_read=lambda: calls.append(1)))
    assert calls == [1] and again.tables["drug_cost"].count() == 3



def test_feed_comes_from_its_rank(inputs, monkeypatch):
    from medweave.operators import ids

    written = []
    monkeypatch.setattr(ids, "settle", lambda df, *args, **kw: written.append(df) or settle(df, *args, **kw))
    made = C.claims_to_cdm(inputs)
    (numbered,) = [df for df in written if {"destination", "_place"} <= set(df.columns)]
    assert not {"feed", "rx_id"} & set(numbered.columns)
    assert rows(made.tables["condition_occurrence"], "condition_type_concept_id") == [(38000200,), (38000230,), (38000230,)]
    assert rows(made.tables["drug_cost"], "drug_exposure_id") == [(1,), (2,), (None,)]
