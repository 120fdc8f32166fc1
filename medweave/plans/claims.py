"""Claims feeds to CDM tables.

Claims are tied to their person and written once (with a row id) before anything is derived from
them; from then on a claim is followed by that id, and only narrow columns are joined to find the
visit, care site and provider ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from medweave import schemas as S
from medweave.functions import claims as fc
from medweave.functions.coverage import payer_plan_periods
from medweave.functions.vocabulary import HCPCS, ICD9, NDC
from medweave.operators import ids, keyed, vocab
from medweave.operators.skew import skew_join
from medweave.session import pieces, settle, together

PERSON = "DESYNPUF_ID"
FEEDS = ("inpatient", "outpatient", "carrier")

# Plan names in the order their periods are numbered, with the months column.
PLANS = {
    "Medicare Part A": "BENE_HI_CVRAGE_TOT_MONS",
    "Medicare Part B": "BENE_SMI_CVRAGE_TOT_MONS",
    "HMO": "BENE_HMO_CVRAGE_TOT_MONS",
    "Medicare Part D": "PLAN_CVRG_MOS_NUM",
}

# A claim's place in the order everything is numbered in.
CLAIM_ORDER = ["person_id", "feed_rank", "claim_id", "segment", "from_dt", "thru_dt", "row_id"]
VISIT_KEY = ["person_id", "from_dt", "thru_dt", "visit_site"]


def conform(df: DataFrame, kind: str) -> DataFrame:
    """All fields of a feed as text in file order; fields the frame lacks, and NULLs, become blank."""
    present = set(df.columns)
    return df.select(
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in present else F.lit("").alias(c)
            for c in S.LAYOUTS[kind]
        ]
    )


def has_service_date(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.coalesce(F.col(col), F.lit("")) != "")


def skip_header_rows(df: DataFrame, col: str = PERSON, token: str = PERSON) -> DataFrame:
    """Drop header lines that ended up among the data."""
    return df.where(~F.trim(F.col(col), F.lit('"')).eqNullSafe(F.lit(token)))


def attach_claims(person: DataFrame, claims: DataFrame, key: str = PERSON) -> DataFrame:
    """Claims of known persons, with the columns of ``person``; persons with very many claims are split."""
    return skew_join(claims, person, [key], "inner")


# --- claims in one shape -------------------------------------------------------------------------------

_LINE = {"line": "int", **{n: "string" for n in S.LINE_FIELDS}}
_LINES_TYPE = "array<struct<" + ",".join(f"{k}:{v}" for k, v in _LINE.items()) + ">>"


def _cols(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def claim_codes(kind: str) -> Column:
    """The codes of a claim with their vocabulary, in the order they are looked up."""
    if kind == "carrier":
        return F.concat(
            fc.tagged_codes(ICD9, _cols(S.CARRIER_DIAGNOSES)),
            fc.tagged_codes(HCPCS, [F.col(f"HCPCS_CD_{i}") for i in range(1, S.CARRIER_LINES + 1)]),
            fc.tagged_codes(ICD9, [F.col(f"LINE_ICD9_DGNS_CD_{i}") for i in range(1, S.CARRIER_LINES + 1)]),
        )
    admitting = ["ADMTNG_ICD9_DGNS_CD"] if kind == "outpatient" else []
    return F.concat(
        fc.tagged_codes(ICD9, _cols(admitting + S.DIAGNOSES + S.PROCEDURES)), fc.tagged_codes(HCPCS, _cols(S.HCPCS))
    )


def claim_rows(kind: str, df: DataFrame) -> DataFrame:
    """A feed's claims in the common shape; claims without a from date are left out."""
    claims = has_service_date(conform(skip_header_rows(df), kind), "CLM_FROM_DT")
    if kind == "carrier":
        groups = [{n: F.col(f"{n}_{i}") for n in S.LINE_FIELDS} for i in range(1, S.CARRIER_LINES + 1)]
        claims = claims.withColumn("lines", fc.carrier_lines(groups, "PRF_PHYSN_NPI").cast(_LINES_TYPE))
        lines, fact = F.col("lines"), fc.carrier_fact_provider_site(F.col("lines"))
        sites = F.filter(
            F.transform(lines, lambda x: F.struct(x["line"].alias("at"), x["TAX_NUM"].alias("site"))), lambda x: x["site"] != ""
        )
        providers = F.transform(
            lines,
            lambda x: F.struct(
                x["line"].alias("at"), x["PRF_PHYSN_NPI"].alias("npi"), fc.not_blank(x["TAX_NUM"]).alias("site"),
                x["PRF_PHYSN_NPI"].alias("source_value"),
            ),
        )
        visit_site, segment, fact_npi, fact_site = F.col("TAX_NUM_1"), F.lit(""), fact["npi"], fact["site"]
    else:
        lines = F.array().cast(_LINES_TYPE)
        site = F.col("PRVDR_NUM")
        sites = F.filter(F.array(F.struct(F.lit(0).alias("at"), site.alias("site"))), lambda x: x["site"] != "")
        seen = [
            F.struct(
                F.lit(i).alias("at"), F.col(n).alias("npi"), fc.not_blank(site).alias("site"),
                F.col("AT_PHYSN_NPI").alias("source_value"),
            )
            for i, n in enumerate(S.PHYSICIANS)
        ]
        providers = F.filter(F.array(*seen), lambda x: x["npi"] != "")
        visit_site, segment, fact_site = site, F.col("SEGMENT"), fc.not_blank(site)
        fact_npi = fc.claim_provider(*_cols(S.PHYSICIANS))
    return claims.select(
        PERSON,
        F.lit(kind).alias("feed"),
        F.lit(FEEDS.index(kind) + 1).alias("feed_rank"),
        F.col("CLM_ID").alias("claim_id"),
        segment.alias("segment"),
        F.col("CLM_FROM_DT").alias("from_dt"),
        F.col("CLM_THRU_DT").alias("thru_dt"),
        visit_site.alias("visit_site"),
        fact_site.alias("fact_site"),
        fact_npi.alias("fact_npi"),
        sites.alias("sites"),
        providers.alias("providers"),
        claim_codes(kind).alias("codes"),
        lines.alias("lines"),
    )


def explode_codes(claims: DataFrame, keep: list[str]) -> DataFrame:
    """One row per code of a claim: ``code_order, vocab, code``."""
    coded = claims.select(*keep, F.posexplode("codes").alias("code_order", "_c"))
    return coded.select(*keep, "code_order", F.col("_c.vocab").alias("vocab"), F.col("_c.code").alias("code"))


# --- person-level tables -----------------------------------------------------------------------------

_LATEST = ["BENE_BIRTH_DT", "BENE_DEATH_DT", "BENE_SEX_IDENT_CD", "BENE_RACE_CD"]


def yearly_records(bene: DataFrame) -> DataFrame:
    """One record per person and year: the first line in sorted order."""
    lines = skip_header_rows(conform(bene, "beneficiary"))
    return keyed.first_seen(lines.withColumn("_line", F.concat_ws(",", *lines.columns)), [PERSON, "FILE_YEAR"], ["_line"]).drop("_line")


def _months(years: list[str]) -> list[Column]:
    return [
        F.coalesce(F.max(F.when(F.col("FILE_YEAR") == y, F.col(c).try_cast("int"))), F.lit(0)).alias(f"{c}_{y}")
        for c in PLANS.values()
        for y in years
    ]


def pivot_coverage(yearly: DataFrame, years: list[str]) -> DataFrame:
    """Months per plan and year, one row per person; a year without a record counts 0 months."""
    return yearly.groupBy(PERSON).agg(*_months(years))


def explode_periods(coverage: DataFrame, years: list[str], keep: list[str]) -> DataFrame:
    """Periods of all plans as rows: ``plan_order, plan_source_value, period_order, start, end``."""
    plans = F.array(
        *[
            F.struct(
                F.lit(i).alias("plan_order"),
                F.lit(name).alias("plan_source_value"),
                payer_plan_periods(*[F.col(f"{c}_{y}") for y in years], first_year=int(years[0])).alias("periods"),
            )
            for i, (name, c) in enumerate(PLANS.items())
        ]
    )
    rows = coverage.select(*keep, F.explode(plans).alias("_p"))
    rows = rows.select(*keep, "_p.plan_order", "_p.plan_source_value", F.posexplode("_p.periods").alias("period_order", "_d"))
    return rows.select(*keep, "plan_order", "plan_source_value", "period_order", F.col("_d.start").alias("start"), F.col("_d.end").alias("end"))


def build_people(bene: DataFrame, years: list[str], base: int) -> DataFrame:
    """One written row per person: id, first known state and county, latest demographics, coverage."""
    yearly = yearly_records(bene)
    latest = F.max_by(F.struct(*_LATEST), F.when(F.col("FILE_YEAR").isin(*years), F.col("FILE_YEAR")))
    earliest = F.min_by(F.struct("SP_STATE_CODE", "BENE_COUNTY_CD"), "FILE_YEAR")
    people = yearly.groupBy(PERSON).agg(latest.alias("latest"), earliest.alias("earliest"), *_months(years))
    return ids.assign_ids(people, "person_id", [PERSON], base)


def build_location(people: DataFrame, known: DataFrame | None, base: int) -> DataFrame:
    keys = people.groupBy(
        F.col("earliest.SP_STATE_CODE").alias("state_code"), F.col("earliest.BENE_COUNTY_CD").alias("county_cd")
    ).agg(F.min("person_id").alias("first_person"))
    keys = keys.select(
        fc.location_key(F.col("state_code"), F.col("county_cd")).alias("location_source_value"),
        fc.ssa_state(F.col("state_code")).alias("state"),
        fc.county_code(F.col("state_code"), F.col("county_cd")).alias("county"),
        "first_person",
    )
    return ids.upsert_dim(known, keys, ["location_source_value"], "location_id", ["first_person"], base)


def build_person(people: DataFrame, location: DataFrame) -> DataFrame:
    named = people.where(F.col("latest").isNotNull()).select(
        "person_id", PERSON, "latest.*",
        fc.location_key(F.col("earliest.SP_STATE_CODE"), F.col("earliest.BENE_COUNTY_CD")).alias("location_source_value"),
    )
    placed = ids.lookup_dim(named, location, ["location_source_value"], "location_id")
    origin = fc.race_ethnicity(F.col("BENE_RACE_CD"))
    return placed.select(
        "person_id",
        fc.gender_concept(F.col("BENE_SEX_IDENT_CD")).alias("gender_concept_id"),
        *[c.alias(n) for n, c in fc.birth_parts(F.col("BENE_BIRTH_DT")).items()],
        origin["race"].alias("race_concept_id"),
        origin["ethnicity"].alias("ethnicity_concept_id"),
        "location_id",
        F.col(PERSON).alias("person_source_value"),
        F.col("BENE_SEX_IDENT_CD").alias("gender_source_value"),
        F.col("BENE_RACE_CD").alias("race_source_value"),
        F.col("BENE_RACE_CD").alias("ethnicity_source_value"),
    )


def build_payer_plan_period(people: DataFrame, years: list[str], base: int) -> DataFrame:
    periods = explode_periods(people.where(F.col("latest").isNotNull()), years, ["person_id"])
    numbered = ids.assign_ids(periods, "payer_plan_period_id", ["person_id", "plan_order", "period_order"], base)
    return numbered.select(
        "payer_plan_period_id", "person_id", F.col("start").alias("payer_plan_period_start_date"),
        F.col("end").alias("payer_plan_period_end_date"), "plan_source_value",
    )


def build_death(people: DataFrame) -> DataFrame:
    death = people.select("person_id", fc.parse_ymd(F.col("latest.BENE_DEATH_DT")).alias("death_date"))
    return death.where(F.col("death_date").isNotNull()).select(
        "person_id", "death_date", F.lit(fc.DEATH_TYPE).alias("death_type_concept_id"), F.lit(0).alias("cause_source_concept_id")
    )


def observation_period(*dated: DataFrame, person: str = "person_id", date: str = "date") -> DataFrame:
    """First and last date per person over all the frames; blank dates are ignored."""
    first, *rest = [d.select(person, date) for d in dated]
    for other in rest:
        first = first.unionByName(other)
    return first.where(F.col(date).isNotNull()).groupBy(person).agg(
        F.min(date).alias("observation_period_start_date"), F.max(date).alias("observation_period_end_date")
    )


def build_observation_period(people: DataFrame, prescriptions: DataFrame, claims: DataFrame, base: int) -> DataFrame:
    dates = [
        people.select("person_id", fc.parse_date(F.col("latest.BENE_DEATH_DT")).alias("date")),
        prescriptions.select("person_id", fc.parse_date(F.col("SRVC_DT")).alias("date")),
        claims.select("person_id", F.explode(F.array(fc.parse_date(F.col("from_dt")), fc.parse_date(F.col("thru_dt")))).alias("date")),
    ]
    numbered = ids.assign_ids(observation_period(*dates), "observation_period_id", ["person_id"], base)
    return numbered.withColumn("period_type_concept_id", F.lit(fc.OBSERVATION_PERIOD_TYPE))


# --- dimensions and visits -----------------------------------------------------------------------------


def build_care_site(claims: DataFrame, known: DataFrame | None, base: int) -> DataFrame:
    """Care sites by first use; the first feed that names a site decides its place of service."""
    seen = claims.select(*CLAIM_ORDER, "feed", F.explode("sites").alias("_s"))
    seen = seen.select(*CLAIM_ORDER, "feed", F.col("_s.at").alias("at"), F.col("_s.site").alias("care_site_source_value"))
    first = keyed.first_seen(seen, ["care_site_source_value"], [*CLAIM_ORDER, "at"])
    keys = first.select(
        "care_site_source_value",
        *[fc.type_concepts(F.col("feed"), n).alias(n) for n in ("place_of_service_concept_id", "place_of_service_source_value")],
        *CLAIM_ORDER, "at",
    )
    dim = ids.upsert_dim(known, keys, ["care_site_source_value"], "care_site_id", [*CLAIM_ORDER, "at"], base)
    return dim.drop(*CLAIM_ORDER, "at")


def build_provider(claims: DataFrame, care_site: DataFrame, known: DataFrame | None, base: int) -> DataFrame:
    """Providers by first use, with the care site and the source value of that use."""
    seen = claims.select(*CLAIM_ORDER, F.explode("providers").alias("_p"))
    seen = seen.select(
        *CLAIM_ORDER, F.col("_p.at").alias("at"), F.col("_p.npi").alias("NPI"), F.col("_p.site").alias("care_site_source_value"),
        F.col("_p.source_value").alias("provider_source_value"),
    )
    first = keyed.first_seen(seen, ["NPI"], [*CLAIM_ORDER, "at"])
    keys = ids.lookup_dim(first, care_site, ["care_site_source_value"], "care_site_id")
    dim = ids.upsert_dim(known, keys.drop("care_site_source_value"), ["NPI"], "provider_id", [*CLAIM_ORDER, "at"], base)
    return dim.drop(*CLAIM_ORDER, "at")


def build_visits(claims: DataFrame, base: int) -> DataFrame:
    """Visit id per visit key, numbered by first use; the feeds share one space of keys."""
    rest = [c for c in CLAIM_ORDER if c not in VISIT_KEY]
    first = keyed.first_seen(claims.select(*VISIT_KEY, *rest), VISIT_KEY, CLAIM_ORDER)
    return ids.assign_ids(first, "visit_occurrence_id", CLAIM_ORDER, base, keep=VISIT_KEY)


def attach_visit(claims: DataFrame, visits: DataFrame, keys: list[str] = VISIT_KEY) -> DataFrame:
    return skew_join(claims, visits, keys, "left")


def resolve_claims(claims: DataFrame, visits: DataFrame, care_site: DataFrame, provider: DataFrame) -> DataFrame:
    """Claims with their codes and the ids of their visit, care site and provider; the codes go along, so they are not looked for again by row."""
    narrow = claims.select(
        *CLAIM_ORDER, "feed", "visit_site", F.col("fact_site").alias("care_site_source_value"), F.col("fact_npi").alias("NPI"), "codes"
    )
    found = attach_visit(narrow, visits)
    found = ids.lookup_dim(found, care_site, ["care_site_source_value"], "care_site_id")
    found = ids.lookup_dim(found, provider, ["NPI"], "provider_id")
    return found.drop("visit_site", "care_site_source_value", "NPI")


# --- facts -----------------------------------------------------------------------------------------------

FACT_ORDER = [*CLAIM_ORDER, "code_order", "target_order"]


def build_facts(resolved: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every code of every claim with its targets, written once for all the tables made from it."""
    coded = explode_codes(resolved, [c for c in resolved.columns if c != "codes"])
    return settle(vocab.lookup_codes(coded, mapping), compression="zstd")


def build_visit_occurrence(facts: DataFrame) -> DataFrame:
    """A row per visit of the first claim that has a code the map knows."""
    cols = ["visit_occurrence_id", "feed", "care_site_id", "provider_id", *CLAIM_ORDER]
    first = keyed.first_seen(facts.where("known").select(*cols), ["visit_occurrence_id"], CLAIM_ORDER)
    return first.select(
        "visit_occurrence_id", "person_id",
        *[fc.type_concepts(F.col("feed"), n).alias(n) for n in ("visit_concept_id", "visit_type_concept_id")],
        fc.parse_ymd(F.col("from_dt")).alias("visit_start_date"),
        fc.parse_ymd(F.col("thru_dt")).alias("visit_end_date"),
        "provider_id", "care_site_id", F.col("claim_id").alias("visit_source_value"),
    )


def _common(prefix: str) -> list[Column | str]:
    return [
        "person_id", "provider_id", "visit_occurrence_id",
        F.col("target_id").cast("long").alias(f"{prefix}_concept_id"),
        F.col("code").alias(f"{prefix}_source_value"),
        F.col("source_id").cast("long").alias(f"{prefix}_source_concept_id"),
    ]


#: Where a code's target goes, with the counter its rows are numbered by.
DESTINATIONS = {
    "condition": "condition_occurrence", "device": "device_exposure", "drug": "drug_exposure",
    "measurement": "measurement", "observation": "observation", "procedure": "procedure_occurrence",
}


#: What the fact tables and the costs take from the numbered rows.
FACT_COLUMNS = [
    "person_id", "from_dt", "thru_dt", "row_id", "feed_rank", "code", "source_id", "target_id", "provider_id", "visit_occurrence_id",
    "quantity", "days_supply",
]


def number_facts(facts: DataFrame, rx: DataFrame, at: dict[str, int]) -> dict[str, DataFrame]:
    """The rows of all fact tables with their ids, each table numbered by person, claim and code from one sorted copy.

    Prescriptions (whatever their destination) come before the drugs named in claims, per person; they carry ``rx_id``
    for the costs, as all rows carry ``row_id`` and ``feed``. :func:`to_cdm` drops what a table does not have. Both come from
    the feed's rank, so that the shuffle does not carry them.
    """
    bought = rx.where(F.col("target_id").isNotNull()).select(
        F.lit("drug").alias("destination"), "person_id", F.lit(0).alias("feed_rank"), F.col("PDE_ID").alias("claim_id"), F.lit("").alias("segment"),
        F.col("SRVC_DT").alias("from_dt"), F.lit("").alias("thru_dt"), "row_id", F.lit(0).alias("code_order"), "target_order",
        "code", "source_id", "target_id", F.col("QTY_DSPNSD_NUM").try_cast("decimal(18,4)").alias("quantity"),
        F.col("DAYS_SUPLY_NUM").try_cast("long").alias("days_supply"),
    )
    named = vocab.fact_targets(facts).select(
        "destination", *FACT_ORDER, "code", "source_id", "target_id", "provider_id", "visit_occurrence_id"
    )
    numbered = ids.assign_ids_by(union_facts([bought, named]), "destination", "fact_id", FACT_ORDER, {d: at[c] for d, c in DESTINATIONS.items()}, FACT_COLUMNS)
    rank = F.col("feed_rank")
    numbered = numbered.withColumns({"feed": F.get(F.array(*map(F.lit, FEEDS)), rank - 1), "rx_id": F.when(rank == 0, F.col("row_id"))})
    return {d: numbered.where(F.col("destination") == d).withColumnRenamed("fact_id", f"{c}_id") for d, c in DESTINATIONS.items()}


def build_condition_occurrence(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "condition_occurrence_id", *_common("condition"),
        fc.parse_ymd(F.col("from_dt")).alias("condition_start_date"), fc.parse_ymd(F.col("thru_dt")).alias("condition_end_date"),
        fc.type_concepts(F.col("feed"), "condition_type_concept_id").alias("condition_type_concept_id"),
    )


def build_procedure_occurrence(numbered: DataFrame) -> DataFrame:
    """Also carries ``row_id`` and ``feed`` for the costs; :func:`to_cdm` drops them."""
    return numbered.select(
        "procedure_occurrence_id", *_common("procedure"), fc.parse_ymd(F.col("from_dt")).alias("procedure_date"),
        fc.type_concepts(F.col("feed"), "procedure_type_concept_id").alias("procedure_type_concept_id"), "row_id", "feed",
    )


def build_measurement_occurrence(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "measurement_id", *_common("measurement"), fc.parse_ymd(F.col("from_dt")).alias("measurement_date"),
        F.lit(fc.MEASUREMENT_TYPE).alias("measurement_type_concept_id"), F.lit(0).alias("value_as_concept_id"),
    )


def build_observation(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "observation_id", *_common("observation"), fc.parse_ymd(F.col("from_dt")).alias("observation_date"),
        F.lit(fc.OBSERVATION_TYPE).alias("observation_type_concept_id"), F.lit(0).alias("value_as_concept_id"),
    )


def build_device_exposure(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "device_exposure_id", *_common("device"),
        fc.parse_ymd(F.col("from_dt")).alias("device_exposure_start_date"), fc.parse_ymd(F.col("thru_dt")).alias("device_exposure_end_date"),
        F.lit(fc.DEVICE_TYPE).alias("device_type_concept_id"),
    )


def procedure_costs(procedures: DataFrame, claims: DataFrame) -> DataFrame:
    """Each carrier procedure with each line of its claim that carries an amount."""
    lines = claims.where(F.col("feed") == "carrier").select(
        "row_id", F.explode(F.filter("lines", fc.has_nonzero_amount)).alias("_l")
    )
    carrier = procedures.where(F.col("feed") == "carrier").select("procedure_occurrence_id", "row_id")
    money = {
        "paid_coinsurance": "LINE_COINSRNC_AMT",
        "paid_toward_deductible": "LINE_BENE_PTB_DDCTBL_AMT",
        "paid_by_payer": "LINE_NCH_PMT_AMT",
        "paid_by_coordination_benefits": "LINE_BENE_PRMRY_PYR_PD_AMT",
        "total_paid": "LINE_ALOWD_CHRG_AMT",
    }
    return carrier.join(lines, "row_id").select(
        "procedure_occurrence_id", F.col("_l.line").alias("line"), F.lit(fc.US_DOLLAR).alias("currency_concept_id"),
        *[F.col(f"_l.{c}").try_cast("decimal(18,4)").alias(n) for n, c in money.items()],
        fc.out_of_pocket(F.col("_l")).alias("total_out_of_pocket"),
    )


def build_procedure_cost(procedures: DataFrame, claims: DataFrame, base: int) -> DataFrame:
    costs = procedure_costs(procedures, claims)
    return ids.assign_ids(costs, "procedure_cost_id", ["procedure_occurrence_id", "line"], base, pieces(costs.sparkSession))


def union_facts(dfs: list[DataFrame]) -> DataFrame:
    first, *rest = dfs
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def prescription_codes(prescriptions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Prescriptions with the targets of their drug code; unknown codes get concept 0. The conversion reads it once, so it is not written."""
    coded = prescriptions.withColumn("vocab", F.lit(NDC)).withColumn("code", F.col("PROD_SRVC_ID"))
    found = vocab.lookup_codes(coded, mapping)
    for c in ("source_id", "target_id"):
        found = found.withColumn(c, F.when(F.col("known"), F.col(c)).otherwise(F.lit(0).cast(mapping.schema[c].dataType)))
    return found


def build_drug_exposure(numbered: DataFrame) -> DataFrame:
    """Carries ``rx_id`` for the costs; :func:`to_cdm` drops it."""
    return numbered.select(
        "drug_exposure_id", *_common("drug"), fc.parse_ymd(F.col("from_dt")).alias("drug_exposure_start_date"),
        F.lit(fc.DRUG_TYPE).alias("drug_type_concept_id"), "quantity", "days_supply", "rx_id",
    )


def build_drug_cost(prescriptions: DataFrame, drug_exposure: DataFrame, base: int) -> DataFrame:
    """One row per prescription, tied to the last exposure it wrote (none: no exposure id)."""
    last = drug_exposure.where(F.col("rx_id").isNotNull()).groupBy(F.col("rx_id").alias("row_id")).agg(
        F.max("drug_exposure_id").alias("drug_exposure_id")
    )
    bought = prescriptions.select("row_id", "person_id", "PDE_ID", "SRVC_DT", "PTNT_PAY_AMT", "TOT_RX_CST_AMT")
    costs = bought.join(last, "row_id", "left")
    written = ["drug_exposure_id", "PTNT_PAY_AMT", "TOT_RX_CST_AMT"]
    numbered = ids.assign_ids(costs, "drug_cost_id", ["person_id", "PDE_ID", "SRVC_DT", "row_id"], base, pieces(costs.sparkSession), written)
    paid = F.col("PTNT_PAY_AMT").try_cast("decimal(18,4)")
    return numbered.select(
        "drug_cost_id", "drug_exposure_id", F.lit(fc.US_DOLLAR).alias("currency_concept_id"), paid.alias("paid_coinsurance"),
        paid.alias("total_out_of_pocket"), F.col("TOT_RX_CST_AMT").try_cast("decimal(18,4)").alias("total_paid"),
    )


def unmapped_log(facts: DataFrame, rx: DataFrame) -> DataFrame:
    """The codes that were not found: feed, vocabulary, code and person."""
    claims = facts.where(~F.col("known")).select("feed", "vocab", "code", "person_id")
    drugs = rx.where(~F.col("known")).select(F.lit("prescription").alias("feed"), "vocab", "code", "person_id")
    return claims.unionByName(drugs)


def append_unmapped(log: DataFrame, path: str) -> None:
    """Add to the log of unknown codes, which grows over the samples."""
    log.write.mode("append").parquet(path)


def to_cdm(df: DataFrame, table: str) -> DataFrame:
    """The columns of a CDM table in order, cast to its types; columns the frame lacks are NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in S.cdm_schema(table)
        ]
    )


# --- the whole flow --------------------------------------------------------------------------------------


def _tie(person_ids: DataFrame, feed: DataFrame) -> DataFrame:
    """Rows of known persons with a row id, written once.

    The id is taken while the feed is read, where a repeated task sees the same rows in the same order.
    """
    rows = feed.withColumn("row_id", F.monotonically_increasing_id())
    return settle(attach_claims(person_ids, rows, PERSON).drop(PERSON), compression="zstd")


@dataclass
class ClaimsInput:
    """The feeds and the vocabulary, each read straight from files or tables; ``prescription_read`` is called when that feed is not read again."""

    beneficiary: DataFrame
    inpatient: DataFrame
    outpatient: DataFrame
    carrier: DataFrame
    prescription: DataFrame
    concept: DataFrame
    relationship: DataFrame
    years: list[str] = field(default_factory=lambda: ["2008", "2009", "2010"])
    prescription_read: Callable[[], None] = lambda: None


@dataclass
class Carried:
    """What one sample hands on to the next."""

    state: dict[str, int] = field(default_factory=lambda: dict.fromkeys(ids.COUNTERS, ids.FIRST_ID))
    location: DataFrame | None = None
    care_site: DataFrame | None = None
    provider: DataFrame | None = None


@dataclass
class ClaimsOutput:
    tables: dict[str, DataFrame]
    unmapped: DataFrame
    visits: DataFrame
    people: DataFrame
    dims: dict[str, DataFrame]
    started_at: dict[str, int]

    def carried(self) -> Carried:
        """The counters after this sample and the dimensions as they are now."""
        state = dict(self.started_at)
        numbered = {**self.tables, **self.dims, "visit_occurrence": self.visits, "person": self.people}
        for counter in ids.COUNTERS:
            table = numbered["measurement_occurrence" if counter == "measurement" else counter]
            state[counter] = ids.next_id(table, f"{counter}_id", state[counter])
        return Carried(state, **{name: dim.drop("is_new") for name, dim in self.dims.items()})


def claims_to_cdm(given: ClaimsInput, carried: Carried | None = None) -> ClaimsOutput:
    """All output tables of one set of feeds; ids continue from ``carried``."""
    spark = given.beneficiary.sparkSession
    carried = carried or Carried()
    at = carried.state

    def ties(person_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One after the other: these shuffles carry whole rows, and the disk need not hold both."""
        rows = has_service_date(conform(skip_header_rows(given.prescription), "prescription"), "SRVC_DT")
        scripts = _tie(person_ids, rows)
        given.prescription_read()
        return scripts, _tie(person_ids, union_facts([claim_rows(k, getattr(given, k)) for k in FEEDS]))

    first = together(
        spark,
        mapping=lambda: settle(vocab.concept_map(given.concept, given.relationship)),
        people=lambda: build_people(given.beneficiary, given.years, at["person"]),
    )
    mapping, people = first["mapping"], first["people"]
    person_ids = people.select(PERSON, "person_id")
    tied = together(
        spark,
        ties=lambda: ties(person_ids),
        location=lambda: build_location(people, carried.location, at["location"]),
        payer_plan_period=lambda: build_payer_plan_period(people, given.years, at["payer_plan_period"]),
    )
    (scripts, claims), location = tied["ties"], tied["location"]

    def places() -> tuple[DataFrame, DataFrame]:
        site = build_care_site(claims, carried.care_site, at["care_site"])
        return site, build_provider(claims, site, carried.provider, at["provider"])

    found = together(
        spark,
        places=places,
        visits=lambda: build_visits(claims, at["visit_occurrence"]),
        observation_period=lambda: build_observation_period(people, scripts, claims, at["observation_period"]),
        person=lambda: build_person(people, location),
    )
    (care_site, provider), visits = found["places"], found["visits"]
    rx = prescription_codes(scripts, mapping)
    facts = build_facts(resolve_claims(claims, visits, care_site, provider), mapping)

    numbered = number_facts(facts, rx, at)
    procedures, drugs = build_procedure_occurrence(numbered["procedure"]), build_drug_exposure(numbered["drug"])
    costs = together(
        spark,
        procedure_cost=lambda: build_procedure_cost(procedures, claims, at["procedure_cost"]),
        drug_cost=lambda: build_drug_cost(scripts, drugs, at["drug_cost"]),
    )
    built = {
        **costs,
        "procedure_occurrence": procedures,
        "drug_exposure": drugs,
        "condition_occurrence": build_condition_occurrence(numbered["condition"]),
        "device_exposure": build_device_exposure(numbered["device"]),
        "measurement_occurrence": build_measurement_occurrence(numbered["measurement"]),
        "observation": build_observation(numbered["observation"]),
        "person": found["person"],
        "observation_period": found["observation_period"],
        "death": build_death(people),
        "visit_occurrence": build_visit_occurrence(facts),
        "location": location.where("is_new"),
        "care_site": care_site.where("is_new"),
        "provider": provider.where("is_new"),
        "payer_plan_period": tied["payer_plan_period"],
    }
    tables = {
        t: to_cdm(built[t], t) if t in built else spark.createDataFrame([], S.cdm_schema(t)) for t in S.OUTPUT_TABLES
    }
    dims = {"location": location, "care_site": care_site, "provider": provider}
    return ClaimsOutput(tables, unmapped_log(facts, rx), visits, people, dims, dict(at))
