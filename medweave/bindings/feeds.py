"""The claims conversion: customers as beneficiaries, orders as claims, lines as prescriptions, parts as vocabulary.

The feeds are written in SQL that both engines read; what is made of them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from medweave.bindings.common import ORACLE, Tables, query
from medweave.bindings.vocab import DOMAINS
from medweave.functions.vocabulary import DESTINATION
from medweave.operators.keys import key_report
from medweave.plans import claims as C
from medweave.schemas import CDM_TABLES, OUTPUT_TABLES, cdm_rules, cdm_schema
from medweave.session import discard, new_folder, settle

_DOMAIN_ROWS = ", ".join(f"({i}, '{d}')" for i, d in enumerate(DOMAINS))
_ROUTES = ", ".join(f"('{k}', '{v}')" for k, v in DESTINATION.items())


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _pad(expr: str, n: int) -> str:
    return f"lpad({_s(expr)}, {n}, '0')"


_PERSON = f"'P' || {_pad('{key}', 9)} AS DESYNPUF_ID"
_CLAIM = f"""
  {_PERSON.format(key='o_custkey')}, {_pad('o_orderkey', 10)} AS CLM_ID,
  CASE WHEN o_totalprice < 5000 THEN '' ELSE {_s('year(o_orderdate)')} || '0101' END AS CLM_FROM_DT,
  {_s('year(o_orderdate)')} || '0104' AS CLM_THRU_DT"""
_SITE = f"CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'H' || {_s('(o_custkey * 2 + o_orderkey % 2) % 50')} END"
_NPIS = f"""
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'N' || {_s('o_orderkey % 97')} END AS AT_PHYSN_NPI,
  CASE WHEN o_orderkey % 3 = 0 THEN 'N' || {_s('o_orderkey % 53')} ELSE '' END AS OP_PHYSN_NPI,
  CASE WHEN o_orderkey % 7 = 0 THEN 'N' || {_s('o_orderkey % 31')} ELSE '' END AS OT_PHYSN_NPI"""
_FACILITY_CODES = f"""
  'D' || {_s('o_orderkey * 7 % 400')} AS ICD9_DGNS_CD_1,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'D' || {_s('o_custkey * 5 % 400')} END AS ICD9_DGNS_CD_2,
  'D' || {_s('o_orderkey * 3 % 400')} AS ICD9_DGNS_CD_10, 'Q' || {_s('o_orderkey % 90')} AS ICD9_PRCDR_CD_1,
  'J' || {_s('o_custkey % 150')} AS HCPCS_CD_1, 'J' || {_s('o_orderkey % 150')} AS HCPCS_CD_45"""


def _line(i: int, blank: int, tax: str) -> str:
    amount = f"CASE WHEN o_orderkey % 6 = {i % 6} THEN '' WHEN o_orderkey % 4 = 1 THEN '0.00' ELSE {_s(f'o_orderkey % {40 + i}')} END"
    return f"""
  CASE WHEN o_orderkey % {blank} = 0 THEN '' ELSE 'N' || {_s(f'(o_orderkey + {i}) % 97')} END AS PRF_PHYSN_NPI_{i}, {tax} AS TAX_NUM_{i},
  'J' || {_s(f'(o_orderkey + {i}) % 150')} AS HCPCS_CD_{i}, {amount} AS LINE_NCH_PMT_AMT_{i}, {amount} AS LINE_BENE_PTB_DDCTBL_AMT_{i},
  '' AS LINE_BENE_PRMRY_PYR_PD_AMT_{i}, CASE WHEN o_orderkey % 6 = {i % 6} THEN '' ELSE '12.50' END AS LINE_COINSRNC_AMT_{i},
  {amount} AS LINE_ALOWD_CHRG_AMT_{i}, CASE WHEN o_orderkey % 8 = {i % 8} THEN 'D' || {_s('o_orderkey % 400')} ELSE '' END AS LINE_ICD9_DGNS_CD_{i}"""


LINES = (1, 2, 13)
# Year, and whether it is a second record of it; who has no record of that year (or only has the second one).
YEARS = (("2008", "0", "c_nationkey <> 9"), ("2009", "0", "c_nationkey <> 5"), ("2010", "0", "c_nationkey <> 3"), ("2009", "1", "c_nationkey = 1"))


def _beneficiary(yr: str, dup: str, who: str) -> str:
    return f"""
SELECT '{yr}' AS FILE_YEAR, {_PERSON.format(key='c_custkey')},
  '19' || {_pad('20 + c_custkey % 60', 2)} || {_pad('1 + c_custkey % 12', 2)} || {_pad('1 + c_custkey % 28', 2)} AS BENE_BIRTH_DT,
  CASE WHEN c_nationkey = 4 AND {yr} = 2010 THEN '20100715' ELSE '' END AS BENE_DEATH_DT,
  {_s('1 + c_custkey % 3')} AS BENE_SEX_IDENT_CD, {_s('c_custkey % 6')} AS BENE_RACE_CD,
  {_pad('1 + c_nationkey', 2)} AS SP_STATE_CODE, {_s(f'(c_custkey + {yr} + {dup} * 7) % 150')} AS BENE_COUNTY_CD,
  {_s(f'(c_custkey + {yr}) % 14')} AS BENE_HI_CVRAGE_TOT_MONS,
  {_s(f"CASE WHEN c_mktsegment = 'BUILDING' THEN 12 ELSE (c_custkey * {yr}) % 13 END")} AS BENE_SMI_CVRAGE_TOT_MONS,
  {_s(f'(c_custkey * 3 + {yr}) % 13')} AS BENE_HMO_CVRAGE_TOT_MONS,
  {_s(f'CASE WHEN (c_custkey + {yr}) % 3 = 0 THEN 5 ELSE 12 END')} AS PLAN_CVRG_MOS_NUM
FROM {{customer}} WHERE c_acctbal >= 0 AND {who}"""


def _relationship(j: int, who: str) -> str:
    return f"""
SELECT p_partkey AS concept_id_1, CAST(floor(p_partkey / 4) AS BIGINT) * 4 + 3 + 4 * {j} AS concept_id_2,
  CASE WHEN p_partkey % 13 = 0 THEN 'Mapped from' ELSE 'Maps to' END AS relationship_id, CASE WHEN p_partkey % 11 = 0 THEN 'D' ELSE '' END AS invalid_reason,
  p_partkey * 10 + {j} AS ordinal
FROM {{part}} WHERE p_partkey % 4 <> 3 AND p_partkey % 3 <> 0 AND {who}"""


FEED_SQL = {
    "beneficiary": " UNION ALL ".join(_beneficiary(*part) for part in YEARS),
    "inpatient": f"SELECT {_CLAIM}, '1' AS SEGMENT, {_SITE} AS PRVDR_NUM, {_NPIS}, {_FACILITY_CODES} FROM {{orders}} WHERE o_orderstatus = 'F'",
    "outpatient": f"""SELECT {_CLAIM}, '1' AS SEGMENT, {_SITE} AS PRVDR_NUM, {_NPIS}, {_FACILITY_CODES},
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'D' || {_s('o_custkey % 400')} END AS ADMTNG_ICD9_DGNS_CD FROM {{orders}} WHERE o_orderstatus = 'O'""",
    "carrier": f"""SELECT {_CLAIM}, 'D' || {_s('o_orderkey * 7 % 400')} AS ICD9_DGNS_CD_1, 'D' || {_s('o_custkey % 400')} AS ICD9_DGNS_CD_8,
  {_line(1, 5, _SITE)}, {_line(2, 4, "'T' || " + _s('o_orderkey % 30'))}, {_line(13, 3, "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'T' || " + _s('o_custkey % 30') + ' END')}
  FROM {{orders}} WHERE o_orderstatus = 'P'""",
    "prescription": f"""SELECT {_PERSON.format(key='o_custkey')},
  {_pad('l_orderkey', 10)} || '-' || {_s('l_linenumber')} || '-' || {_s('l_partkey')} || '-' || {_s('l_suppkey')} || '-' || {_s('CAST(floor(l_extendedprice) AS BIGINT)')} || '-' || l_returnflag AS PDE_ID,
  CASE WHEN l_tax = 0 THEN '' ELSE {_s('year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate)')} END AS SRVC_DT,
  'DRUG' || {_s('l_partkey % 300')} AS PROD_SRVC_ID, {_s('CAST(l_quantity AS INT)')} AS QTY_DSPNSD_NUM,
  {_s('CAST(l_quantity AS INT) % 30')} AS DAYS_SUPLY_NUM, {_s('l_linenumber * 10')} AS PTNT_PAY_AMT, {_s('CAST(floor(l_extendedprice) AS BIGINT)')} AS TOT_RX_CST_AMT
FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey""",
    "concept": f"""
SELECT concept_id, domain_id, vocabulary_id, concept_code, concept_id AS ordinal FROM (
  SELECT p_partkey AS concept_id, p_partkey % {len(DOMAINS)} AS d,
    CASE p_partkey % 4 WHEN 0 THEN 'ICD9CM' WHEN 1 THEN (CASE WHEN p_partkey % 8 = 1 THEN 'HCPCS' ELSE 'CPT4' END) WHEN 2 THEN 'NDC' ELSE 'SNOMED' END AS vocabulary_id,
    CASE p_partkey % 4 WHEN 0 THEN 'D.' || {_s('CAST(floor(p_partkey / 4) AS BIGINT) % 350')} WHEN 1 THEN 'J' || {_s('CAST(floor(p_partkey / 4) AS BIGINT) % 140')}
      ELSE 'DRUG' || {_s('CAST(floor(p_partkey / 4) AS BIGINT) % 280')} END AS concept_code FROM {{part}}
  UNION ALL SELECT -1 - s_suppkey, s_suppkey % {len(DOMAINS)}, 'ICD9Proc', 'Q.' || {_s('s_suppkey % 80')} FROM {{supplier}}) s
JOIN (VALUES {_DOMAIN_ROWS}) AS dm(i, domain_id) ON i = d""",
    "relationship": _relationship(0, "true") + " UNION ALL " + _relationship(1, "p_partkey % 5 = 0"),
}
_SOURCES = ("customer", "orders", "lineitem", "part", "supplier")


def feed(t: Tables, name: str) -> DataFrame:
    used = {s: getattr(t, s) for s in _SOURCES if "{" + s + "}" in FEED_SQL[name]}
    return t.spark.sql(FEED_SQL[name], **used)


def given(t: Tables) -> C.ClaimsInput:
    """The feeds as the conversion wants them: read straight from tables (the joined one is written first, and deleted when it is read)."""
    path = new_folder(t.spark, "settled")
    joined = {"prescription": settle(feed(t, "prescription"), compression="zstd", path=path)}
    return C.ClaimsInput(**{name: joined.get(name) or feed(t, name) for name in FEED_SQL}, prescription_read=lambda: discard(t.spark, path))


_done: dict[tuple[str, str], C.ClaimsOutput] = {}


def flow(t: Tables) -> C.ClaimsOutput:
    """The conversion, run once per session and folder; the result is on disk."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _done:
        _done[key] = C.claims_to_cdm(given(t))
    return _done[key]


# --- the same in SQL -------------------------------------------------------------------------------------------

_FEEDS = ",\n".join(f"{name} AS ({sql.format(**{s: s for s in _SOURCES})})" for name, sql in FEED_SQL.items())
_ORDER = "person_id, feed_rank, CLM_ID"


def _code_rows(feed_name: str, rank: int, cols: list[tuple[str, str]]) -> str:
    parts = [f"SELECT DESYNPUF_ID, {rank} AS feed_rank, '{feed_name}' AS feed, CLM_ID, CLM_FROM_DT, {i} AS pos, '{v}' AS vocab, {c} AS code FROM {feed_name}" for i, (v, c) in enumerate(cols)]
    return " UNION ALL ".join(parts)


_FAC = [("ICD9", "ICD9_DGNS_CD_1"), ("ICD9", "ICD9_DGNS_CD_2"), ("ICD9", "ICD9_DGNS_CD_10"), ("ICD9", "ICD9_PRCDR_CD_1"), ("HCPCS", "HCPCS_CD_1"), ("HCPCS", "HCPCS_CD_45")]
_CAR = [("ICD9", "ICD9_DGNS_CD_1"), ("ICD9", "ICD9_DGNS_CD_8"), *[("HCPCS", f"HCPCS_CD_{i}") for i in LINES], *[("ICD9", f"LINE_ICD9_DGNS_CD_{i}") for i in LINES]]


def _uses(feed_name: str, rank: int) -> str:
    phys = " UNION ALL ".join(
        f"SELECT DESYNPUF_ID, {rank} AS feed_rank, '{feed_name}' AS feed, CLM_ID, CLM_FROM_DT, {i} AS slot, nullif(PRVDR_NUM, '') AS site, {n}_PHYSN_NPI AS npi, AT_PHYSN_NPI AS source_value FROM {feed_name}"
        for i, n in enumerate(("AT", "OP", "OT"))
    )
    return phys


_CARRIER_USES = " UNION ALL ".join(
    f"SELECT DESYNPUF_ID, 3 AS feed_rank, 'carrier' AS feed, CLM_ID, CLM_FROM_DT, {i} AS slot, nullif(TAX_NUM_{i}, '') AS site, PRF_PHYSN_NPI_{i} AS npi, PRF_PHYSN_NPI_{i} AS source_value FROM carrier WHERE PRF_PHYSN_NPI_{i} <> ''"
    for i in LINES
)


def _facility(feed_name: str, rank: int) -> str:
    return f"""SELECT DESYNPUF_ID, {rank} AS feed_rank, '{feed_name}' AS feed, CLM_ID, CLM_FROM_DT, CLM_THRU_DT, PRVDR_NUM AS site_key, nullif(PRVDR_NUM, '') AS fact_site,
    coalesce(nullif(OT_PHYSN_NPI, ''), nullif(OP_PHYSN_NPI, ''), nullif(AT_PHYSN_NPI, '')) AS fact_npi FROM {feed_name}"""


_LAST = "CASE " + " ".join(f"WHEN PRF_PHYSN_NPI_{i} <> '' THEN nullif({{}}_{i}, '')" for i in reversed(LINES)) + " END"

PRELUDE = f"""WITH {_FEEDS},
yearly AS (SELECT * FROM beneficiary QUALIFY row_number() OVER (PARTITION BY DESYNPUF_ID, FILE_YEAR ORDER BY BENE_COUNTY_CD || ',') = 1),
ids AS (SELECT DESYNPUF_ID, row_number() OVER (ORDER BY DESYNPUF_ID) AS person_id FROM (SELECT DISTINCT DESYNPUF_ID FROM beneficiary)),
latest AS (SELECT * FROM yearly JOIN ids USING (DESYNPUF_ID) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY FILE_YEAR DESC) = 1),
earliest AS (SELECT person_id, SP_STATE_CODE, BENE_COUNTY_CD FROM yearly JOIN ids USING (DESYNPUF_ID) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY FILE_YEAR) = 1),
places AS (SELECT SP_STATE_CODE || '-' || BENE_COUNTY_CD AS location_source_value, SP_STATE_CODE AS st, BENE_COUNTY_CD AS co, row_number() OVER (ORDER BY min(person_id)) AS location_id FROM earliest GROUP BY ALL),
claims AS (SELECT person_id, c.* EXCLUDE (DESYNPUF_ID) FROM (
  {_facility('inpatient', 1)} UNION ALL {_facility('outpatient', 2)} UNION ALL
  SELECT DESYNPUF_ID, 3, 'carrier', CLM_ID, CLM_FROM_DT, CLM_THRU_DT, TAX_NUM_1, {_LAST.format(*['TAX_NUM'] * 3)}, {_LAST.format(*['PRF_PHYSN_NPI'] * 3)} FROM carrier) c
  JOIN ids USING (DESYNPUF_ID) WHERE CLM_FROM_DT <> ''),
uses AS (SELECT person_id, u.* FROM ({_uses('inpatient', 1)} UNION ALL {_uses('outpatient', 2)} UNION ALL {_CARRIER_USES}) u JOIN ids USING (DESYNPUF_ID) WHERE CLM_FROM_DT <> ''),
sites AS (SELECT * FROM uses WHERE site IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site ORDER BY {_ORDER}, slot) = 1),
care AS (SELECT row_number() OVER (ORDER BY {_ORDER}, slot) AS care_site_id, site, feed FROM sites),
npis AS (SELECT * FROM uses WHERE npi <> '' QUALIFY row_number() OVER (PARTITION BY npi ORDER BY {_ORDER}, slot) = 1),
prov AS (SELECT row_number() OVER (ORDER BY {_ORDER}, slot) AS provider_id, npi, site, source_value FROM npis),
visit_first AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY person_id, CLM_FROM_DT, CLM_THRU_DT, site_key ORDER BY {_ORDER}) = 1),
visit AS (SELECT row_number() OVER (ORDER BY {_ORDER}) AS visit_occurrence_id, person_id, CLM_FROM_DT, CLM_THRU_DT, site_key FROM visit_first),
resolved AS (SELECT c.*, visit_occurrence_id, care_site_id, provider_id FROM claims c
  JOIN visit v USING (person_id, CLM_FROM_DT, CLM_THRU_DT, site_key) LEFT JOIN care ON care.site = c.fact_site LEFT JOIN prov ON prov.npi = c.fact_npi),
routes(domain_id, destination) AS (VALUES {_ROUTES}),
maps_to AS (SELECT * FROM relationship WHERE relationship_id = 'Maps to' AND invalid_reason = ''),
sources AS (SELECT concept_id, replace(concept_code, '.', '') AS code, destination AS own, concept_id IN (SELECT concept_id_1 FROM maps_to) AS linked,
  CASE vocabulary_id WHEN 'CPT4' THEN 'HCPCS' WHEN 'ICD9CM' THEN 'ICD9' WHEN 'ICD9Proc' THEN 'ICD9' ELSE vocabulary_id END AS vocab FROM concept LEFT JOIN routes USING (domain_id)),
winners AS (SELECT * FROM sources WHERE vocab IN ('ICD9', 'HCPCS', 'NDC') AND (linked OR own IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY vocab, code ORDER BY concept_id DESC) = 1),
mapping AS (
  SELECT vocab, code, concept_id AS source_id, 0 AS target_id, own AS destination, NULL AS target_order FROM winners WHERE NOT linked UNION ALL
  SELECT vocab, code, w.concept_id, x.concept_id_2, x.destination, x.ordinal FROM winners w
  LEFT JOIN (SELECT m.*, destination FROM maps_to m JOIN concept c ON c.concept_id = m.concept_id_2 JOIN routes USING (domain_id)) x ON x.concept_id_1 = w.concept_id WHERE linked),
coded AS (SELECT r.*, pos, vocab, code FROM ({_code_rows('inpatient', 1, _FAC)} UNION ALL {_code_rows('outpatient', 2, [('ICD9', 'ADMTNG_ICD9_DGNS_CD'), *_FAC])} UNION ALL {_code_rows('carrier', 3, _CAR)}) k
  JOIN ids USING (DESYNPUF_ID) JOIN resolved r ON r.person_id = ids.person_id AND r.CLM_ID = k.CLM_ID AND r.feed_rank = k.feed_rank WHERE code <> ''),
facts AS (SELECT coded.*, m.vocab IS NOT NULL AS known, source_id, target_id, destination, target_order FROM coded LEFT JOIN mapping m USING (vocab, code)),
scripts AS (SELECT person_id, p.* FROM prescription p JOIN ids USING (DESYNPUF_ID) WHERE SRVC_DT <> ''),
rx AS (SELECT s.*, m.vocab IS NOT NULL AS known, CASE WHEN m.vocab IS NULL THEN 0 ELSE source_id END AS source_id, CASE WHEN m.vocab IS NULL THEN 0 ELSE target_id END AS target_id, target_order
  FROM scripts s LEFT JOIN mapping m ON m.vocab = 'NDC' AND m.code = PROD_SRVC_ID)
"""


def _date(c: str) -> str:
    return f"CAST(strptime({c}, '%Y%m%d') AS DATE)"


def _fact(destination: str, id_col: str, prefix: str, extra: str) -> str:
    return f"""{PRELUDE} SELECT row_number() OVER (ORDER BY {_ORDER}, pos, target_order NULLS FIRST) AS {id_col}, person_id, provider_id, visit_occurrence_id,
      target_id AS {prefix}_concept_id, code AS {prefix}_source_value, source_id AS {prefix}_source_concept_id, {extra}
      FROM facts WHERE destination = '{destination}' AND target_id IS NOT NULL"""


def _by_feed(inpatient, outpatient, carrier) -> str:
    return f"CASE feed WHEN 'inpatient' THEN {inpatient} WHEN 'outpatient' THEN {outpatient} ELSE {carrier} END"


FILLED: dict[str, list[str]] = {}


def _table(name: str, columns: str, sql: str, key: str | None = None) -> None:
    """Register an output table with the columns that can be filled; concept ids are long."""
    wide = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns.split() if c.endswith("_concept_id"))
    sql = f"SELECT * REPLACE ({wide}) FROM ({sql})" if wide else sql
    FILLED[name] = columns.split()

    @query(key or f"cdm_{name}", sql)
    def run(t, name=name, columns=columns):
        df = flow(t).tables[name].select(*columns.split())
        doubles = [F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema]
        return df.select(*doubles)


_table(
    "person",
    "person_id gender_concept_id year_of_birth month_of_birth day_of_birth race_concept_id ethnicity_concept_id location_id person_source_value gender_source_value race_source_value ethnicity_source_value",
    f"""{PRELUDE} SELECT l.person_id, CASE BENE_SEX_IDENT_CD WHEN '1' THEN 8507 WHEN '2' THEN 8532 ELSE 0 END AS gender_concept_id,
    CAST(substr(BENE_BIRTH_DT, 1, 4) AS BIGINT) AS year_of_birth, CAST(substr(BENE_BIRTH_DT, 5, 2) AS BIGINT) AS month_of_birth, CAST(substr(BENE_BIRTH_DT, 7, 2) AS BIGINT) AS day_of_birth,
    CASE BENE_RACE_CD WHEN '1' THEN 8527 WHEN '2' THEN 8516 ELSE 0 END AS race_concept_id,
    CASE WHEN BENE_RACE_CD IN ('1', '2', '3') THEN 38003564 WHEN BENE_RACE_CD = '5' THEN 38003563 ELSE 0 END AS ethnicity_concept_id,
    location_id, DESYNPUF_ID AS person_source_value, BENE_SEX_IDENT_CD AS gender_source_value, BENE_RACE_CD AS race_source_value, BENE_RACE_CD AS ethnicity_source_value
    FROM latest l JOIN earliest e ON e.person_id = l.person_id JOIN places ON st = e.SP_STATE_CODE AND co = e.BENE_COUNTY_CD""",
)
_STATE_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in C.fc.SSA_STATE.items())
_table(
    "location", "location_id state county location_source_value",
    f"""{PRELUDE}, m(c, abbr) AS (VALUES {_STATE_ROWS}) SELECT location_id, coalesce(abbr, st) AS state, st || lpad(co, 3, '0') AS county, location_source_value
    FROM places LEFT JOIN m ON c = st""",
)
_table(
    "death", "person_id death_date death_type_concept_id cause_source_concept_id",
    f"{PRELUDE} SELECT person_id, {_date('BENE_DEATH_DT')} AS death_date, 38003565 AS death_type_concept_id, 0 AS cause_source_concept_id FROM latest WHERE BENE_DEATH_DT <> ''",
)
_table(
    "observation_period", "observation_period_id person_id observation_period_start_date observation_period_end_date period_type_concept_id",
    f"""{PRELUDE}, d AS (SELECT person_id, BENE_DEATH_DT AS d FROM latest WHERE BENE_DEATH_DT <> '' UNION ALL SELECT person_id, SRVC_DT FROM scripts
    UNION ALL SELECT person_id, CLM_FROM_DT FROM claims UNION ALL SELECT person_id, CLM_THRU_DT FROM claims)
    SELECT row_number() OVER (ORDER BY person_id) AS observation_period_id, person_id, {_date('min(d)')} AS observation_period_start_date,
    {_date('max(d)')} AS observation_period_end_date, 44814722 AS period_type_concept_id FROM d GROUP BY person_id""",
)


def _periods_sql() -> str:
    from medweave.bindings.people import _plan_periods

    parts = []
    for i, (plan, col) in enumerate(C.PLANS.items()):
        months = ", ".join(f"coalesce(max(CASE WHEN FILE_YEAR = '{y}' THEN CAST({col} AS INTEGER) END), 0) AS {n}" for n, y in zip("abc", (2008, 2009, 2010)))
        parts.append(f"SELECT person_id, {i} AS plan_order, '{plan}' AS plan_source_value, {months} FROM yearly JOIN ids USING (DESYNPUF_ID) GROUP BY person_id")
    rule = _plan_periods("cov", "person_id, plan_order, plan_source_value", 2008)
    return f"""{PRELUDE}, cov AS ({' UNION ALL '.join(parts)}), periods AS ({rule})
    SELECT row_number() OVER (ORDER BY person_id, plan_order, "start") AS payer_plan_period_id, person_id, "start" AS payer_plan_period_start_date,
    "end" AS payer_plan_period_end_date, plan_source_value FROM periods"""


_table("payer_plan_period", "payer_plan_period_id person_id payer_plan_period_start_date payer_plan_period_end_date plan_source_value", _periods_sql())
_table(
    "care_site", "care_site_id place_of_service_concept_id care_site_source_value place_of_service_source_value",
    f"""{PRELUDE} SELECT care_site_id, {_by_feed(8717, 8756, 8940)} AS place_of_service_concept_id, site AS care_site_source_value,
    {_by_feed("'Inpatient Facility'", "'Outpatient Facility'", "' '")} AS place_of_service_source_value FROM care""",
)
_table(
    "provider", "provider_id NPI care_site_id provider_source_value",
    f"{PRELUDE} SELECT provider_id, npi AS NPI, care_site_id, source_value AS provider_source_value FROM prov LEFT JOIN care USING (site)",
)
_table(
    "visit_occurrence", "visit_occurrence_id person_id visit_concept_id visit_start_date visit_end_date visit_type_concept_id provider_id care_site_id visit_source_value",
    f"""{PRELUDE}, w AS (SELECT * FROM facts WHERE known QUALIFY row_number() OVER (PARTITION BY visit_occurrence_id ORDER BY {_ORDER}) = 1)
    SELECT visit_occurrence_id, person_id, {_by_feed(9201, 9202, 0)} AS visit_concept_id, {_date('CLM_FROM_DT')} AS visit_start_date, {_date('CLM_THRU_DT')} AS visit_end_date,
    44818517 AS visit_type_concept_id, provider_id, care_site_id, CLM_ID AS visit_source_value FROM w""",
)
_COMMON = "{id} person_id provider_id visit_occurrence_id {p}_concept_id {p}_source_value {p}_source_concept_id "


def _facts_table(table: str, destination: str, id_col: str, prefix: str, columns: str, extra: str) -> None:
    _table(table, _COMMON.format(id=id_col, p=prefix) + columns, _fact(destination, id_col, prefix, extra))


_facts_table(
    "condition_occurrence", "condition", "condition_occurrence_id", "condition", "condition_start_date condition_end_date condition_type_concept_id",
    f"{_date('CLM_FROM_DT')} AS condition_start_date, {_date('CLM_THRU_DT')} AS condition_end_date, {_by_feed(38000200, 38000230, 38000230)} AS condition_type_concept_id",
)
_facts_table(
    "procedure_occurrence", "procedure", "procedure_occurrence_id", "procedure", "procedure_date procedure_type_concept_id",
    f"{_date('CLM_FROM_DT')} AS procedure_date, {_by_feed(38000251, 38000269, 38000269)} AS procedure_type_concept_id",
)
_facts_table(
    "measurement_occurrence", "measurement", "measurement_id", "measurement", "measurement_date measurement_type_concept_id value_as_concept_id",
    f"{_date('CLM_FROM_DT')} AS measurement_date, 45754907 AS measurement_type_concept_id, 0 AS value_as_concept_id",
)
_facts_table(
    "observation", "observation", "observation_id", "observation", "observation_date observation_type_concept_id value_as_concept_id",
    f"{_date('CLM_FROM_DT')} AS observation_date, 38000282 AS observation_type_concept_id, 0 AS value_as_concept_id",
)
_facts_table(
    "device_exposure", "device", "device_exposure_id", "device", "device_exposure_start_date device_exposure_end_date device_type_concept_id",
    f"{_date('CLM_FROM_DT')} AS device_exposure_start_date, {_date('CLM_THRU_DT')} AS device_exposure_end_date, 44818705 AS device_type_concept_id",
)
_DRUGS = f"""{PRELUDE}, e AS (
    SELECT person_id, 0 AS feed_rank, PDE_ID AS k, SRVC_DT AS d, 0 AS pos, target_order, PROD_SRVC_ID AS code, source_id, target_id, CAST(QTY_DSPNSD_NUM AS DOUBLE) AS quantity,
           CAST(DAYS_SUPLY_NUM AS BIGINT) AS days_supply, NULL AS provider_id, NULL AS visit_occurrence_id, PDE_ID AS rx FROM rx WHERE target_id IS NOT NULL
    UNION ALL SELECT person_id, feed_rank, CLM_ID, CLM_FROM_DT, pos, target_order, code, source_id, target_id, NULL, NULL, provider_id, visit_occurrence_id, NULL
    FROM facts WHERE destination = 'drug' AND target_id IS NOT NULL),
  drugs AS (SELECT row_number() OVER (ORDER BY person_id, feed_rank, k, d, pos, target_order NULLS FIRST) AS drug_exposure_id, * FROM e)"""
_table(
    "drug_exposure", _COMMON.format(id="drug_exposure_id", p="drug") + "drug_exposure_start_date drug_type_concept_id quantity days_supply",
    f"""{_DRUGS} SELECT drug_exposure_id, person_id, provider_id, visit_occurrence_id, target_id AS drug_concept_id, code AS drug_source_value, source_id AS drug_source_concept_id,
    {_date('d')} AS drug_exposure_start_date, 38000175 AS drug_type_concept_id, quantity, days_supply FROM drugs""",
)
_table(
    "drug_cost", "drug_cost_id drug_exposure_id currency_concept_id paid_coinsurance total_out_of_pocket total_paid",
    f"""{_DRUGS} SELECT row_number() OVER (ORDER BY s.person_id, PDE_ID, SRVC_DT) AS drug_cost_id, drug_exposure_id, 44818668 AS currency_concept_id,
    CAST(PTNT_PAY_AMT AS DOUBLE) AS paid_coinsurance, CAST(PTNT_PAY_AMT AS DOUBLE) AS total_out_of_pocket, CAST(TOT_RX_CST_AMT AS DOUBLE) AS total_paid
    FROM scripts s LEFT JOIN (SELECT rx, max(drug_exposure_id) AS drug_exposure_id FROM drugs WHERE rx IS NOT NULL GROUP BY rx) x ON rx = PDE_ID""",
)
_LINE_ROWS = " UNION ALL ".join(
    f"""SELECT CLM_ID, {i} AS line, LINE_NCH_PMT_AMT_{i} AS nch, LINE_BENE_PTB_DDCTBL_AMT_{i} AS ded, LINE_BENE_PRMRY_PYR_PD_AMT_{i} AS pry, LINE_COINSRNC_AMT_{i} AS coi, LINE_ALOWD_CHRG_AMT_{i} AS alo
    FROM carrier WHERE PRF_PHYSN_NPI_{i} <> ''"""
    for i in LINES
)
_table(
    "procedure_cost",
    "procedure_cost_id procedure_occurrence_id currency_concept_id paid_coinsurance paid_toward_deductible paid_by_payer paid_by_coordination_benefits total_out_of_pocket total_paid",
    f"""{PRELUDE}, p AS (SELECT row_number() OVER (ORDER BY {_ORDER}, pos, target_order NULLS FIRST) AS procedure_occurrence_id, * FROM facts WHERE destination = 'procedure' AND target_id IS NOT NULL),
    lines AS ({_LINE_ROWS})
    SELECT row_number() OVER (ORDER BY procedure_occurrence_id, line) AS procedure_cost_id, procedure_occurrence_id, 44818668 AS currency_concept_id,
    CAST(nullif(coi, '') AS DOUBLE) AS paid_coinsurance, CAST(nullif(ded, '') AS DOUBLE) AS paid_toward_deductible, CAST(nullif(nch, '') AS DOUBLE) AS paid_by_payer,
    CAST(nullif(pry, '') AS DOUBLE) AS paid_by_coordination_benefits, coalesce(CAST(nullif(ded, '') AS DOUBLE) + CAST(nullif(coi, '') AS DOUBLE), 0) AS total_out_of_pocket,
    CAST(nullif(alo, '') AS DOUBLE) AS total_paid FROM p JOIN lines USING (CLM_ID) WHERE feed = 'carrier' AND nch || ded || pry || coi || alo <> ''""",
)


@query(
    "cdm_unmapped",
    f"""{PRELUDE} SELECT feed, vocab, code, person_id, count(*) AS n FROM (SELECT feed, vocab, code, person_id FROM facts WHERE NOT known
    UNION ALL SELECT 'prescription', 'NDC', PROD_SRVC_ID, person_id FROM rx WHERE NOT known) GROUP BY ALL""",
)
def cdm_unmapped(t):
    return flow(t).unmapped.groupBy("feed", "vocab", "code", "person_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cdm_condition_era",
    f"""{PRELUDE}, spans AS (SELECT row_number() OVER () AS id, person_id, target_id AS concept, {_date('CLM_FROM_DT')} AS start_date, {_date('CLM_THRU_DT')} AS end_date
    FROM facts WHERE destination = 'condition' AND target_id IS NOT NULL), o AS (
    SELECT *, CASE WHEN start_date <= max(end_date) OVER w + 30 THEN 0 ELSE 1 END AS fresh FROM spans
    WINDOW w AS (PARTITION BY person_id, concept ORDER BY start_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY person_id, concept ORDER BY start_date, id) AS island FROM o)
    SELECT person_id, concept AS condition_concept_id, min(start_date) AS condition_era_start_date, max(end_date) AS condition_era_end_date, count(*) AS condition_occurrence_count
    FROM i GROUP BY person_id, concept, island""",
)
def cdm_condition_era(t):
    from medweave.plans.eras import condition_era

    return condition_era(flow(t).tables["condition_occurrence"])


_VOCABULARY = {"concept": ["concept_id", "domain_id", "vocabulary_id", "concept_code"], "concept_relationship": ["concept_id_1", "concept_id_2", "relationship_id", "invalid_reason"]}


def _key_report_sql() -> str:
    """Every rule by itself: counts of a key's rows, values that are not in the parent, missing values."""
    filled = FILLED | _VOCABULARY
    feeds = {"concept": "concept", "concept_relationship": "relationship"}
    sources = ",\n".join(
        f"t_{n} AS MATERIALIZED ({f'{PRELUDE} SELECT * FROM {feeds[n]}' if n in feeds else ORACLE[f'cdm_{n}']})" for n in filled if n in feeds or f"cdm_{n}" in ORACLE
    )
    parts = []
    for table, rules in cdm_rules().items():
        has = filled.get(table, [])
        row = lambda kind, columns, parent, counts: parts.append(
            f"SELECT '{table}' AS \"table\", '{kind}' AS rule, '{','.join(columns)}' AS columns, {parent} AS parent, {counts}"  # noqa: B023
        )
        if rules.key:
            whole = ", ".join(rules.key)
            missing = " OR ".join(f"{c} IS NULL" for c in rules.key)
            row("primary key", rules.key, "NULL", f"CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, count(*) AS keys FROM (SELECT {whole}, count(*) AS n FROM t_{table} GROUP BY ALL HAVING count(*) > 1 OR {missing})" if has else "0 AS rows, 0 AS keys")
        for column, (parent, key) in rules.references.items():
            held = f"AND {column} NOT IN (SELECT {key} FROM t_{parent} WHERE {key} IS NOT NULL)" if key in filled.get(parent, []) else ""
            row("foreign key", [column], f"'{parent}'", f"count(*) AS rows, count(DISTINCT {column}) AS keys FROM t_{table} WHERE {column} IS NOT NULL {held}" if column in has else "0 AS rows, 0 AS keys")
        for column in rules.required:
            row("not null", [column], "NULL", f"count(*) AS rows, 0 AS keys FROM t_{table} {f'WHERE {column} IS NULL' if column in has else ''}" if has else "0 AS rows, 0 AS keys")
    return f"WITH {sources} " + " UNION ALL ".join(parts)


@query("cdm_key_report", _key_report_sql())
def cdm_key_report(t):
    """All keys, references and NOT NULL columns of the converted database with its vocabulary; tables that nothing fills are empty."""
    given = {"concept": feed(t, "concept"), "concept_relationship": feed(t, "relationship")}
    made = flow(t).tables | {n: df.select(*_VOCABULARY[n]) for n, df in given.items()}
    tables = {n: made[n] if n in made else t.spark.createDataFrame([], cdm_schema(n)) for n in CDM_TABLES}
    return key_report(tables, cdm_rules())


_COUNTS = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n FROM ({ORACLE[f'cdm_{n}']})" if f"cdm_{n}" in ORACLE else f"SELECT '{n}', 0" for n in OUTPUT_TABLES
)


@query("cdm_row_counts", _COUNTS)
def cdm_row_counts(t):
    """Records per output table; three of them have a header only."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in flow(t).tables.items()]
    return C.union_facts(parts)


@query(
    "second_sample_ids",
    f"{PRELUDE} SELECT DESYNPUF_ID, person_id + (SELECT count(*) FROM ids) AS person_id FROM ids",
)
def second_sample_ids(t):
    """Person ids of a second sample continue after the first."""
    first = flow(t).carried().state
    people = C.build_people(feed(t, "beneficiary"), ["2008", "2009", "2010"], first["person"])
    return people.select(C.PERSON, "person_id")


# --- steps of the conversion by themselves ------------------------------------------------------------------------


@query(
    "claim_code_rows",
    f"""WITH {_FEEDS} SELECT feed, CLM_ID AS claim_id, vocab, code FROM ({_code_rows('inpatient', 1, _FAC)} UNION ALL
    {_code_rows('outpatient', 2, [('ICD9', 'ADMTNG_ICD9_DGNS_CD'), *_FAC])} UNION ALL {_code_rows('carrier', 3, _CAR)}) WHERE CLM_FROM_DT <> '' AND code <> ''""",
)
def claim_code_rows(t):
    rows = C.union_facts([C.claim_rows(k, feed(t, k)) for k in C.FEEDS])
    return C.explode_codes(rows, ["feed", "claim_id"]).drop("code_order")


@query(
    "carrier_line_rows",
    f"""WITH {_FEEDS}, lines AS ({_LINE_ROWS}) SELECT CLM_ID AS claim_id, line, nch || ded || pry || coi || alo <> '' AS has_amount,
    coalesce(CAST(nullif(ded, '') AS DOUBLE) + CAST(nullif(coi, '') AS DOUBLE), 0) AS out_of_pocket FROM lines JOIN carrier USING (CLM_ID) WHERE CLM_FROM_DT <> ''""",
)
def carrier_line_rows(t):
    rows = C.claim_rows("carrier", feed(t, "carrier")).select("claim_id", F.explode("lines").alias("l"))
    return rows.select(
        "claim_id", F.col("l.line").alias("line"), C.fc.has_nonzero_amount(F.col("l")).alias("has_amount"),
        C.fc.out_of_pocket(F.col("l")).cast("double").alias("out_of_pocket"),
    )


@query(
    "claim_provider_site",
    f"{PRELUDE} SELECT feed, CLM_ID AS claim_id, fact_npi, fact_site FROM claims",
)
def claim_provider_site(t):
    people = C.yearly_records(feed(t, "beneficiary")).select(C.PERSON).distinct()
    rows = C.union_facts([C.claim_rows(k, feed(t, k)) for k in C.FEEDS])
    return C.attach_claims(people, rows).select("feed", "claim_id", "fact_npi", "fact_site")


@query(
    "pivot_coverage",
    f"""{PRELUDE} SELECT DESYNPUF_ID, {', '.join(f"coalesce(max(CASE WHEN FILE_YEAR = '{y}' THEN CAST({c} AS INTEGER) END), 0) AS {c}_{y}" for c in C.PLANS.values() for y in (2008, 2009, 2010))}
    FROM yearly GROUP BY DESYNPUF_ID""",
)
def pivot_coverage(t):
    return C.pivot_coverage(C.yearly_records(feed(t, "beneficiary")), ["2008", "2009", "2010"])
