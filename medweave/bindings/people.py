"""Person-level operators: orders as yearly records, customers as persons."""

from __future__ import annotations

from pyspark.sql import functions as F

from medweave.bindings.common import day, query
from medweave.functions import claims as fc
from medweave.functions import coverage as cov
from medweave.operators import keyed, ordering
from medweave.plans import claims


def _yearly(t):
    return t.orders.select("o_custkey", F.year("o_orderdate").alias("yr"), "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice"))


_YEARLY = "WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders)"


def _first(keys: str, order: str) -> str:
    return f"{_YEARLY} SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


@query("latest_year", _first("o_custkey", "yr DESC, o_orderkey"))
def latest_year(t):
    return keyed.latest_year(_yearly(t), "o_custkey", "yr", ["o_orderkey"])


@query("earliest_year", _first("o_custkey", "yr, o_orderkey"))
def earliest_year(t):
    return keyed.earliest_year(_yearly(t), "o_custkey", "yr", ["o_orderkey"])


@query("first_seen", _first("o_custkey, yr", "o_orderkey"))
def first_seen(t):
    return keyed.first_seen(_yearly(t), ["o_custkey", "yr"], ["o_orderkey"])


@query("latest_per_key", _first("o_custkey, o_orderstatus", "o_totalprice DESC, o_orderkey DESC"))
def latest_per_key(t):
    return keyed.latest_per_key(_yearly(t), ["o_custkey", "o_orderstatus"], ["o_totalprice", "o_orderkey"])


@query(
    "changed_fields",
    f"""{_YEARLY}, f AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY o_custkey, yr ORDER BY o_orderkey) = 1),
    l AS (SELECT *, lag(yr) OVER w AS previous_year, lag(o_orderstatus) OVER w AS s, lag(o_orderpriority) OVER w AS p
          FROM f WINDOW w AS (PARTITION BY o_custkey ORDER BY yr))
    SELECT o_custkey, yr, previous_year, concat_ws(',', CASE WHEN o_orderstatus <> s THEN 'o_orderstatus' END,
           CASE WHEN o_orderpriority <> p THEN 'o_orderpriority' END) AS changed
    FROM l WHERE previous_year IS NOT NULL AND (o_orderstatus <> s OR o_orderpriority <> p)""",
)
def changed_fields(t):
    found = keyed.changed_fields(_yearly(t), "o_custkey", "yr", ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return found.withColumn("changed", F.array_join("changed", ","))


@query(
    "observation_period",
    """WITH d AS (SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS date FROM orders
       UNION ALL SELECT o_custkey, CAST(l_shipdate AS DATE) FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
       SELECT person_id, min(date) AS observation_period_start_date, max(date) AS observation_period_end_date FROM d GROUP BY person_id""",
)
def observation_period(t):
    ordered = t.orders.select(F.col("o_custkey").alias("person_id"), day("o_orderdate").alias("date"))
    shipped = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("person_id"), day("l_shipdate").alias("date"))
    return claims.observation_period(ordered, shipped)


@query(
    "distinct_visits",
    """WITH a AS (SELECT o_custkey, CAST(l_shipdate AS DATE) AS from_dt, CAST(l_shipdate AS DATE) + 7 AS thru_dt, l_suppkey, l_returnflag
                  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
       SELECT DISTINCT o_custkey, from_dt, thru_dt, l_suppkey FROM a""",
)
def distinct_visits(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_custkey", day("l_shipdate").alias("from_dt"), F.date_add(day("l_shipdate"), 7).alias("thru_dt"), "l_suppkey", "l_returnflag"
    )
    feeds = [rows.where(F.col("l_returnflag") == f) for f in ("A", "N", "R")]
    return keyed.distinct_visits(*feeds, keys=["o_custkey", "from_dt", "thru_dt", "l_suppkey"])


@query(
    "visit_by_date",
    """SELECT o_orderkey, coalesce((SELECT max(l_suppkey) FROM lineitem JOIN orders i ON i.o_orderkey = l_orderkey
              WHERE i.o_custkey = o.o_custkey AND l_shipdate = o.o_orderdate), -1) AS l_suppkey FROM orders o""",
)
def visit_by_date(t):
    visits = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", day("l_shipdate").alias("date"), "l_suppkey")
    events = t.orders.select("o_orderkey", "o_custkey", day("o_orderdate").alias("date"))
    return keyed.visit_by_date(events, visits, ["o_custkey", "date"], "l_suppkey").select("o_orderkey", "l_suppkey")


@query(
    "claims_in_date_order",
    """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders ORDER BY o_custkey, date, o_orderkey""",
)
def claims_in_date_order(t):
    return ordering.claims_in_date_order(t.orders.select("o_custkey", "o_orderkey", day("o_orderdate").alias("date")), "o_custkey", "date", "o_orderkey")


@query(
    "sort_feed",
    "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderkey, o_orderstatus",
)
def sort_feed(t):
    return ordering.sort_feed(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"])


# --- codes of a person ---------------------------------------------------------------------------------------


@query(
    "demographics",
    """WITH c AS (SELECT c_custkey, CAST(c_custkey % 4 AS VARCHAR) AS sex, CAST(c_custkey % 7 AS VARCHAR) AS race,
                  CAST(date '1920-01-31' + CAST(c_custkey % 20000 AS INTEGER) AS DATE) AS born FROM customer)
       SELECT c_custkey, CASE sex WHEN '1' THEN 8507 WHEN '2' THEN 8532 ELSE 0 END AS gender_concept_id,
              CASE race WHEN '1' THEN 8527 WHEN '2' THEN 8516 ELSE 0 END AS race_concept_id,
              CASE WHEN race IN ('1', '2', '3') THEN 38003564 WHEN race = '5' THEN 38003563 ELSE 0 END AS ethnicity_concept_id,
              CAST(year(born) AS INTEGER) AS year_of_birth, CAST(month(born) AS INTEGER) AS month_of_birth,
              CAST(day(born) AS INTEGER) AS day_of_birth FROM c""",
)
def demographics(t):
    born = F.date_format(F.date_add(F.lit("1920-01-31").cast("date"), (F.col("c_custkey") % 20000).cast("int")), "yyyyMMdd")
    origin = fc.race_ethnicity((F.col("c_custkey") % 7).cast("string"))
    return t.customer.select(
        "c_custkey", fc.gender_concept((F.col("c_custkey") % 4).cast("string")).alias("gender_concept_id"),
        origin["race"].alias("race_concept_id"), origin["ethnicity"].alias("ethnicity_concept_id"),
        *[c.alias(n) for n, c in fc.birth_parts(born).items()],
    )


_STATES = ", ".join(f"('{k}', '{v}')" for k, v in fc.SSA_STATE.items())


@query(
    "locations",
    f"""WITH m(code, abbr) AS (VALUES {_STATES}), c AS (
        SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN CAST(c_custkey % 9 AS VARCHAR) ELSE lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') END AS state,
               CASE WHEN c_nationkey = 3 THEN '' ELSE CAST(c_custkey % 1000 AS VARCHAR) END AS county FROM customer)
        SELECT c_custkey, coalesce(abbr, state) AS state_code, state || '-' || county AS location_key,
               (CASE WHEN length(state) = 1 THEN '0' || state ELSE state END) ||
               (CASE WHEN length(county) = 1 THEN '00' || county WHEN length(county) = 2 THEN '0' || county ELSE county END) AS county_code
        FROM c LEFT JOIN m ON code = state""",
)
def locations(t):
    key = F.col("c_custkey")
    c = t.customer.select(
        key, F.when(key % 10 == 0, (key % 9).cast("string")).otherwise(F.lpad((key % 60).cast("string"), 2, "0")).alias("state"),
        F.when(F.col("c_nationkey") == 3, "").otherwise((key % 1000).cast("string")).alias("county"),
    )
    state, county = F.col("state"), F.col("county")
    return c.select(
        "c_custkey", fc.ssa_state(state).alias("state_code"), fc.location_key(state, county).alias("location_key"),
        fc.county_code(state, county).alias("county_code"),
    )


@query(
    "parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS ymd, CAST(o_orderdate AS DATE) AS either_form FROM orders""",
)
def parse_dates(t):
    compact, dashed = (F.date_format("o_orderdate", p) for p in ("yyyyMMdd", "yyyy-MM-dd"))
    ymd = F.when(F.col("o_orderstatus") != "P", compact).otherwise("")
    mixed = F.when(F.col("o_orderstatus") == "F", dashed).otherwise(compact)
    return t.orders.select("o_orderkey", fc.parse_ymd(ymd).alias("ymd"), fc.parse_date(mixed).alias("either_form"))


# --- coverage ------------------------------------------------------------------------------------------------------


def _months(t):
    parts = t.orders.select("o_custkey", F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("m"), "o_orderstatus")
    full = F.when(F.col("o_orderstatus") == "F", 12).otherwise(F.countDistinct("m"))
    per_year = parts.groupBy("o_custkey", "yr", "o_orderstatus").agg(full.cast("int").alias("months"))
    return per_year.groupBy("o_custkey", "o_orderstatus").agg(
        *[F.coalesce(F.max(F.when(F.col("yr") == y, F.col("months"))), F.lit(0)).alias(f"m{i}") for i, y in enumerate((1996, 1997, 1998))]
    )


_MONTHS = """WITH per_year AS (
  SELECT o_custkey, year(o_orderdate) AS yr, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 12 ELSE CAST(count(DISTINCT month(o_orderdate)) AS INTEGER) END AS months
  FROM orders GROUP BY o_custkey, year(o_orderdate), o_orderstatus), m AS (
  SELECT o_custkey, o_orderstatus, coalesce(max(CASE WHEN yr = 1996 THEN months END), 0) AS a,
         coalesce(max(CASE WHEN yr = 1997 THEN months END), 0) AS b, coalesce(max(CASE WHEN yr = 1998 THEN months END), 0) AS c
  FROM per_year GROUP BY o_custkey, o_orderstatus)"""


def _plan_periods(rows: str, keys: str, first: int) -> str:
    """The rule of periods branch by branch, over rows with months a, b, c."""
    f = first
    add = "CAST(CAST('{0}' AS DATE) + to_months(CAST({1} AS INTEGER)) AS DATE)"
    alone = " UNION ALL ".join(
        f"""SELECT {keys}, date '{f + i}-01-01' AS "start", CASE WHEN {m} = 12 THEN date '{f + i}-12-31' ELSE {add.format(f'{f + i}-01-01', m)} END AS "end"
            FROM {rows} WHERE b < 12 AND {m} > 0 AND greatest(a, b, c) <= 12"""
        for i, m in enumerate("abc")
    )
    return f"""SELECT {keys}, CASE WHEN a = 12 THEN date '{f}-01-01' WHEN a = 0 THEN date '{f + 1}-01-01' ELSE {add.format(f'{f}-12-31', '-a')} END AS "start",
               CASE WHEN c = 12 THEN date '{f + 2}-12-31' ELSE {add.format(f'{f + 1}-12-31', 'c')} END AS "end"
               FROM {rows} WHERE b = 12 AND greatest(a, b, c) <= 12 UNION ALL {alone}"""


@query("payer_plan_periods", f"{_MONTHS} {_plan_periods('m', 'o_custkey, o_orderstatus', 1996)}")
def payer_plan_periods(t):
    periods = cov.payer_plan_periods(F.col("m0"), F.col("m1"), F.col("m2"), 1996)
    rows = _months(t).select("o_custkey", "o_orderstatus", F.explode(periods).alias("p"))
    return rows.select("o_custkey", "o_orderstatus", "p.start", "p.end")


@query(
    "coverage_window",
    f"""{_MONTHS}, x AS (SELECT o_custkey, o_orderstatus, greatest(a, b, c) AS months, (o_custkey % 15)::INTEGER AS n FROM m)
        SELECT o_custkey, o_orderstatus, months, CASE WHEN n BETWEEN 1 AND 12 THEN make_date(2008, 13 - n, 1) END AS "start",
               CASE WHEN n BETWEEN 1 AND 12 THEN last_day(make_date(2008, CASE WHEN n < 12 THEN least(12, 13 - n + n) ELSE 12 END, 1)) END AS "end" FROM x""",
)
def coverage_window(t):
    window = cov.coverage_window(F.lit(2008), (F.col("o_custkey") % 15).cast("int"))
    rows = _months(t).select("o_custkey", "o_orderstatus", cov.coverage_months(F.col("m0"), F.col("m1"), F.col("m2")).alias("months"), window.alias("w"))
    return rows.select("o_custkey", "o_orderstatus", "months", F.col("w.start").alias("start"), F.col("w.end").alias("end"))


@query(
    "shift_months",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 25 - 12 AS INTEGER)) AS DATE) AS shifted FROM orders""",
)
def shift_months(t):
    return t.orders.select("o_orderkey", cov.shift_months(day("o_orderdate"), (F.col("o_orderkey") % 25 - 12).cast("int")).alias("shifted"))
