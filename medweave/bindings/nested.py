"""Nested records: every order as a case with samples, portions and slides made from its numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from medweave.bindings.common import query
from medweave.functions.nested import flatten_default, json_leaf
from medweave.operators import combine
from medweave.plans import medallion as m
from medweave.session import new_folder
from medweave.sources import files


def _slide(key, i, p, s):
    n = key + i * 100 + p * 10 + s
    return F.struct(
        F.concat_ws("-", F.lit("L"), key, i, p, s).alias("slide_id"), F.lit("sub").alias("submitter_id"), F.lit("TOP").alias("section_location"),
        F.when(n % 4 == 0, "Unknown").otherwise("released").alias("state"),
        *[(n % (10 + j)).cast("double").alias(f"percent_{c}") for j, c in enumerate(
            ("tumor_cells", "tumor_nuclei", "necrosis", "stromal_cells", "normal_cells", "neutrophil_infiltration", "lymphocyte_infiltration", "monocyte_infiltration"))],
    )


def hits(t):
    key = F.col("o_orderkey")

    def some(n, f):
        return F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= n), f)

    def sample(i):
        portions = some(i, lambda p: F.struct(some((key + p) % 3, lambda s: _slide(key, i, p, s)).alias("slides")))
        return F.struct(
            F.concat_ws("-", F.lit("S"), key, i).alias("sample_id"), F.concat(F.lit("sub"), key % 5).alias("submitter_id"),
            F.when(i == 1, "Primary Tumor").otherwise("NA").alias("sample_type"), F.lit("Unknown").alias("specimen_type"),
            F.when(key % 2 == 0, "Tumor").otherwise("Not Reported").alias("tissue_type"), F.lit("--").alias("tumor_descriptor"),
            F.lit("NOT REPORTED").alias("preservation_method"), (key % 90 + i).cast("double").alias("initial_weight"),
            F.when(key % 3 == 0, (key % 40).cast("double")).alias("days_to_collection"), F.lit(None).cast("double").alias("days_to_sample_procurement"),
            F.lit(" Not Reported").alias("pathology_report_uuid"), F.lit("released").alias("state"), portions.alias("portions"),
        )

    return t.orders.select(
        F.concat(F.lit("C"), key).alias("case_id"), F.col("o_orderpriority").alias("submitter_id"), F.col("o_orderstatus").alias("disease_type"),
        F.when(key % 7 != 0, F.struct(F.concat(F.lit("P"), F.col("o_custkey") % 10).alias("project_id"))).alias("project"),
        some(key % 3, lambda i: F.struct(F.concat_ws("/", key % 100, i).alias("morphology"))).alias("diagnoses"),
        some((key + 1) % 3, sample).alias("samples"),
    )


_CASES = """SELECT 'C' || o_orderkey AS case_id, o_orderpriority AS submitter_id, o_orderstatus AS disease_type,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'P' || o_custkey % 10 END AS project_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 100 || '/1' END AS morphology FROM orders"""
_SAMPLES = """SELECT 'C' || o_orderkey AS case_id, 'S-' || o_orderkey || '-' || i AS sample_id, 'sub' || o_orderkey % 5 AS submitter_id,
  CASE WHEN i = 1 THEN 'Primary Tumor' ELSE 'NA' END AS sample_type, 'Unknown' AS specimen_type, CASE WHEN o_orderkey % 2 = 0 THEN 'Tumor' ELSE 'Not Reported' END AS tissue_type,
  '--' AS tumor_descriptor, 'NOT REPORTED' AS preservation_method, CAST(o_orderkey % 90 + i AS DOUBLE) AS initial_weight,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 40 AS DOUBLE) END AS days_to_collection, CAST(NULL AS DOUBLE) AS days_to_sample_procurement,
  ' Not Reported' AS pathology_report_uuid, 'released' AS state FROM orders JOIN generate_series(1, 3) g(i) ON i <= (o_orderkey + 1) % 3"""
_PERCENT = ", ".join(
    f"CAST((o_orderkey + i * 100 + p * 10 + s) % {10 + j} AS DOUBLE) AS percent_{c}"
    for j, c in enumerate(("tumor_cells", "tumor_nuclei", "necrosis", "stromal_cells", "normal_cells", "neutrophil_infiltration", "lymphocyte_infiltration", "monocyte_infiltration"))
)
_SLIDES = f"""SELECT 'C' || o_orderkey AS case_id, 'S-' || o_orderkey || '-' || i AS sample_id, 'L-' || o_orderkey || '-' || i || '-' || p || '-' || s AS slide_id, 'sub' AS submitter_id,
  'TOP' AS section_location, CASE WHEN (o_orderkey + i * 100 + p * 10 + s) % 4 = 0 THEN 'Unknown' ELSE 'released' END AS state, {_PERCENT}
  FROM orders JOIN generate_series(1, 3) a(i) ON i <= (o_orderkey + 1) % 3 JOIN generate_series(1, 3) b(p) ON p <= i JOIN generate_series(1, 3) c(s) ON s <= (o_orderkey + p) % 3"""
_NULLS = "'" + "', '".join(combine.NULL_PLACEHOLDERS) + "'"


def _clean(sql: str, texts: list[str], rest: list[str]) -> str:
    cols = [f"CASE WHEN {c} NOT IN ({_NULLS}) THEN {c} END AS {c}" for c in texts] + rest
    return f"SELECT {', '.join(cols)} FROM (SELECT DISTINCT * FROM ({sql}))"


_FLOATS = ["initial_weight", "days_to_collection", "days_to_sample_procurement"]
_CASE_TEXT = ["case_id", "submitter_id", "disease_type", "project_id", "morphology"]
_SAMPLE_TEXT = ["case_id", "sample_id", "submitter_id", "sample_type", "specimen_type", "tissue_type", "tumor_descriptor", "preservation_method", "pathology_report_uuid", "state"]
_GOLD = f"""SELECT s.*, c.disease_type, c.project_id, c.morphology FROM ({_clean(_SAMPLES, _SAMPLE_TEXT, _FLOATS)}) s
  LEFT JOIN ({_clean(_CASES, _CASE_TEXT, [])}) c ON c.case_id = s.case_id"""


@query("extract_cases", _CASES)
def extract_cases(t):
    return m.extract_cases(hits(t))


@query("extract_samples", _SAMPLES)
def extract_samples(t):
    return m.extract_samples(hits(t))


@query("extract_slides", _SLIDES)
def extract_slides(t):
    return m.extract_slides(hits(t))


@query("read_hits", _CASES)
def read_hits(t):
    """The same cases, written as JSON responses and read back."""
    nested = hits(t)
    path = new_folder(t.spark, "hits")
    nested.select(F.struct(F.array(F.struct(*nested.columns)).alias("hits")).alias("data")).write.json(path)
    return m.extract_cases(files.read_hits(t.spark, path, nested.schema, per_line=True))


@query("json_leaf", "SELECT 'C' || o_orderkey AS case_id, CASE WHEN (o_orderkey + 1) % 3 > 0 AND (o_orderkey + 1) % 3 > 0 THEN 'S-' || o_orderkey || '-1' END AS first_sample, CAST(NULL AS VARCHAR) AS nothing FROM orders")
def json_leaf_query(t):
    df = hits(t)
    return df.select("case_id", json_leaf(df.schema, "samples.sample_id").alias("first_sample"), json_leaf(df.schema, "samples.unknown.x").alias("nothing"))


@query(
    "flatten_default",
    """SELECT 'C' || o_orderkey AS case_id, CASE WHEN o_orderkey % 7 <> 0 THEN '{"project_id":"P' || o_custkey % 10 || '"}' END AS project,
       concat_ws(', ', CASE WHEN o_orderkey % 3 >= 1 THEN '{"morphology":"' || o_orderkey % 100 || '/1"}' END,
                 CASE WHEN o_orderkey % 3 >= 2 THEN '{"morphology":"' || o_orderkey % 100 || '/2"}' END) AS diagnoses FROM orders""",
)
def flatten(t):
    return flatten_default(hits(t).select("case_id", "project", "diagnoses"))


@query("silver_cases", _clean(_CASES, _CASE_TEXT, []))
def silver_cases(t):
    return m.transform_silver(m.extract_cases(hits(t)))


@query("silver_samples", _clean(_SAMPLES, _SAMPLE_TEXT, _FLOATS))
def silver_samples(t):
    return m.transform_silver(m.extract_samples(hits(t)))


@query(
    "silver_clean",
    """SELECT DISTINCT o_custkey, o_orderstatus, CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') THEN o_orderpriority END AS o_orderpriority
       FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority, o_orderkey FROM orders) GROUP BY o_custkey, o_orderstatus, o_orderpriority, o_orderkey""",
)
def silver_clean(t):
    rows = t.orders.select("o_custkey", "o_orderstatus", "o_orderpriority")
    return combine.distinct_rows(combine.null_placeholders(rows, ["4-NOT SPECIFIED", "5-LOW"]))


@query("gold_mastertable", f"SELECT DISTINCT * FROM ({_GOLD})")
def gold_mastertable(t):
    layers = m.medallion(hits(t), lambda _, df: df)
    return layers["gold_mastertable"]


@query(
    "gold_join",
    """SELECT DISTINCT o.o_orderkey, o.o_custkey, o.o_orderstatus, c.c_name FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey""",
)
def gold_join(t):
    left = t.orders.select("o_orderkey", F.col("o_custkey"), "o_orderstatus")
    right = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("never").alias("o_orderstatus"), "c_name")
    return combine.join_tables(left, right, "o_custkey")


@query(
    "outer_join_on_null",
    """WITH l AS (SELECT DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS k, o_orderstatus FROM orders), r AS (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey END AS k, c_mktsegment FROM customer)
       SELECT DISTINCT coalesce(l.k, r.k) AS k, o_orderstatus, c_mktsegment FROM l FULL JOIN r ON l.k IS NOT DISTINCT FROM r.k""",
)
def outer_join_on_null(t):
    left = t.orders.select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("k"), "o_orderstatus").distinct()
    right = t.customer.select(F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("k"), "c_mktsegment")
    return combine.join_tables(left, right, ["k"], "outer", nulls_equal=True)


@query("dedupe_mapping", f"SELECT count(*) AS n FROM ({_SAMPLES})")
def dedupe_mapping(t):
    """A column listed twice is extracted once."""
    twice = m.SAMPLE_FIELDS[:2] + m.SAMPLE_FIELDS[1:]
    return m.extract_samples(hits(t), twice).agg(F.count(F.lit(1)).alias("n"))


def _split_sides(t):
    """Lines and orders by a key that a third of both share and that is missing in others; one row per value on either side."""
    key = lambda c: F.when(F.col(c) % 3 == 0, F.lit(0)).when(F.col(c) % 11 != 1, F.col(c) % 200)
    left = t.customer.where("c_custkey % 2 = 0").select(key("c_custkey").cast("long").alias("k"), F.col("c_nationkey").alias("v"))
    right = t.supplier.where("s_suppkey % 3 <> 2").select(key("s_suppkey").cast("long").alias("k"), F.col("s_suppkey").alias("w"))
    return left, right


_SPLIT = """WITH l AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 11 <> 1 THEN c_custkey % 200 END AS k, c_nationkey AS v FROM customer WHERE c_custkey % 2 = 0),
  r AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 11 <> 1 THEN s_suppkey % 200 END AS k, s_suppkey AS w FROM supplier WHERE s_suppkey % 3 <> 2)
  SELECT DISTINCT coalesce(l.k, r.k) AS k, v, w FROM l {how} JOIN r ON l.k = r.k"""


@query("outer_join_hot_key", _SPLIT.format(how="FULL"))
def outer_join_hot_key(t):
    return combine.join_tables(*_split_sides(t), "k", "outer")


@query("right_join_hot_key", _SPLIT.format(how="RIGHT"))
def right_join_hot_key(t):
    return combine.join_tables(*_split_sides(t), "k", "right")
