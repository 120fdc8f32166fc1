"""Governance: nations as studies, customers as permission holders, orders as export requests, events as audit trail."""

from __future__ import annotations

from pyspark.sql import functions as F

from medweave.bindings.common import day, query
from medweave.functions import access as fa
from medweave.operators import combine, ordering, quality
from medweave.plans import export, governance as g, request_store as store
from medweave.session import new_folder

NOW = 1_000_000_000
USER = "Customer#000000010"

INPUT_SQL = {
    "catalog": """
SELECT 'D' || CAST(n_nationkey AS STRING) AS dataset_id, n_name AS study_name,
  CASE n_nationkey % 3 WHEN 0 THEN 'open_access' WHEN 1 THEN 'controlled_access' ELSE 'unregistered' END AS access_tier,
  'c' || CAST(n_nationkey % 4 AS STRING) AS consent_group, 'status' || CAST(n_regionkey AS STRING) AS dbgap_status,
  CASE WHEN n_nationkey % 5 = 0 THEN '  ' WHEN n_nationkey % 5 = 1 THEN NULL ELSE ' /data/' || n_name || '//' END AS volume_location
FROM {nation}""",
    "perms": """
SELECT c_name AS user_id, 'D' || CAST(c_nationkey AS STRING) AS dataset_id, 'c' || CAST((c_nationkey + CAST(c_custkey % 2 AS INT)) % 4 AS STRING) AS consent_group,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS role,
  CAST(CASE WHEN c_acctbal < 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 900000000 ELSE 1100000000 END AS BIGINT) AS expiration_ts,
  CASE WHEN c_custkey % 3 = 0 THEN 'steward' WHEN c_custkey % 3 = 1 THEN 'analyst' END AS poc_role
FROM {customer}""",
    "requests": """
SELECT 'r-' || CAST(o_orderkey AS STRING) AS request_id, 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS submitter,
  'D' || CAST(CASE WHEN o_orderkey % 2 = 0 THEN c_nationkey ELSE o_orderkey % 30 END AS STRING) AS dataset, o_orderpriority AS justification,
  CASE WHEN o_orderkey % 3 = 0 THEN 'json' ELSE 'csv' END AS format, CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'approved' ELSE 'rejected' END AS status,
  CAST(o_orderdate AS DATE) AS created_at, CAST(NULL AS STRING) AS steward, CAST(NULL AS STRING) AS steward_comment, CAST(NULL AS DATE) AS approved_at, CAST(NULL AS DATE) AS rejected_at,
  CAST(NULL AS STRING) AS output_url, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '' ELSE 't' END AS output_table,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS expires_at
FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
}
_SOURCES = ("nation", "customer", "orders")


def _in(t, name):
    return t.spark.sql(INPUT_SQL[name], **{s: getattr(t, s) for s in _SOURCES if "{" + s + "}" in INPUT_SQL[name]})


_WITH = "WITH " + ", ".join(f"{n} AS ({s.format(**{x: x for x in _SOURCES})})" for n, s in INPUT_SQL.items())


# What follows from a dataset's tier, or for the other tiers from what the user holds. The texts are fixed values.
_RULES = [
    ("open_access", None, "granted", fa.BASIS["open"]),
    ("unregistered", None, "flagged_for_review", fa.BASIS["unregistered"]),
    (None, "nothing", "denied", fa.BASIS["missing"]),
    (None, "lapsed", "denied", fa.BASIS["expired"]),
    (None, "current", "granted", fa.BASIS["valid"]),
]
_WITH += ", rule(tier, holding, decision, basis) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _RULES) + ")"


def _ruled(column: str, holder: str, expires: str, now: str = str(NOW)) -> str:
    """The rule for a row, by its tier if there is one for it, else by its holding."""
    has = f"CAST({holder} IS NOT NULL AS INTEGER)"
    in_time = f"CAST(coalesce({expires}, {now} + 1) > {now} AS INTEGER)"
    holding = f"['nothing', 'lapsed', 'current'][1 + {has} + {has} * {in_time}]"
    return f"coalesce((SELECT {column} FROM rule WHERE tier = access_tier), (SELECT {column} FROM rule WHERE holding = {holding}))"


_D, _B = _ruled("decision", "p.user_id", "p.expiration_ts"), _ruled("basis", "p.user_id", "p.expiration_ts")
_VIEW = f"coalesce(role, '') AS role, coalesce(expiration_ts, 0) AS expiration_ts, {_D} AS decision, {_B} AS decision_basis"


@query(
    "export_decision",
    f"""{_WITH} SELECT c.dataset_id, access_tier, dbgap_status, '{USER}' AS user_id, {_VIEW} FROM catalog c
        LEFT JOIN perms p ON p.dataset_id = c.dataset_id AND p.consent_group = c.consent_group AND p.user_id = '{USER}'""",
)
def export_decision(t):
    return g.export_decision(_in(t, "catalog"), _in(t, "perms"), USER, NOW)


@query(
    "export_decision_all",
    f"""{_WITH} SELECT c.dataset_id, access_tier, dbgap_status, coalesce(p.user_id, '') AS user_id, {_VIEW} FROM catalog c
        LEFT JOIN perms p ON p.dataset_id = c.dataset_id AND p.consent_group = c.consent_group""",
)
def export_decision_all(t):
    return g.export_decision_all(_in(t, "catalog"), _in(t, "perms"), NOW, True)


@query(
    "steward_queue",
    f"""{_WITH} SELECT request_id, submitter, dataset, justification, format, status, created_at, steward, steward_comment, approved_at, rejected_at, output_url,
        study_name, access_tier, dbgap_status, c.consent_group, coalesce(p.role, '') AS submitter_role, coalesce(p.expiration_ts, 0) AS submitter_expiration_ts,
        {_D} AS submitter_decision, {_B} AS submitter_decision_basis
        FROM requests r LEFT JOIN catalog c ON c.dataset_id = r.dataset
        LEFT JOIN perms p ON p.dataset_id = c.dataset_id AND p.consent_group = c.consent_group AND p.user_id = r.submitter WHERE status = 'pending'""",
)
def steward_queue(t):
    return g.steward_queue(_in(t, "requests"), _in(t, "catalog"), _in(t, "perms"), NOW, True)


@query(
    "my_requests",
    f"""{_WITH} SELECT r.request_id, dataset, status, created_at, c.consent_group FROM requests r LEFT JOIN catalog c ON c.dataset_id = r.dataset WHERE submitter = '{USER}'""",
)
def my_requests(t):
    return g.my_requests(_in(t, "requests"), _in(t, "catalog"), USER).select("request_id", "dataset", "status", "created_at", "consent_group")


@query("pending_only", f"{_WITH} SELECT request_id, submitter FROM requests WHERE status = 'pending'")
def pending_only(t):
    return g.pending_only(_in(t, "requests")).select("request_id", "submitter")


@query("audit_scoped", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 8")
def audit_scoped(t):
    return g.row_scope(t.events.select("event_id", "user_id", "event_type"), "8", False, "user_id")


@query("audit_steward", "SELECT event_id, user_id, event_type FROM events")
def audit_steward(t):
    return g.row_scope(t.events.select("event_id", "user_id", "event_type"), "8", True, "user_id")


@query(
    "identity_flags",
    f"""SELECT '{USER}' AS user_email, coalesce(bool_or(c_mktsegment = 'MACHINERY'), false) AS is_steward, coalesce(bool_or(c_nationkey >= 0), false) AS is_analyst
        FROM customer WHERE c_name = '{USER}'""",
)
def identity_flags(t):
    segment = t.customer.select(F.col("c_name").alias("user_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "stewards").otherwise("other").alias("group"))
    everyone = t.customer.select(F.col("c_name").alias("user_id"), F.lit("analysts").alias("group"))
    return g.identity_flags(t.spark, segment.unionByName(everyone), USER)


# --- consent ---------------------------------------------------------------------------------------------------

_GRANTS = """grants AS (SELECT DISTINCT event_type AS consent_tag, user_id AS user_email, CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'error' THEN TIMESTAMP '2020-01-01'
  ELSE TIMESTAMP '2030-01-01' END AS revoked_at FROM events)"""


def _grants(t):
    kind = F.col("event_type")
    until = F.when(kind == "error", F.lit("2020-01-01")).when(kind != "click", F.lit("2030-01-01")).cast("timestamp")
    return t.events.select(kind.alias("consent_tag"), F.col("user_id").cast("string").alias("user_email"), until.alias("revoked_at")).distinct()


def _as_of():
    return F.lit("2025-01-01").cast("timestamp")


@query(
    "consent_filter",
    f"""WITH {_GRANTS} SELECT event_id, event_type FROM events e WHERE EXISTS (SELECT 1 FROM grants g WHERE g.user_email = 8 AND g.consent_tag = e.event_type
        AND (g.revoked_at IS NULL OR g.revoked_at > TIMESTAMP '2025-01-01'))""",
)
def consent_filter(t):
    return g.consent_filter(t.events, _grants(t), "8", _as_of(), "event_type").select("event_id", "event_type")


@query(
    "has_active_consent",
    f"""WITH {_GRANTS} SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM grants g WHERE g.user_email = e.user_id AND g.consent_tag = e.event_type
        AND (g.revoked_at IS NULL OR g.revoked_at > TIMESTAMP '2025-01-01'))""",
)
def has_active_consent(t):
    _grants(t).createOrReplaceTempView("medweave_grants")
    g.register_active_consent(t.spark, "medweave_grants")
    text = "SELECT event_id FROM {events} WHERE has_active_consent(CAST(user_id AS STRING), event_type, TIMESTAMP '2025-01-01')"
    return t.spark.sql(text, events=t.events)


# --- cohorts -----------------------------------------------------------------------------------------------------

_PART = "p_partkey, p_name, p_brand, p_retailprice"
_COHORTS = {
    "contains": ({"column": "P_NAME", "op": "contains", "value": "RED"}, "p_name ILIKE '%red%'"),
    "eq": ({"column": "p_brand", "op": "eq", "value": "Brand#2"}, "p_brand = 'Brand#2'"),
    "ne": ({"column": "p_brand", "op": "ne", "value": "Brand#2"}, "p_brand <> 'Brand#2'"),
    "lt": ({"column": "p_retailprice", "op": "lt", "value": " 950.5 "}, "p_retailprice < 950.5"),
    "lte": ({"column": "p_retailprice", "op": "lte", "value": "0x3c0"}, "p_retailprice <= 960"),
    "gt": ({"column": "p_retailprice", "op": "gt", "value": "9.2e2"}, "p_retailprice > 920"),
    "gte": ({"column": "p_retailprice", "op": "gte", "value": "915"}, "p_retailprice >= 915"),
    "not_a_number": ({"column": "p_retailprice", "op": "gt", "value": "many"}, "true"),
    "unknown_column": ({"column": "nothing", "op": "eq", "value": "1"}, "true"),
}
for _name, (_definition, _where) in _COHORTS.items():

    @query(f"cohort_filter_{_name}", f"SELECT {_PART} FROM part WHERE {_where}")
    def _cohort(t, definition=_definition):
        return export.cohort_filter(t.part.select(*_PART.split(", ")), definition)


@query("project_whitelist", "SELECT p_retailprice, p_name FROM part")
def project_whitelist(t):
    return export.project_whitelist(t.part, ["P_RetailPrice", "nothing", " p_name ", "p_name", "_rescued_data"])


@query(
    "export_rows",
    """SELECT p_partkey, p_name, 'c1' AS _consent_group, 'D1' AS _dbgap_accession, 'open_access' AS _access_tier, 'u' AS _exported_for,
              '2026-01-01' AS _access_expires_at, 'r1' AS _request_id, DATE '2025-01-01' AS _exported_at FROM part WHERE p_brand = 'Brand#2'""",
)
def export_rows(t):
    meta = {"consent_group": "c1", "dataset": "D1", "access_tier": "open_access", "submitter": "u", "expires_at": "2026-01-01", "request_id": "r1"}
    rows = export.export_rows(t.part, ["p_partkey", "p_name"], {"column": "p_brand", "op": "eq", "value": "Brand#2"}, meta, at=_as_of())
    return rows.withColumn("_exported_at", day("_exported_at"))


@query(
    "row_cap",
    "SELECT least(count(*), 100) AS n FROM part",
)
def row_cap(t):
    return ordering.row_cap(t.part, 100).agg(F.count(F.lit(1)).alias("n"))


@query(
    "dataset_meta",
    f"""{_WITH} SELECT CASE WHEN trim(volume_location) = '' THEN NULL ELSE rtrim(trim(volume_location), '/') END AS location, consent_group, access_tier, dbgap_status
        FROM catalog WHERE dataset_id = 'D3'""",
)
def dataset_meta(t):
    return export.dataset_meta(_in(t, "catalog"), "D3")


@query(
    "clean_location",
    f"{_WITH} SELECT dataset_id, nullif(rtrim(trim(volume_location), '/'), '') AS location FROM catalog",
)
def clean_location(t):
    return _in(t, "catalog").select("dataset_id", fa.clean_location(F.col("volume_location")).alias("location"))


@query("artifact_name", f"{_WITH} SELECT request_id, 'req_' || replace(request_id, '-', '_') AS artifact FROM requests")
def artifact_name(t):
    return _in(t, "requests").select("request_id", fa.artifact_name(F.col("request_id")).alias("artifact"))


@query(
    "request_json_round_trip",
    """SELECT p_partkey, 'p_name,p_brand' AS columns, CASE WHEN p_size > 10 THEN 'p_size' END AS "column", CASE WHEN p_size > 10 THEN 'gt' END AS op,
              CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END AS value FROM part""",
)
def request_json_round_trip(t):
    big = F.col("p_size") > 10
    stored = fa.request_json(F.array(F.lit("p_name"), F.lit("p_brand")), F.when(big, "p_size"), F.when(big, "gt"), F.col("p_size").cast("string"))
    rows = t.part.select("p_partkey", *[c.alias(n) for n, c in stored.items()])
    rows = rows.select("p_partkey", fa.parse_selected_columns(F.col("selected_columns")).alias("c"), fa.parse_cohort_filter(F.col("cohort_filter")).alias("f"))
    return rows.select("p_partkey", F.array_join("c", ",").alias("columns"), "f.column", "f.op", "f.value")


@query(
    "parse_request_definition",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN event_type WHEN event_type = 'error' THEN NULL ELSE '' END AS picked,
              CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') END AS value FROM events""",
)
def parse_request_definition(t):
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    columns = F.when(kind == "click", F.concat(F.lit('["'), kind, F.lit('", 5, null]'))).when(kind != "error", "not json").otherwise(F.lit("[[]"))
    filters = F.when(kind == "click", F.concat(F.lit('{"column":"a","op":"eq","value":'), k, F.lit("}"))).otherwise(F.lit('{"column":1,"op":"eq"}'))
    picked = F.array_join(fa.parse_selected_columns(columns), ",")
    return t.events.select("event_id", F.when(kind != "error", picked).alias("picked"), fa.parse_cohort_filter(filters).getField("value").alias("value"))


# --- request state --------------------------------------------------------------------------------------------------

_ACTIONS = """actions AS (SELECT request_id, CASE WHEN dataset < 'D2' THEN 'approve' ELSE 'reject' END AS kind, 'boss' AS steward, justification AS steward_comment,
  DATE '2025-03-01' AS acted_at, CASE WHEN format = 'csv' THEN 'req_x' END AS output_table FROM requests WHERE status = 'pending')"""


@query(
    "transition",
    f"""{_WITH}, {_ACTIONS} SELECT r.request_id, CASE kind WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE status END AS status, a.steward, a.steward_comment,
        CASE WHEN kind = 'approve' THEN acted_at END AS approved_at, CASE WHEN kind = 'reject' THEN acted_at END AS rejected_at,
        CASE WHEN kind = 'approve' AND a.output_table IS NOT NULL THEN '/api/exports/' || r.request_id || '/download' END AS output_url,
        CASE WHEN kind = 'approve' THEN a.output_table ELSE r.output_table END AS output_table,
        CASE WHEN kind = 'approve' THEN (CASE WHEN a.output_table IS NOT NULL THEN DATE '2025-03-08' END) ELSE expires_at END AS expires_at
        FROM requests r LEFT JOIN actions a USING (request_id)""",
)
def transition(t):
    requests = _in(t, "requests").withColumns({c: F.col(c).cast("timestamp") for c in ("approved_at", "rejected_at", "expires_at")})
    actions = g.pending_only(requests).select(
        "request_id", F.when(F.col("dataset") < "D2", "approve").otherwise("reject").alias("kind"), F.lit("boss").alias("steward"),
        F.col("justification").alias("steward_comment"), F.lit("2025-03-01").cast("timestamp").alias("acted_at"), F.when(F.col("format") == "csv", "req_x").alias("output_table"),
    )
    after = g.transition(requests, actions)
    return after.select(
        "request_id", "status", "steward", "steward_comment", day("approved_at").alias("approved_at"), day("rejected_at").alias("rejected_at"),
        "output_url", "output_table", day("expires_at").alias("expires_at"),
    )


_SUBMIT = f"""{_WITH}, d AS (SELECT request_id, CASE WHEN c.dataset_id IS NULL THEN 'no_record' ELSE {_D} END AS decision FROM requests r LEFT JOIN catalog c ON c.dataset_id = r.dataset
  LEFT JOIN perms p ON p.dataset_id = c.dataset_id AND p.consent_group = c.consent_group AND p.user_id = r.submitter)"""


@query("submit_accepted", f"{_SUBMIT} SELECT request_id, submitter, dataset, 'pending' AS status FROM requests JOIN d USING (request_id) WHERE decision = 'granted'")
def submit_accepted(t):
    return g.submit(_in(t, "requests"), _in(t, "catalog"), _in(t, "perms"), NOW)[0].select("request_id", "submitter", "dataset", "status")


@query(
    "submit_blocked",
    f"""{_SUBMIT} SELECT submitter AS "user", 'submit_export' AS action_type, dataset AS resource, 'blocked' AS outcome,
        '{{"reason":"export_decision","decision":"' || decision || '"}}' AS details FROM requests JOIN d USING (request_id) WHERE decision <> 'granted'""",
)
def submit_blocked(t):
    return g.submit(_in(t, "requests"), _in(t, "catalog"), _in(t, "perms"), NOW)[1].drop("event_id", "timestamp")


@query(
    "download_gate",
    f"""{_WITH}, d AS (SELECT c.dataset_id, max(({_D}) = 'granted') AS granted FROM catalog c
        LEFT JOIN perms p ON p.dataset_id = c.dataset_id AND p.consent_group = c.consent_group AND p.user_id = '{USER}' GROUP BY c.dataset_id)
        SELECT request_id, CASE WHEN NOT (status = 'approved' AND coalesce(output_table, '') <> '') THEN 'not_found' WHEN submitter <> '{USER}' THEN 'not_your_request'
        WHEN expires_at < DATE '1998-01-01' THEN 'export_expired' WHEN NOT coalesce(granted, false) THEN 'access_revoked' ELSE 'allowed' END AS gate
        FROM requests LEFT JOIN d ON dataset_id = dataset""",
)
def download_gate(t):
    decisions = g.export_decision(_in(t, "catalog"), _in(t, "perms"), USER, NOW)
    return g.download_decisions(_in(t, "requests"), decisions, USER, True, F.lit("1998-01-01").cast("date")).select("request_id", "gate")


@query(
    "sync_role",
    f"""{_WITH} SELECT user_id, CASE WHEN poc_role IS NULL THEN NULL WHEN role = 'MACHINERY' THEN 'steward' WHEN role IN ('BUILDING', 'HOUSEHOLD') THEN 'analyst' ELSE poc_role END AS poc_role FROM perms""",
)
def sync_role(t):
    perms = _in(t, "perms")
    stewards = perms.where(F.col("role") == "MACHINERY").select("user_id")
    analysts = perms.where(F.col("role").isin("BUILDING", "HOUSEHOLD", "MACHINERY")).select("user_id")
    return g.sync_role(perms, stewards, analysts).select("user_id", "poc_role")


@query("role_listing", f"{_WITH} SELECT DISTINCT user_id, poc_role FROM perms")
def role_listing(t):
    return g.role_listing(_in(t, "perms"))


@query(
    "role_difference",
    f"{_WITH} SELECT DISTINCT user_id FROM perms WHERE poc_role = 'analyst' AND user_id NOT IN (SELECT user_id FROM perms WHERE role = 'MACHINERY')",
)
def role_difference(t):
    perms = _in(t, "perms")
    return combine.role_difference(perms.where(F.col("poc_role") == "analyst"), perms.where(F.col("role") == "MACHINERY"))


@query(
    "grant_missing",
    f"""{_WITH}, held AS (SELECT user_id, dataset_id, consent_group FROM perms WHERE expiration_ts IS NOT NULL)
        SELECT * FROM held UNION ALL SELECT user_id, dataset_id, consent_group FROM perms WHERE (user_id, dataset_id, consent_group) NOT IN (SELECT (user_id, dataset_id, consent_group) FROM held)""",
)
def grant_missing(t):
    perms = _in(t, "perms").select("user_id", "dataset_id", "consent_group", "expiration_ts")
    return g.grant_missing(perms.where(F.col("expiration_ts").isNotNull()), perms).drop("expiration_ts")


@query(
    "default_role_expiry",
    f"{_WITH} SELECT user_id, coalesce(role, '') AS role, coalesce(expiration_ts, 0) AS expiration_ts FROM perms",
)
def default_role_expiry(t):
    return g.default_role_expiry(_in(t, "perms")).select("user_id", "role", "expiration_ts")


# --- audit -----------------------------------------------------------------------------------------------------------


def _audit(t):
    k = F.get_json_object("props", "$.k").cast("int")
    full, name = F.concat(F.lit("governed.default.t"), k.cast("string")), F.concat(F.lit("governed"), k.cast("string"))
    params = F.when(k % 3 == 0, F.create_map(F.lit("full_name_arg"), full)).when(k % 3 == 1, F.create_map(F.lit("name_arg"), name)).otherwise(F.create_map(F.lit("x"), full))
    return t.events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"), day("ts").alias("event_date"),
        F.struct(F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("email")).alias("user_identity"),
        F.lit("svc").alias("service_name"), F.col("event_type").alias("action_name"), params.alias("request_params"),
        F.struct((k + 200).alias("status_code")).alias("response"),
    )


_AUDIT = """WITH a AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_time, CAST(ts AS DATE) AS event_date, CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) ELSE '' END AS user_email,
  'svc' AS service_name, event_type AS action_name, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
  p AS (SELECT *, CASE k % 3 WHEN 0 THEN 'governed.default.t' || k WHEN 1 THEN 'governed' || k ELSE '' END AS target, CAST(k + 200 AS VARCHAR) AS status_code FROM a)"""
_AUDIT_COLS = "event_time, user_email, service_name, action_name, target, status_code"
_PATTERNS = ("governed.default.%", "governed%")


def _today():
    return F.lit("2024-02-10").cast("date")


@query("recent_governed_audit", f"{_AUDIT} SELECT event_id FROM p WHERE event_date >= DATE '2024-02-10' - 30 AND target <> ''")
def recent_governed_audit(t):
    return g.recent_governed_audit(_audit(t), _today(), _PATTERNS).select("event_id")


@query("audit_projection", f"{_AUDIT} SELECT {_AUDIT_COLS} FROM p")
def audit_projection(t):
    return g.audit_projection(_audit(t))


@query("system_audit", f"{_AUDIT} SELECT {_AUDIT_COLS} FROM p WHERE event_date >= DATE '2024-02-10' - 30 AND target <> '' ORDER BY event_time DESC LIMIT 200")
def system_audit(t):
    return g.system_audit(_audit(t), _today(), _PATTERNS, 200)


@query(
    "event_envelope",
    """SELECT CAST(user_id AS VARCHAR) AS "user", event_type AS action_type, 'res' AS resource, 'allowed' AS outcome, '{"egress_path":"' || event_type || '"}' AS details,
       event_type AS path, true AS has_id FROM events""",
)
def event_envelope(t):
    events = g.event_envelope(t.events, F.col("user_id").cast("string"), F.col("event_type"), F.lit("res"), "allowed", F.struct(F.col("event_type").alias("egress_path")))
    return events.select(
        "user", "action_type", "resource", "outcome", "details", fa.egress_path(F.col("details")).alias("path"), (F.length("event_id") == 36).alias("has_id")
    )


@query("egress_path", "SELECT event_id, coalesce(json_extract_string(props, '$.egress_path'), '—') AS path FROM events")
def egress_path(t):
    return t.events.select("event_id", fa.egress_path(F.col("props")).alias("path"))


# --- the flow of requests, from submission to download ------------------------------------------------------------------

# Who asks for what, what stewards do about it, and who comes for it when; the same text for both engines.
_COHORT = """CASE justification WHEN '1-URGENT' THEN '{{"column":"C_ACCTBAL","op":"gt","value":5000}}' WHEN '2-HIGH' THEN '{{"column":"c_mktsegment","op":"eq","value":"BUILDING"}}'
  WHEN '3-MEDIUM' THEN '{{"column":" c_name","op":"contains","value":"r#00000001"}}' WHEN '5-LOW' THEN '{{"column":"c_acctbal","op":"gt","value":"much"}}' END"""
_FLOW = {
    "asked": f"""SELECT request_id, submitter, dataset, justification, format, CAST(created_at AS TIMESTAMP) AS created_at,
  CASE WHEN format = 'json' THEN '["c_name"," C_ACCTBAL","nothing"]' ELSE '[]' END AS selected_columns, {_COHORT} AS cohort_filter FROM {{requests}}""",
    "actions": """SELECT request_id, CASE WHEN status = 'rejected' THEN 'approve' ELSE 'reject' END AS kind, 'stew' AS steward, justification <> '5-LOW' AS is_steward,
  'seen' AS steward_comment, CAST(created_at AS TIMESTAMP) + INTERVAL '1' DAY AS acted_at FROM {requests} WHERE status <> 'pending'""",
    "attempts": f"""SELECT request_id AS attempt_id, request_id, CASE WHEN justification = '4-NOT SPECIFIED' THEN '{USER}' ELSE submitter END AS user, justification <> '2-HIGH' AS enabled,
  CAST(created_at AS TIMESTAMP) + CASE WHEN justification = '3-MEDIUM' THEN INTERVAL '11' DAY ELSE INTERVAL '3' DAY END AS at FROM {{requests}}""",
    "sources": """SELECT 'D' || CAST(c_nationkey AS STRING) AS dataset_id, c_name, c_acctbal, c_mktsegment FROM {customer} WHERE c_nationkey % 5 > 1""",
}
_COHORT_SQL = """CASE justification WHEN '1-URGENT' THEN c_acctbal > 5000 WHEN '2-HIGH' THEN c_mktsegment = 'BUILDING' WHEN '3-MEDIUM' THEN c_name ILIKE '%r#00000001%' ELSE true END"""
_FLOW_WITH = f"""{_WITH.replace("expires_at", "earlier_expiry")}, {", ".join(f"{n} AS ({s.replace(' AS user,', ' AS who,').format(requests='requests', customer='customer')})" for n, s in _FLOW.items())},
  judged AS (SELECT a.*, CASE WHEN c.dataset_id IS NULL THEN 'no_record' ELSE {_D} END AS d FROM asked a LEFT JOIN catalog c ON c.dataset_id = a.dataset
    LEFT JOIN perms p ON p.dataset_id = c.dataset_id AND p.consent_group = c.consent_group AND p.user_id = a.submitter),
  sizes AS (SELECT request_id, count(*) FILTER ({_COHORT_SQL}) AS n FROM judged JOIN sources ON dataset = dataset_id GROUP BY 1),
  state AS (SELECT j.*, CASE WHEN is_steward THEN kind END AS did, acted_at, CASE WHEN is_steward AND kind = 'approve' THEN n END AS row_count,
      CASE WHEN is_steward AND kind = 'approve' AND n IS NOT NULL THEN 'req_' || replace(request_id, '-', '_') END AS output
    FROM judged j LEFT JOIN actions USING (request_id) LEFT JOIN sizes USING (request_id) WHERE d = 'granted'),
  tried AS (SELECT t.request_id, who, s.dataset, s.submitter, row_count, output, format, CASE WHEN output IS NULL THEN 'not_found' WHEN submitter <> who THEN 'not_your_request' WHEN acted_at + INTERVAL 7 DAY < "at" THEN 'export_expired'
      WHEN {_ruled("decision", "p.user_id", "p.expiration_ts", 'epoch("at")')} <> 'granted' THEN 'access_revoked' WHEN NOT enabled THEN 'downloads_disabled' ELSE 'allowed' END AS gate
    FROM attempts t LEFT JOIN state s USING (request_id) LEFT JOIN catalog c ON c.dataset_id = s.dataset
    LEFT JOIN perms p ON p.dataset_id = c.dataset_id AND p.consent_group = c.consent_group AND p.user_id = who)"""


def _flow(t):
    """A store after all submissions, all actions and all attempts."""
    requests, given = _in(t, "requests"), {}
    for name, sql in _FLOW.items():
        given[name] = t.spark.sql(sql, requests=requests) if "{requests}" in sql else t.spark.sql(sql, customer=t.customer)
    own = store.RequestStore(t.spark, new_folder(t.spark, "requests"))
    catalog, perms = _in(t, "catalog"), _in(t, "perms")
    store.submit(own, given["asked"], catalog, perms, NOW)
    store.decide(own, given["actions"], catalog, given["sources"])
    store.record_downloads(own, given["attempts"], catalog, perms)
    return own


@query(
    "export_flow",
    f"""{_FLOW_WITH}
  SELECT submitter AS "user", 'submit_export' AS action_type, dataset AS resource, CASE WHEN d = 'granted' THEN 'submitted' ELSE 'blocked' END AS outcome, CASE WHEN d = 'granted'
    THEN '{{"id":"' || request_id || '","submitter":"' || submitter || '","dataset":"' || dataset || '","justification":"' || justification || '","format":"' || format || '","status":"pending","created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') || '"}}'
    ELSE '{{"reason":"export_decision","decision":"' || d || '"}}' END AS details FROM judged
  UNION ALL SELECT 'stew', kind || '_export', request_id, 'blocked', '{{"reason":"not_a_steward"}}' FROM actions WHERE NOT is_steward
  UNION ALL SELECT 'stew', 'reject_export', dataset, 'rejected', '{{"id":"' || request_id || '"}}' FROM state WHERE did = 'reject'
  UNION ALL SELECT 'stew', 'approve_export', dataset, 'approved', '{{"id":"' || request_id || '",' || coalesce('"output_table":"' || output || '","expires_at":"' || strftime(acted_at + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') || '","row_count":' || row_count || ',', '')
    || '"cohort_projected":' || (output IS NOT NULL AND format = 'json') || ',"cohort_filtered":' || (output IS NOT NULL AND justification IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) || '}}' FROM state WHERE did = 'approve'
  UNION ALL SELECT who, 'download_export', coalesce(dataset, ''), CASE WHEN gate = 'allowed' THEN 'allowed' ELSE 'blocked' END, CASE WHEN gate = 'allowed'
    THEN '{{"id":"' || request_id || '","output_table":"' || output || '","row_count":' || row_count || ',"format":"' || format || '","egress_path":"direct_download"}}'
    ELSE '{{"id":"' || request_id || '","reason":"' || gate || '","egress_path":"direct_download"}}' END FROM tried""",
)
def export_flow(t):
    """The audit events of the whole flow."""
    return _flow(t).events().select("user", "action_type", "resource", "outcome", "details")


@query(
    "export_flow_requests",
    f"""{_FLOW_WITH} SELECT request_id, submitter, CASE did WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS status, output AS output_table, row_count,
  CASE WHEN output IS NOT NULL THEN CAST(acted_at + INTERVAL 7 DAY AS DATE) END AS expires_on, CASE WHEN did IS NOT NULL THEN 'stew' END AS steward FROM state""",
)
def export_flow_requests(t):
    """The requests as the flow leaves them."""
    return _flow(t).requests().select("request_id", "submitter", "status", "output_table", "row_count", day("expires_at").alias("expires_on"), "steward")


# --- lists ---------------------------------------------------------------------------------------------------------


@query(
    "status_counts",
    f"""{_WITH} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected FROM requests""",
)
def status_counts(t):
    return quality.status_counts(_in(t, "requests"), "status", ["pending", "approved", "rejected"])


@query(
    "search",
    f"{_WITH} SELECT request_id, dataset, justification FROM requests WHERE lower(dataset) LIKE '%high%' OR lower(justification) LIKE '%high%'",
)
def search(t):
    return ordering.search(_in(t, "requests"), "  High ", ["dataset", "justification"]).select("request_id", "dataset", "justification")


@query("facet", f"{_WITH} SELECT request_id, status FROM requests WHERE status = 'approved'")
def facet(t):
    return ordering.facet(ordering.facet(_in(t, "requests"), "status", "approved"), "format", "all").select("request_id", "status")


@query("page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page(t):
    return ordering.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3, ordering.PREVIEW_PAGE)


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def top_n(t):
    return ordering.top_n(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 200)


@query("newest_first", f"{_WITH} SELECT request_id, created_at FROM requests")
def newest_first(t):
    return ordering.newest_first(_in(t, "requests").select("request_id", "created_at"), "created_at", ["request_id"])


@query("order_by", f"{_WITH} SELECT dataset_id, study_name FROM catalog ORDER BY study_name")
def order_by(t):
    return ordering.order_by(_in(t, "catalog").select("dataset_id", "study_name"), ["study_name"])
