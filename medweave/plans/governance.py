"""Access decisions, row visibility, the review queue and request state.

``now`` is seconds since 1970 (a number or a column) where permissions expire, a timestamp where
grants are revoked; the user and what groups they are in are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from medweave.functions import access as fa
from medweave.operators.combine import merge_insert
from medweave.operators.skew import skew_join

Now = int | Column


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def default_role_expiry(df: DataFrame) -> DataFrame:
    return df.withColumns({"role": F.coalesce("role", F.lit("")), "expiration_ts": F.coalesce("expiration_ts", F.lit(0).cast("long"))})


def _decided(df: DataFrame, now: Now, prefix: str = "") -> dict[str, Column]:
    args = (F.col("access_tier"), F.col("_holder"), F.col("_expires"), _col(now))
    return {f"{prefix}decision": fa.access_decision(*args), f"{prefix}decision_basis": fa.decision_basis(*args)}


def _permissions(perms: DataFrame) -> DataFrame:
    return perms.select("dataset_id", "consent_group", F.col("user_id").alias("_holder"), F.col("role").alias("_role"), F.col("expiration_ts").alias("_expires"))


def _decision_view(joined: DataFrame, user: Column, now: Now) -> DataFrame:
    view = joined.select(
        "dataset_id", "access_tier", "dbgap_status", user.alias("user_id"), F.col("_role").alias("role"),
        F.col("_expires").alias("expiration_ts"), *[c.alias(n) for n, c in _decided(joined, now).items()],
    )
    return default_role_expiry(view)


def export_decision(catalog: DataFrame, perms: DataFrame, user: str, now: Now) -> DataFrame:
    """One user's decision for every dataset. Two permission rows for one dataset give two rows."""
    own = _permissions(perms.where(F.col("user_id") == user))
    return _decision_view(skew_join(catalog, own, ["dataset_id", "consent_group"], "left"), F.lit(user), now)


def export_decision_all(catalog: DataFrame, perms: DataFrame, now: Now, is_steward: bool) -> DataFrame:
    """Everyone's decisions, for stewards only.

    Most rows come from the permissions, of which one dataset may hold a large share: they are the
    side that is split, and datasets nobody has a permission for are added.
    """
    keys = ["dataset_id", "consent_group"]
    held = skew_join(_permissions(perms), catalog, keys, "inner")
    bare = catalog.join(perms.select(*keys).distinct(), keys, "left_anti")
    joined = held.unionByName(bare, allowMissingColumns=True)
    view = _decision_view(joined, F.coalesce("_holder", F.lit("")), now)
    return view.where(F.lit(is_steward))


def pending_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "pending")


QUEUE = [
    "request_id", "submitter", "dataset", "justification", "format", "status", "created_at", "steward", "steward_comment",
    "approved_at", "rejected_at", "output_url", "selected_columns", "cohort_filter", "study_name", "access_tier",
    "dbgap_status", "consent_group",
]


def request_decisions(requests: DataFrame, catalog: DataFrame, perms: DataFrame, now: Now) -> DataFrame:
    """Requests with what the catalog says of their dataset and the decision for their submitter."""
    known = catalog.withColumnRenamed("dataset_id", "dataset")
    joined = skew_join(requests, known, ["dataset"], "left")
    held = _permissions(perms).select(
        F.col("dataset_id").alias("dataset"), "consent_group", F.col("_holder").alias("submitter"), "_holder", "_role", "_expires"
    )
    return skew_join(joined, held, ["dataset", "consent_group", "submitter"], "left")


def steward_queue(requests: DataFrame, catalog: DataFrame, perms: DataFrame, now: Now, is_steward: bool) -> DataFrame:
    """Pending requests with the submitter's decision, for stewards only."""
    joined = request_decisions(pending_only(requests), catalog, perms, now)
    decided = _decided(joined, now, "submitter_")
    return joined.select(
        *[c for c in QUEUE if c in joined.columns],
        F.coalesce("_role", F.lit("")).alias("submitter_role"),
        F.coalesce("_expires", F.lit(0).cast("long")).alias("submitter_expiration_ts"),
        *[c.alias(n) for n, c in decided.items()],
    ).where(F.lit(is_steward))


def my_requests(requests: DataFrame, catalog: DataFrame, user: str) -> DataFrame:
    """A user's requests with the consent group of the dataset, newest first."""
    own = requests.where(F.col("submitter") == user)
    groups = catalog.select(F.col("dataset_id").alias("dataset"), "consent_group")
    return skew_join(own, groups, ["dataset"], "left").orderBy(F.desc("created_at"), "request_id")


def row_scope(df: DataFrame, user: str, is_steward: bool, owner: str = "user") -> DataFrame:
    """All rows for stewards, their own for everyone else."""
    return df if is_steward else df.where(F.col(owner) == user)


def identity_flags(spark: SparkSession, groups: DataFrame, user: str, steward: str = "stewards", analyst: str = "analysts") -> DataFrame:
    """One row: the user and which of the two groups they are in (``groups``: ``user_id, group``)."""
    own = groups.where(F.col("user_id") == user)
    flags = [F.coalesce(F.bool_or(F.col("group") == g), F.lit(False)).alias(n) for g, n in ((steward, "is_steward"), (analyst, "is_analyst"))]
    return own.agg(*flags).select(F.lit(user).alias("user_email"), "is_steward", "is_analyst")


# --- consent ---------------------------------------------------------------------------------------------


def active_grants(grants: DataFrame, now: Column) -> DataFrame:
    return grants.where(F.col("revoked_at").isNull() | (F.col("revoked_at") > now))


def consent_filter(df: DataFrame, grants: DataFrame, user: str, now: Column, tag: str = "_consents_") -> DataFrame:
    """Rows whose tag the user has an active grant for."""
    tags = active_grants(grants, now).where(F.col("user_email") == user).select(F.col("consent_tag").alias(tag)).distinct()
    return skew_join(df, tags, [tag], "left_semi")


def register_active_consent(spark: SparkSession, grants_view: str, name: str = "has_active_consent") -> None:
    """SQL function ``name(user, tag, now)``: the same test inside a query, planned as a join by Spark.

    It asks whether the pair is among the grants, each read as the time it ends; one that was not revoked ends never.
    """
    ends = "coalesce(revoked_at, timestamp'9999-12-31')"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(who STRING, tag STRING, at TIMESTAMP) RETURNS BOOLEAN "
        f"RETURN (who, tag) IN (SELECT user_email, consent_tag FROM {grants_view} WHERE at < {ends})"
    )


# --- platform audit -----------------------------------------------------------------------------------------

# The request parameters that can name an event's target.
TARGET_KEYS = ("full_name_arg", "name_arg")


def audit_projection(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("event_time").cast("string").alias("event_time"),
        F.coalesce("user_identity.email", F.lit("")).alias("user_email"),
        "service_name",
        "action_name",
        fa.map_first(F.col("request_params"), *TARGET_KEYS).alias("target"),
        F.col("response.status_code").cast("string").alias("status_code"),
    )


def recent_governed_audit(df: DataFrame, today: Column, patterns: tuple[str, str], days: int = 30) -> DataFrame:
    """Events of the last days whose first or second name argument matches its LIKE pattern."""
    names = [F.try_element_at("request_params", F.lit(k)).like(p) for k, p in zip(TARGET_KEYS, patterns)]
    recent = df.where(F.col("event_date") >= F.date_sub(today, days))
    return recent.where(F.coalesce(names[0], F.lit(False)) | F.coalesce(names[1], F.lit(False)))


def system_audit(df: DataFrame, today: Column, patterns: tuple[str, str], limit: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``limit`` newest matching events; ``ties`` order those of one time."""
    return audit_projection(recent_governed_audit(df, today, patterns).orderBy(F.desc("event_time"), *ties).limit(limit))


# --- roles and permissions ------------------------------------------------------------------------------------


def sync_role(perms: DataFrame, stewards: DataFrame, analysts: DataFrame) -> DataFrame:
    """``poc_role`` from the two groups, steward first; others keep theirs. A role that is NULL stays NULL."""
    members = stewards.select("user_id", F.lit(2).alias("_rank")).unionByName(analysts.select("user_id", F.lit(1).alias("_rank")))
    ranked = members.groupBy("user_id").agg(F.max("_rank").alias("_rank"))
    joined = skew_join(perms, ranked, ["user_id"], "left")
    role = F.when(F.col("_rank") == 2, F.lit("steward")).when(F.col("_rank") == 1, F.lit("analyst"))
    changed = role.isNotNull() & (F.col("poc_role") != role)
    return joined.withColumn("poc_role", F.when(changed, role).otherwise(F.col("poc_role"))).select(*perms.columns)


def role_listing(df: DataFrame) -> DataFrame:
    return df.select("user_id", "poc_role").distinct().orderBy("user_id", "poc_role")


def grant_missing(perms: DataFrame, rows: DataFrame) -> DataFrame:
    """Add permissions that are not there yet."""
    return merge_insert(perms, rows, ["user_id", "dataset_id", "consent_group"])


def seed(spark: SparkSession, rows: list[tuple], schema: str, table: str) -> None:
    """Replace a table by literal rows."""
    spark.createDataFrame(rows, schema).write.mode("overwrite").format("parquet").saveAsTable(table)


# --- requests ----------------------------------------------------------------------------------------------------


def submit(requests: DataFrame, catalog: DataFrame, perms: DataFrame, now: Now) -> tuple[DataFrame, DataFrame]:
    """Split submitted requests by their submitter's decision: pending requests, blocked events.

    A dataset the catalog lacks has no decision. Of several permission rows one that grants is enough.
    """
    joined = request_decisions(requests, catalog, perms, now)
    decision = F.when(F.col("access_tier").isNull(), F.lit("no_record")).otherwise(_decided(joined, now)["decision"])
    best = F.max(F.struct((F.col("_d") == fa.GRANTED).alias("granted"), F.col("_d").alias("decision")))
    per_request = joined.withColumn("_d", decision).groupBy("request_id").agg(best.alias("_b"))
    decided = requests.join(per_request, "request_id")
    granted = F.col("_b.granted")
    pending = decided.where(granted).drop("_b").withColumn("status", F.lit("pending"))
    blocked = event_envelope(
        decided.where(~granted), F.col("submitter"), "submit_export", F.col("dataset"), "blocked",
        F.struct(F.lit("export_decision").alias("reason"), F.col("_b.decision").alias("decision")),
    )
    return pending, blocked


def transition(requests: DataFrame, actions: DataFrame) -> DataFrame:
    """Requests after the stewards' actions (``request_id, kind, steward, steward_comment, acted_at, output_table``).

    Approval sets the output columns only when there is an output, which can be had for seven days;
    rejection leaves them alone. There is at most one action per request.
    """
    a = actions.select(
        "request_id", F.col("kind").alias("_kind"), F.col("steward").alias("_steward"), F.col("steward_comment").alias("_comment"),
        F.col("acted_at").alias("_at"), F.col("output_table").alias("_output"),
    )
    joined = requests.join(a, "request_id", "left")
    acted, approved, rejected = F.col("_kind").isNotNull(), F.col("_kind") == "approve", F.col("_kind") == "reject"
    has_output = F.col("_output").isNotNull()
    url = F.concat(F.lit("/api/exports/"), F.col("request_id"), F.lit("/download"))
    changes = {
        "status": F.when(approved, "approved").when(rejected, "rejected").otherwise(F.col("status")),
        "steward": F.when(acted, F.col("_steward")).otherwise(F.col("steward")),
        "steward_comment": F.when(acted, F.col("_comment")).otherwise(F.col("steward_comment")),
        "approved_at": F.when(approved, F.col("_at")).otherwise(F.col("approved_at")),
        "rejected_at": F.when(rejected, F.col("_at")).otherwise(F.col("rejected_at")),
        "output_url": F.when(approved, F.when(has_output, url)).otherwise(F.col("output_url")),
        "output_table": F.when(approved, F.col("_output")).otherwise(F.col("output_table")),
        "expires_at": F.when(approved, F.when(has_output, F.col("_at") + F.make_dt_interval(F.lit(fa.EXPORT_DAYS)))).otherwise(F.col("expires_at")),
    }
    return joined.select(*[(changes.get(c, F.col(c))).alias(c) for c in requests.columns])


def event_envelope(
    df: DataFrame, user: Column, action: str | Column, resource: Column, outcome: str | Column, details: Column, at: Column | None = None
) -> DataFrame:
    """Audit events: a new id, the time, who did what with which outcome, details as JSON."""
    return df.select(
        F.uuid().alias("event_id"),
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        user.alias("user"),
        _col(action).alias("action_type"),
        resource.alias("resource"),
        _col(outcome).alias("outcome"),
        F.to_json(details).alias("details"),
    )


def append_audit(events: DataFrame, table: str) -> None:
    events.write.mode("append").format("parquet").saveAsTable(table)


def download_decisions(requests: DataFrame, decisions: DataFrame, user: str, enabled: bool, now: Column) -> DataFrame:
    """The gate for each request when ``user`` asks for it; ``decisions`` are that user's."""
    per_dataset = decisions.groupBy(F.col("dataset_id").alias("dataset")).agg(
        F.max(F.struct((F.col("decision") == fa.GRANTED).alias("granted"), "decision")).alias("_b")
    )
    joined = skew_join(requests, per_dataset, ["dataset"], "left")
    gate = fa.download_gate(
        F.col("status"), F.col("output_table"), F.col("submitter"), F.col("expires_at"), F.lit(user), F.col("_b.decision"), F.lit(enabled), now
    )
    return joined.withColumn("gate", gate).drop("_b")
