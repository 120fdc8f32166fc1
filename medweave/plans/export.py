"""Cohort definition and export artifacts."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from medweave.functions.access import EXPORT_DAYS, RESERVED_COLUMNS, clean_location, parse_cohort_filter, parse_selected_columns
from medweave.operators.ordering import Order, top_n
from medweave.plans import governance as g
from medweave.sources.files import list_files, read_files
from medweave.sources.tables import to_csv_rfc4180, to_json


def dataset_meta(catalog: DataFrame, dataset_id: str) -> DataFrame:
    """Location and consent context of a dataset; no row when the catalog lacks it."""
    return catalog.where(F.col("dataset_id") == dataset_id).select(
        clean_location(F.col("volume_location")).alias("location"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("consent_group", "access_tier", "dbgap_status")],
    )


def _by_lower(df: DataFrame) -> dict[str, str]:
    return {c.lower(): c for c in df.columns}


def project_whitelist(df: DataFrame, requested: list[str]) -> DataFrame:
    """The requested columns that exist, in the order asked for; all columns when none does."""
    known = _by_lower(df)
    picked = dict.fromkeys(known[r.strip().lower()] for r in requested if r.strip().lower() in known)
    kept = [c for c in picked if c.lower() not in RESERVED_COLUMNS]
    return df.select(*[F.col(f"`{c}`") for c in kept]) if kept else df


def _number(text: str) -> float | None:
    """A finite number in decimal, hexadecimal, octal or binary notation; blank text is 0."""
    t = text.strip()
    if not t:
        return 0.0
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", t):
        return float(int(t, 0))
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t):
        return None
    value = float(t)
    return value if math.isfinite(value) else None


COMPARE = {
    "eq": Column.__eq__, "ne": Column.__ne__, "lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__,
}


def cohort_condition(df: DataFrame, definition: dict | None) -> Column | None:
    """The condition of a ``{column, op, value}`` filter; None when any part of it is not usable."""
    if not definition or not definition.get("column") or not definition.get("op"):
        return None
    column = _by_lower(df).get(definition["column"].strip().lower())
    op, value = definition["op"], str(definition.get("value") if definition.get("value") is not None else "")
    if column is None:
        return None
    c = F.col(f"`{column}`")
    if op == "contains":
        return c.cast("string").ilike(f"%{value}%")
    if op not in COMPARE:
        return None
    if op in ("eq", "ne"):
        return COMPARE[op](c.cast("string"), F.lit(value))
    number = _number(value)
    return None if number is None else COMPARE[op](c.try_cast("double"), F.lit(number))


def cohort_filter(df: DataFrame, definition: dict | None) -> DataFrame:
    condition = cohort_condition(df, definition)
    return df if condition is None else df.where(condition)


def consent_columns(df: DataFrame, meta: dict[str, str], at: Column | None = None) -> DataFrame:
    """Append what an exported row is allowed for, and to whom."""
    names = {
        "_consent_group": "consent_group", "_dbgap_accession": "dataset", "_access_tier": "access_tier",
        "_exported_for": "submitter", "_access_expires_at": "expires_at", "_request_id": "request_id",
    }
    stamp = F.current_timestamp() if at is None else at
    return df.withColumns({n: F.lit(meta.get(k) or "") for n, k in names.items()} | {"_exported_at": stamp})


def export_rows(source: DataFrame, columns: list[str], definition: dict | None, meta: dict[str, str], cap: int | None = None, at: Column | None = None, order: Order = ()) -> DataFrame:
    """The rows of an artifact: filter, projection, consent columns. All rows; with ``cap`` the first so many in ``order``."""
    rows = cohort_filter(source, definition)
    if cap is not None:
        if not order:
            raise ValueError("a cap needs the order that says which rows stay")
        rows = top_n(rows, order, cap)
    return consent_columns(project_whitelist(rows, columns), meta, at)


def artifact_table(request_id: str) -> str:
    return "req_" + re.sub(r"[^a-zA-Z0-9]", "_", request_id)


def export_artifact(
    spark: SparkSession, catalog: DataFrame, database: str, request: dict, steward: str, expires_at: str, cap: int | None = None, order: Order = ()
) -> dict | None:
    """Write the artifact of a request as a table with its provenance as table properties.

    ``request`` holds ``request_id, dataset, submitter, selected_columns, cohort_filter``. Nothing is
    written, and None returned, when the dataset has no files. With ``cap`` the properties also say how many
    rows there were.
    """
    meta = dataset_meta(catalog, request["dataset"]).first()
    if meta is None or not meta["location"]:
        return None
    first = list_files(spark, meta["location"]).orderBy("name").first()
    if first is None:
        return None
    source = read_files(spark, meta["location"], first["name"])
    columns, definition = request.get("selected_columns") or [], request.get("cohort_filter")
    given = {**meta.asDict(), "dataset": request["dataset"], "submitter": request["submitter"], "expires_at": expires_at, "request_id": request["request_id"]}
    rows = export_rows(source, columns, definition, given, cap, order=order)
    filtered = cohort_condition(source, definition) is not None
    projected = project_whitelist(source, columns) is not source
    tags = {
        "request_id": request["request_id"], "dataset": request["dataset"], "consent_group": given["consent_group"],
        "access_tier": given["access_tier"], "submitter": request["submitter"], "approved_by": steward, "expires_at": expires_at,
        "cohort_filtered": str(filtered).lower(), "cohort_projected": str(projected).lower(),
    }
    if cap is not None:
        total = cohort_filter(source, definition).count()
        tags |= {"capped": str(total > cap).lower(), "row_count_before_cap": str(total)}
    table = f"{database}.{artifact_table(request['request_id'])}"
    rows.write.mode("overwrite").format("parquet").saveAsTable(table)
    listed = ", ".join("'{}' = '{}'".format(k, v.replace("\\", "\\\\").replace("'", "\\'")) for k, v in tags.items())
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({listed})")
    return {"table": table, "row_count": spark.table(table).count(), "projected": projected, "filtered": filtered}


def deliver(spark: SparkSession, table: str, fmt: str, path: str) -> None:
    """Write an artifact in the format asked for: JSON or, by default, CSV."""
    df = spark.table(table)
    to_json(df, path) if (fmt or "csv").lower() in ("json", "jsonl") else to_csv_rfc4180(df, path)


def approve(
    spark: SparkSession, requests: DataFrame, catalog: DataFrame, database: str, request_id: str, steward: str, comment: str | None, at: str,
    is_steward: bool, cap: int | None = None, order: Order = (),
) -> tuple[DataFrame, DataFrame]:
    """A steward approves one request: the requests as they are then, and the audit event.

    The stored cohort definition is checked against the source again when the artifact is written; a
    dataset without files is approved without an output. Anyone else leaves the requests as they are.
    """
    when = F.lit(at).cast("timestamp")
    one = requests.where(F.col("request_id") == request_id)
    if not is_steward:
        reason = F.struct(F.lit("not_a_steward").alias("reason"))
        return requests, g.event_envelope(spark.range(1), F.lit(steward), "approve_export", F.lit(request_id), "blocked", reason, when)
    row = one.select(
        "request_id", "dataset", "submitter", parse_selected_columns(F.col("selected_columns")).alias("selected_columns"),
        parse_cohort_filter(F.col("cohort_filter")).alias("cohort_filter"), (when + F.make_dt_interval(F.lit(EXPORT_DAYS))).cast("string").alias("until"),
    ).first()
    if row is None:
        raise LookupError(f"no request {request_id}")
    asked = row.asDict(recursive=True)
    made = export_artifact(spark, catalog, database, asked, steward, row["until"], cap, order)
    action = spark.range(1).select(
        F.lit(request_id).alias("request_id"), F.lit("approve").alias("kind"), F.lit(steward).alias("steward"), F.lit(comment).cast("string").alias("steward_comment"),
        when.alias("acted_at"), F.lit(made and made["table"]).cast("string").alias("output_table"),
    )
    details = F.struct(
        F.lit(request_id).alias("id"), F.lit(made and made["table"]).cast("string").alias("output_table"), F.lit(made and made["row_count"]).cast("long").alias("row_count"),
        F.lit(bool(made and made["projected"])).alias("cohort_projected"), F.lit(bool(made and made["filtered"])).alias("cohort_filtered"),
    )
    event = g.event_envelope(one, F.lit(steward), "approve_export", F.col("dataset"), "approved", details, when)
    return g.transition(requests, action), event


def download(
    spark: SparkSession, requests: DataFrame, decisions: DataFrame, request_id: str, user: str, enabled: bool, at: str, path: str
) -> tuple[str, DataFrame]:
    """Deliver an artifact when every gate is open: the gate that decided, and the audit event."""
    when = F.lit(at).cast("timestamp")
    gated = g.download_decisions(requests.where(F.col("request_id") == request_id), decisions, user, enabled, when)
    row = gated.select("gate", "output_table", "format", "dataset").first()
    gate = "not_found" if row is None else row["gate"]
    if gate == "allowed":
        deliver(spark, row["output_table"], row["format"], path)
    details = F.struct(F.lit(request_id).alias("id"), F.lit(gate).alias("reason"), F.lit("direct_download").alias("egress_path"))
    outcome = "allowed" if gate == "allowed" else "blocked"
    event = g.event_envelope(spark.range(1), F.lit(user), "download_export", F.lit(row["dataset"] if row else ""), outcome, details, when)
    return gate, event
