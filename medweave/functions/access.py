"""Access decisions, requests and audit records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GRANTED, REVIEW, DENIED = "granted", "flagged_for_review", "denied"

# The explanation shown with each outcome.
BASIS = {
    "open": "Public/open-access dataset — no DAR required",
    "unregistered": "Dataset not yet linked to a dbGaP study — no consent group to verify against",
    "valid": "Approved DAR matches dataset consent group and has not expired",
    "expired": "DAR for this dataset/consent group has expired",
    "missing": "No matching approved DAR found for this dataset/consent group",
}
RESERVED_COLUMNS = ("_rescued_data",)
EXPORT_DAYS = 7


def _case(tier: Column, holder: Column, expires: Column, now: Column) -> Column:
    """Which of the five situations applies; ``holder`` is NULL without a permission row."""
    held = F.when(expires.isNull() | (expires > now), "valid").otherwise("expired")
    return (
        F.when(tier == "open_access", "open")
        .when(tier == "unregistered", "unregistered")
        .when(holder.isNotNull(), held)
        .otherwise("missing")
    )


def access_decision(tier: Column, holder: Column, expires: Column, now: Column) -> Column:
    case = _case(tier, holder, expires, now)
    return F.when(case.isin("open", "valid"), GRANTED).when(case == "unregistered", REVIEW).otherwise(DENIED)


def decision_basis(tier: Column, holder: Column, expires: Column, now: Column) -> Column:
    case = _case(tier, holder, expires, now)
    chosen = F.lit(BASIS["missing"])
    for name in ("expired", "valid", "unregistered", "open"):
        chosen = F.when(case == name, BASIS[name]).otherwise(chosen)
    return chosen


def _text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def parse_selected_columns(c: Column) -> Column:
    """The text items of a JSON array; anything else gives an empty array."""
    items = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    texts = F.transform(F.filter(items, _text), lambda v: F.try_variant_get(v, "$", "string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def parse_cohort_filter(c: Column) -> Column:
    """Struct ``column, op, value`` of a JSON object; missing when column or op is not text."""
    parsed = F.try_parse_json(c)
    column, op = (F.try_variant_get(parsed, f"$.{k}", "variant") for k in ("column", "op"))
    value = F.coalesce(F.try_variant_get(parsed, "$.value", "string"), F.lit(""))
    return F.when(
        _text(column) & _text(op),
        F.struct(
            F.try_variant_get(column, "$", "string").alias("column"),
            F.try_variant_get(op, "$", "string").alias("op"),
            value.alias("value"),
        ),
    )


def request_json(columns: Column, column: Column, op: Column, value: Column) -> dict[str, Column]:
    """The stored form of a request definition: a JSON array and, when there is a filter, an object."""
    filtered = F.to_json(F.struct(column.alias("column"), op.alias("op"), value.alias("value")))
    return {
        "selected_columns": F.to_json(F.coalesce(columns, F.array().cast("array<string>"))),
        "cohort_filter": F.when(column.isNotNull() & op.isNotNull(), filtered),
    }


def artifact_name(request_id: Column) -> Column:
    return F.concat(F.lit("req_"), F.regexp_replace(request_id, "[^a-zA-Z0-9]", "_"))


def clean_location(location: Column) -> Column:
    """Trimmed, without slashes at the end; missing when nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(location, r"^\s+|\s+$", ""), "/+$", ""), F.lit(""))


def egress_path(details: Column) -> Column:
    return F.coalesce(F.get_json_object(details, "$.egress_path"), F.lit("—"))


def map_first(m: Column, *keys: str) -> Column:
    """The value of the first key that has one, empty text when none has."""
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys], F.lit(""))


def download_gate(
    status: Column, output: Column, submitter: Column, expires: Column, user: Column, decision: Column, enabled: Column, now: Column
) -> Column:
    """The first reason to refuse a download, ``allowed`` when there is none."""
    return (
        F.when(~F.coalesce((status == "approved") & (output != ""), F.lit(False)), "not_found")
        .when(~submitter.eqNullSafe(user), "not_your_request")
        .when(expires < now, "export_expired")
        .when(~decision.eqNullSafe(F.lit(GRANTED)), "access_revoked")
        .when(enabled.eqNullSafe(F.lit(False)), "downloads_disabled")
        .otherwise("allowed")
    )
