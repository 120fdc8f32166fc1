"""Cleaning, joining and combining whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from medweave.operators.skew import skew_anti_join, skew_join

# Text that stands for a missing value.
NULL_PLACEHOLDERS = ["Not Reported", "Unknown", "not reported", "unknown", "N/A", "NA", "--", "Not Applicable"]


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def null_placeholders(df: DataFrame, values: list[str] = NULL_PLACEHOLDERS) -> DataFrame:
    """NULL for exactly these texts, in every text column."""
    texts = {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(values), F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def join_tables(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "left", nulls_equal: bool = False) -> DataFrame:
    """Join on equal keys; other shared columns come from ``left``; repeated rows go.

    ``how`` is inner, left, right or outer. A NULL in a key matches nothing, unless ``nulls_equal`` says that it matches
    NULL; then as many rows come out as both sides' NULL rows make pairs.

    Rows that occur again on their own side go before the join: pairs are made of different rows only, so that what is joined
    grows with what comes out, not with the product of the copies on either side.

    Spark cannot part a hot key of a right or full outer join, where a row must be seen to match in no piece. So these are
    put together from joins it can part: the matches, or the left join, and once the rows of ``right`` whose key
    ``left`` does not hold.
    """
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"how must be inner, left, right or outer, got {how!r}")
    keys = [on] if isinstance(on, str) else list(on)
    extra = [c for c in right.columns if c not in left.columns]
    # structs are equal when their fields are, NULL fields too, which makes this an equi join on nullable keys
    key = F.struct(*[F.col(k) for k in keys])
    if not nulls_equal:
        key = F.when(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]), key)
    l, r = left.withColumn("_k", key).dropDuplicates(), right.select(key.alias("_k"), *keys, *extra).dropDuplicates()
    joined = skew_join(l, r.drop(*keys), ["_k"], "left" if how in ("left", "outer") else "inner").select(*left.columns, *extra)
    if how in ("right", "outer"):
        joined = joined.unionByName(skew_anti_join(r, l, ["_k"]).select(*keys, *extra), allowMissingColumns=True)
    # Different rows make different pairs; only unmatched rows of both sides with NULL keys can read alike.
    return joined.dropDuplicates() if how == "outer" else joined


def union_parts(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def merge_insert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` plus the rows of ``source`` whose key it does not hold."""
    return target.unionByName(skew_anti_join(source, target, keys))


def role_difference(analysts: DataFrame, stewards: DataFrame, key: str = "user_id") -> DataFrame:
    """Analysts that are not stewards."""
    return analysts.select(key).distinct().join(stewards.select(key), key, "left_anti")


def clashes(new: DataFrame, existing: DataFrame, key: str = "name") -> DataFrame:
    """Names in both listings."""
    return new.select(key).distinct().join(existing.select(key), key, "left_semi")


def table_for_file(files: DataFrame, tables: DataFrame) -> DataFrame:
    """The table with the same name as each file, whatever the case; none: NULL."""
    named = tables.select(F.col("table"), F.lower("table").alias("_t"))
    return files.join(named, F.lower(files["name"]) == named["_t"], "left").drop("_t")
