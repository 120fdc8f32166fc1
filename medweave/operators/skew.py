"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Rows per piece of a key that is split by hand.
HOT_ROWS = 1_000_000
LEFT_SIDED = ("inner", "left", "left_semi", "left_anti")


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi join on equally named columns whose strategy is settled while it runs, from measured sizes.

    ``right`` is broadcast when its bytes, as shuffled, stay under Spark's threshold. Beyond it, both sides are sorted
    and merged, and a partition that one key has made too large is read in pieces of its map outputs, each with
    the same partition of ``right``: equal rows and NULL keys are parted like all others, and ``left`` is computed once.
    ``session.get_session`` makes adaptive execution do so also where another shuffle must follow.
    """
    if how not in LEFT_SIDED:
        raise ValueError(f"how must be one of {LEFT_SIDED}, got {how!r}")
    if how in ("left_semi", "left_anti"):
        right = right.select(*on).distinct()  # each key once, however many rows it has
    return left.join(right, on, how)


def skew_anti_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks."""
    return skew_join(left, right, on, "left_anti")


# --- by hand -------------------------------------------------------------------------------------------------


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of pieces each is split into.

    Holds at most ``rows / hot_rows`` rows, whatever the data looks like. NULL is a key as well:
    an outer join sends all rows with a NULL key to one task otherwise.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    pieces = F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int")
    return counted.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], pieces.alias("_pieces"))


def _with_pieces(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    same = reduce(Column.__and__, [df[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys])
    marked = df.join(F.broadcast(hot), same, "left").drop(*[f"_hot_{k}" for k in keys])
    return marked.withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))


def _without_maps(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    salt_by: list[str] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """The same split by a salt instead of by Spark: for sessions without adaptive execution.

    Rows of ``left`` with a hot key get a salt from a hash of ``salt_by`` (all columns without maps
    by default; give the columns that identify a row: equal rows get one salt), which is the same
    when a task is run again. Rows of ``right`` are repeated once per piece, for hot keys only; semi
    and anti joins need each key of it once.
    """
    if how not in LEFT_SIDED:
        raise ValueError(f"how must be one of {LEFT_SIDED}, got {how!r}")
    if how in ("left_semi", "left_anti"):
        right = right.select(*on).distinct()
    hot = hot_keys(left, on, hot_rows)
    salt = F.pmod(F.xxhash64(*(salt_by or _without_maps(left) or [F.lit(0)])), F.col("_pieces").cast("long")).cast("int")
    salted = _with_pieces(left, hot, on).withColumn("_salt", salt).drop("_pieces")
    repeated = (
        _with_pieces(right, hot, on)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
        .drop("_pieces")
    )
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
