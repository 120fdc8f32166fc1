"""First / latest record per key, as aggregates with map-side combine; Spark sorts for them when records are structs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

Order = Sequence[str | Column]


def _pick(df: DataFrame, keys: list[str], order: Order, chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest]).select(*df.columns)


def first_seen(df: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """The record of each key that comes first by ``order``."""
    return _pick(df, keys, order, F.min_by)


def latest_per_key(df: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """The record of each key that comes last by ``order``."""
    return _pick(df, keys, order, F.max_by)


def latest_year(df: DataFrame, key: str, year: str, order: Order) -> DataFrame:
    """Record of the latest year per key; of several records in that year the first by ``order``."""
    return first_seen(df, [key], [-F.col(year), *order])


def earliest_year(df: DataFrame, key: str, year: str, order: Order) -> DataFrame:
    """Record of the earliest year per key; of several records in that year the first by ``order``."""
    return first_seen(df, [key], [F.col(year), *order])


def distinct_visits(*claims: DataFrame, keys: list[str]) -> DataFrame:
    """One row per visit key over all feeds."""
    first, *rest = [c.select(*keys) for c in claims]
    for other in rest:
        first = first.unionByName(other)
    return first.distinct()


def changed_fields(df: DataFrame, key: str, year: str, order: Order, cols: list[str]) -> DataFrame:
    """Names of ``cols`` that differ from the person's previous year.

    One record per (person, year) is kept first, so a window group has as many rows as there are years.
    """
    yearly = first_seen(df.select(key, year, *{*cols, *[o for o in order if isinstance(o, str)]}), [key, year], order)
    w = Window.partitionBy(key).orderBy(year)
    diffs = [F.when(~F.col(c).eqNullSafe(F.lag(c).over(w)), F.lit(c)) for c in cols]
    return (
        yearly.select(key, year, F.lag(year).over(w).alias("previous_year"), F.array_compact(F.array(*diffs)).alias("changed"))
        .where(F.col("previous_year").isNotNull() & (F.size("changed") > 0))
    )


def visit_by_date(events: DataFrame, visits: DataFrame, keys: list[str], visit_id: str) -> DataFrame:
    """Visit id by (person, date), -1 when there is none; the highest id wins on a shared date."""
    from medweave.operators.skew import skew_join

    by_date = visits.groupBy(*keys).agg(F.max(visit_id).alias(visit_id))
    return skew_join(events, by_date, keys, "left").withColumn(visit_id, F.coalesce(visit_id, F.lit(-1)))
