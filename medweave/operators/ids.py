"""Dense surrogate ids, id counters and dimension state."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from medweave.operators.skew import skew_anti_join, skew_join
from medweave.session import pieces, settle

ROW_BITS = (1 << 33) - 1


def assign_ids(
    df: DataFrame,
    id_col: str,
    order: Sequence[str | Column] | None = None,
    base: int = 1,
    partitions: int | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Number the rows ``base, base + 1, ...`` in ``order``, without a one-task window.

    Rows are range-partitioned by the whole order (which must identify a row, so that no value
    piles up in one range), sorted inside each range and written once with their place in it.
    Only the row counts per partition are summed up afterwards. With ``order=None`` the rows keep
    the partitions they have: dense ids without a shuffle. Only the columns in ``keep`` (by default all) are written.
    """
    placed, kept = df, list(df.columns if keep is None else keep)
    if order:
        placed = placed.repartitionByRange(partitions, *order) if partitions else placed.repartitionByRange(*order)
        placed = placed.sortWithinPartitions(*order)
    placed = settle(
        placed.withColumn("_part", F.spark_partition_id()).withColumn(
            "_place", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
        ).select(*kept, "_part", "_place"),
        compression="zstd",
    )
    # one row per partition, so a list as short as the number of tasks
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).orderBy("_part").collect()
    starts = accumulate((r["_size"] for r in sizes), initial=base)
    offsets = df.sparkSession.createDataFrame([(r["_part"], n) for r, n in zip(sizes, starts)], "_part int, _offset long")
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(id_col, F.col("_offset") + F.col("_place")).select(id_col, *kept)


def assign_ids_by(
    df: DataFrame, group: str, id_col: str, order: Sequence[str | Column], bases: dict[str, int], keep: Sequence[str] | None = None
) -> DataFrame:
    """Number the rows of every ``group`` on their own in ``order``, from the group's base on, all from one sorted copy.

    The rows are range-partitioned once by the order all groups share and sorted by group and order inside each range.
    A row's place in its range, less the first place of its group there, plus the group's rows in the ranges before is its
    number: a matrix of counts per (range, group) summed along the ranges, as small as tasks times groups. Each group
    becomes a folder of the copy. Rows of groups without a base are left out. The ranges are as many as given here:
    adaptive execution would merge them by compressed bytes, and the sort of such a range spills. The copy holds the group
    and the columns in ``keep`` (by default all): what only the order needs is not written.
    """
    spark, kept = df.sparkSession, [c for c in df.columns if keep is None or c == group or c in keep]
    placed = df.where(F.col(group).isin(*bases)).repartitionByRange(pieces(spark), *order).sortWithinPartitions(group, *order)
    placed = settle(
        placed.withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)))
        .select(*kept, "_part", "_place"),
        group, "zstd",
    )
    sizes = placed.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first")).orderBy("_part").collect()
    following, offsets = dict(bases), []
    for r in sizes:
        offsets.append((r["_part"], r[group], following[r[group]] - r["_first"]))
        following[r[group]] += r["_size"]
    # one row per task and group
    matrix = spark.createDataFrame(offsets, f"_part int, {group} string, _offset long")
    numbered = placed.join(F.broadcast(matrix), ["_part", group])
    return numbered.withColumn(id_col, F.col("_offset") + F.col("_place")).select(id_col, *kept)


def new_keys(fact: DataFrame, dim: DataFrame, natural_key: list[str]) -> DataFrame:
    """Natural keys of ``fact`` that ``dim`` does not hold yet."""
    wanted = fact.select(*natural_key).na.drop("any").distinct()
    return wanted.join(dim.select(*natural_key), natural_key, "left_anti")


def lookup_dim(fact: DataFrame, dim: DataFrame, natural_key: list[str], id_col: str) -> DataFrame:
    """Add the surrogate id of ``dim`` to ``fact``; NULL where the key is blank or unknown."""
    return skew_join(fact, dim.select(*natural_key, id_col), natural_key, "left")


def upsert_dim(
    dim: DataFrame | None,
    keys: DataFrame,
    natural_key: list[str],
    id_col: str,
    order: Sequence[str | Column],
    base: int = 1,
) -> DataFrame:
    """``dim`` plus one row per new key of ``keys`` (one row per key), numbered in ``order`` from ``base``.

    The column ``is_new`` tells which rows have still to be written to the output.
    """
    if dim is None:
        return assign_ids(keys, id_col, order, base).withColumn("is_new", F.lit(True))
    fresh = skew_anti_join(keys, dim, natural_key)
    numbered = assign_ids(fresh, id_col, order, base).withColumn("is_new", F.lit(True))
    return dim.withColumn("is_new", F.lit(False)).unionByName(numbered, allowMissingColumns=True)


# Counters that carry over from one sample to the next, with the value each starts at.
COUNTERS = (
    "condition_occurrence", "device_cost", "device_exposure", "drug_cost", "drug_exposure",
    "location", "measurement", "observation", "observation_period", "payer_plan_period",
    "person", "procedure_cost", "procedure_occurrence", "specimen", "visit_cost",
    "visit_occurrence", "care_site", "provider",
)
FIRST_ID = 1


def load_state(spark: SparkSession, path: str | None) -> dict[str, int]:
    """Next id per counter; every counter starts at 1 when nothing was saved."""
    state = dict.fromkeys(COUNTERS, FIRST_ID)
    if path:
        rows = spark.read.parquet(path).where(F.col("counter").isin(*COUNTERS)).limit(len(COUNTERS)).collect()
        state.update({r["counter"]: r["next_id"] for r in rows})
    return state


def save_state(spark: SparkSession, state: dict[str, int], path: str) -> None:
    rows = [(name, int(state[name])) for name in COUNTERS]
    spark.createDataFrame(rows, "counter string, next_id long").coalesce(1).write.mode("overwrite").parquet(path)


def next_id(df: DataFrame, id_col: str, base: int) -> int:
    """The id after the highest one in ``df``; ``base`` when it is empty."""
    top = df.agg(F.max(id_col)).first()[0]
    return base if top is None else int(top) + 1
