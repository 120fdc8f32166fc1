"""Checks on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from medweave.operators.skew import skew_join


def check_row_count(df: DataFrame, min_rows: int, name: str = "table") -> None:
    """Raise when there are fewer than ``min_rows`` rows; counts no further than needed."""
    seen = df.limit(min_rows).count()
    if seen < min_rows:
        raise ValueError(f"{name}: expected at least {min_rows} rows, got {seen}")


def check_schema(df: DataFrame, schema: StructType, key: list[str] | None = None) -> DataFrame:
    """Violations per declared column: missing, values that cannot be cast, NULL in a key column.

    Columns that are not declared are allowed.
    """
    present = set(df.columns)
    facts = []
    for f in schema:
        if f.name in present:
            c = F.col(f"`{f.name}`")
            facts.append(F.sum((c.isNotNull() & c.try_cast(f.dataType).isNull()).cast("long")).alias(f"bad_{f.name}"))
            facts.append(F.sum((F.lit(f.name in (key or [])) & c.isNull()).cast("long")).alias(f"null_{f.name}"))
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *facts)
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.name not in present).alias("missing"),
            (F.coalesce(F.col(f"bad_{f.name}"), F.lit(0)) if f.name in present else F.lit(0)).cast("long").alias("not_castable"),
            (F.coalesce(F.col(f"null_{f.name}"), F.lit(0)) if f.name in present else F.lit(0)).cast("long").alias("null_in_key"),
        )
        for f in schema
    ]
    found = counted.select(F.explode(F.array(*rows)).alias("_v")).select("_v.*")
    return found.where(F.col("missing") | (F.col("not_castable") > 0) | (F.col("null_in_key") > 0))


def check_pk(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that are repeated or have a NULL part, with the number of rows."""
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") > 1) | any_null)


def check_not_null(df: DataFrame, schema: StructType) -> DataFrame:
    """Number of NULLs per NOT NULL column that has any, found in one pass."""
    required = [f.name for f in schema if not f.nullable]
    counted = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in required])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in required])
    return counted.select(F.explode(pairs).alias("_v")).select("_v.*").where(F.col("nulls") > 0)


def fk_orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child key values (none of them NULL) that the parent lacks, with the number of rows.

    ``keys`` maps child columns to parent columns. The child is counted per key before the join, so
    a key shared by many rows costs nothing extra.
    """
    counted = child.select(*keys).na.drop("any").groupBy(*keys).agg(F.count(F.lit(1)).alias("orphans"))
    held = parent.select(*[F.col(p).alias(c) for c, p in keys.items()])
    return counted.join(held, list(keys), "left_anti")


def fk_orphan_rows(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The child rows themselves."""
    return skew_join(child, fk_orphans(child, parent, keys).drop("orphans"), list(keys), "left_semi")


def check_fk(tables: dict[str, DataFrame], child: str, fks: dict[str, tuple[str, str]]) -> DataFrame | None:
    """Orphans of every foreign key of ``child`` whose parent is among ``tables``, in one frame."""
    found = None
    for column, (parent, key) in fks.items():
        if parent not in tables:
            continue
        orphans = fk_orphans(tables[child], tables[parent], {column: key}).select(
            F.lit(child).alias("table"), F.lit(column).alias("column"), F.col(column).cast("string").alias("value"), "orphans"
        )
        found = orphans if found is None else found.unionByName(orphans)
    return found


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """Columns of a table: position, name, type, nullability; from the catalog, no data is read."""
    fields = spark.table(name).schema
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def row_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def status_counts(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """One row: ``total`` and the number of rows with each value."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(col) == v).alias(v) for v in values])
