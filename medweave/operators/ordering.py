"""Sorting, searching and paging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from medweave.operators.ids import ROW_BITS
from medweave.session import settle

LIST_PAGE, PREVIEW_PAGE = 5, 20

Order = Sequence[str | Column]


def sort_feed(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows in order of ``keys``, ties by the whole row; all columns by default."""
    rest = [c for c in df.columns if c not in (keys or [])]
    return df.orderBy(*(keys or []), *rest)


def claims_in_date_order(df: DataFrame, person: str, date: str, position: str) -> DataFrame:
    return df.orderBy(person, date, position)


def newest_first(df: DataFrame, col: str, ties: Sequence[str] = ()) -> DataFrame:
    """Descending by ``col``; ``ties`` spread rows that share one value over several partitions."""
    return df.orderBy(F.desc(col), *ties)


def order_by(df: DataFrame, cols: Order) -> DataFrame:
    return df.orderBy(*cols)


def top_n(df: DataFrame, order: Order, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def row_cap(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


class Pages:
    """The rows of a frame in ``order``, to be read page by page.

    The rows are range-partitioned and sorted once, ties by the other columns, and written with a folder per range. The number of
    rows per range, one entry per task, tells which ranges a page lies in; only their folders are read. Every page, near or far
    in, has the same plan, and tied rows never change pages.
    """

    def __init__(self, df: DataFrame, order: Order) -> None:
        self.columns = df.columns
        given = {o for o in order if isinstance(o, str)}
        whole = [*order, *[f.name for f in df.schema if f.name not in given and "map<" not in f.dataType.simpleString()]]
        placed = df.repartitionByRange(*whole).sortWithinPartitions(*whole)
        self.rows = settle(placed.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))}), "_range")
        self.sizes = {r["_range"]: r["n"] for r in self.rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()}

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number``, from 1; lower numbers are the first page, beyond the last there are no rows."""
        first, before, inside = (max(1, number) - 1) * size, 0, F.lit(False)
        for part, n in self.sizes.items():
            low, high = max(first - before, 0), min(first + size - before, n) - 1
            if low <= high:
                inside = inside | ((F.col("_range") == part) & F.col("_place").between(low, high))
            before += n
        return self.rows.where(inside).orderBy("_range", "_place").select(*self.columns)


def page(df: DataFrame, order: Order, number: int, size: int = LIST_PAGE) -> DataFrame:
    """Page ``number`` (from 1) of the rows in ``order``; keep a :class:`Pages` to read several."""
    return Pages(df, order).page(number, size)


def search(df: DataFrame, text: str, cols: list[str]) -> DataFrame:
    """Rows with ``text`` in any of ``cols``, whatever the case; blank text keeps everything."""
    wanted = text.strip().lower()
    if not wanted:
        return df
    return df.where(reduce(Column.__or__, [F.contains(F.lower(c), F.lit(wanted)) for c in cols]))


def facet(df: DataFrame, col: str, value: str) -> DataFrame:
    return df if value == "all" else df.where(F.col(col) == value)
