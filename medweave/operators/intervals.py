"""Interval merging: eras of events that overlap or lie within a gap of each other.

Dates are days, so grouping by (key, start day) first leaves at most one row per calendar day and
key, however many events a key has. All windows below run over such day-level rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from medweave.session import PIECES_PER_CORE, pieces  # noqa: F401


def condition_end(start: Column, end: Column) -> Column:
    """End of an event, one day after its start when it is missing."""
    return F.coalesce(end, F.date_add(start, 1))


def drug_end(start: Column, end: Column, days_supply: Column) -> Column:
    """End of an exposure: given, else start plus supply (zero days count as missing), else next day."""
    return F.coalesce(end, F.nullif(F.date_add(start, days_supply), start), F.date_add(start, 1))


def dealt(days: DataFrame, keys: list[str]) -> DataFrame:
    """The shuffle that windows or counts over ``keys`` need, in pieces that adaptive execution does not put together again.

    It merges by bytes as shuffled, and day-level rows take some forty times as much memory once they are sorted.
    """
    return days.repartition(pieces(days.sparkSession), *keys)


# --- day-level form: one pass, for intervals with end >= start ------------------------------------


def _islands(days: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Number the runs of rows (``_start``, ``_end``) with no more than ``gap`` days between them."""
    ordered = Window.partitionBy(*keys).orderBy("_start")
    reach = F.max("_end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("_start") <= F.date_add(reach, gap), 0).otherwise(1)
    marked = days.withColumn("_fresh", fresh)
    return marked.withColumn("_island", F.sum("_fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))


def merge_intervals(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    gap: int = 30,
    strict: bool = False,
    count: str | None = None,
    measures: dict[str, str] | None = None,
    unique_starts: bool = False,
) -> DataFrame:
    """Merge intervals per key when the next one starts at most ``gap`` days after the last end.

    Returns ``keys, era_start, era_end, n`` (``n`` sums the column ``count`` when given) and the
    sum of each column in ``measures``. ``strict=True`` follows the start/end event counting to the
    letter, which gives other results than the default only where an interval ends before it starts.
    Rows without a key, a start or an end belong to no era. ``unique_starts`` tells that no two rows
    of a key start on the same day, as is so for eras that are merged once more.
    """
    df = df.na.drop(subset=[*keys, start, end])
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    sums = {name: F.sum(col) for name, col in (measures or {}).items()}
    if strict:
        if measures:
            raise ValueError("strict merging carries no measures")
        return _merge_by_events(df, keys, start, end, gap, F.lit(1) if count is None else F.coalesce(count, F.lit(0)))
    if unique_starts:
        one = F.lit(1) if count is None else F.col(count)
        carried = [F.col(c).alias(name) for name, c in (measures or {}).items()]
        days = df.select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end"), one.alias("_n"), *carried)
    else:
        days = df.groupBy(*keys, F.col(start).alias("_start")).agg(
            F.max(end).alias("_end"), n.alias("_n"), *[c.alias(name) for name, c in sums.items()]
        )
        days = dealt(days, keys)
    return (
        _islands(days, keys, gap)
        .groupBy(*keys, "_island")
        .agg(
            F.min("_start").alias("era_start"),
            F.max("_end").alias("era_end"),
            F.sum("_n").cast("long").alias("n"),
            *[F.sum(name).alias(name) for name in sums],
        )
        .drop("_island")
    )


# --- event form --------------------------------------------------------------------------------------


def era_events(spans: DataFrame, keys: list[str], start: str, end: str, pad_days: int, n: Column | None = None) -> DataFrame:
    """Starts (``kind`` -1) and padded ends (``kind`` 1) with the number of each per day.

    The spans are dealt by key and day before they are counted, since there are nearly as many such days as spans: nothing is
    held while the input is read, and a task counts one piece.
    """
    n = F.count(F.lit(1)) if n is None else n

    def counted(day: Column, kind: int) -> DataFrame:
        by = [*keys, "_day"]
        return dealt(spans.withColumn("_day", day), by).groupBy(*by).agg(n.alias("n")).select(
            *keys, F.col("_day").alias("day"), "n", F.lit(kind).alias("kind")
        )

    return counted(F.col(start), -1).unionByName(counted(F.date_add(F.col(end), pad_days), 1))


def start_ordinal(df: DataFrame, keys: list[str], order: list[str], name: str = "start_ordinal") -> DataFrame:
    """Position of each row within its key; ``order`` must be unique per key to be repeatable.

    Meant for day-level rows, of which a key has no more than there are days; many of them are best :func:`dealt` before.
    """
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def running_max(df: DataFrame, keys: list[str], order: list[str], col: str, name: str) -> DataFrame:
    """Largest value of ``col`` up to and including the row: carries the last start onto end events."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.max(col).over(w))


def event_ordinal(events: DataFrame, keys: list[str], name: str = "overall_ord") -> DataFrame:
    """Events counted so far in (day, kind) order, starts before ends on the same day."""
    w = Window.partitionBy(*keys).orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(name, F.sum("n").over(w))


def closing_days(events: DataFrame, keys: list[str], pad_days: int) -> DataFrame:
    """Days on which as many intervals have ended as have started, with the padding taken off again.

    A row stands for ``n`` events of one day and kind; the balance passes every value between the
    one before and the one after, so zero is hit when it lies in that range.
    """
    upto = Window.partitionBy(*keys).orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(F.when(F.col("kind") == -1, F.col("n")).otherwise(0)).over(upto)
    after = F.sum(-F.col("kind") * F.col("n")).over(upto)
    counted = events.withColumn("_opened", opened).withColumn("_after", after)
    closes = (F.col("kind") == 1) & (F.col("_after") <= 0) & (F.col("_after") + F.col("n") >= 1)
    reopens = (F.col("kind") == -1) & (F.col("_after") >= 0) & (F.col("_after") - F.col("n") <= -1)
    return (
        counted.where((F.col("_opened") > 0) & (closes | reopens))
        .select(*keys, F.date_sub("day", pad_days).alias("end_day"))
        .distinct()
    )


def nearest_end(spans: DataFrame, ends: DataFrame, keys: list[str], start: str, end: str = "end_day") -> DataFrame:
    """For each row of ``spans`` the first end on or after its start; rows without one are dropped.

    Written as one sorted pass over both sides instead of a range join, from the last day to the first, so that
    the frame only grows. ``spans`` should hold one row per key and day.
    """
    kept = [c for c in spans.columns if c not in keys]
    left = spans.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.struct(*kept).alias("_row"), F.lit(None).cast("date").alias("_e"))
    right = ends.select(*keys, F.col(end).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(end).alias("_e"))
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_next", F.min("_e").over(ahead))
    return found.where((F.col("_side") == 0) & F.col("_next").isNotNull()).select(
        *keys, *[F.col("_row").getField(c).alias(c) for c in kept], F.col("_next").alias("era_end")
    )


def _merge_by_events(df: DataFrame, keys: list[str], start: str, end: str, gap: int, weight: Column) -> DataFrame:
    """Eras from the days on which the number of open intervals passes zero, in one read, one shuffle and one sort.

    Each row gives two events, its start and its padded end, counted per key and day before the shuffle. The days of a key
    are then gone through once, from the last to the first: what is open before a day is the key's total less
    what begins and ends from that day on, and the first close that a start can reach is the latest one seen.
    """
    none, one = F.lit(0).cast("long"), weight.cast("long")
    event = lambda day, opens, closes: F.struct(day.alias("day"), opens.alias("opens"), closes.alias("closes"))
    both = F.array(event(F.col(start), one, none), event(F.date_add(F.col(end), gap), none, one))
    events = df.select(*keys, F.explode(both).alias("v"))
    days = events.groupBy(*keys, F.col("v.day").alias("day")).agg(F.sum("v.opens").alias("opens"), F.sum("v.closes").alias("closes"))

    days = days.withColumn("_back", -F.unix_date("day"))
    net, back = F.col("opens") - F.col("closes"), Window.partitionBy(*keys).orderBy("_back")
    everything = back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.sum(net).over(everything) - F.sum(net).over(back.rowsBetween(Window.unboundedPreceding, 0))
    passes = ((F.col("_before") < 0) & (F.col("_before") + F.col("opens") >= 0)) | (
        (F.col("_before") + F.col("opens") > 0) & (F.col("_before") + net <= 0)
    )
    closing = days.withColumn("_before", before).withColumn("_close", F.when(passes, F.date_sub("day", gap)))
    # A start reaches closes that lie on its day or after it, so days at least ``gap`` further on.
    reached = closing.withColumn("era_end", F.min("_close").over(back.rangeBetween(Window.unboundedPreceding, -gap)))
    return (
        reached.where((F.col("opens") > 0) & F.col("era_end").isNotNull())
        .groupBy(*keys, "era_end").agg(F.min("day").alias("era_start"), F.sum("opens").alias("n"))
        .select(*keys, "era_start", "era_end", "n")
    )


def reversed_intervals(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose end lies before their start: the check to make before the default merge."""
    return df.where(F.col(end) < F.col(start))
