"""Coverage months to calendar periods."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def coverage_months(*months: Column) -> Column:
    return F.greatest(*months)


def shift_months(d: Column, n: Column | int) -> Column:
    """Same day ``n`` months later (earlier when negative), at most the last day of that month."""
    return F.add_months(d, n)


def coverage_window(year: Column, months: Column) -> Column:
    """Struct ``start, end`` for a year with some months of coverage, counted back from December.

    Missing for no coverage. With fewer than twelve months the end is as many months after the
    first covered month as there are covered months, December at the latest.
    """
    first = F.lit(13) - months
    last = F.when(first > 1, F.least(F.lit(12), first + months)).otherwise(months)
    window = F.struct(
        F.make_date(year, first, F.lit(1)).alias("start"),
        F.last_day(F.make_date(year, last, F.lit(1))).alias("end"),
    )
    return F.when(months.between(1, 12), window)


def payer_plan_periods(first: Column, middle: Column, last: Column, first_year: int = 2008) -> Column:
    """Array of ``start, end`` for the months covered in three successive years.

    A full middle year joins what lies around it: the first year counts back from its end, the last
    year counts on from the end of the middle one. Without it every year stands alone, a full one
    from January to December and a partial one from January for as many months. More than twelve
    months in any year gives no period.
    """

    def day(offset: int, month: int, d: int) -> Column:
        return F.make_date(F.lit(first_year + offset), F.lit(month), F.lit(d))

    def period(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"))

    joined_start = (
        F.when(first == 12, day(0, 1, 1)).when(first == 0, day(1, 1, 1)).otherwise(shift_months(day(0, 12, 31), -first))
    )
    joined_end = F.when(last == 12, day(2, 12, 31)).otherwise(shift_months(day(1, 12, 31), last))
    alone = []
    for offset, months in enumerate((first, middle, last)):
        whole = period(day(offset, 1, 1), day(offset, 12, 31))
        part = period(day(offset, 1, 1), shift_months(day(offset, 1, 1), months))
        alone.append(F.when(months == 12, whole).when(months > 0, part))
    periods = F.when(middle == 12, F.array(period(joined_start, joined_end))).otherwise(F.array_compact(F.array(*alone)))
    none = F.array().cast("array<struct<start:date,end:date>>")
    return F.when(F.greatest(first, middle, last) <= 12, periods).otherwise(none)
