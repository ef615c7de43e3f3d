"""What is normal for a day: the same weekday in the weeks before it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swingtrace.config import T
from swingtrace.functions import stats
from swingtrace.functions.metrics import QueryError

Day = str | dt.date


def as_date(day: Day) -> dt.date:
    if isinstance(day, dt.date):
        return day
    try:
        return dt.date.fromisoformat(day)
    except ValueError:
        raise QueryError(f"not an ISO date: {day!r}") from None


def days_between(start: Day, end: Day) -> list[dt.date]:
    first, last = as_date(start), as_date(end)
    return [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]


def bounds(rows: DataFrame) -> DataFrame:
    """First and last event date."""
    return rows.agg(F.min("event_date").alias("start"), F.max("event_date").alias("end"))


def bounds_of(rows: DataFrame) -> tuple[dt.date, dt.date]:
    row = bounds(rows).first()
    if row["start"] is None:
        raise QueryError("there are no events")
    return row["start"], row["end"]


def check_window(
    start: Day, end: Day | None, data: tuple[dt.date, dt.date], max_days: int | None = None
) -> tuple[dt.date, dt.date]:
    """ISO dates, in order, inside the data, not too long."""
    first = as_date(start)
    last = as_date(end) if end is not None else first
    if last < first:
        raise QueryError(f"window ends before it starts: {first}..{last}")
    if first < data[0] or last > data[1]:
        raise QueryError(f"window {first}..{last} is outside the data {data[0]}..{data[1]}")
    if max_days is not None and (last - first).days + 1 > max_days:
        raise QueryError(f"window {first}..{last} is longer than {max_days} days")
    return first, last


def baseline_days(start: Day, end: Day, data_start: Day) -> list[dt.date]:
    """Same weekdays 1-4 weeks back, inside the data, never a day of the window itself.

    Calendar arithmetic only; its result is a literal list, so it prunes day partitions.
    """
    window, floor = days_between(start, end), as_date(data_start)
    back = {
        d - dt.timedelta(weeks=k) for d in window for k in range(1, T.baseline_weeks + 1)
    }
    return sorted(d for d in back - set(window) if d >= floor)


def history_start(start: Day) -> dt.date:
    """The first day that any prior same weekday of ``start`` or a later day lies on."""
    return as_date(start) - dt.timedelta(weeks=T.baseline_weeks)


def baseline_dates(rows: DataFrame, start: Day, end: Day) -> DataFrame:
    """The same days as a DataFrame ``(d)``, derived from the data's own bounds."""
    window = (F.lit(as_date(start)), F.lit(as_date(end)))
    weeks = F.sequence(F.lit(1), F.lit(T.baseline_weeks))
    days = (
        bounds(rows)
        .withColumn("day", F.explode(F.sequence(*window)))
        .withColumn("k", F.explode(weeks))
        .withColumn("d", F.date_sub("day", F.col("k") * 7))
    )
    kept = (F.col("d") >= F.col("start")) & ~F.col("d").between(*window)
    return days.filter(kept).select("d").distinct()


def in_days(days: Sequence[dt.date], column: str = "event_date") -> Column:
    return F.col(column).isin(*days) if days else F.lit(False)


def in_window(start: Day, end: Day, column: str = "event_date") -> Column:
    return F.col(column).between(F.lit(as_date(start)), F.lit(as_date(end)))


def trend_baseline(points: Column, growth: Column) -> Column:
    """struct<centre, spread, floored> of array<struct<weeks, v>>.

    Each value is first carried forward by the growth; ``floored`` says that the observed spread was
    below the floor, which makes sigma a restatement of the size of the move.
    """

    def describe(carried: Column, centre: Column) -> Column:
        floor = stats.spread_floor(centre)
        return stats.bind(
            stats.mad_of(carried, centre),
            lambda observed: F.struct(
                centre.alias("centre"),
                F.greatest(observed, floor).alias("spread"),
                (observed < floor).alias("floored"),
            ),
        )

    return stats.bind(
        stats.carry_forward(points, growth),
        lambda carried: stats.bind(
            stats.median_of(carried), lambda centre: describe(carried, centre)
        ),
    )


def prior_weeks(series: DataFrame, keys: Sequence[str], day: str = "d", value: str = "v"):
    """Adds ``points``: each day's own same-weekday values 1-4 weeks back.

    A range frame over day numbers replaces four lag self-joins: one shuffle by key, and the frame
    never holds more than three weeks of one segment.
    """
    number = F.unix_date(day)
    span = (
        Window.partitionBy(*keys)
        .orderBy(number)
        .rangeBetween(-7 * T.baseline_weeks, -7)
    )
    seen = F.collect_list(F.struct(number.alias("n"), F.col(value).alias("v"))).over(span)
    weekly = F.filter("seen", lambda p: (F.unix_date(day) - p["n"]) % 7 == 0)
    points = F.transform(
        weekly,
        lambda p: F.struct(
            ((F.unix_date(day) - p["n"]) / 7).cast("int").alias("weeks"), p["v"].alias("v")
        ),
    )
    return series.withColumn("seen", seen).withColumn("points", points).drop("seen")
