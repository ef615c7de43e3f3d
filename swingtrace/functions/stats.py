"""Order statistics on array columns, all JVM-side.

The arrays hold one element per day (or per prior week), never one per event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from swingtrace.config import T


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def median_of(values: Column) -> Column:
    """Interpolated median of an array: the mean of the two middles on an even count."""

    def middle(ordered: Column) -> Column:
        n = F.size(ordered)
        upper = F.get(ordered, F.floor(n / 2).cast("int"))
        lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
        return F.when(n > 0, (lower + upper) / F.lit(2.0))

    return bind(F.array_sort(values), middle)


def upper_median_of(values: Column) -> Column:
    """Element floor(n/2) of the sorted array, without interpolation."""
    return bind(F.array_sort(values), lambda xs: F.get(xs, F.floor(F.size(xs) / 2).cast("int")))


def mad_of(values: Column, centre: Column) -> Column:
    """Median absolute deviation scaled to a standard deviation."""
    return median_of(F.transform(values, lambda x: F.abs(x - centre))) * F.lit(T.mad_scale)


def spread_floor(centre: Column) -> Column:
    return F.abs(centre) * F.lit(T.spread_floor)


def carry_forward(points: Column, growth: Column) -> Column:
    """Each prior value grown to today: ``v * (1 + g) ** weeks`` over array<struct<weeks, v>>."""
    return F.transform(
        points, lambda p: p["v"] * F.pow(F.lit(1.0) + growth, p["weeks"].cast("double"))
    )


def safe_pct(delta: Column, base: Column) -> Column:
    """Percent change, NULL where there is nothing to compare with."""
    return delta / F.nullif(base, F.lit(0.0)) * F.lit(100.0)


def pct_or_zero(delta: Column, base: Column) -> Column:
    return F.coalesce(safe_pct(delta, base), F.lit(0.0))


def pairwise_slope_median(points: Column) -> Column:
    """Theil-Sen slope of array<struct<x, y>> sorted by x: median over all i < j.

    One point per calendar day, so the number of slopes grows with the length of the history in
    days, not with the number of events.
    """
    slopes = F.flatten(
        F.transform(
            points,
            lambda a, i: F.transform(
                F.slice(points, i + 2, F.greatest(F.size(points) - i - 1, F.lit(0))),
                lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"]),
            ),
        )
    )
    return F.coalesce(median_of(slopes), F.lit(0.0))


def weekly_growth(points: Column) -> Column:
    """Weekly growth from a log-linear fit; 0 when the history is short or the fit implausible."""
    raw = F.exp(pairwise_slope_median(points) * F.lit(7.0)) - F.lit(1.0)
    plausible = bind(
        raw, lambda g: F.when(F.abs(g) <= F.lit(T.growth_max_abs), g).otherwise(F.lit(0.0))
    )
    return F.when(F.size(points) >= T.growth_min_points, plausible).otherwise(F.lit(0.0))
