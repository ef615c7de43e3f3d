"""The eight metrics, as expressions over five additive measures.

A metric is always sum over sum within its group, never an average of per-row or per-day ratios, so
one definition serves the event table and the rollups alike: only the meaning of the five measures
changes between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from swingtrace.config import (
    DIMENSIONS,
    FILLED_ONLY_DIMENSIONS,
    MEASURES,
    SURROGATE_DIMENSIONS,
    dimensions_for,
)


class QueryError(ValueError):
    """A question that cannot be answered as asked."""


@dataclass(frozen=True)
class Metric:
    name: str
    numerator: str
    denominator: str | None = None
    scale: float = 1.0
    unit: str = "ratio"
    min_numerator: int | None = None
    min_denominator: int | None = None

    @property
    def is_ratio(self) -> bool:
        return self.denominator is not None

    @property
    def has_points(self) -> bool:
        """Whether a move is stated in percentage points (ratios that are not scaled)."""
        return self.is_ratio and self.scale == 1.0

    def num(self) -> Column:
        return F.col(self.numerator).cast("double")

    def den(self) -> Column:
        return F.col(self.denominator).cast("double") if self.denominator else F.lit(1.0)

    def value(self) -> Column:
        """The metric over already summed measure columns; NULL on a zero denominator."""
        return ratio(self, self.num(), self.den())

    def floors(self, requests: int, events: str = "events") -> Column:
        """Row-keeping condition: enough traffic and enough of what the metric counts."""
        ok = (F.col(events) >= requests) & self.value().isNotNull()
        if self.min_numerator:
            ok = ok & (self.num() >= self.min_numerator)
        if self.min_denominator:
            ok = ok & (self.den() >= self.min_denominator)
        return ok


# Metric formulas, scales and the floors below which a ratio is not trusted.
METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("revenue", "revenue", unit="usd"),
        Metric("requests", "events", unit="count"),
        Metric("impressions", "impressions", unit="count"),
        Metric("fill_rate", "fills", "events", min_numerator=50),
        Metric("render_rate", "impressions", "fills", min_numerator=50),
        Metric("ctr", "clicks", "impressions", min_numerator=30),
        Metric("ecpm", "revenue", "impressions", 1000.0, "usd", min_denominator=500),
        Metric("rpr", "revenue", "events", unit="usd", min_denominator=500),
    )
}


def ratio(metric: Metric, num: Column, den: Column) -> Column:
    if not metric.is_ratio:
        return num
    value = num / F.nullif(den, F.lit(0.0))
    return value if metric.scale == 1.0 else value * F.lit(metric.scale)


def event_measures() -> list[Column]:
    """The five sums over event rows."""
    return [
        F.count(F.lit(1)).alias("events"),
        F.sum("is_filled").cast("bigint").alias("fills"),
        F.sum("is_impression").cast("bigint").alias("impressions"),
        F.sum("is_click").cast("bigint").alias("clicks"),
        F.sum("revenue").alias("revenue"),
    ]


def rollup_measures() -> list[Column]:
    """The five sums over rollup rows."""
    return [F.sum(m).alias(m) for m in MEASURES]


def resolve_metric(name: str) -> Metric:
    try:
        return METRICS[name]
    except KeyError:
        raise QueryError(f"unknown metric {name!r}; known: {', '.join(METRICS)}") from None


def check_dimension(metric: str, dimension: str) -> str:
    """Refuse a cut that would divide a filled-only count by all requests, or that is no entity."""
    if dimension in dimensions_for(metric):
        return dimension
    if dimension in FILLED_ONLY_DIMENSIONS:
        raise QueryError(
            f"{dimension!r} is empty on unfilled requests, so {metric!r} cannot be cut by it"
        )
    if dimension in SURROGATE_DIMENSIONS:
        raise QueryError(f"{dimension!r} is a join key; use region, country, device or OS instead")
    raise QueryError(
        f"unknown dimension {dimension!r}; known: {', '.join(DIMENSIONS + FILLED_ONLY_DIMENSIONS)}"
    )
