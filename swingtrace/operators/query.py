"""Typed metric questions: level, comparison, ranking, values, series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swingtrace.config import T
from swingtrace.functions import stats
from swingtrace.functions.masks import scope
from swingtrace.functions.metrics import (
    METRICS,
    Metric,
    QueryError,
    check_dimension,
    ratio,
    resolve_metric,
)
from swingtrace.operators.baseline import (
    Day,
    baseline_days,
    days_between,
    in_days,
    in_window,
)
from swingtrace.operators.source import EventSource

GRAINS = {"total": (), "day": ("event_date",), "hour": ("event_hour",)}


def row_limit(limit: int | None) -> int:
    if limit is None:
        return T.default_rows
    if limit < 1:
        raise QueryError("limit must be positive")
    return int(limit)


def check_group_by(metric: str, dims: Sequence[str]) -> list[str]:
    if len(dims) > T.max_group_by:
        raise QueryError(f"group by at most {T.max_group_by} dimensions; filter instead")
    return [check_dimension(metric, d) for d in dims]


def with_share(rows: DataFrame, column: str = "requests") -> DataFrame:
    """Adds ``share_pct``. The total is a scalar subquery, so no task sees every group."""
    total = rows.agg(F.sum(column)).scalar()
    return rows.withColumn(
        "share_pct", F.col(column) * F.lit(100.0) / F.nullif(total, F.lit(0))
    )


def reliability(metric: Metric, num: str = "numerator", den: str = "denominator"):
    """``reliable`` and ``note``: rows under a floor are kept and flagged."""
    if metric.min_numerator:
        low, floor, what = F.col(num) < metric.min_numerator, metric.min_numerator, "numerator"
    elif metric.min_denominator:
        low, floor, what = F.col(den) < metric.min_denominator, metric.min_denominator, "denominator"
    else:
        return {"reliable": F.lit(True), "note": F.lit("")}
    note = f"under {floor} in the {what}: too few to trust"
    return {
        "reliable": ~F.coalesce(low, F.lit(True)),
        "note": F.when(F.coalesce(low, F.lit(True)), note).otherwise(""),
    }


def _level(metric: Metric) -> list[Column]:
    return [
        metric.value().alias("value"),
        F.col("events").alias("requests"),
        metric.num().alias("numerator"),
        metric.den().alias("denominator"),
    ]


def measure(
    source: EventSource,
    metric: str,
    start: Day,
    end: Day | None = None,
    filters: Mapping[str, object] | None = None,
    group_by: Sequence[str] = (),
    granularity: str = "total",
    limit: int | None = None,
) -> DataFrame:
    """A metric's level, optionally by dimension and by day or hour.

    Returns up to ``limit + 1`` rows; the extra row tells the caller that the answer was cut.
    """
    m = resolve_metric(metric)
    if granularity not in GRAINS:
        raise QueryError(f"granularity must be one of {', '.join(GRAINS)}")
    mask, dims = scope(filters, metric), check_group_by(metric, group_by)
    by = [*GRAINS[granularity], *dims]
    where = in_window(start, end if end is not None else start)
    grouped = source.grouped(by, dims, mask, where)
    out = with_share(grouped.select(*by, *_level(m))).withColumns(reliability(m))
    if not by:
        return out
    order = [F.asc(c) for c in by] if GRAINS[granularity] else [F.desc("requests"), *by]
    return out.orderBy(*order).limit(row_limit(limit) + 1)


def compare(
    source: EventSource,
    metric: str,
    start: Day,
    end: Day | None = None,
    baseline: tuple[Day, Day] | None = None,
    filters: Mapping[str, object] | None = None,
    group_by: Sequence[str] = (),
    limit: int | None = None,
    data_start: Day = "0001-01-01",
) -> DataFrame:
    """A window against its same-weekday baseline (or an explicit one).

    Per day first, then the exact median day of numerator and denominator on each side, then the
    ratio of those medians. Ordered by how much traffic moved how far.
    """
    m = resolve_metric(metric)
    mask, dims = scope(filters, metric), check_group_by(metric, group_by)
    end = end if end is not None else start
    days = days_between(*baseline) if baseline else baseline_days(start, end, data_start)
    if not days:
        raise QueryError(f"no baseline days for {start}..{end}")
    is_cur, is_base = in_window(start, end), in_days(days)
    daily = source.grouped([*dims, "event_date"], dims, mask, is_cur | is_base)

    def middle(value: Column, side: Column) -> Column:
        return stats.upper_median_of(F.collect_list(F.when(side, value)))

    sides = daily.groupBy(*dims).agg(
        middle(m.num(), is_cur).alias("cur_num"),
        middle(m.den(), is_cur).alias("cur_den"),
        middle(m.num(), is_base).alias("base_num"),
        middle(m.den(), is_base).alias("base_den"),
        F.coalesce(F.sum(F.when(is_cur, F.col("events"))), F.lit(0)).alias("requests"),
        F.coalesce(F.sum(F.when(is_cur, m.num())), F.lit(0.0)).alias("numerator"),
        F.coalesce(F.sum(F.when(is_cur, m.den())), F.lit(0.0)).alias("denominator"),
    )
    if dims:
        sides = sides.filter("requests > 0")
    values = sides.select(
        *dims,
        ratio(m, F.col("cur_num"), F.col("cur_den")).alias("current"),
        ratio(m, F.col("base_num"), F.col("base_den")).alias("baseline"),
        "requests",
        "numerator",
        "denominator",
    )
    delta = F.col("current") - F.col("baseline")
    points = delta * 100.0 if m.is_ratio else F.lit(None).cast("double")
    out = with_share(values).withColumns(
        {
            "delta_pct": stats.safe_pct(delta, F.col("baseline")),
            "delta_pp": points,
            **reliability(m),
        }
    )
    if not dims:
        return out
    moved = F.desc_nulls_last(F.abs(delta) * F.col("requests"))
    return out.orderBy(moved, *dims).limit(row_limit(limit) + 1)


def rank(
    source: EventSource,
    metric: str,
    dimension: str,
    start: Day,
    end: Day | None = None,
    order: str = "worst",
    filters: Mapping[str, object] | None = None,
    limit: int | None = None,
    min_requests: int = T.segment_min_requests,
) -> DataFrame:
    """Values of one dimension by a metric. Shares are over the rows that pass the floors.

    Like every listing here, up to ``limit + 1`` rows: the extra row says that there are more.
    """
    m = resolve_metric(metric)
    dim = check_dimension(metric, dimension)
    directions = {
        "worst": F.asc("value"),
        "best": F.desc("value"),
        "largest": F.desc("requests"),
    }
    if order not in directions:
        raise QueryError(f"order must be one of {', '.join(directions)}")
    where = in_window(start, end if end is not None else start)
    grouped = source.grouped([dim], [dim], scope(filters, metric), where)
    kept = grouped.filter(m.floors(min_requests)).select(dim, *_level(m))
    return with_share(kept).orderBy(directions[order], dim).limit(row_limit(limit) + 1)


def dimension_values(
    source: EventSource, dimension: str, metric: str, start: Day, end: Day, limit: int = 30
) -> DataFrame:
    """Values of a dimension by traffic, up to ``limit + 1`` of them."""
    dim = check_dimension(resolve_metric(metric).name, dimension)
    grouped = source.grouped([dim], [dim], where=in_window(start, end))
    values = grouped.select(F.col(dim).alias("value"), F.col("events").alias("requests"))
    return with_share(values).orderBy(F.desc("requests"), "value").limit(row_limit(limit) + 1)


def stacked(metrics: Sequence[str]) -> Column:
    """One row per metric from one row of measures: ``metric, v, num, den``."""
    return F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(name).alias("metric"),
                    METRICS[name].value().alias("v"),
                    METRICS[name].num().alias("num"),
                    METRICS[name].den().alias("den"),
                )
                for name in metrics
            )
        )
    )


def stack_series(daily: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``(metric, d, v)`` from one row of measures per day."""
    long = daily.select(F.col("event_date").alias("d"), stacked(metrics).alias("m"))
    return long.select("m.metric", "d", F.col("m.v").alias("v"))


def daily_series(source: EventSource, metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Any number of metrics per day from one pass."""
    return stack_series(source.grouped(["event_date"]), metrics)


def growth_per_metric(series: DataFrame) -> DataFrame:
    """``(metric, growth)``: robust weekly growth of each daily series.

    Grouped per metric; a group holds one point per calendar day.
    """
    points = F.array_sort(
        F.collect_list(
            F.when(
                F.col("v") > 0,
                F.struct(
                    F.unix_date("d").cast("double").alias("x"), F.log("v").alias("y")
                ),
            )
        )
    )
    grouped = series.groupBy("metric").agg(points.alias("points"))
    return grouped.select("metric", stats.weekly_growth(F.col("points")).alias("growth"))


def overview(source: EventSource) -> DataFrame:
    """Bounds, exact number of days and the funnel totals."""
    daily = source.grouped(["event_date"])
    return daily.agg(
        F.min("event_date").alias("start"),
        F.max("event_date").alias("end"),
        F.count_distinct("event_date").alias("days"),
        F.sum("events").alias("requests"),
        F.sum("fills").alias("filled"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("revenue").alias("revenue"),
    )


def evidence_of(answer: DataFrame, label: Column, metric: str, query_hash: str) -> DataFrame:
    """The evidence rows of a measured answer, as a second projection of the same frame."""
    return answer.select(
        label.alias("label"),
        F.round("value", 6).alias("value"),
        F.lit(resolve_metric(metric).unit).alias("unit"),
        F.round("share_pct", 4).alias("share_pct"),
        F.lit(query_hash).alias("query_hash"),
    )

