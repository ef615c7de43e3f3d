"""Detection: is a day outside its own same-weekday history, on the platform or in a segment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swingtrace.config import SWEEP_METRICS, Thresholds, cut_key, sweep_cuts
from swingtrace.config import T as DEFAULTS
from swingtrace.functions import stats
from swingtrace.functions.masks import OPEN, Mask
from swingtrace.functions.metrics import METRICS, resolve_metric, rollup_measures
from swingtrace.operators import baseline as B
from swingtrace.operators.query import daily_series, growth_per_metric, stack_series, stacked
from swingtrace.operators.source import EventSource, RollupSource
from swingtrace.sources.store import materialize


def _judge(points: DataFrame, growth: Column, value: str = "v") -> DataFrame:
    """Adds baseline, spread, floored, pct and sigma to rows carrying ``points``."""
    staged = points.withColumn("base", B.trend_baseline(F.col("points"), growth))
    staged = staged.select(
        "*",
        F.col("base.centre").alias("baseline"),
        F.col("base.spread").alias("spread"),
        F.col("base.floored").alias("floored"),
    ).drop("base")
    delta = F.col(value) - F.col("baseline")
    return staged.withColumns(
        {
            "pct": stats.safe_pct(delta, F.col("baseline")),
            "sigma": delta / F.nullif(F.col("spread"), F.lit(0.0)),
        }
    )


def platform_scan(
    source: EventSource, metrics: Sequence[str] = SWEEP_METRICS, t: Thresholds = DEFAULTS
) -> DataFrame:
    """Every metric on every day; the days that fire."""
    series = daily_series(source, metrics).withColumn("v", F.coalesce("v", F.lit(0.0)))
    growth = growth_per_metric(series)
    # one row per metric name
    judged = B.prior_weeks(series, ["metric"]).join(F.broadcast(growth), "metric")
    judged = judged.filter(F.size("points") >= t.min_baseline_days)
    fired = _judge(judged, F.col("growth")).filter(
        (F.abs("pct") >= t.platform_pct) & (F.abs("sigma") >= t.platform_sigma)
    )
    return fired.select(
        "metric", F.col("d").alias("day"), F.col("v").alias("actual"), "baseline", "pct", "sigma"
    )


def detect_rows(
    daily: DataFrame,
    metric: str,
    start: B.Day,
    end: B.Day,
    keys: Sequence[str] = (),
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """The verdict on one window, per key, from daily measures of window and baseline days.

    Counts and money are compared per day present; ratios as the mean of the days. Growth comes from
    the days passed in, so a short list carries none.
    """
    m = resolve_metric(metric)
    inc = B.in_window(start, end)
    value = F.coalesce(m.value(), F.lit(0.0))
    anchor = F.unix_date(F.lit(B.as_date(start)))
    weeks = F.greatest(
        F.lit(1),
        F.floor((anchor - F.unix_date("event_date")) / 7.0 + F.lit(0.5)).cast("int"),
    )
    grouped = daily.groupBy(*keys).agg(
        F.avg(F.when(inc, value)).alias("incident"),
        F.collect_list(
            F.when(~inc, F.struct(weeks.alias("weeks"), value.alias("v")))
        ).alias("points"),
        F.array_sort(
            F.collect_list(
                F.when(
                    value > 0,
                    F.struct(
                        F.unix_date("event_date").cast("double").alias("x"),
                        F.log(value).alias("y"),
                    ),
                )
            )
        ).alias("whole"),
    )
    grouped = grouped.withColumn("growth", stats.weekly_growth(F.col("whole")))
    judged = _judge(grouped.withColumn("v", F.col("incident")), F.col("growth"))
    delta = F.coalesce(F.col("incident") - F.coalesce("baseline", F.lit(0.0)), F.lit(0.0))
    days = F.size("points")
    pct = F.coalesce("pct", F.lit(0.0))
    sigma = F.coalesce("sigma", F.lit(0.0))
    passes = (F.abs(pct) >= t.platform_pct) & (F.abs(sigma) >= t.platform_sigma)
    enough = days >= t.min_baseline_days
    refusal = F.format_string(
        "Comparable days before it: %d. Needed: %d.",
        days,
        F.lit(t.min_baseline_days),
    )
    moved = F.format_string(
        "%.1f%% off, %.1f standard deviations of %d comparable days.", pct, sigma, days
    )
    inside = F.format_string(
        f"%.1f%% off (limit {t.platform_pct:g}%%), %.1f standard deviations (limit {t.platform_sigma:g}).",
        pct,
        sigma,
    )
    return judged.select(
        *keys,
        F.lit(metric).alias("metric"),
        "incident",
        F.coalesce("baseline", F.lit(0.0)).alias("baseline"),
        F.coalesce("spread", F.lit(0.0)).alias("spread"),
        days.alias("baseline_days"),
        delta.alias("delta_abs"),
        pct.alias("delta_pct"),
        (delta * 100.0 if m.has_points else F.lit(None).cast("double")).alias("delta_pp"),
        sigma.alias("sigma"),
        F.coalesce("floored", F.lit(False)).alias("floored"),
        (enough & passes).alias("anomalous"),
        F.when(~enough, refusal).when(passes, moved).otherwise(inside).alias("reason"),
    )


def detect(
    source: EventSource,
    metric: str,
    start: B.Day,
    end: B.Day,
    data_start: B.Day,
    mask: Mask = OPEN,
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """One metric, one window, one optional mask: a single verdict row."""
    days = B.in_window(start, end) | B.in_days(B.baseline_days(start, end, data_start))
    daily = source.grouped(["event_date"], mask=mask, where=days)
    return detect_rows(daily, metric, start, end, t=t)


def _swept(metrics: Sequence[str]) -> Column:
    """Whether a metric may be cut by a cell's dimensions."""
    allowed = {m: [cut_key(c) for c in sweep_cuts(m)] for m in metrics}
    everywhere = set.intersection(*(set(v) for v in allowed.values()))
    extra = [
        (F.col("metric") == m) & F.col("dim").isin(*sorted(set(keys) - everywhere))
        for m, keys in allowed.items()
        if set(keys) - everywhere
    ]
    ok = F.col("dim").isin(*sorted(everywhere))
    for condition in extra:
        ok = ok | condition
    return ok


def segment_series(
    cells: DataFrame,
    metrics: Sequence[str] = SWEEP_METRICS,
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """``metric, dim, val, d, v, requests`` for every cell that clears the floors."""
    long = cells.select(
        "dim", "val", F.col("event_date").alias("d"), "events", stacked(metrics).alias("m")
    ).select("m.metric", "dim", "val", "d", "m.v", "m.num", "m.den", "events")
    ok = (F.col("events") >= t.segment_min_requests) & F.col("v").isNotNull() & _swept(metrics)
    for name in metrics:
        m = METRICS[name]
        for column, low in (("num", m.min_numerator), ("den", m.min_denominator)):
            if low:
                ok = ok & ((F.col("metric") != name) | (F.col(column) >= low))
    return long.filter(ok).select(
        "metric", "dim", "val", "d", "v", F.col("events").alias("requests")
    )


def segment_scan(
    cells: DataFrame,
    growth: DataFrame | Mapping[str, float],
    metrics: Sequence[str] = SWEEP_METRICS,
    window: tuple[B.Day, B.Day] | None = None,
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """Firings of every segment on every day, all metrics in one job.

    ``window`` limits what is reported, never what is used as history.
    """
    series = B.prior_weeks(segment_series(cells, metrics, t), ["metric", "dim", "val"])
    series = series.filter(F.size("points") >= t.min_baseline_days)
    if window is not None:
        series = series.filter(B.in_window(*window, column="d"))
    if isinstance(growth, DataFrame):
        # one row per metric name
        series = series.join(F.broadcast(growth), "metric")
    else:
        per_metric = F.create_map(
            *(x for m in metrics for x in (F.lit(m), F.lit(float(growth.get(m, 0.0)))))
        )
        series = series.withColumn("growth", per_metric[F.col("metric")])
    fired = _judge(series, F.col("growth")).filter(
        (F.abs("pct") >= t.segment_pct) & (F.abs("sigma") >= t.segment_sigma)
    )
    return fired.select(
        "metric",
        "dim",
        "val",
        F.col("d").alias("day"),
        F.col("v").alias("actual"),
        "baseline",
        "pct",
        "sigma",
        "requests",
    )


def group_incidents(firings: DataFrame) -> DataFrame:
    """Runs of consecutive firing days per segment."""
    keys = ["metric", "dim", "val"]
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("day"))
    runs = firings.withColumn("island", F.date_sub("day", order))
    worst = F.max_by(
        F.struct("pct", "sigma"), F.struct(F.abs("pct"), -F.unix_date("day"))
    )
    grouped = runs.groupBy(*keys, "island").agg(
        F.min("day").alias("start"),
        F.max("day").alias("end"),
        F.count(F.lit(1)).alias("days"),
        worst.alias("worst"),
        F.floor(F.avg("requests") + F.lit(0.5)).alias("requests_per_day"),
    )
    return grouped.select(
        *keys,
        "start",
        "end",
        "days",
        F.col("worst.pct").alias("worst_pct"),
        F.col("worst.sigma").alias("worst_sigma"),
        "requests_per_day",
    )


_FOLD = (
    "metric string, start date, before_start date, before_neg double, before_dim string, "
    "before_val string, flush_neg double, flush_dim string, flush_val string"
)


def _fold_days(span_days: int):
    """Walk one metric's start days in order and say where a new cluster begins.

    The input is one row per (start, end) with the first and last incident of that interval in
    cluster order, so its size is bounded by the calendar and not by the number of incidents.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["start", "end"])
        out, opened, first, reach = [], None, None, None
        for start, group in frame.groupby("start", sort=True):
            rows = [
                (
                    r.end,
                    (r.first_neg, r.first_dim, r.first_val),
                    (r.last_neg, r.last_dim, r.last_val),
                )
                for r in group.itertuples()
            ]
            if first is None or start > reach:
                flush = min(r[1] for r in rows)
            else:
                over = [r[1] for r in rows if (r[0] - first).days > span_days]
                flush = min(over) if over else None
            before = opened or (None, (None, None, None))
            out.append(
                (frame["metric"].iloc[0], start, before[0], *before[1], *(flush or (None,) * 3))
            )
            if flush is None:
                reach = max(reach, *(r[0] for r in rows))
                continue
            long = [r[2] for r in rows if (r[0] - start).days > span_days]
            last = max([flush, *long])
            opened, first = (start, last), start
            reach = max(r[0] for r in rows if r[2] >= last)
        return pd.DataFrame(out, columns=[c.split()[0] for c in _FOLD.split(", ")])

    return fold


def cluster_windows(incidents: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Incident windows per metric: overlapping incidents merged, split beyond the span limit.

    The merge is an ordered fold by (start, severity, dim, val). Only a calendar-sized summary is
    folded; incidents find their cluster by joining the fold's result on (metric, start), and the
    lead, count and examples are ordinary aggregates.
    """
    neg = -(F.abs("worst_pct") * F.col("days"))
    incidents = materialize(incidents, "incidents")  # read several times below
    keyed = incidents.withColumn(
        "key", F.struct(neg.alias("neg"), F.col("dim").alias("dim"), F.col("val").alias("val"))
    )
    is_long = F.datediff("end", "start") > t.window_span_days
    summary = (
        keyed.groupBy("metric", "start", "end")
        .agg(F.min("key").alias("first"), F.max("key").alias("last"))
        .select(
            "metric",
            "start",
            "end",
            *(
                F.col(f"{side}.{f}").alias(f"{side}_{f}")
                for side in ("first", "last")
                for f in ("neg", "dim", "val")
            ),
        )
    )
    folded = summary.groupBy("metric").applyInPandas(_fold_days(t.window_span_days), _FOLD)
    folded = folded.select(
        "metric",
        "start",
        F.struct(
            F.col("before_start").alias("start"),
            F.struct(
                F.col("before_neg").alias("neg"),
                F.col("before_dim").alias("dim"),
                F.col("before_val").alias("val"),
            ).alias("key"),
        ).alias("before"),
        F.when(
            F.col("flush_neg").isNotNull(),
            F.struct(
                F.col("flush_neg").alias("neg"),
                F.col("flush_dim").alias("dim"),
                F.col("flush_val").alias("val"),
            ),
        ).alias("flush"),
    )
    # Incidents longer than the span limit open a cluster of their own; others follow the nearest
    # one before them. Start days without a long incident need no order, so their rows are spread.
    long_days = summary.filter(is_long).select("metric", "start").distinct()
    long_days = long_days.withColumn("has_long", F.lit(True))
    placed = keyed.join(folded, ["metric", "start"]).join(long_days, ["metric", "start"], "left")
    spread = F.when(F.col("has_long"), F.lit(-1)).otherwise(
        F.pmod(F.xxhash64("dim", "val"), F.lit(1024)).cast("int")
    )
    in_order = Window.partitionBy("metric", "start", "spread").orderBy("key")
    opener = F.max(F.when(is_long, F.col("key"))).over(
        in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = placed.withColumn("spread", spread).withColumn("opener", opener)
    joins_old = F.col("flush").isNull() | (F.col("key") < F.col("flush"))
    own = F.struct(
        F.col("start").alias("start"),
        F.greatest("flush", F.coalesce("opener", "flush")).alias("key"),
    )
    placed = placed.withColumn("cluster", F.when(joins_old, F.col("before")).otherwise(own))

    size = F.abs("worst_pct")
    top = Window.partitionBy("metric", "cluster").orderBy(size.desc(), "start", "key")
    shown = F.format_string(
        "%s='%s' %s%s%%",
        F.col("dim"),
        F.col("val"),
        F.when(F.col("worst_pct") >= 0, "+").otherwise(""),
        F.format_string("%.0f", F.col("worst_pct")),
    )
    examples = (
        placed.withColumn("place", F.row_number().over(top))
        .filter("place <= 3")
        .groupBy("metric", "cluster")
        .agg(F.array_sort(F.collect_list(F.struct("place", shown.alias("text")))).alias("top"))
        .select("metric", "cluster", F.transform("top", lambda x: x["text"]).alias("examples"))
    )
    lead = F.min_by(
        F.struct("dim", "val", "start", "end", "days", "worst_pct", "worst_sigma",
                 "requests_per_day"),
        F.struct(neg.alias("neg"), F.col("start"), F.col("dim"), F.col("val")),
    )
    windows = placed.groupBy("metric", "cluster").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        lead.alias("lead"),
        F.count(F.lit(1)).alias("correlated"),
    )
    return windows.join(examples, ["metric", "cluster"]).select(
        "metric",
        "start",
        "end",
        F.col("lead.dim").alias("lead_dim"),
        F.col("lead.val").alias("lead_val"),
        F.col("lead.days").alias("days"),
        F.col("lead.worst_pct").alias("worst_pct"),
        F.col("lead.worst_sigma").alias("worst_sigma"),
        F.col("lead.requests_per_day").alias("requests_per_day"),
        "correlated",
        "examples",
        (F.abs("lead.worst_pct") * F.col("lead.days")).alias("severity"),
    )


def recall_scan(platform: DataFrame, segments: DataFrame, known: DataFrame):
    """Score firings against known incidents ``(label, metric, day)``.

    Returns one frame: ``outcome`` is found, missed or extra; extra rows are platform firings on no
    known date.
    """
    blended = platform.select("metric", "day").distinct().withColumn("blended", F.lit(True))
    segment = segments.select("metric", "day").distinct().withColumn("segment", F.lit(True))
    scored = (
        known.join(blended, ["metric", "day"], "left")
        .join(segment, ["metric", "day"], "left")
        .groupBy("label", "metric")
        .agg(
            F.coalesce(F.bool_or("blended"), F.lit(False)).alias("blended"),
            F.coalesce(F.bool_or("segment"), F.lit(False)).alias("segment"),
        )
        .select(
            F.when(F.col("blended") | F.col("segment"), "found").otherwise("missed").alias("outcome"),
            "label",
            "metric",
            F.lit(None).cast("date").alias("day"),
            (~F.col("blended") & F.col("segment")).alias("segment_only"),
        )
    )
    extra = platform.join(known.select("day").distinct(), "day", "left_anti").select(
        F.lit("extra").alias("outcome"),
        F.lit("").alias("label"),
        "metric",
        "day",
        F.lit(False).alias("segment_only"),
    )
    return scored.unionByName(extra)


def sweep(
    source: EventSource,
    metrics: Sequence[str] = SWEEP_METRICS,
    window: tuple[B.Day, B.Day] | None = None,
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """Firings of all sweep cuts, growth estimated from the whole platform series.

    The daily cells are written once: the platform series is one of their cuts, so the events are
    read a single time whatever the number of metrics.
    """
    cells = source.cells(sweep_cuts())
    if not isinstance(source, RollupSource):
        cells = materialize(cells, "sweep-cells")
    return sweep_cells(cells, metrics, window, t)


def sweep_cells(
    cells: DataFrame,
    metrics: Sequence[str] = SWEEP_METRICS,
    window: tuple[B.Day, B.Day] | None = None,
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """The sweep over stored daily cells, such as the daily rollup."""
    platform = cells.filter(F.col("dim") == "ad_format").groupBy("event_date")
    daily = platform.agg(*rollup_measures())
    growth = growth_per_metric(stack_series(daily, metrics))
    return segment_scan(cells, growth, metrics, window, t)


def find_incidents(
    source: EventSource,
    metrics: Sequence[str] = SWEEP_METRICS,
    window: tuple[B.Day, B.Day] | None = None,
    limit: int | None = 12,
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """The incident windows that matter most, by size times duration; all of them without a limit."""
    windows = cluster_windows(group_incidents(sweep(source, metrics, window, t)), t)
    order = (F.desc("severity"), "metric", "start", "lead_dim", "lead_val")
    return windows.orderBy(*order) if limit is None else windows.orderBy(*order).limit(limit)
