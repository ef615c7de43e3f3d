"""Rollups and detection."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from swingtrace.config import ROLLUP_CUTS, ROLLUP_KEYS, SWEEP_METRICS, T, sweep_cuts
from swingtrace.functions.metrics import METRICS
from swingtrace.operators import baseline as B
from swingtrace.operators import detect as D
from swingtrace.operators import query as Q
from swingtrace.operators import rollup as R
from swingtrace.operators.source import RollupSource
from swingtrace.plans import sqltext as S
from swingtrace.plans.basics import FROM, TO, WINDOW, _CELL_SUMMARY, cell_summary
from swingtrace.plans.registry import (
    FOLDED,
    by_metric,
    folded,
    panel,
    query,
    rnd,
    rounded,
    stored_folded,
    stored_rollups,
)
from swingtrace.sources import adapter as A
from swingtrace.sources import ingest
from swingtrace.sources.store import materialize, new_path

FLOOR = FOLDED.segment_min_requests
SWEPT = list(SWEEP_METRICS)

# -- rollups ------------------------------------------------------------------------------------

_PER_DAY = _CELL_SUMMARY.replace("SELECT dim", "SELECT event_date, dim").replace(
    "GROUP BY 1", "GROUP BY 1, 2"
)
_HOURLY = S.cells(ROLLUP_CUTS, by="event_date, event_hour")
_DAILY = S.cells(ROLLUP_CUTS)


@query("rollup_hourly", f"WITH {S.enriched()}, {_HOURLY} {_PER_DAY}")
def rollup_hourly(spark, sf):
    return cell_summary(R.rollup_hourly(stored_folded(spark, sf), gather=False), "event_date")


@query("rollup_daily", f"WITH {S.enriched()}, {_DAILY} {_PER_DAY}")
def rollup_daily(spark, sf):
    return cell_summary(stored_rollups(spark, sf).daily, "event_date")


@query("rollup_backfill_days", f"WITH {S.enriched()}, {_DAILY} {_PER_DAY}")
def rollup_backfill_days(spark, sf):
    """Build everything, then rebuild three days on top: nothing may change."""
    events = stored_folded(spark, sf)
    hourly, daily = new_path(spark, "rollup-hourly"), new_path(spark, "rollup-daily")
    ingest.write_rollups(events, hourly, daily, gather=False)
    _, rebuilt = ingest.backfill_days(events, B.days_between(FROM, TO), hourly, daily, gather=False)
    return cell_summary(rebuilt, "event_date")


@query(
    "rollup_read_cut",
    f"""WITH {S.enriched()}
SELECT event_date, app_category, os_version, count(*)::BIGINT AS events,
       sum(is_filled)::BIGINT AS fills, 'rollup:daily' AS served_from
FROM enriched GROUP BY 1, 2, 3""",
)
def rollup_read_cut(spark, sf):
    """A pair asked for in the other order comes back under its real column names."""
    source = stored_rollups(spark, sf)
    dims = ["os_version", "app_category"]
    rows = R.read_cut(source.daily, dims)
    return rows.select(
        "event_date",
        "app_category",
        "os_version",
        "events",
        "fills",
        F.lit(source.served_from(dims)).alias("served_from"),
    )


@query(
    "rollup_measure",
    f"""WITH {S.enriched()},
g AS (SELECT event_hour, ad_format, {S.SUMS} FROM enriched
      WHERE {WINDOW} AND region = 'ASIA' GROUP BY 1, 2)
SELECT event_hour, ad_format, {S.r(S.value("fill_rate"))} AS value, events AS requests,
       {S.r("events * 100.0 / (SELECT sum(events) FROM g)")} AS share_pct
FROM g ORDER BY event_hour, ad_format LIMIT 201""",
)
def rollup_measure(spark, sf):
    rows = Q.measure(
        stored_rollups(spark, sf), "fill_rate", FROM, TO,
        filters={"region": "ASIA"}, group_by=["ad_format"], granularity="hour", limit=200,
    )
    return rounded(rows, value=6, share_pct=6).select(
        "event_hour", "ad_format", "value", "requests", "share_pct"
    )


@query(
    "rollup_health",
    f"""SELECT count(*)::BIGINT AS fact_events, {len(ROLLUP_KEYS)}::BIGINT AS daily_keys,
       count(*)::BIGINT AS daily_min, count(*)::BIGINT AS daily_max,
       {len(ROLLUP_KEYS)}::BIGINT AS hourly_keys, count(*)::BIGINT AS hourly_min,
       count(*)::BIGINT AS hourly_max, '' AS reason, TRUE AS ready FROM lineitem""",
)
def rollup_health(spark, sf):
    source = stored_rollups(spark, sf)
    counted = source.rows(()).agg(F.count(F.lit(1)).alias("fact_events"))
    return R.rollup_health(counted, source.hourly, source.daily)


@query(
    "rollup_stale_days",
    f"""WITH {S.enriched()}
SELECT event_date, region, count(*)::BIGINT AS events, sum(is_filled)::BIGINT AS fills,
       'rollup:daily+raw' AS served_from, {TO!r} AS stale
FROM enriched GROUP BY 1, 2""",
)
def rollup_stale_days(spark, sf):
    """One day has lost a region from its daily rollup: that day comes from the events, the others from the rollup."""
    whole = stored_rollups(spark, sf)
    lost = (F.col("event_date") == F.lit(TO).cast("date")) & (F.col("dim") == "region") & (F.col("val") == "ASIA")
    daily = whole.daily.filter(~lost)
    counts = materialize(R.manifest(whole.hourly, daily), "manifest")
    source = RollupSource(whole.hourly, daily, star=whole.star, manifest=counts)
    rows = source.grouped(["event_date", "region"], ["region"])
    stale = ",".join(map(str, source.stale_days))
    return rows.select(
        "event_date", "region", "events", "fills",
        F.lit(source.served_from(["region"])).alias("served_from"), F.lit(stale).alias("stale"),
    )


_FIRINGS = f"""SELECT metric, dim, val, day, {S.by_metric("actual")} AS actual,
       {S.r("baseline", 4)} AS baseline, {S.r("pct", 4)} AS pct, {S.r("sigma", 4)} AS sigma,
       requests FROM firings"""


def _firings(df):
    shown = rounded(df, baseline=4, pct=4, sigma=4)
    return shown.withColumn("actual", by_metric("actual"))


@query("rollup_sweep", f"WITH {S.enriched()}, {S.firings(SWEPT, FLOOR)} {_FIRINGS}")
def rollup_sweep(spark, sf):
    daily = stored_rollups(spark, sf).daily
    return _firings(D.sweep_cells(daily, t=FOLDED))


# -- detection ----------------------------------------------------------------------------------


@query(
    "d_baseline_dates",
    f"""WITH {S.fact()}, b AS (SELECT min(event_date) AS lo FROM fact)
SELECT DISTINCT CAST(w.d - k * 7 AS DATE) AS d
FROM (SELECT unnest(generate_series(DATE '{FROM}', DATE '{TO}', INTERVAL 1 DAY))::DATE AS d) w,
     (VALUES (1), (2), (3), (4)) t(k), b
WHERE w.d - k * 7 >= lo AND NOT (w.d - k * 7 BETWEEN DATE '{FROM}' AND DATE '{TO}')""",
)
def d_baseline_dates(spark, sf):
    return B.baseline_dates(folded(spark, sf).rows(()), FROM, TO)


_SERIES = f"""daily AS (SELECT event_date AS d, {S.SUMS} FROM enriched GROUP BY 1),
series0 AS MATERIALIZED (SELECT metric, d, coalesce(v, 0) AS v
                         FROM ({S.stacked(SWEPT, "daily", "d")})),{S.growth("series0")},
series AS (SELECT s.*, g.growth FROM series0 s JOIN growth g USING (metric)),
{S.judged("series", "metric")}"""


@query(
    "d_trend_baseline",
    f"""WITH {S.enriched()}, {_SERIES}
SELECT metric, d, {S.r("baseline", 4)} AS baseline, {S.r("spread", 4)} AS spread FROM judged""",
)
def d_trend_baseline(spark, sf):
    series = Q.daily_series(folded(spark, sf), SWEPT).withColumn("v", F.coalesce("v", F.lit(0.0)))
    growth = Q.growth_per_metric(series)
    points = B.prior_weeks(series, ["metric"]).join(F.broadcast(growth), "metric")
    points = points.filter(F.size("points") >= T.min_baseline_days)
    base = points.withColumn("b", B.trend_baseline(F.col("points"), F.col("growth")))
    return base.select(
        "metric", "d", rnd("b.centre", 4).alias("baseline"), rnd("b.spread", 4).alias("spread")
    )


@query(
    "d_platform_scan",
    f"""WITH {S.enriched()}, {_SERIES}
SELECT metric, d AS day, {S.by_metric("v")} AS actual, {S.r("baseline", 4)} AS baseline,
       {S.r("pct", 4)} AS pct, {S.r("sigma", 4)} AS sigma
FROM judged WHERE abs(pct) >= {T.platform_pct} AND abs(sigma) >= {T.platform_sigma}""",
)
def d_platform_scan(spark, sf):
    return _firings(D.platform_scan(folded(spark, sf)))


def detect_sql(metric: str, start: str, end: str, where: str = "TRUE") -> str:
    """One verdict row over ``enriched``; growth is 0 because fewer than 14 days are read."""
    m = METRICS[metric]
    base = B.baseline_days(start, end, A.EPOCH)
    inc = f"event_date BETWEEN DATE '{start}' AND DATE '{end}'"
    points = "delta * 100" if m.has_points else "CAST(NULL AS DOUBLE)"
    return f"""
dd AS (SELECT event_date, {inc} AS inc, coalesce({S.value(metric)}, 0) AS v
       FROM (SELECT event_date, {S.SUMS} FROM enriched
             WHERE ({where}) AND ({inc} OR event_date IN {S.days(base)}) GROUP BY 1)),
ds AS (SELECT avg(v) FILTER (WHERE inc) AS incident, list(v) FILTER (WHERE NOT inc) AS xs FROM dd),
dc AS (SELECT *, {S.median("xs")} AS baseline FROM ds),
dm AS (SELECT *, {S.median("list_transform(xs, lambda x: abs(x - baseline))")} * {T.mad_scale}
              AS observed FROM dc),
det AS (
  SELECT incident, baseline, greatest(observed, abs(baseline) * {T.spread_floor}) AS spread,
         len(xs) AS n, incident - baseline AS delta,
         coalesce(delta / nullif(baseline, 0) * 100, 0) AS pct,
         coalesce(delta / nullif(spread, 0), 0) AS sigma,
         observed < abs(baseline) * {T.spread_floor} AS floored, {points} AS pp
  FROM dm)"""


def verdict_sql(digits: int) -> str:
    return f"""SELECT {S.r("incident", digits)} AS incident, {S.r("baseline", digits)} AS baseline,
       n::INTEGER AS baseline_days, {S.r("pct", 4)} AS delta_pct, {S.r("pp", 4)} AS delta_pp,
       {S.r("sigma", 4)} AS sigma, floored,
       n >= {T.min_baseline_days} AND abs(pct) >= {T.platform_pct}
         AND abs(sigma) >= {T.platform_sigma} AS anomalous FROM det"""


def verdict(df, digits: int):
    out = rounded(df, incident=digits, baseline=digits, delta_pct=4, delta_pp=4, sigma=4)
    return out.select(
        "incident", "baseline", "baseline_days", "delta_pct", "delta_pp", "sigma", "floored",
        "anomalous",
    )


@query(
    "d_detect",
    f"WITH {S.enriched()}, {detect_sql('fill_rate', FROM, TO)} {verdict_sql(6)}",
)
def d_detect(spark, sf):
    return verdict(D.detect(folded(spark, sf), "fill_rate", FROM, TO, A.EPOCH), 6)


@query("d_segment_scan", f"WITH {S.enriched()}, {S.firings(SWEPT, FLOOR)} {_FIRINGS}")
def d_segment_scan(spark, sf):
    return _firings(D.sweep(folded(spark, sf), t=FOLDED))


_INCIDENTS = f"""SELECT metric, dim, val, "start", "end", days, {S.r("worst_pct", 4)} AS worst_pct,
       {S.r("worst_sigma", 4)} AS worst_sigma, requests_per_day FROM incidents"""


@query(
    "d_group_incidents",
    f"WITH {S.enriched()}, {S.firings(SWEPT, FLOOR)}, {S.incidents()} {_INCIDENTS}",
)
def d_group_incidents(spark, sf):
    incidents = D.group_incidents(D.sweep(folded(spark, sf), t=FOLDED))
    return rounded(incidents, worst_pct=4, worst_sigma=4)


WINDOW_COLUMNS = f"""metric, "start", "end", lead_dim, lead_val, days,
       {S.r("worst_pct", 4)} AS worst_pct, {S.r("worst_sigma", 4)} AS worst_sigma,
       requests_per_day, correlated"""


def window_columns(df):
    return rounded(df, worst_pct=4, worst_sigma=4).drop("examples", "severity")


@query(
    "d_cluster_windows",
    f"""WITH RECURSIVE {S.enriched()}, {S.firings(SWEPT, FLOOR)}, {S.incidents()}, {S.windows()}
SELECT {WINDOW_COLUMNS} FROM windows""",
)
def d_cluster_windows(spark, sf):
    incidents = D.group_incidents(D.sweep(folded(spark, sf), t=FOLDED))
    return window_columns(D.cluster_windows(incidents, FOLDED))


_KNOWN = (
    ("A", "fill_rate", "2026-06-23"),
    ("B", "requests", "2026-06-24"),
    ("C", "ecpm", "2026-06-23"),
)
_BREAK_METRICS = ["fill_rate", "requests", "ecpm", "revenue"]


@query(
    "d_recall_scan",
    f"""WITH {S.panel("break")}, {S.firings(_BREAK_METRICS, T.segment_min_requests)},
pseries AS MATERIALIZED (SELECT s.metric, s.d, coalesce(s.v, 0) AS v, g.growth
                         FROM series s JOIN growth g USING (metric)),
{S.judged("pseries", "metric", "pj")},
pf AS (SELECT metric, d AS day FROM pj
       WHERE abs(pct) >= {T.platform_pct} AND abs(sigma) >= {T.platform_sigma}),
known(label, metric, day) AS (VALUES {", ".join(f"('{a}', '{b}', DATE '{c}')" for a, b, c in _KNOWN)}),
sc AS (SELECT label, metric, bool_or(EXISTS (SELECT 1 FROM pf WHERE pf.metric = k.metric AND pf.day = k.day)) AS blended,
              bool_or(EXISTS (SELECT 1 FROM firings f WHERE f.metric = k.metric AND f.day = k.day)) AS segment
       FROM known k GROUP BY 1, 2)
SELECT CASE WHEN blended OR segment THEN 'found' ELSE 'missed' END AS outcome, label, metric,
       CAST(NULL AS DATE) AS day, NOT blended AND segment AS segment_only FROM sc
UNION ALL
SELECT 'extra', '', metric, day, FALSE FROM pf WHERE day NOT IN (SELECT day FROM known)""",
)
def d_recall_scan(spark, sf):
    """The planted break is found, the two incidents that were never planted are missed."""
    source = panel(spark, sf, "break")
    cells = materialize(source.cells(sweep_cuts()), "recall-cells")
    segments = D.sweep_cells(cells, _BREAK_METRICS)
    platform = D.platform_scan(source, _BREAK_METRICS)
    known = spark.createDataFrame(
        [(a, b, dt.date.fromisoformat(c)) for a, b, c in _KNOWN],
        "label string, metric string, day date",
    )
    return D.recall_scan(platform, segments, known)


@query(
    "flagship",
    f"""WITH {S.fact()},
d AS (SELECT event_date, ad_format, count(*)::BIGINT AS requests,
             sum(is_filled)::DOUBLE / count(*) AS v FROM fact GROUP BY 1, 2)
SELECT c.event_date, c.ad_format, c.requests, {S.r("any_value(c.v)")} AS fill_rate,
       {S.r("median(b.v)")} AS baseline
FROM d c LEFT JOIN d b ON b.ad_format = c.ad_format
     AND c.event_date - b.event_date IN (7, 14, 21, 28)
GROUP BY 1, 2, 3""",
)
def flagship(spark, sf):
    """Fill rate by day and ad format beside the median of its same weekdays."""
    m = METRICS["fill_rate"]
    daily = folded(spark, sf).grouped(["event_date", "ad_format"], ["ad_format"])
    series = daily.select(
        "ad_format", F.col("event_date").alias("d"), m.value().alias("v"), "events"
    )
    from swingtrace.functions.stats import median_of

    points = B.prior_weeks(series, ["ad_format"])
    base = median_of(F.transform("points", lambda p: p["v"]))
    return points.select(
        F.col("d").alias("event_date"),
        "ad_format",
        F.col("events").alias("requests"),
        rnd("v").alias("fill_rate"),
        rnd(base).alias("baseline"),
    )
