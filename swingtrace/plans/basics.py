"""Sources, predicates, metrics and the typed metric questions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from swingtrace import schema
from swingtrace.config import FILLED_ONLY_DIMENSIONS, sweep_cuts
from swingtrace.functions import masks, stats
from swingtrace.functions.metrics import (
    METRICS,
    QueryError,
    check_dimension,
)
from swingtrace.functions.quantiles import quantiles
from swingtrace.operators import baseline as B
from swingtrace.operators import query as Q
from swingtrace.operators import rollup as R
from swingtrace.plans import sqltext as S
from swingtrace.plans.registry import by_metric, folded, query, rnd, rounded
from swingtrace.sources import adapter as A
from swingtrace.sources import ingest
from swingtrace.sources.store import new_path
from swingtrace.sources.telemetry_views import events as telemetry_events

FROM, TO = "2026-06-23", "2026-06-25"
WINDOW = f"event_date BETWEEN DATE '{FROM}' AND DATE '{TO}'"
LOADED_UNTIL = dt.date(2026, 6, 28)


def _daily_sql(extra: str = "") -> str:
    return f"""WITH {S.fact()}
SELECT event_date, count(*)::BIGINT AS n, {S.r("sum(revenue)", 4)} AS revenue
FROM fact {extra} GROUP BY 1"""


def _per_day(fact):
    return fact.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("revenue"), 4).alias("revenue")
    )


# -- sources and sinks --------------------------------------------------------------------------


@query(
    "src_fact_parquet",
    f"""WITH {S.fact()}
SELECT event_time, app_id, geo_device_id, advertiser_id, ad_format, is_filled, is_impression,
       is_click, {S.r("revenue", 4)} AS revenue FROM fact""",
)
def src_fact_parquet(spark, sf):
    path = new_path(spark, "fact")
    A.ad_events(spark, sf).write.parquet(path)
    return rounded(ingest.read_fact(spark, path), revenue=4)


@query(
    "src_dim_csv",
    f"""WITH {S._dims()}
SELECT app_id, app_category AS category, publisher_tier FROM apps""",
)
def src_dim_csv(spark, sf):
    apps, _, _ = A.dimensions(spark, sf)
    path = new_path(spark, "apps-csv")
    apps.write.option("header", True).csv(path)
    return ingest.replace_dim(ingest.load_dim(spark, path, schema.APPS), new_path(spark, "apps"))


@query("sink_day_partitions", _daily_sql())
def sink_day_partitions(spark, sf):
    return _per_day(ingest.write_days(A.ad_events(spark, sf), new_path(spark, "days")))


@query("load_replace_days", _daily_sql())
def load_replace_days(spark, sf):
    fact, target = A.ad_events(spark, sf), new_path(spark, "replace")
    ingest.replace_days(fact, target)
    again = [d for d in B.days_between(A.EPOCH, "2026-06-07")]
    return _per_day(ingest.replace_days(fact, target, again))


@query(
    "load_pending_days",
    f"""WITH {S.fact()}
SELECT event_date, count(*)::BIGINT AS source_rows, 0::BIGINT AS loaded_rows
FROM fact WHERE event_date > DATE '{LOADED_UNTIL}' GROUP BY 1""",
)
def load_pending_days(spark, sf):
    """The target was loaded up to a day; the days after it are pending."""
    fact, target = A.ad_events(spark, sf), new_path(spark, "pending")
    loaded = ingest.replace_days(fact, target, B.days_between(A.EPOCH, LOADED_UNTIL))
    return ingest.pending_days(ingest.by_day(fact), loaded)


@query("load_assert_days", _daily_sql())
def load_assert_days(spark, sf):
    fact, target = A.ad_events(spark, sf), new_path(spark, "assert")
    loaded = ingest.replace_days(fact, target)
    ingest.assert_days(ingest.by_day(fact), loaded)
    return _per_day(loaded)


@query(
    "dataset_bounds",
    f"""WITH {S.fact()}
SELECT min(event_date) AS "start", max(event_date) AS "end" FROM fact""",
)
def dataset_bounds(spark, sf):
    return B.bounds(folded(spark, sf).rows(()))


@query(
    "dataset_overview",
    f"""WITH {S.fact()}
SELECT min(event_date) AS "start", max(event_date) AS "end",
       count(DISTINCT event_date)::BIGINT AS days, count(*)::BIGINT AS requests,
       sum(is_filled)::BIGINT AS filled, sum(is_impression)::BIGINT AS impressions,
       sum(is_click)::BIGINT AS clicks, {S.r("sum(revenue)", 4)} AS revenue FROM fact""",
)
def dataset_overview(spark, sf):
    return rounded(Q.overview(folded(spark, sf)), revenue=4)


def _notes(spark, sf):
    """Every error event as a notification line."""
    rows = telemetry_events(spark, sf).filter("event_type = 'error'")
    return rows.select(
        F.col("Timestamp").alias("at"),
        F.col("event_id").cast("string").alias("watch_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.lit("fill_rate").alias("metric"),
        F.lit("ad_format").alias("dimension"),
        F.col("props").alias("value"),
        F.to_date("Timestamp").alias("day"),
        F.col("value").alias("pct"),
        F.col("k").cast("double").alias("sigma"),
        F.col("k").alias("requests_per_day"),
    )


_NOTES_SQL = """SELECT ts AS "at", event_id::VARCHAR AS watch_id, user_id::VARCHAR AS user_id,
       'fill_rate' AS metric, 'ad_format' AS dimension, props AS value, ts::DATE AS day,
       value AS pct, (props->>'$.k')::DOUBLE AS sigma, (props->>'$.k')::BIGINT AS requests_per_day
FROM events WHERE event_type = 'error'"""


@query("sink_events_jsonl", _NOTES_SQL)
def sink_events_jsonl(spark, sf):
    path = new_path(spark, "notes")
    ingest.append_jsonl(_notes(spark, sf), path)
    return ingest.jsonl(spark, path, schema.NOTIFICATIONS)


@query(
    "src_events_jsonl",
    f"SELECT * FROM ({_NOTES_SQL}) WHERE \"at\" > TIMESTAMP '2024-01-10' ORDER BY \"at\" DESC LIMIT 25",
)
def src_events_jsonl(spark, sf):
    path = new_path(spark, "notes")
    ingest.append_jsonl(_notes(spark, sf), path)
    return ingest.read_jsonl(spark, path, schema.NOTIFICATIONS, since="2024-01-10")


# -- projections, filters, predicates -----------------------------------------------------------

_ENRICHED = (
    "event_time, event_date, event_hour, day_of_week, hour_of_day, app_id, geo_device_id, "
    "advertiser_id, ad_format, is_filled, is_impression, is_click, app_category, publisher_tier, "
    "advertiser_vertical, campaign_type, region, country, device_model, os_version"
)


@query(
    "enrich_star",
    f"WITH {S.enriched()} SELECT {_ENRICHED}, {S.r('revenue', 4)} AS revenue FROM enriched",
)
def enrich_star_query(spark, sf):
    rows = folded(spark, sf).rows()
    return rows.select(*_ENRICHED.split(", "), rnd("revenue", 4).alias("revenue"))


def _sums_sql(where: str, by: str = "event_date") -> str:
    return f"""WITH {S.enriched()}
SELECT {by}, count(*)::BIGINT AS events, sum(is_filled)::BIGINT AS fills,
       sum(is_impression)::BIGINT AS impressions, sum(is_click)::BIGINT AS clicks,
       {S.r("sum(revenue)", 4)} AS revenue
FROM enriched WHERE {where} GROUP BY {by}"""


def _masked(spark, sf, mask):
    grouped = folded(spark, sf).grouped(["event_date"], mask=mask)
    return rounded(grouped, revenue=4)


@query("filter_segment", _sums_sql("device_model = 'BUILDING'"))
def filter_segment(spark, sf):
    return _masked(spark, sf, masks.segment_mask("device_model", "BUILDING"))


@query("filter_segment_pair", _sums_sql("region = 'ASIA' AND device_model = 'BUILDING'"))
def filter_segment_pair(spark, sf):
    return _masked(spark, sf, masks.segment_mask("region|device_model", "ASIA|BUILDING"))


@query(
    "filter_exclusion",
    _sums_sql(
        "NOT (device_model = 'BUILDING') AND NOT (region = 'ASIA' AND os_version = 'os_3')"
    ),
)
def filter_exclusion(spark, sf):
    return _masked(
        spark, sf, masks.exclude_all([("device_model", "BUILDING"), ("region|os_version", "ASIA|os_3")])
    )


@query(
    "filter_scope",
    _sums_sql(
        "starts_with(app_category, 'Brand#1') AND region IN ('ASIA', 'EUROPE') "
        "AND publisher_tier = 'tier_1'"
    ),
)
def filter_scope(spark, sf):
    filters = {
        "app_category": "Brand#1*",
        "region": ["ASIA", "EUROPE"],
        "publisher_tier": "tier_1",
    }
    return _masked(spark, sf, masks.scope(filters, "fill_rate"))


_BASE = B.baseline_days(FROM, TO, A.EPOCH)


@query("filter_window", _sums_sql(f"({WINDOW} OR event_date IN {S.days(_BASE)})"))
def filter_window(spark, sf):
    where = B.in_window(FROM, TO) | B.in_days(_BASE)
    return rounded(folded(spark, sf).grouped(["event_date"], where=where), revenue=4)


def _refused(metric: str, dim: str) -> bool:
    try:
        check_dimension(metric, dim)
    except QueryError:
        return True
    return False


@query(
    "guard_filled_only",
    f"WITH {S.enriched()} "
    + " UNION ALL ".join(
        f"""SELECT '{d}' AS dimension, count(*) FILTER (WHERE is_filled = 0)::BIGINT AS unfilled,
       count(*) FILTER (WHERE is_filled = 0 AND {d} = '')::BIGINT AS empty_on_unfilled,
       count(*) FILTER (WHERE is_filled = 1 AND {d} = '')::BIGINT AS empty_on_filled,
       '{','.join(m for m in METRICS if m in ('requests', 'fill_rate'))}' AS refused_for
FROM enriched"""
        for d in FILLED_ONLY_DIMENSIONS
    ),
)
def guard_filled_only(spark, sf):
    """Why three dimensions are refused for two metrics: they are empty on every unfilled row."""
    rows = folded(spark, sf).rows(FILLED_ONLY_DIMENSIONS)
    unfilled = F.col("is_filled") == 0
    counts = rows.agg(
        F.count_if(unfilled).alias("unfilled"),
        *(
            c
            for d in FILLED_ONLY_DIMENSIONS
            for c in (
                F.count_if(unfilled & (F.col(d) == "")).alias(f"{d}_off"),
                F.count_if(~unfilled & (F.col(d) == "")).alias(f"{d}_on"),
            )
        ),
    )
    out = F.array(
        *(
            F.struct(
                F.lit(d).alias("dimension"),
                F.col("unfilled"),
                F.col(f"{d}_off").alias("empty_on_unfilled"),
                F.col(f"{d}_on").alias("empty_on_filled"),
                F.lit(",".join(m for m in METRICS if _refused(m, d))).alias("refused_for"),
            )
            for d in FILLED_ONLY_DIMENSIONS
        )
    )
    return counts.select(F.explode(out).alias("r")).select("r.*")


@query(
    "guard_window",
    f"""WITH {S.fact()}
SELECT event_date, count(*)::BIGINT AS events FROM fact
WHERE event_date BETWEEN (SELECT max(event_date) - 6 FROM fact) AND (SELECT max(event_date) FROM fact)
GROUP BY 1""",
)
def guard_window(spark, sf):
    """A checked window: the last seven days of the data."""
    source = folded(spark, sf)
    data = B.bounds_of(source.rows(()))
    window = B.check_window(data[1] - dt.timedelta(days=6), data[1], data, max_days=35)
    return source.grouped(["event_date"], where=B.in_window(*window)).select(
        "event_date", "events"
    )


# -- metrics and aggregations -------------------------------------------------------------------

# Money per count is rounded where a quotient of exact cents cannot fall on a rounding boundary.
_DIGITS = {m: {"revenue": 4, "rpr": 2, "ecpm": -2}.get(m, 6) for m in METRICS}


def _metric_columns():
    return [rnd(METRICS[m].value(), _DIGITS[m]).alias(m) for m in METRICS]


_METRIC_SQL = ", ".join(f"{S.r(S.value(m), _DIGITS[m])} AS {m}" for m in METRICS)


@query(
    "metric_all",
    f"""WITH {S.fact()}, g AS (SELECT event_date, ad_format, {S.SUMS} FROM fact GROUP BY 1, 2)
SELECT event_date, ad_format, {_METRIC_SQL} FROM g""",
)
def metric_all(spark, sf):
    grouped = folded(spark, sf).grouped(["event_date", "ad_format"], ["ad_format"])
    return grouped.select("event_date", "ad_format", *_metric_columns())


@query(
    "agg_reliability",
    f"""WITH {S.enriched()}, g AS (SELECT country, {S.SUMS} FROM enriched WHERE {WINDOW} GROUP BY 1)
SELECT country, {S.r(S.value("ctr"))} AS value, clicks < 30 AS thin, NOT (clicks < 30) AS reliable
FROM g""",
)
def agg_reliability(spark, sf):
    rows = Q.measure(folded(spark, sf), "ctr", FROM, TO, group_by=["country"], limit=200)
    return rows.select(
        "country", rnd("value").alias("value"), (F.col("note") != "").alias("thin"), "reliable"
    )


@query(
    "agg_floor_having",
    f"""WITH {S.enriched()},
g AS (SELECT country, ad_format, {S.SUMS} FROM enriched GROUP BY 1, 2)
SELECT country, ad_format, events, {S.r(S.value("render_rate"))} AS value
FROM g WHERE events >= 150 AND {S.value("render_rate")} IS NOT NULL AND impressions >= 50""",
)
def agg_floor_having(spark, sf):
    m = METRICS["render_rate"]
    grouped = folded(spark, sf).grouped(["country", "ad_format"], ["country", "ad_format"])
    return grouped.filter(m.floors(150)).select(
        "country", "ad_format", "events", rnd(m.value()).alias("value")
    )


@query(
    "agg_conditional",
    f"""WITH {S.enriched()}
SELECT region, count(*) FILTER (WHERE {WINDOW})::BIGINT AS inc_events,
       count(*) FILTER (WHERE event_date IN {S.days(_BASE)})::BIGINT AS base_events,
       coalesce(sum(is_filled) FILTER (WHERE {WINDOW}), 0)::BIGINT AS inc_fills,
       coalesce(sum(is_filled) FILTER (WHERE event_date IN {S.days(_BASE)}), 0)::BIGINT AS base_fills,
       {S.r(f"coalesce(sum(revenue) FILTER (WHERE {WINDOW}), 0)", 4)} AS inc_revenue
FROM enriched GROUP BY 1""",
)
def agg_conditional(spark, sf):
    inc, base = B.in_window(FROM, TO), B.in_days(_BASE)
    rows = folded(spark, sf).rows(["region"])
    zero = F.lit(0)
    return rows.groupBy("region").agg(
        F.count_if(inc).alias("inc_events"),
        F.count_if(base).alias("base_events"),
        F.coalesce(F.sum(F.when(inc, F.col("is_filled"))), zero).alias("inc_fills"),
        F.coalesce(F.sum(F.when(base, F.col("is_filled"))), zero).alias("base_fills"),
        rnd(F.coalesce(F.sum(F.when(inc, F.col("revenue"))), F.lit(0.0)), 4).alias("inc_revenue"),
    )


@query(
    "agg_distinct_if",
    f"""WITH {S.fact()},
d AS (SELECT event_date, count(DISTINCT advertiser_id) FILTER (WHERE advertiser_id <> '') AS n
      FROM fact GROUP BY 1)
SELECT (SELECT count(DISTINCT advertiser_id) FROM fact WHERE advertiser_id <> '')::BIGINT AS pooled,
       median(n) FILTER (WHERE {WINDOW}) AS inc_median,
       median(n) FILTER (WHERE event_date IN {S.days(_BASE)}) AS base_median FROM d""",
)
def agg_distinct_if(spark, sf):
    fact = folded(spark, sf).rows(())
    # one row per (day, advertiser) first: both distinct counts are then plain counts
    seen = fact.filter("advertiser_id <> ''").select("event_date", "advertiser_id").distinct()
    daily = seen.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
    inc, base = B.in_window(FROM, TO), B.in_days(_BASE)
    pooled = seen.select("advertiser_id").distinct().agg(F.count(F.lit(1)).alias("pooled"))
    medians = daily.agg(
        F.median(F.when(inc, F.col("n"))).alias("inc_median"),
        F.median(F.when(base, F.col("n"))).alias("base_median"),
    )
    return medians.withColumn("pooled", pooled.scalar())


def _day_lists(column: str) -> str:
    return f"""WITH {S.enriched()},
d AS (SELECT region, event_date, {S.SUMS} FROM enriched GROUP BY 1, 2),
l AS (SELECT region, list({column}) AS xs FROM d GROUP BY 1)"""


def _lists(spark, sf, column: str):
    daily = folded(spark, sf).grouped(["region", "event_date"], ["region"])
    return daily.groupBy("region").agg(F.collect_list(column).alias("xs"))


@query(
    "agg_median_exact",
    f"{_day_lists('events')} SELECT region, {S.upper_median('xs')}::BIGINT AS middle FROM l",
)
def agg_median_exact(spark, sf):
    return _lists(spark, sf, "events").select(
        "region", stats.upper_median_of(F.col("xs")).alias("middle")
    )


@query(
    "agg_median_interp",
    f"""WITH {S.enriched()},
d AS (SELECT region, event_hour, {S.SUMS} FROM enriched GROUP BY 1, 2)
SELECT region, {S.r("median(revenue)", 2)} AS middle FROM d GROUP BY 1""",
)
def agg_median_interp(spark, sf):
    """Hours of whole days, an even count: the mean of the two middles."""
    hourly = folded(spark, sf).grouped(["region", "event_hour"], ["region"])
    lists = hourly.groupBy("region").agg(F.collect_list("revenue").alias("xs"))
    return lists.select("region", rnd(stats.median_of(F.col("xs")), 2).alias("middle"))


@query(
    "agg_mad",
    f"""{_day_lists('events')}, c AS (SELECT *, {S.median('xs')} AS centre FROM l),
m AS (SELECT *, {S.median('list_transform(xs, lambda x: abs(x - centre))')} * 1.4826 AS mad FROM c)
SELECT region, {S.r('centre')} AS centre, {S.r('greatest(mad, abs(centre) * 0.005)')} AS spread,
       mad < abs(centre) * 0.005 AS floored FROM m""",
)
def agg_mad(spark, sf):
    centred = _lists(spark, sf, "events").withColumn("centre", stats.median_of(F.col("xs")))
    described = centred.withColumn("mad", stats.mad_of(F.col("xs"), F.col("centre")))
    floor = stats.spread_floor(F.col("centre"))
    return described.select(
        "region",
        rnd("centre").alias("centre"),
        rnd(F.greatest("mad", floor)).alias("spread"),
        (F.col("mad") < floor).alias("floored"),
    )


@query(
    "agg_share",
    f"""WITH {S.enriched()}, g AS (SELECT os_version, count(*)::BIGINT AS requests
  FROM enriched WHERE region = 'ASIA' GROUP BY 1)
SELECT os_version, requests, {S.r("requests * 100.0 / sum(requests) OVER ()")} AS share_pct FROM g""",
)
def agg_share(spark, sf):
    mask = masks.segment_mask("region", "ASIA")
    grouped = folded(spark, sf).grouped(["os_version"], ["os_version"], mask)
    rows = grouped.select("os_version", F.col("events").alias("requests"))
    return rounded(Q.with_share(rows), share_pct=6)


@query(
    "agg_quantiles",
    f"""SELECT event_type, {S.r("quantile_cont(value, 0.5)")} AS p50,
       {S.r("quantile_cont(value, 0.95)")} AS p95 FROM events GROUP BY 1""",
)
def agg_quantiles(spark, sf):
    rows = A.table(spark, sf, "events")
    return rounded(quantiles(rows, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}), p50=6, p95=6)


_CELL_SUMMARY = f"""SELECT dim, count(*)::BIGINT AS n_cells, sum(events)::BIGINT AS events,
       sum(fills)::BIGINT AS fills, sum(impressions)::BIGINT AS impressions,
       sum(clicks)::BIGINT AS clicks, sum(events * events)::BIGINT AS squares,
       {S.r("sum(revenue)", 4)} AS revenue FROM cells GROUP BY 1"""


def cell_summary(cells, *by: str):
    """Per cut: cells, sums, and the sum of squares, which moves if any cell does."""
    return cells.groupBy(*by, "dim").agg(
        F.count(F.lit(1)).alias("n_cells"),
        *(F.sum(c).alias(c) for c in ("events", "fills", "impressions", "clicks")),
        F.sum(F.col("events") * F.col("events")).alias("squares"),
        rnd(F.sum("revenue"), 4).alias("revenue"),
    )


@query("agg_fan_out", f"WITH {S.enriched()}, {S.cells(sweep_cuts())} {_CELL_SUMMARY}")
def agg_fan_out(spark, sf):
    return cell_summary(folded(spark, sf).cells(sweep_cuts()))


@query("agg_grouping_sets", f"WITH {S.enriched()}, {S.cells(sweep_cuts())} {_CELL_SUMMARY}")
def agg_grouping_sets(spark, sf):
    return cell_summary(R.grouping_sets_cells(folded(spark, sf).rows(), sweep_cuts()))


# -- typed questions ----------------------------------------------------------------------------


@query(
    "q_measure",
    f"""WITH {S.enriched()},
g AS (SELECT region, device_model, {S.SUMS} FROM enriched WHERE {WINDOW}
      AND starts_with(app_category, 'Brand#1') GROUP BY 1, 2)
SELECT region, device_model, {S.r(S.value("fill_rate"))} AS value, events AS requests,
       fills::DOUBLE AS numerator, events::DOUBLE AS denominator,
       {S.r("events * 100.0 / sum(events) OVER ()")} AS share_pct, NOT (fills < 50) AS reliable
FROM g ORDER BY requests DESC, region, device_model LIMIT 26""",
)
def q_measure(spark, sf):
    rows = Q.measure(
        folded(spark, sf), "fill_rate", FROM, TO,
        filters={"app_category": "Brand#1*"}, group_by=["region", "device_model"],
    )
    return rounded(rows, value=6, share_pct=6).drop("note")


@query(
    "q_measure_hourly",
    f"""WITH {S.enriched()},
g AS (SELECT event_hour, {S.SUMS} FROM enriched WHERE {WINDOW} GROUP BY 1)
SELECT event_hour, {S.r(S.value("rpr"), 2)} AS value, events AS requests,
       {S.r("events * 100.0 / (SELECT sum(events) FROM g)")} AS share_pct, NOT (events < 500) AS reliable
FROM g ORDER BY event_hour LIMIT 201""",
)
def q_measure_hourly(spark, sf):
    rows = Q.measure(folded(spark, sf), "rpr", FROM, TO, granularity="hour", limit=200)
    return rounded(rows, value=2, share_pct=6).drop("note", "numerator", "denominator")


def _compare_sql(metric: str, by: str, base, digits: int) -> str:
    m = METRICS[metric]
    lists = ", ".join(
        f"list({x}) FILTER (WHERE {side}) AS {name}"
        for name, x, side in (
            ("cn", S.num(metric), WINDOW),
            ("cd", S.den(metric), WINDOW),
            ("bn", S.num(metric), f"event_date IN {S.days(base)}"),
            ("bd", S.den(metric), f"event_date IN {S.days(base)}"),
        )
    )

    def side(n: str, d: str) -> str:
        if not m.is_ratio:
            return S.upper_median(n)
        out = f"{S.upper_median(n)} / nullif({S.upper_median(d)}, 0)"
        return out if m.scale == 1 else f"{out} * {m.scale}"

    pp = S.r("(cur - base) * 100", digits) if m.is_ratio else "CAST(NULL AS DOUBLE)"
    return f"""WITH {S.enriched()},
d AS (SELECT {by}, event_date, {S.SUMS} FROM enriched
      WHERE {WINDOW} OR event_date IN {S.days(base)} GROUP BY 1, 2),
s AS (SELECT {by}, {lists}, coalesce(sum(events) FILTER (WHERE {WINDOW}), 0)::BIGINT AS requests
      FROM d GROUP BY 1),
v AS (SELECT {by}, {side("cn", "cd")} AS cur, {side("bn", "bd")} AS base, requests
      FROM s WHERE requests > 0)
SELECT {by}, {S.r("cur", digits)} AS "current", {S.r("base", digits)} AS baseline, requests,
       {S.r("(cur - base) / nullif(base, 0) * 100", 4)} AS delta_pct, {pp} AS delta_pp,
       {S.r("requests * 100.0 / sum(requests) OVER ()")} AS share_pct
FROM v ORDER BY abs(cur - base) * requests DESC NULLS LAST, {by} LIMIT 26"""


def _compare(rows, by: str, digits: int):
    out = rounded(rows, current=digits, baseline=digits, delta_pct=4, delta_pp=digits, share_pct=6)
    return out.select(
        by, "current", "baseline", "requests", "delta_pct", "delta_pp", "share_pct"
    )


@query("q_compare", _compare_sql("fill_rate", "os_version", _BASE, 6))
def q_compare(spark, sf):
    rows = Q.compare(
        folded(spark, sf), "fill_rate", FROM, TO, group_by=["os_version"], data_start=A.EPOCH
    )
    return _compare(rows, "os_version", 6)


_EXPLICIT = B.days_between("2026-06-01", "2026-06-14")


@query("q_compare_explicit", _compare_sql("revenue", "region", _EXPLICIT, 4))
def q_compare_explicit(spark, sf):
    rows = Q.compare(
        folded(spark, sf), "revenue", FROM, TO,
        baseline=("2026-06-01", "2026-06-14"), group_by=["region"],
    )
    return _compare(rows, "region", 4)


@query(
    "q_rank",
    f"""WITH {S.enriched()},
g AS (SELECT country, {S.SUMS} FROM enriched WHERE {WINDOW} GROUP BY 1)
SELECT country, {S.r(S.value("render_rate"))} AS value, events AS requests,
       {S.r("events * 100.0 / sum(events) OVER ()")} AS share_pct
FROM g WHERE events >= 150 AND {S.value("render_rate")} IS NOT NULL AND impressions >= 50
ORDER BY {S.value("render_rate")}, country LIMIT 26""",
)
def q_rank(spark, sf):
    rows = Q.rank(folded(spark, sf), "render_rate", "country", FROM, TO)
    return rounded(rows, value=6, share_pct=6).drop("numerator", "denominator")


@query(
    "q_dimension_values",
    f"""WITH {S.fact()}, g AS (SELECT app_id AS value, count(*)::BIGINT AS requests FROM fact
  WHERE event_date BETWEEN DATE '2026-06-01' AND DATE '2026-07-05' GROUP BY 1)
SELECT value, requests, {S.r("requests * 100.0 / sum(requests) OVER ()")} AS share_pct
FROM g ORDER BY requests DESC, value LIMIT 31""",
)
def q_dimension_values(spark, sf):
    rows = Q.dimension_values(folded(spark, sf), "app_id", "revenue", A.EPOCH, "2026-07-05")
    return rounded(rows, share_pct=6)


_SERIES = f"""WITH {S.fact()}, daily AS (SELECT event_date AS d, {S.SUMS} FROM fact GROUP BY 1),
series AS MATERIALIZED ({S.stacked(list(METRICS), "daily", "d")})"""


@query("q_daily_series", f"{_SERIES} SELECT metric, d, {S.by_metric('v')} AS v FROM series")
def q_daily_series(spark, sf):
    series = Q.daily_series(folded(spark, sf))
    return series.withColumn("v", by_metric("v"))


@query(
    "q_weekly_growth",
    f"{_SERIES}, {S.growth('series')} SELECT metric, {S.r('growth')} AS growth FROM growth",
)
def q_weekly_growth(spark, sf):
    return rounded(Q.growth_per_metric(Q.daily_series(folded(spark, sf))), growth=6)
