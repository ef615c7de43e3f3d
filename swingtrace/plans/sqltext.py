"""SQL fragments for the checking queries (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Sequence

from swingtrace.config import T, Cut, cut_key, sweep_cuts
from swingtrace.functions.metrics import METRICS
from swingtrace.sources import adapter as A


def r(x: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(round({x}, {digits}) + 0.0)"


def by_metric(x: str) -> str:
    """A metric's value, rounded to what its unit can carry."""
    return (
        f"CASE metric WHEN 'ecpm' THEN {r(x, -2)} WHEN 'rpr' THEN {r(x, 2)} ELSE {r(x, 4)} END"
    )


def _events(fold: int) -> str:
    return f"""
    SELECT CAST((CAST(l_shipdate AS DATE) - DATE '{A.FIRST_SHIP_DATE}') % {fold} AS INTEGER) AS off,
           CAST(l_orderkey % 24 AS INTEGER) AS hr,
           'app_' || l_partkey AS app_id,
           'g' || o_custkey || '_' || (l_orderkey % 8) AS geo_device_id,
           CASE WHEN l_returnflag <> 'R' THEN 'adv_' || l_suppkey ELSE '' END AS advertiser_id,
           coalesce(o_orderpriority, '') AS ad_format,
           CAST(l_returnflag <> 'R' AS INTEGER) AS is_filled,
           CAST(l_returnflag <> 'R' AND l_linestatus = 'O' AS INTEGER) AS is_impression,
           CAST(l_returnflag <> 'R' AND l_linestatus = 'O' AND l_discount >= 0.085 AS INTEGER)
             AS is_click,
           CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'O'
                THEN l_extendedprice * (1.0::DOUBLE - l_discount) ELSE 0.0::DOUBLE END AS revenue
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"""


def _dims() -> str:
    return """
apps AS (
  SELECT 'app_' || p_partkey AS app_id, p_brand AS app_category,
         CASE WHEN p_size <= 17 THEN 'tier_1' WHEN p_size <= 34 THEN 'tier_2' ELSE 'tier_3' END
           AS publisher_tier
  FROM part),
advertisers AS (
  SELECT 'adv_' || s_suppkey AS advertiser_id, n_name AS advertiser_vertical,
         'camp_' || (s_suppkey % 3) AS campaign_type
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
geo_device AS (
  SELECT 'g' || c_custkey || '_' || os AS geo_device_id, r_name AS region, n_name AS country,
         c_mktsegment AS device_model, 'os_' || os AS os_version
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN region ON n_regionkey = r_regionkey, range(8) t(os))"""


ATTRIBUTES = (
    "app_category",
    "publisher_tier",
    "advertiser_vertical",
    "campaign_type",
    "region",
    "country",
    "device_model",
    "os_version",
)


def fact() -> str:
    """``WITH`` list up to ``fact``: the nine event columns on the folded calendar."""
    return f"""
base AS ({_events(A.FOLD_DAYS)}),
fact AS (
  SELECT CAST(DATE '{A.EPOCH}' + off AS TIMESTAMP) + to_hours(hr) AS event_time, app_id,
         geo_device_id, advertiser_id, ad_format, is_filled, is_impression, is_click, revenue,
         DATE '{A.EPOCH}' + off AS event_date
  FROM base)"""


def _join(src: str, extra: str = "") -> str:
    attrs = ", ".join(f"coalesce({a}, '') AS {a}" for a in ATTRIBUTES)
    return f"""
  SELECT f.*, date_trunc('hour', f.event_time) AS event_hour,
         CAST(isodow(f.event_date) AS INTEGER) AS day_of_week,
         CAST(hour(f.event_time) AS INTEGER) AS hour_of_day, {attrs}{extra}
  FROM {src} f LEFT JOIN apps USING (app_id) LEFT JOIN advertisers USING (advertiser_id)
       LEFT JOIN geo_device USING (geo_device_id)"""


def enriched() -> str:
    return f"""{fact()},{_dims()},
enriched AS MATERIALIZED ({_join("fact")})"""


def panel(kind: str) -> str:
    """The five-week panel with one plant, as ``enriched``."""
    dim, val = A.PLANT_SEGMENT
    hit = f"event_date = DATE '{A.PLANT_DAY}' AND {dim} = '{val}' AND cp = 1"
    gone = {
        "uniform": f"WHERE NOT (event_date = DATE '{A.UNIFORM_DAY}' AND cp = 1)",
        "supply": f"WHERE NOT ({hit})",
    }.get(kind, "")
    replaced = ""
    if kind == "break":
        zero = ", ".join(
            f"CASE WHEN {hit} THEN 0 ELSE {c} END AS {c}"
            for c in ("is_filled", "is_impression", "is_click")
        )
        blank = ", ".join(
            f"CASE WHEN {hit} THEN '' ELSE {c} END AS {c}"
            for c in ("advertiser_id", "advertiser_vertical", "campaign_type")
        )
        money = f"CASE WHEN {hit} THEN 0.0::DOUBLE ELSE revenue END AS revenue"
        replaced = f" REPLACE ({zero}, {blank}, {money})"
    if kind == "price":
        replaced = (
            f" REPLACE (CASE WHEN {hit} THEN revenue * 0.6::DOUBLE ELSE revenue END AS revenue)"
        )
    return f"""
base AS ({_events(7)}),
fact AS (
  SELECT CAST(DATE '{A.EPOCH}' + CAST(wk * 7 + off AS INTEGER) AS TIMESTAMP) + to_hours(hr)
           AS event_time,
         app_id, geo_device_id, advertiser_id, ad_format, is_filled, is_impression, is_click,
         revenue, DATE '{A.EPOCH}' + CAST(wk * 7 + off AS INTEGER) AS event_date, cp
  FROM base, range(5) w(wk), range(2) c(cp)),{_dims()},
unplanted AS ({_join("fact")}),
enriched AS MATERIALIZED (SELECT *{replaced} FROM unplanted {gone})"""


SUMS = """count(*)::BIGINT AS events, sum(is_filled)::BIGINT AS fills,
         sum(is_impression)::BIGINT AS impressions, sum(is_click)::BIGINT AS clicks,
         sum(revenue) AS revenue"""


def cells(cuts: Sequence[Cut], where: str = "TRUE", name: str = "cells", by="event_date") -> str:
    """Daily cells of some cuts, one fan-out."""
    pairs = ", ".join(
        "{'dim': '%s', 'val': %s}" % (cut_key(c), " || '|' || ".join(c)) for c in cuts
    )
    return f"""
{name} AS MATERIALIZED (
  SELECT {by}, kv.dim AS dim, kv.val AS val, {SUMS}
  FROM (SELECT {by}, is_filled, is_impression, is_click, revenue, unnest([{pairs}]) AS kv
        FROM enriched WHERE {where})
  GROUP BY ALL)"""


def value(metric: str) -> str:
    """A metric over summed measures."""
    m = METRICS[metric]
    if not m.is_ratio:
        return f"CAST({m.numerator} AS DOUBLE)"
    out = f"CAST({m.numerator} AS DOUBLE) / nullif(CAST({m.denominator} AS DOUBLE), 0)"
    return out if m.scale == 1.0 else f"{out} * {m.scale}"


def den(metric: str) -> str:
    m = METRICS[metric]
    return f"CAST({m.denominator} AS DOUBLE)" if m.denominator else "1.0::DOUBLE"


def num(metric: str) -> str:
    return f"CAST({METRICS[metric].numerator} AS DOUBLE)"


def days(dates) -> str:
    return "(" + ", ".join(f"DATE '{d}'" for d in dates) + ")"


def median(xs: str) -> str:
    """Interpolated median of a list expression."""
    return f"list_aggregate({xs}, 'median')"


def upper_median(xs: str) -> str:
    return f"list_sort({xs})[len({xs}) // 2 + 1]"


def stacked(metrics: Sequence[str], src: str, keys: str) -> str:
    """One row per metric: ``keys, metric, v, num, den``."""
    return " UNION ALL ".join(
        f"SELECT {keys}, '{m}' AS metric, {value(m)} AS v, {num(m)} AS num, {den(m)} AS den "
        f"FROM {src}"
        for m in metrics
    )


def growth(series: str, name: str = "growth") -> str:
    """Theil-Sen growth per metric over ``series(metric, d, v)``."""
    return f"""
{name} AS MATERIALIZED (
  WITH pts AS (SELECT metric, (d - DATE '1970-01-01')::DOUBLE AS x, ln(v) AS y
               FROM {series} WHERE v > 0),
       n AS (SELECT metric, count(*) AS n FROM pts GROUP BY 1),
       sl AS (SELECT a.metric, median((b.y - a.y) / (b.x - a.x)) AS s
              FROM pts a JOIN pts b ON a.metric = b.metric AND a.x < b.x GROUP BY 1),
       g AS (SELECT m.metric, coalesce(n.n, 0) AS n, exp(coalesce(s, 0) * 7) - 1 AS raw
             FROM (SELECT DISTINCT metric FROM {series}) m LEFT JOIN n USING (metric)
                  LEFT JOIN sl USING (metric))
  SELECT metric, CASE WHEN n >= {T.growth_min_points} AND abs(raw) <= {T.growth_max_abs}
                      THEN raw ELSE 0.0::DOUBLE END AS growth FROM g)"""


def judged(series: str, keys: str, name: str = "judged") -> str:
    """Same-weekday judgement of ``series(keys, d, v, growth, ...)``."""
    on = " AND ".join(f"b.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    sel = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_prior AS (
  SELECT {sel}, c.d, list(b.v * pow(1 + c.growth, lag)) AS adj
  FROM {series} c CROSS JOIN (VALUES (1), (2), (3), (4)) l(lag)
       JOIN {series} b ON {on} AND b.d = c.d - lag * 7
  GROUP BY ALL HAVING count(*) >= {T.min_baseline_days}),
{name}_centre AS (SELECT *, {median("adj")} AS baseline FROM {name}_prior),
{name} AS MATERIALIZED (
  SELECT c.*, p.baseline,
         greatest({median("list_transform(p.adj, lambda x: abs(x - p.baseline))")} * {T.mad_scale},
                  abs(p.baseline) * {T.spread_floor}) AS spread,
         (c.v - p.baseline) / nullif(p.baseline, 0) * 100 AS pct,
         (c.v - p.baseline) / nullif(spread, 0) AS sigma
  FROM {series} c JOIN {name}_centre p USING ({keys}, d))"""


def segment_series(metrics: Sequence[str], floor: int, src: str = "cells") -> str:
    """Cells that clear the floors, all metrics stacked, as ``seg``."""
    parts = []
    for m in metrics:
        d = METRICS[m]
        keys = ", ".join(f"'{cut_key(c)}'" for c in sweep_cuts(m))
        ok = f"events >= {floor} AND v IS NOT NULL AND dim IN ({keys})"
        if d.min_numerator:
            ok += f" AND num >= {d.min_numerator}"
        if d.min_denominator:
            ok += f" AND den >= {d.min_denominator}"
        parts.append(
            f"SELECT '{m}' AS metric, dim, val, event_date AS d, events AS requests, v FROM "
            f"(SELECT *, {value(m)} AS v, {num(m)} AS num, {den(m)} AS den FROM {src}) WHERE {ok}"
        )
    return "seg0 AS (" + " UNION ALL ".join(parts) + ")"


def firings(metrics: Sequence[str], floor: int) -> str:
    """``firings`` of the folded (or planted) view, from ``enriched``."""
    return f"""{cells(sweep_cuts())},
daily AS (SELECT event_date AS d, {SUMS} FROM enriched GROUP BY 1),
series AS ({stacked(metrics, "daily", "d")}),{growth("series")},
{segment_series(metrics, floor)},
seg AS (SELECT s.*, g.growth FROM seg0 s JOIN growth g USING (metric)),{judged("seg", "metric, dim, val")},
firings AS MATERIALIZED (
  SELECT metric, dim, val, d AS day, v AS actual, baseline, pct, sigma, requests FROM judged
  WHERE abs(pct) >= {T.segment_pct} AND abs(sigma) >= {T.segment_sigma})"""


def incidents() -> str:
    """``incidents`` from ``firings``."""
    return """
runs AS (
  SELECT *, day - CAST(row_number() OVER (PARTITION BY metric, dim, val ORDER BY day) AS INTEGER)
              AS island
  FROM firings),
incidents AS MATERIALIZED (
  SELECT metric, dim, val, min(day) AS "start", max(day) AS "end", count(*)::BIGINT AS days,
         arg_max(pct, (abs(pct), DATE '2100-01-01' - day)) AS worst_pct,
         arg_max(sigma, (abs(pct), DATE '2100-01-01' - day)) AS worst_sigma,
         floor(avg(requests) + 0.5)::BIGINT AS requests_per_day
  FROM runs GROUP BY metric, dim, val, island)"""


def windows() -> str:
    """``windows`` from ``incidents``: the ordered merge as a recursive walk per metric."""
    return f"""
ordered AS MATERIALIZED (
  SELECT *, abs(worst_pct) * days AS severity,
         row_number() OVER (PARTITION BY metric
           ORDER BY "start", abs(worst_pct) * days DESC, dim, val) AS rn
  FROM incidents),
walk AS (
  SELECT metric, rn, "start" AS c_from, "end" AS c_to, 1 AS cluster FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.metric, o.rn,
         CASE WHEN o."start" > w.c_to OR o."end" - w.c_from > {T.window_span_days}
              THEN o."start" ELSE w.c_from END,
         CASE WHEN o."start" > w.c_to OR o."end" - w.c_from > {T.window_span_days}
              THEN o."end" ELSE greatest(o."end", w.c_to) END,
         CASE WHEN o."start" > w.c_to OR o."end" - w.c_from > {T.window_span_days}
              THEN w.cluster + 1 ELSE w.cluster END
  FROM walk w JOIN ordered o ON o.metric = w.metric AND o.rn = w.rn + 1),
placed AS (SELECT o.*, w.cluster FROM ordered o JOIN walk w USING (metric, rn)),
led AS (
  SELECT *, row_number() OVER (PARTITION BY metric, cluster ORDER BY severity DESC, rn) AS lead_rn
  FROM placed),
windows AS MATERIALIZED (
  SELECT p.metric, min(p."start") AS "start", max(p."end") AS "end",
         max(CASE WHEN lead_rn = 1 THEN dim END) AS lead_dim,
         max(CASE WHEN lead_rn = 1 THEN val END) AS lead_val,
         max(CASE WHEN lead_rn = 1 THEN days END) AS days,
         max(CASE WHEN lead_rn = 1 THEN worst_pct END) AS worst_pct,
         max(CASE WHEN lead_rn = 1 THEN worst_sigma END) AS worst_sigma,
         max(CASE WHEN lead_rn = 1 THEN requests_per_day END) AS requests_per_day,
         count(*)::BIGINT AS correlated,
         max(severity) AS severity
  FROM led p GROUP BY p.metric, p.cluster)"""


def candidates(metric: str, q, name: str, src: str, floor: int = T.segment_min_requests) -> str:
    """Segment moves from daily cells ``src``; the total is of the unmasked ``enriched``."""
    m = METRICS[metric]
    inc = f"event_date BETWEEN DATE '{q.start}' AND DATE '{q.end}'"
    base = f"event_date IN {days(q.base)}"
    keys = ", ".join(f"'{cut_key(c)}'" for c in sweep_cuts(metric))
    points = "(inc_value - base_value) * 100" if m.has_points else "CAST(NULL AS DOUBLE)"
    return f"""
{name}_g AS (
  SELECT dim, val, list(v) FILTER (WHERE {base} AND v IS NOT NULL) AS base_days,
         avg(v) FILTER (WHERE {inc}) AS inc_value,
         coalesce(sum(events) FILTER (WHERE {inc}), 0) AS inc_requests
  FROM (SELECT *, {value(metric)} AS v FROM {src} WHERE dim IN ({keys})) GROUP BY 1, 2),
{name}_k AS (
  SELECT dim, val, {median("base_days")} AS base_value, inc_value,
         inc_requests * 1.0::DOUBLE / (SELECT greatest(count(*), 1) FROM enriched WHERE {inc}) * 100
           AS share_pct
  FROM {name}_g WHERE len(base_days) > 0 AND inc_requests >= {floor} AND inc_value IS NOT NULL),
{name} AS MATERIALIZED (
  SELECT dim, val, base_value, inc_value, inc_value - base_value AS delta_abs,
         coalesce((inc_value - base_value) / nullif(base_value, 0) * 100, 0) AS delta_pct,
         {points} AS delta_pp, share_pct,
         abs(inc_value - base_value) * share_pct / 100 AS contribution
  FROM {name}_k)"""


