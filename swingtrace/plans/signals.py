"""Telemetry tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from swingtrace.operators import telemetry as M
from swingtrace.plans import sqltext as S
from swingtrace.plans.registry import query, rounded
from swingtrace.schema import LOG_ATTRIBUTE_PREFIX, LOG_ATTRIBUTES, LOG_COLUMNS, TRACE_COLUMNS
from swingtrace.sources import telemetry_views as V

_NAMES = """CASE event_type WHEN 'view' THEN 'stage.detect' WHEN 'click' THEN 'stage.localize'
  WHEN 'purchase' THEN 'tool.measure' WHEN 'signup' THEN 'investigation' ELSE 'stage.classify' END"""
EVENTS = f"""
ev AS (SELECT ts, event_id, user_id, event_type, value, props,
         coalesce((props->>'$.k')::BIGINT, 0) AS k, {_NAMES} AS span,
         CASE WHEN user_id % 2 = 0 THEN '{V.SERVICES[0]}' ELSE '{V.SERVICES[1]}' END AS service,
         user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace FROM events)"""
_ROOTS = """roots AS (SELECT trace, arg_min(event_id, (ts, event_id)) AS root FROM ev GROUP BY 1),
spans AS (SELECT ev.*, root FROM ev JOIN roots USING (trace))"""
LOGS = f"""
logs AS (SELECT ts, CASE WHEN event_type = 'view' THEN '' ELSE trace END AS "TraceId",
   CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS "SeverityText",
   service AS "ServiceName", span AS "ScopeName", '1.' || (k % 3) AS "ScopeVersion",
   '' AS "ResourceSchemaUrl", '' AS "ScopeSchemaUrl", 'pod-' || (k % 4) AS pod,
   CASE WHEN user_id % 5 = 0 THEN 'staging' ELSE 'production' END AS env FROM ev)"""


@query(
    "t_signal_counts",
    f"""WITH {EVENTS}, s AS (SELECT * FROM ev WHERE service = '{V.SERVICES[0]}')
SELECT 'traces' AS signal, count(*)::BIGINT AS n_rows, max(ts) AS latest FROM s
UNION ALL SELECT 'logs', count(*), max(ts) FROM s
UNION ALL SELECT 'metrics.sum', count(*), max(ts) FROM s WHERE event_type = 'purchase'
UNION ALL SELECT 'metrics.histogram', count(*), max(ts) FROM s WHERE event_type IN ('click', 'error')""",
)
def t_signal_counts(spark, sf):
    sums, histograms = V.metric_points(spark, sf)
    return M.signal_counts(
        {
            "traces": (V.traces(spark, sf), "Timestamp"),
            "logs": (V.logs(spark, sf), "Timestamp"),
            "metrics.sum": (sums, "TimeUnix"),
            "metrics.histogram": (histograms, "TimeUnix"),
        },
        V.SERVICES[0],
    )


@query(
    "t_log_correlation",
    f"""WITH {EVENTS}, {LOGS}
SELECT count(*)::BIGINT AS logs, count(*) FILTER (WHERE "TraceId" <> '')::BIGINT AS correlated,
       count(DISTINCT "TraceId") FILTER (WHERE "TraceId" <> '')::BIGINT AS traces FROM logs""",
)
def t_log_correlation(spark, sf):
    return M.log_correlation(V.logs(spark, sf))


@query(
    "t_latest_trace",
    f"""WITH {EVENTS}, {_ROOTS},
newest AS (SELECT trace FROM spans GROUP BY 1 ORDER BY count(*) > 1 DESC, max(ts) DESC, trace LIMIT 1)
SELECT trace AS trace_id, ts AS "at", event_id::VARCHAR AS span_id, span,
       CASE WHEN event_id = root THEN 0 ELSE 1 END::INTEGER AS nested, {S.r("value", 1)} AS ms
FROM spans JOIN newest USING (trace)""",
)
def t_latest_trace(spark, sf):
    return rounded(M.latest_trace(V.traces(spark, sf)), ms=1)


@query(
    "t_trace_roots",
    f"""WITH {EVENTS}, {_ROOTS}
SELECT trace AS trace_id, count(*)::BIGINT AS spans, count(*) FILTER (WHERE event_id = root)::BIGINT AS roots,
       TRUE AS ok FROM spans GROUP BY 1""",
)
def t_trace_roots(spark, sf):
    return M.trace_roots(V.traces(spark, sf)).withColumnRenamed("TraceId", "trace_id")


@query(
    "t_published_metrics",
    """SELECT 'app.' || event_type AS metric, count(*)::BIGINT AS points, max(ts) AS latest
FROM events WHERE event_type IN ('purchase', 'click', 'error') GROUP BY 1""",
)
def t_published_metrics(spark, sf):
    return M.published_metrics(V.metric_points(spark, sf))


@query(
    "t_span_health",
    f"""WITH {EVENTS}, w AS (SELECT * FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 24 HOUR)
SELECT span AS span_name, count(*)::BIGINT AS calls,
       {S.r("quantile_cont(round(value * 1e6), 0.5) / 1e6", 1)} AS p50_ms,
       {S.r("quantile_cont(round(value * 1e6), 0.95) / 1e6", 1)} AS p95_ms,
       count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors
FROM w GROUP BY 1 ORDER BY calls DESC, span_name LIMIT 30""",
)
def t_span_health(spark, sf):
    spans = V.traces(spark, sf)
    now = V.events(spark, sf).agg(F.max("Timestamp")).scalar()
    return rounded(M.span_health(spans, now, V.SPAN_PREFIXES), p50_ms=1, p95_ms=1)


_QUERY_LOG = f"""{EVENTS},
ql AS (SELECT 'c' || (user_id % 8) AS call_id, regexp_extract(span, '([a-z]+)$', 1) AS stage,
         round(value)::BIGINT AS ms, k * 1000 AS rr, k * 64000 AS rb, k * 4096 AS mem,
         event_id % 2 = 0 AS on_rollup FROM ev WHERE event_type <> 'error')"""


@query(
    "t_query_cost",
    f"""WITH {_QUERY_LOG}
SELECT call_id, stage, count(*)::BIGINT AS queries, sum(ms)::BIGINT AS server_ms,
       sum(rr)::BIGINT AS read_rows, sum(rb)::BIGINT AS read_bytes, max(mem)::BIGINT AS peak
FROM ql GROUP BY 1, 2""",
)
def t_query_cost(spark, sf):
    return M.query_cost(V.query_log(spark, sf))


_SIDE = """SELECT call_id, count(*)::BIGINT AS q, sum(ms)::BIGINT AS ms, sum(rr)::BIGINT AS rr,
  sum(rb)::BIGINT AS rb, max(mem)::BIGINT AS mem FROM ql WHERE {} GROUP BY 1"""


@query(
    "t_cost_delta",
    f"""WITH {_QUERY_LOG}, a AS ({_SIDE.format("NOT on_rollup")}), b AS ({_SIDE.format("on_rollup")}),
j AS (SELECT call_id, coalesce(a.q, 0) AS queries_raw, coalesce(a.ms, 0) AS server_ms_raw,
  coalesce(a.rr, 0) AS read_rows_raw, coalesce(a.rb, 0) AS read_bytes_raw, coalesce(a.mem, 0) AS peak_raw,
  coalesce(b.q, 0) AS queries_rollup, coalesce(b.ms, 0) AS server_ms_rollup,
  coalesce(b.rr, 0) AS read_rows_rollup, coalesce(b.rb, 0) AS read_bytes_rollup,
  coalesce(b.mem, 0) AS peak_rollup FROM a FULL JOIN b USING (call_id)),
u AS (SELECT * FROM j UNION ALL SELECT 'total', sum(queries_raw)::BIGINT, sum(server_ms_raw)::BIGINT,
  sum(read_rows_raw)::BIGINT, sum(read_bytes_raw)::BIGINT, max(peak_raw), sum(queries_rollup)::BIGINT,
  sum(server_ms_rollup)::BIGINT, sum(read_rows_rollup)::BIGINT, sum(read_bytes_rollup)::BIGINT,
  max(peak_rollup) FROM j)
SELECT *, {S.r("read_rows_raw::DOUBLE / nullif(read_rows_rollup, 0)")} AS read_rows_ratio FROM u""",
)
def t_cost_delta(spark, sf):
    """The same calls served by events and by rollups: the even half of the log is the rollup run."""
    log = V.query_log(spark, sf)
    raw, rollup = (M.query_cost(log.filter(c)) for c in (~F.col("on_rollup"), F.col("on_rollup")))
    return rounded(M.cost_delta(raw, rollup), read_rows_ratio=6)


def kv_sql(columns, src: str, where: str = "TRUE") -> str:
    """15-minute counts; ``columns`` maps the key to the expression of its value."""
    parts = " UNION ALL ".join(
        f"SELECT ts, '{k}' AS key, ({x})::VARCHAR AS value FROM {src}" for k, x in columns.items()
    )
    return f"""kv AS ({parts})
SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS "Timestamp", 'NativeColumn' AS "ColumnIdentifier",
       key AS "Key", value AS "Value", count(*)::BIGINT AS "count" FROM kv WHERE {where} GROUP BY ALL"""


LOG_KV = {c: f'"{c}"' for c in LOG_COLUMNS} | {
    LOG_ATTRIBUTE_PREFIX + a: {
        "k8s.pod.name": "pod", "deployment.environment.name": "env",
    }.get(a, "''")
    for a in LOG_ATTRIBUTES
}
_TRACE_KV = {
    "ServiceName": "service", "SpanName": "span",
    "SpanKind": "CASE WHEN event_type = 'error' THEN 'Client' ELSE 'Internal' END",
    "StatusCode": "CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Ok' END",
    "ScopeName": "'swing'", "ScopeVersion": "'1.' || (k % 3)",
}
assert tuple(sorted(_TRACE_KV)) == tuple(sorted(TRACE_COLUMNS))


@query("t_kv_rollup_15m", f"WITH {EVENTS}, {LOGS}, {kv_sql(LOG_KV, 'logs')}")
def t_kv_rollup_15m(spark, sf):
    return M.kv_rollup_15m(V.logs(spark, sf), "logs")


@query("t_kv_rollup_15m_traces", f"WITH {EVENTS}, {kv_sql(_TRACE_KV, 'ev')}")
def t_kv_rollup_15m_traces(spark, sf):
    return M.kv_rollup_15m(V.traces(spark, sf), "traces")


@query(
    "t_attr_items",
    f"""WITH {EVENTS}, {LOGS}
SELECT pod AS pod_name, array_to_string(list_sort(['k8s.pod.name=' || pod,
       'deployment.environment.name=' || env]), ',') AS items, count(*)::BIGINT AS n
FROM logs GROUP BY 1, 2""",
)
def t_attr_items(spark, sf):
    rows = V.logs(spark, sf).select(
        F.col("ResourceAttributes")["k8s.pod.name"].alias("pod_name"),
        F.array_join(F.array_sort(M.attr_items("ResourceAttributes")), ",").alias("items"),
    )
    return rows.groupBy("pod_name", "items").agg(F.count(F.lit(1)).alias("n"))


SESSIONS = """
pr AS (SELECT user_id % 16 AS session, event_id AS prompt_id, ts AS t,
         ts + to_seconds(floor(value)::INTEGER) AS ends FROM events WHERE event_type = 'signup'),
st AS (SELECT user_id % 16 AS session, event_id AS step_id, ts AS t FROM events
       WHERE event_type <> 'signup')"""


@query(
    "t_step_attribution",
    f"""WITH {SESSIONS},
p AS (SELECT *, lag(ends) OVER (PARTITION BY session ORDER BY t, prompt_id) AS lo FROM pr),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= INTERVAL 3 MINUTE THEN 0 ELSE 1 END AS opens
      FROM st WINDOW w AS (PARTITION BY session ORDER BY t, step_id)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY session ORDER BY t, step_id) AS run FROM g),
rs AS (SELECT session, run, min(t) AS run_start FROM r GROUP BY 1, 2),
l AS (SELECT p.session, p.prompt_id, p.lo, p.ends, max(r.t) AS last_t, arg_max(r.run, (r.t, r.step_id)) AS run
      FROM p JOIN r ON r.session = p.session AND r.t <= p.ends GROUP BY 1, 2, 3, 4),
x AS (SELECT l.*, greatest(run_start, coalesce(lo, run_start)) AS low FROM l JOIN rs USING (session, run))
SELECT x.session, x.prompt_id, r.step_id, r.t AS "at"
FROM x JOIN r ON r.session = x.session AND r.t BETWEEN x.low AND x.last_t""",
)
def t_step_attribution(spark, sf):
    return M.attribute_steps(*V.prompts_and_steps(spark, sf))


@query(
    "t_generation_cost",
    f"""WITH u AS (SELECT 'model_' || (user_id % 3) AS model, round(value)::BIGINT AS tokens,
  CASE event_type WHEN 'view' THEN 0.14 WHEN 'signup' THEN 0.14 WHEN 'click' THEN 0.0028 ELSE 0.28 END::DOUBLE
    / 1e6::DOUBLE AS price FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR)
SELECT model, {S.r("sum(tokens * price)")} AS total_cost, sum(tokens)::BIGINT AS total_tokens,
       count(*)::BIGINT AS generations FROM u GROUP BY 1""",
)
def t_generation_cost(spark, sf):
    usage, prices = V.usage(spark, sf)
    now = usage.agg(F.max("at")).scalar()
    return rounded(M.generation_cost(usage, prices, now), total_cost=6)
