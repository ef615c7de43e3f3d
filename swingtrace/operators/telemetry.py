"""Analytics over telemetry tables: spans, logs, metrics, query log, prompts and their steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swingtrace.functions.ordered import last_before
from swingtrace.functions.quantiles import quantiles
from swingtrace.schema import (
    LOG_ATTRIBUTE_PREFIX,
    LOG_ATTRIBUTES,
    LOG_COLUMNS,
    TRACE_COLUMNS,
)
from swingtrace.sources.store import materialize

STEP_GAP = "INTERVAL 3 MINUTES"


def signal_counts(signals: dict[str, tuple[DataFrame, str]], service: str) -> DataFrame:
    """Rows and latest time of each signal of one service."""
    parts = [
        df.filter(F.col("ServiceName") == service).agg(
            F.lit(name).alias("signal"),
            F.count(F.lit(1)).alias("n_rows"),
            F.max(time).alias("latest"),
        )
        for name, (df, time) in signals.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def log_correlation(logs: DataFrame) -> DataFrame:
    """Logs, logs that carry a trace, and how many traces they carry."""
    traced = F.col("TraceId") != ""
    # counted per trace first, so the distinct count is a plain count of groups
    per_trace = logs.groupBy("TraceId").agg(F.count(F.lit(1)).alias("n"))
    return per_trace.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("logs"),
        F.coalesce(F.sum(F.when(traced, F.col("n"))), F.lit(0)).alias("correlated"),
        F.count_if(traced).alias("traces"),
    )


def latest_trace(spans: DataFrame) -> DataFrame:
    """Spans of the newest trace, one with several spans when there is any."""
    per_trace = spans.groupBy("TraceId").agg(
        F.count(F.lit(1)).alias("n"), F.max("Timestamp").alias("latest")
    )
    newest = per_trace.orderBy(F.desc(F.col("n") > 1), F.desc("latest"), "TraceId").limit(1)
    rows = spans.join(newest.select("TraceId"), "TraceId", "left_semi")
    return rows.select(
        F.col("TraceId").alias("trace_id"),
        F.col("Timestamp").alias("at"),
        F.col("SpanId").alias("span_id"),
        F.col("SpanName").alias("span"),
        F.when(F.col("ParentSpanId") == "", 0).otherwise(1).alias("nested"),
        F.round(F.col("Duration") / 1e6, 1).alias("ms"),
    )


def trace_roots(spans: DataFrame) -> DataFrame:
    """Per trace: spans, roots, and whether there is exactly one root."""
    per_trace = spans.groupBy("TraceId").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("ParentSpanId") == "").alias("roots"),
    )
    return per_trace.withColumn("ok", F.col("roots") == 1)


def published_metrics(tables: Sequence[DataFrame]) -> DataFrame:
    """Points and latest time per metric name over all metric tables."""
    rows = tables[0].select("MetricName", "TimeUnix")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("MetricName", "TimeUnix"))
    return rows.groupBy(F.col("MetricName").alias("metric")).agg(
        F.count(F.lit(1)).alias("points"), F.max("TimeUnix").alias("latest")
    )


def span_health(
    spans: DataFrame, now: Column, prefixes: Sequence[str], hours: int = 24, limit: int = 30
) -> DataFrame:
    """Calls, median and 95th percentile duration and errors per span over the last hours."""
    since = now - F.expr(f"INTERVAL {hours} HOURS")
    named = F.lit(False)
    for p in prefixes:
        named = named | F.col("SpanName").like(p)
    rows = spans.filter((F.col("Timestamp") >= since) & named)
    # calls are counted first: only the spans that are shown need their durations ranked
    calls = rows.groupBy("SpanName").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("StatusCode") == "Error").alias("errors")
    )
    shown = materialize(calls.orderBy(F.desc("calls"), "SpanName").limit(limit), "spans")
    of_shown = rows.join(shown.select("SpanName"), "SpanName", "left_semi")
    durations = quantiles(of_shown, ["SpanName"], "Duration", {"p50": 0.5, "p95": 0.95})
    ms = lambda c: F.round(F.col(c) / 1e6, 1).alias(f"{c}_ms")
    health = shown.join(durations, "SpanName").select(F.col("SpanName").alias("span_name"), "calls", ms("p50"), ms("p95"), "errors")
    return health.orderBy(F.desc("calls"), "span_name").limit(limit)


def query_cost(query_log: DataFrame) -> DataFrame:
    """Cost per call and stage, read from the tag each query carries in a comment."""
    call = F.regexp_extract("query", r"bench run=[a-z0-9]+-(c[0-9]+)", 1)
    stage = F.regexp_extract("query", r"stage=([a-z_]+)", 1)
    rows = query_log.filter(
        (F.col("type") == "QueryFinish") & F.contains("query", F.lit("bench run="))
    )
    return rows.groupBy(call.alias("call_id"), stage.alias("stage")).agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("query_duration_ms").alias("server_ms"),
        F.sum("read_rows").alias("read_rows"),
        F.sum("read_bytes").alias("read_bytes"),
        F.max("memory_usage").alias("peak"),
    )


def cost_delta(raw: DataFrame, rollup: DataFrame) -> DataFrame:
    """Two runs of the same calls side by side, and their totals in a last row."""
    sums = ("queries", "server_ms", "read_rows", "read_bytes")

    def per_call(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy("call_id").agg(
            *(F.sum(c).alias(f"{c}_{side}") for c in sums), F.max("peak").alias(f"peak_{side}")
        )

    both = per_call(raw, "raw").join(per_call(rollup, "rollup"), "call_id", "full")
    both = both.fillna(0)
    total = both.agg(
        F.lit("total").alias("call_id"),
        *(F.sum(f"{c}_{s}").alias(f"{c}_{s}") for s in ("raw", "rollup") for c in sums),
        *(F.max(f"peak_{s}").alias(f"peak_{s}") for s in ("raw", "rollup")),
    )
    rows = both.unionByName(total)
    fewer = F.col("read_rows_raw") / F.nullif(F.col("read_rows_rollup").cast("double"), F.lit(0.0))
    return rows.withColumn("read_rows_ratio", fewer)


def attr_items(attributes: str | Column) -> Column:
    """``key=value`` strings of a map."""
    column = F.col(attributes) if isinstance(attributes, str) else attributes
    return F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"]))


def _native(columns: Sequence[str]) -> list[Column]:
    return [
        F.struct(F.lit(c).alias("Key"), F.col(c).cast("string").alias("Value")) for c in columns
    ]


def kv_pairs(rows: DataFrame, kind: str) -> DataFrame:
    """Each row once per counted column: ``Timestamp, ColumnIdentifier, Key, Value``."""
    if kind == "logs":
        pairs = _native(LOG_COLUMNS) + [
            F.struct(
                F.lit(LOG_ATTRIBUTE_PREFIX + a).alias("Key"),
                F.coalesce(F.try_element_at("ResourceAttributes", F.lit(a)), F.lit("")).alias(
                    "Value"
                ),
            )
            for a in LOG_ATTRIBUTES
        ]
    else:
        pairs = _native(TRACE_COLUMNS)
    return rows.select(
        "Timestamp",
        F.lit("NativeColumn").alias("ColumnIdentifier"),
        F.explode(F.array(*pairs)).alias("kv"),
    ).select("Timestamp", "ColumnIdentifier", "kv.Key", "kv.Value")


def kv_rollup_15m(rows: DataFrame, kind: str) -> DataFrame:
    """15-minute counts per column value; the same plan runs on a batch or a stream."""
    grouped = kv_pairs(rows, kind).groupBy(
        F.window("Timestamp", "15 minutes").alias("w"), "ColumnIdentifier", "Key", "Value"
    )
    counted = grouped.agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        F.col("w.start").alias("Timestamp"), "ColumnIdentifier", "Key", "Value", "count"
    )


def step_runs(steps: DataFrame) -> DataFrame:
    """Steps with the start of their run: a gap of more than three minutes starts a new one."""
    order = ["at", "step_id"]
    keyed = steps.withColumn("day", F.to_date("at"))
    keyed = last_before(keyed, ["session"], "day", order, F.col("at"), "previous")
    opens = F.col("previous").isNull() | (F.col("at") > F.col("previous") + F.expr(STEP_GAP))
    return last_before(
        keyed, ["session"], "day", order, F.when(opens, F.col("at")), "run_start", inclusive=True
    )


def attribute_steps(prompts: DataFrame, steps: DataFrame) -> DataFrame:
    """The steps each prompt was answered from: ``prompt_id, step_id``.

    Walk back from the prompt's end to its latest step, then on while steps are at most three
    minutes apart, never past the end of the previous prompt of the session.

    ``prompts``: ``session, prompt_id, at, ends``; ``steps``: ``session, step_id, at``.
    """
    asked = prompts.withColumn("day", F.to_date("at"))
    asked = last_before(asked, ["session"], "day", ["at", "prompt_id"], F.col("ends"), "floor")

    runs = step_runs(steps)
    # prompts look up the latest step at or before their end, on the same sliced order
    seen = runs.select(
        "session", "at", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("prompt_id"),
        F.struct("at", "run_start").alias("step"), F.lit(None).cast("timestamp").alias("floor"),
    )
    wanted = asked.select(
        "session", F.col("ends").alias("at"), F.lit(1).alias("kind"), "prompt_id",
        F.lit(None).cast("struct<at:timestamp,run_start:timestamp>").alias("step"), "floor",
    )
    line = seen.unionByName(wanted).withColumn("day", F.to_date("at"))
    line = last_before(line, ["session"], "day", ["at", "kind", "prompt_id"], F.col("step"), "last")
    found = line.filter((F.col("kind") == 1) & F.col("last").isNotNull())
    low = F.greatest(F.col("last.run_start"), F.coalesce("floor", F.col("last.run_start")))
    spans = found.select("session", "prompt_id", low.alias("low"), F.col("last.at").alias("high"))
    spans = spans.filter("high >= low")
    # an hour is the join key next to the session, so one busy session is many keys
    hours = F.sequence(
        F.date_trunc("hour", "low"), F.date_trunc("hour", "high"), F.expr("INTERVAL 1 HOUR")
    )
    spans = spans.withColumn("hour", F.explode(hours))
    timed = steps.withColumn("hour", F.date_trunc("hour", "at"))
    inside = F.col("at").between(F.col("low"), F.col("high"))
    joined = timed.join(spans, ["session", "hour"]).filter(inside)
    return joined.select("session", "prompt_id", "step_id", "at")


def generation_cost(
    usage: DataFrame, prices: DataFrame, now: Column, hours: int = 24
) -> DataFrame:
    """Cost, tokens and calls per model over the last hours, each usage type at its own price.

    ``usage``: ``model, usage_type, tokens, at, call_id``; ``prices``: ``model, usage_type, price``.
    """
    recent = usage.filter(F.col("at") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    tokens = recent.groupBy("model", "usage_type").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls")
    )
    priced = tokens.join(prices, ["model", "usage_type"], "left")
    cost = F.col("tokens") * F.coalesce("price", F.lit(0.0))
    return priced.groupBy("model").agg(
        F.sum(cost).alias("total_cost"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("calls").alias("generations"),
    )
