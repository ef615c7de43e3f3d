"""The ``events`` test table read as telemetry: spans, logs, metric points, query log, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.sources.adapter import table

SERVICES = ("api", "worker")
SPAN_PREFIXES = ("stage.%", "tool.%", "investigation")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(table(spark, sf_dir, "events"))


def shape(rows: DataFrame) -> DataFrame:
    """Common derived columns; usable on a batch or a stream."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    names = F.create_map(
        *(
            F.lit(x)
            for x in (
                "view", "stage.detect",
                "click", "stage.localize",
                "purchase", "tool.measure",
                "signup", "investigation",
                "error", "stage.classify",
            )
        )
    )
    return rows.select(
        F.col("ts").cast("timestamp").alias("Timestamp"),
        "event_id",
        "user_id",
        "event_type",
        "value",
        "props",
        F.coalesce(k, F.lit(0)).alias("k"),
        names[F.col("event_type")].alias("SpanName"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, SERVICES[0])
        .otherwise(SERVICES[1])
        .alias("ServiceName"),
        F.concat(
            F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")
        ).alias("trace"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace per user and day; its first event is the root."""
    rows = events(spark, sf_dir)
    roots = rows.groupBy("trace").agg(
        F.min_by("event_id", F.struct("Timestamp", "event_id")).alias("root")
    )
    joined = rows.join(roots, "trace")
    parent = F.when(F.col("event_id") == F.col("root"), "").otherwise(
        F.col("root").cast("string")
    )
    return joined.select(
        "Timestamp",
        F.col("trace").alias("TraceId"),
        F.col("event_id").cast("string").alias("SpanId"),
        parent.alias("ParentSpanId"),
        "SpanName",
        F.when(F.col("event_type") == "error", "Client").otherwise("Internal").alias("SpanKind"),
        "ServiceName",
        F.lit("swing").alias("ScopeName"),
        F.concat(F.lit("1."), F.pmod("k", F.lit(3)).cast("string")).alias("ScopeVersion"),
        F.round(F.col("value") * 1e6).cast("bigint").alias("Duration"),
        F.when(F.col("event_type") == "error", "Error").otherwise("Ok").alias("StatusCode"),
    )


def as_logs(rows: DataFrame) -> DataFrame:
    """Log columns of shaped events; views carry no trace."""
    k = F.col("k")
    return rows.select(
        "Timestamp",
        F.when(F.col("event_type") == "view", "").otherwise(F.col("trace")).alias("TraceId"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("SeverityText"),
        "ServiceName",
        F.col("SpanName").alias("ScopeName"),
        F.concat(F.lit("1."), F.pmod(k, F.lit(3)).cast("string")).alias("ScopeVersion"),
        F.lit("").alias("ResourceSchemaUrl"),
        F.lit("").alias("ScopeSchemaUrl"),
        F.col("props").alias("Body"),
        F.create_map(
            F.lit("k8s.pod.name"),
            F.concat(F.lit("pod-"), F.pmod(k, F.lit(4)).cast("string")),
            F.lit("deployment.environment.name"),
            F.when(F.pmod("user_id", F.lit(5)) == 0, "staging").otherwise("production"),
        ).alias("ResourceAttributes"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_logs(events(spark, sf_dir))


def metric_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Purchases as counter points, clicks and errors as histogram points."""
    rows = events(spark, sf_dir).select(
        "event_type",
        "ServiceName",
        F.concat(F.lit("app."), "event_type").alias("MetricName"),
        F.col("Timestamp").alias("TimeUnix"),
        F.col("value").alias("Value"),
    )
    sums = rows.filter("event_type = 'purchase'").drop("event_type")
    return sums, rows.filter("event_type IN ('click', 'error')").drop("event_type")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query per event, tagged with a run, a call and a stage."""
    call = F.pmod("user_id", F.lit(8)).cast("string")
    stage = F.regexp_extract("SpanName", r"([a-z]+)$", 1)
    text = F.concat(
        F.lit("/* bench run=r1-c"), call, F.lit(" stage="), stage, F.lit(" */ SELECT "),
        F.col("k").cast("string"),
    )
    return events(spark, sf_dir).select(
        F.when(F.col("event_type") == "error", "ExceptionWhileProcessing")
        .otherwise("QueryFinish")
        .alias("type"),
        text.alias("query"),
        F.round("value").cast("bigint").alias("query_duration_ms"),
        (F.col("k") * 1000).alias("read_rows"),
        (F.col("k") * 64000).alias("read_bytes"),
        (F.col("k") * 4096).alias("memory_usage"),
        (F.pmod("event_id", F.lit(2)) == 0).alias("on_rollup"),
    )


def prompts_and_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Signups as prompts that end after their latency, every other event as a step.

    A session is one of 16 groups of users, so sessions are busy enough for steps to cluster.
    """
    rows = events(spark, sf_dir).withColumn("session", F.pmod("user_id", F.lit(16)))
    ends = F.timestamp_add("SECOND", F.floor("value").cast("int"), F.col("Timestamp"))
    prompts = rows.filter("event_type = 'signup'").select(
        "session", F.col("event_id").alias("prompt_id"), F.col("Timestamp").alias("at"),
        ends.alias("ends"),
    )
    steps = rows.filter("event_type <> 'signup'").select(
        "session", F.col("event_id").alias("step_id"), F.col("Timestamp").alias("at")
    )
    return prompts, steps


def usage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Token usage per event and a price per usage type, read off the events themselves."""
    kinds = F.create_map(
        *(
            F.lit(x)
            for x in (
                "view", "input", "click", "input_cache_read", "purchase", "output",
                "signup", "input", "error", "output",
            )
        )
    )
    rows = events(spark, sf_dir).select(
        F.concat(F.lit("model_"), F.pmod("user_id", F.lit(3)).cast("string")).alias("model"),
        kinds[F.col("event_type")].alias("usage_type"),
        F.round("value").cast("bigint").alias("tokens"),
        F.col("Timestamp").alias("at"),
        F.col("event_id").alias("call_id"),
    )
    # Price per million tokens by usage type.
    price = (
        F.when(F.col("usage_type") == "input", 0.14)
        .when(F.col("usage_type") == "output", 0.28)
        .otherwise(0.0028)
    )
    prices = rows.select("model", "usage_type").distinct().withColumn("price", price / 1e6)
    return rows, prices
