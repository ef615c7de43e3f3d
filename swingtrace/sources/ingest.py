"""Reading and loading the fact table and its dimensions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swingtrace import schema
from swingtrace.operators.rollup import manifest, rollup_daily, rollup_hourly
from swingtrace.sources.store import CODEC, shuffles_freed, wider_broadcasts

READ_GROUPS = 40  # reads that day_by_day() puts side by side at most
TASK_ROWS = 500_000  # of a task of one of them


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    """Ad events from Parquet, with the schema stated rather than inferred."""
    return spark.read.schema(schema.AD_EVENTS).parquet(path)


def load_dim(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """A dimension from CSV with a header; a malformed row fails the load."""
    reader = spark.read.schema(columns).option("header", True).option("mode", "FAILFAST")
    return reader.option("enforceSchema", False).csv(path)


def replace_dim(df: DataFrame, target: str) -> DataFrame:
    """Full replace of a dimension table."""
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def by_day(fact: DataFrame) -> DataFrame:
    return fact.withColumn("event_date", F.to_date("event_time"))


def _write_days(df: DataFrame, target: str, sort: Iterable[str] = (), gather: bool = True) -> None:
    """One directory per day, replacing exactly the days present in ``df``.

    The rebalance keeps a small day in one file and splits a large one into files of the advisory
    size, so a day never passes through a single task. Without ``gather`` rows do not move once more: what an
    aggregation has just dealt out is written by the tasks that hold it, as a file per task and day.
    """
    out = df.hint("rebalance", "event_date") if gather else df
    if sort:
        out = out.sortWithinPartitions(*sort)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC)
    with shuffles_freed(df.sparkSession):
        writer.partitionBy("event_date").parquet(target)


def store_events(events: DataFrame, path: str) -> DataFrame:
    """Enriched events written once, a directory per day, and read back: joins are not repeated, and their shuffle files are gone."""
    spark = events.sparkSession
    with wider_broadcasts(spark):
        _write_days(events, path, gather=False)
    return spark.read.schema(events.schema).parquet(path).select(*events.columns)


def day_by_day(stored: DataFrame) -> DataFrame:
    """The same rows, each day read by its own tasks, so that a task's partial sums cover few hours; no row moves for that.

    ``stored`` must lie in a directory per day. Only the days and their numbers of rows come to the driver; more than
    READ_GROUPS days are read in groups of neighbouring ones.
    """
    counts = sorted(((r["event_date"], r["n"]) for r in day_counts(stored).collect()), key=lambda r: r[0] or dt.date.min)
    if not counts:
        return stored
    size = -(-len(counts) // READ_GROUPS)
    groups = [counts[i : i + size] for i in range(0, len(counts), size)]
    cores = stored.sparkSession.sparkContext.defaultParallelism
    least = max(2, -(-4 * cores // len(groups)))  # tasks of a group: all cores are busy, and reads of one task each would be run as one task
    day = F.col("event_date")

    def read(group: list) -> DataFrame:
        within = reduce(lambda a, b: a | b, (day.eqNullSafe(F.lit(d).cast("date")) for d, _ in group))
        return stored.filter(within).coalesce(max(least, -(-sum(n for _, n in group) // TASK_ROWS)))

    return reduce(DataFrame.unionByName, map(read, groups))


def write_days(fact: DataFrame, target: str) -> DataFrame:
    """The fact split by calendar day."""
    days = by_day(fact)
    _write_days(days, target, ("event_date", "event_time", "ad_format", "app_id", "geo_device_id"))
    return read_days(fact.sparkSession, target)


def read_days(spark: SparkSession, target: str) -> DataFrame:
    fields = [*schema.AD_EVENTS.fields, T.StructField("event_date", T.DateType())]
    return spark.read.schema(T.StructType(fields)).parquet(target)


def day_counts(fact: DataFrame) -> DataFrame:
    return fact.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


def pending_days(source: DataFrame, loaded: DataFrame) -> DataFrame:
    """Days whose loaded row count differs from the source (both with ``event_date``)."""
    have = day_counts(loaded).withColumnRenamed("n", "loaded_rows")
    both = day_counts(source).withColumnRenamed("n", "source_rows").join(have, "event_date", "left")
    both = both.withColumn("loaded_rows", F.coalesce("loaded_rows", F.lit(0)))
    return both.filter("source_rows <> loaded_rows")


def assert_days(source: DataFrame, loaded: DataFrame) -> None:
    """Fail when any source day is short or duplicated in the target."""
    wrong = pending_days(source, loaded)
    first = wrong.orderBy("event_date").limit(5).collect()
    if first:
        raise ValueError(f"{wrong.count()} loaded days differ from the source, first {[tuple(r) for r in first]}")


def _days_of(rows: DataFrame) -> set[dt.date]:
    return {r[0] for r in rows.select("event_date").distinct().collect()}


def drop_days(spark: SparkSession, target: str, days: Iterable[dt.date]) -> None:
    """Remove whole day partitions, on whatever file system the table is."""
    for day in days:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/event_date={day}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def replace_days(
    fact: DataFrame, target: str, only: Iterable[dt.date] | None = None
) -> DataFrame:
    """Idempotent load: each day replaced, never appended to. A chosen day without rows at the source is emptied."""
    days = by_day(fact)
    if only is not None:
        only = list(only)
        days = days.filter(F.col("event_date").isin(*only))
    _write_days(days, target, ("event_date", "event_time"))
    if only is not None:
        drop_days(fact.sparkSession, target, set(only) - _days_of(days))
    return read_days(fact.sparkSession, target)


def write_rollups(
    events: DataFrame,
    hourly_path: str,
    daily_path: str,
    compact: bool = False,
    manifest_path: str | None = None,
    gather: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Both rollups of the days in ``events``; the daily one from the stored hourly one.

    Rows are sorted by cut, so a reader of one cut skips the row groups of the others. With a
    ``manifest_path`` the days' counts per key are stored there, as read back from what was written.
    ``gather`` says that the events of an hour may be anywhere (see ``rollup_hourly``).
    """
    spark = events.sparkSession
    hourly = rollup_hourly(events, compact=compact, gather=gather)
    _write_days(hourly, hourly_path, ("event_date", "dim", "val", "event_hour"), gather=False)
    stored = read_hourly(spark, hourly_path)
    touched = sorted(_days_of(events))
    fresh = stored.filter(F.col("event_date").isin(*touched)) if touched else stored.filter("false")
    _write_days(rollup_daily(day_by_day(fresh)), daily_path, ("event_date", "dim", "val"), gather=False)
    daily = read_daily(spark, daily_path)
    if manifest_path is not None and touched:
        kept = daily.filter(F.col("event_date").isin(*touched))
        _write_days(manifest(fresh, kept), manifest_path, ("event_date", "grain", "dim"))
    return stored, daily


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ROLLUP_MANIFEST).parquet(path)


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ROLLUP_HOURLY).parquet(path)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ROLLUP_DAILY).parquet(path)


def backfill_days(
    enriched: DataFrame,
    days: Iterable[dt.date],
    hourly_path: str,
    daily_path: str,
    manifest_path: str | None = None,
    gather: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Rebuild chosen days of both rollups from the events; repeating it changes nothing."""
    chosen = list(days)
    events = enriched.filter(F.col("event_date").isin(*chosen))
    hourly, daily = write_rollups(events, hourly_path, daily_path, manifest_path=manifest_path, gather=gather)
    for path in filter(None, (hourly_path, daily_path, manifest_path)):  # days emptied at the source
        drop_days(enriched.sparkSession, path, set(chosen) - _days_of(events))
    hourly, daily = read_hourly(enriched.sparkSession, hourly_path), read_daily(enriched.sparkSession, daily_path)
    expected = events.count()
    covered = daily.filter((F.col("dim") == "ad_format") & F.col("event_date").isin(*chosen))
    got = covered.agg(F.coalesce(F.sum("events"), F.lit(0))).first()[0]
    if got != expected:
        raise ValueError(f"rollup covers {got} of {expected} events")
    return hourly, daily


MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("timestampFormat", MICROS).json(path)


def jsonl(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """All whole lines; a half-written one is skipped."""
    reader = spark.read.schema(columns).option("mode", "DROPMALFORMED")
    return reader.option("timestampFormat", MICROS).json(path).filter("at IS NOT NULL")


def read_jsonl(
    spark: SparkSession, path: str, columns: T.StructType, since: str | None = None, limit: int = 25
) -> DataFrame:
    """The newest rows after ``since``."""
    rows = jsonl(spark, path, columns)
    if since is not None:
        rows = rows.filter(F.col("at") > F.lit(since).cast("timestamp"))
    others = [c for c in rows.columns if c != "at"]
    return rows.orderBy(F.desc("at"), *others).limit(limit)
