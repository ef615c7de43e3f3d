"""Where queries register themselves, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.config import T, Thresholds
from swingtrace.operators.enrich import enrich_star
from swingtrace.operators.source import EventSource, RollupSource
from swingtrace.sources import adapter as A
from swingtrace.sources import ingest
from swingtrace.sources.store import discard, materialize, new_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The folded view has about 1,700 rows a day at the smallest checked scale, so segment floors are
# lowered for it; every other gate stays.
FOLDED = replace(T, segment_min_requests=20)


def query(key: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register


def rnd(column: str | Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: rnd(c, d) for c, d in digits.items()})


def by_metric(column: str) -> Column:
    """A metric's value, rounded to what its unit can carry."""
    metric = F.col("metric")
    return (
        F.when(metric == "ecpm", rnd(column, -2))
        .when(metric == "rpr", rnd(column, 2))
        .otherwise(rnd(column, 4))
    )


def folded(spark: SparkSession, sf_dir: str) -> EventSource:
    return EventSource(A.star(spark, sf_dir))


def stored_star(spark: SparkSession, sf_dir: str) -> A.Star:
    """The star with its fact stored, so that no reader makes it again."""
    return A.Star(materialize(A.ad_events(spark, sf_dir), "fact"), *A.dimensions(spark, sf_dir))


def stored_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded view's joined events, stored once, each day read by its own tasks."""
    return ingest.day_by_day(ingest.store_events(folded(spark, sf_dir).rows(), new_path(spark, "events")))


def panel_rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    week = enrich_star(A.panel_week(spark, sf_dir), *A.dimensions(spark, sf_dir))
    return A.plant(A.repeat_week(week), kind)


def panel(spark: SparkSession, sf_dir: str, kind: str) -> EventSource:
    """The planted panel; its readers go over it several times, so its joined week is stored once."""
    week = enrich_star(A.panel_week(spark, sf_dir), *A.dimensions(spark, sf_dir))
    stored = ingest.day_by_day(ingest.store_events(week, new_path(spark, f"panel-{kind}")))
    return EventSource(flat=A.plant(A.repeat_week(stored), kind))


def stored_rollups(spark: SparkSession, sf_dir: str) -> RollupSource:
    """Both rollups of the folded view, written and read back; the joined events are stored until both are."""
    star, path = stored_star(spark, sf_dir), new_path(spark, "events")
    events = ingest.day_by_day(ingest.store_events(EventSource(star).rows(), path))
    hourly, daily = ingest.write_rollups(
        events, new_path(spark, "rollup-hourly"), new_path(spark, "rollup-daily"), gather=False
    )
    discard(spark, path)
    return RollupSource(hourly, daily, star=star)


def thresholds(**changes) -> Thresholds:
    return replace(T, **changes)
