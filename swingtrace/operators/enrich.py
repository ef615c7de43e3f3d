"""The flat event view: the fact joined with its three dimension tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD = 1024
EVENT_KEYS = ("event_time", "app_id", "geo_device_id", "advertiser_id")
APP_COLUMNS = {"category": "app_category", "publisher_tier": "publisher_tier"}
ADVERTISER_COLUMNS = {"vertical": "advertiser_vertical", "campaign_type": "campaign_type"}
GEO_COLUMNS = {c: c for c in ("region", "country", "device_model", "os_version")}


def lookup(fact: DataFrame, dim: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Left lookup where a missing or empty key gives ``''``.

    No broadcast hint: Catalyst and AQE broadcast the dimension when its measured size allows and
    shuffle otherwise. For the shuffled case, rows with an empty or missing key (every unfilled request) would
    all land in one partition, so a second join key spreads them by a row hash: a number from 1 up for them, 0 for
    other rows and for the dimension's. The number moves with the row, not a second copy of the key.
    """
    others = [c for c in EVENT_KEYS if c != key]
    empty = F.coalesce(F.col(key) == "", F.lit(True))
    left = fact.withColumn(
        "_spread", F.when(empty, F.pmod(F.xxhash64(*others), F.lit(SPREAD)) + 1).otherwise(0).cast("int")
    )
    right = dim.select(
        F.col(key).alias("_dim_key"),
        F.when(F.col(key) == "", -1).otherwise(0).alias("_dim_spread"),
        *(F.col(src).alias(dst) for src, dst in columns.items()),
    )
    joined = left.join(right, (F.col(key) == F.col("_dim_key")) & (F.col("_spread") == F.col("_dim_spread")), "left")
    filled = {dst: F.coalesce(dst, F.lit("")) for dst in columns.values()}
    return joined.drop("_spread", "_dim_key", "_dim_spread").withColumns(filled)


def with_calendar(fact: DataFrame) -> DataFrame:
    """Date, hour bucket, weekday (1 = Monday) and hour of day.

    A stored ``event_date`` is kept: it is what the fact is partitioned by, and only a filter on the stored
    column leaves whole days unread.
    """
    date = {} if "event_date" in fact.columns else {"event_date": F.to_date("event_time")}
    return fact.withColumns(
        {
            **date,
            "event_hour": F.date_trunc("hour", "event_time"),
            "day_of_week": F.weekday("event_time") + 1,
            "hour_of_day": F.hour("event_time"),
        }
    )


def enrich_star(
    fact: DataFrame,
    apps: DataFrame,
    advertisers: DataFrame,
    geo_device: DataFrame,
    dims: Iterable[str] | None = None,
) -> DataFrame:
    """Every event with its looked-up attributes; no NULLs.

    With ``dims``, only the dimension tables those attributes come from are joined: an outer join
    is never dropped by the optimizer on its own, even when nothing reads its columns. The calendar comes last, so
    that its columns do not move with the rows, and the advertisers after the larger tables, as the likeliest to be broadcast.
    """
    out, names = fact, with_calendar(fact).columns
    wanted = None if dims is None else set(dims)
    for dim, key, columns in (
        (apps, "app_id", APP_COLUMNS),
        (geo_device, "geo_device_id", GEO_COLUMNS),
        (advertisers, "advertiser_id", ADVERTISER_COLUMNS),
    ):
        if wanted is None or wanted & set(columns.values()):
            out = lookup(out, dim, key, columns)
            names += columns.values()
    return with_calendar(out).select(*names)
