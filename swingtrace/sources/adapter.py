"""The shared test tables, read as ad events and their dimensions.

``ad_events`` maps every line item to one ad request. Ship dates fold onto a five-week calendar so
that weekday history exists; ``panel`` instead repeats one folded week five times, which makes every
same-weekday comparison exactly zero until something is planted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2026-06-01"
FIRST_SHIP_DATE = "1995-01-02"
FOLD_DAYS = 35
PLANT_DAY = "2026-06-23"
UNIFORM_DAY = "2026-06-21"
QUIET_DAY = "2026-06-24"
PLANT_SEGMENT = ("device_model", "BUILDING")


@dataclass(frozen=True)
class Star:
    """A fact table and the three dimension tables it points at."""

    fact: DataFrame
    apps: DataFrame
    advertisers: DataFrame
    geo_device: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core on an input too small to be split; large inputs are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def _fold_offset(days: int) -> Column:
    shipped = F.datediff(F.to_date("l_shipdate"), F.lit(FIRST_SHIP_DATE).cast("date"))
    return F.pmod(shipped, F.lit(days))


def _events(spark: SparkSession, sf_dir: str, fold_days: int) -> DataFrame:
    """One row per line item, event date still an offset within the folded calendar."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    filled = F.col("l_returnflag") != "R"
    shown = filled & (F.col("l_linestatus") == "O")
    items = table(spark, sf_dir, "lineitem").select(  # what moves to meet the orders
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        _fold_offset(fold_days).alias("offset"),
        filled.cast("int").alias("is_filled"),
        shown.cast("int").alias("is_impression"),
        (shown & (F.col("l_discount") >= 0.085)).cast("int").alias("is_click"),
        F.when(shown, F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")))
        .otherwise(F.lit(0.0))
        .alias("revenue"),
    )
    return (
        spread(items, "l_orderkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(
            "offset",
            F.pmod(F.col("l_orderkey"), F.lit(24)).cast("int").alias("hour"),
            F.concat(F.lit("app_"), F.col("l_partkey")).alias("app_id"),
            F.concat(
                F.lit("g"), F.col("o_custkey"), F.lit("_"), F.pmod(F.col("l_orderkey"), F.lit(8))
            ).alias("geo_device_id"),
            F.when(F.col("is_filled") == 1, F.concat(F.lit("adv_"), F.col("l_suppkey")))
            .otherwise(F.lit(""))
            .alias("advertiser_id"),
            F.coalesce("o_orderpriority", F.lit("")).alias("ad_format"),
            "is_filled",
            "is_impression",
            "is_click",
            "revenue",
        )
    )


EVENT_COLUMNS = (
    "event_time",
    "app_id",
    "geo_device_id",
    "advertiser_id",
    "ad_format",
    "is_filled",
    "is_impression",
    "is_click",
    "revenue",
)


def _at(date: Column) -> Column:
    return F.timestamp_add("HOUR", F.col("hour"), date.cast("timestamp")).alias("event_time")


def ad_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table on the folded five-week calendar."""
    day = F.date_add(F.lit(EPOCH).cast("date"), F.col("offset"))
    return _events(spark, sf_dir, FOLD_DAYS).withColumn("event_time", _at(day)).select(
        *EVENT_COLUMNS
    )


def dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tier = (
        F.when(F.col("p_size") <= 17, "tier_1").when(F.col("p_size") <= 34, "tier_2")
    ).otherwise("tier_3")
    apps = table(spark, sf_dir, "part").select(
        F.concat(F.lit("app_"), F.col("p_partkey")).alias("app_id"),
        F.col("p_brand").alias("category"),
        tier.alias("publisher_tier"),
    )
    nation = table(spark, sf_dir, "nation")
    advertisers = (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.concat(F.lit("adv_"), F.col("s_suppkey")).alias("advertiser_id"),
            F.col("n_name").alias("vertical"),
            F.concat(F.lit("camp_"), F.pmod(F.col("s_suppkey"), F.lit(3))).alias("campaign_type"),
        )
    )
    systems = F.explode(F.sequence(F.lit(0), F.lit(7)))
    geo = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(
            table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        .select("c_custkey", "r_name", "n_name", "c_mktsegment", systems.alias("os"))
        .select(
            F.concat(F.lit("g"), F.col("c_custkey"), F.lit("_"), F.col("os")).alias(
                "geo_device_id"
            ),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("country"),
            F.col("c_mktsegment").alias("device_model"),
            F.concat(F.lit("os_"), F.col("os")).alias("os_version"),
        )
    )
    return apps, advertisers, geo


def star(spark: SparkSession, sf_dir: str) -> Star:
    return Star(ad_events(spark, sf_dir), *dimensions(spark, sf_dir))


def panel_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded week that the panel repeats."""
    day = F.date_add(F.lit(EPOCH).cast("date"), F.col("offset"))
    return _events(spark, sf_dir, 7).withColumn("event_time", _at(day)).select(*EVENT_COLUMNS)


def repeat_week(week: DataFrame) -> DataFrame:
    """The week, five weeks long, two copies of every event (column ``cp``); calendar columns move along.

    Attributes do not depend on the week, so they are looked up before this and not per copy.
    """
    later = F.col("wk") * 7
    moved = {c: F.timestamp_add("DAY", later, F.col(c)) for c in ("event_time", "event_hour") if c in week.columns}
    if "event_date" in week.columns:
        moved["event_date"] = F.date_add("event_date", later)
    weeks = week.withColumn("wk", F.explode(F.sequence(F.lit(0), F.lit(4))))
    copies = weeks.withColumn("cp", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return copies.withColumns(moved).drop("wk")


def panel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folded week, five weeks long, two copies of every event (column ``cp``)."""
    return repeat_week(panel_week(spark, sf_dir))


def plant(enriched: DataFrame, kind: str) -> DataFrame:
    """Put one known cause into the enriched panel.

    ``break``: half of one device's requests go unfilled on a day. ``uniform``: half of all requests
    vanish on a day. ``price``: half of one device's events earn 40% less. ``supply``: half of one
    device's requests vanish. ``quiet``: nothing.
    """
    dim, val = PLANT_SEGMENT
    day = F.col("event_date") == F.lit(PLANT_DAY).cast("date")
    hit = day & (F.col(dim) == val) & (F.col("cp") == 1)
    if kind == "quiet":
        return enriched
    if kind == "uniform":
        gone = (F.col("event_date") == F.lit(UNIFORM_DAY).cast("date")) & (F.col("cp") == 1)
        return enriched.filter(~gone)
    if kind == "supply":
        return enriched.filter(~hit)
    if kind == "price":
        return enriched.withColumn(
            "revenue", F.when(hit, F.col("revenue") * 0.6).otherwise(F.col("revenue"))
        )
    if kind == "break":
        zeroed = {
            c: F.when(hit, F.lit(0)).otherwise(F.col(c))
            for c in ("is_filled", "is_impression", "is_click")
        }
        blanked = {
            c: F.when(hit, F.lit("")).otherwise(F.col(c))
            for c in ("advertiser_id", "advertiser_vertical", "campaign_type")
        }
        revenue = F.when(hit, F.lit(0.0)).otherwise(F.col("revenue"))
        return enriched.withColumns({**zeroed, **blanked, "revenue": revenue})
    raise ValueError(f"unknown plant {kind!r}")
