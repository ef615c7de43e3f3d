"""Segment rollups: one long table of five sums per (bucket, cut, value)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swingtrace.config import MEASURES, PAIRABLE, ROLLUP_CUTS, ROLLUP_KEYS, Cut, cut_key
from swingtrace.functions.metrics import event_measures, rollup_measures

ROW_MEASURES = ("is_filled", "is_impression", "is_click", "revenue")


def cut_value(cut: Cut) -> Column:
    parts = [F.col(cut[0])]
    for name in cut[1:]:
        parts += [F.lit("|"), F.col(name)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def fan_out(
    rows: DataFrame,
    cuts: Sequence[Cut],
    buckets: Sequence[str],
    measures: Sequence[str] = ROW_MEASURES,
) -> DataFrame:
    """Each row once per cut: ``(buckets, cut position, val, measures)``.

    The position stands for the cut until after the aggregation, so the grouped rows carry one
    integer instead of a repeated name. Every cut is a row of places in one array of the dimensions: one short
    expression spells all values, whatever the number of cuts. One expression per cut makes a method that
    the JVM is not willing to compile.
    """
    dims = list(dict.fromkeys(d for c in cuts for d in c))
    width = max(len(c) for c in cuts)
    places = [[dims.index(d) for d in c] + [-1] * (width - len(c)) for c in cuts]
    found = F.posexplode(F.array(*(F.array(*(F.lit(i) for i in p)) for p in places))).alias("cut", "at")
    each = rows.select(*buckets, *measures, F.array(*(F.col(d) for d in dims)).alias("dims"), found)

    def part(k: int) -> Column:
        return F.get("dims", F.get("at", F.lit(k)))

    further = (
        F.when(F.get("at", F.lit(k)) < 0, "").otherwise(F.concat(F.lit("|"), part(k))) for k in range(1, width)
    )
    val = F.concat(part(0), *further) if width > 1 else part(0)
    return each.select(*buckets, *measures, "cut", val.alias("val"))


def _named(grouped: DataFrame, cuts: Sequence[Cut], buckets: Sequence[str]) -> DataFrame:
    keys = F.array(*(F.lit(cut_key(c)) for c in cuts))
    dim = F.element_at(keys, F.col("cut") + 1).alias("dim")
    return grouped.select(*buckets, dim, "val", *MEASURES)


def cells(events: DataFrame, cuts: Sequence[Cut], buckets: Sequence[str]) -> DataFrame:
    """Five sums per (bucket, dim, val), every cut in one pass over the events.

    Partial aggregation runs before the only shuffle, so a value holding a third of all rows is one
    row per task by the time it moves, and what moves grows with values x buckets, not with events.
    """
    grouped = fan_out(events, cuts, buckets).groupBy(*buckets, "cut", "val").agg(*event_measures())
    return _named(grouped, cuts, buckets)


def compact_cells(events: DataFrame, cuts: Sequence[Cut], buckets: Sequence[str]) -> DataFrame:
    """The same cells, reducing events to distinct attribute combinations before the fan-out.

    Worth its extra shuffle when many events share a combination within a bucket, as on very large
    tables: the 45 cuts over the small dimensions are then fanned out per combination, and only the
    cuts over single entities are still fanned out per event.
    """
    small = [c for c in cuts if set(c) <= set(PAIRABLE)]
    entity = [c for c in cuts if c not in small]
    dims = list(dict.fromkeys(d for c in small for d in c))
    combinations = events.groupBy(*buckets, *dims).agg(*event_measures())
    fanned = fan_out(combinations, small, buckets, MEASURES)
    out = _named(
        fanned.groupBy(*buckets, "cut", "val").agg(*rollup_measures()), small, buckets
    )
    return out.unionByName(cells(events, entity, buckets)) if entity else out


def rollup_hourly(
    events: DataFrame, cuts: Sequence[Cut] = ROLLUP_CUTS, compact: bool = False, gather: bool = True
) -> DataFrame:
    """Hourly cells. Events of an hour are first brought together, so that a task's partial sums cover few hours and
    nearly all of the fan-out ends in them. They meet by a hash, which no aggregation asks for, so the rebalance may
    split a large hour over several tasks. ``gather=False`` is for events that are read so already (``ingest.day_by_day``):
    then only sums move.
    """
    build = compact_cells if compact else cells
    buckets = ("event_date", "event_hour")
    if not gather:
        return build(events, cuts, buckets)
    dims = list(dict.fromkeys(d for c in cuts for d in c))
    near = events.select(*buckets, *dims, *ROW_MEASURES, F.xxhash64(*buckets).alias("near")).hint("rebalance", "near")
    return build(near.drop("near"), cuts, buckets)


def rollup_daily(hourly: DataFrame) -> DataFrame:
    """Daily sums, always from the hourly rollup and never from the events."""
    return hourly.groupBy("event_date", "dim", "val").agg(*rollup_measures())


def grouping_sets_cells(events: DataFrame, cuts: Sequence[Cut]) -> DataFrame:
    """The same daily cells through SQL ``GROUPING SETS``; a cross-check of the fan-out."""
    names = list(dict.fromkeys(d for c in cuts for d in c))
    events.createOrReplaceTempView("_grouping_sets_events")
    sets = ", ".join("(event_date, " + ", ".join(c) + ")" for c in cuts)
    flags = {n: f"grouping({n})" for n in names}
    dim = "CASE " + " ".join(
        "WHEN "
        + " AND ".join(f"{flags[n]} = {0 if n in c else 1}" for n in names)
        + f" THEN '{cut_key(c)}'"
        for c in cuts
    )
    val = "CASE " + " ".join(
        "WHEN "
        + " AND ".join(f"{flags[n]} = {0 if n in c else 1}" for n in names)
        + " THEN concat_ws('|', "
        + ", ".join(c)
        + ")"
        for c in cuts
    )
    return events.sparkSession.sql(
        f"""
        SELECT event_date, {dim} END AS dim, {val} END AS val,
               count(1) AS events, sum(is_filled) AS fills, sum(is_impression) AS impressions,
               sum(is_click) AS clicks, sum(revenue) AS revenue
        FROM _grouping_sets_events
        GROUP BY GROUPING SETS ({sets})
        """
    )


def rollup_key(dims: Iterable[str]) -> str | None:
    """The rollup key that carries these dimensions, whatever their order; None if none does."""
    names = list(dict.fromkeys(dims))
    if not names:
        return "ad_format"  # the cheapest cut that covers every event exactly once
    if len(names) == 2:
        if not set(names) <= set(PAIRABLE):
            return None
        names.sort(key=PAIRABLE.index)
    key = "|".join(names)
    return key if key in ROLLUP_KEYS else None


def read_cut(rollup: DataFrame, dims: Iterable[str]) -> DataFrame | None:
    """Rows of one cut under their real column names, or None when the rollup lacks it."""
    key = rollup_key(dims)
    if key is None:
        return None
    rows = rollup.filter(F.col("dim") == key)
    parts = F.split("val", r"\|", -1)
    names = key.split("|")
    if len(names) == 1:
        rows = rows.withColumn(names[0], F.col("val"))
    else:
        rows = rows.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})
    return rows.drop("dim", "val")


def manifest(hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """What the rollups hold: events per (day, grain, key). As long as days x keys, whatever the number of events."""

    def totals(rollup: DataFrame, grain: str) -> DataFrame:
        counted = rollup.groupBy("event_date", "dim").agg(F.sum("events").alias("total"))
        return counted.select("event_date", F.lit(grain).alias("grain"), "dim", "total")

    return totals(hourly, "hourly").unionByName(totals(daily, "daily"))


def day_verdicts(counts: DataFrame) -> DataFrame:
    """One row per day of a manifest: the events it accounts for, and why it cannot be read (empty if it can)."""

    def of(grain: str, f) -> Column:
        return f(F.when(F.col("grain") == grain, F.col("total")))

    per_day = counts.groupBy("event_date").agg(
        *(of(g, f).alias(f"{g}_{n}") for g in ("hourly", "daily") for n, f in (("keys", F.count), ("min", F.min), ("max", F.max)))
    )
    reason = F.lit("")
    for g in ("hourly", "daily"):
        reason = (
            F.when(F.col(f"{g}_keys") != len(ROLLUP_KEYS), f"{g} rollup lacks a key")
            .when(F.col(f"{g}_min") != F.col(f"{g}_max"), f"{g} keys disagree")
            .otherwise(reason)
        )
    apart = F.col("hourly_min") != F.col("daily_min")
    return per_day.select(
        "event_date",
        F.col("daily_min").alias("total"),
        F.when(reason != "", reason).when(apart, "grains disagree").otherwise("").alias("reason"),
    )


def rollup_health(fact_count: DataFrame, hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """Whether every key of both grains accounts for every event, and if not, why.

    ``fact_count`` is one row with ``fact_events``. Missing keys show in the key count, short ones
    in the minimum and maximum of the per-key totals.
    """

    def per_key(rollup: DataFrame, grain: str) -> DataFrame:
        totals = rollup.groupBy("dim").agg(F.sum("events").alias("total"))
        return totals.agg(
            F.count(F.lit(1)).alias(f"{grain}_keys"),
            F.coalesce(F.min("total"), F.lit(0)).alias(f"{grain}_min"),
            F.coalesce(F.max("total"), F.lit(0)).alias(f"{grain}_max"),
        )

    one = fact_count.join(F.broadcast(per_key(daily, "daily")), how="cross").join(
        F.broadcast(per_key(hourly, "hourly")), how="cross"
    )
    expected = F.lit(len(ROLLUP_KEYS))
    fact = F.col("fact_events")
    reason = (
        F.when((F.col("daily_max") == 0), "rollup is empty")
        .when(F.col("daily_keys") != expected, "daily rollup lacks a key")
        .when(F.col("daily_min") != F.col("daily_max"), "daily keys disagree")
        .when(F.col("hourly_keys") != expected, "hourly rollup lacks a key")
        .when(F.col("hourly_min") != F.col("hourly_max"), "hourly keys disagree")
        .when(F.col("hourly_min") != fact, "hourly rollup does not match the events")
        .when(F.col("daily_min") != fact, "daily rollup does not match the events")
        .when(fact == 0, "no events")
        .otherwise("")
    )
    return one.withColumn("reason", reason).withColumn("ready", F.col("reason") == "")
