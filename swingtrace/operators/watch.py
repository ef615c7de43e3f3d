"""Watches: who wants to hear that it happened again, and what is new for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WATCH_KEY = ("user_id", "metric", "dimension", "value")


def dedupe_watches(watches: DataFrame) -> DataFrame:
    """One watch per user and segment: the first registered."""
    keys = [F.coalesce(F.col(k), F.lit("\u0000")).alias(f"k_{k}") for k in WATCH_KEY]
    fields = [c for c in watches.columns]
    first = F.min_by(F.struct(*fields), F.struct("created_at", "watch_id"))
    return watches.groupBy(*keys).agg(first.alias("w")).select("w.*")


def dedupe_alerts(alerts: DataFrame) -> DataFrame:
    """One alert per (metric, where, day): the first to arrive."""
    where = F.coalesce(F.concat_ws("=", "dimension", "value"), F.lit("")).alias("where")
    first = F.min_by(F.struct(*alerts.columns), F.struct("at", "watch_id"))
    return alerts.groupBy("metric", where, "day").agg(first.alias("a")).select("a.*")


def _latest(incidents: DataFrame, keys: list[str]) -> DataFrame:
    """The incident that ends last; the least severe where several end together."""
    fields = ["start", "end", "worst_pct", "worst_sigma", "requests_per_day", "dim", "val"]
    order = F.struct(
        F.col("end"), -(F.abs("worst_pct") * F.col("days")), F.col("dim"), F.col("val")
    )
    picked = incidents.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), order).alias("i"), F.max("end").alias("last_end")
    )
    return picked.select(*(F.col(k).alias(f"on_{k}") for k in keys), "i", "last_end")


def match_watches(watches: DataFrame, incidents: DataFrame) -> DataFrame:
    """Incidents that end after a watch's own cursor, each once.

    A watch that has never reported hears only of the latest incident, so it meets one
    pre-aggregated row per segment (or per metric, for a watch on the platform). A watch with a cursor
    first meets the days on which incidents of its metric or segment end, one row each, and only on
    those after its cursor the incidents themselves: what is between is bounded by watches x days and
    by the result, and a metric's incidents are dealt out by day.
    """
    incidents = incidents.withColumnRenamed("metric", "inc_metric")
    fields = ["start", "end", "worst_pct", "worst_sigma", "requests_per_day", "dim", "val"]
    on_segment = F.col("dimension").isNotNull()
    new, known = watches.filter("watermark IS NULL"), watches.filter("watermark IS NOT NULL")

    by_segment = _latest(incidents, ["inc_metric", "dim", "val"])
    by_metric = _latest(incidents, ["inc_metric"])
    same_segment = (
        (F.col("metric") == F.col("on_inc_metric"))
        & (F.col("dimension") == F.col("on_dim"))
        & (F.col("value") == F.col("on_val"))
    )
    first_segment = new.filter(on_segment).join(by_segment, same_segment)
    first_metric = new.filter(~on_segment).join(
        by_metric, F.col("metric") == F.col("on_inc_metric")
    )
    again_segment = _since(known.filter(on_segment), incidents, fields, ("metric", "dimension", "value"))
    again_metric = _since(known.filter(~on_segment), incidents, fields, ("metric",))
    out = ["watch_id", "user_id", "metric", "dimension", "value", "watermark", "i"]
    parts = [p.select(*out) for p in (first_segment, first_metric, again_segment, again_metric)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.select(
        *out[:-1],
        F.col("i.dim").alias("inc_dim"),
        F.col("i.val").alias("inc_val"),
        F.col("i.end").alias("day"),
        F.col("i.worst_pct").alias("pct"),
        F.col("i.worst_sigma").alias("sigma"),
        F.col("i.requests_per_day").alias("requests_per_day"),
    )


def _since(watches: DataFrame, incidents: DataFrame, fields: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Each watch with every incident of its key that ends after its cursor, as ``i``."""
    of = dict(zip(("metric", "dimension", "value"), ("inc_metric", "dim", "val")))
    renamed = [F.col(of[k]).alias(k) for k in keys]
    days = incidents.select(*renamed, F.col("end").alias("end_day")).distinct()
    due = watches.join(days, list(keys)).filter(F.col("end_day") > F.col("watermark"))
    listed = incidents.select(*renamed, F.col("end").alias("end_day"), F.struct(*fields).alias("i"))
    return due.join(listed, [*keys, "end_day"])


def advance(watches: DataFrame, matched: DataFrame) -> DataFrame:
    """Every watch with its cursor moved to the last incident it was told about."""
    seen = matched.groupBy("watch_id").agg(F.max("day").alias("seen"))
    moved = watches.join(seen, "watch_id", "left")
    cursor = F.coalesce("seen", "watermark")
    return moved.withColumn("watermark", cursor).drop("seen")
