"""Where a metric moved: every segment's own move, and which of them explain it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swingtrace.config import T as DEFAULTS
from swingtrace.config import Thresholds, cut_key, sweep_cuts
from swingtrace.functions import stats
from swingtrace.functions.masks import (
    OPEN,
    Mask,
    and_mask,
    exclusion_mask,
    segment_condition,
)
from swingtrace.functions.metrics import METRICS, event_measures, resolve_metric
from swingtrace.operators import baseline as B
from swingtrace.operators.detect import detect
from swingtrace.operators.source import EventSource
from swingtrace.sources.store import materialize

Segment = tuple[str, str]


@dataclass(frozen=True)
class Question:
    """A window and the days it is compared with."""

    start: B.Day
    end: B.Day
    data_start: B.Day

    @property
    def base(self):
        return B.baseline_days(self.start, self.end, self.data_start)

    @property
    def is_inc(self) -> Column:
        return B.in_window(self.start, self.end)

    @property
    def days(self) -> Column:
        return self.is_inc | B.in_days(self.base)


def total_requests(source: EventSource, q: Question) -> DataFrame:
    """One row: all requests of the window, whatever the mask."""
    window = source.grouped(["event_date"], where=q.is_inc)
    return window.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("total_requests"))


def segment_moves(
    daily: DataFrame,
    metric: str,
    q: Question,
    total: Column,
    keys: Sequence[str] = ("dim", "val"),
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """Candidates from daily measures per key.

    Baseline: median of the days present. Window: mean of the days present. The share is of all
    platform requests, so it stays comparable when part of the traffic is masked out.
    """
    m = resolve_metric(metric)
    value = m.value()
    is_base = B.in_days(q.base)
    grouped = daily.groupBy(*keys).agg(
        F.collect_list(F.when(is_base, value)).alias("base_days"),
        F.avg(F.when(q.is_inc, value)).alias("inc_value"),
        F.coalesce(F.sum(F.when(q.is_inc, F.col("events"))), F.lit(0)).alias("inc_requests"),
    )
    kept = grouped.filter(
        (F.size("base_days") > 0)
        & (F.col("inc_requests") >= t.segment_min_requests)
        & F.col("inc_value").isNotNull()
    ).withColumn("base_value", stats.median_of(F.col("base_days")))
    delta = F.col("inc_value") - F.col("base_value")
    share = F.col("inc_requests") / F.greatest(total, F.lit(1)) * F.lit(100.0)
    return kept.select(
        *keys,
        "base_value",
        "inc_value",
        delta.alias("delta_abs"),
        stats.pct_or_zero(delta, F.col("base_value")).alias("delta_pct"),
        (delta * 100.0 if m.has_points else F.lit(None).cast("double")).alias("delta_pp"),
        share.alias("share_pct"),
        (F.abs(delta) * share / F.lit(100.0)).alias("contribution"),
    )


def localize(
    source: EventSource,
    metric: str,
    q: Question,
    mask: Mask = OPEN,
    t: Thresholds = DEFAULTS,
    total: int | None = None,
) -> DataFrame:
    """Every cut of the metric in one pass over the window and its baseline days."""
    daily = source.cells(sweep_cuts(metric), mask, q.days)
    denominator = F.lit(total) if total is not None else total_requests(source, q).scalar()
    return segment_moves(daily, metric, q, denominator, t=t)


def localize_cells(
    cells: DataFrame, metric: str, q: Question, total: int, t: Thresholds = DEFAULTS
) -> DataFrame:
    """The unmasked sweep from stored daily cells."""
    keys = [cut_key(c) for c in sweep_cuts(metric)]
    rows = cells.filter(F.col("dim").isin(*keys) & q.days)
    return segment_moves(rows, metric, q, F.lit(total), t=t)


def move() -> Column:
    """A candidate's move in its own unit: points where it has them, percent otherwise."""
    return F.coalesce("delta_pp", "delta_pct")


def qualifies(
    metric: str, platform_delta: Column | float = 0.0, t: Thresholds = DEFAULTS
) -> Column:
    """Carries enough traffic and moved clearly further than the platform did."""
    excess = F.abs(move() - platform_delta)
    gate = t.cause_pp if METRICS[metric].has_points else t.cause_pct
    return (F.col("share_pct") >= t.cause_share_pct) & (excess >= gate)


def ranked(candidates: DataFrame) -> DataFrame:
    """Largest contribution first. Where parent and child explain the same, the narrower one that moved further leads."""
    explains = F.round("contribution", 9)
    return candidates.orderBy(F.desc(explains), F.desc(F.round(F.abs(move()), 9)), "share_pct", "dim", "val")


def uniformity(candidates: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row: did everything move together? Six numbers and the verdict.

    Segments need 1% of traffic to count, so a cut has at most a hundred of them and the sorted
    list is bounded whatever the data.
    """
    size = F.abs(move())
    moved = candidates.filter((size > t.uniform_move) & (F.col("share_pct") >= t.uniform_share_pct))
    summary = moved.agg(
        F.count(F.lit(1)).alias("segments_moved"),
        F.count_distinct("dim").alias("dimensions"),
        F.min(size).alias("min_move"),
        F.max(size).alias("max_move"),
        stats.upper_median_of(F.collect_list(size)).alias("median_move"),
    )
    ratio = (F.col("max_move") - F.col("min_move")) / F.nullif(F.col("median_move"), F.lit(0.0))
    summary = summary.withColumn("spread_ratio", ratio)
    enough = F.col("segments_moved") >= t.uniform_segments
    together = F.coalesce(F.col("spread_ratio") <= t.uniform_spread, F.lit(False))
    return summary.withColumn("uniform", enough & together)


@dataclass
class Residual:
    """What is left of the candidates once the causes are taken out."""

    causes: list[dict]
    contamination: DataFrame
    normal: DataFrame
    uniform: dict
    rounds: int
    unresolved: DataFrame  # qualifying segments that the allowed rounds left unexplained


def contamination(
    before: DataFrame,
    after: DataFrame,
    metric: str,
    platform_delta: float,
    cause: Segment,
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """Qualifying segments that are back in band once one cause is excluded.

    A segment that vanished from the second sweep is neither cause nor contamination.
    """
    has_points = METRICS[metric].has_points
    band = t.band_pp if has_points else t.band_pct
    suspects = before.filter(qualifies(metric, platform_delta, t)).filter(
        ~((F.col("dim") == cause[0]) & (F.col("val") == cause[1]))
    )
    left = after.select("dim", "val", move().alias("residual"))
    return suspects.join(left, ["dim", "val"]).filter(F.abs("residual") <= band)


def platform_move(
    source: EventSource, metric: str, q: Question, mask: Mask, t: Thresholds = DEFAULTS
) -> float:
    verdict = detect(source, metric, q.start, q.end, q.data_start, mask, t)
    return verdict.select(move().alias("move")).first()["move"]


def _nothing(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.lit(False)).withColumns(
        {"residual": F.lit(None).cast("double"), "round": F.lit(0)}
    )


def residualize(
    source: EventSource,
    metric: str,
    q: Question,
    initial: DataFrame,
    platform_delta: float,
    total: int,
    t: Thresholds = DEFAULTS,
    platform: str = "remainder",
) -> Residual:
    """Take out the largest mover, measure the rest again, repeat.

    Each round is one job; only its top row comes to the driver. After ``t.max_rounds`` of them, what still
    qualifies is in ``unresolved``. With ``platform="remainder"`` the
    platform's move is re-measured on what is left, so that segments at rest do not qualify merely
    because the original platform moved; ``"fixed"`` keeps judging against the original move.
    """
    verdict = uniformity(initial, t).first().asDict()
    calm = F.abs(move()) <= t.uniform_move
    if verdict["uniform"]:
        return Residual([], _nothing(initial), initial.filter(calm), verdict, 0, initial.filter(F.lit(False)))
    causes: list[dict] = []
    cleared: DataFrame | None = None
    mask, current, delta = OPEN, initial, platform_delta
    while len(causes) < t.max_rounds:
        top = ranked(current.filter(qualifies(metric, delta, t))).first()
        if top is None:
            break
        cause = (top["dim"], top["val"])
        causes.append(top.asDict())
        mask = and_mask(mask, exclusion_mask(*cause))
        after = materialize(localize(source, metric, q, mask, t, total), "remainder")
        found = contamination(current, after, metric, delta, cause, t)
        found = found.withColumn("round", F.lit(len(causes)))
        cleared = found if cleared is None else cleared.unionByName(found)
        current = after
        if platform == "remainder":
            delta = platform_move(source, metric, q, mask, t)
    cleared = _nothing(initial) if cleared is None else materialize(cleared, "contamination")
    spark = initial.sparkSession
    named = spark.createDataFrame(
        [(c["dim"], c["val"]) for c in causes], "dim string, val string"
    )
    seen = named.unionByName(cleared.select("dim", "val").distinct())
    normal = initial.join(seen, ["dim", "val"], "left_anti")
    rounds = len(causes)
    order = survival(source, metric, q, [(c["dim"], c["val"]) for c in causes], total, t)
    causes.sort(key=lambda c: -order[(c["dim"], c["val"])])
    for c in causes:
        c["survival"] = order[(c["dim"], c["val"])]
    unresolved = current.filter(qualifies(metric, delta, t))
    return Residual(causes, cleared, normal, verdict, rounds, unresolved)


def survival_moves(
    source: EventSource,
    metric: str,
    q: Question,
    causes: Sequence[Segment],
    total: int,
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """Each cause re-measured on rows that belong to no other cause, all in one job.

    Only a cause's own rows matter, so nothing is fanned out: a row counts for a cause when it is
    inside that one and outside all the others.
    """
    inside = [segment_condition(*c) for c in causes]
    alone = []
    for i, own in enumerate(inside):
        only = own
        for j, other in enumerate(inside):
            if j != i:
                only = only & ~other
        alone.append(only)
    owner = F.coalesce(*(F.when(c, F.lit(i)) for i, c in enumerate(alone)))
    dims = {d for dim, _ in causes for d in dim.split("|")}
    rows = source.rows(dims).filter(q.days).withColumn("cause", owner)
    daily = rows.filter("cause IS NOT NULL").groupBy("cause", "event_date")
    measures = daily.agg(*event_measures())
    return segment_moves(measures, metric, q, F.lit(total), ("cause",), t)


def survival(source, metric, q, causes, total, t=DEFAULTS) -> dict[Segment, float]:
    if len(causes) < 2:
        return {c: float("inf") for c in causes}
    rows = survival_moves(source, metric, q, causes, total, t)
    left = {r["cause"]: r["size"] for r in rows.select("cause", F.abs(move()).alias("size")).collect()}
    return {c: left.get(i, 0.0) for i, c in enumerate(causes)}
