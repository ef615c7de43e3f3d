"""Why it moved: revenue identity, kind of cause, whether it matters and whether it is over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swingtrace.config import FUNNEL_STEPS, OWNERS, Thresholds
from swingtrace.config import T as DEFAULTS
from swingtrace.functions import stats
from swingtrace.functions.masks import Mask
from swingtrace.functions.metrics import resolve_metric
from swingtrace.operators import baseline as B
from swingtrace.operators.localize import Question
from swingtrace.operators.source import EventSource
from swingtrace.sources.store import materialize

FACTORS = ("requests", "fill_rate", "render_rate", "ecpm")


def identity_sides(daily: DataFrame, q: Question, keys: Sequence[str] = ()) -> DataFrame:
    """Median day of the window and its weekday-matched normal, component by component.

    Every baseline day serves the window days 1-4 weeks after it; per window day the components'
    medians are its normal, and the medians of those are the baseline side.
    """
    parts = ("events", "fills", "impressions", "revenue")
    inc = q.is_inc
    shifted = F.transform(
        F.sequence(F.lit(1), F.lit(DEFAULTS.baseline_weeks)),
        lambda k: F.date_add("event_date", (k * 7).cast("int")),
    )
    serves = F.when(inc, F.array("event_date")).otherwise(
        F.filter(shifted, lambda d: d.between(F.lit(B.as_date(q.start)), F.lit(B.as_date(q.end))))
    )
    rows = daily.filter(q.days).select(
        *keys, inc.alias("is_inc"), *parts, F.explode(serves).alias("day")
    )
    per_day = rows.groupBy(*keys, "is_inc", "day").agg(*(F.median(p).alias(p) for p in parts))
    return per_day.groupBy(*keys).agg(
        *(F.median(F.when(~F.col("is_inc"), F.col(p))).alias(f"base_{p}") for p in parts),
        *(F.median(F.when(F.col("is_inc"), F.col(p))).alias(f"inc_{p}") for p in parts),
    )


def _factors(side: str) -> dict[str, Column]:
    def part(name: str) -> Column:
        return F.col(f"{side}_{name}").cast("double")

    def rate(a: str, b: str) -> Column:
        return F.coalesce(part(a) / F.nullif(part(b), F.lit(0.0)), F.lit(0.0))

    return {
        "requests": part("events"),
        "fill_rate": rate("fills", "events"),
        "render_rate": rate("impressions", "fills"),
        "ecpm": rate("revenue", "impressions") * F.lit(1000.0),
    }


def decompose_rows(daily: DataFrame, q: Question, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue per day as requests x fill x render x eCPM, dollars per factor.

    The factors are swapped one by one from baseline to window in funnel order; the factor with the
    largest effect is the driver. Four rows per key.
    """
    base, inc = _factors("base"), _factors("inc")
    swaps = range(len(FACTORS) + 1)
    one = identity_sides(daily, q, keys).select(
        *keys,
        "base_revenue",
        "inc_revenue",
        *(base[f].alias(f"b_{f}") for f in FACTORS),
        *(inc[f].alias(f"i_{f}") for f in FACTORS),
    )

    def revenue(upto: int) -> Column:
        a, b, c, d = (F.col(f"{'i' if k < upto else 'b'}_{f}") for k, f in enumerate(FACTORS))
        return a * b * c * (d / F.lit(1000.0))

    one = one.withColumns({f"rev_{k}": revenue(k) for k in swaps})
    one = one.withColumns(
        {f"effect_{k}": F.col(f"rev_{k + 1}") - F.col(f"rev_{k}") for k in swaps[:-1]}
    )
    effects = [F.col(f"effect_{k}") for k in swaps[:-1]]
    largest = F.greatest(*(F.abs(e) for e in effects))
    driver = F.coalesce(*(F.when(F.abs(e) == largest, f) for e, f in zip(effects, FACTORS)))
    delta = F.col("inc_revenue") - F.col("base_revenue")
    explained = effects[0] + effects[1] + effects[2] + effects[3]
    one = one.withColumns(
        {"driver": driver, "revenue_delta": delta, "residual": delta - explained}
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(k + 1).alias("step"),
                F.lit(f).alias("factor"),
                F.col(f"b_{f}").alias("base_value"),
                F.col(f"i_{f}").alias("inc_value"),
                stats.pct_or_zero(F.col(f"i_{f}") - F.col(f"b_{f}"), F.col(f"b_{f}")).alias(
                    "delta_pct"
                ),
                effects[k].alias("revenue_effect"),
                (F.col("driver") == f).alias("is_driver"),
            )
            for k, f in enumerate(FACTORS)
        )
    )
    totals = ("base_revenue", "inc_revenue", "revenue_delta", "residual")
    return one.select(*keys, *totals, F.explode(rows).alias("r")).select(*keys, "r.*", *totals)


def decompose(source: EventSource, q: Question, mask: Mask) -> DataFrame:
    daily = source.grouped(["event_date"], mask=mask, where=q.days)
    return decompose_rows(daily, q)


def explain_revenue(source: EventSource, q: Question, mask: Mask) -> DataFrame:
    """The identity under a filter, for a question that names its own scope."""
    return decompose(source, q, mask)


def classify_signals(source: EventSource, q: Question, mask: Mask) -> DataFrame:
    """One row of signals on a cause: advertisers, render rate, eCPM, requests, before and during.

    Distinct advertisers do not add up over days, so they are counted per day and the median day
    speaks for each side. Rows are first reduced to one per day and advertiser; every count after
    that is over the reduced rows.
    """
    rows = mask.apply(source.rows({*mask.dims}).filter(q.days))
    reduced = rows.groupBy("event_date", "advertiser_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("is_filled").alias("fills"),
        F.sum("is_impression").alias("impressions"),
        F.sum("revenue").alias("revenue"),
    )
    inc = q.is_inc
    reduced = materialize(reduced, "day-advertiser")
    # distinct over the whole side, used where the median day has nobody
    present = reduced.filter("advertiser_id != ''").groupBy("advertiser_id")
    sides = present.agg(F.bool_or(inc).alias("inc"), F.bool_or(~inc).alias("base"))
    pooled = sides.agg(F.count_if("inc").alias("inc"), F.count_if("base").alias("base"))

    def pair(name: str, inc_value: Column, base_value: Column) -> list[Column]:
        return [inc_value.alias(f"{name}_inc"), base_value.alias(f"{name}_base")]

    def sums(column: str, side: Column) -> Column:
        return F.sum(F.when(side, F.col(column))).cast("double")

    def rate(a: str, b: str, side: Column) -> Column:
        return F.coalesce(sums(a, side) / F.nullif(sums(b, side), F.lit(0.0)), F.lit(0.0))

    def middle(column: str, side: Column) -> Column:
        return F.coalesce(F.median(F.when(side, F.col(column))), F.lit(0.0))

    def bidding(side: Column, name: str) -> Column:
        typical = F.floor(middle("advertisers", side) + F.lit(0.5))
        everyone = pooled.select(name).scalar()
        return F.when(typical != 0, typical).otherwise(everyone).cast("double")

    daily = reduced.groupBy("event_date").agg(
        F.count(F.when(F.col("advertiser_id") != "", 1)).alias("advertisers"),
        *(F.sum(c).alias(c) for c in ("requests", "fills", "impressions", "revenue")),
    )
    return daily.agg(
        *pair("advertisers", bidding(inc, "inc"), bidding(~inc, "base")),
        *pair("render", rate("impressions", "fills", inc), rate("impressions", "fills", ~inc)),
        *pair(
            "ecpm",
            rate("revenue", "impressions", inc) * 1000.0,
            rate("revenue", "impressions", ~inc) * 1000.0,
        ),
        *pair("requests", middle("requests", inc), middle("requests", ~inc)),
    )


def classify(signals: DataFrame, driver: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """The signals with the channel they point to; rules in order, first match wins."""

    def pct(name: str) -> Column:
        inc, base = F.col(f"{name}_inc"), F.col(f"{name}_base")
        return stats.pct_or_zero(inc - base, base)

    out = signals.withColumns(
        {
            "advertisers_pct": pct("advertisers"),
            "render_pp": (F.col("render_inc") - F.col("render_base")) * 100.0,
            "ecpm_pct": pct("ecpm"),
            "requests_pct": pct("requests"),
        }
    )
    is_driver = {f: F.lit(driver == f) for f in FACTORS}
    rules = (
        (F.col("advertisers_pct") <= t.classify_advertisers_pct, "demand_change", "advertisers left"),
        (
            is_driver["requests"] | (F.abs("requests_pct") >= t.classify_requests_pct),
            "supply_change",
            "request volume moved",
        ),
        (F.col("render_pp") <= t.classify_render_pp, "technical_break", "fills stopped rendering"),
        (is_driver["fill_rate"], "technical_break", "requests stopped filling"),
        (
            is_driver["ecpm"] | (F.abs("ecpm_pct") >= t.classify_ecpm_pct),
            "demand_change",
            "price moved",
        ),
    )
    channel, basis = None, None
    for condition, name, why in rules:
        channel = F.when(condition, name) if channel is None else channel.when(condition, name)
        basis = F.when(condition, why) if basis is None else basis.when(condition, why)
    out = out.withColumn("channel", channel.otherwise("demand_change"))
    out = out.withColumn("basis", basis.otherwise("no matching supply or delivery signal"))
    owners = F.create_map(*(F.lit(x) for kv in OWNERS.items() for x in kv))
    return out.withColumn("owner", owners[F.col("channel")])


def material(t: Thresholds = DEFAULTS) -> Column:
    """Large enough to report: by share of traffic, or by platform points moved."""
    points = F.abs("delta_pct") * F.col("share_pct") / 100.0
    return (F.col("share_pct") >= t.material_share_pct) | (points >= t.material_platform_pp)


def is_material(cause: dict, t: Thresholds = DEFAULTS) -> bool:
    points = abs(cause["delta_pct"]) * cause["share_pct"] / 100.0
    return cause["share_pct"] >= t.material_share_pct or points >= t.material_platform_pp


def recovery(
    series: DataFrame,
    start: B.Day | Column,
    end: B.Day | Column,
    keys: Sequence[str] = (),
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """Whether a movement is over, from a series ``(keys, d, v)``.

    A day's normal is the median of its own same-weekday priors. Movement under the gate, or without
    history, is not applicable; otherwise the first later day back inside the gate, in the direction
    of the movement, is the recovery.
    """
    first = start if isinstance(start, Column) else F.lit(B.as_date(start))
    last = end if isinstance(end, Column) else F.lit(B.as_date(end))
    judged = B.prior_weeks(series.filter("v IS NOT NULL"), list(keys))
    priors = F.transform("points", lambda p: p["v"])
    normal = F.when(F.size("points") >= t.min_baseline_days, stats.median_of(priors))
    judged = judged.withColumn("normal", normal)
    dev = (F.col("v") - F.col("normal")) / F.nullif(F.abs("normal"), F.lit(0.0)) * 100.0
    judged = judged.withColumn("dev", dev)
    # one element per calendar day
    days = F.array_sort(F.collect_list(F.struct("d", "v", "normal", "dev")))
    out = judged.groupBy(*keys).agg(days.alias("days"))
    inside = F.filter("days", lambda x: x["d"].between(first, last))
    moves = F.transform(F.filter(inside, lambda x: x["dev"].isNotNull()), lambda x: x["dev"])
    out = out.withColumn("window_dev", stats.median_of(moves))
    out = out.withColumn("window_days", F.size(inside))

    def back(x: Column) -> Column:
        dropped = F.col("window_dev") < 0
        ok = F.when(dropped, x["dev"] > -t.recovery_pct).otherwise(x["dev"] < t.recovery_pct)
        return F.coalesce(ok, F.lit(False))

    later = F.filter("days", lambda x: x["d"] > last)
    out = out.withColumn("later_days", F.size(later))
    out = out.withColumn("recovered_on", F.try_element_at(F.filter(later, back), F.lit(1))["d"])
    affected = F.filter(
        "days", lambda x: (x["d"] >= first) & (x["d"] < F.col("recovered_on")) & ~back(x)
    )
    out = out.withColumn("ran", F.size(affected))
    idle = F.col("window_dev").isNull() | (F.abs("window_dev") < t.recovery_pct)
    over = F.col("recovered_on").isNotNull()
    return out.select(
        *keys,
        F.when(idle, "not_applicable").when(over, "recovered").otherwise("ongoing").alias("status"),
        "window_dev",
        F.when(~idle, F.col("recovered_on")).alias("recovered_on"),
        F.when(idle, F.lit(None).cast("int"))
        .when(over, F.col("ran"))
        .otherwise(F.col("window_days") + F.col("later_days"))
        .alias("days_running"),
    )


def priority(rows: DataFrame) -> DataFrame:
    """What to do about it: from ``channel, status, metric, per_day, days_running``."""
    idle = F.col("channel").isin("no_anomaly", "seasonality", "mix_shift")
    owners = F.create_map(*(F.lit(x) for kv in OWNERS.items() for x in kv))
    located = {
        name: f"{kind}:{a}->{b}" if b else f"{kind}:{a}"
        for name, (kind, a, b) in FUNNEL_STEPS.items()
    }
    where = F.create_map(*(F.lit(x) for kv in located.items() for x in kv))
    live = F.col("status") == "ongoing"
    return rows.withColumns(
        {
            "priority": F.when(idle, "none")
            .when(live, "act_now")
            .when(F.col("status") == "recovered", "post_mortem")
            .otherwise("monitor"),
            "owner": owners[F.col("channel")],
            "lost_so_far": F.round(F.col("per_day") * F.col("days_running"), 2),
            "recoverable_per_day": F.when(live, F.col("per_day")).otherwise(F.lit(0.0)),
            "where_in_funnel": F.coalesce(where[F.col("metric")], F.lit("unknown")),
        }
    )


def recover_series(source: EventSource, metric: str, mask: Mask, start: B.Day | None = None) -> DataFrame:
    """The daily series from the first day that the normal of ``start`` looks back to."""
    m = resolve_metric(metric)
    since = None if start is None else F.col("event_date") >= F.lit(B.history_start(start))
    daily = source.grouped(["event_date"], mask=mask, where=since)
    return daily.select(F.col("event_date").alias("d"), m.value().alias("v"))
