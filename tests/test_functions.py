import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from swingtrace.config import ROLLUP_CUTS, ROLLUP_KEYS, dimensions_for, sweep_cuts
from swingtrace.functions import masks, stats
from swingtrace.functions.metrics import METRICS, QueryError, check_dimension, resolve_metric
from swingtrace.functions.ordered import last_before
from swingtrace.operators import baseline as B


def test_rollup_has_47_cuts_and_carries_every_sweep_cut():
    assert len(ROLLUP_CUTS) == len(set(ROLLUP_KEYS)) == 47
    assert {"|".join(c) for c in sweep_cuts()} <= set(ROLLUP_KEYS)
    assert len(sweep_cuts("revenue")) == 17 and len(sweep_cuts("fill_rate")) == 14


def test_ratio_is_null_on_zero_denominator(spark):
    row = spark.createDataFrame([(0, 0, 0, 0, 0.0)], "events long, fills long, impressions long, clicks long, revenue double")
    got = row.select(*(METRICS[m].value().alias(m) for m in METRICS)).first()
    assert got["revenue"] == 0.0 and got["requests"] == 0.0
    assert all(got[m] is None for m in ("fill_rate", "render_rate", "ctr", "ecpm", "rpr"))


@pytest.mark.parametrize("xs", [[1.0], [4.0, 1.0], [3.0, 1.0, 2.0], [1.0, 2.0, 10.0, 4.0], []])
def test_medians(spark, xs):
    df = spark.createDataFrame([(xs,)], "xs array<double>")
    mid, upper = df.select(
        stats.median_of(F.col("xs")), stats.upper_median_of(F.col("xs"))
    ).first()
    assert mid == (statistics.median(xs) if xs else None)
    assert upper == (sorted(xs)[len(xs) // 2] if xs else None)


def test_spread_floor_is_reported(spark):
    points = [(1, 100.0), (2, 100.0), (3, 100.0)]
    df = spark.createDataFrame([(points,)], "p array<struct<weeks:int,v:double>>")
    base = df.select(B.trend_baseline(F.col("p"), F.lit(0.0)).alias("b")).first()["b"]
    assert (base["centre"], base["spread"], base["floored"]) == (100.0, 0.5, True)


def test_median_resists_one_wild_week(spark):
    points = [(1, 10.0), (2, 11.0), (3, 9.0), (4, 1000.0)]
    df = spark.createDataFrame([(points,)], "p array<struct<weeks:int,v:double>>")
    base = df.select(B.trend_baseline(F.col("p"), F.lit(0.0)).alias("b")).first()["b"]
    assert base["centre"] == 10.5 and not base["floored"]


def test_growth_needs_fourteen_days_and_a_plausible_fit(spark):
    def growth(values):
        points = [(float(i), v) for i, v in enumerate(values)]
        df = spark.createDataFrame([(points,)], "p array<struct<x:double,y:double>>")
        return df.select(stats.weekly_growth(F.col("p"))).first()[0]

    import math

    steady = [math.log(100 * 1.05 ** (i / 7)) for i in range(21)]
    assert growth(steady) == pytest.approx(0.05, abs=1e-9)
    assert growth(steady[:13]) == 0.0
    assert growth([math.log(100 * 1.5 ** (i / 7)) for i in range(21)]) == 0.0


def test_baseline_days_are_same_weekdays_outside_the_window():
    got = B.baseline_days("2026-06-23", "2026-06-30", "2026-06-01")
    window = set(B.days_between("2026-06-23", "2026-06-30"))
    assert not window & set(got)
    assert all(d >= dt.date(2026, 6, 1) for d in got)
    assert B.baseline_days("2026-06-03", "2026-06-03", "2026-06-01") == []


@pytest.mark.parametrize(
    "start,end",
    [("2026-06-10", "2026-06-09"), ("2026-05-01", None), ("June", None), ("2026-06-01", "2026-06-30")],
)
def test_window_guard(start, end):
    data = (dt.date(2026, 6, 1), dt.date(2026, 7, 5))
    with pytest.raises(QueryError):
        B.check_window(start, end, data, max_days=14)


def test_dimension_guard():
    assert check_dimension("ecpm", "advertiser_id") == "advertiser_id"
    for metric, dim in (("fill_rate", "advertiser_id"), ("ecpm", "geo_device_id"), ("ecpm", "x")):
        with pytest.raises(QueryError):
            check_dimension(metric, dim)
    with pytest.raises(QueryError):
        resolve_metric("nope")
    assert "advertiser_id" not in dimensions_for("requests")


@pytest.mark.parametrize(
    "filters", [{"region": []}, {"region": "*"}, {"region": 3}, {"region|country": "x"}, {"bad": "x"}]
)
def test_meaningless_filters_are_refused(filters, spark):
    with pytest.raises(QueryError):
        masks.scope(filters, "ecpm")


def test_masks_partition_the_rows(spark):
    rows = spark.createDataFrame(
        [("a", "x"), ("a", "y"), ("b", "x"), ("", "")], "region string, country string"
    )
    inside = masks.segment_mask("region|country", "a|x")
    outside = masks.exclusion_mask("region|country", "a|x")
    assert inside.apply(rows).count() == 1 and outside.apply(rows).count() == 3
    both = masks.exclude_all([("region", "a"), ("country", "x")])
    assert both.apply(rows).count() == 1 and both.dims == ("region", "country")


def test_last_before_equals_a_plain_scan_on_a_hot_key(spark):
    rng = random.Random(3)
    rows, t0 = [], dt.datetime(2024, 1, 1)
    for i in range(400):
        key = 0 if rng.random() < 0.6 else rng.randrange(1, 5)
        at = t0 + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 6))
        rows.append((key, i, at, rng.choice([None, float(i)])))
    df = spark.createDataFrame(rows, "k int, id int, at timestamp, v double")
    df = df.withColumn("day", F.to_date("at"))
    for inclusive in (False, True):
        got = last_before(df, ["k"], "day", ["at", "id"], F.col("v"), "prev", inclusive)
        found = {r["id"]: r["prev"] for r in got.collect()}
        want = {}
        for k in range(5):
            last = None
            for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
                if inclusive and r[3] is not None:
                    last = r[3]
                want[r[1]] = last
                if not inclusive and r[3] is not None:
                    last = r[3]
        assert found == want
