import datetime as dt
import random

import pytest

from swingtrace.config import T
from swingtrace.operators import detect as D

D0 = dt.date(2026, 6, 1)
FIRING = (
    "metric string, dim string, val string, day date, actual double, baseline double, pct double, "
    "sigma double, requests bigint"
)
INCIDENT = (
    "metric string, dim string, val string, start date, end date, days bigint, worst_pct double, "
    "worst_sigma double, requests_per_day bigint"
)


def firing(val, day, pct=-20.0, requests=200):
    return ("m", "d", val, D0 + dt.timedelta(days=day), 0.0, 0.0, pct, pct, requests)


def test_consecutive_days_are_one_incident_and_a_gap_splits(spark):
    rows = [firing("a", d) for d in (3, 4, 5)] + [firing("a", 7, 30.0, 101), firing("b", 4)]
    got = D.group_incidents(spark.createDataFrame(rows, FIRING))
    spans = {(r["val"], r["start"].day, r["end"].day, r["days"]) for r in got.collect()}
    assert spans == {("a", 4, 6, 3), ("a", 8, 8, 1), ("b", 5, 5, 1)}


def test_worst_day_is_the_first_of_equals(spark):
    rows = [firing("a", 1, -20.0), firing("a", 2, 30.0), firing("a", 3, -30.0)]
    one = D.group_incidents(spark.createDataFrame(rows, FIRING)).first()
    assert one["worst_pct"] == 30.0


def walk(incidents):
    """The ordered merge, one incident after the other."""
    out = {}
    by_metric = {}
    for i in incidents:
        by_metric.setdefault(i[0], []).append(i)
    for metric, group in by_metric.items():
        group.sort(key=lambda i: (i[3], -abs(i[6]) * i[5], i[1], i[2]))
        clusters, first, reach = [], None, None
        for i in group:
            if first is None or i[3] > reach or (i[4] - first).days > T.window_span_days:
                clusters.append([])
                first, reach = i[3], i[4]
            clusters[-1].append(i)
            reach = max(reach, i[4])
        for c in clusters:
            lead = c[0]
            for i in c:
                if abs(i[6]) * i[5] > abs(lead[6]) * lead[5]:
                    lead = i
            key = (metric, min(i[3] for i in c), lead[1], lead[2])
            out[key] = (max(i[4] for i in c), len(c))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_clustering_equals_the_one_by_one_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for n in range(120):
        start = rng.randrange(0, 40)
        length = rng.choice([1, 1, 2, 3, 7, 8, 9, 12])
        pct = rng.choice([-50.0, 50.0, -12.5, 80.0])
        rows.append(
            (
                rng.choice("mn"), rng.choice("de"), f"v{n}", D0 + dt.timedelta(days=start),
                D0 + dt.timedelta(days=start + length - 1), length, pct, pct / 2, 100,
            )
        )
    got = D.cluster_windows(spark.createDataFrame(rows, INCIDENT))
    found = {
        (r["metric"], r["start"], r["lead_dim"], r["lead_val"]): (r["end"], r["correlated"])
        for r in got.collect()
    }
    assert found == walk(rows)


def test_a_long_incident_does_not_stretch_the_next_window(spark):
    """The running end starts anew with every cluster."""
    day = lambda n: D0 + dt.timedelta(days=n)
    rows = [
        ("m", "d", "long", day(0), day(11), 12, -90.0, -9.0, 100),
        ("m", "d", "next", day(5), day(13), 9, -20.0, -5.0, 100),
        ("m", "d", "late", day(12), day(12), 1, -20.0, -5.0, 100),
    ]
    got = D.cluster_windows(spark.createDataFrame(rows, INCIDENT)).collect()
    assert {(r["lead_val"], r["end"]) for r in got} == {("long", day(11)), ("next", day(13))}


def test_examples_are_the_three_largest(spark):
    rows = [
        ("m", "d", f"v{i}", D0, D0, 1, float(p), 5.0, 100) for i, p in enumerate((12, -40, 25, 31))
    ]
    one = D.cluster_windows(spark.createDataFrame(rows, INCIDENT)).first()
    assert one["examples"] == ["d='v1' -40%", "d='v3' +31%", "d='v2' +25%"]


def daily(spark, values):
    rows = [(D0 + dt.timedelta(days=d), 100, int(100 * v), 50, 5, 10.0) for d, v in values.items()]
    return spark.createDataFrame(
        rows,
        "event_date date, events bigint, fills bigint, impressions bigint, clicks bigint, revenue double",
    )


def test_one_prior_week_is_refused(spark):
    frame = daily(spark, {0: 0.7, 7: 0.1})
    row = D.detect_rows(frame, "fill_rate", "2026-06-08", "2026-06-08").first()
    assert not row["anomalous"] and row["reason"].startswith("Comparable days")


def test_small_move_is_not_an_anomaly_however_stable_the_past(spark):
    frame = daily(spark, {0: 0.7, 7: 0.7, 14: 0.7, 21: 0.69})
    row = D.detect_rows(frame, "fill_rate", "2026-06-22", "2026-06-22").first()
    assert not row["anomalous"] and row["floored"]
    frame = daily(spark, {0: 0.7, 7: 0.7, 14: 0.7, 21: 0.6})
    row = D.detect_rows(frame, "fill_rate", "2026-06-22", "2026-06-22").first()
    assert row["anomalous"] and row["delta_pp"] == pytest.approx(-10.0)


def test_segment_history_has_no_self_join(spark, folded):
    """One shuffle for the cells and one for the history: no join of the cells with themselves."""
    from swingtrace.config import sweep_cuts

    plan = D.segment_scan(folded.cells(sweep_cuts()), {}, ["fill_rate"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Generate posexplode") == 1
    assert "CartesianProduct" not in text


def test_recall_counts_found_missed_and_extra(spark):
    platform = spark.createDataFrame(
        [("fill_rate", D0), ("ecpm", D0 + dt.timedelta(days=3))], "metric string, day date"
    )
    segments = spark.createDataFrame([("rpr", D0 + dt.timedelta(days=1))], "metric string, day date")
    known = spark.createDataFrame(
        [
            ("a", "fill_rate", D0),
            ("b", "rpr", D0 + dt.timedelta(days=1)),
            ("c", "ctr", D0 + dt.timedelta(days=2)),
        ],
        "label string, metric string, day date",
    )
    rows = D.recall_scan(platform, segments, known).collect()
    got = {(r["outcome"], r["label"] or r["metric"], r["segment_only"]) for r in rows}
    assert got == {
        ("found", "a", False), ("found", "b", True), ("missed", "c", False), ("extra", "ecpm", False),
    }
