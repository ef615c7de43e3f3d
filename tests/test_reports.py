import datetime as dt
import random

from pyspark.sql import functions as F

from swingtrace import schema
from swingtrace.operators import digest as G
from swingtrace.operators import grounding as N
from swingtrace.operators import telemetry as M
from swingtrace.operators import watch as W

D0 = dt.date(2026, 6, 1)
INCIDENT = (
    "metric string, dim string, val string, start date, end date, days bigint, worst_pct double, "
    "worst_sigma double, requests_per_day bigint"
)


def check(spark, text, values):
    texts = spark.createDataFrame([("t", text)], "id string, text string")
    evidence = spark.createDataFrame(
        [("t", v, s) for v, s in values], "id string, value double, share_pct double"
    )
    return {r["numeral"]: r["grounded"] for r in N.check_grounding(texts, evidence, "id").collect()}


def test_numbers_match_at_the_precision_they_are_printed(spark):
    got = check(
        spark,
        "fell -6.5pp (33.0%) on 19.6% of 80,799 requests, worth $12.30; 6.4 is wrong, 1 and 0 pass",
        [(-6.4632, None), (0.33, 19.5869), (80799.0, None), (12.3, None)],
    )
    assert got == {
        "-6.5": True, "33.0": True, "19.6": True, "80,799": True, "$12.30": True, "6.4": False,
    }


def test_dates_references_and_names_are_not_claims(spark):
    text = "2026-06-23 [e12] os = 'Android 15' 0f8fad5b-d9cb-469f-a165-70867728950e ok"
    assert check(spark, text, []) == {}


def test_repeats_are_counted_once_but_summed(spark):
    texts = spark.createDataFrame([("t", "7 7 7 9")], "id string, text string")
    evidence = spark.createDataFrame([("t", 7.0, None)], "id string, value double, share_pct double")
    checked = N.check_grounding(texts, evidence, "id")
    row = N.grounding_summary(checked, "id").first()
    assert (row["total"], row["grounded"], row["ungrounded"], row["ok"]) == (4, 3, 1, False)


def test_prose_dates(spark):
    df = spark.createDataFrame(
        [("23-25 June and Jun 27, the 27th of 2026: 35 points, 4.4%",)], "text string"
    )
    plain = df.select(N.strip_prose_dates(F.col("text"))).first()[0]
    assert "35 points" in plain and "4.4%" in plain
    assert not any(x in plain for x in ("23", "25", "27", "2026"))


def incident(val, start, end, pct=-20.0, metric="ctr", dim="d"):
    a, b = D0 + dt.timedelta(days=start), D0 + dt.timedelta(days=end)
    return (metric, dim, val, a, b, end - start + 1, pct, pct, 100)


def watch(id, dim=None, val=None, mark=None, user="u", metric="ctr", minute=0):
    at = dt.datetime(2026, 6, 1, 0, minute)
    seen = D0 + dt.timedelta(days=mark) if mark is not None else None
    return (id, user, metric, dim, val, None, "", at, seen)


def test_first_run_hears_only_of_the_latest_and_later_runs_of_all_new(spark):
    incidents = spark.createDataFrame(
        [incident("a", 1, 2), incident("a", 5, 6), incident("b", 8, 9)], INCIDENT
    )
    watches = spark.createDataFrame(
        [watch("new", "d", "a"), watch("seen", "d", "a", 2), watch("all", None, None, 0),
         watch("first"), watch("other", "d", "z")],
        schema.WATCHES,
    )
    matched = W.match_watches(watches, incidents)
    got = sorted((r["watch_id"], (r["day"] - D0).days) for r in matched.collect())
    assert got == [
        ("all", 2), ("all", 6), ("all", 9), ("first", 9), ("new", 6), ("seen", 6),
    ]
    moved = {r["watch_id"]: r["watermark"] for r in W.advance(watches, matched).collect()}
    assert moved["all"] == D0 + dt.timedelta(days=9) and moved["other"] is None
    again = W.match_watches(W.advance(watches, matched), incidents)
    assert again.count() == 0


def test_one_watch_per_user_and_segment(spark):
    rows = [watch("b", minute=5), watch("a", minute=1), watch("c", "d", "x"), watch("d", user="v")]
    kept = W.dedupe_watches(spark.createDataFrame(rows, schema.WATCHES))
    assert {r["watch_id"] for r in kept.collect()} == {"a", "c", "d"}


def test_same_event_is_attached_to_the_strongest_window(spark):
    columns = (
        "metric string, start date, end date, lead_dim string, lead_val string, days bigint, "
        "worst_pct double, worst_sigma double, requests_per_day bigint, correlated bigint, "
        "examples array<string>, severity double"
    )

    def window(metric, a, b, dim, val, pct):
        start, end = D0 + dt.timedelta(days=a), D0 + dt.timedelta(days=b)
        return (metric, start, end, dim, val, b - a + 1, pct, pct, 100, 3, [], abs(pct) * (b - a + 1))

    rows = [
        window("fill_rate", 1, 2, "os", "x", -60.0),
        window("revenue", 1, 2, "os", "y", -50.0),
        window("fill_rate", 2, 4, "os", "x", -11.0),
        window("ctr", 8, 8, "os", "x", 90.0),
    ]
    got = G.rank_group(spark.createDataFrame(rows, columns), 1000.0)
    roles = {(r["metric"], r["start"].day): (r["incident"], r["role"]) for r in got.collect()}
    assert roles[("fill_rate", 2)] == (1, "primary")
    assert roles[("revenue", 2)] == (1, "corroborating")
    assert roles[("fill_rate", 3)] == (1, "corroborating")
    assert roles[("ctr", 9)] == (2, "primary")


def brute(prompts, steps):
    out, gap = set(), dt.timedelta(minutes=3)
    for s in {p[0] for p in prompts}:
        line = sorted((t, i) for ses, i, t in steps if ses == s)
        floor = None
        for _, pid, at, ends in sorted((p for p in prompts if p[0] == s), key=lambda p: (p[2], p[1])):
            inside = [x for x in line if x[0] <= ends]
            if inside and (floor is None or inside[-1][0] >= floor):
                cursor = inside[-1][0]
                for t, i in reversed(inside):
                    if cursor - t > gap or (floor is not None and t < floor):
                        break
                    out.add((pid, i))
                    cursor = t
            floor = ends
    return out


def test_steps_are_attributed_like_a_walk_back(spark):
    rng = random.Random(11)
    t0 = dt.datetime(2024, 1, 1, 20)
    at = lambda: t0 + dt.timedelta(seconds=rng.randrange(0, 40000))
    steps = [(0 if rng.random() < 0.7 else 1, i, at()) for i in range(250)]
    prompts = []
    for i in range(40):
        t = at()
        prompts.append((rng.randrange(2), 1000 + i, t, t + dt.timedelta(seconds=rng.randrange(900))))
    got = M.attribute_steps(
        spark.createDataFrame(prompts, "session long, prompt_id long, at timestamp, ends timestamp"),
        spark.createDataFrame(steps, "session long, step_id long, at timestamp"),
    )
    assert {(r["prompt_id"], r["step_id"]) for r in got.collect()} == brute(prompts, steps)
