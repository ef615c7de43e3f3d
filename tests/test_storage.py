import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from swingtrace import schema
from swingtrace.config import ROLLUP_CUTS
from swingtrace.operators import quality as V
from swingtrace.operators import rollup as R
from swingtrace.operators.source import EventSource, RollupSource
from swingtrace.sources import adapter as A
from swingtrace.sources import ingest


@pytest.fixture(scope="module")
def rolled(spark, sf, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("rollup"))
    star = A.star(spark, sf)
    from swingtrace.operators.enrich import enrich_star

    events = enrich_star(star.fact, star.apps, star.advertisers, star.geo_device)
    hourly, daily = ingest.write_rollups(events, f"{base}/h", f"{base}/d")
    return RollupSource(hourly, daily, star=star)


def test_reloading_days_changes_nothing(spark, sf, tmp_path):
    fact, target = A.ad_events(spark, sf), str(tmp_path / "t")
    first = ingest.replace_days(fact, target)
    before = {r[0]: r[1] for r in ingest.day_counts(first).collect()}
    again = ingest.replace_days(fact, target, [dt.date(2026, 6, 3)])
    assert {r[0]: r[1] for r in ingest.day_counts(again).collect()} == before
    ingest.assert_days(ingest.by_day(fact), again)


def test_missing_days_are_pending_and_fail_the_assertion(spark, sf, tmp_path):
    fact = A.ad_events(spark, sf)
    loaded = ingest.replace_days(fact, str(tmp_path / "t"), [dt.date(2026, 6, 3)])
    pending = ingest.pending_days(ingest.by_day(fact), loaded)
    assert pending.count() == 34
    with pytest.raises(ValueError):
        ingest.assert_days(ingest.by_day(fact), loaded)


def test_a_day_is_one_directory(spark, sf, tmp_path):
    target = str(tmp_path / "t")
    ingest.write_days(A.ad_events(spark, sf), target)
    days = [d for d in os.listdir(target) if d.startswith("event_date=")]
    assert len(days) == 35


def test_malformed_dimension_row_fails_the_load(spark, tmp_path):
    path = tmp_path / "apps.csv"
    path.write_text("app_id,category,publisher_tier\na,games,tier_1\nb,news\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest.load_dim(spark, str(path), schema.APPS).collect()


def test_half_written_json_line_is_skipped(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text(
        '{"at":"2026-06-01T00:00:00.000000Z","metric":"ctr","pct":-12.0}\n'
        '{"at":"2026-06-02T00:00:00.000000Z","metric":"ctr","pct":-13.0}\n{"at":"2026-06-03T00:'
    )
    rows = ingest.read_jsonl(spark, str(path), schema.NOTIFICATIONS)
    assert [r["pct"] for r in rows.collect()] == [-13.0, -12.0]
    assert ingest.read_jsonl(spark, str(path), schema.NOTIFICATIONS, "2026-06-01").count() == 1


def test_every_cut_accounts_for_every_event(rolled, folded):
    n = folded.rows(()).count()
    totals = rolled.daily.groupBy("dim").agg(F.sum("events").alias("n")).collect()
    assert len(totals) == len(ROLLUP_CUTS) and {r["n"] for r in totals} == {n}


def test_compacting_first_gives_the_same_cells(folded):
    rows, by = folded.rows(), ("event_date", "event_hour")
    ints = ("events", "fills", "impressions", "clicks")
    compared = V.frame_parity(
        R.cells(rows, ROLLUP_CUTS, by), R.compact_cells(rows, ROLLUP_CUTS, by),
        [*by, "dim", "val"], ints, ("revenue",),
    )
    row = V.parity_summary(compared, "compact").first()
    assert row["n_keys"] > 0 and row["mismatches"] == 0


def test_health_names_what_is_wrong(spark, rolled):
    counted = rolled.rows(()).agg(F.count(F.lit(1)).alias("fact_events"))

    def reason(hourly, daily):
        return R.rollup_health(counted, hourly, daily).first()["reason"]

    assert reason(rolled.hourly, rolled.daily) == ""
    no_key = rolled.daily.filter("dim <> 'region'")
    assert reason(rolled.hourly, no_key) == "daily rollup lacks a key"
    short = rolled.daily.filter("NOT (dim = 'region' AND val = 'ASIA')")
    assert reason(rolled.hourly, short) == "daily keys disagree"
    late = rolled.hourly.filter("event_date < '2026-07-05'")
    assert reason(late, rolled.daily) == "hourly rollup does not match the events"
    assert reason(rolled.hourly, rolled.daily.limit(0)) == "rollup is empty"


def test_cut_keys_ignore_order_and_refuse_what_is_not_carried():
    assert R.rollup_key(["os_version", "region"]) == R.rollup_key(["region", "os_version"])
    assert R.rollup_key([]) == "ad_format"
    assert R.rollup_key(["app_id", "region"]) is None
    assert R.rollup_key(["region", "country", "os_version"]) is None


@pytest.mark.parametrize("dims", [(), ("region",), ("os_version", "app_category"), ("app_id", "region")])
def test_rollup_answers_equal_event_answers(rolled, folded, dims):
    keys = [*dims, "event_date"]
    ints = ("events", "fills", "impressions", "clicks")
    compared = V.frame_parity(
        folded.grouped(keys, dims), rolled.grouped(keys, dims), keys, ints, ("revenue",)
    )
    row = V.parity_summary(compared, "p").first()
    assert row["n_keys"] > 0 and row["mismatches"] == 0
    expected = "raw" if dims == ("app_id", "region") else "rollup:daily"
    assert rolled.served_from(dims) == expected


def test_parity_reports_one_sided_keys(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("y", 2, 2.0)], "k string, n int, v double")
    b = spark.createDataFrame([("x", 1, 1.0 + 1e-12), ("z", 2, 2.0)], "k string, n int, v double")
    row = V.parity_summary(V.frame_parity(a, b, ["k"], ["n"], ["v"]), "p").first()
    assert (row["n_keys"], row["mismatches"], row["one_sided"]) == (3, 2, 2)


def test_empty_keys_never_match_a_dimension(spark):
    from swingtrace.operators.enrich import lookup

    fact = spark.createDataFrame(
        [("2026-06-01 00:00:00", "a", "g", ""), ("2026-06-01 01:00:00", "a", "g", "x"),
         ("2026-06-01 02:00:00", "a", "g", "missing")],
        "event_time string, app_id string, geo_device_id string, advertiser_id string",
    )
    dim = spark.createDataFrame([("", "bad"), ("x", "good")], "advertiser_id string, vertical string")
    rows = lookup(fact, dim, "advertiser_id", {"vertical": "advertiser_vertical"}).collect()
    got = {r["advertiser_id"]: r["advertiser_vertical"] for r in rows}
    assert got == {"": "", "x": "good", "missing": ""}


def test_questions_prune_partitions(spark, sf, tmp_path):
    from swingtrace.operators.localize import Question
    from swingtrace.operators.source import EventSource

    stored = ingest.write_days(A.ad_events(spark, sf), str(tmp_path / "t"))
    star = A.star(spark, sf)
    source = EventSource(A.Star(stored, star.apps, star.advertisers, star.geo_device))
    q = Question("2026-06-23", "2026-06-24", A.EPOCH)
    for asked in (source.grouped(["region"], ["region"], where=q.days), source.cells([("region",), ("ad_format",)], where=q.days)):
        plan = asked._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "PartitionFilters: [], PushedFilters" not in plan.split("event_date")[0]
        assert "event_date" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_day_filter_prunes_partitions(spark, sf, tmp_path):
    from swingtrace.operators.baseline import in_window

    target = str(tmp_path / "t")
    stored = ingest.write_days(A.ad_events(spark, sf), target)
    plan = stored.filter(in_window("2026-06-23", "2026-06-23")).groupBy("ad_format").count()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in text
    assert "ReadSchema: struct<ad_format:string>" in text


def test_a_short_rollup_is_not_read(rolled, spark, sf):
    star = A.star(spark, sf)
    short = rolled.daily.filter("event_date < '2026-06-30'")
    source = RollupSource(rolled.hourly, short, star=star)
    assert rolled.served_from(["region"]) == "rollup:daily" and rolled.reason == ""
    assert source.served_from(["region"]) == "raw" and source.reason == "daily rollup does not match the events"
    got = source.grouped([], where=None).first()["events"]
    assert got == star.fact.count()


def test_days_emptied_at_the_source_are_emptied(spark, sf, tmp_path):
    import datetime as dt

    day = dt.date(2026, 6, 23)
    fact = A.ad_events(spark, sf)
    loaded = ingest.replace_days(fact, str(tmp_path / "t"))
    assert loaded.filter(F.col("event_date") == day).count() > 0
    left = fact.filter(F.to_date("event_time") != day)
    again = ingest.replace_days(left, str(tmp_path / "t"), only=[day])
    assert again.filter(F.col("event_date") == day).count() == 0 and again.count() == left.count()
    star = A.star(spark, sf)
    from swingtrace.operators.enrich import enrich_star

    whole = enrich_star(star.fact, star.apps, star.advertisers, star.geo_device).filter(F.col("event_date") >= dt.date(2026, 6, 22))
    paths = str(tmp_path / "h"), str(tmp_path / "d")
    ingest.write_rollups(whole, *paths)
    _, daily = ingest.backfill_days(whole.filter(F.col("event_date") != day), [day], *paths)
    assert daily.filter(F.col("event_date") == day).count() == 0 and daily.count() > 0


def test_a_second_stream_run_counts_nothing_twice(spark, sf, tmp_path):
    from swingtrace.streaming import rollups as R

    star = A.star(spark, sf)
    files, fact, hourly, daily = (str(tmp_path / n) for n in ("in", "fact", "h", "d"))
    events = star.fact.select("event_time", "app_id", "geo_device_id", "advertiser_id", "ad_format", "is_filled", "is_impression", "is_click", "revenue")
    early = events.filter("event_time < '2026-06-20'")
    total = lambda: R.daily_table(spark, daily).read().filter("dim = 'ad_format'").agg(F.sum("events")).first()[0]
    early.repartition(2).write.parquet(files)
    for _ in range(2):
        R.run_rollups(R.read_events(spark, files, 1), star, hourly, daily, fact)
        assert total() == early.count()
    events.filter("event_time >= '2026-06-20'").write.mode("append").parquet(files)
    R.run_rollups(R.read_events(spark, files), star, hourly, daily, fact)
    assert total() == events.count()


def test_a_short_day_is_read_from_the_events_and_the_others_from_the_rollup(rolled, spark, sf, tmp_path):
    star = A.star(spark, sf)
    day = dt.date(2026, 6, 30)
    short = rolled.daily.filter(~((F.col("event_date") == day) & (F.col("dim") == "region") & (F.col("val") == "ASIA")))
    source = RollupSource(rolled.hourly, short, star=star, manifest=R.manifest(rolled.hourly, short))
    assert source.stale_days == [day] and source.served_from(["region"]) == "rollup:daily+raw"
    for by, dims in ((["event_date", "region"], ["region"]), (["region"], ["region"]), ([], []), (["event_hour"], [])):
        got = {tuple(r[b] for b in by): (r["events"], r["fills"]) for r in source.grouped(by, dims).collect()}
        want = {tuple(r[b] for b in by): (r["events"], r["fills"]) for r in EventSource(star).grouped(by, dims).collect()}
        assert got == want
    cells = source.cells([("region",)])
    assert cells.groupBy("event_date", "dim", "val").count().filter("count > 1").count() == 0
    assert cells.agg(F.sum("events")).first()[0] == star.fact.count()
    missing = rolled.hourly.filter(F.col("event_date") != day), rolled.daily.filter(F.col("event_date") != day)
    late = RollupSource(*missing, star=star, manifest=R.manifest(*missing))
    assert late.stale_days == [day] and late.grouped([]).first()["events"] == star.fact.count()
    whole = RollupSource(rolled.hourly, rolled.daily, star=star, manifest=R.manifest(rolled.hourly, rolled.daily))
    assert whole.stale_days == [] and whole.served_from(["region"]) == "rollup:daily"


def test_loads_keep_the_manifest(spark, sf, tmp_path):
    from swingtrace.operators.enrich import enrich_star

    star = A.star(spark, sf)
    day = dt.date(2026, 6, 30)
    rows = enrich_star(star.fact, star.apps, star.advertisers, star.geo_device).filter(F.col("event_date") >= day)
    paths = [str(tmp_path / n) for n in ("h", "d")]
    held = str(tmp_path / "m")
    ingest.write_rollups(rows, *paths, manifest_path=held)
    hourly, daily = ingest.backfill_days(rows.filter(F.col("event_date") != day), [day], *paths, manifest_path=held)
    left = ingest.read_manifest(spark, held)
    assert left.filter(F.col("event_date") == day).count() == 0 and left.count() > 0
    assert left.select("event_date", "grain", "dim", "total").exceptAll(R.manifest(hourly, daily)).count() == 0


def test_hourly_rollup_brings_hours_together_before_the_fan_out(spark):
    """A cut is an entry of one literal array, not an expression of its own, and hours meet before they are fanned out."""
    names = list(dict.fromkeys(d for c in ROLLUP_CUTS for d in c))
    at = dt.datetime(2026, 6, 1, 5)
    rows = [(at.date(), at, *(f"{n}{i % 2}" for n in names), 1, i % 2, 0, 1.5) for i in range(6)]
    rows.append((at.date(), at, None, *("x" for _ in names[1:]), 1, 0, 0, 1.0))
    kinds = "event_date date, event_hour timestamp, " + ", ".join(f"{n} string" for n in names)
    events = spark.createDataFrame(rows, kinds + ", is_filled int, is_impression int, is_click int, revenue double")
    hourly = R.rollup_hourly(events)
    plan = hourly._jdf.queryExecution().toString()
    assert "REBALANCE" in plan and plan.count("concat(") < len(ROLLUP_CUTS)
    got = {(r["dim"], r["val"]): r["events"] for r in hourly.collect()}
    want = {}
    for cut in ROLLUP_CUTS:
        for r in rows:
            parts = [r[2 + names.index(d)] for d in cut]
            key = ("|".join(cut), None if None in parts else "|".join(parts))
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    """Stored tables outlive the shuffles that made them."""
    import time

    from swingtrace.sources.store import shuffles_freed

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    local = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS") or "/tmp"
    rows = spark.range(200_000).selectExpr("id % 100003 AS k", "uuid() AS v")
    blocks = lambda: {os.path.join(r, f) for r, _, files in os.walk(local) for f in files if f.startswith("shuffle_") and f.endswith(".data")}
    before = blocks()
    with shuffles_freed(spark):
        rows.repartition(3, "k").write.parquet(str(tmp_path / "t"))
    for _ in range(50):  # files are deleted by another thread
        if not blocks() - before:
            break
        time.sleep(0.2)
    assert not blocks() - before and spark.read.parquet(str(tmp_path / "t")).count() == 200_000
    assert spark.conf.get(key) == "false"


def _event_rows(spark):
    """Events of three days and of none, three rows an hour, with empty and missing keys."""
    rows = []
    for day in (1, 2, 9, None):
        for i in range(12):
            at = None if day is None else dt.datetime(2026, 6, day, i // 3)
            advertiser = ("", "v1", "v2", None)[i % 4]
            rows.append((at, f"a{i % 5}", "g1" if i % 3 else "", advertiser, "f1", int(advertiser == "v1"), 0, 0, i / 4))
    apps = spark.createDataFrame([(f"a{i}", f"c{i % 2}", "t1") for i in range(4)], schema.APPS)
    advertisers = spark.createDataFrame([("v1", "x", "k"), ("v2", "y", "k"), ("", "bad", "bad")], schema.ADVERTISERS)
    geo = spark.createDataFrame([("g1", "r", "n", "d", "o"), ("", "bad", "bad", "bad", "bad")], schema.GEO_DEVICE)
    return A.Star(spark.createDataFrame(rows, schema.AD_EVENTS), apps, advertisers, geo)


def test_stored_events_are_read_day_by_day_and_give_the_same_cells(spark, tmp_path, monkeypatch):
    events = EventSource(_event_rows(spark)).rows()
    stored = ingest.store_events(events, str(tmp_path / "e"))
    plain = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert stored.columns == events.columns and plain(stored) == plain(events)
    for most in (40, 2):  # fewer groups than days
        monkeypatch.setattr(ingest, "READ_GROUPS", most)
        apart = ingest.day_by_day(stored)
        assert plain(apart) == plain(events)
        direct = R.rollup_hourly(apart, gather=False)
        moved = direct._jdf.queryExecution().toString()
        assert "REBALANCE" not in moved and plain(direct) == plain(R.rollup_hourly(events))
    empty = ingest.store_events(events.filter("false"), str(tmp_path / "none"))
    assert ingest.day_by_day(empty).count() == 0


def test_rollups_of_stored_events_do_not_move_events_or_cells_again(spark, tmp_path):
    events = EventSource(_event_rows(spark)).rows().filter("event_date IS NOT NULL")
    near = ingest.day_by_day(ingest.store_events(events, str(tmp_path / "e")))
    paths = [str(tmp_path / n) for n in ("h", "d", "h2", "d2")]
    hourly, daily = ingest.write_rollups(near, *paths[:2], gather=False)
    other = ingest.write_rollups(events, *paths[2:])
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(hourly) == plain(other[0]) and plain(daily) == plain(other[1])
    assert daily.filter("dim = 'ad_format'").agg(F.sum("events")).first()[0] == 36


def test_a_lookup_moves_each_key_once_and_spreads_rows_without_one(spark):
    """The rows that meet a dimension carry no second copy of their key, and the calendar is added after they have moved."""
    from swingtrace.operators.enrich import enrich_star

    star = _event_rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = enrich_star(star.fact, star.apps, star.advertisers, star.geo_device)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 6 and sum("_spread" in line.split("hashpartitioning")[1] for line in moved) == 6
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert "day_of_week" not in below and "_key#" not in below.replace("_dim_key#", "")
    got = {(r["advertiser_id"], r["advertiser_vertical"]) for r in rows.collect()}
    assert got == {("", ""), ("v1", "x"), ("v2", "y"), (None, "")}
    assert {r["region"] for r in rows.filter("geo_device_id = ''").collect()} == {""}


def test_stored_rollups_make_the_fact_once_and_are_judged_by_it(spark, sf, monkeypatch):
    from swingtrace.plans import registry

    source = registry.stored_rollups(spark, sf)
    plan = source.rows(())._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and source.reason == "" and source.unrolled().served_from([]) == "raw"
    once = A.dimensions
    monkeypatch.setattr(A, "dimensions", lambda s, d: tuple(t.unionAll(t) for t in once(s, d)))
    twice = registry.stored_rollups(spark, sf)
    assert twice.served_from(["region"]) == "raw" and twice.reason == "hourly rollup does not match the events"
