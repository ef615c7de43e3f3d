"""Batch tables, sessions over batches, and exact selection."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swingtrace.functions.quantiles import quantiles
from swingtrace.streaming import rollups as R
from swingtrace.streaming.batches import BatchTable, summed

DAY = dt.date(2026, 6, 1)


def counts(spark, tmp_path):
    return BatchTable(spark, str(tmp_path / "t"), "k string, n bigint", summed(["k"], ["n"]))


def add(spark, table, batch_id, rows):
    table.write(spark.createDataFrame(rows, "day date, k string, n bigint"), batch_id)


def test_batches_add_up_and_a_replay_replaces_its_own(spark, tmp_path):
    table = counts(spark, tmp_path)
    assert table.read().count() == 0 and table.compact(5) == []
    add(spark, table, 0, [(DAY, "a", 1), (DAY, "a", 2), (DAY, None, 5)])
    add(spark, table, 1, [(DAY, "a", 10), (DAY + dt.timedelta(1), "b", 7)])
    add(spark, table, 1, [(DAY, "a", 10), (DAY + dt.timedelta(1), "b", 7)])
    assert {tuple(r) for r in table.read().collect()} == {("a", 13), (None, 5), ("b", 7)}


def test_compaction_changes_no_answer_and_spares_what_may_be_replayed(spark, tmp_path):
    table = counts(spark, tmp_path)
    for b in range(4):
        add(spark, table, b, [(DAY, "a", 10**b), (DAY + dt.timedelta(b), "b", 1)])
    want = {("a", 1111), ("b", 4)}
    read = lambda: {(r.k, r.n) for r in table.read().groupBy("k").agg(F.sum("n").alias("n")).collect()}
    assert read() == want
    assert table.compact(3) == [DAY] and read() == want
    left = {r.batch for r in table._read("rows", "batch").filter(F.col("day") == DAY).collect()}
    assert left == {3}
    add(spark, table, 3, [(DAY, "a", 1000), (DAY + dt.timedelta(3), "b", 1)])  # replayed after the compaction
    add(spark, table, 4, [(DAY, "a", 5)])
    assert table.compact(5) == [DAY] and {(r.k, r.n) for r in table.read().filter("k = 'a'").collect()} == {("a", 1116)}
    # a merged part without its line in the log does not count
    table._write(spark.createDataFrame([(DAY, "a", 9, 9)], "day date, k string, n bigint, upto bigint"), "merged", "upto")
    assert {(r.k, r.n) for r in table.read().filter("k = 'a'").collect()} == {("a", 1116)}


def sessions_by_hand(steps):
    out = {}
    for key in {s for s, _ in steps}:
        at = sorted(t for s, t in steps if s == key)
        runs = [[at[0]]]
        for t in at[1:]:
            if t - runs[-1][-1] < dt.timedelta(minutes=3):
                runs[-1].append(t)
            else:
                runs.append([t])
        out[key] = [(r[0], r[-1], len(r)) for r in runs]
    return {(k, *r) for k, rs in out.items() for r in rs}


def test_a_late_step_joins_two_sessions(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 6, 1, 23, 50) + dt.timedelta(minutes=m)
    source, schema = str(tmp_path / "in"), "session bigint, at timestamp"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    early = [(1, at(0)), (1, at(4)), (1, at(7)), (2, at(0)), (None, at(1))]
    write(early)
    table = R.run_step_sessions(stream(), str(tmp_path / "out"))
    assert {tuple(r) for r in table.read().collect()} == sessions_by_hand(early)  # 4 and 7 are three minutes apart: two sessions
    late = [(1, at(2)), (1, at(9.5)), (1, at(11)), (1, at(30))]
    write(late)
    table = R.run_step_sessions(stream(), str(tmp_path / "out"))
    want = sessions_by_hand(early + late)
    assert {tuple(r) for r in table.read().collect()} == want and (1, at(0), at(4), 3) in want
    table.compact(2)
    assert {tuple(r) for r in table.read().collect()} == want


def test_sessions_of_a_hot_key_over_many_batches(spark, tmp_path):
    r = random.Random(3)
    steps = [(r.choice([7, 7, 7, 8]), dt.datetime(2026, 6, 1) + dt.timedelta(seconds=r.randrange(3 * 86400))) for _ in range(3000)]
    schema = "session bigint, at timestamp"
    spark.createDataFrame(steps, schema).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = R.run_step_sessions(stream, str(tmp_path / "out"))
    assert {tuple(x) for x in table.read().collect()} == sessions_by_hand(steps)


@pytest.mark.parametrize("bins", [64, 4096])
def test_quantiles_of_one_hot_group_among_small_ones(spark, bins):
    g = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in g.lognormal(0, 6, 4000)] + [("hot", 1e300), ("hot", -1e300), ("hot", 0.0)]
    rows += [("one", 3.0), ("same", 2.0), ("same", 2.0), ("two", 1.0), ("two", 2.0), (None, 4.0), (None, None), ("none", None), ("nan", float("nan"))]
    d = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.p0, r.p50, r.p95) for r in quantiles(d, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95}, bins=bins).collect()}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key and v is not None and v == v]
        want = tuple(float(np.quantile(values, p)) if values else None for p in (0, 0.5, 0.95))
        assert got[key] == (pytest.approx(want, rel=1e-12) if values else want), key


def test_no_task_of_the_selection_holds_a_group(spark):
    """What is grouped by key alone are bins: a hot group reaches its window as at most `bins` rows."""
    d = spark.range(200_000).select(F.lit("hot").alias("k"), F.xxhash64("id").cast("double").alias("v"))
    got = quantiles(d, ["k"], "v", {"p50": 0.5}, bins=64).first()
    values = sorted(r.v for r in d.select("v").collect())
    assert got.p50 == (values[99_999] + values[100_000]) / 2


def test_a_batch_of_arriving_files_is_not_one_file(spark, tmp_path, monkeypatch):
    from swingtrace.plans import streams
    from swingtrace.sources import adapter as A

    items = spark.range(0, 400, 1, 5).select(F.col("id").alias("l_orderkey"))
    facts = items.select(F.col("l_orderkey").cast("string").alias("app_id"), F.lit("g").alias("geo_device_id"))
    monkeypatch.setattr(A, "table", lambda spark, sf, name: items)
    monkeypatch.setattr(A, "ad_events", lambda spark, sf: facts)
    path, per_batch = streams._fact_files(spark, "", 2)
    files = spark.read.parquet(path)
    assert per_batch == 5 and len(files.inputFiles()) == 10 and files.count() == 400


def test_rows_that_are_merged_are_stored_as_they_are(spark, tmp_path):
    seen = []

    def merge(rows):
        seen.append(1)
        return summed(["k"], ["n"])(rows)

    table = BatchTable(spark, str(tmp_path / "t"), "k string, n bigint", merge)
    table.write(spark.createDataFrame([(DAY, "a", 3), (DAY, "b", 4)], "day date, k string, n bigint"), 0, merged=True)
    assert not seen
    assert sorted(map(tuple, table.read().collect())) == [("a", 3), ("b", 4)]
