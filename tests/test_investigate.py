import pytest
from pyspark.sql import functions as F

from swingtrace.functions import masks
from swingtrace.operators import explain as X
from swingtrace.operators import investigate as I
from swingtrace.operators import localize as L
from swingtrace.operators.enrich import enrich_star
from swingtrace.operators.grounding import check_grounding
from swingtrace.operators.source import EventSource
from swingtrace.plans.registry import panel
from swingtrace.sources import adapter as A

CASES = {
    "break": ("fill_rate", A.PLANT_DAY, "technical_break", A.PLANT_SEGMENT),
    "uniform": ("requests", A.UNIFORM_DAY, "not_localizable", None),
    "quiet": ("fill_rate", A.PLANT_DAY, "no_anomaly", None),
    "price": ("ecpm", A.PLANT_DAY, "demand_change", A.PLANT_SEGMENT),
    "supply": ("requests", A.PLANT_DAY, "supply_change", A.PLANT_SEGMENT),
}


@pytest.mark.parametrize("kind", CASES)
def test_scenarios(spark, sf, kind):
    metric, day, channel, segment = CASES[kind]
    source = panel(spark, sf, kind)
    inv = I.investigate(source, metric, day, day, data_start=A.EPOCH)
    assert inv.channel == channel and inv.segment == segment
    action = I.recommend(source, inv).first()
    assert action["priority"] == ("none" if channel == "no_anomaly" else "post_mortem")
    if segment:
        assert inv.findings.count() == 1
        assert inv.per_day < 0
        text = I.narrative(inv).withColumn("report", F.lit("r"))
        checked = check_grounding(text, inv.evidence.withColumn("report", F.lit("r")), "report")
        assert checked.filter("NOT grounded").count() == 0


def test_excluding_the_cause_clears_its_neighbours(spark, sf):
    source = panel(spark, sf, "break")
    q = L.Question(A.PLANT_DAY, A.PLANT_DAY, A.EPOCH)
    total = L.total_requests(source, q).first()[0]
    initial = L.localize(source, "fill_rate", q, total=total)
    moved = L.platform_move(source, "fill_rate", q, masks.OPEN)
    res = L.residualize(source, "fill_rate", q, initial, moved, total)
    assert [(c["dim"], c["val"]) for c in res.causes] == [A.PLANT_SEGMENT]
    assert res.contamination.count() > 0
    assert res.contamination.filter("abs(residual) > 1e-9").count() == 0
    fixed = L.residualize(source, "fill_rate", q, initial, moved, total, platform="fixed")
    assert A.PLANT_SEGMENT in [(c["dim"], c["val"]) for c in fixed.causes]
    assert len(fixed.causes) == 4


def test_effects_add_up_to_the_revenue_delta(spark, sf):
    source = panel(spark, sf, "supply")
    q = L.Question(A.PLANT_DAY, A.PLANT_DAY, A.EPOCH)
    rows = X.decompose(source, q, masks.OPEN).collect()
    assert sum(r["revenue_effect"] for r in rows) == pytest.approx(rows[0]["revenue_delta"])
    assert [r["factor"] for r in rows if r["is_driver"]] == ["requests"]


def series(spark, values):
    import datetime as dt

    start = dt.date(2026, 6, 1)
    return spark.createDataFrame(
        [(start + dt.timedelta(days=i), v) for i, v in enumerate(values)], "d date, v double"
    )


def status(spark, values, start, end):
    return X.recovery(series(spark, values), start, end).first()


def test_recovery(spark):
    flat = [10.0] * 35
    hit = flat[:]
    hit[21] = hit[22] = hit[23] = 5.0
    row = status(spark, hit, "2026-06-22", "2026-06-23")
    assert (row["status"], str(row["recovered_on"]), row["days_running"]) == (
        "recovered", "2026-06-25", 3,
    )
    assert status(spark, flat, "2026-06-22", "2026-06-22")["status"] == "not_applicable"
    assert status(spark, hit, "2026-06-03", "2026-06-03")["status"] == "not_applicable"
    lasting = flat[:33] + [5.0, 5.0]
    row = status(spark, lasting, "2026-07-04", "2026-07-04")
    assert (row["status"], row["days_running"]) == ("ongoing", 2)


def test_evidence_is_found_by_id_and_by_label(spark):
    ledger = I.Ledger(L.Question("2026-06-23", "2026-06-23", "2026-06-01"))
    ledger.add("fill_rate.delta_pp", -6.4632, "pp", 2)
    ledger.add("price.revenue_impact_per_day", 12.347, "usd", 2)
    rows = ledger.frame(spark)
    assert I.lookup_evidence(rows, id="e2").first()["value"] == 12.35
    assert I.lookup_evidence(rows, label="DELTA").first()["id"] == "e1"


def test_evidence_hashes_tell_source_measure_and_days_apart(spark):
    one, other = EventSource(), EventSource()
    other.name = "second"
    q, later = L.Question("2026-06-23", "2026-06-23", "2026-06-01"), L.Question("2026-06-23", "2026-06-23", "2026-06-12")

    def hashed(source, metric, q, segment=None):
        ledger = I.Ledger(q, I.origin_of(source, metric, q, segment, "remainder"))
        ledger.add("gate.platform_pct", 1.0, "pct", 2)
        return ledger.frame(spark).first()["query_hash"]

    asked = [
        (one, "fill_rate", q), (other, "fill_rate", q), (one, "ecpm", q), (one, "fill_rate", later),
        (one, "fill_rate", q, ("country", "US")),
    ]
    assert len({hashed(*a) for a in asked}) == len(asked)
    assert hashed(*asked[0]) == hashed(*asked[0])


def test_the_panel_stores_its_week_once_and_repeats_it_when_read(spark, sf):
    rows = panel(spark, sf, "break").rows()
    stored = spark.read.parquet(*rows.inputFiles())
    assert rows.count() == 10 * stored.count()
    whole = A.plant(enrich_star(A.panel_events(spark, sf), *A.dimensions(spark, sf)), "break")
    assert rows.columns != [] and set(rows.columns) == set(whole.columns)
    names = sorted(whole.columns)
    digest = F.sum(F.xxhash64(*names).cast("decimal(38,0)")).alias("h")
    assert rows.agg(digest).first() == whole.agg(digest).first()
