"""Headline timings: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from swingtrace.config import ROLLUP_CUTS, sweep_cuts  # noqa: E402
from swingtrace.operators import detect as D  # noqa: E402
from swingtrace.operators import investigate as I  # noqa: E402
from swingtrace.operators import localize as L  # noqa: E402
from swingtrace.operators import query as Q  # noqa: E402
from swingtrace.operators.enrich import enrich_star  # noqa: E402
from swingtrace.operators.source import EventSource, RollupSource  # noqa: E402
from swingtrace.plans.registry import FOLDED  # noqa: E402
from swingtrace.sources import adapter as A  # noqa: E402
from swingtrace.sources import ingest  # noqa: E402
from swingtrace.sources.store import materialize, new_path  # noqa: E402

FROM, TO = "2026-06-23", "2026-06-25"


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    def rows(df):
        df.write.format("noop").mode("overwrite").save()

    star = A.star(spark, sf_dir)
    rows(EventSource(star).rows())  # first job of the JVM, not timed

    stored = timed("load_events", lambda: ingest.write_days(star.fact, new_path(spark, "bench-fact")))
    star = A.Star(stored, *(materialize(d, "bench-dim") for d in (
        star.apps, star.advertisers, star.geo_device)))
    raw = EventSource(star)
    held = new_path(spark, "bench-manifest")
    hourly, daily = timed(
        "rollup_build",
        lambda: ingest.write_rollups(
            enrich_star(star.fact, star.apps, star.advertisers, star.geo_device),
            new_path(spark, "bench-hourly"),
            new_path(spark, "bench-daily"),
            manifest_path=held,
        ),
    )
    rolled = RollupSource(hourly, daily, star=star, manifest=ingest.read_manifest(spark, held))

    for kind, source in (("raw", raw), ("rollup", rolled)):
        calls = {
            "describe_data": lambda s=source: rows(Q.overview(s)),
            "measure_filtered": lambda s=source: rows(
                Q.measure(s, "fill_rate", FROM, TO, filters={"device_model": "BUILDING"})
            ),
            "measure_by_day": lambda s=source: rows(
                Q.measure(s, "revenue", A.EPOCH, "2026-07-05", granularity="day", limit=200)
            ),
            "measure_by_hour": lambda s=source: rows(
                Q.measure(s, "fill_rate", FROM, TO, granularity="hour", limit=200)
            ),
            "measure_two_dims": lambda s=source: rows(
                Q.measure(s, "ecpm", FROM, TO, group_by=["app_category", "ad_format"])
            ),
            "compare_os": lambda s=source: rows(
                Q.compare(s, "fill_rate", FROM, TO, group_by=["os_version"], data_start=A.EPOCH)
            ),
            "compare_app": lambda s=source: rows(
                Q.compare(s, "revenue", FROM, group_by=["app_id"], data_start=A.EPOCH)
            ),
            "rank_country": lambda s=source: rows(Q.rank(s, "ecpm", "country", FROM, TO)),
            "values_app": lambda s=source: rows(
                Q.dimension_values(s, "app_id", "revenue", A.EPOCH, "2026-07-05")
            ),
            "find_incidents": lambda s=source: rows(D.find_incidents(s, t=FOLDED)),
        }
        for name, call in calls.items():
            timed(f"{name}_{kind}", call)

    events = enrich_star(A.panel_events(spark, sf_dir), *A.dimensions(spark, sf_dir))
    source = EventSource(flat=materialize(A.plant(events, "break"), "bench-panel"))
    q = L.Question(A.PLANT_DAY, A.PLANT_DAY, A.EPOCH)
    timed("localize", lambda: rows(L.localize(source, "fill_rate", q)))
    timed(
        "investigate",
        lambda: rows(
            I.investigate(
                source, "fill_rate", A.PLANT_DAY, A.PLANT_DAY, data_start=A.EPOCH
            ).ruled_out
        ),
    )

    sizes = {
        "events": stored.count(),
        "rollup_daily_rows": daily.count(),
        "rollup_hourly_rows": hourly.count(),
        "rollup_rows_per_sweep": daily.filter(
            F.col("dim").isin(*("|".join(c) for c in sweep_cuts()))
        ).count(),
        "cuts": len(ROLLUP_CUTS),
    }
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").split("sf")[-1],
                "rows": sizes,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
