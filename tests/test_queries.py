"""Registered queries against their SQL; SWINGTRACE_ALL=1 checks every one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from swingtrace.plans import ORACLE, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUICK = (
    "flagship enrich_star filter_scope agg_fan_out q_compare q_rank q_weekly_growth rollup_daily "
    "d_platform_scan d_cluster_windows i_decompose i_localize i_classify g_grounding w_match "
    "v_rollup_parity t_kv_rollup_15m t_step_attribution agg_quantiles t_span_health s_rollup_hourly "
    "rollup_stale_days i_residualize s_rollup_daily s_late_days s_kv_15m s_step_sessions s_watch "
    "i_evidence v_evidence_parity agg_median_interp"
).split()
KEYS = list(QUERIES) if os.environ.get("SWINGTRACE_ALL") else QUICK


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_its_sql(spark, sf, duck, key):
    df = entry.queries()[key](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[key])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert got == want


def test_every_query_has_sql_and_the_entry_runs(spark):
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
