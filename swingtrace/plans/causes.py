"""Investigation stages on the planted panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from swingtrace.config import OWNERS, T, sweep_cuts
from swingtrace.functions import masks
from swingtrace.functions.metrics import METRICS
from swingtrace.operators import baseline as B
from swingtrace.operators import explain as X
from swingtrace.operators import investigate as I
from swingtrace.operators import localize as L
from swingtrace.plans import sqltext as S
from swingtrace.plans.detection import detect_sql
from swingtrace.plans.registry import folded, panel, panel_rows, query, rnd, rounded
from swingtrace.operators.source import EventSource
from swingtrace.sources import adapter as A
from swingtrace.sources.store import materialize

DIM, VAL = A.PLANT_SEGMENT
Q_PLANT = L.Question(A.PLANT_DAY, A.PLANT_DAY, A.EPOCH)
Q_UNIFORM = L.Question(A.UNIFORM_DAY, A.UNIFORM_DAY, A.EPOCH)
# a window of three days, so that medians over days and over weekdays both matter
Q_FOLDED = L.Question("2026-06-23", "2026-06-25", A.EPOCH)

# A second suspect next to the planted one, so that two causes exist to compare.
OTHER = ("region", "ASIA")


def _in(q) -> str:
    return f"event_date BETWEEN DATE '{q.start}' AND DATE '{q.end}'"


def _days(q) -> str:
    return f"({_in(q)} OR event_date IN {S.days(q.base)})"


# -- decomposition ------------------------------------------------------------------------------


def decompose_sql(q, where: str = "TRUE", name: str = "dec") -> str:
    parts = ("events", "fills", "impressions", "revenue")
    med = ", ".join(f"median({p}) AS {p}" for p in parts)
    factors = {
        "requests": "{s}.events",
        "fill_rate": "coalesce({s}.fills / nullif({s}.events, 0), 0)",
        "render_rate": "coalesce({s}.impressions / nullif({s}.fills, 0), 0)",
        "ecpm": "coalesce({s}.revenue / nullif({s}.impressions, 0) * 1000, 0)",
    }
    names = list(factors)

    def rev(upto: int) -> str:
        v = [factors[f].format(s="i" if k < upto else "b") for k, f in enumerate(names)]
        return f"({v[0]} * {v[1]} * {v[2]} * ({v[3]} / 1000))"

    rows = " UNION ALL ".join(
        f"""SELECT {k + 1} AS step, '{f}' AS factor, {factors[f].format(s="b")} AS base_value,
        {factors[f].format(s="i")} AS inc_value, {rev(k + 1)} - {rev(k)} AS revenue_effect,
        b.revenue AS base_revenue, i.revenue AS inc_revenue FROM {name}_i i, {name}_b b"""
        for k, f in enumerate(names)
    )
    return f"""
{name}_d AS (SELECT event_date, {S.SUMS} FROM enriched WHERE ({where}) AND {_days(q)} GROUP BY 1),
{name}_m AS (
  SELECT w.event_date AS day, {", ".join(f"median(x.{p}) AS {p}" for p in parts)}
  FROM (SELECT unnest(generate_series(DATE '{q.start}', DATE '{q.end}', INTERVAL 1 DAY))::DATE
               AS event_date) w
       JOIN {name}_d x ON w.event_date - x.event_date IN (7, 14, 21, 28)
  WHERE NOT (x.event_date BETWEEN DATE '{q.start}' AND DATE '{q.end}') GROUP BY 1),
{name}_b AS (SELECT {med} FROM {name}_m),
{name}_i AS (SELECT {med} FROM {name}_d WHERE {_in(q)}),
{name}_r AS ({rows}),
{name} AS MATERIALIZED (
  SELECT *, coalesce((inc_value - base_value) / nullif(base_value, 0) * 100, 0) AS delta_pct,
         inc_revenue - base_revenue AS revenue_delta,
         inc_revenue - base_revenue - sum(revenue_effect) OVER () AS residual,
         abs(revenue_effect) = max(abs(revenue_effect)) OVER () AS is_driver
  FROM {name}_r)"""


def _decompose_select(name: str = "dec") -> str:
    return f"""SELECT step, factor, {S.r("base_value", 4)} AS base_value,
       {S.r("inc_value", 4)} AS inc_value, {S.r("delta_pct", 4)} AS delta_pct,
       {S.r("revenue_effect", 2)} AS revenue_effect, is_driver,
       {S.r("revenue_delta", 2)} AS revenue_delta, {S.r("residual", 2)} AS residual FROM {name}"""


def _decomposed(df):
    out = rounded(
        df, base_value=4, inc_value=4, delta_pct=4, revenue_effect=2, revenue_delta=2, residual=2
    )
    return out.drop("base_revenue", "inc_revenue")


@query("i_decompose", f"WITH {S.enriched()}, {decompose_sql(Q_FOLDED)} {_decompose_select()}")
def i_decompose(spark, sf):
    return _decomposed(X.decompose(folded(spark, sf), Q_FOLDED, masks.OPEN))


@query(
    "i_explain_revenue",
    f"""WITH {S.enriched()}, {decompose_sql(Q_FOLDED, "region = 'ASIA'")} {_decompose_select()}""",
)
def i_explain_revenue(spark, sf):
    mask = masks.scope({"region": "ASIA"}, "revenue")
    return _decomposed(X.explain_revenue(folded(spark, sf), Q_FOLDED, mask))


@query(
    "i_price",
    f"""WITH {S.panel("break")}, {decompose_sql(Q_PLANT, f"{DIM} = '{VAL}'")}
SELECT {S.r("any_value(revenue_delta)", 2)} AS per_day, 1::INTEGER AS days,
       {S.r("any_value(revenue_delta)", 2)} AS total FROM dec""",
)
def i_price(spark, sf):
    """Dollars per day of the cause itself, over the days of the window."""
    source = EventSource(flat=panel_rows(spark, sf, "break"))
    rows = X.decompose(source, Q_PLANT, masks.segment_mask(DIM, VAL))
    days = len(B.days_between(Q_PLANT.start, Q_PLANT.end))
    one = rows.filter("step = 1")
    return one.select(
        rnd("revenue_delta", 2).alias("per_day"),
        F.lit(days).alias("days"),
        rnd(F.col("revenue_delta") * days, 2).alias("total"),
    )


# -- localization -------------------------------------------------------------------------------


def _candidate_select(name: str) -> str:
    return f"""SELECT dim, val, {S.r("base_value")} AS base_value, {S.r("inc_value")} AS inc_value,
       {S.r("delta_pct", 4)} AS delta_pct, {S.r("delta_pp", 4)} AS delta_pp,
       {S.r("share_pct", 4)} AS share_pct, {S.r("contribution")} AS contribution FROM {name}"""


def _candidates(df):
    out = rounded(
        df, base_value=6, inc_value=6, delta_pct=4, delta_pp=4, share_pct=4, contribution=6
    )
    return out.drop("delta_abs")


def _loc(metric: str, q, name: str = "cand", where: str = "TRUE", floor: int = T.segment_min_requests):
    cells = S.cells(sweep_cuts(metric), f"({where}) AND {_days(q)}", f"{name}_cells")
    return f"{cells}, {S.candidates(metric, q, name, f'{name}_cells', floor)}"


@query(
    "i_localize",
    f"WITH {S.panel('break')}, {_loc('fill_rate', Q_PLANT)} {_candidate_select('cand')}",
)
def i_localize(spark, sf):
    source = EventSource(flat=panel_rows(spark, sf, "break"))
    return _candidates(L.localize(source, "fill_rate", Q_PLANT))


@query(
    "i_localize_masked",
    f"""WITH {S.panel("break")},
{_loc("fill_rate", Q_PLANT, where=f"NOT ({DIM} = '{VAL}')")} {_candidate_select("cand")}""",
)
def i_localize_masked(spark, sf):
    """The sweep without the cause; shares stay shares of all traffic."""
    source = EventSource(flat=panel_rows(spark, sf, "break"))
    return _candidates(L.localize(source, "fill_rate", Q_PLANT, masks.exclusion_mask(DIM, VAL)))


def _qualify(metric: str, name: str, platform: str) -> str:
    m = METRICS[metric]
    move, gate = ("delta_pp", T.cause_pp) if m.has_points else ("delta_pct", T.cause_pct)
    return f"{name}.share_pct >= {T.cause_share_pct} AND abs({name}.{move} - {platform}) >= {gate}"


_DETECT = detect_sql("fill_rate", A.PLANT_DAY, A.PLANT_DAY)


def _break(spark, sf):
    """Planted panel, its candidates, the platform's move and the window's requests."""
    source = panel(spark, sf, "break")
    total = L.total_requests(source, Q_PLANT).first()[0]
    found = L.localize(source, "fill_rate", Q_PLANT, total=total)
    initial = materialize(found, "candidates")
    moved = L.platform_move(source, "fill_rate", Q_PLANT, masks.OPEN)
    return source, initial, moved, total


@query(
    "i_qualify",
    f"""WITH {S.panel("break")}, {_DETECT}, {_loc("fill_rate", Q_PLANT)}
SELECT dim, val, {S.r("delta_pp", 4)} AS delta_pp, {S.r("share_pct", 4)} AS share_pct
FROM cand, det WHERE {_qualify("fill_rate", "cand", "det.pp")}""",
)
def i_qualify(spark, sf):
    _, initial, moved, _ = _break(spark, sf)
    kept = initial.filter(L.qualifies("fill_rate", moved))
    return kept.select("dim", "val", rnd("delta_pp", 4).alias("delta_pp"), rnd("share_pct", 4).alias("share_pct"))


@query(
    "i_uniformity",
    f"""WITH {S.panel("uniform")}, {_loc("requests", Q_UNIFORM)},
m AS (SELECT dim, abs(delta_pct) AS x FROM cand
      WHERE abs(delta_pct) > {T.uniform_move} AND share_pct >= {T.uniform_share_pct}),
s AS (SELECT count(*)::BIGINT AS segments_moved, count(DISTINCT dim)::BIGINT AS dimensions,
             min(x) AS lo, max(x) AS hi, {S.upper_median("list(x)")} AS mid FROM m)
SELECT segments_moved, dimensions, {S.r("lo", 4)} AS min_move, {S.r("hi", 4)} AS max_move,
       {S.r("mid", 4)} AS median_move, {S.r("(hi - lo) / nullif(mid, 0)", 4)} AS spread_ratio,
       segments_moved >= {T.uniform_segments} AND (hi - lo) / nullif(mid, 0) <= {T.uniform_spread}
         AS uniform FROM s""",
)
def i_uniformity(spark, sf):
    source = panel(spark, sf, "uniform")
    found = L.uniformity(L.localize(source, "requests", Q_UNIFORM))
    return rounded(found, min_move=4, max_move=4, median_move=4, spread_ratio=4)


_TOP = f"""top AS (SELECT cand.* FROM cand, det WHERE {_qualify("fill_rate", "cand", "det.pp")}
        ORDER BY contribution DESC, dim, val LIMIT 1)"""
_RESIDUAL = f"""
{_loc("fill_rate", Q_PLANT)}, {_TOP},
{_loc("fill_rate", Q_PLANT, "rest", f"NOT ({DIM} = '{VAL}')")},
cont AS MATERIALIZED (
  SELECT c.dim, c.val, c.delta_pp, c.delta_pct, c.share_pct, r.delta_pp AS residual
  FROM cand c JOIN rest r USING (dim, val), det
  WHERE {_qualify("fill_rate", "c", "det.pp")}
    AND NOT EXISTS (SELECT 1 FROM top WHERE top.dim = c.dim AND top.val = c.val)
    AND abs(r.delta_pp) <= {T.band_pp})"""


@query(
    "i_residualize",
    f"""WITH {S.panel("break")}, {_DETECT}, {_RESIDUAL}
SELECT 'cause' AS verdict, dim, val, {S.r("delta_pp", 4)} AS delta_pp,
       CAST(NULL AS DOUBLE) AS residual FROM top
UNION ALL SELECT 'contamination', dim, val, {S.r("delta_pp", 4)}, {S.r("residual", 4)} FROM cont
UNION ALL SELECT 'normal', dim, val, {S.r("delta_pp", 4)}, CAST(NULL AS DOUBLE) FROM cand
WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.dim = cand.dim AND top.val = cand.val)
  AND NOT EXISTS (SELECT 1 FROM cont WHERE cont.dim = cand.dim AND cont.val = cand.val)""",
)
def i_residualize(spark, sf):
    """One planted cause: found first, the dilution it caused cleared, the rest normal."""
    source, initial, moved, total = _break(spark, sf)
    res = L.residualize(source, "fill_rate", Q_PLANT, initial, moved, total)
    causes = spark.createDataFrame(
        [("cause", c["dim"], c["val"], c["delta_pp"], None) for c in res.causes],
        "verdict string, dim string, val string, delta_pp double, residual double",
    )
    cleared = res.contamination.select(
        F.lit("contamination").alias("verdict"), "dim", "val", "delta_pp", "residual"
    )
    normal = res.normal.select(
        F.lit("normal").alias("verdict"), "dim", "val", "delta_pp",
        F.lit(None).cast("double").alias("residual"),
    )
    rows = causes.unionByName(cleared).unionByName(normal)
    return rounded(rows, delta_pp=4, residual=4)


def _alone_sql(i: int, own: str, other: str) -> str:
    where = f"({own}) AND NOT ({other})"
    base = S.days(Q_PLANT.base)
    return f"""SELECT {i} AS cause,
       (SELECT list(v) FROM (SELECT sum(is_filled)::DOUBLE / count(*) AS v FROM enriched
         WHERE {where} AND event_date IN {base} GROUP BY event_date)) AS base_days,
       (SELECT avg(v) FROM (SELECT sum(is_filled)::DOUBLE / count(*) AS v FROM enriched
         WHERE {where} AND {_in(Q_PLANT)} GROUP BY event_date)) AS inc"""


_OWN, _ELSE = f"{DIM} = '{VAL}'", f"{OTHER[0]} = '{OTHER[1]}'"


@query(
    "i_survival_order",
    f"""WITH {S.panel("break")},
a AS ({_alone_sql(0, _OWN, _ELSE)} UNION ALL {_alone_sql(1, _ELSE, _OWN)})
SELECT cause::INTEGER AS cause, {S.r(f"abs(inc - {S.median('base_days')}) * 100", 4)} AS survives FROM a""",
)
def i_survival_order(spark, sf):
    """Two suspects, each measured outside the other: the planted one survives, the other does not."""
    source = panel(spark, sf, "break")
    total = L.total_requests(source, Q_PLANT).first()[0]
    rows = L.survival_moves(source, "fill_rate", Q_PLANT, [A.PLANT_SEGMENT, OTHER], total)
    return rows.select("cause", rnd(F.abs("delta_pp"), 4).alias("survives")).orderBy(
        F.desc("survives")
    )


def _own_history(i: int, dim: str, val: str) -> str:
    where = f"{dim} = '{val}'"
    text = detect_sql("fill_rate", A.PLANT_DAY, A.PLANT_DAY, where)
    for name in ("dd", "ds", "dc", "dm", "det"):
        text = text.replace(f"{name} AS (", f"{name}{i} AS (").replace(f"FROM {name})", f"FROM {name}{i})")
    return text


@query(
    "i_confirm",
    f"""WITH {S.panel("break")}, {_own_history(0, DIM, VAL)}, {_own_history(1, *OTHER)}
""" + " UNION ALL ".join(
        f"""SELECT '{d}' AS dim, '{v}' AS val, {S.r("pct", 4)} AS delta_pct, {S.r("sigma", 4)} AS sigma,
abs(pct) >= {T.platform_pct} AND abs(sigma) >= {T.platform_sigma} AS anomalous FROM det{i}"""
        for i, (d, v) in enumerate((A.PLANT_SEGMENT, OTHER))
    ),
)
def i_confirm(spark, sf):
    source = EventSource(flat=panel_rows(spark, sf, "break"))
    cells = source.cells(sweep_cuts(), where=Q_PLANT.days)
    rows = I.confirm(cells, "fill_rate", Q_PLANT, [A.PLANT_SEGMENT, OTHER])
    return rounded(rows, delta_pct=4, sigma=4).select("dim", "val", "delta_pct", "sigma", "anomalous")


@query(
    "i_materiality",
    f"""WITH {S.panel("break")}, {_DETECT}, {_loc("fill_rate", Q_PLANT)}
SELECT dim, val, {S.r("share_pct", 4)} AS share_pct,
       {S.r("abs(delta_pct) * share_pct / 100", 4)} AS platform_points,
       share_pct >= {T.material_share_pct} OR abs(delta_pct) * share_pct / 100 >= {T.material_platform_pp}
         AS is_material
FROM cand, det WHERE {_qualify("fill_rate", "cand", "det.pp")}""",
)
def i_materiality(spark, sf):
    """Every qualifying segment, kept or set aside."""
    _, initial, moved, _ = _break(spark, sf)
    rows = initial.filter(L.qualifies("fill_rate", moved))
    return rows.select(
        "dim",
        "val",
        rnd("share_pct", 4).alias("share_pct"),
        rnd(F.abs("delta_pct") * F.col("share_pct") / 100.0, 4).alias("platform_points"),
        X.material().alias("is_material"),
    )


def classify_sql(q, where: str, driver: str, name: str = "cls") -> str:
    inc = _in(q)

    def rate(a: str, b: str, side: str, scale: str = "") -> str:
        return (
            f"coalesce(sum({a}) FILTER (WHERE {side})::DOUBLE "
            f"/ nullif(sum({b}) FILTER (WHERE {side}), 0), 0){scale}"
        )

    def med(x: str, side: str) -> str:
        return f"coalesce(median({x}) FILTER (WHERE {side}), 0)"

    pct = "coalesce(({0}_inc - {0}_base) / nullif({0}_base, 0) * 100, 0)"
    return f"""
{name}_d AS (SELECT event_date, count(DISTINCT advertiser_id) FILTER (WHERE advertiser_id <> '') AS advs,
             {S.SUMS} FROM enriched WHERE ({where}) AND {_days(q)} GROUP BY 1),
{name}_s AS (SELECT floor({med("advs", inc)} + 0.5)::DOUBLE AS advertisers_inc,
       floor({med("advs", f"NOT ({inc})")} + 0.5)::DOUBLE AS advertisers_base,
       {rate("impressions", "fills", inc)} AS render_inc,
       {rate("impressions", "fills", f"NOT ({inc})")} AS render_base,
       {rate("revenue", "impressions", inc, " * 1000")} AS ecpm_inc,
       {rate("revenue", "impressions", f"NOT ({inc})", " * 1000")} AS ecpm_base,
       {med("events", inc)} AS requests_inc, {med("events", f"NOT ({inc})")} AS requests_base
       FROM {name}_d),
{name}_p AS (SELECT *, {pct.format("advertisers")} AS advertisers_pct,
       (render_inc - render_base) * 100 AS render_pp, {pct.format("ecpm")} AS ecpm_pct,
       {pct.format("requests")} AS requests_pct FROM {name}_s),
{name} AS (SELECT *, CASE
       WHEN advertisers_pct <= {T.classify_advertisers_pct} THEN 'demand_change'
       WHEN '{driver}' = 'requests' OR abs(requests_pct) >= {T.classify_requests_pct} THEN 'supply_change'
       WHEN render_pp <= {T.classify_render_pp} THEN 'technical_break'
       WHEN '{driver}' = 'fill_rate' THEN 'technical_break' ELSE 'demand_change' END AS channel
       FROM {name}_p)"""


_OWNER_SQL = "CASE channel " + " ".join(f"WHEN '{c}' THEN '{o}'" for c, o in OWNERS.items()) + " END"
_SIGNALS = ("advertisers", "render", "ecpm", "requests")


def _classify_select(name: str) -> str:
    sides = ", ".join(
        f"{S.r(f'{s}_{w}', 4)} AS {s}_{w}" for s in _SIGNALS for w in ("inc", "base")
    )
    return f"""SELECT {sides}, {S.r("advertisers_pct", 4)} AS advertisers_pct,
       {S.r("render_pp", 4)} AS render_pp, {S.r("ecpm_pct", 4)} AS ecpm_pct,
       {S.r("requests_pct", 4)} AS requests_pct, channel, {_OWNER_SQL} AS owner FROM {name}"""


def _classified(spark, sf, kind: str, driver: str):
    source = EventSource(flat=panel_rows(spark, sf, kind))
    signals = X.classify_signals(source, Q_PLANT, masks.segment_mask(DIM, VAL))
    rows = X.classify(signals, driver).drop("basis")
    names = [f"{s}_{w}" for s in _SIGNALS for w in ("inc", "base")]
    names += ["advertisers_pct", "render_pp", "ecpm_pct", "requests_pct"]
    return rounded(rows, **{n: 4 for n in names})


def _classify_sql(kind: str, driver: str) -> str:
    return f"""WITH {S.panel(kind)}, {classify_sql(Q_PLANT, f"{DIM} = '{VAL}'", driver)}
{_classify_select("cls")}"""


@query("i_classify", _classify_sql("break", "fill_rate"))
def i_classify(spark, sf):
    return _classified(spark, sf, "break", "fill_rate")


@query("i_classify_supply", _classify_sql("supply", "requests"))
def i_classify_supply(spark, sf):
    return _classified(spark, sf, "supply", "requests")


@query("i_classify_price", _classify_sql("price", "ecpm"))
def i_classify_price(spark, sf):
    return _classified(spark, sf, "price", "ecpm")


# -- recovery and priority ----------------------------------------------------------------------


def recovery_sql(metric: str, q, where: str) -> str:
    """Status of one window from its own daily series."""
    gate = T.recovery_pct
    return f"""
rs AS (SELECT event_date AS d, {S.value(metric)} AS v
       FROM (SELECT event_date, {S.SUMS} FROM enriched WHERE {where} GROUP BY 1)),
rn AS (SELECT c.d, c.v, CASE WHEN count(b.v) >= {T.min_baseline_days} THEN median(b.v) END AS normal
       FROM rs c LEFT JOIN rs b ON c.d - b.d IN (7, 14, 21, 28) GROUP BY 1, 2),
rd AS (SELECT *, (v - normal) / nullif(abs(normal), 0) * 100 AS dev FROM rn WHERE v IS NOT NULL),
rw AS (SELECT median(dev) AS w, count(*) AS n FROM rd WHERE d BETWEEN DATE '{q.start}' AND DATE '{q.end}'),
rb AS (SELECT rd.*, coalesce(CASE WHEN rw.w < 0 THEN dev > -{gate} ELSE dev < {gate} END, FALSE) AS back
       FROM rd, rw),
rf AS (SELECT min(d) AS first_back FROM rb WHERE back AND d > DATE '{q.end}'),
ro AS (SELECT count(*) AS n FROM rb, rf WHERE d >= DATE '{q.start}' AND d < first_back AND NOT back),
rl AS (SELECT count(*) AS n FROM rb WHERE d > DATE '{q.end}'),
rec AS (SELECT CASE WHEN w IS NULL OR abs(w) < {gate} THEN 'not_applicable'
                    WHEN first_back IS NOT NULL THEN 'recovered' ELSE 'ongoing' END AS status,
               w AS window_dev, CASE WHEN w IS NOT NULL AND abs(w) >= {gate} THEN first_back END AS recovered_on,
               CASE WHEN w IS NULL OR abs(w) < {gate} THEN NULL
                    WHEN first_back IS NOT NULL THEN ro.n ELSE rw.n + rl.n END::INTEGER AS days_running
        FROM rw, rf, ro, rl)"""


@query(
    "i_recovery",
    f"""WITH {S.panel("break")}, {recovery_sql("fill_rate", Q_PLANT, f"{DIM} = '{VAL}'")}
SELECT status, {S.r("window_dev", 4)} AS window_dev, recovered_on, days_running FROM rec""",
)
def i_recovery(spark, sf):
    source = EventSource(flat=panel_rows(spark, sf, "break"))
    series = X.recover_series(source, "fill_rate", masks.segment_mask(DIM, VAL))
    return rounded(X.recovery(series, Q_PLANT.start, Q_PLANT.end), window_dev=4)


@query(
    "i_priority",
    f"""WITH {S.panel("break")}, {recovery_sql("fill_rate", Q_PLANT, f"{DIM} = '{VAL}'")},
{decompose_sql(Q_PLANT, f"{DIM} = '{VAL}'")},
p AS (SELECT any_value(revenue_delta) AS per_day FROM dec)
SELECT status, 'technical_break' AS channel, 'fill_rate' AS metric, {S.r("per_day", 2)} AS per_day,
       days_running, CASE status WHEN 'ongoing' THEN 'act_now' WHEN 'recovered' THEN 'post_mortem'
         ELSE 'monitor' END AS priority, 'Engineering' AS owner,
       {S.r("per_day * days_running", 2)} AS lost_so_far,
       CASE WHEN status = 'ongoing' THEN {S.r("per_day", 2)} ELSE 0.0::DOUBLE END AS recoverable_per_day,
       'step:request->fill' AS where_in_funnel FROM rec, p""",
)
def i_priority(spark, sf):
    source = panel(spark, sf, "break")
    mask = masks.segment_mask(DIM, VAL)
    status = X.recovery(X.recover_series(source, "fill_rate", mask), Q_PLANT.start, Q_PLANT.end)
    priced = X.decompose(source, Q_PLANT, mask).filter("step = 1").select("revenue_delta")
    rows = status.withColumns(
        {
            "channel": F.lit("technical_break"),
            "metric": F.lit("fill_rate"),
            "per_day": priced.scalar(),
        }
    )
    out = X.priority(rows).drop("window_dev", "recovered_on")
    return rounded(out, per_day=2, lost_so_far=2, recoverable_per_day=2)


# -- the whole pipeline -------------------------------------------------------------------------


def _finding_rows(inv):
    cleared = inv.ruled_out.filter("status = 'cleared_as_contamination'")
    rows = inv.findings.unionByName(cleared)
    return rows.select(
        F.lit(inv.channel).alias("channel"),
        "status",
        "dimension",
        "value",
        "metric",
        rnd("delta_pct", 4).alias("delta_pct"),
        rnd("delta_pp", 4).alias("delta_pp"),
        rnd("share_pct", 4).alias("share_pct"),
        rnd("residual", 4).alias("residual"),
        rnd("revenue_impact", 2).alias("revenue_impact"),
    )


@query(
    "i_investigate",
    f"""WITH {S.panel("break")}, {_DETECT}, {_RESIDUAL},
{decompose_sql(Q_PLANT, f"{DIM} = '{VAL}'")}, drv AS (SELECT factor FROM dec WHERE is_driver LIMIT 1),
{classify_sql(Q_PLANT, f"{DIM} = '{VAL}'", "fill_rate")}
SELECT channel, 'found' AS status, dim AS dimension, val AS value, 'fill_rate' AS metric,
       {S.r("delta_pct", 4)} AS delta_pct, {S.r("delta_pp", 4)} AS delta_pp,
       {S.r("share_pct", 4)} AS share_pct, CAST(NULL AS DOUBLE) AS residual,
       {S.r("(SELECT any_value(revenue_delta) FROM dec)", 2)} AS revenue_impact FROM top, cls
UNION ALL
SELECT channel, 'cleared_as_contamination', dim, val, 'fill_rate', {S.r("delta_pct", 4)},
       {S.r("delta_pp", 4)}, {S.r("share_pct", 4)}, {S.r("residual", 4)}, CAST(NULL AS DOUBLE)
FROM cont, cls""",
)
def i_investigate(spark, sf):
    """The planted break: one cause, what it diluted, its channel and its price."""
    source = panel(spark, sf, "break")
    return _finding_rows(
        I.investigate(source, "fill_rate", A.PLANT_DAY, A.PLANT_DAY, data_start=A.EPOCH)
    )


@query(
    "i_investigate_uniform",
    f"""WITH {S.panel("uniform")}, {detect_sql("requests", A.UNIFORM_DAY, A.UNIFORM_DAY)},
{decompose_sql(Q_UNIFORM)}
SELECT 'not_localizable' AS channel, 'found' AS status, CAST(NULL AS VARCHAR) AS dimension,
       CAST(NULL AS VARCHAR) AS value, 'requests' AS metric, {S.r("pct", 4)} AS delta_pct,
       {S.r("pp", 4)} AS delta_pp, CAST(NULL AS DOUBLE) AS share_pct, CAST(NULL AS DOUBLE) AS residual,
       {S.r("(SELECT any_value(revenue_delta) FROM dec)", 2)} AS revenue_impact FROM det""",
)
def i_investigate_uniform(spark, sf):
    """Everything fell together: no segment is named."""
    source = panel(spark, sf, "uniform")
    return _finding_rows(
        I.investigate(source, "requests", A.UNIFORM_DAY, A.UNIFORM_DAY, data_start=A.EPOCH)
    )


@query(
    "i_segment_fallback",
    f"""WITH {S.panel("quiet")}, {detect_sql("fill_rate", A.PLANT_DAY, A.PLANT_DAY)}
SELECT 'no_anomaly' AS channel, 'cleared_as_normal' AS status, 'fill_rate' AS metric,
       {S.r("pct", 4)} AS delta_pct, {S.r("sigma", 4)} AS sigma FROM det""",
)
def i_segment_fallback(spark, sf):
    """Nothing planted: the platform is quiet, the segment sweep is tried and finds nothing."""
    source = panel(spark, sf, "quiet")
    inv = I.investigate(source, "fill_rate", A.PLANT_DAY, A.PLANT_DAY, data_start=A.EPOCH)
    return inv.ruled_out.select(
        F.lit(inv.channel).alias("channel"), "status", "metric",
        rnd("delta_pct", 4).alias("delta_pct"), rnd("sigma", 4).alias("sigma"),
    )


def _evidence_sql() -> str:
    """The labels and values an investigation of the planted break records, in SQL."""
    det = " UNION ALL ".join(
        f"SELECT 'fill_rate.{n}' AS label, {S.r(x, d)} AS value FROM det"
        for n, x, d in (
            ("incident", "incident", 6), ("baseline", "baseline", 6), ("delta_pct", "pct", 4),
            ("sigma", "sigma", 3), ("baseline_days", "n::DOUBLE", 0), ("delta_pp", "pp", 4),
        )
    )
    dec = " UNION ALL ".join(
        f"SELECT 'decompose.' || factor || '{n}', {S.r(x, d)} FROM alldec"
        for n, x, d in (
            (".delta_pct", "delta_pct", 4), ("", "inc_value", 6), (".revenue_effect", "revenue_effect", 4),
        )
    )
    cause = " UNION ALL ".join(
        f"SELECT 'cause.' || dim || '.' || val || '.{n}', {S.r(x, 4)} FROM top"
        for n, x in (("delta", "delta_pp"), ("share_pct", "share_pct"))
    )
    cont = " UNION ALL ".join(
        f"SELECT 'cleared.' || dim || '.' || val || '.{n}', {S.r(x, 4)} FROM cont"
        for n, x in (("raw", "delta_pp"), ("residual", "residual"))
    )
    gates = " UNION ALL ".join(
        f"SELECT 'gate.{n}', {float(x)}::DOUBLE"
        for n, x in (
            ("platform_pct", T.platform_pct), ("platform_sigma", T.platform_sigma), ("baseline_days", T.min_baseline_days),
        )
    )
    signals = " UNION ALL ".join(
        f"SELECT 'classify.{n}', {S.r(x, d)} FROM cls"
        for s, d in (("advertisers", 0), ("render", 4), ("ecpm", 3), ("requests", 0))
        for n, x in ((s, f"{s}_inc"), (f"{s}.baseline", f"{s}_base"))
    )
    moves = " UNION ALL ".join(
        f"SELECT 'classify.{n}', {S.r(n, 4)} FROM cls" for n in ("advertisers_pct", "render_pp", "ecpm_pct", "requests_pct")
    )
    price = f"SELECT 'price.revenue_impact_per_day', {S.r('any_value(revenue_delta)', 2)} FROM dec"
    own = f"{DIM} = '{VAL}'"
    return f"""WITH {S.panel("break")}, {_DETECT}, {_RESIDUAL}, {decompose_sql(Q_PLANT, name="alldec")},
{decompose_sql(Q_PLANT, own)}, {classify_sql(Q_PLANT, own, "fill_rate")}
SELECT label, value FROM ({" UNION ALL ".join((det, dec, cause, cont, gates, signals, moves, price))})"""


def _investigated(spark, sf):
    source = panel(spark, sf, "break")
    return I.investigate(source, "fill_rate", A.PLANT_DAY, A.PLANT_DAY, data_start=A.EPOCH)


@query("i_evidence", _evidence_sql())
def i_evidence(spark, sf):
    """Every recorded number."""
    return _investigated(spark, sf).evidence.select("label", rnd("value").alias("value"))


@query(
    "i_evidence_lookup",
    f"SELECT * FROM ({_evidence_sql()}) WHERE label LIKE '%device_model%' ORDER BY label LIMIT 40",
)
def i_evidence_lookup(spark, sf):
    found = I.lookup_evidence(_investigated(spark, sf).evidence, label="Device_Model")
    return found.select("label", rnd("value").alias("value"))
