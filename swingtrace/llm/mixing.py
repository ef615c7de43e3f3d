"""Mixing sources to target weights through a domain - language - source tree.

Weights are whole numbers at every node, shared out among siblings. A leaf can give its tokens at most
`max_epochs` times, an inner node what its leaves can give. The budget goes down the tree: among
siblings each gets its weighted share, and what one cannot give is redistributed over the others by
weight; only a shortage of all siblings stays with the parent, whose own siblings were then given more. Since
a node's capacity is known before its parent shares out, one pass of capped shares from the root does
this. A leaf's budget is its whole epochs and then a prefix, by tokens, of the next epoch's seeded order.

Whole numbers throughout. Orders are md5 of seed, epoch and id, so any engine repeats them. The prefix is
found from token sums of ranges of that order; only the range that holds the cut is sorted, and a leaf has
the more ranges the more rows it has, so a source with a third of all rows is no single task.

Defined results: null or empty texts have no tokens and go with their leaf's order; a null language or
source counts as the empty string; repeated rows each count their tokens and stand next to each
other in the order; an empty table gives an empty selection; other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swingtrace.llm.common import stored, table, words

RANGE_ROWS = 20_000
SMALL_LEAVES = 100_000


@dataclass(frozen=True)
class Plan:
    """Weights by level; what is not listed has `default`. The budget is share_pct of all tokens."""

    domains: dict = field(default_factory=lambda: {"web": 60, "curated": 40})
    langs: dict = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    sources: dict = field(default_factory=lambda: {"src0": 2})
    default: int = 1
    share_pct: int = 90
    max_epochs: int = 2
    seed: int = 42


#: The query's domain of a source is "web" for these, "curated" for all others.
WEB = [f"src{i}" for i in range(12)]


def domain_of(source: Column) -> Column:
    return F.when(source.isin(*WEB), "web").otherwise("curated")


def _weight(column: str, listed: dict, default: int) -> Column:
    out = F.lit(default)
    for name, w in listed.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out.cast("long")


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """children (parent columns, child, weight, capacity, parent_budget) with `budget`: capped weighted shares.

    Sorted by capacity per weight, children are filled up as long as their share of what is left exceeds
    their capacity; the others divide the rest by weight, rounded down.
    """
    order = [(F.col("capacity") / F.when(F.col("weight") > 0, F.col("weight"))).asc_nulls_last(), F.col(child)]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    d = children.withColumns(
        {
            "left": F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)),
            "weights": F.sum("weight").over(after),
        }
    ).withColumn("full", (F.col("weight") > 0) & (F.col("capacity") * F.col("weights") <= F.col("weight") * F.col("left")))
    d = d.withColumns(
        {
            "rest": F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole),
            "open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole),
        }
    )
    share = F.when(F.col("open") > 0, F.expr("(weight * rest) div open")).otherwise(0)
    return d.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share)).drop(
        "left", "weights", "full", "rest", "open", "parent_budget"
    )


def leaves(counted: DataFrame, plan: Plan) -> DataFrame:
    """One row per leaf of counted (domain, lang, source, n_tokens): supply, rows, budget."""
    keys = ["domain", "lang", "source"]
    leaf = stored(
        counted.groupBy(*keys).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("rows")), "leaves"
    )
    listed = {"domain": plan.domains, "lang": plan.langs, "source": plan.sources}
    least = F.least(*(_weight(k, listed[k], plan.default) for k in keys))  # a leaf under a weight of zero gives nothing
    leaf = leaf.withColumn("capacity", F.when(least > 0, F.col("supply") * plan.max_epochs).otherwise(0))
    budgets = leaf.agg(F.expr(f"coalesce(sum(supply), 0) * {plan.share_pct} div 100").alias("budget"))
    for depth, level in enumerate(keys):
        parent = keys[:depth]
        nodes = leaf.groupBy(*keys[: depth + 1]).agg(F.sum("capacity").alias("capacity")).withColumn(
            "weight", _weight(level, listed[level], plan.default)
        )
        above = budgets.select(*parent, F.col("budget").alias("parent_budget"))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))  # one row
        budgets = share_out(nodes, parent, level)
    return stored(leaf.join(budgets.select(*keys, "budget"), keys), "budgets")


def _order(plan: Plan, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(plan.seed)), epoch.cast("string"), doc_id.cast("string")))


def _beside(rows: DataFrame, leaf: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their leaf's columns. Up to SMALL_LEAVES leaves are broadcast, for a join on the leaf would
    bring a source with a third of all rows into one task; more are joined by a shuffle, with skew splitting."""
    return rows.join(F.broadcast(leaf) if leaf.count() <= SMALL_LEAVES else leaf, keys)


def cuts(counted: DataFrame, plan: Plan) -> DataFrame:
    """Per leaf: whole epochs, and the last order key that the partial epoch takes (null if none)."""
    keys = ["domain", "lang", "source"]
    leaf = leaves(counted, plan)
    whole = F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(0)
    leaf = leaf.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply"))
    digits = F.ceil(F.log(16.0, F.greatest(F.lit(1.0), F.col("rows") / RANGE_ROWS))).cast("int")
    leaf = stored(leaf.withColumn("digits", digits), "plan")
    rows = _beside(counted, leaf.filter("rest > 0").select(*keys, "epochs", "rest", "digits"), keys)
    rows = rows.withColumn("o", _order(plan, F.col("epochs"), F.col("doc_id")))
    rows = rows.withColumn("part", F.substr("o", F.lit(1), F.col("digits")))
    sums = rows.groupBy(*keys, "part", "rest").agg(F.sum("n_tokens").alias("n"), F.max("o").alias("last"))
    running = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))), "ranges")
    inside = sums.filter(F.col("before") + F.col("n") <= F.col("rest")).groupBy(*keys).agg(F.max("last").alias("cut"))
    at = sums.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))).select(*keys, "part", "before")
    # rows of one order key (a repeated id) are taken or left together
    tied = rows.join(at, [*keys, "part"]).groupBy(*keys, "part", "before", "rest", "o").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    tied = tied.withColumn("upto", F.col("before") + F.sum("n").over(upto)).filter(F.col("upto") <= F.col("rest"))
    cut = tied.groupBy(*keys).agg(F.max("o").alias("cut")).unionAll(inside).groupBy(*keys).agg(F.max("cut").alias("cut"))
    return stored(leaf.select(*keys, "epochs", "supply", "budget").join(cut, keys, "left"), "cuts")


def mix(
    docs: DataFrame, plan: Plan = Plan(), *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source",
    domain=domain_of, rows: bool = True,
) -> DataFrame:
    """The selected rows: `row` (docs' columns, without rows all but the text), leaf, n_tokens and copies (1 or more)."""
    named = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    leaf = [domain(named(source)).alias("domain"), named(lang).alias("lang"), named(source).alias("source")]
    n = F.size(words(docs[text])).cast("long").alias("n_tokens")
    counted = stored(docs.select(docs[doc_id].alias("doc_id"), *leaf, n), "tokens")
    cut = cuts(counted, plan)
    packed = F.struct(*(docs[f"`{c}`"] for c in docs.columns if rows or c != text)).alias("row")
    given = docs.select(packed, docs[doc_id].alias("key"), *leaf, n)
    given = _beside(given, cut, ["domain", "lang", "source"])
    extra = F.when(_order(plan, F.col("epochs"), F.col("key")) <= F.col("cut"), 1).otherwise(0)
    return given.select("row", "domain", "lang", "source", "n_tokens", (F.col("epochs") + extra).cast("long").alias("copies")).filter("copies > 0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), rows=False).select("row.doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _sql_weight(column: str, listed: dict, default: int) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {w}" for k, w in listed.items()) + f" ELSE {default} END"


def sql(plan: Plan = Plan(), source: str = "documents") -> str:
    """DuckDB SQL of the query: the same shares, and running sums over each leaf's whole order."""
    keys = ["domain", "lang", "source"]
    listed = {"domain": plan.domains, "lang": plan.langs, "source": plan.sources}
    web = ", ".join(f"'{s}'" for s in WEB)
    weights = ", ".join(_sql_weight(k, listed[k], plan.default) for k in keys)
    out = rf"""
WITH c AS (SELECT doc_id, CASE WHEN coalesce(source, '') IN ({web}) THEN 'web' ELSE 'curated' END AS domain, coalesce(lang, '') AS lang,
  coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM {source}),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, CASE WHEN least({weights}) > 0
  THEN sum(n_tokens)::BIGINT * {plan.max_epochs} ELSE 0 END AS capacity FROM c GROUP BY 1, 2, 3),
b_ AS (SELECT coalesce(sum(supply), 0)::BIGINT * {plan.share_pct} // 100 AS budget FROM leaf)"""
    for depth, level in enumerate(keys):
        parent, mine = keys[:depth], keys[: depth + 1]
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        order = f"{by} ORDER BY capacity / CASE WHEN weight > 0 THEN weight END ASC NULLS LAST, {level}"
        join = f"JOIN b_{keys[depth - 1]} p USING ({', '.join(parent)})" if parent else "CROSS JOIN b_ p"
        mine_sql = ", ".join(mine)
        out += f""",
n_{level} AS (SELECT {mine_sql}, n.capacity, {_sql_weight(level, listed[level], plan.default)} AS weight, p.budget AS parent_budget
  FROM (SELECT {mine_sql}, sum(capacity)::BIGINT AS capacity FROM leaf GROUP BY {mine_sql}) n {join}),
f_{level} AS (SELECT *, weight > 0 AND capacity * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= weight * (parent_budget -
  coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM n_{level}),
r_{level} AS (SELECT *, parent_budget - sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER ({by}) AS rest,
  sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({by}) AS open FROM f_{level}),
b_{level} AS (SELECT {mine_sql}, (CASE WHEN filled THEN capacity WHEN open > 0 THEN (weight * rest) // open ELSE 0 END)::BIGINT AS budget FROM r_{level})"""
    return out + f""",
e AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs, budget, supply FROM leaf JOIN b_source USING (domain, lang, source)),
o AS (SELECT c.*, e.epochs, e.budget - e.epochs * e.supply AS rest, md5(concat_ws(':', '{plan.seed}', e.epochs::VARCHAR, doc_id::VARCHAR)) AS o
  FROM c JOIN e USING (domain, lang, source)),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o) AS upto FROM o)
SELECT * FROM (SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM s) WHERE copies > 0"""
