"""Exact quantiles of groups of any size, without all values of a group in one task.

Each wanted rank starts with the range of its group's values. A round counts the rows of each range in
`bins` equal bins, picks the bin that holds the rank, and goes on with the least and greatest value in that bin, until they are one value. What
meets in a task is a bin count, never the values; a few rounds single out one of millions of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swingtrace.sources.store import materialize

BINS = 4096


def ranked(counted: DataFrame, keys: Sequence[str], wanted: DataFrame, bins: int = BINS) -> DataFrame:
    """(keys, rank, value) of each wanted (keys, rank), ranks from 0 in ascending order.

    `counted`: (keys, value, n) with n rows of each value, which is not null or NaN. Keys compare null-safe.
    """
    bounds = counted.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    start = wanted.join(bounds, same(wanted, bounds)).select(*(wanted[k] for k in keys), "rank", "lo", "hi", F.lit(0).cast("long").alias("below"))
    targets = materialize(start, "ranks")
    found = None
    while True:
        ready = targets.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
        found = ready if found is None else found.unionByName(ready)
        going = targets.filter("lo <> hi")
        if going.isEmpty():
            return found
        width = (F.col("hi") / 2 - F.col("lo") / 2) / bins
        place = F.least(F.floor((F.col("value") / 2 - F.col("lo") / 2) / width), F.lit(bins - 1))
        inside = counted.join(going, same(counted, going)).filter(F.col("value").between(F.col("lo"), F.col("hi")))
        cells = inside.select(*(going[k] for k in keys), "rank", "below", "value", "n", F.when(width > 0, place).otherwise((F.col("value") > F.col("lo")).cast("long")).alias("bin"))
        cells = cells.groupBy(*keys, "rank", "below", "bin").agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        up_to = Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = cells.withColumn("upto", F.col("below") + F.sum("n").over(up_to))
        holds = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
        targets = materialize(summed.filter(holds).select(*keys, "rank", "lo", "hi", (F.col("upto") - F.col("n")).alias("below")), "ranks")


def quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], weight: str | None = None, bins: int = BINS
) -> DataFrame:
    """Per group its keys and, under each name of `shares`, the interpolated quantile; null for groups without values.

    Rows whose value is null or NaN count for nothing; `weight` names a column with the rows each row stands for.
    """
    v = F.col(value).cast("double")
    per_row = F.lit(1) if weight is None else F.col(weight)
    groups = rows.select(*keys).distinct()
    good = rows.filter(v.isNotNull() & ~F.isnan(v))
    counted = materialize(good.groupBy(*keys, v.alias("value")).agg(F.sum(per_row).cast("long").alias("n")), "counted")
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("size"))
    at = lambda p: (F.col("size") - 1) * F.lit(float(p))
    ends = [c(at(p)).cast("long") for p in shares.values() for c in (F.floor, F.ceil)]
    wanted = materialize(sizes.select(*keys, "size", F.explode(F.array_distinct(F.array(*ends))).alias("rank")), "wanted")
    found = ranked(counted, keys, wanted.select(*keys, "rank"), bins)
    both = wanted.join(found, [wanted[k].eqNullSafe(found[k]) for k in keys] + [wanted["rank"] == found["rank"]])
    each = both.select(*(wanted[k] for k in keys), "size", wanted["rank"].alias("rank"), "value")
    pick = lambda r: F.max(F.when(F.col("rank") == r, F.col("value")))
    out = []
    for name, p in shares.items():
        low, high = pick(F.floor(at(p))), pick(F.ceil(at(p)))
        part = F.max(at(p) - F.floor(at(p)))
        out.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(name))
    told = each.groupBy(*keys).agg(*out)
    joined = groups.join(told, [groups[k].eqNullSafe(told[k]) for k in keys], "left")
    return joined.select(*(groups[k] for k in keys), *shares)
