"""Ordered scans over a key that may hold a third of all rows.

A window over (key, slice) plus a carry per slice gives the same answer as a window over the key,
without sorting a whole hot key in one task. Slices are calendar days, so the carry table has one
row per key and day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(
    rows: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order: Sequence[str | Column],
    value: Column,
    name: str,
    inclusive: bool = False,
) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` before (or at) each row within its keys."""
    by_slice = [*keys, slice_col]
    frame = Window.partitionBy(*by_slice).orderBy(*order)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    near = rows.withColumn("_v", value).withColumn(
        "_near", F.last("_v", ignorenulls=True).over(frame)
    )
    position = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    ends = rows.withColumn("_v", value).filter("_v IS NOT NULL").groupBy(*by_slice).agg(
        F.max_by("_v", position).alias("_last")
    )
    slices = rows.select(*by_slice).distinct().join(ends, by_slice, "left")
    earlier = Window.partitionBy(*keys).orderBy(slice_col)
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier))
    joined = near.join(carry.select(*by_slice, "_carry"), by_slice, "left")
    return joined.withColumn(name, F.coalesce("_near", "_carry")).drop("_v", "_near", "_carry")


def most_before(
    rows: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str | Column], value: Column, name: str
) -> DataFrame:
    """Adds ``name``: the greatest ``value`` of the rows before each row within its keys."""
    by_slice = [*keys, slice_col]
    before = Window.partitionBy(*by_slice).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.max(value).over(before))
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(*by_slice).agg(F.max(value).alias("_most")).withColumn("_carry", F.max("_most").over(earlier))
    joined = near.join(slices.select(*by_slice, "_carry"), by_slice, "left")
    return joined.withColumn(name, F.greatest("_near", "_carry")).drop("_near", "_carry")
