"""Order without a task that sees all rows: ranges of values, totals per range, and sums over the ranges before.

Ranges are cut by a bounded sample of the values, those with the smallest hashes, so the same table is cut alike in every
run. Where they are cut decides how work is dealt and, of results, only which rows an exact bootstrap draws.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTS, SAMPLE = 64, 1_024


def cuts(df: DataFrame, column: str, parts: int = PARTS) -> list:
    """At most ``parts`` - 1 ascending values that cut the column's distinct values into ranges of about equal size."""
    if parts <= 1:
        return []
    v = F.col(column)
    full = df.where(v.isNotNull() & ~F.isnan(v) if dict(df.dtypes)[column] in ("double", "float") else v.isNotNull())
    rows = full.select(v.alias("v")).distinct().orderBy(F.xxhash64("v"), "v").limit(max(parts, SAMPLE)).collect()
    found = sorted(r["v"] for r in rows)
    return list(dict.fromkeys(found[len(found) * k // parts] for k in range(1, parts))) if found else []


def range_of(value: Column, at: list) -> Column:
    """How many cuts are not above the value, by nested halving; -1 for null. It rises with the value, NaN being the last."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(at[mid]), pick(low, mid)).otherwise(pick(mid + 1, high))

    return F.when(value.isNull(), -1).otherwise(pick(0, len(at)))


def joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """A join on equal keys, null with null, that keeps the left side's keys."""
    if not keys:
        return left.crossJoin(right)  # the right side is one row
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(named[f"__r_{k}"]) for k in keys))
    return left.join(named, on, how).drop(*(f"__r_{k}" for k in keys))


def ordinals(df: DataFrame, by: tuple[str, ...], order: str, *, name: str = "ordinal", tie: tuple[str, ...] = (), parts: int = PARTS) -> DataFrame:
    """``df`` with the place (from 0) of each row of a group in ascending order of a column, then of ``tie``.

    Rows are counted by group and range, counts are added up over the ranges, and a row's place is that sum plus its
    place in its range: a task sees one range of a group. Rows of one value are in one range.
    """
    ranged = df.withColumn("__part", range_of(F.col(order), cuts(df, order, parts)))
    sizes = ranged.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*by, "__part", before.alias("__before"))
    place = F.row_number().over(W.partitionBy(*by, "__part").orderBy(order, *tie)) - 1
    out = joined(ranged, offsets, (*by, "__part")).withColumn(name, F.col("__before") + place)
    return out.drop("__part", "__before")
