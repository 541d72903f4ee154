"""Exact global ranks and running sums without a one-partition window.

The rows are range-partitioned by the sort key and written once; each range keeps its own running
sums and gets the total of all earlier ranges as an offset (one row per range, so the offset table
is as small as the number of partitions).  The sort key must be a total order, which also means
that equal leading values never pile up in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut


def prefix_sums(
    df: DataFrame, order: list[Column], sums: dict[str, str] | None = None, rank: str = "rank"
) -> DataFrame:
    """Add ``rank`` (1..n over ``order``) and for each ``out: col`` the inclusive running sum."""
    sums = sums or {}
    parts = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    per_range = parts.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()]
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_s0_{o}") for o in sums],
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(offsets), "_range")
    cols = {rank: F.row_number().over(inside) + F.col("_n0")}
    for o, c in sums.items():
        cols[o] = F.sum(c).over(upto) + F.col(f"_s0_{o}")
    return out.withColumns(cols).drop("_range", "_n0", *[f"_s0_{o}" for o in sums])


def total(df: DataFrame, expr: Column) -> Column:
    """A one-value aggregate of ``df`` as a column (scalar subquery, no join)."""
    return df.agg(expr.alias("_v")).scalar()


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of a total order (distributed top-k)."""
    return df.orderBy(*order).limit(n)


def running(*order: Column) -> Window:
    """Running frame for tables whose size is bounded by construction (a top-k, a year grid)."""
    return Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def ranks_within(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """``rank`` 1..n inside each key without one task per key.

    The rows are ranked over ``(keys, order)`` as a whole and the rank of the first row of the key
    is taken off, so a key that holds most rows is spread over many ranges.
    """
    out = prefix_sums(df, [*[F.asc(k) for k in keys], *order], rank="_pos")
    first = out.groupBy(*keys).agg((F.min("_pos") - 1).alias("_first"), F.count(F.lit(1)).alias("_size"))
    return out.join(first, keys).withColumn(rank, (F.col("_pos") - F.col("_first")).cast("long")).drop("_pos", "_first")
