"""Citation indices from a collapsed profile ``(keys, cites, n)``.

Only the distinct citation counts of a group reach a window, never its documents: ``D`` different
counts need at least ``D(D-1)/2`` citations in total, so a group holding a third of all documents
still brings a short profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, keys: list[str], cites: str = "cited_by", **extra: Column) -> DataFrame:
    """``(keys, c, n, extra...)`` with map-side combine."""
    c = F.coalesce(F.col(cites).cast("long"), F.lit(0)).alias("c")
    return df.groupBy(*keys, c).agg(
        F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in extra.items()]
    )


def ranked_profile(prof: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``n_to`` / ``s_to``: documents and citations down to and including this count."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    w = w.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    return prof.withColumns(
        {"n_to": F.sum("n").over(w), "s_to": F.sum(F.col("n") * F.col("c")).over(w)}
    )


def h_expr(step: int = 1) -> Column:
    """Largest rank i with the i-th count at least ``step * i`` (h: 1, w: 10)."""
    return F.coalesce(F.max(F.least(F.col("n_to"), F.floor(F.col("c") / step))), F.lit(0)).cast("long")


def g_expr() -> Column:
    """Largest rank i whose top-i citation sum is at least i squared.

    Inside a run of equal counts c the sum after j more documents is S0 + j*c and the rank N0 + j,
    so the best j solves a quadratic; it is nudged by one to absorb rounding.
    """
    n0 = F.col("n_to") - F.col("n")
    s0 = F.col("s_to") - F.col("n") * F.col("c")
    b = 2 * n0 - F.col("c")
    disc = b * b - 4 * (n0 * n0 - s0)
    guess = F.floor((F.sqrt(F.greatest(disc, F.lit(0)).cast("double")) - b) / 2).cast("long")

    def fits(j: Column) -> Column:
        return (j <= F.col("n")) & (j >= 1) & (s0 + j * F.col("c") >= (n0 + j) * (n0 + j))

    cand = [F.least(guess + d, F.col("n")) for d in (1, 0, -1)]
    j = F.coalesce(*[F.when(fits(x), n0 + x) for x in cand])
    return F.coalesce(F.max(j), F.lit(0)).cast("long")
