"""Distribution of citations: metrics, classes, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut
from .impact import indices

# Class names and reported percentiles.
CLASSES = ("Uncited", "Low Cited", "Average", "Well Cited (Top 25%)", "Highly Cited (Top 10%)")
PERCENTILES = (5, 10, 25, 50, 75, 90, 95, 99)


def value_counts(works: DataFrame, col: str = "cited_by") -> DataFrame:
    """``(c, n)``: the whole column collapsed to its distinct values."""
    return works.groupBy(F.coalesce(F.col(col), F.lit(0)).alias("c")).agg(F.count(F.lit(1)).alias("n"))


def percentile_values(works: DataFrame, points: tuple[float, ...], col: str = "cited_by") -> Column:
    """Linear-interpolation percentiles as one array value (scalar subquery over value counts)."""
    vc = value_counts(works, col)
    return vc.agg(F.percentile("c", F.array(*[F.lit(p / 100) for p in points]), F.col("n"))).scalar()


def distribution_metrics(works: DataFrame, col: str = "cited_by") -> DataFrame:
    """One row: n, sum, mean, median, population std, min, max, percentiles, uncited, h, g, Gini, moments."""
    c = F.coalesce(F.col(col), F.lit(0)).cast("double")
    base = works.agg(
        F.count(F.lit(1)).alias("n_papers"), F.sum(F.coalesce(F.col(col), F.lit(0))).alias("total_citations"),
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.count_if(c == 0).alias("uncited"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"),
    )
    idx = indices(works, [], col, year=None).select(F.struct("h_index", "g_index", "gini", "docs").alias("i")).scalar()
    out = base.withColumns({"_i": idx, "_p": percentile_values(works, PERCENTILES, col)})
    return out.select(
        "n_papers", "total_citations", "mean", F.col("_p")[3].alias("median"), "std", "min", "max",
        *[F.col("_p")[i].alias(f"p{p}") for i, p in enumerate(PERCENTILES)],
        "uncited", (F.col("uncited") / F.col("n_papers") * 100).alias("uncited_pct"),
        F.col("_i.h_index").alias("h_index"), F.col("_i.g_index").alias("g_index"),
        F.when(F.col("total_citations") > 0, F.col("_i.gini") - 1 / F.col("n_papers")).otherwise(0.0).alias("gini"),
        "skewness", "kurtosis",
    )


def metrics_table(works: DataFrame, col: str = "cited_by") -> DataFrame:
    """The metrics as ``(metric, value)`` rows."""
    row = distribution_metrics(works, col)
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def classify(works: DataFrame, col: str = "cited_by") -> DataFrame:
    """Adds ``citation_class`` by the 90th, 75th and 50th percentile of the collection."""
    c = F.coalesce(F.col(col), F.lit(0))
    p = F.col("_p")
    cls = (
        F.when(c == 0, CLASSES[0]).when(c >= p[0], CLASSES[4]).when(c >= p[1], CLASSES[3])
        .when(c >= p[2], CLASSES[2]).otherwise(CLASSES[1])
    )
    out = works.withColumn("_p", percentile_values(works, (90, 75, 50), col))
    return out.withColumn("citation_class", cls).drop("_p")


def class_report(works: DataFrame, classes: list[str] | None = None, col: str = "cited_by") -> DataFrame:
    """Per class: papers, share of all papers, total and mean citations."""
    done = classify(works.select(col), col)
    per = done.groupBy("citation_class").agg(
        F.count(F.lit(1)).alias("papers"), F.sum(F.coalesce(F.col(col), F.lit(0))).alias("total_citations")
    )
    n = works.agg(F.count(F.lit(1))).scalar()
    out = per.select(
        "citation_class", "papers", (F.col("papers") / n * 100).alias("percentage"), "total_citations",
        F.round(F.col("total_citations") / F.col("papers"), 2).alias("mean_citations"),
    )
    return out.filter(F.col("citation_class").isin(*classes)) if classes else out


def histogram(
    df: DataFrame,
    col: str,
    bins: int = 30,
    low: float | None = None,
    high: float | None = None,
    clip_percentile: float | None = None,
) -> DataFrame:
    """``(bin, low, high, n)`` for equal-width bins, empty bins included, the last one closed.

    Without bounds the data minimum and maximum are used; ``clip_percentile`` moves larger values
    into the last bin.  The values are collapsed first, so wide data costs one small shuffle.
    """
    vc = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    vc = cut(vc)  # read for the bounds and again for the bins
    if clip_percentile is not None:
        cap = vc.agg(F.percentile("v", F.lit(clip_percentile / 100), F.col("n"))).scalar()
        vc = vc.withColumn("_cap", cap).select(F.greatest(F.lit(0.0), F.least("v", "_cap")).alias("v"), "n")
    ends = vc.agg(
        F.struct(
            (F.lit(low) if low is not None else F.min("v")).cast("double").alias("lo"),
            (F.lit(high) if high is not None else F.max("v")).cast("double").alias("hi"),
        )
    ).scalar()
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("_e", ends)
    # a single value gets a range of one around it
    flat = F.col("_e.lo") == F.col("_e.hi")
    lo = F.when(flat, F.col("_e.lo") - 0.5).otherwise(F.col("_e.lo"))
    hi = F.when(flat, F.col("_e.hi") + 0.5).otherwise(F.col("_e.hi"))
    width = (hi - lo) / bins
    placed = vc.withColumn("_e", ends).filter((F.col("v") >= lo) & (F.col("v") <= hi)).select(
        F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int").alias("bin"), "n"
    )
    counts = placed.groupBy("bin").agg(F.sum("n").alias("n"))
    edges = grid.select("bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"))
    return edges.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def log_histogram(df: DataFrame, col: str, edges: int = 30) -> DataFrame:
    """Positive values in ``edges - 1`` bins whose edges are equally spaced on a log scale from 1 to max+1."""
    pos = df.filter(F.col(col) > 0).select(F.log10(F.col(col).cast("double")).alias("v"))
    top_edge = df.agg(F.log10(F.max(col) + 1)).scalar()
    vc = pos.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("_hi", top_edge)
    bins = edges - 1
    # the small nudge keeps a value that equals an edge in the bin that starts there
    place = F.least(F.floor(F.col("v") / F.col("_hi") * bins + 1e-9), F.lit(bins - 1)).cast("int")
    counts = vc.filter("v >= 0").groupBy(place.alias("bin")).agg(F.sum("n").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("_hi", top_edge)
    out = grid.select(
        "bin", F.pow(F.lit(10.0), F.col("_hi") * F.col("bin") / bins).alias("low"),
        F.pow(F.lit(10.0), F.col("_hi") * (F.col("bin") + 1) / bins).alias("high"),
    )
    return out.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
