"""Observed against reference distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lists import explode_entities
from ..functions.numeric import chi2_tail
from .selection import year_between


def observed_distribution(works: DataFrame, col: str, kind: str = "single", year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """``(category, count)`` of a single or list field inside a year range."""
    d = year_between(works, year_from, year_to) if year_from or year_to else works
    return explode_entities(d, col, kind=kind).groupBy(F.col("entity").alias("category")).agg(F.count(F.lit(1)).alias("count"))


def flag_distribution(df: DataFrame, prefix: str = "SDG", label: str = "SDG ") -> DataFrame:
    """``(category, count)`` of 0/1 columns ``SDG1`` … or ``SDG01`` … in one pass."""
    cols = [c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit() and len(c) <= len(prefix) + 2]
    row = df.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(f"{label}{int(c[len(prefix):])}").alias("category"), F.col(c).alias("count")) for c in cols])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def reference_distribution(df: DataFrame) -> DataFrame:
    """The first two columns of any table as ``(category, count)``."""
    cat, num = df.columns[:2]
    rows = df.select(F.trim(F.col(f"`{cat}`").cast("string")).alias("category"), F.col(f"`{num}`").cast("string").try_cast("double").alias("count"))
    return rows.filter("category is not null and count is not null")


def representation(observed: DataFrame, reference: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Shares on each side (of all its categories), difference in points and class, for common categories."""
    ot, rt = observed.agg(F.sum("count")).scalar(), reference.agg(F.sum("count")).scalar()
    o = observed.withColumn("_t", ot).select("category", F.col("count").alias("observed"), (F.col("count") / F.col("_t") * 100).alias("observed_pct"))
    r = reference.withColumn("_t", rt).select("category", F.col("count").alias("reference"), (F.col("count") / F.col("_t") * 100).alias("reference_pct"))
    diff = F.col("observed_pct") - F.col("reference_pct")
    cls = F.when(diff > threshold, "Over-represented").when(diff < -threshold, "Under-represented").otherwise("Similar")
    return o.join(r, "category").withColumns({"difference": diff, "classification": cls})


def goodness_of_fit(rows: DataFrame) -> DataFrame:
    """Adds ``chi2`` and ``p`` of the observed counts against the reference shares to every row.

    Rows with an expected count above zero take part; fewer than two give nulls.  The expected counts
    are scaled to the observed total of those rows.
    """
    t = rows.agg(F.struct(F.sum("observed").alias("o"))).scalar()
    d = rows.withColumn("_o", t).withColumn("_e", F.col("reference_pct") / 100 * F.col("_o.o"))
    ok = F.col("_e") > 0
    scale = d.filter(ok).agg((F.sum("observed") / F.sum("_e")).alias("s")).scalar()
    e = d.withColumn("_s", scale).withColumn("_x", F.col("_e") * F.col("_s"))
    stat = e.filter(ok).agg(F.sum(F.pow(F.col("observed") - F.col("_x"), 2) / F.col("_x")).alias("chi2"), F.count(F.lit(1)).alias("k"))
    stat = stat.select(F.when(F.col("k") >= 2, F.col("chi2")).alias("chi2"), (F.col("k") - 1).cast("double").alias("df"))
    one = stat.withColumn("p", chi2_tail("chi2", "df")).select(F.struct("chi2", "p").alias("s")).scalar()
    return rows.withColumn("_t", one).withColumns({"chi2": F.col("_t.chi2"), "p": F.col("_t.p")}).drop("_t")


def over_represented(rows: DataFrame, threshold: float = 1.0) -> DataFrame:
    return rows.filter(F.col("difference") > threshold)


def under_represented(rows: DataFrame, threshold: float = 1.0) -> DataFrame:
    return rows.filter(F.col("difference") < -threshold)
