"""Yearly citation histories: delayed recognition and citation patterns.

A history has one row per work and year of age, zeros included.  The yearly counts are shuffled once
by work; windows and the final aggregate reuse that partitioning (a work has as many rows as years).

Beauty coefficient and awakening year follow Ke, Ferrara, Radicchi and Flammini (PNAS 2015).  The
pattern thresholds are this library's own and are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATTERNS = ("Evergreen", "Flash-in-the-pan", "Delayed Recognition", "Sleeping Beauty", "Normal", "Uncited", "Too Recent")


def parse_history(df: DataFrame, years: str, counts: str, sep: str = "|") -> DataFrame:
    """``(doc_id, year, cites)`` from two parallel delimited columns."""
    pairs = F.arrays_zip(F.split(years, "\\Q" + sep + "\\E").alias("y"), F.split(counts, "\\Q" + sep + "\\E").alias("c"))
    rows = df.select("doc_id", F.explode(pairs).alias("p"))
    names = rows.schema["p"].dataType.names
    y, c = (F.trim(F.col("p")[n]).try_cast("int") for n in names)
    return rows.select("doc_id", y.alias("year"), c.cast("long").alias("cites")).filter("year is not null and cites is not null")


def parse_history_json(df: DataFrame, col: str) -> DataFrame:
    """``(doc_id, year, cites)`` from a ``{"year": count}`` text (single quotes allowed)."""
    m = F.from_json(F.translate(col, "'", '"'), "map<string,bigint>")
    rows = df.select("doc_id", F.explode(m).alias("y", "cites"))
    return rows.select("doc_id", F.col("y").try_cast("int").alias("year"), "cites").filter("year is not null")


def histories(counts: DataFrame, published: DataFrame | None = None, current_year: int | None = None) -> DataFrame:
    """``(doc_id, publication_year, t, c)``: citations at every age t up to the current year.

    ``published (doc_id, year)`` gives publication years and works without citations; without it the
    first cited year is taken.  The current year defaults to the last year of the counts.
    """
    summed = counts.groupBy("doc_id", "year").agg(F.sum("cites").alias("cites"))
    per = summed.groupBy("doc_id").agg(  # one entry per year of a work's life
        F.map_from_entries(F.collect_list(F.struct("year", "cites"))).alias("m"), F.min("year").alias("first")
    )
    if published is not None:
        per = published.select("doc_id", F.col("year").alias("publication_year")).join(per, "doc_id", "left")
    else:
        per = per.withColumn("publication_year", F.col("first"))
    now = F.lit(current_year) if current_year else counts.agg(F.max("year")).scalar()
    d = per.withColumn("_now", now).filter(F.col("publication_year") <= F.col("_now"))
    rows = d.select("doc_id", "publication_year", "m", F.explode(F.sequence("publication_year", "_now")).alias("year"))
    cites = F.coalesce(F.try_element_at("m", F.col("year")), F.lit(0)).cast("long")
    return rows.select("doc_id", "publication_year", (F.col("year") - F.col("publication_year")).alias("t"), cites.alias("c"))


def _work() -> Window:
    return Window.partitionBy("doc_id")


def _with_peak(hist: DataFrame) -> DataFrame:
    """Adds total, peak value (cm), its first age (tm) and the value at age zero (c0) to every row."""
    w = _work()
    d = hist.withColumns({
        "total": F.sum("c").over(w), "cm": F.max("c").over(w), "c0": F.max(F.when(F.col("t") == 0, F.col("c"))).over(w), "age": F.max("t").over(w),
    })
    return d.withColumn("tm", F.min(F.when(F.col("c") == F.col("cm"), F.col("t"))).over(w))


def beauty(hist: DataFrame) -> DataFrame:
    """Per work: total, peak, beauty coefficient, awakening year, sleep duration and awakening intensity.

    ``beauty_coefficient`` sums the gap between the line from the first to the peak year and the
    curve; the awakening is where the curve is farthest below the line; intensity is the mean yearly
    citations from the awakening on over the mean before it (null where that is zero).
    """
    w = _work()
    d = _with_peak(hist)
    t, c, tm, c0, rise = (F.col("t"), F.col("c"), F.col("tm"), F.col("c0"), F.col("cm") - F.col("c0"))
    rising = (tm > 0) & (t <= tm)
    gap = F.when(rising, (rise / tm * t + c0 - c) / F.greatest(F.lit(1), c)).otherwise(0.0)
    # distance to the line times its constant length: integers, so ties are exact (first one wins)
    d = d.withColumns({"_gap": gap, "_far": F.when(rising, F.abs(rise * t - tm * c + tm * c0))})
    d = d.withColumn("_max", F.max("_far").over(w))
    d = d.withColumn("sl", F.coalesce(F.min(F.when(F.col("_far") == F.col("_max"), t)).over(w), F.lit(0)))
    s = F.col("sl")
    # added year by year: the last digit of a sum depends on its order, and whole coefficients lie on thresholds
    in_order = F.aggregate(F.array_sort(F.collect_list(F.struct("t", "_gap"))), F.lit(0.0), lambda acc, x: acc + x["_gap"])
    out = d.groupBy("doc_id", "publication_year").agg(
        F.max("total").alias("total_citations"), F.max("cm").alias("max_citations_in_year"), in_order.alias("beauty_coefficient"),
        F.max("sl").alias("sleep_duration"), F.avg(F.when(t >= s, c)).alias("_after"), F.avg(F.when(t < s, c)).alias("_before"),
    )
    return out.withColumns({
        "awakening_year": F.col("publication_year") + F.col("sleep_duration"),
        "awakening_intensity": F.when(F.col("_before") > 0, F.col("_after") / F.col("_before")),
    }).drop("_after", "_before")


def sleeping_beauties(
    hist: DataFrame, min_beauty: float = 30.0, min_sleep: int = 3, min_citations: int = 30, min_intensity: float = 1.5
) -> DataFrame:
    """Works over all thresholds; an undefined intensity (nothing before the awakening) passes."""
    strong = F.col("awakening_intensity").isNull() | (F.col("awakening_intensity") >= min_intensity)
    d = beauty(hist).filter((F.col("beauty_coefficient") >= min_beauty) & (F.col("sleep_duration") >= min_sleep))
    return d.filter((F.col("total_citations") >= min_citations) & strong)


def by_publication_year(results: DataFrame) -> DataFrame:
    """``(publication_year, works)``."""
    return results.groupBy("publication_year").agg(F.count(F.lit(1)).alias("works"))


def trajectories(hist: DataFrame, results: DataFrame, n: int = 8, normalise: bool = True, order: Column | None = None) -> DataFrame:
    """``(doc_id, year, citations, value)`` of the first ``n`` results, divided by their maximum."""
    best = results.orderBy(order if order is not None else F.desc("beauty_coefficient"), "doc_id").limit(n).select("doc_id")
    rows = hist.join(best, "doc_id", "left_semi").withColumn("_m", F.max("c").over(_work()))
    value = F.when(F.col("_m") > 0, F.col("c") / F.col("_m")).otherwise(0.0) if normalise else F.col("c").cast("double")
    return rows.select("doc_id", (F.col("publication_year") + F.col("t")).alias("year"), F.col("c").alias("citations"), value.alias("value"))


@dataclass(frozen=True)
class PatternRules:
    """Thresholds of the citation patterns (shares in percent, times in years)."""

    min_age: int = 3
    early_years: int = 3
    late_years: int = 3
    flash_peak: int = 2
    flash_early: float = 60.0
    sleeping_peak: int = 8
    sleeping_early: float = 10.0
    delayed_peak: int = 5
    delayed_early: float = 25.0
    evergreen_late: float = 30.0
    evergreen_age: int = 6
    sure_citations: int = 20


def citation_patterns(hist: DataFrame, rules: PatternRules = PatternRules()) -> DataFrame:
    """One row per work: peak, half-life, decay, early and late share, pattern and confidence.

    half_life: years until half of all citations; decay_rate: mean yearly relative loss from the peak
    to the last year; confidence: 1 for a work with enough citations and twice the minimum age.
    """
    r = rules
    d = _with_peak(hist).withColumn("run", F.sum("c").over(_work().orderBy("t")))
    t, c, whole = F.col("t"), F.col("c"), F.col("total")
    since = F.col("age") - F.col("tm")
    loss = F.when((t == F.col("age")) & (since > 0), 1 - F.pow(c / F.col("cm"), F.lit(1.0) / since))
    d = d.groupBy("doc_id", "publication_year").agg(
        F.max("age").alias("age"), F.max("total").alias("total_citations"), F.max("cm").alias("peak_citations"), F.max("tm").alias("years_to_peak"),
        F.min(F.when(2 * F.col("run") >= whole, t)).alias("half_life"), F.max(loss).alias("decay_rate"),
        (F.sum(F.when(t < r.early_years, c).otherwise(0)) / F.nullif(F.max("total"), F.lit(0)) * 100).alias("early_pct"),
        (F.sum(F.when(t > F.col("age") - r.late_years, c).otherwise(0)) / F.nullif(F.max("total"), F.lit(0)) * 100).alias("late_pct"),
    )
    total, age, peak = F.col("total_citations"), F.col("age"), F.col("years_to_peak")
    cited = total > 0
    d = d.withColumns({
        "peak_year": F.when(cited, F.col("publication_year") + peak), "half_life": F.when(cited, F.col("half_life")),
        "decay_rate": F.when(cited, F.col("decay_rate")),
    })
    e, lt = F.col("early_pct"), F.col("late_pct")
    pattern = (
        F.when(age < r.min_age, PATTERNS[6]).when(~cited, PATTERNS[5])
        .when((peak >= r.sleeping_peak) & (e < r.sleeping_early), PATTERNS[3])
        .when((peak >= r.delayed_peak) & (e < r.delayed_early), PATTERNS[2])
        .when((peak <= r.flash_peak) & (e >= r.flash_early), PATTERNS[1])
        .when((age >= r.evergreen_age) & (lt >= r.evergreen_late), PATTERNS[0])
        .otherwise(PATTERNS[4])
    )
    conf = F.least(F.lit(1.0), total / r.sure_citations) * F.least(F.lit(1.0), age / (2 * r.min_age))
    return d.withColumns({"pattern": pattern, "confidence": conf})


def pattern_rows(results: DataFrame, pattern: str | None = None, columns: tuple[str, ...] = ("years_to_peak", "half_life")) -> DataFrame:
    """Rows of one pattern (or all) with a pair of measures."""
    rows = results.filter(F.col("pattern") == pattern) if pattern else results
    return rows.select("doc_id", "pattern", *columns)


def pattern_counts(results: DataFrame) -> DataFrame:
    """``(pattern, works)``."""
    return results.groupBy("pattern").agg(F.count(F.lit(1)).alias("works"))


def patterns_by_year(results: DataFrame) -> DataFrame:
    """``(publication_year, pattern, works)``."""
    return results.groupBy("publication_year", "pattern").agg(F.count(F.lit(1)).alias("works"))
