"""Time series: yearly production, periods, trend lines, growth, entities over time."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import explode_entities
from ..functions.ordering import running, top
from .selection import frequent_items


def by_year() -> Window:
    """Order of a year grid; it has at most a few hundred rows, so it needs no partitioning."""
    return Window.orderBy("year")


def whole() -> Window:
    """All rows of a year grid."""
    return Window.partitionBy()


def yearly_counts(works: DataFrame, gap_fill: bool = True) -> DataFrame:
    """``(year, docs, citations)``; with ``gap_fill`` every year from first to last is present."""
    per = works.filter("year is not null").groupBy("year").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("cited_by", F.lit(0))).alias("citations")
    )
    if not gap_fill:
        return per
    grid = per.agg(F.min("year").alias("a"), F.max("year").alias("b")).filter("a is not null").select(
        F.explode(F.sequence("a", "b")).alias("year")
    )
    return grid.join(per, "year", "left").fillna(0, ["docs", "citations"])


def change(col: str):
    """Percent change to the previous row; undefined for the first row or after a zero."""
    prev = F.lag(col).over(by_year())
    return (F.col(col) - prev) / F.nullif(prev, F.lit(0)) * 100


def with_shares(series: DataFrame, order: str = "year") -> DataFrame:
    """Share, percentage and cumulative columns of a year or period series."""
    run = running(F.asc(order))
    return series.withColumns({
        "share": F.col("docs") / F.nullif(F.sum("docs").over(whole()), F.lit(0)),
        "percentage": F.col("docs") / F.nullif(F.sum("docs").over(whole()), F.lit(0)) * 100,
        "cumulative_docs": F.sum("docs").over(run),
        "cumulative_citations": F.sum("citations").over(run),
    })


def yearly_production(works: DataFrame) -> DataFrame:
    """Gap-filled production with shares, running totals and percent changes."""
    return with_shares(yearly_counts(works)).withColumns(
        {"docs_change_pct": change("docs"), "citations_change_pct": change("citations")}
    )


def by_period(series: DataFrame, years: int) -> DataFrame:
    """Production per block of ``years`` (2, 5, 10): ``period_start`` is the first year of the block."""
    start = (F.floor(F.col("year") / years) * years).cast("int")
    per = series.groupBy(start.alias("period_start")).agg(F.sum("docs").alias("docs"), F.sum("citations").alias("citations"))
    return with_shares(per, "period_start")


def merge_before(series: DataFrame, cutoff: int, last_value: tuple[str, ...] = ("cumulative_docs", "cumulative_citations", "percentage")) -> DataFrame:
    """One ``<cutoff`` row for all earlier years: sums, or the latest value for running columns."""
    early = F.col("year") < cutoff
    label = F.when(early, f"<{cutoff}").otherwise(F.col("year").cast("string"))
    cols = [c for c in series.columns if c != "year"]
    aggs = [
        (F.max_by(c, "year") if c in last_value else F.sum(c)).alias(c) for c in cols
    ]
    return series.groupBy(label.alias("period"), F.when(early, cutoff - 1).otherwise(F.col("year")).alias("period_start")).agg(*aggs)


def linear_trend(series: DataFrame) -> DataFrame:
    """Adds ``trend`` and ``r_squared`` of a straight line (at least three points, else null)."""
    fit = series.agg(
        F.struct(
            F.regr_slope("docs", "year").alias("b"), F.regr_intercept("docs", "year").alias("a"),
            F.regr_r2("docs", "year").alias("r2"), F.count(F.lit(1)).alias("n"),
        )
    ).scalar()
    d = series.withColumn("_f", fit)
    ok = F.col("_f.n") >= 3
    return d.withColumns({
        "trend": F.when(ok, F.col("_f.b") * F.col("year") + F.col("_f.a")),
        "r_squared": F.when(ok, F.col("_f.r2")),
    }).drop("_f")


def polynomial_trend(series: DataFrame, degree: int) -> DataFrame:
    """Adds ``trend`` of a least-squares polynomial of degree 2 or 3.

    Years are centred and scaled first, which leaves the fitted values unchanged.
    """
    mid = series.agg(F.struct(F.avg("year").alias("m"), F.greatest(F.lit(1.0), F.stddev_pop("year")).alias("s"))).scalar()
    d = series.withColumn("_m", mid).withColumn("_x1", (F.col("year") - F.col("_m.m")) / F.col("_m.s"))
    d = d.withColumns({f"_x{k}": F.pow("_x1", F.lit(k)) for k in range(2, degree + 1)})
    names = [f"_x{k}" for k in range(1, degree + 1)]
    data = VectorAssembler(inputCols=names, outputCol="_x").transform(d.withColumn("_y", F.col("docs").cast("double")))
    model = LinearRegression(featuresCol="_x", labelCol="_y", predictionCol="trend", solver="normal").fit(data)
    return model.transform(data).select(*series.columns, "trend")


def moving_average(series: DataFrame, width: int) -> DataFrame:
    """Adds a centred moving average; null where the window is not full."""
    k = width // 2
    w = by_year().rowsBetween(-k, k)
    return series.withColumn("trend", F.when(F.count("docs").over(w) == width, F.avg("docs").over(w)))


def exponential_trend(series: DataFrame) -> DataFrame:
    """Adds ``trend`` of a * exp(b * (year - first year)), fitted by least squares on the counts."""
    from .lifecycle import fit_exponential

    keyed = series.withColumn("_s", F.lit(1))
    fit = keyed.groupBy("_s").applyInPandas(fit_exponential, "a double, b double, x0 double")
    f = fit.select(F.struct("*")).scalar()
    d = series.withColumn("_f", f)
    return d.withColumn("trend", F.col("_f.a") * F.exp(F.col("_f.b") * (F.col("year") - F.col("_f.x0")))).drop("_f")


TRENDS = {
    "linear": linear_trend,
    "poly2": lambda s: polynomial_trend(s, 2),
    "poly3": lambda s: polynomial_trend(s, 3),
    "exponential": exponential_trend,
    "ma3": lambda s: moving_average(s, 3),
    "ma5": lambda s: moving_average(s, 5),
}


def trend_summary(series: DataFrame) -> DataFrame:
    """Span, totals, averages, maximum, mean growth and R² as report lines."""
    from .descriptive import report

    d = series.withColumn("_g", change("docs"))
    row = d.agg(
        F.min("year").alias("a"), F.max("year").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("docs").alias("docs"),
        F.avg("docs").alias("mean"), F.max("docs").alias("max"), F.sum("citations").alias("cites"),
        F.avg("citations").alias("mc"), F.avg("_g").alias("g"), F.regr_r2("docs", "year").alias("r2"),
    )
    return report(row, [
        ("Time Span", "Start Year", "a"), ("Time Span", "End Year", "b"), ("Time Span", "Number of Years", "n"),
        ("Documents", "Total", "docs"), ("Documents", "Average per Year", F.round("mean", 1)), ("Documents", "Maximum", "max"),
        ("Citations", "Total", "cites"), ("Citations", "Average per Year", F.round("mc", 1)),
        ("Growth", "Avg Annual Growth (%)", F.round("g", 1)), ("Trendline", "R2", F.round("r2", 4)),
    ])


def growth_statistics(works: DataFrame, exclude_last_year: bool = False) -> DataFrame:
    """Report lines on years with documents: best years, geometric-mean growth, recent growth.

    Growth of a year is measured against the previous year that has documents.
    """
    from .descriptive import report

    per = yearly_counts(works, gap_fill=False)
    last = F.row_number().over(Window.orderBy(F.desc("year")))
    d = per.withColumns({"g": change("docs"), "_last": last})
    g = F.when(F.col("_last") > 1, F.col("g")) if exclude_last_year else F.col("g")
    d = d.withColumn("g", g)
    recent = F.row_number().over(Window.orderBy(F.col("g").isNull(), F.desc("year")))
    d = d.withColumn("_r", recent)
    rate = F.ln(1 + F.col("g") / 100)

    def gmean(cond=None):
        x = rate if cond is None else F.when(cond, rate)
        return (F.exp(F.avg(x)) - 1) * 100

    def window(n: int):
        return F.when(F.count("g") >= n, gmean((F.col("_r") <= n) & F.col("g").isNotNull()))

    # ties go to the earlier year
    best = lambda c: F.struct(F.col(c), -F.col("year"))
    row = d.agg(
        F.min("year").alias("a"), F.max("year").alias("b"), F.count(F.lit(1)).alias("n"),
        F.max_by("year", best("docs")).alias("py"), F.max("docs").alias("pd"), gmean().alias("gm"),
        F.max_by("year", F.when(F.col("g").isNotNull(), best("g"))).alias("hy"), F.max("g").alias("hg"),
        F.min_by("year", F.when(F.col("g").isNotNull(), F.struct("g", "year"))).alias("ly"), F.min("g").alias("lg"),
        window(3).alias("g3"), window(5).alias("g5"), window(10).alias("g10"),
        F.max_by("year", best("citations")).alias("cy"), F.max("citations").alias("cc"), F.avg("citations").alias("ca"),
    )
    return report(row, [
        ("Time Series", "First year", "a"), ("Time Series", "Last year", "b"), ("Time Series", "Number of years", "n"),
        ("Time Series", "Most productive year", "py"), ("Time Series", "Documents in most productive year", "pd"),
        ("Growth", "Average annual growth (%)", F.round("gm", 1)),
        ("Growth", "Highest growth year", "hy"), ("Growth", "Highest growth (%)", F.round("hg", 1)),
        ("Growth", "Lowest growth year", "ly"), ("Growth", "Lowest growth (%)", F.round("lg", 1)),
        ("Growth", "Average growth, last 3 years (%)", F.round("g3", 1)),
        ("Growth", "Average growth, last 5 years (%)", F.round("g5", 1)),
        ("Growth", "Average growth, last 10 years (%)", F.round("g10", 1)),
        ("Citations", "Most cited year", "cy"), ("Citations", "Citations in most cited year", "cc"),
        ("Citations", "Average citations per year", F.round("ca", 0)),
    ])


def entity_years(works: DataFrame, col: str, kind: str = "list") -> DataFrame:
    """``(entity, year, docs, citations)`` with map-side combine."""
    long = explode_entities(works.filter("year is not null"), col, "year", "cited_by", kind=kind)
    return long.groupBy("entity", "year").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("cited_by", F.lit(0))).alias("citations")
    )


def _top_entities(per: DataFrame, top_n: int | None, min_docs: int) -> DataFrame:
    totals = per.groupBy("entity").agg(F.sum("docs").alias("docs"))
    return frequent_items(totals, min_docs, top_n)


def entity_over_time(
    works: DataFrame, col: str, kind: str = "list", top_n: int = 10, min_docs: int = 1, cumulative: bool = False
) -> DataFrame:
    """``(entity, year, count)`` of the top entities on a full year grid, zeros included."""
    per = entity_years(works, col, kind)
    kept = _top_entities(per, top_n, min_docs)
    span = works.agg(F.sequence(F.min("year"), F.max("year"))).scalar()
    grid = kept.select("entity", F.explode(span).alias("year"))  # top_n rows times a year list
    filled = grid.join(per.select("entity", "year", "docs"), ["entity", "year"], "left")
    count = F.coalesce("docs", F.lit(0))
    if cumulative:
        count = F.sum(count).over(Window.partitionBy("entity").orderBy("year").rowsBetween(Window.unboundedPreceding, 0))
    return filled.select("entity", "year", count.cast("long").alias("count"))


def items_timeline(
    works: DataFrame, col: str, kind: str = "list", top_n: int = 10, min_docs: int = 1, value: str = "citations_per_doc"
) -> DataFrame:
    """``(entity, year, docs, citations, value)`` of the top entities for years with documents.

    ``value`` is citations_per_doc, citations, docs, or entity_citations_per_doc (over all years).
    """
    per = entity_years(works, col, kind)
    kept = _top_entities(per, top_n, min_docs).select("entity")
    w = Window.partitionBy("entity")
    values = {
        "citations_per_doc": F.col("citations") / F.col("docs"),
        "citations": F.col("citations").cast("double"),
        "docs": F.col("docs").cast("double"),
        "entity_citations_per_doc": F.sum("citations").over(w) / F.sum("docs").over(w),
    }
    return per.join(kept, "entity", "left_semi").select("entity", "year", "docs", "citations", values[value].alias("value"))


def trend_topics(
    works: DataFrame, col: str, kind: str = "list", min_docs: int = 5, max_topics: int = 50, pattern: str | None = None
) -> DataFrame:
    """Entities with the latest median year: ``(entity, year, docs, citations, median_year, growth_rate)``.

    Growth is the share of the entity's documents in its last four years.
    """
    from .selection import filter_by_pattern

    per = filter_by_pattern(entity_years(works, col, kind), pattern)
    totals = per.groupBy("entity").agg(
        F.sum("docs").alias("total"), F.percentile("year", F.lit(0.5), F.col("docs")).alias("median_year"),
        F.max("year").alias("last"),
    ).filter(F.col("total") >= min_docs)
    kept = top(totals, max_topics, F.desc("median_year"), F.asc("entity"))
    w = Window.partitionBy("entity")
    rows = per.join(kept, "entity")
    growth = F.sum(F.when(F.col("year") >= F.col("last") - 3, F.col("docs")).otherwise(0)).over(w) / F.col("total")
    return rows.select("entity", "year", "docs", "citations", "median_year", growth.alias("growth_rate"))


def chart_columns(series: DataFrame, bar: str | None = "docs", line: str | None = None) -> DataFrame:
    """``year`` with the chosen bar and line columns; a column that is missing gives nulls."""
    pickcol = lambda c: F.col(c).cast("double") if c in series.columns else F.lit(None).cast("double")
    cols = [pickcol(bar).alias("bar")] if bar else []
    cols += [pickcol(line).alias("line")] if line else []
    return series.select(*[c for c in ("year", "period") if c in series.columns], *cols)
