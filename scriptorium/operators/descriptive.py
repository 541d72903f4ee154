"""Collection summaries as ``(category, indicator, value)`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import one_decimal, round_halves_up, sample_kurtosis, sample_skewness
from ..functions.ordering import top
from ..functions.quantiles import exact_percentiles
from .impact import core_indices, indices, thresholds
from .trends import growth_statistics

DISTINCT_FIELDS = ("authors", "countries", "affiliations", "author_keywords", "index_keywords")


def report(row: DataFrame, items: list[tuple[str, str, str | Column]]) -> DataFrame:
    """Turn one wide row into report lines; null values are left out."""
    lines = F.array(*[
        F.struct(
            F.lit(cat).alias("category"), F.lit(ind).alias("indicator"),
            (F.col(v) if isinstance(v, str) else v).cast("double").alias("value"),
        )
        for cat, ind, v in items
    ])
    return row.select(F.explode(lines).alias("l")).select("l.*").filter("value is not null")


def distinct_items(works: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row of distinct item counts, one column per list field, in one pass over the works.

    The fields are stacked as ``(field, item)``, de-duplicated with map-side combine and counted.
    """
    def tagged(field: str) -> Column:
        return F.transform(
            F.array_distinct(field), lambda x: F.struct(F.lit(field).alias("field"), F.trim(x).alias("item"))
        )

    stacked = F.concat(*[tagged(f) for f in fields])
    pairs = works.select(F.explode(stacked).alias("p")).select("p.*").filter("item <> ''").dropDuplicates()
    return pairs.agg(*[F.count_if(F.col("field") == f).alias(f) for f in fields])


def dataset_summary(works: DataFrame) -> DataFrame:
    """Size, span, sources, distinct items, references and citation totals of a collection, from one pass.

    Items and citation counts are stacked as ``(field, item)`` and counted; what a row adds to the totals rides on
    one more entry.  The second aggregate sees distinct entries only: the median is taken from the profile of
    citation counts.
    """
    fields = tuple(f for f in DISTINCT_FIELDS if f in works.columns)
    c = F.coalesce(F.col("cited_by"), F.lit(0)).cast("long")
    refs = F.size("references").cast("long") if "references" in works.columns else F.lit(0).cast("long")
    year = F.col("year").cast("long")

    def entry(field: str, item: Column, number: Column | None = None) -> Column:
        none = F.lit(None).cast("long")
        return F.struct(F.lit(field).alias("field"), item.cast("string").alias("item"), (none if number is None else number).alias("k"), refs.alias("refs") if number is not None else none.alias("refs"), year.alias("y") if number is not None else none.alias("y"))

    stacked = F.concat(
        F.array(entry("", F.lit(""), c), entry("source", F.col("source"))),
        *[F.transform(F.array_distinct(f), lambda x: entry(f, F.trim(x))) for f in fields],
    )
    counted = works.select(F.explode(stacked).alias("p")).select("p.*").filter("field = '' or (item is not null and item <> '' or field = 'source' and item is not null)")
    counted = counted.groupBy("field", "item", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("refs").alias("refs"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    doc, n = F.col("field") == "", F.when(F.col("field") == "", F.col("n"))
    total = F.coalesce(F.sum(n), F.lit(0))
    base = counted.agg(
        total.alias("docs"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count_if(F.col("field") == "source").alias("sources"),
        F.sum("refs").alias("refs"), F.sum(n * F.col("k")).alias("cites"), (F.sum(n * F.col("k")) / F.sum(n)).alias("mean"),
        F.percentile(F.when(doc, F.col("k")), F.lit(0.5), F.coalesce(n, F.lit(0))).alias("median"), F.max(F.when(doc, F.col("k"))).alias("max"),
        F.coalesce(F.sum(F.when(doc & (F.col("k") > 0), F.col("n"))), F.lit(0)).alias("cited"), F.struct(*[F.count_if(F.col("field") == f).alias(f) for f in fields] or [F.lit(0).alias("_none")]).alias("d"),
    )
    row = base
    lines: list[tuple[str, str, str | Column]] = [
        ("Dataset", "Number of documents", "docs"), ("Dataset", "First year", "y0"), ("Dataset", "Last year", "y1"),
        ("Dataset", "Number of years", F.col("y1") - F.col("y0") + 1), ("Dataset", "Number of sources", "sources"),
    ]
    lines += [("Dataset", f"Number of {f.replace('_', ' ')}", F.col(f"d.{f}")) for f in fields]
    if "authors" in fields:
        lines.append(("Dataset", "Authors per document", F.round(F.col("d.authors") / F.col("docs"), 2)))
    if "references" in works.columns:
        lines += [
            ("Dataset", "Total references", "refs"),
            ("Dataset", "References per document", F.round(F.col("refs") / F.col("docs"), 2)),
        ]
    lines += [
        ("Citations", "Total citations", "cites"), ("Citations", "Average citations", F.round("mean", 2)),
        ("Citations", "Median citations", F.floor("median")), ("Citations", "Max citations", "max"),
        ("Citations", "Cited documents", "cited"), ("Citations", "Uncited documents", F.col("docs") - F.col("cited")),
        ("Citations", "Citation rate (%)", F.round(F.col("cited") / F.col("docs") * 100, 1)),
    ]
    return report(row, lines)


def performance(works: DataFrame, mode: str = "full") -> DataFrame:
    """Core, extended and full indicators, collaboration index and yearly activity."""
    idx = indices(works, []).select(F.struct("*").alias("i")).scalar()
    aggs = [
        F.count(F.lit(1)).alias("docs"), F.avg("year").alias("my"), F.min("year").alias("y0"), F.max("year").alias("y1"),
        F.percentile("year", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.count_if(F.col("cited_by") > 0).alias("cited"), F.sum("cited_by").alias("cites"),
    ]
    if "authors" in works.columns:
        aggs.append(F.avg(F.when(F.size("authors") > 0, F.size("authors"))).alias("collab"))
    row = works.agg(*aggs).withColumn("i", idx)
    span = F.col("y1") - F.col("y0") + 1
    lines: list[tuple[str, str, str | Column]] = [
        ("Core", "Number of documents", "docs"), ("Core", "Total citations", "cites"),
        ("Core", "H-index", "i.h_index"), ("Core", "Average year", F.round("my", 1)),
    ]
    out = None
    if mode in ("extended", "full"):
        lines += [
            ("Extended", "G-index", "i.g_index"), ("Extended", "First year", "y0"), ("Extended", "Last year", "y1"),
            ("Extended", "Q1 year", F.floor(F.col("q")[0])), ("Extended", "Median year", F.floor(F.col("q")[1])),
            ("Extended", "Q3 year", F.floor(F.col("q")[2])),
        ]
        out = thresholds(works).select(
            F.lit("Extended").alias("category"), F.concat(F.lit("C"), F.col("threshold")).alias("indicator"),
            F.col("docs").cast("double").alias("value"),
        )
    if mode == "full":
        core = core_indices(works, []).select(F.struct("*").alias("k")).scalar()
        row = row.withColumn("k", core)
        lines += [
            ("Full", "Cited documents", "cited"), ("Full", "A-index", F.round("k.a_index", 2)),
            ("Full", "R-index", F.round("k.r_index", 2)), ("Full", "Gini index", F.round("i.gini", 3)),
        ]
    if "authors" in works.columns:
        lines.append(("Collaboration", "Collaboration index", F.round("collab", 2)))
    lines += [
        ("Activity", "Documents per year", F.round(F.col("docs") / span, 2)),
        ("Activity", "Citations per year", F.round(F.col("cites") / span, 2)),
    ]
    main = report(row, lines)
    return main if out is None else main.unionByName(out)


def _text_value(value: Column) -> Column:
    """Numbers as plain text without trailing zeros, so that numeric and text lines share a column."""
    return F.regexp_replace(value.cast("decimal(38,3)").cast("string"), r"\.?0+$", "")


def describe_numeric(works: DataFrame, col: str, extra: bool = False) -> DataFrame:
    """``(variable, indicator, value)`` of one numeric column; the percentiles are found before the query is built."""
    v = F.col(col).try_cast("double")
    median, *tails = (F.lit(x).cast("double") for x in exact_percentiles(works, col, [0.5, *((0.25, 0.75, 0.9, 0.95) if extra else ())]))
    aggs = [
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(median).alias("median"),
        F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"),
    ]
    lines = [("Count", "n", 0), ("Mean", "mean", 2), ("Median", "median", 2), ("Std Dev", "std", 2),
             ("Min", "min", 2), ("Max", "max", 2), ("Sum", "sum", 2)]
    if extra:
        aggs += [
            F.skewness(v).alias("sk"), F.kurtosis(v).alias("ku"),
        ]
    row = works.agg(*aggs)
    if extra:
        n = F.col("n").cast("double")
        row = row.withColumns({
            "skew": sample_skewness(F.col("sk"), n), "kurt": sample_kurtosis(F.col("ku"), n),
            **{f"p{q}": t for q, t in zip((25, 75, 90, 95), tails)},
        })
        lines += [("Skewness", "skew", 3), ("Kurtosis", "kurt", 3)] + [(f"P{q}", f"p{q}", 2) for q in (25, 75, 90, 95)]
    return _lines(row, col, [(name, F.col(c), d) for name, c, d in lines])


def _rounded_text(value: Column, digits: int) -> Column:
    """A rounded number as plain text; what is rounded to nothing keeps its sign."""
    near = round_halves_up(value, digits)
    return F.when((near == 0) & (value < 0), "-0").otherwise(_text_value(near))


def _lines(row: DataFrame, variable: str, items: list[tuple[str, Column, int]]) -> DataFrame:
    """A line per item; what cannot be told (the deviation of one value) is a line without value."""
    arr = F.array(*[F.struct(F.lit(n).alias("indicator"), _rounded_text(v, d).alias("value")) for n, v, d in items])
    return row.select(F.lit(variable).alias("variable"), F.explode(arr).alias("l")).select("variable", "l.*")


def _top_lines(counts: DataFrame, variable: str, pct_of: Column | None, k: int = 3) -> DataFrame:
    best = top(counts, k, F.desc("docs"), F.asc("entity"))
    ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("docs")).alias("o"), F.col("entity").alias("e"), "docs"))).alias("a"))
    pos = ranked.select(F.posexplode("a").alias("i", "r"))
    pct = F.concat(F.lit(", "), one_decimal(F.col("r.docs") / pct_of * 100), F.lit("%")) if pct_of is not None else F.lit("")
    return pos.select(
        F.lit(variable).alias("variable"), F.concat(F.lit("Top "), F.col("i") + 1).alias("indicator"),
        F.concat(F.col("r.e"), F.lit(" ("), F.col("r.docs"), pct, F.lit(")")).alias("value"),
    )


def describe_string(works: DataFrame, col: str) -> DataFrame:
    """Count, unique, missing and the three commonest values."""
    counts = works.groupBy(F.col(col).cast("string").alias("entity")).agg(F.count(F.lit(1)).alias("docs"))
    known = F.col("entity").isNotNull()
    row = counts.agg(
        F.coalesce(F.sum(F.when(known, F.col("docs"))), F.lit(0)).alias("n"), F.count("entity").alias("u"),
        F.coalesce(F.sum(F.when(~known, F.col("docs"))), F.lit(0)).alias("m"),
    )
    n = counts.agg(F.sum(F.when(known, F.col("docs")))).scalar()
    head = _lines(row, col, [("Count", F.col("n"), 0), ("Unique", F.col("u"), 0), ("Missing", F.col("m"), 0)])
    return head.unionByName(_top_lines(counts.filter(known), col, n))


def describe_list(works: DataFrame, col: str) -> DataFrame:
    """Occurrences, unique items, items per document and the three commonest items."""
    from .counts import count_list

    counts = count_list(works, col)
    with_items = works.agg(F.count_if(F.size(col) > 0)).scalar()
    row = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("u")).withColumn("d", with_items)
    head = _lines(row, col, [
        ("Total occurrences", F.col("n"), 0), ("Unique items", F.col("u"), 0),
        ("Items per document", F.try_divide("n", "d"), 2),
    ])
    return head.unionByName(_top_lines(counts, col, None))


def descriptive_statistics(works: DataFrame, variables: dict[str, str], extra: bool = False) -> DataFrame:
    """Descriptive lines of several variables; kinds are ``numeric``, ``string`` and ``list``."""
    out = None
    for col, kind in variables.items():
        one = describe_numeric(works, col, extra) if kind == "numeric" else (
            describe_string(works, col) if kind == "string" else describe_list(works, col)
        )
        out = one if out is None else out.unionByName(one)
    return out


def all_statistics(works: DataFrame, variables: dict[str, str]) -> DataFrame:
    """Summary, performance, growth and descriptive lines with a value in one ``(section, group, indicator, value)`` table."""
    def part(df: DataFrame, section: str, group: str, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col(group).alias("group"), "indicator", value.alias("value"))

    num = _text_value(F.col("value"))
    return (
        part(dataset_summary(works), "summary", "category", num)
        .unionByName(part(performance(works), "performance", "category", num))
        .unionByName(part(growth_statistics(works), "time series", "category", num))
        .unionByName(part(descriptive_statistics(works, variables).filter("value is not null"), "descriptive", "variable", F.col("value")))
    )
