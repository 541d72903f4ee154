"""Filters on entities and the "selected documents" side outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import explode_entities
from ..functions.ordering import top
from ..functions.patterns import valid_pattern


def include_items(long: DataFrame, items: list[str] | DataFrame, col: str = "entity", fold: bool = False) -> DataFrame:
    """Rows whose entity is listed."""
    return _by_list(long, items, col, fold, "left_semi")


def exclude_items(long: DataFrame, items: list[str] | DataFrame, col: str = "entity", fold: bool = False) -> DataFrame:
    """Rows whose entity is not listed."""
    return _by_list(long, items, col, fold, "left_anti")


def _by_list(long: DataFrame, items, col: str, fold: bool, how: str) -> DataFrame:
    key = F.lower(col) if fold else F.col(col)
    if isinstance(items, list):
        hit = key.isin(*[i.lower() if fold else i for i in items])
        return long.filter(hit if how == "left_semi" else ~hit)
    table = items.select(F.col(items.columns[0]).alias("_item"))
    table = table.select(F.lower("_item").alias("_item")) if fold else table
    return long.join(table, key == F.col("_item"), how)  # Spark broadcasts the list when it is small


def pattern_matches(col: str | Column, pattern: str, literal_fallback: bool = True) -> Column:
    """Case-insensitive search; an invalid pattern is taken literally (or matches everything)."""
    c = F.col(col) if isinstance(col, str) else col
    if not valid_pattern(pattern):
        return F.lower(c).contains(pattern.lower()) if literal_fallback else F.lit(True)
    return c.rlike("(?iu)" + pattern)


def any_pattern(col: str | Column, patterns: str, sep: str = ";") -> Column:
    """OR over a ``;``-separated list of patterns."""
    hit = F.lit(False)
    for p in (p.strip() for p in patterns.split(sep)):
        if p:
            hit = hit | pattern_matches(col, p)
    return hit


def filter_by_pattern(
    long: DataFrame, include: str | None = None, exclude: str | None = None, col: str = "entity"
) -> DataFrame:
    """Keep entities matching ``include`` and not matching ``exclude``; invalid patterns are ignored."""
    if include:
        long = long.filter(pattern_matches(col, include, literal_fallback=False))
    if exclude:
        if valid_pattern(exclude):
            long = long.filter(~pattern_matches(col, exclude))
    return long


def frequent_items(
    counts: DataFrame,
    min_count: int = 1,
    top_n: int | None = 50,
    max_items: int | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    include_pattern: str | None = None,
    exclude_pattern: str | None = None,
) -> DataFrame:
    """Item filter shared by the analyses: lists, patterns, minimum, then ``max_items`` or ``top_n``.

    ``max_items`` wins over ``top_n``; an include list switches ``top_n`` off.
    """
    out = counts.filter(F.col("docs") >= min_count)
    if include:
        out = include_items(out, include)
    out = filter_by_pattern(out, include_pattern, exclude_pattern)
    if exclude:
        out = exclude_items(out, exclude)
    limit = max_items or (None if include else top_n)
    return top(out, limit, F.desc("docs"), F.asc("entity")) if limit else out


def in_places(works: DataFrame, places: str, regions: DataFrame, col: str = "countries") -> DataFrame:
    """Works with at least one country among the named places (comma-separated, any case).

    A place is a country name, a code or a region of ``regions (region, country, code)``; a place
    found in none of them is used as a country name.
    """
    wanted = [p.strip().lower() for p in places.split(",") if p.strip()]
    r = regions.select(*[F.lower(c).alias(c) for c in ("region", "country", "code")])
    hit = r.filter(
        F.col("region").isin(*wanted) | F.col("country").isin(*wanted) | F.col("code").isin(*wanted)
    )
    # one value: at most all country names and codes, a table of fixed small size
    names = hit.agg(F.array_union(F.collect_set("country"), F.collect_set("code")).alias("a")).scalar()
    targets = F.array_union(names, F.array(*[F.lit(w) for w in wanted]))
    folded = F.transform(col, lambda c: F.lower(F.trim(c)))
    return works.filter(F.arrays_overlap(folded, targets))


def documents_with(works: DataFrame, col: str, items: list[str], kind: str = "list", fold: bool = False) -> DataFrame:
    """Documents holding any of the items; for ``text`` any item as part of the text."""
    if kind == "text":
        hit = F.lit(False)
        for i in items:
            hit = hit | F.lower(col).contains(i.lower())
        return works.filter(hit)
    wanted = [i.strip().lower() if fold else i.strip() for i in items]
    norm = (lambda x: F.lower(F.trim(x))) if fold else (lambda x: F.trim(x))
    if kind == "single":
        return works.filter(norm(F.col(col).cast("string")).isin(*wanted))
    return works.filter(F.exists(col, lambda x: norm(x).isin(*wanted)))


def documents_with_cells(works: DataFrame, row_col: str, column_col: str, cells: DataFrame) -> DataFrame:
    """Documents that hold both ends of at least one selected ``(row, col)`` cell or flow."""
    rows = explode_entities(works, row_col, distinct=True).withColumnRenamed("entity", "row")
    near = rows.join(cells.select("row", "col").distinct(), "row")
    cols = explode_entities(works, column_col, distinct=True).withColumnRenamed("entity", "col")
    hit = near.join(cols, ["doc_id", "col"], "left_semi").select("doc_id").distinct()
    return works.join(hit, "doc_id", "left_semi")


def documents_by_ids(works: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose ``doc_id`` occurs in a selection."""
    return works.join(ids.select("doc_id"), "doc_id", "left_semi")


def annotate_selected(works: DataFrame, ids: DataFrame, out: str = "selected") -> DataFrame:
    """All rows with a yes/no flag for being in the selection."""
    marks = ids.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return works.join(marks, "doc_id", "left").withColumn(out, F.when(F.col("_hit"), "Yes").otherwise("No")).drop("_hit")


def in_ranges(df: DataFrame, col: str, ranges: list[tuple[float, float]]) -> DataFrame:
    """Rows in any half-open range ``[low, high)``; a literal condition, so it reaches the scan."""
    hit = F.lit(False)
    for low, high in ranges:
        hit = hit | ((F.col(col) >= low) & (F.col(col) < high))
    return df.filter(hit)


def range_report(works: DataFrame, ranges: list[tuple[float, float]], col: str = "cited_by") -> DataFrame:
    """Per range: papers, total, mean, median, max; ranges may overlap, empty ones are left out."""
    c = F.coalesce(F.col(col), F.lit(0))
    hits = F.array(*[
        F.when((c >= low) & (c < high), F.struct(F.lit(i).alias("no"), F.lit(f"{low:.0f}-{high:.0f}").alias("bin")))
        for i, (low, high) in enumerate(sorted(ranges))
    ])
    # collapse to (bin, value) first: the percentile buffers then see distinct values only
    long = works.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("r"), c.alias("c"))
    vals = long.groupBy("r.bin", "c").agg(F.count(F.lit(1)).alias("n"))
    return vals.groupBy("bin").agg(
        F.sum("n").alias("papers"),
        F.sum(F.col("n") * F.col("c")).alias("total_citations"),
        F.round(F.sum(F.col("n") * F.col("c")) / F.sum("n"), 2).alias("mean_citations"),
        F.floor(F.percentile("c", F.lit(0.5), F.col("n"))).alias("median_citations"),
        F.max("c").alias("max_citations"),
    )


def year_between(df: DataFrame, year_from: int | None = None, year_to: int | None = None, col: str = "year") -> DataFrame:
    """Inclusive year range; an unset end means no bound (rows without a year are dropped)."""
    out = df.filter(F.col(col).isNotNull())
    if year_from:
        out = out.filter(F.col(col) >= year_from)
    if year_to:
        out = out.filter(F.col(col) <= year_to)
    return out


def top_cited_subset(works: DataFrame, min_citations: int = 0, n: int = 50) -> DataFrame:
    """At least ``min_citations``, then the ``n`` most cited (ties by doc_id)."""
    return top(works.filter(F.col("cited_by") >= min_citations), n, F.desc("cited_by"), F.asc("doc_id"))


def pick(result: DataFrame, key: str, values: list, columns: list[str] | None = None) -> DataFrame:
    """Result rows whose key is among the picked ones, with a fixed column list."""
    out = result.filter(F.col(key).isin(*values))
    return out.select(*columns) if columns else out
