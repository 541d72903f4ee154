"""Contingency tables of entities against entities or groups, and the statistics on them.

A table is long ``(row, col, n)`` with at most ``top rows x top columns`` cells; documents are only
touched once, to count the cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linear
from ..functions.lists import array_value, clean_items, explode_entities, keep_only, ordered_pairs
from ..functions.numeric import chi2_tail
from ..functions.ordering import top
from ..functions.scratch import cut
from .groups import grouped_entities
from .selection import any_pattern, frequent_items


def _items(col: str, kind: str) -> Column:
    return clean_items(F.col(col) if kind == "list" else F.array(F.col(col).cast("string")))


def _kept(works: DataFrame, col: str, kind: str, top_n: int | None, filters: dict) -> Column:
    long = explode_entities(works, col, kind=kind)
    counts = long.groupBy("entity").agg(F.count(F.lit(1)).alias("docs"))
    return array_value(frequent_items(counts, top_n=top_n, **filters))


def cooccurrence(
    works: DataFrame, row_col: str, col_col: str, row_kind: str = "list", col_kind: str = "list",
    top_rows: int | None = 50, top_cols: int | None = 50, row_filters: dict | None = None, col_filters: dict | None = None,
) -> DataFrame:
    """``(row, col, n)``: every pair of a row item and a column item of one document adds one.

    The items are cut to the kept ones inside the row before pairs are formed, so the only shuffle
    carries pre-aggregated cells.
    """
    # written once: both choices of items and the pairs read the lists, not what they were made from
    works = cut(works.select("doc_id", *dict.fromkeys((row_col, col_col))))
    lists = works.select(_items(row_col, row_kind).alias("_r"), _items(col_col, col_kind).alias("_c"))
    if top_rows or row_filters:
        lists = keep_only(lists, "_r", F.col("_r"), _kept(works, row_col, row_kind, top_rows, row_filters or {}))
    if top_cols or col_filters:
        lists = keep_only(lists, "_c", F.col("_c"), _kept(works, col_col, col_kind, top_cols, col_filters or {}))
    pairs = lists.select(F.explode(ordered_pairs(F.col("_r"), F.col("_c"))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("row"), F.col("p.b").alias("col")).agg(F.count(F.lit(1)).alias("n"))


def group_table(
    works: DataFrame, col: str, kind: str = "list", min_freq: int = 1, top_n: int = 50,
    include: str | None = None, exclude: str | None = None, max_features: int | None = None,
) -> DataFrame:
    """``(row, col, n)`` of entities against groups: total at least ``min_freq``, top ``top_n`` rows.

    For ``text`` the rows are words and word pairs, counted once per document (the ``max_features`` commonest, if given).
    The patterns (``;``-separated) apply to the rows that are left.
    """
    long = grouped_entities(works, col, kind)
    # written once: the totals and the rows of the table both read the cells, not the documents again
    cells = cut(long.groupBy(F.col("entity").alias("row"), F.col("group").alias("col")).agg(F.count(F.lit(1)).alias("n")))
    totals = cells.groupBy("row").agg(F.sum("n").alias("t"))
    if kind == "text" and max_features:
        totals = top(totals, max_features, F.desc("t"), F.asc("row"))
    best = top(totals.filter(F.col("t") >= min_freq), top_n, F.desc("t"), F.asc("row"))
    out = cells.join(best, "row", "left_semi")
    if include:
        out = out.filter(any_pattern("row", include))
    if exclude:
        out = out.filter(~any_pattern("row", exclude))
    return out


def with_totals(cells: DataFrame) -> DataFrame:
    """Adds row, column and grand totals as small joined tables (no window over a hot column).

    The table is short (top rows times top columns) and read several times, so it is written once.
    """
    cells = cut(cells)
    r = cells.groupBy("row").agg(F.sum("n").alias("row_total"))
    c = cells.groupBy("col").agg(F.sum("n").alias("col_total"))
    g = cells.agg(F.sum("n")).scalar()
    return cells.join(r, "row").join(c, "col").withColumn("total", g)


def full_table(cells: DataFrame) -> DataFrame:
    """All cells of the table, zeros included, with totals."""
    cells = cut(cells)
    r = cells.groupBy("row").agg(F.sum("n").alias("row_total"))
    c = cells.groupBy("col").agg(F.sum("n").alias("col_total"))
    grid = r.select("row", "row_total", F.explode(array_value(c, "col")).alias("col")).join(c, "col")
    out = grid.join(cells, ["row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("total", cells.agg(F.sum("n")).scalar())


def wide_table(cells: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per row item, one column per column item, and ``total``."""
    piv = cells.groupBy("row").pivot("col", names).agg(F.sum("n")) if names else cells.groupBy("row").pivot("col").agg(F.sum("n"))
    cols = [c for c in piv.columns if c != "row"]
    out = piv.fillna(0, cols)
    return out.withColumn("total", sum((F.col(f"`{c}`") for c in cols), F.lit(0)))


def chi_square_cells(cells: DataFrame) -> DataFrame:
    """Per cell: observed, expected (2 digits), standardised residual (3), contribution (4)."""
    d = full_table(cells).withColumn("e", F.col("row_total") * F.col("col_total") / F.col("total"))
    diff = F.col("n") - F.col("e")
    return d.select(
        "row", "col", F.col("n").alias("observed"), F.round("e", 2).alias("expected"),
        F.round(diff / F.sqrt("e"), 3).alias("std_residual"), F.round(diff * diff / F.col("e"), 4).alias("contribution"),
    )


def chi_square_test(cells: DataFrame) -> DataFrame:
    """One row ``(chi2, df, p)``; a 2 x 2 table gets the continuity correction."""
    d = full_table(cells).withColumn("e", F.col("row_total") * F.col("col_total") / F.col("total"))
    gap = F.abs(F.col("n") - F.col("e"))
    row = d.agg(
        F.sum(gap * gap / F.col("e")).alias("plain"),
        F.sum(F.pow(gap - F.least(F.lit(0.5), gap), 2) / F.col("e")).alias("yates"),
        F.count_distinct("row").alias("r"), F.count_distinct("col").alias("c"),
    )
    df = (F.col("r") - 1) * (F.col("c") - 1)
    out = row.select(F.when(df == 1, F.col("yates")).otherwise(F.col("plain")).alias("chi2"), df.alias("df"))
    return out.withColumn("p", chi2_tail("chi2", F.col("df").cast("double")))


def chi_square_entities(cells: DataFrame) -> DataFrame:
    """Long per entity and group: observed, expected, residual, std_residual and the entity's contribution."""
    d = full_table(cells).withColumn("e", F.col("row_total") * F.col("col_total") / F.col("total"))
    diff = F.col("n") - F.col("e")
    contrib = d.groupBy("row").agg(F.round(F.sum(diff * diff / F.col("e")), 4).alias("contribution"))
    return d.join(contrib, "row").select(
        "row", "col", "contribution", F.col("n").alias("observed"), F.round("e", 2).alias("expected"),
        F.round(diff, 2).alias("residual"), F.round(diff / F.sqrt("e"), 3).alias("std_residual"),
    )


def associations(cells: DataFrame) -> DataFrame:
    """Jaccard, Dice, PMI and NPMI (base 2, 4 digits) of the non-zero cells."""
    d = with_totals(cells.filter("n > 0"))
    n, r, c, t = (F.col(x) for x in ("n", "row_total", "col_total", "total"))
    p = n / t
    pmi = F.log2(p / ((r / t) * (c / t)))
    return d.select(
        "row", "col", "n", F.round(n / (r + c - n), 4).alias("jaccard"), F.round(2 * n / (r + c), 4).alias("dice"),
        F.round(pmi, 4).alias("pmi"), F.round(F.when(p < 1, pmi / -F.log2(p)).otherwise(0.0), 4).alias("npmi"),
    )


def diversity(cells: DataFrame) -> DataFrame:
    """Per group: entities, documents, Shannon H, its maximum and evenness, Simpson D and 1 - D."""
    t = cells.groupBy("col").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    d = cells.filter("n > 0").join(t, "col").groupBy(F.col("col").alias("group")).agg(
        F.count(F.lit(1)).alias("entities"), F.sum("n").alias("docs"),
        (-F.sum(p * F.ln(p))).alias("h"), F.sum(p * p).alias("s"),
    )
    hmax = F.when(F.col("entities") > 1, F.ln("entities")).otherwise(0.0)
    return d.select(
        "group", "entities", "docs", F.round("h", 4).alias("shannon_h"), F.round(hmax, 4).alias("shannon_max"),
        F.round(F.when(hmax > 0, F.col("h") / hmax).otherwise(0.0), 4).alias("evenness"),
        F.round("s", 6).alias("simpson_d"), F.round(1 - F.col("s"), 6).alias("simpson_1_d"),
    )


def log_ratio(cells: DataFrame) -> DataFrame:
    """log2 of the smoothed share of an entity in one group over another, for every pair of groups."""
    d = full_table(cells)
    k = cells.agg(F.count_distinct("row")).scalar()
    d = d.withColumn("_k", k).withColumn("p", (F.col("n") + 0.5) / (F.col("col_total") + 0.5 * F.col("_k")))
    # as many values per entity as there are groups
    lists = d.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "p"))).alias("v"))
    from ..functions.lists import unordered_pairs

    pairs = lists.select("row", F.explode(unordered_pairs(F.col("v"))).alias("x"))
    return pairs.select(
        "row", F.col("x.a.col").alias("group_a"), F.col("x.b.col").alias("group_b"),
        F.round(F.log2(F.col("x.a.p") / F.col("x.b.p")), 4).alias("log_ratio"),
    )


def row_shares(cells: DataFrame) -> DataFrame:
    """Cell over row total."""
    return with_totals(cells).select("row", "col", "n", (F.col("n") / F.col("row_total")).alias("share"))


def strong_residuals(cells: DataFrame, threshold: float) -> DataFrame:
    """Cells whose absolute standardised residual reaches the threshold."""
    return chi_square_cells(cells).filter(F.abs("std_residual") >= threshold)


def edges(cells: DataFrame, min_weight: int = 1) -> DataFrame:
    """Bipartite edges with at least the given weight."""
    return cells.filter(F.col("n") >= min_weight).select("row", "col", F.col("n").alias("weight"))


# --- decompositions -----------------------------------------------------------------------------


def _row_lists(cells: DataFrame, value: Column) -> DataFrame:
    """Per row item the array of ``(item, value)``; as long as the number of columns."""
    return cells.groupBy("row").agg(F.collect_list(F.struct(F.col("col").alias("item"), value.alias("value"))).alias("v"))


def correspondence(cells: DataFrame, dims: int = 3) -> DataFrame:
    """Correspondence analysis: ``(item, type, dim_1 …)`` for rows and columns, and the inertia shares.

    Works on the non-zero cells: the Gram matrix of the standardised residuals is the one of the
    profiles minus the rank-one expected part.  Inertia shares refer to the reported number of
    dimensions, at most min(rows, columns, 10) - 1.
    """
    d = with_totals(cells.filter("n > 0"))
    n_rows = cells.select("row").distinct().count()
    profile = F.col("n") / F.sqrt(F.col("row_total").cast("double")) / F.sqrt(F.col("col_total").cast("double"))
    names, g = linear.dense(linear.gram(_row_lists(d, profile), F.col("v")))
    masses = {r["col"]: float(r["m"]) for r in d.groupBy("col").agg(F.max(F.col("col_total") / F.col("total")).alias("m")).limit(linear.LIMIT).collect()}
    mass = np.array([masses[n] for n in names])
    root = np.sqrt(mass)
    k = min(n_rows, len(names), 10) - 1
    if k < 1:
        raise ValueError("correspondence analysis needs at least two rows and two columns")
    values, vectors, _ = linear.eigen(g - np.outer(root, root), k)
    shown = min(k, dims)
    axes = {f"dim_{i + 1}": vectors[:, i] / root for i in range(shown)}
    spark = cells.sparkSession
    weights = linear.frame(spark, names, axes)
    rows = d.join(weights, d["col"] == weights["item"]).groupBy("row").agg(
        *[F.sum(F.col("n") / F.col("row_total") * F.col(a)).alias(a) for a in axes]
    )
    rows = rows.select(F.col("row").alias("item"), F.lit("row").alias("type"), *axes)
    cols = linear.frame(spark, names, {a: v * np.sqrt(values[i]) for i, (a, v) in enumerate(axes.items())})
    cols = cols.select("item", F.lit("column").alias("type"), *axes)
    share = values / values.sum() * 100 if values.sum() > 0 else values
    info = linear.frame(spark, ["inertia %"], {a: share[i : i + 1] for i, a in enumerate(axes)})
    return rows.unionByName(cols).unionByName(info.select("item", F.lit("info").alias("type"), *axes))


def singular_values(cells: DataFrame, k: int = 5, loadings: int = 3) -> DataFrame:
    """SVD of the table with columns scaled to one: ``(item, type, component, value)``.

    Types are singular_value, variance_pct, entity and group.
    """
    d = with_totals(cells.filter("n > 0"))
    x = F.col("n") / F.col("col_total")
    names, g = linear.dense(linear.gram(_row_lists(d, x), F.col("v")))
    values, vectors, trace = linear.eigen(g, k)
    s = np.sqrt(values)
    spark = cells.sparkSession
    out = [("", "singular_value", i + 1, float(s[i])) for i in range(len(s))]
    out += [("", "variance_pct", i + 1, float(values[i] / trace * 100)) for i in range(len(s))]
    m = min(len(s), loadings)
    out += [(n, "group", i + 1, float(vectors[j, i])) for i in range(m) for j, n in enumerate(names)]
    small = spark.createDataFrame(out, "item string, type string, component int, value double")
    axes = {f"c{i + 1}": vectors[:, i] / max(s[i], 1e-300) for i in range(m)}
    w = linear.frame(spark, names, axes)
    rows = d.join(w, d["col"] == w["item"]).groupBy("row").agg(*[F.sum(x * F.col(a)).alias(a) for a in axes])
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col(a).alias("value")) for i, a in enumerate(axes)])
    ent = rows.select(F.col("row").alias("item"), F.lit("entity").alias("type"), F.explode(pairs).alias("p")).select("item", "type", "p.*")
    return small.unionByName(ent)
