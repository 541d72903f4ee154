"""Citation indices and statistics per entity or for the whole collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indices import g_expr, h_expr, profile, ranked_profile
from ..functions.lists import explode_entities

CORE = ("docs", "total_citations", "h_index", "mean_year")
EXTENDED = (*CORE, "g_index")
FULL = (*EXTENDED, "w_index", "hg_index", "mean_citations")
DEPTHS = {"core": CORE, "extended": EXTENDED, "full": FULL}


def indices(df: DataFrame, keys: list[str], cites: str = "cited_by", year: str | None = "year") -> DataFrame:
    """Per key: docs, citations, h, g, w, hg, a, r, Gini, mean citations and mean year, in one plan.

    Documents are collapsed to ``(key, citation count)`` map-side; only those rows are shuffled to
    the per-key windows.
    """
    extra: dict[str, Column] = {}
    if year and year in df.columns:
        extra = {"sy": F.sum(year), "ny": F.count(year)}
    prof = ranked_profile(profile(df, keys, cites, **extra), keys)
    n, c = F.col("n"), F.col("c")
    above = F.col("n_to") - n  # documents with a higher count
    aggs = {
        "docs": F.sum("n"), "total_citations": F.sum(n * c), "h_index": h_expr(), "g_index": g_expr(),
        "w_index": h_expr(10), "_desc_weighted": F.sum(c * (n * above + n * (n + 1) / 2)),
    }
    if extra:
        aggs |= {"_sy": F.sum("sy"), "_ny": F.sum("ny")}
    out = prof.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])
    nn, s = F.col("docs"), F.col("total_citations")
    # sum over ascending ranks = (n+1) * S - sum over descending ranks
    gini = F.when((nn >= 2) & (s > 0), ((nn + 1) * s - 2 * F.col("_desc_weighted")) / (nn * s)).otherwise(0.0)
    out = out.withColumns(
        {
            "hg_index": F.sqrt(F.col("h_index") * F.col("g_index")),
            "mean_citations": s / nn,
            "gini": gini,
        }
    )
    if extra:
        out = out.withColumn("mean_year", F.col("_sy") / F.nullif("_ny", F.lit(0))).drop("_sy", "_ny")
    return out.drop("_desc_weighted")


def core_indices(df: DataFrame, keys: list[str], cites: str = "cited_by") -> DataFrame:
    """``h_index, a_index, r_index``: mean and root of the sum of the h most cited documents."""
    prof = ranked_profile(profile(df, keys, cites), keys)
    h = prof.groupBy(*keys).agg(h_expr().alias("h_index"))
    levels = prof.join(h, keys) if keys else prof.withColumn("h_index", h.scalar())
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("h_index") - (F.col("n_to") - F.col("n"))))
    out = levels.groupBy(*keys, "h_index").agg(F.sum(taken * F.col("c")).alias("_core"))
    return out.select(
        *keys, "h_index",
        F.when(F.col("h_index") > 0, F.col("_core") / F.col("h_index")).otherwise(0.0).alias("a_index"),
        F.sqrt("_core").alias("r_index"),
    )


def gini(df: DataFrame, keys: list[str], cites: str = "cited_by") -> DataFrame:
    """``gini`` and the ``gini_shifted`` variant, which is the former minus 1/n."""
    return indices(df, keys, cites, year=None).select(
        *keys, "docs", "gini",
        F.when(F.col("total_citations") > 0, F.col("gini") - 1 / F.col("docs")).otherwise(0.0).alias("gini_shifted"),
    )


def entity_stats(
    works: DataFrame,
    col: str,
    kind: str = "list",
    depth: str = "core",
    counts: DataFrame | None = None,
    top_n: int | None = 50,
    **filters,
) -> DataFrame:
    """Indices of the top entities of one field (membership is exact on documents and citations).

    The item filter runs on the count table first; the long table is then cut to the kept entities
    by a join whose small side Spark broadcasts, before anything is shuffled.
    """
    from .counts import count_list, count_single
    from .selection import frequent_items

    long = explode_entities(works, col, "cited_by", "year", kind=kind, distinct=True)
    if top_n or filters:
        counted = counts if counts is not None else (count_single(works, col) if kind == "single" else count_list(works, col))
        kept = frequent_items(counted, top_n=top_n, **filters).select("entity")
        long = long.join(kept, "entity", "left_semi")
    return indices(long, ["entity"]).select("entity", *DEPTHS[depth])


def thresholds(works: DataFrame, cites: str = "cited_by", levels: tuple[int, ...] = (1, 5, 10, 25, 50, 100)) -> DataFrame:
    """``(threshold, docs)`` with at least that many citations; empty levels are left out."""
    c = F.coalesce(F.col(cites), F.lit(0))
    row = works.agg(*[F.count_if(c >= t).alias(f"t{t}") for t in levels])
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("docs")) for t in levels])
    return row.select(F.explode(pairs).alias("p")).select("p.*").filter("docs > 0")
