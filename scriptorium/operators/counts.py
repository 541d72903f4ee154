"""Counting entities: single values, lists, n-grams; ranks, shares and cumulative columns."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import WORD2, explode_entities, ngrams, tokens
from ..functions.ordering import prefix_sums, running, top, total


def count_single(df: DataFrame, col: str) -> DataFrame:
    """``(entity, docs)`` of trimmed non-empty values."""
    return explode_entities(df, col, kind="single").groupBy("entity").agg(F.count(F.lit(1)).alias("docs"))


def count_list(df: DataFrame, col: str, sep: str | None = None, distinct_docs: bool = False) -> DataFrame:
    """``(entity, docs)`` of a multi-valued field.

    A value repeated inside one document counts each time unless ``distinct_docs`` (which removes
    repeats inside the row, before any shuffle).
    """
    long = explode_entities(df, col, sep=sep, distinct=distinct_docs)
    return long.groupBy("entity").agg(F.count(F.lit(1)).alias("docs"))


def count_ngrams(
    df: DataFrame,
    col: str,
    n_min: int = 1,
    n_max: int = 1,
    stop_words: list[str] | None = None,
    max_features: int | None = None,
    per_document: bool = False,
) -> DataFrame:
    """``(entity, docs)`` of word n-grams; stop words go before the n-grams are formed."""
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    grams = ngrams(F.col("_t"), n_min, n_max)
    if per_document:
        grams = F.array_distinct(grams)
    words = df.select(tokens(F.col(col), WORD2, stop).alias("_t"))
    counts = words.select(F.explode(grams).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("docs"))
    return top(counts, max_features, F.desc("docs"), F.asc("entity")) if max_features else counts


def auto_count_type(df: DataFrame, col: str) -> str:
    """``list`` when a separator occurs, ``text`` when values are long, else ``single``."""
    if df.schema[col].dataType.typeName() == "array":
        return "list"
    return count_type_profile(df, col).first()["count_type"]


def count_type_profile(df: DataFrame, col: str) -> DataFrame:
    """One row: ``has_separator``, ``mean_length``, ``count_type`` of the column."""
    v = df.select(F.col(col).cast("string").alias("v")).filter("v is not null")
    row = v.agg(
        F.coalesce(F.bool_or(F.col("v").contains("|") | F.col("v").contains("; ")), F.lit(False)).alias("has_separator"),
        F.avg(F.length("v")).alias("mean_length"),
    )
    kind = F.when(F.col("has_separator"), "list").when(F.col("mean_length") > 100, "text").otherwise("single")
    return row.withColumn("count_type", kind)


def rank_counts(
    counts: DataFrame, min_count: int = 1, top_n: int | None = None, normalise: bool = False, cumulative: bool = False
) -> DataFrame:
    """``rank``, ``percent_rank`` (1 for the first, 0 for the last) and optional share / running columns.

    With ``top_n`` the windows see at most ``top_n`` rows; without it the ranks of all entities come
    from ``prefix_sums``.  All measures refer to the rows that are kept.
    """
    kept = counts.filter(F.col("docs") >= min_count)
    order = [F.desc("docs"), F.asc("entity")]
    if top_n:
        kept = top(kept, top_n, *order)
        whole = Window.partitionBy()
        out = kept.withColumns(
            {
                "rank": F.row_number().over(Window.orderBy(*order)),
                "_cum": F.sum("docs").over(running(*order)),
                "_n": F.count(F.lit(1)).over(whole),
                "_total": F.sum("docs").over(whole),
            }
        )
    else:
        out = prefix_sums(kept, order, {"_cum": "docs"})
        sizes = out.agg(F.max("rank").alias("n"), F.max("_cum").alias("t"))
        out = out.withColumns({"_n": sizes.select("n").scalar(), "_total": sizes.select("t").scalar()})
    cols = {
        "rank": F.col("rank").cast("long"),
        "percent_rank": F.when(F.col("_n") > 1, (F.col("_n") - F.col("rank")) / (F.col("_n") - 1)).otherwise(1.0),
    }
    if normalise:
        cols["share"] = F.col("docs") / F.col("_total")
    if cumulative:
        cols["cumulative"] = F.col("_cum")
        cols["cumulative_pct"] = F.col("_cum") / F.col("_total") * 100
    return out.withColumns(cols).drop("_cum", "_n", "_total")


def count_entity(
    works: DataFrame, col: str, kind: str = "auto", min_count: int = 1, top_n: int | None = None, **extra: bool
) -> DataFrame:
    """Counts of one field with ranks, choosing the count by kind."""
    kind = auto_count_type(works, col) if kind == "auto" else kind
    counts = {"single": count_single, "list": count_list, "text": count_ngrams}[kind](works, col)
    return rank_counts(counts, min_count, top_n, **extra)


def total_of(counts: DataFrame, col: str = "docs"):
    """Grand total of a count table as a scalar column."""
    return total(counts, F.sum(col))
