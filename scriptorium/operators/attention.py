"""Attention counts per work: weighted score, summary, years, coverage, top works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import top
from ..functions.quantiles import exact_percentiles

# Sources of attention and their weights in the score.
WEIGHTS = {
    "twitter_count": 1.0,
    "facebook_count": 0.25,
    "mendeley_count": 0.5,
    "news_count": 8.0,
    "blog_count": 5.0,
    "policy_count": 10.0,
    "wikipedia_count": 3.0,
    "reddit_count": 0.25,
    "video_count": 5.0,
    "peer_review_count": 1.0,
}


def present(df: DataFrame) -> list[str]:
    return [c for c in WEIGHTS if c in df.columns]


def attention_score(df: DataFrame) -> DataFrame:
    """Adds ``attention_score`` (weighted sum of the counts that are there, 2 digits) and ``has_attention``."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) * WEIGHTS[c] for c in present(df)), F.lit(0.0))
    return df.withColumn("attention_score", F.round(total, 2)).withColumn("has_attention", (F.col("attention_score") > 0).cast("int"))


def attention_summary(scored: DataFrame) -> DataFrame:
    """One row: works, with attention, rate, mean, median and largest score, total per source; the median is found first."""
    (median,) = exact_percentiles(scored, "attention_score", [0.5])
    return scored.agg(
        F.count(F.lit(1)).alias("n_papers"), F.sum("has_attention").alias("n_with_attention"),
        (F.sum("has_attention") / F.count(F.lit(1))).alias("attention_rate"), F.avg("attention_score").alias("mean_score"),
        F.max(F.lit(median).cast("double")).alias("median_score"), F.max("attention_score").alias("max_score"),
        *[F.sum(c).cast("long").alias(f"total_{c}") for c in present(scored)],
    )


def attention_by_year(scored: DataFrame, sources: tuple[str, ...] = ("twitter_count", "mendeley_count")) -> DataFrame:
    """``(year, mean_score, <source sums>)``."""
    return scored.filter("year is not null").groupBy("year").agg(
        F.avg("attention_score").alias("mean_score"), *[F.sum(c).cast("long").alias(c) for c in sources if c in scored.columns]
    )


def coverage(scored: DataFrame) -> DataFrame:
    """``(source, coverage_pct)``: share of works with a count above zero, in one pass."""
    cols = present(scored)
    row = scored.agg(*[(F.count_if(F.col(c) > 0) / F.count(F.lit(1)) * 100).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("coverage_pct")) for c in cols])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def top_attention(scored: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` works with the highest score (ties by id)."""
    return top(scored, n, F.desc("attention_score"), F.asc("doc_id"))


def score_histogram(scored: DataFrame, bins: int = 29) -> DataFrame:
    """Histogram of ln(score + 1) from 0 to its maximum plus a half."""
    from .distribution import histogram

    high = scored.agg(F.max(F.ln(F.col("attention_score") + 1))).first()[0]
    logs = scored.select(F.ln(F.col("attention_score") + 1).alias("log_score"))
    return histogram(logs, "log_score", bins, low=0.0, high=(high or 0.0) + 0.5)
