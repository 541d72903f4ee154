"""Frequency laws on entity counts.

All laws start from ``(entity, docs)`` and first collapse to ``(docs, number of entities)``.  With
``m`` occurrences in total there are at most ``sqrt(2 m)`` different counts, so the windows below
run on that short table and never on the entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import ENGLISH_WORD, tokens
from ..functions.ordering import prefix_sums, running, total


def sizes(counts: DataFrame) -> DataFrame:
    """``(docs, entities)``: how many entities have each count."""
    return counts.groupBy("docs").agg(F.count(F.lit(1)).alias("entities"))


def _levels(counts: DataFrame) -> DataFrame:
    """Sizes with ``n_to`` / ``s_to`` (entities and documents down to this count) and grand totals."""
    w = running(F.desc("docs"))
    out = sizes(counts).withColumns({"n_to": F.sum("entities").over(w), "s_to": F.sum(F.col("entities") * F.col("docs")).over(w)})
    return out


def _totals(levels: DataFrame) -> dict[str, Column]:
    return {"n_total": F.max("n_to"), "total_output": F.max("s_to")}


def lotka(counts: DataFrame) -> DataFrame:
    """``(x, observed, observed_share, theoretical_share, exponent, constant, r_squared, label, …)``.

    Least squares of ln(entities) on ln(documents); a single point gives exponent 2.
    """
    pts = sizes(counts).select(F.col("docs").alias("x"), F.col("entities").alias("observed"))
    lx, ly = F.ln("x"), F.ln("observed")
    fit = pts.agg(
        F.count(F.lit(1)).alias("k"), F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("a"),
        F.regr_r2(ly, lx).alias("r2"), F.sum("observed").alias("ents"),
        F.sum(F.col("x") * F.col("observed")).alias("occ"), F.first("observed").alias("y0"),
    )
    single = F.col("k") == 1
    fit = fit.select(
        F.when(single, 2.0).otherwise(-F.col("slope")).alias("exponent"),
        F.when(single, F.col("y0").cast("double")).otherwise(F.exp("a")).alias("constant"),
        F.when(single, 0.0).otherwise(F.col("r2")).alias("r_squared"),
        F.col("ents").alias("total_entities"), F.col("occ").alias("total_contributions"),
    )
    row = fit.select(F.struct("*").alias("s")).scalar()
    out = pts.withColumn("_f", row).select("x", "observed", "_f.*")
    theory = F.col("constant") / F.pow("x", F.col("exponent"))
    whole = Window.partitionBy()  # one row per distinct count
    return out.select(
        "x", "observed",
        (F.col("observed") / F.col("total_entities")).alias("observed_share"),
        (theory / F.sum(theory).over(whole)).alias("theoretical_share"),
        "exponent", "constant", "r_squared",
        F.when(F.col("exponent").between(1.5, 2.5), "classic").otherwise("deviation").alias("label"),
        "total_entities", "total_contributions",
    )


def bradford(counts: DataFrame) -> DataFrame:
    """One row per zone: ``zone, sources, articles, multiplier``.

    A zone ends with the source whose running total first reaches one or two thirds.  Sources of
    equal count are interchangeable here, so the cut inside a level is arithmetic.
    """
    lv = _levels(counts)
    t = lv.agg(F.max("s_to")).scalar()
    n0, s0 = F.col("n_to") - F.col("entities"), F.col("s_to") - F.col("entities") * F.col("docs")

    def cut(k: int) -> list[Column]:
        goal3 = k * F.col("t")  # compare 3*sum with k*total in integers
        inside = F.ceil((goal3 - 3 * s0) / (3 * F.col("docs"))).cast("long")
        hit = (3 * s0 < goal3) & (goal3 <= 3 * F.col("s_to"))
        return [
            F.max(F.when(hit, n0 + inside)).alias(f"n{k}"),
            F.max(F.when(hit, s0 + inside * F.col("docs"))).alias(f"s{k}"),
        ]

    one = lv.withColumn("t", t).agg(
        *cut(1), *cut(2), F.max("n_to").alias("n3"), F.max("s_to").alias("s3")
    )
    z1, z2, z3 = F.col("n1"), F.col("n2") - F.col("n1"), F.col("n3") - F.col("n2")
    mult = F.when((z1 > 0) & (z2 > 0), (z2 / z1 + z3 / z2) / 2)
    zones = F.array(
        F.struct(F.lit(1).alias("zone"), z1.alias("sources"), F.col("s1").alias("articles")),
        F.struct(F.lit(2).alias("zone"), z2.alias("sources"), (F.col("s2") - F.col("s1")).alias("articles")),
        F.struct(F.lit(3).alias("zone"), z3.alias("sources"), (F.col("s3") - F.col("s2")).alias("articles")),
    )
    return one.select(F.explode(zones).alias("z"), mult.alias("multiplier")).select("z.*", "multiplier")


def bradford_sources(counts: DataFrame) -> DataFrame:
    """Every source with ``rank``, running total and zone."""
    ranked = prefix_sums(counts, [F.desc("docs"), F.asc("entity")], {"cumulative": "docs"})
    t = total(counts, F.sum("docs"))
    before = F.col("cumulative") - F.col("docs")
    zone = F.when(3 * before < t, 1).when(3 * before < 2 * t, 2).otherwise(3)
    return ranked.select("entity", "docs", F.col("rank").cast("long").alias("rank"), "cumulative", zone.alias("zone"))


def word_counts(df: DataFrame, col: str) -> DataFrame:
    """``(entity, docs)`` of English words of three letters or more."""
    words = df.select(F.explode(tokens(F.col(col), ENGLISH_WORD)).alias("entity"))
    return words.groupBy("entity").agg(F.count(F.lit(1)).alias("docs"))


def zipf(counts: DataFrame) -> DataFrame:
    """One row: exponent, constant, r_squared of ln(frequency) on ln(rank), words, occurrences."""
    ranked = prefix_sums(counts, [F.desc("docs"), F.asc("entity")])
    lx, ly = F.ln("rank"), F.ln("docs")
    single = F.col("words") == 1
    return ranked.agg(
        F.count(F.lit(1)).alias("words"), F.sum("docs").alias("occurrences"),
        F.regr_slope(ly, lx).alias("s"), F.regr_intercept(ly, lx).alias("a"), F.regr_r2(ly, lx).alias("r2"),
        F.max("docs").alias("f0"),
    ).select(
        F.when(single, 1.0).otherwise(-F.col("s")).alias("exponent"),
        F.when(single, F.col("f0").cast("double")).otherwise(F.exp("a")).alias("constant"),
        F.when(single, 0.0).otherwise(F.col("r2")).alias("r_squared"),
        "words", "occurrences",
    )


def _share_of_top(levels: DataFrame, n_top: Column) -> Column:
    """Output of the first ``n_top`` entities (columns ``n_to``, ``s_to``, ``entities``, ``docs``)."""
    n0, s0 = F.col("n_to") - F.col("entities"), F.col("s_to") - F.col("entities") * F.col("docs")
    hit = (n0 < n_top) & (n_top <= F.col("n_to"))
    return F.max(F.when(hit, s0 + (n_top - n0) * F.col("docs")))


def _needed(goal: Column) -> Column:
    """Smallest number of top entities whose output reaches ``goal``."""
    n0, s0 = F.col("n_to") - F.col("entities"), F.col("s_to") - F.col("entities") * F.col("docs")
    hit = (s0 < goal) & (goal <= F.col("s_to"))
    return F.max(F.when(hit, n0 + F.ceil((goal - s0) / F.col("docs"))))


def _with_totals(counts: DataFrame) -> DataFrame:
    lv = _levels(counts)
    t = lv.agg(F.struct(F.max("n_to").alias("n_total"), F.max("s_to").alias("total_output")).alias("t")).scalar()
    return lv.withColumn("_t", t).select("docs", "entities", "n_to", "s_to", "_t.*")


def price(counts: DataFrame) -> DataFrame:
    """The square root of all entities should give half of the output."""
    lv = _with_totals(counts)
    elite = F.ceil(F.sqrt("n_total"))
    return lv.agg(
        F.max("n_total").alias("n_total"), F.max(elite).alias("n_elite"),
        _share_of_top(lv, elite).alias("elite_output"), F.max("total_output").alias("total_output"),
        _needed(F.col("total_output") * 0.5).cast("long").alias("n_for_50"),
    ).withColumn("elite_share", F.col("elite_output") / F.col("total_output")).withColumn(
        "holds", F.col("elite_share") >= 0.5
    )


def pareto(counts: DataFrame) -> DataFrame:
    """A fifth of all entities should give four fifths of the output."""
    lv = _with_totals(counts)
    fifth = F.greatest(F.lit(1), F.ceil(F.col("n_total") * 0.2))
    return (
        lv.agg(
            F.max("n_total").alias("n_total"), F.max(fifth).alias("n_top"),
            _share_of_top(lv, fifth).alias("top_output"), F.max("total_output").alias("total_output"),
            _needed(F.col("total_output") * 0.8).cast("long").alias("n_for_80"),
        )
        .withColumn("top_share", F.col("top_output") / F.col("total_output"))
        .withColumn("pct_for_80", F.col("n_for_80") / F.col("n_total") * 100)
        .withColumn("holds", F.col("top_share") >= 0.8)
    )


def law_counts(works: DataFrame, col: str, law: str) -> DataFrame:
    """Counts for a law: Bradford takes whole values, the others split lists."""
    from .counts import count_list, count_single

    return count_single(works, col) if law == "bradford" else count_list(works, col)


def enough_entities(counts: DataFrame) -> str:
    """``error`` under 3 entities, ``warning`` under 10, else ``ok`` (at most ten rows are read)."""
    n = counts.limit(10).count()
    return "error" if n < 3 else "warning" if n < 10 else "ok"
