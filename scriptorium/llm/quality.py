"""Quality rules with thresholds that follow each language and source; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The features that are judged, and the side on which a text can be an outlier.
RULES = {"symbol_share": 1, "dup_line_share": 1, "word_length": 1, "word_length_low": -1}


def _windows(words: Column, size: int) -> Column:
    """One hash per run of ``size`` words."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(-1)))
    return F.when(F.size(words) < size, F.array().cast("array<bigint>")).otherwise(
        F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    )


def base_columns(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text.

    Everything stays inside the row.  Repeated windows are found by sorting their hashes (only in texts
    that have any): ``n log n`` for a text of ``n`` words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumns({"_words": F.regexp_extract_all(text, F.lit(WORD), 0), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))})
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": _windows(F.col("_words"), window),
    }).drop("_words", "_lines")
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(twice, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_placed", placed).drop("_windows")
    marked = F.transform("_placed", lambda p, j: F.when((p["h"] == F.get("_placed", j - 1)["h"]) | (p["h"] == F.get("_placed", j + 1)["h"]), p["i"]))
    df = df.withColumn("_at", F.array_sort(F.filter(marked, lambda i: i.isNotNull()))).drop("_placed")
    # a repeated window covers its words up to the next one
    cover = F.transform("_at", lambda i, j: F.least(F.lit(window), F.coalesce(F.get("_at", j + 1) - i, F.lit(window))))
    total = F.aggregate(cover, F.lit(0).cast("long"), lambda a, c: a + c)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_at")


def _features(df: DataFrame) -> DataFrame:
    chars, lines = F.greatest("word_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    length = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    return df.withColumns({"symbol_share": F.col("n_symbols") / chars, "dup_line_share": F.col("n_dup_lines") / lines, "word_length": length, "word_length_low": length})


def thresholds(measured: DataFrame, strata: list[str], size: int = 1024, least: int = 30, width: float = 3.0) -> DataFrame:
    """``(*strata, limit_<feature>)``: outer fences of the quartiles of every stratum.

    A stratum's quartiles come from KLL sketches, which combine before the shuffle; strata of fewer than
    ``least`` texts take those of their first column's value (its sketches are merged from the strata's, not
    computed again).  Where the quartiles are equal (most texts have no symbols at all) there is no spread to go
    by; the fence is then the 0.99 quantile (0.01 on the lower side) of all texts of the first column's value.
    """
    live = measured.filter("not base_failed")
    per = live.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"), *[F.kll_sketch_agg_double(f, F.lit(size)).alias(f) for f in RULES])
    per = cut(per)
    wide = per.groupBy(strata[0]).agg(*[F.kll_merge_agg_double(f).alias(f"_w_{f}") for f in RULES])
    both = per.alias("p").join(wide.alias("w"), F.col(f"p.{strata[0]}").eqNullSafe(F.col(f"w.{strata[0]}")))
    out = []
    for f, side in RULES.items():
        wide_f = F.col(f"_w_{f}")
        sketch = F.when(F.col("_n") >= least, F.col(f)).otherwise(wide_f)
        low, high = F.kll_sketch_get_quantile_double(sketch, F.lit(0.25)), F.kll_sketch_get_quantile_double(sketch, F.lit(0.75))
        fence = high + width * (high - low) if side > 0 else low - width * (high - low)
        tail = F.kll_sketch_get_quantile_double(wide_f, F.lit(0.99 if side > 0 else 0.01))
        out.append(F.when(high > low, fence).otherwise(tail).alias(f"limit_{f}"))
    return both.select(*[F.col(f"p.{s}") for s in strata], *out)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)``.

    A text that passes the base rules is kept unless one of its features lies beyond the fence of its
    stratum.  The measures are written once; sketches and the final join read those few columns.  The join
    is on the strata; where one holds a third of all rows Spark splits it (both sides are written tables or
    small aggregates).

    Null texts count as empty and fail; null languages or sources are strata of their own; repeated rows are
    judged once each; an empty table gives no rows; other columns are not read.
    """
    names = {s: f"_s{i}" for i, s in enumerate(strata)}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.coalesce(F.concat(F.lit("="), F.col(s).cast("string")), F.lit("")).alias(n) for s, n in names.items()])
    base = base_columns(rows, "_text").drop("_text")
    base = base.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    measured = cut(_features(base))
    limits = cut(thresholds(measured, list(names.values())))
    judged = measured.join(limits, list(names.values()), "left")
    beyond = F.lit(False)
    for f, side in RULES.items():
        v, limit = F.col(f), F.col(f"limit_{f}")
        beyond = beyond | F.coalesce(v > limit if side > 0 else v < limit, F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"))
