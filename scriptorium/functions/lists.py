"""Multi-valued fields: delimited strings, arrays and the long ``(doc_id, entity)`` form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_items(items: Column) -> Column:
    """Trim every item and drop the empty ones and the text ``nan``."""
    trimmed = F.transform(items, lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: (x != "") & (F.lower(x) != "nan"))


def split_items(text: Column, sep: str) -> Column:
    """Split on one literal separator."""
    return clean_items(F.split(text, "\\Q" + sep + "\\E"))


def split_auto(text: Column, comma: bool = False) -> Column:
    """Per-value rule: ``;`` when present, else ``|``, else (optionally) ``,``, else one item."""
    by_comma = F.when(text.contains(","), F.split(text, ",")) if comma else None
    rest = F.array(text)
    if by_comma is not None:
        rest = by_comma.otherwise(rest)
    parts = F.when(text.contains(";"), F.split(text, ";")).when(
        text.contains("|"), F.split(text, "\\|")
    ).otherwise(rest)
    return clean_items(parts)


def as_items(df: DataFrame, col: str, sep: str | None = None, comma: bool = False) -> Column:
    """An array of clean items for a column that is an array, a delimited string or a scalar."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.ArrayType):
        return clean_items(F.col(f"`{col}`"))
    text = F.col(f"`{col}`").cast("string")
    return split_items(text, sep) if sep else split_auto(text, comma)


def explode_entities(
    df: DataFrame,
    col: str,
    *keep: str,
    kind: str = "list",
    sep: str | None = None,
    distinct: bool = False,
    comma: bool = False,
    doc_id: str = "doc_id",
) -> DataFrame:
    """Long table ``(doc_id, entity, *keep)``.

    ``kind='single'`` takes the trimmed whole value.  ``distinct`` removes repeats inside one
    document before the explode, so no later ``countDistinct`` (and no extra shuffle) is needed.
    """
    if kind == "single":
        out = df.select(doc_id, F.trim(F.col(col).cast("string")).alias("entity"), *keep)
        return out.filter((F.col("entity") != "") & (F.lower("entity") != "nan"))
    items = as_items(df, col, sep, comma)
    if distinct:
        items = F.array_distinct(items)
    return df.select(doc_id, F.explode(items).alias("entity"), *keep)


def ngrams(tokens: Column, n_min: int, n_max: int) -> Column:
    """All word n-grams of a token array, ``n_min <= n <= n_max``, in one array."""

    def of(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        # single look-ups: a slice would copy the whole token list for every position
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]))

    parts = [tokens if n == 1 else of(n) for n in range(n_min, n_max + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def tokens(text: Column, pattern: str, stop_words: list[str] | None = None) -> Column:
    """Lower-cased matches of ``pattern`` without the stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    if not stop_words:
        return found
    # one hash set per row (array_except would also remove repeats, which must be counted)
    return F.filter(found, lambda x: ~x.isin(*[w.lower() for w in stop_words]))


# Fixed patterns: a word of two or more letters, digits or underscores; an English word of three letters or more.
WORD2 = r"[\p{L}\p{N}_]{2,}"
ENGLISH_WORD = r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"


def unordered_pairs(items: Column) -> Column:
    """All pairs ``(a, b)`` of an array in which a stands before b."""
    return F.flatten(
        F.transform(
            items,
            lambda x, i: F.transform(
                F.slice(items, i + 2, F.size(items) - i - 1), lambda y: F.struct(x.alias("a"), y.alias("b"))
            ),
        )
    )


def ordered_pairs(left: Column, right: Column) -> Column:
    """All pairs ``(a, b)`` with a from the left array and b from the right one."""
    return F.flatten(
        F.transform(left, lambda x: F.transform(right, lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )


def keep_only(df: DataFrame, out: str, items: Column, allowed: Column) -> DataFrame:
    """Adds ``out``: the items that are in ``allowed`` (a short array value), repeats and order kept."""
    named = df.withColumn("_allowed", allowed)  # a subquery value may not stand inside a lambda
    return named.withColumn(out, F.filter(items, lambda x: F.array_contains(F.col("_allowed"), x))).drop("_allowed")


def array_value(df: DataFrame, col: str = "entity") -> Column:
    """The sorted values of a short column (a top-N list) as one scalar array.

    As a subquery value it replaces a join: the documents are filtered where they are read.
    """
    return df.agg(F.array_sort(F.collect_set(col)).alias("a")).scalar()
