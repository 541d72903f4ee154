"""Tagging texts with concepts: whole-word keywords, wildcards or expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import ENGLISH_WORD, ngrams, tokens
from ..functions.ordering import top
from ..functions.patterns import valid_pattern
from ..functions.scratch import cut

# The 17 goals grouped by dimension and by perspective.
DIMENSIONS = {
    "Environmental": (6, 7, 12, 13, 14, 15),
    "Social": (1, 2, 3, 4, 5, 10, 11, 16),
    "Economic": (8, 9, 17),
}
PERSPECTIVES = {
    "People": (1, 2, 3, 4, 5),
    "Planet": (6, 12, 13, 14, 15),
    "Prosperity": (7, 8, 9, 10, 11),
    "Peace": (16,),
    "Partnership": (17,),
}


def keyword_pattern(keyword: str, wildcard: bool = True) -> str:
    """A whole-word expression; ``*`` stands for more word characters when ``wildcard`` is set."""
    word = keyword.strip().lower()
    body = r"\w*".join(re.escape(p) for p in word.split("*")) if wildcard else re.escape(word)
    return rf"\b{body}\b"


def concept_condition(text: Column, keywords: list[str], regex: bool = False, wildcard: bool = True) -> Column:
    """True when any keyword occurs; one alternation per concept, so a text is scanned once for it.

    Words and boundaries follow Unicode.  A keyword that is not a valid expression is searched as it is.
    """
    parts, literal = [], []
    for kw in (k.strip().lower() for k in keywords):
        if not kw:
            continue
        if regex:
            if valid_pattern(kw):
                parts.append(f"(?:{kw})")
            else:
                literal.append(kw)
        else:
            parts.append(keyword_pattern(kw, wildcard))
    low = F.lower(text)
    hit = low.rlike("(?iU)" + "|".join(parts)) if parts else F.lit(False)
    for kw in literal:
        hit = hit | low.contains(kw)
    return F.coalesce(hit, F.lit(False))


def text_of(df: DataFrame, *cols: str) -> Column:
    """The non-null parts joined by a space."""
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])


def text_fields(df: DataFrame, cols: list[str], min_length: int = 50) -> DataFrame:
    """Profile for choosing a text column: ``(column, mean_length, is_text)`` in one pass."""
    row = df.agg(*[F.avg(F.length(F.col(c).cast("string"))).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mean_length")) for c in cols])
    out = row.select(F.explode(pairs).alias("p")).select("p.*")
    return out.withColumn("is_text", F.coalesce(F.col("mean_length") > min_length, F.lit(False)))


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: is it multi-item (>5 % hold a separator), a year (>80 % in 1900-2100), a text (mean length > 50)."""
    aggs = []
    for c in cols:
        v = F.col(c).cast("string")
        n = v.try_cast("double")
        aggs += [
            F.avg((v.contains(";") | v.contains("|")).cast("int")).alias(f"{c}__sep"),
            F.avg(F.when(v.isNotNull(), F.coalesce(n.between(1900, 2100), F.lit(False)).cast("int"))).alias(f"{c}__year"),
            F.avg(F.length(v)).alias(f"{c}__len"),
        ]
    row = df.agg(*aggs)
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.coalesce(F.col(f"{c}__sep") > 0.05, F.lit(False)).alias("multi_item"),
            F.coalesce(F.col(f"{c}__year") > 0.8, F.lit(False)).alias("year"),
            F.coalesce(F.col(f"{c}__len") > 50, F.lit(False)).alias("text"),
        )
        for c in cols
    ])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def tag_concepts(
    df: DataFrame, text: str, concepts: dict[str, list[str]], regex: bool = False, wildcard: bool = True, prefix: str = ""
) -> DataFrame:
    """A 0/1 column per concept, ``concept_count`` and ``has_concept``."""
    flags = {f"{prefix}{n}": concept_condition(F.col(text), kws, regex, wildcard).cast("int") for n, kws in concepts.items()}
    out = df.withColumns(flags)
    count = sum((F.col(f"`{n}`") for n in flags), F.lit(0)).cast("int")
    return out.withColumn("concept_count", count).withColumn("has_concept", (F.col("concept_count") > 0).cast("int"))


def tag_many_concepts(df: DataFrame, text: str, concepts: DataFrame, max_words: int = 3) -> DataFrame:
    """``(doc_id, concept)`` for a large ``(concept, keyword)`` dictionary without wildcards.

    Word runs of the text meet the keywords in an equi join, so the cost does not grow with the
    number of concepts times the number of texts.
    """
    pattern = r"[\p{L}\p{N}_]+"
    found = F.regexp_extract_all(F.lower("keyword"), F.lit(pattern), F.lit(0))
    keys = concepts.select("concept", F.array_join(found, " ").alias("run"), F.size(found).alias("n")).filter("run <> ''").distinct()
    # only runs as long as some keyword are formed; there are at most ``max_words`` lengths
    lengths = sorted(n for n in keys.agg(F.collect_set("n")).first()[0] if n <= max_words)
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))
    runs = F.concat(F.array().cast("array<string>"), *[ngrams(F.col("_w"), n, n) for n in lengths])
    runs = df.select("doc_id", words.alias("_w")).select("doc_id", F.explode(F.array_distinct(runs)).alias("run"))
    return runs.join(keys, "run").select("doc_id", "concept").distinct()


def concept_summary(tagged: DataFrame, concepts: dict[str, list[str]], prefix: str = "") -> DataFrame:
    """``(concept, keywords, docs, percentage)``."""
    row = tagged.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"`{prefix}{c}`").alias(f"{prefix}{c}") for c in concepts])
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("concept"), F.lit(len(kws)).alias("keywords"), F.coalesce(F.col(f"`{prefix}{c}`"), F.lit(0)).alias("docs"),
            (F.coalesce(F.col(f"`{prefix}{c}`"), F.lit(0)) / F.nullif("_n", F.lit(0)) * 100).alias("percentage"),
        )
        for c, kws in concepts.items()
    ])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def matching_documents(tagged: DataFrame, flag: str = "has_concept") -> DataFrame:
    """Documents with at least one concept."""
    return tagged.filter(F.col(flag) == 1)


def title_case(concepts: dict[str, list[str]]) -> dict[str, list[str]]:
    """Concept names in title case, as for loaded domain dictionaries."""
    return {name.replace("_", " ").title(): kws for name, kws in concepts.items()}


# --- development goals --------------------------------------------------------------------------


def tag_goals(df: DataFrame, text: str, goals: dict[int, list[str]], groups: bool = True) -> DataFrame:
    """``SDG1`` … ``SDG17`` flags with perspectives ``P_*``, dimensions ``D_*``, ``SDG_Count`` and ``Has_SDG``.

    The keyword dictionary is a parameter (``read_concepts`` reads the usual ``{"1": [...]}`` file).
    """
    flags = {f"SDG{g}": concept_condition(F.col(text), goals.get(g, []), wildcard=False).cast("int") for g in range(1, 18)}
    out = df.withColumns(flags)
    extra = {}
    if groups:
        for prefix, table in (("P_", PERSPECTIVES), ("D_", DIMENSIONS)):
            for name, members in table.items():
                cols = [F.col(f"SDG{m}") for m in members]
                extra[prefix + name] = F.greatest(*cols) if len(cols) > 1 else cols[0]
    extra["SDG_Count"] = sum((F.col(c) for c in flags), F.lit(0)).cast("int")
    out = out.withColumns(extra)
    return out.withColumn("Has_SDG", (F.col("SDG_Count") > 0).cast("int"))


def count_goal_keywords(df: DataFrame, text: str, goals: dict[int, list[str]]) -> DataFrame:
    """``SDG1`` … ``SDG17`` as the number of keyword occurrences (each keyword counts its own matches)."""
    low = F.lower(F.col(text))
    cols = {}
    for g in range(1, 18):
        hits = [F.regexp_count(low, F.lit("(?U)" + keyword_pattern(k, wildcard=False))) for k in goals.get(g, [])]
        cols[f"SDG{g}"] = F.coalesce(sum(hits, F.lit(0)), F.lit(0)).cast("int")
    return df.withColumns(cols)


def goal_summary(tagged: DataFrame) -> DataFrame:
    """``(goal, docs, percentage)``."""
    row = tagged.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"SDG{g}").alias(f"SDG{g}") for g in range(1, 18)])
    pairs = F.array(*[
        F.struct(F.lit(f"SDG{g}").alias("goal"), F.col(f"SDG{g}").alias("docs"), (F.col(f"SDG{g}") / F.col("_n") * 100).alias("percentage"))
        for g in range(1, 18)
    ])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


# --- terms ----------------------------------------------------------------------------------------


def term_ngrams(df: DataFrame, text: str, stop_words: list[str], n_min: int = 1, n_max: int = 2) -> DataFrame:
    """``(doc_id, entity)`` n-grams of English words of three letters or more without stop words."""
    words = tokens(F.col(text), ENGLISH_WORD, stop_words)
    return df.select("doc_id", words.alias("_t")).select("doc_id", F.explode(ngrams(F.col("_t"), n_min, n_max)).alias("entity"))


def term_lists(df: DataFrame, col: str, kind: str = "list") -> DataFrame:
    """``(doc_id, terms)``: lower-cased items, or the words longer than two letters of a text."""
    if kind == "text":
        low = F.lower(F.col(col).cast("string"))
        for c in "\t\n\x0b\f\r":  # a split at one blank needs no expression; empty words are short ones
            low = F.replace(low, F.lit(c), F.lit(" "))
        terms = F.filter(F.split(low, " "), lambda x: F.length(x) > 2)
        # the condition is on the raw text: one on the list would be pushed down and split the text twice
        return df.filter(F.col(col).rlike(r"\S{3,}")).select("doc_id", terms.alias("terms"))
    from ..functions.lists import as_items

    terms = F.transform(as_items(df, col), lambda x: F.lower(x))
    return df.select("doc_id", terms.alias("terms")).filter(F.size("terms") > 0)


def document_terms(
    lists: DataFrame, n_terms: int = 100, min_docs: int = 2, method: str = "count"
) -> DataFrame:
    """Long ``(doc_id, term, value)`` of ``(doc_id, terms)`` for the terms in most documents.

    ``count``, ``binary`` or ``tfidf`` (share of the kept terms of the document times
    ln(N / (df + 1)) + 1).
    """
    freq = lists.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # written once: both the documents and the weights read it, and its size is known
    kept = cut(top(freq.filter(F.col("df") >= min_docs), n_terms, F.desc("df"), F.asc("term")))
    # the words meet the kept ones before anything is counted, so what is shuffled is kept words per document
    # (a plain explode of a column would be guarded by a filter that splits every text a second time)
    inside = lists.select("doc_id", F.explode_outer("terms").alias("term")).join(kept, "term")
    rows = inside.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"), F.first("df").alias("df"))
    if method == "tfidf":
        rows = rows.withColumn("_len", F.sum("n").over(Window.partitionBy("doc_id"))).withColumn("_nd", lists.agg(F.count(F.lit(1))).scalar())
        value = F.col("n") / F.col("_len") * (F.ln(F.col("_nd") / (F.col("df") + 1)) + 1)
    else:
        value = F.lit(1.0) if method == "binary" else F.col("n").cast("double")
    return rows.select("doc_id", "term", value.alias("value"))
