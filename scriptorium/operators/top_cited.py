"""Most cited documents: overall, inside the collection, per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import ngrams
from ..functions.ordering import top
from ..functions.scratch import cut


def _top_with_ties(df: DataFrame, n: int, score: str, ties: bool, *order: Column) -> DataFrame:
    """First ``n`` rows, or with ties all rows not below the n-th score (a filter, not a global rank)."""
    if not ties:
        return top(df, n, F.desc(score), *order)
    cutoff = top(df.select(score), n, F.desc(score)).agg(F.min(score)).scalar()
    return df.filter(F.col(score) >= cutoff)


def top_cited(works: DataFrame, n: int = 10, ties: bool = False) -> DataFrame:
    """By citations, then earlier year, then title."""
    d = works.withColumn("global_citations", F.coalesce("cited_by", F.lit(0)))
    return _top_with_ties(d, n, "global_citations", ties, F.asc_nulls_last("year"), F.asc("title"), F.asc("doc_id"))


def top_cited_per_year(works: DataFrame, n: int = 10, ties: bool = False) -> DataFrame:
    """By citations per year of age, counted from the latest year of the collection."""
    latest = works.agg(F.max("year")).scalar()
    d = works.withColumn("_latest", latest)
    age = F.greatest(F.lit(1), F.col("_latest") - F.col("year") + 1)
    d = d.withColumn("citations_per_year", F.coalesce("cited_by", F.lit(0)) / age).drop("_latest")
    return _top_with_ties(d.filter("year is not null"), n, "citations_per_year", ties, F.asc("doc_id"))


def _words(text: Column) -> Column:
    """Lower-cased words, punctuation dropped."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def local_citations(works: DataFrame, anchor: int = 3) -> DataFrame:
    """``(title, local_citations)``: documents whose references name the title (as whole words).

    Titles of up to ``anchor`` words are word runs themselves: a document's different runs of these lengths
    are counted, and the counts meet the titles.  Longer titles are looked up by their rarest run of
    ``anchor`` words, every reference offers its runs, and an equi join on the run yields the candidates that
    are then compared in full.  Picking the rarest run keeps common phrases from becoming join keys.
    """
    titles = works.select("title").filter("title is not null").distinct().withColumn("_w", _words(F.col("title")))
    titles = cut(titles.filter(F.size("_w") > 0))
    lengths = sorted(titles.agg(F.collect_set(F.least(F.size("_w"), F.lit(anchor + 1)))).first()[0])
    parts = [_cited_long(works, titles.filter(F.size("_w") > anchor), anchor)] if anchor + 1 in lengths else []
    short = [n for n in lengths if n <= anchor]
    if short or not parts:
        parts.append(_cited_short(works, titles.filter(F.size("_w") <= anchor), short))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _cited_short(works: DataFrame, titles: DataFrame, lengths: list[int]) -> DataFrame:
    """Counts of documents per run: only runs and numbers are shuffled, equal ones combine before."""
    none = F.array().cast("array<string>")
    docs = works.groupBy("doc_id").agg(F.flatten(F.collect_list("references")).alias("_refs"))  # rows that share an id are one document
    docs = docs.select(F.transform("_refs", lambda r: F.coalesce(_words(r), none)).alias("_rw"))
    runs = F.flatten(F.transform("_rw", lambda w: F.concat(none, *[ngrams(w, n, n) for n in lengths])))
    counts = docs.select(F.explode(F.array_distinct(runs)).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("local_citations"))
    return titles.select("title", F.array_join("_w", " ").alias("run")).join(counts, "run").select("title", "local_citations")


def _cited_long(works: DataFrame, titles: DataFrame, anchor: int) -> DataFrame:
    runs = titles.select(
        "title", "_w",
        F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.size("_w") - anchor + 1), lambda i: F.array_join(F.slice("_w", i, anchor), " ")
        ))).alias("run"),
    )
    common = runs.groupBy("run").agg(F.count(F.lit(1)).alias("_f"))
    best = runs.join(common, "run").groupBy("title").agg(F.min(F.struct("_f", "run")).alias("_b"))
    keyed = best.select(
        "title", F.col("_b.run").alias("run"),
        F.concat(F.lit(" "), F.array_join(_words(F.col("title")), " "), F.lit(" ")).alias("_needle"),
    )
    refs = works.select("doc_id", F.explode("references").alias("_ref")).withColumn("_rw", _words(F.col("_ref")))
    offered = refs.select(
        "doc_id", F.concat(F.lit(" "), F.array_join("_rw", " "), F.lit(" ")).alias("_hay"),
        F.explode(F.array_distinct(ngrams(F.col("_rw"), anchor, anchor))).alias("run"),
    )
    hits = offered.join(keyed, "run").filter(F.col("_hay").contains(F.col("_needle")))
    return hits.select("title", "doc_id").distinct().groupBy("title").agg(F.count(F.lit(1)).alias("local_citations"))


def top_cited_locally(works: DataFrame, n: int = 10, ties: bool = False) -> DataFrame:
    """By the number of documents of the collection that cite the title."""
    local = local_citations(works)
    d = works.join(local, "title", "left").withColumns({
        "local_citations": F.coalesce("local_citations", F.lit(0)),
        "global_citations": F.coalesce("cited_by", F.lit(0)),
    })
    return _top_with_ties(d, n, "local_citations", ties, F.desc("global_citations"), F.asc("doc_id"))
