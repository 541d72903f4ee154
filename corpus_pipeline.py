"""From documents to training windows: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.scratch import cut, discard
from scriptorium.llm import decontaminate, ngram_join, packing, suffix_dedup, toxicity
from scriptorium.llm.queries import BYTE_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
THRESHOLD = 0.3  # score from which a document is toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; null and empty texts stay."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("score") < THRESHOLD).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group linked at four fifths of its five-word shingles.

    Texts without words belong to no group and stay; so do rows without id.  Of rows that share an id the one of
    smallest text (then language, source, length) stays.
    """
    docs = docs.select(*COLUMNS)
    groups = ngram_join.similar_documents(docs, words=5, num=80, den=100)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    # nearly all ids are there once; only the others are compared
    twice = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id")
    named = docs.join(first, "doc_id", "left_semi")
    once = named.join(twice, "doc_id", "left_anti")
    least = named.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", *[f"r.{c}" for c in COLUMNS[1:]])
    return once.select(*COLUMNS).unionByName(least.select(*COLUMNS)).unionByName(docs.filter("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the strings of 200 bytes that start more than once; null texts become empty."""
    found = suffix_dedup.repeats(docs, carry=("lang", "source"), whole_chars=True)
    text = F.col("kept").cast("string")
    return found.select("doc_id", text.alias("text"), "carried.lang", "carried.source", F.length(text).cast("long").alias("n_chars"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay."""
    return decontaminate.uncontaminated(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows; null and empty texts are an end id."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmarks),
    ("packing", packed),
]

ORACLE_SQL = None  # trained scores and tokenizers have no SQL; tests/llm compares every stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written before the next reads it."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
