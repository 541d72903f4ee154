"""Projections of the third review: the steps that grew, each with a test."""

import random
import re

from pyspark.sql import functions as F

from scriptorium.functions import bigcount as B
from scriptorium.functions.scratch import placed
from scriptorium.operators import concepts as K
from scriptorium.operators import contingency as H
from scriptorium.operators import graph as N
from scriptorium.operators import top_cited as T
from scriptorium.plans.fixtures import documents


def test_placed_tables_are_not_sorted_again(spark):
    """F8: the rounds of a sweep sort what is sent, not the links."""
    links = placed(spark.range(1000).select((F.col("id") % 2).alias("side"), F.col("id").alias("a")), "side", "a")
    sent = spark.range(100).select((F.col("id") % 2).alias("side"), F.col("id").alias("a"), F.lit(1).alias("v"))
    plan = links.join(sent.hint("shuffle_merge"), ["side", "a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_short_and_long_numbers_agree(spark):
    """F8: sums, products and doubles on both sides of the borders between 64-bit and limb-wise arithmetic."""
    rng = random.Random(5)
    edges = [0, 1, 2, 10**6 - 1, 10**6, 10**12 - 1, 10**12, 10**17 - 1, 10**17, 10**18 - 1]
    pairs = [(a, b) for a in edges for b in edges] + [(rng.randrange(10 ** rng.randint(1, 18)), rng.randrange(10 ** rng.randint(1, 18))) for _ in range(200)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long")
    d = d.select("i", B.number(F.col("a")).alias("a"), B.number(F.col("b")).alias("b"))
    d = d.select("i", "a", "b", B.added(F.col("a"), F.col("b")).alias("s"), B.multiplied(F.col("a"), F.col("b")).alias("p"))
    got = d.select("i", B.text(F.col("s")).alias("s"), B.text(F.col("p")).alias("p"), B.as_double(F.col("a")).alias("f"), B.as_double(F.col("p")).alias("g"), B.ratio(F.col("a"), F.col("b")).alias("r"))
    for r in got.collect():
        a, b = pairs[r.i]
        assert (r.s, r.p, r.f) == (str(a + b), str(a * b), float(a))
        assert abs(r.g - float(a * b)) <= 1e-15 * a * b
        assert abs(r.r - (float(a) / float(b) if b else 0.0)) <= 1e-15 * r.r
    many = spark.createDataFrame([(n,) for n in edges for _ in range(37)], "n long").select("n", B.number(F.col("n")).alias("v"))
    sums = many.groupBy("n").agg(B.summed("v", 3).alias("v")).select("n", B.text(B.settled(F.col("v"))).alias("t"))
    assert {r.n: r.t for r in sums.collect()} == {n: str(37 * n) for n in edges}


def test_documents_of_one_row_group_are_spread(spark, tmp_path):
    """a file of many splits whose rows all lie in one of them."""
    rows = spark.createDataFrame([(i, f"{i} " * 500) for i in range(400)], "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert spark.read.parquet(str(tmp_path / "documents.parquet")).rdd.getNumPartitions() >= 8
        held = [r["count"] for r in documents(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(held) == 400 and max(held) < 200


def test_document_terms_count_after_the_join(spark):
    """kept words are written once; weights and repeats as by hand."""
    docs = spark.createDataFrame([(1, "Aaa\tbbb\x0baaa x"), (2, "aaa ccc"), (3, "\n yy "), (4, None)], "doc_id long, text string")
    lists = K.term_lists(docs, "text", "text")
    got = {(r.doc_id, r.term): r.value for r in K.document_terms(lists, 2, 1).collect()}
    assert got == {(1, "aaa"): 2.0, (1, "bbb"): 1.0, (2, "aaa"): 1.0}
    plan = K.document_terms(lists, 2, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and "size(" not in plan


def test_group_cells_are_counted_once(spark):
    """the totals read the written cells, not the texts again."""
    works = spark.createDataFrame([(1, ["a"], "red blue"), (2, ["a", "b"], "red")], "doc_id long, groups array<string>, text string")
    got = H.group_table(works, "text", "text", top_n=1)
    assert "ExistingRDD" not in got._jdf.queryExecution().toString()
    assert {(r.row, r.col, r.n) for r in got.collect()} == {("red", "a", 2), ("red", "b", 1)}


def test_runs_are_as_long_as_keywords(spark):
    """a dictionary of single words and of triples makes no pairs."""
    docs = spark.createDataFrame([(1, "One two three four"), (2, "two"), (3, None)], "doc_id long, text string")
    keys = spark.createDataFrame([("x", "two"), ("y", "two, three four"), ("z", "")], "concept string, keyword string")
    got = K.tag_many_concepts(docs, "text", keys)
    assert {tuple(r) for r in got.collect()} == {(1, "x"), (1, "y"), (2, "x")}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") == 1
    assert K.tag_many_concepts(docs, "text", keys.filter("concept = 'z'")).collect() == []


def test_titles_are_counted_by_runs(spark):
    """short titles need no references beside the runs; short and long ones as by brute force."""
    titles = ["Order 1", "order-1", "A", "One, two three", "one two three four", "two three four one two", "four"]
    refs = [["x order 1. y", "ORDER 1", None], ["one two three four one two", "a"], ["order 12, b 1"], None, [], ["two three"], ["one two three"]]
    rows = [(i, t, r) for i, (t, r) in enumerate(zip(titles, refs))] + [(0, "four", ["order 1", "four"]), (None, "A", ["a"]), (None, None, ["a"])]
    works = spark.createDataFrame(rows, "doc_id long, title string, references array<string>")
    words = lambda t: re.findall(r"\w+", t.lower())
    want = {}
    for t in {t for _, t, _ in rows if t}:
        docs = {i for i, _, rs in rows for r in rs or [] if r and f" {' '.join(words(t))} " in f" {' '.join(words(r))} "}
        if docs:
            want[t] = len(docs)
    assert {r.title: r.local_citations for r in T.local_citations(works).collect()} == want
    short = T.local_citations(works.filter("title <> 'one two three four' and title <> 'two three four one two'"))
    assert "_hay" not in short._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_written_before_they_are_counted(spark):
    """choices and pairs read written lists."""
    works = spark.createDataFrame([(1, ["a", "b"], ["k"]), (2, ["a", "b"], ["k", "l"])], "doc_id long, authors array<string>, author_keywords array<string>")
    cells = H.cooccurrence(works, "authors", "author_keywords", top_rows=1)
    nodes, edges = N.cooccurrence_network(works, "authors")
    for df in (cells, nodes, edges):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()
    assert {tuple(r) for r in cells.collect()} == {("a", "k", 2), ("a", "l", 1)}
    assert [tuple(r) for r in edges.collect()] == [("a", "b", 2)]
