"""Faults of the third review: each has a test here."""

import random

from pyspark.sql import functions as F

from scriptorium.functions.scratch import placed
from scriptorium.operators import citation as C
from scriptorium.operators import recognition as R


def test_beauty_does_not_depend_on_the_order_of_rows(spark):
    """Gaps that add up to 2, but for the last digit: the sum goes from year to year in any order of the rows."""
    counts = {1: [3, 3, 3, 3, 7, 2, 1], 2: [2, 2, 4, 4, 7, 10, 2], 3: [1, 3, 4, 2, 4, 8, 3], 4: [5, 6, 3, 3, 6, 7, 6]}
    rows = [(i + 10 * k, 2000, t, c) for i, cs in counts.items() for k in range(50) for t, c in enumerate(cs)]
    want = {1: 2.0, 2: 2.0000000000000004, 3: 1.9999999999999996, 4: 1.9999999999999998}
    for seed in (1, 2):
        shuffled = random.Random(seed).sample(rows, len(rows))
        hist = spark.createDataFrame(shuffled, "doc_id long, publication_year int, t int, c long").repartition(7)
        got = {r.doc_id: r.beauty_coefficient for r in R.beauty(hist).collect()}
        assert got == {i + 10 * k: want[i] for i in counts for k in range(50)}


def test_candidates_of_misspelt_codes_are_few(spark):
    """Codes of 12 letters out of 16: every misspelt one finds its title, and no more than some others."""
    rng = random.Random(3)
    codes = ["".join(rng.choice("0123456789abcdef") for _ in range(12)) for _ in range(3000)]
    bad = [c[:p] + ("x" if i % 3 == 0 else " " if i % 3 == 1 else "") + c[p + (i % 3 != 1):] for i, c in enumerate(codes[:300]) for p in [1 + i % 11]]
    names = spark.createDataFrame([(i, "report " + c) for i, c in enumerate(codes)], "nid long, text string")
    texts = spark.createDataFrame([(i, "report " + " ".join(b.split())) for i, b in enumerate(bad)], "tid long, text string")
    found = {(r.tid, r.nid) for r in C._Grams(0.895).candidates(texts, names).collect()}
    assert {(i, i) for i in range(300)} <= found
    assert len(found) < 20 * 300


def test_links_of_a_component_are_found_once(spark):
    """The rounds and the result read written links, not the works again."""
    works = [(f"W{i}", [f"W{i - 1}"] if i % 5 else []) for i in range(1, 20)]
    got = C.citation_graph(spark.createDataFrame(works, "doc_id string, references array<string>"))
    assert "ExistingRDD" not in got._jdf.queryExecution().toString()
    assert {(r.citing, r.cited) for r in got.collect()} == {(f"W{i}", f"W{i - 1}") for i in range(11, 15)}


def test_placed_tables_are_not_shuffled_again(spark):
    """A join on the keys by which a table was placed shuffles the other side only."""
    links = placed(spark.range(1000).select((F.col("id") % 2).alias("side"), F.col("id").alias("a")), "side", "a")
    sent = spark.range(100).select((F.col("id") % 2).alias("side"), F.col("id").alias("a"), F.lit(1).alias("v"))
    plan = links.join(sent.hint("shuffle_merge"), ["side", "a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
