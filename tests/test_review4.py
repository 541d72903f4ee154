"""Faults of the fourth review: each has a test here."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.numeric import one_decimal
from scriptorium.operators import citation as C
from scriptorium.operators import descriptive as D


def test_candidates_are_about_as_many_as_the_misspelt_texts(spark):
    """Titles that differ in one code: a text meets its title, not a share of all titles that grows with them."""
    rng = random.Random(4)
    codes = ["".join(rng.choice("0123456789abcdef") for _ in range(12)) for _ in range(30_000)]
    bad = [c[:p] + ("x" if i % 2 else "") + c[p + 1:] for i, c in enumerate(codes[:400]) for p in [1 + i % 11]]
    names = spark.createDataFrame([(i, "report " + c) for i, c in enumerate(codes)], "nid long, text string")
    texts = spark.createDataFrame([(i, "report " + b) for i, b in enumerate(bad)], "tid long, text string")
    found = {(r.tid, r.nid) for r in C._Grams(0.895).candidates(texts, names).collect()}
    assert {(i, i) for i in range(400)} <= found
    assert len(found) < 2 * 400


@pytest.mark.parametrize("threshold", [76, 85, 93])
def test_pieces_at_the_ends_of_words_lose_nothing(spark, threshold):
    """Words that are run together, cut apart, put in another order and misspelt at either end."""
    rng = random.Random(threshold)
    word = lambda: "".join(rng.choice("abcé0") for _ in range(rng.randint(2, 14)))
    titles = sorted({" ".join(rng.sample(["report", "on", word(), word(), word()], rng.randint(1, 5))) for _ in range(250)})

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(1, 4)):
            ends = [i for i, c in enumerate(t) if c == " "] + [0, len(t) - 1]
            i = rng.choice(ends) if rng.random() < 0.6 else rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], [rng.choice("ab")], [t[i], rng.choice("c ")], [" ", t[i]]])
            t = t or ["a"]
        words = "".join(t).split() or ["a"]
        return " ".join(rng.sample(words, len(words)))

    texts = sorted({changed(t) for t in titles})
    a = spark.createDataFrame(list(enumerate(texts)), "tid long, text string")
    b = spark.createDataFrame(list(enumerate(titles)), "nid long, text string")
    found = {(r.tid, r.nid) for r in C._Grams((threshold - 0.5) / 100).candidates(a, b).collect()}

    def by_letters(x, y):
        x, y = set(x.split()), set(y.split())
        return C._ratio(" ".join(sorted(x & y) + sorted(x - y)), " ".join(sorted(x & y) + sorted(y - x)))

    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(titles) if by_letters(x, y) >= threshold}
    assert len(want) > 20 and want <= found


def described(spark, rows, **kinds):
    works = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, year int, cited_by double, doc_type string, author_keywords array<string>")
    out = D.descriptive_statistics(works, kinds, extra=True)
    return {(r.variable, r.indicator): r.value for r in out.collect()}


def test_descriptive_texts_are_those_of_the_sql(spark):
    """Shares by the exact value (printf), roundings by the double, lines without a value."""
    rows = [(2000 + i % 2, 1.005, "a" if i < 5 else f"b{i:02d}", ["k"]) for i in range(16)]
    got = described(spark, rows, year="numeric", cited_by="numeric", doc_type="string", author_keywords="list")
    assert got["doc_type", "Top 1"] == "a (5, 31.2%)" and got["doc_type", "Top 2"] == "b05 (1, 6.2%)"
    assert got["cited_by", "Mean"] == "1" and got["cited_by", "Median"] == "1" and got["year", "Mean"] == "2000.5"
    assert got["cited_by", "Skewness"] is None and got["cited_by", "Kurtosis"] is None
    one = described(spark, rows[:1], year="numeric")
    assert len(one) == 13 and one["year", "Std Dev"] is None and one["year", "P90"] == "2000"
    slight = described(spark, [(1, -0.001, "a", [])] * 3 + [(1, 0.0, "a", [])], cited_by="numeric", author_keywords="list")
    assert slight["cited_by", "Mean"] == "-0" and slight["cited_by", "Max"] == "0"
    assert slight["author_keywords", "Total occurrences"] == "0" and slight["author_keywords", "Items per document"] is None


def test_one_decimal_is_that_of_c(spark):
    rng = random.Random(5)
    xs = [k / 20 for k in range(2001)] + [k / n * 100 for n in [rng.randint(1, 3000) for _ in range(3000)] for k in [rng.randint(0, n)]]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [(r.x, r.t) for r in df.select("x", one_decimal(F.col("x")).alias("t")).collect()] == [(x, f"{x:.1f}") for x in xs]
