"""Titles matched letter by letter: every pair that reaches the threshold is found."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import citation as C


def some_titles(rng, n):
    words = ["annual", "report", "theory", "of", "the", "spectral", "analysis", "colour", "networks", "on", "growth", "x", "ab", "aaa"]
    return [" ".join(rng.choice(words) if rng.random() < 0.6 else "".join(rng.choice("abcdeor") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def misspelt(rng, text):
    t = list(text)
    for _ in range(rng.randint(1, 5)):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice([[], [rng.choice("abcdefgh")], [t[i], rng.choice("xyz")]])
        if not t:
            return text
    return " ".join("".join(t).split()) or text


@pytest.mark.parametrize("threshold", [50, 70, 80, 90, 97])
def test_all_pairs_above_the_threshold(spark, threshold):
    rng = random.Random(threshold)
    titles = sorted(set(some_titles(rng, 150)))
    refs = sorted({misspelt(rng, t) for t in titles} | {misspelt(rng, rng.choice(titles) + " " + rng.choice(some_titles(rng, 1))) for _ in range(60)})
    works = [(i, t, []) for i, t in enumerate(titles)] + [(1000 + i, None, [r]) for i, r in enumerate(refs)]
    df = spark.createDataFrame(works, "doc_id long, title string, references array<string>")
    got = {r.citing: (r.cited, r.score) for r in C.fuzzy_citation_graph(df, threshold).collect()}
    want = {}
    for i, r in enumerate(refs):
        best = min((-100 if r == t else -C.token_set_score(r, t), r != t, j) for j, t in enumerate(titles))
        if -best[0] >= threshold:
            want[1000 + i] = (best[2], -best[0])
    assert got == want


@pytest.mark.parametrize("threshold", [60, 80, 90])
def test_candidates_and_bound_lose_nothing(spark, threshold):
    """Only by letters: words in common do not help."""
    rng = random.Random(threshold)
    titles = sorted(set(some_titles(rng, 200)))
    texts = sorted({misspelt(rng, t) for t in titles})
    grams = C._Grams((threshold - 0.5) / 100)
    a = spark.createDataFrame(list(enumerate(texts)), "tid long, text string")
    b = spark.createDataFrame(list(enumerate(titles)), "nid long, text string")
    found = {(r.tid, r.nid) for r in grams.candidates(a, b).collect()}
    by_letters = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(titles) if C._ratio(" ".join(sorted(set(x.split()))), " ".join(sorted(set(y.split())))) >= threshold}
    assert by_letters and by_letters <= found
    pairs = a.join(b.withColumnRenamed("text", "other"), F.abs(F.col("tid") - F.col("nid")) < 12)
    for r in pairs.select("text", "other", grams.bound(F.col("text"), F.col("other")).alias("most")).collect():
        assert C.token_set_score(r.text, r.other) <= r.most + 0.5 + 1e-6


def test_a_misspelt_only_word(spark):
    works = [(1, "Thermodynamics", []), (2, "Electrochemistry", []), (3, "other", ["Doe, J, Thermodinamics, 1999", "Doe, J, Electrochemistri, pp. 3", "Roe, R, Something else altogether, 2001"])]
    df = spark.createDataFrame(works, "doc_id long, title string, references array<string>")
    assert {(r.citing, r.cited, r.score) for r in C.fuzzy_citation_graph(df).collect()} == {(3, 1, 93), (3, 2, 94)}
