"""Passages that many documents share, in the similarity join."""

import collections
import random

import numpy as np

from scriptorium.functions.scratch import cut
from scriptorium.llm import hashing, ngram_join
from scriptorium.operators.graph import components

DOCS = "doc_id long, text string"


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(100_000)}" for _ in range(n))


def sets(texts, words):
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    return hashing.shingle_sets(np.frombuffer(b"".join(data), np.uint8), offsets, words)


def test_gaps_come_back():
    for cells in ([], [0], [0, 0, 65534, 65535, 65535, 131070, 1 << 31, (1 << 32) - 1], [65535], [(1 << 32) - 1] * 3):
        cells = np.array(cells, np.uint32)
        assert np.array_equal(ngram_join._from_gaps(ngram_join._gaps(cells).tobytes()), cells)


def test_frequent_shingles_against_brute_force(spark):
    """All texts are counted, two bytes a shingle; rows do not grow with what texts share."""
    rng = random.Random(3)
    passages = [sentence(rng, 40) for _ in range(4)]
    texts = [sentence(rng, 20) + " " + passages[i % 4 if i % 3 else 0] for i in range(200)] + ["", None, "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    keys = sets([t or "" for t in texts], 4)[0]
    count = collections.Counter((keys >> np.uint64(32)).tolist())
    rows = ngram_join._cells(docs, 4).collect()
    got = collections.Counter(c + (r["range"] << 24) for r in rows for c in ngram_join._from_gaps(r["cells"]).tolist())
    assert got == count and len(rows) <= 3 * ngram_join._RANGES
    for often in (0, 1, 20, 70, 1000):
        has = ngram_join._common(docs, 4, often).has(keys)
        want = np.array([count[c] > often for c in (keys >> np.uint64(32)).tolist()])
        assert has[want].all() and has[~want].mean() < 0.01 if len(has[~want]) else has.all()


def test_shared_passages_are_no_candidates(spark):
    """The first signing already leaves out what many texts hold; sets of little else keep all their parts."""
    rng = random.Random(5)
    passages = [sentence(rng, 60) for _ in range(3)]
    texts = [sentence(rng, 50) + " " + passages[i % 3] + " " + sentence(rng, 50) for i in range(600)]
    texts += [texts[0] + " end", passages[0], passages[0] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    bands = ngram_join.Bands(80, 100)
    full = components(ngram_join._candidates(cut(ngram_join._signed(docs, 5, bands))))
    signed = cut(ngram_join._signed(docs, 5, bands, ngram_join._common(docs, 5, 64)))
    apart = components(ngram_join._candidates(signed))
    largest = [max(r["count"] for r in c.groupBy("component").count().collect()) for c in (full, apart)]
    assert largest[0] > 100 and largest[1] < 20
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs, 5, 80, 100, id_col="id").collect()}
    assert {i: c for i, c in got.items() if i != c} == {600: 0, 602: 601}


def test_join_makes_no_row_per_shingle(spark):
    """Candidate groups beyond a block: no step counts the shingles of their texts row by row."""
    rng = random.Random(7)
    copy = sentence(rng, 200)
    docs = spark.createDataFrame([(i, f"{copy} {i}") for i in range(50)], DOCS).repartition(2)
    keys = []
    plain = ngram_join.DataFrame.mapInArrow
    try:
        ngram_join.DataFrame.mapInArrow = lambda self, f, schema, *a, **k: keys.append(str(schema)) or plain(self, f, schema, *a, **k)
        got = {r.component_id for r in ngram_join.similar_documents(docs, 5, 80, 100, block=500).collect()}
    finally:
        ngram_join.DataFrame.mapInArrow = plain
    assert got == {0} and "key long, n long" not in keys
