"""Every stage of the pipeline against brute force on a small folder of tables."""

import random

import pytest
from test_llm_operators import brute_components, brute_repeats, sentence, shingles

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    d = str(tmp_path_factory.mktemp("tables"))
    texts = {i: sentence(rng, rng.randint(20, 120), 3000) for i in range(200)}
    toxic = set(range(0, 200, 8))
    for i in toxic:
        w = texts[i].split()
        for bad in rng.sample(["blargface", "snorkwit", "grumpelz"], 2):
            w[rng.randrange(len(w))] = bad
        texts[i] = " ".join(w) + "."
    for i in range(300, 330):  # copies and near copies of clean texts
        w = texts[i - 299 if (i - 299) % 8 else i - 298].split()
        if i % 2:
            w[rng.randrange(len(w))] = "changed"
        texts[i] = " ".join(w)
    passage = sentence(rng, 60, 3000)
    items = {j: sentence(rng, 30, 3000) for j in range(6)}
    for i in range(400, 420):
        texts[i] = sentence(rng, 40, 3000) + "\n" + passage + "\n" + sentence(rng, 40, 3000)
    for i in range(420, 432):
        texts[i] = sentence(rng, 50, 3000) + " " + items[i % 6] + " " + sentence(rng, 50, 3000)
    rows = [(i, t, "en", "s", len(t), 1) for i, t in texts.items()] + [(900, None, None, None, None, 1), (901, "", "en", "s", 0, 1), (902, "w1 w2", "en", None, 5, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, toxic, items


def test_stages(spark, folder):
    d, toxic, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    seen = []
    for name, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, d))
        rows = docs.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before)
            assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
            break
        assert tuple(docs.columns) == P.COLUMNS
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows)
        if name == "toxicity":
            assert set(before) - set(after) == toxic
        elif name == "n-gram Jaccard join":
            ids = sorted(before)
            comp = brute_components([before[i].text for i in ids], 5, 80, 100)
            assert set(after) == {ids[i] for i, _, c in comp if i == c}
        elif name == "suffix-array dedup":
            ids = sorted(before)
            assert {i: after[i].text for i in ids} == {i: w[3].decode() for i, w in zip(ids, brute_repeats([before[i].text for i in ids]))}
            assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[i].lang, before[i].source) for i, r in after.items())
        else:
            sets = [shingles(t, 5) for t in items.values()]
            held = {i for i, r in before.items() if any(100 * len(s & shingles(r.text, 5)) >= 80 * len(s) for s in sets)}
            assert held and set(before) - set(after) == held
        seen.append(len(after))
        before = after
    assert sorted(seen, reverse=True) == seen


def test_run_and_empty_tables(spark, folder, tmp_path):
    d, _, _ = folder
    rows = P.run(spark, d).collect()
    assert len(rows) > 100
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_rows_that_share_an_id_or_have_none(spark, folder):
    d, _, _ = folder
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.without_near_copies(spark, docs, d).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 0, 1]
