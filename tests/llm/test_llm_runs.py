"""Periodic runs against a scan of all lags at all places."""

import hashlib
import random
import re
import zlib

import duckdb

from scriptorium.llm import periodic_runs
from scriptorium.llm.queries import QUERIES

D = "/root/testdata/sf0.001"


def brute(s, least=12):
    n, out = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and s[i] == s[i + q]:
                i += 1
            if i - a + q >= max(least, 2 * q):
                out.setdefault((a, i + q), q)
            i += i == a
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    drop = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def some_words(rng):
    n, k = rng.randint(0, 130), rng.choice([1, 2, 3, 5, 30])
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    if n > 20 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.5:
            w[rng.randrange(n)] = "x"
    return w


def test_runs_equal_brute_force():
    rng = random.Random(1)
    texts = [some_words(rng) for _ in range(1500)]
    got = periodic_runs.runs_of([[w.encode() for w in t] for t in texts])
    assert got == [brute(t) for t in texts]


def test_long_periods_and_nested_runs():
    rng = random.Random(2)
    part = [f"v{rng.randrange(40)}" for _ in range(700)]
    inner = part[:100] + ["a", "b"] * 30 + part[100:]
    x, y = ["a"], ["a", "b"]
    while len(y) < 1500:
        x, y = y, y + x
    texts = [part * 3 + ["end"], inner * 2, y, ["a"] * 3000, [rng.choice("ab") for _ in range(2500)]]
    got = periodic_runs.runs_of([[w.encode() for w in t] for t in texts])
    assert got == [brute(t) for t in texts]


def test_splitting_leaves_only_repeated_words():
    rng = random.Random(3)
    words = [rng.randrange(60) for _ in range(400)]
    import numpy as np

    found = periodic_runs.split_by_frequency(np.array(words), np.zeros(400, int))
    for a, b in found:
        assert b - a >= 12 and all(words[a:b].count(w) > 1 for w in words[a:b])
    assert all(any(a <= s and s + n <= b for a, b in found) for s, n, _ in brute(words))


def test_texts_of_all_kinds(spark):
    many = " ".join(["one two three four"] * 5)
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", None), (None, many, "y"), (5, many, "y"), (5, many, "y"), (6, "Ä ä " * 9, "z"), (7, "w " * 40_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic_runs.periodic_runs(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].collapsed == "" and by[i].runs == [] and by[i].n_words == 0 for i in (1, 2, 3))
    assert tuple(by[None].runs[0]) == (0, 20, 4) and by[None].collapsed == "one two three four" and by[5] == [r for r in got if r.doc_id == 5][1]
    assert tuple(by[6].runs[0]) == (0, 18, 2) and tuple(by[7].runs[0]) == (0, 40_000, 1) and by[7].collapsed == "w"
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall())
    rows = QUERIES["op11_periodic_runs"](spark, D).collect()
    assert {r.doc_id for r in rows} == set(docs) and sum(r.n_runs > 0 for r in rows) > 5
    for r in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", docs[r.doc_id] or "") if x]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = [(a, m, q) for a, m, q in periodic_runs.runs_of([[x.encode() for x in w]])[0]] if n > 3000 else brute(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best) and r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
