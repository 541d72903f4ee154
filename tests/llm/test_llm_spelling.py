"""Spelling variants against all pairs."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from scriptorium.llm import spelling as S
from scriptorium.llm.queries import SQL


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def all_pairs(words):
    """Both directions; words are compared with those of about their length."""
    by = collections.defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    return {(a, b) for n in by for a in by[n] for m in (n - 1, n, n + 1) for b in by.get(m, ()) if apart_by_one(a, b)}


def some_words(rng, n, alphabet="etaozé×x", longest=7):
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)})


@pytest.mark.parametrize("depth", [0, 2, 5, S.LEVELS])
def test_every_pair_is_found_once(depth):
    words = some_words(random.Random(depth), 700)
    home, asked = collections.defaultdict(list), collections.defaultdict(list)
    routes = S._routes(depth)
    for w, v in zip(words, S.Letters(words).vectors()[:, :depth].tolist()):
        keys = routes(v)
        home[keys[0][0]].append(w)
        for key, *rest in keys:
            asked[key].append((w, *rest))
    got = []
    for key, inside in home.items():
        q = asked[key]
        for a, b in S.near_pairs(inside, [x[0] for x in q], *(np.array([x[i] for x in q]) for i in (1, 2, 3)), depth):
            got += [(q[i][0], inside[j]) for i, j in zip(a.tolist(), b.tolist())]
    both = set(got) | {(b, a) for a, b in got}
    assert 2 * len(got) == len(both) and both == all_pairs(words)


def expected(counts):
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = collections.defaultdict(list)
    for a, b in all_pairs(words):
        near[a].append(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_forms_roots_and_blocks(spark):
    rng = random.Random(9)
    counts = {w: rng.choice([1, 2, 3, 4, 7, 9, 20, 45, 100]) for w in some_words(rng, 900, "etaé", 8)}
    counts |= {"eaten": 5, "eatena": 12, "eatenaa": 40, "eatenaaa": 90, "x" * 400: 9, "x" * 401: 30, "e" + "x" * 399: 4}
    rows = [(w, n) for w, n in counts.items()] + [(None, 4), ("lonely", None)]
    rows[0:1] = [(rows[0][0], 1)] * rows[0][1]  # rows of one word are added up
    df = spark.createDataFrame(rows, "word string, n long")
    for block in (20_000, 40):  # small blocks split leaves and their queries
        got = [tuple(r) for r in S.spelling_forms(df, block=block).select("word", "form", "root", "n", "n_near", "form_n").collect()]
        assert len(got) == len(set(got)) and set(got) == expected(counts)
    assert S.spelling_forms(df.limit(0)).collect() == []


def test_words_of_all_texts(spark):
    texts = ["Straße STRASSE straße", "élan Élan naïve×x a1b", None, "", "12 -- ", "word " * 3000, "Straße"]
    rows = [(i if i else None, t, 7) for i, t in enumerate(texts)] + [(2, texts[2], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int").repartition(3)
    for spoil in (0, 2):
        want = collections.Counter()
        for i, t, _ in rows:
            for w in re.findall("[A-Za-zÀ-ÿ]+", "".join(c.lower() if c < "a" else c for c in t or "")):
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                j = h % len(w)
                want[w[:j] + w[j + 1 :] if spoil and h % spoil == 0 else w] += 1
        assert {r.word: r.n for r in S.word_counts(df, spoil).collect()} == dict(want)
    assert S.word_counts(df.limit(0)).collect() == []


def test_sql_computes_the_same_checksum():
    head = SQL["op12_spelling"].split("vocab AS")[0].rstrip().rstrip(",")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (12, 'Straße naïve abc'), (NULL, 'abc')) AS t(doc_id, text)")
    got = dict(con.execute(head + " SELECT hexed.x, h FROM hashed JOIN hexed USING (w, k) JOIN bytes ON bytes.w = hashed.w AND bytes.b = list_transform(range(0, length(hexed.x) // 2), lambda i: 16 * instr('0123456789ABCDEF', hexed.x[2 * i + 1]) + instr('0123456789ABCDEF', hexed.x[2 * i + 2]) - 17)").fetchall())
    assert any(zlib.crc32(bytes.fromhex(x)) == h for x, h in got.items()) and len(got) >= 3
