"""Personal data against plain searches, and the bootstrap against plain loops on planted contexts."""

import collections
import hashlib
import random
import re

import duckdb
import pytest

from scriptorium.llm import contextual_pii as P
from scriptorium.llm.queries import QUERIES

D = "/root/testdata/sf0.001"


def plain_seeds(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        if 16 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_seeds_equal_plain_searches():
    rng = random.Random(3)
    alphabets = ["a.@", "a.@- ", "0123456789.", "05.-+() ", "1234567890 -", "a@b.c@0.+é"]
    for _ in range(20_000):
        t = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 45)))
        assert P.seed_spans(t) == plain_seeds(t), t


def test_long_texts_are_no_trap():
    for t in ("a" * 300_000, "a." * 150_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+" * 300_000, "1-" * 150_000, "a:" * 150_000, "(1) " * 80_000):
        P.loose_spans(t, P.seed_spans(t))


def corpus():
    """Numbers behind `phone no` and `contact` lines; some are written so that the fixed form misses them."""
    rng = random.Random(5)
    filler = "the quick brown fox jumps over the lazy dog while rain falls in spain".split()

    def words(n):
        return " ".join(rng.choice(filler) for _ in range(n))

    def phone():
        return f"+1 ({rng.randrange(1000):03}) 555-{rng.randrange(10000):04}"

    rows, hidden = [], []
    for i in range(60):
        rows.append(f"{words(6)} customer hotline number: {phone()} open daily {words(5)}")
    for i in range(6):
        number = f"({rng.randrange(100, 1000)}) 555-{rng.randrange(10000):04}"
        rows.append(f"Ä é {words(4)} customer hotline number: {number} open daily {words(3)}")
        hidden.append((len(rows) - 1, "phone", number))
        rows.append(f"{words(4)} desk extension {number} please {words(3)}")  # the same instance elsewhere
        hidden.append((len(rows) - 1, "phone", number))
    for i in range(8):  # reached in the second round only: behind words that only known hidden numbers share
        number = hidden[2 * (i % 6)][2]
        rows.append(f"{words(2)} night line {number} ok {words(2)}")
        hidden.append((len(rows) - 1, "phone", number))
    rows.append(f"{words(2)} night line (999) 555-0001 ok {words(2)}")
    hidden.append((len(rows) - 1, "phone", "(999) 555-0001"))
    for i in range(20):
        rows.append(f"{words(3)} write to us at user{i}@mail{i}.example.com for help {words(3)}")
    rows.append(f"{words(3)} write to us at joe (at) mail dot example for help {words(3)}")
    hidden.append((len(rows) - 1, "email", "joe (at) mail"))
    for i in range(40):
        rows.append(f"{words(3)} order reference {rng.randrange(10**8, 10**9)} shipped {words(3)}")  # no seed stands there
        rows.append(f"{words(3)} number: {words(2)}")
    return rows, hidden


def plain_bootstrap(rows, support=3, least=0.5, accept=0.8):
    """The same rounds with dictionaries over all texts."""
    token = re.compile(r"[A-Za-z0-9_\u0080-\U0010ffff]+|[^\sA-Za-z0-9_\u0080-\U0010ffff]")
    grams, places, entity_of = collections.Counter(), [], {}
    edges = collections.Counter()
    known, seed_of = {}, set()
    for r, t in enumerate(rows):
        toks = [(m[0].lower(), *m.span()) for m in token.finditer(t)]
        for k in P.SIZES:
            for i in range(len(toks) - k + 1):
                grams[tuple(x[0] for x in toks[i : i + k])] += 1
        seeds = plain_seeds(t)
        for kinds, a, b, seed in [([k], a, b, True) for k, a, b in seeds] + [([k for k in range(4) if m >> k & 1], a, b, False) for m, a, b in P.loose_spans(t, seeds)]:
            before = [x[0] for x in toks if x[2] <= a]
            behind = [x[0] for x in toks if x[1] >= b]
            name = " ".join(t[a:b].lower().split())
            places.append((r, a, b, seed, name))
            for k in P.SIZES:
                for side, gram in ((0, tuple(before[-k:]) if len(before) >= k else None), (1, tuple(behind[:k]) if len(behind) >= k else None)):
                    for kind in kinds:
                        if gram:
                            edges[kind, name, side, gram] += 1
                        if seed:
                            known[name] = (kind, 1.0)
                            seed_of.add(name)
    found = {}
    while True:
        candidates, hits, names = collections.Counter(), collections.Counter(), collections.defaultdict(set)
        for (kind, name, side, gram), n in edges.items():
            candidates[kind, side, gram] += n
            if known.get(name, (None,))[0] == kind:
                hits[kind, side, gram] += n
                names[kind, side, gram].add(name)
        score = {p: hits[p] / (hits[p] + max(grams[p[2]] - candidates[p], 0) + 1) for p in hits if len(names[p]) >= support}
        wrong = collections.defaultdict(lambda: 1.0)
        for (kind, name, side, gram), n in edges.items():
            if name not in known and score.get((kind, side, gram), 0) >= least:
                wrong[kind, name] *= 1 - score[kind, side, gram]
        best = {}
        for (kind, name), w in wrong.items():
            if 1 - w >= accept:
                best[name] = max(best.get(name, (0, 0)), (1 - w, -kind))
        if not best:
            return {(r, -found[n], a, b) for r, a, b, seed, n in places if not seed and n in found}
        known |= {n: (-k, s) for n, (s, k) in best.items()}
        found |= {n: k for n, (s, k) in best.items()}


@pytest.mark.parametrize("held", [1 << 21, 0])
def test_bootstrap_equals_plain_loops(spark, monkeypatch, held):
    monkeypatch.setattr(P, "_HELD", held)
    rows, hidden = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, spans string").repartition(5)
    got = P.personal_data(df).collect()
    new = {(r.doc_id, P.KINDS.index(s.kind), s.start, s.end) for r in got for s in r.spans if (s.kind, s.start, s.end) not in {tuple(x) for x in r.seeds}}
    assert new == plain_bootstrap(rows)
    shown = {(d, P.KINDS[k], rows[d][a:b]) for d, k, a, b in new}
    assert set(hidden) <= shown and not any("order reference" in rows[d] for d, *_ in shown)
    for r in got:
        assert [(P.KINDS.index(s.kind), s.start, s.end) for s in r.seeds] == sorted(plain_seeds(rows[r.doc_id]))


def test_odd_rows(spark):
    mail = "mail me: ann@mail.example.com"
    rows = [(1, None), (2, ""), (None, mail), (4, mail), (4, mail), (5, "1 " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.personal_data(df).collect()
    assert len(got) == len(rows) and all(r.spans == [] for r in got if r.doc_id in (1, 2, 5)) and sum(len(r.spans) for r in got) == 3
    assert P.personal_data(df.limit(0)).collect() == []


def test_query_keeps_the_fixed_forms(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall())
    rows = QUERIES["op13_contextual_pii"](spark, D).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        seeds = sorted(plain_seeds(docs[r.doc_id] or ""))
        told = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in seeds)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(filter(None, told.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in seeds) for x in range(4))
