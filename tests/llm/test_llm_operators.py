"""Training-data operators against brute force, exact round trips and held-out texts."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat, decontaminate, hashing, language, ngram_join, packing, quality, suffix_dedup, token_blocks, tokens, toxicity, url_rules
from scriptorium.llm.queries import BYTE_BPE, RULES

DOCS = "doc_id long, text string"
BLANK = "".join(chr(c) for c in (0x20, *range(0x09, 0x0E)))


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[" + BLANK + "]+", low) if w]


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- tokens and packing ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    rng = random.Random(1)
    atoms = [" ", "  ", "\n", "a", "The", "é", "'s", "12", ".", "\t", "\u00a0", "<|endoftext|>", "\u3000", "日本", ",", "x!"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    got = tokens.Encoder(BYTE_BPE).encode(texts)
    assert all(np.array(library(t), "<u4").tobytes() == g for t, g in zip(texts, got))


def test_sum_of_squares_choice():
    rng = np.random.default_rng(2)
    levels, n = packing.Levels(16), np.zeros(17, int)
    for i in range(500):
        size = int(rng.integers(1, 16))
        options = {}
        for h in range(0, 17 - size):
            if h and not n[h]:
                continue
            m = n.copy()
            m[h] -= 1 if h else 0
            m[h + size] += 1 if h + size < 16 else 0
            options[h] = (m[1:16] ** 2).sum()
        best = max(h for h in options if options[h] == min(options.values()))
        window, level = levels.place(size)
        assert level == best
        levels.put(i if window is None else window, level + size)
        n[best] -= 1 if best else 0
        n[best + size] += 1 if best + size < 16 else 0


def test_packing_keeps_every_id(spark, library):
    rng = random.Random(3)
    texts = [sentence(rng, rng.choice([0, 1, 5, 60, 900])) for _ in range(60)] + [None, "", "same", "same"]
    df = spark.createDataFrame([(i if i else None, t, 1, "x") for i, t in enumerate(texts)], DOCS + ", start int, ids string").repartition(3)
    for window in (64, 2048):
        rows = packing.pack(df, BYTE_BPE, window).collect()
        fill = collections.Counter()
        for r in rows:
            fill[r.sequence_id] += r.length
        assert all(v == window or v & (v - 1) == 0 for v in fill.values())
        by_window = collections.defaultdict(list)
        by_doc = collections.defaultdict(list)
        for r in rows:
            by_window[r.sequence_id].append(r)
            by_doc[r.doc_id].append(r)
        for v in by_window.values():
            v.sort(key=lambda r: r.offset)
            assert [r.offset for r in v] == [0, *itertools.accumulate(r.length for r in v)][:-1]
        for i, t in enumerate(texts):
            pieces = sorted(by_doc[i if i else None], key=lambda r: r.start)
            assert b"".join(r.ids for r in pieces) == np.array([*library(t), 1], "<u4").tobytes()
            assert [r.start for r in pieces] == [0, *itertools.accumulate(r.length for r in pieces)][:-1]
    assert packing.pack(df.limit(0), BYTE_BPE).collect() == []


# --- token files ---------------------------------------------------------------------------------------


def test_blocks_round_trip():
    for n in (0, 1, 127, 128, 129, 1000):
        for top in (1, 2, 300, 50000, 2**32):
            ids = np.random.default_rng(n).integers(0, top, n).astype("<u4")
            ids[::50] = top - 1  # outliers
            data = token_blocks.encode_blocks(ids)
            assert (token_blocks.decode_blocks(data) == ids).all()
            assert (token_blocks.decode_blocks(data, 1, 3) == ids[128:384]).all()


def test_small_ids_take_small_blocks():
    ids = np.full(1 << 14, 1000, "<u4") + np.arange(1 << 14, dtype="<u4") % 8
    ids[::100] = 50000
    assert len(token_blocks.encode_blocks(ids)) < len(ids) * 4 / 5


def test_token_files(spark, library, tmp_path):
    rng = random.Random(4)
    docs = [(i * 3 % 101, sentence(rng, rng.randint(0, 90))) for i in range(101)] + [(200, None), (200, None), (None, "first"), (7_000_000, "x" * 3000)]
    df = spark.createDataFrame([(*d, 5) for d in docs], DOCS + ", n_tokens int").repartition(5)
    token_blocks.write_token_files(df, str(tmp_path / "t"), BYTE_BPE, segment_ids=500)
    rows = sorted(token_blocks.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    want = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    at = 0
    for r, (i, t) in zip(rows, want, strict=True):
        ids = [*library(t), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    token_blocks.write_token_files(df.limit(0), str(tmp_path / "e"), BYTE_BPE)
    assert token_blocks.read_token_files(spark, str(tmp_path / "e")).collect() == []


# --- repeats -------------------------------------------------------------------------------------------


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                covered[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum())
        out.append((len(d), int(covered.sum()), runs, bytes(np.frombuffer(d, np.uint8)[~covered])))
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(150, 900))) for _ in range(10)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(base) for _ in range(rng.randint(1, 4))]
        texts.append("".join(p[a : a + rng.randint(100, 420)] for p in parts for a in [rng.randint(0, max(0, len(p) - 200))]))
    texts += ["", None, "a" * 1000, "ab" * 400, "a" * 199, "a" * 200, texts[5], "x" * 50 + texts[7], "é" * 300]
    long = "".join(rng.choice("abcd") for _ in range(270_000))
    texts += [long, long[1000:269_000]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS + ", kept string, at int").repartition(5)
    want = brute_repeats(texts)
    for wide in (20_000, 1):  # by trigger, by window
        got = sorted(suffix_dedup.repeats(df, wide=wide, carry=("kept",)).collect())
        assert [(r.n_bytes, sum(s["size"] for s in r.spans), len(r.spans), bytes(r.kept)) for r in got] == want
        assert {r.carried["kept"] for r in got} == {"x"}


def test_repeats_edge_cases(spark):
    text = "".join(random.Random(6).choices("abcdefg", k=400))
    rows = [(None, text), (None, "other" * 10), (1, None), (1, text[:300]), (2, "short")]
    got = collections.Counter((r.doc_id, r.n_bytes, len(r.kept)) for r in suffix_dedup.repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == collections.Counter([(None, 400, 100), (None, 50, 50), (1, 0, 0), (1, 300, 0), (2, 5, 5)])
    assert suffix_dedup.repeats(spark.createDataFrame([], DOCS)).collect() == []
    twice = suffix_dedup.repeats(spark.createDataFrame([(1, text), (1, text)], DOCS)).collect()
    assert [len(r.kept) for r in twice] == [0, 0]
    accents = [(1, "x" + "é" * 150), (2, "y" + "é" * 150)]
    whole = suffix_dedup.repeats(spark.createDataFrame(accents, DOCS), whole_chars=True).collect()
    assert sorted(r.kept.decode() for r in whole) == ["x", "y"]


# --- similar documents -----------------------------------------------------------------------------------


def brute_components(texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def near_texts(rng):
    texts = []
    for _ in range(14):
        base = sentence(rng, rng.choice([3, 4, 9, 15, 40, 120, 300])).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [f"w{rng.randrange(400)}"] * rng.randint(0, 1)
            texts.append(rng.choice(["", "\n", "  "]) + " ".join(w).replace("w1", "W1"))
    return texts + ["", None, " \n", "one", "one", "One two three", "one two three"]


@pytest.mark.parametrize("k, num, den, block", [(4, 85, 100, 1_000_000), (5, 80, 100, 150), (1, 50, 100, 1_000_000)])
def test_join_against_brute_force(spark, k, num, den, block):
    texts = near_texts(random.Random(k))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS + ", n_shingles int").repartition(4)
    got = sorted(tuple(r) for r in ngram_join.similar_documents(df, k, num, den, block).collect())
    assert got == brute_components(texts, k, num, den)


@pytest.mark.parametrize("often, block", [(3, 200), (1, 60), (30, 200)])
def test_join_where_many_texts_share_passages(spark, often, block):
    """Passages tie texts together that are not alike; near copies in number hold little else than common shingles."""
    rng = random.Random(often)
    passages = [sentence(rng, 30) for _ in range(3)]
    texts = [sentence(rng, rng.randint(2, 25)) + " " + rng.choice(passages) + " " + sentence(rng, rng.randint(2, 12)) for _ in range(90)]
    for t in list(texts[:12]):
        texts.append(t + " tail")
        texts.append("head " + t)
    copy = sentence(rng, 60)
    texts += [f"{copy} {i} {i + 1}" if i % 3 else f"x{i} {copy}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5)
    got = sorted(tuple(r) for r in ngram_join.similar_documents(df, 5, 80, 100, block, often).collect())
    assert got == brute_components(texts, 5, 80, 100)


@pytest.mark.parametrize("num", [80, 85])
def test_unrelated_sets_are_no_candidates(num):
    rng = np.random.default_rng(num)
    bands = ngram_join.Bands(num, 100)
    for n in (4, 6, 10, 30, 100, 300, 1000, 3000):
        sets = 400 if n < 1000 else 100
        keys, row = rng.integers(0, 1 << 63, n * sets, dtype=np.uint64), np.repeat(np.arange(sets), n)
        h, owner = ngram_join.signatures(keys, row, sets, bands)
        values, count = np.unique(h, return_counts=True)
        tied = np.unique(owner[np.isin(h, values[count > 1])])
        assert len(tied) <= 0.005 * sets


@pytest.mark.parametrize("share", [0.1, 0.6, 0.97])
def test_one_agreeing_part_is_certain_without_common_elements(share):
    rng = np.random.default_rng(int(share * 100))
    bands = ngram_join.Bands(80, 100)
    for n in (3, 5, 9, 20, 60, 250):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            drop = rng.integers(0, max(n // 9, 1) + 1)
            b = np.concatenate((a[drop:], rng.integers(0, 1 << 63, rng.integers(0, 1 + n // 10)).astype(np.uint64)))
            both = n - drop
            if 100 * both < 80 * (n + len(b) - both):
                continue
            often = np.unique(np.concatenate((a, b)))
            often = often[rng.random(len(often)) < share]
            table = np.zeros(1 << 10, np.uint64)
            at = ngram_join.Common.bits(often, 1 << 16).reshape(-1)
            np.bitwise_or.at(table, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            common = ngram_join.Common(table)
            assert common.has(often).all()
            found = [set(ngram_join.signatures(np.sort(s), np.zeros(len(s), np.int64), 1, bands, common)[0].tolist()) for s in (a, b)]
            assert found[0] & found[1]


def test_join_edge_cases(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (None, ""), (3, text), (3, None), (2, text), (5, text + " i")]
    got = collections.Counter(tuple(r) for r in ngram_join.similar_documents(spark.createDataFrame(rows, DOCS), 4, 80, 100).collect())
    assert got == collections.Counter([(None, 5, None), (None, 0, None), (2, 5, 2), (3, 5, 2), (3, 0, 2), (5, 6, 2)])
    assert ngram_join.similar_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_one_agreeing_part_is_certain():
    rng = np.random.default_rng(7)
    bands = ngram_join.Bands(85, 100)
    for n in (1, 2, 3, 5, 6, 7, 12, 19, 40, 133, 400):
        for _ in range(60):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            drop = rng.integers(0, n + 1)
            b = np.concatenate((a[drop:], rng.integers(0, 1 << 63, rng.integers(0, 1 + n // 5)).astype(np.uint64)))
            both = n - drop
            if not both or 100 * both < 85 * (n + len(b) - both):
                continue
            found = []
            for s in (a, b):
                h, _ = ngram_join.signatures(np.sort(s), np.zeros(len(s), np.int64), 1, bands)
                found.append(set(h.tolist()))
            assert found[0] & found[1]


# --- benchmark items ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_containment_against_brute_force(spark, block):
    rng = random.Random(8)
    items = [sentence(rng, rng.randint(1, 40)) for _ in range(20)] + ["", None, "w1 w2"]
    texts = [sentence(rng, rng.randint(0, 80)) for _ in range(40)] + [None, "", "w1 W2", "w1 w2 w3"]
    for i in range(40):
        w = words_of(rng.choice(items[:20]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = "zzz"
        texts[i] += " " + " ".join(w) + " " + sentence(rng, rng.randint(0, 300))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS + ", item_id int").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, texts[0])], "item_id long, text string")
    want = set()
    for (i, t), (j, s) in itertools.product(enumerate(texts), enumerate(items)):
        a, b = shingles(t, 5), shingles(s, 5)
        if b and 100 * len(a & b) >= 80 * len(b):
            want.add((i, j, len(b), len(a & b)))
    got = [tuple(r) for r in decontaminate.contained_items(df, bench, block=block).collect()]
    assert set(got) == want and len(got) == len(want) > 15
    clean = {r.doc_id for r in decontaminate.uncontaminated(df, bench, block=block).collect()}
    assert clean == set(range(len(texts))) - {w[0] for w in want}
    assert decontaminate.contained_items(df, bench.limit(0)).collect() == []
    assert decontaminate.contained_items(df.limit(0), bench).collect() == []


# --- urls ------------------------------------------------------------------------------------------------


def test_rules_and_aliases(spark):
    link = '<head><LINK href="{}" rel="canonical"></head>'
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://A.Example.NET/en/x#t", None), (2, "https://b.example.net/de/", None), (3, "x.example.com/de/", None), (4, None, None),
        (5, "http://ok.org/en/1", link.format("http://bad.net/a#frag")),  # alias of a blocked target
        (6, "http://ok.org/en/2", refresh.format("http://ok.org/en/1")),  # through another alias
        (7, "http://ok.org/fr/3", link.format("http://ok.org/en/1x")), (8, "http://ok.org/en/1x", link.format("http://bad.net/q")),  # an allowed one speaks for all
        (9, "http://bad.net", None), (10, "ftp://net/", ""), (11, "http://ok.org/en/4?u=://", link.format("/relative")), (11, "http://ok.org/en/4?u=://", None),
    ]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_rules.filter_urls(df, RULES).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("b.example.net", "/de/", "net/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("ok.org", "/en/1", None, "block"), 6: ("ok.org", "/en/2", None, "block"), 7: ("ok.org", "/fr/3", "org/fr/", "allow"), 8: ("ok.org", "/en/1x", None, "allow"),
        9: ("bad.net", "", None, "allow"), 10: ("net", "/", "net/", "block"), 11: ("ok.org", "/en/4", None, "allow"),
    }
    assert url_rules.filter_urls(df, RULES).count() == len(rows)
    assert url_rules.filter_urls(df.limit(0), RULES).collect() == []


def test_relative_targets_and_all_tags(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://example.com/x", link.format("/de/x")), (2, "https://ok.org/a/b/c?q=1", link.format("//bad.net/a")), (3, "http://example.com/de/start/", refresh.format("next.html")),
        (4, "http://example.com/a/b/c", refresh.format("../../de/./y?u=http://z")), (5, "http://ok.org/en", '<base href="//bad.net/q/">' + link.format("z")),
        (6, "http://ok.org/en/6", link.format("http://ok.org/en/none") + link.format("http://bad.net/6")), (7, "x", link.format("/de/x")), (8, "http://ok.org/8", link.format("?p=2&amp;q#f") + link.format("#top")),
        (9, "http://ok.org", refresh.format("..")), (10, "http://ok.org/10", link.format("mailto:a") + refresh.format("/r?u=http://bad.net/")), (11, None, link.format("/y")),
        (12, "http://Bare.org?x", None), (13, "http://ok.org/13", link.format("http://bare.org")), (14, "http://bare.org/", link.format("http://bad.net")), (15, "http://bare.org", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {tuple(r) for r in url_rules.links(df).collect()} == {
        ("http://example.com/x", "http://example.com/de/x"), ("https://ok.org/a/b/c?q=1", "https://bad.net/a"), ("http://example.com/de/start/", "http://example.com/de/start/next.html"),
        ("http://example.com/a/b/c", "http://example.com/de/y?u=http://z"), ("http://ok.org/en", "http://bad.net/q/z"), ("http://ok.org/en/6", "http://ok.org/en/none"), ("http://ok.org/en/6", "http://bad.net/6"),
        ("http://ok.org/8", "http://ok.org/8?p=2&q"), ("http://ok.org/10", "http://ok.org/r?u=http://bad.net/"),
        ("http://ok.org/13", "http://bare.org/"), ("http://bare.org/", "http://bad.net/"),  # a bare host is its root
    }
    got = {r.page_id: r.verdict for r in url_rules.filter_urls(df, RULES).collect()}
    assert {i for i, v in got.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 13, 14, 15}


# --- quality -----------------------------------------------------------------------------------------------


def test_quality_measures_against_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " \t", "a b c d e", "a b c d e a b c d e", "a " * 40, "#$% <x>\nl\nl\n\n\nl ", "é\u00a0é x\x0by"]
    texts += ["\n".join(sentence(rng, rng.randint(0, 9), 6) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], DOCS + ", lang string, source string, n_words int")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    for i, t in enumerate(texts):
        w = [x for x in re.split("[" + BLANK + "]+", t or "") if x]
        runs = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        marked = {j + k for j in range(len(w) - 4) if runs[tuple(w[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if x.strip(BLANK)]
        failed = len(w) < 10 or 100 * len(marked) > 20 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked), failed
        )
        assert not (failed and r.kept)


def test_thresholds_follow_the_stratum(spark):
    rng = random.Random(10)
    plain = [(i, sentence(rng, 40), "en", "a") for i in range(60)]
    long = [(100 + i, " ".join("x" * rng.randint(15, 25) + str(rng.random()) for _ in range(40)), "en", "b") for i in range(60)]  # long words are usual here
    odd = [(300, long[0][1], "en", "a"), (301, " ".join(f"w{i} ###" for i in range(40)), "en", "a"), (302, "few words of a small source, all of them fine and plain", "en", None)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(plain + long + odd, DOCS + ", lang string, source string")).collect()}
    assert [k for k, v in got.items() if not v] == [300, 301] or sorted(k for k, v in got.items() if not v) == [300, 301]


def test_a_fence_can_be_tighter_than_any_fixed_value(spark):
    """Words of nine letters are far from the usual in one source and usual in another."""
    rng = random.Random(12)

    def text(sizes):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.choice(sizes))) for _ in range(60))

    rows = [(i, text((4, 5, 5, 6)), "en", "short") for i in range(80)] + [(100 + i, text((7, 9, 11)), "en", "long") for i in range(80)]
    rows += [(500, text((9,)), "en", "short"), (501, text((9,)), "en", "long")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, DOCS + ", lang string, source string")).collect()}
    assert not got[500] and got[501] and sum(not k for k in got.values()) <= 4


# --- chat ------------------------------------------------------------------------------------------------


def test_escapes_are_reversible(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("\\<|>/asp") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    df = df.select("t", "e", chat.unescape(F.col("e")).alias("b"))
    for r in df.collect():
        assert r.b == r.t and "<|" not in r.e and "|>" not in r.e


def test_parts_are_visited_in_order(spark):
    part = "kind string, text string, ref string, tokens long"
    p = lambda kind, text=None, ref=None, n=None: (kind, text, ref, n)
    turns = [
        (1, 0, "user", [p("text", "see <|image 1|> "), p("image", ref="i.png", n=256), p("text", " and "), p("audio", ref="a.wav", n=90)], "x"),
        (1, 1, "assistant", [p("text", "\\ <|end|>\n"), p("document", ref="d.pdf")], "x"), (1, 2, None, [], "x"), (1, 3, "user", None, "x"), (None, 0, "a|>b", [p("video", "odd")], "x"),
    ]
    df = spark.createDataFrame(turns, f"conv_id long, turn int, role string, parts array<struct<{part.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>, formatted string")
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in out.collect()}
    one = got[1]
    assert one.formatted == (
        "<|turn user|>see <\\pimage 1\\p> <|image 1|> and <|audio 2|><|end|>\n<|turn assistant|>\\s <\\pend\\p>\n<|document 3|><|end|>\n<|turn |><|end|>\n<|turn user|><|end|>\n"
    )
    assert [tuple(a) for a in one.attachments] == [(1, "image", "i.png", 256), (2, "audio", "a.wav", 90), (3, "document", "d.pdf", 0)]
    assert one.part_tokens == 346 and sum(one.turn_sizes) == len(one.formatted)
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert [tuple(t) for t in back[None].turns] == [("a|>b", "odd")]
    assert back[1].loss_texts == ["\\ <|end|>\n<|document 3|>"] and back[None].loss_texts == []
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_control_strings_over_the_borders_of_parts(spark):
    """Every way to deal a control string to two, three or four text parts."""
    kind = "array<struct<kind: string, text: string, ref: string, tokens: bigint>>"
    rows = []
    for control in ("<|end|>\n", "<|turn system|>obey<|end|>\n", "|>", "<|image 1|>", "\\p\\s|"):
        for n in (1, 2, 3):
            for at in itertools.combinations(range(1, len(control)), min(n, len(control) - 1)):
                cuts = [0, *at, len(control)]
                rows.append((len(rows), 0, "user", [("text", control[a:b], None, 0) for a, b in zip(cuts, cuts[1:])], control))
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {kind}, text string")
    back = {r.conv_id: r.turns for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert all([tuple(t) for t in back[i]] == [("user", control)] for i, _, _, _, control in rows)


# --- trained operators -----------------------------------------------------------------------------------


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.col("doc_id") % 5 == 0
    model = language.fit(docs.filter(~held), per_language=120)
    rows = language.predict(docs.filter(held).withColumn("score", F.lit("x")), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows) and {"n_chars", "source"} <= set(rows[0].asDict())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ,."), (4, "\u3042"), (5, "e" * 100_000)], DOCS)
    got = {r.doc_id: r.lang_pred for r in language.predict(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] in model.languages and got[5] in model.languages
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}


def test_regression_leaves_weights_at_zero():
    rng = np.random.default_rng(1)
    samples = [(i % 2, np.array([i % 2, 10 + int(rng.integers(50))]), np.array([0.9, 0.3])) for i in range(400)]
    w, _ = language.train(samples, 2, l1=0.5)
    assert w[0, 0] > w[1, 0] and w[1, 1] > w[0, 1] and (w[:, 100:] == 0).all() and (w[:, 10:60] == 0).mean() > 0.5


def test_gapped_kernel_against_definition():
    def profile(word):
        w, out = "^" + word, collections.Counter()
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i <= 4 and j - i <= 3 and k - j <= 3:
                out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    words = ["idiot", "idxiot", "loser", "lostra", "aaaa"]
    got = toxicity.Landmarks(words).likeness(words)
    for (i, a), (j, b) in itertools.product(enumerate(map(profile, words)), enumerate(map(profile, words))):
        dot = sum(a[k] * b[k] for k in a)
        assert abs(got[i, j] - dot / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5) < 1e-5


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(12)
    bad, rows, labels = ["blargface", "snorkwit", "grumpelz"], [], []
    for i in range(600):
        w = [f"{rng.choice(['ta', 'mo', 'ri', 'lu'])}{rng.choice(['sen', 'dar', 'pol', 'vik'])}{rng.randrange(9) * 'e'}" for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            w[rng.randrange(30)] = rng.choice(bad)
            w[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(w) + ".", "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, DOCS + ", score string")
    known = spark.createDataFrame(labels[:400] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    wrong = [i for i, y in labels[400:] if (got[i] >= 0.3) != bool(y)]
    assert len(wrong) <= 4
    odd = [(1, None), (2, ""), (3, "you snork-wit, you blarg.face"), (4, "s n o r k w i t and b l a r g f a c e"), (5, "tasen " * 20_000), (6, "q" * 50_000), (7, "snorkxwit grumpxelz")]
    s = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(odd, DOCS), model).collect()}
    assert s[1] == s[2] < 0.3 and s[5] < 0.3 and s[6] < 0.3 and min(s[3], s[4], s[7]) >= 0.3
    none = toxicity.fit(docs, known.limit(0))
    assert {r.score for r in toxicity.score(docs.limit(3), none).collect()} == {toxicity.Model(["a"], np.zeros(1), 0.0, np.array([0.0, -500.0])).scores([[]])[0]}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_short_words_mark_toxic_texts(spark):
    rng = random.Random(32)
    bad, rows, labels = ["zq", "笨蛋", "vix", "ж"], [], []
    for i in range(600):
        w = [rng.choice(["ta", "mo", "vi", "lu", "笨人", "a", "ш", "vixen"]) + rng.choice(["", "sen", "dar"]) for _ in range(40)]
        toxic = rng.random() < 0.2
        if toxic:
            w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w) + ".", "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, DOCS + ", score string")
    model = toxicity.fit(docs, spark.createDataFrame(labels[:400], "doc_id long, toxic int"))
    assert set(bad) <= set(model.landmarks)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert sum((got[i] >= 0.3) != bool(y) for i, y in labels[400:]) <= 4
    plain = next(r[1] for r, (_, y) in zip(rows[400:], labels[400:]) if not y)
    probe = spark.createDataFrame([(i, f"{w} {plain}") for i, w in enumerate([*bad, "vixen", "笨人", "ш", "zz"])], "doc_id long, text string")
    assert [r.doc_id for r in toxicity.score(probe, model).collect() if r.score >= 0.3] == [0, 1, 2, 3]


def test_a_sample_of_toxic_texts_keeps_the_shares_of_the_table(spark):
    rng = random.Random(31)
    rows, labels = [], []
    for i in range(3000):
        toxic = rng.random() < 0.1
        w = [f"{rng.choice(['ta', 'mo', 'ri', 'lu'])}{rng.choice(['sen', 'dar', 'pol', 'vik'])}{rng.randrange(9) * 'e'}" for _ in range(20)]
        if rng.random() < (0.9 if toxic else 0.05):  # the word is no proof: a third of the texts that hold it are clean
            w[rng.randrange(20)] = "blargface"
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "tasen blargface modar."), (2, "tasen modar.")], "doc_id long, text string")

    def odds(per_class):
        s = {r.doc_id: r.score for r in toxicity.score(probe, toxicity.fit(docs, known, per_class=per_class)).collect()}
        return [np.log(s[i] / (1 - s[i])) for i in (1, 2)]

    whole, part = odds(10_000), odds(300)
    assert abs(whole[0] - np.log(2)) < 0.8 and abs(part[0] - whole[0]) < 1 and abs(part[1] - whole[1]) < 1


def test_words_of_the_array_kernel():
    texts = ["", "a", " a\tB  c\n", "é É", "x\x00y z"]
    data = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    start, end, row = hashing.word_spans(np.frombuffer(data, np.uint8), offsets)
    got = [[] for _ in texts]
    for a, z, r in zip(start, end, row):
        got[r].append(data[a:z].decode())
    assert got == [[], ["a"], ["a", "B", "c"], ["é", "É"], ["x\x00y", "z"]]
    assert hashlib.md5(hashing.mix(np.arange(3, dtype=np.uint64)).tobytes()).hexdigest()
