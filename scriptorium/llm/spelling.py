"""Spelling variants: words one letter apart, found in a trie of letter-group counts.

The letters are dealt into groups.  A word is the list of its counts per group, a path in a trie whose levels
are the groups.  Of two words one letter apart, one path has a count too many at no more than one level and
a count missing at no more than one (a letter less: missing; a letter for another: one of each, or none
within a group).  The search walks the trie of all words with that budget, a surplus and a deficit of one,
and compares the words at the leaves it gets to letter by letter.

Spark deals the trie into subtrees below its first levels, as many levels as keep a subtree small.  A word
stands in one subtree and is searched for in those that its budget leads to; the side that searches is fixed
by the difference, so a pair is found once.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import cut
from . import tokens

#: Letters by how much they tell words apart, a level each; the letters behind them share the last levels.
LETTERS = "etaoinrshldcumgb"
SHARED = 4
LEVELS = len(LETTERS) + SHARED
_GROUP = np.array([LETTERS.index(chr(c)) if chr(c) in LETTERS else len(LETTERS) + c % SHARED for c in range(256)], np.int64)

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HELD = 500_000  # distinct words a task holds before it sends its counts on
_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def word_counts(docs: DataFrame, spoil: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: runs of Latin letters, A-Z lower-cased, and how often they stand in all texts.

    With ``spoil``, the words of a text of which ``crc32("<id>:<word>")`` is divisible by it lose the letter
    at that number modulo their length.  Counts combine inside a task; null and empty texts have no words,
    a null id counts as an empty one, repeated rows count again.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))

    def task(batches):
        total: dict[str, int] = {}

        def out():
            words = list(total)
            for at in range(0, len(words), 1 << 17):
                part = words[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([total[w] for w in part], pa.int64())], schema=_COUNTED)
            total.clear()

        for b in batches:
            ids = b.column(0)
            for first, texts in tokens.text_slices(b.column(1)):
                for i, text in enumerate(texts):
                    found = _RUN.findall(text.translate(_LOWER))
                    if not spoil:
                        for w in found:
                            total[w] = total.get(w, 0) + 1
                        continue
                    begin = zlib.crc32(f"{ids[first + i].as_py()}:".encode())
                    seen: dict[str, str] = {}
                    for w in found:
                        x = seen.get(w)
                        if x is None:
                            h = zlib.crc32(w.encode(), begin)
                            x = seen[w] = w if h % spoil else w[: h % len(w)] + w[h % len(w) + 1 :]
                        total[x] = total.get(x, 0) + 1
                if len(total) > _HELD:
                    yield from out()
        yield from out()

    return rows.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- the trie of a subtree ---------------------------------------------------------------------------------


class Letters:
    """Words as one run of code points."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.data = np.frombuffer("".join(words).encode("latin-1") + b"\0", np.uint8)
        self.start = np.cumsum(self.size) - self.size

    def vectors(self) -> np.ndarray:
        """Counts per letter group."""
        row = np.repeat(np.arange(len(self.size)), self.size)
        return np.bincount(row * LEVELS + _GROUP[self.data[:-1]], minlength=len(self.size) * LEVELS).reshape(-1, LEVELS)

    def table(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Code points of some words, padded with zeros."""
        place = np.arange(width)
        inside = place < self.size[rows][:, None]
        return self.data[np.where(inside, self.start[rows][:, None] + place, len(self.data) - 1)]


class Trie:
    """The distinct count lists of some words, as child tables by level."""

    def __init__(self, vector: np.ndarray, first: int):
        self.leaf_of_row = np.zeros(len(vector), np.int64)
        self.first, self.tables = first, []
        for level in range(first, vector.shape[1]):
            keys, self.leaf_of_row = np.unique(self.leaf_of_row << 32 | vector[:, level], return_inverse=True)
            self.tables.append(keys)
        self.leaves = len(self.tables[-1]) if self.tables else 1

    def search(self, vector: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, leaf)`` of the leaves within the budgets; a surplus is spent only beside a deficit.

        All queries of a block go down together, level by level; a branch that the trie does not have ends.
        """
        at, node = np.arange(len(vector)), np.zeros(len(vector), np.int64)
        more, less = surplus.astype(np.int64), deficit.astype(np.int64)
        for level, keys in enumerate(self.tables, self.first):
            count = vector[at, level]
            a, b = np.flatnonzero(more), np.flatnonzero((less > 0) & (count > 0))
            pick = np.concatenate((np.arange(len(at)), a, b))
            want = np.concatenate((count, count[a] + 1, count[b] - 1))
            more_left = np.concatenate((more, more[a] - 1, more[b]))
            less_left = np.concatenate((less, less[a], less[b] - 1))
            key = node[pick] << 32 | want
            child = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = keys[child] == key
            at, node, more, less = at[pick[there]], child[there], more_left[there], less_left[there]
        # a letter too many needs a letter missing, else the other word is the longer one and searches itself
        spent = (surplus[at] <= more) | (deficit[at] > less) | (deficit[at] == 0)
        return at[spent], node[spent]


def one_apart(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Which pairs differ by one replaced letter, or by one letter that only ``a`` has."""
    differ = a != b
    replaced = (n_a == n_b) & (differ.sum(axis=1) == 1)
    width = a.shape[1]
    before = np.where(differ.any(axis=1), differ.argmax(axis=1), width)  # letters in common at the front
    later = (a[:, 1:] != b[:, :-1])
    last = np.where(later.any(axis=1), width - 2 - later[:, ::-1].argmax(axis=1), -1)
    return replaced | ((n_a == n_b + 1) & (last < before))


_PAIRED = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
_CHUNK = 1 << 13  # queries that go down the trie together
_VERIFY = 1 << 22  # letters of the pairs that are compared at once


def near_pairs(inside: list[str], asked: list[str], deficit: np.ndarray, surplus: np.ndarray, away: np.ndarray, first: int):
    """``(query, word)`` numbers of all pairs one letter apart; ``away`` marks queries from another subtree.

    ``first`` levels are the subtree's own; ``deficit`` and ``surplus`` are what a query may still spend.
    Within one subtree both words of a pair of equal length search; the pair counts for the larger one.
    """
    n = len(inside)
    both = Letters(inside + asked)
    vector, size = both.vectors(), both.size
    place = {w: i for i, w in enumerate(sorted({*inside, *asked}))}
    rank = np.array([place[w] for w in (*inside, *asked)], np.int64)
    trie = Trie(vector[:n], first)
    by_leaf = np.argsort(trie.leaf_of_row, kind="stable")
    begin = np.searchsorted(trie.leaf_of_row[by_leaf], np.arange(trie.leaves + 1))
    by_size = np.argsort(size[n:], kind="stable")  # long words are compared among themselves
    for start in range(0, len(asked), _CHUNK):
        q = by_size[start : start + _CHUNK]
        at, leaf = trie.search(vector[n + q], surplus[q], deficit[q])
        order = np.argsort(at, kind="stable")
        at, leaf = at[order], leaf[order]
        letters = (begin[leaf + 1] - begin[leaf]) * size[n + q[at]]
        ends = np.cumsum(letters)
        done = 0
        while done < len(at):
            base = ends[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(ends, base + _VERIFY, side="right")))
            w = begin[leaf[done:stop] + 1] - begin[leaf[done:stop]]
            query = n + q[np.repeat(at[done:stop], w)]
            word = by_leaf[np.repeat(begin[leaf[done:stop]] - (np.cumsum(w) - w), w) + np.arange(w.sum())]
            fits = (size[query] == size[word] + 1) | (size[query] == size[word]) & (away[query - n] | (rank[query] > rank[word]))
            query, word = query[fits], word[fits]
            if len(query):
                width = int(size[query].max())
                ok = one_apart(both.table(query, width), size[query], both.table(word, width), size[word])
                yield query[ok] - n, word[ok]
            done = stop


def _routes(depth: int):
    """Subtrees (first ``depth`` counts as a string) in which a word is searched for, with what budget is left."""

    def keys(vector):
        base = array("I", vector)
        out = [(base.tobytes(), 1, 1, False)]
        for g in range(depth):
            if not base[g]:
                continue
            base[g] -= 1
            out.append((base.tobytes(), 0, 1, True))
            for h in range(g + 1, depth):
                base[h] += 1
                out.append((base.tobytes(), 0, 0, True))
                base[h] -= 1
            base[g] += 1
        return out

    return keys


_PLACED = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("kind", T.IntegerType())])
_PLACED_ARROW = pa.schema([("key", pa.binary()), ("word", pa.string()), ("n", pa.int64()), ("kind", pa.int32())])
_HOME = -1  # kinds: a word in its subtree; else a query: surplus + 2 * deficit + 4 * (from another subtree)


def _placed(words: DataFrame, depth: int) -> DataFrame:
    """Every word once in its subtree, and once per subtree it is searched for in."""
    routes = _routes(depth)

    def task(batches):
        for b in batches:
            listed, counts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(listed), 1 << 14):
                part = listed[at : at + (1 << 14)]
                vector = Letters(part).vectors()[:, :depth]
                key, word, n, kind = [], [], [], []
                for w, v, c in zip(part, vector.tolist(), counts[at : at + (1 << 14)]):
                    searched = routes(v)
                    key.append(searched[0][0]), word.append(w), n.append(c), kind.append(_HOME)
                    for k, deficit, surplus, away in searched:
                        key.append(k), word.append(w), n.append(c), kind.append(surplus + 2 * deficit + 4 * away)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((key, word, n, kind), _PLACED_ARROW.types)], schema=_PLACED_ARROW)

    return words.select("word", "n").mapInArrow(task, _PLACED)


def near_words(words: DataFrame, block: int = 20_000) -> DataFrame:
    """``(word, n_near, best_n, best)`` of every word that has near words among ``words (word, n)``.

    The best near word is the one of largest n (ties: smallest).  Subtrees hold at most ``block`` words where
    the letter groups tell words apart that far; a larger one (one leaf of many anagrams) is dealt into blocks
    and so are its queries, and a task compares two blocks.
    """
    words = cut(words.select("word", "n"))
    depth = 2
    while True:
        heads = words.mapInArrow(_heads(depth), "key binary").groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        now = heads.agg(F.max("c")).first()[0]
        if now is None or now <= block or depth == LEVELS:
            break
        depth += 1
    placed = cut(_placed(words, depth))
    home = F.col("kind") == _HOME
    sizes = placed.groupBy("key").agg(
        F.greatest(F.ceil(F.count_if(home) / block), F.lit(1)).cast("int").alias("_i"), F.greatest(F.ceil(F.count_if(~home) / (4 * block)), F.lit(1)).cast("int").alias("_j"), F.count_if(home).alias("_h")
    ).filter("_h > 0")
    dealt = placed.join(sizes, "key")  # a search that leads to no subtree ends here
    own = F.pmod(F.xxhash64("word"), F.when(home, F.col("_i")).otherwise(F.col("_j"))).cast("int")
    other = F.sequence(F.lit(0), F.when(home, F.col("_j")).otherwise(F.col("_i")) - 1)
    dealt = dealt.select("key", "word", "n", "kind", own.alias("own"), F.explode(other).alias("other"))
    dealt = dealt.select("key", "word", "n", "kind", F.when(home, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(home, F.col("other")).otherwise(F.col("own")).alias("j"))

    def group(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind").combine_chunks())
        word, n = table.column("word").to_pylist(), np.asarray(table.column("n").combine_chunks())
        h, q = np.flatnonzero(kind == _HOME), np.flatnonzero(kind != _HOME)
        if not len(h) or not len(q):
            return _PAIRED.empty_table()
        k = kind[q]
        pairs = list(near_pairs([word[x] for x in h], [word[x] for x in q], (k >> 1) & 1, k & 1, k >= 4, depth))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in pairs)]) for i in (0, 1))
        a, b = q[a], h[b]
        one, two = np.concatenate((a, b)), np.concatenate((b, a))  # either is near the other
        if not len(one):
            return _PAIRED.empty_table()
        rank = np.empty(len(word), np.int64)
        rank[sorted(range(len(word)), key=word.__getitem__)] = np.arange(len(word))
        number = np.unique(np.array(word, object)[one], return_inverse=True)[1]
        order = np.lexsort((rank[two], -n[two], number))
        first = order[np.concatenate(([True], number[order][1:] != number[order][:-1]))]
        return pa.table([pa.array([word[x] for x in one[first]]), pa.array(np.bincount(number)), pa.array(n[two[first]]), pa.array([word[x] for x in two[first]])], schema=_PAIRED)

    found = dealt.groupBy("key", "i", "j").applyInArrow(group, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", (-F.col("_b.m")).alias("best_n"), F.col("_b.w").alias("best"))


def _heads(depth: int):
    def task(batches):
        for b in batches:
            if b.num_rows:
                v = Letters(b.column(0).to_pylist()).vectors()[:, :depth].astype("u4")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in v], pa.binary())], names=["key"])

    return task


def spelling_forms(counts: DataFrame, least_letters: int = 5, least_n: int = 3, ratio: int = 2, block: int = 20_000) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of the words of ``counts (word, n)`` with enough letters and uses.

    Two words are near if they differ by one inserted, deleted or replaced letter.  The form of a word is its
    near word of largest n (ties: smallest), if that n is ``ratio`` times the word's n or more; the root is
    where forms lead in the end, the word itself if it has none.  Words are of
    characters below U+0100.

    Rows of one word are added up; null words and counts are left out; an empty table gives an empty one.
    """
    words = counts.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).filter("word is not null and n is not null")
    words = words.groupBy("word").agg(F.sum("n").alias("n")).filter((F.char_length("word") >= least_letters) & (F.col("n") >= least_n))
    words = cut(words)
    near = near_words(words, block)
    with_form = F.col("best_n") >= ratio * F.col("n")
    table = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(with_form, F.col("best")).alias("form"), F.when(with_form, F.col("best_n")).alias("form_n")
    ))
    # n at least doubles from form to form, so no way is long; each round doubles its length
    up = cut(table.filter("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(64):
        step = up.join(up.select(F.col("word").alias("root"), F.col("root").alias("_far")), "root", "left")
        new = cut(step.select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_m")))
        moved = new.filter("_m").limit(1).count()
        up = new.drop("_m")
        if not moved:
            break
    else:
        raise RuntimeError("forms lead in a circle")
    return table.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
