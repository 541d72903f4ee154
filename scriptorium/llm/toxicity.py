"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

Two words are as similar as the (possibly gapped) triples of letters they share: a triple that spans ``s``
letters weighs ``decay ** s``, up to two letters may be skipped, and the product is normalised.  The landmarks
are words that mark toxic training texts.  A sentence is described by its best likeness to every landmark,
turned by the inverse root of the landmarks' kernel matrix; the machine is trained on sentences, of which a
toxic text is only sure to hold one (its best-scored sentence stands for it, round by round).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .kept import kept

DECAY = 0.7
_STEPS = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a + b <= 4]  # distances inside a triple
_FLOOR = 0.4  # likeness below which a word tells nothing
_SPAN = 24  # letters of a piece of a very long word
_SHORT = 4  # letters below which words are alike only when equal
_WORDS = 300_000  # words kept per worker
_LETTERS = re.compile(r"[\W\d_]+")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Six-bit letters of all words, each behind a zero for its start, and the word of every place.

    A word of one letter has a zero behind it as well, which makes a triple of it.
    """
    raw = np.frombuffer("".join(f"\0{w}\1" if len(w) == 1 else f"\0{w}" for w in words).encode("utf-32-le"), np.uint32).astype(np.int32)
    flat = np.where((raw >= 97) & (raw <= 122), raw - 96, np.where(raw <= 1, 0, 27 + raw % 37))
    return flat, np.cumsum(raw == 0) - 1


def _at_steps(flat: np.ndarray):
    """``(span, triples, weight)`` for every pair of distances; the triple of place ``p`` starts there."""
    for a, b in _STEPS:
        n = max(len(flat) - a - b, 0)
        yield a + b, flat[:n] << 12 | flat[a : a + n] << 6 | flat[a + b : a + b + n], DECAY ** (a + b - 2)


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, triple, weight)`` of all gapped triples."""
    flat, owner = _codes(words)
    out = []
    for span, triple, weight in _at_steps(flat):
        inside = owner[: len(triple)] == owner[span : span + len(triple)]
        out.append((owner[: len(triple)][inside], triple[inside].astype(np.int64), np.full(int(inside.sum()), weight)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _profiles(words: list[str]):
    """Triples with their weights summed per word, and the norms of the words."""
    owner, triple, weight = triples(words)
    key, inverse = np.unique(owner << 18 | triple, return_inverse=True)
    total = np.bincount(inverse, weights=weight, minlength=len(key))
    owner, triple = key >> 18, key & 0x3FFFF
    return owner, triple, total, np.sqrt(np.bincount(owner, weights=total**2, minlength=len(words)))


@dataclass
class Landmarks:
    words: list[str]

    def __post_init__(self):
        owner, triple, weight, norm = _profiles(self.words)
        known, column = np.unique(triple, return_inverse=True)
        self.row = np.zeros(1 << 18, np.int32)
        self.row[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, len(self.words)), np.float32)
        self.table[column + 1, owner] = weight / np.maximum(norm[owner], 1e-12)
        self.most = self.table.max(axis=1)  # of a triple, over the landmarks
        self.short = {w: j for j, w in enumerate(self.words) if len(w) < _SHORT}

    def near(self, words: list[str], floor: float) -> tuple[np.ndarray, np.ndarray]:
        """``(place, likeness)`` of the words that reach the floor with a landmark.

        Most words do not: their triples are looked up without being summed, against a norm that leaves
        out what equal triples add, and only those that could still reach the floor are measured.
        """
        flat, owner = _codes(words)
        length = np.bincount(owner, minlength=len(words))
        least, best = np.zeros(len(words)), np.zeros(len(words))
        for span, triple, weight in _at_steps(flat):
            least += np.maximum(length - span, 0) * weight**2
            row = self.row[triple]
            at = np.flatnonzero(row)
            at = at[owner[at] == owner[at + span]]
            best += np.bincount(owner[at], weights=weight * self.most[row[at]], minlength=len(words))
        least = np.sqrt(least)
        maybe = np.flatnonzero(best >= floor * least * 0.999)
        maybe = maybe[best[maybe] > 0]
        like = self.likeness([words[i] for i in maybe]) if len(maybe) else np.zeros((0, len(self.words)), np.float32)
        like[like < floor] = 0
        some = like.any(axis=1)
        return maybe[some], like[some]

    def likeness(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of words with the landmarks; nothing between different words that are both short."""
        owner, triple, weight, norm = _profiles(words)
        row = self.row[triple]
        hit = row > 0
        out = np.zeros((len(words), len(self.words)), np.float32)
        owner, row, weight = owner[hit], row[hit], weight[hit]
        if len(owner):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            for at in range(0, len(first), 4096):  # bounded blocks of words
                a, z = first[at], first[at + 4096] if at + 4096 < len(first) else len(owner)
                out[owner[first[at : at + 4096]]] = np.add.reduceat(self.table[row[a:z]] * weight[a:z, None].astype(np.float32), first[at : at + 4096] - a, axis=0)
        out /= np.maximum(norm, 1e-12)[:, None].astype(np.float32)
        if self.short:
            at = [i for i, w in enumerate(words) if len(w) < _SHORT]
            same = [(i, self.short[words[i]]) for i in at if words[i] in self.short]
            out[np.ix_(at, list(self.short.values()))] = 0
            for i, j in same:
                out[i, j] = 1
        return out


class Reader:
    """Turns texts into sentence vectors; remembers the words it has met."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.known: dict[str, np.ndarray | None] = {}

    def learn(self, new) -> None:
        new = list(new)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            units, owner = [], []
            for i, w in enumerate(part):
                letters = w if w.isalpha() else _LETTERS.sub("", w)
                for p in range(0, max(len(letters), 1), _SPAN // 2):
                    units.append(letters[p : p + _SPAN])
                    owner.append(i)
                    if p + _SPAN >= len(letters):
                        break
            self.known.update(dict.fromkeys(part))
            for u, like in zip(*self.landmarks.near(units, _FLOOR)):
                w = part[owner[u]]
                old = self.known[w]
                self.known[w] = like if old is None else np.maximum(old, like)

    def sentences(self, low: str, telling: set[str]) -> list[np.ndarray]:
        """Vectors of the sentences of a lower-cased text that hold a telling word.

        A sentence ends with its line or behind a word that ends in a stop.
        """
        out = []
        for line in low.split("\n"):
            words = line.split()
            words += _spaced(words)
            if telling.isdisjoint(words):
                continue
            hits = []
            for w in words:
                if w in telling:
                    hits.append(self.known[w])
                if w[-1] in ".!?" and hits:
                    out.append(np.maximum.reduce(hits))
                    hits = []
            if hits:
                out.append(np.maximum.reduce(hits))
        return out

    def read(self, texts: list[str]) -> list[list[np.ndarray]]:
        """The sentences of every text; most texts end at a look at their words."""
        if len(self.known) > _WORDS:
            self.known.clear()
        lows = [t.lower() for t in texts]
        words = [low.split() for low in lows]
        for w, low in zip(words, lows):
            w += [x for line in low.split("\n") for x in _spaced(line.split())] if _spaced(w) else []
        self.learn(set().union(*words).difference(self.known))
        telling = {w for w in set().union(*words) if self.known[w] is not None}
        return [self.sentences(low, telling) if not telling.isdisjoint(w) else [] for low, w in zip(lows, words)]


def _spaced(words: list[str]) -> list[str]:
    """Words written letter by letter: runs of three single letters or more."""
    ones = [i for i, w in enumerate(words) if len(w) == 1]
    out, at = [], 0
    while at + 2 < len(ones):
        stop = at
        while stop + 1 < len(ones) and ones[stop + 1] == ones[stop] + 1:
            stop += 1
        if stop - at > 1:
            out.append("".join(words[ones[at] : ones[stop] + 1]))
        at = stop + 1
    return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # on likenesses, the root of the kernel matrix folded in
    bias: float
    calibration: np.ndarray  # slope and constant

    def margins(self, sentences: list[np.ndarray]) -> tuple[float, float]:
        """The worst sentence counts, the second worst counts half."""
        best = sorted([0.0, 0.0, *(float(v @ self.weights) for v in sentences)])
        return best[-1] + best[-2] / 2 + self.bias, 1.0

    def scores(self, texts_sentences: list[list[np.ndarray]]) -> np.ndarray:
        margin = np.array([self.margins(s) for s in texts_sentences]) @ self.calibration
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _choose(texts: list[str], toxic: np.ndarray, limit: int) -> list[str]:
    """Words and beginnings of words that mark toxic texts, strongest first, without near doubles.

    Beginnings have at least four letters; words of fewer are taken whole.
    """
    seen = [Counter(), Counter()]
    for t, y in zip(texts, toxic):
        words = {_LETTERS.sub("", w) for w in t.lower().split()}
        seen[int(y)].update({w[:k] for w in words for k in range(min(len(w), _SHORT), min(len(w), 12) + 1) if k})
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)

    def gain(w):
        a, b = seen[1][w], seen[0][w]
        p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
        return a * math.log(p / q) if p > 2 * q else 0.0

    ranked = sorted(((gain(w), w) for w, n in seen[1].items() if n > 2), key=lambda x: (-x[0], -len(x[1]), x[1]))
    chosen: list[str] = []
    for g, w in ranked[: 20 * limit]:
        if g <= 0 or len(chosen) == limit:
            break
        if not chosen or Landmarks(chosen).likeness([w]).max() < 0.8:
            chosen.append(w)
    return chosen


def _gapped(words: list[str]) -> list[str]:
    """The words with one letter put in, at every inner place."""
    return [w[:i] + x + w[i:] for w in words for i, x in zip(range(2, len(w)), "xaeqo" * len(w))]


def _machine(x: np.ndarray, y: np.ndarray, each: np.ndarray, c: float = 10.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps; a row of ``x`` counts ``each`` times."""
    z = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y, 1.0, -1.0)
    cost = c * each / max((each * y).sum(), 1e-9)
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = sign * (z @ w) < 1
        za = z[active]
        new = np.linalg.solve(ridge * 0.01 + (za.T * cost[active]) @ za, za.T @ (cost * sign)[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, landmarks: int = 64, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on at most ``per_class`` labelled texts of either class, those with the smallest hashed ids.

    The sample (whole texts, some tens of MB) is fetched with one scan and trained on the driver.  The labels of
    both classes are counted over the whole table and the sample is weighted to their shares, so that a score
    means the same at every size.  Rows without label or id teach nothing; if a class is missing, every score is the share of the other (0 or 1; 0 with
    no labels at all).
    """
    label = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").dropDuplicates(["_id"])
    order = F.xxhash64("_id")
    few = [label.filter(F.col("_y") == y).orderBy(order, "_id").limit(per_class) for y in (0, 1)]
    sample = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t"))
    rows = sorted(tuple(r) for r in sample.join(F.broadcast(few[0].unionByName(few[1])), "_id").select("_id", F.coalesce("_t", F.lit("")), "_y").collect())
    texts, toxic = [r[1] for r in rows], np.array([r[2] == 1 for r in rows], bool)
    count = {r[0]: r[1] for r in label.groupBy("_y").count().collect()}
    share = [count.get(y, 0) / max(min(count.get(y, 0), per_class), 1) for y in (0, 1)]
    each = np.where(toxic, share[1], share[0])
    each = each / each.mean() if len(each) else each  # as a table of the sample's size with the whole table's shares
    words = _choose(texts, toxic, landmarks) if toxic.any() and not toxic.all() else []
    if not words:
        return Model(["a"], np.zeros(1), 0.0, np.array([0.0, 500.0 if toxic.any() and toxic.all() else -500.0]))
    base = Landmarks(words)
    values, vectors = np.linalg.eigh(base.likeness(words).astype(float))
    keep = values > 1e-6
    root = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
    reader = Reader(base)
    found = [s for at in range(0, len(texts), 200) for s in reader.read(texts[at : at + 200])]
    fitting = np.arange(len(texts)) % 5 != 0  # every fifth text is kept for the calibration
    zero = np.zeros(len(words), np.float32)
    k1, k0 = each[toxic][0], each[~toxic][0]
    negative = [v for s, y, f in zip(found, toxic, fitting) if f and not y for v in (s or [zero])]
    pure = [w for w in words if not any(w in t.lower() for t, y in zip(texts, toxic) if not y)]
    noisy = base.likeness(_gapped(pure))
    noisy = noisy[noisy.max(axis=1) >= _FLOOR]
    noisy[noisy < _FLOOR] = 0
    weights, bias = np.ones(len(words)) / len(words), 0.0
    for _ in range(4):
        positive = [max(s, key=lambda v: float(v @ weights)) for s, y, f in zip(found, toxic, fitting) if f and y and s]
        positive += list(noisy)  # a telling word stays one with a letter put in
        x = np.array([*positive, *negative, zero])
        marked = np.arange(len(x)) < len(positive)
        w, bias = _machine(x @ root, marked, np.where(marked, k1, k0))
        weights = root @ w
    model = Model(words, weights, bias, np.zeros(2))
    held = ~fitting if (toxic & ~fitting).any() and (~toxic & ~fitting).any() else fitting
    x = np.array([model.margins(s) for s, h in zip(found, held) if h])
    y, each = toxic[held].astype(float), each[held]
    n1, n0 = (each * y).sum(), (each * (1 - y)).sum()
    # Platt's targets keep the slopes finite on data that the margins separate
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ridge = np.diag([1e-2, 1e-9])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ model.calibration, -500, 500)))
        step = np.linalg.solve((x.T * (each * (p * (1 - p) + 1e-9))) @ x + ridge, x.T @ (each * (p - target)) + ridge @ model.calibration)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        model.calibration = model.calibration - step
        if np.abs(step).max() < 1e-8:
            break
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score``, from whole texts, in one pass without a shuffle.

    Null and empty texts score as texts without a telling word.  A column ``score`` of the input is replaced.
    """
    carried = [c for c in docs.columns if c != "score"]
    schema = docs.select(*[F.col(f"`{c}`") for c in carried]).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = carried.index(text_col)

    def task(batches):
        m = shared.value
        reader = kept(("toxicity", *m.landmarks), lambda: Reader(Landmarks(m.landmarks)))
        for b in batches:
            out = [m.scores(reader.read(texts)) for _, texts in tokens.text_slices(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*b.schema.names, "score"])

    out_schema = type(schema)([*schema.fields]).add("score", "double")
    return docs.select(*[F.col(f"`{c}`") for c in carried]).mapInArrow(task, out_schema)
