"""Language by multinomial logistic regression on TF-IDF weighted letter n-grams.

The regression is trained with follow-the-regularised-leader: weights come from sums of gradients, the
absolute penalty keeps most of them at zero, the square one bounds the rest.  A temperature, fitted on texts
the training left out, turns its scores into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tokens

BUCKETS = 1 << 14
_MULTIPLIERS = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_plain = np.array([chr(c).isalpha() for c in range(0x3000)])


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text between blanks; what is no letter is a blank, and runs of blanks one."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.minimum(raw, 0x2FFF)
    other = raw >= 0x3000
    letter = _plain[inside]
    if other.any():
        letter = letter.copy()
        letter[other] = [chr(c).isalpha() for c in raw[other].tolist()]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first blank after a letter
    return np.where(letter, raw, np.uint32(32))[keep]


def counts(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """``(bucket, count)`` of the n-grams of one to three letters, and whether there is a letter at all."""
    raw = _letters(text)
    if len(raw) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    h, grams = np.zeros(len(raw), np.uint32), []
    for n, m in enumerate(_MULTIPLIERS):
        h = (h[: len(raw) - n] ^ raw[n:]) * m
        grams.append((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(18))
        if n + 1 < len(_MULTIPLIERS):
            h = h[:-1] if len(h) else h
    n = np.bincount(np.concatenate(grams), minlength=BUCKETS)
    bucket = np.flatnonzero(n)
    return bucket, n[bucket], True


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (languages, buckets), TF-IDF scale
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def vector(self, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1 + np.log(n)) * self.idf[bucket]
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def probabilities(self, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _softmax((self.weights[:, bucket] @ self.vector(bucket, n) + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _frequencies(rows: DataFrame) -> DataFrame:
    """``(bucket, docs)``: in how many texts a bucket occurs; bucket -1 counts the texts."""

    def task(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for _, texts in tokens.text_slices(b.column(0)):
                for t in texts:
                    total[counts(t)[0]] += 1
                n += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "docs"])

    return rows.select("text").mapInArrow(task, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs"))


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], n_languages: int, l1: float = 1e-3, l2: float = 1e-3, alpha: float = 2.0, beta: float = 1.0, epochs: int = 3):
    """Follow the regularised leader over ``(language, bucket, value)``; returns ``(weights, bias)``."""
    z = np.zeros((n_languages, BUCKETS + 1))
    n = np.zeros_like(z)

    def current(at):
        za, na = z[:, at], n[:, at]
        w = -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2)
        return np.where(np.abs(za) <= l1, 0.0, w)

    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            y, bucket, value = samples[i]
            at, x = np.append(bucket, BUCKETS), np.append(value, 1.0)
            w = current(at)
            p = _softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / alpha
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    w = current(np.arange(BUCKETS + 1))
    return w[:, :-1], w[:, -1]


def _temperature(logits: list[np.ndarray], y: list[int]) -> float:
    """The temperature of least loss, by golden section on its logarithm.

    One text in ``n + 2`` counts as of another language, which keeps it above zero when none was mistaken.
    """
    miss = 1 / (len(y) + 2)

    def loss(t):
        total = 0.0
        for z, k in zip(logits, y):
            p = np.log(np.maximum(_softmax(z / np.exp(t)), 1e-300))
            total -= (1 - miss) * p[k] + miss * (p.sum() - p[k]) / max(len(p) - 1, 1)
        return total

    a, b, r = -4.0, 2.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, per_language: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **rates) -> Model:
    """Learn the values of ``lang`` from the given rows; rows without language teach nothing.

    Document frequencies come from all rows.  The regression is trained on the driver on at most
    ``per_language`` texts of a language (about; those with the smallest hashed ids), as counts of n-grams.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0), np.ones(BUCKETS), 1.0)
    found = {r[0]: r[1] for r in _frequencies(rows).collect()}  # as many rows as buckets
    total = found.pop(-1, 0)
    idf = np.full(BUCKETS, np.log(1 + total) + 1)
    idf[list(found)] = np.log((1 + total) / (1 + np.array(list(found.values())))) + 1
    share = F.lit(1.0)
    for lang in languages:  # a known share of every language, decided by the id alone
        share = F.when(F.col("lang") == lang, F.lit(per_language / sizes[lang])).otherwise(share)
    place = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)

    def task(batches):
        for b in batches:
            for first, texts in tokens.text_slices(b.column(1)):
                got = [counts(t) for t in texts]
                cols = [b.column(0).slice(first, len(texts)), b.column(2).slice(first, len(texts)), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "lang", "bucket", "n"])

    chosen = rows.filter(place < share).mapInArrow(task, "id string, lang string, bucket array<long>, n array<long>")
    sample = sorted(((r.id or "", r.lang, np.array(r.bucket, np.int64), np.array(r.n, np.int64)) for r in chosen.collect()), key=lambda r: r[:2])
    model = Model(languages, np.zeros((len(languages), BUCKETS)), np.zeros(len(languages)), idf, 1.0)
    ready = [(languages.index(lang), bucket, model.vector(bucket, n)) for _, lang, bucket, n in sample if len(bucket)]
    kept = ready[::5]  # for the temperature
    model.weights, model.bias = train([s for i, s in enumerate(ready) if i % 5], len(languages), **rates)
    if kept:
        model.temperature = _temperature([model.weights[:, b] @ v + model.bias for _, b, v in kept], [y for y, _, _ in kept])
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (its probability), in one pass without a shuffle.

    Null texts, texts without a letter, and all texts if no language was learned, get ``und`` and 0.
    Columns of these names in the input are replaced.
    """
    carried = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in carried])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = carried.index(text_col)

    def task(batches):
        m = shared.value
        for b in batches:
            lang, score = [], []
            for _, texts in tokens.text_slices(b.column(at)):
                for t in texts:
                    bucket, n, any_letter = counts(t)
                    if any_letter and m.languages:
                        p = m.probabilities(bucket, n)
                        k = int(p.argmax())
                        lang.append(m.languages[k])
                        score.append(float(p[k]))
                    else:
                        lang.append("und")
                        score.append(0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    schema = StructType([*rows.schema.fields]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(task, schema)
