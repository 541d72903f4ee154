"""Periodic runs of words, by recursive frequency splitting and a scan over lags.

A run holds every word of its period at least twice.  A word that occurs once in a segment can therefore be
in no run of that segment: it splits the segment, in the parts other words are rare in turn, and so on until
nothing splits any more.  Ordinary text is gone by then.  What is left is scanned lag by lag: a run of period
``q`` is a stretch of places that equal the place ``q`` later.  Such a stretch is at least ``q`` long, so for
long lags every ``q``-th place is looked at, and all lags of a segment of ``n`` words cost ``n log n`` looks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import text_slices

LEAST = 12  # words of the shortest run
_FULL = 32  # lags up to here are compared at every place
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string, n_words bigint"
_ARROW = [pa.list_(_RUN), pa.string(), pa.int64()]


def split_by_frequency(codes: np.ndarray, owner: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """``(begin, end)`` of the segments in which every word occurs twice or more.

    ``codes`` are the words of many texts one after the other, ``owner`` the text of each.
    """
    done: list[tuple[int, int]] = []
    at = np.arange(len(codes))
    segment = np.asarray(owner)
    while len(at):
        # segments of the words that are left: neighbours that stand together in one old segment
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])))
        segment = np.cumsum(new) - 1
        long = (np.bincount(segment) >= least)[segment]
        at, segment = at[long], segment[long]
        if not len(at):
            break
        order = np.lexsort((codes[at], segment))
        c, s = codes[at][order], segment[order]
        first = np.concatenate(([True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])))
        group = np.cumsum(first) - 1
        rare = np.empty(len(at), bool)
        rare[order] = (np.bincount(group) < 2)[group]
        split = np.bincount(segment, weights=rare) > 0
        whole = np.flatnonzero(np.bincount(segment) * ~split)
        begin = np.searchsorted(segment, whole)
        end = np.searchsorted(segment, whole, side="right")
        done += zip(at[begin].tolist(), (at[end - 1] + 1).tolist())
        keep = split[segment] & ~rare
        at, segment = at[keep], segment[keep]
    return sorted(done)


def _reach(s: np.ndarray, x: int, q: int) -> tuple[int, int]:
    """The stretch ``[a, b)`` around ``x`` of places that equal the place ``q`` later."""
    n = len(s) - q
    b, step = x + 1, 64
    while b < n:
        part = s[b : min(b + step, n)] != s[b + q : min(b + step, n) + q]
        if part.any():
            b += int(part.argmax())
            break
        b, step = min(b + step, n), step * 2
    a, step = x, 64
    while a > 0:
        low = max(a - step, 0)
        part = s[low:a] != s[low + q : a + q]
        if part.any():
            a = a - int(part[::-1].argmax())
            break
        a, step = low, step * 2
    return a, b


def scan_lags(s: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a segment.

    Lags go up, so a stretch is met at its smallest period first; multiples of it give the same stretch.
    """
    n = len(s)
    found: dict[tuple[int, int], int] = {}
    cover_end, cover_period = np.zeros(n, np.int64), np.ones(n, np.int64)  # the last run found over each place

    def add(a: int, b: int, q: int):
        if found.setdefault((a, b), q) == q:
            cover_end[a:b], cover_period[a:b] = b, q

    for q in range(1, n // 2 + 1):
        if q <= _FULL:
            same = np.concatenate(([False], s[:-q] == s[q:], [False]))
            edge = np.flatnonzero(same[1:] != same[:-1])
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= max(q, least - q):
                    add(a, b + q, q)
            continue
        looks = s[::q]
        hits = np.flatnonzero(looks[:-1] == looks[1:]) * q
        if not len(hits):
            continue
        # inside a run whose period divides the lag there is only that run again
        hits = hits[~((cover_end[hits] > hits + q) & (q % cover_period[hits] == 0))]
        if not len(hits):
            continue
        # a stretch of q places around x reaches half of q to one side of x at least
        right, left = np.ones(len(hits), bool), np.ones(len(hits), bool)
        for k in (1, 2, 3, 5, 8, 13):
            r, l = np.minimum(hits + k, n - q - 1), np.maximum(hits - k, 0)
            right &= (s[r] == s[r + q]) & (hits + k < n - q)
            left &= (s[l] == s[l + q]) & (hits - k >= 0)
        past = 0
        for x in hits[right | left].tolist():
            if x < past:
                continue
            a, past = _reach(s, x, q)
            if past - a >= max(q, least - q):
                add(a, past + q, q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of every text, given as lists of words, by start and period."""
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64)
    size = np.array([len(words) for words in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for begin, end in split_by_frequency(codes, np.repeat(np.arange(len(texts)), size), least):
        text = int(np.searchsorted(first, begin, side="right")) - 1
        shift = begin - int(first[text])
        out[text] += [(a + shift, n, q) for a, n, q in scan_lags(codes[begin:end], least)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a blank, less those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """All columns but the text, with ``runs``, ``collapsed`` and ``n_words``.

    Words are runs of characters other than ASCII white space, told apart by case.  A run is a stretch of
    at least ``least`` words and two periods that repeats with its smallest period and that no neighbouring
    word extends; ``collapsed`` keeps the first period of every run and everything outside runs, joined by
    one blank.  ``runs`` is sorted by start, then period.

    Null and empty texts have no words, no runs and an empty ``collapsed``; repeated rows each have their
    result; an empty table gives an empty one.  Texts of any length are taken whole, one text in one task: a
    segment without repetition is gone after splitting, one of n words costs n log n looks.  Other columns
    pass through unread; those named like a result column are replaced by it.
    """
    new = ("runs", "collapsed", "n_words")
    kept = [c for c in docs.columns if c not in (*new, text_col)]
    carried = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("_none"))
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), carried.alias("carried"))

    def task(batches):
        for b in batches:
            for first, texts in text_slices(b.column(0)):
                words = [t.encode().split() for t in texts]
                runs = runs_of(words, least)
                cols = [
                    pa.array([[{"start": a, "length": n, "period": q} for a, n, q in r] for r in runs], _ARROW[0]),
                    pa.array([collapse(w, r).decode() for w, r in zip(words, runs)], _ARROW[1]), pa.array([len(w) for w in words], _ARROW[2]),
                ]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(first, len(texts)), *cols], names=["carried", *new])

    kind = rows.schema["carried"].dataType.simpleString()
    out = rows.mapInArrow(task, f"carried {kind}, {SCHEMA}")
    return out.select(*[F.col(f"carried.`{c}`").alias(c) for c in kept], *new)
