"""Personal data that fixed forms miss, found by the words around it.

Fixed forms give the seeds: mail addresses, network addresses, payment cards and telephone numbers.  Loose forms
give candidates, whatever could be one of these but is not written so.  The words before and after seeds and
candidates are lexical patterns.  Spark holds the graph of patterns and instances and goes round: a pattern is
scored by how much of all that stands in its place anywhere in the corpus is known, an instance by the patterns
it stands in; instances of high score become known and score patterns in turn, until nothing new is found.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut
from . import hashing as H
from . import tokens

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# --- forms -------------------------------------------------------------------------------------------------

# The forms of the seeds (of a mail address what follows the @).
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# what could be one of them
_LOOSE_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[\[(][aA][tT][\])]) ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(][dD][oO][tT][\])] ?)[A-Za-z0-9-]+)*")
_LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z_@])[+(]?[0-9](?:[ ().\-/]{0,2}[0-9])*")
_LOOSE_HEX = re.compile(r"(?<![0-9A-Za-z:])[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){4,7}(?![0-9A-Za-z:])")
_FOUR = re.compile(r"([0-9]{1,3})[ .\-_]([0-9]{1,3})[ .\-_]([0-9]{1,3})[ .\-_]([0-9]{1,3})")
_DIGIT = re.compile("[0-9]")
_ODD_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]  # twice a digit, its digits added


def _luhn(digits: str) -> bool:
    n = [int(c) for c in reversed(digits)]
    return (sum(n[::2]) + sum(_ODD_DOUBLED[d] for d in n[1::2])) % 10 == 0


def _mails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the letters before an ``@`` that no earlier match holds, and a domain behind it."""
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            past = m.end()
        elif start < at:
            past = at  # no letter before this @ can begin a match at a later one
        at = text.find("@", max(at + 1, past))
    return out


def seed_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind and start, in code points."""
    out = [(EMAIL, a, b) for a, b in _mails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((CARD, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((PHONE, *m.span()))
    return out


def loose_spans(text: str, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(kinds, start, end)`` of candidates beside the seeds, by start; ``kinds`` has a bit per possible kind."""
    low = text.lower() if "(" in text or "[" in text else ""
    mail = "@" in text or "(at)" in low or "[at]" in low
    number = bool(_DIGIT.search(text))
    if not mail and not number and ":" not in text:
        return []
    gaps, past = [], 0
    for _, a, b in sorted(seeds, key=lambda s: s[1]):
        if a > past:
            gaps.append((past, a))
        past = max(past, b)
    gaps.append((past, len(text)))
    found = []
    for a, b in gaps:
        if mail:
            found += [(1 << EMAIL, *m.span()) for m in _LOOSE_MAIL.finditer(text, a, b)]
        if text.count(":", a, b) >= 4:
            found += [(1 << IP, *m.span()) for m in _LOOSE_HEX.finditer(text, a, b)]
        for m in _LOOSE_NUMBER.finditer(text, a, b) if number else ():
            n = sum("0" <= c <= "9" for c in m[0])
            if n < 4 or n > 19 or text[m.end() : m.end() + 1].isalnum():
                continue
            four = _FOUR.fullmatch(m[0])
            kinds = (7 <= n <= 15) << PHONE | (12 <= n <= 19) << CARD | bool(four and all(int(x) <= 255 for x in four.groups())) << IP
            if kinds:
                found.append((kinds, *m.span()))
    found.sort(key=lambda x: (x[1], -x[2]))
    out, past = [], 0
    for x in found:  # of candidates that overlap the first, longest one
        if x[1] >= past:
            out.append(x)
            past = x[2]
    return out


# --- patterns ----------------------------------------------------------------------------------------------

_CLASS = np.ones(256, np.uint8)  # 0 white space, 1 letters and digits, 2 marks (a token each)
_CLASS[:128] = 2
_CLASS[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = 1
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SIZES = (2, 3)  # tokens of a pattern


class Tokens:
    """Tokens of a slice of texts and the hashes of their grams."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))
        data = np.frombuffer(b"".join(raw), np.uint8)
        kind = _CLASS[data]
        first, last = kind != 0, kind != 0
        joined = (kind[1:] == 1) & (kind[:-1] == 1)
        joined[self.offsets[1:-1][(self.offsets[1:-1] > 0) & (self.offsets[1:-1] < len(data))] - 1] = False
        first[1:] &= ~joined
        last[:-1] &= ~joined
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.sums = H.prefix_sums(H.span_hash(H.prefix_sums(H.byte_codes(_LOWER[data])), self.start, self.end))

    def grams(self, begin: np.ndarray, size: int) -> np.ndarray:
        """Even numbers that name the grams; a pattern adds 1 for the words behind."""
        return H.span_hash(self.sums, begin, begin + size).view(np.int64) & ~1

    def all_grams(self) -> np.ndarray:
        out = []
        for k in SIZES:
            at = np.arange(max(len(self.start) - k + 1, 0))
            at = at[self.row[at] == self.row[at + k - 1]] if len(at) else at
            out.append(self.grams(at, k))
        return np.concatenate(out)

    def around(self, text: int, begin: int, end: int) -> list[int]:
        """Patterns of the bytes ``[begin, end)`` of a text: the grams before them and behind them."""
        lo, hi = np.searchsorted(self.row, [text, text + 1])
        base = self.offsets[text]
        before = lo + int(np.searchsorted(self.end[lo:hi], base + begin, side="right"))
        behind = lo + int(np.searchsorted(self.start[lo:hi], base + end))
        out = [int(self.grams(np.array([before - k]), k)[0]) for k in SIZES if before - k >= lo]
        return out + [int(self.grams(np.array([behind]), k)[0]) + 1 for k in SIZES if behind + k <= hi]


def _byte_places(text: str, places: list[int]) -> dict[int, int]:
    """Code points to bytes for some places, in one walk."""
    if text.isascii():
        return dict(zip(places, places))
    out, at, n = {}, 0, 0
    for p in sorted(set(places)):
        n += len(text[at:p].encode())
        out[p], at = n, p
    return out


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.struct([("seed", pa.bool_()), ("kinds", pa.list_(pa.int32())), ("entity", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.int64()))])
_SCAN = "seeds array<struct<kind: int, start: bigint, end: bigint>>, found array<struct<seed: boolean, kinds: array<int>, entity: string, start: bigint, end: bigint, patterns: array<bigint>>>"
_KINDS_OF = [[k for k in range(4) if m >> k & 1] for m in range(16)]


def _scanned(rows: DataFrame) -> DataFrame:
    """Seeds and candidates of every text, with their patterns."""

    def task(batches):
        for b in batches:
            for first, texts in tokens.text_slices(b.column(2)):
                seeds = [seed_spans(t) for t in texts]
                all_spans = [[(1 << k, x, y, True) for k, x, y in s] + [(*c, False) for c in loose_spans(t, s)] for t, s in zip(texts, seeds)]
                some = Tokens(texts) if any(all_spans) else None
                found = []
                for i, (t, spans) in enumerate(zip(texts, all_spans)):
                    place = _byte_places(t, [p for s in spans for p in s[1:3]])
                    found.append([
                        {"seed": seed, "kinds": _KINDS_OF[m], "entity": " ".join(t[x:y].lower().split()), "start": x, "end": y, "patterns": some.around(i, place[x], place[y])}
                        for m, x, y, seed in spans
                    ])
                cols = [pa.array([[{"kind": k, "start": x, "end": y} for k, x, y in s] for s in seeds], pa.list_(_SPAN)), pa.array(found, pa.list_(_FOUND))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), *cols], names=["row", "carried", "seeds", "found"])

    kind = rows.schema["carried"].dataType.simpleString()
    return rows.mapInArrow(task, f"row bigint, carried {kind}, {_SCAN}")


_HELD = 1 << 21  # grams whose names are sent to the tasks; beyond them counts of all grams are joined


def _gram_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(gram, n)``: how often the wanted grams stand in all texts."""
    held = None
    if wanted.limit(_HELD + 1).count() <= _HELD:
        held = np.sort(np.array([r[0] for r in wanted.select("gram").collect()], np.int64))

    def task(batches):
        for b in batches:
            for _, part in tokens.text_slices(b.column(0), 1 << 19):
                g = Tokens(part).all_grams()
                if held is not None:
                    g = g[held[np.minimum(np.searchsorted(held, g), len(held) - 1)] == g] if len(held) else g[:0]
                if len(g):
                    gram, n = np.unique(g, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], names=["gram", "n"])

    counts = texts.mapInArrow(task, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return counts if held is not None else counts.join(wanted, "gram", "left_semi")


# --- rounds ------------------------------------------------------------------------------------------------


def pattern_scores(edges: DataFrame, known: DataFrame, places: DataFrame) -> DataFrame:
    """``(kind, pattern, score, support)`` of the patterns that known instances stand in.

    The score is the share of known instances in all places that tell: places where a candidate stands that is
    not known yet tell nothing, every other place of the words anywhere tells against the pattern.  One place
    against it is added to all.  ``support`` counts different known instances.
    """
    hits = edges.join(known, ["kind", "entity"]).groupBy("kind", "pattern").agg(F.sum("n").alias("_p"), F.count(F.lit(1)).alias("support"))
    against = F.greatest(F.col("places") - F.col("candidates"), F.lit(0))
    return hits.join(places, ["kind", "pattern"]).select("kind", "pattern", (F.col("_p") / (F.col("_p") + against + 1)).alias("score"), "support")


def instance_scores(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(kind, entity, score)``: one minus the chance that every pattern of the instance errs."""
    e = edges.join(patterns.select("kind", "pattern", "score"), ["kind", "pattern"])
    return e.groupBy("kind", "entity").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("score"))


def discovered(scanned: DataFrame, texts: DataFrame, support: int, pattern_score: float, instance_score: float, max_rounds: int) -> DataFrame | None:
    """``(kind, entity, score)`` of instances that are no seeds; None where no pattern leads beyond the seeds."""
    one = scanned.select(F.explode("found").alias("f")).select("f.seed", "f.entity", F.explode("f.kinds").alias("kind"), "f.patterns")
    edges = cut(one.select("seed", "entity", "kind", F.explode("patterns").alias("pattern")).groupBy("kind", "entity", "pattern").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    # only patterns that hold enough instances, some of them unknown, can add anything
    useful = edges.groupBy("kind", "pattern").agg(F.sum("n").alias("candidates"), F.count(F.lit(1)).alias("_e"), F.min("seed").alias("_s")).filter((F.col("_e") > support) & ~F.col("_s"))
    useful = cut(useful.select("kind", "pattern", "candidates", F.col("pattern").bitwiseAND(F.lit(-2).cast("long")).alias("gram")))
    if useful.isEmpty():
        return None
    counts = _gram_counts(texts, useful.select("gram").distinct())
    places = cut(useful.join(counts, "gram").select("kind", "pattern", "candidates", F.col("n").alias("places")))
    edges = cut(edges.join(useful.select("kind", "pattern"), ["kind", "pattern"], "left_semi"))
    known = cut(edges.filter("seed").select("kind", "entity").distinct().withColumn("score", F.lit(1.0)))
    new = None
    for _ in range(max_rounds):
        patterns = cut(pattern_scores(edges, known.select("kind", "entity"), places).filter((F.col("score") >= pattern_score) & (F.col("support") >= support)))
        open_edges = edges.join(known.select("entity"), "entity", "left_anti")
        scored = instance_scores(open_edges, patterns).filter(F.col("score") >= instance_score)
        # a candidate of two kinds becomes the one of higher score, ties: the first listed
        best = F.max_by(F.struct("kind", "score"), F.struct(F.col("score"), -F.col("kind"))).alias("b")
        more = cut(scored.groupBy("entity").agg(best).select("b.kind", "entity", "b.score"))
        if more.isEmpty():
            return new
        new = more if new is None else new.unionByName(more)
        known = cut(known.unionByName(more))
    raise RuntimeError(f"identifiers are still found after {max_rounds} rounds")


def personal_data(
    docs: DataFrame, support: int = 3, pattern_score: float = 0.5, instance_score: float = 0.8, max_rounds: int = 50, text_col: str = "text", spread: int = 16
) -> DataFrame:
    """All columns but the text, with ``seeds`` and ``spans``: arrays of ``(kind, start, end)`` and, for spans, ``score``.

    Places are code points, the end exclusive; both lists are sorted by kind (as in ``KINDS``), then start.
    ``seeds`` are the fixed forms; ``spans`` are the seeds (score 1) and what was discovered.  A pattern is the two or
    three tokens before or behind; it counts from ``support`` different known instances and a share of
    ``pattern_score`` on.  Equal texts of instances (apart from case and width of blanks) are one instance.

    Null and empty texts have no spans; repeated rows each have their spans (and count as often as they stand);
    an empty table gives an empty one; long texts are taken whole.  Other columns pass through unread; those
    named like a result column are replaced by it.  Instances and patterns that a great part of all texts hold are
    counts in the graph; where spans are handed back to texts an instance is dealt over ``spread`` keys.
    """
    kept = [c for c in docs.columns if c not in ("seeds", "spans", text_col)]
    carried = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("_none"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    scanned = cut(_scanned(docs.select(F.monotonically_increasing_id().alias("row"), carried.alias("carried"), text.alias("text"))))
    seeds = F.array_sort("seeds")
    more = discovered(scanned, docs.select(text.alias("text")), support, pattern_score, instance_score, max_rounds)
    spans = F.transform("seeds", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(1.0).alias("score")))
    if more is not None:
        where = scanned.select("row", F.explode("found").alias("f")).filter("not f.seed").select(
            "row", "f.entity", "f.start", "f.end", F.pmod("row", F.lit(spread)).cast("int").alias("_s"))
        dealt = more.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        hit = where.join(dealt, ["entity", "_s"]).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "score")).alias("_more"))
        scanned = scanned.join(hit, "row", "left")
        spans = F.concat(spans, F.coalesce("_more", F.array().cast("array<struct<kind: int, start: bigint, end: bigint, score: double>>")))
    names = F.array(*[F.lit(k) for k in KINDS])

    def named(s, *more_fields):
        return F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *[s[f].alias(f) for f in more_fields])

    return scanned.select(
        *[F.col(f"carried.`{c}`").alias(c) for c in kept], F.transform(seeds, lambda s: named(s)).alias("seeds"), F.transform(F.array_sort(spans), lambda s: named(s, "score")).alias("spans")
    )
