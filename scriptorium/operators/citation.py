"""Citation graphs ``(citing, cited)``: building, degrees, main path, disruption."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bigcount as B
from ..functions.lists import as_items, explode_entities
from ..functions.scratch import cut, discard, placed
from .graph import largest_component, triangles


def short_id(c: Column) -> Column:
    """The ``W123`` tail of an id, or the id itself."""
    tail = F.regexp_extract(F.trim(c.cast("string")), r"(W\d+)$", 1)
    return F.when(tail != "", tail).otherwise(F.trim(c.cast("string")))


def reference_links(works: DataFrame, refs: str = "references") -> DataFrame:
    """``(citing, cited)`` of every reference, repeats kept."""
    return works.select(short_id(F.col("doc_id")).alias("citing"), F.explode(as_items(works, refs)).alias("_r")).select(
        "citing", short_id(F.col("_r")).alias("cited")
    )


def citation_graph(works: DataFrame, refs: str = "references", largest: bool = True) -> DataFrame:
    """Distinct links inside the collection without self citations; optionally the largest weak component."""
    ids = works.select(short_id(F.col("doc_id")).alias("cited")).distinct()
    links = reference_links(works, refs).filter("citing <> cited").join(ids, "cited", "left_semi").dropDuplicates(["citing", "cited"])
    links = links.select("citing", "cited")
    if not largest:
        return links
    links = cut(links)  # the rounds and the last join read them
    inside = largest_component(links.select(F.col("citing").alias("src"), F.col("cited").alias("dst")))
    return inside.select(F.col("src").alias("citing"), F.col("dst").alias("cited"))


def match_statistics(works: DataFrame, refs: str = "references") -> DataFrame:
    """One row: documents, references, internal ones (before removing repeats), distinct edges, match rate."""
    ids = works.select(short_id(F.col("doc_id")).alias("cited")).distinct().withColumn("_in", F.lit(1))
    links = reference_links(works, refs).groupBy("citing", "cited").agg(F.count(F.lit(1)).alias("n"))
    other = F.col("citing") != F.col("cited")
    # summed before the join: a work that everybody cites comes to it as one row
    per = links.groupBy("cited").agg(F.sum("n").alias("n"), F.sum(F.when(other, F.col("n"))).alias("others"), F.count_if(other).alias("pairs"))
    inner = F.col("_in").isNotNull()
    row = per.join(ids, "cited", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_references"),
        F.coalesce(F.sum(F.when(inner, F.col("others"))), F.lit(0)).alias("internal_references"), F.coalesce(F.sum(F.when(inner, F.col("pairs"))), F.lit(0)).alias("edges"),
    )
    docs = works.agg(F.count(F.lit(1))).scalar()
    rate = F.when(F.col("total_references") > 0, F.col("internal_references") / F.col("total_references")).otherwise(0.0)
    return row.withColumn("documents", docs).select("documents", "total_references", "internal_references", "edges", rate.alias("match_rate"))


# --- matching references to titles ------------------------------------------------------------------


def normalise(c: Column) -> Column:
    """Lower case, punctuation to single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def title_guess(ref: Column) -> Column:
    """The first comma part after the author that is long enough and neither a year, a page nor a number."""
    parts = F.transform(F.split(ref, ","), lambda x: F.trim(x))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    fit = F.filter(rest, lambda x: (F.length(x) >= 10) & ~x.rlike(r"^\d+$") & ~x.rlike(r"^pp?\.\s*\d+") & ~x.rlike(r"^\(\d{4}\)$"))
    return F.get(fit, F.lit(0))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer step per letter of ``b``."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        m = masks.get(ch, 0) & s
        s = ((s + m) | (s - m)) & full
    return len(a) - bin(s).count("1")


def _ratio(a: str, b: str) -> int:
    return round(200 * _common(a, b) / (len(a) + len(b))) if a and b else 0


def token_set_score(a: str, b: str) -> int:
    """0..100: best ratio among the shared words and each side's words."""
    x, y = set(a.split()), set(b.split())
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    one, two = (both + " " + left).strip(), (both + " " + right).strip()
    if not one or not two:
        return 0
    # the shared words stand first in both: they belong to the longest common subsequence of any two of the three
    shared, sizes = len(both), len(one) + len(two)
    alone = round(200 * shared / (shared + min(len(one), len(two))))
    rest = _common(one[shared:], two[shared:])
    return max(alone, round(200 * (shared + rest) / sizes))


@F.pandas_udf(T.IntegerType())
def score_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(x, y) for x, y in zip(a, b)], dtype="int32")


def _frequent(counts: DataFrame) -> DataFrame:
    """Keys with more than a 10,000th of all counts: fewer than 10,000, whatever the table."""
    return counts.filter(F.col("_f") * 10_000 > (counts.agg(F.sum("_f")).first()[0] or 0))


def _counted(rows: DataFrame, counts: DataFrame, key: str, row: str) -> DataFrame:
    """``rows`` with the ``_f`` of their ``key`` in ``counts``, 0 if it is not there.

    The frequent keys are broadcast; their rows are dealt by ``row`` meanwhile, so that a word of every title is not
    one task.
    """
    hot = _frequent(counts).select(key, F.col("_f").alias("_hot"))
    dealt = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("\n"), F.col(row)))
    out = rows.join(F.broadcast(hot), key, "left").withColumn("_dealt", dealt).join(counts.withColumnRenamed(key, "_dealt"), "_dealt", "left")
    return out.withColumn("_f", F.coalesce("_hot", "_f", F.lit(0))).drop("_hot", "_dealt")


def _rarest_first(words: DataFrame, row: str) -> DataFrame:
    """``(row, _l)``: the words ``(row, word, _f)`` of every row as an array of ``(f, w)``."""
    return words.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col("_f").alias("f"), F.col("word").alias("w")))).alias("_l"))


def _distinctive(listed: DataFrame, row: str, share: float) -> DataFrame:
    """Explodes the rarest words of each text that together exceed ``1 - share`` of its letters.

    A text that has at least ``share`` of the letters of this one in common with it must share one of them.
    """
    def letters(words: Column | str) -> Column:  # every word with the space after it
        return F.aggregate(words, F.lit(0), lambda acc, x: acc + F.length(x["w"]) + 1)

    first = F.filter("_l", lambda x, i: letters(F.slice("_l", F.lit(1), i)) <= (1 - share) * letters("_l"))
    return listed.select(row, F.explode(first).alias("x")).select(row, F.col("x.w").alias("word"), F.col("x.f").alias("_f"))


def _joined(words: Column) -> Column:
    """Letters of some words joined by blanks."""
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.length(w)) + F.greatest(F.size(words) - 1, F.lit(0))


class _Grams:
    """Letter groups that two texts must have in common to reach a score letter by letter.

    A score compares texts whose words are ordered in some way.  With a blank before and behind every word, the
    pairs of neighbouring letters are the same in any order.  If two texts of ``m`` and ``n`` letters (blanks at
    both ends not counted) have a common subsequence of ``l``, a letter outside it spoils two pairs of its own text
    and one of the other at most, so ``3 (l + 2) - (m + n + 4) - 1`` pairs are common; a score of ``t`` needs
    ``l >= t (m + n) / 2``, and no more than ``(2 - t) / t`` times the letters of the other text.  Up to two thirds
    that says nothing, and single letters (``l + 2`` in common) take the place of pairs.
    """

    PIECES = 0.75

    def __init__(self, t: float):
        self.t, self.size = t, 2 if 1.5 * t > 1.01 else 1
        self.wide = (2 - t) / t * 1.0001

    def listed(self, text: Column) -> Column:
        """The groups of a text as an array; equal ones are numbered."""
        padded = F.array(F.concat(F.lit(" "), F.array_join(F.array_distinct(F.split(text, " ")), " "), F.lit(" ")))
        groups = F.transform(padded, lambda p: F.array_sort(F.transform(F.sequence(F.lit(1), F.length(p) - (self.size - 1)), lambda i: p.substr(i, F.lit(self.size)))))
        return F.transform(groups, lambda g: F.transform(g, lambda x, i: F.concat(x, (i - F.array_position(g, x)).cast("string"))))[0]

    def needed(self, letters: Column) -> Column:
        """Groups in common with any text that reaches the score, at least."""
        both = letters * (2 / (2 - self.t))
        return F.ceil(both * (1.5 * self.t - 1) + 1 - 1e-6) if self.size == 2 else F.ceil(both * (self.t / 2) + 2 - 1e-6)

    def longest(self, common: Column, m: Column, n: Column) -> Column:
        """The longest common subsequence that so many common groups allow."""
        most = F.floor((common + m + n + 5) / 3) - 2 if self.size == 2 else common - 2
        return F.greatest(F.least(most, m, n), F.lit(0))

    def keys(self, texts: DataFrame, freq: DataFrame, name: str) -> DataFrame:
        """``(name, m, token)``: the rarest groups of every text, as many as cannot all be missed."""
        rows = texts.select(name, F.explode(self.listed(F.col("text"))).alias("token"))
        listed = rows.join(freq, "token", "left").groupBy(name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("token").alias("token")))).alias("_l"))
        m = F.size("_l") - (1 if self.size == 2 else 2)
        listed = listed.select(name, m.alias("m"), "_l")
        prefix = F.greatest(F.size("_l") - self.needed(F.col("m")) + 1, F.lit(1)).cast("int")
        return listed.select(name, "m", F.explode(F.slice("_l", F.lit(1), prefix)).alias("_k")).select(name, "m", F.col("_k.token").alias("token"))

    def candidates(self, texts: DataFrame, names: DataFrame) -> DataFrame:
        """Distinct ``(tid, nid)`` of ``texts (tid, text)`` and ``names (nid, text)`` that may reach the score.

        From three quarters on by pieces with at most one change (``_Pieces``), which are far rarer than pairs of
        letters; below that by the rarest groups.  Then lengths are part of the key: texts whose lengths allow the
        score lie in neighbouring classes.
        """
        if self.t >= self.PIECES:
            return _Pieces(self.t).candidates(texts, names)
        freq = names.select(F.explode(self.listed(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("_f"))
        place = F.floor(F.log(F.greatest(F.col("m"), F.lit(1))) / math.log(self.wide)).cast("int")
        left = self.keys(texts, freq, "tid").withColumn("_b", place)
        right = self.keys(names, freq, "nid").withColumn("_b", F.explode(F.array(place - 1, place, place + 1))).withColumnRenamed("m", "n")
        fits = (F.col("m") <= F.col("n") * self.wide) & (F.col("n") <= F.col("m") * self.wide)
        return left.join(right, ["token", "_b"]).filter(fits).select("tid", "nid").distinct()

    def bound(self, a: Column, b: Column, groups_a: Column | None = None, groups_b: Column | None = None) -> Column:
        """What the score of two texts cannot exceed, from shared words and common groups (given, if they are known)."""
        x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
        m, n, s = _joined(x), _joined(y), _joined(F.array_intersect(x, y))
        common = F.size(F.array_intersect(self.listed(a) if groups_a is None else groups_a, self.listed(b) if groups_b is None else groups_b))
        return F.greatest(200 * s / (s + F.least(m, n)), 200 * self.longest(common, m, n) / (m + n))


class _Pieces:
    """Pieces of words, one of which two texts that reach a score letter by letter share but for one letter.

    Texts of ``m`` and ``n`` letters that reach ``t`` differ by at most ``d = (1 - t) (m + n)`` letters dropped or
    put in (``m + n - d`` is even).  Of ``d // 2 + 1`` disjoint pieces of the words of one text, at least one has no
    more than one of these changes, in any order of the words: the other text holds the piece, or the piece less a
    letter, or the piece with one letter more, which may be a blank.  A piece may hold the blank before its word, or
    all pieces come from one word and may also hold the blank behind it (pieces of two words could share that
    blank).  The rarest pieces are taken, of the length that makes their number smallest.

    Pairs that meet in a piece are many, so they carry a signature: one bit of 29 for the parity of letters, one of
    35 for the parity of neighbouring letters.  A change turns one bit of the former and three of the latter at most.
    """

    LETTERS, NEIGHBOURS = 29, 35

    def __init__(self, t: float, longest: int = 8):
        self.t, self.longest = t, longest

    def most(self, m: Column, n: Column) -> Column:
        """Changes between texts of ``m`` and ``n`` letters, at most; negative if no texts of such lengths reach the score."""
        most = F.floor((1 - self.t) * (m + n) + 1e-6)
        return most - (most + m + n) % 2

    def pieces(self, m: Column, n: Column) -> Column:
        """Pieces needed for texts of ``m`` and ``n`` letters; null if no texts of such lengths reach the score."""
        return F.when(self.most(m, n) >= 0, F.call_function("div", self.most(m, n), F.lit(2).cast("bigint")) + 1)

    def signature(self, words: Column) -> Column:
        """Of words with a blank before and behind them, in any order."""
        one = F.lit(1).cast("bigint")

        def turned(sig: Column, p: Column, i: Column) -> Column:
            letter = F.ascii(p.substr(i, F.lit(1))) % self.LETTERS
            pair = F.pmod(F.hash(p.substr(i, F.lit(2))), F.lit(self.NEIGHBOURS)) + self.LETTERS
            return sig.bitwiseXOR(F.call_function("shiftleft", one, letter)).bitwiseXOR(F.call_function("shiftleft", one, pair))

        return F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, p: F.aggregate(F.sequence(F.lit(1), F.length(p) - 1), acc, lambda sig, i: turned(sig, p, i)))

    def near(self, m: Column, n: Column, a: Column, b: Column) -> Column:
        """Whether the signatures ``a`` and ``b`` allow the score."""
        letters, turned = F.lit((1 << self.LETTERS) - 1), a.bitwiseXOR(b)
        return (F.bit_count(turned.bitwiseAND(letters)) <= self.most(m, n)) & (F.bit_count(turned.bitwiseAND(F.bitwise_not(letters))) <= 3 * self.most(m, n))

    @staticmethod
    def _kind(p: Column) -> Column:
        """1, 2, 4, 8: a blank at neither end, before, behind, at both."""
        return F.when(p.startswith(" "), F.when(p.endswith(" "), 8).otherwise(2)).otherwise(F.when(p.endswith(" "), 4).otherwise(1))

    @staticmethod
    def _key(kind: int, k: Column, q: Column, chars: Column) -> Column:
        return F.xxhash64(F.lit(kind), k.cast("int"), q.cast("int"), chars)

    @staticmethod
    def _cut(words: Column, size: Column, step: Column) -> Column:
        """The parts of ``size`` letters of every word that begin at every ``step``-th letter."""
        def of(p: Column) -> Column:
            last = F.length(p) - size
            return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, step), lambda i: p.substr(i + 1, size))).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(words, of))

    def cuts(self, names: DataFrame) -> DataFrame:
        """``(nid, k, one, q, p)``: pieces of the rarest word alone (``one``) and of all words, of a few lengths that give enough.

        The lengths are the largest ones at which the rarest word, the two, four, ... rarest words and all words
        give ``k`` pieces.
        """
        k, sizes, n = F.col("k"), F.sequence(F.lit(1), F.lit(self.longest)), F.size("words")

        def enough(words: Column) -> Column:  # the largest length, null if there is none
            return F.array_max(F.filter(sizes, lambda q: F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, w: acc + F.call_function("div", F.length(w) - 1, q)) >= k))

        first = F.least(F.call_function("div", F.length("rare"), k).cast("int"), F.lit(self.longest))
        several = F.transform(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda i: F.pow(F.lit(2), i) < n), lambda i: enough(F.slice("words", F.lit(1), F.pow(F.lit(2), i).cast("int"))))
        d = names.withColumns({"_one": first, "_all": enough(F.col("words"))})
        lengths = F.array_distinct(F.concat(F.filter(several, lambda q: q > F.col("_one")), F.array("_all")))
        ways = F.concat(
            F.transform(F.filter(F.array("_one"), lambda q: q > 0), lambda q: F.struct(F.lit(True).alias("one"), q.alias("q"))),
            F.transform(F.filter(lengths, lambda q: q.isNotNull()), lambda q: F.struct(F.lit(False).alias("one"), q.alias("q"))),
        )
        d = d.select("nid", "k", "words", "rare", F.explode(ways).alias("w")).select("nid", "k", "words", "rare", "w.*")
        # a blank before each of several words, before and behind the only one
        p = F.when(F.col("one"), self._cut(F.array("rare"), F.col("q"), F.col("q"))).otherwise(self._cut(F.transform("words", lambda w: F.rtrim(w)), F.col("q"), F.col("q")))
        return d.select("nid", "k", "one", "q", F.explode(p).alias("p"))

    def title_keys(self, names: DataFrame, shapes: DataFrame) -> DataFrame:
        """``(nid, m, sig, k, q, l)``: the pieces of titles ``(nid, m, words)``, whose words stand from the rarest on."""
        rare = F.element_at(F.array_sort(F.transform("words", lambda w, i: F.struct(F.get("_f", i).alias("f"), (-F.length(w)).alias("s"), w.alias("w")))), 1)["w"]
        fit = names.join(F.broadcast(shapes.select("m", "k").distinct()), "m").withColumn("rare", rare)
        rows = cut(self.cuts(fit))
        counts = cut(rows.groupBy("p").agg(F.count(F.lit(1)).alias("_f")))
        counted = _counted(rows, counts, "p", "nid").repartition("nid")
        ways = counted.groupBy("nid", "k", "one", "q").agg(F.array_sort(F.collect_list(F.struct("_f", "p"))).alias("l")).filter(F.size("l") >= F.col("k"))
        ways = ways.withColumn("l", F.slice("l", F.lit(1), F.col("k").cast("int")))
        cost = F.aggregate("l", F.lit(0).cast("bigint"), lambda acc, x: acc + x["_f"])
        best = ways.groupBy("nid", "k").agg(F.min_by(F.struct("q", F.transform("l", lambda x: x["p"]).alias("l")), F.struct(cost, -F.col("q"), ~F.col("one"))).alias("b")).select("nid", "k", "b.*")
        out = cut(best.join(names.select("nid", "m", self.signature(F.col("words")).alias("sig")), "nid"))
        discard(rows, counts)
        return out

    def _less(self, p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(p)), lambda i: F.concat(p.substr(F.lit(1), i - 1), p.substr(i + 1, F.length(p))))

    def text_keys(self, texts: DataFrame, used: DataFrame) -> DataFrame:
        """``(tid, n, sig, k, key)``: all parts of the words that a piece may have become, of the kinds that are asked for."""
        q, one, none = F.col("q"), F.lit(1), F.array().cast("array<string>")

        def asked(parts: Column, kinds: str) -> Column:
            return F.filter(parts, lambda x: F.col(kinds).bitwiseAND(self._kind(x)) != 0)

        def less(z: Column) -> Column:  # a letter inside was put in
            return F.transform(F.sequence(F.lit(2), F.length(z) - 1), lambda i: F.concat(z.substr(one, i - 1), z.substr(i + 1, F.length(z))))

        whole = asked(self._cut(F.col("words"), q, one), "whole")
        longer = F.when(q > 1, F.flatten(F.transform(asked(self._cut(F.col("words"), q + 1, one), "whole"), less))).otherwise(none)
        # a blank was put in: the end of a word and the head of another one
        def split(u: Column, v: Column) -> Column:
            ends = F.filter(F.sequence(one, q - 1), lambda i: (F.length(u) - 1 >= i) & (F.length(v) - 1 >= q - i))
            return F.transform(ends, lambda i: F.concat(u.substr(F.length(u) - i, i), v.substr(F.lit(2), q - i)))

        apart = F.when(q > 1, F.flatten(F.flatten(F.transform("words", lambda u: F.transform(F.filter("words", lambda v: v != u), lambda v: split(u, v)))))).otherwise(none)
        shorter = F.when(q > 1, asked(self._cut(F.col("words"), q - 1, one), "less")).otherwise(F.array(F.lit("")))
        held = F.array_distinct(F.concat(whole, longer, asked(apart, "whole")))
        keys = F.concat(F.transform(held, lambda x: self._key(0, F.col("k"), q, x)), F.transform(F.array_distinct(shorter), lambda x: self._key(1, F.col("k"), q, x)))
        return texts.join(F.broadcast(used), "n").select("tid", "n", "sig", "k", F.explode(keys).alias("key"))

    def candidates(self, texts: DataFrame, names: DataFrame) -> DataFrame:
        """Distinct ``(tid, nid)`` of ``texts (tid, text)`` and ``names (nid, _l)`` (or ``(nid, text)``, words of any order)."""
        padded = lambda words: F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
        words = F.array_distinct(F.split("text", " "))
        texts = texts.select("tid", _joined(words).alias("n"), padded(words).alias("words"))
        held, often = (F.transform("_l", lambda x: x["w"]), F.transform("_l", lambda x: x["f"].cast("bigint"))) if "_l" in names.columns else (words, F.transform(words, lambda w: F.lit(0).cast("bigint")))
        names = names.select("nid", _joined(held).alias("m"), padded(held).alias("words"), often.alias("_f"))
        # one row per pair of lengths, not of texts
        shapes = names.select("m").distinct().crossJoin(texts.select("n").distinct()).withColumn("k", self.pieces(F.col("m"), F.col("n"))).filter("k is not null")
        shapes = cut(shapes.filter(2 * F.least("m", "n") >= self.t * (F.col("m") + F.col("n")) - 1e-6))
        pieces = self.title_keys(names, shapes)
        kinds = F.aggregate("l", F.lit(0), lambda acc, p: acc.bitwiseOR(self._kind(p)))
        kinds_less = F.aggregate(F.flatten(F.transform("l", self._less)), F.lit(0), lambda acc, p: acc.bitwiseOR(self._kind(p)))
        used = pieces.select("m", "k", "q", kinds.alias("whole"), kinds_less.alias("less")).distinct().join(shapes, ["m", "k"])
        used = cut(used.groupBy("n", "k", "q").agg(F.bit_or("whole").alias("whole"), F.bit_or("less").alias("less")))
        k, q = F.col("k"), F.col("q")
        keys = F.concat(F.transform("l", lambda p: self._key(0, k, q, p)), F.transform(F.array_distinct(F.flatten(F.transform("l", self._less))), lambda p: self._key(1, k, q, p)))
        right = pieces.select("nid", "m", F.col("sig").alias("sig_m"), F.explode(keys).alias("key"))
        asking = texts.join(F.broadcast(used.select("n").distinct()), "n", "left_semi").withColumn("sig", self.signature(F.col("words")))
        left = self.text_keys(asking, used)
        m, n = F.col("m"), F.col("n")
        fits = self.near(m, n, F.col("sig"), F.col("sig_m")) & (2 * F.least(m, n) >= self.t * (m + n) - 1e-6) & (self.pieces(m, n) == k)
        return left.join(right, "key").filter(fits).select("tid", "nid").distinct()


class _Titles:
    """The titles of a collection, made ready to be looked up by texts that equal none of them."""

    def __init__(self, names: DataFrame, threshold: int):
        """``names (nid, nt, ids)``: different titles, the two smallest ids of each."""
        self.names, self.threshold, self.t = names, threshold, (threshold - 0.5) / 100  # scores are rounded
        self.share = self.t / (2 - self.t)
        self.words = cut(names.select("nid", F.explode(F.array_distinct(F.split("nt", " "))).alias("word")))
        self.freq = cut(self.words.groupBy("word").agg(F.count(F.lit(1)).alias("_f")))
        self.listed = cut(_rarest_first(_counted(self.words, self.freq, "word", "nid"), "nid"))
        self.keys = cut(_distinctive(self.listed, "nid", self.share).select("nid", "word"))
        self.common = _frequent(self.freq).select("word").join(self.keys.select("word").distinct(), "word", "left_anti")

    def discard(self) -> None:
        discard(self.names, self.words, self.freq, self.listed, self.keys)

    def by_words(self, texts: DataFrame) -> DataFrame:
        """``(tid, nid, score)`` of pairs that reach the threshold by the words they share, against the shorter one."""
        words = cut(_counted(texts.select("tid", F.explode(F.array_distinct(F.split("text", " "))).alias("word")), self.freq, "word", "tid"))
        rare = _distinctive(_rarest_first(words, "tid"), "tid", self.share).filter("_f > 0")
        known = words.filter("_f > 0").join(F.broadcast(self.common), "word", "left_anti")
        pairs = known.join(self.keys, "word").select("tid", "nid").union(rare.select("tid", "word").join(self.words, "word").select("tid", "nid")).distinct()
        x, y = F.array_distinct(F.split("text", " ")), F.array_distinct(F.split("nt", " "))
        s, m, n = _joined(F.array_intersect(x, y)), _joined(x), _joined(y)
        both = pairs.join(texts, "tid").join(self.names.select("nid", "nt"), "nid").select("tid", "nid", F.rint(200 * s / (s + F.least(m, n))).cast("int").alias("score"))
        return both.filter(F.col("score") >= self.threshold)

    def by_letters(self, texts: DataFrame) -> DataFrame:
        """``(tid, nid, score)`` of pairs that may reach the threshold letter by letter and do so."""
        grams, least = _Grams(self.t), self.threshold
        if self.t >= _Grams.PIECES:
            pairs = _Pieces(self.t).candidates(texts, self.listed)
            likely = pairs.join(texts, "tid").join(self.names.select("nid", "nt"), "nid")
        else:
            # the groups of a text are listed once, not once for every pair
            left, right = texts.withColumn("_g", grams.listed(F.col("text"))), self.names.select("nid", "nt").withColumn("_h", grams.listed(F.col("nt")))
            pairs = grams.candidates(texts, self.names.select("nid", F.col("nt").alias("text")))
            most = grams.bound(F.col("text"), F.col("nt"), F.col("_g"), F.col("_h"))
            likely = cut(pairs).join(cut(left), "tid").join(cut(right), "nid").filter(most >= least - 0.5 - 1e-6)
        return cut(likely.select("tid", "nid", "text", "nt")).withColumn("score", score_pairs("text", "nt")).filter(F.col("score") >= least).select("tid", "nid", "score")

    def hits(self, texts: DataFrame) -> DataFrame:
        """``(text, hits)``: the two best titled works ``(cited, score)`` of every text that reaches one (ties: smallest id)."""
        texts = cut(texts.select(F.monotonically_increasing_id().alias("tid"), "text"))
        scored = self.by_words(texts).unionByName(self.by_letters(texts)).groupBy("tid", "nid").agg(F.max("score").alias("score"))
        works = scored.join(self.names, "nid").select("tid", "score", F.explode("ids").alias("cited"))
        works = works.withColumn("_r", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("score"), "cited"))).filter("_r <= 2")
        best = works.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("_r", "cited", "score"))).alias("hits"))
        return best.join(texts, "tid").select("text", F.transform("hits", lambda h: F.struct(h["cited"].alias("cited"), h["score"].alias("score"))).alias("hits"))


def fuzzy_citation_graph(works: DataFrame, threshold: int = 80, refs: str = "references") -> DataFrame:
    """``(citing, cited, score)`` of references matched to titles of the collection.

    Each reference is tried as its guessed title, then, if that reaches no title, as a whole; an equal title wins,
    else the best token-set score of at least ``threshold`` (ties: smallest id).  Equal titles are an equi join.
    The other texts are looked up once each, in two ways:

    - by shared words: then these make up at least t / (2 - t) of the letters of one side, so the rarest
      words beyond that share are the join keys and common words never are;
    - letter by letter (misspelt titles, word forms): from a threshold of 75 on, the sides then share one of a
      few pieces of words but for one letter; below, a number of letter pairs that follows from the threshold,
      so all but that number of their pairs, the rarest, are the keys.

    No pair that reaches the threshold is missed.  A score by shared words is a matter of lengths; only what may
    reach the threshold letter by letter is scored in Python.  A work does not cite itself: of works of one title
    the two smallest ids stay, and of every text the two best works.
    """
    titles = works.select(F.col("doc_id").alias("cited"), normalise(F.col("title")).alias("nt")).filter("nt <> ''")
    titles = titles.withColumn("_r", F.row_number().over(Window.partitionBy("nt").orderBy("cited"))).filter("_r <= 2")
    titles = titles.groupBy("nt").agg(F.array_sort(F.collect_list("cited")).alias("ids"))
    names = cut(titles.select(F.monotonically_increasing_id().alias("nid"), "nt", "ids"))
    raw = works.select("doc_id", F.explode(as_items(works, refs)).alias("ref"))
    left = cut(raw.select("doc_id", normalise(title_guess(F.col("ref"))).alias("text"), normalise(F.col("ref")).alias("whole")))
    other = lambda hits: F.get(F.filter(hits, lambda h: h["cited"] != F.col("doc_id")), F.lit(0))
    found, lookup = [], None
    for last in (False, True):
        equal = F.transform("ids", lambda i: F.struct(i.alias("cited"), F.lit(100).alias("score")))
        tried = left.filter("text <> ''").join(names.select(F.col("nt").alias("text"), "ids"), "text", "left")
        tried = cut(tried.select("doc_id", "text", "whole", other(equal).alias("hit")))
        found.append(tried.filter("hit is not null").select("doc_id", "hit"))
        tried = tried.filter("hit is null").drop("hit")
        if not tried.isEmpty():
            lookup = lookup or _Titles(names, threshold)
            hits = lookup.hits(tried.select("text").distinct())
            tried = cut(tried.join(hits, "text", "left").select("doc_id", "text", "whole", other(F.col("hits")).alias("hit")))
            found.append(tried.filter("hit is not null").select("doc_id", "hit"))
            tried = tried.filter("hit is null").drop("hit")
        left = left.filter("text is null or text = ''").unionByName(tried).withColumn("text", F.col("whole"))
        if last or left.isEmpty():
            break
    if lookup:
        lookup.discard()
    out = functools.reduce(DataFrame.unionByName, found)
    return out.groupBy(F.col("doc_id").alias("citing"), F.col("hit.cited").alias("cited")).agg(F.max("hit.score").alias("score"))


# --- tables ---------------------------------------------------------------------------------------------


def citation_nodes(works: DataFrame, links: DataFrame) -> DataFrame:
    """``(doc_id, title, year, citations, in_degree, out_degree)`` of the works in the graph."""
    ends = links.select(F.explode(F.array(F.struct(F.col("citing").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("cited").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    deg = ends.groupBy(F.col("e.id").alias("doc_id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return works.select("doc_id", "title", "year", F.col("cited_by").alias("citations")).join(deg, "doc_id")


# --- main path --------------------------------------------------------------------------------------------


def strong_components(links: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(node, component)`` for the nodes on cycles only, named by their smallest member.

    Nodes without incoming or outgoing links are peeled off first (in an acyclic graph that removes
    everything); what is left is coloured with the smallest name that reaches a node, and the nodes
    of a colour from which its namesake is reached form a component.
    """
    left = cut(links.select("citing", "cited").filter("citing <> cited"))
    size = left.count()
    found = None
    for _ in range(max_rounds):
        while size:
            a = left.join(left.select(F.col("cited").alias("citing")).distinct(), "citing", "left_semi")
            b = cut(a.join(left.select(F.col("citing").alias("cited")).distinct(), "cited", "left_semi"))
            n = b.count()
            left, done = b, n == size
            size = n
            if done:
                break
        if not size:
            break
        nodes = left.select(F.explode(F.array("citing", "cited")).alias("node")).distinct()
        color = cut(nodes.withColumn("color", F.col("node")))
        while True:
            sent = left.join(color, left["citing"] == color["node"]).groupBy(F.col("cited").alias("node")).agg(F.min("color").alias("_c"))
            new = cut(color.join(sent, "node", "left").select("node", F.least("color", "_c").alias("color"), (F.col("_c") < F.col("color")).alias("_m")))
            moved = new.filter("_m").limit(1).count()
            color = new.drop("_m")
            if not moved:
                break
        part = cut(color.filter("node = color"))
        inside = cut(left.join(color.withColumnRenamed("node", "citing").withColumnRenamed("color", "ca"), "citing").join(
            color.withColumnRenamed("node", "cited").withColumnRenamed("color", "cb"), "cited").filter("ca = cb"))
        reached = part.count()
        while True:
            back = inside.join(part, (inside["cited"] == part["node"]) & (inside["ca"] == part["color"])).select(F.col("citing").alias("node"), "color")
            part = cut(part.unionByName(back).dropDuplicates())
            n = part.count()
            if n == reached:
                break
            reached = n
        got = part.withColumnRenamed("color", "component")
        found = got if found is None else found.unionByName(got)
        drop = part.select("node")
        left = cut(left.join(drop.withColumnRenamed("node", "citing"), "citing", "left_anti").join(drop.withColumnRenamed("node", "cited"), "cited", "left_anti"))
        size = left.count()
    else:
        raise RuntimeError(f"cycles are left after {max_rounds} rounds")
    if found is None:
        kind = links.schema["citing"].dataType.simpleString()
        return links.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    many = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.join(many, "component", "left_semi").select("node", "component")


def condense(links: DataFrame) -> DataFrame:
    """The acyclic graph between strong components, each named by its smallest member."""
    comp = cut(strong_components(links))
    if not comp.take(1):
        return links.select("citing", "cited").filter("citing <> cited").dropDuplicates()
    a, b = comp.toDF("citing", "_a"), comp.toDF("cited", "_b")
    out = links.join(a, "citing", "left").join(b, "cited", "left").select(
        F.coalesce("_a", "citing").alias("citing"), F.coalesce("_b", "cited").alias("cited")
    )
    return out.filter("citing <> cited").dropDuplicates()


class Cyclic(ValueError):
    """The links hold a cycle."""


def _ends(e: DataFrame) -> DataFrame:
    """``(node, received, sent)``: distinct links that lead to a node and away from it."""
    both = F.array(F.struct(F.col("citing").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("cited").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return e.select(F.explode(both).alias("x")).groupBy(F.col("x.n").alias("node")).agg(F.sum("x.i").alias("into"), F.sum("x.o").alias("out"))


def _sweep(nodes: DataFrame, links: DataFrame, start: Column, value, merge) -> DataFrame:
    """Carry values along the links of an acyclic graph: ``(side, node, value)``.

    ``nodes`` is ``(side, node, into)``, ``links`` is ``(side, a, b, ...)``.  Nodes that nothing leads to hold
    ``start``.  Every round sends the values of the nodes that became known in the last one, once over each of
    their links: ``value`` makes a link's value of the sender's.  What a node has received so far is merged
    (``merge(rows, width)``, of counts of ``width`` limbs at most); it is known when all its links have sent.
    So there are as many rounds as the longest path has links, and each link is used in one of them.
    """
    # placed once: a round shuffles what is sent, not the links again; a link knows how many lead to its end
    links = placed(links.join(nodes.select("side", F.col("node").alias("b"), "into"), ["side", "b"]), "side", "a")
    known = cut(nodes.filter("into = 0").select("side", "node", F.col("into").alias("got"), "into", start.alias("value")))
    parts, waiting, width = [known.select("side", "node", "value")], None, 1
    scratch = []
    while True:
        sent = links.join(known.select("side", F.col("node").alias("a"), "value"), ["side", "a"]).select("side", F.col("b").alias("node"), F.lit(1).cast("bigint").alias("got"), "into", value.alias("value"))
        rows = sent if waiting is None else sent.unionByName(waiting.select("side", "node", "got", "into", "value"))
        step = cut(merge(rows, width))
        full = F.col("got") == F.col("into")
        row = step.agg(F.count_if(full).alias("k"), F.count_if(~full).alias("w"), F.max(F.size(_limbs(step))).alias("m")).first()
        scratch.append(step)
        if not row["k"]:
            if row["w"]:
                raise Cyclic("citations lead back to where they came from")
            break
        width = row["m"] + 1
        known, waiting = step.filter(full), step.filter(~full)
        parts.append(known.select("side", "node", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = cut(out)
    discard(*scratch)
    return out


def _limbs(step: DataFrame) -> Column:
    return F.col("value") if step.schema["value"].dataType.typeName() == "array" else F.col("value.k.l")


def _sum_counts(rows: DataFrame, width: int) -> DataFrame:
    got = rows.groupBy("side", "node").agg(F.sum("got").alias("got"), F.max("into").alias("into"), B.summed("value", width).alias("value"))
    return got.select("side", "node", "got", "into", B.settled(F.col("value")).alias("value"))


def _best(rows: DataFrame, width: int) -> DataFrame:
    return rows.groupBy("side", "node").agg(F.sum("got").alias("got"), F.max("into").alias("into"), F.min("value").alias("value"))


def path_weights(links: DataFrame, method: str = "SPC") -> DataFrame:
    """``(citing, cited, weight)`` of an acyclic graph (else ``Cyclic`` is raised).

    SPC is paths from the sources to the link times paths from it to the sinks; SPLC divides by the
    number of all source-sink paths, SPNP by sources times sinks.  Paths are counted exactly, however many
    there are; a weight beyond the range of a double is infinite.
    """
    return _path_counts(links, method).select("citing", "cited", "weight")


def _path_counts(links: DataFrame, method: str) -> DataFrame:
    """``(citing, cited, weight, limbs)``: ``limbs`` is the exact number of paths over the link."""
    e = cut(links.select("citing", "cited").dropDuplicates())
    ends = cut(_ends(e))
    # one sweep for both directions: side 0 counts the ways from the sources, side 1 those from the sinks
    nodes = ends.select(F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("into").alias("i")), F.struct(F.lit(1).alias("s"), F.col("out").alias("i")))).alias("x"), "node").select("x.s", "node", F.col("x.i").alias("into")).withColumnRenamed("s", "side")
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("citing").alias("a"), F.col("cited").alias("b")), F.struct(F.lit(1).alias("side"), F.col("cited").alias("a"), F.col("citing").alias("b")))
    ways = _sweep(nodes, e.select(F.explode(both).alias("x")).select("x.*"), B.number(1), F.col("value"), _sum_counts)
    fwd = ways.filter("side = 0").select(F.col("node").alias("citing"), F.col("value").alias("_f"))
    bwd = ways.filter("side = 1").select(F.col("node").alias("cited"), F.col("value").alias("_b"))
    w = e.join(fwd, "citing").join(bwd, "cited").select("citing", "cited", B.multiplied(F.col("_f"), F.col("_b")).alias("limbs"))
    if method == "SPC":
        return w.select("citing", "cited", B.as_double(F.col("limbs")).alias("weight"), "limbs")
    sinks = ends.filter("out = 0").select("node")
    if method == "SPLC":
        reach = ways.filter("side = 0").join(sinks, "node", "left_semi")
        width = reach.agg(F.max(F.size("value"))).first()[0] or 1
        base = reach.agg(B.summed("value", width).alias("t")).select(B.settled(F.col("t")).alias("t")).scalar()
    else:
        base = ends.agg((F.count_if(F.col("into") == 0) * F.count_if(F.col("out") == 0)).alias("t")).select(B.number(F.col("t")).alias("t")).scalar()
    return w.withColumn("_t", base).select("citing", "cited", B.ratio(F.col("limbs"), F.col("_t")).alias("weight"), "limbs")


def main_path(links: DataFrame, method: str = "SPC") -> tuple[DataFrame, DataFrame]:
    """``(edges, path)``: link weights with a main-path flag, and ``(position, node)`` of the heaviest source-sink path.

    Cycles are condensed first.  Ties go to the smaller id.  Paths are compared by their exact counts (the
    methods differ by a factor that is the same for all links); the way back doubles its length per round.
    """
    try:
        weights = cut(_path_counts(links.filter("citing <> cited"), method))
    except Cyclic:
        weights = cut(_path_counts(condense(links), method))
    ends = cut(_ends(weights))
    kind = weights.schema["citing"].dataType.simpleString()
    nothing = F.struct(B.largest_first(F.array().cast(B.TYPE)).alias("k"), F.lit(None).cast(kind).alias("p"))
    # the sort key of the sum so far (smallest: the heaviest way), then the node before
    onward = F.struct(B.largest_first(B.added(B.from_key(F.col("value.k")), F.col("limbs"))).alias("k"), F.col("a").alias("p"))
    one = F.lit(0).alias("side")
    state = _sweep(ends.select(one, "node", "into"), weights.select(one, F.col("citing").alias("a"), F.col("cited").alias("b"), "limbs"), nothing, onward, _best)
    state = cut(state.select("node", F.col("value.k").alias("key"), F.col("value.p").alias("prev")))
    last = state.join(ends.filter("out = 0").select("node"), "node", "left_semi").orderBy("key", "node").limit(1)
    path = cut(last.select("node", F.lit(0).alias("back")))
    jump, length = cut(state.filter("prev is not null").select("node", "prev")), 1  # ``length`` links back
    while True:
        more = cut(path.join(jump, "node").select(F.col("prev").alias("node"), (F.col("back") + length).alias("back")))
        if not more.take(1):
            break
        path = cut(path.unionByName(more))
        jump = cut(jump.join(jump.toDF("prev", "_far"), "prev").select("node", F.col("_far").alias("prev")))
        length *= 2
    path = cut(path.join(state.select("node", "prev"), "node"))
    depth = F.max("back").over(Window.partitionBy())  # the rows of one path
    flags = path.filter("prev is not null").select(F.col("prev").alias("citing"), F.col("node").alias("cited"), F.lit(1).alias("_m"))
    edges = weights.join(flags, ["citing", "cited"], "left").select("citing", "cited", "weight", F.coalesce("_m", F.lit(0)).alias("main_path"))
    return edges, path.select((depth - F.col("back")).alias("position"), "node")


# --- disruption -----------------------------------------------------------------------------------------------


def disruption(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``(doc_id, n_citing, n_i, n_j, n_k, cd_index, di_index, class)`` for every id.

    n_j counts citers that also cite a reference of the focal work, n_i the other citers, n_k citers
    of its references (once per reference) that do not cite it.  Instead of listing the citers of
    every reference, n_k is the citations of all references minus the focal's own and minus the
    citers that close a triangle; triangles are enumerated in degree order, so a reference that
    everybody cites costs no more than its neighbours.
    """
    e = cut(links.select("citing", "cited").filter("citing <> cited").dropDuplicates())
    indeg = e.groupBy("cited").agg(F.count(F.lit(1)).alias("d"))
    around = e.join(indeg, "cited").groupBy(F.col("citing").alias("doc_id")).agg((F.sum("d") - F.count(F.lit(1))).alias("_other"))
    citing = indeg.select(F.col("cited").alias("doc_id"), F.col("d").alias("n_citing"))
    # undirected pairs with the two possible directions in one number: 1 up, 2 down, 3 both
    und = e.select(F.least("citing", "cited").alias("src"), F.greatest("citing", "cited").alias("dst"), F.when(F.col("citing") < F.col("cited"), 1).otherwise(2).alias("_way"))
    und = und.groupBy("src", "dst").agg(F.bit_or("_way").alias("way"))
    tri = triangles(und, "way")

    def goes(a: str, b: str) -> Column:
        """Does a link lead from corner a to corner b?"""
        way = F.col("way_" + "".join(sorted((a, b))))
        return way.bitwiseAND(F.when(F.col(a) < F.col(b), 1).otherwise(2)) > 0

    corners = ("x", "y", "z")
    cases = [
        F.when(goes(c, f) & goes(f, r) & goes(c, r), F.struct(F.col(f).alias("f"), F.col(c).alias("c")))
        for f in corners for c in corners for r in corners if len({f, c, r}) == 3
    ]
    closed = tri.select(F.explode(F.array_compact(F.array(*cases))).alias("t")).groupBy(F.col("t.f").alias("doc_id"), F.col("t.c").alias("c")).agg(F.count(F.lit(1)).alias("k"))
    per = closed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_j"), F.sum("k").alias("_closed"))
    d = ids.select("doc_id").join(citing, "doc_id", "left").join(around, "doc_id", "left").join(per, "doc_id", "left").fillna(0, ["n_citing", "_other", "n_j", "_closed"])
    d = d.select("doc_id", "n_citing", (F.col("n_citing") - F.col("n_j")).alias("n_i"), "n_j", (F.col("_other") - F.col("_closed")).alias("n_k"))
    base = F.col("n_i") + F.col("n_j") + F.col("n_k")
    known = (F.col("n_citing") > 0) & (base > 0)
    cd = F.when(known, (F.col("n_i") - F.col("n_j")) / base)
    d = d.withColumns({"cd_index": cd, "di_index": F.when(known, F.col("n_i") / base)})
    cls = F.when(F.col("n_citing") == 0, "uncited").when(F.col("cd_index").isNull(), "no context").when(F.col("cd_index") > 0.25, "disruptive").when(
        F.col("cd_index") < -0.25, "consolidating").otherwise("neutral")
    return d.withColumn("class", cls)


def disruption_by_entity(works: DataFrame, scores: DataFrame, col: str, kind: str = "list", min_docs: int = 5) -> DataFrame:
    """``(entity, docs, mean_cd, median_cd, disruptive, consolidating)`` over works with a score."""
    long = explode_entities(works, col, kind=kind, distinct=True).join(scores.filter("cd_index is not null").select("doc_id", "cd_index", "class"), "doc_id")
    # collapse to distinct scores first, so that no entity brings its documents to one task
    vals = long.groupBy("entity", "cd_index", "class").agg(F.count(F.lit(1)).alias("n"))
    return vals.groupBy("entity").agg(
        F.sum("n").alias("docs"), (F.sum(F.col("n") * F.col("cd_index")) / F.sum("n")).alias("mean_cd"),
        F.percentile("cd_index", F.lit(0.5), F.col("n")).alias("median_cd"),
        F.sum(F.when(F.col("class") == "disruptive", F.col("n")).otherwise(0)).alias("disruptive"),
        F.sum(F.when(F.col("class") == "consolidating", F.col("n")).otherwise(0)).alias("consolidating"),
    ).filter(F.col("docs") >= min_docs)


def with_disruption(works: DataFrame, scores: DataFrame) -> DataFrame:
    """The works with their disruption columns."""
    return works.join(scores, "doc_id", "left")


def most_disruptive(scores: DataFrame, n: int = 20, ascending: bool = False) -> DataFrame:
    """The ``n`` works with the highest (or lowest) index."""
    order = F.asc("cd_index") if ascending else F.desc("cd_index")
    return scores.filter("cd_index is not null").orderBy(order, F.asc("doc_id")).limit(n)
