"""Documents whose sets of word shingles are similar, by PartEnum signatures.

Sizes are cut into bands so that similar sets lie in one band or in neighbours.  For a pair of bands the
similarity bounds how many elements two sets may differ in, ``k``.  The domain of shingles is dealt into more
than ``k`` parts, so many that nearly all sets fill more than ``k`` of them: two similar sets then agree in at
least one filled part (pigeonhole), and each set's signatures are the hashes of its filled parts.  (Of the
enumerated subsets of parts, single parts are the choice with fewest signatures for sets of documents' size.)
Shingles that many documents share fill parts only of sets that have too few others.  Sets of one signature
are candidates; candidates are verified exactly, together, in groups of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import cut, discard
from ..operators.graph import components
from . import hashing as H
from .kept import release

_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_SCHEMA = "kind int, a long, b long, n long"
_DOC, _SIGNATURE, _SAME, _NEAR = 0, 1, 2, 3  # kinds of rows: (id, -, size), (signature, id, -), (id, equal id, -), (id, candidate id, -)
_NO_ID = -(1 << 63)
_HELD = 1 << 20  # signatures a task holds before it sends them on


_RARE = 1e-6  # chance that a set fills too few parts to be found by them alone


def _filled_at_most(limit: int, size: int, parts: int) -> float:
    """Chance that ``size`` elements fall into ``limit`` of the parts or fewer."""
    if size > 256:  # the number of empty parts is about normal
        load = size / parts
        empty = parts * np.exp(-load)
        spread = np.sqrt(empty * (1 - (1 + load) * np.exp(-load)))
        return 0.5 * math.erfc((parts - empty - limit - 0.5) / max(spread, 1e-9) / math.sqrt(2))
    chance = np.zeros(parts + 1)
    chance[0] = 1.0
    filled = np.arange(parts + 1) / parts
    for _ in range(size):
        chance = chance * filled + np.concatenate(([0.0], (chance * (1 - filled))[:-1]))
    return float(chance[: limit + 1].sum())


def _enough_parts(size: int, differ: int) -> int:
    """Parts for sets of ``size`` elements or more, so that nearly all of them fill more than ``differ``.

    Sets that differ in ``differ`` elements agree in a filled part then.  An empty part says nothing about a
    set; it would tie all sets together that happen to leave it empty.
    """
    parts = differ + 1
    while differ and size > differ + 1 and _filled_at_most(differ, size, parts) > _RARE and parts < 64 * size:
        parts += max(1, parts // 64)
    return parts


class Bands:
    """Size bands and parts for sets with ``den * both >= num * any``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(self.low[-1] * den // num + 1)
        lows = np.array(self.low[:-2], np.int64)
        top, above = np.array(self.low[1:-1], np.int64) - 1, np.array(self.low[2:], np.int64) - 1
        differ = (top + above) * (den - num) // (den + num)  # of a set of the band and one of it or the next
        self.lows = lows
        self.parts = np.array([_enough_parts(int(n), int(k)) for n, k in zip(lows, differ)], np.int64)
        self.slack = self.parts - differ - 1  # agreeing parts that may be empty ones

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, size, side="right") - 1


class Common:
    """A set of hashes in a bit array of fixed size; it may hold a few more, never fewer."""

    TIMES = 4

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @staticmethod
    def bits(keys: np.ndarray, n_bits: int) -> np.ndarray:
        """Places of every key, a row per place; keys of one upper half (a cell) have the same."""
        keys = keys >> np.uint64(32)
        one, two = H.mix(keys + np.uint64(0x9E37)), H.mix(keys ^ np.uint64(0xC2B2AE3D)) | np.uint64(1)
        return np.stack([one + np.uint64(i) * two for i in range(Common.TIMES)]) & np.uint64(n_bits - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.bits(keys, len(self.words) * 64):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def signatures(keys: np.ndarray, row: np.ndarray, n_rows: int, bands: Bands, common: Common | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(signature, row)`` of all sets; ``keys`` sorted by row.

    With ``common``, the parts hold only the elements that are not common: these differ in no more places than
    the sets do.  If one of two similar sets fills more such parts than may differ, both fill one alike; if
    neither does, both also have the signatures of their full parts.
    """
    size = np.bincount(row, minlength=n_rows)
    band = bands.of(np.maximum(size, 1))
    out_h, out_r = [], []
    spread, element = H.mix(keys ^ np.uint64(0xA5A5A5A5)), H.mix(keys + np.uint64(0x51ED27))
    rare = None if common is None else ~common.has(keys)
    for step in (0, 1):  # as the smaller one of a pair of bands, then as the larger
        pair = band - step
        live = (pair >= 0) & (size > 0)
        at = np.maximum(pair, 0)

        def filled_parts(pick: np.ndarray, live: np.ndarray, salt: int, empty_too: bool):
            """Emits the parts of the live sets; returns how many each fills."""
            r, parts = row[pick], bands.parts[at]
            part = ((spread[pick] >> np.uint64(32)) * parts[r].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            first = np.concatenate(([0], np.cumsum(np.where(live, parts, 0))))
            slot = first[r] + part
            sums, filled = np.zeros(first[-1], np.uint64), np.zeros(first[-1], bool)
            np.add.at(sums, slot, element[pick])
            filled[slot] = True
            owner = np.repeat(np.arange(n_rows), np.diff(first))
            index = np.arange(first[-1]) - first[owner]
            full = np.bincount(owner[filled], minlength=n_rows)
            few = live & (bands.parts[at] - full > bands.slack[at])  # else a filled part must agree
            use = filled | few[owner] if empty_too else filled
            owner, index, sums = owner[use], index[use], sums[use]
            place = pair[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + index.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt)
            out_h.append(H.mix(sums + H.mix(place)))
            out_r.append(owner)
            return few

        if rare is not None:
            live = filled_parts(live[row] & rare, live, 0x5EED, False)
        filled_parts(live[row], live, 0, True)
    return np.concatenate(out_h), np.concatenate(out_r)


def _signed(docs: DataFrame, words: int, bands: Bands, common: Common | None = None) -> DataFrame:
    """Sizes, signatures and, inside a task, sets that are equal.

    What a task can settle alone it sends on once: of equal sets only the first has signatures, and of the
    sets that share a signature only the first carries it on, the others are named as its candidates.  So
    a signature has a row per task (and million signatures) at most, however many documents share it.
    """

    def rows(kind, a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n)], schema=_ARROW)

    def task(batches):
        release()
        seen: dict[tuple, int] = {}
        hashes, owners, held = [], [], 0

        def settled():
            nonlocal held
            if not hashes:
                return
            h, o = np.concatenate(hashes), np.concatenate(owners)
            hashes.clear(), owners.clear()
            held = 0
            order = np.lexsort((o, h))
            h, o = h[order], o[order]
            new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            leader = o[new][np.cumsum(new) - 1] if len(h) else o
            other = np.unique(np.stack([leader, o])[:, leader != o], axis=1)
            h, o = h[new].view(np.int64), o[new]
            for kind, a, b in ((_NEAR, other[1], other[0]), (_SIGNATURE, h, o)):
                for at in range(0, len(a), 1 << 18):
                    part = a[at : at + (1 << 18)]
                    yield rows(kind, part, b[at : at + (1 << 18)], np.zeros(len(part), np.int64))

        for b in batches:
            ids = np.asarray(b.column(0))
            for first, data, offsets in H.slices(b.column(1), 1 << 19):
                keys, row = H.shingle_sets(data, offsets, words)
                n_rows = len(offsets) - 1
                own = ids[first : first + n_rows]
                size = np.bincount(row, minlength=n_rows)
                yield rows(_DOC, own, own, size)
                marks = [np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)]
                for i, mark in enumerate(marks):
                    np.add.at(mark, row, H.mix(keys + np.uint64(i + 1)))
                fresh = np.zeros(n_rows, bool)
                same = []
                for i, mark in enumerate(zip(size.tolist(), *(m.tolist() for m in marks))):
                    if mark[0] and own[i] != _NO_ID:
                        other = seen.setdefault(mark, int(own[i]))
                        if other == own[i]:
                            fresh[i] = True
                        else:
                            same.append((own[i], other))
                if same:
                    pairs = np.array(same, np.int64)
                    yield rows(_SAME, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))
                pick = fresh[row]
                h, r = signatures(keys[pick], row[pick], n_rows, bands, common)
                hashes.append(h)
                owners.append(own[r])
                held += len(h)
            if held > _HELD:
                yield from settled()
        yield from settled()
        seen.clear()
        release()

    return docs.mapInArrow(task, _SCHEMA)


def linked(keys: np.ndarray, row: np.ndarray, n_rows: int, num: int, den: int) -> np.ndarray:
    """Component labels (smallest row) of the sets under exact similarity.

    A set is compared with all others by one pass over the lists of its shingles.  Sets of the largest
    component are passed over once every set outside it has been compared: each pair that could still
    join two components then has a compared end.
    """
    label = np.arange(n_rows)
    size = np.bincount(row, minlength=n_rows)
    order = np.argsort(keys, kind="stable")
    owner = row[order]
    sorted_keys = keys[order]
    new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])) if len(keys) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    length = np.diff(np.concatenate((begin, [len(keys)])))
    entry = np.empty(len(keys), np.int64)
    entry[order] = np.cumsum(new) - 1
    first = np.searchsorted(row, np.arange(n_rows + 1))
    done = size == 0
    while not done.all():
        waiting = np.flatnonzero(~done)
        count = np.bincount(label, minlength=n_rows)
        largest = int(np.argmax(count))
        outside = waiting[label[waiting] != largest]
        if len(outside) == 0 and count[largest] > 1:
            break
        y = int(outside[0] if len(outside) else waiting[0])
        lists = entry[first[y] : first[y + 1]]
        n = length[lists]
        at = np.repeat(begin[lists] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=n_rows)
        near = np.flatnonzero((both > 0) & (den * both >= num * (size + size[y] - both)))
        old = np.unique(label[near])
        label[np.isin(label, old)] = old.min()
        done[y] = True
    return label


def _verified(groups: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``(src, dst)``: every document of a candidate group beside the smallest one it is linked with."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def group(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("id").combine_chunks())
        keys, row, at = [], [], 0
        for first, data, offsets in H.slices(table.column("text"), 1 << 19):
            k, r = H.shingle_sets(data, offsets, words)
            keys.append(k)
            row.append(r + first)
        keys, row = np.concatenate(keys), np.concatenate(row)
        label = linked(keys, row, len(ids), num, den)
        lead = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table([pa.array(ids[lead]), pa.array(ids[label[lead]])], schema=schema)

    return groups.groupBy("group", "i", "j").applyInArrow(group, "src long, dst long")


def _candidates(signed: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)``: every set of a signature beside the one of smallest id."""
    near = signed.filter(F.col("kind") == _NEAR).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    shared = signed.filter(F.col("kind") == _SIGNATURE).select(F.col("a").alias("signature"), F.col("b").alias("src"))
    shared = shared.withColumn("dst", F.min("src").over(Window.partitionBy("signature"))).filter("src <> dst").select("src", "dst")
    return near.unionByName(shared).distinct()


_RANGES = 256  # of the cells of shingles, a group each


def _gaps(cells: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, 16 bits each; 65,535 is a step that ends at no number."""
    gap = np.diff(cells.astype(np.int64), prepend=0)
    n = gap // 0xFFFF + 1
    out = np.full(n.sum(), 0xFFFF, "<u2")
    out[np.cumsum(n) - 1] = gap % 0xFFFF
    return out


def _from_gaps(raw: bytes) -> np.ndarray:
    gap = np.frombuffer(raw, "<u2")
    return np.cumsum(gap, dtype=np.int64)[gap != 0xFFFF].astype(np.uint32)


def _cells(docs: DataFrame, words: int) -> DataFrame:
    """``(range, cells)``: the upper half of the hash of every shingle of every text, sorted, as differences.

    That is two bytes a shingle (repeats included) and a row per range and million shingles, whatever the texts share.
    """
    width = 32 - (_RANGES - 1).bit_length()

    def task(batches):
        release()
        held: list[np.ndarray] = []

        def out():
            cells = np.sort(np.concatenate(held))
            held.clear()
            at = np.searchsorted(cells, np.arange(_RANGES, dtype=np.uint64) << np.uint64(width)).tolist()
            filled = [(i, a, b) for i, (a, b) in enumerate(zip(at, [*at[1:], len(cells)])) if a < b]
            packed = [_gaps(cells[a:b] - np.uint32(i << width)).tobytes() for i, a, b in filled]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in filled], pa.int32()), pa.array(packed, pa.binary())], names=["range", "cells"])

        for b in batches:
            for _, data, offsets in H.slices(b.column(1), 1 << 19):
                held.append((H.shingle_sets(data, offsets, words)[0] >> np.uint64(32)).astype(np.uint32))
                if sum(map(len, held)) > _HELD:
                    yield from out()
        if held:
            yield from out()
        release()

    return docs.mapInArrow(task, "range int, cells binary")


def _common(docs: DataFrame, words: int, often: int) -> Common:
    """Shingles of more than ``often`` of the texts, as a bit array (those of one cell are counted as one)."""
    width = 32 - (_RANGES - 1).bit_length()

    def frequent_cells(table: pa.Table) -> pa.Table:
        cells = np.concatenate([_from_gaps(c.as_buffer()) for c in table.column("cells")])
        cells.sort()
        first = cells[: max(len(cells) - often, 0)]
        many = np.unique(first[first == cells[often:]]).astype(np.int64)
        return pa.table({"cell": many + (table.column("range")[0].as_py() << width)})

    frequent = cut(_cells(docs, words).groupBy("range").applyInArrow(frequent_cells, "cell long"))
    n_bits = 1 << min(max(int(16 * frequent.count()).bit_length(), 16), 26)  # at most 8 MB; beyond, more shingles count as common

    def bits(batches):
        for b in batches:
            at = Common.bits(np.asarray(b.column(0)).astype(np.uint64) << np.uint64(32), n_bits).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    rows = frequent.mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(n_bits // 64, np.uint64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    discard(frequent)
    return Common(table)


def similar_documents(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, block: int = 500_000, often: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: documents linked by ``den * both >= num * any`` of their sets.

    Words are runs without ASCII white space after lower-casing A-Z; a set holds the distinct shingles of
    ``words`` words, or the whole sequence of a shorter text.  The component is named by its smallest id.

    - Passages that many documents share would tie most of them together: shingles of more than ``often`` texts
      are counted first, and sets are signed without them.  A candidate group goes to one task while its sets
      hold at most ``block`` shingles.  A larger one (near copies in great number) is dealt into blocks by id,
      and a task compares two blocks.  Tasks return a link per document.
    - Null and empty texts have an empty set and are linked with nothing.  Null ids get a null component and
      are linked with nothing.  Rows that share an id are one node: its size is that of the largest set and
      all its links count.  An empty table gives an empty one; long texts are taken whole.  Other columns are
      not read.
    """
    bands = Bands(num, den)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = cut(_signed(source, words, bands, _common(source, words, often)))
    candidates = cut(_candidates(signed))
    size = cut(signed.filter(F.col("kind") == _DOC).select(F.col("a").alias("id"), "n"))
    same = cut(signed.filter(F.col("kind") == _SAME).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    discard(signed)
    grouped = cut(components(candidates))
    sized = cut(grouped.withColumnRenamed("node", "id").join(size.groupBy("id").agg(F.max("n").alias("n")), "id"))
    discard(candidates, grouped)
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    dealt = sized.join(blocks, "component").select("id", F.col("component").alias("group"), "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("own"))
    # block pairs (i <= j) that this document belongs to
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # by shuffle whatever the number of candidates: few texts or many, the plan is the same
    links = _verified(source.join(dealt.hint("merge"), "id").select("id", "text", "group", "i", "j"), words, num, den)
    found = components(links.unionByName(same))
    out = size.join(found.withColumnRenamed("node", "id"), "id", "left")
    doc = F.when(F.col("id") != _NO_ID, F.col("id"))
    return out.select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(doc.isNotNull(), F.coalesce("component", "id")).alias("component_id"))
