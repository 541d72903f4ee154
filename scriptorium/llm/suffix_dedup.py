"""Repeated byte strings of a corpus, by prefix-free parsing.

A rolling hash of short strings triggers the ends of phrases: the trigger of a window of ``length`` bytes is
the smallest hash inside it, so equal windows have their trigger at the same place wherever they stand.  A
phrase is a run of windows with one trigger.  Its string (all bytes of its windows) is an entry of the
dictionary, and the phrases of the corpus in order are the parse.

Two suffixes share their first ``length`` bytes if their phrases are equal, or if different dictionary
entries with the same trigger contain that window.  Suffixes are therefore ranked in two steps, first on the
parse (how often does an entry occur), then on the suffixes of those entries that meet others at their
trigger.  Ranks beyond ``length`` bytes decide nothing here, so equal 64-bit fingerprints within one trigger
(a fingerprint itself) stand for equal ranks, and no suffix is compared byte by byte or sorted any further.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import cut
from . import hashing as H

LENGTH, TRIGGER = 200, 40  # bytes of a repeat, of a trigger
_CHUNK = 1 << 18  # positions that fit beside 14 bits of hash in a 32-bit key
_PHRASE = "trigger long, entry long, key long, at long"
_PHRASE_ARROW = pa.schema([("trigger", pa.int64()), ("entry", pa.int64()), ("key", pa.int64()), ("at", pa.int64())])
_NO_ID = -(1 << 63)


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER):
    """``(row, start, windows, trigger hash, entry hash)`` of every phrase of a slice of texts."""
    n = len(data)
    if n > _CHUNK:  # one long text: pieces that overlap by a window less one byte
        out = []
        for at in range(0, n - length + 1, _CHUNK - length):
            part = data[at : at + _CHUNK - 1]
            if len(part) >= length:
                row, start, *rest = phrases(part, np.array([0, len(part)]), length, trigger)
                out.append((row, start + at, *rest))
        return tuple(np.concatenate(c) for c in zip(*out))
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = H.prefix_sums(H.byte_codes(data))
    m = n - trigger + 1
    low = (((sums[trigger:] - sums[:-trigger]) * H.powers(H._INVERSE, m)) >> np.uint64(50)).astype(np.uint32)
    low <<= np.uint32(18)
    low |= np.arange(m, dtype=np.uint32)
    width, have = length - trigger + 1, 1
    while have < width:  # smallest key of every run of ``width`` places, by doubling
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    change = np.ones(len(low), bool)
    change[1:] = low[1:] != low[:-1]
    change[offsets[:-1][offsets[:-1] < len(low)]] = True
    first_bad = np.maximum(offsets[1:] - length + 1, offsets[:-1])  # from here on a window leaves its text
    change[first_bad[first_bad < len(low)]] = True
    start = np.flatnonzero(change)
    stop = np.concatenate((start[1:], [len(low)]))
    row = np.searchsorted(offsets, start, side="right") - 1
    good = start + length <= offsets[row + 1]
    start, stop, row = start[good], stop[good], row[good]
    anchor = (low[start] & np.uint32(_CHUNK - 1)).astype(np.int64)
    by_trigger = H.span_hash(sums, anchor, anchor + trigger)
    by_entry = H.span_hash(sums, start, stop - 1 + length)
    return row, start - offsets[row], stop - start, by_trigger, by_entry


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, carried, key, tag, data)``; the tag keeps texts apart that share an id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("boolean")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), carried.alias("carried"), text.alias("_t")).select(
        "doc_id", "carried", F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), F.xxhash64("_t").bitwiseAND(F.lit(0x7FFFFF)).alias("tag"), F.col("_t").cast("binary").alias("data")
    )


def _parse(keyed: DataFrame, length: int) -> DataFrame:
    """The phrases of all texts; ``at`` holds tag, start and number of windows in one long."""

    def task(batches):
        for b in batches:
            keys, tags = (np.asarray(b.column(i)) for i in (0, 1))
            for first, data, offsets in H.slices(b.column(2), _CHUNK >> 1):
                row, start, windows, by_trigger, by_entry = phrases(data, offsets, length)
                at = tags[first + row] << 40 | start << 8 | windows
                cols = [by_trigger.view(np.int64), by_entry.view(np.int64), keys[first + row], at]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_PHRASE_ARROW)

    return keyed.select("key", "tag", "data").mapInArrow(task, _PHRASE)


_TAG, _START, _WINDOWS = "shiftright(at, 40)", "(shiftright(at, 8) & 4294967295)", "(at & 255)"


def _windows_of(entries: list[np.ndarray], length: int):
    """``(hash, entry, offset)`` of all windows of dictionary entries."""
    data = np.concatenate(entries)
    ends = np.cumsum([len(e) for e in entries])
    sums = H.prefix_sums(H.byte_codes(data))
    n = np.array([len(e) for e in entries]) - length + 1
    owner = np.repeat(np.arange(len(entries)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = (ends - n - length + 1)[owner] + offset
    return H.span_hash(sums, start, start + length), owner, offset


def _shared_ranges(rows, length: int):
    """Ranges of the windows that entries of one trigger share; only entries that occur once need them.

    ``rows``: sorted by trigger, ``(trigger, entry, key, at, many, data)``.
    """
    trigger = np.array([r[0] for r in rows])
    h, owner, offset = _windows_of([np.frombuffer(r[5], np.uint8) for r in rows], length)
    order = np.lexsort((h, trigger[owner]))
    h, owner, offset = h[order], owner[order], offset[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (trigger[owner[1:]] != trigger[owner[:-1]])))
    group = np.cumsum(new) - 1
    hit = np.bincount(group)[group] > 1
    hit &= ~np.array([r[4] for r in rows])[owner]
    owner, offset = owner[hit], offset[hit]
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    cutoff = np.concatenate(([True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(owner) else np.zeros(0, bool)
    begin = np.flatnonzero(cutoff)
    count = np.diff(np.concatenate((begin, [len(owner)])))
    for i, at, n in zip(owner[begin].tolist(), offset[begin].tolist(), count.tolist()):
        key, packed = rows[i][2], rows[i][3]
        yield key, packed & ~((1 << 40) - 1) | (((packed >> 8) & 0xFFFFFFFF) + at) << 8 | n


_RANGE = "key long, at long"
_RANGE_ARROW = pa.schema([("key", pa.int64()), ("at", pa.int64())])


def _ranked(entries: DataFrame, length: int) -> DataFrame:
    """Shared windows of entries, trigger by trigger: rows arrive sorted, a task holds one batch and one trigger."""

    def out(rows):
        found = list(_shared_ranges(rows, length))
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], schema=_RANGE_ARROW)

    def task(batches):
        held = []
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                held += [tuple(r.values()) for r in b.slice(at, 4000).to_pylist()]
                whole = len(held)
                while whole and held[whole - 1][0] == held[-1][0]:
                    whole -= 1
                if whole:
                    yield out(held[:whole])
                    held = held[whole:]
        if held:
            yield out(held)

    return entries.select("trigger", "entry", "key", "at", "many", "data").repartition("trigger").sortWithinPartitions("trigger").mapInArrow(task, _RANGE)


def _ranked_wide(entries: DataFrame, length: int) -> DataFrame:
    """The same for triggers with very many entries: windows are dealt by their own hash and counted in two steps."""
    schema = "trigger long, hash long, key long, at long, many boolean"
    arrow = pa.schema([("trigger", pa.int64()), ("hash", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("many", pa.bool_())])

    def task(batches):
        for b in batches:
            for begin in range(0, b.num_rows, 1000):
                part = b.slice(begin, 1000)
                trigger, key, at, many = (np.asarray(part.column(i).to_numpy(zero_copy_only=False)) for i in range(4))
                h, owner, offset = _windows_of([np.frombuffer(x.as_py(), np.uint8) for x in part.column(4)], length)
                moved = at[owner] & ~np.int64((1 << 40) - 1) | (((at[owner] >> 8) & 0xFFFFFFFF) + offset) << 8 | 1
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (trigger[owner], h.view(np.int64), key[owner], moved, many[owner])], schema=arrow)

    windows = entries.select("trigger", "key", "at", "many", "data").mapInArrow(task, schema)
    shared = windows.groupBy("trigger", "hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return windows.join(shared, ["trigger", "hash"]).filter("not many").select("key", "at")


def repeats(
    docs: DataFrame, length: int = LENGTH, wide: int = 20_000, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), whole_chars: bool = False
) -> DataFrame:
    """``(doc_id, carried, n_bytes, kept, spans)``: every text without the bytes of strings that start twice.

    ``spans`` are the maximal removed runs ``(start, size)`` in bytes, ``kept`` the remaining bytes; with
    ``whole_chars`` a character that is repeated only in part stays.  ``carried`` holds the columns ``carry``.

    - Counting triggers and entries combines in the tasks first, so a passage in a third of all texts
      brings a row per task.  Texts are shuffled twice: to fetch the entries that need a closer look, and
      to take out what is repeated.
    - A trigger with more than ``wide`` entries (a passage with as many different surroundings) is ranked
      by window, dealt by hash; the others by trigger.
    - Null texts count as empty; rows with null ids are kept apart by their text; repeated rows repeat
      each other, so both lose everything a window covers; texts shorter than ``length`` stay whole; an
      empty table gives no rows; other columns are not read.
    """
    if not 64 <= length <= 255:
        raise ValueError("length must lie between 64 and 255 bytes")
    keyed = _keyed(docs, id_col, text_col, carry)
    parse = _parse(keyed, length)
    counts = parse.groupBy("trigger").agg(F.count(F.lit(1)).alias("_n"), F.min("entry").alias("_a"), F.max("entry").alias("_b"))
    twice = cut(counts.filter("_n > 1").select("trigger", (F.col("_a") == F.col("_b")).alias("single")))
    met = cut(parse.join(twice, "trigger"))
    several = met.filter("not single")
    entries = several.groupBy("trigger", "entry").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("key", "at")).alias("_r"))
    entries = cut(entries.select("trigger", "entry", "_r.key", "_r.at", (F.col("_n") > 1).alias("many")))
    whole = met.filter("single").select("key", "at").unionByName(
        several.join(entries.filter("many").select("trigger", "entry"), ["trigger", "entry"]).select("key", "at")
    )
    crowded = cut(entries.groupBy("trigger").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > wide).select("trigger"))
    texts = keyed.select("key", "tag", "data")

    def with_bytes(e: DataFrame) -> DataFrame:
        e = e.withColumn("tag", F.expr(_TAG))
        found = texts.join(e, ["key", "tag"])
        return found.withColumn("data", F.expr(f"substring(data, cast({_START} + 1 as int), cast({_WINDOWS} + {length - 1} as int))"))

    if crowded.isEmpty():
        part = _ranked(with_bytes(entries), length)
    else:
        part = _ranked(with_bytes(entries.join(crowded, "trigger", "left_anti")), length)
        part = part.unionByName(_ranked_wide(with_bytes(entries.join(crowded, "trigger", "left_semi")), length))
    ranges = cut(whole.unionByName(part)).groupBy("key", F.expr(_TAG).alias("tag")).agg(F.collect_list(F.expr(f"{_START} << 8 | {_WINDOWS}")).alias("_ranges"))
    return _removed(keyed.join(ranges, ["key", "tag"], "left"), length, whole_chars)


def merged(ranges: np.ndarray, length: int) -> list[tuple[int, int]]:
    """``(start, stop)`` of the union of packed window ranges."""
    start = ranges >> 8
    stop = start + (ranges & 255) + length - 1
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate(([True], start[1:] > stop[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))
    return list(zip(start[new].tolist(), stop[last].tolist()))


def _whole_chars(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs shrunk to character borders."""
    out = []
    for a, z in runs:
        while a < z and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        if a < z:
            out.append((a, z))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))


def _removed(joined: DataFrame, length: int, whole_chars: bool) -> DataFrame:
    rows = joined.select("doc_id", "carried", "data", "_ranges")
    schema = T.StructType(rows.schema.fields[:2]).add("n_bytes", "long").add("kept", "binary").add("spans", T.ArrayType(T.StructType().add("start", "long").add("size", "long")))

    def task(batches):
        for b in batches:
            done, first, sizes, kept, spans = 0, 0, [], [], []
            for i, (data, ranges) in enumerate(zip(b.column(2), b.column(3))):
                raw, runs = data.as_py(), []
                sizes.append(len(raw))
                if ranges.is_valid and len(ranges.values):
                    runs = merged(ranges.values.to_numpy(), length)
                    runs = _whole_chars(raw, runs) if whole_chars else runs
                    raw = b"".join(raw[a:z] for a, z in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)]))
                kept.append(raw)
                spans.append([{"start": a, "size": z - a} for a, z in runs])
                done += len(raw)
                if done > 8 << 20 or i + 1 == b.num_rows:
                    own = b.slice(first, i + 1 - first)
                    cols = [own.column(0), own.column(1), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, _SPANS)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "carried", "n_bytes", "kept", "spans"])
                    done, first, sizes, kept, spans = 0, i + 1, [], [], []

    return rows.mapInArrow(task, schema)
