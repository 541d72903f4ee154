"""Token files of patched frame-of-reference blocks.

A file row is a segment of whole documents.  Its payload holds the ids in blocks: the minimum of a block is
taken off, the differences are packed at a width that a given share of them fits, and the few that do not
fit keep their low bits in place and stand in a list of exceptions.  The starts of blocks and of exception
lists are indexed, so a block can be read alone.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .kept import trim

BLOCK = 128
_HEAD = struct.Struct("<4sIQI")
_MAGIC = b"PFR1"
FILE_SCHEMA = "part int, segment int, before bigint, doc_ids array<bigint>, doc_tokens array<bigint>, n_ids bigint, payload binary"
_FILE_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary())])
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_DOC_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of every value of a row one after the other, as bytes of the row.

    32 values fill ``width`` words of 32 bits; all such lanes are shifted together, value by value.
    """
    lanes = np.ascontiguousarray(values.reshape(-1, 32).T).astype(np.uint64) & np.uint64((1 << width) - 1)
    words = np.zeros((width + 1, lanes.shape[1]), np.uint64)
    for j in range(32):
        k, shift = divmod(j * width, 32)
        v = lanes[j] << np.uint64(shift)
        words[k] |= v
        if shift + width > 32:
            words[k + 1] |= v >> np.uint64(32)
    return np.ascontiguousarray(words[:width].T).astype("<u4").view(np.uint8).reshape(len(values), -1)


def _unpack(raw: np.ndarray, width: int, block: int) -> np.ndarray:
    """The values of rows of packed bytes."""
    words = np.ascontiguousarray(raw).view("<u4").reshape(-1, width).T.astype(np.uint64)
    lanes = np.empty((32, words.shape[1]), "<u4")
    mask = np.uint64((1 << width) - 1)
    for j in range(32):
        k, shift = divmod(j * width, 32)
        v = words[k] >> np.uint64(shift)
        if shift + width > 32:
            v |= words[k + 1] << np.uint64(32 - shift)
        lanes[j] = v & mask
    return np.ascontiguousarray(lanes.T).reshape(-1, block)


def encode_blocks(ids: np.ndarray, share: float = 0.9, block: int = BLOCK) -> bytes:
    """Pack unsigned 32-bit ids; at least ``share`` of a block (a multiple of 32 ids) fits its width."""
    if block % 32 or not 0 < block <= 256:
        raise ValueError("a block is a multiple of 32 ids, 256 at most")
    n = len(ids)
    n_blocks = -(-n // block)
    table = np.empty((n_blocks, block), "<u4")
    if n:
        table.reshape(-1)[:n] = ids
        table.reshape(-1)[n:] = ids[-1]  # padding that changes neither minimum nor width
    low = table.min(axis=1) if n else np.zeros(0, "<u4")
    diff = table - low[:, None]
    at = min(block - 1, int(np.ceil(share * block)) - 1)
    fits = np.partition(diff, at, axis=1)[:, at] if n else np.zeros(0, "<u4")
    width = np.ceil(np.log2(fits.astype(np.float64) + 1)).astype(np.uint8)
    starts = np.concatenate(([0], np.cumsum(width.astype(np.uint64) * np.uint64(block // 8)))).astype("<u8")
    packed = np.empty(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            part = _pack(diff[rows], int(w))
            packed[(starts[rows].astype(np.int64)[:, None] + np.arange(part.shape[1])).reshape(-1)] = part.reshape(-1)
    over = diff.astype(np.uint64) >> width[:, None].astype(np.uint64) > 0
    row, pos = np.nonzero(over)
    lists = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n_blocks)))).astype("<u4")
    return b"".join((
        _HEAD.pack(_MAGIC, block, n, n_blocks), low.astype("<u4").tobytes(), width.tobytes(), starts.tobytes(), lists.tobytes(),
        packed.tobytes(), pos.astype(np.uint8).tobytes(), diff[row, pos].astype("<u4").tobytes(),
    ))


def _parts(data: bytes):
    magic, block, n, n_blocks = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a block file")
    at = _HEAD.size
    out = [block, n]
    for dtype, count in (("<u4", n_blocks), ("u1", n_blocks), ("<u8", n_blocks + 1), ("<u4", n_blocks + 1)):
        out.append(np.frombuffer(data, dtype, count, at))
        at += out[-1].nbytes
    n_packed, n_over = int(out[4][-1]), int(out[5][-1])
    out.append(np.frombuffer(data, "u1", n_packed, at))
    out.append(np.frombuffer(data, "u1", n_over, at + n_packed))
    out.append(np.frombuffer(data, "<u4", n_over, at + n_packed + n_over))
    return out


def decode_blocks(data: bytes, first: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``stop`` (exclusive); all of them by default."""
    block, n, low, width, starts, lists, packed, pos, value = _parts(data)
    stop = len(low) if stop is None else min(stop, len(low))
    out = np.zeros((max(stop - first, 0), block), "<u4")
    for w in np.unique(width[first:stop]):
        rows = np.flatnonzero(width[first:stop] == w)
        if w:
            size = int(w) * block // 8
            raw = packed[starts[first + rows].astype(np.int64)[:, None] + np.arange(size)]
            out[rows] = _unpack(raw, int(w), block)
    a, b = int(lists[first]) if len(low) else 0, int(lists[stop]) if len(low) else 0
    owner = np.repeat(np.arange(stop - first), np.diff(lists[first : stop + 1])) if b > a else np.zeros(0, np.int64)
    out[owner, pos[a:b]] = value[a:b]
    out += low[first:stop, None]
    return out.reshape(-1)[: max(min(n, stop * block) - first * block, 0)]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each followed by ``end_id``, in ascending id order.

    Documents are dealt by ranges of their id (a sample finds the ranges, so no range outgrows a task), a
    task writes its range in order.  Null and empty texts are the end id alone; null ids come first;
    rows that share an id are ordered by text.  Other columns are not read.
    """
    end = np.array([end_id], "<u4").tobytes()

    def task(batches):
        enc = tokens.encoder(tokenizer)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        segment, before, doc_ids, lengths, raw, size = 0, 0, [], [], [], 0

        def row():
            payload = encode_blocks(np.frombuffer(b"".join(raw), "<u4"))
            cols = [[part], [segment], [before], [list(doc_ids)], [list(lengths)], [size], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FILE_ARROW.types)], schema=_FILE_ARROW)

        for b in batches:
            ids_of = b.column(0)
            for first, texts in tokens.text_slices(b.column(1), 1 << 21):
                for i, ids in enumerate(enc.encode(texts)):
                    doc_ids.append(ids_of[first + i].as_py())
                    raw.append(ids + end)
                    lengths.append(len(raw[-1]) // 4)
                    size += lengths[-1]
                    if size >= segment_ids:
                        yield row()
                        segment, before, size = segment + 1, before + size, 0
                        doc_ids.clear(), lengths.clear(), raw.clear()
        if doc_ids:
            yield row()
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(task, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)``: ``start`` counts the ids of all documents before this one.

    A segment knows its place in its part; the parts' starts are a running sum over one row per part, which
    are as many as the tasks that wrote (some bytes each, so they are broadcast and the payloads stay put).
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begin = totals.select("part", F.coalesce(earlier, F.lit(0)).alias("_begin"))

    def task(batches):
        for b in batches:
            for doc_ids, lengths, payload, start in zip(*(b.column(i) for i in range(4))):
                raw = decode_blocks(payload.as_py()).tobytes()
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                begins = ends - n
                ids = [raw[4 * a : 4 * e] for a, e in zip(begins.tolist(), ends.tolist())]
                cols = [doc_ids.values, pa.array(begins + start.as_py()), pa.array(n), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=_DOC_ARROW)

    placed = files.join(F.broadcast(begin), "part")
    return placed.select("doc_ids", "doc_tokens", "payload", (F.col("_begin") + F.col("before")).alias("start")).mapInArrow(task, DOC_SCHEMA)
