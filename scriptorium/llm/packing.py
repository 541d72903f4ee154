"""Documents packed into training windows by the sum-of-squares rule."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .kept import trim

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Levels:
    """Open windows by fill level, and the rule that picks the level of the next piece.

    ``count[h]`` is the number of windows filled up to ``h``.  A piece goes where the sum of the squares
    of these counts grows least, which keeps every level stocked with few windows; equal choices go to
    the fullest window.
    """

    def __init__(self, window: int):
        self.window = window
        self.count = [0] * (window + 1)
        # how the sum of squares changes when a window leaves or joins a level; fullest level first, as ties go there
        self.leave = np.full(window + 1, 1 << 40, np.int64)
        self.join = np.ones(window + 1, np.int64)
        self.leave[window] = 0  # a new window leaves no level
        self.join[0] = 0  # a full window joins none
        self.open: dict[int, list[int]] = {}

    def _set(self, level: int, n: int) -> None:
        self.count[level] = n
        self.leave[self.window - level] = 1 - 2 * n if n else 1 << 40
        self.join[self.window - level] = 2 * n + 1

    def place(self, size: int) -> tuple[int | None, int]:
        """``(window to extend or None for a new one, its level)``; the caller then calls ``put``."""
        full = self.window - size
        level = full - int((self.leave[size:] + self.join[: full + 1]).argmin())
        if level == 0:
            return None, 0
        self._set(level, self.count[level] - 1)
        return self.open[level].pop(), level

    def put(self, window: int, level: int) -> None:
        if level < self.window:
            self._set(level, self.count[level] + 1)
            self.open.setdefault(level, []).append(window)


def recut(pieces: list, window: int):
    """The pieces of windows that stayed open, cut anew: full windows, then windows of powers of two.

    Yields ``(pieces of one window)``.
    """
    total = sum(p[2] for p in pieces)
    sizes = [window] * (total // window)
    rest = total % window
    sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    it = iter(pieces)
    have = None
    for size in sizes:
        out = []
        while size:
            doc, start, n, ids, all_ids = have or next(it)
            take = min(n, size)
            out.append((doc, start, take, ids[: 4 * take], all_ids))
            have = (doc, start + take, n - take, ids[4 * take :], all_ids) if take < n else None
            size -= take
        yield out


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``, one row per piece.

    Every document is its ids and ``end_id``.  Its full windows stand alone; the rest is placed by sum of
    squares among the open windows of the task.  Windows that are still open at the end of the task are
    cut anew, so that only windows of a power of two fall short and nothing is padded.

    No shuffle: a task packs the rows of its input split, holding the open windows only.
    Null and empty texts are the end id alone.  Null ids stay null; repeated rows are packed once each;
    an empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    end = np.array([end_id], "<u4").tobytes()

    def task(batches):
        enc = tokens.encoder(tokenizer, 150_000)  # packing follows other stages, whose JVM has grown
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        levels, held, last, rows, size = Levels(window), {}, 0, [], 0

        def emit(pieces):
            nonlocal last, size
            at = 0
            for doc, start, n, ids, all_ids in pieces:
                rows.append((doc, start, n, ids, all_ids, base + last, at))
                at += n
                size += len(ids)
            last += 1

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
            rows.clear()
            return out

        opened = 0
        for b in batches:
            ids_of = b.column(0)
            for first, texts in tokens.text_slices(b.column(1)):
                for i, ids in enumerate(enc.encode(texts)):
                    doc, ids = ids_of[first + i].as_py(), ids + end
                    n = len(ids) // 4
                    for at in range(0, n - window + 1, window):
                        emit([(doc, at, window, ids[4 * at : 4 * (at + window)], n)])
                    rest = n % window
                    if rest:
                        place, level = levels.place(rest)
                        if place is None:
                            place, opened = opened, opened + 1
                            held[place] = []
                        held[place].append((doc, n - rest, rest, ids[4 * (n - rest) :], n))
                        levels.put(place, level + rest)
                        if level + rest == window:
                            emit(held.pop(place))
                if size > 4 << 20:
                    yield batch()
                    size = 0
        for pieces in recut([p for w in held.values() for p in w], window):
            emit(pieces)
        if rows:
            yield batch()
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, SCHEMA)
