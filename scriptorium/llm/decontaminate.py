"""Benchmark items inside training documents, by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity, so signatures of whole documents would
lose it (see the README).  Here the item is sketched and the document is not: the sketch of an item is the
bottom of its shingle hashes, its length set by the item's size class so that an item contained to the
threshold must show one sketch element (pigeonhole).  Documents are searched for sketch elements by all of
their shingles, and hits are verified by exact containment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut
from . import hashing as H

_ITEM = "item long, n int, element long, rank int"
_ITEM_ARROW = pa.schema([("item", pa.int64()), ("n", pa.int32()), ("element", pa.int64()), ("rank", pa.int32())])
_HIT = "doc_id long, item_id long, n_item long, n_shared long"
_HIT_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())])
_BITS = 20  # of the table that turns most shingles away


def item_sets(items: DataFrame, words: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, n, element, rank)``: the shingles of every item; ``rank`` orders them by a second hash."""

    def task(batches):
        for b in batches:
            ids = np.asarray(b.column(0))
            for first, data, offsets in H.slices(b.column(1), 1 << 19):
                keys, row = H.shingle_sets(data, offsets, words)
                order = np.lexsort((H.mix(keys ^ np.uint64(0x5BD1E995)), row))
                keys, row = keys[order], row[order]
                size = np.bincount(row, minlength=len(offsets) - 1)
                begin = np.cumsum(size) - size
                rank = np.arange(len(row)) - begin[row]
                cols = [ids[first + row], size[row].astype(np.int32), keys.view(np.int64), rank.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_ITEM_ARROW)

    named = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    return named.mapInArrow(task, _ITEM)


class Index:
    """Items of one block, laid out for search; plain arrays, so that it can be sent to the tasks."""

    def __init__(self, item: np.ndarray, n: np.ndarray, element: np.ndarray, rank: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        self.ids, at = np.unique(item, return_index=True)
        self.size = n[at].astype(np.int64)
        owner = np.searchsorted(self.ids, item)
        sketch = rank <= n * (den - num) // den  # one more than may be missing
        order = np.argsort(element[sketch], kind="stable")
        self.sketch, self.sketch_item = element[sketch][order], owner[sketch][order]
        order = np.lexsort((element, owner))
        self.elements = element[order]
        self.first = np.searchsorted(owner[order], np.arange(len(self.ids) + 1))
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.sketch >> np.uint64(64 - _BITS)] = True

    def search(self, keys: np.ndarray, row: np.ndarray):
        """``(row, item index, shared)`` of the contained items; ``keys`` sorted by row and key."""
        if not len(keys) or not len(self.ids):
            return
        pick = np.flatnonzero(self.table[keys >> np.uint64(64 - _BITS)])
        low = np.searchsorted(self.sketch, keys[pick], side="left")
        n = np.searchsorted(self.sketch, keys[pick], side="right") - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs = np.unique(np.stack([np.repeat(row[pick], n), self.sketch_item[at]]), axis=1)
        begin = np.searchsorted(row, pairs[0], side="left")
        stop = np.searchsorted(row, pairs[0], side="right")
        for r, i, a, z in zip(*pairs.tolist(), begin.tolist(), stop.tolist()):
            item = self.elements[self.first[i] : self.first[i + 1]]
            place = np.minimum(np.searchsorted(keys[a:z], item), z - a - 1)
            shared = int((keys[a:z][place] == item).sum())
            if shared * self.den >= self.num * len(item):
                yield r, i, shared


def contained_items(
    docs: DataFrame, items: DataFrame, words: int = 5, num: int = 80, den: int = 100, block: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared)``: documents that hold at least ``num / den`` of an item's shingles.

    Words are runs without ASCII white space after lower-casing A-Z.  An item of fewer words than ``words``
    is one shingle, found in documents that consist of just these words.

    - One pass over the documents and no shuffle: the index of at most ``block`` item shingles (some 30 MB,
      counted before it is sent) goes to the tasks.  More items are dealt into such blocks, with a pass each.
    - Null and empty texts, of items or documents, hold nothing and are contained in nothing; rows with null
      ids are searched like others (documents) or left out (items).  Items that share an id count as the
      item of their joint shingles; repeated documents are reported once per row.  No items: no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for index in _blocks(item_sets(items, words, item_id, item_text), num, den, block):
        hits = _search(source, docs.sparkSession.sparkContext.broadcast(index), words)
        found = hits if found is None else found.unionByName(hits)
    return found


def _blocks(sets: DataFrame, num: int, den: int, block: int):
    """The items' sets as indexes of about ``block`` shingles (one, maybe empty, at least)."""
    sets = cut(sets)
    n_blocks = max(-(-sets.count() // block), 1)
    for i in range(n_blocks):
        part = sets.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == i).toPandas()
        part = part.drop_duplicates(["item", "element"])
        part["n"] = part.groupby("item")["element"].transform("size")
        part["rank"] = part.groupby("item")["rank"].rank(method="first").astype(int) - 1
        yield Index(part["item"].to_numpy(), part["n"].to_numpy(), part["element"].to_numpy(np.int64).view(np.uint64), part["rank"].to_numpy(), num, den)


def uncontaminated(
    docs: DataFrame, items: DataFrame, words: int = 5, num: int = 80, den: int = 100, block: int = 1_000_000,
    text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no item to ``num / den``; searched as in ``contained_items``, without a join."""
    at = docs.columns.index(text_col)
    for index in _blocks(item_sets(items, words, item_id, item_text), num, den, block):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def task(batches, shared=shared):
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for first, data, offsets in H.slices(b.column(at), 1 << 19):
                    keys, row = H.shingle_sets(data, offsets, words)
                    clean[[first + r for r, _, _ in shared.value.search(keys, row)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(task, docs.schema)
    return docs


def _search(source: DataFrame, index, words: int) -> DataFrame:
    def task(batches):
        at = index.value
        for b in batches:
            for first, data, offsets in H.slices(b.column(1), 1 << 19):
                keys, row = H.shingle_sets(data, offsets, words)
                hits = list(at.search(keys, row))
                if hits:
                    r, i, shared = (np.array(c, np.int64) for c in zip(*hits))
                    ids = b.column(0).take(pa.array(first + r))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(at.ids[i]), pa.array(at.size[i]), pa.array(shared)], schema=_HIT_ARROW)

    return source.mapInArrow(task, _HIT)
