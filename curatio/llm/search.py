"""Ranked lexical search, reversed (operator 11): documents stream through an index of the items.

The items' terms make an inverted index (term, postings of item and count) that is
broadcast; its size is checked (``INDEX_BYTES``) and a larger set of items is searched
in pieces of that size.  One Arrow pass looks every term of each whole text up in the
index and stores the counts found; the corpus figures (documents, terms, document
frequencies) are partial aggregates over those rows.  A second pass runs the stored
counts through the postings: 64-bit sums per (document, item) of a slice, and what
beats an item's floor goes into its bounded heap.  Heaps of all tasks are merged by
ranked windows, first in salted groups, then by item.

Defined cases: a null or empty text has no terms; a document or item without terms
gets no rows; every row is a document (or item) of its own, rows with equal ids
included; a document without an id counts in the corpus figures and is never listed;
fewer than ``k`` documents with a score above 0 give fewer rows; empty tables give none.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick
from .words import RangeHash, buffers, chunks, random_odd

#: bytes of item texts in one broadcast index (a single longer item is an index of its own)
INDEX_BYTES = 16 << 20
#: cells of a (documents, items) slice and postings added up at once
CELLS = 1 << 21
SALTS = 32

#: fixed values: a term is a run of these bytes (ASCII letters and digits, and every byte of other characters)
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def term_places(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every term of texts that lie end to end, and the text it belongs to."""
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    inside = TERM[buf]
    before, after = np.ones(len(buf), bool), np.ones(len(buf), bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def spread(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places first .. first + length of many ranges end to end, and each place's range."""
    of = np.repeat(np.arange(len(length)), length)
    return np.arange(len(of)) - (np.cumsum(length) - length)[of] + first[of], of


class ItemIndex:
    """Terms of a bounded set of items, ordered by hash, with their postings."""

    def __init__(self, texts: list[str | None]):
        buf, off = buffers(pa.array(texts, pa.large_string()))
        buf = LOWER[buf]
        start, end, item = term_places(buf, off)
        self.n_items, seed = len(texts), 1
        while True:          # another code if two different terms share a hash
            self.code = random_odd(256, seed)
            h = RangeHash(buf, self.code)(start, end)
            self.hash, first, term = np.unique(h, return_index=True, return_inverse=True)
            self.buf, self.start, self.length = buf, start[first], (end - start)[first]
            if self._same(buf, start, end, term).all():
                break
            seed += 1
        key, times = np.unique(term * max(1, self.n_items) + item, return_counts=True)
        self.item, self.times = key % max(1, self.n_items), times
        self.first = np.searchsorted(key // max(1, self.n_items), np.arange(len(self.hash) + 1))

    def _same(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether each range of ``buf`` (lower case) holds exactly its index term."""
        ok = (end - start) == self.length[term]
        at = np.flatnonzero(ok)
        mine, of = spread(start[at], self.length[term[at]])
        theirs, _ = spread(self.start[term[at]], self.length[term[at]])
        ok[at[np.unique(of[buf[mine] != self.buf[theirs]])]] = False
        return ok

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, and (text, index term, occurrences) of the terms the index holds."""
        buf, off = buffers(texts)
        buf = LOWER[buf]
        start, end, doc = term_places(buf, off)
        n = np.bincount(doc, minlength=len(off) - 1)
        if not len(self.hash) or not len(start):
            return n, *(np.zeros(0, np.int64),) * 3
        h = RangeHash(buf, self.code)(start, end)
        term = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[term] == h)
        hit = hit[self._same(buf, start[hit], end[hit], term[hit])]
        key, tf = np.unique(doc[hit] * len(self.hash) + term[hit], return_counts=True)
        return n, key // len(self.hash), key % len(self.hash), tf


def _count(index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                n, doc, term, tf = index.counts(part.column("text"))
                bounds = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").cast(pa.int64()), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(bounds, pa.array(term, pa.int32())),
                     pa.ListArray.from_arrays(bounds, pa.array(tf, pa.int32()))], names=["id", "n", "terms", "tfs"])
    return run


def term_weight(n_docs: int, df: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1))), in doubles."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Heaps:
    """The k best (score, id) of each item; ``floor`` and ``last`` are what a newcomer has to beat."""

    def __init__(self, n_items: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n_items)]
        self.floor = np.zeros(n_items, np.int64)
        self.last = np.full(n_items, np.iinfo(np.int64).min)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: (documents, items)."""
        doc, item = np.nonzero((scores > self.floor) | ((scores == self.floor) & (scores > 0) & (ids[:, None] < self.last)))
        s, i = scores[doc, item], ids[doc]
        order = np.lexsort((i, -s, item))
        item, s, i = item[order], s[order], i[order]
        best = np.arange(len(item)) - np.searchsorted(item, item) < self.k
        for t, x in zip(item[best].tolist(), zip(s[best].tolist(), (-i[best]).tolist(), strict=True), strict=True):
            heap = self.rows[t]
            if len(heap) < self.k:
                heapq.heappush(heap, x)
            else:
                heapq.heappushpop(heap, x)
        for t in np.unique(item).tolist():
            if len(self.rows[t]) == self.k:
                self.floor[t], self.last[t] = self.rows[t][0][0], -self.rows[t][0][1]


def _score(index: ItemIndex, weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Arrow kernel: stored counts through the postings into one task's heaps."""
    length = np.diff(index.first)
    value = index.times * np.repeat(weight, length)          # weight of each posting
    width = max(1, index.n_items)

    def slices(doc: np.ndarray, work: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Ranges of documents of bounded cells and postings (a document alone may have more)."""
        upto = np.concatenate([[0], np.cumsum(np.bincount(doc, work, n).astype(np.int64))])
        at = 0
        while at < n:
            to = min(int(np.searchsorted(upto, upto[at] + CELLS, side="right")) - 1, at + max(1, CELLS // width), n)
            to = max(to, at + 1)
            yield at, to
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(index.n_items, k)
        for batch in batches:
            ids, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n"))
            lists = batch.column("terms")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            term = lists.values.to_numpy()[bounds[0]: bounds[-1]]
            tf = batch.column("tfs").values.to_numpy()[bounds[0]: bounds[-1]].astype(np.int64)
            bounds = bounds - bounds[0]
            doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
            m = 75 + (25 * n * n_docs) // n_terms
            part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
            for at, to in slices(doc, length[term], len(ids)):
                e = slice(bounds[at], bounds[to])
                posting, of = spread(index.first[term[e]], length[term[e]])
                scores = np.zeros((to - at) * width, np.int64)
                np.add.at(scores, (doc[e][of] - at) * width + index.item[posting], part[e][of] * value[posting])
                heaps.add(scores.reshape(to - at, width), ids[at:to])
        rows = [(t, s, -i) for t, heap in enumerate(heaps.rows) for s, i in heap]
        item, score, doc_id = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(doc_id, pa.int64())],
                                         names=["item", "score", "doc_id"])
    return run


def _pieces(items: DataFrame) -> list[list]:
    """Numbers of rows of items, one list a piece, dealt by size so that a piece keeps to INDEX_BYTES."""
    n = 1
    while True:
        piece = F.pmod(F.xxhash64("row"), F.lit(n))
        sizes = items.groupBy(piece.alias("piece")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        if all(r["size"] <= INDEX_BYTES or r["n"] == 1 for r in sizes):
            return [items.where(piece == r["piece"]) for r in sizes]
        n *= 2


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of every item, equal scores by rising id."""
    spark = docs.sparkSession
    asked = materialize(pick(items, id=item_col, text=item_text_col).where("text IS NOT NULL")
                        .withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.octet_length("text").cast("long")))
    source = pick(docs, id=id_col, text=text_col)
    found = None
    for piece in _pieces(asked):
        rows = piece.orderBy("row").collect()                     # at most INDEX_BYTES of texts, or one item
        index = ItemIndex([r["text"] for r in rows])
        shared = spark.sparkContext.broadcast(index)
        counted = materialize(source.mapInArrow(lambda b, s=shared: _count(s.value)(b), "id long, n long, terms array<int>, tfs array<int>"))
        total = counted.agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["terms"]:
            continue
        weight = np.zeros(len(index.hash), np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():      # a row for each term of the index
            weight[r["t"]] = term_weight(total["docs"], r["count"])
        held = counted.where("id IS NOT NULL AND size(terms) > 0")
        best = held.mapInArrow(lambda b, s=shared, w=weight, t=total: _score(s.value, w, t["docs"], t["terms"], k)(b),
                               "item int, score long, doc_id long")
        names = spark.createDataFrame([(i, r["row"], r["id"]) for i, r in enumerate(rows)], f"item int, row long, item_id {asked.schema['id'].dataType.simpleString()}")
        part = best.join(names, "item")
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = asked.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")

    def top(df: DataFrame, *keys) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    merged = top(top(found, "row", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).drop("rank"), "row")
    return merged.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
