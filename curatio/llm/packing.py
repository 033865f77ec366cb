"""Packing token sequences by shortest-pack-first over the length histogram (operator 7).

Documents are cut at multiples of the sequence length; only the pieces' lengths
matter after that.  Their histogram has at most ``seq_len`` entries, however
large the corpus, and is packed as a whole: lengths go longest first into the
pack pattern with the most room, and a pattern carries the number of sequences
that use it.  Patterns then meet the pieces again by rank among pieces of the
same length; ranks are counted inside hash buckets, so a length that a third
of all pieces share is still numbered by many tasks.

Defined cases: a null or empty text still has its end id and so one piece;
repeated rows are packed each on their own; a null doc_id is kept as such.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick, shuffle_parts
from .encode import encoded

SEQ_LEN = 2048


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, kind: str = "byte", seq_len: int = SEQ_LEN,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32-bit) and doc_tokens: every document's
    ids with ``end_id`` after them, cut into pieces of ``seq_len``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in encoded(batches, tokenizer_path, kind):
            rows = []
            for doc, raw in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                raw += end
                n = len(raw) // 4
                rows += [(doc, s, min(seq_len, n - s), raw[4 * s: 4 * (s + seq_len)], n) for s in range(0, n, seq_len)]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
                                             names=["doc_id", "start", "length", "ids", "doc_tokens"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long")


def pack_histogram(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[list[int], int]]:
    """Patterns (lengths, number of sequences) for a histogram length -> count."""
    room: dict[int, list[list]] = {}      # free places -> patterns still open, as (lengths, count)
    widest: list[int] = []                # heap of the keys of room, largest first
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            while widest and not room.get(-widest[0]):
                room.pop(-heapq.heappop(widest), None)
            free = -widest[0] if widest else 0
            if free >= length:            # the shortest pack that exists
                lengths, count = room[free].pop()
                if count > left:
                    room[free].append((lengths, count - left))
            else:
                free, lengths, count = seq_len, [], left
            taken = min(count, left)
            left -= taken
            to = free - length
            if to not in room:
                room[to] = []
                heapq.heappush(widest, -to)
            room[to].append(([*lengths, length], taken))
    return [p for patterns in room.values() for p in patterns]


def slots(patterns: list[tuple[list[int], int]], histogram: dict[int, int]) -> np.ndarray:
    """first, sequence, offset: pieces in (length, rank) order from ``first`` on go to the sequences
    from ``sequence`` on, at ``offset``."""
    base, at = {}, 0
    for length in sorted(histogram):
        base[length] = at
        at += histogram[length]
    rows, sequence = [], 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            rows.append((base[length], sequence, offset))
            base[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


def pack(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """``pieces`` (doc_id, start, length and any further columns) with sequence_id and offset."""
    buckets = shuffle_parts(pieces)
    pieces = materialize(pieces)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = materialize(dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}     # at most seq_len rows
    table = slots(pack_histogram(histogram, seq_len), histogram)
    first = dict(zip(sorted(histogram), np.cumsum([0] + [histogram[k] for k in sorted(histogram)]).tolist(), strict=False))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")
    counts = counts.select("length", "_bucket", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", F.xxhash64(*pieces.columns))) - 1
    ranked = dealt.withColumn("_inside", inside).join(counts, ["length", "_bucket"])
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("_inside").to_numpy() + b.column("_before").to_numpy() + np.array([first[x] for x in length.tolist()], np.int64)
            i = np.searchsorted(table[:, 0], rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(table[i, 1] + rank - table[i, 0]), pa.array(table[i, 2])],
                                             names=[*names, "sequence_id", "offset"])

    schema = pieces.schema.simpleString()[len("struct<"):-1]
    return ranked.mapInArrow(place, f"{schema},sequence_id:bigint,offset:bigint")


def sequences(packed: DataFrame, seq_len: int = SEQ_LEN, pad_id: int = 0) -> DataFrame:
    """sequence_id, tokens, ids: the packed ids of each sequence end to end, padded to ``seq_len`` unless
    the number of tokens is a power of two.  Needs the pieces' ids column; a sequence is at most ``seq_len`` ids."""
    pad = np.array([pad_id], "<u4").tobytes().hex()
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("x"))
    text = F.array_join(F.transform("x", lambda p: p["ids"]), "")
    power = F.bit_count("tokens") == 1
    return whole.select("sequence_id", "tokens", F.unhex(F.when(power, text).otherwise(F.rpad(text, 8 * seq_len, pad))).alias("ids"))
