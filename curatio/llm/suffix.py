"""Exact substring dedup by longest previous factors, spread over Spark (operator 9).

A byte goes if some 50-byte string that covers it also starts in a document of
smaller id.  No task ever sees the whole text:

1. Every 50-byte window is assigned to an anchor, a 20-byte string in it
   picked by content, so equal windows have equal anchors.  Anchors (about one
   in 16 bytes) are sent to the partition of their hash; each carries a hash
   of all bytes its windows cover.  Equal contexts in a smaller document settle
   all windows of an anchor at once; that is most repeated text.
2. Anchors that remain with several contexts send those bytes to the partition
   of the anchor.  There the suffixes are put in suffix order, and the longest
   previous factors, from the previous and next smaller document of each
   suffix, decide window by window.
3. Each document's marked windows meet its text and the bytes are cut.

Hot strings: a batch sends one row per anchor context and settles its own
further copies before the shuffle; an anchor with over ``HOT`` contexts is dealt
out by its single windows instead, again one row per window and batch.

Defined cases: null and empty texts have no bytes; a document without an id is
never cut and is no source; rows that share an id do not cut each other and are
each handled by their own text; texts under 50 bytes stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, shuffle_parts
from .suffix_core import GRAM, SPAN, WIDTH, anchors, repeated_starts
from .words import U64, RangeHash, buffers, chunks, mix64

HOT = 4096
CHUNK = 1 << 19
#: one anchor as it travels; the four low bytes of the key are enough inside a partition:
#: anchors that share them by chance have several contexts, whose bytes are compared
ANCHOR = np.dtype([("key", "<u4"), ("ctx", "<u8"), ("start", "<u4"), ("n", "u1")])
#: a document of a row: the step from the id before it, its tag and the number of its items
HEAD = np.dtype([("step", "<i8"), ("tag", "<i4"), ("count", "<i4")])
SPANS = np.dtype([("start", "<u4"), ("end", "<u4")])
ASK = np.dtype([("key", "<u8"), ("start", "<u4"), ("n", "u1"), ("hot", "?")])
CONTEXT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("start", "<u4"), ("n", "u1"), ("at", "u1")])
SENT = "part int, kind int, heads binary, items binary"


def planes(a: np.ndarray) -> bytes:
    """The records byte place by byte place: places that hardly vary lie together and the shuffle's compression drops them."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def records(blob: bytes, kind: np.dtype) -> np.ndarray:
    """The records of ``planes``."""
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals sorted by start, touching ones joined."""
    if not len(start):
        return start, end
    top = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > top[:-1]
    i = np.flatnonzero(new)
    return start[i], top[np.append(i[1:], len(start)) - 1]


def runs(*columns: np.ndarray) -> np.ndarray:
    """First places of the runs of equal rows."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def by_document(doc: np.ndarray, tag: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first places, counts) of documents and their items, grouped."""
    order = np.lexsort((items["start"], tag, doc))
    doc, tag, items = doc[order], tag[order], items[order]
    i = runs(doc, tag)
    return i, np.diff(np.append(i, len(doc))), np.stack([doc[i], tag[i]], axis=1) if len(i) else np.zeros((0, 2), np.int64), items


def _rows(part, kind, doc, tag, items) -> dict:
    _, counts, docs, items = by_document(doc, tag, items)
    heads = np.empty(len(docs), HEAD)
    heads["step"], heads["tag"], heads["count"] = np.diff(docs[:, 0], prepend=0), docs[:, 1], counts
    return {"part": part, "kind": kind, "heads": planes(heads), "items": planes(items)}


def _read(heads: bytes, items: bytes, kind: np.dtype):
    h = records(heads, HEAD)
    return np.repeat(np.cumsum(h["step"]), h["count"]), np.repeat(h["tag"].astype(np.int64), h["count"]), records(items, kind)


def _send_anchors(parts: int):
    """Anchors of a chunk by partition of their key; copies inside the chunk are settled here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text", CHUNK):
                ids, tags = piece.column("doc").to_numpy(), piece.column("tag").to_numpy().astype(np.int64)
                a = anchors(*buffers(piece.column("text")))
                doc = ids[a["text"]]
                both = mix64(a["key"] ^ (a["ctx"] * U64(0x9E3779B97F4A7C15)))
                order = np.lexsort((doc, both))
                first = runs(both[order])
                least = np.empty(len(doc), np.int64)
                least[order] = np.repeat(doc[order][first], np.diff(np.append(first, len(doc))))
                copy = doc > least
                out = []
                if copy.any():
                    s = a["start"][copy]
                    e = s + a["n"][copy] - 1 + WIDTH
                    spans = np.empty(len(s), SPANS)
                    spans["start"], spans["end"] = s, e
                    d, t = doc[copy], tags[a["text"][copy]]
                    for p in np.unique(d % parts):
                        m = d % parts == p
                        out.append(_rows(int(p), 0, d[m], t[m], spans[m]))
                keep = np.flatnonzero(~copy)
                where = ((a["key"][keep] >> U64(40)) % U64(parts)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                keep, where = keep[order], where[order]
                items = np.empty(len(keep), ANCHOR)
                items["key"] = a["key"][keep] & U64(0xFFFFFFFF)
                items["ctx"], items["start"], items["n"] = a["ctx"][keep], a["start"][keep], a["n"][keep]
                d, t = doc[keep], tags[a["text"][keep]]
                cuts = np.append(runs(where), len(where))
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    out.append(_rows(int(where[i]), 1, d[i:j], t[i:j], items[i:j]))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_SENT)
    return run


_SENT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("heads", pa.binary()), ("items", pa.binary())])
_LISTS = pa.schema([("doc", pa.int64()), ("tag", pa.int32()), ("gone", pa.binary()), ("asks", pa.binary())])
LISTS = "doc long, tag int, gone binary, asks binary"


def _lists(doc: np.ndarray, tag: np.ndarray, items: np.ndarray, spans: bool) -> pa.RecordBatch:
    """One row per document: its spans merged, or its questions."""
    i, counts, heads, items = by_document(doc, tag, items)
    ends = np.cumsum(counts)
    blobs = []
    for a, b in zip(ends - counts, ends, strict=True):
        x = items[a:b]
        if spans and len(x) > 1:
            s, e = merged(x["start"], x["end"])
            x = np.empty(len(s), SPANS)
            x["start"], x["end"] = s, e
        blobs.append(x.tobytes())
    none = [None] * len(blobs)
    return pa.RecordBatch.from_arrays([pa.array(heads[:, 0], pa.int64()), pa.array(heads[:, 1].astype(np.int32)),
                                       pa.array(blobs if spans else none, pa.binary()), pa.array(none if spans else blobs, pa.binary())], schema=_LISTS)


def _gather(batches: Iterator[pa.RecordBatch], kinds: dict[int, np.dtype]) -> dict[int, list]:
    got: dict[int, list] = {k: [[], [], []] for k in kinds}
    for batch in batches:
        for kind, h, x in zip(*(batch.column(k).to_pylist() for k in ("kind", "heads", "items")), strict=True):
            for to, what in zip(got[kind], _read(h, x, kinds[kind]), strict=True):
                to.append(what)
    return {k: [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(v, (np.int64, np.int64, kinds[k]), strict=True)] for k, v in got.items()}


def _settle_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of anchors: spans of contexts known from smaller documents, and open questions."""
    got = _gather(batches, {0: SPANS, 1: ANCHOR})
    doc, tag, spans = got[0]
    if len(doc):
        yield _lists(doc, tag, spans, True)
    doc, tag, x = got[1]
    if not len(doc):
        return
    key = x["key"].astype(U64)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    doc, tag, x, key = doc[again], tag[again], x[again], key[again]
    if not len(doc):
        return
    order = np.lexsort((doc, x["ctx"], key))
    doc, tag, x, key = doc[order], tag[order], x[order], key[order]
    ctx = x["ctx"]
    k0, c0 = runs(key), runs(key, ctx)
    k_of, c_of = np.repeat(np.arange(len(k0)), np.diff(np.append(k0, len(key)))), np.repeat(np.arange(len(c0)), np.diff(np.append(c0, len(key))))
    gone = doc > doc[c0][c_of]
    n_ctx = np.bincount(k_of[c0], minlength=len(k0))[k_of]
    several = (np.maximum.reduceat(doc, k0) > np.minimum.reduceat(doc, k0))[k_of]
    ask = ~gone & (n_ctx > 1) & several
    if gone.any():
        s = np.empty(gone.sum(), SPANS)
        s["start"] = x["start"][gone]
        s["end"] = s["start"] + x["n"][gone] - 1 + WIDTH
        yield _lists(doc[gone], tag[gone], s, True)
    if ask.any():
        q = np.empty(ask.sum(), ASK)
        q["key"], q["start"], q["n"], q["hot"] = key[ask], x["start"][ask], x["n"][ask], n_ctx[ask] > HOT
        yield _lists(doc[ask], tag[ask], q, False)


def _send_contexts(parts: int):
    """The bytes of open questions by partition of their anchor (hot ones window by window)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                buf, off = buffers(piece.column("text"))
                ids, tags = piece.column("doc").to_numpy(zero_copy_only=False), piece.column("tag").to_numpy(zero_copy_only=False)
                asked = [np.frombuffer(b"".join(v or []), ASK) for v in piece.column("asks").to_pylist()]
                sizes = [len(v) for v in asked]
                if not sum(sizes):
                    continue
                q, text = np.concatenate(asked), np.repeat(np.arange(len(sizes)), sizes)
                rh = RangeHash(buf)
                # the anchor of a question is that of its first window: found again by its hash
                hot = np.flatnonzero(q["hot"])
                cold = np.flatnonzero(~q["hot"])
                n_hot = q["n"][hot].astype(np.int64)
                each = np.repeat(hot, n_hot)
                step = np.arange(len(each)) - np.repeat(np.cumsum(n_hot) - n_hot, n_hot)
                first = off[:-1][text]
                start = np.concatenate([q["start"][cold].astype(np.int64), q["start"][each].astype(np.int64) + step])
                who = np.concatenate([text[cold], text[each]])
                n = np.concatenate([q["n"][cold].astype(np.int64), np.ones(len(each), np.int64)])
                key = np.concatenate([q["key"][cold], mix64(rh(first[each] + start[len(cold):], first[each] + start[len(cold):] + WIDTH))])
                at = _anchor_places(rh, off[:-1][who] + start, n)
                doc, tag = ids[who].astype(np.int64), tags[who].astype(np.int64)
                out, drop = [], np.zeros(len(n), bool)
                if len(each):     # one row per hot window: further copies in this batch are settled
                    h = np.arange(len(cold), len(n))
                    order = h[np.lexsort((doc[h], key[h]))]
                    i = runs(key[order])
                    least = np.repeat(doc[order][i], np.diff(np.append(i, len(order))))
                    drop[order] = doc[order] > least
                    if drop.any():
                        s = np.empty(drop.sum(), SPANS)
                        s["start"], s["end"] = start[drop], start[drop] + WIDTH
                        out.append(_rows(int(doc[drop][0] % parts), 0, doc[drop], tag[drop], s))
                c = np.empty(len(n), CONTEXT)
                c["key"], c["doc"], c["tag"], c["start"], c["n"], c["at"] = key, doc, tag, start, n, at
                begin = off[:-1][who] + start
                where = (mix64(key) % U64(parts)).astype(np.int64)
                where[drop] = -1
                order = np.argsort(where, kind="stable")
                cuts = np.append(runs(where[order]), len(order))
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    m = order[i:j]
                    if where[m[0]] < 0:
                        continue
                    size = n[m] + WIDTH - 1
                    base = np.cumsum(size) - size
                    take = np.arange(size.sum()) + np.repeat(begin[m] - base, size)
                    out.append({"part": int(where[m[0]]), "kind": 1, "heads": planes(c[m]), "items": buf[take].tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=_SENT)
    return run


def _anchor_places(rh: RangeHash, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distance of the anchor from the start of each run of windows: the leftmost least gram of its last window's reach."""
    best = np.full(len(begin), np.iinfo(np.uint64).max, U64)
    place = np.zeros(len(begin), np.int64)
    low = ~U64((1 << 24) - 1)
    for k in range(SPAN):
        p = begin + n - 1 + k       # grams of the last window; the anchor of a run lies in all its windows
        h = mix64((rh.sums[p + GRAM] - rh.sums[p]) * rh.inv[p]) & low
        less = h < best
        best[less], place[less] = h[less], (n - 1 + k)[less]
    return place


def _settle_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Longest previous factors inside one partition of contexts."""
    heads, bytes_ = [], []
    for batch in batches:
        for kind, h, x in zip(*(batch.column(k).to_pylist() for k in ("kind", "heads", "items")), strict=True):
            if kind == 0:
                yield _lists(*_read(h, x, SPANS), True)
            else:
                heads.append(records(h, CONTEXT))
                bytes_.append(np.frombuffer(x, np.uint8))
    if not heads:
        return
    c, buf = np.concatenate(heads), np.concatenate(bytes_)
    n = c["n"].astype(np.int64)
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n + WIDTH - 1, out=off[1:])
    i, w = repeated_starts(c["key"], c["doc"], c["at"].astype(np.int64), n, off, buf)
    if len(i):
        s = np.empty(len(i), SPANS)
        s["start"] = c["start"][i] + w
        s["end"] = s["start"] + WIDTH
        yield _lists(c["doc"][i], c["tag"][i].astype(np.int64), s, True)


def _cut(give: str):
    """What was counted of each text, with its kept bytes, its kept whole characters, or neither."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                counts, left = [[] for _ in range(4)], []
                for text, a, b in zip(*(piece.column(k).to_pylist() for k in ("text", "gone", "gone2")), strict=True):
                    raw = (text or "").encode()
                    x = np.frombuffer(b"".join([*(a or []), *(b or [])]), SPANS)
                    x = x[np.argsort(x["start"], kind="stable")]
                    s, e = merged(x["start"].astype(np.int64), x["end"].astype(np.int64))
                    rest = b"".join(raw[p:q] for p, q in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True)) if len(s) else raw
                    for to, v in zip(counts, (len(raw), len(raw) - len(rest), len(s), hashlib.sha256(rest).hexdigest()), strict=True):
                        to.append(v)
                    if give == "kept_bytes":
                        left.append(rest)
                    elif give == "kept_text":
                        left.append(None if text is None else rest.decode("utf-8", "ignore"))
                cols = [piece.column("doc"), piece.column("rest")] + [pa.array(v, pa.int64()) for v in counts[:3]] + [pa.array(counts[3], pa.string())]
                names = ["doc", "rest", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if give:
                    cols.append(pa.array(left, pa.binary() if give == "kept_bytes" else pa.string()))
                    names.append(give)
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def _applied(docs: DataFrame, id_col: str, text_col: str, rest: Column, give: str) -> DataFrame:
    """doc, rest, the counts and, if named, kept_bytes or kept_text; ``rest`` travels with each row."""
    base = docs.select(F.col(id_col).alias("doc"), F.hash(text_col).alias("tag"), F.col(text_col).alias("text"), rest.alias("rest"))
    parts = shuffle_parts(docs)
    sent = base.where("doc IS NOT NULL AND text IS NOT NULL").select("doc", "tag", "text").mapInArrow(_send_anchors(parts), SENT)
    lists = sent.repartitionById(parts, F.col("part")).mapInArrow(_settle_anchors, LISTS)
    lists = materialize(lists.groupBy("doc", "tag").agg(F.collect_list("gone").alias("gone"), F.collect_list("asks").alias("asks")))
    # both uses of this join read the same shuffled texts
    known = base.join(lists, ["doc", "tag"], "left")
    more = (known.mapInArrow(_send_contexts(parts), SENT).repartitionById(parts, F.col("part")).mapInArrow(_settle_contexts, LISTS)
            .groupBy("doc", "tag").agg(F.collect_list("gone").alias("gone2")))
    kind = base.schema["rest"].dataType.simpleString()
    return known.join(more, ["doc", "tag"], "left").mapInArrow(
        _cut(give), f"doc long, rest {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        + {"": "", "kept_bytes": ", kept_bytes binary", "kept_text": ", kept_text string"}[give])


def remove_earlier_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with_bytes) kept_bytes of every row."""
    give = "kept_bytes" if with_bytes else ""
    out = _applied(docs, id_col, text_col, F.lit(True), give)
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *([give] if give else []))


def without_earlier_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept bytes as text.  A character that loses some of its bytes goes with them; a null text stays null."""
    others = [c for c in docs.columns if c != text_col]
    out = _applied(docs, id_col, text_col, F.struct(*others), "kept_text")
    return out.select(*[F.col("kept_text").alias(c) if c == text_col else F.col(f"rest.{c}").alias(c) for c in docs.columns])
