"""MinHash near-duplicates from b-bit signatures (operator 4).

One Arrow pass hashes the distinct five-word shingles of each whole text with
128 functions.  Four minima make a band; documents that share a band are
candidates.  The low two bits of every minimum are packed into four longs; for
a candidate the bits are compared by a bit count and corrected for chance
agreement, and only likely pairs reach the exact check on the full sets.

Links are found without listing a bucket's pairs.  Texts with the same word
sequence are one node.  First, each member of a bucket is compared with the
bucket's smallest id.  Then buckets that still hold more than one component are
searched in bounded blocks of packed signatures, only across components: a bit
count of an exclusive or per pair, no text.  Likely pairs are distinct over all
bands and verified one by one.  Two blocks with more than a few likely pairs a member
are compared by their full sets at once instead, and return a spanning set of the links.

Defined cases: a null or empty text has no shingles and no links; rows that
share a doc_id are one document; a null doc_id is never linked, its component
is null and it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, signed
from .components import components
from .words import (LOWER_CODE, U64, RangeHash, WordArrays, buffers, chunks, mix64, owner_keys, random_odd, shingles)

HASHES, ROWS, BITS = 128, 4, 2
BANDS = HASHES // ROWS
LONGS = HASHES * BITS // 64
#: members of a bucket in one block (packed signatures only), and of them those whose sets are compared at once
BLOCK, SETS = 1024, 256
#: likely pairs for each member of two blocks beyond which the blocks are compared as sets
CROWD = 4
_MULT, _ADD = random_odd(HASHES, 11), random_odd(HASHES, 12)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes text by text, the n + 1 bounds, and two hashes of each whole word sequence."""
    buf, off = buffers(texts)
    n = len(off) - 1
    w = WordArrays(buf, off)
    word_hash = RangeHash(buf, LOWER_CODE)(w.start, w.end)
    h, owner = shingles(w, word_hash, width)
    key, _ = owner_keys(h, owner, n)
    order = np.argsort(key)
    h, owner, key = h[order], owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    h, owner = h[new], owner[new]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    place = (np.arange(len(word_hash)) - np.repeat(w.first[:-1], w.count)).astype(U64)
    whole = []
    for seed in (21, 22):
        c = random_odd(2, seed)
        sums = np.zeros(len(word_hash) + 1, U64)
        np.cumsum(mix64(word_hash * c[0] + place * c[1]), out=sums[1:])
        whole.append(mix64(sums[w.first[1:]] - sums[w.first[:-1]] + w.count.astype(U64)))
    return h, bounds, np.stack(whole, axis=1)


def minima(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES x n minima; columns of empty sets are left at the largest value."""
    n = len(bounds) - 1
    out = np.full((HASHES, n), np.iinfo(np.uint32).max, np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        at = bounds[full]
        for k in range(HASHES):
            out[k, full] = np.minimum.reduceat(((h * _MULT[k] + _ADD[k]) >> U64(32)).astype(np.uint32), at)
    return out


def pack(mins: np.ndarray) -> np.ndarray:
    """LONGS x n longs of the low BITS bits of each minimum."""
    low = (mins & np.uint32((1 << BITS) - 1)).astype(U64)
    per = 64 // BITS
    out = np.zeros((LONGS, mins.shape[1]), U64)
    for k in range(HASHES):
        out[k // per] |= low[k] << U64(BITS * (k % per))
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, two hashes of the word sequence, packed low bits s0.. and the band hashes."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, bounds, whole = shingle_sets(part.column("text"))
                mins = minima(h, bounds)
                bits = pack(mins)
                bands = np.empty((BANDS, len(bounds) - 1), U64)
                for b in range(BANDS):
                    x = np.full(len(bounds) - 1, b + 1, U64)
                    for k in range(ROWS):
                        x = mix64(x * U64(0x9E3779B97F4A7C15) + mins[b * ROWS + k])
                    bands[b] = x
                flat = pa.array(signed(np.ascontiguousarray(bands.T)).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bounds)) * BANDS, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(signed(whole[:, 0].copy())),
                     pa.array(signed(whole[:, 1].copy()))] + [pa.array(signed(b)) for b in bits] + [lists],
                    names=["id", "n_shingles", "w0", "w1"] + [f"s{i}" for i in range(LONGS)] + ["bands"])

    return pick(docs, id=id_col, text=text_col).mapInArrow(
        sign, "id long, n_shingles long, w0 long, w1 long, " + ", ".join(f"s{i} long" for i in range(LONGS)) + ", bands array<long>")


def estimated_similarity(a: str = "a", b: str = "b") -> F.Column:
    """Share of equal low bits, corrected for the 2**-BITS that agree by chance."""
    def differing(i: int) -> F.Column:
        x = F.col(f"{a}_s{i}").bitwiseXOR(F.col(f"{b}_s{i}"))
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        return F.bit_count(folded)

    equal = 1 - sum((differing(i) for i in range(LONGS)), F.lit(0)) / F.lit(float(HASHES))
    chance = 2.0 ** -BITS
    return (equal - chance) / (1 - chance)


def linked(inter, size_a, size_b, percent: int):
    """100 * intersection >= percent * union, in integers."""
    return 100 * inter >= percent * (size_a + size_b - inter)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text_a"):
                for sub in chunks(part, "text_b"):
                    n = sub.num_rows
                    both = pa.concat_arrays([sub.column("text_a").cast(pa.large_string()), sub.column("text_b").cast(pa.large_string())])
                    h, bounds, _ = shingle_sets(both)
                    size = np.diff(bounds)
                    pair = np.repeat(np.arange(2 * n) % max(n, 1), size)
                    key, _ = owner_keys(h, pair, n)
                    order = np.argsort(key)
                    twice = key[order][1:] == key[order][:-1]
                    inter = np.bincount(pair[order][1:][twice], minlength=n)
                    ok = linked(inter, size[:n], size[n:], percent) & (size[:n] > 0)
                    yield pa.RecordBatch.from_arrays([sub.column("a").filter(pa.array(ok)), sub.column("b").filter(pa.array(ok))], names=["a", "b"])
    return run


def common_counts(hx: np.ndarray, ox: np.ndarray, nx: int, hy: np.ndarray, oy: np.ndarray, ny: int) -> np.ndarray:
    """Sizes of all intersections of two small lists of sets, given as hashes and their owners."""
    inter = np.zeros((nx, ny), np.float32)
    shared = np.intersect1d(hx, hy)
    for at in range(0, len(shared), 4096):     # columns of the incidence matrices, a slice at a time
        some = shared[at: at + 4096]
        m = []
        for h, o, n in ((hx, ox, nx), (hy, oy, ny)):
            j = np.searchsorted(some, h)
            hit = some[np.minimum(j, len(some) - 1)] == h
            a = np.zeros((n, len(some)), np.float32)
            a[o[hit], j[hit]] = 1
            m.append(a)
        inter += m[0] @ m[1].T
    return inter.astype(np.int64)


def sets_of_many(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and bounds of any number of texts, hashed in slices: beside the texts only the sets are held whole."""
    pieces = [shingle_sets(part.column("text"))[:2] for part in chunks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text")]
    sizes = [np.diff(bounds) for _, bounds in pieces]
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])
    return np.concatenate([np.zeros(0, U64), *[h for h, _ in pieces]]), bounds


def _search_blocks(percent: int):
    """Exact links across components between two blocks, as a spanning set."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "side", "text"])
        sides = []
        for side in (0, 1):
            rows = pdf[pdf.side == side]
            h, bounds = sets_of_many(pa.array(rows.text, pa.large_string()))
            sides.append((rows.id.to_numpy(), rows.component.to_numpy(), h, bounds))
        root: dict[int, int] = {}
        out: list[tuple[int, int]] = []

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        (ix, cx, hx, bx), (iy, cy, hy, by) = sides
        for p in range(0, len(ix), SETS):
            for q in range(0, len(iy), SETS):
                px, py = bx[p: p + SETS + 1], by[q: q + SETS + 1]
                sx, sy, kx, ky = np.diff(px), np.diff(py), cx[p: p + SETS], cy[q: q + SETS]
                inter = common_counts(hx[px[0]: px[-1]], np.repeat(np.arange(len(sx)), sx), len(sx), hy[py[0]: py[-1]], np.repeat(np.arange(len(sy)), sy), len(sy))
                ok = linked(inter, sx[:, None], sy[None, :], percent) & (sx[:, None] > 0) & (kx[:, None] != ky[None, :])
                i, j = np.nonzero(ok)
                pairs = pd.DataFrame({"a": ix[p + i], "b": iy[q + j], "lo": np.minimum(kx[i], ky[j]), "hi": np.maximum(kx[i], ky[j])})
                for a, b, lo, hi in pairs.drop_duplicates(["lo", "hi"]).itertuples(index=False):
                    lo, hi = find(lo), find(hi)
                    if lo != hi:
                        root[max(lo, hi)] = min(lo, hi)
                        out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def _block_tasks(o: DataFrame) -> DataFrame:
    """Members of open buckets dealt to tasks (band, x, y): a minor block x (side 0) against a minor block of no
    smaller number or a major block (side 1; y = -1, -2, ...).  Blocks hold about BLOCK members."""
    sizes = o.groupBy("band").agg(
        F.ceil(F.sum(F.col("minor").cast("long")) / BLOCK).cast("long").alias("n_minor"),
        F.ceil(F.sum((~F.col("minor")).cast("long")) / BLOCK).cast("long").alias("n_major"))
    o = o.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("n_minor")).otherwise(F.col("n_major"))))
    keep = ["id", "component", *[f"s{i}" for i in range(LONGS)]]
    xs = o.where("minor").select("band", F.col("own").alias("x"), F.explode(F.concat(
        F.sequence(F.col("own"), F.col("n_minor") - 1), F.transform(F.sequence(F.lit(1).cast("long"), F.col("n_major")), lambda i: -i))).alias("y"),
        F.lit(0).alias("side"), *keep)
    zero = F.lit(0).cast("long")
    ys = o.select("band", F.explode(F.when(F.col("minor"), F.sequence(zero, F.col("own"))).otherwise(F.sequence(zero, F.col("n_minor") - 1))).alias("x"),
                  F.when(F.col("minor"), F.col("own")).otherwise(-F.col("own") - 1).alias("y"), F.lit(1).alias("side"), *keep)
    return xs.unionByName(ys)


def _likely_pairs(low: float):
    """Arrow kernel of one task: its likely pairs across components, or one row without ids if they are more than CROWD a member."""
    odd = U64(0x5555555555555555)

    def run(task: pa.Table) -> pa.Table:
        side = task.column("side").to_numpy() == 0
        ids, of = task.column("id").to_numpy(), task.column("component").to_numpy()
        differ = np.zeros((int(side.sum()), int((~side).sum())), np.int16)
        for i in range(LONGS):
            bits = task.column(f"s{i}").to_numpy().view(U64)
            x = bits[side][:, None] ^ bits[~side][None, :]
            differ += np.bitwise_count((x | (x >> U64(1))) & odd)
        chance = 2.0 ** -BITS
        likely = ((1 - differ / HASHES) - chance) / (1 - chance) >= low
        a, b = np.nonzero(likely & (of[side][:, None] != of[~side][None, :]))
        many = len(a) > CROWD * task.num_rows
        pairs = [pa.nulls(1, pa.int64())] * 2 if many else [pa.array(ids[side][a]), pa.array(ids[~side][b])]
        n = len(pairs[0])
        keys = [pa.array(np.full(n, task.column(k)[0].as_py())) for k in ("band", "x", "y")]
        return pa.Table.from_arrays([*keys, *pairs], names=["band", "x", "y", "a", "b"])
    return run


def _crowded_links(tasks: DataFrame, crowded: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links across components in the tasks with many likely pairs, by their full sets."""
    keys = ["band", "x", "y"]
    rows = tasks.join(crowded, keys, "left_semi").select(*keys, "side", "id", "component").join(texts, "id")
    return rows.groupBy(keys).applyInPandas(_search_blocks(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                    margin: float = 0.25) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    margin: a pair whose estimate lies more than this under the threshold (over
    five standard deviations of the estimate) is not checked exactly."""
    sig = materialize(signatures(docs, id_col, text_col))
    real = sig.where("n_shingles > 0 AND id IS NOT NULL")
    # one node per word sequence: its smallest id
    first = real.groupBy("w0", "w1").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    copies = real.select("id", "w0", "w1").join(first.where("rep <> last"), ["w0", "w1"]).where("id <> rep")
    same = copies.select(F.col("rep").alias("a"), F.col("id").alias("b"))
    nodes = real.groupBy("w0", "w1").agg(F.min(F.struct("id", *[f"s{i}" for i in range(LONGS)], "bands")).alias("x")).select("x.*")
    nodes = materialize(nodes)

    rows = nodes.select("id", F.explode("bands").alias("band"))
    heads = rows.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head <> tail")
    members = materialize(rows.join(heads.select("band", "head"), "band"))
    low = percent / 100 - margin
    bits = nodes.select("id", *[f"s{i}" for i in range(LONGS)]).distinct()

    def side(k: str) -> DataFrame:
        return bits.select(F.col("id").alias(k), *[F.col(f"s{i}").alias(f"{k}_s{i}") for i in range(LONGS)])

    pairs = members.where("head <> id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    likely = materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(estimated_similarity() >= low).select("a", "b").distinct())

    # texts of documents that share a bucket, once
    texts = pick(docs, id=id_col, text=text_col).join(members.select("id").distinct(), "id", "left_semi")
    texts = materialize(texts)
    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    verified = materialize(likely.join(ta, "a").join(tb, "b").mapInArrow(_verify(percent), "a long, b long"))

    found = materialize(components(verified))
    placed = members.join(found, "id", "left").select("band", "id", "head", F.coalesce("component", "id").alias("component"))
    headed = placed.where("id = head").select("band", F.col("component").alias("head_component")).distinct()
    mixed = placed.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n")).where("c0 <> c1 AND n > 2")
    # minor: not in the component of the bucket's first member; major members need comparing with minor ones only
    open_ = placed.join(mixed.select("band"), "band").join(headed, "band").select(
        "band", "id", "component", (F.col("component") != F.col("head_component")).alias("minor"))
    open_ = materialize(open_.join(bits, "id"))
    tasks = materialize(_block_tasks(open_))
    met = materialize(tasks.groupBy("band", "x", "y").applyInArrow(_likely_pairs(low), "band long, x long, y long, a long, b long"))
    # blocks where many pairs look alike are compared as sets at once, the pairs of the others one by one
    crowded = met.where("a IS NULL").select("band", "x", "y")
    sparse = met.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = materialize(sparse).join(ta, "a").join(tb, "b").mapInArrow(_verify(percent), "a long, b long")
    links = verified.unionByName(same).unionByName(more)
    if not crowded.isEmpty():
        links = links.unionByName(_crowded_links(tasks, crowded, texts, percent))
    links = materialize(links.distinct())

    final = components(links)
    return (sig.select(F.col("id").alias("doc_id"), "n_shingles").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
                    F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")))
