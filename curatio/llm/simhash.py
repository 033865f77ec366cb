"""SimHash near-duplicates by segment counts (operator 13).

A fingerprint bit is set if over half of a text's three-word shingles have it set in
their 64-bit hash.  Equal fingerprints are one node.  Every fingerprint maps to the
bit counts of its 32 two-bit segments, written in unary (0, 1 or 2 set places), so the
Manhattan distance of two count vectors is one bit count of an exclusive or; it never
exceeds the number of differing fingerprint bits.

The range join under that distance uses grid cells in subspaces: the segments lie in
``g`` groups, and two points at distance 3 or less differ in at most three groups, so
they agree on some choice of g - 3 of them.  A cell is such a choice with the exact
counts on it; a point lies in C(g, 3) cells.  g follows the number of nodes, so that
chance meetings stay in proportion to it; every g finds the same pairs.

A cell's pairs are never listed.  Its members first meet three of their own (smallest,
largest, smallest by hash); whoever passes the count bound and the exact check is
linked.  Cells that still hold several components after that are compared in bounded
blocks, across components only, and give one link per pair of components.

Defined cases: a text with fewer than three words is one shingle; null, empty and
white texts have fingerprint zero and link like any other; every row is a document of
its own, rows with equal ids or without an id included; a class is named by the ids
in it (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex64, materialize, pick, signed
from .components import components
from .words import U64, WordArrays, buffers, chunks, windows

WIDTH, SEED, BITS = 3, 42, 3
SEGMENTS = 32
BLOCK = 1024
#: chance meetings of a node in one choice of groups at most (about)
MEETINGS = 0.05
#: shingles whose bits are spread out at once
SLICE = 1 << 17

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOW = 0x5555555555555555


def shingle_hashes(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle (words joined by one space), text by text, and the n + 1 bounds."""
    buf, off = buffers(texts)
    w = WordArrays(buf, off)
    # the words of all texts, lower-cased, each followed by one space: a shingle is one slice
    length = w.end - w.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    inside = np.ones(int((length + 1).sum()), bool)
    inside[end] = False
    joined = np.full(len(inside), 0x20, np.uint8)
    joined[inside] = LOWER[buf[~w.white]]
    first, owner = windows(w.first, w.count, width)
    last = first + width - 1
    short = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(short):
        first = np.concatenate([first, w.first[:-1][short]])
        last = np.concatenate([last, w.first[1:][short] - 1])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        first, last, owner = first[order], last[order], owner[order]
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], SEED) for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)), U64, len(first))
    return h, np.searchsorted(owner, np.arange(len(off)))


def majority_bits(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each text: bits set in over half of its hashes; zero without any."""
    n = len(bounds) - 1
    count = np.zeros((n, 64), np.int64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    for at in range(0, len(h), SLICE):
        part, of = h[at: at + SLICE], owner[at: at + SLICE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        count[of[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    set_ = 2 * count > np.diff(bounds)[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view(U64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint as a signed long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                fp = majority_bits(*shingle_hashes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), pa.array(signed(fp))], names=["id", "fp"])

    return pick(docs, id=id_col, text=text_col).mapInArrow(run, "id long, fp long")


def segment_counts(fp: Column) -> Column:
    """Bit counts of the two-bit segments in unary: 00, 01 or 11."""
    high = F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseOR(high).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(high).bitwiseAND(F.lit(_LOW))
    return one.bitwiseOR(F.shiftleft(two, 1))


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def group_number(nodes: int) -> int:
    """Fewest groups (6 to 10) at which a node meets few others of a cell by chance.

    Two random segments hold equal counts in 3 of 8 cases."""
    for g in range(6, 10):
        if nodes * (3 / 8) ** (SEGMENTS * (g - BITS) / g) <= MEETINGS:
            return g
    return 10


def cell_masks(groups: int) -> list[int]:
    """For every choice of groups - 3 groups, the places of their segments, as signed longs."""
    of = np.arange(SEGMENTS) * groups // SEGMENTS
    out = []
    for left_out in combinations(range(groups), BITS):
        mask = sum(3 << (2 * s) for s in range(SEGMENTS) if of[s] not in left_out)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _links(members: DataFrame) -> DataFrame:
    """Exact links of members with three of their own cell: smallest, largest, smallest by hash."""
    spun = F.struct(F.xxhash64("fp").alias("h"), "fp", "u")
    heads = members.groupBy("t", "cell").agg(
        F.min(F.struct("fp", "u")).alias("h0"), F.max(F.struct("fp", "u")).alias("h1"), F.min(spun).alias("h2"))
    heads = heads.select("t", "cell", *[F.col(f"h{i}")[c].alias(f"{c}{i}") for i in range(3) for c in ("fp", "u")])
    near = members.join(heads, ["t", "cell"])
    meets = F.array(*[F.when((differing("u", f"u{i}") <= BITS) & (differing("fp", f"fp{i}") <= BITS) & (F.col("fp") != F.col(f"fp{i}")), F.col(f"fp{i}"))
                      for i in range(3)])
    return near.select("fp", F.explode(F.array_distinct(meets)).alias("b")).where("b IS NOT NULL").select(F.col("fp").alias("a"), "b").distinct()


def _open_blocks(members: DataFrame, found: DataFrame) -> DataFrame:
    """Links across components of cells that still hold several: one for each pair of components and block pair.

    Members of the component of a cell's smallest one meet only members of other
    components (minor ones); minor members meet all."""
    placed = members.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    cells = placed.groupBy("t", "cell").agg(F.min(F.struct("fp", "component")).alias("h"), F.min("component").alias("c0"),
                                            F.max("component").alias("c1"), F.count("*").alias("n")).where("c0 <> c1 AND n > 2")
    cells = cells.select("t", "cell", F.col("h")["component"].alias("of_head"))
    held = materialize(placed.join(cells, ["t", "cell"]).withColumn("minor", F.col("component") != F.col("of_head")))
    sizes = held.groupBy("t", "cell").agg(
        F.ceil(F.sum(F.col("minor").cast("long")) / BLOCK).cast("long").alias("n_minor"),
        F.ceil(F.sum((~F.col("minor")).cast("long")) / BLOCK).cast("long").alias("n_major"))
    o = held.join(sizes, ["t", "cell"]).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.when(F.col("minor"), F.col("n_minor")).otherwise(F.col("n_major"))))
    keep = ["t", "cell", "fp", "u", "component"]
    # x: a minor block; y: a minor block of no smaller number, or a major block as -1, -2, ...
    xs = o.where("minor").select(*keep, F.col("own").alias("x"), F.explode(F.concat(
        F.sequence(F.col("own"), F.col("n_minor") - 1), F.transform(F.sequence(F.lit(1).cast("long"), F.col("n_major")), lambda i: -i))).alias("y"))
    ys = o.select(*keep, "own", "minor", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0).cast("long"), F.col("own")))
                                                   .otherwise(F.sequence(F.lit(0).cast("long"), F.col("n_minor") - 1))).alias("x"))
    ys = ys.select("t", "cell", "x", F.when(F.col("minor"), F.col("own")).otherwise(-F.col("own") - 1).alias("y"),
                   F.col("fp").alias("fp_b"), F.col("u").alias("u_b"), F.col("component").alias("component_b"))
    met = xs.join(ys, (["t", "cell", "x", "y"])).where(
        (F.col("component") != F.col("component_b")) & (differing("u", "u_b") <= BITS) & (differing("fp", "fp_b") <= BITS))
    return met.groupBy(F.least("component", "component_b").alias("c0"), F.greatest("component", "component_b").alias("c1")).agg(
        F.min("fp").alias("a"), F.min("fp_b").alias("b")).select(F.col("c0").alias("a"), F.col("c1").alias("b"))


def classes(nodes: DataFrame, groups: int | None = None) -> DataFrame:
    """fp, component (smallest fingerprint reachable over steps of three differing bits) for distinct fingerprints ``fp``."""
    nodes = nodes.select("fp", segment_counts(F.col("fp")).alias("u"))
    masks = cell_masks(groups or group_number(nodes.count()))
    points = nodes.select("fp", "u", F.posexplode(F.array(*[F.col("u").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "cell"))
    shared = points.groupBy("t", "cell").agg(F.min("fp").alias("f0"), F.max("fp").alias("f1")).where("f0 <> f1").select("t", "cell")
    members = materialize(points.join(shared, ["t", "cell"], "left_semi"))
    links = materialize(_links(members))
    found = materialize(components(links).withColumnRenamed("id", "fp"))
    across = materialize(_open_blocks(members, found))
    joined = components(links.unionByName(across)).withColumnRenamed("id", "fp")
    return nodes.select("fp").join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row: documents whose fingerprints
    differ in three bits or fewer are linked; a component is named by its smallest id."""
    marked = materialize(fingerprints(docs, id_col, text_col))
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("rep")))
    placed = nodes.join(classes(nodes, groups), "fp")
    names = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = placed.join(names, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias("doc_id"), hex64(F.col("fp")).alias("fingerprint"), "component_id")
