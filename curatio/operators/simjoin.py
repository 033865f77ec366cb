"""Vector joins with metric pruning (C3 theta join, C4 kNN, C11 top-k, greedy hits).

A table that fits one block (``auto_block_rows``) is one group.  Beyond that, rows
are filed under the nearest of a few pivots picked from the data, with their
distance to it, and a pivot's rows are cut into blocks: rings of equal numbers of
rows by that distance, a ring of too many equal distances by a hash of the id.  A
row is sent to another block only if the triangle inequality leaves a row there
within its radius: its distance to the block's pivot must not lie further than the
radius outside the block's ring, nor its distance from the plane halfway to that
pivot (all rows of the block lie beyond it) exceed the radius.  Cosine is filed as the
Euclidean distance of unit vectors.  Both tests are lower bounds with a slack for
rounding, so the result equals the full product at every size; kernels compute the
similarities they report on the vectors as they are.

The radius is fixed by the threshold (C3), or per row by the k-th distance inside the
row's own block (C4) or one near block (C11), which bounds the true one.

Blocks hold about ``block_rows`` rows whatever the key skew; one block pair is one
Arrow group multiplied in numpy, in chunks of
``CHUNK_ROWS`` left rows (fewer beside a long block).  A kernel
emits hits, flags or local top-k, never the dense product.  Distances kept apart by
a threshold (the Manhattan quirk of ``similarity``) have no radius: all block pairs meet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

DEFAULT_BLOCK_ROWS = None       # None: sized from the dimension
CHUNK_ROWS, CHUNK_CELLS = 1024, 1 << 21
BLOCK_BYTES = 1 << 26
#: pivots at most, and bytes of the sample of vectors that they are picked from on the driver
MAX_PIVOTS, SAMPLE_BYTES = 256, 8 << 20


def auto_block_rows(dim: int) -> int:
    return int(min(16384, max(512, BLOCK_BYTES // (8 * max(1, dim)))))


def size_of(df: DataFrame, vec_col: str) -> tuple[int, int]:
    """(rows, dimension) in one aggregate."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    return int(r["n"]), int(r["d"] or 1)


def sim_chunks(a: np.ndarray, b: np.ndarray, metric: str, chunk: int | None = None):
    """(start, end, similarity of a[start:end] to all of b), chunk by chunk."""
    chunk = chunk or max(16, min(CHUNK_ROWS, CHUNK_CELLS // max(1, len(b))))
    if metric == "cosine":
        b = l2_normalise(b)
        for i in range(0, a.shape[0], chunk):
            yield i, min(i + chunk, a.shape[0]), l2_normalise(a[i:i + chunk]) @ b.T
    elif metric == "euclidean":
        bb = (b * b).sum(1)[None, :]
        for i in range(0, a.shape[0], chunk):
            yield i, min(i + chunk, a.shape[0]), _distances(a[i:i + chunk], b, bb)
    else:
        for i in range(0, a.shape[0], chunk):
            yield i, min(i + chunk, a.shape[0]), similarity(a[i:i + chunk], b, metric)


# ------------------------------------------------------------ filing by pivots

@dataclass
class Filing:
    """Pivots, and of every block its pivot, its ring of distances and the largest radius of its rows."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    slack: float

    def lower_bounds(self, x: np.ndarray) -> np.ndarray:
        """For each row of ``x`` and each block, a distance that no row of the block falls below."""
        d = similarity(x, self.pivots, "euclidean")
        home = d.argmin(1)
        gap = similarity(self.pivots, self.pivots, "euclidean")
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d * d - (d * d)[np.arange(len(x)), home][:, None]) / (2 * gap[home])
        plane[~np.isfinite(plane)] = 0.0
        out = np.maximum(d[:, self.cell] - self.high, self.low - d[:, self.cell])
        return np.maximum(out, plane[:, self.cell]) - self.slack


def _space(v: pd.Series, metric: str) -> np.ndarray:
    x = stack(v)
    return l2_normalise(x) if metric == "cosine" and len(x) else x


def spread_out(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows of a sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    picks, far = [0], np.full(len(sample), np.inf)
    while len(picks) < min(k, len(sample)):
        far = np.minimum(far, ((sample - sample[picks[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        picks.append(int(far.argmax()))
    return sample[picks]


def file_rows(df: DataFrame, n: int, dim: int, metric: str, block_rows: int) -> tuple[DataFrame, Filing]:
    """``df`` (id, v and other columns) stored with ``blk``, and the filing."""
    want = min(MAX_PIVOTS, math.ceil(n / block_rows))
    size = max(4 * want, min(16 * want, SAMPLE_BYTES // (8 * dim)))
    some = df.select("v").where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, n // size))) == 0).limit(2 * size)
    pivots = spread_out(_space(some.toPandas()["v"], metric), want)
    if not len(pivots):
        pivots = _space(df.select("v").limit(1).toPandas()["v"], metric)
    if not len(pivots):             # no rows at all: n is an upper bound
        one = np.zeros(1)
        return df.withColumn("blk", F.lit(0)), Filing(np.zeros((1, dim)), np.zeros(1, int), one, one, one.copy(), 0.0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", cell int, far double"

    def file_(frames):
        for pdf in frames:
            if len(pdf):
                d = similarity(_space(pdf["v"], metric), pivots, "euclidean")
                cell = d.argmin(1)
                yield pdf.assign(cell=cell.astype("int32"), far=d[np.arange(len(d)), cell])

    filed = stored(df.mapInPandas(file_, schema))
    # rings: a cell's rows cut at even quantiles of their distance to the pivot
    counts = {r["cell"]: r["n"] for r in filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = math.ceil(max(counts.values()) / block_rows)
    if most > 1:
        cuts = filed.groupBy("cell").agg(F.percentile_approx("far", [i / most for i in range(1, most)], 100 * most).alias("cuts"))
        filed = filed.join(cuts, "cell").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("far")))).drop("cuts")
        share = df.sparkSession.createDataFrame([(c, math.ceil(m / block_rows)) for c, m in counts.items()], "cell int, share int")
        filed = filed.join(share, "cell").withColumn("ring", F.floor(F.col("ring") * F.col("share") / F.lit(most)).cast("int")).drop("share")
    else:
        filed = filed.withColumn("ring", F.lit(0))
    rings = filed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()
    blocks, table = [], []
    for r in sorted(rings, key=lambda r: (r["cell"], r["ring"])):
        split = max(1, math.ceil(r["n"] / (1.5 * block_rows)))
        table.append((r["cell"], r["ring"], len(blocks), split))
        blocks += [(r["cell"], r["low"], r["high"])] * split
    numbers = df.sparkSession.createDataFrame(table, "cell int, ring int, _first int, _split int")     # one row a ring
    filed = filed.join(numbers, ["cell", "ring"]).withColumn("blk", (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_split"))).cast("int"))
    cell, low, high = (np.array(c) for c in zip(*blocks, strict=True))
    scale = 1.0 if metric == "cosine" else float(np.abs(pivots).max(initial=0) * math.sqrt(dim) + high.max())
    return (filed.drop("cell", "ring", "far", "_first", "_split"),
            Filing(pivots, cell.astype(int), low, high, np.zeros(len(cell)), 1e-6 * (1 + scale)))


def _wanted(filing: Filing, metric: str, both_ways: bool):
    """Kernel: the blocks in which a row may have a neighbour (``both_ways``: or be one of theirs)."""
    def run(frames):
        for pdf in frames:
            if len(pdf):
                lists = []
                radius = pdf["r"].to_numpy()
                for at in range(0, len(pdf), CHUNK_ROWS):
                    low = filing.lower_bounds(_space(pdf["v"].iloc[at:at + CHUNK_ROWS], metric))
                    reach = radius[at:at + CHUNK_ROWS, None]
                    near = low <= (np.maximum(reach, filing.radius) if both_ways else reach)
                    lists += [np.flatnonzero(row).astype("int32") for row in near]
                yield pdf.assign(to=lists)

    return run


def with_wanted(filed: DataFrame, filing: Filing, metric: str, both_ways: bool) -> DataFrame:
    """Adds ``to`` (blocks that a row has to meet) to rows with ``v`` and a radius ``r``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in filed.schema) + ", to array<int>"
    return filed.mapInPandas(_wanted(filing, metric, both_ways), schema)


def _pairs_of(wanted: DataFrame) -> DataFrame:
    """Rows with ``blk`` and ``to`` copied to the block pairs they have to meet (``_pair``, ``_side``, ``_diag``)."""
    d = wanted.withColumn("_oth", F.explode(F.array_distinct(F.concat("to", F.array("blk"))))).drop("to")
    low, high = F.least("blk", "_oth"), F.greatest("blk", "_oth")
    return (d.withColumn("_pair", F.shiftleft(low.cast("long"), 32) + high).withColumn("_side", (F.col("blk") != low).cast("int"))
            .withColumn("_diag", F.col("blk") == F.col("_oth")).drop("blk", "_oth"))


def _one_group(df: DataFrame) -> DataFrame:
    return df.withColumn("_pair", F.lit(0).cast("long")).withColumn("_side", F.lit(0)).withColumn("_diag", F.lit(True))


def _by_hash(df: DataFrame, blocks: int) -> DataFrame:
    """Every block pair, blocks by hash: for distances that no radius bounds."""
    blk = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    return _pairs_of(df.withColumn("blk", blk).withColumn("to", F.sequence(F.lit(0), F.lit(blocks - 1))))


def radius_of(tau: float, metric: str) -> float | None:
    """Euclidean distance of unit vectors within which a cosine lies above ``tau``."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * tau)) if metric == "cosine" else None


def near_groups(df: DataFrame, radius: float | None, metric: str, block_rows: int | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Rows (id, v, others) of a self-join dealt to block pairs that may hold rows within ``radius``.

    ``size``: rows (at most) and dimension, where the caller knows them."""
    n, dim = size or size_of(df, "v")
    rows = block_rows or auto_block_rows(dim)
    if n <= rows:
        return _one_group(df)
    if radius is None:
        return _by_hash(df, math.ceil(n / rows))
    filed, filing = file_rows(df, n, dim, metric, rows)
    filing.radius[:] = radius
    return _pairs_of(with_wanted(filed.withColumn("r", F.lit(float(radius))), filing, metric, True)).drop("r")


def pruning_figures(df: DataFrame, radius: float, metric: str, block_rows: int, id_col: str = "id", vec_col: str = "embedding") -> dict:
    """How much of the full blocked product a self-join within ``radius`` does: rows sent and block pairs met, as shares."""
    src = usable(df, id_col, vec_col, metric)
    n, dim = size_of(src, "v")
    filed, filing = file_rows(src, n, dim, metric, block_rows)
    filing.radius[:] = radius
    sent = _pairs_of(with_wanted(filed.withColumn("r", F.lit(float(radius))), filing, metric, True))
    met = sent.groupBy("_pair").agg(F.count_distinct("_side").alias("sides"), F.max(F.col("_diag").cast("int")).alias("diag"), F.count(F.lit(1)).alias("n"))
    r = met.agg(F.sum(((F.col("sides") > 1) | (F.col("diag") == 1)).cast("long")).alias("pairs"), F.sum("n").alias("rows")).first()
    b = len(filing.cell)
    return {"blocks": b, "pairs_met": r["pairs"] / (b * (b + 1) / 2), "rows_sent": r["rows"] / (n * b)}


def usable(df: DataFrame, id_col: str, vec_col: str, metric: str) -> DataFrame:
    """(id, v) of the rows that can have a hit: no NULL vector, for cosine no zero vector."""
    src = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("v IS NOT NULL")
    return src.where(F.exists("v", lambda x: x != 0)) if metric == "cosine" else src


def side_groups(left: DataFrame, right: DataFrame, metric: str, radius: float | None, block_rows: int | None,
                k: int | None = None, sizes: tuple[int, int, int] | None = None) -> DataFrame:
    """Two tables (id, v) dealt to (left block, right block) groups: ``_lb``, ``_rb``, ``_side``, id, v.

    A left row goes to the right blocks that may hold a row within its radius; with
    ``k`` the radius is at most its k-th smallest distance to one block of the cell it lies in.
    ``sizes``: rows of both (at most) and the dimension, where the caller knows them."""
    if sizes is None:
        sizes = (*size_of(left, "v"), *size_of(right, "v"))
        sizes = (sizes[0], sizes[2], max(sizes[1], sizes[3]))
    nl, nr, dim = sizes
    rows = block_rows or auto_block_rows(dim)
    lb = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(nl / rows)))).cast("int")
    left = left.withColumn("_lb", lb)
    cols = ["_lb", "_rb", "_side", "id", "v"]
    if nr <= rows or (radius is None and k is None):
        blocks = max(1, math.ceil(nr / rows))
        q = left.withColumn("to", F.sequence(F.lit(0), F.lit(blocks - 1)))
        d = right.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    else:
        d, filing = file_rows(right, nr, dim, metric, rows)
        q = left.withColumn("r", F.lit(float("inf") if radius is None else float(radius)))
        if k is not None:
            q = stored(_within_kth(q, d, filing, metric, k))
        q = with_wanted(q, filing, metric, False)
    sent = q.select("_lb", F.explode("to").alias("_rb"), F.lit(0).alias("_side"), "id", "v")
    meet = sent.select("_lb", "_rb").distinct()
    back = d.withColumnRenamed("blk", "_rb").join(meet, "_rb").withColumn("_side", F.lit(1))
    return sent.select(cols).unionByName(back.select(cols))


def _within_kth(q: DataFrame, d: DataFrame, filing: Filing, metric: str, k: int) -> DataFrame:
    """``q`` with ``r`` lowered to the k-th smallest distance to the rows of one block near each row."""
    def nearest_block(frames):
        first = {c: i for i, c in reversed(list(enumerate(filing.cell.tolist())))}
        for pdf in frames:
            if len(pdf):
                home = similarity(_space(pdf["v"], metric), filing.pivots, "euclidean")
                home[:, [c for c in range(home.shape[1]) if c not in first]] = np.inf
                yield pdf.assign(_rb=np.array([first[c] for c in home.argmin(1).tolist()], "int32"))

    at = q.mapInPandas(nearest_block, f"id {q.schema['id'].dataType.simpleString()}, v {q.schema['v'].dataType.simpleString()}, _lb int, r double, _rb int")
    at = at.withColumn("_side", F.lit(0))
    back = (d.select(F.col("blk").alias("_rb"), "id", "v").join(at.select("_lb", "_rb").distinct(), "_rb")
            .withColumn("r", F.lit(0.0)).withColumn("_side", F.lit(1)))
    cols = ["_lb", "_rb", "_side", "id", "v", "r"]

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        qs, ds = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        reach = qs["r"].to_numpy().copy()
        if len(qs) and len(ds) >= k:
            for i0, i1, dist in sim_chunks(_space(qs["v"], metric), _space(ds["v"], metric), "euclidean"):
                reach[i0:i1] = np.minimum(reach[i0:i1], np.partition(dist, k - 1, axis=1)[:, k - 1] + filing.slack)
        return qs[["id", "v", "_lb"]].assign(r=reach)

    return at.select(cols).unionByName(back.select(cols)).groupBy("_lb", "_rb").applyInPandas(
        bound, f"id {q.schema['id'].dataType.simpleString()}, v {q.schema['v'].dataType.simpleString()}, _lb int, r double")


def stack(vectors: pd.Series) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors.values])


def l2_normalise(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _distances(a: np.ndarray, b: np.ndarray, bb: np.ndarray) -> np.ndarray:
    """Euclidean distances, given the squared lengths of b; two arrays of the product's size at most."""
    out, product = (a * a).sum(1)[:, None] + bb, a @ b.T
    product *= 2.0
    out -= product
    return np.sqrt(np.maximum(out, 0.0, out=out), out=out)


def similarity(a: np.ndarray, b: np.ndarray, metric: str, normalise: bool = True) -> np.ndarray:
    """cosine similarity, or Manhattan *distance* of the rows scaled to length 1
    (``normalise=False``: as they are), compared with the same ``> tau`` rule as
    the reference, which keeps far rows apart: a kept quirk."""
    if metric == "cosine":
        return l2_normalise(a) @ l2_normalise(b).T
    if metric == "manhattan":
        if normalise:
            a, b = l2_normalise(a), l2_normalise(b)
        out = np.empty((a.shape[0], b.shape[0]))
        step = max(1, 2_000_000 // max(1, b.shape[0] * max(1, a.shape[1])))
        for i in range(0, a.shape[0], step):
            out[i:i + step] = np.abs(a[i:i + step, None, :] - b[None, :, :]).sum(-1)
        return out
    if metric == "euclidean":
        return _distances(a, b, (b * b).sum(1)[None, :])
    raise ValueError("metric must be cosine, manhattan or euclidean")


def split_sides(pdf: pd.DataFrame):
    """(left rows, right rows, diagonal?) for one block-pair group."""
    diag = bool(pdf["_diag"].iloc[0])
    if diag:
        return pdf, pdf, True
    return pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1], False


def similar_pairs(df: DataFrame, tau: float, id_col: str = "id", vec_col: str = "embedding",
                  metric: str = "cosine", block_rows: int | None = DEFAULT_BLOCK_ROWS,
                  chunk_rows: int | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Every unordered pair ``(id_a < id_b)`` with similarity ``> tau``.

    The output is the answer (its size is the number of hits); NaN
    similarities (zero vectors) are never hits."""
    src = near_groups(usable(df, id_col, vec_col, metric), radius_of(tau, metric), metric, block_rows, size)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, diag = split_sides(pdf)
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"id_a": [], "id_b": [], "sim": []})
        la = left["id"].to_numpy()
        rb = right["id"].to_numpy()
        out_a, out_b, out_s = [], [], []
        for i0, i1, s in sim_chunks(stack(left["v"]), stack(right["v"]), metric, chunk_rows):
            hit = s > tau
            if diag:
                hit &= la[i0:i1, None] < rb[None, :]
            i, j = np.nonzero(hit)
            a, b = la[i0:i1][i], rb[j]
            out_a.append(np.minimum(a, b))
            out_b.append(np.maximum(a, b))
            out_s.append(s[i, j])
        return pd.DataFrame({"id_a": np.concatenate(out_a), "id_b": np.concatenate(out_b),
                             "sim": np.concatenate(out_s)})

    return src.groupBy("_pair").applyInPandas(kernel, "id_a long, id_b long, sim double")


def knn_distance(df: DataFrame, i: int, id_col: str = "id", vec_col: str = "embedding",
                 block_rows: int | None = DEFAULT_BLOCK_ROWS,
                 chunk_rows: int | None = None) -> DataFrame:
    """Euclidean distance from each row to its i-th nearest neighbour,
    the row itself being the 0-th (so ``i = 0`` gives 0).

    The (i+1)-th smallest distance inside a row's own block bounds how far it is
    sent.  Each block pair then emits its local top-(i+1) per row; the merge keeps
    the (i+1)-th smallest over all blocks with a ranked window, which Spark
    limits per group before the shuffle (WindowGroupLimit)."""
    from pyspark.sql import Window

    k = i + 1
    src = usable(df, id_col, vec_col, "euclidean")
    n, dim = size_of(src, "v")
    rows = block_rows or auto_block_rows(dim)
    if n <= rows:
        src = _one_group(src)
    else:
        filed, filing = file_rows(src, n, dim, "euclidean", rows)
        filed = stored(_radius_in_block(filed, k, filing.slack, chunk_rows))
        for r in filed.groupBy("blk").agg(F.max("r").alias("r")).collect():       # one row a block
            filing.radius[r["blk"]] = r["r"]
        src = _pairs_of(with_wanted(filed, filing, "euclidean", True)).drop("r")

    def smallest(d):
        kk = min(k, d.shape[1])
        return np.take_along_axis(d, np.argpartition(d, kk - 1, axis=1)[:, :kk], axis=1)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, diag = split_sides(pdf)
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"id": [], "dist": []})
        lv, rv = stack(left["v"]), stack(right["v"])
        left_best = []
        right_best = None            # running k smallest per right row
        for i0, i1, d in sim_chunks(lv, rv, "euclidean", chunk_rows):
            if diag:
                d[np.arange(i1 - i0), np.arange(i0, i1)] = 0.0
            left_best.append(smallest(d))
            if not diag:
                cand = smallest(d.T)
                right_best = cand if right_best is None else smallest(np.hstack([right_best, cand]))
        lb = np.vstack(left_best)
        ids = [np.repeat(left["id"].to_numpy(), lb.shape[1])]
        vals = [lb.ravel()]
        if right_best is not None:
            ids.append(np.repeat(right["id"].to_numpy(), right_best.shape[1]))
            vals.append(right_best.ravel())
        return pd.DataFrame({"id": np.concatenate(ids), "dist": np.concatenate(vals)})

    cand = src.groupBy("_pair").applyInPandas(kernel, "id long, dist double")
    w = Window.partitionBy("id").orderBy("dist")
    return (cand.withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") == k)
            .select(F.col("id").alias(id_col), F.col("dist").alias(f"knn_{i}")))


def _radius_in_block(filed: DataFrame, k: int, slack: float, chunk_rows: int | None) -> DataFrame:
    """Adds ``r``: the k-th smallest distance of a row inside its block (infinite in a smaller block)."""
    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        x, out = stack(pdf["v"]), np.full(len(pdf), np.inf)
        if len(pdf) >= k:
            for i0, i1, d in sim_chunks(x, x, "euclidean", chunk_rows):
                out[i0:i1] = np.partition(d, k - 1, axis=1)[:, k - 1] + slack
        return pdf.assign(r=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in filed.schema) + ", r double"
    return filed.groupBy("blk").applyInPandas(bound, schema)


def topk_by_distance_then_id(dist: np.ndarray, col_ids: np.ndarray, k: int):
    """Per row, the ``k`` columns with the smallest (distance, id), as (rows, columns).

    NaN distances (zero vectors) are never hits.  One sort over all entries not
    beyond their row's k-th distance settles the ties of all rows at once."""
    if np.isnan(dist).any():
        dist = np.where(np.isnan(dist), np.inf, dist)
    kk = min(k, dist.shape[1])
    kth = np.partition(dist, kk - 1, axis=1)[:, kk - 1:kk]
    rows, cols = np.nonzero((dist <= kth) & np.isfinite(dist))
    order = np.lexsort((col_ids[cols], dist[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[place < kk], cols[place < kk]


def bipartite_topk(queries: DataFrame, docs: DataFrame, k: int, max_distance: float | None = None,
                   q_id: str = "query_id", d_id: str = "doc_id", vec_col: str = "embedding",
                   block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """C11: for every query vector the ``k`` nearest documents by cosine
    distance (``1 - cos``), optionally only those with distance ``<= max_distance``.

    Documents are filed by pivots, queries dealt to bounded blocks by hash.  A query
    meets one block of its own cell first, which bounds its radius, then every
    block that may hold a document within it; a group is one (query block, document block)
    and emits the local top-k per query, merged by a ranked window (limited per group
    before the shuffle).  Nothing is broadcast, so the query side may be as large
    as the corpus.
    Distances are rounded to 12 decimals, so exact copies tie and are
    ranked by id.  Output: ``query_id, doc_id, rank (1-based), distance``."""
    from pyspark.sql import Window

    radius = None if max_distance is None else math.sqrt(max(0.0, 2.0 * max_distance)) + 1e-6
    both = side_groups(usable(queries, q_id, vec_col, "cosine"), usable(docs, d_id, vec_col, "cosine"), "cosine", radius, block_rows, k)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        qs, ds = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        if len(qs) == 0 or len(ds) == 0:
            return pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})
        dids = ds["id"].to_numpy()
        parts_q, parts_d, parts_v = [], [], []
        qids = qs["id"].to_numpy()
        for i0, i1, s in sim_chunks(stack(qs["v"]), stack(ds["v"]), "cosine"):
            # rounded so that equal vectors tie exactly (the matrix product may
            # differ in the last bit by column position) and fall to the id order
            dist = np.round(1.0 - s, 12)
            r, c = topk_by_distance_then_id(dist, dids, k)
            parts_q.append(qids[i0:i1][r])
            parts_d.append(dids[c])
            parts_v.append(dist[r, c])
        return pd.DataFrame({"query_id": np.concatenate(parts_q), "doc_id": np.concatenate(parts_d),
                             "distance": np.concatenate(parts_v)})

    cand = both.groupBy("_lb", "_rb").applyInPandas(kernel, "query_id long, doc_id long, distance double")
    if max_distance is not None:
        cand = cand.filter(F.col("distance") <= F.lit(max_distance))
    w = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(F.col("query_id").alias(q_id), F.col("doc_id").alias(d_id),
                    F.col("rank").cast("long").alias("rank"), "distance"))


def hits(left: DataFrame, right: DataFrame, tau: float, metric: str, block_rows: int | None = DEFAULT_BLOCK_ROWS,
         sizes: tuple[int, int, int] | None = None) -> DataFrame:
    """Ids of ``left`` (id, v) with a similarity ``> tau`` to any row of ``right`` (id, v)."""
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        hit = np.zeros(len(a), bool)
        if len(a) and len(b):
            for i0, i1, s in sim_chunks(stack(a["v"]), stack(b["v"]), metric):
                hit[i0:i1] = (s > tau).any(1)
        return pd.DataFrame({"id": a["id"][hit]})

    both = side_groups(usable(left, "id", "v", metric), usable(right, "id", "v", metric), metric, radius_of(tau, metric), block_rows, sizes=sizes)
    return both.groupBy("_lb", "_rb").applyInPandas(kernel, "id long").distinct()
