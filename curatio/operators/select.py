"""Thresholds, histograms and the two iterative selectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder, stored
from .rank import global_rank, rank_ids
from .simjoin import hits, near_groups, radius_of, sim_chunks, side_groups, similar_pairs, size_of, split_sides, stack, usable


# ---------------------------------------------------------------- thresholds

def above(df: DataFrame, t: float, col: str = "reward_score") -> DataFrame:
    """Keep rows strictly above ``t``."""
    return df.filter(F.col(col) > F.lit(t))


def below(df: DataFrame, t: float, col: str = "reward_score") -> DataFrame:
    """Keep rows strictly below ``t``."""
    return df.filter(F.col(col) < F.lit(t))


def score_histogram(df: DataFrame, col: str) -> DataFrame:
    """Rows per ``(floor, ceil)`` bucket and their share of all rows.

    The grand total is a scalar subquery (a partial count evaluated once),
    not an unpartitioned window or a join."""
    b = (df.filter(F.col(col).isNotNull())
         .groupBy(F.floor(col).cast("long").alias("lower"), F.ceil(col).cast("long").alias("upper"))
         .agg(F.count(F.lit(1)).alias("n")))
    total = df.filter(F.col(col).isNotNull()).agg(F.count(F.lit(1))).scalar()
    return b.select("lower", "upper", "n", (F.col("n") / total).alias("share"))


# ------------------------------------------------------ greedy diverse filter

#: rows of the first chunk of ranked rows and of the largest one (each is twice the one before)
FIRST_CHUNK, LAST_CHUNK = 2048, 1 << 20
#: rows of a batch up to which whole batches share a group
BATCH_GROUP = 4096
#: edges (two longs) that one task settles in rank order
SETTLE_EDGES = 1 << 20


def _after_batch_mates(rows: DataFrame, batch_size: int, tau: float, metric: str) -> DataFrame:
    """rk of rows similar to any earlier row of their own batch."""
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rk")
        x, batch, out = stack(pdf["v"]), pdf["batch"].to_numpy(), np.zeros(len(pdf), bool)
        place = np.arange(len(pdf))
        for i0, i1, s in sim_chunks(x, x, metric):
            earlier = (batch[None, :] == batch[i0:i1, None]) & (place[None, :] < place[i0:i1, None])
            out[i0:i1] = ((s > tau) & earlier).any(1)
        return pd.DataFrame({"rk": pdf["rk"][out]})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        """One block pair of rows of large batches."""
        left, right, _ = split_sides(pdf)
        later = [np.zeros(0, np.int64)]
        if len(left) and len(right):
            la, lb, ra, rb = (p[c].to_numpy() for p in (left, right) for c in ("id", "batch"))
            for i0, i1, s in sim_chunks(stack(left["v"]), stack(right["v"]), metric):
                i, j = np.nonzero((s > tau) & (lb[i0:i1, None] == rb[None, :]) & (la[i0:i1, None] != ra[None, :]))
                later.append(np.unique(np.maximum(la[i0:i1][i], ra[j])))
        return pd.DataFrame({"rk": np.unique(np.concatenate(later))})

    some = usable(rows, "rk", "v", metric).withColumnRenamed("id", "rk").join(rows.select("rk", "batch"), "rk")
    if batch_size <= BATCH_GROUP:
        group = F.floor(F.col("batch") / F.lit(max(1, BATCH_GROUP // batch_size)))
        return some.groupBy(group.alias("g")).applyInPandas(kernel, "rk long")
    dealt = near_groups(some.withColumnRenamed("rk", "id"), radius_of(tau, metric), metric)
    return dealt.groupBy("_pair").applyInPandas(across, "rk long").distinct()


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows that go, of a bounded set of edges (later, earlier) that is complete up to some rank."""
    pdf = pdf.sort_values(["later", "earlier"])
    out: set[int] = set()
    for later, earlier in zip(pdf["later"].tolist(), pdf["earlier"].tolist(), strict=True):
        if later not in out and earlier not in out:
            out.add(later)
    return pd.DataFrame({"rk": sorted(out)}, dtype="int64")


def settle(edges: DataFrame, limit: int = SETTLE_EDGES) -> DataFrame:
    """rk of the rows that go: a row goes once an earlier neighbour is kept, and is kept once all of them went.

    Few edges are settled by one task, in rank order.  More of them go through rounds: a
    row with no earlier neighbour left is kept, its later neighbours go, and so do all their
    edges.  A round that leaves over half of the edges (a long chain of rows, each like the one
    before) is followed by one task that settles the first ranks, up to ``limit`` edges,
    so every round is of use.  Only counts (256 of them for the ranks) reach the driver."""
    spark = edges.sparkSession
    edges, gone = stored(edges.select("later", "earlier")), []
    n = edges.count()
    while n > limit:
        kept = edges.select(F.col("earlier").alias("k")).distinct().join(edges.select(F.col("later").alias("k")).distinct(), "k", "left_anti")
        out = stored(edges.join(kept, edges["earlier"] == kept["k"], "left_semi").select(F.col("later").alias("rk")).distinct())
        edges, gone, left = *_without(edges, out, gone), n
        n = edges.count()
        if n > max(limit, left // 2):
            upto = _prefix(edges, limit)
            first = edges.where(F.col("later") < upto)
            out = stored(first.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_in_order, "rk long"))
            # rows of the prefix that stay rule out their later neighbours
            stay = edges.where((F.col("earlier") < upto) & (F.col("later") >= upto)).join(out.withColumnRenamed("rk", "earlier"), "earlier", "left_anti")
            out = stored(out.unionByName(stay.select(F.col("later").alias("rk")).distinct()))
            edges, gone = _without(edges.where(F.col("later") >= upto), out, gone)
            n = edges.count()
    if n:
        gone.append(edges.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_in_order, "rk long"))
    return reduce(DataFrame.unionByName, gone, spark.createDataFrame([], "rk long"))


def _without(edges: DataFrame, out: DataFrame, gone: list) -> tuple[DataFrame, list]:
    """Edges between rows that have not gone, stored, and the list of what went."""
    for end in ("later", "earlier"):
        edges = edges.join(out.withColumnRenamed("rk", end), end, "left_anti")
    return stored(edges.select("later", "earlier")), gone + [out]


def _prefix(edges: DataFrame, limit: int) -> int:
    """A rank below which the rows' edges are at most about ``limit`` and at least those of one row."""
    lo, hi = edges.agg(F.min("later"), F.max("later")).first()
    while True:
        width = max(1, -(-(hi - lo + 1) // 256))
        slot = F.floor((F.col("later") - lo) / width)
        counts = dict(edges.where(F.col("later") <= hi).groupBy(slot.alias("s")).count().collect())     # 256 numbers
        total, upto = 0, None
        for s in range(256):
            total += counts.get(s, 0)
            if total > limit:
                break
            upto = lo + (s + 1) * width
        if upto is not None:
            return upto
        if width == 1:
            return lo + 1
        hi = lo + width - 1


def greedy_diverse(scored: DataFrame, tau: float, data_size: int = -1, batch_size: int = 1,
                   id_col: str = "id", score_col: str = "final_score", vec_col: str = "embedding",
                   metric: str = "cosine", chunk_rows: int | None = None) -> DataFrame:
    """F2/F3 score-first diversity filter, settled on executors chunk by chunk.

    Rule: rows by ``score desc, id``; row 0 is kept, each later batch of
    ``batch_size`` rows keeps a row unless it is similar (``> tau``) to a kept row
    of an earlier batch or to *any* earlier row of its own batch; stop at
    ``data_size`` kept rows (-1 = all).

    Whether a row stays depends on earlier rows only, so chunks of whole batches, each
    twice as long as the one before, go through three steps: rows like a kept row of
    an earlier chunk go (``hits``), rows like an earlier row of their batch go, and
    what remains gives a table of (later, earlier) edges that ``settle`` decides.
    All of it is joins of blocks on executors; counts alone reach the driver, and
    chunks after the ``data_size``-th kept row are never opened.

    Output: ``id_col, score_col, rk`` (priority position) and ``sel_rank``
    (0-based order of selection)."""
    spark = scored.sparkSession
    base = scored.select(F.col(id_col).alias("id"), F.col(score_col).cast("double").alias("score"), F.col(vec_col).cast("array<double>").alias("v"))
    kind = base.schema["id"].dataType.simpleString()
    # falling score as rising keys: NULL last, NaN first
    order = rank_ids(base, "id", [F.col("score").isNull(), ~F.isnan("score"), -F.col("score")])
    batch = F.when(F.col("rk") == 0, F.lit(0)).otherwise(F.lit(1) + F.floor((F.col("rk") - 1) / F.lit(batch_size))).cast("long")
    ranked = stored(base.join(order, "id").withColumn("batch", batch).repartitionByRange("rk").sortWithinPartitions("rk"))
    n, dim = size_of(ranked, "v")
    n_kept, at, step = 0, 0, chunk_rows or FIRST_CHUNK
    schema, kept_path = f"id {kind}, score double, rk long, v array<double>", new_folder(spark)
    while at < n and (data_size < 0 or n_kept < data_size):
        to = 1 + -(-max(at + step - 1, 0) // batch_size) * batch_size          # chunks end with a batch
        chunk = ranked.where((F.col("rk") >= at) & (F.col("rk") < to))
        free = chunk
        if n_kept:
            vectors = spark.read.schema(schema).parquet(kept_path).select(F.col("rk").alias("id"), "v")
            ruled_out = hits(chunk.select(F.col("rk").alias("id"), "v"), vectors, tau, metric, sizes=(to - at, n_kept, dim))
            free = free.join(ruled_out.withColumnRenamed("id", "rk"), "rk", "left_anti")
        if batch_size > 1:
            free = free.join(_after_batch_mates(chunk, batch_size, tau, metric), "rk", "left_anti")
        left = to - at
        if n_kept or batch_size > 1:
            free = stored(free)
            left = free.count()         # often far fewer than the chunk's rows
        pairs = similar_pairs(free, tau, "rk", "v", metric, size=(left, dim)).select(F.col("id_b").alias("later"), F.col("id_a").alias("earlier"))
        stays = free.join(settle(pairs), "rk", "left_anti")
        stays.select("id", "score", "rk", "v").write.mode("append").parquet(kept_path)
        n_kept = spark.read.schema(schema).parquet(kept_path).count()
        at, step = to, chunk_rows or min(2 * step, LAST_CHUNK)
    if not n_kept:
        return spark.createDataFrame([], f"`{id_col}` {kind}, `{score_col}` double, rk long, sel_rank long")
    kept = spark.read.schema(schema).parquet(kept_path)
    places = global_rank(kept.select("rk"), ["rk"], "sel_rank")
    out = kept.select(F.col("id").alias(id_col), F.col("score").alias(score_col), "rk").join(places, "rk")
    out = out.where(F.col("sel_rank") < data_size) if data_size > -1 else out
    return out.select(id_col, score_col, "rk", "sel_rank")


# ------------------------------------------------------------ k-center greedy

#: bytes of the vectors of candidates that one job of the exact k-center brings to the driver
CANDIDATE_BYTES = 1 << 20
#: bytes of vectors of one group of the coreset, and of its last one
CORESET_BYTES = 16 << 20


def kcenter_greedy(df: DataFrame, n_picks: int, id_col: str = "id", vec_col: str = "embedding",
                   seeds=None, seed_id=None) -> DataFrame:
    """F4 k-center greedy (Euclidean), exact.

    Without ``seeds`` the first pick is ``seed_id`` (default: lowest id) and
    counts as one of ``n_picks``; with seeds, distances start from the
    seeds and ``n_picks`` new rows follow them.  Every pick is the row
    farthest from its nearest centre, lowest id on ties.

    A job folds the last centres into the stored distances and brings the rows
    farthest from any centre (``CANDIDATE_BYTES`` of vectors).  Distances only
    fall, so the last of them bounds every row left behind: picks are made among the
    candidates, with their distances kept up to date, as long as the best of them still
    lies above that bound.  One job thus settles one pick or several.
    Stops early if every row is already a centre (max distance 0); a seed
    id that no row has is an error.

    Output: ``id_col, pick`` (0-based pick order; seeds first).
    """
    from ..functions.vectors import euclidean

    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    src = stored(df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")))
    picks: list = list(seeds or [])
    if not picks:
        first = F.min("id") if seed_id is None else F.min(F.when(F.col("id") == F.lit(seed_id), F.col("id")))
        start = src.agg(first).first()[0]
        if start is None and seed_id is not None:
            raise KeyError(f"no row has the seed id {seed_id!r}")
        picks = [] if start is None or n_picks < 1 else [start]
        n_picks -= 1
    found = {r["id"]: r["v"] for r in src.filter(F.col("id").isin(picks)).collect()} if picks else {}
    if len(found) < len(set(picks)):
        raise KeyError(f"no row has the seed ids {sorted(set(picks) - set(found))}")
    fresh, cur, goal = [found[p] for p in picks], src.withColumn("min_dist", F.lit(None).cast("double")), len(picks) + n_picks
    most = None
    while picks and len(picks) < goal:
        nearest = [euclidean(F.col("v"), F.lit(list(v))) for v in fresh]
        cur = stored(cur.withColumn("min_dist", F.least("min_dist", *nearest)))
        most = most or max(1, CANDIDATE_BYTES // (8 * max(1, len(fresh[0]))))
        rows = cur.where("min_dist > 0").orderBy(F.desc("min_dist"), "id").limit(min(most, 4 * (goal - len(picks)))).collect()
        if not rows:
            break
        x, d = np.array([r["v"] for r in rows], float), np.array([r["min_dist"] for r in rows])
        whole, fresh = len(rows) < min(most, 4 * (goal - len(picks))), []
        bound, last = d[-1], len(rows) - 1          # rows come by falling distance, then id
        while len(picks) < goal:
            best = int(d.argmax())
            if d[best] <= 0 or not (whole or d[best] > bound or (d[best] == bound and best <= last)):
                break
            picks.append(rows[best]["id"])
            fresh.append(rows[best]["v"])
            # summed in order, as the expression does: the same distances to the last bit
            d = np.minimum(d, np.sqrt(np.cumsum((x - x[best]) ** 2, axis=1)[:, -1]))
    return spark.createDataFrame([(p, i) for i, p in enumerate(picks)], f"`{id_col}` {kind}, pick long")


def _farthest_first(x: np.ndarray, k: int) -> list[int]:
    """Places of k rows of ``x``, the first one and then each the farthest from those before (first of equals)."""
    picks, far = [0], np.full(len(x), np.inf)
    while len(picks) < min(k, len(x)):
        far = np.minimum(far, np.sqrt(np.cumsum((x - x[picks[-1]]) ** 2, axis=1)[:, -1]))
        best = int(far.argmax())
        if far[best] <= 0:
            break
        picks.append(best)
    return picks


def _group_centres(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        picks = _farthest_first(stack(pdf["v"]), k)
        return pdf.iloc[picks][["id", "v"]].assign(pick=np.arange(len(picks)))
    return run


def group_of(id_col: str, groups: int) -> "F.Column":
    """A portable hash group of an id: any engine can recompute it."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(groups))


def kcenter_coreset(df: DataFrame, n_picks: int, id_col: str = "id", vec_col: str = "embedding", group_rows: int | None = None) -> DataFrame:
    """F4 for large pick numbers: greedy centres of every hash group, then greedy over their union.

    Each step covers within twice the best radius of its rows, so the result covers all rows within
    four times the best radius of ``n_picks`` centres (composable coresets).  A union
    that is larger than a group is grouped again.  The work is rows times picks over
    all executors in one pass, where the exact mode makes passes.  Groups are bounded by
    ``group_rows`` (default: ``CORESET_BYTES`` of vectors, at least two picks' worth).

    Output: ``id_col, pick`` (0-based pick order from the lowest id on)."""
    src = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    kind = src.schema["id"].dataType.simpleString()
    n, dim = size_of(src, "v")
    rows = group_rows or max(2 * n_picks, CORESET_BYTES // (8 * dim))
    first = rows
    while n > rows:
        groups = -(-n // first)
        src = stored(src.groupBy(group_of("id", groups).alias("g")).applyInPandas(_group_centres(n_picks), f"id {kind}, v array<double>, pick long").select("id", "v"))
        before, n = n, src.count()
        if n > before // 2:                 # too many picks for the group size: larger groups
            first *= 2
        rows = max(rows, min(2 * n_picks, n))
        if n == before:
            break
    one = src.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_group_centres(n_picks), f"id {kind}, v array<double>, pick long")
    return one.select(F.col("id").alias(id_col), "pick")


def covering_radius(df: DataFrame, centres: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """One row: the largest distance of a row to its nearest centre (nearest centres by ``bipartite_topk``'s blocks)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("v IS NOT NULL")
    c = rows.join(centres.select(F.col(id_col).alias("id")), "id", "left_semi")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        best = np.full(len(a), np.inf)
        if len(a) and len(b):
            for i0, i1, d in sim_chunks(stack(a["v"]), stack(b["v"]), "euclidean"):
                best[i0:i1] = d.min(1)
        return pd.DataFrame({"id": a["id"], "d": best})

    near = side_groups(rows, c, "euclidean", None, None, 1).groupBy("_lb", "_rb").applyInPandas(kernel, f"id {rows.schema['id'].dataType.simpleString()}, d double")
    return near.groupBy("id").agg(F.min("d").alias("d")).agg(F.max("d").alias("radius"))
