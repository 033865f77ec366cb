import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatio.operators import select as SEL
from curatio.operators import simjoin as SJ


def vecs(spark, rows):
    return spark.createDataFrame(rows, "id long, final_score double, embedding array<double>")


def _unit(deg):
    r = math.radians(deg)
    return [math.cos(r), math.sin(r)]


@pytest.fixture
def chain(spark):
    # sims: (1,2) ~.94 and (2,3) ~.94 above tau .9; (1,3) ~.77 below
    return vecs(spark, [(1, 9.0, _unit(0)), (2, 8.0, _unit(20)), (3, 7.0, _unit(40))])


def sel_ids(df):
    return [r.id for r in df.orderBy("sel_rank").collect()]


@pytest.mark.parametrize("rows", [None, 1, 2])
def test_f2_batch1_keeps_rows_1_and_3(chain, rows):
    assert sel_ids(SEL.greedy_diverse(chain, tau=0.9, chunk_rows=rows)) == [1, 3]


@pytest.mark.parametrize("rows", [None, 1, 2])
def test_f3_batch2_drops_row_3_with_its_batch_mate(chain, rows):
    assert sel_ids(SEL.greedy_diverse(chain, tau=0.9, batch_size=2, chunk_rows=rows)) == [1]


@pytest.mark.parametrize("rows", [None, 1, 2])
def test_f2_data_size(chain, rows):
    assert sel_ids(SEL.greedy_diverse(chain, tau=0.9, data_size=0, chunk_rows=rows)) == []
    assert sel_ids(SEL.greedy_diverse(chain, tau=0.9, data_size=1, chunk_rows=rows)) == [1]
    assert sel_ids(SEL.greedy_diverse(chain, tau=0.9, data_size=-1, chunk_rows=rows)) == [1, 3]


def _sequential(ids, scores, m, tau, batch):
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
    x = m / np.linalg.norm(m, axis=1, keepdims=True)
    kept = [order[0]]
    for s in range(1, len(order), batch):
        cur = order[s:s + batch]
        for j, i in enumerate(cur):
            bad = any(x[i] @ x[k] > tau for k in kept) or any(x[i] @ x[cur[t]] > tau for t in range(j))
            if not bad:
                kept.append(i)
    return [ids[i] for i in kept]


@pytest.mark.parametrize("tau,batch,chunk", [(0.2, 1, None), (0.3, 3, 7), (0.25, 1, 64), (0.2, 2, 33), (0.3, 40, 16), (0.3, 5, 1)])
def test_greedy_equals_sequential_scan(spark, tau, batch, chunk):
    from conftest import SF_SMALL
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = emb.select("vec_id", "embedding").limit(60 if chunk == 1 else 500).collect()
    rng = np.random.default_rng(7)
    scores = rng.integers(0, 50, len(rows)).astype(float)   # many ties: id breaks them
    ids = [r.vec_id for r in rows]
    m = np.array([r.embedding for r in rows], dtype=float)
    df = vecs(spark, [(i, float(s), [float(v) for v in r.embedding]) for i, s, r in zip(ids, scores, rows)])
    want = _sequential(ids, scores, m, tau, batch)
    assert sel_ids(SEL.greedy_diverse(df, tau=tau, batch_size=batch, chunk_rows=chunk)) == want
    assert sel_ids(SEL.greedy_diverse(df, tau=tau, batch_size=batch, chunk_rows=chunk, data_size=5)) == want[:5]


def test_greedy_result_has_no_close_pair_and_is_maximal(spark):
    from conftest import SF_SMALL
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.lit(1.0).alias("final_score"), "embedding")
    kept = set(sel_ids(SEL.greedy_diverse(emb, tau=0.3, chunk_rows=100)))
    pairs = SJ.similar_pairs(emb, 0.3, block_rows=100).collect()
    assert not any(p.id_a in kept and p.id_b in kept for p in pairs)
    nbrs = {}
    for p in pairs:
        nbrs.setdefault(p.id_a, set()).add(p.id_b)
        nbrs.setdefault(p.id_b, set()).add(p.id_a)
    all_ids = {r.id for r in emb.select("id").collect()}
    assert all(i in kept or nbrs.get(i, set()) & kept for i in all_ids)


def test_blocked_pairs_equal_single_block(spark):
    from conftest import SF_SMALL
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    a = {(r.id_a, r.id_b) for r in SJ.similar_pairs(emb, 0.3, "vec_id", block_rows=10_000).collect()}
    b = {(r.id_a, r.id_b) for r in SJ.similar_pairs(emb, 0.3, "vec_id", block_rows=37, chunk_rows=5).collect()}
    assert a == b and len(a) > 0


def test_knn_blocked_equals_brute_force(spark):
    from conftest import SF_SMALL
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = emb.select("vec_id", "embedding").collect()
    m = np.array([r.embedding for r in rows], dtype=float)
    d = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(-1))
    want = dict(zip([r.vec_id for r in rows], np.sort(d, axis=1)[:, 2]))
    got = {r.vec_id: r.knn_2 for r in SJ.knn_distance(emb, 2, "vec_id", block_rows=50, chunk_rows=7).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_f4_kcenter_hand_case(spark):
    pts = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 0.0]), (3, [5.0, 1.0]), (4, [0.0, 9.0])]
    df = spark.createDataFrame(pts, "id long, embedding array<double>")
    got = [r.id for r in SEL.kcenter_greedy(df, 3, seed_id=0).orderBy("pick").collect()]
    assert got == [0, 4, 3]


def test_f4_kcenter_sf001_fixture(spark):
    from conftest import SF_MID
    emb = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    got = [r.vec_id for r in SEL.kcenter_greedy(emb, 8, "vec_id", seed_id=0).orderBy("pick").collect()]
    assert got == [0, 188, 291, 152, 366, 49, 11, 132]


def test_d1_histogram_and_thresholds(spark):
    df = spark.createDataFrame([(0.5,), (0.9,), (2.0,), (-0.5,)], "reward_score double")
    got = {(r.lower, r.upper): (r.n, r.share) for r in SEL.score_histogram(df, "reward_score").collect()}
    assert got == {(0, 1): (2, 0.5), (2, 2): (1, 0.25), (-1, 0): (1, 0.25)}
    t = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "reward_score double")
    assert [r.reward_score for r in SEL.above(t, 2.0).collect()] == [3.0]
    assert [r.reward_score for r in SEL.below(t, 2.0).collect()] == [1.0]


def test_kcenter_equals_a_plain_scan(spark):
    from conftest import SF_SMALL
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = emb.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    picks, far = [5, 9], np.minimum(*(np.sqrt(((x - x[i]) ** 2).sum(1)) for i in (5, 9)))
    for _ in range(3):
        picks.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((x - x[picks[-1]]) ** 2).sum(1)))
    got = [r.vec_id for r in SEL.kcenter_greedy(emb, 3, "vec_id", seeds=[rows[5].vec_id, rows[9].vec_id]).orderBy("pick").collect()]
    assert got == [rows[i].vec_id for i in picks]


def test_kcenter_takes_any_id_type_and_refuses_unknown_seeds(spark):
    df = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [9.0])], "id string, embedding array<double>")
    assert [r.id for r in SEL.kcenter_greedy(df, 2).orderBy("pick").collect()] == ["a", "c"]
    with pytest.raises(KeyError):
        SEL.kcenter_greedy(df, 2, seed_id="z")
    with pytest.raises(KeyError):
        SEL.kcenter_greedy(df, 2, seeds=["a", "z"])


def test_a_zero_vector_hides_no_neighbour(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    d = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.0, 0.0])], "doc_id long, embedding array<double>")
    assert [(r.doc_id, r.rank) for r in SJ.bipartite_topk(q, d, 2).collect()] == [(2, 1)]


def test_manhattan_scales_rows_by_default():
    a = np.array([[1.0, 0.0], [0.0, 2.0]])
    assert SJ.similarity(a[:1], 3 * a[:1], "manhattan")[0, 0] == 0 and SJ.similarity(a[:1], 3 * a[:1], "manhattan", normalise=False)[0, 0] == 2


def test_global_rank_is_dense_whatever_aqe_merges(spark):
    from curatio.operators.rank import global_rank
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        df = spark.range(400_000).select("id", (F.col("id") * 7919 % 400_009).alias("k"), F.lit("x" * 20).alias("wide"))
        r = global_rank(df, ["k", "id"])
        assert r.agg(F.count("rk"), F.count_distinct("rk"), F.min("rk"), F.max("rk")).first() == (400_000, 400_000, 0, 399_999)
        want = df.toPandas().sort_values(["k", "id"])["id"].tolist()
        assert r.select("id", "rk").toPandas().sort_values("rk")["id"].tolist() == want
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_topk_ties_resolved_by_id(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    d = spark.createDataFrame([(9, [0.0, 1.0]), (5, [0.0, 1.0]), (3, [0.0, 1.0]), (7, [-1.0, 0.0])],
                              "doc_id long, embedding array<double>")
    for block in (1, 2, 100):
        got = [r.doc_id for r in SJ.bipartite_topk(q, d, 2, block_rows=block).orderBy("rank").collect()]
        assert got == [3, 5], (block, got)
    r, c = SJ.topk_by_distance_then_id(np.array([[0.5, 0.5, 0.5, 0.1]]), np.array([9, 5, 3, 7]), 2)
    assert sorted(np.array([9, 5, 3, 7])[c]) == [3, 7]


# ---------------------------------------------------------------- settling edges on executors

def _settled_by_hand(edges):
    out = set()
    for later, earlier in sorted(edges):
        if earlier not in out:
            out.add(later)
    return out


@pytest.mark.parametrize("limit", [1 << 20, 40, 3])
@pytest.mark.parametrize("kind", ["chain", "random", "star"])
def test_settle_equals_the_sequential_rule(spark, kind, limit):
    """Long chains, dense graphs and hubs, in one task or in rounds and prefixes."""
    rng = np.random.default_rng(5)
    n = {1 << 20: 400, 40: 150, 3: 24}[limit]
    if kind == "chain":
        edges = [(i + 1, i) for i in range(n)]
    elif kind == "star":
        edges = [(i, 0) for i in range(1, n)] + [(i, 1) for i in range(2, n, 2)]
    else:
        edges = sorted({(max(a, b), min(a, b)) for a, b in rng.integers(0, n, (2 * n, 2)).tolist() if a != b})
    got = SEL.settle(spark.createDataFrame(edges, "later long, earlier long"), limit)
    rows = [r.rk for r in got.collect()]
    assert set(rows) == _settled_by_hand(edges)
    assert SEL.settle(spark.createDataFrame([], "later long, earlier long"), limit).count() == 0


def test_greedy_filter_brings_no_vectors_to_the_driver():
    import inspect
    source = inspect.getsource(SEL.greedy_diverse) + inspect.getsource(SEL.settle)
    assert "toPandas" not in source and ".collect(" not in source


def test_greedy_of_large_batches_and_null_or_zero_vectors(spark, monkeypatch):
    monkeypatch.setattr(SEL, "BATCH_GROUP", 4)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 4))
    scores = rng.integers(0, 9, 60).astype(float)
    want = _sequential(list(range(60)), scores, m, 0.7, 9)
    rows = [(i, float(s), [float(v) for v in x]) for i, (s, x) in enumerate(zip(scores, m))]
    assert sel_ids(SEL.greedy_diverse(vecs(spark, rows), tau=0.7, batch_size=9, chunk_rows=30)) == want
    odd = rows + [(100, -1.0, None), (101, -2.0, [0.0] * 4), (102, None, [0.0] * 4)]
    assert sel_ids(SEL.greedy_diverse(vecs(spark, odd), tau=0.7, batch_size=9)) == want + [100, 101, 102]


# ---------------------------------------------------------------- metric pruning

def clustered(n, dim=8, seed=0):
    """Rows around a few centres, a third of them one and the same vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 4
    x = centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dim))
    x[: n // 3] = centres[0]
    return x


def test_pruned_joins_equal_the_full_product(spark):
    x = clustered(600)
    df = vecs(spark, [(i, 0.0, [float(v) for v in row]) for i, row in enumerate(x)]).select("id", "embedding").repartition(3)
    full = {(r.id_a, r.id_b) for r in SJ.similar_pairs(df, 0.95, block_rows=10_000).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if s[i, j] > 0.95}
    assert full == want
    got = [(r.id_a, r.id_b) for r in SJ.similar_pairs(df, 0.95, block_rows=25, chunk_rows=7).collect()]
    assert len(got) == len(want) and set(got) == want
    for i in (0, 3, 40):
        a = {r.id: r[f"knn_{i}"] for r in SJ.knn_distance(df, i, block_rows=10_000).collect()}
        b = {r.id: r[f"knn_{i}"] for r in SJ.knn_distance(df, i, block_rows=25, chunk_rows=9).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)
    queries = df.where("id % 7 = 0").toDF("query_id", "embedding")
    docs = df.where("id % 7 <> 0").toDF("doc_id", "embedding")
    for most in (None, 0.02):
        a = sorted(map(tuple, SJ.bipartite_topk(queries, docs, 5, most, block_rows=10_000).collect()))
        b = sorted(map(tuple, SJ.bipartite_topk(queries, docs, 5, most, block_rows=25).collect()))
        assert a == b and len(a) > 0
    left, right = df.where("id < 100").toDF("id", "v"), df.where("id >= 300").toDF("id", "v")
    assert {r.id for r in SJ.hits(left, right, 0.95, "cosine", 25).collect()} == {i for i in range(100) if (s[i, 300:] > 0.95).any()}
    far = sorted(map(tuple, SJ.similar_pairs(df.where("id > 500"), 2.0, metric="manhattan", block_rows=20).collect()))
    near = sorted(map(tuple, SJ.similar_pairs(df.where("id > 500"), 2.0, metric="manhattan", block_rows=10_000).collect()))
    assert [r[:2] for r in far] == [r[:2] for r in near] and far


def test_lower_bounds_hold_and_blocks_are_bounded(spark):
    x = clustered(900, seed=4)
    df = vecs(spark, [(i, 0.0, [float(v) for v in row]) for i, row in enumerate(x)]).select("id", F.col("embedding").alias("v"))
    filed, filing = SJ.file_rows(df, 900, 8, "euclidean", 30)
    rows = filed.select("id", "blk").toPandas()
    assert len(rows) == 900 and rows.groupby("blk").size().max() < 120 and rows.blk.max() < len(filing.cell)
    blk = rows.set_index("id").blk.loc[range(900)].to_numpy()
    low = filing.lower_bounds(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert (low[:, blk] <= d).all()
    figures = SJ.pruning_figures(df.withColumnRenamed("v", "embedding"), 1.0, "euclidean", 30)
    assert figures["pairs_met"] < 0.5 and figures["rows_sent"] < 0.5


# ---------------------------------------------------------------- coreset k-center

def test_exact_kcenter_settles_several_picks_a_job(spark, monkeypatch):
    x = clustered(400, seed=9)
    df = vecs(spark, [(i, 0.0, [float(v) for v in row]) for i, row in enumerate(x)])
    want = SEL._farthest_first(x, 30)
    for size in (1 << 20, 8 * 8 * 5, 1):
        monkeypatch.setattr(SEL, "CANDIDATE_BYTES", size)
        got = [r.id for r in SEL.kcenter_greedy(df, 30 if size > 1 else 6).orderBy("pick").collect()]
        assert got == want[:len(got)] and len(got) == (30 if size > 1 else 6)


def test_coreset_covers_within_its_bound(spark):
    x = clustered(700, seed=2)
    df = vecs(spark, [(i, 0.0, [float(v) for v in row]) for i, row in enumerate(x)])
    for k, rows in ((3, 60), (12, 30), (20, None)):
        picks = [r.id for r in SEL.kcenter_coreset(df, k, group_rows=rows).orderBy("pick").collect()]
        assert len(picks) == k == len(set(picks)) and picks[0] == 0
        radius = np.sqrt(((x[:, None] - x[picks][None]) ** 2).sum(2)).min(1).max()
        exact = SEL._farthest_first(x, k + 1)
        best = np.sqrt(((x[exact][:, None] - x[exact][None]) ** 2).sum(2) + 1e9 * np.eye(len(exact))).min() / 2     # no k centres cover closer
        assert radius <= 4 * (2 * best) + 1e-9
        got = SEL.covering_radius(df, spark.createDataFrame([(p,) for p in picks], "id long")).first()["radius"]
        assert abs(got - radius) < 1e-6
    assert SEL.kcenter_coreset(df.where("false"), 5).count() == 0


@pytest.mark.parametrize("batch", [1, 4])
def test_chunks_of_many_rows_with_few_or_none_left(spark, monkeypatch, batch):
    monkeypatch.setattr(SJ, "auto_block_rows", lambda dim: 16)
    copies = [(i, 9.0, [1.0, 0.0]) for i in range(200)] + [(500, 1.0, [0.0, 1.0])]
    assert sel_ids(SEL.greedy_diverse(vecs(spark, copies), tau=0.5, batch_size=batch, chunk_rows=64)) == [0, 500]
    # zero vectors are like nothing: all stay, and none of them can rule a later row out
    zeros = [(i, 9.0, [0.0, 0.0]) for i in range(100)] + [(500 + i, 1.0, [0.0, 1.0]) for i in range(3)]
    want = list(range(100)) + [500]
    assert sel_ids(SEL.greedy_diverse(vecs(spark, zeros), tau=0.5, batch_size=batch, chunk_rows=50)) == want


def test_pairs_of_no_rows_under_an_upper_bound(spark):
    none = vecs(spark, [(1, 1.0, [0.0, 0.0])])
    assert SJ.similar_pairs(none, 0.5, block_rows=4, size=(1000, 2)).collect() == []


def _peak_mb(run):
    import tracemalloc
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_products_of_full_blocks_stay_small(metric):
    r = np.random.default_rng(3)
    a, b, ids = r.normal(size=(1024, 8)), r.normal(size=(24576, 8)), np.arange(24576)

    def run():
        for _, _, s in SJ.sim_chunks(a, b, metric):
            SJ.topk_by_distance_then_id(s, ids, 3)
    assert _peak_mb(run) < 100


def test_mtld_holds_the_words_of_a_few_texts():
    import pandas as pd
    from curatio.operators.indicators import _mtld_batch
    texts = pd.Series([" ".join(f"w{(i * j) % 97}" for j in range(300)) for i in range(4000)])
    want = _mtld_batch(texts[:10], pd.Series([0.72] * 10)).tolist()
    got = []
    assert _peak_mb(lambda: got.extend(_mtld_batch(texts, pd.Series([0.72] * 4000)).tolist())) < 60
    assert got[:10] == want
