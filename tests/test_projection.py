import numpy as np

from curatio.operators import projection as P


def _got(df):
    out = {}
    for r in df.collect():
        out.setdefault((r[0], r["size"]), {})[r["j"]] = r["value"]
    return {k: [v[j] for j in range(len(v))] for k, v in out.items()}


def _same(got, want):
    assert set(got) == set(want)
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=1e-9)


def test_entries_and_blocks_equal_the_dense_product(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 4)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(7, 50)) * (rng.random((7, 50)) < 0.3)
    sizes = [3, 10]
    want = {(r, k): list(x[r] @ P.sign_block(50, 0, k, 9) / np.sqrt(k)) for r in range(7) for k in sizes}
    entries = [(r, i, float(x[r, i])) for r in range(7) for i in range(50) if x[r, i] or i == 0]
    df = spark.createDataFrame(entries, "r long, i int, v double").repartition(5)
    _same(_got(P.project_entries(df, "r", "i", "v", sizes, 9)), want)
    blocks = [(r, b, [float(v) for v in x[r, 8 * b:8 * b + 8]]) for r in range(7) for b in range(7)]
    df = spark.createDataFrame(blocks, "r long, b int, v array<float>").repartition(5)
    got = _got(P.project_blocks(df, "r", "b", "v", 8, sizes, 9))
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=1e-5)


def test_nulls_repeats_far_components_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "SIGNS", 8)
    far = 3 << 40
    e = spark.createDataFrame([("a", far, 1.5), ("a", far, 0.5), ("a", None, 9.0), (None, 2, 1.0), ("z", 1, None)], "r string, i long, v double")
    s = lambda i: P.signs(np.array([i]), 0, 4, 1)[0] / 2
    _same(_got(P.project_entries(e, "r", "i", "v", [4], 1)), {("a", 4): list(2 * s(far)), (None, 4): list(s(2)), ("z", 4): [0.0] * 4})
    b = spark.createDataFrame([("a", far >> 1, [0.0, 3.0]), ("a", 0, [1.0]), ("z", 0, None)], "r string, b long, v array<double>")
    _same(_got(P.project_blocks(b, "r", "b", "v", 2, [4], 1)), {("a", 4): list(3 * s(far + 1) + s(0)), ("z", 4): [0.0] * 4})
    assert P.project_entries(e.limit(0), "r", "i", "v", [4], 1).count() == 0
