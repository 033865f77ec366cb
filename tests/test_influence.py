"""Influence by matrix products against a plain loop."""

import collections

import numpy as np
import pytest

from curatio.operators import influence as I


@pytest.mark.parametrize("piece", [32 << 20, 200, 1])
def test_influence_equals_a_plain_loop(spark, piece, monkeypatch):
    monkeypatch.setattr(I, "PIECE_BYTES", piece)
    rng = np.random.default_rng(1)
    train = [(c, r, rng.normal(size=4).tolist()) for r in range(30) for c in range(3) if (r + c) % 7]
    train += [(0, 1, rng.normal(size=4).tolist()), (9, 77, [1.0] * 4), (1, 5, None)]          # a second part, an unknown checkpoint, a NULL
    valid = [(c, t, rng.normal(size=4).tolist()) for t in range(6) for c in range(3) for _ in range(t + 1) if (t, c) != (5, 0)]
    valid += [(2, None, [-9.0] * 4), (8, 3, [100.0] * 4), (0, 1, None)]
    weights = [(0, 1.0), (1, 2.0), (2, 3.0)]
    means = collections.defaultdict(list)
    for c, t, v in valid:
        if v is not None and c < 3:
            means[t, c].append(v)
    means = {k: np.mean(v, axis=0) for k, v in means.items()}
    scores = collections.defaultdict(dict)
    for c, r, v in train:
        for (t, k), m in means.items():
            if k == c and v is not None:
                scores[r][t] = scores[r].get(t, 0.0) + (c + 1) / 6 * float(np.dot(v, m))
    want = {r: max(s.values()) for r, s in scores.items()}
    got = I.influence_scores(spark.createDataFrame(train, "ckpt int, row_id long, vec array<double>").repartition(3),
                             spark.createDataFrame(valid, "ckpt int, subtask int, vec array<double>").repartition(3),
                             spark.createDataFrame(weights, "ckpt int, weight double"))
    assert got.columns == ["row_id", "influence"]
    rows = got.collect()
    assert len(rows) == len(want) and all(abs(r.influence - want[r.row_id]) < 1e-9 for r in rows)


def test_influence_of_empty_tables(spark):
    train = spark.createDataFrame([(0, 1, [1.0])], "ckpt int, row_id string, vec array<float>")
    none = spark.createDataFrame([], "ckpt int, subtask int, vec array<float>")
    w = spark.createDataFrame([(0, 1.0)], "ckpt int, weight double")
    assert I.influence_scores(train, none, w).collect() == []
    some = spark.createDataFrame([(0, 7, [2.0])], "ckpt int, subtask int, vec array<float>")
    assert [tuple(r) for r in I.influence_scores(train, some, w).collect()] == [("1", 2.0)]
    assert I.influence_scores(train.where("false"), some, w).count() == 0
