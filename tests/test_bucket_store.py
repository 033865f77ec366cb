import os

import pytest

from curatio.operators.bucket_store import BUCKET, BucketStore

SCHEMA = "id long, k string, v string"


def _files(path):
    found = {}
    for at, _, names in os.walk(f"{path}/rows"):
        for n in names:
            if n.endswith(".parquet"):
                found[os.path.join(at, n)] = os.path.basename(at)
    return found


def _rows(s):
    return sorted((tuple(r) for r in s.rows().collect()), key=str)


def _store(spark, path, keys=("id",), n=200):
    rows = [(i, None if i % 5 == 0 else f"k{i % 7}", f"v{i}") for i in range(n)]
    return rows, BucketStore.create(spark.createDataFrame(rows, SCHEMA), path, list(keys), 16)


def _changed(before, after):
    return {b for f, b in before.items() if f not in after}


def test_updates_and_deletes_rewrite_touched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows, s = _store(spark, path)
    before = _files(path)
    u = spark.createDataFrame([(3, "new", 1), (4, "x", 1), (4, "y", 2), (999, "none", 1)], "id int, v string, at int")
    touched = s.update(u, order_col="at")
    after = _files(path)
    assert 0 < len(touched) <= 3
    assert _changed(before, after) <= {f"{BUCKET}={b}" for b in touched}
    assert len(set(before) & set(after)) >= len(before) - 3
    want = {r[0]: r for r in rows}
    want[3], want[4] = (3, "k3", "new"), (4, "k4", "y")
    assert _rows(s) == sorted(want.values(), key=str)

    touched = s.delete(spark.createDataFrame([(7,), (7,), (1234,)], "id int"), ["id"])
    assert len(touched) <= 2 and len(set(after) & set(_files(path))) >= len(after) - 2
    del want[7]
    assert _rows(BucketStore.open(spark, path)) == sorted(want.values(), key=str)


def test_conditions_on_other_columns_null_keys_and_first_match(spark, tmp_path):
    path = str(tmp_path / "t")
    rows, s = _store(spark, path, n=60)
    null = spark.createDataFrame([(None,)], "k string")
    s.delete(null, ["k"], first_only=True)
    assert _rows(s) == sorted((r for r in rows if r[0] != 0), key=str)
    s.delete(null, ["k"])
    assert _rows(s) == sorted((r for r in rows if r[1] is not None), key=str)
    assert s.delete(null, ["k"]) == []


def test_inserts_add_files_only_and_repeat_without_effect(spark, tmp_path):
    path = str(tmp_path / "t")
    rows, s = _store(spark, path, keys=("k", "v"), n=40)
    before = _files(path)
    batch = spark.createDataFrame([(1, "k1", "v1", 0), (70, None, "v0", 0), (71, None, "w", 0), (71, None, "w", 0)], SCHEMA + ", extra int")
    for _ in range(2):
        s.insert(batch)
    assert set(before) <= set(_files(path))
    assert _rows(s) == sorted(rows + [(71, None, "w")], key=str)


def test_a_row_whose_key_changes_moves(spark, tmp_path):
    path = str(tmp_path / "t")
    rows, s = _store(spark, path, keys=("k",), n=80)
    s.update(spark.createDataFrame([(8, "elsewhere")], "id long, k string"))
    assert _rows(s) == sorted([r for r in rows if r[0] != 8] + [(8, "elsewhere", "v8")], key=str)
    s.insert(spark.createDataFrame([(500, "elsewhere", "z")], SCHEMA))
    assert s.rows().count() == 80


def test_a_bucket_may_become_empty_and_a_table_too(spark, tmp_path):
    path = str(tmp_path / "t")
    rows, s = _store(spark, path, n=30)
    s.delete(s.rows().select("id"), ["id"])
    assert _rows(s) == []
    s.insert(spark.createDataFrame(rows, SCHEMA))
    assert _rows(s) == sorted(rows, key=str)
    empty = BucketStore.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"), ["id"], 4)
    assert _rows(empty) == [] and empty.update(spark.createDataFrame([(1, "a")], "id long, v string")) in ([], [0], [1], [2], [3])
    empty.insert(spark.createDataFrame(rows, SCHEMA))
    assert _rows(empty) == sorted(rows, key=str)


def test_a_cut_off_rewrite_is_finished_or_dropped(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows, s = _store(spark, path, n=50)

    def lost(self):
        raise RuntimeError("driver lost")

    u = spark.createDataFrame([(i, "new") for i in range(50)], "id long, v string")
    with monkeypatch.context() as m:
        m.setattr(BucketStore, "_put_in_place", lost)
        with pytest.raises(RuntimeError):
            s.update(u)
    assert _rows(s) == sorted(rows, key=str)
    done = BucketStore.open(spark, path)
    assert _rows(done) == sorted(((i, k, "new") for i, k, _ in rows), key=str)
    with monkeypatch.context() as m:
        m.setattr(BucketStore, "_put_in_place", lost)
        with pytest.raises(RuntimeError):
            done.delete(u, ["id"])
    os.remove(f"{path}/pending/_SUCCESS")
    assert len(_rows(BucketStore.open(spark, path))) == 50
    assert not os.path.exists(f"{path}/pending")


def test_refused_layouts(spark, tmp_path):
    t = spark.createDataFrame([(1, "a")], f"id long, {BUCKET} string")
    with pytest.raises(ValueError):
        BucketStore.create(t, str(tmp_path / "t"), ["id"])
    with pytest.raises(ValueError):
        BucketStore.create(t.drop(BUCKET), str(tmp_path / "t"), ["other"])
