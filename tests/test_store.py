from curatio.operators import store as S


def test_a13_null_safe_insert_if_absent_is_idempotent(spark):
    t = spark.createDataFrame([("d", None, "p")], "domain string, task string, prompt string")
    batch = spark.createDataFrame([("d", None, "p"), ("d", None, "p"), ("e", "t", "q")],
                                  "domain string, task string, prompt string")
    once = S.insert_if_absent(t, batch, t.columns)
    assert once.count() == 2
    assert S.insert_if_absent(once, batch, t.columns).count() == 2


def test_a15_a16_delete_and_update(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "id long, k string, v string")
    v = spark.createDataFrame([("a",)], "k string")
    assert sorted(r.id for r in S.delete_by(t, v, ["k"], first_only=True).collect()) == [2, 3]
    assert sorted(r.id for r in S.delete_by(t, v, ["k"]).collect()) == [3]
    u = spark.createDataFrame([(3, "new", "ignored")], "id long, v string, unknown string")
    got = {r.id: r.v for r in S.update_by_id(t, u, time_col=None).collect()}
    assert got == {1: "x", 2: "y", 3: "new"}


def test_null_keys_updates_and_missing_ids(spark, tmp_path):
    from curatio.streaming.ingest import upsert_batch
    schema = "k string, n int"
    rows = spark.createDataFrame([(None, 1), ("a", 1), (None, 1)], schema)
    for _ in range(3):          # replayed batches add nothing, NULL keys included
        upsert_batch(spark, rows, str(tmp_path / "t"), ["k", "n"], schema)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    t = spark.createDataFrame([(1, "x"), (2, None), (3, None)], "id long, k string")
    assert sorted(r.id for r in S.delete_by(t, t.filter("k IS NULL"), ["k"], first_only=True).collect()) == [1, 3]
    u = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1, None, 3), (9, "z", 1)], "id long, k string, at int")
    assert sorted(tuple(r) for r in S.update_by_id(t, u, time_col=None, order_col="at").collect() if r.id == 1) == [(1, "new")]
    assert [r.id for r in S.missing_ids(t, u).collect()] == [9]
