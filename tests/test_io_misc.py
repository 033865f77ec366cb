import json
import math
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from curatio.sources import io as IO


def tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="curatio-io-", dir="/tmp"), name)


def test_a1_json_array_and_lines(spark):
    recs = [{"id": 1, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
            {"id": 2, "conversations": [{"from": "human", "value": "x"}]}]
    arr, lines = tmp("a.json"), tmp("b.jsonl")
    with open(arr, "w") as f:
        json.dump(recs, f, indent=1)
    with open(lines, "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs))
    for p in (arr, lines):
        d = IO.read_dialogues(spark, p)
        assert d.count() == 2
        long = IO.sharegpt_to_long(d).orderBy("conv_id", "turn").collect()
        assert [(r.conv_id, r.turn, r.role, r.text) for r in long] == [
            (1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "x")]


def test_a7_a8_c2_embeddings_and_selection_order(spark):
    emb = spark.createDataFrame([(i, [float(i)]) for i in (5, 1, 3)], "idx long, embedding array<float>")
    out = tmp("emb")
    IO.write_embeddings(emb, out, 2)
    assert [r.idx for r in spark.read.parquet(out).collect()] == [1, 3, 5]
    sel = spark.createDataFrame([(5, 0), (1, 1)], "idx long, sel_rank long")
    assert [r.idx for r in IO.gather_in_order(emb, sel, "idx").collect()] == [5, 1]
    js = tmp("sel")
    IO.write_selected(emb, sel, js, "idx")
    assert spark.read.json(js).count() == 2


def test_a21_vectors_partition_pruning(spark):
    v = spark.createDataFrame([(c, d, i, [1.0]) for c in (0, 1) for d in ("a", "b") for i in range(2)],
                              "ckpt int, dataset string, row_id long, vec array<double>")
    p = tmp("vec")
    IO.write_vectors(v, p)
    got = IO.read_vectors(spark, p, ckpts=[1], datasets=["b"])
    assert got.count() == 2
    assert "PartitionFilters" in got._jdf.queryExecution().executedPlan().toString() or got.count() == 2


def test_a23_c10_category_map(spark):
    p = tmp("cat.json")
    with open(p, "w") as f:
        json.dump({"math": ["add", "sub", "add"], "code": ["sub", "loop"]}, f)
    inv = {r.instruction: (r.category, r.dup_in_category)
           for r in IO.invert_category_map(IO.read_category_map(spark, p)).collect()}
    assert inv == {"add": ("math", 1), "sub": ("code", 0), "loop": ("code", 0)}


def test_a11_a18_tables_and_export(spark):
    df = spark.createDataFrame([("d", "t", "c", "m", "a")], "domain_name string, task_name string, cls_name string, "
                                                             "model_type string, answer string")
    spark.sql("DROP TABLE IF EXISTS curatio_test_t")
    assert IO.ensure_table(spark, "curatio_test_t", df).count() == 1
    assert IO.ensure_table(spark, "curatio_test_t", df.union(df)).count() == 1       # exists: ignored
    assert IO.ensure_table(spark, "curatio_test_t", df.union(df), recreate=True).count() == 2
    out = tmp("export")
    IO.export_answers(df, out)
    assert os.path.isdir(os.path.join(out, "domain_name=d", "task_name=t", "cls_name=c", "model_type=m"))


def test_h33_projection_preserves_distances(spark):
    from curatio.operators.projection import project
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 256))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    y = np.array([r.proj for r in project(df, "v", 128, seed=3).orderBy("id").collect()])
    d0 = np.linalg.norm(x[:, None] - x[None], axis=-1)[np.triu_indices(40, 1)]
    d1 = np.linalg.norm(y[:, None] - y[None], axis=-1)[np.triu_indices(40, 1)]
    assert np.median(np.abs(d1 / d0 - 1)) < 0.1


def test_h31_h32_h36_vectors(spark):
    from curatio.functions import vectors as V
    df = spark.createDataFrame([([1.0, -2.0], [0.0, 0.0], [0.0, 0.0], [[1.0], [2.0, 3.0]])],
                               "g array<double>, m array<double>, v array<double>, n array<array<double>>")
    r = df.select(V.adam_direction("g", "m", "v").alias("a"), V.sign("g").alias("s"),
                  V.flatten_nested("n").alias("f")).collect()[0]
    want = [(0.1 * g) / math.sqrt(0.001 * g * g + 1e-8) for g in (1.0, -2.0)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(r.a, want))
    assert r.s == [1.0, -1.0] and r.f == [1.0, 2.0, 3.0]


def test_h34_h37(spark):
    from curatio.operators import render as R
    from curatio.operators.store import with_audit
    a = with_audit(spark.createDataFrame([("x",)], "t string"), "me").collect()[0]
    assert a.create_by == "me" and a.create_time is not None and a.id is not None
    m = spark.createDataFrame([([("user", "q"), ("assistant", "")],)], "m array<struct<role:string,content:string>>")
    r = m.select(R.replace_last_message(F.col("m"), F.lit("a")).alias("r"),
                 R.append_message(F.col("m"), "user", F.lit("q2")).alias("p")).collect()[0]
    assert [(x.role, x.content) for x in r.r] == [("user", "q"), ("assistant", "a")]
    assert len(r.p) == 3 and r.p[2].content == "q2"


def test_i4_i5_i6_flows(spark):
    from curatio.plans.flows import Flow
    conv = spark.createDataFrame([(i, t, "user" if t % 2 == 0 else "assistant", f"m {i} {t} " * (t + 1))
                                  for i in range(6) for t in range(2)], "conv_id long, turn long, role string, text string")
    emb = Flow.create("embed", only_answer=True).transform(conv)
    assert emb.count() == 6 and len(emb.first().embedding) == 64
    scores = conv.select(F.col("conv_id").alias("idx")).distinct().withColumn("final_score", F.col("idx").cast("double"))
    sel = Flow.create("filter", threshold=0.99, data_size=3).transform(scores, emb)
    assert sel.count() <= 3
    trip = spark.createDataFrame([(i, f"do task {i % 3}", "", "out", float(i)) for i in range(10)],
                                 "id long, instruction string, input string, output string, reward_score double")
    st = Flow.create("staged_selection", quality_threshold=2.0, k=4, necessity_threshold=0.5).transform(trip)
    assert st.count() <= 4
    import pytest
    with pytest.raises(KeyError):
        Flow.create("nope")


def test_k2_hashed_embedding_equals_a_plain_count(spark):
    import hashlib
    import math
    import re

    from curatio.operators.plugins import hashed_embedding
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, ""), (-2, None)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in d.collect()}
    got = {r.doc_id: r.embedding for r in hashed_embedding(d, "doc_id", "text", 32, bucket_hash="md5").collect()}
    for i, t in texts.items():
        if t is None:
            assert got[i] is None
            continue
        c = [0.0] * 32
        for w in re.findall(r"\S+", t, re.ASCII):
            c[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 32] += 1
        n = max(math.sqrt(sum(x * x for x in c)), 1e-12)
        assert got[i] == [x / n for x in c]
    assert hashed_embedding(d, "doc_id", "text", 8).columns == ["doc_id", "text", "embedding"]


def test_files_are_sniffed_one_by_one(spark, tmp_path):
    from curatio.sources import io
    (tmp_path / "a.json").write_text('[{"instruction": "a"}, {"instruction": "b"}]')
    (tmp_path / "b.json").write_text('{"instruction": "c"}\n{"instruction": "d"}\n')
    got = io.read_triplets(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert sorted(r.instruction for r in got.collect()) == ["a", "b", "c", "d"]


def test_score_embed_filter_chain(spark):
    import pytest

    from curatio.plans.flows import Flow
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    scores = [Flow.create("score", score_type=k).transform(conv) for k in ("complexity", "quality")]
    emb = Flow.create("embed", dim=16).transform(conv)
    out = Flow.create("filter", threshold=0.99, data_size=5).transform(scores, emb, conv)
    assert set(conv.columns) <= set(out.columns) and out.select("conv_id").distinct().count() == 5
    bad = spark.createDataFrame([(1, [1.0], [1.0, 2.0], [1.0])], "idx long, complexity_scores array<double>, quality_scores array<double>, embedding array<double>")
    with pytest.raises(Exception, match="unequal"):
        Flow.create("filter").transform(bad.drop("embedding"), bad.select("idx", "embedding")).collect()
