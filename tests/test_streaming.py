import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from curatio.streaming.ingest import append_new_vectors, dialog_ingest, merged_vectors, vector_stream


def test_j1_stream_stores_each_dialogue_once(spark):
    root = tempfile.mkdtemp(prefix="curatio-j1-", dir="/tmp")
    src = os.path.join(root, "in")
    os.makedirs(src)
    d1 = {"message": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "turn": 1}
    d2 = {"message": [{"role": "user", "content": "q"}], "turn": 1}
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write(json.dumps(d1) + "\n" + json.dumps(d1) + "\n" + json.dumps(d2) + "\n")
    table = os.path.join(root, "table")
    q = dialog_ingest(spark, src, table, os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 2
    with open(os.path.join(src, "b.json"), "w") as f:      # a repeat arrives later
        f.write(json.dumps(d1) + "\n")
    q = dialog_ingest(spark, src, table, os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 2


def test_a19_resume_skips_stored_ids(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="curatio-a19-", dir="/tmp"), "vec")
    v = spark.range(10).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    append_new_vectors(spark, v.filter("row_id < 4"), out, chunk_rows=3)
    append_new_vectors(spark, v, out, chunk_rows=3)
    m = merged_vectors(spark, out, normalise=True)
    assert [r.row_id for r in m.collect()] == list(range(10))


def _forget_last_commit(checkpoint):
    """What a crash after the sink wrote and before the batch was committed leaves."""
    commits = os.path.join(checkpoint, "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    os.truncate(os.path.join(commits, str(last)), 0)
    os.remove(os.path.join(commits, str(last)))
    crc = os.path.join(commits, f".{last}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    return last


def _raw(*texts):
    return "".join(json.dumps({"message": [{"role": "user", "content": t}], "turn": 1}) + "\n" for t in texts)


def test_j1_replayed_epoch_is_written_again_and_the_table_never_read(spark):
    root = tempfile.mkdtemp(prefix="curatio-j1-", dir="/tmp")
    src, table, ckpt = (os.path.join(root, n) for n in ("in", "table", "ckpt"))
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write(_raw(*["hot"] * 500, "x", "y"))
    dialog_ingest(spark, src, table, ckpt, state_partitions=3).awaitTermination(120)
    first = sorted(r.message_json for r in spark.read.parquet(table).collect())
    assert len(first) == 3
    # a crash before the commit, with half of the folder written: the epoch is written again, whole
    last = _forget_last_commit(ckpt)
    folder = os.path.join(table, f"epoch={last}")
    for name in os.listdir(folder)[:2]:
        os.truncate(os.path.join(folder, name), 0)
    dialog_ingest(spark, src, table, ckpt, state_partitions=3).awaitTermination(120)
    assert sorted(r.message_json for r in spark.read.parquet(table).collect()) == first
    # later batches do not read what is stored: unreadable old files do not matter to them
    kept = {}
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            with open(os.path.join(folder, name), "r+b") as f:
                kept[name] = f.read()
                f.seek(0), f.truncate(0), f.write(b"junk")
    with open(os.path.join(src, "b.json"), "w") as f:
        f.write(_raw("hot", "x", "new"))
    dialog_ingest(spark, src, table, ckpt, state_partitions=3).awaitTermination(120)
    assert [json.loads(r.message_json)[0]["content"] for r in spark.read.parquet(os.path.join(table, f"epoch={last + 1}")).collect()] == ["new"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    with pytest.raises(ValueError):
        dialog_ingest(spark, src, table, os.path.join(root, "other"))


def test_j2_vector_stream_resumes_and_merges(spark):
    root = tempfile.mkdtemp(prefix="curatio-j2-", dir="/tmp")
    src, out, ckpt = (os.path.join(root, n) for n in ("in", "out", "ckpt"))
    v = spark.range(12).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))

    def run():
        vector_stream(spark, src, "row_id long, vec array<double>", out, ckpt, max_files=1, chunk_rows=5, state_partitions=2,
                      compute=lambda b: b.withColumn("vec", F.transform("vec", lambda x: x * 2))).awaitTermination(120)

    v.filter("row_id < 7").repartition(2).write.parquet(src)
    run()
    _forget_last_commit(ckpt)
    v.repartition(1).write.mode("append").parquet(src)          # earlier ids come again
    run()
    got = merged_vectors(spark, out).collect()
    assert [(r.row_id, r.vec, r.chunk) for r in got] == [(i, [2.0 * i, 2.0], i // 5) for i in range(12)]
