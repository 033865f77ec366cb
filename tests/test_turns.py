"""Message pairs across ranges against a plain loop."""

import random

import pytest

from curatio.operators import dialogs as DG
from curatio.operators.turns import message_pairs


def by_hand(rows, drop):
    out, empty = [], []
    dialogs = {}
    for c, t, r, x in rows:
        dialogs.setdefault(c, {})[t] = (r, x)
    for c, turns in dialogs.items():
        shift = 1 if drop and 0 in turns and turns[0][0] not in (None, "user", "human") else 0
        pairs = [(t - shift, t) for t in turns if t >= shift and (t - shift) % 2 == 0]
        for p, t in pairs:
            out.append((c, p // 2, turns[t][1], (turns[t + 1][1] or "") if t + 1 in turns else "", t + 1 in turns))
        if shift and set(turns) == {0}:
            empty.append((c, None, None, "", False))
    return out, empty


def some_rows(seed):
    r = random.Random(seed)
    rows = []
    for c in range(40):
        n = r.choice([1, 1, 2, 3, 4, 9, 60])
        start = r.choice([0, 0, 0, 1, 2])           # some dialogues begin late
        for t in range(start, start + n):
            if r.random() < 0.03:
                continue                            # a gap
            role = ("system" if t == 0 and r.random() < 0.5 else r.choice(["user", "human", "assistant", None]))
            rows.append((c, t, role, None if r.random() < 0.05 else f"{c}:{t} " + "é" * r.randint(0, 30)))
    return rows


@pytest.mark.parametrize("parts,batch", [(1, 10_000), (3, 10_000), (17, 2), (60, 1), (200, 3)])
def test_pairs_equal_a_plain_loop(spark, parts, batch):
    rows = some_rows(parts)
    rows += [(99, t, "user" if t % 2 else "system", f"long {t}") for t in range(150)]       # spans many ranges, drops its first
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        for drop in (True, False):
            pairs, empty = by_hand(rows, drop)
            got = sorted(map(tuple, message_pairs(df, drop, keep_empty=True).collect()), key=repr)
            assert got == sorted(pairs + empty, key=repr)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_one_scan_of_the_messages(spark, tmp_path):
    rows = some_rows(1)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "c"))
    import curatio.operators.turns as turns
    seen = []
    keep = turns.stored
    turns.stored = lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1]
    try:
        pairs = DG.turn_pairs(spark.read.parquet(str(tmp_path / "c")))
    finally:
        turns.stored = keep
    final = pairs._jdf.queryExecution().executedPlan().toString()
    assert sum(p.count("FileScan") for p in seen) == 1 and str(tmp_path) not in final


def test_pairs_of_odd_tables(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert message_pairs(spark.createDataFrame([], schema), keep_empty=True).count() == 0
    rows = [("a", 0, "system", "s"), ("b", None, "user", "x"), ("c", 0, "user", "q"), ("c", 1, None, None)]
    got = sorted(map(tuple, message_pairs(spark.createDataFrame(rows, schema), keep_empty=True).collect()))
    assert got == [("a", None, None, "", False), ("c", 0, "q", "", True)]
    assert [tuple(r) for r in DG.turn_pairs(spark.createDataFrame(rows, schema)).collect()] == [("c", 0, "q", "")]
