from pyspark.sql import functions as F

from curatio.operators import dialogs as DG
from curatio.operators import render as R


def conv(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_b1_trailing_instruction_gets_empty_response(spark):
    c = conv(spark, [(1, 0, "user", "u1"), (1, 1, "assistant", "a1"), (1, 2, "user", "u2")])
    got = sorted((r.pair_idx, r.instruction, r.response) for r in DG.turn_pairs(c).collect())
    assert got == [(0, "u1", "a1"), (1, "u2", "")]


def test_b1_leading_system_dropped(spark):
    c = conv(spark, [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1")])
    got = [(r.instruction, r.response) for r in DG.turn_pairs(c).collect()]
    assert got == [("u1", "a1")]


def test_b8_zip_stops_at_shorter(spark):
    c = conv(spark, [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2")])
    msgs = R.message_array(c).collect()[0]["messages"]
    assert [(m.role, m.content) for m in msgs] == [("user", "q1"), ("assistant", "a1")]
    hist = R.history_text(c).collect()[0]
    assert hist.history == "[HUMAN]: q1\n[AI]: a1\n" and hist.n_rounds == 1


def test_d2_final_score(spark):
    ps = spark.createDataFrame([(1, 0, 2.0, 1.0), (1, 1, 3.0, 4.0)],
                               "conv_id long, pair_idx long, complexity double, quality double")
    assert DG.final_score(ps).collect()[0]["final_score"] == 14.0


def test_b2_inject_scores_in_pair_order(spark):
    ps = spark.createDataFrame([(1, 1, 4.0), (1, 0, 2.0)], "conv_id long, pair_idx long, s double")
    ids = spark.createDataFrame([(1,), (2,)], "conv_id long")
    got = {r.conv_id: r.s_scores for r in DG.inject_scores(ids, ps, "s").collect()}
    assert got == {1: [2.0, 4.0], 2: []}


def test_b10_alternation_report(spark):
    c = conv(spark, [(1, 0, "user", "x"), (1, 1, "user", "y"), (2, 0, "system", "s"), (2, 1, "user", "u")])
    got = {r.conv_id: (r.bad_roles, r.dropped_first, r.valid) for r in DG.alternation_report(c).collect()}
    assert got == {1: (1, False, False), 2: (0, True, True)}


def test_render_vicuna(spark):
    c = conv(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yo")])
    p = R.render(c, "vicuna_simple").collect()[0]["prompt"]
    assert p == " USER: hi ASSISTANT: yo</s>"
