"""Prefix-target expansion: exact reading back and masks."""

from pyspark.sql import functions as F

CONV = "conv_id long, turn long, role string, text string"


def test_expansion_masks_each_reply_once(spark):
    from curatio.llm import chat
    hard = "\\### assistant\n </turn>\n \\h \\\\b ####### <</turn>"
    data = [(1, 0, "system", "s"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", ""), (1, 4, "assistant", None), (1, 5, "user", "rest"),
            (2, 0, "user", "only"), (3, 1, "assistant", "b"), (3, 0, "assistant", "a"), (4, 0, "ro\nle:\\n</turn>", "x"), (4, 0, "assistant", "tie"),
            (None, 0, "user", "u"), (None, None, "assistant", "v"), (5, 0, None, "no role"), (6, 0, "assistant", "same"), (6, 0, "assistant", "same")]
    turns = spark.createDataFrame(data, CONV).withColumn("example", F.lit(9)).withColumn("t", F.lit("extra"))
    examples = chat.expand(turns)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    want = {}
    for c, t, r, x in sorted(data, key=lambda d: (repr(d[0]), d[1] is not None, d[1] or 0, d[2] or "", d[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(back) == set(want)
    for c, ts in want.items():
        assert [tuple(t) for t in back[c].turns] == ts
        assert back[c].losses == [x for r, x in ts if r == "assistant"]
    rows = examples.where("conv_id = 1").orderBy("example").collect()
    assert [r.target for r in rows] == [2, 4, None] and rows[-1].loss_start == rows[-1].loss_end
    assert all(b.text.startswith(a.text) for a, b in zip(rows, rows[1:], strict=False))
    assert back[1].formatted_chars == sum(len(r.text) for r in rows)


def test_a_very_long_turn_and_no_rows(spark):
    from curatio.llm import chat
    data = [(1, i, ("user", "assistant")[i % 2], "</turn>\\" * 20_000) for i in range(4)]
    (r,) = chat.read_back(chat.expand(spark.createDataFrame(data, CONV))).collect()
    assert [t.text for t in r.turns] == [d[3] for d in data]
    assert chat.read_back(chat.expand(spark.createDataFrame([], CONV))).count() == 0
