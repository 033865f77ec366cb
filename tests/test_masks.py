import random
import re

import pytest
from pyspark.sql import functions as F

from curatio.operators import masks as M
from curatio.operators import render as R

SCHEMA = "conv_id long, turn long, role string, text string"


def dialogue(spark, *messages):
    return spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(messages)], SCHEMA)


def targets(conv, rule, max_len=None, template="vicuna_simple", offsets=None):
    m = M.token_masks(M.loss_spans(conv, rule, template), max_len, offsets)
    r = m.select("text", M.target_texts(m).alias("hit"), F.size("tokens").alias("n")).collect()[0]
    return r.text, r.hit, r.n


def test_tagged_counts_answers_and_end_marks(spark):
    c = dialogue(spark, ("system", "s t"), ("user", " hi  "), ("assistant", " yo man "), ("user", None), ("assistant", ""))
    text, hit, n = targets(c, "tagged")
    assert text == "<|system|>\ns t\n<|user|>\nhi\n<|assistant|>\nyo man</s>\n<|user|>\n\n<|assistant|>\n</s>\n"
    assert hit == ["yo", "man</s>", "</s>"] and n == 11
    # the role line of an answer that no other role precedes counts
    assert targets(dialogue(spark, ("assistant", "a"), ("assistant", "b")), "tagged")[1] == ["<|assistant|>", "a</s>", "<|assistant|>", "b</s>"]
    with pytest.raises(Exception):
        targets(dialogue(spark, ("tool", "a")), "tagged")


def test_inst_masks_up_to_the_answer(spark):
    c = dialogue(spark, ("user", "q w"), ("assistant", "a  b"), ("user", "r"))
    text, hit, _ = targets(c, "inst")
    assert text == "[INST] q w [/INST] a  b </s><s>[INST] r [/INST]"
    assert hit == ["a", "b", "</s><s>[INST]"]            # a token belongs to the span it starts in
    assert text == R.inst_format(c).collect()[0]["text"]
    text, hit, _ = targets(dialogue(spark, ("assistant", " \n"), ("user", "x")), "inst")   # front white space goes
    assert text == "</s><s>[INST] x [/INST]" and hit == ["</s><s>[INST]"]
    assert targets(dialogue(spark, ("assistant", "x y")), "inst")[1] == ["x", "y", "</s>"]


def test_answers_need_whole_rounds(spark):
    whole = [("user", "q"), ("assistant", "a b"), ("user", "r"), ("assistant", "c")]
    text, hit, n = targets(dialogue(spark, *whole), "answers")
    assert text == " USER: q ASSISTANT: a b</s>USER: r ASSISTANT: c</s>"
    assert hit == ["a", "b</s>USER:", "c</s>"] and n == 8
    open_end = whole + [("user", "z")]
    assert targets(dialogue(spark, *open_end), "answers")[1] == []                  # not whole: nothing counts
    assert targets(dialogue(spark, *open_end), "answers", 5)[1] == ["a", "b</s>USER:"]     # whole rounds fill the limit
    for bad in ("x</s>y", "x ASSISTANT: y", ""):
        assert targets(dialogue(spark, ("user", "q"), ("assistant", bad)), "answers")[1] == []
    with pytest.raises(ValueError):
        M.loss_spans(dialogue(spark, *whole), "answers", "chatglm")


def test_replies_count_the_role_head(spark):
    c = dialogue(spark, ("system", "s"), ("user", "q"), ("assistant", "a b"))
    assert targets(c, "replies")[1] == ["ASSISTANT:", "a", "b</s>"]
    assert targets(c, "replies", 3)[1] == ["ASSISTANT:"]
    assert targets(c, "replies", template="chatglm2")[1] == ["答：a", "b"]


def test_masks_equal_prefix_counts(spark):
    """The reference's way: tokens of rendered prefixes are counted, everything of a non-answer is ignored."""
    r = random.Random(5)
    rows, want = [], {}
    for conv in range(60):
        msgs = [(r.choice(("user", "assistant", "system")), "".join(r.choice("ab \n😀é") for _ in range(r.randint(0, 12)))) for _ in range(r.randint(1, 7))]
        rows += [(conv, i, a, b) for i, (a, b) in enumerate(msgs)]

        def text(ms):
            return "".join(f"<|{a}|>\n{b.strip()}" + ("</s>" if a == "assistant" else "") + "\n" for a, b in ms)
        count = lambda s: len(re.findall(r"\S+", s))
        labels = [True] * count(text(msgs))
        for i, (a, _) in enumerate(msgs):
            if a != "assistant":
                upto = text(msgs[:i + 1]) + ("<|assistant|>\n" if i + 1 < len(msgs) and msgs[i + 1][0] == "assistant" else "")
                for k in range(count(text(msgs[:i])), count(upto)):
                    labels[k] = False
        want[conv] = labels
    m = M.token_masks(M.loss_spans(spark.createDataFrame(rows, SCHEMA).repartition(5), "tagged"))
    assert {x.conv_id: [t.is_target for t in x.tokens] for x in m.collect()} == want


def test_library_offsets_and_prompt_masks(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    c = dialogue(spark, ("user", "Que 😀 la"), ("assistant", "réponse 漢字"))
    text, hit, n = targets(c, "tagged", offsets=M.tokenizer_offsets(path))
    from tokenizers import Tokenizer
    enc = Tokenizer.from_file(path).encode(text, add_special_tokens=False)
    cut = text.index("réponse")
    assert n == len(enc.ids) and hit == [text[a:b] for a, b in enc.offsets if a >= cut]
    df = spark.createDataFrame([(1, "a b ", "c d"), (2, None, "x"), (3, "y", None), (4, "ab", "cd")], "id long, s string, t string")
    m = M.token_masks(M.prompt_answer_spans(df, "s", "t"))
    assert {r.id: [t.is_target for t in r.tokens] for r in m.collect()} == {1: [False, False, True, True], 2: [True], 3: [False], 4: [False]}
    rep = M.completion_report(m).collect()[0]
    assert tuple(rep) == (4, 7 / 4, 3 / 4)


def test_no_dialogues_and_long_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    for rule in M.RULES:
        assert M.token_masks(M.loss_spans(none, rule)).count() == 0
    big = dialogue(spark, ("user", "q " * 10), ("assistant", "w " * 2_000_000))
    got = M.token_masks(M.loss_spans(big.unionByName(dialogue(spark, ("user", "q")).withColumn("conv_id", F.lit(2))), "tagged"))
    assert got.where("conv_id = 1").select(F.size("tokens")).first()[0] == 2_000_000 + 12 and got.count() == 2


def test_spans_are_laid_without_sending_texts_to_python(spark):
    c = dialogue(spark, ("user", "q w"), ("assistant", "a"))
    for rule in ("tagged", "inst", "replies"):
        plan = M.token_masks(M.loss_spans(c, rule), 4)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan
    assert M.token_masks(M.loss_spans(c.where("conv_id < 0"), "inst"), 4).collect() == []


def test_token_masks_hold_few_offsets_at_a_time():
    sizes = []
    texts = ["word " * 1000] * 900           # 4.5 million characters
    for at, n in M._slices(M.pa.array(texts)):
        sizes.append(sum(len(t) for t in texts[at:at + n]))
    assert sum(sizes) == 4_500_000 and max(sizes) <= 1 << 20
