import pytest
from pyspark.sql import functions as F

from curatio.operators import render as R


@pytest.fixture
def three(spark):
    return spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "q")],
                                 "conv_id long, turn long, role string, text string")


def rendered(df, name, **kw):
    return R.render(df, name, **kw).collect()[0]["prompt"]


def test_add_colon_two(three):
    assert rendered(three, "vicuna_simple") == " USER: hi ASSISTANT: yo</s>USER: q "


def test_chatglm2_rounds_start_at_one(three):
    assert rendered(three, "chatglm2") == "[Round 1]\n\n问：hi\n\n答：yo\n\n[Round 2]\n\n问：q\n\n"
    assert rendered(three, "chatglm").startswith("[Round 0]\n问：hi\n")


def test_llama2_first_message_follows_system(three):
    t = R.template("llama-2")
    assert rendered(three, "llama-2") == t["system"] + "hi" + "[/INST] yo </s><s>" + "[INST] q "


def test_chatintern(three):
    t = R.template("internlm-chat")
    assert rendered(three, "internlm-chat") == t["system"] + "<s><|User|>:hi<eoh>\n<|Bot|>:yo<eoa>\n<s><|User|>:q<eoh>\n"


def test_rwkv_and_generation_prompt(spark, three):
    assert rendered(three, "rwkv") == "Bob: hi\n\nAlice: yo\n\nBob: q\n\n"
    one = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert rendered(one, "vicuna_simple", add_generation_prompt=True) == " USER: hi ASSISTANT:"
    assert rendered(one, "tulu", add_generation_prompt=True) == "<|user|>\nhi\n<|assistant|>\n"


def test_every_template_renders(three):
    for t in R.TEMPLATES:
        assert isinstance(rendered(three, t[0]), str)


def test_h20_h21_formats(spark, three):
    assert R.role_tagged(three).collect()[0]["text"] == "<|user|>\nhi\n<|assistant|>\nyo</s>\n<|user|>\nq\n"
    assert R.inst_format(three).collect()[0]["text"] == "[INST] hi [/INST] yo </s><s>[INST] q [/INST]"
    bad = spark.createDataFrame([(1, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception):
        R.inst_format(bad).collect()


def test_h19_api_messages(three):
    m = R.api_messages(three, "sys").collect()[0]["messages"]
    assert [(x.role, x.content) for x in m] == [("system", "sys"), ("user", "hi"), ("assistant", "yo"), ("user", "q")]


def test_h23_h24_h26(spark):
    df = spark.createDataFrame([("Q", "A")], "i string, o string")
    r = df.select(R.scorer_prompt("complexity", F.col("i")).alias("c"),
                  R.scorer_prompt("quality", F.col("i"), F.col("o")).alias("q")).collect()[0]
    assert r.c.endswith("##Query: Q  \n##Complexity: ") and "#Question#:\nQ\n#Response#:\nA \n##Quality: " in r.q
    pref = spark.createDataFrame(
        [("p", [("user", "p")], [("user", "p"), ("assistant", "good")], [("user", "p"), ("assistant", "bad")])],
        "prompt string, messages array<struct<role:string,content:string>>, "
        "chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>")
    p = R.preference_strings(pref, "vicuna_simple").collect()[0]
    assert (p.prompt, p.chosen, p.rejected) == (" user: p ", "assistant: good</s>", "assistant: bad</s>")
    m = R.prompt_answer_mask(df, "i", "o", 10).collect()[0]["tokens"]
    assert [(t.token, t.is_target) for t in m] == [("Q", False), ("A", True)]


def test_gathered_messages_render_as_the_long_table_does(spark):
    rows = [(1, 0, "assistant", "dropped"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (2, 0, "user", ""), (2, 1, "assistant", "yo"),
            (2, 2, "user", "q"), (3, 0, "user", "twice a"), (3, 0, "user", "twice"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = R.gathered_messages(df)
    for name in ("one_shot", "vicuna_v1.1", "chatglm2", "llama-2", "starchat", "scorer"):
        for tail in (False, True):
            assert sorted(map(str, R.render(df, name, add_generation_prompt=tail, gathered=messages).collect())) == sorted(
                map(str, R.render(df, name, add_generation_prompt=tail).collect()))


def test_many_templates_share_one_gathering(spark):
    from conftest import SF_SMALL
    from curatio.plans.store_queries import render_plain_templates_q
    plan = render_plain_templates_q(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan            # no sort or shuffle of the texts for each template
