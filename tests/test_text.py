import pytest
from pyspark.sql import functions as F

from curatio.functions import text as T
from curatio.operators import indicators as I


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).collect()[0]["r"]


def test_h1_h2_placeholders(spark):
    t = "写{$Class_2} {$$history} {$num} {$关键}"
    assert one(spark, T.placeholders(F.col("s")), t) == ["Class_2", "num", "关键"]
    assert one(spark, T.placeholders(F.col("s"), deferred=True), "{$x} {$$history}") == ["history"]


def test_h3_one_pass_fill(spark):
    df = spark.createDataFrame([("写{$a}和{$b}{$$c}完", {"a": "{$b}"})], "t string, kw map<string,string>")
    r = df.select(T.fill(F.col("t"), F.col("kw")).alias("f"), T.missing_keys(F.col("t"), F.col("kw")).alias("m")).collect()[0]
    assert r.f == "写{$b}和{$b}{$$c}完"
    assert r.m == ["b"]


def test_h7_numbering(spark):
    from curatio.operators.indicators import numbered_lines
    df = spark.createDataFrame([(1, "1. foo\n2) bar\n10.  baz")], "id long, text string")
    assert [r.line for r in numbered_lines(df, "id", "text").orderBy("line_no").collect()] == ["foo", "2) bar", "baz"]


def test_h14_stop_tokens_in_list_order(spark):
    assert one(spark, T.cut_at_stop_tokens(F.col("s"), ["bc", "ab"]), "xabc") == "xa"


def test_h17_judge(spark):
    r = one(spark, T.parse_judge(F.col("s")), '{"rate": 8, "reason": "ok"}')
    assert (r.rate, r.reason) == (8.0, "ok")
    r = one(spark, T.parse_judge(F.col("s")), "not json")
    assert (r.rate, r.reason) == (-1.0, "not json")
    fenced = '```json\n{"rate": 3, "reason": "x"}\n```'
    assert one(spark, T.parse_judge(F.col("s")), fenced).rate == 3.0
    assert one(spark, T.parse_judge(F.col("s"), strip_fence=False), fenced).rate == -1.0


def test_h27_sort_key_split():
    assert T.sort_key_split("a,b.c") == ["a", "b.c"]
    assert T.sort_key_split("a.b") == ["a", "b"]
    assert T.sort_key_split("a+b") == ["a", "b"]
    with pytest.raises(ValueError):
        T.sort_key_split("a")


def test_h8_remove_prefix(spark):
    assert one(spark, T.remove_prefix(F.col("s")), "1. Question: what?") == "what?"
    assert one(spark, T.remove_prefix(F.col("s")), "**Task** do it") == "do it"
    assert one(spark, T.remove_prefix(F.col("s")), "Q3: next") == "next"


def test_h11_h12_cleanup(spark):
    df = spark.createDataFrame([("*Why is the sky blue?* Answer::",), ("Task: Solve this:\nx = 1",),
                                ("Explain this\nmore",), ("Do it. Answer:: 42",)], "t string")
    g = [tuple(r.c) for r in T.clean_instructions(df, "t", "gemma-2", "c").collect()]
    assert g[0] == ("Why is the sky blue?", 1.0)
    assert g[1] == ("Solve this:", 5.3)
    assert g[2] == ("Explain this", 6.2)
    assert g[3] == ("Do it.", 4.0)
    l = [tuple(r.c) for r in T.clean_instructions(df, "t", "llama-3.1", "c").collect()]
    assert l[2] == ("Explain this", 99.2)
    o = [tuple(r.c) for r in T.clean_instructions(df, "t", "other", "c").collect()]
    assert o[2] == ("Explain this\nmore", 0.0)


def test_b13_wildcard_keyword(spark):
    from curatio.operators.store import keyword_search
    df = spark.createDataFrame([("abc",), ("xyz",)], "text string")
    assert [r.text for r in keyword_search(df, "text", ["A_C"]).collect()] == ["abc"]
    assert keyword_search(df, "text", ["a_c"], escape=True).count() == 0


@pytest.mark.parametrize("logits,want", [
    ([0.0] * 6, 3.5), ([0, 0, 0, 0, 0, 5.0], 5.902225), ([1.0, 2, 3, 4, 5, 6], 5.432933), ([0.0] * 5, 3.0)])
def test_d10_expected_score(spark, logits, want):
    got = one(spark, I.expected_score(F.col("s")), [float(x) for x in logits], "s array<double>")
    assert abs(got - want) < 1e-6


@pytest.mark.parametrize("text,want", [("a b a a c d", 6.0), ("a a a a", 2.0),
                                       ("the cat the dog the cat ran", 7.0), ("a b c", None), ("", None)])
def test_d11_mtld(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(I.mtld(F.col("s")).alias("m")).collect()[0].m
    assert got == want


def test_d9_weights(spark):
    from curatio.operators.influence import normalised_weights
    w = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 2.0)], "ckpt int, weight double")
    assert sorted(r.weight for r in normalised_weights(w).collect()) == [0.25, 0.25, 0.5]


def test_h35_chunks(spark):
    from curatio.operators.indicators import chunk_text
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "")], "id long, text string")
    got = [(r.chunk_idx, r.chunk) for r in chunk_text(df, "id", "text", 4, 1).orderBy("chunk_idx").collect()]
    assert got == [(0, "abcd"), (1, "defg"), (2, "ghij"), (3, "j")]


def test_cleanup_sql_and_spark_agree_on_every_arm(spark):
    import duckdb
    import pandas as pd

    import __spark_entry__ as E
    texts = ["*Why is the sky blue?* Answer::", "Task: Solve this:\nx = 1", "Explain this\nmore",
             "Do it. Answer:: 42", '"Quoted question? yes"', '"Quoted line\nnext"', "<b>bold *x*</b>",
             "Intro:\n# Heading\nbody", "Intro:\nwhat now? ok", "Intro:\n**more**", "Why so? because",
             "1. Question: how?", "a) list item", "Plan ## Step 1: go", "## Step 1 first", "Q2: second part",
             "**Prompt** Write** it", " *Lead? star", "Étude) du texte?"]
    pdf = pd.DataFrame({"conv_id": range(len(texts)), "turn": 0, "role": "user", "text": texts})
    con = duckdb.connect()
    con.register("conversations", pdf)
    want = con.execute(E.oracle_sql()["instruction_cleanup"]).df().sort_values("conv_id")
    from curatio.functions import text as T
    df = spark.createDataFrame(pdf).filter("role = 'user'").select("conv_id", "turn", "text")
    df = T.clean_instructions(T.clean_instructions(df, "text", "gemma-2", "g"), "text", "llama-3.1", "l")
    got = df.select("conv_id", "g.text", "g.class", "l.text", "l.class").toPandas()
    got.columns = ["conv_id", "gemma_text", "gemma_class", "llama_text", "llama_class"]
    got = got.sort_values("conv_id")
    for col in ["gemma_text", "gemma_class", "llama_text", "llama_class"]:
        assert list(got[col]) == list(want[col]), col
    assert len(set(got.gemma_class)) >= 8 and len(set(got.llama_class)) >= 8
