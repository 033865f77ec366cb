import os
import tempfile

import pytest
from pyspark.sql import functions as F

from curatio.operators import dialogs as DG
from curatio.operators import prompts as P


def _write(lines):
    d = tempfile.mkdtemp(prefix="curatio-kw-", dir="/tmp")
    paths = []
    for i, body in enumerate(lines):
        p = os.path.join(d, f"kw{i}.txt")
        with open(p, "w") as f:
            f.write(body)
        paths.append(p)
    return paths


def test_a4_a5_keyword_files_and_fill(spark):
    paths = _write(['{"Class_2": "诗", "num": 2}\n{"Class_2": "词", "num": 1}\n', '{"prompt": "aaaaaa"}\n'])
    rec = P.read_keyword_files(spark, paths)
    assert rec.count() == 3
    rep = {r.file_pos: r.has_key for r in P.required_key_report(rec).collect()}
    assert rep == {0: True, 1: False}
    tpl = spark.createDataFrame([(0, "写{$Class_2}{$$history}", "答{$num}", "q", "e"),
                                 (1, "{$prompt}", "{$x}", "q", "e")],
                                "file_pos int, first_query_prompt string, answer_prompt string, "
                                "query_prompt string, evaluate_prompt string")
    out = {(r.file_pos, r.first_query_prompt, r.answer_prompt, tuple(r.missing))
           for r in P.fill_bundles(tpl, rec).collect()}
    assert out == {(0, "写诗{$$history}", "答2", ()), (0, "写词{$$history}", "答1", ()),
                   (1, "aaaaaa", "{$x}", ("x",))}


def test_malformed_keyword_line_raises(spark):
    paths = _write(["{'prompt': xxxxxx}\n"])
    with pytest.raises(Exception):
        P.read_keyword_files(spark, paths).collect()


def test_c8_bundles_and_lookup(spark):
    typed = spark.createDataFrame(
        [("d", "t", "c", pt, f"{pt} text") for pt in P.PROMPT_TYPES] + [("d", "t", "x", "query_prompt", "only one")],
        "domain_name string, task_name string, cls_name string, prompt_type string, prompt string")
    good, bad = P.bundles_from_typed(typed)
    assert good.count() == 1 and bad.count() == 1
    req = spark.createDataFrame([(1, "d", "t", "c"), (2, "d", "t", "zz")],
                                "request_id long, domain_name string, task_name string, cls_name string")
    hit, miss = P.lookup_bundles(good, req)
    assert [r.request_id for r in hit.collect()] == [1] and [r.request_id for r in miss.collect()] == [2]


def test_h5_h6_args(spark):
    t = spark.createDataFrame([("写{$a}{$b}", "a b; c"), ("{$a}", "b")], "prompt string, args string")
    rows = P.check_args(t, "prompt", "args").collect()
    assert rows[0].parsed_args.input_args == ["a", "b"] and rows[0].parsed_args.iter_args == ["c"]
    assert rows[0].args_match and not rows[1].args_match and rows[1].parsed_args.iter_args is None


def test_f14_round_counts_in_range(spark):
    df = spark.range(50).select(F.col("id"), F.lit(4).alias("n"))
    got = P.round_counts(df, "n", 2, 5, seed=1).collect()
    assert all(len(r.turn) == 4 and all(2 <= x <= 5 for x in r.turn) for r in got)


def test_b6_b18_g2_observe(spark):
    df = spark.createDataFrame([("abc</s>",), ("ab",)], "g string")
    assert [r.c for r in df.select(DG.cut_suffix(F.col("g")).alias("c")).collect()] == ["abc", ""]
    m = spark.createDataFrame([([("user", "x")],), ([],)], "messages array<struct<role:string,content:string>>")
    ok, bad = DG.require_messages(m)
    assert ok.count() == 1 and bad.count() == 1
    a = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert sorted(r.id for r in DG.new_ids(a, a.filter("id = 2"), "id").collect()) == [1, 3]
    o, obs = DG.observe_counts(a, "stage")
    o.collect()
    assert obs.get["rows"] == 3


def test_i11_i12_flows(spark):
    from curatio.plans.construction import answers_for_prompts, construct_by_taxonomy
    typed = spark.createDataFrame(
        [("d", "t", "c", "first_query_prompt", "1. ask a\n2. ask b"), ("d", "t", "c", "query_prompt", "more"),
         ("d", "t", "c", "answer_prompt", "A: {query}"), ("d", "t", "c", "evaluate_prompt", "judge")],
        "domain_name string, task_name string, cls_name string, prompt_type string, prompt string")
    req = spark.createDataFrame([(7, "d", "t", "c", 2)],
                                "request_id long, domain_name string, task_name string, cls_name string, turn int")
    rows, miss = construct_by_taxonomy(typed, req)
    got = rows.collect()
    assert len(got) == 2 and miss.count() == 0
    assert all(len(r.inputs) == 2 and len(r.targets) == 2 and r.history.startswith("[HUMAN]: ") for r in got)
    assert all(r.score == -1.0 for r in got)   # the echo judge is not JSON
    f = spark.createDataFrame([(1, "hello")], "id long, p string")
    a = answers_for_prompts(f, "id", "p").collect()[0]
    assert a.answer == "[answer] hello" and '"content":"hello"' in a.history


def test_construct_with_pandas_generator_and_failures(spark):
    import pandas as pd

    from curatio.operators.plugins import generate, split_rejected
    from curatio.plans.construction import construct

    def gen(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": batch["id"], "text": ["G:" + p[:0] + "ok" for p in batch["prompt"]],
                             "error": None})

    b = spark.createDataFrame([(1, "1. q one\n2. q two", "more", "A {query}", "judge", 3)],
                              "bundle_id long, first_query_prompt string, query_prompt string, "
                              "answer_prompt string, evaluate_prompt string, turn int")
    rows = construct(b, gen).collect()
    # the generator's first query is one line, so one dialogue with 3 rounds
    assert len(rows) == 1 and rows[0].n_messages == 6 and rows[0].rate == -1.0

    def no_answers(batch: pd.DataFrame) -> pd.DataFrame:
        fail = batch["prompt"].str.startswith("A ")
        return pd.DataFrame({"id": batch["id"], "text": batch["prompt"].mask(fail, None), "error": fail.map({True: "refused", False: None})})

    rejects = []
    assert construct(b, no_answers, rejects=rejects).count() == 0
    lost = [tuple(r) for f in rejects for r in f.collect()]
    assert lost == [(1, 0, "first answer", "refused"), (1, 1, "first answer", "refused")]

    def broken(batch: pd.DataFrame) -> pd.DataFrame:
        raise RuntimeError("model down")

    df = spark.createDataFrame([(1, "p")], "id long, prompt string")
    good, bad = split_rejected(generate(df, "id", "prompt", "g", broken), "g")
    assert good.count() == 0 and bad.count() == 1 and "model down" in bad.first().g_error


def test_keyword_files_of_the_same_name_stay_apart(spark, tmp_path):
    from curatio.operators.prompts import read_keyword_files
    paths = []
    for k in ("one", "two"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "k.txt").write_text(f'{{"num": "{k}"}}\n\n{{"num": "{k}2"}}\n')
        paths.append(str(tmp_path / k / "k.txt"))
    got = sorted((r.file_pos, r.line_no, r.kw["num"]) for r in read_keyword_files(spark, paths).collect())
    assert got == [(0, 0, "one"), (0, 2, "one2"), (1, 0, "two"), (1, 2, "two2")]
