"""Registered queries against their DuckDB oracles on the smallest tables."""

import pytest

from conftest import SF_SMALL

FAST = ["turn_pairs", "dialog_lengths", "final_score", "score_histogram", "duplicate_texts",
        "judge_parse", "prompt_fill", "similar_pairs", "knn_i", "influence", "greedy_diverse",
        "greedy_diverse_batched", "unigram_ppl", "render_template", "category_map"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    from compare import compare
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res[0] == "OK", res


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["conv_id", "final_score", "sel_rank"]
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
