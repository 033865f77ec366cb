"""Plan guards for every registered query: no cartesian products or
nested-loop joins, column pruning and pushed filters on the main scans."""

import re

import pytest

from conftest import SF_SMALL


def _plan(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_products_anywhere(spark):
    import __spark_entry__ as E
    bad = {}
    for name in E.queries():
        plan = _plan(spark, name)
        hits = re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
        if hits:
            bad[name] = sorted(set(hits))
    assert not bad, bad


@pytest.mark.parametrize("name,table,filt", [
    ("stop_token_cut", "conversations", "EqualTo(role,assistant)"),
    ("instruction_cleanup", "conversations", "EqualTo(role,user)"),
    ("vector_topk", "embeddings", "EqualTo(label,0)"),
    ("influence", "embeddings", "LessThan(label,3)"),
    ("score_histogram", "events", "IsNotNull(value)"),
])
def test_filters_reach_the_scan(spark, name, table, filt):
    assert filt in _plan(spark, name)


@pytest.mark.parametrize("name,max_cols", [("score_histogram", 1), ("keyword_tags", 2), ("similar_pairs", 2),
                                           ("duplicate_texts", 2), ("mtld", 3)])
def test_scans_read_only_needed_columns(spark, name, max_cols):
    plan = _plan(spark, name)
    schemas = re.findall(r"ReadSchema: struct<([^\n]*?)>(?:,|\n|$)", plan)
    assert schemas
    for sch in schemas:
        cols = re.findall(r"(?:^|,)(\w+):", sch)
        assert len(cols) <= max_cols, (name, sch)
