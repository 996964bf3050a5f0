"""Cleaning rules on small texts, and that cleaning twice changes nothing."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import clean

CASES = [
    (clean.remove_zero_width, "a​b‌c‍d﻿", "abcd"),
    (clean.remove_control_chars, "a\x00b\tc\x1fd\x9fe", "ab\tcde"),
    (clean.fullwidth_to_halfwidth, "Ｈｅｌｌｏ！　x", "Hello!　x"),
    (clean.normalize_line_endings, "a\r\nb\rc", "a\nb\nc"),
    (clean.strip_trailing_whitespace, "a  \nb\t\nc", "a\nb\nc"),
    (clean.collapse_blank_lines, "a\n\n\n\n\nb", "a\n\n\nb"),
    (clean.trim_file_ends, "\n\na\nb\n\n", "a\nb"),
    (clean.ensure_heading_spacing, "a\n# b\n## c\n\n# d", "a\n\n# b\n\n## c\n\n# d"),
    (clean.ensure_list_spacing, "a\n- b\n- c\nd\n\n1. e\n```\nx", "a\n\n- b\n- c\n\nd\n\n1. e\n```\nx"),
    (clean.ensure_code_block_spacing, "a\n```\nb\n```\nc\n```py\nd", "a\n\n```\nb\n```\nc\n\n```py\nd"),
    (clean.ensure_code_block_spacing, "```\na\n```\n\n```\nb", "```\na\n```\n\n```\nb"),
    (clean.remove_page_numbers, "a\n- 12 -\nPage 3 of 9\np. 4\nb", "a\n\n\n\nb"),
    (clean.remove_separators, "a\n" + "-" * 24 + "\nb", "a\n\nb"),
    (clean.clean_passage, "# T\n\n[x](u) ![alt](i) `c` <b>y</b>\n- z\n```\nq\n```", "T\n\nx !alt c y\nz"),
    (clean.normalize_unicode, "é", "é"),
]


@pytest.mark.parametrize(("rule", "raw", "want"), CASES)
def test_rules(spark, rule, raw, want):
    df = spark.createDataFrame([(raw,), (None,)], "t string")
    got = [r[0] for r in df.select(rule(F.col("t"))).collect()]
    assert got == [want, None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab -#`*1.\n\t|", max_size=60), min_size=20, max_size=40))
def test_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select(clean.clean_native(clean.clean_native(F.col("t"))).alias("t"))
    for a, b in once.select("t", clean.clean_native(F.col("t"))).collect():
        assert a == b


def test_rules_run_once(spark):
    """Each rule of cleaning a document, and of a passage, is in the plan of indexing once."""
    from quern.plans.index_queries import index_documents

    docs = spark.createDataFrame([(1, "k", "a\n- b\nc\n```\nx\n```\n\n\n\n\nlast words of it"), (2, "k", None), (3, "k", "short")], "doc_id long, kb_id string, text string")
    found = index_documents(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[ \\t]+$") == 1 and plan.count("{20,}") == 1 and plan.count("<[^>]+>") == 1
    whole = docs.withColumn("own", clean.clean_document(F.col("text")))
    assert [tuple(r) for r in clean.with_clean_document(docs, "text").select("doc_id", "text").collect()] == [tuple(r) for r in whole.select("doc_id", "own").collect()]
    assert found.count() == 1
