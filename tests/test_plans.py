"""Shapes the physical plans must keep."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["accuracy_report", "agreement", "cohen_kappa", "apply_edits", "parse_labels", "to_training"])
def test_label_queries_never_read_text(spark, name):
    text = plan(spark, name)
    assert "ReadSchema" in text and "text:string" not in text and "EvalPython" not in text


@pytest.mark.parametrize("name", ["clean_basic", "clean_advanced", "clean_annotation"])
def test_cleaning_is_one_projection_over_one_arrow_step(spark, name):
    text = plan(spark, name)
    assert text.count("EvalPython") == 1 and "Join" not in text and "Aggregate" not in text
    # The only exchange spreads a table of one split over the cores.
    assert text.count("Exchange") == text.count("RoundRobinPartitioning") == 1


@pytest.mark.parametrize("name", ["term_stats", "document_terms", "tfidf_vectors", "count_vectors", "word2vec"])
def test_no_inferred_filter_repeats_the_cleaning(spark, name):
    text = plan(spark, name)
    assert "Filter (size(" not in text and text.count("EvalPython") == 1


def test_term_statistics_shuffle_once_after_combining(spark):
    text = plan(spark, "term_stats")
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text and "SortAggregate" not in text


def test_split_needs_no_shuffle(spark):
    assert "Exchange" not in plan(spark, "hash_split")


def test_edits_combine_before_the_shuffle(spark):
    text = plan(spark, "apply_edits")
    assert "partial_max" in text and "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_document_terms_need_no_shuffle_of_terms(spark):
    assert "hashpartitioning" not in plan(spark, "document_terms")
