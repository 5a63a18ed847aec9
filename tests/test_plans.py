"""Shuffles and scans of executed plans."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tidewater import registry
from tidewater.functions import aggregates as A
from tidewater.operators import grouping

SF = "/root/testdata/sf0.001"


def executed(df):
    """The plan that ran, without what it was planned as at first."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.partition("== Initial Plan ==")[0]


@pytest.fixture
def shuffling(spark):
    """Joins of small tables shuffle, as large ones do."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("inputs", "shuffles"), [(2, 2), (3, 4)])
def test_co_aggregation_shuffles_each_input_once(shuffling, inputs, shuffles):
    """Beyond two inputs the rows joined so far shuffle once more each."""
    frames = [shuffling.read.parquet(f"{SF}/lineitem.parquet").where(f"l_linenumber = {k + 1}") for k in range(inputs)]
    out = grouping.co_aggregate([(df, [F.col("l_partkey")]) for df in frames], [(f"n{k}", A.counting()) for k in range(inputs)])
    assert len(re.findall(r"\bExchange hashpartitioning", executed(out))) == shuffles


def test_mixed_operations_shuffle_once_each(shuffling):
    df = shuffling.read.parquet(f"{SF}/documents.parquet")
    out = grouping.aggregate(df, [F.col("lang")], {"n": A.counting(), "words": A.flat_mapping("split(text, ' ')", lambda w: A.counting(), "w")})
    assert len(re.findall(r"\bExchange hashpartitioning", executed(out))) == 2


def test_tf_idf_counts_words_once(spark):
    plan = executed(registry.QUERIES["tf_idf"](spark, SF))
    assert "ReusedExchange" in plan and len(re.findall(r"Generate explode", plan)) == 1


def test_tf_idf_deals_words_out_once(shuffling):
    """Documents and words shuffle once each, and no table of a task's documents and words is held or sorted."""
    plan = executed(registry.QUERIES["tf_idf"](shuffling, SF))
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) - plan.count("ReusedExchange") == 2
    assert "SortMergeJoin" not in plan and not re.search(r"HashAggregate\(keys=\[doc_id", plan)


def test_tf_idf_counts_rows_of_one_document_together(spark, tmp_path):
    rows = [(1, "The cat, the\u212aCAT"), (1, "cat"), (2, None), (3, ""), (None, "the dog"), (None, "dog \u00e9t\u00e9"), (4, "12 - 7"), (5, "the " * 300_000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    ln = lambda df: math.log(8) - math.log(df)
    want = {(1, "the"): 2 * ln(3), (1, "cat"): 3 * ln(1), (None, "the"): ln(3), (None, "dog"): 2 * ln(1), (None, "t"): ln(1), (5, "the"): 300_000 * ln(3)}
    got = registry.QUERIES["tf_idf"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.doc_id, r.word): r.score for r in got} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_items_by_one_key_are_hashed(spark):
    """A struct as key would sort all exploded words before they are aggregated."""
    assert not re.findall("SortAggregate", executed(registry.QUERIES["flat_mapping"](spark, SF)))
    df = spark.read.parquet(f"{SF}/orders.parquet")
    plan = executed(grouping.aggregate(df, [F.col("o_custkey")], {"a": A.max_by("o_orderkey", "o_totalprice"), "b": A.filtering("o_orderkey > 5", A.min_by("o_orderkey", "o_totalprice"))}))
    assert not re.findall("SortAggregate", plan)


def test_top_n_gathers_few_rows(spark):
    """Ranks are cut before rows are gathered, in part before they shuffle."""
    df = spark.read.parquet(f"{SF}/orders.parquet")
    plan = executed(grouping.aggregate(df, [F.col("o_orderpriority")], {"top": A.top_n(5, "o_orderkey", "o_totalprice")}))
    assert len(re.findall("WindowGroupLimit", plan)) >= 1
