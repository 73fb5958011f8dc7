"""Shape of the physical plans: what is read, what moves, what runs in Python."""

import re

import pytest

from scoreloom.plans.catalog import QUERIES

# Queries that need Python in tasks: workbook parsing, vocabulary lookup, one p-value.
PYTHON = {"pair_encode", "anova_length", "bulk_anova_length"}
# Jobs whose plan is only complete after they have run.
WRITES = {"fit_binary", "fit_multiclass_weighted", "fit_candidates", "report_json", "report_strategies",
          "report_evaluation", "report_baseline", "src_csv_scan", "src_csv_scan_keep_space", "src_csv_scan_russian",
          "src_workbook_scan", "src_csv_row_numbers", "src_workbook_row_numbers", "vocab_saved", "split_stored"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_cross_join_and_no_python_rows(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in PYTHON:
        assert "EvalPython" not in plan and "MapInPandas" not in plan


def read_columns(plan, table):
    found = re.findall(rf"{table}\.parquet\].*?ReadSchema: struct<(.*?)>\s", plan)
    return [set(re.findall(r"(\w+):", f)) for f in found]


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = plan_of(QUERIES["metrics_summary"](spark, sf_dir))
    assert read_columns(plan, "lineitem") == [{"l_orderkey", "l_partkey", "l_linenumber", "l_quantity"}]
    plan = plan_of(QUERIES["value_counts"](spark, sf_dir))
    assert read_columns(plan, "lineitem") == [{"l_quantity"}]
    plan = plan_of(QUERIES["sample_ledger"](spark, sf_dir))
    assert read_columns(plan, "labels") == [{"doc_id", "quality", "toxic"}]


@pytest.mark.parametrize("name", ["metrics_summary", "classification_report", "bulk_accuracy_by_length",
                                  "log_loss", "class_weights", "per_class_accuracy", "best_candidate"])
def test_one_shuffle_per_metric_family(spark, sf_dir, name):
    """The rows are aggregated once; the metrics on top need no further exchange."""
    df = QUERIES[name](spark, sf_dir)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    stages = set(re.findall(r"ShuffleQueryStage (\d+)", final))
    reused = final.count("ReusedExchange")
    assert len(stages) - reused <= 1, final


def test_texts_do_not_pass_the_joins_of_the_length_study(spark, sf_dir):
    plan = plan_of(QUERIES["bulk_length_correlation"](spark, sf_dir))
    assert "Join" not in plan
    plan = plan_of(QUERIES["accuracy_by_length"](spark, sf_dir))
    # The text column is only mentioned where its length is taken, at the scans.
    assert all("length(text" in line or "FileScan" in line or "isnotnull" in line
               for line in plan.splitlines() if re.search(r"\btext#\d+", line))


# Queries on the large table that may read it more than once: ranks and whiskers.
PASSES = {}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_the_large_table_is_read_once(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir)).split("== Initial Plan ==")[-1]
    assert plan.count("lineitem.parquet") <= PASSES.get(name, 1)
    assert plan.count("embeddings.parquet") <= 1
