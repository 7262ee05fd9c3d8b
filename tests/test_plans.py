"""What the physical plans must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from casework.operators import dimension, records
from casework.plans import adapters, scoring_run
from casework.plans.queries import QUERIES
from casework.session import checkpoint
from casework.sources.writers import write_bucketed
from conftest import SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas")
# Windows over rows whose number does not grow with the data, or hardly: counts by hash prefix (65,536 at most),
# spans of 500,000 cases, and files.
SINGLE_TASK_WINDOWS = {
    "p1_sample_n", "a1_sampled_run", "a1_messages", "r8_running_accuracy", "r8_running_accuracy_gaps",
    "s1_load_cases_by_position", "s3_load_qa_by_position",
}


def plan(spark, name):
    df = QUERIES[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_forbidden_operator(spark, name):
    text = plan(spark, name)
    assert not [word for word in FORBIDDEN if word in text]
    if "SinglePartition" in text and "Window [" in text and name not in SINGLE_TASK_WINDOWS:
        windows = re.findall(r"Window \[.*?\], \[(.*?)\]", text)
        assert all(keys for keys in windows), text


@pytest.mark.parametrize(
    "name, columns",
    [
        ("q15_term_counts", {"text"}),
        ("e4_passk_summary", {"o_orderkey", "o_custkey", "n_name", "n_regionkey"}),
        ("q8_completeness", {"o_orderkey", "o_custkey"}),
        ("q1_split_sizes", {"o_orderkey"}),
        ("d12_explode_options", {"doc_id", "source"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan(spark, name))
    read = {field.split(":")[0] for schema in schemas for field in schema.split(",")}
    assert read == columns


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(n_regionkey), EqualTo(n_regionkey,0)]" in plan(spark, "d10_severe_block")
    assert "PushedFilters: [In(source, [no such source,src1,src2])]" in plan(spark, "p4c_filter_groups")


def test_decisions_need_no_shuffle_of_the_run(spark):
    """Parsing, extraction and decision are projections."""
    for name in ("r2_parse_response", "r4_score_match", "r5_extract_regex", "l3_decide", "l5_to_scoring"):
        text = plan(spark, name)
        assert "Exchange hashpartitioning(o_orderkey" not in text
        assert "SortMergeJoin" not in text


def test_samples_are_not_sorted_in_one_task(spark):
    """What meets in one task are counts; rows are numbered per prefix."""
    for name in ("p1_sample_n", "p2_shuffle_take"):
        windows = re.findall(r"Window \[row_number.*?\], \[(.*?)\]", plan(spark, name))
        assert windows and all("_prefix" in keys for keys in windows)


def test_histograms_shuffle_bins(spark):
    text = plan(spark, "q17_histogram")
    assert "Scan ExistingRDD" not in text and not re.findall(r"hashpartitioning\([^)]*_v#", text)


@pytest.mark.parametrize("name", ["e13_compare_phases", "e13_outcome_margins"])
def test_phases_are_one_scan_of_the_run(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("o_orderkey#") > 0
    scans = [line for line in plan(spark, name).splitlines() if "FileScan" in line and "o_orderkey" in line]
    assert len(scans) == 1


@pytest.mark.parametrize("name", ["p3_take_positions", "p5_quantile_exemplars", "q6_numeric_stats", "q18_box_summary"])
def test_no_range_sort_of_all_rows(spark, name):
    assert "rangepartitioning" not in plan(spark, name)


def test_a_stored_layout_moves_no_case_rows(spark, tmp_path):
    cases = adapters.literal_cases(spark, SMALL)
    write_bucketed(cases, "stored_cases", str(tmp_path / "cases"), buckets=4)
    responses = adapters.responses(spark, SMALL).select("case_id", "raw_model_response")
    write_bucketed(responses, "stored_responses", str(tmp_path / "responses"), buckets=4)
    try:
        codes = checkpoint(adapters.code_map(spark, SMALL))
        stored = spark.table("stored_cases")
        asked = {"case_num": F.col("case_id"), "severe_disease_list": F.lit("")}
        prepared = records.prepare_cases(stored, codes).withColumns(asked)
        scored = scoring_run.score_run(prepared, spark.table("stored_responses"))
        given = scoring_run.score_run(records.prepare_cases(cases, codes).withColumns(asked), responses)
        for df in (prepared, scored):
            text = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(case_id" not in text and "Bucketed: true" in text
        assert scored.exceptAll(given).count() == 0 and scored.count() == given.count()
    finally:
        spark.sql("drop table stored_cases")
        spark.sql("drop table stored_responses")


#: Queries that look codes up in a dictionary that can be beyond the size limit.
DICTIONARY_QUERIES = [
    "a1_messages", "a1_sampled_run", "d6a_decode_name", "d6b_decode_question", "d6c_decode_list", "d7_decode_symptoms",
    "f1_training_record_a", "f3_user_prompt", "f4_user_prompt_rules", "r7_assemble_results",
]


@pytest.mark.parametrize("name", DICTIONARY_QUERIES)
def test_a_dictionary_beyond_the_size_limit_is_not_broadcast(spark, monkeypatch, name):
    """Spark's own estimate, which counts neither rows nor salts, would broadcast it."""
    within = QUERIES[name](spark, SMALL).collect()
    monkeypatch.setattr(dimension, "fits_in_memory", lambda *args: False)
    beyond = QUERIES[name](spark, SMALL)
    joins = [line for line in beyond._jdf.queryExecution().executedPlan().toString().splitlines() if "_salt#" in line and "Join" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert sorted(beyond.collect(), key=str) == sorted(within, key=str)


#: Queries that join tables with a row per case.
CASE_JOINS = [
    "d6c_decode_list", "d7_decode_symptoms", "f1_training_record_a", "f3_user_prompt", "f4_user_prompt_rules", "r7_assemble_results",
]


@pytest.mark.parametrize("name", CASE_JOINS)
def test_cases_are_not_broadcast(spark, name):
    """Spark's own estimate, by the files, says nothing of how many rows a file holds or of parsed cells."""
    joins = [line for line in plan(spark, name).splitlines() if "Join [case_id#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
