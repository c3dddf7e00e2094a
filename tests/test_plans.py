"""What the plans must look like: built-in operators, Arrow batches where words are found, pruned and filtered scans, no cross joins."""

import re

import pytest

import __spark_entry__ as entry
from quillon.storage import spread

FOLDER = "/root/testdata/sf0.001"
CORE = entry.CORE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["make_split", "doc_entities", "unicode_unescape", "p5_found"])
def test_what_needs_no_words_stays_in_the_jvm(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", text)


@pytest.mark.parametrize(("name", "steps"), [("word_tokens", 1), ("chunk_documents", 1), ("seq2seq_format", 1), ("bio_tags", 1), ("bio_decode", 2), ("micro_prf1", 2)])
def test_words_and_tags_take_one_arrow_step_each(spark, name, steps):
    """Whole batches at a third to a tenth of the CPU seconds of array expressions (README): never a step of Python for a row,
    and texts handed over once."""
    text = plan(entry.queries()[name](spark, FOLDER))
    assert not re.search("BatchEvalPython|Pandas|CartesianProduct|BroadcastNestedLoop", text)
    assert len(re.findall("ArrowEvalPython", text)) == steps


def test_one_pass_queries_do_not_shuffle(spark):
    queries = entry.queries()
    for name in ("seq2seq_target", "strip_chunk_suffix", "unicode_unescape", "argmax_labels"):
        assert "Exchange" not in plan(queries[name](spark, FOLDER))
    for name in ("word_tokens", "bio_tags", "chunk_documents"):  # only the spreading of one small file
        assert set(re.findall(r"Exchange (\w+)", plan(queries[name](spark, FOLDER)))) <= {"RoundRobinPartitioning"}


def test_scoring_shuffles_once_by_pair(spark):
    text = plan(entry.queries()["per_doc_prf1"](spark, FOLDER))
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+, entity#\d+", text)) == 1 and "Join" not in text


def test_scans_are_pruned_and_filtered(spark):
    text = plan(entry.queries()["strip_chunk_suffix"](spark, FOLDER))
    assert "ReadSchema: struct<row_id:bigint,doc_id:string>" in text
    text = plan(entry.queries()["word_count"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(text)]" in text and "entities" not in text


def test_a_wide_scan_is_not_repartitioned(spark):
    wide = spark.range(100).repartition(16)
    assert spread(wide) is wide
    grouped = spark.range(100).groupBy("id").count()  # must not run a first time to be counted
    assert spread(grouped) is grouped
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
