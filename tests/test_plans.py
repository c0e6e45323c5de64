"""What plans may hold: columns that are needed, equality joins, no pairs of all rows."""

import contextlib
import io
import re

import pytest

from quillspark.plans import documents, fidelity, layout

QUERIES = fidelity.QUERIES | layout.QUERIES | documents.QUERIES


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text)


@pytest.mark.parametrize("name, columns", [("classify_blocks", {"doc_id", "text"}), ("doc_status", {"user_id", "event_type", "ts", "event_id"}), ("qa_summary", {"doc_id", "text"}), ("mask_secret", {"item_id"})])
def test_scans_read_what_is_needed(spark, sf_dir, name, columns):
    read = re.findall(r"ReadSchema: struct<(.*?)>\n", plan(QUERIES[name](spark, sf_dir)))
    assert read and all({c.split(":")[0] for c in r.split(",")} <= columns for r in read)


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(documents.delete_docs(spark, sf_dir))
    assert "EqualTo(toxic,1)" in text


def test_extraction_is_one_stage(spark, sf_dir, tmp_path):
    """Of a table that is read in as many parts as there are cores; one that isn't is dealt out first."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(32).write.parquet(f"file://{tmp_path}/documents.parquet")
    text = plan(fidelity.QUERIES["protected_tokens"](spark, f"file://{tmp_path}"))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text
    assert plan(fidelity.QUERIES["protected_tokens"](spark, sf_dir)).count("REPARTITION_BY_NUM") <= 2
