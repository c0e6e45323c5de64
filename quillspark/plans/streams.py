"""Queries that run a stream to its end."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import sql as S
from quillspark.plans.fidelity import block_table
from quillspark.streaming import pages


def shared(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; without one, on one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    return f"{found}/quillspark/{name}-{uuid.uuid4().hex}"


def stream_pages(spark: SparkSession, d: str) -> DataFrame:
    """Blocks are dealt out by document, written as files, and published in micro-batches."""
    at = shared(spark, "pages")
    rows = block_table(spark, d).select("doc_id", "page", "ord", "translated")
    rows.repartition(8, "doc_id").write.parquet(f"{at}/in")
    pages.publish_pages(spark, f"{at}/in", rows.schema, f"{at}/out")
    return pages.published(spark, f"{at}/out").select("doc_id", "page", "run_id", "blocks", "blank")


QUERIES = {"stream_pages": stream_pages}
ORACLES = {"stream_pages": S.with_blocks("SELECT doc_id, page, 'run' AS run_id, count(*) AS blocks, count(*) FILTER (translated = '') AS blank FROM b GROUP BY doc_id, page")}
