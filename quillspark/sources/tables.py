"""Readers and writers of the tables that a collection of documents consists of."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.parse import PAGES

INDEX = "doc_id long, filename string, status string, progress double, page_count long, source_lang string, target_lang string, created_at timestamp, message string, output_ready boolean, run_id string"
GLOSSARY = "seq int, flat string, latex string, desc string, type string"
#: Documents of a layout's folder: few enough folders, and a document is in one.
BUCKETS = 64


def read_index(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """The index as JSON; rows of documents that aren't in existing (doc_id) go, a missing flag follows from the status."""
    rows = spark.read.schema(INDEX).json(path)
    if existing is not None:
        rows = rows.join(existing, "doc_id", "left_semi")
    return rows.withColumn("output_ready", F.coalesce("output_ready", F.col("status") == "completed"))


def write_index(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Dumped pages of glyph spans, one JSON object a line; unknown keys are ignored."""
    return spark.read.schema(PAGES).json(path)


def write_layout(blocks: DataFrame, path: str) -> None:
    blocks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_layout(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """All blocks, or those of a document, of which only its bucket is read."""
    rows = spark.read.parquet(path)
    if doc_id is not None:
        rows = rows.where((F.col("bucket") == F.pmod(F.xxhash64(F.lit(doc_id).cast("long")), F.lit(BUCKETS))) & (F.col("doc_id") == doc_id))
    return rows.drop("bucket")


def read_glossary(spark: SparkSession, *paths: str) -> DataFrame:
    """Entries (flat, latex, desc, type) of files, the later file's over the earlier's; type is subscript where it is missing. A file is JSON, an
    object a line, or the YAML of a glossary: a list of such entries, under ``entries`` or by itself (needs a YAML library). An entry's place is
    its place in the file, so files are read whole; they are small by nature. A file that isn't there has no entries."""
    out = []
    for path in paths:
        try:
            found = spark.read.option("wholetext", "true").text(path).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        for r in found:
            out += _entries(r["value"], path)
    rows = [(i, e["flat"], e.get("latex"), e.get("desc"), e.get("type") or "subscript") for i, e in enumerate(out) if e.get("flat")]
    return spark.createDataFrame(rows, GLOSSARY)


def _entries(text: str, path: str) -> list[dict]:
    if path.rstrip("/").endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text) or []
        return list(found.get("entries", []) if isinstance(found, dict) else found)
    return [json.loads(line) for line in text.splitlines() if line.strip()]
