"""Pages as they are finished: a stream of translated blocks becomes page data and, after it, the pages' publication.

Micro-batches write their data under their own number, so that a batch that is tried again overwrites itself, and the
publication row only after the data: what is published is there, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def publish_pages(spark: SparkSession, source: str, schema: StructType, target: str, files_per_batch: int = 4, run_id: str = "run") -> None:
    """Reads all files of blocks that are new in source, and writes target/data and target/published by batch."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/data/batch={number}")
        pages = rows.groupBy("doc_id", "page").agg(F.count("*").alias("blocks"), F.count_if(F.col("translated") == "").alias("blank"))
        pages.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{target}/published/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    done = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{target}/_checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()


def published(spark: SparkSession, target: str) -> DataFrame:
    """Pages that can be read: a page whose blocks came in several batches is one."""
    return spark.read.parquet(f"{target}/published").groupBy("doc_id", "page", "run_id").agg(F.sum("blocks").alias("blocks"), F.sum("blank").alias("blank"))


def current(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Published pages of each document's latest run; runs: (doc_id, run_id, started)."""
    last = runs.groupBy("doc_id").agg(F.max_by("run_id", "started").alias("run_id"))
    return pages.join(last, ["doc_id", "run_id"], "left_semi")


def status_stream(events: DataFrame, status) -> DataFrame:
    """A streaming table of each document's status: that of its latest event (doc_id, ts, event_id)."""
    return events.groupBy("doc_id").agg(F.max_by(status, F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"))
