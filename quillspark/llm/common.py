"""What the operators of this package share: batches, stored tables, hashes of ids."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (by the batch's mean) of the pieces in which batches are worked on.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, but only if the
    executors are threads of the driver (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, keep: str = "table") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: computed once, its lineage cut,
    and readable after any executor is lost. The folder goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillspark/{keep}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before
        pass


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within, an action's shuffle files go when it has ended: what follows reads the tables that it has stored."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; fn gets batches of BATCH_ROWS rows and some BATCH_BYTES bytes at most, whatever batches the session sends (64 MB by Spark's default)."""

    def cut(batches):
        for batch in batches:
            rows = max(1, min(BATCH_ROWS, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    return df.mapInArrow(lambda batches: fn(cut(batches)), schema)


def crc_mod(doc_id, n: int):
    """crc32 of the id's decimal text, modulo n; of a null id: that of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as bytes; null is empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8."""
    return text.split()
