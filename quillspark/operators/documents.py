"""Operators over document tables: admission, index, listing, messages, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.functions import patterns as P
from quillspark.functions import text as T
from quillspark.operators.translate import stored

MAX_UPLOAD = 100 * 1024 * 1024
#: Statuses, and those in which a document is being worked on.
STATUSES = ("uploaded", "queued", "parsing", "translating", "composing", "qa", "completed", "failed")
RUNNING = ("queued", "parsing", "translating", "composing", "qa")
LABELS = {"uploaded": "待处理", "queued": "排队中", "parsing": "解析中", "translating": "翻译中", "composing": "排版中", "qa": "校验中", "completed": "已完成", "failed": "失败"}


def admitted(name: Column, size: Column) -> Column:
    return F.endswith(F.lower(name), F.lit(".pdf")) & (size <= MAX_UPLOAD)


def read_uploads(spark, path: str) -> DataFrame:
    """Files of a folder that may be uploaded: path, length, content."""
    return spark.read.format("binaryFile").load(path).where(admitted(F.col("path"), F.col("length")))


def masked_secret(secret: Column) -> Column:
    return F.when(F.length(secret) > 8, F.concat(F.substring(secret, 1, 4), F.lit("****"), F.right(secret, F.lit(4)))).otherwise("****")


def coalesced(special: Column, main: Column) -> Column:
    return F.coalesce(F.nullif(special, F.lit("")), main)


def sees(model: Column, vision_model: Column) -> Column:
    name = F.lower(coalesced(vision_model, model))
    return (F.coalesce(vision_model, F.lit("")) != "") | F.exists(F.array(*map(F.lit, P.VISION_MARKERS)), lambda m: F.contains(name, m))


def messages(model: Column, system: Column, user: Column) -> Column:
    """A conversation for a model; models that only translate get the system's words in the user's turn."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    merged = F.when(F.coalesce(system, F.lit("")) != "", F.concat(system, F.lit("\n\n"), user)).otherwise(user)
    return F.when(model.isin(*P.TRANSLATION_ONLY), F.array(turn("user", merged))).otherwise(F.array(turn("system", system), turn("user", user)))


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), F.coalesce(mime, F.lit("image/png")), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def status_label(status: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), status), status)


def numbered_pages(docs: DataFrame, order: list[Column], size: int = 10) -> DataFrame:
    """docs with place and page (1-based) in an order over all documents. Ranges of the order are ranked each by itself, and the
    ranges' sizes added up, so that no task orders all documents. Spark samples the ranges' bounds anew each time that they are computed, so
    the rows are stored with their range: sizes and ranks are those of the same ranges."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(docs.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    parts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = parts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")
    return rows.join(before, F.col("__part") == F.col("__p")).withColumn("place", place).withColumn("page", F.floor((F.col("place") - 1) / size) + 1).drop("__part", "__p", "__before")


def assembled(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, pages, complete): whether each page (doc_id, page, w) has one file (doc_id, page, fw) of its width, and no file is left over. Null ids are a document."""
    right = files.select(F.col("doc_id").alias("__of"), F.col("page").alias("__at"), "fw")
    met = pages.join(right, F.col("doc_id").eqNullSafe(F.col("__of")) & (F.col("page") == F.col("__at")), "full")
    return met.groupBy(F.coalesce("doc_id", "__of").alias("doc_id")).agg(F.count("*").alias("pages"), F.bool_and(F.coalesce(F.col("w") == F.col("fw"), F.lit(False))).alias("complete"))


def page_reports(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, t, p, a, r): translated, protected, absorbed and retained blocks of each page."""
    said = F.col("translated")
    failed = F.col("translate") & ((said == "") | F.startswith(said, F.lit(P.FAILED)))
    absorbed = F.startswith(said, F.lit(P.ABSORBED))
    return blocks.groupBy("doc_id", "page").agg(F.count_if(F.col("translate") & ~failed & ~absorbed).alias("t"), F.count_if(~F.col("translate")).alias("p"), F.count_if(absorbed).alias("a"), F.count_if(failed).alias("r"))


def document_reports(pages: DataFrame) -> DataFrame:
    """Reports of pages (page_reports()) as those of documents."""
    return pages.groupBy("doc_id").agg(F.sum("t").alias("translated_blocks"), F.sum("p").alias("protected"), F.sum("a").alias("absorbed"), F.sum("r").alias("retained"), F.when(F.sum("r") > 0, "needs_review").otherwise("passed").alias("status"), F.count("*").alias("pages"))


def with_last(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """blocks with last, the translation (doc_id, source_id, seq, t) of the greatest seq, or null."""
    last = translations.groupBy(F.col("doc_id").alias("__doc"), F.col("source_id").alias("__id")).agg(F.max_by("t", "seq").alias("last"))
    return blocks.join(last, blocks.doc_id.eqNullSafe(F.col("__doc")) & (blocks.source_id == F.col("__id")), "left").drop("__doc", "__id")


def page_context(blocks: DataFrame, chars: int = 320) -> DataFrame:
    """(doc_id, page, before, after): the last text of the page before and the first of the page after, cut short."""
    ends = blocks.groupBy("doc_id", "page").agg(F.max_by("text", "ord").alias("last"), F.min_by("text", "ord").alias("first"))
    w = Window.partitionBy("doc_id").orderBy("page")
    return ends.select("doc_id", "page", F.lag(T.clip(F.col("last"), chars)).over(w).alias("before"), F.lead(T.clip(F.col("first"), chars)).over(w).alias("after"))


def progress(pages: DataFrame) -> DataFrame:
    """(doc_id, page, middle, done): the progress of a document in percent while a page (doc_id, page) is worked on, and after it."""
    p = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return pages.select("doc_id", "page", F.round(5 + 90 * ((p - 1) + 0.8) / n, 6).alias("middle"), F.round(5 + 90 * p / n, 6).alias("done"))
