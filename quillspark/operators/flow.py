"""The flow of pages: blocks are translated, what fails goes to a fallback and then to a repair, quality is checked, and pages are published.

Each model call is made once and its outcome stored; every step after that is an expression over the stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions import text as T
from quillspark.operators import quality
from quillspark.operators import translate as M


def going() -> Column:
    """Whether a block goes to the model; others are passed through."""
    return F.col("translate") & F.col("text").rlike(r"\S")


def failed(translated: Column) -> Column:
    return F.startswith(translated, F.lit(P.FAILED))


def translated(rows: DataFrame, translator: M.Translator, fallback: M.Translator | None = None, repair: M.Translator | None = None, retries: int = 2, folder: str | None = None) -> DataFrame:
    """rows (doc_id, page, ord, source_id, text, translate, ...) with translated, error, stage (none, model, fallback or repair) and attempt.

    A repair is taken only if it keeps the text's symbols. Blocks that no stage could translate keep the last failure as their text."""
    names = rows.columns
    left = rows.where(going())
    done = rows.where(~F.coalesce(going(), F.lit(False))).select("*", F.col("text").alias("translated"), F.lit(None).cast("string").alias("error"), F.lit("none").alias("stage"), F.lit(0).alias("attempt"))
    stages = [(k, t) for k, t in (("model", translator), ("fallback", fallback), ("repair", repair)) if t is not None]
    for i, (stage, model) in enumerate(stages):
        got = M.staged_translation(left, model, retries if stage == "model" else 1, folder=folder).withColumn("stage", F.lit(stage))
        if stage == "repair":
            change = T.symbol_changes(F.col("text"), F.col("translated"))
            lost = F.col("error").isNull() & ((F.size(change.added) > 0) | (F.size(change.removed) > 0))
            got = got.withColumn("error", F.when(lost, F.lit("科学符号增删或改写")).otherwise(F.col("error"))).withColumn("translated", F.when(lost, F.concat(F.lit(P.FAILED + " "), "error", F.lit("]"))).otherwise(F.col("translated")))
        last = i == len(stages) - 1
        done = done.unionByName(got if last else got.where("error IS NULL"))
        left = got.where("error IS NOT NULL").select(*names)
    return done


def published(done: DataFrame) -> DataFrame:
    """A row for each page: its blocks, how many came from a fallback or a repair or failed, and the digest of its texts in order."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "translated"))), lambda x: x.translated), "\n")
    return done.groupBy("doc_id", "page").agg(F.count("*").alias("blocks"), F.count_if(F.col("stage") == "fallback").alias("fallbacks"), F.count_if(F.col("stage") == "repair").alias("repairs"), F.count_if(failed(F.col("translated"))).alias("failures"), F.md5(lines.cast("binary")).alias("digest"))


def checked(done: DataFrame) -> DataFrame:
    """The quality summary of each document of the flow."""
    return quality.summary(quality.block_quality(done))
