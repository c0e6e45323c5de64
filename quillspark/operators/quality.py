"""Fidelity of translations: what each block contributes, and its document's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions import text as T

#: Details of a document's summary at most.
DETAILS = 50


def _strings(when: Column, *items: Column) -> Column:
    return F.when(when, F.array(*items)).otherwise(F.array().cast("array<string>"))


def block_quality(rows: DataFrame) -> DataFrame:
    """rows (doc_id, ord, source_id, type, translate, vision, text, translated) as doc_id, ord, blank, numeric, unit, formula, citation and details."""
    source, target = F.col("text"), F.col("translated")
    rewritten = ~F.col("translate") & (F.col("type") == "formula") & (T.stripped(source) != T.stripped(target))
    blank = F.col("translate") & ((T.stripped(target) == "") | F.startswith(target, F.lit(P.FAILED)))
    checked = F.col("translate") & ~blank & ~F.startswith(target, F.lit(P.ABSORBED))
    folded, said = T.merge_scripts(source), T.merge_scripts(target)
    kept = rows.select("doc_id", "ord", "source_id", "vision", rewritten.alias("rewritten"), blank.alias("blank"), F.when(checked, T.missing_tokens(folded, said)).alias("lost"), F.when(checked, T.symbol_changes(folded, said)).alias("change"), F.when(checked, T.missing_figures(source, target)).alias("refs"))
    cites = lambda t: t.rlike(r"(?i)\[\d+|Fig\.|Table|Eq\.")
    units = lambda t: ~cites(t) & t.rlike(r"(?i)dB|mW|nm|Gb/s|%|mm")
    drift = F.coalesce((F.size("change.added") > 0) | (F.size("change.removed") > 0), F.lit(False))
    lost, refs = (F.coalesce(c, F.array().cast("array<string>")) for c in ("lost", "refs"))
    name = F.concat(F.lit(" ["), "source_id", F.lit("]: "))
    label = lambda t: F.concat(F.when(cites(t), "引用/编号丢失").when(units(t), "单位/数值丢失").otherwise("数值丢失"), name, t)
    details = F.concat(
        _strings(F.col("rewritten"), F.concat(F.lit("公式被改写: "), "source_id")),
        _strings(F.col("blank"), F.concat(F.lit("漏译段落: "), "source_id")),
        _strings(drift, F.concat(F.when(F.col("vision"), "软告警: ").otherwise(""), F.lit("科学符号增删或改写"), name, T.symbol_diff_text(F.col("change.added"), F.col("change.removed")))),
        F.transform(lost, label),
        F.transform(F.array_sort(refs), lambda r: F.concat(F.lit("图表引用丢失"), name, r)),
    )
    return kept.select("doc_id", "ord", "blank", (~F.exists(lost, lambda t: ~cites(t) & ~units(t))).alias("numeric"), (~F.exists(lost, units)).alias("unit"), (~F.col("rewritten") & ~(drift & ~F.col("vision"))).alias("formula"), (~F.exists(lost, cites) & (F.size(refs) == 0)).alias("citation"), details.alias("details"))


def summary(quality: DataFrame, most: int = DETAILS) -> DataFrame:
    """Per document: four kinds of fidelity, missing paragraphs, whether all is well, and the first details in order of blocks.

    Details of more than most blocks aren't gathered: a block that comes after that many with details has none in the summary."""
    some = F.when(F.size("details") > 0, F.col("ord"))
    rows = quality.withColumn("place", F.count(some).over(Window.partitionBy("doc_id").orderBy("ord")))
    first = F.when((F.size("details") > 0) & (F.col("place") <= most), F.struct("ord", "details"))
    got = rows.groupBy("doc_id").agg(*[F.bool_and(c).alias(c) for c in ("numeric", "unit", "formula", "citation")], F.count_if("blank").alias("missing"), F.array_sort(F.collect_list(first)).alias("d"))
    overall = F.col("numeric") & F.col("unit") & F.col("formula") & F.col("citation") & (F.col("missing") == 0)
    return got.select("doc_id", "numeric", "unit", "formula", "citation", "missing", overall.alias("overall"), F.slice(F.flatten(F.transform("d", lambda x: x.details)), 1, most).alias("details"))
