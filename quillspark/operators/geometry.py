"""Operators over blocks of pages by their rectangles. Blocks are rows (doc_id, page, ord, x0, y0, x1, y1, ...).

Joins are keyed by document and page (null ids are a document), so that what compares rectangles stays within a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import layout as L
from quillspark.functions import patterns as P
from quillspark.functions import text as T


def page_key(left: str = "a", right: str = "o") -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.page") == F.col(f"{right}.page"))


def first() -> dict[str, Column]:
    return L.rect("a.")


def other() -> dict[str, Column]:
    return L.rect("o.")


def met(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """left (a) and right (o) of one page where on holds."""
    return left.alias("a").join(right.alias("o"), page_key() & on, how)


def pairs(blocks: DataFrame, on: Column | None = None) -> DataFrame:
    """Each two blocks of a page once, the earlier one as a."""
    each = F.col("a.ord") < F.col("o.ord")
    return met(blocks, blocks, each if on is None else each & on)


def _of(blocks: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    """blocks joined with marked (of, at): documents and their blocks' numbers."""
    return blocks.join(marked, blocks.doc_id.eqNullSafe(marked["of"]) & (blocks.ord == marked["at"]), how)


def without_overlaps(blocks: DataFrame, ratio: float = L.PREPARED) -> DataFrame:
    """Blocks that stay when of two that overlap the smaller goes, the earlier one of two alike."""
    smaller = F.when(L.area(first()) <= L.area(other()), F.col("a.ord")).otherwise(F.col("o.ord"))
    lost = pairs(blocks, L.significant(first(), other(), ratio)).select(F.col("a.doc_id").alias("of"), smaller.alias("at")).distinct()
    return _of(blocks, lost, "left_anti")


def beside(blocks: DataFrame, others: DataFrame, above: float = -4, gap: float = 48) -> DataFrame:
    """Blocks that stand beside another one of others."""
    return met(blocks, others, (F.col("a.ord") != F.col("o.ord")) & L.near(first(), other(), above, gap), "left_semi")


def _origin() -> Column:
    return F.abs(first()["x0"] - other()["x0"]) + F.abs(first()["y0"] - other()["y0"])


def nearest(blocks: DataFrame, raw: DataFrame) -> DataFrame:
    """(doc_id, ord, raw_ord): for each block the nearest of raw (doc_id, page, raw_ord and corners) on its page, the first of equals; null on a page without."""
    return met(blocks, raw, F.lit(True), "left").groupBy("a.doc_id", "a.ord").agg(F.min_by("o.raw_ord", F.struct(L.distance(first(), other()), F.col("o.raw_ord"))).alias("raw_ord"))


def rematched(blocks: DataFrame, raw: DataFrame, within: float = 1) -> DataFrame:
    """(doc_id, ord, raw_ord, y0): the raw block whose edges all lie within a distance, the nearest origin first, and its top."""
    close = F.greatest(*[F.abs(first()[k] - other()[k]) for k in first()]) < within
    order = F.struct(_origin(), F.col("o.raw_ord"))
    return met(blocks, raw, close, "left").groupBy("a.doc_id", "a.ord").agg(F.min_by("o.raw_ord", order).alias("raw_ord"), F.coalesce(F.min_by("o.y0", order), F.first("a.y0")).alias("y0"))


def rematched_by_text(blocks: DataFrame, raw: DataFrame) -> DataFrame:
    """(doc_id, ord, raw_ord): the nearest raw block of the same text."""
    return met(blocks, raw, F.col("a.text") == F.col("o.text")).groupBy("a.doc_id", "a.ord").agg(F.min_by("o.raw_ord", F.struct(_origin(), F.col("o.raw_ord"))).alias("raw_ord"))


def absorbed(blocks: DataFrame) -> DataFrame:
    """Blocks that absorbed others (whose translation names them), widened to hold these, with how many they are."""
    rows = blocks.withColumn("__into", F.regexp_extract("translated", r"^\[MERGED_INTO:(.+?)\]$", 1))
    members = rows.where("__into <> ''").groupBy("doc_id", "__into").agg(F.min("x0").alias("mx0"), F.max("x1").alias("mx1"), F.max("y1").alias("my1"), F.count("*").alias("n"))
    left = rows.where("__into = ''").drop("__into")
    joined = left.alias("a").join(members.alias("g"), F.col("a.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("source_id") == F.col("__into")), "left")
    return joined.select("a.doc_id", "ord", F.least("x0", "mx0").alias("x0"), F.greatest("x1", "mx1").alias("x1"), F.greatest("y1", "my1").alias("y1"), F.coalesce("n", F.lit(0)).alias("members"))


def flow_limits(blocks: DataFrame, reach: float = 20, bottom: float = L.PAGE_HEIGHT - 12) -> DataFrame:
    """(doc_id, ord, y1): how far down each translated block may flow: a little, up to the page's foot or the next thing below it."""
    below = (F.col("a.ord") != F.col("o.ord")) & (F.least(first()["x1"], other()["x1"]) > F.greatest(first()["x0"], other()["x0"])) & (other()["y0"] >= first()["y1"] - 0.1)
    end = F.first("a.y1")
    return met(blocks.where("translate"), blocks, below, "left").groupBy("a.doc_id", "a.ord").agg(F.greatest(end, F.least(F.lit(bottom), end + reach, F.min(other()["y0"] - 1))).alias("y1"))


def in_reading_order(blocks: DataFrame) -> DataFrame:
    """blocks with place, their number on the page from top to bottom, then left to right."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "ord")).cast("long"))


def fit_level(translated: Column, size: Column, width: Column, height: Column) -> Column:
    """The first of L.LEVELS at which a translation fits by a budget of characters (an approximation: nothing is typeset), or -1."""

    def fits(scale, leading):
        adjusted = F.greatest(F.lit(7.0), size * scale)
        floor = F.greatest(F.lit(0.6), F.least(F.lit(1.0), 5.5 / adjusted))
        per_line = F.greatest(F.lit(1), F.floor(width / (adjusted * 0.7 * floor)))
        return F.ceil(F.length(translated) / per_line) * adjusted * leading * floor <= height

    level = F.lit(-1)
    for i, (scale, leading) in reversed(list(enumerate(L.LEVELS))):
        level = F.when(fits(scale, leading), i).otherwise(level)
    return level.cast("int")


def retained(blocks: DataFrame, width: float = L.PAGE_WIDTH, height: float = L.PAGE_HEIGHT) -> DataFrame:
    """Blocks that go (and aren't absorbed) with reason: why the source stays, or null."""
    mine = blocks.where(F.col("translate") & ~F.startswith("translated", F.lit(P.ABSORBED)))
    hit = met(mine, blocks.where("NOT translate"), L.significant(first(), other(), L.INITIAL)).select(F.col("a.doc_id").alias("of"), F.col("a.ord").alias("at")).distinct()
    page = {"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(width), "y1": F.lit(height)}
    own = L.rect()
    reason = F.when((T.stripped(F.col("translated")) == "") | F.startswith("translated", F.lit(P.FAILED)), "没有有效译文，已保留原文").when((L.area(own) <= 0) | ~L.contains(page, own), "文字区域越界，已保留原文").when(F.col("at").isNotNull(), "与公式或图形保护区相交，已保留原文")
    return _of(mine, hit, "left").withColumn("reason", reason).drop("of", "at")
