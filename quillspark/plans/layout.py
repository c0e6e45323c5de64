"""Queries over the geometry of blocks: classification, spatial joins, fonts, fixpoints, units, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import layout as L
from quillspark.functions import patterns as P
from quillspark.functions import text as T
from quillspark.operators import artwork, pages
from quillspark.operators import geometry as G
from quillspark.plans import sql as S
from quillspark.plans.fidelity import block_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, *more: str):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = S.with_blocks(oracle, *more)
        return fn

    return register


def simple(name: str, columns: Callable[[], dict], oracle: dict | None) -> None:
    query(name, oracle and "SELECT doc_id, ord, " + ", ".join(f"{v} AS {k}" for k, v in oracle.items()) + " FROM b")(lambda spark, d: block_table(spark, d).select("doc_id", "ord", *[c.alias(k) for k, c in columns().items()]))


def page_key(df: DataFrame, left: str, right: str):
    """Blocks of one document and page; the join is on these, so the theta part stays within a page."""
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.page") == F.col(f"{right}.page"))


SAME = "a.doc_id IS NOT DISTINCT FROM o.doc_id AND a.page = o.page"


def text():
    return F.col("text")


def own() -> dict:
    return L.rect()


def first() -> dict:
    return L.rect("a.")


def other() -> dict:
    return L.rect("o.")


def width():
    return F.col("x1") - F.col("x0")


def height():
    return F.col("y1") - F.col("y0")



def m(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {S.q(pattern.replace('(?iu)', '(?i)'))})"


def classify_sql(t: str = "text") -> str:
    s = S.stripped(t)
    return (
        f"CASE WHEN {m(s, P.CAPTION)} THEN 'caption' WHEN y1 < 792.0 * 0.06 THEN 'header' WHEN y0 > 792.0 * 0.94 AND {m(s, '^[0-9]+$')} THEN 'page_number' WHEN y0 > 792.0 * 0.94 THEN 'footer' "
        f"WHEN {m(s, P.SECTION)} AND length({t}) < 120 THEN 'section' WHEN starts_with(lower({t}), 'abstract') THEN 'abstract' WHEN starts_with(lower({t}), 'references') OR starts_with(lower({t}), 'bibliography') THEN 'reference' "
        f"WHEN {S.formula(t)} THEN 'formula' WHEN y0 < 792.0 * 0.12 AND length({t}) < 180 AND NOT {m(t, '[.;:]$')} AND NOT {m(t, 'Fig\\.|Table|see |See ')} THEN 'title' ELSE 'paragraph' END"
    )


simple("classify_blocks", lambda: {"class": L.classify(text(), F.col("y0"), F.col("y1"))}, {"class": classify_sql()})


@query("translate_flags", f"SELECT doc_id, ord, CASE WHEN c <> 'caption' AND f THEN 'formula' ELSE c END AS type, c IN ('title', 'abstract', 'section', 'paragraph', 'caption', 'table_text', 'footnote') AND NOT f AS translate FROM (SELECT *, {classify_sql()} AS c, {S.formula('text')} AS f FROM b) z")
def translate_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = block_table(spark, d).select("doc_id", "ord", L.classify(text(), F.col("y0"), F.col("y1")).alias("c"), T.looks_like_formula(text()).alias("f"))
    return rows.select("doc_id", "ord", F.when((F.col("c") != "caption") & F.col("f"), "formula").otherwise(F.col("c")).alias("type"), (F.col("c").isin(*P.TRANSLATABLE) & ~F.col("f")).alias("translate"))


# ---- spans: three for each block, by the same SQL in both engines

SPANS = """SELECT doc_id, page, ord, source_id, s AS i, y1, text AS block_text,
  CASE s WHEN 0 THEN text WHEN 1 THEN CAST(m AS STRING) ELSE ' tail' END AS words, CASE s WHEN 1 THEN font_size * 0.7 ELSE font_size END AS size,
  CASE WHEN s = 1 THEN 'XY+CMMI10' WHEN k % 2 = 0 THEN 'AB+Serif-Bold' ELSE 'AB+Serif' END AS font,
  y1 - 3 + CASE WHEN s = 1 THEN (k % 3 - 1) * 2.0 ELSE 0.0 END AS y, s = 1 AND k = 8 AS raised
FROM {b} q """
SPANS_SQL = "sp AS (" + SPANS.replace("{b}", "b") + " CROSS JOIN (VALUES (0), (1), (2)) v(s))"


def span_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(SPANS + "LATERAL VIEW explode(array(0, 1, 2)) v AS s", b=block_table(spark, d))


@query("avg_font_size", "SELECT doc_id, ord, round(avg(size), 6) AS size FROM sp GROUP BY doc_id, ord", SPANS_SQL)
def avg_font_size(spark, d):
    return span_table(spark, d).groupBy("doc_id", "ord").agg(F.round(F.avg("size"), 6).alias("size"))


@query("style_flags", "SELECT sp.doc_id, sp.ord, sum(CASE WHEN contains(lower(font), 'bold') THEN length(words) ELSE 0 END) > any_value(length(block_text)) * 0.5 AS bold, any_value(type IN ('title', 'section') OR x1 - x0 > 612.0 * 0.7) AS centered FROM sp JOIN b ON sp.doc_id IS NOT DISTINCT FROM b.doc_id AND sp.ord = b.ord GROUP BY sp.doc_id, sp.ord", SPANS_SQL)
def style_flags(spark, d):
    spans = span_table(spark, d).groupBy(F.col("doc_id").alias("of"), F.col("ord").alias("at")).agg(F.sum(F.when(F.contains(F.lower("font"), F.lit("bold")), F.length("words")).otherwise(0)).alias("bold"))
    rows = block_table(spark, d).join(spans, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("ord") == F.col("at")))
    return rows.select("doc_id", "ord", (F.col("bold") > F.length(text()) * 0.5).alias("bold"), (F.col("type").isin("title", "section") | (own()["x1"] - own()["x0"] > L.PAGE_WIDTH * 0.7)).alias("centered"))


@query("dominant_font", "SELECT doc_id, ord, least(28.0, greatest(7.0, size)) AS size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY w DESC, first_i) AS r FROM (SELECT doc_id, ord, round(size, 1) AS size, sum(length(words)) AS w, min(i) AS first_i FROM sp GROUP BY doc_id, ord, round(size, 1)) z) y WHERE r = 1", SPANS_SQL)
def dominant_font(spark, d):
    sizes = span_table(spark, d).groupBy("doc_id", "ord", F.round("size", 1).alias("size")).agg(F.sum(F.length("words")).alias("w"), F.min("i").alias("first"))
    best = sizes.groupBy("doc_id", "ord").agg(F.max_by("size", F.struct("w", -F.col("first"))).alias("size"))
    return best.select("doc_id", "ord", F.least(F.lit(28.0), F.greatest(F.lit(7.0), F.col("size").cast("double"))).alias("size"))


_MAIN = "mx AS (SELECT sp.*, max(size) OVER (PARTITION BY doc_id, ord) AS top FROM sp), base AS (SELECT doc_id, ord, arg_max(y, struct_pack(w := w, f := -first_i)) AS baseline FROM (SELECT doc_id, ord, round(y, 1) AS y, sum(length(words)) AS w, min(i) AS first_i FROM mx WHERE size >= top * 0.9 GROUP BY doc_id, ord, round(y, 1)) z GROUP BY doc_id, ord)"


def baselines(spans: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "ord")
    large = spans.withColumn("top", F.max("size").over(w)).where("size >= top * 0.9")
    sums = large.groupBy("doc_id", "ord", F.round("y", 1).alias("y")).agg(F.sum(F.length("words")).alias("w"), F.min("i").alias("first"))
    return sums.groupBy("doc_id", "ord").agg(F.max_by("y", F.struct("w", -F.col("first"))).alias("baseline"))


@query("baseline_mode", "SELECT doc_id, ord, baseline::DOUBLE AS baseline FROM base", SPANS_SQL, _MAIN)
def baseline_mode(spark, d):
    return baselines(span_table(spark, d)).select("doc_id", "ord", F.col("baseline").cast("double").alias("baseline"))


_TAG = "CASE WHEN raised OR (size < top * 0.9 AND y - baseline < -top * 0.12) THEN '<sup>' || words || '</sup>' WHEN size < top * 0.9 AND y - baseline > top * 0.12 THEN '<sub>' || words || '</sub>' ELSE words END"


@query("line_text", f"SELECT mx.doc_id, mx.ord, string_agg({_TAG}, '' ORDER BY i) AS line FROM mx JOIN base ON mx.doc_id IS NOT DISTINCT FROM base.doc_id AND mx.ord = base.ord GROUP BY mx.doc_id, mx.ord", SPANS_SQL, _MAIN)
def line_text(spark, d):
    span = F.struct("i", F.col("words").alias("text"), F.col("size").cast("double").alias("size"), F.col("font"), F.col("raised").cast("int").alias("flags"), F.col("y").cast("double").alias("y"))
    lines = span_table(spark, d).groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return lines.select("doc_id", "ord", L.line_text(F.col("spans")).alias("line"))


@query(
    "art_override",
    f"""SELECT doc_id, ord, CASE WHEN ov AND inside THEN 'figure' WHEN ov THEN 'formula' ELSE type END AS type, translate AND NOT ov AS translate
    FROM (SELECT *, (inside AND type <> 'caption') OR NOT regexp_matches(text, '\\pL') OR (type <> 'caption' AND length(CAST(m AS VARCHAR)) > 0 AND length(text) < 80 AND length(CAST(m AS VARCHAR)) / greatest(length(text), 1) > 0.30) AS ov
    FROM (SELECT *, y0 < 140.0 AND y1 <= 140.0 AND y0 >= 55.0 AND x1 <= 310.0 AND 270.0 * 85.0 < (x1 - x0) * (y1 - y0) * 8 AND page % 3 = 0 AS inside FROM b) z) y""",
)
def art_override(spark, d):
    """Artwork at (40, 55, 310, 140) of every third page; the text's one-digit span is in a mathematical font."""
    art = {"x0": F.lit(40.0), "y0": F.lit(55.0), "x1": F.lit(310.0), "y1": F.lit(140.0)}
    inside = (F.col("page") % 3 == 0) & L.contains(art, own()) & (L.area(art) < L.area(own()) * 8)
    math = F.length(F.col("m").cast("string"))
    prose = F.col("type") != "caption"
    over = (inside & prose) | ~text().rlike(r"\p{L}") | (prose & (math > 0) & (F.length(text()) < 80) & (math / F.greatest(F.length(text()), F.lit(1)) > 0.30))
    rows = block_table(spark, d)
    return rows.select("doc_id", "ord", F.when(over & inside, "figure").when(over, "formula").otherwise(F.col("type")).alias("type"), (F.col("translate") & ~over).alias("translate"))


simple("title_override", lambda: {"type": F.when((F.col("page") == 1) & (own()["y0"] < L.PAGE_HEIGHT * 0.25) & (F.col("font_size") > 17), "title").otherwise(F.col("type")), "translate": F.col("translate")}, {"type": "CASE WHEN page = 1 AND y0 < 198.0 AND font_size > 17 THEN 'title' ELSE type END", "translate": "translate"})

_NUM = m(f"trim(regexp_replace({S.prose('text')}, '\\s+', ' ', 'g'))", P.EQUATION_NUMBER)
_LEN = f"length({S.prose('text')})"
_DISPLAY = f"({_NUM} OR (y1 - y0 > 28 AND {_LEN} > 16) OR (x1 - x0 > 612.0 * 0.28 AND {_LEN} > 24 AND {S.formula('text')}))"
_SCRAP = f"(y1 - y0 < 36 AND {_LEN} < 96 AND NOT {_NUM} AND ({m(S.prose('text'), P.SYMBOL)} OR {m(S.prose('text'), '[=+−×÷/√∝≈∑∫≤≥±]')} OR ({S.formula('text')} AND {_LEN} < 64 AND y1 - y0 < 28)))"
simple("math_role", lambda: {"display": L.is_display(text(), width(), height()), "scrap": L.is_scrap(text(), height())}, {"display": _DISPLAY, "scrap": _SCRAP})


def later_roles() -> dict:
    formula, plain = F.col("type") == "formula", F.length(T.visible_prose(text()))
    display = formula & (L.numbered(text()) | ((width() > 140) & (plain > 24)) | ((height() > 28) & (plain > 16)))
    return {"display": display, "scrap": formula & ~F.col("translate") & ~display & (plain < 64) & (height() < 28)}


simple("math_role_sem", later_roles, {"display": f"type = 'formula' AND ({_NUM} OR (x1 - x0 > 140 AND {_LEN} > 24) OR (y1 - y0 > 28 AND {_LEN} > 16))", "scrap": f"type = 'formula' AND NOT translate AND NOT ({_NUM} OR (x1 - x0 > 140 AND {_LEN} > 24) OR (y1 - y0 > 28 AND {_LEN} > 16)) AND {_LEN} < 64 AND y1 - y0 < 28"})
simple("layout_budget", lambda: L.budget(width(), height(), F.col("font_size")), {"lines": "greatest(1, round_even((y1 - y0) / (font_size * 1.15), 0)::BIGINT)", "per_line": "floor((x1 - x0) / (font_size * 0.7))::BIGINT", "budget": "floor(greatest(1, round_even((y1 - y0) / (font_size * 1.15), 0)::BIGINT) * floor((x1 - x0) / (font_size * 0.7))::BIGINT * 0.85::DOUBLE)::BIGINT"})


# ---- joins within a page


def paired(spark, d, how: str, on, **sides) -> DataFrame:
    rows = block_table(spark, d)
    return rows.alias("a").join(rows.alias("o"), page_key(rows, "a", "o") & on, how)




def earlier():
    return F.col("a.ord") < F.col("o.ord")



@query("column_band", f"SELECT a.doc_id, a.ord, o.ord AS other, abs(a.x0 - o.x0) < 36 AND abs(a.x1 - o.x1) < 54 AS same, (abs(a.x0 - o.x0) < 36 AND abs(a.x1 - o.x1) < 54) OR (o.x0 >= a.x0 - 36 AND o.x1 <= a.x1 + 36) AS band FROM b a JOIN b o ON {SAME} AND a.ord < o.ord")
def column_band(spark, d):
    return paired(spark, d, "inner", earlier()).select("a.doc_id", "a.ord", F.col("o.ord").alias("other"), L.same_column(first(), other()).alias("same"), L.in_band(first(), other()).alias("band"))


def _area(a: str) -> str:
    return f"(greatest({a}.x1 - {a}.x0, 0.0) * greatest({a}.y1 - {a}.y0, 0.0))"


_OVER = "(greatest(least(a.x1, o.x1) - greatest(a.x0, o.x0), 0.0) * greatest(least(a.y1, o.y1) - greatest(a.y0, o.y0), 0.0))"
_SIG = f"({_OVER} >= 5 AND least({_area('a')}, {_area('o')}) >= 1 AND {_OVER} > least({_area('a')}, {_area('o')}) * 0.15)"


@query("rect_overlap", f"SELECT a.doc_id, a.ord, o.ord AS other, round({_OVER}, 3) AS area, {_SIG} AS significant FROM b a JOIN b o ON {SAME} AND a.ord < o.ord")
def rect_overlap(spark, d):
    return paired(spark, d, "inner", earlier()).select("a.doc_id", "a.ord", F.col("o.ord").alias("other"), F.round(L.overlap(first(), other()), 3).alias("area"), L.significant(first(), other(), L.PREPARED).alias("significant"))


@query("overlap_drop", f"SELECT doc_id, ord FROM b EXCEPT SELECT a.doc_id, CASE WHEN {_area('a')} <= {_area('o')} THEN a.ord ELSE o.ord END FROM b a JOIN b o ON {SAME} AND a.ord < o.ord AND {_SIG}")
def overlap_drop(spark, d):
    return G.without_overlaps(block_table(spark, d)).select("doc_id", "ord")


_NEAR = "least(a.y1, o.y1) - greatest(a.y0, o.y0) > {above} AND greatest(a.x0, o.x0) - least(a.x1, o.x1) < {gap} AND NOT (o.x0 >= a.x1 + 24 AND o.x0 - a.x0 > 100)"


@query("near_formula", f"SELECT doc_id, ord FROM b a WHERE EXISTS (SELECT 1 FROM b o WHERE {SAME} AND o.type = 'formula' AND NOT o.translate AND o.ord <> a.ord AND {_NEAR.format(above=-4, gap=48)})")
def near_formula(spark, d):
    rows = block_table(spark, d)
    return G.beside(rows, rows.where("type = 'formula' AND NOT translate")).select("doc_id", "ord")


@query("inside_art", f"SELECT doc_id, ord FROM b a WHERE EXISTS (SELECT 1 FROM b o WHERE {SAME} AND o.ord <> a.ord AND a.x0 >= 40 AND a.x1 <= 580 AND o.y0 - 40 <= a.y0 AND o.y1 + 40 >= a.y1 AND o.type = 'caption' AND 540.0 * (o.y1 - o.y0 + 80) < {_area('a')} * 8)")
def inside_art(spark, d):
    """Artwork: what stands beside a caption across the page, with 40 points above and below it."""
    rows = block_table(spark, d)
    art = {"x0": F.lit(40.0), "y0": other()["y0"] - 40, "x1": F.lit(580.0), "y1": other()["y1"] + 40}
    return rows.alias("a").join(rows.where("type = 'caption'").alias("o"), page_key(rows, "a", "o") & (F.col("a.ord") != F.col("o.ord")) & L.contains(art, first()) & (L.area(art) < L.area(first()) * 8), "left_semi").select("doc_id", "ord")


#: What a second parse of the pages gives: the same blocks, a little moved and numbered anew, without each ninth.
RAW = "SELECT doc_id, page, ord * 10 AS raw_ord, x0 + CASE WHEN ord % 5 = 0 THEN 1.5 ELSE 0.25 END AS x0, y0 + 0.5 AS y0, x1 + 0.25 AS x1, y1 + 0.5 AS y1, text FROM {b} q WHERE (page + ord * 2) % 9 <> 0"
RAW_SQL = "raw AS (" + RAW.replace("{b}", "b") + ")"


def raw_table(spark, d):
    return spark.sql(RAW, b=block_table(spark, d))


_DIST = "(abs(a.x0 - o.x0) + abs(a.y0 - o.y0) + abs(a.x1 - o.x1) + abs(a.y1 - o.y1))"


@query("nearest_block", f"SELECT a.doc_id, a.ord, arg_min(o.raw_ord, struct_pack(d := {_DIST}, r := o.raw_ord)) AS raw_ord FROM b a LEFT JOIN raw o ON {SAME} GROUP BY a.doc_id, a.ord", RAW_SQL)
def nearest_block(spark, d):
    return G.nearest(block_table(spark, d), raw_table(spark, d))


@query("geometry_rematch", f"SELECT a.doc_id, a.ord, arg_min(o.raw_ord, struct_pack(d := abs(a.x0 - o.x0) + abs(a.y0 - o.y0), r := o.raw_ord)) AS raw_ord, coalesce(arg_min(o.y0, struct_pack(d := abs(a.x0 - o.x0) + abs(a.y0 - o.y0), r := o.raw_ord)), any_value(a.y0)) AS y0 FROM b a LEFT JOIN raw o ON {SAME} AND greatest(abs(a.x0 - o.x0), abs(a.y0 - o.y0), abs(a.x1 - o.x1), abs(a.y1 - o.y1)) < 1 GROUP BY a.doc_id, a.ord", RAW_SQL)
def geometry_rematch(spark, d):
    return G.rematched(block_table(spark, d), raw_table(spark, d))


@query("text_rematch", f"SELECT a.doc_id, a.ord, arg_min(o.raw_ord, struct_pack(d := abs(a.x0 - o.x0) + abs(a.y0 - o.y0), r := o.raw_ord)) AS raw_ord FROM b a JOIN raw o ON {SAME} AND a.text = o.text GROUP BY a.doc_id, a.ord", RAW_SQL)
def text_rematch(spark, d):
    return G.rematched_by_text(block_table(spark, d), raw_table(spark, d))


_TARGET = "regexp_extract(translated, '^\\[MERGED_INTO:(.+?)\\]$', 1)"


@query("absorb_union", f"SELECT b.doc_id, b.ord, least(x0, coalesce(mx0, x0)) AS x0, greatest(x1, coalesce(mx1, x1)) AS x1, greatest(y1, coalesce(my1, y1)) AS y1, coalesce(n, 0) AS members FROM b LEFT JOIN (SELECT doc_id, {_TARGET} AS target, min(x0) AS mx0, max(x1) AS mx1, max(y1) AS my1, count(*) AS n FROM b WHERE {_TARGET} <> '' GROUP BY ALL) g ON b.doc_id IS NOT DISTINCT FROM g.doc_id AND b.source_id = g.target WHERE {_TARGET} = ''")
def absorb_union(spark, d):
    return G.absorbed(block_table(spark, d))


@query("flow_limit", f"SELECT a.doc_id, a.ord, greatest(any_value(a.y1), least(780.0, any_value(a.y1) + 20, coalesce(min(o.y0 - 1), 1e9))) AS y1 FROM b a LEFT JOIN b o ON {SAME} AND o.ord <> a.ord AND least(a.x1, o.x1) > greatest(a.x0, o.x0) AND o.y0 >= a.y1 - 0.1 WHERE a.translate GROUP BY a.doc_id, a.ord")
def flow_limit(spark, d):
    return G.flow_limits(block_table(spark, d))


@query("reading_order", "SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ord) AS place FROM b")
def reading_order(spark, d):
    return G.in_reading_order(block_table(spark, d)).select("doc_id", "ord", "place")


@query("page_count", "SELECT doc_id, max(page) AS pages, count(*) AS blocks FROM b GROUP BY doc_id")
def page_count(spark, d):
    return block_table(spark, d).groupBy("doc_id").agg(F.max("page").alias("pages"), F.count("*").alias("blocks"))


simple("blocks_scan", lambda: {k: F.col(k) for k in ("page", "source_id", "type", "translate", "x0", "y0", "x1", "y1", "text")}, {k: k for k in ("page", "source_id", "type", "translate", "x0", "y0", "x1", "y1", "text")})


@query("protected_rects", "SELECT doc_id, page, 'block' AS kind, x0, y0, x1, y1 FROM b WHERE NOT translate UNION ALL SELECT doc_id, page, 'image', x0, y0 - 60, x1, y0 FROM b WHERE type = 'caption' UNION ALL SELECT doc_id, page, 'vector', x0 - 1, y1, x1 + 1, y1 + 1 FROM b WHERE type = 'section'")
def protected_rects(spark, d):
    """Blocks that aren't translated, images (above captions) and vector art (a rule below a section's heading)."""
    rows = block_table(spark, d)
    part = lambda where, kind, x0, y0, x1, y1: rows.where(where).select("doc_id", "page", F.lit(kind).alias("kind"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return part("NOT translate", "block", *own().values()).unionByName(part("type = 'caption'", "image", own()["x0"], own()["y0"] - 60, own()["x1"], own()["y0"])).unionByName(part("type = 'section'", "vector", own()["x0"] - 1, own()["y1"], own()["x1"] + 1, own()["y1"] + 1))


# ---- fitting


@query(
    "fit_ladder",
    "SELECT doc_id, ord, coalesce(min(CASE WHEN ceil(length(translated) / greatest(1, floor((x1 - x0) / (a * 0.7 * f)))) * a * h * f <= y1 - y0 THEN level END), -1)::INT AS level FROM (SELECT b.*, level, h, greatest(7.0, font_size * s) AS a, greatest(0.6, least(1.0, 5.5 / greatest(7.0, font_size * s))) AS f FROM b CROSS JOIN (VALUES "
    + ", ".join(f"({i}, {s}::DOUBLE, {h}::DOUBLE)" for i, (s, h) in enumerate(L.LEVELS))
    + ") v(level, s, h) WHERE translate) z GROUP BY doc_id, ord",
)
def fit_ladder(spark, d):
    level = G.fit_level(F.col("translated"), F.col("font_size"), width(), height())
    return block_table(spark, d).where("translate").select("doc_id", "ord", level.alias("level"))


@query(
    "retention_reason",
    f"SELECT doc_id, ord, CASE WHEN translated = '' OR starts_with(translated, '[翻译失败:') THEN '没有有效译文，已保留原文' WHEN x1 <= x0 OR y1 <= y0 OR x0 < 0 OR y0 < 0 OR x1 > 612 OR y1 > 792 THEN '文字区域越界，已保留原文' WHEN EXISTS (SELECT 1 FROM b o WHERE {SAME} AND NOT o.translate AND {_SIG.replace('0.15', '0.10')}) THEN '与公式或图形保护区相交，已保留原文' END AS reason FROM b a WHERE translate AND NOT starts_with(translated, '[MERGED_INTO:')",
)
def retention_reason(spark, d):
    return G.retained(block_table(spark, d)).select("doc_id", "ord", "reason")


# ---- what needs the order of a page

_COLUMNS = ["source_id", "type", "translate", "x0", "y0", "x1", "y1", "text"]


def _candidate():
    plain = T.visible_prose(text())
    words = T.extract(plain, "[A-Za-z]+")
    unit = T.stripped(plain).rlike(r"^[A-Za-z ]{1,32}\((?:dBm|dB|W|V|A|Hz)\)[ .]*$")
    tail = plain.rlike(r"^[\d(\[+−-]") & plain.rlike(r"\(\d+[a-z]?\)\s*$")
    scrap = (F.length(plain) < 24) & ~plain.rlike("[A-Za-z]{4,}") & (plain.rlike(P.SYMBOL) | plain.rlike("[=+−×÷/√∝]"))
    short = F.forall(words, lambda w: (F.length(w) <= 2) | w.rlike("^[A-Z]{1,5}$") | w.rlike("^[a-z][A-Z]{1,5}$") | w.rlike("^[A-Za-z]{0,3}(?:pd|total|max|min|sin|cos|log|exp)$"))
    wordy = (F.size(words) > 0) & (unit | tail | short)
    alone = (plain.rlike("[=+−∝]") & ~plain.rlike("[A-Za-z]{5,}")) | ((F.length(plain) < 8) & text().rlike(P.SYMBOL))
    eligible = F.col("translate") & (F.col("type") != "caption") & (height() < 40) & (F.length(plain) < 100) & (scrap | wordy | T.looks_like_formula(plain))
    return eligible, alone


_PL = S.prose("text")
_WORDS = f"regexp_extract_all({_PL}, '[A-Za-z]+')"
_ELIGIBLE = f"translate AND type <> 'caption' AND y1 - y0 < 40 AND length({_PL}) < 100 AND ((length({_PL}) < 24 AND NOT {m(_PL, '[A-Za-z]{4,}')} AND ({m(_PL, P.SYMBOL)} OR {m(_PL, '[=+−×÷/√∝]')})) OR (len({_WORDS}) > 0 AND ({m(S.stripped(_PL), '^[A-Za-z ]{1,32}\\((?:dBm|dB|W|V|A|Hz)\\)[ .]*$')} OR ({m(_PL, '^[0-9(\\[+−-]')} AND {m(_PL, '\\([0-9]+[a-z]?\\)\\s*$')}) OR len(list_filter({_WORDS}, lambda w: NOT (length(w) <= 2 OR regexp_matches(w, '^[A-Z]{{1,5}}$') OR regexp_matches(w, '^[a-z][A-Z]{{1,5}}$') OR regexp_matches(w, '^[A-Za-z]{{0,3}}(?:pd|total|max|min|sin|cos|log|exp)$')))) = 0)) OR {S.formula(_PL)})"
_ALONE = f"(({m(_PL, '[=+−∝]')} AND NOT {m(_PL, '[A-Za-z]{5,}')}) OR (length({_PL}) < 8 AND {m('text', P.SYMBOL)}))"


def _fixpoint(rows: DataFrame, above: float, gap: float, near_columns: bool = True) -> DataFrame:
    """rows with seed and eligible: which blocks end as formulas. The closure grows only, so that order doesn't matter."""

    def run(found):
        got = pages.closure(found, {i for i, x in enumerate(found) if x["seed"]}, {i for i, x in enumerate(found) if x["eligible"]}, above, gap)
        return [{"ord": x["ord"], "formula": i in got} for i, x in enumerate(found)]

    return pages.per_page(rows, ["seed", "eligible", "x0", "y0", "x1", "y1"], run, "ord long, formula boolean").select("doc_id", "ord", "formula")


def _fixpoint_sql(seed: str, eligible: str, above: int, gap: int) -> tuple[str, str]:
    marked = f"mk AS (SELECT doc_id, page, ord, x0, y0, x1, y1, {seed} AS seed, {eligible} AS eligible FROM b)"
    closed = f"f AS (SELECT doc_id, page, ord, x0, y0, x1, y1 FROM mk WHERE seed UNION SELECT a.doc_id, a.page, a.ord, a.x0, a.y0, a.x1, a.y1 FROM mk a JOIN f o ON {SAME} AND a.eligible AND {_NEAR.format(above=above, gap=gap)})"
    return marked, closed


def _recursive(marked: str, closed: str) -> str:
    return S.with_blocks("SELECT mk.doc_id, mk.ord, f.ord IS NOT NULL AS formula FROM mk LEFT JOIN f ON mk.doc_id IS NOT DISTINCT FROM f.doc_id AND mk.ord = f.ord", marked, closed).replace("WITH ", "WITH RECURSIVE ", 1)


@query("formula_fixpoint")
def formula_fixpoint(spark, d):
    eligible, alone = _candidate()
    return _fixpoint(block_table(spark, d).withColumn("eligible", eligible).withColumn("seed", (F.col("type") == "formula") | (F.col("eligible") & alone)), 0, 40)


ORACLES["formula_fixpoint"] = _recursive(*_fixpoint_sql(f"type = 'formula' OR ({_ELIGIBLE} AND {_ALONE})", f"({_ELIGIBLE})", 0, 40))


@query("equation_lock")
def equation_lock(spark, d):
    plain = T.visible_prose(text())
    compact = F.trim(F.regexp_replace(plain, r"\s+", " "))
    lone = compact.rlike(r"^\(\d+[a-z]?\)$")
    sure = (F.col("type") != "caption") & (T.looks_like_formula(plain) | lone | (compact.rlike(P.EQUATION_NUMBER) & (plain.rlike("[=+−×/]") | text().rlike("<su[bp]>") | plain.rlike(P.SYMBOL))))
    joins = (F.col("type") != "caption") & F.col("translate") & (lone | T.looks_like_formula(plain) | ((F.length(plain) < 48) & plain.rlike(P.SYMBOL) & ~plain.rlike("[A-Za-z]{5,}")))
    return _fixpoint(block_table(spark, d).withColumn("seed", (F.col("type") == "formula") | sure).withColumn("eligible", joins), -4, 48)


_CP = f"trim(regexp_replace({_PL}, '\\s+', ' ', 'g'))"
_SURE = f"(type <> 'caption' AND ({S.formula(_PL)} OR {m(_CP, '^\\([0-9]+[a-z]?\\)$')} OR ({m(_CP, P.EQUATION_NUMBER)} AND ({m(_PL, '[=+−×/]')} OR {m('text', '<su[bp]>')} OR {m(_PL, P.SYMBOL)}))))"
_JOINS = f"(type <> 'caption' AND translate AND ({m(_CP, '^\\([0-9]+[a-z]?\\)$')} OR {S.formula(_PL)} OR (length({_PL}) < 48 AND {m(_PL, P.SYMBOL)} AND NOT {m(_PL, '[A-Za-z]{5,}')})))"
ORACLES["equation_lock"] = _recursive(*_fixpoint_sql(f"type = 'formula' OR {_SURE}", _JOINS, -4, 48))


@query("inline_tagging")
def inline_tagging(spark, d):
    rows = block_table(spark, d).withColumn("is_display", L.is_display(text(), width(), height())).withColumn("is_scrap", L.is_scrap(text(), height())).withColumn("type", F.when(T.looks_like_formula(text()), "formula").otherwise(F.col("type")))
    return pages.per_page(rows, ["type", "is_display", "is_scrap", "x0", "y0", "x1", "y1"], pages.tag_inline, "ord long, display boolean").select("doc_id", "ord", "display")


@query("semantic_units")
def semantic_units(spark, d):
    found = pages.per_page(block_table(spark, d), _COLUMNS, pages.semantic_units, "unit long, primary_id string, members array<string>, absorbed array<string>, source_text string")
    return found.select("doc_id", "page", "unit", "primary_id", F.array_join("members", "|").alias("members"), F.array_join("absorbed", "|").alias("absorbed"), "source_text")


@query("next_continuation")
def next_continuation(spark, d):
    return pages.per_page(block_table(spark, d), _COLUMNS, pages.next_continuations, "source_id string, next_id string, scrap_id string").drop("page")


@query("next_in_column", "SELECT doc_id, ord, CASE WHEN lead(y0) OVER w - y1 <= 40 AND lead(translate) OVER w THEN lead(source_id) OVER w END AS next_id FROM b WINDOW w AS (PARTITION BY doc_id, page, x0 ORDER BY y0, ord)")
def next_in_column(spark, d):
    """The next block of a column if it may carry on: no blocks are skipped, so a window finds it."""
    w = Window.partitionBy("doc_id", "page", "x0").orderBy("y0", "ord")
    close = (F.lead("y0").over(w) - F.col("y1") <= 40) & F.lead("translate").over(w)
    return block_table(spark, d).select("doc_id", "ord", F.when(close, F.lead("source_id").over(w)).alias("next_id"))


@query("art_regions")
def art_regions(spark, d):
    rows = block_table(spark, d).withColumn("y1", F.col("y1") + 30)  # a drawing reaches below its label
    return pages.per_page(rows, ["x0", "y0", "x1", "y1"], pages.art_regions, "region long, x0 double, y0 double, x1 double, y1 double, parts long")


_DRAWN = "CASE WHEN ord % 5 = 0 THEN 'clip' WHEN ord % 5 = 4 THEN 's' ELSE 'fs' END"
_ART = f"""dr AS (SELECT doc_id, page, ord, {_DRAWN} AS type, ord % 3 AS level, x0, y0, x1, y1, CASE WHEN ord % 5 = 0 THEN x1 - 40.0 ELSE x1 END AS right_edge, CASE ord % 4 WHEN 0 THEN 0.0 ELSE 0.5 END AS fill, CASE ord % 7 WHEN 0 THEN 0.0 ELSE 1.0 END AS stroke, ord % 6 AS line FROM b),
cl AS (SELECT a.*, (SELECT min(z.ord) FROM dr z WHERE z.doc_id IS NOT DISTINCT FROM a.doc_id AND z.page = a.page AND z.ord > a.ord AND z.level <= a.level) AS ends FROM dr a WHERE type = 'clip'),
mk AS (SELECT *, CASE WHEN stroke > 0 THEN greatest(0.1, line / 2.0) ELSE 0.0 END AS m FROM dr WHERE type <> 'clip' AND (fill > 0 OR stroke > 0)),
vs AS (SELECT mk.doc_id, mk.page, mk.ord, greatest(any_value(mk.x0 - m), 0.0, coalesce(max(cl.x0), 0.0)) AS x0, greatest(any_value(mk.y0 - m), 0.0, coalesce(max(cl.y0), 0.0)) AS y0, least(any_value(mk.x1 + m), 612.0, coalesce(min(cl.right_edge), 612.0)) AS x1, least(any_value(mk.y1 + m), 792.0, coalesce(min(cl.y1 + 300.0), 792.0)) AS y1
  FROM mk LEFT JOIN cl ON cl.doc_id IS NOT DISTINCT FROM mk.doc_id AND cl.page = mk.page AND cl.ord < mk.ord AND (cl.ends IS NULL OR mk.ord < cl.ends) GROUP BY mk.doc_id, mk.page, mk.ord)"""


@query("visible_art", "SELECT doc_id, page, ord, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM vs WHERE x1 > x0 AND y1 > y0", _ART)
def visible_art(spark, d):
    """Blocks as drawings: every fifth a clip that reaches further down, levels, opacities and strokes by rule."""
    drawn = F.col("ord") % 5
    box = F.array("x0", "y0", "x1", "y1")
    scissor = F.array("x0", "y0", F.col("x1") - 40.0, F.col("y1") + 300.0)
    one = F.struct(
        "ord", F.when(drawn == 0, "clip").when(drawn == 4, "s").otherwise("fs").alias("type"), (F.col("ord") % 3).cast("int").alias("level"), box.cast("array<double>").alias("rect"), scissor.cast("array<double>").alias("scissor"),
        F.when(F.col("ord") % 7 == 0, 0.0).otherwise(1.0).alias("stroke_opacity"), F.when(F.col("ord") % 4 == 0, 0.0).otherwise(0.5).alias("fill_opacity"), (F.col("ord") % 6).cast("double").alias("line"),
    )
    rows = block_table(spark, d).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(one)).alias("drawings"))
    seen = artwork.visible_rects(rows.select("doc_id", "page", F.lit(L.PAGE_WIDTH).alias("width"), F.lit(L.PAGE_HEIGHT).alias("height"), F.transform("drawings", lambda x: x.dropFields("ord")).alias("drawings")))
    starts = rows.select(F.col("doc_id").alias("of"), F.col("page").alias("at"), F.transform("drawings", lambda x: x["ord"]).alias("ords"))
    met = seen.join(starts, seen.doc_id.eqNullSafe(starts.of) & (seen.page == starts["at"]))
    return met.select("doc_id", "page", F.get("ords", F.col("ord").cast("int")).alias("ord"), "x0", "y0", "x1", "y1")


@query("lock_shrink")
def lock_shrink(spark, d):
    def run(found):
        locks = [[x["x0"], x["y0"], x["x1"], x["y1"]] for x in found if not x["translate"]]
        out = []
        for x in found:
            if x["translate"]:
                box = [x["x0"], x["y0"], x["x1"], x["y1"]]
                r, ok = pages.shrink([box[0], box[1], box[2], min(780.0, box[3] + 20)], locks, box)
                out.append({"ord": x["ord"], "x0": r[0], "y0": r[1], "x1": r[2], "y1": r[3], "usable": ok})
        return out

    return pages.per_page(block_table(spark, d), ["translate", "x0", "y0", "x1", "y1"], run, "ord long, x0 double, y0 double, x1 double, y1 double, usable boolean").drop("page")


# ---- glyphs and pixels


def _glyphs(spark, d):
    """Spans with control codes as some fonts give them, and each font's map of codes to characters."""
    rows = block_table(spark, d)
    spans = rows.select("doc_id", "ord", F.col("k").alias("k"), F.explode(F.array(F.struct(F.lit("F1").alias("font"), (F.col("k") % 5 + 1).cast("int").alias("code")), F.struct(F.when(F.col("m") % 2 == 0, "F2").otherwise("F1").alias("font"), (F.col("m") % 5 + 1).cast("int").alias("code")))).alias("s"))
    fonts = spark.createDataFrame([("F1", 1, "α"), ("F1", 2, "β"), ("F1", 3, "γ"), ("F2", 1, "α"), ("F2", 2, "δ")], "font string, code int, to string")
    return spans.select("doc_id", "ord", "s.font", "s.code"), F.broadcast(fonts)  # a row for each code of the fonts


_GLYPH_SQL = "gl AS (SELECT doc_id, ord, 'F1' AS font, (k % 5 + 1)::INT AS code FROM b UNION ALL SELECT doc_id, ord, CASE WHEN m % 2 = 0 THEN 'F2' ELSE 'F1' END, (m % 5 + 1)::INT FROM b), fo(font, code, ch) AS (VALUES ('F1', 1, 'α'), ('F1', 2, 'β'), ('F1', 3, 'γ'), ('F2', 1, 'α'), ('F2', 2, 'δ')), un AS (SELECT doc_id, ord, gl.code, min(coalesce(ch, chr(gl.code))) AS ch FROM gl LEFT JOIN fo ON gl.font = fo.font AND gl.code = fo.code GROUP BY doc_id, ord, gl.code HAVING count(DISTINCT coalesce(ch, chr(gl.code))) = 1)"


def _unanimous(spark, d):
    spans, fonts = _glyphs(spark, d)
    met = spans.join(fonts, ["font", "code"], "left").withColumn("to", F.coalesce("to", F.char(F.col("code").cast("long"))))
    return met.groupBy("doc_id", "ord", "code").agg(F.count_distinct("to").alias("n"), F.min("to").alias("to")).where("n = 1").drop("n")


@query("control_unanimous", "SELECT doc_id, ord, code, ch AS char FROM un", _GLYPH_SQL)
def control_unanimous(spark, d):
    return _unanimous(spark, d).select("doc_id", "ord", "code", F.col("to").alias("char"))


@query("control_repair", "SELECT b.doc_id, b.ord, any_value(text) || coalesce(string_agg(ch, '' ORDER BY code), '') AS repaired FROM b LEFT JOIN un ON b.doc_id IS NOT DISTINCT FROM un.doc_id AND b.ord = un.ord GROUP BY b.doc_id, b.ord", _GLYPH_SQL)
def control_repair(spark, d):
    """The text with its codes behind it in order, each replaced where all fonts agree and left out where they don't."""
    rows = block_table(spark, d)
    codes = _unanimous(spark, d).groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct("code", "to"))).alias("map"))
    met = rows.select("doc_id", "ord", "text").alias("a").join(codes.alias("c"), F.col("a.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("a.ord") == F.col("c.ord")), "left")
    raw = F.concat("text", F.lit("\x01\x02\x03\x04\x05"))
    fixed = F.aggregate(F.coalesce("map", F.array().cast("array<struct<code:int,to:string>>")), raw, lambda s, x: F.replace(s, F.char(x.code.cast("long")), F.concat(F.lit("\x0e"), x.to)))
    kept = F.replace(F.regexp_replace(fixed, "(?<!\x0e)[\x01-\x05]", ""), F.lit("\x0e"), F.lit(""))
    return met.select("a.doc_id", "a.ord", kept.alias("repaired"))


@query("text_containment")
def text_containment(spark, d):
    rows = block_table(spark, d)
    letters = lambda c: F.filter(F.split(F.regexp_replace(c, "[\\s­]+", ""), ""), lambda x: x != "")
    each = rows.select("doc_id", "ord", F.explode(F.concat(F.transform(letters(text()), lambda c: F.struct(c.alias("c"), F.lit(1).alias("n"))), F.transform(letters(F.col("translated")), lambda c: F.struct(c.alias("c"), F.lit(-1).alias("n"))))).alias("x"))
    counts = each.groupBy("doc_id", "ord", "x.c").agg(F.sum("x.n").alias("n"))
    return counts.groupBy("doc_id", "ord").agg((F.max("n") <= 0).alias("contained"))


ORACLES["text_containment"] = S.with_blocks("SELECT doc_id, ord, max(n) <= 0 AS contained FROM (SELECT doc_id, ord, c, sum(n) AS n FROM (SELECT doc_id, ord, 1 AS n, unnest(string_split(regexp_replace(text, '[\\s­]+', '', 'g'), '')) AS c FROM b UNION ALL SELECT doc_id, ord, -1, unnest(string_split(regexp_replace(translated, '[\\s­]+', '', 'g'), '')) FROM b) z WHERE c <> '' GROUP BY doc_id, ord, c) y GROUP BY doc_id, ord")


@query("pixel_diff", "SELECT doc_id, ord, round(avg(CASE WHEN abs((k * 37 + i * 11) % 256 - (k * 37 + i * 11 + CASE WHEN (i + m) % 20 = 0 THEN 40 ELSE 3 END) % 256) > 12 THEN 1.0 ELSE 0.0 END), 6) AS ratio, avg(CASE WHEN abs((k * 37 + i * 11) % 256 - (k * 37 + i * 11 + CASE WHEN (i + m) % 20 = 0 THEN 40 ELSE 3 END) % 256) > 12 THEN 1.0 ELSE 0.0 END) > CASE WHEN any_value((x1 - x0) * (y1 - y0)) < 2500 THEN 0.05 ELSE 0.002 END AS warns FROM b, unnest(range(0, 100)) u(i) GROUP BY doc_id, ord")
def pixel_diff(spark, d):
    """Crops of 100 samples by rule, before and after; the share that differs by more than 12 decides, by the region's size."""
    i = F.sequence(F.lit(0), F.lit(99))
    base = F.col("k") * 37
    differ = lambda x: F.abs((base + x * 11) % 256 - (base + x * 11 + F.when((x + F.col("m")) % 20 == 0, 40).otherwise(3)) % 256) > 12
    ratio = F.size(F.filter(i, differ)) / 100
    return block_table(spark, d).select("doc_id", "ord", F.round(ratio, 6).alias("ratio"), (ratio > F.when(L.area(own()) < 2500, 0.05).otherwise(0.002)).alias("warns"))
