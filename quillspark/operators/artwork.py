"""Vector art of pages: what of each drawing can be seen, and the regions that visible drawings form.

A clip holds for what is drawn after it at deeper levels, until something comes at its own level or above; so for each
drawing the clips in force are those before it that nothing has ended since, and what is seen is inside all of them. Stated like
this, no drawing depends on another's outcome, and a page's drawings are expressions over its array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import pages

DRAWINGS = "doc_id long, page long, width double, height double, drawings array<struct<type: string, level: int, rect: array<double>, scissor: array<double>, stroke_opacity: double, fill_opacity: double, line: double>>"
#: Kinds of drawings that leave a mark (strokes, fills, both), and by how much strokes reach beyond their path at least.
MARKS, LEAST_STROKE = ("s", "f", "fs"), 0.1


def visible_rects(rows: DataFrame) -> DataFrame:
    """(doc_id, page, ord, x0, y0, x1, y1) of the drawings of pages (DRAWINGS) that can be seen: not wholly transparent, widened by half their
    stroke, within the page and all clips in force. Empty ones go; a missing level is 0."""
    level = lambda d: F.coalesce(d.level, F.lit(0))
    numbered = rows.withColumn("drawings", F.transform("drawings", lambda d, i: F.struct(i.alias("i"), level(d).alias("level"), d.alias("d"))))
    # a clip ends with the first drawing after it that isn't deeper
    ends = lambda c: F.coalesce(F.array_min(F.transform(F.filter("drawings", lambda x: (x.i > c.i) & (x.level <= c.level)), lambda x: x.i)), F.lit(1 << 30))
    clips = F.transform(F.filter("drawings", lambda x: x.d.type == "clip"), lambda c: F.struct(c.i.alias("i"), ends(c).alias("end"), c.d.scissor.alias("r")))
    each = numbered.withColumn("clips", clips).select("doc_id", "page", "width", "height", "clips", F.explode("drawings").alias("x")).where(F.col("x.d.type").isin(*MARKS))
    stroke, fill = (F.coalesce(f"x.d.{k}_opacity", F.lit(0.0)) for k in ("stroke", "fill"))
    margin = F.when(stroke != 0, F.greatest(F.lit(LEAST_STROKE), F.coalesce("x.d.line", F.lit(0.0)) / 2)).otherwise(0.0)
    force = F.filter("clips", lambda c: (c.i < F.col("x.i")) & (F.col("x.i") < c.end))
    corner = lambda k: F.get("x.d.rect", F.lit(k))

    def inner(k: int, edge: Column, best) -> Column:
        """The innermost of the drawing's own edge, the page's and those of the clips in force."""
        own = corner(k) - margin if k < 2 else corner(k) + margin
        return F.aggregate(force, best(own, edge), lambda a, c: best(a, F.get(c.r, F.lit(k))))

    edges = (F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    box = {name: inner(k, edges[k], F.greatest if k < 2 else F.least).alias(name) for k, name in enumerate(("x0", "y0", "x1", "y1"))}
    seen = each.where((stroke != 0) | (fill != 0)).select("doc_id", "page", F.col("x.i").cast("long").alias("ord"), *box.values())
    return seen.where("x1 > x0 AND y1 > y0")


def regions(rows: DataFrame) -> DataFrame:
    """The regions of visible drawings of pages (DRAWINGS), as pages.art_regions gives them."""
    return pages.per_page(visible_rects(rows), ["x0", "y0", "x1", "y1"], pages.art_regions, "region long, x0 double, y0 double, x1 double, y1 double, parts long")
