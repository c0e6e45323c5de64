"""Geometry and classification of blocks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.text import looks_like_formula, stripped, visible_prose

PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
#: Least overlap in square points, and shares of the smaller rectangle that count.
MIN_OVERLAP, INITIAL, PREPARED = 5.0, 0.10, 0.15
#: Font scale and line height of the levels at which a text is fitted.
LEVELS = ((1.0, 1.15), (1.0, 1.10), (0.95, 1.10), (0.95, 1.05), (0.9, 1.05), (0.9, 1.0), (0.85, 1.0))


#: Spans below this share of the main size are scripts if they are shifted by this share of it; a span's flag for superscripts.
SCRIPT_SIZE, SCRIPT_SHIFT, SUPERSCRIPT_FLAG = 0.9, 0.12, 1


def line_text(spans: Column) -> Column:
    """The text of a line of spans (text, size, y, flags), in order; small ones off the baseline are tagged. The baseline is that of most
    characters among the large spans, the first of equals."""
    chars = lambda s: F.length(F.coalesce(s.text, F.lit("")))
    size = lambda s: F.coalesce(s["size"], F.lit(0.0))

    def tagged(line: Column, top: Column) -> Column:
        large = F.transform(F.filter(line, lambda s: size(s) >= top * SCRIPT_SIZE), lambda s: F.struct(F.round(F.coalesce(s.y, F.lit(0.0)), 1).alias("y"), chars(s).alias("n")))
        heights = F.array_distinct(F.transform(large, lambda s: s.y))
        weighed = F.transform(heights, lambda y, i: F.struct((-F.aggregate(F.filter(large, lambda s: s.y == y), F.lit(0), lambda n, s: n + s.n)).alias("n"), i.alias("i"), y.alias("y")))
        base = F.coalesce(F.get(F.array_sort(weighed), F.lit(0)).y, F.lit(0.0))

        def one(s: Column, base: Column) -> Column:
            small, shift = F.coalesce(s["size"], top) < top * SCRIPT_SIZE, F.coalesce(s.y, base) - base
            raised = F.coalesce(s.flags, F.lit(0)).bitwiseAND(F.lit(SUPERSCRIPT_FLAG)) != 0
            tag = F.when(raised | (small & (shift < -top * SCRIPT_SHIFT)), "sup").when(small & (shift > top * SCRIPT_SHIFT), "sub")
            text = F.coalesce(s.text, F.lit(""))
            return F.when(tag.isNotNull() & (stripped(text) != ""), F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">"))).otherwise(text)

        return F.array_join(F.flatten(F.transform(F.array(base), lambda b: F.transform(line, lambda s: one(s, b)))), "")

    main = lambda line: F.coalesce(F.nullif(F.array_max(F.transform(line, size)), F.lit(0.0)), F.lit(10.0))
    bound = F.transform(F.array(spans), lambda line: F.transform(F.array(main(line)), lambda top: tagged(line, top))[0])[0]
    return F.when(F.size(spans) > 0, bound).otherwise("")


def rect(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("x0", "y0", "x1", "y1")}


def area(r: dict) -> Column:
    return F.greatest(r["x1"] - r["x0"], F.lit(0.0)) * F.greatest(r["y1"] - r["y0"], F.lit(0.0))


def intersection(a: dict, b: dict) -> dict:
    return {"x0": F.greatest(a["x0"], b["x0"]), "y0": F.greatest(a["y0"], b["y0"]), "x1": F.least(a["x1"], b["x1"]), "y1": F.least(a["y1"], b["y1"])}


def overlap(a: dict, b: dict) -> Column:
    return area(intersection(a, b))


def significant(a: dict, b: dict, ratio: float) -> Column:
    smaller = F.least(area(a), area(b))
    return (overlap(a, b) >= MIN_OVERLAP) & (smaller >= 1) & (overlap(a, b) > smaller * ratio)


def contains(outer: dict, inner: dict) -> Column:
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (outer["x1"] >= inner["x1"]) & (outer["y1"] >= inner["y1"])


def distance(a: dict, b: dict) -> Column:
    return sum((F.abs(a[k] - b[k]) for k in ("y0", "x1", "y1")), F.abs(a["x0"] - b["x0"]))


def classify(text: Column, y0: Column, y1: Column, height: float = PAGE_HEIGHT) -> Column:
    t = stripped(text)
    lower = F.lower(text)
    return (
        F.when(t.rlike(P.CAPTION), "caption")
        .when(y1 < height * 0.06, "header")
        .when((y0 > height * 0.94) & t.rlike(r"^\d+$"), "page_number")
        .when(y0 > height * 0.94, "footer")
        .when(t.rlike(P.SECTION) & (F.length(text) < 120), "section")
        .when(F.startswith(lower, F.lit("abstract")), "abstract")
        .when(F.startswith(lower, F.lit("references")) | F.startswith(lower, F.lit("bibliography")), "reference")
        .when(looks_like_formula(text), "formula")
        .when((y0 < height * 0.12) & (F.length(text) < 180) & ~F.contains(text, F.lit("\n")) & ~F.rtrim(text).rlike("[.;:]$") & ~text.rlike("Fig\\.|Table|see |See "), "title")
        .otherwise("paragraph")
    )


def numbered(text: Column) -> Column:
    return F.trim(F.regexp_replace(visible_prose(text), r"\s+", " ")).rlike(P.EQUATION_NUMBER)


def is_display(text: Column, width: Column, height: Column, page_width: float = PAGE_WIDTH) -> Column:
    plain = visible_prose(text)
    lines = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
    formula = looks_like_formula(plain)
    return (plain != "") & (numbered(text) | ((height > 28) & (F.length(plain) > 16)) | ((width > max(140.0, page_width * 0.28)) & (F.length(plain) > 24) & formula) | ((lines >= 2) & formula))


def is_scrap(text: Column, height: Column) -> Column:
    plain = visible_prose(text)
    return (plain != "") & (height < 36) & (F.length(plain) < 96) & ~numbered(text) & (plain.rlike(P.SYMBOL) | plain.rlike("[=+−×÷/√∝≈∑∫≤≥±]") | (looks_like_formula(plain) & (F.length(plain) < 64) & (height < 28)))


def same_column(a: dict, b: dict, tol: float = 36.0) -> Column:
    return (F.abs(a["x0"] - b["x0"]) < tol) & (F.abs(a["x1"] - b["x1"]) < tol * 1.5)


def in_band(column: dict, other: dict, tol: float = 36.0) -> Column:
    return same_column(column, other, tol) | ((other["x0"] >= column["x0"] - tol) & (other["x1"] <= column["x1"] + tol))


def near(r: dict, other: dict, above: float, gap: float, columns: bool = True) -> Column:
    """other stands beside r: vertical overlap above a bound, horizontal gap below one, and not clearly in the next column."""
    found = (F.least(r["y1"], other["y1"]) - F.greatest(r["y0"], other["y0"]) > above) & (F.greatest(r["x0"], other["x0"]) - F.least(r["x1"], other["x1"]) < gap)
    return found & ~((other["x0"] >= r["x1"] + 24) & (other["x0"] - r["x0"] > 100)) if columns else found


def budget(width: Column, height: Column, size: Column) -> dict[str, Column]:
    """Lines, characters of a line and the characters that a translation should keep to; null where the block is too small to say."""
    known = ~((width < 10) | (height < 5) | (size < 5))
    lines = F.greatest(F.lit(1), F.bround(height / (size * 1.15)).cast("long"))
    per_line = F.floor(width / (size * 0.7)).cast("long")
    return {"lines": F.when(known, lines), "per_line": F.when(known, per_line), "budget": F.when(known, F.floor((lines * per_line) * 0.85).cast("long"))}
