"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the copies that each of its documents is due. The whole part are certain copies. Of the rest, documents have
unequal inclusion probabilities in proportion to their size (or a weight), such that the expected words are those still wanting;
where that would exceed one, a document is certain as well and is allocated first. The others are ranked by their random odds over their
inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order as long as whole documents fit into the words that are still wanting. What
then is left of these is filled by the document that comes nearest to it, FILLS times at most; only the last may go beyond. u comes from a hash of the document's id, so that reruns agree.

Texts are read once for their sizes; all else is decided on a table of ids, sources and sizes. No source is ordered in one task: ranks fall into
bins of random odds (BINS, and more of a source of very many documents), the words of the bins are summed, and only documents of one bin are ordered among themselves.

Defined results: a null text has no words; sizes of 0 take 0; null sources are a source of their own, last in
order; a null id draws by its text; rows that are equal in id, source and text are taken alike. Other columns are kept by mix_copies()
and ignored by mixture().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import common

# fixed values: the contract's weights, by the sources' order, and the most copies of a source
WEIGHTS, MOST = (5, 2, 1), 3
#: Bins of the rank within a source at least, documents for each bin beyond these, and documents that fill what is left.
BINS, PER_BIN, FILLS = 4096, 1 << 16, 3
SEED = "mixing"


def n_words(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the md5 of the seed and the id, or the text's md5 where that is null: 48 bits."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name).cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def source_weights(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """sizes (source, source_size) with weights given in turn, by the sources' code points, null last.
    One window over a row for each source."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long"))


def targets(weighted: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, weight) with target: shares of all sizes by weight, none above most times its source's
    size; what is above is shared among the others by weight. In order of size over weight, the sources that the
    common level exceeds come first, so the level needs no iteration: one window over a row for each source."""
    up = Window.orderBy(F.col("source_size") / F.col("weight"), "source_size", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = weighted.withColumn("left", F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    rows = rows.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # capped: its cap is no more than what it would get if all before it are capped
    rows = rows.withColumn("capped", F.col("left") * F.col("weight") >= most * F.col("source_size") * F.col("left_weight"))
    level = F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("weight")).alias("o"), "source_size", F.col("source").isNull().alias("z"), "source", F.col("left").alias("l"), F.col("left_weight").alias("w")))).over(everything)
    rows = rows.withColumn("level", level)
    return rows.select("source", "source_size", "weight", F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise((F.col("level.l") * F.col("weight")).cast("double") / F.col("level.w").cast("double")).alias("target"))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """What tells rows apart: doc_id, source, tag (a hash of the text) and size, with more."""
    return docs.select("doc_id", "source", F.xxhash64("text").alias("tag"), n_words(F.col("text")).alias("size"), *more)


def _same(left: DataFrame, right: DataFrame, columns) -> Column:
    met = [left[c].eqNullSafe(right[c]) for c in columns]
    out = met[0]
    for m in met[1:]:
        out = out & m
    return out


def inclusion(groups: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with lowest (the least weight that is certain, null if none is) and level: p is level * own below that.

    In order of falling weight the certain ones come first, so no iteration is needed: one window over a row for each weight of a source
    (sizes; other weights in steps of 1/64 of their logarithm)."""
    met = groups.where("size > 0 AND own > 0").join(goals.select(F.col("of").alias("source_of"), "wanting"), F.col("source").eqNullSafe(F.col("source_of")))
    steps = met.groupBy("source", "step").agg(F.sum("words").alias("words"), F.sum(F.col("words") * F.col("own")).alias("moment"), F.max("own").alias("top"), F.min("own").alias("low"), F.first("wanting").alias("wanting"))
    falling = Window.partitionBy("source").orderBy(F.desc("step"))
    steps = steps.withColumn("left", F.col("wanting") - F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double"))
    steps = steps.withColumn("rest", F.sum("moment").over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double"))
    steps = steps.withColumn("certain", F.col("left") * F.col("top") >= F.col("rest"))
    found = steps.groupBy("source").agg(F.min(F.when(F.col("certain"), F.col("low"))).alias("lowest"), F.max_by(F.col("left") / F.col("rest"), F.when(~F.col("certain"), F.col("step"))).alias("level"))
    return goals.join(found.withColumnRenamed("source", "source_of"), F.col("of").eqNullSafe(F.col("source_of")), "left").drop("source_of")


def decided(rows: DataFrame, weights=WEIGHTS, most: int = MOST, stepped: bool = False) -> DataFrame:
    """Rows (doc_id, source, tag, size, own, u), equal ones as one with their number n, with source_size, target and copies."""
    groups = common.stored(rows.groupBy("doc_id", "source", "tag", "size", "own", "u").agg(F.count("*").alias("n")).withColumn("words", F.col("size") * F.col("n")), "sizes")
    groups = groups.withColumn("step", F.floor(F.log("own") * 64) if stepped else F.col("size"))
    stats = groups.groupBy("source").agg(F.sum("words").alias("source_size"), F.count("*").alias("docs"))
    goals = targets(source_weights(stats.drop("docs"), weights), most).join(stats.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goals = goals.withColumn("wanting", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
    goals = goals.select(F.col("source").alias("of"), "source_size", "target", "whole", "wanting", "docs")
    goals = common.stored(inclusion(groups, goals), "goals")  # a row for each source

    met = groups.join(goals, groups.source.eqNullSafe(goals.of)).drop("of").withColumn("certain", F.coalesce((F.col("size") > 0) & (F.col("own") >= F.col("lowest")), F.lit(False)))
    within = lambda p: F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    p, q, u = within(F.coalesce(F.col("level") * F.col("own"), F.lit(0.0))), within(F.coalesce(F.col("wanting") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))), F.col("u")
    met = met.withColumn("rank", F.when(F.col("certain"), 0.0).otherwise((u / (1 - u)) / (p / (1 - p))))
    # without the source's own odds, ranks spread evenly over the bins; certain ones come before, in bins of their own
    odds = F.col("rank") * (q / (1 - q))
    bins = F.greatest(F.lit(BINS), F.ceil(F.col("docs") / PER_BIN))
    met = met.withColumn("bin", F.when(F.col("certain"), -F.ceil(u * bins)).otherwise(F.least(F.floor(odds / (1 + odds) * bins), bins - 1)).cast("long"))
    sums = met.where("size > 0").groupBy("source", "bin").agg(F.sum("words").alias("bin_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("bin").alias("at"), F.coalesce(F.sum("bin_size").over(before), F.lit(0)).alias("bin_before"))
    met = met.join(sums, met.source.eqNullSafe(sums.of) & (met.bin == sums["at"]), "left").drop("of", "at")
    w = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "size", "tag").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("bin_before") + F.coalesce(F.sum("words").over(w), F.lit(0))
    met = common.stored(met.withColumn("more", (F.col("size") > 0) & (F.col("certain") | (so_far + F.col("words") <= F.col("wanting")))), "ranked")

    # what is still wanting after that, and the documents that come nearest to it
    left = met.groupBy("source").agg(F.first("wanting").alias("gap"), F.sum(F.when(F.col("more"), F.col("words")).otherwise(0)).alias("got"))
    left = left.select(F.col("source").alias("of"), (F.col("gap") - F.col("got")).alias("gap"), F.array().cast("array<struct<words:bigint,rank:double,u:double,tag:bigint>>").alias("fills"))
    mine = F.struct("words", (-F.col("rank")).alias("rank"), "u", "tag")
    for k in range(FILLS):
        fits = F.col("words") < 2 * F.col("gap") if k == FILLS - 1 else F.col("words") <= F.col("gap")  # only the last may go beyond
        free = met.where("NOT more AND size > 0").join(left, met.source.eqNullSafe(left.of)).where(fits & ~F.array_contains("fills", mine))
        best = free.groupBy("source").agg(F.max(F.struct((-F.abs(F.col("words") - F.col("gap"))).alias("near"), mine.alias("it")))["it"].alias("best")).select(F.col("source").alias("s"), "best")
        left = left.join(best, left.of.eqNullSafe(best.s), "left").select("of", F.when(F.col("best").isNull(), F.col("gap")).otherwise(F.col("gap") - F.col("best.words")).alias("gap"), F.when(F.col("best").isNull(), F.col("fills")).otherwise(F.array_append("fills", F.col("best"))).alias("fills"))
    left = common.stored(left, "fills")
    met = met.join(left, met.source.eqNullSafe(left.of)).withColumn("more", F.col("more") | F.array_contains("fills", mine))
    return met.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("more").cast("long")).otherwise(F.lit(0)).cast("long")).select("doc_id", "source", "tag", "size", "n", "source_size", "target", "copies")


def _decided(docs: DataFrame, weights, most: int, weight: str | None) -> DataFrame:
    rows = _keyed(docs, uniform(F.col("doc_id"), F.col("text")).alias("u"), *([F.greatest(F.col(weight).cast("double"), F.lit(0.0)).alias("own")] if weight else []))
    return decided(rows if weight else rows.withColumn("own", F.col("size")), weights, most, bool(weight))


def mixture(docs: DataFrame, weights=WEIGHTS, most: int = MOST, weight: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken). weight: a column to which inclusion probabilities are
    proportional, in place of the size; documents without one, or one that isn't above 0, come last."""
    found = _decided(docs, weights, most, weight)
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("__k")).drop("__k")


def mix_copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST, weight: str | None = None) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with the columns of docs."""
    taken = _decided(docs, weights, most, weight).where("copies > 0").select("doc_id", "source", "tag", "copies")
    rows = _keyed(docs, F.struct(*docs.columns).alias("row")).drop("size")
    found = rows.join(taken, _same(rows, taken, ("doc_id", "source", "tag")))
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: The same rows from DuckDB, for the query's parameters.
MIX_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size FROM documents),
d AS (SELECT doc_id, source, size, md5(text) AS tag,
  (('0x' || substr(md5('mixing:' || coalesce(doc_id::VARCHAR, 'null:' || md5(text))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM t),
g AS (SELECT doc_id, source, size, tag, any_value(u) AS u, count(*) AS n, (size * count(*))::BIGINT AS words FROM d GROUP BY doc_id, source, size, tag),
stats AS (SELECT source, sum(words)::BIGINT AS source_size FROM g GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM stats),
up AS (SELECT *,
  (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0))::BIGINT AS l,
  (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::BIGINT AS lw
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, source_size, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cap AS (SELECT *, l * weight >= 3 * source_size * lw AS capped FROM up),
lev AS (SELECT l AS level_l, lw AS level_w FROM cap WHERE NOT capped ORDER BY source_size / weight, source_size, source ASC NULLS LAST LIMIT 1),
goal0 AS (SELECT cap.*, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (level_l * weight)::DOUBLE / level_w::DOUBLE END AS target FROM cap LEFT JOIN lev ON true),
goal1 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goal0),
goal AS (SELECT source AS of, source_size, target, whole, target - (whole * source_size)::DOUBLE AS wanting FROM goal1),
s0 AS (SELECT source, size, any_value(wanting) AS wanting, sum(words)::BIGINT AS w, sum(words * size)::BIGINT AS m FROM g JOIN goal ON source IS NOT DISTINCT FROM of WHERE size > 0 GROUP BY source, size),
s1 AS (SELECT *, wanting - coalesce(sum(w) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS l,
  sum(m) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest FROM s0),
s2 AS (SELECT *, l * size >= rest AS certain FROM s1),
inc AS (SELECT source, min(size) FILTER (certain) AS lowest, arg_max(l / rest, size) FILTER (NOT certain) AS level FROM s2 GROUP BY source),
p AS (SELECT g.*, source_size, target, whole, wanting, coalesce(size > 0 AND size >= lowest, false) AS certain, least(1 - 1e-9, greatest(1e-9, coalesce(level * size, 0))) AS p
  FROM g JOIN goal ON g.source IS NOT DISTINCT FROM goal.of LEFT JOIN inc ON g.source IS NOT DISTINCT FROM inc.source),
r AS (SELECT *, CASE WHEN certain THEN 0 ELSE (u / (1 - u)) / (p / (1 - p)) END AS rank FROM p),
run AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM r),
f0 AS (SELECT *, size > 0 AND (certain OR so_far + words <= wanting) AS more FROM run),
g0 AS (SELECT source AS of, any_value(wanting) - coalesce(sum(words) FILTER (more), 0) AS gap FROM f0 GROUP BY source),
f1 AS (SELECT f0.*, gap, more OR (size > 0 AND words <= gap AND row_number() OVER (PARTITION BY source, more, size > 0 AND words <= gap ORDER BY abs(words - gap), words DESC, rank) = 1) AS more1 FROM f0 JOIN g0 ON source IS NOT DISTINCT FROM of),
g1 AS (SELECT source AS of1, any_value(gap) - coalesce(sum(words) FILTER (more1 AND NOT more), 0) AS gap1 FROM f1 GROUP BY source),
f2 AS (SELECT f1.*, gap1, more1 OR (size > 0 AND words <= gap1 AND row_number() OVER (PARTITION BY source, more1, size > 0 AND words <= gap1 ORDER BY abs(words - gap1), words DESC, rank) = 1) AS more2 FROM f1 JOIN g1 ON source IS NOT DISTINCT FROM of1),
g2 AS (SELECT source AS of2, any_value(gap1) - coalesce(sum(words) FILTER (more2 AND NOT more1), 0) AS gap2 FROM f2 GROUP BY source),
f3 AS (SELECT f2.*, gap2, more2 OR (size > 0 AND words < 2 * gap2 AND row_number() OVER (PARTITION BY source, more2, size > 0 AND words < 2 * gap2 ORDER BY abs(words - gap2), words DESC, rank) = 1) AS more3 FROM f2 JOIN g2 ON source IS NOT DISTINCT FROM of2)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN (whole + more3::BIGINT) * size ELSE 0 END::BIGINT AS taken
FROM f3, unnest(range(0, n)) AS t(k)
"""
