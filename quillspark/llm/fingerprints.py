"""Document fingerprints: threshold-scaled sketches, in DataFrame functions alone.

Every hash of a shingle of five words below a fixed fraction of the hash range is retained. The
threshold is the same for all documents, so the sketch of a union is the union of sketches
(merge_sketches) and containment can be estimated between documents of very unequal length.

Defined results: null text is empty; a text of fewer than five words is one shingle of all its
words; no words give an empty sketch. Two empty sketches are alike (1.0) only if their texts are equal.
Rows that share a doc_id are ordered by text; null ids come last, by a hash of the text, then the text. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a shingle, and the share of the hash range that is retained: one in SCALE.
SHINGLE, SCALE = 5, 4
#: Documents of a bucket of neighbouring ids, and quantiles of the ids by which buckets are cut, at most (a square number).
BUCKET, QUANTILES = 512, 4096


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes (XXH64 over the words in turn, unsigned) below 2^64 / scale."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    below = (1 << 64) // scale

    def hashes(w: Column) -> Column:
        # get() past the end is null, and a null leaves the hash as it is: a short text is one shingle
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]))
        return F.array_sort(F.array_distinct(F.filter(each, lambda h: (h >= 0) & (h < F.lit(below)) & (F.size(w) > 0))))

    # the words are bound to a lambda's variable, or each shingle would split the text anew
    return F.transform(F.array(words), hashes)[0]


def merge_sketches(sketches: Column) -> Column:
    """Aggregate: the sketch of the documents of a group together."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches))))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def likeness(a: Column, b: Column, tag_a: Column, tag_b: Column) -> Column:
    """Estimated Jaccard likeness; 1 where the tags (hashes of the whole texts) are equal."""
    both = F.size(a) + F.size(b)
    return F.when(tag_a == tag_b, 1.0).when(both == 0, 0.0).otherwise(_shared(a, b) / (both - _shared(a, b)))


def containment(a: Column, b: Column, tag_a: Column, tag_b: Column) -> Column:
    """Estimated share of a's shingles that b has; null where a's sketch is empty and the texts differ."""
    return F.when(tag_a == tag_b, 1.0).when(F.size(a) > 0, _shared(a, b) / F.size(a))


def _hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def fingerprint(sk: Column, tag: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """``k5s4:`` and the whole text's hash, then the sketch, 16 hexadecimal digits for each hash."""
    return F.concat(F.lit(f"k{shingle}s{scale}:"), _hex(tag), F.lit(":"), F.array_join(F.transform(sk, _hex), ""))


def _buckets(docs: DataFrame) -> Column:
    """A bucket for each row of docs (doc_id long, text, h): the greater, the earlier in order. Buckets are cut at quantiles of the ids, so that they are
    as full however ids are spread, and between two quantiles by an even division of their span; null ids by their texts' hashes."""
    n, ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    cuts = min(QUANTILES, max(1, math.ceil(ids / BUCKET)))
    found = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(cuts + 1)], 4 * cuts + 100)).first()[0] or [0]
    low = sorted(set(found[:-1])) or [0]
    high = [*low[1:], max(found[-1], low[-1]) + 1]
    each = max(1, math.ceil(ids / len(low) / BUCKET))  # buckets between two quantiles
    # two steps of some sixty comparisons find the quantile below an id; a list of numbers is one literal, folded when the query is planned
    root = math.isqrt(len(low) - 1) + 1
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    upto = lambda xs, x: F.greatest(F.lit(1), F.size(F.filter(xs, lambda c: c <= x)))
    row = upto(longs(low[::root]), F.col("doc_id"))
    place = F.transform(F.array(row), lambda i: (i - 1) * root + upto(F.slice(longs(low), (i - 1) * root + 1, root), F.col("doc_id")))[0]
    wide = lambda c: c.cast("decimal(38,0)")
    if each > 1:
        part = lambda i: F.floor((wide(F.col("doc_id")) - wide(F.element_at(longs(low), i))) * each / (wide(F.element_at(longs(high), i)) - wide(F.element_at(longs(low), i)))).cast("long")
        of_id = F.transform(F.array(place), lambda i: i.cast("long") * each + F.least(F.lit(each - 1), F.greatest(F.lit(0), part(i))))[0]
    else:
        of_id = place.cast("long")
    span = (1 << 64) // max(1, math.ceil((n - ids) / BUCKET)) + 1
    of_null = F.floor((wide(F.col("h")) - wide(F.lit(str(1 << 63)))) / wide(F.lit(str(span)))).cast("long")  # below 0
    return F.when(F.col("doc_id").isNull(), of_null).otherwise(of_id)


def with_next(docs: DataFrame, make) -> DataFrame:
    """Each document (doc_id, text) with make(text) and what follows it by descending doc_id: next_text, next_made.

    The last is followed by the first. Documents meet in buckets of neighbouring ids: one shuffle of the
    texts, windows of some BUCKET rows. Only the first text of each bucket goes on to the bucket before,
    and which that is comes from a table of buckets, itself ordered in groups of buckets.
    """
    kind = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)))
    docs = docs.withColumn("b", _buckets(docs))
    ids = docs.select("b").distinct().withColumn("s", F.floor(F.col("b") / 4096))
    inside = Window.partitionBy("s").orderBy(F.desc("b"))
    groups = ids.groupBy("s").agg(F.max("b").alias("first_b"))
    over = Window.orderBy(F.desc("s"))  # a row for each 4096 buckets of 512 documents
    groups = groups.select("s", F.coalesce(F.lead("first_b").over(over), F.max("first_b").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_first"))
    follows = ids.withColumn("next_b", F.lead("b").over(inside)).join(groups, "s").select(F.col("b").alias("from_b"), F.coalesce("next_b", "next_first").alias("next_b"))

    dealt = docs.repartition("b")
    order = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), F.bitwise_not("h"), "text")
    heads = dealt.groupBy("b").agg(F.min_by("text", order).alias("head_text"))
    heads = follows.join(heads, follows.next_b == heads.b).select("from_b", "head_text", make(F.col("head_text")).alias("head_made"))
    w = Window.partitionBy("b").orderBy(F.col("doc_id").desc_nulls_last(), F.desc("h"), "text")
    rows = dealt.withColumn("made", make(F.col("text"))).select("*", F.lead("text").over(w).alias("lead_text"), F.lead("made").over(w).alias("lead_made"))
    last = F.col("lead_text").isNull()
    met = rows.join(heads, (rows.b == heads.from_b) & last, "left")
    return met.select(F.col("doc_id").cast(kind).alias("doc_id"), "text", "made", F.coalesce("lead_text", "head_text").alias("next_text"), F.coalesce("lead_made", "head_made").alias("next_made"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike the sketches are."""
    rows = with_next(docs, lambda t: F.struct(sketch(t).alias("sk"), F.xxhash64(t).alias("tag")))
    cut = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.withColumn("edited_made", F.struct(sketch(F.col("edited")).alias("sk"), F.xxhash64("edited").alias("tag")))
    pair = lambda f, other: f(F.col("made.sk"), F.col(f"{other}.sk"), F.col("made.tag"), F.col(f"{other}.tag"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("made.sk"), F.col("made.tag")).alias("fingerprint"),
        fingerprint(F.col("edited_made.sk"), F.col("edited_made.tag")).alias("edited_fingerprint"),
        pair(likeness, "edited_made").alias("near_edited"),
        pair(likeness, "next_made").alias("near_next"),
        pair(containment, "edited_made").alias("contained_in_edited"),
        pair(containment, "next_made").alias("contained_in_next"),
    )
