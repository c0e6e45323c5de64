"""Substring dedup by fixed-block anchors.

A passage of LENGTH words that a document shares with one of a smaller doc_id holds a whole block of BLOCK
words of that document's own grid (blocks at multiples of BLOCK; 2 * BLOCK - 1 <= LENGTH). So:

1. Blocks of every document's grid are the index; every rolling window of BLOCK words is a probe. Both meet by
   hash, in buckets; a bucket keeps the hashes of which a larger document has a probe to a smaller one's block.
2. Documents with such anchors are read again. Around each anchor, every window of LENGTH words that holds it is
   hashed and goes to a bucket, where those that also start in a document of a smaller doc_id are marked.
3. The marked windows of a document join to maximal repeats, and the words that they cover are removed.

Hashes travel packed, in a row for each bucket and many documents, so that a probe takes five bytes and those of its id above
the row's least one. What documents of one task decide among themselves doesn't travel: of a hash that many of them have, only the probes that
are still open go on, with the least block and the greatest document; of a window, the least document alone.
Anchors have 39 bits and their bucket's; what decides are hashes of 64 bits and the bucket, which another hash (the
least of the window's blocks) gives: texts are held equal if both agree. No window is compared with another: a passage that a third of all
documents share costs as much as any other words.

Defined results: null text has no words; documents of fewer than LENGTH words have no window. Rows without a
doc_id are neither removed from nor a reference. Rows that share a doc_id don't remove words from each other, and
each is judged by its own text. Other columns are ignored by repeats() and kept by without_repeats().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.packed import MAX_BITS, MULTIPLIERS, groups, ids_of, packed, rolling, rows_by_bucket, unpacked, whole_groups, word_hashes

LENGTH, BLOCK = 50, 25
#: Documents for each bucket: so few that tasks get many buckets each, and none much more than the others.
DOCS_PER_BUCKET = 256
_BLOCK_BITS = 39


def _in_pieces(entries, bits: int):
    """Concatenated columns of entries, arrays (bucket, id, value...) of one document after another. So many entries go together
    that a row has some, however many buckets there are."""
    enough = max(1 << 18, min(16 << bits, 1 << 22))
    held, n = [], 0
    for e in entries:
        held.append(e)
        n += len(e[0])
        if n >= enough:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _sent(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * (len(names) - 2)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _bucket_bits(docs: DataFrame) -> int:
    n = docs.count()
    return min(MAX_BITS, max(4, (n // DOCS_PER_BUCKET).bit_length()))


def anchors(docs: DataFrame, bits: int, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, hashes binary): of each document, the hashes (6 bytes each) of blocks that tie it to another one."""
    if 2 * block - 1 > length:
        raise ValueError("a repeat of length words has to hold a whole block")

    names = ["bucket", "base", "ids", "entries"]

    def entries(batches):
        for batch in batches:
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), common.utf8(batch, "text"), strict=True):
                w = t.split()
                if len(w) >= length:
                    h = rolling(word_hashes(w), block, 0) >> np.uint64(64 - bits - _BLOCK_BITS)
                    yield h, np.full(len(h), doc_id), np.arange(len(h)) % block == 0

    def hits(h, doc, grid):
        """Of entries in order of h: groups, where each begins, and which entries tie two documents: the larger's probe, the smaller's block."""
        first, size = groups(h)
        least = np.repeat(np.minimum.reduceat(np.where(grid, doc, np.iinfo(np.int64).max), first), size)
        most = np.repeat(np.maximum.reduceat(doc, first), size)
        return least, most, (least < most) & ((doc > least) | (grid & (doc < most)))

    def by_document(doc, h):
        """(document, packed hashes) of entries."""
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
        first, size = groups(doc)
        return [(int(doc[a]), packed(np.unique(h[a : a + n]), 8)) for a, n in zip(first.tolist(), size.tolist(), strict=True)]

    def probes(batches):
        for h, doc, grid in _in_pieces(entries(batches), bits):
            order = np.argsort(h)
            go, out = np.ones(len(h), bool), []
            _, size = groups(h[order])
            several = order[np.repeat(size > 1, size)]
            if len(several):
                k, d, g = h[several], doc[several], grid[several]
                least, most, hit = hits(k, d, g)
                go[several] = ~hit | (g & (d == least)) | (d == most)
                out = [(int(d % (1 << bits)), int(d), None, x) for d, x in by_document(d[hit], k[hit])]
            h, doc, grid = h[go], doc[go], grid[go]  # in the documents' order: their ids then compress
            entry = ((h & np.uint64((1 << _BLOCK_BITS) - 1)) << np.uint64(1)) | grid.astype(np.uint64)
            yield _sent([*out, *rows_by_bucket((h >> np.uint64(_BLOCK_BITS)).astype(np.int64), doc, [(entry, 5)])], names)

    def met(batches):
        found = lambda rows: pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["doc_id", "hashes"])
        for bucket, rows in whole_groups(batches, names):
            yield found([(doc, x) for doc, ids, x in rows if ids is None])
            rows = [r for r in rows if r[1] is not None]
            if not rows:
                continue
            entry = [unpacked(e, 5) for _, _, e in rows]
            doc = np.concatenate([ids_of(i, o, len(e)) for (i, o, _), e in zip(rows, entry, strict=True)])
            entry = np.concatenate(entry)
            order = np.argsort(entry, kind="stable")
            doc, entry = doc[order], entry[order]
            h = entry >> np.uint64(1)
            hit = hits(h, doc, (entry & np.uint64(1)).astype(bool))[2]
            yield found(by_document(doc[hit], h[hit] | np.uint64(bucket << _BLOCK_BITS)))

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = common.map_batches(rows, probes, "bucket int, base long, ids binary, entries binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(met, "doc_id long, hashes binary")


def marked_windows(docs: DataFrame, found: DataFrame, bits: int, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, tag, starts binary): starts (4 bytes each) of the windows that also start in a document of a smaller
    doc_id; tag: 32 bits of the text's hash, for rows that share a doc_id."""

    def entries(batches):
        for batch in batches:
            columns = [*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "hashes")), common.utf8(batch, "text")]
            for doc_id, tag, blobs, t in zip(*columns, strict=True):
                w = t.split()
                if len(w) < length:
                    continue
                hashes = word_hashes(w)
                blocks = rolling(hashes, block, 0)
                wanted = np.frombuffer(b"".join(blobs), "<u8")
                at = np.flatnonzero(np.isin(blocks >> np.uint64(64 - bits - _BLOCK_BITS), wanted))
                if not len(at):
                    continue
                n = len(w) - length + 1
                cover = np.zeros(len(w) + 1, np.int64)  # windows that hold a whole anchor
                np.add.at(cover, np.maximum(0, at - (length - block)), 1)
                np.add.at(cover, at + 1, -1)
                start = np.flatnonzero(np.cumsum(cover)[:n])
                # the least block that a window holds decides its bucket: neighbouring windows mostly share it
                least = np.lib.stride_tricks.sliding_window_view(blocks, length - block + 1).min(axis=1)[start] * np.uint64(MULTIPLIERS[0])
                yield least >> np.uint64(64 - bits), np.full(len(start), doc_id), rolling(hashes, length, 1)[start], start, np.full(len(start), tag)

    names = ["bucket", "base", "ids", "hashes", "starts", "tags"]

    def by_text(doc, tag, start):
        """(document, tag, packed starts) of windows."""
        order = np.lexsort((tag, doc))
        doc, tag, start = doc[order], tag[order], start[order].astype(np.uint64)
        first, size = groups(doc, tag)
        return [(int(doc[a]), int(tag[a]), packed(start[a : a + n], 4)) for a, n in zip(first.tolist(), size.tolist(), strict=True)]

    def judge(h, doc):
        """Whether a smaller document has the window, of windows in any order."""
        order = np.argsort(h, kind="stable")
        first, size = groups(h[order])
        least = np.empty(len(h), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], first), size)
        return doc > least

    def windows(batches):
        for bucket, doc, h, start, tag in _in_pieces(entries(batches), bits):
            hit = judge(h, doc)
            out = [(int(d % (1 << bits)), d, None, None, x, np.array([t], "<i4").tobytes()) for d, t, x in by_text(doc[hit], tag[hit], start[hit])]
            go = ~hit
            parts = [(h[go], 8), (start[go].astype(np.uint64), 4), ((tag[go] & 0xFFFFFFFF).astype(np.uint64), 4)]
            yield _sent([*out, *rows_by_bucket(bucket[go].astype(np.int64), doc[go], parts)], names)

    def judged(batches):
        def found(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "tag", "starts"])

        for _, rows in whole_groups(batches, names):
            yield found([(r[0], int(np.frombuffer(r[4], "<i4")[0]), r[3]) for r in rows if r[1] is None])
            rows = [r for r in rows if r[1] is not None]
            if not rows:
                continue
            h = [np.frombuffer(r[2], "<u8") for r in rows]
            doc = np.concatenate([ids_of(r[0], r[1], len(x)) for r, x in zip(rows, h, strict=True)])
            start, tag = np.concatenate([unpacked(r[3], 4) for r in rows]), np.concatenate([np.frombuffer(r[4], "<i4") for r in rows])
            hit = judge(np.concatenate(h), doc)
            yield found(by_text(doc[hit], tag[hit], start[hit]))

    met = found.groupBy("doc_id").agg(F.collect_list("hashes").alias("hashes"))
    rows = _tagged(docs).where("doc_id is not null and text is not null").select("doc_id", "tag", "text").join(met, "doc_id")
    dealt = common.map_batches(rows, windows, "bucket int, base long, ids binary, hashes binary, starts binary, tags binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(judged, "doc_id long, tag int, starts binary")


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(F.xxhash64("text")).alias("tag"), "text")


def kept_words(text: bytes, starts: bytes, length: int = LENGTH) -> tuple[list[bytes], np.ndarray]:
    """The words and, for each, whether it is kept."""
    words = text.split()
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.frombuffer(starts, "<u4").astype(np.int64)
    at = at[at + length <= len(words)]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length, -1)
    return words, np.cumsum(cover)[: len(words)] == 0


def _marks(docs: DataFrame, length: int, block: int) -> DataFrame:
    """(of, of_tag, starts): the marked windows of each document that has any."""
    with common.freed_shuffles(docs.sparkSession):
        bits = _bucket_bits(docs)
        found = common.stored(anchors(docs, bits, length, block), "anchors")
        marks = common.stored(marked_windows(docs, found, bits, length, block), "marks")
    return marks.groupBy("doc_id", "tag").agg(F.collect_list("starts").alias("starts")).select(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag"), "starts")


def repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_sha256); spans: the maximal repeats, as (first word, words)."""
    marks = _marks(docs, length, block)

    def run(batches):
        for batch in batches:
            out = []
            for text, starts in zip(common.utf8(batch, "text"), batch.column("starts").to_pylist(), strict=True):
                words, kept = kept_words(text, b"".join(starts or []), length)
                edge = np.flatnonzero(np.diff(np.concatenate([[1], kept.astype(np.int8), [1]]))).reshape(-1, 2)
                left = words if kept.all() else [w for w, k in zip(words, kept.tolist(), strict=True) if k]
                out.append((len(words), len(words) - len(left), [{"first": int(a), "words": int(b - a)} for a, b in edge], hashlib.sha256(b" ".join(left)).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_words", "n_removed", "spans", "kept_sha256"])

    rows = _tagged(docs)
    rows = rows.join(marks, (rows.doc_id == marks.of) & (rows.tag == marks.of_tag), "left").select("doc_id", "text", "starts")
    return common.map_batches(rows, run, "doc_id long, n_words long, n_removed long, spans array<struct<first:long,words:long>>, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """docs without the repeated words: texts that lose words are the kept ones joined by spaces, with n_chars
    counted anew; documents of which nothing is left go."""
    marks = _marks(docs, length, block)

    def run(batches):
        for batch in batches:
            out = []
            for text, starts in zip(common.utf8(batch, "__body"), batch.column("starts").to_pylist(), strict=True):
                words, kept = kept_words(text, b"".join(starts), length)
                out.append(b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(out, pa.string())], ["__row", "__left"])

    keyed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__body"), F.col("doc_id").cast("long").alias("__id"), F.hash(F.xxhash64("text")).alias("__tag"))
    joined = keyed.join(marks, (F.col("__id") == marks.of) & (F.col("__tag") == marks.of_tag), "left")
    same = joined.where("starts is null").select("__row.*")
    cut = common.map_batches(joined.where("starts is not null").select("__row", "__body", "starts"), run, f"__row {keyed.schema['__row'].dataType.simpleString()}, __left string").where("__left <> ''")
    new = {"text": F.col("__left")} | ({"n_chars": F.length("__left").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return same.unionByName(cut.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns]))


#: The same rows from DuckDB.
REPEAT_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM d),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM n, unnest(range(1, greatest(n - 48, 1))) AS t(i)),
m AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS marked FROM s),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM m, unnest(range(0, 50)) AS t(k) WHERE marked),
g AS (SELECT doc_id, list(p) AS ps, count(*)::BIGINT AS k FROM c GROUP BY doc_id)
SELECT n.doc_id, n AS n_words, coalesce(k, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN k IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, j: NOT list_contains(ps, j)), ' ') END) AS kept_sha256
FROM n LEFT JOIN g ON n.doc_id = g.doc_id
"""
