"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits: a bit is set if it is set in more than half of the XXH64 hashes (seed 42) of the
text's shingles of words, repeats included. Fingerprints of RADIUS or fewer differing bits are linked, and no
link is lost.

Equal fingerprints become one first, so that a group of copies is one row. Two fingerprints within RADIUS bits
agree in at least one of RADIUS + 1 blocks of bits, so they are laid out as tiles of those that agree in a block;
within these, rows stand by population count. numpy compares tile against tile by exclusive-or and bit counts, and skips
pairs of tiles whose population counts differ beyond the radius. Blocks that very many fingerprints share are dealt out
as several tiles, and pairs of tiles to different tasks. A task returns the links of a spanning forest of those it finds.

Groups of a given likeness (like_groups, keep_first) join texts whose sets of shingles of five words have a cosine of 0.8 or more:
the cosine is what bits of SimHash estimate, and a Jaccard likeness of 0.8 is a cosine of 0.89. No block of bits cuts so wide a radius
without loss, but shingles do. Two such sets of n and m share at least 0.64 n (and 0.64 m) shingles, so with all shingles in one
order each has a shared one among its first n - 0.64 n + 1. The order is by the number of texts that have a shingle, rarest first: shingles
of one text come first and lead nowhere, so most texts have nothing to be compared by. Texts that share a shingle of this prefix are a
tile, in which fingerprints of 256 bits are compared as above; what these links join are candidates, and within each group of candidates
links are those of pairs whose sets of shingles have the cosine. The work follows the texts and what they share, not their pairs.

Defined results: null text is empty; a text of fewer words than a shingle is one shingle of all its words, one
without words has the fingerprint zero and is linked like any other. Repeated rows are one group. A component's id
is its smallest doc_id that isn't null, and null if there is none. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.components import components
from quillspark.llm.packed import MAX_BITS, groups, ids_of, packed, rolling, rows_by_bucket, unpacked, whole_groups, word_hashes

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tile that is compared by one task; rows and columns that numpy compares at once.
TILE, STEP = 16384, 1024
_BITS = np.arange(64, dtype=np.uint64)
#: Alike documents: shingles of five words, fingerprints of four words of 64 bits, the bits in which the first word and all words of
#: candidates may differ, and the least cosine of the sets of shingles. At that cosine a bit differs with odds of 0.205, of some texts of two or three
#: shingles 0.25, so beyond these bits lie at most 3e-6 of such pairs (by the binomial), and 1e-7 of those of five shingles or more.
LIKE_SHINGLE, LIKE_WORDS, LIKE_FIRST, LIKE_RADIUS, LIKE_RATIO = 5, 4, 32, 100, 0.8
#: Shingles of a tile of one group of candidates.
LIKE_TILE = 1 << 20
#: Texts for each bucket of shingles; a sample of texts, and how many of it have a shingle that is taken for a common one. This tells
#: only how shingles travel: common ones come last in the order and need no count.
LIKE_DOCS, LIKE_SAMPLE, LIKE_COMMON = 4096, 4096, 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint, unsigned, of a text in UTF-8."""
    words = text.lower().split()  # bytes: A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64, len(starts))
    return int(((2 * bit_counts(hashes[:, None]) > len(hashes)).astype(np.uint64) << _BITS).sum())


def bit_counts(rows: np.ndarray, step: int = 8192) -> np.ndarray:
    """How many rows have each bit of 64-bit words [row, word]; a step's counts fit 16 bits."""
    total = np.zeros(64 * rows.shape[1], np.int64)
    for k in range(0, len(rows), step):
        total += np.unpackbits(np.ascontiguousarray(rows[k : k + step]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return total


def fingerprints(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """columns and fp, the fingerprint as a signed 64-bit number."""
    rows = docs.select(*[F.col(c) for c in columns], F.col(text).alias("__body"))

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in common.utf8(batch, "__body")], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(fp.view(np.int64))], [*columns, "fp"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return common.map_batches(rows, run, f"{kinds}, fp long")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of radius + 1 blocks that divide the 64 bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def near_pairs(left: np.ndarray, right: np.ndarray | None, radius: int):
    """Index pairs of fingerprints within the radius, in pieces; right None: of left with itself, each pair once.
    Both are ordered by population count; steps whose counts differ beyond the radius are skipped."""
    pop = np.bitwise_count(left).astype(np.int16)
    other, pops = (left, pop) if right is None else (right, np.bitwise_count(right).astype(np.int16))
    for a in range(0, len(left), STEP):
        b = min(a + STEP, len(left))
        low = np.searchsorted(pops, pop[a] - radius, "left")
        high = np.searchsorted(pops, pop[b - 1] + radius, "right")
        for c in range(max(low, a) if right is None else low, high, STEP):
            d = min(c + STEP, high)
            i, j = np.nonzero(np.bitwise_count(left[a:b, None] ^ other[None, c:d]) <= radius)
            i, j = i + a, j + c
            if right is None:
                once = i < j
                i, j = i[once], j[once]
            if len(i):
                yield i, j


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the pairs i, j are joined."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _joined(n: int, pieces, alike=None) -> np.ndarray:
    """Of n positions, the least one that each is joined to by the pairs in pieces; with alike, by those pairs of one i with several j for which alike(i, j)
    says so, which isn't asked of pairs that others have joined."""
    root = np.arange(n)
    for i, j in pieces:
        if alike is None:
            root = _merge(root, i, j)
            continue
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        first, size = groups(i)
        for a, k in zip(first.tolist(), size.tolist(), strict=True):
            x, others = int(i[a]), j[a : a + k]
            others = others[root[others] != root[x]]
            if len(others):
                good = others[alike(x, others)]
                root = _merge(root, np.full(len(good), x), good)
    return root


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links among the distinct fingerprints nodes.fp that join all that lie within the radius."""
    cuts = _blocks(radius)
    block = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1)) for low, bits in cuts]
    laid = nodes.select("fp", F.posexplode(F.array(*block)).alias("k", "v"))
    crowded = laid.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    crowded = crowded.select(F.col("k").alias("ck"), F.col("v").alias("cv"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    laid = laid.join(crowded, (laid.k == crowded.ck) & (laid.v == crowded.cv), "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    # each pair of tiles of a block is a task's: a fingerprint goes to the pairs that its tile is in
    laid = laid.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    laid = laid.select("k", "v", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "own", "fp")

    def run(batches):
        held: list[np.ndarray] = []
        key = None
        for batch in batches:
            k, v, p, q, own, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            if not len(k):
                continue
            edge = np.flatnonzero((np.diff(k) != 0) | (np.diff(v) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
            out: list[tuple[int, int]] = []
            for a, b in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(k)]]), strict=True):
                here = (k[a], v[a], p[a], q[a])
                if here != key and held:
                    out += compared(key, held)
                    held = []
                key = here
                held.append(np.stack([own[a:b].astype(np.int64), fp[a:b]]))
            yield _pairs(out)
        if held:
            yield _pairs(compared(key, held))

    def compared(key, held):
        if sum(x.shape[1] for x in held) < 2:
            return []
        rows = np.concatenate(held, axis=1)
        fp = rows[1].view(np.uint64)
        order = np.argsort(np.bitwise_count(fp), kind="stable")
        fp, own = fp[order], rows[0][order]
        if key[2] == key[3]:
            x, pieces = fp, near_pairs(fp, None, radius)
        else:
            left, right = fp[own == key[2]], fp[own == key[3]]
            x, n = np.concatenate([left, right]), len(left)
            pieces = ((i, j + n) for i, j in near_pairs(left, right, radius))
        root = _joined(len(x), pieces)
        at = np.flatnonzero(root != np.arange(len(x)))
        return list(zip(x[at].view(np.int64).tolist(), x[root[at]].view(np.int64).tolist(), strict=True))

    def _pairs(out):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    dealt = laid.repartition("k", "v", "p", "q").sortWithinPartitions("k", "v", "p", "q")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    marked = common.stored(fingerprints(docs, shingle=shingle), "simhash")
    return grouped(marked, radius)


def grouped(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """component_id for rows (doc_id, fp, ...): fingerprints become nodes, with the smallest doc_id of each."""
    nodes = common.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    reached = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "at")
    nodes = nodes.join(reached, nodes.fp == reached["at"], "left").select("fp", F.coalesce("component", "fp").alias("c"), "least")
    least = nodes.groupBy("c").agg(F.min("least").alias("component_id"))
    of = nodes.join(least, "c").select(F.col("fp").alias("of"), "component_id")
    return marked.join(of, marked.fp == of["of"]).drop("of")


# ---- groups of a given likeness


def shingle_hashes(text: bytes, shingle: int = LIKE_SHINGLE) -> np.ndarray:
    """The hashes of the different shingles of a text in UTF-8, in order."""
    tokens = text.lower().split()
    return np.unique(rolling(word_hashes(tokens), min(shingle, len(tokens)), 0)) if tokens else np.zeros(0, np.uint64)


def node_of(h: np.ndarray) -> int:
    """What stands for all texts of these shingles, signed."""
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63)


def signed(h: np.ndarray, words: int = LIKE_WORDS) -> bytes:
    """The fingerprint of 64 * words bits of the hashes of a text's shingles."""
    if not len(h):
        return bytes(8 * words)
    # further words of a shingle's hash are mixed from the first
    z = h[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return np.packbits(2 * bit_counts(z) > len(h), bitorder="little").tobytes()


def marked_texts(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """columns, and node, which stands for the text's set of shingles."""
    rows = docs.select(*[F.col(c) for c in columns], F.col(text).alias("__body"))

    def run(batches):
        for batch in batches:
            node = [node_of(shingle_hashes(t)) for t in common.utf8(batch, "__body")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(node, pa.int64())], [*columns, "node"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return common.map_batches(rows, run, f"{kinds}, node long")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, n, sig, set): each text's number of different shingles, fingerprint and shingles' hashes."""

    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(t) for t in common.utf8(batch, "text")]
            arrays = [pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(signed, sets), pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "n", "sig", "set"])

    return common.map_batches(texts.select("text"), run, "node long, n long, sig binary, set binary")


def common_shingles(docs: DataFrame, total: int) -> np.ndarray:
    """Shingles that LIKE_COMMON of some LIKE_SAMPLE texts have, in order: at most the sample's shingles over LIKE_COMMON."""
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, total // LIKE_SAMPLE))) == 0).select("text")

    def run(batches):
        for batch in batches:
            h = np.concatenate([np.zeros(0, np.uint64), *map(shingle_hashes, common.utf8(batch, "text"))])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    found = common.map_batches(drawn, run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= LIKE_COMMON).select("h").collect()
    return np.sort(np.array([r["h"] for r in found], np.int64).view(np.uint64))


def prefixes(docs: DataFrame, total: int) -> DataFrame:
    """(node, h): the shingles by which texts are compared.

    A task sends the shingles of some texts together, in a row for each bucket, and numbers these texts; a bucket answers with those that
    several texts have and how many; where the answers meet again, each text's prefix is known. Of equal texts that are sent together one is. A
    shingle is told by the bucket and 40 more bits of its hash: what others share these with is compared for nothing, no link is lost."""
    bits = min(MAX_BITS, max(4, (total // LIKE_DOCS).bit_length()))
    cut, low = np.uint64(24 - bits), np.uint64((1 << 40) - 1)
    known = docs.sparkSession.sparkContext.broadcast(np.unique(common_shingles(docs, total) >> cut))  # bounded by the sample
    names, kinds = ["kind", "bucket", "base", "ids", "entries"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    answer, answers = ["kind", "base", "ids", "entries", "often"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    batch_of = lambda rows, of, types: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], of)

    def sent(batches):
        held: dict[int, np.ndarray] = {}
        first, size, often = TaskContext.get().partitionId() << 32, 0, known.value

        def flush():
            ids = np.repeat(np.arange(first, first + len(held)), [len(h) for h in held.values()])
            h = np.concatenate(list(held.values()))
            lots = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h if len(often) else np.zeros(len(h), bool)
            out = [(1, first % 16, first, np.array(list(held), "<i8").tobytes(), np.array([len(x) for x in held.values()], "<u4").tobytes())]
            if lots.any():
                out.append((2, first % 16, first, packed((ids[lots] - first).astype(np.uint64), 4), packed(h[lots], 8)))
            h, ids = h[~lots], ids[~lots]
            if len(h):
                out += [(0, *r) for r in rows_by_bucket((h >> np.uint64(40)).astype(np.int64), ids, [(h & low, 5)], base=first)]
            return batch_of(out, names, kinds)

        for batch in batches:
            for t in common.utf8(batch, "text"):
                h = shingle_hashes(t)
                node = node_of(h)
                if len(h) and node not in held:
                    held[node] = h = np.unique(h >> cut)
                    size += len(h)
                    if size >= 1 << 21:
                        yield flush()
                        first, size, held = first + len(held), 0, {}
        if held:
            yield flush()

    def met(batches):
        for bucket, rows in whole_groups(batches, ("bucket", "kind", "base", "ids", "entries")):
            out = [(kind, base, ids, x, None) for kind, base, ids, x in rows if kind]
            rows = [r for r in rows if not r[0]]
            entry = [unpacked(e, 5) for _, _, _, e in rows]
            of = np.repeat(np.arange(len(rows)), [len(e) for e in entry])
            ids = np.concatenate([np.zeros(0, np.int64), *(ids_of(0, i, len(e)) for (_, _, i, _), e in zip(rows, entry, strict=True))])
            h = np.concatenate([np.zeros(0, np.uint64), *entry])
            order = np.argsort(h, kind="stable")
            first, times = groups(h[order])
            n = np.empty(len(h), np.int64)
            n[order] = np.repeat(times, times)
            shared = np.flatnonzero(n > 1)  # still in order of the rows
            of, ids, h, n = of[shared], ids[shared].astype(np.uint64), h[shared] | (np.uint64(bucket) << np.uint64(40)), n[shared].astype("<u4")
            first, size = groups(of)
            out += [(0, rows[of[a]][1], packed(ids[a : a + k], 4), packed(h[a : a + k], 8), n[a : a + k].tobytes()) for a, k in zip(first.tolist(), size.tolist(), strict=True)]
            yield batch_of(out, answer, answers)

    def told(batches):
        for base, rows in whole_groups(batches, ("base", "kind", "ids", "entries", "often")):
            texts = [(np.frombuffer(x, "<i8"), np.frombuffer(e, "<u4")) for kind, x, e, _ in rows if kind == 1]
            node, n = texts[0]
            rows = [r for r in rows if r[0] != 1]
            ids = np.concatenate([np.zeros(0, np.int64), *(unpacked(i, 4).astype(np.int64) for _, i, _, _ in rows)])
            h = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(e, "<u8") for _, _, e, _ in rows)])
            often = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(o, "<u4").astype(np.int64) if o else np.full(len(e) // 8, 1 << 32) for _, _, e, o in rows)])
            order = np.lexsort((h, often, ids))
            ids, h = ids[order], h[order]
            first, size = groups(ids)
            need = np.maximum(1, np.ceil(LIKE_RATIO**2 * n[ids[first]] - 1e-9).astype(np.int64))
            keep = np.arange(len(ids)) - np.repeat(first, size) <= np.repeat(size - need, size)
            yield pa.RecordBatch.from_arrays([pa.array(node[ids[keep]]), pa.array(h[keep].view(np.int64))], ["node", "h"])

    laid = common.map_batches(docs.select("text"), sent, "kind int, bucket int, base long, ids binary, entries binary")
    back = laid.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(met, "kind int, base long, ids binary, entries binary, often binary")
    return back.repartition("base").sortWithinPartitions("base").mapInArrow(told, "node long, h long").distinct()


def like_links(posts: DataFrame, sets: DataFrame, tile: int | None = None) -> DataFrame:
    """(a, b): links that join all candidates, texts that share a shingle of posts (node, h), of which the first words differ in at most
    LIKE_FIRST bits, all words in at most LIKE_RADIUS, and the numbers of shingles by no more than the cosine allows. sets has node, n and sig.

    Equal tiles of several shingles are one; of a shingle that very many texts share, pairs of tiles are dealt out."""
    tile = tile or TILE
    sizes = posts.groupBy("h").agg(F.count("*").alias("texts"))
    few = posts.join(sizes.where((F.col("texts") > 1) & (F.col("texts") <= tile)), "h", "left_semi").groupBy("h").agg(F.array_sort(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    few = few.select(F.xxhash64("nodes").alias("g"), F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("own"), F.explode("nodes").alias("node"))
    many = posts.join(sizes.where(F.col("texts") > tile).select("h", F.ceil(F.col("texts") / tile).cast("int").alias("tiles")), "h")
    many = many.withColumn("own", F.pmod(F.xxhash64("node", F.lit("tile")), F.col("tiles")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    many = many.select(F.col("h").alias("g"), F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "own", "node")
    return _compared(few.unionByName(many).join(sets.select("node", "n", "sig"), "node").select("g", "p", "q", "own", "node", "n", "sig"))


def alike_links(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join all nodes (c, node) of one group of candidates c of which the sets of shingles have a cosine of
    LIKE_RATIO. A group of many shingles is dealt out as pairs of tiles."""
    laid = nodes.join(sets, "node")
    sizes = laid.groupBy("c").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / LIKE_TILE)).cast("int").alias("tiles"))
    laid = laid.join(sizes, "c").withColumn("own", F.pmod(F.xxhash64("node", F.lit("set")), F.col("tiles")).cast("int"))
    laid = laid.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return _compared(laid.select(F.col("c").alias("g"), F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "own", "node", "n", "sig", "set"))


def _compared(laid: DataFrame) -> DataFrame:
    """Links (a, b) within the groups (g, p, q): of a tile with itself, or of tile p with tile q. Where there are sets, these decide."""
    keys = ["g", "p", "q"]
    width = len(laid.columns)

    def run(batches):
        key, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(width)), strict=True):
                if row[:3] != key and held:
                    yield compared(key, held)
                    held = []
                key = row[:3]
                held.append(row[3:])
        if held:
            yield compared(key, held)

    def compared(key, held):
        own, node, n, sig, *sets = zip(*held, strict=True)
        sig = np.frombuffer(b"".join(sig), np.uint64).reshape(len(n), -1)
        a, b = _alike(np.array(own) == key[1], np.array(node, np.int64), np.array(n, np.int64), sig, key[1] == key[2], sets[0] if sets else None)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return laid.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def _alike(left, node, n, sig, alone: bool, sets: list | None = None):
    """Links among the nodes of a task: of a tile with itself, or of the left ones with the others. With sets, those of pairs of the cosine."""
    order = np.argsort(np.bitwise_count(sig[:, 0]), kind="stable")
    left, node, n, sig = left[order].astype(bool), node[order], n[order], sig[order]
    if alone:
        pieces = near_pairs(sig[:, 0].copy(), None, LIKE_FIRST)
    else:
        l, r = np.flatnonzero(left), np.flatnonzero(~left)
        pieces = ((l[i], r[j]) for i, j in near_pairs(sig[l, 0], sig[r, 0], LIKE_FIRST))

    def near():
        for i, j in pieces:
            keep = np.minimum(n[i], n[j]) >= LIKE_RATIO**2 * np.maximum(n[i], n[j]) - 1e-9
            i, j = i[keep], j[keep]
            for a in range(0, len(i), 1 << 17):
                x, y = i[a : a + (1 << 17)], j[a : a + (1 << 17)]
                keep = np.bitwise_count(sig[x] ^ sig[y]).sum(axis=1, dtype=np.int64) <= LIKE_RADIUS
                yield x[keep], y[keep]

    if not sets:
        root = _joined(len(node), near())
    else:
        # shingles by number; those of one text are marked, and counted in all others that it is compared with at once
        held = [np.frombuffer(sets[k], np.uint64) for k in order.tolist()]
        size = np.array([len(x) for x in held])
        start = np.cumsum(size) - size
        known, number = np.unique(np.concatenate(held), return_inverse=True)
        marked = np.zeros(len(known), bool)

        def alike(x, others):
            own = number[start[x] : start[x] + size[x]]
            marked[own] = True
            n = size[others]
            ends = np.cumsum(n)
            shared = np.add.reduceat(marked[number[np.arange(ends[-1]) + np.repeat(start[others] - ends + n, n)]], ends - n, dtype=np.int64)
            marked[own] = False
            return shared >= LIKE_RATIO * np.sqrt(size[x] * n.astype(float)) - 1e-9

        root = _joined(len(node), near(), alike)
    at = np.flatnonzero(root != np.arange(len(node)))
    return node[at], node[root[at]]


def like_groups(marked: DataFrame, docs: DataFrame) -> DataFrame:
    """component_id for rows (doc_id, node) of docs: documents joined by pairs of a cosine of LIKE_RATIO or more."""
    nodes = common.stored(marked.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    with common.freed_shuffles(docs.sparkSession):
        posts = common.stored(prefixes(docs.select("doc_id", "text"), marked.count()), "prefixes")
    wanted = posts.select("node").distinct()
    some = nodes.join(wanted, "node").select(F.col("least").alias("__least")).distinct()
    texts = docs.select("doc_id", "text").join(some, F.col("doc_id").eqNullSafe(F.col("__least")), "left_semi")
    # texts of other nodes (other rows of an id) go
    sets = common.stored(shingle_sets(texts).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
    reached = common.stored(components(like_links(posts, sets)).select("node", F.col("component").alias("c")), "candidates")
    reached = components(alike_links(reached, sets)).withColumnRenamed("node", "at")
    nodes = nodes.join(reached, nodes.node == reached["at"], "left").select("node", F.coalesce("component", "node").alias("c"), "least")
    least = nodes.groupBy("c").agg(F.min("least").alias("component_id"))
    of = nodes.join(least, "c").select(F.col("node").alias("of"), "component_id")
    return marked.join(of, marked.node == of["of"]).drop("of")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of alike documents, that of the smallest doc_id, with the columns of docs; of rows that are
    alike and equal in doc_id one stays. Of rows without doc_id, one stays for each group that has no other rows."""
    columns = docs.columns
    marked = common.stored(marked_texts(docs).distinct(), "simhash")
    kept = like_groups(marked, docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept_id"), F.col("node").alias("__kept_node"))
    kept = common.stored(kept.distinct(), "kept")
    # rows without an id, or of an id that has several texts, are told apart by their texts
    odd = common.stored(marked.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__odd")), "odd")
    plain = kept.where("__kept_id is not null").join(odd, F.col("__kept_id") == F.col("__odd"), "left_anti").select("__kept_id")
    named = docs.join(plain, F.col("doc_id") == F.col("__kept_id")).select(*columns).dropDuplicates(["doc_id"])
    if odd.isEmpty():
        return named
    rows = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("__odd")), "left_semi").select(F.struct(*columns).alias("__row"), "text")
    rows = marked_texts(rows, ("__row",))
    some = rows.join(kept, (rows.node == kept["__kept_node"]) & F.col("__row.doc_id").eqNullSafe(F.col("__kept_id"))).select("__row", "node", "__kept_id").dropDuplicates(["__kept_id", "node"])
    return named.unionByName(some.select("__row.*"))
