"""The parts of the methods, one by one."""

import base64
import hashlib
import re
import struct
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quillspark.llm import matroska, mixing, packed, packing, simhash, substrings, toxicity, urlrules, warc
from quillspark.llm.langid import clusters


# ---- Matroska


@given(st.lists(st.binary(min_size=0, max_size=700), min_size=2, max_size=12), st.sampled_from(["xiph", "ebml"]))
def test_lacing_round_trip(frames, kind):
    if kind == "ebml" and not all(frames):
        frames = [f or b"x" for f in frames]
    flags, body = matroska.lace(frames, kind)
    block = b"\x81" + struct.pack(">hB", 7, flags) + body
    track, time, _, spans = matroska.block_frames(block, 0, len(block))
    assert (track, time, [block[a:b] for a, b in spans]) == (1, 7, frames)


@given(st.integers(0, (1 << 56) - 2))
def test_sizes_round_trip(n):
    data = matroska.vint(n)
    assert matroska._vint(data, 0, len(data), False) == (n, len(data))


@pytest.mark.parametrize("lacing", ["fixed", "xiph", "ebml"])
@pytest.mark.parametrize("n", [192, 192 * 9, 192 * 8 * 32 * 2 + 192])
def test_files_round_trip(lacing, n):
    payload = bytes(i * 31 % 256 for i in range(n))
    data = matroska.write_file(payload, lacing)
    got = matroska.read_file(data)
    assert b"".join(data[a:b] for _, _, a, b, _, _ in got["packets"]) == payload
    assert [p[1] for p in got["packets"]] == [24 * i for i in range(n // 192)]
    assert len(got["cues"]) == got["clusters"] and got["duration_ms"] == n / 8


def test_unknown_sizes_and_broken_files():
    data = matroska.write_file(b"a" * 192 * 20)
    at = data.index(matroska._id(matroska.SEGMENT)) + 4
    n = 9 - data[at].bit_length()
    live = data[:at] + b"\xff" + data[at + n :]  # a segment of unknown size
    cluster = live.index(matroska._id(matroska.CLUSTER)) + 4
    m = 9 - live[cluster].bit_length()
    live = live[:cluster] + bytes([1, *[255] * 7])[: 8] + live[cluster + m :]
    cues = live.index(matroska._id(matroska.CUES))
    got = matroska.read_file(live[:cues])
    assert len(got["packets"]) == 20
    for cut in (3, 30, at + 2, len(data) // 2):
        with pytest.raises(matroska.MatroskaError):
            matroska.read_file(data[:cut])


def test_keyframes_of_block_groups():
    """A block of a group is a keyframe if the group refers to no other; the flag of 0x80 says so of simple blocks alone."""
    block = lambda flags: b"\x81" + struct.pack(">hB", 0, flags) + b"frame"
    m = matroska
    groups = [m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block(f)) + extra) for f, extra in ((0x00, b""), (0x80, m.element(m.REFERENCE_BLOCK, b"\xff")))]
    simple = [m.element(m.SIMPLE_BLOCK, block(f)) for f in (0x00, 0x80)]
    cluster = m.element(m.CLUSTER, m.element(m.TIMESTAMP, b"\x00") + b"".join(groups + simple))
    data = m._HEAD + m.element(m.SEGMENT, m._TRACKS + cluster)
    assert [p[5] for p in m.read_file(data)["packets"]] == [True, False, False, True]


def test_checksums_of_elements():
    m = matroska
    body = m.element(m.TIMESTAMP, b"\x00") + m.element(m.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 0, 0x80) + b"frame")
    for wrong in (0, 1):
        crc = m.element(m.CRC_32, struct.pack("<I", zlib.crc32(body) ^ wrong))
        data = m._HEAD + m.element(m.SEGMENT, m._TRACKS + m.element(m.CLUSTER, crc + body))
        if wrong:
            with pytest.raises(m.MatroskaError):
                m.read_file(data)
        else:
            assert len(m.read_file(data)["packets"]) == 1


# ---- WARC


def records(n):
    html = [f"<html><body>page {i} {'text ' * (i % 50)}</body></html>".encode() for i in range(n)]
    return [warc.record(i, f"http://x/{i}", h, hashlib.sha1(h).digest(), None, False) for i, h in enumerate(html)]


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_archives_round_trip(n):
    data = warc.archive(records(n))
    assert [r["headers"]["warc-target-uri"] for r in warc.read_archive(data)] == [f"http://x/{i}" for i in range(n)]
    assert (data[:4] == struct.pack("<I", warc.SKIPPABLE)) == (n >= 300)


def test_compressed_dictionary_is_read():
    data = warc.archive(records(300))
    n = struct.unpack_from("<I", data, 4)[0]
    body = zstandard.ZstdCompressor().compress(data[8 : 8 + n])
    again = struct.pack("<II", warc.SKIPPABLE, len(body)) + body + data[8 + n :]
    assert sum(1 for _ in warc.read_archive(again)) == 300


@pytest.mark.parametrize(
    "change",
    [lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1), lambda r: r[:-2], lambda r: r.replace(b"WARC/1.1", b"WARC/9"), lambda r: r.replace(b"page 0", b"page 1"), lambda r: r.replace(b"WARC-Date", b"WARC Date"), lambda r: r.replace(b"sha1:", b"sha1:*")],
)
def test_broken_records_are_found(change):
    """The broken record is told, and the next one is read."""
    one, two = records(2)
    broken, good = warc.read_archive(warc.archive([change(one), two]))
    assert isinstance(broken, warc.WarcError) and good["headers"]["warc-target-uri"] == "http://x/1"


def test_archives_of_other_writers():
    """Frames that don't state their size, chunks, no digest, no length, frames of other kinds in between."""
    http = lambda head, body: b"HTTP/1.1 200 OK\r\n" + head + b"\r\n" + body

    def one(block, digest=b""):
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: x\r\n" + digest + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    chunked = b"5;ext=1\r\nhello\r\n6\r\n world\r\n0\r\n\r\n"
    sent = base64.b32encode(hashlib.sha1(chunked).digest())
    found = [
        one(http(b"Transfer-Encoding: chunked\r\n", chunked)), one(http(b"transfer-encoding: Chunked\r\n", chunked), b"WARC-Payload-Digest: sha1:" + sent + b"\r\n"), one(http(b"", b"until the end")),
        one(http(b"Transfer-Encoding: chunked\r\n", b"9\r\nshort\r\n0\r\n\r\n")), one(http(b"", b"last"), b"WARC-Payload-Digest: md5:abc\r\n"),
    ]
    unsized = [zstandard.ZstdCompressor(write_content_size=False).compress(r) for r in found]
    data = unsized[0] + struct.pack("<II", warc.SKIPPABLE - 5, 3) + b"abc" + b"".join(unsized[1:])
    got = list(warc.read_archive(data))
    assert [None if isinstance(r, warc.WarcError) else r["payload"] for r in got] == [b"hello world", b"hello world", b"until the end", None, b"last"]
    assert got[0]["digest"] == got[1]["digest"] == hashlib.sha1(b"hello world").hexdigest()


def test_declared_sizes_are_not_believed():
    """A frame that declares 2^45 bytes, and one longer than the bound, are errors; the next record is read."""
    one, two = records(2)
    small = zstandard.ZstdCompressor(write_content_size=False).compress(one)
    huge = small[:4] + bytes([0xC0 | small[4] & 0x1F & ~0x20]) + small[5:6] + struct.pack("<Q", 1 << 45) + small[6:]
    got = list(warc.read_archive(huge + zstandard.ZstdCompressor().compress(two)))
    assert isinstance(got[0], warc.WarcError) and got[1]["type"] == "response"
    with pytest.raises(warc.WarcError):
        warc.decoded(zstandard.ZstdDecompressor(), zstandard.ZstdCompressor().compress(b"x" * 100_000), most=5000)


def test_cut_archives_are_found():
    data = warc.archive(records(300))
    for cut in (6, 100, len(data) - 1):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(data[:cut]))


# ---- URL rules

globs = st.text(alphabet="abé/.*?", min_size=0, max_size=8)


@settings(max_examples=200)
@given(st.lists(globs, min_size=1, max_size=12), st.lists(st.text(alphabet="ab/.é語", max_size=12), min_size=1, max_size=8))
def test_automaton_agrees_with_regular_expressions(patterns, urls):
    def regex(g):
        return re.compile("".join(".*" if x == "**" else "[^/]*" if x == "*" else "." if x == "?" else re.escape(x) for x in re.findall(r"\*\*|.", g)), re.S)

    got = urlrules.Automaton(patterns).match_all([u.encode() for u in urls])
    assert [[bool(regex(g).fullmatch(u)) for g in patterns] for u in urls] == got.tolist()


# ---- SimHash

words64 = st.integers(0, (1 << 64) - 1)


@given(st.lists(words64, min_size=0, max_size=40), st.integers(0, 10))
def test_near_pairs_are_all_pairs(base, radius):
    x = np.array(sorted({b ^ (1 << i % 64) ^ (1 << i * 7 % 64) for b in base for i in range(3)}, key=lambda v: v.bit_count()), np.uint64)
    got = {(min(i, j), max(i, j)) for a, b in simhash.near_pairs(x, None, radius) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if (int(x[i]) ^ int(x[j])).bit_count() <= radius}


def test_links_of_crowded_tiles(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    values = {centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 4)), replace=False)) for _ in range(900)} | {int(v) for v in rng.integers(0, 1 << 62, 300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    small, large = ({(r["a"], r["b"]) for r in simhash.links(nodes, tile=t).collect()} for t in (64, 16384))

    def parts(links):
        root = {v: v for v in signed}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in links:
            p, q = sorted((find(a), find(b)))
            root[q] = p
        return {v: find(v) for v in signed}

    every = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    assert parts(small) == parts(large) == parts(every)


# ---- substrings


@given(st.lists(st.integers(0, 3), min_size=0, max_size=60), st.integers(1, 8))
def test_rolling_hashes_tell_runs_apart(values, size):
    h = packed.rolling(packed.word_hashes([bytes([v]) for v in values]), size, 0)
    runs = [tuple(values[i : i + size]) for i in range(len(values) - size + 1)]
    assert len(h) == len(runs) and len(set(h.tolist())) == len(set(runs))
    assert len({(int(a), b) for a, b in zip(h, runs, strict=True)}) == len(set(runs))


def test_packed_values_round_trip():
    x = np.array([0, 1, (1 << 40) - 1, 12345678901], np.uint64)
    assert packed.unpacked(packed.packed(x, 5), 5).tolist() == x.tolist()


# ---- mixing


def test_inclusion_probabilities_hold_over_seeds(spark):
    """A source that is to give half of its words, over many draws: each document is taken as often as its inclusion probability says, and the largest always."""
    sizes = [400, 90, 80, 70, 60, 50, 40, 30, 20, 10, 10, 20, 30, 40, 50, 60, 70, 80, 90, 5]
    draws, times = 300, np.zeros(len(sizes))
    half = sum(sizes) / 2
    # one source for each draw, so that one run draws them all; a last one takes the rest of the words
    rows = [(d * 100 + i, f"s{d:03}", n) for d in range(draws) for i, n in enumerate(sizes)] + [(-1, "z", 2 * sum(sizes) * draws)]
    docs = spark.createDataFrame([(i, s, n) for i, s, n in rows], "doc_id long, source string, size long")
    keyed = docs.select("doc_id", "source", F.lit(0).cast("long").alias("tag"), "size", F.col("size").alias("own"), mixing.uniform(F.col("doc_id"), F.lit("")).alias("u"))
    weights = tuple([1] * draws + [int(round((rows[-1][2] + draws * half) / half))])  # a draw's target: half of its words
    got = mixing.decided(keyed, weights).collect()
    targets = {r["target"] for r in got if r["source"] != "z"}
    assert len(targets) == 1 and abs(targets.pop() - half) < 2
    taken = np.zeros(draws)
    for r in got:
        if r["source"] != "z":
            times[r["doc_id"] % 100] += r["copies"]
            taken[int(r["source"][1:])] += r["copies"] * r["size"]
    assert np.abs(taken - half).max() <= 30 and np.abs(taken - half).mean() <= 6
    rest = np.array(sizes[1:], float)
    p = np.concatenate([[1], (half - 400) / (rest**2).sum() * rest])  # 400 is certain
    assert times[0] == draws and np.abs(times / draws - p).max() < 0.15 and np.corrcoef(times, p)[0, 1] > 0.95


def test_weights_of_documents_order_the_sample(spark):
    docs = spark.createDataFrame([(i, "a" if i < 200 else "b", " ".join(["w"] * 20), float(i % 2)) for i in range(400)], "doc_id long, source string, text string, keep double")
    got = mixing.mixture(docs, weights=(1, 7), weight="keep").where("source = 'a'").collect()
    assert sum(r["taken"] for r in got) == 1000 and {r["doc_id"] % 2 for r in got if r["taken"]} == {1}
    copies = mixing.mix_copies(docs, weights=(1, 7), weight="keep")
    assert copies.columns == docs.columns and copies.where("source = 'a'").count() == 50


def test_rows_without_ids_draw_by_their_texts(spark):
    docs = spark.createDataFrame([(None, s, f"{i} " * 10) for i in range(300) for s in "ab"], "doc_id long, source string, text string")
    got = mixing.mixture(docs, weights=(1, 3)).where("source = 'a'").collect()
    assert abs(sum(r["taken"] for r in got) - 1500) <= 10 and len({r["copies"] for r in got}) == 2


# ---- packing


def laid_out(queues, window=256, slot=16):
    """The layout of queues (weight or None, tokens), and of each queue its group, number and the tails before it."""
    rows = [(w or max(1, n // slot), n // slot, n % slot) for w, n in queues]
    groups = sorted({r[:2] for r in rows}, reverse=True)
    layout = packing.Layout([(*g, sum(r[:2] == g for r in rows), sum(r[2] for r in rows if r[:2] == g)) for g in groups], window, slot)
    return layout, [(groups.index(r[:2]), sum(x[:2] == r[:2] for x in rows[:i]), sum(x[2] for x in rows[:i] if x[:2] == r[:2])) for i, r in enumerate(rows)]


queues = st.lists(st.tuples(st.one_of(st.none(), st.integers(1, 9)), st.one_of(st.integers(0, 5000), st.sampled_from([480, 500, 1600]))), min_size=1, max_size=9)


@settings(max_examples=60, deadline=None)
@given(queues)
def test_layout_covers_the_stream(queues):
    layout, places = laid_out(queues)
    filled: dict[int, list] = {}
    for (_, n), of in zip(queues, places, strict=True):
        for at in range(0, n, 700):
            for _, length, s, offset in layout.pieces(*of, at, min(700, n - at)):
                filled.setdefault(s, []).append((offset, length))
    assert sorted(filled) == list(range(len(filled)))
    for s, parts in filled.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0 and s >= sum(n for _, n in queues) // 256


@settings(max_examples=60, deadline=None)
@given(queues)
def test_places_are_those_of_a_deficit_round_robin(queues):
    """Queue by queue and quantum by quantum: the round goes on until some queue's deficit reaches half a quantum; that one is served."""
    layout, places = laid_out(queues)
    rank = sorted(range(len(queues)), key=lambda i: places[i][:2])
    left = {i: queues[i][1] // 16 for i in rank}
    weight = {i: queues[i][0] or max(1, left[i]) for i in rank}
    earned, served, now = {i: Fraction(0) for i in rank}, dict.fromkeys(rank, 0), 0
    while any(left.values()):
        active = [i for i in rank if left[i]]
        wait = min((Fraction(1, 2) - (earned[i] - served[i])) / weight[i] for i in active)
        if wait > 0:
            for i in active:
                earned[i] += wait * weight[i]
        i = next(i for i in active if earned[i] - served[i] >= Fraction(1, 2))
        assert layout.places(*places[i][:2], np.array([served[i]])).tolist() == [now]
        served[i] += 1
        left[i] -= 1
        now += 1


def test_places_are_exact_beyond_64_bits():
    big = 1 << 33
    layout = packing.Layout([(big, big, 1, 0), (big - 1, big - 1, 1, 0)], 2048, 128)
    assert layout.quanta.dtype == object
    assert layout.places(0, 0, np.array([0, 1, big - 1])).tolist() == [0, 2, 2 * big - 2]


def test_encoder_agrees_with_the_tokenizers_library():
    e = packing.Encoder()
    letters = [chr(c) for c in range(0x250)]
    texts = [f"{a}{b} {b}{a}{a} 1{a}" for a in letters for b in (" ", "a", "9", "'", "\n", "é", "\x85", "\xa0")] + ["<|endoftext|> it's we'll  \n\n x", "a" * 999, " " * 999, "don't 日本", "x" * 3000]
    assert [e.ids(t) for t in texts] == [e.exact.encode(t, add_special_tokens=False).ids for t in texts]


# ---- models


def kneser_ney(texts, y, c, min_count, min_pair):
    """p(word | context) of class c, written out: texts as lists of words, None the unknown word, "" the text's start."""
    pairs = [set(zip(["", *t], t, strict=False)) for t in texts]
    docs = {p: [sum(p in q for q, k in zip(pairs, y, strict=True) if k == j) for j in (0, 1)] for p in set().union(*pairs)}
    contexts = {}
    for _, w in docs:
        contexts[w] = contexts.get(w, 0) + 1
    known = {w for w, n in contexts.items() if n >= min_count}
    of = lambda w: w if w in known else None

    def discount(counts):
        one, two = sum(n == 1 for n in counts), sum(n == 2 for n in counts)
        return min(0.9, max(0.1, one / (one + 2 * two))) if one else 0.5

    def order(counts, d, below):
        total, kept = sum(counts.values()), {w: max(n - d, 0) for w, n in counts.items()}
        return {w: (kept.get(w, 0) + (total - sum(kept.values())) * below[w]) / total if total else below[w] for w in below}

    words = [*known, None]
    together = {w: sum(n for x, n in contexts.items() if of(x) == w) for w in words}
    shared = order(together, discount([contexts[w] for w in known]), {w: 1 / len(words) for w in words})
    own = {w: sum(p[1] == w and n[c] > 0 for p, n in docs.items()) for w in known}
    rest = 1 - shared[None]
    lower = {w: rest * p for w, p in order(own, discount(list(own.values())), {w: shared[w] / rest for w in known}).items()} | {None: shared[None]}
    d = discount([n[c] for n in docs.values()])

    def p(word, context):
        n = sum(x[c] for (u, _), x in docs.items() if u == context) if context == "" or context in known else 0
        if not n:
            return lower[of(word)]
        kept = {w: max(x[c] - d, 0) for (u, w), x in docs.items() if u == context and w in known and sum(x) >= min_pair}
        return (kept.get(word, 0) + (n - sum(kept.values())) * lower[of(word)]) / n

    return p, words


@pytest.mark.parametrize("min_count, min_pair", [(1, 1), (2, 2), (3, 4), (9, 1)])
def test_kneser_ney_is_as_written_out_and_sums_to_one(min_count, min_pair):
    rng = np.random.default_rng(min_count)
    texts = [[f"w{int(v)}" for v in rng.zipf(1.4, 30) % 40] for _ in range(60)]
    y = rng.random(60) < 0.3
    words, pairs = toxicity.pairs_of([" ".join(t) for t in texts])
    m = toxicity.fit_counts(words, toxicity.counted(pairs, y.astype(int)), min_count, min_pair)
    v = m.uni.shape[1]
    outcomes = np.array([0, *range(2, v)])
    for context in range(v):
        got = m.likelihoods(np.full(len(outcomes), context), outcomes)
        assert np.allclose(got.sum(axis=1), 1) and (got > 0).all()
    for c in (0, 1):
        p, outside = kneser_ney(texts, y.astype(int), c, min_count, min_pair)
        for context in ["", "w1", "w2", "w7", "w23", "never"]:
            for word in [*outside, "never"]:
                at = lambda w: m.vocabulary.get(w, 0)
                u = 1 if context == "" else at(context)
                assert np.isclose(m.likelihoods(np.array([u]), np.array([at(word) if word else 0]))[c, 0], p(word, context))


def test_toxic_and_ordinary_words_tell():
    words, pairs = toxicity.pairs_of(["a b c a b", "a b d d", "x y x y z", "x a y"])
    m = toxicity.fit_counts(words, toxicity.counted(pairs, np.array([0, 0, 1, 1])), 1)
    assert m.describe("")[0] == 1 and not m.describe("")[1:].any()
    assert m.describe("x y z")[1] > 0 > m.describe("a b c")[1]
    assert m.describe("never seen")[-1] == 1 and np.allclose(m.difference(np.array([0, 0]))[1:], 0)


def test_held_out_toxic_documents_are_caught():
    """Of the labelled documents of the larger table that the fit leaves out: nearly all clean ones stay, three quarters of the toxic are caught."""
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pydict()
    toxic = dict(zip(labels["doc_id"], labels["toxic"], strict=True))
    docs = [(i, t or "", toxic[i]) for i, t in zip(*pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True) if i in toxic]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    m = toxicity.fit_rows([(t, y, i % 4, 1.0) for i, t, y in docs if not held(i) and len(t) <= toxicity.MAX_CHARS])
    out = [(y, float(m.score(m.describe(t)))) for i, t, y in docs if held(i)]
    assert np.mean([s >= 0.5 for y, s in out if y == 1]) >= 0.75 and np.mean([s >= 0.5 for y, s in out if y == 0]) <= 0.02


def test_clusters_find_directions():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.eye(3)[k] + rng.normal(0, 0.05, (40, 3)) for k in range(3)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, of = clusters(x, 3)
    assert len({tuple(of[i * 40 : (i + 1) * 40]) for i in range(3)}) == 3 and np.allclose(np.linalg.norm(c, axis=1), 1)


# ---- alike documents


@given(st.lists(st.lists(words64, min_size=2, max_size=2), min_size=0, max_size=50))
def test_bit_counts(rows):
    x = np.array(rows, np.uint64).reshape(-1, 2)
    want = [sum(int(r[b // 64]) >> b % 64 & 1 for r in rows) for b in range(128)]
    assert simhash.bit_counts(x).tolist() == want


def made_documents():
    """Groups of a text and copies of it with more and more words changed: (doc_id, text) and each text's shingles."""
    rng = np.random.default_rng(11)
    out = []
    for g in range(60):
        base = [f"w{v}" for v in rng.integers(0, 50_000, int(rng.integers(60, 700)))]
        for changed in (0, 0, 0.004, 0.01, 0.3):
            words = list(base)
            for at in rng.choice(len(words), int(len(words) * changed), replace=False):
                words[at] = f"x{rng.integers(0, 10**9)}"
            out.append((len(out), " ".join(words)))
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in out]
    return out, shingles


@pytest.mark.parametrize("tile", [simhash.TILE, 32])
def test_alike_documents_go_and_others_stay(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows, shingles = made_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_first(docs).collect()}
    for g in range(0, len(rows), 5):
        likeness = [len(shingles[g] & shingles[g + k]) / len(shingles[g] | shingles[g + k]) for k in range(5)]
        assert g in kept
        for k in range(1, 5):
            assert g + k not in kept if likeness[k] >= 0.85 else g + k in kept if likeness[k] < 0.5 else True
