"""The contract's queries against DuckDB, and against brute force where SQL can't state them."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quillspark.llm import matroska
from quillspark.llm import queries as Q
from tests.helpers import assert_same, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.fixture(scope="module")
def texts(con):
    return {i: t or "" for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", sorted(Q.oracle()))
def test_oracle(spark, sf_dir, con, name):
    assert assert_same(Q.queries()[name](spark, sf_dir), con, Q.oracle()[name]) > 0


def signed_chain(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h


def sketch(text):
    w = text.encode().split()
    w = [x.decode() for x in w]
    if not w:
        return set()
    return {h for i in range(max(1, len(w) - 4)) if (h := signed_chain(w[i : i + 5])) < 1 << 62}


def test_fingerprints(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in Q.op1_fingerprints(spark, sf_dir).collect()}
    ids = sorted(texts, reverse=True)
    assert set(got) == set(ids)
    true, near = [], []
    for i, d in enumerate(ids):
        t, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        r, a, b, c = got[d], sketch(t), sketch(edited), sketch(after)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"].split(":")[2] == "".join(f"{h:016x}" for h in sorted(a))
        for value, other, same in ((r["near_edited"], b, t == edited), (r["near_next"], c, t == after)):
            assert value == pytest.approx(1.0 if same else len(a & other) / len(a | other) if a | other else 0.0)
        if len(t.split()) > 400:
            full = lambda x: {tuple(x.split()[k : k + 5]) for k in range(len(x.split()) - 4)}
            true.append(len(full(t) & full(edited)) / len(full(t) | full(edited)))
            near.append(r["near_edited"])
    assert np.abs(np.array(true) - np.array(near)).mean() < 0.06
    by_text = defaultdict(set)
    for d, r in got.items():
        by_text[texts[d]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)


def test_media(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in Q.op3_matroska(spark, sf_dir).collect()}
    for d, t in texts.items():
        raw = t.encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = matroska.write_file(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        x = np.frombuffer(payload, np.uint8).astype(int) - 128
        said = dict(kv.split("=") for kv in r["feature"].split(";"))
        assert (int(said["packets"]), int(said["clusters"]), int(said["cues"]), int(said["sum"]), int(said["energy"])) == (len(payload) // 192, -(-len(payload) // 49152), -(-len(payload) // 49152), x.sum(), (x * x).sum())
        assert int(said["crossings"]) == np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))
        assert float(said["last_ms"]) == (len(payload) // 192 - 1) * 24 and float(said["duration_ms"]) == len(payload) / 8
    by_text = defaultdict(set)
    for d, r in got.items():
        by_text[texts[d]].add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_languages(spark, sf_dir, con):
    truth = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = Q.op4_langid(spark, sf_dir).collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [(r["lang_pred"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_toxicity(spark, sf_dir, con):
    truth = dict(con.sql("SELECT doc_id, toxic FROM labels").fetchall())
    got = Q.op5_toxicity(spark, sf_dir).collect()
    assert len(got) == con.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    clean = [r["predicted"] for r in got if truth.get(r["doc_id"]) == 0]
    assert np.mean(clean) < 0.1


def simhash(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in Q.op8_simhash(spark, sf_dir).collect()}
    fp = {d: simhash(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{fp[d]:016x}", find(d)) for d in texts}


def test_packing(spark, sf_dir, con, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    source = dict(con.sql("SELECT doc_id, source FROM documents").fetchall())
    pieces = defaultdict(list)
    filled = defaultdict(list)
    mix = defaultdict(Counter)
    for r in Q.op10_packing(spark, sf_dir).collect():
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
        mix[r["sequence_id"]][source[r["doc_id"]]] += r["length"]
    total = Counter()
    for d, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        total[source[d]] += len(ids)
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    everything = sum(total.values())
    full = [m for s, m in mix.items() if sum(m.values()) == 2048][: everything // 2048 - 2]
    worst = max(abs(m[s] - 2048 * n / everything) for m in full[:-3] for s, n in total.items())
    assert worst <= 2 * 128 + 1
