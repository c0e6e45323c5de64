"""Cases that a review has found: each asks for the whole job."""

import numpy as np
import pytest

from quillspark.llm import langid, packing, queries, simhash, toxicity

# ---- toxicity


def labelled(spark, n=2400, share=0.08):
    """Documents whose words say little about their label."""
    rng = np.random.default_rng(3)
    toxic = rng.random(n) < share
    words = lambda t: " ".join(f"w{v}" for v in np.where(rng.random(40) < (0.25 if t else 0.15), rng.integers(0, 20, 40), rng.integers(20, 120, 40)))
    docs = spark.createDataFrame([(i, words(t)) for i, t in enumerate(toxic)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int"), toxic


def test_capped_sample_keeps_the_classes_proportions(spark):
    docs, labels, toxic = labelled(spark)
    mean = lambda m: np.mean([[r["score"], r["predicted"]] for r in toxicity.score_documents(docs, m).collect()], axis=0)
    whole, capped = mean(toxicity.fit(docs, labels)), mean(toxicity.fit(docs, labels, max_docs=170))
    assert abs(whole[0] - toxic.mean()) < 0.03
    assert abs(capped[0] - whole[0]) < 0.06 and abs(capped[1] - whole[1]) < 0.08


def small_model():
    bad, good = ["kill them all now", "kill them all here"], ["them all now here kill time", "now all of them stay here", "time to kill here"]
    words, pairs = toxicity.pairs_of(bad * 8 + good * 8)
    return toxicity.fit_counts(words, toxicity.counted(pairs, np.array([1] * 16 + [0] * 24)), 1, 12)


def test_toxic_passage_of_known_words_counts_late_in_a_text():
    model = small_model()
    unit = "now all of them stay here time to kill here"
    clean = " ".join([unit] * 40)
    without, late, early = (model.describe(t) for t in (clean, f"{clean} kill them all now", f"{unit} kill them all now {clean.removeprefix(unit).strip()}"))
    assert (late[1:-1] > without[1:-1]).all()
    assert np.allclose(late[3:-1], early[3:-1], rtol=0.3)


def test_windows_count_a_pair_once_in_each():
    model = small_model()
    text = "kill them all now stay " * 30 + "time to kill them all here now all of them " * 20
    words = toxicity.tokens(text)
    ids = np.array([model.vocabulary.get(w, 0) for w in words])
    d = model.difference(ids)
    pair = list(zip(["", *words], words, strict=False))
    want = []
    for k in toxicity.WINDOWS:
        size, sums = min(k, len(d)), []
        for a in range(len(d) - size + 1):
            once = {pair[i]: d[i] for i in reversed(range(a, a + size))}
            sums.append(sum(once.values()))
        want.append(max(sums) / k)
    assert np.allclose(model.describe(text)[3:-1], want)


# ---- alike documents


def shingles(t):
    return {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}


def cosine(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / np.sqrt(len(x) * len(y))


@pytest.mark.parametrize("tile", [1 << 20, 1])
def test_alike_documents_by_their_shingles(spark, monkeypatch, tile):
    """Each pair's second text goes if and only if the sets of shingles have a cosine of 0.8; its texts share none with other pairs."""
    monkeypatch.setattr(simhash, "LIKE_TILE", tile, raising=False)
    rng = np.random.default_rng(9)
    pairs = []
    for k in range(400):
        words = [f"{k}x{v}" for v in range(9 if k % 2 else int(rng.integers(60, 300)))]
        n = len(words) - 4
        other = words[: 4 + int(np.ceil(n * rng.choice([0.55, 0.6, 0.63, 0.64, 0.66, 0.7, 0.78, 0.8, 0.82])))]
        if k % 4 < 2:
            other += [f"{k}y{v}" for v in range(len(words) - len(other))]
        pairs.append((" ".join(words), " ".join(other)))
    docs = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_first(docs).collect()}
    assert kept == {2 * i for i in range(len(pairs))} | {2 * i + 1 for i, p in enumerate(pairs) if cosine(*p) < 0.8 - 1e-9}


@pytest.mark.parametrize("sizes", [{}, {"LIKE_COMMON": 2, "TILE": 64, "LIKE_TILE": 4096}])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, sizes):
    """Copies changed more and more, a passage in a third of all texts, lines of few words: the groups of brute force over all pairs."""
    for k, v in sizes.items():
        monkeypatch.setattr(simhash, k, v)
    rng = np.random.default_rng(21)
    passage = [f"p{v}" for v in range(70)]
    texts = []
    for g in range(80):
        base = [f"w{v}" for v in rng.integers(0, 40_000, int(rng.choice([3, 6, 12, 60, 400])))]
        for changed in (0, 0, 0.01, 0.02, 0.04, 0.08):
            words = list(base)
            for at in rng.choice(len(words), int(np.ceil(len(words) * changed)), replace=False):
                words[at] = f"x{rng.integers(0, 10**9)}"
            if len(texts) % 3 == 0:
                at = int(rng.integers(0, len(words)))
                words[at:at] = passage
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    caught = {0.6: [], 0.7: [], 0.8: [], 0.9: []}
    near = []
    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared:
                near.append((a, b, shared / len(sets[a] | sets[b])))
                if shared >= 0.8 * np.sqrt(len(sets[a]) * len(sets[b])) - 1e-9:
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = simhash.marked_texts(docs).distinct()
    got = {r["doc_id"]: r["component_id"] for r in simhash.like_groups(marked, docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    for a, b, likeness in near:
        if likeness >= 0.6:
            caught[max(k for k in caught if likeness >= k)].append(got[a] == got[b])
    assert [all(caught[k]) for k in (0.8, 0.9)] == [True, True] and np.mean(caught[0.7]) > 0.95 and np.mean(caught[0.6]) > 0.3


def test_texts_of_one_id_are_told_apart(spark):
    """Of an id that has several texts, the copy goes and the other stays; of rows without an id one stays for each group."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (9, one), (9, two), (9, two), (None, one), (None, three), (None, three)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept)) == sorted([(1, one), (9, two), (0, three)])


# ---- packing


def test_ids_of_added_tokens_are_the_library_s():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert added
    for text in (f"before {added[0]} after", added[-1], "none of them"):
        assert packing.Encoder().ids(text) == plain.encode(text, add_special_tokens=False).ids


# ---- Matroska


def test_media_are_stored_and_read_back(spark, sf_dir):
    assert all("/quillspark/media-" in f for f in queries.op3_matroska(spark, sf_dir).inputFiles())


# ---- languages


def test_every_language_is_learned(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} text", f"l{i:04}") for i in range(1010)] + [(2000, "long words " * 3000, "long")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == {r[2] for r in rows}
