"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import fingerprints, langid, matroska, mixing, packing, simhash, substrings, toxicity, urlrules, warc

LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(120_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (0, "one two three four five six seven", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, LONG, "en", "a"), (5, LONG, "en", "b"),
    (6, f"before {PASSAGE} after", "fr", "b"), (7, f"other {PASSAGE} end", "fr", "b"), (7, f"other {PASSAGE} end", "fr", "b"), (8, "日本語 текст ελληνικά \U0001f600", "en", "é"), (None, f"null {PASSAGE} id", "en", "a"),
    (None, "null id", "en", None), (9, "one", "en", "a"), (9, "two different texts of one id", "en", "a"), (10, "x" * 5000, "de", "a"),
]
CLASH = "fp string, key string, score string, predicted string, row string, starts string, size string, rank string, bin string, body string, component_id string, at string, of string"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return base.select("*", *[F.lit("clash").alias(c.split()[0]) for c in CLASH.split(", ")])


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "https://A.example.COM/en/x?q", big), (2, "http://www.example.com/en/", big), (2, "http://www.example.com/en/", big), (3, "no scheme", None), (4, None, ""), (5, "x://b.net/es/1#f\r\nX: y", "y" * 50), (None, "http://null.net/fr/", big), (6, "http://com/", "y" * 50)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, host string")


def test_fingerprints(spark, docs):
    got = fingerprints.edited_fingerprints(docs).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] == 5)["near_next"] == 1.0  # the next, 4, has the same text
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(docs.where("doc_id = 0")).first()
    assert one["near_next"] == 1.0  # a lone document is its own next


def test_sketches_merge_and_contain(spark):
    whole = " ".join(f"w{i}" for i in range(4000))
    part = " ".join(f"w{i}" for i in range(400))
    rows = spark.createDataFrame([(whole, part)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    inside = rows.select(fingerprints.containment(F.col("b"), F.col("a"), F.lit(1), F.lit(2)).alias("x")).first()["x"]
    assert inside == 1.0
    halves = [(" ".join(f"w{i}" for i in range(a, b)),) for a, b in ((0, 2004), (2000, 4000))]
    merged = spark.createDataFrame(halves, "t string").select(fingerprints.sketch(F.col("t")).alias("s")).agg(fingerprints.merge_sketches(F.col("s")).alias("m")).first()["m"]
    assert merged == rows.first()["a"]


def test_warc(spark, pages):
    got = warc.read_archives(warc.write_archives(warc.with_revisits(pages), archive_bytes=3000)).collect()
    assert len(got) == 8 and all(r["error"] is None for r in got)
    kinds = sorted((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert [k for k in kinds if k[2] == "revisit"] == [(False, 1, "revisit", 2), (True, 0, "revisit", 2)]
    assert warc.read_archives(warc.write_archives(warc.with_revisits(pages.limit(0)))).count() == 0


def test_media(spark, docs):
    media = matroska.encode_texts(docs)
    assert matroska.read_back(media).count() == len(ROWS)
    packets = matroska.packet_table(media.unionByName(media.limit(1).withColumn("media", F.lit(None).cast("binary"))))
    assert packets.where("error = 'null media'").count() == 1
    assert packets.where("doc_id = 0").select("track", "time_ms").first() == (1, 0)
    assert matroska.read_back(matroska.encode_texts(docs.limit(0))).count() == 0


def test_languages(spark, docs):
    model = langid.fit(docs)
    got = langid.identify(docs, model, reject=False).collect()
    assert len(got) == len(ROWS)
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert {r["score"] for r in got if r["lang_pred"] == "und"} == {0.0}
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(["² ½ ① Ⅷ 12", "…—!", "٣٤"])], "doc_id long, text string"), model, reject=False).collect()} == {"und"}
    alike = spark.createDataFrame([(i, "the same words", lang) for i, lang in enumerate(["zz", "aa"] * 20)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], round(r["score"], 6)) for r in langid.identify(alike, langid.fit(alike), reject=False).collect()} == {("aa", 1.0)}  # of equal cosines the first
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (2, 0), (3, 0), (6, 0), (7, None), (None, 1), (99, 1), (8, 5)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5)}) == 1  # equal texts
    assert {r["score"] for r in toxicity.score_documents(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    long = toxicity.sample(docs, spark.createDataFrame([(4, 1), (0, 0), (5, 0)], "doc_id long, toxic int"), F.lit(True)).collect()
    assert {r["id"] for r in long} == {0, 4}  # of a class that has only longer documents, these
    assert toxicity.fit(docs.limit(0), labels) is None


def test_urls(spark, pages):
    got = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge_urls(pages).collect())
    assert got[1] == (1, "a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2][3:] == ("www.example.com/en/", "allow") and got[4] == (3, "", "", None, "allow")
    assert got[-1][3] == "com/" and got[0][3:] == ("net/fr/", "block")
    assert urlrules.judge_urls(pages, rules=()).where("rule IS NULL AND verdict = 'allow'").count() == 8
    assert urlrules.judge_urls(pages.limit(0)).count() == 0


def test_mixing(spark, docs):
    got = mixing.mixture(docs).collect()
    assert len(got) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in got)
    empty = mixing.mixture(docs.where("doc_id IN (2, 3)")).collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0), (0.0, 0)]
    assert mixing.mixture(docs.limit(0)).count() == 0
    copies = mixing.mix_copies(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["copies"] for r in got)


def test_packing_of_many_sources_keeps_their_shares(spark):
    """1,100 sources: every window holds of any tenth of them that tenth's tokens, to a few quanta."""
    docs = spark.range(6600).select(F.col("id").alias("doc_id"), (F.col("id") % 1100).cast("string").alias("source"), F.repeat(F.lit(" word"), 319).alias("text"))
    rows = packing.pack(docs, slot=64).select((F.floor(F.col("source").cast("int") / 110)).alias("tenth"), "sequence_id", "length", "source").collect()
    full, sources = {}, {}
    for r in rows:
        full.setdefault(r["sequence_id"], []).append(r)
        sources.setdefault(r["source"], set()).add(r["sequence_id"])
    assert sum(r["length"] for r in rows) == 6600 * 320 and all(sum(r["length"] for r in x) <= 2048 for x in full.values())
    spread = [max(s) - min(s) for s in sources.values()]
    assert min(spread) > 0.9 * len(full)  # every source is served from the first windows to the last


def test_packing_to_targets(spark):
    """Of two sources of like size, one at three times the other's weight: three quarters of each window until it is empty."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.repeat(F.lit(" word"), 511).alias("text"))
    shares = {}
    for r in packing.pack(docs, weights={"a": 3, "b": 1}).collect():
        shares.setdefault(r["sequence_id"], {"a": 0, "b": 0})[r["source"]] += r["length"]
    early = [shares[k]["a"] for k in range(60)]
    assert set(early) <= {1408, 1536, 1664} and np.mean(early) == pytest.approx(1536, abs=16)
    assert all(shares[k]["b"] == 2048 for k in range(70, 95))


def test_simhash(spark, docs):
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(ROWS)
    of = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] not in (None, 9)}
    assert of[5] == 4 and of[1] == of[2] == of[3] == 1
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids.count(7) <= 1 and 5 not in ids and ids.count(9) == 2
    assert simhash.near_groups(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0


def test_substrings(spark, docs):
    got = {}
    for r in substrings.repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], [tuple(s) for s in r["spans"]]))
    assert got[5] == [(120_000, 120_000, [(0, 120_000)])] and got[4][0][1] == 0
    assert got[7] == [(62, 60, [(1, 60)])] * 2 and got[6] == [(62, 0, [])]
    assert [n for _, n, _ in got[None]] == [0, 0] and got[1] == [(0, 0, [])]
    left = substrings.without_repeats(docs)
    assert left.columns == docs.columns and left.where("doc_id = 5").count() == 0
    assert {(r["text"], r["n_chars"]) for r in left.where("doc_id = 7").collect()} == {("other end", 9)}
    assert substrings.repeats(docs.limit(0)).count() == 0 and substrings.without_repeats(docs.limit(0)).count() == 0


def test_packing(spark, docs):
    got = packing.pack(docs, with_ids=True)
    done = packing.sequences(got).collect()
    assert sum(len(r["ids"]) // 4 for r in done) == sum(r["tokens"] for r in done) == got.agg(F.sum("length")).first()[0]
    assert all(r["tokens"] == 2048 or r["tokens"] & (r["tokens"] - 1) == 0 for r in done)
    weighed = packing.pack(docs, weights={"a": 3, None: 0.5})
    assert weighed.agg(F.sum("length")).first()[0] == sum(r["tokens"] for r in done)
    assert packing.pack(docs.limit(0)).count() == 0


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(0, 1, 1), (2, 1, 0), (6, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
        assert (corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() > 0) == (now.count() > 0)


@pytest.mark.parametrize("ids", ["outlier", "null", "dense", "uneven"])
def test_buckets_hold_few_documents_however_ids_are_spread(spark, ids):
    """One outlying id, ids that are all null, and ids in clumps: no bucket holds many, and each document has its next."""
    n = 6000
    made = {"outlier": F.when(F.col("id") == 7, F.lit(1 << 60)).otherwise(F.col("id")), "null": F.lit(None).cast("long"), "dense": F.col("id"), "uneven": F.col("id") * F.col("id") * F.col("id") - 9_000_000}
    docs = spark.range(n).select(made[ids].alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = docs.withColumn("h", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)))
    most = rows.groupBy(fingerprints._buckets(rows)).count().agg(F.max("count")).first()[0]
    assert most <= 3 * fingerprints.BUCKET
    got = fingerprints.with_next(docs, F.length).collect()
    assert len(got) == n and len({r["next_text"] for r in got}) == n
    if ids != "null":
        order = [r["text"] for r in sorted(got, key=lambda r: -r["doc_id"])]
        assert [r["next_text"] for r in sorted(got, key=lambda r: -r["doc_id"])] == [*order[1:], order[0]]
