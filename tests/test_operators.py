"""Small cases of operators over pages, runs and the model boundary."""

import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.operators import documents as D
from quillspark.operators import pages
from quillspark.operators import translate as M
from quillspark.sources.decoration import blocks
from quillspark.streaming import pages as stream


def block(i, text, x0=50, y0=100, x1=300, y1=112, kind="paragraph", translate=True):
    return {"ord": i, "source_id": f"b{i}", "text": text, "type": kind, "translate": translate, "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}


def test_unit_takes_scrap_and_continuation_once():
    page = [block(0, "The gain depends on", y0=100, y1=112), block(1, "√x", y0=115, y1=125, kind="formula", translate=False), block(2, "and rises.", y0=128, y1=140), block(3, "and so on", y0=143, y1=155)]
    units = pages.semantic_units(page)
    assert [u["members"] for u in units] == [["b0", "b2", "b1"], ["b3"]]
    assert units[0]["source_text"] == "The gain depends on\n√x\nand rises."


def test_other_columns_are_skipped_and_display_equations_are_barriers():
    page = [block(0, "the value of", y0=100, y1=112), block(1, "right column", x0=320, x1=570, y0=113, y1=125), block(2, "continues here", y0=126, y1=138)]
    assert pages.next_continuations(page)[0]["next_id"] == "b2"
    page[1] = block(1, "y = a x + b with a long body (3)", y0=113, y1=125, kind="formula", translate=False)
    assert pages.next_continuations(page)[0]["next_id"] is None


def test_promotion_is_seen_by_later_blocks():
    page = [block(0, "x", x0=50, x1=60, kind="formula"), block(1, "y", x0=100, x1=110, kind="formula"), block(2, "z = (1)", x0=150, x1=200, kind="formula")]
    for b, d in zip(page, (False, False, True), strict=True):
        b |= {"is_display": d, "is_scrap": not d}
    assert [t["display"] for t in pages.tag_inline(page)] == [False, True, True]  # the first was looked at before the second changed


def test_shrinking_away_from_locks():
    r, ok = pages.shrink([50, 100, 300, 140], [[50, 130, 300, 160]], [50, 100, 300, 120])
    assert (r, ok) == ([50, 100, 300, 129], True)
    assert pages.shrink([50, 100, 300, 140], [[60, 100, 400, 140]], [50, 100, 300, 140])[1] is False


def test_touching_art_becomes_one_region():
    got = pages.art_regions([{"x0": 0.0, "y0": 0.0, "x1": 30.0, "y1": 15.0}, {"x0": 20.0, "y0": 10.0, "x1": 60.0, "y1": 40.0}, {"x0": 200.0, "y0": 0.0, "x1": 210.0, "y1": 90.0}])
    assert [(g["x0"], g["x1"], g["parts"]) for g in got] == [(0.0, 60.0, 2)]


def test_operators_over_blocks_take_any_table(spark):
    """Null ids are a document, pages without counterparts keep their blocks, ties go to the first, columns of the user's stay."""
    from quillspark.operators import geometry as G

    schema = "doc_id long, page long, ord long, x0 double, y0 double, x1 double, y1 double, text string, translate boolean, translated string, source_id string, mine string"
    row = lambda d, o, x0, y0, x1, y1, t="t", go=True, said="s": (d, 1, o, x0, y0, x1, y1, t, go, said, f"s{o}", "keep")
    rows = spark.createDataFrame([row(None, 0, 0.0, 0.0, 100.0, 100.0), row(None, 1, 0.0, 0.0, 100.0, 100.0), row(1, 0, 0.0, 0.0, 100.0, 20.0, said=""), row(1, 1, 0.0, 30.0, 100.0, 50.0, go=False), row(1, 2, 50.0, 45.0, 150.0, 80.0)], schema)
    left = G.without_overlaps(rows)
    assert sorted((r["doc_id"] or 0, r["ord"], r["mine"]) for r in left.collect()) == [(0, 1, "keep"), (1, 0, "keep"), (1, 1, "keep"), (1, 2, "keep")]
    raw = spark.createDataFrame([(None, 1, 7, 0.5, 0.0, 100.0, 100.0, "t"), (None, 1, 8, 0.5, 0.0, 100.0, 100.0, "u")], "doc_id long, page long, raw_ord long, x0 double, y0 double, x1 double, y1 double, text string")
    for found in (G.nearest(rows, raw), G.rematched(rows, raw)):
        assert {((r["doc_id"], r["ord"]), r["raw_ord"]) for r in found.collect()} == {((None, 0), 7), ((None, 1), 7), ((1, 0), None), ((1, 1), None), ((1, 2), None)}
    assert {(r["doc_id"], r["ord"]): r["y1"] for r in G.flow_limits(rows).collect()} == {(None, 0): 120.0, (None, 1): 120.0, (1, 0): 29.0, (1, 2): 100.0}
    assert {(r["doc_id"], r["ord"]): r["reason"] for r in G.retained(rows).collect()} == {(None, 0): None, (None, 1): None, (1, 0): "没有有效译文，已保留原文", (1, 2): "与公式或图形保护区相交，已保留原文"}
    assert [r["place"] for r in G.in_reading_order(rows).where("doc_id = 1").orderBy("ord").collect()] == [1, 2, 3]
    files = spark.createDataFrame([(None, 1, 612), (1, 1, 595), (3, 2, 612)], "doc_id long, page long, fw int")
    pages_ = rows.select("doc_id", "page").distinct().withColumn("w", F.lit(612))
    assert {r["doc_id"]: (r["pages"], r["complete"]) for r in D.assembled(pages_, files).collect()} == {None: (1, True), 1: (1, False), 3: (1, False)}
    assert G.without_overlaps(rows.limit(0)).count() == G.nearest(rows.limit(0), raw).count() == 0


def test_clips_hold_until_something_ends_them(spark):
    from quillspark.operators import artwork

    def drawing(kind, level, box, stroke=0.0, fill=1.0, line=0.0):
        return (kind, level, None if kind == "clip" else box, box if kind == "clip" else None, stroke, fill, line)

    page = [
        drawing("clip", 0, [0.0, 0.0, 100.0, 100.0]), drawing("f", 1, [50.0, 50.0, 200.0, 200.0]), drawing("clip", 1, [60.0, 0.0, 300.0, 300.0]), drawing("s", 2, [0.0, 0.0, 70.0, 70.0], 1.0, None, 4.0),
        drawing("f", 1, [0.0, 0.0, 90.0, 90.0]), drawing("f", 0, [0.0, 0.0, 700.0, 90.0]), drawing("fs", None, [10.0, 10.0, 20.0, 20.0], 0.0, 0.0), drawing("s", 0, [10.0, 10.0, 20.0, 10.0], 0.5, 0.0, None), drawing("f", 0, [5.0, 5.0, 5.0, 50.0]),
    ]
    got = {r["ord"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in artwork.visible_rects(spark.createDataFrame([(1, 1, 612.0, 792.0, page)], artwork.DRAWINGS)).collect()}
    assert got == {1: (50.0, 50.0, 100.0, 100.0), 3: (60.0, 0.0, 72.0, 72.0), 4: (0.0, 0.0, 90.0, 90.0), 5: (0.0, 0.0, 612.0, 90.0), 7: (9.9, 9.9, 20.1, 10.1)}
    assert artwork.regions(spark.createDataFrame([(1, 1, 612.0, 792.0, page), (2, 1, 612.0, 792.0, [])], artwork.DRAWINGS)).count() == 1


def test_model_failures_become_rows(spark):
    rows = spark.createDataFrame([(1, "5 dB loss"), (2, "bad words"), (3, None)], "id int, text string")
    got = {r["id"]: r["translated"] for r in M.map_model(rows, M.StubTranslator(fails_on="bad")).collect()}
    assert got == {1: "译:5 dB loss", 2: "[翻译失败: model failed]", 3: "译:"}


def test_staged_translation_masks_then_gives_up(spark):
    rows = spark.createDataFrame([(1, "5 dB in [3]"), (2, "bad 7 dB")], "id int, text string")
    got = {r["id"]: (r["translated"], r["attempt"]) for r in M.staged_translation(rows, M.StubTranslator(fails_on="bad")).collect()}
    assert got == {1: ("译:5 dB in [3]", 1), 2: ("[翻译失败: model failed]", 3)}


class Dropper:
    def translate(self, texts):
        return ["nothing kept" for _ in texts]


def test_lost_markers_are_errors(spark):
    rows = spark.createDataFrame([(1, "5 dB")], "id int, text string")
    assert M.masked_translation(rows, Dropper()).first()["error"] == "模型遗漏或重复了公式、图注编号或科学符号"


def test_pages_of_a_listing(spark):
    docs = spark.range(95).withColumn("created", F.col("id") % 7)
    got = D.numbered_pages(docs, [F.desc("created"), F.asc("id")]).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 96)) and got[-1]["page"] == 10
    assert [(r["created"], r["id"]) for r in got] == sorted(((r["created"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))


def test_pages_of_a_listing_are_numbered_by_the_ranges_that_are_ranked(spark):
    """A column that only the result needs: Spark would sample other bounds for the ranges' sizes than for the ranks."""
    docs = spark.range(20000).select("id", (F.col("id") * 7919 % 10007).alias("created"), F.concat(F.lit("paper "), F.col("id").cast("string")).alias("name"))
    got = D.numbered_pages(docs.repartition(5), [F.desc("created"), F.asc("id")]).select("id", "name", "place", "page").orderBy("place").collect()
    want = sorted(range(20000), key=lambda i: (-(i * 7919 % 10007), i))
    assert [(r["id"], r["place"], r["page"]) for r in got] == [(d, i + 1, i // 10 + 1) for i, d in enumerate(want)]


@pytest.mark.parametrize("name, size, ok", [("a.PDF", 10, True), ("a.pdf", 104857600, True), ("a.pdf", 104857601, False), ("a.txt", 1, False)])
def test_admission(spark, name, size, ok):
    assert spark.createDataFrame([(name, size)], "n string, s long").select(D.admitted(F.col("n"), F.col("s"))).first()[0] is ok


def test_stream_publishes_each_page_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 1, ""), (1, 2, 0, "y"), (2, 1, 0, "z")], "doc_id long, page long, ord long, translated string")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream.publish_pages(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", files_per_batch=1)
    got = {(r["doc_id"], r["page"]): (r["blocks"], r["blank"]) for r in stream.published(spark, f"{tmp_path}/out").collect()}
    assert got == {(1, 1): (2, 1), (1, 2): (1, 0), (2, 1): (1, 0)}
    runs = spark.createDataFrame([(1, "old", 1), (1, "run", 2), (2, "run", 1), (2, "new", 5)], "doc_id long, run_id string, started int")
    assert {r["doc_id"] for r in stream.current(stream.published(spark, f"{tmp_path}/out"), runs).collect()} == {1}


def test_blocks_of_odd_documents(spark):
    docs = spark.createDataFrame([(None, "a line", "en", "s", 1, "clash"), (1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "\n \n", "en", "s", 0, "x")], "doc_id long, text string, lang string, source string, n_chars long, page string")
    assert {r["doc_id"] for r in blocks(docs).collect()} == {None}
    assert blocks(docs.limit(0)).count() == 0


def span(text, size=10.0, y=100.0, font="Serif", flags=0):
    return {"text": text, "size": size, "font": font, "flags": flags, "y": y}


def text_block(spans, box):
    return {"kind": 0, "bbox": box, "lines": [{"bbox": box, "spans": spans}]}


@pytest.fixture(scope="module")
def dumped(spark):
    from quillspark.operators.parse import PAGES

    blocks = [
        text_block([span("A Study Of Noise", 20.0, 60.0)], [50.0, 50.0, 300.0, 70.0]),
        text_block([span("The gain of the amplifier is 5 dB in [3] and it stays the same.")], [50.0, 300.0, 300.0, 312.0]),
        text_block([span("V"), span("DD", 6.0, 102.0), span(" = 3 V "), span("(4)")], [50.0, 400.0, 300.0, 412.0]),
        text_block([span("(5)")], [310.0, 400.0, 330.0, 412.0]),
        text_block([span("Fig. 1 Spectrum of the noise")], [50.0, 500.0, 300.0, 512.0]),
        text_block([span("axis label")], [60.0, 620.0, 100.0, 640.0]),
        {"kind": 1, "bbox": [0.0] * 4, "lines": []},
        text_block([span("  ")], [0.0, 0.0, 1.0, 1.0]),
        text_block([span("12")], [300.0, 770.0, 310.0, 780.0]),
    ]
    return spark.createDataFrame([(1, 1, 612.0, 792.0, blocks, [[55.0, 610.0, 110.0, 650.0]], [])], PAGES)


def test_parse(dumped):
    from quillspark.operators.parse import parse

    got = {r["source_id"]: r for r in parse(dumped).collect()}
    assert [(k, got[k]["type"], got[k]["translate"]) for k in sorted(got)] == [
        ("b_1_1", "title", True), ("b_1_2", "paragraph", True), ("b_1_3", "formula", False), ("b_1_4", "formula", False), ("b_1_5", "caption", True), ("b_1_6", "figure", False), ("b_1_9", "formula", False), ("fig_1_1", "figure", False),
    ]
    assert got["b_1_3"]["text"] == "V<sub>DD</sub> = 3 V (4)" and got["b_1_3"]["has_subscript"]
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1]["place"])][:2] == ["b_1_1", "b_1_2"]


def test_workspace(spark, dumped, tmp_path):
    from quillspark.workspace import Workspace

    w = Workspace(spark, f"file://{tmp_path}/ws")
    names = spark.createDataFrame([(1, "paper.PDF", 1000), (2, "notes.txt", 10)], "doc_id long, filename string, bytes long")
    for _ in range(2):  # a document that is added again is there once
        w.add_pages(dumped, names)
    assert [(r["doc_id"], r["status"], r["page_count"]) for r in w.list_documents().collect()] == [(1, "uploaded", 1)]
    w.translate(M.StubTranslator())
    assert w.get_document(1).first()["status"] == "completed" and w.get_document(1).first()["output_ready"]
    before = w.check(1).first()
    assert before["overall"] and before["details"] == []
    after = w.retranslate_block(1, "b_1_2", "by hand").first()
    assert not after["overall"] and any("[b_1_2]" in x for x in after["details"])
    w.translate(M.StubTranslator("new:"), ids=spark.createDataFrame([(1,)], "doc_id long"))  # what was written by hand stays
    got = {r["source_id"]: r["translated"] for r in w.get_result(1).collect()}
    assert got["b_1_2"] == "by hand" and got["b_1_1"].startswith("new:")
    w.rebuild_layout(dumped)
    text, cited = w.chat_context(1)
    assert "→ by hand" in text and len(cited) == 5
    assert w.get_layout(1).count() == w.get_result(1).count() == 8 and w.published().first()["blocks"] == 8
    w.delete_documents(spark.createDataFrame([(1,)], "doc_id long"))
    assert w.list_documents().count() == 0
    with pytest.raises(LookupError):
        w.get_result(1)


def test_a_step_that_fails_leaves_the_table(spark, tmp_path):
    from quillspark.workspace import Workspace

    w = Workspace(spark, f"file://{tmp_path}/ws")
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a").alias("x"))
    w._put("index", rows, rows)
    bad = rows.withColumn("x", F.when(F.col("doc_id") == 150, F.raise_error(F.lit("lost"))).otherwise("b"))
    with pytest.raises(Exception, match="lost"):
        w._put("index", rows, bad)
    assert {r["x"] for r in w._read("index").collect()} == {"a"} and w._read("index").count() == 200
    w._put("index", rows.where("doc_id = 3"), rows.where("doc_id = 3").withColumn("x", F.lit("c")))
    assert sorted(r["doc_id"] for r in w._read("index").where("x = 'c'").collect()) == [3] and w._read("index").count() == 200


def test_configuration(spark, tmp_path):
    from quillspark.workspace import Workspace

    w = Workspace(spark, f"file://{tmp_path}/ws")
    assert w.load_config({"model": "m"}) == {"model": "m"}
    w.save_config({"api_key": "abcd1234efgh"})
    w.save_config({"api_key": "abcd1234wxyz", "model": "n"})
    assert w.load_config({"model": "m", "base_url": "u"}) == {"model": "n", "base_url": "u", "api_key": "abcd1234wxyz"}
    assert w.shown_config()["api_key"] == "abcd****wxyz"


def test_glossaries_of_files(spark, tmp_path):
    from quillspark.operators import restore as R
    from quillspark.sources import tables

    (tmp_path / "a.json").write_text('{"flat": "VDD", "latex": "V_1"}\n{"flat": "gm", "latex": "g_m"}\n')
    (tmp_path / "b.json").write_text('{"flat": "VDD", "latex": "V_2", "type": "superscript"}\n')
    rows = tables.read_glossary(spark, *(f"file://{tmp_path}/{n}.json" for n in ("a", "missing", "b")))
    got = {r["flat"]: (r["latex"], r["type"], r["place"]) for r in R.effective_glossary(rows).collect()}
    assert got == {"VDD": ("V_2", "superscript", 0), "gm": ("g_m", "subscript", 1)}


# ---- models


class Counting:
    """A model that fails in ways of its own, and writes down each text that reaches it."""

    def __init__(self, at, fails=()):
        self.at, self.fails = at, dict(fails)

    def translate(self, texts):
        with open(f"{self.at}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        for t in texts:
            for word, error in self.fails.items():
                if word in t:
                    raise error
        return [f"译:{t}" for t in texts]


def test_every_failure_is_a_row_and_each_text_is_asked_once_an_attempt(spark, tmp_path):
    """A text that succeeds reaches the model once by itself; one that always fails once for each attempt."""
    rows = spark.createDataFrame([(1, "fine words"), (2, "slow words"), (3, "lost words")], "id int, text string").repartition(3, "id")
    model = Counting(str(tmp_path), {"slow": TimeoutError("too slow"), "lost": ConnectionError()})
    done = M.staged_translation(rows, model, retries=2, folder=f"file://{tmp_path}/stored")
    for _ in range(3):  # reading again asks nothing again
        got = {r["id"]: (r["translated"], r["error"], r["attempt"]) for r in done.collect()}
    assert got == {1: ("译:fine words", None, 1), 2: ("[翻译失败: too slow]", "too slow", 3), 3: ("[翻译失败: ConnectionError]", "ConnectionError", 3)}
    asked = " ".join(p.read_text() for p in tmp_path.iterdir() if p.is_file())
    assert asked.count("fine") <= 2 and asked.count("slow") <= 6 and asked.count("lost") <= 6


def test_last_of_several_new_rows_wins(spark):
    now = spark.createDataFrame([(1, "a", "old"), (None, "b", "old"), (2, "c", "old")], "doc_id int, source_id string, translated string")
    new = spark.createDataFrame([(1, "a", "x", 2), (1, "a", "z", 1), (None, "b", "y", 1)], "doc_id int, source_id string, translated string, seq int")
    got = M.upsert(now, new, ["doc_id", "source_id"], ["translated"], F.lit(True), ["seq"]).collect()
    assert sorted((r["source_id"], r["translated"]) for r in got) == [("a", "x"), ("b", "y"), ("c", "old")]


class Says:
    def __init__(self, text, reason="stop"):
        self.reply, self.seen = M.Reply(text, reason), []

    def complete(self, messages, temperature, max_tokens):
        self.seen.append((messages, temperature))
        return self.reply


@pytest.mark.parametrize("reply, ok, seen", [(("  yes ", "stop"), True, True), (("cut", "length"), False, False), (("", "stop"), False, False), ((None, "stop"), False, False), (("yes", None), False, True), (("yes", "end_turn"), False, True)])
def test_connectors(reply, ok, seen):
    """A text model must say that it ended; a vision model must only not have been cut off. Neither may say nothing."""
    for call, want in ((lambda m: M.chat(m, "m", "p", "s"), ok), (lambda m: M.chat_with_images(m, "m", "p", ["data:image/png;base64,AA=="], "s"), seen)):
        model = Says(*reply)
        if want:
            assert call(model) == "yes" and model.seen[0][1] == 0
        else:
            with pytest.raises(ValueError):
                call(model)
    assert M.connection_test(Says(*reply), "m")["ok"] is ok


def test_messages_of_connectors():
    model = Says("x")
    with pytest.raises(ValueError):
        M.chat_with_images(model, "m", "p", [])
    M.chat(model, "qwen-mt-plus", "p", "s")
    M.chat_with_images(model, "m", "p", ["u"], "s")
    assert model.seen[0][0] == [{"role": "user", "content": "s\n\np"}]
    assert [x["type"] for x in model.seen[1][0][1]["content"]] == ["text", "image_url"]


def test_the_flow_takes_fallback_then_repair(spark, tmp_path):
    from quillspark.operators import flow

    rows = spark.createDataFrame([(1, 1, i, f"s{i}", "paragraph", True, False, t) for i, t in enumerate(["plain text", "first fails", "both fail", "α stays", "  "])], "doc_id long, page long, ord long, source_id string, type string, translate boolean, vision boolean, text string")
    first = Counting(str(tmp_path), {"fail": ValueError("no"), "α": ValueError("no")})
    done = flow.translated(rows, first, M.StubTranslator(fails_on="both"), M.StubTranslator("修复:"), retries=1, folder=f"file://{tmp_path}/stored")
    got = {r["ord"]: (r["stage"], r["translated"]) for r in done.collect()}
    assert got[0] == ("model", "译:plain text") and got[1] == ("fallback", "译:first fails") and got[2] == ("repair", "修复:both fail") and got[4] == ("none", "  ")
    page = flow.published(done).first()
    assert (page["blocks"], page["fallbacks"], page["repairs"], page["failures"]) == (5, 1 + (got[3][0] == "fallback"), 1, 0)
    assert flow.checked(done).first()["missing"] == 1  # the blank one


def test_font_control_maps(spark):
    """Codes that the font maps to themselves and whose glyph is known; in text they become what they stand for."""
    from quillspark.operators import parse as PA

    fonts = [(1, 1, "AB+Math", [(1, "Delta1"), (2, "alpha"), (3, "nosuchglyph"), (4, "uni2264"), (65, "Omega1"), (5, "beta")], [(1, "\x01"), (2, "\x02"), (3, "\x03"), (4, "\x04"), (65, "A"), (5, "x")])]
    controls = PA.font_controls(spark.createDataFrame(fonts, PA.FONTS))
    assert {(r["font"], r["code"], r["char"]) for r in controls.collect()} == {("Math", 1, "Δ"), ("Math", 2, "α"), ("Math", 4, "≤")}
    blocks = [text_block([span("x \x01\x04\x03", font="CD+Math"), span(" \x01", font="Other")], [50.0, 300.0, 300.0, 312.0])]
    pages_ = spark.createDataFrame([(1, 1, 612.0, 792.0, blocks, [], []), (2, 1, 612.0, 792.0, blocks, [], [])], PA.PAGES)
    got = {r["doc_id"]: r["text"] for r in PA.raw_blocks(pages_, controls).collect()}
    assert got == {1: "x Δ≤\x03 \x01", 2: "x \x01\x04\x03 \x01"}


def test_lines_of_odd_spans(spark):
    from quillspark.functions import layout as L

    lines = [[], [span("a", None, None), span(None, 10.0, 5.0)], [span("x", 0.0, 0.0)], [span("V", 10.0, 100.0), span("2", 6.0, 97.0), span(" ", 6.0, 103.0), span("n", 6.0, 103.0), span("!", 10.0, 90.0, flags=1)]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, spans array<struct<text: string, size: double, font: string, flags: int, y: double>>")
    got = {r["i"]: r["t"] for r in rows.select("i", L.line_text(F.col("spans")).alias("t")).collect()}
    assert got == {0: "", 1: "a", 2: "x", 3: "V<sup>2</sup> <sub>n</sub><sup>!</sup>"}


def test_extractors_are_sql_functions(spark):
    from quillspark.functions.register import register

    assert len(register(spark)) == 9
    r = spark.sql("SELECT quill_quantities(t) AS q, quill_citations(t) AS c, quill_numbers(t) AS n, quill_dates(t) AS d, quill_symbols(t) AS s FROM VALUES ('gain of 5 dB in [3], -7.5 on May 3, 2020 and α') v(t)").first()
    assert (r["q"], r["c"], r["d"], r["s"]) == (["5 dB"], ["[3]"], ["May 3, 2020"], ["α"]) and "-7.5" in r["n"]


def test_tables_round_trip(spark, dumped, tmp_path):
    from quillspark.operators.parse import parse
    from quillspark.sources import tables

    dumped.write.json(f"{tmp_path}/pages")
    again = tables.read_pages(spark, f"{tmp_path}/pages")
    tables.write_layout(parse(again), f"{tmp_path}/layout")
    assert tables.read_layout(spark, f"{tmp_path}/layout", 1).count() == 8 and tables.read_layout(spark, f"{tmp_path}/layout", 2).count() == 0
    index = spark.createDataFrame([(1, "a.pdf", "completed", None), (2, "b.pdf", "failed", None), (3, "c.pdf", "failed", True)], "doc_id long, filename string, status string, output_ready boolean")
    tables.write_index(index, f"{tmp_path}/index")
    got = tables.read_index(spark, f"{tmp_path}/index", spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert {(r["doc_id"], r["output_ready"]) for r in got.collect()} == {(1, True), (2, False)}
