import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from castellan import schemas
from castellan.kernels import images
from castellan.operators import books, diagnosis, glyphs, notation, patches, pictures, reader, survey, trees
from castellan.plans.run import letters_of, run
from castellan.sinks import archives as sink
from castellan.sources import archives as source
from castellan.sources import pages as P

TEXTS = [
    ("b1", 1, "1.e4 e5 2.Nf3 Nc6 (2... d6 3. d4) 3. Bb5 a6 4. Ra5 Nf6"),
    ("b1", 2, "Some words here\n1. d4 d5 2. c4 e6 1-0"),
    ("b2", 1, "1. e4 c5 2. Cf3 d6 3. d4 cxd4 4. Cxd4 Cf6 5. Cc3 a6 6. Fe2 e5 7. Cb3 Fe7 8. O-O O-O 9. Fe3 Fe6 10. Cd5 Cbd7 11. Dd3 Fxd5 12. exd5"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "book_id string, page int, text string")


@pytest.fixture(scope="module")
def result(texts):
    return {k: v.cache() for k, v in run(P.of_texts(texts)).items()}


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_notation(result):
    assert {(r.book_id, r.style, r.language) for r in result["notation"].collect()} == {("b1", "letters", "en"), ("b2", "letters", "fr")}
    r = result["notation"].where("book_id = 'b2'").first()
    assert r.language_scores["fr"] == 13 and r.letter_hits == {"C": 7, "D": 1, "F": 5} and abs(r.confidence - 0.09) < 1e-12


def test_decision_list(spark):
    def report(text, font="Serif", n=1):
        page = P.of_texts(spark.createDataFrame([("b", k, text) for k in range(1, n + 1)], "book_id string, page int, text string"), font=font)
        return notation.reports(page).withColumn("needs", notation.needs_glyph_recovery()).withColumn("good", notation.is_supported()).withColumn("letters", notation.piece_letters()).first()

    assert report("1. ♘f3 ♞c6 " * 12).style == "figurine_unicode"
    r = report("1. e4 e5 " * 12, font="ChessFont")
    assert (r.style, r.language, r.needs) == ("figurine_font", None, True) and abs(r.confidence - 24 / 200 * 0.8) < 1e-12
    r = report("Nf3 " * 30, font="GlyphLessFont")
    assert r.is_ocr_layer and not r.good and r.confidence == 0 and r.language_scores is None
    assert report("Rd2 Dd2 Tf1 Cc3").language is None  # fr and es tie on letters that they share
    assert report("Rd2 Td3 Ff1").letters == "RDTFC"
    assert report("no moves").style == "letters"
    over = notation.overridden(notation.reports(P.of_texts(spark.createDataFrame([("b", 1, "x")], "book_id string, page int, text string"))), "figurine_unicode", "fr").first()
    assert (over.style, over.confidence, over.language) == ("figurine_unicode", 1.0, "fr")


def test_moves_and_counts(result):
    moves = {(r.book_id, r.id): r for r in result["moves"].collect()}
    assert len(moves) == 36 and moves["b1", "g1-m5"].parent_id == "g1-m3" and moves["b1", "g1-m5"].variation_index == 1
    assert moves["b1", "g1-m9"].status == "broken" and moves["b1", "g1-m9"].comment == "Some words here" and moves["b1", "g1-m9"].repair.raw == "Ra5"
    assert moves["b2", "g1-m7"].san == "Nxd4"
    c = {r.book_id: r.asDict() for r in result["counts"].collect()}
    assert c["b1"] == {"book_id": "b1", "games": 2, "moves": 13, "ok": 12, "uncertain": 0, "broken": 1, "skipped": 1, "ambiguous": 0}
    breaks = {r.book_id: r for r in diagnosis.book_breaks(result["moves"], result["games"], result["contradicted"]).collect()}
    assert (breaks["b1"].first_breaks, breaks["b1"].clean, breaks["b1"].below_break) == (1, 12, 0)
    assert result["errors"].isEmpty() and result["skipped"].first().reason == "no move number in context"
    text = diagnosis.report(c["b1"], breaks["b1"].asDict(), {"style": "letters", "language": "en", "confidence": 0.5}, {"unread": 2})
    assert "13 (12 ok" in text and "2 unread" in text
    assert [r.id for r in diagnosis.problems(result["moves"], ["book_id"]).collect()] == ["g1-m9"]
    assert schemas.violations(result["moves"], "id", schemas.move_rules()).isEmpty()


def test_a_bad_book_stays_alone(spark, texts):
    tokens = books.tokenize(P.of_texts(texts)).withColumn("text", F.when((F.col("book_id") == "b1") & (F.col("kind") == "move_number"), "x").otherwise(F.col("text")))
    parsed = books.parse(tokens)
    assert rows(books.table_of(parsed, "error"), "book_id") == [("b1",)] and books.table_of(parsed, "move").count() > 0


def reading_tree(spark):
    made = [("m1", None, "e4", 1, 12, 0, "ok"), ("m2", "m1", "e5", 2, 12, 0, "ok"), ("m3", "m1", "c5", 2, 12, 1, "ok"), ("m4", "m2", "Nf3", 3, 13, 0, "ok"), ("m5", "m4", "Nc8", 4, 13, 0, "broken")]
    return spark.createDataFrame(made, "id string, parent_id string, san string, ply int, page int, variation_index int, status string").withColumn("book_id", F.lit("b"))


def test_tree_lookups(spark):
    m = reading_tree(spark)
    line = trees.line_to(m, m.where("id = 'm4'")).orderBy("depth")
    assert rows(line, "id") == [("m1",), ("m2",), ("m4",)]
    assert {r.parent: r.children for r in trees.children(m).collect()}["m1"] == ["m2", "m3"]
    assert rows(trees.printed_tree(m, ["book_id"]), "id", "depth", "label") == [("m1", 0, "1. e4"), ("m2", 0, "1… e5"), ("m4", 0, "2. Nf3"), ("m5", 0, "2… Nc8"), ("m3", 1, "1… c5")]
    assert sorted(rows(reader.annotated_pages(m), "page", "broken")) == [(12, 0), (13, 1)]
    assert reader.page_after(m, 13).first().next_page == 12 and reader.page_after(m, 12).first().next_page == 13
    up = {r.id: (r.tainted, r.distance) for r in trees.ancestors(m, "id", "parent_id", F.col("status") == "broken", F.col("id") == "m1").collect()}
    assert up == {"m1": (False, None), "m2": (False, 1), "m3": (False, 1), "m4": (False, 2), "m5": (False, 3)}


def test_groups_are_dealt_to_all_tasks(spark):
    """Small groups are read from a stream in order, by as many tasks as there are cores, and none is split or joined to another."""
    from castellan.operators.groups import in_order, tasks

    df = spark.range(30_000).select(F.concat(F.lit("b"), F.col("id") % 7_000).alias("book_id"), (-F.col("id")).alias("ord"), F.when(F.col("id") % 3 > 0, F.col("id").cast("int")).alias("v")).coalesce(1)
    got = in_order(df, ["book_id"], ["ord"], lambda key, rows: [(key[0], len(rows), [r[1] for r in rows], rows[0][2])], "book_id string, n int, ords array<bigint>, v int")
    assert got.rdd.getNumPartitions() == tasks(spark) >= 4
    out = {r.book_id: r for r in got.collect()}
    assert len(out) == 7_000 and sum(r.n for r in out.values()) == 30_000
    assert out["b0"].ords == [-28_000, -21_000, -14_000, -7_000, 0] and out["b0"].v == 28_000 and out["b5"].v is None
    assert P.of_texts(spark.createDataFrame(TEXTS, "book_id string, page int, text string").coalesce(1)).rdd.getNumPartitions() == tasks(spark)


def test_positions_are_read_once():
    """A text on one board is read once, however many books print it."""
    from castellan.kernels import resolve, rules

    board, before = rules.position(rules.START), resolve.resolve.cache_info().hits
    assert [resolve.resolve(board, "Nf3").san for _ in range(3)] == ["Nf3"] * 3
    assert resolve.resolve.cache_info().hits >= before + 2
    assert resolve.reached(board, board.read("Nf3")).startswith("rnbqkbnr/pppppppp/8/8/8/5N2")


def test_cycles_end(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c")], "id string, parent_id string")
    assert trees.line_to(m, m.where("id = 'a'")).count() == 2
    assert trees.ancestors(m, "id", "parent_id", F.lit(False), F.lit(False)).count() == 3


@pytest.fixture(scope="module")
def packed(spark, texts, result):
    sources = texts.groupBy("book_id").agg(F.lit("a book.pdf").alias("filename"), F.encode(F.lit("%PDF stub"), "utf-8").alias("content"), F.max("page").alias("page_count"))
    return sink.archives(sources, result["notation"], result["games"], result["moves"]).select(F.col("book_id").alias("path"), "content").cache()


def test_archive_round_trip(packed, result):
    opened = source.opened(packed)
    assert opened.where("error is not null").isEmpty() and opened.first().cache_name.endswith("-a_book.pdf")
    assert source.moves(opened).count() == result["moves"].count() and source.games(opened).count() == 3
    m = source.manifests(opened).where("path = 'b1'").first()
    assert (m.media_type, m.page_count, m.is_pdf, m.counts.moves) == ("application/pdf", 2, True, 13)
    before = {(r.id, r.fen_before) for r in trees.fen_before(source.moves(opened).where("book_id = 'b2'"), source.games(opened).where("book_id = 'b2'")).collect()}
    assert ("g1-m1", "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1") in before
    with zipfile.ZipFile(io.BytesIO(bytes(packed.first().content))) as z:
        assert z.getinfo("source/a book.pdf").compress_type == zipfile.ZIP_STORED and z.getinfo("moves.json").compress_type == zipfile.ZIP_DEFLATED
        assert "repair" not in json.loads(z.read("moves.json"))["moves"][0]


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_bad_archives(spark):
    m = lambda **kw: json.dumps({"source": {"path": "source/b.pdf", "media_type": "application/pdf", "sha256": "0" * 64} | kw})
    cases = {"not a zip": b"nothing", "empty": zipped({}), "no manifest": zipped({"x": ""}), "not an object": zipped({"manifest.json": "[]"}), "epub": zipped({"manifest.json": m(media_type="application/epub+zip"), "moves.json": "{}"}), "no source": zipped({"manifest.json": m(), "moves.json": "{}"}), "hash": zipped({"manifest.json": m(), "moves.json": "{}", "source/b.pdf": "x"})}
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, content binary")
    assert source.opened(files).where("error is null").isEmpty()


def test_patches(spark, packed):
    moves = source.moves(source.opened(packed))
    made = [(1, "b1", "g1-m3", "san_edit", '{"san":"Nh3"}'), (2, "b1", "g1-m3", "san_edit", '{"san":"Nc3"}'), (3, "b1", "g1-m1", "bbox_edit", '{"x":1,"y":2,"w":3,"h":4}')]
    p = spark.createDataFrame([(*x, "user", datetime(2020, 1, 1)) for x in made], "ord int, book_id string, move_id string, type string, value string, source string, ts timestamp")
    assert schemas.violations(p, "move_id", schemas.patch_rules()).isEmpty()
    out = {r.id: r for r in patches.apply(moves, p).where("book_id = 'b1'").collect()}
    assert out["g1-m3"].san == "Nc3" and out["g1-m4"].fen.startswith("r1bqkbnr/pppp1ppp/2n5/4p3/4P3/2N5") and out["g1-m1"].bbox.w == 3
    bad = spark.createDataFrame([(1, "b1", "g1-m2", "san_edit", '{"san":"Qh5"}', "user", datetime(2020, 1, 1))], p.schema)
    out = {r.id: r for r in patches.apply(moves, bad).where("book_id = 'b1'").collect()}
    assert out["g1-m2"].status == "broken" and out["g1-m4"].status == "ok"
    editions = spark.createDataFrame([("b1", "x")], "book_id string, sha256 string")
    assert patches.of_edition(p.withColumn("sha256", F.lit("y")), editions).isEmpty()


SYMBOLS = "1. d4 ¤f6 2. c4 e6 3. ¤c3 ¥b4 4. e3 O-O 5. ¥d3 d5 6. ¤f3 c5 7. O-O ¤c6 8. a3 ¥xc3 9. bxc3 dxc4 10. ¥xc4 ¤a5 11. ¥d3 b6"


def test_symbols_settle(spark):
    page = P.of_texts(spark.createDataFrame([("b", 1, SYMBOLS)], "book_id string, page int, text string"))
    odd = F.transform("chars", lambda c: c.withField("font", F.when(c.char.isin("¤", "¥"), "Symbols").otherwise(c.font)))
    page = page.withColumn("chars", odd)
    assert [(r.symbol, r.n) for r in books.symbol_candidates(page).orderBy("k").collect()] == [("¤", 5), ("¥", 5)]
    found = books.symbol_meanings(page, letters_of)
    assert dict(zip(found.first().symbols, (books.FIGURINES[f] for f in found.first().figurines))) == {"¤": "N", "¥": "B"}
    assert run(page)["counts"].first().ok == 22


def test_glyphs(spark):
    page = P.of_texts(spark.createDataFrame([("b", 1, "12. tg3 e5")], "book_id string, page int, text string"))
    g = spark.createDataFrame([("b", "N", 0.9, 1, (4.0, 700.0, 1.0, 10.0), 1.6)], schemas.GLYPHS)
    fixed = books.repair_pages(page, g)
    assert fixed.first().text == "12. ♘g3 e5" and tuple(glyphs.placement_score(fixed).first()) == ("b", 1, 1)
    assert tuple(glyphs.covered_chars(page, g.withColumn("glyph", F.lit(1))).select("first", "last").first()) == (4, 4)
    assert rows(books.repair_pages(page, g.where("false")), "text") == [("12. tg3 e5",)]
    found = spark.createDataFrame([(1, 0, 0, "N", 0.9), (1, 0, 1, "R", 0.4), (1, 1, 0, "Q", 0.5)], "page int, line_no int, ord int, piece string, confidence double")
    truth = spark.createDataFrame([(1, 0, "NR"), (1, 2, "B")], "page int, line_no int, pieces string")
    scored = {r.threshold: (r.recovered, r.total, r.invented) for r in glyphs.scores(found, truth, ["page", "line_no"]).collect()}
    assert scored[0.3] == (2, 3, 1) and scored[0.45] == (1, 3, 1) and scored[0.6] == (1, 3, 0)


def test_pictures(spark):
    from test_kernels import synthetic_board

    places = ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR", "r1bq1rk1/pp2ppbp/2np1np1/8/2P1P3/2N1BP2/PP2N1PP/R2QKB1R"]
    made = [("b", k + 1, 0, 0, (10.0, 10.0, 100.0, 100.0), int(im.shape[1]), int(im.shape[0]), 500000.0, bytearray(im.tobytes())) for k, im in enumerate(map(synthetic_board, places))]
    df = spark.createDataFrame(made, f"book_id string, page int, ord int, start int, bbox {schemas.BOX}, width int, height int, page_area double, pixels binary")
    assert pictures.shaped_like_boards(df).count() == 2
    out = pictures.read(pictures.squares(df)).orderBy("page").collect()
    assert len(out) == 2 and len(out[0].twins) == 6 and out[0].rows[2] == out[0].empty * 8
    page = P.of_texts(spark.createDataFrame([("b", 1, "some words")], "book_id string, page int, text string"))
    at = pictures.place(df.where("page = 1").select("book_id", "page", "ord", F.struct(F.lit(7.0).alias("x"), F.lit(710.0).alias("y"), F.lit(3.0).alias("w"), F.lit(100.0).alias("h")).alias("bbox")), page)
    assert at.first().start == 5


def test_survey_and_sources(spark, texts):
    pages = P.of_texts(texts)
    assert rows(survey.survey(pages), "book_id", "starts") == [("b1", 2), ("b2", 1)]
    assert {r.book_id: r.last_page for r in survey.windows(pages).collect()} == {"b1": 2, "b2": 1}
    assert rows(P.page_range(pages, 2, 9), "page") == [(2,)] and dict(rows(P.page_count(pages), "book_id", "page_count")) == {"b1": 2, "b2": 1}
    files = spark.createDataFrame([("/a/x (1).pdf",), ("/b/x.pdf",), ("/a/y.pdf",)], "path string")
    assert sorted(rows(P.discover(files), "path")) == [("/a/y.pdf",), ("/b/x.pdf",)]
    zone = reader.tap_zones(spark.createDataFrame([("b1", 1, "m", "e4", 1, 0, (72.0, 640.0, 18.0, 10.0))], f"book_id string, page int, id string, san string, ply int, variation_index int, bbox {schemas.BOX}"), pages, 595.0, 842.0).first()
    assert zone.rect.top == 190.0 and zone.label == "1. e4"


def test_blocks(spark):
    c = lambda s: [{"char": x, "bbox": {"x": 1.0, "y": 1.0, "w": 1.0, "h": 1.0}, "font": "f", "size": 1.0, "consumed": ""} for x in s]
    made = [("b", 1, 100.0, 100.0, 0, 5.0, 50.0, [c("low")]), ("b", 1, 100.0, 100.0, 1, 5.0, 10.0, [c("up"), c("two")])]
    df = spark.createDataFrame(made, f"book_id string, page int, width double, height double, block int, x0 double, y0 double, lines array<array<{schemas.CHAR}>>")
    assert P.of_blocks(df).first().text == "low\n\nup\ntwo" and P.of_blocks(df, True).first().text == "up\ntwo\n\nlow"
    assert P.of_blocks(df).first().chars[3].bbox.w == 0.0


def test_truth(spark, tmp_path):
    (tmp_path / "truth.json").write_text(json.dumps({"5": [{"pieces": "NB", "text": "x"}, {"pieces": "", "text": "y"}], "book": {"a": 1}}))
    assert sorted(rows(P.read_truth(spark, str(tmp_path / "truth.json")), "page", "line_no", "pieces")) == [(5, 0, "NB"), (5, 1, "")]


def test_stages(spark, tmp_path, result):
    sink.write_stages(result, str(tmp_path), ("moves", "tokens"))
    assert spark.read.parquet(f"{tmp_path}/moves").count() == 36
    assert sink.media_type("x.PDF") == "application/pdf" and sink.media_type("x.txt") == schemas.OTHER_MEDIA
    assert sink.sparse_json({"confidence": 0.12345, "repair": None}, {"confidence": 3}) == {"confidence": 0.123}


def test_streaming(spark, tmp_path, texts):
    from castellan.streaming import books as stream

    P.of_texts(texts).repartition(1).write.parquet(f"{tmp_path}/in")
    pages = spark.readStream.schema(schemas.PAGES).parquet(f"{tmp_path}/in")
    q = stream.moves(pages).writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("streamed").where("book_id = 'b1'").count() == 13
    events = spark.createDataFrame([(datetime(2020, 1, 1, 1, 5), "view", 2.0), (datetime(2020, 1, 1, 1, 50), "view", 3.0)], "ts timestamp, event_type string, value double")
    assert [(r.n, r.value) for r in stream.event_counts(events).collect()] == [(2, 5.0)]


def test_empty_pages(spark):
    none = spark.createDataFrame([], schemas.PAGES)
    out = run(none)
    assert all(out[k].isEmpty() for k in ("moves", "games", "tokens", "notation", "counts"))
    blank = P.of_texts(spark.createDataFrame([("b", 1, None), ("b", 2, "")], "book_id string, page int, text string"))
    assert run(blank)["moves"].isEmpty()


def test_command_lines(spark, tmp_path, texts, capsys):
    from castellan import score
    from castellan import survey as survey_tool

    P.of_texts(texts).write.parquet(f"{tmp_path}/pages")
    survey_tool.main([f"{tmp_path}/pages", "--window", "2"])
    spark.createDataFrame([(5, 0, 0, "N", 0.9)], "page int, line_no int, ord int, piece string, confidence double").write.parquet(f"{tmp_path}/glyphs")
    (tmp_path / "truth.json").write_text(json.dumps({"5": [{"pieces": "N", "text": "x"}], "6": [{"pieces": "B", "text": "y"}]}))
    score.main([f"{tmp_path}/glyphs", f"{tmp_path}/truth.json", "--pages", "5", "--sweep"])
    assert "b2" in capsys.readouterr().out and score.page_numbers("5-6,9") == [5, 6, 9]


def test_line_crops_and_symbols(spark):
    """Black rectangles on a sheet: the wide one is a symbol, and its place comes back in points."""
    import numpy as np

    from castellan.operators import scans

    sheet = np.full((624 * 5, 472 * 5), 255, np.uint8)
    line = (20.0, 100.0, 40.0, 10.0)
    top = round((624 - 110) * 5)
    for x, w in ((10, 30), (70, 15), (100, 15), (130, 15)):
        sheet[top + 10 : top + 40, 18 * 5 + x : 18 * 5 + x + w] = 0
    raster = spark.createDataFrame([("b", 1, 472.0, 624.0, sheet.shape[1], sheet.shape[0], bytearray(sheet.tobytes()))], scans.RASTERS)
    lines = spark.createDataFrame([("b", 1, 0, line), ("b", 1, 1, (20.0, 300.0, 40.0, 10.0))], f"book_id string, page int, idx int, bbox {schemas.BOX}")
    crops = scans.line_crops(raster, lines)
    first = crops.orderBy("idx").first()
    assert tuple(first.clip) == (18.0, 100.0, 44.0, 10.0) and (first.width, first.height, first.scale) == (220, 50, 5.0)

    class Always:
        n_features_in_ = 1767

        def predict_proba(self, rows):
            return [[0.02, 0.02, 0.03, 0.03, 0.9]] * len(rows)

    got = glyphs.find_glyphs(crops, glyphs.Classifier(Always())).collect()
    assert [(r.piece, r.page, r.idx, tuple(r.bbox), r.width_ratio) for r in got] == [("N", 1, 0, (20.0, 102.0, 6.0, 6.0), 2.0)]
    assert glyphs.find_glyphs(crops, glyphs.Classifier(Always()), least=0.95).count() == 0
    Always.n_features_in_ = 3
    with pytest.raises(ValueError):
        glyphs.Classifier(Always())
    assert glyphs.Classifier(object()).classify_many([]) == []


def test_models_are_read_from_files_folders_and_archives(tmp_path):
    import zipfile

    import numpy as np

    rng = np.random.default_rng(0)
    crops = [np.where(rng.random((30, 20 + 4 * k)) < 0.1 + 0.18 * k, 0, 255).astype(np.uint8) for k in range(5) for _ in range(8)]
    model = glyphs.Softmax.fit([images.hog(c) for c in crops], np.repeat(np.arange(5), 8))
    np.savez(tmp_path / "classifier.npz", weights=model.weights, bias=model.bias)
    with zipfile.ZipFile(tmp_path / "model.zip", "w") as z:
        z.writestr("a/older/classifier.npz", b"not this one")
        z.write(tmp_path / "classifier.npz", "a/classifier.npz")
    for path in (tmp_path, tmp_path / "classifier.npz", tmp_path / "model.zip"):
        read = glyphs.Classifier.load(str(path)).classify_many(crops)
        assert sum(p == "KQRBN"[k // 8] for k, (p, _) in enumerate(read)) >= 36 and all(0 <= c <= 1 for _, c in read)
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("x", b"")
    with pytest.raises(ValueError):
        glyphs.Classifier.load(str(tmp_path / "empty.zip"))


@pytest.mark.parametrize("tilt", [0.0, 0.8])
def test_boards_on_a_scanned_sheet(spark, tilt):
    """Two boards pasted on a sheet of prose are found, placed and read; a page with a stored picture is not searched."""
    import numpy as np
    from test_kernels import synthetic_board

    from castellan.operators import scans

    sheet = np.full((1000, 760), 255, np.uint8)
    places = ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR", "r1bq1rk1/pp2ppbp/2np1np1/8/2P1P3/2N1BP2/PP2N1PP/R2QKB1R"]
    for k, p in enumerate(places):
        board = (synthetic_board(p) * 255).astype(np.uint8)
        y, x = 100 + 450 * k, 20 + 380 * k  # a line of pixels shows one rule, the longest
        sheet[y : y + board.shape[0], x : x + board.shape[1]] = board
    sheet[30:34, 50:700] = 0  # a rule that is no board
    if tilt:
        shift = np.round(np.arange(760) * np.tan(np.radians(tilt))).astype(int)
        sheet = np.stack([np.roll(sheet[:, c], shift[c]) for c in range(760)], 1)
    raster = spark.createDataFrame([("b", n, 760 * 0.36, 1000 * 0.36, 760, 1000, bytearray(sheet.tobytes())) for n in (1, 2)], scans.RASTERS)
    text = P.of_texts(spark.createDataFrame([("b", 1, "8... under the first"), ("b", 2, "x")], "book_id string, page int, text string"))
    under = text.withColumn("chars", F.transform("chars", lambda c, i: c.withField("bbox", F.struct((100 + 4 * i).cast("double").alias("x"), F.lit(180.0).alias("y"), F.lit(1.0).alias("w"), F.lit(10.0).alias("h")))))
    skip = spark.createDataFrame([("b", 2)], "book_id string, page int")
    found = pictures.on_pages(under, None, raster, skip)
    got = found.orderBy("ord").collect()
    assert [(r.page, r.ord, len(r.squares)) for r in got] == [(1, 0, 64), (1, 1, 64)]
    assert got[0].start == 0 and got[1].start == len("8... under the first")
    if not tilt:
        read = pictures.read(found).orderBy("start").collect()
        assert [r.rows[0][0] == read[0].rows[0][7] for r in read[:1]] == [True] and read[0].rows[3] == read[0].empty * 8
    with pytest.raises(ValueError):
        pictures.on_pages(under)


def test_findings_and_mismatches(spark):
    found = spark.createDataFrame([(1, 0, 0, "N", 0.9), (1, 0, 1, "R", 0.4), (1, 1, 0, "Q", 0.5), (2, 0, 0, "N", 0.8)], "page int, line_no int, ord int, piece string, confidence double")
    truth = spark.createDataFrame([(1, 0, "NR"), (1, 1, "Q"), (1, 2, "B"), (2, 0, "N")], "page int, line_no int, pieces string")
    assert rows(glyphs.piece_counts(found), "piece", "n") == [("N", 2), ("Q", 1)]
    assert sorted(map(tuple, glyphs.findings(found, ["page", "line_no"]).collect())) == [(1, 0, "♘", "N0.90"), (1, 1, "♕", "Q0.50"), (2, 0, "♘", "N0.80")]
    assert sorted(map(tuple, glyphs.mismatches(found, truth, ["page", "line_no"]).collect())) == [(1, 0, "NR", "N", "N0.90 R0.40"), (1, 2, "B", "", "")]


def test_sources_are_cached_once(spark, packed, tmp_path):
    files = packed.union(spark.createDataFrame([("bad", bytearray(b"x"))], "path string, content binary"))
    first, second = (source.cached(files, f"{tmp_path}/kept").collect() for _ in range(2))
    assert any(r.written for r in first) and not any(r.written for r in second) and {r.path for r in first} == {"b1", "b2"}
    with open(first[0].cache_path, "ab") as f:
        f.write(b"more")
    assert any(r.written for r in source.cached(files, f"{tmp_path}/kept").collect())


def test_a_builder_forgets_closed_games():
    from castellan.kernels import tokens, tree

    pages = ["1. e4 e5 2. Nf3", "2... Nc6 3. Bb5 (3. Bc4 Bc5) a6 1-0 1. d4", "1... d5 2. c4 1. c4 e5"]
    read = lambda k, t: list(tokens.tokenize(tokens.PageText(k, t, [(float(i), 700.0, 1.0, 10.0) for i in range(len(t))], None)))
    whole, parts = tree.Builder(), tree.Builder()
    moves = []
    for k, text in enumerate(pages, 1):
        whole.feed(read(k, text))
        parts.feed(read(k, text))
        moves += parts.forget().moves
        assert {n.game_id for n in parts.nodes.values()} <= {parts.game.id}
    assert [(m.id, m.parent_id, m.san, m.fen, m.variation_index) for m in moves] == [(m.id, m.parent_id, m.san, m.fen, m.variation_index) for m in whole.out.moves]
