"""Documents, decks, presentation files and jobs."""

import json
import zipfile
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from slateflow.operators import jobs, masks
from slateflow.plans import deck as plan
from slateflow.sources import artifacts, decks, pptx
from slateflow.streaming import jobs as streams


def test_documents_are_checked(spark):
    good = {"slide_size": {"width_px": 5, "height_px": 6}, "detections": [{"box_id": "a", "category": "text", "x": 1, "y": 2, "width": 3, "height": 4}]}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(good | {"detections": []}))], "slide int, json string")
    (row,) = artifacts.read_detections(df, ["slide"]).collect()
    assert (row.slide, row.confidence, row.x, row.width_px, row.label) == (1, 1.0, 1.0, 5, None)
    bad = spark.createDataFrame([(1, json.dumps(good).replace("text", "painting"))], "slide int, json string")
    with pytest.raises(Exception, match="unknown category"):
        artifacts.read_detections(bad, ["slide"]).collect()
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        artifacts.read_detections(spark.createDataFrame([(1, "{no")], "slide int, json string"), ["slide"]).collect()
    with pytest.raises(Exception, match="neither a list"):
        artifacts.read_expected(spark.createDataFrame([(1, '{"a": 1}')], "slide int, json string"), ["slide"]).collect()


def test_documents_through_files(spark, tmp_path):
    lines = [("a", None, [[0.0, 1.0]])]
    rows = [(s, i, "/p", f"b{i}", "t", None, None, lines) for s in (1, 2) for i in range(3)]
    results = spark.createDataFrame(rows, "slide int, ord int, image_path string, box_id string, text string, confidence double, language string, lines array<struct<text: string, confidence: double, bbox: array<array<double>>>>")
    documents = artifacts.result_documents(results, ["slide"], "ord", "portable", "ko+en", artifacts.pipeline_metadata("a", "b", "c"))
    artifacts.write_documents(documents, f"{tmp_path}/out", ["slide"])
    files = artifacts.read_files(spark, f"{tmp_path}/out/*/*.txt")
    back = artifacts.read_results(files.withColumn("slide", F.regexp_extract("path", r"slide=(\d+)", 1).cast("int")), ["slide"]).orderBy("slide", "result_ord").collect()
    assert [(b.slide, b.box_id, b.confidence, b.lines[0].text, b.lines[0].bbox) for b in back] == [(s, f"b{i}", None, "a", [[0.0, 1.0]]) for s in (1, 2) for i in range(3)]
    payload = json.loads(documents.first().json)
    assert payload["pipeline"] == {"detector_backend": "a", "ocr_backend": "b", "inpainting_backend": "c"} and payload["results"][0]["confidence"] is None and "python_version" in payload["runtime"]


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(masks.png(np.full((4, 7, 3), 9, np.uint8)))
    (tmp_path / "b.txt").write_text("no image")
    (row,) = decks.read_images(spark, str(tmp_path)).select("width_px", "height_px").collect()
    assert tuple(row) == (7, 4)


def test_uploads_must_be_known(spark):
    pages = spark.createDataFrame([("a.png", 0, 5, 6)], "path string, page_number int, width_px int, height_px int")
    for name, problem in (("x.doc", "unsupported"), ("y.pdf", "no pages")):
        with pytest.raises(Exception, match=problem):
            decks.expand_uploads(spark.createDataFrame([(1, 0, name)], "deck int, ord int, path string"), pages, ["deck"], "ord").collect()
    with pytest.raises(Exception, match="unsupported mode"):
        spark.range(1).select(decks.checked_mode(F.lit("fast"))).collect()


def deck(spark):
    style = "font_name string, font_size_pt double, color struct<r: int, g: int, b: int>, bold boolean, italic boolean, align string, word_wrap boolean"
    rows = [(1, n, k, f"t{k}", text, 10.0 * k, 5.0, 96.0, 48.0, "A&B", 12.5, (1, 2, 255), True, None, "right", False) for n in (1, 2) for k, text in enumerate(["same", "same", " <x> & \"y\"\n2", ""])]
    texts = spark.createDataFrame(rows, f"deck int, slide_no int, ord int, box_id string, text string, x double, y double, width double, height double, {style}")
    slides = spark.createDataFrame([(1, 1, 960, 540), (1, 2, 100, 100)], "deck int, slide_no int, width_px int, height_px int")
    image = bytearray(masks.png(np.zeros((2, 2, 3), np.uint8)))
    images = spark.createDataFrame([(1, 1, 0, "bg", 0.0, 0.0, 960.0, 540.0, image)], "deck int, slide_no int, ord int, box_id string, x double, y double, width double, height double, image binary")
    return slides, texts, images


def test_presentation_round_trip(spark):
    slides, texts, images = deck(spark)
    files = pptx.render(slides, texts, images, ["deck"])
    package = zipfile.ZipFile(io.BytesIO(files.first().content))
    assert package.testzip() is None and b'cx="9144000" cy="5143500"' in package.read("ppt/presentation.xml") and any(n.startswith("ppt/media/") for n in package.namelist())
    found = pptx.text_inventory(files, ["deck"])
    got = found.orderBy("slide_number", "shape_index").collect()
    assert [(g.slide_number, g.shape_index, g.text) for g in got] == [(1, 1, "same"), (1, 2, "same"), (1, 3, '<x> & "y"\n2'), (2, 0, "same"), (2, 1, "same"), (2, 2, '<x> & "y"\n2')]
    assert (got[0].width, got[0].font_name, got[0].font_size_pt, got[0].bold, got[0].italic, got[0].alignment, got[0].color_hex) == (914400, "A&B", 12.5, True, False, "r", "#0102FF")
    kinds = "deck int, slide_number int, shape_index int, current_text string, corrected_text string, approx_hex string, ord int"
    wanted = [(1, 1, None, "same", "first", None, 0), (1, 1, None, " same ", "second\nline", "#f7f7f7", 1), (1, 1, None, "same", "third", None, 2), (1, 2, 2, None, None, "00ff00", 0), (1, 2, 99, None, "x", None, 1), (1, 9, 0, None, "x", None, 0)]
    patches = pptx.resolve_patches(spark.createDataFrame(wanted, kinds), found, ["deck"], "ord")
    back = pptx.text_inventory(pptx.patch_files(files, patches, ["deck"], "ord"), ["deck"]).orderBy("slide_number", "shape_index").collect()
    assert [(b.text, b.color_hex, b.bold, b.font_size_pt, b.font_name, b.alignment) for b in back] == [
        ("first", "#0102FF", True, 12.5, "A&B", "r"),
        ("second\nline", "#F7F7F7", True, 12.5, "A&B", "r"),
        ('<x> & "y"\n2', "#0102FF", True, 12.5, "A&B", "r"),
        ("same", "#0102FF", True, 12.5, "A&B", "r"),
        ("same", "#0102FF", True, 12.5, "A&B", "r"),
        ('<x> & "y"\n2', "#00FF00", True, 12.5, "A&B", "r"),
    ]
    per_slide = pptx.render(slides.where("slide_no = 1"), texts.where("slide_no = 1"), images, ["deck", "slide_no"])
    assert pptx.text_inventory(per_slide, ["deck", "slide_no"]).count() == 3


def test_presets(spark):
    presets = jobs.preset_table(spark)
    installed = jobs.installed_presets(spark.createDataFrame([("/m/thai/manifest.json",), ("/m/greek/manifest.json",), ("/m/x/other.json",)], "path string"))
    flags = jobs.flag_presets(presets, installed, spark.createDataFrame([("thai",)], "preset_id string"))
    got = {f.preset_id: (f.installed, f.active, f.default) for f in flags.collect()}
    assert len(got) == 12 and got["thai"] == (True, True, False) and got["ko-en"] == (False, False, True)


def test_settings():
    assert jobs.Settings(inpainter="OpenCV").backend("inpainter") == "telea"
    with pytest.raises(ValueError, match="unsupported detector"):
        jobs.Settings(detector="magic").backend("detector")


def test_states_as_a_stream(spark, tmp_path):
    events = [(1, 1, "uploaded"), (1, 2, "completed"), (1, 3, "prepared"), (2, 1, "prepared"), (1, 4, "processing"), (2, 2, "uploaded")]
    spark.createDataFrame(events, "job int, ord int, state string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job int, ord int, state string").parquet(f"{tmp_path}/in")
    query = streams.follow_states(stream, "job", "ord").writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("states").collect())) == [(1, "processing", 1), (2, "uploaded", 1)]
    assert len(new := jobs.new_job_ids(spark.range(3)).collect()) == 3 and all(len(n.job_id) == 12 for n in new)


def test_slides_to_decks(spark, tmp_path):
    """Two slides of 1200 x 800 and 600 x 400: one size, boxes scaled, one font size, colours from the pixels."""
    box = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
    found = spark.createDataFrame([(1, n, "a", "text", 100.0, 100.0, 200.0, 60.0) for n in (1, 2)] + [(1, 1, "f", "figure", 0.0, 0.0, 9.0, 9.0), (1, 2, "b", "text", 10.0, 10.0, 50.0, 30.0)], "deck int, slide_no int, box_id string, category string, x double, y double, width double, height double")
    results = spark.createDataFrame([(1, 1, "a", 0, "old"), (1, 1, "a", 1, "x"), (1, 2, "a", 0, "y"), (1, 2, "b", 0, " a block ")], "deck int, slide_no int, box_id string, result_ord int, text string")
    lines = spark.createDataFrame([(1, n, "a", k, f"line {k}", box(100.0, 100.0 + 24 * k, 200.0, 22.0 - n)) for n in (1, 2) for k in (0, 1)], "deck int, slide_no int, box_id string, ord int, text string, bbox array<array<double>>")
    slides = spark.createDataFrame([(1, 1, 1200, 800), (1, 2, 600, 400)], "deck int, slide_no int, width_px int, height_px int")
    plan.text_placements(found, results, lines).coalesce(1).write.parquet(f"{tmp_path}/placements")
    placements = spark.read.parquet(f"{tmp_path}/placements")
    got = placements.orderBy("slide_no", "ord").collect()
    assert [(g.box_id, g.text, g.word_wrap) for g in got] == [("a:p01", "line 0\nline 1", False), ("b", "a block", True), ("a:p01", "line 0\nline 1", False)]
    pixels = {}
    for n, (w, h) in ((1, (1200, 800)), (2, (600, 400))):
        back = np.full((h, w, 3), 255, np.uint8)
        front = back.copy()
        front[100:150, 100:300] = (20, 58, 90 + n)
        pixels[n] = [(1, n, w, h, bytearray(a.tobytes())) for a in (front, back)]
    kind = "deck int, slide_no int, width_px int, height_px int, data binary"
    images, backs = (spark.createDataFrame([pixels[n][k] for n in (1, 2)], kind) for k in (0, 1))
    plan.color_placements(placements, images, backs).coalesce(1).write.parquet(f"{tmp_path}/colored")
    placements = spark.read.parquet(f"{tmp_path}/colored")
    colored = placements.orderBy("slide_no", "ord").collect()
    assert [tuple(c.color) for c in colored] == [(20, 58, 91), (0, 0, 0), (20, 58, 92)]
    files = plan.build_decks(slides, placements)
    files.write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    items = pptx.text_inventory(files, ["deck"]).orderBy("slide_number", "shape_index").collect()
    assert [(i.slide_number, i.left, i.top, i.color_hex) for i in items] == [(1, 952500, 952500, "#143A5B"), (2, 190500, 190500, "#000000"), (2, 1905000, 1905000, "#143A5C")]
    assert b'cx="11430000" cy="7620000"' in zipfile.ZipFile(io.BytesIO(files.first().content)).read("ppt/presentation.xml")


def test_uploads_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a b.PDF", "c.png", "d.txt"):
        (tmp_path / "in" / name).write_text("x")
    query = streams.watch_uploads(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("uploads").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((u.stored_name, u.kind, u.length) for u in spark.table("uploads").collect())[1:] == [("c.png", "image", 1), ("d.txt", "unknown", 1)]


def test_slides_are_looked_up_and_zipped(spark):
    slides = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "deck int, slide_no int, name string")
    assert decks.one_slide(slides, 2).first().name == "b"
    with pytest.raises(KeyError):
        decks.one_slide(slides, 3)
    specs = slides.select("deck", "slide_no", F.upper("name").alias("spec"))
    assert sorted(z.spec for z in decks.zip_slides(slides, specs, ["deck", "slide_no"]).collect()) == ["A", "B"]
    with pytest.raises(Exception, match="don't match"):
        decks.zip_slides(slides, specs.where("slide_no = 1"), ["deck", "slide_no"]).collect()
    with pytest.raises(Exception, match="no raster image"):
        spark.range(1).select(decks.raster_path(F.lit("x.pdf"))).collect()


def test_files_go_on_in_small_batches():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(950))], ["k"])
    cut = list(pptx.small([batch, batch.slice(0, 0), batch.slice(0, 3)]))
    assert max(b.num_rows for b in cut) <= pptx.FILES and [v for b in cut for v in b.column(0).to_pylist()] == [*range(950), 0, 1, 2]


def test_package_bytes(spark):
    """Archives are zipfile's, byte for byte, laid out by us or, if large, by zipfile; pictures keep their numbers."""
    slides, texts, images = deck(spark)
    content = bytes(pptx.render(slides, texts, images, ["deck"]).first().content)
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        parts = {name: package.read(name) for name in package.namelist()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as again:
        for name, data in parts.items():
            again.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    assert out.getvalue() == content
    assert b'Id="rId2"' in parts["ppt/slides/_rels/slide1.xml.rels"] and b'r:embed="rId2"' in parts["ppt/slides/slide1.xml"] and "ppt/media/image1-2.png" in parts


def test_large_packages(monkeypatch):
    slides = [{"xml": "<a/>", "images": [{"k": 2, "image": b"png"}]}, None]
    mine = pptx._package(1, 2, slides)
    monkeypatch.setattr(pptx, "ENTRIES", 0)
    assert pptx._package(1, 2, slides) == mine
