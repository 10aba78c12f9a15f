"""Crops, recognition, filled masks, text pixels, and texts measured with a font."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slateflow.operators import color, jobs, masks, raster
from slateflow.sources import decks, fonts, pptx

IMAGE = "slide int, width_px int, height_px int, data binary"


def image(spark, pixels, slide=1):
    return spark.createDataFrame([(slide, pixels.shape[1], pixels.shape[0], bytearray(pixels.tobytes()))], IMAGE)


def test_unmasked_pixels_stay_and_masked_ones_fill(spark):
    pixels = np.full((20, 40, 3), 32, np.uint8)
    pixels[5:15, 10:30] = 255
    boxes = spark.createDataFrame([(1, 10, 5, 29, 14)], "slide int, left int, top int, right int, bottom int")
    rows = image(spark, pixels).unionByName(image(spark, pixels, 2))
    got = {r.slide: np.frombuffer(r.data, np.uint8).reshape(20, 40, 3) for r in raster.inpaint(rows, boxes, ["slide"], feather=0).collect()}
    assert (got[1] == 32).all() and np.array_equal(got[2], pixels)
    slope = np.repeat(np.arange(0, 200, 5, dtype=np.uint8)[None, :, None], 20, 0).repeat(3, 2)
    mask = np.zeros((20, 40), bool)
    mask[6:14, 15:22] = True
    filled = raster.fill(np.where(mask[:, :, None], 255, slope).astype(np.uint8), mask)
    assert np.abs(filled.astype(int) - slope).max() <= 30 and np.array_equal(filled[~mask], slope[~mask])
    clear, bare = raster.review_backgrounds(rows, boxes, boxes.withColumn("slide", F.lit(2)), ["slide"])
    assert clear.count() == bare.count() == 2


def test_recognition_by_a_given_runner(spark):
    pixels = np.zeros((60, 80, 3), np.uint8)
    seen = "slide int, box_id string, category string, x double, y double, width double, height double"
    boxes = spark.createDataFrame([(1, "a", "text", 10.0, 20.0, 40.0, 30.0), (1, "b", "figure", 0.0, 0.0, 9.0, 9.0), (1, "c", "text", 500.0, 0.0, 9.0, 9.0)], seen)

    def runner():
        def read(part):
            assert part.shape == (30, 40, 3)
            return [([[2.0, 12.0], [18.0, 12.0], [18.0, 16.0], [2.0, 16.0]], " world ", 0.8), ([[1.0, 1.0], [9.0, 1.0], [9.0, 5.0], [1.0, 5.0]], "안녕", 0.9), ([[0.0, 0.0]], " ", 0.1), ["short"]]

        return read

    (got,) = raster.recognised_results(raster.recognise(image(spark, pixels), boxes, ["slide"], runner)).collect()
    assert (got.box_id, got.text, got.language) == ("a", "안녕\nworld", "ko+en") and got.confidence == pytest.approx(0.85)
    assert got.lines[0].bbox[0] == [11.0, 21.0] and got.lines[1].bbox[2] == [28.0, 36.0]


def test_line_colors_equal_the_pixels_way(spark):
    """Lighter, darker and mixed lines, lines that are their background, ties at the strongest pixels' border, slides without a background."""
    r = np.random.default_rng(3)
    fronts, backs, lines = [], [], []
    for slide in range(12):
        back = r.integers(0, 256, (30, 40, 3), dtype=np.uint8) if slide % 3 else np.full((30, 40, 3), 90, np.uint8)
        front = back.copy()
        front[5:25, 5:35] = np.clip(back[5:25, 5:35].astype(int) + r.choice([-60, -20, 0, 15, 21, 60], (20, 30, 1)), 0, 255)
        fronts.append((slide, 40, 30, bytearray(front.tobytes())))
        if slide != 7:
            backs.append((slide, 40, 30, bytearray(back.tobytes())))
        for line in range(6):
            x, y, w, h = (float(v) for v in (r.integers(0, 30), r.integers(0, 22), r.integers(1, 12), r.integers(1, 9)))
            polygon = [[x, y], [x + w, y + 1], [x + w, y + h], [x, y + h]]
            lines.append((slide, line, polygon[: 4 - 2 * (line == 3)]))
    lines += [(0, 6, [[0.0, 0.0], [3.0, 0.0], [3.0, 3.0], [0.0, 3.0]]), (0, 7, [])]
    a, b = spark.createDataFrame(fronts, IMAGE), spark.createDataFrame(backs, IMAGE)
    c = spark.createDataFrame(lines, "slide long, line int, bbox array<array<double>>")
    got = raster.line_colors(a, b, c, ["slide"], "line")
    want = color.estimate_line_colors(raster.line_pixels(a, b, c, ["slide"], "line"), ["slide", "line"], "pixel")
    rows = lambda df: sorted(tuple(q) for q in df.select("slide", "line", "r", "g", "b", "support").collect())
    assert rows(got) == rows(want) and len(rows(got)) > 40
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_colors_of_text(spark):
    """Lines of two near blues over white; what lies outside a line's polygon doesn't count."""
    back = np.full((60, 120, 3), 255, np.uint8)
    pixels = back.copy()
    pixels[5:20, 10:60], pixels[30:45, 10:60] = (18, 58, 90), (26, 66, 98)
    pixels[0:4], pixels[50:] = 0, 0
    lines = spark.createDataFrame([(1, 0, [[10.0, 5.0], [60.0, 5.0], [60.0, 20.0], [10.0, 20.0]]), (1, 1, [[10.0, 30.0], [60.0, 30.0], [60.0, 45.0], [10.0, 45.0]]), (1, 2, [[70.0, 5.0], [90.0, 5.0], [90.0, 9.0]]), (1, 3, [])], "slide int, line int, bbox array<array<double>>")
    found = raster.line_pixels(image(spark, pixels), image(spark, back), lines, ["slide"], "line")
    per_line = {r.line: (r.r, r.g, r.b) for r in color.estimate_line_colors(found, ["slide", "line"], "pixel").collect()}
    assert per_line == {0: (18, 58, 90), 1: (26, 66, 98)}
    (one,) = color.combine_colors(color.estimate_line_colors(found, ["slide", "line"], "pixel"), ["slide"]).collect()
    assert (one.r, one.g, one.b) == (22, 62, 94)
    other = image(spark, back[:30])
    assert raster.line_pixels(image(spark, pixels), other, lines, ["slide"], "line").count() == 0


def test_images_and_crops_through_files(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, (6, 9, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(masks.png(pixels))
    rows = raster.from_image_source(decks.read_images(spark, str(tmp_path)).withColumn("slide", F.lit(1)), ["slide"])
    assert rows.first().data == pixels.tobytes()
    boxes = spark.createDataFrame([(1, "x", 2, 1, 5, 4)], "slide int, box_id string, left int, top int, right int, bottom int")
    (crop,) = raster.crops(rows, boxes, ["slide"]).collect()
    assert crop.box_id == "x" and crop.png == masks.png(np.ascontiguousarray(pixels[1:4, 2:5]))
    assert raster.as_png(rows, ["slide"]).first().png == masks.png(pixels)


FOLDER = "/usr/share/fonts/truetype/dejavu"


@pytest.mark.skipif(not os.path.exists(f"{FOLDER}/DejaVuSans.ttf"), reason="no font at hand")
def test_texts_are_measured_with_their_font(spark):
    files = fonts.font_files(spark, [FOLDER, FOLDER]).where("path like '%DejaVuSans.ttf' or path like '%DejaVuSansMono.ttf'")
    table = fonts.font_advances(files)
    ems = {(r.path.rsplit("/", 1)[1], r.letter): r.advance for r in table.where("ascii(letter) < 128").collect()}
    assert ems["DejaVuSansMono.ttf", "i"] == ems["DejaVuSansMono.ttf", "W"] and ems["DejaVuSans.ttf", "i"] < ems["DejaVuSans.ttf", "W"]
    wanted = spark.createDataFrame([("Nothing", False), ("DejaVu Sans Mono", False)], "font_name string, korean boolean")
    paths = {r.font_name: r.path.rsplit("/", 1)[1] for r in fonts.find_fonts(wanted, files).collect()}
    assert paths == {"Nothing": "DejaVuSans.ttf", "DejaVu Sans Mono": "DejaVuSansMono.ttf"}
    path = files.where("path like '%Mono.ttf'").first().path
    rows = [(1, "wide\n\nwider", path, 300.0, 100.0), (2, "x" * 100, path, 50.0, 50.0), (3, "no font", None, 10.0, 60.0), (4, " ", path, 10.0, 60.0)]
    texts = spark.createDataFrame(rows, "id int, text string, path string, width double, height double")
    got = {m.id: m for m in fonts.measure(texts.where("path is not null"), table, ["id"]).collect()}
    em = ems["DejaVuSansMono.ttf", "x"]
    assert got[1].n_lines == 2 and got[1].em_width == pytest.approx(5 * em) and 4 not in got
    size = {r.id: r.font_size_pt for r in fonts.fit_texts(texts, table, ["id"]).collect()}
    px = round(size[1] * 96 / 72)
    high = got[1].em_height * 2 + 0.3
    assert px * high <= 100 and px * 5 * em <= 300 and ((px + 1) * high > 100 or (px + 1) * 5 * em > 300)
    assert (size[2], size[3], size[4]) == (10.0, 30.0, 10.0)


def test_patch_documents_and_records(spark, tmp_path):
    one, many = {"slide_number": 3, "mappings": [{"shape_index": 1, "corrected_text": "a"}]}, {"slides": [{"slide_number": 2, "mappings": [{"current_text": "x"}, {"current_text": "y"}]}]}
    docs = spark.createDataFrame([(1, json.dumps(one)), (2, json.dumps(many)), (3, json.dumps({"mappings": [{"shape_index": 0}]}))], "deck int, json string")
    got = [(p.deck, p.slide_number, p.ord, p.shape_index, p.current_text) for p in pptx.read_patches(docs, ["deck"]).orderBy("deck", "ord").collect()]
    assert got == [(1, 3, 0, 1, None), (2, 2, 0, None, "x"), (2, 2, 1, None, "y"), (3, 1, 0, 0, None)]
    assert {p.slide_number for p in pptx.read_patches(docs, ["deck"], slide_number=F.lit(9)).where("deck <> 2").collect()} == {9}
    records = spark.createDataFrame([("j1", "uploaded"), ("j2", "failed")], "job_id string, state string")
    jobs.save_records(records, f"{tmp_path}/jobs")
    jobs.save_records(records.where("job_id = 'j1'").withColumn("state", F.lit("prepared")), f"{tmp_path}/jobs")
    assert jobs.load_record(spark, f"{tmp_path}/jobs", "j1").first().state == "prepared" and jobs.load_record(spark, f"{tmp_path}/jobs", "j2").first().state == "failed"
    with pytest.raises(FileNotFoundError):
        jobs.load_record(spark, f"{tmp_path}/jobs", "j3")


def test_fitted_sizes_halve_in_batches(spark):
    """16 halvings against a plain loop, missing widths included; no interpreted loop is left in the plan."""
    r = random.Random(14)
    rows = [(i, None if i % 50 == 0 else r.uniform(0, 30), r.choice([1.0, 1.25, 1.7]), r.randint(1, 5), r.random() < 0.3, r.uniform(1, 900), r.uniform(1, 900)) for i in range(600)]

    def plain(em, tall, n, cjk, width, height):
        low, high, best = 10.0, max(44.0, height / n * 1.8 / 96 * 72.0), 10.0
        for _ in range(16):
            probe = (low + high) / 2
            px = max(1.0, float(round(probe * 96 / 72.0)))
            if em is not None and em * px <= width and n * tall * px + (n - 1) * (0.5 if cjk else 0.3) * px <= height:
                low = best = probe
            else:
                high = probe
        return best

    df = spark.createDataFrame(rows, "id long, em double, tall double, n int, cjk boolean, width double, height double")
    out = df.select("id", fonts.fit_size(*(F.col(c) for c in ("em", "tall", "n", "cjk", "width", "height"))).alias("size"))
    got = dict(out.collect())
    assert all(abs(got[i] - plain(*rest)) <= 0.0051 for i, *rest in rows) and len(set(got.values())) > 50
    assert "aggregate(" not in out._jdf.queryExecution().toString()
