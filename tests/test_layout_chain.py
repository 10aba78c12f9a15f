"""Lines to paragraphs, font tokens, repairs, masks and reviews: known cases and brute force."""

import itertools
import json
import math
import random
import re
import zlib
from collections import defaultdict
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from slateflow.functions import geometry as G
from slateflow.operators import correction, layout, masks, review, typography

LINES = "slide string, ord int, text string, bbox array<array<double>>"


def box(x0, y0, x1, y1):
    return [[float(x0), float(y0)], [float(x1), float(y0)], [float(x1), float(y1)], [float(x0), float(y1)]]


# name -> lines (text, left, top, right, bottom), paragraphs in order
CASES = {
    "two rows": ([("Growth, Key Metrics", 280, 100, 560, 138), ("Accelerating", 100, 101, 260, 140), ("Outlook", 240, 148, 360, 186), ("& Strategic", 100, 146, 220, 187)], ["Accelerating Growth, Key Metrics\n& Strategic Outlook"]),
    "heights differ": ([("Revenue", 100, 100, 240, 138), ("2025", 252, 92, 330, 148)], ["Revenue", "2025"]),
    "drift": (
        [("스토리라인,카피,스타일,", 126.2, 1260.3, 522.9, 1317.9), ("근거(grounding)를JSON", 115.1, 1309.7, 535.4, 1367.3), ("파일로 구체화하여 정의한다.", 106.8, 1360.5, 547.9, 1409.8)],
        ["스토리라인,카피,스타일,\n근거(grounding)를JSON\n파일로 구체화하여 정의한다."],
    ),
    "borderline": (
        [("복원된", 2177.7, 1263.1, 2659.1, 1315.2), ("OCR로", 2194.4, 1315.2, 2641.0, 1360.5), ("배치하여 최종", 2305.4, 1357.7, 2528.7, 1412.6), ("PowerPoint", 2179.1, 1408.5, 2648.0, 1457.8)],
        ["복원된\nOCR로\n배치하여 최종\nPowerPoint"],
    ),
    "heading": (
        [("Engine + ONNX 엔진", 1141.6, 1190.4, 1591.0, 1252.1), ("이미지", 1162.4, 1264.5, 1567.4, 1315.2), ("환경에서", 1184.6, 1313.8, 1543.9, 1364.5), ("모델을", 1158.2, 1363.2, 1571.6, 1408.5), ("인식한다.", 1162.4, 1408.5, 1567.4, 1457.8)],
        ["Engine + ONNX 엔진", "이미지\n환경에서\n모델을\n인식한다."],
    ),
    "left offset": ([("Platform Overview", 90, 90, 350, 130), ("Manual OCR Hint", 210, 138, 410, 178)], ["Platform Overview\nManual OCR Hint"]),
    "gap": ([("슬라이드 이미지 생성", 634.0, 1104.0, 1060.0, 1168.5), ("Gemini+템플릿 렌더링", 632.5, 1190.4, 1061.1, 1249.4)], ["슬라이드 이미지 생성", "Gemini+템플릿 렌더링"]),
    "far apart": ([("Single Optical Sensor", 60, 120, 280, 164), ("Pulse Wave -> Features", 380, 122, 650, 166), ("BP Estimate", 760, 120, 930, 164)], ["Single Optical Sensor", "Pulse Wave -> Features", "BP Estimate"]),
    "columns": (
        [("One", 80, 100, 340, 146), ("Two", 620, 100, 1070, 148), ("Three", 1220, 102, 1510, 148), ("one", 80, 152, 332, 198), ("two", 760, 150, 940, 198), ("three", 1220, 154, 1526, 200)],
        ["One\none", "Two\ntwo", "Three\nthree"],
    ),
    "scrambled": ([("c", 1158.2, 1363.2, 1571.6, 1408.5), ("a", 1162.4, 1264.5, 1567.4, 1315.2), ("d", 1162.4, 1408.5, 1567.4, 1457.8), ("b", 1184.6, 1313.8, 1543.9, 1364.5)], ["a\nb\nc\nd"]),
    "list": ([("• one", 10, 10, 100, 30), ("2) two", 10, 32, 100, 52), ("more", 10, 54, 100, 74)], ["• one", "2) two\nmore"]),
    "blank": ([("  ", 10, 10, 100, 30)], []),
}


def test_known_layouts(spark):
    rows = [(name, i, t, box(*at)) for name, (found, _) in CASES.items() for i, (t, *at) in enumerate(found)] + [("no polygon", 0, "x", [])]
    segments = layout.line_segments(spark.createDataFrame(rows, LINES))
    got = defaultdict(list)
    for r in layout.typeset(segments, ["slide"], "ord").orderBy("slide", "number").collect():
        got[r.slide].append(r.text)
    assert dict(got) == {k: v for k, (_, v) in CASES.items() if v}
    detections = spark.createDataFrame([(k, 0.0, 0.0, 50.0, 60.0) for k in ("blank", "gap", "no result")], "slide string, x double, y double, width double, height double")
    results = spark.createDataFrame([("blank", " a block "), ("gap", "unused"), ("other", "x")], "slide string, text string")
    placed = layout.place(detections, results, segments, ["slide"], "ord").orderBy("slide", "number").collect()
    assert [(p.slide, p.text, p.word_wrap, p.language) for p in placed] == [("blank", "a block", True, "en"), ("gap", "슬라이드 이미지 생성", False, "ko"), ("gap", "Gemini+템플릿 렌더링", False, "ko")]
    assert placed[0].font_size_pt == 30.0


def brute_typeset(boxes):
    """Paragraphs (texts) of (x, y, width, height, text), stated step by step."""
    mid = lambda b: b[1] + b[3] / 2
    over = lambda a, b: max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))

    def rows_of(items):
        order = sorted(items, key=lambda b: (mid(b), b[0]))
        top, bottom = min(b[1] for b in order), max(b[1] + b[3] for b in order)
        if len(order) < 2 or bottom - top < 5:
            return [order]
        empty = [all(not b[1] <= top + k <= b[1] + b[3] for b in order) for k in range(round(bottom - top) + 1)]
        lines, k = [], 0
        for gap, run in itertools.groupby(empty):
            n = len(list(run))
            if gap:
                lines.append(top + (k + k + n - 1) / 2)
            k += n
        found = defaultdict(list)
        for b in order:
            found[sum(mid(b) > s for s in lines)].append(b)
        return [found[k] for k in sorted(found)]

    def union(items):
        x, y = min(b[0] for b in items), min(b[1] for b in items)
        return (x, y, max(b[0] + b[2] for b in items) - x, max(b[1] + b[3] for b in items) - y)

    merged = []
    for row in rows_of(boxes):
        line = []
        for b in sorted(row, key=lambda b: b[0]):
            if line:
                a = line[-1]
                low, high = sorted((a[3], b[3]))
                apart = over(a, b) >= min(a[2], b[2]) * 0.25 and abs(mid(a) - mid(b)) >= low * 0.35
                if any(q[3] > q[2] * 1.4 for q in (a, b)) or apart or high / max(1.0, low) > 1.15 or b[0] - a[0] - a[2] > max(24.0, low * 0.8):
                    merged.append(line)
                    line = []
            line.append(b)
        merged.append(line)
    lines = [(*union(g), " ".join(b[4] for b in g)) for g in merged]
    lines.sort(key=lambda b: (b[1], b[0]))
    numbers = layout.paragraph_numbers(*zip(*(b[:4] for b in lines)), [bool(re.match(r"- ", b[4])) for b in lines])
    groups = defaultdict(list)
    for n, b in zip(numbers, lines):
        groups[n].append(b)
    parts = []
    for n in sorted(groups):
        head, *body = groups[n]
        split = False
        if len(body) > 1:
            middle = median(b[3] for b in body)
            gaps = [b[1] - a[1] - a[3] for a, b in zip(body, body[1:])]
            room = max(8.0, middle * 0.18)
            split = head[3] / middle >= 1.18 and body[0][1] - head[1] - head[3] >= max(room, median(gaps) + 8) and over(head, body[0]) >= max(1.0, min(head[2], body[0][2])) * 0.35
            split = split and max(b[3] for b in body) / max(1.0, min(b[3] for b in body)) <= 1.22 and all(abs(g - median(gaps)) <= room for g in gaps)
        parts += [[head], body] if split else [groups[n]]
    out = []
    firsts = [(*p[0], i) for i, p in enumerate(parts)]
    for row in rows_of(firsts):
        out += ["\n".join(b[4] for b in parts[f[5]]) for f in sorted(row, key=lambda f: f[0])]
    return out


def test_typeset_equals_plain_python(spark):
    r = random.Random(12)
    slides = []
    for _ in range(250):
        columns, boxes = r.randint(1, 3), []
        for c in range(columns):
            y = r.randint(0, 40)
            for _ in range(r.randint(1, 5)):
                h = r.choice([12, 13, 14, 20, 22])
                for part in range(r.choice([1, 1, 2])):
                    boxes.append((float(c * 160 + part * 70 + r.randint(0, 9)), float(y + r.randint(0, 1)), float(r.choice([8, 40, 60])), float(h), r.choice(["- ", ""]) + f"w{len(boxes)}"))
                y += h + r.choice([1, 3, 9, 14, 30])
        slides.append(boxes)
    rows = [(s, i, *b) for s, boxes in enumerate(slides) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "slide int, ord int, x double, y double, width double, height double, text string")
    got = defaultdict(list)
    for t in layout.typeset(df, ["slide"], "ord").orderBy("slide", "number").collect():
        got[t.slide].append(t.text)
    assert [got[s] for s in range(len(slides))] == [brute_typeset(b) for b in slides]


def brute_tokens(sizes, counts, ratio):
    """The best of all divisions of the distinct sizes into runs."""
    pairs = sorted((s, n) for s, n in zip(sizes, counts) if s > 0)
    whole = [s for s, n in pairs for _ in range(n)]
    step = lambda v: math.floor(v / 0.5 + 0.5) * 0.5
    if not whole:
        return []
    for k in range(min(6, len(whole) // 2), 1, -1):
        best = None
        for cuts in itertools.combinations(range(1, len(pairs)), k - 1):
            runs = [[s for s, n in pairs[a:b] for _ in range(n)] for a, b in zip((0, *cuts), (*cuts, len(pairs)))]
            score = 0.0
            for low, high in zip(runs, runs[1:]):
                a, b = median(low), median(high)
                if b / max(a, 0.01) < ratio or step(a) == step(b):
                    score = -math.inf
                    break
                spread = max(low[-1] - low[0] + high[-1] - high[0], 0.5)
                score += b / max(a, 0.01) + high[0] / max(low[-1], 0.01) * 0.1 + (high[0] - low[-1]) / spread * 0.35 + min(len(low), len(high)) / max(len(low), len(high)) * 0.05
            if all(len(x) > 1 for x in runs) and score > -math.inf and (best is None or score > best[0] + 1e-12):
                best = (score, [step(median(x)) for x in runs])
        if best:
            return best[1]
    return [step(median(whole))]


@pytest.mark.parametrize("ratio", [1.15, 1.2])
def test_font_tokens_equal_every_division(ratio):
    r = random.Random(int(ratio * 100))
    for _ in range(150):
        sizes = r.sample([8 + k * 0.5 for k in range(60)], r.randint(0, 8))
        counts = [r.randint(1, 4) for _ in sizes]
        assert typography.partition_sizes(sizes, counts, ratio) == brute_tokens(sizes, counts, ratio), (sizes, counts)


def test_a_family_of_many_sizes_is_quick():
    sizes = [round(8 + k * 0.1, 1) for k in range(400)]
    assert len(typography.partition_sizes(sizes, [1000] * 400, 1.2)) == 6


def test_deck_fonts(spark):
    body, rows = "둘째 줄\nbody", []
    families = {"two": [20.6, 20.8], "three": [14.1, 14.2, 24.1, 24.2, 36.1, 36.2], "outlier": [20.0, 20.5, 11.0], "six": [v + d for v in (12, 16, 21, 27, 34, 42) for d in (0.1, 0.2)]}
    want = {"two": [20.5, 20.5], "three": [14.0, 14.0, 24.0, 24.0, 36.0, 36.0], "outlier": [20.0] * 3, "six": [float(v) for v in (12, 12, 16, 16, 21, 21, 27, 27, 34, 34, 42, 42)]}
    for deck, sizes in families.items():
        rows += [(deck, i, "Pretendard", body, float(s), True) for i, s in enumerate(sizes)]
    rows += [("labels", i, " ", t, s, True) for i, (t, s) in enumerate([("a", 29.6), ("b", 29.8), ("c", 13.6), ("d", 13.8), ("  ", 99.0)])]
    out = typography.normalize_fonts(spark.createDataFrame(rows, "deck string, ord int, font_name string, text string, font_size_pt double, auto_fit boolean"), "deck")
    got = defaultdict(list)
    for x in out.orderBy("deck", "ord").collect():
        got[x.deck].append(x.font_size_pt)
    assert dict(got) == want | {"labels": [29.5, 29.5, 13.5, 13.5, 99.0]}
    assert [x.auto_fit for x in out.where("deck = 'labels'").orderBy("ord").collect()] == [False] * 4 + [True]


def test_repair(spark):
    plan = {"slides": [{"slide_number": 1, "title": "Why cuffless blood pressure still matters", "subtitle": "1.4B adults live with hypertension", "on_slide_copy": ["1.4B with hypertension", "23% controlled"], "quantified_points": ["600 million unaware", " 23%  CONTROLLED "]}, {"slide_number": 1, "title": "later"}]}
    from slateflow.sources import artifacts

    plans = artifacts.read_plan(spark.createDataFrame([(7, json.dumps(plan))], "deck int, json string"), ["deck"])
    texts = correction.plan_texts(plans, ["deck"])
    assert [x.text for x in texts.orderBy("ordinal").collect()] == ["Why cuffless blood pressure still matters", "1.4B adults live with hypertension", "1.4B with hypertension", "23% controlled", "600 million unaware"]
    line = "struct<text: string, n: int>"
    results = [(7, 0, "Why cuffiess blood pressure still matters", [("Why cuffiess blood pressure still matters", 5)]), (7, 1, " ", []), (7, 2, "nothing like it", [("nothing", 1), ("like it", 2)]), (7, 3, "23% controled", [("23%", 1), ("controled", 2)])]
    df = spark.createDataFrame(results, f"deck int, ord int, text string, lines array<{line}>")
    got = correction.correct(df, texts, ["deck"], "ord", "ordinal", 0.7).orderBy("ord").collect()
    assert [(g.corrected_text, g.applied, [(x.text, x.n) for x in g.lines]) for g in got] == [
        ("Why cuffless blood pressure still matters", True, [("Why cuffless blood pressure still matters", 5)]),
        (" ", False, []),
        ("nothing like it", False, [("nothing", 1), ("like it", 2)]),
        ("23% controlled", True, []),
    ]
    assert got[1].expected_text is None and got[1].match_score == 0.0 and got[2].expected_text is not None


def test_masks(spark):
    rows = [("a", 200, 100, box(10, 20, 60, 40)), ("a", 200, 100, box(50, 30, 300, 200)), ("a", 200, 100, []), ("b", 200, 100, box(-50, -50, -10, -10))]
    lines = spark.createDataFrame(rows, "slide string, width_px int, height_px int, bbox array<array<double>>")
    found = masks.line_rectangles(lines, ["slide"], 0)
    want = np.zeros((100, 200), np.uint8)
    want[20:41, 10:61] = 255
    want[30:, 50:] = 255
    data = masks.mask_images(found, ["slide"]).where("slide = 'a'").first().mask
    at, body = 8, b""
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        body += data[at + 8 : at + 8 + n] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + n
    got = np.frombuffer(zlib.decompress(body), np.uint8).reshape(100, 201)
    assert (got[:, 0] == 0).all() and np.array_equal(got[:, 1:], want) and want[30, 30] == 255 and want[5, 5] == 0
    assert {x.slide: x.covered for x in masks.covered_pixels(found, ["slide"]).collect()} == {"a": int((want > 0).sum())} | ({"b": 0} if found.where("slide = 'b'").count() else {})


def test_covered_pixels_equal_counting(spark):
    r = random.Random(3)
    rows, want = [], {}
    for s in range(60):
        grid = np.zeros((40, 40), bool)
        for _ in range(r.randint(1, 8)):
            left, top = r.randint(0, 39), r.randint(0, 39)
            right, bottom = r.randint(left, 39), r.randint(top, 39)
            rows.append((s, left, top, right, bottom))
            grid[top : bottom + 1, left : right + 1] = True
        want[s] = int(grid.sum())
    got = masks.covered_pixels(spark.createDataFrame(rows, "slide int, left int, top int, right int, bottom int"), ["slide"])
    assert {x.slide: x.covered for x in got.collect()} == want


def test_geometry_edges(spark):
    one = lambda e: spark.range(1).select(e.alias("v")).first().v
    d = lambda *v: [F.lit(float(x)) for x in v]
    assert one(G.pixel_bounds(*d(-5.5, 2.5, 10, 4), F.lit(100), F.lit(50))).asDict() == {"left": 0, "top": 2, "right": 4, "bottom": 6}
    assert one(G.pixel_bounds(*d(1.9, 1.9, 10, 4), F.lit(100), F.lit(50), truncate=True)).asDict() == {"left": 1, "top": 1, "right": 12, "bottom": 6}
    assert one(G.pixel_bounds(*d(200, 1, 10, 4), F.lit(100), F.lit(50))) is None
    assert one(G.keep_inside(*d(90, -5, 500, 0.5, 100, 50))).asDict() == {"x": 0.0, "y": 0.0, "width": 100.0, "height": 1.0}
    assert one(G.placed_size(*d(10, 5, 2, -1, 11, 9))).asDict() == {"width": 12.0, "height": 9.0}
    line = F.struct(*(c.alias(n) for c, n in zip(d(0, 0, 10, 10), ("x", "y", "width", "height"))))
    assert one(G.meets(line, *d(10, 10, 5, 5))) and not one(G.meets(line, *d(10.1, 0, 5, 5)))
    assert one(G.bounds(F.array().cast("array<array<double>>"))) is None


def test_first_snapshot_stays(spark):
    old, new = spark.createDataFrame([(1, "a")], "slide int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "slide int, v string")
    assert sorted(map(tuple, review.first_snapshot(old, new, ["slide"]).collect())) == [(1, "a"), (2, "c")]


def test_rows_are_split_in_one_sort(spark):
    """A task holds its rows once, whatever windows look at them."""
    r = random.Random(11)
    boxes = spark.createDataFrame([(i % 7, i, 0.0, float(r.randint(0, 160)), 30.0, float(r.randint(10, 18))) for i in range(200)], "slide long, ord long, x double, y double, width double, height double")
    plan = layout.split_rows(boxes, ["slide"], "ord")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert len(re.findall(r"\bSort \[", plan)) == 1


def test_equal_masks_lie_together(spark):
    """Masks of many slides against painting each; equal ones come to the same tasks, in ranges that the keys divide."""
    r = random.Random(4)
    kinds = [[(r.randint(0, 30), r.randint(0, 10), r.randint(30, 39), r.randint(10, 19)) for _ in range(r.randint(1, 3))] for _ in range(5)]
    rows = [(s, 40, 20, *b) for s in range(300) for b in r.sample(kinds[min(4, s % 9)], len(kinds[min(4, s % 9)]))]
    rows += [(0, 40, 20, *kinds[0][0]), (999, 41, 20, *kinds[0][0])]
    table = spark.createDataFrame(rows, "slide int, width_px int, height_px int, left int, top int, right int, bottom int")
    out = masks.mask_images(table, ["slide"])
    want = {}
    for s, w, h, left, top, right, bottom in rows:
        want.setdefault(s, np.zeros((h, w), np.uint8))[top : bottom + 1, left : right + 1] = 255
    assert {q.slide: bytes(q.mask) for q in out.collect()} == {s: masks.png(m) for s, m in want.items()}
    assert "rangepartitioning(_same" in out._jdf.queryExecution().toString()


def test_paragraphs_of_many_detections():
    """All detections of a batch at once, against one row after another."""
    r = random.Random(3)
    found = []
    for _ in range(300):
        rows = sorted((float(r.randrange(0, 200, 5)), float(r.randrange(0, 100, 5)), float(r.randrange(80)), float(r.randrange(8, 14)), r.random() < 0.15) for _ in range(r.choice([0, 1, 2, 5, 20, 60])))
        found.append([(x, y, w, h, b) for y, x, w, h, b in rows])
    columns = [np.array(c) for c in zip(*(row for rows in found for row in rows))]
    want = [n for rows in found if rows for n in layout.paragraph_numbers(*zip(*rows))]
    assert layout.paragraph_numbers_of(np.array([len(rows) for rows in found]), *columns).tolist() == want
    assert layout.paragraph_numbers_of(np.array([], np.int64), *(np.zeros(0),) * 5).tolist() == []


def test_placing_works_paragraphs_out_once(spark):
    """Detections with paragraphs and without, from one pass over the lines; a blank result gives no block."""
    lines = spark.createDataFrame([("a", 0, " one ", box(0, 0, 50, 20)), ("a", 1, "two", box(0, 90, 50, 110)), ("b", 0, " ", box(0, 0, 9, 9)), ("c", 0, "x", []), ("x", 0, "stray", box(0, 0, 50, 20))], LINES)
    boxes = spark.createDataFrame([(s, 1.0, 2.0, 60.0, 30.0) for s in "abcde"], "slide string, x double, y double, width double, height double")
    results = spark.createDataFrame([("a", "r"), ("b", " block "), ("c", "\n"), ("d", None), ("x", "r")], "slide string, text string")
    out = layout.place(boxes, results, layout.line_segments(lines), ["slide"], "ord")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = sorted((r.slide, r.number, r.text, r.x, r.height, r.n_lines, r.word_wrap) for r in out.collect())
    assert got == [("a", 1, "one", 0.0, 20.0, 1, False), ("a", 2, "two", 0.0, 20.0, 1, False), ("b", 0, "block", 1.0, 30.0, 0, True)]


def test_gathered_fonts(spark):
    """A deck's fonts worked out in its row are those of the joins."""
    r = random.Random(7)
    texts = ["a", " ", "b\nc", "a text of some length, so a body", None]
    rows = [(d, i, r.choice(["F", "G", None]), r.choice(texts), r.choice([None, 0.0, 10.0, 10.4, 12.0, 14.5, 20.0, 31.0]), True) for d in "abc" for i in range(60)]
    placements = spark.createDataFrame(rows, "deck string, ord int, font_name string, text string, font_size_pt double, auto_fit boolean")
    got, want = (sorted(map(str, f(placements, "deck").select(*placements.columns).collect())) for f in (typography.gather_fonts, typography.normalize_fonts))
    assert got == want


def test_close_sizes_have_one_token(monkeypatch):
    """Families whose sizes lie closer than two tiers are settled by their median alone."""
    monkeypatch.setattr(typography, "_weighted_medians", None)
    for sizes, counts, want in (([10.0], [1], 10.0), ([11.3, 10.0, 10.8], [5, 2, 1], 11.5), ([10.0, 11.0], [3, 3], 10.5)):
        assert typography.partition_sizes(sizes, counts, 1.2) == [want]
