"""Layout, matching, typography and colour operators against plain statements of their rules."""

import math
import random
import re
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from slateflow.functions import geometry, text
from slateflow.operators import correction, color, layout, matching, typography
from slateflow.plans import catalogue


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize("s,want", [("한글 title", True), ("English title", False)])
def test_korean(spark, s, want):
    assert one(spark, text.has_korean(F.lit(s))) is want


def test_conversions(spark):
    assert one(spark, geometry.px_to_emu(F.lit(96.0))) == 914400 and one(spark, geometry.px_to_pt(F.lit(96.0))) == 72
    assert one(spark, geometry.font_step(F.lit(20.8))) == 21.0 and one(spark, geometry.font_step(F.lit(20.7))) == 20.5


def test_clean_and_keys(spark):
    assert one(spark, text.clean(F.lit(" a\n\n\xa0b "))) == "a b"
    assert one(spark, text.match_key(F.lit("Straße, 12.5% É!"))) == "strasse 12.5% é"
    assert one(spark, text.upload_kind(F.lit("a/B.PDF"))) == "pdf" and one(spark, text.file_stem(F.lit("??"))) == "upload"


def brute_rows(boxes):
    """Rows by the scan lines themselves."""
    top, bottom = min(b[1] for b in boxes), max(b[1] + b[3] for b in boxes)
    if len(boxes) <= 1 or bottom - top < 5:
        return [1] * len(boxes)
    n = round(bottom - top)
    empty = [not any(y <= top + k <= y + h for _, y, _, h in boxes) for k in range(n + 1)]
    seps, k = [], 0
    while k <= n:
        if empty[k]:
            j = k
            while j + 1 <= n and empty[j + 1]:
                j += 1
            seps.append((top + k + top + j) / 2)
            k = j
        k += 1
    passed = [sum(y + h / 2 > s for s in seps) for _, y, _, h in boxes]
    return [sorted(set(passed)).index(p) + 1 for p in passed]


def test_row_split_equals_scan(spark):
    r = random.Random(4)
    groups = [[(float(r.randint(0, 50)), float(r.randint(0, 60)), 5.0, float(r.randint(1, 9))) for _ in range(r.randint(1, 7))] for _ in range(300)]
    rows = [(g, i, *b) for g, boxes in enumerate(groups) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "slide long, ord int, x double, y double, width double, height double")
    got = defaultdict(dict)
    for q in layout.split_rows(df, ["slide"], "ord").collect():
        got[q.slide][q.ord] = q.row_no
    assert [[got[g][i] for i in range(len(b))] for g, b in enumerate(groups)] == [brute_rows(b) for b in groups]


def test_paragraphs(spark):
    rows = [(1, 0, 0.0, 0.0, 100.0, 20.0, "a"), (1, 1, 0.0, 23.0, 100.0, 20.0, "b"), (1, 2, 0.0, 90.0, 100.0, 20.0, "c"), (1, 3, 0.0, 112.0, 100.0, 20.0, "- d")]
    df = spark.createDataFrame(rows, "slide long, ord int, x double, y double, width double, height double, text string")
    assert [r.paragraph_no for r in layout.merge_paragraphs(df, ["slide"], "ord").orderBy("ord").collect()] == [1, 1, 2, 3]


def test_exclusive_assignment_equals_loop(spark):
    r = random.Random(2)
    rows = [(g, i, c, r.choice([0.0, 0.2, 0.4, 0.5, 0.9])) for g in range(20) for i in range(6) for c in range(5)]
    df = spark.createDataFrame(rows, "g long, row long, cand long, score double")
    want = {}
    for g in range(20):
        used = set()
        for i in range(6):
            left = [(-s, c) for a, b, c, s in rows if (a, b) == (g, i) and c not in used and s > 0]
            loss, cand = min(left, default=(0.0, None))
            applied = -loss >= 0.4 and cand is not None
            if applied:
                used.add(cand)
            want[g, i] = (cand, -loss, applied)
    got = {(q.g, q.row): (q.cand, q.score, q.applied) for q in matching.assign_exclusively(df, ["g"], "row", "cand", "score", 0.4).collect()}
    assert got == {k: (c, s + 0.0, a) for k, (c, s, a) in want.items()}


def test_nearest_token_ties_to_the_smaller(spark):
    assert one(spark, typography.nearest_token(F.lit(11.0), F.array(F.lit(12.0), F.lit(10.0)))) == 10.0


def test_palette(spark):
    rows = [(1, 0, 18.0, 58.0, 90.0, 5), (1, 1, 26.0, 66.0, 98.0, 5), (1, 2, 240.0, 130.0, 20.0, 5)]
    df = spark.createDataFrame(rows, "slide long, ord int, r double, g double, b double, support int")
    assert [r.cluster_no for r in color.palette_clusters(df, ["slide"], "ord").orderBy("ord").collect()] == [1, 1, 2]
    palette = spark.createDataFrame([(1, 1, 22.0, 62.0, 94.0), (2, 1, 240.0, 130.0, 20.0)], "slide long, token int, pr double, pg double, pb double")
    assert [r.snapped for r in color.snap_to_palette(df, palette, ["slide"]).orderBy("ord").collect()] == [1, 1, None]
    got = color.normalize_colors(df, ["slide"], "ord").orderBy("ord").collect()
    assert [(r.r, r.g, r.b) for r in got] == [(22.0, 62.0, 94.0)] * 2 + [(240.0, 130.0, 20.0)]


def test_language_and_math(spark):
    assert one(spark, text.language(F.lit("가"))) == "ko"
    assert math.isclose(one(spark, geometry.luminance(F.lit(10.0), F.lit(20.0), F.lit(30.0))), 18.15)


def key_of(t):
    return " ".join(re.sub(r"[^\w\s%./:+-]", "", " ".join((t or "").lower().split())).split())


def similarity_of(a, b):
    from difflib import SequenceMatcher

    if not a or not b:
        return 0.0, 0.0
    x, y, inside = set(a.split()), set(b.split()), 0.05 * (a in b or b in a)
    shared = len(x & y) / max(len(x), len(y))
    digits = [re.findall(r"\d+(?:\.\d+)?", t) for t in (a, b)]
    mixed = min(1.0, SequenceMatcher(None, a, b).ratio() * 0.7 + shared * 0.3 + 0.08 * (digits[0] == digits[1] != []) + inside)
    return (1.0 if a == b else mixed), shared + inside


def test_every_turn_meets_every_item(spark, tmp_path):
    r = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "bcdfg" for b in ("an", "or", "ee", "12", "3.5")]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 80)))) for i in range(23)] + [(40, "ore"), (41, "--"), (42, ""), (43, None)]
    turns = [(c, t, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60)))) for c in range(9) for t in range(r.randint(1, 5))]
    # quotes of items of other residues and in later turns, an item inside a word, texts that share no word with any, and none
    turns += [(30, 0, items[7][1]), (30, 1, items[7][1]), (30, 2, items[3][1] + ", Bee!"), (31, 0, "xorey"), (31, 1, "zzz"), (31, 2, "an orr"), (32, 1, ""), (32, 3, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    score = {(c, t, i): similarity_of(key_of(x), key_of(y)) for c, t, x in turns for i, y in items}
    got = catalogue.QUERIES["fuzzy_candidates"](spark, str(tmp_path)).collect()
    assert len(got) == len(score)
    assert {(q.conv_id, q.turn, q.item_id): q.score for q in got} == pytest.approx({k: s for k, (s, _) in score.items()}, abs=2e-9)
    want, used = {}, defaultdict(set)
    for c, t, _ in sorted(turns, key=lambda x: x[:2]):
        loss, item = min(((-score[c, t, i][1], i) for i, _ in items if i not in used[c] and score[c, t, i][1] > 0), default=(0.0, None))
        want[c, t] = (item, pytest.approx(-loss, abs=2e-9), -loss >= 0.1)
        if -loss >= 0.1:
            used[c].add(item)
    got = {(q.conv_id, q.turn): (q.item_id, q.score, q.applied) for q in catalogue.QUERIES["exclusive_assignment"](spark, str(tmp_path)).collect()}
    assert got == want and got[30, 0] == (7, 1.05, True) and got[31, 1] == (None, 0.0, False)
    got = {(q.conv_id, q.turn, q.item_id): q.score for q in catalogue.QUERIES["token_overlap_join"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({k: s for k, (_, s) in score.items() if s > 0}, abs=2e-9)


def test_token_matches_equal_all_pairs(spark):
    """Few letters, so that short keys lie inside words and across their borders; astral characters, nulls and empty keys too."""
    r = random.Random(8)
    key = lambda: " ".join("".join(r.choice("ab\U0001d11e") for _ in range(r.randint(1, 6))) for _ in range(r.choice([1, 1, 2, 2, 3, 9])))
    said = [(1, i, key()) for i in range(70)] + [(2, 0, ""), (2, 1, None), (2, 2, "a" * 50_000)]
    wanted = [(i, key()) for i in range(60)] + [(90, ""), (91, None), (92, "a" * 40_000 + " b"), (93, "a" * 30_000)]
    a, b = spark.createDataFrame(said, "g long, row long, key string"), spark.createDataFrame(wanted, "item long, key string")
    shared = lambda x, y: len(set(x.split()) & set(y.split())) / max(len(set(x.split())), len(set(y.split())))
    want = {(g, i, j): shared(x, y) + 0.05 * (x in y or y in x) for g, i, x in said for j, y in wanted if x and y}
    df = matching.token_matches(a, b, ["g", "row"], ["item"])
    got = {(q.g, q.row, q.item): q.score for q in df.collect()}
    assert got == pytest.approx({k: s for k, s in want.items() if s > 0}) and min(got.values()) > 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "collect_list" not in plan


def noisy(r, text):
    """A text as it is read: characters lost, doubled or mistaken now and then."""
    return "".join(r.choice(["", c + c, "o"]) if r.random() < 0.04 else c for c in text)


def test_bounded_repair_equals_all_pairs(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("etaoinshrdlu0123가나") for _ in range(r.randint(1, 9)))
    said, wanted = [], []
    for slide in range(12):
        texts = [" ".join(word() for _ in range(r.choice([1, 3, 12, 60]))) for _ in range(r.randint(0, 7))]
        wanted += [(slide, i, t) for i, t in enumerate([*texts, *texts[:1], ""])]
        said += [(slide, i, noisy(r, t)) for i, t in enumerate([*r.sample(texts, len(texts)), *texts[:1], "", word()])]
    said += [(50, 0, "no texts here"), (50, 1, None)]
    a = spark.createDataFrame(said, "slide long, ord long, _key string").selectExpr("slide", "ord", "coalesce(_key, '') as _key")
    b = spark.createDataFrame(wanted, "slide long, item long, _key string")
    pairs = a.join(b.withColumnRenamed("_key", "_w"), "slide").select("slide", "ord", "item", text.similarity(F.col("_key"), F.col("_w")).alias("score")).where("score > 0")
    pairs = pairs.unionByName(a.selectExpr("slide", "ord", "cast(null as long) as item", "0.0D as score"))
    rows = lambda df: sorted((q.slide, q.ord, q.item, q.score, q.applied) for q in df.collect())
    want = rows(matching.assign_exclusively(pairs, ["slide"], "ord", "item", "score", 0.5))
    assert rows(correction.assign_similar(a, b, ["slide"], "ord", "item", 0.5)) == want and len(want) == len(said)


def test_bounds_spare_ratios():
    """A long slide read with mistakes: a tenth of the ratios of all pairs and fewer, the same choice."""
    r = random.Random(9)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    wanted = [" ".join("".join(r.choice(r.choice([letters, letters[:9]])) for _ in range(r.randint(2, 9))) for _ in range(r.randint(2, 30))) for _ in range(40)]
    said = [noisy(r, t) for t in r.sample(wanted, 40)]
    shared = lambda x, y: len(set(x.split()) & set(y.split())) / max(len(set(x.split())), len(set(y.split())))
    known = [[[shared(x, y) * 0.3, 0.05 * (x in y or y in x)] for y in wanted] for x in said]
    found, ratios = correction.choose(said, wanted, known, 0.5)
    used = set()
    for x, (at, score, applied), extra in zip(said, found, known):
        all_scores = [(-(1.0 if x == y else min(1.0, SequenceMatcher(None, x, y).ratio() * 0.7 + e[0] + e[1])), j) for j, (y, e) in enumerate(zip(wanted, extra)) if j not in used]
        assert (-score, at) == min(all_scores) and applied
        used.add(at)
    assert ratios <= len(said) * len(wanted) // 10
