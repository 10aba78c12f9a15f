"""Queries of stage documents, presentation files and jobs, with SQL that computes the same.

Documents and files are made from the given tables, written as the library writes them, and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import correction, jobs
from ..sources import artifacts, pptx
from .catalogue import BOXES, boxes, query, read

_CATEGORY = "CASE ord % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'figure' ELSE 'table' END"


def detections(spark, sf_dir: str) -> DataFrame:
    o = F.col("ord")
    return boxes(spark, sf_dir).select(
        "slide", F.struct("ord", "width").alias("place"), F.concat(F.lit("b"), o.cast("string")).alias("box_id"), F.when(o % 3 == 0, "text").when(o % 3 == 1, "figure").otherwise("table").alias("category"),
        F.when(o % 2 == 0, "a label").alias("label"), F.when(o % 4 != 0, (o % 100) / 100).alias("confidence"), "x", "y", "width", "height",
        F.concat(F.lit("/s/"), F.col("slide").cast("string")).alias("image_path"), F.lit(640).alias("width_px"), F.lit(180).alias("height_px"),
    )


@query(
    f"""WITH {BOXES} SELECT slide, CAST(row_number() OVER (PARTITION BY slide ORDER BY ord, width) - 1 AS INT) AS box_ord, 'b' || ord AS box_id, {_CATEGORY} AS category,
  CASE WHEN ord % 2 = 0 THEN 'a label' END AS label, CASE WHEN ord % 4 <> 0 THEN ord % 100 / 100 ELSE 1 END AS confidence, x, y, width, height, 640 AS width_px FROM b"""
)
def detection_documents(spark, sf_dir):
    documents = artifacts.detection_documents(detections(spark, sf_dir), ["slide"], "place", "full_slide", artifacts.pipeline_metadata("full_slide", "portable", "telea"))
    return artifacts.read_detections(documents, ["slide"]).select("slide", "box_ord", "box_id", "category", "label", "confidence", "x", "y", "width", "height", "width_px")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS result_ord, role || turn AS box_id, md5(coalesce(text, '')) AS text_md5, CASE WHEN turn % 2 = 0 THEN 'ko+en' END AS language, CAST(CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END AS INT) AS n_lines, CASE WHEN turn % 3 <> 0 THEN turn + 12.5 END AS \"right\" FROM conversations")
def result_documents(spark, sf_dir):
    t = F.col("turn").cast("double")
    line = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.lit(0.5).alias("confidence"), G.corners(t, t, F.lit(12.5), F.lit(3.0)).alias("bbox"))
    found = F.when(F.col("turn") % 3 != 0, F.array(line)).otherwise(F.slice(F.array(line), 1, 0))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.col("turn").cast("string")).alias("box_id"), "text", F.lit(None).cast("double").alias("confidence"), F.when(F.col("turn") % 2 == 0, "ko+en").alias("language"), found.alias("lines"), F.lit("/s").alias("image_path"))
    documents = artifacts.result_documents(rows, ["conv_id"], "turn", "portable", "ko+en")
    back = artifacts.read_results(documents, ["conv_id"])
    right = G.bounds(F.get("lines", F.lit(0))["bbox"])
    return back.select("conv_id", "result_ord", "box_id", F.md5("text").alias("text_md5"), "language", F.size("lines").alias("n_lines"), (right["x"] + right["width"]).alias("right"))


def plans(spark, sf_dir: str) -> DataFrame:
    """Each conversation as a deck plan: a slide per two turns, with their texts as title and copy."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("t"))
    entry = F.struct("turn", F.struct(F.floor(F.col("turn") / 2).cast("int").alias("slide_number"), F.col("t").alias("title"), F.array(F.col("t"), F.upper("t"), F.concat(F.lit("  "), F.lower(F.substring("t", 1, 9)), F.lit(" "))).alias("on_slide_copy")).alias("s"))
    slides = F.transform(F.sort_array(F.collect_list(entry)), lambda r: r["s"])
    return rows.groupBy("conv_id").agg(F.to_json(F.struct(slides.alias("slides"))).alias("json"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, turn // 2 AS s, substring(coalesce(text, ''), 1, 40) AS t FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY turn) AS k FROM t),
c AS (SELECT conv_id, s, 0 AS o, t FROM f WHERE k = 1 UNION ALL SELECT conv_id, s, 2, t FROM f WHERE k = 1 UNION ALL SELECT conv_id, s, 3, upper(t) FROM f WHERE k = 1 UNION ALL SELECT conv_id, s, 4, lower(substring(t, 1, 9)) FROM f WHERE k = 1),
n AS (SELECT conv_id, s, o, trim(regexp_replace(t, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+', ' ', 'g'), ' ') AS t FROM c),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, s, replace(lower(t), 'ß', 'ss') ORDER BY o) AS k FROM n WHERE t <> '')
SELECT conv_id, CAST(s AS INT) AS slide_number, CAST(o AS INT) AS ordinal, t AS text FROM d WHERE k = 1"""
)
def deck_plan_texts(spark, sf_dir):
    return correction.plan_texts(artifacts.read_plan(plans(spark, sf_dir), ["conv_id"]), ["conv_id"])


@query(
    r"""WITH t AS (SELECT item_id, item_id % 3 AS kind, coalesce(text, '') AS t FROM benchmark),
c AS (SELECT item_id, 0 AS o, t FROM t WHERE kind < 2 UNION ALL SELECT item_id, 1, 'second' FROM t WHERE kind < 2 UNION ALL SELECT item_id, 2, 'SECOND ' FROM t WHERE kind < 2
  UNION ALL SELECT item_id, 0, replace(t, chr(10), ' ') FROM t WHERE kind = 2 UNION ALL SELECT item_id, 2, 'last' FROM t WHERE kind = 2),
n AS (SELECT item_id, o, trim(regexp_replace(t, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+', ' ', 'g'), ' ') AS t FROM c),
d AS (SELECT *, row_number() OVER (PARTITION BY item_id, replace(lower(t), 'ß', 'ss') ORDER BY o) AS k FROM n WHERE t <> '')
SELECT item_id, CAST(o AS INT) AS ordinal, md5(t) AS text_md5 FROM d WHERE k = 1"""
)
def expected_text_files(spark, sf_dir):
    """A list, an object with texts, or plain lines, by item."""
    text = F.coalesce("text", F.lit(""))
    three = F.array(text, F.lit("second"), F.lit("SECOND "))
    kind = F.col("item_id") % 3
    content = F.when(kind == 0, F.to_json(three)).when(kind == 1, F.to_json(F.struct(three.alias("texts")))).otherwise(F.concat(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\n\nlast")))
    rows = read(spark, sf_dir, "benchmark").select("item_id", content.alias("json"))
    return artifacts.read_expected(rows, ["item_id"], is_json=kind != 2).select("item_id", "ordinal", F.md5("text").alias("text_md5"))


@query("SELECT o_custkey AS slide, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS n, 'c' || o_orderkey AS box_id, o_orderstatus AS original_text, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS corrected_text, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS expected_text, o_orderkey % 100 / 100 AS match_score, o_orderkey % 2 = 0 AS applied FROM orders")
def correction_documents(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("slide"), k.alias("ord"), F.concat(F.lit("c"), k.cast("string")).alias("box_id"), F.col("o_orderstatus").alias("text"), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("corrected_text"),
        F.when(k % 3 != 0, F.col("o_orderpriority")).alias("expected_text"), (k % 100 / 100).alias("match_score"), (k % 2 == 0).alias("applied"), F.lit("/o.json").alias("ocr_json_path"),
    )
    documents = artifacts.correction_documents(rows, ["slide"], "ord")
    kind = "corrections array<struct<box_id string, original_text string, corrected_text string, expected_text string, match_score double, applied boolean>>"
    return documents.select("slide", F.posexplode(F.from_json("json", kind)["corrections"]).alias("n", "c")).select("slide", "n", "c.*")


@query(
    f"""WITH {BOXES} SELECT slide, CAST(row_number() OVER (PARTITION BY slide ORDER BY ord, width) - 1 AS INT) AS box_ord, 'e' || ord AS box_id, x, width,
  CASE WHEN ord % 2 = 0 THEN 'figure' ELSE 'text' END AS category, CASE WHEN ord % 3 = 0 THEN 'e1' END AS source_box_id FROM b"""
)
def edit_documents(spark, sf_dir):
    o = F.col("ord")
    rows = boxes(spark, sf_dir).select("*", F.struct("ord", "width").alias("place"), F.concat(F.lit("e"), o.cast("string")).alias("box_id"), F.when(o % 2 == 0, "figure").otherwise("text").alias("category"), F.lit("manual").alias("source"), F.when(o % 3 == 0, "e1").alias("source_box_id"))
    documents = artifacts.edit_documents(rows, ["slide"], "place")
    return artifacts.read_edits(documents, ["slide"]).select("slide", "box_ord", "box_id", "x", "width", "category", "source_box_id")


@query(
    f"""WITH {BOXES}, e AS (SELECT slide, ord, x, width, CAST(row_number() OVER (PARTITION BY slide ORDER BY ord, width) - 1 AS INT) AS n FROM b)
SELECT slide, n AS ord, 'i' || ord AS box_id, 'crop-' || ord % 50 || '.png' AS image_relpath, x, width FROM e WHERE ord % 50 % 3 <> 0"""
)
def image_placement_documents(spark, sf_dir):
    """Placements whose image is missing go; every third crop is."""
    o = F.col("ord")
    name = F.concat(F.lit("crop-"), (o % 50).cast("string"), F.lit(".png"))
    rows = boxes(spark, sf_dir).select("*", F.struct("ord", "width").alias("place"), F.concat(F.lit("i"), o.cast("string")).alias("box_id"), name.alias("image_relpath"))
    files = rows.where("ord % 50 % 3 <> 0").select("image_relpath").distinct()
    documents = artifacts.image_placement_documents(rows, ["slide"], "place")
    return artifacts.read_image_placements(documents, ["slide"], files).select("slide", "ord", "box_id", "image_relpath", "x", "width")


@query("SELECT page_id, 's' || page_id || '.detections.json' AS detections_json, 's' || page_id || '.ocr.json' AS ocr_json, 's' || page_id || '.mask.png' AS mask_png, 's' || page_id || '.background.png' AS background_png, 's' || page_id || '.pptx' AS result_pptx FROM pages")
def artifact_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", artifacts.artifact_names(F.concat(F.lit("s"), F.col("page_id").cast("string"))).alias("a")).select("page_id", "a.*")


# ---- presentation files


def decks(spark, sf_dir: str) -> DataFrame:
    """Each conversation as a deck of one text per slide."""
    t = F.col("turn").cast("double")
    # XML can't hold control characters
    text = F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), r"[\x00-\x1f]", " ")
    rows = read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("slide_no"), F.col("turn").alias("ord"), F.col("role").alias("box_id"), F.concat(F.lit("a<&> "), text, F.lit("\nsecond")).alias("text"), (t * 10).alias("x"), (t * 5 + 0.5).alias("y"))
    color = F.struct((F.col("ord") % 256).cast("int").alias("r"), F.lit(18).alias("g"), F.lit(255).alias("b"))
    style = {"width": F.lit(300.0), "height": F.lit(40.0), "font_name": F.lit("Pretendard"), "font_size_pt": F.col("ord") % 9 + 12.5, "color": color, "bold": F.col("ord") % 2 == 0, "italic": F.lit(False), "align": F.when(F.col("ord") % 3 == 0, "Center").otherwise("justify"), "word_wrap": F.lit(True)}
    texts = rows.select("*", *(c.alias(n) for n, c in style.items()))
    slides = rows.select("conv_id", "slide_no", F.lit(640).alias("width_px"), F.lit(180).alias("height_px"))
    images = texts.where("false").select("conv_id", "slide_no", "ord", "box_id", "x", "y", "width", "height", F.lit(None).cast("binary").alias("image"))
    return pptx.render(slides, texts, images, ["conv_id"])


_DECK_TEXT = r"trim(regexp_replace(substring(coalesce(text, ''), 1, 60), '[\x00-\x1f]', ' ', 'g'))"
_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations"


@query(
    rf"""SELECT conv_id, CAST(n AS INT) AS slide_number, md5('a<&> ' || regexp_replace(substring(coalesce(text, ''), 1, 60), '[\x00-\x1f]', ' ', 'g') || chr(10) || 'second') AS text_md5, CAST(round_even(turn * 10 / 96 * 914400, 0) AS BIGINT) AS "left",
  CAST(round_even((turn * 5 + 0.5) / 96 * 914400, 0) AS BIGINT) AS top, 'Pretendard' AS font_name, turn % 9 + 12.5 AS font_size_pt, turn % 2 = 0 AS bold, CASE WHEN turn % 3 = 0 THEN 'ctr' ELSE 'l' END AS alignment, '#' || printf('%02X', CAST(turn % 256 AS INT)) || '12FF' AS color_hex FROM ({_NUMBERED})"""
)
def pptx_inventory(spark, sf_dir):
    """Decks rendered and taken stock of."""
    found = pptx.text_inventory(decks(spark, sf_dir), ["conv_id"])
    return found.select("conv_id", "slide_number", F.md5("text").alias("text_md5"), "left", "top", "font_name", "font_size_pt", "bold", "alignment", "color_hex")


@query(
    rf"""SELECT conv_id, CAST(n AS INT) AS slide_number, CASE WHEN n % 2 = 0 THEN md5('new & text') ELSE md5('a<&> ' || regexp_replace(substring(coalesce(text, ''), 1, 60), '[\x00-\x1f]', ' ', 'g') || chr(10) || 'second') END AS text_md5, turn % 9 + 12.5 AS font_size_pt, turn % 2 = 0 AS bold,
  CASE WHEN n % 2 = 0 THEN '#F7F7F7' ELSE '#' || printf('%02X', CAST(turn % 256 AS INT)) || '12FF' END AS color_hex FROM ({_NUMBERED})"""
)
def pptx_patched(spark, sf_dir):
    """Every second slide's text and colour replaced, found by its text; the style stays."""
    files = decks(spark, sf_dir)
    found = pptx.text_inventory(files, ["conv_id"])
    wanted = found.where("slide_number % 2 = 0").select("conv_id", "slide_number", F.lit(None).cast("int").alias("shape_index"), F.concat(F.lit(" "), "text").alias("current_text"), F.lit("new & text").alias("corrected_text"), F.lit("#f7f7f7").alias("approx_hex"), F.lit(1).alias("ord"))
    patches = pptx.resolve_patches(wanted, found, ["conv_id"], "ord")
    back = pptx.text_inventory(pptx.patch_files(files, patches, ["conv_id"], "ord"), ["conv_id"])
    return back.select("conv_id", "slide_number", F.md5("text").alias("text_md5"), "font_size_pt", "bold", "color_hex")


# ---- jobs

_STATES = ("uploaded", "prepared", "processing", "awaiting_review", "completed")
_SQL_ALLOWED = " OR ".join(f"(before = '{k}' AND state IN ({', '.join(repr(x) for x in v)}))" for k, v in jobs.TRANSITIONS.items() if v)


@query(
    f"""WITH s AS (SELECT user_id AS job, event_id, {list(_STATES)}[event_id % 5 + 1] AS state FROM events), b AS (SELECT *, lag(state) OVER (PARTITION BY job ORDER BY event_id) AS before FROM s)
SELECT job, event_id, state, before, CASE WHEN before IS NULL THEN state = 'uploaded' ELSE {_SQL_ALLOWED} END AS allowed FROM b"""
)
def job_transitions(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", state.alias("state"))
    return jobs.transitions(rows, "job", "event_id")


_PRESETS = list(jobs.PRESETS)


@query(
    f"""WITH r AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN {_PRESETS}[event_id % 12 + 1] END AS requested, CASE WHEN event_id % 3 = 0 THEN {_PRESETS}[event_id % 7 + 1] END AS active FROM events),
p AS (SELECT *, coalesce(requested, active) AS preset FROM r)
SELECT event_id, preset, CASE WHEN preset IN ('ko-en', 'english', 'thai', 'greek') THEN 'preset' WHEN preset IS NULL AND event_id % 2 = 0 THEN 'bundled' END AS source,
  CASE WHEN preset IN ('ko-en', 'english', 'thai', 'greek') OR (preset IS NULL AND event_id % 2 = 0) THEN NULL WHEN preset IS NOT NULL THEN 'not installed: ' || preset ELSE 'no models' END AS problem FROM p"""
)
def resolved_presets(spark, sf_dir):
    e = F.col("event_id")
    pick = lambda k: F.element_at(F.array(*map(F.lit, _PRESETS)), (e % k + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select("event_id", F.when(e % 4 == 0, pick(12)).alias("requested"), F.when(e % 3 == 0, pick(7)).alias("active"))
    installed = spark.createDataFrame([("ko-en",), ("english",), ("thai",), ("greek",)], "preset_id string")
    return jobs.resolve_presets(rows, installed, e % 2 == 0).select("event_id", "preset", "source", "problem")


@query("SELECT page_id, sha256(html) AS sha256, page_id % 3 = 0 AS verified FROM pages")
def verified_files(spark, sf_dir):
    """Contents against expected digests: a third are right, a third wrong, and a third unknown."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    want = pages.where("page_id % 3 <> 2").select("page_id", F.upper(F.when(F.col("page_id") % 3 == 0, F.sha2("content", 256)).otherwise(F.sha2(F.lit("x").cast("binary"), 256))).alias("sha256"))
    return jobs.verified(pages, want, "page_id").select("page_id", "sha256", "verified")
