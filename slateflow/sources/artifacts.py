"""Stage results as JSON documents, one per slide: readers to rows, and writers from rows.

A reader takes a DataFrame with a JSON column (from ``spark.read.text(..., wholetext=True)``, a table, or a stream), so that thousands of
documents parse in parallel; a writer returns one with a JSON column, one row per slide.
"""

from __future__ import annotations

import platform
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.correction import distinct_texts

#: What an element may be.
CATEGORIES = ("text", "figure", "table", "chart", "icon", "shape", "decoration")
_BOX = "box_id string, category string, label string, confidence double, x double, y double, width double, height double"
_LINE = "text string, confidence double, bbox array<array<double>>"
DETECTIONS = f"image_path string, slide_size struct<width_px: int, height_px: int>, backend string, detections array<struct<{_BOX}>>"
RESULTS = f"image_path string, backend string, language string, results array<struct<box_id string, text string, confidence double, language string, lines array<struct<{_LINE}>>>>"
PLAN = "slides array<struct<slide_number int, title string, subtitle string, on_slide_copy array<string>, quantified_points array<string>>>"
EDITS = "boxes array<struct<box_id string, x double, y double, width double, height double, category string, source string, source_box_id string>>"
IMAGES = "placements array<struct<box_id string, image_relpath string, x double, y double, width double, height double>>"
_ALL_FIELDS = {"ignoreNullFields": "false"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and json of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("json"))


def _parsed(json: Column, schema: str) -> Column:
    """A document that isn't JSON is an error, as is one without content."""
    return F.from_json(json, schema, {"mode": "FAILFAST"})


def read_detections(documents: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """Boxes in order (box_ord), with the slide's size; confidence is 1.0 unless given, an unknown category is an error."""
    rows = documents.select(*keys, _parsed(F.col(json), DETECTIONS).alias("d"))
    rows = rows.select(*keys, "d.slide_size.*", F.posexplode("d.detections").alias("box_ord", "b")).select(*keys, "width_px", "height_px", "box_ord", "b.*")
    known = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce("category", F.lit("none")))))
    return rows.withColumn("category", known).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def read_results(documents: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """Recognised results in order (result_ord), with their lines; text is empty unless given."""
    rows = documents.select(*keys, _parsed(F.col(json), RESULTS).alias("d"))
    rows = rows.select(*keys, F.posexplode("d.results").alias("result_ord", "r")).select(*keys, "result_ord", "r.*")
    nothing = F.array().cast("array<struct<text: string, confidence: double, bbox: array<array<double>>>>")
    return rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("lines", F.coalesce("lines", nothing))


def read_plan(documents: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """Deck plans: ``keys`` and their array of slides."""
    return documents.select(*keys, _parsed(F.col(json), PLAN).alias("d")).select(*keys, "d.slides")


def read_expected(documents: DataFrame, keys: list[str], content: str = "json", is_json: Column | None = None) -> DataFrame:
    """Distinct expected texts (``keys``, ordinal, text) of a list, of an object with ``texts``, or of the lines of plain text."""
    value = F.col(content)
    is_json = F.lit(True) if is_json is None else is_json
    listed, wrapped = F.from_json(value, "array<string>"), F.from_json(value, "texts array<string>")["texts"]
    kind = F.regexp_extract(value, r"^\s*([\[{]?)", 1)
    error = F.raise_error(F.lit("neither a list nor an object with texts")).cast("array<string>")
    texts = F.when(~is_json, F.split(value, r"\R")).when(kind == "[", listed).when((kind == "{") & wrapped.isNotNull(), wrapped).otherwise(error)
    return distinct_texts(documents.select(*keys, F.posexplode(texts).alias("ordinal", "text")), keys, "ordinal")


def read_edits(documents: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    return documents.select(*keys, F.posexplode(_parsed(F.col(json), EDITS)["boxes"]).alias("box_ord", "b")).select(*keys, "box_ord", "b.*")


def read_image_placements(documents: DataFrame, keys: list[str], files: DataFrame, json: str = "json") -> DataFrame:
    """Placements whose image is among ``files`` (image_relpath); others go."""
    rows = documents.select(*keys, F.posexplode(_parsed(F.col(json), IMAGES)["placements"]).alias("ord", "p")).select(*keys, "ord", "p.*")
    return rows.join(files.select("image_relpath").distinct(), "image_relpath", "left_semi")


def runtime_metadata() -> Column:
    found = {"platform": sys.platform, "system": platform.system(), "release": platform.release(), "machine": platform.machine(), "python_version": platform.python_version()}
    return F.create_map(*(F.lit(x) for pair in found.items() for x in pair))


def pipeline_metadata(detector: str, ocr: str, inpainting: str) -> Column:
    found = {"detector_backend": detector, "ocr_backend": ocr, "inpainting_backend": inpainting}
    return F.create_map(*(F.lit(x) for pair in found.items() for x in pair))


def _in_order(order: str, fields: list[str]) -> Column:
    """Aggregate: rows as an array of structs, in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order, F.struct(*fields).alias("row")))), lambda r: r["row"])


def _document(rows: DataFrame, keys: list[str], fields: dict[str, Column], pipeline: Column | None = None) -> DataFrame:
    """The pipeline is left out where there is none; other fields stay even if null."""
    parts = [c.alias(n) for n, c in fields.items()]
    if pipeline is not None:
        parts.append(pipeline.alias("pipeline"))
    return rows.select(*keys, F.to_json(F.struct(*parts), _ALL_FIELDS).alias("json"))


def detection_documents(boxes: DataFrame, keys: list[str], order: str, backend: str, pipeline: Column | None = None) -> DataFrame:
    """``boxes`` have image_path, width_px and height_px of their slide."""
    fields = ["box_id", "category", "label", "confidence", "x", "y", "width", "height"]
    rows = boxes.groupBy(*keys, "image_path", "width_px", "height_px").agg(_in_order(order, fields).alias("detections"))
    size = F.struct("width_px", "height_px")
    return _document(rows, keys, {"image_path": F.col("image_path"), "slide_size": size, "backend": F.lit(backend), "runtime": runtime_metadata(), "detections": F.col("detections")}, pipeline)


def result_documents(results: DataFrame, keys: list[str], order: str, backend: str, language: str, pipeline: Column | None = None) -> DataFrame:
    """``results`` have image_path of their slide, and lines (text, confidence, bbox)."""
    rows = results.groupBy(*keys, "image_path").agg(_in_order(order, ["box_id", "text", "confidence", "language", "lines"]).alias("results"))
    return _document(rows, keys, {"image_path": F.col("image_path"), "backend": F.lit(backend), "language": F.lit(language), "runtime": runtime_metadata(), "results": F.col("results")}, pipeline)


def correction_documents(corrections: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``corrections`` as of ``correct``, with box_id and ocr_json_path."""
    rows = corrections.withColumn("original_text", F.col("text"))
    done = F.transform(F.filter(F.sort_array(F.collect_list(F.struct(order, "expected_text", "applied"))), lambda r: r["expected_text"].isNotNull()), lambda r: r["expected_text"])
    rows = rows.groupBy(*keys, "ocr_json_path").agg(_in_order(order, ["box_id", "original_text", "corrected_text", "expected_text", "match_score", "applied"]).alias("corrections"), F.array_distinct(done).alias("expected_texts"))
    return _document(rows, keys, {c: F.col(c) for c in ("ocr_json_path", "expected_texts", "corrections")})


def edit_documents(boxes: DataFrame, keys: list[str], order: str) -> DataFrame:
    rows = boxes.groupBy(*keys).agg(_in_order(order, ["box_id", "x", "y", "width", "height", "category", "source", "source_box_id"]).alias("boxes"))
    return _document(rows, keys, {"boxes": F.col("boxes")})


def image_placement_documents(placements: DataFrame, keys: list[str], order: str) -> DataFrame:
    rows = placements.groupBy(*keys).agg(_in_order(order, ["box_id", "image_relpath", "x", "y", "width", "height"]).alias("placements"))
    return _document(rows, keys, {"placements": F.col("placements")})


def artifact_names(stem: Column) -> Column:
    """The files of a slide's artifacts."""
    return F.struct(*(F.concat(stem, F.lit(f".{end}")).alias(name) for name, end in (("detections_json", "detections.json"), ("ocr_json", "ocr.json"), ("mask_png", "mask.png"), ("background_png", "background.png"), ("result_pptx", "pptx"))))


def write_documents(documents: DataFrame, path: str, keys: list[str]) -> None:
    """One folder per slide, with its document as text."""
    documents.select(*keys, F.col("json").alias("value")).write.partitionBy(*keys).mode("overwrite").text(path)
