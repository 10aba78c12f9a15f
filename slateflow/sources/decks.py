"""Uploads, images and pages as slides in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_stem, padded, strip, upload_kind

MODES = ("auto", "review")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width_px, height_px and image (Spark's image struct, BGR) of raster files; files that aren't images go."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width_px"), F.col("image.height").alias("height_px"), "image")


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def expand_uploads(uploads: DataFrame, pages: DataFrame, keys: list[str], order: str, path: str = "path") -> DataFrame:
    """Slides (slide_number, label, source_type, source_name, page_number, width_px, height_px) of uploads in order.

    An image is one slide; a PDF is as many as ``pages`` (path, page_number, width_px, height_px) has of it, in page order. An
    upload that is neither, or has no page, is an error. Images are in ``pages`` as page 0.
    """
    kind = upload_kind(F.col(path))
    known = F.when(kind != "unknown", kind).otherwise(F.raise_error(F.concat(F.lit("unsupported upload: "), F.col(path))))
    rows = uploads.select(*keys, order, path, known.alias("kind"))
    rows = rows.join(pages.select(F.col("path").alias(path), "page_number", "width_px", "height_px"), path, "left")
    missing = F.raise_error(F.concat(F.lit("no pages: "), F.col(path)))
    rows = rows.withColumn("page_number", F.when(F.col("page_number").isNull(), missing.cast("int")).otherwise(F.col("page_number")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "page_number"))
    label = F.concat(F.lit("slide-"), padded(number, 3))
    page = F.when(F.col("kind") == "pdf", F.col("page_number"))
    source_type = F.when(F.col("kind") == "pdf", "pdf_page").otherwise("image")
    return rows.select(*keys, number.alias("slide_number"), label.alias("label"), source_type.alias("source_type"), F.col(path).alias("source_name"), page.alias("page_number"), "width_px", "height_px")


def full_slide_boxes(slides: DataFrame, keys: list[str]) -> DataFrame:
    """One text box per slide that covers it."""
    constant = {"box_id": F.lit("t0001"), "category": F.lit("text"), "x": F.lit(0.0), "y": F.lit(0.0), "width": F.col("width_px").cast("double"), "height": F.col("height_px").cast("double")}
    return slides.select(*keys, *(c.alias(n) for n, c in constant.items()), F.lit(1.0).alias("confidence"), F.lit("full slide").alias("label"))


def deck_file_names(uploads: DataFrame, keys: list[str], order: str, name: str = "name", safe: bool = False) -> DataFrame:
    """file_name of each deck: its first PDF upload's stem, or a fixed name where there is none."""
    first = F.min(F.when(is_pdf(F.col(name)), F.struct(order, name)))[name]
    stem = strip(F.regexp_replace(F.regexp_extract(first, r"([^/]*)$", 1), r"(?i)\.pdf$", ""))
    stem = F.when(stem == "", "deck").otherwise(stem)
    stem = file_stem(stem) if safe else stem
    return uploads.groupBy(*keys).agg(F.when(first.isNotNull(), F.concat(stem, F.lit(".pptx"))).otherwise("deck.pptx").alias("file_name"))


def ingest(uploads: DataFrame, keys: list[str], order: str, name: str = "name") -> DataFrame:
    """Stored names (01-..., 02-...) and kinds of uploads; of a stream, number them by ``foreachBatch``."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return uploads.select("*", F.concat(padded(number, 2), F.lit("-"), file_stem(F.col(name))).alias("stored_name"), upload_kind(F.col(name)).alias("kind"))


def checked_mode(mode: Column) -> Column:
    return F.when(mode.isin(*MODES), mode).otherwise(F.raise_error(F.concat(F.lit("unsupported mode: "), mode)))


def raster_path(path: Column) -> Column:
    """The path, unless it is a PDF: operators on single images don't take those."""
    return F.when(is_pdf(path), F.raise_error(F.concat(F.lit("no raster image: "), path))).otherwise(path)


def one_slide(slides: DataFrame, number: int) -> DataFrame:
    """The slide of a number; a missing one is an error."""
    found = slides.where(F.col("slide_no") == number)
    if found.isEmpty():
        raise KeyError(f"no slide {number}")
    return found


def zip_slides(slides: DataFrame, specs: DataFrame, keys: list[str]) -> DataFrame:
    """Slides with what was made of them; a slide without it, or the other way round, is an error."""
    a, b = slides.withColumn("_a", F.lit(True)), specs.withColumn("_b", F.lit(True))
    both = F.when(F.col("_a") & F.col("_b"), True).otherwise(F.raise_error(F.lit("slides don't match")).cast("boolean"))
    rows = a.join(b, keys, "full").withColumn("_both", both)
    return rows.where("_both").drop("_a", "_b", "_both")
