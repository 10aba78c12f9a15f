"""Masks of text and figures: rectangles of whole pixels per slide, how much they cover, and the images they stand for."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bounds, pixel_bounds

#: Pixels by which a text mask is wider than its boxes.
PADDING = 2


def inclusive(x: Column, y: Column, width: Column, height: Column, width_px: Column, height_px: Column, padding: int = PADDING) -> Column:
    """left, top, right, bottom of a rectangle with both edges painted: rounded, padded and clipped to the last row and column of its slide; not all have pixels."""
    near = lambda c: F.bround(c.cast("double")).cast("int")
    right, bottom = F.least(width_px.cast("int") - 1, near(x + width) + padding), F.least(height_px.cast("int") - 1, near(y + height) + padding)
    return F.struct(F.greatest(F.lit(0), near(x) - padding).alias("left"), F.greatest(F.lit(0), near(y) - padding).alias("top"), right.alias("right"), bottom.alias("bottom"))


def within(r: Column, width_px: Column, height_px: Column) -> Column:
    """left, top, right, bottom as of ``pixel_bounds``, up to the last row and column of the slide."""
    return F.struct(r["left"].alias("left"), r["top"].alias("top"), F.least(r["right"], width_px.cast("int") - 1).alias("right"), F.least(r["bottom"], height_px.cast("int") - 1).alias("bottom"))


def _inclusive(rows: DataFrame, keys: list[str], padding: int) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    found = inclusive(*(d(c) for c in ("x", "y", "width", "height")), F.col("width_px"), F.col("height_px"), padding)
    rows = rows.select(*keys, "width_px", "height_px", found.alias("_r")).select(*keys, "width_px", "height_px", "_r.*")
    return rows.where("left <= right and top <= bottom")


def detection_rectangles(detections: DataFrame, keys: list[str], padding: int = PADDING) -> DataFrame:
    return _inclusive(detections.where(F.col("category") == "text"), keys, padding)


def line_rectangles(lines: DataFrame, keys: list[str], padding: int = PADDING) -> DataFrame:
    """Of recognised lines (bbox) the rectangle around their polygon."""
    rows = lines.withColumn("_b", bounds(F.col("bbox"))).where("_b is not null").select(*keys, "width_px", "height_px", "_b.*")
    return _inclusive(rows, keys, padding)


def figure_rectangles(boxes: DataFrame, keys: list[str], padding: int = 0) -> DataFrame:
    """Of figure boxes; those that have no pixels on the slide go."""
    d = lambda c: F.col(c).cast("double")
    rows = boxes.where(F.col("category") == "figure").withColumn("_b", pixel_bounds(d("x"), d("y"), d("width"), d("height"), F.col("width_px"), F.col("height_px"), padding))
    rows = rows.where("_b is not null").select(*keys, "width_px", "height_px", "_b.*")
    return rows.withColumn("right", F.least("right", F.col("width_px").cast("int") - 1)).withColumn("bottom", F.least("bottom", F.col("height_px").cast("int") - 1))


def text_rectangles(detections: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Of slides with any recognised line the lines' rectangles, of others the detections'."""
    by_line = line_rectangles(lines, keys)
    with_lines = lines.where(F.size("bbox") > 0).select(*keys).distinct()
    return by_line.unionByName(detection_rectangles(detections.join(with_lines, keys, "left_anti"), keys))


def covered_pixels(rectangles: DataFrame, keys: list[str]) -> DataFrame:
    """covered: pixels of each slide that any of its rectangles (edges included) covers.

    Columns at which a rectangle begins or ends cut a slide into strips; in a strip the rectangles that span it are vertical intervals, and what
    a running maximum of their ends has not reached is new.
    """
    edge = F.explode(F.array(F.col("left"), F.col("right") + 1))
    cuts = rectangles.select(*keys, edge.alias("at")).distinct()
    cuts = cuts.withColumn("to", F.lead("at").over(Window.partitionBy(*keys).orderBy("at"))).where("to is not null")
    strips = rectangles.select(*keys, "left", "right", "top", "bottom").join(cuts, keys).where("left <= at and right >= at")
    before = F.max("bottom").over(Window.partitionBy(*keys, "at").orderBy("top", "bottom").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("bottom") - F.greatest(F.col("top") - 1, F.coalesce(before, F.col("top") - 1)))
    rows = strips.withColumn("fresh", fresh.cast("long") * (F.col("to") - F.col("at")))
    return rows.groupBy(*keys).agg(F.sum("fresh").alias("covered"))


def with_content(slides: DataFrame, rectangles: DataFrame, keys: list[str]) -> DataFrame:
    """Slides whose mask covers a pixel; the others need no filling."""
    return slides.join(rectangles.select(*keys).distinct(), keys, "left_semi")


def _png(rows: np.ndarray, color: bool) -> bytes:
    """The PNG of rows of bytes that each begin with their filter."""
    height, width = rows.shape[0], (rows.shape[1] - 1) // (3 if color else 1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", width, height, 8, 2 if color else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def png(pixels: np.ndarray) -> bytes:
    """A grey or RGB image as PNG."""
    height = pixels.shape[0]
    return _png(np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)), axis=1), pixels.ndim == 3)


def mask_png(width: int, height: int, boxes: list[tuple[int, int, int, int]]) -> bytes:
    """White where a rectangle (left, top, right, bottom, edges included) is, painted where the file's rows are to lie."""
    rows = np.zeros((height, width + 1), np.uint8)
    for left, top, right, bottom in boxes:
        rows[top : bottom + 1, left + 1 : right + 2] = 255
    return _png(rows, False)


def mask_images(rectangles: DataFrame, keys: list[str]) -> DataFrame:
    """The mask of each slide as a PNG, white where a rectangle is; a slide's rectangles are what one row holds.

    Slides of the same size and rectangles lie together, and a mask that many of them have is drawn once in each task that has some:
    ranges of a hash and the keys spread it, however many slides have it.
    """
    sides = ("left", "top", "right", "bottom")
    slides = rectangles.groupBy(*keys, "width_px", "height_px").agg(F.array_sort(F.collect_set(F.struct(*sides))).alias("boxes"))
    same = F.xxhash64("width_px", "height_px", "boxes")
    # as many tasks as the shuffle has: rows are few bytes, and drawing them is what takes time
    width = int(rectangles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slides = slides.withColumn("_same", same).repartitionByRange(width, "_same", *keys).sortWithinPartitions("_same")
    kinds = ", ".join(f"`{k}` {rectangles.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        last = image = None
        for batch in batches:
            out, lists = [], batch.column("boxes")
            at, flat = lists.offsets.to_pylist(), lists.values
            places = list(zip(*(flat.field(c).to_pylist() for c in sides)))
            for width, height, a, b in zip(batch.column("width_px").to_pylist(), batch.column("height_px").to_pylist(), at, at[1:]):
                now = (width, height, places[a:b])
                if now != last:
                    last, image = now, mask_png(*now)
                out.append(image)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.binary())], [*keys, "mask"])

    return slides.mapInArrow(run, f"{kinds}, mask binary")
