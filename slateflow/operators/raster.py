"""Pixels of slides: crops, recognition by a given runner, pixels of text, and filling of masks.

Images are rows (``keys``, width_px, height_px, data: RGB bytes, row by row). A task works on one image at a time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bounds, pixel_bounds
from ..functions.text import strip
from .color import DIFFERENT, LIGHTER, STRONG_LEAST, STRONG_SHARE
from .masks import png


#: A line of recognised text.
LINES = "array<struct<text: string, confidence: double, bbox: array<array<double>>>>"


def from_image_source(images: DataFrame, keys: list[str]) -> DataFrame:
    """RGB rows of Spark's image structs (BGR, one to four channels)."""

    def run(batches):
        for batch in batches:
            out = []
            for i in batch.column("image").to_pylist():
                data = np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"], i["nChannels"])
                out.append((np.repeat(data, 3, 2) if i["nChannels"] == 1 else data[:, :, 2::-1]).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("width_px"), batch.column("height_px"), pa.array(out, pa.binary())], [*keys, "width_px", "height_px", "data"])

    kinds = _kinds(images, keys)
    rows = images.select(*keys, F.col("image.width").alias("width_px"), F.col("image.height").alias("height_px"), "image")
    return rows.mapInArrow(run, f"{kinds}, width_px int, height_px int, data binary")


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _pixels(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def crops(images: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``boxes`` (left, top, right, bottom in pixels, and more) with their part of the slide's image as PNG."""
    own = [c for c in boxes.columns if c not in keys]
    grouped = boxes.groupBy(*keys).agg(F.collect_list(F.struct(*own)).alias("boxes"))
    rows = images.select(*keys, "width_px", "height_px", "data").join(grouped, keys)
    kinds = _kinds(images, keys) + ", boxes " + grouped.schema["boxes"].dataType.simpleString() + ", crops array<binary>"

    def run(batches):
        for batch in batches:
            out = []
            for data, width, height, found in zip(*(batch.column(c).to_pylist() for c in ("data", "width_px", "height_px", "boxes"))):
                image = _pixels(data, width, height)
                out.append([png(np.ascontiguousarray(image[b["top"] : b["bottom"], b["left"] : b["right"]])) for b in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("boxes"), pa.array(out, pa.list_(pa.binary()))], [*keys, "boxes", "crops"])

    found = rows.mapInArrow(run, kinds).select(*keys, F.explode(F.arrays_zip("boxes", "crops")).alias("z"))
    return found.select(*keys, "z.boxes.*", F.col("z.crops").alias("png"))


def recognise(images: DataFrame, detections: DataFrame, keys: list[str], runner: Callable[[], Callable[[np.ndarray], list]]) -> DataFrame:
    """Raw rows (``keys``, box_id, offset_x, offset_y, raw) of the text boxes of each slide.

    ``runner`` is called once per task and gives the function that recognises an image (BGR): a list of (polygon, text, score). A
    model is loaded there, so that it is loaded once. Boxes without pixels have no row.
    """
    d = lambda c: F.col(c).cast("double")
    boxes = detections.where(F.col("category") == "text").join(images.select(*keys, "width_px", "height_px"), keys)
    boxes = boxes.withColumn("_at", pixel_bounds(d("x"), d("y"), d("width"), d("height"), F.col("width_px"), F.col("height_px"))).where("_at is not null")
    grouped = boxes.groupBy(*keys).agg(F.collect_list(F.struct("box_id", "_at.*")).alias("boxes"))
    raw = "array<struct<polygon: array<array<double>>, text: string, score: double>>"
    found = f"array<struct<box_id: string, offset_x: int, offset_y: int, raw: {raw}>>"
    kind = pa.list_(pa.struct([("box_id", pa.string()), ("offset_x", pa.int32()), ("offset_y", pa.int32()), ("raw", pa.list_(pa.struct([("polygon", pa.list_(pa.list_(pa.float64()))), ("text", pa.string()), ("score", pa.float64())])))]))

    def run(batches):
        read = runner()
        for batch in batches:
            out = []
            for data, width, height, mine in zip(*(batch.column(c).to_pylist() for c in ("data", "width_px", "height_px", "boxes"))):
                image = _pixels(data, width, height)[:, :, ::-1]
                rows = ((b, read(image[b["top"] : b["bottom"], b["left"] : b["right"]]) or []) for b in mine)
                out.append([{"box_id": b["box_id"], "offset_x": b["left"], "offset_y": b["top"], "raw": [{"polygon": r[0], "text": str(r[1]), "score": r[2]} for r in raws if len(r) >= 3]} for b, raws in rows])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, kind)], [*keys, "found"])

    rows = images.select(*keys, "width_px", "height_px", "data").join(grouped, keys).mapInArrow(run, f"{_kinds(images, keys)}, found {found}")
    return rows.select(*keys, F.explode("found").alias("r")).select(*keys, "r.*")


def recognised_results(raw: DataFrame, language: str = "ko+en") -> DataFrame:
    """Results of raw rows: lines with a text, in the slide's coordinates, by the top, then the left; their text, and their mean score."""
    shifted = lambda p: F.transform(p, lambda q: F.array(q[0] + F.col("offset_x"), q[1] + F.col("offset_y")))
    lines = F.transform("raw", lambda r: F.struct(strip(r["text"]).alias("text"), r["score"].alias("confidence"), shifted(r["polygon"]).alias("bbox")))
    lines = F.filter(lines, lambda line: line["text"] != "")
    keyed = F.transform(lines, lambda line, i: F.struct(bounds(line["bbox"])["y"].alias("y"), bounds(line["bbox"])["x"].alias("x"), i.alias("i"), line.alias("line")))
    rows = raw.withColumn("lines", F.transform(F.array_sort(keyed), lambda k: k["line"]).cast(LINES))
    scores = F.filter(F.transform("lines", lambda line: line["confidence"]), lambda c: c.isNotNull())
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, c: a + c) / F.size(scores))
    text = F.array_join(F.transform("lines", lambda line: line["text"]), "\n")
    return rows.select(*(c for c in raw.columns if c not in ("raw", "offset_x", "offset_y")), text.alias("text"), "lines", F.lit(language).alias("language"), mean.alias("confidence"))


def inside(polygon: list[list[float]], left: int, top: int, width: int, height: int) -> np.ndarray:
    """Which pixels' centres of a window a polygon contains (or are on its upper left edge): crossings to the left, counted."""
    x, y = np.arange(left, left + width)[None, :], np.arange(top, top + height)[:, None]
    odd = np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if ay != by:
            odd ^= ((ay <= y) != (by <= y)) & (x >= ax + (y - ay) * (bx - ax) / (by - ay))
    return odd


def _lines_on_images(images: DataFrame, backgrounds: DataFrame, lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Images with their background of the same size and their lines' windows, for ``_windows``."""
    back = backgrounds.select(*keys, F.col("width_px").alias("_w"), F.col("height_px").alias("_h"), F.col("data").alias("back"))
    rows = images.select(*keys, "width_px", "height_px", "data").join(back, keys).where("width_px = _w and height_px = _h")
    boxed = lines.withColumn("_b", bounds(F.col("bbox"))).where("_b is not null").join(images.select(*keys, "width_px", "height_px"), keys)
    boxed = boxed.withColumn("_at", pixel_bounds(*(F.col(f"_b.{c}") for c in ("x", "y", "width", "height")), F.col("width_px"), F.col("height_px"), truncate=True)).where("_at is not null")
    grouped = boxed.groupBy(*keys).agg(F.collect_list(F.struct(F.col(line).alias("line"), "bbox", "_at.*")).alias("lines"))
    return rows.join(grouped, keys)


def _windows(batch: pa.RecordBatch):
    """Of each image its lines with their pixels, row by row: r, g, b of the slide and of the background."""
    for data, behind, width, height, mine in zip(*(batch.column(c).to_pylist() for c in ("data", "back", "width_px", "height_px", "lines"))):
        both = np.concatenate((_pixels(data, width, height), _pixels(behind, width, height)), axis=2)
        parts = []
        for n in mine:
            part = both[n["top"] : n["bottom"], n["left"] : n["right"]]
            if len(n["bbox"]) >= 3:
                part = part[inside(n["bbox"], n["left"], n["top"], part.shape[1], part.shape[0])]
            parts.append((n["line"], part.reshape(-1, 6)))
        yield parts


def line_pixels(images: DataFrame, backgrounds: DataFrame, lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Pixels (``keys``, ``line``, pixel, r, g, b, br, bg, bb) of each line's polygon, of the slide and of its background.

    Slides whose background is missing or of another size have none, nor have lines without pixels; polygons of less than three points count as their rectangle.
    """
    kind = lines.schema[line].dataType.simpleString()
    found = f"array<struct<line: {kind}, rgb: array<array<int>>>>"

    def run(batches):
        for batch in batches:
            line_kind = batch.schema.field("lines").type.value_type.field("line").type
            out_kind = pa.list_(pa.struct([("line", line_kind), ("rgb", pa.list_(pa.list_(pa.int32())))]))
            out = [[{"line": n, "rgb": part.tolist()} for n, part in parts] for parts in _windows(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, out_kind)], [*keys, "found"])

    rows = _lines_on_images(images, backgrounds, lines, keys, line).mapInArrow(run, f"{_kinds(images, keys)}, found {found}").select(*keys, F.explode("found").alias("f"))
    rows = rows.select(*keys, F.col("f.line").alias(line), F.posexplode("f.rgb").alias("pixel", "c"))
    return rows.select(*keys, line, "pixel", *(F.col("c")[i].cast("double").alias(n) for i, n in enumerate(("r", "g", "b", "br", "bg", "bb"))))


def line_colors(images: DataFrame, backgrounds: DataFrame, lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """``color.estimate_line_colors`` of ``line_pixels``, estimated where the image is: a row a line leaves the task, not a row a pixel."""
    kind = lines.schema[line].dataType.simpleString()
    found = f"array<struct<line: {kind}, r: int, g: int, b: int, support: bigint>>"

    def run(batches):
        for batch in batches:
            line_kind = batch.schema.field("lines").type.value_type.field("line").type
            out_kind = pa.list_(pa.struct([("line", line_kind), *((c, pa.int32()) for c in "rgb"), ("support", pa.int64())]))
            out = [[{"line": n, **estimate} for n, part in parts if (estimate := text_color(part))] for parts in _windows(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, out_kind)], [*keys, "found"])

    rows = _lines_on_images(images, backgrounds, lines, keys, line).mapInArrow(run, f"{_kinds(images, keys)}, found {found}").select(*keys, F.explode("found").alias("f"))
    return rows.select(*keys, F.col("f.line").alias(line), "f.r", "f.g", "f.b", "f.support")


def text_color(pixels: np.ndarray) -> dict | None:
    """Channel medians of a line's strongest text pixels, by the rules of ``color.text_pixels`` and ``color.strongest``; None without a text pixel."""
    own, back = pixels[:, :3].astype(float), pixels[:, 3:].astype(float)
    distance = np.sqrt(((own - back) ** 2).sum(axis=1))
    text = distance >= DIFFERENT
    own, back, distance = own[text], back[text], distance[text]
    if not len(own):
        return None
    light, under = (c[:, 0] * 0.299 + c[:, 1] * 0.587 + c[:, 2] * 0.114 for c in (own, back))
    delta = light - under
    lighter, darker = delta >= LIGHTER, delta <= -LIGHTER
    side = lighter if distance[lighter].sum() > distance[darker].sum() else darker if darker.any() else lighter if lighter.any() else slice(None)
    own, distance = own[side], distance[side]
    strong = own[np.argsort(-distance, kind="stable")[: max(STRONG_LEAST, math.ceil(len(own) * STRONG_SHARE))]]
    return {**{c: int(v) for c, v in zip("rgb", np.rint(np.median(strong, axis=0)))}, "support": len(strong)}


def fill(image: np.ndarray, mask: np.ndarray, radius: float = 3.0) -> np.ndarray:
    """An image whose masked pixels are filled from the rim inwards (fast marching, Telea 2004).

    Pixels are taken by their distance from the rim; each becomes the mean of the known ones within ``radius``, weighted by direction, nearness and level, and
    carried on along their gradient.
    """
    height, width = mask.shape
    out = image.astype(np.float64)
    known, far = ~mask.copy(), np.where(mask, np.inf, 0.0)
    r = int(np.ceil(radius))
    steps = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if 0 < dy * dy + dx * dx <= radius * radius]
    near = ((-1, 0), (1, 0), (0, -1), (0, 1))
    rim = [(0.0, int(y), int(x)) for y, x in np.argwhere(~mask) if any(0 <= y + dy < height and 0 <= x + dx < width and mask[y + dy, x + dx] for dy, dx in near)]
    heapq.heapify(rim)

    def slope(of: np.ndarray, y: int, x: int) -> np.ndarray:
        """Central differences over the known neighbours; one-sided or zero where there is none."""
        parts = []
        for dy, dx in ((1, 0), (0, 1)):
            ay, ax, by, bx = y + dy, x + dx, y - dy, x - dx
            a = ay < height and ax < width and known[ay, ax]
            b = by >= 0 and bx >= 0 and known[by, bx]
            parts.append((of[ay, ax] - of[by, bx]) / 2 if a and b else of[ay, ax] - of[y, x] if a else of[y, x] - of[by, bx] if b else 0.0 * of[y, x])
        return np.array(parts)

    def reach(y: int, x: int) -> float:
        """The distance at a pixel from those of its neighbours, as a front that moves at speed one."""
        a = min((far[y + d, x] for d in (-1, 1) if 0 <= y + d < height), default=np.inf)
        b = min((far[y, x + d] for d in (-1, 1) if 0 <= x + d < width), default=np.inf)
        low, high = min(a, b), max(a, b)
        return (a + b + np.sqrt(2 - (a - b) ** 2)) / 2 if high - low < 1 else low + 1

    while rim:
        d, y, x = heapq.heappop(rim)
        if d > far[y, x]:
            continue
        if not known[y, x]:
            toward = np.array([_difference(far, y, x, 0), _difference(far, y, x, 1)])
            total, weight = np.zeros(out.shape[2]), 0.0
            for dy, dx in steps:
                v, u = y + dy, x + dx
                if 0 <= v < height and 0 <= u < width and known[v, u]:
                    length = dy * dy + dx * dx
                    along = abs(dy * toward[0] + dx * toward[1]) / np.sqrt(length) or 1e-6
                    w = along / length / (1 + abs(far[v, u] - far[y, x]))
                    total += w * (out[v, u] - np.array([dy, dx]) @ slope(out, v, u).reshape(2, -1))
                    weight += w
            out[y, x] = np.clip(total / weight, 0, 255) if weight else out[y, x]
            known[y, x] = True
        for dy, dx in near:
            v, u = y + dy, x + dx
            if 0 <= v < height and 0 <= u < width and not known[v, u] and (t := reach(v, u)) < far[v, u]:
                far[v, u] = t
                heapq.heappush(rim, (t, v, u))
    return np.round(out).astype(np.uint8)


def _difference(far: np.ndarray, y: int, x: int, axis: int) -> float:
    a = far[min(y + 1, far.shape[0] - 1), x] if axis == 0 else far[y, min(x + 1, far.shape[1] - 1)]
    b = far[max(y - 1, 0), x] if axis == 0 else far[y, max(x - 1, 0)]
    return (a - b) / 2 if np.isfinite(a) and np.isfinite(b) else a - far[y, x] if np.isfinite(a) else far[y, x] - b if np.isfinite(b) else 0.0


def feathered(mask: np.ndarray, feather: int) -> np.ndarray:
    """1 inside the mask, falling off outside like a Gaussian of ``feather`` pixels."""
    alpha = mask.astype(np.float64)
    if feather:
        kernel = np.exp(-0.5 * (np.arange(-3 * feather, 3 * feather + 1) / feather) ** 2)
        kernel /= kernel.sum()
        blurred = np.pad(alpha, 3 * feather, mode="edge")
        for axis in (0, 1):
            blurred = np.apply_along_axis(np.convolve, axis, blurred, kernel, "valid")
        alpha = np.maximum(alpha, blurred)
    return alpha


def inpaint(images: DataFrame, rectangles: DataFrame, keys: list[str], radius: float = 3.0, feather: int = 2) -> DataFrame:
    """Images whose rectangles (left, top, right, bottom, edges included) are filled from around them; others stay as they are."""
    grouped = rectangles.groupBy(*keys).agg(F.collect_list(F.struct("left", "top", "right", "bottom")).alias("boxes"))
    rows = images.select(*keys, "width_px", "height_px", "data").join(grouped, keys, "left")

    def filled(data: bytes, width: int, height: int, boxes: list[dict] | None) -> bytes:
        mask = np.zeros((height, width), bool)
        for b in boxes or []:
            mask[b["top"] : b["bottom"] + 1, b["left"] : b["right"] + 1] = True
        if not mask.any():
            return data
        image = _pixels(data, width, height)
        alpha = feathered(mask, feather)[:, :, None]
        return (image * (1 - alpha) + fill(image, mask, radius) * alpha).clip(0, 255).astype(np.uint8).tobytes()

    def run(batches):
        for batch in batches:
            out = [filled(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("data", "width_px", "height_px", "boxes")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("width_px"), batch.column("height_px"), pa.array(out, pa.binary())], [*keys, "width_px", "height_px", "data"])

    return rows.mapInArrow(run, f"{_kinds(images, keys)}, width_px int, height_px int, data binary")


def review_backgrounds(images: DataFrame, text: DataFrame, figures: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Images without text, from which figures are cropped, and images without text and figures."""
    clear = inpaint(images, text, keys)
    return clear, inpaint(clear, figures, keys)


def as_png(images: DataFrame, keys: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [png(_pixels(*row)) for row in zip(*(batch.column(c).to_pylist() for c in ("data", "width_px", "height_px")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.binary())], [*keys, "png"])

    return images.select(*keys, "width_px", "height_px", "data").mapInArrow(run, f"{_kinds(images, keys)}, png binary")


