"""The review loop: boxes that an editor moved, added or left, against what was recognised before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bounds, corners, keep_inside, meets, pixel_bounds
from ..functions.text import file_stem, has_text, padded, strip

#: Pixels by which an edited box is widened before its text is recognised again.
PADDING = 20.0
TEXT, FIGURE = "text", "figure"
_SIDES = ("x", "y", "width", "height")


def number_in_order(rows: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def editor_boxes(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Boxes line-001, line-002, ... of the recognised lines (text, bbox) that have a text and a polygon, with the line's own columns."""
    # the rectangles are worked out after the filter and the shuffle, once a line
    rows = lines.where(has_text(F.col("text")) & (F.size("bbox") > 0))
    rows = number_in_order(rows, keys, order, "_n").withColumn("_box", bounds(F.col("bbox")))
    box_id = F.concat(F.lit("line-"), padded(F.col("_n"), 3))
    return rows.select(*lines.columns, box_id.alias("box_id"), "_box.*", F.lit(TEXT).alias("category"), F.lit("base").alias("source"), box_id.alias("source_box_id"))


def editor_boxes_in_rows(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``keys`` and lines: ``editor_boxes`` where a slide is one row, in order, each with the columns of ``order``, box_id, rectangle, text and bbox."""
    rows = lines.where(has_text(F.col("text")) & (F.size("bbox") > 0))
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, "text", "bbox"))).alias("lines"))

    def with_box(r: Column, i: Column) -> Column:
        return F.struct(*(r[c].alias(c) for c in order), F.concat(F.lit("line-"), padded(i + 1, 3)).alias("box_id"), bounds(r["bbox"]).alias("at"), r["text"].alias("text"), r["bbox"].alias("bbox"))

    rows = rows.withColumn("lines", F.transform("lines", with_box))
    flat = lambda r: F.struct(*(r[c].alias(c) for c in (*order, "box_id")), *(r["at"][c].alias(c) for c in _SIDES), r["text"].alias("text"), r["bbox"].alias("bbox"))
    return rows.withColumn("lines", F.transform("lines", flat))


def _sanitized(of: Callable[[str], Column]) -> dict[str, Column]:
    least = lambda c: F.greatest(F.lit(1.0), of(c).cast("double"))
    return {
        "box_id": of("box_id").cast("string"),
        "x": of("x").cast("double"),
        "y": of("y").cast("double"),
        "width": least("width"),
        "height": least("height"),
        "category": F.when(of("category") == FIGURE, FIGURE).otherwise(TEXT),
        "source": F.when(of("source") != "", of("source")).otherwise("manual"),
        "source_box_id": F.when(of("source_box_id") != "", of("source_box_id")),
    }


def sanitize_boxes(boxes: DataFrame) -> DataFrame:
    """Edited boxes as they are kept: category figure or text, at least a pixel each way, source manual unless named, no empty source box."""
    new = _sanitized(F.col)
    return boxes.select(*(new[c].alias(c) if c in new else F.col(c) for c in boxes.columns))


def clamp_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes moved and cut so that they lie on their slide (slide_width, slide_height)."""
    d = lambda c: F.col(c).cast("double")
    rows = boxes.withColumn("_in", keep_inside(*(d(c) for c in ("x", "y", "width", "height", "slide_width", "slide_height"))))
    return rows.select(*(F.col(f"_in.{c}").alias(c) if c in ("x", "y", "width", "height") else F.col(c) for c in boxes.columns))


def compare_with_baseline(edited: DataFrame, baseline: DataFrame, keys: list[str], tolerance: float = 1.0) -> DataFrame:
    """Edited text boxes with change (new, kept or moved) and base, the baseline box they came from.

    A box comes from its source box if it names one, else from the baseline box of its own id. Kept boxes lie within ``tolerance`` pixels.
    """
    sides = ("x", "y", "width", "height")
    base = baseline.select(*keys, F.col("box_id").alias("_base"), *(F.col(c).alias(f"_{c}") for c in sides))
    rows = edited.where(F.col("category") == TEXT).withColumn("_base", F.coalesce("source_box_id", "box_id"))
    rows = rows.join(base.withColumn("_found", F.lit(True)), [*keys, "_base"], "left")
    near = F.lit(True)
    for c in sides:
        near = near & (F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance)
    change = F.when(F.col("_found").isNull(), "new").when(near, "kept").otherwise("moved")
    return rows.select(*edited.columns, change.alias("change"), F.when(F.col("_found"), F.col("_base")).alias("base"))


def boxes_to_read(compared: DataFrame) -> DataFrame:
    """New and moved boxes, widened for recognition."""
    wide = {"x": F.col("x") - PADDING, "y": F.col("y") - PADDING, "width": F.col("width") + 2 * PADDING, "height": F.col("height") + 2 * PADDING}
    return compared.where("change <> 'kept'").select(*(wide[c].alias(c) if c in wide else F.col(c) for c in compared.columns))


def rebuild_lines(compared: DataFrame, baseline: DataFrame, recognised: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The lines of edited slides, and the lines to be removed from their images: ``keys``, box_id, text, bbox.

    Kept boxes keep their baseline line. For others the lines that were recognised anew in them (``recognised``: ``keys``, box_id, text, bbox)
    and that touch the box are taken. Removed are baseline lines of kept and moved boxes, and the rectangles of new and moved ones.
    """
    base = baseline.select(*keys, F.col("box_id").alias("base"), F.col("text").alias("base_text"), F.col("bbox").alias("base_bbox"))
    known = compared.join(base, [*keys, "base"])
    line = [*keys, "box_id", F.col("base_text").alias("text"), F.col("base_bbox").alias("bbox")]
    anew = recognised.select(*keys, "box_id", F.col("text").alias("_text"), F.col("bbox").alias("_bbox")).withColumn("_line", bounds(F.col("_bbox")))
    anew = compared.where("change <> 'kept'").join(anew, [*keys, "box_id"])
    touches = meets(F.col("_line"), F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    anew = anew.where((strip(F.col("_text")) != "") & touches).select(*keys, "box_id", F.col("_text").alias("text"), F.col("_bbox").alias("bbox"))
    final = known.where("change = 'kept'").select(*line).unionByName(anew)
    own = compared.where("change <> 'kept'").select(*keys, "box_id", F.lit("").alias("text"), corners(*(F.col(c) for c in ("x", "y", "width", "height"))).alias("bbox"))
    return final, known.where("change <> 'new'").select(*line).unionByName(own)


def tagged_lines(compared: DataFrame, baseline: DataFrame, recognised: DataFrame, keys: list[str]) -> DataFrame:
    """What ``rebuild_lines`` gives, in one pass over the compared boxes: ``compared``'s columns with kind (kept, read or removed), text and bbox of each line."""
    base = baseline.select(*keys, F.col("box_id").alias("base"), F.struct("text", "bbox").alias("_was"))
    reads = recognised.groupBy(*keys, "box_id").agg(F.collect_list(F.struct("text", "bbox")).alias("_reads"))
    rows = compared.join(base, [*keys, "base"], "left").join(reads, [*keys, "box_id"], "left")
    line = lambda kind, text, bbox: F.struct(F.lit(kind).alias("kind"), text.alias("text"), bbox.alias("bbox"))
    was = lambda kind: line(kind, F.col("_was.text"), F.col("_was.bbox"))
    sides = [F.col(c) for c in ("x", "y", "width", "height")]
    touching = F.filter("_reads", lambda r: (strip(r["text"]) != "") & F.coalesce(meets(bounds(r["bbox"]), *sides), F.lit(False)))
    kept, new = F.col("change") == "kept", F.col("change") == "new"
    anew = F.concat(F.transform(F.coalesce(touching, F.array().cast(rows.schema["_reads"].dataType)), lambda r: line("read", r["text"], r["bbox"])), F.array(line("removed", F.lit(""), corners(*sides))))
    found = F.when(kept, F.array(was("kept"), was("removed"))).when(new, anew).otherwise(F.concat(anew, F.array(was("removed"))))
    return rows.withColumn("_line", F.explode(found)).select(*compared.columns, "_line.*")


def compare_in_rows(slides: DataFrame, size: tuple[Column, Column] | None = None, tolerance: float = 1.0) -> DataFrame:
    """``compare_with_baseline`` where a slide is one row: adds compared, its edited boxes with ``was`` (the baseline box) and change; null for figures.

    ``boxes`` (ord and what ``sanitize_boxes`` takes) are sanitized, and clamped to ``size`` if it is given. ``baseline`` has box_id, rectangle, text and bbox.
    """
    rows = slides.withColumn("_ids", F.col("baseline.box_id"))
    rows = rows.withColumn("compared", F.transform("boxes", lambda b: F.struct(b["ord"].alias("ord"), *(c.alias(n) for n, c in _sanitized(lambda n: b[n]).items()))))

    def with_base(b: Column) -> Column:
        sides = [b[c] for c in _SIDES]
        at = F.struct(*(c.alias(n) for n, c in zip(_SIDES, sides))) if size is None else keep_inside(*sides, *(c.cast("double") for c in size))
        place = F.array_position("_ids", F.coalesce(b["source_box_id"], b["box_id"])).cast("int") - 1
        own = (b[c].alias(c) for c in ("ord", "box_id", "category", "source", "source_box_id"))
        return F.struct(*own, at.alias("at"), F.when(b["category"] == TEXT, F.get("baseline", place)).alias("was"))

    def with_change(b: Column) -> Column:
        near = F.lit(True)
        for c in _SIDES:
            near = near & (F.abs(b["at"][c] - b["was"][c]) <= tolerance)
        change = F.when(b["category"] == TEXT, F.when(b["was"].isNull(), "new").when(near, "kept").otherwise("moved"))
        own = (b[c].alias(c) for c in ("category", "source", "source_box_id"))
        return F.struct(b["ord"].alias("ord"), b["box_id"].alias("box_id"), *(b["at"][c].alias(c) for c in _SIDES), *own, change.alias("change"), b["was"].alias("was"))

    rows = rows.withColumn("compared", F.transform("compared", with_base))
    return rows.withColumn("compared", F.transform("compared", with_change)).drop("_ids")


def compared_boxes(slides: DataFrame, columns: list[str]) -> DataFrame:
    """The text boxes of ``compare_in_rows``, a row each, with ``columns`` of their slides: what ``compare_with_baseline`` gives."""
    # the outer form, as for the other one Spark works the array out again to see whether it is empty
    rows = slides.select(*columns, F.explode_outer("compared").alias("b")).where("b.change is not null")
    return rows.select(*columns, *(f"b.{c}" for c in ("ord", "box_id", *_SIDES, "category", "source", "source_box_id", "change")), F.col("b.was.box_id").alias("base"))


def lines_in_rows(slides: DataFrame, recognised: DataFrame, keys: list[str]) -> DataFrame:
    """``rebuild_lines`` where a slide is one row of ``compare_in_rows``: adds tagged, an array of kind (kept, read or removed), ord, box_id, text, bbox and ``at``, its rectangle."""
    # reads lie by box, so that those of a box are a slice
    reads = recognised.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("box_id", "text", "bbox"))).alias("_reads"))
    rows = slides.join(reads, keys, "left")
    with_text = F.filter("_reads", lambda r: has_text(r["text"]))
    rows = rows.withColumn("_reads", F.transform(with_text, lambda r: F.struct(r["box_id"].alias("box_id"), r["text"].alias("text"), r["bbox"].alias("bbox"), bounds(r["bbox"]).alias("at"))))
    rows = rows.withColumn("_ids", F.col("_reads.box_id")).withColumn("_back", F.reverse("_ids"))

    def line(kind: str, b: Column, text: Column, bbox: Column, at: Column) -> Column:
        rectangle = F.struct(*(at[c].alias(c) for c in _SIDES))
        return F.struct(F.lit(kind).alias("kind"), b["ord"].alias("ord"), b["box_id"].alias("box_id"), text.alias("text"), bbox.alias("bbox"), rectangle.alias("at"))

    def lines(b: Column) -> Column:
        sides = [b[c] for c in _SIDES]
        x, y, width, height = sides
        was = lambda kind: line(kind, b, b["was"]["text"], b["was"]["bbox"], b["was"])
        first, last = F.array_position("_ids", b["box_id"]), F.size("_ids") + 1 - F.array_position("_back", b["box_id"])
        own = F.filter(F.slice("_reads", first.cast("int"), (last - first + 1).cast("int")), lambda r: F.coalesce(meets(r["at"], *sides), F.lit(False)))
        anew = F.transform(own, lambda r: line("read", b, r["text"], r["bbox"], r["at"]))
        gone = F.array(line("removed", b, F.lit(""), corners(*sides), {"x": x, "y": y, "width": x + width - x, "height": y + height - y}))
        gone = F.when(b["change"] == "new", gone).otherwise(F.concat(gone, F.array(was("removed"))))
        return F.when(b["change"] == "kept", F.array(was("kept"), was("removed"))).when(first > 0, F.concat(anew, gone)).otherwise(gone)

    rows = rows.withColumn("tagged", F.flatten(F.transform(F.filter("compared", lambda b: b["change"].isNotNull()), lines)))
    return rows.drop("_reads", "_ids", "_back")


def lines_in_reading_order(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add line_no: by the top, then the left of their polygons, ties as they came."""
    rows = lines.withColumn("_b", bounds(F.col("bbox")))
    return number_in_order(rows.withColumn("_y", F.col("_b.y")).withColumn("_x", F.col("_b.x")), keys, ["_y", "_x", *order], "line_no").select(*lines.columns, "line_no")


def crop_file(number: Column, box_id: Column) -> Column:
    return F.concat(padded(number, 3), F.lit("-"), file_stem(box_id), F.lit(".png"))


def figure_crops(boxes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Figure boxes in reading order, with the pixels to crop and the file to crop them to; boxes without pixels go, but keep their number."""
    figures = number_in_order(boxes.where(F.col("category") == FIGURE), keys, ["y", "x", *order])
    d = lambda c: F.col(c).cast("double")
    figures = figures.withColumn("bounds", pixel_bounds(d("x"), d("y"), d("width"), d("height"), F.col("slide_width"), F.col("slide_height"))).where("bounds is not null")
    return figures.select(*keys, "box_id", "number", "bounds.*", crop_file(F.col("number"), F.col("box_id")).alias("file"))


def as_detections(boxes: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Boxes as detections of one category."""
    return boxes.select(*keys, "box_id", F.lit(category).alias("category"), "x", "y", "width", "height", F.lit(1.0).alias("confidence"))


def first_snapshot(existing: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Baselines: those there are, and the current state of slides that have none; the first one written stays."""
    return existing.unionByName(current.join(existing.select(*keys).distinct(), keys, "left_anti"))
