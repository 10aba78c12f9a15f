"""Slides rebuilt from an editor's boxes, and the rebuilding of those slides alone that were edited.

A slide's state is one row: its size, the baseline lines, the latest edit, and what follows from them. Edits come as
documents (all boxes of a slide, with a revision); the latest counts, and a document that comes late or again changes
nothing. ``apply_edits`` recomputes the slides with newer documents and leaves the others' rows as they are;
``ReviewStore`` keeps the rows in buckets of slides, so that a batch reads and writes only the buckets it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import pixel_bounds
from ..functions.text import strip
from ..operators import masks, review

_BASELINE = "array<struct<box_id:string,x:double,y:double,width:double,height:double,text:string,bbox:array<array<double>>>>"
_BOXES = "array<struct<box_id:string,x:double,y:double,width:double,height:double,category:string,source:string,source_box_id:string>>"
_LINES = "array<struct<line_no:int,box_id:string,text:string,bbox:array<array<double>>>>"
_RECTANGLES = "array<struct<left:int,top:int,right:int,bottom:int>>"
_CROPS = "array<struct<number:int,box_id:string,left:int,top:int,right:int,bottom:int,file:string>>"
_DETECTIONS = "array<struct<box_id:string,category:string,x:double,y:double,width:double,height:double,confidence:double>>"
#: Columns of an edited box.
FIELDS = ("box_id", "x", "y", "width", "height", "category", "source", "source_box_id")
#: What follows from a slide's size, baseline and edit.
DERIVED = {"lines": _LINES, "removed": _LINES, "text_mask": _RECTANGLES, "figure_mask": _RECTANGLES, "crops": _CROPS, "detections": _DETECTIONS}
#: Reads the boxes it is given (the columns of ``review.boxes_to_read``) and returns keys, box_id, text, bbox.
Reader = Callable[[DataFrame], DataFrame]


def edit_documents(boxes: DataFrame, keys: list[str], order: list[str], revision: Column) -> DataFrame:
    """``keys``, revision, boxes of edited boxes in rows."""
    rows = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*FIELDS).alias("box")))).alias("rows"))
    return rows.select(*keys, revision.cast("long").alias("revision"), F.transform("rows", lambda r: r["box"]).cast(_BOXES).alias("boxes"))


def slide_rows(slides: DataFrame, lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What ``recompute`` takes of slides (``keys``, width_px, height_px) that nobody has edited, from their recognised lines (text, bbox)."""
    found = review.editor_boxes_in_rows(lines, keys, order)
    rows = slides.select(*keys, F.col("width_px").cast("int"), F.col("height_px").cast("int")).join(found, keys, "left")
    fields = ("box_id", "x", "y", "width", "height", "text", "bbox")
    named = F.sort_array(F.transform("lines", lambda r: F.struct(*(r[c].alias(c) for c in fields))))
    baseline = F.coalesce(named.cast(_BASELINE), F.array().cast(_BASELINE))
    return rows.select(*keys, "width_px", "height_px", baseline.alias("baseline"), F.lit(None).cast("long").alias("revision"), F.lit(None).cast(_BOXES).alias("boxes"))


def recompute(rows: DataFrame, keys: list[str], read: Reader) -> DataFrame:
    """Whole states from keys, width_px, height_px, baseline, revision and boxes (null: the baseline's own).

    Kept boxes keep their lines, new and moved ones take what is read in them; lines stand in reading order. Masks cover
    what goes from the image, crops are the figure boxes, and the detections are one text box over the slide and the figures.
    """
    core = rows.select(*keys, "width_px", "height_px", "baseline", "revision", F.col("boxes").alias("_boxes"))
    own = F.transform("baseline", lambda b: F.struct(b["box_id"].alias("box_id"), *(b[c].alias(c) for c in ("x", "y", "width", "height")), F.lit(review.TEXT).alias("category"), F.lit("base").alias("source"), b["box_id"].alias("source_box_id"))).cast(_BOXES)
    size = F.col("width_px"), F.col("height_px")
    # all that follows from a slide is worked out in its row, and joined with what is read in its boxes alone
    slides = core.withColumn("boxes", F.transform(F.coalesce("_boxes", own), lambda b, i: F.struct(i.alias("ord"), *(b[c].alias(c) for c in FIELDS))))
    slides = review.compare_in_rows(slides, size).drop("boxes")
    boxes = review.compared_boxes(slides.select(*keys, size[0].alias("slide_width"), size[1].alias("slide_height"), "compared"), [*keys, "slide_width", "slide_height"])
    whole = review.lines_in_rows(slides, read(review.boxes_to_read(boxes)), keys)

    def ordered(removed: bool) -> Column:
        lines = F.filter("tagged", lambda t: (t["kind"] == "removed") == F.lit(removed))
        return F.sort_array(F.transform(lines, lambda t: F.struct(t["at"]["y"].alias("y"), t["at"]["x"].alias("x"), *(t[c].alias(c) for c in ("ord", "box_id", "text", "bbox")))))

    numbered = lambda lines: F.transform(lines, lambda r, i: F.struct((i + 1).alias("line_no"), r["box_id"].alias("box_id"), r["text"].alias("text"), r["bbox"].alias("bbox")))
    covered = F.transform(F.filter("tagged", lambda t: t["kind"] == "removed"), lambda t: masks.inclusive(*(t["at"][c] for c in ("x", "y", "width", "height")), *size))
    whole = whole.withColumn("text_mask", F.sort_array(F.filter(covered, lambda r: (r["left"] <= r["right"]) & (r["top"] <= r["bottom"]))))
    whole = whole.withColumn("lines", numbered(ordered(False))).withColumn("removed", numbered(ordered(True))).drop("tagged")

    whole = whole.withColumn("_figures", F.filter("compared", lambda b: b["category"] == review.FIGURE)).drop("compared")
    pixels = lambda b: pixel_bounds(b["x"], b["y"], b["width"], b["height"], *size)
    filled = F.transform(F.filter(F.transform("_figures", pixels), lambda r: r.isNotNull()), lambda r: masks.within(r, *size))
    in_order = F.sort_array(F.transform("_figures", lambda b: F.struct(b["y"].alias("y"), b["x"].alias("x"), b["ord"].alias("ord"), b["box_id"].alias("box_id"), pixels(b).alias("at"))))
    crop = lambda b, i: F.struct((i + 1).alias("number"), b["box_id"].alias("box_id"), *(b["at"][c].alias(c) for c in ("left", "top", "right", "bottom")), review.crop_file(i + 1, b["box_id"]).alias("file"))
    crops = F.filter(F.transform(in_order, crop), lambda c: c["left"].isNotNull())
    d = lambda c: c.cast("double")
    slide = F.struct(F.lit("manual-editor-text").alias("box_id"), F.lit(review.TEXT).alias("category"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), d(size[0]).alias("width"), d(size[1]).alias("height"), F.lit(1.0).alias("confidence"))
    others = F.transform("_figures", lambda b: F.struct(b["box_id"].alias("box_id"), F.lit(review.FIGURE).alias("category"), *(b[c].alias(c) for c in ("x", "y", "width", "height")), F.lit(1.0).alias("confidence")))
    whole = whole.withColumn("figure_mask", F.sort_array(filled)).withColumn("crops", crops)
    whole = whole.withColumn("detections", F.concat(F.array(slide).cast(_DETECTIONS), F.coalesce(others.cast(_DETECTIONS), F.array().cast(_DETECTIONS))))
    derived = [F.coalesce(F.col(c).cast(kind), F.array().cast(kind)).alias(c) for c, kind in DERIVED.items()]
    status = F.when(F.col("revision").isNull(), "ready").otherwise("reviewed").alias("status")
    return whole.select(*keys, "width_px", "height_px", "baseline", "revision", F.col("_boxes").alias("boxes"), *derived, F.coalesce(F.size("text_mask") + F.size("figure_mask") > 0, F.lit(False)).alias("to_fill"), status)


def _latest(edits: DataFrame, keys: list[str]) -> DataFrame:
    return edits.where("revision is not null").groupBy(*keys).agg(F.max(F.struct("revision", F.col("boxes").cast(_BOXES).alias("boxes"))).alias("edit"))


def newer_edits(states: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """The latest document of each slide that is newer than the one its state has; documents of unknown slides go."""
    rows = _latest(edits, keys).join(states.select(*keys, F.col("revision").alias("_held")), keys)
    return rows.where("_held is null or edit.revision > _held").select(*keys, "edit")


def with_edits(rows: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """What ``recompute`` takes of all slides, with the latest documents where they are newer: for states that aren't stored yet, so that each is worked out once."""
    newer = F.col("edit").isNotNull() & (F.col("revision").isNull() | (F.col("edit.revision") > F.col("revision")))
    boxes = F.when(newer, F.coalesce("edit.boxes", F.array().cast(_BOXES))).otherwise(F.col("boxes"))
    found = rows.join(_latest(edits, keys), keys, "left")
    return found.select(*keys, "width_px", "height_px", "baseline", F.when(newer, F.col("edit.revision")).otherwise(F.col("revision")).alias("revision"), boxes.alias("boxes"))


def apply_edits(states: DataFrame, edits: DataFrame, keys: list[str], read: Reader) -> DataFrame:
    """Stored states after edit documents (``keys``, revision, boxes): what a full run over the latest documents gives."""
    newer = newer_edits(states, edits, keys)
    changed = states.select(*keys, "width_px", "height_px", "baseline").join(newer, keys)
    changed = changed.select(*keys, "width_px", "height_px", "baseline", "edit.revision", F.coalesce("edit.boxes", F.array().cast(_BOXES)).alias("boxes"))
    return states.join(newer.select(*keys), keys, "left_anti").unionByName(recompute(changed, keys, read))


class ReviewStore:
    """States of slides in a Parquet table in ``buckets`` partitions of slides."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], read: Reader, buckets: int = 64):
        self.spark, self.path, self.keys, self.read, self.buckets = spark, path, keys, read, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, states: DataFrame) -> None:
        rows = states.withColumn("bucket", self.bucket()).repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def start(self, slides: DataFrame, lines: DataFrame, order: list[str]) -> None:
        self._write(recompute(slide_rows(slides, lines, self.keys, order), self.keys, self.read))

    def states(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.drop("bucket")

    def apply(self, edits: DataFrame) -> None:
        """Rebuild the slides that ``edits`` change. Running it again changes nothing, so a batch may be repeated.

        A bucket whose slides all stay is neither read nor written; every slide has one row, so no bucket is left without.
        """
        edits = edits.persist()
        try:
            # at most ``buckets`` numbers
            touched = sorted(r[0] for r in edits.select(self.bucket()).distinct().collect())
            if touched:
                self._write(apply_edits(self.states(touched), edits, self.keys, self.read))
        finally:
            edits.unpersist()

    def follow(self, edits: DataFrame, checkpoint: str, **trigger):
        """Apply a stream of edit documents as it comes."""
        return edits.writeStream.foreachBatch(lambda batch, _: self.apply(batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def joined_text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda r: strip(r["text"])), "|")
