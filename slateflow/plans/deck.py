"""From recognised slides to presentation files: placements, colours, font tokens, one size, one file a deck."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import corners
from ..functions.text import padded
from ..operators import color, layout, raster, typography
from ..operators.jobs import Settings
from ..sources import pptx

SLIDE = ["deck", "slide_no"]


def text_placements(detections: DataFrame, results: DataFrame, lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Placements of text boxes (deck, slide_no, box_id and rectangle): box_id, ord, text, rectangle, font, size, colour.

    ``results`` (text) and ``lines`` (ord, text, bbox) are by box; of several results of a box the last (``result_ord``) counts.
    """
    keys = [*SLIDE, "box_id"]
    last = results.groupBy(*keys).agg(F.max_by("text", "result_ord").alias("text"))
    boxes = detections.where(F.col("category") == "text").select(*keys, "x", "y", "width", "height")
    placed = layout.place(boxes, last, layout.line_segments(lines), keys, "ord")
    font = F.when(F.col("language") == "ko", settings.korean_font).otherwise(settings.latin_font)
    part = F.when(F.col("number") > 0, F.concat("box_id", F.lit(":p"), padded(F.col("number"), 2))).otherwise(F.col("box_id"))
    order = F.row_number().over(Window.partitionBy(*SLIDE).orderBy("y", "x", "box_id", "number"))
    default = F.struct(*(F.lit(v).alias(c) for c, v in zip("rgb", settings.text_color)))
    style = {"font_name": font, "color": default, "bold": F.lit(False), "italic": F.lit(False), "align": F.lit("left"), "auto_fit": F.lit(False)}
    rows = placed.withColumn("ord", order).withColumn("box_id", part)
    return rows.select(*SLIDE, "ord", "box_id", "text", "x", "y", "width", "height", "font_size_pt", "word_wrap", "language", *(c.alias(n) for n, c in style.items()))


def color_placements(placements: DataFrame, images: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """Placements with the colours of their texts, estimated from the slides over their backgrounds and snapped to each slide's palette."""
    areas = placements.select(*SLIDE, "ord", corners(*(F.col(c) for c in ("x", "y", "width", "height"))).alias("bbox"))
    found = raster.line_colors(images, backgrounds, areas, SLIDE, "ord")
    rows = placements.join(found, [*SLIDE, "ord"], "left").withColumn("estimated", F.col("r").isNotNull())
    known = rows.select(*SLIDE, "ord", *(F.coalesce(F.col(c), F.col(f"color.{c}")).cast("double").alias(c) for c in "rgb"), F.coalesce("support", F.lit(0)).alias("support"), "estimated")
    snapped = color.normalize_colors(known, SLIDE, "ord").select(*SLIDE, "ord", F.struct(*(F.col(c).cast("int").alias(c) for c in "rgb")).alias("color"))
    return placements.drop("color").join(snapped, [*SLIDE, "ord"])


def build_decks(slides: DataFrame, placements: DataFrame, images: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """deck and content: a presentation of all slides (deck, slide_no, width_px, height_px) at the first one's size, with one set of font sizes.

    ``images`` (deck, slide_no, ord, box_id, rectangle, image) lie under the texts.
    """
    sized = slides.select(*SLIDE, F.col("width_px").alias("slide_width"), F.col("height_px").alias("slide_height"))
    # the first slide sets the scale even if it has no text
    shape = typography.scale_to_first(sized.select(*SLIDE, "slide_width", "slide_height", *(F.lit(1.0).alias(c) for c in ("x", "y", "font_size"))), "deck", "slide_no")
    factor = shape.select(*SLIDE, *(F.col(c).alias(f"_{c}") for c in ("x", "y", "font_size")), F.lit(True).alias("_known"))

    def scaled(df: DataFrame) -> DataFrame:
        by = {"x": "_x", "width": "_x", "y": "_y", "height": "_y", "font_size_pt": "_font_size"}
        return df.select(*((F.col(c) * F.col(by[c])).alias(c) if c in by else F.col(c) for c in df.columns if c not in factor.columns or c in SLIDE))

    # placements meet their slides where they are numbered, by slide, and then lie by deck until its file is written; texts off the slides count for the fonts
    rows = scaled(typography.gather_fonts(placements.join(factor, SLIDE, "left"), "deck").where("_known"))
    if images is None:
        images = rows.where("false").select(*SLIDE, "ord", "box_id", "x", "y", "width", "height", F.lit(None).cast("binary").alias("image"))
    else:
        images = scaled(images.join(factor, SLIDE))
    return pptx.render(slides, rows, images, ["deck"], settings.dpi)
