"""Pixel, point and EMU arithmetic; rounding to half-even where sizes are converted, half-up for font steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def px_to_emu(px: Column, dpi: int = 96) -> Column:
    return F.bround(px / dpi * 914400).cast("long")


def px_to_pt(px: Column, dpi: int = 96) -> Column:
    return px / dpi * 72.0


def font_step(size: Column) -> Column:
    return F.floor(size / F.lit(0.5) + F.lit(0.5)) * F.lit(0.5)


def edges(x: Column, y: Column, width: Column, height: Column) -> dict[str, Column]:
    """right, bottom and center_y of a box."""
    return {"right": x + width, "bottom": y + height, "center_y": y + height / 2}


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, value))


def bounds(polygon: Column) -> Column:
    """x, y, width, height of an array of points; null if it is empty."""
    sides = F.struct(F.transform(polygon, lambda p: p[0]).alias("xs"), F.transform(polygon, lambda p: p[1]).alias("ys"))
    low, high = F.array_min, F.array_max
    box = lambda s: F.struct(low(s["xs"]).alias("x"), low(s["ys"]).alias("y"), (high(s["xs"]) - low(s["xs"])).alias("width"), (high(s["ys"]) - low(s["ys"])).alias("height"))
    # an array of one, so that each side is taken from the points once
    return F.when(F.size(polygon) > 0, F.get(F.transform(F.array(sides), box), F.lit(0)))


def corners(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The polygon of a box, clockwise from the top left."""
    return F.array(F.array(x, y), F.array(x + width, y), F.array(x + width, y + height), F.array(x, y + height))


def pixel_bounds(x, y, width, height, slide_width, slide_height, padding: int = 0, truncate: bool = False) -> Column:
    """left, top, right, bottom in whole pixels: rounded, padded, then clipped to the slide; null if nothing is left.

    With ``truncate`` the left and top are cut to whole numbers instead of being rounded, as crops of text lines are.
    """
    near = (lambda c: c.cast("int")) if truncate else (lambda c: F.bround(c).cast("int"))
    left, top = F.greatest(F.lit(0), near(x) - padding), F.greatest(F.lit(0), near(y) - padding)
    right = F.least(slide_width.cast("int"), F.bround(x + width).cast("int") + padding)
    bottom = F.least(slide_height.cast("int"), F.bround(y + height).cast("int") + padding)
    return F.when((right > left) & (bottom > top), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


def keep_inside(x, y, width, height, slide_width, slide_height) -> Column:
    """x, y, width, height of a box that an editor may show: at least a pixel, at most the slide, and on it."""
    w, h = clamp(width, 1.0, slide_width), clamp(height, 1.0, slide_height)
    return F.struct(clamp(x, 0.0, slide_width - w).alias("x"), clamp(y, 0.0, slide_height - h).alias("y"), w.alias("width"), h.alias("height"))


def across(ax: Column, aw: Column, bx: Column, bw: Column) -> Column:
    """How far two boxes overlap horizontally."""
    return F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))


def meets(line: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """Whether a line's rectangle (a struct as of ``bounds``) touches a box, edges included."""
    return (line["x"] + line["width"] >= x) & (line["x"] <= x + width) & (line["y"] + line["height"] >= y) & (line["y"] <= y + height)


def fallback_font_size(height: Column, least: float = 10.0, dpi: int = 96) -> Column:
    """Points for a text whose font isn't at hand: two thirds of its height, two decimals, no less than ``least``."""
    return F.greatest(F.lit(least), F.round(px_to_pt(height / 1.5, dpi), 2))


def placed_size(width: Column, height: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Width and height that a text measured as (left, top, right, bottom) needs in its box."""
    w, h = F.greatest(width + F.greatest(F.lit(0.0), left), right), F.greatest(height + F.greatest(F.lit(0.0), top), bottom)
    return F.struct(w.alias("width"), h.alias("height"))


def same_geometry(a: str, b: str, tolerance: float = 1.0) -> Column:
    out = F.lit(True)
    for side in ("x", "y", "width", "height"):
        out = out & (F.abs(F.col(f"{a}.{side}") - F.col(f"{b}.{side}")) <= tolerance)
    return out


def rgb_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def bucket16(channel: Column) -> Column:
    """A channel's nearest multiple of 16, ties to even."""
    return (F.bround(channel / 16) * 16).cast("int")
