"""Rows, line clusters and paragraphs of boxes. Every operator is keyed, so that slides run in parallel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import ranges
from ..functions.geometry import across, bounds, fallback_font_size
from ..functions.text import has_text, join_words, language, starts_bullet, strip


def rectangle() -> list[Column]:
    """Aggregates: the rectangle around boxes."""
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    return [F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (bottom - F.min("y")).alias("height")]


def union_rect(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(*rectangle())


def split_rows(boxes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add row_no: boxes apart by a vertical gap at the 1-pixel scan lines lie in different rows.

    Gaps and islands over each box's covered scan lines; a box between two lines covers none and
    opens no row of its own, it falls to the rows whose separators its centre has passed.
    """
    whole = Window.partitionBy(*keys)
    # scan lines rise with y, so that one sort by y serves the top, the reach and, as it begins with the keys, all that is over whole groups
    by_y = whole.orderBy("y")
    b = boxes.withColumn("_top", F.min("y").over(by_y.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    b = b.withColumn("_end", F.max(F.col("y") + F.col("height")).over(whole))
    b = b.withColumn("_n", F.rint(F.col("_end") - F.col("_top")))
    lo, hi = F.ceil(F.col("y") - F.col("_top")), F.least(F.col("_n"), F.floor(F.col("y") + F.col("height") - F.col("_top")))
    b = b.withColumn("_lo", lo.cast("double")).withColumn("_hi", hi.cast("double"))
    # of boxes with the same first line whichever comes first opens the gap, so that their order changes nothing
    seen = F.when(F.col("_lo") <= F.col("_hi"), F.col("_hi"))
    b = b.withColumn("_reach", F.max(seen).over(by_y.rowsBetween(Window.unboundedPreceding, -1)))
    gap = (F.col("_lo") <= F.col("_hi")) & (F.col("_lo") > F.col("_reach") + 1)
    b = b.withColumn("_sep", F.when(gap, (F.col("_top") * 2 + F.col("_reach") + F.col("_lo")) / 2))
    # a group has as many bands as centres have passed separators, and separators are at most its scan lines
    b = b.withColumn("_seps", F.collect_list("_sep").over(whole)).withColumn("_count", F.count("*").over(whole))
    few = (F.col("_count") <= 1) | (F.col("_end") - F.col("_top") < 5)
    mid = F.col("y") + F.col("height") / 2
    b = b.withColumn("_passed", F.when(few, 0).otherwise(F.size(F.filter("_seps", lambda s: s < mid))))
    b = b.withColumn("_bands", F.collect_set("_passed").over(whole))
    passed = F.col("_passed")
    return b.select(*boxes.columns, F.size(F.filter("_bands", lambda p: p <= passed)).alias("row_no"))


def cluster_lines(boxes: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """Add cluster_no: within a row, by x, a new line starts at a vertical box, an overlap at another height, another font height or a wide gap."""
    w = Window.partitionBy(*keys).orderBy("x", *([order] if isinstance(order, str) else order))
    prev = lambda c: F.lag(c).over(w)
    px, py, pw, ph = (prev(c) for c in ("x", "y", "width", "height"))
    x, y, wd, h = (F.col(c) for c in ("x", "y", "width", "height"))
    vertical = (h > wd * 1.4) | (ph > pw * 1.4)
    apart = (across(px, pw, x, wd) >= F.least(wd, pw) * 0.25) & (F.abs((y + h / 2) - (py + ph / 2)) >= F.least(h, ph) * 0.35)
    unlike = F.greatest(h, ph) / F.greatest(F.lit(1.0), F.least(h, ph)) > 1.15
    wide = x - (px + pw) > F.greatest(F.lit(24.0), F.least(h, ph) * 0.8)
    return boxes.withColumn("_new", F.when(px.isNull(), 1).when(vertical | apart | unlike | wide, 1).otherwise(0)).withColumn("cluster_no", F.sum("_new").over(w)).drop("_new")


def line_segments(lines: DataFrame, text: str = "text", polygon: str = "bbox") -> DataFrame:
    """Recognised lines with stripped text and the rectangle of their polygon; lines without text or polygon go."""
    # filtered before they are worked out, as a filter on the results works them out a second time
    some = lines.where(has_text(F.col(text)) & (F.size(polygon) > 0))
    rows = some.withColumn("_text", strip(F.col(text))).withColumn("_box", bounds(F.col(polygon)))
    return rows.select(*(c for c in lines.columns if c not in (text, polygon)), F.col("_text").alias("text"), "_box.*")


def reading_order(boxes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add read_no: by row, then x, ties as they came."""
    rows = split_rows(boxes, keys, order)
    return rows.withColumn("read_no", F.row_number().over(Window.partitionBy(*keys).orderBy("row_no", "x", order)))


def merge_paragraphs(rows: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """Add paragraph_no: each row, by (y, x), joins the best-scoring open paragraph or opens one.

    The choice depends on earlier ones (a paragraph's last row and running extent), so the rows of one detection are
    gathered, in order, and decided in Arrow batches of many detections. ``text`` decides on list items.
    """
    order = [order] if isinstance(order, str) else order
    own = [c for c in rows.columns if c not in keys]
    line = F.struct("y", "x", *order, F.col("width"), F.col("height"), starts_bullet(F.col("text")).alias("bullet"), F.struct(*own).alias("own"))
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    grouped = grouped.select(*keys, F.col("lines.own").alias("own"), *(F.col(f"lines.{c}").alias(f"_{c}") for c in ("x", "y", "width", "height", "bullet")))
    kept = [*keys, "own"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.schema.fields if f.name in kept) + ", numbers array<int>"

    def run(batches):
        for batch in batches:
            lists = [batch.column(f"_{c}") for c in ("x", "y", "width", "height", "bullet")]
            ends = np.concatenate(([0], np.cumsum(lists[0].value_lengths().to_numpy()))).astype(np.int32)
            found = paragraph_numbers_of(np.diff(ends), *(c.flatten().to_numpy(zero_copy_only=False) for c in lists))
            numbers = pa.ListArray.from_arrays(pa.array(ends), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), numbers], [*kept, "numbers"])

    found = grouped.mapInArrow(run, schema)
    return found.select(*keys, F.explode(F.arrays_zip("own", "numbers")).alias("r")).select(*keys, "r.own.*", F.col("r.numbers").alias("paragraph_no")).select(*rows.columns, "paragraph_no")


def paragraph_numbers(x: list[float], y: list[float], width: list[float], height: list[float], bullet: list[bool]) -> list[int]:
    """The paragraph of each row of a detection; rows come by (y, x), and the first of equally good paragraphs takes a row."""
    last: list[tuple] = []  # of each paragraph its last row,
    extent: list[tuple] = []  # and its left and right
    out = []
    for row in zip(x, y, width, height, bullet):
        scores = [continues(before, reach, row) for before, reach in zip(last, extent)]
        best = max((s for s in scores if s is not None), default=None)
        left, right = row[0], row[0] + row[2]
        if best is None:
            last.append(row)
            extent.append((left, right))
            out.append(len(last))
            continue
        at = scores.index(best)
        last[at], extent[at] = row, (min(extent[at][0], left), max(extent[at][1], right))
        out.append(at + 1)
    return out


def paragraph_numbers_of(sizes, x, y, width, height, bullet) -> np.ndarray:
    """``paragraph_numbers`` of many detections that lie end to end, ``sizes`` rows each: their first rows at once, then their second ones, and so on."""
    start = np.cumsum(sizes) - sizes
    out = np.ones(len(x), np.int64)
    # a detection's paragraphs lie from its start on, as it has no more of them than rows: the last row of each, and its left and right
    last, left, right = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x))
    count = np.zeros(len(sizes), np.int64)
    for turn in range(max(sizes, default=0)):
        who = np.flatnonzero(sizes > turn)
        row = start[who] + turn
        at, owner = ranges(start[who], start[who] + count[who])
        score = _continue(last[at], left[at], right[at], row[owner], x, y, width, height, bullet)
        best = np.full(len(who), -np.inf)
        np.maximum.at(best, owner, score)
        # of equally good paragraphs the first
        place = start[who] + count[who]
        joins = np.flatnonzero((score == best[owner]) & (score > -np.inf))[::-1]
        place[owner[joins]] = at[joins]
        new = best == -np.inf
        count[who] += new
        out[row], last[place] = place - start[who] + 1, row
        left[place] = np.where(new, x[row], np.minimum(left[place], x[row]))
        right[place] = np.where(new, x[row] + width[row], np.maximum(right[place], x[row] + width[row]))
    return out


def _continue(last, left, right, row, x, y, width, height, bullet) -> np.ndarray:
    """``continues`` of many paragraphs and rows; -inf where a row can't continue a paragraph."""
    lx, ly, lw, lh = x[last], y[last], width[last], height[last]
    x, y, w, h = x[row], y[row], width[row], height[row]
    low, limit, gap = np.minimum(lh, h), np.maximum(GAP, lh * GAP_SHARE), y - (ly + lh)
    shared = np.maximum(0.0, np.minimum(lx + lw, x + w) - np.maximum(lx, x))
    unlike = np.maximum(lh, h) / np.maximum(1.0, low) > HEIGHTS
    near = (-low * BACK <= gap) & (gap <= limit)
    beside = (shared < np.maximum(1.0, np.minimum(lw, w)) * SHARED) & (np.abs(lx - x) > lh * ASIDE)
    with_extent = np.maximum(0.0, np.minimum(right, x + w) - np.maximum(left, x))
    aside = np.minimum(np.abs(lx - x), np.abs(left - x)) / np.maximum(lh * ASIDE, 1.0)
    widths = np.minimum(right - left, w) / np.maximum(np.maximum(right - left, w), 1.0)
    score = np.maximum(shared, with_extent) / np.maximum(1.0, w) * 3.0 + (1.0 - np.minimum(np.maximum(0.0, gap) / limit, 1.0)) + (1.0 - np.minimum(aside, 1.0)) + widths * 0.5
    return np.where(bullet[row].astype(bool) | unlike | ~near | beside, -np.inf, score)


#: Limits of a paragraph: how much heights may differ, how far rows may lie apart or over each other, and how far to the side.
HEIGHTS, GAP, GAP_SHARE, BACK, SHARED, ASIDE = 1.22, 12.0, 0.20, 0.35, 0.35, 2.0


def continues(last: tuple, extent: tuple[float, float], row: tuple) -> float | None:
    """How well a row (x, y, width, height, list item) continues a paragraph; None if it can't.

    It can't if it opens a list item, if its height is unlike the last row's, if it lies too far below that row or too far over it,
    or if it hardly shares columns with it and begins far aside.
    """
    lx, ly, lw, lh, _ = last
    x, y, w, h, bullet = row
    gap, gap_limit = y - (ly + lh), max(GAP, lh * GAP_SHARE)
    if bullet or max(lh, h) / max(1.0, min(lh, h)) > HEIGHTS or not -min(lh, h) * BACK <= gap <= gap_limit:
        return None
    shared = max(0.0, min(lx + lw, x + w) - max(lx, x))
    if shared < max(1.0, min(lw, w)) * SHARED and abs(lx - x) > lh * ASIDE:
        return None
    left, right = extent
    with_extent = max(0.0, min(right, x + w) - max(left, x))
    aside = min(abs(lx - x), abs(left - x)) / max(lh * ASIDE, 1.0)
    widths = min(right - left, w) / max(right - left, w, 1.0)
    return max(shared, with_extent) / max(1.0, w) * 3.0 + (1.0 - min(max(0.0, gap) / gap_limit, 1.0)) + (1.0 - min(aside, 1.0)) + widths * 0.5


def _median(values: Column) -> Column:
    """Median of an array of numbers; null if it is empty."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def split_headings(rows: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """Add part: 0 for the first row, by (y, x), of a paragraph that it heads, 1 for its other rows; 0 if there is no heading.

    A heading stands over at least two even rows (heights within 1.22, gaps near their median), is 1.18 times as high as they are, keeps
    more distance than they do, and shares columns with the first of them.
    """
    order = [order] if isinstance(order, str) else order
    own = [c for c in rows.columns if c not in keys]
    line = F.struct("y", "x", *order, "width", "height", F.struct(*own).alias("own"))
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("l")).withColumn("body", F.slice("l", 2, F.size("l")))
    head, first = F.get("l", F.lit(0)), F.get("l", F.lit(1))
    g = g.withColumn("heights", F.transform("body", lambda r: r["height"])).withColumn("middle", _median(F.col("heights")))
    after = F.zip_with(F.slice("body", 1, F.size("body") - 1), F.slice("body", 2, F.size("body")), lambda a, b: b["y"] - (a["y"] + a["height"]))
    g = g.withColumn("gaps", F.when(F.size("l") >= 3, after)).withColumn("gap", _median(F.col("gaps")))
    uneven, gap, middle = F.greatest(F.lit(8.0), F.col("middle") * 0.18), F.col("gap"), F.col("middle")
    even = (F.array_max("heights") / F.greatest(F.lit(1.0), F.array_min("heights")) <= 1.22) & F.forall("gaps", lambda d: F.abs(d - gap) <= uneven)
    clear = first["y"] - (head["y"] + head["height"]) >= F.greatest(uneven, gap + 8)
    shares = across(head["x"], head["width"], first["x"], first["width"]) >= F.greatest(F.lit(1.0), F.least(head["width"], first["width"])) * 0.35
    headed = (F.size("l") >= 3) & (middle > 0) & (head["height"] / middle >= 1.18) & clear & shares & even
    g = g.withColumn("headed", F.coalesce(headed, F.lit(False)))
    return g.select(*keys, "headed", F.posexplode("l").alias("pos", "r")).select(*keys, "r.own.*", F.when(F.col("headed") & (F.col("pos") > 0), 1).otherwise(0).alias("part")).select(*rows.columns, "part")


def typeset(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The paragraphs of each detection (``keys``) in reading order: number, text, x, y, width, height, n_lines.

    ``lines`` are segments (text, x, y, width, height): they are split into rows and lines, merged into paragraphs, freed of
    headings and numbered as they are read.
    """
    rows = split_rows(lines, keys, order).withColumn("_mid", F.col("y") + F.col("height") / 2)
    rows = cluster_lines(rows, [*keys, "row_no"], ["_mid", order])
    line = [*keys, "row_no", "cluster_no"]
    texts = F.transform(F.sort_array(F.collect_list(F.struct("x", "_mid", order, "text"))), lambda t: t["text"])
    whole = rows.groupBy(*line).agg(join_words(texts).alias("text"), *rectangle()).where("text <> ''")
    merged = merge_paragraphs(whole, keys, ["row_no", "cluster_no"])
    paragraph = [*keys, "paragraph_no"]
    parts = split_headings(merged, paragraph, ["row_no", "cluster_no"])
    ordered = F.sort_array(F.collect_list(F.struct("y", "x", "row_no", "cluster_no", "height", "width", "text")))
    found = parts.groupBy(*paragraph, "part").agg(ordered.alias("l"), *rectangle())
    first = F.get("l", F.lit(0))
    # a paragraph is read where its first line stands
    heads = found.select(*paragraph, "part", F.struct("x", "y", "width", "height").alias("rect"), "l", *(first[c].alias(c) for c in ("x", "y", "width", "height")))
    heads = heads.withColumn("_ord", F.struct("paragraph_no", "part"))
    numbered = split_rows(heads, keys, "_ord").withColumn("_mid", F.col("y") + F.col("height") / 2)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("row_no", "x", "_mid", "_ord"))
    text = F.array_join(F.transform("l", lambda r: r["text"]), "\n")
    return numbered.select(*keys, number.alias("number"), text.alias("text"), "rect.*", F.size("l").alias("n_lines"))


def place(detections: DataFrame, results: DataFrame, lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Text placements of detections (``keys`` and rectangle): one per paragraph, else one block with the result's text.

    Of ``results`` (``keys``, text) detections without one go; blank texts give no placement. Font sizes are those for fonts that aren't at hand.
    """
    found = detections.join(results.select(*keys, F.col("text").alias("_text")), keys)
    part = ["number", "text", "x", "y", "width", "height", "n_lines"]
    paragraphs = typeset(lines, keys, order).select(*keys, F.struct(*part).alias("_part"))
    block = F.struct(F.lit(0).alias("number"), strip(F.col("_text")).alias("text"), "x", "y", "width", "height", F.lit(0).alias("n_lines"))
    # one join, so that paragraphs are worked out once: a detection that meets none is a block
    rows = found.join(paragraphs, keys, "left").where(F.col("_part").isNotNull() | has_text(F.col("_text")))
    rows = rows.select(*keys, F.coalesce("_part", block).alias("_part")).select(*keys, "_part.*")
    return rows.select("*", fallback_font_size(F.col("height")).alias("font_size_pt"), language(F.col("text")).alias("language"), (F.col("number") == 0).alias("word_wrap"))


