"""Text colours: strongest pixels, estimates, palette clusters and snapping. Every operator is keyed, so that slides run in parallel."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import luminance, rgb_distance

CLUSTER_WITHIN, SNAP_WITHIN = 20.0, 18.0
#: A pixel belongs to a text if it differs so much from the background; it is lighter or darker from this luminance on.
DIFFERENT, LIGHTER = 18.0, 6.0
#: Share and least number of a group's pixels that count as its strongest.
STRONG_SHARE, STRONG_LEAST = 0.35, 24


def strongest(pixels: DataFrame, keys: list[str], distance: str, order: str) -> DataFrame:
    """Of each group the max(24, 35 %) most distant pixels; of equally distant ones those that come first.

    Counts per distance find the distance at which a group's share ends; only pixels at just that distance are ranked,
    so that a group of any size is never sorted in one task.
    """
    per = pixels.groupBy(*keys, distance).agg(F.count("*").alias("_c"))
    group, down = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.col(distance).desc())
    per = per.withColumn("_keep", F.greatest(F.lit(STRONG_LEAST), F.ceil(F.sum("_c").over(group) * STRONG_SHARE))).withColumn("_upto", F.sum("_c").over(down))
    last = per.where("_upto - _c < _keep").groupBy(*keys).agg(F.min(distance).alias("_least"), F.min_by(F.col("_keep") - (F.col("_upto") - F.col("_c")), distance).alias("_room"))
    rows = pixels.join(last, keys).where(F.col(distance) >= F.col("_least"))
    above = rows.where(F.col(distance) > F.col("_least"))
    ties = rows.where(F.col(distance) == F.col("_least")).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k <= _room").drop("_k")
    return above.unionByName(ties).select(*pixels.columns)


def strongest_median(pixels: DataFrame, keys: list[str], distance: str, order: str) -> DataFrame:
    """Per group the channel medians of its strongest pixels, and how many those are."""
    return strongest(pixels, keys, distance, order).groupBy(*keys).agg(*(F.median(c).alias(c) for c in "rgb"), F.count("*").alias("support"))


def text_pixels(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (r, g, b over br, bg, bb) of the text in each group, with their distance from the background.

    Pixels too near the background go; of the others the lighter ones stay if their distances sum up to more than the darker ones', else the
    darker, else the lighter, else all.
    """
    own, back = tuple(F.col(c) for c in "rgb"), tuple(F.col(f"b{c}") for c in "rgb")
    rows = pixels.withColumn("distance", rgb_distance(own, back)).where(F.col("distance") >= DIFFERENT)
    delta = luminance(*own) - luminance(*back)
    rows = rows.withColumn("side", F.when(delta >= LIGHTER, 1).when(delta <= -LIGHTER, -1).otherwise(0))
    side = lambda k: F.sum(F.when(F.col("side") == k, F.col("distance")))
    scores = rows.groupBy(*keys).agg(side(1).alias("_light"), side(-1).alias("_dark"))
    taken = F.when(F.col("_light") > F.coalesce("_dark", F.lit(0.0)), 1).when(F.col("_dark").isNotNull(), -1).when(F.col("_light").isNotNull(), 1)
    chosen = rows.join(scores.select(*keys, taken.alias("_side")), keys)
    return chosen.where(F.col("_side").isNull() | (F.col("_side") == F.col("side"))).drop("_side")


def estimate_line_colors(pixels: DataFrame, keys: list[str], order: str) -> DataFrame:
    """r, g, b and support of each line of text; lines without a text pixel go."""
    found = strongest_median(text_pixels(pixels, keys), keys, "distance", order)
    return found.select(*keys, *(F.bround(c).cast("int").alias(c) for c in "rgb"), "support")


def combine_colors(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """One colour of several estimates, weighted by their support (1 at least)."""
    weight = F.greatest(F.lit(1), F.col("support"))
    return estimates.groupBy(*keys).agg(*(F.bround(F.sum(F.col(c) * weight) / F.sum(weight)).cast("int").alias(c) for c in "rgb"), F.sum(weight).alias("support"))


def nearest_color(r: Column, g: Column, b: Column, palette: Column) -> Column:
    """d and token of the nearest of an array of (token, pr, pg, pb); of equally near ones the first."""
    d = lambda p: rgb_distance((r, g, b), (p["pr"], p["pg"], p["pb"]))
    return F.array_min(F.transform(palette, lambda p: F.struct(d(p).alias("d"), p["token"].alias("token"))))


def snap_to_palette(colors: DataFrame, palette: DataFrame, keys: list[str], within: float = SNAP_WITHIN) -> DataFrame:
    """Add nearest and snapped: the nearest entry (token, pr, pg, pb) of the colour's own palette, and the same if near enough.

    A palette (``keys``) is a slide's handful of clusters: it becomes one array, which an equality join brings to the slide's colours.
    """
    whole = palette.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("token", "pr", "pg", "pb"))).alias("_p"))
    rows = colors.join(whole, keys, "left").withColumn("_b", nearest_color(F.col("r"), F.col("g"), F.col("b"), F.col("_p")))
    return rows.select(*colors.columns, F.col("_b.token").alias("nearest"), F.when(F.col("_b.d") <= within, F.col("_b.token")).alias("snapped"))


def palette_clusters(colors: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add cluster_no: in order, each estimated colour joins the nearest cluster within reach, whose weighted centre (rounded) then moves.

    Colours that aren't estimated (``estimated``, if there is such a column) have none. The colours of a slide (``keys``) are
    gathered, in order, and decided in Arrow batches of many slides.
    """
    own = [c for c in colors.columns if c not in keys]
    estimated = F.col("estimated") if "estimated" in colors.columns else F.lit(True)
    line = F.struct(order, "r", "g", "b", "support", estimated.alias("estimated"), F.struct(*own).alias("own"))
    grouped = colors.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("l"))
    flat = ("r", "g", "b", "support", "estimated")
    grouped = grouped.select(*keys, F.col("l.own").alias("own"), *(F.col(f"l.{c}").alias(f"_{c}") for c in flat))
    kept = [*keys, "own"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.schema.fields if f.name in kept) + ", numbers array<int>"

    def run(batches):
        for batch in batches:
            columns = (batch.column(f"_{c}").to_pylist() for c in flat)
            numbers = pa.array([cluster_numbers(*group) for group in zip(*columns)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), numbers], [*kept, "numbers"])

    found = grouped.mapInArrow(run, schema)
    return found.select(*keys, F.explode(F.arrays_zip("own", "numbers")).alias("r")).select(*keys, "r.own.*", F.col("r.numbers").alias("cluster_no")).select(*colors.columns, "cluster_no")


def cluster_numbers(r: list[float], g: list[float], b: list[float], support: list[int], estimated: list[bool]) -> list[int | None]:
    sums: list[list[float]] = []  # of each cluster the weighted channels and the weight
    centres: list[tuple] = []
    out: list[int | None] = []
    for *color, n, known in zip(r, g, b, support, estimated):
        if not known:
            out.append(None)
            continue
        weight = max(1, n)
        near = [(math.dist(color, c), i) for i, c in enumerate(centres)]
        d, at = min(near, default=(math.inf, 0))
        if d > CLUSTER_WITHIN:
            at = len(sums)
            sums.append([0.0, 0.0, 0.0, 0.0])
            centres.append(())
        for i, v in enumerate((*color, 1)):
            sums[at][i] += v * weight
        centres[at] = tuple(float(round(v / sums[at][3])) for v in sums[at][:3])
        out.append(at + 1)
    return out


def normalize_colors(colors: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Colours of a slide's placements, snapped to its palette: the clusters of at least two of them.

    Colours that aren't estimated or aren't near a palette entry stay.
    """
    clustered = palette_clusters(colors, keys, order)
    weight = F.greatest(F.lit(1), F.col("support"))
    centre = [F.bround(F.sum(F.col(c) * weight) / F.sum(weight)).alias(f"p{c}") for c in "rgb"]
    palette = clustered.where("cluster_no is not null").groupBy(*keys, F.col("cluster_no").alias("token")).agg(F.count("*").alias("_n"), *centre).where("_n > 1")
    whole = palette.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("token", "pr", "pg", "pb"))).alias("_p"))
    rows = colors.join(whole, keys, "left").withColumn("_b", nearest_color(F.col("r"), F.col("g"), F.col("b"), F.col("_p")))
    entry = F.get(F.filter("_p", lambda p: p["token"] == F.col("_b.token")), F.lit(0))
    known = F.col("estimated") if "estimated" in colors.columns else F.lit(True)
    snap = F.coalesce(known & (F.col("_b.d") <= SNAP_WITHIN), F.lit(False))
    new = {c: F.when(snap, entry[f"p{c}"]).otherwise(F.col(c)).cast(colors.schema[c].dataType).alias(c) for c in "rgb"}
    return rows.select(*(new.get(c, F.col(c)) for c in colors.columns))
