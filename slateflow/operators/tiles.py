"""Rectangles against rectangles of a slide, met by tiles of a grid in place of pair by pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a tile in pixels. Results are the same for any; it should be about as large as the larger rectangles.
TILE = 64.0


def _tile(value: Column, side: float) -> Column:
    return F.floor(value / side).cast("long")


def _laid(rows: DataFrame, box: Column, side: float) -> DataFrame:
    """A row for each tile that a rectangle touches, edges included."""
    # a filter would be pushed below the box and work it out once for each of its terms; where there is no span, the tile is null and meets nothing
    rows = rows.withColumn("_b", box)
    valid = F.expr("_b.width >= 0 and _b.height >= 0 and not isnan(_b.x + _b.y + _b.width + _b.height)")
    span = lambda at, size: F.when(valid, F.sequence(_tile(F.col(at), side), _tile(F.col(at) + F.col(size), side)))
    return rows.withColumn("_tx", F.explode_outer(span("_b.x", "_b.width"))).withColumn("_ty", F.explode_outer(span("_b.y", "_b.height")))


def touching(left: DataFrame, right: DataFrame, keys: list[str], left_box: Column, right_box: Column, side: float = TILE) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose rectangles touch, edges included: the columns of both, the keys once.

    A box is a struct of x, y, width, height in doubles; null boxes, negative sizes and keys that are null match nothing. Equal rows make a pair each. Both sides are laid
    on a grid and meet by key and tile, an equality join that many tasks share even where one slide has most of the rectangles. A pair that shares several tiles is
    made by one alone: the one that holds the upper left corner of what the two have in common. Other columns must differ in name.
    """
    a = _laid(left, left_box, side).withColumnRenamed("_b", "_lb")
    b = _laid(right, right_box, side).withColumnRenamed("_b", "_rb")
    pairs = a.join(b, [*keys, "_tx", "_ty"])
    x, y = F.greatest("_lb.x", "_rb.x"), F.greatest("_lb.y", "_rb.y")
    meet = (x <= F.least(F.col("_lb.x") + F.col("_lb.width"), F.col("_rb.x") + F.col("_rb.width"))) & (y <= F.least(F.col("_lb.y") + F.col("_lb.height"), F.col("_rb.y") + F.col("_rb.height")))
    owner = (_tile(x, side) == F.col("_tx")) & (_tile(y, side) == F.col("_ty"))
    names = [*keys, *(c for c in left.columns if c not in keys), *(c for c in right.columns if c not in keys)]
    return pairs.where(meet & owner).select(*names)
