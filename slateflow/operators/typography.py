"""Font sizes: family labels, tokens per family, nearest token, scaling to a deck's first slide."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean

#: Least ratio between neighbouring font tiers.
BODY_RATIO, LABEL_RATIO = 1.15, 1.20
#: Tokens of a family at most.
MOST_TOKENS = 6
#: Distinct sizes up to which a family's boundaries are all worked out at once.
SMALL_FAMILY = 32


def family_label(font: Column, text: Column, line_count: Column) -> Column:
    kind = F.when((line_count > 1) | (F.char_length(clean(text)) >= 24), "body").otherwise("label")
    name = F.when(F.trim(F.coalesce(font, F.lit(""))) == "", "default").otherwise(font)
    return F.concat(name, F.lit(":"), kind)


def scale_to_first(rows: DataFrame, deck: str, slide: str) -> DataFrame:
    """Placements scaled from their slide's size to the deck's first slide's; font sizes, of texts, by the smaller factor."""
    first = Window.partitionBy(deck).orderBy(slide).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sx = F.first("slide_width").over(first) / F.greatest(F.lit(1), F.col("slide_width"))
    sy = F.first("slide_height").over(first) / F.greatest(F.lit(1), F.col("slide_height"))
    r = rows.withColumn("_sx", sx).withColumn("_sy", sy)
    by = {"x": F.col("_sx"), "width": F.col("_sx"), "y": F.col("_sy"), "height": F.col("_sy"), "font_size": F.least("_sx", "_sy")}
    return r.select(*((F.col(c) * by[c]).alias(c) if c in by else F.col(c) for c in rows.columns))


def top_ratio(y: Column, slide_height: Column) -> Column:
    """How far down its slide a placement begins."""
    return F.greatest(F.lit(0.0), y / F.greatest(F.lit(1), slide_height))


def nearest_token(size: Column, tokens: Column) -> Column:
    """The token nearest to a size, the smaller of two as near."""
    return F.array_min(F.transform(tokens, lambda t: F.struct(F.abs(t - size).alias("d"), t.alias("t"))))["t"]


def _weighted_medians(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """medians[a, b]: of the sizes a .. b - 1, each as often as it counts."""
    m, upto = len(sizes), np.concatenate(([0], np.cumsum(counts)))
    a, b = np.meshgrid(np.arange(m + 1), np.arange(m + 1), indexing="ij")
    n = np.maximum(upto[b] - upto[a], 1)
    at = lambda k: sizes[np.minimum(np.searchsorted(upto, upto[a] + k, "right") - 1, m - 1)]
    return (at((n - 1) // 2) + at(n // 2)) / 2


def half_points(sizes: np.ndarray) -> np.ndarray:
    return np.floor(sizes / 0.5 + 0.5) * 0.5


def partition_sizes(sizes: list[float], counts: list[int], ratio: float) -> list[float]:
    """Font tokens of a family: medians, in half points, of runs of at least two sizes, neighbours at least ``ratio`` apart.

    ``sizes`` are distinct, each with how often it occurs; equal sizes share a token. As many runs as can be (MOST_TOKENS
    at most, each with its own token) win, then the highest sum over their boundaries of the medians' ratio + 0.1 x the sizes' ratio across
    the gap + 0.35 x the gap over the runs' spread (half a point at least) + 0.05 x their balance. If no division is allowed, the family has one token.

    Runs are laid from the smallest size up: the best division that ends in the run (a, b) extends the best that ends in a run (h, a).
    """
    order = np.argsort(sizes)
    s, n = np.asarray(sizes, float)[order], np.asarray(counts, np.int64)[order]
    s, n = s[s > 0], n[s > 0]
    m = len(s)
    if not m:
        return []
    upto = np.concatenate(([0], np.cumsum(n)))
    if s[-1] / max(s[0], 0.01) < ratio:
        # no two medians lie far enough apart
        low, high = s[np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], "right") - 1]
        return [float(half_points((low + high) / 2))]
    middle = _weighted_medians(s, n)
    token = half_points(middle)
    amount = upto[None, :] - upto[:, None]
    first_run = np.where(amount[0] >= 2, 0.0, -np.inf)
    # what a boundary at a between the runs (h, a) and (a, b) adds: small families have all of them at once, large ones those of one a
    def edges(at: np.ndarray) -> np.ndarray:
        low, a, high = np.arange(at[-1])[:, None, None], at[None, :, None], np.arange(at[0] + 1, m + 1)[None, None, :]
        ma, mb = middle[low, a], middle[a, high]
        allowed = (low < a) & (amount[a, high] >= 2) & (mb / np.maximum(ma, 0.01) >= ratio) & (token[low, a] != token[a, high])
        spread = np.maximum((s[a - 1] - s[low]) + (s[high - 1] - s[a]), 0.5)
        na, nb = amount[low, a], amount[a, high]
        edge = mb / np.maximum(ma, 0.01) + s[a] / np.maximum(s[a - 1], 0.01) * 0.1 + (s[a] - s[a - 1]) / spread * 0.35 + np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1) * 0.05
        return np.where(allowed, edge, -np.inf)

    places = np.arange(1, m)
    blocks = [] if m == 1 else [places] if m <= SMALL_FAMILY else np.split(places, len(places))
    known = [edges(at) for at in blocks] if m <= SMALL_FAMILY else None
    # score[a, b]: of the best division of the sizes before b whose last run is (a, b)
    score = np.full((m + 1, m + 1), -np.inf)
    score[0] = first_run
    steps: list[np.ndarray] = []
    best = [half_points(np.array([middle[0, m]]))[0]]
    for _ in range(1, min(MOST_TOKENS, int(upto[-1]) // 2)):
        longer, back = np.full_like(score, -np.inf), np.zeros(score.shape, np.int64)
        for n_block, at in enumerate(blocks):
            total = score[: at[-1], at][:, :, None] + (known[n_block] if known else edges(at))
            top = total.argmax(0)
            longer[at, at[0] + 1 :], back[at, at[0] + 1 :] = np.take_along_axis(total, top[None], 0)[0], top
        steps.append(back)
        score = longer
        if score.max() == -np.inf:
            break
        if score[:, m].max() == -np.inf:
            continue
        a, b, runs = int(score[:, m].argmax()), m, []
        for back in reversed(steps):
            runs.append((a, b))
            a, b = int(back[a, b]), a
        runs.append((a, b))
        best = [float(token[r]) for r in reversed(runs)]
    return [float(t) for t in best]


def font_tokens(rows: DataFrame, keys: list[str], size: str, ratio: Column | float = LABEL_RATIO) -> DataFrame:
    """tokens (ascending) per family; ``ratio`` is a family's least ratio between tiers. Only distinct sizes and their counts enter a group."""
    counted = rows.withColumn("_ratio", ratio if isinstance(ratio, Column) else F.lit(float(ratio))).where(F.col(size) > 0).groupBy(*keys, "_ratio", size).agg(F.count("*").alias("_n"))
    groups = counted.groupBy(*keys, "_ratio").agg(F.collect_list(size).alias("_sizes"), F.collect_list("_n").alias("_counts"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("_sizes", "_counts", "_ratio"))
            tokens = pa.array([partition_sizes(*group) for group in zip(*columns)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), tokens], [*keys, "tokens"])

    return groups.mapInArrow(run, f"{kinds}, tokens array<double>")


def _with_families(placements: DataFrame) -> DataFrame:
    """Add _family; null for blank texts."""
    lines = F.size(F.split(F.col("text"), r"\R"))
    return placements.withColumn("_family", F.when(clean(F.col("text")) != "", family_label(F.col("font_name"), F.col("text"), lines)))


def _snapped(families: pd.Series, sizes: pd.Series) -> pd.Series:
    out = []
    for names, values in zip(families, sizes):
        found = np.full(len(values), np.nan)
        for family in {name for name in names if name is not None}:
            mine = names == family
            distinct, counts = np.unique(values[mine & (values > 0)], return_counts=True)
            tokens = np.array(partition_sizes(distinct, counts, BODY_RATIO if family.endswith(":body") else LABEL_RATIO))
            if len(tokens):
                # as in nearest_token a text without a size takes the smallest
                found[mine] = tokens[np.abs(tokens - values[mine][:, None]).argmin(1)]
        out.append([None if np.isnan(v) else v for v in found])
    return pd.Series(out)


def gather_fonts(placements: DataFrame, deck: str) -> DataFrame:
    """``normalize_fonts`` of decks that fit into a row: each deck's placements are gathered once and worked out there. Rows stay together by deck."""
    columns = placements.columns
    gathered = _with_families(placements).groupBy(deck).agg(F.collect_list(F.struct(*(c for c in columns if c != deck), "_family")).alias("_p"))
    sizes = F.pandas_udf(_snapped, "array<double>")(F.col("_p._family"), F.col("_p.font_size_pt").cast("array<double>"))
    rows = gathered.withColumn("_sizes", sizes).select(deck, F.explode(F.arrays_zip("_p", "_sizes")).alias("r")).select(deck, "r._p.*", F.col("r._sizes").alias("_size"))
    return rows.select(*(c.alias(n) for n, c in _replaced(columns, F.col("_size")).items()))


def _replaced(columns: list[str], snapped: Column) -> dict[str, Column]:
    """The columns of placements with their sizes replaced where there is a token."""
    out = {c: F.col(c) for c in columns} | {"font_size_pt": F.coalesce(snapped, F.col("font_size_pt"))}
    if "auto_fit" in columns:
        out["auto_fit"] = F.when(snapped.isNotNull(), False).otherwise(F.col("auto_fit"))
    return out


def normalize_fonts(placements: DataFrame, deck: str) -> DataFrame:
    """Placements (font_name, font_size_pt, text) with their sizes replaced by the nearest token of their family in the deck.

    Body families take tiers 1.15 apart, labels 1.20. Blank texts keep their size; where a size is replaced, auto_fit, if there is one, ends.
    """
    rows = _with_families(placements)
    tier = F.when(F.col("_family").endswith(":body"), BODY_RATIO).otherwise(LABEL_RATIO)
    tokens = font_tokens(rows.where("_family is not null"), [deck, "_family"], "font_size_pt", tier)
    # a deck has a handful of families
    found = rows.join(tokens.withColumnRenamed(deck, "_deck").withColumnRenamed("_family", "_f"), (F.col(deck) == F.col("_deck")) & (F.col("_family") == F.col("_f")), "left")
    snapped = nearest_token(F.col("font_size_pt"), F.col("tokens"))
    return found.select(*(c.alias(n) for n, c in _replaced(placements.columns, snapped).items()))
