"""Text expressions: all are built-in Catalyst functions but for ``similarity``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .blocks import matched

# Unicode blocks that count as Korean, and with the others as CJK, and the marks that open a list item.
KOREAN_BLOCKS = {"Hangul Jamo": "1100-11ff", "Hangul Compatibility Jamo": "3130-318f", "Hangul Syllables": "ac00-d7a3"}
CJK_BLOCKS = KOREAN_BLOCKS | {
    "CJK Radicals Supplement": "2e80-2eff",
    "CJK Symbols and Punctuation": "3000-303f",
    "Hiragana": "3040-309f",
    "Katakana": "30a0-30ff",
    "CJK Strokes": "31c0-31ef",
    "CJK Unified Ideographs Extension A": "3400-4dbf",
    "CJK Unified Ideographs": "4e00-9fff",
    "CJK Compatibility Ideographs": "f900-faff",
}
BULLETS = "-*•·▪◦‣"
# Shares of the similarity, and its bonus for equal numbers.
RATIO_SHARE, TOKENS_SHARE, DIGITS_BONUS = 0.7, 0.3, 0.08


def _class_of(blocks: dict[str, str]) -> str:
    """A character class that Java's and RE2's patterns share."""
    return "[" + "".join("\\x{{{}}}-\\x{{{}}}".format(*block.split("-")) for block in blocks.values()) + "]"


KOREAN, CJK = _class_of(KOREAN_BLOCKS), _class_of(CJK_BLOCKS)
BULLET = rf"^\s*(?:[{BULLETS}]|\d+[.)]|[A-Za-z][.)])\s+"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_text(text: Column) -> Column:
    """Whether anything is left by ``strip``."""
    return text.rlike(r"(?U)\S")


def clean(text: Column) -> Column:
    """White space of any kind to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\R"), clean), lambda s: s != "")


def match_key(text: Column) -> Column:
    """Folded text of letters, digits and ``_%./:+-``; sharp s folds to ss."""
    folded = F.replace(F.lower(clean(text)), F.lit("ß"), F.lit("ss"))
    return clean(F.regexp_replace(folded, r"[^\p{L}\p{N}_\s%./:+-]", ""))


def tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: t != ""))


def digit_list(key: Column) -> Column:
    return F.regexp_extract_all(key, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def has_korean(text: Column) -> Column:
    return text.rlike(KOREAN)


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def language(text: Column) -> Column:
    return F.when(has_korean(text), "ko").otherwise("en")


def starts_bullet(text: Column) -> Column:
    return text.rlike(BULLET)


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger token set; 0 if either is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def containment(a: Column, b: Column) -> Column:
    return F.when((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), 0.05).otherwise(0.0)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    (at, said), (to, wanted) = (pd.factorize(s) for s in (a, b))
    lengths = a.str.len().to_numpy() + b.str.len().to_numpy()
    # two empty texts are equal
    return pd.Series(np.where(lengths == 0, 1.0, 2.0 * matched(list(said), list(wanted), at, to) / np.maximum(lengths, 1)), dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """difflib's ratio (argument order and the popular-character rule count), all pairs of a batch at once."""
    return F.pandas_udf(_ratios, "double")(a, b)


def parts(key: Column) -> Column:
    """What ``similarity`` takes from a match key besides its characters: its tokens and its numbers."""
    return F.struct(tokens(key).alias("tokens"), digit_list(key).alias("digits"))


def similarity(a: Column, b: Column, parts_a: Column | None = None, parts_b: Column | None = None) -> Column:
    """Similarity of two match keys, 0 to 1. Where keys are in many pairs their ``parts`` are worked out before, once a key."""
    pa, pb = parts(a) if parts_a is None else parts_a, parts(b) if parts_b is None else parts_b
    bonus = F.when((F.size(pa["digits"]) > 0) & (pa["digits"] == pb["digits"]), DIGITS_BONUS).otherwise(0.0) + containment(a, b)
    mixed = F.least(F.lit(1.0), sequence_ratio(a, b) * RATIO_SHARE + overlap(pa["tokens"], pb["tokens"]) * TOKENS_SHARE + bonus)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(mixed)


def padded(number: Column, digits: int) -> Column:
    """A number with leading zeros up to so many digits; longer ones stay whole."""
    return F.when(number < 10**digits, F.lpad(number.cast("string"), digits, "0")).otherwise(number.cast("string"))


def count_lines(text: Column) -> Column:
    """Lines that aren't blank, at least 1."""
    return F.greatest(F.lit(1), F.size(clean_lines(text)))


def recognised_text(lines: Column, text: Column) -> Column:
    """The stripped, non-blank lines of a result, else its text."""
    joined = F.array_join(F.filter(F.transform(lines, strip), lambda s: s != ""), "\n")
    return F.when(joined != "", joined).otherwise(strip(text))


def font_key(name: Column) -> Column:
    """A font's name as it is compared: lower-case letters and digits only."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def hex_to_rgb(color: Column) -> Column:
    """r, g, b of ``#RRGGBB`` or ``RRGGBB``; null if it is neither."""
    digits = F.upper(F.regexp_extract(color, r"^#?([0-9A-Fa-f]{6})$", 1))
    part = lambda at: F.conv(F.substring(digits, at, 2), 16, 10).cast("int")
    return F.when(digits != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(*(F.lpad(F.hex(c.cast("int")), 2, "0") for c in (r, g, b)))


def join_words(texts: Column) -> Column:
    """One line of ordered texts: stripped, blank ones left out, one space between two but where none belongs.

    None follows ``- / (``, precedes closing punctuation, or stands between two CJK characters.
    """

    def glue(line, t):
        close = line.rlike(r"[-/(]$") | t.rlike(r"^[,.:;!?)\]%]") | (F.right(line, F.lit(1)).rlike(CJK) & F.left(t, F.lit(1)).rlike(CJK))
        return F.when(t == "", line).when(line == "", t).when(close, F.concat(line, t)).otherwise(F.concat(line, F.lit(" "), t))

    return F.aggregate(F.transform(texts, strip), F.lit(""), glue)


def file_stem(path: Column) -> Column:
    """Characters outside [A-Za-z0-9._-] to dashes, dots and dashes stripped; blank gives 'upload'."""
    name = F.btrim(F.regexp_replace(path, r"[^A-Za-z0-9._-]+", "-"), F.lit(".-"))
    return F.when(name == "", "upload").otherwise(name)


def upload_kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(suffix == ".pdf", "pdf").when(suffix.isin(".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff"), "image").otherwise("unknown")
