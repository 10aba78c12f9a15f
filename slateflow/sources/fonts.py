"""Font files as tables of advances, and texts measured by joins with them."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import fallback_font_size
from ..functions.text import CJK, font_key, strip

# The families tried after the wanted one, in order.
KOREAN_FALLBACKS = ("Pretendard", "Apple SD Gothic Neo", "AppleSDGothicNeo", "Noto Sans CJK KR", "NotoSansCJKkr", "Malgun Gothic", "NanumGothic")
LATIN_FALLBACKS = ("Pretendard", "Helvetica", "Aptos", "Noto Sans", "DejaVu Sans", "Liberation Sans")


def font_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path and content of font files in folders (and below them), each folder once."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ttf,otf,ttc,otc}").load(list(dict.fromkeys(folders)))
    return rows.select("path", "content")


def find_fonts(wanted: DataFrame, fonts: DataFrame) -> DataFrame:
    """``wanted`` (font_name, korean) with path: of the first family tried, the first file whose name holds the family's; null if there is none.

    The wanted family is tried first, then the fallbacks of its script. Families and font files are few.
    """
    fallbacks = F.when(F.col("korean"), F.array(*map(F.lit, KOREAN_FALLBACKS))).otherwise(F.array(*map(F.lit, LATIN_FALLBACKS)))
    families = wanted.select("font_name", "korean").distinct().select("*", F.posexplode(F.concat(F.array("font_name"), fallbacks)).alias("rank", "family"))
    names = fonts.select("path", font_key(F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1)).alias("file"))
    found = families.join(F.broadcast(names), F.contains(F.col("file"), font_key(F.col("family")))).groupBy("font_name", "korean").agg(F.min(F.struct("rank", "path"))["path"].alias("path"))
    return wanted.join(found, ["font_name", "korean"], "left")


def _table(content: bytes, offset: int = 0) -> dict[bytes, tuple[int, int]]:
    n = struct.unpack_from(">H", content, offset + 4)[0]
    return {content[at : at + 4]: struct.unpack_from(">II", content, at + 8) for at in range(offset + 12, offset + 12 + 16 * n, 16)}


def advances(content: bytes) -> tuple[int, int, int, dict[int, int]] | None:
    """Units per em, ascent, descent and the advance of each code point of a TrueType or OpenType font (the first of a collection)."""
    start = struct.unpack_from(">I", content, 12)[0] if content[:4] == b"ttcf" else 0
    tables = _table(content, start)
    if not {b"cmap", b"hmtx", b"hhea", b"head"} <= tables.keys():
        return None
    head, hhea, hmtx, cmap = (tables[k][0] for k in (b"head", b"hhea", b"hmtx", b"cmap"))
    units = struct.unpack_from(">H", content, head + 18)[0]
    ascent, descent = struct.unpack_from(">hh", content, hhea + 4)
    n_long = struct.unpack_from(">H", content, hhea + 34)[0]
    wide = struct.unpack_from(">" + "Hh" * n_long, content, hmtx)[::2]
    glyphs: dict[int, int] = {}
    for k in range(struct.unpack_from(">H", content, cmap + 2)[0]):
        at = cmap + struct.unpack_from(">I", content, cmap + 4 + 8 * k + 4)[0]
        kind = struct.unpack_from(">H", content, at)[0]
        if kind == 12:
            for g in range(struct.unpack_from(">I", content, at + 12)[0]):
                low, high, first = struct.unpack_from(">III", content, at + 16 + 12 * g)
                glyphs.update(zip(range(low, high + 1), range(first, first + high - low + 1)))
        elif kind == 4:
            n = struct.unpack_from(">H", content, at + 6)[0] // 2
            highs, lows = struct.unpack_from(f">{n}H", content, at + 14), struct.unpack_from(f">{n}H", content, at + 16 + 2 * n)
            deltas, ranges = struct.unpack_from(f">{n}H", content, at + 16 + 4 * n), struct.unpack_from(f">{n}H", content, at + 16 + 6 * n)
            for i, (high, low, delta, shift) in enumerate(zip(highs, lows, deltas, ranges)):
                for c in range(low, min(high, 0xFFFE) + 1):
                    g = struct.unpack_from(">H", content, at + 16 + 6 * n + 2 * i + shift + 2 * (c - low))[0] if shift else c
                    if g or not shift:
                        glyphs.setdefault(c, (g + delta) & 0xFFFF)
    return units, ascent, -descent, {c: wide[min(g, n_long - 1)] for c, g in glyphs.items() if g}


def font_advances(fonts: DataFrame) -> DataFrame:
    """path, code, advance, ascent, descent (shares of an em) of each code point of each font; other files have none."""
    item = pa.list_(pa.struct([("letter", pa.string()), ("advance", pa.float64())]))

    def run(batches):
        for batch in batches:
            rows = [(p, found) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) if (found := advances(c))]
            glyphs = pa.array([[{"letter": chr(c), "advance": w / units} for c, w in table.items() if not 0xD800 <= c < 0xE000] for _, (units, _, _, table) in rows], item)
            sides = [pa.array([f[k] / f[0] for _, f in rows], pa.float64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), *sides, glyphs], ["path", "ascent", "descent", "glyphs"])

    rows = fonts.select("path", "content").mapInArrow(run, "path string, ascent double, descent double, glyphs array<struct<letter: string, advance: double>>")
    return rows.select("path", "ascent", "descent", F.explode("glyphs").alias("g")).select("path", "g.letter", "g.advance", "ascent", "descent")


def measure(texts: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n_lines, em_width, em_height and cjk of texts (text, path): the widest line and a line's height, in ems.

    Characters are counted per text and line before they meet their advances; one that the font lacks is an em wide. Blank lines don't count.
    """
    lines = texts.select(*keys, "path", F.posexplode(F.filter(F.transform(F.split("text", r"\R"), strip), lambda s: s != "")).alias("line", "t"))
    chars = lines.select(*keys, "path", "line", F.explode(F.filter(F.split("t", ""), lambda c: c != "")).alias("letter"))
    counted = chars.groupBy(*keys, "path", "line", "letter").agg(F.count("*").alias("n"))
    met = counted.join(table, ["path", "letter"], "left").groupBy(*keys, "line").agg(F.sum(F.col("n") * F.coalesce("advance", F.lit(1.0))).alias("w"), F.max(F.col("ascent") + F.col("descent")).alias("h"), F.bool_or(F.col("letter").rlike(CJK)).alias("cjk"))
    return met.groupBy(*keys).agg(F.count("*").cast("int").alias("n_lines"), F.max("w").alias("em_width"), F.coalesce(F.max("h"), F.lit(1.0)).alias("em_height"), F.bool_or("cjk").alias("cjk"))


def fit_size(em_width: Column, em_height: Column, n_lines: Column, cjk: Column, width: Column, height: Column, least: float = 10.0, most: float = 44.0, dpi: int = 96) -> Column:
    """The largest size in points, by 16 halvings, at which a text fits its box; ``least`` if none does.

    Between lines stand 0.3 of the font's pixels, 0.5 if there is any CJK character.
    """
    high = F.greatest(F.lit(most), height / F.greatest(F.lit(1), n_lines) * 1.8 / dpi * 72.0)
    gap = (n_lines - 1) * F.when(cjk, 0.5).otherwise(0.3)

    def best(em_width: pd.Series, lines: pd.Series, gaps: pd.Series, width: pd.Series, height: pd.Series, high: pd.Series) -> pd.Series:
        w, ls, gs, right, bottom, top = (c.to_numpy(np.float64) for c in (em_width, lines, gaps, width, height, high))
        low, found = np.full(len(w), least), np.full(len(w), least)
        for _ in range(16):
            probe = (low + top) / 2
            px = np.maximum(1.0, np.rint(probe * dpi / 72.0))
            fits = (w * px <= right) & (ls * px + gs * px <= bottom)
            low, top, found = np.where(fits, probe, low), np.where(fits, top, probe), np.where(fits, probe, found)
        return pd.Series(found)

    sides = (em_width, n_lines * em_height, gap, width, height, high)
    return F.round(F.pandas_udf(best, "double")(*(c.cast("double") for c in sides)), 2)


def fit_texts(texts: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Add font_size_pt to texts (text, path, width, height): fitted where the font is at hand, else from the height alone."""
    found = measure(texts.where("path is not null"), table, keys)
    size = fit_size(*(F.col(c) for c in ("em_width", "em_height", "n_lines", "cjk", "width", "height")))
    rows = texts.join(found, keys, "left")
    blank = F.when(F.col("path").isNull(), fallback_font_size(F.col("height"))).otherwise(F.lit(10.0))
    return rows.select(*texts.columns, F.when(F.col("em_width").isNotNull(), size).otherwise(blank).alias("font_size_pt"))
