"""Repair of recognised text against expected texts, and where expected texts come from."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DIGITS_BONUS, RATIO_SHARE, TOKENS_SHARE, clean, clean_lines, containment, digit_list, match_key, overlap, tokens

#: Least similarity from which on a text is replaced.
MIN_SCORE = 0.74


def fold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def distinct_texts(texts: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """The cleaned, non-blank texts of each slide, the first of each folded text, in order (``order`` stays)."""
    rows = texts.select(*keys, order, clean(F.col(text)).alias("text")).where("text <> ''").withColumn("_fold", fold(F.col("text")))
    # a minimum is combined before the shuffle
    return rows.groupBy(*keys, "_fold").agg(F.min(F.struct(order, "text")).alias("_first")).select(*keys, f"_first.{order}", "_first.text")


def replaced_lines(lines: Column, corrected: Column) -> Column:
    """Lines (text and more) of a result whose text has become ``corrected``: one line takes it whole, as many take one each, else none is left."""
    texts = clean_lines(corrected)
    with_text = lambda line, text: line.withField("text", text)
    one = F.transform(lines, lambda line: with_text(line, corrected))
    each = F.zip_with(lines, texts, with_text)
    return F.when((F.size(lines) == 1) & (F.size(texts) <= 1), one).when(F.size(texts) == F.size(lines), each).otherwise(F.slice(lines, 1, 0))


def correct(results: DataFrame, expected: DataFrame, keys: list[str], order: str, expected_order: str, least: float = MIN_SCORE) -> DataFrame:
    """``results`` (text, and lines if there are) with corrected_text, expected_text, match_score and applied.

    Results in ``order`` take the most similar expected text of their slide (``keys``) that none before them took, if it is similar enough;
    otherwise the best one left is reported. Blank results match nothing. Expected texts are made distinct first.
    """
    wanted = distinct_texts(expected, keys, expected_order).select(*keys, F.col(expected_order).alias("_candidate"), F.col("text").alias("_wanted"))
    said = results.select(*keys, order, F.coalesce(match_key(F.col("text")), F.lit("")).alias("_key"))
    chosen = assign_similar(said, wanted.withColumn("_key", match_key(F.col("_wanted"))), keys, order, "_candidate", least)
    chosen = chosen.join(wanted, [*keys, "_candidate"], "left")
    rows = results.join(chosen.select(*keys, order, "_wanted", "score", "applied"), [*keys, order], "left")
    corrected = F.when(F.col("applied"), F.col("_wanted")).otherwise(F.col("text"))
    out = [F.col(c) for c in results.columns if c != "lines"]
    if "lines" in results.columns:
        out.append(F.when(F.col("applied") & F.col("lines").isNotNull(), replaced_lines(F.col("lines"), F.col("_wanted"))).otherwise(F.col("lines")).alias("lines"))
    return rows.select(*out, corrected.alias("corrected_text"), F.col("_wanted").alias("expected_text"), F.col("score").alias("match_score"), "applied")


def assign_similar(said: DataFrame, wanted: DataFrame, keys: list[str], order: str, candidate: str, least: float) -> DataFrame:
    """``matching.assign_exclusively`` over ``text.similarity`` of all pairs of a slide's match keys (``_key``), without making the pairs.

    A slide's texts meet in one row. What the tokens, digits and containment of a pair give is computed there natively; a task then runs the
    costly ratio only of candidates that can still win by a bound. Columns: ``keys``, order, candidate, score, applied.
    """
    parts = lambda *own: (*own, F.col("_key").alias("key"), tokens(F.col("_key")).alias("t"), digit_list(F.col("_key")).alias("d"))
    # a number asked for isn't made smaller by the bytes: ratios cost far more than their texts weigh; the grouping and the join keep it
    parallel = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said, wanted = (df.repartition(parallel, *keys) for df in (said, wanted))
    rows = said.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*parts(F.col(order).alias("id"))))).alias("rows"))
    items = wanted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*parts(F.col(candidate).alias("id"))))).alias("items"))
    digits = lambda a, b: F.when((F.size(a["d"]) > 0) & (a["d"] == b["d"]), DIGITS_BONUS).otherwise(0.0)
    known = lambda a, b: F.array(overlap(a["t"], b["t"]) * TOKENS_SHARE, digits(a, b) + containment(a["key"], b["key"]))
    slides = rows.join(items, keys, "left").withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))
    slides = slides.withColumn("known", F.transform("rows", lambda r: F.transform("items", lambda i: known(r, i))))
    slides = slides.select(*keys, F.col("rows.id").alias("ids"), F.col("items.id").alias("candidates"), F.col("rows.key").alias("said"), F.col("items.key").alias("wanted"), "known")
    passed = [*keys, "ids", "candidates"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slides.schema.fields if f.name in passed)
    out = pa.list_(pa.struct([("at", pa.int32()), ("score", pa.float64()), ("applied", pa.bool_())]))

    def run(batches):
        for batch in batches:
            found = [choose(*(batch.column(c)[i].as_py() for c in ("said", "wanted", "known")), least)[0] for i in range(batch.num_rows)]
            chosen = pa.array([[dict(zip(("at", "score", "applied"), line)) for line in lines] for lines in found], out)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), chosen], [*passed, "chosen"])

    found = slides.mapInArrow(run, f"{kinds}, chosen array<struct<at: int, score: double, applied: boolean>>")
    found = found.select(*keys, "candidates", F.explode(F.arrays_zip("ids", "chosen")).alias("z"))
    return found.select(*keys, F.col("z.ids").alias(order), F.get("candidates", F.col("z.chosen.at")).alias(candidate), F.col("z.chosen.score").alias("score"), F.col("z.chosen.applied").alias("applied"))


def choose(said: list[str], wanted: list[str], known: list[list[list[float]]], least: float) -> tuple[list[tuple[int | None, float, bool]], int]:
    """Of each text in order its best candidate that none before took (of equal ones the first), the score and whether it is taken; and the ratios run.

    Texts share at most the characters that both histograms have, so no ratio is above what these give. Candidates are tried from the highest
    bound on, until no bound reaches the best score.
    """
    counts = {t: np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) & 255, minlength=256) for t in {*said, *wanted}}
    table = np.array([counts[t] for t in wanted]).reshape(-1, 256)
    lengths = np.array([len(t) for t in wanted])
    matchers: dict[int, SequenceMatcher] = {}  # each keeps what it learned of its second text
    used: set[int] = set()
    out, ratios = [], 0
    for text, extra in zip(said, known):
        best = (0.0, None)
        if text and wanted:
            bounds = 2.0 * np.minimum(table, counts[text]).sum(axis=1) / (lengths + len(text))
            upper = [0.0 if not w else 1.0 if w == text else min(1.0, u * RATIO_SHARE + tokens_part + bonus) for w, u, (tokens_part, bonus) in zip(wanted, bounds.tolist(), extra)]
            for j in sorted(set(range(len(wanted))) - used, key=lambda j: (-upper[j], j)):
                if upper[j] <= 0 or upper[j] < best[0]:
                    break
                if wanted[j] == text:
                    score = 1.0
                else:
                    if j not in matchers:
                        matchers[j] = SequenceMatcher(None, "", wanted[j])
                    matchers[j].set_seq1(text)
                    ratios += 1
                    score = min(1.0, matchers[j].ratio() * RATIO_SHARE + extra[j][0] + extra[j][1])
                if score > best[0] or (score == best[0] > 0 and best[1] is not None and j < best[1]):
                    best = (score, j)
        applied = best[1] is not None and best[0] >= least
        if applied:
            used.add(best[1])
        out.append((best[1], best[0], applied))
    return out, ratios


def plan_texts(plans: DataFrame, keys: list[str]) -> DataFrame:
    """Expected texts (``keys``, slide_number, ordinal, text) of deck plans: of each slide number the first entry's title, subtitle, copy and points.

    ``plans`` has ``slides``, an array of (slide_number, title, subtitle, on_slide_copy, quantified_points).
    """
    entries = plans.select(*keys, F.posexplode("slides").alias("_at", "s")).select(*keys, "_at", "s.*")
    first = Window.partitionBy(*keys, "slide_number").orderBy("_at")
    entries = entries.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    nothing = F.array().cast("array<string>")
    texts = F.concat(F.array(F.coalesce("title", F.lit("")), F.coalesce("subtitle", F.lit(""))), F.coalesce("on_slide_copy", nothing), F.coalesce("quantified_points", nothing))
    rows = entries.select(*keys, "slide_number", F.posexplode(texts).alias("ordinal", "text"))
    return distinct_texts(rows, [*keys, "slide_number"], "ordinal")
