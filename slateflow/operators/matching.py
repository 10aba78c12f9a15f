"""Joins of recognised text with expected text, of boxes with results, and of edits with baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import same_geometry
from ..functions.text import tokens

#: A short key is looked up by its first characters, so many of them.
GRAM = 4


def last_result_join(detections: DataFrame, results: DataFrame, on: list[str], order: str) -> DataFrame:
    """Each detection with its last result; detections without one go."""
    last = Window.partitionBy(*on).orderBy(F.col(order).desc())
    only = results.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    return detections.join(only, on)


def number_in_ranges(rows: DataFrame, keys: list[str], order: str, width: int = 4096) -> DataFrame:
    """Add number: 1, 2, ... in ``order`` (whole numbers) within ``keys``; equal rows in any order.

    Ranges of ``width`` values are numbered apart and begin after what the ranges before them count, so that no group is sorted in one task.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy(F.col("_range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.struct(*keys, "_range").alias("_at"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_at").orderBy(order))
    found = ranged.withColumn("_at", F.struct(*keys, "_range")).withColumn("_inside", inside).join(starts, "_at")
    return found.select(*rows.columns, (F.col("_start") + F.col("_inside")).cast("int").alias("number"))


def kth_match(patches: DataFrame, shapes: DataFrame, on: list[str], patch_order: str, shape_order: str) -> DataFrame:
    """The k-th patch of a text with the k-th shape of that text, which is first-unused-wins matching."""
    rank = lambda df, o: df.withColumn("_k", F.row_number().over(Window.partitionBy(*on).orderBy(o)))
    return rank(patches, patch_order).join(rank(shapes, shape_order), [*on, "_k"]).withColumnRenamed("_k", "k")


def changed_boxes(edited: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Add change: new, kept (within a pixel) or moved."""
    joined = edited.alias("e").join(baseline.alias("b"), F.col(f"e.{key}") == F.col(f"b.{key}"), "left")
    change = F.when(F.col(f"b.{key}").isNull(), "new").when(same_geometry("e", "b"), "kept").otherwise("moved")
    return joined.select("e.*", change.alias("change"))


def assign_exclusively(scored: DataFrame, group: list[str], row: str, candidate: str, score: str, least: float) -> DataFrame:
    """Rows in order take the best-scoring expected text that no earlier row took; ties go to the earlier candidate.

    ``scored`` has a line per row and candidate of a group. A row whose best is under ``least`` (or 0) is reported with
    that best, not applied, and takes nothing. One fold over a group's rows, in the JVM.
    """
    options = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("loss"), F.col(candidate).alias("candidate"))))
    rows = scored.groupBy(*group, row).agg(options.alias("options"))
    groups = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(row).alias("row"), "options"))).alias("rows"))
    # earlier rows can take no more candidates than there are rows, so a row needs no more options than that
    few = F.size("rows")
    groups = groups.withColumn("rows", F.transform("rows", lambda r: F.struct(r["row"].alias("row"), F.slice(r["options"], 1, few).alias("options"))))
    kinds = {f.name: f.dataType.simpleString() for f in scored.schema.fields}
    start = F.struct(F.expr(f"cast(array() as array<{kinds[candidate]}>)").alias("used"), F.expr(f"cast(array() as array<struct<row:{kinds[row]},candidate:{kinds[candidate]},score:double,applied:boolean>>)").alias("out"))

    def step(acc, r):
        best = F.get(F.filter(r["options"], lambda o: ~F.array_contains(acc["used"], o["candidate"]) & (o["loss"] < 0)), F.lit(0))
        applied = F.coalesce(-best["loss"] >= least, F.lit(False))
        line = F.struct(r["row"].alias("row"), best["candidate"].alias("candidate"), F.coalesce(-best["loss"], F.lit(0.0)).cast("double").alias("score"), applied.alias("applied"))
        used = F.when(applied, F.concat(acc["used"], F.array(best["candidate"]))).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(line)).alias("out"))

    folded = groups.select(*group, F.explode(F.aggregate("rows", start, step)["out"]).alias("o"))
    return folded.select(*group, F.col("o.row").alias(row), F.col("o.candidate").alias(candidate), F.col("o.score").alias(score), F.col("o.applied").alias("applied"))


def token_matches(said: DataFrame, wanted: DataFrame, said_keys: list[str], wanted_keys: list[str], key: str = "key") -> DataFrame:
    """score of every pair of match keys that share a token or contain each other; all other pairs score 0 and aren't made.

    The score is the shared tokens over the larger token set, and 0.05 more where one key contains the other. ``said`` and ``wanted`` have ids
    (names that differ, one row an id) and ``key``. Shared tokens are counted where inverted lists meet; containment is looked up by a token that
    the longer key must have whole, or by the first characters of keys that may have none, and then checked.
    """
    a, b = (df.select(*ids, F.coalesce(key, F.lit("")).alias("_text")).where("_text <> ''").withColumn("_tokens", tokens(F.col("_text"))) for df, ids in ((said, said_keys), (wanted, wanted_keys)))
    ids = [*said_keys, *wanted_keys]
    lists = [df.select(*own, F.size("_tokens").alias(n), F.explode("_tokens").alias("_t")) for df, own, n in ((a, said_keys, "_na"), (b, wanted_keys, "_nb"))]
    # the pairs of one text meet in one task as long as the other side's lists are broadcast, and are summed up there
    shared = lists[0].join(lists[1], "_t").select(*ids, "_na", "_nb", F.lit(1).alias("_shared"), F.lit(0).alias("_in"))
    nothing = (F.lit(1).alias("_na"), F.lit(1).alias("_nb"), F.lit(0).alias("_shared"), F.lit(1).alias("_in"))
    inside = _contained(a, b, said_keys, wanted_keys).unionByName(_contained(b, a, wanted_keys, said_keys))
    summed = shared.unionByName(inside.select(*ids, *nothing)).groupBy(*ids).agg(F.sum("_shared").alias("_shared"), F.max("_na").alias("_na"), F.max("_nb").alias("_nb"), F.max("_in").alias("_in"))
    score = F.col("_shared") / F.greatest("_na", "_nb") + F.when(F.col("_in") == 1, 0.05).otherwise(0.0)
    return summed.select(*ids, score.alias("score"))


def _grams(text: Column, length: int) -> Column:
    """All runs of ``length`` characters, overlapping, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def _contained(short: DataFrame, long: DataFrame, short_keys: list[str], long_keys: list[str]) -> DataFrame:
    """Ids of pairs whose first text is part of the second. Of a text of three tokens or more the middle ones are tokens of any text around it."""
    words = F.filter(F.split("_text", " "), lambda t: t != "")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    # the longest is the rarest, as a rule; it decides about cost alone
    longest = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    probes = short.select(*short_keys, longest.alias("_t"), F.substring("_text", 1, GRAM).alias("_gram"))
    whole = probes.where("_t is not null").select(*short_keys, "_t").join(long.select(*long_keys, F.explode("_tokens").alias("_t")), "_t")
    few = probes.where("_t is null").select(*short_keys, "_gram", F.length("_gram").alias("_n"))
    # at most GRAM lengths; texts are cut into runs of the lengths that occur, so not at all where no text is short
    lengths = few.groupBy().agg(F.collect_set("_n").alias("l"))
    none = F.array().cast("array<string>")
    runs = F.concat(*(F.when(F.array_contains("_l", n), _grams(F.col("_text"), n)).otherwise(none) for n in range(1, GRAM + 1)))
    cut = long.select(*long_keys, "_text", lengths.scalar().alias("_l")).select(*long_keys, F.explode(F.array_distinct(runs)).alias("_gram"))
    pairs = whole.drop("_t").unionByName(few.join(cut, "_gram").select(*short_keys, *long_keys))
    texts = lambda df, keys, name: df.select(*keys, F.col("_text").alias(name))
    found = pairs.join(texts(short, short_keys, "_a"), short_keys).join(texts(long, long_keys, "_b"), long_keys)
    return found.where(F.contains("_b", "_a")).select(*short_keys, *long_keys)
