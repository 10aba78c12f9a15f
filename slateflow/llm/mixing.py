"""Mixing sources to target weights along a time-varying curriculum.

Each source has a piecewise-linear weight schedule over training time 0..1. Its integral is the
source's share; shares are cut at ``max_epochs`` times the source's size and the excess is shared
again by weight. A source's documents stand in a fixed pseudo-random order; the running sum of
their sizes is the token demand at which each is read, and the inverse of the integrated schedule
turns that demand into the training position. The running sum is taken in two levels (hash
buckets within a source, then rows within a bucket), so no source is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Weight classes by the source's rank, repeating: (time, weight) knots, linear in between; their integrals are 3, 1 and 2.
SCHEDULES = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)))
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
#: Rows that a bucket of a source's order has on average.
ROWS_PER_BUCKET = 2000
#: Multiplier and modulus of the order's hash of doc_id.
MULTIPLIER, MODULUS = 2654435761, 4294967296


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def integral(knots) -> float:
    return sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))


def invert_demand(share: Column, schedules, rank: Column) -> Column:
    """Training time at which a source with schedule number ``rank`` has used ``share`` (0..1) of its demand."""
    whole = []
    for knots in schedules:
        done, total, parts = 0.0, integral(knots), []
        for (t0, a), (t1, b) in zip(knots, knots[1:]):
            d = (t1 - t0) * (a + b) / 2 / total
            parts.append(F.struct(*(F.lit(float(x)).alias(n) for n, x in (("t0", t0), ("t1", t1), ("a", a / total), ("b", b / total), ("d0", done), ("d1", done + d)))))
            done += d
        whole.append(F.array(*parts))
    segments = F.element_at(F.array(*whole), (rank + 1).cast("int"))
    fitting = F.filter(segments, lambda s: share <= s["d1"])
    s = F.coalesce(F.get(fitting, F.lit(0)), F.element_at(segments, -1))
    slope = (s["b"] - s["a"]) / (s["t1"] - s["t0"])
    left = F.greatest(share - s["d0"], F.lit(0.0))
    # the stable root of slope/2 x^2 + a x = left
    step = 2 * left / (s["a"] + F.sqrt(F.greatest(s["a"] * s["a"] + 2 * slope * left, F.lit(0.0))))
    return F.least(s["t0"] + F.coalesce(step, F.lit(0.0)), s["t1"])


def targets(sizes: DataFrame, schedules=SCHEDULES, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, rank, target from one row (source, source_size) per source.

    Water filling in closed form: by rising size per weight, the sources before the first one whose
    fair level fits under its cap are the capped ones. Levels fall from there on, so the highest that
    fits is the one that all uncapped sources share.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    classes = F.array(*(F.lit(float(integral(k))) for k in schedules))
    rows = sizes.withColumn("rank", ((F.row_number().over(rank) - 1) % len(schedules)).cast("int"))
    rows = rows.withColumn("weight", F.element_at(classes, F.col("rank") + 1)).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped_before"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
    )
    rows = rows.withColumn("level", (F.lit(float(total_share)) * F.col("all_size") - F.col("capped_before")) / F.col("weight_left"))
    rows = rows.withColumn("water", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    capped = F.col("water").isNull() | (F.col("water") * F.col("weight") > F.col("cap"))
    return rows.select("source", "source_size", "rank", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def in_order(docs: DataFrame, schedules=SCHEDULES, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, rank, before: each row with the words of its source that are read before it."""
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    sizes = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")))
    aims = targets(sizes.select("source", "source_size"), schedules, total_share, max_epochs)
    aims = cut(aims.join(sizes.select(F.col("source").alias("s"), "n_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    spot = (F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2147483648)) * MULTIPLIER) % MODULUS
    buckets = F.ceil(F.col("n_rows") / ROWS_PER_BUCKET)
    with_aims = sized.withColumnRenamed("source", "src").join(aims, F.col("src").eqNullSafe(F.col("source"))).drop("src")
    with_aims = with_aims.withColumn("spot", spot).withColumn("bucket", F.floor(F.col("spot") * buckets / MODULUS))
    per_bucket = with_aims.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("source", "bucket").orderBy("spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = with_aims.withColumn("upto", F.sum("size").over(inside))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    before = F.col("bucket_start") + F.col("upto") - F.col("size")
    return placed.select("doc_id", "source", "size", "source_size", "target", "rank", before.alias("before"))


def readings(rows: DataFrame, schedules=SCHEDULES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add taken (words, repeats counted) and positions (training time of each reading) to rows of ``in_order``."""
    budget, before = F.floor("target").cast("long"), F.col("before")
    passes = F.array(*(F.struct(F.lit(p).alias("p"), F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - before - p * F.col("source_size"))).alias("n")) for p in range(max_epochs)))
    read = F.filter(passes, lambda x: x["n"] > 0)
    taken = F.aggregate(passes, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    when = F.transform(read, lambda x: invert_demand((before + x["p"] * F.col("source_size") + x["n"] / 2) / F.col("target"), schedules, F.col("rank")))
    return rows.select("*", taken.alias("taken"), when.alias("positions"))


def mix(docs: DataFrame, schedules=SCHEDULES, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, positions.

    ``taken`` counts words with repeats: the document is read whole in each pass over its source,
    but for the one document per source on which the budget ends, read in part. ``positions`` has
    the training time of each reading. Null sources form one source, ranked last; documents without
    words take nothing and have no position; equal rows split what falls to them in any order; an empty
    table gives no rows.
    """
    return readings(in_order(docs, schedules, total_share, max_epochs), schedules, max_epochs).drop("rank", "before")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix reads them: once per reading, range-sorted by training position.

    The reading on which a source's budget ends has its text cut after the words taken, and n_chars
    follows; documents that the mix doesn't take go. Columns stay as they are, whatever their names. Rows that agree in
    id, source and size stand side by side in the order and are read one after the other, in any order.
    """
    key = F.struct("doc_id", "source", "size").alias("key")
    plan = in_order(docs).groupBy(key).agg(F.min("before").alias("start"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("rank").alias("rank"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size")).select("row", "size", key)
    # the join's partitioning and order serve the numbering
    rows = rows.join(plan, "key").withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1))))
    rows = readings(rows.withColumn("before", F.col("start") + (F.col("number") - 1) * F.col("size"))).where("taken > 0")
    full = F.floor(F.col("taken") / F.col("size")).cast("int")
    rows = rows.select("row", "size", "taken", full.alias("full"), F.posexplode("positions").alias("pass", "position"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    part = F.array_join(F.slice(words, 1, (F.col("taken") - F.col("pass") * F.col("size")).cast("int")), "")
    cut_short = F.col("pass") >= F.col("full")
    row = F.col("row").withField("text", F.when(cut_short, part).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(cut_short, F.char_length(part).cast(kind)).otherwise(F.col("row.n_chars")))
    keys = [F.col("position"), F.col("row.doc_id")]
    return rows.select("position", row.alias("row")).repartitionByRange(*keys).sortWithinPartitions(*keys).select("row.*")


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    first = mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))
    keys = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return first.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = {
    "op1_source_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  ((coalesce(doc_id, 0) % 2147483648) * 2654435761) % 4294967296 AS spot FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2 AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
                 - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
                / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
w AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN water IS NULL OR water * weight > cap THEN CAST(cap AS DOUBLE) ELSE water * weight END AS target FROM w),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.spot, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, budget - before)) + greatest(0, least(size, budget - before - source_size)) AS BIGINT) AS taken
FROM p
"""
}
