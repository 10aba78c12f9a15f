"""Exact dedup: frequent digests leave on the map side, the rest through one shuffle.

A Misra-Gries style frequent-items sketch (Spark's ``approx_top_k``, kept per digest bucket so
that no single task merges all sketches) names candidates. A second, map-side combined pass
counts the candidates exactly and picks their winners; that table has at most
``BUCKETS * PER_BUCKET`` rows, so it is broadcast and the rows of a frequent digest never meet in
one task. All other digests go through an ordinary shuffle. The sketch only chooses the route:
a digest that it misses or names needlessly gets the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, stored, text_of

#: Digest buckets, each with its own sketch.
BUCKETS = 64
#: Candidates taken from a bucket's sketch, and counters the sketch keeps.
PER_BUCKET, COUNTERS = 32, 1024


def digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(text_of(text)), 256)


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def frequent_keys(rows: DataFrame, key: str) -> DataFrame:
    """At most ``BUCKETS * PER_BUCKET`` distinct values of ``key`` that may be frequent."""
    top = rows.groupBy(_bucket(key).alias("b")).agg(F.expr(f"approx_top_k({key}, {PER_BUCKET}, {COUNTERS})").alias("top"))
    return top.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias(key))


def resolve(rows: DataFrame, key: str = "digest", id_col: str = "doc_id", keep: str = "max") -> DataFrame:
    """Add keep_id, group_size and kept to ``rows`` (materialised, with ``id_col`` and ``key``).

    keep_id is the largest (``keep='max'``) or smallest id of the rows with one key; null ids lose
    to any other, and a group of null ids alone has a null keep_id. Exactly one row of each group
    is kept: of repeated rows with the winning id, one. No rows give no rows.
    """
    best = F.max if keep == "max" else F.min
    first = F.col(id_col).desc_nulls_last() if keep == "max" else F.col(id_col).asc_nulls_last()
    frequent = frequent_keys(rows, key)
    winners = rows.join(F.broadcast(frequent), key, "left_semi").groupBy(key).agg(best(id_col).alias("keep_id"), F.count("*").alias("group_size"))
    winners = cut(winners)
    tagged = rows.join(F.broadcast(winners), key, "left")
    hot = tagged.where("group_size is not null")
    losers = hot.where(~F.col(id_col).eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    one = Window.partitionBy(key).orderBy(first)
    holders = hot.where(F.col(id_col).eqNullSafe(F.col("keep_id"))).withColumn("kept", F.row_number().over(one) == 1)
    cold = rows.join(F.broadcast(winners.select(key)), key, "left_anti")
    whole = Window.partitionBy(key)
    cold = cold.select("*", best(id_col).over(whole).alias("keep_id"), F.count("*").over(whole).alias("group_size"), (F.row_number().over(one) == 1).alias("kept"))
    return losers.unionByName(holders).unionByName(cold)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Empty and null texts are equal to each other. See ``resolve`` for ties and repeated rows.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest")))
    return resolve(rows).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def _row_key(id_: Column, digest_: Column) -> Column:
    return F.concat_ws(":", digest_, id_.cast("string"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; the columns stay as they are, whatever their names.

    The decision goes back to the rows by id and digest in one exchange of the texts. Rows that repeat a kept id and
    text are one document and stay once; of several rows that differ in other columns alone, any one does.
    """
    kept = stored(exact_dedup(docs).where("kept").select(_row_key(F.col("doc_id"), F.col("text_sha256")).alias("key")))
    rows = docs.select(F.struct("*").alias("row"), _row_key(F.col("doc_id"), digest(F.col("text"))).alias("key"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = {
    "op2_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
}
