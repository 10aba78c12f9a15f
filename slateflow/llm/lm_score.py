"""Stupid-backoff scores against the corpus itself, computed relationally.

A bigram that at least two documents have scores ``c(p, w) / c(p)``; any other word backs off to ``ALPHA * c(w) / N``.
A document's first word follows the empty word, which counts once per document. Counts are the whole corpus's: a bigram
that one document alone has would vouch only for itself and so is not in the tables. Log scores are summed per document.

All of it is Catalyst's:

* One pass counts the words; the ``WORDS`` most frequent at most form a dictionary of small codes. A pair of two such words
  is one long, so that a line of the large exchange is a key and a document. The dictionary chooses encodings only.
* Bigrams that a sample of documents names as frequent (``HOT`` at most) are counted exactly in the same pass. Their lines are
  dealt by document and scored from a broadcast, so that no hot bigram meets in one task. The sample chooses the route only.
* All other bigrams are exploded and partitioned by hash: of the pair, or of its rare word. Where they meet they are
  counted, and so are the rare words, as each occurrence of a word ends one bigram. A pair of two rare words is sent
  to both. Scores are summed per document before and after the last, small exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, shuffle_width, stored, text_of

ALPHA = 0.4
#: Words with a code, and bigrams counted ahead of the exchange, at most; both are broadcast.
WORDS, HOT = 1 << 19, 1 << 16
#: One document in so many is sampled for candidates of HOT, which this many lines of the sample have at least.
SAMPLE, LEAST = 64, 3
#: The id that rows without one share.
NO_ID = -(1 << 63)
#: What a line of the exchange is: a pair of coded words, a hot bigram, one that ends or starts with a rare word, and the two lines of a pair of rare words.
CODED, BUSY, ENDS, STARTS, BOTH_END, BOTH_START = range(6)
#: Of the key's 64 bits, a pair of codes takes the top ones: beside the document's low bytes, all that varies in a line is then one run.
_P, _W, _MASK = 44, 24, (1 << 20) - 1


def bigrams(docs: DataFrame) -> DataFrame:
    """doc, p, w: hashes of each two successive words; the empty word stands before the first."""
    words = F.concat(F.array(F.lit("")), F.filter(F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    hashed = docs.select("doc", F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    pairs = F.arrays_zip(F.col("h").alias("p"), F.slice("h", 2, F.size("h")).alias("w"))
    return hashed.select("doc", F.inline(pairs)).where("w is not null")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the largest ``n``, ``most`` at most; counts within an eighth of an octave stand or fall together."""
    size = F.floor(F.log2("n") * 8)
    left, least = most, None
    for row in counts.groupBy(size.alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("size")).collect():  # 512 rows at most
        left -= row["rows"]
        if left < 0:
            break
        least = row["size"]
    return counts.where(size >= least) if least is not None else counts.where(F.lit(False))


def numbered(rows: DataFrame, key: str, name: str, parts: int = 64) -> DataFrame:
    """Add ``name``: 1, 2, ... over distinct keys, counted up within ``parts`` parts, of which none but their sizes meet."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n_part")).select("part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("before"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(key))
    return rows.join(F.broadcast(sizes), "part").withColumn(name, at.cast("long")).drop("part", "before")


def hot_candidates(docs: DataFrame) -> DataFrame:
    """pair, p, w: bigrams that several documents of the sample have, HOT at most."""
    sample = bigrams(docs.where(F.pmod(F.xxhash64("doc", "text"), F.lit(SAMPLE)) == 0))
    counted = sample.groupBy("p", "w").agg(F.count("*").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where(f"lo <> hi and n >= {LEAST}")
    return stored(most_frequent(stored(counted.select(F.xxhash64("p", "w").alias("pair"), "p", "w", "n")), HOT).select("pair", "p", "w"))


def count_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The dictionary (h, code, log_n), the hot bigrams (pair, hot, log_score), and the number of words."""
    candidates = hot_candidates(docs)
    pairs = bigrams(docs).withColumn("pair", F.xxhash64("p", "w")).join(F.broadcast(candidates.select("pair", F.lit(True).alias("hot"))), "pair", "left")
    unit = lambda kind, key: F.struct(F.lit(kind).cast("byte").alias("kind"), F.col(key).alias("key"))
    word, context, pair = unit(0, "w"), unit(1, "p"), unit(2, "pair")
    at_start = F.col("p") == F.xxhash64(F.lit(""))
    units = F.when(F.col("hot") & at_start, F.array(word, context, pair)).when(F.col("hot"), F.array(word, pair)).when(at_start, F.array(word, context)).otherwise(F.array(word))
    counts = stored(pairs.select(F.inline(units)).groupBy("kind", "key").agg(F.count("*").alias("n")))
    total = counts.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    top = most_frequent(counts.where("kind = 0").select(F.col("key").alias("h"), "n"), WORDS)
    log_n = F.log(F.col("n").cast("double")).alias("log_n")
    coded = numbered(top, "h", "code").select("h", "code", log_n)
    words = stored(coded.unionByName(counts.where("kind = 1").select(F.col("key").alias("h"), F.lit(0).cast("long").alias("code"), log_n)))
    hot = candidates.join(counts.where("kind = 2").select(F.col("key").alias("pair"), log_n), "pair")
    hot = hot.join(words.select(F.col("h").alias("p"), F.col("log_n").alias("log_p")), "p").join(words.select(F.col("h").alias("w")), "w")
    return words, stored(numbered(hot, "pair", "hot").select("pair", "hot", (F.col("log_n") - F.col("log_p")).alias("log_score"))), total


def exchange_lines(docs: DataFrame, words: DataFrame, hot: DataFrame) -> DataFrame:
    """key, doc, other, kind: a line for each occurrence of a bigram, two for a pair of rare words."""
    code = lambda c: F.broadcast(words.select(F.col("h").alias(c), F.col("code").alias(f"c{c}")))
    pairs = bigrams(docs).join(code("p"), "p", "left").join(code("w"), "w", "left").withColumn("pair", F.xxhash64("p", "w"))
    pairs = pairs.join(F.broadcast(hot.select("pair", "hot")), "pair", "left")
    line = lambda key, other, kind: F.struct(key.alias("key"), other.alias("other"), F.lit(kind).cast("byte").alias("kind"))
    p, w, cp, cw = (F.col(c) for c in ("p", "w", "cp", "cw"))
    lines = (
        F.when(F.col("hot").isNotNull(), F.array(line(F.col("doc"), F.col("hot"), BUSY)))
        .when(cp.isNotNull() & cw.isNotNull(), F.array(line(F.shiftleft(cp, _P) + F.shiftleft(cw, _W), F.lit(0).cast("long"), CODED)))
        .when(cp.isNotNull(), F.array(line(w, cp, ENDS)))
        .when(cw.isNotNull(), F.array(line(p, cw, STARTS)))
        .otherwise(F.array(line(w, p, BOTH_END), line(p, w, BOTH_START)))
    )
    return pairs.select("doc", F.inline(lines)).select("key", "doc", "other", "kind")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs), mean_log_score of each document.

    A document is all rows of one id: repeated ids are parts of one document, rows without an id are parts of another (no row
    may have the id -2^63), and one row is returned for each. Null texts count as empty; documents without words score 0.0 and
    have a null mean. No rows give no rows.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), text_of(text_col).alias("text"))
    words, hot, total = count_tables(docs)
    # as many partitions as keep a task's share of the input bounded
    lines = exchange_lines(docs, words, hot).repartition(max(shuffle_width(docs.sparkSession), 2 * docs.rdd.getNumPartitions()), "key")
    kind = F.col("kind")
    unit, bigram = Window.partitionBy("key"), Window.partitionBy("key", "kind", "other")
    met = lines.withColumn("n", F.count("*").over(bigram)).withColumn("seen", F.min("doc").over(bigram) < F.max("doc").over(bigram))
    met = met.withColumn("rare", F.count(F.when(kind.isin(ENDS, BOTH_END), 1)).over(unit))
    seen, first, second = F.col("seen"), F.shiftrightunsigned("key", _P), F.shiftrightunsigned("key", _W).bitwiseAND(F.lit(_MASK))
    # the one coded word whose count the line needs: the context if the bigram counts, else the word
    code = F.when(kind == CODED, F.when(seen, first).otherwise(second)).when(((kind == ENDS) & seen) | ((kind == STARTS) & ~seen), F.col("other"))
    met = met.withColumn("code", code).withColumn("hot", F.when(kind == BUSY, F.col("other")))
    met = met.join(F.broadcast(words.select("code", "log_n")), "code", "left").join(F.broadcast(hot.select("hot", "log_score")), "hot", "left")
    log_pair, log_rare, coded = F.log(F.col("n").cast("double")), F.log(F.col("rare").cast("double")), F.col("log_n")
    back = F.lit(math.log(ALPHA) - math.log(max(total, 1)))
    log_score = (
        F.when(kind == BUSY, F.col("log_score"))
        .when(kind == CODED, F.when(seen, log_pair - coded).otherwise(back + coded))
        .when(kind == ENDS, F.when(seen, log_pair - coded).otherwise(back + log_rare))
        .when(kind == STARTS, F.when(seen, log_pair - log_rare).otherwise(back + coded))
        .when(kind == BOTH_END, F.when(seen, log_pair).otherwise(back + log_rare))
        .otherwise(F.when(seen, -log_rare).otherwise(0.0))
    )
    scored = met.select("doc", log_score.alias("s"), F.when(kind == BOTH_START, 0).otherwise(1).alias("w"))
    summed = scored.unionByName(docs.select("doc", F.lit(0.0).alias("s"), F.lit(0).alias("w"))).groupBy("doc").agg(F.sum("w").alias("n_words"), F.sum("s").alias("log_score"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return summed.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "log_score", mean.alias("mean_log_score"))


def op7_stupid_backoff(spark, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    # sums of floating-point numbers depend on their order in the last digits
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE = {
    "op7_stupid_backoff": r"""
WITH d AS (SELECT doc_id, list_concat([''], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS h FROM documents),
b AS (SELECT doc_id, unnest(h[:-2]) AS p, unnest(h[2:]) AS w FROM d),
u AS (SELECT w, count(*) AS c FROM b GROUP BY w UNION ALL SELECT '', count(*) FROM b WHERE p = ''),
k AS (SELECT p, w, count(*) AS c, count(DISTINCT doc_id) AS docs FROM b GROUP BY p, w),
t AS (SELECT count(*) AS n FROM b),
s AS (SELECT b.doc_id, CASE WHEN k.docs > 1 THEN ln(k.c) - ln(up.c) ELSE ln(0.4) + ln(uw.c) - ln(t.n) END AS s
      FROM b JOIN k USING (p, w) JOIN u up ON up.w = b.p JOIN u uw ON uw.w = b.w, t),
g AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, round(coalesce(s, 0.0), 4) AS log_score, round(s / n, 6) AS mean_log_score
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id
"""
}
