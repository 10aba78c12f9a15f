"""Line dedup: a line that several documents share stays in one of them.

Hashes of the lines' keys are range-partitioned together with document and position, and each partition is sorted by
all three, so that a key's documents come from the largest id down. One pass streams a partition: the first document
of a key is its holder, and once the third has come, all but the holder's lines go. A frequent key spreads over as
many partitions as it fills; only the first key of a partition can have begun in an earlier one, and only the last can
go on in a later one, so the lines of those wait, and at most three documents a partition stand witness for them. The
witnesses, at most six rows a partition, decide what waits.

What comes out is no text but, for each document, a compressed bitmap of the lines that stay.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .common import ascii_lower, shuffle_width, stored, text_of

#: Stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: Shortest key (code points) that can be dropped, and the documents that must hold it.
LEAST_CHARS, LEAST_DOCS = 20, 3
_DROP, _OPEN, _WITNESS = 0, 1, 2


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds what names a document (known, id) and, with a hash of its text, a row; equal rows have equal names and results."""
    id_ = F.col(id_col).cast("long")
    text = text_of(text_col)
    return docs.select(F.struct("*").alias("row"), id_.isNotNull().alias("known"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def dropped_lines(rows: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """known, id, mark, positions (ascending, from 0) of each of ``rows`` (known, id, mark, text) that loses lines."""
    width = shuffle_width(rows.sparkSession)
    lines = rows.select("known", "id", "mark", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = line_key(F.col("line"))
    # 128 bits: 64 would make different lines equal at the size of a web corpus
    hashed = lines.where(F.char_length(key) >= least_chars).select(F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"), "known", "id", "mark", "pos")
    order = [F.col("h1"), F.col("h2"), F.col("known").desc(), F.col("id").desc(), F.col("pos")]

    def run(batches):
        yield from _stream(batches, least_docs)

    kinds = "kind int, h1 long, h2 long, known boolean, id long, mark long, pos int"
    found = stored(hashed.repartitionByRange(width, *order).sortWithinPartitions(*order).mapInArrow(run, kinds))
    names = F.struct("known", "id")
    # at most two keys of a partition have witnesses, with at most ``least_docs`` each
    shared = found.where(F.col("kind") == _WITNESS).groupBy("h1", "h2").agg(F.max(names).alias("holder"), F.size(F.collect_set(names)).alias("n")).where(F.col("n") >= least_docs)
    waiting = found.where(F.col("kind") == _OPEN).join(F.broadcast(shared), ["h1", "h2"]).where(names != F.col("holder"))
    gone = found.where(F.col("kind") == _DROP).select("known", "id", "mark", "pos").unionByName(waiting.select("known", "id", "mark", "pos"))
    return gone.distinct().groupBy("known", "id", "mark").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def _stream(batches, least_docs: int):
    """Lines to drop, lines that wait for other partitions, and their witnesses, from one sorted partition."""
    names = ["kind", "h1", "h2", "known", "id", "mark", "pos"]
    first = last = None  # keys of the partition's first line and of the line before
    doc, rank = None, 0  # the document of the line before, and how many its key has had
    witnesses = {}  # key: its first documents, for the first and the latest key
    held: list[pa.RecordBatch] = []  # lines of the latest key's documents after the first, until enough have come

    def out(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, kind, np.int32)), *rows.columns], names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2, id_ = (batch.column(i).to_numpy() for i in (0, 1, 3))
        known = batch.column(2).to_numpy(zero_copy_only=False)
        new_key = np.ones(n, bool)
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_key[0] = last != (h1[0], h2[0])
        new_doc = new_key.copy()
        new_doc[1:] |= (id_[1:] != id_[:-1]) | (known[1:] != known[:-1])
        new_doc[0] |= doc != (known[0], id_[0])
        if first is None:
            first = (h1[0], h2[0])
        # how many documents the key of each line has had so far
        met = np.cumsum(new_doc) + rank
        group = np.cumsum(new_key)  # 0: the key of the batch before
        starts = np.flatnonzero(new_key)
        base = np.concatenate(([0], met[starts] - 1))
        ranks = met - base[group]
        most = np.zeros(group[-1] + 1, np.int64)
        np.maximum.at(most, group, ranks)
        in_first = (h1 == first[0]) & (h2 == first[1])
        enough = most[group] >= least_docs
        if new_key[0] or most[0] >= least_docs:  # the key held over has ended, or has enough
            if not new_key[0] and (h1[0], h2[0]) != first:
                for rows in held:
                    yield out(rows, _DROP)
            held = []
        yield out(batch.filter(pa.array(in_first)), _OPEN)
        yield out(batch.filter(pa.array(~in_first & enough & (ranks > 1))), _DROP)
        ends = group == group[-1]
        if most[-1] < least_docs and not in_first[-1]:
            held.append(batch.filter(pa.array(ends & (ranks > 1))))
        latest = (h1[-1], h2[-1])
        for key in {first, latest}:
            mine = np.flatnonzero(new_doc & (h1 == key[0]) & (h2 == key[1]))
            witnesses[key] = (witnesses.get(key, []) + [(known[i], id_[i]) for i in mine[:least_docs]])[:least_docs]
        witnesses = {k: v for k, v in witnesses.items() if k in (first, latest)}
        last, doc, rank = latest, (known[-1], id_[-1]), int(ranks[-1])
    for rows in held:
        yield out(rows, _OPEN)
    seen = [(_WITNESS, int(k[0]), int(k[1]), bool(d[0]), int(d[1]), 0, 0) for k, docs in witnesses.items() for d in docs]
    if seen:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*seen), kinds)], names)


def bitmap(n_lines: int, dropped) -> bytes:
    """The lines that stay as bits, first line first, compressed by zlib."""
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(text: str, keep: bytes) -> str:
    """The lines of ``text`` whose bits in ``keep`` are set, joined."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, bit in zip(lines, bits) if bit)


@F.pandas_udf(BinaryType())
def _bitmaps(n_lines: pd.Series, positions: pd.Series) -> pd.Series:
    return pd.Series([bitmap(n, [] if p is None else p) for n, p in zip(n_lines, positions)])


@F.pandas_udf(StringType())
def _kept_texts(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else kept_lines(t, k) for t, k in zip(text, keep)])


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (the columns of ``docs``), text, n_lines, n_dropped, keep for each row of ``docs``.

    Null texts count as empty, which is one empty line. Rows that share an id are one document, and rows without an id
    are one too, which holds a key only where no other does. The holder keeps every occurrence of a line. An empty
    table gives no rows; columns may have any names.
    """
    rows = _identified(docs, id_col, text_col)
    key = ["known", "id", "mark"]
    gone = dropped_lines(rows.select(*key, "text"))
    sized = rows.withColumn("n_lines", F.size(lines_of(F.col("text"))).cast("long"))
    both = sized.join(gone, key, "left")
    return both.select("row", "text", "n_lines", F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"), _bitmaps("n_lines", "positions").alias("keep"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, keep of each row of ``docs`` (see ``with_bitmaps``); no text is moved."""
    return with_bitmaps(docs, id_col, text_col).select(F.col(f"row.{id_col}").alias("doc_id"), "n_lines", "n_dropped", "keep")


def kept_text() -> Column:
    """The text that stays of rows of ``with_bitmaps``; only those that lose lines go through Python."""
    changed = F.col("n_dropped") > 0
    return F.when(changed, _kept_texts(F.when(changed, F.col("text")), F.col("keep"))).otherwise(F.col("text"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines dropped from their texts; the columns stay as they are, and n_chars follows. Texts that lose nothing stay null where null."""
    rows = with_bitmaps(docs).withColumn("kept", kept_text())
    changed = F.col("n_dropped") > 0
    row = F.col("row").withField("text", F.when(changed, F.col("kept")).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(changed, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return rows.select(row.alias("row")).select("row.*")


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    rows = with_bitmaps(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_lines", "n_dropped", F.sha2(kept_text(), 256).alias("kept_sha256"))


ORACLE = {
    "op12_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keyed.*, holder IS NOT NULL AND holder <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
}
