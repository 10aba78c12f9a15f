"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of an LZ78 dictionary: each phrase is the shortest run of
characters not yet in it. The phrases' hashes form a set, the smallest ``K`` of which are the
document's minimum-hash signature; the overlap of two signatures estimates the likeness of the
phrase sets (the Lempel-Ziv Jaccard distance), which stands for compressing one text by the other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import cut, shuffle_width, text_of

#: Values in a signature.
K = 64
#: A dictionary entry is its parent's number times this, plus the code point that it adds.
_CODES = 1 << 21
_STEP, _SALT = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)


def parse(text: str, entries: dict[int, int], state: int = 0) -> int:
    """Add the phrases of ``text`` to ``entries``; returns the open phrase's.

    The dictionary is a trie: an entry's key is (parent, code point), its value its own number, shifted by the code points.
    Reading a text in parts, with the state handed on, gives the phrases of the whole.
    """
    get, node, fresh = entries.get, state, (len(entries) + 1) * _CODES
    for c in map(ord, text):
        key = node | c
        found = get(key)
        if found is None:
            entries[key] = fresh
            fresh += _CODES
            node = 0
        else:
            node = found
    return node


def keys_of(entries: dict[int, int]) -> np.ndarray:
    return np.fromiter(entries, np.int64, len(entries))


def phrase_hashes(keys: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """64-bit hashes of the phrases of several dictionaries, laid end to end; ``roots`` has, for each phrase, where its dictionary begins.

    A phrase's hash is a polynomial in its code points. Each step joins a phrase's last part to the part before it, so that
    the longest phrase needs as many steps as its length has bits.
    """
    parent = keys >> 21
    # 0 is the beginning of every dictionary, n + 1 phrase n
    up = np.concatenate(([0], np.where(parent > 0, parent + roots, 0)))
    value = np.concatenate((np.zeros(1, np.uint64), W.mix64((keys & (_CODES - 1)).astype(np.uint64) + _SALT)))
    scale = np.full(len(up), _STEP)
    scale[0] = 1
    while up.any():
        value += value[up] * scale
        scale = scale * scale[up]
        up = up[up]
    return W.mix64(value[1:])


def signatures(dictionaries: list[np.ndarray]) -> list[np.ndarray]:
    """Of each dictionary (its keys, in order) the ``K`` smallest distinct 32-bit hashes, ascending."""
    sizes = np.array([len(d) for d in dictionaries], np.int64)
    if not sizes.sum():
        return [np.zeros(0, np.uint32) for _ in dictionaries]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    hashes = phrase_hashes(np.concatenate(dictionaries), np.repeat(np.cumsum(sizes) - sizes, sizes))
    values = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
    starts = np.searchsorted(values >> np.uint64(32), np.arange(len(sizes) + 1, dtype=np.uint64))
    low = values.astype(np.uint32)
    return [low[a : min(a + K, b)] for a, b in zip(starts[:-1], starts[1:])]


def likenesses(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Jaccard estimates, pair by pair, over the ``K`` smallest values of each union; 1 for two empty texts."""
    nothing = np.uint64(1 << 32)
    both = np.full((len(a), 2 * K), nothing)
    for i, (x, y) in enumerate(zip(a, b)):
        both[i, : len(x)] = x
        both[i, K : K + len(y)] = y
    both.sort(axis=1)
    real = both < nothing
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, axis=1)
    low = np.minimum(rank[:, -1], K)
    return np.where(low > 0, (again & (rank <= K)).sum(1) / np.maximum(low, 1), 1.0)


def as_hex(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def fingerprint_text(text: str) -> np.ndarray:
    entries: dict[int, int] = {}
    parse(text, entries)
    return signatures([keys_of(entries)])[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint (hex) of each row; a null text counts as empty, whose fingerprint is empty."""

    def run(batches):
        for batch in batches:
            row = 0
            for texts in W.text_slices(batch.column(1)):
                found = []
                for t in texts:
                    entries: dict[int, int] = {}
                    parse(t, entries)
                    found.append(keys_of(entries))
                marks = [as_hex(s) for s in signatures(found)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(marks, pa.string())], ["doc_id", "n_chars", "fingerprint"])
                row += len(texts)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def in_order_with_next(docs: DataFrame, width: int) -> DataFrame:
    """Rows (part, ghost, doc_id, text), partition by partition in descending doc_id, rows without an id last and in the order of a hash.

    Ids are dealt to ``width`` ranges by approximate quantiles, rows without one to ranges of the hash, as many as their share
    asks for. The first document of each range is also sent, as a ghost, to the end of the range before it (of the first
    range, to the last), so that each row's successor is in its partition.
    """
    keyed = docs.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    ids = keyed.select("doc_id", "spread")
    none = F.array().cast("array<long>")
    marks = F.percentile_approx("doc_id", [i / width for i in range(1, width)], 20 * width) if width > 1 else none
    bounds = cut(ids.agg(F.coalesce(marks, none).alias("bounds"), F.count("*").alias("n"), F.count("spread").alias("missing")))
    n, missing = bounds.select("n", "missing").first()
    more = -(-width * missing // n) if missing else 0
    # one row of ``width`` - 1 numbers
    by_id = F.lit(width - 1) - F.size(F.filter("bounds", lambda b: b < F.col("doc_id")))
    by_hash = F.lit(width) + F.least(F.lit(more - 1), F.floor((F.col("spread") / F.lit(2.0**64) + 0.5) * more))
    at = (F.when(F.col("doc_id").isNull(), by_hash) if more else F.when(F.lit(False), F.lit(0))).otherwise(by_id).cast("int")
    firsts = ids.crossJoin(F.broadcast(bounds)).groupBy(at.alias("part")).agg(F.max("doc_id").alias("first"), F.min("spread").alias("first_spread"))
    # one row per range
    before = F.lag("part").over(Window.orderBy("part"))
    last = F.max("part").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ghosts = cut(firsts.select("first", "first_spread", F.coalesce(before, last).alias("to")))
    tagged = keyed.crossJoin(F.broadcast(bounds)).withColumn("part", at).drop("bounds", "n", "missing")
    tagged = tagged.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("first")) & F.col("spread").eqNullSafe(F.col("first_spread")), "left")
    here = F.struct(F.col("part").alias("part"), F.lit(0).alias("ghost"))
    copies = F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("to").alias("part"), F.lit(1).alias("ghost"))))
    rows = tagged.select(F.explode(copies).alias("c"), "doc_id", "spread", "text").select("c.part", "c.ghost", "doc_id", "spread", "text")
    dealt = rows.repartitionById(width + more, F.col("part"))
    return dealt.sortWithinPartitions("ghost", F.col("doc_id").desc_nulls_last(), "spread", F.col("text").desc()).drop("spread")


def compare_with_edits(docs: DataFrame, width: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last third (rounded down) replaced by the beginning of the
    next document. Order: descending doc_id, rows without an id last, by a hash of their texts; rows of one id by text,
    descending; the last row's next is the first. Repeated rows are each other's next. Null texts count as empty, and two empty texts are alike (1.0). Each text is parsed once;
    the edited one resumes the parse at the cut.
    """
    width = width or shuffle_width(docs.sparkSession)
    rows = in_order_with_next(docs.select("doc_id", text_of("text").alias("text")), width)

    def run(batches):
        last = None  # the last row whose successor hasn't come yet: doc_id, text
        waiting = None  # the last closed row, which lacks near_next: its columns and its signature
        ended = False  # the first ghost closes the partition; others are copies of it or of its id
        for batch in batches:
            if ended:
                continue
            ids, ghosts, row = batch.column(2).to_pylist(), batch.column(1).to_pylist(), 0
            for texts in W.text_slices(batch.column(3)):
                if ended:
                    break
                here = list(zip(ids[row : row + len(texts)], texts, ghosts[row : row + len(texts)]))
                row += len(texts)
                closed, own, changed = [], [], []
                for doc_id, text, ghost in here:
                    if last is not None:
                        mine, edited = _dictionaries(last[1], text)
                        own.append(mine)
                        changed.append(edited)
                        third = len(last[1]) // 3
                        sha = hashlib.sha256((last[1][: len(last[1]) - third] + text[:third]).encode("utf-8", "surrogatepass")).hexdigest()
                        closed.append((last[0], len(last[1]), sha))
                    last = (doc_id, text)
                    if ghost:
                        # nothing comes after the row that only closes the one before it
                        closed.append((doc_id, len(text), None))
                        own.append(_dictionaries(text, "")[0])
                        changed.append(own[-1])
                        ended = True
                        break
                if closed:
                    a, b = signatures(own), signatures(changed)
                    lines = [(*c, as_hex(x), as_hex(y), float(n)) for c, x, y, n in zip(closed, a, b, likenesses(a, b))]
                    if waiting is not None:
                        lines, a = [waiting[0], *lines], [waiting[1], *a]
                    waiting = (lines[-1], a[-1])
                    done = [(*line, float(n)) for line, n in zip(lines[:-1], likenesses(a[:-1], a[1:]))]
                    if done:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), _KINDS)], _NAMES)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _dictionaries(text: str, following: str) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a text's dictionary and of its edited text's, which resumes the parse where the last third begins."""
    third = len(text) // 3
    entries: dict[int, int] = {}
    state = parse(text[: len(text) - third], entries)
    shared = len(entries)
    parse(text[len(text) - third :], entries, state)
    mine = keys_of(entries)
    if not third:
        return mine, mine
    for _ in range(len(entries) - shared):
        entries.popitem()
    parse(following[:third], entries, state)
    return mine, keys_of(entries)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def op4_lz_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
