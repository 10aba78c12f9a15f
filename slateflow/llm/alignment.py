"""Cross-tokenizer alignment: which tokens of two vocabularies share bytes, and how often over the corpus.

Two tokenisations of a text cut the same bytes. Where a space stands between two other characters both always cut, so a
text falls into units whose alignment doesn't depend on their neighbours, and a worker remembers the units it has met.

Counting spills. Each task gathers pair-document records (the ids of a linked pair, a document, how many links) into
buffers of bounded size, sorts a buffer by radix of the B id, B id, A id and document, and writes one zstd run a
radix. Of each run the sums by pair are kept too; a k-way merge through a heap of block heads adds them up, first a
task's, then, in rounds of at most ``FAN_IN`` runs a task, those of all tasks. Merged sums come in B-major order, so a
B id's highest count stands when its pairs end. Then every run meets its radix's counts and sends back, for each
document of its buffer, the sum of counts and the number of best links; a buffer's answers add up to its documents'.

No pair of documents meets, a frequent pair is one record a document, and no table of pairs is larger than a radix's
share of the two vocabularies' product.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, stored, text_of
from .packing import _gather, _Numbers
from .words import text_slices

VOCABULARY_A, RANKS_A, VOCABULARY_B = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Bits of the B id that choose the radix.
RADIX_BITS = 5
RADICES = 1 << RADIX_BITS
#: Links gathered before a buffer is written, and documents of one buffer.
LINKS, DOCUMENTS = 1 << 20, 60_000
#: Pairs of a block of a run of sums, pairs gathered before a merge gives some out, and runs merged by one task.
BLOCK, PENDING, FAN_IN = 4096, 1 << 17, 256
#: Units that a worker remembers, code points of the longest that others are encoded with, and units encoded together.
REMEMBERED, LONGEST, TOGETHER = 150_000, 200, 2000

#: A space that both vocabularies cut before: no white space stands beside it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Text in which a space stands beside white space or at an end.
_LOOSE = re.compile(r" (?:\s|\Z)|\s ")


class Vocabularies:
    """Ids of both vocabularies and the bytes of each id."""

    def __init__(self, path_a: str, ranks_a: str, path_b: str):
        import base64

        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(ranks_a, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole_a = Tokenizer.from_file(path_a)
        self.whole_a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.decimal = {sep: np.array([f"{i}{sep}" for i in range(n)], f"S{len(str(n)) + 1}") for sep in ",|;"}
        self.digits = np.array([len(str(i)) for i in range(n)], np.int64)

    def ids_a(self, text: str) -> np.ndarray:
        """Of a text with its space before it. The fast encoder's time grows with the square of a run without white space (or of it)."""
        if len(text) > LONGEST and max(map(len, re.findall(r"\S+|\s+", text))) > LONGEST:
            return np.array(self.whole_a.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.fast_a.encode_ordinary(text), np.int64)

    def ids_b(self, text: str) -> np.ndarray:
        """Of the same text; the encoder adds the space."""
        return np.array(self.b.encode(text[1:]), np.int64)


class Units:
    """A memory of units: token and group counts, links as pairs (B id << 16 | A id), and groups as text."""

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.counts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.bad = np.zeros(0, bool)
        self.starts, self.pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.groups: list[bytes] = []

    def learn(self) -> None:
        """Align the units numbered since the last call."""
        new, self.known.fresh = self.known.fresh, []
        found: list[tuple | None] = [None] * len(new)
        # units that end in white space or hold the mark of spaces depend on what stands beside them
        plain = [i for i, u in enumerate(new) if u and len(u) <= LONGEST and not u[0].isspace() and not u[-1].isspace() and "▁" not in u]
        for at in range(0, len(plain), TOGETHER):
            part = plain[at : at + TOGETHER]
            for i, x in zip(part, self.aligned([new[i] for i in part])):
                found[i] = x
        for i, x in enumerate(found):
            if x is None:
                found[i] = self.aligned([new[i]])[0]
        if not new:
            return
        self.counts = np.concatenate((self.counts, np.array([x[0] if x else (0, 0, 0, 0) for x in found], np.int64)))
        self.bad = np.concatenate((self.bad, np.array([x is None for x in found])))
        self.pairs = np.concatenate((self.pairs, *(x[1] for x in found if x)))
        self.starts = np.cumsum(self.counts[:, 3]) - self.counts[:, 3]
        self.groups += [x[2] if x else b"" for x in found]

    def aligned(self, units: list[str]) -> list[tuple | None]:
        """(counts, pairs, groups) of each unit, or None where the bytes differ; of several encoded together all None, if it isn't sure."""
        text = "".join(f" {u}" for u in units)
        a, b, data = self.v.ids_a(text), self.v.ids_b(text), text.encode()
        ends_a, ends_b = np.cumsum(self.v.sizes_a[a]), np.cumsum(self.v.sizes_b[b])
        none = [None] * len(units)
        if b"".join(map(self.v.bytes_a.__getitem__, a.tolist())) != data or b"".join(map(self.v.bytes_b.__getitem__, b.tolist())) != data:
            return none
        unit_ends = np.cumsum([len(u.encode()) + 1 for u in units])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not np.isin(unit_ends, common).all():
            return none
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        # a pair shares one run of bytes, and each run between two cuts of either is a pair's
        cuts = np.union1d(ends_a, ends_b)
        pairs = b[np.searchsorted(ends_b, cuts)] << 16 | a[np.searchsorted(ends_a, cuts)]
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        shown = np.empty(len(a) + len(b), self.v.decimal[","].dtype)
        shown[place_a] = np.where(last_a, self.v.decimal["|"][a], self.v.decimal[","][a])
        shown[place_b] = np.where(last_b, self.v.decimal[";"][b], self.v.decimal[","][b])
        width = np.empty(len(shown), np.int64)
        width[place_a], width[place_b] = self.v.digits[a] + 1, self.v.digits[b] + 1
        raw = shown.view(np.uint8)
        line, upto = raw[raw != 0].tobytes(), np.concatenate(([0], np.cumsum(width)))
        at_a, at_b, at_g, at_l = (np.searchsorted(x, unit_ends, "right") for x in (ends_a, ends_b, common, cuts))
        counts = np.stack([np.diff(x, prepend=0) for x in (at_a, at_b, at_g, at_l)], 1)
        edges, text_at = np.concatenate(([0], at_l)), upto[np.concatenate(([0], at_a + at_b))]
        return [(c, pairs[i:j], line[k:m]) for c, i, j, k, m in zip(counts, edges[:-1], edges[1:], text_at[:-1], text_at[1:])]

    def align_many(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Counts (a row a text), digests of the groups, and the links' pairs, text by text. Texts without tokens have zeros, '' and none."""
        if len(self.known) > REMEMBERED:
            self.forget()
        units: list[str] = []
        ends = []
        for t in texts:
            if t:
                units += _CUT.split(t) if _LOOSE.search(t) or t[0] == " " else t.split(" ")
            ends.append(len(units))
        at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        self.learn()
        edges = np.concatenate(([0], ends)).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), np.diff(edges))
        counts = np.zeros((len(texts), 4), np.int64)
        np.add.at(counts, row, self.counts[at])
        bad = np.zeros(len(texts), bool)
        bad[row[self.bad[at]]] = True
        counts[bad] = 0
        at_list = at.tolist()
        groups = ["" if bad[i] or a == b else hashlib.sha256(b"".join(map(self.groups.__getitem__, at_list[a:b]))[:-1]).hexdigest() for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
        good = at[~bad[row]]
        return counts, groups, _gather(self.pairs, self.starts, self.counts[:, 3], good)


_units: dict[tuple, Units] = {}


def units_for(*paths: str) -> Units:
    if paths not in _units:
        _units[paths] = Units(Vocabularies(*paths))
    return _units[paths]


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return tuple(str(public_tokenizers.path(x)) for x in (VOCABULARY_A, RANKS_A, VOCABULARY_B))


# Runs. A pair within a radix is (B id >> RADIX_BITS) << 16 | A id, below 2 ** 32.


def _zip(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in arrays))


def sums_run(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """A run of pairs, ascending, with their counts: a table of the blocks' first pairs and sizes, then zstd blocks."""
    heads, blocks = [], []
    for at in range(0, len(pairs), BLOCK):
        p, c = pairs[at : at + BLOCK], counts[at : at + BLOCK]
        blocks.append(_zip(np.diff(p, prepend=p[:1]).astype("<u4"), c.astype("<i8")))
        heads.append(struct.pack("<III", int(p[0]), len(p), len(blocks[-1])))
    return b"".join([struct.pack("<I", len(blocks)), *heads, *blocks])


class SumsRun:
    """Reads the blocks of ``sums_run`` one by one."""

    def __init__(self, run: bytes):
        self.run = run
        (n,) = struct.unpack_from("<I", run)
        self.heads = np.frombuffer(run, "<u4", 3 * n, 4).reshape(n, 3).astype(np.int64)
        self.at = 4 + 12 * n + np.concatenate(([0], np.cumsum(self.heads[:, 2])))

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        first, n = self.heads[i, :2].tolist()
        raw = zstandard.ZstdDecompressor().decompress(self.run[self.at[i] : self.at[i + 1]])
        return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)) + first, np.frombuffer(raw, "<i8", n, 4 * n)


def merge(runs: list[bytes]):
    """(pairs, counts), ascending, each pair once with the sum of its counts: a k-way merge by a heap of the next blocks' first pairs."""
    readers = [SumsRun(r) for r in runs]
    heap = [(int(r.heads[0, 0]), k, 0) for k, r in enumerate(readers) if len(r.heads)]
    heapq.heapify(heap)
    pairs, counts, waiting = [], [], 0
    while heap:
        _, k, i = heapq.heappop(heap)
        p, c = readers[k].block(i)
        pairs.append(p)
        counts.append(c)
        waiting += len(p)
        if i + 1 < len(readers[k].heads):
            heapq.heappush(heap, (int(readers[k].heads[i + 1, 0]), k, i + 1))
        if waiting < PENDING and heap:
            continue
        p, c = summed(np.concatenate(pairs), np.concatenate(counts))
        # nothing still to come is below the lowest head
        done = int(np.searchsorted(p, heap[0][0])) if heap else len(p)
        if done:
            yield p[:done], c[:done]
        pairs, counts, waiting = [p[done:]], [c[done:]], 0


def summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def merged(runs: list[bytes]) -> bytes:
    if len(runs) == 1:
        return runs[0]
    parts = list(merge(runs))
    none = np.zeros(0, np.int64)
    return sums_run(np.concatenate([none, *(p for p, _ in parts)]), np.concatenate([none, *(c for _, c in parts)]))


def record_run(pairs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> bytes:
    """Records sorted by pair and document, by columns; numbers of links over 254 stand apart."""
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    many = times[times > 254].astype("<u4")
    head = struct.pack("<III", len(starts), len(pairs), len(many))
    body = _zip(np.diff(pairs[starts], prepend=0).astype("<u4"), np.diff(starts, append=len(pairs)).astype("<u2"), docs.astype("<u2"), np.minimum(times, 255).astype("u1"), many)
    return head + body


def read_records(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, the number of each record's pair among them, documents and numbers of links."""
    n, m, k = struct.unpack_from("<III", run)
    raw = zstandard.ZstdDecompressor().decompress(run[12:])
    pairs = np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64))
    sizes = np.frombuffer(raw, "<u2", n, 4 * n)
    docs = np.frombuffer(raw, "<u2", m, 6 * n)
    times = np.frombuffer(raw, "u1", m, 6 * n + 2 * m).astype(np.int64)
    times[times == 255] = np.frombuffer(raw, "<u4", k, 6 * n + 3 * m)
    return pairs, np.repeat(np.arange(n), sizes), docs.astype(np.int64), times


_DOC, _RECORDS, _SUMS = 0, 1, 2
_FIELDS = [("kind", pa.int32()), ("buffer", pa.int64()), ("radix", pa.int32()), ("idx", pa.int32()), ("run", pa.binary()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_SCHEMA = pa.schema(_FIELDS)
_DDL = "kind int, buffer long, radix int, idx int, run binary, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[k] if isinstance(columns.get(k), pa.Array) else pa.array([columns.get(k)] * n if not isinstance(columns.get(k), (list, np.ndarray)) else columns[k], t) for k, t in _FIELDS], schema=_SCHEMA)


def _spill(number: int, pairs: np.ndarray, docs: np.ndarray, sums: list[list[bytes]]):
    """The record runs of a buffer; its sums by pair are added to ``sums``, a list of runs by radix."""
    b = pairs >> 16
    key = ((b & (RADICES - 1)) << 48 | (b >> RADIX_BITS) << 32 | (pairs & 0xFFFF) << 16) | docs
    key.sort()
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(starts, append=len(key))
    key = key[starts]
    edges = np.searchsorted(key, np.arange(RADICES + 1, dtype=np.int64) << 48)
    runs, radices = [], []
    for r in range(RADICES):
        k, t = key[edges[r] : edges[r + 1]], times[edges[r] : edges[r + 1]]
        if not len(k):
            continue
        pair = (k >> 16) & 0xFFFFFFFF
        runs.append(record_run(pair, k & 0xFFFF, t))
        radices.append(r)
        sums[r].append(sums_run(*summed(pair, t)))
        if len(sums[r]) >= FAN_IN:
            sums[r] = [merged(sums[r])]
    return _rows(len(runs), kind=_RECORDS, buffer=number, radix=radices, run=runs)


def spilled(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Rows of three kinds: documents with their counts, record runs, and a task's sums by radix."""

    def run(batches):
        from pyspark import TaskContext

        units = units_for(*(paths or default_paths()))
        number = TaskContext.get().partitionId() << 32
        sums: list[list[bytes]] = [[] for _ in range(RADICES)]
        held, at, links = [], 0, 0  # pairs and document numbers of the buffer, its documents, its links
        for batch in batches:
            row = 0
            for texts in text_slices(batch.column(1)):
                for first in range(0, len(texts), DOCUMENTS):
                    part = texts[first : first + DOCUMENTS]
                    if held and (links >= LINKS or at + len(part) > DOCUMENTS):
                        yield _spill(number, *(np.concatenate(x) for x in zip(*held)), sums)
                        number, held, at, links = number + 1, [], 0, 0
                    counts, groups, pairs = units.align_many(part)
                    idx = np.arange(at, at + len(part))
                    held.append((pairs, np.repeat(idx, counts[:, 3])))
                    yield _rows(len(part), kind=_DOC, buffer=number, idx=idx, doc_id=batch.column(0).slice(row, len(part)), n_a=counts[:, 0], n_b=counts[:, 1], n_groups=counts[:, 2], n_links=counts[:, 3], groups_sha256=groups)
                    row, at, links = row + len(part), at + len(part), links + len(pairs)
        if held:
            yield _spill(number, *(np.concatenate(x) for x in zip(*held)), sums)
        whole = [(r, merged(runs)) for r, runs in enumerate(sums) if runs]
        if whole:
            yield _rows(len(whole), kind=_SUMS, buffer=number >> 32, radix=[r for r, _ in whole], run=[x for _, x in whole])

    return docs.mapInArrow(run, _DDL)


def counted(sums: DataFrame) -> DataFrame:
    """radix, run: the counts of all tasks' sums (buffer: the task, radix, run), merged in rounds of at most ``FAN_IN`` runs a task."""
    tasks = (sums.agg(F.max("buffer")).first()[0] or 0) + 1
    current = sums.select(F.col("buffer").alias("task"), "radix", "run")
    while True:
        tasks = -(-tasks // FAN_IN)
        grouped = current.select(F.expr(f"task div {FAN_IN}").alias("task"), "radix", "run")
        current = stored(grouped.repartition("radix", "task").sortWithinPartitions("radix", "task").mapInArrow(_merge_groups, "task long, radix int, run binary"))
        if tasks <= 1:
            return current.select("radix", "run")


def _merge_groups(batches):
    group, runs = None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([group[0]], pa.int64()), pa.array([group[1]], pa.int32()), pa.array([merged(runs)], pa.binary())], ["task", "radix", "run"])

    for batch in batches:
        for task, radix, run in zip(*(c.to_pylist() for c in batch.columns)):
            if group != (task, radix):
                if runs:
                    yield out()
                group, runs = (task, radix), []
            runs.append(run)
    if runs:
        yield out()


def best_of(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs, in B-major order, have the highest count of their B id."""
    starts = np.flatnonzero(np.diff(pairs >> 16, prepend=-1))
    highest = np.maximum.reduceat(counts, starts) if len(starts) else counts[:0]
    return counts == np.repeat(highest, np.diff(starts, append=len(pairs)))


def answers(records: DataFrame, counts: DataFrame) -> DataFrame:
    """buffer, run: for each record run (buffer, radix, run) its documents' count sums and best links, from the radices' ``counts``.

    A radix's runs are dealt to several tasks, each of which gets a copy of its counts first and then streams runs.
    """
    salts = max(1, -(-2 * shuffle_width(records.sparkSession) // RADICES))
    dealt = records.select("radix", F.pmod(F.xxhash64("buffer"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("order"), "buffer", "run")
    copies = counts.select("radix", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("order"), F.lit(0).cast("long").alias("buffer"), "run")
    rows = copies.unionByName(dealt).repartition("radix", "salt").sortWithinPartitions("radix", "salt", "order")

    def run(batches):
        pairs = total = best = None
        for batch in batches:
            buffers, runs = [], []
            for order, buffer, blob in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if not order:
                    reader = SumsRun(blob)
                    blocks = [reader.block(i) for i in range(len(reader.heads))]
                    pairs, total = (np.concatenate(x) for x in zip(*blocks))
                    best = best_of(pairs, total)
                    continue
                mine, number, docs, times = read_records(blob)
                at = np.searchsorted(pairs, mine)
                n = int(docs.max()) + 1
                sums, wins = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(sums, docs, total[at][number] * times)
                np.add.at(wins, docs, best[at][number] * times)
                buffers.append(buffer)
                runs.append(struct.pack("<I", n) + _zip(sums.astype("<i8"), wins.astype("<u4")))
            if buffers:
                yield pa.RecordBatch.from_arrays([pa.array(buffers, pa.int64()), pa.array(runs, pa.binary())], ["buffer", "run"])

    return rows.mapInArrow(run, "buffer long, run binary")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs``.

    Null and empty texts have no tokens, nor have texts whose bytes either vocabulary's tokens don't give back: zeros and
    ''. Every row is a text of its own, whatever its id; repeated rows count as often as they are. No rows give no
    rows; other columns are left out. ``paths``: the files of A, of A's ranks (the same vocabulary) and of B.
    """
    spills = stored(spilled(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), paths))
    counts = counted(spills.where(F.col("kind") == _SUMS).select("buffer", "radix", "run"))
    back = answers(spills.where(F.col("kind") == _RECORDS).select("buffer", "radix", "run"), counts)
    own = ["idx", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = spills.where(F.col("kind") == _DOC).select("buffer", F.lit(1).alias("order"), F.lit(None).cast("binary").alias("run"), *own)
    back = back.select("buffer", F.lit(0).alias("order"), "run", *(F.lit(None).cast(spills.schema[c].dataType).alias(c) for c in own))
    rows = back.unionByName(rows).repartition("buffer").sortWithinPartitions("buffer", "order")

    def run(batches):
        buffer, sums, wins = None, None, None
        for batch in batches:
            of, order = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (order[1:] != order[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if of[a] != buffer:
                    buffer, sums, wins = of[a], np.zeros(DOCUMENTS + 1, np.int64), np.zeros(DOCUMENTS + 1, np.int64)
                part = batch.slice(a, b - a)
                if not order[a]:
                    for blob in part.column(2).to_pylist():
                        (n,) = struct.unpack_from("<I", blob)
                        raw = zstandard.ZstdDecompressor().decompress(blob[4:])
                        sums[:n] += np.frombuffer(raw, "<i8", n)
                        wins[:n] += np.frombuffer(raw, "<u4", n, 8 * n)
                    continue
                idx = part.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns[4:9], pa.array(wins[idx]), pa.array(sums[idx]), part.column(9)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
