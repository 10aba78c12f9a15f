"""A byte-level convolutional network, in numpy, that scores the quality of whole texts.

Bytes are embedded, runs of ``WIDTH`` embedded bytes pass learned filters at every ``STRIDE``-th place,
and each of the overlapping chunks that cover the whole text keeps every filter's maximum. A document's
vector is the mean, the lowest and the highest of its chunks' maxima, and a hidden layer makes one
probability of it. Repetition shows in low maxima, as few patterns occur in a repetitive chunk.

It is fitted on a bounded sample of labelled rows (``SAMPLE``, by hash), on the whole text of each; scoring reads every
chunk of every text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

CHUNK, STEP = 320, 256
WIDTH, STRIDE, FILTERS, EMBED, HIDDEN = 8, 2, 48, 8, 24
#: Labelled rows fitted on at most.
SAMPLE = 4000
#: Chunks that pass the filters at a time.
AT_ONCE = 256
STEPS, BATCH, RATE = 450, 64, 0.004
ACCEPT = 0.3
HELD_OUT_OF = 5
#: Bytes of padding: value 256 of the embedding.
PAD = 256


def chunks_of(text: np.ndarray) -> np.ndarray:
    """The overlapping chunks that cover a text's bytes, padded to ``CHUNK``; an empty text has one of padding."""
    n = max(1, -(-max(len(text) - (CHUNK - STEP), 1) // STEP))
    out = np.full((n - 1) * STEP + CHUNK, PAD, np.int16)
    out[: len(text)] = text
    return np.lib.stride_tricks.sliding_window_view(out, CHUNK)[::STEP]


class Network:
    """Parameters by name; ``tables`` are the filters applied to each byte at each place, for scoring."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (257, EMBED)),
            "filters": r.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)),
            "filter_bias": np.zeros(FILTERS),
            "hidden": r.normal(0, 1 / np.sqrt(3 * FILTERS), (3 * FILTERS, HIDDEN)),
            "hidden_bias": np.zeros(HIDDEN),
            "out": r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            "out_bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def tables(self) -> np.ndarray:
        """(WIDTH, 257, FILTERS): what a byte at a place of the run adds to each filter."""
        return np.stack([self.p["embed"] @ self.p["filters"][j * EMBED : (j + 1) * EMBED] for j in range(WIDTH)]).astype(np.float32)

    def filtered(self, chunks: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """(chunks, places, FILTERS): what each filter gives at each place."""
        n = (CHUNK - WIDTH) // STRIDE + 1
        total = np.take(tables[0], chunks[:, : n * STRIDE : STRIDE], axis=0)
        for j in range(1, WIDTH):
            total += np.take(tables[j], chunks[:, j : j + n * STRIDE : STRIDE][:, :n], axis=0)
        return total

    def chunk_maxima(self, chunks: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return np.tanh(self.filtered(chunks, tables).max(axis=1) + self.p["filter_bias"])

    def head(self, maxima: np.ndarray) -> float:
        """A document's probability from its chunks' maxima."""
        v = np.concatenate((maxima.mean(0), maxima.min(0), maxima.max(0)))
        h = np.maximum(v @ self.p["hidden"] + self.p["hidden_bias"], 0)
        return float(1 / (1 + np.exp(-np.clip(h @ self.p["out"] + self.p["out_bias"][0], -30, 30))))

    def score(self, texts: list[np.ndarray], tables: np.ndarray, at_once: int = AT_ONCE) -> list[float]:
        out = []
        for text in texts:
            chunks = chunks_of(text)
            out.append(self.head(np.concatenate([self.chunk_maxima(chunks[i : i + at_once], tables) for i in range(0, len(chunks), at_once)])))
        return out

    def step(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the weighted log loss over whole texts; places that aren't a chunk's maximum have none and aren't kept."""
        p = self.p
        groups = [chunks_of(t) for t in texts]
        chunks = np.concatenate(groups)
        edges = np.cumsum([0, *map(len, groups)])
        tables = self.tables()
        where, maxima = [], []
        for at in range(0, len(chunks), AT_ONCE):
            total = self.filtered(chunks[at : at + AT_ONCE], tables)
            where.append(total.argmax(axis=1))
            maxima.append(np.take_along_axis(total, where[-1][:, None, :], 1)[:, 0])
        where, maxima = np.concatenate(where), np.tanh(np.concatenate(maxima) + p["filter_bias"])
        docs = len(texts)
        mean = np.add.reduceat(maxima, edges[:-1]) / np.diff(edges)[:, None]
        low_at = np.stack([a + maxima[a:b].argmin(0) for a, b in zip(edges, edges[1:])])
        high_at = np.stack([a + maxima[a:b].argmax(0) for a, b in zip(edges, edges[1:])])
        cols = np.arange(FILTERS)
        v = np.concatenate((mean, maxima[low_at, cols], maxima[high_at, cols]), 1)
        pre = v @ p["hidden"] + p["hidden_bias"]
        h = np.maximum(pre, 0)
        prob = 1 / (1 + np.exp(-np.clip(h @ p["out"] + p["out_bias"][0], -30, 30)))
        loss = -float(weights @ (labels * np.log(prob + 1e-9) + (1 - labels) * np.log(1 - prob + 1e-9))) / docs
        d = (weights * (prob - labels) / docs).astype(np.float32)
        g = {"out": h.T @ d, "out_bias": np.array([d.sum()], np.float32)}
        dh = np.outer(d, p["out"]) * (pre > 0)
        g["hidden"], g["hidden_bias"] = v.T @ dh, dh.sum(0)
        dv = dh @ p["hidden"].T
        dm = np.repeat(dv[:, :FILTERS] / np.diff(edges)[:, None], np.diff(edges), 0)
        np.add.at(dm, (low_at, cols[None]), dv[:, FILTERS : 2 * FILTERS])
        np.add.at(dm, (high_at, cols[None]), dv[:, 2 * FILTERS :])
        dt = dm * (1 - maxima**2)
        g["filter_bias"] = dt.sum(0)
        g["filters"], g["embed"] = np.zeros_like(p["filters"]), np.zeros_like(p["embed"])
        rows = np.arange(len(chunks))[:, None]
        for j in range(WIDTH):
            seen = chunks[rows, where * STRIDE + j]
            by_byte = np.zeros((257 * FILTERS,), np.float32)
            by_byte += np.bincount((seen.astype(np.int64) * FILTERS + cols).ravel(), dt.ravel(), 257 * FILTERS)
            by_byte = by_byte.reshape(257, FILTERS)
            part = slice(j * EMBED, (j + 1) * EMBED)
            g["filters"][part] = p["embed"].T @ by_byte
            g["embed"] += by_byte @ p["filters"][part].T
        return g, loss


def fit(texts: list[bytes], labels: list[int], seed: int = 7, steps: int = STEPS) -> Network:
    """A network fitted by Adam to whole texts; without rows, or with one class alone, one that scores that class's share."""
    raw = [np.frombuffer(t, np.uint8) for t in texts]
    net = Network(seed)
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.5
    net.p["out_bias"][:] = np.log((share + 0.01) / (1 - share + 0.01))
    if not len(y) or share in (0.0, 1.0):
        net.p["out"][:] = 0
        return net
    weights = np.where(y == 1, 0.4 / share, 0.6 / (1 - share)).astype(np.float32)
    net.p["out_bias"][:] = 0
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    t = 0
    while t < steps:
        order = rng.permutation(len(y))
        for at in range(0, min(len(y), (steps - t) * BATCH), BATCH):
            pick = order[at : at + BATCH]
            g, _loss = net.step([raw[i] for i in pick], y[pick], weights[pick])
            t += 1
            rate = RATE * (1 - t / (steps + 1))
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def remainder(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % HELD_OUT_OF


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE) -> list[tuple[bytes, int]]:
    """Text (UTF-8) and label of up to ``rows`` labelled rows that aren't held out, in an order set by a hash of the id.

    Of repeated labels of a document the lowest counts; each text of a repeated id is a row, and equal rows are one.
    """
    learn = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT_OF)) != 0))
    order = F.xxhash64("doc_id")
    chosen = learn.groupBy("doc_id").agg(F.min(target).alias("y")).orderBy(order, "doc_id").limit(rows)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))
    # both broadcasts are of at most ``rows`` rows of numbers; the second is what bounds the texts, as an id may be on any number of rows
    picked = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "mark", "y").distinct().orderBy(order, "doc_id", "mark").limit(rows)
    found = texts.join(F.broadcast(picked), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).collect()
    return [(bytes(r.text), int(r.y)) for r in sorted(found, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.mark))]


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """doc_id, score of each row of ``docs`` (and the columns ``keep``). Null counts as the empty text, which has a score too."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        model = shared.value
        tables = model.tables()
        for batch in batches:
            raw, off = W.text_buffer(batch.column(1))
            scores = model.score([raw[a:b] for a, b in zip(off, off[1:])], tables)
            if scores:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), *batch.columns[2:]], ["doc_id", "score", *keep])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)))
    return rows.mapInArrow(run, f"doc_id long, score double{', ' * bool(kinds)}{kinds}")


def train(docs: DataFrame, labels: DataFrame) -> Network:
    sample = labelled_sample(docs, labels)
    return fit([t for t, _ in sample], [y for _, y in sample])


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; rows with a null id are never held out nor learned from."""
    scored = score_documents(docs, train(docs, labels))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT_OF)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    net = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        tables = model.tables()
        for batch in batches:
            raw, off = W.text_buffer(batch.column(at))
            good = np.array(model.score([raw[a:b] for a, b in zip(off, off[1:])], tables)) >= ACCEPT
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
