"""Near-duplicates from bottom-k sketches under one hash function.

A document's sketch is the ``k`` smallest hashes of its shingle set. Inverted lists of the retained
values generate the overlaps:

* Documents with equal sets become one representative first, by the heavy-hitter split of exact dedup.
* A value that only one representative retains is in no list. The values that a document is listed
  under are its rarest ones, as many as make a pair over the threshold meet (prefix filtering over
  the sketches: exact while the sets fit into the sketches, else with ``SLACK`` standard deviations to
  spare). Passages that many otherwise different documents share are frequent and so come last.
* In each list every member is first compared with a hub: a pair passes the union-sketch estimate (with
  ``SLACK`` to spare) and is then confirmed on the full sets. Members that are in one component by then
  need no comparison among themselves.
* Lists with one hub form a group. Groups in which several components are left are cut into blocks of
  about ``BLOCK`` members; each pair of blocks compares its full sets, of different components only, and
  reports no more links than connect them. So pairs are never rows, and a hot group is many tasks.

Components come from minimum labels with pointer jumping; nothing is gathered on the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import cut, stored, text_of
from .exact_dedup import resolve

SHINGLE_WORDS = 5
#: Linked when 100 * intersection >= 75 * union.
PERCENT = 75
SKETCH = 128
#: Standard deviations that sampled overlaps may fall short of their mean.
SLACK = 4.5
#: Hubs that the lists of one family have at most.
HUBS = 2
#: Members of a block.
BLOCK = 256
#: Columns of an incidence matrix that are multiplied at a time.
COLUMNS = 4096


def prefix_length(n: int, k: int = SKETCH, percent: int = PERCENT) -> int:
    """How many of the rarest of a sketch's values a document of ``n`` shingles is listed under."""
    t, m = percent / 100, min(n, k)
    if n <= t * k:  # every partner's set is also within its sketch
        return m - math.ceil(t * n) + 1
    return m - max(1, math.floor(t * m - SLACK * math.sqrt(t * (1 - t) * m))) + 1


def sketches(docs: DataFrame, n: int = SHINGLE_WORDS, k: int = SKETCH) -> DataFrame:
    """doc_id, mark, n_shingles, set_key, prefix, sketch (ascending) of each row (doc_id, text, mark)."""

    def run(batches):
        for batch in batches:
            for first, words, off in W.word_hashes(batch.column(1)):
                rows, sets = [], []
                for at, end in zip(off[:-1], off[1:]):
                    s = W.shingle_set(words[at:end], n).view(np.int64)
                    s.sort()
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), prefix_length(len(s), k)))
                    sets.append(s[:k].copy())
                size, key, prefix = zip(*rows)
                ids, marks = (batch.column(i).slice(first, len(rows)) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, marks, pa.array(size, pa.int64()), pa.array(key), pa.array(prefix, pa.int32()), W.list_column(sets, pa.int64())], ["doc_id", "mark", "n_shingles", "set_key", "prefix", "sketch"])

    return docs.select("doc_id", "text", "mark").mapInArrow(run, "doc_id long, mark long, n_shingles long, set_key string, prefix int, sketch array<long>")


def full_sets(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, shingles (ascending, so that a slice of them is the sketch) of each row."""

    def run(batches):
        for batch in batches:
            for first, words, off in W.word_hashes(batch.column(1)):
                sets = [np.sort(W.shingle_set(words[at:end], n).view(np.int64)) for at, end in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), W.list_column(sets, pa.int64())], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def estimate(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Jaccard estimate from the k smallest values of two sketches' union; exact when both hold whole sets."""
    low = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(low, a), b)) / F.size(low)


def linked(pairs: DataFrame, sets: DataFrame, k: int = SKETCH, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that the union sketch lets pass and the full sets confirm."""
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.size("shingles").alias(f"n_{name}"), F.slice("shingles", 1, k).alias(f"s_{name}"))
    t = percent / 100
    least = t - SLACK * math.sqrt(t * (1 - t) / k)
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (estimate(F.col("s_a"), F.col("s_b"), k) >= least)
    near = cut(near.where(fits).select("a", "b"))
    one = lambda name: sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"set_{name}"))
    both = near.join(one("a"), "a").join(one("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(common * 100 >= (F.size("set_a") + F.size("set_b") - common) * percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links (a, b) reach from each node that has one."""
    edges = cut(links.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*").where("src <> dst").distinct())
    labels = cut(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("label")))
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = cut(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = moved.select("node", "label")
        if moved.where("label < old").isEmpty():
            return labels


def near_links(reps: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, label over representatives (doc_id: the node, prefix, sketch; materialised); ``texts_of`` gives the texts of some (doc_id, text)."""
    listed = reps.select("doc_id", F.explode("sketch").alias("value"))
    shared = stored(listed.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    by_doc = listed.join(shared, "value").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    # values that nobody else retains fill the prefix first
    keys = reps.select("doc_id", "prefix", F.size("sketch").alias("m")).join(by_doc, "doc_id")
    keys = keys.withColumn("take", F.col("prefix") - (F.col("m") - F.size("shared"))).where("take > 0")
    index = stored(keys.select("doc_id", F.explode(F.slice("shared", 1, F.col("take"))).alias("s")).select("doc_id", "s.value"))
    rank = F.struct(F.xxhash64("doc_id", F.pmod("value", F.lit(HUBS))).alias("h"), "doc_id")
    hubs = stored(index.groupBy("value").agg(F.min(rank).alias("hub"), F.count("*").alias("n")).where("n > 1").select("value", F.col("hub.doc_id").alias("hub")))
    members = stored(index.join(hubs, "value").select("hub", "doc_id").distinct())
    stars = members.where("doc_id <> hub").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    wanted = members.select("doc_id").distinct()
    sets = stored(full_sets(texts_of(wanted)))
    links = cut(linked(stars, sets))
    labels = components(links)
    named = stored(members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("hub", "doc_id", F.coalesce("label", "doc_id").alias("label")))
    open_ = stored(named.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("hub", "n"))
    more = links_between(cut(named.join(open_, "hub")), sets)
    return components(cut(links.unionByName(more)))


def links_between(groups: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the labels of each group (hub, n members, doc_id, label) as all links of its ``sets`` would."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = groups.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).join(sets, "doc_id")
    met = mine.select("hub", "doc_id", "label", "shingles", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("hub", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "doc_id", "label", "shingles")
    keys = ["hub", "lo", "hi"]

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None and held.num_rows else rows
            key = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in keys])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), rows.num_rows]
            for at, end in zip(edges[:-2], edges[1:-1]):
                yield _compare_blocks(rows.slice(at, end - at))
            held = rows.slice(edges[-2])
        if held is not None and held.num_rows:
            yield _compare_blocks(held)

    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _compare_blocks(rows: pa.Table) -> pa.RecordBatch:
    """The links that join different labels across (or, in one block, within) the blocks of a pair, as a spanning forest."""
    ids, labels, mine = (rows.column(c).to_numpy() for c in ("doc_id", "label", "mine"))
    lists = rows.column("shingles").combine_chunks()
    off = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1] if isinstance(lists, pa.ListArray) else lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    size = np.diff(off)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), size)
    met = times[column] > 1
    column, row = (np.cumsum(times > 1) - 1)[column[met]], row[met]
    common = np.zeros((len(ids), len(ids)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((len(ids), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        common += part @ part.T
    close = common * 100 >= (size[:, None] + size[None, :] - common) * PERCENT
    close &= labels[:, None] != labels[None, :]
    close &= np.triu(np.ones_like(close), 1) if rows.column("lo")[0] == rows.column("hi")[0] else (mine[:, None] < mine[None, :])
    up = {int(x): int(x) for x in labels}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    links = []
    for i, j in np.argwhere(close):
        x, y = root(int(labels[i])), root(int(labels[j]))
        if x != y:
            up[x] = y
            links.append((int(ids[i]), int(ids[j])))
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in links], pa.int64()), pa.array([p[1] for p in links], pa.int64())], ["a", "b"])


#: What names a row: rows that share all three have equal ids and texts.
NAME = ["known", "id", "mark"]


def _named(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    id_ = F.col(id_col).cast("long")
    return [id_.isNotNull().alias("known"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(text_of(text_col)).alias("mark")]


def _marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, mark (a hash of the text)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("mark"))


def _rows_of(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (doc_id, mark, ...) that ``names`` (doc_id, mark, node; each once) lists, with their nodes, equal rows once.

    The join's partitioning serves the removal of equal rows.
    """
    named = lambda df: df.withColumns({"known": F.col("doc_id").isNotNull(), "id": F.coalesce("doc_id", F.lit(0))}).drop("doc_id")
    return named(rows).join(named(names), NAME).dropDuplicates(NAME)


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, component (its name) of each row of ``docs`` (doc_id, text, mark).

    A node is a distinct set, whichever ids its documents have. Its number is drawn once, for the materialised row that
    stands for it.
    """
    # sketches are drawn twice and written once: the first pass keeps only what finds equal sets
    drawn = stored(sketches(docs).select("doc_id", "mark", "n_shingles", "set_key"))
    groups = stored(resolve(drawn.where("n_shingles > 0"), "set_key", keep="min").select("set_key", "doc_id", "mark", "n_shingles", F.col("keep_id").alias("least"), "kept"))
    nodes = stored(groups.where("kept").select("set_key", "doc_id", "mark", "least", F.monotonically_increasing_id().alias("node")))
    names = nodes.select("doc_id", "mark", "node")
    reps = stored(_rows_of(sketches(docs).where(F.size("sketch") > 0).select("doc_id", "mark", "prefix", "sketch"), names).select(F.col("node").alias("doc_id"), "prefix", "sketch"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        return _rows_of(docs, names.join(wanted.withColumnRenamed("doc_id", "node"), "node", "left_semi")).select(F.col("node").alias("doc_id"), "text")

    tied = stored(nodes.join(near_links(reps, texts_of), "node").select("set_key", "least", "label"))
    smallest = tied.groupBy("label").agg(F.min("least").alias("component_id"))
    found = tied.join(smallest, "label").select("set_key", "component_id", F.col("label").cast("string").alias("component"))
    out = groups.join(found, "set_key", "left").select("doc_id", "mark", "n_shingles", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "set_key").alias("component"))
    alone = drawn.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("string").alias("component"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Null and word-less texts have no shingles and stand alone. Every row counts with its own text: rows that repeat an
    id may be of different components, each named by the smallest id that any of its rows has, null where none has one.
    ``kept`` says that a row has that id, so several may. Equal sets of any number meet through one representative.
    """
    return _grouped(_marked(docs, id_col, text_col)).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null last), of several texts under it that of the smallest hash.

    Columns stay as they are, whatever their names. Of rows that repeat an id and text, one stays; so of word-less ones.
    """
    rows = _grouped(_marked(docs))
    name = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark")
    first = rows.where("component is not null").groupBy("component").agg(F.min(name).alias("name")).select("name.doc_id", "name.mark")
    kept = cut(first.unionByName(rows.where("component is null").select("doc_id", "mark").distinct()))
    kept = kept.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    return docs.select(F.struct("*").alias("row"), *_named()).join(kept, NAME).dropDuplicates(NAME).select("row.*")


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
