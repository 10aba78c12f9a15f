"""A trie of conversations by their turns, with totals of every subtree.

A node is a distinct sequence of first turns. Its name is the exclusive or of a 128-bit hash of each turn with its
place, so names come from running aggregates that any cut of a conversation can be part of, and a parent's name is the
child's less the last turn.

Totals rise by bands of ``BAND`` depths. A node adds to its ancestors within its band only; the nodes at the top of
each band, with what their bands hold, form a trie that is ``BAND`` times less deep and is summed in the same way; then
each of them adds its whole to its ancestors in the band above. So a node is exploded to fewer than ``BAND`` rows
twice, and the rounds are the logarithm of the depth. The path from a node up is that of its member with the smallest
id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stored

#: Depths of a band.
BAND = 16
#: Conversations of a family share the first turns of the one whose id is the family's lowest; each takes fewer than ``SHARED`` of them.
FAMILY, SHARED = 100, 6
#: Ids whose high bits agree are joined before they are hashed.
ID_BITS = 12
#: Parents with more than this part of all nodes as children are sent to every task; there are at most as many of them.
HEAVY = 1000
NODE = ["depth", "g1", "g2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, part, idx, h1, h2, chars: each turn with its place among the turns of its conversation that are in its partition.

    Turns are range-partitioned by conversation, turn (null first), role and text, so that a long conversation is
    dealt over many tasks.
    """
    clean = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    keys = ["conv_id", "turn", "role", "text"]
    rows = clean.repartitionByRange(shuffle_width(conversations.sparkSession), *keys).sortWithinPartitions(*keys)
    slim = rows.select("conv_id", *(F.xxhash64(F.lit(i), "role", "text").alias(f"h{i}") for i in (1, 2)), F.char_length("text").cast("long").alias("chars"))

    def run(batches):
        from pyspark import TaskContext

        part, last, upto = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(0).to_numpy()
            new = np.ones(n, bool)
            new[1:] = conv[1:] != conv[:-1]
            new[0] = last != conv[0]
            starts = np.concatenate(([-upto], np.flatnonzero(new)))  # of the conversation before and of those that begin here
            idx = np.arange(n) - starts[np.cumsum(new)]
            last, upto = conv[-1], int(idx[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(idx), *batch.columns[1:]], ["conv_id", "part", "idx", "h1", "h2", "chars"])

    return slim.mapInArrow(run, "conv_id long, part int, idx long, h1 long, h2 long, chars long")


def placed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, h1, h2, chars) and conversations (conv_id, n)."""
    turns = stored(numbered(conversations))
    by_part = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    parts = stored(counts.withColumn("ahead", F.coalesce(F.sum("n").over(by_part), F.lit(0))))
    # at most one conversation goes on in each partition
    going_on = parts.where("ahead > 0").select("conv_id", "part", "ahead")
    turns = turns.join(F.broadcast(going_on), ["conv_id", "part"], "left").select("conv_id", (F.col("idx") + F.coalesce("ahead", F.lit(0))).alias("pos"), "h1", "h2", "chars")
    return turns, parts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of the rebuilt conversations: a family's first turns, then each one's own.

    Conversation c takes the first h turns of c - c % FAMILY (all, if it has fewer; none, if there is no such
    conversation), with h = crc32 of its decimal id modulo SHARED, and then its own turns after its first h.
    """
    turn = F.struct("pos", "h1", "h2", "chars")
    heads = turns.where(F.col("pos") < SHARED - 1).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    plan = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.array().cast("array<struct<pos:bigint,h1:bigint,h2:bigint,chars:bigint>>")).otherwise(F.slice("head", 1, F.col("h")))
    plan = plan.select("conv_id", "h", head.alias("head"), (F.size(head) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    plan = stored(plan)
    own = turns.join(plan.select("conv_id", "h", F.size("head").alias("k")), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "h1", "h2", "chars")
    shared = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    return stored(own.unionByName(shared)), plan.select("conv_id", F.col("length").alias("n"))


def _running(rows: DataFrame, longest: int) -> DataFrame:
    """``rows`` (conv_id, pos, p1, p2, ...) with g1 and g2, the exclusive or of p1 and p2 up to each; ``longest``: places at most.

    Conversations are cut into blocks; each block's total is a place of a conversation ``BAND`` times shorter.
    """
    if longest <= BAND:
        w = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select("*", F.bit_xor("p1").over(w).alias("g1"), F.bit_xor("p2").over(w).alias("g2"))
    cut_ = rows.withColumn("block", F.expr(f"pos div {BAND}"))
    w = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = cut_.select("*", F.bit_xor("p1").over(w).alias("x1"), F.bit_xor("p2").over(w).alias("x2"))
    totals = cut_.groupBy("conv_id", "block").agg(F.bit_xor("p1").alias("p1"), F.bit_xor("p2").alias("p2")).withColumnRenamed("block", "pos")
    before = _running(totals, -(-longest // BAND)).select("conv_id", (F.col("pos") + 1).alias("block"), F.col("g1").alias("b1"), F.col("g2").alias("b2"))
    whole = [F.col(f"x{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))).alias(f"g{i}") for i in (1, 2)]
    return inside.join(before, ["conv_id", "block"], "left").select(*rows.columns, *whole)


def prefixes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, int]:
    """conv_id, depth, g1, g2, up1, up2 (the parent's name), chars, ends of every prefix of every conversation, and the greatest depth."""
    longest = convs.agg(F.max("n")).first()[0] or 0
    hashed = turns.select("conv_id", "pos", *(F.xxhash64(F.lit(i), "pos", "h1", "h2").alias(f"p{i}") for i in (1, 2)), "chars")
    named = _running(hashed, longest).join(convs, "conv_id")
    up = [F.col(f"g{i}").bitwiseXOR(F.col(f"p{i}")).alias(f"up{i}") for i in (1, 2)]
    deeper = named.select("conv_id", (F.col("pos") + 1).alias("depth"), "g1", "g2", *up, "chars", (F.col("pos") + 1 == F.col("n")).alias("ends"))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), *(F.lit(None).cast("long").alias(f"up{i}") for i in (1, 2)), zero.alias("chars"), (F.col("n") == 0).alias("ends"))
    return stored(roots.unionByName(deeper)), longest


def _paths(prefix: DataFrame, step: int) -> DataFrame:
    """conv_id, band, path: the names of each conversation's prefixes whose depths ``step`` divides, in runs of ``BAND``."""
    name = F.struct(*NODE)
    some = prefix.where(F.col("depth") % step == 0)
    return some.groupBy("conv_id", F.expr(f"depth div {step * BAND}").alias("band")).agg(F.sort_array(F.collect_list(name)).alias("path"))


def rollup(values: DataFrame, prefix: DataFrame, longest: int, step: int = 1) -> DataFrame:
    """depth, g1, g2, conv_id, saved, leaves: ``values`` of the nodes whose depths ``step`` divides, summed over their subtrees."""
    paths = stored(_paths(prefix, step))
    band = F.expr(f"depth div {step * BAND}").alias("band")
    up_to = (F.expr(f"depth div {step}") % BAND + 1).cast("int")
    within = values.select("*", band, up_to.alias("m")).join(paths, ["conv_id", "band"])
    within = within.select(F.explode(F.slice("path", 1, F.col("m"))).alias("to"), "depth", "conv_id", "saved", "leaves")
    mine = F.max(F.when(F.col("depth") == F.col("to.depth"), F.col("conv_id"))).alias("conv_id")
    sums = lambda rows: rows.groupBy(*(F.col(f"to.{c}").alias(c) for c in NODE)).agg(mine, F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    inside = stored(sums(within))
    if longest < step * BAND:
        return inside
    tops = rollup(inside.where(F.col("depth") % (step * BAND) == 0), prefix, longest, step * BAND)
    above = tops.where("depth > 0").withColumn("band", F.expr(f"depth div {step * BAND} - 1")).join(paths, ["conv_id", "band"])
    above = above.select(F.explode("path").alias("to"), "depth", "conv_id", "saved", "leaves")
    own = inside.select(F.struct(*NODE).alias("to"), "depth", "conv_id", "saved", "leaves")
    return stored(sums(own.unionByName(above)))


def digests(ends: DataFrame) -> DataFrame:
    """depth, g1, g2, ends_sha256: of the ids (conv_id) of each node, ascending, decimal, comma-joined.

    SHA-256 takes a node's ids one after the other. They are joined in runs of close ids first, each in a task of its
    own choice, and the runs of a node are streamed in order through one hash, so a task holds a batch of runs at most.
    """
    runs = ends.groupBy(*NODE, F.shiftright("conv_id", ID_BITS).alias("high")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    runs = runs.select(*NODE, "high", F.array_join(F.col("ids").cast("array<string>"), ",").alias("joined"))

    def run(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for *key, joined in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(joined.encode())
            if done:
                yield _digest_rows(done)
        if node is not None:
            yield _digest_rows([(*node, state.hexdigest())])

    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "high").mapInArrow(run, "depth long, g1 long, g2 long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*NODE, "ends_sha256"])


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the conversations ``convs`` (conv_id, n) with ``turns`` (conv_id, pos, h1, h2, chars).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Conversations
    without turns end at the root. No conversations make no nodes.
    """
    prefix, longest = prefixes(turns, convs)
    nodes = prefix.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("up1").alias("up1"), F.min("up2").alias("up2"))
    nodes = stored(nodes)
    up = [(F.col("depth") - 1).alias("depth"), F.col("up1").alias("g1"), F.col("up2").alias("g2")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    values = nodes.select(*NODE, "conv_id", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    totals = rollup(values, prefix, longest).select(*NODE, "saved", "leaves")
    ends = digests(prefix.where("ends").select("conv_id", *NODE))

    # the nodes share their parents' children among them, so at most HEAVY parents have more than that part
    many = nodes.count() // HEAVY
    parents = nodes.select(*(F.col(c).alias(f"p_{c}") for c in NODE), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy, light = (parents.where(F.col("n_children") > many).drop("n_children"), parents.where(F.col("n_children").between(1, many)).drop("n_children"))
    on = (F.col("depth") - 1 == F.col("p_depth")) & (F.col("up1") == F.col("p_g1")) & (F.col("up2") == F.col("p_g2"))
    below = nodes.where("depth > 0")
    joined = below.join(F.broadcast(heavy), on).unionByName(below.join(F.broadcast(heavy), on, "left_anti").join(light, on))
    joined = joined.drop("p_depth", "p_g1", "p_g2").unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    whole = joined.join(totals, NODE).join(ends, NODE, "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), as they are or rebuilt by families (see ``rebuilt``, ``trie``).

    Turns come by ``turn``, null first, then role and text; a null role or text is empty; rows without a conv_id belong
    to no conversation; repeated rows are turns of their own; other columns are left out.
    """
    turns, convs = placed(conversations)
    if rebuild:
        turns, convs = rebuilt(turns, convs)
    return trie(turns, convs)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=True)


ORACLE = {
    "op13_prefix_trie": """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM t GROUP BY c),
crc AS (
  SELECT c, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda b: ascii(b)::BIGINT), lambda s, b:
           list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384)), 4294967295), 4294967295) % 6 AS h
  FROM sizes),
plan AS (SELECT sizes.c, h, least(h, coalesce(b.n, 0)) AS k, sizes.c - sizes.c % 100 AS base FROM sizes JOIN crc USING (c) LEFT JOIN sizes AS b ON b.c = sizes.c - sizes.c % 100),
turns AS (
  SELECT plan.c, t.p, t.r, t.x FROM plan JOIN t ON t.c = plan.base AND t.p < plan.k
  UNION ALL SELECT plan.c, t.p - h + k, t.r, t.x FROM plan JOIN t ON t.c = plan.c AND t.p >= h),
prefix AS (
  SELECT c, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, length(x) AS w, p + 1 AS d FROM turns
  UNION ALL SELECT c, [], 0, 0 FROM sizes),
lengths AS (SELECT c, max(d) AS d FROM prefix GROUP BY c),
nodes AS (
  SELECT prefix.d, s, min(prefix.c) AS conv_id, count(*) AS n, min(w) AS w,
         sha256(coalesce(string_agg(prefix.c::VARCHAR, ',' ORDER BY prefix.c) FILTER (WHERE lengths.d = prefix.d), '')) AS e
  FROM prefix JOIN lengths USING (c) GROUP BY prefix.d, s),
children AS (SELECT d - 1 AS d, s[1:d - 1] AS s, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
ups AS (
  SELECT a AS d, s[1:a] AS s, (n - 1) * w AS saved, NOT EXISTS (SELECT 1 FROM children WHERE children.s = nodes.s AND children.d = nodes.d) AS leaf
  FROM nodes, range(0, nodes.d + 1) AS r(a)),
totals AS (SELECT d, s, sum(saved)::BIGINT AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM ups GROUP BY 1, 2)
SELECT nodes.conv_id, nodes.d AS depth, parent.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(children.n, 0) AS n_children,
       leaves AS n_leaves, saved AS saved_tokens, nodes.e AS ends_sha256
FROM nodes JOIN totals ON totals.d = nodes.d AND totals.s = nodes.s
LEFT JOIN children ON children.d = nodes.d AND children.s = nodes.s
LEFT JOIN nodes AS parent ON nodes.d > 0 AND parent.d = nodes.d - 1 AND parent.s = nodes.s[1:nodes.d - 1]
"""
}
