"""Rectangles by tiles, against every pair."""

import random

from pyspark.sql import functions as F

from slateflow.operators import tiles
from slateflow.plans import catalogue


def boxes(spark, rows, name):
    df = spark.createDataFrame(rows, f"slide int, {name} int, x double, y double, width double, height double")
    return df.select("slide", name, F.struct("x", "y", "width", "height").alias(f"{name}_box"))


def pairs(spark, a, b, side=tiles.TILE):
    found = tiles.touching(boxes(spark, a, "a"), boxes(spark, b, "b"), ["slide"], F.col("a_box"), F.col("b_box"), side)
    assert found.columns == ["slide", "a", "a_box", "b", "b_box"]
    return found


def brute(a, b):
    out = []
    for s, i, x, y, w, h in a:
        for t, j, u, v, p, q in b:
            if s is not None and s == t and None not in (x, y, w, h, u, v, p, q) and min(w, h, p, q) >= 0:
                if x <= u + p and u <= x + w and y <= v + q and v <= y + h:
                    out.append((s, i, j))
    return sorted(out)


def test_every_touching_pair_once(spark):
    rng = random.Random(3)

    def some(n):
        side = lambda: rng.choice((0.0, 1.0, 16.0, 64.0, rng.uniform(0, 300)))
        at = lambda: rng.choice((0.0, 64.0, -64.0, 128.0, rng.uniform(-200, 400)))
        return [(rng.choice((1, 1, 1, 2, None)), i, at(), at(), side(), side()) for i in range(n)]

    a, b = some(120), some(150)
    a += [a[0], (1, 500, None, 1.0, 1.0, 1.0), (1, 501, 0.0, 0.0, -1.0, 5.0)]
    want = brute(a, b)
    assert len(want) > 500
    for side in (16.0, 64.0, 1000.0):
        assert sorted((r.slide, r.a, r.b) for r in pairs(spark, a, b, side).collect()) == want


def test_empty_and_plan(spark):
    a = [(1, 1, 0.0, 0.0, 5.0, 5.0)]
    assert pairs(spark, a, []).isEmpty() and pairs(spark, [], a).isEmpty()
    plan = pairs(spark, a, a)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_query_is_registered():
    from slateflow.plans import layout_queries  # noqa: F401

    assert "lines_in_boxes" in catalogue.QUERIES and "lines_in_boxes" in catalogue.ORACLE_SQL


def test_boxes_are_worked_out_once(spark):
    """No filter below the tiles repeats what a box is made of."""
    from slateflow.functions import geometry as G

    table = spark.createDataFrame([(1, 1, [[0.0, 0.0], [70.0, 9.0]]), (1, 2, [])], "slide int, a int, poly array<array<double>>")
    left = table.select("slide", "a", G.bounds(F.col("poly")).alias("of_a"))
    right = table.select("slide", F.col("a").alias("b"), G.bounds(F.col("poly")).alias("of_b"))
    out = tiles.touching(left, right, ["slide"], F.col("of_a"), F.col("of_b"))
    assert [(q.slide, q.a, q.b) for q in out.collect()] == [(1, 1, 1)]
    assert not any("Filter" in step and "transform(" in step for step in out._jdf.queryExecution().toString().split("== Optimized Logical Plan ==")[1].split("\n"))
