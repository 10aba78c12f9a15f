"""Slides rebuilt batch by batch against one full run over the latest edits."""

import os
import random

from pyspark.sql import functions as F

from slateflow.functions.geometry import corners
from slateflow.operators import review
from slateflow.plans import rebuild

KEYS = ["deck", "slide_no"]
EDITS = f"deck string, slide_no int, revision long, boxes {rebuild._BOXES}"


def read(wanted):
    """A reader that finds one line at the top left of every box, and a blank one."""
    place = corners(F.col("x") + 25, F.col("y") + 25, F.lit(20.0), F.lit(10.0))
    rows = wanted.select(*KEYS, "box_id", F.explode(F.array(F.struct(F.concat(F.lit("read in "), "box_id").alias("text"), place.alias("bbox")), F.struct(F.lit(" ").alias("text"), place.alias("bbox")))).alias("l"))
    return rows.select(*KEYS, "box_id", "l.*")


def tables(spark, decks=3, slides=5):
    sizes = [(f"d{d}", n, 640, 360) for d in range(decks) for n in range(1, slides + 1)]
    lines = [(d, n, k, f"line {k} of {n}", [[10.0, 30.0 * k], [200.0, 30.0 * k], [200.0, 30.0 * k + 20], [10.0, 30.0 * k + 20]]) for d, n, *_ in sizes if n != slides for k in range(1 + n % 4)]
    return spark.createDataFrame(sizes, "deck string, slide_no int, width_px int, height_px int"), spark.createDataFrame(lines, "deck string, slide_no int, ord int, text string, bbox array<array<double>>")


def document(r, deck, slide, revision):
    boxes = []
    for k in range(r.randrange(4)):
        kind = r.choice(["text", "text", "figure"])
        source = r.choice([f"line-{k + 1:03d}", None, "line-009"])
        boxes.append((f"line-{k + 1:03d}", r.choice([10.0, 14.0]), 30.0 * k, 190.0, 20.0, kind, r.choice(["base", "", None]), source) if r.random() < 0.7 else (f"own-{k}", r.uniform(0, 600), r.uniform(0, 340), r.uniform(0, 300), 50.0, kind, "manual", None))
    return (deck, slide, revision, boxes)


def everything(df):
    return sorted((tuple(r[c] for c in [*KEYS, "revision", "status", "to_fill", *rebuild.DERIVED]) for r in df.collect()), key=lambda x: x[:2])


def files(path):
    return {b: sorted(os.listdir(f"{path}/{b}")) for b in os.listdir(path) if b.startswith("bucket=")}


def test_batches_equal_a_full_run(spark, tmp_path):
    r = random.Random(3)
    slides, lines = tables(spark)
    store = rebuild.ReviewStore(spark, f"{tmp_path}/states", KEYS, read, buckets=8)
    store.start(slides, lines, ["ord"])
    before = files(store.path)
    assert everything(store.states()) == everything(rebuild.recompute(rebuild.slide_rows(slides, lines, KEYS, ["ord"]), KEYS, read))
    first = [document(r, "d0", 1, 5), document(r, "d1", 2, 1), ("nobody", 1, 1, [])]
    store.apply(spark.createDataFrame(first, EDITS))
    untouched = {b for b, names in files(store.path).items() if names == before[b]}
    touched = {f"bucket={x[0]}" for x in spark.createDataFrame(first, EDITS).select(store.bucket()).collect()}
    assert untouched == set(before) - touched and untouched
    # late, repeated, newer and emptying documents, as a stream of two files
    later = [[document(r, "d0", 1, 4), first[1], document(r, "d2", 3, 1), document(r, "d2", 3, 2), ("d1", 4, 1, [])], [document(r, "d1", 2, 7), document(r, "d0", 5, 1), ("d2", 1, None, [])]]
    for i, rows in enumerate(later):
        spark.createDataFrame(rows, EDITS).coalesce(1).write.parquet(f"{tmp_path}/edits/{i}")
    stream = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/edits/*")
    store.follow(stream, f"{tmp_path}/checkpoint").awaitTermination()
    latest = {}
    for d, n, revision, boxes in [*first, *later[0], *later[1]]:
        if revision is not None and revision >= latest.get((d, n), (-1,))[0]:
            latest[d, n] = (revision, boxes)
    every = spark.createDataFrame([(*k, *v) for k, v in latest.items() if k[0] != "nobody"], EDITS)
    rows = rebuild.slide_rows(slides, lines, KEYS, ["ord"]).drop("revision", "boxes").join(every, KEYS, "left")
    want = everything(rebuild.recompute(rows, KEYS, read))
    got = everything(store.states())
    assert got == want and sum(x[3] == "reviewed" for x in got) == len(latest) - 1
    again = files(store.path)
    store.apply(spark.createDataFrame([], EDITS))
    assert files(store.path) == again
    plan = store.states([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_tagged_lines_are_the_rebuilt_lines(spark):
    r = random.Random(8)
    slides, lines = tables(spark)
    rows = rebuild.slide_rows(slides, lines, KEYS, ["ord"])
    base = rows.select(*KEYS, F.explode("baseline").alias("b")).select(*KEYS, "b.*")
    edits = spark.createDataFrame([document(r, f"d{d}", n, 1) for d in range(3) for n in range(1, 6)], EDITS)
    edited = review.sanitize_boxes(edits.select(*KEYS, F.explode("boxes").alias("b")).select(*KEYS, "b.*"))
    changes = review.compare_with_baseline(edited, base, KEYS)
    anew = read(review.boxes_to_read(changes))
    final, removed = review.rebuild_lines(changes, base, anew, KEYS)
    tagged = review.tagged_lines(changes, base, anew, KEYS).select(*KEYS, "kind", "box_id", "text", "bbox")
    both = lambda df: sorted(map(tuple, df.select(*KEYS, "box_id", "text", "bbox").collect()))
    assert both(tagged.where("kind = 'removed'")) == both(removed) and both(tagged.where("kind <> 'removed'")) == both(final)
    assert {x.kind for x in tagged.collect()} == {"kept", "read", "removed"}


def test_lines_in_rows_are_the_rebuilt_lines(spark):
    """Where a slide is one row, a box of an id that another has too, of unknown sources and without any."""
    r = random.Random(8)
    slides, lines = tables(spark)
    rows = rebuild.slide_rows(slides, lines, KEYS, ["ord"]).drop("boxes", "revision")
    base = rows.select(*KEYS, F.explode("baseline").alias("b")).select(*KEYS, "b.*")
    documents = [document(r, f"d{d}", n, 1) for d in range(3) for n in range(1, 6)]
    documents = [(d, n, v, [*boxes, *boxes[:1], ("own", 5.0, 25.0, 0.0, 9.0, "chart", "", "")]) for d, n, v, boxes in documents]
    edits = spark.createDataFrame(documents, EDITS).select(*KEYS, F.transform("boxes", lambda b, i: b.withField("ord", i)).alias("boxes"))
    edited = review.sanitize_boxes(edits.select(*KEYS, F.explode("boxes").alias("b")).select(*KEYS, "b.*"))
    changes = review.compare_with_baseline(edited, base, KEYS)
    final, removed = review.rebuild_lines(changes, base, read(review.boxes_to_read(changes)).distinct(), KEYS)
    compared = review.compare_in_rows(rows.join(edits, KEYS))
    boxes = review.compared_boxes(compared, KEYS)
    columns = [*KEYS, "ord", "box_id", "x", "y", "width", "height", "change", "base"]
    by_row = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert by_row(boxes) == by_row(changes) and {x.change for x in boxes.collect()} == {"kept", "moved", "new"}
    tagged = review.lines_in_rows(compared, read(review.boxes_to_read(boxes)).distinct(), KEYS).select(*KEYS, F.explode("tagged").alias("l")).select(*KEYS, "l.*")
    both = lambda df: sorted(map(tuple, df.select(*KEYS, "box_id", "text", "bbox").collect()))
    assert both(tagged.where("kind = 'removed'")) == both(removed) and both(tagged.where("kind <> 'removed'")) == both(final)


def test_slides_are_shuffled_once(spark):
    """Rows that lie by slide are rebuilt where they lie, the boxes that are read again too."""
    slides, lines = tables(spark)
    rows = rebuild.slide_rows(slides, lines, KEYS, ["ord"]).repartition(3, *KEYS)
    plan = rebuild.recompute(rows, KEYS, read)._jdf.queryExecution().executedPlan().toString()
    without = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 * without.count("Exchange")


def test_edits_of_rows_that_are_not_stored(spark):
    r = random.Random(4)
    slides, lines = tables(spark)
    rows = rebuild.slide_rows(slides, lines, KEYS, ["ord"])
    first = spark.createDataFrame([document(r, f"d{d}", n, 5) for d in range(2) for n in range(1, 4)], EDITS)
    later = spark.createDataFrame([document(r, "d0", 1, 4), document(r, "d0", 2, 6), ("d1", 1, 7, None), ("d2", 1, None, []), ("nobody", 1, 9, [])], EDITS)
    edited = rebuild.with_edits(rows, first, KEYS)
    want = rebuild.apply_edits(rebuild.recompute(edited, KEYS, read), later, KEYS, read)
    assert everything(rebuild.recompute(rebuild.with_edits(edited, later, KEYS), KEYS, read)) == everything(want)
