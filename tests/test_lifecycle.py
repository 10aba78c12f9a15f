"""Jobs with timers, against a plain fold of each job's events; one action a deck."""

import random
import threading
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from slateflow.operators.guard import AlreadyRunning, Guard
from slateflow.operators.jobs import TRANSITIONS
from slateflow.streaming import lifecycle

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "job string, number long, state string, time timestamp"
LIMITS = {"uploaded": 100, "prepared": 100, "processing": 300}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def write_batches(spark, folder, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(j, n, s, None if t is None else START + timedelta(seconds=t)) for j, n, s, t in rows], SCHEMA)
        df.coalesce(1).write.parquet(f"{folder}/b{i:03}")
        time.sleep(0.02)


def read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def followed(spark, folder, batches, late="1000 seconds", forget=10**6):
    """All transitions after the batches came one by one."""
    write_batches(spark, f"{folder}/in", batches)
    found = []
    rows = lifecycle.follow_jobs(read(spark, f"{folder}/in"), "job", "number", "time", late=late, limits=LIMITS, forget=forget)
    at = F.unix_seconds("at") - int(START.timestamp())
    query = rows.select("job", "number", "before", "state", at.alias("at"), "outcome").writeStream.foreachBatch(lambda df, _: found.extend(map(tuple, df.collect())))
    stream = query.option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    assert stream.awaitTermination(200)
    return found


def folded(events, watermark):
    """What becomes of one job: its events by number, up to the first that is missing."""
    by_number = {}
    for n, state, at in events:
        by_number.setdefault(n, (state, at))
    out, state, since, due, n = [], None, 0, None, 0
    while n + 1 in by_number:
        n += 1
        after, at = by_number[n]
        at = max(at, since)
        if due is not None and at > due:
            out.append((n - 1, state, "failed", due, "expired"))
            state, since, due = "failed", due, None
        if after in (TRANSITIONS[state] if state else ("uploaded",)):
            out.append((n, state, after, at, "applied"))
            state, since = after, at
            due = at + LIMITS[after] if after in LIMITS else None
        else:
            out.append((n, state, state, at, "refused"))
            if state is None and due is None:
                due = at + LIMITS["uploaded"]
    if due is not None and due <= watermark:
        out.append((n, state, "failed", due, "expired"))
    return out


def test_any_division_into_batches_gives_the_fold(rocks, tmp_path):
    rng, jobs, events = random.Random(5), {}, []
    for j in range(40):
        at, mine, state = rng.randrange(100), [], None
        for n in range(1, rng.randrange(2, 8)):
            after = rng.choice((TRANSITIONS[state] if state else ("uploaded",)) or ("failed",)) if rng.random() < 0.85 else rng.choice(list(TRANSITIONS))
            mine.append((n, after, at))
            state = after if n == 1 or after in TRANSITIONS.get(state, ()) else state
            at += rng.choice((1, 20, 60, 150, 280))
        if rng.random() < 0.2 and len(mine) > 2:
            mine.pop(rng.randrange(1, len(mine)))
        jobs[f"j{j}"] = mine
        # some come again
        events += [(f"j{j}", *e) for e in mine + mine[: rng.randrange(3)]]
    rng.shuffle(events)
    batches = [events[i::5] for i in range(5)]
    end = 100000
    found = followed(rocks, tmp_path, [*batches, [("end", 1, "completed", end)], [("end", 2, "completed", end)]], late="5000 seconds")
    got = {}
    for job, *row in found:
        got.setdefault(job, []).append(tuple(row))
    want = {j: folded(e, end - 5000) for j, e in jobs.items()}
    in_order = lambda rows: sorted(rows, key=lambda r: (r[0], r[4] == "expired"))
    for j, rows in want.items():
        assert in_order(got.pop(j)) == in_order(rows), j
    assert set(got) == {"end"}
    assert {r[5] for r in found} == {"applied", "refused", "expired"}


def test_late_missing_and_empty_events(rocks, tmp_path):
    batches = [
        [("a", 1, "uploaded", 0), ("b", 2, "prepared", 10), (None, 1, "uploaded", 0), ("n", None, "uploaded", 0), ("n", 1, None, 0), ("n", 1, "uploaded", None)],
        [("a", 2, "prepared", 50), ("c", 1, "uploaded", 60), ("c", 2, "failed", 61)],
        [("z", 1, "uploaded", 5000)],
        [("z", 2, "failed", 5001)],
        # behind the watermark: dropped; the job has failed by its timer
        [("a", 3, "processing", 120)],
        [("c", 3, "prepared", 9000), ("z", 3, "failed", 9001)],
        [("y", 1, "uploaded", 9002)],
    ]
    found = followed(rocks, tmp_path, batches, late="10 seconds", forget=3000)
    assert [r[1:] for r in found if r[0] == "a"] == [(1, None, "uploaded", 0, "applied"), (2, "uploaded", "prepared", 50, "applied"), (2, "prepared", "failed", 150, "expired")]
    # its first event never came
    assert [r[1:] for r in found if r[0] == "b"] == [(0, None, "failed", 110, "expired")]
    # forgotten after it failed: a later event starts from nothing, and waits
    assert [r[1:] for r in found if r[0] == "c"] == [(1, None, "uploaded", 60, "applied"), (2, "uploaded", "failed", 61, "applied")]
    assert not [r for r in found if r[0] in (None, "n")]


def test_steps_run_on_transition(rocks, tmp_path):
    write_batches(rocks, f"{tmp_path}/in", [[("a", 1, "uploaded", 0), ("b", 1, "uploaded", 0), ("c", 1, "prepared", 0)], [("a", 2, "prepared", 5)], [("a", 3, "uploaded", 6), ("d", 1, "uploaded", 6)]])
    calls, seen = [], []
    note = lambda name: lambda jobs, batch: calls.append((name, sorted(r.job for r in jobs.collect())))
    rows = lifecycle.follow_jobs(read(rocks, f"{tmp_path}/in"), "job", "number", "time", limits=LIMITS)
    stream = lifecycle.run_steps(rows, {"uploaded": note("prepare"), "prepared": note("process"), "completed": note("pack")}, f"{tmp_path}/check", [lambda df, b: seen.append(df.count())])
    assert stream.trigger(availableNow=True).start().awaitTermination(200)
    assert calls == [("prepare", ["a", "b"]), ("process", ["a"]), ("prepare", ["d"])]
    assert sum(seen) == 6


def test_one_action_a_deck(spark):
    failed, go = [], threading.Event()
    guard = Guard(spark, lambda deck, error: failed.append((deck, type(error).__name__)))
    first = guard.start("a,b", lambda: (go.wait(30), spark.range(10).count()))
    with pytest.raises(AlreadyRunning):
        guard.start("a,b", lambda: None)
    other = guard.start("c", lambda: spark.range(10).count())
    other.join(60)
    assert guard.running() == ["a,b"] and not guard.cancel("c")
    go.set()
    first.join(60)
    assert not guard.running() and not failed
    # it may start again, and what it raises is its deck's failure
    guard.start("a,b", lambda: 1 / 0).join(60)
    assert failed == [("a,b", "ZeroDivisionError")]


def test_cancelled_by_tag(spark):
    failed = []
    guard = Guard(spark, lambda deck, error: failed.append(deck))

    def sleepy(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    thread = guard.start("long", lambda: spark.range(0, 2, 1, 2).mapInArrow(sleepy, "id long").collect())
    mine = guard.start("short", lambda: spark.range(100).count())
    until = time.time() + 60
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < until:
        time.sleep(0.1)
    time.sleep(1)
    assert guard.cancel("long")
    thread.join(40)
    mine.join(40)
    assert not thread.is_alive() and failed == ["long"] and not guard.running()
