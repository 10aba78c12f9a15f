"""Jobs with time: numbered events put in order, states that may not last for ever, and steps that run as jobs enter a state."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.jobs import TRANSITIONS

#: Seconds that a job may stay in a state; a state that isn't named waits for a person.
LIMITS = {"uploaded": 3600, "prepared": 3600, "processing": 7200, "rebuilding_slide": 1800, "building_deck": 3600}
#: Seconds after which a finished job's state is dropped.
FORGET = 7 * 86400
TERMINAL = tuple(s for s, after in TRANSITIONS.items() if not after)


class JobClock(StatefulProcessor):
    """A job's state, the events that wait for their predecessors, and a timer for the state's end.

    Held are one row a job and its waiting events, in the state store; what a job has behind it is not kept. The result doesn't depend on how events
    are divided into batches: an event later than the end of the state it meets finds the job failed, whether the timer has run yet or not.
    """

    def __init__(self, job: str, limits: dict[str, int], forget: int):
        self.job, self.limits, self.forget = job, limits, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, number long, since long, due long")
        self.waiting = handle.getMapState("waiting", "number long", "state string, at long")

    def handleInputRows(self, key, rows, timerValues):
        state, number, since, due = self.now.get() if self.now.exists() else (None, 0, None, None)
        came = pd.concat(list(rows)).sort_values(["number", "at", "state"], kind="stable")
        for n, after, at in zip(came["number"], came["state"], came["at"]):
            if n > number and not self.waiting.containsKey((int(n),)):
                self.waiting.updateValue((int(n),), (after, int(at)))
        was, out = due, []
        while self.waiting.containsKey((number + 1,)):
            after, at = self.waiting.getValue((number + 1,))
            self.waiting.removeKey((number + 1,))
            # that a first event is waited for ends with it
            at, due, number = max(at, since or 0), due if number else None, number + 1
            if state not in TERMINAL and due is not None and at > due:
                out.append((number - 1, state, "failed", due, "expired"))
                state, since, due = "failed", due, self._due("failed", due)
                at = max(at, since)
            if after in (TRANSITIONS[state] if state else ("uploaded",)):
                out.append((number, state, after, at, "applied"))
                state, since, due = after, at, self._due(after, at)
            else:
                out.append((number, state, state, at, "refused"))
                if state is None and due is None:
                    due = self._due("uploaded", at)
        if state is None and due is None and len(came):
            # its first event is missing: it may come as late as an uploaded job may rest
            due = self._due("uploaded", int(came["at"].min()))
        self.now.update((state, number, since, due))
        self._wake(was, due)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, number, since, due = self.now.get() if self.now.exists() else (None, 0, None, None)
        if due is None or due != expiredTimerInfo.getExpiryTimeInMs():
            return
        if state in TERMINAL:
            self.now.clear()
            self.waiting.clear()
            return
        end = self._due("failed", due)
        self.now.update(("failed", number, due, end))
        self._wake(None, end)
        yield self._rows(key, [(number, state, "failed", due, "expired")])

    def close(self) -> None:
        pass

    def _due(self, state: str, since: int) -> int | None:
        seconds = self.forget if state in TERMINAL else self.limits.get(state)
        return None if seconds is None else since + seconds * 1000

    def _wake(self, was: int | None, due: int | None) -> None:
        if was != due:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        # texts as objects: Arrow-backed ones don't go back into a struct
        columns = [self.job, "number", "before", "state", "at", "outcome"]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=columns, dtype=object).astype({"number": "int64", "at": "int64"})


def follow_jobs(events: DataFrame, job: str, number: str, time: str, state: str = "state", late: str = "10 minutes", limits: dict[str, int] = LIMITS, forget: int = FORGET) -> DataFrame:
    """Transitions (``job``, number, before, state, at, outcome) of a stream of events, which each job numbers 1, 2, 3, ...

    An event waits until its predecessors have come; one that comes again, or whose number is taken, changes nothing. Outcomes: applied; refused,
    where the state may not follow (before and state are equal); expired, where a job stayed in a state for longer than ``limits`` says and failed.
    A job whose next event never comes fails that way, too, and so does one whose first event is missing. Events later than ``late`` are dropped
    by the watermark. Events without job, number, state or time are left out. The state store must be RocksDB's.
    """
    kind = events.schema[job].dataType.simpleString()
    rows = events.where(" and ".join(f"`{c}` is not null" for c in (job, number, state, time))).withWatermark(time, late)
    rows = rows.select(job, F.col(time), F.col(number).cast("long").alias("number"), F.col(state).alias("state"), F.unix_millis(time).alias("at"))
    schema = f"`{job}` {kind}, number long, before string, state string, at long, outcome string"
    found = rows.groupBy(job).transformWithStateInPandas(JobClock(job, limits, forget), schema, "Append", "EventTime")
    return found.withColumn("at", F.timestamp_millis("at"))


def run_steps(transitions: DataFrame, steps: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, finish: Iterable[Callable[[DataFrame, int], None]] = ()):
    """A stream writer that calls, batch by batch, each state's step with all jobs that entered it, then ``finish`` with the batch's transitions.

    A batch may run again after a failure, with the same number, so steps must be such that a second run changes nothing (as overwriting a job's folder is).
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        held = rows.persist()
        try:
            entered = held.where("outcome <> 'refused'")
            there = {r.state for r in entered.select("state").distinct().collect()}  # as many as there are states
            for state, step in steps.items():
                if state in there:
                    step(entered.where(F.col("state") == state), batch_id)
            for last in finish:
                last(held, batch_id)
        finally:
            held.unpersist()

    return transitions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
