"""Uploads and job states as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stem, upload_kind
from ..operators.jobs import TRANSITIONS


def watch_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they come into a folder: path, stored_name, kind, length and modificationTime. Their numbers come from ``decks.ingest``, batch by batch."""
    kinds = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(kinds).load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return rows.select("path", file_stem(name).alias("stored_name"), upload_kind(F.col("path")).alias("kind"), "length", "modificationTime")


def follow_states(events: DataFrame, job: str, order: str, state: str = "state") -> DataFrame:
    """The streaming form: a job's current state as its events come; an event that may not follow is counted and ignored.

    ``events`` is a stream; per job only its state and a count are kept. Events of one batch are taken in order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def step(key, batches, held):
        now, refused = held.get if held.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for after in rows[state]:
            if after in (TRANSITIONS[now] if now else ("uploaded",)):
                now = after
            else:
                refused += 1
        held.update((now, refused))
        yield pd.DataFrame({job: [key[0]], state: [now], "refused": [refused]})

    return events.groupBy(job).applyInPandasWithState(step, f"{job} {kinds[job]}, {state} string, refused long", f"{state} string, refused long", "update", "NoTimeout")
