"""The ledger as a stream: last status by item, first sight by id, batches of books, and (an extension) windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_status(events: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """Updates of (key, status, at, changes): an event older than the state changes nothing but the count."""
    kind, stamp = events.schema[key].dataType.simpleString(), events.schema[at].dataType.simpleString()

    def run(name: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status_, at_, n = state.get if state.exists else (None, None, 0)
        for part in rows:
            n += len(part)
            last = part.sort_values([at, status]).iloc[-1]
            if at_ is None or last[at] >= at_:
                status_, at_ = last[status], last[at]
        state.update((status_, at_, n))
        yield pd.DataFrame({key: [name[0]], status: [status_], at: [at_], "changes": [n]})

    return events.select(key, status, at).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {status} string, {at} {stamp}, changes long", f"{status} string, {at} {stamp}, n long", "update", GroupStateTimeout.NoTimeout)


def first_seen(rows: DataFrame, key: str, at: str, delay: str = "7 days") -> DataFrame:
    """Each key once while its state is kept."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def consolidate_every(books: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, files: int = 10):
    """A query that hands micro-batches of at most `files` new files' rows to step(batch, number) and ends when all are done."""
    return books.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, at: str, width: str, kind: str, delay: str = "10 minutes") -> DataFrame:
    """Extension: counts by window of fixed width."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sliding(events: DataFrame, at: str, width: str, step: str, kind: str, delay: str = "10 minutes") -> DataFrame:
    """Extension: counts by overlapping windows."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width, step), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sessions(events: DataFrame, at: str, gap: str, key: str, delay: str = "10 minutes") -> DataFrame:
    """Extension: sessions by key that end after a gap."""
    return events.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
