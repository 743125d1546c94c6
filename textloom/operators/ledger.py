"""Incremental state: a ledger of (operation, item, status, time), last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key, whole."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e"), F.count("*").alias("events")).select(*keys, *(F.col(f"e.{c}").alias(c) for c in rest), "events")


def summary(last: DataFrame, status: str, amounts: list[str]) -> DataFrame:
    """Items and summed amounts by status."""
    return last.groupBy(status).agg(F.count("*").alias("items"), *(F.sum(a).alias(f"total_{a}") for a in amounts))


def completed(last: DataFrame, status: str = "status") -> DataFrame:
    """Items that need no more work: skipped ones count as completed."""
    return last.where(F.col(status).isin("completed", "skipped"))


def pending(items: DataFrame, last: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Items that no completed or skipped event covers."""
    return items.join(completed(last, status).select(key), key, "left_anti")


def recoverable(last: DataFrame, rule: Column, status: str = "status") -> DataFrame:
    """Skipped items that a rule brings back."""
    return last.where((F.col(status) == "skipped") & F.coalesce(rule, F.lit(False)))


def transitions(events: DataFrame, key: str, order: list[str], event: str, server: str, most: int = 3) -> DataFrame:
    """(key, state, attempts, status, events): where a series of events leaves each item.

    event: stacked (being worked on), retried (counts an attempt), failed or processed. Being processed or failed ends
    the attempts; an item whose attempts reach `most` has failed for good; one processed stays so whatever comes later
    but its status is the last one's: assigned (server semantic_fastpath), the server's own name where that begins with
    skipped_, else extracted.
    """
    at = F.struct(*order)
    last = lambda kind: F.max(F.when(F.col(event) == kind, at))
    rows = events.withColumn("_s", F.when(F.col(server) == "semantic_fastpath", "assigned").when(F.startswith(F.coalesce(server, F.lit("")), F.lit("skipped_")), F.col(server)).otherwise("extracted"))
    ends = rows.groupBy(key).agg(F.max(F.when(F.col(event).isin("processed", "failed"), at)).alias("_end"))
    one = rows.join(ends, key).groupBy(key).agg(
        F.count("*").alias("events"), last("processed").alias("_p"), last("failed").alias("_f"), F.max_by(event, at).alias("_last"),
        F.count_if((F.col(event) == "retried") & (F.col("_end").isNull() | (at > F.col("_end")))).alias("attempts"), F.max_by("_s", F.when(F.col(event) == "processed", at)).alias("status"),
    )
    state = F.when(F.col("_p").isNotNull(), "processed").when(F.col("_f").isNotNull() | (F.col("attempts") >= most), "failed").when(F.col("_last") == "stacked", "stacked").otherwise("retried")
    return one.select(key, state.alias("state"), "attempts", "status", "events")


def milestones(df: DataFrame, key: str, order: list[str], step: float = 10.0) -> DataFrame:
    """(key, order .., step): rows of a key at which the share of its rows seen so far, in percent, first reaches a further multiple of `step`. The largest multiple reached is given."""
    w = Window.partitionBy(key)
    at = F.floor(100.0 * F.row_number().over(w.orderBy(*order)) / F.count("*").over(w) / step)
    seen = df.select(key, *order, at.alias("step"))
    return seen.withColumn("_before", F.lag("step").over(w.orderBy("step", *order))).where(F.col("step") > F.coalesce("_before", F.lit(0))).drop("_before")


def token_totals(usage: DataFrame, section: str, kinds: list[str], prices: DataFrame | None = None) -> DataFrame:
    """Token sums by section with their total and, given prices (section, one column for each kind, for a million), the cost."""
    out = usage.groupBy(section).agg(*(F.sum(k).alias(k) for k in kinds)).withColumn("total", sum((F.col(k) for k in kinds), F.lit(0)))
    if prices is None:
        return out
    p = prices.select(section, *(F.col(k).alias(f"_{k}") for k in kinds))
    return out.join(F.broadcast(p), section, "left").withColumn("cost", sum((F.col(k) * F.coalesce(f"_{k}", F.lit(0.0)) / 1e6 for k in kinds), F.lit(0.0))).drop(*(f"_{k}" for k in kinds))


def server_statistics(calls: DataFrame, server: str, task: str, priority: str, amounts: list[str]) -> DataFrame:
    """Calls and amounts by server and task, with a total for each server (task null); least priority and all tasks."""
    return calls.rollup(server, task).agg(F.count("*").alias("calls"), *(F.sum(a).alias(a) for a in amounts), F.min(priority).alias("priority"), F.sort_array(F.collect_set(task)).alias("tasks")).where(F.col(server).isNotNull())
