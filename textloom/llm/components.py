"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.storage import stash


def _stars(pairs: DataFrame, larger: bool) -> DataFrame:
    """pairs (a, b). Large star: link each neighbour above a to the least of a and its neighbours; small star: those below, and a."""
    near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if larger:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


#: Up to this many edges (16 MB) one task joins them all, which saves the steps' shuffles; the result is the same.
FEW_EDGES = 1 << 20


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of a task: each turn takes every node's label to the least of its neighbours' labels, and labels to their own labels."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    nodes, back = np.unique(np.r_[a, b], return_inverse=True)
    x, y, label = back[: len(a)], back[len(a) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def components(edges: DataFrame, name: str = "components", most: int = 100) -> DataFrame:
    """(node, component) for every node of edges (a, b): the least node that can be reached. Steps end when no edge changes."""
    now = stash(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), name)
    if now.count() <= FEW_EDGES:
        return stash(now.coalesce(1).mapInArrow(_join_all, "node long, component long"), name)
    before = None
    for _ in range(most):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        now = stash(_stars(stash(_stars(now, True), name), False), name)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
