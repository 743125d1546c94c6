"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingle sets.

One permutation of hashes orders all shingles. An item of n distinct shingles is found in a document that holds
at least `need` = ceil(containment * n) of them, so at most n - need are missing. Its sketch are its n - need + r
least shingles in that order (a bottom-k MinHash sketch); a document that holds the item therefore holds at least r
of the sketch, whatever its length and wherever the shingles stand. That bound has no exceptions: no match is lost.

Items are partitioned by size, class c holding those of 2 ** (c - 1) < n <= 2 ** c distinct shingles. Within a class
all sketches end at much the same place of the order, so a document shows the class only its minima up to the
highest of them; r grows with the size, which spares large items most of the false candidates. Documents with r
hits on an item's sketch are candidates; for these the share of the item's distinct shingles found anywhere in the
whole document is computed exactly.

Items are the stated query set: they are taken in groups of at most `GROUP_SHINGLES` shingles, each group's
index is sent to all tasks, and each task compares its documents with it. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.batches import Words, as_buffer, blocks, distinct_by_row, mix, shingles, words
from textloom.sources.tables import table
from textloom.storage import stash

GROUP_SHINGLES = 2_000_000
#: Sketch hits expanded to items at once, unless one document has more.
_HITS = 1 << 20
_ORDER = np.uint64(0xA24BAED4963EE407)


def _order(values: np.ndarray) -> np.ndarray:
    """The place of shingles in the order that sketches are taken by; one to one."""
    return mix(values ^ _ORDER)


class _Class:
    """The sketches of the items of one size: places in order, with the items that have them."""

    def __init__(self, places: list[np.ndarray], items: list[int]):
        every = np.concatenate(places)
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.array(items), [len(x) for x in places])[order]
        self.places, self.first = np.unique(every[order], return_index=True)
        self.owner, self.first = owner, np.r_[self.first, len(owner)]
        self.top = self.places[-1]
        self.shift = np.uint64(64 - min(24, max(12, (16 * len(self.places)).bit_length())))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self.places >> self.shift] = True

    def hits(self, places: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, number of a sketch place)."""
        near = np.flatnonzero(self.maybe[places >> self.shift])
        near = near[places[near] <= self.top]
        at = np.searchsorted(self.places, places[near])
        ok = self.places[at] == places[near]
        number, row = distinct_by_row(at[ok], rows[near[ok]])
        return row, number


class ItemIndex:
    """Items given as (shingle length, distinct shingle hashes in order), found from a share of `containment` on."""

    def __init__(self, items: list[tuple[int, np.ndarray]], containment: float):
        self.sets = [s for _, s in items]
        self.need = np.array([ceil(containment * len(s) - 1e-9) for s in self.sets], np.int64)
        self.hits = np.ones(len(items), np.int64)
        by: dict[tuple[int, int], tuple[list, list]] = {}
        for i, (k, s) in enumerate(items):
            if len(s):
                self.hits[i] = max(1, min(1 + self.need[i] // 8, self.need[i]))
                size = min(len(s), len(s) - max(1, int(self.need[i])) + int(self.hits[i]))
                sketches, owners = by.setdefault((k, (len(s) - 1).bit_length()), ([], []))
                sketches.append(np.partition(_order(s), size - 1)[:size])
                owners.append(i)
        self.parts: dict[int, list[_Class]] = {}
        for (k, _), (sketches, owners) in sorted(by.items()):
            self.parts.setdefault(k, []).append(_Class(sketches, owners))

    def candidates(self, values: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Distinct (row, item) pairs in order, of k-word shingles with enough hits on the item's sketch."""
        places, found = _order(values), [np.zeros((0, 2), np.int64)]
        for own in self.parts[k]:
            row, number = own.hits(places, rows)
            n = own.first[number + 1] - own.first[number]
            total, a = np.cumsum(n), 0
            while a < len(row):  # whole rows, of about _HITS hits
                last = row[min(int(np.searchsorted(total, (total[a - 1] if a else 0) + _HITS)), len(row) - 1)]
                b = max(int(np.searchsorted(row, last, "left")), int(np.searchsorted(row, row[a], "right")))
                b = len(row) if last == row[-1] and total[-1] - (total[a - 1] if a else 0) <= _HITS else b
                m = n[a:b]
                at = np.repeat(own.first[number[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                pairs, count = np.unique(np.repeat(row[a:b], m) * len(self.sets) + own.owner[at], return_counts=True)
                item = pairs % len(self.sets)
                ok = count >= self.hits[item]
                found.append(np.stack([pairs[ok] // len(self.sets), item[ok]], 1))
                a = b
        out = np.concatenate(found)
        return out[np.lexsort((out[:, 1], out[:, 0]))]

    def matches(self, w: Words, rows: int) -> list[list[tuple[int, int, int]]]:
        """For each row its items: (item, distinct shingles, how many of them the row has)."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
        for k in self.parts:
            values, at = shingles(w, k)
            last, own = -1, None
            for row, item in self.candidates(values, at, k).tolist():
                if row != last:
                    a, b = np.searchsorted(at, [row, row + 1])
                    last, own = row, np.unique(values[a:b])
                place = np.minimum(np.searchsorted(own, self.sets[item]), len(own) - 1)
                n = int((own[place] == self.sets[item]).sum())
                if n >= self.need[item]:
                    out[row].append((item, len(self.sets[item]), n))
        return out


def item_sets(items: DataFrame, k: int, text_col: str, id_col: str) -> DataFrame:
    """(item, k, n, shingles) of each item that has a word; one of fewer than k words is a single shingle of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            buf, off = as_buffer(batch.column("text"))
            w = words(buf, off)
            first = w.first(batch.num_rows)
            for i in range(batch.num_rows):
                own = Words(*(x[first[i] : first[i + 1]] for x in w))
                if len(own.hash):
                    values, _ = shingles(own, size := min(k, len(own.hash)))
                    yield pa.RecordBatch.from_arrays([batch.column("item").slice(i, 1), pa.array([size], pa.int32()), pa.array([len(own_set := np.unique(values))], pa.int64()), pa.array([own_set.tobytes()], pa.binary())], ["item", "k", "n", "shingles"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(run, f"item {kind}, k int, n long, shingles binary")


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, containment: float = 0.8, text_col: str = "text", item_text_col: str = "text", item_id_col: str = "item_id", out_col: str = "leaks") -> DataFrame:
    """docs with an array of (item, n_shingles, n_common) for the items whose shingles a row holds to that share or more.

    containment lies in 0 < containment <= 1. Every row and column stays; a column named out_col is replaced. A null, empty or blank text holds nothing;
    items without a word are never found; an item given twice is found twice. Items of fewer than k words are
    one shingle of their length. An empty item table leaves all arrays empty.
    """
    sets = stash(item_sets(items, k, item_text_col, item_id_col), "leak-items")
    total = sets.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // GROUP_SHINGLES))
    kind = items.schema[item_id_col].dataType
    leak = T.ArrayType(T.StructType([T.StructField("item", kind), T.StructField("n_shingles", T.LongType()), T.StructField("n_common", T.LongType())]))
    rest = docs.drop(out_col)
    out = rest.withColumn(out_col, F.array().cast(leak))
    for g in range(groups):
        rows = sets.where(F.pmod(F.xxhash64("shingles"), F.lit(groups)) == g).collect()  # about GROUP_SHINGLES shingles
        if rows:
            out = _search(out, rows, text_col, out_col, containment)
    return out


def _search(docs: DataFrame, items: list, text_col: str, out_col: str, containment: float) -> DataFrame:
    ids = [r["item"] for r in items]
    shared = docs.sparkSession.sparkContext.broadcast([(r["k"], bytes(r["shingles"])) for r in items])
    names = [f"_{i}" for i in range(len(docs.columns))]
    at, last = docs.columns.index(text_col), len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex([(k, np.frombuffer(s, np.uint64)) for k, s in shared.value], containment)
        for batch in blocks(batches, names[at], 4 << 20):
            w = words(*as_buffer(batch.column(at)))
            found = index.matches(w, batch.num_rows)
            before = batch.column(last).to_pylist()
            after = [(x or []) + [{"item": ids[i], "n_shingles": n, "n_common": c} for i, n, c in y] for x, y in zip(before, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(after, batch.schema.field(last).type)], names)

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item found in it."""
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", F.col("x.item").alias("item_id"), "x.n_shingles", "x.n_common", (F.col("x.n_common") / F.col("x.n_shingles")).alias("containment"))


QUERIES = {"op4_decontaminate": op4_decontaminate}

SQL = {
    "op4_decontaminate": r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), items AS (
  SELECT item_id, least(5, len(w)) AS k, w FROM item_words WHERE len(w) > 0
), item_shingles AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM items
), sizes AS (
  SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id
), doc_shingles AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM doc_words, (SELECT DISTINCT k FROM items) WHERE len(w) >= k
), common AS (
  SELECT doc_id, item_id, count(*) AS n_common FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shingles, n_common, n_common::DOUBLE / n_shingles AS containment FROM common JOIN sizes USING (item_id) WHERE n_common >= 0.8 * n_shingles
"""
}
