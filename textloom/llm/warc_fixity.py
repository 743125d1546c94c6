"""WARC fixity: Merkle trees over records and ordered offset ranges, compared from the root down.

Each replica has a tree of its own. Its leaves are SHA-256 of a zero byte and the record, in order of ids and hashes,
equal records folded into one leaf with a count; positions and byte offsets are running sums over range partitions, so
no task sees all rows. A leaf whose own hash is a multiple of `fan` begins a node, of `fan` ** 2 one of the level
above, and so on: about `fan` children make a node, and a record lost or added moves no boundary but its own. A node's
hash covers its children's hashes, the byte ranges they span within it and their copies; nodes are known by the record
that they begin with. An audit compares the roots and goes on only below nodes that differ, in both replicas, down to
the records; it gives the byte ranges that differ on each level. Records are laid out by id: an archive's own order
of records is not audited.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.tables import table
from textloom.storage import stash

FAN = 16


def record_of(id_: Column, url: Column, body: Column) -> Column:
    """A WARC response record, binary. Null url and body count as empty; null ids read `null`."""
    body = F.coalesce(body.cast("binary"), F.lit(b""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def write_warc(records: DataFrame, path: str, record_col: str = "record") -> None:
    """Write records, whatever their bytes, as WARC files, one for each partition. Null records are left out."""
    body = F.substring(F.col(record_col), F.lit(1), F.length(record_col) - 4)  # all but the last line ends, which the writer puts there
    records.where(F.col(record_col).isNotNull()).select(body.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, byte_offset, record_id, url, record, body) of the records of plain WARC files.

    Each file is one row of a task: files should be of some hundred MB at most. An empty file has no records; a record
    without the header of its id or url has null there; bytes that are no record raise ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_ = lambda head, name: (m.group(1).decode() if (m := re.search(rb"(?mi)^" + name + rb":[ \t]*(.*?)\r$", head)) else None)
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, at = [], 0
                while at < len(data):
                    begin = data.find(b"\r\n\r\n", at)
                    if data[at : at + 5] != b"WARC/" or begin < 0:
                        raise ValueError(f"{name}: no record at {at}")
                    head = data[at : begin + 2]
                    end = begin + 4 + int(field_(head, b"Content-Length") or 0)
                    rows.append((name, at, field_(head, b"WARC-Record-ID"), field_(head, b"WARC-Target-URI"), data[at : end + 4], data[begin + 4 : end]))
                    at = end + 4
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "byte_offset", "record_id", "url", "record", "body"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, byte_offset long, record_id string, url string, record binary, body binary")


def running(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """df with the columns `sums` summed over all rows before, in order. Ranges of rows are summed apart, then one total for each is added."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            made = []
            for c in sums:
                n = batch.column(c).to_numpy().astype(np.int64)
                made += [pa.array(n), pa.array(at[c] + np.cumsum(n) - n)]
                at[c] += int(n.sum())
            rest = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, *made, pa.array(np.full(batch.num_rows, part, np.int32))], [*names, *(x for c in sums for x in (f"_{c}", c)), "_part"])

    names = [c for c in df.columns if c not in sums]
    by = [F.col(c).asc_nulls_first() for c in order]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), *(f"`_{c}` long, `{c}` long" for c in sums), "_part int"])
    local = stash(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema), "running")
    totals = local.groupBy("_part").agg(*(F.sum(f"_{c}").alias(c) for c in sums)).orderBy("_part").collect()  # a row for each partition
    base, at = [], [0] * len(sums)
    for r in totals:
        base.append((r._part, *at))
        at = [x + r[c] for x, c in zip(at, sums, strict=True)]
    small = F.broadcast(df.sparkSession.createDataFrame(base, ", ".join(["_part int", *(f"_b{i} long" for i in range(len(sums)))])))
    return local.join(small, "_part").select(*names, *((F.col(c) + F.col(f"_b{i}")).alias(c) for i, c in enumerate(sums)))


def leaves(records: DataFrame, id_col: str, record_col: str = "record", height: int = 1, fan: int = FAN) -> DataFrame:
    """(id, leaf, n_bytes, copies, position, byte_offset, u1 ..) of the distinct records in order; u1 ..: the numbers of the nodes they lie in."""
    record = F.coalesce(F.col(record_col), F.lit(b""))
    hashed = records.select(F.col(id_col).alias("id"), F.length(record).cast("long").alias("n_bytes"), F.sha2(F.concat(F.lit(b"\x00"), record), 256).alias("leaf"))
    distinct = hashed.groupBy("id", "leaf", "n_bytes").agg(F.count("*").alias("copies"))
    mark = F.xxhash64("id", "leaf")
    marks = [(F.pmod(mark, F.lit(fan**level)) == 0).cast("long").alias(f"m{level}") for level in range(1, height + 1)]
    sized = distinct.select("id", "leaf", "n_bytes", "copies", F.col("copies").alias("position"), (F.col("copies") * F.col("n_bytes")).alias("byte_offset"), *marks, *(m.alias(f"u{i}") for i, m in enumerate(marks, 1)))
    summed = running(sized, ["id", "leaf", "n_bytes"], ["position", "byte_offset", *(f"u{i}" for i in range(1, height + 1))])
    up = [(F.col(f"u{i}") + F.col(f"m{i}")).alias(f"u{i}") for i in range(1, height + 1)]
    return stash(summed.select("id", "leaf", "n_bytes", "copies", "position", "byte_offset", *up), "warc-leaves")


@dataclass
class Tree:
    """A replica's leaves and its node tables from level 1 up: (number, key, hash, begin, end, parent)."""

    leaves: DataFrame
    levels: list[DataFrame]
    root: str | None


def _hex(x: Column) -> Column:
    return F.lpad(F.hex(x), 16, "0")


def _hash(children: Column, begin: Column) -> Column:
    """SHA-256 of a one byte and the children in order: hash, begin after the node's own begin, length, number of copies."""
    parts = F.transform(F.array_sort(children), lambda c: F.concat(c["hash"], _hex(c["begin"] - begin), _hex(c["end"] - c["begin"]), _hex(c["copies"])))
    return F.sha2(F.concat(F.lit(b"\x01"), F.unhex(F.array_join(parts, ""))), 256)


def tree(placed: DataFrame, height: int) -> Tree:
    """The tree over a replica's leaves with `height` levels of nodes below the root."""
    key = F.concat_ws(":", "leaf", F.coalesce(F.col("id").cast("string"), F.lit("null")))
    now = placed.select("position", key.alias("key"), F.col("leaf").alias("hash"), F.col("byte_offset").alias("begin"), (F.col("byte_offset") + F.col("copies") * F.col("n_bytes")).alias("end"), "copies", *(f"u{i}" for i in range(1, height + 1)))
    levels: list[DataFrame] = []
    for level in range(1, height + 1):
        rest = [f"u{i}" for i in range(level + 1, height + 1)]
        up = now.groupBy(F.col(f"u{level}").alias("number")).agg(
            F.collect_list(F.struct("position", "hash", "begin", "end", "copies")).alias("children"), F.min_by("key", "position").alias("key"), F.min("position").alias("position"), F.min("begin").alias("begin"), F.max("end").alias("end"), *(F.min(c).alias(c) for c in rest)
        )
        named = F.when(F.col("number") == 0, "first").otherwise(F.col("key"))  # what comes before the first boundary
        up = up.select("number", named.alias("key"), "position", _hash(F.col("children"), F.col("begin")).alias("hash"), "begin", "end", F.lit(1).cast("long").alias("copies"), *rest)
        levels.append(now := stash(up, "warc-level"))
    top = now.agg(F.collect_list(F.struct("position", "hash", "begin", "end", "copies")).alias("children"), F.min("begin").alias("begin")).select(_hash(F.col("children"), F.col("begin")).alias("hash"), F.size("children").alias("n")).first()
    return Tree(placed, levels, top.hash if top.n else None)


@dataclass
class Comparison:
    """records: as audit gives them. ranges: (level, begin, end, other_begin, other_end) of the byte ranges that differ, null where a replica has no such range."""

    records: DataFrame
    ranges: DataFrame
    root: str | None
    other_root: str | None


def _matched(left: DataFrame, order: str) -> DataFrame:
    """Rows of (k, leaf, n, ..) once for each of n copies, with their place among those of k."""
    from textloom.llm.skew import join_dealt

    summed = running(left.withColumn("g", F.col("n")), ["k", "leaf"], ["g"])
    first = summed.groupBy("k").agg(F.min("g").alias("first"))
    every = join_dealt(summed, first, "k", "leaf").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return every.withColumn(order, F.col("g") - F.col("first") + F.col("i"))


def compare(first: DataFrame, second: DataFrame, id_col: str, record_col: str = "record", fan: int = FAN) -> Comparison:
    n, height = max(first.count(), second.count()), 1
    while fan**height < n:
        height += 1
    a, b = (tree(leaves(x, id_col, record_col, height, fan), height) for x in (first, second))
    spark = first.sparkSession
    ranges = spark.createDataFrame([], "level int, begin long, end long, other_begin long, other_end long")
    key = F.coalesce(F.concat(F.lit("v"), F.col("id").cast("string")), F.lit("n")).alias("k")
    cols = ["k", "id", "leaf", "n_bytes", "n", "position", "byte_offset"]
    x, y = (t.leaves.select(key, "id", "leaf", "n_bytes", F.col("copies").alias("n"), "position", "byte_offset", "u1") for t in (a, b))
    if a.root == b.root:
        x, y = x.limit(0), y.limit(0)
    else:
        bad = None
        for level in range(height, 0, -1):
            p, q = (t.levels[level - 1].select("number", "key", "hash", "begin", "end", *([f"u{level + 1}"] if level < height else [])) for t in (a, b))
            if bad is not None:
                p, q = (z.join(bad.where(f"{side} is not null").select(F.col(side).alias(f"u{level + 1}")), f"u{level + 1}", "left_semi").drop(f"u{level + 1}") for z, side in ((p, "x"), (q, "y")))
            q = q.toDF("y", "key", "other_hash", "other_begin", "other_end")
            both = p.withColumnRenamed("number", "x").join(q, "key", "full").where(~F.col("hash").eqNullSafe(F.col("other_hash")))
            bad = stash(both.select("x", "y", "begin", "end", "other_begin", "other_end"), "warc-differ")
            ranges = ranges.unionByName(bad.select(F.lit(level).alias("level"), "begin", "end", "other_begin", "other_end"))
        x, y = (z.join(bad.where(f"{side} is not null").select(F.col(side).alias("u1")), "u1", "left_semi") for z, side in ((x, "x"), (y, "y")))
    x, y = x.select(cols), y.select(F.col("k").alias("k_"), F.col("leaf").alias("leaf_"), *(F.col(c).alias(f"{c}_") for c in ("id", "n_bytes", "n")))
    both = stash(x.join(y, (F.col("k") == F.col("k_")) & (F.col("leaf") == F.col("leaf_")) & (F.col("n_bytes") == F.col("n_bytes_")), "full"), "warc-both")
    same = F.least(F.coalesce("n", F.lit(0)), F.coalesce("n_", F.lit(0)))
    here = both.where(F.coalesce("n", F.lit(0)) > same).select("k", "id", "leaf", "n_bytes", (F.col("n") - same).alias("n"), (F.col("position") + same).alias("position"))
    there = both.where(F.coalesce("n_", F.lit(0)) > same).select(F.col("k_").alias("k"), F.col("id_").alias("id"), F.col("leaf_").alias("leaf"), F.col("n_bytes_").alias("n_bytes"), (F.col("n_") - same).alias("n"))
    lost = _matched(here, "turn").select("k", "turn", (F.col("position") + F.col("i")).alias("p"))
    found = _matched(there, "turn").select("k", "turn", F.col("id").alias("other_id"), F.col("leaf").alias("other"), F.col("n_bytes").alias("other_bytes"))
    changed = stash(lost.join(found, ["k", "turn"], "full").select("p", "other_id", "other", "other_bytes"), "warc-changed")
    every = a.leaves.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select("id", (F.col("position") + F.col("i")).alias("position"), (F.col("byte_offset") + F.col("i") * F.col("n_bytes")).alias("byte_offset"), "n_bytes", F.col("leaf").alias("sha256"))
    state = F.when(F.col("p").isNull(), "intact").when(F.col("other").isNull(), "missing").otherwise("corrupt")
    known = every.join(changed.where("p is not null"), F.col("position") == F.col("p"), "left")
    known = known.select("id", "position", "byte_offset", "n_bytes", "sha256", F.when(F.col("p").isNull(), F.col("sha256")).otherwise(F.col("other")).alias("other_sha256"), state.alias("status"))
    null = lambda kind: F.lit(None).cast(kind)
    extra = changed.where("p is null").select(F.col("other_id").alias("id"), null("long").alias("position"), null("long").alias("byte_offset"), F.col("other_bytes").alias("n_bytes"), null("string").alias("sha256"), F.col("other").alias("other_sha256"), F.lit("extra").alias("status"))
    return Comparison(known.unionByName(extra).withColumnRenamed("id", id_col), ranges, a.root, b.root)


def audit(first: DataFrame, second: DataFrame, id_col: str, record_col: str = "record", fan: int = FAN) -> DataFrame:
    """One row for each record of either replica: id, position, byte_offset, n_bytes, sha256, other_sha256, status.

    status: intact, corrupt (both have a record of the id, hashes differ), missing (only the first has it) or extra
    (only the second; no position, its own n_bytes). Equal records of one id, null ids included, are matched first,
    the others of that id in order of their hashes. A null record counts as empty. Repeated records have a row each. Equal roots end the audit at
    once; two empty replicas give no rows.
    """
    return compare(first, second, id_col, record_col, fan).records


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records against a replica with simulated damage: every 97th id loses its first byte's value, every 89th its record."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    good = pages.select("page_id", record_of(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    html = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("?"), F.substring("html", 2, 2147483647))).otherwise(F.col("html"))
    replica = pages.where(F.coalesce(F.col("page_id") % 89 != 7, F.lit(True))).select("page_id", record_of(F.col("page_id"), F.col("url"), html).alias("record"))
    return audit(good, replica, "page_id").select("page_id", "position", "byte_offset", "n_bytes", "sha256", "other_sha256", "status")


QUERIES = {"op6_warc_fixity": op6_warc_fixity}

_RECORD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce({html}, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce({html}, '') || chr(13) || chr(10) || chr(13) || chr(10)"

SQL = {
    "op6_warc_fixity": f"""
WITH one AS (
  SELECT page_id, {_RECORD.format(html="html")} AS record FROM pages
), two AS (
  SELECT page_id, {_RECORD.format(html="CASE WHEN page_id % 97 = 13 THEN '?' || substring(html, 2) ELSE html END")} AS record FROM pages WHERE page_id % 89 <> 7
), a AS (
  SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS position, sum(strlen(record)) OVER (ORDER BY page_id) - strlen(record) AS byte_offset, strlen(record) AS n_bytes, sha256('\\x00'::BLOB || encode(record)) AS sha256 FROM one
), b AS (
  SELECT page_id, sha256('\\x00'::BLOB || encode(record)) AS other_sha256 FROM two
)
SELECT page_id, position, byte_offset::BIGINT AS byte_offset, n_bytes, sha256, other_sha256, CASE WHEN other_sha256 IS NULL THEN 'missing' WHEN sha256 = other_sha256 THEN 'intact' ELSE 'corrupt' END AS status
FROM a LEFT JOIN b USING (page_id)
"""
}
