"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference-count tables.

A line's key is a 128-bit digest of the line without white space at its ends, A-Z lower-cased. The index
holds `pairs` (key, document), the exact reference counts `refs` (key, n_docs, max_doc), and for each shard
of the keys a cuckoo filter of the keys that are frequent now. Inserting documents raises counts, deleting
them lowers counts; keys that cross the threshold go into or out of their shard's filter, so that a document
that left no longer costs another its lines. A filter that gets too full is built anew from the exact table.

Dedup probes the filters first, so that only pairs with (almost surely) frequent keys reach the exact table,
which then decides. The filters are broadcast while they hold at most `filter_bytes`; beyond that each shard's
pairs are dealt to several tasks, which read the shard's filter before them. Keys of very many documents are dealt
to several tasks too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.cuckoo import CuckooFilter
from textloom.llm.skew import hot_keys, join_dealt
from textloom.sources.tables import table
from textloom.storage import stash

_ENDS = " \t\n\x0b\x0c\r"
#: Tasks that a shard's pairs are dealt to where the filters are not broadcast.
_SLICES = 8


def line_key(line: str, min_chars: int) -> bytes | None:
    """The digest of a line's key; None for keys of fewer than min_chars code points."""
    import xxhash

    if len(line) < min_chars:
        return None
    key = line.strip(_ENDS)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)[:, 0]


class LineIndex:
    """Counts of documents by line key, for lines of at least min_chars; keys in at least min_docs documents are frequent."""

    def __init__(self, spark: SparkSession, min_docs: int = 5, min_chars: int = 40, shards: int | None = None, filter_bytes: int = 64 << 20):
        self.spark, self.min_docs, self.min_chars, self.filter_bytes = spark, min_docs, min_chars, filter_bytes
        self.shards = shards or max(64, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
        self.pairs = spark.createDataFrame([], "key binary, doc long")
        self.refs = spark.createDataFrame([], "key binary, n_docs long, max_doc long")
        self.filters = spark.createDataFrame([], "shard int, filter binary")
        self._empty = True

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def keys_of(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """(key, doc) of every row's lines, once for each row; rows with a null id have none."""
        least = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, n = [], []
                for text in batch.column("text").to_pylist():
                    own = {k for line in (text or "").split("\n") if (k := line_key(line, least)) is not None}
                    keys += own
                    n.append(len(own))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.repeat(batch.column("doc").to_numpy(zero_copy_only=False), n), pa.int64())], ["key", "doc"])

        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        return rows.mapInArrow(run, "key binary, doc long")

    def insert(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> "LineIndex":
        """Add documents. A document that is there already gains the keys it did not have."""
        fresh = self.keys_of(docs, text_col, id_col)
        if self._empty:
            self.pairs = stash(fresh, "line-pairs")
            counted = self.pairs.groupBy("key").agg(F.countDistinct("doc").alias("n_docs"), F.max("doc").alias("max_doc"))
            self.refs, self._empty = stash(counted, "line-refs"), False
            self._build(self.refs)
            return self
        added = stash(fresh.distinct().join(self.pairs, ["key", "doc"], "left_anti"), "line-added")
        delta = added.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc"))
        refs = self.refs.unionByName(delta).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        self._advance(stash(self.pairs.distinct().unionByName(added), "line-pairs"), stash(refs, "line-refs"))
        return self

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> "LineIndex":
        """Take documents out; ids that are not there change nothing."""
        gone = ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc")).distinct()
        pairs = stash(self.pairs.distinct().join(gone, "doc", "left_anti").select("key", "doc"), "line-pairs")
        touched = self.pairs.join(gone, "doc", "left_semi").select("key").distinct()
        counted = pairs.join(touched, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc"))
        self._advance(pairs, stash(self.refs.join(touched, "key", "left_anti").unionByName(counted), "line-refs"))
        return self

    def frequent(self, refs: DataFrame | None = None) -> DataFrame:
        return (self.refs if refs is None else refs).where(F.col("n_docs") >= self.min_docs)

    def _build(self, refs: DataFrame, shards: DataFrame | None = None) -> None:
        """Filters of the frequent keys, of all shards or of those given."""

        def run(rows: pa.Table) -> pa.Table:
            hashes, capacity = _hashes(rows.column("key").to_pylist()), rows.num_rows
            made = CuckooFilter(capacity)
            while not made.insert(hashes):
                capacity *= 2
                made = CuckooFilter(capacity)
            return pa.table({"shard": rows.column("shard")[:1], "filter": pa.array([made.to_bytes()], pa.binary())})

        keys = self.frequent(refs).select("key", self._shard().alias("shard"))
        if shards is not None:
            keys = keys.join(shards, "shard", "left_semi")
        built = keys.groupBy("shard").applyInArrow(run, "shard int, filter binary")
        self.filters = stash(built if shards is None else self.filters.join(shards, "shard", "left_anti").unionByName(built), "line-filters")

    def _advance(self, pairs: DataFrame, refs: DataFrame) -> None:
        """Move to new tables; filters take in and let go the keys that crossed the threshold."""
        old, new = self.frequent().select("key", F.lit(1).alias("was")), self.frequent(refs).select("key", F.lit(1).alias("now"))
        moved = old.join(new, "key", "full").where(F.col("was").isNull() | F.col("now").isNull()).select("key", self._shard().alias("shard"), F.col("now").isNotNull().alias("comes"))

        def run(filters: pa.Table, changes: pa.Table) -> pa.Table:
            shard = (filters if filters.num_rows else changes).column("shard")[:1]
            data = filters.column("filter")[0].as_py() if filters.num_rows else None
            if changes.num_rows and data is not None:
                own = CuckooFilter.from_bytes(data)
                comes = changes.column("comes").to_numpy().astype(bool)
                hashes = _hashes(changes.column("key").to_pylist())
                own.delete(hashes[~comes])
                data = own.to_bytes() if (own.table > 0).sum() + comes.sum() <= 0.95 * own.table.size and own.insert(hashes[comes]) else None
            return pa.table({"shard": shard, "filter": pa.array([data], pa.binary())})

        after = stash(self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(run, "shard int, filter binary"), "line-filters")
        self.pairs, self.refs, self.filters = pairs, refs, after
        full = after.where(F.col("filter").isNull()).select("shard")
        if not full.isEmpty():
            self._build(refs, full)

    def _probed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose key may be frequent."""
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size > self.filter_bytes:
            return self._probed_by_shard(pairs)
        shared = self.spark.sparkContext.broadcast([(r.shard, bytes(r.filter)) for r in self.filters.collect()])  # at most filter_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {shard: CuckooFilter.from_bytes(data) for shard, data in shared.value}
            for batch in batches:
                shards, keep = batch.column("shard").to_numpy(), np.zeros(batch.num_rows, bool)
                hashes = _hashes(batch.column("key").to_pylist()) if batch.num_rows else np.zeros(0, np.uint64)
                order = np.argsort(shards, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1):
                    if len(at) and shards[at[0]] in filters:
                        keep[at] = filters[shards[at[0]]].contains(hashes[at])
                yield batch.select(["key", "doc"]).filter(pa.array(keep))

        return pairs.select("key", "doc", self._shard().alias("shard")).mapInArrow(run, "key binary, doc long")

    def _probed_by_shard(self, pairs: DataFrame) -> DataFrame:
        """As _probed, with one shard's filter at a time in a task. A shard's pairs are dealt to _SLICES tasks by document."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, own = None, None
            for batch in batches:
                shards, given = batch.column("shard").to_numpy(), batch.column("filter").is_valid().to_numpy(zero_copy_only=False)
                cut = np.flatnonzero(given | (np.r_[-1 if now is None else now, shards[:-1]] != shards))
                for a, b in zip(np.r_[0, cut], np.r_[cut, len(shards)], strict=True):
                    if a == b:
                        continue
                    if shards[a] != now or given[a]:
                        now, own = shards[a], None
                    if given[a]:
                        own, a = CuckooFilter.from_bytes(batch.column("filter")[int(a)].as_py()), a + 1
                    if own is not None and b > a:
                        part = batch.slice(int(a), int(b - a)).select(["key", "doc"])
                        yield part.filter(pa.array(own.contains(_hashes(part.column("key").to_pylist()))))

        asked = pairs.select(self._shard().alias("shard"), F.pmod(F.xxhash64("doc"), F.lit(_SLICES)).cast("int").alias("slice"), F.lit(None).cast("binary").alias("filter"), "key", "doc")
        first = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(_SLICES - 1))).alias("slice"), "filter", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc"))
        return asked.unionByName(first).repartition("shard", "slice").sortWithinPartitions("shard", "slice", F.col("filter").isNull()).mapInArrow(run, "key binary, doc long")

    def dropped(self, pairs: DataFrame | None = None) -> DataFrame:
        """(doc, keys): the keys whose lines each document loses, those frequent ones that a larger document holds."""
        probed = self._probed(self.pairs if pairs is None else pairs)
        hot = hot_keys(self.frequent(), "key", "n_docs")
        hit = join_dealt(probed, self.frequent().select("key", "max_doc"), "key", "doc", hot).where(F.col("doc") != F.col("max_doc"))
        return hit.groupBy("doc").agg(F.collect_set("key").alias("keys"))

    def apply(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", of_index: bool = False) -> DataFrame:
        """docs without the lines they lose, with n_lines (before) and n_dropped; every row and column stays.

        A null text has one empty line and stays null if nothing is dropped. Rows with a null id lose nothing.
        Columns named n_lines and n_dropped are replaced. of_index: the index holds exactly these documents.
        """
        least = self.min_chars
        rest = docs.drop("n_lines", "n_dropped")
        lost = self.dropped(None if of_index else self.keys_of(docs, text_col, id_col).distinct())
        names = [f"_{i}" for i in range(len(rest.columns))]
        at, plain = rest.columns.index(text_col), rest.toDF(*names)
        id_name = names[rest.columns.index(id_col)]
        joined = plain.join(lost, plain[id_name].cast("long") == lost["doc"], "left").drop("doc")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, n, cut = batch.column(at).to_pylist(), [], []
                for i, keys in enumerate(batch.column(len(names)).to_pylist()):
                    lines = (texts[i] or "").split("\n")
                    kept = lines
                    if keys:
                        gone = set(keys)
                        kept = [x for x in lines if line_key(x, least) not in gone]
                        texts[i] = "\n".join(kept)
                    n.append(len(lines))
                    cut.append(len(lines) - len(kept))
                columns = list(batch.columns[: len(names)])
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(cut, pa.int64())], [*names, "n_lines", "n_dropped"])

        schema = T.StructType([*plain.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        return joined.mapInArrow(run, schema).toDF(*rest.columns, "n_lines", "n_dropped")


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """docs deduplicated against themselves; see LineIndex.apply. An empty table gives an empty one."""
    index = LineIndex(docs.sparkSession, min_docs, min_chars).insert(docs, text_col, id_col)
    return index.apply(docs, text_col, id_col, of_index=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that repeat in five or more. A null text has one empty line; of repeated ids every row loses the same lines."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}

SQL = {
    "op3_line_dedup": r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
}
