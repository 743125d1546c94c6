"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Each row gives its set's size, a 128-bit fingerprint of the set, `MINIMA` minima of which the low `2`
   bits are kept, packed in bit planes, and a key for each band of `ROWS` minima.
2. Equal sets form classes by fingerprint; from here only each class's least id (its representative) goes on,
   so that copies, however many, cost one row.
3. Representatives meet by band key. Of each band bucket only links to its least member are tried: the
   packed bits' matches give an estimate of the similarity, corrected for chance collisions of two bits, and
   pairs that reach the threshold less five standard errors, even if no bits match by chance, are confirmed on
   the full sets, as are all pairs with a set of under `SMALL` shingles.
4. Links are gathered into components. A bucket whose members do not all lie in one component may hide more
   links: for up to `STARS` rounds another member, drawn by hash, is tried with those of other components.
5. What is left is compared in tiles: every pair of a bucket that still lies in two components, in the first
   bucket that it shares, by the packed bits of `FINE` minima and, where their estimate passes or a set is small, on the
   full sets. Tiles are bounded by rows and by the bytes of their sets. Only links leave a tile, so no pair that shares a band key and could join two components is left
   untried, and no list of pairs is made.

A pair at the threshold of 0.8 shares no band key with probability (1 - 0.8 ** 4) ** 28 = 4e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.batches import as_buffer, blocks, distinct_by_row, mix, shingles, words
from textloom.llm.components import components
from textloom.llm.skew import hot_keys, join_dealt
from textloom.sources.tables import table
from textloom.storage import stash

MINIMA, BANDS, ROWS, BITS = 128, 28, 4, 2
_TILE = 1024
#: Bytes of full sets that one side of a tile has, but for a set that is larger by itself.
_TILE_BYTES = 16 << 20
#: Pairs of one document that go to one task.
_PAIRS = 256
#: Rounds in which buckets of several components try one member more.
STARS = 4
#: Ids of candidates are broadcast to the scan of the texts up to this many, and shuffled beyond.
BROADCAST_IDS = 1 << 21
#: Minima of the longer signatures that members of buckets with several components are compared by.
FINE = 1024
#: Sets of fewer shingles are compared whole: their minima are too few different numbers for an estimate.
SMALL = 64
_ODD = (np.random.default_rng(20).integers(0, 1 << 32, FINE, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_ADD = np.random.default_rng(21).integers(0, 1 << 32, FINE, dtype=np.uint32)


def row_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' distinct shingle hashes in order, and where each row's begin: rows + 1 places."""
    buf, off = as_buffer(column)
    values, rows = distinct_by_row(*shingles(words(buf, off), k))
    return values, np.searchsorted(rows, np.arange(len(off)))


def minima(values: np.ndarray, at: np.ndarray, number: int = MINIMA) -> np.ndarray:
    """Rows x number least values of the sets, all rows with some shingle."""
    out = np.empty((len(at) - 1, number), np.uint32)
    low = (values >> np.uint64(16)).astype(np.uint32)
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + (1 << 15), "right")) - 1)
        part, cut = low[at[a] : at[b]], (at[a:b] - at[a]).astype(np.int64)
        for i in range(number):
            out[a:b, i] = np.minimum.reduceat(part * _ODD[i] + _ADD[i], cut)
        a = b
    return out


def planes(least: np.ndarray) -> np.ndarray:
    """Rows x (BITS * minima / 64) words: bit planes of the minima's low bits."""
    bits = np.concatenate([(least >> np.uint32(b)) & np.uint32(1) for b in range(BITS)], 1).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    """Rows x BANDS 64-bit keys."""
    out = np.empty((len(least), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(least), b, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + least[:, b * ROWS + r].astype(np.uint64))
        out[:, b] = key
    return out.view(np.int64)


_WORDS = MINIMA // 64


def estimate(left: list[Column], right: list[Column]) -> Column:
    """Similarity from packed bits: matches less what chance alone gives."""
    differ = F.lit(0)
    for w in range(_WORDS):
        some = left[w].bitwiseXOR(right[w])
        for b in range(1, BITS):
            some = some.bitwiseOR(left[b * _WORDS + w].bitwiseXOR(right[b * _WORDS + w]))
        differ += F.bit_count(some)
    chance = 0.5**BITS
    return ((MINIMA - differ) / MINIMA - chance) / (1 - chance)


def least_estimate(similarity: float, number: int = MINIMA, errors: float = 5.0) -> float:
    """The estimate that a pair of that similarity falls below once in some millions, however few bits match by chance."""
    chance = 0.5**BITS
    return (similarity - errors * math.sqrt(similarity * (1 - similarity) / number) - chance) / (1 - chance)


def signatures(docs: DataFrame, k: int, text_col: str, id_col: str) -> DataFrame:
    """(id, n_shingles, f0, f1, s0 .. , bands) of each row; null f0 and bands for rows without a shingle or an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 2 << 20, 1 << 14):
            values, at = row_sets(batch.column("text"), k)
            n = np.diff(at)
            some = np.flatnonzero(n > 0)
            first = np.zeros((2, len(n)), np.uint64)
            packed, keys = np.zeros((len(n), BITS * _WORDS), np.int64), [None] * len(n)
            if len(some):
                cut = at[some]
                first[0, some] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5F00DF00D)), cut)
                first[1, some] = np.add.reduceat(mix(values * np.uint64(0xD1342543DE82EF95) + np.uint64(7)), cut)
                least = minima(values, np.r_[cut, at[-1]])
                packed[some] = planes(least)
                for i, row in zip(some.tolist(), band_keys(least), strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64), mask=n == 0) for x in first), *(pa.array(np.ascontiguousarray(c)) for c in packed.T), pa.array(keys, pa.list_(pa.int64()))], names)

    names = ["id", "n_shingles", "f0", "f1", *(f"s{i}" for i in range(BITS * _WORDS)), "bands"]
    kinds = ", ".join(["id long", "n_shingles long", "f0 long", "f1 long", *(f"s{i} long" for i in range(BITS * _WORDS)), "bands array<long>"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two ordered sets share."""
    if not len(x):
        return 0
    return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())


def fine_signatures(docs: DataFrame, ids: DataFrame, k: int, text_col: str, id_col: str) -> DataFrame:
    """(id, fine, shingles, bands): packed bits of FINE minima, the full set and the band keys, for the rows with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20, 1 << 11):
            values, at = row_sets(batch.column("text"), k)
            some = np.flatnonzero(np.diff(at) > 0)
            if len(some):
                least = minima(values, np.r_[at[some], at[-1]], FINE)
                packed, keys = planes(least), band_keys(least)
                full = [values[at[i] : at[i + 1]].tobytes() for i in some.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(some)), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(full, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["id", "fine", "shingles", "bands"])

    return _texts(docs, ids, text_col, id_col).mapInArrow(run, "id long, fine binary, shingles binary, bands array<long>")


def _texts(docs: DataFrame, ids: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, text) of the rows with these ids."""
    hint = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(hint, "id", "left_semi")


def confirm(docs: DataFrame, pairs: DataFrame, k: int, percent: int, text_col: str, id_col: str) -> DataFrame:
    """Of pairs (a, b) those whose full sets have 100 * intersection >= percent * union, with both sizes."""
    ids = stash(pairs.select(F.col("a").alias("id")).distinct().union(pairs.select("b").distinct()).distinct(), "near-ids")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 2 << 20):
            values, at = row_sets(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([values[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "shingles"])

    sets = stash(_texts(docs, ids, text_col, id_col).mapInArrow(to_sets, "id long, shingles binary"), "near-sets", "none")
    both = join_dealt(pairs.select("a", "b"), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b", "a", most=_PAIRS)
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), "a", most=_PAIRS)
    both = join_dealt(both, sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a", "b", hot)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, union = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                n = shared(x, y)
                common.append(n)
                union.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "common", "total"])

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, common long, total long").where(F.col("common") * 100 >= F.col("total") * percent)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the least id that can be reached), kept (id = component_id).

    Documents are linked where 100 * intersection >= percent * union of their sets of k-word shingles; one with
    fewer words has its whole sequence as its only shingle. A null, empty or blank text has an empty set and is
    linked with nothing, as is a row with a null id, whose component is null and which is kept. Repeated rows
    have the same answer; rows of one id with different texts count as one document. Other columns are not read.
    """
    sign = [f"s{i}" for i in range(BITS * _WORDS)]
    all_rows = stash(signatures(docs, k, text_col, id_col), "near-signatures")
    usable = F.col("id").isNotNull() & F.col("f0").isNotNull()
    classes = stash(all_rows.where(usable).groupBy("f0", "f1", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "near-classes")
    named = all_rows.select("id", "n_shingles", "f0", "f1").join(classes.where("n > 1").drop("n"), ["f0", "f1", "n_shingles"], "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    reps = all_rows.where(usable).join(classes.select("f0", "f1", "n_shingles", F.col("rep").alias("id")), ["f0", "f1", "n_shingles", "id"], "left_semi").dropDuplicates(["id", "f0", "f1"])
    reps = stash(reps.select("id", *sign, "n_shingles", "bands"), "near-representatives")
    entries = reps.select("id", "n_shingles", F.explode("bands").alias("band"))
    buckets = stash(entries.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1"), "near-bands")
    hot = stash(hot_keys(buckets, "band"), "near-hot")
    members = stash(join_dealt(entries, buckets, "band", "id", hot), "near-buckets")
    tried = stash(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "near-tried")
    bits = reps.select("id", *sign, "n_shingles")

    def likely(pairs: DataFrame) -> DataFrame:
        left, right = ([F.col(f"{side}{i}") for i in range(len(sign))] for side in "xy")
        one = bits.toDF("b", *(f"y{i}" for i in range(len(sign))), "yn")
        two = bits.toDF("a", *(f"x{i}" for i in range(len(sign))), "xn")
        dealt = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), "a")
        return join_dealt(join_dealt(pairs, one, "b", "a"), two, "a", "b", dealt).where((F.least("xn", "yn") < SMALL) | (estimate(left, right) >= least_estimate(percent / 100))).select("a", "b")

    links = stash(confirm(docs, stash(likely(tried), "near-likely"), k, percent, text_col, id_col), "near-links")
    found = components(links)
    wide = stash(members.where("n > 2"), "near-wide")
    place = lambda: wide.join(found, wide["id"] == found["node"], "left").select("band", "id", "n", "n_shingles", F.coalesce("component", "id").alias("component"))
    for turn in range(STARS):  # buckets that still touch several components: another member is tried with those of other components
        placed = place()
        heads = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(F.struct("id", "component"), F.xxhash64("id", "band", F.lit(turn))).alias("head"))
        heads = heads.where("low <> high").select("band", F.col("head.id").alias("h"), F.col("head.component").alias("hc"))
        fresh = join_dealt(placed, heads, "band", "id", hot).where("component <> hc").select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b")).distinct()
        fresh = stash(fresh.join(tried, ["a", "b"], "left_anti"), "near-tried")
        tried = tried.unionByName(fresh)
        more = stash(confirm(docs, stash(likely(fresh), "near-likely"), k, percent, text_col, id_col), "near-links")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        found = components(links)
    placed = place()
    split = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n_shingles").alias("weight")).where("low <> high").select("band", "weight")
    rest = stash(join_dealt(placed, split, "band", "id", hot), "near-rest")
    fine = stash(fine_signatures(docs, stash(rest.select("id").distinct(), "near-ids"), k, text_col, id_col), "near-fine")
    tiles = F.ceil(F.greatest(F.col("n") / _TILE, F.col("weight") * 8 / _TILE_BYTES)).cast("int")
    tile = F.pmod(F.xxhash64("id"), tiles).cast("int")
    whole = rest.join(fine, "id")
    dealt = whole.select("band", "id", "component", "bands", "fine", "shingles", tile.alias("t"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("u"))
    dealt = dealt.select("band", F.least("t", "u").alias("p"), F.greatest("t", "u").alias("q"), "t", "id", "component", "bands", "fine", "shingles")
    least = least_estimate(percent / 100, FINE)

    def compare(rows: pa.Table) -> pa.Table:
        ids, parts, t = (rows.column(c).to_numpy() for c in ("id", "component", "t"))
        x = np.frombuffer(b"".join(rows.column("fine").to_pylist()), np.uint64).reshape(len(ids), BITS, -1)
        full = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column("shingles")]
        size = np.array([len(v) for v in full])
        keys = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        p, q, band = (rows.column(c)[0].as_py() for c in ("p", "q", "band"))
        right = np.flatnonzero(t == q)
        a, b = [], []
        for i in np.flatnonzero(t == p):
            other = right[(parts[right] != parts[i]) & ((ids[right] > ids[i]) | (p != q))]
            same = FINE - np.bitwise_count(np.bitwise_or.reduce(x[other] ^ x[i], axis=1)).sum(1, dtype=np.int64)
            low, high = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
            hit = other[(100 * low >= percent * high) & ((low < SMALL) | ((same / FINE - 0.5**BITS) / (1 - 0.5**BITS) >= least))]
            hit = hit[keys[i][(keys[hit] == keys[i]).argmax(1)] == band]  # in the first bucket that both share
            for j in hit.tolist():
                n = shared(full[i], full[j])
                if 100 * n >= percent * (len(full[i]) + len(full[j]) - n):
                    a.append(min(int(ids[i]), int(ids[j])))
                    b.append(max(int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    more = stash(dealt.groupBy("band", "p", "q").applyInArrow(compare, "a long, b long"), "near-links")
    if not more.isEmpty():
        found = components(links.select("a", "b").unionByName(more))
    out = named.join(found, named["rep"] == found["node"], "left").select("id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document, on two-word shingles. Empty and null texts stand alone; repeated rows have the same answer."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


QUERIES = {"op5_near_dedup": op5_near_dedup}
