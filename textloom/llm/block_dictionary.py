"""Texts as blocks with dictionaries of their own: what a global shuffle of distinct words moves.

Exploding every token of a corpus and shuffling it by word would move many times the corpus. Here whole
rows are gathered into blocks of about `BLOCK` bytes. A block keeps, for every position, the local number of
its token, and lists each distinct token once; only these lists are shuffled. A token's bucket is given by
the top bits of its hash, so a block's list, in order of hashes, falls into one chunk for each bucket. A
bucket's chunks from all blocks meet in one task; each is answered in the same order, and the answers
return to their block, where they are looked up by local number. A word that stands in every text has one
entry for each block, so no key is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession

BLOCK = 16 << 20


def pack(x: np.ndarray) -> bytes:
    """A number array as compressed bytes: its kind, its length, then zstd of its bytes, dealt by significance."""
    x, zstd = np.ascontiguousarray(x), pa.Codec("zstd", compression_level=3)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return x.dtype.str[1:].encode().ljust(4) + len(x).to_bytes(8, "little") + (zstd.compress(planes, asbytes=True) if planes else b"")


def unpack(data: bytes) -> np.ndarray:
    kind, n = np.dtype("<" + data[:4].decode().strip()), int.from_bytes(data[4:12], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[12:], n * kind.itemsize, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n)


def bucket_bits(spark: SparkSession) -> int:
    """Enough buckets that each shuffle partition gets a few."""
    return max(6, (4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")) - 1).bit_length())


def block_number(k: int) -> int:
    """A number that no other block has: the task's partition and k, the block's place in it."""
    context = TaskContext.get()
    return ((context.partitionId() if context else 0) << 32) | k


class Local:
    """A block's distinct hashes in order, and the local numbers of its tokens, the most frequent lowest."""

    def __init__(self, hashes: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        new = np.ones(len(hashes), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        at = np.flatnonzero(new)
        self.hashes = ordered[at]
        self.first = order[at]  # the token at which each stands first
        self.counts = np.diff(np.r_[at, len(hashes)])
        rank = np.empty(len(at), np.uint32)
        rank[by_frequency(self.counts)] = np.arange(len(at), dtype=np.uint32)
        self.local = np.empty(len(hashes), np.uint32)
        self.local[order] = np.repeat(rank, self.counts)

    def relist(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and local numbers if the distinct hashes were listed in this order."""
        rank = np.empty(len(order), np.uint32)
        rank[order[by_frequency(self.counts[order])]] = np.arange(len(order), dtype=np.uint32)
        return self.counts[order], rank[by_frequency(self.counts)][self.local]

    def bounds(self, bits: int) -> np.ndarray:
        """Where each bucket's chunk begins: 2 ** bits + 1 places."""
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.r_[np.searchsorted(self.hashes, edges), len(self.hashes)]


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """The places of the distinct hashes, the most frequent first; the same whenever the counts are."""
    return np.argsort(-counts.astype(np.int64), kind="stable")
