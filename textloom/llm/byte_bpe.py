"""Byte-level BPE by a global shuffle of distinct words, and decoding by the table of token bytes.

Texts are split by the GPT-2 pattern (as tiktoken does: \\s is White_Space, \\p{L} and \\p{N} are Unicode's)
into pre-tokens, in arrays: runs of one class of characters, with the rules for spaces and contractions.
Blocks of texts list their distinct pre-tokens (block_dictionary); those meet by hash, each distinct one is
encoded once in its task, the ids return to the blocks and are put together by position. Decoding gathers
the bytes of each id from the token table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.batches import as_buffer, blocks, span_hashes
from textloom.llm.block_dictionary import BLOCK, Local, block_number, bucket_bits, by_frequency, pack, unpack
from textloom.sources.tables import table
from textloom.storage import stash_bucketed

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_PIECE = 1 << 20
#: Words whose ids a task remembers; beyond it, it begins anew.
_KNOWN = 1 << 20
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _CLASSES:
        import regex

        every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "�" for i in range(0x110000))
        out = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = kind
        _CLASSES.append(out)
    return _CLASSES[0]


def _cuts(buf: np.ndarray, off: np.ndarray) -> list[int]:
    """Row bounds and places inside long rows, at which pieces of about _PIECE bytes may end: a space between printable ASCII characters."""
    out, at = [0], 0
    while at < len(buf):
        row_end = int(off[np.searchsorted(off, at + _PIECE, "right") - 1]) if at + _PIECE < len(buf) else len(buf)
        if row_end > at:
            at = row_end
        else:
            row_end = int(off[np.searchsorted(off, at, "right")])
            look, cut = at + _PIECE, row_end
            while look < row_end - 1:
                x = buf[look - 1 : min(look + 65536, row_end)]
                ok = np.flatnonzero((x[1:-1] == 32) & (x[:-2] > 32) & (x[:-2] < 127) & (x[2:] > 32) & (x[2:] < 127))
                if len(ok):
                    cut = look + int(ok[0])
                    break
                look += 65536 - 2
            at = cut
        out.append(at)
    return out


def pretokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pre-tokens of all rows, in order."""
    starts, ends, cuts = [], [], _cuts(buf, off)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        inner = off[(off > a) & (off < b)] - a
        s = _piece_starts(buf[a:b], inner)
        starts.append(s + a)
        ends.append(np.r_[s[1:], b - a] + a)
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _piece_starts(buf: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens; inner: first bytes of the piece's later rows."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    byte = np.flatnonzero((buf & 0xC0) != 0x80)
    n = len(points)
    kind = classes()[points]
    row = np.zeros(n + 1, bool)  # a row begins here, or all ends
    row[[0, n]] = True
    row[np.searchsorted(byte, inner)] = True
    run = row.copy()  # a run of one class begins here
    run[1:n] |= kind[1:] != kind[:-1]
    begins = run[:n].copy()
    after = np.flatnonzero(run[1:n] & ~row[1:n] & (kind[:-1] == _SPACE)) + 1  # first characters after white space
    begins[after - 1] = True
    begins[after[points[after - 1] == 32]] = False
    quote = np.flatnonzero((points == 39) & begins)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~row[quote + 1]]
    x = points[quote + 1]
    y = np.where((quote + 2 < n) & ~row[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
    one = np.isin(x, [ord(c) for c in "stmd"])
    two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
    begins[quote[one | two] + 1] = False
    for stop in (quote[one] + 2, quote[two] + 3):
        stop = stop[stop < n]
        begins[stop[kind[stop] == _LETTER]] = True
    return byte[begins]


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 of the token's bytes, then its rank, on each line. Read once by each process."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def _token_bytes(path: str) -> "TokenBytes":
    return TokenBytes(load_ranks(path))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", digests: bool = False) -> DataFrame:
    """One row for each row of docs: the id and n_tokens, and ids (array of int), or with digests instead ids_sha256 and decoded_sha256.

    A null text counts as empty: no tokens. A null id stays null; repeated rows are encoded each; other
    columns are not read. ranks_path is read by the executors; pattern must be the one described above, and
    is checked against the splitting of a fixed text.
    """
    import regex

    probe = "I'll say: 'tis 12  we've\t\n it's''s done.  x \n\n"
    raw = np.frombuffer(probe.encode(), np.uint8)
    a, b = pretokens(raw, np.array([0, len(raw)]))
    if [probe.encode()[i:j].decode() for i, j in zip(a, b, strict=True)] != regex.findall(pattern, probe):
        raise ValueError("pattern is not the GPT-2 split pattern")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    bits = bucket_bits(spark)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(blocks(batches, "text", BLOCK, 1 << 18)):
            buf, off = as_buffer(batch.column("text"))
            start, end = pretokens(buf, off)
            own = Local(span_hashes(buf, start, end))
            bound, raw = own.bounds(bits), buf.tobytes()
            distinct = [raw[x:y] for x, y in zip(start[own.first].tolist(), end[own.first].tolist(), strict=True)]
            chunks, listed = [], []
            for bucket in np.flatnonzero(np.diff(bound)):
                listed += (order := sorted(range(bound[bucket], bound[bucket + 1]), key=distinct.__getitem__))  # in order, they compress better
                data = b"".join([distinct[i] for i in order])
                chunks.append({"bucket": int(bucket), "lengths": pack(np.array([len(distinct[i]) for i in order], np.uint32)), "data": pack(np.frombuffer(data, np.uint8))})
            counts, local = own.relist(np.array(listed, np.int64))
            lengths = np.searchsorted(start, off)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block_number(k)], pa.int64()), pa.array([batch.column("id").to_pylist()], pa.list_(batch.schema.field("id").type)), pa.array([pack(np.diff(lengths).astype(np.uint32))]), pa.array([pack(counts.astype(np.uint32))]), pa.array([pack(local)]),
                 pa.array([chunks], pa.list_(pa.struct([("bucket", pa.int32()), ("lengths", pa.binary()), ("data", pa.binary())])))],
                ["block", "ids", "lengths", "counts", "local", "chunks"],
            )

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(to_blocks, f"block long, ids array<{kind}>, lengths binary, counts binary, local binary, chunks array<struct<bucket:int,lengths:binary,data:binary>>")
    stored = stash_bucketed(made, "bpe-blocks", "block")

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        for batch in batches:
            if len(known) > _KNOWN:
                known.clear()
            for block, bucket, lengths, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "lengths", "data")), strict=True):
                ends = np.cumsum(unpack(lengths).astype(np.int64)).tolist()
                raw, at, out = unpack(data).tobytes(), 0, []
                for end in ends:
                    word, at = raw[at:end], end
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(one(word), np.uint32).tobytes()
                    out.append(ids)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([pack(np.array([len(x) // 4 for x in out], np.uint32))]), pa.array([pack(np.frombuffer(b"".join(out), np.uint32))])], ["block", "bucket", "n", "ids"])

    words = stored.select("block", F.explode("chunks").alias("c")).select("block", "c.bucket", "c.lengths", "c.data")
    answers = words.repartition("bucket").mapInArrow(encode_words, "block long, bucket int, n binary, ids binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _assemble(left, right, _token_bytes(ranks_path) if digests else None)
        return pa.Table.from_arrays(out, ["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["id", "n_tokens", "ids"])

    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    both = stored.select("block", "ids", "lengths", "counts", "local").groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(assemble, f"id {kind}, n_tokens long, {rest}").withColumnRenamed("id", id_col)


def _assemble(left: pa.Table, right: pa.Table, table_: "TokenBytes | None") -> list[pa.Array]:
    """A block's rows: its id lists put together by position, and with a token table the digests of ids and of decoded bytes."""
    docs = left.column("ids").combine_chunks().flatten()
    counts, local = unpack(left.column("counts")[0].as_py()), unpack(left.column("local")[0].as_py())
    per_row = unpack(left.column("lengths")[0].as_py()).astype(np.int64)
    order = np.argsort(right.column("bucket").to_numpy()) if right.num_rows else []
    ns, ids = right.column("n").to_pylist(), right.column("ids").to_pylist()
    n = np.concatenate([unpack(ns[i]) for i in order]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    flat = np.concatenate([unpack(ids[i]) for i in order]) if len(order) else np.zeros(0, np.uint32)
    begin = np.cumsum(n) - n
    perm = by_frequency(counts)
    n, begin = n[perm], begin[perm]  # by local number
    totals, first, second, at = [], [], [], 0
    row_end = np.cumsum(per_row)
    step = max(1, len(per_row) // max(1, len(local) // (1 << 19)))
    for a in range(0, len(per_row), step):
        b = min(a + step, len(per_row))
        x = local[at : int(row_end[b - 1])]
        at = int(row_end[b - 1])
        length = n[x]
        out = flat[_ranges(begin[x], length)]
        ends = np.r_[0, np.cumsum(length)][row_end[a:b] - (row_end[a] - per_row[a])]
        bounds = np.r_[0, ends]
        totals.append(np.diff(bounds))
        if table_ is None:
            first.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out.astype(np.int32))))
        else:
            raw = out.astype("<u4").tobytes()
            first += [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            data, cut = table_.decode(out, bounds)
            second += [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    total = pa.array(np.concatenate(totals) if totals else np.zeros(0, np.int64), pa.int64())
    if table_ is None:
        return [docs, total, pa.concat_arrays(first) if first else pa.array([], pa.list_(pa.int32()))]
    return [docs, total, pa.array(first, pa.string()), pa.array(second, pa.string())]


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All of begin[i] .. begin[i] + length[i] - 1, one after another."""
    total = int(length.sum())
    out = np.repeat(begin - (np.cumsum(length) - length), length)
    return out + np.arange(total)


class TokenBytes:
    """The token-byte table, joined by position in arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for token, i in ranks.items():
            by_id[i] = token
        self.length = np.array([len(t) for t in by_id], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each row's begin and end."""
        length = self.length[ids]
        cut = np.r_[0, np.cumsum(length)][bounds]
        return self.data[_ranges(self.begin[ids], length)].tobytes(), cut


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with a binary column of the decoded bytes (null for null ids); a column of that name is replaced."""
    rest = encoded.drop(out_col)
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_bytes(ranks_path)
        at = names.index(ids_col)
        for batch in batches:
            out = []
            for ids in batch.column(at).to_pylist():
                out.append(None if ids is None else tokens.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, out_col])

    from pyspark.sql import types as T

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out_col, T.BinaryType())]))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the bytes decoded from them. A null text counts as empty; repeated rows each have a row."""
    import public_tokenizers as P

    return encode(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, digests=True)


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
