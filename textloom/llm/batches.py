"""Texts as byte buffers: blocks of bounded size, and words found and hashed without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Rows handled at once.
BLOCK_ROWS = 1 << 16
#: Words are hashed in pieces of at most about this many bytes, cut at white space.
_SEGMENT = 2 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def as_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; a null has no bytes."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES, most: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut or join batches so that their column holds about `limit` bytes in at most `most` rows, by whole rows.

    Callers give the rows by what a row costs them: short, empty and null texts have next to no bytes.
    """
    kept: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        _, off = as_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(off, off[at] + limit - size, "right")) - 1
            end = min(max(end, at if kept else at + 1), batch.num_rows, at + most - rows)
            if end > at:
                kept.append(batch.slice(at, end - at))
                size += int(off[end] - off[at])
                rows += end - at
            if end < batch.num_rows or rows == most:
                yield _joined(kept)
                kept, size, rows = [], 0, 0
            at = end
    if kept:
        yield _joined(kept)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class Words(NamedTuple):
    start: np.ndarray  # of each word, in the buffer
    end: np.ndarray
    row: np.ndarray  # its row
    hash: np.ndarray  # 64 bits of the lower-cased word

    def first(self, rows: int) -> np.ndarray:
        """The rows' first words: rows + 1 positions."""
        return np.searchsorted(self.row, np.arange(rows + 1))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _TABLES or len(_TABLES["up"]) < n:
        _TABLES["up"], _TABLES["down"] = _powers(n, _M), _powers(n, _M_INVERSE)
    return _TABLES["up"], _TABLES["down"]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans (in order, not overlapping) of a buffer: a polynomial in an odd base, with the length, mixed."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = int(start[at])
        stop = max(int(np.searchsorted(end, base + _SEGMENT, "right")), at + 1)
        piece = buf[base : int(end[stop - 1])]
        s, e = start[at:stop] - base, end[at:stop] - base
        if len(piece) <= 2 * _SEGMENT:
            up, down = _tables(2 * _SEGMENT)
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece.astype(np.uint64) * up[: len(piece)], out=total[1:])
            value = (total[e] - total[s]) * down[s]
        else:  # one long span: the same polynomial, piece by piece
            up, _ = _tables(2 * _SEGMENT)
            value, factor = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            for i in range(0, len(piece), _SEGMENT):
                part = piece[i : i + _SEGMENT]
                value += (part.astype(np.uint64) * up[: len(part)]).sum(dtype=np.uint64, keepdims=True) * factor
                factor = factor * up[_SEGMENT] if len(part) == _SEGMENT else factor
        out[at:stop] = mix(value + (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        at = stop
    return out


def words(buf: np.ndarray, off: np.ndarray) -> Words:
    """The words [^\\x20\\x09-\\x0D]+ of each row, A-Z lower-cased. Found in pieces that end at white space."""
    parts, at = [], 0
    while at < len(buf):
        stop = min(at + _SEGMENT, len(buf))
        while stop < len(buf) and not _SPACE[buf[stop]]:
            look = np.flatnonzero(_SPACE[buf[stop : stop + 65536]])
            stop = stop + int(look[0]) if len(look) else min(stop + 65536, len(buf))
        start, end, hashes = _piece_words(buf[at:stop], off[(off >= at) & (off < stop)] - at)
        parts.append((start + at, end + at, hashes))
        at = stop
    start, end, hashes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Words(start, end, np.searchsorted(off, start, "right") - 1, hashes)


def _piece_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = _LOWER[buf]
    space = _SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    before = np.ones(len(buf), bool)
    before[1:] = space[:-1]
    start = np.flatnonzero(~space & (before | first[:-1]))
    after = np.ones(len(buf), bool)
    after[:-1] = space[1:]
    end = np.flatnonzero(~space & (after | first[1:])) + 1
    return start, end, span_hashes(lower, start, end)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the rows' runs of k words and their rows. A row with fewer words, but some, has its whole sequence as one."""
    h, n = w.hash, len(w.hash)
    if not n:
        return h, w.row
    mixed = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        mixed = mix(mixed * np.uint64(0x9FB21C651E98DF25) + h[i : n - k + 1 + i]) if n >= k else mixed
    same = w.row[: n - k + 1] == w.row[k - 1 :] if n >= k else np.zeros(0, bool)
    found, rows = mixed[same], w.row[: n - k + 1][same] if n >= k else w.row[:0]
    begin = np.flatnonzero(np.r_[True, w.row[1:] != w.row[:-1]])
    length = np.diff(np.r_[begin, n])
    short = np.flatnonzero(length < k)
    if len(short):
        extra = []
        for b, m in zip(begin[short], length[short], strict=True):
            value = np.full(1, m, np.uint64)
            for x in h[b : b + m]:
                value = mix(value * np.uint64(0x9FB21C651E98DF25) + x)
            extra.append(value[0])
        found, rows = np.r_[found, np.array(extra, np.uint64)], np.r_[rows, w.row[begin[short]]]
        order = np.argsort(rows, kind="stable")
        found, rows = found[order], rows[order]
    return found, rows


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value) pairs, ordered by both."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], rows[new]
