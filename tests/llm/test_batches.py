import random

import numpy as np
import pyarrow as pa

from textloom.llm import batches as B
from textloom.llm.block_dictionary import Local, by_frequency, pack, unpack


def texts():
    r = random.Random(1)
    return ["", None, " a\x0bB c", "x", "\n\t ", "É é\x85z", "q" * 50] + ["".join(r.choices("ab Z\n\tü0", k=r.randint(0, 80))) for _ in range(200)]


def test_words_in_any_pieces(monkeypatch):
    for segment in (2 << 20, 64, 7):
        monkeypatch.setattr(B, "_SEGMENT", segment)
        B._TABLES.clear()
        buf, off = B.as_buffer(pa.array(texts()))
        w, raw, seen = B.words(buf, off), buf.tobytes(), {}
        want = [(i, x) for i, t in enumerate(texts()) for x in (t or "").encode().lower().split()]
        assert [(int(r), raw[a:b].lower()) for a, b, r in zip(w.start, w.end, w.row, strict=True)] == want
        for (_, x), h in zip(want, w.hash, strict=True):
            assert seen.setdefault(x, int(h)) == int(h)
        assert len(set(seen.values())) == len(seen)
    B._TABLES.clear()


def test_shingles_and_distinct():
    buf, off = B.as_buffer(pa.array(["a b c a b", "", "a", "a b"]))
    values, rows = B.shingles(B.words(buf, off), 2)
    assert rows.tolist() == [0, 0, 0, 0, 2, 3] and values[0] == values[3] == values[5] and len(set(values.tolist())) == 4
    v, r = B.distinct_by_row(values, rows)
    assert r.tolist() == [0, 0, 0, 2, 3]


def test_blocks_are_whole_rows():
    rows = ["x" * n for n in (5, 3, 0, 50, 1, 9, 9, 9)]
    parts = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 3])], ["t"]) for i in range(0, 8, 3)]
    got = [b.column(0).to_pylist() for b in B.blocks(iter(parts), "t", 20)]
    assert sum(got, []) == rows and all(sum(map(len, g)) <= 20 or len(g) == 1 for g in got)
    assert list(B.blocks(iter([]), "t")) == []


def test_pack_and_local_numbers():
    rng = np.random.default_rng(3)
    for x in (np.array([], np.uint32), rng.integers(0, 9, 50).astype(np.int64), rng.random(7)):
        assert (unpack(pack(x)) == x).all() and unpack(pack(x)).dtype == x.dtype
    h = rng.choice(rng.integers(0, 2**63, 30).astype(np.uint64), 500)
    own = Local(h)
    assert (own.hashes[by_frequency(own.counts)][own.local] == h).all() and (h[own.first] == own.hashes).all()
    order = rng.permutation(len(own.hashes))
    counts, local = own.relist(order)
    assert (own.hashes[order][by_frequency(counts)][local] == h).all()
    assert own.bounds(4)[0] == 0 and own.bounds(4)[-1] == len(own.hashes)
