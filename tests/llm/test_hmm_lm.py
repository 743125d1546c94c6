import math
import random
import zlib
from collections import Counter

import numpy as np

from textloom.llm import hmm_lm
from textloom.llm.splits import fold


def brute_forward(model, cls):
    p = model.start * model.emit[cls[0]]
    for c in cls[1:]:
        p = (p @ model.move) * model.emit[c]
    return math.log(p.sum())


def small_model(states=3, classes=6, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm_lm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def test_forward_is_exact():
    model, rng = small_model(), np.random.default_rng(1)
    length = np.array([1, 7, 3, 12, 1])
    cls = rng.integers(0, 6, length.sum())
    want = [brute_forward(model, x) for x in np.split(cls, np.cumsum(length)[:-1])]
    assert np.allclose(hmm_lm.forward(model, cls, length), want)
    # all sequences of two have probability 1 together
    pairs = np.array([(a, b) for a in range(6) for b in range(6)])
    assert math.isclose(np.exp(hmm_lm.forward(model, pairs.ravel(), np.full(36, 2))).sum(), 1)


def test_counts_equal_enumeration():
    model, cls = small_model(2, 4), np.array([0, 3, 1, 2])
    starts, moves, emit, ll = hmm_lm.expected(model, cls, np.array([4]))
    total, s0, m0, e0 = 0, np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for n in range(16):
        z = [(n >> i) & 1 for i in range(4)]
        p = model.start[z[0]] * np.prod([model.move[a, b] for a, b in zip(z, z[1:])]) * np.prod([model.emit[c, k] for c, k in zip(cls, z)])
        total += p
        s0[z[0]] += p
        for a, b in zip(z, z[1:]):
            m0[a, b] += p
        for c, k in zip(cls, z):
            e0[c, k] += p
    for got, want in ((starts, s0), (moves, m0), (emit, e0)):
        assert np.allclose(got, want / total, atol=1e-5)
    assert math.isclose(ll, math.log(total), rel_tol=1e-5)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(3)
    cls = np.concatenate([rng.integers(0, 40, 50) + 100 * (i % 2) for i in range(40)])
    n = np.full(40, 50)
    at = lambda r: hmm_lm.expected(hmm_lm.local_model(cls, n, 3, r), cls, n)[3]
    assert at(1) < at(4) <= at(12) + 1e-3


def test_base_counts_and_gain(spark):
    r = random.Random(4)
    langs = [[f"{c}{i}" for i in range(30)] for c in "ab"]
    rows = [(i, " ".join(r.choices(langs[i % 2], k=40)) + r.choice(["", "\n", "\tZ\x0bÉ"]), "x") for i in range(300)]
    rows += [(None, "A1 b2", "y"), (900, None, None), (901, "", "q"), (901, "", "q"), (902, "a1 " * 3000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    got = hmm_lm.score(df, fold("doc_id", 7) == 2, states=4).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    count = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t, _ in rows)
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 4)) for x in got) == want
    out = [x for x in got if x.held_out and x.n_tokens > 10]
    assert out and sum(x.score for x in out) > sum(x.base_score for x in out)


def test_empty_and_all_held_out(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert hmm_lm.score(df.limit(0), fold("doc_id", 7) == 2).count() == 0
    row = hmm_lm.score(df, fold("doc_id", 1) == 0).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0)


def test_states_part_whatever_the_first_block_holds(spark):
    r = random.Random(6)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    say = lambda i: " ".join(r.choices([f"{'ab'[i % 2]}{j}" for j in range(30)], k=40))
    rows = [(i, say(i)) for i in range(400)]
    for first in (lambda i: held(i), lambda i: i % 2 == 0):  # rows that are not learned from, one language alone
        parts = [spark.createDataFrame([x for x in rows if first(x[0]) == side], "doc_id long, text string").coalesce(1) for side in (True, False)]
        df = parts[0].union(parts[1])
        at = lambda n: sum(x.score for x in hmm_lm.score(df, fold("doc_id", 7) == 2, states=n).collect() if x.held_out)  # noqa: B023, E731
        tokens = 41 * sum(held(i) for i in range(400))
        assert at(4) - at(1) > 0.2 * tokens


def plain_counts(model, cls):
    """Forward and backward over one sequence, step by step."""
    n, k = len(cls), len(model.start)
    e = model.emit[cls]
    a, b, c = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        a[t] = (a[t - 1] @ model.move if t else model.start) * e[t]
        c[t] = a[t].sum()
        a[t] /= c[t]
    for t in range(n - 2, -1, -1):
        b[t] = model.move @ (e[t + 1] * b[t + 1]) / c[t + 1]
    g = a * b
    moves = sum((np.outer(a[t], e[t + 1] * b[t + 1]) * model.move / c[t + 1] for t in range(n - 1)), np.zeros((k, k)))
    emit = np.zeros(model.emit.shape)
    np.add.at(emit, cls, g)
    return g[0], moves, emit, np.log(c).sum()


def test_counts_of_long_texts_are_those_of_the_whole(monkeypatch):
    model, rng = small_model(3, 6, seed=2), np.random.default_rng(8)
    length = np.array([1, 23, 8, 7, 60, 2, 16, 17])
    cls = rng.integers(0, 6, length.sum())
    want = [sum(x) for x in zip(*(plain_counts(model, x) for x in np.split(cls, np.cumsum(length)[:-1])), strict=True)]
    for segment, lanes in ((1024, 1 << 19), (8, 1 << 19), (8, 20), (2, 5), (7, 9)):
        monkeypatch.setattr(hmm_lm, "SEGMENT", segment)
        monkeypatch.setattr(hmm_lm, "_LANES", lanes)
        got = hmm_lm.expected(model, cls, length)
        for x, y in zip(got, want, strict=True):
            assert np.allclose(x, y, atol=2e-4, rtol=1e-5), segment


def test_layout_and_merging_change_nothing(spark, monkeypatch):
    r = random.Random(2)
    df = spark.createDataFrame([(i, " ".join(r.choices([f"{'ab'[i % 2]}{j}" for j in range(30)], k=40 if i % 9 else 3000))) for i in range(120)], "doc_id long, text string")
    a, b = ({x.doc_id: x for x in hmm_lm.score(d, fold("doc_id", 7) == 2, states=3, rounds=6).collect()} for d in (df.repartition(5), df.orderBy("text").coalesce(1)))
    for i, x in a.items():
        assert (x.n_tokens, x.n_known, x.train_tokens) == (b[i].n_tokens, b[i].n_known, b[i].train_tokens)
        assert math.isclose(x.base_score, b[i].base_score, rel_tol=1e-9) and math.isclose(x.score, b[i].score, rel_tol=2e-3)


def test_merged_counts():
    rng, at, n, every = np.random.default_rng(4), np.zeros(0, np.uint64), np.zeros(0, np.int64), Counter()
    for _ in range(5):
        held = [(np.unique(rng.integers(0, 50, 20).astype(np.uint64)),) for _ in range(3)]
        held = [(h, rng.integers(0, 9, len(h))) for (h,) in held]
        for h, c in held:
            for x, y in zip(h.tolist(), c.tolist(), strict=True):
                every[x] += y
        at, n = hmm_lm._merge(at, n, held)
    assert dict(zip(at.tolist(), n.tolist(), strict=True)) == dict(every) and (np.diff(at.astype(np.int64)) > 0).all()
