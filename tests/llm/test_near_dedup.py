import random

import numpy as np
import pytest

from textloom.llm import components as cc
from textloom.llm import near_dedup as nd
from textloom.llm import skew


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t, k))
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return sorted((str(i), len(shingle_set(t, k)), str(None if i is None else find(i)), i is None or find(i) == i) for i, t in rows)


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def corpus(seed=5):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = r.choices(vocab, k=r.randint(20, 90))
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.randint(0, 7)):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append(" ".join(t) if r.random() < 0.8 else "  ".join(t).upper())
            base = t if g % 3 == 0 else base  # chains
    rows += ["", None, " \n", "one", "ONE", "one two", "é ü", "long " * 4000, "long " * 4100]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark):
    for seed, k in ((5, 2), (6, 2), (7, 5)):
        rows = corpus(seed) + [(None, "one two"), (3, dict(corpus(seed))[3])]
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, id int").repartition(3)
        assert result(nd.near_duplicates(df, k)) == brute(rows, k)
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_large_bucket_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(nd, "_TILE", 4)
    r = random.Random(8)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(shared + [f"{i // 2}x{j}" for j in range(14)] + [f"{i}y{r.random()}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(nd.near_duplicates(df, 2)) == brute(rows, 2)


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = np.sort(x[:800]), np.sort(x[100:])
    least = nd.minima(np.r_[a, b], np.array([0, 800, 1600]))
    p = nd.planes(least).view(np.uint64)
    differ = int(np.bitwise_count((p[0, :2] ^ p[1, :2]) | (p[0, 2:] ^ p[1, 2:])).sum())
    assert abs(((128 - differ) / 128 - 0.25) / 0.75 - 700 / 900) < 0.2
    assert (nd.band_keys(least)[0] == nd.band_keys(least)[1]).any()


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(cc, "FEW_EDGES", few)
    r = random.Random(1)
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(20)] + [(7, 7)]
    got = {x.node: x.component for x in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41))
    assert all(got[a] == got[b] for a, b in edges if a != b)


def test_small_sets_in_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(nd, "STARS", 0)
    rows = []
    for g in range(60):
        core = [f"{g}c{j}" for j in range(5)]
        rows += [(len(rows) + i, " ".join([f"{g}x{i}", *core, f"{g}y{i}"])) for i in range(12)]
        rows += [(len(rows), " ".join(core)), (len(rows) + 1, " ".join([*core, f"{g}z"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(nd.near_duplicates(df, 2)) == brute(rows, 2)


def test_hot_keys_small_tiles_and_shuffled_ids(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST", 2)
    for name, value in (("_PAIRS", 2), ("BROADCAST_IDS", 0), ("_TILE_BYTES", 200), ("_TILE", 5)):
        monkeypatch.setattr(nd, name, value)
    rows = corpus(9)
    shared = [f"s{i}" for i in range(40)]
    rows += [(len(rows) + i, " ".join([*shared, *(f"{i // 2}x{j}" for j in range(8)), f"{i}y"])) for i in range(40)]
    assert result(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == brute(rows, 2)


def test_join_dealt(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST", 3)
    left = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (None, 9), (4, 7)) for i in range(n)], "k int, i int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, v string")
    want = sorted(map(str, left.join(right, "k").select("k", "i", "v").collect()))
    assert sorted(map(str, skew.join_dealt(left, right, "k", "i").select("k", "i", "v").collect())) == want
    hot = skew.hot_keys(left.groupBy("k").count(), "k", "count")
    assert {(r.k, r._parts) for r in hot.collect() if r.k} == {(1, 17), (4, 3)}
    assert sorted(map(str, skew.join_dealt(left, right, "k", "i", hot).select("k", "i", "v").collect())) == want
