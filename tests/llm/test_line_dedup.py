import random
from collections import defaultdict

import numpy as np

from textloom.llm import skew
from textloom.llm.cuckoo import CuckooFilter
from textloom.llm.line_dedup import LineIndex, dedup


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2**63, 20000).astype(np.uint64), rng.integers(0, 2**63, 20000).astype(np.uint64)
    f = CuckooFilter(40000)
    assert f.insert(x) and f.insert(y) and f.contains(x).all() and f.contains(y).all()
    f.delete(x)
    assert f.contains(y).all() and f.contains(x).mean() < 0.01
    g = CuckooFilter.from_bytes(f.to_bytes())
    assert g.contains(y).all()
    g.delete(y)
    assert not (g.table > 0).any()
    assert not CuckooFilter(10).insert(x)


def brute(rows, min_docs=3, least=10):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least:
                    held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def corpus(n=60, seed=3):
    r = random.Random(seed)
    common = ["A common line é %d" % i for i in range(12)]
    return [(i, "\n".join(r.choice([r.choice(common), " \t" + r.choice(common).upper().replace("É", "é") + "\x0b", "short", "", f"own line of {i}"]) for _ in range(r.randint(0, 9)))) for i in range(n)]


def result(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text or "") for r in df.collect())


def test_dedup_equals_brute_force(spark):
    rows = corpus() + [(None, "A common line é 1"), (70, None), (71, ""), (5, "A common line é 2\nA common line é 2"), (72, "A common line é 3\n" * 500)]
    df = spark.createDataFrame([(i, t, "k", "d") for i, t in rows], "doc_id long, text string, key string, doc string").repartition(4)
    out = dedup(df, min_docs=3, min_chars=10)
    assert out.columns == ["doc_id", "text", "key", "doc", "n_lines", "n_dropped"]
    assert result(out) == brute(rows)
    assert dedup(df.limit(0)).count() == 0


def test_insertions_and_deletions_are_reversible(spark):
    rows = corpus()
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = LineIndex(spark, 3, 10, shards=4).insert(frame(rows[:20])).insert(frame(rows[15:]))
    assert result(index.apply(frame(rows))) == brute(rows)
    index.delete(frame(rows[30:]).select("doc_id")).delete(frame([(999, "")]).select("doc_id"))
    assert result(index.apply(frame(rows[:30]))) == brute(rows[:30])
    fresh = LineIndex(spark, 3, 10, shards=4).insert(frame(rows[:30]))
    assert sorted(map(str, index.refs.collect())) == sorted(map(str, fresh.refs.collect()))
    index.filter_bytes = 0  # the way beyond the bound
    assert result(index.apply(frame(rows[:30]))) == brute(rows[:30])


def test_hot_lines_and_filters_by_shard(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST", 2)
    rows = corpus(90, seed=8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index = LineIndex(spark, 3, 10, shards=4, filter_bytes=0).insert(df)
    probed, every = index._probed(index.pairs), index.pairs
    frequent = index.frequent().select("key")
    assert probed.join(frequent, "key").count() == every.join(frequent, "key").count() and probed.count() < every.count()
    assert result(index.apply(df)) == brute(rows)
    none = LineIndex(spark, 999, 10, filter_bytes=-1).insert(df)
    assert none._probed(none.pairs).count() == 0
