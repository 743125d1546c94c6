import random

from textloom.llm import decontaminate as dc


def grams(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items, least=0.8):
    out = []
    for d, t in docs:
        for i, q in items:
            n = len((q or "").encode().lower().split())
            k = min(5, n)
            if n and (s := grams(q, k)) and len(s & grams(t, k)) >= least * len(s) - 1e-9:
                out.append((str(d), str(i), len(s), len(s & grams(t, k))))
    return sorted(out)


def data(seed=1):
    r = random.Random(seed)
    say = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(say(r.choice([6, 9, 12, 15, 20, 33, 60, 75, 140, 300])))) for i in range(40)] + [(100, "x y"), (101, ""), (102, None), (103, "solo"), (104, "same same same same same same same")]
    docs = []
    for d in range(120):
        t = say(r.randint(0, 900))
        for _ in range(r.randint(0, 3)):
            q = (r.choice(items)[1] or "").split()
            if r.random() < 0.5 and len(q) > 30:
                q[r.randrange(len(q))] = "changed"
            if r.random() < 0.3:  # in two places
                h = len(q) // 2
                t, q = q[:h] + ["gap"] * r.randint(1, 40) + t, q[h - 4 if h > 4 else h :]
            at = r.randint(0, len(t))
            t = t[:at] + q + t[at:]
        docs.append((d, r.choice([" ", "\n", " \t"]).join(t).upper() if r.random() < 0.3 else " ".join(t)))
    return docs + [(None, items[3][1]), (500, None), (501, ""), (502, "X  Y"), (502, "X  Y"), (503, "w1 " * 30000)], items


def test_equals_brute_force(spark, monkeypatch):
    for limit in (dc.GROUP_SHINGLES, 300):
        monkeypatch.setattr(dc, "GROUP_SHINGLES", limit)
        docs, items = data()
        df = spark.createDataFrame([(d, t, "q", 1) for d, t in docs], "doc_id long, text string, item_id string, leaks int").repartition(3)
        out = dc.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
        assert out.columns == ["doc_id", "text", "item_id", "leaks"] and out.count() == len(docs)
        assert sorted((str(r.doc_id), str(x.item), x.n_shingles, x.n_common) for r in out.collect() for x in r.leaks) == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.contaminated(docs, items.limit(0)).first().leaks == []
    assert dc.contaminated(docs.limit(0), items).count() == 0


def test_no_repetitive_or_tiny_item_is_missed(spark):
    r = random.Random(7)
    say = lambda n, v=3000: [f"w{r.randrange(v)}" for _ in range(n)]
    items = [" ".join(say(3, 10**6) * 300), " ".join(say(20, 10**6) * 20), "one1", "two1 two2 two3", *(" ".join(say(n, 10**6)) for n in (5, 6, 7, 8, 9, 12, 30)), "again " * 900]
    items += [" ".join(say(4, 10**6) * n) for n in (2, 7, 60)]
    docs = []
    for i, q in enumerate(items):
        for _ in range(40):
            t = say(6000)
            at = r.randint(0, len(t))
            docs.append((len(docs), " ".join(t[:at] + q.split() + t[at:])))
    scattered = items[10].split()
    for _ in range(40):  # shingle by shingle, all over the text
        t = say(400)
        for a in r.sample(range(26), 22):
            at = r.randint(0, len(t))
            t = t[:at] + scattered[a : a + 5] + t[at:]
        docs.append((len(docs), " ".join(t)))
    table = list(enumerate(items))
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(table, "item_id long, text string"))
    got = sorted((str(x.doc_id), str(y.item), y.n_shingles, y.n_common) for x in found.collect() for y in x.leaks)
    assert got == brute(docs, table) and len(got) >= 40 * len(items)


def test_sketch_bound_for_any_share():
    r = random.Random(5)
    for least in (0.1, 0.5, 0.8, 1.0):
        items = [(i, " ".join(r.choices("abcdefgh", k=r.randint(1, 60)))) for i in range(60)]
        sets = []
        for _, q in items:
            w = dc.words(*dc.as_buffer(dc.pa.array([q])))
            sets.append((k := min(5, len(w.hash)), dc.np.unique(dc.shingles(w, k)[0])))
        docs = [(i, " ".join(r.choices("abcdefgh", k=r.randint(0, 900)))) for i in range(30)]
        got = dc.ItemIndex(sets, least).matches(dc.words(*dc.as_buffer(dc.pa.array([t for _, t in docs]))), len(docs))
        assert sorted((str(d), str(i), n, c) for d, row in enumerate(got) for i, n, c in row) == brute(docs, items, least)


def test_hits_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(dc, "_HITS", 3)
    test_sketch_bound_for_any_share()
