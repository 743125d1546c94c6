import numpy as np
from pyspark.sql import functions as F

from textloom.operators import audit as A


def test_overlaps_equal_a_loop(spark):
    rng = np.random.default_rng(1)
    make = lambda n: [(int(k), int(s), int(s + w)) for k, s, w in zip(rng.integers(0, 3, n), rng.integers(0, 200, n), rng.integers(1, 60, n), strict=True)]
    a, b = sorted(set(make(40))), sorted(set(make(40)))
    frame = lambda x: spark.createDataFrame(x, "k int, start int, end int")
    got = sorted((r.k, r.l_start, r.l_end, r.r_start, r.r_end, r.contained) for r in A.overlaps(frame(a), frame(b), "k", 16).collect())
    assert got == sorted((k, s, e, x, y, s <= (x + y) / 2 <= e) for k, s, e in a for j, x, y in b if j == k and s < y and e > x)


def test_locate(spark):
    long_ = "a" * 60 + "MIDDLE" + "b" * 60
    df = spark.createDataFrame([("xx needle yy", "needle"), ("q " + "a" * 60 + "other" + "b" * 60, long_), ("none", "zzz")], "t string, q string")
    got = [r.x and tuple(r.x) for r in df.select(A.locate(F.col("t"), F.col("q")).alias("x")).collect()]
    assert got[0] == (3, 9) and got[1][0] == 2 and got[2] is None


def test_greedy_match(spark):
    df = spark.createDataFrame([("b", 1, 1, 0.9), ("b", 2, 1, 0.95), ("b", 2, 2, 0.8), ("b", 3, 2, 0.3)], "k string, l int, r int, s double")
    assert sorted((x.l, x.r) for x in A.greedy_match(df, "k", "l", "r", "s", 0.5).collect()) == [(1, 1), (2, 2)]


def test_worst_and_sample(spark):
    df = spark.createDataFrame([(1, 0.5, "A  b"), (2, 0.1, "c"), (3, 0.2, "a B"), (4, 0.9, None)], "id int, s double, t string")
    assert [(r.id, r.place) for r in A.worst(df, "s", "t", "id").orderBy("place").collect()] == [(2, 1), (3, 2), (4, 3)]
    assert A.worst(df, "s", "t", "id", offset=1, chars=3).count() == 2
    big = spark.range(20000)
    assert 1700 < A.sample(big, "id", 0.1).count() < 2300 and A.sample(big, "id", 0.0).count() == 0


def test_json(spark):
    assert A.salvage('<think>x</think>```json\n[{"a": 1}, {"b": 2}, {"c": ') == [{"a": 1}, {"b": 2}]
    assert A.salvage("[]") == [] and A.salvage("no") == []
    df = spark.createDataFrame([("```json\n{\"a\": 1}```",), (None,)], "v string")
    assert [r.x for r in df.select(A.salvage_column(F.col("v")).alias("x")).collect()] == [['{"a": 1}'], []]
    assert df.select(A.llm_json(F.col("v")).alias("x")).first().x == '{"a": 1}'


def test_quotes_and_texts(spark):
    q = ["short", "The quick brown fox jumps over", "the quick brown fox jumps OVER!", "A very different sentence here", "The quick brown fox jumps over the dog"]
    assert A.prune_quotes(q) == ["The quick brown fox jumps over the dog", "A very different sentence here"]
    df = spark.createDataFrame([(q, "abcd", "abxx"), (None, "", "")], "q array<string>, a string, b string")
    got = df.select(A.prune_quotes_column(F.col("q")).alias("q"), A.disproportion(F.col("a"), F.col("b")).alias("d"), A.safe_component(F.lit("a b/ü")).alias("s")).collect()
    assert len(got[0].q) == 2 and abs(got[0].d - (1 - 2 / 6)) < 1e-9 and got[1].d == 0 and got[0].s == "a%20b%2F%C3%BC"


def test_consolidation(spark):
    df = spark.createDataFrame([("k", i, f"d{i % 2}", [f"r{i}", "x"], f"desc {i}", f"quote {i}") for i in range(6)], "k string, i int, detail string, related array<string>, description string, quote string")
    r = A.consolidate(df, "k", "i").first()
    assert (r.detail, r.related) == ("d0\n\nd1", ["r0", "x", "r1", "r2", "r3"])
    assert A.payload(df, "k", ["i"]).first().payload.split("\n") == ['- desc 0 "quote 0"', '- desc 1 "quote 1"', '- desc 2 "quote 2"', '> "quote 3"', '> "quote 4"']
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "cluster int, embedding array<double>")
    o = spark.createDataFrame([(7, [1.0, 0.05]), (8, [0.0, 1.0])], "id int, embedding array<double>")
    assert [(r.cluster, r.id) for r in A.absorb(c, o).collect()] == [(1, 7)]


def test_vicreg(spark):
    x = np.random.default_rng(2).normal(size=(50, 3))
    df = spark.createDataFrame([(v.tolist(), v.tolist()) for v in x], "a array<double>, b array<double>")
    cov = np.cov(x.T)
    want = 15 * np.maximum(0, 1 - np.sqrt(np.diag(cov) + 1e-4)).mean() + 2 * 5 * ((cov**2).sum() - (np.diag(cov) ** 2).sum()) / 3
    assert abs(A.vicreg(df, "a", "b") - want) < 1e-8


def test_greedy_matching_takes_every_legal_partner(spark):
    from textloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    sims = (x := x / np.linalg.norm(x, axis=1)[:, None]) @ x.T
    used, want = {}, []
    for i, r in enumerate(rows):
        taken = used.setdefault(r.label, set())
        if r.vec_id % 2 == 0 and (legal := [j for j, o in enumerate(rows) if o.vec_id % 2 and sims[i, j] >= 0.2 and j not in taken]):
            taken.add(legal[0])
            want.append((r.label, r.vec_id, rows[legal[0]].vec_id))
    assert sorted((r.label, r.vec_id, r.idea_id) for r in catalog.queries()["greedy_matching"](spark, sf).collect()) == sorted(want)


def test_payload_cuts_as_its_sql_does(spark, tmp_path):
    import duckdb

    from textloom.plans import catalog
    from textloom.plans import graph_queries as G

    ends = ["\n", "\r\n", " ", "\u2028", "\u0085", "\x0b", ".\n"]
    rows = [(i, most, f"{'x' * (most - 6 - len(end))} words{end} and much more that does not fit" + " y" * 40) for i, end in enumerate(ends) for most in (100, 120, 150)]
    rows += [(50, None, "last"), (50, 1, None), (50, 1, "first"), (51, 1, None), (52, 1, ""), (53, 1, "a"), (53, 2, None), (53, 3, "c"), (53, 4, ""), (53, 5, "e"), (53, 6, "f")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = dict(con.execute(catalog.oracle_sql()["consolidation_payload"]).fetchall())
    assert {r.conv_id: r.payload for r in G.consolidation_payload(spark, str(tmp_path)).collect()} == want
