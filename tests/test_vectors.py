import re

import numpy as np
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.functions.formulas import extract_formulas, formula_features
from textloom.operators import metrics as M
from textloom.operators import similarity as S


def frame(spark, x, name="vec_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, embedding array<double>")


def random(n, d=8, seed=0):
    return np.random.default_rng(seed).normal(size=(n, d))


def test_nearest_equals_numpy(spark, monkeypatch):
    x, y = random(50), random(23, seed=1)
    sims = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    for limit in (S.BLOCK_NUMBERS, 40):
        monkeypatch.setattr(S, "BLOCK_NUMBERS", limit)
        for k in (1, 3, 50):
            got = {r.vec_id: [(h.id, h.sim) for h in r.hits] for r in S.nearest(frame(spark, x), frame(spark, y, "idea_id"), k).collect()}
            for i, row in enumerate(sims):
                want = np.argsort(-row, kind="stable")[:k]
                assert [a for a, _ in got[i]] == want.tolist() and np.allclose([b for _, b in got[i]], row[want])


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    ideas = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [1.0, 2.0, 3.0]), (10, [0.0, 1.0])], "idea_id long, embedding array<double>")
    assert {r.vec_id: r.max_sim for r in S.best_match(rows, ideas).collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}
    assert {r.tier for r in S.route(rows, ideas.limit(0)).collect()} == {"unassigned"}
    assert S.modal_dimension(ideas).count() == 2


def test_routing_tiers(spark):
    rows = spark.createDataFrame([(i, [c, (1 - c * c) ** 0.5], n) for i, (c, n) in enumerate([(0.5, 10), (0.7, 10), (0.7, 2000), (0.95, 10)])], "vec_id long, embedding array<double>, size int")
    idea = spark.createDataFrame([(1, [1.0, 0.0])], "idea_id long, embedding array<double>")
    got = {r.vec_id: (r.tier, r.recovered) for r in S.route(rows, idea, size=F.col("size")).collect()}
    assert got == {0: ("unassigned", False), 1: ("limbo", False), 2: ("unassigned", True), 3: ("high_confidence", False)}


def test_identity_coverage(spark):
    df = frame(spark, np.eye(5)).withColumn("weight", F.lit(1.0))
    one = M.coverage(S.best_match(df, frame(spark, np.eye(5), "idea_id"))).first()
    assert (one.chamfer, one["std"], one.coverage, one.gap) == (1.0, 0.0, 100.0, 0.0)


def test_percentiles_auc_and_scaling(spark):
    df = spark.createDataFrame([(0.1, 1), (0.5, 3), (0.9, 6)], "v double, w int")
    assert M.weighted_percentile(df, "v", "w", [0.1, 0.4, 0.41, 1.0]).first().asDict() == {"p10": 0.1, "p40": 0.5, "p41": 0.9, "p100": 0.9}
    s = spark.createDataFrame([(0.9, True), (0.8, True), (0.1, False), (0.2, False)], "s double, y boolean")
    assert M.roc_auc(s, "s", F.col("y")).first().auc == 1.0
    assert M.roc_auc(s.withColumn("s", F.lit(1.0)), "s", F.col("y")).first().auc == 0.5
    assert M.roc_auc(s.where("y"), "s", F.col("y")).first().auc == 0.5
    d = M.distribution(spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4, 0.5)], "v double"), "v").first()
    assert (d["count"], round(d["mean"], 9), d["min"], d["max"]) == (5, 0.3, 0.1, 0.5)
    z = spark.createDataFrame([(0.5,), (0.75,), (1.0,)], "s double").select(M.zero_anchor(F.col("s"), F.lit(0.5)).alias("z"))
    assert [r.z for r in z.collect()] == [0.0, 0.5, 1.0]


def test_drift_of_a_set_with_itself(spark):
    df = frame(spark, random(12))
    one = M.drift(df, df, "vec_id").first()
    assert all(abs(one[c] - 1) < 1e-9 for c in ("forward", "backward", "harmonic", "centroid_cosine", "p10", "least")) and one.dropped == 0


def test_leverage_identities(spark):
    df = spark.createDataFrame([(0.9, 2.0, True), (0.2, 1.0, True), (0.8, 1.0, False)], "max_sim double, weight double, p boolean")
    one = M.leverage(df, F.col("p")).first()
    assert (one.rho, one.coverage, one.skipped_retention, one.surplus, one.leverage) == (0.75, 0.75, 1.0, 0.0, 1.0)
    assert M.leverage(df.where("p"), F.col("p")).first().skipped_retention == 1.0


def test_vendi_and_whitening(spark):
    x = random(40, 4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    values = np.linalg.eigvalsh((1 + u @ u.T) / 2 / len(u))
    values = values[values > 1e-10]
    assert abs(M.vendi(frame(spark, x)) - np.exp(-(values * np.log(values)).sum())) < 1e-6
    assert abs(M.vendi(frame(spark, np.ones((9, 3)))) - 1) < 1e-9 and M.vendi(frame(spark, x).limit(0)) == 0
    mean, matrix = M.whitening(frame(spark, x))
    y = (x - mean) @ matrix
    assert np.allclose(y.T @ y / len(y), np.eye(4), atol=1e-6)


def test_codec_and_composite(spark):
    x = random(6, 10)
    df = frame(spark, x).withColumn("back", V.decode_udf()(V.encode_udf()(F.col("embedding"))))
    assert df.where(V.cosine(F.col("embedding"), F.col("back")) < 0.9999).count() == 0
    c = df.select(V.norm(V.composite(F.slice("embedding", 1, 5), F.slice("embedding", 6, 5))).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in c)


def test_ternary(spark):
    df = spark.createDataFrame([("a", v) for v in ("SUPPORTED", " pass ", "CONTRADICTED", "x")], "k string, v string")
    r = M.ternary(df, F.col("v"), ["k"]).first()
    assert (r.total_probes, r.supported_count, r.not_mentioned_count, r.against_count, r.net_score, r.calibrated_fidelity) == (4, 2, 1, 1, 0.1875, 0.1875)


def test_formulas():
    v = formula_features(r"$\nabla L = \sum x$ the gradient")
    assert v[5] > 2.5 and v[1] > 1.7 and v[0] == 1.0 and v[32:64].sum() == 3.0
    assert not formula_features("  ").any()
    found = extract_formulas("Text $$a = b$$ here\nthen $c_1 \\le d$ and \\(a = b\\)\nE = m c\n")
    assert [f[1] for f in found] == ["a = b", "c_1 \\le d", "E = m c"]


def test_every_formula_keyword_counts():
    from textloom.functions import formulas as fm

    for text in [*fm.KEYWORDS, "the variance of a softmax policy gradient", "kl divergence and l2 norm", "unrelated words"]:
        want = np.zeros(128)
        for word, targets in fm.KEYWORDS.items():
            if re.search(rf"\b{word}\b", text):
                for t in targets:
                    want[64 + fm._bucket(t[4:], 64) if t.startswith("var:") else list(fm.OPERATORS).index(t)] += 1.8
        for v in fm.VARIABLES:
            if not v.startswith("\\"):
                want[64 + fm._bucket(v, 64)] += f" {text} ".replace("-", " ").count(f" {v} ")
        if "kl" in text.split():
            want[list(fm.OPERATORS).index("KL")] += fm.OPERATORS["KL"]
        assert np.allclose(fm.formula_features(text), want, atol=1e-4), text
