"""Queries on vectors and metrics. Ideas are the vectors whose id ends in 0, chunks all others; weights are the documents' lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators import audit
from textloom.operators import metrics as M
from textloom.operators import similarity as S
from textloom.plans.catalog import query
from textloom.sources.tables import table

LOW, HIGH, TAU = 0.25, 0.35, 0.30


def _sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    chunks = e.where("vec_id % 10 <> 0").join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars"), "vec_id", "left")
    return chunks.withColumn("weight", F.coalesce("n_chars", F.lit(1)).cast("double")), e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "idea_id")


def _sims(spark: SparkSession, sf: str) -> DataFrame:
    chunks, ideas = _sets(spark, sf)
    return S.best_match(chunks, ideas)


_SIMS = """
pairs AS (SELECT c.vec_id, i.vec_id AS idea_id, list_cosine_similarity(c.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS sim FROM embeddings c, embeddings i WHERE c.vec_id % 10 <> 0 AND i.vec_id % 10 = 0),
sims AS (SELECT p.vec_id, max(sim) AS max_sim, coalesce(max(n_chars), 1)::DOUBLE AS weight FROM pairs p LEFT JOIN documents d ON d.doc_id = p.vec_id GROUP BY p.vec_id)
"""


@query(f"WITH {_SIMS} SELECT CASE WHEN max_sim < {LOW} THEN 'unassigned' WHEN max_sim >= {HIGH} THEN 'high_confidence' ELSE 'limbo' END AS tier, count(*) AS chunks, sum(weight) AS weight FROM sims GROUP BY 1")
def route_tiers(spark: SparkSession, sf: str) -> DataFrame:
    chunks, ideas = _sets(spark, sf)
    return S.route(chunks, ideas, LOW, HIGH).groupBy("tier").agg(F.count("*").alias("chunks"), F.sum("weight").alias("weight"))


@query(f"WITH {_SIMS} SELECT vec_id, weight >= 1024 AS recovered, CASE WHEN max_sim < {LOW} THEN 'unassigned' WHEN max_sim >= {HIGH} THEN 'high_confidence' WHEN weight >= 1024 THEN 'unassigned' ELSE 'limbo' END AS tier FROM sims WHERE max_sim >= {LOW} AND max_sim < {HIGH}")
def limbo_recovery(spark: SparkSession, sf: str) -> DataFrame:
    chunks, ideas = _sets(spark, sf)
    out = S.route(chunks, ideas, LOW, HIGH, size=F.col("weight"))
    return out.where(F.col("recovered") | (F.col("tier") == "limbo")).select("vec_id", "recovered", "tier")


@query(f"WITH {_SIMS}, q AS (SELECT vec_id, CASE WHEN max_sim < {LOW} THEN 0 ELSE 1 END AS priority FROM sims WHERE max_sim < {HIGH}) SELECT vec_id, priority, row_number() OVER (PARTITION BY priority ORDER BY vec_id) AS place FROM q")
def llm_queue(spark: SparkSession, sf: str) -> DataFrame:
    chunks, ideas = _sets(spark, sf)
    queue = S.extraction_queue(S.route(chunks, ideas, LOW, HIGH), ["vec_id"])
    return queue.select("vec_id", "priority", F.row_number().over(Window.partitionBy("priority").orderBy("vec_id")).alias("place"))


@query(f"WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, idea_id) AS place FROM pairs) SELECT vec_id, idea_id, place, round(sim, 6) AS sim FROM r WHERE place <= 3")
def top3_ideas(spark: SparkSession, sf: str) -> DataFrame:
    chunks, ideas = _sets(spark, sf)
    hits = S.nearest(chunks.select("vec_id", "embedding"), ideas, 3)
    return hits.select("vec_id", F.posexplode("hits").alias("at", "h")).select("vec_id", F.col("h.id").alias("idea_id"), (F.col("at") + 1).cast("long").alias("place"), F.round("h.sim", 6).alias("sim"))


@query("""
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place FROM p) SELECT query_id, vec_id, place, round(sim, 6) AS sim FROM r WHERE place <= 10
""")
def knn_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of all vectors for each query vector (ids divisible by 100): the corpus is scanned against the query set, partial answers are merged."""
    e = table(spark, sf, "embeddings")
    hits = S.nearest(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("idea_id"), "embedding"), 11)
    rows = hits.select("query_id", F.explode("hits").alias("h")).where("h.id <> query_id").select("query_id", F.col("h.id").alias("vec_id"), F.col("h.sim").alias("s"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")))
    return ranked.where("place <= 10").select("query_id", "vec_id", F.col("place").cast("long").alias("place"), F.round("s", 6).alias("sim"))


@query(f"""
WITH {_SIMS}, q AS (SELECT (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1) AS v), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], v) * (label + 1) AS score FROM embeddings, q WHERE vec_id % 10 = 0),
d AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s), k AS (SELECT vec_id, label, score, row_number() OVER (ORDER BY score DESC, vec_id) AS place FROM d WHERE r = 1) SELECT vec_id, label, round(score, 6) AS score, place FROM k WHERE place <= 20
""")
def idea_priority_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine x weight, the best of each name (here: label), top 20: a top-k report."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 1").select(F.col("embedding").alias("v"))
    scored = e.where("vec_id % 10 = 0").join(F.broadcast(q), F.lit(True)).select("vec_id", "label", (V.cosine(F.col("embedding"), F.col("v")) * (F.col("label") + 1)).alias("score"))
    best = scored.groupBy("label").agg(F.max_by(F.struct("vec_id", "score"), F.struct("score", -F.col("vec_id"))).alias("b")).select("b.vec_id", "label", "b.score")
    return best.orderBy(F.desc("score"), "vec_id").limit(20).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).cast("long")).select("vec_id", "label", F.round("score", 6).alias("score"), "place")


@query(f"WITH {_SIMS} SELECT round(sum(weight * max_sim) / sum(weight), 6) AS chamfer, round(sqrt(sum(weight * max_sim * max_sim) / sum(weight) - (sum(weight * max_sim) / sum(weight)) ** 2), 6) AS std, round(100 * sum(CASE WHEN max_sim >= {TAU} THEN weight ELSE 0 END) / sum(weight), 6) AS coverage, round(1 - min(max_sim), 6) AS gap, sum(weight) AS total_weight FROM sims")
def coverage_chamfer(spark: SparkSession, sf: str) -> DataFrame:
    one = M.coverage(_sims(spark, sf), tau=TAU)
    return one.select(*(F.round(c, 6).alias(c) for c in ("chamfer", "std", "coverage", "gap")), "total_weight")


@query("""
WITH r AS (SELECT n_chars::DOUBLE AS v, sum(n_chars) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS cw, sum(n_chars) OVER () AS tw FROM documents)
SELECT min(v) FILTER (WHERE cw >= 0.1 * tw) AS p10, min(v) FILTER (WHERE cw >= 0.5 * tw) AS p50 FROM r
""")
def weighted_p10_p50(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("n_chars").cast("double").alias("v"), F.col("n_chars").cast("double").alias("w"))
    return M.weighted_percentile(docs, "v", "w", [0.1, 0.5])


@query(f"""
WITH {_SIMS}, one AS (SELECT sum(CASE WHEN vec_id % 3 <> 0 THEN weight ELSE 0 END) / sum(weight) AS rho, sum(CASE WHEN max_sim >= {TAU} THEN weight ELSE 0 END) / sum(weight) AS coverage, sum(CASE WHEN vec_id % 3 = 0 AND max_sim >= {TAU} THEN weight ELSE 0 END) / sum(CASE WHEN vec_id % 3 = 0 THEN weight ELSE 0 END) AS skipped_retention FROM sims)
SELECT round(rho, 6) AS rho, round(coverage, 6) AS coverage, round(skipped_retention, 6) AS skipped_retention, round(coverage - rho, 6) AS surplus, round(coverage / rho, 6) AS leverage FROM one
""")
def skipping_leverage(spark: SparkSession, sf: str) -> DataFrame:
    """What skipping every third chunk costs."""
    one = M.leverage(_sims(spark, sf), F.col("vec_id") % 3 != 0, tau=TAU)
    return one.select(*(F.round(c, 6).alias(c) for c in one.columns))


@query(f"""
WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 = 0), b AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 <> 0),
f AS (SELECT a.vec_id, max(list_cosine_similarity(a.v, b.v)) AS s FROM a, b GROUP BY 1), k AS (SELECT b.vec_id, max(list_cosine_similarity(a.v, b.v)) AS s FROM a, b GROUP BY 1),
ca AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(v[i]) AS m FROM a, range(1, 65) t(i) GROUP BY i)), cb AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(v[i]) AS m FROM b, range(1, 65) t(i) GROUP BY i))
SELECT round(avg(f.s), 6) AS forward, round(any_value(k2.m), 6) AS backward, round(2 * avg(f.s) * any_value(k2.m) / (avg(f.s) + any_value(k2.m)), 6) AS harmonic, round(any_value(list_cosine_similarity(ca.c, cb.c)), 6) AS centroid_cosine, round(quantile_cont(f.s, 0.1), 6) AS p10, round(min(f.s), 6) AS least, count(*) FILTER (WHERE f.s < {TAU}) AS dropped
FROM f, (SELECT avg(s) AS m FROM k) k2, ca, cb
""")
def drift_forward_backward(spark: SparkSession, sf: str) -> DataFrame:
    """How well ideas and chunks stand for each other: every vector is on one side."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    one = M.drift(e.where("vec_id % 10 = 0"), e.where("vec_id % 10 <> 0"), "vec_id", tau=TAU)
    return one.select(*(F.round(c, 6).alias(c) if c != "dropped" else F.col(c) for c in one.columns))


@query("WITH s AS (SELECT l.quality AS y, d.n_chars AS x FROM labels l JOIN documents d USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS ar FROM s) SELECT round((sum(CASE WHEN y = 1 THEN ar END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return M.roc_auc(rows, "n_chars", F.col("quality") == 1).select(F.round("auc", 6).alias("auc"))


@query("SELECT count(n_chars) AS count, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, min(n_chars)::DOUBLE AS min, quantile_cont(n_chars, 0.1) AS p10, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, max(n_chars)::DOUBLE AS max FROM documents")
def distribution_summary(spark: SparkSession, sf: str) -> DataFrame:
    one = M.distribution(table(spark, sf, "documents"), "n_chars")
    return one.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(f"WITH {_SIMS}, m AS (SELECT avg(max_sim) AS mu FROM sims WHERE vec_id % 2 = 0) SELECT vec_id, round((max_sim - mu) / greatest(1e-6, 1 - mu), 6) AS aligned FROM sims, m")
def zero_anchor(spark: SparkSession, sf: str) -> DataFrame:
    sims = _sims(spark, sf).select("vec_id", "max_sim")
    mean = sims.where("vec_id % 2 = 0").agg(F.avg("max_sim").alias("mu"))
    return sims.join(F.broadcast(mean), F.lit(True)).select("vec_id", F.round(M.zero_anchor(F.col("max_sim"), F.col("mu")), 6).alias("aligned"))


@query("SELECT doc_id, round(cume_dist() OVER (ORDER BY n_chars), 9) AS rank FROM documents")
def percentile_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Share of documents no longer than each."""
    from textloom.operators.ranges import percentile_rank as rank

    return rank(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "share").select("doc_id", F.round("share", 9).alias("rank"))


@query("SELECT doc_id, round((n_chars - min(n_chars) OVER ()) / greatest(1e-6, max(n_chars) OVER () - min(n_chars) OVER ()), 9) AS scaled FROM documents")
def minmax(spark: SparkSession, sf: str) -> DataFrame:
    return M.min_max(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "scaled").select("doc_id", F.round("scaled", 9).alias("scaled"))


_VERDICT = "CASE WHEN toxic = 1 THEN 'AGAINST' WHEN quality = 1 THEN 'SUPPORTED' ELSE 'NOT_MENTIONED' END"


@query(f"""
WITH v AS (SELECT d.source, {_VERDICT} AS v FROM labels JOIN documents d USING (doc_id)), n AS (SELECT source, count(*) AS t, count(*) FILTER (v = 'SUPPORTED') AS s, count(*) FILTER (v = 'NOT_MENTIONED') AS m, count(*) FILTER (v = 'AGAINST') AS a FROM v GROUP BY source)
SELECT source, t AS total_probes, s AS supported_count, m AS not_mentioned_count, a AS against_count, round(s / t, 4) AS support_ratio, round(a / t, 4) AS hallucination_ratio, round((s - 0.25 * m - a) / t, 4) AS net_score, round(greatest(0, (s - 0.25 * m - a) / t), 4) AS calibrated_fidelity, round(s / (s + 0.25 * m + a), 4) AS calibrated_fidelity_ratio FROM n
""")
def ternary_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return M.ternary(rows, F.expr(_VERDICT), ["source"])


@query("""
WITH b AS (SELECT source, sum(toxic) AS d, count(*) AS n, avg(quality) AS a, avg(quality * (1 - toxic)) AS b, avg(1 - toxic) AS s FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(s), 6) AS mean_seam, round(sum(d) / sum(n), 6) AS micro_fail_ratio, avg(b) - avg(a) >= -0.03 AS gate_quality, avg(s) >= 0.8 AS gate_seam FROM b
""")
def micro_fail_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    one = M.cross_check(rows.withColumns({"one": F.lit(1), "ok": F.col("quality") * (1 - F.col("toxic")), "seam": 1 - F.col("toxic")}), "source", "toxic", "one", "quality", "ok", "seam")
    return one.select(*(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "mean_seam", "micro_fail_ratio")), "gate_quality", "gate_seam")


@query("""
WITH p AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings), d AS (SELECT label, greatest(0, least(2, 1 - list_cosine_similarity(v, w))) / 10 AS d FROM p WHERE w IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM d)
SELECT label, count(*) AS steps, round(max(d) FILTER (r = floor(n * 0.5)), 6) AS median, round(max(d) FILTER (r = floor(n * 0.8)), 6) AS p80, round(max(d) FILTER (r = floor(n * 0.95)), 6) AS p95, round(stddev_pop(d), 6) AS std, count(*) FILTER (d < 0.05) AS bucket0, count(*) FILTER (d >= 0.05 AND d < 0.1) AS bucket1, count(*) FILTER (d >= 0.1 AND d < 0.15) AS bucket2, count(*) FILTER (d >= 0.15 AND d < 0.2) AS bucket3, count(*) FILTER (d >= 0.2) AS bucket4 FROM r GROUP BY label
""")
def coherence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Step distances (tenths) between neighbours of a label."""
    e = table(spark, sf, "embeddings")
    steps = e.withColumn("next", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("next is not null").withColumn("d", V.cosine_distance(F.col("embedding"), F.col("next")) / 10)
    out = M.coherence(steps, "label", "d")
    return out.select("label", "steps", *(F.round(c, 6).alias(c) for c in ("median", "p80", "p95", "std")), *(f"bucket{i}" for i in range(5)))


@query("SELECT b.item_id, coalesce(max(CASE WHEN contains(d.text, b.text) THEN 1 ELSE 0 END) = 1, false) AS actual, b.item_id % 2 = 0 AS expected, coalesce(max(CASE WHEN contains(d.text, b.text) THEN 1 ELSE 0 END) = 1, false) = (b.item_id % 2 = 0) AS passed FROM benchmark b, documents d GROUP BY b.item_id")
def checklist_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each item's text stands verbatim in some document, against what is expected."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    found = audit.held_verbatim(table(spark, sf, "documents"), items, [], ["item_id"], F.col("text"), F.col("text")).distinct()
    return M.checklist(items.select("item_id", (F.col("item_id") % 2 == 0).alias("expected")), found.withColumn("actual", F.lit(True)), "item_id")


@query(f"""
WITH {_SIMS}, g AS (SELECT low, high FROM (VALUES (0.20, 0.30), (0.20, 0.35), (0.25, 0.30), (0.25, 0.35), (0.25, 0.40), (0.30, 0.40)) t(low, high))
SELECT low::DOUBLE AS low, high::DOUBLE AS high, count(*) FILTER (max_sim < low) AS unassigned, count(*) FILTER (max_sim >= low AND max_sim < high) AS limbo, count(*) FILTER (max_sim >= high) AS high_confidence, round(100 * sum(CASE WHEN max_sim < low THEN weight ELSE 0 END) / sum(weight), 6) AS rho FROM sims, g GROUP BY 1, 2
""")
def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Static routing for a grid of threshold pairs, from one pass of similarities."""
    pairs = [(0.20, 0.30), (0.20, 0.35), (0.25, 0.30), (0.25, 0.35), (0.25, 0.40), (0.30, 0.40)]
    grid = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in pairs))
    s, w = F.col("max_sim"), F.col("weight")
    rows = _sims(spark, sf).select("max_sim", "weight", F.explode(grid).alias("g")).select("max_sim", "weight", "g.low", "g.high")
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("low", "high").agg(n(s < F.col("low")).alias("unassigned"), n((s >= F.col("low")) & (s < F.col("high"))).alias("limbo"), n(s >= F.col("high")).alias("high_confidence"), F.round(100 * F.sum(F.when(s < F.col("low"), w).otherwise(0.0)) / F.sum(w), 6).alias("rho"))


@query("""
WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS w FROM p WHERE vec_id = 0)
SELECT vec_id, round(CASE WHEN list_dot_product(v[49:64], v[49:64]) <= 1e-24 THEN list_cosine_similarity(v[1:48], w[1:48]) ELSE greatest(list_cosine_similarity(v[1:48], w[1:48]), 0.65 * list_cosine_similarity(v[1:48], w[1:48]) + 0.35 * list_cosine_similarity(v[49:64], w[49:64])) END, 6) AS adaptive, round(list_max(list_transform(list_zip(v, w), lambda x: abs(x[1] - x[2]))), 6) AS largest_gap FROM p, q
""")
def adaptive_cosine(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("w"))
    rows = e.join(F.broadcast(q), F.lit(True))
    return rows.select("vec_id", F.round(V.adaptive_cosine(F.col("embedding"), F.col("w"), math_dims=16), 6).alias("adaptive"), F.round(V.largest_gap(F.col("embedding"), F.col("w")), 6).alias("largest_gap"))


@query()
def vendi(spark: SparkSession, sf: str) -> DataFrame:
    """Diversity of all vectors."""
    return spark.createDataFrame([(round(M.vendi(table(spark, sf, "embeddings")), 6),)], "vendi double")


@query()
def whitening(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    mean, matrix = M.whitening(e, keep=16)
    return M.project(e.select("vec_id", "embedding"), mean, matrix).select("vec_id", F.transform("projected", lambda x: F.round(x, 4)).alias("projected"))


@query()
def vector_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors through the half-precision codec, with what that costs."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding").withColumn("packed", V.encode_udf()(F.col("embedding")))
    back = e.withColumn("back", V.decode_udf()(F.col("packed")))
    return back.select("vec_id", F.length("packed").alias("chars"), F.round(V.cosine(F.col("embedding"), F.col("back")), 4).alias("cosine"), F.round(V.largest_gap(F.col("embedding"), F.col("back")), 3).alias("gap"))


@query("""
WITH e AS (SELECT vec_id, list_concat((embedding::DOUBLE[])[1:48], CASE WHEN vec_id % 3 = 0 THEN list_transform(range(16), lambda x: 0.0::DOUBLE) ELSE (embedding::DOUBLE[])[49:64] END) AS v, vec_id % 3 <> 0 AS f FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS idea, list_cosine_similarity(a.v[1:48], b.v[1:48]) AS t, CASE WHEN a.f AND b.f THEN list_cosine_similarity(a.v[49:64], b.v[49:64]) END AS m FROM e a, e b WHERE a.vec_id % 10 <> 0 AND b.vec_id % 10 = 0)
SELECT vec_id, round(max(CASE WHEN m IS NULL THEN t ELSE greatest(t, 0.65 * t + 0.35 * m) END), 6) AS max_sim FROM p GROUP BY vec_id
""")
def formula_aware_match(spark: SparkSession, sf: str) -> DataFrame:
    """Best matches of vectors whose last 16 numbers are formula features; every third has none."""
    e = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.concat(F.slice("embedding", 1, 48), F.array_repeat(F.lit(0.0).cast("float"), 16))).otherwise(F.col("embedding")).alias("embedding"))
    out = S.best_match(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "idea_id"), formula_dims=16)
    return out.select("vec_id", F.round("max_sim", 6).alias("max_sim"))
