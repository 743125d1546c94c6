"""Weighted distribution metrics: coverage, percentiles, leverage, drift, AUC, diversity, integrity scores, gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.similarity import best_match


def chunk_weight(chars: Column, text: Column) -> Column:
    """char_count, else the text's length, else 1."""
    return F.coalesce(F.nullif(chars, F.lit(0)), F.nullif(F.length(text), F.lit(0)), F.lit(1)).cast("double")


def weighted_percentile(df: DataFrame, value: str, weight: str, shares: list[float]) -> DataFrame:
    """One row: for each share the least value up to which that share of all weight lies; null for an empty input.

    Weights are summed by value first. Running sums then go over ranges of values: one total for each range
    partition, and a running sum inside it.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    ranged = sums.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    from textloom.storage import stash

    kept = stash(ranged, "ranges")
    totals = kept.groupBy("p").agg(F.sum("w").alias("w")).orderBy("p").collect()  # a row for each partition
    base, total = [], 0.0
    for r in totals:
        base.append((r.p, float(total)))
        total += float(r.w)
    spark = df.sparkSession
    running = kept.join(F.broadcast(spark.createDataFrame(base, "p int, base double")), "p").withColumn("cw", F.col("base") + F.sum("w").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return running.agg(*(F.min(F.when(F.col("cw") >= F.lit(s * total - 1e-9), F.col("v"))).alias(f"p{round(100 * s)}") for s in shares))


def coverage(df: DataFrame, sim: str = "max_sim", weight: str = "weight", tau: float = 0.75) -> DataFrame:
    """One row: weighted mean and deviation of the best similarity, share of weight at tau or more (percent), and the largest gap."""
    w, s = F.col(weight), F.col(sim)
    mean = F.sum(w * s) / F.sum(w)
    return df.agg(mean.alias("chamfer"), F.sqrt(F.greatest(F.lit(0.0), F.sum(w * s * s) / F.sum(w) - mean * mean)).alias("std"), (100.0 * F.sum(F.when(s >= tau, w).otherwise(0.0)) / F.sum(w)).alias("coverage"), (1.0 - F.min(s)).alias("gap"), F.sum(w).alias("total_weight"))


def leverage(df: DataFrame, parent: Column, sim: str = "max_sim", weight: str = "weight", tau: float = 0.75) -> DataFrame:
    """One row about what skipping costs. parent: rows that were processed.

    rho: share of weight processed; coverage: share at tau or more; skipped_retention: share of the skipped
    weight that is covered (1 if none is skipped); surplus = coverage - rho; leverage = coverage / rho (0 if rho is 0).
    """
    w, hit = F.col(weight), F.col(sim) >= tau
    rho, cov = F.sum(F.when(parent, w).otherwise(0.0)) / F.sum(w), F.sum(F.when(hit, w).otherwise(0.0)) / F.sum(w)
    skipped = F.sum(F.when(~parent, w).otherwise(0.0))
    kept = F.when(skipped == 0, 1.0).otherwise(F.try_divide(F.sum(F.when(~parent & hit, w).otherwise(0.0)), skipped))
    one = df.agg(rho.alias("rho"), cov.alias("coverage"), kept.alias("skipped_retention"))
    return one.withColumn("surplus", F.col("coverage") - F.col("rho")).withColumn("leverage", F.when(F.col("rho") == 0, 0.0).otherwise(F.try_divide("coverage", "rho")))


def centroid(df: DataFrame, vec: str) -> DataFrame:
    """One row: the mean vector, summed by place."""
    places = df.where(F.col(vec).isNotNull()).select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return places.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda r: r["m"]).alias("centroid"))


def drift(before: DataFrame, after: DataFrame, id_col: str, vec: str = "embedding", tau: float = 0.75) -> DataFrame:
    """One row: how well two sets of vectors stand for each other."""
    from textloom.functions.vectors import cosine

    fwd = best_match(before.select(F.col(id_col).alias("i"), F.col(vec).alias("v")), after, row_vec="v", target_id=id_col, target_vec=vec)
    back = best_match(after.select(F.col(id_col).alias("i"), F.col(vec).alias("v")), before, row_vec="v", target_id=id_col, target_vec=vec)
    one = fwd.agg(F.avg("max_sim").alias("forward"), F.percentile("max_sim", F.lit(0.1)).alias("p10"), F.min("max_sim").alias("least"), F.sum((F.col("max_sim") < tau).cast("long")).alias("dropped"))
    two = back.agg(F.avg("max_sim").alias("backward"))
    both = one.join(two, F.lit(True)).join(centroid(before, vec).withColumnRenamed("centroid", "x"), F.lit(True)).join(centroid(after, vec).withColumnRenamed("centroid", "y"), F.lit(True))
    return both.select("forward", "backward", F.try_divide(2 * F.col("forward") * F.col("backward"), F.col("forward") + F.col("backward")).alias("harmonic"), cosine(F.col("x"), F.col("y")).alias("centroid_cosine"), "p10", "least", "dropped")


def distribution(df: DataFrame, value: str) -> DataFrame:
    """count, mean, population deviation, least, interpolated p10, p50, p90 and largest."""
    v = F.col(value).cast("double")
    return df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), *(F.percentile(v, F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.1, 0.5, 0.9)), F.max(v).alias("max"))


def roc_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row, auc: chance that a positive scores above a negative, ties half; one half if either is missing.

    Counts by score first, so only distinct scores are ordered.
    """
    from textloom.storage import stash

    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg"))
    kept = stash(by.repartitionByRange("s").withColumn("p", F.spark_partition_id()), "scores")
    base, below = [], 0
    for r in kept.groupBy("p").agg(F.sum("neg").alias("n")).orderBy("p").collect():  # a row for each partition
        base.append((r.p, below))
        below += r.n
    ranked = kept.join(F.broadcast(df.sparkSession.createDataFrame(base, "p int, base long")), "p").withColumn("lower", F.col("base") + F.sum("neg").over(Window.partitionBy("p").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("neg"))
    area = F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2.0)) / (F.nullif(F.sum("pos"), F.lit(0)) * F.nullif(F.sum("neg"), F.lit(0)))
    return ranked.agg(F.coalesce(area, F.lit(0.5)).alias("auc"))


def zero_anchor(score: Column, mean_negative: Column) -> Column:
    return (score - mean_negative) / F.greatest(F.lit(1e-6), 1.0 - mean_negative)


def min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the value scaled to 0 .. 1 by the least and largest of all rows."""
    ends = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    return df.join(F.broadcast(ends), F.lit(True)).withColumn(out, (F.col(value) - F.col("_lo")) / F.greatest(F.lit(1e-6), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def ternary(df: DataFrame, label: Column, keys: list[str], support: float = 1.0, neutral: float = -0.25, against: float = -1.0) -> DataFrame:
    """Verdict counts, ratios and scores by key; null scores for groups without a verdict.

    calibrated_fidelity is the net score, at least 0; calibrated_fidelity_ratio is supported / (supported + neutral / 4 + against).
    """
    kind = F.upper(F.trim(label))
    state = F.when(kind.isin("SUPPORTED", "PASS"), "s").when(kind.isin("AGAINST", "CONTRADICTED", "CONFRONTED"), "a").otherwise("n")
    n = {k: F.sum((state == k).cast("long")) for k in "sna"}
    out = df.groupBy(*keys).agg(F.count("*").alias("total_probes"), n["s"].alias("supported_count"), n["n"].alias("not_mentioned_count"), n["a"].alias("against_count"))
    s, m, a, t = (F.col(c) for c in ("supported_count", "not_mentioned_count", "against_count", "total_probes"))
    net = F.try_divide(s * support + m * neutral + a * against, t)
    return out.withColumns({"support_ratio": F.round(F.try_divide(s, t), 4), "hallucination_ratio": F.round(F.try_divide(a, t), 4), "net_score": F.round(net, 4), "calibrated_fidelity": F.round(F.greatest(F.lit(0.0), net), 4), "calibrated_fidelity_ratio": F.round(F.try_divide(s, s + 0.25 * m + a), 4)})


def cross_check(df: DataFrame, block: str, dropped: str, probes: str, quality_a: str, quality_b: str, seam: str) -> DataFrame:
    """One row: macro means over blocks, the micro share of dropped probes, and the gates on quality (-0.03) and seams (0.80)."""
    by = df.groupBy(block).agg(F.sum(dropped).alias("d"), F.sum(probes).alias("n"), F.avg(quality_a).alias("a"), F.avg(quality_b).alias("b"), F.avg(seam).alias("s"))
    one = by.agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("s").alias("mean_seam"), F.try_divide(F.sum("d"), F.sum("n")).alias("micro_fail_ratio"))
    return one.withColumn("gate_quality", F.col("mean_b") - F.col("mean_a") >= -0.03).withColumn("gate_seam", F.col("mean_seam") >= 0.80)


def checklist(expected: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """(key, actual, expected, passed) of a checklist (key, expected): an item without a verdict (key, actual) is actually false; of several verdicts one that is true counts."""
    got = verdicts.groupBy(key).agg(F.bool_or("actual").alias("_a"))
    out = expected.join(got, key, "left").select(key, F.coalesce("_a", F.lit(False)).alias("actual"), "expected")
    return out.withColumn("passed", F.col("actual") == F.col("expected"))


def coherence(df: DataFrame, key: str, distance: str) -> DataFrame:
    """By key: order statistics by index (no interpolation) of step distances and a histogram of width 0.05."""
    edges = [0.05, 0.10, 0.15, 0.20]
    d = F.col(distance)
    bucket = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        bucket = F.when(d < e, i).otherwise(bucket)
    ranked = df.where(d.isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(distance)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    at = lambda share: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * share), d))
    return ranked.groupBy(key).agg(F.count("*").alias("steps"), at(0.5).alias("median"), at(0.8).alias("p80"), at(0.95).alias("p95"), F.stddev_pop(d).alias("std"), *(F.sum((bucket == i).cast("long")).alias(f"bucket{i}") for i in range(5)))


def gates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Five gates between two one-row metric tables (chamfer, std, p10, gap, coverage, efficiency, vendi_per_node, skipped_retention, surplus, leverage)."""
    x, y = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns)), b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    d = lambda c: F.col(f"b_{c}") - F.col(f"a_{c}")
    return x.join(y, F.lit(True)).select(
        d("coverage").alias("delta_coverage"), d("std").alias("delta_std"), d("p10").alias("delta_p10"), d("gap").alias("delta_gap"), d("efficiency").alias("delta_efficiency"),
        (d("coverage") >= -4.0).alias("gate_coverage"), ((d("std") <= 0.03) & ((F.col("b_p10") >= 0.5) | (d("p10") >= -0.05))).alias("gate_spread"), (d("gap") <= 0.15).alias("gate_gap"),
        ((d("efficiency") >= -0.005) | (d("vendi_per_node") >= -0.02)).alias("gate_efficiency"), ((F.col("b_skipped_retention") >= 75) & ((F.col("b_surplus") >= 0) | (F.col("b_leverage") >= 1))).alias("gate_skipping"),
    )


def _gram(df: DataFrame, vec: str, dim: int, lead: bool) -> tuple[np.ndarray, int]:
    """Sum of g gT over unit rows (with a leading 1 if lead), added up in the tasks; at most (dim + 1) squared numbers reach the driver from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textloom.operators.similarity import _matrix

        total, n = None, 0
        for batch in batches:
            g = _matrix(batch.column(0), dim)
            g = np.c_[np.ones(len(g)), g] if lead else g
            total, n = g.T @ g if total is None else total + g.T @ g, n + len(g)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(range(len(total)))), pa.array(total.tolist()), pa.array([n] + [0] * (len(total) - 1))], ["i", "row", "n"])

    parts = df.where(F.size(vec) == dim).select(vec).mapInArrow(run, "i long, row array<double>, n long")
    rows = parts.select("i", "n", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    out = np.zeros((dim + lead, dim + lead))
    for r in rows:
        out[r.i, r.j] = r.x
    return out, max((r.n for r in rows if r.i == 0), default=0)


def vendi(df: DataFrame, vec: str = "embedding") -> float:
    """Effective number of different rows: exp of the entropy of the eigenvalues of (1 + G GT) / 2 / n, by its small dual form."""
    shape = df.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count")).first()
    if shape is None:
        return 0.0
    gram, n = _gram(df, vec, shape["d"], True)
    values = np.linalg.eigvalsh(gram / 2 / n)
    values = values[values > 1e-10]
    return float(np.exp(-(values * np.log(values)).sum()))


def whitening(df: DataFrame, vec: str = "embedding", keep: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix) that maps rows to white components, largest first."""
    dim = df.where(F.col(vec).isNotNull()).select(F.max(F.size(vec))).first()[0]
    mean = np.array(centroid(df, vec).first()["centroid"])
    gram, n = _raw_gram(df, vec, dim, mean)
    values, vectors = np.linalg.eigh(gram / max(n, 1))
    order = np.argsort(-values)[: keep or dim]
    return mean, vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-9))


def _raw_gram(df: DataFrame, vec: str, dim: int, mean: np.ndarray) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for batch in batches:
            g = np.array(batch.column(0).to_pylist(), float).reshape(-1, dim) - mean
            total, n = total + g.T @ g, n + len(g)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([n])], ["x", "n"])

    parts = df.where(F.size(vec) == dim).select(vec).mapInArrow(run, "x array<double>, n long").select("n", F.posexplode("x").alias("i", "v"))
    rows = parts.groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()
    return np.array([r.v for r in rows]).reshape(dim, dim), rows[0].n if rows else 0


def project(df: DataFrame, mean: np.ndarray, matrix: np.ndarray, vec: str = "embedding", out: str = "projected") -> DataFrame:
    """df with (x - mean) @ matrix at unit length; null for vectors of another length."""
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            at = np.flatnonzero([v is not None and len(v) == len(mean) for v in s])
            out_ = pd.Series([None] * len(s), dtype=object)
            if len(at):
                y = (np.stack(s.iloc[at].tolist()).astype(float) - mean) @ matrix
                n = np.linalg.norm(y, axis=1, keepdims=True)
                out_.iloc[at] = list(np.divide(y, n, out=y, where=n > 1e-12))
            yield out_

    return df.withColumn(out, run(F.col(vec)))
