"""Pairs of chunks and ideas that should and should not be alike, how well vectors tell them apart, and one report on a graph's space.

Where a view draws random pairs, these draw by hash of the ids: the same pairs whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators import metrics as M
from textloom.operators.similarity import best_match


def chunk_pairs(chunks: DataFrame, chunk_ideas: DataFrame, offset: int = 7919) -> DataFrame:
    """(a, b, positive) of chunks (chunk, book, section, idx, embedding): neighbours in a section, chunks two apart in a book that share an idea (chunk, idea); against them each chunk with one drawn from another book."""
    w = Window.partitionBy("book").orderBy("idx", "chunk")
    near = chunks.select("chunk", "book", "section", "idx", F.lead("chunk").over(w).alias("b1"), F.lead("section").over(w).alias("s1"), F.lead("idx").over(w).alias("i1"), F.lead("chunk", 2).over(w).alias("b2"))
    one = near.where(F.col("b1").isNotNull() & F.col("s1").eqNullSafe(F.col("section")) & (F.abs(F.col("i1") - F.col("idx")) == 1)).select(F.col("chunk").alias("a"), F.col("b1").alias("b"))
    ideas = chunk_ideas.select("chunk", "idea").distinct()
    two = near.where("b2 is not null").select(F.col("chunk").alias("a"), F.col("b2").alias("b"))
    two = two.join(ideas.select(F.col("chunk").alias("a"), "idea"), "a").join(ideas.select(F.col("chunk").alias("b"), "idea"), ["b", "idea"]).select("a", "b").distinct()
    return one.unionByName(two).distinct().withColumn("positive", F.lit(True)).unionByName(strangers(chunks, "chunk", chunks, "chunk", offset).withColumn("positive", F.lit(False)))


def strangers(left: DataFrame, left_id: str, right: DataFrame, right_id: str, offset: int = 7919) -> DataFrame:
    """(a, b): each left row (with book) with one right row of another book, if there is one.

    Books stand in a ring by hash; each left row looks at the next book and there, by its own hash, at one of that book's
    rows. Only one row for each book is ordered; no pair is tried in vain.
    """
    sizes = right.where("book is not null").groupBy("book").agg(F.count("*").alias("n"))
    ring = Window.orderBy(F.xxhash64("book", F.lit(offset)), "book")
    books = sizes.select("book", "n", F.lead("book").over(ring).alias("other"), F.lead("n").over(ring).alias("other_n"), F.first("book").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("f"), F.first("n").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("fn"))
    after = books.select("book", F.coalesce("other", "f").alias("other"), F.coalesce("other_n", "fn").alias("m")).where("other <> book")
    numbered = right.select(F.col("book").alias("other"), F.col(right_id).alias("b"), (F.row_number().over(Window.partitionBy("book").orderBy(right_id)) - 1).alias("at"))
    asked = left.select(F.col(left_id).alias("a"), "book").join(after, "book").withColumn("at", F.pmod(F.xxhash64("a", F.lit(offset)), F.col("m")).cast("int"))
    return asked.join(numbered, ["other", "at"]).select("a", "b")


def idea_chunk_pairs(ideas: DataFrame, chunks: DataFrame, offset: int = 104729) -> DataFrame:
    """(a, b, positive): ideas (idea, chunk, book) with the chunk they came from, and with one of another book."""
    from_ = ideas.join(chunks.select("chunk"), "chunk", "left_semi").select(F.col("idea").alias("a"), F.col("chunk").alias("b"), F.lit(True).alias("positive"))
    return from_.unionByName(strangers(ideas, "idea", chunks, "chunk", offset).withColumn("positive", F.lit(False)))


def idea_pairs(ideas: DataFrame, relations: DataFrame, offset: int = 15485863) -> DataFrame:
    """(a, b, positive): ideas (idea, book) that a relation (a, b) joins, and each idea with one of another book. Without relations each idea stands for itself."""
    names = ideas.select("idea").distinct()
    joined = relations.select("a", "b").distinct().join(names.select(F.col("idea").alias("a")), "a", "left_semi").join(names.select(F.col("idea").alias("b")), "b", "left_semi").select("a", "b")
    if joined.isEmpty():
        joined = names.select(F.col("idea").alias("a"), F.col("idea").alias("b"))
    return joined.withColumn("positive", F.lit(True)).unionByName(strangers(ideas, "idea", ideas, "idea", offset).withColumn("positive", F.lit(False)))


def pair_similarity(pairs: DataFrame, left: DataFrame, right: DataFrame, vec: str = "embedding") -> DataFrame:
    """pairs (a, b, ..) with sim, the cosine of the vectors that left (id, vec) and right (id, vec) hold; pairs without both are left out."""
    x, y = left.select(F.col("id").alias("a"), F.col(vec).alias("_x")), right.select(F.col("id").alias("b"), F.col(vec).alias("_y"))
    return pairs.join(x, "a").join(y, "b").withColumn("sim", V.cosine(F.col("_x"), F.col("_y"))).drop("_x", "_y")


def pair_report(pairs: DataFrame) -> DataFrame:
    """One row for pairs (positive, sim): counts, means and deviations of both sides, margin, AUC, span, and the means aligned so that the negative mean is 0."""
    side = lambda p, c: F.when(F.col("positive") == p, c)
    s = F.col("sim")
    one = pairs.agg(
        F.count_if("positive").alias("num_positive"), F.count_if(~F.col("positive")).alias("num_negative"), F.avg(side(True, s)).alias("positive_mean"), F.avg(side(False, s)).alias("negative_mean"),
        F.stddev_pop(side(True, s)).alias("positive_std"), F.stddev_pop(side(False, s)).alias("negative_std"), F.percentile(side(True, s), F.lit(0.5)).alias("positive_p50"), F.percentile(side(False, s), F.lit(0.5)).alias("negative_p50"), (F.max(s) - F.min(s)).alias("span"),
    )
    aligned = one.withColumns({"margin": F.col("positive_mean") - F.col("negative_mean"), "aligned_positive_mean": M.zero_anchor(F.col("positive_mean"), F.col("negative_mean")), "aligned_negative_mean": M.zero_anchor(F.col("negative_mean"), F.col("negative_mean"))})
    return aligned.join(M.roc_auc(pairs, "sim", F.col("positive")), F.lit(True))


def space_report(chunks: DataFrame, ideas: DataFrame, parents: Column | None = None, tau: float = 0.75, weight: str = "weight", **names: str) -> DataFrame:
    """One row on how ideas cover chunks: chamfer, std, coverage (percent), gap, weighted p10 and p50, counts, vendi, vendi_per_node and efficiency (coverage share per idea in a hundred), and with `parents` what skipping costs."""
    from textloom.storage import stash

    sims = stash(best_match(chunks, ideas, **names), "space")
    one = M.coverage(sims, weight=weight, tau=tau).join(M.weighted_percentile(sims, "max_sim", weight, [0.1, 0.5]), F.lit(True))
    n = ideas.count()
    diversity = M.vendi(ideas, names.get("target_vec", "embedding"))
    one = one.withColumns({"chunks": F.lit(sims.count()), "ideas": F.lit(n), "vendi": F.lit(diversity), "vendi_per_node": F.lit(diversity / n if n else 0.0), "efficiency": F.when(F.lit(n) > 0, F.col("coverage") / F.lit(float(max(n, 1)))).otherwise(F.lit(0.0))})
    if parents is not None:
        cost = M.leverage(sims, parents, weight=weight, tau=tau).select("rho", F.col("skipped_retention") * 100, "surplus", "leverage").toDF("rho", "skipped_retention", "surplus", "leverage")
        one = one.join(cost, F.lit(True))
    return one
