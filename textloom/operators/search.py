"""Lexical search: TF-IDF over words and letter triples, tiered scores, sort orders, caps."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def features(text: Column) -> Column:
    """Words of two letters or more, and all triples of characters, of the lower-cased text."""
    t = F.lower(text)
    words = F.filter(F.regexp_extract_all(t, F.lit(r"(?U)\w+"), F.lit(0)), lambda x: F.length(x) >= 2)
    triples = F.when(F.length(t) >= 3, F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, triples)


def tfidf_scores(df: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """(id, score): cosine of (1 + ln tf)(ln((n + 1) / (df + 1)) + 1) vectors of each row and the query; rows that share nothing are left out.

    Document frequencies are counted over all rows by a shuffle of distinct (row, feature) pairs; the query's features are few and broadcast.
    """
    spark = df.sparkSession
    q = query.lower()
    counted = Counter([w for w in re.findall(r"\w+", q) if len(w) >= 2] + [q[i : i + 3] for i in range(len(q) - 2)])
    n = df.count()
    tf = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(features(F.col(text_col))).alias("f")).groupBy("id", "f").agg(F.count("*").alias("c"))
    idf = tf.groupBy("f").agg((F.log((n + 1) / (F.count("*") + 1)) + 1).alias("idf"))
    w = tf.join(idf, "f").select("id", "f", ((1 + F.log("c")) * F.col("idf")).alias("w"))
    wanted = spark.createDataFrame([(f, 1 + math.log(c)) for f, c in counted.items()] or [("", 0.0)], "f string, k double")
    qv = wanted.join(idf, "f", "left").select("f", (F.col("k") * F.coalesce("idf", F.lit(1.0))).alias("qw"))
    norm = math.sqrt(qv.agg(F.sum(F.col("qw") * F.col("qw"))).first()[0] or 1.0) or 1.0
    scored = w.join(F.broadcast(qv), "f", "left").groupBy("id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    return scored.where(F.col("dot").isNotNull()).select(F.col("id").alias(id_col), (F.col("dot") / F.col("n") / norm).alias("score"))


def sort_order(mode: str, tie: str) -> list[Column]:
    """Sort columns of a mode (unknown ones sort as month_desc), with a tie-breaker."""
    down = F.desc_nulls_last
    orders = {
        "month_desc": [down("month"), down("weight"), down("occurrences")],
        "month_asc": [F.asc_nulls_last("month"), down("weight")],
        "weight_desc": [down("weight"), down("occurrences"), down("month")],
        "occurrences_desc": [down("occurrences"), down("weight"), down("month")],
        "similarity_desc": [down("cosine_similarity"), down("weight")],
        "relevance": [down("match_score"), down("weight"), down("occurrences")],
        "name_asc": [F.lower("name")],
    }
    return [*orders.get(mode, orders["month_desc"]), F.col(tie)]


def cap_per_seed(df: DataFrame, seed: str, order: list[Column], per_seed: int, total: int) -> DataFrame:
    """At most per_seed rows of each seed and total in all, in order: a top-k report."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(seed).orderBy(*order))).where(F.col("_r") <= per_seed)
    return ranked.orderBy("_r", *order).limit(total).drop("_r")


def seed_score(terms: list[tuple[str, str]], name: Column, summary: Column, detail: Column, weight: Column, semantic: Column | None = None) -> Column:
    """Score of a graph seed: the whole question, its phrases and its words, by the field they stand in, the semantic rank and the weight.

    terms: (kind, text) with kind full, phrase or word; of each kind the best term counts. 30 where nothing matches.
    """
    points = {"full": (15000, 9000, 5000), "phrase": (2500, 1200, 600), "word": (50, 25, 15)}
    fields = [F.lower(F.coalesce(c, F.lit(""))) for c in (name, summary, detail)]
    parts = []
    for kind, values in points.items():
        cases = [F.when(F.contains(f, F.lit(t.lower())), v).otherwise(0) for k, t in terms if k == kind for f, v in zip(fields, values, strict=True)]
        parts.append(F.greatest(*cases, F.lit(0)) if len(cases) > 1 else F.lit(0))
    total = sum(parts, F.lit(0)) + (F.when(semantic, 4000).otherwise(0) if semantic is not None else F.lit(0))
    return F.when(total > 0, total + F.coalesce(weight, F.lit(0))).otherwise(F.lit(30) + F.coalesce(weight, F.lit(0)))
