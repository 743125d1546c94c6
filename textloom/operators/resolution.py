"""Concept resolution in three bands, and postprocessing of a graph's concepts into canonical ones.

Names decide first, then vectors: from `high` on two concepts are one; from `low` on their names may decide, else the
caller's judge (a function from pairs to verdicts, in place of a language model) does, else `unsure`; below they are two.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import graph as G
from textloom.operators.ordered import leader_clusters, settle
from textloom.operators.similarity import nearest
from textloom.storage import stash

#: Categories that are never one concept with another of them, whatever the names.
APART = ["Mathematical Formulation", "Formula", "Empirical Finding"]
_FORMULAS = ["Mathematical Formulation", "Formula"]

#: A judge gets (a, b, sim, ..) pairs and adds a boolean column `verdict`.
Judge = Callable[[DataFrame], DataFrame]


def same_concept(a: dict[str, Column], b: dict[str, Column], low: float = 0.80, high: float = 0.95) -> Column:
    """struct(same, similarity, method) of two concepts given by name, category, has_formula, quote and embedding (all but the name may be left out).

    method: exact, distinct_formula_guard, distinct_category_guard, high_vector, lexical, open (the names leave the
    band undecided: same is null) or none. Null vectors are similar to nothing.
    """
    get = lambda c, k: F.coalesce(c[k], F.lit("")) if k in c else F.lit("")
    flag = lambda c: F.coalesce(c["has_formula"], F.lit(False)) if "has_formula" in c else F.lit(False)
    x, y = (T.normalize_name(c["name"]) for c in (a, b))
    p, q = (F.trim(get(c, "quote")) for c in (a, b))
    formulas = (flag(a) | get(a, "category").isin(_FORMULAS)) & (flag(b) | get(b, "category").isin(_FORMULAS))
    other_formula = formulas & (p != "") & (q != "") & (p != q) & ~F.contains(q, p) & ~F.contains(p, q)
    other_kind = get(a, "category").isin(APART) & get(b, "category").isin(APART) & (get(a, "category") != get(b, "category"))
    sim = F.coalesce(V.cosine(a["embedding"], b["embedding"]), F.lit(0.0)) if "embedding" in a and "embedding" in b else F.lit(0.0)
    names = T.same_concept(a["name"], b["name"], sim)
    made = lambda same, value, method: F.struct(same.alias("same"), value.alias("similarity"), F.lit(method).alias("method"))
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    return (
        F.when((x == y) & other_formula, made(no, F.lit(0.0), "distinct_formula_guard")).when((x == y) & other_kind, made(no, F.lit(0.0), "distinct_category_guard"))
        .when(x == y, made(yes, F.lit(1.0), "exact")).when(sim >= high, made(yes, sim, "high_vector"))
        .when((sim >= low) & names.isNotNull(), made(names, sim, "lexical")).when(sim >= low, made(none, sim, "open")).otherwise(made(no, sim, "none"))
    )


def resolve(concepts: DataFrame, known: DataFrame | None = None, low: float = 0.80, high: float = 0.95, judge: Judge | None = None, unsure: bool = True) -> DataFrame:
    """(id, canonical, method, similarity) of concepts (id, name, embedding), in order of id, against known ones (id, name, embedding) and one another.

    An equal normal name joins the known one, else the first of that name. Others look at the most similar canonical
    concept, known or earlier: from `high` on they join it; from `low` on the names decide, else the judge, else `unsure`;
    a concept that joins none is canonical itself. ids of both tables differ; ties go to the known, then the smaller id.
    Null names and vectors match nothing; each such concept is its own.
    """
    spark = concepts.sparkSession
    own = concepts.select("id", "name", "embedding", F.nullif(T.normalize_name(F.col("name")), F.lit("")).alias("n"))
    kind = concepts.schema["id"].dataType
    old = known.select("id", "name", "embedding", F.nullif(T.normalize_name(F.col("name")), F.lit("")).alias("n")) if known is not None else spark.createDataFrame([], own.schema)
    named = old.where("n is not null").groupBy("n").agg(F.min("id").alias("to"))
    first = own.where("n is not null").groupBy("n").agg(F.min("id").alias("first"))
    placed = stash(own.join(named, "n", "left").join(first, "n", "left"), "resolve-names")
    exact = placed.where("to is not null or first <> id").select("id", F.col("to").alias("joined"), "first")
    rest = placed.where("to is null and (first is null or first = id)").select("id", "name", "embedding")
    # every pair at `low` or more; known concepts stand before all others
    targets = old.select("id", "name", "embedding", F.lit(0).alias("rank")).unionByName(rest.select("id", "name", "embedding", F.lit(1).alias("rank"))).where("embedding is not null")
    total = targets.count()
    hits = nearest(rest, targets.select(F.struct("rank", "id").alias("t"), F.col("embedding").alias("v")).select(F.to_json("t").alias("t"), "v"), max(total, 1), target_id="t", target_vec="v", least=low)
    read = F.from_json("h.id", f"rank int, id {kind.simpleString()}")
    pairs = hits.select("id", "name", F.explode("hits").alias("h")).select("id", "name", read.alias("t"), F.col("h.sim").alias("sim")).where((F.col("t.rank") == 0) | (F.col("t.id") < F.col("id")))
    pairs = pairs.select("id", "name", F.col("t.id").alias("to"), F.col("t.rank").alias("rank"), "sim")
    named_pairs = stash(pairs.join(targets.select(F.col("id").alias("to"), F.col("name").alias("other")), "to"), "resolve-pairs")
    verdict = F.when(F.col("sim") >= high, True).otherwise(T.same_concept(F.col("name"), F.col("other"), F.col("sim")))
    judged = named_pairs.withColumn("joins", verdict)
    if judge is not None:
        asked = judge(judged.where("joins is null").select(F.col("id").alias("a"), F.col("to").alias("b"), "name", "other", "sim"))
        judged = judged.join(asked.select(F.col("a").alias("id"), F.col("b").alias("to"), "verdict"), ["id", "to"], "left").withColumn("joins", F.coalesce("joins", "verdict")).drop("verdict")
    links = stash(judged.withColumn("joins", F.coalesce("joins", F.lit(unsure))).select("id", "to", "sim", "rank", "joins"), "resolve-links")
    order = F.struct(-F.col("sim"), "rank", "to")
    found = settle(rest.select("id").unionByName(old.select("id")), links, order).join(old.select("id"), "id", "left_anti")
    met = links.select("id", F.col("to").alias("canonical"), "sim").groupBy("id", "canonical").agg(F.max("sim").alias("sim"))
    out = found.withColumnRenamed("leader", "canonical").join(met, ["id", "canonical"], "left")
    new = out.select("id", "canonical", F.when(F.col("id") == F.col("canonical"), "new").when(F.col("sim") >= high, "high_vector").otherwise("verdict").alias("method"), F.coalesce("sim", F.lit(1.0)).alias("similarity"))
    via = found.select(F.col("id").alias("first"), F.col("leader").alias("through"))
    by_name = exact.join(via, "first", "left").select("id", F.coalesce("joined", "through", "first").alias("canonical"), F.lit("exact").alias("method"), F.lit(1.0).alias("similarity"))
    return new.unionByName(by_name)


def representative(observed: DataFrame, key: str, name: str = "canonical", brief: str = "brief", detail: str = "detail") -> DataFrame:
    """(key, brief, detail): the longest brief text of each key, else its longest detail, else its name; and the other way round."""
    longest = lambda c: F.max_by(F.nullif(F.col(c), F.lit("")), F.struct(F.length(c), F.col(c)))
    one = observed.groupBy(key).agg(longest(brief).alias("_b"), longest(detail).alias("_d"), F.min(name).alias("_n"))
    return one.select(key, F.coalesce("_b", "_d", "_n").alias(brief), F.coalesce("_d", "_b", "_n").alias(detail))


@dataclass
class Postprocessed:
    nodes: DataFrame
    edges: DataFrame
    clusters: DataFrame  # normal, canonical, aliases, occurrences, first_month, affected, multi
    aliases: DataFrame  # (alias, canonical) node ids

    def report(self) -> DataFrame:
        """One row: concepts, clusters, merged, multi, single and affected clusters."""
        c = self.clusters
        one = c.agg(F.sum(F.size("aliases")).alias("concepts"), F.count("*").alias("clusters"), F.count_if("multi").alias("multi"), F.count_if(~F.col("multi")).alias("single"), F.count_if("affected").alias("affected"))
        return one.withColumn("merged", F.col("concepts") - F.col("clusters"))


def clusters_of(nodes: DataFrame, edges: DataFrame, theta: float = 0.92, least: int = 2) -> DataFrame:
    """Clusters of concept nodes (id, name, weight, month, embedding): by normal name, then by greedy leaders from cosine `theta` on, in order of normal name.

    normal, canonical (most mentions, then shortest, then first), aliases, node_ids, chunk_ids, max_weight, first_month,
    occurrences (mentions or chunks, whichever is more), embedding (of the first name that has one), multi.
    """
    concepts = nodes.where("type = 'Concept'").withColumn("normal", T.normalize_name(T.canonical_name(F.col("name")))).where("normal <> ''")
    support = edges.where(F.col("relation").isin("SUPPORTED_BY", "MENTIONED_IN")).select(F.col("src").alias("id"), F.col("dst").alias("chunk"))
    support = support.unionByName(edges.where("relation = 'SUPPORTS_IDEA'").select(F.col("dst").alias("id"), F.col("src").alias("chunk"))).distinct()
    seen = concepts.join(support, "id", "left").select("normal", F.col("name"), "id", "weight", "month", "chunk")
    mentions = seen.groupBy("normal", "id", "name").agg(F.greatest(F.count("chunk"), F.lit(1)).alias("k"), F.max("weight").alias("w"), F.min("month").alias("m"), F.collect_set("chunk").alias("c"))
    names = concepts.groupBy("normal").agg(F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.struct("name", "id"))).alias("embedding"))
    numbered = stash(names, "cluster-names")
    leaders = leader_clusters(numbered.where("embedding is not null"), "normal", theta)
    group = numbered.select("normal").join(leaders, "normal", "left").select("normal", F.coalesce("leader", "normal").alias("lead"))
    rows = mentions.join(group, "normal")
    best = F.max_by("name", F.struct(F.col("k"), -F.length("name"), F.transform(F.split("name", ""), lambda x: -F.ascii(x))))
    out = rows.groupBy(F.col("lead").alias("normal")).agg(best.alias("canonical"), F.sort_array(F.collect_set("name")).alias("aliases"), F.sort_array(F.collect_set("id")).alias("node_ids"), F.array_distinct(F.flatten(F.collect_list("c"))).alias("chunk_ids"), F.max("w").alias("max_weight"), F.min("m").alias("first_month"), F.sum("k").alias("mentions"))
    out = out.withColumn("occurrences", F.greatest("mentions", F.size("chunk_ids").cast("long"))).drop("mentions")
    return out.join(numbered, "normal").withColumn("multi", F.col("occurrences") >= least)


def affected(clusters: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """clusters with affected: whether a cycle has to write them again.

    So are clusters whose canonical node is missing, that have several nodes, are multi and not refined, not yet
    postprocessed, or whose node lacks occurrences, an earlier month, a vector, or an edge to or from one of their chunks.
    """
    own = nodes.where("type = 'Concept'").select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") if c in nodes.columns else F.lit(None).cast(k).alias(f"_{c}") for c, k in (("refined", "boolean"), ("postprocessed", "boolean"), ("occurrences", "long"), ("month", "string"))), F.col("embedding").isNotNull().alias("_vec"))
    out = clusters.withColumn("_id", F.concat(F.lit("concept:"), "canonical")).join(own, "_id", "left")
    want = clusters.select(F.concat(F.lit("concept:"), "canonical").alias("src"), F.explode("chunk_ids").alias("dst")).join(nodes.where("type = 'Chunk'").select(F.col("id").alias("dst")), "dst", "left_semi")
    have = edges.select("src", "dst").distinct()
    lacking = want.join(have, ["src", "dst"], "left_anti").select(F.col("src").alias("_id")).unionByName(want.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(have, ["src", "dst"], "left_anti").select(F.col("dst").alias("_id"))).distinct().withColumn("_lack", F.lit(True))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rules = T.any_of(
        F.col("_vec").isNull(), F.size("node_ids") > 1, F.col("multi") & no("_refined"), no("_postprocessed"), F.coalesce("_occurrences", F.lit(0)) < F.col("occurrences"),
        F.col("first_month").isNotNull() & (F.col("_month").isNull() | (F.col("first_month") < F.col("_month"))), F.col("embedding").isNotNull() & no("_vec"), F.coalesce("_lack", F.lit(False)),
    )
    return out.join(lacking, "_id", "left").withColumn("affected", rules).drop("_id", "_refined", "_postprocessed", "_occurrences", "_month", "_vec", "_lack")


def postprocess(nodes: DataFrame, edges: DataFrame, theta: float = 0.92, least: int = 2, touched: DataFrame | None = None, synthesize: Callable[[DataFrame], DataFrame] | None = None) -> Postprocessed:
    """Concepts of a graph merged into canonical ones. nodes: id, type, name, brief, detail, weight, month, embedding, and refined, postprocessed, occurrences if there.

    Only affected clusters (and, with touched (id), only those that hold a touched concept) are written: one node each
    with the longest texts, largest weight, earliest month and all occurrences; alias nodes go and their edges move to it;
    SUPPORTED_BY and SUPPORTS_IDEA edges join it and its chunks. synthesize gets (canonical, brief, detail, occurrences)
    of the affected multi clusters and gives (canonical, brief, detail): a language model's step.
    """
    found = affected(clusters_of(nodes, edges, theta, least), nodes, edges)
    if touched is not None:
        hit = found.select("normal", F.explode("node_ids").alias("id")).join(touched.select("id"), "id", "left_semi").select("normal").distinct().withColumn("_t", F.lit(True))
        found = found.join(hit, "normal", "left").withColumn("affected", F.col("affected") & F.coalesce("_t", F.lit(False))).drop("_t")
    found = stash(found, "clusters")
    act = found.where("affected")
    member = act.select("canonical", F.explode("node_ids").alias("id"))
    seen = member.join(nodes.select("id", "brief", "detail"), "id")
    texts = representative(seen, "canonical")
    if synthesize is not None:
        multi = act.where("multi").select("canonical", "occurrences").join(texts, "canonical")
        made = synthesize(multi).select("canonical", F.col("brief").alias("_b"), F.col("detail").alias("_d"))
        texts = texts.join(made, "canonical", "left").select("canonical", F.coalesce("_b", "brief").alias("brief"), F.coalesce("_d", "detail").alias("detail"))
    canonical = act.join(texts, "canonical").select(
        F.concat(F.lit("concept:"), "canonical").alias("id"), F.lit("Concept").alias("type"), F.col("canonical").alias("name"), "brief", "detail", F.col("max_weight").alias("weight"), F.col("first_month").alias("month"), "embedding",
        "occurrences", F.lit(True).alias("postprocessed"), F.col("multi").alias("refined"),
    )
    aliases = member.select(F.col("id").alias("alias"), F.concat(F.lit("concept:"), "canonical").alias("canonical"))
    kept = nodes.join(aliases.select(F.col("alias").alias("id")), "id", "left_anti").join(canonical.select("id"), "id", "left_anti")
    out_nodes = kept.unionByName(canonical, allowMissingColumns=True)
    moved = G.redirect(edges, aliases.where("alias <> canonical"))
    support = act.select(F.concat(F.lit("concept:"), "canonical").alias("src"), F.explode("chunk_ids").alias("dst"))
    links = support.select("src", "dst", F.lit("SUPPORTED_BY").alias("relation")).unionByName(support.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("SUPPORTS_IDEA").alias("relation")))
    return Postprocessed(out_nodes, moved.unionByName(links).distinct(), found, aliases)


def merge_node(cluster: DataFrame, node: DataFrame, edges: DataFrame) -> DataFrame:
    """Clusters (normal, aliases, node_ids, chunk_ids, max_weight, first_month, occurrences) that take in existing nodes (normal, id, name, weight, month): their aliases, chunks, weight, month and occurrences."""
    support = edges.where(F.col("relation").isin("SUPPORTED_BY", "MENTIONED_IN")).select(F.col("src").alias("id"), F.col("dst").alias("chunk")).unionByName(edges.where("relation = 'SUPPORTS_IDEA'").select(F.col("dst").alias("id"), F.col("src").alias("chunk")))
    more = node.join(support.distinct(), "id", "left").groupBy("normal").agg(F.collect_set("name").alias("_a"), F.collect_set(T.canonical_name(F.col("name"))).alias("_k"), F.collect_set("id").alias("_i"), F.collect_set("chunk").alias("_c"), F.max("weight").alias("_w"), F.min("month").alias("_m"))
    out = cluster.join(more, "normal", "left")
    add = lambda c, *more_: F.sort_array(F.array_distinct(F.concat(F.col(c), *(F.coalesce(F.col(m), F.array().cast("array<string>")) for m in more_))))
    fresh = F.size(F.array_except(F.coalesce("_c", F.array().cast("array<string>")), F.col("chunk_ids")))
    out = out.withColumns({"occurrences": F.col("occurrences") + F.when(F.col("_i").isNull(), 0).otherwise(F.greatest(fresh, F.when(F.size("chunk_ids") == 0, 1).otherwise(0))), "aliases": add("aliases", "_a", "_k"), "node_ids": add("node_ids", "_i"), "chunk_ids": add("chunk_ids", "_c"), "max_weight": F.greatest("max_weight", "_w"), "first_month": F.least("first_month", "_m"), "merged": F.col("_i").isNotNull()})
    return out.drop("_a", "_k", "_i", "_c", "_w", "_m")
