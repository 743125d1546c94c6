import random

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import resolution as R


def cos(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def brute(rows, known, low, high, unsure, verdict):
    """One concept after another: by name, else by the most similar canonical one."""
    canon = {i: (n, v) for i, n, v in known}
    rank = {i: 0 for i, *_ in known}
    names = {}
    for i, n, _ in sorted(known):
        names.setdefault(n.lower(), i)
    out, by_name = {}, {}
    for i, n, v in sorted(rows):
        if n.lower() in names:
            out[i] = names[n.lower()]
            continue
        if n.lower() in by_name:
            out[i] = out[by_name[n.lower()]]
            continue
        by_name[n.lower()] = i
        near = sorted((-cos(v, w), rank.get(j, 1), j) for j, (_, w) in canon.items() if cos(v, w) >= low)
        if near:
            sim, j = -near[0][0], near[0][2]
            said = True if sim >= high else verdict(n, canon[j][0], sim)
            if said or (said is None and unsure):
                out[i] = j
                continue
        canon[i] = (n, v)
        out[i] = i
    return out


def test_resolve_equals_one_after_another(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "rho", "sigma", "tau", "phi"]
    make = lambda i: (i, " ".join(r.sample(words, 3)) + f" {r.randrange(9)}", [r.gauss(0, 1) for _ in range(3)])
    known, rows = [make(1000 + i) for i in range(8)], [make(i) for i in range(70)]
    schema = "id long, name string, embedding array<double>"
    verdict = lambda a, b, s: (len(set(a.split()) & set(b.split())) >= 2) if s < 0.9 else None

    def judge(pairs):
        both = F.size(F.array_intersect(F.split("name", " "), F.split("other", " ")))
        return pairs.withColumn("verdict", F.when(F.col("sim") < 0.9, both >= 2))

    for unsure in (True, False):
        got = {x.id: x.canonical for x in R.resolve(spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(known, schema), 0.8, 0.97, judge, unsure).collect()}
        lexical = lambda a, b, s: lexical_verdict(spark, a, b, s)
        want = brute(rows, known, 0.8, 0.97, unsure, lambda a, b, s: x if (x := lexical(a, b, s)) is not None else verdict(a, b, s))
        assert got == want


_CACHE = {}


def lexical_verdict(spark, a, b, sim):
    from textloom.functions import text as T

    key = (a, b, round(sim, 9))
    if key not in _CACHE:
        _CACHE[key] = spark.range(1).select(T.same_concept(F.lit(a), F.lit(b), F.lit(sim)).alias("x")).first().x
    return _CACHE[key]


def test_resolve_odd_rows(spark):
    schema = "id long, name string, embedding array<double>"
    rows = [(1, None, None), (2, "", [0.0, 0.0]), (3, "A thing", [1.0, 0.0]), (4, "a  Thing", None), (5, "Other", [1.0, 0.01]), (6, "Far", [0.0, 1.0])]
    got = {x.id: (x.canonical, x.method) for x in R.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (1, "new"), 2: (2, "new"), 3: (3, "new"), 4: (3, "exact"), 5: (3, "high_vector"), 6: (6, "new")}
    assert R.resolve(spark.createDataFrame([], schema)).count() == 0


def graph(spark):
    nodes = [
        ("concept:The Idea", "Concept", "The Idea", "short", "", 3, "2001-05", [1.0, 0.0]), ("concept:idea", "Concept", "idea", "a longer brief", "detail", 7, "2000-01", None), ("concept:Notion", "Concept", "Notion", "n", "", 5, None, [0.99, 0.05]),
        ("concept:Alone", "Concept", "Alone", "", "only detail", 5, None, [0.0, 1.0]), ("chunk:1", "Chunk", None, None, None, None, None, None), ("chunk:2", "Chunk", None, None, None, None, None, None),
    ]
    edges = [("concept:The Idea", "chunk:1", "SUPPORTED_BY"), ("chunk:2", "concept:idea", "SUPPORTS_IDEA"), ("concept:Notion", "chunk:2", "MENTIONED_IN"), ("concept:Alone", "concept:Notion", "RELATES_TO"), ("concept:idea", "concept:Notion", "RELATES_TO")]
    return spark.createDataFrame(nodes, "id string, type string, name string, brief string, detail string, weight int, month string, embedding array<double>"), spark.createDataFrame(edges, "src string, dst string, relation string")


def test_postprocess_merges_and_a_second_cycle_writes_nothing(spark):
    nodes, edges = graph(spark)
    out = R.postprocess(nodes, edges, synthesize=lambda rows: rows.select("canonical", F.upper("brief").alias("brief"), "detail"))
    found = {r.canonical: r for r in out.clusters.collect()}
    one = next(r for r in found.values() if "idea" in r.aliases)
    assert set(one.aliases) == {"The Idea", "idea", "Notion"} and one.first_month == "2000-01" and one.max_weight == 7 and one.multi and not found["Alone"].multi
    kept = {r.id: r for r in out.nodes.where("type = 'Concept'").collect()}
    name = f"concept:{one.canonical}"
    assert set(kept) == {name, "concept:Alone"} and kept[name].brief == "A LONGER BRIEF" and kept["concept:Alone"].brief == "only detail" and kept[name].occurrences == one.occurrences >= 2
    links = {(r.src, r.dst, r.relation) for r in out.edges.collect()}
    assert {(name, "chunk:1", "SUPPORTED_BY"), ("chunk:1", name, "SUPPORTS_IDEA"), (name, "chunk:2", "SUPPORTED_BY"), ("concept:Alone", name, "RELATES_TO")} <= links and not any(a == b for a, b, _ in links)
    report = out.report().first()
    assert (report.concepts, report.clusters, report.merged, report.multi, report.affected) == (4, 2, 2, 1, 2)
    again = R.postprocess(out.nodes, out.edges)
    assert again.report().first().affected == 0 and again.nodes.count() == out.nodes.count()


def test_only_touched_clusters_are_written(spark):
    nodes, edges = graph(spark)
    out = R.postprocess(nodes, edges, touched=spark.createDataFrame([("concept:Alone",)], "id string"))
    assert {r.id for r in out.nodes.where("type = 'Concept'").collect()} == {"concept:The Idea", "concept:idea", "concept:Notion", "concept:Alone"}
    assert out.nodes.where("postprocessed").count() == 1


def test_each_reason_makes_a_cluster_affected(spark):
    nodes, edges = graph(spark)
    done = R.postprocess(nodes, edges)
    base, links = done.nodes, done.edges
    name = next(r.id for r in base.where("type = 'Concept' and id <> 'concept:Alone'").collect())
    here = F.col("id") == name
    changes = {
        "refined": base.withColumn("refined", F.when(here, False).otherwise(F.col("refined"))), "postprocessed": base.withColumn("postprocessed", F.when(here, None).otherwise(F.col("postprocessed"))),
        "occurrences": base.withColumn("occurrences", F.when(here, 1).otherwise(F.col("occurrences"))), "gone": base.withColumn("id", F.when(here, "concept:renamed").otherwise(F.col("id"))),
    }
    for reason, changed in changes.items():
        assert R.affected(R.clusters_of(changed, links), changed, links).where("affected").count() == 1, reason
    fewer = links.where(~((F.col("src") == name) & (F.col("dst") == "chunk:1")))
    assert R.affected(R.clusters_of(base, fewer), base, fewer).where("affected").count() == 1


def test_merge_node(spark):
    cluster = spark.createDataFrame([("idea", ["Idea"], ["concept:Idea"], ["chunk:1"], 5, "2001-01", 2), ("other", ["Other"], [], [], 1, None, 1)], "normal string, aliases array<string>, node_ids array<string>, chunk_ids array<string>, max_weight int, first_month string, occurrences long")
    node = spark.createDataFrame([("idea", "concept:The Idea", "The Idea", 9, "1999-02")], "normal string, id string, name string, weight int, month string")
    edges = spark.createDataFrame([("concept:The Idea", "chunk:1", "SUPPORTED_BY"), ("chunk:7", "concept:The Idea", "SUPPORTS_IDEA")], "src string, dst string, relation string")
    got = {r.normal: r for r in R.merge_node(cluster, node, edges).collect()}
    one = got["idea"]
    assert (one.aliases, one.chunk_ids, one.max_weight, one.first_month, one.occurrences, one.merged) == (["Idea", "The Idea"], ["chunk:1", "chunk:7"], 9, "1999-02", 3, True)
    assert not got["other"].merged and got["other"].occurrences == 1


def test_representative(spark):
    rows = spark.createDataFrame([("a", "x", "abc"), ("a", "xyz", "b"), ("b", "", "only"), ("c", None, None)], "canonical string, brief string, detail string")
    assert {r.canonical: (r.brief, r.detail) for r in R.representative(rows, "canonical").collect()} == {"a": ("xyz", "abc"), "b": ("only", "only"), "c": ("c", "c")}
