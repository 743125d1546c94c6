from pyspark.sql import functions as F

from textloom.operators import graph as G
from textloom.operators import ledger as L


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def graph(spark):
    nodes = spark.createDataFrame([("book:1", "Book"), ("book:2", "Book"), ("section:1", "Section"), ("chunk:1", "Chunk"), ("concept:a", "Concept"), ("concept:b", "Concept"), ("concept:c", "Concept")], "id string, type string").withColumn("weight", F.lit(4.0))
    edges = [("book:1", "section:1", "HAS_SECTION"), ("section:1", "chunk:1", "HAS_CHUNK"), ("chunk:1", "concept:a", "SUPPORTS_IDEA"), ("chunk:1", "concept:b", "SUPPORTS_IDEA"), ("book:2", "concept:b", "EXPLORES_IDEA"), ("concept:a", "concept:c", "RELATES_TO")]
    return nodes, spark.createDataFrame(edges, "src string, dst string, relation string")


def test_removal_takes_only_orphans(spark):
    nodes, edges = graph(spark)
    out = G.remove_books(nodes, edges, nodes.where("id = 'book:1'"))
    assert rows(out.gone, "id") == [("book:1",), ("chunk:1",), ("concept:a",), ("section:1",)]
    assert rows(out.edges, "src", "dst") == [("book:2", "concept:b")]
    assert {r.type: r.removed for r in out.counts().collect()} == {"Book": 1, "Section": 1, "Chunk": 1, "Concept": 1}
    assert G.remove_books(nodes, edges, nodes.limit(0)).gone.count() == 0


def test_edges_and_stubs(spark):
    e = spark.createDataFrame([("a", "b", "X", 1, "p"), ("a", "b", "Y", 2, None), ("concept:z", "a", "X", 1, "q")], "src string, dst string, relation string, seq int, quote string")
    assert rows(G.latest_edges(e, "seq"), "src", "relation", "quote") == [("a", "Y", "p"), ("concept:z", "X", "q")]
    assert rows(G.first_edges(e, "seq"), "src", "relation") == [("a", "X"), ("concept:z", "X")]
    nodes = spark.createDataFrame([("a", "Book")], "id string, type string")
    assert rows(G.stub_nodes(nodes, e), "id", "type", "weight") == [("b", "Node", 5), ("concept:z", "Concept", 5)]


def test_merge_and_concepts(spark):
    old = spark.createDataFrame([(1, "x", 3), (2, "y", None), (None, "n", 1)], "k int, a string, b int")
    new = spark.createDataFrame([(1, None, 4), (3, "z", 5), (None, "m", None)], "k int, a string, b int")
    assert sorted(map(str, rows(G.merge(old, new, ["k"]), "k", "a", "b"))) == sorted(map(str, [(1, "x", 4), (2, "y", None), (3, "z", 5), (None, "m", 1)]))
    seen = spark.createDataFrame([("a", 1, 5, "bb", "d", None, False), ("a", 2, 7, "cc", None, [1.0], True)], "k string, seq int, weight int, brief string, detail string, embedding array<double>, has_formula boolean")
    r = G.merge_concepts(seen, "k", "seq").first()
    assert (r.occurrences, r.weight, r.brief, r.detail, r.embedding, r.has_formula) == (2, 7, "bb", "d", [1.0], True)


def test_redirect_neighbours_and_difference(spark):
    nodes, edges = graph(spark)
    alias = spark.createDataFrame([("concept:c", "concept:a")], "alias string, canonical string")
    assert ("concept:a", "concept:a") not in rows(G.redirect(edges, alias), "src", "dst") and G.redirect(edges, alias).count() == 5
    seed = nodes.where("id = 'book:1'").select("id")
    assert rows(G.neighbours(edges, seed, 2), "id", "hop") == [("chunk:1", 2), ("section:1", 1)]
    n, e = G.difference_subgraph(nodes, edges, nodes.where("id = 'book:2'").select("id"))
    assert rows(n, "id") == [("book:2",), ("concept:b",)] and e.count() == 1


def test_new_books(spark):
    ours = spark.createDataFrame([(1, "A Paper 2401.12345"), (2, "Hello, World"), (3, "ab"), (4, "Fresh one")], "id int, title string")
    theirs = spark.createDataFrame([(9, "same 2401.12345v2"), (8, "hello world!"), (3, "ab")], "id int, title string")
    assert rows(G.new_books(ours, theirs), "id") == [(4,)]


def test_hashes_and_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").withColumn("h", G.row_hash(["v", "k"]))
    old = df.where("k = 1").union(spark.createDataFrame([(3, "x", "h")], df.schema))
    assert rows(G.changes(df, old, "k", "h"), "k", "change") == [(1, "same"), (2, "added"), (3, "removed")]
    assert rows(G.changed(df, old, "k", "h"), "k") == [(2,)]


def test_shards_and_order(spark):
    sizes = spark.createDataFrame([(1, 600.0), (2, 300.0), (3, 200.0), (4, 2000.0), (5, 1.0)], "book int, mb double")
    assert rows(G.shards(sizes, "book", "mb", 1000), "book", "shard") == [(1, 0), (2, 0), (3, 1), (4, 2), (5, 3)]
    chunks = spark.createDataFrame([("b1_c1_p2_x", 1, None, ""), ("q", 1, None, "B [part 1.1]"), ("z", 1, 3, "")], "id string, ch int, n int, crumb string").withColumn("book", F.lit(1))
    links = G.sequence_links(chunks, "book", G.chunk_order(F.col("ch"), F.col("n"), F.col("id"), F.col("crumb")), "id")
    assert rows(links.where("relation = 'NEXT'"), "src", "dst") == [("b1_c1_p2_x", "z"), ("q", "b1_c1_p2_x")]


def test_ledger(spark):
    ev = spark.createDataFrame([(1, 1, "started"), (1, 2, "completed"), (2, 1, "failed"), (3, 1, "skipped")], "item int, at int, status string")
    last = L.latest(ev, ["item"], ["at"])
    assert {r.status: r.items for r in L.summary(last, "status", []).collect()} == {"completed": 1, "failed": 1, "skipped": 1}
    assert rows(L.completed(last), "item") == [(1,), (3,)]
    assert rows(L.pending(ev.select("item").distinct(), last, "item"), "item") == [(2,)]
    assert rows(L.recoverable(last, F.col("item") == 3), "item") == [(3,)]
    usage = spark.createDataFrame([("a", 1000000, 0), ("a", 1000000, 500000)], "section string, i long, o long")
    price = spark.createDataFrame([("a", 2.0, 4.0)], "section string, i double, o double")
    assert rows(L.token_totals(usage, "section", ["i", "o"], price), "total", "cost") == [(2500000, 6.0)]
