import numpy as np
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import evaluation as E
from textloom.operators import integration as I
from textloom.operators import metrics as M
from textloom.operators import ranges, search
from textloom.operators import surface as S


def graph(spark):
    nodes = [("c1", "Concept", "Small Ring", 3.0, [1.0, 0.0]), ("c2", "Idea", "small ring", 1.0, [0.9, 0.1]), ("c3", "Concept", "Other", 9.0, [0.0, 1.0]), ("b1", "Book", "A Book", None, None), ("s1", "Section", "Part", 2.0, None), ("k1", "Chunk", None, 1.0, None)]
    edges = [("c2", "b1", "IN"), ("s1", "c2", "HAS"), ("c2", "c3", "RELATES"), ("k1", "c2", "SUPPORTS_IDEA"), ("c3", "k1", "SUPPORTED_BY"), ("c2", "k1", "SUPPORTED_BY"), ("c1", "c3", "RELATES")]
    return spark.createDataFrame(nodes, "id string, type string, name string, weight double, embedding array<double>"), spark.createDataFrame(edges, "src string, dst string, relation string")


def test_nodes_are_found_and_upgraded_to_ideas(spark):
    nodes, edges = graph(spark)
    asked = spark.createDataFrame([("c1",), ("SMALL RING",), ("Other",), ("nothing",)], "asked string")
    assert {r.asked: r.id for r in S.find_nodes(nodes, asked).collect()} == {"c1": "c2", "SMALL RING": "c2", "Other": "c3"}
    page = {(r.part, r.other, r.relation, r.outgoing) for r in S.node_details(nodes, edges, asked.where("asked = 'c1'")).collect()}
    assert page == {("books", "b1", "IN", True), ("evidence", "s1", "HAS", False), ("ideas", "c3", "RELATES", True), ("evidence", "k1", "SUPPORTED_BY", True)}


def test_expansion_by_kind_and_order(spark):
    nodes, edges = graph(spark)
    seeds = spark.createDataFrame([("c2",)], "id string")
    got = S.expand(nodes, edges, seeds, "all", 3).orderBy("place").collect()
    assert [(r.id, r.place) for r in got] == [("c3", 1), ("b1", 2), ("s1", 3)]
    assert {r.id for r in S.expand(nodes, edges, seeds, "Chunk").collect()} == {"k1"} and S.expand(nodes, edges, seeds, "Concept").first().id == "c3"


def test_search_in_one_and_two_steps(spark):
    nodes, edges = graph(spark)
    seeds = {r.id: (r.cosine, r.priority_score) for r in S.seed_ideas(nodes, " Small ring ", [0.0, 1.0], 0.7).collect()}
    assert seeds == {"c1": (1.0, 3.0), "c2": (1.0, 1.0), "c3": (1.0, 9.0)}
    one, two = (S.query_ideas(nodes, edges, "small ring", deep=deep) for deep in (False, True))
    assert ("c3", "k1") not in {(r.src, r.dst) for r in one.edges.collect()} and ("c3", "k1") in {(r.src, r.dst) for r in two.edges.collect()}
    assert S.query_ideas(nodes, edges, "small rings").seeds.count() == 2  # by letters
    assert S.query_ideas(nodes, edges, "qqqq zzzz").edges.count() == 0
    assert S.query_ideas(nodes, edges, "small ring", limit=1).edges.count() == 1


def test_ideas_for_chunks_prefer_the_edge(spark):
    nodes = spark.createDataFrame([("c", "Concept", "N", 4.0, "node brief", "Kind")], "id string, type string, name string, weight double, brief string, category string")
    edges = spark.createDataFrame([("c", "k", "SUPPORTED_BY", "from the idea", "q1"), ("k", "c", "SUPPORTS_IDEA", "from the chunk", "")], "src string, dst string, relation string, brief string, quote string")
    r = S.ideas_for_chunks(nodes, edges, spark.createDataFrame([("k",), ("x",)], "id string")).collect()
    assert [(x.chunk, x.name, x.brief, x.quote, x.category, x.weight) for x in r] == [("k", "N", "from the chunk", "q1", "Kind", 4.0)]


def test_routed_chunks_and_concepts_become_graph_rows(spark):
    routed = spark.createDataFrame([("1", "t" * 300, 7, "2001", "high_confidence", "Idea", "s"), ("2", "x", 7, None, "limbo", "Idea", ""), ("3", "y", None, None, "high_confidence", None, "")], "chunk_id string, text string, book_id long, publication_date string, tier string, idea string, summary string")
    out = I.high_confidence(routed)
    assert [(r.id, r.filter_state) for r in out.nodes.collect()] == [("chunk:1", "retain")]
    assert {(r.src, r.dst, r.relation, len(r.quote or ""), r.month) for r in out.edges.collect()} == {("concept:Idea", "chunk:1", "SUPPORTED_BY", 200, "2001-01"), ("chunk:1", "concept:Idea", "SUPPORTS_IDEA", 200, "2001-01"), ("book:7", "concept:Idea", "EXPLORES_IDEA", 0, "2001-01")}
    schema = "chunk_id string, book_id long, publication_date string, name string, summary string, brief string, detail string, category string, weight int, quote string, embedding array<double>"
    rows = [("1", 1, "2002-03-04", " Idea ", "", "", None, None, 0, None, [1.0]), ("2", 1, "2001", "Idea", "long summary", None, None, "Kind", 8, "q", [2.0]), ("2", 1, None, "", "s", "", "", "", 1, "", [1.0]), ("3", None, None, "No vector", "s", "", "", "", 1, "", None)]
    found = I.extracted_concepts(spark.createDataFrame(rows, schema))
    n = found.nodes.collect()
    assert [(r.id, r.occurrences, r.weight, r.brief, r.month) for r in n] == [("concept:Idea", 2, 8, "long summary", "2001-01")]
    assert found.edges.where("relation = 'EXPLORES_IDEA'").first().occurrences == 2 and found.edges.count() == 5


def test_backfill_takes_the_cache_then_the_embedder(spark):
    calls = []

    def embed(texts):
        assert sum(map(len, texts)) <= 16000 or len(texts) == 1
        calls.append(texts)
        return [[float(len(t)), 0.0] for t in texts]

    nodes = [("a", "Chunk", None, "abc", None), ("b", "Concept", "Name", None, [1.0, 2.0]), ("c", "Concept", "Name", None, [1.0]), ("d", "Chunk", None, " ", None), ("e", "Book", "B", None, None), ("f", "Chunk", None, "x" * 9000, None), ("g", "Idea", "G", None, None)]
    df = spark.createDataFrame(nodes, "id string, type string, name string, text string, embedding array<double>")
    cached = spark.createDataFrame([("g", [5.0, 6.0]), ("a", [1.0])], "id string, embedding array<double>")
    got = {r.id: r.embedding for r in I.backfill_embeddings(df, embed, 2, cached).collect()}
    assert got == {"a": [3.0, 0.0], "b": [1.0, 2.0], "c": [4.0, 0.0], "d": None, "e": None, "f": [6000.0, 0.0], "g": [5.0, 6.0]}


def test_formulas_and_ideas_are_reconciled(spark):
    f = [("k", 0, "$E = m c$", "E = m c", "energy is $E = m c$", "E", "m c", ""), ("k", 1, "$z$", "z", "z", "", "", ""), ("k", 2, "$F \\le 3$", "F \\le 3", "", "", "", "Bound"), ("l", 0, "$q$", "q", "", "", "", ""), ("m", 0, "$a = b$", "a = b", "a", "a", "b", "")]
    i = [("k", 0, "claim", "see $E = m c$ there", "Theoretical Claim", ["x"]), ("k", 1, "other", "nothing", "Idea", None), ("m", 0, "so a = 3", "said", "Idea", None), ("n", 0, "free", "q", "Formula", None)]
    out = I.reconcile_formulas(spark.createDataFrame(f, "chunk string, pos int, raw string, normal string, quote string, lhs string, rhs string, label string"), spark.createDataFrame(i, "chunk string, seq int, statement string, quote string, kind string, entities array<string>"))
    got = {(r.chunk, r.seq, r.kind, r.has_formula, (r.entities or [""])[0]) for r in out.collect()}
    assert got == {("k", 0, "Theoretical Claim", True, "x"), ("k", 1, "Idea", False, ""), ("k", None, "Mathematical Formulation", True, "Bound"), ("l", None, "Mathematical Formulation", True, "Formula: q"), ("m", 0, "Mathematical Formulation", True, ""), ("n", 0, "Formula", False, "")}


def test_concept_vectors(spark):
    nodes = spark.createDataFrame([("concept:a", "Concept", None, [1.0, 0.0], "plain"), ("concept:b", "Idea", "B", [0.0, 2.0], r"\nabla x = 3"), ("concept:c", "Idea", "C", [0.0, 2.0, 1.0], ""), ("x", "Chunk", "X", [1.0, 1.0], "")], "id string, type string, name string, embedding array<double>, brief string")
    assert {r.name: list(r.vector) for r in I.concept_vectors(nodes).collect()} == {"a": [1.0, 0.0], "B": [0.0, 2.0]}
    hybrid = {r.name: list(r.vector) for r in I.concept_vectors(nodes, hybrid=True).collect()}
    assert len(hybrid["a"]) == 130 and not any(hybrid["a"][2:]) and any(hybrid["B"][2:]) and abs(sum(x * x for x in hybrid["B"]) - 1) < 1e-6


def test_strangers_are_of_other_books(spark):
    rows = [(f"{b}-{i}", b, "s", i, [float(i), 1.0]) for b in "abc" for i in range(1 + 5 * (b == "b"))]
    df = spark.createDataFrame(rows, "chunk string, book string, section string, idx int, embedding array<double>")
    got = E.strangers(df, "chunk", df, "chunk").collect()
    assert len(got) == len(rows) and all(r.a[0] != r.b[0] for r in got)
    assert sorted(map(str, E.strangers(df.repartition(5), "chunk", df.orderBy(F.desc("chunk")), "chunk").collect())) == sorted(map(str, got))
    assert E.strangers(df.where("book = 'a'"), "chunk", df.where("book = 'a'"), "chunk").count() == 0
    ideas = spark.createDataFrame([("i", "b-1", "b"), ("j", "gone", "a")], "idea string, chunk string, book string")
    pairs = E.idea_chunk_pairs(ideas, df).collect()
    assert [(r.a, r.b) for r in pairs if r.positive] == [("i", "b-1")] and sum(not r.positive for r in pairs) == 2
    named = E.idea_pairs(ideas, spark.createDataFrame([("i", "j"), ("i", "nobody")], "a string, b string")).collect()
    assert [(r.a, r.b) for r in named if r.positive] == [("i", "j")]
    assert E.idea_pairs(ideas, spark.createDataFrame([], "a string, b string")).where("positive").count() == 2


def test_gates(spark):
    base = {"coverage": 60.0, "std": 0.1, "p10": 0.55, "gap": 0.4, "efficiency": 0.02, "vendi_per_node": 0.5, "skipped_retention": 80.0, "surplus": 0.1, "leverage": 1.2}
    row = lambda **c: spark.createDataFrame([tuple((base | c).values())], list(base))
    names = ["gate_coverage", "gate_spread", "gate_gap", "gate_efficiency", "gate_skipping"]
    at = lambda **c: [M.gates(row(), row(**c)).first()[n] for n in names]
    assert at() == [True] * 5
    assert at(coverage=55.9) == [False, True, True, True, True] and at(std=0.14) == [True, False, True, True, True] and at(p10=0.4) == [True, False, True, True, True]
    assert at(gap=0.56) == [True, True, False, True, True] and at(efficiency=0.01, vendi_per_node=0.4) == [True, True, True, False, True]
    assert at(skipped_retention=74.0) == [True, True, True, True, False] and at(surplus=-0.1, leverage=0.9) == [True, True, True, True, False]


def test_small_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    w = lambda n, t: one(M.chunk_weight(F.lit(n).cast("int"), F.lit(t).cast("string")))
    assert (w(7, "abc"), w(0, "abc"), w(None, ""), w(None, None)) == (7.0, 3.0, 1.0, 1.0)
    assert one(T.plain_name(F.lit("  The Big, Idea! "))) == "the big idea"
    assert one(T.breadcrumb(F.lit("B"), F.lit("C"), F.lit("C"), F.lit(2), F.lit(3))) == "B > C [part 2.3]" and one(T.breadcrumb(F.lit("B"), F.lit("C"), F.lit("S"), F.lit(2), F.lit(3))) == "B > C > S [part 2.3]"
    assert one(T.embedding_text(F.lit("N"), F.lit("s"), F.lit("S "), F.lit("d"))) == "N: s — d" and one(T.embedding_text(F.lit("N"), F.lit(""), F.lit(None).cast("string"), F.lit(" "))) == "N"
    score = lambda name, weight, semantic=None: one(search.seed_score([("full", "big idea"), ("word", "big"), ("word", "idea")], F.lit(name), F.lit("an idea"), F.lit(""), F.lit(weight), semantic))
    assert score("The Big Idea", 2) == 15000 + 50 + 2 and score("Nothing", 1) == 25 + 1 and score("Big", 0, F.lit(True)) == 50 + 4000
    rows = spark.createDataFrame([(s, i) for s in "ab" for i in range(5)], "s string, i int")
    assert {(r.s, r.i) for r in search.cap_per_seed(rows, "s", [F.col("i")], 2, 3).collect()} == {("a", 0), ("b", 0), ("a", 1)}


def test_terms(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    t = one(T.query_terms_by_rank(F.lit('What is the "deep water" model of big Ships?')))
    assert t.full_query == '"deep water" model of big Ships' and t.word_terms == ["deep", "water", "of", "big", "Ships"] and t.phrase_terms[:2] == ["deep water\" model of big Ships", "deep water"]
    assert one(T.query_terms_by_rank(F.lit("  "))).phrase_terms == []
    note = "See **Alpha Beta** and **Example** \"Quoted term\"\n- Item one: text\n* [[Wiki link]] - more\n• http\n- x"
    assert one(T.candidate_terms(F.lit(note), F.lit("about the wiki and beta"))) == ["Alpha Beta", "Wiki link", "Quoted term", "Item one", "http"]


def test_running_sums_and_numbers(spark):
    rows = [(i % 7, None if i % 11 == 0 else i) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(6)
    got = ranges.numbered(df.where("v is not null").withColumn("o", F.col("v")), ["o"], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.v)] == list(range(1, 1 + sum(v is not None for _, v in rows)))
    at, want = 0, {}
    for v in sorted(x for _, x in rows if x is not None):
        want[v], at = at, at + v
    assert {r.v: r.s for r in ranges.running(df.where("v is not null"), ["v"], {"s": F.col("v")}).collect()} == want
    rank = {r.v: r.p for r in ranges.percentile_rank(df, "v", "p").collect()}
    known = [v for _, v in rows if v is not None]
    assert rank[None] is None and all(abs(rank[v] - sum(x <= v for x in known) / len(known)) < 1e-12 for v in known)
    assert ranges.numbered(df.limit(0), ["v"], "n").count() == 0


def test_a_common_word_in_titles_joins_no_pairs(spark, tmp_path):
    from itertools import product

    rng = np.random.default_rng(6)
    words = ["customer", "custom", "merchant", "book", "x1", "second", "edition", "12345678"]
    asked = [(i, " ".join(rng.choice(words, rng.integers(1, 5)))) for i in range(120)] + [(200 + i, f"customer number {i:04}") for i in range(300)]
    files = [(f"f{i:03}", " ".join(rng.choice(words, rng.integers(1, 6)))) for i in range(80)] + [(f"g{i:03}", f"Customer Number {i:04} second") for i in range(0, 300, 2)]
    plain = lambda t: t.lower().replace(" ", "")
    want = {}
    for (k, t), (f, u) in product(asked, files):
        x, y = plain(t), plain(u)
        if x == y or min(len(x), len(y)) >= 8 and (x in y or y in x):
            want[k] = min(want.get(k, (9,)), (3 if x == y else 4, 0 if x == y else abs(len(x) - len(y)), f))
    a = spark.createDataFrame([(k, t, None, None, None) for k, t in asked], "asked_id long, title string, filename string, book_key string, breadcrumb string")
    b = spark.createDataFrame([(f, u, None) for f, u in files], "file string, title string, key string")
    out = S.resolve_book_files(a, b)
    out.write.parquet(f"{tmp_path}/out")
    assert {r.asked_id: r.file for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {k: v[2] for k, v in want.items()}
    titles = [b.select(F.regexp_replace(F.lower("title"), "[^a-z0-9]", "").alias("_t")), a.select(F.regexp_replace(F.lower("title"), "[^a-z0-9]", "").alias("_t"))]
    assert S.parts_of(*titles).count() < 2000
