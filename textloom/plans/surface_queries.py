"""Queries on what users ask of a graph, on concept resolution, integration and evaluation: parts are concepts, orders books, suppliers sections, documents chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import evaluation as E
from textloom.operators import integration as I
from textloom.operators import resolution as R
from textloom.operators import surface as S
from textloom.plans.catalog import query
from textloom.plans.graph_queries import _GRAPH, _edges
from textloom.plans.metric_queries import _SIMS, HIGH, LOW, TAU, _sets
from textloom.sources.tables import table


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of the graph with their names."""
    p, o, s = table(spark, sf, "part"), table(spark, sf, "orders"), table(spark, sf, "supplier")
    n = lambda df, kind, key, name, w: df.select(F.concat(F.lit(f"{kind.lower()}:"), key).alias("id"), F.lit(kind).alias("type"), F.col(name).cast("string").alias("name"), F.expr(w).cast("double").alias("weight"))
    return n(p, "Concept", "p_partkey", "p_name", "p_size").union(n(o, "Book", "o_orderkey", "o_orderkey", "1")).union(n(s, "Section", "s_suppkey", "s_name", "1"))


_NAMED = "named AS (SELECT 'concept:' || p_partkey AS id, 'Concept' AS type, p_name AS name, p_size::DOUBLE AS weight FROM part UNION ALL SELECT 'book:' || o_orderkey, 'Book', o_orderkey::VARCHAR, 1 FROM orders UNION ALL SELECT 'section:' || s_suppkey, 'Section', s_name, 1 FROM supplier)"
_NEAR = "near AS (SELECT src AS seed, dst AS id, relation, true AS outgoing FROM edges UNION SELECT dst, src, relation, false FROM edges)"


@query(f"""
WITH {_GRAPH}, {_NAMED}, {_NEAR}, k AS (SELECT seed, n.id, relation, outgoing, n.type, n.weight FROM near JOIN named n USING (id) WHERE seed IN (SELECT 'concept:' || p_partkey FROM part WHERE p_partkey % 100 = 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY CASE type WHEN 'Concept' THEN 1 WHEN 'Book' THEN 2 WHEN 'Section' THEN 3 ELSE 5 END, weight DESC, id, relation, outgoing) AS place FROM k) SELECT seed, id, relation, outgoing, type, weight, place FROM r WHERE place <= 25
""")
def expand_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """The first 25 relations of each query node (parts of keys divisible by 100): the view's limit."""
    seeds = table(spark, sf, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("concept:"), F.col("p_partkey")).alias("id"))
    return S.expand(_named(spark, sf), _edges(spark, sf), seeds, "all", 25)


@query(f"WITH {_GRAPH}, {_NAMED}, {_NEAR} SELECT seed, n.id, relation, outgoing, n.type, n.weight FROM near JOIN named n USING (id) WHERE n.type = 'Concept' AND seed IN (SELECT 'section:' || s_suppkey FROM supplier WHERE s_suppkey % 100 = 0)")
def expand_typed(spark: SparkSession, sf: str) -> DataFrame:
    """All concepts around each query node (suppliers of keys divisible by 100)."""
    seeds = table(spark, sf, "supplier").where("s_suppkey % 100 = 0").select(F.concat(F.lit("section:"), F.col("s_suppkey")).alias("id"))
    return S.expand(_named(spark, sf), _edges(spark, sf), seeds, "Concept", None)


@query(f"""
WITH {_GRAPH}, {_NAMED}, {_NEAR}, asked AS (SELECT DISTINCT upper(p_name) AS asked FROM part), t AS (SELECT asked, arg_min(id, (-weight, id)) AS id FROM asked JOIN named ON lower(asked) = lower(name) GROUP BY asked),
d AS (SELECT asked, t.id, CASE n.type WHEN 'Book' THEN 'books' WHEN 'Concept' THEN 'ideas' ELSE 'evidence' END AS part, n.id AS other FROM t JOIN near ON seed = t.id JOIN named n ON n.id = near.id) SELECT asked, id, part, count(DISTINCT other) AS n FROM d GROUP BY 1, 2, 3
""")
def node_details(spark: SparkSession, sf: str) -> DataFrame:
    """What the page of each name shows, by part; names are asked for in capitals."""
    asked = table(spark, sf, "part").select(F.upper("p_name").alias("asked")).distinct()
    out = S.node_details(_named(spark, sf), _edges(spark, sf), asked)
    return out.groupBy("asked", "id", "part").agg(F.count("*").alias("n"))


@query(f"""
WITH {_GRAPH}, {_NAMED}, {_NEAR}, i AS (SELECT seed AS chunk, name, min(n.id) AS id FROM near JOIN named n USING (id) WHERE n.type = 'Concept' AND starts_with(seed, 'section:') GROUP BY 1, 2) SELECT chunk, i.id, i.name, 'Idea' AS category, n.weight FROM i JOIN named n USING (id)
""")
def chunk_ideas(spark: SparkSession, sf: str) -> DataFrame:
    """Ideas of each section, each name once."""
    chunks = table(spark, sf, "supplier").select(F.concat(F.lit("section:"), F.col("s_suppkey")).alias("id"))
    return S.ideas_for_chunks(_named(spark, sf), _edges(spark, sf), chunks).select("chunk", "id", "name", "category", "weight")


@query("""
WITH c AS (SELECT 'chunk:' || d.doc_id AS id, CASE WHEN quality = 0 THEN 'SKIP' WHEN quality = 1 THEN 'retain' END AS state FROM documents d LEFT JOIN labels USING (doc_id)), s AS (SELECT bool_or(coalesce(state = 'SKIP', false)) AS skips FROM c), h AS (SELECT DISTINCT 'chunk:' || l_partkey AS id FROM lineitem)
SELECT id FROM c, s WHERE CASE WHEN skips THEN coalesce(state = 'retain', false) ELSE id IN (SELECT id FROM h) END
""")
def parent_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    nodes = d.select(F.concat(F.lit("chunk:"), F.col("doc_id")).alias("id"), F.lit("Chunk").alias("type"), F.when(F.col("quality") == 0, "SKIP").when(F.col("quality") == 1, "retain").alias("filter_state"))
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("concept:"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("chunk:"), F.col("l_partkey")).alias("dst"), F.lit("SUPPORTED_BY").alias("relation"))
    return S.parent_chunks(nodes, edges)


@query("WITH h AS (SELECT DISTINCT 'chunk:' || l_partkey AS id FROM lineitem WHERE l_partkey IN (SELECT doc_id FROM documents)) SELECT id FROM h UNION SELECT 'chunk:' || doc_id FROM documents WHERE doc_id % 9 = 0")
def supporting_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """As parent_chunk_ids where nothing was skipped: chunks with a supporting edge or a mark."""
    nodes = table(spark, sf, "documents").select(F.concat(F.lit("chunk:"), F.col("doc_id")).alias("id"), F.lit("Chunk").alias("type"), (F.col("doc_id") % 9 == 0).alias("is_parent"))
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("chunk:"), F.col("l_partkey")).alias("src"), F.concat(F.lit("concept:"), F.col("l_suppkey")).alias("dst"), F.lit("SUPPORTS_IDEA").alias("relation"))
    return S.parent_chunks(nodes, edges)


def _ideas(spark: SparkSession, sf: str) -> DataFrame:
    """Concept nodes with a vector where there is one of their number."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding")
    return table(spark, sf, "part").join(e, "p_partkey", "left").select(F.concat(F.lit("concept:"), F.col("p_partkey")).alias("id"), F.lit("Concept").alias("type"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("weight"), "embedding", F.col("p_partkey").alias("key"))


@query(f"""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1), c AS (SELECT 'concept:' || p_partkey AS id, p_name AS name, p_size::DOUBLE AS weight, CASE WHEN lower(p_name) = 'small ring' THEN 1.0 WHEN starts_with(lower(p_name), 'small ring') THEN 0.95 WHEN contains(lower(p_name), 'small ring') THEN 0.9 END::DOUBLE AS cosine FROM part
UNION ALL SELECT 'concept:' || vec_id, p_name, p_size, list_cosine_similarity(embedding::DOUBLE[], v) FROM embeddings JOIN part ON p_partkey = vec_id, q WHERE list_cosine_similarity(embedding::DOUBLE[], v) >= {LOW}), b AS (SELECT id, any_value(name) AS name, max(cosine) AS cosine, round(max(cosine) * any_value(weight), 4) AS priority_score FROM c WHERE cosine IS NOT NULL GROUP BY id)
SELECT id, name, round(cosine, 6) AS cosine, priority_score FROM b ORDER BY priority_score DESC, id LIMIT 6
""")
def idea_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The six seeds of a search by name and vector."""
    v = table(spark, sf, "embeddings").where("vec_id = 1").first()["embedding"]
    return S.seed_ideas(_ideas(spark, sf), "small ring", v, LOW).select("id", "name", F.round("cosine", 6).alias("cosine"), "priority_score")


@query(f"""
WITH {_GRAPH}, {_NAMED}, {_NEAR}, s AS (SELECT id, round(weight, 4) AS p FROM named WHERE type = 'Concept' AND lower(name) = 'small ring' ORDER BY p DESC, id LIMIT 6),
k AS (SELECT seed, n.id, relation, outgoing, p, n.weight, CASE n.type WHEN 'Concept' THEN 1 WHEN 'Book' THEN 2 WHEN 'Section' THEN 3 ELSE 5 END AS pr FROM s JOIN near ON seed = s.id JOIN named n ON n.id = near.id), r AS (SELECT * FROM k ORDER BY p DESC, pr, weight DESC, seed, id, relation LIMIT 60)
SELECT CASE WHEN outgoing THEN seed ELSE id END AS src, CASE WHEN outgoing THEN id ELSE seed END AS dst, relation FROM r
""")
def graph_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 60 relations around the seeds of a search: the view's limit."""
    return S.query_ideas(_named(spark, sf), _edges(spark, sf), "small ring", limit=60).edges


@query("""
WITH i AS (SELECT p_partkey AS id, p_name AS name, p_brand AS category, p_size AS weight, strftime(min(l_shipdate), '%Y-%m') AS month, count(l_partkey) AS occurrences FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4), f AS (SELECT *, CASE WHEN lower(name) = 'hot ring' THEN 100.0 WHEN starts_with(lower(name), 'hot ring') THEN 85 WHEN contains(lower(name), 'hot ring') THEN 75 WHEN contains(lower(category), 'hot ring') THEN 60 END AS match_score FROM i)
SELECT id, name, weight, month, occurrences, match_score::DOUBLE AS match_score FROM f WHERE match_score IS NOT NULL AND month BETWEEN '1992-02' AND '1994-12' ORDER BY weight DESC, occurrences DESC, month DESC, id LIMIT 500
""")
def idea_list(spark: SparkSession, sf: str) -> DataFrame:
    """Ideas named hot ring first seen within some months, heaviest first."""
    seen = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM").alias("month"), F.count("*").alias("occurrences"))
    nodes = table(spark, sf, "part").join(seen, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("id"), F.lit("Concept").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.lit("").alias("summary"), F.lit("").alias("detail"), F.col("p_size").alias("weight"), "month", F.coalesce("occurrences", F.lit(0)).alias("occurrences"))
    return S.list_ideas(nodes, "hot ring", "1992-02", "1994-12", "weight_desc").select("id", "name", "weight", "month", "occurrences", "match_score")


@query("""
WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'Sample' ELSE c_name END AS title, CASE WHEN c_custkey % 3 = 0 THEN '/books/f' || c_custkey || '.PDF' END AS filename, CASE WHEN c_custkey % 7 = 0 THEN 'book:' || c_custkey END AS k FROM customer),
f AS (SELECT 'lib/f' || c_custkey || '.pdf' AS file, 'Customer-' || lpad(c_custkey::VARCHAR, 9, '0') || CASE WHEN c_custkey % 2 = 0 THEN ' second edition' ELSE '' END AS title, c_custkey::VARCHAR AS key FROM customer WHERE c_custkey % 4 <> 3),
n AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS t FROM a), m AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS t FROM f),
h AS (SELECT n.id, m.file, CASE WHEN lower(split_part(n.filename, '/', 3)) = lower(split_part(m.file, '/', 2)) THEN 1 WHEN replace(n.k, 'book:', '') = m.key THEN 2 WHEN n.t = m.t THEN 3 ELSE 4 END AS tier, abs(length(n.t) - length(m.t)) AS gap FROM n, m WHERE coalesce(lower(split_part(n.filename, '/', 3)) = lower(split_part(m.file, '/', 2)), false) OR coalesce(replace(n.k, 'book:', '') = m.key, false) OR n.t NOT IN ('', 'sample') AND (n.t = m.t OR length(n.t) >= 8 AND length(m.t) >= 8 AND (contains(n.t, m.t) OR contains(m.t, n.t))))
SELECT id AS asked_id, arg_min(file, (tier, CASE WHEN tier = 4 THEN gap ELSE 0 END, file)) AS file FROM h GROUP BY id
""")
def book_files(spark: SparkSession, sf: str) -> DataFrame:
    """The file of each customer's book: by file name, key, title, or a title inside another."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    asked = c.select(k.alias("asked_id"), F.when(k % 5 == 0, "Sample").otherwise(F.col("c_name")).alias("title"), F.when(k % 3 == 0, F.concat(F.lit("/books/f"), k, F.lit(".PDF"))).alias("filename"), F.when(k % 7 == 0, F.concat(F.lit("book:"), k)).alias("book_key"), F.lit(None).cast("string").alias("breadcrumb"))
    files = c.where("c_custkey % 4 <> 3").select(F.concat(F.lit("lib/f"), k, F.lit(".pdf")).alias("file"), F.concat(F.lit("Customer-"), F.lpad(k.cast("string"), 9, "0"), F.when(k % 2 == 0, " second edition").otherwise("")).alias("title"), k.cast("string").alias("key"))
    return S.resolve_book_files(asked, files)


_LEX = r"""
t AS (SELECT *, list_distinct(list_filter(regexp_extract_all(x, '[a-z0-9]+'), lambda w: w NOT IN ('the', 'a', 'an', 'and', 'or', 'of', 'in', 'to', 'for', 'with', 'on', 'at', 'by', 'from', 'as', 'is', 'are'))) AS s, list_distinct(list_filter(regexp_extract_all(y, '[a-z0-9]+'), lambda w: w NOT IN ('the', 'a', 'an', 'and', 'or', 'of', 'in', 'to', 'for', 'with', 'on', 'at', 'by', 'from', 'as', 'is', 'are'))) AS t FROM p),
u AS (SELECT *, list_distinct(list_transform(s, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ing' THEN left(w, length(w) - 3) WHEN length(w) > 3 AND w LIKE '%es' THEN left(w, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END)) AS u, list_distinct(list_transform(t, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ing' THEN left(w, length(w) - 3) WHEN length(w) > 3 AND w LIKE '%es' THEN left(w, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END)) AS v FROM t),
j AS (SELECT *, len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))) AS jac FROM u)
SELECT a, b, CASE WHEN x = y OR len(s) > 0 AND (list_sort(s) = list_sort(t) OR list_sort(u) = list_sort(v)) OR x || 's' = y OR y || 's' = x OR x || 'es' = y OR y || 'es' = x THEN true
  WHEN list_contains(s, 'static') AND list_contains(t, 'dynamic') OR list_contains(t, 'static') AND list_contains(s, 'dynamic') OR list_contains(s, 'linear') AND list_contains(t, 'nonlinear') OR list_contains(t, 'linear') AND list_contains(s, 'nonlinear') THEN false
  WHEN sim >= 0.93 AND jac >= 0.7 THEN true WHEN sim < 0.83 AND jac < 0.2 THEN false END AS same FROM j
"""


@query(rf"""
WITH w AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' WHEN 2 THEN 'the ' || split_part(p_name, ' ', 2) || ' of ' || split_part(p_name, ' ', 1) WHEN 3 THEN 'static ' || p_name WHEN 4 THEN 'dynamic ' || p_name ELSE p_name || ' linking boxes core' END AS name FROM part), n AS (SELECT a.k AS a, b.k AS b, lower(trim(a.name)) AS x, lower(trim(b.name)) AS y, CASE (a.k // 6 + b.k) % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.81 WHEN 2 THEN 0.9 ELSE 0.83 END AS sim FROM w a JOIN w b ON b.k // 6 = a.k // 6 AND a.k < b.k), p AS (SELECT * FROM n), {_LEX}
""")
def lexical_disambiguation(spark: SparkSession, sf: str) -> DataFrame:
    """Whether names decide that two concepts are one: each part's name as it is, in the plural, turned round, made static, dynamic or longer, against the others of six parts, at four similarities."""
    from textloom.functions import text as T

    k, n = F.col("p_partkey"), F.col("p_name")
    two = F.split(n, " ")
    name = F.when(k % 6 == 0, n).when(k % 6 == 1, F.concat(n, F.lit("s"))).when(k % 6 == 2, F.concat(F.lit("the "), two[1], F.lit(" of "), two[0])).when(k % 6 == 3, F.concat(F.lit("static "), n)).when(k % 6 == 4, F.concat(F.lit("dynamic "), n)).otherwise(F.concat(n, F.lit(" linking boxes core")))
    w = table(spark, sf, "part").select(k.alias("a"), name.alias("x"), F.floor(k / 6).alias("g"))
    pairs = w.join(w.select(F.col("a").alias("b"), F.col("x").alias("y"), "g"), "g").where("a < b")
    sim = F.element_at(F.array(*map(F.lit, (0.95, 0.81, 0.9, 0.83))), ((F.col("g") + F.col("b")) % 4 + 1).cast("int"))
    return pairs.select("a", "b", T.same_concept(F.col("x"), F.col("y"), sim).alias("same"))


@query(r"""
WITH c AS (SELECT vec_id AS k, p_name AS name, CASE WHEN vec_id % 4 = 0 THEN 'Mathematical Formulation' WHEN vec_id % 4 = 1 THEN 'Empirical Finding' ELSE 'Idea' END AS cat, 'q' || vec_id % 3 AS quote, embedding::DOUBLE[] AS v FROM embeddings JOIN part ON p_partkey = vec_id), p AS (SELECT a.k AS a, b.k AS b, lower(a.name) = lower(b.name) AS eq, a.cat AS ac, b.cat AS bc, a.quote AS aq, b.quote AS bq, list_cosine_similarity(a.v, b.v) AS sim FROM c a JOIN c b ON b.k // 8 = a.k // 8 AND a.k < b.k)
SELECT a, b, CASE WHEN eq AND ac = 'Mathematical Formulation' AND bc = 'Mathematical Formulation' AND aq <> bq THEN 'distinct_formula_guard' WHEN eq AND ac <> bc AND ac <> 'Idea' AND bc <> 'Idea' THEN 'distinct_category_guard' WHEN eq THEN 'exact' WHEN sim >= 0.35 THEN 'high_vector' WHEN sim >= 0.2 THEN 'band' ELSE 'none' END AS method FROM p
""")
def same_concept_bands(spark: SparkSession, sf: str) -> DataFrame:
    """How pairs of concepts are told: by name, guards, or the bands of similarity (0.2 and 0.35 here); what names decide inside the band is lexical_disambiguation's."""
    k = F.col("vec_id")
    c = table(spark, sf, "embeddings").join(table(spark, sf, "part"), k == F.col("p_partkey")).select(k.alias("a"), F.floor(k / 8).alias("g"), F.struct(F.col("p_name").alias("name"), F.when(k % 4 == 0, "Mathematical Formulation").when(k % 4 == 1, "Empirical Finding").otherwise("Idea").alias("category"), F.concat(F.lit("q"), k % 3).alias("quote"), "embedding").alias("x"))
    pairs = c.join(c.select(F.col("a").alias("b"), "g", F.col("x").alias("y")), "g").where("a < b")
    side = lambda s: {n: F.col(f"{s}.{n}") for n in ("name", "category", "quote", "embedding")}
    method = R.same_concept(side("x"), side("y"), 0.2, 0.35)["method"]
    return pairs.select("a", "b", F.when(method.isin("lexical", "open"), "band").otherwise(method).alias("method"))


@query()
def resolved_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts resolved against known ones (ids divisible by 10) and one another, in order: by name, vector and verdict."""
    rows = _ideas(spark, sf).select(F.col("key").alias("id"), F.concat_ws(" ", "name", F.col("key") % 40).alias("name"), "embedding")
    return R.resolve(rows.where("id % 10 <> 0"), rows.where("id % 10 = 0"), 0.3, 0.4).select("id", "canonical", "method", F.round("similarity", 6).alias("similarity"))


_POST = """
c AS (SELECT 'part:' || p_partkey AS id, p_name AS name, lower(p_name) AS n FROM part), s AS (SELECT DISTINCT 'part:' || l_partkey AS id, 'chunk:' || l_suppkey AS chunk FROM lineitem), k AS (SELECT id, count(*) AS k FROM s GROUP BY id),
g AS (SELECT n, count(DISTINCT name) AS names, count(DISTINCT c.id) AS ids, greatest(sum(coalesce(k, 1)), (SELECT count(DISTINCT chunk) FROM s JOIN c c2 ON s.id = c2.id WHERE c2.n = c.n)) AS occ FROM c LEFT JOIN k USING (id) GROUP BY n)
"""


def _concept_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lit("Concept").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("brief"), F.col("p_type").alias("detail"), F.col("p_size").alias("weight"), F.lit(None).cast("string").alias("month"), F.lit(None).cast("array<float>").alias("embedding"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("chunk:"), "s_suppkey").alias("id"), F.lit("Chunk").alias("type"))
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("src"), F.concat(F.lit("chunk:"), "l_suppkey").alias("dst"), F.lit("SUPPORTED_BY").alias("relation")).distinct()
    return p.unionByName(s, allowMissingColumns=True), edges


@query(f"WITH {_POST} SELECT sum(names)::BIGINT AS concepts, count(*) AS clusters, count(*) FILTER (occ >= 2) AS multi, count(*) FILTER (occ < 2) AS single, count(*) AS affected, sum(names)::BIGINT - count(*) AS merged FROM g")
def postprocess_report(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _concept_graph(spark, sf)
    return R.postprocess(nodes, edges).report()


@query(f"WITH {_POST}, m AS (SELECT n, min(name) AS canonical FROM c GROUP BY n) SELECT 'concept:' || canonical AS id, g.occ::BIGINT AS occurrences, (SELECT max(p_size) FROM part WHERE lower(p_name) = g.n) AS weight, (SELECT count(DISTINCT chunk) FROM s JOIN c ON s.id = c.id WHERE c.n = g.n) AS chunks FROM g JOIN m USING (n)")
def postprocessed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical concepts after postprocessing, with the chunks that support them."""
    nodes, edges = _concept_graph(spark, sf)
    out = R.postprocess(nodes, edges)
    links = out.edges.where("relation = 'SUPPORTED_BY'").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("chunks"))
    return out.nodes.where("type = 'Concept'").join(links, "id", "left").select("id", "occurrences", "weight", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query(f"""
WITH {_SIMS}, b AS (SELECT p.vec_id, min(idea_id) AS idea FROM pairs p JOIN sims s ON s.vec_id = p.vec_id AND p.sim = s.max_sim GROUP BY 1), h AS (SELECT s.vec_id, 'idea ' || idea AS idea, s.vec_id % 7 AS book FROM sims s JOIN b USING (vec_id) WHERE max_sim >= {HIGH})
SELECT relation, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM (SELECT 'SUPPORTED_BY' AS relation, 'concept:' || idea AS src, 'chunk:' || vec_id AS dst FROM h UNION ALL SELECT 'SUPPORTS_IDEA', 'chunk:' || vec_id, 'concept:' || idea FROM h UNION ALL SELECT DISTINCT 'EXPLORES_IDEA', 'book:' || book, 'concept:' || idea FROM h) GROUP BY 1
""")
def integrated_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that high-confidence chunks add, by relation."""
    from textloom.operators import similarity

    chunks, ideas = _sets(spark, sf)
    routed = similarity.route(chunks, ideas, LOW, HIGH).select(F.col("vec_id").alias("chunk_id"), F.lit("some text").alias("text"), (F.col("vec_id") % 7).alias("book_id"), F.lit("2001-02-03").alias("publication_date"), "tier", F.concat(F.lit("idea "), F.col("best_id")).alias("idea"), F.lit("").alias("summary"))
    return I.high_confidence(routed).edges.groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("""
WITH r AS (SELECT l_orderkey AS chunk, p_name AS name, p_size AS weight, p_type AS brief, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem JOIN part ON l_partkey = p_partkey JOIN embeddings ON vec_id = p_partkey)
SELECT 'concept:' || name AS id, count(*) AS occurrences, max(weight) AS weight, max(length(brief)) AS brief_chars, min(month) AS month FROM r GROUP BY name
""")
def integrated_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Concept nodes from extracted ideas: every mention of a part that has a vector."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    rows = l.join(_ideas(spark, sf).select(F.col("key").alias("l_partkey"), "embedding"), "l_partkey").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").alias("book_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("publication_date"), F.col("p_name").alias("name"), F.lit("").alias("summary"), F.col("p_type").alias("brief"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("string").alias("category"), F.col("p_size").alias("weight"), F.lit("").alias("quote"), "embedding")
    return I.extracted_concepts(found).nodes.select("id", "occurrences", "weight", F.length("brief").cast("long").alias("brief_chars"), "month")


def _toy_vectors(texts: list[str]):
    """An embedder that SQL can follow: length, spaces and e's."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts]


@query(r"""
WITH n AS (SELECT doc_id, trim(text, ' ') AS t, doc_id % 3 AS k FROM documents), m AS (SELECT *, left(t, 6000) AS c FROM n)
SELECT doc_id, CASE WHEN k = 0 THEN 1.0 WHEN k = 1 THEN 7.0 WHEN c <> '' THEN length(c) END AS first, CASE WHEN k = 0 THEN 2.0 WHEN k = 1 THEN 8.0 WHEN c <> '' THEN length(c) - length(replace(c, ' ', '')) END AS second, CASE WHEN k = 0 THEN 3.0 WHEN k = 1 THEN 9.0 WHEN c <> '' THEN length(c) - length(replace(c, 'e', '')) END AS third FROM m
""")
def backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors filled in: a third of the documents have one, a third find theirs in the cache, the rest are embedded, at most 6,000 characters of each."""
    d = table(spark, sf, "documents")
    vec = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    nodes = d.select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.lit("Chunk").alias("type"), "text", F.when(F.col("doc_id") % 3 == 0, vec(1, 2, 3)).when(F.col("doc_id") % 3 == 1, vec(5, 5)).alias("embedding"))
    cached = d.where("doc_id % 3 = 1").select(F.col("doc_id").cast("string").alias("id"), vec(7, 8, 9).alias("embedding"))
    out = I.backfill_embeddings(nodes, _toy_vectors, 3, cached)
    return out.select("doc_id", *(F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(("first", "second", "third"))))


@query("""
WITH a AS (SELECT o_custkey AS book_id, o_orderkey AS seq, 'Book ' || o_orderpriority || CASE WHEN o_orderkey % 9 = 0 THEN ' 1234.56789' ELSE '' END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'Unknown' ELSE 'A' || o_orderkey END AS author, repeat('s', (o_orderkey % 11)::INT) AS summary, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT book_id, arg_max(title, seq) AS title, coalesce(arg_max(author, seq) FILTER (author <> 'Unknown'), 'Unknown') AS author, length(arg_max(summary, (length(summary), -seq))) AS summary_chars, arg_max(d, seq) AS publication_date, max(CASE WHEN contains(title, '1234.56789') THEN '1234.56789' END) AS arxiv_id FROM a GROUP BY book_id
""")
def added_books(spark: SparkSession, sf: str) -> DataFrame:
    """Books after a series of additions."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    new = o.select(F.col("o_custkey").alias("book_id"), k.alias("seq"), F.concat(F.lit("Book "), "o_orderpriority", F.when(k % 9 == 0, " 1234.56789").otherwise("")).alias("title"), F.when(k % 3 == 0, "Unknown").otherwise(F.concat(F.lit("A"), k)).alias("author"), F.repeat(F.lit("s"), (k % 11).cast("int")).alias("summary"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"), F.lit("").alias("arxiv_id"))
    old = new.drop("seq").limit(0)
    return I.add_books(old, new).select("book_id", "title", "author", F.length("summary").cast("long").alias("summary_chars"), "publication_date", "arxiv_id")


@query("SELECT lower(p_name) AS name, CASE WHEN l_linenumber % 2 = 0 THEN 100.0 ELSE length(p_type) END::DOUBLE AS weight, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE lower(p_name) IN (SELECT lower(p_name) FROM part JOIN embeddings ON vec_id = p_partkey) GROUP BY 1, 2")
def corpus_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted ideas with a vector by name, weighted by their quotes."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.upper("p_name").alias("name"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("p_type")).alias("quote"))
    vectors = _ideas(spark, sf).where("embedding is not null").select("name", F.col("embedding").alias("vector"))
    return I.corpus_vectors(rows, vectors).groupBy("name", "weight").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT conv_id || '-' || turn || '-' || md5(text) AS chunk, conv_id AS book, role AS section, turn AS idx, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id || '-' || turn || '-' || md5(text)) AS r, turn % 2 AS idea FROM conversations)
SELECT a.chunk AS a, b.chunk AS b FROM c a JOIN c b ON a.book = b.book AND b.r = a.r + 1 AND a.section = b.section AND abs(b.idx - a.idx) = 1 UNION SELECT a.chunk, b.chunk FROM c a JOIN c b ON a.book = b.book AND b.r = a.r + 2 AND a.idea = b.idea
""")
def chunk_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of turns that should be alike: neighbours of one role, or two apart with an idea in common."""
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn", F.md5(F.col("text").cast("binary"))).alias("chunk"), F.col("conv_id").alias("book"), F.col("role").alias("section"), F.col("turn").alias("idx"))
    return E.chunk_pairs(c, c.select("chunk", (F.col("idx") % 2).alias("idea"))).where("positive").select("a", "b")


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings), s AS (SELECT true AS pos, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.label = b.label AND b.r = a.r + 1 UNION ALL SELECT false, list_cosine_similarity(a.v, b.v) FROM e a JOIN e b ON a.r = b.r AND b.label = a.label + 1), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM s),
o AS (SELECT count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n, avg(s) FILTER (pos) AS pm, avg(s) FILTER (NOT pos) AS nm, stddev_pop(s) FILTER (pos) AS ps, stddev_pop(s) FILTER (NOT pos) AS ns, quantile_cont(s, 0.5) FILTER (pos) AS p5, quantile_cont(s, 0.5) FILTER (NOT pos) AS n5, max(s) - min(s) AS span, sum(k) FILTER (pos) AS ks FROM r)
SELECT p AS num_positive, n AS num_negative, round(pm, 6) AS positive_mean, round(nm, 6) AS negative_mean, round(ps, 6) AS positive_std, round(ns, 6) AS negative_std, round(p5, 6) AS positive_p50, round(n5, 6) AS negative_p50, round(span, 6) AS span, round(pm - nm, 6) AS margin, round((pm - nm) / greatest(1e-6, 1 - nm), 6) AS aligned_positive_mean, round(0.0, 6) AS aligned_negative_mean, round((ks - p * (p + 1) / 2.0) / (p * n), 6) AS auc FROM o
""")
def pair_report(spark: SparkSession, sf: str) -> DataFrame:
    """How well vectors tell neighbours of a label from vectors of the next one."""
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    x, y = e.select(F.col("vec_id").alias("a"), "label", "r"), e.select(F.col("vec_id").alias("b"), F.col("label").alias("l2"), F.col("r").alias("r2"))
    same = x.join(y, (F.col("label") == F.col("l2")) & (F.col("r2") == F.col("r") + 1)).select("a", "b", F.lit(True).alias("positive"))
    other = x.join(y, (F.col("r") == F.col("r2")) & (F.col("l2") == F.col("label") + 1)).select("a", "b", F.lit(False).alias("positive"))
    ids = e.select(F.col("vec_id").alias("id"), "embedding")
    one = E.pair_report(E.pair_similarity(same.unionByName(other), ids, ids))
    return one.select("num_positive", "num_negative", *(F.round(c, 6).alias(c) for c in one.columns if not c.startswith("num_")))


@query(f"""
WITH {_SIMS}, o AS (SELECT 100 * sum(CASE WHEN max_sim >= {TAU} THEN weight ELSE 0 END) / sum(weight) AS coverage, sum(weight * max_sim) / sum(weight) AS chamfer, 1 - min(max_sim) AS gap, count(*) AS chunks, sum(CASE WHEN vec_id % 3 <> 0 THEN weight ELSE 0 END) / sum(weight) AS rho, 100 * sum(CASE WHEN vec_id % 3 = 0 AND max_sim >= {TAU} THEN weight ELSE 0 END) / sum(CASE WHEN vec_id % 3 = 0 THEN weight ELSE 0 END) AS skipped_retention FROM sims), n AS (SELECT count(*) AS ideas FROM embeddings WHERE vec_id % 10 = 0),
w AS (SELECT max_sim, sum(weight) OVER (ORDER BY max_sim ROWS UNBOUNDED PRECEDING) AS cw, sum(weight) OVER () AS tw FROM sims), q AS (SELECT min(max_sim) FILTER (cw >= 0.1 * tw - 1e-9) AS p10, min(max_sim) FILTER (cw >= 0.5 * tw - 1e-9) AS p50 FROM w)
SELECT round(chamfer, 6) AS chamfer, round(coverage, 6) AS coverage, round(gap, 6) AS gap, round(p10, 6) AS p10, round(p50, 6) AS p50, chunks, ideas, round(coverage / ideas, 6) AS efficiency, round(rho, 6) AS rho, round(skipped_retention, 6) AS skipped_retention FROM o, n, q
""")
def space_report(spark: SparkSession, sf: str) -> DataFrame:
    """One report on how ideas cover chunks; the diversity by eigenvalues, which SQL lacks, is vendi's."""
    chunks, ideas = _sets(spark, sf)
    one = E.space_report(chunks, ideas, F.col("vec_id") % 3 != 0, TAU)
    return one.select(*(F.round(c, 6).alias(c) for c in ("chamfer", "coverage", "gap", "p10", "p50")), F.col("chunks").cast("long").alias("chunks"), F.col("ideas").cast("long").alias("ideas"), *(F.round(c, 6).alias(c) for c in ("efficiency", "rho", "skipped_retention")))
