"""Queries on graphs and ledgers: an order is a book, a part a concept, a lineitem a mention, a supplier a section; events are a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import graph as G
from textloom.operators import ledger as L
from textloom.operators import search
from textloom.plans.catalog import query
from textloom.sources.tables import table


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda t, key, kind, w: table(spark, sf, t).select(F.concat(F.lit(f"{kind.lower()}:"), F.col(key)).alias("id"), F.lit(kind).alias("type"), F.expr(w).cast("double").alias("weight"))
    return n("orders", "o_orderkey", "Book", "1").union(n("part", "p_partkey", "Concept", "p_size")).union(n("supplier", "s_suppkey", "Section", "1"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    e = lambda a, b, r: l.select(a.alias("src"), b.alias("dst"), F.lit(r).alias("relation"), F.col("l_linenumber").alias("seq"))
    book, concept, section = (F.concat(F.lit(f"{k}:"), F.col(c)) for k, c in (("book", "l_orderkey"), ("concept", "l_partkey"), ("section", "l_suppkey")))
    return e(book, concept, "EXPLORES_IDEA").union(e(section, concept, "DISCUSSES")).union(e(book, section, "HAS_SECTION"))


_GRAPH = """
nodes AS (SELECT 'book:' || o_orderkey AS id, 'Book' AS type, 1.0::DOUBLE AS weight FROM orders UNION ALL SELECT 'concept:' || p_partkey, 'Concept', p_size FROM part UNION ALL SELECT 'section:' || s_suppkey, 'Section', 1 FROM supplier),
raw AS (SELECT 'book:' || l_orderkey AS src, 'concept:' || l_partkey AS dst, 'EXPLORES_IDEA' AS relation, l_linenumber AS seq FROM lineitem UNION ALL SELECT 'section:' || l_suppkey, 'concept:' || l_partkey, 'DISCUSSES', l_linenumber FROM lineitem UNION ALL SELECT 'book:' || l_orderkey, 'section:' || l_suppkey, 'HAS_SECTION', l_linenumber FROM lineitem),
edges AS (SELECT DISTINCT src, dst, relation FROM raw)
"""


@query(f"WITH {_GRAPH} SELECT 'node' AS kind, type AS name, count(*) AS n, round(avg(weight), 1) AS mean_weight FROM nodes GROUP BY type UNION ALL SELECT 'edge', relation, count(*), NULL FROM edges GROUP BY relation")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return G.stats(_nodes(spark, sf), G.latest_edges(_edges(spark, sf), "seq"))


@query("SELECT l_orderkey AS book, l_partkey AS concept, count(*) AS occurrences FROM lineitem GROUP BY 1, 2")
def book_idea_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("book"), F.col("l_partkey").alias("concept")).agg(F.count("*").alias("occurrences"))


@query("SELECT l_partkey, strftime(min(l_shipdate), '%Y-%m') AS first_month, greatest(1, count(DISTINCT l_orderkey)) AS occurrences FROM lineitem GROUP BY 1")
def first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM").alias("first_month"), F.greatest(F.lit(1), F.countDistinct("l_orderkey")).alias("occurrences"))


@query("""
WITH a AS (SELECT c_custkey, c_name, c_acctbal AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS c_name, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, coalesce(b.c_name, a.c_name) AS c_name, coalesce(b.bal, a.bal) AS bal, seg FROM a FULL JOIN b ON a.c_custkey = b.c_custkey
""")
def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping stores merged attribute by attribute."""
    c = table(spark, sf, "customer")
    a = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    b = c.where("c_custkey % 5 <> 0").select("c_custkey", F.expr("CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END").alias("c_name"), (F.col("c_acctbal") + 1).alias("bal"))
    return G.merge(a, b, ["c_custkey"])


@query("""
WITH a AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_quantity > 49), n AS (SELECT count(a.p) AS x, count(b.p) AS y, count(*) FILTER (a.p IS NOT NULL AND b.p IS NOT NULL) AS c FROM a FULL JOIN b ON a.p = b.p)
SELECT x AS size_a, y AS size_b, c AS common, x - c AS only_a, y - c AS only_b, round(c / (x + y - c), 6) AS jaccard, round(c / x, 6) AS overlap_a, round(c / y, 6) AS overlap_b FROM n
""")
def graph_compare_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    one = G.compare(l.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("name")), l.where("l_quantity > 49").select(F.col("l_partkey").alias("name")))
    return one.select("size_a", "size_b", "common", "only_a", "only_b", *(F.round(c, 6).alias(c) for c in ("jaccard", "overlap_a", "overlap_b")))


@query(f"""
WITH {_GRAPH}, g AS (SELECT DISTINCT 'pair:' || l_partkey || ':' || l_suppkey AS concept, 'book:' || l_orderkey AS book FROM lineitem), dead AS (SELECT 'book:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'),
touched AS (SELECT DISTINCT concept FROM g WHERE book IN (SELECT id FROM dead)), held AS (SELECT DISTINCT concept FROM g WHERE book NOT IN (SELECT id FROM dead))
SELECT 'Book' AS type, count(*) AS removed FROM dead UNION ALL SELECT 'Concept', count(*) FROM touched WHERE concept NOT IN (SELECT concept FROM held)
""")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """All finished orders removed with the (part, supplier) pairs that only they mention."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    pair = F.concat(F.lit("pair:"), F.col("l_partkey"), F.lit(":"), F.col("l_suppkey"))
    edges = l.select(F.concat(F.lit("book:"), F.col("l_orderkey")).alias("src"), pair.alias("dst"), F.lit("EXPLORES_IDEA").alias("relation")).distinct()
    books = table(spark, sf, "orders").select(F.concat(F.lit("book:"), F.col("o_orderkey")).alias("id"), "o_orderstatus")
    nodes = books.select("id", F.lit("Book").alias("type")).union(edges.select("dst", F.lit("Concept")).distinct())
    return G.remove_books(nodes, edges, books.where("o_orderstatus = 'F'")).counts()


@query(f"""
WITH {_GRAPH}, m AS (SELECT id AS alias, 'concept:' || (p_partkey - p_partkey % 4 + 1) AS canonical FROM (SELECT p_partkey, 'concept:' || p_partkey AS id FROM part) WHERE p_partkey % 4 <> 1),
r AS (SELECT coalesce(a.canonical, src) AS src, coalesce(b.canonical, dst) AS dst, relation FROM edges LEFT JOIN m a ON src = a.alias LEFT JOIN m b ON dst = b.alias) SELECT relation, count(*) AS edges, count(DISTINCT dst) AS targets FROM (SELECT DISTINCT * FROM r WHERE src <> dst) GROUP BY relation
""")
def alias_redirect(spark: SparkSession, sf: str) -> DataFrame:
    """Edges after four parts at a time are merged into one."""
    aliases = table(spark, sf, "part").where("p_partkey % 4 <> 1").select(F.concat(F.lit("concept:"), F.col("p_partkey")).alias("alias"), F.concat(F.lit("concept:"), F.col("p_partkey") - F.col("p_partkey") % 4 + 1).alias("canonical"))
    return G.redirect(_edges(spark, sf), aliases).groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("targets"))


_BOTH = "b AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges)"


@query(f"WITH {_GRAPH}, {_BOTH} SELECT x AS seed, y AS id, 1 AS hop FROM b WHERE x IN (SELECT 'section:' || s_suppkey FROM supplier WHERE s_suppkey % 100 = 0)")
def one_hop(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of the query nodes: every supplier whose key is divisible by 100."""
    seeds = table(spark, sf, "supplier").where("s_suppkey % 100 = 0").select(F.concat(F.lit("section:"), F.col("s_suppkey")).alias("id"))
    return G.neighbours(_edges(spark, sf), seeds, 1)


@query(f"WITH {_GRAPH}, {_BOTH}, s AS (SELECT 'book:' || o_orderkey AS id FROM orders WHERE o_orderkey % 100 = 0), h1 AS (SELECT DISTINCT id AS seed, y AS id, 1 AS hop FROM s JOIN b ON x = id), h2 AS (SELECT DISTINCT seed, y AS id, 2 AS hop FROM h1 JOIN b ON x = id), r AS (SELECT seed, id, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT id, id, 0 FROM s) GROUP BY 1, 2) SELECT seed, hop, count(*) AS reached FROM r WHERE hop > 0 GROUP BY 1, 2")
def two_hop(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes lie one and two steps from each query node: every order whose key is divisible by 100."""
    seeds = table(spark, sf, "orders").where("o_orderkey % 100 = 0").select(F.concat(F.lit("book:"), F.col("o_orderkey")).alias("id"))
    return G.neighbours(_edges(spark, sf), seeds, 2).groupBy("seed", "hop").agg(F.count("*").alias("reached"))


@query("SELECT doc_id AS id, left(text, 60) AS title FROM documents a WHERE lang <> 'en' AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.lang = 'en' AND length(regexp_replace(lower(left(b.text, 60)), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+', '', 'g')) >= 4 AND regexp_replace(lower(left(b.text, 60)), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+', '', 'g') = regexp_replace(lower(left(a.text, 60)), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+', '', 'g'))")
def incremental_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Books of one store that another lacks; a book's title is its text's beginning."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.left("text", F.lit(60)).alias("title"), "lang")
    return G.new_books(d.where("lang <> 'en'").select("id", "title"), d.where("lang = 'en'").select("id", "title"))


@query("SELECT conv_id, sha256(string_agg(d, '' ORDER BY turn, d)) AS content_hash FROM (SELECT conv_id, turn, sha256(role || ':' || text) AS d FROM conversations) GROUP BY conv_id")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws(":", "role", "text"), 256).alias("d"))
    return G.group_hash(rows, "conv_id", "d", "turn")


@query("WITH h AS (SELECT doc_id, md5(text) AS d FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(text || 'x') ELSE md5(text) END AS d FROM documents WHERE doc_id % 11 <> 0) SELECT h.doc_id FROM h LEFT JOIN o ON h.doc_id = o.doc_id AND h.d = o.d WHERE o.doc_id IS NULL")
def hash_guard_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that an upsert has to write into an older copy."""
    h = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("d"), "text")
    old = h.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("x")).cast("binary"))).otherwise(F.col("d")).alias("d"))
    return G.changed(h.select("doc_id", "d"), old, "doc_id", "d").select("doc_id")


@query("""
WITH m AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN p_brand ELSE upper(p_brand) END AS name, lower(p_brand) AS n, p_size, strftime(l_shipdate, '%Y-%m') AS month, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT n, name, count(*) AS c FROM m GROUP BY 1, 2)
SELECT n AS normal, (SELECT arg_max(name, (c, -length(name), -ascii(substring(name, 2, 1)))) FROM k WHERE k.n = m.n) AS canonical, len(list_distinct(list(name))) AS aliases, max(p_size) AS max_weight, min(month) AS first_month, count(DISTINCT l_suppkey) AS chunks, count(*) AS mentions, greatest(count(*), count(DISTINCT l_suppkey)) AS total_occurrences FROM m GROUP BY n
""")
def concept_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions gathered by brand, each brand a concept written in two ways."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    seen = rows.select(F.when(F.col("l_linenumber") % 2 == 0, F.col("p_brand")).otherwise(F.upper("p_brand")).alias("name"), F.col("p_size").alias("weight"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_suppkey").alias("chunk_id"))
    out = G.observations(seen, F.lower("name"))
    return out.select("normal", "canonical", F.size("aliases").cast("long").alias("aliases"), "max_weight", "first_month", F.size("chunk_ids").cast("long").alias("chunks"), "mentions", "total_occurrences")


@query("""
WITH m AS (SELECT p_brand AS name, p_size AS weight, p_type AS brief, l_orderkey * 10 + l_linenumber AS seq, l_linenumber = 3 AND p_size = 7 AS f FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT name, count(*) AS occurrences, max(weight) AS weight, max(length(brief)) AS brief_chars, arg_max(brief, (length(brief), -seq)) AS brief, bool_or(f) AS has_formula FROM m GROUP BY name
""")
def merged_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of each brand merged: occurrences, largest weight, longest text, whether any has a formula."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    seen = rows.select(F.col("p_brand").alias("name"), F.col("p_size").alias("weight"), F.col("p_type").alias("brief"), F.lit("").alias("detail"), F.lit(None).cast("array<float>").alias("embedding"), ((F.col("l_linenumber") == 3) & (F.col("p_size") == 7)).alias("has_formula"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return G.merge_concepts(seen, "name", "seq").select("name", "occurrences", "weight", F.length("brief").cast("long").alias("brief_chars"), "brief", "has_formula")


@query("""
WITH a AS (SELECT 'Concept' AS type, p_name AS name, p_type AS text FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'Section', s_name, NULL FROM supplier), b AS (SELECT 'Concept' AS type, p_name AS name, p_brand AS text FROM part WHERE p_partkey % 5 <> 0), x AS (SELECT type, count(*) AS n, avg(length(text)) AS c FROM a GROUP BY 1), y AS (SELECT type, count(*) AS n, avg(length(text)) AS c FROM b GROUP BY 1)
SELECT 'node' AS kind, coalesce(x.type, y.type) AS name, coalesce(x.n, 0) AS n_a, round(x.c, 6) AS chars_a, coalesce(y.n, 0) AS n_b, round(y.c, 6) AS chars_b, coalesce(y.n, 0) - coalesce(x.n, 0) AS difference FROM x FULL JOIN y ON x.type = y.type
UNION ALL SELECT 'edge', 'SUPPORTED_BY', count(*) FILTER (l_linenumber < 3), NULL, count(*) FILTER (l_linenumber < 4), NULL, count(*) FILTER (l_linenumber = 3) FROM lineitem
""")
def graph_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Two graphs by type and relation."""
    p, l = table(spark, sf, "part"), table(spark, sf, "lineitem")  # noqa: E741
    a = p.where("p_partkey % 3 <> 0").select(F.lit("Concept").alias("type"), F.col("p_name").alias("name"), F.col("p_type").alias("text")).unionByName(table(spark, sf, "supplier").select(F.lit("Section").alias("type"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("text")))
    b = p.where("p_partkey % 5 <> 0").select(F.lit("Concept").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("text"))
    e = lambda n: l.where(F.col("l_linenumber") < n).select(F.lit("SUPPORTED_BY").alias("relation"))
    types, _ = G.compare_graphs(a, e(3), b, e(4))
    return types.select("kind", "name", "n_a", F.round("chars_a", 6).alias("chars_a"), "n_b", F.round("chars_b", 6).alias("chars_b"), "difference")


@query("SELECT doc_id, left(sha256('doc:' || doc_id || ':Chunk:' || CASE WHEN lang IS NOT NULL THEN 'lang=' || lang || '|' ELSE '' END || CASE WHEN n_chars IS NOT NULL THEN 'n_chars=' || n_chars || '|' ELSE '' END || 'tags=[\"a\",\"' || coalesce(source, 'none') || '\"]|' || 'vector=' || printf('%.4f', n_chars / 7.0) || ',' || printf('%.4f', doc_id * 0.25) || ';len=2|'), 32) AS digest FROM documents")
def node_digests(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of each document as a node with texts, numbers, a list and a vector."""
    d = table(spark, sf, "documents")
    nodes = d.select("doc_id", F.concat(F.lit("doc:"), "doc_id").alias("id"), F.lit("Chunk").alias("type"), "lang", "n_chars", F.array(F.lit("a"), F.coalesce("source", F.lit("none"))).alias("tags"), F.array(F.col("n_chars") / 7.0, F.col("doc_id") * 0.25).alias("vector"), F.lit("x").alias("content_hash"))
    return nodes.select("doc_id", G.node_hash(nodes.drop("doc_id")).alias("digest"))


@query("SELECT event_type, user_id, event_id, ts, value, events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS events FROM events) WHERE r = 1")
def ledger_latest(spark: SparkSession, sf: str) -> DataFrame:
    return L.latest(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("event_type", "user_id", "event_id", "ts", "value", "events")


@query("SELECT event_type, count(*) AS items, round(sum(value), 4) AS total_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY event_type")
def ledger_summary(spark: SparkSession, sf: str) -> DataFrame:
    last = L.latest(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"])
    return L.summary(last, "event_type", ["value"]).withColumn("total_value", F.round("total_value", 4))


@query("""
SELECT o_orderpriority AS section, round(sum(l_quantity), 2) AS prompt, sum(l_linenumber)::BIGINT AS completion, round(sum(l_quantity) + sum(l_linenumber), 2) AS total, round(sum(l_quantity) * CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE length(o_orderpriority) END / 1e6 + sum(l_linenumber) * CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 2.5 END / 1e6, 9) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority
""")
def section_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each section with what they cost; one section has no price."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("section"))
    usage = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("section", F.col("l_quantity").alias("prompt"), F.col("l_linenumber").alias("completion"))
    prices = o.select("section").distinct().where("section <> '5-LOW'").select("section", F.length("section").cast("double").alias("prompt"), F.lit(2.5).alias("completion"))
    out = L.token_totals(usage, "section", ["prompt", "completion"], prices)
    return out.select("section", F.round("prompt", 2).alias("prompt"), "completion", F.round("total", 2).alias("total"), F.round("cost", 9).alias("cost"))


@query("SELECT l_returnflag AS server, l_linestatus AS task, count(*) AS calls, round(sum(l_quantity), 2) AS amount, min(l_linenumber) AS priority, array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS tasks FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING l_returnflag IS NOT NULL")
def server_statistics(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("server"), F.col("l_linestatus").alias("task"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("amount"))  # noqa: E741
    return L.server_statistics(l, "server", "task", "n", ["amount"]).select("server", "task", "calls", F.round("amount", 2).alias("amount"), "priority", F.array_join("tasks", ",").alias("tasks"))


@query("""
WITH i AS (SELECT p_partkey AS id, p_name AS name, p_size AS weight, strftime(min(l_shipdate), '%Y-%m') AS month, count(*) AS occurrences FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3), s AS (SELECT *, row_number() OVER (ORDER BY month DESC NULLS LAST, weight DESC, occurrences DESC, id) AS place FROM i)
SELECT id, name, weight, month, occurrences, place FROM s WHERE place <= 500
""")
def ideas_sorted_month_desc(spark: SparkSession, sf: str) -> DataFrame:
    """The list of ideas, newest first: the 500 that the list shows."""
    seen = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM").alias("month"), F.count("*").alias("n"))
    ideas = table(spark, sf, "part").join(seen, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("weight"), "month", F.coalesce("n", F.lit(1)).alias("occurrences"))
    order = search.sort_order("month_desc", "id")
    return ideas.orderBy(*order).limit(500).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query("""
WITH b AS (SELECT l_orderkey, l_partkey, count(*) * max(p_size) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey) AS place FROM b)
SELECT l_orderkey AS book, list(l_partkey ORDER BY place) AS top FROM r WHERE place <= 10 GROUP BY 1
""")
def indexed_books(spark: SparkSession, sf: str) -> DataFrame:
    """Each book's ten ideas of the largest occurrences x weight."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    scored = l.groupBy("l_orderkey", "l_partkey").agg((F.count("*") * F.max("p_size")).alias("score"))
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "l_partkey"))), 1, 10)
    return scored.groupBy(F.col("l_orderkey").alias("book")).agg(F.transform(ranked, lambda x: x["l_partkey"]).alias("top"))


@query("WITH a AS (SELECT 'Book' AS type, count(*) AS here, count(*) FILTER (o_orderstatus <> 'P') AS there FROM orders UNION ALL SELECT 'Concept', count(*), count(*) FROM part) SELECT type, here, there, here - there AS difference, CASE WHEN here = there THEN 'equal' WHEN here > there THEN 'missing there' ELSE 'extra there' END AS state FROM a")
def consistency(spark: SparkSession, sf: str) -> DataFrame:
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    kinds = lambda part: part.select(F.lit("Book").alias("type")).union(p.select(F.lit("Concept")))
    return G.consistency(kinds(o), kinds(o.where("o_orderstatus <> 'P'")))


@query("""
WITH a AS (SELECT l_orderkey AS book, string_agg(s_name, ' & ' ORDER BY l_linenumber, l_suppkey) AS a, array_to_string(list_sort(list_distinct(list(upper(CASE WHEN l_linenumber % 3 = 0 THEN 'epub' WHEN l_linenumber % 3 = 1 THEN 'pdf' ELSE '' END)) FILTER (l_linenumber % 3 < 2))), ',') AS f FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'Untitled' ELSE o_orderpriority END AS title, coalesce(a, '') AS authors, CASE WHEN o_orderkey % 2 = 0 THEN 'about ' || o_orderkey ELSE '' END AS comments, coalesce(f, '') AS formats, 'lib/p' || o_orderkey AS path, strftime(o_orderdate, '%Y-%m-%d') AS publication_date FROM orders LEFT JOIN a ON book = o_orderkey
""")
def catalogue_listing(spark: SparkSession, sf: str) -> DataFrame:
    """A library's listing: orders as books, suppliers as their authors."""
    from textloom.sources.library import Library, list_books

    o, l, s = (table(spark, sf, t) for t in ("orders", "lineitem", "supplier"))  # noqa: E741
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    books = o.select(k.alias("id"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("title"), F.concat(F.lit("p"), k).alias("path"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("pubdate"))
    links = l.select(F.struct("l_linenumber", "l_suppkey").alias("id"), F.col("l_orderkey").alias("book"), F.col("l_suppkey").alias("author"))
    comments = o.where("o_orderkey % 2 = 0").select(k.alias("book"), F.concat(F.lit("about "), k).alias("text"))
    data = l.select(F.col("l_orderkey").alias("book"), F.when(n % 3 == 0, "epub").when(n % 3 == 1, "pdf").otherwise("").alias("format"))
    out = list_books(Library(books, links, s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), comments, data), "lib")
    return out.withColumns({"authors": F.array_join("authors", " & "), "formats": F.array_join("formats", ",")})


@query("""
WITH c AS (SELECT conv_id, sum(length(text)) OVER w - length(text) AS s, sum(length(text)) OVER w AS e FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING)), b AS (SELECT DISTINCT conv_id, s + 100 AS s, s + 700 AS e FROM c)
SELECT c.conv_id, c.s::BIGINT AS l_start, c.e::BIGINT AS l_end, b.s::BIGINT AS r_start, b.e::BIGINT AS r_end, (b.s + b.e) / 2.0 BETWEEN c.s AND c.e AS contained FROM c JOIN b ON c.conv_id = b.conv_id AND c.s < b.e AND c.e > b.s
""")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as intervals of a conversation's text against windows that begin 100 characters after each turn."""
    from textloom.operators.audit import overlaps

    w = Window.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, sf, "conversations").select("conv_id", F.length("text").cast("long").alias("n"), F.sum(F.length("text")).over(w).alias("end")).select("conv_id", (F.col("end") - F.col("n")).alias("start"), "end")
    windows = c.select("conv_id", (F.col("start") + 100).alias("start"), (F.col("start") + 700).alias("end")).distinct()
    return overlaps(c, windows, "conv_id", 1024)


@query("""
WITH n AS (SELECT doc_id, n_chars, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM documents), o AS (SELECT t, arg_min(doc_id, (n_chars, doc_id)) AS doc_id, min(n_chars) AS n_chars FROM n GROUP BY t), r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM o)
SELECT doc_id, n_chars, place FROM r WHERE place <= 500
""")
def worst_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The 500 shortest documents, each text once: a top-k report."""
    from textloom.operators.audit import worst

    return worst(table(spark, sf, "documents").select("doc_id", "n_chars", "text"), "n_chars", "text", "doc_id").select("doc_id", "n_chars", F.col("place").cast("long").alias("place"))


@query("""
WITH e AS (SELECT user_id, ts, event_id, CASE event_id % 7 WHEN 0 THEN 'processed' WHEN 1 THEN 'failed' WHEN 2 THEN 'stacked' WHEN 3 THEN 'stacked' ELSE 'retried' END AS ev, CASE event_id % 3 WHEN 0 THEN 'semantic_fastpath' WHEN 1 THEN 'skipped_biblio' ELSE 'node1' END AS server, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id % 4 <> 0 OR event_id % 7 > 2),
x AS (SELECT *, max(CASE WHEN ev IN ('processed', 'failed') THEN r END) OVER (PARTITION BY user_id) AS ended FROM e), g AS (SELECT user_id, count(*) AS events, max(CASE WHEN ev = 'processed' THEN r END) AS p, max(CASE WHEN ev = 'failed' THEN r END) AS f, arg_max(ev, r) AS last, count(*) FILTER (ev = 'retried' AND (ended IS NULL OR r > ended)) AS attempts, arg_max(CASE WHEN server = 'semantic_fastpath' THEN 'assigned' WHEN starts_with(server, 'skipped_') THEN server ELSE 'extracted' END, r) FILTER (ev = 'processed') AS status FROM x GROUP BY user_id)
SELECT user_id, CASE WHEN p IS NOT NULL THEN 'processed' WHEN f IS NOT NULL OR attempts >= 3 THEN 'failed' WHEN last = 'stacked' THEN 'stacked' ELSE 'retried' END AS state, attempts, status, events FROM g
""")
def ledger_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Where a series of events leaves each chunk (here: user): stacked, retried, failed or processed."""
    k = F.col("event_id")
    kind = F.when(k % 7 == 0, "processed").when(k % 7 == 1, "failed").when(k % 7 <= 3, "stacked").otherwise("retried")
    server = F.when(k % 3 == 0, "semantic_fastpath").when(k % 3 == 1, "skipped_biblio").otherwise("node1")
    rows = table(spark, sf, "events").where("user_id % 4 <> 0 or event_id % 7 > 2").select("user_id", "ts", "event_id", kind.alias("ev"), server.alias("server"))
    return L.transitions(rows, "user_id", ["ts", "event_id"], "ev", "server")


@query("""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (ORDER BY doc_id) AS r FROM documents), s AS (SELECT r, doc_id, 0::BIGINT AS shard, n AS used FROM d WHERE r = 1 UNION ALL SELECT d.r, d.doc_id, CASE WHEN s.used > 0 AND s.used + d.n > 1000000 THEN shard + 1 ELSE shard END, CASE WHEN s.used > 0 AND s.used + d.n > 1000000 THEN d.n ELSE s.used + d.n END FROM s JOIN d ON d.r = s.r + 1)
SELECT doc_id, shard FROM s
""")
def shard_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Whole books packed into shards of at most 1,000,000 characters."""
    return G.shards(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 1_000_000)


@query(r"""
WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations), c AS (SELECT conv_id, r, text, CASE WHEN length(text) <= 150 THEN text ELSE regexp_replace(left(text, 150), '[\t\n\x0b\f\r ]+[^\t\n\x0b\f\r ]*$', '') || '...' END AS a, CASE WHEN length(text) <= 100 THEN text ELSE regexp_replace(left(text, 100), '[\t\n\x0b\f\r ]+[^\t\n\x0b\f\r ]*$', '') || '...' END AS b, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(left(text, 120), '[\t\n\x0b\f\r ]+[^\t\n\x0b\f\r ]*$', '') || '...' END AS d FROM r WHERE r <= 5),
l AS (SELECT conv_id, r, CASE WHEN r <= 3 THEN '- ' || a || CASE WHEN text <> '' THEN ' "' || b || '"' ELSE '' END WHEN text <> '' THEN '> "' || d || '"' END AS l FROM c) SELECT conv_id, string_agg(l, chr(10) ORDER BY r) AS payload FROM l WHERE l IS NOT NULL GROUP BY conv_id
""")
def consolidation_payload(spark: SparkSession, sf: str) -> DataFrame:
    from textloom.operators.audit import payload

    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("description"), F.col("text").alias("quote"))
    return payload(rows, "conv_id", ["turn", "quote"])


@query("""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), h AS (SELECT a.label, a.vec_id, list(b.vec_id ORDER BY b.vec_id) AS ideas, list(list_cosine_similarity(a.v, b.v) ORDER BY b.vec_id) AS sims FROM e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND list_cosine_similarity(a.v, b.v) >= 0.2 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM h),
s AS (SELECT label, r, vec_id, ideas[1] AS idea, sims[1] AS sim, [ideas[1]] AS used FROM o WHERE r = 1 UNION ALL SELECT o.label, o.r, o.vec_id, list_filter(o.ideas, lambda x: NOT list_contains(s.used, x))[1], o.sims[list_position(o.ideas, list_filter(o.ideas, lambda x: NOT list_contains(s.used, x))[1])], list_append(s.used, list_filter(o.ideas, lambda x: NOT list_contains(s.used, x))[1]) FROM s JOIN o ON o.label = s.label AND o.r = s.r + 1)
SELECT label, vec_id, idea AS idea_id, round(sim, 6) AS sim FROM s WHERE idea IS NOT NULL
""")
def greedy_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of even number matched to those of odd number in each label, in order; every one of similarity 0.2 or more may be taken."""
    from textloom.operators.audit import greedy_match
    from textloom.operators.similarity import nearest

    e = table(spark, sf, "embeddings")
    ideas = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("idea_id"), "embedding")
    hits = nearest(e.where("vec_id % 2 = 0"), ideas, max(ideas.count(), 1), least=0.2).select("label", "vec_id", F.explode("hits").alias("h")).select("label", "vec_id", F.col("h.id").alias("idea_id"), F.col("h.sim").alias("sim"))
    return greedy_match(hits, "label", "vec_id", "idea_id", "sim", 0.2).select("label", "vec_id", "idea_id", F.round("sim", 6).alias("sim"))
