"""What users ask of a graph: nodes found by name, their details, typed and ordered neighbourhoods, ideas of chunks, search.

nodes: id, type, name, weight and whatever else; edges: src, dst, relation and attributes. Limits are those of the views.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import search
from textloom.operators.similarity import nearest

IDEAS = ["Concept", "Idea"]


def priority(kind: Column) -> Column:
    """Order of neighbours: ideas, books, sections, chunks, the rest."""
    return F.when(kind.isin(IDEAS), 1).when(kind == "Book", 2).when(kind == "Section", 3).when(kind == "Chunk", 4).otherwise(5)


def find_nodes(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id): the node of each asked text (asked): of that id or, whatever the case, of that name; Idea nodes first, then the heaviest, then the least id. Texts that name none are left out."""
    kind = F.when(F.col("type") == "Idea", 1).otherwise(2)
    order = F.struct(kind, -F.coalesce("weight", F.lit(5)), F.col("id"))
    names = nodes.select("id", "type", "weight", F.lower("name").alias("_n"))
    by_id = asked.join(names, F.col("asked") == F.col("id")).select("asked", "id", "type", "weight", "_n")
    by_name = asked.join(names, F.lower("asked") == F.col("_n")).select("asked", "id", "type", "weight", "_n")
    one = by_id.unionByName(by_name).groupBy("asked").agg(F.min_by(F.struct("id", "_n"), order).alias("t")).select("asked", "t.id", "t._n")
    better = names.where("type = 'Idea'").groupBy("_n").agg(F.min_by("id", F.struct(-F.coalesce("weight", F.lit(5)), F.col("id"))).alias("better"))
    return one.join(better, "_n", "left").select("asked", F.coalesce("better", "id").alias("id"))


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, kind: str = "all", limit: int | None = 50) -> DataFrame:
    """(seed, id, relation, outgoing, type, weight, place): relations of each seed (id) to neighbours of a kind, by priority, then weight, then id; at most `limit` for each seed.

    kind: all, Concept (ideas too), Book, Section or Chunk. Edges are narrowed to the seeds before anything else.
    """
    ids = seeds.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("seed"), F.col("dst").alias("id"), "relation", F.lit(True).alias("outgoing"))
    into = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("dst").alias("seed"), F.col("src").alias("id"), "relation", F.lit(False).alias("outgoing"))
    wanted = nodes if kind == "all" else nodes.where(F.col("type").isin(IDEAS) if kind == "Concept" else F.col("type") == kind)
    near = out.unionByName(into).distinct().join(wanted.select("id", "type", "weight"), "id")
    if limit is None:
        return near.select("seed", "id", "relation", "outgoing", "type", "weight")
    order = [priority(F.col("type")), F.coalesce("weight", F.lit(5)).desc(), F.col("id"), F.col("relation"), F.col("outgoing")]
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(*order)).cast("long")).where(F.col("place") <= limit)
    return ranked.select("seed", "id", "relation", "outgoing", "type", "weight", "place")


def node_details(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id, part, other, relation, outgoing, name): what a node's page shows: books once by book, ideas once by relation, evidence (chunks and sections) once, and other relations."""
    found = find_nodes(nodes, asked)
    near = expand(nodes, edges, found.select("id"), limit=None)
    part = F.when(F.col("type") == "Book", "books").when(F.col("type").isin(IDEAS), "ideas").when(F.col("type").isin("Chunk", "Section"), "evidence").otherwise("other")
    named = near.withColumn("part", part).join(nodes.select("id", F.coalesce("name", "id").alias("name")), "id")
    key = F.when(F.col("part").isin("books", "evidence"), F.lit("")).when(F.col("part") == "ideas", F.col("relation")).otherwise(F.concat_ws(":", "relation", "outgoing"))
    one = named.groupBy("seed", "part", F.col("id").alias("other"), key.alias("_k")).agg(F.min_by(F.struct("relation", "outgoing", "name"), F.struct("relation", ~F.col("outgoing"))).alias("r"))
    return found.join(one, F.col("id") == F.col("seed")).select("asked", "id", "part", "other", "r.relation", "r.outgoing", "r.name")


def ideas_for_chunks(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk, id, name, category, brief, detail, quote, weight): ideas joined to each chunk (id) by an edge either way, each name once for a chunk.

    What an edge says of the chunk wins over the node; of two edges the chunk's own one does. nodes may lack category, brief, detail and quote.
    """
    have = lambda df, c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    texts = ["brief", "detail", "quote", "category"]
    said = lambda: [have(edges, c).alias(f"e_{c}") for c in texts]
    ids = chunks.select(F.col("id").alias("chunk")).distinct()
    out = edges.select(F.col("src").alias("chunk"), F.col("dst").alias("id"), F.lit(0).alias("side"), *said()).join(ids, "chunk", "left_semi")
    into = edges.select(F.col("dst").alias("chunk"), F.col("src").alias("id"), F.lit(1).alias("side"), *said()).join(ids, "chunk", "left_semi")
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("side", c)))
    both = out.unionByName(into).groupBy("chunk", "id").agg(*(pick(f"e_{c}").alias(f"e_{c}") for c in texts))
    ideas = nodes.where(F.col("type").isin(IDEAS)).select("id", F.coalesce("name", F.regexp_replace("id", "^concept:", "")).alias("name"), "weight", *(have(nodes, c).alias(f"n_{c}") for c in texts))
    first = lambda c, order, default: F.coalesce(*(F.col(f"{x}_{c}") for x in order), F.lit(default))
    rows = both.join(ideas, "id").select("chunk", "id", "name", first("category", "ne", "Idea").alias("category"), first("brief", "en", "").alias("brief"), first("detail", "en", "").alias("detail"), first("quote", "en", None).alias("quote"), F.coalesce("weight", F.lit(5)).alias("weight"))
    rest = [c for c in rows.columns if c not in ("chunk", "name")]
    return rows.groupBy("chunk", "name").agg(F.min_by(F.struct(*rest), "id").alias("r")).select("chunk", "r.id", "name", *(F.col(f"r.{c}").alias(c) for c in rest if c != "id"))


def parent_chunks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): chunks retained or continued by their filter_state if any is skipped, else those that support an idea or are marked as parents."""
    state = F.lower("filter_state") if "filter_state" in nodes.columns else F.lit(None).cast("string")
    marks = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in ("is_parent", "supports_ideas") if c in nodes.columns]
    chunks = nodes.where("type = 'Chunk'").select("id", state.alias("state"), (T.any_of(*marks) if marks else F.lit(False)).alias("marked"))
    skips = F.broadcast(chunks.agg(F.coalesce(F.bool_or(F.col("state") == "skip"), F.lit(False)).alias("skips")))
    ends = edges.where(F.col("relation").isin("SUPPORTED_BY", "SUPPORTS_IDEA")).select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("held", F.lit(True))
    keep = F.when(F.col("skips"), F.coalesce(F.col("state").isin("retain", "continue"), F.lit(False))).otherwise(F.coalesce("held", F.lit(False)) | F.col("marked"))
    return chunks.join(ends, "id", "left").join(skips, F.lit(True)).where(keep).select("id")


@dataclass
class Found:
    seeds: DataFrame  # id, name, cosine, priority_score
    nodes: DataFrame
    edges: DataFrame


def seed_ideas(nodes: DataFrame, query: str, vector: list[float] | None, threshold: float = 0.70, top: int = 6) -> DataFrame:
    """(id, name, cosine, priority_score): ideas by cosine x weight from the threshold on, and by name (equal 1, beginning 0.95, inside 0.90); the best by each id, `top` in all: a top-k report."""
    ideas = nodes.where(F.col("type").isin(IDEAS))
    q = query.strip().lower()
    n = F.lower("name")
    by_name = F.when((n == q) | (F.col("id") == query.strip()), 1.0).when(n.startswith(q), 0.95).when(F.contains(n, F.lit(q)), 0.90)
    named = ideas.select("id", "name", F.coalesce("weight", F.lit(8)).cast("double").alias("weight"), by_name.alias("cosine")).where("cosine is not null")
    parts = named
    if vector is not None:
        one = nodes.sparkSession.createDataFrame([("query", [float(x) for x in vector])], "t string, v array<double>")
        hits = nearest(ideas.where("embedding is not null").select("id", "name", F.coalesce("weight", F.lit(5)).cast("double").alias("weight"), "embedding"), one, 1, target_id="t", target_vec="v", least=threshold)
        parts = named.unionByName(hits.where(F.size("hits") > 0).select("id", "name", "weight", F.col("hits")[0]["sim"].alias("cosine")))
    best = parts.groupBy("id").agg(F.max_by(F.struct("name", "weight"), "cosine").alias("r"), F.max("cosine").alias("cosine")).select("id", "r.name", "cosine", F.round(F.col("cosine") * F.col("r.weight"), 4).alias("priority_score"))
    return best.orderBy(F.desc("priority_score"), "id").limit(top)


def query_ideas(nodes: DataFrame, edges: DataFrame, query: str, vector: list[float] | None = None, deep: bool = False, limit: int = 60, top: int = 6, threshold: float = 0.70) -> Found:
    """Seeds of a query and the relations around them: one step, or for deep ones also a second step from ideas; at most `limit` relations, nearer seeds and weightier neighbours first.

    Where neither names nor the vector give a seed, the best by word and letter-triple similarity (0.40 or more) are taken.
    """
    from textloom.storage import stash

    seeds = stash(seed_ideas(nodes, query, vector, threshold, top), "seeds")
    if seeds.isEmpty():
        ideas = nodes.where(F.col("type").isin(IDEAS))
        near = search.tfidf_scores(ideas.select("id", "name"), "id", "name", query).where("score >= 0.40").orderBy(F.desc("score"), "id").limit(top)
        seeds = stash(near.join(ideas.select("id", "name"), "id").select("id", "name", F.round("score", 4).alias("cosine"), F.round(F.col("score") * 5, 4).alias("priority_score")), "seeds")
    one = expand(nodes, edges, seeds, limit=limit).join(seeds.select(F.col("id").alias("seed"), "priority_score"), "seed").withColumn("hop", F.lit(1))
    steps = one
    if deep:
        front = one.where(F.col("type").isin(IDEAS)).groupBy(F.col("id").alias("seed")).agg(F.max("priority_score").alias("priority_score"))
        two = expand(nodes, edges, front.select(F.col("seed").alias("id")), limit=limit).join(front, "seed").withColumn("hop", F.lit(2))
        steps = one.unionByName(two)
    rows = steps.orderBy("hop", F.desc("priority_score"), priority(F.col("type")), F.coalesce("weight", F.lit(5)).desc(), "seed", "id", "relation").limit(limit)
    links = stash(rows.select(F.when(F.col("outgoing"), F.col("seed")).otherwise(F.col("id")).alias("src"), F.when(F.col("outgoing"), F.col("id")).otherwise(F.col("seed")).alias("dst"), "relation").distinct(), "found-edges")
    ids = links.select(F.col("src").alias("id")).union(links.select("dst")).union(seeds.select("id")).distinct()
    return Found(seeds, nodes.join(ids, "id", "left_semi"), links)


def list_ideas(nodes: DataFrame, query: str = "", month_from: str | None = None, month_to: str | None = None, mode: str = "month_desc", limit: int = 500) -> DataFrame:
    """Ideas (id, name, category, summary, detail, weight, month, occurrences) that a lexical query finds within months, in the order of a mode, `limit` of them: the list's own limit. An empty query finds all."""
    rows = nodes.where(F.col("type").isin(IDEAS))
    if query.strip():
        rows = rows.withColumn("_m", T.exact_score(query, F.col("name"), F.col("category"), F.col("summary"), F.col("detail"))).where("_m.match_score is not null").select("*", "_m.match_score", "_m.match_type").drop("_m")
    else:
        rows = rows.withColumns({"match_score": F.lit(0.0), "match_type": F.lit("all")})
    low, high = (F.lit(x).cast("string") for x in (month_from, month_to))
    return rows.where(T.month_in_range(F.col("month"), low, high)).orderBy(*search.sort_order(mode, "id")).limit(limit)


def parts_of(rows: DataFrame, sought: DataFrame) -> DataFrame:
    """rows (_t, ..), once for each part (_p) of _t that may be among the titles sought (_t), 8 characters or more: those that begin with eight characters and have a length that some sought one has together."""
    heads = sought.where(F.length("_t") >= 8).groupBy(F.left("_t", F.lit(8)).alias("_g")).agg(F.collect_set(F.length("_t")).alias("_n"))
    places = F.sequence(F.lit(1), F.length("_t") - 7)
    grams = rows.where(F.length("_t") >= 8).select("*", F.explode(places).alias("_at")).withColumn("_g", F.substring("_t", F.col("_at"), F.lit(8)))
    fits = F.filter("_n", lambda n: F.col("_at") + n - 1 <= F.length("_t"))
    long = grams.hint("merge").join(heads, "_g").select(*rows.columns, F.explode(fits).alias("_l"), "_at")
    return long.select(*rows.columns, F.substring("_t", F.col("_at"), F.col("_l")).alias("_p"))


def resolve_book_files(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(asked_id, file): the file of each asked book (asked_id, title, filename, book_key, breadcrumb; nulls allowed) among files (file, title, key).

    In turn: the file's own name, the key (a paper id or number), the normal title (the breadcrumb's first part where the
    title says nothing), and titles of which one holds the other (8 characters or more; the most alike in length).
    """
    norm = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    base = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    blank = ["", "sample", "unknown", "untitled", "none"]
    crumb = F.trim(F.element_at(F.split("breadcrumb", " > "), 1))
    title = F.when(F.lower(F.trim(F.coalesce("title", F.lit("")))).isin(blank), crumb).otherwise(F.col("title"))
    a = asked.select("asked_id", base(F.col("filename")).alias("_f"), F.regexp_replace(F.trim(F.col("book_key").cast("string")), "^book:", "").alias("_k"), norm(title).alias("_t"))
    b = files.select("file", base(F.col("file")).alias("_f"), F.col("key").cast("string").alias("_k"), norm(F.col("title")).alias("_t"))
    tier = lambda on, n: a.where(f"{on} <> ''").hint("merge").join(b.where(f"{on} <> ''").groupBy(on).agg(F.min("file").alias("file")), on).select("asked_id", "file", F.lit(n).alias("tier"), F.lit(0).alias("gap"))
    exact = tier("_f", 1).unionByName(tier("_k", 2)).unionByName(tier("_t", 3))
    # one title inside another, for books that nothing exact finds: titles are looked up by equality among the other side's parts, so that a common word joins nothing; sides are as large as the tables, and their sizes are guessed too small once rows are exploded, so none is broadcast
    rest = a.hint("merge").join(exact.select("asked_id"), "asked_id", "left_anti").where(F.length("_t") >= 8)
    titles = b.where(F.length("_t") >= 8).groupBy("_t").agg(F.min("file").alias("file"))
    held = parts_of(titles, rest.select("_t")).groupBy("_p").agg(F.min(F.struct(F.length("_t").alias("n"), "file")).alias("x"))
    around = rest.hint("merge").join(held.withColumnRenamed("_p", "_t"), "_t").select("asked_id", F.col("x.file").alias("file"), F.lit(4).alias("tier"), (F.col("x.n") - F.length("_t")).alias("gap"))
    inner = parts_of(rest.select("_t").distinct(), titles.select("_t")).hint("merge").join(titles.withColumnRenamed("_t", "_p"), "_p").groupBy("_t").agg(F.min(F.struct((F.length("_t") - F.length("_p")).alias("gap"), "file")).alias("x"))
    within = rest.hint("merge").join(inner, "_t").select("asked_id", F.col("x.file").alias("file"), F.lit(4).alias("tier"), F.col("x.gap").alias("gap"))
    fuzzy = around.unionByName(within)
    return exact.unionByName(fuzzy).groupBy("asked_id").agg(F.min_by("file", F.struct("tier", "gap", "file")).alias("file"))
