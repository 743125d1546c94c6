"""One day's run: pages to new papers, their chunks through the cascade and the router, what they add merged into the graph, concepts postprocessed.

Fetching, embedding and extracting are the caller's functions; every step is one of the library's operators.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import cascade, integration, resolution, similarity
from textloom.operators.chunking import Embed
from textloom.operators.graph import latest_edges, merge
from textloom.storage import stash


@dataclass
class Synced:
    nodes: DataFrame
    edges: DataFrame
    papers: DataFrame  # those taken in
    counts: DataFrame  # what the pages held
    queue: DataFrame  # the chunks that were extracted


def merge_graph(nodes: DataFrame, edges: DataFrame, more: integration.Additions) -> tuple[DataFrame, DataFrame]:
    """A graph with additions: nodes by id, attribute by attribute the new value unless it is null, occurrences added up; one edge for each pair of ends, the new attributes last."""
    new = more.nodes
    if "occurrences" in new.columns and "occurrences" in nodes.columns:
        old = nodes.select(F.col("id").alias("_id"), F.col("occurrences").alias("_o"))
        new = new.join(old, F.col("id") == F.col("_id"), "left").withColumn("occurrences", F.col("occurrences") + F.coalesce("_o", F.lit(0))).drop("_id", "_o")
    both = edges.withColumn("_seq", F.lit(0)).unionByName(more.edges.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return merge(nodes, new, ["id"]), latest_edges(both, "_seq")


def daily_sync(nodes: DataFrame, edges: DataFrame, pages: DataFrame, fetch: Callable[[DataFrame], DataFrame], embed: Embed, extract: Callable[[DataFrame], DataFrame], low: float = 0.65, high: float = 0.90, exact: str | None = None, limit: int | None = None, judge: Callable | None = None) -> Synced:
    """pages (url, html) are searched for papers that the graph's Book nodes (book:<paper id>) lack.

    fetch gets papers (paper_id, title, ..) and gives their chunks: chunk_id, book_id, chapter_idx, chunk_idx, section_title, text,
    publication_date. The cascade skips, the rest is embedded and routed to the graph's ideas: chunks of high confidence are
    linked, the others go to extract, which gives ideas as integration.extracted_concepts takes them (without embedding:
    they are embedded here). Then all touched concepts are postprocessed.
    """
    from textloom.sources.books import crawl

    known = nodes.where("type = 'Book'").select(F.regexp_replace("id", "^book:", "").alias("paper_id"))
    wanted, counts = crawl(pages, known, exact, limit)
    papers = stash(wanted, "sync-papers")
    kept = cascade.classify(fetch(papers), section="section_title").where("decision = 'retain'")
    chunks = stash(integration.embedded(kept.withColumn("embedding", F.lit(None).cast("array<double>")), F.col("text"), embed), "sync-chunks")
    ideas = nodes.where(F.col("type").isin("Concept", "Idea") & F.col("embedding").isNotNull()).select(F.col("id").alias("idea_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    routed = stash(similarity.route(chunks, ideas, low, high, size=F.length("text"), formula=F.col("has_formula")), "sync-routed")
    names = nodes.select(F.col("id").alias("best_id"), F.col("name").alias("idea"), *([F.col("brief").alias("summary")] if "brief" in nodes.columns else [F.lit("").alias("summary")]))
    linked = integration.high_confidence(routed.join(names, "best_id", "left"))
    queue = stash(similarity.extraction_queue(routed, ["chunk_id"], limbo=False), "sync-queue")
    found = extract(queue)
    if "embedding" not in found.columns:
        found = integration.embedded(found.withColumn("embedding", F.lit(None).cast("array<double>")), F.concat_ws(": ", "name", "summary"), embed)
    added = integration.extracted_concepts(stash(found, "sync-found"))
    books = papers.select(F.concat(F.lit("book:"), "paper_id").alias("id"), F.lit("Book").alias("type"), F.col("title").alias("name"))
    texts = chunks.select(F.concat(F.lit("chunk:"), "chunk_id").alias("id"), F.lit("Chunk").alias("type"), "text", "embedding")
    touched = stash(linked.edges.unionByName(added.edges, allowMissingColumns=True).where("relation = 'SUPPORTED_BY'").select(F.col("src").alias("id")).distinct(), "sync-touched")
    no_edges = added.edges.limit(0)
    for part in (integration.Additions(books, no_edges), integration.Additions(texts, no_edges), linked, added):
        nodes, edges = merge_graph(nodes, edges, part)
    nodes, edges = stash(nodes, "sync-nodes"), stash(edges, "sync-edges")
    done = resolution.postprocess(nodes, edges, touched=touched)
    return Synced(stash(done.nodes, "sync-nodes"), stash(done.edges, "sync-edges"), papers, counts, queue)
