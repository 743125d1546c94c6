import json

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import cascade, sync
from textloom.sources import library as L
from textloom.sources.books import is_comic

from .test_states import PAGE


def made(spark):
    return L.Library(
        spark.createDataFrame([(1, "One", "a/b", "2001-02-03 00:00:00"), (2, None, None, "0101-01-01")], "id long, title string, path string, pubdate string"), spark.createDataFrame([(1, 1, 20), (2, 1, 10)], "id long, book long, author long"),
        spark.createDataFrame([(10, "Ann"), (20, "Bob & Cy")], "id long, name string"), spark.createDataFrame([(1, "c")], "book long, text string"), spark.createDataFrame([(1, "pdf"), (1, "epub"), (2, "")], "book long, format string"),
    )


def test_listing_and_updates(spark, tmp_path):
    rows = {r.id: r for r in L.list_books(made(spark), "/lib").collect()}
    assert (rows[1].authors, rows[1].formats, rows[1].path, rows[1].publication_date, rows[1].comments) == (["Bob", "Cy", "Ann"], ["EPUB", "PDF"], "/lib/a/b", "2001-02-03", "c")
    assert (rows[2].title, rows[2].authors, rows[2].formats, rows[2].publication_date) == ("Untitled", [], [], None)
    changes = spark.createDataFrame([(1, " New ", ["Dee", "Ann"], None), (2, None, None, " said "), (9, "x", ["y"], "z")], "book long, title string, authors array<string>, comments string")
    after = L.update_metadata(made(spark), changes)
    rows = {r.id: r for r in L.list_books(after).collect()}
    assert set(rows) == {1, 2} and (rows[1].title, rows[1].authors, rows[1].comments) == ("New", ["Dee", "Ann"], "c") and (rows[2].title, rows[2].comments) == ("Untitled", "said")
    assert {r.name for r in after.authors.collect()} == {"Ann", "Bob & Cy", "Dee"} and after.comments.count() == 2
    (tmp_path / "l.json").write_text(json.dumps([{"id": 4, "title": "", "authors": "A & B", "pubdate": "", "publication_date": "1999", "formats": ["X"]}]))
    r = L.list_books_json(spark, f"{tmp_path}/l.json").first()
    assert (r.id, r.title, r.authors, r.publication_date, r.formats) == (4, "Untitled", ["A", "B"], "1999", ["X"])
    assert [r.x for r in spark.createDataFrame([("a/b.CBZ",), ("cbz",), ("a.pdf",)], "p string").select(is_comic(F.col("p")).alias("x")).collect()] == [True, False, False]


def test_conveyor_switches(spark):
    rows = [(1, "", "S", [1.0, 0.0]), (2, "MIT License text", "S", [1.0, 0.0]), (3, "plain one", "S", [1.0, 0.0]), (4, "plain two", "S", [1.0, 0.0]), (5, "plain three", "References", [0.0, 1.0]), (6, "E = m c", "S", [1.0, 0.0])]
    df = spark.createDataFrame([("b", 1, *r) for r in rows], "book string, chapter_idx int, i int, text string, section_title string, embedding array<double>")
    at = lambda **k: [r.category for r in cascade.conveyor(df, "book", ["i"], section="section_title", **k).orderBy("i").collect()]
    assert at() == ["empty", "tech_boiler", "passed", "passed", "ref_sections", "formulas"]
    assert at(skip_technical_boilerplate=False, skip_reference_sections=False, detect_formulas=False) == ["empty", "passed", "passed", "passed", "passed", "passed"]
    assert at(chunk_similarity=True) == ["empty", "tech_boiler", "passed", "chunk_sim", "ref_sections", "formulas"]
    ideas = spark.createDataFrame([("x", [1.0, 0.75])], "idea_id string, embedding array<double>")
    assert at(ideas=ideas) == ["empty", "tech_boiler", "limbo", "limbo", "ref_sections", "formulas"] and at(ideas=ideas, skip_limbo=False)[2] == "passed" and at(ideas=ideas, high=0.79)[2] == "limbo"
    assert [r.x for r in df.orderBy("i").select(cascade.boilerplate_only(F.col("text"), F.col("section_title")).alias("x")).collect()] == [True, True, False, False, True, False]
    try:
        cascade.conveyor(df, skip_nothing=True)
        raise AssertionError
    except ValueError:
        pass


def test_daily_sync(spark):
    nodes = spark.createDataFrame([("book:2101.00002", "Book", "Old", None, None, None, None, None, None), ("concept:Water", "Concept", "Water", "wet", "wet stuff", 5, "2000-01", [1.0, 0.0], 1)], "id string, type string, name string, brief string, detail string, weight int, month string, embedding array<double>, occurrences long")
    edges = spark.createDataFrame([], "src string, dst string, relation string")
    pages = spark.createDataFrame([("https://x.org/search/?a", PAGE)], "url string, html string")

    def fetch(papers):
        texts = spark.createDataFrame([(1, "All about water and more of it here"), (2, "fire burns what it can find there"), (3, "")], "chunk_idx int, text string")
        return papers.crossJoin(F.broadcast(texts)).select(F.concat_ws("-", "paper_id", "chunk_idx").alias("chunk_id"), F.col("paper_id").alias("book_id"), F.lit(1).alias("chapter_idx"), "chunk_idx", F.lit("Body").alias("section_title"), "text", F.lit("2021-01").alias("publication_date"))

    embed = lambda texts: [np.array([float("water" in t.lower()), float("fire" in t.lower())]) + 1e-3 for t in texts]
    extract = lambda queue: queue.select("chunk_id", "book_id", "publication_date", F.lit("Fire").alias("name"), F.lit("hot fire").alias("summary"), *(F.lit("").alias(c) for c in ("brief", "detail", "category", "quote")), F.lit(5).alias("weight"))
    out = sync.daily_sync(nodes, edges, pages, fetch, embed, extract)
    assert [r.paper_id for r in out.papers.collect()] == ["2101.00001"] and out.counts.first().existing == 1
    assert [r.chunk_id for r in out.queue.collect()] == ["2101.00001-2"]
    ids = {r.id: r for r in out.nodes.collect()}
    assert {"book:2101.00001", "book:2101.00002", "concept:Water", "concept:Fire", "chunk:2101.00001-1", "chunk:2101.00001-2"} == set(ids) and ids["concept:Fire"].postprocessed
    links = {(r.src, r.dst, r.relation) for r in out.edges.collect()}
    assert {("concept:Water", "chunk:2101.00001-1", "SUPPORTED_BY"), ("chunk:2101.00001-2", "concept:Fire", "SUPPORTS_IDEA"), ("book:2101.00001", "concept:Fire", "EXPLORES_IDEA")} <= links
    again = sync.daily_sync(out.nodes, out.edges, pages, fetch, embed, extract)
    assert again.papers.count() == 0 and again.nodes.count() == len(ids)
