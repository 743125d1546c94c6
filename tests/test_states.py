import json

from pyspark.sql import functions as F

from textloom.sources import books as B
from textloom.sources import sinks, states


def write(path, name, data):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(data if isinstance(data, str) else json.dumps(data))


def book(i, chunks, date=None):
    made = [{"chunk_id": f"{i}-{k}", "chunk_idx": k, "section_title": "S", "text": f"text {k}", "embedding": [float(k), 1.0]} for k in range(chunks)]
    idea = lambda n, q="", r=(): {"name": n, "supporting_quote": q, "related_concepts": list(r)}
    done = {f"{i}-0": {"status": "extracted", "extraction": {"concepts": [idea(" Alpha ", "quote", ["Beta", " "]), idea("")], "extracted_ideas": [{"idea_statement": "A claim"}]}}, f"{i}-1": {"extraction": {"concepts": []}, "cached_extraction": {"concepts": [idea("Gamma")]}}}
    return {"book_id": str(i), "book_title": f"Book {i}", "publication_date": date, "chunks": made, "processed_chunks": done}


def folder(tmp_path):
    write(tmp_path / "s" / ".book_states", "book_1_state.json", book(1, 4, "2001-02"))
    write(tmp_path / "s", "book_2_state.json", book(2, 2))
    write(tmp_path / "s", "book_3_state.json", "no json {")
    write(tmp_path / "s", "other.json", {"book_id": "9"})
    return str(tmp_path / "s")


def test_states_ideas_and_simulation(spark, tmp_path):
    state = states.states(spark, folder(tmp_path))
    assert {r.book_id for r in state.where("chunks is not null").collect()} == {"1", "2"}
    assert states.state_chunks(state).count() == 6
    ideas = {(r.book_id, r.chunk_id, r.name, r.quote_weight) for r in states.raw_ideas(state).collect()}
    assert ideas == {(b, f"{b}-{k}", n, w) for b in "12" for k, n, w in ((0, "Alpha", 5), (1, "Gamma", 100))}
    assert states.raw_ideas(state, "1", spark.createDataFrame([("1-0",)], "chunk_id string")).first().name == "Gamma"
    graph = tmp_path / "g.json"
    graph.write_text(json.dumps({"nodes": [{"id": "concept:Alpha", "name": "Alpha", "type": "Concept", "embedding": [1, 2]}, {"id": "chunk:1-0", "type": "Chunk", "embedding": [9, 9]}], "edges": [{"source": "concept:Alpha", "target": "chunk:1-0", "relation": "SUPPORTED_BY"}]}))
    nodes, edges = states.graph_file(spark, str(graph))
    assert nodes.count() == 2 and edges.first().dst == "chunk:1-0"
    chunks, vectors = states.simulation_data(spark, folder(tmp_path), (nodes, edges), max_books=1)
    assert {r.book_id for r in chunks.collect()} == {"1"} and chunks.where("chunk_id = '1-0'").first().names == ["alpha"] and vectors.first().name == "alpha"
    assert states.simulation_data(spark, folder(tmp_path))[1].count() == 0


def test_reference_data(spark, tmp_path):
    write(tmp_path / "r", "book_5_state.json", book(5, 9))
    state = states.states(spark, str(tmp_path / "r"))
    chunks, ideas, relations = states.reference_data(state, most=4)
    assert sorted(r.chunk for r in chunks.collect()) == ["5-0", "5-2", "5-4", "5-6"]  # every second one, four of them
    assert {r.idea for r in ideas.collect()} == {"Alpha", "A claim"} and [(r.a, r.b) for r in relations.collect()] == [("Alpha", "Beta")]


def test_chunks_are_saved_and_read(spark, tmp_path):
    rows = [("1", "T", 1, i, f"c{i}", f"text\n{i}", [0.5, float(i)]) for i in range(3)] + [("2", "U", 1, 0, "d0", None, None)]
    df = spark.createDataFrame(rows, "book_id string, book_title string, chapter_idx int, chunk_idx int, chunk_id string, text string, embedding array<double>")
    states.save_chunks(df, f"{tmp_path}/chunks")
    back = states.chunk_files(spark, f"{tmp_path}/chunks")
    assert {(r.book_id, r.book_title, r.chunk_idx, r.chunk_id, r.text, tuple(r.embedding or ())) for r in back.collect()} == {(b, t, i, c, x, tuple(e or ())) for b, t, _, i, c, x, e in rows}


PAGE = """<html><h1>Showing 1–2 of 1,240 results</h1><ol>
<li class="arxiv-result"><div><p class="list-title is-inline-block"><a href="https://x.org/abs/2101.00001v2">arXiv:2101.00001</a><span>[<a href="/pdf/2101.00001">pdf</a>, <a href="/format/2101.00001">other</a>]</span></p>
<div class="tags is-inline-block"><span class="tag is-small">cs.LG</span><span class="tag">cs.AI</span></div></div><p class="title is-5">Title: Deep  <span>Water</span><br> Things</p>
<p class="authors"><span>Authors:</span> <a href="#">Ann B</a>, <a href="#">Cee D</a>, <a href="#">Ann B</a></p><p class="abstract"><span class="abstract-short">Short...</span><span class="abstract-full">Abstract: All about water. △ Less</span></p></li>
<li class="arxiv-result"><p class="list-title">arXiv:2101.00002v1</p></li><li class="arxiv-result"><p>nothing</p></li></ol></html>"""


def test_search_pages(spark):
    found, after = B.any_page(PAGE, "https://x.org/search/?query=water&start=0&size=50")
    assert [a["paper_id"] for a in found] == ["2101.00001", "2101.00002"] and after.endswith("query=water&start=50&size=50")
    a = found[0]
    assert (a["title"], a["authors"], a["categories"], a["primary_category"], a["formats"], a["abstract"]) == ("Deep Water Things", ["Ann B", "Cee D"], ["cs.LG", "cs.AI"], "cs.LG", ["pdf", "other"], "All about water.")
    assert found[1]["title"] == "Paper 2101.00002" and found[1]["pdf_url"] == "https://x.org/pdf/2101.00002" and found[1]["formats"] == ["pdf"]
    link = PAGE.replace("</html>", '<a class="pagination-next" href="/search/?start=9">Next</a></html>')
    assert B.any_page(link, "https://x.org/search/")[1] == "https://x.org/search/?start=9"
    assert B.any_page(link.replace("pagination-next", "pagination-next is-invisible"), "https://x.org/search/?start=1300")[1] is None
    pages = spark.createDataFrame([("https://x.org/search/?a", PAGE), ("https://x.org/search/?b", PAGE), ("u", None)], "url string, html string")
    wanted, counts = B.crawl(pages, spark.createDataFrame([("2101.00002",)], "paper_id string"))
    c = counts.first()
    assert [r.paper_id for r in wanted.collect()] == ["2101.00001"] and (c.pages, c.inspected, c.new, c.existing, c.wanted) == (3, 2, 1, 1, 1)
    assert B.crawl(pages, exact='"WATER"', limit=5)[0].count() == 1 and B.crawl(pages, exact="wate")[0].count() == 0


def test_shards_notes_and_statistics(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Book", "1"), ("b", "Chunk", "1"), ("c", "Concept", None), ("d", "Chunk", "2")], "id string, type string, book string")
    edges = spark.createDataFrame([("a", "b", "HAS", "1"), ("b", "c", "SUPPORTS", None)], "src string, dst string, relation string, book string")
    plan = spark.createDataFrame([("1", 0), ("2", 1)], "book string, shard long")
    listed = {r.part: (r.nodes, r.edges) for r in sinks.save_shards(nodes, edges, plan, f"{tmp_path}/g").collect()}
    assert listed == {"spine": (1, 1), "shard_0": (2, 1), "shard_1": (1, 0)}
    n, e = sinks.load_shards(spark, f"{tmp_path}/g", ["shard_0"])
    assert {r.id for r in n.collect()} == {"a", "b", "c"} and e.count() == 2 and sinks.load_shards(spark, f"{tmp_path}/g")[0].count() == 4
    books = spark.createDataFrame([("1", "My: Book", None, "about")], "id string, title string, author string, summary string")
    sections = spark.createDataFrame([("s1", "1", "One", None), ("s2", None, "Two", "x")], "id string, book string, title string, summary string")
    got = {r.file: r.note for r in sinks.book_notes(books, sections, spark.createDataFrame([("s1", "Idea"), ("s1", "Idea"), ("s1", "A/B")], "section string, name string")).collect()}
    assert "## Sections\n- [[One]]" in got["My Book.md"] and got["My Book - One.md"].endswith("## Ideas\n- [[AB]]\n- [[Idea]]") and "Book - Two.md" in got
    sinks.save_statistics({"space": spark.createDataFrame([(1.5, "x")], "coverage double, name string"), "none": spark.createDataFrame([], "a int")}, f"{tmp_path}/stats")
    assert json.loads(spark.read.text(f"{tmp_path}/stats/json").first().value) == {"space": {"coverage": 1.5, "name": "x"}, "none": {}}
    assert "| space | coverage | 1.5 |" in [r.value for r in spark.read.text(f"{tmp_path}/stats/markdown").collect()]
    assert [(r.place, r.line) for r in sinks.notes_index(spark.createDataFrame([("a", 1), ("b", 9), ("c", None), ("d", 9)], "name string, weight int")).orderBy("place").collect()] == [(1, "- [[b]]"), (2, "- [[d]]"), (3, "- [[a]]"), (4, "- [[c]]")]
    assert sinks.book_list({"nodes": nodes.withColumn("name", F.lit("t"))}).first().book_id == "a"


def test_misread_pieces():
    read = lambda s, w, r: s.encode(w).decode(r)
    assert B.repair(read("Супермен", "utf-8", "latin1")) == "Супермен" and B.repair(read("Расписку", "cp1251", "latin1")) == "Расписку"
    assert B.repair("see " + read("Скамью", "cp1251", "latin1") + " there") == "see Скамью there"
    assert B.repair("word " + read("Привет", "utf-8", "cp1251") + "!") == "word Привет!"
    assert B.repair("Café à la crème, naïve — fine…") == "Café à la crème, naïve — fine…" and B.repair("a\x00b\x07\n") == "ab\n" and B.repair("\ud83d") == "�"
