import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from textloom.sources import books as B
from textloom.sources import sinks as S

LONG = "This is a sentence that is long enough to be kept as a section of its own. "
HTML = f"<html><head><script>var a=1;</script></head><body><nav>menu</nav><h2>Second</h2><h1> First &amp; best </h1><p>{LONG}</p><footer>end</footer></body></html>"


def epub(toc=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        ncx = '<item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/>' if toc else ""
        z.writestr("OPS/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/>{ncx}</manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("OPS/t.ncx", '<ncx xmlns="urn:n"><navMap><navPoint><navLabel><text>Named</text></navLabel><content src="a.xhtml#x"/></navPoint><navPoint><navLabel><text>Again</text></navLabel><content src="a.xhtml"/></navPoint></navMap></ncx>')
        z.writestr("OPS/a.xhtml", HTML)
    return out.getvalue()


def test_html_page():
    title, text = B.html_page(HTML)
    assert title == "First & best" and "menu" not in text and "var a" not in text and "end" not in text.split() and LONG.strip() in text


def test_formats(spark, tmp_path):
    files = {
        "a.txt": ("# One\n" + LONG + "\n# Two\n" + LONG).encode(), "b.rtf": rb"{\rtf1\ansicpg1251{\fonttbl{\f0 X;}}\'cf\'f0\'e8\'e2\'e5\'f2 \u1084?\u1080?\u1088? and more text here\par line}",
        "c.fb2": f'<FictionBook><body><section><title><p>T</p></title><p>{LONG}</p></section><section><p>x</p></section></body></FictionBook>'.encode(),
        "d.epub": epub(), "e.epub": epub(False), "f.cbz": b"zz", "g.epub": b"broken", "h.html": HTML.encode(), "i.txt": "Привет, это текст подлиннее".encode("cp1251"),
    }
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as out:
        out.writestr("small.bin", b"1")
        out.writestr("in.txt", LONG)
    files["j.zip"] = z.getvalue()
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as out:
        info = tarfile.TarInfo("in.txt")
        info.size = len(LONG)
        out.addfile(info, io.BytesIO(LONG.encode()))
    files["k.tar"] = t.getvalue()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = B.book_sections(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.chapter_idx):
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    titles = {k: [r.title for r in v] for k, v in got.items()}
    assert titles["a.txt"] == ["One", "Two"] and titles["c.fb2"] == ["T"] and titles["d.epub"] == ["Named"] and titles["e.epub"] == ["First & best"]
    assert "Привет мир" in got["b.rtf"][0].text and got["i.txt"][0].text.startswith("Привет") and "f.cbz" not in got
    assert got["g.epub"][0].error and got["h.html"][0].title == "First & best" and got["j.zip"][0].text == LONG.strip() == got["k.tar"][0].text


def test_pages():
    assert [t for t, _ in B.page_sections(["a" * 4000, "b" * 3000, "", "c"])] == ["Pages 1-2", "Pages 3-4"]


def test_opf_round_trip_and_catalogue(spark):
    art = spark.createDataFrame([("2401.00001", 'A & "B"', ["X Y", "Z"], "cs.AI", ["cs.AI", "cs.LG"], "About", "http://a"), ("2401.00002", "T", [], "c", [], None, None)], "paper_id string, title string, authors array<string>, primary_category string, categories array<string>, abstract string, abstract_url string")
    back = S.opf(art).select("paper_id", *B.opf_columns(F.col("opf"))).orderBy("paper_id").collect()
    assert (back[0].title, back[0].authors, back[0].subjects, back[0].publication_date) == ('A & "B"', ["X Y", "Z"], ["cs.AI", "cs.LG"], "2024-01")
    assert back[1].authors == ["Unknown Author"]
    files = spark.createDataFrame([("/x/a.pdf",), ("/x/b.pdf",), ("/x/a.pdf",)], "path string")
    index = spark.createDataFrame([("/x/a.pdf", "From index", ["I"])], "path string, title string, authors array<string>")
    side = spark.createDataFrame([("/x/b.opf", "From package", ["P"])], "path string, title string, authors array<string>")
    assert [(r.book_id, r.title) for r in B.catalogue(files, index, side).orderBy("book_id").collect()] == [(1, "From index"), (2, "From package")]


def test_listing(spark):
    one = '<dt><a href="/abs/2401.00001v2" title="Abstract">arXiv:2401.00001v2</a> [<a href="/pdf/2401.00001">pdf</a>, <a href="/x">other</a>]</dt><dd><div class="list-title"><span class="descriptor">Title:</span> A study</div><div class="list-authors"><a>Ann A</a>, <a>Bob B</a>, <a>Ann A</a></div><div class="list-subjects"><span class="primary-subject">AI (cs.AI)</span>; Learning (cs.LG)</div></dd>'
    html = f'<dl>{one}<dt>nothing</dt><dd></dd></dl><a href="?skip=50">Next</a>'
    rows, after = B.listing(html, "https://x.org/list/cs.AI/recent")
    r = rows[0]
    assert len(rows) == 1 and (r["paper_id"], r["title"], r["authors"], r["categories"], r["formats"]) == ("2401.00001", "A study", ["Ann A", "Bob B"], ["cs.AI", "cs.LG"], ["pdf", "other"])
    assert after == "https://x.org/list/cs.AI/recent?skip=50"
    pages = spark.createDataFrame([("u1", html), ("u2", html), ("u3", None)], "url string, html string")
    assert [x.page for x in B.listings(pages).collect()] == ["u1"]


def test_repair(spark):
    word = "Супермен"
    for bad in (word.encode().decode("latin1"), word.encode("cp1251").decode("latin1"), word):
        assert B.repair(bad) == word
    assert B.repair("Café naïve\x00 ok") == "Café naïve ok"
    df = spark.createDataFrame([("plain",), (None,), (word.encode().decode("latin1"),)], "t string")
    assert [r.t for r in B.repair_column(df, "t").collect()] == ["plain", None, word]


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("book:1", "Book", "A<b>", 1.0), ("concept:x", "Concept", "X", 5.0)], "id string, type string, name string, weight double")
    edges = spark.createDataFrame([("book:1", "concept:x", "EXPLORES_IDEA")], "src string, dst string, relation string")
    S.save_graph(nodes, edges, f"{tmp_path}/g", 2)
    n, e = S.load_graph(spark, f"{tmp_path}/g")
    assert n.count() == 2 and sorted(map(tuple, e.select("src", "dst", "relation").collect())) == [("book:1", "concept:x", "EXPLORES_IDEA")]
    from xml.etree import ElementTree

    for write, name in ((S.write_graphml, "m"), (S.write_gexf, "x")):
        write(nodes, edges, f"{tmp_path}/{name}")
        text = "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        tags = [t.tag.rsplit("}", 1)[-1] for t in ElementTree.fromstring(text).iter()]
        assert tags.count("node") == 2 and tags.count("edge") == 1


def test_notes(spark):
    c = spark.createDataFrame([("a", "Alpha: one", 3, "sum"), ("b", "Beta", None, None)], "id string, name string, weight int, summary string")
    links = spark.createDataFrame([("a", "b")], "src string, dst string")
    got = {r.file: r.note for r in S.notes(c, links).collect()}
    assert got["Alpha one.md"].endswith("# Alpha: one\n\nsum\n\n## Related\n- [[Beta]]") and "Beta.md" in got
    assert [r.line for r in S.notes_index(c).orderBy("place").collect()] == ["- [[Alpha one]]", "- [[Beta]]"]


def test_backup(spark, tmp_path):
    S.backup({"t": spark.range(5).coalesce(1)}, str(tmp_path))
    assert {r.state for r in S.verify_backup(spark, str(tmp_path)).collect()} == {"intact"}
    part = next((tmp_path / "data" / "t").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"x")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert "changed" in {r.state for r in S.verify_backup(spark, str(tmp_path)).collect()}
