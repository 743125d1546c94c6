"""Books and listings as tables: files of several formats to sections, catalogue folders, listing pages."""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, urlencode, urljoin, urlsplit, urlunsplit
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.chunking import sections, tidy

COMIC = ["cbz", "cbr", "cb7", "cbt"]


def is_comic(path: Column) -> Column:
    """Whether a file is a book of pictures, by its extension."""
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(COMIC) & F.contains(path, F.lit("."))


_FURNITURE = {"script", "style", "nav", "aside", "header", "footer"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.heads: dict[str, list[str]] = {"h1": [], "h2": [], "h3": []}
        self.closed: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _FURNITURE:
            self.closed.append(tag)
        elif tag in self.heads:
            self.open.append(tag)
            self.heads[tag].append("")

    def handle_endtag(self, tag):
        if tag in _FURNITURE and tag in self.closed:
            while self.closed.pop() != tag:
                pass
        elif tag in self.open:
            self.open.remove(tag)

    def handle_data(self, data):
        if not self.closed:
            self.parts.append(data)
            for tag in self.open:
                self.heads[tag][-1] += data


def html_page(html: str) -> tuple[str | None, str]:
    """(title, text) of a page: the first heading with text, h1 before h2 before h3; furniture is left out."""
    p = _Text()
    p.feed(html)
    p.close()
    title = next((h.strip() for tag in ("h1", "h2", "h3") for h in p.heads[tag] if h.strip()), None)
    return title, tidy("\n".join(x for x in (s.strip() for s in p.parts) if x))


def decode(data: bytes) -> str:
    for code in ("utf-8", "cp1251"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def rtf_text(data: bytes) -> str:
    """Plain text of RTF, by the code page it names."""
    raw = data.decode("latin-1")
    page = re.search(r"\\ansicpg(\d+)", raw)
    code = f"cp{page.group(1)}" if page else "cp1252"
    raw = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", raw)
    raw = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m.group(1)) % 65536), raw)
    raw = re.sub(r"(?:\\'[0-9a-fA-F]{2})+", lambda m: bytes.fromhex(m.group(0).replace("\\'", "")).decode(code, "replace"), raw)
    raw = re.sub(r"\\(?:par|line)\b ?", "\n", raw)
    return tidy(re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", raw)))


def fb2_sections(data: bytes, name: str) -> list[tuple[str, str]]:
    root = ElementTree.fromstring(data)
    flat = lambda e: tidy("\n".join(x for x in (t.strip() for t in e.itertext()) if x))
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for i, s in enumerate((e for e in root.iter() if local(e) == "section"), 1):
        title = next((flat(e) for e in s if local(e) == "title"), f"Section {i}")
        if len(flat(s)) >= 40:
            out.append((title, flat(s)))
    body = next((e for e in root.iter() if local(e) == "body"), None)
    return out or ([(name, flat(body))] if body is not None and len(flat(body)) > 30 else [])


def epub_sections(data: bytes) -> list[tuple[str, str]]:
    """Documents of the table of contents, each once and of 50 characters or more; else those of the spine."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    root = next((e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if tag(e) == "rootfile"), None)
    package = ElementTree.fromstring(z.read(root))
    near = lambda href, base: posixpath.normpath(posixpath.join(posixpath.dirname(base), href.split("#")[0]))
    items = {e.get("id"): (near(e.get("href"), root), e.get("media-type")) for e in package.iter() if tag(e) == "item"}
    out, seen = [], set()
    for path, kind in items.values():
        if kind != "application/x-dtbncx+xml" or path not in names:
            continue
        for point in (e for e in ElementTree.fromstring(z.read(path)).iter() if tag(e) == "navPoint"):
            title = next(("".join(e.itertext()).strip() for e in point if tag(e) == "navLabel"), "")
            href = next((near(e.get("src"), path) for e in point if tag(e) == "content"), "")
            if href in names and href not in seen:
                text = html_page(z.read(href).decode("utf-8", "ignore"))[1]
                if len(text) >= 50:
                    seen.add(href)
                    out.append((title or f"Section {len(out) + 1}", text))
    if not out:
        for ref in (e.get("idref") for e in package.iter() if tag(e) == "itemref"):
            path = items.get(ref, ("", ""))[0]
            if path in names:
                title, text = html_page(z.read(path).decode("utf-8", "ignore"))
                if len(text) >= 50:
                    out.append((title or f"Chapter {len(out) + 1}", text))
    return out


def page_sections(pages: list[str], most: int = 6000) -> list[tuple[str, str]]:
    """Pages gathered until 6,000 characters or the last: `Pages a-b`."""
    out, held, first, size = [], [], 1, 0
    for i, p in enumerate(pages, 1):
        text = tidy(p)
        if text:
            held.append(text)
            size += len(text)
        if held and (size >= most or i == len(pages)):
            out.append((f"Pages {first}-{i}", "\n\n".join(held)))
            held, first, size = [], i + 1, 0
    return out


def file_sections(name: str, data: bytes, depth: int = 0) -> list[tuple[str, str]]:
    """(title, text) of a file by its extension; archives give their largest readable member. Comics and unknown kinds give nothing."""
    stem, _, kind = posixpath.basename(name).rpartition(".")
    kind = kind.lower()
    if kind in ("txt", "md"):
        return sections(decode(data), stem or "Section")
    if kind == "rtf":
        return sections(rtf_text(data), stem or "Section")
    if kind == "fb2":
        return fb2_sections(data, stem)
    if kind == "epub":
        return epub_sections(data)
    if kind in ("html", "htm", "xhtml"):
        title, text = html_page(decode(data))
        return [(title or stem, text)] if text else []
    if depth == 0 and kind == "zip":
        z = zipfile.ZipFile(io.BytesIO(data))
        members = [(i.file_size, i.filename, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir()]
    elif depth == 0 and kind in ("tar", "gz", "tgz"):
        t = tarfile.open(fileobj=io.BytesIO(data))
        members = [(m.size, m.name, lambda m=m: t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
    else:
        return []
    for _, inner, read in sorted(members, key=lambda m: (-m[0], m[1])):
        if found := file_sections(inner, read(), 1):
            return found
    return []


def book_sections(spark: SparkSession, path: str) -> DataFrame:
    """(path, chapter_idx, title, text) of all files under a path; a file that cannot be read gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [(name, i, t, x, None) for i, (t, x) in enumerate(file_sections(name, data), 1)]
                except (ValueError, KeyError, zipfile.BadZipFile, tarfile.TarError, ElementTree.ParseError) as e:
                    rows.append((name, 0, None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "chapter_idx", "title", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, chapter_idx int, title string, text string, error string")


def opf_columns(xml) -> list:
    """Columns of an OPF package: title, authors, description, subjects, identifiers, publication_date."""
    one = lambda name: F.nullif(F.trim(F.xpath_string(xml, F.lit(f"//*[local-name()='{name}'][1]"))), F.lit(""))
    many = lambda name: F.filter(F.transform(F.xpath(xml, F.lit(f"//*[local-name()='{name}']/text()")), lambda x: F.trim(x)), lambda x: x != "")
    date = F.coalesce(T.publication_date(one("date")), T.publication_date(F.array_join(many("identifier"), " ")))
    return [one("title").alias("title"), many("creator").alias("authors"), one("description").alias("description"), many("subject").alias("subjects"), many("identifier").alias("identifiers"), date.alias("publication_date")]


def catalogue(files: DataFrame, index: DataFrame | None = None, opf: DataFrame | None = None) -> DataFrame:
    """One row for each file (path): index rows first, then OPF rows of the same stem, then the file's own name. Ids number the paths in order."""
    from textloom.operators.ranges import numbered

    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    out = files.dropDuplicates(["path"]).withColumn("_stem", stem)
    for name, side in (("i", index), ("o", opf)):
        if side is not None:
            own = side.withColumn("_stem", stem).dropDuplicates(["_stem"]).select("_stem", F.col("title").alias(f"_t{name}"), F.col("authors").alias(f"_a{name}"))
            out = out.join(own, "_stem", "left")
        else:
            out = out.withColumn(f"_t{name}", F.lit(None).cast("string")).withColumn(f"_a{name}", F.lit(None).cast("array<string>"))
    return out.select("path", F.coalesce("_ti", "_to", "_stem").alias("title"), F.coalesce("_ai", "_ao", F.array().cast("array<string>")).alias("authors")).transform(lambda df: numbered(df, ["path"], "book_id"))


class _Listing(HTMLParser):
    """dt and dd of a listing page, with the links, titles, authors and subjects inside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.next: str | None = None
        self.where: list[str] = []
        self.link: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        kind = a.get("class") or ""
        if tag == "dt":
            self.rows.append({"dt": "", "links": [], "title": "", "authors": [], "subjects": "", "primary": ""})
        for name in ("list-title", "list-authors", "list-subjects", "primary-subject", "descriptor"):
            if name in kind.split():
                self.where.append(f"{tag}:{name}")
                break
        else:
            if tag in ("dt", "dd", "div", "span"):
                self.where.append(f"{tag}:")
        if tag == "a":
            self.link = {"href": a.get("href") or "", "text": ""}

    def handle_endtag(self, tag):
        if tag == "a" and self.link is not None:
            inside = [w.split(":")[1] for w in self.where]
            if self.rows and "dt" in [w.split(":")[0] for w in self.where]:
                self.rows[-1]["links"].append(self.link)
            elif self.rows and "list-authors" in inside and self.link["text"].strip():
                self.rows[-1]["authors"].append(self.link["text"].strip())
            elif self.link["text"].strip().lower() in ("next", "next page", ">"):
                self.next = self.link["href"]
            self.link = None
        elif tag in ("dt", "dd", "div", "span"):
            while self.where and self.where.pop().split(":")[0] != tag:
                pass

    def handle_data(self, data):
        if self.link is not None:
            self.link["text"] += data
        if not self.rows:
            return
        inside = [w.split(":")[1] for w in self.where]
        if "dt" in [w.split(":")[0] for w in self.where]:
            self.rows[-1]["dt"] += data
        elif "descriptor" in inside:
            return
        elif "list-title" in inside:
            self.rows[-1]["title"] += data
        elif "list-subjects" in inside:
            self.rows[-1]["subjects"] += data
            if "primary-subject" in inside:
                self.rows[-1]["primary"] += data


def listing(html: str, url: str) -> tuple[list[dict], str | None]:
    """Articles of a dt/dd listing page and the next page's address."""
    p = _Listing()
    p.feed(html)
    out = []
    for r in p.rows:
        found = re.search(r"(\d{4}\.\d{4,5})(?:v\d+)?", " ".join([x["text"] for x in r["links"] if "/abs/" in x["href"]] + [r["dt"]]))
        if not found:
            continue
        id_ = found.group(1)
        formats = list(dict.fromkeys("pdf" if "/pdf/" in x["href"] else x["text"].strip().lower() for x in r["links"] if "/pdf/" in x["href"] or x["text"].strip().lower() in ("pdf", "html", "other")))
        pdf = next((urljoin(url, x["href"]) for x in r["links"] if "/pdf/" in x["href"]), urljoin(url, f"/pdf/{id_}"))
        codes = list(dict.fromkeys(re.findall(r"\(([a-zA-Z\-]+(?:\.[a-zA-Z\-]+)?)\)", r["subjects"])))
        named = re.search(r"/list/([a-zA-Z\-]+(?:\.[a-zA-Z\-]+)?)/", url)
        title = re.sub(r"(?i)^title:\s*", "", re.sub(r"\s+", " ", r["title"]).strip())
        out.append({"paper_id": id_, "title": title or f"Paper {id_}", "authors": list(dict.fromkeys(r["authors"])), "primary_category": r["primary"].strip() or (codes[0] if codes else named.group(1) if named else "General"), "categories": codes, "abstract_url": urljoin(url, f"/abs/{id_}"), "pdf_url": pdf, "formats": formats or ["pdf"]})
    return out, urljoin(url, p.next) if p.next else None


class _Results(HTMLParser):
    """Items of a search page: a tree of the elements inside each result, and the page's links and texts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.open: list[dict] = []
        self.next: dict | None = None
        self.texts: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        node = {"tag": tag, "kinds": a.get("class", "").split(), "href": a.get("href", ""), "text": "", "inner": []}
        if tag in _VOID:
            return
        if tag == "li" and "arxiv-result" in node["kinds"]:
            self.items.append(node)
            self.open = [node]
        else:
            if tag == "a" and "pagination-next" in node["kinds"] and self.next is None:
                self.next = node
            if self.open:
                self.open[-1]["inner"].append(node)
                self.open.append(node)

    def handle_endtag(self, tag):
        if any(n["tag"] == tag for n in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        self.texts.append(data)
        if self.open:
            self.open[-1]["inner"].append(data)


_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _said(node: dict | None, without: str = "") -> str:
    """The text of an element, without the parts of a class."""
    if node is None:
        return ""
    return "".join(x if isinstance(x, str) else "" if without and without in x["kinds"] else _said(x, without) for x in node["inner"])


def _inside(node: dict, tag: str, kind: str = "") -> list[dict]:
    found = []
    for x in node["inner"]:
        if isinstance(x, dict):
            if x["tag"] == tag and (not kind or any(kind in k for k in x["kinds"])):
                found.append(x)
            found += _inside(x, tag, kind)
    return found


def search_results(html: str, url: str) -> tuple[list[dict], str | None]:
    """Articles of a search page, with their abstracts, and the next page's address: its link, else the next start while results are left."""
    p = _Results()
    p.feed(html)
    p.close()
    flat = lambda s: re.sub(r"\s+", " ", s).strip()
    kinds = {"/pdf/": "pdf", "/format/": "other", "/ps/": "ps", "/html/": "html"}
    out = []
    for item in p.items:
        links = [a for head in _inside(item, "p", "list-title")[:1] for a in _inside(head, "a")]
        about = next((a for a in links if "/abs/" in a["href"]), None)
        found = about and (re.search(r"/abs/([a-zA-Z0-9.\-_/]+)", about["href"]) or re.search(r"(\d{4}\.\d{4,5}(?:v\d+)?)", _said(about)))
        found = found or re.search(r"arXiv:(\d{4}\.\d{4,5}(?:v\d+)?)", _said(item))
        if not found:
            continue
        id_ = re.sub(r"v\d+$", "", found.group(1))
        formats, pdf = [], ""
        for a in links:
            name = next((k for part, k in kinds.items() if part in a["href"]), _said(a).strip().lower())
            if name in kinds.values() and name not in formats:
                formats.append(name)
            pdf = urljoin(url, a["href"]) if name == "pdf" else pdf
        title = flat(_said(next((x for x in _inside(item, "p", "title") if "title" in x["kinds"]), None), "descriptor"))
        title = title[6:].strip() if title.lower().startswith("title:") else title
        people = [flat(_said(a)) for x in _inside(item, "p", "authors")[:1] for a in _inside(x, "a")]
        topics = list(dict.fromkeys(t for x in _inside(item, "div", "tags")[:1] for s in _inside(x, "span", "tag") if (t := flat(_said(s)))))
        body = next(iter(_inside(item, "p", "abstract")), None)
        if body is not None:
            body = next(iter(_inside(body, "span", "abstract-full") or _inside(body, "span", "abstract-short")), body)
        abstract = re.sub(r"(?:▽|△)\s*(?:More|Less)", "", re.sub(r"^[Aa]bstract:\s*", "", flat(_said(body)))).strip()
        out.append({"paper_id": id_, "title": title or f"Paper {id_}", "authors": list(dict.fromkeys(x for x in people if x)), "primary_category": topics[0] if topics else "General", "categories": topics, "abstract": abstract, "abstract_url": urljoin(url, about["href"] if about else f"/abs/{id_}"), "pdf_url": pdf or urljoin(url, f"/pdf/{id_}"), "formats": formats if "pdf" in formats else [*formats, "pdf"]})
    if p.next is not None and p.next["href"].strip() and not {"is-invisible", "disabled"} & set(p.next["kinds"]):
        return out, urljoin(url, p.next["href"].strip())
    parts = urlsplit(url)
    asked = {k: v[0] for k, v in parse_qs(parts.query).items()}
    number = lambda k, default: int(asked[k]) if asked.get(k, "").isdigit() else default
    after = number("start", 0) + number("size", len(out) or 100)
    total = re.search(r"(?i)Showing\s+\d+[–\-]\d+\s+of\s+([\d,]+)\s+results", " ".join(p.texts))
    if total and after < int(total.group(1).replace(",", "")):
        return out, urlunsplit(parts._replace(query=urlencode(asked | {"start": str(after)})))
    return out, None


def any_page(html: str, url: str) -> tuple[list[dict], str | None]:
    """Articles of a listing or a search page, whichever it is."""
    if "/search" in url or re.search(r"""<li[^>]*class=["'][^"']*arxiv-result""", html):
        return search_results(html, url)
    articles, after = listing(html, url)
    return [a | {"abstract": ""} for a in articles], after


def crawl(pages: DataFrame, known: DataFrame | None = None, exact: str | None = None, limit: int | None = None, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(wanted, counts): the articles of pages (in order of address) that are to be fetched, and one row of counts.

    exact: only articles with that word or phrase in title or abstract, whatever its case. known (paper_id): papers that are
    there already; they count as existing. limit: so many new articles, first page first: the caller's own limit.
    """
    found = listings(pages, url, html)
    if exact and exact.strip().strip('"'):
        word = re.escape(exact.strip().strip('"'))
        found = found.where(F.concat_ws(" ", "title", "abstract").rlike(rf"(?i)\b{word}\b"))
    fresh = found if known is None else found.join(known.select("paper_id").distinct(), "paper_id", "left_anti")
    wanted = fresh if limit is None else fresh.orderBy("page", "paper_id").limit(limit)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(pages, "pages").join(n(found, "inspected"), F.lit(True)).join(n(fresh, "new"), F.lit(True)).join(n(wanted, "wanted"), F.lit(True))
    return wanted, counts.withColumn("existing", F.col("inspected") - F.col("new"))


def listings(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Articles of all listing and search pages, each paper once (the first page by address)."""
    kind = "paper_id string, title string, authors array<string>, primary_category string, categories array<string>, abstract string, abstract_url string, pdf_url string, formats array<string>, page string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("paper_id", pa.string()), ("title", pa.string()), ("authors", pa.list_(pa.string())), ("primary_category", pa.string()), ("categories", pa.list_(pa.string())), ("abstract", pa.string()), ("abstract_url", pa.string()), ("pdf_url", pa.string()), ("formats", pa.list_(pa.string())), ("page", pa.string())]
        for batch in batches:
            rows = [a | {"page": u} for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a in any_page(h or "", u or "")[0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in fields], [n for n, _ in fields])

    found = pages.select(F.col(url), F.col(html)).mapInArrow(run, kind)
    rest = [c for c in found.columns if c != "paper_id"]
    return found.groupBy("paper_id").agg(F.min_by(F.struct(*rest), "page").alias("r")).select("paper_id", *(F.col(f"r.{c}").alias(c) for c in rest))


# Which characters make up a piece of misread text.
_MISREAD = re.compile("(?<![a-zA-Z])[\u0080-\u00ff\u0192\u201a\u201e\u2026\u2020\u2021\u20ac\u2030\u2039\u203a\u2122]+(?![a-zA-Z])")
_MISREAD_CYRILLIC = re.compile("[РрСс][\u0080-\u00ff\u0400-\u04ff]+")
_CYRILLIC = re.compile("[\u0400-\u04ff]")
_VOWEL = re.compile("[аеёиоуыэюяАЕЁИОУЫЭЮЯ]")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def _cyrillic(s: str) -> int:
    return len(_CYRILLIC.findall(s))


def _word(was: str, now: str) -> bool:
    """Plausible as a Russian word: two Cyrillic letters or more, among them a vowel, and mostly such."""
    return _cyrillic(now) >= 2 and bool(_VOWEL.search(now)) and _cyrillic(now) >= 0.7 * len(now)


#: Attempts in order, as (written as, to be read as, whether the new reading is taken). Of a step's attempts the first taken counts.
_WHOLE = [
    [("cp1252", "utf-8", lambda s, t: _cyrillic(t) > _cyrillic(s)), ("latin1", "utf-8", lambda s, t: _cyrillic(t) > _cyrillic(s))],
    [("latin1", "cp1251", lambda s, t: _cyrillic(t) > _cyrillic(s) and _cyrillic(t) >= 0.5 * len(s.strip()))],
    [("cp1251", "utf-8", lambda s, t: len(t) < len(s) and _cyrillic(t) > 0)],
]
_PIECE = [
    ("cp1252", "utf-8", lambda s, t: _cyrillic(t) > 0), ("latin1", "utf-8", lambda s, t: _cyrillic(t) > 0), ("latin1", "cp1251", lambda s, t: len(s) >= 2 and _word(s, t)),
    ("cp1252", "cp1251", lambda s, t: len(s) >= 2 and _word(s, t)), ("cp1251", "utf-8", lambda s, t: _cyrillic(t) > 0 and len(t) < len(s)),
]


def _reread(s: str, attempts: list[tuple]) -> str:
    for written, read, taken in attempts:
        try:
            t = s.encode(written).decode(read)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if taken(s, t):
            return t
    return s


def repair(text: str) -> str:
    """Text whose bytes were read in the wrong code page, read again: as a whole, then piece by piece. Control characters go."""
    s = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    for step in _WHOLE:
        s = _reread(s, step)
    for pieces in (_MISREAD, _MISREAD_CYRILLIC):
        s = pieces.sub(lambda m: _reread(m.group(0), _PIECE), s)
    return _CONTROL.sub("", s)


def repair_column(df: DataFrame, column: str) -> DataFrame:

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else v if v.isascii() and not _CONTROL.search(v) else repair(v))

    return df.withColumn(column, run(F.col(column)))
