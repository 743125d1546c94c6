"""Queries on texts: documents are books, their lines chunks; pages are HTML books; conversations are ordered chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import patterns as P
from textloom.functions import text as T
from textloom.operators import cascade
from textloom.plans.catalog import query
from textloom.sources.tables import spread, table


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all documents: doc_id, chunk_idx (from 1), text."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("long").alias("chunk_idx"), "text")


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS chunk_idx FROM documents)"
_WS = r"[\t\n\x0b\f\r ]"


@query(rf"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]+>', '', 'g')), ''), nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h2\b[^>]*>(.*?)</h2\s*>', 1), '<[^>]+>', '', 'g')), ''), nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h3\b[^>]*>(.*?)</h3\s*>', 1), '<[^>]+>', '', 'g')), '')) AS title FROM pages")
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


def _clean_sql() -> str:
    out = r"regexp_replace(html, '(?is)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "nav", "aside", "header", "footer"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    out = rf"regexp_replace({out}, '(?s)<[^>]+>', chr(10), 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


@query(rf"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_clean_sql()}, chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM pages")
def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?m)^(#{1,6})[\t\n\f\r ]+(.+)$', 2)) AS headings, array_to_string(regexp_extract_all(text, '(?m)^(#{1,6})[\t\n\f\r ]+(.+)$', 2), ' | ') AS titles FROM documents")
def section_headings(spark: SparkSession, sf: str) -> DataFrame:
    h = T.headings(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(h).cast("long").alias("headings"), F.array_join(h, " | ").alias("titles"))


@query(r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[\t\n\x0b\f\r ]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS sentences FROM documents")
def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Pc}\t\n\x0b\f\r ]')) AS tokens FROM documents")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '^(?:the|a|an)\s+', ''), '[^\w\s-]', '', 'g'), '\s+', ' ', 'g')) AS normal, CASE WHEN trim(regexp_replace(trim(p_name), '(?i)^(?:the|a|an)\s+', '')) = '' THEN trim(p_name) ELSE trim(regexp_replace(trim(p_name), '(?i)^(?:the|a|an)\s+', '')) END AS canonical, coalesce(nullif(regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'Node') AS label, trim(regexp_replace(regexp_replace(p_brand, '[\\/*?:\"<>|#\[\]^]', '', 'g'), '\s+', ' ', 'g')) AS file FROM part")
def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.normalize_name(F.col("p_name")).alias("normal"), T.canonical_name(F.col("p_name")).alias("canonical"), T.graph_label(F.col("p_type")).alias("label"), T.file_name(F.col("p_brand")).alias("file"))


@query(r"""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month_of_date, strftime(o_orderdate, '%Y-01') AS month_of_year, strftime(o_orderdate, '%Y-%m') AS month_as_typed, strftime(o_orderdate, '%Y-12') AS upper_of_year,
  strftime(o_orderdate, '%Y-%m-%d') AS published, strftime(o_orderdate, '%Y-%m-01') AS sorts_as, strftime(o_orderdate, '%Y') AS year_inside, strftime(o_orderdate, '%Y-%m') BETWEEN '1994-06' AND '1996-02' AS in_range FROM orders
""")
def dates(spark: SparkSession, sf: str) -> DataFrame:
    d = lambda f: F.date_format("o_orderdate", f)
    day, month, year = d("yyyy-MM-dd"), d("yyyy-MM"), d("yyyy")
    return table(spark, sf, "orders").select(
        "o_orderkey", T.idea_month(day).alias("month_of_date"), T.idea_month(year).alias("month_of_year"), T.query_month(F.concat_ws(" ", d("MMMM"), year)).alias("month_as_typed"), T.query_month(year, True).alias("upper_of_year"),
        T.publication_date(F.concat(F.lit("D:"), d("yyyyMMdd"), F.lit("Z"))).alias("published"), T.sort_date(month).alias("sorts_as"), T.publication_date(F.concat_ws(" ", F.lit("printed"), year, F.lit("in town"))).alias("year_inside"),
        T.month_in_range(month, F.lit("1994-06"), F.lit("1996-02")).alias("in_range"),
    )


def _rules_sql(source: str, formulas: bool) -> str:
    """The cascade in SQL over source(.., text, section): a CASE of the rules' patterns, the two that look behind put as what they look for."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    m = lambda p, c="t": f"regexp_matches({c}, {q(p)})"
    n = lambda p, c="t": f"len(regexp_extract_all({c}, {q(p)}))"
    marked = P.FORMULA_MARKED.replace(r"(?<=[\)\}\]])", r"[\)\}\]]").replace(r"(?<![A-Za-z0-9_,\(\)\{\}\[\]\^])", "")
    money = P.CURRENCY.replace(r"(?<!\\)", r"(^|[^\\])")
    weak = ", ".join(f"'{x}'" for x in P.WEAK_SYMBOLS)
    found = f"list_concat(regexp_extract_all(bare, {q(marked)}), regexp_extract_all(bare, {q(P.FORMULA_WORDS)}))"
    title = rf"(?i)\b{P.REFERENCE_TITLE}\b"
    named = f"({m(P.DOI)} OR {m(P.ARXIV_ID)} OR {m(P.VENUE)})"
    plain = f"regexp_replace(t, {q(P.LINKS)}, '', 'g')"
    tail = f"(rows <= 4 AND {n(P.AUTHOR_TOKEN)} >= 5 OR n < 220 AND {m(P.CITATION_TAIL)} OR n < 250 AND {named} AND {m(P.YEAR)} AND ({m(P.NUMBERED_AUTHOR)} OR {n(P.AUTHOR_TOKEN)} >= 2))"
    biblio = (
        f"({n(P.CITATION_BRACKET)} >= 5 AND rows <= {n(P.CITATION_BRACKET)} + 3 OR {n(P.CITATION_BRACKET)} >= 8 OR {named} AND {n(P.BIB_LINE)} >= 2 AND rows <= {n(P.BIB_LINE)} + 3 OR {m(P.ARXIV_AUTHORS)} AND rows <= 5 OR rows <= 4 AND {m(P.PROCEEDINGS_SLICE)} "
        f"OR rows <= 3 AND {n(P.AUTHOR_TOKEN)} >= 4 AND n < 350 OR {m(P.REFERENCES_TURN)} AND n < 650 OR NOT prose AND NOT contains({plain}, ':') AND NOT contains({plain}, '?') AND n < 280 AND {tail})"
    )
    scattered = f"rows >= 8 AND NOT list_bool_or(list_transform(l, lambda x: {m(P.TABLE_RULE, 'x')})) AND NOT list_bool_or(list_transform(l, lambda x: {m(P.CODE_WORDS, 'x')})) AND len(list_filter(l, lambda x: right(x, 1) IN ('.', ';'))) <= 1 AND list_sum(list_transform(l, lambda x: length(x))) <= 22 * rows AND len(list_filter(l, lambda x: length(x) <= 45)) >= 0.85 * rows"
    marks = "length(t) - length(replace(t, '?', ''))"
    heads, asks, options = n(P.CODE_HEADER), n(P.QUESTION_ITEM), n(P.OPTION_ITEM)
    rules = {
        "ref_sections": f"{m(title, 'section')} OR {m(rf'(?i)^{P.REFERENCE_TITLE}' + chr(92) + 'b', 'coalesce(l[1], chr(0))')} OR n < 900 AND {m(P.TOC_DOTS)} OR n < 320 AND {m(P.GOVERNANCE)} AND NOT prose",
        "biblio": biblio,
        "tech_boiler": f"{heads} >= 3 AND rows <= {heads} + 3 OR n < 400 AND {m(P.LICENSE)} OR rows <= 5 AND {m(P.SCRAPE_NOISE)} OR n < 300 AND NOT {m('(?i)' + chr(92) + 'bAbstract' + chr(92) + 'b')} AND NOT prose AND {m(P.AFFILIATION)}",
        "dataset_stim": f"{m(P.TOKENIZER_NOISE)} OR {m(P.SURVEY_TITLE, 'section')} OR {asks} >= 1 AND {options} >= 3 AND rows <= {asks} + {options} + 2 OR n < 400 AND NOT prose AND {m(P.PROMPT_SCHEMA)} OR {marks} >= 4 AND n < 150 AND NOT prose",
        "diag_ocr": f"NOT formula AND ({m(P.CHECKMARKS)} AND n < 600 OR {m(P.CALLOUTS)} AND n < 450 OR {scattered})",
        "captions_signposts": f"NOT formula AND n < 200 AND NOT prose AND ({m(P.SUBFIGURES)} OR n < 140 AND {m(P.CAPTION)} AND NOT {m(P.CAPTION_VERBS)} OR n < 160 AND {m(P.SIGNPOST)})",
    }
    case = " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in rules.items())
    return rf"""
{source}, s0 AS (SELECT * REPLACE (regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g') AS text) FROM source), s1 AS (SELECT * EXCLUDE (text), text AS t, length(text) AS n, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS l, {m(P.PROSE_GUARD, 'text')} AS prose,
regexp_replace(regexp_replace(regexp_replace(text, {q(P.URL)}, ' ', 'g'), {q(money)}, '\1 ', 'g'), {q(money)}, '\1 ', 'g') AS bare FROM s0), s2 AS (SELECT *, len(l) AS rows FROM s1), s3 AS (SELECT *, {found} AS found, {biblio} AS bib FROM s2),
s4 AS (SELECT *, len(found) > 0 AND NOT (len(list_filter(found, lambda x: trim(x) NOT IN ({weak}))) = 0 AND bib) AS formula FROM s3), classified AS (SELECT * EXCLUDE (l, found, bib, prose, bare), CASE WHEN {"formula AND t <> ''" if formulas else "false"} THEN 'formulas' WHEN t = '' THEN 'empty' {case} ELSE 'passed' END AS category FROM s4)
"""


#: Lines that each rule of the cascade takes, and lines that it nearly takes.
_PLANTED = [
    "", "  \t ", "plain prose about nothing much", "References", "Bibliography and more", "CHAPTER ONE . . . . . . . . 12", "Contents.......3", "Funding was received from nobody at all", "In this section funding was received", "We acknowledge support from the council", "This work was supported in part by grant 5",
    "see [1] [2] [3] [4] [5]", "see [1] [2] [3] [4]", "[1] [2] [3] [4] [5] [6] [7] [8] and\nmany\nmore\nlines\nhere\nto\nfollow\nthat\nend\nonly\nnow\nthen\nagain", "[1] Smith, J. In Proceedings of the old meeting\n[2] Jones, K. Journal of Things", "arXiv:1234.56789 by Somebody", "Proceedings of the meeting, pages 12-19",
    "Smith, Jones, Brown, Green, and others", "Smith J., Jones K., Brown L., Green M., White N.", "the end.\nReferences\n1. one", "pp. 12-14 of a book", "doi:10.1234/abc 1999 Smith, Jones,", "#include <stdio.h>\n#define ABC\n#endif", "#include <stdio.h>\n#define ABC", "All rights reserved by the owner", "Licensed under the Apache License, Version 2", "MIT License " + "x" * 400, "Posted by someone yesterday", "Join Date: today",
    "Correspondence to: the author", "1 Department of Nothing, Some University", "Abstract 1 Department of Nothing, Some University", "a @-@ b", "odd <unk> token", "Question 1: what\nOption A: x\nOption B: y\nOption C: z", "Question 1: what\nOption A: x", "really? what? why? when?", "really? what? why?", "instruction: ... , output: ...", "<curr_prompt> go",
    "\u2713 \u2717 \u2713 \u2717 done", "01 Start here 02 Then there 03 Go on 04 Finish now", "box\narrow\nnode\nedge\nleft\nright\ntop\nbottom", "def f\nreturn x\nwhile y\nclass z\nleft\nright\ntop\nbottom", "(a) First thing (b) Second thing", "Figure 3: a plot", "Figure 3: a plot that shows much", "Table 2. numbers", "All proofs are provided in Appendix B",
    "we propose a thing. All proofs are provided in Appendix B", "let $x$ be", "it costs $5 today", "it costs $5.00 and $6 and \\$7", "E = mc", "so a_1 holds", "x^2 grows", "f(x) = 3", "a <= b", "\u2211 of all", "angle of 5\u00b0", "5\u00b0 [1] [2] [3] [4] [5]", "Theorem 3. holds", "log (x)", "mod 5", "the Hessian is", "see http://a.b/c_d=e", "softmax [x]", "a := b", "so (x)_i holds", "so )^2 ends", "\\alpha beta", "plain ~ tilde", "x ~ 3", "REFERENCE", "Acknowledgements", "appendix contents",
]


def _planted(spark: SparkSession) -> DataFrame:
    titles = ["Body", "References", "Survey items", "Methods"]
    return spark.createDataFrame([(4 * i + j, x, title) for i, x in enumerate(_PLANTED) for j, title in enumerate(titles)], "id long, text string, section string").repartition(2)


def _planted_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {quote(x)})" for i, x in enumerate(_PLANTED)) + ") t(i, text)), source AS (SELECT 4 * i + j AS id, text, section FROM p, (VALUES (0, 'Body'), (1, 'References'), (2, 'Survey items'), (3, 'Methods')) s(j, section))"


@query(_rules_sql(_planted_sql(), True) + "SELECT id, formula AS has_formula, category, CASE WHEN category IN ('formulas', 'passed') THEN 'retain' ELSE 'skip' END AS decision FROM classified")
def filter_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule of the cascade, line by line, on planted lines under four section titles."""
    return cascade.classify(_planted(spark), section="section").select("id", "has_formula", "category", "decision")


@query(_rules_sql(f"WITH {_LINES}, source AS (SELECT doc_id, chunk_idx, text, '' AS section FROM lines)", False) + "SELECT category, count(*) AS chunks FROM classified GROUP BY category")
def filter_categories(spark: SparkSession, sf: str) -> DataFrame:
    """All lines by category, without the formulas' precedence."""
    return cascade.classify(_chunks(spark, sf), formulas=False).groupBy("category").agg(F.count("*").alias("chunks"))


@query(rf"WITH {_LINES} SELECT count(*) AS chunks, count(*) FILTER (regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') = '') AS empty FROM lines")
def filter_empty(spark: SparkSession, sf: str) -> DataFrame:
    out = cascade.classify(_chunks(spark, sf), formulas=False, rules=["empty"])
    return out.agg(F.count("*").alias("chunks"), F.count_if(F.col("category") == "empty").alias("empty"))


@query(_rules_sql(f"WITH {_LINES}, source AS (SELECT doc_id, chunk_idx, text, '' AS section FROM lines)", True) + "SELECT category, CASE WHEN category IN ('formulas', 'passed') THEN 'retain' ELSE 'skip' END AS decision, count(*) AS chunks, list_position(['formulas', 'empty', 'ref_sections', 'biblio', 'tech_boiler', 'dataset_stim', 'diag_ocr', 'captions_signposts', 'limbo', 'chunk_sim', 'passed'], category) AS place FROM classified GROUP BY category")
def filter_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cascade over all lines."""
    return cascade.stats(cascade.classify(_chunks(spark, sf)))


@query(f"WITH {_LINES} SELECT doc_id, chunk_idx::BIGINT AS chunk_idx FROM lines WHERE regexp_matches(text, '(?i)All\\s+rights\\s+reserved|GNU\\s+General\\s+Public\\s+License|Apache\\s+License,\\s+Version|Permission\\s+is\\s+hereby\\s+granted,\\s+free\\s+of\\s+charge|MIT\\s+License|Creative\\s+Commons\\s+Attribution') AND length(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) < 400")
def filter_license(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that a rule registered by the caller skips: license lines alone."""
    cascade.RULES["license_only"] = lambda c: (c.n < 400) & c.text.rlike(P.LICENSE)
    try:
        out = cascade.classify(_chunks(spark, sf), formulas=False, rules=["license_only"])
    finally:
        del cascade.RULES["license_only"]
    return out.where("category = 'license_only'").select("doc_id", "chunk_idx")


_STOP = ", ".join(f"'{x}'" for x in P.GROUNDING_STOP_WORDS)


@query(rf"""
WITH c AS (SELECT conv_id, turn, text, right(lag(text) OVER w, 200) AS q, CASE WHEN turn % 3 = 0 THEN left(lead(text) OVER w, 40) WHEN turn % 3 = 1 THEN 'unheard of' ELSE '' END AS name, left(coalesce(lead(text, 2) OVER w, ''), 120) AS brief, md5(text) AS h FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
f AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS ft, trim(CASE WHEN turn % 4 = 0 THEN substring(text, 5, 60) WHEN turn % 4 = 1 THEN coalesce(q, '') WHEN turn % 4 = 2 THEN 'zzz qqq' ELSE '' END) AS quote FROM c),
w AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]{{3,}}')), lambda x: x NOT IN ({_STOP})) AS here, list_filter(list_distinct(regexp_extract_all(lower(quote), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]{{4,}}')), lambda x: x NOT IN ({_STOP})) AS w4, list_filter(list_distinct(regexp_extract_all(lower(quote), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]{{3,}}')), lambda x: x NOT IN ({_STOP})) AS w3,
list_filter(list_distinct(regexp_extract_all(lower(coalesce(name, '')), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]{{3,}}')), lambda x: x NOT IN ({_STOP})) AS nw, list_filter(list_distinct(regexp_extract_all(lower(brief), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]{{4,}}')), lambda x: x NOT IN ({_STOP})) AS bw FROM f),
k AS (SELECT *, CASE WHEN len(w4) > 0 THEN w4 ELSE w3 END AS want FROM w), g AS (SELECT *, quote <> '' AND (contains(ft, trim(regexp_replace(lower(quote), '\s+', ' ', 'g'))) OR len(want) > 0 AND len(here) > 0 AND len(list_intersect(want, here)) / len(want) >= 0.5) AS found FROM k)
SELECT conv_id, turn, h, text <> '' AND (found OR list_has_any(nw, here) OR len(list_intersect(bw, here)) >= 2) AS grounded, CASE WHEN text <> '' AND found THEN quote ELSE '' END AS quote FROM g
""")
def quote_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Whether ideas rest on a turn, by quotes from it, from the turn before or from nowhere, and by names and descriptions from the turns after."""
    from textloom.operators.chunking import context

    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = context(c, "conv_id", ["turn", "text"], chars=200).withColumn("next", F.lead("text").over(w)).withColumn("later", F.left(F.coalesce(F.lead("text", 2).over(w), F.lit("")), F.lit(120)))
    t = F.col("turn")
    name = F.when(t % 3 == 0, F.left("next", F.lit(40))).when(t % 3 == 1, "unheard of").otherwise("")
    quote = F.when(t % 4 == 0, F.substring("text", 5, 60)).when(t % 4 == 1, F.coalesce("before", F.lit(""))).when(t % 4 == 2, "zzz qqq").otherwise("")
    g = T.grounding(F.col("text"), name, F.col("later"), quote)
    return rows.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("h"), g["grounded"].alias("grounded"), g["quote"].alias("quote"))


@query(r"SELECT doc_id, item_id FROM benchmark b, documents d WHERE trim(regexp_replace(lower(b.text), '\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\s+', ' ', 'g')))")
def verbatim_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose text a document holds, whatever the case and the blanks."""
    from textloom.operators.audit import held_verbatim

    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return held_verbatim(spread(table(spark, sf, "documents").select("doc_id", "text")), table(spark, sf, "benchmark"), ["doc_id"], ["item_id"], flat(F.col("text")), flat(F.col("text")))


@query("""
WITH c AS (SELECT conv_id, turn, text, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn, right(lag(text) OVER w, 500) AS before, left(lead(text) OVER w, 500) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text))
SELECT conv_id, turn, prev_turn, next_turn, length(before) AS before_chars, length(after) AS after_chars, md5(coalesce(before, '')) AS before_md5, md5(coalesce(after, '')) AS after_md5 FROM c
""")
def prev_next_context(spark: SparkSession, sf: str) -> DataFrame:
    from textloom.operators.chunking import context

    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    c = context(table(spark, sf, "conversations").withColumns({"prev_turn": F.lag("turn").over(w), "next_turn": F.lead("turn").over(w)}), "conv_id", ["turn", "text"])
    md5 = lambda x: F.md5(F.coalesce(F.col(x), F.lit("")).cast("binary"))
    return c.select("conv_id", "turn", "prev_turn", "next_turn", F.length("before").cast("long").alias("before_chars"), F.length("after").cast("long").alias("after_chars"), md5("before").alias("before_md5"), md5("after").alias("after_md5"))


@query(r"""
WITH c AS (SELECT conv_id, 'b' || conv_id || '_c1_p' || turn || '_' || left(md5(text), 8) AS id, turn % 3 AS chapter, CASE WHEN turn % 2 = 0 THEN turn END AS idx, turn FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY chapter NULLS FIRST, turn, id) AS r FROM c), p AS (SELECT a.id AS a, b.id AS b FROM o a JOIN o b ON a.conv_id = b.conv_id AND b.r = a.r + 1)
SELECT a AS src, b AS dst, 'NEXT' AS relation FROM p UNION ALL SELECT b, a, 'PREV' FROM p
""")
def sequence_links(spark: SparkSession, sf: str) -> DataFrame:
    """NEXT and PREV between chunks of a book, in order of chapter and place; every other place stands in the id alone."""
    from textloom.operators import graph as G

    c, t = table(spark, sf, "conversations"), F.col("turn")
    rows = c.select("conv_id", F.concat(F.lit("b"), "conv_id", F.lit("_c1_p"), t, F.lit("_"), F.left(F.md5(F.col("text").cast("binary")), F.lit(8))).alias("id"), (t % 3).alias("chapter"), F.when(t % 2 == 0, t).alias("idx"))
    return G.sequence_links(rows, "conv_id", G.chunk_order(F.col("chapter"), F.col("idx"), F.col("id"), F.lit("")), "id")


@query("WITH p AS (SELECT conv_id, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS b FROM conversations) SELECT DISTINCT md5(a) AS a, md5(b) AS b FROM p WHERE length(trim(a)) >= 40 AND length(trim(b)) >= 40")
def discourse_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct pairs of neighbours of at least 40 characters, by digest."""
    from textloom.operators.chunking import neighbour_pairs

    p = neighbour_pairs(table(spark, sf, "conversations"), "conv_id", ["turn", "text"])
    return p.select(F.md5(F.col("a").cast("binary")).alias("a"), F.md5(F.col("b").cast("binary")).alias("b")).distinct()


@query("SELECT doc_id, source, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 10)::BIGINT AS batch FROM documents")
def batch_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of ten books of a shelf."""
    from textloom.operators.chunking import batches

    return batches(table(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"], 10)


@query("""
WITH p AS (SELECT user_id, event_id, floor(100.0 * row_number() OVER w / count(*) OVER (PARTITION BY user_id) / 10)::BIGINT AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), l AS (SELECT *, lag(step) OVER (PARTITION BY user_id ORDER BY step, event_id) AS before FROM p)
SELECT user_id, step, count(*) AS fired FROM l WHERE step > coalesce(before, 0) GROUP BY 1, 2
""")
def milestone_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of each user through their events, in steps of ten percent."""
    from textloom.operators.ledger import milestones

    return milestones(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).groupBy("user_id", "step").agg(F.count("*").alias("fired"))


@query(r"""
WITH p AS (SELECT p_partkey, lower(p_name) AS n, lower(p_type) AS s, lower(p_brand) AS c, p_size AS weight FROM part), m AS (SELECT *, CASE WHEN n = 'small' THEN 100.0 WHEN starts_with(n, 'small') THEN 85 WHEN contains(n, 'small') THEN 75 WHEN contains(c, 'small') THEN 60 WHEN contains(s, 'small') THEN 50 END AS score FROM p)
SELECT p_partkey, score::DOUBLE AS match_score, weight FROM m WHERE score IS NOT NULL
""")
def exact_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every part that the word `small` finds, scored by where it stands."""
    scored = table(spark, sf, "part").withColumn("m", T.exact_score("small", F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit("")))
    return scored.where("m.match_score is not null").select("p_partkey", "m.match_score", F.col("p_size").alias("weight"))


@query(r"""
WITH q AS (SELECT ['the', 'and', 'that'] AS q), w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS d FROM documents)
SELECT doc_id, round(len(list_intersect(d, q)) / (sqrt(len(q)) * sqrt(len(d))), 6) AS score FROM w, q WHERE len(d) > 0
""")
def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    q = F.array(*map(F.lit, ["the", "and", "that"]))
    d = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return table(spark, sf, "documents").withColumn("d", d).where(F.size("d") > 0).select("doc_id", F.round(F.size(F.array_intersect("d", q)) / (F.sqrt(F.lit(3)) * F.sqrt(F.size("d"))), 6).alias("score"))


@query(r"""
WITH f AS (SELECT p_partkey AS id, unnest(list_concat(list_filter(regexp_extract_all(lower(p_name), '\w+'), lambda x: length(x) >= 2), list_transform(range(1, greatest(length(p_name) - 1, 1)), lambda i: substring(lower(p_name), i, 3)))) AS f FROM part), n AS (SELECT count(*) AS n FROM part),
tf AS (SELECT id, f, count(*) AS c FROM f GROUP BY 1, 2), df AS (SELECT f, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT id, f, (1 + ln(c)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (f), n), nrm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
qf AS (SELECT unnest(list_concat(['small', 'ring'], list_transform(range(1, 9), lambda i: substring('small ring', i, 3)))) AS f), qt AS (SELECT f, count(*) AS c FROM qf GROUP BY 1), qw AS (SELECT f, (1 + ln(c)) * coalesce(ln((n + 1) / (df + 1)) + 1, 1) AS w FROM qt LEFT JOIN df USING (f), n)
SELECT id AS p_partkey, round(sum(w.w * qw.w) / any_value(norm) / (SELECT sqrt(sum(w * w)) FROM qw), 6) AS score FROM w JOIN qw USING (f) JOIN nrm USING (id) GROUP BY id
""")
def tfidf_search(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of all part names to `small ring` by words and letter triples."""
    from textloom.operators.search import tfidf_scores

    return tfidf_scores(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", "small ring").select("p_partkey", F.round("score", 6).alias("score"))


@query()
def document_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of all documents."""
    from textloom.operators import chunking as C

    make = lambda t: [(i, title, len(body)) for i, (title, body) in enumerate(C.sections(t), 1)]
    return C.explode_texts(table(spark, sf, "documents"), "text", "chapter_idx int, title string, chars int", make, ["doc_id"])


@query()
def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all sections with ids, by blocks and sentences."""
    from textloom.operators import chunking as C

    def make(t: str) -> list[tuple]:
        return [(c["chapter_idx"], c["chunk_idx"], c["section_title"], c["char_count"], c["word_count"], c["chunk_id"].rsplit("_", 1)[1]) for i, (title, body) in enumerate(C.sections(t), 1) for c in C.chunk_section(0, i, title, body)]

    return C.explode_texts(table(spark, sf, "documents"), "text", "chapter_idx int, chunk_idx int, section_title string, char_count int, word_count int, digest string", make, ["doc_id"])


@query()
def rolling_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks where the talk turns, by hashed vectors in place of an embedder."""
    from textloom.operators import chunking as C

    make = lambda t: [(c["chunk_idx"], c["token_count"], c["start_sentence"], c["end_sentence"], c["split_reason"]) for c in C.rolling_chunks(t, C.hashed_vector)]
    return C.explode_texts(table(spark, sf, "conversations"), "text", "chunk_idx int, token_count int, start_sentence int, end_sentence int, split_reason string", make, ["conv_id", "turn"])


@query("""
WITH RECURSIVE d AS (SELECT conv_id, turn, strlen(text) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn, strlen(text)) AS r FROM conversations), s AS (SELECT conv_id, r, turn, bytes, 0::BIGINT AS batch, bytes + 150 AS used, 1 AS n FROM d WHERE r = 1 UNION ALL SELECT d.conv_id, d.r, d.turn, d.bytes, CASE WHEN s.used + d.bytes + 150 > 5120 OR s.n >= 3 THEN batch + 1 ELSE batch END, CASE WHEN s.used + d.bytes + 150 > 5120 OR s.n >= 3 THEN d.bytes + 150 ELSE s.used + d.bytes + 150 END, CASE WHEN s.used + d.bytes + 150 > 5120 OR s.n >= 3 THEN 1 ELSE s.n + 1 END FROM s JOIN d ON d.conv_id = s.conv_id AND d.r = s.r + 1)
SELECT conv_id, turn, bytes, batch FROM s
""")
def extraction_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations in batches of at most 5,120 bytes (150 of them overhead for each) and 3 items."""
    from textloom.operators import chunking as C

    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.octet_length("text").alias("bytes"))
    return C.pack(rows, "conv_id", ["turn", "bytes"], F.col("bytes") + 150, 5120, 3)


@query()
def semantic_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Cover decisions over all lines of all documents; the vector of a line is that of its number's place among the vectors."""
    from textloom.operators.ordered import semantic_cover as cover

    lines = _chunks(spark, sf).withColumns({"chapter_idx": F.lit(1), "section_title": F.lit("body")})
    vecs = table(spark, sf, "embeddings")
    n = vecs.count()
    rows = cascade.classify(lines, section="section_title").withColumn("vec_id", F.pmod(F.xxhash64(F.lower("text")), F.lit(n)))
    joined = rows.join(vecs.select("vec_id", "embedding"), "vec_id", "left").drop("vec_id")
    out = cover(joined, "doc_id", ["chunk_idx"])
    return out.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if("selected").alias("selected"), F.count_if(F.col("status") == "skipped_redundant").alias("redundant"), F.count_if(F.col("status") == "skipped_reference").alias("skipped"))


@query("""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings), l AS (SELECT a.r, any_value(a.vec_id) AS id, list(b.vec_id ORDER BY b.vec_id) FILTER (b.vec_id IS NOT NULL) AS near FROM e a LEFT JOIN e b ON b.vec_id < a.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.35 GROUP BY a.r),
s AS (SELECT r, id, id AS leader, [id] AS leaders FROM l WHERE r = 1 UNION ALL SELECT l.r, l.id, coalesce(list_filter(l.near, lambda x: list_contains(s.leaders, x))[1], l.id), CASE WHEN coalesce(len(list_filter(l.near, lambda x: list_contains(s.leaders, x))), 0) = 0 THEN list_append(s.leaders, l.id) ELSE s.leaders END FROM s JOIN l ON l.r = s.r + 1)
SELECT id AS vec_id, leader FROM s
""")
def greedy_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Leader clusters of all vectors."""
    from textloom.operators.ordered import leader_clusters

    return leader_clusters(table(spark, sf, "embeddings"), "vec_id", 0.35)


@query("""
WITH RECURSIVE e AS (SELECT embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings), m AS (SELECT a.r, list(list_cosine_similarity(a.v, b.v) ORDER BY b.r) AS sims FROM e a JOIN e b ON b.r <= a.r GROUP BY a.r), p AS (SELECT low::DOUBLE AS low, high::DOUBLE AS high FROM (VALUES (0.25, 0.35), (0.3, 0.4), (0.35, 0.45), (0.4, 0.5)) t(low, high)),
s AS (SELECT low, high, 1::BIGINT AS r, [1::BIGINT] AS idx, 1::BIGINT AS una, 0::BIGINT AS limbo, 0::BIGINT AS sure FROM p UNION ALL SELECT low, high, nr, CASE WHEN best < low THEN list_append(idx, nr) ELSE idx END, una + (best < low)::INT, limbo + (best >= low AND best < high)::INT, sure + (best >= high)::INT FROM (SELECT s.*, m.r AS nr, list_max(list_transform(s.idx, lambda j: m.sims[j])) AS best FROM s JOIN m ON m.r = s.r + 1))
SELECT low, high, una AS unassigned, limbo, sure AS high_confidence, len(idx) AS ideas, 100.0 * una / r AS rho FROM s WHERE r = (SELECT count(*) FROM e)
""")
def adaptive_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Routing with a growing index for a grid of thresholds; each vector yields itself as an idea."""
    from textloom.operators.ordered import adaptive_replay as replay

    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.lit(100.0).alias("weight"), F.array("embedding").alias("ideas"))
    pairs = spark.createDataFrame([(0.25, 0.35), (0.3, 0.4), (0.35, 0.45), (0.4, 0.5)], "low double, high double")
    return replay(rows, pairs, ["vec_id"])


@query()
def formula_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Formula features of all documents, by the sum and the place of the largest."""
    from textloom.functions.formulas import formula_vector

    v = table(spark, sf, "documents").select("doc_id", formula_vector(F.col("text")).alias("v"))
    return v.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 3).alias("total"), (F.array_position("v", F.array_max("v")) - 1).alias("largest"))


@query()
def html_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Title and text of all pages by a parser."""
    from textloom.operators.chunking import explode_texts
    from textloom.sources.books import html_page

    return explode_texts(table(spark, sf, "pages"), "html", "title string, chars int", lambda h: [(t, len(x)) for t, x in [html_page(h)]], ["page_id"])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: hourly counts."""
    from textloom.streaming.ledger import tumbling

    return tumbling(table(spark, sf, "events"), "ts", "1 hour", "event_type")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k
""")
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: sessions of each user that end after half an hour."""
    from textloom.streaming.ledger import sessions

    return sessions(table(spark, sf, "events"), "ts", "30 minutes", "user_id")
