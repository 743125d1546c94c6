"""Text functions on columns: names, titles, dates, tokens, formulas, grounding. Nulls give nulls unless said."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import patterns as P

_NONE = "\x00"


def any_of(*columns: Column) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


#: In Java's syntax, what RE2 means by these outside and inside of brackets.
_RE2 = {r"\b": r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))", r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]"}
_RE2_INSIDE = {r"\s": r"\t\n\f\r ", r"\S": r"[^\t\n\f\r ]"}
#: Letters that count as the same under (?i), besides those that Java knows.
_FOLDED = {"s": "\u017f", "k": "\u212a"} | dict(zip("βεθικμπρσφωΒΕΘΙΚΜΠΡΣΦΩ", 2 * ["\u03d0", "\u03f5", "\u03d1\u03f4", "\u0345\u1fbe", "\u03f0", "\u00b5", "\u03d6", "\u03f1", "\u03c2", "\u03d5", "\u2126"], strict=True))


@cache
def as_re2(pattern: str) -> str:
    """A pattern in Java's syntax that finds what RE2 finds by it: words end by ASCII letters whatever Java's version, blanks are without the vertical tab, lines end at \\n alone, and (?i) folds all letters."""
    flags = m[1] if (m := re.match(r"\(\?([a-z]+)\)", pattern)) else ""
    out, inside, at = ["(?d)"], False, 0
    while at < len(pattern):
        if not inside and (m := re.compile(r"\(\?(?:[a-z]+\)|[a-z]*:|<?[=!])").match(pattern, at)):
            out.append(m[0])
            at += len(m[0])
            continue
        c = pattern[at]
        if c == "\\":
            e = pattern[at : at + 2]
            out.append((_RE2_INSIDE if inside else _RE2).get(e, e))
            at += 2
            continue
        more = _FOLDED.get(c.lower() if c.isascii() else c, "") if "i" in flags else ""
        if inside and "i" in flags and pattern[at : at + 3] in ("a-z", "A-Z"):
            c, more = pattern[at : at + 3], "\u017f\u212a"
        if not inside and c == "$" and "m" not in flags:
            c = r"\z"
        elif not inside and more:
            c, more = f"[{c.lower()}{c.upper()}{more}]" if c.isascii() else f"[{c}{more}]", ""
        out.append(c + more)
        at += 3 if c in ("a-z", "A-Z") else 1
        inside = c == "[" or inside and c != "]"
    return "".join(out)


def has(text: Column, pattern: str) -> Column:
    return text.rlike(as_re2(pattern))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(as_re2(pattern)))


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")), lambda x: x != "")


def clean_whitespace(text: Column) -> Column:
    """Blanks collapsed, three newlines or more to two, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def normalize_name(name: Column) -> Column:
    """Lower case without a leading article, punctuation or repeated blanks."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"^(?:the|a|an)\s+", ""), r"(?U)[^\w\s-]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def plain_name(name: Column) -> Column:
    """normalize_name without the rule on articles."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w\s-]", ""), r"\s+", " "))


def canonical_name(name: Column) -> Column:
    """The name without a leading article, in its own case; all of it if nothing else is there."""
    trimmed = F.trim(name)
    bare = F.trim(F.regexp_replace(trimmed, r"(?i)^(?:the|a|an)\s+", ""))
    return F.when(bare == "", trimmed).otherwise(bare)


def file_name(title: Column) -> Column:
    """A title that a file system takes."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, r'[\\/*?:"<>|#\[\]^]', ""), r"\s+", " "))


def graph_label(label: Column, default: str = "Node") -> Column:
    """Letters, digits and underscores only; default if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(label, r"[^A-Za-z0-9_]", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(default))


def breadcrumb(book: Column, chapter: Column, subtitle: Column, chapter_idx: Column, chunk_idx: Column) -> Column:
    """book > chapter > subtitle [part c.k]; a subtitle equal to the chapter is left out."""
    own = F.when((subtitle == chapter) | (subtitle == ""), F.lit(None)).otherwise(subtitle)
    return F.concat(F.concat_ws(" > ", book, chapter, own), F.format_string(" [part %d.%d]", chapter_idx, chunk_idx))


def token_count(text: Column) -> Column:
    """Runs of word characters and single other marks."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def html_text(html: Column) -> Column:
    """Text nodes of a page, trimmed, one a line; scripts, styles and page furniture go with their content."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    for tag in ("script", "style", "nav", "aside", "header", "footer"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.array_join(lines(out), "\n")


def html_title(html: Column) -> Column:
    """Text of the first h1 that has some, else h2, else h3."""
    found = []
    for tag in ("h1", "h2", "h3"):
        texts = F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", "")))
        found.append(F.try_element_at(F.filter(texts, lambda x: x != ""), F.lit(1)))
    return F.coalesce(*found)


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.HEADING), F.lit(2))


def _part(text: Column, pattern: str, group: int) -> Column:
    """The group's text where the pattern is found, else null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _month(value: Column) -> Column:
    return value.cast("int").between(1, 12)


def _unset(text: Column) -> Column:
    return text.startswith("0101-01-01")


def idea_month(value: Column) -> Column:
    """YYYY-MM of a date that begins with a year; a bare year is its January."""
    s = F.trim(value)
    year, month = _part(s, r"^(\d{4})-(\d{2})", 1), _part(s, r"^(\d{4})-(\d{2})", 2)
    only = _part(s, r"^(\d{4})", 1)
    return F.when(_unset(s), F.lit(None)).when((year >= "1000") & _month(month), F.concat_ws("-", year, month)).when(only >= "1000", F.concat(only, F.lit("-01")))


def publication_date(value: Column) -> Column:
    """YYYY-MM-DD, YYYY-MM or YYYY of a date in one of the known spellings, or of an identifier or year inside the text."""
    s = F.trim(value)

    def day(pattern: str) -> Column:
        y, m, d = (_part(s, pattern, i) for i in (1, 2, 3))
        return F.when((y >= "1000") & _month(m) & d.cast("int").between(1, 31), F.concat_ws("-", y, m, d))

    y, m = _part(s, r"^(\d{4})-(\d{2})$", 1), _part(s, r"^(\d{4})-(\d{2})$", 2)
    only = _part(s, r"^(\d{4})$", 1)
    paper = r"(?i)(?:^|[^\d])(?:arxiv[:\s]*)?(\d{2})(\d{2})\.\d{4,5}(?:v\d+)?(?=[^\d]|$)"
    yy, mm = _part(s, paper, 1), _part(s, paper, 2)
    century = F.when(yy >= "90", "19").otherwise("20")
    return F.when(_unset(s), F.lit(None)).otherwise(
        F.coalesce(
            day(r"^(\d{4})-(\d{2})-(\d{2})"), F.when((y >= "1000") & _month(m), F.concat_ws("-", y, m)), F.when(only >= "1000", only), day(r"D:(\d{4})(\d{2})(\d{2})"),
            F.when(_month(mm), F.concat(century, yy, F.lit("-"), mm)), _part(s, r"(?:^|[^\d])(19\d{2}|20\d{2})(?:[^\d]|$)", 1),
        )
    )


def sort_date(value: Column) -> Column:
    """YYYY-MM-DD to sort by; what has no date sorts last."""
    date = publication_date(value)
    full = F.when(F.length(date) == 4, F.concat(date, F.lit("-01-01"))).when(F.length(date) == 7, F.concat(date, F.lit("-01"))).otherwise(date)
    return F.coalesce(full, F.lit("9999-12-31"))


def query_month(value: Column, upper: bool = False) -> Column:
    """YYYY-MM of a month as people type it; a bare year is its first month, or its last as an upper bound."""
    s = F.trim(value)
    table = F.create_map(*(F.lit(x) for pair in P.MONTHS.items() for x in pair))

    def joined(year: Column, month: Column) -> Column:
        y, m = year.cast("int"), month.cast("int")
        return F.when(y.between(1000, 2999) & m.between(1, 12), F.format_string("%04d-%02d", y, m))

    only = _part(s, r"^(\d{4})$", 1)
    ymd, my = r"^(\d{4})[-/.](\d{1,2})(?:[-/.]\d{1,2})?", r"^(\d{1,2})[-/.](\d{4})$"
    named, named2 = r"^([a-zA-Z]+)[\s,\-/]+(\d{4})$", r"^(\d{4})[\s,\-/]+([a-zA-Z]+)$"
    return F.coalesce(
        joined(only, F.lit(12 if upper else 1)), joined(_part(s, ymd, 1), _part(s, ymd, 2)), joined(_part(s, my, 2), _part(s, my, 1)),
        joined(_part(s, named, 2), table[F.lower(_part(s, named, 1))]), joined(_part(s, named2, 1), table[F.lower(_part(s, named2, 2))]), idea_month(s),
    )


def month_in_range(month: Column, low: Column, high: Column) -> Column:
    """Inclusive; a null month is outside every bounded range, null bounds are open."""
    return F.when(low.isNull() & high.isNull(), True).otherwise(F.coalesce(month.isNotNull() & F.coalesce(month >= low, F.lit(True)) & F.coalesce(month <= high, F.lit(True)), F.lit(False)))


def latex(raw: Column) -> Column:
    """A formula without its delimiters, repeated blanks and a closing mark."""
    t = F.trim(raw)
    inner = lambda n: F.trim(t.substr(F.lit(n + 1), F.length(t) - 2 * n))
    bare = F.when(t.rlike(r"(?s)^\$\$.*\$\$$") & (F.length(t) >= 4), inner(2)).when(t.rlike(r"(?s)^\\\[.*\\\]$") & (F.length(t) >= 4), inner(2)).when(t.rlike(r"(?s)^\$.*\$$") & (F.length(t) >= 2), inner(1)).when(t.rlike(r"(?s)^\\\(.*\\\)$") & (F.length(t) >= 4), inner(2)).otherwise(t)
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"[,;.]\s*$", "")


def formula_sides(raw: Column) -> Column:
    """struct(lhs, rhs) about the first relation, by rank of relation; empty texts without one."""
    t = latex(raw)
    out = F.struct(F.lit("").alias("lhs"), F.lit("").alias("rhs"))
    for op in reversed(P.RELATIONS):
        at = F.instr(t, op)
        out = F.when(at > 0, F.struct(F.trim(t.substr(F.lit(1), at - 1)).alias("lhs"), F.trim(t.substr(at + len(op), F.length(t))).alias("rhs"))).otherwise(out)
    return out


#: Characters of which a formula of the first pattern has one, and some more: ranges are found fast.
_MARKS = r"[\\$_^=~\u00b0\u00b5\u0345\u1fbe\u0370-\u03ff\u2026\u2032-\u2034\u2100-\u2bff\x{1d400}-\x{1d7ff}]"


def without_links_and_money(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("$")) | F.contains(F.lower(text), F.lit("http")), F.regexp_replace(F.regexp_replace(text, as_re2(P.URL), " "), as_re2(P.CURRENCY), " ")).otherwise(text)


def formula_in(bare: Column) -> Column:
    """Whether a formula pattern is found. The marks that the first needs are looked for before it, which spares most texts its search."""
    return (bare.rlike(_MARKS) & has(bare, P.FORMULA_MARKED)) | has(bare, P.FORMULA_WORDS)


def has_formula(text: Column) -> Column:
    """A formula outside URLs and sums of money."""
    return F.coalesce(formula_in(without_links_and_money(text)), F.lit(False))


def _words(text: Column, least: int) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\w{{{least},}}"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, P.GROUNDING_STOP_WORDS)))


def grounding(chunk: Column, name: Column, brief: Column, quote: Column) -> Column:
    """struct(grounded, quote): whether an idea rests on the chunk, and its quote where that is found there."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    here = _words(chunk, 3)
    q = F.trim(F.coalesce(quote, F.lit("")))
    long_, short = _words(q, 4), _words(q, 3)
    wanted = F.when(F.size(long_) > 0, long_).otherwise(short)
    share = F.size(F.array_intersect(wanted, here)) / F.size(wanted)
    found = (q != "") & (F.contains(flat(chunk), flat(q)) | ((F.size(wanted) > 0) & (F.size(here) > 0) & F.coalesce(share >= 0.5, F.lit(False))))
    about = F.arrays_overlap(_words(F.coalesce(name, F.lit("")), 3), here) | (F.size(F.array_intersect(_words(F.coalesce(brief, F.lit("")), 4), here)) >= 2)
    empty = F.coalesce(chunk, F.lit("")) == ""
    return F.struct((~empty & (found | about)).alias("grounded"), F.when(~empty & found, q).otherwise("").alias("quote"))


def stems(tokens: Column) -> Column:
    def stem(t: Column) -> Column:
        n = F.length(t)
        cut = lambda k: t.substr(F.lit(1), n - k)
        return F.when((n > 4) & t.endswith("ing"), cut(3)).when((n > 3) & t.endswith("es"), cut(2)).when((n > 3) & t.endswith("s"), cut(1)).otherwise(t)

    return F.array_distinct(F.transform(tokens, stem))


def same_concept(a: Column, b: Column, similarity: Column) -> Column:
    """true or false where the names decide whether two concepts are one, else null."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    tokens = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b[a-zA-Z0-9]+\b"), F.lit(0))), F.array(*map(F.lit, P.NAME_STOP_WORDS)))
    s, t = tokens(x), tokens(y)
    u, v = stems(s), stems(t)
    equal = lambda p, q: (F.size(F.array_except(p, q)) == 0) & (F.size(F.array_except(q, p)) == 0)
    opposed = any_of(*((F.array_contains(s, p) & F.array_contains(t, q)) | (F.array_contains(s, q) & F.array_contains(t, p)) for p, q in P.OPPOSITES))
    jaccard = F.size(F.array_intersect(u, v)) / F.size(F.array_union(u, v))
    plural = (F.concat(x, F.lit("s")) == y) | (F.concat(y, F.lit("s")) == x) | (F.concat(x, F.lit("es")) == y) | (F.concat(y, F.lit("es")) == x)
    some = (F.size(u) > 0) & (F.size(v) > 0)
    return F.when((x == y) | ((F.size(s) > 0) & (equal(s, t) | equal(u, v))) | plural, True).when(opposed, False).when(some & (similarity >= 0.93) & (jaccard >= 0.7), True).when(some & (similarity < 0.83) & (jaccard < 0.2), False)


def query_terms(question: Column) -> Column:
    """Words of a question without its opening phrase and the generic concepts, with their pairs and triples, longest first."""
    q = F.lower(F.trim(F.regexp_replace(question, r"[?!.]+\s*$", "")))
    for prefix in P.QUESTION_PREFIXES:
        q = F.regexp_replace(q, prefix, "")
    w = F.regexp_extract_all(q, F.lit(r"(?U)[\w-]{2,}"), F.lit(0))
    n = lambda k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
    quoted = F.transform(F.regexp_extract_all(question, F.lit(r'"([^"]+)"|\[\[([^\]]+)\]\]'), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, r'^"|"$|^\[\[|\]\]$', "")))
    dull = F.array(*map(F.lit, P.GENERIC_CONCEPTS + P.NAME_STOP_WORDS))
    return F.array_except(F.array_distinct(F.concat(quoted, F.array(q), n(3), n(2), w)), dull)


def query_terms_by_rank(question: Column) -> Column:
    """struct(full_query, phrase_terms, word_terms) of a question: without its opening phrase and closing marks; quoted and linked phrases, the whole, triples and pairs of words; words. Generic concepts are left out, 15 of each kind kept, first spelling first."""
    raw = F.trim(question)
    q = raw
    for prefix in P.QUESTION_PREFIXES:
        q = F.trim(F.regexp_replace(q, f"(?i){prefix}", ""))
    q = F.trim(F.regexp_replace(q, r"[?.!]+$", ""))
    full = F.coalesce(F.nullif(q, F.lit("")), raw)
    w = F.filter(F.regexp_extract_all(full, F.lit(r"(?U)[\w-]+"), F.lit(0)), lambda x: F.length(x) >= 2)
    dull = F.array(*map(F.lit, P.GENERIC_CONCEPTS))
    none = F.array().cast("array<string>")
    runs = lambda k: F.when(F.size(w) >= k, F.filter(F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " ")), lambda x: ~F.array_contains(dull, F.lower(x)))).otherwise(none)
    marked = lambda p: F.filter(F.transform(F.regexp_extract_all(raw, F.lit(p), F.lit(1)), lambda x: F.trim(x)), lambda x: F.size(F.split(x, r"\s+")) >= 2)
    named = F.concat(marked(r'"([^"]+)"'), marked(r"\[\[(.*?)\]\]"))
    whole = F.when((F.size(w) >= 2) & ~F.exists(named, lambda x: F.lower(x) == F.lower(full)), F.array(full)).otherwise(none)
    bare = lambda xs: F.transform(xs, lambda x: F.regexp_replace(x, r"""^[ *"'\[\]]+|[ *"'\[\]]+$""", ""))
    once = lambda xs: F.aggregate(xs, none, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    phrases = once(F.filter(bare(F.concat(whole, named, runs(3), runs(2))), lambda x: F.length(x) >= 3))
    words = once(F.filter(bare(w), lambda x: (F.length(x) >= 2) & ~F.array_contains(dull, F.lower(x))))
    empty = raw == ""
    return F.struct(F.when(empty, "").otherwise(full).alias("full_query"), F.when(empty, none).otherwise(F.slice(phrases, 1, 15)).alias("phrase_terms"), F.when(empty, none).otherwise(F.slice(words, 1, 15)).alias("word_terms"))


def candidate_terms(note: Column, question: Column) -> Column:
    """Terms of a Markdown note: bold, quoted and listed ones of 2 to 60 characters, once each, without generic concepts that the question does not name; those that share more words with the question first."""
    none = F.array().cast("array<string>")
    found = lambda p: F.transform(F.regexp_extract_all(note, F.lit(p), F.lit(1)), lambda x: F.trim(x))
    bold = F.filter(found(r"\*\*([^*]+)\*\*"), lambda x: ~F.startswith(x, F.lit("http")))
    rows = F.filter(F.transform(F.split(note, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[-*•]"))
    items = F.transform(rows, lambda x: F.regexp_replace(F.trim(F.split(F.split(F.regexp_replace(x, r"^[-*•]+", ""), ":")[0], " - ")[0]), r"\[\[(.*?)\]\]", "$1"))
    every = F.filter(F.concat(bold, found(r'"([^"]+)"'), items), lambda x: F.length(x).between(2, 60))
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), r"""^[ *"'\[\]]+|[ *"'\[\]]+$""", ""))
    dull, asked = F.array(*map(F.lit, P.GENERIC_CONCEPTS)), F.lower(F.trim(question))
    kept = F.filter(every, lambda x: (F.length(plain(x)) >= 2) & ~(F.array_contains(dull, plain(x)) & ~F.contains(asked, plain(x))) & ~F.contains(plain(x), F.lit("reference document")) & ~F.contains(plain(x), F.lit("document chunk")))
    once = F.aggregate(kept, none, lambda acc, x: F.when(F.exists(acc, lambda y: plain(y) == plain(x)), acc).otherwise(F.concat(acc, F.array(x))))
    words = F.array_distinct(F.regexp_extract_all(asked, F.lit(r"(?U)\w+"), F.lit(0)))
    ranked = F.transform(once, lambda x, i: F.struct((-F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(plain(x), F.lit(r"(?U)\w+"), F.lit(0))), words))).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda r: r["x"])


def exact_score(query: str, name: Column, category: Column, summary: Column, detail: Column) -> Column:
    """struct(match_score, match_type) of a lexical search; score null where nothing matches."""
    q = query.strip().lower()
    n, c, s, d = (F.lower(F.coalesce(x, F.lit(""))) for x in (name, category, summary, detail))
    tokens = q.split()
    every = F.lit(len(tokens) > 1)
    for t in tokens:
        every = every & any_of(*(F.contains(x, F.lit(t)) for x in (n, s, c, d)))
    hits = sum((F.contains(n, F.lit(t)).cast("int") for t in tokens), F.lit(0))
    rules = [(n == q, 100.0, "exact_name"), (n.startswith(q), 85.0, "prefix_name"), (F.contains(n, F.lit(q)), 75.0, "substring_name"), (F.contains(c, F.lit(q)), 60.0, "category_match"), (F.contains(s, F.lit(q)), 50.0, "summary_match"), (F.contains(d, F.lit(q)), 40.0, "detail_match")]
    kind = F.when(every, F.struct(F.round(45.0 + hits / max(len(tokens), 1) * 25.0, 2).alias("match_score"), F.lit("all_tokens").alias("match_type")))
    for test, score, label in reversed(rules):
        kind = F.when(test, F.struct(F.lit(score).alias("match_score"), F.lit(label).alias("match_type"))).otherwise(kind)
    return kind


def embedding_text(name: Column, short: Column, brief: Column, detail: Column, limit: int = 2400) -> Column:
    """name: short — brief — detail, each once whatever its case, up to a length."""
    parts = F.filter(F.array(short, brief, detail), lambda x: x.isNotNull() & (F.trim(x) != ""))
    once = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(F.trim(y)) == F.lower(F.trim(x))), acc).otherwise(F.concat(acc, F.array(F.trim(x)))))
    return F.left(F.concat_ws(": ", name, F.nullif(F.array_join(once, " — "), F.lit(""))), F.lit(limit))
