"""The chunk filter cascade: named rules, the first that decides wins. One CASE over columns, nothing else."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import patterns as P
from textloom.functions.text import any_of, as_re2, count_of, formula_in, has, lines, without_links_and_money


@dataclass(frozen=True)
class Chunk:
    """The columns that rules look at; titles and breadcrumb may be literals. own: the text's lines, where they are there already."""

    text: Column
    section: Column
    chapter: Column
    crumb: Column
    formula: Column
    own: Column | None = None

    @property
    def n(self) -> Column:
        return F.length(self.text)

    @property
    def lines(self) -> Column:
        return lines(self.text) if self.own is None else self.own

    @property
    def rows(self) -> Column:
        return F.size(self.lines)

    @property
    def prose(self) -> Column:
        return has(self.text, P.PROSE_GUARD)


Rule = Callable[[Chunk], Column]
_TITLE = rf"(?i)\b{P.REFERENCE_TITLE}\b"


def empty(c: Chunk) -> Column:
    return c.text == ""


def reference_section(c: Chunk) -> Column:
    first = F.coalesce(F.try_element_at(c.lines, F.lit(1)), F.lit(""))
    return any_of(
        *(has(x, _TITLE) for x in (c.section, c.chapter, c.crumb)), has(first, rf"(?i)^{P.REFERENCE_TITLE}\b"),
        (c.n < 900) & has(c.text, P.TOC_DOTS), (c.n < 320) & has(c.text, P.GOVERNANCE) & ~c.prose,
    )


def bibliography(c: Chunk) -> Column:
    t, n, rows = c.text, c.n, c.rows
    brackets, bib, authors = count_of(t, P.CITATION_BRACKET), count_of(t, P.BIB_LINE), count_of(t, P.AUTHOR_TOKEN)
    named = has(t, P.DOI) | has(t, P.ARXIV_ID) | has(t, P.VENUE)
    bare = F.when(F.contains(t, F.lit(":")), F.regexp_replace(t, as_re2(P.LINKS), "")).otherwise(t)
    tail = (rows <= 4) & (authors >= 5) | (n < 220) & has(t, P.CITATION_TAIL) | (n < 250) & named & has(t, P.YEAR) & (has(t, P.NUMBERED_AUTHOR) | (authors >= 2))
    return any_of(
        F.contains(t, F.lit("[")) & ((brackets >= 5) & (rows <= brackets + 3) | (brackets >= 8)), (bib >= 2) & (rows <= bib + 3) & named, F.contains(t, F.lit("arXiv:")) & has(t, P.ARXIV_AUTHORS) & (rows <= 5), (rows <= 4) & has(t, P.PROCEEDINGS_SLICE),
        (n < 350) & (rows <= 3) & (authors >= 4), (n < 650) & has(t, P.REFERENCES_TURN), (n < 280) & tail & ~c.prose & ~F.contains(bare, F.lit(":")) & ~F.contains(bare, F.lit("?")),
    )


def boilerplate(c: Chunk) -> Column:
    heads = count_of(c.text, P.CODE_HEADER)
    return any_of(F.contains(c.text, F.lit("#")) & (heads >= 3) & (c.rows <= heads + 3), (c.n < 400) & has(c.text, P.LICENSE), (c.rows <= 5) & has(c.text, P.SCRAPE_NOISE), (c.n < 300) & has(c.text, P.AFFILIATION) & ~has(c.text, r"(?i)\bAbstract\b") & ~c.prose)


def stimulus(c: Chunk) -> Column:
    q, o = count_of(c.text, P.QUESTION_ITEM), count_of(c.text, P.OPTION_ITEM)
    marks = F.length(c.text) - F.length(F.replace(c.text, F.lit("?"), F.lit("")))
    return any_of(has(c.text, P.TOKENIZER_NOISE), has(c.section, P.SURVEY_TITLE), (q >= 1) & (o >= 3) & (c.rows <= q + o + 2), (c.n < 400) & ~c.prose & has(c.text, P.PROMPT_SCHEMA), (marks >= 4) & (c.n < 150) & ~c.prose)


def diagram(c: Chunk) -> Column:
    own = c.lines
    n = F.size(own)
    total = F.aggregate(own, F.lit(0), lambda s, x: s + F.length(x))
    short = F.size(F.filter(own, lambda x: F.length(x) <= 45))
    ends = F.size(F.filter(own, lambda x: x.endswith(".") | x.endswith(";")))
    scattered = F.contains(c.text, F.lit("\n")) & (n >= 8) & ~F.exists(own, lambda x: has(x, P.TABLE_RULE)) & ~F.exists(own, lambda x: has(x, P.CODE_WORDS)) & (ends <= 1) & (total <= 22 * n) & (short >= 0.85 * n)
    return ~c.formula & any_of((c.n < 600) & has(c.text, P.CHECKMARKS), (c.n < 450) & F.contains(c.text, F.lit("01")) & has(c.text, P.CALLOUTS), scattered)


def caption(c: Chunk) -> Column:
    label = F.startswith(c.text, F.lit("(")) & has(c.text, P.SUBFIGURES) | (c.n < 140) & has(c.text, P.CAPTION) & ~has(c.text, P.CAPTION_VERBS) | (c.n < 160) & has(c.text, P.SIGNPOST)
    return (c.n < 200) & ~c.formula & label & ~c.prose


#: Rules in the order in which they are asked; each skips. More can be registered under other names.
RULES: dict[str, Rule] = {"empty": empty, "ref_sections": reference_section, "biblio": bibliography, "tech_boiler": boilerplate, "dataset_stim": stimulus, "diag_ocr": diagram, "captions_signposts": caption}
DISPLAY_ORDER = ["formulas", *RULES, "limbo", "chunk_sim", "passed"]


def formula_column(text: Column, own: Column | None = None, bare: Column | None = None) -> Column:
    """Whether a chunk holds a formula; lone weak symbols in a bibliography do not count.

    They are alone if nothing is found once they are taken out, by a mark that no formula holds.
    """
    symbols = "".join(P.WEAK_SYMBOLS)
    bare = without_links_and_money(text) if bare is None else bare
    weak = bare.rlike(f"[{symbols}]") & ~formula_in(F.translate(bare, symbols, "\x01" * len(symbols)))
    c = Chunk(text, F.lit(""), F.lit(""), F.lit(""), F.lit(False), own)
    return F.coalesce(formula_in(bare) & ~(weak & bibliography(c)), F.lit(False))


def classify(df: DataFrame, text: str = "text", section: str | None = None, chapter: str | None = None, crumb: str | None = None, formulas: bool = True, rules: list[str] | None = None, sim: Column | None = None, low: float = 0.72, high: float = 0.87) -> DataFrame:
    """df with has_formula, decision (skip or retain) and category.

    A null text is empty. formulas: a formula retains at once. sim: similarity to the nearest known idea, for the
    last step: at `high` or more retain, from `low` skip unless the chunk has a formula or 1,024 characters.
    """
    get = lambda name: F.trim(F.coalesce(F.col(name), F.lit(""))) if name else F.lit("")
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+\z", "")
    out = df.withColumn("_body", body).withColumn("_lines", F.when(F.contains("_body", F.lit("\n")), lines(F.col("_body"))).when(F.col("_body") != "", F.array("_body")).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_bare", without_links_and_money(F.col("_body"))).withColumn("has_formula", formula_column(F.col("_body"), F.col("_lines"), F.col("_bare")))
    c = Chunk(F.col("_body"), get(section), get(chapter), get(crumb), F.col("has_formula"), F.col("_lines"))
    case = F.when(F.lit(formulas) & c.formula & (c.text != ""), "retain:formulas")
    for name in rules if rules is not None else list(RULES):
        case = case.when(RULES[name](c), f"skip:{name}")
    if sim is not None:
        case = case.when(sim >= high, "retain:limbo").when((sim >= low) & ~c.formula & (c.n < 1024), "skip:limbo")
    out = out.withColumn("_verdict", case.otherwise("retain:passed"))
    return out.withColumn("decision", F.substring_index("_verdict", ":", 1)).withColumn("category", F.substring_index("_verdict", ":", -1)).drop("_verdict", "_body", "_lines", "_bare")


#: Steps of a conveyor by the names they are switched by, with their categories.
SWITCHES = {"skip_empty": "empty", "skip_reference_sections": "ref_sections", "skip_bibliographic": "biblio", "skip_technical_boilerplate": "tech_boiler", "skip_dataset_stimulus": "dataset_stim", "skip_diagram_ocr": "diag_ocr", "skip_captions_and_signposts": "captions_signposts"}


def conveyor(df: DataFrame, book: str | None = None, order: list[str] | None = None, text: str = "text", section: str | None = None, chapter: str | None = None, crumb: str | None = None, detect_formulas: bool = True, ideas: DataFrame | None = None, low: float = 0.72, high: float = 0.87, skip_limbo: bool = True, chunk_similarity: bool = False, tau: float = 0.92, window: int = 3, vec: str = "embedding", **switches: bool) -> DataFrame:
    """All steps as they are switched: rules by SWITCHES (all on), similarity to ideas (idea_id, embedding) where given, and similarity to a section's last chunks where asked (then book and order are needed, and a column vec).

    skip_limbo: False lets chunks between low and high pass.
    """
    unknown = set(switches) - set(SWITCHES)
    if unknown:
        raise ValueError(f"no such step: {sorted(unknown)}")
    rules = [name for switch, name in SWITCHES.items() if switches.get(switch, True)]
    sim = None
    if ideas is not None:
        from textloom.operators.similarity import best_match

        df = best_match(df, ideas, row_vec=vec)
        sim = F.col("max_sim") if skip_limbo else F.when(F.col("max_sim") >= high, F.col("max_sim"))
    out = classify(df, text, section, chapter, crumb, detect_formulas, rules, sim, low, high)
    if chunk_similarity:
        from textloom.operators.ordered import chunk_similarity as cover

        out = cover(out, book, order, tau, window, vec)
    return out


def boilerplate_only(text: Column, section: Column | None = None) -> Column:
    """Whether the cascade's rules (no similarity) skip a text."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+\z", "")
    formula = formula_column(body)
    c = Chunk(body, section if section is not None else F.lit(""), F.lit(""), F.lit(""), formula)
    return (~formula | (body == "")) & any_of(*(rule(c) for rule in RULES.values()))


def stats(classified: DataFrame) -> DataFrame:
    """Counts by category, with the place each has on display."""
    place = F.array_position(F.array(*map(F.lit, DISPLAY_ORDER)), F.col("category"))
    return classified.groupBy("category", "decision").agg(F.count("*").alias("chunks")).withColumn("place", place)
