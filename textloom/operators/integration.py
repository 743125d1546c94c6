"""Routed chunks and extracted ideas brought into a graph, vectors filled in, books added. New rows are given, to be merged by operators.graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from textloom.functions import text as T

Embed = Callable[[list[str]], np.ndarray]


@dataclass
class Additions:
    nodes: DataFrame
    edges: DataFrame


def _concept(name: Column) -> Column:
    return F.concat(F.lit("concept:"), name)


def _both(links: DataFrame, rest: list[str]) -> DataFrame:
    """SUPPORTED_BY and SUPPORTS_IDEA edges of (concept, chunk, ..)."""
    return links.select(F.col("concept").alias("src"), F.col("chunk").alias("dst"), F.lit("SUPPORTED_BY").alias("relation"), *rest).unionByName(links.select(F.col("chunk").alias("src"), F.col("concept").alias("dst"), F.lit("SUPPORTS_IDEA").alias("relation"), *rest))


def _explores(links: DataFrame) -> DataFrame:
    """Book to idea edges, with how often and since when."""
    named = links.where("book_id is not null")
    return named.groupBy(F.concat(F.lit("book:"), F.col("book_id").cast("string")).alias("src"), F.col("concept").alias("dst")).agg(F.lit("EXPLORES_IDEA").alias("relation"), F.count("*").alias("occurrences"), F.min("month").alias("month"))


def high_confidence(routed: DataFrame) -> Additions:
    """What high-confidence chunks add: routed has chunk_id, text, book_id, publication_date, tier, idea (the matched name) and summary.

    The chunk's node with filter_state retain, its support of the idea with the text's first 200 characters as quote, and the book's link. Rows without an idea add nothing.
    """
    rows = routed.where((F.col("tier") == "high_confidence") & F.col("idea").isNotNull()).withColumns({"chunk": F.concat(F.lit("chunk:"), "chunk_id"), "concept": _concept(F.col("idea")), "month": T.idea_month(F.col("publication_date"))})
    nodes = rows.select(F.col("chunk").alias("id"), F.lit("Chunk").alias("type"), F.lit("retain").alias("filter_state")).distinct()
    links = rows.select("concept", "chunk", F.left("text", F.lit(200)).alias("quote"), F.col("summary").alias("brief"), "month", "book_id")
    edges = _both(links, ["quote", "brief", "month"])
    return Additions(nodes, edges.unionByName(_explores(links), allowMissingColumns=True))


def extracted_concepts(concepts: DataFrame) -> Additions:
    """What extracted ideas add: concepts has chunk_id, book_id, publication_date, name, summary, brief, detail, category, weight, quote, embedding.

    Blank names and ideas without a vector add nothing. Missing texts are filled from one another (summary from brief, then the
    name), category from Idea, weight from 5. One node for each name: occurrences counted, largest weight, longest texts.
    """
    from textloom.operators.graph import merge_concepts

    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = concepts.withColumn("name", F.trim("name")).where((F.col("name") != "") & F.col("embedding").isNotNull())
    rows = rows.withColumn("summary", F.coalesce(blank("summary"), blank("brief"), F.col("name")))
    rows = rows.withColumns({"brief": F.coalesce(blank("brief"), "summary"), "detail": F.coalesce(blank("detail"), "summary"), "category": F.coalesce(blank("category"), F.lit("Idea")), "weight": F.coalesce(F.nullif("weight", F.lit(0)), F.lit(5)), "month": T.idea_month(F.col("publication_date")), "concept": _concept(F.col("name")), "chunk": F.concat(F.lit("chunk:"), "chunk_id"), "has_formula": T.has_formula(F.col("detail"))})
    merged = merge_concepts(rows, "concept", "chunk_seq") if "chunk_seq" in rows.columns else merge_concepts(rows.withColumn("chunk_seq", F.xxhash64("chunk_id", "name")), "concept", "chunk_seq")
    first = rows.groupBy("concept").agg(F.min("name").alias("name"), F.min("category").alias("category"), F.min("month").alias("month"))
    nodes = merged.join(first, "concept").select(F.col("concept").alias("id"), F.lit("Concept").alias("type"), "name", "category", "occurrences", "weight", "brief", "detail", "embedding", "has_formula", "month")
    links = rows.select("concept", "chunk", F.coalesce("quote", F.lit("")).alias("quote"), "brief", "detail", "month", "book_id")
    return Additions(nodes, _both(links, ["quote", "brief", "detail", "month"]).unionByName(_explores(links), allowMissingColumns=True))


def embedded(rows: DataFrame, text: Column, embed: Embed, vec: str = "embedding", batch_chars: int = 16000, batch_items: int = 64, item_chars: int = 6000) -> DataFrame:
    """rows with vectors of `text` where `vec` is null and the text is not blank: the caller's embedder is given batches of bounded size, each text cut to item_chars."""
    plain = rows.withColumn("_text", F.when(F.col(vec).isNull(), F.nullif(F.left(F.trim(text), F.lit(item_chars)), F.lit(""))))
    names, at = plain.columns, plain.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, vectors = batch.column(len(names) - 1).to_pylist(), batch.column(at).to_pylist()
            for part in _batches([(i, t) for i, t in enumerate(texts) if t is not None], batch_chars, batch_items):
                for (i, _), v in zip(part, embed([t for _, t in part]), strict=True):
                    vectors[i] = [float(x) for x in v]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(vectors, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names[:-1])

    return plain.mapInArrow(run, T_.StructType(rows.schema.fields))


def _batches(items: list[tuple[int, str]], chars: int, most: int) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for i, t in items:
        if held and (size + len(t) > chars or len(held) == most):
            yield held
            held, size = [], 0
        held.append((i, t))
        size += len(t)
    if held:
        yield held


def backfill_embeddings(nodes: DataFrame, embed: Embed, dim: int | None = None, cached: DataFrame | None = None, project: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """nodes with vectors for the ideas and chunks that lack one (or one of length dim): from cached (id, embedding) first, then by the embedder, of an idea's name and texts and of a chunk's text.

    project may turn cached vectors of other lengths into those of length dim. Other nodes stay as they are.
    """
    wanted = F.col("type").isin("Concept", "Idea", "Chunk")
    fits = F.size("embedding") == dim if dim else F.size("embedding") > 1
    out = nodes.withColumn("embedding", F.when(~wanted | F.coalesce(fits, F.lit(False)), F.col("embedding")))
    if cached is not None:
        known = project(cached) if project is not None else cached
        known = known.where(fits).groupBy("id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("_cached"))
        out = out.join(known, "id", "left").withColumn("embedding", F.when(wanted, F.coalesce("embedding", F.col("_cached").cast(nodes.schema["embedding"].dataType))).otherwise(F.col("embedding"))).drop("_cached").select(*nodes.columns)
    have = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    text = F.when(F.col("type") == "Chunk", have("text")).when(wanted, T.embedding_text(have("name"), have("brief"), have("brief"), have("detail")))
    return embedded(out, text, embed)


def add_books(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Book rows (book_id, title, author, summary, publication_date, arxiv_id) after a series of additions (with seq): the last title, the last known author, the longest summary (ties: the earlier), the last known date and paper id, which may stand in the title."""
    paper = F.coalesce(F.nullif("arxiv_id", F.lit("")), F.nullif(F.regexp_extract("title", r"(\d{4}\.\d{4,5})", 1), F.lit("")))
    rows = new.withColumns({"arxiv_id": paper, "publication_date": T.publication_date(F.col("publication_date")), "author": F.nullif(F.nullif("author", F.lit("")), F.lit("Unknown")), "summary": F.coalesce("summary", F.lit(""))})
    every = old.withColumn(seq, F.lit(None).cast(new.schema[seq].dataType)).withColumn("author", F.nullif("author", F.lit("Unknown"))).unionByName(rows.select(*[c for c in old.columns], seq))
    at = F.struct(F.col(seq).isNotNull(), F.col(seq))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    longest = F.max_by("summary", F.struct(F.length("summary"), F.col(seq).isNull(), -F.col(seq)))
    return every.groupBy("book_id").agg(last("title").alias("title"), F.coalesce(last("author"), F.lit("Unknown")).alias("author"), longest.alias("summary"), last("publication_date").alias("publication_date"), last("arxiv_id").alias("arxiv_id"))


def concept_vectors(nodes: DataFrame, edges: DataFrame | None = None, hybrid: bool = False, alpha: float = 0.35) -> DataFrame:
    """(id, name, vector) of idea and formula nodes that have a vector, of the most common length. hybrid: composite with a block of formula features of their texts and of the formulas that HAS_FORMULA edges name."""
    from textloom.functions import vectors as V
    from textloom.functions.formulas import formula_vector
    from textloom.operators.similarity import modal_dimension

    rows = nodes.where(F.col("type").isin("Concept", "Idea", "Formula") & (F.size("embedding") > 1))
    name = F.coalesce("name", F.regexp_replace("id", "^(concept|formula):", ""))
    if not hybrid:
        return modal_dimension(rows.select("id", name.alias("name"), F.col("embedding").alias("vector")), "vector")
    have = [c for c in ("name", "brief", "detail", "summary", "quote", "raw_latex", "label") if c in nodes.columns]
    said = F.concat_ws(" ", *have)
    if edges is not None and "raw_latex" in nodes.columns:
        named = edges.where("relation = 'HAS_FORMULA'").join(nodes.select(F.col("id").alias("dst"), F.col("raw_latex").alias("_l")), "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("_l")), " ").alias("_more"))
        rows = rows.join(named, "id", "left")
        said = F.concat_ws(" ", *have, "_more")
    flag = F.coalesce(F.col("has_formula"), F.lit(False)) if "has_formula" in nodes.columns else F.lit(False)
    math = F.when(flag | (F.col("type") == "Formula") | T.has_formula(said), said).otherwise("")
    made = rows.withColumn("_math", formula_vector(math)).select("id", name.alias("name"), V.composite(F.col("embedding"), F.col("_math"), alpha).alias("vector"))
    return modal_dimension(made, "vector")


def corpus_vectors(extractions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(name, vector, weight) of every extracted idea (name, quote) whose lower-cased name has a vector (name, vector): weight is the quote's length, 100 without one."""
    key = F.lower(F.trim("name"))
    known = vectors.select(key.alias("_k"), F.col("vector")).dropDuplicates(["_k"])
    weight = F.coalesce(F.nullif(F.length("quote"), F.lit(0)), F.lit(100)).cast("double")
    return extractions.withColumn("_k", key).join(known, "_k").select(F.col("_k").alias("name"), "vector", weight.alias("weight"))


def reconcile_formulas(formulas: DataFrame, ideas: DataFrame) -> DataFrame:
    """Ideas of chunks after their formulas: formulas (chunk, pos, raw, normal, quote, lhs, rhs, label), ideas (chunk, seq, statement, quote, kind, entities).

    Every idea stays; one whose quote or statement names a formula is marked, and becomes a Mathematical Formulation unless it is a
    Theoretical Claim. Formulas that no idea names and that relate two sides become ideas (seq null); lesser ones only in chunks without ideas.
    """
    f = formulas.select("chunk", "pos", "raw", "normal", F.col("quote").alias("fq"), F.coalesce("lhs", F.lit("")).alias("lhs"), F.coalesce("rhs", F.lit("")).alias("rhs"), F.coalesce(F.trim("label"), F.lit("")).alias("label"))
    both = ideas.join(f, "chunk", "left")
    quote, said = F.coalesce("quote", F.lit("")), F.coalesce("statement", F.lit(""))
    related = T.any_of(*(F.contains(said, F.lit(s)) for s in ("=", "≈", "∼", "≤", "≥")))
    in_quote = F.contains(quote, F.col("raw")) | ((F.col("lhs") != "") & F.contains(quote, F.col("lhs")))
    hit = in_quote | F.contains(T.latex(quote), F.col("normal")) | ((F.col("lhs") != "") & F.contains(said, F.col("lhs")) & related)
    loose = in_quote | ((F.col("lhs") != "") & F.contains(said, F.col("lhs")))
    rest = [c for c in ideas.columns if c not in ("chunk", "seq")]
    seen = both.groupBy("chunk", "seq").agg(F.first(F.struct(*rest)).alias("r"), F.min(F.when(hit, F.col("pos"))).alias("pos"), F.coalesce(F.bool_or(loose), F.lit(False)).alias("loose"))
    marked = F.col("pos").isNotNull() | F.col("loose") | F.coalesce(F.col("r.kind").isin("Formula", "Mathematical Formulation"), F.lit(False))
    kind = F.when(marked & ~F.coalesce(F.col("r.kind").isin("Theoretical Claim"), F.lit(False)), "Mathematical Formulation").otherwise(F.col("r.kind"))
    any_formula = f.select("chunk").distinct().withColumn("_f", F.lit(True))
    own = seen.join(any_formula, "chunk", "left").select("chunk", "seq", "r.statement", "r.quote", F.when(F.col("_f"), kind).otherwise(F.col("r.kind")).alias("kind"), "r.entities", (F.coalesce("_f", F.lit(False)) & marked).alias("has_formula"))
    used = seen.where("pos is not null").select("chunk", "pos")
    normal = F.col("normal")
    sides = ((F.col("lhs") != "") & (F.col("rhs") != "")) | ((F.length(normal) >= 6) & T.any_of(*(F.contains(normal, F.lit(s)) for s in ("=", "\\le", "\\ge", "≤", "≥", "<", ">", "\\approx", "\\sim"))))
    busy = ideas.select("chunk").distinct().withColumn("_i", F.lit(True))
    left = f.join(used, ["chunk", "pos"], "left_anti").join(busy, "chunk", "left").where(sides | F.col("_i").isNull())
    short = (F.col("lhs") != "") & (F.length("lhs") <= 40) & ~T.any_of(*(F.contains("lhs", F.lit(s)) for s in ("\\", "$", "\n")))
    label = F.when(F.col("label") != "", F.col("label")).when(short, F.concat(F.trim("lhs"), F.lit(" Formulation"))).otherwise(F.concat(F.lit("Formula: "), F.left(F.trim(F.replace(normal, F.lit("$"), F.lit(""))), F.lit(35))))
    new = left.select("chunk", F.lit(None).cast(ideas.schema["seq"].dataType).alias("seq"), F.concat(F.lit("Mathematical formulation for "), label, F.lit(": "), "raw").alias("statement"), F.coalesce(F.nullif("fq", F.lit("")), "raw").alias("quote"), F.lit("Mathematical Formulation").alias("kind"), F.array(label, F.lit("Mathematical Formulation")).alias("entities"), F.lit(True).alias("has_formula"))
    return own.unionByName(new)
