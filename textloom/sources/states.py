"""Book states, cached chunks and graphs that were kept as JSON files, read as tables.

A state file: book_id, book_title, publication_date, chunks (an array) and processed_chunks (by chunk id, each with its
extraction). Files are read whole and parsed by schema in the JVM; files that are no JSON object give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T

_CHUNK = "chunk_id string, book_id string, chapter_idx int, chunk_idx int, section_title string, chapter_title string, breadcrumb string, text string, char_count int, filter_state string, embedding array<double>"
_CONCEPT = "name string, summary string, brief_description string, detailed_explanation string, category string, weight int, supporting_quote string, source_quote string, related_concepts array<string>"
_EXTRACTION = f"concepts array<struct<{', '.join(':'.join(f.split(' ')) for f in _CONCEPT.split(', '))}>>, extracted_ideas array<struct<idea_statement:string,source_quote:string,key_entities:array<string>>>"
_FIELDS = lambda ddl: ", ".join(":".join(f.split(" ", 1)) for f in ddl.split(", "))
_STATE = f"book_id string, book_title string, publication_date string, chunks array<struct<{_FIELDS(_CHUNK)}>>, processed_chunks map<string, struct<status:string, extraction:struct<{_FIELDS(_EXTRACTION)}>, cached_extraction:struct<{_FIELDS(_EXTRACTION)}>>>"
_GRAPH = "nodes array<struct<id:string, type:string, name:string, chunk_id:string, weight:double, embedding:array<double>, text:string, category:string, summary:string, brief_description:string, detailed_explanation:string>>, edges array<struct<source:string, target:string, relation:string>>"


def _read(spark: SparkSession, path: str, schema: str, glob: str) -> DataFrame:
    inner = spark._jvm.org.apache.hadoop.fs.Path(path, ".book_states")  # listings leave hidden folders out
    here = [path, inner.toString()] if inner.getFileSystem(spark._jsc.hadoopConfiguration()).exists(inner) else [path]
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(here, wholetext=True)
    rows = files.select(F.col("_metadata.file_name").alias("file"), F.from_json("value", schema).alias("s"))
    return rows.where("s is not null").select("file", "s.*")


def states(spark: SparkSession, path: str) -> DataFrame:
    """(file, book_id, book_title, publication_date, chunks, processed_chunks) of each book_*_state.json under a path; of one book's files, the first by name. A missing book_id is taken from the file's name."""
    own = F.nullif(F.regexp_extract("file", r"^book_(.+)_state\.json$", 1), F.lit(""))
    rows = _read(spark, path, _STATE, "book_*_state.json").withColumn("book_id", F.coalesce("book_id", own))
    return rows.groupBy("book_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "book_id"]), "file").alias("r")).select("book_id", "r.*")


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Chunks that save_chunks (or book_*_chunks.json files) hold: book_id and the fields of a chunk."""
    rows = _read(spark, path, f"book_id string, book_title string, chunks array<struct<{_FIELDS(_CHUNK)}>>", "*")
    return rows.select(F.col("book_id").alias("_book"), "book_title", F.explode("chunks").alias("c")).select("book_title", "c.*", "_book").withColumn("book_id", F.coalesce("book_id", "_book")).drop("_book")


def state_chunks(state: DataFrame) -> DataFrame:
    """The chunks of states, with their book's id, title and date."""
    rows = state.select(F.col("book_id").alias("_book"), "book_title", "publication_date", F.explode("chunks").alias("c"))
    return rows.select("book_title", "publication_date", "c.*", "_book").withColumn("book_id", F.col("_book")).drop("_book").where("chunk_id is not null")


def _extractions(state: DataFrame) -> DataFrame:
    """(book_id, chunk_id, x): the extraction of each processed chunk, the cached one where the own has no concepts."""
    rows = state.select("book_id", F.explode("processed_chunks").alias("chunk_id", "p"))
    some = lambda c: F.size(F.coalesce(F.col(f"{c}.concepts"), F.array())) > 0
    return rows.select("book_id", "chunk_id", F.when(some("p.extraction"), F.col("p.extraction")).when(F.col("p.cached_extraction").isNotNull(), F.col("p.cached_extraction")).otherwise(F.col("p.extraction")).alias("x")).where("x is not null")


def raw_ideas(state: DataFrame, book_id: str | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """(book_id, chunk_id, name, summary, brief, detail, category, weight, quote, related, quote_weight): every extracted concept with a name; quote_weight is its quote's length, 100 without one. skipped (chunk_id): chunks to leave out."""
    rows = _extractions(state)
    if book_id is not None:
        rows = rows.where(F.col("book_id") == str(book_id))
    if skipped is not None:
        rows = rows.join(skipped.select("chunk_id").distinct(), "chunk_id", "left_anti")
    c = rows.select("book_id", "chunk_id", F.explode("x.concepts").alias("c")).where(F.trim(F.coalesce("c.name", F.lit(""))) != "")
    quote = F.coalesce(F.nullif("c.supporting_quote", F.lit("")), F.nullif("c.source_quote", F.lit("")), F.lit(""))
    return c.select("book_id", "chunk_id", F.trim("c.name").alias("name"), "c.summary", F.col("c.brief_description").alias("brief"), F.col("c.detailed_explanation").alias("detail"), "c.category", "c.weight", quote.alias("quote"), F.col("c.related_concepts").alias("related"), F.coalesce(F.nullif(F.length(quote), F.lit(0)), F.lit(100)).alias("quote_weight"))


def graph_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph kept in one JSON file: id, type, name and the like; src, dst, relation."""
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", _GRAPH).alias("g"))
    nodes = one.select(F.explode("g.nodes").alias("n")).select("n.*").withColumnsRenamed({"brief_description": "brief", "detailed_explanation": "detail"})
    return nodes, one.select(F.explode("g.edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.relation")


def simulation_data(spark: SparkSession, path: str, graph: tuple[DataFrame, DataFrame] | None = None, max_books: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) for replays: chunks with book_id, sort_date, chunk_idx, chunk_id, char_count, embedding (its own, else the graph's) and the lower-cased names extracted from it; vectors (name, vector) of the graph's concepts.

    max_books: only so many books, the earliest by date, then id: the caller's own limit.
    """
    state = states(spark, path).withColumn("sort_date", T.sort_date(F.col("publication_date")))
    if max_books is not None:
        state = state.join(F.broadcast(state.select("book_id", "sort_date").orderBy("sort_date", "book_id").limit(max_books).select("book_id")), "book_id", "left_semi")
    own = state_chunks(state).join(state.select("book_id", "sort_date"), "book_id")
    names = raw_ideas(state).groupBy("book_id", "chunk_id").agg(F.sort_array(F.collect_set(F.lower("name"))).alias("names"))
    rows = own.join(names, ["book_id", "chunk_id"], "left").select("book_id", "sort_date", "chunk_idx", "chunk_id", "section_title", F.coalesce("char_count", F.length("text")).alias("char_count"), "embedding", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    if graph is None:
        return rows, spark.createDataFrame([], "name string, vector array<double>")
    nodes = graph[0].where(F.size("embedding") > 1)
    is_chunk = (F.col("type") == "Chunk") | F.startswith("id", F.lit("chunk:"))
    known = nodes.where(is_chunk).select(F.regexp_replace(F.coalesce("chunk_id", "id"), "^chunk:", "").alias("chunk_id"), F.col("embedding").alias("_v")).dropDuplicates(["chunk_id"])
    vectors = nodes.where(~F.coalesce(is_chunk, F.lit(False))).select(F.lower(F.trim(F.coalesce("name", F.regexp_replace("id", "^concept:", "")))).alias("name"), F.col("embedding").alias("vector"), "id")
    vectors = vectors.where("name <> ''").groupBy("name").agg(F.max_by("vector", "id").alias("vector"))
    return rows.join(known, "chunk_id", "left").withColumn("embedding", F.coalesce("embedding", "_v")).drop("_v"), vectors


def reference_data(state: DataFrame, most: int = 150) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, ideas, relations) that pairs are made from: of a book with more than `most` chunks every n-th in order (n = chunks // most) up to `most`, as the comparison defines it.

    chunks: chunk, book, section, idx, text (300 characters), embedding of the most common length; ideas: idea, book, chunk, embedding of the
    chunk it was first seen in (by book, then order); relations (a, b): each once.
    """
    from pyspark.sql import Window

    from textloom.operators.similarity import modal_dimension

    w = Window.partitionBy("book_id")
    rows = state.select("book_id", F.posexplode("chunks").alias("at", "c")).withColumn("n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    taken = rows.where((F.col("n") <= most) | ((F.col("at") % step == 0) & (F.col("at") / step < most))).where("c.chunk_id is not null and size(c.embedding) > 0")
    chunks = modal_dimension(taken.select(F.col("c.chunk_id").alias("chunk"), F.col("book_id").alias("book"), F.coalesce("c.section_title", F.lit("")).alias("section"), F.coalesce("c.chunk_idx", F.lit(0)).alias("idx"), F.left(F.coalesce("c.text", F.lit("")), F.lit(300)).alias("text"), F.col("c.embedding").alias("embedding"), "at"))
    made = state.select("book_id", F.explode("processed_chunks").alias("chunk", "p")).select("chunk", F.col("p.extraction").alias("x")).join(chunks.select("chunk", "book", "embedding", "at"), "chunk")
    concepts = made.select("chunk", "book", "embedding", "at", F.posexplode("x.concepts").alias("k", "c"), F.lit(0).alias("kind")).select("chunk", "book", "embedding", "at", "kind", "k", F.trim("c.name").alias("idea"), F.col("c.related_concepts").alias("related"))
    said = made.select("chunk", "book", "embedding", "at", F.posexplode("x.extracted_ideas").alias("k", "c"), F.lit(1).alias("kind")).select("chunk", "book", "embedding", "at", "kind", "k", F.trim("c.idea_statement").alias("idea"), F.lit(None).cast("array<string>").alias("related"))
    every = concepts.unionByName(said).where("idea <> ''")
    ideas = every.groupBy("idea").agg(F.min_by(F.struct("book", "chunk", "embedding"), F.struct("book", "at", "kind", "k")).alias("r")).select("idea", "r.book", "r.chunk", "r.embedding")
    relations = concepts.where("idea <> ''").select(F.col("idea").alias("a"), F.explode("related").alias("b")).select("a", F.trim("b").alias("b")).where("b <> ''").distinct()
    return chunks.drop("at"), ideas, relations


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks (with book_id and, if there, book_title) as one JSON object for each book, under path by book; a book's chunks meet in one task. Written anew as a whole, so readers see the old or the new ones."""
    rest = [c for c in chunks.columns if c != "book_title"]
    title = F.min("book_title") if "book_title" in chunks.columns else F.lit("").cast("string")
    order = [c for c in ("chapter_idx", "chunk_idx", "chunk_id") if c in chunks.columns]
    made = chunks.groupBy("book_id").agg(title.alias("book_title"), F.count("*").alias("total_chunks"), F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("c")))).alias("k"))
    json: Column = F.to_json(F.struct(F.col("book_id"), "book_title", "total_chunks", F.current_timestamp().alias("created_at"), F.transform("k", lambda x: x["c"]).alias("chunks")))
    made.select(F.col("book_id").alias("book"), json.alias("value")).write.mode("overwrite").partitionBy("book").text(path)
