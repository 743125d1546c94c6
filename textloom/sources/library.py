"""A library's catalogue kept in relational tables: books, links to authors, comments, formats; or as a tool's JSON listing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T

NAMES = ["books", "books_authors_link", "authors", "comments", "data"]


@dataclass
class Library:
    """books (id, title, path, pubdate), books_authors_link (id, book, author), authors (id, name), comments (book, text), data (book, format)."""

    books: DataFrame
    books_authors_link: DataFrame
    authors: DataFrame
    comments: DataFrame
    data: DataFrame


def open_library(spark: SparkSession, source: str | dict, properties: dict | None = None) -> Library:
    """The tables of a JDBC address (its driver is the caller's), or of Parquet folders given by name."""
    if isinstance(source, dict):
        return Library(*(spark.read.parquet(source[n]) for n in NAMES))
    return Library(*(spark.read.jdbc(source, n, properties=properties or {}) for n in NAMES))


def list_books(library: Library, root: str = "") -> DataFrame:
    """(id, title, authors, comments, formats, path, publication_date): authors in the order of their links (names that join several by & are parted), formats in capitals by name; a missing title reads Untitled."""
    named = library.books_authors_link.select(F.col("id").alias("_l"), "book", "author").join(library.authors.select(F.col("id").alias("author"), "name"), "author")
    joined = named.groupBy("book").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_l", "name"))), lambda x: x["name"]), " & ").alias("_a"))
    formats = library.data.where("format <> ''").groupBy("book").agg(F.sort_array(F.collect_set(F.upper("format"))).alias("formats"))
    said = library.comments.groupBy("book").agg(F.min("text").alias("comments"))
    b = library.books.select("id", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"), F.concat(F.lit(root.rstrip("/") + "/" if root else ""), F.coalesce("path", F.lit(""))).alias("path"), T.publication_date(F.col("pubdate").cast("string")).alias("publication_date"))
    for side in (joined, formats, said):
        b = b.join(side.withColumnRenamed("book", "_b"), F.col("id") == F.col("_b"), "left").drop("_b")
    people = F.filter(F.transform(F.split(F.coalesce("_a", F.lit("")), "&"), lambda x: F.trim(x)), lambda x: x != "")
    return b.select("id", "title", people.alias("authors"), F.coalesce("comments", F.lit("")).alias("comments"), F.coalesce("formats", F.array().cast("array<string>")).alias("formats"), "path", "publication_date")


def list_books_json(spark: SparkSession, path: str) -> DataFrame:
    """The same from a tool's JSON listing: an array of objects in a file. pubdate and publication_date are both understood."""
    kind = "array<struct<id:bigint, title:string, authors:string, comments:string, formats:array<string>, path:string, pubdate:string, publication_date:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("b")).select("b.*")
    people = F.filter(F.transform(F.split(F.coalesce("authors", F.lit("")), "&"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("id", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"), people.alias("authors"), F.coalesce("comments", F.lit("")).alias("comments"), F.coalesce("formats", F.array().cast("array<string>")).alias("formats"), F.coalesce("path", F.lit("")).alias("path"), T.publication_date(F.coalesce(F.nullif("pubdate", F.lit("")), "publication_date")).alias("publication_date"))


def update_metadata(library: Library, changes: DataFrame) -> Library:
    """The library after changes (book, title, authors, comments; nulls change nothing): titles and comments replaced, links to the named authors made anew, authors not there yet added with the next ids."""
    from textloom.operators.ranges import numbered

    c = changes.groupBy("book").agg(*(F.min(F.when(F.col(n).isNotNull(), F.col(n))).alias(n) for n in ("title", "authors", "comments")))
    title = c.select(F.col("book").alias("id"), F.nullif(F.trim("title"), F.lit("")).alias("_t"))
    books = library.books.join(title, "id", "left").withColumn("title", F.coalesce("_t", "title")).select(*library.books.columns)
    said = c.where("comments is not null").select("book", F.trim("comments").alias("text")).join(library.books.select(F.col("id").alias("book")), "book", "left_semi")
    comments = library.comments.select("book", "text").join(said.select("book"), "book", "left_anti").unionByName(said)
    wanted = c.where(F.size("authors") > 0).join(library.books.select(F.col("id").alias("book")), "book", "left_semi").select("book", F.posexplode("authors").alias("k", "n")).select("book", "k", F.trim("n").alias("name")).where("name <> ''")
    fresh = wanted.select("name").distinct().join(library.authors.select("name"), "name", "left_anti")
    most = lambda df: df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_m"))
    added = numbered(fresh, ["name"], "_n").join(F.broadcast(most(library.authors)), F.lit(True)).select((F.col("_n") + F.col("_m")).alias("id"), "name")
    authors = library.authors.select("id", "name").unionByName(added)
    ids = authors.groupBy("name").agg(F.min("id").alias("author"))
    kept = library.books_authors_link.select("id", "book", "author").join(wanted.select("book").distinct(), "book", "left_anti").select("id", "book", "author")
    links = numbered(wanted.join(ids, "name").groupBy("book", "author").agg(F.min("k").alias("k")), ["book", "k"], "_n")
    links = links.join(F.broadcast(most(library.books_authors_link)), F.lit(True)).select((F.col("_n") + F.col("_m")).alias("id"), "book", "author")
    return Library(books, kept.unionByName(links), authors, comments, library.data)
