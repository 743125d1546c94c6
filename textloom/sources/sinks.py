"""Sinks: graphs as Parquet, GraphML, GEXF and notes; packages; backups with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import file_name


def _xml(c: Column) -> Column:
    out = F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _ordered(spark: SparkSession, parts: list[DataFrame], head: str, foot: str, path: str) -> None:
    """Write (line) frames in order between a head and a foot, one file for each range of lines."""
    frames = [spark.createDataFrame([(0, "", head)], "part int, key string, line string")]
    frames += [p.select(F.lit(i).alias("part"), F.col("key").cast("string").alias("key"), "line") for i, p in enumerate(parts, 1)]
    frames.append(spark.createDataFrame([(len(parts) + 1, "", foot)], "part int, key string, line string"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    out.orderBy("part", "key").select("line").write.text(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, buckets: int = 64) -> None:
    """nodes and edges as Parquet, by type and relation, edges also by bucket of their source."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.withColumn("bucket", F.pmod(F.xxhash64("src"), F.lit(buckets))).write.mode("overwrite").partitionBy("relation", "bucket").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges").drop("bucket")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML with the primitive columns of nodes and the relation of edges."""
    plain = [c for c, k in nodes.dtypes if c != "id" and k in ("string", "int", "bigint", "double", "float", "boolean")]
    kinds = {"int": "int", "bigint": "long", "double": "double", "float": "float", "boolean": "boolean"}
    keys = "".join(f'<key id="{c}" for="node" attr.name="{c}" attr.type="{kinds.get(dict(nodes.dtypes)[c], "string")}"/>' for c in plain)
    data = F.concat_ws("", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), _xml(F.col(c)), F.lit("</data>"))) for c in plain))
    n = nodes.select(F.col("id").alias("key"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data, F.lit("</node>")).alias("line"))
    e = edges.select(F.concat_ws(" ", "src", "dst").alias("key"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"><data key="relation">'), _xml(F.col("relation")), F.lit("</data></edge>")).alias("line"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<key id="relation" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="directed">'
    _ordered(nodes.sparkSession, [n, e], head, "</graph></graphml>", path)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    n = nodes.select(F.col("id").alias("key"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('" label="'), _xml(F.coalesce("name", "id") if "name" in nodes.columns else F.col("id")), F.lit('"/>')).alias("line"))
    middle = nodes.sparkSession.createDataFrame([("", "</nodes><edges>")], "key string, line string")
    e = edges.select(F.concat_ws(" ", "src", "dst").alias("key"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('" label="'), _xml(F.col("relation")), F.lit('"/>')).alias("line"))
    _ordered(nodes.sparkSession, [n, middle, e], '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>', "</edges></graph></gexf>", path)


def notes(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """(file, note): a Markdown note for each concept (id, name, weight, summary) with its linked names, by name. The links of a note meet in one task."""
    named = links.join(concepts.select(F.col("id").alias("dst"), F.col("name").alias("other")), "dst").groupBy("src").agg(F.sort_array(F.collect_set("other")).alias("names"))
    rows = concepts.join(named, concepts["id"] == named["src"], "left")
    related = F.array_join(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.concat(F.lit("- [["), file_name(n), F.lit("]]"))), "\n")
    body = F.concat(F.lit("---\nweight: "), F.coalesce(F.col("weight").cast("string"), F.lit("5")), F.lit("\n---\n# "), F.col("name"), F.lit("\n\n"), F.coalesce("summary", F.lit("")), F.when(related != "", F.concat(F.lit("\n\n## Related\n"), related)).otherwise(""))
    return rows.select(F.concat(file_name(F.col("name")), F.lit(".md")).alias("file"), body.alias("note"))


def notes_index(concepts: DataFrame) -> DataFrame:
    """(place, line): concepts by weight, the heaviest first, then name."""
    from textloom.operators.ranges import numbered

    own = concepts.select((-F.coalesce(F.col("weight").cast("double"), F.lit(-1e308))).alias("_w"), "name", F.concat(F.lit("- [["), file_name(F.col("name")), F.lit("]]")).alias("line"))
    return numbered(own, ["_w", "name"], "place").select("place", "line")


def book_notes(books: DataFrame, sections: DataFrame, mentions: DataFrame) -> DataFrame:
    """(file, note): a note for each book (id, title, author, summary) with its sections, and for each section (id, book, title, summary) with its ideas; mentions (section, name). What a note lists meets in one task, each name once."""
    link = lambda names, head: F.when(F.size(names) > 0, F.concat(F.lit(f"\n\n## {head}\n"), F.array_join(F.transform(names, lambda n: F.concat(F.lit("- [["), file_name(n), F.lit("]]"))), "\n"))).otherwise("")
    none = F.array().cast("array<string>")
    under = sections.groupBy(F.col("book").alias("_b")).agg(F.sort_array(F.collect_set("title")).alias("_s"))
    b = books.join(under, F.col("id") == F.col("_b"), "left").select(F.concat(file_name(F.col("title")), F.lit(".md")).alias("file"), F.concat(F.lit("---\ntype: book\nauthor: "), F.coalesce("author", F.lit("Unknown")), F.lit("\n---\n# "), "title", F.lit("\n\n"), F.coalesce("summary", F.lit("")), link(F.coalesce("_s", none), "Sections")).alias("note"))
    said = mentions.groupBy(F.col("section").alias("_i")).agg(F.sort_array(F.collect_set("name")).alias("_n"))
    s = sections.join(said, F.col("id") == F.col("_i"), "left").join(books.select(F.col("id").alias("book"), F.col("title").alias("_t")), "book", "left")
    s = s.select(F.concat(file_name(F.coalesce("_t", F.lit("Book"))), F.lit(" - "), file_name(F.col("title")), F.lit(".md")).alias("file"), F.concat(F.lit("---\ntype: section\n---\n# "), "title", F.lit("\n\nFrom [["), file_name(F.coalesce("_t", F.lit("Book"))), F.lit("]]\n\n"), F.coalesce("summary", F.lit("")), link(F.coalesce("_n", none), "Ideas")).alias("note"))
    return b.unionByName(s)


def save_shards(nodes: DataFrame, edges: DataFrame, plan: DataFrame, path: str) -> DataFrame:
    """Write a graph as a spine (nodes without a book) and book shards (plan: book, shard), with a manifest: (part, nodes, edges). nodes and edges have a book column, null for the spine's."""
    where = lambda df: df.join(F.broadcast(plan), "book", "left").withColumn("part", F.when(F.col("shard").isNull(), "spine").otherwise(F.concat(F.lit("shard_"), F.col("shard").cast("string")))).drop("shard")
    for name, df in (("nodes", nodes), ("edges", edges)):
        where(df).write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")
    spark = nodes.sparkSession
    n, e = (spark.read.parquet(f"{path}/{x}").groupBy("part").agg(F.count("*").alias(x)) for x in ("nodes", "edges"))
    listed = n.join(e, "part", "full").select(F.col("part").cast("string").alias("part"), F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))
    listed.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("part string, nodes long, edges long").json(f"{path}/manifest")


def load_shards(spark: SparkSession, path: str, parts: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a sharded graph: all of it, or the spine with some shards; only their folders are read."""
    out = []
    for name in ("nodes", "edges"):
        df = spark.read.parquet(f"{path}/{name}")
        out.append((df if parts is None else df.where(F.col("part").isin("spine", *parts))).drop("part"))
    return out[0], out[1]


def save_statistics(reports: dict[str, DataFrame], path: str) -> None:
    """One-row reports as one JSON object, by name, and as a Markdown table."""
    spark = next(iter(reports.values())).sparkSession
    rows = {name: df.first() for name, df in reports.items()}  # a row each
    import json

    plain = {name: (r.asDict(recursive=True) if r is not None else {}) for name, r in rows.items()}
    spark.createDataFrame([(json.dumps(plain, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/json")
    lines = ["| Report | Value | |", "|-|-|-|", *(f"| {n} | {k} | {v} |" for n, r in plain.items() for k, v in r.items())]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def book_list(tables: dict[str, DataFrame]) -> DataFrame:
    """(book_id, title) of the books in a graph's nodes, wherever they were kept: a restored backup, a folder or a store's rows."""
    return tables["nodes"].where("type = 'Book'").select(F.regexp_replace("id", "^book:", "").alias("book_id"), *([F.col("title")] if "title" in tables["nodes"].columns else [F.col("name").alias("title")]))


def opf(articles: DataFrame) -> DataFrame:
    """(paper_id, opf): a package for each article (paper_id, title, authors, primary_category, categories, abstract, abstract_url)."""
    tag = lambda name, c, extra="": F.concat(F.lit(f"<dc:{name}{extra}>"), _xml(c), F.lit(f"</dc:{name}>"))
    people = F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.array(F.lit("Unknown Author")))
    creators = F.array_join(F.transform(people, lambda a: tag("creator", a, ' opf:role="aut"')), "")
    topics = F.array_distinct(F.filter(F.concat(F.array("primary_category"), "categories"), lambda x: x.isNotNull()))
    about = F.concat(F.when(F.coalesce("abstract", F.lit("")) != "", F.concat("abstract", F.lit("\n\n"))).otherwise(""), F.lit("arXiv article "), F.col("paper_id"), F.lit(". Abstract: "), F.coalesce("abstract_url", F.lit("")))
    body = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" unique-identifier="arxiv_id" version="2.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">'),
        tag("title", F.col("title")), creators, tag("identifier", F.col("paper_id"), ' id="arxiv_id" opf:scheme="arxiv"'), F.array_join(F.transform(topics, lambda s: tag("subject", s)), ""), tag("description", about), F.lit("</metadata></package>"),
    )
    return articles.select("paper_id", body.alias("opf"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of all files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def backup(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write tables under a path with a manifest of their files, which is also given back."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/data/{name}")
    listed = manifest(spark, f"{path}/data")
    listed.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(listed.schema).json(f"{path}/manifest")


def verify_backup(spark: SparkSession, path: str) -> DataFrame:
    """(file, state) of a backup's files: intact, changed, missing or extra."""
    kept = spark.read.schema("file string, bytes long, sha256 string").json(f"{path}/manifest").select("file", F.col("sha256").alias("x"))
    now = manifest(spark, f"{path}/data").select("file", F.col("sha256").alias("y"))
    state = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x") == F.col("y"), "intact").otherwise("changed")
    return kept.join(now, "file", "full").select("file", state.alias("state"))


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/data/{name}") for name in names}
