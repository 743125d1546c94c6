"""A property graph as two tables: nodes(id, type, ...) and edges(src, dst, relation, ...), one edge for each ordered pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_edges(edges: DataFrame, seq: str, attributes: list[str] | None = None) -> DataFrame:
    """One edge for each (src, dst): of each attribute the last non-null value, by the order of writing."""
    names = attributes or [c for c in edges.columns if c not in ("src", "dst", seq)]
    return edges.groupBy("src", "dst").agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in names))


def first_edges(edges: DataFrame, seq: str) -> DataFrame:
    """One edge for each (src, dst): the first one seen, whole."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.groupBy("src", "dst").agg(F.min_by(F.struct(*rest), seq).alias("e")).select("src", "dst", *(F.col(f"e.{c}").alias(c) for c in rest))


def stub_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that edges name and the table lacks, with the type their id's prefix gives, weight 5 and one occurrence."""
    kinds = F.create_map(*(F.lit(x) for pair in {"book": "Book", "section": "Section", "chunk": "Chunk", "concept": "Concept", "formula": "Formula"}.items() for x in pair))
    named = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return named.join(nodes.select("id"), "id", "left_anti").select("id", F.coalesce(kinds[F.substring_index("id", ":", 1)], F.lit("Node")).alias("type"), F.lit(5).alias("weight"), F.lit(1).alias("occurrences"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n, mean_weight): counts by node type and relation, the mean weight of each type to one place."""
    a = nodes.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 1).alias("mean_weight")).select(F.lit("node").alias("kind"), F.col("type").alias("name"), "n", "mean_weight")
    b = edges.groupBy("relation").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("relation").alias("name"), "n", F.lit(None).cast("double").alias("mean_weight"))
    return a.unionByName(b)


def consistency(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Counts by type side by side. Where all types agree a row `total` compares all rows, null types too."""
    both = local.groupBy("type").agg(F.count("*").alias("here")).join(remote.groupBy("type").agg(F.count("*").alias("there")), "type", "full")
    both = both.select("type", F.coalesce("here", F.lit(0)).alias("here"), F.coalesce("there", F.lit(0)).alias("there"))
    totals = local.agg(F.count("*").alias("here")).join(remote.agg(F.count("*").alias("there")), F.lit(True)).select(F.lit("total").alias("type"), "here", "there")
    agree = both.agg(F.coalesce(F.bool_and(F.col("here") == F.col("there")), F.lit(True)).alias("agree"))
    both = both.unionByName(totals.join(F.broadcast(agree), F.lit(True)).where("agree").drop("agree"))
    return both.withColumn("difference", F.col("here") - F.col("there")).withColumn("state", F.when(F.col("difference") == 0, "equal").when(F.col("difference") > 0, "missing there").otherwise("extra there"))


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of both, attribute by attribute the new value unless it is null."""
    rest = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    pick = lambda c: F.coalesce(*(F.col(f"{side}.`{c}`") for side, df in (("b", new), ("a", old)) if c in df.columns))
    same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    return a.join(b, same, "full").select(*(F.coalesce(F.col(f"b.`{k}`"), F.col(f"a.`{k}`")).alias(k) for k in keys), *(pick(c).alias(c) for c in rest))


def merge_concepts(seen: DataFrame, key: str, seq: str) -> DataFrame:
    """Observations (weight, brief, detail, embedding, has_formula) to one concept for each key.

    Occurrences are counted, the largest weight and the longest texts win (ties: the earlier), the first vector stays.
    """
    longest = lambda c: F.max_by(F.col(c), F.struct(F.length(c), -F.col(seq)))
    return seen.groupBy(key).agg(F.count("*").alias("occurrences"), F.max("weight").alias("weight"), longest("brief").alias("brief"), longest("detail").alias("detail"), F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.col(seq))).alias("embedding"), F.bool_or("has_formula").alias("has_formula"))


def observations(concepts: DataFrame, normal: Column, name: str = "name") -> DataFrame:
    """Mentions grouped by normal name: aliases, distinct chunks, largest weight, earliest month, canonical name (most often written, then shortest, then first)."""
    by_name = concepts.withColumn("_n", normal).where("_n <> ''").groupBy("_n", name).agg(F.count("*").alias("k"), F.max("weight").alias("w"), F.min("month").alias("m"), F.collect_set("chunk_id").alias("c"))
    best = F.max_by(F.col(name), F.struct(F.col("k"), -F.length(name), F.transform(F.split(name, ""), lambda x: -F.ascii(x))))
    out = by_name.groupBy("_n").agg(best.alias("canonical"), F.sort_array(F.collect_set(name)).alias("aliases"), F.max("w").alias("max_weight"), F.min("m").alias("first_month"), F.array_distinct(F.flatten(F.collect_list("c"))).alias("chunk_ids"), F.sum("k").alias("mentions"))
    return out.withColumnRenamed("_n", "normal").withColumn("total_occurrences", F.greatest("mentions", F.size("chunk_ids").cast("long")))


def compare(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """One row: sizes, common and own names of two sets, Jaccard and overlap ratios (0 for empty sets)."""
    x, y = a.select(name).distinct().withColumn("in_a", F.lit(1)), b.select(name).distinct().withColumn("in_b", F.lit(1))
    one = x.join(y, name, "full").agg(F.count("in_a").alias("size_a"), F.count("in_b").alias("size_b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("common"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return one.select("*", (F.col("size_a") - F.col("common")).alias("only_a"), (F.col("size_b") - F.col("common")).alias("only_b"), zero(F.try_divide("common", F.col("size_a") + F.col("size_b") - F.col("common"))).alias("jaccard"), zero(F.try_divide("common", "size_a")).alias("overlap_a"), zero(F.try_divide("common", "size_b")).alias("overlap_b"))


@dataclass
class Removal:
    nodes: DataFrame
    edges: DataFrame
    gone: DataFrame  # (id, type) of all removed nodes

    def counts(self) -> DataFrame:
        return self.gone.groupBy("type").agg(F.count("*").alias("removed"))


def remove_books(nodes: DataFrame, edges: DataFrame, books: DataFrame, owned: tuple[str, ...] = ("HAS_SECTION", "HAS_CHUNK"), anchors: tuple[str, ...] = ("Book", "Section", "Chunk")) -> Removal:
    """Remove books (id) with what they own, two steps down, then the concepts they touched that no anchor node touches any more."""
    ids = books.select("id").distinct()
    step = edges.where(F.col("relation").isin(*owned))
    below = step.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    under = step.join(below.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    body = ids.union(below).union(under).distinct()
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ends = both.join(body.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    touched = ends.join(nodes.where("type = 'Concept'").select("id"), "id", "left_semi")
    kept = nodes.where(F.col("type").isin(*anchors)).select("id").join(body, "id", "left_anti")
    held = both.join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    orphans = touched.join(held, "id", "left_anti")
    gone = nodes.select("id", "type").join(body.union(orphans), "id", "left_semi")
    dead = gone.select("id")
    left = edges.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)
    return Removal(nodes.join(dead, "id", "left_anti").select(*nodes.columns), left, gone)


def redirect(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with both ends mapped by aliases (alias, canonical); loops go, and one edge is kept for each pair and relation."""
    a = aliases.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    out = edges.join(a.select(F.col("alias").alias("src"), F.col("canonical").alias("_s")), "src", "left").join(a.select(F.col("alias").alias("dst"), F.col("canonical").alias("_d")), "dst", "left")
    out = out.withColumn("src", F.coalesce("_s", "src")).withColumn("dst", F.coalesce("_d", "dst")).where("src <> dst")
    return out.select("src", "dst", "relation").distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(seed, id, hop): nodes within `hops` steps of each seed (id), whatever the direction; the least number of steps."""
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(edges.select(F.col("dst").alias("x"), F.col("src").alias("y")))
    reached = front = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop")).distinct()
    for h in range(1, hops + 1):
        if h > 1:
            front = front.select("seed", "id").distinct()
        near = both.join(front.select(F.col("id").alias("x")).distinct(), "x", "left_semi").distinct()  # only what the frontier touches is told apart
        front = front.join(near, front["id"] == near["x"]).select("seed", F.col("y").alias("id"), F.lit(h).alias("hop"))
        reached = reached.union(front)
    return reached.groupBy("seed", "id").agg(F.min("hop").alias("hop")).where("hop > 0")


def new_books(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Our books (id, title) that theirs lack: matched by paper id in the title, else by title signature (4 letters or more), else by id with equal signatures."""
    paper = lambda c: F.nullif(F.regexp_extract(c, r"(\d{4}\.\d{4,5})", 1), F.lit(""))
    sign = lambda c: F.regexp_replace(F.lower(c), r"(?U)[^\w]+", "")
    a = ours.withColumns({"_p": paper(F.col("title")), "_s": sign(F.col("title"))})
    b = theirs.select(F.col("id").alias("_id"), paper(F.col("title")).alias("_p"), sign(F.col("title")).alias("_s"))
    out = a.join(b.where("_p is not null").select("_p").distinct(), "_p", "left_anti")
    out = out.join(b.where("length(_s) >= 4").select("_s").distinct(), "_s", "left_anti")
    return out.join(b, (F.col("id") == F.col("_id")) & (out["_s"] == b["_s"]), "left_anti").select(*ours.columns)


def difference_subgraph(nodes: DataFrame, edges: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of a graph that new books (id) add: they, what they own, their concepts and those concepts' neighbours among concepts, and the edges between."""
    ids = books.select("id")
    near = neighbours(edges, ids, 1).select("id").union(ids).distinct()
    concepts = near.join(nodes.where("type = 'Concept'").select("id"), "id", "left_semi")
    more = neighbours(edges, concepts, 1).select("id").join(nodes.where("type in ('Concept', 'Book')").select("id"), "id", "left_semi")
    keep = near.union(more).distinct()
    inner = edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
    return nodes.join(keep, "id", "left_semi").select(*nodes.columns), inner


def row_hash(columns: list[str], length: int = 32) -> Column:
    """Hex digest of the non-null columns as sorted key=value lines."""
    pairs = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in sorted(columns)]
    return F.left(F.sha2(F.concat_ws("\n", *pairs), 256), F.lit(length))


def node_hash(df: DataFrame, id_col: str = "id", label: str = "type", length: int = 32) -> Column:
    """Hex digest of a node: its id, label, and all other columns but content_hash by name as key=value. Vectors count by their first 16 numbers to four places and their length; other lists and structs as JSON; nulls are left out."""
    parts = [F.concat_ws(":", id_col, label, F.lit(""))]
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if f.name in (id_col, label, "content_hash"):
            continue
        c, kind = F.col(f.name), f.dataType.simpleString()
        if kind in ("array<float>", "array<double>"):
            value = F.concat(F.array_join(F.transform(F.slice(c, 1, 16), lambda x: F.format_string("%.4f", x.cast("double"))), ","), F.lit(";len="), F.size(c))
        else:
            value = F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(f"{f.name}="), value, F.lit("|"))))
    return F.left(F.sha2(F.concat_ws("", *parts), 256), F.lit(length))


def compare_graphs(a_nodes: DataFrame, a_edges: DataFrame, b_nodes: DataFrame, b_edges: DataFrame, samples: int = 10) -> tuple[DataFrame, DataFrame]:
    """(types, one): nodes by type and edges by relation on both sides with their difference and mean text length (nodes with text); and compare()'s row of idea names with up to `samples` names that one side alone has."""
    def counts(nodes: DataFrame, edges: DataFrame, side: str) -> DataFrame:
        chars = F.avg(F.length("text")) if "text" in nodes.columns else F.lit(None).cast("double")
        n = nodes.groupBy(F.lit("node").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias(f"n_{side}"), chars.alias(f"chars_{side}"))
        return n.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("relation").alias("name")).agg(F.count("*").alias(f"n_{side}"), F.lit(None).cast("double").alias(f"chars_{side}")))

    both = counts(a_nodes, a_edges, "a").join(counts(b_nodes, b_edges, "b"), ["kind", "name"], "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_a", "n_b")})
    x, y = (n.where("type in ('Concept', 'Idea')").select(F.lower(F.trim("name")).alias("name")).distinct() for n in (a_nodes, b_nodes))
    first = lambda p, q, out: p.join(q, "name", "left_anti").orderBy("name").limit(samples).agg(F.sort_array(F.collect_list("name")).alias(out))
    one = compare(x, y).join(first(x, y, "samples_a"), F.lit(True)).join(first(y, x, "samples_b"), F.lit(True))
    return both.withColumn("difference", F.col("n_b") - F.col("n_a")), one


def group_hash(df: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """(key, content_hash): digest of the rows' digests in order; combined in the group, so groups are to be of bounded size (a book)."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda r: r[digest])
    return df.groupBy(key).agg(F.sha2(F.array_join(rows, ""), 256).alias("content_hash"))


def changed(new: DataFrame, old: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of new whose (key, digest) old lacks: what an upsert has to write."""
    return new.join(old.select(key, digest), [key, digest], "left_anti").select(*new.columns)


def changes(new: DataFrame, old: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, changed, removed or same."""
    a, b = new.select(key, F.col(digest).alias("x")), old.select(key, F.col(digest).alias("y"))
    state = F.when(F.col("y").isNull(), "added").when(F.col("x").isNull(), "removed").when(F.col("x") == F.col("y"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("change"))


def sequence_links(chunks: DataFrame, book: str, order: list[Column], id_col: str) -> DataFrame:
    """NEXT and PREV edges between neighbours of a book."""
    w = Window.partitionBy(book).orderBy(*order)
    pairs = chunks.select(F.col(id_col).alias("src"), F.lead(id_col).over(w).alias("dst")).where("dst is not null")
    return pairs.select("src", "dst", F.lit("NEXT").alias("relation")).union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("PREV").alias("relation")))


def chunk_order(chapter: Column, chunk_idx: Column, chunk_id: Column, crumb: Column) -> list[Column]:
    """(chapter, place): the place from the index, else from _pN_ in the id, else from [part a.b] in the breadcrumb."""
    pick = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).cast("int")
    return [chapter, F.coalesce(chunk_idx.cast("int"), pick(chunk_id, r"_p(\d+)_"), pick(crumb, r"\[part \d+\.(\d+)\]")), chunk_id]


def shards(sizes: DataFrame, book: str, size: str, limit: float) -> DataFrame:
    """(book, shard): whole books in order of id, a new shard where the next would pass the limit.

    Greedy packing is sequential: ids and sizes, a row for each book, stream in order through one task, which holds one
    batch of them.
    """
    import pyarrow as pa

    def run(batches):
        shard, used = 0, 0.0
        for batch in batches:
            out = []
            for s in batch.column(1).to_pylist():
                if used and used + s > limit:
                    shard, used = shard + 1, 0.0
                used += s
                out.append(shard)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], [book, "shard"])

    kind = sizes.schema[book].dataType.simpleString()
    own = sizes.select(book, F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias(size))
    return own.repartition(1).sortWithinPartitions(book).mapInArrow(run, f"{book} {kind}, shard long")


def spine(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("Book", "Section", "Concept")) -> tuple[DataFrame, DataFrame]:
    """Nodes of the spine types and edges with both ends there."""
    top = nodes.where(F.col("type").isin(*kinds))
    ids = top.select("id")
    return top, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
