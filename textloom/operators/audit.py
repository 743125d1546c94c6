"""Audits: intervals of chunks in texts, matching of ideas, worst cases, samples, tolerant JSON, quotes, consolidation payloads."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """Pairs of intervals (key, start, end) of two tables that overlap, as (key, l_start, l_end, r_start, r_end, contained): an equi-join on blocks of positions, each pair found in its first common block.

    contained: the right one's middle lies in the left one.
    """
    spread = lambda df, p: df.select(key, F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest("start", F.col("end") - 1) / width))).alias("block"))
    both = spread(left, "l").join(spread(right, "r"), [key, "block"]).where("l_start < r_end and l_end > r_start")
    first = F.floor(F.greatest("l_start", "r_start") / width)
    middle = (F.col("r_start") + F.col("r_end")) / 2
    return both.where(F.col("block") == first).select(key, "l_start", "l_end", "r_start", "r_end", middle.between(F.col("l_start"), F.col("l_end")).alias("contained"))


def locate(text: Column, query: Column) -> Column:
    """struct(start, end), from 0, of a query in a text: exact, else between its first and last 50 characters (queries of over 100), else with any run of blanks for a run of blanks; nulls if not found."""
    at = F.instr(text, query)
    head, tail = F.instr(text, F.left(query, F.lit(50))), F.instr(text, F.right(query, F.lit(50)))
    near = (F.length(query) > 100) & (head > 0) & (tail > head)
    words = F.transform(F.filter(F.split(query, r"\s+"), lambda x: x != ""), lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    found = F.regexp_substr(text, F.array_join(words, "\\s+"))
    loose = F.instr(text, found)
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return F.when((query != "") & (at > 0), span(at - 1, at - 1 + F.length(query))).when(near, span(head - 1, tail - 1 + 50)).when((F.size(words) > 0) & found.isNotNull(), span(loose - 1, loose - 1 + F.length(found)))


def held_verbatim(docs: DataFrame, items: DataFrame, doc_cols: list[str], item_cols: list[str], text: Column, item_text: Column, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_cols, item_cols): the items whose text a document holds. Items are the stated query set: sent to the scan of the documents in blocks of about block_chars characters; blank ones are held by nothing."""
    own = items.select(*item_cols, item_text.alias("_i")).where("_i <> ''")
    total = own.agg(F.sum(F.length("_i"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    out = None
    for b in range(blocks):
        part = own.where(F.pmod(F.xxhash64(*item_cols), F.lit(blocks)) == b).agg(F.collect_list(F.struct(*item_cols, "_i")).alias("_items"))
        both = docs.select(*doc_cols, text.alias("_t")).join(F.broadcast(part), F.lit(True))
        hit = both.select(*doc_cols, F.explode(F.filter("_items", lambda x: F.contains(F.col("_t"), x["_i"]))).alias("_x")).select(*doc_cols, *(F.col(f"_x.{c}").alias(c) for c in item_cols))
        out = hit if out is None else out.unionByName(hit)
    return out


def greedy_match(sims: DataFrame, block: str, left: str, right: str, sim: str, least: float) -> DataFrame:
    """(block, left, right, sim): each left item, in order, takes its first unmatched right item of that similarity or more.

    Blocks stream through tasks in order; a task holds the right items that its block has used, not its pairs.
    """
    own = sims.where((F.col(sim) >= least) & F.col(left).isNotNull() & F.col(right).isNotNull()).select(block, left, right, sim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, item, done, used = object(), None, False, set()
        for batch in batches:
            keep = []
            for i, (b, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if b != now:
                    now, item, used = b, object(), set()
                if x != item:
                    item, done = x, False
                if not done and y not in used:
                    used.add(y)
                    done = True
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return own.repartition(block).sortWithinPartitions(block, left, right).mapInArrow(run, own.schema)


def worst(df: DataFrame, sim: str, text: str, id_col: str, offset: int = 0, most: int = 500, chars: int | None = None) -> DataFrame:
    """The rows of least similarity, one for each normal text, after `offset`; at most `most` rows and `chars` characters: a top-k report."""
    normal = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    once = df.withColumn("_n", normal).groupBy("_n").agg(F.min_by(F.struct(*df.columns), F.struct(sim, id_col)).alias("r")).select("r.*")
    head = once.orderBy(sim, id_col).limit(offset + most)
    ranked = head.withColumn("place", F.row_number().over(Window.orderBy(sim, id_col)))
    out = ranked.where(F.col("place") > offset)
    if chars is None:
        return out
    return out.withColumn("_c", F.sum(F.length(text)).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_c") <= chars).drop("_c")


def sample(df: DataFrame, id_col: str, share: float, seed: int = 42) -> DataFrame:
    """About that share of rows, by hash of the id: the same rows whatever the partitions."""
    return df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def llm_json(raw: Column) -> Column:
    """Model output without its thoughts and fences."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"(?is)<think>.*?</think>", ""), r"(?i)```(?:json)?", ""), r"^\s+|\s+$", "")


def salvage(text: str) -> list:
    """Objects of a JSON array that may be cut short: the whole ones."""
    text = re.sub(r"(?i)```(?:json)?", "", re.sub(r"(?is)<think>.*?</think>", "", text)).strip()
    try:
        found = json.loads(text)
        return found if isinstance(found, list) else [found]
    except ValueError:
        out, at, decoder = [], text.find("{"), json.JSONDecoder()
        while at >= 0:
            try:
                x, end = decoder.raw_decode(text, at)
                out.append(x)
                at = text.find("{", end)
            except ValueError:
                at = text.find("{", at + 1)
        return out


def salvage_column(raw: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: [json.dumps(x, sort_keys=True) for x in salvage(v or "")])

    return run(raw)


def prune_quotes(quotes: list[str], most: int = 5) -> list[str]:
    """Longest quotes (15 characters or more) that neither hold nor share over 85% of their words with one kept."""
    plain = lambda q: re.sub(r"\W+", " ", q.lower()).strip()
    kept: list[tuple[str, str, set]] = []
    for q in sorted(dict.fromkeys(x.strip() for x in quotes if len(x.strip()) >= 15), key=len, reverse=True):
        p = plain(q)
        w = set(p.split())
        if not any(p in o or o in p or (w and v and len(w & v) / min(len(w), len(v)) > 0.85) for _, o, v in kept):
            kept.append((q, p, w))
        if len(kept) == most:
            break
    return [q for q, _, _ in kept]


def prune_quotes_column(quotes: Column, most: int = 5) -> Column:
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: prune_quotes([x for x in v if x], most) if v is not None else None)

    return run(quotes)


def disproportion(a: Column, b: Column) -> Column:
    """1 - matching characters / all different ones: how little two chunks share, 0 to 1."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            def one(p, q):
                same = sum(m.size for m in difflib.SequenceMatcher(None, p or "", q or "", autojunk=False).get_matching_blocks())
                whole = len(p or "") + len(q or "") - same
                return 1 - same / whole if whole else 0.0
            yield pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return run(a, b)


def safe_component(name: Column) -> Column:
    """A reversible file name: all but letters, digits, dot, dash and underscore as %XX."""
    return F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))


def store_properties(columns: dict[str, str]) -> list[Column]:
    """Columns for a store of primitives: primitives and lists of them stay, all else becomes JSON. columns: name to type."""
    plain = re.compile(r"(?:array<)?(?:string|int|bigint|double|float|boolean)>?")
    return [F.col(c) if plain.fullmatch(k) else F.to_json(F.col(c)).alias(c) for c, k in columns.items()]


def _clip(text: Column, most: int) -> Column:
    """At most that many characters, cut at a blank."""
    cut = F.left(text, F.lit(most))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, r"\s+\S*\z", ""), F.lit("...")))


def payload(seen: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, payload): the first three descriptions (150 characters) with their quotes (100), and two more quotes (120), in order, nulls last. A key's first five rows are all that is gathered; one with neither gives no line."""
    ranked = seen.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).asc_nulls_last() for c in order)))).where("_r <= 5 and (description is not null or quote is not null)")
    line = F.concat(F.lit("- "), _clip(F.coalesce("description", F.lit("")), 150), F.when(F.coalesce("quote", F.lit("")) != "", F.concat(F.lit(' "'), _clip(F.col("quote"), 100), F.lit('"'))).otherwise(""))
    more = F.when(F.coalesce("quote", F.lit("")) != "", F.concat(F.lit('> "'), _clip(F.col("quote"), 120), F.lit('"')))
    rows = ranked.select(key, "_r", F.when(F.col("_r") <= 3, line).otherwise(more).alias("l")).where("l is not null")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "l"))), lambda x: x["l"]), "\n").alias("payload"))


def consolidate(seen: DataFrame, key: str, order: str) -> DataFrame:
    """(key, detail, related): details in order, each once, and the first five related names."""
    rows = F.array_sort(F.collect_list(F.struct(order, "detail", "related")))
    pick = seen.groupBy(key).agg(rows.alias("r"))
    detail = F.array_join(F.array_distinct(F.filter(F.transform("r", lambda x: F.trim(x["detail"])), lambda x: x.isNotNull() & (x != ""))), "\n\n")
    names = F.slice(F.array_distinct(F.flatten(F.filter(F.transform("r", lambda x: x["related"]), lambda x: x.isNotNull()))), 1, 5)
    return pick.select(key, detail.alias("detail"), names.alias("related"))


def absorb(clusters: DataFrame, others: DataFrame, theta: float = 0.92) -> DataFrame:
    """(cluster, id, sim): each concept outside the batch joins the first cluster, by number, at theta or more."""
    from textloom.operators.similarity import nearest

    n = max(1, clusters.count())
    hits = nearest(others.select("id", F.col("embedding").alias("v")), clusters.select("cluster", "embedding"), n, row_vec="v", target_id="cluster", target_vec="embedding", out="h", least=theta)
    first = F.array_min(F.transform("h", lambda x: F.struct(x["id"].alias("cluster"), x["sim"].alias("sim"))))
    return hits.where(F.size("h") > 0).select(first["cluster"].alias("cluster"), "id", first["sim"].alias("sim"))


def sample_context(sections: DataFrame, book: str, order: str, embed, most: int = 12000, tau: float = 0.85, parts: int = 6) -> DataFrame:
    """(book, context): about six sections (over 80 characters, evenly spaced, 1,800 characters each) that do not repeat any chosen before."""
    w = Window.partitionBy(book)
    own = sections.where(F.length("text") > 80).withColumn("_r", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    picked = own.where(F.col("_r") % F.greatest(F.lit(1), F.floor(F.col("_n") / parts)) == 0).select(book, "_r", F.left("text", F.lit(1800)).alias("text"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_r")
        kept, vectors, size = [], [], 0
        for text, v in zip(rows["text"], embed(rows["text"].tolist()), strict=True):
            v = np.asarray(v, float)
            v = v / max(float(np.linalg.norm(v)), 1e-12)
            if size + len(text) > most:
                break
            if not any(float(u @ v) >= tau for u in vectors):
                kept.append(text)
                vectors.append(v)
                size += len(text)
        return pd.DataFrame({book: [rows[book].iloc[0]], "context": ["\n\n".join(kept)]})

    return picked.groupBy(book).applyInPandas(run, T.StructType([picked.schema[book], T.StructField("context", T.StringType())]))


def vicreg(df: DataFrame, a: str, b: str, invariance: float = 15.0, variance: float = 15.0, covariance: float = 5.0) -> float:
    """Invariance, variance and covariance loss of two views of each row; sums are added up in the tasks."""
    first = df.select(F.size(a)).first()
    if first is None:
        return 0.0
    dim = first[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, gap, sums, squares = 0, 0.0, np.zeros((2, dim)), np.zeros((2, dim, dim))
        for part in batches:
            x = [np.array(part[c].tolist(), float) for c in (a, b)]
            n, gap = n + len(part), gap + float(((x[0] - x[1]) ** 2).sum())
            for i in range(2):
                sums[i] += x[i].sum(0)
                squares[i] += x[i].T @ x[i]
        yield pd.DataFrame({"n": [n], "gap": [gap], "s": [sums.ravel()], "q": [squares.ravel()]})

    parts = df.select(a, b).mapInPandas(run, "n long, gap double, s array<double>, q array<double>")
    total = parts.agg(F.sum("n").alias("n"), F.sum("gap").alias("gap")).first()
    add = lambda c: np.array([r.v for r in parts.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])
    n, s, q = total.n, add("s").reshape(2, dim), add("q").reshape(2, dim, dim)
    loss = invariance * total.gap / (n * dim)
    for i in range(2):
        cov = (q[i] - np.outer(s[i], s[i]) / n) / max(n - 1, 1)
        loss += variance * float(np.maximum(0, 1 - np.sqrt(np.diag(cov) + 1e-4)).mean()) / 2
        loss += covariance * float((cov**2).sum() - (np.diag(cov) ** 2).sum()) / dim
    return loss
