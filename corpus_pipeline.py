"""A corpus pipeline: toxicity, line dedup, MinHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes and reads again as the next
stage's docs. All but the last give the columns of docs; rows with a null in any column, empty texts, repeated
rows and empty tables pass through every stage by the rules in the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import byte_bpe, decontaminate, line_dedup, near_dedup, toxicity
from textloom.llm.splits import fold
from textloom.sources.tables import table
from textloom.storage import stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half. The lexicon is learned from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return toxicity.score(docs, lexicon).where(~F.col("is_toxic")).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat in five or more; n_chars, if there, is that of the new text."""
    out = line_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one of least doc_id.

    Rows with a null doc_id belong to no group and all stay. Rows of one doc_id are one document: its equal texts
    stay once, with the other columns that hash least, and its different texts all stay.
    """
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null")
    ids = stash(kept.groupBy("doc_id").agg(F.count("*").alias("_n")), "kept-ids")
    once = docs.join(ids.where("_n = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    often = docs.join(ids.where("_n > 1").select("doc_id"), "doc_id", "left_semi")
    often = often.groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_r")).select("_r.*")
    return once.unionByName(often).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every benchmark item's five-word shingles."""
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), out_col="_leaks").where(F.size("_leaks") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document left."""
    import public_tokenizers as P

    return byte_bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The first stage learns its lexicon; SQL cannot express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
