"""Folds by CRC-32, and samples bounded by a count of rows."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32(id as text) mod folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most `rows` distinct ids of df, by least hash: the same whatever the partitions, and however often an id stands.

    Each task hands on its `rows` least alone, so an id of very many rows fills no one's share.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if kept is not None and kept.num_rows == rows:
                now = now.filter(pc.less_equal(now["h"], kept["h"][rows - 1]))
            if now.num_rows:
                now = pa.concat_tables([kept, now]) if kept is not None else now
                kept = now.group_by(["h", id_col]).aggregate([]).select(["h", id_col]).sort_by([("h", "ascending"), (id_col, "ascending")])[:rows].combine_chunks()
        yield from kept.to_batches() if kept is not None else []

    hashed = df.select(F.xxhash64(F.col(id_col), F.lit(17)).alias("h"), id_col)
    return hashed.mapInArrow(least, hashed.schema).distinct().orderBy("h", id_col).limit(rows).select(id_col)


def one_of_each(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row of each id: that whose other columns hash least. Rows of one id meet as partial aggregates."""
    rest = F.struct(*columns)
    return df.groupBy(id_col).agg(F.min_by(rest, F.xxhash64(*columns)).alias("_r")).select(id_col, *(F.col(f"_r.{c}").alias(c) for c in columns))
