"""Joins on keys of which a few may hold much of a table: those keys are dealt to several parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that go to one part.
MOST = 1 << 10
#: So many of the largest keys are dealt; the table of them is broadcast (some MB), and any other key holds at most one row in KEYS.
KEYS = 1 << 18


def hot_keys(counts: DataFrame, key: str, n: str = "n", most: int | None = None) -> DataFrame:
    """(key, _parts) of the largest keys with more than `most` rows, from a table (key, n)."""
    most = most or MOST
    return counts.where(F.col(n) > most).orderBy(F.col(n).desc(), key).limit(KEYS).select(key, F.ceil(F.col(n) / most).cast("int").alias("_parts"))


def join_dealt(left: DataFrame, right: DataFrame, key: str, spread: str, hot: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """left inner join right on key. left may hold any number of rows of a key, right a few.

    A hot key's rows of left are dealt by hash of `spread` to its parts, its rows of right go to every part.
    hot: from hot_keys; else left is counted. Null keys match nothing.
    """
    if hot is None:
        hot = hot_keys(left.groupBy(key).agg(F.count("*").alias("n")), key, most=most)
    a = left.join(F.broadcast(hot), key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    b = right.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return a.join(b, [key, "_part"]).drop("_part")
