"""Running sums and places over all rows in order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.storage import stash


def running(df: DataFrame, order: list[str], sums: dict[str, Column], first: bool = False) -> DataFrame:
    """df with each of `sums` summed over all rows before, in order; with first, the row's own value too.

    Ranges of rows by their order are summed apart, then one total for each range is added: a row for each partition
    reaches the driver. Nulls sort first and count as 0. Equal rows share a range; their order among them is not fixed.
    """
    names = df.columns
    by = [F.col(c).asc_nulls_first() for c in order]
    plain = df.select(*names, *(F.coalesce(v, F.lit(0)).alias(f"_v_{c}") for c, v in sums.items()))
    kept = stash(plain.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "running")
    totals = kept.groupBy("_part").agg(*(F.sum(f"_v_{c}").alias(c) for c in sums)).orderBy("_part").collect()
    kinds = {c: kept.agg(F.sum(f"_v_{c}").alias(c)).schema[c].dataType.simpleString() for c in sums}
    base, at = [], dict.fromkeys(sums, 0)
    for r in totals:
        base.append((r._part, *at.values()))
        at = {c: at[c] + r[c] for c in sums}
    small = F.broadcast(df.sparkSession.createDataFrame(base, ", ".join(["_part int", *(f"_b_{c} {kinds[c]}" for c in sums)])))
    w = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    own = lambda c: F.lit(0) if first else F.col(f"_v_{c}")
    out = kept.join(small, "_part").select(*(F.col(n) for n in names), *((F.col(f"_b_{c}") + F.sum(f"_v_{c}").over(w) - own(c)).alias(c) for c in sums))
    return out


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with each row's number from 1, in order."""
    return running(df, order, {out: F.lit(1).cast("long")}, first=True)


def percentile_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the share of rows (those with a value) that are no larger; null values have none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    summed = running(counts, [value], {"_upto": F.col("_n")}, first=True)
    total = F.broadcast(counts.agg(F.sum("_n").alias("_all")))
    shares = summed.join(total, F.lit(True)).select(F.col(value).alias("_value"), (F.col("_upto") / F.col("_all")).alias(out))
    return df.join(shares, F.col(value) == F.col("_value"), "left").drop("_value")
