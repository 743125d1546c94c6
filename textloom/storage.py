"""Tables written between jobs, so that lost executors cost a reread and lineage stays short."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one of this process, on a local master alone: executors elsewhere would not see it."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, _OWN["dir"], True)
    return _OWN["dir"]


def clear(spark: SparkSession) -> int:
    """Remove every table that this process has written, and say how many. DataFrames that rest on them cannot be read afterwards."""
    jvm, n = spark._jvm, 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def stash(df: DataFrame, name: str, compression: str = "zstd", partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    writer = df.write.option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stash_bucketed(df: DataFrame, name: str, column: str, compression: str = "none") -> DataFrame:
    """As stash, dealt into as many buckets by a column as there are shuffle partitions: joins on it need not shuffle this side.

    The files lie in the shared folder; the catalog holds a name for them only while the plan is made.
    """
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    _WRITTEN.append(f"{shared_dir(spark)}/{own}")
    try:
        df.write.format("parquet").option("compression", compression).option("path", _WRITTEN[-1]).bucketBy(buckets, column).saveAsTable(own)
        out = spark.table(own)
        out.schema  # noqa: B018  resolved before the name goes
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {own}")
    return out
