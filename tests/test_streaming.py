import datetime

from textloom.streaming import ledger

T0 = datetime.datetime(2024, 1, 1)
KIND = "item long, status string, at timestamp"


def stream(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame([(k, s, T0 + datetime.timedelta(minutes=m)) for k, s, m in rows], KIND).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_latest_status(spark, tmp_path):
    rows = stream(spark, f"{tmp_path}/in", [[(1, "started", 0), (2, "failed", 1)], [(1, "completed", 5)], [(1, "started", 2)]])
    q = ledger.latest_status(rows, "item", "status", "at").writeStream.outputMode("update").format("memory").queryName("last").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("last").orderBy("changes").collect():
        got[r["item"]] = (r["status"], r["changes"])
    assert got == {1: ("completed", 3), 2: ("failed", 1)}


def test_first_seen_and_batches(spark, tmp_path):
    rows = stream(spark, f"{tmp_path}/in", [[(1, "a", 0)], [(1, "b", 1), (2, "c", 2)]])
    seen = []
    q = ledger.consolidate_every(ledger.first_seen(rows, "item", "at"), lambda df, n: seen.append(sorted(r["item"] for r in df.collect())), f"{tmp_path}/c")
    q.awaitTermination(60)
    assert sorted(sum(seen, [])) == [1, 2]


def test_windows(spark):
    rows = spark.createDataFrame([(1, "a", T0), (1, "a", T0 + datetime.timedelta(minutes=50)), (1, "a", T0 + datetime.timedelta(minutes=55))], KIND)
    assert [r.n for r in ledger.tumbling(rows, "at", "1 hour", "status").collect()] == [3]
    assert sorted(r.n for r in ledger.sessions(rows, "at", "10 minutes", "item").collect()) == [1, 2]
    assert sum(r.n for r in ledger.sliding(rows, "at", "1 hour", "30 minutes", "status").collect()) == 6
