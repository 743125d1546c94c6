import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from textloom.llm import warc_fixity as wf

KIND = "id long, record binary"


def sha(x):
    return hashlib.sha256(x).digest()


def brute_root(rows, marks, height, fan):
    """rows: (id, record) in order of id and leaf, distinct; marks: the leaves' own hashes."""
    at, nodes = 0, []
    for (_, r), m in zip(rows, marks, strict=True):
        nodes.append((sha(b"\x00" + r), at, at + len(r), m))
        at += len(r)
    join = lambda part: sha(b"\x01" + b"".join(h + (x - part[0][1]).to_bytes(8, "big") + (y - x).to_bytes(8, "big") + (1).to_bytes(8, "big") for h, x, y, _ in part))
    for level in range(1, height + 1):
        parts = []
        for n in nodes:
            if not parts or n[3] % fan**level == 0:
                parts.append([])
            parts[-1].append(n)
        nodes = [(join(p), p[0][1], p[-1][2], p[0][3]) for p in parts]
    return join(nodes).hex()


def test_tree_and_offsets(spark):
    rows = [(i, bytes([i % 7]) * (i % 5)) for i in range(90)]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in rows], KIND).repartition(5)
    placed = wf.leaves(df, "id", height=3, fan=3)
    got = placed.orderBy("position").withColumn("m", F.pmod(F.xxhash64("id", "leaf"), F.lit(27))).collect()
    assert [(r.id, r.position, r.byte_offset) for r in got] == [(i, i, sum(len(r) for _, r in rows[:i])) for i in range(90)]
    assert wf.tree(placed, 3).root == brute_root(rows, [r.m for r in got], 3, 3)


def statuses(rows, other):
    """Equal records of an id are intact, the others matched in order of their hashes."""
    out = Counter()
    for i in {i for i, _ in rows} | {i for i, _ in other}:
        x, y = (Counter(bytes(r) for j, r in z if j == i) for z in (rows, other))
        out[i, "intact"] += sum((x & y).values())
        n, m = sum((x - y).values()), sum((y - x).values())
        out[i, "corrupt"] += min(n, m)
        out[i, "missing"] += max(0, n - m)
        out[i, "extra"] += max(0, m - n)
    return +out


def test_any_damage_equals_brute_force(spark):
    r = random.Random(4)
    say = lambda: bytearray(r.randbytes(r.randint(0, 3)))
    for fan in (2, 5):
        rows = [(r.choice([None, 7, *range(60)]), say()) for _ in range(150)] + [(7, bytearray(b"same"))] * 40
        other = [(i, say() if r.random() < 0.1 else x) for i, x in rows if r.random() < 0.9] + [(r.randrange(90), say()) for _ in range(9)]
        a, b = (spark.createDataFrame(x, KIND).repartition(3) for x in (rows, other))
        got = wf.compare(a, b, "id", fan=fan)
        assert Counter((x.id, x.status) for x in got.records.collect()) == statuses(rows, other)
        assert got.root != got.other_root and got.ranges.count() > 0


def test_only_what_differs_is_descended(spark):
    rows = [(i, bytearray(b"r%d" % i)) for i in range(600)]
    a, b = (spark.createDataFrame(x, KIND) for x in (rows, [(i, bytearray(b"x") if i == 300 else r) for i, r in rows]))
    got = wf.compare(a, b, "id", fan=4)
    byte = sum(len(r) for i, r in rows if i < 300)
    ranges = got.ranges.where("level = 1").collect()
    assert 0 < len(ranges) <= 4 and any(r.begin is not None and r.begin <= byte < r.end for r in ranges)
    more = wf.compare(a, spark.createDataFrame([*rows, (10**6, bytearray(b"new"))], KIND), "id")
    assert more.root != more.other_root and [(r.id, r.status) for r in more.records.where("status <> 'intact'").collect()] == [(10**6, "extra")]


def test_audit(spark):
    rows = [(i, bytearray(b"r%d" % i)) for i in range(40)] + [(3, bytearray(b"again")), (3, bytearray(b"r3")), (None, bytearray(b"")), (None, bytearray(b"n"))]
    other = [(i, r) for i, r in rows if i not in (5, 20)]
    other = [(i, bytearray(b"bad") if i in (7, 31) else r) for i, r in other] + [(99, bytearray(b"new"))]
    a, b = (spark.createDataFrame(x, KIND).repartition(4) for x in (rows, other))
    got = wf.audit(a, b, "id", fan=3).collect()
    assert len(got) == len(rows) + 1
    assert {r.id: r.status for r in got if r.status != "intact"} == {5: "missing", 20: "missing", 7: "corrupt", 31: "corrupt", 99: "extra"}
    assert {r.status for r in wf.audit(a, a, "id").collect()} == {"intact"}
    none = a.limit(0)
    assert wf.audit(none, none, "id").count() == 0
    assert {r.status for r in wf.audit(a, none, "id").collect()} == {"missing"}
    assert {r.status for r in wf.audit(none, a, "id").collect()} == {"extra"}


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>é\r\n\r\n</p>"), (2, None, None), (3, "u", "")], "id long, url string, html string")
    records = pages.select("id", wf.record_of(F.col("id"), F.col("url"), F.col("html")).alias("record"))
    wf.write_warc(records.coalesce(1), f"{tmp_path}/w")
    back = wf.read_warc(spark, f"{tmp_path}/w/*.txt").orderBy("byte_offset").collect()
    assert [bytes(r.record) for r in back] == [bytes(r.record) for r in records.orderBy("id").collect()]
    assert [bytes(r.body).decode() for r in back] == ["<p>é\r\n\r\n</p>", "", ""] and back[0].record_id == "<urn:record:1>"


def test_any_bytes_are_written(spark, tmp_path):
    records = spark.createDataFrame([(1, bytearray(b"\xff\x00\xfe\r\n\r\n")), (2, None)], "id long, body binary")
    records = records.select("id", wf.record_of(F.col("id"), F.lit("u"), F.col("body")).alias("record"))
    wf.write_warc(records.unionByName(records.limit(0)).coalesce(1), f"{tmp_path}/b")
    open(f"{tmp_path}/b/empty.txt", "w").close()
    back = wf.read_warc(spark, f"{tmp_path}/b/*.txt").orderBy("byte_offset").collect()
    assert [bytes(r.body) for r in back] == [b"\xff\x00\xfe\r\n\r\n", b""]
