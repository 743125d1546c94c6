import hashlib

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as cp
from textloom.llm import byte_bpe
from textloom.sources.tables import table

from .test_decontaminate import brute as brute_leaks
from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from textloom.storage import stash

    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(stash(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages_keep_the_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def test_toxic_documents_go_and_most_others_stay(spark, stages):
    left = {r.doc_id for r in stages[1].collect()}
    label = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    assert sum(label.get(i) == 0 for i in left) >= 0.97 * sum(v == 0 for v in label.values())
    assert left < {r.doc_id for r in stages[0].collect()}


def test_lines(stages):
    want = {int(i): text for i, _, _, text in brute_lines([(r.doc_id, r.text) for r in stages[1].collect()], 5, 40)}
    got = stages[2].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_near_duplicates(stages):
    want = {int(i) for i, _, _, kept in brute_near([(r.doc_id, r.text) for r in stages[2].collect()], 5) if kept}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_leaks(spark, stages):
    rows = [(r.doc_id, r.text) for r in stages[3].collect()]
    gone = {int(d) for d, *_ in brute_leaks(rows, [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])}
    assert {r.doc_id for r in stages[4].collect()} == {i for i, _ in rows} - gone


def test_tokens_and_run(spark, stages):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {r.doc_id: (len(enc.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in stages[4].collect()}
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in stages[5].collect()} == want
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in cp.run(spark, SF).collect()} == want


def test_odd_rows_pass(spark, tmp_path):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (None, None, None, None, None), (2, "", None, "s", 0), (3, "A  b c d e f g", None, None, 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for part, n in ((df, 3), (df.limit(0), 0)):
        docs = part
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == n


def test_rows_of_one_id(spark):
    rows = [(1, "a b c d e f g", "en"), (1, "a b c d e f g", "de"), (1, "quite another text than the first one", "en"), (2, "A B c d e f g", "en"), (3, "one more text that nobody else has", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picks = {tuple(sorted(map(str, cp.keep_one_of_each_group(spark, d, SF).collect()))) for d in (df, df.orderBy("lang"), df.repartition(3))}
    assert len(picks) == 1
    assert sorted((r.doc_id, r.text[:5]) for r in cp.keep_one_of_each_group(spark, df, SF).collect()) == [(1, "a b c"), (1, "quite"), (3, "one m")]


def test_run_equals_the_stages_by_hand(stages):
    """Toxicity as scored, then every stage by brute force."""
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    rows = [(int(i), text) for i, _, _, text in brute_lines(rows, 5, 40)]
    texts = dict(rows)
    rows = [(int(i), texts[int(i)]) for i, _, _, kept in brute_near(rows, 5) if kept]
    items = [(r.item_id, r.text) for r in table(stages[0].sparkSession, SF, "benchmark").collect()]
    gone = {int(d) for d, *_ in brute_leaks(rows, items)}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows if i not in gone}
    assert {r.doc_id: r.decoded_sha256 for r in stages[5].collect()} == want
