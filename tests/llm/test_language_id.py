import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import language_id as li
from textloom.llm.splits import bounded_sample, fold

LETTERS = {"aa": "abcde", "bb": "defgh", "cc": "ghaij", "dd": "jklmé", "ee": "жзик"}


def corpus(seed=1, n=600):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(LETTERS))
        out.append((i, " ".join("".join(r.choices(LETTERS[lang], k=r.randint(2, 7))) for _ in range(r.randint(8, 60))), lang))
    return out


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 6, 9, 30):
        code = li.codewords(n)
        gaps = [int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)]
        assert min(gaps) >= max(1, code.shape[1] // 5)


def test_counts_equal_brute_force():
    rows = [b"Abc", b"", b"x", b"hello hello"]
    buf, off = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    whole = li.ngram_counts(buf, off)
    assert whole.sum(1).tolist() == [3, 0, 0, 19]
    assert (whole == li.ngram_counts(buf, off, piece=4)).all()
    for i, row in enumerate(rows):
        assert (li.ngram_counts(np.frombuffer(row.lower(), np.uint8), np.array([0, len(row)]))[0] == whole[i]).all()


def test_held_out_accuracy(spark):
    df = spark.createDataFrame([(*r, "q") for r in corpus()], "doc_id long, text string, lang string, score string")
    model = li.learn(df.where(fold("doc_id", 5) != 0), sample_rows=300)
    got = li.predict(df, model, keep=["doc_id", "lang"]).where(fold("doc_id", 5) == 0).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "жз"), (4, "жз"), (None, "abc " * 30000)], "doc_id long, text string")
    model = li.learn(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    got = sorted((str(r.doc_id), r.lang_pred) for r in li.predict(df, model).collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "ee"), ("4", "ee"), ("None", "aa")]
    none = li.learn(df.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {(r.lang_pred, r.score) for r in li.predict(df, none).collect()} == {("und", 0.0)}
    one = li.learn(spark.createDataFrame([(1, "abc", "aa")], "doc_id long, text string, lang string"))
    assert li.predict(df, one).where("doc_id = 4").first().lang_pred == "aa"
    assert li.predict(df.limit(0), model).count() == 0


def test_decoding_equals_brute_force():
    rows = corpus(3, 80)
    x = li.unit(np.concatenate([li.ngram_counts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for _, t, _ in rows]))
    model = li.fit(x[:60], [lang for _, _, lang in rows[:60]])
    best, score, gap = model.predict(x)
    for i, v in enumerate(x.astype(float)):
        margins = [sum(v[d] * float(model.weights[d, b]) for d in np.flatnonzero(v)) + float(model.weights[-1, b]) for b in range(model.code.shape[1])]
        loss = [sum(t * np.log1p(np.exp(-m * c)) for t, m, c in zip(model.trust[j], margins, model.code[j], strict=True)) for j in range(len(model.langs))]
        order = np.argsort(loss)
        assert best[i] == order[0] and abs(gap[i] - (loss[order[1]] - loss[order[0]])) < 1e-4
        assert abs(score[i] - 1 / sum(np.exp(-4 * (np.array(loss) - min(loss))))) < 1e-4


def test_repeated_ids_and_clashing_names(spark):
    df = spark.createDataFrame([(*r, "q") for r in corpus(n=200) for _ in range(3)], "doc_id long, text string, lang string, score string")
    a, b = (li.learn(x, sample_rows=50) for x in (df.repartition(5), df.orderBy(F.desc("text")).coalesce(2)))
    assert np.array_equal(a.weights, b.weights) and a.langs == b.langs
    out = li.predict(df, a, keep=["doc_id", "score", "lang"])
    assert out.columns.count("score") == 1 and out.count() == 600
    hot = spark.createDataFrame([(7, "abc", "aa")] * 500 + [(i, "def", "bb") for i in range(20)], "doc_id long, text string, lang string")
    assert bounded_sample(hot, "doc_id", 10).count() == 10
