import random

from textloom.llm import toxicity as tx
from textloom.llm.splits import fold


def corpus(seed=1, n=400):
    r = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in "blorn" for b in "aeiou" for c in ("sten", "dar", "mil", "kop")]
    bad = ["vilename", "slurword", "hexhate"]
    docs, labels = [], []
    for i in range(n):
        words = r.choices(plain, k=r.randint(20, 120))
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randint(3, 9)):
                w = r.choice(bad)
                words[r.randrange(len(words))] = r.choice([w, w.upper(), w.replace("e", "3").replace("a", "а"), w.replace("l", "ⅼ")])
        elif r.random() < 0.08:
            words += ["vilename", "clinic"] * 3
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_folding_keeps_length():
    assert tx.fold_text("Ѕ1ur\tW0RD ＡＢ") == "siur word ab"
    text = "ÀßЖ😀İ１２ 3"
    assert len(tx.fold_text(text)) == len(text)


def test_hits_stand_alone_and_exceptions_hold():
    m = tx.Lexicon({"slur": 2.0, "slurs": 1.0}, ["slur clinic"], [-3.0, 2.0, 1.0, 1.0]).matcher()
    assert [h[2] for h in m.hits("a 5lur, Slurs! slurred slur clinic")] == ["slur", "slurs"]
    assert m.hits("") == [] and m.score("the slur slur slur") > m.score("the slur") > m.score("")
    assert m.score("slur " + "word " * 5000) < m.score("slur word")  # by length


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, toxicity string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = tx.learn(df, lab.where(fold("doc_id", 5) != 0))
    assert {"vilename", "slurword", "hexhate"} <= set(lexicon.weights)
    out = tx.score(df, lexicon)
    assert out.columns == ["doc_id", "text", "toxicity", "toxic_hits", "is_toxic"]
    want = dict(labels)
    held = out.where(fold("doc_id", 5) == 0).collect()
    assert sum(r.is_toxic == bool(want[r.doc_id]) for r in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "slur " * 20000)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    empty = tx.learn(df, none)
    assert empty.weights == {} and [r.toxicity < 1e-9 for r in tx.score(df, empty).collect()] == [True] * 4
    scored = tx.score(df, tx.Lexicon({"slur": 2.0}, [], [-3.0, 2.0, 1.0, 1.0])).orderBy("toxicity").collect()
    assert [r.is_toxic for r in scored] == [False, False, False, True]
    assert tx.score(df.limit(0), empty).count() == 0


def test_hits_equal_a_naive_matcher():
    r = random.Random(9)
    for _ in range(60):
        words = {"".join(r.choices("abo", k=r.randint(1, 4))): r.random() + 1 for _ in range(8)}
        phrases = [f"{r.choice(list(words))} {''.join(r.choices('abo', k=2))}" for _ in range(3)]
        text = "".join(r.choices("abo0@ .A", k=120))
        got = sorted((a, b, w) for a, b, w, _ in tx.Lexicon(words, phrases).matcher().hits(text))
        flat = tx.fold_text(text)
        alone = lambda a, b: not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())  # noqa: B023, E731
        spans = lambda xs: [(a, a + len(x), x) for x in xs for a in range(len(flat)) if flat.startswith(x, a) and alone(a, a + len(x))]  # noqa: B023, E731
        shields = spans([p for p in phrases if p not in words])
        assert got == sorted(h for h in spans(words) if not any(a <= h[0] and h[1] <= b for a, b, _ in shields))


def test_hits_are_given_whatever_the_score(spark):
    lexicon = tx.Lexicon({"bad": 1.0}, [], [-30.0, 0.0, 0.0, 0.0])
    row = tx.score(spark.createDataFrame([(1, "a bad b4d x")], "doc_id long, text string"), lexicon).first()
    assert row.toxic_hits == ["bad", "bad"] and not row.is_toxic
    edge = tx.Lexicon({}, [], [0.0, 0.0, 0.0, 0.0])
    assert tx.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), edge).first().is_toxic  # exactly the threshold


def test_repeated_ids_are_learned_from_once(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"plain words here {'vile nasty' if i % 2 else 'kind calm'} {j}") for i in range(80) for j in range(3)], "doc_id long, text string")
    a, b = (tx.learn(x, labels) for x in (docs.repartition(4), docs.orderBy("text").coalesce(1)))
    assert a == b and set(a.weights) == {"vile", "nasty"}
