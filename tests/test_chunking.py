import random

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import chunking as C
from textloom.operators import ordered as O

TOPICS = {"cat": 0, "ship": 1, "tax": 2}


def embed(texts):
    out = np.zeros((len(texts), 3))
    for i, t in enumerate(texts):
        for w, d in TOPICS.items():
            out[i, d] = t.lower().count(w)
    return out


def test_sections_and_subsections():
    text = "Preface words that are long enough here\n# One\nbody of the first section, long enough\nChapter II The end\nmore text that is long enough"
    assert [t for t, _ in C.sections(text)] == ["Preface words that are long enough here", "One", "Chapter II The end"]
    assert C.sections("short") == [("Section", "short")] and C.sections("") == []
    assert [t for t, _ in C.sections(("p" * 3500 + "\n\n") * 3)] == ["Section 1", "Section 2"]
    assert C.subsections("pre\n# A\nx\n## B\n\n# C\ny", "T") == [("T", "pre"), ("A", "x"), ("C", "y")]


def test_smart_split_keeps_code():
    text = "para one.\n\n```\ncode\n\nmore code\n```\n\n" + "Sentence here. " * 20
    parts = C.smart_split(text, 60)
    assert any("code\n\nmore code" in p for p in parts) and all(len(p) <= 75 for p in parts)
    assert C.smart_split("abc", 10) == ["abc"]


def test_sentences():
    got = C.split_sentences('Dr. Smith met J. Doe. "Where?" asked he. Then left.\n\n# Head\n\nNew para! ok')
    assert got == [("Dr. Smith met J. Doe.", False), ('"Where?" asked he.', False), ("Then left.", True), ("# Head", True), ("New para!", False), ("ok", True)]


def test_rolling_chunks_split_by_topic():
    said = [f"The cat {w} with the other cat on the mat." for w in ("sat", "ran", "lay")] + [f"A ship {w} past another ship at sea." for w in ("went", "came", "sank")] + [f"The tax {w} and one more tax is due." for w in ("rose", "fell", "held")]
    got = C.rolling_chunks(" ".join(said), embed, window=2, least=20, most=150, fixed=0.5, overlap=0)
    assert [(c["start_sentence"], c["end_sentence"], c["split_reason"]) for c in got] == [(0, 2, "semantic_drop"), (3, 5, "semantic_drop"), (6, 8, "document_end")]
    assert C.rolling_chunks("", embed) == [] and C.rolling_chunks("One only.", embed)[0]["split_reason"] == "document_end"
    long_ = C.rolling_chunks("cat word word word word word. " * 60, embed, least=10, most=40, overlap=1)
    assert all(c["token_count"] <= 48 for c in long_) and {c["split_reason"] for c in long_[:-1]} == {"max_tokens_exceeded"}
    assert [c["start_sentence"] for c in long_[1:]] == [c["end_sentence"] for c in long_[:-1]]


def test_thresholds_and_expansion():
    s = np.array([0.1, 0.5, 0.9])
    assert C.threshold(s, "percentile", amount=50) == 0.5 and abs(C.threshold(s, "standard_deviation", amount=1) - (0.5 - s.std())) < 1e-12 and C.threshold(s[:0], fixed=0.7) == 0.7
    assert C.expanding_chunks("A cat. The cat. A ship. Some ship.", embed, limit=0.05) == ["A cat. The cat.", "A ship. Some ship."]


def test_stitch():
    assert C.stitch(["one two three four five.", "three four five. six"]) == "one two three four five. six"
    assert C.stitch(["Start. Shared.", "Shared. End."]) == "Start. Shared. End."
    assert C.stitch(["a", "", "b"]) == "a b" and C.stitch([]) == ""


def test_pack(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate([10, 20, 90, 5, 5, 5, 5, None])], "k string, i int, s int")
    got = [r.batch for r in C.pack(df, "k", ["i"], F.col("s"), 40, 3).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 2, 2, 3, 3]


def cover_rows(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "book int, i int, chapter_idx int, section_title string, text string, category string, decision string, has_formula boolean, embedding array<double>")


def test_semantic_cover(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    p = ("passed", "retain", False)
    rows = [(1, "S", "first", *p, a), (1, "s", "again", *p, a), (1, "S", "other", *p, b), (1, "S", "formula", "formulas", "retain", True, a), (1, "S", "x" * 600, *p, a), (1, "S", "skip", "biblio", "skip", False, a), (2, "References", "Smith", *p, a), (2, "More", "trailing", *p, a), (2, "Appendix A", "kept", *p, a)]
    got = [(r.selected, r.status) for r in O.semantic_cover(cover_rows(spark, rows), "book", ["i"]).orderBy("i").collect()]
    assert got == [(True, "selected_anchor"), (False, "skipped_redundant"), (True, "selected_distinct"), (True, "selected_distinct"), (True, "selected_distinct"), (False, "skipped_reference"), (False, "skipped_reference"), (False, "skipped_reference"), (True, "selected_anchor")]
    one = O.semantic_cover(cover_rows(spark, [(1, "References", "x", *p, None)]), "book", ["i"]).first()
    assert one.selected


def test_leader_clusters_equal_a_loop(spark):
    x = np.random.default_rng(4).normal(size=(60, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    leader: dict[int, int] = {}
    for i in range(60):
        leader[i] = next((j for j in range(i) if leader[j] == j and x[i] @ x[j] >= 0.8), i)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.leader for r in O.leader_clusters(df, "vec_id", 0.8).collect()} == leader
    assert O.leader_clusters(df.limit(0), "vec_id").count() == 0


def test_leader_clusters_write_no_pairs(spark, monkeypatch):
    import textloom.storage as storage
    from textloom.operators import ranges

    counts, stash = [], storage.stash

    def counted(df, *a, **b):
        out = stash(df, *a, **b)
        counts.append(out.count())
        return out

    monkeypatch.setattr(storage, "stash", counted)
    monkeypatch.setattr(ranges, "stash", counted)
    df = spark.createDataFrame([(i, [1.0, i / 1e6] if i % 2 else [-1.0, 0.0]) for i in range(200)], "vec_id long, embedding array<double>")
    assert {(r.vec_id % 2, r.leader) for r in O.leader_clusters(df, "vec_id", 0.9).collect()} == {(0, 0), (1, 1)}
    assert max(counts) <= 200


def test_leader_clusters_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(O, "LEADER_ROWS", 8)
    x = np.random.default_rng(5).normal(size=(300, 6))
    x[40] = 0
    vectors = [None if i in (3, 200) else v[:4].tolist() if i in (7, 150) else v.tolist() for i, v in enumerate(x)]
    units = [np.array(v) / max(np.linalg.norm(v), 1e-12) if v is not None and len(v) == 6 else None for v in vectors]
    leader: dict[int, int] = {}
    for i, u in enumerate(units):
        leader[i] = i if u is None else next((j for j in range(i) if leader[j] == j and units[j] is not None and u @ units[j] >= 0.6), i)
    df = spark.createDataFrame([(f"{i:03}", v) for i, v in enumerate(vectors)], "vec_id string, embedding array<double>").repartition(3)
    assert {int(r.vec_id): int(r.leader) for r in O.leader_clusters(df, "vec_id", 0.6).collect()} == leader


def test_replay(spark):
    v = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(0, [1.0, 0.0], 50.0, [[1.0, 0.0]]), (1, v(0.97), 50.0, []), (2, v(0.75), 50.0, []), (3, [-1.0, 0.0], 50.0, [[-1.0, 0.0]])]
    df = spark.createDataFrame(rows, "i int, embedding array<double>, weight double, ideas array<array<double>>")
    pairs = spark.createDataFrame([(0.65, 0.9), (0.80, 0.9)], "low double, high double")
    got = {r.low: (r.unassigned, r.high_confidence, r.limbo, r.ideas, r.rho) for r in O.adaptive_replay(df, pairs, ["i"]).collect()}
    assert got == {0.65: (2, 1, 1, 2, 50.0), 0.80: (3, 1, 0, 2, 75.0)}


def test_first_match_dedup(spark):
    rows = [("b", 1, "Idea", "short", [1.0, 0.0]), ("b", 2, "idea", "a longer text", [0.0, 1.0]), ("b", 3, "Else", "x", [0.0, 1.0]), ("b", 4, "New", "y", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "book string, i int, name string, brief string, embedding array<double>")
    assert sorted((r.name, r.merged) for r in O.first_match_dedup(df, "book", ["i"]).collect()) == [("New", 1), ("idea", 3)]


def old_rolling(said, ends, sims, limit, tokens, least, most, overlap, paragraphs):
    """Cuts, sentence by sentence."""
    n, out, start, last = len(said), [], 0, -1
    while start < n:
        used, cuts, cut, why = 0, [], n - 1, "document_end"
        for i in range(start, n):
            used += tokens[i]
            if i == n - 1:
                if used >= most and cuts:
                    cut, why = C._best_cut(cuts, paragraphs), "max_tokens_exceeded"
                break
            if i <= last or used < least:
                continue
            if used > most:
                cut, why = (C._best_cut(cuts, paragraphs) if cuts else i), "max_tokens_exceeded"
                break
            cuts.append((float(sims[i]), i, ends[i]))
            if sims[i] < limit * (1.10 if ends[i] and paragraphs else 1.0):
                cut, why = i, "semantic_drop"
                break
        out.append((start, cut, why))
        if cut >= n - 1:
            break
        last, start = cut, max(cut + 1 - overlap, start + 1)
    return out


def test_rolling_cuts_equal_a_loop():
    r = random.Random(6)
    for _ in range(120):
        text = "\n\n".join(" ".join("Word " + " ".join(r.choices("abc def ghi jkl".split(), k=r.randint(0, 12))) + r.choice(".!?") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 5)))
        least, most, overlap, paragraphs, fixed = r.randint(0, 20), r.randint(5, 50), r.randint(0, 3), r.random() < 0.5, r.choice([0.0, 0.2, 0.6])
        pairs = C.split_sentences(text)
        said, ends = [p[0] for p in pairs], [p[1] for p in pairs]
        sims = C.window_similarities(said, C.hashed_vector, 3)[1]
        want = old_rolling(said, ends, sims, fixed, [C.count_tokens(s) for s in said], least, most, overlap, paragraphs)
        assert [(c["start_sentence"], c["end_sentence"], c["split_reason"]) for c in C.rolling_chunks(text, C.hashed_vector, 3, least, most, fixed, overlap=overlap, paragraphs=paragraphs)] == want
    rows = C.sentence_similarities("One two. Three four. Five.", C.hashed_vector)
    assert [x["split_idx"] for x in rows] == [0, 1] and rows[0]["left_context"] == "One two." and C.sentence_similarities("One.", C.hashed_vector) == []


def test_chunk_similarity(spark):
    e = [1.0, 0.0]
    rows = [("b", 1, "Opt", "first", "passed", False, e), ("b", 2, "Opt", "again", "passed", False, e), ("b", 3, "Opt", "other", "passed", False, [0.0, 1.0]), ("b", 4, "Opt", "x" * 500, "passed", False, e), ("b", 5, "Opt", "formula", "passed", True, e), ("b", 6, "Opt", "none", "passed", False, None),
            ("b", 7, "Opt", "skipped", "biblio", False, e), ("b", 8, "Else", "anchor", "passed", False, e), ("b", 9, "else ", "again", "passed", False, e), ("b", 10, "Opt", "long", "passed", False, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(b, i, 1, s, t, c, "retain" if c == "passed" else "skip", f, v) for b, i, s, t, c, f, v in rows], "book string, i int, chapter_idx int, section_title string, text string, category string, decision string, has_formula boolean, embedding array<double>")
    got = {r.i: (r.category, r.similarity_to_cover) for r in O.chunk_similarity(df, "book", ["i"]).collect()}
    assert sorted(i for i, (c, _) in got.items() if c == "chunk_sim") == [2, 9] and got[1][1] is None and got[3][1] == 0.0 and got[4][1] == 1.0 and got[6][1] is None and got[10][1] == -1.0
    assert got[7] == ("biblio", None)
