import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import cascade


def values(spark, column, rows, kind="v string"):
    return [r.x for r in spark.createDataFrame(rows, kind).select(column.alias("x")).collect()]


@pytest.mark.parametrize(
    "make,cases",
    [
        (T.idea_month, {"2024-05-18": "2024-05", "2015": "2015-01", "0101-01-01": None, "": None, None: None}),
        (T.sort_date, {"2020-08": "2020-08-01", "2011": "2011-01-01", None: "9999-12-31", "2020-08-09": "2020-08-09"}),
        (T.publication_date, {"2020-13": "2020", "20-13": None, "D:20210304Z": "2021-03-04", "arXiv:2401.12345v2": "2024-01", "in 1999, at sea": "1999", "0101-01-01T00": None, "9912.1234": "1999-12"}),
        (T.query_month, {"05/2024": "2024-05", "May, 2024": "2024-05", "2024 sept": "2024-09", "2024": "2024-01", "2024/5": "2024-05", "x": None}),
        (T.normalize_name, {"The Event Sourcing": "event sourcing", "An LSM-Tree...": "lsm-tree", "Event Sourcing (ES)": "event sourcing es"}),
        (T.canonical_name, {"The Event": "Event", "the ": "the", "Zed": "Zed"}),
        (T.latex, {"$$ a  = b. $$": "a = b", "\\[x\\]": "x", "$y,$": "y"}),
        (T.token_count, {"Hi, you 2!": 5, "": 0}),
        (T.graph_label, {"a b-c": "a_b_c", "__": "Node"}),
        (T.clean_whitespace, {" a \t b\n\n\n\nc ": "a b\n\nc"}),
    ],
)
def test_scalars(spark, make, cases):
    assert values(spark, make(F.col("v")), [(k,) for k in cases]) == list(cases.values())


def test_upper_bound_and_range(spark):
    assert values(spark, T.query_month(F.col("v"), True), [("2024",)]) == ["2024-12"]
    r = T.month_in_range(F.col("v"), F.lit("2020-01"), F.lit("2020-06"))
    assert values(spark, r, [("2020-01",), ("2020-07",), (None,)]) == [True, False, False]


def test_formula_sides(spark):
    got = values(spark, T.formula_sides(F.col("v")), [("$a \\le b = c$",), ("nothing",)])
    assert [(x.lhs, x.rhs) for x in got] == [("a \\le b", "c"), ("", "")]


def test_grounding(spark):
    rows = [("The cat sat on the mat today", "Feline", "", "cat  SAT on"), ("The cat sat", "Cat", "", "dogs bark loudly"), ("The cat sat", "Dog", "", "dogs bark loudly"), ("A long story of waves", "Sea", "story about waves", ""), ("", "x", "", "y")]
    df = spark.createDataFrame(rows, "c string, n string, b string, q string")
    got = [tuple(r.x) for r in df.select(T.grounding(F.col("c"), F.col("n"), F.col("b"), F.col("q")).alias("x")).collect()]
    assert got == [(True, "cat  SAT on"), (True, ""), (False, ""), (True, ""), (False, "")]


def test_same_concept(spark):
    rows = [("Failure Attribution", "Attribution of Failure", 0.5), ("Attack Vector", "Attack Vectors", 0.5), ("Attack plan", "Defense plan", 0.95), ("Markov Decision Process", "Reinforcement Agent", 0.81), ("Graph model one two", "Graph model one two three", 0.95), ("alpha beta", "alpha gamma", 0.9)]
    df = spark.createDataFrame(rows, "a string, b string, s double")
    assert [r.x for r in df.select(T.same_concept(F.col("a"), F.col("b"), F.col("s")).alias("x")).collect()] == [True, True, False, False, True, None]


def test_exact_score(spark):
    rows = [("Event Log", "", "", ""), ("event log store", "", "", ""), ("the event log", "", "", ""), ("x", "event log", "", ""), ("x", "", "an event log", ""), ("x", "", "", "event log"), ("log of", "", "event", ""), ("x", "", "", "")]
    df = spark.createDataFrame(rows, "n string, c string, s string, d string")
    got = [r.x and r.x.match_score for r in df.select(T.exact_score("event log", *(F.col(c) for c in "ncsd")).alias("x")).collect()]
    assert got == [100.0, 85.0, 75.0, 60.0, 50.0, 40.0, 57.5, None]


def test_query_terms(spark):
    got = values(spark, T.query_terms(F.col("v")), [('What is the "write ahead log" model?',)])[0]
    assert got[0] == "write ahead log" and "ahead log" in got and "model" not in got and "is" not in got


CASES = {
    "": "empty", " \n ": "empty", "References\n[1] A": "ref_sections", "[1] a\n[2] b\n[3] c\n[4] d\n[5] e": "biblio", "See arXiv:2101.00001 by Smith": "biblio",
    "#include <a.h>\n#include <b.h>\n#define X": "tech_boiler", "Licensed under the MIT License": "tech_boiler", "a @-@ b": "dataset_stim", "Why? Who? How? When?": "dataset_stim",
    "✓ ✓ × × ok": "diag_ocr", "Figure 3: The tower": "captions_signposts", "All proofs are provided in Appendix B": "captions_signposts",
    "Figure 3: This shows the tower": "passed", "We show that [1] holds and go on with plain prose.": "passed", "where $x_i = y$ holds": "formulas", "it cost $5 million": "passed",
}


def test_cascade(spark):
    df = spark.createDataFrame([(k,) for k in CASES] + [(None,)], "text string")
    got = {r.text: (r.category, r.decision) for r in cascade.classify(df).collect()}
    assert {k: v[0] for k, v in got.items()} == CASES | {None: "empty"}
    assert all(d == ("retain" if c in ("passed", "formulas") else "skip") for c, d in got.values())
    assert {r.category: r.chunks for r in cascade.stats(cascade.classify(df)).collect()}["empty"] == 3


def test_cascade_similarity_step(spark):
    df = spark.createDataFrame([("plain words here", 0.9), ("plain words here", 0.8), ("plain words here", 0.1), ("w " * 600, 0.8)], "text string, s double")
    assert [r.category for r in cascade.classify(df, sim=F.col("s")).collect()] == ["limbo", "limbo", "passed", "passed"]


def _against_rules_sql(spark, odd, formulas):
    """The cascade's categories and those of its SQL, by line."""
    import duckdb

    from textloom.operators import cascade
    from textloom.plans import text_queries as Q

    rows = list(enumerate(odd))
    con = duckdb.connect()
    con.execute("CREATE TABLE given (id INT, text VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?, ?)", rows)
    want = dict(con.execute(Q._rules_sql("WITH source AS (SELECT id, text, '' AS section FROM given)", formulas) + "SELECT id, category FROM classified").fetchall())
    got = {r.id: r.category for r in cascade.classify(spark.createDataFrame(rows, "id int, text string"), formulas=formulas).collect()}
    return [(text, got[i], want[i]) for i, text in rows if got[i] != want[i]], set(got.values())


def test_rules_find_what_their_sql_finds(spark):
    odd = [
        "ANEN!! ÉOUPA,!! ÈÊTRE,!! ÇLE,!! UN,!! DU", "ÉSmith, ÉJones, ÉBrown, ÉGreen, ÉWhite", "Éall rights reserved", "MIT Licen\u017fe", "Ma\u017fter All right\u017f re\u017ferved", "IEEE Tran\u017factions on ACM, Smith, Jones, 1999", "see pp. 12-13 in 1999é Smith, Jones,", "1999\u0085[1] x\u2028[2] y doi:10.1234/ab",
        "MIT\x0bLicense", "ZooKeeper \u212ann", "Figure 3: a plot that showsé much", "Figure 3: a plot that \u017fhows much", "Référence", "References\u0085", "Tab\u212a. 3", "\u2713 \u2717 \u2713\x0b\u2717 done", "Funding\u00e9 was", "we propo\u017fe: really? what? why? when?", "écorrespondence to: x", "Correspondence to:é x",
        "a\nb\nc\nd\ne\nf\ng\nh\u0085| - | - |", "a\nb\nc\nd\ne\nf\ng\néclass z", "(a) Fir\u017ft \u2028 (b) Second", "\u0085 References \u0085",
    ]
    wrong, kinds = _against_rules_sql(spark, odd, False)
    assert wrong == []
    assert {"biblio", "tech_boiler", "passed"} <= kinds


def test_formulas_are_found_as_their_sql_finds_them(spark):
    odd = ["soit éa_1 ici", "soit xé_1 ici", "5\u00b5 de large", "\u2126 et", "\u03d1 et", "éHessian", "Lip\u017fchitz", "le spectral\x0bbound", "log\u2028(x)", "élog (x)", "Theorem 3. tient", "ÉTheorem 3. tient", "log \x0b(x)", "$5\x0bmillion", "il coûte $5 millioné $6", "x^2é", "écoloneqq", "http\u017f://a_1=b c", "UN, ÉX, DU, LA, ÉY, DE, LES,", "\u00b5 [1] [2] [3] [4] [5]"]
    wrong, kinds = _against_rules_sql(spark, odd, True)
    assert wrong == []
    assert {"formulas", "passed", "biblio"} <= kinds
