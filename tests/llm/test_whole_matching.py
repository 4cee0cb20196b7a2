from datetime import datetime

from tests.llm.test_matching import METHOD_ROWS, METHODS, SYMBOLS, matched
from wakegraph.llm import matching


def test_rows_of_other_lines_or_files_are_no_rivals(spark):
    inner = "io.x.Outer.Inner.close()"
    symbols = [
        (1, 7, inner, "METHOD", None, 50, 60), (2, 7, "io.x.Outer.Inner.clsoe(..)", "METHOD", None, 300, 305),
        (3, 8, inner, "METHOD", "a/Outer.java", None, None), (4, 8, "io.x.Outer.Inner.clsoe(..)", "METHOD", "b/Outer.java", None, None),
    ]
    assert {i: m for i, (m, _) in matched(spark, symbols, METHOD_ROWS).items()} == dict.fromkeys([1, 2, 3, 4], inner)


def test_all_lines_of_a_method_are_evidence(spark):
    rows = [("io.x.Shop.sell(int)", a, a + 9, datetime(2024, 1, d), "k") for d, a in ((1, 10), (2, 500), (3, 900))] + [("io.x.Shop.sell(long)", 100, 130, datetime(2024, 1, 1), "k")]
    s = spark.createDataFrame([(1, 1, "Shop.sell(..)", "METHOD", None, 500, 509, "k", 1)], SYMBOLS)
    scores = {r.method_fqn: r.score for r in matching.candidates(s, spark.createDataFrame(rows, METHODS)).collect()}
    assert scores["io.x.Shop.sell(int)"] - scores["io.x.Shop.sell(long)"] == 5.0
    none = matching.candidates(s, spark.createDataFrame([("io.x.Shop.sell(int)", None, None, None, "k")], METHODS)).first()
    assert none.score == scores["io.x.Shop.sell(int)"] - 4.0


def test_names_cut_off_early_have_candidates(spark):
    s = spark.createDataFrame([(i, i, f, "METHOD", None, None, None, "k", 1) for i, f in enumerate(("io.x.Shop.s…", "io.x.Shop.se...", "io.x.Shop.sel…", "io.x.Shop.sell…", "io.x.Shop.selle…", "io.x.Shop._…", "io.x.Shop.b…"))], SYMBOLS)
    got = {(r.symbol_id, r.method_fqn) for r in matching.candidates(s, spark.createDataFrame([("io.x.Shop.sellAll(int)", 1, 2, None, "k"), ("io.x.Shop.go()", 1, 2, None, "k")], METHODS)).collect()}
    assert got == {(i, "io.x.Shop.sellAll(int)") for i in (0, 1, 2, 3, 4, 5)} | {(5, "io.x.Shop.go()")}  # 4 with a letter replaced


def test_misspelt_names_cut_off_have_candidates(spark):
    cut = ("io.x.Shop.porc…", "io.x.Shop.rpocess…", "io.x.Shop.pocessR…", "io.x.Shop.prrocess…", "io.x.Shop.xyz…", "io.x.Shop.px…")
    s = spark.createDataFrame([(i, i, f, "METHOD", None, None, None, "k", 1) for i, f in enumerate(cut)], SYMBOLS)
    m = spark.createDataFrame([("io.x.Shop.processRequest(int)", 1, 2, None, "k"), ("io.x.Shop.go()", 1, 2, None, "k")], METHODS)
    assert {(r.symbol_id, r.method_fqn) for r in matching.candidates(s, m).collect()} == {(i, "io.x.Shop.processRequest(int)") for i in range(4)}


def test_swinging_messages_come_to_rest(spark):
    """Many rivals of one strength on one place: the messages swing, and end without a bound on the rounds."""
    pairs = [(f"s{i}", f"p{i % 3}", 6.0) for i in range(12)] + [(f"s{i}", f"p{(i + 1) % 3}", 6.0) for i in range(12)]
    got = matching.propagate(spark.createDataFrame(pairs, "symbol string, place string, score double")).collect()
    assert len(got) == 24 and all(0 <= r.belief <= 1 for r in got)
