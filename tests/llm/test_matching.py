import pytest

from wakegraph.llm import matching

SYMBOLS = "symbol_id long, patch_id long, fqn string, kind string, file_path string, start_line int, end_line int, key string, score int"
METHODS = "fqn string, start_line int, end_line int, recorded_at timestamp_ntz, key string"


def matched(spark, symbols, methods):
    s = spark.createDataFrame([(*x, "k", 1) for x in symbols], SYMBOLS)
    m = spark.createDataFrame([(f, a, b, None, "k") for f, a, b in methods], METHODS)
    return {r.symbol_id: (r.method_fqn, r.confidence) for r in matching.match_symbols(s, m).collect()}


@pytest.mark.parametrize("text, want", [
    ("a.b.C.m(java.util.Map<String, Long>, final int x, String[])", (["a", "b"], "C", "m", "all", ["Map", "int", "String[]"], 3)),
    ("a.C::m()", (["a"], "C", "m", "all", [], 0)), ("C#C(..)", ([], "C", "<init>", "none", [], -1)), ("a.C$D.<init>(2 args)", (["a", "C"], "D", "<init>", "count", [], 2)),
    ("a.C.m(int,java.util.Li…", (["a"], "C", "m", "first", ["int", "Li"], -1)), ("a.C.mak…", (["a"], "C", "mak", "name", [], -1)), ("m", ([], "", "m", "none", [], -1)), ("", ([], "", "", "none", [], -1)),
])
def test_names_are_taken_apart(text, want):
    assert matching.read_name(text) == want


def test_letters_apart():
    assert [matching.letters_apart(*x) for x in (("abc", "abc"), ("abc", "acb"), ("abc", "abcd"), ("abc", "xbc"), ("abc", "xyz"), ("a", "abcdef"))] == [0, 1, 1, 1, 3, 3]


METHOD_ROWS = [
    ("io.x.util.Tool.run(int,Map)", 10, 20), ("io.x.util.Tool.run(int)", 30, 40), ("io.x.util.Tool.walk(?)", None, None), ("io.x.util.Tool.<init>(String)", 5, 8), ("io.other.web.Tool.run(int,Map)", 10, 20),
    ("io.x.Outer.Inner.close()", 50, 60), ("io.x.util.Tool.run(int,Map)", 10, 20), (None, 1, 2),
]


def test_writings_of_one_method(spark):
    writings = {
        1: "io.x.util.Tool.run(int,Map)", 2: "io.x.util.Tool#run(int, java.util.Map<K, V>)", 3: "io.x.utils.Tool.rnu(final int a, Map b)", 4: "io.x.util.Tool.Tool(String)", 5: "io.x.Outer$Inner::close()", 6: "Outer.Inner.close",
        7: "io.x.util.Tool.run(1 args)", 8: "io.x.util.Tool.run(int,M…", 9: "io.x.util.Tool.run(..)", 10: "io.x.util.Tool.run(long)", 11: "io.x.util.Tool.walk(?)", 12: "io.x.util.Tool.jump()", 13: None, 14: "io.x.util.Shim.run(int)", 15: "", 16: "Tool.run(int,Map)",
    }
    lines = {9: (31, 40), 16: (10, 20)}
    symbols = [(i, i, f, "CONSTRUCTOR" if i == 4 else "METHOD", "src/io/x/util/Tool.java" if i == 16 else None, *lines.get(i, (None, None))) for i, f in writings.items()]
    symbols += [(99, 1, "io.x.util.Tool", "CLASS", None, 1, 2), symbols[0]]
    got = matched(spark, symbols, METHOD_ROWS)
    two, one, inner = "io.x.util.Tool.run(int,Map)", "io.x.util.Tool.run(int)", "io.x.Outer.Inner.close()"
    assert {i: m for i, (m, _) in got.items()} == {
        1: two, 2: two, 3: two, 4: "io.x.util.Tool.<init>(String)", 5: inner, 6: inner, 7: one, 8: two, 9: one, 10: None, 11: None, 12: None, 13: None, 14: None, 15: None, 16: two,
    }
    assert all(0.4 <= c <= 1.0 if m else c == 0.0 for m, c in got.values())


def test_nothing(spark):
    assert matched(spark, [], METHOD_ROWS) == {}
    assert matched(spark, [(1, 1, "a.B.c()", "METHOD", None, None, None)], []) == {1: (None, 0.0)}


def test_beliefs_against_enumeration(spark):
    """A chain of pairs has no loop, so the messages give its exact marginals (places take one symbol, others at odds)."""
    scores = {("s1", "p1"): 1.0, ("s1", "p2"): 0.5, ("s2", "p2"): 2.0}
    df = spark.createDataFrame([(s, p, x) for (s, p), x in scores.items()], "symbol string, place string, score double")
    got = {(r.symbol, r.place): r.belief for r in matching.propagate(df).collect()}
    import itertools
    import math

    total, mass = 0.0, dict.fromkeys(scores, 0.0)
    for chosen in itertools.product([0, 1], repeat=3):
        on = [k for k, c in zip(scores, chosen) if c]
        if len({s for s, _ in on}) == len(on) and len({p for _, p in on}) == len(on):
            w = math.prod(math.exp(scores[k]) for k in on)
            total += w
            for k in on:
                mass[k] += w
    assert all(abs(got[k] - mass[k] / total) < 1e-3 for k in scores)


def test_symbols_of_one_patch_may_name_a_method_twice(spark):
    symbols = [(1, 7, "io.x.util.Tool.run(int,Map)", "METHOD", None, 10, 20), (2, 7, "io.x.util.Tool.rum(int,Map)", "METHOD", None, 10, 20)]
    assert {m for m, _ in matched(spark, symbols, METHOD_ROWS).values()} == {"io.x.util.Tool.run(int,Map)"}
