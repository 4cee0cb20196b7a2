import subprocess

import pytest

from tests.harness import compare, connect
from wakegraph.operators.intervals import anchored_shift, reconciled
from wakegraph.plans.ingest import counts, ingest
from wakegraph.queries import all_queries, all_sql
from wakegraph.sources import config, files, patches
from wakegraph.sources.java_source import read_java

PATCH = """diff --git a/src/A.java b/src/A.java
--- a/src/A.java
+++ b/src/A.java
@@ -5,2 +5,5 @@ class A
 int context;
+added line one of the patch
+two
+three
 }
@@ -20,3 +23,2 @@
 x
-removed();
 y
diff --git a/old.txt b/new.txt
rename from old.txt
rename to new.txt
--- /dev/null
+++ b/B.java
@@ -0,0 +1,2 @@
+class B {
+}
--- a/gone/C.java
+++ /dev/null
@@ -1,4 +0,0 @@
-public class C {
-  C(final String a, Map<K, V> b) {
-  static int run(int[] x) throws E {
-  return new Foo(1);
"""


def test_patch_files_and_edit_ranges(spark):
    p = spark.createDataFrame([(1, PATCH), (2, None), (3, ""), (4, "no patch at all")], "patch_id long, text string")
    got = {r.ordinal: (r.old_path, r.new_path, r.change, list(zip(r.hunk_starts, r.hunk_ends))) for r in patches.file_changes(p).collect()}
    assert got == {
        0: ("src/A.java", "src/A.java", "MODIFY", [(6, 8), (24, 24)]), 1: ("old.txt", "new.txt", "RENAME", []), 2: (None, "B.java", "ADD", [(1, 2)]), 3: ("gone/C.java", None, "DELETE", []),
    }
    lines = [(r.path, r.line_no, r.added) for r in patches.hunk_lines(p).where("path = 'src/A.java' and hunk = 0").orderBy("line_no").collect()]
    assert lines == [("src/A.java", 5, False), ("src/A.java", 6, True), ("src/A.java", 7, True), ("src/A.java", 8, True), ("src/A.java", 9, False)]
    assert [(r.line_no, r.text) for r in patches.removed_lines(p).where("path = 'src/A.java'").collect()] == [(21, "removed();")]


def damaged(spark, path, *texts):
    """Writes texts as the documents of kind patch, numbered from 1."""
    rows = [(n, "patch", text) for n, text in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, doc_kind string, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


ZEROS = "0" * 14


def git(old="78", new="90", news="2"):
    return f"diff --git a/x/A.java b/x/A.java\n--- a/x/A.java\n+++ b/x/A.java\n@@ -{old},3 +{new},4 @@ f(\n+one\n same\n-two\n+three\n@@ -1,2 +1,{news} @@\n-a\n+b\n c\n"


DAMAGED = [
    "", "no patch", git(old="78" + ZEROS), git(old="78" + "0" * 5000), git(old="7\u0660\u06618"), git(new=ZEROS + "90"), git() + "\n--- a/x/Z.java\n+++ b/x/B.java\n@@ -5 +5 @@\n+z\n-y\n", "-cut off\n@@ -1 +1,2 @@\n+--- a/y\n-b\n" + git(),
    git().replace("+++ ", "++").replace("--- a", "---\u2009 a"), "diff --git a/x/A", "diff  --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n", git().replace("--- a/x/A.java", "--- \u3000b/q\tr"),
    "diff --git a/o b/n\nnew file mode 1\nrename from o\nrename to n\n\\\n@@ -1 +1,0 @@\n-a\n\\ no newline\n+b\n", git().replace("+++ b/x/A.java", "+++ /dev/null"), git().replace("--- a/x/A.java", "--- /dev/null"),
]


def test_files_of_damaged_patches_agree_with_sql(spark, tmp_path):
    base = damaged(spark, tmp_path, *DAMAGED)
    ok, what = compare(spark, connect(base), "patch_files", all_queries()["patch_files"], all_sql()["patch_files"], base)
    assert ok, what


def test_files_of_patches_whose_lines_are_no_int(spark, tmp_path):
    base = damaged(spark, tmp_path, git("78" + ZEROS, "90" + ZEROS), git(new="90" + "0" * 5000), git(new="90" + ZEROS).replace("+1,2", f"+1{ZEROS},2"))
    got = {r.patch_id: (r.new_path, r.n_edits, r.first_line, r.last_line) for r in all_queries()["patch_files"](spark, base).collect()}
    assert got == {1: ("x/A.java", 3, 1, None), 2: ("x/A.java", 3, 1, None), 3: ("x/A.java", 3, None, None)}


def test_lines_of_damaged_patches_agree_with_sql(spark, tmp_path):
    base = damaged(spark, tmp_path, *DAMAGED, git("78" + ZEROS, "90" + ZEROS), git(new="90" + "0" * 5000))
    ok, what = compare(spark, connect(base), "patch_lines", all_queries()["patch_lines"], all_sql()["patch_lines"], base)
    assert ok, what


def test_lines_of_hunks_longer_than_an_int(spark, tmp_path):
    base = damaged(spark, tmp_path, git(news="2" + ZEROS), git(news="2" + "0" * 5000))
    assert {tuple(r) for r in all_queries()["patch_lines"](spark, base).collect()} == {(1, 3, 2), (2, 3, 2)}


def test_deleted_declarations(spark):
    p = spark.createDataFrame([(1, PATCH)], "patch_id long, text string")
    got = {(r.kind, r.name, r.params, r.line_no) for r in patches.deleted_declarations(p).collect()}
    assert got == {("CLASS", "C", None, 1), ("CONSTRUCTOR", "C", "String,Map", 2), ("METHOD", "run", "int[]", 3)}


def test_deleted_declarations_are_qualified(spark):
    text = """--- a/x/Top.java
+++ b/x/Top.java
@@ -1,7 +1,3 @@
 package a.b;
-public class Top {
-  Top(int x) { super(x); }
-  int one() { return 1; }
-  static class Inner {
-    Inner() {}
 }
"""
    p = spark.createDataFrame([(1, text), (2, text.replace(" package a.b;", " "))], "patch_id long, text string")
    got = {(r.patch_id, r.kind, r.fqn, r.line_no) for r in patches.deleted_declarations(p).collect()}
    own = {("CLASS", "Top", 2), ("CONSTRUCTOR", "Top.<init>(int)", 3), ("METHOD", "Top.one()", 4), ("CLASS", "Inner", 5)}
    assert got == {(1, k, "a.b." + f, n) for k, f, n in own} | {(2, k, f, n) for k, f, n in own}


def test_hunks_are_moved_and_cut_to_the_file(spark):
    source = ["."] * 7 + ["context above", "", "first added line of the hunk", "}", "  context below "]
    s = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(source)], "file_path string, line_no int, text string")
    rows = [("h", "f", 5 + i, t, a) for i, (t, a) in enumerate([("context above", False), ("", False), ("first added line of the hunk", True), ("}", True), ("context below", False)])]
    h = spark.createDataFrame(rows, "hunk_id string, path string, line_no int, text string, added boolean")
    edits = spark.createDataFrame([("exact", "f", 5, 9), ("inside", "f", 7, 30), ("none", "f", 40, 41), ("other", "g", 5, 6)], "edit_id string, file_path string, h_start int, h_end int")
    got = {r.edit_id: (r.new_start, r.new_end) for r in reconciled(edits, patches.hunk_contents(h), patches.anchors(h), s).collect()}
    assert got == {"exact": (8, 12), "inside": (10, 12), "none": (40, 41), "other": (5, 6)}


def shift(spark, start, source):
    lines = [("h", "f", start + i, t, a) for i, (t, a) in enumerate([("context above", False), ("first added line of the hunk", True), ("x", True), ("y", True), ("context below", False)])]
    h = spark.createDataFrame(lines, "hunk_id string, path string, line_no int, text string, added boolean")
    s = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(source)], "file_path string, line_no int, text string")
    return [r.shift for r in anchored_shift(s, patches.anchors(h)).collect()]


def test_hunks_find_their_lines(spark):
    block = ["context above", "first added line of the hunk", "x", "y", "  context below "]
    assert shift(spark, 5, ["."] * 7 + block + ["."]) == [3]
    assert shift(spark, 1, block) == [0]
    assert shift(spark, 9, ["context below"] + ["."] * 20 + ["context below"]) == [-12]  # line 1 is nearer to where the hunk begins than line 22
    assert shift(spark, 5, ["nothing"]) == []


JAVA = '''package a.b;
import a.c.Helper;
import a.d.*;
/** Helper.nope() */
public class Main extends Base implements Runnable {
  private final Helper helper = new Helper();
  static final long LIMIT = 50L;
  public Main(int x) { super(); this.init(x); }
  @Override public void run() { helper.go("a,b", 1); Other o = new Other(); o.act(); Util.of(); List<String> s = null; s.add(LIMIT); }
  void init(int x) { new Thread(this).start(); Worker w = make(); w.start(); Class.forName("a.d.Other"); "s".length(); int y = (x < 3) ? twice(x) : 0; }
  int twice(int v) { return v; } int twice(long v) { return 0; }
  Worker make() { return null; }
  enum Kind { ONE, TWO(2) { }; Kind() { } }
  static class Inner { void deep() { Main.this.twice(1); } }
}
'''
REST = {
    "Base.java": "package a.b; public class Base { protected Base() { } void shared(String s) { } }",
    "Helper.java": "package a.c; public class Helper { public void go(String s, int n) { } public Helper() { } }",
    "Other.java": "package a.d; public class Other extends a.b.Base { public Other() { } void act() { shared(null); } }",
    "Util.java": "package a.d; class Util { static Util of() { return null; } }",
    "Worker.java": "package a.b; class Worker { public void run() { } }",
    "Broken.java": "class X { void f( { }",
}


def test_reading_java():
    pkg, rows = read_java(JAVA)
    assert pkg == "a.b"
    names = {(r["kind"], r["name"]) for r in rows if r["kind"] not in ("call", "import")}
    assert {("class", "a.b.Main"), ("enum", "a.b.Main.Kind"), ("class", "a.b.Main.Inner"), ("constructor", "a.b.Main.<init>(int)"), ("method", "a.b.Main.twice(long)"), ("field", "a.b.Main.LIMIT"), ("method", "a.b.Main.Inner.deep()")} <= names
    calls = {(r["name"], r["scope_kind"], r["scope"], r["arity"]) for r in rows if r["kind"] == "call"}
    assert {("go", "variable", "Helper", 2), ("act", "variable", "Other", 0), ("of", "type", "Util", 0), ("<init>", "super", None, 0), ("init", "this", None, 1), ("twice", "none", None, 1), ("start", "variable", "Worker", 0), ("length", "type", "String", 0)} <= calls
    assert not any(r["name"] == "nope" for r in rows)
    with pytest.raises(ValueError):
        read_java(REST["Broken.java"])
    assert read_java("") == ("", [])


def test_ingest_resolves_calls(spark):
    rows = [("r", "src/Main.java", JAVA), ("r", "src/Main.java", JAVA), ("r", "x.md", "text"), ("r", "N.java", None)] + [("r", "src/" + k, v) for k, v in REST.items()]
    t = ingest(spark.createDataFrame(rows, "repo_id string, path string, content string"))
    calls = {(r.src.rpartition("Main.")[2], r.dst, r.kind) for r in t["calls"].collect()}
    assert ("run()", "a.c.Helper.go(String,int)", "virtual") in calls
    assert ("run()", "a.d.Other.act()", "virtual") in calls
    assert ("run()", "a.d.Util.of()", "static") in calls
    assert ("run()", "a.d.Other.<init>()", "constructor") in calls
    assert ("<init>(int)", "a.b.Base.<init>()", "constructor") in calls
    assert {c for c in calls if c[0] == "init(int)" and "twice" in c[1]} == {("init(int)", "a.b.Main.twice(int)", "ambiguous-of-2"), ("init(int)", "a.b.Main.twice(long)", "ambiguous-of-2")}
    assert ("a.d.Other.act()", "a.b.Base.shared(String)", "virtual") in calls
    assert {(r.src, r.dst) for r in t["starts_thread"].collect()} == {("a.b.Main.init(int)", "a.b.Worker.run()")}
    assert {(r.src, r.dst) for r in t["reflects"].collect()} == {("a.b.Main.init(int)", "a.d.Other.<init>()")}
    assert {(r.child, r.parent) for r in t["extends"].collect()} == {("a.b.Main", "a.b.Base"), ("a.d.Other", "a.b.Base")}
    assert {r.what: r.n for r in counts(t).collect()}["corrupt"] == 1


def test_fields_of_ancestors_give_receivers_and_accesses(spark):
    texts = {
        "Top.java": "package p; import q.Tool; public class Top { protected Tool tool; static final int MAX = 3; int own; }",
        "Mid.java": "package p; class Mid extends Top { Other tool2; }",
        "Low.java": "package r; import p.*; class Low extends p.Mid { int n; void f(Low o) { tool.cut(1); tool2.go(); this.n = Top.MAX; o.own = missing.x; super.own = 1; tool.size = 2; } }",
        "Tool.java": "package q; public class Tool { int size; public void cut(int n) { } }", "Other.java": "package p; class Other { void go() { } }",
    }
    t = ingest(spark.createDataFrame([("r", k, v) for k, v in texts.items()], "repo_id string, path string, content string"))
    assert {(r.src, r.dst) for r in t["calls"].collect()} == {("r.Low.f(Low)", "q.Tool.cut(int)"), ("r.Low.f(Low)", "p.Other.go()")}
    assert {r.dst for r in t["accesses"].collect()} == {"r.Low.n", "p.Top.MAX", "p.Top.own", "q.Tool.size"}


def test_source_tree(spark, tmp_path):
    (tmp_path / "repo" / "src").mkdir(parents=True)
    (tmp_path / "repo" / "build").mkdir()
    (tmp_path / "repo" / "src" / "A.java").write_text("class A {}")
    (tmp_path / "repo" / "build" / "B.java").write_text("class B {}")
    (tmp_path / "repo" / "src" / "c.txt").write_text("no")
    got = files.source_files(spark, str(tmp_path))
    row = got.collect()
    assert [(r.path, r.repo_id, r.content, r.n_bytes) for r in row] == [("src/A.java", "repo", "class A {}", 10)]
    assert files.unseen(got, got).count() == 0 and files.unseen(got, got.limit(0)).count() == 1
    changes = spark.createDataFrame([("src/A.java",), ("gone.xml",)], "new_path string")
    assert {(r.new_path, r.content) for r in files.blobs(changes, got).collect()} == {("src/A.java", "class A {}"), ("gone.xml", None)}
    java, other = files.routed(changes)
    assert java.count() == 1 and [r.language for r in other.collect()] == ["xml"]


def test_git_patch(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    git("add", "-A")
    git("commit", "-qm", "1")
    (tmp_path / "a.txt").write_text("one\n2\n")
    git("commit", "-qam", "2")
    (change,) = patches.parse_patch(files.git_patch(str(tmp_path), "HEAD~1", "HEAD"))
    assert (change.new_path, change.change, change.edits()) == ("a.txt", "MODIFY", [(2, 2)])
    with pytest.raises(ValueError):
        files.git_patch(str(tmp_path), "--output=x", "HEAD")


def test_properties_and_paths():
    assert files.properties("a = 1\n# c\n\nbad\nb=x=y\na=2") == {"a": "2", "b": "x=y"}
    assert [files.resolved_path(p, "/r/") for p in ("C:\\x", "/y", "z\\w")] == ["C:/x", "/y", "/r/z/w"]


XML = """<rules><url path="/a" apimethod="GET"/><url apimethod='x'/><URL PATH='/b'/>
<action path="/act" type="p.Act" parameter="m"/><action path="/two" type="p.Two"/>
<ApiMapping API_URL="x/y" SERVLET_CLASS_NAME="p.S" MTCALL_VALUE="v"/><Api URL_PATH="/u" CLASS_NAME="p.C" METHOD_NAME="go"/><Api URL_PATH="/v" CLASS_NAME="p.C"/>
<TaskEngine_Task TASK_NAME="t" class_name="p.Old"/><BackgroundTaskDetails task_name="t" CLASS_NAME="p.New"/>
<forward url="/f" to="/u"/><Row handler="p.q.Good" other="p.q.bad" HANDLER2="x.Y"/></rules>"""


def test_xml_configuration(spark):
    x = spark.createDataFrame([("f.xml", XML), ("g.xml", None)], "path string, content string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(config.secured_urls(x)) == [("/a", "GET"), ("/b", None)]
    acts = config.actions(x)
    assert rows(acts) == [("/act.do", "p.Act", "m"), ("/two.do", "p.Two", None)]
    methods = spark.createDataFrame([("p.Act", "save"), ("p.Act", "load")], "owner string, simple string")
    assert rows(config.action_methods(acts, methods)) == [("/act.do?m=load", "p.Act.load"), ("/act.do?m=save", "p.Act.save"), ("/two.do", "p.Two")]
    assert rows(config.api_mappings(x, "ApiMapping")) == [("/x/y", "p.S", "v")]
    apis = config.servlet_apis(x, "Api")
    assert rows(apis) == [("/u", "p.C", "go")]
    assert rows(config.forwards(x, apis)) == [("/u", "/f", "p.C")]
    assert rows(config.task_classes(x)) == [("t", "p.New")]
    seeds = config.seed_classes(x)
    assert ("row", "HANDLER", "p.q.Good") in rows(seeds) and all(r[2] != "p.q.bad" for r in rows(seeds))
    wanted = spark.createDataFrame([("ROW",), ("none",)], "table string")
    assert [(r.table, r.column, r.n, r.classes) for r in config.table_candidates(wanted, seeds, ["MISSING", "HANDLER2", "HANDLER"]).collect()] == [("row", "HANDLER2", 1, ["x.Y"])]
    assert [(r.n, r.classes) for r in config.table_candidates(wanted, seeds, ["HANDLER"], cap=0).collect()] == [(1, None)]


def test_xml_files(spark, tmp_path):
    (tmp_path / "web.xml").write_text(
        "<web-app><servlet><servlet-name> S </servlet-name><servlet-class>p.S</servlet-class></servlet><servlet-mapping><servlet-name>S</servlet-name><url-pattern>/s</url-pattern><url-pattern>/x/*</url-pattern></servlet-mapping></web-app>"
    )
    assert [tuple(r) for r in config.servlets(spark, str(tmp_path / "web.xml")).collect()] == [("S", "p.S", "/s")]
    (tmp_path / "dd.xml").write_text(
        "<dd><table name='T'><columns><column name='ID'><data-type>BIGINT</data-type><nullable>false</nullable></column><column name='NOTE'><data-type>CHAR</data-type><max-size>50</max-size></column></columns>"
        "<uniquevalue-generation><uniquevalue-column>id</uniquevalue-column></uniquevalue-generation></table></dd>"
    )
    got = {tuple(r) for r in config.data_dictionary(spark, str(tmp_path / "dd.xml")).collect()}
    assert got == {("T", "ID", "BIGINT", None, False, True), ("T", "NOTE", "CHAR", 50, True, False)}


def test_test_descriptions(spark, tmp_path):
    md = "| ID | T | S | E | X |\n|-|-|-|-|-|\n| (LBF-LOGIN-01) | opens | click | page | y |\n| bad | a | b | c | d |\nLBF-X-2 | no\n"
    got = [tuple(r) for r in config.markdown_cases(spark.createDataFrame([("t.md", md), ("n.md", None)], "path string, content string")).collect()]
    assert got == [("LBF-LOGIN-01", "opens", "LOGIN", "click", "page", "t.md")]
    assert config.sheet_cases([["x"], ["Test ID", "Title", "Expected Result"], ["1", "a", "ok"], ["", "b", "c"]], "s") == [{"test_id": "1", "title": "a", "area": "", "steps": "", "expected": "ok", "source": "s"}]
    assert config.sheet_cases([["a", "b"]], "s") == []
    (tmp_path / "c.csv").write_text('Test ID,Title,Steps\n1,"a, b",x\n,none,y\n')
    assert [(r.test_id, r.title, r.steps, r.area) for r in config.csv_cases(spark, str(tmp_path / "c.csv")).collect()] == [("1", "a, b", "x", "")]


def test_workbooks(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, t, v: f'<c r="{r}" t="{t}">' + (f"<is><t>{v}</t></is>" if t == "inlineStr" else f"<v>{v}</v>") + "</c>"
    rows = [
        cell("A1", "inlineStr", "Cases of the release"), cell("B3", "s", 0) + cell("C3", "s", 1) + cell("E3", "inlineStr", "Steps"),
        cell("B4", "s", 2) + cell("C4", "inlineStr", "opens &lt;page&gt;") + cell("E4", "n", 12), cell("C5", "s", 1), cell("B6", "s", 3) + '<c r="C6"/>',
    ]
    with zipfile.ZipFile(tmp_path / "cases.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Test ID</t></si><si><r><t>Ti</t></r><r><t>tle</t></r></si><si><t>T-1</t></si><si><t>T-2</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet10.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    got = {tuple(r) for r in config.workbook_cases(spark, str(tmp_path)).collect()}
    assert got == {("T-1", "opens <page>", "", "12", "", "cases.xlsx"), ("T-2", "", "", "", "", "cases.xlsx")}


def test_rules_and_registry(spark):
    assert config.parse_rules("T1:\n  add:\n    - METHOD: a.B.c\n  remove:\n    - URL: /x # why\n\n# c\n") == [(0, "T1", "add", "METHOD", "a.B.c"), (1, "T1", "remove", "URL", "/x")]
    for bad in ("T1\n", "T1:\n  change:\n", "T1:\n  add:\n    METHOD: x\n", "T1:\n   add:\n", "T1:\n  add:\n    - METHOD:\n"):
        with pytest.raises(config.RuleFault, match="line"):
            config.parse_rules(bad)
    reg = spark.createDataFrame(config.macro_registry('{"p.M": [{"key": "k2", "placeholder": "%b", "column": "NAME"}, {"key": "k1", "column": "name"}], "p.N": [{"key": "z", "column": "ID"}]}'), "macro_class string, macro_key string, placeholder string, db_column string")
    assert [tuple(r) for r in config.keys_of_columns(reg, spark.createDataFrame([("Name",)], "db_column string")).collect()] == [("p.M", "k1,k2")]


SCRIPT = """define('m', function (a) {
  function outer(b, cb) { // {
    const re = /[{}'"]+\\/x/g.test(b), t = `a ${b} }`;
    return { inner: function () { return 1; }, short(c) { } };
  }
  const arrow = async (x) => {
    if (x) { go(x); }
  };
});
"""


def test_script_functions(spark):
    from wakegraph.plans.polyglot import js_functions, script_functions

    assert js_functions(SCRIPT) == [("outer", "", 2, 5), ("inner", "outer", 4, 4), ("short", "outer", 4, 4), ("arrow", "", 6, 8)]
    assert js_functions("function f( {") == [] and js_functions("") == []
    df = spark.createDataFrame([("a.js", SCRIPT), ("b.js", None), ("c.js", "")], "file string, content string")
    assert script_functions(df).count() == 4


def test_xml_impact(spark):
    from wakegraph.plans.polyglot import file_lines, xml_columns, xml_impact

    text = "<d>\n<column name='lost'/>\n<table name='T'>\n<column name='a' type='CHAR'/>\n<column name='b'/>\n</table>\n<column name='out'/>\n</d>"
    cols = xml_columns(file_lines(spark.createDataFrame([("f", text), ("g", None)], "file string, content string")))
    assert sorted((r.line_no, r.table, r.column, r.data_type) for r in cols.collect()) == [(2, None, "lost", ""), (4, "T", "a", "CHAR"), (5, "T", "b", ""), (7, None, "out", "")]
    hunks = spark.createDataFrame([("f", 4, 5), ("h", 1, 9)], "file string, h_start int, h_end int")
    assert sorted(tuple(r) for r in xml_impact(cols, hunks).collect()) == [("f", "T", 2, "MEDIUM"), ("h", "", 0, "LOW")]
