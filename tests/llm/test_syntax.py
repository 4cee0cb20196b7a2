import pytest

from wakegraph.llm.parsing import judge_files, parse_rates
from wakegraph.llm.syntax import parses

JAVA = """package a.b;
import java.util.*;
import static a.B.*;
@Ann(value = {1, 2}, x = @In("y")) public sealed abstract class A<T extends Comparable<? super T> & B> extends C<List<Map<String, int[]>>> implements D, E permits F {
  static { x = 1; } { y(); }
  private final int a = 0x1F, b[] = {1, 2,}, c = 1_000;
  long l = 0b11L + 017 + 1e-3f > 2 ? 'c' : '\\u0041';
  String t = \"\"\"
     text "block" { \"\"\";
  public <R> A(int x, final String... y) throws X, Y { this.<R>go(x); super(); }
  abstract int f() ;
  default <T> List<? extends T>[] g(A this, int a[]) { return null; }
  enum Z implements I { P(1) { void q() {} }, Q, ; int w; }
  record R<T>(int a, @N String b) implements I { R { if (a < 0) throw new E(); } static int z = 1; }
  @interface N { int v() default 1; String[] w() default {}; }
  void m() {
    int i = 0, j; final var k = new int[3][]; List<String> s = new ArrayList<>() { };
    for (int q = 0; q < 3 && a < b; q++, r--) { continue; } for (String u : us) ; for (;;) break;
    l1: while (i >>> 2 >= 3 >> 1) { i >>>= 1; i >>= 2; break l1; } do x(); while (y);
    try (var r = open(); r2) { } catch (final E | F e) { } finally { }
    switch (i) { case 1: case 2: f(); break; default: }
    int v = switch (i) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new X(); };
    Runnable run = () -> { }; F f = x -> x + 1; G h = (a, b) -> (int) a + (long) -b; H hh = (final int a, B<C> b) -> a;
    Function<X, Y> mr = A::new; mr = int[]::new; mr = List<String>::size; mr = this::<T>foo; Object o = (A & B) () -> 1;
    if (o instanceof String str && !str.isEmpty()) assert a : "b"; else synchronized (this) { }
    a.b[c].d().<E>f(1)[2] = (String) x; outer.new Inner(); new A[]{b}[0].go(); x = A.class; y = int[].class; z = Outer.this.x;
    record Local(int x) {} class L {} interface M {} ; int yield2 = a < b ? c : d; String record = "x"; record = a;
    return;
  }
}
interface I { int x = 1; private static void y() { } }
"""

SCRIPT = """#!/usr/bin/env node
'use strict'
var a = 1, b = /[/\\]]+/g.test(x) ? `t${a + `${b}`} }` : c / 2 / d
let {p, q: [r, , ...s] = [], ...u} = v; const w = (x, {y = 1, z}, [k] = [], ...rest) => ({x, y});
for (const i of list) { if (i) continue; else break } for (let i = 0, j; i < 3; i++) ; for (x in o) ; for (;;) { break }
label: while (1) { do { continue label } while (0) }
async function* g(a, b = 2,) { for await (const x of y) yield* x; await z; return }
class A extends (B, C) { #p = 1; static s; static { this.t = 1 } constructor() { super(); this.#p?.q?.[0]?.(1) } get x() { return 1 } set x(v) {} async *[k]() {} static async m() {} 'q'() {} 3() {} get; set = 1 }
switch (a) { case 1: default: f() } try { throw new Error } catch { } finally { }
x = function () { return new.target }, y = async x => await x, z = async (a, b) => a ** b, n = 1_000n ?? 0b11
;({a = 1, b} = c); [a, b] = [b, a]; o = {a, 'b': 1, [c]: 2, get d() { return 1 }, async e() {}, *f() {}, ...h, if: 1}; o.if.class
i++
--j
if (a) function ff() {}
var yield_ = let_ => typeof void delete x.y, async = 1; async(); let
z2 = 1
return_: { break return_ }
a = b
/re/g.exec(c)
<!-- comment
--> another
"""


def test_java_accepts():
    assert parses("java", JAVA)
    for text in ("", "// only\n/* comments */", ";", "module a.b { requires transitive c; exports d to e, f; }", "class A { non-sealed interface B {} }", "class A { int sealed, permits, record; void f() { yield = 1; x = y -> z; } }"):
        assert parses("java", text), text


@pytest.mark.parametrize("old, new", [
    ("class A<T", "class <T"), ("return null; }", "return null }"), ("for (;;)", "for (;)"), ("static {", "static }"), ("case 1:", "case :"), ("Q, ;", "Q R;"), ("import static a.B.*;", "import static a.*.B;"),
    ("List<String> s", "List<String s"), ("i >>>= 1;", "i + 1;"), ("int v() default 1;", "int v() default;"), ("'c'", "'cd'"), ("interface I {", "<<<<<<< HEAD\ninterface I {"), ("0x1F", "0xG"), ("a.b[c].d()", "a.b[c.d()"), ("x(); while (y);", "x(); while y;"),
    ("catch (final E | F e) { } finally { }", ""),
])
def test_java_refuses(old, new):
    assert old in JAVA
    changed = JAVA.replace(old, new, 1)
    assert not parses("java", changed) or old.startswith("catch")


def test_java_refuses_every_prefix_of_a_class():
    body = JAVA[JAVA.index("@Ann") : JAVA.index("interface I {")].rstrip()
    assert all(not parses("java", body[:n]) for n in range(1, len(body) - 1, 37))


def test_script_accepts():
    assert parses("js", SCRIPT)
    for text in ("", "// c", "a\n++b", "x = a ? b : c => d", "({}).x", "(function(){})()", "if (a) ; else b", "var x = y\n(z)", "`${`a${b}`}`", "async () => {}", "import('x').then(y)", "let of = 1; for (of of of) ;"):
        assert parses("js", text), text


@pytest.mark.parametrize("text", [
    "function f( {", "x = ", "a b", "({a = 1})", "(a, b)) => c", "(a, ...b)", "() ", "return 1", "break", "continue", "import a from 'b'", "export default 1", "`abc", "'abc\n'", "/abc", "x = {a: 1", "[1, 2", "const x", "let {a}",
    "if (a", "a => {", "class A { x y }", "<<<<<<< HEAD\na", "1 = 2", "f() = 1", "for (a of b, c) ;", "new.target", "try {}", "switch (a) { case: }", "throw\na", "x = 08a", "'\\x1'", "a?.b = 1", "while (1) { break nolabel }", "package a.b;\nclass C {}",
])
def test_script_refuses(text):
    assert not parses("js", text)


def test_xml_and_json():
    for text in ("<a/>", "<?xml version='1.0'?><!DOCTYPE a [<!ENTITY e 'x'>]><a b='&e;'>&#65;<![CDATA[<]]></a>", "<?xml version='1.0' encoding='ISO-8859-1'?><a>é</a>"):
        assert parses("xml", text), text
    for text in ("", " ", "<a>", "<a></b>", "<a/><b/>", "<a b=c/>", "<a b='1' b='2'/>", "<a>&x;</a>", "<a>\x01</a>", "text", "<<<<<<< HEAD\n<a/>"):
        assert not parses("xml", text), text
    deep = "[" * 30000 + "]" * 30000
    for text in ("{}", "1", ' "a\\u00e9" ', "[1, -0.5e+3, null, true, {\"a\": {}}]", "1" * 6000, deep):
        assert parses("json", text), text[:30]
    for text in ("", " ", "{,}", "[1,]", "{'a': 1}", "NaN", "[Infinity]", "01", "+1", "1 2", "{\"a\" 1}", '"a\nb"', "[1] // c", deep[:-1], deep + "]", "[" * 30000 + "," + "]" * 30000):
        assert not parses("json", text), text[:30]


def test_deep_nesting_is_parsed():
    assert parses("java", "class A { int x = " + "(" * 3000 + "1" + ")" * 3000 + "; }")
    assert parses("js", "x = " + "[" * 3000 + "]" * 3000)


def test_judging(spark):
    rows = [
        ("r", "a/A.java", "class A {}"), ("r", "a/A.java", "class A {}"), ("r", "B.JAVA", "<a/>"), ("r", "c.Json", "class {"), ("r", "d.xml", ""), ("r", "e.js", ""), ("r", "f.java", None), ("r", "g.md", "<<<"), ("r", None, "x"), ("s", "dir.js/x", "((("),
        (None, "h.json", "{}"), ("r", "i.js", "[1]"), ("r", "long.js", "f();\n" * 50_000),
    ]
    files = spark.createDataFrame([(*x, "v", 1) for x in rows], "repo_id string, path string, content string, status string, language int")
    got = {(r.repo_id, r.path): (r.language, r.status, r.parses_as) for r in judge_files(files).collect()}
    assert got == {
        ("r", "a/A.java"): ("java", "valid", ["java", "js"]), ("r", "B.JAVA"): ("java", "wrong_extension", ["xml"]), ("r", "c.Json"): ("json", "corrupt", []), ("r", "d.xml"): ("xml", "corrupt", ["java", "js"]),
        ("r", "e.js"): ("js", "valid", ["java", "js"]), (None, "h.json"): ("json", "valid", ["json", "js"]), ("r", "i.js"): ("js", "valid", ["json", "js"]), ("r", "long.js"): ("js", "valid", ["js"]),
    }
    rates = {(r.repo_id, r.language): (r.n_files, r.n_invalid, r.n_wrong_extension, r.n_corrupt) for r in parse_rates(judge_files(files)).collect()}
    assert rates["r", "java"] == (2, 1, 1, 0) and rates["r", "json"] == (1, 1, 0, 1)
    assert judge_files(files.limit(0)).count() == 0
