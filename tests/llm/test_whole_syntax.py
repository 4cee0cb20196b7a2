from wakegraph.llm.syntax import parses

N = 60_000


def test_nesting_has_no_bound():
    deep = {
        "java": ["class A { int x = " + "(" * N + "1" + ")" * N + "; }", "class A { void m() { " + "switch(a){default:" * N + "}" * N + " } }"],
        "js": ["x = " + "[" * N + "]" * N, "(function(){" * N + "})" * N],
    }
    for language, texts in deep.items():
        for text in texts:
            assert parses(language, text), text[:30]
            assert not parses(language, text[:-1] + "("), text[:30]
