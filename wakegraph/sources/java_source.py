"""Declarations and call sites of Java sources.

A tokenizer and a walk over matched brackets find types, methods, fields, imports and calls; bodies are not parsed into
trees. A call's receiver gets the type that the nearest declaration before it gives its name: a local variable (by its
initialiser's type where that is plain), a parameter, or else a field. Files whose brackets don't match give one row of
kind `corrupt`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r'\s+|//[^\n]*|/\*.*?\*/|(?P<str>"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\')|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<op>->|::|\.\.\.|.)', re.S
)
# Words that may stand before a parenthesis without being a call, and modifiers.
_NO_CALL = frozenset("if for while switch catch synchronized return throw new assert do else try case yield".split())
_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
_TYPES = ("class", "interface", "enum", "record")
_PAIRS = {"(": ")", "[": "]", "{": "}"}

SCHEMA = (
    "repo_id string, path string, kind string, pkg string, owner string, name string, types array<string>, text string,"
    " start_line int, end_line int, is_static boolean, arity int, scope_kind string, scope string"
)
FIELDS = [p.split()[0] for p in SCHEMA.split(", ")]


class _Source:
    def __init__(self, text: str):
        self.t: list[str] = []
        self.kind: list[str] = []
        self.line: list[int] = []
        self.close: dict[int, int] = {}
        line, stack = 1, []
        for m in _TOKEN.finditer(text):
            s, k = m[0], m.lastgroup
            if k:
                if k == "op" and s in "([{":
                    stack.append(len(self.t))
                elif k == "op" and s in ")]}":
                    if not stack or _PAIRS[self.t[stack[-1]]] != s:
                        raise ValueError("brackets")
                    self.close[stack.pop()] = len(self.t)
                self.t.append(s)
                self.kind.append(k)
                self.line.append(line)
            line += s.count("\n")
        if stack:
            raise ValueError("brackets")
        self.t += [""] * 3
        self.kind += ["end"] * 3
        self.line += [line] * 3
        self.rows: list[dict] = []
        self.pkg = ""

    def add(self, **values) -> None:
        self.rows.append(values)

    def angle(self, i: int) -> int:
        """The index after <...> at i."""
        depth = 0
        while self.t[i]:
            depth += (self.t[i] == "<") - (self.t[i] == ">")
            i += 1
            if depth == 0:
                return i
        return i

    def type_at(self, i: int) -> tuple[str, int]:
        """A type's text without generics and annotations, and the index after it; an empty text if there is none."""
        while self.t[i] == "@":
            i = self.annotation(i)
        if self.kind[i] != "id":
            return "", i
        text = self.t[i]
        i += 1
        while True:
            if self.t[i] == "<":
                i = self.angle(i)
            elif self.t[i] == "." and self.kind[i + 1] == "id":
                text += "." + self.t[i + 1]
                i += 2
            elif self.t[i] == "[" and self.t[i + 1] == "]":
                text += "[]"
                i += 2
            elif self.t[i] == "...":
                return text + "[]", i + 1
            else:
                return text, i

    def annotation(self, i: int) -> int:
        _, i = self.type_at(i + 1)
        return self.close[i] + 1 if self.t[i] == "(" else i

    def modifiers(self, i: int) -> tuple[set[str], int]:
        found = set()
        while True:
            if self.t[i] == "@" and self.t[i + 1] != "interface":
                i = self.annotation(i)
            elif self.t[i] in _MODIFIERS and self.t[i + 1] not in ("(", "=", ";", ","):
                found.add(self.t[i])
                i += 1
            elif self.t[i] == "non" and self.t[i + 1] == "-":
                i += 3
            else:
                return found, i

    def unit(self) -> None:
        i = 0
        while self.t[i]:
            if self.t[i] == "package":
                j = self.t.index(";", i) if ";" in self.t[i:] else i
                self.pkg = "".join(self.t[i + 1 : j])
                i = j + 1
            elif self.t[i] == "import":
                j = self.t.index(";", i) if ";" in self.t[i:] else i
                words = self.t[i + 1 : j]
                static = words[:1] == ["static"]
                self.add(kind="import", name="".join(words[static:]), is_static=static, start_line=self.line[i], end_line=self.line[j])
                i = j + 1
            else:
                mods, j = self.modifiers(i)
                k = self.declared_type(self.pkg, mods, j)
                i = k if k > j else max(j, i) + 1

    def declared_type(self, outer: str, mods: set[str], i: int) -> int:
        """A type declaration at i; the index after it, or i."""
        at = i + (self.t[i] == "@")
        if self.t[at] not in _TYPES or self.kind[at + 1] != "id" or self.t[at] == "record" and self.t[at + 2] not in ("(", "<"):
            return i
        word, name = self.t[at], self.t[at + 1]
        fqn = f"{outer}.{name}" if outer else name
        j = at + 2
        parts: dict[str, list[str]] = {"extends": [], "implements": [], "permits": []}
        components: list[tuple[str, str]] = []
        if self.t[j] == "<":
            j = self.angle(j)
        if self.t[j] == "(":
            components = self.parameters(j)
            j = self.close[j] + 1
        while self.t[j] in parts:
            into = parts[self.t[j]]
            j += 1
            while True:
                text, j = self.type_at(j)
                if text:
                    into.append(text)
                if self.t[j] != ",":
                    break
                j += 1
        if self.t[j] != "{":
            return i
        end = self.close[j]
        extends, implements = (parts["extends"], parts["implements"]) if word != "interface" else ([], parts["extends"])
        self.add(kind=word, owner=outer, name=fqn, types=extends, text=",".join(implements), start_line=self.line[i], end_line=self.line[end], is_static="static" in mods)
        fields = {n: t for t, n in components}
        body = j + 1
        if word == "enum":
            body = self.constants(body, end)
        self.members(fqn, name, fields, body, end)
        return end + 1

    def constants(self, i: int, end: int) -> int:
        while i < end and self.t[i] != ";":
            i = self.close[i] + 1 if i in self.close else i + 1
        return i

    def parameters(self, i: int) -> list[tuple[str, str]]:
        """(type, name) of a parameter list at its bracket."""
        out, end, i = [], self.close[i], i + 1
        while i < end:
            _, i = self.modifiers(i)
            text, i = self.type_at(i)
            name = self.t[i] if self.kind[i] == "id" else ""
            i += 1
            while self.t[i] == "[":
                text += "[]"
                i += 2
            if text and name and name != "this":
                out.append((text, name))
            while i < end and self.t[i] != ",":
                i += 1
            i += 1
        return out

    def members(self, fqn: str, simple: str, fields: dict[str, str], i: int, end: int) -> None:
        bodies = []
        while i < end:
            if self.t[i] == ";":
                i += 1
                continue
            start = i
            mods, i = self.modifiers(i)
            if self.t[i] == "{":
                bodies.append((f"{fqn}.<clinit>()", {}, i, self.close[i]))
                i = self.close[i] + 1
                continue
            j = self.declared_type(fqn, mods, i)
            if j > i:
                i = j
                continue
            if self.t[i] == "<":
                i = self.angle(i)
            ctor = self.t[i] == simple and self.t[i + 1] in ("(", "{")
            kind, i = ("void", i) if ctor else self.type_at(i)
            name = self.t[i]
            if self.kind[i] != "id":
                i = start + 1 if i <= start else i + 1
                continue
            if self.t[i + 1] == "(" or ctor:
                params = self.parameters(i + 1) if self.t[i + 1] == "(" else []
                j = self.close[i + 1] + 1 if self.t[i + 1] == "(" else i + 1
                while j < end and self.t[j] not in ("{", ";"):
                    j = self.close[j] + 1 if j in self.close else j + 1
                last = self.close[j] if self.t[j] == "{" else j
                types = [t.rpartition(".")[2] for t, _ in params]
                method = f"{fqn}.{'<init>' if ctor else name}({','.join(types)})"
                self.add(kind="constructor" if ctor else "method", owner=fqn, name=method, types=types, text=kind, start_line=self.line[start], end_line=self.line[last], is_static="static" in mods, arity=len(types))
                if self.t[j] == "{":
                    bodies.append((method, {n: t for t, n in params}, j, last))
                i = last + 1
            else:
                while True:
                    fields[name] = kind
                    value = self.t[i + 2] if self.t[i + 1] == "=" and self.t[i + 3] in (";", ",") else None
                    self.add(kind="field", owner=fqn, name=f"{fqn}.{name}", types=[kind], text=value, start_line=self.line[i], end_line=self.line[i], is_static="static" in mods)
                    i += 1
                    depth = 0
                    while i < end and not (self.t[i] == ";" or self.t[i] == "," and depth == 0):
                        depth += (self.t[i] == "<") - (self.t[i] == ">" and depth > 0)
                        i = self.close[i] + 1 if i in self.close else i + 1
                    if self.t[i] != ",":
                        break
                    i += 1
                    name = self.t[i]
                i += 1
        for method, names, a, b in bodies:
            self.calls(fqn, method, {**fields, **names}, a, b)

    def calls(self, owner: str, method: str, names: dict[str, str], i: int, end: int) -> None:
        t, kind = self.t, self.kind
        while i < end:
            if kind[i] == "id" and kind[i + 1] == "id" and t[i] not in _NO_CALL and t[i + 2] in ("=", ";", ":", ",", ")"):
                declared, value = t[i], i + 3
                if t[i + 2] == "=" and t[value] == "new" and self.type_at(value + 1)[0]:
                    declared = self.type_at(value + 1)[0]
                names[t[i + 1]] = declared
            elif kind[i] == "id" and t[i + 1] in ("<", "[") and t[i] not in _NO_CALL and t[i - 1] not in (".", "new"):
                text, j = self.type_at(i)
                if text and kind[j] == "id" and t[j + 1] in ("=", ";", ":", ",", ")"):
                    names[t[j]] = text
            elif t[i] == "new":
                text, j = self.type_at(i + 1)
                if text and t[j] == "(":
                    self.site(owner, method, "new", text, "<init>", j, self.line[i])
            elif kind[i] == "id" and t[i + 1] == "(" and t[i] not in _NO_CALL and t[i - 1] != "new":
                self.receiver(owner, method, names, i)
            elif kind[i] == "id" and t[i - 1] == "." and kind[i - 2] == "id" and t[i - 3] != "." and kind[i + 1] != "id" and t[i + 1] not in ("(", ".", "<", "::"):
                self.access(owner, method, names, i)
            i += 1

    def receiver(self, owner: str, method: str, names: dict[str, str], i: int) -> None:
        t, kind = self.t, self.kind
        name = t[i]
        if name in ("this", "super"):
            return self.site(owner, method, name, None, "<init>", i + 1, self.line[i])
        if t[i - 1] != ".":
            back = i - 1
            if t[back] == ">" or kind[back] == "id" and t[back] not in _NO_CALL and t[back] not in ("else", "do"):
                return None  # a declaration in a nested type
            return self.site(owner, method, "none", None, name, i + 1, self.line[i])
        j = i - 2
        if t[j] in ("this", "super"):
            return self.site(owner, method, t[j], None, name, i + 1, self.line[i])
        if kind[j] == "str":
            return self.site(owner, method, "type", "String", name, i + 1, self.line[i])
        if kind[j] != "id":
            return self.site(owner, method, "expression", None, name, i + 1, self.line[i])
        parts = [t[j]]
        while t[j - 1] == "." and kind[j - 2] == "id":
            j -= 2
            parts.insert(0, t[j])
        if t[j - 1] == ".":
            return self.site(owner, method, "expression", None, name, i + 1, self.line[i])
        if parts[0] == "this" and len(parts) == 2:
            parts = parts[1:]
        text = ".".join(parts)
        if len(parts) == 1 and text in names:
            return self.site(owner, method, "variable", names[text], name, i + 1, self.line[i])
        if parts[-1][:1].isupper():
            return self.site(owner, method, "type", text, name, i + 1, self.line[i])
        # a name that nothing here declares may be a field of an ancestor
        return self.site(owner, method, *(("field", text) if len(parts) == 1 else ("expression", None)), name, i + 1, self.line[i])

    def access(self, owner: str, method: str, names: dict[str, str], i: int) -> None:
        """The field named at i, behind a point and one word."""
        word = self.t[i - 2]
        kind, scope = ("this", None) if word == "this" else ("super", None) if word == "super" else ("variable", names[word]) if word in names else ("type", word) if word[:1].isupper() else ("field", word)
        self.add(kind="access", owner=method, name=self.t[i], types=[owner], start_line=self.line[i], end_line=self.line[i], scope_kind=kind, scope=scope)

    def site(self, owner: str, method: str, scope_kind: str, scope: str | None, name: str, bracket: int, line: int) -> None:
        end, i, n = self.close[bracket], bracket + 1, int(self.close[bracket] > bracket + 1)
        first = self.t[i] if self.kind[i] == "str" and i + 1 == end else None
        while i < end:
            if self.t[i] == ",":
                n += 1
            i = self.close[i] + 1 if i in self.close else i + 1
        self.add(kind="call", owner=method, name=name, types=[owner], text=first, start_line=line, end_line=line, arity=n, scope_kind=scope_kind, scope=scope)


def read_java(text: str) -> tuple[str, list[dict]]:
    """(package, records) of a source; raises ValueError when its brackets don't match."""
    source = _Source(text)
    source.unit()
    return source.pkg, source.rows


def java_records(files: DataFrame) -> DataFrame:
    """One row a declaration, import or call of the Java files of files(repo_id, path, content); see SCHEMA.

    kind: class, interface, enum, record, method, constructor, field, import, call, access, corrupt. Null contents and other
    extensions give nothing.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in files.sparkSession.createDataFrame([], SCHEMA).schema]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[dict] = []
            for repo, path, text in zip(*[c.to_pylist() for c in batch.columns]):
                try:
                    pkg, rows = read_java(text)
                except ValueError:
                    pkg, rows = None, [{"kind": "corrupt"}]
                got += [{"repo_id": repo, "path": path, "pkg": pkg, **r} for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([g.get(f) for g in got], t) for f, t in zip(FIELDS, types)], names=FIELDS)

    java = files.where(F.lower("path").endswith(".java") & F.col("content").isNotNull()).select("repo_id", "path", "content").distinct()
    return java.mapInArrow(work, SCHEMA)
