"""Recogniser of Java 17 compilation units.

Operator precedence is left out, as it doesn't change which texts are in the language. Statements that are no
statements (`a + b;`) and targets that can't be assigned are faults; what needs names or types is not looked at.
"""

from __future__ import annotations

import re

from wakegraph.llm.syntax.common import SyntaxFault

# The reserved words of the language.
RESERVED = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final"
    " finally float for goto if implements import instanceof int interface long native new package private protected"
    " public return short static strictfp super switch synchronized this throw throws transient try void volatile while"
    " _ true false null".split()
)
PRIMITIVE = frozenset("boolean byte char double float int long short".split())
MODIFIER = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())
BINARY = frozenset("* / % + - << < <= == != & ^ | && ||".split())
LITERAL = frozenset(["NUM", "STR", "true", "false", "null"])
STATEMENT_KINDS = frozenset(["assign", "step", "call", "new"])
TARGET_KINDS = frozenset(["name", "field", "item"])

_ESC = r"\\(?:[btnfrs\"'\\]|[0-3]?[0-7]?[0-7])"
_TOKEN = re.compile(
    rf"""[ \t\n\r\f]+|//[^\n\r]*|/\*[\s\S]*?\*/
|(?P<id>[^\W\d][\w$]*|\$[\w$]*)
|(?P<num>0[xX](?:[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?)?(?:\.[0-9a-fA-F_]*)?[pP][+-]?\d[\d_]*[fFdD]?
 |0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?
 |0[bB][01](?:[01_]*[01])?[lL]?
 |(?:\d(?:[\d_]*\d)?\.?(?:\d(?:[\d_]*\d)?)?|\.\d(?:[\d_]*\d)?)(?:[eE][+-]?\d(?:[\d_]*\d)?)?[fFdDlL]?)
|(?P<str>\"\"\"[ \t\f]*(?:\r\n|\r|\n)(?:(?!\"\"\")(?:{_ESC}|\\(?:\r\n|\r|\n)|[^\\]))*\"\"\"
 |"(?!"")(?:{_ESC}|[^"\\\n\r])*"
 |""(?!")
 |'(?:{_ESC}|[^'\\\n\r])')
|(?P<op>->|::|\.\.\.|\+\+|--|&&|\|\||<<=|==|!=|<=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[-+*/%&|^!~<>=?:;,.(){{}}\[\]@])""",
    re.VERBOSE,
)
_UNICODE = re.compile(r"(?<!\\)((?:\\\\)*)\\u+([0-9a-fA-F]{4})")
_CLOSES = {")": "(", "]": "[", "}": "{"}


class _Java:
    def __init__(self, text: str):
        if "\\u" in text:
            text = _UNICODE.sub(lambda m: m[1] + chr(int(m[2], 16)), text)
        if text.endswith("\x1a"):
            text = text[:-1]
        k: list[str] = []
        at: list[int] = []
        pos, end, match = 0, len(text), _TOKEN.match
        opened: list[int] = []
        pair: dict[int, int] = {}
        while pos < end:
            m = match(text, pos)
            if not m:
                raise SyntaxFault(f"no token at {pos}")
            group = m.lastgroup
            if group:
                t = m[0]
                if group == "id":
                    t = t if t in RESERVED else "I:" + t
                elif group == "num":
                    t = "NUM"
                elif group == "str":
                    t = "STR"
                elif t in "([{":
                    opened.append(len(k))
                elif t in ")]}":
                    if not opened or k[opened[-1]] != _CLOSES[t]:
                        raise SyntaxFault(f"{t} closes nothing at {pos}")
                    pair[opened.pop()] = len(k)
                k.append(t)
                at.append(pos)
            pos = m.end()
        if opened:
            raise SyntaxFault("a bracket stays open")
        k += ["EOF"] * 4
        at += [end + 9 * i + 9 for i in range(4)]
        self.k, self.at, self.pair, self.i = k, at, pair, 0

    # tokens
    def fail(self):
        raise SyntaxFault(f"{self.k[self.i]} at {self.at[self.i]}")

    def eat(self, t: str) -> None:
        if self.k[self.i] != t:
            self.fail()
        self.i += 1

    def has(self, t: str) -> bool:
        if self.k[self.i] == t:
            self.i += 1
            return True
        return False

    def name(self) -> None:
        if self.k[self.i][:2] != "I:":
            self.fail()
        self.i += 1

    def qualified(self) -> None:
        self.name()
        while self.k[self.i] == "." and self.k[self.i + 1][:2] == "I:":
            self.i += 2

    # types: each gives the index after it, or -1
    def type_at(self, i: int) -> int:
        k = self.k
        i = self.annotations_at(i)
        if i < 0:
            return -1
        if k[i] in PRIMITIVE:
            return self.dims_at(i + 1)
        i = self.class_type_at(i)
        return self.dims_at(i) if i >= 0 else -1

    def class_type_at(self, i: int) -> int:
        k = self.k
        while True:
            i = self.annotations_at(i)
            if i < 0 or k[i][:2] != "I:":
                return -1
            i += 1
            if k[i] == "<":
                i = self.arguments_at(i)
                if i < 0:
                    return -1
            if k[i] == "." and (k[i + 1][:2] == "I:" or k[i + 1] == "@"):
                i += 1
            else:
                return i

    def arguments_at(self, i: int) -> int:
        k = self.k
        i += 1
        if k[i] == ">":
            return i + 1
        while True:
            i = self.annotations_at(i)
            if i < 0:
                return -1
            if k[i] == "?":
                i += 1
                if k[i] in ("extends", "super"):
                    i = self.type_at(i + 1)
            else:
                i = self.type_at(i)
            if i < 0:
                return -1
            if k[i] == ">":
                return i + 1
            if k[i] != ",":
                return -1
            i += 1

    def dims_at(self, i: int) -> int:
        k = self.k
        while True:
            j = self.annotations_at(i) if k[i] == "@" else i
            if j >= 0 and k[j] == "[" and k[j + 1] == "]":
                i = j + 2
            else:
                return i

    def annotations_at(self, i: int) -> int:
        k = self.k
        while k[i] == "@" and k[i + 1] != "interface":
            i += 1
            if k[i][:2] != "I:":
                return -1
            i += 1
            while k[i] == "." and k[i + 1][:2] == "I:":
                i += 2
            if k[i] == "(":
                i = self.pair[i] + 1
        return i

    def type(self) -> None:
        j = self.type_at(self.i)
        if j < 0:
            self.fail()
        self.i = j

    def class_type(self) -> None:
        j = self.class_type_at(self.i)
        if j < 0:
            self.fail()
        self.i = j

    def annotation(self) -> None:
        self.eat("@")
        self.qualified()
        if self.k[self.i] == "(":
            end = self.pair[self.i]
            self.i += 1
            if self.i != end:
                if self.k[self.i][:2] == "I:" and self.k[self.i + 1] == "=":
                    while True:
                        self.name()
                        self.eat("=")
                        self.element()
                        if not self.has(","):
                            break
                else:
                    self.element()
            if self.i != end:
                self.fail()
            self.i += 1

    def element(self) -> None:
        if self.k[self.i] == "@":
            self.annotation()
        elif self.k[self.i] == "{":
            self.i += 1
            while self.k[self.i] != "}":
                if self.k[self.i] == ",":
                    self.i += 1
                    break
                self.element()
                if not self.has(","):
                    break
            self.eat("}")
        else:
            self.ternary()

    def modifiers(self) -> None:
        while True:
            t = self.k[self.i]
            if t == "@" and self.k[self.i + 1] != "interface":
                self.annotation()
            elif t in MODIFIER:
                if t == "default" and self.k[self.i + 1] in (":", "->"):
                    return
                self.i += 1
            elif t == "I:sealed" and self.starts_declaration(self.i + 1):
                self.i += 1
            elif t == "I:non" and self.k[self.i + 1] == "-" and self.k[self.i + 2] == "I:sealed":
                self.i += 3
            else:
                return

    def starts_declaration(self, i: int) -> bool:
        t = self.k[i]
        return t in ("class", "interface", "abstract", "public", "private", "protected", "static", "strictfp", "@") or t == "I:sealed"

    # declarations
    def unit(self) -> None:
        k = self.k
        self.module_or_package()
        while k[self.i] != "EOF":
            if self.has(";"):
                continue
            if k[self.i] == "import":
                self.i += 1
                self.has("static")
                self.name()
                while self.has("."):
                    if self.has("*"):
                        break
                    self.name()
                self.eat(";")
            else:
                break
        while k[self.i] != "EOF":
            if self.has(";"):
                continue
            self.modifiers()
            if not self.type_declaration():
                self.fail()

    def module_or_package(self) -> None:
        k, start = self.k, self.i
        while k[self.i] == "@" and k[self.i + 1] != "interface":
            self.annotation()
        if self.has("package"):
            self.qualified()
            self.eat(";")
            return
        if (k[self.i] == "I:open" and k[self.i + 1] == "I:module") or (k[self.i] == "I:module" and k[self.i + 1][:2] == "I:"):
            self.has("I:open")
            self.i += 1
            self.qualified()
            self.eat("{")
            while not self.has("}"):
                self.directive()
            return
        self.i = start

    def directive(self) -> None:
        t = self.k[self.i]
        self.i += 1
        if t == "I:requires":
            while self.k[self.i] in ("I:transitive", "static") and self.k[self.i + 1] not in (";", "."):
                self.i += 1
            self.qualified()
        elif t in ("I:exports", "I:opens", "I:provides"):
            self.qualified()
            if self.has("I:with" if t == "I:provides" else "I:to"):
                self.qualified()
                while self.has(","):
                    self.qualified()
        elif t == "I:uses":
            self.qualified()
        else:
            self.i -= 1
            self.fail()
        self.eat(";")

    def type_declaration(self) -> bool:
        k, t = self.k, self.k[self.i]
        if t == "class":
            self.i += 1
            self.name()
            self.type_parameters()
            if self.has("extends"):
                self.class_type()
            self.type_list("implements")
            self.type_list("I:permits")
            self.body("class")
        elif t == "interface":
            self.i += 1
            self.name()
            self.type_parameters()
            self.type_list("extends")
            self.type_list("I:permits")
            self.body("interface")
        elif t == "enum":
            self.i += 1
            self.name()
            self.type_list("implements")
            self.enum_body()
        elif t == "@" and k[self.i + 1] == "interface":
            self.i += 2
            self.name()
            self.body("annotation")
        elif t == "I:record" and k[self.i + 1][:2] == "I:" and k[self.i + 2] in ("(", "<"):
            self.i += 2
            self.type_parameters()
            self.parameters()
            self.type_list("implements")
            self.body("record")
        else:
            return False
        return True

    def type_list(self, word: str) -> None:
        if self.has(word):
            self.class_type()
            while self.has(","):
                self.class_type()

    def type_parameters(self) -> None:
        if self.has("<"):
            while True:
                while self.k[self.i] == "@":
                    self.annotation()
                self.name()
                if self.has("extends"):
                    self.class_type()
                    while self.has("&"):
                        self.class_type()
                if not self.has(","):
                    break
            self.eat(">")

    def enum_body(self) -> None:
        self.eat("{")
        while self.k[self.i][:2] == "I:" or self.k[self.i] == "@":
            while self.k[self.i] == "@":
                self.annotation()
            self.name()
            if self.k[self.i] == "(":
                self.args()
            if self.k[self.i] == "{":
                self.body("class")
            if not self.has(","):
                break
        else:
            self.has(",")
        if self.has(";"):
            while self.k[self.i] != "}":
                self.member("class")
        self.eat("}")

    def body(self, kind: str) -> None:
        self.eat("{")
        while self.k[self.i] != "}":
            self.member(kind)
        self.i += 1

    def member(self, kind: str) -> None:
        k = self.k
        if self.has(";"):
            return
        if k[self.i] == "{":
            return self.block()
        if k[self.i] == "static" and k[self.i + 1] == "{":
            self.i += 1
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return
        generic = k[self.i] == "<"
        self.type_parameters()
        while k[self.i] == "@":
            self.annotation()
        if k[self.i][:2] == "I:" and k[self.i + 1] == "(":  # constructor
            self.i += 1
            self.parameters()
            self.throws()
            return self.block()
        if kind == "record" and k[self.i][:2] == "I:" and k[self.i + 1] == "{":  # compact constructor
            self.i += 1
            return self.block()
        if not self.has("void"):
            self.type()
        elif k[self.i + 1] != "(":
            self.fail()
        self.name()
        if k[self.i] == "(":
            self.parameters()
            self.i = self.dims_at(self.i)
            self.throws()
            if kind == "annotation" and self.has("default"):
                self.element()
            if k[self.i] == "{":
                self.block()
            else:
                self.eat(";")
            return
        if generic:
            self.fail()
        self.declarators()
        self.eat(";")

    def throws(self) -> None:
        self.type_list("throws")

    def parameters(self) -> None:
        self.eat("(")
        if self.has(")"):
            return
        while True:
            self.modifiers()
            self.type()
            while self.k[self.i] == "@":
                self.annotation()
            self.has("...")
            if self.k[self.i] == "this":
                self.i += 1
            else:
                self.name()
                if self.k[self.i] == "." and self.k[self.i + 1] == "this":
                    self.i += 2
            self.i = self.dims_at(self.i)
            if not self.has(","):
                break
        self.eat(")")

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.i = self.dims_at(self.i)
            if self.has("="):
                self.initializer()
            if not self.has(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.k[self.i] == "{":
            self.i += 1
            while self.k[self.i] != "}":
                if self.k[self.i] == ",":
                    self.i += 1
                    break
                self.initializer()
                if not self.has(","):
                    break
            self.eat("}")
        else:
            self.expr()

    # statements
    def block(self) -> None:
        self.eat("{")
        while self.k[self.i] != "}":
            self.block_statement()
        self.i += 1

    def local_at(self, i: int) -> int:
        """The index of the name of a local variable declaration, or -1."""
        j = self.type_at(i)
        if j >= 0 and self.k[j][:2] == "I:" and self.k[j + 1] in ("=", ";", ",", ":", "[", ")"):
            return j
        return -1

    def block_statement(self) -> None:
        k, t = self.k, self.k[self.i]
        if t in ("final", "abstract", "@", "static", "strictfp") or (t == "I:sealed" or t == "I:non") and self.is_modified_type():
            self.modifiers()
            if self.type_declaration():
                return
            j = self.local_at(self.i)
            if j < 0:
                self.fail()
            self.i = j + 1
            self.declarators()
            return self.eat(";")
        if t in ("class", "interface", "enum") or t == "I:record" and k[self.i + 1][:2] == "I:" and k[self.i + 2] in ("(", "<"):
            self.type_declaration()
            return
        if t[:2] == "I:" or t in PRIMITIVE:
            if t == "I:yield" and k[self.i + 1] not in ("=", ".", "[", "++", "--", "(", "+=", "-="):
                return self.statement()
            j = self.local_at(self.i)
            if j >= 0:
                self.i = j + 1
                self.declarators()
                return self.eat(";")
        self.statement()

    def is_modified_type(self) -> bool:
        k = self.k
        if k[self.i] == "I:non":
            return k[self.i + 1] == "-" and k[self.i + 2] == "I:sealed"
        return self.starts_declaration(self.i + 1)

    def paren(self) -> None:
        self.eat("(")
        self.expr()
        self.eat(")")

    def statement(self) -> None:
        k, t = self.k, self.k[self.i]
        if t == "{":
            return self.block()
        if t == ";":
            self.i += 1
            return None
        if t[:2] == "I:":
            if k[self.i + 1] == ":":
                self.i += 2
                return self.statement()
            if t == "I:yield" and k[self.i + 1] not in ("=", ".", "[", "++", "--", "+=", "-=") and not (k[self.i + 1] == "(" and k[self.pair[self.i + 1] + 1] == "."):
                self.i += 1
                self.expr()
                return self.eat(";")
            return self.expression_statement()
        method = _STATEMENTS.get(t)
        if method is None:
            return self.expression_statement()
        self.i += 1
        return method(self)

    def expression_statement(self) -> None:
        if self.expr() not in STATEMENT_KINDS:
            self.fail()
        self.eat(";")

    def s_if(self) -> None:
        self.paren()
        self.statement()
        if self.has("else"):
            self.statement()

    def s_while(self) -> None:
        self.paren()
        self.statement()

    def s_do(self) -> None:
        self.statement()
        self.eat("while")
        self.paren()
        self.eat(";")

    def s_for(self) -> None:
        self.eat("(")
        k = self.k
        if k[self.i] != ";":
            start = self.i
            self.modifiers()
            j = self.local_at(self.i)
            if j >= 0:
                self.i = j + 1
                if k[self.dims_at(self.i)] == ":":
                    self.i = self.dims_at(self.i) + 1
                    self.expr()
                    self.eat(")")
                    return self.statement()
                self.declarators()
            else:
                if self.i != start:
                    self.fail()
                self.expression_list()
        self.eat(";")
        if k[self.i] != ";":
            self.expr()
        self.eat(";")
        if k[self.i] != ")":
            self.expression_list()
        self.eat(")")
        self.statement()

    def expression_list(self) -> None:
        while True:
            if self.expr() not in STATEMENT_KINDS:
                self.fail()
            if not self.has(","):
                return

    def s_try(self) -> None:
        resources = self.k[self.i] == "("
        if resources:
            self.i += 1
            while True:
                start = self.i
                self.modifiers()
                j = self.local_at(self.i)
                if j >= 0 and self.k[j + 1] == "=":
                    self.i = j + 2
                    self.expr()
                else:
                    self.i = start
                    if self.expr() not in ("name", "field", "other"):
                        self.fail()
                if not self.has(";") or self.k[self.i] == ")":
                    break
            self.eat(")")
        self.block()
        n = 0
        while self.has("catch"):
            n += 1
            self.eat("(")
            self.modifiers()
            self.class_type()
            while self.has("|"):
                self.class_type()
            self.name()
            self.eat(")")
            self.block()
        if self.has("finally"):
            self.block()
        elif not n and not resources:
            self.fail()

    def s_switch(self) -> None:
        self.switch_rest()

    def switch_rest(self) -> None:
        self.paren()
        self.eat("{")
        k = self.k
        while k[self.i] != "}":
            if self.has("default"):
                pass
            else:
                self.eat("case")
                while True:
                    if not self.has("default"):
                        self.ternary()
                    if not self.has(","):
                        break
            if self.has("->"):
                if k[self.i] == "{":
                    self.block()
                elif k[self.i] == "throw":
                    self.i += 1
                    self.s_throw()
                else:
                    self.expr()
                    self.eat(";")
            else:
                self.eat(":")
                while k[self.i] not in ("case", "default", "}"):
                    self.block_statement()
        self.i += 1

    def s_return(self) -> None:
        if self.k[self.i] != ";":
            self.expr()
        self.eat(";")

    def s_throw(self) -> None:
        self.expr()
        self.eat(";")

    def s_jump(self) -> None:
        if self.k[self.i] != ";":
            self.name()
        self.eat(";")

    def s_sync(self) -> None:
        self.paren()
        self.block()

    def s_assert(self) -> None:
        self.expr()
        if self.has(":"):
            self.expr()
        self.eat(";")

    # expressions: each gives the kind of what it read
    def expr(self) -> str:
        k, t = self.k, self.k[self.i]
        if t[:2] == "I:" and k[self.i + 1] == "->":
            self.i += 2
            return self.lambda_body()
        if t == "(" and k[self.pair[self.i] + 1] == "->":
            self.lambda_parameters()
            self.i += 1
            return self.lambda_body()
        kind = self.ternary()
        t = k[self.i]
        if t in ASSIGN or t == ">" and self.shift_assign():
            if kind not in TARGET_KINDS:
                self.fail()
            self.i += 1 if t != ">" else self.shift_assign()
            self.expr()
            return "assign"
        return kind

    def shift_assign(self) -> int:
        """The number of tokens of >>= or >>>= here, or 0."""
        k, at, i = self.k, self.at, self.i
        n = 1
        while k[i + n] == ">" and at[i + n] == at[i] + n:
            n += 1
        return n + 1 if n in (2, 3) and k[i + n] == "=" and at[i + n] == at[i] + n else 0

    def lambda_body(self) -> str:
        if self.k[self.i] == "{":
            self.block()
        else:
            self.expr()
        return "lambda"

    def lambda_parameters(self) -> None:
        k, end = self.k, self.pair[self.i]
        if self.i + 1 == end:
            self.i += 2
            return
        if k[self.i + 1][:2] == "I:" and k[self.i + 2] in (",", ")"):
            self.i += 1
            while True:
                self.name()
                if not self.has(","):
                    break
            self.eat(")")
        else:
            self.parameters()

    def ternary(self) -> str:
        k = self.k
        kind = self.unary()
        while True:
            t = k[self.i]
            if t in BINARY:
                self.i += 1
                self.unary()
            elif t == ">":
                if self.shift_assign():
                    return kind
                n, at = 1, self.at
                while n < 3 and k[self.i + n] == ">" and at[self.i + n] == at[self.i] + n:
                    n += 1
                if k[self.i + n] == "=" and at[self.i + n] == at[self.i] + n:
                    if n > 1:
                        self.fail()
                    n += 1
                elif k[self.i + n] == "==" and at[self.i + n] == at[self.i] + n:
                    self.fail()
                self.i += n
                self.unary()
            elif t == "instanceof":
                self.i += 1
                self.has("final")
                self.type()
                if k[self.i][:2] == "I:":
                    self.i += 1
            else:
                break
            kind = "other"
        if t == "?":
            self.i += 1
            self.expr()
            self.eat(":")
            nxt = k[self.i]
            if nxt[:2] == "I:" and k[self.i + 1] == "->" or nxt == "(" and k[self.pair[self.i] + 1] == "->":
                self.expr()
            else:
                self.ternary()
            return "other"
        return kind

    def unary(self) -> str:
        k, t = self.k, self.k[self.i]
        if t in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "other"
        if t in ("++", "--"):
            self.i += 1
            if self.unary() not in TARGET_KINDS:
                self.fail()
            return "step"
        if t == "(":
            end = self.pair[self.i]
            after = k[end + 1]
            j = self.type_at(self.i + 1)
            while j >= 0 and k[j] == "&":
                j = self.class_type_at(j + 1)
            if j == end:
                primitive = k[end - 1] in PRIMITIVE
                if primitive and after in ("+", "-", "++", "--") or after[:2] == "I:" or after in LITERAL or after in ("(", "!", "~", "this", "super", "new", "switch", "void") or after in PRIMITIVE:
                    self.i = end + 1
                    if after[:2] == "I:" and k[self.i + 1] == "->" or after == "(" and k[self.pair[self.i] + 1] == "->":
                        self.expr()
                    else:
                        self.unary()
                    return "other"
        return self.primary()

    def args(self) -> None:
        self.eat("(")
        if self.has(")"):
            return
        while True:
            self.expr()
            if not self.has(","):
                break
        self.eat(")")

    def primary(self) -> str:
        k, t = self.k, self.k[self.i]
        if t[:2] == "I:":
            nxt = k[self.i + 1]
            kind = "name"
            if nxt == "(":
                self.i += 1
                self.args()
                kind = "call"
            else:
                if nxt in ("<", ".", "[", "@"):
                    j = self.type_at(self.i)
                    if j > self.i + 1 and k[j] == "::" and k[j - 1] in (">", "]"):
                        self.i = j
                        return self.selectors("type")
                self.i += 1
        elif t in LITERAL:
            self.i += 1
            kind = "other"
        elif t == "(":
            self.i += 1
            kind = self.expr()
            kind = kind if kind in TARGET_KINDS else "other"
            self.eat(")")
        elif t == "this":
            self.i += 1
            kind = "other"
            if k[self.i] == "(":
                self.args()
                kind = "call"
        elif t == "super":
            self.i += 1
            if k[self.i] == "(":
                self.args()
                kind = "call"
            elif k[self.i] in (".", "::"):
                kind = "other"
            else:
                self.fail()
        elif t == "new":
            kind = self.creator()
        elif t == "switch":
            self.i += 1
            self.switch_rest()
            kind = "other"
        elif t in PRIMITIVE or t == "void":
            self.i = self.dims_at(self.i + 1)
            if k[self.i] == "." and k[self.i + 1] == "class":
                self.i += 2
                kind = "other"
            elif k[self.i] == "::":
                kind = "type"
            else:
                self.fail()
        elif t == "<":  # explicit type arguments of a constructor call
            j = self.arguments_at(self.i)
            if j < 0 or k[j] not in ("this", "super"):
                self.fail()
            self.i = j
            return self.primary()
        else:
            self.fail()
        return self.selectors(kind)

    def selectors(self, kind: str) -> str:
        k = self.k
        while True:
            t = k[self.i]
            if t == ".":
                self.i += 1
                t = k[self.i]
                if t == "<":
                    j = self.arguments_at(self.i)
                    if j < 0:
                        self.fail()
                    self.i = j
                    if k[self.i] == "super":
                        self.i += 1
                    else:
                        self.name()
                    self.args()
                    kind = "call"
                elif t[:2] == "I:":
                    self.i += 1
                    if k[self.i] == "(":
                        self.args()
                        kind = "call"
                    else:
                        kind = "field"
                elif t == "new":
                    kind = self.creator()
                elif t in ("this", "class"):
                    self.i += 1
                    kind = "other"
                elif t == "super":
                    self.i += 1
                    if k[self.i] == "(":
                        self.args()
                        kind = "call"
                    elif k[self.i] not in (".", "::"):
                        self.fail()
                else:
                    self.fail()
            elif t == "[":
                if k[self.i + 1] == "]":
                    self.i = self.dims_at(self.i)
                    if k[self.i] == "." and k[self.i + 1] == "class":
                        self.i += 2
                        kind = "other"
                    elif k[self.i] == "::":
                        kind = "type"
                    else:
                        self.fail()
                else:
                    self.i += 1
                    self.expr()
                    self.eat("]")
                    kind = "item"
            elif t == "::":
                self.i += 1
                if k[self.i] == "<":
                    j = self.arguments_at(self.i)
                    if j < 0:
                        self.fail()
                    self.i = j
                if not self.has("new"):
                    self.name()
                return "other"
            elif t in ("++", "--"):
                if kind not in TARGET_KINDS:
                    return kind
                self.i += 1
                return "step"
            elif kind == "type":
                self.fail()
            else:
                return kind

    def creator(self) -> str:
        k = self.k
        self.eat("new")
        while k[self.i] == "@":
            self.annotation()
        if k[self.i] == "<":
            j = self.arguments_at(self.i)
            if j < 0:
                self.fail()
            self.i = j
        if k[self.i] in PRIMITIVE:
            self.i += 1
            if k[self.i] not in ("[", "@"):
                self.fail()
        else:
            self.class_type()
        while k[self.i] == "@":
            self.annotation()
        if k[self.i] == "[":
            if k[self.i + 1] == "]":
                self.i = self.dims_at(self.i)
                if k[self.i] != "{":
                    self.fail()
                self.initializer()
            else:
                while k[self.i] == "[" and k[self.i + 1] != "]":
                    self.i += 1
                    self.expr()
                    self.eat("]")
                self.i = self.dims_at(self.i)
            return "array"
        self.args()
        if k[self.i] == "{":
            self.body("class")
        return "new"


_STATEMENTS = {
    "if": _Java.s_if, "while": _Java.s_while, "do": _Java.s_do, "for": _Java.s_for, "try": _Java.s_try, "switch": _Java.s_switch,
    "return": _Java.s_return, "throw": _Java.s_throw, "break": _Java.s_jump, "continue": _Java.s_jump, "synchronized": _Java.s_sync, "assert": _Java.s_assert,
}


def check_java(text: str) -> None:
    """Raises SyntaxFault unless the text is a compilation unit."""
    _Java(text).unit()
