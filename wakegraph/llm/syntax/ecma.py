"""Recogniser of ECMAScript scripts (no modules), with automatic semicolons.

The scanner is driven by the parser, which knows where a slash begins a regular expression. Parentheses and brackets are
read under a cover grammar: what only arrow parameters or patterns may hold is a fault unless `=>` or `=` follows.
"""

from __future__ import annotations

import re

from wakegraph.llm.syntax.common import SyntaxFault

# The reserved words of a script outside strict code.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function"
    " if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = frozenset("* / % ** + - << >> >>> < > <= >= == != === !== & ^ | && || ?? instanceof in".split())
TARGETS = frozenset(["name", "member"])
PATTERNS = frozenset(["object", "array"])

_SPACE = re.compile(r"(?:[ \t\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000\n\r\u2028\u2029]+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/|<!--[^\n\r\u2028\u2029]*)+")
_LINE_END = re.compile(r"[\n\r\u2028\u2029]")
_CLOSE_COMMENT = re.compile(r"-->[^\n\r\u2028\u2029]*")
_ID_PART = r"(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})"
_TOKEN = re.compile(
    rf"""(?P<id>(?:[^\W\d]|\$|\\u[0-9a-fA-F]{{4}}|\\u\{{[0-9a-fA-F]+\}}){_ID_PART}*)
|(?P<private>\#(?:[^\W\d]|\$){_ID_PART}*)
|(?P<num>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?
 |(?:(?:0|[1-9]\d*(?:_\d+)*)n|(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?))(?![\w$])
|(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
|(?P<op>=>|\.\.\.|\?\.(?!\d)|\?\?=|\?\?|&&=|\|\|=|\*\*=|\*\*|>>>=|>>>|>>=|<<=|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>
 |[{{}}()\[\];,<>+\-*/%&|^!~?:=.`@])""",
    re.VERBOSE,
)
_BAD_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+/([\w$]*)")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?P<end>`|\$\{)?")


class _Script:
    def __init__(self, text: str):
        self.text, self.pos, self.end = text, 0, len(text)
        if text.startswith("#!"):
            m = _LINE_END.search(text)
            self.pos = m.start() if m else self.end
        self.function = self.loop = self.breakable = self.generator = self.asynchronous = False
        self.labels: list[str] = []
        self.cover: int | None = None  # where something stands that only a pattern may hold
        self.newline = True
        self.after = 0
        self.next()

    # tokens: self.t is the kind ("id", "str", "num", an operator or reserved word, "end"), self.v its text
    def next(self) -> None:
        self.after = self.pos
        text, first = self.text, self.pos == 0
        self.newline = first
        while True:
            m = _SPACE.match(text, self.pos)
            if m:
                if _LINE_END.search(m[0]):
                    self.newline = True
                self.pos = m.end()
            if self.newline and text.startswith("-->", self.pos):
                self.pos = _CLOSE_COMMENT.match(text, self.pos).end()
                continue
            break
        self.start = self.pos
        if self.pos >= self.end:
            self.t, self.v = "end", ""
            return
        m = _TOKEN.match(text, self.pos)
        if not m:
            raise SyntaxFault(f"no token at {self.pos}")
        self.v = m[0]
        group = m.lastgroup
        if group == "op":
            self.t = self.v
        elif group == "id":
            self.t = self.v if self.v in RESERVED else "id"
        else:
            if group == "str" and "\\" in self.v and _BAD_ESCAPE.search(self.v.replace("\\\\", "")):
                raise SyntaxFault(f"escape at {self.pos}")
            self.t = group
        self.pos = m.end()

    def fail(self):
        raise SyntaxFault(f"{self.v or 'end'} at {self.start}")

    def eat(self, t: str) -> None:
        if self.t != t:
            self.fail()
        self.next()

    def has(self, t: str) -> bool:
        if self.t == t:
            self.next()
            return True
        return False

    def word(self, w: str) -> bool:
        return self.t == "id" and self.v == w

    def peek(self) -> tuple[str, bool]:
        """Text of the token after this one (a slash counts as an operator), and whether a line ends before it."""
        pos, newline = self.pos, False
        m = _SPACE.match(self.text, pos)
        if m:
            newline, pos = bool(_LINE_END.search(m[0])), m.end()
        m = _TOKEN.match(self.text, pos)
        return (m[0] if m else "", newline)

    def semicolon(self) -> None:
        if self.t == ";":
            self.next()
        elif self.t not in ("}", "end") and not self.newline:
            self.fail()

    def name(self) -> None:
        if self.t != "id":
            self.fail()
        if self.v == "yield" and self.generator or self.v == "await" and self.asynchronous:
            self.fail()
        self.next()

    # statements
    def script(self) -> None:
        while self.t != "end":
            self.item()

    def item(self) -> None:
        t = self.t
        if t == "function":
            self.next()
            self.has("*") and self.mark_generator()
            self.function_rest(True, *self.flags())
        elif t == "class":
            self.next()
            self.class_rest(True)
        elif t == "const" or t == "id" and self.v == "let" and self.declares():
            self.next()
            self.declarations(t == "const")
            self.semicolon()
        elif t == "id" and self.v == "async" and self.peek() == ("function", False):
            self.next()
            self.next()
            star = self.has("*")
            self.function_rest(True, star, True)
        else:
            self.statement()

    def mark_generator(self) -> None:
        self.star = True

    def flags(self) -> tuple[bool, bool]:
        star, self.star = getattr(self, "star", False), False
        return star, False

    def declares(self, in_for: bool = False) -> bool:
        """Whether `let` begins a declaration here."""
        nxt = self.peek()[0]
        return nxt[:1] in "[{" and nxt != "" or (bool(re.match(r"[^\W\d]|\$|\\", nxt)) and nxt not in RESERVED and not (in_for and nxt == "of"))

    def block(self) -> None:
        self.eat("{")
        while self.t != "}":
            if self.t == "end":
                self.fail()
            self.item()
        self.next()

    def declarations(self, needs_value: bool, in_for: bool = False) -> int:
        n = 0
        while True:
            n += 1
            pattern = self.t in ("{", "[")
            self.binding()
            if self.has("="):
                self.assignment(not in_for)
                n += 100
            elif (needs_value or pattern) and not (in_for and (self.t == "in" or self.word("of"))):
                self.fail()
            if not self.has(","):
                return n

    def binding(self) -> None:
        if self.t == "[":
            self.next()
            while self.t != "]":
                if self.has(","):
                    continue
                rest = self.has("...")
                self.binding()
                if rest:
                    break
                if self.has("="):
                    self.assignment()
                if self.t != "]":
                    self.eat(",")
            self.eat("]")
        elif self.t == "{":
            self.next()
            while self.t != "}":
                if self.has("..."):
                    self.name()
                    break
                plain = self.t == "id"
                self.key()
                if self.has(":"):
                    self.binding()
                elif not plain:
                    self.fail()
                if self.has("="):
                    self.assignment()
                if self.t != "}":
                    self.eat(",")
            self.eat("}")
        else:
            self.name()

    def key(self) -> bool:
        """A property name; whether it is computed."""
        if self.t == "[":
            self.next()
            self.assignment()
            self.eat("]")
            return True
        if self.t in ("id", "str", "num", "private") or self.t in RESERVED:
            self.next()
            return False
        self.fail()

    def statement(self) -> None:
        t = self.t
        if t == "{":
            return self.block()
        if t == ";":
            return self.next()
        if t == "id":
            if self.peek()[0] == ":" and not (self.v == "yield" and self.generator):
                label = self.v
                self.next()
                self.next()
                self.labels.append(label)
                if self.t == "function":
                    self.item()
                else:
                    self.statement()
                self.labels.pop()
                return None
            if self.v == "let" and self.peek()[0] == "[":
                self.fail()
        method = _STATEMENTS.get(t)
        if method:
            return method(self)
        if t in ("function", "class", "const", "import", "export", "enum", "extends", "case", "default", "catch", "finally", "else", "in", "instanceof"):
            if t != "import" or self.peek()[0] not in ("(", "."):
                self.fail()
        self.expression()
        self.semicolon()
        return None

    def nested(self, loop: bool) -> None:
        """The body of a statement."""
        before = self.loop, self.breakable
        if loop:
            self.loop = self.breakable = True
        if self.t == "function":
            self.item()
        else:
            self.statement()
        self.loop, self.breakable = before

    def paren(self) -> None:
        self.eat("(")
        self.expression()
        self.eat(")")

    def s_var(self) -> None:
        self.next()
        self.declarations(False)
        self.semicolon()

    def s_if(self) -> None:
        self.next()
        self.paren()
        self.nested(False)
        if self.has("else"):
            self.nested(False)

    def s_for(self) -> None:
        self.next()
        waits = self.asynchronous and self.word("await")
        if waits:
            self.next()
        self.eat("(")
        each = False
        if self.t != ";":
            if self.t in ("var", "const") or self.word("let") and self.declares(True):
                self.next()
                n = self.declarations(False, in_for=True)
                each = self.t == "in" or self.word("of")
                if each and n != 1 and n != 101:
                    self.fail()
            else:
                kind = self.expression(False, True)
                each = self.t == "in" or self.word("of")
                if each:
                    if kind not in TARGETS and kind not in PATTERNS:
                        self.fail()
                    self.cover = None
                else:
                    self.settled()
        if each:
            of = self.t == "id"
            self.next()
            if of:
                self.assignment()
            else:
                self.expression()
        else:
            if waits:
                self.fail()
            self.eat(";")
            if self.t != ";":
                self.expression()
            self.eat(";")
            if self.t != ")":
                self.expression()
        self.eat(")")
        self.nested(True)

    def s_while(self) -> None:
        self.next()
        self.paren()
        self.nested(True)

    def s_with(self) -> None:
        self.next()
        self.paren()
        self.nested(False)

    def s_do(self) -> None:
        self.next()
        self.nested(True)
        self.eat("while")
        self.paren()
        self.has(";")

    def s_jump(self) -> None:
        loop = self.t == "continue"
        self.next()
        if self.t == "id" and not self.newline:
            if self.v not in self.labels:
                self.fail()
            self.next()
        elif not (self.loop if loop else self.breakable):
            self.fail()
        self.semicolon()

    def s_return(self) -> None:
        if not self.function:
            self.fail()
        self.next()
        if self.t not in (";", "}", "end") and not self.newline:
            self.expression()
        self.semicolon()

    def s_throw(self) -> None:
        self.next()
        if self.newline:
            self.fail()
        self.expression()
        self.semicolon()

    def s_try(self) -> None:
        self.next()
        self.block()
        n = 0
        if self.has("catch"):
            n = 1
            if self.has("("):
                self.binding()
                self.eat(")")
            self.block()
        if self.has("finally"):
            n = 1
            self.block()
        if not n:
            self.fail()

    def s_switch(self) -> None:
        self.next()
        self.paren()
        self.eat("{")
        before, self.breakable = self.breakable, True
        defaults = 0
        while self.t != "}":
            if self.has("default"):
                defaults += 1
                if defaults > 1:
                    self.fail()
            else:
                self.eat("case")
                self.expression()
            self.eat(":")
            while self.t not in ("case", "default", "}"):
                if self.t == "end":
                    self.fail()
                self.item()
        self.next()
        self.breakable = before

    def s_debugger(self) -> None:
        self.next()
        self.semicolon()

    # functions and classes
    def function_rest(self, named: bool, star: bool, asynchronous: bool) -> None:
        """After `function`, `*`: the name, parameters and body."""
        if named or self.t == "id":
            if self.t != "id":
                self.fail()
            self.next()
        self.eat("(")
        self.parameters_and_body(star, asynchronous)

    def parameters_and_body(self, star: bool, asynchronous: bool) -> None:
        state = self.enter(star, asynchronous)
        while self.t != ")":
            rest = self.has("...")
            self.binding()
            if not rest and self.has("="):
                self.assignment()
            if rest or not self.has(","):
                break
        self.eat(")")
        self.body(state)

    def enter(self, star: bool, asynchronous: bool):
        state = self.function, self.loop, self.breakable, self.generator, self.asynchronous, self.labels, self.cover
        self.function, self.loop, self.breakable, self.generator, self.asynchronous, self.labels, self.cover = True, False, False, star, asynchronous, [], None
        return state

    def leave(self, state) -> None:
        self.function, self.loop, self.breakable, self.generator, self.asynchronous, self.labels, self.cover = state

    def body(self, state) -> None:
        self.eat("{")
        while self.t != "}":
            if self.t == "end":
                self.fail()
            self.item()
        self.leave(state)
        self.next()

    def class_rest(self, named: bool) -> None:
        if self.t == "id":
            self.next()
        elif named:
            self.fail()
        if self.has("extends"):
            self.left_side()
        self.eat("{")
        while self.t != "}":
            if self.has(";"):
                continue
            if self.word("static") and self.peek()[0] not in ("(", "=", ";", "}"):
                self.next()
                if self.t == "{":
                    state = self.enter(False, False)
                    self.function = False
                    self.body(state)
                    continue
            self.method_or_field()
        self.next()

    def method_or_field(self) -> None:
        star = asynchronous = accessor = False
        if self.word("async") and self.peek()[0] not in ("(", "=", ";", "}") and not self.peek()[1]:
            self.next()
            asynchronous = True
        if self.has("*"):
            star = True
        elif (self.word("get") or self.word("set")) and self.peek()[0] not in ("(", "=", ";", "}"):
            self.next()
            accessor = True
        self.key()
        if self.t == "(":
            self.next()
            self.parameters_and_body(star, asynchronous)
            return
        if star or asynchronous or accessor:
            self.fail()
        if self.has("="):
            state = self.enter(False, False)
            self.function = False
            self.assignment()
            self.leave(state)
        self.semicolon()

    # expressions: each gives the kind of what it read
    def settled(self) -> None:
        if self.cover is not None:
            raise SyntaxFault(f"pattern at {self.cover}")

    def expression(self, allow_in: bool = True, keep_cover: bool = False) -> str:
        kind = self.assignment(allow_in, keep_cover)
        while self.t == ",":
            self.next()
            self.assignment(allow_in)
            kind = "other"
        return kind

    def assignment(self, allow_in: bool = True, keep_cover: bool = False) -> str:
        before, self.cover = self.cover, None
        kind = self.assignment_inner(allow_in)
        if self.cover is not None and not keep_cover:
            self.settled()
        if self.cover is None:
            self.cover = before
        return kind

    def assignment_inner(self, allow_in: bool) -> str:
        if self.t == "id":
            v = self.v
            if v == "yield" and self.generator:
                self.next()
                if not self.newline:
                    if self.has("*"):
                        self.assignment(allow_in)
                    elif self.t not in (")", "]", "}", ",", ";", ":", "end", "in") and not self.word("of"):
                        self.assignment(allow_in)
                return "other"
            if v == "async":
                nxt, newline = self.peek()
                if not newline and nxt == "function":
                    pass
                elif not newline and re.match(r"[^\W\d]|\$", nxt) and nxt not in ("in", "instanceof", "of"):
                    self.next()
                    self.next()
                    if self.t != "=>" or self.newline:
                        self.fail()
                    return self.arrow(True, allow_in)
            nxt = self.peek()
            if nxt == ("=>", False):
                self.name()
                return self.arrow(False, allow_in)
        kind = self.conditional(allow_in)
        if self.t == "=>":
            if kind not in ("arguments", "async call") or self.newline:
                self.fail()
            self.cover = None
            return self.arrow(kind == "async call", allow_in)
        if kind == "arguments":
            self.fail()
        if self.t in ASSIGN:
            if self.t == "=" and kind in PATTERNS:
                self.cover = None
            elif kind not in TARGETS:
                self.fail()
            self.next()
            self.assignment(allow_in)
            return "other"
        return kind

    def arrow(self, asynchronous: bool, allow_in: bool) -> str:
        """At `=>`."""
        state = self.enter(False, asynchronous)
        self.next()
        if self.t == "{":
            self.body(state)
        else:
            self.function = state[0]
            self.assignment(allow_in)
            self.leave(state)
        return "function"

    def conditional(self, allow_in: bool) -> str:
        kind = self.binary(allow_in)
        if self.t == "?":
            if kind == "arguments":
                self.fail()
            self.next()
            self.assignment()
            self.eat(":")
            self.assignment(allow_in)
            return "other"
        return kind

    def binary(self, allow_in: bool) -> str:
        if self.t == "private":
            self.next()
            if self.t != "in":
                self.fail()
            kind = "other"
        else:
            kind = self.unary()
        while self.t in BINARY and (allow_in or self.t != "in"):
            if kind in ("arguments", "function"):
                self.fail()
            self.next()
            kind = self.unary()
            if kind == "arguments":
                self.fail()
            kind = "other"
        return kind

    def unary(self) -> str:
        t = self.t
        if t in ("!", "~", "+", "-", "typeof", "void", "delete") or t == "id" and self.v == "await" and self.asynchronous:
            self.next()
            if self.unary() == "arguments":
                self.fail()
            return "other"
        if t in ("++", "--"):
            self.next()
            if self.unary() not in TARGETS:
                self.fail()
            return "other"
        kind = self.left_side()
        if self.t in ("++", "--") and not self.newline:
            if kind not in TARGETS:
                self.fail()
            self.next()
            return "other"
        return kind

    def arguments(self) -> None:
        self.eat("(")
        while self.t != ")":
            self.has("...")
            self.assignment()
            if self.t != ")":
                self.eat(",")
        self.next()

    def left_side(self) -> str:
        if self.t == "new":
            self.next()
            if self.has("."):
                if not (self.word("target") and self.function):
                    self.fail()
                self.next()
                kind = "other"
            else:
                if self.t == "import":
                    self.fail()
                kind = self.tail(self.left_side() if self.t == "new" else self.primary(), False)
                if self.t == "?.":
                    self.fail()
                if self.t == "(":
                    self.arguments()
                kind = "other"
            return self.tail(kind, True)
        asynchronous = self.word("async")
        kind = self.primary()
        if kind in ("arguments", "function arrow"):
            return kind
        if asynchronous and kind == "name" and self.t == "(" and not self.newline:
            before, self.cover = self.cover, None
            mark = self.start
            self.cover_parentheses()
            if self.t == "=>":
                return "async call"
            if self.cover is not None and self.cover > mark:
                self.settled()
            self.cover = before
            kind = "call"
        return self.tail(kind, True)

    def tail(self, kind: str, calls: bool) -> str:
        optional = False
        while True:
            t = self.t
            if t == ".":
                self.next()
                if self.t not in ("id", "private") and self.t not in RESERVED:
                    self.fail()
                self.next()
                kind = "member"
            elif t == "?." and calls:
                optional = True
                self.next()
                if self.t == "(":
                    self.arguments()
                elif self.t == "[":
                    continue
                elif self.t == "`":
                    self.fail()
                elif self.t in ("id", "private") or self.t in RESERVED:
                    self.next()
                else:
                    self.fail()
            elif t == "[":
                self.next()
                self.expression()
                self.eat("]")
                kind = "member"
            elif t == "(" and calls:
                if kind == "arrow":
                    return kind
                self.arguments()
                kind = "call"
            elif t == "`":
                self.template(True)
                kind = "other"
            else:
                return "other" if optional else kind

    def template(self, tagged: bool) -> None:
        """At the opening backtick."""
        pos = self.start + 1
        while True:
            m = _TEMPLATE.match(self.text, pos)
            if not m["end"]:
                raise SyntaxFault(f"template at {self.start} stays open")
            if not tagged and "\\" in m[0] and _BAD_ESCAPE.search(m[0].replace("\\\\", "")):
                raise SyntaxFault(f"escape at {pos}")
            self.pos = m.end()
            if m["end"] == "`":
                self.next()
                return
            self.next()
            self.expression()
            if self.t != "}":
                self.fail()
            pos = self.start + 1

    def regex(self) -> None:
        m = _REGEX.match(self.text, self.start)
        if not m or len(set(m[1])) != len(m[1]) or set(m[1]) - set("dgimsuyv"):
            self.fail()
        self.pos = m.end()
        self.next()

    def primary(self) -> str:
        t = self.t
        if t == "id":
            if self.v == "async" and self.peek() == ("function", False):
                self.next()
                self.next()
                star = self.has("*")
                self.function_rest(False, star, True)
                return "other"
            self.name()
            return "name"
        if t in ("num", "str", "this", "null", "true", "false"):
            self.next()
            return "other"
        if t == "function":
            self.next()
            star = self.has("*")
            self.function_rest(False, star, False)
            return "other"
        if t == "(":
            return self.parenthesised()
        if t == "{":
            self.object()
            return "object"
        if t == "[":
            self.array()
            return "array"
        if t in ("/", "/="):
            self.regex()
            return "other"
        if t == "`":
            self.template(False)
            return "other"
        if t == "class":
            self.next()
            self.class_rest(False)
            return "other"
        if t == "super":
            self.next()
            if self.t not in (".", "[", "("):
                self.fail()
            return "other"
        if t == "import":
            self.next()
            if self.t != "(":
                self.fail()
            return "other"
        self.fail()

    def cover_parentheses(self) -> tuple[str, int, bool]:
        """The inside of ( ): the kind of the last part, the number of parts, whether only parameters may look so."""
        self.eat("(")
        kind, n, only = "other", 0, False
        while self.t != ")":
            if self.t == "...":
                self.next()
                self.assignment(True, True)
                only, n = True, n + 1
                break
            kind = self.assignment(True, True)
            n += 1
            if self.t != ")":
                self.eat(",")
                only = self.t == ")"
        self.eat(")")
        return kind, n, only or n == 0

    def parenthesised(self) -> str:
        before, self.cover = self.cover, None
        kind, n, only = self.cover_parentheses()
        if self.t == "=>" and not self.newline:
            self.cover = before
            return "arguments"
        if only:
            self.fail()
        self.settled()
        self.cover = before
        return kind if n == 1 and kind in TARGETS else "other"

    def array(self) -> None:
        self.next()
        while self.t != "]":
            if self.has(","):
                continue
            self.has("...")
            self.assignment(True, True)
            if self.t != "]":
                self.eat(",")
        self.next()

    def object(self) -> None:
        self.next()
        while self.t != "}":
            if self.has("..."):
                self.assignment(True, True)
            else:
                self.property()
            if self.t != "}":
                self.eat(",")
        self.next()

    def property(self) -> None:
        star = asynchronous = accessor = False
        ends = ("(", ":", ",", "}", "=")
        if self.word("async") and self.peek()[0] not in ends and not self.peek()[1]:
            self.next()
            asynchronous = True
        if self.has("*"):
            star = True
        elif (self.word("get") or self.word("set")) and self.peek()[0] not in ends:
            self.next()
            accessor = True
        plain = self.t == "id"
        if self.t == "private":
            self.fail()
        self.key()
        if self.t == "(":
            self.next()
            return self.parameters_and_body(star, asynchronous)
        if star or asynchronous or accessor:
            self.fail()
        if self.has(":"):
            self.assignment(True, True)
        elif not plain:
            self.fail()
        elif self.t == "=":
            at = self.start
            self.next()
            self.assignment()
            if self.cover is None:
                self.cover = at
        return None


_STATEMENTS = {
    "var": _Script.s_var, "if": _Script.s_if, "for": _Script.s_for, "while": _Script.s_while, "with": _Script.s_with, "do": _Script.s_do,
    "break": _Script.s_jump, "continue": _Script.s_jump, "return": _Script.s_return, "throw": _Script.s_throw, "try": _Script.s_try,
    "switch": _Script.s_switch, "debugger": _Script.s_debugger,
}


def check_script(text: str) -> None:
    """Raises SyntaxFault unless the text is a script."""
    _Script(text).script()
