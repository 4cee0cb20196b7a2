"""Recognisers of Java 17, ECMAScript, XML 1.0 and JSON: they tell whether a text is in the language, and build nothing."""

from __future__ import annotations

import json
import re
import sys
from xml.parsers import expat

from wakegraph.llm.syntax.common import SyntaxFault
from wakegraph.llm.syntax.ecma import check_script
from wakegraph.llm.syntax.java import check_java

FRAMES = 150_000  # of Python, for what lies above and for short texts
FRAMES_A_LETTER = 200  # no rule goes deeper without taking a letter, so that no text reaches the limit


def check_xml(text: str) -> None:
    parser = expat.ParserCreate("utf-8")
    try:
        parser.Parse(text.encode("utf-8"), True)
    except (expat.ExpatError, UnicodeEncodeError) as e:
        raise SyntaxFault(str(e)) from None


def _no(_: str):
    raise ValueError("not JSON")


_JSON = json.JSONDecoder(parse_int=len, parse_float=len, parse_constant=_no)


def _nesting_only(text: str) -> bool:
    return len(text) > 20_000 and max(text.count("["), text.count("{")) > 500


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null)|([\[\]{},:]))')


def _check_deep_json(text: str) -> None:
    """The grammar with a stack of its own, for nesting that the standard decoder would recurse into."""
    stack: list[str] = []
    want, pos, end = "value", 0, len(text.rstrip(" \t\n\r"))
    while pos < end:
        m = _JSON_TOKEN.match(text, pos)
        if not m:
            raise SyntaxFault("not a token")
        pos = m.end()
        t = '"' if m[1] else "v" if m[2] else m[3]
        if want in ("value", "value or ]") and t in '"v[{':
            if t == "[":
                stack.append("]")
                want = "value or ]"
            elif t == "{":
                stack.append("}")
                want = "key or }"
            else:
                want = "next" if stack else "end"
        elif want in ("key", "key or }") and t == '"':
            want = "colon"
        elif want == "colon" and t == ":":
            want = "value"
        elif want == "next" and t == ",":
            want = "value" if stack[-1] == "]" else "key"
        elif (want == "next" or want == f"value or {t}" or want == f"key or {t}") and stack and t == stack[-1]:
            stack.pop()
            want = "next" if stack else "end"
        else:
            raise SyntaxFault(f"{t} where {want} was expected")
    if want != "end":
        raise SyntaxFault("ends early")


def check_json(text: str) -> None:
    if _nesting_only(text):
        return _check_deep_json(text)
    try:
        _JSON.decode(text)
    except RecursionError:
        _check_deep_json(text)
    except ValueError as e:
        raise SyntaxFault(str(e)) from None


CHECKS = {"java": check_java, "xml": check_xml, "json": check_json, "js": check_script}


def parses(language: str, text: str) -> bool:
    """Whether the whole text is in the language."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(min(2**31 - 1, max(before, FRAMES + FRAMES_A_LETTER * len(text))))
    try:
        CHECKS[language](text)
        return True
    except SyntaxFault:
        return False
    finally:
        sys.setrecursionlimit(before)
