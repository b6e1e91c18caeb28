"""Tokens of JavaScript and TypeScript sources: names, strings, the texts and the code of templates, operators.

Comments are left out. A template is a ``text`` token for each stretch of literal text, with the tokens of its fields in
between, so what is code is never taken for words and words are never taken for code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_CODE = re.compile(
    r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|(?P<string>'(?:[^'\\\n]|\\.)*'?|\"(?:[^\"\\\n]|\\.)*\"?)|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<number>\d[\w.]*)"
    r"|(?P<op>=>|\?\?|\?\.|\|\||&&|[=!]==?|[^\s\w])"
)
_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")


class Token(NamedTuple):
    kind: str  # name, string, text, number or op
    text: str  # of a string without its quotes
    at: int


def tokens(source: str) -> Iterator[Token]:
    at, fields = 0, []  # for each open template field, how many braces are open in it
    in_text = False
    while at < len(source):
        if in_text:
            m = _TEXT.match(source, at)
            if m[0]:
                yield Token("text", m[0], at)
            at = m.end()
            if source.startswith("${", at):
                fields.append(0)
                at += 2
            else:
                at += 1
            in_text = False
            continue
        m = _CODE.match(source, at)
        if source[at] == "`":
            in_text, at = True, at + 1
        elif m is None:
            at += 1
        elif m["op"] == "}" and fields and not fields[-1]:
            fields.pop()
            in_text, at = True, at + 1
        else:
            if fields and m["op"] in ("{", "}"):
                fields[-1] += 1 if m["op"] == "{" else -1
            if kind := m.lastgroup:
                text = m[0]
                yield Token(kind, text[1:-1] if kind == "string" and text[-1] == text[0] and len(text) > 1 else text[1:] if kind == "string" else text, at)
            at = m.end()


def is_value(own: list[Token], i: int) -> bool:
    """Whether the name at a place stands for its value: it is no property of something else and no key of an object."""
    before, after = own[i - 1].text if i else "", own[i + 1].text if i + 1 < len(own) else ""
    return own[i].kind == "name" and before not in (".", "?.") and not (after == ":" and before in ("{", ",", ""))


def closing(own: list[Token], i: int) -> int:
    """Where the bracket at a place is closed; the end if it is not."""
    depth = 0
    for j in range(i, len(own)):
        if own[j].kind == "op":
            depth += (own[j].text in "([{") - (own[j].text in ")]}")
            if not depth:
                return j
    return len(own)


def opening(own: list[Token], i: int) -> int:
    """Where the innermost bracket around a place is opened; -1 if there is none."""
    depth = 0
    for j in range(i - 1, -1, -1):
        if own[j].kind == "op":
            depth += (own[j].text in ")]}") - (own[j].text in "([{")
            if depth < 0:
                return j
    return -1


def fields(own: list[Token]) -> Iterator[tuple[str, int, int]]:
    """Each key of an object with the places from which and to which its value reaches."""
    for i in range(len(own) - 1):
        if own[i].kind in ("name", "string") and own[i + 1].text == ":" and own[i + 1].kind == "op" and (not i or own[i - 1].text in ("{", ",", "(")):
            j = i + 2
            while j < len(own) and not (own[j].kind == "op" and own[j].text in ",)]}"):
                j = closing(own, j) + 1 if own[j].kind == "op" and own[j].text in "([{" else j + 1
            yield own[i].text, i + 2, j
