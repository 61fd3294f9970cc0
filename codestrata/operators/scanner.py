"""Words and marks of source lines and SQL statements: what the row generators read instead of raw text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from typing import NamedTuple

_LINE = re.compile(r"\r?\n")
_PLAIN = re.compile(r"[^\W\d][\w$]*|\d[\w.]*|:=|[^\s\w]")
_SQL = re.compile(r"(?P<w>[A-Za-z_][\w$]*)|(?P<s>'(?:''|[^'])*')|(?P<q>\"(?:\"\"|[^\"])*\"|`(?:``|[^`])*`|\[[^\]]+\])|(?P<n>\d[\w.]*)|(?P<m>\|\||\S)")


class Token(NamedTuple):
    kind: str  # w word, s string, q quoted name, n number, m mark
    text: str
    start: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower()


def lines_of(text: str) -> list[str]:
    return _LINE.split(text)


class LineNumbers:
    """1-based line numbers of offsets, by bisection."""

    def __init__(self, text: str):
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def of(self, offset: int) -> int:
        return bisect_right(self.breaks, offset - 1) + 1


def first_word(line: str) -> str:
    """The word a line begins with, in lower case; '' if it begins with a mark."""
    m = _PLAIN.search(line)
    return m[0].lower() if m and (m[0][0].isalpha() or m[0][0] == "_") and not line[: m.start()].strip() else ""


def plain(line: str) -> list[Token]:
    """Words and marks of one line; quotes are marks like any, as the generators judge line by line."""
    return [Token("w" if m[0][0].isalpha() or m[0][0] == "_" else "n" if m[0][0].isdigit() else "m", m[0], m.start(), m.end()) for m in _PLAIN.finditer(line)]


def sql_scan(text: str, start: int = 0) -> Iterator[Token]:
    for m in _SQL.finditer(text, start):
        yield Token(m.lastgroup or "m", m[0], m.start(), m.end())


def sql_tokens(text: str) -> list[Token]:
    return list(sql_scan(text))


def unquoted(name: str) -> str:
    """A name without its quotes or brackets."""
    s = name.strip()
    return s[1:-1].strip() if s[:1] == "[" and s[-1:] == "]" else s.strip("\"'`").strip()


def is_word(t: Token, *words: str) -> bool:
    return t.kind == "w" and t.low in words


def dotted_name(tokens: Sequence[Token], i: int) -> tuple[list[str], int]:
    """Parts of the name at ``i`` and the place behind it; no parts if there is no name."""
    parts: list[str] = []
    while i < len(tokens) and tokens[i].kind in "wq":
        parts.append(unquoted(tokens[i].text))
        i += 1
        if i + 1 < len(tokens) and tokens[i].text == "." and tokens[i + 1].kind in "wq":
            i += 1
        else:
            break
    return parts, i


def matching(tokens: Sequence[Token], i: int) -> int:
    """The place of the bracket that closes the one at ``i``; -1 if none does."""
    depth = 0
    for j in range(i, len(tokens)):
        if tokens[j].text == "(":
            depth += 1
        elif tokens[j].text == ")":
            depth -= 1
            if depth == 0:
                return j
    return -1


def comma_parts(tokens: Sequence[Token]) -> Iterator[Sequence[Token]]:
    """The parts between commas outside brackets; empty ones are left out."""
    depth, start = 0, 0
    for i, t in enumerate(tokens):
        if t.text == "(":
            depth += 1
        elif t.text == ")":
            depth = max(0, depth - 1)
        elif t.text == "," and not depth:
            if i > start:
                yield tokens[start:i]
            start = i + 1
    if start < len(tokens):
        yield tokens[start:]


def before_word(tokens: Sequence[Token], *words: str) -> Sequence[Token]:
    """The tokens in front of the first of the words."""
    return tokens[: next((i for i, t in enumerate(tokens) if is_word(t, *words)), len(tokens))]


def source(text: str, tokens: Sequence[Token]) -> str:
    """The text from the first token to the last."""
    return text[tokens[0].start : tokens[-1].end] if tokens else ""
