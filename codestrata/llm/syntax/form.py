"""Form files in text: nested objects with properties."""

from __future__ import annotations

import re

from codestrata.llm.syntax.core import Fault, Kinds, LineCache, Memo, Parser

# The words of the format.
K = Kinds("object inherited inline end item true false nil", "= : . , + - ( ) [ ] < >", True)
_TOKEN = re.compile(
    r"(?P<w>[^\W\d]\w*)|[ \t\r\n﻿\x00\x1a]+|(?P<s>(?:'(?:[^'\r\n]|'')*'|\#\d+)+)|(?P<n>\$[0-9A-Fa-f]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?[sdcSDC]?)|(?P<b>\{[0-9A-Fa-f \t\r\n]*\})|(?P<o>[=:.,+\-()\[\]<>])"
)
OBJECT, INHERITED, INLINE, END, ITEM = (K[w] for w in "object inherited inline end item".split())
_HEADS = K.set("object inherited inline")
_WORD = frozenset("i") | K.set("item true false nil object inherited inline")
_MEMO = Memo()


def tokens(text: str) -> tuple[str, list[int], tuple[int, str] | None]:
    out: list[str] = []
    at: list[int] = []
    pos, n, words, match = 0, len(text), K.word, _TOKEN.match
    while pos < n:
        m = match(text, pos)
        if m is None:
            return "".join(out), at, (pos, "text that is no token")
        g = m.lastgroup
        if g is not None:
            out.append(words.get(m[0].lower(), "i") if g == "w" else m[0] if g == "o" else "s" if g == "s" else "n" if g == "n" else "c")
            at.append(pos)
        pos = m.end()
    return "".join(out), at, None


class FormParser(Parser):
    kinds = K
    __slots__ = ()

    def file(self) -> None:
        try:
            if self.ks[self.p] not in _HEADS:
                self.fail("object")
            while self.ks[self.p] in _HEADS:
                self.object()
            if self.ks[self.p] != "\0":
                self.fail("end of file")
        except Fault as f:
            self.faults.append((f.at, f.message))
            self.recover(f)

    def recover(self, f: Fault) -> None:
        """Panic mode: go on at the next object head."""
        self.p = max(self.p, f.at)
        while self.ks[self.p] != "\0":
            self.p += 1
            if self.ks[self.p] in _HEADS and self.ks[self.p + 1] == "i" and self.ks[self.p + 2] == ":":
                try:
                    self.object()
                    while self.ks[self.p] in _HEADS or self.ks[self.p] == END:
                        if not self.accept(END):
                            self.object()
                except Fault as again:
                    self.faults.append((again.at, again.message))
                    self.p = max(self.p, again.at)

    def object(self) -> None:
        ks = self.ks
        self.p += 1
        self.word()
        if self.accept(":"):
            self.word()
            while self.accept("."):
                self.word()
        if self.accept("["):
            self.need("n")
            self.need("]")
        while True:
            k = ks[self.p]
            if k in _WORD and (ks[self.p + 1] == "=" or ks[self.p + 1] == "."):
                self.property()
            elif k in _HEADS:
                self.object()
            elif k == END:
                self.p += 1
                break
            else:
                self.fail("property, object or end")

    def word(self) -> None:
        if self.ks[self.p] not in _WORD:
            self.fail("name")
        self.p += 1

    def property(self) -> None:
        self.p += 1
        while self.accept("."):
            self.word()
        self.need("=")
        self.value()

    def value(self) -> None:
        ks = self.ks
        k = ks[self.p]
        if k == "s":
            self.p += 1
            while ks[self.p] == "+":
                self.p += 1
                self.need("s")
        elif k == "n" or k == "c":
            self.p += 1
        elif k == "-" or k == "+":
            self.p += 1
            if not self.accept("n"):
                self.word()
        elif k in _WORD:
            self.p += 1
            while self.accept("."):
                self.word()
        elif k == "[":
            self.p += 1
            if not self.accept("]"):
                while True:
                    if self.ks[self.p] == "n":
                        self.p += 1
                    else:
                        self.word()
                    if not self.accept(","):
                        break
                self.need("]")
        elif k == "(":
            self.p += 1
            while not self.accept(")"):
                self.value()
        elif k == "<":
            self.p += 1
            while not self.accept(">"):
                self.need(ITEM)
                if self.accept("["):
                    self.need("n")
                    self.need("]")
                while not self.accept(END):
                    if ks[self.p] not in _WORD:
                        self.fail("property or end")
                    self.property()
        else:
            self.fail("value")


_LINES = LineCache(tokens, (), ("}",))


def faults(text: str) -> list[tuple[int, str]]:
    """``(offset, message)`` of every fault, in order of the text."""
    quick = _LINES.kinds(text)
    if quick is not None:
        if (known := _MEMO.get(quick)) is None:
            p = FormParser(quick)
            p.file()
            known = tuple(p.faults)
            _MEMO.put(quick, known)
        if not known:
            return []
    ks, at, lexical = tokens(text)
    got = _MEMO.get(ks)
    if got is None:
        p = FormParser(ks)
        p.file()
        got = tuple(p.faults)
        _MEMO.put(ks, got)
    out = [(at[a] if a < len(at) else len(text), m) for a, m in got]
    if lexical:
        out = [x for x in out if x[0] < lexical[0] and x[0] < len(text)] + [lexical]
    return out
