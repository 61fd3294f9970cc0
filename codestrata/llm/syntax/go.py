"""Go source files."""

from __future__ import annotations

import re

from codestrata.llm.syntax.core import Fault, Kinds, LineCache, Memo, Parser

# Keywords and operators of the language.
K = Kinds(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "&^= <<= >>= ... &^ << >> && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= + - * / % & | ^ < > = ! ( ) [ ] { } , . : ~",
    False,
)
_TOKEN = re.compile(
    r"(?P<w>[^\W\d]\w*)|(?P<nl>\n)|[ \t\r]+|//[^\n]*|(?P<c>/\*.*?\*/)|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`)|(?P<r>'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"
    r"|(?P<n>0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)"
    r"|(?P<o>&\^=|<<=|>>=|\.\.\.|&\^|<<|>>|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[-+*/%&|^]=|[-+*/%&|^<>=!()\[\]{},.:~])|(?P<semi>;)",
    re.S,
)
_ENDS = frozenset("ins)]}") | K.set("break continue fallthrough return ++ --")
_ESC = re.compile(r"\\(?![abfnrtv\\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})")


def tokens(text: str) -> tuple[str, list[int], tuple[int, str] | None]:
    """Kind string, offsets, and the first lexical fault; semicolons are put in by the language's rule."""
    out: list[str] = []
    at: list[int] = []
    last, pos, n = "", 0, len(text)
    word, mark, match, ends = K.word, K.mark, _TOKEN.match, _ENDS
    if text.startswith("﻿"):
        pos = 1
    while pos < n:
        m = match(text, pos)
        if m is None:
            return "".join(out), at, (pos, "text that is no token")
        g = m.lastgroup
        if g is None:
            pos = m.end()
            continue
        if g == "w":
            k = word.get(m[0], "i")
        elif g == "nl" or g == "c":
            if (g == "nl" or "\n" in m[0]) and last in ends and last:
                k = ";"
            else:
                pos = m.end()
                continue
        elif g == "o":
            k = mark[m[0]]
        elif g == "semi":
            k = ";"
        elif g == "s":
            k = "s"
            if m[0][0] == '"' and "\\" in m[0] and _ESC.search(m[0].replace("\\\\", "")):
                return "".join(out), at, (pos, "unknown escape")
        elif g == "n":
            k = "n"
        else:
            k = "n"
        out.append(k)
        at.append(pos)
        last = k
        pos = m.end()
    if last in ends and last:
        out.append(";")
        at.append(n)
    return "".join(out), at, None


_MEMO = Memo()
_BINARY = {K["||"]: 1, K["&&"]: 2, **{K[o]: 3 for o in "== != < <= > >=".split()}, **{K[o]: 4 for o in "+ - | ^".split()}, **{K[o]: 5 for o in "* / % << >> & &^".split()}}
_UNARY = K.set("+ - ! ^ * & <- ~")
_ASSIGN = K.set("= := += -= *= /= %= &= |= ^= <<= >>= &^=")
_TYPE_START = frozenset("i*[(") | K.set("struct func interface map chan <-")
_DECL = K.set("const type var func import")
(CASE, CHAN, CONST, DEFAULT, DEFER, ELSE, FOR, FUNC, GO, GOTO, IF, IMPORT, INTERFACE, MAP, PACKAGE, RANGE, RETURN, SELECT, STRUCT, SWITCH, TYPE, VAR) = (
    K[w] for w in "case chan const default defer else for func go goto if import interface map package range return select struct switch type var".split()
)
BREAK, CONTINUE, FALL, ARROW, DOTS, DEFINE, INC, DEC = (K[w] for w in ("break", "continue", "fallthrough", "<-", "...", ":=", "++", "--"))


class GoParser(Parser):
    kinds = K
    __slots__ = ("level",)

    def file(self) -> None:
        self.level = 0
        try:
            self.need(PACKAGE)
            self.need("i")
            self.need(";")
            while self.ks[self.p] == IMPORT:
                self.p += 1
                self.group(self.import_spec)
                self.need(";")
        except Fault as f:
            self.recover(f)
        while self.ks[self.p] != "\0":
            start = self.p
            end = self.chunk_end()
            key = self.ks[start:end]
            got = _MEMO.get(key)
            if got is None:
                sub = GoParser(key)
                sub.level = 0
                sub.declarations()
                got = tuple(sub.faults)
                _MEMO.put(key, got)
            self.faults += [(start + a, m) for a, m in got]
            self.p = end

    def chunk_end(self) -> int:
        """The next declaration word that follows a semicolon outside all brackets."""
        ks, depth, i = self.ks, 0, self.p + 1
        while True:
            k = ks[i]
            if k == "\0":
                return i
            if k in "({[":
                depth += 1
            elif k in ")}]":
                depth -= 1
            elif depth == 0 and k in _DECL and ks[i - 1] == ";":
                return i
            i += 1

    def declarations(self) -> None:
        while self.ks[self.p] != "\0":
            try:
                if self.accept(";"):
                    continue
                self.declaration(True)
                if self.ks[self.p] != "\0":
                    self.need(";")
            except Fault as f:
                self.recover(f)

    def recover(self, f: Fault) -> None:
        """Panic mode: skip to a declaration word behind a semicolon."""
        self.faults.append((f.at, f.message))
        self.level = 0
        self.p = max(self.p, f.at)
        if self.ks[self.p] != "\0":
            self.p += 1
        while self.ks[self.p] != "\0" and not (self.ks[self.p] in _DECL and self.ks[self.p - 1] == ";"):
            self.p += 1

    def declaration(self, top: bool) -> None:
        k = self.ks[self.p]
        self.p += 1
        if k == CONST:
            self.group(self.const_spec)
        elif k == VAR:
            self.group(self.var_spec)
        elif k == TYPE:
            self.group(self.type_spec)
        elif k == FUNC and top:
            if self.ks[self.p] == "(":
                self.params()
            self.need("i")
            if self.ks[self.p] == "[":
                self.type_params()
            self.signature()
            if self.ks[self.p] == "{":
                self.block()
        else:
            self.p -= 1
            self.fail("declaration")

    def group(self, spec) -> None:
        if self.accept("("):
            while not self.accept(")"):
                spec()
                if self.ks[self.p] != ")":
                    self.need(";")
        else:
            spec()

    def import_spec(self) -> None:
        if self.ks[self.p] in "i.":
            self.p += 1
        self.need("s")

    def names(self) -> None:
        self.need("i")
        while self.accept(","):
            self.need("i")

    def const_spec(self) -> None:
        self.names()
        if self.ks[self.p] not in (";", ")", "\0"):
            if self.ks[self.p] != "=":
                self.type_()
            self.need("=")
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if self.ks[self.p] != "=":
            self.type_()
            if self.ks[self.p] != "=":
                return
        self.need("=")
        self.expressions()

    def type_spec(self) -> None:
        self.need("i")
        if self.ks[self.p] == "[" and self.ks[self.p + 1] == "i" and self.ks[self.p + 2] not in "]":
            self.type_params()
        self.accept("=")
        self.type_()

    def type_params(self) -> None:
        self.need("[")
        while not self.accept("]"):
            self.names()
            self.constraint()
            if self.ks[self.p] != "]":
                self.need(",")

    def constraint(self) -> None:
        while True:
            self.accept("~")
            self.type_()
            if not self.accept("|"):
                return

    def type_(self) -> None:
        ks = self.ks
        k = ks[self.p]
        if k == "i":
            self.p += 1
            if self.accept("."):
                self.need("i")
            if ks[self.p] == "[" and ks[self.p + 1] not in "]n":
                mark = self.p
                try:
                    self.p += 1
                    self.type_()
                    while self.accept(","):
                        self.type_()
                    self.need("]")
                except Fault:
                    self.p = mark
        elif k == "*":
            self.p += 1
            self.type_()
        elif k == "[":
            self.p += 1
            if not self.accept("]"):
                if not self.accept(DOTS):
                    self.nested(self.expression)
                self.need("]")
            self.type_()
        elif k == STRUCT:
            self.p += 1
            self.struct()
        elif k == FUNC:
            self.p += 1
            self.signature()
        elif k == INTERFACE:
            self.p += 1
            self.interface()
        elif k == MAP:
            self.p += 1
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
        elif k == CHAN:
            self.p += 1
            self.accept(ARROW)
            self.type_()
        elif k == ARROW:
            self.p += 1
            self.need(CHAN)
            self.type_()
        elif k == "(":
            self.p += 1
            self.type_()
            self.need(")")
        else:
            self.fail("type")

    def struct(self) -> None:
        self.need("{")
        ks = self.ks
        while not self.accept("}"):
            if ks[self.p] == "*" or ks[self.p] == "(":
                self.type_()
            else:
                self.need("i")
                if ks[self.p] == ".":
                    self.p += 1
                    self.need("i")
                elif ks[self.p] not in ";}s":
                    while self.accept(","):
                        self.need("i")
                    self.type_()
            self.accept("s")
            if ks[self.p] != "}":
                self.need(";")

    def interface(self) -> None:
        self.need("{")
        while not self.accept("}"):
            if self.ks[self.p] == "i" and self.ks[self.p + 1] == "(":
                self.p += 1
                self.signature()
            else:
                self.constraint()
            if self.ks[self.p] != "}":
                self.need(";")

    def signature(self) -> None:
        self.params()
        k = self.ks[self.p]
        if k == "(":
            self.params()
        elif k in _TYPE_START:
            self.type_()

    def params(self) -> None:
        self.need("(")
        ks, plain, named = self.ks, 0, 0
        while not self.accept(")"):
            if ks[self.p] == DOTS:
                self.p += 1
                self.type_()
                plain += 1
            else:
                start = self.p
                self.type_()
                if ks[self.p] not in ",)":
                    if not (start + 1 == self.p and ks[start] == "i") and not ks[start] == "i":
                        self.fail(", or )")
                    self.accept(DOTS)
                    self.type_()
                    named += 1
                elif not (start + 1 == self.p and ks[start] == "i"):
                    plain += 1
            if ks[self.p] != ")":
                self.need(",")
        if named and plain:
            self.p -= 1
            self.fail("parameter names")

    def nested(self, production) -> None:
        outer, self.level = self.level, 0
        production()
        self.level = outer

    def block(self) -> None:
        self.need("{")
        outer, self.level = self.level, 0
        self.statements()
        self.level = outer
        self.need("}")

    def statements(self) -> None:
        ks = self.ks
        while True:
            k = ks[self.p]
            if k == "}" or k == "\0" or k == CASE or k == DEFAULT:
                return
            if k == ";":
                self.p += 1
                continue
            self.statement()
            k = ks[self.p]
            if k == ";":
                self.p += 1
            elif k != "}":
                self.fail("end of statement")

    def statement(self) -> None:
        ks = self.ks
        k = ks[self.p]
        if k == "i":
            if ks[self.p + 1] == ":" :
                self.p += 2
                if ks[self.p] not in "};":
                    self.statement()
                return
            self.simple()
        elif k == RETURN:
            self.p += 1
            if ks[self.p] not in ";}":
                self.expressions()
        elif k == IF:
            self.if_()
        elif k == FOR:
            self.for_()
        elif k == SWITCH:
            self.switch()
        elif k == SELECT:
            self.p += 1
            self.cases(self.comm)
        elif k == VAR or k == CONST or k == TYPE:
            self.declaration(False)
        elif k == DEFER or k == GO:
            self.p += 1
            self.expression()
            if ks[self.p - 1] != ")":
                self.fail("call")
        elif k == BREAK or k == CONTINUE:
            self.p += 1
            self.accept("i")
        elif k == GOTO:
            self.p += 1
            self.need("i")
        elif k == FALL:
            self.p += 1
        elif k == "{":
            self.block()
        else:
            self.simple()

    def simple(self) -> None:
        start = self.p
        self.expressions()
        k = self.ks[self.p]
        if k in _ASSIGN:
            if k == DEFINE and not all(x in "i," for x in self.ks[start : self.p]):
                self.fail("names left of :=")
            self.p += 1
            if self.accept(RANGE):
                self.expression()
            else:
                self.expressions()
        elif k == INC or k == DEC:
            self.p += 1
        elif k == ARROW:
            self.p += 1
            self.expression()
        elif self.ks[self.p - 1] not in ")" and self.ks[start] != ARROW and not self.level < 0:
            self.fail("statement")  # an expression that is no call is no statement

    def header(self, loop: bool) -> None:
        """Clauses of if, for and switch; composite literals need brackets here."""
        ks = self.ks
        self.level = -1
        if ks[self.p] != "{":
            if loop and ks[self.p] == RANGE:
                self.p += 1
                self.expression()
            else:
                if ks[self.p] != ";":
                    self.simple()
                if ks[self.p] == ";":
                    self.p += 1
                    if ks[self.p] not in "{;":
                        self.simple()
                    if loop:
                        self.need(";")
                        if ks[self.p] != "{":
                            self.simple()
        self.level = 0

    def if_(self) -> None:
        self.p += 1
        if self.ks[self.p] == "{":
            self.fail("condition")
        outer = self.level
        self.header(False)
        self.block()
        self.level = outer
        if self.accept(ELSE):
            if self.ks[self.p] == IF:
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.p += 1
        outer = self.level
        self.header(True)
        self.block()
        self.level = outer

    def switch(self) -> None:
        self.p += 1
        outer = self.level
        self.header(False)
        self.cases(self.expressions_or_types)
        self.level = outer

    def cases(self, guard) -> None:
        self.need("{")
        while not self.accept("}"):
            if self.accept(CASE):
                guard()
            else:
                self.need(DEFAULT)
            self.need(":")
            self.statements()

    def comm(self) -> None:
        outer, self.level = self.level, -1
        self.simple()
        self.level = outer

    def expressions_or_types(self) -> None:
        while True:
            mark = self.p
            try:
                self.expression()
            except Fault:
                self.p = mark
                self.type_()
            if not self.accept(","):
                return

    def expressions(self) -> None:
        self.expression()
        while self.ks[self.p] == ",":
            self.p += 1
            self.expression()

    def expression(self, least: int = 1) -> None:
        """Precedence climbing."""
        self.unary()
        prec = _BINARY.get(self.ks[self.p], 0)
        while prec >= least:
            self.p += 1
            self.expression(prec + 1)
            prec = _BINARY.get(self.ks[self.p], 0)

    def unary(self) -> None:
        ks = self.ks
        while ks[self.p] in _UNARY:
            if ks[self.p] == ARROW and ks[self.p + 1] == CHAN:
                self.type_()
                return self.postfix(True)
            self.p += 1
        self.operand()

    def operand(self) -> None:
        ks = self.ks
        k = ks[self.p]
        typed = False
        if k == "i":
            self.p += 1
            typed = True
        elif k == "n" or k == "s":
            self.p += 1
        elif k == "(":
            self.p += 1
            self.nested(self.expression_or_type)
            self.need(")")
        elif k == FUNC:
            self.p += 1
            self.signature()
            if ks[self.p] == "{":
                self.block()
        elif k == "[" or k == STRUCT or k == MAP or k == CHAN or k == INTERFACE:
            self.type_()
            if ks[self.p] == "{":
                self.literal()
            elif ks[self.p] not in "(),":
                self.fail("{ or (")
        else:
            self.fail("expression")
        self.postfix(typed)

    def expression_or_type(self) -> None:
        mark = self.p
        try:
            self.expression()
        except Fault:
            self.p = mark
            self.type_()

    def postfix(self, typed: bool) -> None:
        ks = self.ks
        while True:
            k = ks[self.p]
            if k == ".":
                self.p += 1
                if self.accept("("):
                    if not self.accept(TYPE):
                        self.type_()
                    self.need(")")
                    typed = False
                else:
                    self.need("i")
            elif k == "(":
                self.p += 1
                outer, self.level = self.level, 0
                while not self.accept(")"):
                    self.expression_or_type()
                    self.accept(DOTS)
                    if ks[self.p] != ")":
                        self.need(",")
                self.level = outer
                typed = False
            elif k == "[":
                self.p += 1
                outer, self.level = self.level, 0
                if ks[self.p] != ":":
                    self.expression_or_type()
                    while self.accept(","):
                        if ks[self.p] == "]":
                            break
                        self.type_()
                for _ in range(2):
                    if self.accept(":") and ks[self.p] not in ":]":
                        self.expression()
                self.need("]")
                self.level = outer
            elif k == "{" and typed and self.level == 0:
                self.literal()
                typed = False
            else:
                return

    def literal(self) -> None:
        self.need("{")
        outer, self.level = self.level, 0
        while not self.accept("}"):
            self.element()
            if self.accept(":"):
                self.element()
            if self.ks[self.p] != "}":
                self.need(",")
        self.level = outer

    def element(self) -> None:
        if self.ks[self.p] == "{":
            self.literal()
        else:
            self.expression()


_LINES = LineCache(tokens, ("/*",), ("`", "*/"))


def faults(text: str) -> list[tuple[int, str]]:
    """``(offset, message)`` of every fault, in order of the text."""
    quick = _LINES.kinds(text)
    if quick is not None:
        p = GoParser(quick)
        p.file()
        if not p.faults:
            return []
    ks, at, lexical = tokens(text)
    p = GoParser(ks)
    p.file()
    out = [(at[a] if a < len(at) else len(text), m) for a, m in p.faults]
    if lexical:
        out = [x for x in out if x[0] < lexical[0] and x[0] < len(text)] + [lexical]
    return out
