"""Object Pascal units, programs, libraries and packages."""

from __future__ import annotations

import re

from codestrata.llm.syntax.core import Fault, Kinds, LineCache, Memo, Parser

# Reserved words, then words that are reserved only in some places.
_RESERVED = (
    "and array as asm begin case class const constructor destructor dispinterface div do downto else end except exports file finalization finally for function goto if"
    " implementation in inherited initialization interface is label library mod nil not object of or packed procedure program property raise record repeat resourcestring set"
    " shl shr string then threadvar to try type unit until uses var while with xor"
)
_PLACED = (
    "private protected public published strict automated read write readonly writeonly default stored index implements nodefault dispid forward external virtual override overload reintroduce"
    " dynamic cdecl stdcall register pascal safecall export far near assembler message absolute deprecated platform experimental reference helper sealed abstract operator static out package requires contains"
    " on at name local inline varargs final unsafe resident delayed dependency winapi"
)
K = Kinds(f"{_RESERVED} {_PLACED}", ":= <> <= >= .. + - * / = < > ( ) [ ] , ; : . @ ^", True)
_TOKEN = re.compile(
    r"(?P<w>&?[^\W\d]\w*)|[ \t\r\n﻿\x00\x1a]+|//[^\n]*|(?P<d>\{\$[^}]*\}|\(\*\$.*?\*\))|\{[^}]*\}|\(\*.*?\*\)|(?P<s>(?:'(?:[^'\r\n]|'')*'|\#\$?[0-9A-Fa-f]+|\^[A-Z](?='))+)"
    r"|(?P<n>\$[0-9A-Fa-f]+|%[01]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)|(?P<o>:=|<>|<=|>=|\.\.|[-+*/=<>()\[\],;:.@^])",
    re.S,
)
(BEGIN, END, CASE, TRY, ASM, RECORD, CLASS, OBJECT, INTERFACE, IMPLEMENTATION, INITIALIZATION, FINALIZATION, USES, UNIT, PROGRAM, LIBRARY, CONST, TYPE, VAR, THREADVAR, RESOURCESTRING, LABEL, PROCEDURE, FUNCTION, CONSTRUCTOR, DESTRUCTOR, PROPERTY, EXPORTS, IF, THEN, ELSE, FOR, TO, DOWNTO, DO, WHILE, REPEAT, UNTIL, WITH, RAISE, GOTO, EXCEPT, FINALLY, OF, IN, IS, AS, NOT, NIL, INHERITED, ARRAY, SET, FILE, STRING, PACKED, DISPINTERFACE) = (
    K[w] for w in "begin end case try asm record class object interface implementation initialization finalization uses unit program library const type var threadvar resourcestring label procedure function constructor destructor property exports if then else for to downto do while repeat until with raise goto except finally of in is as not nil inherited array set file string packed dispinterface".split()
)
PACKAGE, REQUIRES, CONTAINS, ON, AT, OUT, HELPER, REFERENCE, ABSOLUTE, FORWARD, EXTERNAL, OPERATOR, STRICT, NAME, MESSAGE, DISPID, DEFAULT, INDEX, STORED, IMPLEMENTS, INLINE = (
    K[w] for w in "package requires contains on at out helper reference absolute forward external operator strict name message dispid default index stored implements inline".split()
)
_ID = frozenset("i") | K.set(_PLACED)
_MEMBER = _ID | K.set(_RESERVED)
_VISIBLE = K.set("private protected public published automated")
_PLAIN_DIRECTIVE = K.set("virtual override overload reintroduce dynamic cdecl stdcall register pascal safecall export far near assembler deprecated platform experimental abstract static inline varargs final unsafe resident local library winapi delayed sealed")
_SPECIFIER, _BARE_SPECIFIER, _HINT = K.set("read write stored index default implements dispid"), K.set("nodefault readonly writeonly"), K.set("deprecated platform experimental library")
_ROUTINE = K.set("procedure function constructor destructor")
_BINARY = {**{K[o]: 1 for o in "= <> < > <= >= in is".split()}, **{K[o]: 2 for o in "+ - or xor".split()}, **{K[o]: 3 for o in "* / div mod and shl shr as".split()}}
ASSIGN, DOTDOT = K[":="], K[".."]
_OPENERS = re.compile(f"[{BEGIN}{CASE}{TRY}{END}]")
_DIRECTIVE = re.compile(r"(?:\{|\(\*)\$\s*(\w+)")


_IF, _ELSE, _ENDIF = "\x01", "\x02", "\x03"
_CONDITIONAL = {"ifdef": _IF, "ifndef": _IF, "if": _IF, "ifopt": _IF, "else": _ELSE, "elseif": _ELSE, "endif": _ENDIF, "ifend": _ENDIF}


def raw_tokens(text: str) -> tuple[str, list[int], tuple[int, str] | None]:
    """Kind string and offsets with marks for conditional directives; asm bodies are dropped."""
    out: list[str] = []
    at: list[int] = []
    pos, n, words, marks, match = 0, len(text), K.word, K.mark, _TOKEN.match
    while pos < n:
        m = match(text, pos)
        if m is None:
            return "".join(out), at, (pos, "text that is no token")
        g = m.lastgroup
        if g is not None:
            if g == "d":
                d = _DIRECTIVE.match(m[0])
                k = _CONDITIONAL.get(d[1].lower()) if d else None
                if k is None:
                    pos = m.end()
                    continue
            elif g == "w":
                k = words.get(m[0].lower(), "i")
                if out and out[-1] == "." and k not in _ID and k != END:
                    k = "i"
                if k == ASM:
                    e = _ASM_END.search(text, m.end())
                    if e is None:
                        return "".join(out), at, (pos, "asm without end")
                    out.append(BEGIN)
                    at.append(pos)
                    pos = e.start()
                    continue
            elif g == "o":
                k = marks[m[0]]
            else:
                k = g
            out.append(k)
            at.append(pos)
        pos = m.end()
    return "".join(out), at, None


_ASM_END = re.compile(r"(?i)\bend\b")


def hidden(ks: str, other: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]], bool]:
    """Spans that a choice of conditional branches leaves out, spans of ELSE branches, and whether all were closed.

    Of every conditional the first branch is chosen, or with ``other`` the last one.
    """
    out: list[tuple[int, int]] = []
    behind: list[tuple[int, int]] = []
    stack: list[list[int]] = []

    def close(places: list[int], end: int) -> None:
        if len(places) > 1:
            behind.append((places[1], end))
            out.append((places[0], places[-1]) if other else (places[1], end))

    for m in _MARKS.finditer(ks):
        if m[0] == _IF:
            stack.append([m.start()])
        elif stack and m[0] == _ELSE:
            stack[-1].append(m.start())
        elif stack:
            close(stack.pop(), m.start())
    closed = not stack
    while stack:
        close(stack.pop(), len(ks))
    return sorted(out), behind, closed


def resolve(ks: str, at: list[int] | None, other: bool = False) -> tuple[str, list[int], bool]:
    """The kinds with one branch of every conditional; the last result tells whether all were closed."""
    if _IF not in ks and _ELSE not in ks and _ENDIF not in ks:
        return ks, at or [], True
    gaps, _, closed = hidden(ks, other)
    gaps = sorted(gaps + [m.span() for m in _MARKS.finditer(ks)])
    kept: list[str] = []
    places: list[int] = []
    start = 0
    for a, b in [*gaps, (len(ks), len(ks))]:
        if a > start:
            kept.append(ks[start:a])
            if at:
                places += at[start:a]
        start = max(start, b)
    return "".join(kept), places, closed


_MARKS = re.compile("[\x01\x02\x03]")


def else_faults(ks: str, at: list[int]) -> list[tuple[int, str]]:
    """Faults inside ELSE branches, found by a second parse that takes the last branch of every conditional."""
    _, behind, _ = hidden(ks, True)
    spans = [(at[a], at[b] if b < len(at) else float("inf")) for a, b in behind]
    other, places, _ = resolve(ks, at, True)
    p = PascalParser(other)
    p.file()
    found = [(places[a], m) for a, m in p.faults if a < len(places)]
    return [(x, m) for x, m in found if any(a <= x < b for a, b in spans)]


_LINES = LineCache(raw_tokens, ("(*",), ("}", "*)"))
_MEMO = Memo()
#: Blocks of more tokens are parsed without being looked up.
MEMO_TOKENS = 1000


class PascalParser(Parser):
    kinds = K
    __slots__ = ("ends",)

    def file(self) -> None:
        ks = self.ks
        try:
            k = ks[self.p]
            if k == UNIT:
                self.unit()
            elif k == LIBRARY or k == PROGRAM or k == PACKAGE:
                self.p += 1
                self.qualified()
                if self.accept("("):
                    self.names()
                    self.need(")")
                self.hints()
                self.need(";")
                if k == PACKAGE:
                    self.package()
                else:
                    self.program()
            else:
                self.fail("unit or program")
        except Fault as f:
            self.recover(f)

    def hints(self) -> None:
        while self.ks[self.p] in _PLAIN_DIRECTIVE:
            self.p += 1
            self.accept("s")

    def unit(self) -> None:
        self.p += 1
        self.qualified()
        self.hints()
        self.need(";")
        self.need(INTERFACE)
        self.uses()
        self.declarations(False)
        self.need(IMPLEMENTATION)
        self.uses()
        self.declarations(True)
        if self.accept(INITIALIZATION):
            self.statements()
            if self.accept(FINALIZATION):
                self.statements()
            self.need(END)
        elif self.ks[self.p] == BEGIN:
            self.compound()
        else:
            self.need(END)
        self.finish()

    def finish(self) -> None:
        self.need(".")  # the language ends here; what follows is ignored

    def program(self) -> None:
        self.uses()
        self.declarations(True)
        if self.accept(END):
            return self.finish()
        self.compound()
        self.finish()

    def package(self) -> None:
        for word in (REQUIRES, CONTAINS):
            if self.accept(word):
                self.used()
        self.need(END)
        self.finish()

    def uses(self) -> None:
        if self.accept(USES):
            self.used()

    def used(self) -> None:
        while True:
            self.qualified()
            if self.accept(IN):
                self.need("s")
            if not self.accept(","):
                break
        self.need(";")

    def recover(self, f: Fault) -> None:
        """Panic mode: note the fault, skip to the next routine or section and parse on from there."""
        stop = _ROUTINE | K.set("type const var implementation initialization finalization")
        while True:
            self.faults.append((f.at, f.message))
            self.p = max(self.p, f.at)
            while self.ks[self.p] != "\0" and not (self.ks[self.p] in stop and self.ks[self.p - 1] == ";"):
                self.p += 1
            if self.ks[self.p] == "\0":
                return
            try:
                if self.accept(IMPLEMENTATION):
                    self.uses()
                if self.ks[self.p] in K.set("initialization finalization"):
                    return
                self.declarations(True)
                if self.ks[self.p] in (END, BEGIN, INITIALIZATION, "\0"):
                    return
                self.fail("declaration")
            except Fault as again:
                f = again
                if self.ks[self.p] != "\0":
                    self.p += 1

    def name(self) -> None:
        if self.ks[self.p] not in _ID:
            self.fail("name")
        self.p += 1

    def names(self) -> None:
        self.name()
        while self.accept(","):
            self.name()

    def qualified(self) -> None:
        self.name()
        while self.accept("."):
            if self.ks[self.p] not in _MEMBER:
                self.fail("name")
            self.p += 1

    # declarations -------------------------------------------------------------------------------
    def declarations(self, bodies: bool) -> None:
        ks = self.ks
        while True:
            k = ks[self.p]
            if k == "[":
                self.attributes()
            elif k == CONST or k == RESOURCESTRING:
                self.p += 1
                self.section(self.constant)
            elif k == TYPE:
                self.p += 1
                self.section(self.type_declaration)
            elif k == VAR or k == THREADVAR:
                self.p += 1
                self.section(self.variable)
            elif k == LABEL:
                self.p += 1
                self.label()
                while self.accept(","):
                    self.label()
                self.need(";")
            elif k == EXPORTS:
                self.p += 1
                while True:
                    self.qualified()
                    while ks[self.p] in (NAME, INDEX):
                        self.p += 1
                        self.expression()
                    if not self.accept(","):
                        break
                self.need(";")
            elif k in _ROUTINE:
                self.routine(bodies)
            elif k == CLASS:
                self.p += 1
                if ks[self.p] == VAR:
                    continue
                self.routine(bodies)
            elif k == USES:
                self.uses()
            else:
                return

    def label(self) -> None:
        if self.ks[self.p] != "n":
            self.name()
        else:
            self.p += 1

    def section(self, one) -> None:
        if self.ks[self.p] == "[":
            self.attributes()
        if self.ks[self.p] not in _ID:
            self.fail("name")
        while self.ks[self.p] in _ID or self.ks[self.p] == "[":
            if self.ks[self.p] == "[":
                self.attributes()
                continue
            one()
            self.need(";")

    def attributes(self) -> None:
        self.need("[")
        while not self.accept("]"):
            if self.ks[self.p] == "\0":
                self.fail("]")
            self.expression()
            self.accept(",")

    def constant(self) -> None:
        self.name()
        if self.accept(":"):
            self.type_()
        self.need("=")
        self.initial()
        self.hints()

    def initial(self) -> None:
        """A value, or nested lists and records of values in brackets."""
        ks = self.ks
        if ks[self.p] == "(":
            key = None
            end = ks.find(")", self.p)
            if end > 0 and ks.find("(", self.p + 1, end) < 0:
                key = (1, ks[self.p : end + 1])
                if _MEMO.get(key):
                    self.p = end + 1
                    if ks[self.p] in ";),":
                        return
                    self.p = end + 1 - len(key[1])
            mark = self.p
            try:
                self.expression()
                if ks[self.p] in ";),":
                    return
            except Fault:
                pass
            self.p = mark + 1
            while not self.accept(")"):
                if ks[self.p] in _ID and ks[self.p + 1] == ":":
                    self.p += 2
                self.initial()
                if ks[self.p] != ")" and not self.accept(";"):
                    self.need(",")
                    if ks[self.p] == ")":
                        self.fail("value")
            if key and self.p == end + 1:
                _MEMO.put(key, True)
        else:
            self.expression()

    def variable(self) -> None:
        self.names()
        self.need(":")
        self.type_()
        if self.accept(ABSOLUTE):
            self.expression()
        elif self.accept("="):
            self.initial()
        self.hints()

    def type_declaration(self) -> None:
        self.name()
        if self.accept("<"):
            self.generic_parameters()
        self.need("=")
        self.accept(TYPE)
        self.type_()
        self.hints()

    def generic_parameters(self) -> None:
        while True:
            self.names()
            if self.accept(":"):
                while True:
                    if self.ks[self.p] in (CLASS, RECORD, CONSTRUCTOR):
                        self.p += 1
                    else:
                        self.type_name()
                    if not self.accept(","):
                        break
            if not (self.accept(";") or self.accept(",")):
                break
        self.need(">")

    def type_name(self) -> None:
        if self.ks[self.p] == STRING or self.ks[self.p] == FILE:
            self.p += 1
            return
        self.qualified()
        if self.ks[self.p] == "<":
            mark = self.p
            try:
                self.p += 1
                self.type_()
                while self.accept(","):
                    self.type_()
                self.need(">")
                if self.accept("."):
                    self.type_name()
            except Fault:
                self.p = mark

    def type_(self) -> None:
        ks = self.ks
        self.accept(PACKED)
        k = ks[self.p]
        if k == "^":
            self.p += 1
            self.type_()
        elif k == ARRAY:
            self.p += 1
            if self.accept("["):
                self.range()
                while self.accept(","):
                    self.range()
                self.need("]")
            self.need(OF)
            if not self.accept(CONST):
                self.type_()
        elif k == SET:
            self.p += 1
            self.need(OF)
            self.type_()
        elif k == FILE:
            self.p += 1
            if self.accept(OF):
                self.type_()
        elif k == STRING:
            self.p += 1
            if self.accept("["):
                self.expression()
                self.need("]")
        elif k == RECORD:
            self.p += 1
            if self.accept(HELPER):
                self.need(K["for"])
                self.type_name()
            self.members(True)
        elif k == CLASS or k == OBJECT:
            self.class_()
        elif k == INTERFACE or k == DISPINTERFACE:
            self.p += 1
            if ks[self.p] != ";":
                if self.accept("("):
                    self.type_name()
                    self.need(")")
                if ks[self.p] != ";":
                    if ks[self.p] == "[" and ks[self.p + 1] == "s":
                        self.p += 2
                        self.need("]")
                    self.members(False)
        elif k == PROCEDURE or k == FUNCTION:
            self.routine_type()
        elif k == REFERENCE and ks[self.p + 1] == TO:
            self.p += 2
            self.routine_type()
        elif k == "(":
            self.p += 1
            while True:
                self.name()
                if self.accept("="):
                    self.expression()
                if not self.accept(","):
                    break
            self.need(")")
        elif k in _ID:
            mark = self.p
            self.type_name()
            if ks[self.p] in (DOTDOT, "(", "+", "-", "*"):
                self.p = mark
                self.range()
        else:
            self.range()

    def range(self) -> None:
        if self.ks[self.p] in (STRING,):
            self.p += 1
            return
        self.simple_expression()
        if self.accept(DOTDOT):
            self.simple_expression()

    def routine_type(self) -> None:
        function = self.ks[self.p] == FUNCTION
        self.p += 1
        if self.ks[self.p] == "(":
            self.parameters()
        if function:
            self.need(":")
            self.type_()
        if self.accept(OF):
            self.need(OBJECT)
        while self.ks[self.p] in _PLAIN_DIRECTIVE or self.ks[self.p] == ";" and self.ks[self.p + 1] in _PLAIN_DIRECTIVE and self.ks[self.p + 2] == ";":
            self.p += 1

    def class_(self) -> None:
        ks = self.ks
        self.p += 1
        if ks[self.p] == OF:
            self.p += 1
            self.type_name()
            return
        if ks[self.p] == ";":
            return
        if ks[self.p] == HELPER:
            self.p += 1
            if self.accept("("):
                self.type_name()
                self.need(")")
            self.need(K["for"])
            self.type_name()
        else:
            while ks[self.p] in K.set("sealed abstract"):
                self.p += 1
            if self.accept("("):
                self.type_name()
                while self.accept(","):
                    self.type_name()
                self.need(")")
                if ks[self.p] == ";":
                    return
        self.members(False)

    def members(self, record: bool) -> None:
        ks = self.ks
        while True:
            k = ks[self.p]
            if k == END:
                self.p += 1
                break
            if k == STRICT and ks[self.p + 1] in _VISIBLE or k in _VISIBLE and ks[self.p + 1] not in (":", ","):
                self.p += 1 + (k == STRICT)
            elif k == "[":
                self.attributes()
            elif k in _ROUTINE:
                self.heading()
            elif k == CLASS:
                self.p += 1
                if ks[self.p] == OPERATOR:
                    self.heading()
            elif k == PROPERTY:
                self.property()
            elif k == CONST:
                self.p += 1
                self.section_members(self.constant)
            elif k == TYPE:
                self.p += 1
                self.section_members(self.type_declaration)
            elif k == VAR or k == THREADVAR:
                self.p += 1
            elif k == CASE and record:
                self.variant()
            elif k in _ID:
                self.names()
                self.need(":")
                self.type_()
                self.hints()
                if ks[self.p] != END:
                    self.need(";")
            else:
                self.fail("member or end")

    def section_members(self, one) -> None:
        while self.ks[self.p] in _ID and self.ks[self.p] not in _VISIBLE and self.ks[self.p] != STRICT:
            one()
            self.need(";")

    def variant(self) -> None:
        self.p += 1
        if self.ks[self.p + 1] == ":":
            self.p += 2
        self.type_name()
        self.need(OF)
        while self.ks[self.p] not in (END, ")"):
            self.range()
            while self.accept(","):
                self.range()
            self.need(":")
            self.need("(")
            while not self.accept(")"):
                if self.ks[self.p] == CASE:
                    self.variant()
                    continue
                self.names()
                self.need(":")
                self.type_()
                if self.ks[self.p] != ")":
                    self.need(";")
            if self.ks[self.p] not in (END, ")"):
                self.need(";")

    def property(self) -> None:
        ks = self.ks
        self.p += 1
        self.name()
        if ks[self.p] == "[":
            self.parameters("]")
        if self.accept(":"):
            self.type_name()
        while ks[self.p] != ";":
            k = ks[self.p]
            if k in _SPECIFIER:
                self.p += 1
                if k != DEFAULT or ks[self.p] != ";":
                    self.expression()
                    while k == IMPLEMENTS and self.accept(","):
                        self.type_name()
            elif k in _BARE_SPECIFIER:
                self.p += 1
            else:
                self.fail("property specifier")
        self.p += 1
        if ks[self.p] == DEFAULT and ks[self.p + 1] == ";":
            self.p += 2
        self.after_hints()

    def after_hints(self) -> None:
        while self.ks[self.p] in _HINT and self.ks[self.p + 1] in ";s":
            self.p += 1
            self.accept("s")
            self.need(";")

    def parameters(self, close: str = ")") -> None:
        ks = self.ks
        self.p += 1
        if self.accept(close):
            return
        while True:
            while ks[self.p] == "[":
                self.attributes()
            if ks[self.p] in (VAR, CONST) or ks[self.p] == OUT and ks[self.p + 1] in _ID:
                self.p += 1
            self.names()
            if self.accept(":"):
                self.type_()
                if self.accept("="):
                    self.expression()
            if not self.accept(";"):
                break
        self.need(close)

    def heading(self) -> bool:
        """A routine's head with its directives; true if a body cannot follow (forward, external)."""
        ks = self.ks
        k = ks[self.p]
        self.p += 1
        self.qualified_generic(k == OPERATOR)
        if ks[self.p] == "(":
            self.parameters()
        if k == FUNCTION or k == OPERATOR:
            if self.accept(":"):
                self.type_()
            elif ks[self.p] not in ";=":
                self.fail(":")
        elif ks[self.p] == ":":
            self.fail(";")
        if self.accept("="):
            self.qualified()
        bodiless = False
        if ks[self.p] in _PLAIN_DIRECTIVE or ks[self.p] in (EXTERNAL, FORWARD):
            pass
        else:
            self.need(";")
        while True:
            d = ks[self.p]
            if d in _PLAIN_DIRECTIVE and not (d == LIBRARY and ks[self.p + 1] != ";"):
                self.p += 1
                self.accept("s")
            elif d == FORWARD:
                self.p += 1
                bodiless = True
            elif d == EXTERNAL:
                self.p += 1
                bodiless = True
                if ks[self.p] != ";" and ks[self.p] not in K.set("name index delayed"):
                    self.expression()
                while ks[self.p] in K.set("name index delayed dependency"):
                    self.p += 1
                    if ks[self.p] not in ";":
                        self.expression()
            elif d in (MESSAGE, DISPID) and ks[self.p + 1] not in (":", ","):
                self.p += 1
                self.expression()
            else:
                return bodiless
            self.need(";")

    def qualified_generic(self, operator: bool) -> None:
        if operator and self.ks[self.p] in K.set("in"):
            self.p += 1
            return
        while True:
            if self.ks[self.p] not in _ID:
                self.fail("routine name")
            self.p += 1
            if self.ks[self.p] == "<":
                self.p += 1
                self.generic_parameters()
            if not self.accept("."):
                return

    def routine(self, bodies: bool) -> None:
        if self.heading() or not bodies:
            return
        self.declarations(True)
        self.compound()
        self.need(";")

    # statements ---------------------------------------------------------------------------------
    def compound(self) -> None:
        """begin … end, remembered by its kinds."""
        ks = self.ks
        if ks[self.p] != BEGIN:
            self.fail("begin")
        depth, end = 0, -1
        for m in _OPENERS.finditer(ks, self.p, self.p + MEMO_TOKENS):
            depth += -1 if m[0] == END else 1
            if depth == 0:
                end = m.end()
                break
        key = ks[self.p : end] if end > 0 else None
        if key is not None and _MEMO.get(key):
            self.p = end
            return
        self.p += 1
        self.statements()
        self.need(END)
        if key is not None and self.p == end:
            _MEMO.put(key, True)

    def statements(self) -> None:
        while True:
            self.statement()
            if not self.accept(";"):
                return

    def statement(self) -> None:
        ks = self.ks
        k = ks[self.p]
        if k in _ID or k == "n":
            if ks[self.p + 1] == ":" :
                self.p += 2
                return self.statement()
            if k == "n":
                self.fail("statement")
            self.simple()
        elif k == BEGIN:
            self.compound()
        elif k == IF:
            self.p += 1
            self.expression()
            self.need(THEN)
            self.statement()
            if self.accept(ELSE):
                self.statement()
        elif k == FOR:
            self.p += 1
            if self.accept(VAR):
                self.name()
                if self.accept(":"):
                    self.type_()
            else:
                self.designator()
            if self.accept(IN):
                self.expression()
            else:
                self.need(ASSIGN)
                self.expression()
                if not self.accept(TO):
                    self.need(DOWNTO)
                self.expression()
            self.need(DO)
            self.inner()
        elif k == WHILE:
            self.p += 1
            self.expression()
            self.need(DO)
            self.inner()
        elif k == REPEAT:
            self.p += 1
            self.statements()
            self.need(UNTIL)
            self.expression()
        elif k == CASE:
            self.case()
        elif k == TRY:
            self.try_()
        elif k == WITH:
            self.p += 1
            self.expression()
            while self.accept(","):
                self.expression()
            self.need(DO)
            self.inner()
        elif k == RAISE:
            self.p += 1
            if ks[self.p] not in (";", END, ELSE):
                self.expression()
                if self.accept(AT):
                    self.expression()
        elif k == GOTO:
            self.p += 1
            self.label()
        elif k == VAR or k == CONST:
            self.p += 1
            self.names()
            if self.accept(":"):
                self.type_()
            if not self.accept(ASSIGN):
                if k == CONST:
                    self.need("=")
                else:
                    return
            self.expression()
        elif k == INHERITED or k in "(@" or k == STRING:
            self.simple()
        # otherwise the empty statement

    def inner(self) -> None:
        self.statement()

    def simple(self) -> None:
        ks = self.ks
        start = self.p
        self.designator()
        if self.accept(ASSIGN):
            self.expression()
        elif ks[self.p] not in (";", END, ELSE, UNTIL, EXCEPT, FINALLY, FINALIZATION, "\0"):
            self.fail(":= or ;")
        elif ks[self.p - 1] == "]" and ks[start] != INHERITED:
            self.fail(":=")

    def case(self) -> None:
        ks = self.ks
        self.p += 1
        self.expression()
        self.need(OF)
        while ks[self.p] not in (END, ELSE):
            self.range()
            while self.accept(","):
                self.range()
            self.need(":")
            self.statement()
            if ks[self.p] not in (END, ELSE):
                self.need(";")
        if self.accept(ELSE):
            self.statements()
        self.need(END)

    def try_(self) -> None:
        ks = self.ks
        self.p += 1
        self.statements()
        if self.accept(FINALLY):
            self.statements()
        else:
            self.need(EXCEPT)
            if ks[self.p] == ON and ks[self.p + 1] in _ID:
                while self.accept(ON):
                    if ks[self.p + 1] == ":":
                        self.p += 2
                    self.type_name()
                    self.need(DO)
                    self.statement()
                    if not self.accept(";"):
                        break
                if self.accept(ELSE):
                    self.statements()
            else:
                self.statements()
        self.need(END)

    # expressions --------------------------------------------------------------------------------
    def expression(self, least: int = 1) -> None:
        """Precedence climbing."""
        self.unary()
        prec = _BINARY.get(self.ks[self.p], 0)
        while prec >= least:
            k = self.ks[self.p]
            self.p += 1
            if k == IS or k == IN:
                self.accept(NOT)
            self.expression(prec + 1)
            prec = _BINARY.get(self.ks[self.p], 0)

    def simple_expression(self) -> None:
        self.expression(2)

    def unary(self) -> None:
        ks = self.ks
        while ks[self.p] in ("+", "-", NOT, "@"):
            self.p += 1
        k = ks[self.p]
        if k == "n" or k == NIL:
            self.p += 1
        elif k == "s":
            self.p += 1
            while ks[self.p] == "." and ks[self.p + 1] in _ID:
                self.suffixes()
            if ks[self.p] == "[":
                self.suffixes()
        elif k == "[":
            self.p += 1
            while not self.accept("]"):
                self.range()
                if ks[self.p] != "]":
                    self.need(",")
                    if ks[self.p] == "]":
                        self.fail("value")
            self.suffixes()
        elif k == PROCEDURE or k == FUNCTION:
            self.p += 1
            if ks[self.p] == "(":
                self.parameters()
            if k == FUNCTION:
                self.need(":")
                self.type_()
            self.declarations(True)
            self.compound()
        elif k == IF:
            self.p += 1
            self.expression()
            self.need(THEN)
            self.expression()
            self.need(ELSE)
            self.expression()
        else:
            self.designator()

    def designator(self) -> None:
        ks = self.ks
        k = ks[self.p]
        if k == INHERITED:
            self.p += 1
            if ks[self.p] in _ID:
                self.p += 1
        elif k in _ID or k == STRING or k == FILE:
            self.p += 1
        elif k == "(":
            self.p += 1
            self.expression()
            self.need(")")
        elif k == "@":
            self.p += 1
            return self.designator()
        else:
            self.fail("expression")
        self.suffixes()

    def suffixes(self) -> None:
        ks = self.ks
        while True:
            k = ks[self.p]
            if k == ".":
                self.p += 1
                if ks[self.p] not in _ID:
                    self.fail("name")
                self.p += 1
            elif k == "^":
                self.p += 1
            elif k == "(":
                self.p += 1
                if not self.accept(")"):
                    while True:
                        if ks[self.p] not in (",", ")"):
                            self.expression()
                            if ks[self.p] == ASSIGN:
                                self.p += 1
                                self.expression()
                            while self.accept(":"):
                                self.expression()
                        if not self.accept(","):
                            break
                        if ks[self.p] == ")":
                            self.fail("argument")
                    self.need(")")
            elif k == "[":
                self.p += 1
                self.range()
                while self.accept(","):
                    self.range()
                self.need("]")
            elif k == "<" and self.generic_arguments():
                continue
            else:
                return

    def generic_arguments(self) -> bool:
        """``<Type, …>`` where a call or member follows; otherwise the mark is a comparison."""
        mark = self.p
        try:
            self.p += 1
            self.type_name()
            while self.accept(","):
                self.type_name()
            self.need(">")
            if self.ks[self.p] in "(.;)":
                return True
        except Fault:
            pass
        self.p = mark
        return False


def faults(text: str) -> list[tuple[int, str]]:
    """``(offset, message)`` of every fault, in order of the text."""
    quick = _LINES.kinds(text)
    if quick is not None and _ELSE not in quick:
        quick, _, closed = resolve(quick, None)
        p = PascalParser(quick)
        p.file()
        if closed and not p.faults:
            return []
    raw, raw_at, lexical = raw_tokens(text)
    ks, at, closed = resolve(raw, raw_at)
    if not closed:
        lexical = lexical or (len(text), "conditional without end")
    p = PascalParser(ks)
    p.file()
    out = [(at[a] if a < len(at) else len(text), m) for a, m in p.faults]
    if _ELSE in raw:
        out = sorted({*out, *else_faults(raw, raw_at)})
    if lexical:
        if not p.faults and p.ks[p.p - 1 : p.p] == "." and p.p <= len(at) and p.p > 1:
            return []  # behind the final "end." anything may stand
        out = [x for x in out if x[0] < lexical[0] and x[0] < len(text)] + [lexical]
    return out
