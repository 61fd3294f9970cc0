"""SQL scripts of the common dialects.

Queries, data changes, table and view definitions, parameters, declarations, RETURN, PRINT, CALL, EXEC and
procedural blocks are parsed in full; of other statements with a known verb the order of words is free, but brackets must balance and every word
after which something must follow has to be followed by it.
"""

from __future__ import annotations

import re

from codestrata.llm.syntax.core import Fault, Kinds, LineCache, Memo, Parser

# Reserved words, then words that may also be names.
_RESERVED = (
    "select from where group having order by union intersect except join on and or not in is like between case when then else end insert into values update set delete create drop alter table"
    " as null exists using inner cross distinct"
)
_OPEN_WORDS = (
    "left right full outer natural all any some limit offset fetch first next rows row only top with recursive view procedure function trigger index database schema user login role sequence"
    " primary foreign key unique check constraint references default begin if elseif elsif while loop repeat until for return returns declare exec execute call print raise raiserror throw open close"
    " cursor do try catch leave iterate signal exit continue replace ignore merge matched truncate grant revoke deny use go commit rollback start transaction savepoint save lock unlock tables explain analyze"
    " show describe comment rename delimiter over partition escape ilike rlike regexp similar to collate at interval cast convert extract temporary temp or_replace language cascade ascending asc desc"
    " minus window filter within returning output pivot unpivot apply lateral nulls global local identified option package body perform get diagnostics handler copy vacuum optimize pragma attach detach"
    " kill prepare deallocate backup restore dbcc bulk reset install load handler_ flush checkpoint waitfor shutdown set_ add column modify change values_ inout out precision varying unsigned signed zerofill without national large constant nocopy readonly variadic qualify grouping sets"
)
K = Kinds(f"{_RESERVED} {_OPEN_WORDS}", "<=> := <> != !< !> <= >= || && :: ->> -> => ** << >> == ~* !~ += -= *= /= %= |= &= ^= .. + - * / % = < > ( ) [ ] { } , . : ? @ & | ^ ~ ! # $", True)
_TOKEN = re.compile(
    r"(?P<w>[^\W\d][\w$\#]*|(?:@@?|\#\#?|:)[^\W\d][\w$\#]*|\$\d+)|[ \t\r\n﻿\x00\x1a]+|--[^\n]*|/\*.*?\*/"
    r"|(?P<s>'(?:[^'\\]|''|\\.)*')|(?P<q>\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|\[[^\W\d][^\]\n]*\])"
    r"|(?P<n>0[xX][0-9A-Fa-f]*|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)"
    r"|(?P<o><=>|:=|<>|!=|!<|!>|<=|>=|\|\||&&|::|->>|->|=>|\*\*|<<|>>|==|~\*|!~|\.\.|[-+*/%|&^]=|[-+*/%=<>()\[\]{},.:?@&|^~!\#$])|(?P<e>;)",
    re.S,
)
(SELECT, FROM, WHERE, GROUP, HAVING, ORDER, BY, UNION, INTERSECT, EXCEPT, JOIN, ON, AND, OR, NOT, IN, IS, LIKE, BETWEEN, CASE, WHEN, THEN, ELSE, END, INSERT, INTO, VALUES, UPDATE, SET, DELETE, CREATE, DROP, ALTER, TABLE, AS, NULL, EXISTS, USING, INNER, CROSS, DISTINCT) = (K[w] for w in _RESERVED.split())
(LEFT, RIGHT, FULL, OUTER, NATURAL, ALL, LIMIT, OFFSET, FETCH, TOP, WITH, RECURSIVE, VIEW, PROCEDURE, FUNCTION, TRIGGER, INDEX, PRIMARY, FOREIGN, KEY, UNIQUE, CHECK, CONSTRAINT, REFERENCES, DEFAULT, BEGIN, IF, ELSEIF, ELSIF, WHILE, LOOP, REPEAT, UNTIL, FOR, RETURN, RETURNS, DECLARE, EXEC, EXECUTE, DO, TRY, CATCH, REPLACE, MERGE, GO, OVER, PARTITION, ESCAPE, INTERVAL, MINUS, RETURNING, OUTPUT, LATERAL, ROWS, ROW, ONLY, COLLATE, CAST, LANGUAGE, WINDOW, FILTER, TO, AT, IGNORE, OPTION, ASC, DESC, TRANSACTION, CURSOR, IDENTIFIED, HANDLER, DELIMITER, PACKAGE, BODY, COMMENT, APPLY, NULLS) = (
    K[w] for w in "left right full outer natural all limit offset fetch top with recursive view procedure function trigger index primary foreign key unique check constraint references default begin if elseif elsif while loop repeat until for return returns declare exec execute do try catch replace merge go over partition escape interval minus returning output lateral rows row only collate cast language window filter to at ignore option asc desc transaction cursor identified handler delimiter package body comment apply nulls".split()
)
QUALIFY, GROUPING, SETS, PIVOT, UNPIVOT = (K[w] for w in "qualify grouping sets pivot unpivot".split())
_MODES = K.set("in out inout variadic nocopy")
_TYPE_WORDS = K.set("precision varying unsigned signed zerofill cursor")
_ID = frozenset("iq") | K.set(_OPEN_WORDS)
_NAMEABLE = _ID | K.set("left right values set table")
_VERBS = K.set("select insert update delete create drop alter with merge exec execute declare if while begin print return set truncate grant revoke deny use raiserror throw open close fetch call")
_FREE = K.set(
    "drop alter exec execute call print raise raiserror throw open close fetch truncate grant revoke deny use commit rollback start savepoint save lock unlock explain analyze show describe comment"
    " rename do leave iterate signal exit continue perform get copy vacuum optimize pragma attach detach kill prepare deallocate backup restore dbcc bulk reset install load flush checkpoint waitfor shutdown go return"
)
_COMPARE = K.set("= <> != < > <= >= <=> == !< !> ~ ~* !~")
_BINARY = {K["or"]: 1, K["and"]: 2, K["&&"]: 2, **{k: 4 for k in _COMPARE}, **{K[o]: 5 for o in "| & ^ << >> -> ->>".split()}, **{K[o]: 6 for o in "+ - ||".split()}, **{K[o]: 7 for o in "* / % **".split()}}
_NO_ALIAS = K.set("pivot unpivot lateral qualify limit offset fetch with window for go begin if while declare exec execute print return truncate use merge minus do loop then returning output option natural left right full call open close raiserror throw commit rollback elseif elsif until grant revoke explain apply")
_NEEDS_MORE = frozenset(",(.=+-*/%<>|") | K.set("select from where by join on and or not in like between when then set into values as using update := <> != <= >= || :: create alter drop table grant to insert delete case if")
_MEMO = Memo()


def tokens(text: str) -> tuple[str, list[int], tuple[int, str] | None]:
    out: list[str] = []
    at: list[int] = []
    pos, n, words, marks, match = 0, len(text), K.word, K.mark, _TOKEN.match
    ender, begun = "", 0  # what a client command has put in place of the semicolon; where the statement began
    while pos < n:
        if ender and text.startswith(ender, pos):
            out.append(";")
            at.append(pos)
            pos += len(ender)
            continue
        m = match(text, pos)
        if m is None:
            return "".join(out), at, (pos, "text that is no token")
        g = m.lastgroup
        if g is not None:
            if g == "w":
                w = m[0].lower()
                if len(w) <= 2 and m.end() < n and text[m.end()] == "'":
                    if w in ("n", "e", "b", "x", "u", "_u"):
                        pos = m.end()
                        continue
                    if w in ("q", "nq") and m.end() + 1 < n:  # q'[…]': any mark may bracket the text
                        opening = text[m.end() + 1]
                        e = text.find(_CLOSING.get(opening, opening) + "'", m.end() + 2)
                        if e < 0:
                            return "".join(out), at, (pos, "string without end")
                        out.append("s")
                        at.append(pos)
                        pos = e + 2
                        continue
                if ender and ender in w:  # END$$
                    w = w[: w.index(ender)]
                    out.append(words.get(w, "i"))
                    at.append(pos)
                    pos += len(w)
                    continue
                k = words.get(w, "i")
                if k == DELIMITER:  # a client command: the rest of the line
                    e = text.find("\n", m.end())
                    e = n if e < 0 else e
                    ender = text[m.end() : e].strip().lower()
                    ender = "" if ender == ";" else ender
                    pos = e
                    continue
                if not out or out[-1] == ";":
                    begun = pos
            elif g == "o":
                k = marks[m[0]]
                if m[0] == "$" and text.startswith("$$", pos):
                    e = text.find("$$", pos + 2)
                    if e < 0:
                        return "".join(out), at, (pos, "$$ without end")
                    out.append("s")
                    at.append(pos)
                    pos = e + 2
                    continue
                if m[0] == "/" and text[max(0, text.rfind("\n", 0, pos)) : pos].strip() == "" and re.match(r"/[ \t\r]*(?:\n|$)", text[pos : pos + 40]):
                    k = ";"
                if m[0] == "#":
                    e = text.find("\n", pos)
                    pos = n if e < 0 else e
                    continue
            else:
                k = {"s": "s", "q": "q", "n": "n", "e": ";"}[g]
                if g == "e" and _COPY.fullmatch(text, begun, pos):  # rows of data up to a line of \\.
                    e = _COPY_END.search(text, pos)
                    if e is None:
                        return "".join(out), at, (pos, "data without end")
                    out.append(k)
                    at.append(pos)
                    pos = e.end()
                    continue
            out.append(k)
            at.append(pos)
        pos = m.end()
    return "".join(out), at, None


_CLOSING = {"[": "]", "{": "}", "(": ")", "<": ">"}
_COPY = re.compile(r"(?is)copy\b.*\bfrom\s+stdin\b.*")
_COPY_END = re.compile(r"(?m)^\\\.[ \t]*\r?$")
#: Texts whose lines cannot be tokenised one by one.
_WHOLE = re.compile(r"(?i)\bdelimiter\b|\bstdin\b|\bn?q'")


class SqlParser(Parser):
    kinds = K
    __slots__ = ()

    def file(self) -> None:
        ks = self.ks
        while ks[self.p] != "\0":
            if ks[self.p] == ";" or ks[self.p] == GO:
                self.p += 1
                continue
            try:
                self.statement()
                self.ended()
            except Fault as f:
                # panic mode: the next statement begins behind the next semicolon
                self.faults.append((f.at, f.message))
                self.p = max(self.p, f.at)
                while ks[self.p] not in ";\0":
                    self.p += 1

    def ended(self) -> None:
        k = self.ks[self.p]
        if k == ";":
            self.p += 1
        elif k != "\0" and k != GO and k not in _VERBS and k not in _FREE:
            self.fail("end of statement")

    # statements ---------------------------------------------------------------------------------
    def statement(self) -> None:
        ks = self.ks
        k = ks[self.p]
        if k in (SELECT, INSERT, UPDATE, DELETE, WITH, REPLACE, "(", VALUES, MERGE):
            end = ks.find(";", self.p)
            key = ks[self.p : end] if end > 0 else None
            if key is not None and _MEMO.get(key):
                self.p = end
            else:
                start = self.p
                self.data(k)
                if key is not None and self.p == end and end - start < 5000:
                    _MEMO.put(key, True)
        elif k == CREATE or k == ALTER and ks[self.p + 1] in (PROCEDURE, FUNCTION, TRIGGER, VIEW):
            self.create()
        elif k == BEGIN:
            if ks[self.p + 1] in (TRANSACTION, ";", "\0") or ks[self.p + 1] == "i" and ks[self.p + 2] in ";\0":
                self.p += 1
                if ks[self.p] not in ";\0":
                    self.p += 1
            else:
                self.block()
        elif k == IF and ks[self.p + 1] != "(" or k == IF:
            self.if_()
        elif k == WHILE:
            self.p += 1
            self.expression()
            if self.accept(LOOP) or self.accept(DO):
                self.until_end(K["loop"], WHILE)
            else:
                self.statement()
        elif k == LOOP or k == FOR:
            if k == FOR:
                while ks[self.p] not in (LOOP, DO, ";", "\0"):
                    self.p += 1
            self.p += 1
            self.until_end(LOOP, FOR)
        elif k == REPEAT:
            self.p += 1
            self.statements((UNTIL,))
            self.need(UNTIL)
            self.expression()
            self.need(END)
            self.need(REPEAT)
        elif k == CASE:
            self.case_statement()
        elif k == DECLARE:
            self.declare()
        elif k == SET:
            self.set_()
        elif k in _FREE:
            self.free()
        elif k == NULL:
            self.p += 1
        elif k == "i" and ks[self.p + 1] == ":" and ks[self.p + 2] in (LOOP, WHILE, REPEAT, BEGIN):
            self.p += 2
            self.statement()
        elif k == "i" and ks[self.p + 1] == K[":="]:
            self.p += 2
            self.expression()
        else:
            self.fail("statement")

    def data(self, k: str) -> None:
        if k == WITH:
            self.ctes()
            k = self.ks[self.p]
        if k in (SELECT, "(", VALUES):
            self.query()
        elif k == INSERT or k == REPLACE:
            self.insert()
        elif k == UPDATE:
            self.update()
        elif k == DELETE:
            self.delete()
        elif k == MERGE:
            self.p += 1
            self.balanced()
        else:
            self.fail("query")

    def statements(self, stops: tuple[str, ...]) -> None:
        ks = self.ks
        while True:
            k = ks[self.p]
            if k == ";":
                self.p += 1
            elif k in stops:
                return
            elif k == "\0":
                self.fail("end")
            else:
                self.statement()
                if ks[self.p] not in stops:
                    self.ended()

    def block(self) -> None:
        ks = self.ks
        self.need(BEGIN)
        suffix = None
        if ks[self.p] in (TRY, CATCH):
            suffix = ks[self.p]
            self.p += 1
        self.statements((END,))
        self.need(END)
        if suffix:
            self.accept(suffix)
        elif ks[self.p] == "i" or ks[self.p] == "q":
            self.p += 1

    def if_(self) -> None:
        ks = self.ks
        self.p += 1
        self.expression()
        if self.accept(THEN):
            self.statements((ELSE, ELSEIF, ELSIF, END))
            while ks[self.p] in (ELSEIF, ELSIF):
                self.p += 1
                self.expression()
                self.need(THEN)
                self.statements((ELSE, ELSEIF, ELSIF, END))
            if self.accept(ELSE):
                self.statements((END,))
            self.need(END)
            self.need(IF)
        else:
            self.statement()
            if ks[self.p] == ELSE or ks[self.p] == ";" and ks[self.p + 1] == ELSE:
                self.p += 1 + (ks[self.p] == ";")
                self.statement()

    def until_end(self, *words: str) -> None:
        self.statements((END,))
        self.need(END)
        if self.ks[self.p] in words:
            self.p += 1
        if self.ks[self.p] == "i":
            self.p += 1

    def case_statement(self) -> None:
        self.p += 1
        if self.ks[self.p] != WHEN:
            self.expression()
        while self.accept(WHEN):
            self.expression()
            self.need(THEN)
            self.statements((WHEN, ELSE, END))
        if self.accept(ELSE):
            self.statements((END,))
        self.need(END)
        self.need(CASE)

    def declare(self) -> None:
        ks = self.ks
        self.p += 1
        handler = ks.find(HANDLER, self.p, self.p + 3)
        if handler > 0:
            self.p = handler + 1
            while ks[self.p] not in (BEGIN, SET, SELECT, INSERT, UPDATE, DELETE, ";", "\0") and ks[self.p] not in _FREE:
                self.p += 1
            self.statement()
            return
        if ks[self.p] not in _NAMEABLE:
            self.fail("name")
        self.declaration()
        while self.accept(","):
            self.declaration()
        while ks[self.p] == ";" and ks[self.p + 1] == "i" and (ks[self.p + 2] in ("i", K["constant"]) or ks[self.p + 2] == CURSOR):
            self.p += 1  # the other declarations of an anonymous block
            self.declaration()

    def declaration(self) -> None:
        """Names, a type and a value; a cursor and its query; of conditions and named types the order is free."""
        ks = self.ks
        if ks[self.p] == CURSOR and ks[self.p + 1] in _NAMEABLE:
            self.p += 2
            if ks[self.p] == "(":
                self.parameters()
            if self.accept(RETURN):
                self.type()
            if ks[self.p] == ";":
                return
            self.need(IS)
            self.query()
            return
        if ks[self.p] not in _NAMEABLE:
            self.fail("name")
        if ks[self.p] == K["pragma"] or ks[self.p] in (PROCEDURE, FUNCTION) or ks[self.p] == "i" and ks[self.p + 2] == IS:
            self.balanced()
            return
        self.p += 1
        while ks[self.p] == "," and ks[self.p + 1] in _NAMEABLE:
            self.p += 2
        end = self.p
        while ks[end] in _ID and ks[end] != CURSOR:
            end += 1
        if ks[end] == CURSOR:
            self.p = end + 1
            while ks[self.p] in _ID and ks[self.p] != FOR:
                self.p += 1
            if ks[self.p] == "(":
                self.parameters()
            if self.accept(FOR) or self.accept(IS):
                if ks[self.p] in (SELECT, WITH, "(", VALUES):
                    self.query()
                else:
                    self.name()
            return
        if ks[self.p] == "i" and ks[self.p + 1] == FOR:
            self.balanced()
            return
        self.accept(AS)
        self.accept(K["constant"])
        if ks[self.p] == TABLE and ks[self.p + 1] == "(":
            self.p += 1
            self.columns()
            return
        self.type()
        self.value()

    def value(self) -> None:
        """What may follow the type of a variable or parameter."""
        if self.accept(NOT):
            self.need(NULL)
        else:
            self.accept(NULL)
        if self.accept(K[":="]) or self.accept("=") or self.accept(DEFAULT):
            self.expression()

    def type(self) -> None:
        ks = self.ks
        first = ks[self.p]
        if first not in _NAMEABLE or first in (AS, DEFAULT):
            self.fail("type")
        self.p += 1
        if first == K["national"] and ks[self.p] in _ID:
            self.p += 1
        while ks[self.p] == ".":
            self.p += 1
            if ks[self.p] not in _NAMEABLE:
                self.fail("name")
            self.p += 1
        while True:
            k = ks[self.p]
            if k == "(":
                self.group()
            elif k in _TYPE_WORDS:
                self.p += 1
            elif k == K["large"] or k == "%":
                self.p += 1
                if ks[self.p] not in _ID:
                    self.fail("type")
                self.p += 1
            elif k in (WITH, K["without"]) and ks[self.p + 1] == "i" and ks[self.p + 2] == "i":
                self.p += 3
            elif k == WITH and ks[self.p + 1] == K["local"]:
                self.p += 4
            elif k == "i" and ks[self.p + 1] == SET:
                self.p += 3
            elif k == COLLATE:
                self.p += 1
                self.name()
            elif k == "[":
                self.p += 1
                self.accept("n")
                self.need("]")
            elif first == INTERVAL and (k == "i" or k == TO):
                self.p += 1
            else:
                return

    def parameters(self) -> int:
        """Parameters in brackets; the place of the first that is one word only, or -1."""
        self.need("(")
        bare = -1
        if self.accept(")"):
            return bare
        while True:
            at = self.parameter()
            bare = at if bare < 0 else bare
            if not self.accept(","):
                break
        self.need(")")
        return bare

    def parameter(self) -> int:
        """Modes, a name, a type and a value; some dialects leave out the name. The place if it is one word only, or -1."""
        ks = self.ks
        while ks[self.p] in _MODES and ks[self.p + 1] not in (",", ")"):
            self.p += 1
        start = self.p
        if ks[start] not in _NAMEABLE:
            self.fail("parameter")
        if ks[start + 1] in (",", ")", "=", DEFAULT, K[":="], AS) and not (ks[start + 1] == AS and ks[start + 2] in _NAMEABLE and ks[start + 3] in ",()="):
            self.p += 1
            self.value()
            return start
        if ks[start + 1] in _NAMEABLE or ks[start + 1] in (AS, IN):
            self.p += 1
            self.accept(AS)
            while ks[self.p] in _MODES:
                self.p += 1
        self.type()
        self.value()
        while ks[self.p] in K.set("out output readonly"):
            self.p += 1
        return -1

    def set_(self) -> None:
        ks = self.ks
        self.p += 1
        if ks[self.p + 1] in ("=", K[":="], TO, ".", K["+="], K["-="]):
            while True:
                self.name()
                if ks[self.p] not in ("=", K[":="], TO, K["+="], K["-="], K["*="], K["/="], K["|="]):
                    self.fail("=")
                self.p += 1
                if ks[self.p] in (ON, DEFAULT):
                    self.p += 1
                else:
                    self.expression()
                    while ks[self.p] == ",":  # search paths
                        if ks[self.p + 2] in ("=", K[":="], "."):
                            break
                        self.p += 1
                        self.expression()
                if not self.accept(","):
                    return
        words = 0
        while ks[self.p] in _NAMEABLE or ks[self.p] in ("s", "n", ON, "=", ",", ".", IN, NOT, AS):
            self.p += 1
            words += 1
        if words < 2:
            self.fail("setting")

    def free(self) -> None:
        """A statement of free form."""
        ks, start = self.ks, self.p
        k = ks[start]
        self.p += 1
        if k in (EXEC, EXECUTE) and ks[self.p] in ";\0":
            self.fail("name")
        if k == RETURN or k == K["print"]:
            if k == RETURN and (ks[self.p] in (";", "\0", END, ELSE, GO) or ks[self.p] in _VERBS and ks[self.p] not in (SELECT, WITH)):
                return
            if ks[self.p] in (SELECT, WITH):
                self.query()
                return
            if not (ks[self.p] == "i" and ks[self.p + 1] in (SELECT, WITH, EXECUTE)):  # RETURN QUERY
                self.expression()
                return
        elif k == K["call"]:
            self.name()
            if ks[self.p] == "(":
                self.call()
            return
        elif k in (EXEC, EXECUTE) and ks[self.p] in _ID and ks[self.p] not in (PROCEDURE, FUNCTION, AS):
            if ks[self.p + 1] == "=":
                self.p += 2
            self.name()
            if ks[self.p] == "(":
                self.call()
            elif ks[self.p] in _ARGUMENT:
                while True:
                    if not self.accept(DEFAULT):
                        self.expression()
                    if not self.accept(OUTPUT):
                        self.accept(K["out"])
                    if not self.accept(","):
                        break
            if ks[self.p] in (INTO, USING, WITH, AT, RETURNING):
                self.balanced()
            return
        elif k == ALTER and ks[self.p] == TABLE:
            self.p += 1
            self.if_exists()
            self.accept(ONLY)
            self.name()
            if ks[self.p] == K["add"] and ks[self.p + 1] not in (PARTITION, "("):
                self.p += 1
                self.accept(K["column"])
                if ks[self.p] == IF:
                    self.if_exists()
                self.column()
        self.balanced(start)

    def balanced(self, start: int = -1) -> None:
        """Words and marks up to the end of the statement, brackets balanced, not ending in mid-phrase."""
        ks = self.ks
        depth, first = 0, self.p if start < 0 else start
        while True:
            k = ks[self.p]
            if k == "(":
                depth += 1
            elif k == ")":
                depth -= 1
                if depth < 0:
                    self.fail("end of statement")
            elif k == "\0" or k == ";" and depth == 0 or k == GO:
                break
            elif k in "<>" and ks[self.p + 1] in "<>=" and ks[self.p + 1] == k or k == "=" and ks[self.p + 1] == K["=="]:
                self.fail("expression")
            elif depth == 0 and self.p > first + 1 and start >= 0 and k in _VERBS and ks[first] not in K.set("grant revoke deny explain alter show lock comment do prepare bulk drop copy") and ks[self.p - 1] not in (K["for"], ON):
                break
            elif depth == 0 and k == END:
                break
            elif k == K["=="] or k == K["<<"] and ks[self.p + 1] == K["<<"]:
                self.fail("expression")
            self.p += 1
        if depth or ks[self.p - 1] in _NEEDS_MORE and ks[self.p - 1] != ON:
            self.fail("rest of statement")

    # definitions --------------------------------------------------------------------------------
    def create(self) -> None:
        ks = self.ks
        self.p += 1
        if self.accept(OR):
            if not self.accept(REPLACE):
                self.need(ALTER)
        for _ in range(12):
            k = ks[self.p]
            if k in (TABLE, VIEW, PROCEDURE, FUNCTION, TRIGGER, INDEX, PACKAGE) or k in ";\0(":
                break
            self.p += 1
        k = ks[self.p]
        if k == TABLE:
            self.p += 1
            self.if_exists()
            self.name()
            self.table()
        elif k == VIEW:
            self.p += 1
            self.if_exists()
            self.name()
            if ks[self.p] == "(":
                self.group()  # names, in some dialects with comments
            if self.accept(WITH):
                self.p += 1
                while self.accept(","):
                    self.p += 1
            self.need(AS)
            self.accept(BEGIN)
            if ks[self.p] == WITH:
                self.ctes()
            self.query()
            if self.accept(WITH):
                self.balanced()
        elif k == PROCEDURE or k == FUNCTION or k == TRIGGER or k == PACKAGE:
            self.p += 1
            self.accept(BODY)
            self.if_exists()
            self.name()
            self.routine(k)
        elif k == INDEX:
            self.p += 1
            self.if_exists()
            if ks[self.p] != ON:
                self.name()
            self.need(ON)
            self.accept(ONLY)
            self.name()
            if self.accept(USING):
                self.p += 1
            if ks[self.p] != "(":
                self.fail("(")
            self.group()
            self.balanced()
        else:
            self.balanced()  # users, roles, sequences and the like
            if self.p < 3 or ks[self.p - 1] == CREATE:
                self.fail("object")

    def if_exists(self) -> None:
        if self.accept(IF):
            self.accept(NOT)
            self.need(EXISTS)

    def routine(self, kind: str) -> None:
        """Parameters, options in free form, then the body: a block, AS statements, one statement, or a quoted body."""
        ks = self.ks
        depth, bare = 0, -1
        if kind in (PROCEDURE, FUNCTION):
            if ks[self.p] == "(":
                bare = self.parameters()
            elif kind == PROCEDURE and ks[self.p] == "i":
                bare = self.parameter()
                while self.accept(","):
                    at = self.parameter()
                    bare = at if bare < 0 else bare
                if ks[self.p] == "i":
                    self.fail(", or body")
        while True:
            k = ks[self.p]
            if k == "(":
                depth += 1
            elif k == ")":
                depth -= 1
                if depth < 0:
                    self.fail("body")
            elif k == "\0" or k in _MARKS:
                self.fail("body")
            elif depth == 0:
                if k == ";":
                    if kind == FUNCTION:  # external or SQL-body functions end here
                        return
                    self.fail("body")
                if k == RETURN and kind == FUNCTION:  # the type of the result, where IS and declarations follow
                    end = self.p + 1
                    while ks[end] in _NAMEABLE or ks[end] in ".%n" or ks[end] == "(" and ks[end + 1] == "n" or ks[end] == ")" and ks[end - 1] == "n":
                        end += 1
                    if end > self.p + 1 and ks[end] in (IS, AS) and ks[end + 1] not in (NULL, NOT, "s"):
                        self.p = end
                        continue
                if k == BEGIN or k == RETURN or k == IF:
                    break
                if k == RETURNS:
                    self.p += 1
                    if ks[self.p] == "i" and ks[self.p + 1] == TABLE:
                        self.p += 1
                    if ks[self.p] == TABLE and ks[self.p + 1] == "(":
                        self.p += 1
                    if ks[self.p] == "(" or ks[self.p - 1] == TABLE:
                        self.columns()
                    continue
                if k == AS or k == IS:
                    self.p += 1
                    if ks[self.p] == "s":
                        self.p += 1
                        self.balanced()
                        return
                    break
                if kind == TRIGGER and k in (EXECUTE, EXEC):
                    self.balanced()
                    return
                if k in (SELECT, SET, CASE, WHILE) or k in (INSERT, UPDATE, DELETE) and ks[self.p - 1] not in _TRIGGERING:
                    break
            self.p += 1
        if depth:
            self.fail(")")
        if kind == TRIGGER and self.p and ks[self.p - 1] in ";":
            self.fail("body")
        if bare >= 0 and ks[self.p] != RETURN and not (ks[self.p] == BEGIN and ks[self.p + 1] == "i"):  # types alone go with quoted bodies
            self.p = bare + 1
            self.fail("type")
        while ks[self.p] not in (BEGIN, ";", "\0") and ks[self.p] in _ID and (ks[self.p] not in _FREE or ks[self.p] == K["pragma"]) and ks[self.p] not in (IF, WHILE, DECLARE, LOOP, FOR, RETURN, WITH, REPLACE, MERGE):
            # declarations of a stored body: name type [:= value];
            self.declaration()
            self.need(";")
        if ks[self.p] in ";\0":
            self.fail("body")
        self.statement()
        if ks[self.p] not in ";\0" and ks[self.p - 1] != END:
            while ks[self.p] in _VERBS or ks[self.p] in _FREE and ks[self.p] != GO:
                self.statement()
                self.accept(";")

    def table(self) -> None:
        ks = self.ks
        k = ks[self.p]
        if k == AS or k == SELECT:
            self.accept(AS)
            self.query()
            return
        if k == LIKE:
            self.p += 1
            self.name()
            return
        if k != "(":
            self.fail("(")
        self.p += 1
        if ks[self.p] == SELECT or ks[self.p] == LIKE:
            self.balanced_inside()
        else:
            self.p -= 1
            self.columns()
        if self.accept(AS):
            self.query()
            return
        self.balanced()

    def balanced_inside(self) -> None:
        depth = 1
        while depth:
            k = self.ks[self.p]
            if k in ";\0":
                self.fail(")")
            depth += (k == "(") - (k == ")")
            self.p += 1

    def columns(self) -> None:
        self.need("(")
        while True:
            self.column()
            if not self.accept(","):
                break
        self.need(")")

    def column(self) -> None:
        """A column or a constraint: a name, then a type and options."""
        ks = self.ks
        k = ks[self.p]
        if k in (CONSTRAINT, PRIMARY, FOREIGN, UNIQUE, CHECK, KEY, INDEX, FULL, LIKE, EXCEPT) or k == "i" and ks[self.p + 1] == KEY:
            if k != CHECK:
                self.p += 1
            if ks[self.p] in ",)\0;":
                self.fail("constraint")
        else:
            if k not in _NAMEABLE:
                self.fail("column")
            self.p += 1
            if ks[self.p] not in _NAMEABLE and ks[self.p] != AS:
                self.fail("type")
            self.p += 1
        while True:
            k = ks[self.p]
            if k in ",);\0":
                break
            if k == "(":
                self.group()
            elif k in (DEFAULT, COMMENT, CHECK, REFERENCES, COLLATE, CONSTRAINT, USING):
                self.p += 1
                if ks[self.p] in ",);\0":
                    self.fail("value")
                if k == DEFAULT:
                    self.expression(5)
                elif k == CHECK and ks[self.p] == "(":
                    self.condition()
            elif k in _NAMEABLE or k in "sn" or k in (NOT, NULL, ON, AS, DELETE, UPDATE, BY, "=", "-", "+", ".", IN, IS, "["):
                self.p += 1
                if k == "[":
                    self.accept("n")
                    self.need("]")
                elif k in (NOT, ON, "=", BY) and ks[self.p] in ",);\0":
                    self.fail("option")
            else:
                self.fail(", or )")

    # queries ------------------------------------------------------------------------------------
    def ctes(self) -> None:
        self.need(WITH)
        self.accept(RECURSIVE)
        while True:
            self.name()
            if self.ks[self.p] == "(":
                self.group()
            self.need(AS)
            self.accept(NOT)
            if self.ks[self.p] == "i":
                self.p += 1
            self.need("(")
            self.data(self.ks[self.p])
            self.need(")")
            if not self.accept(","):
                return

    def query(self) -> None:
        ks = self.ks
        while True:
            if ks[self.p] == "(":
                self.p += 1
                self.query()
                self.need(")")
            elif ks[self.p] == VALUES:
                self.p += 1
                self.rows()
            elif ks[self.p] == WITH:
                self.ctes()
                continue
            else:
                self.select()
            if ks[self.p] in (UNION, INTERSECT, EXCEPT, MINUS):
                self.p += 1
                if not self.accept(ALL):
                    self.accept(DISTINCT)
                continue
            break
        self.tail()

    def tail(self) -> None:
        ks = self.ks
        while True:
            k = ks[self.p]
            if k == ORDER:
                self.p += 1
                self.need(BY)
                self.order_list()
            elif k == LIMIT or k == OFFSET:
                self.p += 1
                if not self.accept(ALL):
                    self.expression(3)
                while ks[self.p] in (ROW, ROWS):
                    self.p += 1
                if self.accept(","):
                    self.expression(3)
            elif k == FETCH and ks[self.p + 1] in K.set("first next"):
                self.p += 2
                while ks[self.p] not in (ONLY, ";", ")", "\0", WITH):
                    self.p += 1
                self.accept(ONLY)
            elif k == FOR:
                self.p += 1
                while ks[self.p] in _NAMEABLE or ks[self.p] in (UPDATE, "(", ")", ",", "s"):
                    if ks[self.p] == ")":
                        break
                    if ks[self.p] == "(":
                        self.group()
                    else:
                        self.p += 1
            elif k == OPTION and ks[self.p + 1] == "(":
                self.p += 1
                self.group()
            elif k == LOCK_IN and ks[self.p + 1] == IN:
                self.p += 4
            else:
                return

    def order_list(self) -> None:
        while True:
            self.expression()
            if not self.accept(ASC):
                self.accept(DESC)
            if self.accept(NULLS):
                self.p += 1
            if not self.accept(","):
                return

    def select(self) -> None:
        ks = self.ks
        self.need(SELECT)
        while ks[self.p] in (DISTINCT, ALL):
            self.p += 1
            if self.accept(ON):
                self.group()
        if self.accept(TOP):
            if ks[self.p] == "(":
                self.group()
            else:
                self.need("n")
            if ks[self.p] == "i" and ks[self.p + 1] not in ",." and ks[self.p + 1] != FROM:
                self.p += 1
        if ks[self.p] != FROM:
            while True:
                self.item()
                if not self.accept(","):
                    break
        if self.accept(INTO):
            while True:
                self.name()
                if not self.accept(","):
                    break
        if self.accept(FROM):
            self.sources()
        self.filters()

    def filters(self) -> None:
        ks = self.ks
        if self.accept(WHERE):
            self.expression()
        if self.accept(GROUP):
            self.need(BY)
            if not self.accept(ALL):
                self.grouping()
            if ks[self.p] == WITH and ks[self.p + 1] == "i":
                self.p += 2
        if self.accept(HAVING):
            self.expression()
        if ks[self.p] == QUALIFY:
            self.p += 1
            self.expression()
        if self.accept(WINDOW):
            while True:
                self.name()
                self.need(AS)
                self.window()
                if not self.accept(","):
                    break
        if ks[self.p] == QUALIFY:
            self.p += 1
            self.expression()

    def grouping(self) -> None:
        """Expressions, empty sets, and GROUPING SETS of the same."""
        while True:
            if self.ks.startswith("()", self.p):
                self.p += 2
            elif self.ks[self.p] == GROUPING and self.ks[self.p + 1] == SETS:
                self.p += 2
                self.need("(")
                self.grouping()
                self.need(")")
            else:
                self.expression()
            if not self.accept(","):
                return

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def window(self) -> None:
        """What stands in brackets behind OVER: a name, partition, order and frame."""
        ks = self.ks
        self.need("(")
        if ks[self.p] in "iq" and ks[self.p + 1] in (PARTITION, ORDER, ")"):
            self.p += 1
        if self.accept(PARTITION):
            self.need(BY)
            while True:
                self.expression()
                if not self.accept(","):
                    break
        if self.accept(ORDER):
            self.need(BY)
            self.order_list()
        if ks[self.p] in (ROWS, "i"):  # the frame: words and bounds
            self.p += 1
            if ks[self.p] == ")":
                self.fail("frame")
            between = self.accept(BETWEEN)
            self.bound()
            if between:
                self.need(AND)
                self.bound()
            while ks[self.p] in _ID and ks[self.p] != "q" or ks[self.p] == GROUP:  # EXCLUDE
                self.p += 1
        self.need(")")

    def bound(self) -> None:
        """UNBOUNDED PRECEDING, CURRENT ROW, or a value and a direction."""
        ks = self.ks
        if ks[self.p] == "i" and ks[self.p + 1] in ("i", ROW):
            self.p += 2
        else:
            self.expression(5)
            if ks[self.p] != "i":
                self.fail("bound")
            self.p += 1

    def item(self) -> None:
        ks = self.ks
        if ks[self.p] == "*":
            self.p += 1
        else:
            self.expression()
            if ks[self.p] == "." and ks[self.p + 1] == "*":
                self.p += 2
        self.alias(True)

    def alias(self, strings: bool) -> None:
        ks = self.ks
        if self.accept(AS):
            if ks[self.p] in "s":
                self.p += 1
            elif ks[self.p] in _NAMEABLE:
                self.p += 1
            else:
                self.fail("alias")
        elif ks[self.p] in _ID and ks[self.p] not in _NO_ALIAS or strings and ks[self.p] == "s":
            self.p += 1

    def sources(self) -> None:
        ks = self.ks
        while True:
            self.source()
            while True:
                k = ks[self.p]
                if k in (JOIN, INNER, CROSS, NATURAL) or k in (LEFT, RIGHT, FULL) and ks[self.p + 1] in (JOIN, OUTER) or k == OUTER:
                    while ks[self.p] in (INNER, CROSS, NATURAL, LEFT, RIGHT, FULL, OUTER):
                        self.p += 1
                    if not self.accept(APPLY):
                        self.need(JOIN)
                    self.source()
                    if self.accept(ON):
                        self.expression()
                    elif self.accept(USING):
                        self.group()
                else:
                    break
            if not self.accept(","):
                return

    def source(self) -> None:
        ks = self.ks
        self.accept(LATERAL)
        self.accept(ONLY)
        if ks[self.p] == "(":
            self.p += 1
            if ks[self.p] in (SELECT, VALUES, WITH, "("):
                mark = self.p
                try:
                    self.query()
                except Fault:
                    if ks[mark] != "(":
                        raise
                    self.p = mark
                    self.sources()
            else:
                self.sources()
            self.need(")")
        else:
            self.name()
            if ks[self.p] == "(":
                self.group()
        self.alias(False)
        if ks[self.p] == "(":
            self.group()
        if ks[self.p] == WITH and ks[self.p + 1] == "(":
            self.p += 1
            self.group()
        while True:
            if ks[self.p] in (PIVOT, UNPIVOT):
                self.pivot()
            elif ks[self.p] == LATERAL and ks[self.p + 1] == VIEW:
                self.p += 2
                self.accept(OUTER)
                self.name()
                if ks[self.p] != "(":
                    self.fail("(")
                self.call()
                if ks[self.p] != AS:
                    self.alias(False)
                if self.accept(AS):
                    self.name()
                    while self.accept(","):
                        self.name()
            else:
                return

    def pivot(self) -> None:
        """[UN]PIVOT (values FOR columns IN (list)) [alias]."""
        ks = self.ks
        self.p += 1
        while ks[self.p] == "i" or ks[self.p] == NULLS:  # INCLUDE NULLS, XML
            self.p += 1
        self.need("(")
        while True:
            self.expression()
            self.alias(True)
            if not self.accept(","):
                break
        self.need(FOR)
        self.unary()
        self.need(IN)
        self.need("(")
        if ks[self.p] in (SELECT, WITH):
            self.query()
        else:
            while True:
                self.expression()
                self.alias(True)
                if not self.accept(","):
                    break
        self.need(")")
        self.need(")")
        self.alias(False)

    def name(self) -> None:
        ks = self.ks
        if ks[self.p] not in _ID and ks[self.p] not in "s":
            self.fail("name")
        self.p += 1
        while ks[self.p] in (".", K[".."], "@"):
            self.p += 1
            if ks[self.p] in _NAMEABLE or ks[self.p] in ("*", "s"):
                self.p += 1
            elif ks[self.p - 1] != K[".."]:
                self.fail("name")

    def group(self) -> None:
        """A bracket with free contents; commas stand between two things."""
        ks = self.ks
        self.need("(")
        depth, last = 1, "("
        while depth:
            k = ks[self.p]
            if k == "\0" or k == ";":
                self.fail(")")
            if k == ")" and last in ",=" or k == "," and last in "(,=":
                self.fail("value")
            if k in "<>" and ks[self.p + 1] == k or k in (K["=="], K["<<"], K[">>"]) and last not in "in)q":
                self.fail("value")
            depth += (k == "(") - (k == ")")
            last = k
            self.p += 1

    def insert(self) -> None:
        ks = self.ks
        self.p += 1
        while ks[self.p] in (IGNORE, INTO, "i", K["or"], REPLACE, K["values_"]) and not (ks[self.p] == "i" and ks[self.p + 1] not in (INTO, "i")):
            if ks[self.p] == INTO:
                self.p += 1
                break
            self.p += 1
        self.accept(TABLE)
        self.name()
        if self.accept(PARTITION):
            self.group()
        self.accept(AS)
        if ks[self.p] == "i" and ks[self.p + 1] in ("(", VALUES, SELECT):
            self.p += 1
        if ks[self.p] == "(" and ks[self.p + 1] not in (SELECT, WITH, "("):
            self.names_in()
        if self.accept(OUTPUT):
            while ks[self.p] not in (VALUES, SELECT, ";", "\0"):
                self.p += 1
        if self.accept(VALUES):
            self.rows()
        elif self.accept(SET):
            self.assignments()
        elif self.accept(DEFAULT):
            self.need(VALUES)
        elif ks[self.p] in (EXEC, EXECUTE):
            self.free()
            return
        elif ks[self.p] in (SELECT, WITH, "("):
            self.query()
        else:
            self.fail("values")
        if ks[self.p] == ON:
            self.p += 1
            self.balanced()
        elif self.accept(RETURNING):
            self.balanced()
        elif self.accept(AS):
            self.balanced()

    def names_in(self) -> None:
        self.need("(")
        while True:
            if self.ks[self.p] not in _NAMEABLE and self.ks[self.p] != "s":
                self.fail("column")
            self.p += 1
            while self.accept("."):
                self.p += 1
            if not self.accept(","):
                break
        self.need(")")

    def rows(self) -> None:
        while True:
            if self.accept(ROW):
                pass
            self.need("(")
            if not self.accept(")"):
                while True:
                    if not self.accept(DEFAULT):
                        self.expression()
                    if not self.accept(","):
                        break
                self.need(")")
            if not self.accept(","):
                return

    def assignments(self) -> None:
        ks = self.ks
        while True:
            if ks[self.p] == "(":
                self.names_in()
            else:
                if ks[self.p] not in _NAMEABLE:
                    self.fail("column")
                self.p += 1
                while self.accept("."):
                    self.p += 1
            if ks[self.p] not in ("=", K[":="], K["+="], K["-="], K["*="], K["/="], K["%="], K["|="], K["&="], K["^="]):
                self.fail("=")
            self.p += 1
            if not self.accept(DEFAULT):
                self.expression()
            if not self.accept(","):
                return

    def update(self) -> None:
        ks = self.ks
        self.p += 1
        if self.accept(TOP):
            self.group()
        self.accept(ONLY)
        self.accept(IGNORE)
        self.sources()
        self.need(SET)
        self.assignments()
        if self.accept(OUTPUT):
            while ks[self.p] not in (FROM, WHERE, ";", "\0"):
                self.p += 1
        if self.accept(FROM):
            self.sources()
        if self.accept(WHERE):
            self.expression()
        self.tail()
        if self.accept(RETURNING):
            self.balanced()

    def delete(self) -> None:
        ks = self.ks
        self.p += 1
        if self.accept(TOP):
            self.group()
        self.accept(IGNORE)
        if ks[self.p] != FROM:
            self.name()
            while self.accept(","):
                self.name()
        if self.accept(FROM):
            self.sources()
        if self.accept(OUTPUT):
            while ks[self.p] not in (FROM, WHERE, ";", "\0"):
                self.p += 1
        if self.accept(FROM) or self.accept(USING):
            self.sources()
        if self.accept(WHERE):
            self.expression()
        self.tail()
        if self.accept(RETURNING):
            self.balanced()

    # expressions --------------------------------------------------------------------------------
    def expression(self, least: int = 1) -> None:
        """Precedence climbing; predicates stand at the level of comparisons."""
        ks = self.ks
        if ks[self.p] == NOT:
            self.p += 1
            self.expression(3)
        else:
            self.unary()
        while True:
            k = ks[self.p]
            prec = _BINARY.get(k, 0)
            if prec:
                if prec < least:
                    break
                self.p += 1
                if k in _COMPARE and ks[self.p] in (ALL, K["any"], K["some"]) and ks[self.p + 1] == "(":
                    self.p += 1
                if k in "<>" and ks[self.p] == k:
                    self.fail("expression")
                self.expression(prec + 1 if prec > 2 else prec + 1)
                continue
            if least > 4:
                break
            if k == IS:
                self.p += 1
                self.accept(NOT)
                if self.accept(DISTINCT):
                    self.need(FROM)
                    self.expression(5)
                elif not self.accept(NULL):
                    self.expression(5)
                continue
            negated = k == NOT and ks[self.p + 1] in (IN, LIKE, BETWEEN, K["ilike"], K["rlike"], K["regexp"], K["similar"])
            if negated:
                self.p += 1
                k = ks[self.p]
            if k == IN:
                self.p += 1
                if ks[self.p] == "(":
                    self.p += 1
                    if ks[self.p] in (SELECT, WITH):
                        self.query()
                    elif ks[self.p] != ")":
                        while True:
                            self.expression()
                            if not self.accept(","):
                                break
                    self.need(")")
                else:
                    self.unary()
            elif k == LIKE or k in K.set("ilike rlike regexp similar") and least <= 4:
                self.p += 1
                if k == K["similar"]:
                    self.need(TO)
                self.expression(5)
                if self.accept(ESCAPE):
                    self.expression(5)
            elif k == BETWEEN:
                self.p += 1
                self.expression(5)
                self.need(AND)
                self.expression(5)
            elif negated:
                self.fail("predicate")
            else:
                break

    def unary(self) -> None:
        ks = self.ks
        while ks[self.p] in "+-~!&":
            self.p += 1
        k = ks[self.p]
        if k == "n" or k == "?":
            self.p += 1
        elif k == "s":
            self.p += 1
            while ks[self.p] == "s":
                self.p += 1
        elif k == NULL or k == DEFAULT:
            self.p += 1
        elif k == "(":
            self.p += 1
            if ks[self.p] in (SELECT, WITH, VALUES):
                self.query()
            else:
                self.expression()
                while self.accept(","):
                    self.expression()
            self.need(")")
        elif k == CASE:
            self.case()
        elif k == EXISTS:
            self.p += 1
            self.need("(")
            self.query()
            self.need(")")
        elif k == CAST and ks[self.p + 1] == "(":
            self.p += 2
            self.expression()
            self.need(AS)
            self.type()
            if ks[self.p] != ")":  # FORMAT, ARRAY and the like
                self.balanced_inside()
            else:
                self.p += 1
        elif k == K["convert"] and ks[self.p + 1] == "(" or k == K["extract"] and ks[self.p + 1] == "(":
            self.p += 1
            self.group()
        elif k == INTERVAL and ks[self.p + 1] in "sn(i" and ks[self.p + 1] != ")":
            self.p += 1
            self.unary()
            if ks[self.p] == "i" and ks[self.p - 1] != "s" or ks[self.p] == "i":
                self.p += 1
        elif k == DISTINCT:
            self.p += 1
            self.expression()
        elif k in _ID or k in (LEFT, RIGHT, VALUES, REPLACE, IF, SET, INSERT) and ks[self.p + 1] == "(" or k == VALUES:
            self.p += 1
            while ks[self.p] in (".", K[".."]):
                self.p += 1
                if ks[self.p] not in _NAMEABLE and ks[self.p] != "*":
                    self.fail("name")
                self.p += 1
            if ks[self.p] == "(":
                self.call()
            elif ks[self.p] == "s" and ks[self.p - 1] == "i":
                self.p += 1  # DATE '2020-01-01', _utf8'x'
        elif k == "*" and ks[self.p - 1] == "(":
            self.p += 1
        elif k == ":" and ks[self.p + 1] in _NAMEABLE:
            self.p += 2
        elif k == "{" or k == "[" or k == "$" or k == "@":
            close = "}" if k == "{" else "]"
            if k in "$@":
                self.p += 1
                return self.unary()
            end = ks.find(close, self.p)
            if end < 0:
                self.fail(close)
            self.p = end + 1
        else:
            self.fail("expression")
        while True:
            k = ks[self.p]
            if k == K["::"]:
                self.p += 1
                self.name()
                if ks[self.p] == "(":
                    self.group()
            elif k == COLLATE:
                self.p += 1
                self.name()
            elif k == "[" and ks[self.p + 1] in "nis":
                self.p += 1
                self.expression()
                self.need("]")
            elif k == AT and ks[self.p + 1] == "i" and ks[self.p + 2] == "i":
                self.p += 3
                self.unary()
            else:
                return

    def call(self) -> None:
        ks = self.ks
        if ks.startswith("(+)", self.p):  # an outer join in the old way
            self.p += 3
            return
        self.p += 1
        if ks[self.p] in (DISTINCT, ALL):
            self.p += 1
        if ks[self.p] in (SELECT, WITH):
            self.query()
        elif ks[self.p] != ")":
            while True:
                if ks[self.p] == "*":
                    self.p += 1
                else:
                    self.expression()
                    if ks[self.p] == K["=>"]:
                        self.p += 1
                        self.expression()
                    while ks[self.p] in (FROM, FOR, AS, USING, IN) or ks[self.p] in _ID:
                        self.p += 1
                        if ks[self.p] not in ",)":
                            self.expression()
                    if ks[self.p] == ORDER:
                        self.p += 1
                        self.need(BY)
                        self.order_list()
                if not self.accept(","):
                    break
        self.need(")")
        if ks[self.p] == FILTER and ks[self.p + 1] == "(":
            self.p += 1
            self.need("(")
            self.need(WHERE)
            self.expression()
            self.need(")")
        if ks[self.p] == K["within"] and ks[self.p + 1] == GROUP:
            self.p += 2
            self.need("(")
            self.need(ORDER)
            self.need(BY)
            self.order_list()
            self.need(")")
        if ks[self.p] == OVER:
            self.p += 1
            if ks[self.p] == "(":
                self.window()
            else:
                self.name()

    def case(self) -> None:
        self.p += 1
        if self.ks[self.p] != WHEN:
            self.expression()
        if self.ks[self.p] != WHEN:
            self.fail("when")
        while self.accept(WHEN):
            self.expression()
            self.need(THEN)
            self.expression()
        if self.accept(ELSE):
            self.expression()
        self.need(END)


#: What an argument of EXEC without brackets begins with.
_ARGUMENT = frozenset("snq-+?") | {"i", NULL, DEFAULT}
_MARKS = K.set("== << >>")
LOCK_IN = K["lock"]
_TRIGGERING = K.set("for on or ,") | frozenset(",") | {K["or"]} | frozenset("i")


_LINES = LineCache(tokens, ("/*",), ("'", "*/"))


def faults(text: str) -> list[tuple[int, str]]:
    """``(offset, message)`` of every fault, in order of the text."""
    quick = None if _WHOLE.search(text) else _LINES.kinds(text)
    if quick is not None:
        p = SqlParser(quick)
        p.file()
        if not p.faults:
            return []
    ks, at, lexical = tokens(text)
    p = SqlParser(ks)
    p.file()
    out = [(at[a] if a < len(at) else len(text), m) for a, m in p.faults]
    if lexical:
        out = [x for x in out if x[0] < lexical[0] and x[0] < len(text)] + [lexical]
    return out
