"""Token stream, errors and memo shared by the language parsers."""

from __future__ import annotations

import sys

#: Sub-parses remembered per worker and language; the oldest half goes when it is full.
MEMO_ENTRIES = 200_000
#: Python calls a token may nest: an expression in brackets takes the most.
CALLS_PER_TOKEN = 60


class Fault(Exception):
    """Raised inside a production; caught where the parser recovers."""

    def __init__(self, at: int, message: str):
        self.at, self.message = at, message


class Kinds:
    """Characters for words and marks: letters i n s c are names, numbers, strings, characters."""

    def __init__(self, words: str, marks: str, fold: bool):
        self.fold = fold
        self.word: dict[str, str] = {w: chr(0x4E00 + i) for i, w in enumerate(words.split())}
        self.mark: dict[str, str] = {m: m if len(m) == 1 else chr(0x3400 + i) for i, m in enumerate(marks.split())}
        self.name = {v: k for k, v in {**self.word, **self.mark}.items()} | {"i": "name", "n": "number", "s": "string", "c": "character", "\0": "end of file", ";": ";"}

    def __getitem__(self, word: str) -> str:
        return self.word.get(word) or self.mark[word]

    def set(self, words: str) -> frozenset[str]:
        return frozenset(self[w] for w in words.split())


class Memo:
    def __init__(self) -> None:
        self.seen: dict = {}

    def get(self, key):
        return self.seen.get(key)

    def put(self, key, value) -> None:
        if len(self.seen) >= MEMO_ENTRIES:
            for k in list(self.seen)[: MEMO_ENTRIES // 2]:
                del self.seen[k]
        self.seen[key] = value


class Parser:
    """Cursor over a kind string ended by NUL; subclasses hold the grammar."""

    kinds: Kinds
    __slots__ = ("ks", "p", "faults")

    def __init__(self, ks: str):
        self.ks, self.p = ks + "\0", 0
        # calls between Python functions live on the heap: nesting is bounded by the text, never by a limit
        if sys.getrecursionlimit() < (calls := CALLS_PER_TOKEN * len(self.ks) + 10_000):
            sys.setrecursionlimit(calls)
        self.faults: list[tuple[int, str]] = []

    def fail(self, wanted: str) -> None:
        k = self.ks[self.p]
        raise Fault(self.p, f"{wanted} expected, {self.kinds.name.get(k, k)} found")

    def need(self, k: str) -> None:
        if self.ks[self.p] != k:
            self.fail(self.kinds.name.get(k, k))
        self.p += 1

    def accept(self, k: str) -> bool:
        if self.ks[self.p] == k:
            self.p += 1
            return True
        return False


class LineCache:
    """Kind strings of whole texts, put together from remembered pieces.

    A piece is one line, or a run of lines up to one that closes what the first has opened. It counts only
    if it is tokenised without a fault and leaves nothing open; a text with any other line is left to the
    full tokeniser (``None``). Lines recur so often in code that most are never tokenised twice; the table
    is bounded like every memo here.
    """

    def __init__(self, tokens, openers: tuple[str, ...] = (), closers: tuple[str, ...] = (), most: int = 64):
        self.tokens, self.openers, self.closers, self.most, self.memo = tokens, openers, closers, most, Memo()

    def piece(self, text: str):
        ks, _, lexical = self.tokens(text)
        if lexical is not None or any(o in ks for o in self.openers):
            ks = False
        if len(text) <= 1000:
            self.memo.put(text, ks)
        return ks

    def kinds(self, text: str) -> str | None:
        seen, out, lines = self.memo.seen, [], text.split("\n")
        i, n = 0, len(lines)
        while i < n:
            line = lines[i]
            ks = seen.get(line)
            if ks is None:
                ks = self.piece(line)
            i += 1
            if ks is False:
                for j in range(i, min(n, i + self.most)):
                    if any(c in lines[j] for c in self.closers):
                        run = "\n".join(lines[i - 1 : j + 1])
                        ks = seen.get(run)
                        if ks is None:
                            ks = self.piece(run)
                        if ks is not False:
                            i = j + 1
                            break
                else:
                    return None
                if ks is False:
                    return None
            out.append(ks)
        return "".join(out)
