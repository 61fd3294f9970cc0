"""Lexical rules of the languages found in the corpus: where comments and literals begin and end.

``literals(language, text)`` walks a text once and yields comments and string literals only; the
scanner is one regular expression per language, so that everything between is skipped in C.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

# group names: c comment, s string, r raw string
_RULES = {
    "go": r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>\"(?:[^\"\\\n]|\\.)*\"?)|(?P<r>`[^`]*`?)|'(?:[^'\\\n]|\\.)*'?",
    "pascal": r"(?P<c>//[^\n]*|\{(?!\$)[^}]*\}?|\(\*(?!\$).*?(?:\*\)|\Z))|\{\$[^}]*\}?|(?P<s>'(?:[^'\n]|'')*'?)",
    "sql": r"(?P<c>--[^\n]*|/\*.*?(?:\*/|\Z)|(?m:^[ \t]*\#[^\n]*))|(?P<s>'(?:[^'\\]|''|\\.)*'?)|\"(?:[^\"\n]|\"\")*\"?|`[^`\n]*`?",
    "form": r"(?P<s>'(?:[^'\n]|'')*'?)",
    "rc": r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z)|(?m:^[ \t]*;[^\n]*))|(?P<s>\"(?:[^\"\n]|\"\")*\"?)",
    "ini": r"(?m:^[ \t]*(?P<c>[;#][^\n]*|//[^\n]*))|(?m:^[^\n=;#\[]+=[ \t]*(?P<v>[^\r\n]+))",
    "xml": r"(?P<c><!--.*?(?:-->|\Z))|(?<=>)(?P<v>[^<>]*[^<>\s][^<>]*)(?=</)|(?P<s>\"[^\"\n]*\")",
    # families of other languages: braces (C, Java, JavaScript, PHP, JSON), scripts, keyed values
    "brace": r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)",
    "script": r"(?P<c>\#[^\n]*)|(?P<r>\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z))|(?P<s>\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\]|\\.)*'?)",
    "keyed": r"(?P<c>(?m:(?:^|(?<=[ \t]))[\#;][^\n]*))|(?P<s>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\n]|'')*'?)|(?m:^[ \t]*(?:-[ \t]+|export[ \t]+)?[\w.-]+[ \t]*[=:][ \t]*(?P<v>[^\s\"'\#][^\r\n]*))",
}
SCANNERS = {k: re.compile(v, re.S if k != "form" else 0) for k, v in _RULES.items()}

BY_EXTENSION = {
    "go": "go", "sql": "sql", "pas": "pascal", "dpr": "pascal", "dpk": "pascal", "inc": "pascal", "pp": "pascal",
    "dfm": "form", "fmx": "form", "rc": "rc", "cfg": "ini", "dof": "ini", "ini": "ini", "conf": "ini",
    "dproj": "xml", "groupproj": "xml", "xml": "xml", "config": "xml", "html": "xml", "htm": "xml",
    **dict.fromkeys(("c", "h", "cc", "cpp", "hpp", "cs", "java", "js", "jsx", "ts", "tsx", "mjs", "kt", "swift", "scala", "rs", "php", "dart", "groovy", "gradle", "json", "css"), "brace"),
    **dict.fromkeys(("py", "rb", "sh", "bash", "zsh", "pl", "r", "tf", "ps1", "mk"), "script"),
    **dict.fromkeys(("yaml", "yml", "toml", "env", "properties"), "keyed"),
}
#: Families that no sign in the text tells apart: the extension decides.
_FAMILIES = ("brace", "script", "keyed")

_SKIP = re.compile(r"(?:\s+|﻿|//[^\n]*|--[^\n]*|/\*.*?\*/|\(\*.*?\*\)|\{(?!\$)[^}\"]*\}|;[^\n]*)+", re.S)
_SIGNS = (
    ("xml", re.compile(r"<\?xml|<Project\b|<[A-Za-z][\w.:-]*(?:\s[^<>]*)?>", re.I)),
    ("form", re.compile(r"(?:object|inherited|inline)\s+(?:\w+\s*:\s*)?\w+", re.I)),
    ("go", re.compile(r"package\s+\w+\s*(?:$|[;\n\r/])|func\s+[(\w]|import\s*[(\"]|type\s+\w+\s+(?:struct|interface|func|map|\[|=)|var\s+\w+(?:\s+[\w*\[\]]+)?\s*=|const\s*\(")),
    ("pascal", re.compile(r"(?:unit|program|library|package)\s+[\w.]+\s*;|interface\b(?!\s*\{)|implementation\b|uses\s+[\w.]+|(?:procedure|function|constructor|destructor)\s+[\w.]+\s*[(;:]|const\s+\w+\s*(?::[^=\n]+)?=|type\s+\w+\s*=|var\s+\w+\s*(?:,\s*\w+\s*)*:|begin\b(?!\s+(?:tran|work))|\{\$", re.I)),
    ("sql", re.compile(r"(?:create|alter|drop|insert|update|delete|select|with|set|grant|revoke|use|exec|execute|declare|begin|commit|merge|truncate|call|delimiter)\b[\s(@\[`\"\w]", re.I)),
    ("rc", re.compile(r"STRINGTABLE\b|\w+\s+(?:DIALOG|DIALOGEX|MENU|ICON|BITMAP|RCDATA|VERSIONINFO|ACCELERATORS)\b|#include|#define|LANGUAGE\s", re.I)),
    ("ini", re.compile(r"\[[^\]\n]+\][ \t]*(?:\r?\n|$)|[\w.-]+=[^\n]*(?:\n[\w.-]+=|\n\[)")),
)


def extension(path: str | None) -> str:
    return path.rsplit(".", 1)[-1].lower() if path and "." in path else ""


def content_language(path: str | None, text: str) -> str:
    """The language a text is written in: by its first real words, else by its extension ('' if neither tells)."""
    expected = BY_EXTENSION.get(extension(path), "")
    if expected in _FAMILIES:
        return expected
    m = _SKIP.match(text)
    at = m.end() if m else 0
    if expected and expected not in ("rc", "ini"):
        sign = next(p for k, p in _SIGNS if k == expected)
        if sign.match(text, at):
            return expected
    for kind, sign in _SIGNS:
        if sign.match(text, at):
            if kind == "sql" and expected == "pascal" and re.match(r"(?:begin|set|with|exec)\b", text[at : at + 5], re.I):
                continue
            return kind
    return expected


def literals(language: str, text: str) -> Iterator[tuple[str, int, int]]:
    """``(kind, start, end)`` of each comment ('c'), string ('s'), raw string ('r') or bare value ('v')."""
    scanner = SCANNERS.get(language)
    if scanner is None:
        return
    for m in scanner.finditer(text):
        k = m.lastgroup
        if k:
            yield k, m.start(k), m.end(k)


class Lines:
    """Line numbers of offsets; lines end in LF or CRLF and count from 1."""

    def __init__(self, text: str):
        self.text, self.at, self.n = text, 0, 1

    def of(self, offset: int) -> int:
        if offset < self.at:
            self.at, self.n = 0, 1
        self.n += self.text.count("\n", self.at, offset)
        self.at = offset
        return self.n


@lru_cache(maxsize=65536)
def words_of(identifier: str) -> tuple[str, ...]:
    """Lower-case words of a camelCase, PascalCase, snake_case or dotted identifier."""
    return tuple(w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿ]+|\d+", identifier))
