"""Problem 1: live credentials in source and configuration text, found and masked.

A text is tokenised into comments, string literals and bare values. A literal is a credential if it is
usable (no placeholder, mask, look-up or format) and is

* assigned or passed to a credential-named identifier, column, property, key or call,
* inside a connection string, header, URL or ``name=value`` text under such a name,
* a private key block, or of the unmistakable shape of an issued token.

Concatenated literals count as one value. Masking replaces every character of the value alone: delimiters,
line breaks and everything around stay, and an escape becomes an escape of the same form.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.lexers import Lines, content_language, literals, words_of

# Words and word pairs that name a credential.
CREDENTIAL_WORDS = {
    "password", "passwd", "passwort", "passw", "passphrase", "pwd", "pw", "pass", "secret", "token", "apikey", "kennwort", "credential",
    "credentials", "senha", "clave", "contrasena", "contraseña", "motdepasse", "haslo", "hasło", "parol", "auth", "authorization", "bearer",
    "zugang", "geheim", "geheimnis", "schluessel", "schlüssel", "kennung", "chave", "klucz", "signpass", "rmtpassword", "secretkey", "authtoken", "accesskey", "privatekey", "smtppasswort", "sas",
}
CREDENTIAL_PAIRS = {(a, b) for a in ("api", "access", "secret", "private", "sign", "signing", "sms", "license", "licence", "encryption", "crypt", "cipher", "auth", "master", "sec", "session", "shared", "account", "client", "app", "service", "storage", "hmac", "aes", "jwt", "smtp", "ftp", "mail") for b in ("key",)}
# A name that ends in one of these speaks about a credential and holds none.
ABOUT_WORDS = {
    "field", "length", "len", "count", "ttl", "expires", "expiry", "hash", "hashed", "char", "label", "caption", "hint", "prompt", "url", "uri", "column",
    "policy", "min", "max", "file", "path", "type", "mode", "checksum", "digest", "kind", "class", "title", "table", "user", "username", "regex", "pattern",
    "format", "placeholder", "error", "message", "msg", "name", "names", "env", "var", "variable", "page", "form", "dialog", "visible", "enabled", "changed", "required", "date", "at", "id", "index", "size", "width", "height",
    "left", "top", "onclick", "tooltip", "description", "comment", "status", "public", "verify",
}
# Words before a user name and its password.
LOGIN_WORDS = ("login", "logon", "user", "account", "credential", "credentials", "zugang", "benutzer", "utilisateur", "usuario", "usuário", "anmeldung")
# What any rule needs: the words of the rules themselves, marks of addresses, beginnings of issued tokens.
_CUES = tuple(dict.fromkeys([*sorted(CREDENTIAL_WORDS), *LOGIN_WORDS, "key", "basic", "identified", "private", "@", "://", "akia", "asia", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "glpat", "xox", "eyj", "sk-", "sk_", "aiza", "sg."]))
_NAME = r"(?:[A-Za-z]*(?:password|passwort|passwd|passphrase|kennwort|secret|senha|apikey|api[_-]?key|access[_-]?key|secret[_-]?key|sign[_-]?key|private[_-]?key|license[_-]?key|auth[_-]?token|token|pwd)|[A-Za-z_]*(?:pass|pw|auth|_key|-key))"
_PAIR = re.compile(rf"(?i)(?<![\w.$])(?P<n>[\w.-]*{_NAME})\b[\"']?[ \t]*(?:=|:(?![:=/])|:=|=>)[ \t]*[\"']?(?P<v>[^\s\"';,<>()]+)")
_URL = re.compile(r"(?i)\b[a-z][a-z0-9+.-]*://(?P<u>[^\s/:@\"'<>]*):(?P<v>[^\s/@\"'<>]+)@[^\s/\"']")
_DSN = re.compile(r"(?<![\w/])(?P<u>[A-Za-z_][\w.-]*):(?P<v>[^\s:@\"'<>/()]+)@(?:tcp|udp|unix)?[\w(][\w.(-]*")
_LOGIN = re.compile(rf"(?i)\b(?:{'|'.join(LOGIN_WORDS)})\b[^\n]{{0,60}}?[\w.-]+[ \t]*(?:/|:|\||,[ \t]*(?:pw|password|pass)?)[ \t]*(?P<v>[^\s/\"'<>]{{6,}})[ \t]*(?:\*/|\*\)|\}}|-->)?[ \t\r]*$", re.M)
_BEARER = re.compile(r"(?i)\b(?:bearer|basic|token)[ \t]+(?P<v>[A-Za-z0-9._~+/=-]{10,})")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_ISSUED = re.compile(
    r"(?<![\w/+-])(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|glpat-[\w-]{18,}|xox[abprs]-[\w-]{10,}|sk_live_\w{16,}|sk-[A-Za-z0-9]{32,}|AIza[\w-]{35}|eyJ[\w-]{6,}\.eyJ[\w-]{6,}\.[\w-]{10,}|SG\.[\w-]{16,}\.[\w-]{16,}"
    r"|[a-z]{2,6}_(?:[a-z]{2,6}_)?(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Z])[A-Za-z0-9]{28,}|[a-z]{2,5}-\d{8,14}-(?=\w*[A-Z])[A-Za-z0-9]{16,})(?![\w/+])"
)
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*#.?_•-]+|\$\{.*|\$\(.*|%\(.*|%[\w%-]*|\{\{.*|\{\w*\}.*|<.*|\[.*\]|\$\w+|@\w+|:\w+|#\{.*|&\w+;.*|null|none|nil|empty|undefined|n/?a|true|false|yes|no|on|off)$"
    r"|change.?me|changeit|place.?holder|your[-_ ]|my[-_ ]?(?:password|secret|token)|insert[-_ ]|enter[-_ ]|replace|redacted|masked|hidden|removed|dummy|^todo|^fixme|^tbd|^example|^sample|^(?:foo|bar|baz|test|demo|pass|secret|password|passwd|passwort|token|pwd|admin|default|value|string|text|key)\d{0,3}$"
)


class Cues:
    """Where in a text any rule below could fire: one pass of an Aho-Corasick automaton, then bisection."""

    _automaton = None

    def __init__(self, text: str):
        if Cues._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w in _CUES:
                a.add_word(w, len(w))
            a.make_automaton()
            Cues._automaton = a
        low = text.lower()
        if len(low) != len(text):  # a few capitals change length
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        self.at = [e for e, _ in Cues._automaton.iter(low)]
        self.at += [m.start() for m in _SHAPE.finditer(text)]
        self.at.sort()

    def within(self, a: int, b: int) -> bool:
        i = bisect_left(self.at, a)
        return i < len(self.at) and self.at[i] < b


_SHAPE = re.compile(r"[a-z]-\d{8,14}-\w|[a-z]_[A-Za-z0-9]{28}")
_BEFORE = re.compile(r"([A-Za-z_@][\w.@$\[\]]*)[ \t\r\n]*(?::[ \t]*[\w.<>\[\]]+[ \t]*)?(:=|==|=>|=|<>|!=|:)[ \t\r\n]*(?:[NnEeUu@](?=$))?$")
_ASSIGNS = tuple(":=>NnEeUu@")
_CALL = re.compile(r"([A-Za-z_][\w.]*)[ \t]*\([^()]*$")
_JOIN = re.compile(r"(?:\#\d+)+$|[ \t\r\n]*(?:\+|\|\||&)[ \t\r\n]*(?:[A-Za-z_]\w*[ \t]*(?:\+|\|\||&)[ \t\r\n]*|(?:#\d+)+[ \t]*\+?[ \t\r\n]*)*(?:(?://|--)[^\n]*\n[ \t]*)?$")
_BY = re.compile(r"(?i)(?:identified\s+(?:with\s+\w+\s+)?by|with\s+password|password)\s*=?\s*[NnEe]?$")
_LOGIN_CALLS = {"setbasicauth", "login", "logon", "signin", "authenticate", "connect", "basicauth", "logonuser", "auth", "sqlconnect", "bind", "opensession"}
_TOKEN_CALLS = {"setpassword", "settoken", "setapikey", "setsecret", "withtoken", "withapikey", "encrypt", "decrypt", "hmac", "newtoken", "sign", "withpassword", "setkey", "usetoken", "setauthtoken", "setcredentials"}
_LOOKUP_CALLS = {"getenv", "lookupenv", "readstring", "getstring", "getvalue", "fieldbyname", "parambyname", "readsecret", "getsecret", "loadsecret", "getenvironmentvariable", "getparam", "get", "lookup", "values", "findcomponent", "translate", "gettext", "showmessage", "create", "errorf", "errorln", "print", "printf", "log", "inputquery", "inputbox"}


@lru_cache(maxsize=65536)
def names_credential(identifier: str) -> bool:
    """Whether an identifier names something that holds a credential."""
    parts = [p for p in re.split(r"[.\[\]]", identifier) if p]
    if not parts:
        return False
    last = words_of(parts[-1])
    if last and last[-1] in ("text", "value", "asstring", "string", "val") and len(parts) > 1:
        last = words_of(parts[-2])
    while last and last[-1].isdigit():
        last = last[:-1]
    if not last or last[-1] in ABOUT_WORDS or last[0] in ("max", "min", "num", "lbl", "label", "public", "verify"):
        return False
    if any(w in CREDENTIAL_WORDS for w in last):
        return not (len(last) > 1 and last[-1] in ("header",) and "auth" not in last)
    joined = "".join(last)
    if re.search(r"password|passwort|passwd|secretkey|apikey|authtoken|accesstoken|signpass|kennwort", joined):
        return True
    return any(p in CREDENTIAL_PAIRS for p in zip(last, last[1:]))


@lru_cache(maxsize=4096)
def names_key(identifier: str) -> bool:
    """A bare 'key': a credential only if its value looks random."""
    w = words_of(identifier.rsplit(".", 1)[-1])
    return bool(w) and w[-1] == "key" and not {"primary", "foreign", "public", "verify", "sort", "map", "hash", "index", "cache"} & set(w)


def random_looking(v: str) -> bool:
    if len(v) < 16 or re.search(r"\s", v):
        return False
    kinds = bool(re.search(r"[a-z]", v)) + bool(re.search(r"[A-Z]", v)) + bool(re.search(r"\d", v))
    return kinds >= 2 and len(set(v)) >= 8 and not re.search(r"[a-z]{9,}", v)


def usable(v: str) -> bool:
    """A value someone could log in with, as far as its form tells."""
    v = v.strip()
    if len(v) < 5 or re.search(r"\s", v) or _PLACEHOLDER.search(v):
        return False
    if len(set(v)) < 4 or re.search(r"%[sdvq]|\$\{|\$\(|\{\{|<\w", v):
        return False
    if re.fullmatch(r"[A-Za-z_.-]+", v) and not (re.search(r"[a-z][A-Z]", v) and len(v) >= 10) and not (len(v) >= 12 and re.search(r"[A-Z]", v[1:]) and re.search(r"[a-z]", v)):
        return False  # a plain word, a field name, a host or a caption
    return not re.fullmatch(r"\d{1,4}(?:[.,]\d+)?|[\w.-]+\.(?:pas|go|sql|txt|ini|cfg|exe|dll|com|org|net)|[A-Za-z]:\\.*|/[\w/.-]*", v)


# Words that make a phrase wording, and parts of words that speak of credentials.
WORDING = {"the", "and", "for", "not", "you", "your", "this", "that", "with", "are", "has", "was", "must", "please", "from", "der", "die", "das", "und", "ist", "nicht", "bitte", "ein", "eine", "les", "des", "est", "pas", "pour", "una", "por", "para", "con", "los", "las"}
ABOUT_CREDENTIALS = ("pass", "secret", "token", "auth", "login", "user", "cred", "key", "kennwort", "bearer", "default", "config", "setting", "field", "value")


def assigned(v: str) -> bool:
    """A literal assigned to a credential-named identifier: any that is no placeholder, no look-up and no wording.

    Words and phrases count too, but not those that speak of credentials (captions, messages, names).
    """
    if usable(v):
        return True
    v = v.strip()
    if len(v) < 8 or _PLACEHOLDER.search(v) or len(set(v)) < 4 or re.search(r"%[sdvq]|\$\{|\$\(|\{\{|<\w|[.!?:…]$", v):
        return False
    parts = v.split()
    if len(parts) > 1:
        return 3 <= len(parts) <= 8 and all(re.fullmatch(r"[a-z]{3,}", w) for w in parts) and not any(w in CREDENTIAL_WORDS for w in parts) and not WORDING & set(parts)
    return bool(re.fullmatch(r"[a-z]{12,}", v)) and not any(w in v for w in ABOUT_CREDENTIALS)


def _inner(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Credentials named inside one literal, comment or bare text."""
    body = text[a:b]
    for m in _URL.finditer(body):
        if usable(m["v"]) and m["u"]:
            yield a + m.start("v"), a + m.end("v")
    for m in _DSN.finditer(body) if "@" in body else ():
        if usable(m["v"]) and (re.search(r"\d|[a-z][A-Z]", m["v"])):
            yield a + m.start("v"), a + m.end("v")
    for m in _LOGIN.finditer(body) if "/" in body or ":" in body else ():
        if usable(m["v"]) and re.search(r"\d|[a-z][A-Z]", m["v"]) and re.search(r"[A-Za-z]", m["v"]) and not re.match(r"[\d:.,-]+\w?$", m["v"]):
            yield a + m.start("v"), a + m.end("v")
    for m in _BEARER.finditer(body):
        if usable(m["v"]) and (random_looking(m["v"]) or re.search(r"\d", m["v"])):
            yield a + m.start("v"), a + m.end("v")
    for m in _ISSUED.finditer(body):
        yield a + m.start("v"), a + m.end("v")
    for m in _PAIR.finditer(body):
        v = m["v"].rstrip(".")
        if names_credential(m["n"]) and usable(v) and not re.match(r"(?:bearer|basic|token)$", v, re.I) and not re.match(r"[A-Za-z_][\w.]*[(\[]", body[m.start("v") : m.end("v") + 1]):
            yield a + m.start("v"), a + m.start("v") + len(v)


def find_secrets(path: str | None, text: str) -> list[list[tuple[int, int]]]:
    """Each credential as the spans of its pieces, in order of the text."""
    cues = Cues(text) if text else None
    if cues is None or not cues.at:
        return []
    language = content_language(path, text)
    found: list[list[tuple[int, int]]] = []
    chain: list[tuple[int, int]] = []  # inner spans of concatenated literals
    chain_end, chain_before, names = -1, 0, []

    def settle() -> None:
        if chain:
            _judge(text, chain, chain_before, names, found, language, cues)

    previous_end = 0
    for kind, a, b in literals(language, text):
        if kind == "c":
            between = text[previous_end:a]
            if cues.within(a, b):
                found += [[x] for x in _inner(text, a, b)]
                found += _pem_blocks(text, [(a, b)])
            if chain and not between.strip(" \t\r\n+"):
                continue
            continue
        if kind == "v":
            settle()
            chain = []
            _bare(text, a, b, found, language, cues)
            previous_end = b
            continue
        ia, ib = a + 1, b - 1 if b - a > 1 and text[b - 1] == text[a] else b
        gap = text[chain_end:a] if chain else ""
        if chain and len(gap) < 200 and _JOIN.match(gap):
            chain.append((ia, ib))
        else:
            settle()
            names = [*names[-7:], (chain[0][0], chain[-1][1], chain_end)] if chain else names[-8:]
            chain, chain_before = [(ia, ib)], a
        chain_end = previous_end = b
    settle()
    if language in ("sql", ""):
        found += _sql_values(text) if language == "sql" else []
        if not language:
            found += [[x] for x in _inner(text, 0, len(text))] + _pem_blocks(text, [(0, len(text))])
    unique: dict[int, list[tuple[int, int]]] = {}
    for spans in found:
        unique.setdefault(spans[0][0], spans)
    out: list[list[tuple[int, int]]] = []
    for start in sorted(unique):
        if not out or start >= out[-1][-1][1]:
            out.append(unique[start])
    return out


_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY")
#: A line of a key block in a comment or raw text: its marks, then the value.
_PEM_LINE = re.compile(r"(?m)^[ \t]*(?:(?://|--|\#|\*|;|\{|\(\*)[ \t]*)?+([^\s\"'`\\][^\r\n]*?)[ \t\r]*$")
_PEM_NEXT = re.compile(r"[^\n]*\n[ \t]*(?://|--|\#|\*|;)?[ \t]*[A-Za-z0-9+/=]{8,}[ \t\r]*(?=\n|\Z)")
_PEM_RUN = re.compile(r"\\[nrt\"'\\\n]|((?:[^\\\r\n\"'`]|\\[^nrt\"'\\\n])+)")


def _pem_blocks(text: str, pieces: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Key blocks in the pieces of a literal, in a comment or in raw text: the mark, then all up to the end mark.

    A block whose end is missing runs to the end of its literal, or as far as its lines look like a key.
    """
    out = []
    first, last = pieces[0][0], pieces[-1][1]
    literal = first > 0 and text[first - 1] in "'\"`"
    for m in _PEM.finditer(text, first, last):
        begin = _PEM.search(text, m.end())
        end = _PEM_END.search(text, m.end(), begin.start() if begin else len(text))
        if end:
            stop = end.start()
        elif literal:
            stop = last
        else:
            stop = m.end()
            while n := _PEM_NEXT.match(text, stop):
                stop = n.end()
        if literal:
            spans = [x.span(1) for a, b in pieces if b > m.end() and a < stop for x in _PEM_RUN.finditer(text, max(a, m.end()), min(b, stop)) if x[1] and x[1].strip()]
        else:
            line = text.find("\n", m.end(), stop) + 1 or stop
            spans = [x.span(1) for x in _PEM_LINE.finditer(text, line, stop)] or [x.span(1) for x in _PEM_RUN.finditer(text, m.end(), stop) if x[1] and x[1].strip()]
        body = "".join(text[a:b] for a, b in spans)
        if re.search(r"[A-Za-z0-9+/=]{24,}", body) and len(set(body)) > 8 and not re.search(r"(?i)placeholder|your[-_ ]|\.\.\.\s*$", body):
            out.append([(m.start(), m.end()), *spans])
    return out


def _bare(text: str, a: int, b: int, found: list, language: str, cues: Cues) -> None:
    """A value without quotes: ``name=value`` lines and XML elements."""
    line = text.rfind("\n", 0, a) + 1
    if language == "ini":
        name = text[line:a].rstrip("= \t").strip()
    elif language == "keyed":
        name = re.sub(r"^(?:-|export)[ \t]+", "", text[line:a].strip()).rstrip("=: \t").replace("-", "_")
    else:
        m = re.search(r"<([\w.:-]+)[^<>]*>\s*$", text[max(0, a - 200) : a])
        name = m[1] if m else ""
    v = text[a:b].strip(" \t\"'")
    at = text.find(v, a) if v else a
    if names_credential(name) and usable(v):
        found.append([(at, at + len(v))])
    elif names_key(name) and random_looking(v) and usable(v):
        found.append([(at, at + len(v))])
    elif cues.within(a, b):
        found += [[x] for x in _inner(text, a, b)] + _pem_blocks(text, [(a, b)])


def _judge(text: str, chain: list[tuple[int, int]], before: int, names: list, found: list, language: str, cues: Cues) -> None:
    value = "".join(text[a:b] for a, b in chain)
    if len(value) < 5:
        return
    whole = (chain[0][0], chain[-1][1])
    if _PEM.search(value):
        found += _pem_blocks(text, chain)
        return
    token = len(chain) > 1 and re.fullmatch(r"[\w.+/=~-]+", value)  # one value in pieces, whatever a piece looks like
    inner = [] if token else [x for a, b in chain for x in _inner(text, a, b)] if cues.within(*whole) or _SHAPE.search(value) else []
    if inner:
        found += [[x] for x in inner]
        return
    if len(chain) > 1 and (m := _ISSUED.search(value)) and m.start() == 0:
        found.append(list(chain))
        return
    if not assigned(value):
        return
    plain = usable(value)  # anything else counts only where it is assigned outright
    left = text[max(0, before - 240) : before]
    tail = left.rstrip()
    m = _BEFORE.search(left, max(0, len(left) - 120)) if tail[-1:] in _ASSIGNS else None
    if m and m[2] not in ("<>", "!=", "=="):
        name = m[1].lstrip("@")
        if names_credential(name) or (names_key(name) and random_looking(value)):
            found.append(list(chain))
            return
        if not plain:
            return
        if name.lower() in ("value", "val", "wert", "setting_value", "v") and _where_name(text, whole[1]):
            found.append(list(chain))
        if language != "form" or m[2] != "=":
            return
    if not plain:
        return
    if _BY.search(left, max(0, len(left) - 60)):
        found.append(list(chain))
        return
    if names:
        na, nb, nend = names[-1]
        between = text[nend : before]
        key = text[na:nb]
        if re.fullmatch(r"\s*[:,]\s*[NnEe]?|\s*=>\s*", between) and len(key) < 60 and re.fullmatch(r"[\w .-]+", key):
            if names_credential(key.replace("-", "_")) or (re.search(r"(?i)key$", key) and random_looking(value)):
                found.append(list(chain))
                return
    c = _CALL.search(left) if "(" in left else None
    if c:
        call = c[1].rsplit(".", 1)[-1].lower()
        args = left[c.end(1) :].count(",")
        if call in _LOGIN_CALLS and args >= 1 and re.search(r",\s*$", left):
            found.append(list(chain))
        elif call in _TOKEN_CALLS and args == 0 and not re.fullmatch(r"[a-z_ ]+", value):
            found.append(list(chain))
        elif call not in _LOOKUP_CALLS and args == 0 and names_credential(c[1].rsplit(".", 1)[-1]) and re.search(r"\d", value):
            found.append(list(chain))


def _where_name(text: str, end: int) -> bool:
    """``SET val = '…' WHERE name = 'smtp_password'``."""
    m = re.compile(r"'?\s*,?[^;']*\bWHERE\s+\w+\s*=\s*N?'([^']*)'", re.I).match(text, end)
    return bool(m) and (names_credential(m[1].replace("-", "_")) or bool(re.search(r"(?i)key$", m[1])))


_INSERT = re.compile(r"(?is)\binsert\s+into\s+[\w.\[\]`\"]+\s*\((?P<cols>[^()]*)\)\s*values\s*(?P<rows>(?:\((?:[^()']|'(?:[^']|'')*'|\([^()]*\))*\)\s*,?\s*)+)")
_ITEM = re.compile(r"(?s)\s*(?P<x>N?'(?:[^']|'')*'|\([^()]*\)|[^,()']+(?:\([^()]*\))?)\s*(?:,|$)")
_TUPLE = re.compile(r"(?s)\((?P<t>(?:[^()']|'(?:[^']|'')*'|\([^()]*\))*)\)")


def _sql_values(text: str) -> list[list[tuple[int, int]]]:
    """Values inserted into credential-named columns."""
    out = []
    if not re.search(r"(?i)insert", text):
        return out
    for m in _INSERT.finditer(text):
        wanted = [i for i, c in enumerate(m["cols"].split(",")) if names_credential(c.strip(" \t\r\n`\"[]"))]
        if not wanted:
            continue
        for t in _TUPLE.finditer(text, m.start("rows"), m.end("rows")):
            for i, x in enumerate(_ITEM.finditer(text, t.start("t"), t.end("t"))):
                if i in wanted and x["x"].lstrip("N").startswith("'"):
                    a, b = x.start("x") + x["x"].index("'") + 1, x.end("x") - 1
                    if usable(text[a:b]):
                        out.append([(a, b)])
    return out


_UNIT = re.compile(r"(?s)\\(?:u\{[0-9A-Fa-f]+\}|U[0-9A-Fa-f]{8}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|[0-7]{3}|.)|&\#x[0-9A-Fa-f]+;|&\#\d+;|&\w+;|%[0-9A-Fa-f]{2}|''|\"\"|.")


def masked(unit: str) -> str:
    """One character or escape of a value as ``x``; escapes keep their form, line breaks and escaped delimiters stay."""
    if unit[0] == "\\" and len(unit) > 2:
        if unit[1:3] == "u{":
            return "\\u{78}"
        return "\\170" if unit[1].isdigit() else unit[:2] + "78".rjust(len(unit) - 2, "0")
    if unit[0] == "&" and len(unit) > 1:
        return unit if unit[1] != "#" else "&#x78;" if unit[2] in "xX" else "&#120;"
    if unit[0] == "%" and len(unit) == 3:
        return "%78"
    return unit if unit in ("\r", "\n", "''", '""') or unit[0] == "\\" else "x"


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """Every character of the spans becomes ``x`` (see :func:`masked`); all around them stays.

    Character codes between the pieces of a Pascal literal (``'a'#98'c'``) are part of the value too.
    """
    out, at = [], 0
    for a, b in sorted(spans):
        a = max(a, at)
        between = text[at:a]
        if at and re.fullmatch(r"'(?:\#\d+|\s|\+)*'?", between[:200]) and len(between) < 200:
            between = re.sub(r"\#(\d+)", lambda m: m[0] if int(m[1]) < 32 else "#120", between)
        body = text[a:b]
        out += [between, body if _PEM.fullmatch(body) else "".join(masked(u) for u in _UNIT.findall(body))]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_lines(files: DataFrame) -> DataFrame:
    """``(id, filePath, content) → (fileId, lineNumber)``, one row per line on which a credential begins.

    Null or empty contents give no rows, null paths are judged by their content, repeated rows repeat
    their results. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, lines = [], []
            for i, path, text in zip(b["id"], b["filePath"], b["content"]):
                if text:
                    at = Lines(text)
                    for n in dict.fromkeys(at.of(x[0][0]) for x in find_secrets(path, text)):
                        ids.append(i)
                        lines.append(n)
            yield pd.DataFrame({"fileId": pd.Series(ids, dtype="int64"), "lineNumber": pd.Series(lines, dtype="int32")})

    kept = files.select("id", "filePath", "content").where(F.col("content").isNotNull() & F.col("id").isNotNull())
    return kept.mapInPandas(run, "fileId long, lineNumber int")


def redacted_files(files: DataFrame) -> DataFrame:
    """``(fileId, secrets, content)``: every file, its number of credentials, and its text with them masked; null stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts, texts = [], []
            for path, text in zip(b["filePath"], b["content"]):
                got = find_secrets(path, text) if text else []
                counts.append(len(got))
                texts.append(redact(text, [s for x in got for s in x]) if got else text)
            yield pd.DataFrame({"fileId": b["id"], "secrets": pd.Series(counts, dtype="int32"), "content": pd.Series(texts, dtype=object)})

    return files.select("id", "filePath", "content").mapInPandas(run, "fileId long, secrets int, content string")
