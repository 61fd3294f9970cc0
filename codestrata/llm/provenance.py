"""Problem 2: files nobody wrote by hand (generated, minified, third-party, data stored as code).

Evidence, each a reason code of :func:`classify_provenance`:

* ``notice``    a generation notice in a comment near the top of the file, found with one
                Aho-Corasick automaton over case-folded comment text (phrases of several languages);
* ``licence``   a third-party header: a distribution's licence sentence or contributors' copyright;
* ``path``      vendored folders, lock files, minified and generated name suffixes;
* ``minified``  code packed into very long, dense lines;
* ``data``      most of the text is literal data (byte tables, base64, hex, delimited rows, inserts).

Forms (.dfm, .fmx), project and configuration files count as hand-written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that announce a generator. Each group must be present in one comment line.
GENERATION_NOTICES: tuple[tuple[str, ...], ...] = (
    ("code generated by",),
    ("@generated",),
    ("automatically generated by",),
    ("automatically generated from",),
    ("auto-generated from",),
    ("auto-generated by", "do not"),
    ("autogenerated by", "do not"),
    ("auto-generated file",),
    ("autogenerated file",),
    ("generated file", "do not"),
    ("generated code", "do not"),
    ("generated automatically",),
    ("this file was generated",),
    ("this file is generated",),
    ("this unit was generated",),
    ("generated by", "do not edit"),
    ("generated by", "do not modify"),
    ("generated by", "will be lost"),
    ("generated by", "overwritten"),
    ("generated from", "do not"),
    ("written by", "overwritten"),
    ("created by", "edit the template"),
    ("created by", "at build time"),
    ("changes will be lost", "generated"),
    ("produced by", "do not edit"),
    ("automatisch", "erzeugt", "nicht"),
    ("automatisch", "generiert", "nicht"),
    ("produit automatiquement",),
    ("généré automatiquement",),
    ("généré par", "ne pas"),
    ("generado automáticamente",),
    ("generado por", "no modificar"),
    ("gerado automaticamente",),
    ("gerado por", "não"),
    ("wygenerowany automatycznie",),
    ("wygenerowano automatycznie",),
    ("сгенерирован автоматически",),
    ("автоматически сгенерирован",),
    ("создан автоматически",),
    ("自動產生",),
    ("自动生成",),
    ("自動生成",),
    ("자동으로 생성",),
    ("자동 생성",),
)
# Phrases that deny or merely discuss generation ("generated by the database").
NOTICE_DENIALS = ("by the database", "by the nightly", "by hand, not", "not generated", "no longer generated", "was once generated")
# Sentences of third-party headers.
LICENCE_NOTICES: tuple[tuple[str, ...], ...] = (
    ("permission to use and distribute this software",),
    ("permission is hereby granted",),
    ("permission to use, copy",),
    ("redistribution and use in source and binary",),
    ("redistribution in source and binary forms",),
    ("contents of this file are subject to",),
    ("copyright", "contributors"),
    ("copyright", "version", "authors"),
    ("licensed under the apache license",),
    ("licensed under the mit license",),
    ("mozilla public license",),
    ("gnu general public license",),
    ("gnu lesser general public license",),
    ("spdx-license-identifier",),
    ("this software is provided", "as is"),
)

HAND_EXT = r"(?i)\.(dfm|fmx|dproj|dof|cfg|groupproj|bdsproj|bpg|ini|conf|toml|yaml|yml|properties|config)$"
VENDOR_DIR = (
    r"(?i)(^|/)(third[_-]?party(s)?|3rd[_-]?party|externals?|node_modules|bower_components|jspm_packages"
    r"|vendored|vendor|site-packages|Godeps|extlibs?|external[_-]libs?)/"
    r"|(?i)(^|/)components/[^/]+/(source|src|lib)/"
)
LOCK_FILE = r"(?i)(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|go\.sum|Cargo\.lock|composer\.lock|poetry\.lock|Gemfile\.lock|[^/]+\.lock)$"
GENERATED_NAME = (
    r"(?i)(_TLB\.pas|_string\.go|\.pb\.go|_pb2?\.\w+|\.gen\.\w+|_gen\.go|\.generated\.\w+|_generated\.\w+"
    r"|\.g\.\w+|\.designer\.\w+|[._-]dump\.sql|\.dump\.sql)$|(?i)(^|/)(zz_generated[^/]*|bindata\.go|[^/]*_dump_\d+\.sql|[^/]*\.dump\.\d*\.?sql)$"
)
MINIFIED_NAME = r"(?i)[._-](min|packed|minified|compressed)\.\w+$"

#: The head of a file: its first lines, and how many lines of code end it sooner (the method looks at headers only).
HEADER_LINES, HEADER_CODE_LINES = 60, 12
DENSE_LINE, DENSE_SHARE, BLANK_SHARE, DATA_SHARE = 400, 0.8, 0.16, 0.9

_COMMENT = re.compile(r"^[ \t]*(//|--|\{(?!\$)|\(\*|/\*|\*|;|#|<!--|rem\b|')", re.I)
_DATA = re.compile(
    r"(?:(?:0x|\$)[0-9A-Fa-f]{2,8}[ \t\r\n]*,[ \t\r\n]*){6,}(?:0x|\$)?[0-9A-Fa-f]*"  # byte tables
    r"|(?:[-+]?\d+(?:\.\d+)?[ \t\r\n]*,[ \t\r\n]*){12,}"  # number tables
    r"|0x[0-9A-Fa-f]{48,}"  # hex literals
    r"|(?:^[ \t]*['\"`]?[A-Za-z0-9+/]{48,}={0,2}['\"`]?[ \t]*(?:\+|,|;|\+[ \t]*\w+[ \t]*\+)?[ \t]*\r?\n?){3,}"  # base64 blocks
    r"|[A-Za-z0-9+/]{120,}={0,2}",
    re.M,
)
_INSERT = re.compile(r"INSERT[ \t]+INTO\b(?:(?!\bINSERT\b)[^;])*?\bVALUES\b(?:[^;']|'(?:[^']|'')*')*;", re.I)
_ROW = re.compile(r"^[^\s;,|(){}'\"=]*(?:([;,|\t])[^\s;,|(){}'\"=]*)(?:\1[^;,|(){}'\"=\n]*)+\r?$", re.M)
_ENTRY = re.compile(
    r"^[ \t]*(?:[\"'`][^\"'`\n]*[\"'`][ \t]*[:,][^\n]*|\{?[ \t]*[\"'`][^\"'`\n]*[\"'`](?:,[^,\n]+)+\}?,?"
    r"|\(?[ \t]*(?:'(?:[^'\n]|'')*'|[-+]?[\d.]+|NULL)(?:[ \t]*[,;:][ \t]*(?:'(?:[^'\n]|'')*'|[-+]?[\d.]+|NULL))+[ \t]*\)?[,;]?)[ \t]*\r?$",
    re.M,
)


def _automaton():
    import ahocorasick

    a, groups = ahocorasick.Automaton(), {}
    for kind, table in (("notice", GENERATION_NOTICES), ("licence", LICENCE_NOTICES), ("denial", tuple((x,) for x in NOTICE_DENIALS))):
        for g, phrases in enumerate(table):
            for p in phrases:
                groups.setdefault(p, []).append((kind, g, len(phrases)))
    for p, owners in groups.items():
        a.add_word(p, (p, owners))
    a.make_automaton()
    return a


def header_lines(text: str) -> list[str]:
    """Comment lines of a file's head: up to the point where real code has clearly begun."""
    out, code, inside = [], 0, ""
    for n, line in enumerate(text.split("\n", HEADER_LINES)[:HEADER_LINES]):
        s = line.strip()
        if inside:
            out.append(s)
            if inside in s:
                inside = ""
        elif _COMMENT.match(line) and not s.startswith("#include"):
            out.append(s)
            for o, c in (("/*", "*/"), ("(*", "*)"), ("{", "}"), ("<!--", "-->")):
                if s.startswith(o) and c not in s[len(o) :]:
                    inside = c
        elif s:
            code += 1
            if code > HEADER_CODE_LINES:
                break
    return out


def header_evidence(text: str, automaton) -> str | None:
    """'notice' or 'licence' if a comment line of the head holds all phrases of one entry."""
    found = None
    for line in header_lines(text):
        low, hits, denied = line.lower(), {}, False
        for _, (phrase, owners) in automaton.iter(low):
            for kind, g, n in owners:
                if kind == "denial":
                    denied = True
                else:
                    hits.setdefault((kind, g, n), set()).add(phrase)
        if denied:
            continue
        for (kind, _, n), got in hits.items():
            if len(got) == n:
                if kind == "notice":
                    return kind
                found = kind
    return found


def is_dense(text: str) -> bool:
    """Minified: at least DENSE_SHARE of the characters lie in very long lines with hardly a blank."""
    if len(text) < DENSE_LINE:
        return False
    long_lines = [x for x in text.split("\n") if len(x) >= DENSE_LINE]
    size = sum(map(len, long_lines))
    if size < DENSE_SHARE * len(text):
        return False
    blanks = sum(x.count(" ") + x.count("\t") for x in long_lines)
    marks = sum(x.count(";") + x.count("{") + x.count("(") for x in long_lines)
    return blanks < BLANK_SHARE * size and marks > 0.01 * size


def data_share(text: str) -> float:
    """Share of the non-blank characters that is literal data."""
    total = len(text) - text.count(" ") - text.count("\n") - text.count("\t") - text.count("\r")
    if not total:
        return 0.0
    spans: list[tuple[int, int]] = [m.span() for m in _DATA.finditer(text)]
    if "nsert" in text or "NSERT" in text:
        spans += [m.span() for m in _INSERT.finditer(text)]
    lines = text.count("\n") + 1
    for p in (_ROW, _ENTRY):
        rows = [m.span() for m in p.finditer(text)]
        if len(rows) >= max(8, 0.3 * lines):
            spans += rows
    spans.sort()
    n, end = 0, -1
    for a, b in spans:
        a = max(a, end)
        if b > a:
            s = text[a:b]
            n += len(s) - s.count(" ") - s.count("\n") - s.count("\t") - s.count("\r")
            end = b
    return n / total


def path_evidence(path: Column) -> Column:
    """JVM-side path rules over a slash-normalised path; null path gives null."""
    p = F.regexp_replace(path, r"\\", "/")
    return (
        F.when(p.rlike(HAND_EXT), F.lit("hand"))
        .when(p.rlike(VENDOR_DIR), F.lit("path"))
        .when(p.rlike(LOCK_FILE) | p.rlike(GENERATED_NAME) | p.rlike(MINIFIED_NAME), F.lit("path"))
    )


def classify_provenance(files: DataFrame) -> DataFrame:
    """``(id, filePath, content) → (fileId, reason)``; one row per file, reason null if hand-written.

    Null paths are judged by content alone, null contents by path alone, empty texts are
    hand-written. Repeated rows give repeated results. No shuffle: one scan, one Arrow pass.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton()
        for b in batches:
            reasons = []
            for path, text in zip(b["pathReason"], b["content"]):
                if path is not None or not text:
                    reasons.append(path)
                    continue
                r = header_evidence(text, automaton)
                if r is None and is_dense(text):
                    r = "minified"
                if r is None and data_share(text) >= DATA_SHARE:
                    r = "data"
                reasons.append(r)
            yield pd.DataFrame({"fileId": b["fileId"], "reason": pd.Series(reasons, dtype=object)})

    narrowed = files.select(F.col("id").alias("fileId"), path_evidence(F.col("filePath")).alias("pathReason"), "content")
    # The text travels to Python only where the path has not settled the matter.
    narrowed = narrowed.withColumn("content", F.when(F.col("pathReason").isNull(), F.col("content")))
    out = narrowed.mapInPandas(judge, "fileId long, reason string")
    return out.withColumn("reason", F.when(F.col("reason") != "hand", F.col("reason")))


def not_hand_written(files: DataFrame) -> DataFrame:
    """Ids of the files with any evidence (query ``p2_found``)."""
    return classify_provenance(files).where(F.col("reason").isNotNull()).select("fileId")
