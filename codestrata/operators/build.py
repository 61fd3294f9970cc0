"""Build metadata: what project files declare, and findings about what they need and do not have.

One narrow pass turns every file into typed records; findings are joins and aggregates over them.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.operators.extract import _per_file
from codestrata.operators.scanner import LineNumbers, Token, comma_parts, dotted_name, first_word, is_word, lines_of, plain

RECORD = "projectId long, fileId long, file string, kind string, value string, detail string, line int, condition string"
EXTENSIONS = ("pas", "dpr", "dpk", "inc", "dproj", "bdsproj", "groupproj", "cfg", "dof", "rc")
#: XML metadata above so many bytes is not parsed.
XML_LIMIT = 1_000_000

# Tags of project files, standard units and packages.
TAGS = {
    "configuration": {"config"},
    "platform": {"platform"},
    "define": {"dcc_define"},
    "search": {"dcc_unitsearchpath", "searchpath"},
    "include": {"dcc_includepath", "includepath"},
    "output": {"outputdir", "dcc_outputneverbuilddcus", "dcc_dcuoutput", "dcc_exeoutput", "dcc_bploutput", "dcc_dcpoutput"},
    "requires": {"dcc_usepackage"},
    "runtime": {"runtimeonlypackage", "buildwithruntimepackages"},
}
REFERENCE_TAGS = {"projects", "project", "target"}
STANDARD_UNITS = ("system", "sysutils", "classes", "variants", "windows", "messages", "controls", "forms", "dialogs", "graphics", "db", "dbctrls", "dbgrids", "sqlexpr", "math", "types", "strutils", "dateutils", "contnrs", "rtlconsts")
STANDARD_PREFIXES = ("system.", "system.net.", "winapi.", "vcl.", "data.", "xml.", "web.", "soap.", "datasnap.", "firedac.", "fmx.", "rest.")
STANDARD_PACKAGES = ("rtl", "vcl", "vclx", "dbrtl", "vcldb", "xmlrtl", "soaprtl", "dsnap", "fmx", "fmxase", "firedac", "designide")
SCORE = {"blocker": 15, "error": 8, "warning": 3, "info": 0}

# Switches of compiler options, at the start of a line or anywhere in it, by what they set.
SWITCHES = {
    "define": (("-D",), ("Defines=",)),
    "search": (("-U",), ("UnitSearchPath=",)),
    "include": (("-I",), ("IncludePath=",)),
    "output": (("-E",), ("-N0", "-N", "OutputDir=")),
    "requires": (("-LU",), ("UsePackages=",)),
}
# Kinds of resources that are read from a file.
RESOURCE_KINDS = ("ICON", "BITMAP", "RCDATA", "HTML")


def _clauses(tokens: list[Token], word: str) -> Iterator[list[Token]]:
    """What stands between a word and the next semicolon."""
    start = None
    for i, t in enumerate(tokens):
        if start is None and is_word(t, word):
            start = i + 1
        elif start is not None and t.text == ";":
            yield tokens[start:i]
            start = None


def _header(text: str, word: str) -> str | None:
    """The dotted name of a ``unit x;`` or ``package x;`` line."""
    for line in lines_of(text):
        if first_word(line) == word:
            t = plain(line)
            parts, at = dotted_name(t, 1)
            if parts and at < len(t) and t[at].text == ";":
                return ".".join(parts)
    return None


def _placed(text: str, tokens: list[Token]) -> Iterator[tuple[Token, str, int, str]]:
    """``name in 'path'``: the name's first token, the name, the offset of the path, the path."""
    for i, t in enumerate(tokens):
        if is_word(t, "in") and i and i + 1 < len(tokens) and tokens[i + 1].text in "'\"":
            quote = tokens[i + 1]
            end = min((e for q in "'\"" if (e := text.find(q, quote.end)) >= 0), default=-1)
            a = i - 1
            while a > 1 and tokens[a - 1].text == "." and tokens[a - 2].kind == "w" and tokens[a - 2].end + 1 == tokens[a].start:
                a -= 2
            if end > quote.end and tokens[a].kind == "w":
                yield tokens[a], text[tokens[a].start : tokens[i - 1].end], quote.end, text[quote.end : end]


def record_rows(file: str, text: str) -> Iterator[tuple]:
    """``(kind, value, detail, line, condition)``: what a file of a build declares and refers to."""
    ext, base = file.rsplit(".", 1)[-1].lower(), file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    low, numbers = text.lower(), LineNumbers(text)

    def line_of(literal: str) -> int | None:
        at = low.find(literal.lower())
        return numbers.of(at) if at >= 0 else None

    yield "file", file.lower(), ext, 1, None
    if ext in ("pas", "dpr", "dpk", "inc"):
        t = plain(text)
        yield "unit", _header(text, "unit") or base, None, 1, None
        for clause in _clauses(t, "uses"):
            for part in comma_parts(clause):
                if name := ".".join(dotted_name(part, 0)[0]):
                    yield "uses", name, None, line_of(name), None
        for first, name, at, path in _placed(text, t):
            yield "explicit", path, name, numbers.of(at), None
            yield "uses", name, None, numbers.of(first.start), None
        at = low.find("{$r")
        while at >= 0:
            end = text.find("}", at)
            name = text[at + 3 : end].strip().strip("'\"") if end > 0 and text[at + 3].isspace() else ""
            if name and name != "*.res":
                yield "resource", name, None, numbers.of(at), None
            at = low.find("{$r", at + 3)
    if ext in ("dpr", "dpk"):
        yield "entry", file, "project" if ext == "dpr" else "package", 1, None
    if ext == "dpk":
        for name in {(_header(text, "package") or base).lower(), base.lower()}:
            yield "package", name, None, 1, None
        for clause in _clauses(plain(text), "requires"):
            for part in text[clause[0].start : clause[-1].end].split(",") if clause else ():
                name = next(iter(part.split()), "")
                if name and (name[0].isalnum() or name[0] in "_$.\\/"):
                    yield "requires", name, None, line_of(name), None
    if ext in ("dproj", "bdsproj", "groupproj"):
        yield "metadata", file, ext, 1, None
        yield from _xml_rows(file, text, ext, line_of)
    if ext in ("cfg", "dof"):
        yield "metadata", file, ext, 1, None
        for line in re.split(r"[\r\n]+", text):
            for kind, value in _switches(line):
                for part in value.replace(",", ";").split(";") if kind == "requires" else value.split(";"):
                    if part := part.strip():
                        yield kind, part, None, line_of(part), None
    if ext == "rc":
        yield "metadata", file, ext, 1, None
        for i, line in enumerate(lines_of(text)):
            words = line.split(None, 2)
            if len(words) == 3 and words[1].upper() in RESOURCE_KINDS and words[2][0] in "'\"":
                path = re.split("[\"']", words[2][1:], maxsplit=1)
                if len(path) == 2 and path[0]:
                    yield "resource", path[0], None, i + 1, None


def _switches(line: str) -> Iterator[tuple[str, str]]:
    """What the switches of a line set; of one kind the leftmost counts, and its value is the rest of the line."""
    low = line.lower()
    for kind, (leading, anywhere) in SWITCHES.items():
        places = [(0, len(x)) for x in leading if low.startswith(x.lower())]
        places += [(at, len(x)) for x in anywhere if (at := low.find(x.lower())) >= 0]
        if places:
            at, size = min(places, key=lambda p: (p[0], -p[1]))
            yield kind, line[at + size :]


def _xml_rows(file: str, text: str, ext: str, line_of) -> Iterator[tuple]:
    large = len(text.encode()) > XML_LIMIT
    if large or "<!ENTITY" in text:
        yield "limited", file, "too large" if large else "entities", 1, None
        return
    try:
        root = ET.fromstring(text.lstrip("﻿ \r\n\t"))
    except ET.ParseError:
        yield "limited", file, "malformed", 1, None
        return
    stack = [(root, None)]
    while stack:
        node, inherited = stack.pop()
        condition = (node.get("Condition") or "").strip() or inherited
        tag = node.tag.rsplit("}", 1)[-1].lower() if isinstance(node.tag, str) else ""
        value = (node.text or "").strip()
        for kind, tags in TAGS.items():
            if tag in tags and value:
                for part in re.split(r"[;,]+" if kind in ("define", "requires", "runtime") else r"[;\r\n]+", value):
                    if part.strip():
                        yield kind, part.strip(), None, line_of(part.strip()), condition
        for a in ("Personality", "Version"):
            if (node.get(a) or "").strip():
                yield "compiler", f"{a}={node.get(a)}", None, None, condition
        if tag == "mainsource" or "projectguid" in tag:
            yield "compiler", f"{'MainSource' if tag == 'mainsource' else 'ProjectGUID'}={value}", None, None, condition
        if ext == "groupproj" and tag in REFERENCE_TAGS and node.get("Include"):
            yield "member", node.get("Include"), None, line_of(node.get("Include")), condition
        stack += [(c, condition) for c in reversed(list(node))]


def build_records(files: DataFrame) -> DataFrame:
    return _per_file(files, RECORD, EXTENSIONS, record_rows)


def _standard_unit(c: Column) -> Column:
    out = c.isin(*STANDARD_UNITS)
    for p in STANDARD_PREFIXES:
        out = out | c.startswith(p)
    return out


def _standard_package(c: Column) -> Column:
    return c.isin(*STANDARD_PACKAGES) | F.regexp_extract(c, r"^([a-z][a-z0-9]*?)\d+$", 1).isin(*STANDARD_PACKAGES)


def _found(condition: Column, code: str, severity: str, evidence: Column) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), evidence.cast("string").alias("evidence")))


def _exploded(df: DataFrame, findings: list[Column], file: Column, line: Column) -> DataFrame:
    """A row for every finding of a row of ``df``."""
    rows = df.select("projectId", file.alias("file"), line.cast("int").alias("line"), F.explode(F.filter(F.array(*findings), lambda x: x.isNotNull())).alias("f"))
    return rows.select("projectId", "f.code", "f.severity", "file", "line", "f.evidence")


def build_findings(records: DataFrame) -> DataFrame:
    """All findings per project, each once: ``(projectId, code, severity, file, line, evidence)``.

    References of every kind are looked up among the files in one join and judged in one pass; what a project has
    or lacks as a whole comes from one aggregate.
    """
    of = lambda *kinds: records.where(F.col("kind").isin(*kinds))
    none, value, kind = F.lit(None), F.col("value"), F.col("kind")
    known = of("file").select("projectId", F.col("value").alias("resolved")).distinct().withColumn("there", F.lit(True))
    target = P.resolved_relative(P.dirname(F.col("file")), F.regexp_replace(F.trim("value"), r"^['\"]|['\"]$", ""))
    refs = of("explicit", "search", "include", "output", "resource", "member", "limited").withColumn("resolved", F.lower(target)).join(known, ["projectId", "resolved"], "left")
    gone = F.col("resolved").isNotNull() & F.col("there").isNull()
    local = kind.isin("explicit", "search", "include", "output")
    up = ~value.rlike(r"\$\([^)]+\)|%[^%]+%") & P.collapsed(value).rlike(r"(^|/)\.\.(/|$)")
    judged = [
        _found(local & P.is_absolute(value) & ~value.startswith("\\"), "DELPHI_ABSOLUTE_SEARCH_PATH", "warning", value),
        _found(local & up, "DELPHI_ESCAPING_SEARCH_PATH", "warning", value),
        _found((kind == "explicit") & gone, "DELPHI_EXPLICIT_UNIT_PATH_MISSING", "blocker", value),
        _found((kind == "resource") & gone & ~F.contains(value, F.lit("*")), "DELPHI_RESOURCE_REFERENCE_MISSING", "warning", value),
        _found((kind == "member") & gone, "DELPHI_GROUP_PROJECT_REFERENCE_MISSING", "warning", value),
        _found(kind == "limited", "DELPHI_CONFIG_PARSE_LIMITED", "warning", F.col("detail")),
    ]
    parts = [_exploded(refs, judged, F.col("file"), F.col("line"))]

    members = refs.where((kind == "member") & F.col("resolved").isNotNull())
    twice = members.join(members.groupBy("projectId", "resolved").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["projectId", "resolved"], "left_semi")
    parts.append(_exploded(twice, [_found(F.lit(True), "DELPHI_GROUP_PROJECT_REFERENCE_DUPLICATE", "warning", value)], F.col("file"), F.col("line")))

    # units that are declared, used, or whose place in the project is missing, side by side
    unit = F.lower(F.trim("value"))
    sides = of("unit", "uses").select("projectId", unit.alias("unit"), "kind", "value").unionByName(refs.where((kind == "explicit") & gone).select("projectId", F.lower("detail").alias("unit"), F.lit("gone").alias("kind"), "value"))
    n = lambda k: F.count_if(F.col("kind") == k)
    u = sides.groupBy("projectId", "unit").agg(n("unit").alias("declared"), n("gone").alias("gone"), F.min(F.when(F.col("kind") == "uses", F.col("value"))).alias("used"))
    lost = F.col("used").isNotNull() & (F.col("declared") == 0) & (F.col("gone") == 0) & ~_standard_unit(F.col("unit"))
    parts.append(_exploded(u, [_found(F.col("declared") > 1, "DELPHI_UNIT_AMBIGUOUS", "warning", F.col("unit")), _found(lost, "DELPHI_UNIT_UNRESOLVED", "warning", F.col("used"))], none.cast("string"), none))

    has = lambda k: F.max(kind == k)
    values = lambda k: F.array_join(F.array_sort(F.collect_set(F.when(kind == k, value))), ", ")
    p = records.groupBy("projectId").agg(has("entry").alias("entry"), has("metadata").alias("metadata"), has("compiler").alias("compiler"), has("runtime").alias("runtime"), has("define").alias("define"), values("runtime").alias("runtimes"), values("define").alias("defines"))
    whole = [
        _found(~F.col("entry"), "DELPHI_PROJECT_ENTRY_MISSING", "warning", F.lit("")), _found(~F.col("metadata"), "DELPHI_PROJECT_METADATA_MISSING", "warning", F.lit("")),
        _found(~F.col("compiler"), "DELPHI_COMPILER_VERSION_UNCERTAIN", "warning", F.lit("")), _found(F.col("runtime"), "DELPHI_RUNTIME_PACKAGE_DETECTED", "info", F.col("runtimes")),
        _found(F.col("define"), "DELPHI_CONDITIONAL_DEFINE_DETECTED", "info", F.col("defines")),
    ]
    parts.append(_exploded(p, whole, none.cast("string"), none))

    is_ = lambda r: F.col("resolution") == r
    packages = [_found(is_("missing"), "DELPHI_PACKAGE_MISSING", "blocker", F.col("package")), _found(is_("ambiguous"), "DELPHI_PACKAGE_AMBIGUOUS", "warning", F.col("package")), _found(is_("external_unverified"), "DELPHI_PACKAGE_UNRESOLVED", "warning", F.col("package"))]
    parts.append(_exploded(package_resolutions(records), packages, none.cast("string"), none))
    return reduce(DataFrame.unionByName, parts).distinct()


def package_resolutions(records: DataFrame) -> DataFrame:
    """Required packages and what they are: missing, project_local, ambiguous, delphi_standard or external_unverified."""
    needed = records.where(F.col("kind") == "requires").withColumn("key", F.lower(F.trim("value")))
    explicit = F.col("value").rlike(r"(?i)[\\/]|\.dpk$|\.dproj$")
    needed = needed.withColumn("resolved", F.when(explicit, F.lower(P.resolved_relative(P.dirname(F.col("file")), F.trim("value")))))
    known = records.where(F.col("kind") == "file").select("projectId", F.col("value").alias("resolved")).distinct().withColumn("there", F.lit(True))
    n = needed.join(known, ["projectId", "resolved"], "left")
    g = n.groupBy("projectId", "key").agg(F.min("value").alias("package"), F.max(F.col("resolved").isNotNull() & F.col("there").isNull()).alias("gone"))
    local = records.where(F.col("kind") == "package").select("projectId", F.col("value").alias("name"), F.col("file").alias("localFile"))
    keys = g.select("projectId", "key", F.explode(F.array_distinct(F.array("key", P.stem(F.col("key"))))).alias("name"))
    matches = keys.join(local, ["projectId", "name"]).groupBy("projectId", "key").agg(F.count_distinct("localFile").alias("n"))
    g = g.join(matches, ["projectId", "key"], "left")
    kind = F.when(F.col("gone"), "missing").when(F.col("n") == 1, "project_local").when(F.col("n") > 1, "ambiguous").when(_standard_package(F.col("key")), "delphi_standard").otherwise("external_unverified")
    return g.select("projectId", "package", kind.alias("resolution"))


def build_scores(findings: DataFrame) -> DataFrame:
    """Score (100 less 15, 8 or 3 a finding, not below 0) and status per project."""
    lost = F.lit(0)
    for s, w in SCORE.items():
        lost = lost + F.count_if(F.col("severity") == s) * w
    status = F.when(F.count_if(F.col("severity") == "blocker") > 0, "blocked").when(F.count_if(F.col("severity").isin("error", "warning")) > 0, "ready_with_warnings").otherwise("ready")
    return findings.groupBy("projectId").agg(F.greatest(F.lit(0), 100 - lost).cast("int").alias("score"), status.alias("status"), F.count("*").alias("findings"))
