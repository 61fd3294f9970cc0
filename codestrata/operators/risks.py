"""Risk findings from lines of source, their de-duplication, grouping and scores.

Everything here stays in the JVM: lines are exploded once, patterns become flags, flags become rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.functions import text as T


def source_lines(files: DataFrame) -> DataFrame:
    """``(projectId, file, line, raw, text)``: one row per line, counted from 1; null contents give none."""
    split = F.posexplode(F.split("content", r"\r?\n")).alias("pos", "raw")
    lines = files.where(F.col("content").isNotNull()).select("projectId", F.regexp_replace("filePath", r"\\", "/").alias("file"), "id", split)
    return lines.select("projectId", "file", F.col("id").alias("fileId"), (F.col("pos") + 1).alias("line"), "raw", T.trimmed(F.col("raw")).alias("text"))


# What is detected, as the reports word it: title, severity, category, description, recommendation.
# ``{}`` in a description stands for the text found.
class Detector(NamedTuple):
    title: str
    severity: str
    category: str
    description: str
    recommendation: str
    #: the line must hold the first pattern (or one behind it), and the mark if there is one
    patterns: tuple[str, ...] = ()
    mark: str = ""


DATE_LITERAL = Detector("Date literal embedded in code", "medium", "magic_value", 'Found hard-coded date value "{}" in executable code.', "Promote the value to a named constant or configuration entry.")
NUMBER_LITERAL = Detector("Large numeric literal embedded in code", "medium", "magic_value", 'Found numeric literal "{}" that should be documented or externalized.', "Replace the literal with a named constant and document the business meaning.")
STRING_LITERAL = Detector("String literal with business meaning", "low", "magic_value", 'Found long string literal "{}" embedded in code.', "Consider centralizing repeated business literals.")
MISSING_WHERE = Detector("Write statement without WHERE clause", "critical", "missing_condition", "Detected UPDATE/DELETE statement without a WHERE clause.", "Add an explicit predicate or document why full-table mutation is safe.")
EMPTY_HANDLER = Detector(
    "Broad or empty Delphi exception handling", "high", "other", "Found an except block without a concrete handling action; this can suppress runtime failures.", "Avoid empty exception handlers and handle or log exceptions explicitly.",
    (r"(?i)\bexcept\b",),
)
CONVERSIONS = (
    Detector("Potential date/time conversion inconsistency", "medium", "format_conversion", "Found date/time conversion logic that should be aligned with documented business rules.", "Verify precision, timezone, and canonical format rules against the target system.", (r"(?i)Parse(Time|Date)|Format(Date|Time)|strftime",)),
    Detector("Potential amount conversion inconsistency", "high", "format_conversion", "Found amount conversion logic that should be aligned with documented business rules.", "Verify precision, timezone, and canonical format rules against the target system.", (r"(?i)ParseFloat|Round\(|Truncate\(|Decimal",)),
)
PASCAL = (
    Detector("Delphi field access detected", "low", "other", 'Found FieldByName("{}") usage. Review data access patterns and result validation.', "Confirm that field names are valid and that the data access is protected against missing fields.", (r"(?i)FieldByName\(\s*['\"]([^'\"]+)['\"]\s*\)",)),
    Detector("Delphi query parameter usage detected", "low", "other", 'Found ParamByName("{}"); verify parameters are used consistently with the SQL statement.', "Verify that parameters are applied to parameterized SQL statements rather than string-concatenated queries.", (r"(?i)ParamByName\(\s*['\"]([^'\"]+)['\"]\s*\)",)),
    Detector("Dynamic Delphi SQL construction", "high", "other", "Detected SQL.Add with string concatenation; this can expose the application to SQL injection or broken queries.", "Use parameterized query building and avoid concatenating user input into SQL strings.", (r"(?i)\bSQL\.Add\s*\(",), "+"),
    Detector("Dynamic SQL text assignment", "high", "other", "Detected SQL.Text assignment using string concatenation; this is a common source of query risk.", "Review the SQL text and convert it to parameterized queries where possible.", (r"\bSQL\.Text\b.*:=.*\+",)),
    EMPTY_HANDLER,
    Detector("Delphi database component detected", "low", "other", "Found Delphi database component usage ({}). Review connection and query handling patterns.", "Check whether the component uses parameterized queries and proper transaction boundaries.", (r"(?i)\b(TQuery|TADOQuery|TClientDataSet|TFDQuery|DataSource)\b",)),
    Detector("Hardcoded Delphi path or connection string", "medium", "other", "Detected a hardcoded filesystem path or connection string pattern in Delphi code.", "Move environment-specific values to configuration and avoid literal paths in code.", (r"([A-Za-z]:\\|\\\\)[^\"'\s]+", r"(?i)\b(Database|Data Source|User ID|Password|Pwd|Server|Provider)\b")),
)

# Extensions of Delphi projects, whatever the file holds.
DELPHI = ("pas", "dpr", "dfm", "inc", "dpk", "fmx", "dproj", "groupproj", "bdsproj", "cfg", "dof", "rc", "delphi")

RISK = ("projectId", "fileId", "file", "line", "title", "severity", "category", "description", "recommendation", "snippet")


def _described(d: Detector, found: Column) -> Column:
    before, mark, behind = d.description.partition("{}")
    return F.concat(F.lit(before), found, F.lit(behind)) if mark else F.lit(before)


def _finding(d: Detector, found: Column) -> Column:
    return F.struct(F.lit(d.title).alias("title"), F.lit(d.severity).alias("severity"), F.lit(d.category).alias("category"), _described(d, found).alias("description"), F.lit(d.recommendation).alias("recommendation"))


def _detected(lines: DataFrame, detectors: Sequence[Detector], on: str, also: Mapping[str, Column] | None = None) -> DataFrame:
    """A row for every line and detector that fires on it."""
    c, flags = F.col(on), []
    for d in detectors:
        fires = reduce(lambda a, b: a | b, [c.rlike(p) for p in d.patterns])
        if d.mark:
            fires = fires & F.contains(c, F.lit(d.mark))
        if also and d.title in also:
            fires = fires & also[d.title]
        found = F.regexp_extract(c, d.patterns[0], 1) if "{}" in d.description else F.lit("")
        flags.append(F.when(fires, _finding(d, found)))
    rows = lines.select("projectId", "fileId", "file", "line", F.col("text").alias("snippet"), F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())).alias("f"))
    return rows.select("projectId", "fileId", "file", "line", "f.*", "snippet")


def magic_values(files: DataFrame) -> DataFrame:
    """Literals of business meaning on lines that are no comments: ``RISK`` columns, and the ``value`` and its ``kind``."""
    lines = source_lines(files).where(~F.col("text").startswith("//") & ~F.col("text").startswith("--"))
    literal = lambda pattern, kind: F.transform(F.regexp_extract_all("raw", F.lit(pattern), F.lit(1)), lambda v: F.struct(v.alias("value"), F.lit(kind).alias("kind")))
    both = F.concat(literal(r"[\"']([^\"']{4,})[\"']", "string"), literal(r"\b(\d{4,})\b", "number"))
    found = lines.select("projectId", "fileId", "file", "line", F.col("text").alias("snippet"), F.explode(both).alias("m"))
    v = F.col("m.value")
    dated = v.rlike(r"^\d{8}$|^\d{4}-\d{2}-\d{2}$")
    risk = F.when(dated, _finding(DATE_LITERAL, v)).when(F.col("m.kind") == "number", _finding(NUMBER_LITERAL, v)).when(F.length(v) >= 10, _finding(STRING_LITERAL, F.substring(v, 1, 40)))
    found = found.withColumn("f", risk).where(F.col("f").isNotNull())
    return found.select("projectId", "fileId", "file", "line", "f.*", "snippet", "m.value", "m.kind")


def conversion_risks(files: DataFrame) -> DataFrame:
    """Date or time conversions (medium) and amount conversions (high), by line."""
    return _detected(source_lines(files), CONVERSIONS, "raw")


def pascal_risks(files: DataFrame) -> DataFrame:
    """Pattern findings in the sources, forms and build files of Delphi projects, by line; comment lines are skipped.

    An ``except`` without ``raise`` is empty if, of the up to nine lines that follow, the first that decides
    is ``;`` or ``end``; lines with a handler or an assignment decide against it.
    """
    pascal = files.where(F.lower(F.col("filePath")).rlike(rf"\.({'|'.join(DELPHI)})$"))
    order = W.partitionBy("fileId").orderBy("line")
    lines, t = source_lines(pascal), F.col("text")
    word = F.lower(F.regexp_extract(t, r"(?i)\b(on|raise|begin|try)\b", 1))
    decides = F.when(F.lower(t).isin(";", "end", "end;"), "empty").when((word != "") | F.split_part(t, F.lit(";"), F.lit(1)).contains(":="), "handled")
    lines = lines.withColumn("next", F.first(decides, ignorenulls=True).over(order.rowsBetween(1, 9)))
    comment = reduce(lambda a, b: a | b, [t.startswith(m) for m in ("//", "#", "{", "(*")])
    empty = {EMPTY_HANDLER.title: ~F.lower(t).contains("raise") & (F.col("next") == "empty")}
    return _detected(lines.where((t != "") & ~comment), PASCAL, "text", empty)


def missing_where_risks(statements: DataFrame) -> DataFrame:
    """Statements that change rows without a condition, as risks."""
    f = _finding(MISSING_WHERE, F.lit(""))
    return statements.select("projectId", "fileId", "file", "line", F.col("sql").alias("snippet"), f.alias("f")).select("projectId", "fileId", "file", "line", "f.*", "snippet")


def multiple_write_risks(writes: DataFrame) -> DataFrame:
    """Fields written at several places, as risks at the first of them."""
    name = F.concat_ws(".", F.coalesce("table", F.lit("")), "fieldKey")
    title = F.concat(F.lit("Field "), name, F.lit(" is written from multiple locations"))
    description = F.concat(name, F.lit(" has "), F.col("writes").cast("string"), F.lit(" write operations across the codebase, which raises drift risk."))
    advice = F.lit("Review whether the field should have a single write owner or stronger validation.")
    return writes.select("projectId", F.lit(None).cast("long").alias("fileId"), "file", "line", title.alias("title"), "severity", F.lit("multiple_writes").alias("category"), description.alias("description"), advice.alias("recommendation"), F.lit(None).cast("string").alias("snippet"))


def project_risks(files: DataFrame, missing: DataFrame, writes: DataFrame) -> DataFrame:
    """All findings of a project, each once: the first by branch, then snippet, of the same category, title, wording, file and line."""
    branches = [magic_values(files), missing_where_risks(missing), conversion_risks(files), pascal_risks(files), multiple_write_risks(writes)]
    every = reduce(DataFrame.unionByName, [b.select(*RISK, F.lit(n).alias("branch")) for n, b in enumerate(branches)])
    words = T.squeezed(F.regexp_replace(F.regexp_replace(F.lower("description"), "[\"'`].*?[\"'`]", "<value>"), r"\b\d+\b", "<n>"))
    one = every.groupBy("projectId", "category", F.lower("title").alias("_t"), words.alias("_d"), "file", "line").agg(F.min(F.struct("branch", *[c for c in RISK if c not in ("projectId", "category", "file", "line")])).alias("r"))
    return one.select("projectId", "category", "file", "line", "r.*").select(*RISK)


def risk_occurrences(risks: DataFrame) -> DataFrame:
    """Risks that are the same but for literals, at the same place: one row, with the number of them.

    The first by ``(sourceFile, lineNumber, id)`` represents them; the greatest severity counts. The location is
    part of the key, so a frequent risk type spreads over all tasks, and partial aggregation comes first.
    """
    key = F.concat_ws("|", "riskType", T.normalized_text(F.col("title")), T.normalized_text(F.col("description")), T.normalized_text(F.col("sourceFile")), F.coalesce(F.col("lineNumber").cast("string"), F.lit("")), T.normalized_text(F.col("recommendation")))
    row = F.struct(F.coalesce("sourceFile", F.lit("")).alias("f"), F.coalesce("lineNumber", F.lit(0)).alias("l"), "id", "riskType", "title", "description", "sourceFile", "lineNumber", "recommendation")
    top = F.max(F.struct(T.severity_rank(F.col("severity")).alias("rank"), F.col("severity").alias("severity")))
    grouped = risks.groupBy("projectId", F.coalesce(key, F.lit("")).alias("key")).agg(F.count("*").alias("occurrenceCount"), F.min(row).alias("r"), top.alias("s"))
    return grouped.select("projectId", "key", "occurrenceCount", "s.severity", "r.riskType", "r.title", "r.description", "r.sourceFile", "r.lineNumber", "r.recommendation", F.col("r.id").alias("firstId"))


def risk_groups(risks: DataFrame, samples: int = 5) -> DataFrame:
    """Occurrences grouped by type, title, description and recommendation: sums, files and first locations.

    Folding is a combine-able aggregate: the first ``samples`` distinct locations come from an ordered minimum
    of per-location rows, so a group with a third of all rows is reduced before the exchange.
    """
    o = risk_occurrences(risks)
    group = F.concat_ws("|", "riskType", T.normalized_text(F.col("title")), T.normalized_text(F.col("description")), T.normalized_text(F.col("recommendation")))
    o = o.withColumn("groupKey", F.coalesce(group, F.lit(""))).withColumn("location", F.concat_ws(":", F.coalesce("sourceFile", F.lit("")), F.coalesce(F.col("lineNumber").cast("string"), F.lit(""))))
    keys = ["projectId", "groupKey"]
    sums = o.groupBy(*keys).agg(
        F.sum("occurrenceCount").alias("occurrenceCount"),
        F.max(F.struct(T.severity_rank(F.col("severity")).alias("rank"), "severity")).alias("s"),
        F.min(F.struct(F.coalesce("sourceFile", F.lit("")).alias("f"), F.coalesce("lineNumber", F.lit(0)).alias("l"), "firstId", "riskType", "title")).alias("r"),
        F.count_distinct("sourceFile").alias("affectedFileCount"),
    )
    order = W.partitionBy(*keys).orderBy(F.col("f").asc_nulls_first(), F.col("l").asc_nulls_first(), "location")
    first = o.groupBy(*keys, "location").agg(F.min("sourceFile").alias("f"), F.min("lineNumber").alias("l"))
    first = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= samples)
    first = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "location"))), lambda x: x["location"]).alias("sampleLocations"))
    return sums.join(first, keys).select(*keys, "r.riskType", "r.title", "s.severity", "occurrenceCount", "affectedFileCount", F.array_join("sampleLocations", ", ").alias("sampleLocations"))


def risk_scores(risks: DataFrame) -> DataFrame:
    """Per project: the weighted sum over severities and the number of risks of each."""
    by = [F.count_if(F.col("severity") == s).alias(s) for s in T.RISK_WEIGHTS]
    return risks.groupBy("projectId").agg(F.sum(T.risk_weight(F.col("severity"))).cast("long").alias("score"), *by)
