"""Reports of a project: summaries, sections of Markdown and YAML, and the entries of an archive.

A report is made of lines ``(projectId, document, section, ord, text)``. Lines stay rows up to the end; a document
is put together only by :func:`documents`, which cuts it at the size that is stored, so that no task holds more
than that of a project.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.functions import text as T
from codestrata.operators import history as H
from codestrata.operators import views as V
from codestrata.operators.analysis import Analysis
from codestrata.sources.sinks import MAX_DOCUMENT, MAX_REPORT, markdown_cell, yaml_scalar

# Rows of the tables of a summary, of sections that are folded, and the line that says a document was cut.
TOP, SHOWN = 10, 12
FOOTER = "\n\n> Document truncated at the storage limit.\n"
LINE = ("projectId", "document", "section", "ord", "text")


def _lines(df: DataFrame, document: str, section: Column | str, ord_: Column, text: Column) -> DataFrame:
    s = F.lit(section) if isinstance(section, str) else section
    return df.select("projectId", F.lit(document).alias("document"), s.alias("section"), ord_.cast("string").alias("ord"), text.alias("text"))


def _place(file: str = "file", line: str = "line") -> Column:
    return F.concat_ws(":", F.coalesce(F.col(file), F.lit("?")), F.col(line).cast("string"))


def _sorted(*columns: str) -> Column:
    """A sort key as text: numbers padded, null first."""
    return F.concat_ws("\u0001", *[F.coalesce(F.lpad(F.col(c).cast("string"), 10, "0") if c in ("line", "lineNumber", "startLine", "rank") else F.col(c).cast("string"), F.lit("")) for c in columns])


def _row(*columns: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(c.cast("string")) for c in columns]), F.lit(" |"))


def impact_counts(risks: DataFrame, rules: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(projectId, file, impactCount)``: risks, rules and ends of edges in every file, counted where they are before they meet."""
    at = symbols.select("projectId", F.col("stableKey").alias("key"), "file")
    ends = edges.select("projectId", F.explode(F.filter(F.array("fromKey", "toKey"), lambda k: k.isNotNull())).alias("key")).groupBy("projectId", "key").agg(F.count("*").alias("n"))
    by = lambda df: df.where(F.col("file").isNotNull()).groupBy("projectId", "file").agg(F.count("*").alias("n"))
    every = by(risks).unionByName(by(rules)).unionByName(ends.join(at, ["projectId", "key"]).select("projectId", "file", "n"))
    return every.groupBy("projectId", "file").agg(F.sum("n").alias("impactCount"))


def top(df: DataFrame, order: list[Column], n: int = TOP, by: tuple[str, ...] = ("projectId",)) -> DataFrame:
    """The first ``n`` rows of every project (a top-k report), ranked by a limit that tasks apply before the exchange."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def impact_summary(a: Analysis) -> DataFrame:
    """Per project and kind the foremost entries: files by impact, edges by name, risks from high on, and counts of rules by type."""
    item = lambda df, kind, text, n: df.select("projectId", F.lit(kind).alias("kind"), F.col("rank").cast("int").alias("rank"), text.alias("item"), n.cast("long").alias("count"))
    none = F.lit(None).cast("long")
    files = top(impact_counts(a.risks, a.rules, a.edges, a.symbols), [F.desc("impactCount"), F.col("file")])
    shown = F.concat(F.coalesce("fromName", F.lit("?")), F.lit(" -> "), F.coalesce("toName", F.lit("unresolved")), F.lit(" ("), "type", F.lit(")"))
    edges = top(a.edges.withColumn("shown", shown), [F.col("shown"), F.col("file"), F.col("line")])
    high = top(a.risks.where(T.severity_rank(F.col("severity")) >= 3), [T.severity_rank(F.col("severity")).desc(), F.col("title"), F.col("file"), F.col("line"), F.col("description")])
    types = a.rules.groupBy("projectId", "ruleType").agg(F.count("*").alias("n"))
    types = top(types, [F.col("ruleType")])
    parts = [item(files, "file", F.col("file"), F.col("impactCount")), item(edges, "dependency", F.col("shown"), none), item(high, "risk", F.concat_ws(" ", "title", _place()), none), item(types, "ruleType", F.col("ruleType"), F.col("n"))]
    return reduce(DataFrame.unionByName, parts)


def affected_files(risk_groups: DataFrame, rule_groups: DataFrame) -> DataFrame:
    """The files that the sample locations of risk and rule groups name most (a top-k report)."""

    def places(df: DataFrame, kind: str) -> DataFrame:
        file = F.explode(F.split("sampleLocations", ", ")).alias("at")
        rows = df.select("projectId", file).select("projectId", F.regexp_replace("at", r":\d*$", "").alias("file"))
        return rows.where(F.col("file") != "").groupBy("projectId", "file").agg(F.count("*").alias(kind))

    both = places(risk_groups, "riskCount").join(places(rule_groups, "ruleCount"), ["projectId", "file"], "full").na.fill(0, ["riskCount", "ruleCount"])
    return top(both.withColumn("totalCount", F.col("riskCount") + F.col("ruleCount")), [F.desc("totalCount"), F.col("file")])


def partial_reasons(warnings: DataFrame, status: DataFrame) -> DataFrame:
    """Why an analysis is partial: one reason a code that is no note, most frequent first, and one for the run's status."""
    w = warnings.where(F.col("level") != "note").groupBy("projectId", "code").agg(F.count("*").alias("n"))
    w = w.select("projectId", F.concat("code", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("reason"), (-F.col("n")).alias("ord"))
    said = F.when(F.col("status") == "failed", "The analysis failed.").when(F.col("status") == "partial", "Some files were skipped or analysed in part.")
    s = status.select("projectId", said.alias("reason"), F.lit(1).cast("long").alias("ord")).where(F.col("reason").isNotNull())
    return w.unionByName(s)


def evidence_counts(risks: DataFrame, warnings: DataFrame) -> DataFrame:
    """Per project: risks and warnings whose text speaks of dynamic SQL, fixed paths, empty handlers, and unresolved forms."""
    # What the words of each kind are.
    words = {"dynamicSql": r"(?i)dynamic sql|sql\.text|sql\.add|SQL_DYNAMIC", "hardcoded": r"(?i)hardcoded|connection string|filesystem path", "emptyHandlers": r"(?i)empty exception|empty except", "unresolvedForms": r"(?i)EVENT_HANDLER_UNRESOLVED|DATA_BINDING_UNRESOLVED"}
    text = risks.select("projectId", F.concat_ws(" ", "title", "description").alias("t")).unionByName(warnings.select("projectId", F.concat_ws(" ", "code", "message").alias("t")))
    return text.groupBy("projectId").agg(*[F.count_if(F.col("t").rlike(p)).alias(k) for k, p in words.items()])


def capped(df: DataFrame, keys: list[str], order: list[Column], shown: int = SHOWN) -> DataFrame:
    """The first ``shown`` rows of every section, each with ``hiddenCount``: how many more there are."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    first = top(df, order, shown, tuple(keys)).drop("rank")
    return first.join(counts, keys).withColumn("hiddenCount", F.greatest(F.lit(0), F.col("_n") - shown)).drop("_n")


def report_lines(a: Analysis) -> DataFrame:
    """The lines of all documents of all projects."""
    flow = _lines(a.edges, "FLOW.md", F.coalesce("fromName", F.lit("?")), _sorted("line", "toName"), F.concat(F.lit("- "), "type", F.lit(" "), F.coalesce("toName", F.lit("unresolved")), F.lit(" at "), _place()))
    refs = a.references
    data = _lines(refs, "DATA_DEPENDENCY.md", F.coalesce("tableName", F.lit("unknown")), _sorted("field", "access", "file", "line"), F.concat(F.lit("- "), markdown_cell(F.col("field")), F.lit(" "), "access", F.lit(" at "), _place()))
    k = a.risks
    risks = _lines(k, "RISKS.md", F.concat((4 - T.severity_rank(F.col("severity"))).cast("string"), F.lit(" "), "severity"), _sorted("title", "file", "line", "description"), F.concat(F.lit("- "), markdown_cell(F.col("title")), F.lit(" ("), _place(), F.lit("): "), markdown_cell(F.col("description"))))
    r = a.rules
    entry = F.concat(F.lit("- type: "), yaml_scalar(F.col("ruleType")), F.lit("\n  name: "), yaml_scalar(F.col("name")), F.lit("\n  description: "), yaml_scalar(F.col("description")), F.lit("\n  source: "), yaml_scalar(_place()))
    rules = _lines(r, "RULES.yaml", F.lit("rules"), _sorted("ruleType", "name"), entry)
    events = _lines(a.handlers, "DELPHI_EVENT_MAP.md", F.col("formName"), _sorted("component", "event", "line"), _row(F.concat_ws(".", "componentClass", "component"), F.col("event"), F.col("handler"), F.coalesce("method", F.lit("unresolved")), F.col("status")))
    shown = lambda c: F.coalesce(F.col(c), F.lit("unresolved"))
    binds = _lines(a.bindings, "DELPHI_DATA_BINDINGS.md", F.col("formName"), _sorted("component", "dataField", "line"), _row(F.concat_ws(".", "componentClass", "component"), shown("dataSource"), shown("dataSet"), shown("resolvedTable"), shown("dataField"), F.col("accessHint"), F.col("confidence")))
    build = _lines(a.findings, "BUILD_DOCTOR.md", F.col("severity"), _sorted("code", "file", "line", "evidence"), F.concat(F.lit("- "), "code", F.lit(" ("), F.coalesce(_place(), F.lit("project")), F.lit("): "), markdown_cell(F.col("evidence"))))
    t = a.traces
    ui = _lines(t, "UI_DATABASE_FLOW.md", F.coalesce("formName", F.lit("?")), _sorted("componentName", "eventName", "stableKey"), _row(F.col("stableKey"), F.col("status"), F.col("confidence"), F.array_join("affectedTables", ", "), F.array_join(F.transform("affectedFields", lambda f: F.concat_ws(".", f["table"], f["field"])), ", ")))
    warn = _lines(a.warnings, "WARNINGS.md", F.col("code"), _sorted("file", "message"), F.concat(F.lit("- "), F.coalesce("file", F.lit("project")), F.lit(" "), markdown_cell(F.col("message"))))
    counters = V.file_counters(a.files.withColumn("lineCount", T.line_count(F.col("content"))), a.symbols, a.edges, a.risks, a.warnings)
    files = _lines(counters, "FILE_COUNTERS.md", "files", F.coalesce("file", F.lit("")), _row(*[F.col(c) for c in ("file", "lines", "symbols", "edges", "risks", "warnings", "limited")]))
    summary = impact_summary(a)
    impact = _lines(summary, "IMPACT_SUMMARY.md", F.col("kind"), _sorted("rank"), F.concat(F.lit("- "), markdown_cell(F.col("item")), F.when(F.col("count").isNotNull(), F.concat(F.lit(" ("), F.col("count").cast("string"), F.lit(")"))).otherwise("")))
    m = a.metrics.join(a.status, "projectId").join(evidence_counts(a.risks, a.warnings), "projectId", "left")
    numbers = F.explode(F.array(*[F.struct(F.lit(f"{n:02}").alias("o"), F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("0"))).alias("t")) for n, c in enumerate(("status", *H.METRICS, "dynamicSql", "hardcoded", "emptyHandlers", "unresolvedForms"))]))
    executive = _lines(m.select("projectId", numbers.alias("n")), "EXECUTIVE_SUMMARY.md", "Numbers", F.col("n.o"), F.col("n.t"))
    reasons = partial_reasons(a.warnings, a.status)
    executive = executive.unionByName(_lines(reasons, "EXECUTIVE_SUMMARY.md", "Reasons", F.lpad((F.col("ord") + 1_000_000_000).cast("string"), 12, "0"), F.concat(F.lit("- "), "reason")))
    return reduce(DataFrame.unionByName, [flow, data, risks, rules, events, binds, build, ui, warn, files, impact, executive]).select(*LINE)


def documents(lines: DataFrame, limit: int = MAX_DOCUMENT) -> DataFrame:
    """``(projectId, document, text, bytes, truncated)``: lines in order of section and key under their headings, cut at a byte limit.

    Lengths are summed up first, line by line in order; lines behind the limit are left out before anything is
    put together, and a footer says so. Running sums go by blocks of sections, so that a project with a third of all
    lines is sorted in many tasks.
    """
    by = ["projectId", "document"]
    heads = lines.select(*by, "section").distinct().where(~F.col("document").endswith(".yaml")).select(*by, "section", F.lit("").alias("ord"), F.concat(F.lit("\n## "), "section").alias("text"), F.lit(0).alias("kind"))
    rows = heads.unionByName(lines.select(*by, "section", "ord", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("kind")))
    rows = rows.withColumn("size", F.octet_length("text") + 1)
    # sizes of whole sections first: only the section in which the limit falls is summed line by line
    sections = rows.groupBy(*by, "section").agg(F.sum("size").alias("all"))
    before = F.coalesce(F.sum("all").over(W.partitionBy(*by).orderBy("section").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sections = sections.withColumn("before", before)
    room = limit - len(FOOTER.encode())
    rows = rows.join(sections, [*by, "section"]).where(F.col("before") < room)
    inside = F.sum("size").over(W.partitionBy(*by, "section").orderBy("kind", "ord", "text").rowsBetween(W.unboundedPreceding, W.currentRow))
    fits = rows.where(F.col("before") + F.col("all") <= room).unionByName(rows.where(F.col("before") + F.col("all") > room).withColumn("_in", inside).where(F.col("before") + F.col("_in") <= room).drop("_in"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "kind", "ord", "text"))), lambda r: r["text"]), "\n")
    out = fits.groupBy(*by).agg(body.alias("body"))
    whole = sections.groupBy(*by).agg((F.sum("all") > room).alias("truncated"))
    out = out.join(whole, by)
    text = F.concat(F.when(F.col("document").endswith(".md"), F.concat(F.lit("# "), F.regexp_replace("document", r"\.md$", ""), F.lit("\n"))).otherwise(F.lit("")), "body", F.when(F.col("truncated"), F.lit(FOOTER)).otherwise(F.lit("")))
    return out.select(*by, text.alias("text"), F.octet_length(text).cast("long").alias("bytes"), "truncated")


def truncation_warnings(docs: DataFrame) -> DataFrame:
    """A warning for every document that was cut."""
    said = F.concat("document", F.lit(" was truncated at the storage limit."))
    return docs.where("truncated").select("projectId", F.lit("ANALYSIS_DOCUMENT_TRUNCATED").alias("code"), F.lit("warning").alias("level"), "document", said.alias("message"))


def archive_sizes(docs: DataFrame, limit: int = MAX_REPORT) -> DataFrame:
    """Per project: entries and bytes of its archive, and whether it may be made: known from lengths alone."""
    return docs.groupBy("projectId").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes")).withColumn("accepted", F.col("bytes") <= limit)


def archives(docs: DataFrame, limit: int = MAX_REPORT) -> DataFrame:
    """``(projectId, archive)``: a ZIP of every project whose documents fit, entries by name and with fixed times; equal documents give equal bytes.

    Projects above the limit are left to :func:`archive_sizes`, which tells them; a task holds one archive.
    """
    import pandas as pd

    from codestrata.sources.sinks import report_archive

    fits = docs.join(archive_sizes(docs, limit).where("accepted").select("projectId"), "projectId", "left_semi")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        data = report_archive(dict(zip(rows["document"], rows["text"])), limit)
        return pd.DataFrame([(int(rows["projectId"].iloc[0]), data)], columns=["projectId", "archive"])

    return fits.select("projectId", "document", "text").groupBy("projectId").applyInPandas(run, "projectId long, archive binary")


def diff_documents(diff: DataFrame, deltas: DataFrame) -> DataFrame:
    """The three entries of a diff archive: the document as JSON, as Markdown, and the changed metrics."""
    b = H.buckets(diff)
    b = b.withColumn("line", F.explode(F.concat(F.array(F.concat(F.lit("- total "), F.col("total").cast("string"), F.when(F.col("truncated"), F.lit(", truncated")).otherwise(F.lit("")))), F.transform("items", lambda x: F.concat(F.lit("- "), F.substring(x, 1, 400))))))
    md = b.select("projectId", F.lit("ANALYSIS_DIFF.md").alias("document"), F.concat_ws(".", "section", "bucket").alias("section"), F.col("line").alias("ord"), F.col("line").alias("text"))
    doc = H.diff_document(diff, deltas)
    whole = doc.select("projectId", F.lit("ANALYSIS_DIFF.json").alias("document"), F.to_json(F.struct("metricsDelta", "buckets", "truncated")).alias("text"))
    metrics = doc.select("projectId", F.lit("METRICS_DELTA.json").alias("document"), F.to_json("metricsDelta").alias("text"))
    return documents(md).select("projectId", "document", "text", "bytes").unionByName(whole.unionByName(metrics).withColumn("bytes", F.octet_length("text").cast("long")))
