"""Registered queries of the core: each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.functions import paths as P
from codestrata.functions import text as T
from codestrata.operators import build as B
from codestrata.operators import derive as D
from codestrata.operators import extract as X
from codestrata.operators import graph as G
from codestrata.operators import history as H
from codestrata.operators import lists as L
from codestrata.operators import resolve as R
from codestrata.operators import pages as PG
from codestrata.operators import reports as RP
from codestrata.operators import risks as K
from codestrata.operators import traces as TR
from codestrata.operators import views as V
from codestrata.operators.analysis import Analysis
from codestrata.operators.merkle import snapshot_diff
from codestrata.sources import archives as AR
from codestrata.session import checkpointed, maybe_broadcast, scan, spread, table
from codestrata.streaming import jobs as J
from codestrata.streaming.limits import anchored_limit

Query = Callable[[SparkSession, str], DataFrame]
_SNAPSHOT = ("name", "type", "startLine", "endLine", "signature")


def _files(s: SparkSession, d: str) -> DataFrame:
    return spread(scan(s, d, "files", "projectId", "id", "filePath", "content"), "id")


def _risks(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d, "risks", "id", "projectId", "riskType", "severity", "title", "description", "sourceFile", "lineNumber", "recommendation")


def _runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "analysis_runs").drop("errorMessage")


def _symbols(s: SparkSession, d: str) -> DataFrame:
    return X.symbols(_files(s, d))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return snapshot_diff(scan(s, d, "symbol_snapshots", "projectId", "runNumber", "stableKey", "rowId", *_SNAPSHOT))


def p6_counts(s: SparkSession, d: str) -> DataFrame:
    """How many symbols were added, removed and changed in each run."""
    return p6_found(s, d).groupBy("projectId", "runNumber").pivot("change", ["added", "removed", "changed"]).count().na.fill(0)


def a6_paths(s: SparkSession, d: str) -> DataFrame:
    f = scan(s, d, "files", "id", "filePath").withColumn("path", P.normalized(F.col("filePath")))
    p = F.col("path")
    return f.select("id", "path", P.is_safe_relative(p).alias("safe"), P.is_absolute(F.col("filePath")).alias("absolute"), P.is_ignored(p).alias("ignored"), P.extension(p).alias("extension"), P.language(p).alias("language"), P.basename(p).alias("base"), P.stem(p).alias("stem"), P.dirname(p).alias("dir"))


def a10_import_guard(s: SparkSession, d: str) -> DataFrame:
    """Per project: files, bytes, files above 5 MB, and whether the limits of an import are kept."""
    f = scan(s, d, "extracted_files", "projectId", "content").withColumn("bytes", F.coalesce(F.octet_length("content"), F.lit(0)))
    g = f.groupBy("projectId").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes") > 5 * 1024 * 1024).alias("oversized"))
    return g.withColumn("accepted", (F.col("files") <= 2000) & (F.col("bytes") <= 500 * 1024 * 1024))


def b2_line_counts(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d, "files", "id", "content").where(F.col("content").isNotNull()).select("id", T.line_count(F.col("content")).alias("lines"))


def c2_lines(s: SparkSession, d: str) -> DataFrame:
    return K.source_lines(_files(s, d)).select("fileId", "line", "text")


def _of(extension: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        f = _files(s, d).where(F.lower("filePath").rlike(rf"\.({extension})$"))
        return X.symbols(f).select("fileId", "name", "qualifiedName", "type", "startLine", "endLine", "stableKey")

    return run


def c7_go_calls(s: SparkSession, d: str) -> DataFrame:
    return R.go_call_edges(X.call_sites(_files(s, d)), _symbols(s, d))


def c22_pascal_calls(s: SparkSession, d: str) -> DataFrame:
    return R.unique_call_edges(X.call_sites(_files(s, d)), _symbols(s, d))


def c5_imports(s: SparkSession, d: str) -> DataFrame:
    return R.import_edges(X.imports(_files(s, d)), _symbols(s, d))


def _analysis(s: SparkSession, d: str) -> Analysis:
    return Analysis(_files(s, d))


def f7_dependency_summary(s: SparkSession, d: str) -> DataFrame:
    """Internal, external, unresolved and standard-library edges per project, over the unfiltered edge set."""
    a = _analysis(s, d)
    e = R.stored_edges(a.edges, a.symbols)
    n = lambda kind, *more: F.count_if(reduce(lambda x, y: x & y, [F.col("targetKind") == kind, *more]))
    return e.groupBy("projectId").agg(n("internal").alias("internalCount"), n("external").alias("externalCount"), n("unresolved").alias("unresolvedCount"), n("external", T.is_standard_unit(F.col("targetExternalName"))).alias("standardLibraryCount"))


def c31_missing_where(s: SparkSession, d: str) -> DataFrame:
    return R.missing_where(X.sql_statements(_files(s, d)))


def c35_sql_evidence(s: SparkSession, d: str) -> DataFrame:
    return R.with_owner(R.sql_evidence(X.sql_statements(_files(s, d))), _symbols(s, d))


def e6_event_handlers(s: SparkSession, d: str) -> DataFrame:
    return R.event_handlers(X.form_events(_files(s, d)), _symbols(s, d))


def c27_data_bindings(s: SparkSession, d: str) -> DataFrame:
    return R.data_bindings(X.form_objects(_files(s, d)))


def d6_file_search(s: SparkSession, d: str) -> DataFrame:
    """Stored SQL files whose path or name holds 'invoice', any letter case."""
    f = scan(s, d, "files", "id", "projectId", "filePath", "fileName", "fileType", "status")
    return L.filtered(f, {"status": "stored", "fileType": ".sql"}, " Invoice ", ["filePath", "fileName"])


def e16_risk_files(s: SparkSession, d: str) -> DataFrame:
    """Risks with the newest file of their path, compared without letter case; null where there is none."""
    f = scan(s, d, "files", "id", "projectId", "filePath").groupBy("projectId", F.lower(F.trim(P.slashed(F.col("filePath")))).alias("k")).agg(F.max("id").alias("fileId"))
    r = scan(s, d, "risks", "id", "projectId", "sourceFile", "severity").withColumn("k", F.lower(F.trim(P.slashed(F.col("sourceFile")))))
    return r.join(f, ["projectId", "k"], "left").select(F.col("id").alias("riskId"), "projectId", "fileId", "severity")


def h3_files_page(s: SparkSession, d: str) -> DataFrame:
    """Page 3 of 40 files (a paged list)."""
    return L.page(scan(s, d, "files", "id", "projectId", "filePath", "fileName"), L.file_order(), 3, 40)


def h6_top_risks(s: SparkSession, d: str) -> DataFrame:
    """The ten foremost risks (a top-k report)."""
    return scan(s, d, "risks", "id", "projectId", "severity", "sourceFile", "lineNumber", "title").orderBy(*L.risk_order()).limit(10)


def _latest_two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The last two runs of every project that have rows."""
    x = scan(s, d, "symbol_snapshots", "projectId", "runNumber", "stableKey", "rowId", *_SNAPSHOT)
    runs = x.select("projectId", "runNumber").distinct().withColumn("n", F.row_number().over(W.partitionBy("projectId").orderBy(F.desc("runNumber"))))
    pick = lambda n: x.join(runs.where(F.col("n") == n).select("projectId", "runNumber"), ["projectId", "runNumber"], "left_semi")
    return pick(2), pick(1)


def k1_last_diff(s: SparkSession, d: str) -> DataFrame:
    base, compare = _latest_two(s, d)
    return L.keyed_diff(base, compare, ["projectId", "stableKey"], _SNAPSHOT, "rowId")


def k3_diff_buckets(s: SparkSession, d: str) -> DataFrame:
    return L.diff_buckets(k1_last_diff(s, d), "projectId", "stableKey")


def _impact(s: SparkSession, d: str) -> G.Impact:
    a = _analysis(s, d)
    files = scan(s, d, "files", "projectId", "filePath")
    return G.Impact(a.symbols, files, a.edges, a.references, a.risks.withColumnRenamed("file", "sourceFile").withColumnRenamed("line", "lineNumber"), a.rules, a.columns)


def l3_impact(s: SparkSession, d: str) -> DataFrame:
    """What touches the field or symbol ``currency`` in every project."""
    return _impact(s, d).rows("currency")


def l7_impact_results(s: SparkSession, d: str) -> DataFrame:
    """Result per project for a table (``invoice_line``): counts, lists and chains."""
    r = _impact(s, d).results("invoice_line", "sql_table")
    return r.select("projectId", "targetType", "confidence", "affectedCount", F.size("files").alias("files"), F.size("symbols").alias("symbols"), F.size("fields").alias("fields"), F.size("rules").alias("rules"), F.size("risks").alias("risks"), F.size("chains").alias("chains"), "summary")


def l6_risk_impact(s: SparkSession, d: str) -> DataFrame:
    """What a risk title touches in every project."""
    return _impact(s, d).rows("Write statement without WHERE clause", "risk")


def l8_flow_traces(s: SparkSession, d: str) -> DataFrame:
    return TR.trace_steps(_analysis(s, d).traces)


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The files of every project stored in the first and in the second half of its time, as two imports; undated ones are in both."""
    f = spread(scan(s, d, "files", "projectId", "id", "filePath", "content", "createdAt"), "id")
    us = F.unix_micros(F.col("createdAt").cast("timestamp"))
    middle = f.groupBy("projectId").agg(((F.min(us) + F.max(us)) / 2).alias("middle"))
    f = f.join(maybe_broadcast(middle), "projectId").withColumn("_us", us)
    columns = ["projectId", "id", "filePath", "content"]
    early, late = F.coalesce(F.col("_us") <= F.col("middle"), F.lit(True)), F.coalesce(F.col("_us") > F.col("middle"), F.lit(True))
    return f.where(early).select(*columns), f.where(late).select(*columns)


def _two_imports(s: SparkSession, d: str) -> tuple[Analysis, Analysis]:
    base, compare = _halves(s, d)
    return Analysis(checkpointed(base)), Analysis(checkpointed(compare))


def k3_sections(s: SparkSession, d: str) -> DataFrame:
    """What changed in all eleven sections between the two halves of every project."""
    base, compare = _two_imports(s, d)
    return H.diff_sections(base.sections(), compare.sections()).select("projectId", "section", "key", "change")


def k3_document(s: SparkSession, d: str) -> DataFrame:
    """The same as a document: buckets with totals and items, and deltas of the metrics."""
    base, compare = _two_imports(s, d)
    diff = H.diff_sections(base.sections(), compare.sections())
    return H.diff_document(diff, H.metric_deltas(base.metrics, compare.metrics)).select("projectId", "metricsDelta.*", F.to_json("buckets").alias("buckets"), "truncated")


def k3_files(s: SparkSession, d: str) -> DataFrame:
    """The file section alone, from the manifests."""
    base, compare = (H.section_rows("files", L.source_manifest(f)) for f in _halves(s, d))
    return H.diff_sections(base, compare).select("projectId", "key", "change")


def k3_symbol_buckets(s: SparkSession, d: str) -> DataFrame:
    """The symbol section of the last two runs in ``symbol_snapshots``, as buckets with their first items."""
    diff = k1_last_diff(s, d).where(F.col("change") != "changed")
    rows = diff.select("projectId", F.lit("symbols").alias("section"), F.col("stableKey").alias("key"), "change", F.col("stableKey").alias("before"), F.col("stableKey").alias("after"))
    return H.buckets(rows).select("projectId", "bucket", "total", "displayed", "truncated", F.element_at("items", 1).alias("first"), F.element_at("items", -1).alias("last"))


def l8_reachable(s: SparkSession, d: str) -> DataFrame:
    """Symbols that traces from the handlers of forms can reach, and how many steps in at least."""
    a = _analysis(s, d)
    roots = a.handlers.where(F.col("methodKey").isNotNull()).select("projectId", F.col("methodKey").alias("root")).distinct()
    return TR.reachable(roots, checkpointed(TR.adjacency(a.edges, a.evidence, a.symbols)))


# runs as jobs: one without an end is running since it was made, and has had as many tries as its number says
def _jobs(s: SparkSession, d: str) -> DataFrame:
    r = scan(s, d, "analysis_runs", "id", "projectId", "runNumber", "status", "completedAt", "createdAt")
    at = F.col("createdAt").cast("timestamp")
    none = F.lit(None)
    return r.select(
        "id", "projectId", F.when(F.col("status") == "failed", "running").otherwise("completed").alias("status"), (F.col("runNumber") % 5).alias("attemptCount"), F.lit(3).alias("maxAttempts"),
        none.cast("string").alias("lockedBy"), none.cast("timestamp").alias("leaseUntil"), none.cast("timestamp").alias("heartbeatAt"), at.alias("createdAt"), at.alias("startedAt"),
    )


_NOW = "2030-01-01 00:00:00"


def m4_recovered(s: SparkSession, d: str) -> DataFrame:
    """What becomes of runs that never ended, as jobs, when the service starts again."""
    return J.recovered(_jobs(s, d), F.lit(_NOW).cast("timestamp")).select("id", "projectId", "status", "attemptCount")


def m4_orphans(s: SparkSession, d: str) -> DataFrame:
    return J.orphaned_projects(_projects(s, d), _jobs(s, d)).select("id", "status")


def m2_claim(s: SparkSession, d: str) -> DataFrame:
    """The one job that is claimed next."""
    return J.next_claim(_jobs(s, d), F.lit(_NOW).cast("timestamp")).select("id", "projectId", "attemptCount")


def b9_diff_documents(s: SparkSession, d: str) -> DataFrame:
    """Sizes of the entries of a diff archive, for the symbols of the last two runs."""
    diff = k1_last_diff(s, d).where(F.col("change") != "changed").select("projectId", F.lit("symbols").alias("section"), F.col("stableKey").alias("key"), "change", F.col("stableKey").alias("before"), F.col("stableKey").alias("after"))
    none = scan(s, d, "projects", "id").select(F.col("id").alias("projectId"))
    return RP.diff_documents(diff, H.metric_deltas(none, none)).select("projectId", "document", "bytes")


# lists of a user ---------------------------------------------------------------------------------
#: The user whose lists the queries show.
USER = 2


def _projects(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d, "projects", "id", "userId", "status")


def d1_owned_files(s: SparkSession, d: str) -> DataFrame:
    """All files of the projects a user owns."""
    return PG.scoped(scan(s, d, "files", "id", "projectId", "filePath", "status"), _projects(s, d), PG.Request(user=USER))


def d9_critical_risks(s: SparkSession, d: str) -> DataFrame:
    """Critical risks, each once, whose text holds 'sql' when normalised."""
    r = PG.Request(search="  SQL ")
    return PG.risk_list(_risks(s, d), _projects(s, d), r, critical_only=True).select("projectId", "key", "occurrenceCount", "severity", "firstId")


def h4_risk_page(s: SparkSession, d: str) -> DataFrame:
    """Page 3 of 20 risks of one project (a paged list)."""
    r = PG.Request(project=1, page=3, size=20)
    return PG.paged(PG.risk_list(_risks(s, d), _projects(s, d), r), PG.ORDERS["risks"](), r).select("projectId", "severity", "title", "sourceFile", "lineNumber", "occurrenceCount")


def h2_page_info(s: SparkSession, d: str) -> DataFrame:
    """What a page far beyond the end of the file list is clamped to."""
    return PG.page_info(scan(s, d, "files", "id"), PG.Request(page=1_000_000, size=500))


def e14_field_list(s: SparkSession, d: str) -> DataFrame:
    """Fields whose table or name holds 'price', with their use; unused ones show zeros."""
    a = _analysis(s, d)
    return PG.field_list(V.field_dimension(a.references, a.columns), a.references, _projects(s, d), PG.Request(search="price")).drop("schema", "table", "fieldKey")


def e11_field_dependencies(s: SparkSession, d: str) -> DataFrame:
    """Writes whose table, field, symbol or context holds 'status'."""
    a = _analysis(s, d)
    return PG.field_dependency_list(a.references, _projects(s, d), PG.Request(search="status"), operation="write")


def e10_dependency_page(s: SparkSession, d: str) -> DataFrame:
    """Page 2 of 25 unresolved or external edges without the standard library (a paged list)."""
    a = _analysis(s, d)
    r = PG.Request(page=2)
    e = PG.dependency_list(R.stored_edges(a.edges, a.symbols), a.symbols, _projects(s, d), r, target="external")
    return PG.paged(e, PG.ORDERS["dependencies"](), r)


def f10_rule_page(s: SparkSession, d: str) -> DataFrame:
    """Page 1 of 50 rules on constants (a paged list)."""
    r = PG.Request(size=50)
    return PG.paged(PG.rule_list(f14_rules(s, d), _projects(s, d), r, "magic_value"), PG.ORDERS["rules"](), r)


def e21_latest_jobs(s: SparkSession, d: str) -> DataFrame:
    """The latest job of every project that ran one."""
    jobs = scan(s, d, "analysis_runs", "projectId", "jobId", "status").where(F.col("jobId").isNotNull()).select("projectId", F.col("jobId").alias("id"), "status")
    return PG.latest_jobs(jobs)


def a20_source_urls(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d, "projects", "id", "sourceUrl").withColumn("safe", AR.is_safe_source_url(F.col("sourceUrl")))


def f12_affected_by_groups(s: SparkSession, d: str) -> DataFrame:
    """Files that risk and rule groups name most (a top-k report)."""
    a = _analysis(s, d)
    return RP.affected_files(K.risk_groups(_risks(s, d)), V.rule_groups(a.rules))


def r1_build_findings(s: SparkSession, d: str) -> DataFrame:
    return B.build_findings(checkpointed(B.build_records(_files(s, d))))


def f14_rules(s: SparkSession, d: str) -> DataFrame:
    return _analysis(s, d).rules


def f16_metrics(s: SparkSession, d: str) -> DataFrame:
    return _analysis(s, d).metrics


def f18_confidence(s: SparkSession, d: str) -> DataFrame:
    a = _analysis(s, d)
    warnings = L.import_warnings(scan(s, d, "projects", "id", "importWarningsJson"))
    return D.confidence(a.files, D.file_warnings(a.files), warnings, a.handlers, a.bindings, a.risks)


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d, "symbol_snapshots", "projectId", "runNumber", "stableKey", "rowId", "name", "qualifiedName", "type", "file", "startLine")


def e9_symbol_page(s: SparkSession, d: str) -> DataFrame:
    """Page 2 of 50 procedures whose name or file holds 'load', over the newest runs (a paged list)."""
    found = V.symbol_list(V.latest_symbols(_snapshots(s, d)), "procedure", "Load")
    return L.page(found, [F.col("projectId"), F.coalesce("file", F.lit("")), F.coalesce("startLine", F.lit(0)), F.col("stableKey")], 2, 50)


def e10_dependencies(s: SparkSession, d: str) -> DataFrame:
    a = _analysis(s, d)
    return V.dependency_list(a.edges, a.symbols)


def f22_file_counters(s: SparkSession, d: str) -> DataFrame:
    a = _analysis(s, d)
    return V.file_counters(scan(s, d, "files", "projectId", "filePath", "lineCount"), a.symbols, a.edges, a.risks, a.warnings)


def m7_rate_limit(s: SparkSession, d: str) -> DataFrame:
    """Requests of ``events`` per user and kind, at most three in an hour's window that starts with its first one."""
    e = scan(s, d, "events", "event_id", "ts", "user_id", "event_type")
    return anchored_limit(e, ["user_id", "event_type"], "ts", "event_id", 3, 3600)


def queries() -> dict[str, Query]:
    return {
        "p6_found": p6_found,
        "p6_counts": p6_counts,
        "a6_paths": a6_paths,
        "a8_duplicate_paths": lambda s, d: L.duplicate_paths(scan(s, d, "extracted_files", "projectId", "path")),
        "a10_import_guard": a10_import_guard,
        "a18_import_warnings": lambda s, d: L.import_warnings(scan(s, d, "projects", "id", "importWarningsJson")),
        "b2_line_counts": b2_line_counts,
        "c2_lines": c2_lines,
        "c4_go_symbols": _of("go"),
        "c8_sql_symbols": _of("sql"),
        "c21_pascal_symbols": _of("pas|dpr|inc|dpk"),
        "c26_form_symbols": _of("dfm|fmx"),
        "c5_imports": c5_imports,
        "c7_go_calls": c7_go_calls,
        "c22_pascal_calls": c22_pascal_calls,
        "c12_sql_statements": lambda s, d: X.sql_statements(_files(s, d)),
        "c14_field_references": lambda s, d: X.field_references(_files(s, d)),
        "c18_table_columns": lambda s, d: X.table_columns(_files(s, d)),
        "c25_form_objects": lambda s, d: X.form_objects(_files(s, d)).drop("properties", "columns"),
        "c26_form_events": lambda s, d: X.form_events(_files(s, d)),
        "c27_data_bindings": c27_data_bindings,
        "c29_magic_values": lambda s, d: K.magic_values(_files(s, d)).select("projectId", "fileId", "file", "line", "value", "kind", "title", "severity"),
        "c31_missing_where": c31_missing_where,
        "c32_pascal_risks": lambda s, d: K.pascal_risks(_files(s, d)).select("projectId", "fileId", "file", "line", "title", "severity"),
        "c33_conversion_risks": lambda s, d: K.conversion_risks(_files(s, d)).select("projectId", "fileId", "file", "line", "title", "severity"),
        "c35_sql_evidence": c35_sql_evidence,
        "d6_file_search": d6_file_search,
        "e6_event_handlers": e6_event_handlers,
        "e16_risk_files": e16_risk_files,
        "e22_analysis_status": lambda s, d: L.analysis_status(scan(s, d, "projects", "id", "status", "sourceFingerprint"), _runs(s, d)),
        "f2_field_usage": lambda s, d: R.field_usage(X.field_references(_files(s, d))),
        "f3_table_usage": lambda s, d: R.table_usage(X.field_references(_files(s, d))),
        "f4_project_totals": lambda s, d: L.project_totals(scan(s, d, "projects", "id", "name"), scan(s, d, "files", "projectId", "lineCount"), scan(s, d, "risks", "projectId", "severity"), _runs(s, d)),
        "f5_warning_summary": lambda s, d: L.warning_summary(L.import_warnings(scan(s, d, "projects", "id", "importWarningsJson"))),
        "f7_dependency_summary": f7_dependency_summary,
        "f8_risk_occurrences": lambda s, d: K.risk_occurrences(_risks(s, d)),
        "f9_risk_groups": lambda s, d: K.risk_groups(_risks(s, d)),
        "f12_affected_files": lambda s, d: L.affected_files(_risks(s, d)),
        "f13_multiple_writes": lambda s, d: R.multiple_writes(X.field_references(_files(s, d))),
        "d13_entry_points": lambda s, d: V.entry_points(_symbols(s, d)).select("projectId", "file", "name", "type", "startLine"),
        "e9_symbol_page": e9_symbol_page,
        "e9_latest_symbols": lambda s, d: V.latest_symbols(_snapshots(s, d)),
        "e10_dependencies": e10_dependencies,
        "f10_rule_occurrences": lambda s, d: V.rule_occurrences(f14_rules(s, d)),
        "f11_rule_groups": lambda s, d: V.rule_groups(f14_rules(s, d)),
        "f22_file_counters": f22_file_counters,
        "f24_trace_summary": lambda s, d: TR.trace_summary(_analysis(s, d).traces),
        "d10_trace_filter": lambda s, d: TR.filtered_traces(_analysis(s, d).traces, status="partial", confidence="medium").select("projectId", "stableKey", "status", "confidence"),
        "f25_top_tables": lambda s, d: V.top_tables(R.sql_evidence(X.sql_statements(_files(s, d)))),
        "f26_metric_deltas": lambda s, d: V.run_metric_deltas(scan(s, d, "symbol_snapshots", "projectId", "runNumber", "stableKey", "type")),
        "f29_field_dimension": lambda s, d: V.field_dimension(X.field_references(_files(s, d)), X.table_columns(_files(s, d))),
        "c19_file_warnings": lambda s, d: D.file_warnings(_files(s, d)),
        "f14_rules": f14_rules,
        "f16_metrics": f16_metrics,
        "f18_confidence": f18_confidence,
        "f15_risk_scores": lambda s, d: K.risk_scores(_risks(s, d)),
        "f21_file_stats": lambda s, d: L.file_stats(scan(s, d, "files", "projectId", "filePath", "lineCount")),
        "f28_language_stats": lambda s, d: L.file_stats(scan(s, d, "files", "projectId", "filePath", "lineCount"), "language"),
        "f27_next_run": lambda s, d: L.next_run_number(_runs(s, d)),
        "g1_latest_runs": lambda s, d: L.latest_usable_run(_runs(s, d)),
        "g2_current_runs": lambda s, d: L.current_source_run(scan(s, d, "projects", "id", "sourceFingerprint"), _runs(s, d)),
        "h3_files_page": h3_files_page,
        "h6_top_risks": h6_top_risks,
        "j9_manifest": lambda s, d: L.source_manifest(_files(s, d)),
        "j9_fingerprints": lambda s, d: L.source_fingerprints(_files(s, d)),
        "l3_impact": l3_impact,
        "l8_flow_traces": l8_flow_traces,
        "l8_reachable": l8_reachable,
        "l7_impact_results": l7_impact_results,
        "l6_risk_impact": l6_risk_impact,
        "k3_sections": k3_sections,
        "k3_document": k3_document,
        "k3_files": k3_files,
        "k3_symbol_buckets": k3_symbol_buckets,
        "d1_owned_files": d1_owned_files,
        "d9_critical_risks": d9_critical_risks,
        "d15_field_accesses": lambda s, d: PG.field_accesses(_analysis(s, d).references),
        "d17_evidence_counts": lambda s, d: RP.evidence_counts((a := _analysis(s, d)).risks, a.warnings),
        "h4_risk_page": h4_risk_page,
        "h2_page_info": h2_page_info,
        "e14_field_list": e14_field_list,
        "e11_field_dependencies": e11_field_dependencies,
        "e10_dependency_page": e10_dependency_page,
        "f10_rule_page": f10_rule_page,
        "e21_latest_jobs": e21_latest_jobs,
        "a20_source_urls": a20_source_urls,
        "f12_affected_by_groups": f12_affected_by_groups,
        "f6_partial_reasons": lambda s, d: RP.partial_reasons((a := _analysis(s, d)).warnings, a.status),
        "f23_impact_summary": lambda s, d: RP.impact_summary(_analysis(s, d)),
        "f30_import_summary": lambda s, d: D.import_summary_warnings(_files(s, d), L.import_warnings(scan(s, d, "projects", "id", "importWarningsJson"))),
        "b8_documents": lambda s, d: RP.documents(RP.report_lines(_analysis(s, d))).select("projectId", "document", "bytes", "truncated"),
        "b8_archive_sizes": lambda s, d: RP.archive_sizes(RP.documents(RP.report_lines(_analysis(s, d)))),
        "b7_snapshot_json": lambda s, d: H.snapshot_json((a := _analysis(s, d)).sections(), a.metrics),
        "m2_claim": m2_claim,
        "m4_recovered": m4_recovered,
        "m4_orphans": m4_orphans,
        "b9_diff_documents": b9_diff_documents,
        "k3_comparable_runs": lambda s, d: H.comparable_runs(scan(s, d, "analysis_runs", "id", "projectId", "runNumber", "status", "snapshotSchemaVersion"), L.USABLE),
        "k4_legacy_candidates": lambda s, d: H.legacy_candidates(scan(s, d, "analysis_runs", "id", "projectId", "runNumber", "status", "snapshotSchemaVersion"), L.USABLE).select("id", "projectId"),
        "c9_exec_edges": lambda s, d: R.exec_edges(X.exec_sites(_files(s, d)), checkpointed(_symbols(s, d))),
        "c26_handler_edges": lambda s, d: R.handler_edges(X.form_events(_files(s, d))),
        "e7_stored_edges": lambda s, d: R.stored_edges((a := _analysis(s, d)).edges, a.symbols),
        "i2_project_risks": lambda s, d: _analysis(s, d).risks.drop("snippet"),
        "i3_project_warnings": lambda s, d: _analysis(s, d).warnings,
        "f17_run_status": lambda s, d: _analysis(s, d).status,
        "r1_build_records": lambda s, d: B.build_records(_files(s, d)),
        "r1_build_findings": r1_build_findings,
        "e20_packages": lambda s, d: B.package_resolutions(B.build_records(_files(s, d))),
        "f19_build_scores": lambda s, d: B.build_scores(r1_build_findings(s, d)),
        "m7_rate_limit": m7_rate_limit,
        "k1_last_diff": k1_last_diff,
        "k3_diff_buckets": k3_diff_buckets,
        "k5_runs": lambda s, d: L.run_list(_runs(s, d)),
    }
