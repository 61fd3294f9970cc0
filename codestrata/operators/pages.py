"""Lists of one owned project with filters, search, total order and clamped pages.

Every list is declared as rows, conditions and an order; :func:`paged` adds the page. Without a project the list
runs over all projects of the owner. Filters and the project reach the scan; a search over names of other
tables is a join with those names followed by one filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import lists as L
from codestrata.operators import risks as K
from codestrata.operators import views as V
from codestrata.session import maybe_broadcast

#: Longest search term a list takes.
MAX_SEARCH = 200


@dataclass(frozen=True)
class Request:
    """What a list is asked for; a blank search finds everything, a longer one than ``MAX_SEARCH`` is refused."""

    project: int | None = None
    user: int | None = None
    search: str = ""
    page: int = 1
    size: int = L.PAGE_SIZE

    def __post_init__(self) -> None:
        if len(self.search) > MAX_SEARCH:
            raise ValueError(f"search longer than {MAX_SEARCH}")


def owned(projects: DataFrame, user: int | None, project: int | None = None) -> DataFrame:
    """Ids of the projects of a user (all without one), narrowed to one project if given."""
    p = projects if user is None else projects.where(F.col("userId") == user)
    return (p if project is None else p.where(F.col("id") == project)).select(F.col("id").alias("projectId"))


def scoped(rows: DataFrame, projects: DataFrame, r: Request) -> DataFrame:
    """Rows of the project asked for, if the user owns it; a literal filter first, so that it reaches the scan."""
    if r.project is not None:
        rows = rows.where(F.col("projectId") == r.project)
    return rows.join(maybe_broadcast(owned(projects, r.user, r.project)), "projectId", "left_semi")


def visible_projects(projects: DataFrame, jobs: DataFrame, user: int | None = None) -> DataFrame:
    """Projects of a user with their latest job; drafts that never had one are hidden."""
    p = projects if user is None else projects.where(F.col("userId") == user)
    out = p.join(latest_jobs(jobs).withColumnRenamed("projectId", "id"), "id", "left")
    return out.where((F.col("status") != "draft") | F.col("jobId").isNotNull())


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """``(projectId, jobId, jobStatus)``: the job with the greatest id of every project."""
    best = jobs.groupBy("projectId").agg(F.max_by(F.struct("id", "status"), "id").alias("j"))
    return best.select("projectId", F.col("j.id").alias("jobId"), F.col("j.status").alias("jobStatus"))


def paged(rows: DataFrame, order: Sequence[Column], r: Request) -> DataFrame:
    return L.page(rows, order, r.page, r.size)


def page_info(rows: DataFrame, r: Request) -> DataFrame:
    """``(total, page, pageSize, pageCount)`` of a list, the page clamped to those there are."""
    size = min(L.MAX_PAGE_SIZE, max(1, r.size))
    total = rows.agg(F.count("*").alias("total"))
    count = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("int")
    return total.select("total", F.least(F.lit(max(1, r.page)), count).alias("page"), F.lit(size).alias("pageSize"), count.alias("pageCount"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _number(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


# Total orders; null counts as '' or 0.
ORDERS = {
    "files": lambda: [F.col("projectId"), _text("filePath"), _text("fileName"), _number("id")],
    "symbols": lambda: [F.col("projectId"), _text("name"), _text("file"), _number("startLine"), _text("stableKey")],
    "dependencies": lambda: [F.col("projectId"), _text("sourceName"), _text("targetName"), _number("line"), _text("file"), _text("type")],
    "fields": lambda: [F.col("projectId"), _text("tableName"), _text("field")],
    "risks": lambda: [F.col("projectId"), T.severity_rank(F.col("severity")).desc(), _text("title"), _text("sourceFile"), _number("lineNumber"), _text("key")],
    "rules": lambda: [F.col("projectId"), _text("ruleType"), _text("title"), _text("sourceFile"), _number("lineNumber"), _text("key")],
    "fieldDependencies": lambda: [F.col("projectId"), _text("tableName"), _text("field"), _text("symbolName"), _number("line"), _text("access"), _text("file")],
}


def symbol_list(symbols: DataFrame, projects: DataFrame, r: Request, kind: str | None = None) -> DataFrame:
    """Symbols by kind; the search covers name, qualified name and file."""
    return L.filtered(scoped(symbols, projects, r), {"type": kind}, r.search, ["name", "qualifiedName", "file"])


def field_list(fields: DataFrame, references: DataFrame, projects: DataFrame, r: Request, table: str | None = None) -> DataFrame:
    """Fields with their reads, writes and references; a field nobody uses shows zeros."""
    f = L.filtered(scoped(fields, projects, r), {"tableName": table}, r.search, ["tableName", "field"]).withColumn("k", T.field_identity(F.col("tableName"), F.col("field")))
    u = scoped(references, projects, r).withColumn("k", T.field_identity(F.col("tableName"), F.col("field"))).groupBy("projectId", "k")
    u = u.agg(F.count_if(F.col("access") == "read").alias("readCount"), F.count_if(F.col("access") == "write").alias("writeCount"), F.count("*").alias("referenceCount"))
    return f.join(u, ["projectId", "k"], "left").drop("k").na.fill(0, ["readCount", "writeCount", "referenceCount"])


def risk_list(risks: DataFrame, projects: DataFrame, r: Request, *, severity: str | None = None, kind: str | None = None, critical_only: bool = False, file: str = "") -> DataFrame:
    """Risk occurrences by severity, type, file and normalised text: filtered after they are folded, before they are grouped."""
    o = L.filtered(K.risk_occurrences(scoped(risks, projects, r)), {"severity": "critical" if critical_only else severity, "riskType": kind})
    if file.strip():
        o = o.where(F.contains(T.normalized_text(F.col("sourceFile")), T.normalized_text(F.lit(file))))
    return o.where(V.normalized_search(["title", "description", "recommendation", "sourceFile", "riskType"], r.search)) if r.search.strip() else o


def rule_list(rules: DataFrame, projects: DataFrame, r: Request, kind: str | None = None) -> DataFrame:
    """Rule occurrences by type and normalised text."""
    o = L.filtered(V.rule_occurrences(scoped(rules, projects, r)), {"ruleType": kind})
    return o.where(V.normalized_search(["title", "description", "recommendation", "sourceFile", "ruleType"], r.search)) if r.search.strip() else o


def dependency_list(stored: DataFrame, symbols: DataFrame, projects: DataFrame, r: Request, *, kind: str | None = None, target: str | None = None, hide_standard: bool = True) -> DataFrame:
    """Stored edges with the names of both ends, by type and kind of target; standard-library targets are hidden by default."""
    s = symbols.select("projectId", F.col("stableKey").alias("targetKey"), F.coalesce("qualifiedName", "name").alias("targetSymbol"))
    e = scoped(stored, projects, r).join(s, ["projectId", "targetKey"], "left")
    e = e.withColumn("sourceName", F.coalesce("fromName", F.concat(F.lit("symbol:"), "fromKey"))).withColumn("targetName", F.coalesce("targetExternalName", "targetSymbol"))
    e = L.filtered(e, {"type": kind, "targetKind": target}, r.search, ["sourceName", "targetSymbol", "targetExternalName"])
    if hide_standard:
        e = e.where(~T.is_standard_unit(F.col("targetName")))
    return e.select("projectId", "file", "line", "type", "sourceName", "targetName", "targetKind")


def dependency_summary(stored: DataFrame) -> DataFrame:
    """Per project: internal, external, unresolved and standard-library edges, whatever a list hides."""
    n = lambda kind, cond=F.lit(True): F.count_if((F.col("targetKind") == kind) & cond)
    return stored.groupBy("projectId").agg(n("internal").alias("internalCount"), n("external").alias("externalCount"), n("unresolved").alias("unresolvedCount"), n("external", T.is_standard_unit(F.col("targetExternalName"))).alias("standardLibraryCount"))


def field_dependency_list(references: DataFrame, projects: DataFrame, r: Request, *, table: str | None = None, operation: str | None = None) -> DataFrame:
    """Reads and writes with table, field and the symbol they stand in (``unknown`` where there is none); the search covers the context too."""
    f = scoped(references, projects, r).select(
        "projectId", "file", "line", F.coalesce("tableName", F.lit("unknown")).alias("tableName"), F.coalesce("field", F.lit("unknown")).alias("field"),
        F.coalesce("ownerName", F.concat(F.lit("symbol:"), "ownerKey"), F.lit("unknown")).alias("symbolName"), "access", "context",
    )
    return L.filtered(f, {"tableName": table, "access": operation}, r.search, ["tableName", "field", "symbolName", "context"])


# what a field access in Pascal is made of
def field_accesses(references: DataFrame) -> DataFrame:
    """Field accesses in Pascal sources: whether by field or parameter, and the object in front of the call."""
    c = F.coalesce("context", F.lit(""))
    kind = F.when(c.rlike(r"(?i)ParamByName\s*\("), "ParamByName").when(c.rlike(r"(?i)FieldByName\s*\("), "FieldByName").otherwise("SQL")
    owner = F.regexp_extract(c, r"(?i)([A-Za-z_]\w*)\s*\.\s*(?:FieldByName|ParamByName)\s*\(", 1)
    kept = references.where(F.lower("file").endswith(".pas") | (kind != "SQL"))
    return kept.select("projectId", "file", "line", "tableName", "field", "access", kind.alias("accessKind"), F.when(owner != "", owner).alias("ownerObject"))
