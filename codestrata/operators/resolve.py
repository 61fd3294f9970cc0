"""Joins across the extracted rows: owners by line, edges to symbols, form bindings, statement evidence.

Range conditions always come with an equality on the file, so that they are planned as hash or sort-merge
joins with a residual condition, never as nested loops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.session import maybe_broadcast

# Which of two equally narrow symbols owns a line.
TYPE_RANK = {"method": 6, "function": 5, "procedure": 4, "query": 3, "table": 2, "class": 1}


def type_rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv])[c], F.lit(0))


def with_owner(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every row of ``(projectId, file, line, …)`` with the most specific symbol around its line, or nulls.

    Narrowest range first, then type rank, latest start, greatest name. Owners are found for distinct lines,
    keyed by project, file and line alone, so that a task that is run again finds the same ones.
    """
    at = ["projectId", "file", "line"]
    s = symbols.select("projectId", "file", F.col("name").alias("_n"), F.coalesce("qualifiedName", "name").alias("ownerName"), F.col("stableKey").alias("ownerKey"), F.col("startLine").alias("_s"), F.col("endLine").alias("_e"), type_rank(F.col("type")).alias("_r"))
    order = F.struct((F.col("_s") - F.col("_e")).alias("a"), F.col("_r").alias("b"), F.col("_s").alias("c"), F.col("_n").alias("d"), "ownerKey")
    hits = rows.select(*at).distinct().join(s, ["projectId", "file"]).where(F.col("line").between(F.col("_s"), F.col("_e")))
    best = hits.groupBy(*at).agg(F.max_by(F.struct("ownerKey", "ownerName"), order).alias("o"))
    return rows.join(best, at, "left").select(*[rows[c] for c in rows.columns], "o.ownerKey", "o.ownerName")


def _target(name: str) -> Column:
    return F.struct("stableKey", F.coalesce("qualifiedName", "name").alias("name")).alias(name)


def go_call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls in Go files to symbols of the same project's Go files: typed receivers first, then the first of the name.

    The lookups are one row a name; every row joins them by a key that is never null.
    """
    is_go = F.lower("file").endswith(".go")
    go = symbols.where(is_go)
    owned = with_owner(calls.where(is_go), symbols).where(F.col("ownerKey").isNotNull())
    first = lambda name: F.min_by(_target("t"), F.struct("file", "ord")).alias(name)
    methods = go.where(F.col("type") == "method")
    typed = methods.groupBy("projectId", F.col("qualifiedName").alias("_q")).agg(first("t1"))
    by_name = go.groupBy("projectId", F.col("name").alias("callee")).agg(
        F.min_by(F.when(F.col("type") == "method", _target("t")), F.when(F.col("type") == "method", F.struct("file", "ord"))).alias("t2"),
        F.min_by(F.when(F.col("type") == "function", _target("t")), F.when(F.col("type") == "function", F.struct("file", "ord"))).alias("t3"),
    )
    # "?" begins no name: calls without a known type spread by what they call and find nothing
    e = owned.withColumn("_q", F.concat_ws(".", F.coalesce(F.when(F.col("receiver").isNotNull(), F.col("receiverType")), F.lit("?")), "callee"))
    e = e.join(typed, ["projectId", "_q"], "left").join(by_name, ["projectId", "callee"], "left")
    return _edges(e.withColumn("t", F.when(F.col("receiver").isNotNull(), F.coalesce("t1", "t2")).otherwise(F.col("t3"))), "calls")


def unique_targets(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """``rows`` with ``t``: the only symbol named ``callee`` in the file, else the only one in the project, else null."""
    names = F.array_distinct(F.filter(F.array("name", "qualifiedName"), lambda x: x.isNotNull()))
    named = symbols.select("projectId", "file", F.explode(names).alias("callee"), _target("t"))
    in_file = named.groupBy("projectId", "file", "callee").agg(F.count("*").alias("n1"), F.min("t").alias("t1"))
    in_project = named.groupBy("projectId", "callee").agg(F.count("*").alias("n2"), F.min("t").alias("t2"))
    e = rows.join(in_file, ["projectId", "file", "callee"], "left").join(in_project, ["projectId", "callee"], "left")
    return e.withColumn("t", F.when(F.col("n1") == 1, F.col("t1")).when(F.col("n2") == 1, F.col("t2"))).drop("n1", "n2", "t1", "t2")


def unique_call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Pascal calls: the only symbol of the name in the file, else the only one in the project, else no edge."""
    owned = with_owner(calls.where(~F.lower("file").endswith(".go")), symbols).where(F.col("ownerKey").isNotNull())
    return _edges(unique_targets(owned, symbols), "calls")


def exec_edges(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """EXEC statements of SQL files that name a known routine; one that calls its own owner counts too."""
    owned = with_owner(sites, symbols).where(F.col("ownerKey").isNotNull())
    return _edges(unique_targets(owned, symbols), "references", own=True)


EDGE = ("projectId", "file", "line", "fromKey", "fromName", "toKey", "toName", "type")


def _edges(e: DataFrame, kind: str, own: bool = False) -> DataFrame:
    e = e.where(F.col("t").isNotNull() if own else F.col("t").isNotNull() & (F.col("t.stableKey") != F.col("ownerKey")))
    e = e.select("projectId", "file", "line", F.col("ownerKey").alias("fromKey"), F.col("ownerName").alias("fromName"), F.col("t.stableKey").alias("toKey"), F.col("t.name").alias("toName"), F.lit(kind).alias("type"))
    return deduped_edges(e)


def deduped_edges(edges: DataFrame) -> DataFrame:
    """One edge of the same ends, type and line; of several without a known target the first name stands for all."""
    first = F.min(F.struct("file", "toName", "fromName")).alias("f")
    return edges.groupBy("projectId", "fromKey", "toKey", "type", "line").agg(first).select("projectId", "f.file", "line", "fromKey", "f.fromName", "toKey", "f.toName", "type")


def import_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """External references from the first symbol of the importing file, else from the first one of the project.

    Every imported name stays an edge of its own here; :func:`deduped_edges` folds those of one line.
    """
    one = lambda order: F.min_by(_target("t"), order)
    in_file = symbols.groupBy("projectId", "file").agg(one(F.col("ord")).alias("t1"))
    in_project = symbols.groupBy("projectId").agg(one(F.struct("file", "ord")).alias("t2"))
    e = imports.join(in_file, ["projectId", "file"], "left").join(maybe_broadcast(in_project), "projectId", "left").withColumn("s", F.coalesce("t1", "t2")).where(F.col("s").isNotNull())
    return e.select("projectId", "file", "line", F.col("s.stableKey").alias("fromKey"), F.col("s.name").alias("fromName"), F.lit(None).cast("string").alias("toKey"), F.col("target").alias("toName"), F.lit("references").alias("type")).distinct()


def handler_edges(events: DataFrame) -> DataFrame:
    """References from the symbol of a form event to the name of its handler; they are resolved when stored."""
    full = F.concat_ws(".", "formName", "component", "event")
    key = F.concat_ws("::", "file", full, F.col("line").cast("string"))
    return events.select("projectId", "file", "line", key.alias("fromKey"), full.alias("fromName"), F.lit(None).cast("string").alias("toKey"), F.col("handler").alias("toName"), F.lit("references").alias("type"))


def project_edges(calls: DataFrame, execs: DataFrame, imports: DataFrame, events: DataFrame, symbols: DataFrame) -> DataFrame:
    """All edges of a project, each once."""
    parts = [go_call_edges(calls, symbols), unique_call_edges(calls, symbols), exec_edges(execs, symbols), import_edges(imports, symbols), handler_edges(events)]
    return deduped_edges(reduce(DataFrame.unionByName, parts))


def stored_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges as they are stored: a target that is not known yet is the only symbol of its name, if there is just one.

    ``targetKind`` is internal, external (an import) or unresolved; ``targetExternalName`` stands where no symbol does.
    """
    known = edges.where(F.col("toKey").isNotNull()).withColumn("key", F.col("toKey"))
    open_ = unique_targets(edges.where(F.col("toKey").isNull()).withColumn("callee", F.col("toName")), symbols).withColumn("key", F.col("t.stableKey"))
    e = known.select(*EDGE, "key").unionByName(open_.select(*EDGE, "key"))
    form = F.lower("file").rlike(r"\.(dfm|fmx)$")
    kind = F.when(F.col("key").isNotNull(), "internal").when(form | (F.col("type") == "calls"), "unresolved").otherwise("external")
    return e.select("projectId", "file", "line", "type", "fromKey", "fromName", F.col("key").alias("targetKey"), F.when(F.col("key").isNull(), F.col("toName")).alias("targetExternalName"), kind.alias("targetKind"))


def _base(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]+$", ""))


def event_handlers(events: DataFrame, symbols: DataFrame) -> DataFrame:
    """Form events with the method that handles them: by qualified name (or its owner), in the form's unit, then if unique.

    Every step looks up one row a name: a handler name that a third of all forms share is never paired with
    all methods of that name. A step that finds several keeps the event ambiguous unless a later, narrower one
    decides. ``status`` is resolved, ambiguous or unresolved; ``warning`` says why.
    """
    methods = symbols.where(F.col("type").isin("method", "procedure", "function") & F.lower("file").rlike(r"\.(pas|dpr|inc|dpk)$"))
    m = methods.select("projectId", F.lower("name").alias("_h"), F.lower("qualifiedName").alias("_q"), _base(F.col("file")).alias("_b"), F.struct(F.col("file").alias("methodFile"), "startLine", F.coalesce("qualifiedName", "name").alias("method"), "stableKey").alias("m"))

    def lookup(name: str, *keys: str) -> DataFrame:
        return m.groupBy("projectId", *keys).agg(F.count_distinct("m").alias(f"n{name}"), F.min("m").alias(f"m{name}"))

    e = events.withColumn("_h", F.lower("handler")).withColumn("_b", _base(F.col("file")))
    e = e.withColumn("_q", F.lower(F.concat_ws(".", F.coalesce("formClass", F.concat(F.lit("T"), "formName")), "handler")))
    e = e.join(lookup("q", "_q"), ["projectId", "_q"], "left").join(lookup("qb", "_q", "_b"), ["projectId", "_q", "_b"], "left")
    e = e.join(lookup("b", "_h", "_b"), ["projectId", "_h", "_b"], "left").join(lookup("h", "_h"), ["projectId", "_h"], "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(0))
    one = F.when(has("nq") == 1, F.col("mq")).when(has("nq") > 1, F.when(has("nqb") == 1, F.col("mqb"))).when(has("nb") == 1, F.col("mb")).when(has("nb") > 1, F.lit(None)).when(has("nh") == 1, F.col("mh"))
    e = e.withColumn("m", one)
    status = F.when(F.col("m").isNotNull(), "resolved").when(has("nh") > 0, "ambiguous").otherwise("unresolved")
    warning = (
        F.when(status == "ambiguous", F.concat(F.lit("Handler "), F.col("handler"), F.lit(" matched "), has("nh").cast("string"), F.lit(" Pascal symbols.")))
        .when(status == "unresolved", "No matching Pascal procedure/function/method was found by stable key, qualified name, owner, same unit, or unique project candidate.")
        .when(_base(F.col("m.methodFile")) != F.col("_b"), "Resolved outside the same DFM/PAS basename; verify inherited forms or cross-unit handler wiring.")
    )
    return e.select(*events.columns, status.alias("status"), F.col("m.method").alias("method"), F.col("m.methodFile").alias("methodFile"), F.col("m.stableKey").alias("methodKey"), warning.alias("warning"))


# Components that show or edit a field.
DB_AWARE = ("TDBEdit", "TDBText", "TDBMemo", "TDBCheckBox", "TDBComboBox", "TDBLookupComboBox", "TDBGrid", "TDBRadioGroup", "TDBNavigator")


def data_bindings(objects: DataFrame) -> DataFrame:
    """Database-aware components with their data source, data set, table and field; grids give a row a column."""
    p = lambda name: F.col("properties")[name]
    keys = ["projectId", "fileId", "file"]
    last = lambda v: F.max_by(v, F.col("line"))
    sources = objects.where((F.lower("class") == "tdatasource") & p("DataSet").isNotNull()).groupBy(*keys, F.lower("name").alias("_s")).agg(last(p("DataSet")).alias("dataSet"))
    sets = objects.where(p("TableName").isNotNull()).groupBy(*keys, F.lower("name").alias("_d")).agg(last(p("TableName")).alias("resolvedTable"))
    c = objects.where(F.col("class").isin(*DB_AWARE))
    boolean = lambda v: F.when(F.lower(v) == "true", True).when(F.lower(v) == "false", False)
    c = c.select(*keys, "line", "formName", F.col("name").alias("component"), F.col("class").alias("componentClass"), p("DataSource").alias("dataSource"), p("DataField").alias("_f"), "columns", boolean(p("ReadOnly")).alias("readOnly"), boolean(p("Enabled")).alias("enabled"), boolean(p("Visible")).alias("visible"))
    c = c.withColumn("_s", F.lower("dataSource")).join(sources, [*keys, "_s"], "left").withColumn("_d", F.lower("dataSet")).join(sets, [*keys, "_d"], "left")
    fields = F.when(F.col("componentClass") == "TDBGrid", F.when(F.size("columns") > 0, F.col("columns")).otherwise(F.array(F.lit(None).cast("string")))).otherwise(F.array("_f"))
    c = c.withColumn("dataField", F.explode(fields))
    hint = F.when(F.col("readOnly").eqNullSafe(True) | F.col("enabled").eqNullSafe(False), "read-only").when(F.col("dataSource").isNotNull() & F.col("dataSet").isNotNull(), "read-write").otherwise("unresolved")
    sure = F.when(F.col("dataSource").isNotNull() & F.col("dataSet").isNotNull() & F.col("dataField").isNotNull(), "high").when(F.col("dataSource").isNotNull() & F.col("dataField").isNotNull(), "medium").otherwise("low")
    return c.select(*keys, "line", "formName", "component", "componentClass", "dataSource", "dataSet", "resolvedTable", "dataField", "readOnly", "enabled", "visible", hint.alias("accessHint"), sure.alias("confidence"))


# The marks of a table in a statement, of a credential in one, and the longest text kept.
_TABLE = r"(?i)\b(?:from|join|update|into|delete\s+from)\s+([A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)?|\[[^\]]+\](?:\.\[[^\]]+\])?|\"[^\"]+\"(?:\.\"[^\"]+\")?)"
_SECRET = r"(?i)((?:password|passwd|pwd|token|secret|api[_-]?key)\s*=\s*)'[^']*'"
EVIDENCE_LENGTH = 2000


def sql_evidence(statements: DataFrame) -> DataFrame:
    """Statements with credentials masked, operation, tables, confidence and a key; texts are cut at 2,000 characters by definition."""
    masked = F.regexp_replace("sql", _SECRET, "$1'<redacted>'")
    sql = F.substring(T.squeezed(masked), 1, EVIDENCE_LENGTH)
    first = F.lower(F.regexp_extract(F.col("normalizedSql"), r"^(\S+)", 1))
    operation = F.when(first.isin("select", "insert", "update", "delete"), first).when(first.isin("exec", "execute"), "execute").otherwise("unknown")
    tables = F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all("normalizedSql", F.lit(_TABLE), F.lit(1)), lambda t: F.trim(F.regexp_replace(t, r'[\[\]"]', ""))), lambda t: t != "")))
    dynamic = F.coalesce("dynamic", F.lit(False)) if "dynamic" in statements.columns else F.lit(False)
    s = statements.select("projectId", "fileId", "file", "line", sql.alias("normalizedSql"), dynamic.alias("dynamic"))
    s = s.withColumn("operation", operation).withColumn("tables", F.array_join(tables, ","))
    key = F.substring(F.sha2(F.concat_ws(":", "file", F.col("line").cast("string"), "normalizedSql"), 256), 1, 16)
    access = F.when(F.col("operation") == "select", "read").when(F.col("operation").isin("insert", "update", "delete"), "write").otherwise("unknown")
    s = s.withColumn("access", access).withColumn("stableKey", F.concat(F.col("file"), F.lit("::sql::"), F.col("line").cast("string"), F.lit("::"), key))
    s = s.withColumn("confidence", F.when(F.col("dynamic"), "medium").otherwise("high"))
    return s.withColumn("warning", F.when(F.col("dynamic"), "SQL appears dynamically constructed; table or field extraction may be incomplete."))


def with_fields(evidence: DataFrame, references: DataFrame) -> DataFrame:
    """Evidence with ``fields``: table, field and access of every reference on the lines of the statement, in order."""
    at = ["projectId", "file", "line"]
    r = references.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct(F.col("tableName").alias("table"), "field", F.col("access").alias("operation")))).alias("fields"))
    return evidence.join(r, at, "left")


def missing_where(statements: DataFrame) -> DataFrame:
    """UPDATE and DELETE statements without a WHERE clause (critical)."""
    return statements.where(F.col("sql").rlike(r"(?i)^(UPDATE|DELETE)\b") & ~F.col("sql").rlike(r"(?i)\bWHERE\b")).select("projectId", "fileId", "file", "line", "sql")


def multiple_writes(references: DataFrame) -> DataFrame:
    """Fields written at two places or more: medium, from three on high; the first place represents them."""
    w = references.where(F.col("access") == "write").withColumn("k", T.field_identity(F.col("tableName"), F.col("field")))
    g = w.groupBy("projectId", "k.schema", "k.table", F.col("k.field").alias("fieldKey")).agg(F.count("*").alias("writes"), F.min(F.struct("file", "line")).alias("f"))
    g = g.where(F.col("writes") >= 2)
    return g.select("projectId", "schema", "table", "fieldKey", "writes", F.when(F.col("writes") >= 3, "high").otherwise("medium").alias("severity"), F.col("f.file").alias("file"), F.col("f.line").alias("line"))


def field_usage(references: DataFrame) -> DataFrame:
    """Reads, writes and all references per field, as the tables name them."""
    return references.groupBy("projectId", "tableName", "field").agg(F.count_if(F.col("access") == "read").alias("readCount"), F.count_if(F.col("access") == "write").alias("writeCount"), F.count("*").alias("referenceCount"))


def table_usage(references: DataFrame) -> DataFrame:
    """Per table: distinct fields and references."""
    return references.groupBy("projectId", "tableName").agg(F.count_distinct("field").alias("fieldCount"), F.count_if(F.col("access") == "read").alias("readCount"), F.count_if(F.col("access") == "write").alias("writeCount"), F.count("*").alias("referenceCount"))
