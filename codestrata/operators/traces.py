"""Flow traces: from a form event through handler, calls and statements to tables and fields, and from data bindings.

A trace is one row with its steps in an array. What is behind a handler is the same for every event that it
handles, so walks are made once a handler, over the part of the call graph that a trace can reach at all
(:func:`reachable`), and joined to the events.
"""

from __future__ import annotations

from collections import defaultdict
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.operators.lists import all_of
from codestrata.session import checkpointed

# Limits of the report (calls deep, steps a trace, traces a project) and what it says where they are met.
MAX_DEPTH, MAX_STEPS, MAX_TRACES = 8, 200, 2000
STEP_LIMIT = f"FLOW_TRACE_STEP_LIMIT_REACHED: trace stopped after {MAX_STEPS} steps."
DEPTH_LIMIT = f"FLOW_TRACE_MAX_CALL_DEPTH_REACHED: traversal exceeded depth {MAX_DEPTH}."
DYNAMIC = "Dynamic SQL lowers flow confidence."
NO_TABLE = "DataSet component was resolved, but its database table could not be determined statically."

STEP = "struct<type:string,label:string,file:string,line:int,operation:string>"
FIELD = "struct<table:string,field:string,operation:string>"
WALK = f"projectId long, root string, steps array<{STEP}>, tables array<string>, fields array<{FIELD}>, warnings array<string>, broken boolean, truncated boolean"
#: Steps in front of a walk: component, event and handler.
HEAD = 3
TRACE = (
    "projectId", "kind", "stableKey", "file", "formName", "componentName", "componentClass", "eventName", "handlerName", "resolvedHandler",
    "status", "confidence", "steps", "affectedTables", "affectedFields", "warnings", "truncated",
)


def stable_part(c: Column) -> Column:
    """A part of a trace's key: runs of other characters than letters, digits, ``_``, ``.`` and ``-`` become ``_``."""
    return F.regexp_replace(F.coalesce(c, F.lit("unknown")), r"[^\w.-]+", "_")


def adjacency(edges: DataFrame, evidence: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(projectId, key, place, …)``: what a symbol holds in the order a trace takes it, statements first, then calls.

    A trace of ``MAX_STEPS`` takes one step an entry at least: entries behind that place are out of reach for all.
    """
    shown = symbols.select("projectId", F.col("stableKey").alias("target"), F.coalesce("qualifiedName", "name").alias("shown"), F.col("file").alias("targetFile"), F.col("startLine").alias("targetLine"))
    calls = edges.where((F.col("type") == "calls") & F.col("toKey").isNotNull()).select("projectId", F.col("fromKey").alias("key"), F.lit(1).alias("kind"), "line", F.col("toName").alias("label"), F.col("toKey").alias("target"))
    calls = calls.join(shown, ["projectId", "target"], "left")
    owned = evidence.where(F.col("ownerKey").isNotNull())
    fields = F.col("fields") if "fields" in evidence.columns else F.lit(None)
    dynamic = F.col("dynamic") if "dynamic" in evidence.columns else F.lit(False)
    label = F.concat_ws(" ", F.upper("operation"), F.when(F.col("tables") == "", "unknown table").otherwise(F.regexp_replace("tables", ",", ", ")))
    sql = owned.select(
        "projectId", F.col("ownerKey").alias("key"), F.lit(0).alias("kind"), "line", label.alias("label"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("shown"),
        F.col("file").alias("targetFile"), F.col("line").alias("targetLine"), F.col("stableKey").alias("_k"), "tables", F.col("access").alias("operation"), fields.cast(f"array<{FIELD}>").alias("fields"), dynamic.alias("dynamic"),
    )
    both = sql.unionByName(calls, allowMissingColumns=True)
    place = F.row_number().over(W.partitionBy("projectId", "key").orderBy("kind", "line", "_k", "label", "target"))
    return both.withColumn("place", place).where(F.col("place") <= MAX_STEPS).drop("_k")


def reachable(roots: DataFrame, entries: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """``(projectId, root, key, cost)``: symbols that a trace from ``roots(projectId, root)`` may expand.

    ``cost`` is the least sum of places on a way to the symbol: so many steps are taken before it is met, so
    ways beyond ``MAX_STEPS`` are left, which loses nothing. Level by level, from the roots only.
    """
    step = entries.where(F.col("target").isNotNull()).select("projectId", "key", F.col("target").alias("next"), "place")
    found = roots.select("projectId", "root", F.col("root").alias("key"), F.lit(0).alias("cost")).distinct()
    fresh = found
    for _ in range(depth):
        far = fresh.join(step, ["projectId", "key"]).select("projectId", "root", F.col("next").alias("key"), (F.col("cost") + F.col("place")).alias("cost"))
        far = far.where(F.col("cost") < MAX_STEPS).groupBy("projectId", "root", "key").agg(F.min("cost").alias("cost"))
        known = found.groupBy("projectId", "root", "key").agg(F.min("cost").alias("known"))
        # each level is written to the shared folder: the plan stays small and a lost executor costs one level
        fresh = checkpointed(far.join(known, ["projectId", "root", "key"], "left").where(F.col("known").isNull() | (F.col("cost") < F.col("known"))).drop("known"))
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    return found.groupBy("projectId", "root", "key").agg(F.min("cost").alias("cost"))


def walks(roots: DataFrame, entries: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row a root: what a trace finds behind its handler, depth first.

    Every symbol is expanded once; calls back into the active path are reported as cycles. A task holds what
    one handler can reach, at most ``MAX_STEPS`` entries a symbol.
    """
    reach = reachable(roots, entries)
    names = symbols.select("projectId", F.col("stableKey").alias("key"), F.coalesce("qualifiedName", "name").alias("name"))
    rows = reach.join(names, ["projectId", "key"], "left").join(entries, ["projectId", "key"], "left")
    rows = rows.select("projectId", "root", "key", "name", "kind", "place", "line", "label", "target", "shown", "targetFile", "targetLine", "tables", "operation", F.to_json("fields").alias("fields"), "dynamic")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import json

        graph: dict[str, list] = defaultdict(list)
        names = dict(zip(rows["key"], rows["name"]))
        for r in rows.sort_values("place").itertuples():
            if r.place == r.place and r.place is not None:
                graph[r.key].append(r)
        project, root = int(rows["projectId"].iloc[0]), rows["root"].iloc[0]
        got = _walk(graph, names, root, lambda x: json.loads(x) if isinstance(x, str) else [])
        return pd.DataFrame([(project, root, *got)], columns=["projectId", "root", "steps", "tables", "fields", "warnings", "broken", "truncated"])

    return rows.groupBy("projectId", "root").applyInPandas(run, WALK)


def _walk(graph: dict[str, list], names: dict[str, str], root: str, fields_of) -> tuple:
    """Steps, tables, fields, warnings, and whether a way was broken off or the trace cut."""
    steps: list[dict] = []
    tables: set[str] = set()
    fields: dict[tuple, dict] = {}
    warnings: dict[str, None] = {}
    state = {"broken": False, "full": False}

    def push(kind: str, label: str, file=None, line=None, operation=None) -> bool:
        used = HEAD + len(steps)
        if state["full"] or used >= MAX_STEPS or kind != "warning" and used == MAX_STEPS - 1:
            if not state["full"]:
                state["full"] = True
                warnings.setdefault(STEP_LIMIT)
                if used < MAX_STEPS:
                    steps.append({"type": "warning", "label": STEP_LIMIT, "file": None, "line": None, "operation": None})
            return False
        steps.append({"type": kind, "label": label, "file": file, "line": None if line is None or line != line else int(line), "operation": operation})
        return True

    def warn(message: str, file=None, line=None) -> None:
        warnings.setdefault(message)
        state["broken"] = True
        push("warning", message, file, line)

    def statement(r) -> bool:
        if not push("sql", r.label, r.targetFile, r.targetLine, r.operation):
            return False
        if r.dynamic:
            warnings.setdefault(DYNAMIC)
        for t in (r.tables or "").split(","):
            if t and r.operation != "unknown":
                tables.add(t)
            if t and not push("table", t, operation=r.operation):
                break
        for f in fields_of(r.fields):
            fields[f.get("table"), f.get("field"), f.get("operation")] = f
            if not push("field", f"{f.get('table')}.{f.get('field')}", operation=f.get("operation")):
                break
        return True

    done, path = {root}, [root]
    stack = [iter(graph.get(root, ()))]  # an explicit stack: one iterator a symbol on the path
    blocked = False  # no more statements of the symbol at hand
    while stack:
        r = next(stack[-1], None)
        if r is None:
            stack.pop()
            path.pop()
            blocked = False
        elif r.kind == 0:
            blocked = blocked or not statement(r)
        elif not push("call", r.shown or r.label, r.targetFile, r.targetLine):
            stack[-1] = iter(())
        elif r.target in path:
            ring = [names.get(k) or k for k in [*path[path.index(r.target) :], r.target]]
            warn(f"FLOW_TRACE_CALL_CYCLE: {' -> '.join(ring)}", r.targetFile, r.line)
        elif r.target not in done:
            if len(path) > MAX_DEPTH:
                warn(DEPTH_LIMIT, r.targetFile, r.targetLine)
                state["cut"] = True
                continue
            done.add(r.target)
            path.append(r.target)
            stack.append(iter(graph.get(r.target, ())))
            blocked = False
    ordered = [fields[k] for k in sorted(fields, key=lambda k: tuple(x or "" for x in k))]
    return steps, sorted(tables), ordered, sorted(warnings), state["broken"] or state["full"], state["full"] or "cut" in state


def _step(kind: str, label: Column, operation: Column | None = None, file: str = "file", line: str = "line") -> Column:
    return F.struct(F.lit(kind).alias("type"), label.alias("label"), F.col(file).alias("file"), F.col(line).cast("int").alias("line"), (F.lit(None).cast("string") if operation is None else operation).alias("operation"))


def _level(status: Column, warnings: Column) -> Column:
    n = F.size(warnings)
    return F.when(status == "complete", F.when(n >= 2, "low").when(n == 1, "medium").otherwise("high")).when(status == "partial", "medium").otherwise("low")


def _descriptors(handlers: DataFrame, bindings: DataFrame) -> DataFrame:
    """What there is a trace for, in the order in which traces are kept, at most ``MAX_TRACES`` a project.

    The first places come from a limit that every task applies to its own rows before the exchange.
    """
    none = F.lit(None).cast("string")
    key = lambda *parts: F.concat_ws(":", *parts)
    e = handlers.select(
        "projectId", F.lit("event").alias("kind"), key(*[stable_part(F.col(c)) for c in ("formName", "component", "event", "handler")]).alias("stableKey"), "file", "line", "formName", F.col("component").alias("componentName"),
        "componentClass", F.col("event").alias("eventName"), F.col("handler").alias("handlerName"), F.col("method").alias("resolvedHandler"), F.col("methodKey").alias("root"), F.col("status").alias("found"), F.col("warning").alias("said"),
    )
    b = bindings.select(
        "projectId", F.lit("binding").alias("kind"), key(stable_part(F.col("formName")), stable_part(F.col("component")), F.lit("binding"), stable_part(F.col("dataField")), stable_part(F.col("dataSet"))).alias("stableKey"), "file", "line", "formName", F.col("component").alias("componentName"),
        "componentClass", none.alias("eventName"), none.alias("handlerName"), none.alias("resolvedHandler"), none.alias("root"), F.col("confidence").alias("found"), none.alias("said"),
        "dataSource", "dataSet", "resolvedTable", "dataField", "accessHint",
    )
    every = e.unionByName(b, allowMissingColumns=True)
    order = [F.lower(F.coalesce(c, F.lit(""))) for c in ("formName", "componentName", "eventName", "stableKey")]
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("projectId").orderBy(*order, F.col("kind").desc(), "file", "line"))).where(F.col("rank") <= MAX_TRACES)
    counts = every.groupBy("projectId").agg(F.count("*").alias("candidates"))
    return ranked.join(counts, "projectId")


def flow_traces(handlers: DataFrame, bindings: DataFrame, edges: DataFrame, evidence: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row a trace (:data:`TRACE`), at most ``MAX_TRACES`` a project; the last of a cut project says so.

    ``status`` is complete, partial (a way breaks off) or unresolved. Projects without forms give no rows.
    """
    d = checkpointed(_descriptors(handlers, bindings))
    entries = checkpointed(adjacency(edges, evidence, symbols))
    found = walks(d.where(F.col("root").isNotNull()).select("projectId", "root").distinct(), entries, symbols)
    strings = F.array().cast("array<string>")
    unresolved = F.when(F.col("found") == "ambiguous", F.concat(F.lit("Ambiguous handler "), "handlerName")).otherwise(F.concat(F.lit("Handler "), "handlerName", F.lit(" was not resolved to a persisted Pascal symbol.")))

    e = d.where(F.col("kind") == "event").join(found, ["projectId", "root"], "left")
    third = F.when(F.col("root").isNotNull(), _step("handler", F.coalesce("resolvedHandler", "handlerName"))).otherwise(_step("warning", unresolved))
    steps = F.concat(F.array(_step("ui_component", F.concat_ws(".", "componentClass", "componentName")), _step("event", F.col("eventName")), third), F.coalesce("steps", F.array().cast(f"array<{STEP}>")))
    said = F.filter(F.array("said", F.when(F.col("root").isNull(), unresolved)), lambda x: x.isNotNull())
    warnings = F.array_sort(F.array_distinct(F.concat(said, F.coalesce("warnings", strings))))
    status = F.when(F.col("root").isNull(), "unresolved").when(F.coalesce("broken", F.lit(False)) | F.coalesce("truncated", F.lit(False)), "partial").otherwise("complete")
    e = e.withColumn("status", status).withColumn("warnings", warnings)
    e = e.select("*", _level(F.col("status"), F.col("warnings")).alias("confidence")).withColumn("steps", steps)
    e = e.withColumn("affectedTables", F.coalesce("tables", strings)).withColumn("affectedFields", F.coalesce("fields", F.array().cast(f"array<{FIELD}>")))

    b = d.where(F.col("kind") == "binding")
    reads = F.when(F.col("accessHint") == "read-only", "read").otherwise("unknown")
    whole = F.col("dataField").isNotNull() & F.col("resolvedTable").isNotNull()
    label = F.concat(F.lit("DataSource "), F.coalesce("dataSource", F.lit("unresolved")), F.lit(" -> DataSet "), F.coalesce("dataSet", F.lit("unresolved")))
    taken = [
        _step("ui_component", F.concat_ws(".", "componentClass", "componentName")), _step("data_binding", label), F.when(F.col("resolvedTable").isNotNull(), _step("table", F.col("resolvedTable"), F.lit("unknown"))),
        F.when(F.col("dataField").isNotNull(), _step("field", F.concat_ws(".", "resolvedTable", "dataField"), F.when(whole, reads).otherwise("unknown"))),
    ]
    b = b.withColumn("steps", F.filter(F.array(*taken), lambda x: x.isNotNull()))
    b = b.withColumn("status", F.when((F.col("found") == "high") & F.col("resolvedTable").isNotNull(), "complete").when(F.col("found") == "low", "unresolved").otherwise("partial"))
    b = b.withColumn("confidence", F.when(F.col("resolvedTable").isNotNull() | (F.col("found") != "high"), F.col("found")).otherwise("medium"))
    b = b.withColumn("warnings", F.when(F.col("dataSet").isNotNull() & F.col("resolvedTable").isNull(), F.array(F.lit(NO_TABLE))).otherwise(strings)).withColumn("truncated", F.lit(False))
    b = b.withColumn("affectedTables", F.filter(F.array("resolvedTable"), lambda x: x.isNotNull()))
    one = F.struct(F.col("resolvedTable").alias("table"), F.col("dataField").alias("field"), reads.alias("operation"))
    b = b.withColumn("affectedFields", F.when(whole, F.array(one)).otherwise(F.array().cast(f"array<{FIELD}>")))

    last = (F.col("candidates") > MAX_TRACES) & (F.col("rank") == MAX_TRACES)
    cut = F.concat(F.lit(f"FLOW_TRACE_LIMIT_REACHED: persisted {MAX_TRACES} of "), F.col("candidates").cast("string"), F.lit(" candidate traces."))
    both = e.withColumn("truncated", F.coalesce("truncated", F.lit(False))).select(*TRACE, "candidates", "rank").unionByName(b.select(*TRACE, "candidates", "rank"))
    both = both.withColumn("status", F.when(last & (F.col("status") == "complete"), "partial").otherwise(F.col("status")))
    both = both.withColumn("confidence", F.when(last & (F.col("confidence") == "high"), "medium").otherwise(F.col("confidence")))
    return both.withColumn("warnings", F.when(last, F.array_sort(F.array_append("warnings", cut))).otherwise(F.col("warnings"))).select(*TRACE)


def trace_steps(traces: DataFrame) -> DataFrame:
    """One row a step, in order."""
    rows = traces.select("projectId", "kind", "stableKey", "file", F.posexplode("steps").alias("step", "s"))
    return rows.select("projectId", "kind", "stableKey", "file", "step", "s.type", "s.label", F.col("s.line").alias("line"), "s.operation")


def filtered_traces(
    traces: DataFrame, *, form: str | None = None, component: str | None = None, event: str | None = None, status: str | None = None, confidence: str | None = None,
    table: str | None = None, operation: str | None = None, search: str | None = None,
) -> DataFrame:
    """Traces by form, component, event (letter case and outer blanks aside), status, confidence, a table or operation they touch, and free text over all of it."""
    same = lambda c, v: F.lower(F.trim(F.coalesce(c, F.lit("")))) == v.strip().lower()
    conditions = [same(F.col(c), v) for c, v in (("formName", form), ("componentName", component), ("eventName", event)) if v]
    conditions += [F.col(c) == v for c, v in (("status", status), ("confidence", confidence)) if v]
    if table:
        conditions.append(F.exists("affectedTables", lambda t: same(t, table)))
    if operation:
        conditions.append(F.exists("affectedFields", lambda f: f["operation"] == operation))
    if search and search.strip():
        conditions.append(F.contains(F.lower(F.to_json(F.struct(*TRACE))), F.lit(search.strip().lower())))
    return traces.where(all_of(conditions)) if conditions else traces


def trace_summary(traces: DataFrame) -> DataFrame:
    """Per project: traces by status, those that read or write a field, distinct tables."""
    touches = lambda what: F.count_if(F.exists("affectedFields", lambda f: f["operation"] == what))
    g = traces.groupBy("projectId").agg(F.count("*").alias("traces"), *[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "partial", "unresolved")], touches("read").alias("readPaths"), touches("write").alias("writePaths"))
    tables = traces.select("projectId", F.explode("affectedTables").alias("t")).groupBy("projectId").agg(F.count_distinct("t").alias("tables"))
    return g.join(tables, "projectId", "left").na.fill(0, ["tables"])
