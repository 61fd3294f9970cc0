"""Edges, handlers, traces, impact, history: planted cases, and plain re-implementations to compare with."""


import json
import random

import pytest

from codestrata.operators import build, extract, graph, history, lists, resolve, traces, views
from codestrata.operators.analysis import Analysis
from codestrata.session import checkpointed

FILES = "projectId long, id long, filePath string, content string"


def files(spark, *rows, project=1):
    return spark.createDataFrame([(project, i, p, c) for i, (p, c) in enumerate(rows, 1)], FILES)


UNIT = """unit MainForm;
interface
type
  TMainForm = class(TForm)
    procedure SaveClick(Sender: TObject);
  end;
implementation
procedure TMainForm.SaveClick(Sender: TObject);
begin
  StoreAll(1);
  Q.SQL.Text := 'UPDATE stock SET qty = qty + 1';
end;
procedure StoreAll(n: Integer);
begin
  Q.SQL.Text := 'SELECT name FROM customer WHERE id = 1';
end;
end.
"""
FORM = """object MainForm: TMainForm
  object btnSave: TButton
    OnClick = SaveClick
  end
  object btnLost: TButton
    OnClick = LostClick
  end
  object src: TDataSource
    DataSet = qry
  end
  object qry: TQuery
    TableName = 'customer'
  end
  object ed: TDBEdit
    DataSource = src
    DataField = 'name'
  end
end
"""
SQL = "CREATE PROCEDURE fill_stock\nSELECT 1;\n\nEXEC fill_stock 1;\nexec unknown_one;\n"


@pytest.fixture(scope="module")
def analysis(spark):
    return Analysis(files(spark, ("src\\MainForm.pas", UNIT), ("src/MainForm.dfm", FORM), ("db/a.sql", SQL), ("a.GO", "package a\nfunc Run() {\n\tstep()\n}\nfunc step() {\n}\n"), ("x.pas", None)))


def test_one_pass_gives_the_same_rows(spark, analysis):
    direct = {
        "symbols": extract.symbols, "calls": extract.call_sites, "execs": extract.exec_sites, "imports": extract.imports, "statements": extract.sql_statements, "references": extract.field_references,
        "columns": extract.table_columns, "objects": extract.form_objects, "events": extract.form_events, "forms": extract.form_states, "records": build.build_records,
    }
    more = analysis.files.unionByName(files(spark, ("t.sql", "CREATE TABLE t (a INT DEFAULT 'ü\"x', b DECIMAL(1, 2) NOT NULL COMMENT 'é');"), ("p.dpr", "program p;\nuses a in 'b.pas';\nbegin end."), ("UP.GO", "package a\nimport \"fmt\"\nfunc f() {}\n")))
    one = Analysis(more)
    for name, make in direct.items():
        a, b = one.extracted(name), make(more)
        assert a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name


def test_edges_of_all_kinds(analysis):
    got = {(r.fromName, r.toName, r.type) for r in analysis.edges.collect()}
    assert {("TMainForm.SaveClick", "StoreAll", "calls"), ("Run", "step", "calls"), ("MainForm.btnSave.OnClick", "SaveClick", "references"), ("MainForm.btnLost.OnClick", "LostClick", "references")} <= got
    execs = {(r.line, r.callee) for r in extract.exec_sites(analysis.files).collect()}
    assert execs == {(4, "fill_stock"), (5, "unknown_one")}


def test_stored_edges_resolve_unique_names(analysis):
    got = {r.fromName: (r.targetKind, r.targetExternalName) for r in resolve.stored_edges(analysis.edges, analysis.symbols).where("type = 'references'").collect()}
    assert got["MainForm.btnLost.OnClick"] == ("unresolved", "LostClick")
    calls = {r.targetKind for r in resolve.stored_edges(analysis.edges, analysis.symbols).where("type = 'calls'").collect()}
    assert calls == {"internal"}


def test_handlers_and_warnings(analysis):
    got = {r.component: (r.status, r.method) for r in analysis.handlers.collect()}
    assert got == {"btnSave": ("resolved", "TMainForm.SaveClick"), "btnLost": ("unresolved", None)}
    codes = {r.code for r in analysis.warnings.collect()}
    assert {"DELPHI_EVENT_HANDLER_UNRESOLVED", "HEURISTIC_ANALYSIS"} <= codes


def handler_cases(spark, *methods):
    events = spark.createDataFrame([(1, 9, "a/F.dfm", 3, "F", "TF", "b", "TButton", "OnClick", "Go")], extract.FORM_EVENT)
    rows = [(1, 1, file, n, name, full, "method", 5, 9, None, None, f"{file}::{full}::5") for n, (file, name, full) in enumerate(methods)]
    return resolve.event_handlers(events, spark.createDataFrame(rows, extract.SYMBOL)).first()


def test_handlers_step_by_step(spark):
    r = handler_cases(spark, ("x.pas", "Go", "TF.Go"), ("F.pas", "Go", "TOther.Go"))
    assert (r.status, r.methodFile) == ("resolved", "x.pas") and "outside" in r.warning
    assert handler_cases(spark, ("x.pas", "Go", "TX.Go"), ("b/F.pas", "Go", "TY.Go")).methodFile == "b/F.pas"
    assert handler_cases(spark, ("x.pas", "Go", "TX.Go")).status == "resolved"
    r = handler_cases(spark, ("x.pas", "Go", "TX.Go"), ("y.pas", "Go", "TY.Go"))
    assert (r.status, r.method) == ("ambiguous", None) and "2" in r.warning
    r = handler_cases(spark, ("x.pas", "Go", "TF.Go"), ("F.pas", "Go", "TF.Go"))
    assert r.methodFile == "F.pas"
    assert handler_cases(spark, ("x.pas", "Went", "TX.Went")).status == "unresolved"


def test_a_shared_handler_name_is_no_pairing(spark):
    n = 300
    events = spark.createDataFrame([(1, i, f"f{i}.dfm", 3, f"F{i}", f"TF{i}", "b", "TButton", "OnCreate", "FormCreate") for i in range(n)], extract.FORM_EVENT)
    methods = spark.createDataFrame([(1, i, f"f{i}.pas", 0, "FormCreate", f"TF{i}.FormCreate", "method", 5, 9, None, None, f"k{i}") for i in range(n)], extract.SYMBOL)
    got = resolve.event_handlers(events, methods)
    assert {(r.formName, r.methodKey) for r in got.collect()} == {(f"F{i}", f"k{i}") for i in range(n)}


# traces -----------------------------------------------------------------------------------------
def test_traces(analysis):
    got = {r.stableKey: r for r in analysis.traces.collect()}
    save = got["MainForm:btnSave:OnClick:SaveClick"]
    steps = [(s.type, s.label) for s in save.steps]
    assert steps[:3] == [("ui_component", "TButton.btnSave"), ("event", "OnClick"), ("handler", "TMainForm.SaveClick")]
    assert [x for x in steps if x[0] in ("sql", "call")] == [("sql", "UPDATE stock"), ("call", "StoreAll"), ("sql", "SELECT customer")]
    assert save.status == "complete" and save.affectedTables == ["customer", "stock"]
    assert {(f.table, f.field, f.operation) for f in save.affectedFields} >= {("stock", "qty", "write"), ("customer", "name", "read")}
    assert got["MainForm:btnLost:OnClick:LostClick"].status == "unresolved"
    edit = got["MainForm:ed:binding:name:qry"]
    assert (edit.status, edit.affectedTables) == ("complete", ["customer"])
    assert {r.projectId: (r.traces, r.complete, r.unresolved, r.tables) for r in traces.trace_summary(analysis.traces).collect()} == {1: (3, 2, 1, 2)}
    names = lambda df: {r.componentName for r in df.collect()}
    t = analysis.traces
    assert names(traces.filtered_traces(t, form=" mainform ", event="onclick")) == {"btnSave", "btnLost"}
    assert names(traces.filtered_traces(t, table="STOCK")) == {"btnSave"} and names(traces.filtered_traces(t, operation="write")) == {"btnSave"}
    assert names(traces.filtered_traces(t, search="tdbedit")) == {"ed"} and names(traces.filtered_traces(t, status="unresolved", confidence="low")) == {"btnLost"}


def world(spark, calls, statements=()):
    keys = sorted({k for c in calls for k in c} | {k for k, _, _ in statements})
    symbols = spark.createDataFrame([(1, k, k, None, "u.pas", 1) for k in keys], "projectId long, stableKey string, name string, qualifiedName string, file string, startLine int")
    edges = spark.createDataFrame([(1, "u.pas", n, a, a, b, b, "calls") for n, (a, b) in enumerate(calls, 1)] or [(1, "u", 0, "", "", None, "", "references")], "projectId long, file string, line int, fromKey string, fromName string, toKey string, toName string, type string")
    evidence = spark.createDataFrame([(1, "u.pas", n, k, op, t, "read" if op == "select" else "write", f"s{n}") for n, (k, op, t) in enumerate(statements, 1)] or [(1, "u", 0, None, "", "", "", "")], "projectId long, file string, line int, ownerKey string, operation string, tables string, access string, stableKey string")
    handlers = spark.createDataFrame([(1, "F.dfm", 3, "F", "b", "TB", "OnClick", keys[0], "resolved", keys[0], "u.pas", keys[0], None)], "projectId long, file string, line int, formName string, component string, componentClass string, event string, handler string, status string, method string, methodFile string, methodKey string, warning string")
    bindings = spark.createDataFrame([], "projectId long, file string, line int, formName string, component string, componentClass string, dataSource string, dataSet string, resolvedTable string, dataField string, accessHint string, confidence string")
    return handlers, bindings, edges, evidence, symbols


def plain_walk(calls, statements, root):
    """The walk by recursion over whole lists, to compare with."""
    out, done, path, full = [], set(), [], []

    def push(kind, label):
        used = 3 + len(out)
        if full or used >= 200 or kind != "warning" and used == 199:
            if not full:
                full.append(1)
                out.append(("warning", traces.STEP_LIMIT))
            return False
        out.append((kind, label))
        return True

    def visit(k, depth):
        if k in done:
            return
        if depth > 8:
            push("warning", traces.DEPTH_LIMIT)
            return
        done.add(k)
        path.append(k)
        for o, op, t in statements:
            if o == k:
                if not push("sql", f"{op.upper()} {t}"):
                    break
                push("table", t)
        for a, b in calls:
            if a == k:
                if not push("call", b):
                    break
                if b in path:
                    push("warning", "FLOW_TRACE_CALL_CYCLE: " + " -> ".join([*path[path.index(b) :], b]))
                else:
                    visit(b, depth + 1)
        path.pop()

    visit(root, 0)
    return out[:197]


@pytest.mark.parametrize("seed", range(2))
def test_walks_against_plain_recursion(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(r.choice([4, 12, 40]))]
    calls = [(r.choice(nodes), r.choice(nodes)) for _ in range(r.choice([8, 60, 260]))]
    calls = [(nodes[0], nodes[1]), *[(a, b) for a, b in calls if a != b]]
    statements = [(r.choice(nodes), r.choice(["select", "update"]), f"t{i}") for i in range(15)]
    h, b, e, ev, s = world(spark, calls, statements)
    got = traces.flow_traces(h, b, e, ev, s).first()
    assert [(x.type, x.label) for x in got.steps][3:] == plain_walk(calls, statements, nodes[0])


def test_depth_chain_and_limit(spark):
    chain = [(f"k{i:02}", f"k{i + 1:02}") for i in range(12)]
    t = traces.flow_traces(*world(spark, chain)).first()
    assert t.status == "partial" and [s.label for s in t.steps][-1] == traces.DEPTH_LIMIT and sum(s.type == "call" for s in t.steps) == 9
    wide = [("a", f"b{i:03}") for i in range(400)]
    t = traces.flow_traces(*world(spark, wide)).first()
    assert len(t.steps) == 200 and t.steps[-1].label == traces.STEP_LIMIT and t.truncated and t.status == "partial"


def test_traces_are_capped_by_project(spark, monkeypatch):
    monkeypatch.setattr(traces, "MAX_TRACES", 3)
    h, b, e, ev, s = world(spark, [("a", "b")])
    many = h.select("projectId", "file", "line", "formName", "component", "componentClass", "event", "handler", "status", "method", "methodFile", "methodKey", "warning").crossJoin(spark.range(5).withColumnRenamed("id", "n")).selectExpr("projectId", "file", "line", "formName", "concat(component, n) component", "componentClass", "event", "handler", "status", "method", "methodFile", "methodKey", "warning")
    got = traces.flow_traces(many, b, e, ev, s).orderBy("componentName").collect()
    assert [r.componentName for r in got] == ["b0", "b1", "b2"] and [r.status for r in got] == ["complete", "complete", "partial"]
    assert got[-1].warnings == ["FLOW_TRACE_LIMIT_REACHED: persisted 3 of 5 candidate traces."] and got[-1].confidence == "medium"


# impact -----------------------------------------------------------------------------------------
def impact(spark):
    s = spark.createDataFrame([(1, "a", "A", "U.A", "method", "u.pas", 1, 5), (1, "b", "B", None, "function", "v.pas", 1, 5), (1, "c", "C", None, "function", "w.pas", 1, 5), (1, "d", "D", None, "function", "u.pas", 8, 9)], "projectId long, stableKey string, name string, qualifiedName string, type string, file string, startLine int, endLine int")
    e = spark.createDataFrame([(1, "a", "U.A", "b", "B", "calls", 1), (1, "b", "B", "c", "C", "calls", 2), (1, "c", "C", None, "ext", "references", 3)], "projectId long, fromKey string, fromName string, toKey string, toName string, type string, line int")
    f = spark.createDataFrame([(1, "u.pas"), (1, "v.pas"), (1, "w.pas"), (2, "u.pas")], "projectId long, filePath string")
    refs = spark.createDataFrame([(1, "a", "sales.Orders", "Total"), (1, "b", "hr.Orders", "Total"), (1, "b", "Other", "x")], "projectId long, ownerKey string, tableName string, field string")
    rk = spark.createDataFrame([(1, "u.pas", 3, "Bad"), (1, "U.PAS", None, "Worse"), (1, "z.pas", 1, "Far")], "projectId long, sourceFile string, lineNumber int, title string")
    rl = spark.createDataFrame([(1, "keep_total", "about Orders.Total", None, "u.pas", 3), (1, "no_line", None, "cond", "v.pas", None), (1, "off", None, None, "u.pas", 99)], "projectId long, name string, description string, condition string, file string, line int")
    return graph.Impact(s, f, e, refs, rk, rl)


CASES = {
    ("u.a", "auto"): ("symbol", {("symbol", "U.A"), ("symbol", "B"), ("file", "u.pas"), ("file", "v.pas"), ("table", "sales.Orders"), ("field", "sales.Orders.Total"), ("rule", "keep_total"), ("rule", "off"), ("risk", "Bad"), ("risk", "Worse")}, ["U.A -> B", "U.A -> sales.Orders.Total"]),
    ("u.pas", "auto"): ("file", {("file", "u.pas"), ("file", "v.pas"), ("symbol", "U.A"), ("symbol", "D"), ("symbol", "B"), ("rule", "keep_total"), ("rule", "off"), ("risk", "Bad"), ("risk", "Worse")}, ["U.A -> B", "u.pas -> Bad", "u.pas -> Worse", "u.pas -> keep_total", "u.pas -> off"]),
    ("orders.total", "auto"): ("sql_field", {("table", "sales.Orders"), ("table", "hr.Orders"), ("field", "sales.Orders.Total"), ("field", "hr.Orders.Total"), ("symbol", "U.A"), ("symbol", "B"), ("file", "u.pas"), ("file", "v.pas"), ("rule", "keep_total")}, ["B -> hr.Orders.Total", "U.A -> sales.Orders.Total"]),
    ("hr.orders.total", "auto"): ("sql_field", {("table", "hr.Orders"), ("field", "hr.Orders.Total"), ("symbol", "B"), ("file", "v.pas"), ("rule", "keep_total")}, ["B -> hr.Orders.Total"]),
    ("orders", "sql_table"): ("sql_table", {("table", "sales.Orders"), ("table", "hr.Orders"), ("field", "sales.Orders.Total"), ("field", "hr.Orders.Total"), ("symbol", "U.A"), ("symbol", "B"), ("file", "u.pas"), ("file", "v.pas"), ("rule", "keep_total")}, ["B -> hr.Orders.Total", "U.A -> sales.Orders.Total"]),
    ("bad", "auto"): ("risk", {("risk", "Bad"), ("file", "u.pas"), ("symbol", "U.A")}, []),
    ("keep_total", "auto"): ("rule", {("rule", "keep_total"), ("file", "u.pas"), ("symbol", "U.A"), ("risk", "Bad"), ("risk", "Worse")}, ["U.A -> B"]),
    ("off", "rule"): ("rule", {("rule", "off"), ("file", "u.pas"), ("symbol", "U.A"), ("symbol", "D"), ("risk", "Bad"), ("risk", "Worse")}, ["U.A -> B"]),
}


@pytest.mark.parametrize("case", CASES)
def test_impact(spark, case):
    kind, items, chains = CASES[case]
    rows = impact(spark).rows(*case).collect()
    assert {r.targetType for r in rows} == {kind} and {r.projectId for r in rows} <= {1, 2}
    mine = [r for r in rows if r.projectId == 1]
    assert {(r.kind, r.item) for r in mine if r.kind != "chain"} == items
    assert sorted(r.item for r in mine if r.kind == "chain") == sorted(chains)


def test_impact_result_and_unknown_target(spark):
    r = impact(spark).results("u.a").collect()
    assert [(x.projectId, x.affectedCount, x.confidence) for x in r] == [(1, 10, 1)] and "affects 10 scoped items" in r[0].summary
    assert impact(spark).rows("nothing like it").count() == 0 and impact(spark).results("u.a", "risk").count() == 0


# history ----------------------------------------------------------------------------------------
def test_sections_between_two_imports(spark):
    base = Analysis(files(spark, ("src/MainForm.pas", UNIT), ("src/MainForm.dfm", FORM), ("old.sql", "SELECT a FROM gone WHERE b = 1;")))
    compare = Analysis(files(spark, ("SRC/MainForm.pas", UNIT.replace("UPDATE stock", "UPDATE depot")), ("src/MainForm.dfm", FORM.replace("LostClick", "FoundClick"))))
    before = checkpointed(base.sections())
    diff = checkpointed(history.diff_sections(before, compare.sections()))
    got = {(r.section, r.change) for r in diff.collect()}
    assert {("files", "changed"), ("files", "removed"), ("symbols", "added"), ("symbols", "removed"), ("fields", "added"), ("fields", "removed"), ("risks", "changed"), ("delphiEvents", "changed"), ("flowTraces", "added")} <= got
    assert not {("symbols", "changed"), ("dependencies", "changed")} & got
    doc = history.diff_document(diff, history.metric_deltas(base.metrics, compare.metrics)).first()
    assert doc.metricsDelta.fileCount == -1 and doc.buckets["files.removed"].total == 1 and not doc.truncated
    assert json.loads(doc.buckets["files.removed"]["items"][0])["path"] == "old.sql"
    assert set(json.loads(doc.buckets["delphiEvents.resolutionChanged"]["items"][0])) == {"key", "before", "after"}
    same = history.diff_sections(before, before)
    assert same.count() == 0


def test_buckets_are_cut_and_counted(spark):
    rows = [(1, "risks", f"k{i:03}", "added", None, f"v{i}") for i in range(30)] + [(1, "risks", "x", "changed", "a", "b"), (2, "files", "y", "removed", "a", None)]
    b = history.buckets(spark.createDataFrame(rows, "projectId long, section string, key string, change string, before string, after string"), limit=10)
    got = {(r.projectId, r.section, r.bucket): (r.total, r.displayed, r.truncated, r["items"][0]) for r in b.collect()}
    assert got == {(1, "risks", "introduced"): (30, 10, True, "v0"), (1, "risks", "changed"): (1, 1, False, '{"key":"x","before":"a","after":"b"}'), (2, "files", "removed"): (1, 1, False, "a")}


def test_last_of_repeated_keys_holds(spark):
    s = "projectId long, section string, key string, item string, place string"
    a = spark.createDataFrame([(1, "files", "k", "1", "1"), (1, "files", "k", "2", "2"), (None, "files", "", None, None)], s)
    b = spark.createDataFrame([(1, "files", "k", "2", "1")], s)
    assert history.diff_sections(a, b).where("projectId = 1").count() == 0


def test_snapshots_as_json(spark, monkeypatch):
    a = Analysis(files(spark, ("src/MainForm.pas", UNIT), ("src/MainForm.dfm", FORM)))
    sections = checkpointed(a.sections())
    text = checkpointed(history.snapshot_json(sections, a.metrics))
    loaded = json.loads(text.first()["snapshotJson"])
    assert loaded["schemaVersion"] == 1 and loaded["metrics"]["fileCount"] == 2 and len(loaded["files"]) == 2
    again = history.parsed_snapshots(text.unionByName(spark.createDataFrame([(2, None, None), (3, "{", None), (4, '{"schemaVersion":7}', None), (5, '{"schemaVersion":1,"files":[{},{}]}', None)], "projectId long, snapshotJson string, error string")))
    got = {r.projectId: r for r in again.collect()}
    assert [got[p].warning for p in (1, 2, 3, 4, 5)] == [None, "SNAPSHOT_MISSING", "SNAPSHOT_INVALID", "UNSUPPORTED_SNAPSHOT_VERSION", None]
    assert got[1].metrics.symbolCount == len(loaded["symbols"]) and got[5].metrics.fileCount == 2 and got[5].symbols == "[]" and got[4].files is None and got[5].projectContext == "unknown"
    assert history.parsed_snapshots(text, strict=True).count() == 1
    monkeypatch.setattr(history, "MAX_SNAPSHOT", 100)
    r = history.snapshot_json(sections, a.metrics).first()
    assert r.snapshotJson is None and r.error == "SNAPSHOT_TOO_LARGE"


def test_runs_and_baselines(spark):
    runs = spark.createDataFrame([(1, 1, 1, "completed", 1), (2, 1, 2, "failed", None), (3, 1, 3, "partial", 1), (4, 2, 1, "completed", None), (5, 3, 1, "completed", 9)], "id long, projectId long, runNumber int, status string, snapshotSchemaVersion int")
    assert [(r.baseId, r.compareId) for r in history.comparable_runs(runs, lists.USABLE).collect()] == [(1, 3)]
    none = spark.createDataFrame([(1, 1), (2, 4)], "projectId long, runId long")
    changes = spark.createDataFrame([(1, 2), (1, 3), (2, None), (3, 1)], "projectId long, runId long")
    b = history.set_baseline(none, changes, runs, lists.USABLE)
    assert {(r.projectId, r.runId) for r in b.collect()} == {(1, 3)}
    assert {r.id for r in history.with_baseline(runs, b).where("isBaseline").collect()} == {3}
    assert {r.id for r in history.legacy_candidates(runs, lists.USABLE).collect()} == {4}


# risks and rules --------------------------------------------------------------------------------
def test_risks_have_all_columns_once(analysis):
    rows = analysis.risks.collect()
    assert rows and all(r.title and r.severity and r.category and r.description and r.recommendation for r in rows)
    assert ("Write statement without WHERE clause", "critical", 11) in {(r.title, r.severity, r.line) for r in rows}
    assert len({(r.category, r.title, r.description, r.file, r.line) for r in rows}) == len(rows)


def test_shown_rules(spark):
    r = spark.createDataFrame([(1, "validation", "validate_a_b_c_single_owner", "d", "c", 2, "u.pas", 1), (1, "magic_value", "externalize_u", "d", "c", 1, "u.pas", 2), (1, "magic_value", "externalize_v", "d", None, 1, "v.pas", None), (1, "other", "some_name", None, "cond", 1, None, None)], "projectId long, ruleType string, name string, description string, condition string, occurrences long, file string, line int")
    got = {x.name: (x.title, x.description) for x in views.shown_rules(r).collect()}
    assert got["validate_a_b_c_single_owner"] == ("a_b.* 欄位有多處寫入來源", views.OWNER_DESCRIPTION) and got["some_name"] == ("some name", "cond")
    g = {x.title: (x.occurrenceCount, x.affectedFileCount, x.sampleLocations) for x in views.rule_groups(r).collect()}
    assert g["商業常數應抽離管理"] == (2, 2, "u.pas:2, v.pas:")
    assert views.rule_groups(r, rule_type="other").count() == 1 and views.rule_groups(r, search="SOME  NAME").count() == 1 and views.rule_groups(r, file="V.PAS").count() == 1


def test_metrics_and_status(analysis):
    m = analysis.metrics.first()
    assert (m.fileCount, m.analyzedFileCount, m.skippedFileCount) == (5, 4, 1) and m.symbolCount == analysis.symbols.count() and m.riskCount == analysis.risks.count()
    assert analysis.status.first()["status"] == "partial"


def test_empty_input(spark):
    a = Analysis(spark.createDataFrame([], FILES))
    for df in (a.symbols, a.edges, a.risks, a.rules, a.warnings, a.traces, a.metrics, a.status):
        assert df.count() == 0
    assert history.diff_sections(a.sections(), a.sections()).count() == 0
