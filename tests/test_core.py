"""Core operators on small relations, each against values worked out by hand or by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.functions import text as T
from codestrata.operators import build, derive, extract, lists, resolve, risks
from codestrata.operators.merkle import snapshot_diff
from codestrata.sources import archives, sinks
from codestrata.streaming import jobs
from codestrata.streaming.limits import anchored_limit

FILES = "projectId long, id long, filePath string, content string"
SNAP = "projectId long, runNumber int, stableKey string, rowId long, name string, type string, startLine int, endLine int, signature string"


def files(spark, *rows):
    return spark.createDataFrame([(1, i, p, c) for i, (p, c) in enumerate(rows, 1)], FILES)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


# snapshots --------------------------------------------------------------------------------------
def test_diff_added_removed_changed(spark):
    rows = [(1, 1, "a", 1, "a", "f", 1, 2, "f( x )"), (1, 1, "b", 2, "b", "f", 1, 2, None), (1, 1, "c", 3, "c", "f", 1, 2, "c"),
            (1, 3, "a", 4, "a", "f", 1, 2, " f(x)\t"), (1, 3, "b", 5, "b", "f", 1, 3, None), (1, 3, "d", 6, "d", "f", 1, 2, "d")]
    got = {tuple(r) for r in snapshot_diff(spark.createDataFrame(rows, SNAP)).collect()}
    assert got == {(1, 3, "b", "changed"), (1, 3, "c", "removed"), (1, 3, "d", "added")}


def test_diff_last_row_holds_and_nulls(spark):
    rows = [(1, 1, "a", 1, None, None, None, None, None), (1, 2, "a", 9, None, None, None, None, None), (1, 2, "a", 5, "old", "f", 1, 1, "x"), (None, 1, "a", 1, "a", "f", 1, 1, "x"), (1, 2, None, 3, "a", "f", 1, 1, "x"), (1, None, "z", 3, "a", "f", 1, 1, "x")]
    assert snapshot_diff(spark.createDataFrame(rows, SNAP)).collect() == []


def test_diff_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SNAP)
    assert snapshot_diff(empty.withColumn("leaf", F.lit(1)).withColumn("pair", F.lit(2)).withColumn("d1", F.lit(3))).count() == 0


def test_diff_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for p in (1, 2):
        for run in (1, 2, 4):
            for k in range(80):
                if r.random() < 0.8:
                    for _ in range(r.choice([1, 1, 2])):
                        rows.append((p, run, f"k{k}", len(rows), "n", "t", r.randint(1, 2), 9, r.choice(["s", "s ", "t", None])))
    state = {}
    for row in sorted(rows, key=lambda x: x[3]):
        state.setdefault((row[0], row[1]), {})[row[2]] = (*row[4:8], row[8].strip() if row[8] else None)
    want = set()
    for p in (1, 2):
        for base, run in ((1, 2), (2, 4)):
            a, b = state[p, base], state[p, run]
            want |= {(p, run, k, "added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert {tuple(x) for x in snapshot_diff(spark.createDataFrame(rows, SNAP)).collect()} == want


# functions --------------------------------------------------------------------------------------
@pytest.mark.parametrize(("path", "safe"), [("a/b.go", True), ("", False), ("../a", False), ("a/./b", False), ("C:/x", False), ("a\0b", False), (None, False), ("/", False)])
def test_safe_paths(spark, path, safe):
    assert one(spark, P.is_safe_relative(F.col("x")), path) is safe


@pytest.mark.parametrize(("path", "want"), [("a/../b", "b"), ("../a", "../a"), ("a/b/../../c/.", "c"), ("a\\b", "a/b")])
def test_collapsed(spark, path, want):
    assert one(spark, P.collapsed(F.col("x")), path) == want


def test_text_functions(spark):
    assert one(spark, T.normalized_text(F.col("x")), "Field 'A' at  C:\\x\\y 12") == "field <value> at <path> <n>"
    assert one(spark, T.normalized_text(F.col("x")), None) == ""
    i = one(spark, T.field_identity(F.lit("[Dbo].\"Order\""), F.col("x")), "`Id`")
    assert (i["schema"], i["table"], i["field"]) == (None, "order", "id")
    assert T.like_pattern(" 50%_\\ ") == "%50\\%\\_\\\\%"


def test_pages():
    assert lists.page_bounds(9, 500, 0) == (1, 100, 1)
    assert lists.page_bounds(9, 10, 95) == (9, 10, 10)
    assert lists.page_bounds(-1, 0, 3) == (1, 1, 3)
    with pytest.raises(ValueError, match="no condition"):
        lists.all_of([])


# extraction -------------------------------------------------------------------------------------
GO = "package a\nimport \"fmt\"\ntype Store struct {\n}\nfunc (s *Store) Load(id int) error {\n\tif id > 0 {\n\t\treturn nil\n\t}\n\treturn nil\n}\nfunc main() { run() }\nfunc run() {\n\tvar s Store\n\ts.Load(1)\n}\n"
PAS = "unit U;\ninterface\nuses SysUtils, My in 'My.pas';\ntype\n  TForm1 = class(TForm)\n    procedure Click(Sender: TObject);\n  end;\nimplementation\nprocedure TForm1.Click(Sender: TObject);\nbegin\n  Q.FieldByName('NAME').AsString := 'x';\n  Helper(1);\nend;\nprocedure Helper(A: Integer);\nbegin\n  try\n    X;\n  except\n  end;\nend;\nend."
DFM = "object Form1: TForm1\n  OnClick = Click\n  object ds: TDataSource\n    DataSet = cds\n  end\n  object cds: TClientDataSet\n    TableName = 'CUSTOMER'\n  end\n  object e: TDBEdit\n    DataSource = ds\n    DataField = 'NAME'\n  end\n  object g: TDBGrid\n    Columns = <\n      item\n        FieldName = 'A'\n      end\n      item\n        FieldName = 'B'\n      end\n    >\n  end\nend\n"


def test_go_symbols_and_calls(spark):
    f = files(spark, ("m/a.go", GO))
    s = extract.symbols(f)
    assert [(r.name, r.qualifiedName, r.type, r.startLine, r.endLine) for r in s.orderBy("ord").collect()] == [("Store", None, "class", 3, 3), ("Load", "Store.Load", "method", 5, 10), ("main", "main", "function", 11, 11), ("run", "run", "function", 12, 15)]
    e = {(r.fromName, r.toName, r.line) for r in resolve.go_call_edges(extract.call_sites(f), s).collect()}
    assert e == {("run", "Store.Load", 14)}  # calls on the line of a head are not looked at


def test_pascal_forms_and_events(spark):
    f = files(spark, ("Form1.pas", PAS), ("Form1.dfm", DFM))
    s = extract.symbols(f)
    names = {(r.name, r.type) for r in s.where("file = 'Form1.pas'").collect()}
    assert {("U", "class"), ("TForm1", "class"), ("Click", "procedure"), ("Click", "method"), ("Helper", "procedure")} <= names
    h = resolve.event_handlers(extract.form_events(f), s).collect()
    assert [(r.event, r.status, r.method) for r in h] == [("OnClick", "resolved", "TForm1.Click")]
    b = {(r.component, r.dataField, r.dataSet, r.resolvedTable, r.accessHint) for r in resolve.data_bindings(extract.form_objects(f)).collect()}
    assert b == {("e", "NAME", "cds", "CUSTOMER", "read-write"), ("g", "A", None, None, "unresolved"), ("g", "B", None, None, "unresolved")}
    refs = {(r.tableName, r.field, r.access, r.ownerName) for r in resolve.with_owner(extract.field_references(f), s).collect()}
    assert refs == {("delphi", "NAME", "write", "TForm1.Click")}
    found = {(r.title.split()[0], r.line) for r in risks.pascal_risks(f).collect()}
    assert ("Broad", 18) in found and ("Delphi", 11) in found


SQL = "CREATE TABLE IF NOT EXISTS `t` (\n  id INT NOT NULL,\n  price DECIMAL(10, 2) DEFAULT 0.5 COMMENT 'it''s',\n  PRIMARY KEY (id)\n);\nUPDATE t SET price = price + 1;\nINSERT INTO log (a, b) SELECT x.p, x.q FROM src x WHERE x.r = 1;\nWITH c AS (SELECT id FROM t) SELECT id FROM c\n WHERE id > 1;\n"


def test_sql_extraction(spark):
    f = files(spark, ("a.sql", SQL))
    c = [(r.field, r.fieldType, r.nullable, r.primaryKey, r.defaultValue, r.line) for r in extract.table_columns(f).orderBy("line").collect()]
    assert c == [("id", "INT", False, True, None, 1), ("price", "DECIMAL(10, 2)", None, False, "0.5", 2)]
    refs = {(r.tableName, r.field, r.access) for r in extract.field_references(f).collect()}
    assert {("t", "price", "write"), ("t", "price", "read"), ("log", "a", "write"), ("src", "p", "read"), ("src", "r", "read")} <= refs
    assert [r.line for r in resolve.missing_where(extract.sql_statements(f)).collect()] == [6]


def test_embedded_and_edges_of_extraction(spark):
    f = files(spark, ("a.go", 'q := "SELECT a FROM t" + " WHERE b = 1"'), ("b.go", None), ("c.go", ""), ("d.sql", "x" * 200_000))
    s = extract.sql_statements(f).collect()
    assert [(r.line, r.sql) for r in s] == [(1, "SELECT a FROM t WHERE b = 1")]
    assert extract.symbols(files(spark).limit(0)).count() == 0


# risks and lists --------------------------------------------------------------------------------
def test_risk_grouping(spark):
    schema = "id long, projectId long, riskType string, severity string, title string, description string, sourceFile string, lineNumber int, recommendation string"
    rows = [(1, 1, "x", "low", "Found 12", None, "a", 1, None), (2, 1, "x", "high", "found 13", None, "a", 1, None), (3, 1, "x", "low", "Found 9", None, "b", 2, None), (4, 1, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    occ = {r.firstId: (r.occurrenceCount, r.severity) for r in risks.risk_occurrences(df).collect()}
    assert occ == {1: (2, "high"), 3: (1, "low"), 4: (1, None)}
    g = [r for r in risks.risk_groups(df).collect() if r.title]
    assert [(r.occurrenceCount, r.severity, r.affectedFileCount, r.sampleLocations) for r in g] == [(3, "high", 2, "a:1, b:2")]
    assert risks.risk_scores(df).first()["score"] == 26


def test_keyed_diff_last_wins(spark):
    a = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("gone", 1, "z")], "k string, o int, v string")
    b = spark.createDataFrame([("k", 1, "y"), ("new", 1, None)], "k string, o int, v string")
    assert {tuple(r) for r in lists.keyed_diff(a, b, ["k"], ["v"], "o").collect()} == {("gone", "removed"), ("new", "added")}


def test_warning_lists(spark):
    p = spark.createDataFrame([(1, '[{"code":"A","message":"m","filePath":"f"},{"code":"A","message":"m","filePath":null}]'), (2, "nonsense"), (3, None)], "id long, importWarningsJson string")
    got = lists.warning_summary(lists.import_warnings(p)).collect()
    assert [(r.projectId, r.code, r["count"], r.sampleMessages, r.sampleFiles) for r in got] == [(1, "A", 2, "m", "f")]


def edges(spark, *pairs):
    return spark.createDataFrame([(1, a, a, b, b, "calls", n) for n, (a, b) in enumerate(pairs, 1)], "projectId long, fromKey string, fromName string, toKey string, toName string, type string, line int")


# build metadata ---------------------------------------------------------------------------------
def test_build_findings(spark):
    f = files(spark, ("p/App.dpr", "program App;\nuses\n  Forms, Gone in '..\\x\\Gone.pas', Other;\n{$R logo.res}\nbegin end."), ("p/App.dproj", '<Project><PropertyGroup Condition="x"><DCC_UsePackage>rtl;acme</DCC_UsePackage><DCC_UnitSearchPath>C:\\lib</DCC_UnitSearchPath></PropertyGroup></Project>'))
    r = build.build_records(f)
    codes = {(x.code, x.evidence) for x in build.build_findings(r).collect()}
    assert {("DELPHI_EXPLICIT_UNIT_PATH_MISSING", "..\\x\\Gone.pas"), ("DELPHI_UNIT_UNRESOLVED", "Other"), ("DELPHI_RESOURCE_REFERENCE_MISSING", "logo.res"), ("DELPHI_ABSOLUTE_SEARCH_PATH", "C:\\lib"), ("DELPHI_PACKAGE_UNRESOLVED", "acme"), ("DELPHI_COMPILER_VERSION_UNCERTAIN", "")} <= codes
    assert {x.package: x.resolution for x in build.package_resolutions(r).collect()} == {"rtl": "delphi_standard", "acme": "external_unverified"}
    assert build.build_scores(build.build_findings(r)).first()["status"] == "blocked"


# sources, sinks, state --------------------------------------------------------------------------
def test_zip_round_trip(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, data in (("src/a.go", b"package a"), ("x.py", b""), ("../evil.go", b"x"), ("node_modules/b.go", b"x"), ("u.pas", "größe".encode("cp1252")), ("r.txt", b"")):
            z.writestr(name, data)
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    got = {r.path: (r.action, r.content) for r in archives.read_zip(spark, str(tmp_path)).collect()}
    assert got["src/a.go"] == ("keep", "package a") and got["u.pas"] == ("keep", "größe")
    assert got["x.py"][0] == "IMPORT_LANGUAGE_UNSUPPORTED" and got["../evil.go"][0] == "IMPORT_UNSAFE_PATH" and got["node_modules/b.go"][0] == "ignore" and got["r.txt"][0] == "ignore"
    assert got[None][0] == "ZIP_INVALID"


@pytest.mark.parametrize(("text", "encoding"), [("更新稅率設定之後一定要同步更新客戶資料", "big5"), ("Не удалять эту строку, потому что", "windows-1251"), ("plain", "ascii"), ("Größe", "utf-8")])
def test_decode(text, encoding):
    assert archives.decode(text.encode(encoding))[0] == text


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "projectId long, v string")
    sinks.replace_partitions(df, str(tmp_path / "t"), "projectId")
    sinks.replace_partitions(spark.createDataFrame([(2, "c")], "projectId long, v string"), str(tmp_path / "t"), "projectId")
    assert {(r.projectId, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "c")}
    up = sinks.upserted(df.withColumn("n", F.lit(1)), spark.createDataFrame([(2, "z", 1)], "projectId long, v string, n int"), ["projectId"], "n")
    assert {(r.projectId, r.v) for r in up.collect()} == {(1, "a"), (2, "z")}
    assert one(spark, sinks.truncated_utf8(F.col("x"), 10, "…"), "größe größe") == "größe…"
    a, b = (sinks.report_archive({"b.md": "x", "a.md": "y"}) for _ in range(2))
    assert a == b
    with pytest.raises(ValueError, match="exceeds"):
        sinks.report_archive({"a": "x" * 100}, most=10)


def test_anchored_limit_against_fold(spark):
    r = random.Random(2)
    rows = [(i, r.choice("ab"), r.randint(0, 400)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, s int").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {x.id: x.allowed for x in anchored_limit(df, ["k"], "ts", "id", 3, 60).collect()}
    want, state = {}, {}
    for i, k, s in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        start, n = state.get(k, (None, 0))
        if start is None or s >= start + 60:
            start, n = s, 0
        state[k] = (start, n + 1)
        want[i] = n + 1 <= 3
    assert got == want


def test_jobs(spark):
    schema = "id long, status string, attemptCount int, maxAttempts int, leaseUntil timestamp, startedAt timestamp, createdAt timestamp"
    t = lambda s: F.lit(s).cast("timestamp")
    rows = spark.createDataFrame([(1, "running", 1, 3), (2, "queued", 0, 3), (3, "running", 3, 3), (4, "done", 0, 3)], "id long, status string, attemptCount int, maxAttempts int")
    df = rows.withColumn("leaseUntil", F.when(F.col("id") != 2, t("2024-01-01 00:00:00"))).withColumn("startedAt", t("2024-01-01 00:00:00")).withColumn("createdAt", t("2023-12-31 00:00:00"))
    assert schema and jobs.next_claim(df, t("2024-01-01 00:00:10")).first()["id"] == 1
    assert {r.id: r.status for r in jobs.recovered(df, t("2024-01-01 00:00:10")).collect()} == {1: "queued", 2: "queued", 3: "failed", 4: "done"}
    changes = spark.createDataFrame([("draft", "importing"), ("draft", "completed"), ("failed", "failed")], "before string, after string")
    assert [(r.before, r.after) for r in jobs.invalid_transitions(changes).collect()] == [("draft", "completed")]
    assert one(spark, jobs.retry_delay(F.col("x")), 20, "int") == 30_000


# derived ----------------------------------------------------------------------------------------
def test_warnings_rules_confidence(spark):
    f = files(spark, ("U.pas", "unit U;\nbegin\n Q.SQL.Add('SELECT a ' + B);\nend."), ("a.inc", "x"), ("a.xyz", "x"), ("b.go", None), ("m.dproj", "<a/>"))
    got = {(r.file, r.code) for r in derive.file_warnings(f).collect()}
    assert ("U.pas", "SQL_DYNAMIC_STRING") in got and ("U.pas", "DELPHI_UNIT_NOT_FOUND") not in got
    assert {("a.inc", "DELPHI_UNIT_NOT_FOUND"), ("a.inc", "DELPHI_LIMITED_ANALYSIS"), ("a.xyz", "LANGUAGE_UNSUPPORTED"), ("m.dproj", "IMPORT_BUILD_METADATA")} <= got
    refs = spark.createDataFrame([(1, "T", "a_b_c", "write", "x", 1), (1, "dbo.T", "A_B_C", "write", "y", 2), (1, "T", "d", "write", "z", 1)], "projectId long, tableName string, field string, access string, file string, line int")
    found = spark.createDataFrame([(1, "a/b.go", 3, "Date literal")] * 2, "projectId long, file string, line int, title string")
    r = {(x.ruleType, x.name): x.occurrences for x in derive.rules(refs, found, found.limit(0)).collect()}
    assert r == {("validation", "validate_t_a_b__single_owner"): 2, ("magic_value", "externalize_a_b_go_date_literal"): 2}
    none = spark.createDataFrame([], "projectId long, status string, confidence string, accessHint string, title string, code string")
    c = derive.confidence(f, derive.file_warnings(f), none, none, none, none).first()
    assert 0 <= c["score"] <= 100 and c["level"] in ("low", "medium", "high")


# views ------------------------------------------------------------------------------------------
def test_views(spark):
    from codestrata.operators import views

    s = spark.createDataFrame([(1, 1, "a", 1, "x", "f"), (1, 2, "a", 2, "y", "f"), (1, 2, "a", 3, "z", "f"), (1, 2, "b", 4, "w", "g"), (2, 5, "q", 9, None, None)], "projectId long, runNumber int, stableKey string, rowId long, name string, type string")
    assert {(r.projectId, r.stableKey, r.name) for r in views.latest_symbols(s).collect()} == {(1, "a", "z"), (1, "b", "w"), (2, "q", None)}
    assert {(r.runNumber, r.type, r.symbols, r.delta) for r in views.run_metric_deltas(s).collect()} == {(2, "f", 1, 0), (2, "g", 1, 1)}
    refs = spark.createDataFrame([(1, "t", "A", "r.sql", 9)], "projectId long, tableName string, field string, file string, line int")
    cols = spark.createDataFrame([(1, "dbo.T", "a", "d.sql", 1, "INT"), (1, "T", "a", "e.sql", 1, "BIGINT")], "projectId long, tableName string, field string, file string, line int, fieldType string")
    assert [(r.fieldKey, r.tableName, r.field, r.fieldType) for r in views.field_dimension(refs, cols).collect()] == [("a", "dbo.T", "a", "BIGINT")]
    e = edges(spark, ("k1", "k2")).unionByName(spark.createDataFrame([(1, "k1", "k1", None, "SysUtils", "references", 1)], "projectId long, fromKey string, fromName string, toKey string, toName string, type string, line int")).withColumn("file", F.lit("f"))
    sym = spark.createDataFrame([(1, "k1", "A", None, "method")], "projectId long, stableKey string, name string, qualifiedName string, type string")
    assert [(r.sourceName, r.targetName, r.targetKind) for r in views.dependency_list(e, sym).collect()] == [("A", "k2", "internal")]
    points = spark.createDataFrame([(1, "f", 0, "other"), (1, "f", 1, "Main"), (2, "g", 0, "x"), (2, "g", 1, "y")], "projectId long, file string, ord int, name string")
    assert {(r.projectId, r.name) for r in views.entry_points(points, 1).collect()} == {(1, "Main"), (2, "x")}


def test_streaming_limit(spark, tmp_path):
    import json

    from codestrata.streaming.limits import streaming_limit

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"key": "a", "ms": m}) for m in (0, 10, 20, 30, 70000)))
    stream = spark.readStream.schema("key string, ms long").json(str(tmp_path))
    q = streaming_limit(stream, 2, 60).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("limited").collect())
    assert got == [("a", 0, True), ("a", 10, True), ("a", 20, False), ("a", 30, False), ("a", 70000, True)]
