"""Lists, jobs, imports and reports: defined results for odd inputs, and plain counts to compare with."""

import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from codestrata.operators import build, history, lists, pages, reports
from codestrata.operators.analysis import Analysis
from codestrata.session import checkpointed
from codestrata.sources import archives
from codestrata.streaming import jobs

PROJECTS = "id long, userId long, status string, name string"


@pytest.fixture(scope="module")
def projects(spark):
    return spark.createDataFrame([(1, 5, "ready", "a"), (2, 5, "draft", None), (3, 6, "importing", "c"), (4, None, "draft", "d")], PROJECTS)


# lists ------------------------------------------------------------------------------------------
def test_scope_is_owned_and_one_project(spark, projects):
    rows = spark.createDataFrame([(p, f"x{p}") for p in (1, 1, 2, 3, 9, None)], "projectId long, name string")
    count = lambda **k: pages.scoped(rows, projects, pages.Request(**k)).count()
    assert count() == 4 and count(user=5) == 3 and count(user=5, project=1) == 2 and count(user=6, project=1) == 0 and count(project=9) == 0
    with pytest.raises(ValueError):
        pages.Request(search="x" * 201)


@pytest.mark.parametrize(("page", "size", "wanted"), [(1, 10, (1, 10, 5)), (9, 10, (5, 10, 5)), (-3, 0, (1, 1, 45)), (2, 1000, (1, 100, 1))])
def test_pages_are_clamped(spark, page, size, wanted):
    df = spark.range(45).withColumnRenamed("id", "n")
    r = pages.Request(page=page, size=size)
    i = pages.page_info(df, r).first()
    assert (i.page, i.pageSize, i.pageCount) == wanted and i.total == 45
    rows = [x.n for x in pages.paged(df, [F.col("n")], r).collect()]
    assert rows == list(range(45))[(wanted[0] - 1) * wanted[1] : wanted[0] * wanted[1]]
    assert tuple(pages.page_info(df.limit(0), r).first())[0::3] == (0, 1)


def test_symbol_page_of_a_search(spark, projects):
    s = spark.createDataFrame([(1, f"k{i}", f"LoadUser{i}" if i % 2 else f"Other{i}", None, "procedure" if i < 60 else "class", "u.pas", i) for i in range(60)] + [(1, "n", None, None, None, None, None)], "projectId long, stableKey string, name string, qualifiedName string, type string, file string, startLine int")
    r = pages.Request(project=1, search=" loaduser ", page=2, size=20)
    found = pages.symbol_list(s, projects, r, "procedure")
    assert found.count() == 30 and pages.paged(found, pages.ORDERS["symbols"](), r).count() == 10


def test_field_and_dependency_lists(spark, projects):
    fields = spark.createDataFrame([(1, "dbo.Orders", "Total", "INT"), (1, "Orders", "Gone%", None)], "projectId long, tableName string, field string, fieldType string")
    refs = spark.createDataFrame([(1, "u.pas", 1, "orders", "total", "read", "TF.Go", "k", "SELECT Total"), (1, "u.pas", 2, "[Orders]", "TOTAL", "write", None, None, None), (1, "v.pas", 3, None, None, "read", None, "k9", "x")], "projectId long, file string, line int, tableName string, field string, access string, ownerName string, ownerKey string, context string")
    got = {r.field: (r.readCount, r.writeCount, r.referenceCount) for r in pages.field_list(fields, refs, projects, pages.Request()).collect()}
    assert got == {"Total": (1, 1, 2), "Gone%": (0, 0, 0)}
    assert [r.field for r in pages.field_list(fields, refs, projects, pages.Request(search="%")).collect()] == ["Gone%"]
    deps = pages.field_dependency_list(refs, projects, pages.Request())
    assert {(r.tableName, r.symbolName) for r in deps.collect()} == {("orders", "TF.Go"), ("[Orders]", "unknown"), ("unknown", "symbol:k9")}
    assert pages.field_dependency_list(refs, projects, pages.Request(search="select"), operation="read").count() == 1
    stored = spark.createDataFrame([(1, "f", 1, "calls", "a", "A", "b", None, "internal"), (1, "f", 2, "references", "a", None, None, "SysUtils", "external"), (1, "f", 3, "references", "a", "A", None, "sysutils", "external"), (1, "f", 4, "calls", "a", "A", None, "Lost", "unresolved")], "projectId long, file string, line int, type string, fromKey string, fromName string, targetKey string, targetExternalName string, targetKind string")
    symbols = spark.createDataFrame([(1, "b", "B", "U.B")], "projectId long, stableKey string, name string, qualifiedName string")
    names = lambda **k: sorted(r.targetName for r in pages.dependency_list(stored, symbols, projects, pages.Request(), **k).collect())
    assert names() == ["Lost", "U.B", "sysutils"] and names(hide_standard=False) == ["Lost", "SysUtils", "U.B", "sysutils"] and names(target="unresolved") == ["Lost"] and names(kind="references") == ["sysutils"]
    assert tuple(pages.dependency_summary(stored).first()) == (1, 1, 2, 1, 1)
    acc = {r.line: (r.accessKind, r.ownerObject) for r in pages.field_accesses(refs.withColumn("context", F.lit("qry.FieldByName('a').Value"))).collect()}
    assert acc[1] == ("FieldByName", "qry")


def test_risk_list_filters_after_folding(spark, projects):
    rows = [(1, 1, "t", "low", "Found 'a'", "d", "u.pas", 1, None), (2, 1, "t", "critical", "Found 'b'", "d", "u.pas", 1, None), (3, 1, "t", "critical", "SQL text", None, "v.pas", None, "fix")]
    risks = spark.createDataFrame(rows, "id long, projectId long, riskType string, severity string, title string, description string, sourceFile string, lineNumber int, recommendation string")
    got = pages.risk_list(risks, projects, pages.Request(), critical_only=True).collect()
    assert sorted((r.occurrenceCount, r.severity) for r in got) == [(1, "critical"), (2, "critical")]
    assert pages.risk_list(risks, projects, pages.Request(search="FIX")).count() == 1 and pages.risk_list(risks, projects, pages.Request(), file="V.pas").count() == 1
    assert pages.risk_list(risks, projects, pages.Request(search="found 'zzz'")).count() == 1  # quoted text is a mark on both sides


def test_visible_projects(spark, projects):
    j = spark.createDataFrame([(1, 2, "failed"), (4, 2, "queued"), (2, 3, "running")], "id long, projectId long, status string")
    got = {r.id: r.jobStatus for r in pages.visible_projects(projects, j).collect()}
    assert got == {1: None, 2: "queued", 3: "running"}


# jobs -------------------------------------------------------------------------------------------
JOB = "id long, projectId long, type string, payloadJson string, status string, progress int, attemptCount int, maxAttempts int, lockedBy string, leaseUntil timestamp, heartbeatAt timestamp, createdAt timestamp, startedAt timestamp, finishedAt timestamp, errorMessage string"


def at(seconds):
    return F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def job_rows(spark, *rows):
    """(id, project, type, status, tries, holder, lease, created) in seconds from the start."""
    data = [(i, p, t, json.dumps({"type": t} | ({"gitUrl": "https://x"} if t == "import_git" else {})), s, 0, n, 3, by, lease, None, made, None, None, None) for i, p, t, s, n, by, lease, made in rows]
    df = spark.createDataFrame(data, JOB.replace("leaseUntil timestamp", "leaseUntil int").replace("createdAt timestamp", "createdAt int"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    moved = lambda c: (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(c))).alias(c)
    return df.select(*[moved(c) if c in ("leaseUntil", "createdAt") else F.col(c) for c in df.columns])


def test_a_job_from_queue_to_end(spark, projects):
    j = job_rows(spark, (1, 1, "import_git", "queued", 0, None, None, 5), (2, 3, "analyze", "queued", 0, None, None, 1), (3, 1, "analyze", "completed", 1, None, None, 0))
    j = jobs.claimed(j, "w1", at(10))
    state = lambda df: {r.id: (r.status, r.lockedBy, r.attemptCount) for r in df.collect()}
    assert state(j) == {1: ("queued", None, 0), 2: ("running", "w1", 1), 3: ("completed", None, 1)}
    j = jobs.claimed(j, "w2", at(11))
    assert state(j)[1] == ("running", "w2", 1)
    assert state(jobs.claimed(j, "w3", at(12))) == state(j)
    beats = spark.createDataFrame([(1, "w2", 1), (2, "other", 1), (2, "w1", 7)], "id long, lockedBy string, attemptCount int")
    later = {r.id: r.leaseUntil.second for r in jobs.heartbeats(j, beats, at(20)).where("status = 'running'").collect()}
    assert later == {1: 50, 2: 40}
    told = spark.createDataFrame([(1, "w2", 1, "completed", None), (2, "stranger", 1, "failed", "no")], "id long, lockedBy string, attemptCount int, status string, errorMessage string")
    done = jobs.finalized(j, told, at(30))
    assert state(done)[1] == ("completed", None, 1) and state(done)[2] == ("running", "w1", 1) and done.where("id = 1").first()["progress"] == 100
    assert [(r.projectId, r.type) for r in jobs.follow_ups(j, done).collect()] == [(1, "analyze")]
    p = projects.withColumn("status", F.when(F.col("id") == 1, "importing").otherwise(F.col("status")))
    assert {r.id: r.status for r in jobs.project_states(p, j, done).collect()} == {1: "ready", 2: "draft", 3: "importing", 4: "draft"}


def test_progress_by_owner(spark):
    j = jobs.claimed(job_rows(spark, (1, 1, "analyze", "queued", 0, None, None, 5), (2, 2, "import_git", "queued", 0, None, None, 9)), "w", at(10))
    told = lambda stage, by="w": spark.createDataFrame([(1, by, 1, stage)], "id long, lockedBy string, attemptCount int, stage int")
    now = lambda df: {r.id: r.progress for r in df.collect()}
    j = jobs.progressed(j, told(2))
    assert now(j) == {1: 45, 2: 0} and now(jobs.progressed(j, told(0))) == {1: 45, 2: 0} and now(jobs.progressed(j, told(5, "x"))) == {1: 45, 2: 0}


def test_recovery(spark, projects):
    j = job_rows(spark, (1, 1, "analyze", "running", 1, "w", 5, 0), (2, 2, "analyze", "running", 3, "w", 5, 0), (3, 3, "analyze", "running", 1, "w", 90, 0), (4, 4, "analyze", "running", 1, None, None, 0))
    r = {x.id: (x.status, x.lockedBy) for x in jobs.recovered(j, at(60)).collect()}
    assert r == {1: ("queued", None), 2: ("failed", None), 3: ("running", "w"), 4: ("queued", None)}
    assert [x.id for x in jobs.orphaned_projects(projects, j.where("projectId <> 3")).collect()] == [3]
    assert jobs.orphaned_projects(projects, j).count() == 0


def test_enqueue_one_job_a_project(spark, projects):
    j = job_rows(spark, (1, 3, "analyze", "running", 1, "w", 5, 0))
    ask = [(1, 1, "analyze"), (2, 1, "import_git"), (3, 2, "analyze"), (4, 9, "analyze"), (5, 3, "analyze"), (6, 4, "import_zip"), (7, 2, "analyze")]
    req = spark.createDataFrame([(i, p, t, json.dumps({"type": t, "gitUrl": "https://x"})) for i, p, t in ask], "requestId long, projectId long, type string, payloadJson string")
    got = {r.requestId: r.reason for r in jobs.enqueued(j, projects, req, at(1)).collect()}
    assert got == {1: None, 2: "PROJECT_JOB_ACTIVE", 3: "INVALID_PROJECT_STATE", 4: "PROJECT_NOT_FOUND", 5: "PROJECT_JOB_ACTIVE", 6: "INVALID_PAYLOAD", 7: "PROJECT_JOB_ACTIVE"}
    assert {r.requestId: r.reason for r in jobs.enqueued(j, projects, req, at(60)).collect()}[5] == "INVALID_PROJECT_STATE"


def test_payloads_uploads_and_transitions(spark, projects):
    data = [(1, "import_zip", '{"type":"import_zip","tempFilePath":"/u/a.zip"}'), (2, "import_zip", '{"type":"import_zip"}'), (3, "import_zip", '{"type":"import_zip","tempFilePath":"a","zipContent":"b"}'), (4, "analyze", '{"type":"import_git","gitUrl":"x"}'), (5, "analyze", "{"), (6, "analyze", None)]
    df = spark.createDataFrame([(*x, "queued", 1) for x in data], "id long, type string, payloadJson string, status string, projectId long")
    assert {r.id: (r.validPayload, r.tempFilePath) for r in jobs.parsed_payloads(df).collect()} == {1: (True, "/u/a.zip"), **{i: (False, None) for i in range(2, 7)}}
    up = spark.createDataFrame([("/u/a.zip",), ("/u/old.zip",)], "path string").withColumn("modifiedAt", at(0))
    assert [r.path for r in jobs.expired_uploads(up, df, at(100), 50).collect()] == ["/u/old.zip"] and jobs.expired_uploads(up, df, at(10), 50).count() == 0
    ch = spark.createDataFrame([(1, "analyzing"), (2, "completed"), (3, "importing")], "id long, status string")
    assert {r.id: r.status for r in jobs.applied_transitions(projects, ch).collect()} == {1: "analyzing", 2: "draft", 3: "importing", 4: "draft"}
    row = spark.createDataFrame([("load", None, "a.go")], "s string, m string, c string").select(jobs.error_text(F.col("s"), F.col("m"), F.col("c")).alias("t")).first()
    assert row.t == "load | a.go"


# imports ----------------------------------------------------------------------------------------
def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in entries.items():
            z.writestr(k.replace("__", "/").replace("_dot_", "."), v)
    return out.getvalue()


def test_archives_are_accepted_or_refused_whole(spark, monkeypatch):
    good = zipped(src__a_dot_go="package a\n", src__b_dot_py="x", readme_dot_txt="x", f_dot_dfm="object A: TA\nend")
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../up.go", "package a")
    rows = [("good", good), ("evil", evil.getvalue()), ("twice", zipped(A_dot_go="1", a_dot_go="2")), ("none", zipped(x_dot_txt="1")), ("broken", b"PK nonsense")]
    e = archives.unzipped(spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "path string, content binary"))
    assert {r.archive: r.problem for r in archives.archive_problems(e).collect()} == {"evil": "ZIP_UNSAFE_PATH", "twice": "ZIP_DUPLICATE_PATH", "none": "EMPTY_SOURCE", "broken": "ZIP_INVALID"}
    assert {(r.archive, r.path) for r in archives.accepted_rows(e).collect()} == {("good", "src/a.go"), ("good", "f.dfm")}
    assert {(r.code, r.filePath) for r in archives.import_warning_rows(e).where("archive = 'good'").collect()} == {("IMPORT_LANGUAGE_UNSUPPORTED", "src/b.py"), ("IMPORT_LIMITED_ANALYSIS", "f.dfm")}
    s = {r.archive: (r.files, r.warnings, r.problem) for r in archives.import_summary(e).collect()}
    assert s["good"] == (2, 2, None) and s["none"] == (0, 0, "EMPTY_SOURCE")
    probe = {r.path: (r.valid, r.sourceFiles) for r in archives.zip_probe(spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "path string, content binary")).collect()}
    assert probe["good"] == (True, 2) and probe["broken"] == (False, 0)
    monkeypatch.setattr(archives, "MAX_FILES", 1)
    assert {r.archive: r.problem for r in archives.archive_problems(e).collect()}["good"] == "ZIP_TOO_MANY_FILES"


def test_import_replaces_files_of_one_project(spark, tmp_path):
    kept = archives.read_base64_zip(spark.createDataFrame([(base64.b64encode(zipped(a_dot_go="package a\nx\n", ignored_dot_lock="x")).decode(),)], "z string"), "z").where("action = 'keep'")
    target = str(tmp_path / "files")
    for project in (1, 2):
        archives.replace_project_files(kept, target, project)
    archives.replace_project_files(kept.withColumn("content", F.lit("package b")), target, 1)
    got = {(r.projectId, r.filePath, r.content, r.lineCount) for r in spark.read.parquet(target).collect()}
    assert got == {(1, "a.go", "package b", 1), (2, "a.go", "package a\nx\n", 3)}


def test_source_addresses(spark):
    cases = {"https://git.example.org/a/b.git": True, "http://git.example.org/a": False, "https://user:pw@git.example.org/a": False, "https://localhost/a": False, "https://127.0.0.1/a": False, "https://10.1.2.3:8443/a": False, "https://172.20.0.1/a": False, "https://[::1]/a": False, "": False}
    df = spark.createDataFrame([*[(k,) for k in cases], (None,)], "u string")
    assert {r.u: r.ok for r in df.select("u", archives.is_safe_source_url(F.col("u")).alias("ok")).collect()} == {**cases, None: False}
    assert df.where(archives.is_safe_source_url(F.col("u"), ["other.org"])).count() == 0


@pytest.mark.parametrize(("text", "encoding"), [("Привет, мир и все остальные", "windows-1251"), ("Γειά σου κόσμε και όλοι", "windows-1253"), ("größer als üblich", "windows-1252"), ("更新稅率設定之後一定要同步", "big5")])
def test_encodings(text, encoding):
    got, name, warning = archives.decode(text.encode(encoding))
    assert warning and isinstance(got, str) and (got == text or name != encoding)


def test_bytes_as_text():
    assert (archives.format_bytes(30 * 1024**2), archives.format_bytes(1536 * 1024), archives.format_bytes(7)) == ("30 MB", "1.5 MB", "7 bytes")


# reports ----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def report(spark):
    rows = [(1, 1, "src/U.pas", "unit U;\ninterface\nimplementation\nprocedure A;\nbegin\n  B(1);\n  Q.SQL.Text := 'DELETE FROM stock';\nend;\nprocedure B(n: Integer);\nbegin\n  x := 20240131;\nend;\nend.\n"), (1, 2, "src/U.dfm", "object U: TU\n  object b: TButton\n    OnClick = A\n  end\nend\n"), (2, 3, "a.go", "package a\n")]
    a = Analysis(spark.createDataFrame(rows, "projectId long, id long, filePath string, content string"))
    return a, checkpointed(reports.report_lines(a))


def test_documents_of_a_report(report):
    a, lines = report
    made_of = checkpointed(reports.documents(lines))
    docs = {(r.projectId, r.document): r.text for r in made_of.collect()}
    assert {d for p, d in docs if p == 1} >= {"FLOW.md", "RISKS.md", "RULES.yaml", "DELPHI_EVENT_MAP.md", "UI_DATABASE_FLOW.md", "EXECUTIVE_SUMMARY.md", "IMPACT_SUMMARY.md", "FILE_COUNTERS.md", "BUILD_DOCTOR.md", "WARNINGS.md"}
    assert docs[1, "RISKS.md"].startswith("# RISKS\n") and docs[1, "RISKS.md"].index("## 0 critical") < docs[1, "RISKS.md"].index("Date literal")
    assert "- calls B at src/U.pas:6" in docs[1, "FLOW.md"] and docs[1, "RULES.yaml"].startswith('- type: "')
    assert "- symbolCount: 0" in docs[2, "EXECUTIVE_SUMMARY.md"] and "The analysis" not in docs[2, "EXECUTIVE_SUMMARY.md"]
    sizes = {r.projectId: (r.entries, r.bytes, r.accepted) for r in reports.archive_sizes(made_of).collect()}
    assert sizes[1][1] == sum(len(t.encode()) for (p, _), t in docs.items() if p == 1) and sizes[1][2]
    made = {r.projectId: bytes(r.archive) for r in reports.archives(made_of).collect()}
    assert set(zipfile.ZipFile(io.BytesIO(made[1])).namelist()) == {d for p, d in docs if p == 1}
    assert zipfile.ZipFile(io.BytesIO(made[1])).read("FLOW.md").decode() == docs[1, "FLOW.md"]


@pytest.mark.parametrize("limit", [120, 300, 1000])
def test_documents_are_cut_at_a_limit(spark, limit):
    rows = [(1, "D.md", f"s{i % 3}", f"{i:03}", f"líne number {i}") for i in range(60)] + [(2, "D.md", "s", "0", "short")]
    lines = spark.createDataFrame(rows, "projectId long, document string, section string, ord string, text string")
    docs = {r.projectId: r for r in reports.documents(lines, limit).collect()}
    whole = {r.projectId: r.text for r in reports.documents(lines).collect()}
    cut = docs[1].text.removesuffix(reports.FOOTER)
    assert docs[1].truncated and whole[1].startswith(cut) and docs[1].bytes <= limit + 8 and not docs[2].truncated and docs[2].text == whole[2]
    assert [(r.projectId, r.code) for r in reports.truncation_warnings(reports.documents(lines, limit)).collect()] == [(1, "ANALYSIS_DOCUMENT_TRUNCATED")]


def test_impact_counts_against_plain_counts(report):
    a, _ = report
    keys = {r.stableKey: r.file for r in a.symbols.where("projectId = 1").collect()}
    plain = {}
    for r in [*a.risks.where("projectId = 1").collect(), *a.rules.where("projectId = 1").collect()]:
        if r.file:
            plain[r.file] = plain.get(r.file, 0) + 1
    for r in a.edges.where("projectId = 1").collect():
        for k in (r.fromKey, r.toKey):
            if k in keys:
                plain[keys[k]] = plain.get(keys[k], 0) + 1
    assert {r.file: r.impactCount for r in reports.impact_counts(a.risks, a.rules, a.edges, a.symbols).where("projectId = 1").collect()} == plain


def test_entries_of_a_diff_archive(spark):
    diff = spark.createDataFrame([(1, "risks", "k", "added", None, "v"), (1, "files", "p", "changed", "a", "b")], "projectId long, section string, key string, change string, before string, after string")
    m = spark.createDataFrame([(1, 3)], "projectId long, fileCount int")
    got = {r.document: r.text for r in reports.diff_documents(diff, history.metric_deltas(m.limit(0), m)).collect()}
    assert set(got) == {"ANALYSIS_DIFF.md", "ANALYSIS_DIFF.json", "METRICS_DELTA.json"}
    assert "## risks.introduced" in got["ANALYSIS_DIFF.md"] and json.loads(got["METRICS_DELTA.json"])["fileCount"] == 3 and json.loads(got["ANALYSIS_DIFF.json"])["buckets"]["files.changed"]["total"] == 1
    docs = spark.createDataFrame([("completed", "a", "b", "c", "d"), ("failed", "a", "b", "c", "d"), ("partial", "a", " ", "c", None)], "status string, flow string, dataDependency string, risks string, rules string")
    assert [r.ready for r in history.exportable(docs, ("completed", "partial")).collect()] == [True, False, False]


def test_capped_sections_and_reasons(spark):
    df = spark.createDataFrame([(1, "a", i) for i in range(15)] + [(1, "b", 1)], "projectId long, section string, n int")
    got = reports.capped(df, ["projectId", "section"], [F.col("n")])
    assert {(r.section, r.hiddenCount) for r in got.collect()} == {("a", 3), ("b", 0)} and got.where("section = 'a'").count() == 12
    w = spark.createDataFrame([(1, "A", "warning"), (1, "A", "warning"), (1, "B", "warning"), (1, "N", "note")], "projectId long, code string, level string")
    s = spark.createDataFrame([(1, "partial"), (2, "completed")], "projectId long, status string")
    assert [r.reason for r in reports.partial_reasons(w, s).orderBy("ord", "reason").collect()] == ["A (2)", "B (1)", "Some files were skipped or analysed in part."]


# planted cases of operators that the given tables hardly exercise --------------------------------
def test_run_of_the_present_source(spark):
    p = spark.createDataFrame([(1, "new"), (2, "x"), (3, None), (4, "none")], "id long, sourceFingerprint string")
    runs = spark.createDataFrame([(1, 1, 1, "completed", "old"), (2, 1, 2, "partial", "new"), (3, 1, 3, "failed", "new"), (4, 1, 4, "completed", "other"), (5, 2, 7, "completed", "x"), (6, 3, 1, "completed", None)], "id long, projectId long, runNumber int, status string, sourceFingerprint string")
    runs = runs.withColumn("createdAt", F.lit(None).cast("timestamp_ntz")).withColumn("completedAt", F.lit(None).cast("timestamp_ntz"))
    assert {r.projectId: r.runId for r in lists.current_source_run(p, runs).collect()} == {1: 2, 2: 5}
    status = lists.analysis_status(p.withColumn("status", F.lit("analyzing")), runs)
    assert {r.id: r.analysisStatus for r in status.collect()} == {1: "partial", 2: "completed", 3: "running", 4: "running"}


def test_paths_that_collide(spark):
    f = spark.createDataFrame([(1, "a\\B.pas"), (1, "./A/b.pas"), (1, "a/b.pas/"), (1, "c.pas"), (2, "a/b.pas"), (1, None)], "projectId long, path string")
    assert [(r.projectId, r.key, r.n) for r in lists.duplicate_paths(f).collect()] == [(1, "a/b.pas", 3)]


def test_go_calls_by_type_name_and_function(spark):
    rows = [
        (1, 1, "a.go", "package a\n\ntype A struct{}\n\nfunc (a *A) Save() {\n}\n\nfunc run(x *A, y Other) {\n\tx.Save()\n\ty.Load()\n\thelp()\n\tz.Nothing()\n\tlen(x)\n}\n"),
        (1, 2, "b.GO", "package a\n\ntype B struct{}\n\nfunc (b B) Save() {\n}\n\nfunc (b B) Load() {\n}\n\nfunc help() {\n}\n"),
        (2, 3, "c.go", "package c\n\nfunc help() {\n\thelp()\n}\n"),
    ]
    e = Analysis(spark.createDataFrame(rows, "projectId long, id long, filePath string, content string")).edges.where("type = 'calls'")
    assert {(r.projectId, r.fromName, r.toName, r.file) for r in e.collect()} == {(1, "run", "A.Save", "a.go"), (1, "run", "B.Load", "a.go"), (1, "run", "help", "a.go")}


def test_packages_of_every_kind(spark):
    rows = [
        (1, 1, "p/App.dpk", "package App;\nrequires rtl, vcl290, Local, Twice, Alien, 'x';\nend."), (1, 2, "p/Local.dpk", "package Local;\nend."),
        (1, 3, "q/Twice.dpk", "package Twice;\nend."), (1, 4, "r/Twice.dpk", "package Twice;\nend."),
        (1, 5, "p/App.dproj", "<Project><PropertyGroup><DCC_UsePackage>..\\lib\\Gone.dpk</DCC_UsePackage></PropertyGroup></Project>"),
    ]
    r = build.build_records(spark.createDataFrame(rows, "projectId long, id long, filePath string, content string"))
    got = {x.package.lower(): x.resolution for x in build.package_resolutions(r).collect()}
    assert got == {"rtl": "delphi_standard", "vcl290": "delphi_standard", "local": "project_local", "twice": "ambiguous", "alien": "external_unverified", "..\\lib\\gone.dpk": "missing"}
