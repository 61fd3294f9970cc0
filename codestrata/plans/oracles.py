"""The same queries in SQL, for an independent engine over the same tables."""

from __future__ import annotations

_SP = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_TRIM = rf"regexp_replace(raw, '^{_SP}+|{_SP}+$', '', 'g')"
_LINES = rf"""
f AS (SELECT projectId, id AS fileId, replace(filePath, '\', '/') AS file, content FROM files WHERE content IS NOT NULL),
l0 AS (SELECT projectId, fileId, file, unnest(regexp_split_to_array(content, '\r?\n')) AS raw,
              unnest(range(1, len(regexp_split_to_array(content, '\r?\n')) + 1))::INT AS line FROM f),
lines AS (SELECT *, {_TRIM} AS text FROM l0)
"""
_NORM = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[\"''`].*?[\"''`]', '<value>', 'g'),"
    r" '\b\d+\b', '<n>', 'g'), '[a-zA-Z]:\\[^\s)]+', '<path>', 'g'), '\\\\[^\s)]+', '<path>', 'g'), '\s+', ' ', 'g'))"
)


def _norm(c: str) -> str:
    return _NORM.replace("{0}", c)


_P6_LATEST = r"""
latest AS (
  SELECT projectId, runNumber, stableKey,
         max_by({'name': name, 'type': type, 's': startLine, 'e': endLine,
                 'sig': regexp_replace(trim(regexp_replace(signature, '[\s\x{00A0}\x{3000}\x{200B}\x{FEFF}]+', ' ', 'g')), ' ?([^\w ]) ?', '\1', 'g')}, rowId) AS v
  FROM symbol_snapshots WHERE projectId IS NOT NULL AND runNumber IS NOT NULL AND stableKey IS NOT NULL AND rowId IS NOT NULL
  GROUP BY 1, 2, 3),
runs AS (SELECT projectId, runNumber, lag(runNumber) OVER (PARTITION BY projectId ORDER BY runNumber) AS base
         FROM (SELECT DISTINCT projectId, runNumber FROM latest)),
now AS (SELECT l.projectId, l.runNumber, l.stableKey, l.v FROM latest l JOIN runs r USING (projectId, runNumber) WHERE r.base IS NOT NULL),
base AS (SELECT l.projectId, r.runNumber, l.stableKey, l.v FROM runs r JOIN latest l ON l.projectId = r.projectId AND l.runNumber = r.base),
diff AS (SELECT projectId, runNumber, stableKey,
       CASE WHEN base.v IS NULL THEN 'added' WHEN now.v IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM now FULL JOIN base USING (projectId, runNumber, stableKey)
WHERE base.v IS NULL OR now.v IS NULL OR now.v.name IS DISTINCT FROM base.v.name OR now.v.type IS DISTINCT FROM base.v.type
   OR now.v.s IS DISTINCT FROM base.v.s OR now.v.e IS DISTINCT FROM base.v.e OR now.v.sig IS DISTINCT FROM base.v.sig)
"""
_EXT = "CASE WHEN contains({0}, '.') THEN lower(string_split({0}, '.')[-1]) WHEN {0} IS NOT NULL THEN '' END"
_LANG = "CASE WHEN {0} IN ('go', 'sql') THEN {0} WHEN {0} IN ('pas', 'dpr', 'delphi', 'dfm', 'inc', 'dpk', 'fmx', 'dproj', 'groupproj', 'bdsproj', 'cfg', 'dof', 'rc') THEN 'delphi' END"
_USABLE = "status IN ('completed', 'completed_with_warnings', 'partial')"
_LATEST = f"""
SELECT projectId, id AS runId, runNumber, status, sourceFingerprint, completedAt FROM (
  SELECT *, row_number() OVER (PARTITION BY projectId ORDER BY runNumber DESC, coalesce(createdAt, TIMESTAMP '1970-01-01') DESC, id DESC) AS n FROM {{0}} WHERE {_USABLE}) WHERE n = 1
"""
_CURRENT = _LATEST.replace("{0}", "(SELECT r.* FROM analysis_runs r WHERE EXISTS (SELECT 1 FROM projects p WHERE p.id = r.projectId AND p.sourceFingerprint = r.sourceFingerprint))")
_OCC = f"""
occ AS (SELECT projectId, concat_ws('|', riskType, {_norm('title')}, {_norm('description')}, {_norm('sourceFile')}, coalesce(lineNumber::VARCHAR, ''), {_norm('recommendation')}) AS key, count(*) AS occurrenceCount,
  max_by(severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS severity,
  min_by({{'riskType': riskType, 'title': title, 'description': description, 'sourceFile': sourceFile, 'lineNumber': lineNumber, 'recommendation': recommendation, 'id': id}},
         {{'f': coalesce(sourceFile, ''), 'l': coalesce(lineNumber, 0), 'i': id}}) AS r
  FROM risks GROUP BY 1, 2)
"""
_TWO = """
x AS (SELECT *, dense_rank() OVER (PARTITION BY projectId ORDER BY runNumber DESC) AS n FROM symbol_snapshots),
y AS (SELECT n, projectId, stableKey, max_by({'a': name, 'b': type, 'c': startLine, 'd': endLine, 'e': signature}, rowId) AS v FROM x WHERE n <= 2 GROUP BY 1, 2, 3),
k1 AS (SELECT projectId, stableKey, CASE WHEN b.v IS NULL THEN 'added' WHEN c.v IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM (SELECT * FROM y WHERE n = 2) b FULL JOIN (SELECT * FROM y WHERE n = 1) c USING (projectId, stableKey) WHERE b.v IS NULL OR c.v IS NULL OR b.v IS DISTINCT FROM c.v)
"""
_WARN = """
w AS (SELECT id AS projectId, unnest(range(0, json_array_length(importWarningsJson)::BIGINT))::INT AS ord, unnest(from_json(importWarningsJson, '["JSON"]')) AS w FROM projects
      WHERE json_valid(importWarningsJson) AND json_type(importWarningsJson) = 'ARRAY'),
warnings AS (SELECT projectId, ord, w->>'$.code' AS code, w->>'$.message' AS message, w->>'$.filePath' AS filePath FROM w WHERE w->>'$.code' IS NOT NULL)
"""


_NEWEST = """
n AS (SELECT projectId, max(runNumber) AS runNumber FROM symbol_snapshots GROUP BY 1),
newest AS (SELECT projectId, runNumber, stableKey, v.* FROM (SELECT s.projectId, s.runNumber, s.stableKey,
  max_by({'name': name, 'qualifiedName': qualifiedName, 'type': type, 'file': file, 'startLine': startLine}, rowId) AS v FROM symbol_snapshots s JOIN n USING (projectId, runNumber) GROUP BY 1, 2, 3))
"""


def _block_ends(lines: str, opener: str, closer: str) -> str:
    """End lines of blocks: the start line itself, or the first later line at which the depth is back."""
    return rf"""
counted AS (SELECT *, len(regexp_extract_all(raw, '{opener}')) AS o, len(regexp_extract_all(raw, '{closer}')) AS c FROM {lines}),
depth AS (SELECT *, sum(o - c) OVER (PARTITION BY fileId ORDER BY line) AS d FROM counted)
"""


_END = """
CASE WHEN s.o > 0 AND s.o - s.c <= 0 THEN s.line
     ELSE coalesce((SELECT min(e.line) FROM depth e WHERE e.fileId = s.fileId AND e.line > s.line AND e.d <= s.d - (s.o - s.c)), s.line) END
"""


def oracle_sql() -> dict[str, str]:
    risk_line = lambda arr: f"SELECT projectId, fileId, file, line, unnest(list_filter([{arr}], lambda x: x IS NOT NULL)) AS f FROM src"
    return {
        "p6_found": f"WITH {_P6_LATEST} SELECT * FROM diff",
        "p6_counts": f"WITH {_P6_LATEST} SELECT projectId, runNumber, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'changed') AS changed FROM diff GROUP BY 1, 2",
        "a6_paths": rf"""
WITH p AS (SELECT id, filePath, regexp_replace(regexp_replace(replace(filePath, '\', '/'), '^\./+', ''), '^/+', '') AS path FROM files),
q AS (SELECT *, {_EXT.replace('{0}', 'path')} AS extension, string_split(path, '/')[-1] AS base, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p)
SELECT id, path, coalesce(path <> '' AND len(seg) > 0 AND NOT list_contains(seg, '.') AND NOT list_contains(seg, '..') AND NOT regexp_matches(seg[1], '^[a-zA-Z]:$'), FALSE) AS safe,
  coalesce(regexp_matches(filePath, '^[/\\]|^[a-zA-Z]:[\\/]'), FALSE) AS absolute,
  coalesce(regexp_matches(path, '^__MACOSX/|(^|/)node_modules/|(^|/)\.git/|(^|/)dist/|(^|/)build/|(^|/)target/|(^|/)\.idea/|(^|/)\.vscode/|\.lock$|(?i:\.env)'), FALSE) AS ignored,
  extension, {_LANG.replace('{0}', 'extension')} AS language, base, regexp_replace(base, '\.[^.]+$', '') AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM q""",
        "a8_duplicate_paths": r"""
SELECT projectId, lower(regexp_replace(regexp_replace(regexp_replace(replace(path, '\', '/'), '^\./+', ''), '^/+', ''), '/+$', '')) AS key, count(*) AS n FROM extracted_files GROUP BY 1, 2 HAVING count(*) > 1""",
        "a10_import_guard": """
SELECT projectId, count(*) AS files, sum(coalesce(strlen(content), 0))::BIGINT AS bytes, count(*) FILTER (WHERE strlen(content) > 5242880) AS oversized,
  count(*) <= 2000 AND sum(coalesce(strlen(content), 0)) <= 524288000 AS accepted FROM extracted_files GROUP BY 1""",
        "a18_import_warnings": f"WITH {_WARN} SELECT * FROM warnings",
        "b2_line_counts": r"SELECT id, len(regexp_split_to_array(content, '\r?\n'))::INT AS lines FROM files WHERE content IS NOT NULL",
        "c2_lines": f"WITH {_LINES} SELECT fileId, line, text FROM lines",
        "c4_go_symbols": rf"""
WITH {_LINES}, {_block_ends("(SELECT * FROM lines WHERE lower(file) LIKE '%.go')", '[{]', '[}]')},
w AS (SELECT *, string_split_regex(trim(replace(text, '(', ' ( ')), '\s+') AS words, ltrim(substr(text, 5)) AS rest FROM depth),
h AS (SELECT *, words[1] = 'func' AND words[2] = '(' AS has_recv, CASE WHEN words[1] = 'func' AND words[2] = '(' THEN ltrim(split_part(rest, ')', 2)) WHEN words[1] = 'func' THEN rest ELSE '' END AS tail FROM w),
m AS (SELECT *, {{'recv': CASE WHEN has_recv THEN split_part(substr(rest, 2), ')', 1) ELSE '' END, 'name': CASE WHEN contains(tail, '(') AND NOT regexp_matches(rtrim(split_part(tail, '(', 1)), '\W|^\d|^$') THEN rtrim(split_part(tail, '(', 1)) ELSE '' END}} AS fn,
  CASE WHEN words[1] = 'type' AND regexp_matches(words[3], '^struct\b') THEN words[2] ELSE '' END AS st FROM h),
s AS (SELECT *, ltrim(string_split_regex(trim(fn.recv), '\s+')[-1], '*') AS owner FROM m),
r AS (SELECT fileId, file, line, CASE WHEN fn.name <> '' THEN fn.name ELSE st END AS name, CASE WHEN fn.name <> '' THEN CASE WHEN owner <> '' THEN owner || '.' || fn.name ELSE fn.name END END AS qualifiedName,
  CASE WHEN fn.name = '' THEN 'class' WHEN fn.recv <> '' THEN 'method' ELSE 'function' END AS type, CASE WHEN fn.name = '' THEN line ELSE {_END} END AS endLine FROM s WHERE fn.name <> '' OR st <> '')
SELECT fileId, name, qualifiedName, type, line AS startLine, endLine::INT AS endLine, file || '::' || coalesce(qualifiedName, name) || '::' || line AS stableKey FROM r""",
        "c21_pascal_symbols": rf"""
WITH {_LINES}, pas AS (SELECT * FROM lines WHERE regexp_matches(lower(file), '\.(pas|dpr|inc|dpk)$')),
cnt AS (SELECT *, len(regexp_extract_all(raw, '(?i)\bbegin\b')) AS o1, len(regexp_extract_all(raw, '(?i)\bend\b\s*;?')) AS c1, len(regexp_extract_all(raw, '(?i)\bclass\b')) AS o2 FROM pas),
depth AS (SELECT *, sum(o1 - c1) OVER w AS d1, sum(o2 - c1) OVER w AS d2 FROM cnt WINDOW w AS (PARTITION BY fileId ORDER BY line)),
t1 AS (SELECT *, CASE WHEN regexp_matches(lower(text), '^class\s') THEN ltrim(substr(text, 6)) ELSE text END AS head FROM depth WHERE NOT list_contains(['interface', 'implementation', 'initialization', 'finalization'], regexp_extract(lower(text), '^\w+'))),
t2 AS (SELECT *, regexp_extract(lower(head), '^\w+') AS kind, regexp_extract(ltrim(substr(head, length(regexp_extract(head, '^\w+')) + 1)), '^[\w$.]+') AS nm FROM t1),
t3 AS (SELECT *, ltrim(substr(head, strpos(head, nm) + length(nm))) AS rest0 FROM t2),
t4 AS (SELECT *, CASE WHEN starts_with(rest0, '(') THEN CASE WHEN contains(rest0, ')') THEN ltrim(substr(rest0, strpos(rest0, ')') + 1)) ELSE '(' END ELSE rest0 END AS rest FROM t3),
t5 AS (SELECT *, list_contains(['procedure', 'function', 'constructor', 'destructor'], kind) AND nm <> '' AND NOT regexp_matches(nm, '^\d|[.]$|[.][.]') AND (rest = '' OR starts_with(rest, ';') OR starts_with(rest, ':') AND trim(split_part(substr(rest, 2), ';', 1)) <> '') AS is_head FROM t4),
s AS (SELECT *, {{'kind': kind, 'full': CASE WHEN is_head THEN nm ELSE '' END}} AS m,
  CASE WHEN regexp_matches(lower(ltrim(split_part(text, '=', 2))), '^class\b') AND regexp_matches(trim(split_part(text, '=', 1)), '^(\w+\s+)?[^\W\d][\w$]*$') AND (NOT contains(trim(split_part(text, '=', 1)), ' ') OR starts_with(lower(text), 'type ')) THEN string_split_regex(trim(split_part(text, '=', 1)), '\s+')[-1] ELSE '' END AS k FROM t5),
r AS (SELECT fileId, file, line, CASE WHEN m.full <> '' THEN string_split(m.full, '.')[-1] ELSE k END AS name, CASE WHEN m.full <> '' THEN m.full ELSE k END AS qualifiedName,
  CASE WHEN m.full = '' THEN 'class' WHEN lower(m.kind) IN ('constructor', 'destructor') OR contains(m.full, '.') THEN 'method' ELSE lower(m.kind) END AS type,
  CASE WHEN m.full <> '' THEN CASE WHEN s.o1 > 0 AND s.o1 - s.c1 <= 0 THEN s.line ELSE coalesce((SELECT min(e.line) FROM depth e WHERE e.fileId = s.fileId AND e.line > s.line AND e.d1 <= s.d1 - (s.o1 - s.c1)), s.line) END
       ELSE CASE WHEN s.o2 - s.c1 <= 0 THEN s.line ELSE coalesce((SELECT min(e.line) FROM depth e WHERE e.fileId = s.fileId AND e.line > s.line AND e.d2 <= s.d2 - (s.o2 - s.c1)), s.line) END END AS endLine FROM s WHERE m.full <> '' OR k <> ''),
u AS (SELECT fileId, file, first(regexp_extract(raw, '(?i)^\s*(?:unit|library|program)\s+([A-Za-z_][\w$]*)', 1) ORDER BY line) AS name FROM pas
  WHERE regexp_matches(raw, '(?i)^\s*(?:unit|library|program)\s+[A-Za-z_]') AND NOT regexp_matches(text, '^(//|\{{|\(\*)') GROUP BY 1, 2),
n AS (SELECT fileId, max(line) AS lines FROM pas GROUP BY 1),
every AS (SELECT fileId, file, name, qualifiedName, type, line AS startLine, endLine::INT AS endLine FROM r UNION ALL SELECT u.fileId, file, name, name, 'class', 1, lines FROM u JOIN n USING (fileId))
SELECT fileId, name, qualifiedName, type, startLine, endLine, file || '::' || qualifiedName || '::' || startLine AS stableKey FROM every""",
        "c8_sql_symbols": rf"""
WITH {_LINES}, m AS (SELECT fileId, file, line, text, regexp_extract(raw, '(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z_][\w$]*|`[^`]+`)', 1) AS t, regexp_extract(raw, '(?i)CREATE\s+PROCEDURE\s+([A-Za-z_][\w$]*)', 1) AS p,
  regexp_extract(raw, '(?i)CREATE\s+FUNCTION\s+([A-Za-z_][\w$]*)', 1) AS fn, regexp_matches(text, '(?i)^(SELECT|INSERT|UPDATE|DELETE)\b') AS q FROM lines WHERE lower(file) LIKE '%.sql'),
r AS (SELECT *, CASE WHEN t <> '' THEN trim(t, '`') WHEN p <> '' THEN p WHEN fn <> '' THEN fn ELSE 'query_' || line END AS name, CASE WHEN t <> '' THEN 'table' WHEN p <> '' THEN 'procedure' WHEN fn <> '' THEN 'function' ELSE 'query' END AS type FROM m WHERE t <> '' OR p <> '' OR fn <> '' OR q)
SELECT fileId, name, NULL::VARCHAR AS qualifiedName, type, line AS startLine, line AS endLine, file || '::' || name || '::' || line AS stableKey FROM r""",
        "c19_file_warnings": rf"""
WITH f AS (SELECT projectId, id AS fileId, replace(filePath, '\', '/') AS file, content AS c, {_EXT.replace('{0}', 'filePath')} AS e FROM files WHERE content IS NOT NULL),
g AS (SELECT *, e IN ('pas', 'dpr', 'inc', 'dpk', 'delphi') AS pas, e IN ('go', 'sql', 'pas', 'dpr', 'inc', 'dpk', 'delphi') AS script FROM f),
w AS (SELECT projectId, fileId, file, unnest(list_filter([
  CASE WHEN script AND regexp_matches(c, '(?is)["''`](SELECT|INSERT|UPDATE|DELETE).*?\n.*?["''`]') THEN 'SQL_STRING_MULTILINE|warning' END,
  CASE WHEN script AND regexp_matches(c, '(?i)(SELECT|INSERT|UPDATE|DELETE)[^;\n]*("?\s*\+|&|\|\|)') THEN 'SQL_DYNAMIC_STRING|warning' END,
  CASE WHEN e = 'sql' AND contains(c, chr(10)) AND regexp_matches(c, '(?i)(SELECT|INSERT|UPDATE|DELETE)\b') AND NOT contains(c, ';') THEN 'SQL_STATEMENT_MULTILINE|warning' END,
  CASE WHEN pas AND NOT (regexp_matches(c, '(?i)begin\b') AND regexp_matches(c, '(?i)end\b')) THEN 'DELPHI_BLOCK_UNBALANCED|warning' END,
  CASE WHEN pas AND NOT regexp_matches(c, '(?im)^\s*(?:unit|library|program)\s+[A-Za-z_]') THEN 'DELPHI_UNIT_NOT_FOUND|warning' END,
  CASE WHEN e IN ('inc', 'dpk') THEN 'DELPHI_LIMITED_ANALYSIS|warning' END, CASE WHEN pas THEN 'HEURISTIC_ANALYSIS|note' END,
  CASE WHEN e IN ('dproj', 'groupproj', 'bdsproj', 'cfg', 'dof', 'rc') THEN 'IMPORT_BUILD_METADATA|note' END,
  CASE WHEN {_LANG.replace('{0}', 'e')} IS NULL THEN 'LANGUAGE_UNSUPPORTED|warning' END], lambda x: x IS NOT NULL)) AS w FROM g)
SELECT projectId, fileId, file, split_part(w, '|', 1) AS code, split_part(w, '|', 2) AS level FROM w""",
        "c29_magic_values": rf"""
WITH {_LINES}, src AS (SELECT * FROM lines WHERE NOT starts_with(text, '//') AND NOT starts_with(text, '--')),
m AS (SELECT projectId, fileId, file, line, unnest(regexp_extract_all(raw, '["'']([^"'']{{4,}})["'']', 1)) AS value, 'string' AS kind FROM src
  UNION ALL SELECT projectId, fileId, file, line, unnest(regexp_extract_all(raw, '\b(\d{{4,}})\b', 1)), 'number' FROM src),
r AS (SELECT *, CASE WHEN regexp_matches(value, '^\d{{8}}$|^\d{{4}}-\d{{2}}-\d{{2}}$') THEN 'Date literal embedded in code' WHEN kind = 'number' THEN 'Large numeric literal embedded in code' WHEN length(value) >= 10 THEN 'String literal with business meaning' END AS title FROM m)
SELECT projectId, fileId, file, line, value, kind, title, CASE WHEN title LIKE 'String%' THEN 'low' ELSE 'medium' END AS severity FROM r WHERE title IS NOT NULL""",
        "c32_pascal_risks": rf"""
WITH {_LINES}, pas AS (SELECT * FROM lines WHERE regexp_matches(lower(file), '\.(pas|dpr|dfm|inc|dpk|fmx|dproj|groupproj|bdsproj|cfg|dof|rc|delphi)$')),
dec AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)^(;|end;?)$') THEN 'empty' WHEN regexp_matches(text, '(?i)\b(on|raise|begin|try)\b|^[^;]*:=') THEN 'handled' END AS dd FROM pas),
nx AS (SELECT *, first_value(dd IGNORE NULLS) OVER (PARTITION BY fileId ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS nxt FROM dec),
src AS (SELECT * FROM nx WHERE text <> '' AND NOT regexp_matches(text, '^(//|#|\{{|\(\*)')),
e AS ({risk_line(r'''
 CASE WHEN regexp_matches(text, '(?i)FieldByName\(\s*[''"][^''"]+[''"]\s*\)') THEN 'Delphi field access detected|low' END,
 CASE WHEN regexp_matches(text, '(?i)ParamByName\(\s*[''"][^''"]+[''"]\s*\)') THEN 'Delphi query parameter usage detected|low' END,
 CASE WHEN regexp_matches(text, '(?i)\bSQL\.Add\s*\(') AND contains(text, '+') THEN 'Dynamic Delphi SQL construction|high' END,
 CASE WHEN regexp_matches(text, '\bSQL\.Text\b.*:=.*\+') THEN 'Dynamic SQL text assignment|high' END,
 CASE WHEN regexp_matches(text, '(?i)\bexcept\b') AND NOT regexp_matches(text, '(?i)raise\b') AND nxt = 'empty' THEN 'Broad or empty Delphi exception handling|high' END,
 CASE WHEN regexp_matches(text, '(?i)\b(TQuery|TADOQuery|TClientDataSet|TFDQuery|DataSource)\b') THEN 'Delphi database component detected|low' END,
 CASE WHEN regexp_matches(text, '([A-Za-z]:\\|\\\\)[^"''\s]+') OR regexp_matches(text, '(?i)\b(Database|Data Source|User ID|Password|Pwd|Server|Provider)\b') THEN 'Hardcoded Delphi path or connection string|medium' END''')})
SELECT projectId, fileId, file, line, split_part(f, '|', 1) AS title, split_part(f, '|', 2) AS severity FROM e""",
        "c33_conversion_risks": rf"""
WITH {_LINES}, src AS (SELECT * FROM lines), e AS ({risk_line(r'''CASE WHEN regexp_matches(raw, '(?i)Parse(Time|Date)|Format(Date|Time)|strftime') THEN 'Potential date/time conversion inconsistency|medium' END,
 CASE WHEN regexp_matches(raw, '(?i)ParseFloat|Round\(|Truncate\(|Decimal') THEN 'Potential amount conversion inconsistency|high' END''')})
SELECT projectId, fileId, file, line, split_part(f, '|', 1) AS title, split_part(f, '|', 2) AS severity FROM e""",
        "d6_file_search": "SELECT id, projectId, filePath, fileName, fileType, status FROM files WHERE status = 'stored' AND fileType = '.sql' AND (contains(lower(filePath), 'invoice') OR contains(lower(fileName), 'invoice'))",
        "e16_risk_files": r"""
WITH f AS (SELECT projectId, lower(trim(replace(filePath, '\', '/'))) AS k, max(id) AS fileId FROM files GROUP BY 1, 2)
SELECT r.id AS riskId, r.projectId, f.fileId, r.severity FROM risks r LEFT JOIN f ON f.projectId = r.projectId AND f.k = lower(trim(replace(r.sourceFile, '\', '/')))""",
        "e22_analysis_status": f"""
WITH c AS ({_CURRENT}) SELECT p.id, coalesce(c.status, CASE p.status WHEN 'failed' THEN 'failed' WHEN 'analyzing' THEN 'running' ELSE 'pending' END) AS analysisStatus FROM projects p LEFT JOIN c ON c.projectId = p.id""",
        "e9_latest_symbols": f"WITH {_NEWEST} SELECT * FROM newest",
        "e9_symbol_page": f"""WITH {_NEWEST} SELECT * FROM newest WHERE type = 'procedure' AND (contains(lower(name), 'load') OR contains(lower(qualifiedName), 'load') OR contains(lower(file), 'load'))
ORDER BY projectId, coalesce(file, '') COLLATE C, coalesce(startLine, 0), stableKey COLLATE C LIMIT 50 OFFSET 50""",
        "f26_metric_deltas": """
WITH c AS (SELECT projectId, runNumber, type, count(DISTINCT stableKey) AS n FROM symbol_snapshots GROUP BY 1, 2, 3),
r AS (SELECT *, lag(runNumber) OVER (PARTITION BY projectId ORDER BY runNumber) AS base FROM (SELECT DISTINCT projectId, runNumber FROM symbol_snapshots)),
x AS (SELECT r.projectId, r.runNumber, c.type, c.n AS a, 0 AS b FROM r JOIN c ON c.projectId = r.projectId AND c.runNumber = r.runNumber WHERE r.base IS NOT NULL
  UNION ALL SELECT r.projectId, r.runNumber, c.type, 0, c.n FROM r JOIN c ON c.projectId = r.projectId AND c.runNumber = r.base)
SELECT projectId, runNumber, type, sum(a)::BIGINT AS symbols, sum(a - b)::BIGINT AS delta FROM x GROUP BY 1, 2, 3""",
        "f4_project_totals": f"""
WITH f AS (SELECT projectId, count(*) n, sum(lineCount) l FROM files GROUP BY 1), r AS (SELECT projectId, count(*) n, count(*) FILTER (WHERE severity = 'critical') c FROM risks GROUP BY 1),
a AS (SELECT projectId, count(*) n, count(*) FILTER (WHERE {_USABLE}) u FROM analysis_runs GROUP BY 1)
SELECT p.id, p.name, coalesce(f.n, 0) AS files, coalesce(f.l, 0)::BIGINT AS lines, coalesce(r.n, 0) AS risks, coalesce(r.c, 0) AS critical, coalesce(a.n, 0) AS runs, coalesce(a.u, 0) AS usableRuns
FROM projects p LEFT JOIN f ON f.projectId = p.id LEFT JOIN r ON r.projectId = p.id LEFT JOIN a ON a.projectId = p.id""",
        "f5_warning_summary": f"""
WITH {_WARN}, m AS (SELECT projectId, code, message, min(ord) o FROM warnings WHERE message <> '' GROUP BY 1, 2, 3), p AS (SELECT projectId, code, filePath, min(ord) o FROM warnings WHERE filePath <> '' GROUP BY 1, 2, 3),
m2 AS (SELECT projectId, code, string_agg(message, ' | ' ORDER BY n) s FROM (SELECT *, row_number() OVER (PARTITION BY projectId, code ORDER BY o, message) n FROM m) WHERE n <= 3 GROUP BY 1, 2),
p2 AS (SELECT projectId, code, string_agg(filePath, ' | ' ORDER BY n) s FROM (SELECT *, row_number() OVER (PARTITION BY projectId, code ORDER BY o, filePath) n FROM p) WHERE n <= 50 GROUP BY 1, 2)
SELECT c.projectId, c.code, c.count, coalesce(m2.s, '') AS sampleMessages, coalesce(p2.s, '') AS sampleFiles FROM (SELECT projectId, code, count(*) AS count FROM warnings GROUP BY 1, 2) c LEFT JOIN m2 USING (projectId, code) LEFT JOIN p2 USING (projectId, code)""",
        "f8_risk_occurrences": f"WITH {_OCC} SELECT projectId, key, occurrenceCount, severity, r.riskType, r.title, r.description, r.sourceFile, r.lineNumber, r.recommendation, r.id AS firstId FROM occ",
        "f9_risk_groups": f"""
WITH {_OCC}, g AS (SELECT *, concat_ws('|', r.riskType, {_norm('r.title')}, {_norm('r.description')}, {_norm('r.recommendation')}) AS groupKey, coalesce(r.sourceFile, '') || ':' || coalesce(r.lineNumber::VARCHAR, '') AS location FROM occ),
t AS (SELECT projectId, groupKey, sum(occurrenceCount)::BIGINT AS occurrenceCount, max_by(severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS severity,
  min_by({{'riskType': r.riskType, 'title': r.title}}, {{'f': coalesce(r.sourceFile, ''), 'l': coalesce(r.lineNumber, 0), 'i': r.id}}) AS x, count(DISTINCT r.sourceFile) AS affectedFileCount FROM g GROUP BY 1, 2),
s AS (SELECT projectId, groupKey, string_agg(location, ', ' ORDER BY n) AS sampleLocations FROM (SELECT *, row_number() OVER (PARTITION BY projectId, groupKey ORDER BY f NULLS FIRST, l NULLS FIRST, location) n FROM (SELECT projectId, groupKey, location, min(r.sourceFile) f, min(r.lineNumber) l FROM g GROUP BY 1, 2, 3)) WHERE n <= 5 GROUP BY 1, 2)
SELECT projectId, groupKey, x.riskType, x.title, severity, occurrenceCount, affectedFileCount, sampleLocations FROM t JOIN s USING (projectId, groupKey)""",
        "f12_affected_files": """
WITH c AS (SELECT projectId, sourceFile, count(*) AS riskCount, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)::INT AS worst FROM risks WHERE sourceFile IS NOT NULL GROUP BY 1, 2)
SELECT projectId, sourceFile, riskCount, worst, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY projectId ORDER BY riskCount DESC, sourceFile) AS rank FROM c) WHERE rank <= 10""",
        "f15_risk_scores": """
SELECT projectId, sum(CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 20 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END)::BIGINT AS score, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM risks GROUP BY 1""",
        "f21_file_stats": f"SELECT projectId, {_EXT.replace('{0}', 'filePath')} AS extension, count(*) AS files, coalesce(sum(lineCount), 0)::BIGINT AS lines FROM files GROUP BY 1, 2",
        "f28_language_stats": f"WITH x AS (SELECT *, {_EXT.replace('{0}', 'filePath')} AS e FROM files) SELECT projectId, coalesce({_LANG.replace('{0}', 'e')}, 'other') AS language, count(*) AS files, coalesce(sum(lineCount), 0)::BIGINT AS lines FROM x GROUP BY 1, 2",
        "f27_next_run": "SELECT projectId, coalesce(max(runNumber), 0) + 1 AS nextRunNumber FROM analysis_runs GROUP BY 1",
        "g1_latest_runs": _LATEST.replace("{0}", "analysis_runs"),
        "g2_current_runs": _CURRENT,
        "h3_files_page": "SELECT id, projectId, filePath, fileName FROM files ORDER BY coalesce(filePath, '') COLLATE C, coalesce(fileName, '') COLLATE C, id LIMIT 40 OFFSET 80",
        "h6_top_risks": "SELECT id, projectId, severity, sourceFile, lineNumber, title FROM risks ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, coalesce(sourceFile, '') COLLATE C, coalesce(lineNumber, 0), coalesce(title, '') COLLATE C, id LIMIT 10",
        "j9_manifest": r"SELECT projectId, replace(filePath, '\', '/') AS path, max_by(sha256(content), id) AS hash FROM files WHERE content IS NOT NULL GROUP BY 1, 2",
        "j9_fingerprints": r"""
WITH m AS (SELECT projectId, replace(filePath, '\', '/') AS path, max_by(sha256(content), id) AS hash FROM files WHERE content IS NOT NULL GROUP BY 1, 2)
SELECT projectId, count(*) AS files, sha256(string_agg(path || ':' || hash, chr(10) ORDER BY encode(path))) AS fingerprint FROM m GROUP BY 1""",
        "m7_rate_limit": """
WITH RECURSIVE w AS (SELECT user_id, event_type, min(ts) AS s FROM events WHERE ts IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT n.user_id, n.event_type, n.s FROM (SELECT w.user_id, w.event_type, min(e.ts) AS s FROM w JOIN events e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.event_type IS NOT DISTINCT FROM w.event_type AND e.ts >= w.s + INTERVAL 1 HOUR GROUP BY 1, 2, w.s) n),
x AS (SELECT e.event_id, e.ts, e.user_id, e.event_type, max(w.s) AS s FROM events e JOIN w ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.event_type IS NOT DISTINCT FROM w.event_type AND w.s <= e.ts GROUP BY 1, 2, 3, 4)
SELECT event_id, ts, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type, s ORDER BY ts, event_id) <= 3 AS allowed, epoch_us(s) AS windowStart FROM x""",
        "k1_last_diff": f"WITH {_TWO} SELECT * FROM k1",
        "k3_diff_buckets": f"WITH {_TWO} SELECT projectId, change, count(*) AS total, least(count(*), 200) AS displayed, count(*) > 200 AS truncated FROM k1 GROUP BY 1, 2",
        "d1_owned_files": "SELECT f.id, f.projectId, f.filePath, f.status FROM files f JOIN projects p ON p.id = f.projectId WHERE p.userId = 2",
        "d9_critical_risks": f"""
WITH {_OCC} SELECT projectId, key, occurrenceCount, severity, r.id AS firstId FROM occ WHERE severity = 'critical'
  AND (contains({_norm('r.title')}, 'sql') OR contains({_norm('r.description')}, 'sql') OR contains({_norm('r.recommendation')}, 'sql') OR contains({_norm('r.sourceFile')}, 'sql') OR contains({_norm('r.riskType')}, 'sql'))""",
        "h4_risk_page": f"""
WITH {_OCC} SELECT projectId, severity, r.title, r.sourceFile, r.lineNumber, occurrenceCount FROM occ WHERE projectId = 1
ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, coalesce(r.title, '') COLLATE C, coalesce(r.sourceFile, '') COLLATE C, coalesce(r.lineNumber, 0), key COLLATE C LIMIT 20 OFFSET 40""",
        "h2_page_info": "SELECT count(*) AS total, ceil(count(*) / 100)::INT AS page, 100 AS pageSize, ceil(count(*) / 100)::INT AS pageCount FROM files",
        "e21_latest_jobs": "SELECT projectId, max(jobId) AS jobId, max_by(status, jobId) AS jobStatus FROM analysis_runs WHERE jobId IS NOT NULL GROUP BY 1",
        "a20_source_urls": r"""
SELECT id, sourceUrl, coalesce(starts_with(trim(sourceUrl), 'https://') AND NOT contains(trim(sourceUrl), '@') AND NOT contains(trim(sourceUrl), ' ')
  AND NOT regexp_matches(lower(split_part(split_part(substr(trim(sourceUrl), 9), '/', 1), ':', 1)), '^($|localhost$|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)'), FALSE) AS safe FROM projects""",
        "m2_claim": "SELECT id, projectId, runNumber % 5 AS attemptCount FROM analysis_runs WHERE status = 'failed' AND runNumber % 5 < 3 ORDER BY createdAt, id LIMIT 1",
        "m4_recovered": "SELECT id, projectId, CASE WHEN status <> 'failed' THEN 'completed' WHEN runNumber % 5 < 3 THEN 'queued' ELSE 'failed' END AS status, runNumber % 5 AS attemptCount FROM analysis_runs",
        "m4_orphans": "SELECT id, status FROM projects p WHERE status IN ('importing', 'analyzing') AND NOT EXISTS (SELECT 1 FROM analysis_runs r WHERE r.projectId = p.id AND r.status = 'failed')",
        "k3_comparable_runs": f"""
SELECT * FROM (SELECT projectId, lag(id) OVER w AS baseId, id AS compareId, lag(runNumber) OVER w AS baseRun, runNumber AS compareRun FROM analysis_runs WHERE {_USABLE} AND snapshotSchemaVersion = 1
  WINDOW w AS (PARTITION BY projectId ORDER BY runNumber, id)) WHERE baseId IS NOT NULL""",
        "k4_legacy_candidates": f"SELECT id, projectId FROM analysis_runs r WHERE {_USABLE} AND snapshotSchemaVersion IS NULL AND (SELECT count(*) FROM analysis_runs x WHERE x.projectId = r.projectId) = 1",
        "f30_import_summary": f"""
WITH {_WARN}, x AS (SELECT projectId, {_EXT.replace('{0}', 'filePath')} AS e FROM files), f AS (SELECT projectId, count(*) AS n, count(*) FILTER (WHERE {_LANG.replace('{0}', 'e')} IS NOT NULL) AS known FROM x GROUP BY 1),
i AS (SELECT projectId, count(*) AS n FROM warnings GROUP BY 1)
SELECT projectId, 'ANALYSIS_INPUT_SUMMARY' AS code, 'note' AS level, NULL::VARCHAR AS file, 'Analysis input: ' || f.n || ' files, ' || known || ' of supported languages, ' || coalesce(i.n, 0) || ' import warnings.' AS message, FALSE AS heuristic FROM f LEFT JOIN i USING (projectId)
UNION ALL SELECT DISTINCT projectId, code, 'warning', filePath, coalesce(message, ''), FALSE FROM warnings""",
        "k3_files": r"""
WITH f AS (SELECT *, replace(filePath, '\', '/') AS path FROM files), m AS (SELECT projectId, (epoch_us(min(createdAt)) + epoch_us(max(createdAt))) / 2 AS middle FROM files GROUP BY 1),
h AS (SELECT f.projectId, path, id, content, coalesce(epoch_us(createdAt) <= middle, TRUE) AS early, coalesce(epoch_us(createdAt) > middle, TRUE) AS late FROM f JOIN m USING (projectId) WHERE content IS NOT NULL),
b AS (SELECT projectId, path, max_by(sha256(content), id) AS hash FROM h WHERE early GROUP BY 1, 2), c AS (SELECT projectId, path, max_by(sha256(content), id) AS hash FROM h WHERE late GROUP BY 1, 2),
bk AS (SELECT projectId, lower(path) AS key, max_by({'h': hash, 'p': path}, {'h': hash, 'p': path}) AS v FROM b GROUP BY 1, 2), ck AS (SELECT projectId, lower(path) AS key, max_by({'h': hash, 'p': path}, {'h': hash, 'p': path}) AS v FROM c GROUP BY 1, 2)
SELECT projectId, key, CASE WHEN bk.v IS NULL THEN 'added' WHEN ck.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM bk FULL JOIN ck USING (projectId, key) WHERE bk.v IS NULL OR ck.v IS NULL OR bk.v IS DISTINCT FROM ck.v""",
        "k3_symbol_buckets": f"""
WITH {_TWO} SELECT projectId, change AS bucket, count(*) AS total, least(count(*), 200) AS displayed, count(*) > 200 AS truncated, min(stableKey COLLATE C) AS first,
  list_sort(list(stableKey))[least(count(*), 200)] AS last FROM k1 WHERE change <> 'changed' GROUP BY 1, 2""",
        "k5_runs": f"""
WITH l AS ({_LATEST.replace('{0}', 'analysis_runs')}) SELECT r.id, r.projectId, r.runNumber, r.status, r.analyzerVersion, r.sourceFingerprint, l.runId IS NOT NULL AS isLatestUsable FROM analysis_runs r LEFT JOIN l ON l.runId = r.id""",
    }
