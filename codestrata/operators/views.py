"""Composite lists and summaries behind the reading interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.functions import text as T
from codestrata.operators.lists import any_of, filtered


def latest_symbols(snapshots: DataFrame) -> DataFrame:
    """Symbols of the newest run of every project, the last row of a key."""
    newest = snapshots.groupBy("projectId").agg(F.max("runNumber").alias("runNumber"))
    rows = snapshots.join(newest, ["projectId", "runNumber"], "left_semi")
    cols = [c for c in rows.columns if c not in ("projectId", "runNumber", "stableKey", "rowId")]
    best = rows.groupBy("projectId", "runNumber", "stableKey").agg(F.max_by(F.struct(*cols), "rowId").alias("v"))
    return best.select("projectId", "runNumber", "stableKey", "v.*")


def symbol_list(symbols: DataFrame, kind: str | None = None, search: str = "") -> DataFrame:
    """Symbols by kind and search term over name, qualified name and file."""
    return filtered(symbols, {"type": kind}, search, ["name", "qualifiedName", "file"])


def dependency_list(edges: DataFrame, symbols: DataFrame, hide_standard: bool = True) -> DataFrame:
    """Edges with the names and kinds of both ends; standard-library targets are hidden by default."""
    s = symbols.select("projectId", "stableKey", F.coalesce("qualifiedName", "name").alias("n"), F.col("type").alias("t"))
    e = edges.join(s.toDF("projectId", "fromKey", "sourceName", "sourceType"), ["projectId", "fromKey"], "left").join(s.toDF("projectId", "toKey", "targetName", "targetType"), ["projectId", "toKey"], "left")
    e = e.withColumn("sourceName", F.coalesce("sourceName", F.concat(F.lit("symbol:"), "fromKey"))).withColumn("targetName", F.coalesce("targetName", "toName"))
    e = e.withColumn("targetKind", F.when(F.col("toKey").isNotNull(), "internal").otherwise("external"))
    if hide_standard:
        e = e.where(~((F.col("targetKind") == "external") & T.is_standard_unit(F.col("targetName"))))
    return e.select("projectId", "file", "line", "type", "sourceName", "sourceType", "targetName", "targetType", "targetKind")


def field_dimension(references: DataFrame, columns: DataFrame) -> DataFrame:
    """Distinct fields of references and table definitions: display from the first place, definitions before
    references; type from the last definition."""
    of = lambda df, n, typ: df.select("projectId", T.field_identity(F.col("tableName"), F.col("field")).alias("k"), F.struct(F.lit(n).alias("src"), "file", "line", "tableName", "field").alias("at"), typ.alias("fieldType"))
    both = of(columns, 0, F.col("fieldType")).unionByName(of(references, 1, F.lit(None).cast("string")))
    g = both.groupBy("projectId", "k").agg(F.min("at").alias("a"), F.max_by("fieldType", F.when(F.col("at.src") == 0, F.struct("at.file", "at.line"))).alias("fieldType"))
    return g.select("projectId", "k.schema", "k.table", F.col("k.field").alias("fieldKey"), F.col("a.tableName").alias("tableName"), F.col("a.field").alias("field"), "fieldType")


def file_counters(files: DataFrame, symbols: DataFrame, edges: DataFrame, risks: DataFrame, warnings: DataFrame) -> DataFrame:
    """Symbols, outgoing edges, risks and warnings of every file, each side aggregated before the join; ``limited`` files have a warning that is no note."""
    f = files.groupBy("projectId", F.regexp_replace("filePath", r"\\", "/").alias("file")).agg(F.max("lineCount").alias("lines"))
    n = lambda df, name: df.groupBy("projectId", "file").agg(F.count("*").alias(name))
    w = warnings.where(F.col("file").isNotNull()).groupBy("projectId", "file").agg(F.count("*").alias("warnings"), F.max(F.col("level") != "note").alias("limited"))
    out = f
    for side in (n(symbols, "symbols"), n(edges, "edges"), n(risks, "risks"), w):
        out = out.join(side, ["projectId", "file"], "left")
    return out.na.fill(0, ["symbols", "edges", "risks", "warnings"]).na.fill(False, ["limited"])


def top_tables(evidence: DataFrame, top: int = 20) -> DataFrame:
    """The tables most statements name, per project (a top-k report)."""
    t = evidence.where(F.col("tables") != "").select("projectId", F.explode(F.split("tables", ",")).alias("table"), "access")
    g = t.groupBy("projectId", "table").agg(F.count("*").alias("statements"), F.count_if(F.col("access") == "write").alias("writes"))
    n = F.row_number().over(W.partitionBy("projectId").orderBy(F.desc("statements"), "table"))
    return g.withColumn("rank", n).where(F.col("rank") <= top)


def run_metric_deltas(snapshots: DataFrame) -> DataFrame:
    """Distinct symbols of every run and kind, and the difference to the run before (0 where a kind is missing)."""
    c = snapshots.groupBy("projectId", "runNumber", "type").agg(F.count_distinct("stableKey").alias("symbols"))
    runs = snapshots.select("projectId", "runNumber").distinct()
    runs = runs.withColumn("base", F.lag("runNumber").over(W.partitionBy("projectId").orderBy("runNumber"))).where("base IS NOT NULL")
    now = runs.join(c, ["projectId", "runNumber"]).select("projectId", "runNumber", "type", F.col("symbols").alias("now"), F.lit(0).alias("before"))
    before = runs.join(c.withColumnRenamed("runNumber", "base"), ["projectId", "base"]).select("projectId", "runNumber", "type", F.lit(0).alias("now"), F.col("symbols").alias("before"))
    g = now.unionByName(before).groupBy("projectId", "runNumber", "type").agg(F.sum("now").alias("symbols"), F.sum("before").alias("before"))
    return g.select("projectId", "runNumber", "type", "symbols", (F.col("symbols") - F.col("before")).alias("delta"))


# How rules are shown.
RULE_TITLES = {"calculation": "計算欄位需可重現", "magic_value": "商業常數應抽離管理", "format": "格式轉換規則需一致"}
RULE_ADVICE = {"format": "確認轉換格式、精度、時區與目標系統規則一致。", "magic_value": "將商業常數抽成命名常數、設定檔或對照表。", "calculation": "補上計算來源、公式與回歸測試。"}
OWNER_TITLE = " 欄位有多處寫入來源"
OWNER_DESCRIPTION, OWNER_ADVICE = "同一組欄位偵測到多處寫入來源，建議確認單一寫入責任與驗證邏輯。", "整併寫入入口，或補上明確的 ownership 與資料一致性驗證。"


def shown_rules(rules: DataFrame) -> DataFrame:
    """Rules with the title, description and advice that lists show; members of a family share a name but for its last part."""
    owner = F.lower("name").contains("single_owner")
    name = F.regexp_replace(F.regexp_replace("name", "(?i)^validate_", ""), "(?i)_single_owner$", "")
    parts = F.filter(F.split(name, "_"), lambda x: x != "")
    family = F.when(F.size(parts) >= 3, F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "_"), F.lit(".*"))).when(name != "", name).otherwise(F.col("name"))
    of = lambda table, other: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("ruleType")], other)
    title = F.when(owner, F.concat(family, F.lit(OWNER_TITLE))).otherwise(of(RULE_TITLES, F.regexp_replace("name", "_", " ")))
    description = F.when(owner, F.lit(OWNER_DESCRIPTION)).otherwise(F.coalesce("description", "condition"))
    advice = F.when(owner, F.lit(OWNER_ADVICE)).otherwise(of(RULE_ADVICE, F.lit(None).cast("string")))
    return rules.select("projectId", "ruleType", "name", title.alias("title"), description.alias("description"), advice.alias("recommendation"), F.col("file").alias("sourceFile"), F.col("line").alias("lineNumber"))


def rule_occurrences(rules: DataFrame) -> DataFrame:
    """Rules that are shown alike at one place, with the number of them."""
    r = shown_rules(rules)
    key = [F.col("ruleType"), *[T.normalized_text(F.col(c)) for c in ("title", "description", "sourceFile")], F.coalesce(F.col("lineNumber").cast("string"), F.lit(""))]
    g = r.groupBy("projectId", F.concat_ws("|", *key).alias("key")).agg(F.count("*").alias("occurrenceCount"), F.min(F.struct("sourceFile", "lineNumber", "ruleType", "title", "description", "recommendation")).alias("r"))
    return g.select("projectId", "key", "occurrenceCount", "r.ruleType", "r.title", "r.description", "r.recommendation", "r.sourceFile", "r.lineNumber")


def rule_groups(rules: DataFrame, *, rule_type: str | None = None, search: str = "", file: str = "", samples: int = 5) -> DataFrame:
    """Occurrences by type and title with sums, files and first locations, after filters by type, file and text."""
    o = rule_occurrences(rules)
    if rule_type:
        o = o.where(F.col("ruleType") == rule_type)
    if file.strip():
        o = o.where(F.contains(T.normalized_text(F.col("sourceFile")), T.normalized_text(F.lit(file))))
    if search.strip():
        o = o.where(normalized_search(["title", "description", "recommendation", "sourceFile", "ruleType"], search))
    keys = ["projectId", "groupKey"]
    o = o.withColumn("groupKey", F.concat_ws("|", "ruleType", T.normalized_text(F.col("title")))).withColumn("location", F.concat_ws(":", F.coalesce("sourceFile", F.lit("")), F.coalesce(F.col("lineNumber").cast("string"), F.lit(""))))
    sums = o.groupBy(*keys).agg(F.sum("occurrenceCount").alias("occurrenceCount"), F.count_distinct("sourceFile").alias("affectedFileCount"), F.min(F.struct("sourceFile", "lineNumber", "ruleType", "title")).alias("r"))
    places = o.groupBy(*keys, "location").agg(F.min("sourceFile").alias("f"), F.min("lineNumber").alias("l"))
    first = places.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("f").asc_nulls_first(), F.col("l").asc_nulls_first(), "location"))).where(F.col("n") <= samples)
    first = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "location"))), lambda x: x["location"]), ", ").alias("sampleLocations"))
    return sums.join(first, keys).select(*keys, "r.ruleType", "r.title", "occurrenceCount", "affectedFileCount", "sampleLocations")


def normalized_search(columns: list[str], term: str) -> Column:
    """Whether a column holds the term when both are normalised as for grouping; null matches nothing."""
    t = T.normalized_text(F.lit(term))
    return any_of([F.contains(T.normalized_text(F.col(c)), t) for c in columns])


def entry_points(symbols: DataFrame, fallback: int = 8) -> DataFrame:
    """Symbols named main, serve or handler; in projects without one the first ``fallback`` symbols."""
    s = symbols.withColumn("entry", F.lower("name").isin("main", "serve", "handler"))
    named = s.where("entry").select("projectId").distinct()
    order = W.partitionBy("projectId").orderBy("file", "ord")
    first = s.join(named, "projectId", "left_anti").withColumn("n", F.row_number().over(order)).where(F.col("n") <= fallback).drop("n")
    return s.where("entry").unionByName(first).drop("entry")
