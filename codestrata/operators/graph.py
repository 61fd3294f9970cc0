"""Impact of a change: what a symbol, file, table, field, risk or rule touches."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.functions import text as T
from codestrata.session import checkpointed

# What a target may be, in the order in which a name is tried.
TARGETS = ("sql_field", "symbol", "file", "sql_table", "risk", "rule")
#: What an impact lists; chains are not counted.
KINDS = ("file", "symbol", "table", "field", "rule", "risk")


def touching(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges with an end in ``keys(projectId, key)``: two semi-joins united, never a join with OR."""
    k = keys.select("projectId", "key").distinct()
    a = edges.join(k.withColumnRenamed("key", "fromKey"), ["projectId", "fromKey"], "left_semi").select(*edges.columns)
    b = edges.join(k.withColumnRenamed("key", "toKey"), ["projectId", "toKey"], "left_semi").select(*edges.columns)
    return a.unionByName(b).distinct()


def name_parts(name: str) -> list[str]:
    """Parts of a dotted name in lower case, without quotes; dots inside quotes do not split."""
    return [p.strip("[]`\" ").strip().lower() for p in re.findall(r"\[[^\]]*\]|\"(?:\"\"|[^\"])*\"|`(?:``|[^`])*`|[^.\[\]\"`]+", name) if p.strip()]


def _norm(c: Column) -> Column:
    return F.lower(T.trimmed(F.coalesce(c, F.lit(""))))


def _path(c: Column) -> Column:
    return _norm(F.regexp_replace(c, r"\\", "/"))


def field_index(references: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """``(projectId, tableName, field, k)``: the fields a project knows, each spelling once, with its identity."""
    f = references.select("projectId", "tableName", "field")
    if columns is not None:
        f = f.unionByName(columns.select("projectId", "tableName", "field"))
    return f.where(F.col("field").isNotNull()).distinct().withColumn("k", T.field_identity(F.col("tableName"), F.col("field")))


def matching_fields(fields: DataFrame, target: str) -> DataFrame:
    """Fields a ``table.field`` names; a schema counts only where the target has one (``dbo`` counts as none)."""
    parts = name_parts(target)
    if len(parts) < 2:
        return fields.where(F.lit(False))
    found = (F.col("k.field") == parts[-1]) & (F.col("k.table") == parts[-2])
    return fields.where(found & _schema(parts[-3]) if len(parts) > 2 else found)


def _schema(name: str) -> Column:
    return F.col("k.schema").eqNullSafe(F.lit(None if name in ("dbo", "") else name))


def matching_tables(fields: DataFrame, target: str) -> DataFrame:
    """Fields of the table that the target names."""
    parts = name_parts(target)
    if not parts:
        return fields.where(F.lit(False))
    found = F.col("k.table") == parts[-1]
    return fields.where(found & _schema(parts[-2]) if len(parts) > 1 else found)


def matching_symbols(symbols: DataFrame, target: str) -> DataFrame:
    """Symbols whose full name or last dotted part is the target, letter case and outer blanks aside."""
    t = target.strip().lower()
    name = F.lower(F.trim(F.coalesce("qualifiedName", "name")))
    return symbols.where((name == t) | (F.substring_index(name, ".", -1) == t) | (F.lower(F.trim("name")) == t))


def matching_files(files: DataFrame, target: str) -> DataFrame:
    t = target.strip().lower()
    return files.where((_path(F.col("filePath")) == t.replace("\\", "/")) | (F.substring_index(_path(F.col("filePath")), "/", -1) == t))


def matching_rules(rules: DataFrame, target: str) -> DataFrame:
    """Rules whose name, description or condition is the target."""
    t = target.strip().lower()
    return rules.where(reduce(lambda a, b: a | b, [_norm(F.col(c)) == t for c in ("name", "description", "condition")]))


def matching_risks(risks: DataFrame, target: str) -> DataFrame:
    return risks.where(_norm(F.col("title")) == target.strip().lower())


def near_symbols(places: DataFrame, symbols: DataFrame, fall_back: bool) -> DataFrame:
    """Symbols around ``(projectId, file, line, id)``: those over the line; all of the file without a line.

    With ``fall_back`` a place that no symbol covers has all symbols of its file too.
    """
    j = places.select("projectId", "file", "line", "id").join(symbols, ["projectId", "file"])
    hit = F.coalesce(F.col("line").between(F.col("startLine"), F.col("endLine")), F.lit(True))
    if not fall_back:
        return j.where(hit)
    j = j.withColumn("_hit", hit).withColumn("_any", F.max("_hit").over(W.partitionBy("projectId", "file", "id")))
    return j.where(F.col("_hit") | ~F.col("_any")).drop("_hit", "_any")


class Impact:
    """Relations of projects, and what a target touches in each of them.

    symbols ``(projectId, stableKey, name, qualifiedName, type, file, startLine, endLine)``, files ``(projectId,
    filePath)``, edges, references with owners, columns, risks ``(projectId, title, sourceFile, lineNumber)``,
    rules ``(projectId, name, description, condition, file, line)``. Null and absent values match nothing;
    a target that a project does not know gives it no rows.
    """

    def __init__(self, symbols: DataFrame, files: DataFrame, edges: DataFrame, references: DataFrame, risks: DataFrame, rules: DataFrame, columns: DataFrame | None = None):
        self.symbols = symbols.withColumn("shown", F.coalesce("qualifiedName", "name"))
        self.files = files.select("projectId", F.regexp_replace("filePath", r"\\", "/").alias("filePath")).where(F.col("filePath").isNotNull()).distinct()
        self.edges, self.references, self.rules = edges, references, rules
        self.risks = risks.withColumn("file", F.regexp_replace("sourceFile", r"\\", "/"))
        self.fields = field_index(references, columns)

    def resolved(self, target: str, kind: str = "auto") -> DataFrame:
        """``(projectId, targetType)``: what the target is in each project, the first kind in order that it names."""
        found = {
            "sql_field": matching_fields(self.fields, target), "symbol": matching_symbols(self.symbols, target), "file": matching_files(self.files, target),
            "sql_table": matching_tables(self.fields, target), "risk": matching_risks(self.risks, target), "rule": matching_rules(self.rules, target),
        }
        kinds = TARGETS if kind == "auto" else (kind,)
        hits = reduce(DataFrame.unionByName, [found[k].select("projectId", F.lit(TARGETS.index(k)).alias("k")) for k in kinds])
        first = hits.groupBy("projectId").agg(F.min("k").alias("k"))
        return first.select("projectId", F.element_at(F.array(*[F.lit(t) for t in TARGETS]), F.col("k") + 1).alias("targetType"))

    def _of(self, df: DataFrame, resolved: DataFrame, *kinds: str) -> DataFrame:
        return df.join(resolved.where(F.col("targetType").isin(*kinds)).select("projectId"), "projectId", "left_semi")

    @staticmethod
    def _items(df: DataFrame, kind: str, item: Column, detail: Column | None = None) -> DataFrame:
        return df.select("projectId", F.lit(kind).alias("kind"), item.alias("item"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))

    def _symbol_items(self, s: DataFrame) -> list[DataFrame]:
        return [self._items(s, "symbol", F.col("shown"), F.concat_ws(" ", "type", "file")), self._items(s, "file", F.col("file"))]

    def _chains(self, s: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges with an end in the symbols, and the symbols at both ends."""
        e = touching(self.edges, s.select("projectId", F.col("stableKey").alias("key")))
        ends = e.select("projectId", F.explode(F.array("fromKey", "toKey")).alias("stableKey")).where(F.col("stableKey").isNotNull()).distinct()
        return e, self.symbols.join(ends, ["projectId", "stableKey"], "left_semi")

    def _chain_items(self, e: DataFrame) -> DataFrame:
        return self._items(e, "chain", F.concat_ws(" -> ", "fromName", F.coalesce("toName", F.lit("unresolved"))))

    def _by_file(self, df: DataFrame, file: Column, paths: DataFrame) -> DataFrame:
        """Rows whose file is one of ``paths(projectId, file)``, letter case and outer blanks aside; ``hit`` is that path."""
        p = paths.groupBy("projectId", _path(F.col("file")).alias("_f")).agg(F.min("file").alias("hit"))
        return df.withColumn("_f", _path(file)).join(p, ["projectId", "_f"]).drop("_f")

    def rows(self, target: str, kind: str = "auto") -> DataFrame:
        """``(projectId, targetType, kind, item, detail)``: everything touched, each once; chains with repetition.

        Which of the six kinds the target is in any project is asked first, so that the plan holds only those.
        """
        resolved = checkpointed(self.resolved(target, kind))
        kinds = {r["targetType"] for r in resolved.select("targetType").distinct().collect()}  # six at most
        makers = {"symbol": self._of_symbol, "file": self._of_file, "sql_field": self._of_field, "sql_table": self._of_field, "risk": self._of_risk, "rule": self._of_rule}
        parts = [x for k in TARGETS if k in kinds for x in makers[k](target, k, resolved)]
        if not parts:
            return resolved.select("projectId", "targetType", *[F.lit(None).cast("string").alias(c) for c in ("kind", "item", "detail")]).where(F.lit(False))
        every = reduce(DataFrame.unionByName, parts).where(F.col("item").isNotNull())
        once = every.where(F.col("kind") != "chain").distinct().unionByName(every.where(F.col("kind") == "chain"))
        return once.join(resolved, "projectId").select("projectId", "targetType", "kind", "item", "detail")

    def _of_symbol(self, target: str, kind: str, resolved: DataFrame) -> list[DataFrame]:
        hit = self._of(matching_symbols(self.symbols, target), resolved, kind)
        e, ends = self._chains(hit)
        used = self.references.join(hit.select("projectId", F.col("stableKey").alias("ownerKey"), "shown"), ["projectId", "ownerKey"])
        field = F.concat_ws(".", "tableName", "field")
        return [
            *self._symbol_items(hit), *self._symbol_items(ends), self._chain_items(e),
            self._items(used, "table", F.col("tableName")), self._items(used, "field", field), self._items(used, "chain", F.concat(F.col("shown"), F.lit(" -> "), field)),
            self._items(self._by_file(self.rules, F.col("file"), hit), "rule", F.col("name")), self._items(self._by_file(self.risks, F.col("file"), hit), "risk", F.col("title")),
        ]

    def _of_file(self, target: str, kind: str, resolved: DataFrame) -> list[DataFrame]:
        at = self._of(matching_files(self.files, target), resolved, kind).withColumnRenamed("filePath", "file")
        inside = self.symbols.join(at, ["projectId", "file"], "left_semi")
        e, ends = self._chains(inside)
        rules, risks = self._by_file(self.rules, F.col("file"), at), self._by_file(self.risks, F.col("file"), at)
        base = F.substring_index("hit", "/", -1)
        return [
            self._items(at, "file", F.col("file")), *self._symbol_items(inside), *self._symbol_items(ends), self._chain_items(e), self._items(rules, "rule", F.col("name")), self._items(risks, "risk", F.col("title")),
            self._items(rules, "chain", F.concat(base, F.lit(" -> "), F.col("name"))), self._items(risks, "chain", F.concat(base, F.lit(" -> "), F.col("title"))),
        ]

    def _of_field(self, target: str, kind: str, resolved: DataFrame) -> list[DataFrame]:
        fields = self._of((matching_fields if kind == "sql_field" else matching_tables)(self.fields, target), resolved, kind)
        used = self.references.join(fields.select("projectId", "tableName", "field"), ["projectId", "tableName", "field"], "left_semi").where(F.col("ownerKey").isNotNull())
        users = self.symbols.join(used.select("projectId", F.col("ownerKey").alias("stableKey"), "tableName", "field"), ["projectId", "stableKey"])
        field = F.concat_ws(".", "tableName", "field")
        return [
            self._items(fields, "table", F.col("tableName")), self._items(fields, "field", field), *self._symbol_items(users), self._items(users, "chain", F.concat(F.col("shown"), F.lit(" -> "), field)),
            self._items(self._rules_naming(fields), "rule", F.col("name")),
        ]

    def _of_risk(self, target: str, kind: str, resolved: DataFrame) -> list[DataFrame]:
        hit = self._of(matching_risks(self.risks, target), resolved, kind)
        over = near_symbols(hit.select("projectId", "file", F.col("lineNumber").alias("line"), F.col("title").alias("id")), self.symbols, False)
        return [self._items(hit, "risk", F.col("title")), self._items(hit, "file", F.col("file")), *self._symbol_items(over)]

    def _of_rule(self, target: str, kind: str, resolved: DataFrame) -> list[DataFrame]:
        hit = self._of(matching_rules(self.rules, target), resolved, kind)
        near = near_symbols(hit.select("projectId", "file", "line", F.col("name").alias("id")), self.symbols, True)
        e, _ = self._chains(near)
        return [
            self._items(hit, "rule", F.col("name")), self._items(hit, "file", F.col("file")), *self._symbol_items(near), self._chain_items(e),
            self._items(self._by_file(self.risks, F.col("file"), hit), "risk", F.col("title")),
        ]

    def _rules_naming(self, fields: DataFrame) -> DataFrame:
        """Rules whose text holds a field's key. The keys of a project are those of one table at most, so they fit in one row."""
        keys = F.array(F.concat_ws(".", F.coalesce("k.table", F.lit("")), "k.field"), F.lower(F.concat_ws(".", "tableName", "field")))
        of = fields.groupBy("projectId").agg(F.array_distinct(F.flatten(F.collect_set(keys))).alias("keys"))
        text = F.concat_ws(" ", *[_norm(F.col(c)) for c in ("name", "description", "condition", "file")])
        return self.rules.join(of, "projectId").where(F.exists("keys", lambda k: F.contains(text, k)))

    def results(self, target: str, kind: str = "auto") -> DataFrame:
        """One row a project that knows the target: its kind, how much is touched and the sorted lists."""
        r = self.rows(target, kind)
        lists = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.concat_ws(" | ", "item", "detail")))).alias(f"{k}s") for k in KINDS]
        g = r.groupBy("projectId", "targetType").agg(*lists, F.array_sort(F.collect_list(F.when(F.col("kind") == "chain", F.col("item")))).alias("chains"))
        count = reduce(lambda a, b: a + b, [F.size(f"{k}s") for k in KINDS])
        g = g.withColumn("affectedCount", count).withColumn("confidence", F.lit(1))
        said = F.concat(F.lit(f"Modifying {target} ("), F.col("targetType"), F.lit(") affects "), F.col("affectedCount").cast("string"), F.lit(" scoped items inside project "), F.col("projectId").cast("string"), F.lit("."))
        return g.withColumn("summary", F.when(F.col("affectedCount") > 0, said).otherwise(F.concat(F.lit(f"No additional impacts were found for {target} inside project "), F.col("projectId").cast("string"), F.lit("."))))
