"""All relations of an analysis over one ``files`` table, each made once and written to the shared folder when several use it."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.functions import text as T
from codestrata.operators import build as B
from codestrata.operators import derive as D
from codestrata.operators import extract as X
from codestrata.operators import history as H
from codestrata.operators import lists as L
from codestrata.operators import resolve as R
from codestrata.operators import risks as K
from codestrata.operators import traces as G
from codestrata.session import checkpointed


_GENERATORS = {**X.GENERATORS, "records": X.Generator(B.RECORD, B.EXTENSIONS, B.record_rows)}


class Analysis:
    """``files(projectId, id, filePath, content)`` → symbols, edges, fields, risks, rules, events, bindings, findings, traces, metrics.

    Null contents give files without rows; an empty table gives empty relations of the same schema.
    """

    def __init__(self, files: DataFrame):
        self.files = files

    @cached_property
    def _rows(self) -> DataFrame:
        """What is read out of the texts, in one pass, written once."""
        return checkpointed(X.tagged(self.files, _GENERATORS))

    def extracted(self, name: str) -> DataFrame:
        return X.relation(self._rows, name, _GENERATORS[name])

    @cached_property
    def symbols(self) -> DataFrame:
        return self.extracted("symbols")

    @cached_property
    def events(self) -> DataFrame:
        return self.extracted("events")

    @cached_property
    def edges(self) -> DataFrame:
        return checkpointed(R.project_edges(*[self.extracted(n) for n in ("calls", "execs", "imports", "events")], self.symbols))

    @cached_property
    def statements(self) -> DataFrame:
        return self.extracted("statements")

    @cached_property
    def references(self) -> DataFrame:
        return checkpointed(R.with_owner(self.extracted("references"), self.symbols))

    @cached_property
    def columns(self) -> DataFrame:
        return self.extracted("columns")

    @cached_property
    def evidence(self) -> DataFrame:
        return R.with_fields(R.with_owner(R.sql_evidence(self.statements), self.symbols), self.references)

    @cached_property
    def handlers(self) -> DataFrame:
        return checkpointed(R.event_handlers(self.events, self.symbols))

    @cached_property
    def bindings(self) -> DataFrame:
        return checkpointed(R.data_bindings(self.extracted("objects")))

    @cached_property
    def risks(self) -> DataFrame:
        return checkpointed(K.project_risks(self.files, R.missing_where(self.statements), R.multiple_writes(self.references)))

    @cached_property
    def rules(self) -> DataFrame:
        return checkpointed(D.rules(self.references, self.risks.where(F.col("category") == "magic_value"), self.risks.where(F.col("category") == "format_conversion")))

    @cached_property
    def warnings(self) -> DataFrame:
        return checkpointed(D.project_warnings(D.file_warnings(self.files), self.extracted("forms"), self.handlers, self.bindings))

    @cached_property
    def findings(self) -> DataFrame:
        return checkpointed(B.build_findings(self.extracted("records")))

    @cached_property
    def traces(self) -> DataFrame:
        return checkpointed(G.flow_traces(self.handlers, self.bindings, self.edges, self.evidence, self.symbols))

    @cached_property
    def metrics(self) -> DataFrame:
        """The 13 metrics of every project that has files."""
        lang = P.language(F.col("filePath"))
        f = self.files.groupBy("projectId").agg(F.count("*").alias("fileCount"), F.count_if(lang.isNotNull()).alias("eligibleFileCount"), F.count_if(lang.isNotNull() & F.col("content").isNotNull()).alias("analyzedFileCount"))
        f = f.withColumn("skippedFileCount", F.col("fileCount") - F.col("analyzedFileCount"))
        n = lambda df, name: df.groupBy("projectId").agg(F.count("*").alias(name))
        w = self.warnings.groupBy("projectId").agg(F.count("*").alias("warningCount"), F.count_distinct(F.when(F.col("level") != "note", F.col("file"))).alias("degradedFileCount"), F.count_distinct(F.when(F.col("heuristic"), F.col("file"))).alias("heuristicFileCount"))
        identity = lambda df: df.select("projectId", T.field_identity(F.col("tableName"), F.col("field")).alias("k"))
        fields = identity(self.references).unionByName(identity(self.columns)).distinct()
        parts = [n(self.symbols, "symbolCount"), n(self.edges, "dependencyCount"), n(fields, "fieldCount"), n(self.references, "fieldDependencyCount"), n(self.risks, "riskCount"), n(self.rules, "ruleCount"), w]
        out = reduce(lambda a, b: a.join(b, "projectId", "left"), parts, f).na.fill(0)
        return out.select("projectId", *[F.col(m).cast("long").alias(m) for m in H.METRICS])

    @cached_property
    def status(self) -> DataFrame:
        """``(projectId, status)`` of the run: failed, partial, completed_with_warnings or completed, in this order."""
        m = self.metrics
        told = self.warnings.where(F.col("level") != "note").select("projectId").distinct().withColumn("told", F.lit(True))
        m = m.join(told, "projectId", "left")
        failed = (F.col("eligibleFileCount") == 0) | (F.col("analyzedFileCount") == 0)
        status = D.run_status(failed, F.col("analyzedFileCount"), F.col("skippedFileCount") + F.col("degradedFileCount"), F.coalesce("told", F.lit(False)).cast("int"))
        return m.select("projectId", status.alias("status"))

    def sections(self) -> DataFrame:
        """The rows of all sections of a snapshot, keyed for comparison."""
        manifest = L.source_manifest(self.files)
        fields = self.references.select("projectId", "tableName", "field").unionByName(self.columns.select("projectId", "tableName", "field"))
        of = {
            "files": manifest, "symbols": self.symbols, "dependencies": self.edges, "fields": fields.distinct(),
            "fieldDependencies": self.references.select("projectId", "file", "line", "tableName", "field", "access", "ownerKey", "ownerName"), "risks": self.risks,
            "rules": self.rules, "delphiEvents": self.handlers, "dataBindings": self.bindings, "buildDoctor": self.findings, "flowTraces": self.traces,
        }
        order = {"symbols": ("file", "startLine"), "fieldDependencies": ("file", "line"), "risks": ("line",), "delphiEvents": ("file", "line"), "dataBindings": ("file", "line")}
        return reduce(DataFrame.unionByName, [H.section_rows(s, df, order.get(s, ())) for s, df in of.items()])
