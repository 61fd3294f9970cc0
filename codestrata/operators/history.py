"""Run history: what differs between two runs of a project in every section of its snapshot, as rows and as a document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Items listed in a bucket, the longest snapshot, its version, and the metrics of a run.
BUCKET, MAX_SNAPSHOT, VERSION = 200, 15 * 1024**2, 1
METRICS = (
    "fileCount", "eligibleFileCount", "analyzedFileCount", "skippedFileCount", "heuristicFileCount", "degradedFileCount", "symbolCount",
    "dependencyCount", "fieldCount", "fieldDependencyCount", "riskCount", "ruleCount", "warningCount",
)
# What the changes of a section are called; symbols and dependencies have no changed ones.
SECTIONS: dict[str, dict[str, str]] = {
    "files": {"added": "added", "removed": "removed", "changed": "changed"},
    "symbols": {"added": "added", "removed": "removed"},
    "dependencies": {"added": "added", "removed": "removed"},
    "fields": {"added": "added", "removed": "removed", "changed": "changed"},
    "fieldDependencies": {"added": "introduced", "removed": "removed", "changed": "changed"},
    "risks": {"added": "introduced", "removed": "resolved", "changed": "changed"},
    "rules": {"added": "introduced", "removed": "resolved", "changed": "changed"},
    "delphiEvents": {"added": "introduced", "removed": "removed", "changed": "resolutionChanged"},
    "dataBindings": {"added": "introduced", "removed": "removed", "changed": "changed"},
    "buildDoctor": {"added": "introduced", "removed": "resolved", "changed": "changed"},
    "flowTraces": {"added": "introduced", "removed": "removed", "changed": "changed"},
}


def _n(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))


def _p(name: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"\\", "/")


def _k(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def keys() -> dict[str, Column]:
    """The key of an item in each section."""
    low = lambda c: F.lower(c)
    return {
        "files": low(_p("path")),
        "symbols": F.col("stableKey"),
        "dependencies": _k(F.col("fromKey"), F.coalesce("toKey", "toName"), F.col("type"), F.col("line").cast("string")),
        "fields": _k(_n("tableName"), _n("field")),
        "fieldDependencies": _k(_n("tableName"), _n("field"), F.coalesce(_n_or_null("ownerKey"), _n_or_null("ownerName"), F.lit("unknown")), _n("access"), low(_p("file"))),
        "risks": _k(F.col("category"), low("title"), low(_p("file"))),
        "rules": _k(F.col("ruleType"), low("name"), low(_p("file"))),
        "delphiEvents": _k(_n("formName"), _n("component"), _n("event")),
        "dataBindings": _k(_n("formName"), _n("component"), _n("dataField"), _n("dataSet")),
        "buildDoctor": _k(F.col("code"), F.lower(F.col("code")), _p("file"), F.coalesce(F.col("line").cast("string"), F.lit("0")), _n("evidence")),
        "flowTraces": F.col("stableKey"),
    }


def _n_or_null(name: str) -> Column:
    return F.lower(F.trim(F.col(name)))


def stable_json(columns: Sequence[str]) -> Column:
    """One text for equal values: keys in order, nulls left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def section_rows(section: str, items: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """``(projectId, section, key, item, place)`` of one run; ``item`` is the stable JSON, ``place`` decides among repeated keys (the last holds)."""
    values = [c for c in items.columns if c not in ("projectId", "fileId", "ord")]
    place = F.struct(*[F.col(c).cast("string") for c in (order or ())], stable_json(values)) if order else F.struct(stable_json(values))
    return items.select("projectId", F.lit(section).alias("section"), F.coalesce(keys()[section], F.lit("")).alias("key"), stable_json(values).alias("item"), F.to_json(place).alias("place"))


def diff_sections(base: DataFrame, compare: DataFrame) -> DataFrame:
    """``(projectId, section, key, change, before, after)`` between two sets of :func:`section_rows`.

    All sections in one tagged union and one aggregate, which combines before the exchange; keys, not
    sections or projects, spread the rows. Items travel as hashes until they are known to differ: equal ones
    are dropped after the aggregate.
    """
    both = base.withColumn("now", F.lit(False)).unionByName(compare.withColumn("now", F.lit(True)))
    last = lambda now: F.max_by(F.when(F.col("now") == now, F.col("item")), F.when(F.col("now") == now, F.col("place")))
    g = both.groupBy("projectId", "section", "key").agg(last(False).alias("before"), last(True).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    kept = reduce(lambda a, b: a | b, [(F.col("section") == s) & F.col("change").isin(*c) for s, c in SECTIONS.items()])
    return g.withColumn("change", change).where(F.col("change").isNotNull() & kept)


def _named(section: Column, change: Column) -> Column:
    out = F.lit(None).cast("string")
    for s, names in SECTIONS.items():
        for c, name in names.items():
            out = F.when((section == s) & (change == c), F.lit(name)).otherwise(out)
    return out


def buckets(diff: DataFrame, limit: int = BUCKET) -> DataFrame:
    """``(projectId, section, bucket, total, displayed, truncated, items)``: the first ``limit`` items by key, and how many there are.

    A bucket that is cut is so by definition of the report; totals count all. The first ones are ranked by a
    limit that every task applies to its own rows before the exchange.
    """
    d = diff.withColumn("bucket", _named(F.col("section"), F.col("change")))
    by = ["projectId", "section", "bucket"]
    item = F.when(F.col("change") == "changed", F.to_json(F.struct("key", "before", "after"))).otherwise(F.coalesce("after", "before"))
    counts = d.groupBy(*by).agg(F.count("*").alias("total"))
    first = d.select(*by, "key", item.alias("item"), F.row_number().over(W.partitionBy(*by).orderBy("key")).alias("n")).where(F.col("n") <= limit)
    lists = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]).alias("items"))
    out = counts.join(lists, by)
    return out.select(*by, "total", F.least("total", F.lit(limit)).cast("long").alias("displayed"), (F.col("total") > limit).alias("truncated"), "items")


def metric_deltas(base: DataFrame, compare: DataFrame) -> DataFrame:
    """The 13 metrics of two runs, compare less base; a missing side or value counts as 0."""
    tag = lambda df, sign: df.select("projectId", *[(F.coalesce(F.col(m).cast("long"), F.lit(0)) * sign if m in df.columns else F.lit(0).cast("long")).alias(m) for m in METRICS])
    return tag(base, -1).unionByName(tag(compare, 1)).groupBy("projectId").agg(*[F.sum(m).alias(m) for m in METRICS])


def diff_document(diff: DataFrame, deltas: DataFrame, limit: int = BUCKET) -> DataFrame:
    """One row a project: the buckets of all sections, the deltas of the metrics, and whether anything was cut."""
    b = buckets(diff, limit)
    entry = F.struct("total", "displayed", "truncated", "items")
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(".", "section", "bucket").alias("key"), entry.alias("value")))))
    docs = b.groupBy("projectId").agg(pairs.alias("buckets"), F.max("truncated").alias("truncated"))
    out = deltas.join(docs, "projectId", "left")
    return out.select("projectId", F.struct(*METRICS).alias("metricsDelta"), "buckets", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def comparable_runs(runs: DataFrame, usable: Sequence[str]) -> DataFrame:
    """Pairs of consecutive usable runs with snapshots of the known version: ``(projectId, baseId, compareId)``.

    Failed runs, runs without a snapshot version or with another one, and a run with itself are no pairs.
    """
    ok = runs.where(F.col("status").isin(*usable) & (F.col("snapshotSchemaVersion") == VERSION))
    w = W.partitionBy("projectId").orderBy("runNumber", "id")
    return ok.select("projectId", F.lag("id").over(w).alias("baseId"), F.col("id").alias("compareId"), F.lag("runNumber").over(w).alias("baseRun"), F.col("runNumber").alias("compareRun")).where(F.col("baseId").isNotNull())


def with_baseline(runs: DataFrame, baselines: DataFrame) -> DataFrame:
    """Runs with ``isBaseline``: the run that a project's baseline points to."""
    b = baselines.select("projectId", F.col("runId").alias("id"), F.lit(True).alias("isBaseline")).distinct()
    return runs.join(b, ["projectId", "id"], "left").withColumn("isBaseline", F.coalesce("isBaseline", F.lit(False)))


def set_baseline(baselines: DataFrame, changes: DataFrame, runs: DataFrame, usable: Sequence[str]) -> DataFrame:
    """Baselines after ``changes(projectId, runId)``: a null run clears one; only usable runs of the project can be one.

    Of several changes of a project the greatest run holds; refused ones leave what was.
    """
    fit = runs.where(F.col("status").isin(*usable)).select("projectId", F.col("id").alias("runId"))
    sets = changes.where(F.col("runId").isNotNull()).join(fit, ["projectId", "runId"], "left_semi").groupBy("projectId").agg(F.max("runId").alias("runId"))
    clears = changes.where(F.col("runId").isNull()).select("projectId").distinct()
    kept = baselines.select("projectId", "runId").join(sets, "projectId", "left_anti").join(clears, "projectId", "left_anti")
    return kept.unionByName(sets.join(clears, "projectId", "left_anti").select("projectId", "runId"))


# snapshots as JSON ------------------------------------------------------------------------------
def snapshot_json(sections: DataFrame, metrics: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """One JSON text a project from :func:`section_rows`: every section sorted by its items' JSON, metrics and context.

    Meant for the projects of one export: a snapshot above ``MAX_SNAPSHOT`` bytes is refused (``snapshotJson``
    null, ``error`` set), as it is by definition of the format; the size is known from the lengths of the items
    before anything is put together, so that no larger one is ever collected.
    """
    items = sections.select("projectId", "section", "item")
    size = items.groupBy("projectId").agg(F.sum(F.octet_length("item") + 1).alias("bytes"))
    fits = items.join(size.where(F.col("bytes") <= MAX_SNAPSHOT).select("projectId"), "projectId", "left_semi")
    arrays = fits.groupBy("projectId", "section").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("a"))
    body = arrays.groupBy("projectId").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "section", F.lit('":['), "a", F.lit("]")))), ",").alias("body"))
    m = metrics.select("projectId", F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in metrics.columns else F.lit(0).alias(c) for c in sorted(METRICS)])).alias("metrics"))
    out = m.join(body, "projectId", "left").join(size, "projectId", "left")
    if context is not None:
        out = out.join(context.select("projectId", F.to_json(F.struct(*[c for c in context.columns if c != "projectId"])).alias("context")), "projectId", "left")
    else:
        out = out.withColumn("context", F.lit(None).cast("string"))
    text = F.concat(F.lit(f'{{"schemaVersion":{VERSION},"metrics":'), "metrics", F.lit(',"projectContext":'), F.coalesce("context", F.lit('"unknown"')), F.when(F.col("body").isNotNull(), F.concat(F.lit(","), "body")).otherwise(F.lit("")), F.lit("}"))
    too_large = F.coalesce(F.col("bytes"), F.lit(0)) > MAX_SNAPSHOT
    return out.select("projectId", F.when(~too_large, text).alias("snapshotJson"), F.when(too_large, "SNAPSHOT_TOO_LARGE").alias("error"))


def parsed_snapshots(snapshots: DataFrame, strict: bool = False) -> DataFrame:
    """``snapshots(…, snapshotJson)`` with version, metrics, sections as JSON texts, and what is wrong with it.

    ``warning`` is SNAPSHOT_MISSING, SNAPSHOT_INVALID or UNSUPPORTED_SNAPSHOT_VERSION; a wrong one has no
    sections. Missing metrics are the sizes of the sections they count, else 0. With ``strict`` wrong ones are
    left out of the rows.
    """
    j = F.col("snapshotJson")
    schema = "struct<schemaVersion:int,metrics:map<string,long>,projectContext:string>"
    p = snapshots.withColumn("_s", F.from_json(j, schema)).withColumn("schemaVersion", F.col("_s.schemaVersion"))
    warning = F.when(j.isNull(), "SNAPSHOT_MISSING").when(F.col("schemaVersion").isNull(), "SNAPSHOT_INVALID").when(F.col("schemaVersion") != VERSION, "UNSUPPORTED_SNAPSHOT_VERSION")
    p = p.withColumn("warning", warning)
    of = {s: F.when(warning.isNull(), F.coalesce(F.get_json_object(j, f"$.{s}"), F.lit("[]"))) for s in SECTIONS}
    sized = {"fileCount": "files", "symbolCount": "symbols", "dependencyCount": "dependencies", "fieldCount": "fields", "fieldDependencyCount": "fieldDependencies", "riskCount": "risks", "ruleCount": "rules"}
    known = lambda m: F.coalesce(F.col("_s.metrics")[m], F.json_array_length(of[sized[m]]).cast("long") if m in sized else F.lit(0).cast("long"), F.lit(0).cast("long"))
    metrics = F.struct(*[known(m).alias(m) for m in METRICS])
    context = F.coalesce("_s.projectContext", F.lit("unknown"))
    out = p.select(*[p[c] for c in snapshots.columns], "schemaVersion", "warning", F.when(warning.isNull(), metrics).alias("metrics"), F.when(warning.isNull(), context).alias("projectContext"), *[c.alias(s) for s, c in of.items()])
    return out.where(F.col("warning").isNull()) if strict else out


def exportable(reports: DataFrame, usable: Sequence[str], documents: Sequence[str] = ("flow", "dataDependency", "risks", "rules")) -> DataFrame:
    """Reports that may be exported: of a usable run, with all four documents."""
    full = reduce(lambda a, b: a & b, [F.length(F.trim(F.coalesce(F.col(d), F.lit("")))) > 0 for d in documents])
    return reports.withColumn("ready", F.col("status").isin(*usable) & full)


def legacy_candidates(runs: DataFrame, usable: Sequence[str]) -> DataFrame:
    """Usable runs without a snapshot that may be filled in from the stored relations: only where a project has exactly one run in all.

    With several runs the relations cannot be told to belong to it, so none is filled in.
    """
    one = runs.groupBy("projectId").agg(F.count("*").alias("n")).where("n = 1").select("projectId")
    return runs.where(F.col("status").isin(*usable) & F.col("snapshotSchemaVersion").isNull()).join(one, "projectId", "left_semi")
