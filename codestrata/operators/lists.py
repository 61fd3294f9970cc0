"""Filtered, searched, sorted and paged lists, summaries, run history and generic snapshot comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.functions import paths as P
from codestrata.functions import text as T

PAGE_SIZE, MAX_PAGE_SIZE = 25, 100
USABLE = ("completed", "completed_with_warnings", "partial")


def all_of(conditions: Sequence[Column]) -> Column:
    if not conditions:
        raise ValueError("no condition")
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    if not conditions:
        raise ValueError("no condition")
    return reduce(lambda a, b: a | b, conditions)


def filtered(df: DataFrame, equal: Mapping[str, object | None], search: str = "", columns: Sequence[str] = ()) -> DataFrame:
    """Optional equality filters (None: any) and a case-blind search over columns."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df.where(T.contains_any([F.col(c) for c in columns], search)) if columns else df


def page_bounds(page: int, page_size: int, total: int) -> tuple[int, int, int]:
    """Clamped ``(page, page size, page count)``; an empty list has page 1 of 1."""
    size = min(MAX_PAGE_SIZE, max(1, page_size))
    count = max(1, -(-total // size))
    return min(max(1, page), count), size, count


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = PAGE_SIZE, clamp: bool = True) -> DataFrame:
    """One page in total order. With ``clamp`` a page beyond the end is the last one (this counts the rows first)."""
    if clamp:
        number, size, _ = page_bounds(number, size, df.count())
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def file_order() -> list[Column]:
    return [F.coalesce("filePath", F.lit("")).asc(), F.coalesce("fileName", F.lit("")).asc(), F.col("id").asc()]


def risk_order() -> list[Column]:
    return [T.severity_rank(F.col("severity")).desc(), F.coalesce("sourceFile", F.lit("")).asc(), F.coalesce("lineNumber", F.lit(0)).asc(), F.coalesce("title", F.lit("")).asc(), F.col("id").asc()]


def file_stats(files: DataFrame, by: str = "extension") -> DataFrame:
    """Files and lines per project and extension or language (``other`` where none)."""
    key = P.extension(F.col("filePath")) if by == "extension" else F.coalesce(P.language(F.col("filePath")), F.lit("other"))
    return files.groupBy("projectId", key.alias(by)).agg(F.count("*").alias("files"), F.coalesce(F.sum("lineCount"), F.lit(0)).alias("lines"))


def project_totals(projects: DataFrame, files: DataFrame, risks: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts per project from one aggregate a table; projects without rows show zeros."""
    f = files.groupBy(F.col("projectId").alias("id")).agg(F.count("*").alias("files"), F.coalesce(F.sum("lineCount"), F.lit(0)).alias("lines"))
    r = risks.groupBy(F.col("projectId").alias("id")).agg(F.count("*").alias("risks"), F.count_if(F.col("severity") == "critical").alias("critical"))
    a = runs.groupBy(F.col("projectId").alias("id")).agg(F.count("*").alias("runs"), F.count_if(F.col("status").isin(*USABLE)).alias("usableRuns"))
    out = projects.select("id", "name").join(f, "id", "left").join(r, "id", "left").join(a, "id", "left")
    return out.na.fill(0, ["files", "lines", "risks", "critical", "runs", "usableRuns"])


def latest_usable_run(runs: DataFrame) -> DataFrame:
    """The usable run with the greatest run number, then creation time, then id, per project."""
    rank = F.struct("runNumber", F.coalesce("createdAt", F.lit("1970-01-01").cast("timestamp_ntz")).alias("c"), "id")
    row = F.struct("id", "runNumber", "status", "sourceFingerprint", "completedAt")
    return runs.where(F.col("status").isin(*USABLE)).groupBy("projectId").agg(F.max_by(row, rank).alias("r")).select("projectId", F.col("r.id").alias("runId"), "r.runNumber", "r.status", "r.sourceFingerprint", "r.completedAt")


def current_source_run(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """The latest usable run made from the source the project has now; projects without one are left out."""
    p = projects.where(F.col("sourceFingerprint").isNotNull()).select(F.col("id").alias("projectId"), "sourceFingerprint")
    return latest_usable_run(runs.join(p, ["projectId", "sourceFingerprint"], "left_semi"))


def run_list(runs: DataFrame) -> DataFrame:
    """Runs with the mark of the latest usable one of their project."""
    latest = latest_usable_run(runs).select(F.col("runId").alias("id"), F.lit(True).alias("isLatestUsable"))
    out = runs.select("id", "projectId", "runNumber", "status", "analyzerVersion", "sourceFingerprint").join(latest, "id", "left")
    return out.withColumn("isLatestUsable", F.coalesce("isLatestUsable", F.lit(False)))


def next_run_number(runs: DataFrame) -> DataFrame:
    return runs.groupBy("projectId").agg((F.coalesce(F.max("runNumber"), F.lit(0)) + 1).alias("nextRunNumber"))


def analysis_status(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """The status shown for a project: that of the run of its present source, else one derived from the project's own."""
    current = current_source_run(projects, runs).select(F.col("projectId").alias("id"), F.col("status").alias("runStatus"))
    own = F.when(F.col("status") == "failed", "failed").when(F.col("status") == "analyzing", "running").otherwise("pending")
    return projects.select("id", "status").join(current, "id", "left").select("id", F.coalesce("runStatus", own).alias("analysisStatus"))


WARNING = "array<struct<code:string,message:string,filePath:string>>"


def import_warnings(projects: DataFrame) -> DataFrame:
    """The warnings in ``importWarningsJson``; text that is no such list gives none."""
    parsed = F.from_json("importWarningsJson", WARNING, {"mode": "PERMISSIVE"})
    return projects.select(F.col("id").alias("projectId"), F.posexplode(parsed).alias("ord", "w")).select("projectId", "ord", "w.code", "w.message", "w.filePath").where(F.col("code").isNotNull())


def warning_summary(warnings: DataFrame, messages: int = 3, files: int = 50) -> DataFrame:
    """Per project and code: number, first distinct messages and files in order of arrival."""

    def first(column: str, limit: int) -> DataFrame:
        seen = warnings.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy("projectId", "code", column).agg(F.min("ord").alias("o"))
        n = F.row_number().over(W.partitionBy("projectId", "code").orderBy("o", column))
        top = seen.withColumn("n", n).where(F.col("n") <= limit).groupBy("projectId", "code")
        return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", column))), lambda x: x[column]), " | ").alias(column))

    counts = warnings.groupBy("projectId", "code").agg(F.count("*").alias("count"))
    out = counts.join(first("message", messages), ["projectId", "code"], "left").join(first("filePath", files), ["projectId", "code"], "left")
    return out.select("projectId", "code", "count", F.coalesce("message", F.lit("")).alias("sampleMessages"), F.coalesce("filePath", F.lit("")).alias("sampleFiles"))


def affected_files(risks: DataFrame, top: int = 10) -> DataFrame:
    """The files with most risks per project (a top-k report)."""
    counts = risks.where(F.col("sourceFile").isNotNull()).groupBy("projectId", "sourceFile").agg(F.count("*").alias("riskCount"), F.max(T.severity_rank(F.col("severity"))).alias("worst"))
    n = F.row_number().over(W.partitionBy("projectId").orderBy(F.desc("riskCount"), "sourceFile"))
    return counts.withColumn("rank", n).where(F.col("rank") <= top)


def source_manifest(files: DataFrame) -> DataFrame:
    """``(projectId, path, hash)`` of stored files, the newest import of a path."""
    kept = files.where(F.col("content").isNotNull())
    newest = kept.groupBy("projectId", P.slashed(F.col("filePath")).alias("path")).agg(F.max_by(F.sha2("content", 256), "id").alias("hash"))
    return newest


def source_fingerprints(files: DataFrame) -> DataFrame:
    """One hash per project over its manifest in order of path, independent of the order of rows.

    Paths and content hashes are sorted by the executors and hashed as a stream, so that no project is ever
    held as a whole.
    """
    m = source_manifest(files).repartition("projectId").sortWithinPartitions("projectId", "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, count, digest = None, 0, None
        for b in batches:
            out = []
            for p, path, value in zip(b["projectId"], b["path"], b["hash"]):
                if digest is None or p != project:
                    if digest is not None:
                        out.append((project, count, digest.hexdigest()))
                    project, count, digest = p, 0, hashlib.sha256()
                digest.update(f"{chr(10) if count else ''}{path}:{value}".encode())
                count += 1
            if out:
                yield pd.DataFrame(out, columns=["projectId", "files", "fingerprint"])
        if digest is not None:
            yield pd.DataFrame([(project, count, digest.hexdigest())], columns=["projectId", "files", "fingerprint"])

    return m.where(F.col("projectId").isNotNull()).mapInPandas(run, "projectId long, files long, fingerprint string")


def keyed_diff(base: DataFrame, compare: DataFrame, keys: Sequence[str], payload: Sequence[str], order: str) -> DataFrame:
    """Added, removed and changed keys between two relations; of repeated keys the last by ``order`` holds.

    One tagged union and one aggregate in place of a full join: both sides combine before the exchange.
    """
    tag = lambda df, side: df.select(*keys, F.struct(F.col(order).alias("o"), F.struct(*payload).alias("v")).alias("x"), F.lit(side).alias("side"))
    both = tag(base, 0).unionByName(tag(compare, 1))
    last = lambda side: F.max_by(F.when(F.col("side") == side, F.col("x.v")), F.when(F.col("side") == side, F.col("x.o")))
    has = lambda side: F.max(F.col("side") == side)
    g = both.groupBy(*keys).agg(last(0).alias("b"), last(1).alias("c"), has(0).alias("hb"), has(1).alias("hc"))
    change = F.when(~F.col("hb"), "added").when(~F.col("hc"), "removed").when(~F.col("b").eqNullSafe(F.col("c")), "changed")
    return g.withColumn("change", change).where(F.col("change").isNotNull()).select(*keys, "change")


def diff_buckets(diff: DataFrame, group: str, key: str, limit: int = 200) -> DataFrame:
    """Per group and kind of change: total, how many are shown, whether the list was cut (a capped report section)."""
    counts = diff.groupBy(group, "change").agg(F.count("*").alias("total"))
    return counts.withColumn("displayed", F.least("total", F.lit(limit))).withColumn("truncated", F.col("total") > limit)


def duplicate_paths(files: DataFrame) -> DataFrame:
    """Paths that collide when letter case and a final slash do not count."""
    return files.groupBy("projectId", P.collision_key(P.normalized(F.col("path"))).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
