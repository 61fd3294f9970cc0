"""Sinks: files tables by project, run history, upserts, report documents and archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes of a report archive and of a stored document.
MAX_REPORT, MAX_DOCUMENT = 25 * 1024**2, 16_777_215


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that ``df`` has rows for (a project's files, a projection)."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def append_run(df: DataFrame, path: str) -> None:
    """Add an immutable run, partitioned by project and run number."""
    df.write.mode("append").partitionBy("projectId", "runNumber").parquet(path)


def upserted(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows by key, the greatest version of both sides; ties go to the change."""
    both = current.withColumn("_n", F.lit(0)).unionByName(changes.withColumn("_n", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*current.columns), F.struct(version, "_n")).alias("r"))
    return best.select("r.*")


def without(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in ``gone`` (a cascading delete as an anti-join)."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def truncated_utf8(text: Column, most: int, footer: str) -> Column:
    """Cut at a byte limit on a character's border, with a footer; shorter texts stay as they are."""
    room = most - len(footer.encode())
    raw = F.encode(text, "UTF-8")
    # step back over at most three continuation bytes
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, room - k).cast("string")) for k in range(4)])
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut, F.lit(footer)))


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"\r?\n", " ")


def yaml_scalar(c: Column) -> Column:
    """A JSON string, which every YAML reader takes."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\"), '"', r'\\"'), r"\r?\n", r"\\n"), F.lit('"'))


def report_archive(documents: Mapping[str, str], most: int = MAX_REPORT) -> bytes:
    """A ZIP of named documents with fixed times, so that equal documents give equal bytes; too large ones are refused."""
    size = sum(len(v.encode()) for v in documents.values())
    if size > most:
        raise ValueError(f"report of {size} bytes exceeds {most}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(documents):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), documents[name])
    return out.getvalue()
