"""Problem 3 as DataFrame operators: faults per file, invalid files, rates per project and language."""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.lexers import Lines

#: Extension → parser module; other extensions are no cases.
PARSERS = {"go": "go", "sql": "sql", "pas": "pascal", "dpr": "pascal", "dfm": "form", "fmx": "form"}
RESULT = "fileId long, projectId long, language string, valid boolean, faults array<struct<line:int,message:string>>"


def extension_column(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))


def checked_files(files: DataFrame) -> DataFrame:
    """``(id, projectId, filePath, content)`` → one row per file of a known extension with content.

    ``faults`` holds every fault in order of the text, so its first entry is the first cause; an empty list
    means the file is accepted. Null contents, null paths and other extensions give no rows; an empty text
    is judged like any other (an empty script is valid, an empty unit is not). Nesting may be of any depth; it
    takes about 100 bytes of memory a token. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsers = {e: import_module(f"codestrata.llm.syntax.{m}").faults for e, m in PARSERS.items()}
        for b in batches:
            rows = []
            for e, text in zip(b["language"], b["content"]):
                found = parsers[e](text)
                if found:
                    lines = Lines(text)
                    rows.append([{"line": lines.of(min(a, len(text))), "message": m} for a, m in found])
                else:
                    rows.append([])
            yield pd.DataFrame({"fileId": b["id"], "projectId": b["projectId"], "language": b["language"], "valid": [not r for r in rows], "faults": pd.Series(rows, dtype=object)})

    kept = files.select("id", "projectId", extension_column(F.col("filePath")).alias("language"), "content")
    kept = kept.where(F.col("content").isNotNull() & F.col("language").isin(*PARSERS))
    return kept.mapInPandas(run, RESULT)


def invalid_files(files: DataFrame) -> DataFrame:
    """Ids of files that are no complete, valid file of their extension's language (query ``p3_found``)."""
    lean = files.select("id", F.lit(None).cast("long").alias("projectId"), "filePath", "content")
    return checked_files(lean).where(~F.col("valid")).select("fileId")


def acceptance_rates(files: DataFrame) -> DataFrame:
    """Files, invalid files and share of accepted files per project and language; null projects form a group."""
    lang = F.coalesce(*[F.when(F.col("language").isin(*[e for e, m in PARSERS.items() if m == g]), F.lit(g)) for g in dict.fromkeys(PARSERS.values())])
    out = checked_files(files).groupBy("projectId", lang.alias("language")).agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
    return out.withColumn("acceptance", 1 - F.col("invalid") / F.col("files"))


def first_causes(files: DataFrame) -> DataFrame:
    """How often each first cause occurs per language."""
    first = F.element_at("faults", 1)
    return checked_files(files).where(~F.col("valid")).groupBy("language", first["message"].alias("cause")).agg(F.count("*").alias("files"))
