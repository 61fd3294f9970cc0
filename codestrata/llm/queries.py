"""The registered queries of this subpackage and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import leakage, mojibake, packing, prose, provenance, secrets, syntax_check, truncation
from codestrata.session import scan, spread

Query = Callable[[SparkSession, str], DataFrame]


def _files(s: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(scan(s, d, "files", "id", "filePath", "content", *more), "id")


def _texts(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(scan(s, d, "documents", "doc_id", "text", *columns), "doc_id")


def _records(s: SparkSession, d: str) -> DataFrame:
    return spread(scan(s, d, "extracted_files", "extractId", "content"), "extractId")


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d, "documents", "doc_id", "lang", "text")


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: secrets.secret_lines(_files(s, d)),
        "p1_redacted": lambda s, d: secrets.redacted_files(_files(s, d)),
        "p2_found": lambda s, d: provenance.not_hand_written(_files(s, d)),
        "p2_reasons": lambda s, d: provenance.classify_provenance(_files(s, d)),
        "p3_found": lambda s, d: syntax_check.invalid_files(_files(s, d)),
        "p3_faults": lambda s, d: syntax_check.checked_files(_files(s, d, "projectId")),
        "p3_rates": lambda s, d: syntax_check.acceptance_rates(_files(s, d, "projectId")),
        "p3_causes": lambda s, d: syntax_check.first_causes(_files(s, d, "projectId")),
        "p4_found": lambda s, d: mojibake.garbled_records(_records(s, d)),
        "p4_repaired": lambda s, d: mojibake.garbled_records(_records(s, d), repair=True),
        "p5_found": lambda s, d: prose.prose_languages(_files(s, d), _labelled(s, d)),
        "p5_passages": lambda s, d: prose.prose_passages(_files(s, d), _labelled(s, d)),
        "p5_shares": lambda s, d: prose.prose_spans(_files(s, d), _labelled(s, d)),
        "p7_packed": lambda s, d: packing.packed(_texts(s, d), scan(s, d, "context_windows", "window_id", "capacity_tokens")),
        "p7_utilisation": lambda s, d: packing.utilisation(_texts(s, d), scan(s, d, "context_windows", "window_id", "capacity_tokens")),
        "p8_found": lambda s, d: leakage.leaked_pairs(scan(s, d, "eval_items", "item_id", "text"), _texts(s, d)),
        "p8_items": lambda s, d: leakage.leaked_items(scan(s, d, "eval_items", "item_id", "text"), _texts(s, d)),
        "p9_found": lambda s, d: truncation.truncated_documents(_texts(s, d, "source")).select("doc_id"),
        "p9_rates": lambda s, d: truncation.truncation_rates(_texts(s, d, "source")),
        "p9_limits": lambda s, d: truncation.field_limits(_texts(s, d, "source")),
    }


_OPEN = r"""
WITH d AS (SELECT coalesce(source, '') AS source, length(text) AS c, strlen(text) AS b,
  NOT coalesce(regexp_matches(rtrim(text, ' '), '(?s)[.!?。！？][''"”’»)\]]*$'), TRUE)
    OR coalesce(regexp_matches(rtrim(text, ' '), '(?:\.\.\.|…)(?:\s*\[\w+\])?$'), FALSE) AS open
  FROM documents WHERE length(text) > 0),
sizes AS (SELECT source, open, 'c' AS unit, c AS size FROM d UNION ALL SELECT source, open, 'b', b FROM d),
counts AS (SELECT source, unit, size, count(*) FILTER (WHERE open) AS rows, count(*) AS n FROM sizes GROUP BY 1, 2, 3),
w AS (SELECT *, sum(rows) OVER (PARTITION BY source, unit) AS total,
  coalesce(sum(n) OVER (PARTITION BY source, unit ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS longer FROM counts)
SELECT source, unit, size::INT AS size, rows FROM w
WHERE rows >= greatest(3, total * 0.02) AND longer <= rows * 0.5
"""


def oracle_sql() -> dict[str, str]:
    return {"p9_limits": _OPEN}
