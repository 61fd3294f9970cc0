"""Text functions: normalisers, search, ranks, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts in browsers know it: Unicode spaces, tabs, line ends, byte order mark.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Units of the standard library that dependency lists hide by default.
STANDARD_UNITS = (
    "Windows", "Messages", "SysUtils", "Classes", "Forms", "Dialogs", "DB", "ADODB", "Variants", "Controls", "Graphics", "StdCtrls", "ExtCtrls", "ComCtrls", "DBCtrls",
    "Mask", "Math", "StrUtils", "DateUtils", "IniFiles", "TypInfo", "Contnrs", "Types", "Clipbrd", "Menus", "Buttons", "Grids", "DBGrids", "ActnList", "ShellApi",
)
# Weight of a risk by severity.
RISK_WEIGHTS = {"critical": 40, "high": 20, "medium": 8, "low": 3}


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeezed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, f"{SPACE}+", " "))


def normalized_text(c: Column) -> Column:
    """For grouping: lower case, quoted spans, integers and paths replaced by marks, white space squeezed; null as ''."""
    # These steps define the grouping key.
    steps = (
        ("[\"'`].*?[\"'`]", "<value>"),
        (r"\b\d+\b", "<n>"),
        (r"(?i)[a-z]:\\[^\s)]+", "<path>"),
        (r"\\\\[^\s)]+", "<path>"),
    )
    out = F.lower(F.coalesce(c, F.lit("")))
    return squeezed(reduce(lambda x, s: F.regexp_replace(x, *s), steps, out))


def severity_rank(c: Column) -> Column:
    return F.when(c == "critical", 4).when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def risk_weight(c: Column) -> Column:
    return reduce(lambda x, kv: x.when(c == kv[0], kv[1]), RISK_WEIGHTS.items(), F.when(F.lit(False), 0)).otherwise(0)


def contains_any(columns: list[Column], term: str) -> Column:
    """Case-blind substring search over several columns; a blank term finds everything."""
    t = term.strip().lower()
    if not t:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(t)), F.lit(False)) for c in columns])


def like_pattern(term: str) -> str:
    """A LIKE pattern (escape ``\\``) that finds ``term`` as it stands."""
    escaped = term.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{escaped}%"


def line_count(c: Column) -> Column:
    return F.size(F.split(c, r"\r?\n"))


def is_standard_unit(c: Column) -> Column:
    return F.coalesce(trimmed(c).isin(*STANDARD_UNITS), F.lit(False))


def identifier_unquoted(c: Column) -> Column:
    return F.lower(trimmed(F.regexp_replace(trimmed(c), r"^[\[`\"]+|[\]`\"]+$", "")))


def field_identity(table: Column, field: Column) -> Column:
    """``struct(schema, table, field)``: last three dotted parts, lower case, unquoted; schema dbo counts as none.

    Dots inside quotes do not split (parts are taken by a quote-aware pattern).
    """
    dotted = F.concat_ws(".", table, field)
    parts = F.transform(F.regexp_extract_all(dotted, F.lit(r"(\[[^\]]*\]|\"(?:\"\"|[^\"])*\"|`(?:``|[^`])*`|[^.\[\]\"`]+)"), F.lit(1)), identifier_unquoted)
    n = F.size(parts)
    schema = F.when(n >= 3, F.get(parts, n - 3))
    return F.struct(F.when(~schema.isin("dbo", ""), schema).alias("schema"), F.when(n >= 2, F.get(parts, n - 2)).alias("table"), F.get(parts, n - 1).alias("field"))
