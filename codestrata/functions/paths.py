"""Path functions over slash paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and patterns of the import rules.
SUPPORTED = ("go", "sql", "pas", "dpr", "delphi", "dfm", "inc", "dpk", "fmx", "dproj", "groupproj", "bdsproj", "cfg", "dof", "rc")
UNSUPPORTED_CODE = ("ts", "js", "java", "py", "rb", "php", "cs", "cpp", "c", "h", "hpp", "scala", "kt", "rs", "swift")
LIMITED = ("dfm", "inc", "dpk", "fmx", "dproj", "groupproj", "bdsproj", "cfg", "dof", "rc")
BUILD_METADATA = ("dproj", "groupproj", "bdsproj", "cfg", "dof", "rc")
IGNORED = r"^__MACOSX/|(^|/)node_modules/|(^|/)\.git/|(^|/)dist/|(^|/)build/|(^|/)target/|(^|/)\.idea/|(^|/)\.vscode/|\.lock$|(?i:\.env)"


def slashed(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def normalized(path: Column) -> Column:
    """Slashes only, without leading ``./`` and ``/``."""
    return F.regexp_replace(F.regexp_replace(slashed(path), r"^\./+", ""), r"^/+", "")


def is_safe_relative(path: Column) -> Column:
    """No NUL, no ``.`` or ``..`` segment, no drive, at least one segment; null is unsafe."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    safe = (path != "") & ~F.contains(path, F.lit("\0")) & (F.size(segments) > 0) & ~F.exists(segments, lambda s: s.isin(".", "..")) & ~F.element_at(segments, 1).rlike("^[a-zA-Z]:$")
    return F.coalesce(safe, F.lit(False))


def is_absolute(raw: Column) -> Column:
    return F.coalesce(raw.rlike(r"^[/\\]|^[a-zA-Z]:[\\/]"), F.lit(False))


def collision_key(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, "/+$", ""))


def is_ignored(path: Column) -> Column:
    return F.coalesce(path.rlike(IGNORED), F.lit(False))


def basename(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(slashed(path), r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case text behind the last dot of the whole path, without the dot; '' if there is none."""
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))).when(path.isNotNull(), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def language(path: Column) -> Column:
    """go, sql or delphi by extension; null for others."""
    e = extension(path)
    return F.when(e.isin("go", "sql"), e).when(e.isin(*SUPPORTED), F.lit("delphi"))


def collapsed(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; ``..`` above the root stays in front."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(slashed(path), "/"), F.array().cast("array<string>"), step), "/")


def resolved_relative(base_dir: Column, path: Column) -> Column:
    """A relative path against a folder; absolute paths and macros (``$(X)``) give null."""
    bad = is_absolute(path) | path.rlike(r"\$\(|%\w+%")
    return F.when(~bad, collapsed(F.concat_ws("/", F.when(base_dir != "", base_dir), path)))
