"""Archives and folders of source files to rows, and bytes to text."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.session import ship_package

# Limits of an import.
MAX_ARCHIVE, MAX_ENTRIES, MAX_FILES, MAX_FILE, MAX_TOTAL = 30 * 1024**2, 10_000, 2_000, 5 * 1024**2, 500 * 1024**2
# Encodings tried, in this order, when bytes are no UTF-8.
CANDIDATES = (
    "big5", "gb18030", "shift_jis", "euc_jp", "euc_kr", "windows-1251", "koi8-r", "windows-1250", "iso-8859-2", "windows-1252", "iso-8859-5", "iso-8859-7", "windows-1253", "windows-1254", "iso-8859-9",
    "windows-1255", "iso-8859-8", "windows-1256", "iso-8859-6", "windows-1257", "windows-1258", "ibm866",
)
#: Bytes of unpacked files that are handed on together.
FRAME_BYTES = 16 * 1024**2
ENTRY = "archive string, path string, content binary, size long, problem string"


def decode(data: bytes) -> tuple[str, str, str | None]:
    """``(text, encoding, warning)``: byte order marks, strict UTF-8, then the likeliest candidate, then Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(name), f"{name.upper()}-BOM", None
            except UnicodeDecodeError:
                break
    try:
        text = data.decode("utf-8")
        return text, "ascii" if text.isascii() else "UTF-8", None
    except UnicodeDecodeError:
        pass
    best, score = None, 0.0
    for name in CANDIDATES:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        odd = [c for c in text if c > "\x7f"]
        if any("\x80" <= c <= "\x9f" or "" <= c <= "" for c in odd):
            continue
        good = sum(c.isalpha() for c in odd) / max(1, len(odd))
        # a letter between two words of the same script counts more than a lone symbol
        pairs = sum(a.isalpha() and b.isalpha() and (ord(a) < 0x250) == (ord(b) < 0x250) for a, b in zip(text, text[1:]) if a > "\x7f" or b > "\x7f")
        s = good + pairs / max(1, 2 * len(odd)) - 0.01 * CANDIDATES.index(name) / len(CANDIDATES)
        if s > score:
            best, score = (text, name), s
    if best is None:
        return data.decode("latin-1"), "LATIN1-FALLBACK", "No encoding fits; decoded as Latin-1. Content may be corrupted."
    return best[0], best[1], f"Detected encoding: {best[1]} (confidence: {min(99, round(score * 66))}%)."


def decoded(rows: DataFrame, column: str = "content") -> DataFrame:
    """``rows`` with the binary column as text, and ``encoding`` and ``encodingWarning``; null stays null."""
    others = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [decode(bytes(x)) if x is not None else (None, None, None) for x in b[column]]
            yield b[others].assign(**{column: [g[0] for g in got], "encoding": [g[1] for g in got], "encodingWarning": [g[2] for g in got]})

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != column)
    return rows.mapInPandas(run, f"{fields + ', ' if fields else ''}`{column}` string, encoding string, encodingWarning string")


def unzipped(archives: DataFrame) -> DataFrame:
    """Binary rows ``(path, content)`` of ZIP archives to one row an entry, or one row with the archive's ``problem``."""

    def entries(name: str, data: bytes) -> Iterator[tuple]:
        if len(data) > MAX_ARCHIVE:
            yield name, None, None, len(data), "ZIP_TOO_LARGE"
            return
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            yield name, None, None, len(data), "ZIP_INVALID"
            return
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(z.infolist()) > MAX_ENTRIES or sum(i.file_size for i in infos) > MAX_TOTAL:
            yield name, None, None, len(data), "ZIP_TOO_LARGE"
            return
        for i in infos:
            if i.file_size > MAX_FILE:
                yield name, i.filename, None, i.file_size, "IMPORT_FILE_TOO_LARGE"
            else:
                yield name, i.filename, z.read(i), i.file_size, None

    columns = ["archive", "path", "content", "size", "problem"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                # some entries at a time, so that a worker holds one archive and a few of its files
                rows, held = [], 0
                for row in entries(name, bytes(data)):
                    rows.append(row)
                    held += len(row[2] or b"")
                    if held > FRAME_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return archives.select("path", "content").mapInPandas(run, ENTRY)


def archive_problems(entries: DataFrame) -> DataFrame:
    """``(archive, problem)``: what makes a whole archive unfit, the first of: a damaged or too large archive, an unsafe
    path, paths that collide, more source files or more text than an import takes, no source file at all."""
    e = import_rows(entries)
    bad = F.max(F.when(F.col("problem").startswith("ZIP_"), F.col("problem")))
    g = e.groupBy("archive").agg(bad.alias("bad"), F.max(F.col("action") == "IMPORT_UNSAFE_PATH").alias("unsafe"), F.count_if(F.col("action") == "keep").alias("files"), F.sum(F.when(F.col("action") == "keep", F.col("size"))).alias("bytes"))
    twice = e.where(F.col("path").isNotNull()).groupBy("archive", P.collision_key(F.col("path")).alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("archive").distinct().withColumn("twice", F.lit(True))
    why = (
        F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("unsafe"), "ZIP_UNSAFE_PATH").when(F.col("twice"), "ZIP_DUPLICATE_PATH").when(F.col("files") > MAX_FILES, "ZIP_TOO_MANY_FILES")
        .when(F.col("bytes") > MAX_TOTAL, "ZIP_TOO_LARGE").when(F.col("files") == 0, "EMPTY_SOURCE")
    )
    return g.join(twice, "archive", "left").select("archive", why.alias("problem")).where(F.col("problem").isNotNull())


def accepted_rows(entries: DataFrame) -> DataFrame:
    """Rows to keep of the archives that have no problem."""
    return import_rows(entries).where(F.col("action") == "keep").join(archive_problems(entries).select("archive"), "archive", "left_anti")


def import_warning_rows(entries: DataFrame) -> DataFrame:
    """``(archive, code, filePath, message)``: what an import warns of, entry by entry."""
    e = import_rows(entries)
    code = F.when(F.col("action").startswith("IMPORT_"), F.col("action")).when((F.col("action") == "keep") & P.extension(F.col("path")).isin(*P.LIMITED), "IMPORT_LIMITED_ANALYSIS")
    said = F.when(code == "IMPORT_FILE_TOO_LARGE", F.lit(f"Skipped: larger than {format_bytes(MAX_FILE)}.")).when(code == "IMPORT_LIMITED_ANALYSIS", "Analysed in part only.").when(code == "IMPORT_LANGUAGE_UNSUPPORTED", "Language is not supported.").otherwise("Path is not safe.")
    rows = e.select("archive", code.alias("code"), F.col("path").alias("filePath"), said.alias("message")).where(F.col("code").isNotNull())
    if "encodingWarning" in entries.columns:
        odd = e.where((F.col("action") == "keep") & F.col("encodingWarning").isNotNull())
        rows = rows.unionByName(odd.select("archive", F.lit("IMPORT_ENCODING_DETECTED").alias("code"), F.col("path").alias("filePath"), F.col("encodingWarning").alias("message")))
    return rows


def import_summary(entries: DataFrame) -> DataFrame:
    """Per archive: files kept, their size, warnings, and the problem that refuses it if there is one."""
    k = import_rows(entries).where(F.col("action") == "keep").groupBy("archive").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    w = import_warning_rows(entries).groupBy("archive").agg(F.count("*").alias("warnings"))
    out = entries.select("archive").distinct().join(k, "archive", "left").join(w, "archive", "left").join(archive_problems(entries), "archive", "left")
    return out.na.fill(0, ["files", "bytes", "warnings"])


def zip_probe(archives: DataFrame) -> DataFrame:
    """``(path, valid, sourceFiles)`` of binary ZIP rows, from their directories alone: nothing is unpacked."""
    endings = tuple(f".{x}" for x in P.SUPPORTED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, data in zip(b["path"], b["content"]):
                try:
                    names = zipfile.ZipFile(io.BytesIO(bytes(data))).namelist()
                    rows.append((name, True, sum(n.lower().endswith(endings) for n in names)))
                except (zipfile.BadZipFile, TypeError):
                    rows.append((name, False, 0))
            yield pd.DataFrame(rows, columns=["path", "valid", "sourceFiles"])

    return archives.select("path", "content").mapInPandas(run, "path string, valid boolean, sourceFiles int")


def format_bytes(n: int) -> str:
    """Whole megabytes, else bytes."""
    return f"{n // 1024**2} MB" if n >= 1024**2 and n % 1024**2 == 0 else f"{n / 1024**2:.1f} MB" if n >= 1024**2 else f"{n} bytes"


# Hosts and networks that a source address may not name.
_PRIVATE = r"^(localhost|.*\.localhost|0\.0\.0\.0|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|\[?::1\]?|\[?f[cd]|\[?fe80)"


def is_safe_source_url(url: Column, allowed: Sequence[str] | None = None) -> Column:
    """Addresses an import may fetch: https, no credentials, no private or loopback host, on the list if there is one. Null is not safe."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^https://([^/:?#@\s]+)(?::\d+)?(?:/\S*)?$", 1))
    ok = (host != "") & ~host.rlike(_PRIVATE)
    return F.coalesce(ok & host.isin(*allowed) if allowed is not None else ok, F.lit(False))


def replace_project_files(imported: DataFrame, path: str, project: int) -> None:
    """Write the rows of an import as the files of a project, in place of those it had; other projects stay."""
    from codestrata.sources.sinks import replace_partitions

    rows = imported.select(F.lit(project).cast("long").alias("projectId"), F.col("path").alias("filePath"), P.basename(F.col("path")).alias("fileName"), P.extension(F.col("path")).alias("fileType"), F.lit("stored").alias("status"), "content", F.size(F.split("content", r"\r?\n")).alias("lineCount"))
    replace_partitions(rows, path, "projectId")


def import_rows(entries: DataFrame) -> DataFrame:
    """Entries with what the import does with each: ``keep``, ``ignore``, or a warning code."""
    path = P.normalized(F.col("path"))
    e = entries.withColumn("rawPath", F.col("path")).withColumn("path", path)
    x = P.extension(F.col("path"))
    action = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(P.is_absolute(F.col("rawPath")) | ~P.is_safe_relative(F.col("path")), "IMPORT_UNSAFE_PATH")
        .when(P.is_ignored(F.col("path")), "ignore")
        .when(x.isin(*P.UNSUPPORTED_CODE), "IMPORT_LANGUAGE_UNSUPPORTED")
        .when(~x.isin(*P.SUPPORTED), "ignore")
        .otherwise("keep")
    )
    return e.withColumn("language", P.language(F.col("path"))).withColumn("action", action)


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """ZIP archives below a path to text rows with language, encoding and the import's decision."""
    ship_package(spark)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return decoded(import_rows(unzipped(raw)))


def read_base64_zip(rows: DataFrame, column: str) -> DataFrame:
    ship_package(rows.sparkSession)
    return decoded(import_rows(unzipped(rows.select(F.lit("inline").alias("path"), F.unbase64(column).alias("content")))))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Supported source files below a folder (checked out beforehand), without ignored folders."""
    ship_package(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = F.regexp_replace("path", r"^.*?" + path.rstrip("/").replace("\\", "\\\\").replace(".", r"\.") + "/", "")
    root = os.path.realpath(path)
    if os.path.isdir(root):  # a local folder: what a link leads out of it is no part of it
        outside = F.udf(lambda p: not os.path.realpath(p.removeprefix("file:")).startswith(root + os.sep) or os.path.islink(p.removeprefix("file:")), "boolean")
        raw = raw.where(~outside("path"))
    e = raw.select(F.lit(path).alias("archive"), inside.alias("path"), F.when(F.col("length") <= MAX_FILE, F.col("content")).alias("content"), F.col("length").alias("size"), F.when(F.col("length") > MAX_FILE, "IMPORT_FILE_TOO_LARGE").alias("problem"))
    return decoded(import_rows(e))
