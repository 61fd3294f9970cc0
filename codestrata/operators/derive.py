"""What is derived from extracted rows: analyser warnings, rules, project metrics, confidence, documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.functions import text as T

# Warning codes and their levels.
LEVELS = {
    "SQL_STRING_MULTILINE": "warning", "SQL_DYNAMIC_STRING": "warning", "SQL_STATEMENT_MULTILINE": "warning", "DELPHI_BLOCK_UNBALANCED": "warning", "DELPHI_UNIT_NOT_FOUND": "warning",
    "DELPHI_LIMITED_ANALYSIS": "warning", "HEURISTIC_ANALYSIS": "note", "IMPORT_BUILD_METADATA": "note", "LANGUAGE_UNSUPPORTED": "warning",
}


# Signs of texts that analysis cannot be sure of.
TEXT_SIGNS = {
    "string": r"(?is)[\"'`](SELECT|INSERT|UPDATE|DELETE).*?\n.*?[\"'`]",
    "joined": r"(?i)(SELECT|INSERT|UPDATE|DELETE)[^;\n]*(\"?\s*\+|&|\|\|)",
    "verb": r"(?i)(SELECT|INSERT|UPDATE|DELETE)\b",
    "begin": r"(?i)begin\b",
    "end": r"(?i)end\b",
    "unit": r"(?im)^\s*(?:unit|library|program)\s+[A-Za-z_]",
}


def file_warnings(files: DataFrame) -> DataFrame:
    """``(projectId, fileId, file, code, level)`` from flags over whole texts; null contents give none."""
    c, e = F.col("content"), P.extension(F.col("filePath"))
    pascal, script = e.isin("pas", "dpr", "inc", "dpk", "delphi"), e.isin("go", "sql", "pas", "dpr", "inc", "dpk", "delphi")
    holds = {k: c.rlike(p) for k, p in TEXT_SIGNS.items()}
    flags = {
        "SQL_STRING_MULTILINE": script & holds["string"],
        "SQL_DYNAMIC_STRING": script & holds["joined"],
        "SQL_STATEMENT_MULTILINE": (e == "sql") & F.contains(c, F.lit("\n")) & holds["verb"] & ~F.contains(c, F.lit(";")),
        "DELPHI_BLOCK_UNBALANCED": pascal & ~(holds["begin"] & holds["end"]),
        "DELPHI_UNIT_NOT_FOUND": pascal & ~holds["unit"],
        "DELPHI_LIMITED_ANALYSIS": e.isin("inc", "dpk"),
        "HEURISTIC_ANALYSIS": pascal,
        "IMPORT_BUILD_METADATA": e.isin(*P.BUILD_METADATA),
        "LANGUAGE_UNSUPPORTED": ~e.isin(*P.SUPPORTED),
    }
    found = F.filter(F.array(*[F.when(f, F.struct(F.lit(k).alias("code"), F.lit(LEVELS[k]).alias("level"))) for k, f in flags.items()]), lambda x: x.isNotNull())
    rows = files.where(c.isNotNull()).select("projectId", F.col("id").alias("fileId"), P.slashed(F.col("filePath")).alias("file"), F.explode(found).alias("w"))
    return rows.select("projectId", "fileId", "file", "w.code", "w.level")


def field_family(c: Column) -> Column:
    parts = F.filter(F.split(c, r"[_\W]+"), lambda x: x != "")
    n = F.size(parts)
    return F.when(n >= 3, F.concat(F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), "_"), F.lit(".*"))).when(n == 2, F.concat(F.get(parts, F.lit(0)), F.lit(".*"))).otherwise(c)


def _word(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\w]+", "_")


RULE = ("projectId", "ruleType", "name", "description", "condition", "occurrences", "file", "line")


def rules(references: DataFrame, magic: DataFrame, conversions: DataFrame) -> DataFrame:
    """Rules of :data:`RULE`: single owners of fields written at several places, calculated fields to reproduce,
    constants to take out of the code, and conversions to guard; one a type and name, the last one made holds."""
    at = F.struct("file", "line")
    w = references.where(F.col("access") == "write").withColumn("k", T.field_identity(F.col("tableName"), F.col("field")))
    several = w.groupBy("projectId", "k").agg(F.count("*").alias("n"), F.min(at).alias("at")).where(F.col("n") >= 2)
    owner = several.withColumn("family", field_family(F.col("k.field"))).groupBy("projectId", F.coalesce("k.table", F.lit("")).alias("t"), "family").agg(F.sum("n").alias("occurrences"), F.count("*").alias("fields"), F.min("at").alias("at"))
    shown = F.concat_ws(".", "t", "family")
    owner = owner.select(
        "projectId", F.lit(1).alias("made"), F.lit("validation").alias("ruleType"), F.concat(F.lit("validate_"), _word(F.concat_ws("_", "t", "family")), F.lit("_single_owner")).alias("name"),
        F.concat(F.lit("Review write ownership for "), shown, F.lit("; "), F.col("fields").cast("string"), F.lit(" related fields have multiple write sites.")).alias("description"),
        F.concat(shown, F.lit(" should have a documented write owner")).alias("condition"), "occurrences", "at",
    )
    c = references.where(F.col("access") == "calculate")
    field = F.concat_ws(".", "tableName", "field")
    calculated = c.select(
        "projectId", F.lit(0).alias("made"), F.lit("calculation").alias("ruleType"), _word(F.concat(F.lit("recalculate_"), F.concat_ws("_", "tableName", "field"))).alias("name"),
        F.concat(F.lit("Calculated field "), field, F.lit(" should be reproducible.")).alias("description"), (F.col("context") if "context" in references.columns else F.lit(None).cast("string")).alias("condition"), F.lit(1).cast("long").alias("occurrences"), at.alias("at"),
    )

    def from_risks(df: DataFrame, kind: str, prefix: str, made: int) -> DataFrame:
        name = F.concat(F.lit(prefix), _word(F.col("file")), F.lit("_"), F.lower(_word(F.col("title"))))
        told = F.col("description") if "description" in df.columns else F.lit(None).cast("string")
        g = df.groupBy("projectId", name.alias("name")).agg(F.count("*").alias("occurrences"), F.min(F.struct("file", "line", "title", told.alias("told"))).alias("r"))
        description = F.when(F.col("occurrences") > 1, F.concat("r.title", F.lit(" ("), F.col("occurrences").cast("string"), F.lit(" occurrences)"))).otherwise(F.col("r.title"))
        return g.select("projectId", F.lit(made).alias("made"), F.lit(kind).alias("ruleType"), "name", description.alias("description"), F.col("r.told").alias("condition"), "occurrences", F.struct("r.file", "r.line").alias("at"))

    every = reduce(DataFrame.unionByName, [calculated, owner, from_risks(magic, "magic_value", "externalize_", 2), from_risks(conversions, "format", "format_guard_", 3)])
    one = every.groupBy("projectId", "ruleType", "name").agg(F.max(F.struct("made", "at", "description", "condition", "occurrences")).alias("r"))
    return one.select("projectId", "ruleType", "name", "r.description", "r.condition", "r.occurrences", "r.at.file", "r.at.line").select(*RULE)


# What the warnings of forms say.
FORM_UNBALANCED = "DFM object blocks appear incomplete; object and property extraction is best-effort."
FORM_EMPTY = "No objects were found in the DFM file. The file may be malformed or use an unsupported format."
HEURISTIC = "Analysis results are heuristic for Go, SQL, and Delphi. Use them to support legacy impact review and human code review, not as a compiler-grade source-of-truth."


def project_warnings(files: DataFrame, forms: DataFrame, handlers: DataFrame, bindings: DataFrame) -> DataFrame:
    """``(projectId, code, level, file, message, heuristic)``: warnings of files, forms, handlers and bindings, each once, and the note on the method."""
    none = F.lit(None).cast("string")
    make = lambda df, code, level, message, heuristic=True, file="file": df.select("projectId", F.lit(code).alias("code"), F.lit(level).alias("level"), (F.col(file) if file else none).alias("file"), message.alias("message"), F.lit(heuristic).alias("heuristic"))
    parts = [files.select("projectId", "code", "level", "file", F.lit("").alias("message"), F.col("code").isin("HEURISTIC_ANALYSIS", "DELPHI_LIMITED_ANALYSIS", "SQL_STRING_MULTILINE", "SQL_DYNAMIC_STRING").alias("heuristic"))]
    parts.append(make(forms.where(F.col("error").isNotNull()), "DFM_LIMITED_ANALYSIS", "warning", F.col("error")))
    parts.append(make(forms.where(F.col("error").isNull() & ~F.col("closed")), "DFM_OBJECT_UNBALANCED", "warning", F.lit(FORM_UNBALANCED)))
    parts.append(make(forms.where(F.col("error").isNull() & (F.col("objects") == 0)), "DFM_NO_OBJECTS", "warning", F.lit(FORM_EMPTY)))
    place = F.concat_ws(".", "formName", "component", "event")
    parts.append(make(handlers.where(F.col("status") != "resolved"), "DELPHI_EVENT_HANDLER_UNRESOLVED", "warning", F.concat(place, F.lit(" references "), F.col("handler"), F.lit(", but no Pascal method was resolved."))))
    incomplete = F.concat("component", F.lit(" has incomplete static DB binding metadata: runtime assignment may be required."))
    parts.append(make(bindings.where(F.col("confidence") != "high"), "DELPHI_DATA_BINDING_UNRESOLVED", "warning", incomplete))
    every = reduce(DataFrame.unionByName, parts)
    note = make(every.select("projectId").distinct(), "HEURISTIC_ANALYSIS", "note", F.lit(HEURISTIC), file="")
    return merged_warnings(every, note)


def merged_warnings(*warnings: DataFrame) -> DataFrame:
    """Several lists of warnings as one; of the same code, file and message the first stands."""
    every = reduce(DataFrame.unionByName, [w.withColumn("_n", F.lit(n)) for n, w in enumerate(warnings)])
    one = every.groupBy("projectId", "code", "file", "message").agg(F.min(F.struct("_n", "level", "heuristic")).alias("w"))
    return one.select("projectId", "code", "w.level", "file", "message", "w.heuristic")


def import_summary_warnings(files: DataFrame, imported: DataFrame) -> DataFrame:
    """One note a project on what was imported, and the import's own warnings as analysis warnings."""
    f = files.groupBy("projectId").agg(F.count("*").alias("n"), F.count_if(P.language(F.col("filePath")).isNotNull()).alias("known"))
    i = imported.groupBy("projectId").agg(F.count("*").alias("w"))
    f = f.join(i, "projectId", "left").na.fill(0, ["w"])
    said = F.concat(F.lit("Analysis input: "), F.col("n").cast("string"), F.lit(" files, "), F.col("known").cast("string"), F.lit(" of supported languages, "), F.col("w").cast("string"), F.lit(" import warnings."))
    note = f.select("projectId", F.lit("ANALYSIS_INPUT_SUMMARY").alias("code"), F.lit("note").alias("level"), F.lit(None).cast("string").alias("file"), said.alias("message"), F.lit(False).alias("heuristic"))
    own = imported.select("projectId", "code", F.lit("warning").alias("level"), F.col("filePath").alias("file"), F.coalesce("message", F.lit("")).alias("message"), F.lit(False).alias("heuristic"))
    return merged_warnings(note, own)


def confidence(files: DataFrame, file_warnings_: DataFrame, import_warnings: DataFrame, handlers: DataFrame, bindings: DataFrame, risks: DataFrame) -> DataFrame:
    """Score from 0 to 100 and level per project: 100 less capped penalties for what analysis could not be sure of."""
    e = P.extension(F.col("filePath"))
    known, forms, eligible = e.isin("go", "sql", "pas", "dpr", "delphi", "dfm", "inc", "dpk", "fmx"), e.isin("pas", "dpr", "delphi", "dfm", "inc", "dpk", "fmx"), e.isin(*P.SUPPORTED)
    has = lambda *x: F.max(F.coalesce(e.isin(*x), F.lit(False)))
    f = files.groupBy("projectId").agg(
        F.count("*").alias("n"), F.count_if(eligible).alias("eligible"), F.count_if(eligible & F.col("content").isNotNull()).alias("analyzed"), F.count_if(~known).alias("unknown"),
        F.count_if(forms).alias("delphi"), has("pas").alias("pas"), has("dfm").alias("dfm"), has("dpr", "dproj", "dpk").alias("entry"),
    )
    w = file_warnings_.groupBy("projectId").agg(
        F.count_distinct(F.when(F.col("level") != "note", F.col("fileId"))).alias("degraded"), F.count_distinct("file").alias("limited"), F.count_if(F.col("level") != "note").alias("analyzer"),
        F.count_if(F.col("code") == "SQL_DYNAMIC_STRING").alias("dynamic"),
    )
    i = import_warnings.groupBy("projectId").agg(F.count("*").alias("imports"))
    h = handlers.groupBy("projectId").agg(F.count_if(F.col("status") != "resolved").alias("events"))
    b = bindings.groupBy("projectId").agg(F.count_if((F.col("confidence") != "high") | (F.col("accessHint") == "unresolved")).alias("bindings"))
    r = risks.groupBy("projectId").agg(F.count_if(F.col("title").rlike(r"(?i)dynamic sql|sql\.text|sql\.add")).alias("dynamicRisks"), F.count_if(F.col("title").rlike(r"(?i)hardcoded|connection string|filesystem path")).alias("hard"))
    x = reduce(lambda a, c: a.join(c, "projectId", "left"), [f, w, i, h, b, r]).na.fill(0)
    cap = lambda most, v: F.least(F.lit(most), v)
    share = lambda part, whole, most: F.when(F.col(whole) > 0, cap(most, F.ceil(F.col(part) / F.col(whole) * most))).otherwise(0)
    missed = F.when(F.col("eligible") > 0, cap(25, F.ceil((F.col("eligible") - F.col("analyzed")) / F.col("eligible") * 25))).otherwise(0)
    pairs = F.when(F.col("delphi") == 0, 0).when(F.col("pas") & F.col("dfm"), 0).when(F.col("pas"), 3).otherwise(4)
    entry = F.when((F.col("delphi") > 0) & ~F.col("entry"), 4).otherwise(0)
    lost = [missed, cap(20, F.col("degraded") * 2), cap(20, F.col("limited") * 2), cap(15, F.col("imports") * 2), cap(20, F.col("analyzer")), share("unknown", "n", 12), pairs, entry,
            cap(20, F.col("events") * 4), cap(20, F.col("bindings") * 4), cap(18, (F.col("dynamic") + F.col("dynamicRisks")) * 3), cap(12, F.col("hard") * 2)]
    score = F.greatest(F.lit(0), 100 - reduce(lambda a, c: a + c, lost)).cast("int")
    level = F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")
    return x.select("projectId", score.alias("score"), level.alias("level"))


def run_status(failed: Column, analyzed: Column, degraded: Column, warnings: Column) -> Column:
    """failed, partial, completed_with_warnings or completed, in this order."""
    return F.when(failed | (analyzed == 0), "failed").when(degraded > 0, "partial").when(warnings > 0, "completed_with_warnings").otherwise("completed")
