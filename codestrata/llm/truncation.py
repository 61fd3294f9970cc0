"""Problem 9: texts that break off before their author's end.

A stack automaton runs over the structural marks of the whole text (code fences, inline code, quotes,
brackets, tags, comments); what is open at the end was cut. Broken multibyte sequences, cut escapes and
marks that say so count too. For the rest the last line decides: a sentence wants a terminator, while
list entries, links, signatures, status lines and closed code blocks may end without one.

Each source has its baseline, found over all rows. Lengths (in characters or UTF-8 bytes) at which its texts pile
up without a terminator are field limits; at a limit, dots are a mark and an ending without a terminator is a
cut. Where nearly all texts of a source end without a terminator (``NORM_SHARE``), a missing one tells nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import checkpointed, maybe_broadcast

#: A length is a limit of its source if at least this share and number of its unterminated texts have it: with
#: fewer than three rows of one length chance cannot be told from a limit. Both are parameters of ``field_limits``.
LIMIT_SHARE, LIMIT_ROWS = 0.02, 3
#: Longer texts of the source allowed for one at the limit (a few arrive by other ways).
LONGER = 0.5

#: Share of a source's texts that end openly from which that is its way, if it has so many texts at least.
NORM_SHARE, NORM_ROWS = 0.75, 50

# Marks that say a text was cut.
MARKS = re.compile(r"(?:\[\s*(?:truncated|trimmed|cut|snip(?:ped)?|clipped|more|message clipped|gekürzt|abgeschnitten|tronqué|truncado|ucięto|обрезано|\.\.\.|…)\s*\]|<\s*(?:truncated|snip|cut)\s*>|\(\s*(?:truncated|cut off|continued|gekürzt)\s*\)|(?:…|\.\.\.)\s*(?:read more|show more|see more|more|mehr|\(more\))|\[…|\[\.\.\.)\s*$", re.I)
# Words of farewell and of lines that stand alone.
FAREWELL = re.compile(
    r"^(?:(?:with\s+)?(?:best|kind|warm)?\s*(?:wishes|regards)|best|cheers|thanks|thank you|many thanks|sincerely|yours|greetings|bye|signed|sent from|mit freundlichen|freundliche|viele|beste|liebe|schöne|mfg|lg|vg|gruß|grüße|danke"
    r"|cordialement|bien à|salutations|merci|amicalement|saludos|atentamente|gracias|un saludo|atenciosamente|obrigad|abraços|cumprimentos|att|pozdrawiam|z poważaniem|dzięki|с уважением|спасибо|всего|敬具|以上|よろしく|此致|敬上|謝謝|谢谢|祝|感謝|감사합니다|드림|올림)\b",
    re.I,
)
_TERMINATED = re.compile(r"[.!?。！？｡…‼⁉]['\"”’»)\]）」』*_~]*$")
_DOTS = re.compile(r"(?:\.\.\.|…)['\"”’»)\]]*$")
_BROKEN = re.compile(r"(?:�|[\ud800-\udbff]|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|&(?:#x?[0-9A-Fa-f]*|[A-Za-z]{1,8})|%[0-9A-Fa-f]?)$")
_LIST = re.compile(r"^\s*(?:[-*+•▪‣–]|\(?\d{1,3}[.)]|[a-z][.)])\s+\S")
_LINK = re.compile(r"(?:https?|ftp|mailto|file)[:][^\s]*$|(?:^|\s)www\.\S+$|\S+@[\w-]+\.\w+$")
_STATUS = re.compile(r"^[^\s:：][^:：.!?]{0,40}[:：]\s*\S[^.!?]{0,60}$")
_SIGN = re.compile(r"^(?:--|—|–|~|/|@|\(signed\)|\(gez\.\)|gez\.|i\.\s?a\.|cc:|p\.?s\.?:)\s*\S.{0,40}$", re.I)
_HEADING = re.compile(r"^(?:#{1,6}\s+\S|={3,}$|-{3,}$|\*{3,}$|\|.*\|$)")
_ALONE = re.compile(r"^(?:n/?a|none|tbd|todo|wip|fyi|eom|eof|ok(?:ay)?|done|fixed|yes|no|lgtm|merged|closed|open|-|\.|x|\+1|end|ende|fin|wontfix|duplicate|invalid|test)$", re.I)
_VERSION = re.compile(r"(?i)\b(?:version|rev|v)\s*\d+\.$")
_STATEMENT_END = re.compile(r"(?:;|\bend\b[;.]?|\})\s*$", re.I)
_TOKENS = re.compile(r"```|~~~|`|\n\s*\n|<!--|-->|</?[A-Za-z][\w-]*(?:\s[^<>\n]*)?/?>|<[A-Za-z/!][^<>\n]*\Z|[()\[\]{}“”„«»「」『』（）]|(?<![\w])\"|\"")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "」": "「", "』": "『", "）": "（"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "p", "li", "td", "tr", "th", "dd", "dt"}


def open_marks(text: str) -> list[str]:
    """What the automaton has on its stack at the end: fences and tags of the text, the rest of its last paragraph."""
    fence, inline, comment = "", False, False
    tags: list[str] = []
    stack: list[str] = []
    for m in _TOKENS.finditer(text):
        t = m[0]
        if fence:
            if t == fence:
                fence = ""
            continue
        if comment:
            comment = t != "-->"
            continue
        if t in ("```", "~~~"):
            fence, inline = t, False
        elif t[0] in "\n":
            stack.clear()
            inline = False
        elif t == "`":
            inline = not inline
        elif inline:
            continue
        elif t == "<!--":
            comment = True
        elif t[0] == "<":
            if not t.endswith(">"):
                tags.append("<")
                continue
            name = re.match(r"</?([A-Za-z][\w-]*)", t)
            if name is None or t.endswith("/>") or name[1].lower() in _VOID:
                continue
            if t[1] == "/":
                if name[1] in tags:
                    while tags.pop() != name[1]:
                        pass
            else:
                tags.append(name[1])
        elif t in _PAIRS:
            if stack and (stack[-1] == _PAIRS[t] or t == "”" and stack[-1] == "„"):
                stack.pop()
        elif t == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            else:
                stack.append('"')
        elif t != "-->" and t != "}":
            stack.append(t)
    out = stack + (["`"] if inline else []) + (["<!--"] if comment else [])
    # only tags that the text closes elsewhere are markup; placeholders such as <name> are not
    out += [f"<{t}>" if t != "<" else t for t in tags if t == "<" or f"</{t}" in text]
    return out + ([fence] if fence else [])


def cut_reason(text: str | None, at_limit: bool, open_source: bool = False) -> str | None:
    """Why a text counts as cut; None for one that ends as its author meant. Null and blank texts are no cases."""
    if text is None:
        return None
    body = text.rstrip()
    if not body:
        return None
    if body.endswith("�") or _BROKEN.search(body[-12:]) and not re.search(r"\d\s?%$", body):
        return "broken"
    if MARKS.search(body[-60:]):
        return "mark"
    opened = open_marks(body)
    if opened and opened[-1] in ("```", "~~~"):
        return "fence"
    if any(x[0] == "<" for x in opened):
        return "markup"
    if _DOTS.search(body):
        return "mark" if at_limit else None
    line = body[body.rfind("\n") + 1 :].strip()
    if at_limit and _VERSION.search(line):
        return "sentence"  # cut inside a number such as 5.2
    if _TERMINATED.search(line) or body.endswith(("```", "~~~")):
        return "bracket" if at_limit and opened and opened[-1] in "([（「『“«" and not body.endswith(")") else None
    if at_limit:
        return "limit"
    if opened and opened[-1] in ("`", '"', "“", "«", "「", "『", "（", "("):
        return "bracket"
    if _LIST.match(line):
        return "list" if _cut_entry(body, line) else None
    words = line.split()
    if _LINK.search(line) or _ALONE.match(line) or _HEADING.match(line) or _SIGN.match(line) or _STATEMENT_END.search(line):
        return None
    if len(words) <= 9 and _STATUS.match(line) and not line.endswith((":", "：", ",")):
        return None
    paragraph = [x.strip() for x in body[body.rfind("\n\n") + 1 :].strip().split("\n")]
    if len(paragraph) <= 3 and sum(len(x.split()) for x in paragraph) <= 9 and any(FAREWELL.match(x) for x in paragraph):
        return None
    return None if open_source else "sentence"


def _cut_entry(body: str, line: str) -> bool:
    """A last list entry that lacks what all entries before it share."""
    before = []
    for x in reversed(body.split("\n")[:-1]):
        if not _LIST.match(x):
            break
        before.append(x.strip())
    if line.endswith((",", "(", ".", "_", "-", "/", "=")) and not any(x[-1] == line[-1] for x in before):
        return True
    if not before:
        return False
    for mark in (".", ":", ")", ";", "`"):
        if all(mark in x[2:] for x in before) and mark not in line[2:]:
            return True
    return False


def ends_openly(text: Column) -> Column:
    """JVM-side: a text without a final terminator, closing fence or the like; dots count as open."""
    t = F.rtrim(text)
    return ~F.coalesce(t.rlike(r"(?s)[.!?。！？]['\"”’»)\]]*$"), F.lit(True)) | F.coalesce(t.rlike(r"(?:\.\.\.|…)(?:\s*\[\w+\])?$"), F.lit(False))


def field_limits(documents: DataFrame, share: float = LIMIT_SHARE, least: int = LIMIT_ROWS) -> DataFrame:
    """``(source, unit, size, rows)``: lengths at which texts of a source pile up with open ends.

    Hardly any text of the source may be longer. Rows are counted by length before any exchange; at most
    ``1 / share`` lengths a source and unit are candidates, and every length adds to those below it, so that
    no source is sorted in one task. Null sources form a source of their own.
    """
    return _limits(checkpointed(_lengths(documents)), share, least)


def _lengths(documents: DataFrame) -> DataFrame:
    """``(source, unit, size, rows, all)``: texts of every length, and those of them that end openly."""
    d = documents.where(F.length("text") > 0).select(F.coalesce("source", F.lit("")).alias("source"), F.length("text").alias("c"), F.octet_length("text").alias("b"), ends_openly(F.col("text")).alias("open"))
    sizes = d.select("source", "open", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("c").alias("size")), F.struct(F.lit("b").alias("unit"), F.col("b").alias("size")))).alias("x"))
    return sizes.groupBy("source", "x.unit", "x.size").agg(F.count_if("open").alias("rows"), F.count("*").alias("all"))


def _limits(counts: DataFrame, share: float, least: int) -> DataFrame:
    by = ["source", "unit"]
    totals = counts.groupBy(*by).agg(F.sum("rows").alias("total"))
    piled = counts.join(totals, by).where(F.col("rows") >= F.greatest(F.lit(least), F.col("total") * share))
    piled = piled.groupBy(*by).agg(F.collect_list(F.struct("size", "rows")).alias("piled"))
    below = F.transform("piled", lambda p: F.struct(p["size"].alias("size"), p["rows"].alias("rows"), F.when(p["size"] < F.col("size"), F.col("all")).otherwise(0).alias("longer")))
    longer = counts.join(piled, by).select(*by, F.explode(below).alias("p")).groupBy(*by, "p.size", "p.rows").agg(F.sum("p.longer").alias("longer"))
    return longer.where(F.col("longer") <= F.col("rows") * LONGER).select(*by, "size", "rows")


def truncated_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, reason)`` of cut texts; null and blank texts are no cases, repeated rows repeat.

    The limits are joined as one small row a source (a map of sizes), by broadcast while they are small.
    """
    counts = checkpointed(_lengths(documents))  # a row a length: used several times below
    way = counts.where(F.col("unit") == "c").groupBy("source").agg(((F.sum("all") >= NORM_ROWS) & (F.sum("rows") >= NORM_SHARE * F.sum("all"))).alias("open_source"))
    limits = _limits(counts, LIMIT_SHARE, LIMIT_ROWS).groupBy("source").agg(F.collect_set(F.when(F.col("unit") == "c", F.col("size"))).alias("chars"), F.collect_set(F.when(F.col("unit") == "b", F.col("size"))).alias("bytes"))
    d = documents.where(F.length("text") > 0).select("doc_id", "source", F.coalesce("source", F.lit("")).alias("s"), "text")
    d = d.join(maybe_broadcast(way.join(limits, "source", "left").withColumnRenamed("source", "s")), "s", "left")
    # a cut in bytes may leave out up to three bytes of a broken character
    near = F.exists("bytes", lambda x: F.octet_length("text").between(x - 3, x) & (F.octet_length("text") > F.length("text")))
    at = F.coalesce(F.array_contains("chars", F.length("text")), F.lit(False)) | F.coalesce(F.array_contains("bytes", F.octet_length("text")), F.lit(False)) | F.coalesce(near, F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            reasons = [cut_reason(t, a, bool(o)) for t, a, o in zip(b["text"], b["at_limit"], b["open_source"])]
            out = pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "reason": pd.Series(reasons, dtype=object)})
            yield out[out["reason"].notna()]

    return d.select("doc_id", "source", "text", at.alias("at_limit"), F.coalesce("open_source", F.lit(False)).alias("open_source")).mapInPandas(run, "doc_id long, source string, reason string")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """Per source: documents with text, cut ones, and the rate."""
    cut = truncated_documents(documents).groupBy("source").agg(F.count("*").alias("truncated"))
    whole = documents.where(F.length("text") > 0).groupBy("source").agg(F.count("*").alias("documents"))
    out = whole.join(cut, whole["source"].eqNullSafe(cut["source"]), "left").select(whole["source"], "documents", F.coalesce("truncated", F.lit(0)).alias("truncated"))
    return out.withColumn("rate", F.col("truncated") / F.col("documents"))
