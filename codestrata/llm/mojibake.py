"""Problem 4: passages garbled by wrong decoding, found and, where nothing was lost, restored.

1. Pair statistics: how often each character and each adjacent pair with a non-ASCII character occurs in
   the whole corpus, without stretches that have the form of a wrong decoding (``formed``): however common
   a garbling is, it never counts as good text. All pairs count, in a table of ``SLOTS`` hashed places: its
   size is the same for every corpus, and two of very many rare pairs may share a place.
2. Every adjacent pair of a line gets its pointwise mutual information, shrunk by its support; maximum-scoring
   segments of what is missing to ``EXPECTED`` isolate improbable runs.
3. Only inside those runs inverse mappings are tried: encode with the encoding the bytes were read as, decode
   with the one they were in, up to three times over. A mapping is believed if the corpus predicts its result by far
   more than the run. A run that holds replacement characters or C1 controls is garbled without a mapping.

Sequences quoted on purpose (a literal that is nothing but the sequence) and rare but correct characters,
which no mapping explains, are left alone.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.shared import Model

#: Places of the pair table (8 bytes each), and the share of all pairs from which a place counts as known.
SLOTS, KNOWN_SHARE = 1 << 21, 1e-7
#: Shrunken mutual information expected of a pair in good text, in bits; support at which half of it counts.
EXPECTED, HALF_SUPPORT = 2.0, 1e-3
#: Bits a mapping must gain over a run: in all, and a character of the run.
GAIN, GAIN_PER_CHAR = 9.0, 1.2
#: Bits a character beyond which a mapping's result is no text, and the share of its pairs the corpus must know.
MOST_BITS, KNOWN_PAIRS = 11.0, 0.6

# Names of encodings. What bytes were read as, and what they were in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_5", "gb18030", "gbk", "big5", "cp950", "cp932", "euc_jp", "cp949", "cp1253", "cp1254", "cp1257")
WERE_IN = ("utf-8", "cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "gb18030", "big5", "cp932", "euc_jp", "cp949", "cp850", "cp437", "cp852", "mac_roman", "mac_cyrillic")
_SAME = ({"gbk", "gb18030"}, {"big5", "cp950"})
_MULTI = {"utf-8", "gb18030", "gbk", "big5", "cp950", "cp932", "euc_jp", "cp949"}
_C1 = {i: chr(i) for i in range(0x80, 0xA0)}

_RUN = re.compile(r".?[^\x00-\x7f]+(?:[\x00-\x7f]{1,2}[^\x00-\x7f]+)*.?")
_LOST = re.compile(r"�|[\x80-\x84\x86-\x9f]")
_QUESTION = re.compile(r"(?<![\w?=&/.:])[^\W\d_]*(?:[^\W\d_]\?+[^\W\d_])[^\W\d_]*(?![\w(=&/:.])")
_PRIVATE = re.compile("[\ue000-\uf8ff]")
_TWICE = re.compile(r"[Ã-ü][\x80-¿ŒœŠšŸŽžƒˆ˜–-—‘-‚“-„†-‡•…‰‹›€™]")
#: A question mark in place of a lost letter, in a line that was garbled.
_ASKED = re.compile(r"\?(?!\w+=)(?:[^\W\d_]|[^\x00-\x7f])")
_QUOTED = re.compile(r"(['\"`])([^'\"`\n]{1,8})\1")


def _undefined_as_c1(raw: bytes, encoding: str) -> str:
    """``raw`` decoded by a single-byte encoding; undefined bytes come through as C1 controls."""
    return "".join(_C1.get(b, "") if (c := bytes([b]).decode(encoding, "ignore")) == "" else c for b in raw)


def _sequences(encoding: str) -> re.Pattern:
    """Well-formed UTF-8 of two to four bytes, each byte read as ``encoding``."""
    of = lambda a, b: "[" + re.escape(_undefined_as_c1(bytes(range(a, b)), encoding)) + "]"
    trail = of(0x80, 0xC0)
    return re.compile(f"{of(0xC2, 0xE0)}{trail}|{of(0xE0, 0xF0)}{trail}{{2}}|{of(0xF0, 0xF5)}{trail}{{3}}")


_SINGLE = tuple(e for e in READ_AS if e not in _MULTI)
_SEQUENCES = {e: _sequences(e) for e in _SINGLE}
#: Characters that a sequence of UTF-8 may stand for: the scripts and marks of ordinary text.
_ORDINARY = re.compile("[\x80-\u017f\u0391-\u03ce\u0400-\u045f\u0490\u0491\u2010-\u2044\u20ac\u2116\u2122\u2190-\u2193\u2212\u2500-\u257f\u3000-\u30ff\u3400-\u9fff\uac00-\ud7a3\ufe30-\ufe4f\uff00-\uffef\U0001f300-\U0001faff]+")
_STRETCH = re.compile(r"[^\x00-\x7f]{3,}")
#: Letters and marks of one byte in Western encodings; words of four or more in a row are bytes of another one.
_WESTERN = re.compile("[\x80-ÿŒœŠšŸŽžƒˆ˜–-—‘-‚“-„†-‡•…‰‹›€™]{4,}")
_MIXED = re.compile("[A-Za-z][\u0400-\u045f\u0391-\u03ce]|[\u0400-\u045f\u0391-\u03ce][A-Za-z]")


#: A Russian word in which the case of every letter is turned round: KOI8 against Windows.
_TURNED = re.compile(r"(?<![^\W\d_])[а-яё][А-ЯЁ]{2,}(?![^\W\d_])")
#: A Cyrillic word with parts of boxes and other marks of DOS encodings in it: Windows against DOS.
_DRAWN = re.compile("[\u0400-\u045f][\u2500-\u257f∙√¤]|[\u2500-\u257f∙√¤][\u0400-\u045f]")
_KANA = re.compile("[\u3040-\u30ff]")


@lru_cache(maxsize=50_000)
def formed(text: str) -> tuple[tuple[int, int], ...]:
    """Spans that have the form of a wrong decoding, whatever the corpus holds.

    UTF-8 read as an encoding of one byte (the sequence is well-formed) or of several (three characters or more
    are well-formed together), long rows of different Western letters and marks, letters of two scripts side by side,
    Russian with its case turned round or with lines of boxes inside its words, ideographs that are kana in the bytes
    of Japanese, characters for private use, and those that stand for lost bytes.
    """
    if _TURNED.search(text) or _DRAWN.search(text):
        return ((0, len(text)),)
    spans = [m.span() for p in (_LOST, _PRIVATE) for m in p.finditer(text)]
    for encoding, pattern in _SEQUENCES.items():
        for m in pattern.finditer(text):
            after = decoded(m[0], encoding, "utf-8")
            if after and _ORDINARY.fullmatch(after):
                spans.append(m.span())
    spans += [m.span() for m in _WESTERN.finditer(text) if len(set(m[0])) > 2]
    spans += [m.span() for m in _MIXED.finditer(text)]
    for m in _STRETCH.finditer(text):
        for encoding in _MULTI - {"utf-8"}:
            try:
                raw = m[0].encode(encoding)
            except UnicodeEncodeError:
                continue
            try:
                after = raw.decode("utf-8")
            except UnicodeDecodeError as e:
                if e.reason != "unexpected end of data" or e.start < 4:
                    continue  # the last bytes may have gone into the ASCII behind
                after = raw[: e.start].decode("utf-8")
            if _ORDINARY.fullmatch(after):
                spans.append(m.span())
                break
        if _KANA.search(m[0]) is None:
            for encoding in ("gb18030", "big5", "cp949"):
                after = decoded(m[0], encoding, "cp932")
                if after and len(_KANA.findall(after)) > 0.3 * len(after):
                    spans.append(m.span())
                    break
    return tuple(spans)


def slot(ab: str) -> int:
    """The place of a pair in the table."""
    x = (ord(ab[0]) * 0x9E3779B97F4A7C15 + ord(ab[1]) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ x >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 43


class Pairs:
    """Counts by pair over the hashed table."""

    def __init__(self, places: np.ndarray):
        self.places, self.total = places, int(places.sum())
        self.least = max(1.0, self.total * KNOWN_SHARE)
        self.seen: dict[str, int] = {}

    def get(self, ab: str) -> int:
        c = self.seen.get(ab)
        if c is None:
            if len(self.seen) >= 500_000:
                self.seen.clear()
            c = self.seen[ab] = int(self.places[slot(ab)])
        return c

    def __contains__(self, ab: str) -> bool:
        return self.get(ab) >= self.least


class Stats:
    """The corpus statistics in the form the scoring needs."""

    def __init__(self, single: dict[str, int], places: np.ndarray):
        self.single, self.pair = single, Pairs(places)
        self.n = max(1, sum(single.values()))
        self.pairs = max(1, self.pair.total)
        self.cost: dict[str, float] = {}
        #: bytes of each single-byte encoding that stand for characters of the corpus
        self.bytes_known = {e: bytes(b for b in range(256) if b < 128 or bytes([b]).decode(e, "ignore") in single) for e in WERE_IN if e not in _MULTI}

    def bits(self, text: str) -> float:
        """-log2 of the text's characters, each behind its predecessor; a flat rate between ASCII characters."""
        known, total = self.cost, 0.0
        for a, b in zip(text, text[1:]):
            if a < "\x80" and b < "\x80":
                total += 4.0
                continue
            c = known.get(a + b)
            if c is None:
                p = 0.9 * self.pair.get(a + b) / (self.single.get(a, 0) + 1) + 0.1 * (self.single.get(b, 0) + 0.01) / self.n
                c = -math.log2(p)
                if len(known) < 500_000:
                    known[a + b] = c
            total += c
        return total

    def association(self, ab: str) -> float:
        """Pointwise mutual information of the pair, shrunk towards 0 where its support is small."""
        c = self.pair.get(ab)
        if not c:
            return -4.0
        mi = math.log2(c * self.n / (self.single.get(ab[0], 1) * self.single.get(ab[1], 1)))
        support = c / self.pairs
        return mi * support / (support + HALF_SUPPORT)

    def known(self, text: str) -> bool:
        """Whether the corpus knows ``KNOWN_PAIRS`` of the pairs with a non-ASCII character."""
        pairs = [a + b for a, b in zip(text, text[1:]) if a > "\x7f" or b > "\x7f"]
        spare = (1 - KNOWN_PAIRS) * len(pairs)
        for p in pairs:
            if p not in self.pair:
                spare -= 1
                if spare < 0:
                    return False
        return bool(pairs)


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal-scoring segments with a positive sum (Ruzzo and Tompa), as half-open index ranges."""
    kept: list[list[float]] = []  # left sum, right sum, start, end
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        left, right, start = total, total + s, i
        total = right
        while True:
            j = next((k for k in range(len(kept) - 1, -1, -1) if kept[k][0] < left), -1)
            if j < 0 or kept[j][1] >= right:
                kept.append([left, right, start, i + 1])
                break
            left, start = kept[j][0], int(kept[j][2])
            del kept[j:]
    return [(int(k[2]), int(k[3])) for k in kept]


def _table(encoding: str) -> dict[int, str]:
    """Characters a single-byte encoding can stand for, and their bytes as characters; undefined bytes are C1 controls."""
    out = {}
    for b in range(256):
        c = bytes([b]).decode(encoding, "ignore") or (_C1.get(b, "") if encoding in ("cp1252", "cp1250", "cp1251", "cp1254") else "")
        if c:
            out.setdefault(ord(c), chr(b))
    return out


_TABLES = {e: _table(e) for e in _SINGLE}
_ENCODABLE = {e: frozenset(map(chr, t)) for e, t in _TABLES.items()}


def encoded(run: str, read_as: str) -> bytes | None:
    """The bytes that look like ``run`` when read as ``read_as``; None if there are none."""
    if read_as in _ENCODABLE:
        return run.translate(_TABLES[read_as]).encode("latin-1") if _ENCODABLE[read_as].issuperset(run) else None
    try:
        return run.encode(read_as)
    except UnicodeEncodeError:
        return None


def decoded(run: str, read_as: str, were_in: str) -> str | None:
    """The text whose bytes in ``were_in`` look like ``run`` when read as ``read_as``; None if there is none."""
    raw = encoded(run, read_as)
    try:
        return None if raw is None else raw.decode(were_in)
    except UnicodeDecodeError:
        return None


class Detector:
    def __init__(self, stats: Stats):
        self.stats = stats
        self.mapping = lru_cache(maxsize=100_000)(self._mapping)
        self.verdict = lru_cache(maxsize=200_000)(self._verdict)

    def runs(self, line: str) -> list[tuple[str, str]]:
        """Improbable runs of a line: its maximum-scoring segments, out to the ends of their words, each with the stretch it is in.

        Bytes of several-byte encodings may be ASCII: several runs are also one run from the first to the last.
        """
        found: list[tuple[int, int, str]] = []
        for m in _RUN.finditer(line):
            text, start = m[0], m.start()
            bad = [-0.5 if a < "\x80" and b < "\x80" else EXPECTED - self.stats.association(a + b) for a, b in zip(text, text[1:])]
            ends = [(a, b) for a, b in segments(bad) if sum(bad[a:b]) > EXPECTED]
            for a, b in ends:
                b += 1  # the segment's last pair ends one character on
                while a and text[a] > "\x7f":
                    a -= 1
                while b < len(text) and text[b - 1] > "\x7f":
                    b += 1
                if found and start + a < found[-1][1]:
                    found[-1] = (found[-1][0], max(found[-1][1], start + b), text)
                else:
                    found.append((start + a, start + b, text))
        out = [(line[a:b], stretch) for a, b, stretch in found]
        if len(found) > 1:
            out.append((line[found[0][0] : found[-1][1]],) * 2)
        return out

    def believed(self, run: str, stretch: str) -> tuple[str, str, str] | None:
        """The mapping of a run, unless it would make less likely text of the stretch around it."""
        m = self.mapping(run)
        if m and run != stretch:
            after = decoded(stretch, m[0], m[1])
            if after is not None and not _LOST.search(after) and self.stats.bits(f" {after} ") >= self.stats.bits(f" {stretch} "):
                return None
        return m

    def _mapping(self, run: str) -> tuple[str, str, str] | None:
        """The believed mapping ``(read as, were in, restored)`` of a run, with the most gain."""
        raws: dict[bytes, str] = {}
        for read_as in READ_AS:
            raw = encoded(run, read_as)
            if raw is not None:
                raws.setdefault(raw, read_as)
        results: dict[str, tuple[str, str]] = {}
        for raw, read_as in raws.items():
            odd = len(raw.translate(None, _ASCII))
            # pairs with a character above ASCII: each such byte begins one, each row of them one more
            spare = (1 - KNOWN_PAIRS) * (odd + len(_HIGH.findall(raw)))
            for were_in in WERE_IN:
                if read_as == were_in or {read_as, were_in} in _SAME:
                    continue
                if were_in in self.stats.bytes_known and len(raw.translate(None, self.stats.bytes_known[were_in])) > spare:
                    continue  # too many characters that the corpus does not hold
                try:
                    after = raw.decode(were_in)
                except UnicodeDecodeError:
                    continue
                if after != run:
                    results.setdefault(after, (read_as, were_in))
        best, most, before, odd = None, GAIN, None, sum(c > "\x7f" for c in run)
        for after, (read_as, were_in) in results.items():
            by_chance = were_in != "utf-8" or read_as in _MULTI
            deeper = self._mapping(after) if not by_chance and _TWICE.search(after) else None
            result = deeper[2] if deeper else after
            if not self.stats.known(f" {result} ") or _LOST.search(result) or _PRIVATE.search(result):
                continue
            before = self.stats.bits(f" {run} ") if before is None else before
            cost = self.stats.bits(f" {result} ")
            gain = before - cost + (0 if by_chance else 4 * sum(c > "\x7f" for c in result))  # UTF-8 is hardly ever well-formed by chance
            if gain > most and gain > GAIN_PER_CHAR * odd and cost <= MOST_BITS * (len(result) + 1):
                best, most = (read_as, were_in, result), gain
        return best

    def _verdict(self, line: str) -> bool:
        quoted = {m[2] for m in _QUOTED.finditer(line) if not m[2].isascii() and not re.search(r"[A-Za-z]", m[2])}
        body = line
        for q in quoted:
            body = re.sub(rf"(['\"`]){re.escape(q)}\1", "", body)
        if body.isascii():
            return self.questioned(body) if "?" in body else False
        return any(_LOST.search(r) or self.believed(r, around) for r, around in self.runs(body))

    def questioned(self, line: str) -> bool:
        """Letters lost to question marks: inside a word, where some letter of the corpus fits on both sides."""
        if re.search(r"[;=(){}<>]|://|\bid\b", line):
            return False
        for m in _QUESTION.finditer(line):
            for q in re.finditer(r"([^\W\d_])(\?+)([^\W\d_])", m[0]):
                if any(self.stats.pair.get(q[1] + x) and self.stats.pair.get(x + (q[3] if len(q[2]) == 1 else x)) for x in self._letters()):
                    return True
        return False

    def _letters(self) -> list[str]:
        if not hasattr(self, "_odd"):
            self._odd = [c for c in self.stats.single if c > "\x7f" and c.isalpha() and ord(c) < 0x250]
        return self._odd

    def garbled(self, text: str) -> bool:
        if text.isascii() and "?" not in text:
            return False
        for line in text.split("\n"):
            if (not line.isascii() or "?" in line and _QUESTION.search(line)) and self.verdict(re.sub(r"\d+", "0", line.strip())):
                return True
        return False

    def repaired(self, text: str) -> str | None:
        """The original text if one mapping turns all of it back without loss; else line by line; else None.

        Line by line, a mapping believed anywhere in the record is applied to every run and sequence it decodes.
        """
        if _LOST.search(text) and not re.search(r"[\x80-\x9f]", text):
            return None
        lines = text.split("\n")
        maps: Counter = Counter()
        for line in lines:
            if not line.isascii():
                for m in [m for r, around in self.runs(line) if (m := self.believed(r, around))]:
                    maps[m[:2]] += 1
        for (read_as, were_in), _ in maps.most_common(3):
            whole = decoded(text, read_as, were_in)
            for _ in range(2):  # decoded twice
                if whole is not None and self.garbled(whole):
                    whole = decoded(whole, read_as, were_in)
            if whole is not None and not self.garbled(whole) and not self.left_over(whole, maps):
                return None if _asked(lines, whole.split("\n")) else whole
        if not maps:
            return None
        after = [line if line.isascii() else self.repaired_line(line, maps) for line in lines]
        if _asked(lines, after):
            return None
        whole = "\n".join(after)
        return None if self.garbled(whole) or self.left_over(whole, maps) else whole

    def repaired_line(self, line: str, maps: Counter) -> str:
        """The line with every run put right, quoted sequences aside; as often as a run was decoded wrongly."""
        for _ in range(3):
            before, kept = line, _quoted_spans(line)

            def put_right(m: re.Match) -> str:
                inside = any(a < m.end() and m.start() < b for a, b in kept)
                return m[0] if inside else self.repaired_run(m[0], maps)

            line = _RUN.sub(put_right, line)
            if line == before:
                break
        return line

    def repaired_run(self, run: str, maps: Counter) -> str:
        if m := self.mapping(run):
            return m[2]
        for (read_as, were_in), _ in maps.most_common():
            if were_in == "utf-8" and read_as in _SEQUENCES:
                run = _SEQUENCES[read_as].sub(lambda m: _ordinary(m[0], read_as) or m[0], run)
                continue
            after = decoded(run, read_as, were_in)
            # these succeed by chance as well: the corpus must hold the result for no less likely
            if after and after != run and not _LOST.search(after) and self.stats.bits(f" {after} ") < self.stats.bits(f" {run} "):
                return after
        return run

    def left_over(self, text: str, maps: Counter) -> bool:
        """Whether the text still holds what a believed mapping decodes or the first half of it, quoted sequences aside."""
        leads = {c for read_as, were_in in maps if were_in == "utf-8" and read_as in _SEQUENCES for c in _undefined_as_c1(b"\xc2\xc3\xc4\xc5", read_as)}
        for line in text.split("\n"):
            if line.isascii():
                continue
            if self.repaired_line(line, maps) != line:
                return True
            kept = _quoted_spans(line)
            for i, c in enumerate(line):
                if c in leads and not any(a <= i < b for a, b in kept) and _halved(line, i):
                    return True
        return False


def _asked(lines: list[str], after: list[str]) -> bool:
    """Whether a line that was put right still asks for a lost character."""
    return any(a != b and _ASKED.search(b) for a, b in zip(lines, after))


def _quoted_spans(line: str) -> list[tuple[int, int]]:
    """Where sequences are quoted on purpose: a literal that is nothing but the sequence."""
    return [m.span() for m in _QUOTED.finditer(line) if not m[2].isascii() and not re.search(r"[A-Za-z]", m[2])]


def _halved(line: str, i: int) -> bool:
    """Whether the first byte of a sequence has lost its second one: a capital behind a small letter, or a mark in or at a word."""
    c, before, behind = line[i], line[i - 1 : i], line[i + 1 : i + 2]
    if c.isupper():
        return before.islower() or c in "ÃĂ" and not before.isalpha() and not behind.isalpha()
    return not c.isalpha() and (before.isalpha() or behind.isalpha())


def _ordinary(sequence: str, read_as: str) -> str | None:
    """What a sequence of UTF-8 read as ``read_as`` stands for, if that is ordinary text."""
    after = decoded(sequence, read_as, "utf-8")
    return after if after and _ORDINARY.fullmatch(after) else None


def counted(c: Counter, text: str) -> None:
    """Adds the characters and pairs of a text to the statistics, without stretches that are ``formed``."""
    c.update(text)
    if text.isascii():
        return
    for m in _RUN.finditer(text):
        s = m[0]
        bad: set[int] = set()
        for a, b in formed(s):
            bad.update(range(a, b))
        if bad:
            c.subtract(s[i] for i in bad if s[i] > "\x7f")
        c.update(x + y for i, (x, y) in enumerate(zip(s, s[1:])) if (x > "\x7f" or y > "\x7f") and i not in bad and i + 1 not in bad)


_ASCII = bytes(range(128))
_HIGH = re.compile(rb"[\x80-\xff]+")


def pair_statistics(records: DataFrame, text: str = "content") -> DataFrame:
    """``(gram, place, n)``: counts of single characters, and by place of pairs with a non-ASCII one, over all rows.

    Counted within each Arrow batch before anything is shuffled; null and empty texts count nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for t in b[text]:
                counted(c, t)
            rows = [(None, slot(g), n) if len(g) == 2 else (g, None, n) for g, n in c.items() if n > 0]
            yield pd.DataFrame(rows, columns=["gram", "place", "n"]).astype({"place": "Int32", "n": "int64"})

    counts = records.where(F.length(text) > 0).select(text).mapInPandas(run, "gram string, place int, n long")
    return counts.groupBy("gram", "place").agg(F.sum("n").alias("n"))


def collected_statistics(records: DataFrame, text: str = "content") -> bytes:
    """The statistics for broadcasting: at most a row a character and ``SLOTS`` places, whatever the corpus holds."""
    got = pair_statistics(records, text).toPandas()
    single, pairs = got[got["gram"].notna()], got[got["gram"].isna()]
    places = np.zeros(SLOTS, dtype=np.int64)
    np.add.at(places, pairs["place"].to_numpy(dtype=np.int64), pairs["n"].to_numpy(dtype=np.int64))
    return pickle.dumps((dict(zip(single["gram"], single["n"].map(int))), zlib.compress(places.tobytes(), 1)), protocol=5)


def detector(single: dict[str, int], places: bytes) -> Detector:
    return Detector(Stats(single, np.frombuffer(zlib.decompress(places), dtype=np.int64)))


def garbled_records(records: DataFrame, repair: bool = False) -> DataFrame:
    """``(extractId)`` of records with a garbled passage; with ``repair`` also ``repairedContent``.

    ``repairedContent`` is null where bytes were lost. What the importer believed (encoding, warning) is not
    read. Null and empty contents give no rows; repeated rows repeat their results. Two scans: statistics,
    then detection; only the grouped statistics are shuffled.
    """
    kept = records.select("extractId", "content").where((F.length("content") > 0) & F.col("extractId").isNotNull())
    model = Model(records.sparkSession, collected_statistics(kept))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = model.load(lambda x: detector(*x))
        for b in batches:
            ids, texts = [], []
            for i, t in zip(b["extractId"], b["content"]):
                if d.garbled(t):
                    ids.append(i)
                    texts.append(d.repaired(t) if repair else None)
            out = pd.DataFrame({"extractId": pd.Series(ids, dtype="int64")})
            if repair:
                out["repairedContent"] = pd.Series(texts, dtype=object)
            yield out

    return kept.mapInPandas(run, "extractId long" + (", repairedContent string" if repair else ""))
