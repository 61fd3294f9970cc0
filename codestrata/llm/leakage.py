"""Problem 8: passages of evaluation items inside documents, by greedy string tiling.

Words (letters and digits, case folded) of every passage get ids. A document's word ids are hashed in
windows of ``SEED`` words with a Karp-Rabin rolling hash; windows that a passage shares are the seeds of
matches, which grow to both sides. The longest matches are marked first and never overlap (tiles), in
descending length down to ``SEED`` words. A document leaks an item if

* tiles that follow each other without a gap in the passage and stand in order in the document make up at
  least ``RUN`` words (so a quotation may be interrupted by other text), or
* tiles, with single replaced words between them filled in, cover ``COVERAGE`` of the passage, in any order.

Evaluation items are a stated query set that does not grow with the documents. The driver reads their passages
once, each distinct one kept once; they are broadcast in blocks of at most ``BLOCK_CHARS`` and one passage, and each
block is run against all documents.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.shared import Model

SEED, RUN, COVERAGE = 4, 20, 0.88
#: Characters of passages held in memory at a time; more items make more blocks.
BLOCK_CHARS = 16_000_000

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(1_000_003)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def passage_of(text: str | None) -> str:
    """The middle of instruction, passage and question, which blank lines separate."""
    parts = [p for p in re.split(r"\n[ \t\r]*\n", (text or "").strip()) if p.strip()]
    if len(parts) >= 3:
        return "\n\n".join(parts[1:-1])
    return parts[-1] if parts else ""


class Index:
    """Passages of one block: word ids, and seeds by rolling hash."""

    def __init__(self, passages: dict[str, list[int]]):
        self.owners = list(passages.values())
        self.vocabulary: dict[str, int] = {}
        self.ids: list[list[int]] = []
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, text in enumerate(passages):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            self.ids.append(ids)
            for i, h in enumerate(rolling(np.array(ids, dtype=np.uint64)).tolist()):
                seeds[h].append((p, i))
        self.seeds = dict(seeds)
        self.sorted = np.array(sorted(seeds), dtype=np.uint64)


def rolling(ids: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all windows of SEED ids, in arithmetic modulo 2 ** 64."""
    n = len(ids) - SEED + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SEED):
            out = out * _BASE + ids[j : j + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def tiles(passage: list[int], text: list[int], seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Greedy tiling: ``(start in passage, start in text, length)``, longest first, none overlapping."""
    starts = set(seeds)
    matches: list[tuple[int, int, int]] = []
    for i, j in seeds:
        if (i - 1, j - 1) in starts:
            continue  # inside a match that starts earlier
        if passage[i : i + SEED] != text[j : j + SEED]:
            continue  # hash collision
        n = SEED
        while i + n < len(passage) and j + n < len(text) and passage[i + n] == text[j + n]:
            n += 1
        matches.append((n, i, j))
    used_p, used_t = bytearray(len(passage)), set()
    by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n, i, j in matches:
        by_length[n].append((i, j))
    out = []
    for n in range(max(by_length, default=0), SEED - 1, -1):
        for i, j in sorted(by_length.pop(n, ())):
            free, k = [], 0
            while k < n:  # the parts of the match that no longer tile has taken
                a = k
                while k < n and not used_p[i + k] and (j + k) not in used_t:
                    k += 1
                if k > a:
                    free.append((a, k - a))
                k += 1
            for a, m in free:
                if m == n:
                    out.append((i, j, n))
                    used_p[i : i + n] = b"\x01" * n
                    used_t.update(range(j, j + n))
                elif m >= SEED:
                    by_length[m].append((i + a, j + a))
    return out


def leaks(passage: list[int], text: list[int], seeds: list[tuple[int, int]]) -> bool:
    found = tiles(passage, text, seeds)
    if not found:
        return False
    found.sort(key=lambda t: t[1])
    # a quotation that other text interrupts: tiles adjacent in the passage, in order in the document
    best: dict[int, tuple[int, int]] = {}  # passage end → (words so far, text end)
    for i, j, n in found:
        before = best.get(i)
        total = n + (before[0] if before and before[1] <= j else 0)
        if total >= min(RUN, len(passage)):
            return True
        if best.get(i + n, (0, 0))[0] <= total:
            best[i + n] = (total, j + n)
    covered = bytearray(len(passage))
    for i, _, n in found:
        covered[i : i + n] = b"\x01" * n
    # replaced words: equal words at equal distance from a tile, as long as two of three words agree
    for i, j, n in found:
        for step, (a, b) in ((1, (i + n, j + n)), (-1, (i - 1, j - 1))):
            wrong = right = 0
            while 0 <= a < len(passage) and 0 <= b < len(text) and not covered[a] and wrong <= 1 + right // 2:
                if passage[a] == text[b]:
                    covered[a] = 1
                    right += 1
                else:
                    wrong += 1
                a += step
                b += step
    return sum(covered) >= COVERAGE * len(passage)


def _blocks(items: DataFrame) -> list[dict[str, list[int]]]:
    """Distinct passages with the ids they occur under, in blocks of bounded size, read one row at a time."""
    out: list[dict[str, list[int]]] = [{}]
    size, where = 0, {}
    for r in items.select("item_id", "text").where(F.col("item_id").isNotNull()).orderBy("item_id").toLocalIterator():
        p = " ".join(words(passage_of(r["text"])))
        if not p:
            continue
        if p in where:
            if r["item_id"] not in where[p][p]:
                where[p][p].append(r["item_id"])
            continue
        if size > BLOCK_CHARS:
            out.append({})
            size = 0
        out[-1][p] = [r["item_id"]]
        where[p] = out[-1]
        size += len(p)
    return out


def _scan(documents: DataFrame, passages: dict[str, list[int]]) -> DataFrame:
    model = Model(documents.sparkSession, pickle.dumps(Index(passages), protocol=5))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = model.load(lambda x: x)
        get, known = index.vocabulary.get, index.sorted
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = [get(w, 0) for w in words(text)]
                if len(ids) < SEED:
                    continue
                h = rolling(np.array(ids, dtype=np.uint64))
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                hits = np.nonzero(known[at] == h)[0] if len(known) else []
                if len(hits) == 0:
                    continue
                seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for j in hits.tolist():
                    for p, i in index.seeds[int(h[j])]:
                        seeds[p].append((i, j))
                for p, s in seeds.items():
                    if leaks(index.ids[p], ids, s):
                        rows += [(item, doc) for item in index.owners[p]]
            yield pd.DataFrame(rows, columns=["item_id", "doc_id"]).astype({"item_id": "int64", "doc_id": "int64"})

    kept = documents.where((F.length("text") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    return kept.mapInPandas(run, "item_id long, doc_id long")


def leaked_pairs(items: DataFrame, documents: DataFrame) -> DataFrame:
    """``(item_id, doc_id)``: documents that hold the passage of an item or a long part of it.

    A passage under several item ids counts for each. Null ids, null or empty texts and items without a
    passage give no rows; repeated documents repeat their rows. One scan of the documents a block of
    items, no shuffle.
    """
    scans = [_scan(documents, block) for block in _blocks(items)]
    return reduce(DataFrame.unionAll, scans)


def leaked_items(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Per leaked item: the number of documents that hold it."""
    return leaked_pairs(items, documents).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))
