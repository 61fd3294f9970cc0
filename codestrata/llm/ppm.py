"""Prediction by partial matching over characters, one adaptive-order context tree per class.

A symbol is predicted in the longest context seen in training; an unseen one escapes to the next shorter
context (escape method C: the number of distinct successors over it plus the count), at last to a uniform
alphabet. ``Scorer`` keeps the cost vector of every (context, symbol) it has met, so that text of the same
language is scored by one table look-up a character.
"""

from __future__ import annotations

import math
import numpy as np

ORDER = 4
ALPHABET = 8192
CACHE = 400_000
#: Counts stop here, so that often repeated sentences do not make a context blind to anything else.
MOST_COUNT = 6


def normalised(text: str) -> str:
    """Lower case; digits become 0, runs of white space one blank."""
    out = "".join("0" if c.isdigit() else c for c in text.lower())
    return " ".join(out.split())


class ContextTree:
    """Counts of successors of every context up to ``order`` characters."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.next: dict[str, dict[str, int]] = {}

    def add(self, text: str) -> None:
        padded = " " * self.order + text
        table = self.next
        for i in range(self.order, len(padded)):
            c = padded[i]
            for k in range(self.order + 1):
                row = table.setdefault(padded[i - k : i], {})
                row[c] = min(MOST_COUNT, row.get(c, 0) + 1)

    def cost(self, context: str, symbol: str) -> float:
        """Bits for ``symbol`` behind ``context``."""
        bits = 0.0
        for k in range(len(context), -1, -1):
            row = self.next.get(context[len(context) - k :])
            if row is None:
                continue
            total, distinct = sum(row.values()), len(row)
            n = row.get(symbol)
            if n:
                return bits + math.log2((total + distinct) / n)
            bits += math.log2((total + distinct) / distinct)
        return bits + math.log2(ALPHABET)


def train(samples: dict[str, list[str]], order: int = ORDER) -> dict[str, ContextTree]:
    trees: dict[str, ContextTree] = {}
    for name in sorted(samples):
        t = trees[name] = ContextTree(order)
        for s in samples[name]:
            t.add(normalised(s))
    return trees


class Scorer:
    """Cross-entropy of a text under each tree, in bits a character."""

    def __init__(self, trees: dict[str, ContextTree]):
        self.names = sorted(trees)
        self.trees = [trees[n] for n in self.names]
        self.order = max((t.order for t in self.trees), default=0)
        self.rows: dict[str, int] = {}
        self.costs = np.zeros((4096, len(self.names)), dtype=np.float32)

    def row(self, gram: str) -> int:
        i = len(self.rows)
        if i >= CACHE:
            self.rows.clear()
            i = 0
        if i >= len(self.costs):
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        self.costs[i] = [t.cost(gram[:-1], gram[-1]) for t in self.trees]
        self.rows[gram] = i
        return i

    def entropies(self, text: str) -> np.ndarray:
        """Per class; an empty text costs nothing."""
        text = normalised(text)
        if not text:
            return np.zeros(len(self.names), dtype=np.float32)
        if len(self.rows) + len(text) >= CACHE:
            self.rows.clear()
        padded, w, get, row = " " * self.order + text, self.order + 1, self.rows.get, self.row
        at = []
        for i in range(len(text)):
            gram = padded[i : i + w]
            j = get(gram)
            at.append(row(gram) if j is None else j)
        return self.costs[at].mean(axis=0)
