"""Problem 7: filling containers of fixed capacity with documents, by hierarchical residual packing.

Sizes are tokens of a public tokenizer. A document larger than a container is cut into full containers and
a rest; nothing else is ever split. Every partition first packs its own items best-fit decreasing, for all
capacities in one pass. Bins that are nearly full are final; the others become items of the next round,
in which fewer partitions, each of bounded size, pack them again. The last round emits all that is left.
Only (key, size) rows of underfull bins are ever shuffled between rounds.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.session import checkpointed, maybe_broadcast

#: Where the public vocabularies lie, and the one used here; both are parameters of the operators.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fill from which a bin of a round is final; the last round takes all.
NEARLY_FULL = (0.99, 0.97, 0.94, 0.0)
#: Items packed together at most.
TASK_ITEMS = 200_000
#: Texts are tokenised in pieces of about so many characters, so that very long ones stay linear.
CHUNK = 100_000

BIN = "window_id long, key string, bin string, fill long, final boolean"
ITEM = "doc_id long, piece int, tokens long"


def tokenizer(folder: str, name: str):
    """The tokenizer of a ``.tiktoken`` file of ranks, without special tokens.

    The folder must be the same on every executor, or hold a file handed out by ``SparkContext.addFile``.
    """
    import tiktoken

    with open(Path(folder) / name, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Borders of the splitting pattern that no context moves: white space behind anything else, letters beside digits.
_BORDER = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Pieces whose tokens together are those of the text; one without a border stays whole."""
    at = 0
    while len(text) - at > size and (m := _BORDER.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def document_sizes(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``(doc_id, tokens)`` of every row, repeated rows included; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(folder, name)
        for b in batches:
            sizes = [sum(len(t.encode_ordinary(c)) for c in chunks(x)) if x else 0 for x in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": pd.Series(sizes, dtype="int64")})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, tokens long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """Best-fit decreasing: the bin of each item and the fill of each bin. No size exceeds the capacity."""
    place, fill = [0] * len(sizes), []
    residuals: list[int] = []  # distinct residuals of open bins, ascending
    open_bins: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect_left(residuals, s)
        if at < len(residuals):
            r = residuals[at]
            bins = open_bins[r]
            b = bins.pop()
            if not bins:
                del open_bins[r]
                del residuals[at]
            fill[b] += s
        else:
            r, b = capacity, len(fill)
            fill.append(s)
        place[i] = b
        rest = r - s
        if rest:
            if rest not in open_bins:
                open_bins[rest] = []
                insort(residuals, rest)
            open_bins[rest].append(b)
    return place, fill


def _round(items: DataFrame, number: int, carried: str = "") -> DataFrame:
    """Pack the ``(window_id, capacity, key, size)`` rows of every partition by themselves, at most ``TASK_ITEMS`` together.

    Only the first round may see more rows in a partition; its rows come in the order of a written table, so
    that a task that is run again cuts them at the same places.
    """
    threshold = NEARLY_FULL[number]
    more = [c.split()[0] for c in carried.split(", ") if c]

    def pack(frames: list[pd.DataFrame], block: str) -> Iterator[pd.DataFrame]:
        # sorted by key first: the same rows give the same bins if a task is run again
        all_rows = pd.concat(frames, ignore_index=True).sort_values(["window_id", "key"], kind="stable", ignore_index=True)
        for window, rows in all_rows.groupby("window_id", sort=False):
            capacity = int(rows["capacity"].iloc[0])
            place, fill = best_fit(rows["size"].to_numpy(), capacity)
            filled = np.array(fill, dtype="int64")[place]
            out = {"window_id": window, "key": rows["key"].to_numpy(), "bin": [f"{block}.{p}" for p in place], "fill": filled, "final": filled >= threshold * capacity}
            yield pd.DataFrame(out | {c: rows[c].to_numpy() for c in more})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, block, frames, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            if size and size + len(b) > TASK_ITEMS and number == 0:
                yield from pack(frames, f"{number}.{part}.{block}")
                block, frames, size = block + 1, [], 0
            if len(b):
                frames.append(b)
                size += len(b)
        if frames:
            yield from pack(frames, f"{number}.{part}.{block}")

    return items.select("window_id", "capacity", "key", "size", *more).mapInPandas(run, f"{BIN}, {carried}" if carried else BIN)


def packed(documents: DataFrame, windows: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``(window_id, container, position, doc_id, piece, tokens)`` for every document row and window.

    ``piece`` counts from 0 and is above it only for documents larger than the container; ``container`` is
    unique within its window; ``position`` counts from 0 by document and piece. Null and empty texts take
    one token's room, so that no container holds an unbounded number of them, and show 0 tokens. Windows
    without a positive capacity get no rows; an empty table gives none.
    """
    sizes = document_sizes(documents, folder, name).withColumn("row", F.monotonically_increasing_id())
    sizes = checkpointed(sizes)  # keys must not change when a task is run again
    w = windows.where(F.col("capacity_tokens") > 0).groupBy("window_id").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    pairs = sizes.crossJoin(maybe_broadcast(w))  # a stated set of windows against all rows
    room = F.greatest("tokens", F.lit(1))
    count = F.ceil(room / F.col("capacity"))
    pieces = pairs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    pieces = pieces.withColumn("size", F.least("capacity", room - F.col("piece") * F.col("capacity")))
    pieces = pieces.select("window_id", "capacity", F.concat_ws("/", "row", "piece").alias("key"), "size", "doc_id", F.col("piece").cast("int").alias("piece"), F.least("size", "tokens").alias("tokens"))

    rounds, source = [], pieces
    for number in range(len(NEARLY_FULL)):
        # the first round carries what the result needs, so that nothing is joined back to it
        done = checkpointed(_round(source, number, "" if number else ITEM))
        rounds.append(done)
        if number + 1 == len(NEARLY_FULL):
            break
        left = done.where(~F.col("final")).groupBy("window_id", F.col("bin").alias("key")).agg(F.max("fill").alias("size"))
        left = left.join(maybe_broadcast(w), "window_id")
        n = left.count()
        if n == 0:
            break
        # a merge of eight partitions into one where that stays within a task's bound
        parts = max(1, -(-n // TASK_ITEMS), min(done.rdd.getNumPartitions() // 8, n // 1000))
        source = left.repartition(parts, "key")

    # bins of bins: follow what was not final to the bin that took it
    of_bin = None
    for r in reversed(rounds[1:]):
        step = r.select("window_id", F.col("key").alias("bin"), F.col("bin").alias("next"))
        if of_bin is not None:
            upper = of_bin.select("window_id", F.col("bin").alias("next"), F.col("container").alias("upper"))
            step = step.join(upper, ["window_id", "next"], "left").withColumn("next", F.coalesce("upper", "next"))
        of_bin = step.select("window_id", "bin", F.col("next").alias("container"))
    columns = ["window_id", "container", "doc_id", "piece", "tokens", "key"]
    placed = rounds[0].where("final").withColumn("container", F.col("bin")).select(*columns)
    moved = rounds[0].where("NOT final")
    moved = moved.join(of_bin, ["window_id", "bin"], "left").withColumn("container", F.coalesce("container", "bin")) if of_bin is not None else moved.withColumn("container", F.col("bin"))
    every = placed.unionByName(moved.select(*columns))
    # a container holds at most its capacity in items, so this window is bounded
    order = W.partitionBy("window_id", "container").orderBy("doc_id", "piece", "key")
    return every.withColumn("position", F.row_number().over(order) - 1).select("window_id", "container", "position", "doc_id", "piece", "tokens")


def utilisation(documents: DataFrame, windows: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Per window: containers, their least possible number, tokens, and the share of room that is used."""
    p = packed(documents, windows, folder, name)
    w = windows.select("window_id", F.col("capacity_tokens").alias("capacity"))
    per = p.groupBy("window_id", "container").agg(F.sum("tokens").alias("tokens"))
    out = per.groupBy("window_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens")).join(maybe_broadcast(w), "window_id")
    return out.select("window_id", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used"))


