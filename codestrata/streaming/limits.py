"""Request limits in windows anchored at the first request of a key (not clock-aligned windows).

A window opens with a request and lasts ``seconds``; ``most`` requests pass in it, the others are refused;
the first request at or after its end opens the next one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def anchored_limit(requests: DataFrame, keys: Sequence[str], time: str, order: str, most: int, seconds: int) -> DataFrame:
    """``requests`` with ``allowed`` and ``windowStart`` (epoch microseconds); null times are left out.

    Rows are sorted within range partitions by the executor's external sort and folded as a stream of
    batches, so a key with a third of all rows never has to fit into memory.
    """
    df = requests.where(F.col(time).isNotNull()).withColumn("_us", F.unix_micros(F.col(time).cast("timestamp")))
    names = [*requests.columns]
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, "_us", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, count = None, 0, 0
        for b in batches:
            allowed, starts = [], []
            for row in zip(*[b[k] for k in keys], b["_us"]):
                key, us = row[:-1], row[-1]
                if key != current or us >= start + seconds * 1_000_000:
                    current, start, count = key, us, 0
                count += 1
                allowed.append(count <= most)
                starts.append(start)
            yield b.drop(columns=["_us"]).assign(allowed=allowed, windowStart=starts)

    fields = ", ".join(f"{c} {t}" for c, t in requests.dtypes)
    return sorted_rows.mapInPandas(run, f"{fields}, allowed boolean, windowStart long").select(*names, "allowed", "windowStart")


def _processor(most: int, seconds: int) -> StatefulProcessor:
    """The processor as a local class: it travels by value, so that stream workers need not import this package."""

    class AnchoredLimit(StatefulProcessor):
        """The same rule over a stream: keyed state of window start and count."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("window", StructType([StructField("start", LongType()), StructField("count", IntegerType())]))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            start, count = self.state.get() if self.state.exists() else (None, 0)
            for b in rows:
                out = []
                for ms in sorted(b["ms"]):
                    if start is None or ms >= start + seconds * 1000:
                        start, count = int(ms), 0
                    count += 1
                    out.append((*key, int(ms), count <= most))
                yield pd.DataFrame(out, columns=["key", "ms", "allowed"])
            if start is not None:
                self.state.update((start, count))

        def close(self) -> None:
            pass

    return AnchoredLimit()


def streaming_limit(requests: DataFrame, most: int, seconds: int) -> DataFrame:
    """``(key STRING, ms LONG)`` stream to ``(key, ms, allowed)``."""
    return requests.groupBy("key").transformWithStateInPandas(_processor(most, seconds), "key string, ms long, allowed boolean", "Append", "None")
