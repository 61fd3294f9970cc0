"""Models handed to Python workers: broadcast once, unpickled once a worker process."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

#: Models a worker keeps: those of the queries that may run in it at a time.
KEPT = 8
_LOADED: dict[str, Any] = {}


class Model:
    """A broadcast pickle with a key by which workers remember what they made of it."""

    def __init__(self, spark: SparkSession, payload: bytes):
        self.key = hashlib.sha256(payload).hexdigest()
        self.data = spark.sparkContext.broadcast(payload)

    def load(self, make: Callable[[Any], Any]) -> Any:
        if self.key not in _LOADED:
            while len(_LOADED) >= KEPT:
                del _LOADED[next(iter(_LOADED))]
            _LOADED[self.key] = make(pickle.loads(self.data.value))
        return _LOADED[self.key]
