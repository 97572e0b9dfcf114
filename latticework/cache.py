"""Results of queries, kept on the driver for a while: bounded in number and in age, and by the catalogue's version."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

#: A larger result isn't kept.
MAX_ROWS = 10_000


class QueryCache:
    def __init__(self, entries: int = 256, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self.kept: OrderedDict[str, tuple[float, list]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(method: str, params: dict, version) -> str:
        return hashlib.sha256(json.dumps([method, params, version], sort_keys=True, default=str).encode()).hexdigest()[:32]

    def rows(self, method: str, params: dict, version, make: Callable[[], DataFrame]) -> Iterable:
        """A list of the rows; of a result too large to be kept all rows too, as they come from the cluster, a partition at a time."""
        k = self.key(method, params, version)
        if k in self.kept and self.clock() - self.kept[k][0] < self.seconds:
            self.hits += 1
            self.kept.move_to_end(k)
            return self.kept[k][1]
        self.misses += 1
        df = make()
        found = df.limit(MAX_ROWS + 1).collect()
        if len(found) > MAX_ROWS:
            return df.toLocalIterator()
        self.kept[k] = (self.clock(), found)
        self.kept.move_to_end(k)
        while len(self.kept) > self.entries:
            self.kept.popitem(last=False)
        return found

    @property
    def hit_rate(self) -> float:
        total = self.hits + self.misses
        return self.hits / total if total else 0.0
