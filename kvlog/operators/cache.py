"""An LRU block cache, and its hits over a trace of accesses."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame

from .layout import folded


class LruCache:
    def __init__(self, capacity: int):
        self.capacity = capacity
        self._held: OrderedDict = OrderedDict()

    def __len__(self) -> int:
        return len(self._held)

    def __contains__(self, key) -> bool:
        return key in self._held

    def get(self, key):
        if key in self._held:
            self._held.move_to_end(key)
            return self._held[key]
        return None

    def put(self, key, value) -> None:
        self._held[key] = value
        self._held.move_to_end(key)
        if len(self._held) > self.capacity:
            self._held.popitem(last=False)

    def drop(self, key) -> None:
        self._held.pop(key, None)

    def clear(self) -> None:
        self._held.clear()


def lru_hits(trace: DataFrame, capacity: int, by: str = "sst_id", order: str = "access_id", block: str = "block_index") -> DataFrame:
    """Adds hit to each access, with one cache for each table, as each open table has its own."""

    def start():
        cache = LruCache(capacity)

        def access(b) -> bool:
            hit = cache.get(b) is not None
            cache.put(b, True)
            return hit

        return access

    return folded(trace, by, order, block, start, "hit", "boolean")
