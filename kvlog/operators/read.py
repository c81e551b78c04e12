"""Point and range reads of a log. Key predicates stand below resolution, so they reach the scan;
predicates on values never do."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .resolve import live, newest_per_key


def get(log: DataFrame, key) -> DataFrame:
    """The live entry of a key: one row or none."""
    return live(newest_per_key(log.filter(F.col("key") == F.lit(key))))


def multi_get(log: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """Every probe with its live value, or null. The log is cut to the probed keys before it is resolved."""
    wanted = probes.select(F.col(key).alias("key")).distinct()
    found = live(newest_per_key(log.join(wanted, "key", "left_semi"))).select(F.col("key").alias(key), "value")
    return probes.join(found, key, "left")


def in_range(lower=None, upper=None) -> Column:
    """lower <= key < upper."""
    condition = F.lit(True)
    if lower is not None:
        condition = condition & (F.col("key") >= F.lit(lower))
    if upper is not None:
        condition = condition & (F.col("key") < F.lit(upper))
    return condition


def scan(log: DataFrame, lower=None, upper=None, reverse: bool = False) -> DataFrame:
    """Live entries in [lower, upper) by key."""
    found = live(newest_per_key(log.filter(in_range(lower, upper))))
    return found.orderBy(F.col("key").desc() if reverse else F.col("key"))


def seek(log: DataFrame, key) -> DataFrame:
    """The first live entry at or after a key."""
    return live(newest_per_key(log.filter(F.col("key") >= F.lit(key)))).orderBy("key").limit(1)


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with a prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def prefix_scan(log: DataFrame, prefix: bytes) -> DataFrame:
    return scan(log, prefix, successor(prefix))


class Cursor:
    """A cursor over a frame in the order of its keys, a partition at a time. It begins at the first row
    (the last key, if ``reverse``); ``prev`` steps the other way, and ``seek`` goes to a key."""

    def __init__(self, ordered: DataFrame, reverse: bool = False):
        self._frame, self._reverse = ordered.select("key", "value"), reverse
        self._rows: Iterator[Row] = self._frame.toLocalIterator()
        self._row: Row | None = None
        self._ahead = True  # the way that the open iterator goes
        self._past = False  # beyond the last row, or before the first
        self.next()

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_) -> None:
        self._rows = iter(())

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        while self.is_valid():
            yield self.key(), self.value()
            self.next()

    def is_valid(self) -> bool:
        return self._row is not None

    def key(self) -> bytes:
        return bytes(self._row["key"])

    def value(self) -> bytes:
        return bytes(self._row["value"])

    def _open(self, ahead: bool, beyond: Column) -> None:
        down = ahead == self._reverse
        self._rows = self._frame.filter(beyond).orderBy(F.col("key").desc() if down else F.col("key")).toLocalIterator()
        self._ahead = ahead

    def _step(self, ahead: bool) -> None:
        if ahead != self._ahead:
            key = F.col("key")
            if self._row is None:
                self._open(ahead, F.lit(self._past))  # from the end that it ran over
            else:
                at = F.lit(bytearray(self._row["key"]))
                self._open(ahead, key < at if ahead == self._reverse else key > at)
        self._row = next(self._rows, None)
        self._past = self._row is None

    def next(self) -> None:
        self._step(True)

    def prev(self) -> None:
        self._step(False)

    def seek(self, key: bytes) -> None:
        """To the first row at or after the key (at or before it, if ``reverse``)."""
        at = F.lit(bytearray(key))
        self._open(True, F.col("key") <= at if self._reverse else F.col("key") >= at)
        self._row = next(self._rows, None)
        self._past = self._row is None
