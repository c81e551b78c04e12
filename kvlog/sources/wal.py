"""The write-ahead log: a folder for each memtable, a file of entries for each batch of writes, named by its first seq."""

from __future__ import annotations

import json

from .files import Files

Entry = tuple[bytes, bytes, int]


class Wal:
    def __init__(self, files: Files):
        self.files = files
        files.make("wal")

    def append(self, memtable: int, entries: list[Entry]) -> None:
        """One file, so that a batch is there or not."""
        rows = [[k.hex(), v.hex(), s] for k, v, s in entries]
        self.files.make(f"wal/{memtable:012d}")
        self.files.write(f"wal/{memtable:012d}/{entries[0][2]:020d}.json", json.dumps(rows).encode())

    def drop(self, memtable: int) -> None:
        self.files.delete(f"wal/{memtable:012d}")

    def replay(self) -> list[tuple[int, list[Entry]]]:
        """(memtable, entries) in the order of writing."""
        out = []
        for folder in self.files.names("wal"):
            entries = []
            for name in self.files.names(f"wal/{folder}"):
                entries += [(bytes.fromhex(k), bytes.fromhex(v), s) for k, v, s in json.loads(self.files.read(f"wal/{folder}/{name}"))]
            out.append((int(folder), entries))
        return out
