"""The queries and SQL of all operators here."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("katz", "langid", "licenses", "bpe", "chat", "media", "sharding", "simhash", "packing", "quality")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
