"""All registered queries, section by section."""

from __future__ import annotations

import importlib

SECTIONS = ("io", "identity", "conversion", "generation", "verbs", "references", "records", "playback", "profiles",
            "benchmarks", "rules", "streams")


def _registries():
    return [importlib.import_module(f"{__package__}.{name}").reg for name in SECTIONS]


def all_queries() -> dict:
    return {name: query for reg in _registries() for name, query in reg.queries.items()}


def all_oracles() -> dict:
    return {name: sql for reg in _registries() for name, sql in reg.oracles.items()}
