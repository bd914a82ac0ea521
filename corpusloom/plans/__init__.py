"""Registered queries: operators applied to the given tables."""

from importlib import import_module

MODULES: tuple[str, ...] = ("retrieval", "texts", "records", "upkeep", "ranking", "answers", "relational", "streams", "scans", "sessions", "composites", "payloads", "sources")


def load() -> None:
    """Imports every module of queries, which registers them."""
    for name in MODULES:
        import_module(f"corpusloom.plans.{name}")
