"""Registered queries: each binds the given tables to an operator and names its check SQL."""

from importlib import import_module

MODULES = ["metering", "context", "behaviour", "compaction", "search", "memory", "transcripts", "streams", "facts", "upkeep", "code", "recall", "notes", "history"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
