"""Incremental, range-based data processing on Spark."""

from importlib import import_module

#: What the package offers, and where it is; modules load when something of theirs is asked for.
_PLACES = {
    "streaming.planner": ("Planner", "Policy", "ThreadBackend"),
    "streaming.checkpoints": ("Ledger", "MemoryCheckpoints", "SQLiteCheckpoints", "TableCheckpoints"),
    "streaming.fanout": ("FanOut",),
    "sources.clients": ("SourceClient", "SparkSources"),
    "sources.log_stream": ("LogSourceFormat", "RangeClient"),
    "sources.registry": ("discover",),
    "types": ("Cursor", "Handler", "Limits", "LogSource", "Request", "SharedRead", "Sink", "Span", "TableSource", "Work", "make_handler", "offset_kwargs"),
}
_HOMES = {name: module for module, names in _PLACES.items() for name in names}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(name)
    return getattr(import_module(f".{_HOMES[name]}", __name__), name)
