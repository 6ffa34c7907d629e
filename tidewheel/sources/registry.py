"""Handlers found in a folder of modules."""

from __future__ import annotations

import hashlib
import importlib.util
from collections.abc import Mapping
from pathlib import Path

from ..functions.codec import parse_time
from ..types import DEFAULTS, Cursor, DiscoveryError, Handler, Sink, SpecError, make_handler
from .connectors import source_from_config


def cursor_from_config(raw) -> Cursor | None:
    if raw is None or isinstance(raw, Cursor):
        return raw
    ts = raw["timestamp"] if "timestamp" in raw else raw["ts"]
    return Cursor(parse_time(ts) if isinstance(ts, str) else ts, raw["primary_key"] if "primary_key" in raw else raw["pk"])


def sink_from_config(raw) -> Sink | None:
    return raw if raw is None or isinstance(raw, Sink) else Sink(**raw)


#: Settings of existing configurations that have another name here.
OTHER_NAMES = {"remote_method": "method", "data_fetcher": "fetch", "args_builder": "args"}


def handler_from_config(module, raw, stem: str, several: bool) -> Handler:
    """A handler from a mapping: named by handler_id, else by stem and name, else by name or stem.

    Functions may be given by their names in the module. The entry point is `worker`, or what `entrypoint` names: `process`
    if nothing is said, or `run` in modules that have no `process`. `mode: actor` asks for a class.
    """
    if isinstance(raw, Handler):
        return raw
    raw = {OTHER_NAMES.get(k, k): v for k, v in dict(raw).items() if v is not None}
    named, explicit = raw.pop("name", None), raw.pop("handler_id", None)
    name = explicit or (f"{stem}:{named or stem}" if several else named or stem)
    default = DEFAULTS["entrypoint"] if hasattr(module, DEFAULTS["entrypoint"]) or not hasattr(module, "run") else "run"
    resolve = lambda x: getattr(module, x) if isinstance(x, str) else x
    entry = resolve(raw.pop("worker", None) or raw.pop("entrypoint", default))
    raw.pop("entrypoint", None)
    if isinstance(raw.get("fetch"), str):
        raw.setdefault("fetcher_id", raw["fetch"])
    raw |= {k: resolve(raw[k]) for k in ("fetch", "args") if k in raw}
    mode = raw.pop("mode", "actor" if isinstance(entry, type) else "task")
    if mode not in ("task", "actor") or (mode == "actor") != isinstance(entry, type):
        raise SpecError(f"{name}: mode {mode!r} with {entry!r}")
    if mode == "actor":
        raw.setdefault("method", DEFAULTS["method"])
    sources = tuple(source_from_config(s) for s in raw.pop("sources", ()))
    return make_handler(str(name), entry, sources, sink_from_config(raw.pop("output", None)), **raw)


def _load(path: Path):
    name = f"tidewheel_handlers_{hashlib.sha256(str(path).encode()).hexdigest()[:12]}"
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    try:
        spec.loader.exec_module(module)
    except Exception as e:
        raise DiscoveryError(f"{path}: {e}") from e
    return module


def discover(folder) -> tuple[Handler, ...]:
    """Handlers of the folder's modules by name, without those that start with `_`.

    A module gives HANDLERS, get_worker_spec(), WORKER_SPEC or WORKER_CONFIG, the first of these.
    """
    found: dict[str, Handler] = {}
    for path in sorted(Path(folder).glob("*.py")):
        if path.name.startswith("_"):
            continue
        module = _load(path)
        several = hasattr(module, "HANDLERS")
        if several:
            raws = list(module.HANDLERS)
            if not raws or not all(isinstance(r, (Handler, Mapping)) for r in raws):
                raise DiscoveryError(f"{path}: HANDLERS is to be a list of handlers or mappings, and not empty")
        elif hasattr(module, "get_worker_spec"):
            raws = [module.get_worker_spec()]
        elif hasattr(module, "WORKER_SPEC"):
            raws = [module.WORKER_SPEC]
        elif hasattr(module, "WORKER_CONFIG"):
            raws = [module.WORKER_CONFIG]
        else:
            raise DiscoveryError(f"{path}: no handler is defined")
        for raw in raws:
            try:
                spec = handler_from_config(module, raw, path.stem, several)
            except Exception as e:
                raise DiscoveryError(f"{path}: {e}") from e
            if spec.handler_id in found:
                raise DiscoveryError(f"{path}: handler {spec.handler_id!r} is defined twice")
            found[spec.handler_id] = spec
    if not found:
        raise DiscoveryError(f"{folder}: no handlers")
    return tuple(found.values())
