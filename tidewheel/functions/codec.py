"""Checkpoint values as typed JSON, and the parsing of configured strings."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Cursor


def encode(value) -> tuple[str, str]:
    if isinstance(value, Cursor):
        return "cursor", json.dumps({"ts": value.ts.isoformat(), "pk": value.pk})
    if isinstance(value, int) and not isinstance(value, bool):
        return "offset", json.dumps(value)
    raise TypeError(f"no checkpoint type for {type(value).__name__}")


def decode(kind: str, text: str):
    if kind == "offset":
        return int(json.loads(text))
    if kind == "cursor":
        raw = json.loads(text)
        return Cursor(parse_time(raw["ts"]), raw["pk"])
    raise ValueError(f"unknown checkpoint type {kind!r}")


def parse_time(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def offset_of(kind: Column, text: Column) -> Column:
    return F.when(kind == "offset", text.cast("long"))


def cursor_part(kind: Column, text: Column, field: str) -> Column:
    return F.when(kind == "cursor", F.get_json_object(text, f"$.{field}"))


def split_list(text: Column) -> Column:
    """A comma-separated list without blanks around or empty entries."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def is_identifier(text: Column, qualified: bool = False) -> Column:
    one = r"[A-Za-z_][A-Za-z0-9_$]*"
    return text.rlike(f"^{one}(\\.{one})?$" if qualified else f"^{one}$")
