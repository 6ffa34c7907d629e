"""Stable ids as column expressions and for the driver."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH = 24


def text(c: Column) -> Column:
    """A string as it is written in an id: in single quotes; missing: None."""
    return F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))


def number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, LENGTH)


def stable_id_of(*parts) -> str:
    """The same id of Python values; strings in single quotes."""
    return hashlib.sha256("|".join(map(repr, parts)).encode()).hexdigest()[:LENGTH]


def batch_id(owner: Column, key: Column, start: Column, end: Column) -> Column:
    return stable_id(text(owner), text(key), number(start), number(end))


def shared_batch_id(group: Column, key: Column, start: Column, end: Column) -> Column:
    return stable_id(F.lit("'shared'"), text(group), text(key), number(start), number(end))


def slice_id(batch: Column, index: Column, start: Column, end: Column) -> Column:
    return stable_id(text(batch), number(index), number(start), number(end))


def fetch_id(batch: Column, index: Column, start: Column, end: Column) -> Column:
    return stable_id(text(batch), F.lit("'fetch'"), number(index), number(start), number(end))


def handler_id(batch: Column, handler: Column, index: Column, start: Column, end: Column) -> Column:
    return stable_id(text(batch), text(handler), number(index), number(start), number(end), F.lit("None"), F.lit("None"))
