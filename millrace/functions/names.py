"""Column predicates over file, directory and object names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ends_with_any(name: Column, ends: Sequence[str]) -> Column:
    return reduce(lambda a, end: a | name.endswith(end), ends, F.lit(False))


def valid_file(name: Column, forbidden: Sequence[str]) -> Column:
    """A file is kept unless it ends with a forbidden suffix."""
    return ~ends_with_any(name, forbidden)


def valid_dir(name: Column, forbidden: Sequence[str]) -> Column:
    """A directory is kept unless hidden, an egg-info, or named as forbidden."""
    refused = name.endswith(".egg-info") | name.startswith(".")
    return ~(refused | name.isin(list(forbidden))) if forbidden else ~refused


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_segments(path: Column) -> Column:
    """Directory names above a file, outermost first."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parent_dir(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, "\\s+$", "")


def relative_key(key: Column, prefix: str) -> Column:
    return F.substring(key, F.lit(len(prefix) + 1), F.length(key))
