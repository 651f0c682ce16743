"""JSON columns: canonical text, indented text, status and ingress fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _rewriter(malformed_as_is: bool, **layout):
    """Parse and write anew in Arrow batches. What is no JSON, or nested too deep to parse, becomes NULL or stays as it is."""

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return json.dumps(json.loads(text), **layout)
            except (ValueError, RecursionError):
                return text if malformed_as_is else None

        return texts.map(one, na_action="ignore")

    return rewrite


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys; NULL for malformed text.

    Text behind the value is an error, the last of equal keys wins, whole numbers keep all digits.
    """
    return _rewriter(False, separators=(",", ":"), sort_keys=True, ensure_ascii=False)(text)


def canonical_or_raw(text: Column) -> Column:
    return _rewriter(True, separators=(",", ":"), sort_keys=True, ensure_ascii=False)(text)


def pretty_json(text: Column) -> Column:
    """Indent by four with sorted keys, other characters escaped; raw text if not JSON."""
    return _rewriter(True, indent=4, sort_keys=True, ensure_ascii=True)(text)


def beautified_json(text: Column) -> Column:
    """Indent by four, key order and non-ASCII characters kept."""
    return _rewriter(True, indent=4, sort_keys=False, ensure_ascii=False)(text)


def json_depth(text: Column) -> Column:
    """How many containers a JSON text nests at its deepest point."""
    bare = F.regexp_replace(text, '"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"', "")
    marks = F.split(F.regexp_replace(bare, "[^\\[\\]{}]", ""), "")
    walk = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda acc, mark: F.struct(
            (acc["now"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)).alias("now"),
            F.greatest(acc["top"], acc["now"] + F.when(mark.isin("{", "["), 1).otherwise(0)).alias("top"),
        ),
    )
    return F.coalesce(walk["top"], F.lit(0))


def ingress_value(ingress: Column, prop: str) -> Column:
    """``ip`` or ``hostname`` of the first ingress entry; NULL if there is none."""
    if prop not in ("ip", "hostname"):
        raise ValueError("prop is ip or hostname")
    return F.get(ingress, F.lit(0))[prop]
