"""Configuration: layers and references (from their modules), flattening, and template variables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.json_leaves import checked, leaves
from millrace.operators.layers import layered_lists, layered_resolve
from millrace.operators.resolution import ordered_resolve
from millrace.operators.resolution import resolve_values as substitution_resolve

__all__ = [
    "config_flatten", "layered_lists", "layered_resolve", "malformed_documents", "ordered_resolve", "substitution_resolve", "variable_named",
    "variables_from_config",
]

# -- trees --------------------------------------------------------------------------

LEAF_BYTES = 4 << 20


def config_flatten(documents: DataFrame, body: str) -> DataFrame:
    """Leaves of each JSON document: path, type and value; empty containers count as leaves, the last of equal keys wins.

    One pass without a shuffle, whatever the documents look like: neither nesting nor
    length is bounded. Leaves leave a task in batches, so a document of many is never held as rows.
    Documents that are no JSON have none (see ``malformed_documents``).
    """
    rest = [c for c in documents.columns if c != body]
    rows = documents.select(*rest, F.col(body).alias("_body"))
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL("path string, type string, value string").fields])

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0

            def flush(batch=batch) -> pa.RecordBatch:
                owners, paths, types, values = zip(*held) if held else ((), (), (), ())
                of_rows = batch.select(batch.schema.names[:-1]).take(pa.array(owners, pa.int64()))
                found = [pa.array(c, pa.string()) for c in (paths, types, values)]
                held.clear()
                return pa.RecordBatch.from_arrays([*of_rows.columns, *found], names=[*of_rows.schema.names, "path", "type", "value"])

            for row, text in enumerate(batch.column(batch.num_columns - 1)):
                for leaf in leaves(text.as_py()) if text.is_valid else ():
                    held.append((row, *leaf))
                    size += 64 + len(leaf[0]) + len(leaf[2])
                    if size >= LEAF_BYTES:
                        yield flush()
                        size = 0
            yield flush()

    return rows.mapInArrow(flatten, schema)


def malformed_documents(documents: DataFrame, body: str) -> DataFrame:
    """The documents that ``config_flatten`` cannot read, as they are."""

    @F.arrow_udf("boolean")
    def is_json(texts: pa.Array) -> pa.Array:
        return pa.array([t.is_valid and checked(t.as_py()) is not None for t in texts], pa.bool_())

    return documents.where(F.col(body).isNotNull() & ~is_json(F.col(body)))


def variables_from_config(documents: DataFrame, body: str, escape: str = "#", template: bool = True) -> DataFrame:
    """Top-level entries of each document, in order, as template variables."""
    mark = escape if template else ""
    rest = [c for c in documents.columns if c != body]
    entries = F.map_entries(F.from_json(body, "map<string,string>"))
    return documents.select(*rest, F.posexplode(entries).alias("pos", "entry")).select(
        *rest, "pos", F.concat(F.lit(mark), "entry.key", F.lit(mark)).alias("k"), F.col("entry.value").alias("v")
    )


def variable_named(variables: Column, key: str) -> Column:
    """The first variable of a list with the key, NULL if none."""
    return F.get(F.filter(variables, lambda v: v["k"] == key), F.lit(0))
