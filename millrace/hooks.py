"""Caller-supplied hooks: row predicates and micro-batch handlers.

A predicate is a Column, SQL text, or a function from Column to Column, so
Catalyst always sees it. A batch handler is what ``foreachBatch`` takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = Column | str | Callable[[Column], Column]
BatchHandler = Callable[[DataFrame, int], None]


def as_condition(predicate: Predicate | None, subject: Column | None = None) -> Column:
    """Turn any accepted predicate form into one boolean Column."""
    if predicate is None:
        return F.lit(True)
    if isinstance(predicate, Column):
        return predicate
    if isinstance(predicate, str):
        return F.expr(predicate)
    if subject is None:
        raise ValueError("a function predicate needs a subject column")
    return predicate(subject)


def chain_handlers(*handlers: BatchHandler) -> BatchHandler:
    """One handler that runs several over a micro-batch read once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if len(handlers) > 1:
            batch = batch.persist()
        try:
            for handler in handlers:
                handler(batch, batch_id)
        finally:
            if len(handlers) > 1:
                batch.unpersist()

    return run
