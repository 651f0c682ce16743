"""Reading of vector columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and components (double) of the vectors without null or non-finite components, one pair per length."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        flat = pc.fill_null(column.take(pa.array(rows)).flatten().cast(pa.float64()), float("nan"))
        matrix = flat.to_numpy(zero_copy_only=False).reshape(len(rows), length)
        whole = np.isfinite(matrix).all(axis=1)
        if whole.any():
            yield rows[whole], matrix[whole]


def scaled_floor(matrix: np.ndarray, scale: float, most: int) -> np.ndarray:
    """``floor(scale * x)`` as integers; an error where one is over ``most``, since squared distances would not fit a long."""
    scaled = np.floor(matrix * scale)
    if scaled.size and np.abs(scaled).max() > most:
        raise OverflowError(f"a component times {scale} is beyond {most}: squared distances do not fit 64 bits")
    return scaled.astype(np.int64)
