"""Checks and conversions of vector columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    return F.coalesce(
        vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))),
        F.lit(False),
    )


def stacked(vectors: pd.Series, width: int, dtype) -> np.ndarray:
    """Rows of a matrix of ``width`` columns; shorter vectors end in zeros."""
    if len(vectors) and all(len(v) == width for v in vectors):
        return np.stack(vectors.to_numpy()).astype(dtype, copy=False)
    out = np.zeros((len(vectors), width), dtype=dtype)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out
