"""Cosine similarity over array<float> columns, evaluated on whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix_of(vectors: pa.Array, dim: int) -> np.ndarray:
    """The (n, dim) double matrix behind an Arrow list column without nulls; other widths raise."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != dim).any():
        raise ValueError(f"expected vectors of {dim} numbers, found {sorted(set(lengths.tolist()))[:3]}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; an all-zero row becomes NaN, as it has no direction."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def has_direction(vector: Column) -> Column:
    """Whether a vector is present, all finite and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine_to(vector: Column, reference: list[float]) -> Column:
    """Cosine similarity of each vector to one reference; null for null or zero vectors."""
    target = unit_rows(np.asarray([reference], dtype=np.float64))[0]

    @F.arrow_udf("double")
    def similarity(vectors: pa.Array) -> pa.Array:
        present = vectors.is_valid()
        scores = np.full(len(vectors), np.nan)
        kept = vectors.filter(present)
        scores[present.to_numpy(zero_copy_only=False)] = unit_rows(matrix_of(kept, len(target))) @ target
        return pa.array(scores, mask=np.isnan(scores))

    return similarity(vector)
