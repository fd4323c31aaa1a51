"""What the operators on embeddings share: vectors as rows of bounded integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer components end at plus and minus this, so that sums of 2048 products of two stay under 2^63. Vectors of ordinary size do not come near it.
LARGEST = 1 << 26


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def scaled(vector: Column, by: int) -> Column:
    """The components as integers, floor(by * x)."""
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * by, F.lit(float(LARGEST))), F.lit(float(-LARGEST))))
    return F.transform(vector, lambda x: whole(x).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix; shorter ones are filled up with zeros."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exact: in doubles where none can pass 2^53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 1 << 53 else a @ b.T


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and those of b, exact."""
    most = int(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if most * most * a.shape[1] < 1 << 50:
        return (a * a).sum(axis=1)[:, None] - 2 * products(a, b) + (b * b).sum(axis=1)
    return np.stack([((a - x) ** 2).sum(axis=1) for x in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)
