"""Vectors as rows, as numpy blocks and as binary columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str, nonzero: bool = False) -> DataFrame:
    """``id`` (long) and ``x`` (array of double) of the rows that take part.

    Left out are rows without a key, null vectors and vectors that hold a null
    or a component that is not finite; with ``nonzero`` also those without a
    component other than zero.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)
    return rows.filter(F.exists("x", lambda v: v != 0)) if nonzero else rows


def matrix(lists: pa.Array) -> np.ndarray:
    """Equally long or not: shorter vectors are filled up with zeros."""
    lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    """The rows cut or filled up with zeros to this width."""
    if a.shape[1] == width:
        return a
    out = np.zeros((len(a), width), a.dtype)
    shared = min(width, a.shape[1])
    out[:, :shared] = a[:, :shared]
    return out


def gathered(batches) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a whole (bounded) partition; columns 0 and 1."""
    ids, parts = [], []
    for batch in batches:
        if batch.num_rows:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            parts.append(matrix(batch.column(1)))
    if not ids:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    width = max(p.shape[1] for p in parts)
    return np.concatenate(ids), np.concatenate([widened(p, width) for p in parts])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k least scores with their ids, ties to the smaller id."""
    order = np.lexsort((ids, scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
