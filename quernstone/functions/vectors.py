"""Expressions over vectors, which are arrays of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either vector is all zeros."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def cosines(a: Column | str, others: list[list[float]]) -> Column:
    """array(cosine(a, each of others)): many fixed vectors held against a column. Sums run in the order of the components, as in cosine, so that values are equal."""
    fixed = np.array([[float(x) for x in v] for v in others]).reshape(len(others), -1)
    lengths = np.zeros(len(fixed))
    for x in fixed.T:
        lengths += x * x
    lengths = np.sqrt(lengths)

    @F.arrow_udf("array<double>")
    def near(vectors: pa.Array) -> pa.Array:
        out = np.zeros((len(vectors), len(fixed)))
        sizes = np.array(vectors.value_lengths().fill_null(-1))
        starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))[:-1]]).astype(int)
        values = vectors.flatten()
        known = np.concatenate([[0], np.cumsum(np.array(values.is_valid()))])
        fit = np.flatnonzero((sizes == fixed.shape[1]) & (known[starts + np.maximum(sizes, 0)] - known[starts] == sizes))
        if len(fit):
            flat = np.array(values.fill_null(0.0))
            dots, squares = np.zeros((len(fit), len(fixed))), np.zeros(len(fit))
            with np.errstate(all="ignore"):
                for j in range(fixed.shape[1]):
                    x = flat[starts[fit] + j]
                    dots += x[:, None] * fixed[:, j]
                    squares += x * x
                product = np.sqrt(squares)[:, None] * lengths
                out[fit] = np.where(product == 0, 0.0, dots / product)
        return pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * len(fixed), pa.array(out.ravel()))

    return near(doubles(a))


def cosine_rows(left: pa.Array, right: pa.Array) -> pa.Array:
    """cosine() of each row of two arrays of lists of doubles, equal to it, for long vectors; rows whose vectors differ in length, or lack one or a number, have 0."""
    out = np.zeros(len(left))
    n, m = (np.array(v.value_lengths().fill_null(-1)) for v in (left, right))
    for size in np.unique(n[(n == m) & (n > 0)]):
        for start in range(0, len(left), 1024):
            rows = start + np.flatnonzero((n == m)[start : start + 1024] & (n[start : start + 1024] == size))
            if not len(rows):
                continue
            flat = [v.take(pa.array(rows)).flatten() for v in (left, right)]
            full = np.all([np.array(v.is_valid()).reshape(-1, size).all(axis=1) for v in flat], axis=0)
            x, y = (np.array(v.fill_null(0.0)).reshape(-1, size).T.copy() for v in flat)
            dots, xx, yy = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
            with np.errstate(all="ignore"):
                for p, q in zip(x, y):
                    dots += p * q
                    xx += p * p
                    yy += q * q
                product = np.sqrt(xx) * np.sqrt(yy)
                out[rows] = np.where(full & (product != 0), dots / product, 0.0)
    return pa.array(out)


def row_cosine(a: Column | str, b: Column | str) -> Column:
    """cosine_rows() of two columns, in Arrow batches."""

    @F.arrow_udf("double")
    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        return cosine_rows(left, right)

    return near(doubles(a), doubles(b))
