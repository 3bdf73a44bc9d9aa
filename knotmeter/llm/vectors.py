"""Embeddings as integer vectors, and exact products of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def integer_vectors(embeddings: DataFrame, scale: int, *others: Column) -> DataFrame:
    """``row, vec_id``, the columns ``others`` and ``ints``: each component as floor(scale * x), x as double.

    Vectors that are null or hold a null or non-finite component take no part. ``row`` numbers the rows, as vec_id
    may be null or repeat; store the result before using it twice.
    """
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.where(vector.isNotNull() & ~bad).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), *others,
        F.transform(vector, lambda x: F.floor(x * scale)).alias("ints"),
    )


def matrices(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A column of lists by length: the places of its rows, and a row of numbers for each."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        out[int(length)] = places, values[starts[places][:, None] + np.arange(length)]
    return out


def magnitude(numbers: np.ndarray) -> float:
    """The largest absolute value, of the least integer too."""
    return float(np.abs(numbers.astype(np.float64)).max(initial=0))


def exact_type(bound: float) -> type:
    """The fastest numbers in which sums of products that stay below ``bound`` are exact."""
    for kind, digits in ((np.float32, 24), (np.float64, 53), (np.int64, 62)):
        if bound < 2.0**digits:
            return kind
    raise OverflowError("these vectors are too large: their products do not fit a long")
