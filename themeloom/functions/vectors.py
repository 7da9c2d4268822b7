"""Vector columns (``ARRAY<FLOAT|DOUBLE>``) and the wide ``V1..Vn`` layout."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.binding import bind

NORM_FLOOR = 1e-12  # fixed value: smallest norm used as a divisor


def embedding_columns(columns: list[str]) -> list[str]:
    """The ``V<digits>`` columns in numeric order."""
    wide = [c for c in columns if re.fullmatch(r"V[0-9]+", c)]
    return sorted(wide, key=lambda c: int(c[1:]))


def pack_embedding(df: DataFrame, name: str = "embedding") -> DataFrame:
    """Replaces ``V1..Vn`` by one array column."""
    wide = embedding_columns(df.columns)
    if not wide:
        raise ValueError("no embedding columns (V<int>) found")
    rest = [c for c in df.columns if c not in set(wide)]
    return df.select(*rest, F.array(*[F.col(c).cast("float") for c in wide]).alias(name))


def unpack_embedding(df: DataFrame, n: int, name: str = "embedding") -> DataFrame:
    """Replaces an array column by ``V1..Vn``."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, *[F.col(name)[i].alias(f"V{i + 1}") for i in range(n)])


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column) -> Column:
    """Unit vector; the norm is bound once so that it is not recomputed per component."""
    floor = F.greatest(norm(a), F.lit(NORM_FLOOR))
    return bind(floor, lambda n: F.transform(as_double(a), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (
        F.greatest(norm(a), F.lit(NORM_FLOOR)) * F.greatest(norm(b), F.lit(NORM_FLOOR))
    )


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def validate_embeddings(df: DataFrame, dim: int, name: str = "embedding") -> DataFrame:
    """One row of counts: rows, missing vectors, wrong width, NaN inside, zero norm."""
    vec = F.col(name)
    has_nan = F.exists(as_double(vec), lambda x: F.isnan(x))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(vec.isNull()).alias("n_missing"),
        F.count_if(F.size(vec) != dim).alias("n_wrong_width"),
        F.count_if(has_nan).alias("n_nan"),
        F.count_if(norm(vec) == 0.0).alias("n_zero"),
    )


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    """Arrow list column to a 2-d numpy array without per-row Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, 0), dtype=dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(n, -1)


def list_array(values: np.ndarray) -> pa.Array:
    """2-d numpy array to an Arrow ``list<double>`` column."""
    n, width = values.shape
    offsets = np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[: n + 1]
    flat = pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(offsets), flat)
