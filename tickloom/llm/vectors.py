"""Embedding tables: which vectors count, classes of equal vectors, numpy batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """Whether a vector is neither null, zero nor empty, and all its components are finite."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & ~odd & F.exists(vec, lambda x: x != 0), F.lit(False))


def keyed(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, h1, h2): 128 hash bits tell equal vectors."""
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    return picked.filter(usable("vec")).select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))


#: Vectors of one length that a task compares by themselves, where the length is not the commonest.
FEW = 2048


def dimensions(rows: DataFrame) -> tuple[list[int], list[int]]:
    """The lengths of vectors (vec): the commonest (ties: the longest) and all that over FEW rows have, and the rest.
    Vectors of different lengths are never near, so each length is a table of its own."""
    found = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).collect()
    large = [r["n"] for k, r in enumerate(found) if not k or r["count"] > FEW]
    return large, [r["n"] for r in found[len(large) :]]


def matrix(column: pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """A list column as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), dim)


def even(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares of very large or small components stay finite; no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
