"""Compressed columns: three arrays in, three arrays out, for callers that hold a matrix in memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_csc(spark: SparkSession, indptr, indices, data) -> DataFrame:
    """Columns `indptr`, rows `indices` of any integer type and `data` of any float type -> entries (i, j, a)."""
    indptr = np.asarray(indptr, np.int64)
    if len(indptr) == 0 or indptr[0] != 0 or (np.diff(indptr) < 0).any() or indptr[-1] != len(indices) or len(indices) != len(data):
        raise ValueError("indptr, indices and data do not make a matrix")
    return spark.createDataFrame(pa.table({"i": np.asarray(indices, np.int64), "j": np.repeat(np.arange(len(indptr) - 1), np.diff(indptr)), "a": np.asarray(data, float)}))


def to_csc(entries: DataFrame, n: int, most: int = 50_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (col, row, val) of at most `most` rows -> indptr, indices and data, rows ascending in each column."""
    if entries.count() > most:
        raise ValueError(f"more than {most} entries")
    got = entries.select("col", "row", "val").toArrow()
    col, row, val = (np.asarray(got.column(c)) for c in ("col", "row", "val"))
    order = np.lexsort((row, col))
    return np.concatenate([[0], np.cumsum(np.bincount(col, minlength=n))]), row[order], val[order]


def transpose(a: DataFrame) -> DataFrame:
    """Entries of the transpose; what is written sorted by (j, i) is its compressed form."""
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "a")
