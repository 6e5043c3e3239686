"""Right-hand sides b(v, x)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators.linalg import centre, spmv


def unit(x: DataFrame) -> DataFrame:
    return x.join(x.agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("n"))).select("v", F.when(F.col("n") > 0, F.col("x") / F.col("n")).otherwise(0.0).alias("x"))  # n is one row


def random_zero_mean(vertices: DataFrame, seed: int = 42) -> DataFrame:
    """Values that only (seed, v) decide, of mean 0 and norm 1."""
    return unit(centre(vertices.select("v", ((F.xxhash64("v", F.lit(seed)) / F.lit(2.0**63))).alias("x"))))


def range_space(a: DataFrame, vertices: DataFrame, seed: int = 42) -> DataFrame:
    """A g, of norm 1, for normal g that only (seed, v) decides."""
    even = lambda k: (F.pmod(F.xxhash64("v", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / F.lit(2.0**52)
    g = vertices.select("v", (F.sqrt(-2 * F.log(even(1))) * F.cos(2 * math.pi * even(2))).alias("x"))
    return unit(vertices.join(spmv(a, g), "v", "left").select("v", F.coalesce("y", F.lit(0.0)).alias("x")))
