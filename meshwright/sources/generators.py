"""Synthetic graphs as edge tables (u, v, w), u < v."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _steps(cells: DataFrame, steps: list[tuple[Column, Column, Column]]) -> DataFrame:
    """For each cell, an edge to id + offset wherever the condition holds."""
    out = F.filter(F.array(*[F.when(ok, F.struct((F.col("id") + off).cast("long").alias("v"), w.cast("double").alias("w"))) for ok, off, w in steps]), lambda x: x.isNotNull())
    return cells.select(F.col("id").alias("u"), F.explode(out).alias("e")).select("u", "e.v", "e.w")


def _harmonic(a: Column, b: Column) -> Column:
    return F.lit(2.0) * a * b / (a + b)


def grid2d(spark: SparkSession, rows: int, cols: int, jump_col: int | None = None, left: float = 1.0, right: float = 1.0) -> DataFrame:
    """4-neighbour grid; cells from jump_col on have coefficient right, edges the harmonic mean of their cells."""
    cells = spark.range(rows * cols).withColumn("r", F.floor(F.col("id") / cols)).withColumn("c", F.col("id") % cols)
    jump = cols if jump_col is None else jump_col
    k = lambda c: F.when(c < jump, F.lit(float(left))).otherwise(F.lit(float(right)))
    return _steps(cells, [(F.col("c") + 1 < cols, F.lit(1), _harmonic(k(F.col("c")), k(F.col("c") + 1))), (F.col("r") + 1 < rows, F.lit(cols), k(F.col("c")))])


def grid3d(spark: SparkSession, nx: int, ny: int, nz: int, w: float = 1.0) -> DataFrame:
    cells = spark.range(nx * ny * nz).withColumn("x", F.col("id") % nx).withColumn("y", F.floor(F.col("id") / nx) % ny).withColumn("z", F.floor(F.col("id") / (nx * ny)))
    return _steps(cells, [(F.col("x") + 1 < nx, F.lit(1), F.lit(w)), (F.col("y") + 1 < ny, F.lit(nx), F.lit(w)), (F.col("z") + 1 < nz, F.lit(nx * ny), F.lit(w))])


def checkerboard(spark: SparkSession, rows: int, cols: int, tile: int, high: float, low: float) -> DataFrame:
    cells = spark.range(rows * cols).withColumn("r", F.floor(F.col("id") / cols)).withColumn("c", F.col("id") % cols)
    k = lambda r, c: F.when((F.floor(r / tile) + F.floor(c / tile)) % 2 == 0, F.lit(float(high))).otherwise(F.lit(float(low)))
    r, c = F.col("r"), F.col("c")
    return _steps(cells, [(c + 1 < cols, F.lit(1), _harmonic(k(r, c), k(r, c + 1))), (r + 1 < rows, F.lit(cols), _harmonic(k(r, c), k(r + 1, c)))])


def path(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(0, n - 1)).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("w"))


def star(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("w"))


def cycle(spark: SparkSession, n: int) -> DataFrame:
    closing = spark.range(1).select(F.lit(0).cast("long").alias("u"), F.lit(n - 1).cast("long").alias("v"), F.lit(1.0).alias("w"))
    return path(spark, n).unionByName(closing)


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 42) -> DataFrame:
    """G(n, p): the edges of a vertex are found by geometric skips over the larger ids, so no pair is looked at in vain."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            u_out, v_out = [], []
            for u in part["id"]:
                r, v = np.random.default_rng([seed, int(u)]), int(u)
                while 0 < p:
                    v += int(r.geometric(p)) if p < 1 else 1
                    if v >= n:
                        break
                    u_out.append(int(u))
                    v_out.append(v)
            yield pd.DataFrame({"u": np.array(u_out, np.int64), "v": np.array(v_out, np.int64), "w": np.ones(len(u_out))})

    return spark.range(n).mapInPandas(run, "u long, v long, w double")


def random_geometric(spark: SparkSession, n: int, radius: float, seed: int = 42) -> DataFrame:
    """Points in the unit square, edges within the radius: an equi-join on grid cells, each point sent to nine of them."""
    pts = spark.range(n).select("id", F.rand(seed).alias("x"), F.rand(seed + 1).alias("y")).withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    near = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda a: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda b: F.struct((F.col("cx") + a).alias("gx"), (F.col("cy") + b).alias("gy"))))))
    sent = pts.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"), near.alias("g")).select("v", "vx", "vy", "g.gx", "g.gy")
    hit = pts.join(sent, (F.col("cx") == F.col("gx")) & (F.col("cy") == F.col("gy"))).where(F.col("id") < F.col("v"))
    return hit.where((F.col("x") - F.col("vx")) ** 2 + (F.col("y") - F.col("vy")) ** 2 <= radius**2).select(F.col("id").alias("u"), "v", F.lit(1.0).alias("w"))


def complete(spark: SparkSession, n: int, w: float = 1.0) -> DataFrame:
    """Every pair once: the output is n (n - 1) / 2 edges by definition."""
    return spark.range(n - 1).select(F.col("id").alias("u"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("v"), F.lit(float(w)).alias("w"))


def aniso_grid(spark: SparkSession, rows: int, cols: int, stretch: float) -> DataFrame:
    """Grid whose edges along rows weigh 1 and those across them `stretch`."""
    cells = spark.range(rows * cols).withColumn("r", F.floor(F.col("id") / cols)).withColumn("c", F.col("id") % cols)
    return _steps(cells, [(F.col("c") + 1 < cols, F.lit(1), F.lit(1.0)), (F.col("r") + 1 < rows, F.lit(cols), F.lit(float(stretch)))])


def weighted_grid(spark: SparkSession, rows: int, cols: int, spread: float, seed: int = 42) -> DataFrame:
    """Grid with weights between 1 and `spread` that only (seed, u, v) decide."""
    from meshwright.operators.select import MODULUS, portable_hash

    w = 1 + (F.lit(float(spread)) - 1) * portable_hash(F.col("u") * 65_537 + F.col("v"), seed) / F.lit(float(MODULUS))
    return grid2d(spark, rows, cols).select("u", "v", w.alias("w"))


def star_of_cliques(spark: SparkSession, k: int, copies: int | None = None) -> DataFrame:
    """`copies` (k // 2) complete graphs of k vertices, the first vertex of each joined to one centre, the last id."""
    copies = k // 2 if copies is None else copies
    inside = complete(spark, k).crossJoin(spark.range(copies).select((F.col("id") * k).alias("at")))  # every copy of every edge is the output
    joined = spark.range(copies).select((F.col("id") * k).alias("u"), F.lit(copies * k).cast("long").alias("v"), F.lit(1.0).alias("w"))
    return inside.select((F.col("u") + F.col("at")).alias("u"), (F.col("v") + F.col("at")).alias("v"), "w").unionByName(joined)


def grounded(a: DataFrame, excess: float) -> DataFrame:
    """A + excess I: an SDDM operator of a Laplacian."""
    return a.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("a") + F.lit(float(excess))).otherwise(F.col("a")).alias("a"))


def flipped(a: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The k off-diagonal pairs of least hash with their sign turned: nearly SDDM."""
    from meshwright.operators.select import portable_hash

    some = a.where("i < j").orderBy(portable_hash(F.col("i") * 65_537 + F.col("j"), seed), "i", "j").limit(k).select(F.col("i").alias("x"), F.col("j").alias("y"))
    return a.join(some, (F.least("i", "j") == F.col("x")) & (F.greatest("i", "j") == F.col("y")), "left").select("i", "j", F.when(F.col("x").isNotNull(), -F.col("a")).otherwise(F.col("a")).alias("a"))
