"""Vectors x(v, x) and products of operators with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.session import met


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """y(v, y) = A x for every row of A."""
    return met(a, x.select(F.col("v").alias("j"), "x"), "j").groupBy(F.col("i").alias("v")).agg(F.sum(F.col("a") * F.col("x")).alias("y"))


def quadratic(a: DataFrame, x: DataFrame) -> DataFrame:
    return spmv(a, x).join(x, "v").agg(F.sum(F.col("x") * F.col("y")).alias("xax"))


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """r(v, r) = b - A x; vertices without entries in A keep b."""
    return b.join(spmv(a, x), "v", "left").select("v", (F.col("x") - F.coalesce("y", F.lit(0.0))).alias("r"))


def relative_residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    r = residual(a, x, b).join(b, "v").agg(F.sum(F.col("r") ** 2).alias("rr"), F.sum(F.col("x") ** 2).alias("bb"))
    return r.select(F.when(F.col("bb") > 0, F.sqrt(F.col("rr") / F.col("bb"))).otherwise(0.0).alias("residual"))


def centre(x: DataFrame) -> DataFrame:
    return x.join(x.agg(F.avg("x").alias("m"))).select("v", (F.col("x") - F.col("m")).alias("x"))  # m is one row


def scatter(x: DataFrame, perm: DataFrame) -> DataFrame:
    return x.join(perm, "v").select(F.col("pos").alias("v"), "x")


def gather(x: DataFrame, perm: DataFrame) -> DataFrame:
    return perm.join(x.withColumnRenamed("v", "pos"), "pos").select("v", "x")


def jacobi_pcg(a: DataFrame, b: DataFrame, steps: int, tol: float = 0.0, every: int = 1) -> tuple[DataFrame, list[float]]:
    """Conjugate gradients with the diagonal as preconditioner: state(v, x, r, p) with a product, two sums and one write a
    step. Stops at tol |b|, or when p'Ap or r'z is not positive."""
    from meshwright.session import materialise

    a = materialise(a.select("i", "j", "a"))  # read once a step, whatever it is computed from
    diag = a.where("i = j").select(F.col("i").alias("v"), F.col("a").alias("d"))
    state = materialise(b.join(diag, "v", "left").select("v", F.lit(0.0).alias("x"), F.col("x").alias("r"), F.when(F.col("d") > 0, F.col("d")).otherwise(1.0).alias("d")).withColumn("p", F.col("r") / F.col("d")))
    rz, bb = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sum(F.col("r") * F.col("r"))).first()
    norms = [1.0]
    for _ in range(steps):
        if not bb or not rz or norms[-1] <= tol:
            break
        y = spmv(a, state.select("v", F.col("p").alias("x")))
        step = materialise(state.join(y, "v", "left").fillna(0.0, ["y"]))
        pap = step.agg(F.sum(F.col("p") * F.col("y"))).first()[0]
        if pap <= 0:
            break
        alpha = rz / pap
        moved = step.withColumn("x", F.col("x") + alpha * F.col("p")).withColumn("r", F.col("r") - alpha * F.col("y"))
        new, rr = moved.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sum(F.col("r") * F.col("r"))).first()
        state = moved.select("v", "x", "r", "d", (F.col("r") / F.col("d") + F.lit(new / rz) * F.col("p")).alias("p"))
        rz = new
        norms.append((rr / bb) ** 0.5)
    return state.select("v", "x", "r"), norms
