"""Singular operators: solved as a whole or by connected component, and what is done about their null space.

`native` takes means out inside of the solver, `pin` fixes one vertex of each component, `coarse` gives a solver one near-null vector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators import components
from meshwright.plans import solver as solvers

#: Kinds of solver and what each can do about a null space; the first is its default.
GROUNDS = {"factor": ("native",), "amgcl": ("pin", "coarse"), "boomeramg": ("pin",)}
DECOMPOSE = ("whole", "split")


@dataclass(frozen=True)
class Plan:
    supported: bool
    decompose: str
    ground: str


def plan(kind: str, decompose: str = "auto", ground: str = "auto", disconnected: bool = False) -> Plan:
    """One vector cannot span the null space of several components, so `coarse` needs them apart."""
    if kind not in GROUNDS or decompose not in ("auto", *DECOMPOSE) or ground not in ("auto", "native", "pin", "coarse"):
        raise ValueError(f"no such plan: {kind!r}, {decompose!r}, {ground!r}")
    if ground == "auto":
        ground = GROUNDS[kind][0]
    if decompose == "auto":
        decompose = "split" if disconnected and (ground == "coarse" or kind == "boomeramg") else "whole"
    stuck = ground == "coarse" and decompose == "whole" and disconnected
    return Plan(ground in GROUNDS[kind] and not stuck, decompose, ground)


def solve(a: DataFrame, b: DataFrame, how: Plan, tol: float = 1e-8, **options) -> solvers.SolveResult:
    """A x = b of a Laplacian with this engine's solver. Pinned vertices, the smallest of each component, get 0."""
    if how.ground == "coarse":
        raise ValueError("no solver here takes a near-null vector")
    tier = "component" if how.decompose == "split" else "distributed"
    if how.ground == "native":
        return solvers.solve(a, b, tier, tol, **options)
    edges = a.where("i < j").select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("a").alias("w"))
    pins = components.components(edges, b.select("v")).groupBy("component").agg(F.min("v").alias("v")).select("v", F.lit(True).alias("pinned"))
    held = b.join(pins, "v", "left").select("v", F.when(F.col("pinned"), 0.0).otherwise(F.col("x")).alias("x"))
    return solvers.solve(components.pin(a, pins), held, tier, tol, **options)
