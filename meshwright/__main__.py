"""python -m meshwright MATRIX [--rhs FILE | --random-rhs] ...: solve a MatrixMarket system.

Exit codes: 0 converged, 1 not converged, 2 wrong input."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshwright.operators import operator
from meshwright.plans import solver
from meshwright.sources import matrix_market, report, rhs


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="meshwright")
    p.add_argument("matrix")
    side = p.add_mutually_exclusive_group(required=True)
    side.add_argument("--rhs", help="dense MatrixMarket vector")
    side.add_argument("--random-rhs", action="store_true", help="a seeded vector of mean 0 and norm 1")
    p.add_argument("-o", "--output", help="where to write the solution")
    p.add_argument("--input-kind", choices=operator.KINDS, default="auto")
    p.add_argument("--tier", choices=("distributed", "component", "jacobi"), default="distributed")
    p.add_argument("--tol", type=float, default=1e-8)
    p.add_argument("--maxiter", type=int, default=200)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--report", help="folder that a line of results is appended to (.csv or .json)")
    return p.parse_args(given)


def run(spark: SparkSession, opt: argparse.Namespace) -> dict:
    began, info = time.perf_counter(), matrix_market.header(spark, opt.matrix)
    n = info["n"]
    a = matrix_market.read_matrix(spark, opt.matrix)
    seen = operator.input_census(a, n).first().asDict()
    kind, why = operator.resolve_kind(seen, opt.input_kind, info["field"] == "pattern")
    print(operator.describe_input(kind, seen, why), file=sys.stderr)
    if kind == "adjacency":
        a = operator.adjacency_to_laplacian(a, n)
    vertices = spark.range(n).select(F.col("id").alias("v"))
    b = matrix_market.read_vector(spark, opt.rhs, n) if opt.rhs else rhs.random_zero_mean(vertices, opt.seed)
    got = solver.solve(a, b, opt.tier, opt.tol, opt.maxiter, **({"seed": opt.seed} if opt.tier == "distributed" else {}))
    if opt.output:
        matrix_market.write_vector(got.x, opt.output)
    if not got.converged and (hint := operator.diagnose_failure(kind, seen)):
        print(hint, file=sys.stderr)
    out = {"matrix": opt.matrix, "kind": kind, "n": n, "iterations": got.iters, "residual": got.residual, "converged": got.converged, "seconds": round(time.perf_counter() - began, 3)}
    if opt.report:
        report.append(spark, [out], opt.report)
    return out


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    opt = arguments(given)
    try:
        out = run(spark or SparkSession.builder.getOrCreate(), opt)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    print(json.dumps(out))
    return 0 if out["converged"] else 1


if __name__ == "__main__":
    sys.exit(main())
