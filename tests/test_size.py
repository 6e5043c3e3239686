"""What larger inputs ask for: partitions in proportion to the input, bounded tasks, few rows read again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright import catalogue, session
from meshwright.operators import components, eliminate, factor, linalg, operator, select
from meshwright.plans import solver
from meshwright.sources import generators, rhs

TABLES = "/root/testdata/sf0.001"


def _bipartite(spark, parts=400, leaves=6, suppliers=40):
    """Stars 1000.. with leaves 0.., read from files as the queries' tables are."""
    e = spark.range(parts * leaves).select(((F.col("id") * 7 + F.floor(F.col("id") / leaves) * 3) % suppliers).alias("u"), (F.floor(F.col("id") / leaves) + 1000).alias("v"), (F.col("id") % 3 + 1).cast("double").alias("w"))
    return session.materialise(e)


def _steps(spark, e):
    vertices = operator.both_ways(e).select(F.col("u").alias("v")).distinct()
    picked = vertices.where("v >= 1000").select("v", (F.col("v") % 3).cast("double").alias("excess"))
    degs = select.degrees(e, vertices)
    star = eliminate.stars(e, picked)
    total = eliminate.totals(star, picked)
    g = eliminate.factor_columns(star, total)
    return {
        "stars": star, "factor_columns": g, "exact_clique": eliminate.exact_clique(star, total).groupBy("u", "v").agg(F.sum("w").alias("w")), "tree_clique": eliminate.tree_clique(star, total),
        "drop_small": factor.drop_small(g, 0.6), "narrow": factor.narrow(g), "ldl": factor.ldl(g)[0], "coalesce_edges": eliminate.coalesce_edges(e), "conflicts": select.conflicts(e, picked.select("v")),
        "local_minima": select.local_minima(e, select.by_degree(degs, 42)), "neighbours_of": select.neighbours_of(e, picked.select("v")), "symmetry": operator.symmetry(operator.laplacian(e).where("i <> 3")),
        "lists_to_laplacian": operator.lists_to_laplacian(operator.both_ways(e).selectExpr("u AS v", "v AS to", "w")), "level_histogram": factor.level_histogram(g, degs.selectExpr("v AS pos", "CAST(deg % 3 AS int) AS round")),
    }


@pytest.fixture
def as_if_large(monkeypatch):
    monkeypatch.setattr(session, "SHARE", 256)


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_spreading_changes_no_result(spark, monkeypatch):
    e = _bipartite(spark)
    assert session.shares(e) == 0
    want = {k: _rows(x) for k, x in _steps(spark, e).items()}
    monkeypatch.setattr(session, "SHARE", 256)
    assert session.shares(e) > session.FEW
    for k, x in _steps(spark, e).items():
        assert _rows(x) == want[k], k


@pytest.mark.parametrize("step", ["stars", "tree_clique", "drop_small", "narrow", "ldl", "coalesce_edges", "symmetry", "lists_to_laplacian"])
def test_partitions_grow_with_the_input(spark, as_if_large, step):
    e = _bipartite(spark)
    assert _steps(spark, e)[step].rdd.getNumPartitions() >= session.shares(e)


def test_cliques_are_added_up_before_they_travel(spark, as_if_large):
    e = _bipartite(spark)
    star = eliminate.stars(e, operator.both_ways(e).select(F.col("u").alias("v")).distinct().where("v >= 1000"))
    total = star.groupBy("v").agg(F.sum("w").alias("total"))
    assert eliminate.exact_clique(star, total).count() < 40 * 39 < star.groupBy("v").count().agg(F.sum("count") * 2).first()[0]


def test_nation_queries_read_lineitems_once(spark):
    for df in (catalogue._nation_laplacian(spark, TABLES), *catalogue._balanced(spark, TABLES)):
        assert not [x for x in df.inputFiles() if "lineitem" in x]


def test_components_read_all_edges_once(spark, monkeypatch):
    r = np.random.default_rng(3)
    ids = r.permutation(300)
    rows = [(int(min(a, b)), int(max(a, b))) for at in (0, 100, 200) for a, b in zip(ids[at : at + 99], ids[at + 1 : at + 100], strict=True)]
    e, seen = spark.createDataFrame(rows, "u long, v long"), []
    keep = components.materialise

    def told(df):
        out = keep(df)
        if out.columns == ["u", "v"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(components, "materialise", told)
    got = {x.v: x.component for x in components.components(e, spark.range(302).select(F.col("id").alias("v"))).collect()}
    want = {int(v): int(ids[at : at + 100].min()) for at in (0, 100, 200) for v in ids[at : at + 100]} | {300: 300, 301: 301}
    assert got == want and seen[0] == 297 and all(2 * b < a for a, b in zip(seen[:-1], seen[1:], strict=True))


def _two(spark, n=70):
    e = generators.grid2d(spark, 8, 8).unionByName(generators.cycle(spark, 5).select((F.col("u") + 64).alias("u"), (F.col("v") + 64).alias("v"), "w"))
    v = spark.range(n).select(F.col("id").alias("v"))
    a = operator.laplacian(e, v)
    return a, session.materialise(rhs.range_space(a, v))


def test_large_components_are_in_no_task(spark, monkeypatch):
    a, b = _two(spark)
    want = {x.v: x.x for x in solver.solve(a, b, "component", 1e-10).x.collect()}
    seen, keep = [], linalg.jacobi_pcg
    monkeypatch.setattr(components, "MOST", 50)
    monkeypatch.setattr(linalg, "jacobi_pcg", lambda a, b, *x: seen.append(b.count()) or keep(a, b, *x))
    got = solver.solve(a, b, "component", 1e-10)
    assert seen == [64] and got.converged and all(abs(x.x - want[x.v]) < 1e-7 for x in got.x.collect())


def test_large_operators_stay_out_of_the_driver(spark, monkeypatch):
    a, b = _two(spark, 69)
    monkeypatch.setattr(solver, "LOCAL", 100, raising=False)
    monkeypatch.setattr(solver, "Solver", None)
    with pytest.raises(ValueError, match="b has no row"):
        solver.solve(a, b.where("v <> 7"))
    got = solver.solve(a, b)
    assert got.converged and linalg.relative_residual(a, got.x, b).first()[0] < 1e-8
