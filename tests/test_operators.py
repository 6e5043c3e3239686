import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.__main__ import main
from meshwright.functions import kernels, trees
from meshwright.operators import components, eliminate, factor, linalg, operator, select
from meshwright.plans import grounding, solver
from meshwright.sources import compressed, generators, matrix_market, report, rhs

_vec = "v long, x double"


def _grid(spark, n=8, excess=None):
    e = generators.grid2d(spark, n, n)
    v = spark.range(n * n).select(F.col("id").alias("v"))
    x = None if excess is None else v.select("v", F.lit(float(excess)).alias("excess"))
    return operator.laplacian(e, v, x), v


def test_path_laplacian(spark):
    got = {(r.i, r.j): r.a for r in operator.laplacian(generators.path(spark, 3)).collect()}
    assert got == {(0, 0): 1, (1, 1): 2, (2, 2): 1, (0, 1): -1, (1, 0): -1, (1, 2): -1, (2, 1): -1}


def test_adjacency_keeps_isolated_vertices(spark):
    a = spark.createDataFrame([(1, 2, -3.0), (2, 1, -3.0), (0, 0, 5.0)], "i long, j long, a double")
    got = {(r.i, r.j): r.a for r in operator.adjacency_to_laplacian(a, 5).collect()}
    assert got == {(0, 0): 0, (1, 1): 3, (2, 2): 3, (3, 3): 0, (4, 4): 0, (1, 2): -3, (2, 1): -3}


def test_contract(spark):
    f = lambda rows: spark.createDataFrame(rows, "i long, j long, a double")
    with pytest.raises(ValueError, match="not symmetric"):
        operator.require(f([(0, 0, 1.0), (1, 1, 1.0), (0, 1, -1.0)]))
    with pytest.raises(ValueError, match="non-finite"):
        operator.require(f([(0, 0, float("nan"))]))
    with pytest.raises(ValueError, match="adjacency"):
        operator.require(f([(0, 1, 1.0), (1, 0, 1.0)]))
    with pytest.raises(ValueError, match="ceiling"):
        operator.require(f([(0, 0, 2.0), (1, 1, 2.0), (0, 1, 1.0), (1, 0, 1.0)]))
    with pytest.raises(ValueError, match="square"):
        operator.require(f([(0, 5, 1.0)]), 2)


def test_lumping_keeps_row_sums_and_is_idempotent(spark):
    a = spark.createDataFrame([(0, 0, 3.0), (1, 1, 3.0), (2, 2, 3.0), (0, 1, -1.0), (1, 0, -1.0), (1, 2, 0.5), (2, 1, 0.5)], "i long, j long, a double")
    b = operator.lump(a)
    sums = lambda x: {r.i: r.s for r in x.groupBy("i").agg(F.sum("a").alias("s")).collect()}
    assert sums(a) == sums(b) and not b.where("i <> j AND a > 0").count()
    assert sorted(map(tuple, operator.lump(b).collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("name", select.NAMES)
def test_selectors_and_solve(spark, name):
    for excess in (None, 0.5):
        a, v = _grid(spark, 8, excess)
        got = solver.solve(a, rhs.range_space(a, v), partitioner=name, peel_below=40, degree_quantile=0.6)
        assert got.converged and got.residual < 1e-8
        if excess is None:
            assert abs(got.x.agg(F.avg("x")).first()[0]) < 1e-12


def test_exact_factor_and_ldl(spark):
    a, v = _grid(spark, 6, 2.0)
    fac = solver.factorize(a, sampler="exact", peel_below=10)
    assert factor.quality(a, fac.matrix(), fac.perm) < 1e-10
    s = solver.Solver(a, fac)
    assert s.solve(rhs.range_space(a, v)).iters <= 3
    low, d = factor.ldl(fac.matrix())
    assert low.where("row = col AND abs(val - 1) > 1e-12").count() == 0 and d.where("d <= 0").count() == 0


def test_warm_start_zero_rhs_and_lengths(spark):
    a, v = _grid(spark, 5)
    b, s = rhs.range_space(a, v), solver.Solver(a)
    x = s.solve(b, 1e-12).x
    assert s.solve(b, x0=x).iters == 0 and s.solve(b, maxiter=0).residual == 1.0
    assert s.solve(v.select("v", F.lit(0.0).alias("x"))).residual == 0
    with pytest.raises(ValueError):
        s.solve(b.limit(3))
    with pytest.raises(ValueError, match="unknown option"):
        solver.Solver(a, colour="red")


def test_components_tier(spark):
    e = generators.grid2d(spark, 4, 4).unionByName(generators.cycle(spark, 5).select((F.col("u") + 16).alias("u"), (F.col("v") + 16).alias("v"), "w"))
    v = spark.range(22).select(F.col("id").alias("v"))
    assert components.components(e, v).select("component").distinct().count() == 3
    a = operator.laplacian(e, v)
    b = rhs.range_space(a, v)
    assert solver.solve(a, b, "component").converged and solver.solve(a, b, "jacobi").converged


def test_multigraph_coalescing(spark):
    rows = [(0, 1, 1.0), (0, 1, 2.0), (0, 2, 4.0), (1, 2, 3.0), (1, 2, 5.0), (1, 2, 7.0), (2, 3, 1.0)]
    e = spark.createDataFrame(rows, "u long, v long, w double")
    got = {(r.u, r.v): (r.w, r.mult) for r in eliminate.coalesce_edges(e).collect()}
    assert got == {(0, 1): (3, 2), (0, 2): (4, 1), (1, 2): (15, 3), (2, 3): (1, 1)}
    degs = {r.v: r.deg for r in select.degrees(e, spark.range(4).select(F.col("id").alias("v"))).collect()}
    assert degs == {0: 3, 1: 5, 2: 5, 3: 1}


def test_tree_sample_is_unbiased():
    w = np.array([1.0, 2.0, 3.0, 4.0])
    seen = np.zeros((4, 4))
    for k in range(4000):
        got = trees.sampled(np.array([7] * 4 + [9, 9]), np.array([0, 1, 2, 3, 5, 4]), np.array([*w, 1.0, 3.0]), np.array([10.0] * 4 + [8.0] * 2), k)
        assert len(got[0]) == 4 and (got[0][3], got[1][3], got[2][3]) == (4, 5, 3 / 8)
        for a, b, x in list(zip(*got, strict=True))[:3]:
            seen[min(a, b), max(a, b)] += x / 4000
    assert np.allclose(seen, np.triu(np.outer(w, w) / 10, 1), atol=0.06)


def test_kernel_against_dense():
    r = np.random.default_rng(2)
    m = -np.triu((r.random((40, 40)) < 0.2) * r.random((40, 40)), 1)
    m = m + m.T
    m += np.diag(1 - m.sum(1))
    i, j = np.nonzero(m)
    s, b = kernels.Solver(kernels.Operator(40, i, j, m[i, j])), r.normal(size=40)
    assert np.allclose(s.solve(b, 1e-12).x, np.linalg.solve(m, b), atol=1e-9)


def _laplacian(n, p, seed=2, ground=0.0):
    r = np.random.default_rng(seed)
    m = -np.triu((r.random((n, n)) < p) * r.random((n, n)), 1)
    m = m + m.T
    m += np.diag(ground - m.sum(1))
    i, j = np.nonzero(m)
    return m, kernels.Operator(n, i, j, m[i, j])


@pytest.mark.parametrize("order", ["natural", "min_degree", "bk_serial"])
def test_exact_factor_is_cholesky(order):
    m, op = _laplacian(30, 0.3, ground=0.5)
    f = kernels.factorise(op, exact_below=30, order=order)
    g = np.diag(f.diag)
    g[f.row, f.col] = f.val
    back = np.empty(30, int)
    back[f.perm] = np.arange(30)
    assert (f.row > f.col).all() and np.allclose(g @ g.T, m[np.ix_(back, back)])
    if order == "natural":
        assert np.allclose(g, np.linalg.cholesky(m))


def test_sampled_factors_precondition():
    m, op = _laplacian(3000, 0.004)
    b = np.random.default_rng(1).normal(size=3000)
    b -= b.mean()
    for options in ({}, {"order": "natural"}, {"order": "bk_serial"}, {"exact_below": 4}, {"sampler": lambda w, u, total, draws: [(int(u[k]), int(u[-1]), float(w[k] * w[k + 1 :].sum() / total)) for k in range(len(u) - 1)]}):
        got = kernels.Solver(op, **options).solve(b, 1e-8, 400)
        assert got.iterations < 400 and np.linalg.norm(b - op.times(got.x)) < 1e-6 * np.linalg.norm(b)


def test_baselines():
    m, op = _laplacian(200, 0.1, ground=0.01)
    b = np.random.default_rng(3).normal(size=200)
    want = np.linalg.solve(m, b)
    assert np.allclose(kernels.direct(op, b).x, want) and kernels.direct(op, b).converged
    got = kernels.Solver(op, kernels.incomplete_cholesky(op)).solve(b, 1e-10, 300)
    assert got.converged and np.allclose(got.x, want, atol=1e-6)
    m, op = _laplacian(12, 1.0, ground=0.2)  # on a full pattern nothing is left out
    f = kernels.incomplete_cholesky(op)
    g = np.diag(f.diag)
    g[f.row, f.col] = f.val
    assert np.allclose(g, np.linalg.cholesky(m))


_GRID = [(0, 1, -1.0), (1, 0, -1.0), (1, 2, -1.0), (2, 1, -1.0)]


@pytest.mark.parametrize(
    ("entries", "n", "want"),
    [
        ([*_GRID, (0, 0, 1.0), (1, 1, 2.0), (2, 2, 1.0)], 3, "laplacian"),
        (_GRID, 3, "laplacian"),
        ([(i, j, -a) for i, j, a in _GRID], 3, "adjacency"),
        ([(i, j, -2.5 * a) for i, j, a in _GRID] + [(0, 0, 3.0)], 3, "adjacency"),
        ([(0, 1, 0.25), (1, 0, 0.25), (1, 2, -1.0), (2, 1, -1.0), (0, 0, 1.0), (1, 1, 2.0), (2, 2, 1.0)], 3, "laplacian"),
        ([(0, 1, 1.0), (1, 0, 1.0), (1, 2, -1.0), (2, 1, -1.0)], 3, ValueError),
        ([(0, 1, 1.0), (1, 0, 1.0), (1, 2, -1.0), (2, 1, -1.0), (0, 0, 1.0)], 3, ValueError),
        ([(1, 0, -1.0), (2, 1, -1.0), (0, 0, 1.0), (1, 1, 2.0), (2, 2, 1.0)], 3, ValueError),
        ([(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)], 3, "laplacian"),
    ],
)
def test_input_kinds(spark, entries, n, want):
    seen = operator.input_census(spark.createDataFrame(entries, "i long, j long, a double"), n).first().asDict()
    if want is ValueError:
        with pytest.raises(ValueError):
            operator.resolve_kind(seen)
    else:
        kind, why = operator.resolve_kind(seen)
        assert kind == want and why


def test_explicit_kinds_and_what_is_said(spark):
    lap, adj = ([*_GRID, (0, 0, 1.0), (1, 1, 2.0), (2, 2, 1.0)], [(i, j, -a) for i, j, a in _GRID])
    seen = [operator.input_census(spark.createDataFrame(x, "i long, j long, a double"), 3).first().asDict() for x in (lap, adj)]
    assert operator.resolve_kind(seen[0], "adjacency")[0] == "adjacency" and "WARNING" in operator.resolve_kind(seen[1], "laplacian")[1]
    assert "unit weights" in operator.resolve_kind(seen[1], pattern=True)[1]
    assert "every row sums to zero" in operator.describe_input("laplacian", seen[0]) and "L = D - A" in operator.describe_input("adjacency", seen[1])
    assert operator.diagnose_failure("laplacian", seen[0]) == "" and "positive" in operator.diagnose_failure("laplacian", seen[1]) and "dominance" in operator.diagnose_failure("laplacian", seen[1])
    with pytest.raises(ValueError):
        operator.resolve_kind(seen[0], "graph")


def test_every_tier_checks_its_operator(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0), (1, 0, -0.5), (1, 1, 1.0)], "i long, j long, a double")
    b = spark.createDataFrame([(0, 1.0), (1, -1.0)], "v long, x double")
    for tier in ("distributed", "component", "jacobi"):
        with pytest.raises(ValueError, match="not symmetric"):
            solver.solve(a, b, tier)


def test_what_a_solver_tells(spark):
    a, v = _grid(spark, 6)
    s = solver.Solver(a, sampler="exact", drop=0.0)
    assert s.shape == (36, 36) and not s.sddm and s.lumped == 0 and s.perm.count() == 36 and s.chol.count() == s.factor_nnz
    assert s.unit_lower.where("row = col AND abs(val - 1) > 1e-12").count() == 0 and s.pivots.count() == 36
    with pytest.raises(ValueError, match="max_factor"):
        solver.Solver(a, max_factor=10)


def test_rounds_before_the_rest(spark):
    a, v = _grid(spark, 9)
    for options in ({"exact_below": 2}, {"partitioner": "luby", "sampler": "exact"}):
        s = solver.Solver(a, peel_below=60, degree_quantile=0.6, **options)
        assert s.fac.rounds and s.solve(rhs.range_space(a, v)).converged


def test_drop_keeps_column_sums(spark):
    g = spark.createDataFrame([(0, 0, 2.0), (0, 1, -1.0), (0, 2, -1e-6), (0, 3, -0.5)], "col long, row long, val double")
    got = factor.drop_small(g)
    assert got.count() == 3 and abs(got.agg(F.sum("val")).first()[0] - (0.5 - 1e-6)) < 1e-12


def test_matrix_market(spark, tmp_path):
    p = tmp_path / "a.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 4\n1 1 1\n2 1 -1\n2 2 1\n3 3 5\n")
    assert matrix_market.header(spark, str(p))["nnz"] == 4 and matrix_market.read_operator(spark, str(p)).count() == 5
    assert {(r.i, r.j): r.a for r in matrix_market.read_adjacency(spark, str(p)).collect()} == {(0, 1): 1, (1, 0): 1}
    x = spark.createDataFrame([(0, 1.5), (1, -2.0)], _vec)
    matrix_market.write_vector(x, str(tmp_path / "x"))
    assert sorted(map(tuple, matrix_market.read_vector(spark, str(tmp_path / "x"), 2).collect())) == [(0, 1.5), (1, -2.0)]
    with pytest.raises(ValueError):
        matrix_market.read_vector(spark, str(tmp_path / "x"), 3)


def test_spmv_and_pcg(spark):
    a, v = _grid(spark, 5)
    assert linalg.spmv(a, v.select("v", F.lit(1.0).alias("x"))).where("abs(y) > 1e-12").count() == 0
    x, norms = linalg.jacobi_pcg(a, rhs.range_space(a, v), 60, 1e-8)
    assert norms[-1] < 1e-8


def test_unknown_peel_is_rejected():
    with pytest.raises(ValueError, match="unknown peel strategy 'bk'"):
        solver.Options.of(peel="bk")


def test_centring_schedule():
    m, op = _laplacian(200, 0.1)
    b = np.random.default_rng(1).normal(size=200)
    b -= b.mean()
    for every in (1, 3, 10):
        s = kernels.Solver(op, centre_every=every)
        r = b + 1
        means = [abs(s.precondition(r).mean()) < 1e-12 for _ in range(10)]
        assert means == [(k + 1) % every == 0 for k in range(10)]
        assert s.solve(b, 1e-10).converged


def test_yield_rules():
    assert select.least_yield(0.05, 2001, 500, 500) == pytest.approx(0.15) and select.least_yield(0.2, 2001, 500, 500) == 0.2
    assert select.least_yield(0.05, 2000, 500, 500) == select.least_yield(0.05, 2001, 499, 500) == select.least_yield(0.05, 2001, 500, None) == 0.05
    assert select.least_yield(0.0, 2001, 500, 500) == 0
    assert select.too_little(0, 10, 10, 0.0, 500) and not select.too_little(1, 1000, 1000, 0.5, 500)
    assert select.too_little(1, 1000, 1001, 0.5, 500) and select.too_little(1, 1000, 10, 0.5, None) and not select.too_little(500, 1000, 1001, 0.5, 500)


def test_half_precision_keeps_column_sums(spark):
    r = np.random.default_rng(5)
    rows = [(c, c + k, float(x)) for c in range(20) for k, x in enumerate([2.0, *-r.random(6), -1e-6, 0.0])]
    got = {(x.col, x.row): x.val for x in factor.narrow(spark.createDataFrame(rows, "col long, row long, val double")).collect()}
    for c in range(20):
        own = {row: val for col, row, val in rows if col == c}
        scale = max(abs(v) for k, v in own.items() if k != c)
        want = {k: float(np.float16(v / scale)) for k, v in own.items() if k != c}
        for k, x in want.items():
            assert got[c, k] == (0 if abs(x) < 2.0**-14 else x * scale)
        assert sum(own.values()) == pytest.approx(sum(got[c, k] for k in own), abs=1e-12)


def test_duplicate_ratio(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0), (0, 2, 4.0), (1, 2, 3.0), (1, 2, 5.0), (1, 2, 7.0), (2, 3, 1.0)], "u long, v long, w double")
    assert eliminate.duplicate_ratio(e).first().ratio == 14 / 8 and eliminate.duplicate_ratio(e.limit(0)).first().ratio == 1
    assert eliminate.duplicate_ratio(eliminate.coalesce_edges(e)).first().ratio == 14 / 8


def test_released_and_foreign_factors(spark):
    a, v = _grid(spark, 5)
    fac = solver.factorize(a)
    s = solver.Solver(a, fac)
    x = np.arange(25.0)
    assert np.allclose(s.aslinearoperator() @ x, s.local.op.times(x)) and s.aspreconditioner().matmat(np.stack([x, x], 1)).shape == (25, 2)
    with pytest.raises(ValueError, match="fit"):
        s.aslinearoperator().matvec(x[:3])
    with pytest.raises(ValueError, match="does not have"):
        solver.Solver(_grid(spark, 6)[0], fac)
    fac.release()
    with pytest.raises(ValueError, match="released"):
        solver.Solver(a, fac)


def test_partitioner_on_all_vertices(spark):
    a, v = _grid(spark, 8)
    seen = []

    def mine(edges, candidates, seed):
        seen.append(candidates.count())
        return select.luby(edges, candidates, seed)

    for p in (mine, select.on_all(mine)):
        assert solver.solve(a, rhs.range_space(a, v), partitioner=p, peel_below=58, degree_quantile=0.0).converged
    assert seen[0] == 4 and 64 in seen  # the corners have the least degree


def test_grounding(spark):
    assert grounding.plan("amgcl", ground="coarse", disconnected=True) == grounding.Plan(True, "split", "coarse")
    assert not grounding.plan("amgcl", "whole", "coarse", True).supported and grounding.plan("amgcl", "whole", "coarse").supported
    e = generators.grid2d(spark, 3, 4).unionByName(generators.cycle(spark, 5).select((F.col("u") + 12).alias("u"), (F.col("v") + 12).alias("v"), "w"))
    v = spark.range(17).select(F.col("id").alias("v"))
    a = operator.laplacian(e, v)
    b = rhs.range_space(a, v)
    for how in (grounding.Plan(True, "whole", "pin"), grounding.Plan(True, "split", "pin"), grounding.plan("factor", "split")):
        assert linalg.relative_residual(a, grounding.solve(a, b, how).x, b).first()[0] < 1e-6
    with pytest.raises(ValueError, match="near-null"):
        grounding.solve(a, b, grounding.plan("amgcl", ground="coarse"))


def test_census_tells_the_worst(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (2, 2, 9.0), (0, 1, -3.0), (1, 0, -1.0), (2, 1, -1.0), (1, 2, -8.0)], "i long, j long, a double")
    c = operator.census(a).first()
    assert (c.worst_deficient, c.asymmetric, c.asymmetric_i, c.asymmetric_j) == (1, 2, 2, 1)


def test_command_line(spark, tmp_path, capsys):
    p = tmp_path / "path.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real symmetric\n4 4 7\n1 1 1\n2 2 2\n3 3 2\n4 4 1\n2 1 -1\n3 2 -1\n4 3 -1\n")
    assert main([str(p), "--random-rhs", "-o", str(tmp_path / "x"), "--report", str(tmp_path / "r.json")], spark) == 0
    assert matrix_market.read_vector(spark, str(tmp_path / "x"), 4).count() == 4 and report.read(spark, str(tmp_path / "r.json")).first()["converged"]
    assert "every row sums to zero" in capsys.readouterr().err
    assert main([str(p), "--rhs", str(tmp_path / "x"), "--input-kind", "laplacian", "--tier", "jacobi"], spark) == 0
    q = tmp_path / "bad.mtx"
    q.write_text("%%MatrixMarket matrix coordinate real general\n2 2 1\n2 1 -1\n")
    assert main([str(q), "--random-rhs"], spark) == 2 and "not symmetric" in capsys.readouterr().err


def test_compressed_columns(spark):
    a = compressed.from_csc(spark, np.array([0, 2, 3], np.int32), [0, 1, 1], np.array([1, 2, 3], np.float32))
    assert sorted(map(tuple, a.collect())) == [(0, 0, 1.0), (1, 0, 2.0), (1, 1, 3.0)]
    back = compressed.to_csc(a.selectExpr("j AS col", "i AS row", "a AS val"), 2)
    assert [x.tolist() for x in back] == [[0, 2, 3], [0, 1, 1], [1.0, 2.0, 3.0]]
    with pytest.raises(ValueError):
        compressed.from_csc(spark, [0, 2], [0], [1.0])


def test_reports(spark, tmp_path):
    for k in (3, 1, 2):
        report.append(spark, [{"name": "q", "seconds": float(k)}], str(tmp_path / "r.csv"))
    rows = [x.asDict() for x in report.read(spark, str(tmp_path / "r.csv")).collect()]
    assert len(rows) == 3 and report.median_run(rows)["seconds"] == 2.0
