"""Queries over the tables, one for each operator, and the SQL that says what they return."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators import components, eliminate, factor, linalg, operator, select
from meshwright.plans import grounding, solver
from meshwright.session import materialise, shared_folder, spread, workers_see_package
from meshwright.sources import compressed, generators, matrix_market, rhs, tables

SEED = 42
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return keep


_NATION = """
  pairs AS (SELECT c_nationkey::BIGINT AS cn, s_nationkey::BIGINT AS sn FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
  e AS (SELECT least(cn, sn) AS u, greatest(cn, sn) AS v, count(*)::DOUBLE AS w FROM pairs WHERE cn <> sn GROUP BY 1, 2),
  b AS (SELECT u, v, w FROM e UNION ALL SELECT v, u, w FROM e),
  vx AS (SELECT n_nationkey::BIGINT AS v FROM nation),
  lap AS (SELECT vx.v AS i, vx.v AS j, coalesce(sum(w), 0.0)::DOUBLE AS a FROM vx LEFT JOIN b ON b.u = vx.v GROUP BY vx.v UNION ALL SELECT u, v, -w FROM b),
  ex AS (SELECT vx.v, count(cn)::DOUBLE AS excess FROM vx LEFT JOIN pairs ON cn = vx.v AND sn = vx.v GROUP BY vx.v)"""
_SUPP = """
  e AS (SELECT l_suppkey AS u, l_partkey + 1000000 AS v, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2),
  b AS (SELECT u, v, w FROM e UNION ALL SELECT v, u, w FROM e),
  lap AS (SELECT u AS i, u AS j, sum(w)::DOUBLE AS a FROM b GROUP BY u UNION ALL SELECT u, v, -w FROM b),
  deg AS (SELECT u AS v, count(*) AS deg FROM b GROUP BY u)"""
_VISITS = "d AS (SELECT user_id AS i, nx AS j, count(*)::DOUBLE AS a FROM (SELECT user_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NOT NULL GROUP BY 1, 2)"


def _census_sql(source: str) -> str:
    return f"""WITH {source}, c AS (
      SELECT j, count(*) AS stored, count(*) FILTER (NOT isfinite(a)) AS nonfinite, count(*) FILTER (i <> j) AS offdiag, count(*) FILTER (i <> j AND a > 0) AS offdiag_pos, max(a) FILTER (i = j) AS diag,
        coalesce(sum(abs(a)) FILTER (i <> j), 0) AS mass, coalesce(sum(a) FILTER (i <> j AND a > 0), 0) AS pos FROM lap GROUP BY j
    ), skewed AS (
      SELECT i, j, abs(coalesce(a, 0) - coalesce(t, 0)) AS apart FROM (SELECT i, j, a FROM lap WHERE i > j) l FULL JOIN (SELECT j AS i, i AS j, a AS t FROM lap WHERE i < j) r USING (i, j)
      WHERE apart > 1e-10 * greatest(abs(coalesce(a, 0)), abs(coalesce(t, 0)))
    ), s AS (SELECT count(*) AS skew, arg_min(struct_pack(i := i, j := j), struct_pack(x := -apart, i := i, j := j)) AS w FROM skewed)
    SELECT sum(stored)::BIGINT AS stored, sum(nonfinite)::BIGINT AS nonfinite, sum(offdiag)::BIGINT AS offdiag, sum(offdiag_pos)::BIGINT AS offdiag_pos, count(*) FILTER (diag > 0) AS diag_pos, count(*) FILTER (NOT coalesce(diag > 0, false)) AS bad_diag,
      coalesce(min(j) FILTER (NOT coalesce(diag > 0, false)), -1)::BIGINT AS first_bad_diag, sum(mass)::DOUBLE AS abs_mass, sum(pos)::DOUBLE AS pos_mass, count(*) FILTER (coalesce(diag, 0) - mass < -1e-12 * coalesce(diag, 0)) AS deficient_rows,
      count(*) FILTER (coalesce(diag, 0) - mass > 1e-12 * coalesce(diag, 0)) AS excess_rows, any_value(skew) AS "asymmetric",
      coalesce(arg_min(j, struct_pack(s := coalesce(diag, 0) - mass, j := j)) FILTER (coalesce(diag, 0) - mass < -1e-12 * coalesce(diag, 0)), -1)::BIGINT AS worst_deficient, coalesce(any_value(w.i), -1)::BIGINT AS asymmetric_i, coalesce(any_value(w.j), -1)::BIGINT AS asymmetric_j FROM c, s"""


def _census(a: DataFrame) -> DataFrame:
    return operator.census(a).fillna(-1, ["first_bad_diag", "worst_deficient", "asymmetric_i", "asymmetric_j"])


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems of every pair of nations, written once: what is made of them reads these few rows, however often."""
    return materialise(tables.nation_counts(spark, sf_dir))


def _nation_laplacian(spark: SparkSession, sf_dir: str, trade: DataFrame | None = None) -> DataFrame:
    return operator.laplacian(tables.nation_edges(spark, sf_dir, trade or _trade(spark, sf_dir)), tables.nation_vertices(spark, sf_dir))


def _supp(spark: SparkSession, sf_dir: str, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges and vertices; keep writes the edges once, for work that reads them in many jobs."""
    e = tables.supplier_part_edges(spark, sf_dir)
    e = materialise(e) if keep else e
    return e, operator.both_ways(e).select(F.col("u").alias("v")).distinct()


def _round6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


@query(f"WITH {_NATION} SELECT * FROM e")
def nation_trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.nation_edges(spark, sf_dir)


@query(f"WITH {_NATION} SELECT * FROM lap")
def nation_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_laplacian(spark, sf_dir)


@query(f"WITH {_SUPP} SELECT i, a FROM lap WHERE i = j")
def supp_part_laplacian_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator.laplacian(tables.supplier_part_edges(spark, sf_dir)).where("i = j").select("i", "a")


@query(_census_sql(_NATION))
def operator_census_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _census(_nation_laplacian(spark, sf_dir))


@query(_census_sql(_SUPP))
def operator_census_supp_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _census(operator.laplacian(tables.supplier_part_edges(spark, sf_dir)))


@query(_census_sql(f"{_VISITS}, lap AS (SELECT * FROM d)"))
def operator_census_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _census(tables.visits(spark, sf_dir))


@query(f"""WITH {_VISITS} SELECT i, j, coalesce(a, 0.0) AS lower, coalesce(t, 0.0) AS upper FROM (SELECT i, j, a FROM d WHERE i > j) l FULL JOIN (SELECT j AS i, i AS j, a AS t FROM d WHERE i < j) r USING (i, j)
  WHERE coalesce(a, 0) <> coalesce(t, 0)""")
def symmetry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator.symmetry(tables.visits(spark, sf_dir)).select("i", "j", "lower", "upper")


def _input_sql(source: str, n: str = "max(greatest(i, j)) + 1") -> str:
    return f"""SELECT ({n})::BIGINT AS n, count(*) FILTER (i <> j AND a > 0) AS off_pos, count(*) FILTER (i <> j AND a < 0) AS off_neg, count(*) FILTER (i > j) AS lower, count(*) FILTER (i < j) AS upper, count(DISTINCT i) FILTER (i = j AND a > 0) AS diag_pos FROM {source}"""


@query(f"""WITH {_VISITS}, r AS (SELECT i, coalesce(sum(a) FILTER (i = j), 0) - coalesce(sum(abs(a)) FILTER (i <> j), 0) AS slack FROM d GROUP BY i),
  q AS (SELECT count(*) FILTER (slack < 0) AS deficient_rows, count(*) FILTER (slack > 0) AS excess_rows, least(min(slack), 0)::DOUBLE AS worst_deficit, (SELECT i FROM r WHERE slack < 0 ORDER BY slack, i LIMIT 1)::BIGINT AS worst_row FROM r)
  SELECT * FROM ({_input_sql("d")}), q""")
def input_kind_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator.input_census(tables.visits(spark, sf_dir))


#: Readings of the nation operator: (name, what replaces entry a, which entries stay).
_CASES = {
    "operator": ("a", "true"), "no diagonal": ("a", "i <> j"), "adjacency": ("abs(a)", "i <> j"), "adjacency with loops": ("abs(a)", "i <> j OR i % 5 = 0"),
    "mixed, whole diagonal": ("CASE WHEN i <> j AND (i + j) % 7 = 0 THEN -a ELSE a END", "true"), "mixed, no diagonal": ("CASE WHEN (i + j) % 7 = 0 THEN -a ELSE a END", "i <> j"),
    "mixed, part of the diagonal": ("CASE WHEN i <> j AND (i + j) % 7 = 0 THEN -a ELSE a END", "i <> j OR i % 5 = 0"), "lower triangle": ("a", "i >= j"), "diagonal": ("a", "i = j"),
}
_KIND = """CASE WHEN lower + upper > 0 AND least(lower, upper) = 0 THEN 'not symmetric' WHEN off_pos = 0 THEN 'laplacian' WHEN off_neg = 0 THEN 'adjacency' WHEN diag_pos = n THEN 'laplacian' ELSE 'cannot tell' END"""


@query(f"WITH {_NATION} " + " UNION ALL ".join(f"SELECT '{k}' AS input, {_KIND} AS kind FROM ({_input_sql(f'(SELECT i, j, {x} AS a FROM lap WHERE {ok})', '25')})" for k, (x, ok) in _CASES.items()))
def input_kind_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, out = _nation_laplacian(spark, sf_dir), []
    for name, (x, ok) in _CASES.items():
        seen = operator.input_census(a.where(ok).select("i", "j", F.expr(x).alias("a")), 25).first().asDict()
        try:
            kind, _ = operator.resolve_kind(seen)
        except ValueError as e:
            kind = "not symmetric" if "not symmetric" in str(e) else "cannot tell"
        out.append((name, kind))
    return spark.createDataFrame(out, "input string, kind string")


_FLIP = "m AS (SELECT i, j, CASE WHEN i <> j AND (i + j) % 7 = 0 THEN -a ELSE a END AS a FROM lap)"


def _flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_laplacian(spark, sf_dir).withColumn("a", F.when((F.col("i") != F.col("j")) & ((F.col("i") + F.col("j")) % 7 == 0), -F.col("a")).otherwise(F.col("a")))


@query(f"""WITH {_NATION}, {_FLIP}, x AS (SELECT j, sum(a) AS x FROM m WHERE i <> j AND a > 0 GROUP BY j)
  SELECT i, m.j, (a + CASE WHEN i = m.j THEN coalesce(x, 0) ELSE 0 END)::DOUBLE AS a FROM m LEFT JOIN x ON x.j = m.j WHERE i = m.j OR a < 0""")
def lump_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator.lump(_flipped(spark, sf_dir))


@query(f"WITH {_NATION}, {_FLIP} SELECT sum(a) FILTER (a > 0) / sum(abs(a)) AS rho FROM m WHERE i <> j")
def positive_mass_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator.positive_mass_fraction(_flipped(spark, sf_dir))


@query(f"WITH {_NATION} SELECT v, excess FROM ex")
def excess_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    trade = _trade(spark, sf_dir)
    a = operator.laplacian(tables.nation_edges(spark, sf_dir, trade), tables.nation_vertices(spark, sf_dir), tables.nation_excess(spark, sf_dir, trade))
    return operator.to_graph(a)[1]


@query(f"""WITH {_NATION}, n AS (SELECT i, j, abs(a) AS w FROM lap WHERE i <> j AND a <> 0), r AS (SELECT range AS i FROM range(30))
  SELECT r.i, r.i AS j, coalesce(sum(w), 0)::DOUBLE AS a FROM r LEFT JOIN n ON n.i = r.i GROUP BY r.i UNION ALL SELECT i, j, -w FROM n""")
def adjacency_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _nation_laplacian(spark, sf_dir).where("i <> j").withColumn("a", -F.col("a"))
    return operator.adjacency_to_laplacian(a, 30)


@query(f"WITH {_NATION} SELECT i, j, CASE WHEN i = j THEN a + 0.5 * (SELECT avg(abs(a)) FROM lap WHERE i = j) ELSE a END AS a FROM lap")
def regularised_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator.regularise(_nation_laplacian(spark, sf_dir), 0.5)


@query("SELECT bool_and(c_acctbal = c_acctbal::FLOAT::DOUBLE) AS exact FROM customer")
def fp32_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator.fp32_exact(tables.read(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("a")))


@query(f"WITH {_NATION} SELECT i, j, a FROM lap WHERE i >= j UNION ALL SELECT j, i, a FROM lap WHERE i > j")
def mirrored_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operator.from_lower(_nation_laplacian(spark, sf_dir))


@query(f"WITH {_SUPP} SELECT v, deg FROM deg")
def live_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.degrees(*_supp(spark, sf_dir))


_CAP = "cap AS (SELECT deg AS cap FROM (SELECT deg, row_number() OVER (ORDER BY deg) - 1 AS k, count(*) OVER () AS n FROM deg) WHERE k = floor(0.2::DOUBLE * n))"


@query(f"WITH {_SUPP}, {_CAP} SELECT cap FROM cap")
def degree_quantile_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.quantile_cap(select.degrees(*_supp(spark, sf_dir)))


@query(f"WITH {_SUPP}, {_CAP} SELECT v, deg FROM deg, cap WHERE deg <= cap")
def degree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    degs = select.degrees(*_supp(spark, sf_dir))
    return select.under_cap(degs, select.quantile_cap(degs))


_HASH = f"(v * {select.MULTIPLIER} + {SEED * select.STEP}) % {select.MODULUS}"
_MINIMA = """SELECT v FROM r WHERE NOT EXISTS (SELECT 1 FROM b JOIN r q ON q.v = b.v WHERE b.u = r.v AND (q.deg, q.h, q.v) <= (r.deg, r.h, r.v))"""


@query(f"WITH {_SUPP}, r AS (SELECT v, deg, {_HASH} AS h FROM deg WHERE {_HASH} <= least(1.0::DOUBLE, 1 / (0.3::DOUBLE * (SELECT avg(deg) FROM deg))) * {select.MODULUS}) {_MINIMA}")
def bk_sample_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, vertices = _supp(spark, sf_dir)
    return select.baumann_kyng(edges, select.degrees(edges, vertices), SEED)


@query(f"WITH {_SUPP}, r AS (SELECT v, deg, {_HASH} AS h FROM deg) {_MINIMA}")
def luby_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, vertices = _supp(spark, sf_dir)
    return select.local_minima(edges, select.by_degree(select.degrees(edges, vertices), SEED))


def _invariants(name: str, sets: Callable[[SparkSession, str], tuple[DataFrame, DataFrame, DataFrame]], maximal: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_see_package(spark)
        edges, vertices, chosen = sets(spark, sf_dir)
        free = vertices.join(chosen, "v", "left_anti").join(select.neighbours_of(edges, chosen), "v", "left_anti")
        return spark.createDataFrame([(bool(chosen.take(1)), not select.conflicts(edges, chosen).take(1), not maximal or not free.take(1))], "chosen boolean, independent boolean, maximal boolean")

    run.__name__ = name
    query("SELECT true AS chosen, true AS independent, true AS maximal")(run)


def _chosen(rule: Callable[[DataFrame, DataFrame], DataFrame]):
    def sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        edges, vertices = _supp(spark, sf_dir, keep=True)
        return edges, vertices, rule(edges, select.degrees(edges, vertices))

    return sets


_invariants("lfmis_independent", _chosen(lambda e, d: select.greedy(e, d.select("v", F.col("deg").alias("p")))), True)
_invariants("rootset_maximal", _chosen(lambda e, d: select.rootset(e, d)), True)
_invariants("luby_independent", _chosen(lambda e, d: select.luby(e, d)), False)
_invariants("block_greedy_independent", _chosen(lambda e, d: select.block_greedy(e, d)), True)

#: The nation graph is almost complete, so a round takes out one vertex; the parts, an independent set of the bipartite graph, give a real one.
_ROUND = f"""{_SUPP}, sel AS (SELECT v FROM deg WHERE v >= 1000000), st AS (SELECT b.u AS v, b.v AS u, w FROM b JOIN sel ON sel.v = b.u),
  tot AS (SELECT v, sum(w) + (v % 3) AS total, (v % 3)::DOUBLE AS e FROM st GROUP BY v)"""


def _round(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges, vertices = _supp(spark, sf_dir)
    picked = vertices.where(f"v >= {tables.PART_OFFSET}").select("v", (F.col("v") % 3).cast("double").alias("excess"))
    star = eliminate.stars(edges, picked)
    return edges, star, eliminate.totals(star, picked)


@query(f"WITH {_ROUND} SELECT u, v, round(sum(w), 6) + 0.0 AS w FROM (SELECT x.u, y.u AS v, x.w * y.w / total AS w FROM st x JOIN st y ON x.v = y.v AND x.u < y.u JOIN tot ON tot.v = x.v) GROUP BY u, v")
def exact_clique_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, star, total = _round(spark, sf_dir)
    return _round6(spread(eliminate.exact_clique(star, total), "u", "v").groupBy("u", "v").agg(F.sum("w").alias("w")), "w")


@query(f"WITH {_ROUND} SELECT u AS v, round(sum(w * e / total), 6) + 0.0 AS change FROM st JOIN tot USING (v) WHERE e > 0 GROUP BY u")
def excess_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, star, total = _round(spark, sf_dir)
    return _round6(eliminate.excess_change(star, total), "change")


@query(f"WITH {_ROUND} SELECT v AS col, v AS row, round(sqrt(total), 6) + 0.0 AS val FROM tot UNION ALL SELECT v, u, round(-w / sqrt(total), 6) + 0.0 FROM st JOIN tot USING (v)")
def factor_column_round1(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, star, total = _round(spark, sf_dir)
    return _round6(eliminate.factor_columns(star, total), "val")


@query(f"WITH {_ROUND} SELECT (sum(d) - count(*))::BIGINT AS edges FROM (SELECT count(*) AS d FROM st GROUP BY v)")
def tree_sample_edges_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_see_package(spark)
    _, star, total = _round(spark, sf_dir)
    return eliminate.tree_clique(star, total).agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT l_suppkey AS u, l_partkey + 1000000 AS v, sum(l_quantity) AS w, count(*) AS mult FROM lineitem GROUP BY 1, 2")
def coalesce_multigraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") + tables.PART_OFFSET).alias("u"), F.col("l_suppkey").alias("v"), F.col("l_quantity").alias("w"))
    return eliminate.coalesce_edges(line)


@query("SELECT count(*) / count(DISTINCT (l_suppkey, l_partkey)) AS ratio FROM lineitem")
def duplicate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") + tables.PART_OFFSET).alias("u"), F.col("l_suppkey").alias("v"))
    return eliminate.duplicate_ratio(line)


#: Rounds on which the yield rules are asked: (base, active, mean degree, hand-off size or none, candidates, chosen).
_YIELDS = [(b, n, d, h, c, k) for b in (0.0, 0.03, 0.05, 0.2) for n in (900, 1000, 2000, 2001, 5000) for d in (8.0, 500.0) for h in (None, 500) for c in (400, 800) for k in (0, 20, 100, 121)]


@query(f"""WITH y(base, active, degree, handoff, candidates, chosen) AS (VALUES {", ".join(str(x).replace("None", "NULL") for x in _YIELDS)}),
  l AS (SELECT *, CASE WHEN base > 0 AND active > 4 * handoff AND degree >= handoff THEN greatest(base::DOUBLE, least(0.15::DOUBLE, 3 * base::DOUBLE)) ELSE base::DOUBLE END AS least FROM y)
  SELECT base::DOUBLE AS base, active::BIGINT AS active, degree::DOUBLE AS degree, coalesce(handoff, -1)::BIGINT AS handoff, candidates::BIGINT AS candidates, chosen::BIGINT AS chosen, round(least, 6) AS least,
    chosen = 0 OR ((handoff IS NULL OR active > 2 * handoff) AND chosen < least * candidates) AS given_up FROM l""")
def round_yield_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(*x, select.least_yield(x[0], x[1], x[2], x[3])) for x in _YIELDS]
    rows = [(*x[:3], -1 if x[3] is None else x[3], *x[4:6], round(x[6], 6), select.too_little(x[5], x[4], x[1], x[6], x[3])) for x in rows]
    return spark.createDataFrame(rows, "base double, active long, degree double, handoff long, candidates long, chosen long, least double, given_up boolean")


#: The factor columns of a round that takes out all parts.
_G = "g AS MATERIALIZED (SELECT v AS col, v AS row, sqrt(total) AS val FROM tot UNION ALL SELECT v, u, -w / sqrt(total) FROM st JOIN tot USING (v))"


def _g(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, star, total = _round(spark, sf_dir)
    return eliminate.factor_columns(star, total)


@query(f"""WITH {_ROUND}, {_G}, t AS (SELECT *, max(abs(val)) FILTER (row <> col) OVER (PARTITION BY col) AS top FROM g), k AS (SELECT *, row = col OR abs(val) >= 0.6::DOUBLE * top AS keep FROM t),
  s AS (SELECT *, sum(CASE WHEN keep THEN 0 ELSE val END) OVER (PARTITION BY col) AS lost, sum(CASE WHEN keep AND row <> col THEN abs(val) ELSE 0 END) OVER (PARTITION BY col) AS mass FROM k)
  SELECT col, row, round(CASE WHEN row <> col AND mass > 0 THEN val + lost * abs(val) / mass ELSE val END, 6) + 0.0 AS val FROM s WHERE keep""")
def factor_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round6(factor.drop_small(_g(spark, sf_dir), 0.6), "val")


@query(f"WITH {_ROUND}, {_G} SELECT col, round(coalesce(max(abs(val)) FILTER (row <> col), 1.0), 6) + 0.0 AS scale FROM g GROUP BY col")
def column_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round6(factor.column_scale(_g(spark, sf_dir)), "scale")


@query(f"""WITH {_ROUND}, {_G}, x AS (SELECT *, coalesce(max(abs(val)) FILTER (row <> col) OVER (PARTITION BY col), 1.0) AS scale FROM g),
  s AS (SELECT *, val / scale AS x, pow(2.0::DOUBLE, greatest(floor(log2(abs(val / scale))), -14) - 10) AS step FROM x), h AS (SELECT *, round_even(x / step, 0) * step AS h FROM s),
  k AS (SELECT *, CASE WHEN abs(h) < pow(2.0::DOUBLE, -14) THEN 0.0 ELSE h * scale END AS kept FROM h)
  SELECT col, row, round(CASE WHEN row <> col THEN kept ELSE val + sum(CASE WHEN row <> col THEN val - kept ELSE 0 END) OVER (PARTITION BY col) END, 6) + 0.0 AS val FROM k""")
def half_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round6(factor.narrow(_g(spark, sf_dir)), "val")


@query(f"WITH {_ROUND}, {_G} SELECT col, row, round(val, 6) + 0.0 AS val FROM g WHERE row < 1000500 AND col < 1000500")
def leading_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round6(factor.leading_block(_g(spark, sf_dir), 1_000_500), "val")


@query(f"WITH {_ROUND}, {_G} SELECT (w.deg // 3)::INTEGER AS level, count(DISTINCT col) AS rows, count(*) AS nnz FROM g JOIN deg w ON w.v = col GROUP BY 1")
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, vertices = _supp(spark, sf_dir)
    rounds = select.degrees(edges, vertices).select(F.col("v").alias("pos"), F.floor(F.col("deg") / 3).cast("int").alias("round"))
    return factor.level_histogram(_g(spark, sf_dir), rounds)


@query(f"WITH {_ROUND}, {_G}, p AS MATERIALIZED (SELECT col, val AS p FROM g WHERE row = col) SELECT g.col, row, round(val / p, 6) + 0.0 AS val FROM g JOIN p ON p.col = g.col")
def unit_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round6(factor.ldl(_g(spark, sf_dir))[0], "val")


@query(f"WITH {_SUPP} SELECT DISTINCT i AS v, 0.0::DOUBLE AS y FROM lap")
def spmv_ones_is_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = _supp(spark, sf_dir)
    return linalg.spmv(operator.laplacian(e), v.select("v", F.lit(1.0).alias("x"))).select("v", (F.col("y") + 0.0).alias("y"))


@query(f"WITH {_SUPP} SELECT u AS v, sum(w)::DOUBLE AS y FROM b GROUP BY u")
def spmv_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = _supp(spark, sf_dir)
    return linalg.spmv(operator.both_ways(e).select(F.col("u").alias("i"), F.col("v").alias("j"), F.col("w").alias("a")), v.select("v", F.lit(1.0).alias("x")))


@query(f"WITH {_SUPP} SELECT sum(w * ((u % 5) - (v % 5)) * ((u % 5) - (v % 5)))::DOUBLE AS xax FROM e")
def quadratic_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = _supp(spark, sf_dir)
    return linalg.quadratic(operator.laplacian(e), v.select("v", (F.col("v") % 5).cast("double").alias("x")))


@query(f"""WITH {_SUPP}, x AS (SELECT v, (v % 5)::DOUBLE AS x, ((v % 3) - 1)::DOUBLE AS b FROM deg), y AS (SELECT i AS v, sum(a * x.x) AS y FROM lap JOIN x ON x.v = lap.j GROUP BY i)
  SELECT round(sqrt(sum((b - y) * (b - y)) / sum(b * b)), 6) AS residual FROM x JOIN y USING (v)""")
def residual_of_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = _supp(spark, sf_dir)
    x, b = v.select("v", (F.col("v") % 5).cast("double").alias("x")), v.select("v", ((F.col("v") % 3) - 1).cast("double").alias("x"))
    return _round6(linalg.relative_residual(operator.laplacian(e), x, b), "residual")


@query("SELECT c_custkey AS v, round(c_acctbal - avg(c_acctbal) OVER (), 4) + 0.0 AS x FROM customer")
def mean_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = linalg.centre(tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("v"), F.col("c_acctbal").alias("x")))
    return x.select("v", (F.round("x", 4) + 0.0).alias("x"))


@query("SELECT n_nationkey::BIGINT AS v, ((n_nationkey * 7 + 3) % 25)::DOUBLE AS x FROM nation")
def permute_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.nation_vertices(spark, sf_dir)
    perm = v.select("v", ((F.col("v") * 7 + 3) % 25).alias("pos"))
    return linalg.gather(v.select("v", F.col("v").cast("double").alias("x")), perm)


_REACH = """cc(v, component) USING KEY (v) AS (SELECT u, u FROM (SELECT DISTINCT u FROM b) UNION (SELECT b.v, min(cc.component) FROM cc JOIN b ON b.u = cc.v JOIN recurring.cc q ON q.v = b.v WHERE cc.component < q.component GROUP BY b.v)),
  comp AS MATERIALIZED (SELECT v, component FROM cc)"""


@query(f"WITH RECURSIVE {_SUPP}, {_REACH} SELECT v, component FROM comp")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(*_supp(spark, sf_dir, keep=True))


@query(f"""WITH RECURSIVE {_SUPP}, {_REACH}, pins AS (SELECT DISTINCT component AS p FROM comp)
  SELECT i, j, a FROM lap WHERE i NOT IN (SELECT p FROM pins) AND j NOT IN (SELECT p FROM pins) UNION ALL SELECT p, p, 1.0::DOUBLE FROM pins""")
def dirichlet_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = _supp(spark, sf_dir, keep=True)
    return components.pin_components(operator.laplacian(e, v), components.components(e, v))


def _grid_sql(k: str, n: int, m: int) -> str:
    return f"""WITH c AS (SELECT range AS id, range // {m} AS r, range % {m} AS c FROM range({n * m})), q AS (SELECT id, r, c, {k} AS k FROM c)
      SELECT a.id AS u, b.id AS v, 2.0::DOUBLE * a.k * b.k / (a.k + b.k) AS w FROM q a JOIN q b ON (b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1)"""


@query(_grid_sql("CASE WHEN c < 12 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END", 20, 30))
def grid2d_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.grid2d(spark, 20, 30, 12, 1.0, 100.0)


@query("""WITH c AS (SELECT range AS id, range % 6 AS x, range // 6 % 7 AS y, range // 42 AS z FROM range(336))
  SELECT a.id AS u, b.id AS v, 2.0::DOUBLE AS w FROM c a JOIN c b ON b.id > a.id AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1""")
def grid3d_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.grid3d(spark, 6, 7, 8, 2.0)


@query(_grid_sql("CASE WHEN (r // 4 + c // 4) % 2 = 0 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END", 16, 20))
def checkerboard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.checkerboard(spark, 16, 20, 4, 1000.0, 1.0)


@query("""SELECT 'star' AS kind, 0::BIGINT AS u, range AS v, 1.0::DOUBLE AS w FROM range(1, 10) UNION ALL SELECT 'cycle', range, range + 1, 1.0::DOUBLE FROM range(19) UNION ALL SELECT 'cycle', 0, 19, 1.0::DOUBLE
  UNION ALL SELECT 'path', range, range + 1, 1.0::DOUBLE FROM range(7)""")
def star_cycle_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f(spark, n).withColumn("kind", F.lit(k)) for k, f, n in (("star", generators.star, 10), ("cycle", generators.cycle, 20), ("path", generators.path, 8))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT true AS simple, true AS dense_enough")
def erdos_renyi_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_see_package(spark)
    e = generators.erdos_renyi(spark, 2000, 0.01)
    return e.agg((F.count_if(F.col("u") >= F.col("v")) == 0).alias("simple"), F.count(F.lit(1)).between(18_000, 22_000).alias("dense_enough"))


@query("SELECT true AS simple, true AS dense_enough")
def random_geometric_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = generators.random_geometric(spark, 2000, 0.05)
    return e.agg((F.count_if(F.col("u") >= F.col("v")) == 0).alias("simple"), F.count(F.lit(1)).between(10_000, 20_000).alias("dense_enough"))


@query("SELECT true AS mean_zero, true AS unit")
def random_rhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rhs.random_zero_mean(tables.nation_vertices(spark, sf_dir))
    return x.agg((F.abs(F.avg("x")) < 1e-14).alias("mean_zero"), (F.abs(F.sum(F.col("x") ** 2) - 1) < 1e-12).alias("unit"))


@query("SELECT true AS sums_to_zero, true AS unit")
def range_space_rhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rhs.range_space(_nation_laplacian(spark, sf_dir), tables.nation_vertices(spark, sf_dir))
    return x.agg((F.abs(F.sum("x")) < 1e-12).alias("sums_to_zero"), (F.abs(F.sum(F.col("x") ** 2) - 1) < 1e-12).alias("unit"))


def _balance(spark: SparkSession, sf_dir: str, p: DataFrame) -> DataFrame:
    """Lineitems sold minus bought of every nation: sums to zero."""
    net = p.select(F.col("sn").alias("v"), F.col("w").alias("x")).unionByName(p.select(F.col("cn").alias("v"), (-F.col("w")).alias("x"))).groupBy("v").agg(F.sum("x").alias("x"))
    return tables.nation_vertices(spark, sf_dir).join(net, "v", "left").fillna(0.0, ["x"])


def _balanced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The nation operator and the balance it is solved for."""
    trade = _trade(spark, sf_dir)
    return _nation_laplacian(spark, sf_dir, trade), _balance(spark, sf_dir, trade)


def _pcg_sql(steps: int) -> str:
    ctes = [_NATION, "bal AS (SELECT vx.v, coalesce(sum(x), 0)::DOUBLE AS x FROM vx LEFT JOIN (SELECT sn AS v, 1.0::DOUBLE AS x FROM pairs UNION ALL SELECT cn, -1.0::DOUBLE FROM pairs) t ON t.v = vx.v GROUP BY vx.v)", "dg AS (SELECT i AS v, a AS d FROM lap WHERE i = j)"]
    ctes.append("s0 AS MATERIALIZED (SELECT v, 0.0::DOUBLE AS x, bal.x AS r, d, bal.x / d AS p FROM bal JOIN dg USING (v))")
    for k in range(steps):
        ctes += [
            f"y{k} AS MATERIALIZED (SELECT s.v, any_value(s.x) AS x, any_value(s.r) AS r, any_value(s.d) AS d, any_value(s.p) AS p, sum(a * t.p) AS y FROM s{k} s JOIN lap ON lap.i = s.v JOIN s{k} t ON t.v = lap.j GROUP BY s.v)",
            f"m{k} AS MATERIALIZED (SELECT v, x + al * p AS x, r - al * y AS r, d, p, rz FROM y{k}, (SELECT sum(r * r / d) AS rz, sum(r * r / d) / sum(p * y) AS al FROM y{k}))",
            f"s{k + 1} AS MATERIALIZED (SELECT v, x, r, d, r / d + (SELECT sum(r * r / d) FROM m{k}) / rz * p AS p FROM m{k})",
        ]
    return f"WITH {', '.join(ctes)} SELECT v, round(x, 6) + 0.0 AS x, round(r, 4) + 0.0 AS r FROM s{steps}"


@query(_pcg_sql(3))
def jacobi_pcg_3_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _ = linalg.jacobi_pcg(*_balanced(spark, sf_dir), 3)
    return x.select("v", (F.round("x", 6) + 0.0).alias("x"), (F.round("r", 4) + 0.0).alias("r"))


@query(f"WITH {_NATION}, bal AS (SELECT vx.v, coalesce(sum(x), 0)::DOUBLE AS imbalance FROM vx LEFT JOIN (SELECT sn AS v, 1.0::DOUBLE AS x FROM pairs UNION ALL SELECT cn, -1.0::DOUBLE FROM pairs) t ON t.v = vx.v GROUP BY vx.v) SELECT n_name, imbalance, true AS settled FROM bal JOIN nation ON n_nationkey = v")
def nation_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Potentials at which trade between nations balances: L x = sold - bought, solved to 1e-8, checked at every nation."""
    a, b = _balanced(spark, sf_dir)
    got = solver.solve(a, b)
    left = linalg.residual(a, got.x, b)
    names = tables.read(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("v"))
    settled = (F.abs("r") <= 1e-6 * F.greatest(F.abs("x"), F.lit(1.0))) & F.lit(got.converged)
    return b.join(left, "v").join(names, "v").select("n_name", F.col("x").alias("imbalance"), settled.alias("settled"))


def _solved(name: str, sql: str, run: Query) -> None:
    def safe(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_see_package(spark)
        return run(spark, sf_dir)

    safe.__name__ = name
    query(sql)(safe)


def _zero_sum(vertices: DataFrame) -> DataFrame:
    return rhs.random_zero_mean(vertices)


def _solve_supp_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _supp(spark, sf_dir)
    a = materialise(operator.laplacian(e))
    got = solver.solve(a, materialise(rhs.range_space(a, a.where("i = j").select(F.col("i").alias("v")))), maxiter=200)
    return spark.createDataFrame([(got.converged,)], "converged boolean")


def _solve_by_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = _supp(spark, sf_dir, keep=True)
    a = materialise(operator.laplacian(e, v))
    b = materialise(rhs.range_space(a, v))
    got = solver.solve(a, b, "component")
    return linalg.relative_residual(a, got.x, b).select((F.col("residual") < 1e-8).alias("converged"))


def _solve_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation operator with a vertex of each component fixed; what a pin takes up is its own balance, which is that of all others."""
    a, b = _balanced(spark, sf_dir)
    got = grounding.solve(a, b, grounding.Plan(True, "whole", "pin"))
    return linalg.relative_residual(a, got.x, b).select((F.col("residual") < 1e-6).alias("converged"))


def _solve_bk_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = operator.laplacian(generators.grid2d(spark, 60, 60))
    got = solver.solve(a, rhs.range_space(a, spark.range(3600).select(F.col("id").alias("v"))), peel="bk_serial")
    return spark.createDataFrame([(got.converged,)], "converged boolean")


def _warm_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _balanced(spark, sf_dir)
    s = solver.Solver(a)
    x = s.solve(b, 1e-12)
    return spark.createDataFrame([(s.solve(b, 1e-8, x0=x.x).iters, s.solve(b, maxiter=0).residual)], "iterations int, untouched double")


def _exact_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _balanced(spark, sf_dir)
    got = solver.Solver(a, sampler="exact").solve(b)
    return spark.createDataFrame([(got.iters <= 3, got.converged)], "few boolean, converged boolean")


def _factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = generators.grid2d(spark, 20, 20)
    fac = solver.factorize(operator.laplacian(edges), peel_below=200, degree_quantile=0.5)
    return spark.createDataFrame([(factor.quality(operator.laplacian(edges), fac.matrix(), fac.perm) < 0.45,)], "close boolean")


_solved("solve_supp_part", "SELECT true AS converged", _solve_supp_part)
_solved("solve_pinned", "SELECT true AS converged", _solve_pinned)
_solved("solve_bk_serial", "SELECT true AS converged", _solve_bk_serial)
_solved("solve_by_component", "SELECT true AS converged", _solve_by_component)
_solved("warm_start_zero_iters", "SELECT 0::INTEGER AS iterations, 1.0::DOUBLE AS untouched", _warm_start)
_solved("exact_factor_le_3_iters", "SELECT true AS few, true AS converged", _exact_factor)
_solved("factor_quality_ok", "SELECT true AS close", _factor_quality)


@query("""WITH q AS (SELECT s.solver, d.asked_decompose, g.asked_ground, c.disconnected, CASE WHEN g.asked_ground <> 'auto' THEN g.asked_ground WHEN s.solver = 'factor' THEN 'native' ELSE 'pin' END AS ground
    FROM (VALUES ('factor'), ('amgcl'), ('boomeramg')) s(solver), (VALUES ('auto'), ('whole'), ('split')) d(asked_decompose), (VALUES ('auto'), ('native'), ('pin'), ('coarse')) g(asked_ground), (VALUES (true), (false)) c(disconnected)),
  p AS (SELECT *, CASE WHEN asked_decompose <> 'auto' THEN asked_decompose WHEN disconnected AND (ground = 'coarse' OR solver = 'boomeramg') THEN 'split' ELSE 'whole' END AS decompose FROM q)
  SELECT *, CASE solver WHEN 'factor' THEN ground = 'native' WHEN 'amgcl' THEN ground IN ('pin', 'coarse') ELSE ground = 'pin' END AND NOT (ground = 'coarse' AND decompose = 'whole' AND disconnected) AS supported FROM p""")
def grounding_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, d, g, c, grounding.plan(k, d, g, c)) for k in grounding.GROUNDS for d in ("auto", *grounding.DECOMPOSE) for g in ("auto", "native", "pin", "coarse") for c in (True, False)]
    return spark.createDataFrame([(*x[:4], x[4].ground, x[4].decompose, x[4].supported) for x in rows], "solver string, asked_decompose string, asked_ground string, disconnected boolean, ground string, decompose string, supported boolean")


_CELLS = "c AS (SELECT range AS id, range // 12 AS r, range % 12 AS c FROM range(120)), g AS (SELECT a.id AS u, b.id AS v, b.r - a.r AS dr FROM c a JOIN c b ON (b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1))"
_GRIDLAP = "w AS (SELECT u, v, 1.0::DOUBLE AS w FROM g UNION ALL SELECT v, u, 1.0::DOUBLE FROM g), lap AS (SELECT u AS i, u AS j, sum(w) AS a FROM w GROUP BY u UNION ALL SELECT u, v, -w FROM w)"


@query(f"WITH {_CELLS} SELECT u, v, CASE WHEN dr = 1 THEN 50.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM g")
def aniso_grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.aniso_grid(spark, 10, 12, 50.0)


@query(f"WITH {_CELLS} SELECT u, v, 1 + 99.0::DOUBLE * (((u * 65537 + v) * {select.MULTIPLIER} + {SEED * select.STEP}) % {select.MODULUS}) / {select.MODULUS}.0::DOUBLE AS w FROM g")
def weighted_grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.weighted_grid(spark, 10, 12, 100.0, SEED)


@query("SELECT 7 * k + a AS u, 7 * k + b AS v, 1.0::DOUBLE AS w FROM range(3) x(k), range(7) y(a), range(7) z(b) WHERE a < b UNION ALL SELECT 7 * k, 21, 1.0::DOUBLE FROM range(3) x(k)")
def star_of_cliques_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.star_of_cliques(spark, 7)


@query(f"WITH {_CELLS}, {_GRIDLAP} SELECT i, j, CASE WHEN i = j THEN a + 0.25::DOUBLE ELSE a END AS a FROM lap")
def sddm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.grounded(operator.laplacian(generators.grid2d(spark, 10, 12)), 0.25)


@query(f"""WITH {_CELLS}, {_GRIDLAP}, f AS (SELECT i AS x, j AS y FROM lap WHERE i < j ORDER BY ((i * 65537 + j) * {select.MULTIPLIER} + {SEED * select.STEP}) % {select.MODULUS}, i, j LIMIT 9)
  SELECT i, j, CASE WHEN x IS NULL THEN a ELSE -a END AS a FROM lap LEFT JOIN f ON x = least(i, j) AND y = greatest(i, j)""")
def nearly_sddm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.flipped(operator.laplacian(generators.grid2d(spark, 10, 12)), 9, SEED)


@query(f"WITH {_SUPP} SELECT i, j, a FROM lap")
def lists_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = operator.both_ways(tables.supplier_part_edges(spark, sf_dir))
    return operator.lists_to_laplacian(both.select(F.col("u").alias("v"), F.col("v").alias("to"), "w"))


@query(f"WITH {_VISITS} SELECT j AS i, i AS j, a FROM d")
def transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed.transpose(tables.visits(spark, sf_dir))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_NATION} SELECT i, j, a FROM lap")
def matrix_market_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read back."""
    matrix_market.write_matrix(_nation_laplacian(spark, sf_dir), 25, path := _folder(spark, "matrix"))
    return matrix_market.read_operator(spark, path)


@query(f"WITH {_NATION} SELECT i, j, -a AS a FROM lap WHERE i <> j")
def matrix_market_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix_market.write_matrix(_nation_laplacian(spark, sf_dir), 25, path := _folder(spark, "matrix"))
    return matrix_market.read_adjacency(spark, path)


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS v, c_acctbal AS x FROM customer")
def matrix_market_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("v"), F.col("c_acctbal").alias("x"))
    matrix_market.write_vector(x, path := _folder(spark, "vector"))
    return matrix_market.read_vector(spark, path)


@query(f"WITH {_ROUND}, l AS (SELECT col, row, val FROM (SELECT v AS col, v AS row, sqrt(total) AS val FROM tot UNION ALL SELECT v, u, -w / sqrt(total) FROM st JOIN tot USING (v))) SELECT count(*) AS nnz, round((2.0::DOUBLE * count(*) - count(DISTINCT col)) / (SELECT count(*) FROM lap), 6) AS fill FROM l")
def factor_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, a = _g(spark, sf_dir), operator.laplacian(tables.supplier_part_edges(spark, sf_dir))
    n, nnz = g.groupBy("col").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)), F.sum("k")).first()
    return spark.createDataFrame([(nnz, round((2 * nnz - n) / a.count(), 6))], "nnz long, fill double")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
