"""Operators A(i, j, a): census, contract, lumping, readings of a matrix as a graph and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.session import spread

SYMMETRY_TOL, LUMP_CEILING, EXCESS_TOL = 1e-10, 0.25, 1e-12


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "w").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def laplacian(edges: DataFrame, vertices: DataFrame | None = None, excess: DataFrame | None = None) -> DataFrame:
    """L = D - W; with vertices, each has a diagonal entry; excess(v, excess) is added to it."""
    both = both_ways(edges)
    diag = both.groupBy(F.col("u").alias("i")).agg(F.sum("w").alias("d"))
    if vertices is not None:
        diag = vertices.select(F.col("v").alias("i")).join(diag, "i", "left").select("i", F.coalesce("d", F.lit(0.0)).alias("d"))
    if excess is not None:
        diag = diag.join(excess, F.col("i") == F.col("v"), "left").select("i", (F.col("d") + F.coalesce("excess", F.lit(0.0))).alias("d"))
    return diag.select("i", F.col("i").alias("j"), F.col("d").alias("a")).unionByName(both.select(F.col("u").alias("i"), F.col("v").alias("j"), (-F.col("w")).alias("a")))


def adjacency_to_laplacian(a: DataFrame, n: int, sum_first: bool = False) -> DataFrame:
    """L = D - |A| without loops and zeros; sum_first sums duplicates before taking absolute values."""
    off = a.where("i <> j")
    off = off.groupBy("i", "j").agg(F.abs(F.sum("a")).alias("w") if sum_first else F.sum(F.abs("a")).alias("w")).where("w > 0")
    diag = off.groupBy("i").agg(F.sum("w").alias("d"))
    every = a.sparkSession.range(n).select(F.col("id").alias("i")).join(diag, "i", "left")
    return every.select("i", F.col("i").alias("j"), F.coalesce("d", F.lit(0.0)).alias("a")).unionByName(off.select("i", "j", (-F.col("w")).alias("a")))


def lists_to_laplacian(lists: DataFrame) -> DataFrame:
    """Neighbours lists(v, to, w), every edge in the lists of both its ends: each of these gives -w / 2 to both slots."""
    ends = lists.groupBy("v").agg(F.sum("w").alias("a")).select(F.col("v").alias("i"), F.col("v").alias("j"), "a")
    half = lists.select(F.explode(F.array(F.struct(F.col("v").alias("i"), F.col("to").alias("j")), F.struct(F.col("to").alias("i"), F.col("v").alias("j")))).alias("x"), (-F.col("w") / 2).alias("a")).select("x.*", "a")
    return spread(ends.unionByName(half), "i", "j").groupBy("i", "j").agg(F.sum("a").alias("a"))


def symmetry(a: DataFrame, tol: float = SYMMETRY_TOL) -> DataFrame:
    """Pairs i > j whose two entries differ: (i, j, lower, upper); a missing entry counts as 0."""
    side = lambda cond, i, j, name: spread(a.where(cond).select(F.col(i).alias("i"), F.col(j).alias("j"), F.col("a").alias(name)), "i", "j")
    both = side("i > j", "i", "j", "lower").join(side("i < j", "j", "i", "upper"), ["i", "j"], "full_outer").fillna(0.0, ["lower", "upper"])
    return both.where(F.abs(F.col("lower") - F.col("upper")) > tol * F.greatest(F.abs("lower"), F.abs("upper")))


def census(a: DataFrame) -> DataFrame:
    """One row: what the operator holds, from one pass over its entries grouped by column, and the asymmetric pairs."""
    off, fin = F.col("i") != F.col("j"), ~(F.isnan("a") | (F.abs("a") == float("inf")))
    x = F.when(off & fin, F.col("a"))
    cols = a.groupBy("j").agg(
        F.count(F.lit(1)).alias("stored"), F.count_if(~fin).alias("nonfinite"), F.count_if(off).alias("offdiag"), F.count_if(off & (F.col("a") > 0)).alias("offdiag_pos"),
        F.max(F.when(~off, F.col("a"))).alias("diag"), F.coalesce(F.sum(F.abs(x)), F.lit(0.0)).alias("mass"), F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("pos"), F.coalesce(F.sum(x), F.lit(0.0)).alias("row"),
    )
    slack = F.coalesce("diag", F.lit(0.0)) - F.col("mass")
    small = F.lit(EXCESS_TOL) * F.coalesce("diag", F.lit(0.0))
    out = cols.agg(
        F.coalesce(F.sum("stored"), F.lit(0)).alias("stored"), F.coalesce(F.sum("nonfinite"), F.lit(0)).alias("nonfinite"), F.coalesce(F.sum("offdiag"), F.lit(0)).alias("offdiag"), F.coalesce(F.sum("offdiag_pos"), F.lit(0)).alias("offdiag_pos"),
        F.count_if(F.col("diag") > 0).alias("diag_pos"), F.count_if(~F.coalesce(F.col("diag") > 0, F.lit(False))).alias("bad_diag"), F.min(F.when(~F.coalesce(F.col("diag") > 0, F.lit(False)), F.col("j"))).alias("first_bad_diag"),
        F.coalesce(F.sum("mass"), F.lit(0.0)).alias("abs_mass"), F.coalesce(F.sum("pos"), F.lit(0.0)).alias("pos_mass"), F.count_if(slack < -small).alias("deficient_rows"), F.count_if(slack > small).alias("excess_rows"),
        F.min_by(F.when(slack < -small, F.col("j")), F.when(slack < -small, F.struct(slack.alias("s"), "j"))).alias("worst_deficient"),
    )
    worst = F.min_by(F.struct("i", "j"), F.struct(-F.abs(F.col("lower") - F.col("upper")), "i", "j"))
    pairs = symmetry(a).agg(F.count(F.lit(1)).alias("asymmetric"), worst.alias("w")).select("asymmetric", F.col("w.i").alias("asymmetric_i"), F.col("w.j").alias("asymmetric_j"))
    return out.join(pairs)  # one row each


def positive_mass_fraction(a: DataFrame) -> DataFrame:
    return census(a).select(F.when(F.col("abs_mass") > 0, F.col("pos_mass") / F.col("abs_mass")).otherwise(0.0).alias("rho"))


def require(a: DataFrame, n: int | None = None, ceiling: float = LUMP_CEILING) -> dict:
    """Raise ValueError unless A is square, finite, symmetric, of positive diagonal and of little positive mass. The census."""
    if n is not None and a.where(f"i < 0 OR j < 0 OR i >= {n} OR j >= {n}").take(1):
        raise ValueError(f"operator is not square: an entry lies outside of {n} x {n}")
    c = census(a).first().asDict()
    if c["nonfinite"]:
        raise ValueError(f"operator has {c['nonfinite']} non-finite entries")
    if c["asymmetric"]:
        i, j = c["asymmetric_i"], c["asymmetric_j"]
        raise ValueError(f"operator is not symmetric: {c['asymmetric']} pairs of entries differ, most of all ({i}, {j})")
    if c["bad_diag"]:
        hint = "; all off-diagonal entries are positive and none is on the diagonal: an adjacency matrix? use laplacian()" if not c["diag_pos"] and c["offdiag_pos"] else ""
        raise ValueError(f"operator has {c['bad_diag']} diagonal entries that are not positive, first in column {c['first_bad_diag']}{hint}")
    rho = c["pos_mass"] / c["abs_mass"] if c["abs_mass"] else 0.0
    if rho > ceiling:
        raise ValueError(f"positive off-diagonal mass is {rho:.3g} of the whole, over the ceiling {ceiling}")
    return c | {"rho": rho}


def lump(a: DataFrame) -> DataFrame:
    """Move positive off-diagonal mass to its column's diagonal: row sums stay, no positive off-diagonal entry is left."""
    extra = a.where("i <> j AND a > 0").groupBy("j").agg(F.sum("a").alias("x"))
    kept = a.where("i = j OR a < 0").join(extra, "j", "left")
    return kept.select("i", "j", (F.col("a") + F.when(F.col("i") == F.col("j"), F.coalesce("x", F.lit(0.0))).otherwise(0.0)).alias("a"))


def view(a: DataFrame, seen: dict) -> tuple[DataFrame, int]:
    """The operator to factorise and the entries lumped; the same DataFrame when there is nothing to lump."""
    return (lump(a), seen["offdiag_pos"]) if seen["offdiag_pos"] else (a, 0)


def describe(seen: dict) -> str:
    return f"{seen['stored']} entries, {seen['offdiag']} off the diagonal ({seen['offdiag_pos']} positive), {seen['excess_rows']} rows with excess, {seen['deficient_rows']} deficient"


def to_graph(a: DataFrame, reg: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v, w) of the strict triangle and excess(v, excess); excess within rounding of 0 is 0."""
    edges = a.where("i < j AND a < 0").select(F.col("i").alias("u"), F.col("j").alias("v"), (-F.col("a")).alias("w"))
    per = a.groupBy(F.col("j").alias("v")).agg(F.coalesce(F.max(F.when(F.col("i") == F.col("j"), F.col("a"))), F.lit(0.0)).alias("d"), F.coalesce(F.sum(F.when((F.col("i") != F.col("j")) & (F.col("a") < 0), -F.col("a"))), F.lit(0.0)).alias("deg"))
    raw = F.col("d") - F.col("deg")
    return edges, per.select("v", F.greatest(F.when(raw <= EXCESS_TOL * F.col("d"), 0.0).otherwise(raw), reg * F.col("d")).alias("excess"))


def is_sddm(excess: DataFrame) -> bool:
    return bool(excess.where("excess > 0").take(1))


def input_census(a: DataFrame, n: int | None = None) -> DataFrame:
    """One row of counts by which a file is read as adjacency or as operator; n: rows, else one more than the largest id."""
    off = F.col("i") != F.col("j")
    rows = a.groupBy("i").agg(F.coalesce(F.sum(F.when(~off, F.col("a"))), F.lit(0.0)).alias("d"), F.coalesce(F.sum(F.when(off, F.abs("a"))), F.lit(0.0)).alias("s"))
    slack = F.col("d") - F.col("s")
    rows = rows.agg(
        F.count_if(slack < 0).alias("deficient_rows"), F.count_if(slack > 0).alias("excess_rows"),
        F.coalesce(F.least(F.min(slack), F.lit(0.0)), F.lit(0.0)).alias("worst_deficit"), F.coalesce(F.min_by(F.when(slack < 0, F.col("i")), F.struct(slack, "i")), F.lit(-1)).alias("worst_row"),
    )
    size = F.lit(n).cast("long") if n is not None else F.coalesce(F.greatest(F.max("i"), F.max("j")) + 1, F.lit(0)).cast("long")
    counts = a.agg(
        size.alias("n"), F.count_if(off & (F.col("a") > 0)).alias("off_pos"), F.count_if(off & (F.col("a") < 0)).alias("off_neg"), F.count_if(F.col("i") > F.col("j")).alias("lower"), F.count_if(F.col("i") < F.col("j")).alias("upper"),
        F.countDistinct(F.when(~off & (F.col("a") > 0), F.col("i"))).alias("diag_pos"),
    )
    return counts.join(rows)  # one row each


KINDS = ("auto", "laplacian", "adjacency")


def resolve_kind(seen: dict, kind: str = "auto", pattern: bool = False) -> tuple[str, str]:
    """(`laplacian` or `adjacency`, why) from an input census. ValueError where only one triangle is stored, and where off-diagonal
    entries have both signs and not every row has a positive diagonal entry."""
    if kind not in KINDS:
        raise ValueError(f"input kind {kind!r} is none of {', '.join(KINDS)}")
    off = seen["lower"] + seen["upper"]
    if off and not (seen["lower"] and seen["upper"]):
        raise ValueError(f"matrix is not symmetric: all {off} off-diagonal entries are in the {'lower' if seen['lower'] else 'upper'} triangle; a file of one triangle must be declared symmetric")
    signs = f"{seen['off_pos']} positive and {seen['off_neg']} negative off-diagonal entries"
    if kind == "adjacency":
        return kind, "asked for"
    if kind == "laplacian":
        if seen["n"] and not seen["diag_pos"]:
            return kind, f"asked for; WARNING: none of {seen['n']} rows has a positive diagonal entry, as adjacency matrices have none"
        return kind, f"asked for; WARNING: {seen['off_pos']} positive off-diagonal entries become negative edge weights" if seen["off_pos"] else "asked for"
    if not seen["off_pos"]:
        return "laplacian", f"all {off} off-diagonal entries are non-positive" if off else "a diagonal operator"
    if not seen["off_neg"]:
        return "adjacency", f"a pattern of {off} entries with unit weights" if pattern else f"all {off} off-diagonal entries are positive"
    if seen["diag_pos"] == seen["n"]:
        return "laplacian", f"mixed signs ({signs}), but every row has a positive diagonal entry"
    raise ValueError(f"cannot tell an operator from an adjacency matrix: {signs}, and {seen['diag_pos']} of {seen['n']} rows have a positive diagonal entry; give the input kind")


def describe_input(kind: str, seen: dict, why: str = "") -> str:
    """One line on how an input is read."""
    if kind == "adjacency":
        return f"adjacency matrix, solving L = D - A ({why})"
    if seen["diag_pos"] < seen["n"]:
        more = f"{seen['diag_pos']} of {seen['n']} rows have a positive diagonal entry"
    elif seen["deficient_rows"]:
        more = f"{seen['deficient_rows']} of {seen['n']} rows are not diagonally dominant"
    else:
        more = f"SDDM, {seen['excess_rows']} rows have excess" if seen["excess_rows"] else "every row sums to zero"
    return f"operator, solved as given ({'; '.join(x for x in (why, more) if x)})"


def diagnose_failure(kind: str, seen: dict) -> str:
    """What about the input may explain that a solve failed; empty if nothing does."""
    found = []
    if kind == "laplacian" and seen["off_pos"]:
        found.append(f"{seen['off_pos']} off-diagonal entries are positive and give edges of negative weight")
    if kind == "laplacian" and seen["diag_pos"] < seen["n"]:
        found.append(f"{seen['diag_pos']} of {seen['n']} rows have a positive diagonal entry: is it an adjacency matrix?")
    if seen["deficient_rows"]:
        found.append(f"{seen['deficient_rows']} of {seen['n']} rows break diagonal dominance, row {seen['worst_row']} by {-seen['worst_deficit']:g}: the operator may be indefinite")
    return "; ".join(found)


def regularise(a: DataFrame, rel: float) -> DataFrame:
    """A + rel * mean|diagonal| * I."""
    mean = a.where("i = j").agg(F.avg(F.abs("a")).alias("m"))
    return a.join(mean).select("i", "j", F.when(F.col("i") == F.col("j"), F.col("a") + rel * F.col("m")).otherwise(F.col("a")).alias("a"))  # m is one row


def fp32_exact(a: DataFrame) -> DataFrame:
    return a.agg(F.coalesce(F.bool_and(F.col("a") == F.col("a").cast("float").cast("double")), F.lit(True)).alias("exact"))


def from_lower(a: DataFrame) -> DataFrame:
    """Full matrix of the lower triangle; what is stored above the diagonal is ignored."""
    low = a.where("i >= j")
    return low.unionByName(low.where("i > j").select(F.col("j").alias("i"), F.col("i").alias("j"), "a"))
