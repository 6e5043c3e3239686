"""Independent sets on an edge table, and the degrees that steer them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.operators.operator import both_ways
from meshwright.session import among, materialise, met, spread

#: Portable hash: the same value in Spark and in SQL, for ids under 2**31.
MULTIPLIER, STEP, MODULUS = 2654435761, 40503, 4294967291
NAMES = ("block_greedy", "luby", "rootset", "baumann_kyng")


def portable_hash(v: Column, seed: int) -> Column:
    return (v * F.lit(MULTIPLIER) + F.lit(seed * STEP)) % F.lit(MODULUS)


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, deg): edges counted with multiplicity (column mult, else 1); isolated vertices have 0."""
    mult = F.col("mult") if "mult" in edges.columns else F.lit(1)
    ends = edges.select(F.explode(F.array("u", "v")).alias("v"), mult.alias("m"))
    return vertices.select("v").join(ends.groupBy("v").agg(F.sum("m").cast("long").alias("deg")), "v", "left").select("v", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def quantile_cap(degs: DataFrame, q: float = 0.2) -> DataFrame:
    """One row: the degree of 0-based rank floor(q n). Degrees are counted first, so few distinct values are ordered."""
    hist = degs.groupBy("deg").agg(F.count(F.lit(1)).alias("n"))
    run = hist.withColumn("upto", F.sum("n").over(Window.orderBy("deg"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return run.where(F.col("upto") > F.floor(F.col("all") * F.lit(q))).agg(F.min("deg").alias("cap"))


def multiplier_cap(degs: DataFrame, k: float = 2.0) -> DataFrame:
    return degs.agg((F.avg("deg") * k).alias("cap"))


def under_cap(degs: DataFrame, cap: DataFrame) -> DataFrame:
    return degs.join(cap).where("deg <= cap").select("v", "deg")  # cap is one row


def neighbours_of(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    return among(both_ways(edges).select("u", "v"), "u", chosen).select("v").distinct()


def local_minima(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """ranked(v, p): vertices whose p is less than that of all their neighbours among ranked."""
    near = spread(met(both_ways(edges).select("u", "v"), ranked.select("v", F.col("p").alias("q")), "v").select("u", "q"), "u").groupBy("u").agg(F.min("q").alias("least"))
    return ranked.join(near, F.col("v") == F.col("u"), "left").where("least IS NULL OR p < least").select("v")


def lfmis(edges: DataFrame, ranked: DataFrame, rounds: int | None = None) -> DataFrame:
    """Iterated local minima of a fixed total order: the lexicographically first maximal independent set; with a cap on rounds,
    what was chosen until then."""
    left, out, k = materialise(ranked), None, 0
    while left.take(1) and (rounds is None or k < rounds):
        got = materialise(local_minima(edges, left))
        out = got if out is None else out.unionByName(got)
        left = materialise(left.join(got, "v", "left_anti").join(neighbours_of(edges, got), "v", "left_anti"))
        k += 1
    return out if out is not None else ranked.select("v").limit(0)


def by_degree(degs: DataFrame, seed: int) -> DataFrame:
    """Total order (degree, hash, id)."""
    return degs.select("v", F.struct("deg", portable_hash(F.col("v"), seed).alias("h"), F.col("v").alias("id")).alias("p"))


def luby(edges: DataFrame, degs: DataFrame, seed: int = 42, rounds: int = 16) -> DataFrame:
    return lfmis(edges, by_degree(degs, seed), rounds)


def rootset(edges: DataFrame, degs: DataFrame, seed: int = 42) -> DataFrame:
    return lfmis(edges, by_degree(degs, seed))


def greedy(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """Greedy by a user's priority ranked(v, p)."""
    return lfmis(edges, ranked.select("v", F.struct("p", "v").alias("p")))


def baumann_kyng(edges: DataFrame, degs: DataFrame, seed: int = 42, c: float = 0.3) -> DataFrame:
    """Sample vertices with p = min(1, 1 / (c mean degree)) by hash; keep the (degree, hash) minima among sampled neighbours."""
    mean = degs.agg(F.greatest(F.avg("deg"), F.lit(1e-9)).alias("d"))
    some = degs.join(mean).where(portable_hash(F.col("v"), seed) <= F.least(F.lit(1.0), 1 / (c * F.col("d"))) * MODULUS).select("v", "deg")
    return local_minima(edges, by_degree(some, seed))


def block_greedy(edges: DataFrame, degs: DataFrame, blocks: int = 16, most: int = 1 << 16) -> DataFrame:
    """Greedy by ascending id inside each block of at most `most` ids; chosen vertices that lose by (degree, id) to a chosen neighbour of
    another block drop out on one snapshot; what has become free is filled to a maximal set."""
    import pandas as pd

    n = (degs.agg(F.max("v")).first()[0] or 0) + 1
    width = min(most, -(-n // blocks))
    inside = degs.select("v").withColumn("b", F.floor(F.col("v") / width)).join(both_ways(edges).where(F.floor(F.col("u") / width) == F.floor(F.col("v") / width)).groupBy(F.col("u").alias("v")).agg(F.collect_list("v").alias("near")), "v", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        for v, near in zip(*(x for _, x in pdf.sort_values("v")[["v", "near"]].items()), strict=True):
            if near is None or taken.isdisjoint(near):
                taken.add(v)
        return pd.DataFrame({"v": sorted(taken)})

    chosen = materialise(inside.groupBy("b").applyInPandas(run, "v long").join(degs, "v"))
    rank = chosen.select("v", F.struct("deg", "v").alias("p"))
    pairs = both_ways(edges).join(rank, "v").withColumnRenamed("p", "pv").join(rank.select(F.col("v").alias("u"), F.col("p").alias("pu")), "u")
    keep = materialise(chosen.select("v").join(pairs.where("pu > pv").select(F.col("u").alias("v")).distinct(), "v", "left_anti"))
    free = degs.join(keep, "v", "left_anti").join(neighbours_of(edges, keep), "v", "left_anti").select("v", F.struct("deg", "v").alias("p"))
    return keep.unionByName(lfmis(edges, free))


def least_yield(base: float, active: int, mean_degree: float, handoff: int | None) -> float:
    """Share of the candidates that a round has to take: three times base, up to 0.15, on what is dense (mean degree of handoff or more)
    and still more than four times handoff; base elsewhere."""
    dense = handoff is not None and active > 4 * handoff and mean_degree >= handoff
    return max(base, min(0.15, 3 * base)) if dense and base > 0 else base


def too_little(chosen: int, candidates: int, active: int, least: float, handoff: int | None) -> bool:
    """Whether a round's set is to be given up: nothing chosen, or under the least yield while more than twice handoff is active."""
    if not chosen:
        return True
    return (handoff is None or active > 2 * handoff) and chosen < least * candidates


def on_all(f: Callable) -> Callable:
    """A caller's partitioner that gets all active vertices with their degrees, not only those under the cap."""
    def run(edges: DataFrame, candidates: DataFrame, seed: int) -> DataFrame:
        return f(edges, candidates, seed)

    run.capped = False
    return run


def select(name: str | Callable, edges: DataFrame, degs: DataFrame, seed: int = 42) -> DataFrame:
    """By name, or a callable (edges, candidates, seed) -> DataFrame(v)."""
    if callable(name):
        return name(edges, degs, seed)
    if name not in NAMES:
        raise ValueError(f"unknown partitioner {name!r}; valid: {', '.join(NAMES)}")
    if name == "block_greedy":
        return block_greedy(edges, degs)
    return {"luby": luby, "rootset": rootset, "baumann_kyng": baumann_kyng}[name](edges, degs, seed)


def conflicts(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends chosen; none for an independent set."""
    return among(among(edges.select("u", "v"), "u", chosen), "v", chosen)
