"""Eliminating an independent set: factor columns, excess, and exact or sampled Schur complements.

State of a factorisation: edges(u, v, w, mult) of the active vertices and active(v, excess).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions import trees
from meshwright.operators.operator import both_ways
from meshwright.session import among, dealt, shares, spread


def stars(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(v, u, w): neighbours of each chosen vertex, parallel edges summed."""
    return among(both_ways(edges).select(F.col("u").alias("v"), F.col("v").alias("u"), "w"), "v", chosen).groupBy("v", "u").agg(F.sum("w").alias("w"))


def totals(star: DataFrame, chosen: DataFrame) -> DataFrame:
    """(v, total, e): weighted degree with excess, 1 where it is not positive; chosen(v, excess)."""
    deg = star.groupBy("v").agg(F.sum("w").alias("s"))
    total = F.coalesce("s", F.lit(0.0)) + F.col("excess")
    return chosen.join(deg, "v", "left").select("v", F.when(total > 0, total).otherwise(1.0).alias("total"), F.col("excess").alias("e"))


def factor_columns(star: DataFrame, total: DataFrame) -> DataFrame:
    """(col, row, val): sqrt(total) on the diagonal, -w / sqrt(total) below it."""
    below = star.join(total, "v").select(F.col("v").alias("col"), F.col("u").alias("row"), (-F.col("w") / F.sqrt("total")).alias("val"))
    return total.select(F.col("v").alias("col"), F.col("v").alias("row"), F.sqrt("total").alias("val")).unionByName(below)


def excess_change(star: DataFrame, total: DataFrame) -> DataFrame:
    """(v, change): excess that eliminated vertices pass on to their neighbours."""
    return star.join(total.where("e > 0"), "v").groupBy(F.col("u").alias("v")).agg(F.sum(F.col("w") * F.col("e") / F.col("total")).alias("change"))


#: Ids of stars that lie side by side when their cliques are added up: neighbours in id tend to share leaves.
NEAR = 8192


def exact_clique(star: DataFrame, total: DataFrame) -> DataFrame:
    """(u, v, w) of every pair of a star's leaves, w1 w2 / total: the exact Schur complement. For stars of bounded degree. A star is one
    row until its pairs are made; of much input, stars of near ids lie together and equal pairs are added up before they travel."""
    rows = star.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("u", "w"))).alias("leaves")).join(total.select("v", "total"), "v")
    n = shares(rows)
    if n:
        rows = rows.withColumn("near", F.floor(F.col("v") / NEAR)).repartition(n, "near")
    first = rows.select(*(["near"] if n else []), "total", "leaves", F.posexplode("leaves").alias("k", "x"))
    pairs = first.select(*(["near"] if n else []), "total", "x", F.explode(F.slice("leaves", F.col("k") + 2, F.size("leaves"))).alias("y"))
    w = F.col("x.w") * F.col("y.w") / F.col("total")
    if not n:
        return pairs.select(F.col("x.u").alias("u"), F.col("y.u").alias("v"), w.alias("w"))
    return pairs.select("near", F.col("x.u").alias("u"), F.col("y.u").alias("v"), w.alias("w")).groupBy("near", "u", "v").agg(F.sum("w").alias("w")).select("u", "v", "w")


def tree_clique(star: DataFrame, total: DataFrame, seed: int = 42, sampler: Callable | None = None) -> DataFrame:
    """(u, v, w): sampled clique of every star. Stars lie together and whole in sorted partitions and are drawn many at a time; a
    caller's sampler(w, u, total, draws) is asked star by star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def give(cols: list[np.ndarray]) -> pa.RecordBatch:
            got = trees.sampled(*cols, seed) if sampler is None else trees.by_rule(sampler, *cols, seed)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(got, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["u", "v", "w"])

        for batch in batches:
            held.append([np.asarray(batch.column(c)) for c in ("v", "u", "w", "total")])
            v = held[-1][0]
            end = int(np.searchsorted(v, v[-1])) if len(v) else 0
            if end:  # the last star may go on in the next batch
                yield give([np.concatenate([*[h[k] for h in held[:-1]], held[-1][k][:end]]) for k in range(4)])
                held = [[c[end:] for c in held[-1]]]
        if held:
            yield give([np.concatenate([h[k] for h in held]) for k in range(4)])

    rows = star.join(total.select("v", "total"), "v").select("v", "u", "w", "total")
    return dealt(rows, "v").sortWithinPartitions("v").mapInArrow(run, "u long, v long, w double")


def coalesce_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges become one; mult keeps how many there were."""
    mult = F.col("mult") if "mult" in edges.columns else F.lit(1)
    return spread(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w", mult.alias("mult")), "u", "v").groupBy("u", "v").agg(F.sum("w").alias("w"), F.sum("mult").cast("long").alias("mult"))


def duplicate_ratio(edges: DataFrame) -> DataFrame:
    """One row: edges counted with multiplicity over distinct ones, 1 for none."""
    mult = F.col("mult") if "mult" in edges.columns else F.lit(1)
    pairs = spread(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), mult.alias("m")), "u", "v").groupBy("u", "v").agg(F.sum("m").alias("m"))
    return pairs.agg(F.coalesce(F.sum("m") / F.count(F.lit(1)), F.lit(1.0)).alias("ratio"))


def eliminate(edges: DataFrame, active: DataFrame, chosen: DataFrame, sampler: str | Callable = "tree", exact_below: int = 0, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: (edges, active, factor columns) after taking out the chosen vertices. Stars of at most exact_below leaves
    get their exact clique."""
    picked = active.join(chosen.select("v"), "v", "left_semi")
    star = stars(edges, picked)
    total = totals(star, picked)
    if sampler == "exact":
        new = exact_clique(star, total)
    else:
        size = star.withColumn("d", F.count(F.lit(1)).over(Window.partitionBy("v")))
        rule = None if sampler == "tree" else sampler
        new = tree_clique(size.where(F.col("d") > exact_below).drop("d"), total, seed, rule)
        if exact_below:
            new = new.unionByName(exact_clique(size.where(F.col("d") <= exact_below).drop("d"), total))
    left = edges.join(picked.select(F.col("v").alias("u")), "u", "left_anti").join(picked.select("v"), "v", "left_anti")
    mult = left if "mult" in left.columns else left.withColumn("mult", F.lit(1).cast("long"))
    rest = active.join(picked.select("v"), "v", "left_anti").join(excess_change(star, total), "v", "left").select("v", (F.col("excess") + F.coalesce("change", F.lit(0.0))).alias("excess"))
    edges = coalesce_edges(mult.select("u", "v", "w", "mult").unionByName(new.withColumn("mult", F.lit(1).cast("long"))))
    return edges, rest, factor_columns(star, total)
