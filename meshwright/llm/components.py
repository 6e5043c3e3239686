"""Connected components of a table of links, without collecting it: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import cut, discard


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of comparable ids -> (node, root): root is the smallest id reachable. Only nodes with links are returned."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of a node is linked to the least of the node and its neighbours
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours are linked to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        old, edges = edges, cut(small.distinct(), "stars")
        discard(old)
        now = _mark(edges)
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now


def extend(roots: DataFrame, links: DataFrame) -> DataFrame:
    """What `components` gave for some links, with further links(a, b) of which only the components that they join are looked at."""
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    mapped = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    new = components(mapped)
    moved = new.select(F.col("node").alias("old"), F.col("root").alias("now"))
    kept = roots.join(moved, roots["root"] == moved["old"], "left").select("node", F.coalesce("now", "root").alias("root"))
    return cut(kept.unionByName(new.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")
