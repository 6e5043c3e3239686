"""Weighted graphs built from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.session import met, spread

#: Parts and suppliers share one id space: part ids are moved up by this.
PART_OFFSET = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def undirected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Counted pairs as edges u < v; pairs of a vertex with itself drop out. Few of them repeat, so they are spread before they are counted."""
    ends = pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v"))
    return spread(ends, "u", "v").groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("w"))


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cn, sn) of every lineitem: the customer's and the supplier's nation. Nations take the place of keys before lineitems meet their orders."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("cn"))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("sn"))
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "cn")
    sold = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "sn")
    return met(sold, bought, "l_orderkey").select("cn", "sn")


def nation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cn, sn, w): lineitems of every pair of nations, a row for each pair; all that edges, excess and balance are computed from."""
    return nation_pairs(spark, sf_dir).groupBy("cn", "sn").agg(F.count(F.lit(1)).cast("double").alias("w"))


def nation_edges(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    pairs = nation_counts(spark, sf_dir) if counts is None else counts
    return pairs.where("cn <> sn").groupBy(F.least("cn", "sn").cast("long").alias("u"), F.greatest("cn", "sn").cast("long").alias("v")).agg(F.sum("w").alias("w"))


def nation_excess(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    """Domestic lineitems of each nation, as its excess."""
    own = (nation_counts(spark, sf_dir) if counts is None else counts).where("cn = sn").select("cn", F.col("w").alias("e"))
    return nation_vertices(spark, sf_dir).join(own, F.col("v") == F.col("cn"), "left").select("v", F.coalesce("e", F.lit(0.0)).alias("excess"))


def nation_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("v"))


def supplier_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") + PART_OFFSET).alias("p"))
    return undirected(line, "l_suppkey", "p")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed (i, j, a): consecutive users in the event stream, with how often."""
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", F.lead("user_id").over(order).alias("next"))
    return e.where("next IS NOT NULL").groupBy(F.col("user_id").alias("i"), F.col("next").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("a"))
