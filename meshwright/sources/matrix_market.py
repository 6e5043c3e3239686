"""MatrixMarket files: coordinate matrices and dense vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Words of the header line, and the numbered lines of the body (size line first)."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("k"))
    head = text.orderBy("k").limit(1).first()
    if head is None or not head["value"].startswith("%%MatrixMarket"):
        raise ValueError(f"{path}: no MatrixMarket header")
    return head["value"].lower().split(), text.where(~F.col("value").startswith("%") & (F.trim("value") != "")).select("value", "k")


def header(spark: SparkSession, path: str) -> dict:
    words, body = _lines(spark, path)
    size = [int(x) for x in body.orderBy("k").limit(1).first()["value"].split()]
    return {"format": words[2], "field": words[3], "symmetry": words[4], "n": size[0], "m": size[1], "nnz": size[2] if len(size) > 2 else size[0] * size[1]}


def _stored(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    info = header(spark, path)
    if info["format"] != "coordinate":
        raise ValueError(f"{path}: not a coordinate matrix")
    _, body = _lines(spark, path)
    first = body.agg(F.min("k")).first()[0]
    p = F.split(F.trim("value"), r"\s+")
    value = F.lit(1.0) if info["field"] == "pattern" else p[2].cast("double")
    return info, body.where(F.col("k") > first).select((p[0].cast("long") - 1).alias("i"), (p[1].cast("long") - 1).alias("j"), value.alias("a"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Both triangles of a symmetric file; duplicates are summed."""
    info, e = _stored(spark, path)
    if info["symmetry"] == "symmetric":
        e = e.unionByName(e.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "a"))
    return e.groupBy("i", "j").agg(F.sum("a").alias("a"))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """As weights: no diagonal, absolute value of every entry, pattern entries 1."""
    info, e = _stored(spark, path)
    e = e.where("i <> j").withColumn("a", F.abs("a"))
    if info["symmetry"] == "symmetric":
        e = e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "a"))
    return e.groupBy("i", "j").agg(F.sum("a").alias("a"))


def read_operator(spark: SparkSession, path: str) -> DataFrame:
    if header(spark, path)["field"] == "pattern":
        raise ValueError(f"{path}: a pattern has no values to be an operator")
    return read_matrix(spark, path)


def read_vector(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Dense array file as (v, x), in file order."""
    info = header(spark, path)
    if n is not None and info["n"] != n:
        raise ValueError(f"right-hand side has {info['n']} rows, the matrix {n}")
    _, body = _lines(spark, path)
    # ranks from counts of partitions: k holds a partition's number above bit 33 and the line's below, comments are left out
    part = F.shiftrightunsigned("k", 33)
    counts = body.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row a partition
    ranked = body.withColumn("p", part).withColumn("at", F.row_number().over(Window.partitionBy("p").orderBy("k"))).join(before, "p")
    return ranked.select((F.col("start") + F.col("at") - 2).alias("v"), F.trim("value").cast("double").alias("x")).where("v >= 0")


def write_vector(x: DataFrame, path: str) -> None:
    """Array file (a folder of parts; one part, as the format is one stream)."""
    n = x.count()
    head = x.sparkSession.createDataFrame([(-2, "%%MatrixMarket matrix array real general"), (-1, f"{n} 1")], "v long, s string")
    head.unionByName(x.select("v", F.col("x").cast("string").alias("s"))).coalesce(1).sortWithinPartitions("v").select("s").write.mode("overwrite").text(path)


def write_matrix(a: DataFrame, n: int, path: str) -> None:
    head = a.sparkSession.createDataFrame([(-2, -2, "%%MatrixMarket matrix coordinate real general"), (-1, -1, f"{n} {n} {a.count()}")], "j long, i long, s string")
    rows = a.select("j", "i", F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("a").cast("string")).alias("s"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("j", "i").select("s").write.mode("overwrite").text(path)
