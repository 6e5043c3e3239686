"""Factor tables G(col, row, val), positions perm(v, pos, round), and what is computed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.session import met, spread

DROP = 1e-4


def leading_block(g: DataFrame, m: int) -> DataFrame:
    return g.where((F.col("row") < m) & (F.col("col") < m))


def column_scale(g: DataFrame) -> DataFrame:
    """(col, scale): largest |off-diagonal| of a column, 1 where there is none."""
    return g.groupBy("col").agg(F.max(F.when(F.col("row") != F.col("col"), F.abs("val"))).alias("m")).select("col", F.when(F.col("m") > 0, F.col("m")).otherwise(1.0).alias("scale"))


def drop_small(g: DataFrame, rel: float = DROP) -> DataFrame:
    """Keep off-diagonal entries of at least rel times the column's largest; what was dropped is folded into the kept ones in
    proportion to their size, so column sums stay."""
    off, w = F.col("row") != F.col("col"), Window.partitionBy("col")
    size = F.abs("val")
    x = spread(g, "col").withColumn("top", F.max(F.when(off, size)).over(w)).withColumn("keep", ~off | (size >= F.lit(rel) * F.col("top")))
    x = x.withColumn("lost", F.sum(F.when(~F.col("keep"), F.col("val")).otherwise(0.0)).over(w)).withColumn("mass", F.sum(F.when(off & F.col("keep"), size).otherwise(0.0)).over(w))
    new = F.when(off & (F.col("mass") > 0), F.col("val") + F.col("lost") * size / F.col("mass")).otherwise(F.col("val"))
    return x.where("keep").select("col", "row", new.alias("val"))


def narrow(g: DataFrame) -> DataFrame:
    """Off-diagonal entries over their column's scale as half-precision floats (11 bits, ties to even, subnormal ones to 0); what
    rounding takes from a column goes to its diagonal, so column sums stay."""
    off, tiny = F.col("row") != F.col("col"), 2.0**-14
    x = F.col("val") / F.col("scale")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs("x"))), F.lit(-14)) - 10)
    g = spread(g, "col")
    h = g.join(column_scale(g), "col").withColumn("x", x).withColumn("h", F.when(F.col("x") == 0, 0.0).otherwise(F.rint(F.col("x") / step) * step))
    h = h.withColumn("kept", F.when(F.abs("h") < tiny, 0.0).otherwise(F.col("h") * F.col("scale")))
    lost = F.sum(F.when(off, F.col("val") - F.col("kept")).otherwise(0.0)).over(Window.partitionBy("col"))
    return h.select("col", "row", F.when(off, F.col("kept")).otherwise(F.col("val") + lost).alias("val"))


def assemble(columns: DataFrame, perm: DataFrame) -> DataFrame:
    """Factor columns of original vertices in elimination order."""
    c, r = perm.select(F.col("v").alias("col"), F.col("pos").alias("pc")), perm.select(F.col("v").alias("row"), F.col("pos").alias("pr"))
    return columns.join(c, "col").join(r, "row").select(F.col("pc").alias("col"), F.col("pr").alias("row"), "val")


def level_histogram(g: DataFrame, perm: DataFrame) -> DataFrame:
    """Rows and entries of every level, a level being the round that eliminated the column."""
    return met(g, perm.select(F.col("pos").alias("col"), F.col("round").alias("level")), "col").groupBy("level").agg(F.countDistinct("col").alias("rows"), F.count(F.lit(1)).alias("nnz"))


def ldl(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unit lower L(col, row, val) and D(v, d)."""
    g = spread(g, "col")
    d = g.where("row = col").select("col", F.col("val").alias("p"))
    return g.join(d, "col").select("col", "row", (F.col("val") / F.col("p")).alias("val")), d.select(F.col("col").alias("v"), (F.col("p") * F.col("p")).alias("d"))


def fill_ratio(g: DataFrame, nnz: int, n: int) -> float:
    return (2 * g.count() - n) / nnz


def fill_offdiagonal(g: DataFrame, nnz_off: int) -> float:
    return 2 * g.where("row <> col").count() / nnz_off


def gram(g: DataFrame) -> DataFrame:
    """G G' as (i, j, a)."""
    return g.select("col", F.col("row").alias("i"), F.col("val").alias("x")).join(g.select("col", F.col("row").alias("j"), F.col("val").alias("y")), "col").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("a"))


def quality(a: DataFrame, g: DataFrame, perm: DataFrame) -> float:
    """|A - P'GG'P| / |A| in the Frobenius norm."""
    p = a.join(perm.select(F.col("v").alias("i"), F.col("pos").alias("pi")), "i").join(perm.select(F.col("v").alias("j"), F.col("pos").alias("pj")), "j").select(F.col("pi").alias("i"), F.col("pj").alias("j"), "a")
    both = p.join(gram(g).withColumnRenamed("a", "b"), ["i", "j"], "full_outer").fillna(0.0, ["a", "b"])
    d, n = both.agg(F.sum((F.col("a") - F.col("b")) ** 2), F.sum(F.col("a") ** 2)).first()
    return (d / n) ** 0.5
