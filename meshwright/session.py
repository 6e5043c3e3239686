"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of stored input to one partition of what is grouped or joined; inputs of at most FEW such parts are left to the session's settings.
SHARE, FEW = 4 << 20, 8


def workers_see_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, whatever folder the driver was started in."""
    env = spark.sparkContext.environment
    had = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in had:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *had])


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set (tests, one machine)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="meshwright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df):
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_bytes(df) -> int:
    """Bytes of the files and local rows that df is computed from, each counted once; what tells no size counts as none."""
    leaves, sizes = df._jdf.queryExecution().analyzed().collectLeaves(), {}
    for k in range(leaves.size()):
        x = leaves.apply(k)
        kind = x.getClass().getSimpleName()
        if kind == "LogicalRelation":
            at = getattr(x.relation(), "location", None)
            sizes[at().rootPaths().mkString(",") if at else k] = int(str(x.stats().sizeInBytes()))
        elif kind in ("LocalRelation", "Range"):
            sizes[k] = int(str(x.stats().sizeInBytes()))
    return sum(sizes.values())


def shares(df) -> int:
    """Partitions for df's rows, in proportion to what it is computed from; 0 where that is little."""
    n = -(-read_bytes(df) // SHARE)
    return n if n > FEW else 0


def spread(df, *keys: str | Column):
    """df with equal keys in one partition, of sizes that do not grow with the input: the session's number of partitions, and what is
    merged of them, do. Little input stays as it is. Not before sums over few keys, whose rows are better added up where they lie."""
    n = shares(df)
    return df.repartition(n, *keys) if n else df


def met(df, other, key: str, how: str = "inner"):
    """df joined with other by key. Both are spread: of one that is not, a join takes over the number of partitions."""
    n = shares(df)
    return df.repartition(n, key).join(other.repartition(n, key), key, how) if n else df.join(other, key, how)


def among(df, key: str, chosen):
    """Rows of df whose key is one of chosen(v). Of much input by an inner join: the optimiser moves a semi join below the spreading."""
    own, n = chosen.select(F.col("v").alias(key)), shares(df)
    if not n:
        return df.join(own, key, "left_semi").select(df.columns)
    return df.repartition(n, key).join(own.repartition(n, key).distinct(), key).select(df.columns)


def dealt(df, key: str):
    """df with equal keys in one partition whatever its size, for kernels that rely on it."""
    n = shares(df)
    return df.repartition(n, F.xxhash64(key)) if n else df.repartition(F.xxhash64(key))
