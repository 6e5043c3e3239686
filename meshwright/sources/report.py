"""Result rows of solves and benchmarks: lines of CSV or JSON, appended to a folder; and which of several runs to report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Add rows (dicts of the same keys) as .csv with a header, or as .json."""
    df = spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))
    (df.write.mode("append").option("header", "true").csv if path.endswith(".csv") else df.write.mode("append").json)(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path) if path.endswith(".csv") else spark.read.json(path)


def median_run(rows: list[dict], by: str = "seconds") -> dict:
    """The run of median time, the upper one of two."""
    return sorted(rows, key=lambda r: r[by])[len(rows) // 2]
