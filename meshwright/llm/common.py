"""Shared pieces of the training-data operators: tables, cut points, distributed ranks and byte blocks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.session import workers_see_package

#: Rows of an Arrow batch; with texts of up to a few hundred KB this bounds a worker's memory.
ARROW_ROWS = 512
#: Bytes of text that numpy kernels look at together.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Small Arrow batches: the texts of one batch must fit in a worker's memory."""
    workers_see_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set (tests, one machine)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="meshwright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


#: Where `cut` wrote what it returned.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete what `cut` wrote for tables that nothing reads any more: all that was made of them has been written itself."""
    for df in tables:
        if (path := _WRITTEN.pop(df, None)) is not None:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to; else they stay until the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slim(spark: SparkSession) -> None:
    """Let executors collect their garbage and return the heap that it took; else a heap that has once been full stays so, and its
    Python workers' memory comes on top. One short task for each core; an executor that gets none only keeps what it has."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def unused(names: list[str], *stems: str) -> list[str]:
    """Column names like the stems that are not among the given ones, whatever their case."""
    taken, out = {x.lower() for x in names}, []
    for stem in stems:
        while stem in taken:
            stem += "_"
        taken.add(stem)
        out.append(stem)
    return out


def together(df: DataFrame, *cols: str) -> DataFrame:
    """Rows of equal cols into one partition, for kernels that rely on it. A plain repartition by the columns of a join before it
    is optimised away, and the join's partitions may then be split at run time where they are skewed; by a hash of them it is not."""
    return df.repartition(F.xxhash64(*cols))


def spread(df: DataFrame, by: list[str], order: list[str], bins: int, weight: str, before: str, place: str | None = None) -> DataFrame:
    """Running sum of weight (and rank) inside each group, without one task per group.

    Rows are dealt to bins by the leading hex digits of order[0] (a hash in hex), so that a hot group is split evenly; bins are
    summed, their small totals are accumulated, and only the rows of one bin are sorted together. before: sum of the rows
    in front; place: how many rows are in front.
    """
    keyed = df.withColumn("_bin", F.conv(F.substring(order[0], 1, 6), 16, 10).cast("int") % F.lit(bins))
    sums = keyed.groupBy(*by, "_bin").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_bin", F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_w0"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy(*by, "_bin").orderBy(*order)
    rows = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.withColumns({"_w1": F.coalesce(F.sum(weight).over(rows), F.lit(0)), "_n1": F.row_number().over(inside) - 1})
    same = [out[c].eqNullSafe(sums[c]) for c in by] + [out["_bin"] == sums["_bin"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = out.join(sums, cond, "left").select(*[out[c] for c in df.columns], (F.col("_w0") + F.col("_w1")).cast("long").alias(before), (F.col("_n0") + F.col("_n1")).cast("long").alias(place or "_place"))
    return joined if place else joined.drop("_place")


#: Tables that operators keep in a worker from task to task; the next other operator's task lets go of them.
HELD: list[dict] = []


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and what one keeps counts for its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def utf8_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, held: dict | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to about limit bytes of text: (rows, offsets, bytes). Null texts are empty. held: the tables of HELD that the
    operator uses; all others are let go of."""
    for tables in HELD:
        if tables is not held:
            tables.clear()
    yield from _blocks(batches, column, limit)
    give_back()


def _blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        kind = texts.type
        if pa.types.is_string(kind) or pa.types.is_large_string(kind):
            texts = pc.fill_null(texts, "")
        texts = texts.cast(pa.large_binary())
        texts = pc.fill_null(texts, b"")
        _, offs, data = texts.buffers()
        ends = np.frombuffer(offs, "<i8")[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            to = min(to, len(texts))
            yield batch.slice(at, to - at), (ends[at : to + 1] - ends[at]).astype(np.int64), whole[ends[at] : ends[to]]
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (all uint64, wrapping)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}
HELD.append(_powers)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(data: np.ndarray, ends: np.ndarray, inside: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Words of a block: starts, stops and 64-bit hashes, and for each of `prefixes` hashes of so many leading bytes, up to the end
    of the character. inside[byte]: whether a byte belongs to words; A-Z count as a-z; no word crosses the end of a text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * (1 + len(prefixes))
    is_in = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    start = is_in.copy()
    start[1:] &= ~is_in[:-1] | edge[1:n]
    stop = is_in.copy()
    stop[:-1] &= ~is_in[1:] | edge[1:n]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _power_table(n + 1)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64) + np.uint64(1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(low * up[:n], out=total[1:])
    hashed = lambda to: mix64((total[to] - total[starts]) * down[starts] + (to - starts).astype(np.uint64))
    return starts, stops, hashed(stops), *[mix64(hashed(prefix_ends(data, starts, stops, k)) + np.uint64(k)) for k in prefixes]


def prefix_ends(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, size: int) -> np.ndarray:
    """Where the first `size` bytes of each word end, with the rest of a character that begins there."""
    to = np.minimum(starts + size, stops)
    for _ in range(3):
        to = to + ((to < stops) & (data[np.minimum(to, len(data) - 1)] & 0xC0 == 0x80))
    return to
