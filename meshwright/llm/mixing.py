"""Mixing sources to target weights by a low-discrepancy schedule (operator 4).

Golden-ratio points are mapped through the sources' cumulative shares, which gives every slot of the mix a source; slots are
ranked per source, and slot r of a source takes block r of that source's shuffled words, round and round. Only sizes are
shuffled, never texts. Everything is DataFrame work; a hot source is split into hash bins for its running sums.

Edge cases: a null text has size 0 and takes nothing; a null source is a source of its own, last in the order; repeated rows
are separate documents; an empty table gives an empty result; `mix` and `blocks` ignore further columns, `mixed_documents` keeps
them, whatever their names. Windows without a hot key: sources and runs of slots have one row each there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.common import cut, discard, spread, unused

#: Weights of the sources in code-point order, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
GOLDEN = 0.6180339887498949
BLOCK = 512
RUN = 1 << 12


def word_count(text: str = "text"):
    """Number of runs of characters other than space and 0x09-0x0D; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources(source, total) -> with weight and target. Sources over their cap are fixed at it and the rest is reshared."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source, few columns
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    ranked = cut(sources.select("source", "total", place.alias("place")).withColumn("weight", w), "sources")
    whole = ranked.agg(F.sum("total")).first()[0] or 0
    level = None
    while True:  # each round fixes at least one source more; three weights settle in a few rounds
        full = F.lit(False) if level is None else F.lit(cap) * F.col("total") <= F.lit(level) * F.col("weight")
        fixed, rest = ranked.agg(F.sum(F.when(full, F.lit(cap) * F.col("total"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest:
            break
        now = (share * whole - (fixed or 0)) / rest
        if level is not None and now <= level:
            break
        level = now
    aim = F.least((F.lit(cap) * F.col("total")).cast("double"), F.lit(level) * F.col("weight")) if level is not None else F.lit(cap) * F.col("total").cast("double")
    return ranked.withColumn("target", aim.cast("double"))


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """plan(source, total, place, target) -> slots(slot, place, rank).

    Slot i's point frac(i * golden) falls into one source's share. Ranks are counted in runs of slots, so no source's slots
    meet in one task. A source stops at its quota of blocks; what discrepancy leaves it short of is added at the end.
    """
    spark = plan.sparkSession
    quotas = plan.select("place", F.ceil(F.col("target") / block).cast("long").alias("quota")).where("quota > 0")
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    bounds = cut(quotas.withColumn("lo", F.coalesce(F.sum("quota").over(before), F.lit(0))), "bounds")
    n = bounds.agg(F.sum("quota")).first()[0] or 0
    point = F.floor((F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))) * F.lit(float(n))).cast("long")
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("point", point)
    # interval lookup as an equi-join on coarse cells of the cumulative shares
    cell = max(1, n // 4096)
    cells = bounds.select("place", "quota", "lo", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("lo") + F.col("quota") - 1) / cell))).alias("cell"))
    hit = slots.withColumn("cell", F.floor(F.col("point") / cell)).join(cells, "cell").where("point >= lo AND point < lo + quota")
    runs = hit.select("slot", "place", "quota", F.floor(F.col("slot") / RUN).alias("run"))
    counts = runs.groupBy("place", "run").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("place", "run").orderBy("slot")
    ranked = runs.withColumn("at", F.row_number().over(inside) - 1).join(counts, ["place", "run"]).select("slot", "place", "quota", (F.col("start") + F.col("at")).alias("rank"))
    had = hit.groupBy("place").agg(F.count(F.lit(1)).alias("had"))
    short = bounds.join(had, "place", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < quota")
    extra = short.select((F.lit(n) + F.col("place")).cast("long").alias("slot"), "place", F.explode(F.sequence("had", F.col("quota") - 1)).alias("rank"))
    return ranked.where("rank < quota").select("slot", "place", "rank").unionByName(extra)


def blocks(docs: DataFrame, seed: int = 0, block: int = BLOCK, bins: int = 4096, share: float = SHARE, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, source) -> (rows, pieces). rows(row, doc_id, source, size, source_size, target, ...) are the documents;
    pieces(row, slot, lap, a, b) the mix: slot by slot, words a to b of a document, the lap-th time round its source."""
    sized = docs.select("doc_id", "source", word_count().alias("size")).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sized = cut(sized, "sizes")
    plan = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("total")), share, cap), "targets")
    slots = schedule(plan, block)
    placed = spread(sized, ["source"], ["_h", "doc_id"], bins, "size", "begin")
    named = plan.select(F.col("source").alias("_s"), "place", F.col("total").alias("source_size"), "target")
    rows = placed.join(named, placed["source"].eqNullSafe(named["_s"])).select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "size", "source_size", "target", "place", "begin")
    rows = cut(rows, "placed")
    discard(sized)
    # a source's stream repeats: on lap l a document covers words l * source_size + begin and on, up to the target
    goal = F.floor("target").cast("long")
    laps = rows.where("size > 0").select("row", "place", "size", goal.alias("goal"), F.posexplode(F.array(*[F.lit(k).cast("long") * F.col("source_size") + F.col("begin") for k in range(cap)])).alias("lap", "at")).where("at < goal")
    laps = laps.withColumn("stop", F.least(F.col("at") + F.col("size"), F.col("goal")))
    cells = laps.select("row", "place", "lap", "at", "stop", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("stop") - 1) / block))).alias("rank"))
    word = lambda x: (x - F.col("at")).cast("long")
    pieces = cells.join(slots, ["place", "rank"]).select("row", "slot", "lap", word(F.greatest("at", F.col("rank") * block)).alias("a"), word(F.least("stop", (F.col("rank") + 1) * block)).alias("b"))
    return rows, pieces


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, taken, first_slot, again_slot: the slots of the mix in
    which the document begins on its source's first and second lap, if it does."""
    rows, pieces = blocks(docs, **options)
    start = lambda lap, name: F.min(F.when(F.col("lap") == lap, F.col("slot"))).alias(name)
    got = pieces.groupBy("row").agg(F.sum(F.col("b") - F.col("a")).cast("long").alias("taken"), start(0, "first_slot"), start(1, "again_slot"))
    return rows.join(got, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "again_slot")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in its order: each whole document as often as its taken words cover it, rounded, at the slots in
    which it begins. Rows are ranged and sorted by slot, so files read one after the other follow the schedule."""
    names = docs.columns
    own, copies, slots = unused(names, "own", "copies", "slots")
    plan = mix(docs, **options).groupBy(F.col("doc_id").alias(own)).agg(F.sum("taken").alias("t"), F.sum("size").alias("z"), F.min("first_slot").alias("first"), F.min("again_slot").alias("again"))
    often = F.when(F.col("z") > 0, F.round(F.col("t") / F.col("z"))).otherwise(0).cast("int")
    plan = plan.select(own, often.alias(copies), F.array("first", F.coalesce("again", "first")).alias(slots)).where(F.col(copies) > 0)
    every = docs.join(plan, docs["doc_id"].eqNullSafe(plan[own])).select(*[docs[c] for c in names], F.explode(F.slice(slots, 1, F.col(copies))).alias(own))
    return every.repartitionByRange(own).sortWithinPartitions(own).select(*names)
