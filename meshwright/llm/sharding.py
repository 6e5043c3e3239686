"""Sharding by a hierarchical weighted hash tree (operator 5), law `key`.

The tree has regions, racks and shards. A document descends it: at each level every child draws -ln(u) / weight, u a hash of
(doc_id, child), and the least draw wins, so a child gets documents in proportion to its weight and a change of weights
moves documents only into or out of the subtrees whose weights change; inside of any other, the draws are what they were. A new shard joins as a region and rack of its own, so what moves, moves into
the new shard only. Pure DataFrame expressions; slots are ranked in hash bins, so no shard is sorted in one task.

Edge cases: a null text has size 1 and crc32 0; a null doc_id is hashed as the empty string; repeated rows share a shard and
have slots of their own; an empty table gives an empty result; extra columns are ignored; of long texts only size and crc32 are
read; a shard of weight 0 gets nothing, and a tree without any weight gives null shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import spread

#: region -> rack -> shard -> weight; inner nodes weigh the sum of their shards.
TREE = {0: {0: {0: 1, 1: 1}, 1: {2: 1, 3: 1}}, 1: {0: {4: 1, 5: 1}, 1: {6: 1, 7: 1}}}
Tree = dict[int, dict[int, dict[int, float]]]


def grown(tree: Tree, shard: int = 8, weight: float = 1) -> Tree:
    """With one more shard, which is a region and a rack of its own."""
    return tree | {max(tree) + 1: {0: {shard: weight}}}


def _draw(node: str, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{node}"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)
    return -F.log(u) / F.lit(float(weight))


def _pick(options: list[tuple[str, float, Column]]) -> Column:
    """The value of the option with the least draw; ties go to the first. Options of no weight are not drawn."""
    options = [x for x in options if x[1] > 0]
    if not options:
        return F.lit(None).cast("int")
    if len(options) == 1:
        return options[0][2]
    return F.array_min(F.array(*[F.struct(_draw(n, w).alias("d"), F.lit(k).alias("k"), v.alias("v")) for k, (n, w, v) in enumerate(options)]))["v"]


def shard_of(tree: Tree = TREE) -> Column:
    """The shard that a doc_id descends to."""
    tops = []
    for region, racks in tree.items():
        inner = [(f"g{region}/r{rack}", sum(shards.values()), _pick([(f"s{s}", w, F.lit(s)) for s, w in shards.items()])) for rack, shards in racks.items()]
        tops.append((f"g{region}", sum(w for _, w, _ in inner), _pick(inner)))
    return _pick(tops).cast("int")


def shard(docs: DataFrame, tree: Tree = TREE, bins: int = 4096) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(tree).alias("shard"), shard_of(grown(tree)).alias("grown_shard"), F.md5(F.concat(F.lit("slot:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_h"),
    )
    out = spread(rows.withColumn("_one", F.lit(1)), ["shard"], ["_h", "doc_id", "text_crc32", "size"], bins, "_one", "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
