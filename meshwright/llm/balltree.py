"""Exact top-k inner products by ball-tree branch and bound per shard (operator 8).

The top of one ball tree, built on a bounded sample, deals all candidates to its leaves; a leaf of too many rows has several shards,
by hash. Of every leaf the centre (of the sample) and the exact radius over all its rows are known. A query first visits a shard of
its own leaf; the k-th score found there travels on, and the query is sent only to shards of leaves whose ball can offer as much: a
ball with centre c and radius r offers at most q.c + |q| r. Each shard's task builds the lower part of the tree and takes blocks of
queries down it, nodes of larger upper bound first, leaving a subtree when no query of the block can reach its k-th score.
Scores are exact integers; where they could exceed 2**53, they are computed with whole numbers of any size, and those beyond a
long are its ends.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; shorter vectors count as padded
with zeros; rows with a query's own id are its own and no candidates of it; equal scores go to the smaller id; fewer than k
candidates give fewer rows; equal vectors share a leaf, whose shards divide them; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.common import arrow_batches, cut, mix64

LEAF, SHARD_ROWS, BLOCK_ROWS = 64, 8192, 512
#: Rows that the top of the tree is built on, and leaves that it has at most.
SAMPLE, LEAVES = 20_000, 1024
NONE, EXACT = -(2.0**62), 2.0**53


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray | None
    left: "Node | None" = None
    right: "Node | None" = None


def build(vectors: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Node:
    """Split at the median of the projection on the line between two far points, until leaf rows are left."""
    own = vectors[rows]
    centre = own.mean(0)
    far = ((own - centre) ** 2).sum(1)
    radius = float(np.sqrt(far.max()))
    if len(rows) <= leaf or radius == 0:
        return Node(centre, radius, rows)
    a = own[far.argmax()]
    b = own[((own - a) ** 2).sum(1).argmax()]
    order = np.argsort(own @ (b - a), kind="stable")
    half = len(rows) // 2
    return Node(centre, radius, None, build(vectors, rows[order[:half]], leaf), build(vectors, rows[order[half:]], leaf))


def search(root: Node, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best k of this tree for each query: scores and ids (score NONE where there are fewer), and the leaf scores computed.
    kth holds scores already reached elsewhere: what lies below them is not looked for."""
    n = len(queries)
    best, who = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
    bound, length, looked = kth.astype(float).copy(), np.sqrt((queries**2).sum(1)), 0
    stack = [(root, np.arange(n))]
    while stack:
        node, live = stack.pop()
        top = queries[live] @ node.centre + length[live] * node.radius
        live = live[top * (1 + 1e-12 * np.sign(top)) + 1e-6 >= bound[live]]
        if not len(live):
            continue
        if node.rows is None:
            nearer = [float((queries[live] @ c.centre + length[live] * c.radius).mean()) for c in (node.left, node.right)]
            pair = [(node.left, live), (node.right, live)]
            stack += pair if nearer[1] >= nearer[0] else pair[::-1]
            continue
        scores = queries[live] @ vectors[node.rows].T
        looked += scores.size
        names = np.broadcast_to(ids[node.rows], scores.shape)
        scores = np.where(names == own[live][:, None], NONE, scores)
        scores, names = np.concatenate([best[live], scores], 1), np.concatenate([who[live], names], 1)
        order = np.lexsort((names, -scores), axis=-1)[:, :k]
        best[live], who[live] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
        bound[live] = np.maximum(bound[live], best[live][:, -1])
    return best, who, looked


@dataclass
class Top:
    """The top of the tree: planes[k] . x > cuts[k] goes right; children of a node, or -1 - leaf; centres of the leaves."""

    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    centres: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, leaves: int) -> "Top":
        planes, cuts, children, centres = [], [], [], []

        def grow(rows: np.ndarray, leaves: int) -> int:
            own = sample[rows]
            centre = own.mean(0) if len(rows) else np.zeros(sample.shape[1])
            far = ((own - centre) ** 2).sum(1) if len(rows) else np.zeros(1)
            if leaves < 2 or len(rows) < 2 or not far.max():
                centres.append(centre)
                return -len(centres)
            a = own[far.argmax()]
            plane = own[((own - a) ** 2).sum(1).argmax()] - a
            at = own @ plane
            cut = float(np.median(at))
            right = at > cut
            if not right.any():  # half of the rows or more lie at the largest value
                cut = float(at[at < cut].max())
                right = at > cut
            k = len(planes)
            planes.append(plane)
            cuts.append(cut)
            children.append([0, 0])
            children[k] = [grow(rows[~right], leaves // 2), grow(rows[right], leaves - leaves // 2)]
            return k

        width = sample.shape[1]
        grow(np.arange(len(sample)), leaves)
        return cls(np.array(planes).reshape(-1, width), np.array(cuts), np.array(children, int).reshape(-1, 2), np.array(centres))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), 0 if len(self.planes) else -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.cuts[node]
            at[inner] = self.children[node, right.astype(int)]
        return -1 - at


def _shard(ids: np.ndarray, leaf: np.ndarray, parts: int) -> np.ndarray:
    return (leaf * parts + (mix64(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)).astype(np.int32)


def _placed(top: Top, parts: int):
    """Rows (vec_id, vec) -> with shard, leaf and distance to the leaf's centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = np.asarray(batch.column("vec_id")), _wide(_matrix(batch.column("vec")), top.centres.shape[1])
            inside = x[:, : top.centres.shape[1]]
            leaf = top.leaf(inside)
            far = np.sqrt(((inside - top.centres[leaf]) ** 2).sum(1) + (x[:, top.centres.shape[1] :] ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(_shard(ids, leaf, parts)), pa.array(leaf.astype(np.int32)), pa.array(far), pa.array(ids), batch.column("vec")], ["shard", "leaf", "far", "vec_id", "vec"])

    return run


def _sent(top: Top, radius: np.ndarray, parts: int):
    """Queries (vec_id, vec, kth, home) -> one row for each other shard whose leaf's ball can offer as much as kth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _wide(_matrix(batch.column("vec")), top.centres.shape[1])
            best = x[:, : top.centres.shape[1]] @ top.centres.T + np.sqrt((x**2).sum(1))[:, None] * radius
            good = (best * (1 + 1e-12 * np.sign(best)) + 1e-6 >= np.asarray(batch.column("kth"))[:, None]) & (radius >= 0)
            q, leaf = np.nonzero(good)
            q, shard = np.repeat(q, parts), (leaf[:, None] * parts + np.arange(parts)).ravel()
            away = shard != np.asarray(batch.column("home"))[q]
            rows = batch.take(pa.array(q[away]))
            yield pa.RecordBatch.from_arrays([pa.array(shard[away].astype(np.int32)), pa.array(np.ones(away.sum(), np.int32)), rows.column("vec_id"), rows.column("vec"), rows.column("kth")], ["shard", "kind", "vec_id", "vec", "kth"])

    return run


def exact_best(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of the best k, with whole numbers of any size; scores beyond a long are its ends."""
    whole = lambda m: np.array([[int(z) for z in row] for row in m], object).reshape(m.shape)
    out, v = [], whole(vectors)
    for q, me in zip(whole(queries), own.tolist(), strict=True):
        found = sorted((-max(-(2**63), min(2**63 - 1, int(s))), i) for s, i in zip(v @ q, ids.tolist(), strict=True) if i != me)[:k]
        out += [(me, i, -s) for s, i in found]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    width = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(width) and (width == width[0]).all():
        return flat.reshape(len(width), width[0])
    out = np.zeros((len(width), int(width.max(initial=0))))
    at = np.concatenate([[0], np.cumsum(width)])
    for k in range(len(width)):
        out[k, : width[k]] = flat[at[k] : at[k + 1]]
    return out


def _wide(a: np.ndarray, n: int) -> np.ndarray:
    return a if a.shape[1] >= n else np.pad(a, ((0, 0), (0, n - a.shape[1])))


def _searcher(k: int):
    """Rows come sorted by shard, candidates (kind 0) before queries (kind 1)."""
    kinds = [pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, tree = None, [], None
        for batch in batches:
            home, kind = (np.asarray(batch.column(c)) for c in ("shard", "kind"))
            edges = np.flatnonzero((np.diff(home) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                ids, vectors = np.asarray(batch.column("vec_id"))[a:b], _matrix(batch.column("vec").slice(a, b - a))
                if home[a] != shard:
                    shard, parts, tree = home[a], [], None
                if kind[a] == 0:
                    parts.append((ids, vectors))
                    continue
                if not parts:
                    continue
                if tree is None:
                    n = max(v.shape[1] for _, v in parts)
                    names, whole = np.concatenate([i for i, _ in parts]), np.concatenate([_wide(v, n) for _, v in parts])
                    tree = build(whole, np.arange(len(whole)))
                n = max(vectors.shape[1], whole.shape[1])
                if n > whole.shape[1]:
                    whole = _wide(whole, n)
                    tree = build(whole, np.arange(len(whole)))
                kth = np.asarray(batch.column("kth"))[a:b]
                if np.sqrt((whole**2).sum(1).max() * (vectors**2).sum(1).max()) >= EXACT:
                    got = exact_best(whole, names, _wide(vectors, n), ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*got, strict=True) if got else ((), (), ()))], ["query_id", "vec_id", "score"])
                    continue
                for at in range(0, b - a, BLOCK_ROWS):
                    to = at + BLOCK_ROWS
                    best, who, _ = search(tree, whole, names, _wide(vectors[at:to], n), ids[at:to], kth[at:to], k)
                    q, p = np.nonzero(best > NONE)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids[at:to][q], who[q, p], best[q, p].astype(np.int64)), kinds, strict=True)], ["query_id", "vec_id", "score"])

    return run


def topk(vectors: DataFrame, is_query, k: int = 5, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE, leaves: int = LEAVES) -> DataFrame:
    """vectors(vec_id, vec array<double> of integers) -> query_id, rank, vec_id, score; is_query: a condition on the rows."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    vectors = cut(vectors.select("vec_id", "vec", F.coalesce(is_query if not isinstance(is_query, str) else F.expr(is_query), F.lit(False)).alias("asked")), "vectors")
    shards = max(1, -(-vectors.count() // shard_rows))
    some = vectors.select("vec_id", "vec").orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id").limit(sample).toArrow()  # at most `sample` rows
    base = _matrix(some.column("vec").combine_chunks()) if some.num_rows else np.zeros((0, 1))
    top = Top.of(base, min(shards, leaves))
    parts = max(1, -(-shards // len(top.centres)))
    total = len(top.centres) * parts
    placed = cut(vectors.select("vec_id", "vec").mapInArrow(_placed(top, parts), "shard int, leaf int, far double, vec_id long, vec array<double>"), "placed")
    radius = np.full(len(top.centres), -1.0)
    for x in placed.groupBy("leaf").agg(F.max("far").alias("far")).collect():  # a row a leaf
        radius[x["leaf"]] = x["far"] * (1 + 1e-9)
    rows = placed.select("shard", F.lit(0).alias("kind"), "vec_id", "vec", F.lit(NONE).alias("kth"))
    asked = cut(vectors.where("asked").select("vec_id", "vec").dropDuplicates(["vec_id"]).mapInArrow(_placed(top, parts), "shard int, leaf int, far double, vec_id long, vec array<double>"), "asked")

    def visit(queries: DataFrame) -> DataFrame:
        both = rows.unionByName(queries).repartition(total, "shard").sortWithinPartitions("shard", "kind")
        return both.mapInArrow(_searcher(k), "query_id long, vec_id long, score long")

    first = cut(visit(asked.select("shard", F.lit(1).alias("kind"), "vec_id", "vec", F.lit(NONE).alias("kth"))), "home")
    reached = first.groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score").cast("double")).otherwise(F.lit(NONE)).alias("kth"))
    onward = asked.join(reached, asked["vec_id"] == reached["query_id"], "left").select("vec_id", "vec", F.coalesce("kth", F.lit(-float("inf"))).alias("kth"), F.col("shard").alias("home"))
    onward = onward.mapInArrow(_sent(top, radius, parts), "shard int, kind int, vec_id long, vec array<double>, kth double")
    found = first.unionByName(visit(onward)) if total > 1 else first
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """embeddings(vec_id, embedding) -> vec_id, vec: floor(scale * x) of each component, whole vectors only."""
    x = F.col("embedding")
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return embeddings.where(whole & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("vec"))
