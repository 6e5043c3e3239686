"""Quality classifier by co-training (operator 2).

Two linear classifiers see different views of a document: its text content (byte and byte-pair shares, shape of words and lines)
and its page metadata (language, source, length). They are fitted on moments (counts, sums and outer products of each class), so
that training adds up over executors. In each round every document outside of the labelled sample is scored by both views; those
of which a calibrated view is confident join the moments of the other view with that label. There is no pool and no count: a
threshold on confidence decides, over the whole table. A text that makes up more than a thousandth of the table counts once
(at most a thousand such texts exist). At the end a calibrated combination of both views scores every document.

The labelled sample is bounded: at most `labelled` labelled rows, those with the smallest hash of doc_id; of each four, two fit,
one calibrates the views and one fits their combination. All texts are read whole.

Edge cases: null and empty texts have zero text features; null metadata are a value of their own; without labels of both
classes every document is kept with score 0.5; repeated rows give repeated rows; labels given more than once count as their
smallest; an empty table gives an empty result; `score` ignores extra columns, `kept` returns the input's columns, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import arrow_batches, cut, utf8_blocks

#: Labelled rows to fit on at most, rounds, and from what probability on a view is confident.
LABELLED, ROUNDS, SURE = 6000, 3, 0.95
#: A text counts once if it has this share of the rows; there are at most 1 / HEAVY of them.
HEAVY = 1e-3
#: Parts that are added up into one, until so many are left for the driver.
MERGED = 8
PAIRS, META = 256, 64
#: A document is rejected when its score (probability of good quality) falls below this.
KEEP = 0.5
_SHAPES = 7


def text_view(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row for each text of a block: 128 byte shares, hashed shares of byte pairs, and shape features."""
    n, size = len(ends) - 1, np.maximum(np.diff(ends), 1)[:, None]
    doc = np.repeat(np.arange(n), np.diff(ends))
    plain = np.minimum(data, 127).astype(np.int64)
    ones = np.bincount(doc * 128 + plain, minlength=n * 128)[: n * 128].reshape(n, 128) / size
    pair = (data[:-1].astype(np.int64) * 37 + data[1:] * 101 + (data[:-1] == data[1:]) * 53) % PAIRS if len(data) else np.zeros(0, np.int64)
    same = doc[:-1] == doc[1:]
    twos = np.bincount(doc[:-1][same] * PAIRS + pair[same], minlength=n * PAIRS)[: n * PAIRS].reshape(n, PAIRS) / size
    shape = np.zeros((n, _SHAPES))
    for k in range(n):
        text = data[ends[k] : ends[k + 1]].tobytes()
        lines = text.split(b"\n")
        words = text.split()
        shape[k] = (len(set(lines)) / len(lines), len(text) / len(lines) / 500, len(set(words)) / max(1, len(words)), len(text) / max(1, text.count(b" ") + len(lines)) / 10, np.log1p(len(text)) / 10, text.count(b". ") * 20 / max(1, len(text)), 1.0)
    return np.concatenate([np.sqrt(ones), np.sqrt(twos), shape], 1)


def meta_view(lang: list, source: list, size: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lang), 2 * META + 16))
    for k, (a, b) in enumerate(zip(lang, source, strict=True)):
        out[k, xxhash.xxh32_intdigest(f"l{a}") % META] = 1
        out[k, META + xxhash.xxh32_intdigest(f"s{b}") % META] = 1
    out[np.arange(len(out)), 2 * META + np.minimum(np.log2(size + 1).astype(int), 15)] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Moments:
    """Weight, sum and outer products of the rows of each class, 0 and 1."""

    n: np.ndarray
    sums: np.ndarray
    outer: np.ndarray

    @classmethod
    def none(cls, width: int) -> "Moments":
        return cls(np.zeros(2), np.zeros((2, width)), np.zeros((2, width, width)))

    def add(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        for c in (0, 1):
            if (own := label == c).any():
                z, w = x[own], weight[own]
                self.n[c] += w.sum()
                self.sums[c] += w @ z
                self.outer[c] += (z * w[:, None]).T @ z

    def plus(self, other: "Moments") -> "Moments":
        """With other rows, of each class no more weight of them than there is of own ones."""
        share = np.where(other.n > self.n, self.n / np.maximum(other.n, 1e-9), 1.0)
        return Moments(self.n + share * other.n, self.sums + share[:, None] * other.sums, self.outer + share[:, None, None] * other.outer)


@dataclass
class View:
    """Linear discriminant on standardised features, with Platt scaling."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def of(cls, x: np.ndarray) -> "View":
        return cls(x.mean(0), x.std(0) + 1e-3, np.zeros(x.shape[1] + 1))

    def seen(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def fit(self, m: Moments) -> "View":
        """Both classes weigh the same; the covariance is drawn to the identity the more, the fewer rows there are."""
        centre = m.sums / m.n[:, None]
        spread = sum(m.outer[c] / m.n[c] - np.outer(centre[c], centre[c]) for c in (0, 1)) / 2
        width = len(spread)
        drawn = width / (width + m.n.sum())
        w = np.linalg.solve((1 - drawn) * spread + (drawn + 1e-3) * np.eye(width), centre[1] - centre[0])
        return View(self.mean, self.spread, np.append(w, -w @ (centre[0] + centre[1]) / 2))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.seen(x) @ self.weights[:-1] + self.weights[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "View":
        w = _logistic(np.stack([self.raw(x), np.ones(len(x))], 1), y, np.array([1.0, 0.0]), 0.1)
        self.scale, self.shift = float(max(w[0], 0)), float(w[1])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.scale * self.raw(x) + self.shift


def _logistic(z: np.ndarray, y: np.ndarray, start: np.ndarray, penalty: float) -> np.ndarray:
    """Weights of a logistic regression, drawn to `start`."""
    w = start.copy()
    for _ in range(30):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(w)), z.T @ (p - y) + penalty * (w - start))
        w = w - step / max(1.0, np.abs(step).max())
    return w


@dataclass
class Model:
    text: View
    meta: View
    joint: np.ndarray

    def score(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(x), self.meta.logit(m)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.joint[0] * a + self.joint[1] * b + self.joint[2])


def cotrain(x: np.ndarray, m: np.ndarray, y: np.ndarray, given, rounds: int = ROUNDS) -> Model:
    """Labelled views x, m with y; given(text view, metadata view) -> moments that the text view and the metadata view are given of
    rows without labels, labelled by the other view."""
    part = np.arange(len(y)) % 4
    fit, held, last = (p if len(set(y[p])) == 2 else np.ones(len(y), bool) for p in (part < 2, part == 2, part == 3))
    both = [View.of(v[fit]) for v in (x, m)]
    own = [Moments.none(v.shape[1]) for v in (x, m)]
    for view, mine, v in zip(both, own, (x, m), strict=True):
        mine.add(view.seen(v[fit]), y[fit], np.ones(fit.sum()))
    views = [view.fit(mine).calibrate(v[held], y[held]) for view, mine, v in zip(both, own, (x, m), strict=True)]
    for _ in range(rounds):
        more = given(*views)
        views = [view.fit(mine.plus(extra)).calibrate(v[held], y[held]) for view, mine, extra, v in zip(both, own, more, (x, m), strict=True)]
    z = np.stack([views[0].logit(x[last]), views[1].logit(m[last]), np.ones(last.sum())], 1)
    return Model(*views, _logistic(z, y[last], np.array([1.0, 0.0, 0.0]), 1.0))


def _features(rows: pa.RecordBatch, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return text_view(data, ends), meta_view(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), np.diff(ends))


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, ends, data in utf8_blocks(batches):
        x, m = _features(rows, ends, data)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("quality").cast(pa.int64()), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()), pa.array([r.tobytes() for r in m.astype(np.float32)], pa.binary())], ["doc_id", "quality", "x", "m"])


_PARTS = "part int, view int, n binary, sums binary, outer binary"


def _part(part: int, moments: list[Moments]) -> pa.RecordBatch:
    cols = [[x.tobytes() for x in col] for col in zip(*[(m.n, m.sums, m.outer) for m in moments], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(moments), pa.int32()), pa.array(range(len(moments)), pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], [x.split()[0] for x in _PARTS.split(", ")])


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Moments]]:
    """All parts of a task added up, if there are any."""
    out: dict[int, Moments] = {}
    for batch in batches:
        for view, *raw in zip(*(batch.column(c).to_pylist() for c in ("view", "n", "sums", "outer")), strict=True):
            n, sums, outer = (np.frombuffer(x, float) for x in raw)
            width = len(sums) // 2
            have = out.setdefault(view, Moments.none(width))
            have.n += n
            have.sums += sums.reshape(2, width)
            have.outer += outer.reshape(2, width, width)
    if out:
        yield [out[k] for k in sorted(out)]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for moments in _sum_parts(batches):
        yield _part(TaskContext.get().partitionId(), moments)


def _confident(text: View, meta: View, sample: set[int], copies: dict[int, int], sure: float):
    """Rows -> moments of those that a view is confident of, for the other view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [Moments.none(len(text.mean)), Moments.none(len(meta.mean))]
        for rows, ends, data in utf8_blocks(batches):
            x, m = _features(rows, ends, data)
            free = np.array([i not in sample for i in rows.column("doc_id").to_pylist()])
            weight = np.array([1 / copies.get(k, 1) for k in rows.column("same").to_pylist()])
            p = _sigmoid(text.logit(x)), _sigmoid(meta.logit(m))
            for to, view, v, q in ((out[0], text, x, p[1]), (out[1], meta, m, p[0])):
                own = free & ((q >= sure) | (q <= 1 - sure))
                to.add(view.seen(v[own]), (q[own] >= sure).astype(int), weight[own])
        yield _part(TaskContext.get().partitionId(), out)

    return run


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> Model | None:
    """Fit on at most `labelled` labelled rows, and on all other rows that one view is sure of."""
    arrow_batches(docs.sparkSession)
    h = F.xxhash64(F.lit(29), "doc_id")
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality")).withColumn("_h", h)
    here = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    some = cut(known.join(here, "doc_id", "left_semi").orderBy("_h", "doc_id").limit(labelled).select("doc_id", "quality"), "labelled")
    # at most `labelled` rows of two numbers: bounded, so they may be broadcast; a doc_id that many rows have gives one of them
    one = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "lang", "source", "quality"), F.xxhash64("text", "lang", "source")).alias("x"))
    got = one.select("doc_id", "x.*").mapInArrow(_views, "doc_id long, quality long, x binary, m binary").toArrow().sort_by("doc_id")
    y = np.array(got.column("quality").to_pylist(), float)
    if len(set(y)) < 2:
        return None
    x, m = (np.frombuffer(b"".join(got.column(c).to_pylist()), np.float32).reshape(len(y), -1).astype(float) for c in ("x", "m"))
    order = np.random.default_rng(5).permutation(len(y))
    sample = set(got.column("doc_id").to_pylist())
    rows = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("same"))
    total = docs.count()
    heavy = rows.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, HEAVY * total)).toArrow()
    copies = dict(zip(heavy.column("same").to_pylist(), heavy.column("n").to_pylist(), strict=True))

    def given(text: View, meta: View) -> list[Moments]:
        parts = rows.mapInArrow(_confident(text, meta, sample, copies, sure), _PARTS)
        left = parts.rdd.getNumPartitions()
        while left > MERGED:
            left = -(-left // MERGED)
            parts = parts.repartition(left, F.col("part") % left).mapInArrow(_merge, _PARTS)
        whole = next(_sum_parts(iter(parts.toArrow().to_batches())), None)
        return whole or [Moments.none(len(text.mean)), Moments.none(len(meta.mean))]

    return cotrain(x[order], m[order], y[order], given, rounds)


def _scorer(model: Model | None, names: list[str] | None, keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends, data in utf8_blocks(batches):
            p = (np.full(rows.num_rows, 0.5),) * 3 if model is None else model.score(*_features(rows, ends, data))
            good = p[2] >= keep
            if names is not None:
                yield pa.RecordBatch.from_arrays([rows.column(c).filter(pa.array(good)) for c in names], names)
            else:
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *[pa.array(np.round(x, 6)) for x in p], pa.array(good.astype(np.int32))], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return run


def score(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **bounds) -> DataFrame:
    """docs(doc_id, text, lang, source) -> both views' scores, the combined score and keep (0 or 1) of every document."""
    model = train(docs, labels, **bounds)
    return docs.select("doc_id", "text", "lang", "source").mapInArrow(_scorer(model, None, keep), "doc_id long, text_score double, meta_score double, score double, keep int")


def kept(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **bounds) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    return docs.mapInArrow(_scorer(train(docs, labels, **bounds), docs.columns, keep), docs.schema)
