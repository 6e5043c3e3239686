"""Removal of repeated 200-byte strings by bucket-pointer refinement (operator 9).

Suffixes are put in buckets by their first q bytes, and buckets are refined by sorting on the bucket identifiers of later
offsets, doubling the compared length until it is 200; what is alone in its bucket is dropped, and identifiers that a round
has refined are what the next one sorts on. At corpus scale two things keep the work small. Every 200-byte string is
represented by one suffix: that of the least q-gram hash among its own, a choice that equal strings share, so a bucket needs
one row for about 70 bytes. And most buckets settle as a whole: where the window of all 200-byte strings that one suffix stands
for has an equal elsewhere, all of them repeat; where its bucket is empty otherwise, none does. Only windows that share a
q-gram but are not equal (the edges of repeated passages) are refined offset by offset, in memory for bounded groups; buckets
of more windows are resolved by counting their 200-byte strings.

Equal texts (by SHA-256) repeat as a whole and count once. Filters on what to fetch in a further scan are bitmaps of fixed size.

Edge cases: null texts are empty; texts under 200 bytes lose nothing; a text may repeat itself, overlaps included; long texts
are looked at whole; repeated rows repeat each other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import arrow_batches, cut, mix64, together, utf8_blocks

LENGTH, Q = 200, 64
#: Starts that one suffix can stand for.
SPAN = LENGTH - Q + 1
BITS = 25
#: Windows of one bucket that are refined in memory.
GROUP = 50_000
_U = np.uint64
_PLACE = 28


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes (a power of two) that start at each byte; the last ones are of shorter strings."""
    h, base, width = data.astype(np.uint64) + _U(1), 0x9E3779B97F4A7C15, 1
    while width < size:
        step = h.copy()
        step[:-width] += h[width:] * _U(base)
        h, base, width = step, base * base & (1 << 64) - 1, width * 2
    return mix64(h)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: suffixes that stand for 200-byte strings: (place, first start, last start, q-gram hash)."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(data, Q)
    least = (h >> _U(_PLACE) << _U(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPAN - width
    least = np.minimum(least[: len(least) - rest], least[rest:])[:n]
    doc_end = np.repeat(ends[1:], np.diff(ends))[:n]
    starts = np.flatnonzero(np.arange(n) + LENGTH <= doc_end)
    place = (least[starts] & _U((1 << _PLACE) - 1)).astype(np.int64)
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return place[new], starts[new], starts[last], h[place[new]]


def text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _windows(data: np.ndarray, ends: np.ndarray, fresh: np.ndarray):
    """Anchors of the texts marked fresh, with text number, window hash and packed (place, back to first start, to last)."""
    at, first, last, gram = anchors(data, ends)
    doc = np.searchsorted(ends, at, "right") - 1
    keep = fresh[doc] if len(doc) else np.zeros(0, bool)
    at, first, last, gram, doc = at[keep], first[keep], last[keep], gram[keep], doc[keep]
    raw = data.tobytes()
    whole = np.array([xxhash.xxh3_64_intdigest(raw[a:b], int(seed)) for a, b, seed in zip(first.tolist(), (last + LENGTH).tolist(), ((at - first) << 8 | (at - last)).tolist(), strict=True)], np.uint64)
    packed = (at - ends[doc]) << 16 | (at - first) << 8 | (at - last)
    return at, first, last, gram, doc, whole, packed


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, ends, data in utf8_blocks(batches):
        texts = [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array([text_key(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], ["doc_id", "n_bytes", "key", "sha"])


def _fresh(data: np.ndarray, ends: np.ndarray, seen: set[int]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array([text_key(data[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64)
    fresh = np.zeros(len(keys), bool)
    for k, key in enumerate(keys.tolist()):
        if key not in seen:
            seen.add(key)
            fresh[k] = True
    if len(seen) > 250_000:
        seen.clear()
    return keys, fresh


def _third(gram: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Rows that are at least the third of a block with their window. They are known to repeat, and the first two stand for them in
    the bucket, so that a passage of many texts does not send a row for each of them to one task."""
    both = mix64(gram + mix64(whole))
    order = np.argsort(both, kind="stable")
    new = np.concatenate([[True], both[order][1:] != both[order][:-1]])[: len(both)]
    rank = np.arange(len(both)) - np.maximum.accumulate(np.where(new, np.arange(len(both)), 0))
    out = np.zeros(len(both), bool)
    out[order] = rank >= 2
    return out


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for _, ends, data in utf8_blocks(batches):
        keys, fresh = _fresh(data, ends, seen)
        _, _, _, gram, doc, whole, packed = _windows(data, ends, fresh)
        cols = [pa.array(x, pa.int64()) for x in (gram.view(np.int64), whole.view(np.int64), keys[doc], packed)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(_third(gram, whole))], ["gram", "whole", "key", "packed", "known"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by known, gram, whole -> those whose gram is not alone, with whether their window is not alone either. One row is
    held back until its successor is known."""
    names = ["gram", "whole", "key", "packed"]
    held: list[np.ndarray] | None = None
    before: tuple | None = None

    def flagged(cols: list[np.ndarray], after: tuple | None) -> pa.RecordBatch:
        gram, whole = cols[:2]
        pad = lambda x, lo, hi, k: np.concatenate([x[:1] ^ 1 if lo is None else [lo[k]], x, x[-1:] ^ 1 if hi is None else [hi[k]]])
        g, w = pad(gram, before, after, 0), pad(whole, before, after, 1)
        up, down = g[1:-1] == g[:-2], g[1:-1] == g[2:]
        same = (up & (w[1:-1] == w[:-2])) | (down & (w[1:-1] == w[2:]))
        keep = up | down
        return pa.RecordBatch.from_arrays([*[pa.array(c[keep]) for c in cols], pa.array(same[keep])], [*names, "same"])

    for batch in batches:
        repeats = batch.filter(batch.column("known"))
        if repeats.num_rows:
            yield pa.RecordBatch.from_arrays([*[repeats.column(c) for c in names], pa.array(np.ones(repeats.num_rows, bool))], [*names, "same"])
            batch = batch.filter(pc.invert(batch.column("known")))
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(c)) for c in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if len(cols[0]) > 1:
            body, after = [c[:-1] for c in cols], (cols[0][-1], cols[1][-1])
            yield flagged(body, after)
            before = (body[0][-1], body[1][-1])
        held = [c[-1:] for c in cols]
    if held is not None:
        yield flagged(held, None)


def _bitmap(df: DataFrame, column: str) -> bytes:
    top = f"shiftrightunsigned({column}, {64 - BITS})"
    words = df.select(F.expr(f"{top} div 64").alias("at"), F.expr(f"shiftleft(1L, cast({top} % 64 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    out = np.zeros((1 << BITS) // 64, "<i8")
    out[np.asarray(words.column("at"))] = np.asarray(words.column("word"))
    return out.tobytes()


def _hits(bitmap: bytes, values: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(bitmap, np.uint8)
    slot = values.view(np.uint64) >> _U(64 - BITS)
    return (bits[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1 > 0


def _spot(keys: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """A number for one suffix of one text."""
    return mix64(keys.view(np.uint64) + mix64(packed.view(np.uint64)))


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spots = _spot(np.asarray(batch.column("key")), np.asarray(batch.column("packed")))
        yield pa.RecordBatch.from_arrays([pa.array(spots.view(np.int64))], ["spot"])


def _fetch(bitmap):
    """The windows of the suffixes in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, ends, data in utf8_blocks(batches):
            keys, fresh = _fresh(data, ends, seen)
            at, first, last, gram, doc, whole, packed = _windows(data, ends, fresh)
            new = _hits(bitmap.value, _spot(keys[doc], packed))
            pieces = [data[a : b + LENGTH].tobytes() for a, b in zip(first[new], last[new], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(gram[new].view(np.int64)), pa.array(whole[new].view(np.int64)), pa.array((packed[new] & 0xFFFF).astype(np.int32)), pa.array(pieces, pa.binary())], ["gram", "whole", "reach", "bytes"])

    return run


def refine(pieces: list[bytes], front: np.ndarray, back: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which starts repeat. Row r's piece lies around its anchor: its starts are front[r] to back[r] bytes before it. Returns
    rows x SPAN booleans, column SPAN - 1 - d for the start d bytes before the anchor."""
    n, wide = len(pieces), SPAN - 1 + LENGTH
    text = np.zeros((n, wide), np.uint8)
    inside = np.zeros((n, wide), bool)
    for r, piece in enumerate(pieces):
        a = SPAN - 1 - front[r]
        text[r, a : a + len(piece)] = np.frombuffer(piece, np.uint8)
        inside[r, a : a + len(piece)] = True
    # q-gram buckets: identifiers of the strings of Q bytes, with the group's number in them
    ids = text.astype(np.uint64) + _U(1)
    base, q = 0x9E3779B97F4A7C15, 1
    while q < Q:
        ids = ids[:, :-q] + ids[:, q:] * _U(base)
        base, q = base * base & (1 << 64) - 1, q * 2
    ids = mix64(ids + group.astype(np.uint64)[:, None] * _U(0xD6E8FEB86659FD93))
    live = inside[:, : wide - Q + 1] & inside[:, Q - 1 :]

    def ranked(keys: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sort the keys of live suffixes; new identifiers, and which are not alone in their bucket."""
        out, more = np.zeros(keys.shape, np.int64), np.zeros(keys.shape, bool)
        _, inverse, count = np.unique(keys[live], return_inverse=True, return_counts=True)
        out[live], more[live] = inverse, count[inverse] > 1
        return out, more

    def refined(ids: np.ndarray, live: np.ndarray, length: int) -> np.ndarray:
        """Buckets of equal strings of `length` bytes, sorted on the buckets that begin up to `length` bytes later, and so on with what
        that gives, until the strings have LENGTH bytes. What is alone in its bucket is left out from there on."""
        if length == LENGTH or not live.any():
            return live
        step = min(length, LENGTH - length)
        cols = ids.shape[1] - step
        both = live[:, :cols] & live[:, step:]
        if length + step == LENGTH:  # only the starts that each suffix stands for count
            d = SPAN - 1 - np.arange(cols)
            both &= (d <= front[:, None]) & (d >= back[:, None])
        return refined(*ranked(ids[:, :cols] * (int(ids.max(initial=0)) + 1) + ids[:, step:], both), length + step)

    out = refined(*ranked(ids, live), Q)
    whole = np.zeros((n, SPAN), bool)
    whole[:, : min(SPAN, out.shape[1])] = out[:, :SPAN]
    return whole


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and last column of every run of True."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    r, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return r, a, b - 1


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, whole, reach, bytes) sorted by gram, whole -> (gram, whole, near, far): starts near to far bytes before the
    anchor repeat. Whole groups are taken together, some thousand rows at a time."""
    rows: list[tuple] = []

    def settle() -> pa.RecordBatch:
        gram = np.array([x[0] for x in rows], np.int64)
        new = np.concatenate([[True], gram[1:] != gram[:-1]])
        group = np.cumsum(new)
        keep = np.bincount(group)[group] > 1
        own = [x for x, k in zip(rows, keep, strict=True) if k]
        rows.clear()
        if not own:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())], ["gram", "whole", "near", "far"])
        reach = np.array([x[2] for x in own], np.int64)
        mask = refine([x[3] for x in own], reach >> 8, reach & 255, group[keep])
        r, a, b = _runs(mask)
        return pa.RecordBatch.from_arrays([pa.array(np.array([x[0] for x in own], np.int64)[r]), pa.array(np.array([x[1] for x in own], np.int64)[r]), pa.array((SPAN - 1 - b).astype(np.int32)), pa.array((SPAN - 1 - a).astype(np.int32))], ["gram", "whole", "near", "far"])

    for batch in batches:
        for x in zip(*(batch.column(c).to_pylist() for c in ("gram", "whole", "reach", "bytes")), strict=True):
            if rows and x[:2] == rows[-1][:2]:
                continue
            if len(rows) >= 2048 and x[0] != rows[-1][0]:
                yield settle()
            rows.append(x)
    if rows:
        yield settle()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of very large buckets: a row for every start, to be counted."""
    for batch in batches:
        out: list[tuple] = []
        for gram, whole, reach, piece in zip(*(batch.column(c).to_pylist() for c in ("gram", "whole", "reach", "bytes")), strict=True):
            out += [(xxhash.xxh3_64_intdigest(piece[k : k + LENGTH]) - (1 << 63), gram, whole, (reach >> 8) - k) for k in range(len(piece) - LENGTH + 1)]
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["string", "gram", "whole", "near"])


def _take(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, ends, data in utf8_blocks(batches):
            keys, fresh = _fresh(data, ends, seen)
            pick = np.flatnonzero(fresh & _hits(bitmap.value, keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys[pick]), pa.array([data[ends[k] : ends[k + 1]].tobytes() for k in pick], pa.binary())], ["key", "bytes"])

    return run


def merged(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(pieces):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remains(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for ab in removed for x in ab], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, text, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("key", "bytes", "starts", "stops")), strict=True):
            gone = merged(list(zip(starts, stops, strict=True)))
            out.append((key, sum(b - a for a, b in gone), len(gone), hashlib.sha256(remains(text, gone)).hexdigest(), [x for ab in gone for x in ab]))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "n_removed", "n_spans", "kept_sha256", "removed"])


def covered(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(key, start, stop): pieces of texts, by text key, that repeated strings cover; equal texts are left to `dedup`."""
    spark = docs.sparkSession
    texts = docs.select("text")
    rows = texts.mapInArrow(_suffixes, "gram long, whole long, key long, packed long, known boolean")
    dealt = rows.repartition(F.when(F.col("known"), F.xxhash64("key", "packed")).otherwise(F.xxhash64("gram")))
    shared = cut(dealt.sortWithinPartitions("known", "gram", "whole").mapInArrow(_shared, "gram long, whole long, key long, packed long, same boolean"), "shared")
    place, front, back = F.shiftright("packed", 16), F.shiftright("packed", 8).bitwiseAND(F.lit(255)), F.col("packed").bitwiseAND(F.lit(255))
    whole = shared.where("same").select("key", (place - front).alias("start"), (place - back + LENGTH).alias("stop"))
    mixed = shared.where("NOT same")
    # of equal windows of a bucket one is enough to compare with; which one to fetch is told by a bitmap
    chosen = shared.join(mixed.select("gram").distinct(), "gram", "left_semi").groupBy("gram", "whole").agg(F.min(F.struct("key", "packed")).alias("x")).select("gram", "x.key", "x.packed")
    chosen = cut(chosen, "chosen")
    bitmap = spark.sparkContext.broadcast(_bitmap(chosen.select("key", "packed").mapInArrow(_spots, "spot long"), "spot"))
    windows = texts.mapInArrow(_fetch(bitmap), "gram long, whole long, reach int, bytes binary")
    large = cut(chosen.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("gram"), "large")
    found = "gram long, whole long, near int, far int"
    if large.take(1):
        windows = cut(windows, "windows")
        few = together(windows.join(large, "gram", "left_anti"), "gram").sortWithinPartitions("gram", "whole")
        each = windows.join(large, "gram", "left_semi").dropDuplicates(["gram", "whole"]).mapInArrow(_each, "string long, gram long, whole long, near int")
        often = each.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
        more = each.join(often, "string").select("gram", "whole", "near", F.col("near").alias("far"))
        ranges = few.mapInArrow(_refined, found).unionByName(more)
    else:
        ranges = together(windows, "gram").sortWithinPartitions("gram", "whole").mapInArrow(_refined, found)
    edges = mixed.join(ranges, ["gram", "whole"]).select("key", (place - F.col("far")).alias("start"), (place - F.col("near") + LENGTH).alias("stop"))
    return whole.unionByName(edges)


def dedup(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (starts and stops in turn)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    base = cut(docs.select("doc_id", "text").mapInArrow(_base, "doc_id long, n_bytes long, key long, sha string"), "base")
    copies = cut(base.where(F.col("n_bytes") >= LENGTH).groupBy("key", "sha").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    pieces = covered(docs, base).join(copies.select("key"), "key", "left_anti").groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    pieces = cut(pieces, "pieces")
    bitmap = spark.sparkContext.broadcast(_bitmap(pieces, "key"))
    texts = docs.select("text").mapInArrow(_take(bitmap), "key long, bytes binary")
    done = texts.join(pieces, "key").mapInArrow(_outcome, "key long, n_removed long, n_spans long, kept_sha256 string, removed array<long>").dropDuplicates(["key"])
    out = base.join(copies, ["key", "sha"], "left").join(done, "key", "left")
    gone, none = F.col("copies").isNotNull(), F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"), F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.array(none, F.col("n_bytes"))).otherwise(F.coalesce("removed", F.array().cast("array<long>"))).alias("removed"),
    )
