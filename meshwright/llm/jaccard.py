"""N-gram Jaccard join by universe-partition pigeonhole (operator 10).

A document's set holds the 64-bit hashes of its distinct 5-word shingles; equal sets are one class. Sets x and y with Jaccard
similarity of t or more differ in at most H = (1 - t) / (1 + t) (|x| + |y|) elements. The universe of hashes is cut into m
segments, m set by size band, so at most H segments of the two differ. Every segment's subset is a key. Both documents rank
their keys alike (rare ones first, empty ones last) and index the first H + L: the L best-ranked segments on which they agree are
preceded by at most H others in either, so both index them, and pairs with fewer than L keys in common need no look. Costs decide the ranking: how often keys occur is counted over the
whole corpus, and the most frequent are put off. Finer segments do not cost more keys, so bands below SMALL use segments of one
element, larger sets coarser ones; sets of up to six, which differ in
one element at most, are one segment with its one-deletion neighbourhood. A set with too few occupied segments for the
guarantee makes the join start again with another hash.

In the band of one-element segments, of two sets that link, the one whose index of infrequent elements ends first has at most
n - o of these that nobody else has indexed (o: least overlap): the other has indexed all that they share there. Where both have
indexed all their infrequent elements this holds for both. Pairs that fail it are not looked at, which settles crowds that share
a passage and little else, and copies with many edits.

Every class also has one parity bit for each of some segments: no more segments can differ in parity than elements differ, so
a pair with more differing bits than a link allows is ruled out exactly, without its sets. BRIEF bits go with the keys; a longer
signature, of four bits an element or more, is asked before sets are fetched.

Classes under one key are first compared with the key's first class, and those under crowded keys with one class and along a random chain.
Components of what links leave the pairs of classes of
one key in different components; all of these that have L keys in common and sizes that allow a link are then compared, so no
link that matters to a component is lost. Comparisons are exact, on whole sets.

Edge cases: null texts and texts without words have no set, no links and are their own component; repeated rows and equal
texts share a class; rows without a doc_id link as others do, and their component is null where no row in it has one; long texts
only have larger sets; an empty table gives an empty result; extra columns, whatever their names, are ignored by `join` and stay
in `distinct_documents`. Sets and classes are known by 64-bit hashes: of n different texts, n * n / 2**65 pairs are expected to be
taken for equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meshwright.llm.common import arrow_batches, cut, discard, give_back, mix64, slim, tidy, together, unused, utf8_blocks, word_hashes
from meshwright.llm.components import components, extend

SHINGLE, PERCENT = 5, 75
#: Sets below TINY use one-deletion neighbourhoods, below SMALL segments of one element; bands above grow by BAND.
TINY, SMALL, BAND = 7, 1024, 4
#: A key met in this many documents counts as frequent; so many of the most frequent are told to the tasks (3 MB).
FREQUENT, TOLD = 8, 1 << 18
#: Keys in common that a pair must have (L), where its sets have that many to spare.
SHARED = 5
#: Classes of a key that make it crowded; of eight such keys, so many are compared with one class or chained.
CROWD, STARS, CHAINS = 8, 1, 2
#: Keys that a task packs together, and that a bucket is to hold; key of notes.
PACK, BUCKET, NOTE = 1 << 17, 1 << 19, -1
#: Bits of the signature that goes with keys, and rows of keys looked at together.
BRIEF, ROWS = 1024, 1 << 16
#: Classes that a task remembers, so as not to give them twice.
SEEN = 250_000
#: Pairs of one lead that one task verifies.
LEAD = 512
BITS = 24
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_U = np.uint64


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a block."""
    starts, _, h = word_hashes(data, ends, _WORD)
    first = np.searchsorted(starts, ends)
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        rolled += mix64(h[j : len(h) - size + 1 + j] + _U(0x1000 + j)) if len(rolled) else rolled
    rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(mix64(sum((mix64(h[a + j : a + j + 1] + _U(0x2000 * (b - a) + j)) for j in range(b - a)), np.zeros(1, np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """One number for a set; 0 only for the empty one."""
    return int(np.array(mix64(np.add.reduce(mix64(s + _U(0x51ED)), keepdims=True) + _U(len(s))))[0].view(np.int64)) if len(s) else 0


def parity(s: np.ndarray, bits: int) -> bytes:
    """One bit a segment (the low bits of the hash): whether the set has an odd number of elements there."""
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def signature(s: np.ndarray) -> bytes:
    return parity(s, max(64, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 64)


def folded(sig: np.ndarray, size: int) -> np.ndarray:
    """The signature with `size` bytes, no longer than it is: halves of the segments joined."""
    while len(sig) > size:
        sig = sig[: len(sig) // 2] ^ sig[len(sig) // 2 :]
    return sig


def most(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """How many elements two linked sets of these sizes can differ in."""
    return n + m + 2 * (-PERCENT * (n + m) // (100 + PERCENT))


def bands(n: int) -> list[tuple[int, int]]:
    """(number of the band, its end) for a set of n: its own, and the next if partners can lie there."""
    edges, k = [1, TINY, SMALL], 0
    while edges[-1] <= n * 100 // PERCENT:
        edges.append(edges[-1] * BAND)
    k = next(i for i in range(len(edges)) if n < edges[i]) - 1
    out = [(k, edges[k + 1])]
    if n * 100 // PERCENT >= edges[k + 1]:
        out.append((k + 1, edges[k + 2]))
    return out


def keys(s: np.ndarray, band: int, end: int, seed: int) -> tuple[np.ndarray, int, bool]:
    """(all keys of the occupied segments, H + 1, whether there are so many). Keys of one-element segments are odd."""
    n = len(s)
    salt = _U((band * 1_000_003 + seed * 7919 + 1) & 0xFFFFFFFF)
    if band == 0:
        m = mix64(s + salt)
        total = np.add.reduce(m)
        k = mix64(np.concatenate([[total], total - m]) + salt) if n > 1 else mix64(np.array([total]) + salt)
        return k & _U(-2 & (1 << 64) - 1), len(k), True
    need = (n + min(n * 100 // PERCENT, end - 1)) * (100 - PERCENT) // (100 + PERCENT) + 1
    if band == 1:
        return mix64(s * _U(0x9E3779B97F4A7C15) + salt) | _U(1), need, n >= need
    m = mix64(s + _U(int(salt) * 0x2545F4914F6CDD1D & (1 << 64) - 1))
    if seed:
        m = np.sort(m)
    segment = (s if not seed else m) >> _U(64 - (end // 2).bit_length() + 1)
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    k = mix64(np.add.reduceat(m, first) ^ mix64(segment[first] + salt))
    return k & _U(-2 & (1 << 64) - 1), need, len(k) >= need


def chosen(s: np.ndarray, seed: int, told: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, int, bool]:
    """The keys to index: of each band the first by (cost, key), SHARED - 1 more than H + 1. Second, where the set lies in the
    band of one-element segments alone: how many infrequent elements are indexed (their keys have bit 1), as -2 - number if not all are;
    else -1."""
    out, fine, rare, own = [], True, -1, bands(len(s))
    for band, end in own:
        k, need, ok = keys(s, band, end, seed)
        fine &= ok
        need += SHARED - 1
        if band == 1:
            at = np.searchsorted(told, k)
            at[at == len(told)] = 0
            hit = told[at] == k if len(told) else np.zeros(len(k), bool)
            common = k[hit]
            free = int(len(k) - len(common))
            if need < len(k):
                price = cost[at[hit]]
                common = common[np.lexsort((common, price))[: max(0, need - free)]]
                rest = k[~hit] if need >= free else np.partition(k[~hit], need - 1)[:need]
            else:
                rest = k[~hit]
            if len(own) == 1:
                rare = free if len(rest) == free else -2 - len(rest)
            k = np.concatenate([common & _U(-3 & (1 << 64) - 1), rest | _U(2)])
        elif need < len(k):
            at = np.searchsorted(told, k)
            at[at == len(told)] = 0
            hit = told[at] == k if len(told) else np.zeros(len(k), bool)
            k = k[np.lexsort((k, np.where(hit, cost[at], 0)))[:need]] if hit.any() else np.partition(k, need - 1)[:need]
        out.append(k)
    return np.concatenate(out), rare, fine


def often_met(met: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys that occur three times or more in these arrays, and how often. The list is emptied, and its keys are held once."""
    k = np.concatenate(met) if met else np.zeros(0, np.uint64)
    met.clear()
    k.sort()
    third = np.flatnonzero(k[2:] == k[:-2])
    keys = k[third[np.concatenate([[True], k[third[1:]] != k[third[:-1]]])[: len(third)]]]
    return keys, np.searchsorted(k, keys, "right") - np.searchsorted(k, keys)


def _classes(seed: int):
    """Rows of documents (kind 0: doc_id, size, class) and of keys that a task met often (kind 1: key, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[np.ndarray] = []
        seen: set[int] = set()
        kept = 0
        names = ["kind", "id", "n", "class", "least", "sig", "brief"]

        def flush() -> pa.RecordBatch:
            k, n = often_met(met)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(k), np.int32)), pa.array(k.view(np.int64)), pa.array(n, pa.int64()), pa.array(np.zeros(len(k), np.int64)), pa.array(np.zeros(len(k), np.int32)), pa.nulls(len(k), pa.binary()), pa.nulls(len(k), pa.binary())], names)

        for rows, ends, data in utf8_blocks(batches):
            sets = shingle_sets(data, ends)
            own = [class_of(s) for s in sets]
            least = np.zeros(len(own), np.int32)
            sigs, briefs = [None] * len(own), [None] * len(own)
            for at, (s, c) in enumerate(zip(sets, own, strict=True)):
                if len(s) and c not in seen:
                    seen.add(c)
                    sigs[at], briefs[at] = signature(s), parity(s, BRIEF)
                    got = [(band, *keys(s, band, end, seed)) for band, end in bands(len(s))]
                    least[at] = min(1 + min(SHARED - 1, len(k) - need) if band else 1 for band, k, need, _ in got)
                    met += [k for band, k, _, _ in got if band]
                    kept += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(own), np.int32)), rows.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.int64()), pa.array(least), pa.array(sigs, pa.binary()), pa.array(briefs, pa.binary())], names)
            if kept > 3_000_000 or len(seen) > SEEN:
                yield flush()
                kept = 0
                seen.clear()
        yield flush()

    return run


_CLASSES = "kind int, id long, n long, class long, least int, sig binary, brief binary"


def _packed(buckets: int, k: np.ndarray, c: np.ndarray, note: bool) -> pa.RecordBatch:
    """Keys and their classes, or classes and notes on them, as one row a bucket."""
    bucket = (mix64(k) % _U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    k, c, bucket = k[order], c[order], bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = pa.py_buffer((np.concatenate([first, [len(k)]]) * 8).astype(np.int32))
    blobs = [pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(x)]) for x in (k, c)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *blobs, pa.array(np.full(len(first), note))], ["bucket", "keys", "classes", "note"])


def _index(seed: int, told: np.ndarray, cost: np.ndarray, buckets: int):
    """Texts -> packed keys, and as notes what `chosen` says of infrequent elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        ks, cs, notes, size = [], [], [], 0

        def give() -> Iterator[pa.RecordBatch]:
            yield _packed(buckets, np.concatenate(ks), np.concatenate(cs), False)
            own = np.array(notes, np.int64)
            yield _packed(buckets, np.ascontiguousarray(own[:, 0]).view(np.uint64), np.ascontiguousarray(own[:, 1]), True)
            for x in (ks, cs, notes):
                x.clear()

        for _, ends, data in utf8_blocks(batches):
            for s in shingle_sets(data, ends):
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    k, rare, fine = chosen(s, seed, told, cost)
                    ks.append(k if fine else np.concatenate([k, [_U(0)]]))
                    cs.append(np.full(len(ks[-1]), c, np.int64))
                    size += len(ks[-1])
                    notes.append((c, rare))
            if len(seen) > SEEN:
                seen.clear()
            if size > PACK:
                yield from give()
                size = 0
        if ks:
            yield from give()

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by bucket -> (key, class, lead) of keys with two classes or more; lead: the key's first class. Key 0
    marks sets without the guarantee and always passes. Notes come out with key NOTE and themselves as lead."""

    def give() -> pa.RecordBatch:
        k, c = np.frombuffer(b"".join(ks), np.uint64), np.frombuffer(b"".join(cs), np.int64)
        order = np.argsort(k)
        k, c = k[order], c[order]
        again = np.concatenate([[False], k[1:] == k[:-1]])
        some = again[: len(k)] | np.concatenate([again[1:], [False]])[: len(k)] | (k == 0)
        k, c = k[some], c[some]
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        once = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])[: len(k)]
        k, c = k[once], c[once]
        new = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        lead = c[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        more = ~new | np.concatenate([~new[1:], [False]])[: len(k)] | (k == 0)
        about, said = (np.frombuffer(b"".join(x), np.int64) for x in (nk, nc))
        out = zip((k.view(np.int64)[more], c[more], lead[more]), (np.full(len(about), NOTE), about, said), strict=True)
        for x in (ks, cs, nk, nc):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["key", "class", "lead"])

    at, ks, cs, nk, nc = None, [], [], [], []
    for batch in batches:
        for bucket, k, c, note in zip(*(batch.column(x).to_pylist() for x in ("bucket", "keys", "classes", "note")), strict=True):
            if bucket != at and at is not None:
                yield give()
            at = bucket
            (nk if note else ks).append(k)
            (nc if note else cs).append(c)
    if at is not None:
        yield give()
    give_back()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables of about ROWS rows that end where a key ends."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        whole = pa.Table.from_batches(held)
        k = whole.column("key").to_numpy()
        end = len(k) - int(np.argmax(k[::-1] != k[-1])) if k[0] != k[-1] else 0
        if end:
            yield whole.slice(0, end)
        held = whole.slice(end).combine_chunks().to_batches()
        rows = len(k) - end
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BRIEF // 64)


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, root, class, n, alone, viable, whole, brief) sorted by key, n -> (a, b, keys): pairs of classes of one key, one of
    them viable, whose roots differ and whose sizes and brief signatures allow a link, counted within the task. Each row meets the
    one so many places on, for all rows at once, as long as the key is the same and the size fits."""
    held, size = [], 0

    def give() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        _, first, count = np.unique(mix64(a.view(np.uint64) + mix64(b.view(np.uint64))), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(count, pa.int64())], ["a", "b", "keys"])

    for rows in _whole_groups(batches):
        key, root, cls, n, alone = (rows.column(c).to_numpy() for c in ("key", "root", "class", "n", "alone"))
        viable, whole = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("viable", "whole"))
        brief = _matrix(rows.column("brief"))
        at, step = np.arange(len(key)), 0
        while len(at):
            step += 1
            at = at[: np.searchsorted(at, len(key) - step)]
            at = at[(key[at] == key[at + step]) & (PERCENT * n[at + step] <= 100 * n[at])]
            i = at[(root[at] != root[at + step]) & (viable[at] | viable[at + step])]
            j = i + step
            o = -(-PERCENT * (n[i] + n[j]) // (100 + PERCENT))
            fits_i, fits_j = alone[i] <= n[i] - o, alone[j] <= n[j] - o
            both = fits_i & fits_j & (alone[i] + alone[j] <= n[i] + n[j] - 2 * o)
            fits = np.where(whole[i], np.where(whole[j], both, fits_j), np.where(whole[j], fits_i, fits_i | fits_j))
            i = i[(alone[i] < 0) | (alone[j] < 0) | fits]
            for k in range(0, len(i), 1 << 14):
                x = i[k : k + (1 << 14)]
                y = x + step
                x = x[np.bitwise_count(brief[x] ^ brief[y]).sum(1, dtype=np.int64) <= most(n[x], n[y])]
                y = x + step
                if len(x):
                    held.append((np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])))
                    size += len(x)
            if size > 500_000:
                yield give()
                size = 0
    if held:
        yield give()
    give_back()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, star, turn, class, n, brief) sorted by key, turn -> (a, b): neighbours in a key's own random order, or the first
    and each other one (star), whose sizes and brief signatures allow a link."""
    for rows in _whole_groups(batches):
        key, cls, n = (rows.column(c).to_numpy() for c in ("key", "class", "n"))
        star = rows.column("star").to_numpy(zero_copy_only=False).astype(bool)
        brief = _matrix(rows.column("brief"))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        y = np.flatnonzero(~new)
        x = np.where(star[y], first[y], y - 1)
        ok = (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])) & (cls[x] != cls[y])
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(brief[x] ^ brief[y]).sum(1, dtype=np.int64) <= most(n[x], n[y])
        x, y = x[ok], y[ok]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[x], cls[y])), pa.array(np.maximum(cls[x], cls[y])), pa.array(star[y])], ["a", "b", "star"])
    give_back()


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, na, nb, sa, sb) -> (a, b) of those whose signatures allow a link."""
    for batch in batches:
        keep = []
        sa, sb = batch.column("sa"), batch.column("sb")
        for k, bound in enumerate(np.asarray(most(batch.column("na").to_numpy(), batch.column("nb").to_numpy())).tolist()):
            x, y = np.frombuffer(sa[k].as_buffer(), np.uint8), np.frombuffer(sb[k].as_buffer(), np.uint8)
            size = min(len(x), len(y))
            keep.append(int(np.bitwise_count((folded(x, size) ^ folded(y, size)).view(np.uint64)).sum()) <= bound)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    give_back()


def close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their signatures do not rule out."""
    a = classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_close, "a long, b long")


def _bitmap(classes: DataFrame) -> bytes:
    slot = F.shiftrightunsigned("class", 64 - BITS)
    words = classes.select(F.floor(slot / 64).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(class, {64 - BITS}) % 64 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    out = np.zeros((1 << BITS) // 64, "<i8")
    out[np.asarray(words.column("at"))] = np.asarray(words.column("word"))
    return out.tobytes()


def marked(bitmap: bytes, c: int) -> int:
    """Whether the bit of a class is set."""
    slot = (c & (1 << 64) - 1) >> (64 - BITS)
    return bitmap[slot >> 3] >> (slot & 7) & 1


def _sets(bitmap: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, ends, data in utf8_blocks(batches):
            cs, ss = [], []
            for s in shingle_sets(data, ends):
                if len(s) and (c := class_of(s)) not in seen and marked(bitmap, c):
                    seen.add(c)
                    cs.append(c)
                    ss.append(s.tobytes())
            if cs:
                yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(ss, pa.binary())], ["class", "elements"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, elements) sorted by a, b: b null holds a's own set and comes first."""
    lead, own = None, None
    for batch in batches:
        a_out, b_out = [], []
        col = batch.column("elements")
        for k, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
            s = np.frombuffer(col[k].as_buffer(), np.uint64)
            if b is None:
                lead, own = a, s
            elif a == lead:
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= PERCENT * (len(own) + len(s) - both):
                    a_out.append(a)
                    b_out.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])
    give_back()


def fetch(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, elements): the sets of the given classes."""
    found = docs.select("text").mapInArrow(_sets(_bitmap(classes)), "class long, elements binary")
    return cut(found.join(classes, "class", "left_semi").groupBy("class").agg(F.first("elements").alias("elements")), "sets")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole sets."""
    # the pairs of a lead with many are dealt to several tasks, and its set to each of them; sets are fetched once that is settled
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEAD).cast("int").alias("salts")).where("salts > 1")
    salts = F.coalesce("salts", F.lit(1))
    dealt = pairs.join(many, "a", "left").select(F.col("b").alias("class"), "a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    given = pairs.select("a").distinct().join(many, "a", "left").select(F.col("a").alias("class"), "a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    both = together(dealt.unionByName(given).join(sets, "class"), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return both.select("a", "b", "elements").mapInArrow(_verify, "a long, b long")


def candidates(counted: DataFrame, classes: DataFrame, few: int = SHARED) -> DataFrame:
    """counted(a, b, keys) -> pairs with enough keys in common (at most `few` are asked for) and sizes that allow a link."""
    sized = counted.join(classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("least").alias("la"), F.col("alone").alias("va"), F.col("whole").alias("wa")), "a").join(classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("least").alias("lb"), F.col("alone").alias("vb"), F.col("whole").alias("wb")), "b")
    least = f"cast(ceil({PERCENT} * (na + nb) / {100 + PERCENT}) as bigint)"
    a, b = f"va <= na - {least}", f"vb <= nb - {least}"
    return sized.where(f"va < 0 OR vb < 0 OR CASE WHEN wa AND wb THEN {a} AND {b} AND va + vb <= na + nb - 2 * {least} WHEN wa THEN {b} WHEN wb THEN {a} ELSE {a} OR {b} END").where((100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")) & (F.col("keys") >= F.least("la", "lb", F.lit(few)))).select("a", "b")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components."""
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def join(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id reachable by links), class, root (the same for
    classes; null without a set)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    seed, texts = 0, docs.select("text")
    first = cut(docs.select("doc_id", "text").mapInArrow(_classes(seed), _CLASSES), "classes")
    base = cut(first.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class"), "base")
    elements = base.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), elements // BUCKET)
    while True:
        often = first.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "id").limit(TOLD).toArrow()
        told = np.asarray(often.column("id")).view(np.uint64)
        order = np.argsort(told)
        told, cost = told[order], np.log2(np.maximum(np.asarray(often.column("n")), 1)).astype(np.int8)[order]
        index = texts.mapInArrow(_index(seed, told, cost, buckets), "bucket int, keys binary, classes binary, note boolean")
        table = cut(together(index, "bucket").sortWithinPartitions("bucket").mapInArrow(_grouped, "key long, class long, lead long"), "groups")
        if not table.where("key = 0").take(1):
            break
        seed += 1
        discard(first, table)
        first = cut(docs.select("doc_id", "text").mapInArrow(_classes(seed), _CLASSES), "classes")
    del index
    sized = first.where("kind = 0 AND n > 0").groupBy("class").agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.max("least").alias("least"), F.first("sig", True).alias("sig"), F.first("brief", True).alias("brief"))
    # elements that no other set has, where they are known; -1 elsewhere
    groups = table.where(F.col("key") != NOTE)
    one = F.when(F.col("key") == NOTE, 0).otherwise((F.col("key").bitwiseAND(F.lit(3)) == 3).cast("int"))
    met = table.groupBy("class").agg(F.max(F.when(F.col("key") == NOTE, F.col("lead"))).alias("rare"), F.sum(one).alias("met"))
    rare = F.coalesce("rare", F.lit(-1))
    alone = F.when(rare == -1, F.lit(-1)).otherwise(F.when(rare >= 0, rare).otherwise(-2 - rare) - F.col("met")).cast("long")
    spare = F.expr(f"n - cast(ceil({PERCENT} * (n + ceil({PERCENT} * n / 100)) / {100 + PERCENT}) as bigint)")
    classes = cut(sized.join(met, "class", "left").withColumn("alone", alone).withColumn("viable", F.col("alone") <= spare).withColumn("whole", rare >= 0).drop("met", "rare"), "viable")
    del sized, met
    discard(first)
    tidy(spark)
    slim(spark)
    # only some of a pair's keys have it with their lead: that fewer than SHARED are counted here does not rule it out
    led = groups.where("class <> lead").groupBy(F.col("lead").alias("a"), F.col("class").alias("b")).agg(F.count(F.lit(1)).alias("keys"))
    pairs = cut(close(candidates(led, classes, 3).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), classes), "pairs")
    # keys of many classes: a star and chains through them join most of a large group before all its pairs are looked at
    turn = F.shiftright("key", 2).bitwiseAND(F.lit(7))
    dealt = groups.select("key", "class").where(turn < STARS + CHAINS)
    crowded = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= CROWD).select("key")
    rows = dealt.join(crowded, "key", "left_semi").join(classes.where("viable").select("class", "n", "alone", "brief"), "class")
    rows = rows.select("key", (turn < STARS).alias("star"), F.when(turn < STARS, F.col("alone")).otherwise(F.xxhash64("key", "class")).alias("turn"), "class", "n", "brief")
    chained = together(rows, "key").sortWithinPartitions("key", "turn", "class").mapInArrow(_chained, "a long, b long, star boolean").groupBy("a", "b").agg(F.max("star").alias("star"))
    hot = cut(chained.join(pairs, ["a", "b"], "left_anti"), "hot")
    near = cut(close(hot, classes).join(hot, ["a", "b"]), "close")
    del led, dealt, crowded, rows, chained
    discard(hot)
    tidy(spark)
    sets = fetch(ends_of(pairs.unionByName(near.select("a", "b"))), docs)
    starred = pairs.unionByName(near.where("star").select("a", "b"))
    tidy(spark)
    linked = cut(verify(starred, sets), "linked")
    tidy(spark)
    roots = components(linked)
    discard(linked)
    chain = cut(apart(near.where("NOT star").select("a", "b"), roots), "chain")
    looked = cut(starred.unionByName(chain), "looked")
    linked = cut(verify(chain, sets), "linked")
    discard(sets, pairs, near, chain)
    del starred
    tidy(spark)
    roots = extend(roots, linked)
    discard(linked)
    tidy(spark)
    slim(spark)
    labelled = groups.select("key", "class").join(classes.select("class", "n", "alone", "viable", "whole", "brief"), "class").join(roots, F.col("class") == F.col("node"), "left").select("key", F.coalesce("root", "class").alias("root"), "class", "n", "alone", "viable", "whole", "brief")
    several = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("viable").alias("any")).where("lo <> hi AND any").select("key")
    open_ = together(labelled.join(several, "key", "left_semi"), "key").sortWithinPartitions("key", "n", "class")
    counted = open_.mapInArrow(_rest, "a long, b long, keys long").groupBy("a", "b").agg(F.sum("keys").alias("keys"))
    rest = cut(close(candidates(counted, classes).join(looked, ["a", "b"], "left_anti"), classes), "rest")
    del labelled, several, open_, counted
    discard(table, looked)
    tidy(spark)
    if rest.take(1):
        sets = fetch(ends_of(rest), docs)
        tidy(spark)
        linked = cut(verify(rest, sets), "linked")
        discard(sets)
        roots = extend(roots, linked)
        discard(linked)
    discard(rest)
    # the smallest doc_id of every component of two classes or more
    named = cut(classes.select("class", "doc").join(roots, F.col("class") == F.col("node"), "left").select("class", "doc", "root"), "named")
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("least"))
    joined = named.where("root IS NOT NULL").join(least, "root").select("class", "root", F.col("least").alias("component_id"))
    of_class = cut(joined.unionByName(named.where("root IS NULL").select("class", F.col("class").alias("root"), F.col("doc").alias("component_id"))), "components")
    discard(classes, named)
    tidy(spark)
    return base.join(of_class, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class", "root")


def _with_class(text: str, names: list[str]):
    """Rows, and the class of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends, data in utf8_blocks(batches, text):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([class_of(s) for s in shingle_sets(data, ends)], pa.int64())], names)

    return run


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest doc_id (nulls last); where several rows have that
    doc_id, that of the least class, then text. Documents without a set all stay."""
    names = docs.columns
    rows = cut(join(docs), "rows")
    times = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    alone = times.where("times = 1 AND doc_id IS NOT NULL").select("doc_id")
    first = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("x")).select("x.doc_id", "x.class")
    kept = first.select("doc_id").unionByName(rows.where("root IS NULL").select("doc_id"))
    (own,) = unused(names, "own")
    ids = kept.join(alone, "doc_id", "left_semi").select(F.col("doc_id").alias(own))
    out = docs.join(ids, docs["doc_id"] == ids[own], "left_semi")
    # rows whose doc_id does not name one row alone: few, and told apart by their class
    again = cut(times.where("times > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(own)), "again")
    if not again.take(1):
        return out
    plain = [f"c{k}" for k in range(len(names))]
    id_, text = plain[names.index("doc_id")], plain[names.index("text")]
    both = docs.join(again, docs["doc_id"].eqNullSafe(again[own]), "left_semi").toDF(*plain)
    both = both.mapInArrow(_with_class(text, [*plain, "class"]), StructType([*both.schema.fields, StructField("class", LongType())]))
    mine = both.join(first, both[id_].eqNullSafe(first["doc_id"]) & (both["class"] == first["class"]), "left_semi")
    one = mine.groupBy(id_, "class").agg(F.min_by(F.struct(*plain), F.col(text)).alias("x")).select(*[F.col(f"x.{c}").alias(n) for c, n in zip(plain, names, strict=True)])
    return out.unionByName(one).unionByName(both.where("class = 0").select(*plain).toDF(*names))
