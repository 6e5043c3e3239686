"""Personal data and information-theoretic sanitisation (operator 3).

Base findings (e-mail, IP address, payment card, phone) are found in every text. Their values are the protected entities. Corpus
co-occurrence says how much a term gives away of an entity that it shares documents with: with counts over all documents,
PMI(t, e) = log2(N df(t, e) / (df(t) df(e))), where df(t) counts one document more than were seen (what one document alone says is
uncertain), against the information of the entity itself, IC(e) = log2(N / df(e)). A term of
which PMI reaches `general` of IC(e) is generalised wherever it stands in a document with e, from `remove` on it is removed. It is
generalised to the longest of its `PREFIXES` that is in too many documents to disclose any entity of the document, as postal
codes are to their first digits, and to <TERM> where there is none.

Context is the whole document. As df(t, e) <= df(e), only terms of up to N (df(e) / N) ** general documents can disclose e; all
others are left out before pairs are counted. Of an entity of one document df(t, e) is 1 for all terms there, and nothing is
counted in pairs. Terms and entities are known by 64-bit hashes.

Edge cases: null texts are empty; offsets are code points of whole texts; kinds may overlap; copies of a document count as
documents; repeated rows keep rows of their own; an empty table gives an empty result; an entity of every document has no
information to give away; long texts are read whole; `scan` ignores extra columns, `sanitise` keeps all columns, whatever their
names, and all rows; a null text stays null there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from meshwright.llm.common import arrow_batches, cut, give_back, prefix_ends, utf8_blocks, word_hashes

KINDS = ("email", "ip", "card", "phone", "term")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GENERAL, REMOVE = 0.75, 0.95
#: Bytes of the prefixes that terms are generalised to, and the least length of a term.
PREFIXES, SHORTEST = (5, 3, 1), 3
#: Words that a task counts before it gives their counts away.
HELD_WORDS = 1_000_000
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out, done = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            at = m.start()
            a = at
            while a > done and (c := LOCAL.search(text, max(done, a - 64), a)):
                a = c.start()
                if a > max(done, c.end() - 64):
                    break
            if a < at:
                out.append((0, a, m.end()))
                done = m.end()
    out += [(1, *m.span()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in spans])


def read_spans(base: str) -> list[tuple[int, int, int]]:
    return [(KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in base.split(","))] if base else []


_FOUND = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, entities array<long>"


def _find(kept: list[str], all_rows: bool):
    """Rows -> what `_FOUND` says, and the columns c0, c1, ... named in `kept`; of rows without findings only if all_rows."""
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [t or "" for t in batch.column(kept[0]).to_pylist()]
            spans = [base_spans(t) for t in texts]
            entities = [sorted({xxhash.xxh64_intdigest(f"{k}:{t[a:b]}") - (1 << 63) for k, a, b in s}) if s else None for t, s in zip(texts, spans, strict=True)]
            counts = [pa.array([sum(x[0] == k for x in s) for s in spans], pa.int64()) for k in range(4)]
            base = [written(s) for s in spans]
            rest = [batch.column(c) for c in kept]
            if not all_rows:
                none = pa.array([not s for s in spans])
                rest = [pc.if_else(none, pa.scalar(None, c.type), c) for c in rest]
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(texts)), pa.int64()), batch.column("doc_id").cast(pa.int64()), *counts, pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.int64())), *rest], names + kept)
            row += len(texts)
        give_back()

    return run


def words(data: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Terms of a block: starts, stops, hashes and hashes of prefixes of the runs of letters that are long enough and touch no digit."""
    starts, stops, *hashes = word_hashes(data, ends, _LETTERS, prefixes)
    around = np.concatenate([[False], (data >= 48) & (data <= 57), [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    good = (stops - starts >= SHORTEST) & ~(around[starts] & ~edge[starts]) & ~(around[stops + 1] & ~edge[stops])
    return [x[good] for x in (starts, stops, *hashes)]


def _distinct(ends: np.ndarray, starts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and hashes of the different words of each text."""
    doc = np.searchsorted(ends, starts, "right") - 1
    _, first = np.unique(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
    return doc[first], h[first]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (term, n): of how many of a task's texts words and prefixes are."""
    held: list[np.ndarray] = []
    size = 0

    def give() -> pa.RecordBatch:
        term, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n, pa.int64())], ["term", "n"])

    for _, ends, data in utf8_blocks(batches):
        starts, _, *hashes = words(data, ends, PREFIXES)
        for h in hashes:
            held.append(_distinct(ends, starts, h)[1])
            size += len(held[-1])
        if size > HELD_WORDS:
            yield give()
            size = 0
    yield give()


def _masked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows with text c0 and base -> with findings blanked out, so that no term overlaps one."""
    texts = []
    for text, base in zip(batch.column("c0").to_pylist(), batch.column("base").to_pylist(), strict=True):
        parts, done = [], 0
        for _, a, b in sorted(read_spans(base), key=lambda x: x[1]):
            parts += [text[done:a], " " * (b - max(a, done))]
            done = max(done, b)
        texts.append("".join([*parts, text[done:]]))
    return batch.set_column(batch.schema.get_field_index("c0"), "c0", pa.array(texts, pa.string()))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with findings -> (row, term): the different terms of each."""
    for rows, ends, data in utf8_blocks(map(_masked, batches), "c0"):
        starts, _, h = words(data, ends)
        doc, term = _distinct(ends, starts, h)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(rows.column("row"))[doc]), pa.array(term.view(np.int64))], ["row", "term"])


def disclosing(found: DataFrame, counts: DataFrame, general: float = GENERAL) -> DataFrame:
    """found: what `_find` gives, counts(term, of_term) -> (row, terms array<(term, share, most)>): the terms that give away an entity
    of the row, with the largest PMI / IC; most: of how many documents a term can be that discloses any entity of the row."""
    total = float(max(1, found.count()))
    hit = found.where("entities IS NOT NULL")
    near = hit.select("row", F.explode("entities").alias("entity"))
    often = cut(near.groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity")).where(F.col("of_entity") < total).withColumn("most", F.lit(total) * F.pow(F.col("of_entity") / total, F.lit(general)) * (1 + 1e-9)), "entities")
    most = often.agg(F.max("most")).first()[0]
    none = "row long, terms array<struct<term:long,share:double,most:double>>"
    if most is None:
        return found.sparkSession.createDataFrame([], none)
    here = hit.select("row", "c0", "base").mapInArrow(_terms, "row long, term long").join(counts.where(F.col("of_term") <= most), "term")
    with_entity = cut(near.join(often, "entity"), "with-entity")
    limits = with_entity.groupBy("row").agg(F.max("most").alias("most"), F.min("of_entity").alias("least"))
    rare = cut(here.join(limits, "row").where("of_term <= most"), "rare")
    # an entity of one document: each of its terms is with it once
    alone = rare.where("least = 1").select("row", "term", (1 - F.log2("of_term") / F.lit(np.log2(total))).alias("share"))
    both = rare.select("row", "term", "of_term").join(with_entity.where("of_entity > 1"), "row").where("of_term <= most").select("row", "term", "entity", "of_term", "of_entity")
    ic, pmi = F.log2(F.lit(total) / F.col("of_entity")), F.log2(F.lit(total) * F.col("both") / (F.col("of_term") * F.col("of_entity")))
    shares = both.groupBy("entity", "term", "of_entity", "of_term").agg(F.count(F.lit(1)).alias("both")).select("entity", "term", (pmi / ic).alias("share")).where(F.col("share") >= general)
    every = alone.where(F.col("share") >= general).unionByName(both.select("row", "entity", "term").join(shares, ["entity", "term"]).select("row", "term", "share"))
    worst = every.groupBy("row", "term").agg(F.max("share").alias("share")).join(limits.select("row", "most"), "row")
    return worst.groupBy("row").agg(F.collect_list(F.struct("term", "share", "most")).alias("terms"))


_HITS = pa.list_(pa.struct([("at", pa.int32()), ("stop", pa.int32()), ("share", pa.float64()), ("keep", pa.list_(pa.int32())), ("prefixes", pa.list_(pa.int64())), ("most", pa.float64())]))
_PLACED = "row long, hits array<struct<at:int,stop:int,share:double,keep:array<int>,prefixes:array<long>,most:double>>"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with findings and terms -> (row, hits): where the terms stand, in code points, and what prefixes they have."""
    for rows, ends, data in utf8_blocks(map(_masked, batches), "c0"):
        starts, stops, h, *prefixes = words(data, ends, PREFIXES)
        cuts = [prefix_ends(data, starts, stops, k) for k in PREFIXES]
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first = np.searchsorted(starts, ends)
        out = []
        for k, terms in enumerate(rows.column("terms").to_pylist()):
            known = {x["term"]: x for x in terms}
            own = np.arange(first[k], first[k + 1])
            own = own[np.isin(h[own].view(np.int64), np.array(list(known), np.int64))]
            zero, hits = points[ends[k]], []
            for i in own.tolist():
                x = known[int(h[i].view(np.int64))]
                hits.append({"at": int(points[starts[i]] - zero), "stop": int(points[stops[i]] - zero), "share": x["share"], "most": x["most"], "keep": [int(points[c[i]] - points[starts[i]]) for c in cuts], "prefixes": [int(p[i].view(np.int64)) for p in prefixes]})
            out.append(hits)
        yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(out, _HITS)], ["row", "hits"])


def found_and_terms(docs: DataFrame, kept: list[str], all_rows: bool, general: float = GENERAL) -> tuple[DataFrame, DataFrame]:
    """(found, hits): findings of each row with columns c0 (the text), c1, ... of `kept`; hits(row, at, stop, share, keep): terms that
    disclose, and how many characters stay if they are generalised."""
    arrow_batches(docs.sparkSession)
    plain = [f"c{k}" for k in range(len(kept))]
    schema = StructType.fromDDL(_FOUND)
    for c, name in zip(plain, kept, strict=True):
        schema = schema.add(c, docs.schema[name].dataType)
    found = cut(docs.select("doc_id", *[docs[n].alias(c) for c, n in zip(plain, kept, strict=True)]).mapInArrow(_find(plain, all_rows), schema), "found")
    counts = cut(docs.select("text").mapInArrow(_count, "term long, n long").groupBy("term").agg((F.sum("n") + 1).alias("of_term")), "terms")
    bad = disclosing(found, counts, general)
    rows = found.where("entities IS NOT NULL").select("row", "c0", "base").join(bad, "row").mapInArrow(_place, _PLACED)
    hits = cut(rows.select("row", F.explode("hits").alias("x")).select("row", "x.*"), "hits")
    # the longest prefix that is in more documents than a term that discloses can be
    each = hits.select("prefixes", "most").distinct().select("prefixes", "most", F.posexplode("prefixes").alias("level", "term"))
    safe = each.join(counts, "term").where("of_term > most").groupBy("prefixes", "most").agg(F.min("level").alias("level"))
    keep = F.coalesce(F.element_at("keep", F.col("level") + 1), F.lit(0))
    return found, hits.join(safe, ["prefixes", "most"], "left").select("row", "at", "stop", "share", keep.alias("keep"))


def scan(docs: DataFrame, general: float = GENERAL, remove: float = REMOVE) -> DataFrame:
    """docs(doc_id, text) -> counts, digest of the base spans, all spans, how many terms are generalised and removed, and how many
    spans there are."""
    found, hits = found_and_terms(docs.select("doc_id", "text"), ["text"], False, general)
    of_row = hits.groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "stop"))), lambda x: F.concat(F.lit("term:"), x["at"], F.lit(":"), x["stop"])), ",").alias("terms"),
        F.sum(F.when(F.col("share") < remove, 1).otherwise(0)).alias("n_generalised"), F.sum(F.when(F.col("share") >= remove, 1).otherwise(0)).alias("n_removed"),
    )
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    whole = sum((F.coalesce(c, F.lit(0)) for c in ("n_email", "n_ip", "n_card", "n_phone", "n_generalised", "n_removed")), F.lit(0)).cast("long").alias("n_spans")
    return found.drop("c0").join(of_row, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), zero("n_generalised"), zero("n_removed"), whole)


def rewrite(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, float, int]], remove: float = REMOVE) -> str:
    """The text with findings replaced by their kind, and terms (start, end, share, characters to keep) generalised or taken out."""
    edits = [(a, b, f"<{KINDS[k].upper()}>") for k, a, b in base]
    edits += [(a, b, "" if s >= remove else text[a : a + keep] + "*" if keep else "<TERM>") for a, b, s, keep in terms]
    out, done = [], 0
    for a, b, new in sorted(edits):
        if a >= done:
            out += [text[done:a], new]
            done = b
        elif b > done:  # kinds overlap: the rest of the later finding goes too
            done = b
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, general: float = GENERAL, remove: float = REMOVE) -> DataFrame:
    """docs with text rewritten (and n_chars counted anew, if there); every row and column stays."""
    names = docs.columns
    kept = ["text", *[n for n in names if n != "text"]]
    found, hits = found_and_terms(docs, kept, True, general)
    plain = [f"c{k}" for k in range(len(kept))]
    of_row = hits.groupBy("row").agg(F.collect_list(F.struct("at", "stop", "share", "keep")).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [
                rewrite(t, read_spans(base), [(x["at"], x["stop"], x["share"], x["keep"]) for x in terms or ()], remove)
                for t, base, terms in zip(*(batch.column(c).to_pylist() for c in ("c0", "base", "terms")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), *[batch.column(c) for c in plain[1:]]], plain)
        give_back()

    hit = found.where("entities IS NOT NULL").join(of_row, "row", "left").select("base", "terms", *plain)
    shape = StructType([StructField(c, docs.schema[n].dataType) for c, n in zip(plain, kept, strict=True)])
    done = found.where("entities IS NULL").select(*plain).unionByName(hit.mapInArrow(run, shape))
    if "n_chars" in names:
        done = done.withColumn(at := plain[kept.index("n_chars")], F.length("c0").cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(plain[kept.index(n)]).alias(n) for n in names])
