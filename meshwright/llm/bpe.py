"""BPE encoding and decoding with content-defined chunk reuse (operator 7).

A rolling hash over the UTF-8 bytes cuts every text into chunks at places that depend on nearby bytes only, so passages that
documents share become the same chunks and are encoded once per worker. A cut may fall inside a word: the joint (what lies
between the last white space of one chunk and the first of the next) is encoded anew, and widened by a word on either side
until encoding it with its neighbours agrees with encoding the three apart. Inside a new chunk, words are encoded once too.

Reuse is per worker, over its tasks, with tables of two generations: what is met again moves to the newer one, and the older one is
dropped when that is full. Encoding each chunk once in the whole corpus would take a shuffle of all their codes, about as
many bytes as the texts. The vocabulary file's path is a parameter; every machine has it.

Edge cases: null and empty texts have no tokens and decode to the empty text; texts without white space are one joint; other
columns are ignored, texts of any length and script are cut at white space only, repeated rows give repeated rows and an empty table an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from meshwright.llm.common import HELD, arrow_batches, mix64, utf8_blocks

#: A cut follows a byte whose window hash has these bits clear: about one in 2048.
CUT_BITS = 11
WINDOW = 16
#: What a generation of the tables holds: words, chunks and joints.
WORDS, CHUNKS, JOINTS = 100_000, 4_000, 20_000
_SPACE = b" \t\n\r\x0b\x0c"
#: A pre-tokenizer that parts letters from what follows them, and what may follow: no apostrophe, as 's and the like are pieces.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACE)] = True


def rolling(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Polynomial hash (wrapping) of the `window` bytes that end at each byte; window is a power of two."""
    h, base, width = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    while width < window:
        step = h.copy()
        step[width:] += h[:-width] * base
        h, base, width = step, np.uint64(int(base) ** 2 & (1 << 64) - 1), width * 2
    return mix64(h)


def _parts(tok) -> bool:
    """Whether letters and the marks behind them are encoded apart, whatever they are: by the published rules, no others are looked into."""
    told = json.loads(tok.to_str())
    rules, before = told["pre_tokenizer"] or {}, told["normalizer"] or {}
    rules, before = rules.get("pretokenizers", [rules]), before.get("normalizers", [before])
    split = {"type": "Split", "pattern": {"Regex": _PARTS}, "behavior": "Removed", "invert": True}
    bytes_ = all(x.get("type") == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in rules[1:])
    even = all(x.get("type") in (None, "NFC", "Lowercase") or x.get("type") == "Replace" and x["pattern"] == {"Regex": r"\s+"} for x in before)
    # a word of letters and marks behind them holds no added token
    added = all(re.search("[A-Za-z0-9].*[^A-Za-z0-9]$", x["content"]) and not x["content"][0].isalpha() for x in told["added_tokens"])
    return bool(rules) and rules[0] == split and bytes_ and even and added


class Codec:
    """A tokenizers vocabulary with tables of words and chunks already encoded."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.plain = self.tok.decoder is None
        size = self.tok.get_vocab_size(with_added_tokens=True)
        names = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.names, self.texts = [x.encode() for x in names], [str(i).encode() for i in range(size)]
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.last = np.array([x.endswith(suffix) for x in names]) if suffix else None
        special = [(x.content.encode(), i) for i, x in self.tok.get_added_tokens_decoder().items() if x.special]
        self.mark_text, self.mark = special[-1] if special else (b"", None)
        self.parted = self.plain and self.last is not None and _parts(self.tok)
        self.tails: dict[bytes, tuple[bytes, bytes]] = {}
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.words_before: dict[bytes, tuple[bytes, bytes]] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}  # by 128-bit digests
        self.chunks_before: dict[bytes, tuple[bytes, bytes]] = {}
        self.agreed: set[tuple[bytes, int, int]] = set()
        self.encoded = self.reused = 0
        if self._ids(b"a1 b's, c") != sum((self._ids(w) for w in (b"a1", b"b's,", b"c")), []):
            raise ValueError("this vocabulary joins words across white space")

    def _ids(self, piece: bytes) -> list[int]:
        return self.tok.encode(piece.decode("utf-8"), add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)

    def learn(self, words: set[bytes]) -> None:
        """Encode words not seen yet, many in one call. Words of letters alone stand behind each other, as each is one run of tokens
        up to one that ends a word; others have a special token between them that no word holds."""
        if len(self.words) > WORDS:
            self.words_before, self.words = self.words, {}
        new = []
        for w in words:
            if w not in self.words:
                if (had := self.words_before.get(w)) is not None:
                    self.words[w] = had
                else:
                    new.append(w)
        if self.last is not None:
            self._learn_letters([w for w in new if w.isalpha()], self.words)
        if self.parted:
            self._learn_marked([w for w in new if not w.isalpha()])
        plain = [w for w in new if w not in self.words and self.mark is not None and self.mark_text not in w]
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            flat = self._many(self.mark_text.join(part))
            stops = [i for i, x in enumerate(flat) if x == self.mark]
            if len(stops) == len(part) - 1:
                self._keep(part, flat, [0, *(i + 1 for i in stops)], [*stops, len(flat)])
        for w in new:
            if w not in self.words:
                ids = self._ids(w)
                self._keep([w], ids, [0], [len(ids)])

    def _learn_letters(self, letters: list[bytes], into: dict[bytes, tuple[bytes, bytes]]) -> None:
        for k in range(0, len(letters), 4096):
            part = letters[k : k + 4096]
            flat = self._many(b" ".join(part))
            stops = np.flatnonzero(self.last[flat]) + 1 if flat else np.zeros(0, int)
            if len(stops) == len(part) and stops[-1] == len(flat):
                self._keep(part, flat, [0, *stops[:-1].tolist()], stops.tolist(), into)

    def _learn_marked(self, words: list[bytes]) -> None:
        """Of these words, enter those of letters and one or two marks behind them; letters that are no word yet are not entered."""
        ended = [(w, x) for w in words if 0 < len(w) - len(x := w.rstrip(_MARKS)) < 3 and x.isalpha()]
        cores: dict[bytes, tuple[bytes, bytes]] = {}
        self._learn_letters(list({x for _, x in ended if x not in self.words}), cores)
        for w, x in ended:
            core = self.words.get(x) or cores.get(x)
            if core is not None:
                tail = self.tails.get(w[len(x) :])
                if tail is None:
                    ids = self._ids(w[len(x) :])
                    self._keep([w[len(x) :]], ids, [0], [len(ids)], self.tails)
                    tail = self.tails[w[len(x) :]]
                self.words[w] = core[0] + b" " + tail[0], core[1] + b" " + tail[1]

    def _many(self, joined: bytes) -> list[int]:
        return self.tok.encode_batch_fast([joined.decode("utf-8")], add_special_tokens=False)[0].ids

    def learn_block(self, data: np.ndarray, ends: np.ndarray, cuts: list[tuple[list[int], list[int], list[int]]]) -> None:
        """Encode the words of a block that are in chunks not met yet, or outside of chunks."""
        words: set[bytes] = set()
        for a, b, (_, firsts, lasts) in zip(ends[:-1].tolist(), ends[1:].tolist(), cuts, strict=True):
            text, done = data[a:b].tobytes(), 0
            for low, high in zip(lasts, firsts, strict=True):
                if low > done:
                    if not self._met(piece := text[done:low]):
                        words.update(piece.split())
                    words.update(text[low:high].split())
                    done = high
            if not self._met(piece := text[done:]):
                words.update(piece.split())
        self.learn(words)

    def _met(self, piece: bytes) -> bool:
        key = xxhash.xxh3_128_digest(piece)
        return key in self.chunks or key in self.chunks_before

    def _keep(self, words: list[bytes], flat: list[int], starts: list[int], stops: list[int], into: dict[bytes, tuple[bytes, bytes]] | None = None) -> None:
        """Enter words, whose ids are pieces of flat."""
        into = self.words if into is None else into
        texts, names = [self.texts[i] for i in flat], [self.names[i] for i in flat]
        if self.plain:
            into.update([(w, (b" ".join(texts[a:b]), b" ".join(names[a:b]))) for w, a, b in zip(words, starts, stops, strict=True)])
        else:
            into.update([(w, (b" ".join(texts[a:b]), self.decode(flat[a:b]).encode())) for w, a, b in zip(words, starts, stops, strict=True)])

    def _piece(self, piece: bytes) -> tuple[bytes, bytes]:
        """(ids, decoded text) of bytes between white space, both joined by spaces."""
        words = piece.split()
        get = self.words.__getitem__
        try:
            got = list(map(get, words))
        except KeyError:
            self.learn(set(words))
            got = list(map(self.words.__getitem__, words))
        return _joined(got)

    def _chunk(self, piece: bytes) -> tuple[bytes, bytes]:
        key = xxhash.xxh3_128_digest(piece)
        had = self.chunks.get(key)
        if had is None:
            if len(self.chunks) > CHUNKS:
                self.chunks_before, self.chunks = self.chunks, {}
            had = self.chunks_before.get(key)
            if had is None:
                self.encoded += 1
                self.chunks[key] = had = self._piece(piece)
                return had
            self.chunks[key] = had
        self.reused += 1
        return had

    def _joint(self, text: bytes, a: int, b: int) -> tuple[int, int]:
        """Widen [a, b) until encoding it with a word on either side agrees with the codes of the parts."""
        while True:
            left, right = _word_before(text, a), _word_after(text, b)
            known = (text[left:right], a - left, b - left)
            if known in self.agreed:
                return a, b
            apart = _joined([self._piece(text[x:y]) for x, y in ((left, a), (a, b), (b, right))])[0]
            if b" ".join([self.texts[i] for i in self._ids(known[0])]) == apart:
                if len(self.agreed) > JOINTS:
                    self.agreed.clear()
                if right - left <= 256:
                    self.agreed.add(known)
                return a, b
            a, b = left, right

    def encode(self, text: bytes, cuts: list[int], firsts: list[int], lasts: list[int]) -> tuple[bytes, bytes]:
        """cuts: chunk starts after the first; firsts, lasts: first white space at or after each cut, last one before it."""
        spans, done = [], 0  # (start, stop, whether a chunk)
        for a, b in zip(lasts, firsts, strict=True):
            if a <= done:  # no white space since the last joint: this cut is inside it
                continue
            a, b = self._joint(text, a, b)
            while a < done:  # widened into what came before: a joint there is one with this one, a chunk ends earlier
                done, _, chunk = spans.pop()
                a, b = self._joint(text, a if chunk else min(a, done), b)
            if a > done:
                spans.append((done, a, True))
            spans.append((a, b, False))
            done = b
        if done < len(text):
            spans.append((done, len(text), True))
        out = [self._chunk(text[a:b]) if chunk else self._piece(text[a:b]) for a, b, chunk in spans]
        return _joined(out)


def _joined(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """ids and decoded texts of parts that white space divides; those without tokens are left out."""
    if not parts:
        return b"", b""
    ids, back = zip(*parts, strict=True)
    return b" ".join(filter(None, ids) if b"" in ids else ids), b" ".join(filter(None, back) if b"" in back else back)


def _word_before(text: bytes, at: int) -> int:
    reach = 256
    while True:
        low = max(0, at - reach)
        head = text[low:at].rstrip(_SPACE)
        space = max(head.rfind(s) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if space >= 0 or low == 0:
            return low + space + 1 if head else at
        reach *= 2


def _word_after(text: bytes, at: int) -> int:
    reach = 256
    while True:
        tail = text[at : at + reach]
        body = tail.lstrip(_SPACE)
        stop = len(tail) - len(body) + len(body.split(None, 1)[0]) if body else len(tail)
        if stop < len(tail) or at + len(tail) == len(text):
            return at + stop if body else at
        reach *= 2


def place_cuts(data: np.ndarray, ends: np.ndarray) -> list[tuple[list[int], list[int], list[int]]]:
    """For each text of a block: cuts, and the white space after and before each. Hash windows that reach into an earlier
    text are not used."""
    n, hits = len(data), np.flatnonzero((rolling(data) & np.uint64((1 << CUT_BITS) - 1)) == 0) + 1 if len(data) else np.zeros(0, np.int64)
    spaces = np.flatnonzero(_IS_SPACE[data])
    doc = np.searchsorted(ends, hits, "right") - 1
    keep = (hits < n) & (doc < len(ends) - 1)
    hits, doc = hits[keep], doc[keep]
    hits_in = hits - ends[doc]
    after, before = np.searchsorted(spaces, hits), np.searchsorted(spaces, hits) - 1
    ok = (hits_in >= WINDOW) & (before >= 0) & (after < len(spaces))
    hits, doc, after, before = hits[ok], doc[ok], spaces[after[ok]], spaces[before[ok]]
    ok = (before >= ends[doc]) & (after < ends[doc + 1])
    hits, doc, after, before = hits[ok], doc[ok], after[ok], before[ok]
    base, first = ends[doc], np.searchsorted(doc, np.arange(len(ends)))
    cuts, firsts, lasts = ((x - base).tolist() for x in (hits, after, before))
    return [(cuts[a:b], firsts[a:b], lasts[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


_codecs: dict[str, Codec] = {}
HELD.append(_codecs)


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of text, with the codecs kept from task to task."""
    return utf8_blocks(batches, held=_codecs)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> n_tokens and digests of the ids and of the decoded text."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for rows, ends, data in _blocks(batches):
            counts, ids, back = [], [], []
            cuts = place_cuts(data, ends)
            own.learn_block(data, ends, cuts)
            for (a, b), where in zip(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), cuts, strict=True):
                x, y = own.encode(data[a:b].tobytes(), *where)
                counts.append(x.count(b" ") + 1 if x else 0)
                ids.append(hashlib.sha256(x).hexdigest())
                back.append(hashlib.sha256(y).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids array<int>, decoded string."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for rows, ends, data in _blocks(batches):
            cuts = place_cuts(data, ends)
            own.learn_block(data, ends, cuts)
            got = [own.encode(data[a:b].tobytes(), *where) for (a, b), where in zip(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), cuts, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array([list(map(int, x.split())) for x, _ in got], pa.list_(pa.int32())), pa.array([y.decode() for _, y in got], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
