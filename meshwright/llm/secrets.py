"""Secret scans (operator 1): base patterns plus a character convolutional network in numpy.

Base findings (assignments, access keys, hex runs) are always kept. The network reads every run of secret characters of at least
16 with its surrounding context, those in base findings too: its view starts at every character that leaves it full, and the
highest score counts. Runs whose calibrated score reaches a threshold that keeps a set share of the labelled findings of every kind
(with digits, without, longer than the view, of the table itself) are added if base findings do not cover them; `n_confirmed`
counts base findings that hold or touch such a run, `top_score` is the highest score of the document's runs.

It is trained on the driver on labelled findings: of the table itself, base findings against runs of plain letters or of digits (at most
FINDINGS of each, those of least hash), and of fixed rules, a seeded generator that writes secrets of several shapes, with and
without digits, and harmless look-alikes (versions, dates, paths, addresses, numbers, words) into context, and secrets behind paths
into longer runs. Of each eight findings six fit, one calibrates and one sets the threshold.

Edge cases: a null text is empty; offsets are code points of the whole text, however long; overlapping kinds are all reported;
repeated rows give repeated rows, an empty table an empty result, and extra columns are ignored; a null doc_id stays null; a
table without findings leaves those of the generator.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from meshwright.llm.common import arrow_batches, cut

KINDS = ("assign", "access", "hex", "net")
_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_NAMES = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")

#: Alphabet of the network: characters outside of it share one place.
ALPHABET = string.ascii_letters + string.digits + "+/_.=-:\"' \n,;@()<>#$%&!?"
BEFORE, INSIDE, AFTER = 24, 40, 8
WIDTH, FILTERS, TAPS, DIM = BEFORE + INSIDE + AFTER, 24, 5, 8
#: Findings of the table to train on, of each label at most.
FINDINGS = 1000
#: Runs that no secret looks like.
PLAIN = re.compile(r"[0-9]+|[A-Za-z]?[a-z]+\.?")
#: Share of the held-out labelled findings that the threshold must keep.
RECALL = 0.95
_CODE = np.full(256, len(ALPHABET) + 1, np.int64)
for _k, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _k + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def codes(text: str, a: int, b: int) -> np.ndarray:
    """The network's view: context in front, the candidate from its start, context behind; 0 where there is nothing."""
    row = np.zeros(WIDTH, np.int64)
    for at, part in ((BEFORE - len(p := text[max(0, a - BEFORE) : a]), p), (BEFORE, text[a : min(b, a + INSIDE)]), (BEFORE + INSIDE, text[b : b + AFTER])):
        raw = np.frombuffer(part.encode("latin-1", "replace"), np.uint8)
        row[at : at + len(raw)] = _CODE[raw]
    return row


def spread_codes(text: str, a: int, b: int) -> np.ndarray:
    """A run of INSIDE or more: WIDTH codes from k on are what codes() gives for the INSIDE characters from a + k on."""
    row = np.zeros(BEFORE + b - a + AFTER, np.int64)
    front = text[max(0, a - BEFORE) : a]
    raw = np.frombuffer((front + text[a : b + AFTER]).encode("latin-1", "replace"), np.uint8)
    row[BEFORE - len(front) : BEFORE - len(front) + len(raw)] = _CODE[raw]
    return row


def _highest(h: np.ndarray, width: int, n: int) -> np.ndarray:
    """Maximum of h[k : k + width] for the first n k."""
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.maximum(h[:-step], h[step:])
        have += step
    return h[:n]


class CharNet:
    """Embedding, one convolution with ReLU, maximum over three zones (before, inside, after), logistic output."""

    zones = ((0, BEFORE), (BEFORE, BEFORE + INSIDE), (BEFORE + INSIDE, WIDTH - TAPS + 1))

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.3, (len(ALPHABET) + 2, DIM)), "k": r.normal(0, 0.2, (TAPS * DIM, FILTERS)), "b": np.zeros(FILTERS), "w": r.normal(0, 0.1, 3 * FILTERS), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]
        wide = np.concatenate([e[:, t : WIDTH - TAPS + 1 + t] for t in range(TAPS)], 2)
        h = np.maximum(wide @ self.p["k"] + self.p["b"], 0)
        args = [h[:, a:b].argmax(1) + a for a, b in self.zones]
        pooled = np.concatenate([np.take_along_axis(h, g[:, None], 1)[:, 0] for g in args], 1)
        return wide, pooled, args, pooled @ self.p["w"] + self.p["c"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k : k + 256])[3] for k in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def slide(self, row: np.ndarray, part: int = 8192) -> np.ndarray:
        """Logits of the view at every position of a row of codes; each position is convolved once."""
        out = []
        for k in range(0, len(row) - WIDTH + 1, part):
            x = row[k : k + part + WIDTH - 1]
            e, n = self.p["e"][x], len(x) - WIDTH + 1
            wide = np.concatenate([e[t : len(x) - TAPS + 1 + t] for t in range(TAPS)], 1)
            h = np.maximum(wide @ self.p["k"] + self.p["b"], 0)
            out.append(np.concatenate([_highest(h[a:], b - a, n) for a, b in self.zones], 1) @ self.p["w"] + self.p["c"])
        return np.concatenate(out)

    def runs(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Logit of each run: the highest of all positions of the view."""
        z = np.zeros(len(found))
        short = [k for k, (_, a, b) in enumerate(found) if b - a <= INSIDE]
        for k in range(0, len(short), 4096):
            z[short[k : k + 4096]] = self.logits(np.stack([codes(*found[i]) for i in short[k : k + 4096]]))
        for k, (text, a, b) in enumerate(found):
            if b - a > INSIDE:
                z[k] = self.slide(spread_codes(text, a, b)).max()
        return z

    def sure(self, z: np.ndarray) -> np.ndarray:
        """Calibrated probability of a secret."""
        return 1 / (1 + np.exp(-(self.scale * z + self.shift)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.sure(self.logits(x))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 3) -> None:
        r, m = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for part in np.array_split(r.permutation(len(x)), max(1, len(x) // 64)):
                xs = x[part]
                wide, pooled, args, z = self._forward(xs)
                d = (1 / (1 + np.exp(-z)) - y[part]) / len(part)
                g = {"w": pooled.T @ d, "c": np.array([d.sum()]), "b": np.zeros(FILTERS), "k": np.zeros_like(self.p["k"])}
                dp = d[:, None] * self.p["w"] * (pooled > 0)
                dwide = np.zeros_like(wide)
                rows = np.arange(len(part))
                for zone, at in enumerate(args):
                    dz = dp[:, zone * FILTERS : (zone + 1) * FILTERS]
                    g["b"] += dz.sum(0)
                    for f in range(FILTERS):
                        g["k"][:, f] += wide[rows, at[:, f]].T @ dz[:, f]
                        np.add.at(dwide, (rows, at[:, f]), dz[:, f][:, None] * self.p["k"][:, f])
                g["e"] = np.zeros_like(self.p["e"])
                for t in range(TAPS):
                    np.add.at(g["e"], xs[:, t : WIDTH - TAPS + 1 + t], dwide[:, :, t * DIM : (t + 1) * DIM])
                step += 1
                for k, v in self.p.items():
                    a, b = m[k]
                    a += 0.1 * (g[k] - a)
                    b += 0.001 * (g[k] ** 2 - b)
                    v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on logits of held-out runs."""
        for _ in range(200):
            d = 1 / (1 + np.exp(-(self.scale * z + self.shift))) - y
            self.scale -= 0.1 * float((d * z).mean() + 0.01 * (self.scale - 1))
            self.shift -= 0.1 * float(d.mean())

    def demand(self, z: np.ndarray, group: np.ndarray, recall: float = RECALL) -> None:
        """The threshold is the highest that keeps `recall` of the findings of each group; z: logits of other held-out findings."""
        found = [np.sort(self.sure(z[group == g])) for g in np.unique(group)]
        self.threshold = float(min(p[int((1 - recall) * len(p))] for p in found))


def shapes(r: random.Random):
    """Writers of a word, of secrets and of harmless look-alikes."""
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    up, low, dig = string.ascii_uppercase, string.ascii_lowercase, string.digits
    word = lambda: pick(low, r.randint(2, 9))
    secret = [
        lambda: pick("0123456789abcdef", r.choice((32, 40, 64))), lambda: "AKIA" + pick(up + dig, 16), lambda: "ghp_" + pick(up + low + dig, 36), lambda: "sk_live_" + pick(up + low + dig, 24),
        lambda: pick(up + low + dig + "+/", r.choice((27, 39, 43))) + "=", lambda: "xoxb-" + pick(dig, 11) + "-" + pick(up + low + dig, 24), lambda: "AIza" + pick(up + low + dig + "_-", 35), lambda: pick(up + low + dig, r.randint(20, 44)),
        lambda: pick(up + low, r.randint(20, 44)), lambda: "ghp_" + pick(up + low, 36), lambda: "sk_live_" + pick(up + low, 24), lambda: pick(up + low + "+/", r.choice((27, 39, 43))) + "=",
        lambda: "eyJ" + pick(up + low + dig, 20) + "." + pick(up + low + dig, 24) + "." + pick(up + low + dig + "_-", 30),
    ]
    harmless = [
        lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 2030)}", lambda: f"20{pick(dig, 2)}-{pick(dig, 2)}-{pick(dig, 2)}_{word()}_{word()}", lambda: pick(dig, r.randint(16, 24)), lambda: "/".join([word(), word(), word() + pick(dig, 1), word() + ".html"]),
        lambda: f"mail{pick(dig, 1)}.{word()}.{word()}.example.com", lambda: f"{word()}_{word()}_{word()}_v{r.randint(1, 20)}.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: "=" * r.randint(8, 20) + pick(dig, 1) + "=" * 9, lambda: f"{word()}{word()}{word()}{word()}{pick(dig, 1)}", lambda: ".".join(pick(dig, r.randint(2, 3)) for _ in range(6)),
        lambda: "".join(word() for _ in range(4)), lambda: (word() + word() + word()).upper(), lambda: (word() + word() + word()).capitalize() + ".", lambda: "".join(word().capitalize() for _ in range(4)), lambda: "_".join(word().upper() for _ in range(4)),
        lambda: "/".join(word() for _ in range(5)), lambda: ".".join(word() for _ in range(4)), lambda: "-".join(word() for _ in range(4)), lambda: r.choice("=-_.") * r.randint(16, 60),
    ]
    return word, secret, harmless


_LEAD = ["key = ", "key: ", "auth=", "bearer ", "pwd=", "credential: '", "", "", "Authorization: "]


def labelled(n: int = 4000, seed: int = 11) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Labelled findings: (text, start, end) and 1 for secrets, 0 for look-alikes, from fixed shapes and a seed."""
    r = random.Random(seed)
    word, secret, harmless = shapes(r)
    rows, y = [], []
    for k in range(n):
        hot = k % 2
        body = r.choice(secret if hot else harmless)()
        while len(body) < 16:
            body += "_" + word()
        front = " ".join(word() for _ in range(4)) + r.choice(" \n") + (r.choice(_LEAD) if r.random() < (0.7 if hot else 0.3) else "")
        rows.append((front + body + r.choice(["\n", " ", "'", '"', ". "]) + word(), len(front), len(front) + len(body)))
        y.append(hot)
    return rows, np.array(y, float)


def labelled_runs(n: int = 2000, seed: int = 13) -> tuple[list[tuple[str, int, int]], np.ndarray, list[int]]:
    """Labelled runs longer than the view, as `labelled` gives them, and where to look: at the secret, or anywhere."""
    r = random.Random(seed)
    word, secret, harmless = shapes(r)
    rows, y, at = [], [], []
    for k in range(n):
        hot, front, path = k % 2, " ".join(word() for _ in range(4)) + " ", ""
        for _ in range(r.randint(1, 4)):
            path += r.choice(harmless)() + r.choice("/=.-_")
        while len(path) <= INSIDE:
            path += word() + "/"
        body = path + (r.choice(secret)() if hot else word())
        rows.append((front + body + r.choice(["\n", " ", "'", '"']) + word(), len(front), len(front) + len(body)))
        y.append(hot)
        at.append(len(front) + (min(len(path), len(body) - INSIDE) if hot else r.randint(0, len(body) - INSIDE)))
    return rows, np.array(y, float), at


def as_run(text: str, a: int, b: int) -> tuple[str, int, int]:
    """The run that a labelled finding is read in: "auth=" in front of it, for one, belongs to it."""
    return next(((text, x, z) for x, z in candidates(text) if x <= a and b <= z), (text, a, b))


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (h, label, piece, start, stop): runs that base findings touch, and plain ones, with their context."""
    for batch in batches:
        out = []
        for t in batch.column("text").to_pylist():
            base = base_spans(t or "")
            for a, b in candidates(t or ""):
                hot = any(x < b and a < z for x, _, z in base)
                if hot or PLAIN.fullmatch(t, a, b):
                    low = max(0, a - BEFORE)
                    piece = t[low : b + AFTER]
                    out.append((xxhash.xxh64_intdigest(piece) - (1 << 63), int(hot), piece, a - low, b - low))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["h", "label", "piece", "start", "stop"])


def findings(docs: DataFrame, bound: int = FINDINGS) -> tuple[tuple[str, int, int, int], ...]:
    """(piece, start, stop, label) of at most `bound` different findings of the table of each label, those of least hash."""
    arrow_batches(docs.sparkSession)
    every = cut(docs.select("text").mapInArrow(_findings, "h long, label int, piece string, start int, stop int").dropDuplicates(["h"]), "findings")
    rows = [x for label in (0, 1) for x in every.where(f"label = {label}").orderBy("h").limit(bound).collect()]
    return tuple((x.piece, x.start, x.stop, x.label) for x in rows)


@lru_cache(maxsize=4)
def trained(own: tuple[tuple[str, int, int, int], ...] = (), n: int = 4000) -> CharNet:
    rows, y = labelled(n)
    rows, y = rows + [x[:3] for x in own], np.concatenate([y, [x[3] for x in own]])
    long, long_y, at = labelled_runs(n // 2)
    x = np.stack([codes(*row) for row in rows] + [codes(text, a, a + INSIDE) for (text, _, _), a in zip(long, at, strict=True)])
    every, y = [as_run(*row) for row in rows + long], np.concatenate([y, long_y])
    part = np.random.default_rng(17).permutation(len(y)) % 8
    net, fit = CharNet(), part < 6
    wider = [k for k, row in enumerate(rows) if every[k] != row and fit[k]]
    net.fit(np.concatenate([x[fit], *([np.stack([codes(*every[k]) for k in wider])] if wider else [])]), np.concatenate([y[fit], y[wider]]))
    table = np.arange(len(y))
    table = (table >= n) & (table < n + len(own))
    group = np.array([3 if t else 2 if b - a > INSIDE else int(any(c.isdigit() for c in text[a:b])) for (text, a, b), t in zip(every, table, strict=True)])
    z = lambda p: net.runs([row for row, q in zip(every, p, strict=True) if q])
    net.calibrate(z(part == 6), y[part == 6])
    net.demand(z((part == 7) & (y == 1)), group[(part == 7) & (y == 1)])
    return net


def _covered(a: int, b: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether spans (start, kind, end), by start, hold all of a to b."""
    for x, _, z in spans:
        if x <= a < z:
            a = z
    return a >= b


Spans = list[tuple[int, int, int]]


def find(texts: list[str], net: CharNet) -> list[tuple[Spans, Spans, list[tuple[int, int, float]]]]:
    """For each text: base spans and all spans, (start, kind, end), and the score of every run, (start, end, score)."""
    base = [base_spans(t) for t in texts]
    asked = [(k, a, b) for k, t in enumerate(texts) for a, b in candidates(t)]
    every, scores = [list(x) for x in base], [[] for _ in texts]
    if asked:
        for (k, a, b), p in zip(asked, net.sure(net.runs([(texts[k], a, b) for k, a, b in asked])), strict=True):
            scores[k].append((a, b, float(p)))
            if p >= net.threshold and not _covered(a, b, base[k]):
                every[k].append((a, 3, b))
    return [(x, sorted(e), s) for x, e, s in zip(base, every, scores, strict=True)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long, n_confirmed long, top_score double"


def scan(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """docs(doc_id, text) -> counts, digest of the base spans, all spans, and what the network says. net: one trained already."""
    arrow_batches(docs.sparkSession)
    own = net or trained(findings(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find([t or "" for t in batch.column("text").to_pylist()], own)
            counts = [[sum(s[1] == k for s in x) for x, _, _ in found] for k in range(3)]
            net_count = [sum(s[1] == 3 for s in e) for _, e, _ in found]
            sure = [[(a, b) for a, b, p in s if p >= own.threshold] for _, _, s in found]
            confirmed = [sum(any(x < b and a < z for a, b in hits) for x, _, z in base) for (base, _, _), hits in zip(found, sure, strict=True)]
            top = [round(max((p for _, _, p in s), default=0.0), 6) for _, _, s in found]
            digest = [hashlib.sha256(written(x).encode()).hexdigest() for x, _, _ in found]
            cols = [*[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array([written(e) for _, e, _ in found], pa.string()), pa.array(net_count, pa.int64()), pa.array(confirmed, pa.int64()), pa.array(top, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
