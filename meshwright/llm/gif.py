"""GIF media columns (operator 6): byte payloads as animated GIFs, decoded with LZW, palettes, disposal and transparency.

`encode` stores a payload as 24 x 24 frames. A byte's colour is fixed (`colour_of`), and a file's global palette holds the colours
that the payload uses, so code sizes follow it; a frame with few colours has a local palette where that pays. Where a frame
repeats enough of the one before, the repeated pixels are a transparent index over the picture that disposal 1 leaves there.
All code streams are compressed LZW. `decode` reads any GIF: global and local palettes, interlacing, transparency, disposal 0-3,
delays, clears and code sizes of any kind; the payload is read back from the colours that the composed frames show.

Coder and decoder run many images in step: every numpy operation advances one symbol, or one code, of each. The decoder keeps
table entries as places of the output, and copies are resolved in the end by following them to literals, distance doubling.

Edge cases: null and empty texts are one frame of bytes 255; equal texts give equal values; an empty table gives an empty result;
images are coded and decoded some hundred at a time, so that a very long text needs memory for its bytes, its file and one such
group; extra columns are ignored by `media` and repeated rows give repeated rows. A payload that uses all 256 bytes has no
transparent index.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshwright.llm.common import arrow_batches, utf8_blocks

SIDE = 24
FRAME = SIDE * SIDE
DELAY = 4
#: Pixels that must repeat for a frame to be stored as a change to the one before.
REPEATED = FRAME // 8
#: Images that are coded or decoded in step, and slots of a frame's table while coding.
GROUP, SLOTS = 1024, 2048
_BITS = np.array([1, 1, *[max(1, (n - 1).bit_length()) for n in range(2, 258)]])


@dataclass
class Frame:
    """One composed picture: colours as shown (n x 3), delay in hundredths of a second."""

    colours: np.ndarray
    delay: int


def colour_of() -> np.ndarray:
    """The colour of each byte: three bits of red, three of green, two of blue."""
    v = np.arange(256)
    return np.stack([(v >> 5) * 36, (v >> 2 & 7) * 36, (v & 3) * 85], 1).astype(np.uint8)


_COLOURS = colour_of()
_RED, _GREEN, _BLUE = (np.zeros(256, np.uint8) for _ in range(3))
_RED[_COLOURS[:, 0]], _GREEN[_COLOURS[:, 1]], _BLUE[_COLOURS[:, 2]] = np.arange(256) >> 5 << 5, np.arange(256) & 28, np.arange(256) & 3


def samples(colours: np.ndarray) -> np.ndarray:
    """The bytes that colours stand for."""
    return _RED[colours[:, 0]] | _GREEN[colours[:, 1]] | _BLUE[colours[:, 2]]


def lzw_pack(pixels: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """rows x n indices, all rows of the same n (at most 3800), and each row's code size -> compressed code streams. All rows
    advance by one symbol at a time; strings are looked up as (code, symbol) in a table with open addresses for each row."""
    rows, n = pixels.shape
    if n > 3800:
        raise ValueError("a row must end before its table is full")
    sizes = sizes.astype(np.int64)
    clear = np.int64(1) << sizes
    after, width, every = clear + 2, sizes + 1, np.arange(rows)
    slots = max(SLOTS, 1 << (2 * n - 1).bit_length())
    keys, found, base = np.full(rows * slots, -1, np.int32), np.zeros(rows * slots, np.int16), every * slots
    codes, widths = np.zeros((rows, n + 2), np.int64), np.zeros((rows, n + 2), np.int64)
    codes[:, 0], widths[:, 0] = clear, width
    put = np.ones(rows, np.int64)
    symbols = np.ascontiguousarray(pixels.T.astype(np.int64))
    held = symbols[0] if n else np.zeros(rows, np.int64)
    for t in range(1, n):
        c = symbols[t]
        key = held << 8 | c
        slot = base + (key * 40503 >> 4 & slots - 1)
        there = keys[slot]
        off = np.flatnonzero((there != key) & (there >= 0))
        while len(off):  # another string's slot: the next one
            s = slot[off] + 1
            s = np.where(s == base[off] + slots, base[off], s)
            slot[off], there[off] = s, keys[s]
            off = off[(there[off] != key[off]) & (there[off] >= 0)]
        new = np.flatnonzero(there < 0)
        held = found[slot].astype(np.int64)
        if len(new):
            at = put[new]
            codes[new, at], widths[new, at] = key[new] >> 8, width[new]
            put[new] = at + 1
            keys[slot[new]], found[slot[new]] = key[new], after[new]
            width[new] += after[new] == 1 << width[new]
            after[new] += 1
            held[new] = c[new]
    if n:
        codes[every, put], widths[every, put] = held, width
        width += (after == 1 << width) & (put > 1)
        put += 1
    codes[every, put], widths[every, put] = clear + 1, width
    # place the bits: a code reaches over three bytes at most
    ends = np.cumsum(widths, 1)
    size = -(-ends[:, -1] // 8)
    start = np.concatenate([[0], np.cumsum(size + 3)])
    bit = ends - widths
    word, byte = codes << (bit & 7), (bit >> 3) + start[:-1, None]
    out = np.zeros(int(start[-1]), np.int64)
    for k in range(3):
        out += np.bincount(byte.ravel() + k, weights=(word >> 8 * k & 255).ravel(), minlength=len(out))[: len(out)].astype(np.int64)
    raw = out.astype(np.uint8).tobytes()
    return [raw[a : a + z] for a, z in zip(start.tolist(), size.tolist(), strict=False)]


def lzw_unpack(streams: list[bytes], sizes: list[int], limits: list[int]) -> list[np.ndarray]:
    """Any LZW code streams -> the indices of each, up to its limit; all streams advance by one code at a time. A table entry is
    where in the output its string stands: the output before a code, and one symbol more."""
    count = len(streams)
    length = np.array([len(s) for s in streams], np.int64)
    data = np.frombuffer(b"".join(streams) + b"\0\0\0", np.uint8).astype(np.int64)
    bit = np.concatenate([[0], np.cumsum(length)])[:-1] * 8
    stop = bit + length * 8
    size, limit = np.array(sizes, np.int64), np.array(limits, np.int64)
    base = np.concatenate([[0], np.cumsum(limit)])
    clear, width = np.int64(1) << size, size + 1
    room = min(4096, int((length * 8 // (size + 1)).max(initial=0)) + 1)
    begins, lengths = np.zeros((count, room), np.int32), np.zeros((count, room), np.int32)
    entries, pos = np.zeros(count, np.int64), np.zeros(count, np.int64)
    last, last_size = np.full(count, -1, np.int64), np.zeros(count, np.int64)
    spans: list[tuple[np.ndarray, ...]] = []
    value, source = np.zeros(int(base[-1]), np.uint8), np.arange(int(base[-1]))
    live = np.flatnonzero(limit > 0)
    while len(live):
        w, b = width[live], bit[live]
        if (b + w > stop[live]).any():  # cut short: what is there counts
            live = live[b + w <= stop[live]]
            continue
        at = b >> 3
        code = (data[at] | data[at + 1] << 8 | data[at + 2] << 16) >> (b & 7) & (1 << w) - 1
        bit[live] = b + w
        limit_code = clear[live]
        control = (code == limit_code) | (code == limit_code + 1)
        if control.any():
            again = live[code == limit_code]
            width[again], entries[again], last[again] = size[again] + 1, 0, -1
            over = code == limit_code + 1
            own = live[~control]
            live, code = live[~over], code[~control]
            if not len(own):
                continue
        else:
            own = live
        known = entries[own]
        more = (last[own] >= 0) & (known + clear[own] + 2 < 4096)
        add = own[more]
        begins[add, known[more]], lengths[add, known[more]] = last[add], last_size[add] + 1
        entries[add] += 1
        width[add] += (entries[add] + clear[add] + 2 == 1 << width[add]) & (width[add] < 12)
        here, copy = pos[own], code >= clear[own]
        value[base[own[~copy]] + here[~copy]] = code[~copy]
        size_now = np.ones(len(own), np.int64)
        if copy.any():
            c = own[copy]
            entry = code[copy] - clear[c] - 2
            if (entry >= entries[c]).any():
                raise ValueError("code outside of the table")
            size_now[copy] = np.minimum(lengths[c, entry], limit[c] - here[copy])
            spans.append((base[c] + here[copy], base[c] + begins[c, entry], size_now[copy]))
        last[own], last_size[own], pos[own] = here, size_now, here + size_now
        if (pos[own] >= limit[own]).any():
            live = live[pos[live] < limit[live]]
    if (pos < limit).any():
        raise ValueError("picture is cut short")
    if spans:
        to, origin, size_of = (np.concatenate(x) for x in zip(*spans, strict=True))
        inside = np.arange(int(size_of.sum())) - np.repeat(np.cumsum(size_of) - size_of, size_of)
        source[np.repeat(to, size_of) + inside] = np.repeat(origin, size_of) + inside
        while True:
            further = source[source]
            if (further == source).all():
                break
            source = further
    out = value[source]
    return [out[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p := data[k : k + 255])]) + p for k in range(0, len(data), 255)) + b"\x00"


def _palette(values: np.ndarray, bits: int) -> bytes:
    """Colours of the given bytes, filled up to 2 ** bits."""
    out = np.zeros((1 << bits, 3), np.uint8)
    out[: len(values)] = _COLOURS[values]
    return out.tobytes()


def encode(payloads: list[bytes], delay: int = DELAY) -> list[bytes]:
    """Positive multiples of 576 bytes, each as an animated GIF with one frame for each 576."""
    frames = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    count = np.array([len(p) // FRAME for p in payloads])
    doc, first = np.repeat(np.arange(len(payloads)), count), np.concatenate([[0], np.cumsum(count)])
    used = np.stack([np.bincount(np.frombuffer(p, np.uint8), minlength=256) > 0 for p in payloads])
    colours = used.sum(1)
    spare = colours < 256
    bits_of = _BITS[colours + spare]
    ranks = np.concatenate([np.cumsum(used, 1) - 1, colours[:, None]], 1)  # the last column: the transparent index
    out = [bytearray(b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF0 | int(b) - 1, 0, 0) + _palette(np.flatnonzero(u), int(b)) + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00") for u, b in zip(used, bits_of, strict=True)]
    for low in range(0, len(frames), GROUP):
        x, own = frames[low : low + GROUP], doc[low : low + GROUP]
        n = len(x)
        same = x == (frames[low - 1 : low + n - 1] if low else np.concatenate([x[:1], x[:-1]]))
        hidden = spare[own] & (low + np.arange(n) != first[own]) & (same.sum(1) >= REPEATED)
        seen = np.where(same & hidden[:, None], 256, x.astype(np.int64))
        row = np.arange(n)[:, None]
        here = (np.bincount((row * 257 + seen).ravel(), minlength=n * 257) > 0).reshape(n, 257)
        bits, whole = _BITS[here.sum(1)], bits_of[own]
        local = (whole - bits) * (FRAME // 4) > 24 << bits
        table = np.where(local[:, None], np.cumsum(here, 1) - 1, ranks[own])
        bits = np.where(local, bits, whole)
        sizes = np.maximum(2, bits)
        streams = lzw_pack(table[row, seen], sizes)
        for k, stream in enumerate(streams):
            b, veil = int(bits[k]), int(table[k, 256]) if hidden[k] else 0
            lead = struct.pack("<BHBB", 4 | int(hidden[k]), delay, veil, 0)
            head = b"\x21\xf9\x04" + lead + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0x80 | b - 1 if local[k] else 0)
            out[own[k]] += head + (_palette(np.flatnonzero(here[k, :256]), b) if local[k] else b"") + bytes([sizes[k]]) + _blocks(stream)
    return [bytes(x + b"\x3b") for x in out]


@dataclass
class Image:
    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    palette: np.ndarray | None
    size: int
    stream: bytes
    delay: int
    disposal: int
    hidden: int | None


def parse(data: bytes) -> tuple[int, int, int, np.ndarray | None, list[Image]]:
    """Width, height, index of the background, global palette and images."""
    if data[:4] != b"GIF8":
        raise ValueError("not a GIF")
    width, height, flags, back = *struct.unpack_from("<HHB", data, 6), data[11]

    def colours(at: int, flags: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 2 << (flags & 7)
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3), at + 3 * n

    palette, at = colours(13, flags)
    images, timing = [], (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", data, at + 3)
                timing = (delay, bits >> 2 & 7, index if bits & 1 else None)
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            own, at = colours(at + 10, flags)
            size, at, parts = data[at], at + 1, []
            while n := data[at]:
                parts.append(data[at + 1 : at + 1 + n])
                at += n + 1
            at += 1
            images.append(Image(left, top, w, h, bool(flags & 0x40), palette if own is None else own, size, b"".join(parts), *timing))
            timing = (0, 0, None)
        else:
            raise ValueError(f"block {data[at]:#x} is unknown")
    return width, height, back, palette, images


def planes(images: list[Image]) -> Iterator[np.ndarray]:
    """The indices of each image, in rows from top to bottom."""
    for low in range(0, len(images), GROUP):
        part = images[low : low + GROUP]
        for x, plane in zip(part, lzw_unpack([x.stream for x in part], [x.size for x in part], [x.width * x.height for x in part]), strict=True):
            if x.interlaced:
                order = np.concatenate([np.arange(a, x.height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                fixed = np.empty((x.height, x.width), np.uint8)
                fixed[order] = plane.reshape(x.height, x.width)
                plane = fixed.ravel()
            yield plane


def compose(width: int, height: int, back: int, palette: np.ndarray | None, images: list[Image], indices: Iterator[np.ndarray]) -> Iterator[Frame]:
    """The pictures that are shown, one after the other: each image drawn on what disposal has left of the one before."""
    empty = np.zeros((height, width, 3), np.uint8)
    if palette is not None and back < len(palette):
        empty[:] = palette[back]
    canvas = empty
    for x in images:
        plane, own = next(indices).reshape(x.height, x.width), x.palette
        if own is None:
            own = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
        drawn = own[plane] if len(own) == 256 else own[np.minimum(plane, len(own) - 1)]
        area = slice(x.top, x.top + x.height), slice(x.left, x.left + x.width)
        before = canvas
        if x.hidden is not None:
            drawn = np.where((plane != x.hidden)[:, :, None], drawn, canvas[area])
        if drawn.shape == canvas.shape:
            canvas = drawn
        else:
            canvas = canvas.copy()
            canvas[area] = drawn
        yield Frame(canvas.reshape(-1, 3), x.delay)
        if x.disposal == 2:
            canvas = canvas.copy()
            canvas[area] = empty[area]
        elif x.disposal == 3:
            canvas = before


def decode(data: bytes) -> Iterator[Frame]:
    """All frames of a GIF, composed on the canvas, one at a time."""
    *screen, images = parse(data)
    return compose(*screen, images, planes(images))


class Seen:
    """What is learnt from a file's frames, a few at a time: payload digests and features."""

    def __init__(self, bins: int = 4):
        self.digest, self.tail, self.size, self.frames, self.delay = hashlib.sha256(), b"", 0, 0, 0
        self.counts, self.held = np.zeros((3, bins), np.int64), []

    def add(self, frame: Frame) -> None:
        self.held.append(frame.colours)
        self.frames += 1
        self.delay += frame.delay
        if len(self.held) >= GROUP:
            self.settle()

    def settle(self) -> None:
        if self.held:
            colours, bins = np.concatenate(self.held), self.counts.shape[1]
            back = samples(colours).tobytes()
            self.held = []
            self.digest.update(back)
            self.size += len(back)
            self.tail = (self.tail + back[-32:])[-32:]
            self.counts += np.bincount(((colours >> 9 - bins.bit_length()) + np.arange(3, dtype=np.uint8) * bins).ravel(), minlength=3 * bins).reshape(3, bins)


def pad(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms long"


def read(files: list[bytes]) -> list[Seen]:
    """What the files' frames show; the images of all are decoded together."""
    parsed, out = [parse(x) for x in files], []
    indices = planes([image for *_, images in parsed for image in images])
    for *screen, images in parsed:
        seen = Seen()
        for frame in compose(*screen, images, indices):
            seen.add(frame)
        seen.settle()
        out.append(seen)
    return out


def _groups(ends: np.ndarray, data: np.ndarray) -> Iterator[list[bytes]]:
    """The texts of a block, as many at a time as fill GROUP frames."""
    held, frames = [], 0
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        held.append(data[a:b].tobytes())
        frames += 1 + (b - a) // FRAME
        if frames >= GROUP:
            yield held
            held, frames = [], 0
    if held:
        yield held


def _rows(texts: list[bytes]) -> list[tuple]:
    files = encode([pad(t) for t in texts])
    return [
        (len(t), s.size, s.digest.hexdigest(), zlib.crc32(s.tail), len(f), hashlib.sha256(f).hexdigest(), ";".join(",".join(map(str, row)) for row in s.counts.tolist()), s.frames, 10 * s.delay)
        for t, f, s in zip(texts, files, read(files), strict=True)
    ]


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for rows, ends, data in utf8_blocks(batches):
        got = [row for texts in _groups(ends, data) for row in _rows(texts)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)]], names)


def media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> digests and features of each text's GIF, taken from what was read back."""
    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_media, SCHEMA)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, ends, data in utf8_blocks(batches):
        files = [f for texts in _groups(ends, data) for f in encode([pad(t) for t in texts])]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(files, pa.binary())], ["doc_id", "media"])


def store(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, media binary."""
    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_stored, "doc_id long, media binary")
