"""Media columns in lossless WebP: write byte payloads as images and read the pixels back.

`decode_webp` reads any lossless (VP8L) image: prefix codes, back-references, colour cache, entropy
image, and the predictor, cross-colour, subtract-green and palette transforms.  `decode_many` reads
many images whose headers are equal in step, a pixel of each image at a time, and hands images
with transforms or an entropy image to `decode_webp`.

`encode_many` writes payloads (multiples of 3 bytes) as RGB images with one fixed set of prefix
codes, a colour cache, and back-references for runs of a pixel.  Images that a transform may suit
(few colours: palette; rows that repeat: predictor; grey pixels: cross-colour) are also written with
it and with codes of their own, and the smallest file is stored.  Stored bytes depend on the payload
only, so equal texts give equal files.

Defined results: a null or empty text is one row of 64 blanks (192 bytes).  A payload that needs
more than 16,384 rows becomes several images, one after another, each with its own file header.
Texts are never cut short; repeated rows and null ids give results like others, an empty table gives
none, and columns but the id and the text (or the media) are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from platewright.llm._text import slices

WIDTH = 64
ROW_BYTES = 3 * WIDTH
MAX_SIDE = 16384
CACHE_BITS = 8
HASH = 0x1E35A7BD
#: Order in which code lengths of the code-length code are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, *range(6, 16)]
#: Neighbours behind the 120 short distance codes: by distance, then the upper, then the right one.
NEIGHBOURS = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))
MIN_RUN = 4
MAX_COPY = 4096


# ---------------------------------------------------------------- prefix codes


def code_lengths(weights: np.ndarray, limit: int = 12) -> np.ndarray:
    """Huffman code lengths of positive weights; weights are flattened until none is over the limit."""
    weights = np.asarray(weights, float)
    while True:
        heap = [(w, i, (i,)) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        out, n = np.zeros(len(weights), int), len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            out[[*a[2], *b[2]]] += 1
            heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
            n += 1
        if out.max() <= limit:
            return out
        weights = weights + weights.max() / 2**limit


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the lengths, bit-reversed as the stream holds them."""
    codes, code, top = np.zeros(len(lengths), np.int64), 0, int(max(lengths, default=0))
    for n in range(1, top + 1):
        for s in np.flatnonzero(np.asarray(lengths) == n):
            codes[s] = int(format(code, f"0{n}b")[::-1], 2)
            code += 1
        code <<= 1
    return codes


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Table by the next bits: symbol << 4 | length, and its index mask."""
    lengths = np.asarray(lengths)
    used = np.flatnonzero(lengths)
    if len(used) <= 1:  # a lone symbol takes no bits
        return np.array([(int(used[0]) if len(used) else 0) << 4], np.int64), 0
    top = int(lengths.max())
    if (2.0 ** -lengths[used]).sum() != 1:
        raise ValueError("prefix code is not complete")
    table, codes = np.zeros(1 << top, np.int64), canonical(lengths)
    for s in used:
        table[codes[s] :: 1 << lengths[s]] = s << 4 | lengths[s]
    return table, (1 << top) - 1


class BitReader:
    def __init__(self, data: bytes, bit: int = 0):
        self.data, self.bit = data + bytes(16), bit

    def peek(self) -> int:
        at = self.bit >> 3
        return int.from_bytes(self.data[at : at + 8], "little") >> (self.bit & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.bit += n
        if self.bit > 8 * len(self.data):
            raise ValueError("image stream ends early")
        return value

    def symbol(self, code: tuple[np.ndarray, int]) -> int:
        entry = int(code[0][self.peek() & code[1]])
        self.bit += entry & 15
        return entry >> 4


class BitWriter:
    def __init__(self):
        self.value, self.bits = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= int(value) << self.bits
        self.bits += int(n)

    def symbol(self, s: int, lengths: np.ndarray, codes: np.ndarray) -> None:
        if np.count_nonzero(lengths) > 1:
            self.write(codes[s], lengths[s])

    def data(self) -> bytes:
        return self.value.to_bytes((self.bits + 7) // 8, "little")


def read_code(r: BitReader, alphabet: int) -> np.ndarray:
    """Code lengths of one prefix code."""
    out = np.zeros(alphabet, int)
    if r.read(1):  # one or two symbols
        two = r.read(1)
        first = r.read(8 if r.read(1) else 1)
        out[[first, r.read(8)] if two else [first]] = 1
        return out
    inner = np.zeros(19, int)
    for i in range(4 + r.read(4)):
        inner[LENGTH_ORDER[i]] = r.read(3)
    code = lookup(inner)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = r.symbol(code)
        if s < 16:
            out[at], last, at = s, s or last, at + 1
        else:
            n = {16: lambda: 3 + r.read(2), 17: lambda: 3 + r.read(3), 18: lambda: 11 + r.read(7)}[s]()
            out[at : at + n] = last if s == 16 else 0
            at += n
    return out


def write_code(w: BitWriter, lengths: np.ndarray) -> None:
    """Write one prefix code; a lone symbol below 256 takes the short form."""
    used = np.flatnonzero(lengths)
    if len(used) == 1 and used[0] < 256:
        w.write(1, 1)
        w.write(0, 1)
        w.write(1, 1)
        w.write(used[0], 8)
        return
    items, i = [], 0  # (symbol of the inner code, extra bits' value and number)
    last = 8
    while i < len(lengths):
        n = i
        while n < len(lengths) and lengths[n] == lengths[i]:
            n += 1
        run, v = n - i, int(lengths[i])
        if v == 0 and run >= 3:
            run = min(run, 138)
            items.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
        elif v == last and run >= 3:
            run = min(run, 6)
            items.append((16, run - 3, 2))
        else:
            run, last = 1, v or last
            items.append((v, 0, 0))
        i += run
    counts = np.bincount([s for s, _, _ in items], minlength=19)
    some = np.flatnonzero(counts)
    inner = np.zeros(19, int)
    inner[some] = 1 if len(some) == 1 else code_lengths(counts[some], 7)
    stored = max(4, max(k for k, s in enumerate(LENGTH_ORDER) if inner[s]) + 1)
    w.write(0, 1)
    w.write(stored - 4, 4)
    for k in range(stored):
        w.write(inner[LENGTH_ORDER[k]], 3)
    w.write(0, 1)
    codes = canonical(inner)
    for s, value, n in items:
        w.symbol(s, inner, codes)
        w.write(value, n)


def prefix_value(r: BitReader, prefix: int) -> int:
    """Length or distance behind a prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.read(extra) + 1


def value_prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits' value and number of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    prefix = 2 * (extra + 1) + ((v >> extra) & 1)
    return prefix, v & ((1 << extra) - 1), extra


def reach(code: int, width: int) -> int:
    """Pixels back of a distance code."""
    if code > 120:
        return code - 120
    x, y = NEIGHBOURS[code - 1]
    return max(1, x + y * width)


# ---------------------------------------------------------------- one image, every feature


def read_pixels(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded ARGB pixels (flat)."""
    bits = r.read(4) if r.read(1) else 0
    if bits > 11:
        raise ValueError("colour cache is too large")
    groups, tile, across = np.zeros(1, int), 0, 1
    if main and r.read(1):
        tile = r.read(3) + 2
        across = -(-width >> tile)
        groups = (read_pixels(r, across, -(-height >> tile), False) >> 8) & 0xFFFF
    cached = 1 << bits if bits else 0
    codes = [[lookup(read_code(r, n)) for n in (280 + cached, 256, 256, 256, 40)] for _ in range(int(groups.max()) + 1)]
    out, cache, at, total = [0] * (width * height), [0] * max(cached, 1), 0, width * height
    while at < total:
        green, red, blue, alpha, far = codes[groups[(at // width >> tile) * across + (at % width >> tile)] if tile else 0]
        s = r.symbol(green)
        if s < 256:
            new = [r.symbol(red) << 16 | s << 8 | r.symbol(blue) | r.symbol(alpha) << 24]
        elif s >= 280:
            new = [cache[s - 280]]
        else:
            n = prefix_value(r, s - 256)
            back = reach(prefix_value(r, r.symbol(far)), width)
            if back > at:
                raise ValueError("back-reference before the image")
            n = min(n, total - at)
            new = (out[at - back : at] * (n // back + 1))[:n] if back < n else out[at - back : at - back + n]
        out[at : at + len(new)] = new
        at += len(new)
        if bits:
            for c in new:
                cache[(HASH * c & 0xFFFFFFFF) >> (32 - bits)] = c
    return np.array(out, np.int64)


def channels(pixels: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue in a last axis."""
    return np.stack([(pixels >> s) & 255 for s in (24, 16, 8, 0)], -1)


def joined(parts: np.ndarray) -> np.ndarray:
    parts = parts & 255
    return parts[..., 0] << 24 | parts[..., 1] << 16 | parts[..., 2] << 8 | parts[..., 3]


def predicted(mode: int, left: list, top: list, right: list, corner: list) -> list:
    """A pixel's prediction; `right` is above and to the right, `corner` above and to the left."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(max(v, 0), 255)
    plain = {1: left, 2: top, 3: right, 4: corner}
    if mode in plain:
        return plain[mode]
    if mode == 11:
        nearer_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True)) < sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if nearer_left else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]
    means = {5: lambda: mean(mean(left, right), top), 6: lambda: mean(left, corner), 7: lambda: mean(left, top), 8: lambda: mean(corner, top), 9: lambda: mean(top, right), 10: lambda: mean(mean(left, corner), mean(top, right))}
    return means[mode]() if mode in means else [255, 0, 0, 0]


def add_predictions(pixels: np.ndarray, width: int, modes: np.ndarray, tile: int, sign: int = 1) -> np.ndarray:
    """Invert the predictor transform (sign -1 applies it)."""
    rows = channels(pixels).reshape(-1, width, 4)
    out, across = rows.tolist(), -(-width >> tile)
    source = out if sign > 0 else rows.tolist()
    for y, row in enumerate(out):
        for x, value in enumerate(row):
            if not y:
                guess = source[0][x - 1] if x else [255, 0, 0, 0]
            elif not x:
                guess = source[y - 1][0]
            else:
                up = source[y - 1]
                guess = predicted(int(modes[(y >> tile) * across + (x >> tile)]), source[y][x - 1], up[x], up[x + 1] if x + 1 < width else source[y][0], up[x - 1])
            row[x] = [(v + sign * g) & 255 for v, g in zip(value, guess, strict=True)]
    return joined(np.array(out)).reshape(-1)


def signed(v: np.ndarray) -> np.ndarray:
    return ((v & 255) ^ 128) - 128


def add_cross_colour(pixels: np.ndarray, width: int, factors: np.ndarray, tile: int, sign: int = 1) -> np.ndarray:
    """Invert the cross-colour transform (sign -1 applies it)."""
    at = np.arange(len(pixels))
    f = channels(factors)[(at // width >> tile) * -(-width >> tile) + (at % width >> tile)]
    p = channels(pixels)
    from_green = lambda k: (signed(f[:, k]) * signed(p[:, 2])) >> 5
    red = (p[:, 1] + sign * from_green(3)) & 255
    blue = p[:, 3] + sign * from_green(2) + sign * ((signed(f[:, 1]) * signed(red if sign > 0 else p[:, 1])) >> 5)
    return joined(np.stack([p[:, 0], red, p[:, 2], blue], -1))


def add_green(pixels: np.ndarray) -> np.ndarray:
    p = channels(pixels)
    p[:, 1] += p[:, 2]
    p[:, 3] += p[:, 2]
    return joined(p)


def from_palette(pixels: np.ndarray, width: int, palette: np.ndarray, bundle: int) -> np.ndarray:
    """Colours of palette indices; 2**bundle indices share the green of a pixel."""
    index = (pixels >> 8) & 255
    if bundle:
        each = 8 >> bundle
        index = (index.reshape(-1, -(-width >> bundle))[:, :, None] >> (each * np.arange(1 << bundle))) & ((1 << each) - 1)
        index = index.reshape(index.shape[0], -1)[:, :width].reshape(-1)
    return np.append(palette, np.zeros(256, np.int64))[index]


def bundling(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def stream_of(data: bytes) -> bytes:
    """The VP8L stream of a WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP image")
    return data[20 : 20 + struct.unpack_from("<I", data, 16)[0]]


def decode_webp(data: bytes) -> np.ndarray:
    """Height x width x 4 array (red, green, blue, alpha) of a lossless WebP file."""
    r = BitReader(stream_of(data), 8)
    width, height = r.read(14) + 1, r.read(14) + 1
    has_alpha = r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    undo, seen, coded = [], set(), width
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind < 2:
            tile = r.read(3) + 2
            image = read_pixels(r, -(-coded >> tile), -(-height >> tile), False)
            invert = add_predictions if kind == 0 else add_cross_colour
            undo.append(lambda p, w=coded, i=(image >> 8) & 255 if kind == 0 else image, t=tile, f=invert: f(p, w, i, t))
        elif kind == 2:
            undo.append(add_green)
        else:
            colours = r.read(8) + 1
            palette = joined(np.cumsum(channels(read_pixels(r, colours, 1, False)), 0))
            bundle = bundling(colours)
            undo.append(lambda p, w=coded, c=palette, b=bundle: from_palette(p, w, c, b))
            coded = -(-coded >> bundle)
    pixels = read_pixels(r, coded, height, True)
    for f in reversed(undo):
        pixels = f(pixels)
    out = channels(pixels)[:, [1, 2, 3, 0]].astype(np.uint8).reshape(height, width, 4)
    if not has_alpha:
        out[..., 3] = 255
    return out


# ---------------------------------------------------------------- many images in step


class Codes:
    """A header's prefix codes, for images without transforms and entropy image."""

    def __init__(self, stream: bytes):
        r = BitReader(stream, 40)
        self.plain = not r.read(1)
        if not self.plain:
            return
        self.bits = r.read(4) if r.read(1) else 0
        self.plain = not r.read(1)
        if self.plain:
            n = 1 << self.bits if self.bits else 0
            self.tables = [lookup(read_code(r, k)) for k in (280 + n, 256, 256, 256, 40)]
            self.start = r.bit
            self.key = self.cut(stream)

    def cut(self, stream: bytes) -> bytes:
        """The header's bits after the image size."""
        end = self.start >> 3
        return stream[5:end] + bytes([stream[end] & ((1 << (self.start & 7)) - 1)])

    def fits(self, stream: bytes) -> bool:
        return len(stream) > self.start >> 3 and self.cut(stream) == self.key


def decode_in_step(streams: list[bytes], codes: Codes) -> list[np.ndarray]:
    """ARGB pixels of images that share `codes`; each round reads one symbol of every image left."""
    sizes = [struct.unpack_from("<I", s, 1)[0] for s in streams]
    widths = np.array([(v & 0x3FFF) + 1 for v in sizes])
    counts = widths * np.array([((v >> 14) & 0x3FFF) + 1 for v in sizes])
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    words = np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))
    starts = np.cumsum([0, *map(len, streams)])[:-1]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]), np.uint32)
    (green, gm), (red, rm), (blue, bm), (alpha, am), (far, fm) = [(t, np.uint64(m)) for t, m in codes.tables]
    bits, shift = codes.bits, np.uint32(32 - codes.bits)
    cache = np.zeros((len(streams), 1 << bits), np.uint32) if bits else None
    live = np.arange(len(streams))
    bit, at, end = starts * 8 + codes.start, ends - counts, ends.copy()
    while len(live):
        w = words[bit >> 3] >> (bit & 7).astype(np.uint64)
        e = green[(w & gm).astype(np.int64)]
        s, used = e >> 4, e & 15
        w >>= used.astype(np.uint64)
        er = red[(w & rm).astype(np.int64)]
        n = er & 15
        w >>= n.astype(np.uint64)
        eb = blue[(w & bm).astype(np.int64)]
        n = n + (eb & 15)
        literal = s < 256
        if am:  # the fourth code may reach beyond the word
            far_bit = bit + used + n
            ea = alpha[((words[far_bit >> 3] >> (far_bit & 7).astype(np.uint64)) & am).astype(np.int64)]
            n = n + (ea & 15)
        else:
            ea = alpha[0]
        colour = ((ea >> 4) << 24 | (er >> 4) << 16 | s << 8 | eb >> 4).astype(np.uint32)
        bit = bit + used + np.where(literal, n, 0)
        if not literal.all():
            if bits:
                hit = np.flatnonzero(s >= 280)
                colour[hit] = cache[live[hit], s[hit] - 280]
            for k in np.flatnonzero((s >= 256) & (s < 280)).tolist():
                r = BitReader(data[bit[k] >> 3 : (bit[k] >> 3) + 24].tobytes(), int(bit[k] & 7))
                length = prefix_value(r, int(s[k]) - 256)
                back = reach(prefix_value(r, r.symbol((far, int(fm)))), int(widths[live[k]]))
                bit[k] += r.bit - (bit[k] & 7)
                first = ends[live[k]] - counts[live[k]]
                length = min(length, int(end[k] - at[k]))
                if back > at[k] - first:
                    raise ValueError("back-reference before the image")
                run = np.resize(out[at[k] - back : at[k]], length) if back < length else out[at[k] - back : at[k] - back + length]
                out[at[k] : at[k] + length] = run
                if bits:
                    cache[live[k], (run * np.uint32(HASH)) >> shift] = run  # later pixels win, as in order
                at[k] += length - 1
                colour[k] = run[-1]
        out[at] = colour
        if bits:
            cache[live, (colour * np.uint32(HASH)) >> shift] = colour
        at += 1
        left = at < end
        if not left.all():
            live, bit, at, end = live[left], bit[left], at[left], end[left]
    return np.split(out, ends[:-1])


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """RGB pixels (rows x width x 3) of lossless WebP files without alpha."""
    out: list = [None] * len(files)
    known: list[tuple[Codes, list[int]]] = []
    streams = [stream_of(f) for f in files]
    for i, s in enumerate(streams):
        for codes, members in known:
            if codes.fits(s):
                members.append(i)
                break
        else:
            if len(known) < 64 and (codes := Codes(s)).plain:
                known.append((codes, [i]))
            else:
                out[i] = decode_webp(files[i])[..., :3]
    for codes, members in known:
        for i, p in zip(members, decode_in_step([streams[i] for i in members], codes), strict=True):
            width = (struct.unpack_from("<I", streams[i], 1)[0] & 0x3FFF) + 1
            out[i] = np.stack([p >> 16, p >> 8, p], -1).astype(np.uint8).reshape(-1, width, 3)
    return out


# ---------------------------------------------------------------- writing


def byte_weights() -> np.ndarray:
    """Expected shares of bytes in prose: a rule by kind of byte and by rank of the letter."""
    w = np.full(256, 0.05)
    w[33:127] = 1.0
    w[0x80:0xC0] = 1.5
    w[0xC2:0xF5] = 0.3
    w[0xC3] = 12
    w[[0x0A, 0x2C, 0x2E]] = 12
    w[0x20] = 160
    for rank, letter in enumerate("etaonihrsdlcumwfgypbvkjqxz"):
        w[ord(letter)] = 110 / (rank + 1) ** 0.6
        w[ord(letter.upper())] = 4 / (rank + 1) ** 0.4
    return w


class Written:
    """The fixed codes of `encode_many` and the header bits that state them."""

    def __init__(self):
        literal = byte_weights()
        literal /= literal.sum()
        self.colour = code_lengths(literal)
        cached = 1 << CACHE_BITS
        self.green = code_lengths(np.concatenate([0.7 * literal, np.full(24, 0.0005), np.full(cached, 0.3 / cached)]))
        w = BitWriter()
        for value, n in ((0, 1), (1, 1), (CACHE_BITS, 4), (0, 1)):  # no transform, a cache, one group of codes
            w.write(value, n)
        alone = lambda s, n: np.bincount([s], minlength=n)
        for code in (self.green, self.colour, self.colour, alone(255, 256), alone(1, 40)):  # distance code 2: the pixel before
            write_code(w, code)
        self.header, self.header_bits = np.frombuffer(w.data(), np.uint8), w.bits
        self.green_code, self.colour_code = canonical(self.green), canonical(self.colour)


_written: list[Written] = []


def written() -> Written:
    if not _written:
        _written.append(Written())
    return _written[0]


def encode_many(payloads: list[bytes], width: int = WIDTH) -> list[bytes]:
    """One WebP file for each payload of whole rows (3 * width bytes) and at most 16,384 of them."""
    c = written()
    counts = np.array([len(p) // 3 for p in payloads])
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 3).astype(np.int64)
    argb = (0xFF << 24 | flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2]).astype(np.uint32)
    n, doc = len(argb), np.repeat(np.arange(len(payloads)), counts)
    first = np.zeros(n, bool)
    first[np.cumsum(counts) - counts] = True
    # runs of the pixel before
    same = np.zeros(n, bool)
    same[1:] = argb[1:] == argb[:-1]
    same &= ~first
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    begin, length = edge[::2], edge[1::2] - edge[::2]
    begin, length = begin[length >= MIN_RUN], length[length >= MIN_RUN]
    parts = -(-length // MAX_COPY)
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    run_at = np.repeat(begin, parts) + part * MAX_COPY
    run_of = np.minimum(np.repeat(length, parts) - part * MAX_COPY, MAX_COPY)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, begin, 1)
    np.add.at(covered, begin + length, -1)
    emit = np.cumsum(covered[:-1]) == 0
    # the last pixel of a cache slot decides whether the cache has the colour
    slot = (argb * np.uint32(HASH)) >> np.uint32(32 - CACHE_BITS)
    order = np.argsort(doc << CACHE_BITS | slot, kind="stable")
    hit = np.zeros(n, bool)
    hit[order[1:]] = (argb[order[1:]] == argb[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (slot[order[1:]] == slot[order[:-1]])
    g, r, b = flat[:, 1], flat[:, 0], flat[:, 2]
    lg, lr, lb = c.green[g], c.colour[r], c.colour[b]
    value = np.where(hit, c.green_code[280 + slot.astype(np.int64)], c.green_code[g] | c.colour_code[r] << lg | c.colour_code[b] << (lg + lr))
    bits = np.where(hit, c.green[280 + slot.astype(np.int64)], lg + lr + lb)
    for i, k in zip(run_at.tolist(), run_of.tolist(), strict=True):
        prefix, extra, m = value_prefix(k)
        value[i] = c.green_code[256 + prefix] | extra << int(c.green[256 + prefix])
        bits[i] = c.green[256 + prefix] + m
        emit[i] = True
    value, bits, doc = value[emit], bits[emit], doc[emit]
    # place each value at its bit
    total = np.bincount(doc, bits, len(payloads)).astype(np.int64)
    stream = 5 + (c.header_bits + total + 7) // 8
    size = 20 + stream + (stream & 1)
    offset = np.cumsum(size) - size
    bit = np.cumsum(bits) - bits
    bit += (8 * (offset + 25) + c.header_bits - (np.cumsum(total) - total))[doc]
    at, value = bit >> 3, value << (bit & 7)
    out = np.zeros(int(size.sum()) + 8, np.int64)
    for k in range(6):
        out += np.bincount(at + k, (value >> (8 * k)) & 255, len(out)).astype(np.int64)
    for k, v in enumerate(c.header.tolist()):
        out[offset + 25 + k] += v
    data = out.astype(np.uint8).tobytes()
    files = []
    for o, z, s, k in zip(offset.tolist(), size.tolist(), stream.tolist(), counts.tolist(), strict=True):
        head = b"RIFF" + struct.pack("<I", z - 8) + b"WEBPVP8L" + struct.pack("<IBI", s, 0x2F, (width - 1) | (k // width - 1) << 14)
        files.append(head + data[o + 25 : o + z])
    return files


# ---------------------------------------------------------------- writing with transforms

#: Most colours of a palette, share of pixels like the one above, share of grey pixels that make a transform worth a try.
FEW_COLOURS, REPEATED, GREY = 16, 0.6, 0.6
TILE = 5


class Bits(list):
    """Bits of a stream, least first; linear in its length."""

    def write(self, value: int, n: int) -> None:
        if n:
            self.append(format(int(value), f"0{int(n)}b")[::-1])

    def symbol(self, s: int, lengths: np.ndarray, codes: np.ndarray) -> None:
        if np.count_nonzero(lengths) > 1:
            self.write(codes[s], lengths[s])

    def data(self) -> bytes:
        stream = "".join(self)
        return int(stream[::-1] or "0", 2).to_bytes((len(stream) + 7) // 8, "little")


def own_code(counts: np.ndarray) -> np.ndarray:
    """Code lengths of an image's own symbols; none used is as the first one alone."""
    out, used = np.zeros(len(counts), int), np.flatnonzero(counts)
    out[used] = 1 if len(used) == 1 else code_lengths(counts[used]) if len(used) else 0
    out[0] += not len(used)
    return out


def write_pixels(w: Bits, pixels: np.ndarray, main: bool) -> None:
    """ARGB pixels with prefix codes of their own; runs of a pixel are back-references."""
    w.write(0, 1)  # no cache
    if main:
        w.write(0, 1)  # one group of codes
    starts = np.flatnonzero(np.append(True, pixels[1:] != pixels[:-1]))
    tokens: list[tuple[int, int]] = []  # (pixel, length of the run behind it, or 0)
    for at, n in zip(starts.tolist(), np.diff(np.append(starts, len(pixels))).tolist(), strict=True):
        tokens.append((int(pixels[at]), 0))
        n -= 1
        while n >= MIN_RUN:
            tokens.append((-1, min(n, MAX_COPY)))
            n -= min(n, MAX_COPY)
        tokens += [(int(pixels[at]), 0)] * n
    parts = channels(np.array([p for p, n in tokens if not n], np.int64))
    prefixes = [256 + value_prefix(n)[0] for _, n in tokens if n]
    counts = [np.bincount(np.append(parts[:, 2], prefixes).astype(int), minlength=280), *(np.bincount(parts[:, k], minlength=256) for k in (1, 3, 0)), np.bincount([1] * bool(prefixes), minlength=40)]
    lengths = [own_code(c) for c in counts]
    codes = [canonical(x) for x in lengths]
    for x in lengths:
        write_code(w, x)
    for p, n in tokens:
        if n:
            prefix, extra, m = value_prefix(n)
            w.symbol(256 + prefix, lengths[0], codes[0])
            w.write(extra, m)
            w.symbol(1, lengths[4], codes[4])  # distance code 2: the pixel before
        else:
            for k, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
                w.symbol((p >> shift) & 255, lengths[k], codes[k])


def file_of(width: int, height: int, write) -> bytes:
    w = Bits()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        w.write(v, n)
    write(w)
    data = w.data()
    data += bytes(len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def with_palette(pixels: np.ndarray, width: int) -> bytes:
    palette, index = np.unique(pixels, return_inverse=True)
    bundle = bundling(len(palette))
    each, wide = 8 >> bundle, -(-width >> bundle)
    held = np.zeros((len(pixels) // width, wide << bundle), np.int64)
    held[:, :width] = index.reshape(-1, width)
    packed = (held.reshape(len(held), wide, -1) << (each * np.arange(1 << bundle))).sum(2)

    def write(w: Bits) -> None:
        w.write(1, 1), w.write(3, 2), w.write(len(palette) - 1, 8)
        write_pixels(w, joined(np.diff(channels(palette), axis=0, prepend=0)), False)
        w.write(0, 1)
        write_pixels(w, 0xFF << 24 | packed.reshape(-1) << 8, True)

    return file_of(width, len(held), write)


def with_tiles(pixels: np.ndarray, width: int, predict: bool, cross: bool) -> bytes:
    """Pixels after the predictor (each tile by the pixel above or the one before) and the cross-colour transform (grey pixels keep one channel)."""
    height = len(pixels) // width
    across, down = -(-width >> TILE), -(-height >> TILE)
    modes = np.full(across * down, 2)
    if predict:
        rows = pixels.reshape(height, width)
        above, before = np.zeros((height, width)), np.zeros((height, width))
        above[1:] = rows[1:] == rows[:-1]
        before[:, 1:] = rows[:, 1:] == rows[:, :-1]
        at = (np.arange(height) >> TILE)[:, None] * across + (np.arange(width) >> TILE)
        better = np.bincount(at.reshape(-1), (before - above).reshape(-1), across * down) > 0
        modes[better] = 1
    factors = np.full(across * down, 32 << 8 | 32)  # from green to red and to blue: all of it

    def write(w: Bits) -> None:
        coded = pixels
        if predict:
            w.write(1, 1), w.write(0, 2), w.write(TILE - 2, 3)
            write_pixels(w, 0xFF << 24 | modes << 8, False)
            coded = add_predictions(coded, width, modes, TILE, -1)
        if cross:
            w.write(1, 1), w.write(1, 2), w.write(TILE - 2, 3)
            write_pixels(w, 0xFF << 24 | factors, False)
            coded = add_cross_colour(coded, width, factors, TILE, -1)
        w.write(0, 1)
        write_pixels(w, coded, True)

    return file_of(width, height, write)


def transformed(payload: bytes, width: int = WIDTH) -> list[bytes]:
    """Files of an image with the transforms that may suit it."""
    flat = np.frombuffer(payload, np.uint8).reshape(-1, 3).astype(np.int64)
    pixels = 0xFF << 24 | flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2]
    out = []
    if len(np.unique(pixels[:4096])) <= FEW_COLOURS and len(np.unique(pixels)) <= FEW_COLOURS:
        out.append(with_palette(pixels, width))
    predict = len(pixels) > width and (pixels[width:] == pixels[:-width]).mean() >= REPEATED
    cross = ((flat[:, 0] == flat[:, 1]) & (flat[:, 1] == flat[:, 2])).mean() >= GREY
    if predict:
        out.append(with_tiles(pixels, width, True, False))
    if cross:
        out.append(with_tiles(pixels, width, predict, True))
    return out


# ---------------------------------------------------------------- columns


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and UTF-8 bytes with blanks up to a positive multiple of 192."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (ROW_BYTES - len(raw) % ROW_BYTES if len(raw) % ROW_BYTES or not raw else 0)


def split_files(data: bytes) -> list[bytes]:
    files, at = [], 0
    while at < len(data):
        size = struct.unpack_from("<I", data, at + 4)[0] + 8
        files.append(data[at : at + size])
        at += size
    return files


def write_media(payloads: list[bytes], budget: int = 2 << 20) -> list[bytes]:
    step = ROW_BYTES * MAX_SIDE
    cut = [[p[i : i + step] for i in range(0, len(p), step)] for p in payloads]
    images, done, start, total = [x for c in cut for x in c], [], 0, 0
    for i, x in enumerate(images):
        total += len(x)
        if total >= budget or i + 1 == len(images):  # bounds the working arrays
            plain = encode_many(images[start : i + 1])
            done += [min([f, *transformed(x)], key=len) for f, x in zip(plain, images[start : i + 1], strict=True)]
            start, total = i + 1, 0
    files = iter(done)
    return [b"".join(next(files) for _ in c) for c in cut]


def read_media(media: list[bytes]) -> list[np.ndarray]:
    """Pixel rows (rows x 64 x 3) of each media value."""
    cut = [split_files(m) for m in media]
    images = iter(decode_many([x for c in cut for x in c]))
    return [np.concatenate([next(images) for _ in c]) for c in cut]


def feature(pixels: np.ndarray) -> str:
    """Rows, mean and deviation of each colour, and share of pixels equal to their left neighbour."""
    flat = pixels.reshape(-1, 3).astype(np.int64)
    mean = flat.mean(0)
    spread = np.sqrt(np.maximum((flat**2).mean(0) - mean**2, 0))
    even = (pixels[:, 1:] == pixels[:, :-1]).all(-1).mean()
    return f"rows={len(pixels)};mean={','.join(f'{v:.4f}' for v in mean)};std={','.join(f'{v:.4f}' for v in spread)};even={even:.4f}"


def to_media(df: DataFrame, key: str = "doc_id", column: str = "text", media: str = "media") -> DataFrame:
    """`key`, n_bytes and the WebP file(s) of each text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                rows = [payload_of(t) for t in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([n for n, _ in rows], pa.int64()), pa.array(write_media([p for _, p in rows]), pa.binary())], [key, "n_bytes", media])

    return df.select(key, column).mapInArrow(apply, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, `{media}` binary")


def media_features(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Read stored images back: `key`, n_bytes, digests of the pixels and of the file, and features.

    A null media value gives nulls.
    """
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [x.split()[0] for x in schema.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media):
                stored = part.column(media).to_pylist()
                images = iter(read_media([m for m in stored if m]))
                rows = []
                for m in stored:
                    if not m:
                        rows.append((None,) * 6)
                        continue
                    pixels = next(images)
                    raw = pixels.tobytes()
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(pixels)))
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("n_bytes"), *made], [key, "n_bytes", *names])

    return df.select(key, "n_bytes", media).mapInArrow(apply, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, {schema}")
