"""Operator 2: lossless WebP (VP8L): a writer, and a reader for the whole format.

The reader decodes prefix codes, back-references and the colour cache, with several prefix-code
groups where an image has them, inverts the predictor, cross-colour, subtract-green and palette
transforms and returns the pixel array. The writer stores a payload as 8-bit grey samples, or as a
palette with bundled pixels where at most 16 values occur, with prefix codes and back-references
for runs; ``write_image`` takes the other transforms and the colour cache for any ARGB image.

A payload over IMAGE bytes, or of a size that no width and height of the format give, is stored as
several images, one after the other; no bytes are added, and ``feature`` names each image.

Defined results of ``text_media``: a null or empty text is 64 zero bytes; ids pass through; repeated
rows give repeated rows; other columns are not read; an empty table gives an empty table. A damaged
stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, utf8

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Order in which the lengths of the code-length code are stored. Fixed by the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
MAX_SIDE, MAX_COPY, LONGEST_CODE = 16384, 4096, 15
#: Bytes of a payload that one image holds at most, a multiple of 64 * MAX_SIDE; bounds the memory of a row.
IMAGE = 256 * MAX_SIDE
#: Pixels that the largest distance code reaches back.
MAX_BACK = (1 << 20) - 120
#: Near pixels by distance, then by how far they are to the side, left of the pixel first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
SPAN = 15  # bits that one look-up of the grey reader takes


# ---- bits ---------------------------------------------------------------------------------------


class Bits:
    """Reads little-endian bits from bytes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(16), 0, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 6], "little") >> (at & 7) & (1 << n) - 1

    def peek(self, n: int) -> int:
        at = self.at
        return int.from_bytes(self.data[at >> 3 : at + n + 7 >> 3], "little") >> (at & 7) & (1 << n) - 1


def pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Values of the given bit widths (at most 32) one after the other, low bits first."""
    widths = widths.astype(np.int64)
    if not len(widths) or not (total := int(widths.sum())):
        return b""
    keep = widths > 0
    values, widths = values[keep].astype(np.uint64), widths[keep]
    at = np.cumsum(widths) - widths
    word, shift = at >> 5, (at & 31).astype(np.uint64)
    wide = values << shift
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((total >> 5) + 2, np.uint64)
    sums = np.add.reduceat(wide, first)  # bits do not meet, so a sum is an or; the part over 32 bits carries into the next word
    word = word[first]
    out[word] = sums & np.uint64(0xFFFFFFFF)
    out[word + 1] += sums >> np.uint64(32)
    return out.astype("<u4").tobytes()[: (total + 7) // 8]


# ---- prefix codes -------------------------------------------------------------------------------


def code_lengths(weights: list[int], longest: int = LONGEST_CODE) -> list[int]:
    """Huffman lengths; weights are levelled until no code is longer than allowed. 0: not coded."""
    used = [(w, i) for i, w in enumerate(weights) if w > 0]
    out = [0] * len(weights)
    if len(used) == 1:
        out[used[0][1]] = 1
        return out
    floor = 0
    while used:
        heap = [(max(w, floor), i, (i,)) for w, i in used]
        heapq.heapify(heap)
        depth = dict.fromkeys((i for _, i in used), 0)
        while len(heap) > 1:
            (a, i, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            for x in left + right:
                depth[x] += 1
            heapq.heappush(heap, (a + b, i, left + right))
        if max(depth.values()) <= longest:
            for i, d in depth.items():
                out[i] = d
            break
        floor = max(1, 2 * floor, sum(w for w, _ in used) >> longest)
    return out


def canonical(lengths: list[int]) -> list[int]:
    """The code of each symbol, reversed, as it stands in the stream."""
    out, code = [0] * len(lengths), 0
    for n in range(1, max(lengths, default=0) + 1):
        code <<= 1
        for s, x in enumerate(lengths):
            if x == n:
                out[s] = int(f"{code:0{n}b}"[::-1], 2)
                code += 1
    return out


class Code:
    """Decodes one prefix code; a code of one symbol takes no bits."""

    def __init__(self, lengths: tuple[int, ...]):
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            used, lengths = [0], (1,)
        self.only, self.pixels = used[0] if len(used) == 1 else None, 0
        self.width, self.table = 0, [(used[0], 0)]
        if self.only is None:
            if sum(2.0 ** -lengths[s] for s in used) != 1:
                raise ValueError("a prefix code is over- or undersubscribed")
            self.width = max(lengths)
            self.table = [None] * (1 << self.width)
            for s, c in ((s, c) for s, c in enumerate(canonical(list(lengths))) if lengths[s]):
                step = 1 << lengths[s]
                for k in range(c, 1 << self.width, step):
                    self.table[k] = (s, lengths[s])

    @property
    def spans(self) -> list[tuple[bytes, int]]:
        """For each value of the next SPAN bits: the literals that they hold in full and the bits of
        these; 0 bits where another symbol or a longer code comes first."""
        if not hasattr(self, "_spans"):
            # from short windows to long ones: a literal and what the shorter rest holds
            found: list[list[tuple[bytes, int]]] = [[(b"", 0)]]
            for width in range(1, SPAN + 1):
                held = []
                for window in range(1 << width):
                    s, n = self.table[window & (1 << self.width) - 1]
                    if n > width or s >= LITERALS:
                        held.append((b"", 0))
                    else:
                        rest, m = found[width - n][window >> n]
                        held.append((bytes((s,)) + rest, n + m))
                found.append(held)
            self._spans = found[SPAN]
        return self._spans


@lru_cache(256)
def _code(lengths: tuple[int, ...]) -> Code:
    return Code(lengths)


#: Stored codes met before, by alphabet and first 64 bits: (bits taken, their value, code). Emptied when full.
_MET: dict[tuple[int, int], tuple[int, int, Code]] = {}


def read_code(bits: Bits, alphabet: int) -> Code:
    """The next stored prefix code; one met before is recognised by its bits."""
    key = (alphabet, bits.peek(64))
    if (met := _MET.get(key)) and bits.at + met[0] <= bits.end and bits.peek(met[0]) == met[1]:
        bits.at += met[0]
        return met[2]
    start = bits.at
    code = _read_code(bits, alphabet)
    used, bits.at = bits.at - start, start
    if len(_MET) >= 256:
        _MET.clear()
    _MET[key] = used, bits.peek(used), code
    bits.at = start + used
    return code


def _read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):  # one or two symbols
        two, wide = bits.read(1), bits.read(1)
        for s in [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else []):
            if s >= alphabet:
                raise ValueError("a symbol is outside its alphabet")
            lengths[s] = 1
        return _code(tuple(lengths))
    order = [0] * len(LENGTH_ORDER)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        order[k] = bits.read(3)
    meta, left = _code(tuple(order)), alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    s, last = 0, 8
    while s < alphabet and left:
        left -= 1
        n = read_symbol(bits, meta)
        if n < 16:
            lengths[s] = n
            s, last = s + 1, n or last
            continue
        value, count = (last, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
        if s + count > alphabet:
            raise ValueError("code lengths run over")
        lengths[s : s + count] = [value] * count
        s += count
    return _code(tuple(lengths))


def read_symbol(bits: Bits, code: Code) -> int:
    at = bits.at
    s, n = code.table[int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & (1 << code.width) - 1]
    bits.at = at + n
    if bits.at > bits.end:
        raise ValueError("the stream ends early")
    return s


def read_extra(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = prefix - 2 >> 1
    return (2 + (prefix & 1) << n) + bits.read(n) + 1


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, their number) of a copy length or distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & (1 << n) - 1, n


# ---- reading ------------------------------------------------------------------------------------


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups_at, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        groups_at = (_read_pixels(bits, across, -(-height >> block), False) >> 8 & 0xFFFF).tolist()
    sizes = (LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCE_CODES)
    groups = [tuple(read_code(bits, n) for n in sizes) for _ in range(max(groups_at) + 1 if groups_at else 1)]
    total = width * height
    green, red, blue, alpha, far = groups[0]
    if len(groups) == 1 and not cache_bits and None not in (red.only, blue.only, alpha.only):
        base = alpha.only << 24 | red.only << 16 | blue.only
        return np.frombuffer(_read_green(bits, green, far, width, total), np.uint8).astype(np.uint32) << 8 | np.uint32(base)
    out, cache, cached = [], [0] * (1 << cache_bits if cache_bits else 0), 0
    while (n := len(out)) < total:
        if groups_at:
            green, red, blue, alpha, far = groups[groups_at[(n // width >> block) * across + (n % width >> block)]]
        s = read_symbol(bits, green)
        if s < LITERALS:
            r, b, a = read_symbol(bits, red), read_symbol(bits, blue), read_symbol(bits, alpha)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < LITERALS + LENGTH_CODES:
            count = read_extra(bits, s - LITERALS)
            back = _distance(read_extra(bits, read_symbol(bits, far)), width)
            if back > n or n + count > total:
                raise ValueError("a back-reference leaves the image")
            out += out[n - back : n - back + count] if back >= count else (out[n - back :] * (count // back + 1))[:count]
        else:  # the cache holds all pixels before this one
            for p in out[cached:]:
                cache[(p * CACHE_FACTOR & 0xFFFFFFFF) >> 32 - cache_bits] = p
            cached = n
            out.append(cache[s - LITERALS - LENGTH_CODES])
    return np.array(out, np.uint32)


def _read_green(bits: Bits, green: Code, far: Code, width: int, total: int) -> bytearray:
    """An image in which only green varies: a look-up gives all literals in the next bits."""
    out = bytearray()
    if green.only is not None and green.only < LITERALS:
        return out + bytes([green.only]) * total
    green.pixels += total
    # a table for many literals pays off for large images and for codes that come again and again
    spans = green.spans if green.pixels > 1 << SPAN else None
    data, end, mask = bits.data, bits.end, (1 << SPAN) - 1
    at, left, read = bits.at, total - 3 * SPAN if spans else 0, int.from_bytes
    while len(out) < total:
        # three look-ups take at most 3 * SPAN literals, so none is past the image
        while len(out) < left and at < end:
            word = read(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)
            got, n = spans[word & mask]
            if not n:
                break
            out += got
            word >>= n
            got, m = spans[word & mask]
            out += got
            word >>= m
            got, k = spans[word & mask]
            out += got
            at += n + m + k
        if at > end:
            raise ValueError("the stream ends early")
        bits.at = at
        s = read_symbol(bits, green)
        if s < LITERALS:
            out.append(s)
        else:
            count = read_extra(bits, s - LITERALS)
            back = _distance(read_extra(bits, read_symbol(bits, far)), width)
            size = len(out)
            if back > size or size + count > total:
                raise ValueError("a back-reference leaves the image")
            out += out[size - back : size - back + count] if back >= count else (bytes(out[size - back :]) * (count // back + 1))[:count]
        at = bits.at
    if len(out) != total:
        raise ValueError("pixels run over")
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)  # blue, green, red, alpha


def _argb(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view("<u4")[..., 0]


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p & 255, p >> 8 & 255, p >> 16 & 255, p >> 24


def _joined(parts) -> int:
    b, g, r, a = (0 if x < 0 else 255 if x > 255 else x for x in parts)
    return a << 24 | r << 16 | g << 8 | b


def _select(left: int, top: int, corner: int) -> int:
    to_left = sum(abs(t - c) for t, c in zip(_parts(top), _parts(corner)))
    to_top = sum(abs(x - c) for x, c in zip(_parts(left), _parts(corner)))
    return left if to_left < to_top else top


def _half(a: int, b: int) -> int:
    return a + int((a - b) / 2)


def _predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    match mode:
        case 1: return left
        case 2: return top
        case 3: return right
        case 4: return corner
        case 5: return _average(_average(left, right), top)
        case 6: return _average(left, corner)
        case 7: return _average(left, top)
        case 8: return _average(corner, top)
        case 9: return _average(top, right)
        case 10: return _average(_average(left, corner), _average(top, right))
        case 11: return _select(left, top, corner)
        case 12: return _joined(x + t - c for x, t, c in zip(_parts(left), _parts(top), _parts(corner)))
        case 13: return _joined(_half(m, c) for m, c in zip(_parts(_average(left, top)), _parts(corner)))
    return 0xFF000000


def _predicted(pixels: list[int], n: int, width: int, modes: list[int], across: int, block: int) -> int:
    x, y = n % width, n // width
    if not n:
        return 0xFF000000
    if not y:
        return pixels[n - 1]
    if not x:
        return pixels[n - width]
    return _predict(modes[(y >> block) * across + (x >> block)], pixels[n - 1], pixels[n - width], pixels[n - width - 1], pixels[n - width + 1])


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _cross(argb: np.ndarray, of: np.ndarray, block: int, back: bool) -> np.ndarray:
    """Cross-colour transform, or its inverse."""
    height, width = argb.shape
    each = _channels(of)[np.arange(height)[:, None] >> block, np.arange(width)[None] >> block].view(np.int8).astype(np.int32)
    green_red, green_blue, red_blue = each[..., 0], each[..., 1], each[..., 2]
    c = _channels(argb).astype(np.int32)
    signed = lambda x: (x & 255 ^ 128) - 128
    sign, green, red = (1 if back else -1), signed(c[..., 1]), c[..., 2].copy()
    moved = red + sign * (green_red * green >> 5)
    c[..., 2] = moved
    c[..., 0] += sign * ((green_blue * green >> 5) + (red_blue * signed(moved if back else red) >> 5))
    return _argb((c & 255).astype(np.uint8))


def read_image(data: bytes) -> np.ndarray:
    """The ARGB pixel array (height x width) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, across = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            undo.append((kind, across, block, _read_pixels(bits, -(-across >> block), -(-height >> block), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(_read_pixels(bits, n, 1, False)), axis=0, dtype=np.uint8)
            bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, across, bundle, _argb(table)))
            across = -(-across >> bundle)
        else:
            undo.append((kind, across, 0, None))
    pixels = _read_pixels(bits, across, height, True).reshape(height, across)
    for kind, across, block, extra in reversed(undo):
        if kind == SUBTRACT_GREEN:
            c = _channels(pixels).copy()
            c[..., 0] += c[..., 1]
            c[..., 2] += c[..., 1]
            pixels = _argb(c)
        elif kind == PALETTE:
            index = pixels >> 8 & 255
            if block:
                size = 8 >> block
                index = (index[..., None] >> np.arange(0, 8, size, dtype=np.uint32) & (1 << size) - 1).reshape(height, -1)[:, :across]
            pixels = np.append(extra, np.zeros(256, np.uint32))[index]
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, extra.reshape(-(-height >> block), -1), block, True)
        else:
            modes, wide = (extra >> 8 & 15).tolist(), -(-across >> block)
            flat = pixels.ravel().tolist()
            for n, residual in enumerate(flat):
                flat[n] = _add(residual, _predicted(flat, n, across, modes, wide, block))
            pixels = np.array(flat, np.uint32).reshape(height, across)
    return pixels


# ---- writing ------------------------------------------------------------------------------------


class Out:
    def __init__(self):
        self.values, self.widths = [], []

    def put(self, value: int, width: int) -> None:
        while width > 24:
            self.values.append(value & 0xFFFFFF)
            self.widths.append(24)
            value, width = value >> 24, width - 24
        self.values.append(value)
        self.widths.append(width)


def _put_code(out: Out, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used, default=0) < 256:
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(used[0] > 1, 1)
        out.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    if len(used) == 1:  # one symbol over 255: a neighbour completes the code
        lengths = list(lengths)
        lengths[used[0] - 1] = 1
    runs: list[tuple[int, int, int]] = []  # (length symbol, extra, extra bits)
    at = 0
    while at < len(lengths):
        n = 1
        while at + n < len(lengths) and lengths[at + n] == lengths[at] and n < 138:
            n += 1
        if lengths[at] or n < 3:
            runs.append((lengths[at], 0, 0))
            at += 1
        else:
            runs.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
            at += n
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    if sum(x > 0 for x in counts) == 1:
        counts[0 if not counts[0] else 1] = 1
    meta = code_lengths(counts, 7)
    codes = canonical(meta)
    n = max(k for k, s in enumerate(LENGTH_ORDER) if meta[s]) + 1
    out.put(0, 1)
    out.put(max(n, 4) - 4, 4)
    for s in LENGTH_ORDER[: max(n, 4)]:
        out.put(meta[s], 3)
    out.put(0, 1)
    for s, extra, width in runs:
        out.put(codes[s], meta[s])
        out.put(extra, width)


def _put_pixels(out: Out, argb: list[int], width: int, main: bool, cache_bits: int = 0, copies: bool = False) -> None:
    """An entropy-coded image with codes made for it."""
    ops: list[tuple] = []
    cache: dict[int, int] = {}
    last: dict[tuple, int] = {}
    at = 0
    key = lambda p: (p * CACHE_FACTOR & 0xFFFFFFFF) >> 32 - cache_bits
    while at < len(argb):
        n, seen = 0, None
        if copies and at + 3 < len(argb):
            seen = last.get(tuple(argb[at : at + 3]))
            if seen is not None and at - seen > MAX_BACK:  # no distance code reaches so far
                seen = None
            while seen is not None and at + n < len(argb) and n < MAX_COPY and argb[seen + n] == argb[at + n]:
                n += 1
        if n >= 3:
            ops.append((n, at - seen))
        else:
            n = 1
            ops.append((None, key(argb[at])) if cache_bits and cache.get(key(argb[at])) == argb[at] else (argb[at],))
        for k in range(at, at + n):
            last[tuple(argb[k : k + 3])] = k
            if cache_bits:
                cache[key(argb[k])] = argb[k]
        at += n
    tally = [[0] * n for n in (LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCE_CODES)]
    near = {d: k for k, d in reversed([(k, max(1, x + y * width)) for k, (x, y) in enumerate(NEAR, 1)])}
    coded = []
    for op in ops:
        if len(op) == 1:
            b, g, r, a = _parts(op[0])
            coded.append(((0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)))
        elif op[0] is None:
            coded.append(((0, LITERALS + LENGTH_CODES + op[1], 0, 0),))
        else:
            (s, x, n), (d, y, m) = prefix_of(op[0]), prefix_of(near.get(op[1], op[1] + len(NEAR)))
            coded.append(((0, LITERALS + s, x, n), (4, d, y, m)))
        for which, s, _, _ in coded[-1]:
            tally[which][s] += 1
    out.put(cache_bits > 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    lengths = [code_lengths(x) for x in tally]
    for x in lengths:
        _put_code(out, x)
    codes, single = [canonical(x) for x in lengths], [sum(n > 0 for n in x) == 1 for x in lengths]
    for k, x in enumerate(lengths):
        if single[k] and max(s for s, n in enumerate(x) if n) >= 256:  # see _put_code
            s = next(s for s, n in enumerate(x) if n)
            single[k], codes[k][s] = False, 1
    for symbols in coded:
        for which, s, extra, n in symbols:
            if not single[which]:
                out.put(codes[which][s], lengths[which][s])
            out.put(extra, n)


def _file(stream: bytes) -> bytes:
    body = b"\x2f" + stream
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _header(out: Out, width: int, height: int, alpha: bool) -> None:
    for value, n in ((width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        out.put(value, n)


def write_image(argb: np.ndarray, modes: np.ndarray | None = None, colours: np.ndarray | None = None, block: int = 2, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, copies: bool = True) -> bytes:
    """A lossless WebP file of any ARGB image. ``modes`` (predictors) and ``colours`` (cross-colour
    elements) hold one value for each block of ``2 ** block`` pixels a side."""
    argb = np.ascontiguousarray(argb, np.uint32)
    height, width = argb.shape
    out = Out()
    _header(out, width, height, True)
    across = width
    if palette:
        table, index = np.unique(argb, return_inverse=True)
        if len(table) > 256:
            raise ValueError("a palette has at most 256 colours")
        bundle = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(table) - 1, 8)
        _put_pixels(out, _argb(np.diff(_channels(table), axis=0, prepend=np.zeros((1, 4), np.uint8))).tolist(), len(table), False)
        across = -(-width >> bundle)
        index = np.pad(index.reshape(height, width).astype(np.uint32), ((0, 0), (0, (across << bundle) - width)))
        argb = (index.reshape(height, across, -1) << np.arange(0, 8, 8 >> bundle, dtype=np.uint32)).sum(axis=2, dtype=np.uint32) << 8 | np.uint32(0xFF000000)
    if modes is not None:
        out.put(1, 1)
        out.put(PREDICTOR, 2)
        out.put(block - 2, 3)
        wide = -(-across >> block)
        _put_pixels(out, (modes.ravel().astype(np.uint32) << 8 | np.uint32(0xFF000000)).tolist(), wide, False)
        flat, of = argb.ravel().tolist(), modes.ravel().tolist()
        guess = np.array([_predicted(flat, n, across, of, wide, block) for n in range(len(flat))], np.uint32).reshape(argb.shape)
        argb = _argb(_channels(argb) - _channels(guess))
    if colours is not None:
        out.put(1, 1)
        out.put(CROSS_COLOUR, 2)
        out.put(block - 2, 3)
        _put_pixels(out, colours.ravel().tolist(), colours.shape[1], False)
        argb = _cross(argb, colours, block, False)
    if subtract_green:
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
        c = _channels(argb).copy()
        c[..., 0] -= c[..., 1]
        c[..., 2] -= c[..., 1]
        argb = _argb(c)
    out.put(0, 1)
    _put_pixels(out, argb.ravel().tolist(), across, True, cache_bits, copies)
    return _file(pack(np.array(out.values, np.uint64), np.array(out.widths)))


def _profile(order: bytes, rest: bytes, low: bool) -> list[int]:
    """Code lengths for text: weights fall along ``order``, then stand for other bytes."""
    weights = [1] * (LITERALS + LENGTH_CODES)
    for b in rest:
        weights[b] = 6
    if low:
        for b in range(128, 192):
            weights[b] = 24
        weights[0xC3] = 260
    for k, b in enumerate(order):
        weights[b] = 1400 // (k + 2)
    return code_lengths(weights)


@lru_cache(1)
def _profiles() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Prefix codes known beforehand, so that a reader's tables serve all images: English-like text,
    other Latin text, and bytes of any kind. The first two lists are the frequent bytes in order.
    Returned: the bits of each byte by profile, and lengths, codes and the stored header of each."""
    shown = bytes(range(32, 127)) + b"\n"
    found = []
    for lengths in (
        _profile(b" etnhaorsidlu.b,\nwgycfpmv", shown, False),
        _profile(b" eniratusochdldzb.pmg,\nv", shown, True),
        code_lengths([8] * LITERALS + [1] * LENGTH_CODES),
    ):
        out = Out()
        # no alpha, version 0; subtract green; no further transform, no colour cache, one group of codes
        for value, n in ((0, 1), (0, 3), (1, 1), (SUBTRACT_GREEN, 2), (0, 1), (0, 1), (0, 1)):
            out.put(value, n)
        _put_code(out, lengths)
        for only in (0, 0, 255):
            _put_code(out, [int(s == only) for s in range(256)])
        _put_code(out, [int(s == _ONE_BACK[0]) for s in range(DISTANCE_CODES)])
        found.append((np.array(lengths), np.array(canonical(lengths), np.uint64), np.array(out.values, np.uint64), np.array(out.widths)))
    return np.array([f[0][:256] for f in found]), found


#: The distance code of one pixel to the left.
_ONE_BACK = prefix_of(NEAR.index((1, 0)) + 1)


def shape_of(n: int) -> tuple[int, int]:
    """(height, width) of n samples, a multiple of 64; the width is the least that keeps to the format's sides."""
    width = 64 * -(-n // (64 * MAX_SIDE))
    while n % width:
        width += 64
    if width > MAX_SIDE:
        raise ValueError("a payload of this size does not fit one image")
    return n // width, width


def _runs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, how many) of samples: literals and, for runs of 8 or more, copies from one pixel back,
    whose extra bits end with those of the distance."""
    symbols = samples.astype(np.int16)
    extra, widths = np.zeros(len(samples), np.uint32), np.zeros(len(samples), np.uint8)
    starts = np.flatnonzero(np.diff(symbols, prepend=-1))
    counts = np.diff(np.append(starts, len(samples)))
    long = np.flatnonzero(counts >= 8)
    if not long.size:
        return symbols, extra, widths
    _, back, n_back = _ONE_BACK
    # a run: one literal, then copies of MAX_COPY pixels and the rest
    starts, left = starts[long], counts[long] - 1
    parts = -(-left // MAX_COPY)
    run = np.repeat(np.arange(len(starts)), parts)
    number = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(MAX_COPY, left[run] - number * MAX_COPY)
    sizes, which = np.unique(size, return_inverse=True)
    coded = np.array([prefix_of(int(n)) for n in sizes])[which]
    spot = starts[run] + 1 + number
    keep = np.ones(len(samples), bool)
    inside = np.zeros(len(samples) + 1, np.int32)
    np.add.at(inside, starts + 1, 1)
    np.add.at(inside, starts + 1 + left, -1)
    keep &= np.cumsum(inside[:-1]) == 0
    keep[spot] = True
    symbols[spot], extra[spot], widths[spot] = LITERALS + coded[:, 0], coded[:, 1] | back << coded[:, 2], coded[:, 2] + n_back
    return symbols[keep], extra[keep], widths[keep]


def _palette_header(table: np.ndarray, lengths: list[int]) -> Out:
    """What comes before the pixels: no alpha, a palette of grey values, and one group of codes, of which only green has more than one symbol."""
    out = Out()
    for value, n in ((0, 1), (0, 3), (1, 1), (PALETTE, 2), (len(table) - 1, 8)):
        out.put(value, n)
    colours = table.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)
    _put_pixels(out, _argb(np.diff(_channels(colours[:, None]), axis=0, prepend=np.zeros((1, 1, 4), np.uint8))).ravel().tolist(), len(table), False)
    for value, n in ((0, 1), (0, 1), (0, 1)):  # no further transform, no colour cache
        out.put(value, n)
    _put_code(out, lengths)
    for only in (0, 0, 255):
        _put_code(out, [int(k == only) for k in range(256)])
    _put_code(out, [int(k == _ONE_BACK[0]) for k in range(DISTANCE_CODES)])
    return out


def write_samples(payload: bytes) -> bytes:
    """Bytes as a grey image, R = G = B = the byte; the same bytes give the same file."""
    samples = np.frombuffer(payload, np.uint8)
    height, width = shape_of(len(samples))
    tally = np.bincount(samples, minlength=256)
    table = np.flatnonzero(tally)
    if len(table) <= 16:  # a palette: some pixels share a byte
        bundle = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1
        index = np.zeros(256, np.uint8)
        index[table] = np.arange(len(table))
        shifts = np.arange(0, 8, 8 >> bundle, dtype=np.uint8)
        # the width is a multiple of 64, so every row fills its bytes
        symbols, extra, n_extra = _runs((index[samples].reshape(-1, len(shifts)) << shifts).sum(axis=1, dtype=np.uint8))
        of_each = np.bincount(symbols, minlength=LITERALS + LENGTH_CODES).tolist()
        lengths = code_lengths(of_each)
        out = _palette_header(table, lengths)
        header, header_widths = np.array(out.values, np.uint64), np.array(out.widths)
        if np.count_nonzero(of_each) == 1:  # a code of one symbol takes no bits
            lengths = [0] * len(lengths)
        lengths, codes = np.array(lengths), np.array(canonical(lengths) if any(lengths) else lengths, np.uint64)
    else:
        each, profiles = _profiles()
        lengths, codes, header, header_widths = profiles[int(np.argmin(each @ tally))]
        symbols, extra, n_extra = _runs(samples)
    widths = lengths[symbols]
    values = codes[symbols] | extra.astype(np.uint64) << widths.astype(np.uint64)
    sides = np.array([width - 1, height - 1], np.uint64)
    return _file(pack(np.concatenate([sides, header, values]), np.concatenate([[14, 14], header_widths, widths + n_extra])))


def read_samples(data: bytes) -> bytes:
    return (read_image(data) & 255).astype(np.uint8).tobytes()


def cuts(n: int) -> list[int]:
    """Sizes of the images that hold a payload of n bytes, a multiple of 64: one image if it is at most
    IMAGE bytes and has a shape, else whole images of IMAGE bytes, then columns of full height, then the rest."""
    found = [IMAGE] * ((n - 1) // IMAGE)
    left = n - IMAGE * len(found)
    try:
        shape_of(left)
    except ValueError:
        tail = left % (64 * MAX_SIDE)  # not 0, since full columns have a shape
        return [*found, left - tail, tail]
    return [*found, left]


def write_media(payload: bytes) -> bytes:
    """A payload of any size as one file, or as several, one after the other (``cuts``)."""
    ends = np.cumsum(cuts(len(payload))).tolist()
    return b"".join(write_samples(payload[at:end]) for at, end in zip([0, *ends], ends))


def images(media: bytes) -> Iterator[np.ndarray]:
    """The pixel arrays of the files that follow each other in ``media``."""
    at = 0
    while at < len(media) or not at:
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield read_image(media[at:end])
        at = end


# ---- on documents -------------------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def features(pixels: np.ndarray) -> str:
    """Size, mean, deviation, number of values, entropy and mean step to the right and down of the grey samples."""
    grey = (pixels & 255).astype(np.uint8)
    tally = np.bincount(grey.ravel(), minlength=256)
    share = tally[tally > 0] / grey.size
    values = np.arange(256)
    mean = int(tally @ values) / grey.size
    spread = max(0.0, int(tally @ (values * values)) / grey.size - mean * mean) ** 0.5
    wide = grey.astype(np.int16)
    across = int(np.abs(np.diff(wide, axis=1)).sum()) / grey.size
    down = int(np.abs(np.diff(wide, axis=0)).sum()) / grey.size
    return f"{grey.shape[1]}x{grey.shape[0]} mean={mean:.4f} sd={spread:.4f} values={share.size} entropy={float(-(share * np.log2(share)).sum()):.4f} dx={across:.4f} dy={down:.4f}"


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media binary)``: each text's padded bytes as lossless WebP, one file or several."""
    out = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    found = map_rows(docs, [id_col, text_col], lambda i, t: (i, len(utf8(t)), write_media(padded(utf8(t)))), "id long, n_bytes long, media binary", out, rows=64)
    return found.withColumnRenamed("id", id_col)


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Pixel arrays read back from the files: ``(id, image, height, width, pixels array<int>)``, ARGB as
    signed 32-bit integers, rows from the top; a row for each image of the media, numbered from 0. A null
    file gives one row of nulls."""
    out = pa.schema([("id", pa.int64()), ("image", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if data is None:
                    yield i, None, None, None, None
                else:
                    for n, pixels in enumerate(images(data)):
                        yield i, n, *pixels.shape, pixels.astype(np.int32).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for row in rows(batches):
            part.append(row)
            size += 0 if row[4] is None else len(row[4])
            if len(part) == 16 or size >= IMAGE:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), out)], schema=out)
                part, size = [], 0
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), out)], schema=out)

    found = media.select(id_col, media_col).mapInArrow(run, "id long, image int, height int, width int, pixels array<int>")
    return found.withColumnRenamed("id", id_col)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as media, read the stored file back and digest what was read."""

    def row(i: int, text: str | None) -> tuple:
        data = utf8(text)
        media = write_media(padded(data))
        n_got, digest, found = 0, hashlib.sha256(), []
        for pixels in images(media):
            got = (pixels & 255).astype(np.uint8).tobytes()
            n_got += len(got)
            digest.update(got)
            found.append(features(pixels))
        return i, len(data), n_got, digest.hexdigest(), zlib.crc32(got[-64:]), len(media), hashlib.sha256(media).hexdigest(), "; ".join(found)

    out = pa.schema(
        [("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(docs, [id_col, text_col], row, schema, out, rows=64).withColumnRenamed("id", id_col)
