"""Lossless WebP (VP8L): a decoder for the whole format and a writer of 8-bit samples.

The decoder reads prefix codes (simple and normal, one group or a meta image of groups), back-references, the colour
cache and all four transforms, and returns the pixels as an array of ARGB bytes. Where only green varies, the code at
every bit position is looked up by array operations and the chain of codes is followed; every other image is read symbol
by symbol.

The writer stores samples as green: as a palette where there are few values, as differences to the left neighbour
(predictor) where these are more regular, with back-references to earlier runs and prefix codes by frequency.
"""

from __future__ import annotations

import struct
import sys
from functools import cache

import numpy as np

MOST = 16384  # largest width and height of the format
WIDTH = 64
FRAME = WIDTH * MOST  # samples of one image at most; longer payloads are several images
LONGEST_CODE, LEAST_COPY, FARTHEST = 15, 10, 1_000_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # odd, so that a product's high bits hash all of a number
#: Fixed: order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Neighbours that distance codes 1 to 120 name: by distance, then by column, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


def _reversals() -> list[np.ndarray]:
    """For each width the numbers with their bits in reverse order."""
    made = [np.zeros(1, np.int64)]
    for _ in range(LONGEST_CODE):
        made.append(np.concatenate((2 * made[-1], 2 * made[-1] + 1)))
    return made


_REVERSED = _reversals()


class Bits:
    """A reader of bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        a = self.at
        if a + n > self.end:
            raise ValueError("the bit stream ends too early")
        self.at = a + n
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)

    def array(self, n: int) -> np.ndarray:
        """The next n bits, one per element."""
        a = self.at
        if a + n > self.end:
            raise ValueError("the bit stream ends too early")
        self.at = a + n
        raw = np.frombuffer(self.data, np.uint8, (a + n + 7 >> 3) - (a >> 3), a >> 3)
        return np.unpackbits(raw, bitorder="little")[a & 7 : (a & 7) + n]


class Code:
    """A prefix code from its lengths: `fixed` is its length if all used symbols share one, 0 for a single symbol."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            used, lengths = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.symbols, self.fixed = used, None
        if len(used) == 1:
            self.fixed = 0
            return
        n = self.lengths = lengths[used]
        if int((1 << LONGEST_CODE - n).sum()) != 1 << LONGEST_CODE:
            raise ValueError("a prefix code is not complete")
        if n.min() == n.max():
            self.fixed = int(n[0])
        self.table: dict[tuple[int, int], int] | None = None

    def _fill(self) -> dict[tuple[int, int], int]:
        self.table, code, last = {}, 0, 0
        for i in np.lexsort((self.symbols, self.lengths)):
            code <<= int(self.lengths[i]) - last
            last = int(self.lengths[i])
            self.table[last, code] = int(self.symbols[i])
            code += 1
        return self.table

    def window(self) -> tuple[int, np.ndarray, np.ndarray]:
        """(width, symbol, length) by the next `width` bits, whatever follows the code in them."""
        if self.fixed == 0:
            return 0, self.symbols[:1], np.zeros(1, np.int64)
        order = np.argsort(self.lengths, kind="stable")
        n = self.lengths[order]
        width = int(n[-1])
        row, times = _REVERSED[width], 1 << width - n
        return width, np.repeat(self.symbols[order], times)[row], np.repeat(n, times)[row]

    def read(self, bits: Bits) -> int:
        if self.fixed == 0:
            return int(self.symbols[0])
        code, table = 0, self.table or self._fill()
        for n in range(1, 16):
            code = code << 1 | bits.read(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such prefix code")


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):  # simple: one or two symbols
        lengths = np.zeros(size, np.int64)
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    of_lengths = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    if of_lengths.fixed == 1 and of_lengths.symbols[-1] < 16 and left == size:
        return Code(of_lengths.symbols[bits.array(size)])
    i, before, at, lengths = 0, 8, bits.at, [0] * size
    width, symbol, length = of_lengths.window()
    symbol, length, mask = symbol.tolist(), length.tolist(), (1 << width) - 1
    ahead = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 2 * size + 8], "little") >> (at & 7)  # 14 bits a symbol at most
    while i < size and left:
        left -= 1
        s, used = symbol[ahead & mask], length[ahead & mask]
        ahead >>= used
        at += used
        if s < 16:
            lengths[i] = s
            before = s or before
            i += 1
            continue
        more, least, value = ((2, 3, before), (3, 3, 0), (7, 11, 0))[s - 16]
        n = least + (ahead & (1 << more) - 1)
        ahead >>= more
        at += more
        if i + n > size:
            raise ValueError("too many code lengths")
        if value:
            lengths[i : i + n] = [value] * n
        i += n
    if at > bits.end:
        raise ValueError("the bit stream ends too early")
    bits.at = at
    return Code(np.array(lengths))


def _amount(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: Bits, w: int, h: int, main: bool) -> np.ndarray:
    """Pixels as 32-bit ARGB, still transformed."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of this size is not allowed")
    meta, shift = None, 0
    if main and bits.read(1):
        shift = 2 + bits.read(3)
        meta = _read_image(bits, w + (1 << shift) - 1 >> shift, h + (1 << shift) - 1 >> shift, False) >> 8 & 0xFFFF
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(bits, n) for n in sizes] for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    total = w * h
    if len(groups) == 1 and not cache_bits:
        made = _read_green(bits, groups[0], total, w)
        if made is not None:
            return made.reshape(h, w)
    out, cache, at = np.zeros(total, np.uint32), [0] * (1 << cache_bits), 0
    fed = 0
    while at < total:
        g = groups[int(meta[at // w >> shift, at % w >> shift])] if meta is not None else groups[0]
        s = g[0].read(bits)
        if s < 256:
            red, blue, alpha = g[1].read(bits), g[2].read(bits), g[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            n = _amount(bits, s - 256)
            far = _amount(bits, g[4].read(bits))
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * w)
            if far > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            if far >= n:
                out[at : at + n] = out[at - far : at - far + n]
            else:
                out[at : at + n] = np.resize(out[at - far : at], n)
            at += n
        else:
            while fed < at:
                argb = int(out[fed])
                cache[(0x1E35A7BD * argb & 0xFFFFFFFF) >> 32 - cache_bits] = argb
                fed += 1
            out[at] = cache[s - 280]
            at += 1
    return out.reshape(h, w)


@cache
def _near(w: int) -> np.ndarray:
    """Pixels back for distance codes up to 120; widths are 16384 at most."""
    return np.array([0, *(max(1, x + y * w) for x, y in NEAR)])


def _far(code: np.ndarray, w: int) -> np.ndarray:
    """Pixels back for distance codes."""
    return np.where(code > 120, code - 120, _near(w)[np.minimum(code, 120)])


def _chain(size: np.ndarray, at: int, most: int) -> np.ndarray:
    """Positions of at most `most` codes from `at` on, when the code at position i is size[i] long. Four are passed at once."""
    n, number = len(size), np.arange(len(size))
    one, two = np.zeros(n + 256, np.uint8), np.zeros(n + 256, np.uint8)
    one[:n] = size
    two[:n] = size + one[number + size]
    four = (two[:n] + two[number + two[:n]]).tobytes()
    found: list[int] = []
    add = found.append
    try:
        for _ in range(-(-most // 4)):
            step = four[at]
            add(at)
            at += step
    except IndexError:
        pass
    first = np.array(found, np.int64)
    out = np.empty((len(first), 4), np.int64)
    out[:, 0] = first
    out[:, 1] = first + one[first]
    out[:, 2] = first + two[first]
    out[:, 3] = out[:, 2] + one[np.minimum(out[:, 2], len(size))]
    out = out.ravel()[:most]
    return out[: int(np.searchsorted(out, len(size), "left"))]


def _read_green(bits: Bits, group: list[Code], total: int, w: int) -> np.ndarray | None:
    """All pixels, if red, blue and alpha have one value each: codes are looked up at every bit, then chained."""
    if any(c.fixed != 0 for c in group[1:4]):
        return None
    red, blue, alpha = (int(c.symbols[0]) for c in group[1:4])
    base = np.uint32(alpha << 24 | red << 16 | blue)
    if group[0].fixed == 0:
        return np.full(total, base | np.uint32(int(group[0].symbols[0]) << 8), np.uint32) if group[0].symbols[0] < 256 else None
    first = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8, offset=first).astype(np.uint32)
    raw = np.concatenate((raw, np.zeros(12, np.uint32)))
    four = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    peek = (four[:, None] >> np.arange(8, dtype=np.uint32)).ravel()  # the next 25 bits or more at every bit
    n = 8 * (len(raw) - 12)
    width, symbol, length = group[0].window()
    index = (peek[:n] & np.uint32((1 << width) - 1)).astype(np.intp)
    marked = (length + 128 * (symbol > 255)).astype(np.uint8)[index]
    copies = np.flatnonzero(marked > 127)
    size = marked & np.uint8(127)
    lengths = far = None
    if len(copies) and group[0].symbols[-1] > 255:

        def amounts(at, prefix):
            """Values of prefixes whose extra bits begin at `at`, and how many bits these are."""
            extra = np.maximum(prefix - 2, 0) >> 1
            value = peek[np.minimum(at, len(peek) - 1)].astype(np.int64) & (1 << extra) - 1
            return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + value + 1), extra

        at = copies + size[copies]
        lengths, extra = amounts(at, symbol[index[copies]] - 256)
        at = at + extra
        dwidth, dsymbol, dlength = group[4].window()
        dindex = (peek[np.minimum(at, len(peek) - 1)] & np.uint32((1 << dwidth) - 1)).astype(np.intp)
        at = at + dlength[dindex]
        far, dextra = amounts(at, dsymbol[dindex])
        size[copies] = np.minimum(at + dextra - copies, 63)
    place = _chain(size, bits.at - 8 * first, total)
    green = symbol[index[place]]
    again = np.flatnonzero(green > 255)
    amount = None
    if far is not None:
        known = np.searchsorted(copies, place[again])
        amount = np.ones(len(place), np.int64)
        amount[again] = lengths[known]
        ends = np.cumsum(amount)
        place = place[: int(np.searchsorted(ends, total, "left")) + 1]
        amount, green = amount[: len(place)], green[: len(place)]
        again = again[: int(np.searchsorted(again, len(place)))]
        far = _far(far[known[: len(again)]], w)
        if len(ends) >= len(place) and ends[len(place) - 1] > total:
            raise ValueError("a back-reference leaves the image")
    if (len(place) if far is None else int(amount.sum())) < total or (last := int(place[-1]) + int(size[place[-1]])) > n:
        raise ValueError("the bit stream ends too early")
    bits.at = 8 * first + last
    if far is None:
        return base | green.astype(np.uint32) << np.uint32(8)
    to = np.cumsum(amount) - amount
    out = np.zeros(total, np.uint16)
    literal = green < 256
    out[to[literal]] = green[literal]
    for a, m, d in zip(to[again].tolist(), amount[again].tolist(), far.tolist(), strict=True):
        if d > a:
            raise ValueError("a back-reference leaves the image")
        out[a : a + m] = out[a - d : a - d + m] if d >= m else np.resize(out[a - d : a], m)
    return base | out.astype(np.uint32) << np.uint32(8)


def _bytes(pixels: np.ndarray) -> np.ndarray:
    """ARGB pixels as an array (height, width, 4) of bytes in the order blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _joined(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts).view("<u4").reshape(parts.shape[:2])


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b >> 1


def _predict(mode: int, left, top, corner, right) -> np.ndarray:
    """Predicted (blue, green, red, alpha) of a pixel from its neighbours, as signed numbers."""
    if mode in (0, 14, 15):
        return np.array([0, 0, 0, 255])
    if mode == 11:
        return left if np.abs(left + top - corner - left).sum() < np.abs(left + top - corner - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        return np.clip(mean + np.trunc((mean - corner) / 2).astype(int), 0, 255)
    simple = {1: left, 2: top, 3: right, 4: corner}
    if mode in simple:
        return simple[mode]
    pairs = {6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}
    if mode in pairs:
        return _average(*pairs[mode])
    return _average(_average(left, right), top) if mode == 5 else _average(_average(left, corner), _average(top, right))


def _undo_predictor(pixels: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    h, w = pixels.shape
    out = _bytes(pixels).astype(int)
    used = set(np.unique(modes).tolist())
    out[0, 0] += (0, 0, 0, 255)
    if used <= {1}:  # each row from its left neighbour, the first column from above
        out[:, 0] = np.cumsum(out[:, 0], 0)
        out = np.cumsum(out, 1)
    elif used <= {2}:
        out[0] = np.cumsum(out[0], 0)
        out = np.cumsum(out, 0)
    else:
        out &= 255
        for x in range(1, w):
            out[0, x] = out[0, x] + out[0, x - 1] & 255
        flat = out.reshape(-1, 4)
        for y in range(1, h):
            flat[y * w] = flat[y * w] + flat[(y - 1) * w] & 255
            for x in range(1, w):
                i = y * w + x
                flat[i] = flat[i] + _predict(int(modes[y >> shift, x >> shift]), flat[i - 1], flat[i - w], flat[i - w - 1], flat[i - w + 1]) & 255
    return _joined((out & 255).astype(np.uint8))


def _undo_cross_colour(pixels: np.ndarray, table: np.ndarray, shift: int) -> np.ndarray:
    h, w = pixels.shape
    e = _bytes(np.repeat(np.repeat(table, 1 << shift, 0), 1 << shift, 1)[:h, :w]).view(np.int8).astype(int)
    p = _bytes(pixels).astype(int)
    signed = lambda x: (x + 128 & 255) - 128
    green = signed(p[..., 1])
    red = p[..., 2] + (e[..., 0] * green >> 5) & 255
    blue = p[..., 0] + (e[..., 1] * green >> 5) + (e[..., 2] * signed(red) >> 5) & 255
    p[..., 2], p[..., 0] = red, blue
    return _joined(p.astype(np.uint8))


def _undo_palette(pixels: np.ndarray, colours: np.ndarray, w: int, shift: int) -> np.ndarray:
    index = pixels >> 8 & 255
    if shift:
        n = 8 >> shift
        index = np.stack([index >> n * k & (1 << n) - 1 for k in range(1 << shift)], 2).reshape(len(pixels), -1)[:, :w]
    return np.where(index < len(colours), np.append(colours, 0)[np.minimum(index, len(colours))], 0).astype(np.uint32)


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file as an array (height, width, 4) of the bytes alpha, red, green, blue."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, seen, width = [], set(), w
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind < 2:
            shift = 2 + bits.read(3)
            table = _read_image(bits, width + (1 << shift) - 1 >> shift, h + (1 << shift) - 1 >> shift, False)
            steps.append((kind, table >> 8 & 15 if kind == 0 else table, shift, width))
        elif kind == 2:
            steps.append((2, None, 0, width))
        else:
            n = bits.read(8) + 1
            colours = _joined(np.cumsum(_bytes(_read_image(bits, n, 1, False)), 1, dtype=np.uint8))[0]
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((3, colours, shift, width))
            width = width + (1 << shift) - 1 >> shift
    pixels = _read_image(bits, width, h, True)
    for kind, table, shift, width in reversed(steps):
        if kind == 0:
            pixels = _undo_predictor(pixels, table, shift)
        elif kind == 1:
            pixels = _undo_cross_colour(pixels, table, shift)
        elif kind == 2:
            p = _bytes(pixels).copy()
            p[..., 2] += p[..., 1]
            p[..., 0] += p[..., 1]
            pixels = _joined(p)
        else:
            pixels = _undo_palette(pixels, table, width, shift)
    return _bytes(pixels)[..., ::-1]


def images(data: bytes) -> list[np.ndarray]:
    """All images of a column value, one after the other, as `decode` returns them."""
    out, at = [], 0
    while at < len(data):
        to = at + 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
        out.append(decode(data[at:to]))
        at = to
    return out


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of a prefix code by frequency, none over `longest`."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used]
    while True:
        order = np.argsort(weight, kind="stable").tolist()
        leaves = [*weight[order].tolist(), sys.maxsize, sys.maxsize]
        m = n = len(used)
        made, parent = [sys.maxsize] * m, [0] * (2 * m - 1)
        i = j = 0  # next leaf, next inner node; both come by rising weight, leaves first
        for k in range(m - 1):
            if leaves[i] <= made[j]:
                total = leaves[i]
                parent[order[i]] = n
                i += 1
            else:
                total = made[j]
                parent[m + j] = n
                j += 1
            if leaves[i] <= made[j]:
                total += leaves[i]
                parent[order[i]] = n
                i += 1
            else:
                total += made[j]
                parent[m + j] = n
                j += 1
            made[k] = total
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= longest:
            out[used] = depth[: len(used)]
            return out
        weight = weight // 2 + 1


def code_bits(lengths: np.ndarray) -> np.ndarray:
    """The codes of a canonical prefix code, first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order]
    top = int(n[-1])
    begin = np.cumsum(1 << top - n) - (1 << top - n)  # left-aligned, so reversed codes start at bit 0
    out[order] = _REVERSED[top][begin]
    return out


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits, how many) that store lengths and distance codes."""
    v = value.astype(np.int64) - 1
    high = np.frexp(np.maximum(v, 1).astype(float))[1].astype(np.int64) - 1
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), v & (1 << extra) - 1, extra


def find_copies(x: np.ndarray, least: int = LEAST_COPY) -> list[tuple[int, int, int]]:
    """(start, length, distance) of runs of `least` samples or more that occur before, in order, not overlapping."""
    n = len(x) - 7
    if n < 2:
        return []
    eight = np.ndarray((n,), "<u8", np.ascontiguousarray(x), 0, (1,))
    low = np.uint64((1 << n.bit_length()) - 1)  # a hash with the position below it sorts faster than an argsort
    keyed = np.sort(eight * SPREAD & ~low | np.arange(n, dtype=np.uint64))
    same = np.flatnonzero((keyed[1:] ^ keyed[:-1]) <= low)
    if not len(same):
        return []
    later, before = (keyed[same + 1] & low).astype(np.int64), (keyed[same] & low).astype(np.int64)
    back = np.zeros(n, np.int64)
    back[later] = np.where(eight[later] == eight[before], later - before, 0)
    if n > FARTHEST:
        back[back > FARTHEST] = 0
    cut = np.concatenate(([0], np.flatnonzero(back[1:] != back[:-1]) + 1))
    length = np.append(cut[1:], n) - cut + 7
    good = (back[cut] > 0) & (length >= least)
    out, at = [], 0
    for a, m, d in zip(cut[good].tolist(), length[good].tolist(), back[cut[good]].tolist(), strict=True):
        if a < at:
            a, m = at, m - at + a
        while m >= least:
            out.append((a, min(m, 4096), d))
            a, m = a + min(m, 4096), m - min(m, 4096)
            at = a
    return out


class Writer:
    """Collects bits, least significant first."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.put_many([value], [n])

    def put_many(self, values, widths) -> None:
        self.values.append(np.asarray(values, np.int64))
        self.widths.append(np.asarray(widths, np.int64))

    def put_bits(self, bits: np.ndarray) -> None:
        self.put_many(bits, np.ones(len(bits), np.int64))

    def put_single(self, symbol: int) -> None:
        """A code of one symbol."""
        self.put(1 | 0 << 1 | 1 << 2 | symbol << 3, 11)

    def put_code(self, lengths: np.ndarray) -> None:
        """The lengths of a code of at least one symbol."""
        used = np.flatnonzero(lengths).tolist()
        if len(used) <= 2 and used[-1] < 256:
            self.put_single(used[0]) if len(used) == 1 else self.put(1 | 1 << 1 | 1 << 2 | used[0] << 3 | used[1] << 11, 19)
            return
        symbols, extras, known = [], [], lengths.tolist()  # extras: (place, value, bits) of runs of zeros
        last = -1
        for i in used:
            gap = i - last - 1
            while gap:
                n = min(gap, 138)
                if n > 2:
                    extras.append((len(symbols), n - 11, 7) if n > 10 else (len(symbols), n - 3, 3))
                symbols.append(18 if n > 10 else 17 if n > 2 else 0)
                gap -= n if n > 2 else 1
            symbols.append(known[i])
            last = i
        if last < len(lengths) - 1:
            for n in [138] * ((len(lengths) - 1 - last) // 138) + [(len(lengths) - 1 - last) % 138]:
                if n > 2:
                    extras.append((len(symbols), n - 11, 7) if n > 10 else (len(symbols), n - 3, 3))
                symbols += [18] if n > 10 else [17] if n > 2 else [0] * n
        own = code_lengths(np.bincount(symbols, minlength=19), 7)
        count = max(4, int(np.flatnonzero(own[list(LENGTH_ORDER)])[-1]) + 1)
        self.put(0 | count - 4 << 1, 5)
        self.put_many(own[list(LENGTH_ORDER[:count])], np.full(count, 3))
        self.put(0, 1)
        only = np.count_nonzero(own) < 2
        at = np.array(symbols)
        values, widths = np.zeros(2 * len(at), np.int64), np.zeros(2 * len(at), np.int64)
        values[::2], widths[::2] = code_bits(own)[at], 0 if only else own[at]
        more, *extra = np.array(extras, np.int64).reshape(-1, 3).T
        values[2 * more + 1], widths[2 * more + 1] = extra
        self.put_many(values, widths)

    def put_green(self, x: np.ndarray, main: bool, alpha: int) -> None:
        """An image whose green varies, with back-references; red and blue are 0."""
        self.put(0, 2 if main else 1)  # no colour cache; one group
        copies = find_copies(x)
        start, run, back = (np.array(c, np.int64) for c in zip(*copies, strict=True)) if copies else (np.zeros(0, np.int64),) * 3
        if copies:
            inside = np.zeros(len(x) + 1, np.int8)
            inside[start] = 1
            inside[start + run] -= 1
            held = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)
            lengths, more, extra = prefix_of(run)
            codes, dmore, dextra = prefix_of(back + 120)
            green = np.concatenate((x[held].astype(np.int64), 256 + lengths))
        else:
            green, codes = x.astype(np.int64), start
        own, far = code_lengths(np.bincount(green, minlength=280)), code_lengths(np.bincount(codes, minlength=40))
        self.put_code(own)
        for symbol in (0, 0, alpha):
            self.put_single(symbol)
        self.put_code(far) if copies else self.put_single(0)
        shown, taken = code_bits(own)[green], own[green] if np.count_nonzero(own) > 1 else np.zeros(len(green), np.int64)
        if not copies:
            self.put_many(shown, taken)
            return
        # A copy's code is followed by three more numbers: extra bits of its length, distance code, extra bits of that.
        c = len(held)
        of = np.searchsorted(held, start) + 4 * np.arange(len(start))
        value, width = np.zeros(c + 4 * len(start), np.int64), np.zeros(c + 4 * len(start), np.int64)
        to = np.arange(c) + 4 * np.searchsorted(start, held)
        value[to], width[to], value[of], width[of] = shown[:c], taken[:c], shown[c:], taken[c:]
        value[of + 1], width[of + 1], value[of + 3], width[of + 3] = more, extra, dmore, dextra
        value[of + 2], width[of + 2] = code_bits(far)[codes], far[codes] if np.count_nonzero(far) > 1 else 0
        self.put_many(value, width)

    def put_palette(self, colours: np.ndarray) -> None:
        """Opaque colours that differ in green, each as the difference to the one before."""
        self.put(0, 1)
        green, alpha = np.diff(colours.astype(np.int64), prepend=0) & 255, np.where(np.arange(len(colours)) == 0, 255, 0)
        codes = [code_lengths(np.bincount(c, minlength=n)) for c, n in ((green, 280), (alpha, 256))]
        self.put_code(codes[0])
        self.put_single(0)
        self.put_single(0)
        self.put_code(codes[1])
        self.put_single(0)
        for g, a in zip(green.tolist(), alpha.tolist(), strict=True):
            for symbol, lengths in ((g, codes[0]), (a, codes[1])):
                self.put(int(code_bits(lengths)[symbol]), int(lengths[symbol]) if np.count_nonzero(lengths) > 1 else 0)

    def file(self, w: int, h: int) -> bytes:
        value, width = np.concatenate(self.values), np.concatenate(self.widths)
        full = width > 0
        value, width = value[full], width[full]
        ends = np.cumsum(width)
        begin = ends - width
        word, shifted = begin >> 5, (value & (1 << width) - 1) << (begin & 31)  # at most 32 bits each, so two words of 32
        size = int(ends[-1])
        words = np.zeros((size >> 5) + 2, np.int64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] = np.add.reduceat(shifted & 0xFFFFFFFF, first)
        words[word[first] + 1] += np.add.reduceat(shifted >> 32, first)
        body = words.astype("<u4").tobytes()[: size + 7 >> 3]
        head = struct.pack("<I", w - 1 | h - 1 << 14)
        chunk = b"\x2f" + head + body
        chunk_size, chunk = len(chunk), chunk + b"\0" * (len(chunk) & 1)
        return b"RIFF" + struct.pack("<I", 12 + len(chunk)) + b"WEBPVP8L" + struct.pack("<I", chunk_size) + chunk


def _cost(counts: np.ndarray) -> float:
    """Bits by entropy."""
    c = counts[counts > 0].astype(float)
    return float((c * (np.log2(c.sum()) - np.log2(c))).sum())


def encode_samples(samples: np.ndarray) -> bytes:
    """8-bit samples (a multiple of 64 of them) as the green channel of opaque images 64 wide, row by row."""
    return b"".join(_encode_frame(samples[a : a + FRAME]) for a in range(0, len(samples), FRAME))


def _encode_frame(samples: np.ndarray) -> bytes:
    w, h = WIDTH, len(samples) // WIDTH
    out = Writer()
    counts = np.bincount(samples, minlength=256)
    values = np.flatnonzero(counts)
    if len(values) <= 16:
        out.put(1 | 3 << 1 | len(values) - 1 << 3, 11)  # palette
        out.put_palette(values)
        shift = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
        n = 8 >> shift
        rank = np.searchsorted(values, samples).reshape(h, -1, 1 << shift)
        out.put(0, 1)
        out.put_green((rank << n * np.arange(1 << shift)).sum(2).astype(np.uint8).ravel(), True, 255)
        return out.file(w, h)
    rows = samples.reshape(h, w)
    step = np.diff(rows, axis=1, prepend=rows[:, :1])
    step[1:, 0], step[0, 0] = rows[1:, 0] - rows[:-1, 0], rows[0, 0]
    if _cost(np.bincount(step.ravel())) < 0.95 * _cost(counts):
        out.put(1 | 0 << 1 | 7 << 3, 6)  # predictor in blocks of 512
        out.put(0, 1)
        for symbol in (1, 0, 0, 255, 0):  # one block after the other: the left neighbour
            out.put_single(symbol)
        out.put(0, 1)
        out.put_green(step.ravel(), True, 0)
    else:
        out.put(0, 1)
        out.put_green(samples, True, 255)
    return out.file(w, h)
