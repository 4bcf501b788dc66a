"""Lossless WebP (VP8L): a decoder for whole streams, an encoder, and columns of such images.

The decoder reads prefix codes, literals, back-references and the colour cache, meta prefix codes,
and inverts the predictor, cross-colour, subtract-green and palette transforms. The encoder makes
back-references, prefix codes of differing length, and a colour cache and those transforms where they
make an image smaller.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.llm.common import blocks

#: Bytes of a row of a stored payload, and the most rows of one image; longer payloads take several.
WIDTH, MOST_ROWS = 576, 256
PAD = 255

# Fixed values of the format: the order of code length codes, the near distances as (x, y), the cache's multiplier.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTHS, DISTANCES = 24, 40
#: An opaque black pixel's samples: blue, green, red, alpha.
BLACK = np.array([0, 0, 0, 255], dtype=np.uint8)
#: Pixels that a back-reference copies, and how far back it reaches.
LEAST_COPY, MOST_COPY, MOST_DISTANCE = 3, 4096, (1 << 20) - 120
#: Bits of a field that is written at once, at most.
MOST_BITS = 32
#: Bits of the encoder's colour cache, at most.
CACHE_BITS = 8
#: The encoder's own code for code lengths, the same for all images: bits of each of the 19 symbols.
LENGTH_CODE = (4, 6, 6, 6, 5, 4, 3, 3, 3, 3, 4, 5, 6, 7, 7, 6, 0, 3, 5)
#: What stands before code lengths: a normal code, all 19 lengths, no limit of symbols.
LENGTH_HEAD = ((0, 1), (15, 4), (sum(LENGTH_CODE[s] << 3 * i for i, s in enumerate(CODE_ORDER[:9])), 27), (sum(LENGTH_CODE[s] << 3 * i for i, s in enumerate(CODE_ORDER[9:])), 30), (0, 1))
#: Of each prefix symbol of a length or distance the bits behind it, and the least value.
EXTRA = np.array([0, 0, 0, 0, *((s - 2) >> 1 for s in range(4, DISTANCES))])
LEAST = np.array([1, 2, 3, 4, *((2 + (s & 1) << ((s - 2) >> 1)) + 1 for s in range(4, DISTANCES))])
#: An image of so many pixels is decoded by arrays.
MANY = 256


class Reader:
    """Bits from the lowest of each byte on."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + bytes(16), 0, 8 * len(data)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends early")

    def read(self, n: int) -> int:
        i = self.at
        self.at = i + n
        if self.at > self.end:
            raise ValueError("the image ends early")
        return int.from_bytes(self.data[i >> 3 : (i >> 3) + 8], "little") >> (i & 7) & ((1 << n) - 1)


class Writer:
    def __init__(self) -> None:
        self.fields: list[tuple[np.ndarray, np.ndarray]] = []
        self.small: list[int] = []  # value << 6 | bits

    def write(self, value: int, n: int) -> None:
        self.small.append(value << 6 | n)

    def write_all(self, values: np.ndarray, counts: np.ndarray) -> None:
        """Fields one after the other, counts[i] bits of values[i]; MOST_BITS at most."""
        small = np.array(self.small, dtype=np.int64)
        self.fields += [(small >> 6, small & 63), (values, counts)]
        self.small = []

    def bytes(self) -> bytes:
        self.write_all(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        values, counts = (np.concatenate(x) for x in zip(*self.fields, strict=True))
        self.fields = [(values, counts)]
        begin = np.zeros(len(counts) + 1, dtype=np.int64)
        counts.cumsum(out=begin[1:])
        n = int(begin[-1])
        if not n:
            return b""
        word, here = begin[:-1] >> 5, begin[:-1] & 31
        wide = (values & (1 << counts) - 1) << here
        first = np.concatenate([[0], (word[1:] != word[:-1]).nonzero()[0] + 1])
        words = np.zeros((n >> 5) + 2, dtype=np.int64)
        words[word[first]] = np.add.reduceat(wide & 0xFFFFFFFF, first)
        words[word[first] + 1] += np.add.reduceat(wide >> 32, first)
        return words.astype("<u4").tobytes()[: (n + 7) >> 3]


@lru_cache(maxsize=16)
def mirrored(n: int) -> np.ndarray:
    """Every number of n bits with its bits in reverse."""
    i = np.arange(1 << n)
    return sum((i >> k & 1) << (n - 1 - k) for k in range(n)) if n else i


class PrefixCode:
    """A canonical code from its lengths; one symbol alone takes no bits. both[the next bits & mask] is
    symbol << 4 | length; written has the bits of each symbol as they are written, n their number."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.used = lengths.nonzero()[0]
        self.single = len(self.used) < 2
        self.n = np.zeros(len(lengths), dtype=np.int64) if self.single else lengths
        self.mask = 0
        if not self.single:
            n = lengths[self.used]
            place = n.astype(np.uint8).argsort(kind="stable")
            self.order, self.lengths = self.used[place], n[place]
            most = int(self.lengths[-1])
            self.span = 1 << (most - self.lengths)
            self.ends = self.span.cumsum()
            if self.ends[-1] != 1 << most:
                raise ValueError("a prefix code is not complete")
            self.back, self.mask = mirrored(most), (1 << most) - 1

    @cached_property
    def both(self) -> np.ndarray:
        return np.array([self.used[0] << 4 if len(self.used) else 0]) if self.single else (self.order << 4 | self.lengths).repeat(self.span)[self.back]

    @cached_property
    def sizes(self) -> np.ndarray:
        """The lengths, and 16 for what is a place in the cache, 32 for lengths of back-references."""
        sizes = (self.both & 15).astype(np.uint8)
        if len(self.n) > 256:
            sizes[self.both >= 256 << 4] += 32
            sizes[self.both >= 256 + LENGTHS << 4] -= 16
        return sizes

    @cached_property
    def table(self) -> list[int]:
        return self.both.tolist()

    @cached_property
    def steps(self) -> dict[int, tuple[int, int, bytes, int]]:
        """length_steps() of the bits that were met."""
        return {}

    @cached_property
    def written(self) -> np.ndarray:
        bits = np.zeros(len(self.n), dtype=np.int64)
        if not self.single:
            bits[self.order] = self.back[self.ends - self.span]
        return bits


@lru_cache(maxsize=64)
def code_of_lengths(lengths: tuple[int, ...]) -> PrefixCode:
    return PrefixCode(np.array(lengths, dtype=np.int64))


@lru_cache(maxsize=1024)
def code_of_few(size: int, symbols: tuple[int, ...]) -> PrefixCode:
    """The code of one or two symbols."""
    lengths = np.zeros(size, dtype=np.int64)
    lengths[list(symbols)] = 1
    return PrefixCode(lengths)


def read_code(r: Reader, size: int) -> PrefixCode:
    if r.read(1):
        two = r.read(1)
        symbols = (r.read(8 if r.read(1) else 1), *([r.read(8)] if two else []))
        return code_of_few(size, symbols)
    of_lengths = [0] * 19
    n = 4 + r.read(4)
    bits = r.read(3 * n)
    for i in range(n):
        of_lengths[CODE_ORDER[i]] = bits >> 3 * i & 7
    code = code_of_lengths(tuple(of_lengths))
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    steps, at, before, found = code.steps, 0, 8, bytearray()
    bits = kept = given = 0
    while at < size and left:
        if kept < 16:  # 14 are the most that a step reads
            r.skip(given - kept)
            bits = int.from_bytes(r.data[r.at >> 3 : (r.at >> 3) + 48], "little") >> (r.at & 7)
            kept = given = 48 * 8 - 8
        window = bits & 0x1FFF
        step = steps.get(window)
        if step is None:
            step = steps[window] = length_steps(code, window)
        n, symbols, part, last = step
        if not symbols or symbols > left or at + len(part) > size:
            n, part, last = length_step(code, bits, before)
            symbols = 1
        found += part
        at += len(part)
        left -= symbols
        before = last or before
        bits >>= n
        kept -= n
    r.skip(given - kept)
    if at > size:
        raise ValueError("code lengths run over")
    return PrefixCode(np.frombuffer(found + bytes(size - at), dtype=np.uint8).astype(np.int64))


def length_step(code: PrefixCode, bits: int, before: int) -> tuple[int, bytes, int]:
    """(bits taken, the code lengths that they stand for, the last of these that is not zero, or zero) of one symbol."""
    x = code.table[bits & code.mask]
    n, s = x & 15, x >> 4
    if s < 16:
        return n, bytes([s]), s
    extra = 2 if s == 16 else 3 if s == 17 else 7
    run = (11 if s == 18 else 3) + (bits >> n & (1 << extra) - 1)
    return n + extra, bytes([before if s == 16 else 0]) * run, 0


def length_steps(code: PrefixCode, window: int) -> tuple[int, int, bytes, int]:
    """The same of as many symbols as the 13 bits of the window hold whole, and their number; what
    repeats the length before it ends them."""
    n, symbols, found, last = 0, 0, b"", 0
    while symbols < 13 and code.table[window >> n & code.mask] >> 4 != 16:
        taken, part, some = length_step(code, window >> n, 0)
        if n + taken > 13:
            break
        n, symbols, found, last = n + taken, symbols + 1, found + part, some or last
    return n, symbols, found, last


def blocks_of(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def far_of(code: int, width: int) -> int:
    """The distance in pixels of a distance code: the first ones name near places."""
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, y * width + x)


@lru_cache(maxsize=64)
def near_places(width: int) -> tuple[int, ...]:
    return tuple(far_of(i + 1, width) for i in range(len(NEAR)))


@lru_cache(maxsize=64)
def near_codes(width: int) -> dict[int, int]:
    """The first distance code of each near distance."""
    return {d: i + 1 for i, d in reversed(list(enumerate(near_places(width))))}


def read_pixels(r: Reader, width: int, height: int, main: bool = False) -> np.ndarray:
    """The entropy-coded ARGB pixels."""
    cache_bits = r.read(4) if r.read(1) else 0
    block, which, groups = 0, None, 1
    if main and r.read(1):
        block = r.read(3) + 2
        which = (read_pixels(r, blocks_of(width, block), blocks_of(height, block)) >> 8 & 0xFFFF).tolist()
        groups = max(which) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[read_code(r, n) for n in sizes] for _ in range(groups)]
    if which is None and width * height >= MANY:
        return pixels_by_arrays(r, width, height, cache_bits, codes[0])
    return pixels_one_by_one(r, width, height, cache_bits, codes, block, which)


def pixels_one_by_one(r: Reader, width: int, height: int, cache_bits: int, groups: list[list[PrefixCode]], block: int = 0, which: list[int] | None = None) -> np.ndarray:
    """Symbol by symbol, the codes chosen anew for each block if there are several groups of them."""
    codes = [tuple(x for c in g for x in (c.table, c.mask)) for g in groups]
    green, green_mask, red, red_mask, blue, blue_mask, alpha, alpha_mask, far, far_mask = codes[0]
    out: list[int] = []
    cache, shift, filed = [0] * (1 << cache_bits), 32 - cache_bits, 0
    across, at, total = blocks_of(width, block), 0, width * height
    data, number, near = r.data, int.from_bytes, near_places(width)
    bits = kept = given = 0
    while at < total:
        if which is not None:
            green, green_mask, red, red_mask, blue, blue_mask, alpha, alpha_mask, far, far_mask = codes[which[(at // width >> block) * across + (at % width >> block)]]
        if kept < 76:  # no pixel and no reference has more bits
            r.skip(given - kept)
            bits = number(data[r.at >> 3 : (r.at >> 3) + 32], "little") >> (r.at & 7)
            kept = given = 32 * 8 - 8
        x = green[bits & green_mask]
        n = x & 15
        if x < 256 << 4:
            y = red[bits >> n & red_mask]
            n += y & 15
            z = blue[bits >> n & blue_mask]
            n += z & 15
            a = alpha[bits >> n & alpha_mask] if alpha_mask else alpha[0]
            n += a & 15
            out.append((a >> 4) << 24 | (y & 0xFF0) << 12 | (x & 0xFF0) << 4 | z >> 4)
            at += 1
        elif x >= 256 + LENGTHS << 4:
            for p in out[filed:]:
                cache[(p * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = p
            filed = at
            out.append(cache[(x >> 4) - 256 - LENGTHS])
            at += 1
        else:
            s = (x >> 4) - 256
            if s < 4:
                count = s + 1
            else:
                extra = (s - 2) >> 1
                count = ((2 + (s & 1)) << extra) + (bits >> n & (1 << extra) - 1) + 1
                n += extra
            x = far[bits >> n & far_mask]
            n += x & 15
            s = x >> 4
            if s < 4:
                code = s + 1
            else:
                extra = (s - 2) >> 1
                code = ((2 + (s & 1)) << extra) + (bits >> n & (1 << extra) - 1) + 1
                n += extra
            d = near[code - 1] if code <= len(NEAR) else code - len(NEAR)
            if d > at or at + count > total:
                raise ValueError("a back-reference leaves the image")
            out += out[at - d : at - d + count] if d >= count else (out[-d:] * (count // d + 1))[:count]
            at += count
        bits >>= n
        kept -= n
    r.skip(given - kept)
    return np.array(out, dtype=np.uint32)


def extended_all(s: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from their prefix symbols and the bits behind them, and how many of these they take."""
    extra = EXTRA.take(s)
    return LEAST.take(s) + (bits & (1 << extra) - 1), extra


def followed(to: np.ndarray) -> np.ndarray:
    """Where each place leads in the end; what leads to itself is an end."""
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def pixels_by_arrays(r: Reader, width: int, height: int, cache_bits: int, codes: list[PrefixCode], stretch: int = 1 << 18) -> np.ndarray:
    """The same for one group of codes. How many bits a pixel or reference takes is looked up for every
    bit position of a stretch at once; then the positions where one begins are followed, and only
    there the symbols are read."""
    green, red, blue, alpha, far = codes
    total, held, parts = width * height, 0, []
    data = np.frombuffer(r.data + bytes(16), dtype=np.uint8)
    while held < total:
        if r.at >= r.end:
            if max(c.mask for c in codes[:4]) or held:
                raise ValueError("the image ends early")
        base = r.at & ~7
        count = min(stretch, max(8, r.end - base), (60 * (total - held) + 15) & ~7)
        raw = data[base >> 3 : (base + count >> 3) + 20].astype(np.int64)
        # 25 bits and more from every position on
        wide = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        near = np.empty((len(wide), 8), dtype=np.int64)
        for k in range(8):
            np.right_shift(wide, k, out=near[:, k])
        near = near.ravel()
        kind = green.sizes.take(near[:count] & green.mask)
        behind = np.arange(count)
        behind += kind & 15
        plain = kind < 16
        after = behind.copy()
        for code in (red, blue, alpha):
            if code.mask:
                n = code.sizes.take(near & code.mask).take(after)
                n *= plain
                after += n
        copy = (kind > 31).nonzero()[0]
        if len(copy):
            s = (green.both.take(near.take(copy) & green.mask) >> 4) - 256
            at = behind.take(copy) + EXTRA.take(s)
            x = far.both.take(near.take(at, mode="clip") & far.mask)
            after[copy] = at + (x & 15) + EXTRA.take(x >> 4)
        # four steps at once; what leads out of the stretch ends at count
        jump = np.append(np.minimum(after, count), count)
        two = jump.take(jump)
        four, path, p = memoryview(two.take(two)), [], r.at - base
        for _ in range(-(-(total - held) // 4)):
            path.append(p)
            p = four[p]
            if p == count:
                break
        q = np.array(path)
        q = np.stack([q, jump[q], two[q], jump[two[q]]], axis=1).ravel()[: total - held]
        q = q[q < count]
        x = green.both[near[q] & green.mask]
        kinds, n, away = x >> 4, np.ones(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
        behind = q + (x & 15)
        value, at = (kinds & 255) << 8, behind
        for code, place in ((red, 16), (blue, 0), (alpha, 24)):
            x = code.both[near[at] & code.mask]
            at = at + (x & 15)
            value |= x >> 4 << place
        copy = np.flatnonzero((kinds >= 256) & (kinds < 256 + LENGTHS))
        if len(copy):
            at = behind[copy]
            n[copy], extra = extended_all(kinds[copy] - 256, near[at])
            at = at + extra
            x = far.both[near[at] & far.mask]
            code, _ = extended_all(x >> 4, near[at + (x & 15)])
            away[copy] = np.where(code > len(NEAR), code - len(NEAR), np.array(near_places(width))[np.minimum(code, len(NEAR)) - 1])
        ends = held + np.cumsum(n)
        taken = int(np.searchsorted(ends, total)) + 1
        if taken <= len(q):
            if ends[taken - 1] > total:
                raise ValueError("a back-reference leaves the image")
        parts.append((kinds[:taken], value[:taken], n[:taken], away[:taken]))
        last = min(taken, len(q)) - 1
        held = int(ends[last])
        r.at = base + int(after[q[last]])
        if r.at > r.end:
            raise ValueError("the image ends early")
    kinds, value, n, away = (np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
    return resolved(kinds, value, n, away, cache_bits)


def resolved(kinds: np.ndarray, value: np.ndarray, n: np.ndarray, away: np.ndarray, cache_bits: int) -> np.ndarray:
    """The pixels of literals, references and cached pixels: where each pixel comes from is followed to
    the literal; a cached pixel comes from the last one before it with the same place in the cache."""
    begin = np.cumsum(n) - n
    total = int(n.sum())
    pixels = np.zeros(total + 1, dtype=np.uint32)  # the last one is what an unused place of the cache holds
    pixels[begin] = value  # of what is no literal nothing comes
    came = here = np.arange(total + 1)
    if away.any():
        came = here.copy()
        came[:-1] -= np.repeat(away, n)
        if came.min() < 0:
            raise ValueError("a back-reference leaves the image")
        came = followed(came)
    hit = begin[kinds >= 256 + LENGTHS]
    if len(hit):
        slot = (pixels[:-1] * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)).astype(np.uint16)
        slot[hit] = kinds[kinds >= 256 + LENGTHS] - 256 - LENGTHS
        slot = slot.take(came[:-1])
        order = slot.argsort(kind="stable")
        slot = slot.take(order)
        before = np.empty(total, dtype=np.int64)
        before[order[:1]] = total
        before[order[1:]] = np.where(slot[1:] == slot[:-1], order[:-1], total)
        came = came.copy()
        came[hit] = before[hit]
        came = followed(came)
    return pixels.take(came[:-1])


def added(a: int, b: int) -> int:
    """Sums of the four samples, each modulo 256."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def middle(a: int, b: int) -> int:
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def each(a: int, b: int, c: int, f) -> int:  # noqa: ANN001
    return sum(f(a >> k & 255, b >> k & 255, c >> k & 255) << k for k in (0, 8, 16, 24))


def clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def chosen(left: int, top: int, corner: int) -> int:
    """Left or top, whichever is nearer to left + top - corner."""
    to_left = sum(abs((top >> k & 255) - (corner >> k & 255)) for k in (0, 8, 16, 24))
    to_top = sum(abs((left >> k & 255) - (corner >> k & 255)) for k in (0, 8, 16, 24))
    return left if to_left < to_top else top


def half_further(a: int, b: int, _: int) -> int:
    d = a - b
    return clamp(a + (d // 2 if d >= 0 else -(-d // 2)))


def predicted(mode: int, l: int, t: int, tr: int, tl: int) -> int:  # noqa: E741
    match mode:
        case 1: return l
        case 2: return t
        case 3: return tr
        case 4: return tl
        case 5: return middle(middle(l, tr), t)
        case 6: return middle(l, tl)
        case 7: return middle(l, t)
        case 8: return middle(tl, t)
        case 9: return middle(t, tr)
        case 10: return middle(middle(l, tl), middle(t, tr))
        case 11: return chosen(l, t, tl)
        case 12: return each(l, t, tl, lambda a, b, c: clamp(a + b - c))
        case 13: return each(middle(l, t), tl, 0, half_further)
    return 0xFF000000


def predictions(mode: int, l: np.ndarray, t: np.ndarray, tr: np.ndarray, tl: np.ndarray) -> np.ndarray:  # noqa: E741
    """predicted() of many pixels, as rows of four samples."""
    mean = lambda a, b: (a & b) + ((a ^ b) >> 1)
    apart = lambda a, b: np.abs(a.astype(np.int16) - b).sum(axis=1)
    match mode:
        case 1: return l
        case 2: return t
        case 3: return tr
        case 4: return tl
        case 5: return mean(mean(l, tr), t)
        case 6: return mean(l, tl)
        case 7: return mean(l, t)
        case 8: return mean(tl, t)
        case 9: return mean(t, tr)
        case 10: return mean(mean(l, tl), mean(t, tr))
        case 11: return np.where((apart(t, tl) < apart(l, tl))[:, None], l, t)
        case 12: return np.clip(l.astype(np.int16) + t - tl, 0, 255).astype(np.uint8)
        case 13:
            a = mean(l, t).astype(np.int16)
            d = a - tl
            return np.clip(a + np.where(d >= 0, d // 2, -(-d // 2)), 0, 255).astype(np.uint8)
    return np.broadcast_to(BLACK, t.shape)


#: Predictors that look at the row above alone, and so need no pixel of their own row.
ABOVE = (0, 2, 3, 4, 8, 9, 14, 15)


def undo_predictor(pixels: np.ndarray, width: int, bits: int, modes: np.ndarray) -> np.ndarray:
    """Row by row and block by block: what looks above alone as arrays, the left neighbour as a running
    sum, the other predictors pixel by pixel."""
    across, mode = blocks_of(width, bits), (modes >> 8 & 15).tolist()
    rest = pixels.view(np.uint8).reshape(-1, 4)
    out = rest.copy()
    out[0] += BLACK
    out[:width] = np.cumsum(out[:width], axis=0, dtype=np.uint8)
    for begin in range(width, len(out), width):
        row = (begin // width >> bits) * across
        out[begin] += out[begin - width]
        for block in range(across):
            lo, hi = begin + max(1, block << bits), begin + min(width, (block + 1) << bits)
            m = mode[row + block]
            if lo >= hi:
                continue
            if m in ABOVE:
                t, tr, tl = (out[lo - width + k : hi - width + k] for k in (0, 1, -1))
                out[lo:hi] += predictions(m, t, t, tr, tl)
            elif m == 1:
                out[lo - 1 : hi] = np.cumsum(out[lo - 1 : hi], axis=0, dtype=np.uint8)
            else:
                above = out[begin - width : begin + 1].reshape(-1).view(np.uint32).tolist()
                left, x = int(out[lo - 1].view(np.uint32)[0]), lo - begin
                new = []
                for p in rest[lo:hi].reshape(-1).view(np.uint32).tolist():
                    left = added(p, predicted(m, left, above[x], above[x + 1], above[x - 1]))
                    new.append(left)
                    x += 1
                out[lo:hi] = np.array(new, dtype=np.uint32).view(np.uint8).reshape(-1, 4)
    return out.reshape(-1).view(np.uint32)


def neighbours(pixels: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(the samples, their left, top, top right and top left neighbours), rows of four; what lies before
    the first pixel is the first pixel."""
    four = pixels.view(np.uint8).reshape(-1, 4)
    wide = np.concatenate([np.repeat(four[:1], width + 1, axis=0), four])
    return four, wide[width:-1], wide[1 : 1 + len(four)], wide[2 : 2 + len(four)], wide[: len(four)]


def residuals(around: tuple[np.ndarray, ...], width: int, mode: int) -> np.ndarray:
    """What is left of each pixel once one predictor is taken off."""
    four, left, top, *corners = around
    rest = four - predictions(mode, left, top, *corners)
    rest[:width] = four[:width] - left[:width]
    rest[::width] = four[::width] - top[::width]
    rest[0] = four[0] - BLACK
    return rest.reshape(-1).view(np.uint32)


def cross_terms(pixels: np.ndarray, width: int, bits: int, elements: np.ndarray) -> tuple[np.ndarray, ...]:
    i = np.arange(len(pixels))
    e = elements[(i // width >> bits) * blocks_of(width, bits) + (i % width >> bits)]
    signed = lambda x: (x & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    return signed(e >> 16), signed(e >> 8), signed(e), signed(pixels >> 8)  # red to blue, green to blue, green to red, green


def cross_colour(pixels: np.ndarray, width: int, bits: int, elements: np.ndarray, undo: bool = True) -> np.ndarray:
    red_blue, green_blue, green_red, green = cross_terms(pixels, width, bits, elements)
    sign = 1 if undo else -1
    red, blue = (pixels >> 16 & 255).astype(np.int32), (pixels & 255).astype(np.int32)
    new_red = red + sign * (green_red * green >> 5) & 255
    seen = (new_red if undo else red).astype(np.uint8).view(np.int8).astype(np.int32)
    new_blue = blue + sign * ((green_blue * green >> 5) + (red_blue * seen >> 5)) & 255
    return pixels & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << np.uint32(16) | new_blue.astype(np.uint32)


def green_added(pixels: np.ndarray, sign: int = 1) -> np.ndarray:
    green = (pixels >> 8 & 255).astype(np.int32)
    red, blue = (pixels >> 16 & 255).astype(np.int32) + sign * green & 255, (pixels & 255).astype(np.int32) + sign * green & 255
    return pixels & np.uint32(0xFF00FF00) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def palette_bits(n: int) -> int:
    """Indices to a pixel, as a power of two."""
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def undo_palette(pixels: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    bits = palette_bits(len(table))
    packed = (pixels >> 8 & 255).reshape(height, -1)
    x = np.arange(width)
    index = packed[:, x >> bits] >> (8 >> bits) * (x & (1 << bits) - 1) & (1 << (8 >> bits)) - 1
    return np.r_[table, np.zeros(256, dtype=np.uint32)][index].astype(np.uint32).ravel()


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB pixels in rows) of a RIFF file with one VP8L image."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    r = Reader(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if r.read(8) != 0x2F:
        raise ValueError("no lossless image")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    undo, packed = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            undo.append((kind, packed, bits, read_pixels(r, blocks_of(packed, bits), blocks_of(height, bits))))
        elif kind == PALETTE:
            n = r.read(8) + 1
            steps = read_pixels(r, n, 1)
            table = np.cumsum(steps.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)
            undo.append((kind, packed, 0, table))
            packed = blocks_of(packed, palette_bits(n))
        else:
            undo.append((kind, packed, 0, None))
    pixels = read_pixels(r, packed, height, main=True)
    for kind, wide, bits, data in reversed(undo):
        if kind == PREDICTOR:
            pixels = undo_predictor(pixels, wide, bits, data)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, wide, bits, data)
        elif kind == SUBTRACT_GREEN:
            pixels = green_added(pixels)
        else:
            pixels = undo_palette(pixels, wide, height, data)
    return width, height, pixels


def riff(image: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(image)) + image + bytes(len(image) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def head(w: Writer, width: int, height: int, alpha: bool) -> None:
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        w.write(int(value), n)


def write_single(w: Writer, symbol: int) -> None:
    for value, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
        w.write(value, n)


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for the counts, none over `most`; one used symbol has length 1."""
    used = counts.nonzero()[0]
    lengths = np.zeros(len(counts), dtype=np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves, some = counts[used].tolist(), len(used)
    while True:
        # the two lightest of the leaves and of what was joined, again and again; behind both stands what is never light
        leaves.append((1 << 62) + 1)
        weight, of_leaf, of_joined, leaf, joined = [1 << 62] * some, [0] * some, [0] * some, 0, 0
        a, b = leaves[0], weight[0]
        for new in range(some - 1):
            if a <= b:
                both = a
                of_leaf[leaf] = new
                leaf += 1
                a = leaves[leaf]
            else:
                both = b
                of_joined[joined] = new
                joined += 1
                b = weight[joined]
            if a <= b:
                both += a
                of_leaf[leaf] = new
                leaf += 1
                a = leaves[leaf]
            else:
                both += b
                of_joined[joined] = new
                joined += 1
                b = weight[joined]
            weight[new] = both
            if joined == new:
                b = both
        depth = [1] * (some - 1)
        for i in range(some - 3, -1, -1):
            depth[i] = depth[of_joined[i]] + 1
        if depth[of_leaf[0]] <= most:
            lengths[used] = [depth[i] for i in of_leaf]
            return lengths
        leaves = [(n + 1) // 2 + 1 for n in leaves[:some]]


def write_code(w: Writer, counts: np.ndarray) -> PrefixCode:
    some = counts.nonzero()[0]
    used = some.tolist()
    if len(used) <= 2 and max(used, default=0) < 256:
        symbols = used or [0]
        for value, n in ((1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols)):
            w.write(value, n)
        return code_of_few(len(counts), tuple(symbols))
    lengths = code_lengths(counts, 15)
    # runs of zeros, and every other length on its own
    for value, n in LENGTH_HEAD:
        w.write(value, n)
    field, fields, at = fields_of_lengths(), w.small, 0
    for symbol, n in zip(used, lengths[some].tolist(), strict=True):
        if symbol > at:
            fields += fields_of_zeros(symbol - at)
        at = symbol + 1
        fields.append(field[n])
    fields += fields_of_zeros(len(lengths) - at)
    return PrefixCode(lengths)


@lru_cache(maxsize=1)
def fields_of_lengths() -> list[int]:
    """Each step of LENGTH_CODE as a writer's field."""
    code = code_of_lengths(LENGTH_CODE)
    return (code.written << 6 | code.n).tolist()


@lru_cache(maxsize=2048)
def fields_of_zeros(n: int) -> list[int]:
    """The fields of n lengths of zero: runs of 138 at most, one or two each on its own."""
    out = []
    while n:
        run = min(n, 138)
        step, base, extra = (0, 1, 0) if run < 3 else (17, 3, 3) if run < 11 else (18, 11, 7)
        run = run if extra else 1
        value, bits = divmod(fields_of_lengths()[step], 64)
        out.append((value | run - base << bits) << 6 | bits + extra)
        n -= run
    return out


def prefix_of(value: int) -> tuple[int, int, int]:
    """(symbol, extra value, extra bits) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v - ((2 + second) << (high - 1)), high - 1


def copies(pixels: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Back-references (start, pixels, distance), one behind the other: where LEAST_COPY pixels stood
    before, as often at the same distance as they go on."""
    n = len(pixels) - LEAST_COPY + 1
    if n < 2:
        return []
    name = np.zeros(n, dtype=np.uint64)
    for k in range(LEAST_COPY):
        name = (name ^ pixels[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    if n < 4096:  # few enough for short names, which sort faster
        name = (name >> np.uint64(48)).astype(np.uint16)
    order = name.argsort(kind="stable")
    name = name[order]
    again = (name[1:] == name[:-1]).nonzero()[0]
    again, before = order[again + 1], order[again]
    distance = again - before
    same = distance <= MOST_DISTANCE
    for k in range(LEAST_COPY):
        same &= pixels[again + k] == pixels[before + k]
    again, distance = again[same], distance[same]
    if not len(again):
        return []
    order = again.argsort()
    again, distance = again[order], distance[order]
    # runs of places at the same distance
    edge = ((again[1:] != again[:-1] + 1) | (distance[1:] != distance[:-1])).nonzero()[0]
    begin, end = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(again) - 1]])
    out, at = [], 0
    for lo, hi, d in zip(again[begin].tolist(), again[end].tolist(), distance[begin].tolist(), strict=True):
        lo = max(lo, at)
        left = hi + LEAST_COPY - lo
        while left >= LEAST_COPY:
            out.append((lo, min(left, MOST_COPY), d))
            at = lo = lo + out[-1][1]
            left -= out[-1][1]
    return out


def entropy(symbols: np.ndarray) -> float:
    """Bits of the symbols under their best code, and about six for each in the code's table."""
    used = np.bincount(symbols)
    used = used[used.nonzero()[0]]
    return len(symbols) * log2(max(1, len(symbols))) - float(used @ np.log2(used)) + 6 * len(used)


def literal_bits(pixels: np.ndarray) -> float:
    """What the pixels take as literals."""
    four = pixels.view(np.uint8) + quarters(1 << max(10, (4 * len(pixels) - 1).bit_length()))[: 4 * len(pixels)]
    return entropy(four) - 8 * len(pixels)  # four codes, each for a quarter of the samples


@lru_cache(maxsize=2)
def quarters(n: int) -> np.ndarray:
    """Where the four samples of a pixel are counted, for n samples."""
    return np.tile(np.array([0, 256, 512, 768]), n >> 2)


def cached(pixels: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the cache, whether it holds the pixel) for each pixel of `at`."""
    slot = ((pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - bits)).astype(np.uint16)
    order = slot.argsort(kind="stable")
    sorted_slots, sorted_pixels = slot[order], pixels[order]
    hit = np.empty(len(pixels), dtype=bool)
    # of a place the first pixel meets the zero that it starts with
    hit[order[1:]] = np.where(sorted_slots[1:] == sorted_slots[:-1], sorted_pixels[1:] == sorted_pixels[:-1], sorted_pixels[1:] == 0)
    hit[order[:1]] = sorted_pixels[:1] == 0
    return slot[at].astype(np.int64), hit[at]


def best_cache(pixels: np.ndarray, at: np.ndarray) -> tuple[int, np.ndarray | None, np.ndarray | None]:
    """(bits, cached()) of the colour cache if it saves something on the literals, else 0 bits: a hit
    takes a symbol of so many bits, about, and its symbol a place in the code's table."""
    bits = min(CACHE_BITS, len(at).bit_length() - 2)
    if bits < 1:
        return 0, None, None
    slot, hit = cached(pixels, at, bits)
    found = slot[hit]
    saved = literal_bits(pixels[at]) / len(at) - bits - 1
    return (bits, slot, hit) if saved * len(found) > 5 * np.count_nonzero(np.bincount(found)) else (0, None, None)


def write_pixels(w: Writer, pixels: np.ndarray, width: int, main: bool = False, cache_bits: int | None = 0, references: bool = False) -> None:
    """Greedy back-references, hits of a colour cache (None: the one that saves the most), literals."""
    pixels = np.asarray(pixels, dtype=np.uint32)
    steps = copies(pixels, width) if references else []
    starts, spans = (np.array(x, dtype=np.int64) for x in ([t for t, _, _ in steps], [n for _, n, _ in steps]))
    depth = np.zeros(len(pixels) + 1, dtype=np.int8)
    depth[starts] += 1
    depth[starts + spans] -= 1
    begins = depth[:-1].cumsum(dtype=np.int8) == 0
    at = begins.nonzero()[0]
    slot = hit = None
    if cache_bits is None:
        cache_bits, slot, hit = best_cache(pixels, at)
    elif cache_bits:
        slot, hit = cached(pixels, at, cache_bits)
    w.write(int(cache_bits > 0), 1)
    if cache_bits:
        w.write(cache_bits, 4)
    if main:
        w.write(0, 1)
    near = near_codes(width)
    length = np.array([prefix_of(n) for _, n, _ in steps], dtype=np.int64).reshape(-1, 3)
    far = np.array([prefix_of(near.get(d, d + len(NEAR))) for _, _, d in steps], dtype=np.int64).reshape(-1, 3)
    four = pixels[at].view(np.uint8).reshape(-1, 4).astype(np.int64)
    green, red, blue, alpha = (np.ascontiguousarray(four[:, k]) for k in (1, 2, 0, 3))
    plain = (red, blue, alpha)
    if cache_bits:
        green = np.where(hit, 256 + LENGTHS + slot, green)
        rest = (~hit).nonzero()[0]
        plain = tuple(x.take(rest) for x in plain)
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    symbols = (np.concatenate([green, 256 + length[:, 0]]) if steps else green, *plain, far[:, 0])
    codes = [write_code(w, np.bincount(x, minlength=n)) for x, n in zip(symbols, sizes, strict=True)]
    # a pixel's fields: green, red with blue, alpha if it has bits; a reference's: its length, its distance, in two if it is long
    first, reds, blues, alphas, away = codes
    behind = reds.n[red]
    fields = [(first.written[green], first.n[green]), (reds.written[red] | blues.written[blue] << behind, behind + blues.n[blue])]
    if not alphas.single:
        fields.append((alphas.written[alpha], alphas.n[alpha]))
    if cache_bits:
        for _, n in fields[1:]:
            n[hit] = 0
    if steps:
        n, m = first.n[256 + length[:, 0]], away.n[far[:, 0]]
        copy = [(first.written[256 + length[:, 0]] | length[:, 1] << n, n + length[:, 2])]
        if len(fields) > 2 or (m + far[:, 2]).max() > MOST_BITS:
            copy += [(away.written[far[:, 0]], m), (far[:, 1], far[:, 2])]
        else:
            copy.append((away.written[far[:, 0]] | far[:, 1] << m, m + far[:, 2]))
        none = np.zeros(max(len(at), len(steps)), dtype=np.int64)
        fields += [(none[: len(at)], none[: len(at)])] * (len(copy) - len(fields))
        place = np.empty(len(pixels), dtype=np.int64)
        place[at], place[starts] = np.arange(len(at)), np.arange(len(at), len(at) + len(steps))
        begins[starts] = True
        order = place[begins]
        fields = [tuple(np.concatenate(x)[order] for x in zip(a, b, strict=True)) for a, b in zip(fields, copy, strict=True)]
    w.write_all(*(np.stack(x, axis=1).ravel() for x in zip(*fields, strict=True)))


def best_modes(pixels: np.ndarray, width: int, bits: int) -> np.ndarray:
    """For each block the predictor that leaves the smallest samples."""
    height, around = len(pixels) // width, neighbours(pixels, width)
    down, across = np.arange(0, height, 1 << bits), np.arange(0, width, 1 << bits)
    sums = []
    for mode in range(14):
        size = np.abs(residuals(around, width, mode).view(np.int8).reshape(height, width, 4).astype(np.int64)).sum(axis=2)
        sums.append(np.add.reduceat(np.add.reduceat(size, down, axis=0), across, axis=1).ravel())
    return np.argmin(np.stack(sums), axis=0)


def best_elements(pixels: np.ndarray, width: int, bits: int) -> np.ndarray:
    """For each block the multipliers that fit red and blue to green, and blue to red, by least squares."""
    height, across = len(pixels) // width, blocks_of(width, bits)
    i = np.arange(len(pixels))
    block = (i // width >> bits) * across + (i % width >> bits)
    n = across * blocks_of(height, bits)
    signed = lambda k: (pixels >> np.uint32(k) & np.uint32(255)).astype(np.uint8).view(np.int8).astype(float)
    red, green, blue = signed(16), signed(8), signed(0)

    def slope(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(32 * np.bincount(block, x * y, n) / np.maximum(1, np.bincount(block, x * x, n))), -128, 127)

    to_red, to_blue = slope(green, red), slope(green, blue)
    red_blue = slope(red, blue - green * to_blue[block] / 32)
    byte = lambda x: x.astype(np.int64).astype(np.uint32) & np.uint32(255)
    return np.uint32(0xFF000000) | byte(red_blue) << np.uint32(16) | byte(to_blue) << np.uint32(8) | byte(to_red)


def distinct(pixels: np.ndarray) -> np.ndarray:
    colours = np.sort(pixels)
    return np.concatenate([colours[:1], colours[1:][colours[1:] != colours[:-1]]])


def best_transforms(pixels: np.ndarray, width: int, bits: int) -> tuple[int, ...]:
    """The transforms that save the most on the literals, by their entropies, each tried on what the
    ones before it leave."""
    out, least = [], literal_bits(pixels)
    colours = distinct(pixels[:2048])
    if len(pixels) > 2048 and len(colours) <= 256:
        colours = distinct(pixels)
    if len(colours) <= 256:
        index = np.searchsorted(colours, pixels).astype(np.uint32) << np.uint32(8)
        if literal_bits(steps_of(colours)) + literal_bits(index) / (1 << palette_bits(len(colours))) < least:
            return (PALETTE,)
    # differences tell whether neighbours, or the samples of a pixel, say anything about one another
    four = pixels.view(np.uint8).reshape(-1, 4)
    if len(four) > 1 and literal_bits((four[1:] - four[:-1]).reshape(-1).view(np.uint32)) < least:
        left, modes = predictor_taken_off(pixels, width, bits, best_modes(pixels, width, bits))
        if (now := literal_bits(left) + literal_bits(modes)) < least:
            out, pixels, least = [PREDICTOR], left, now
        elements = best_elements(pixels, width, bits)
        if literal_bits(cross_colour(pixels, width, bits, elements, undo=False)) + literal_bits(elements) < least:
            return (*out, CROSS_COLOUR)
        if literal_bits(green_added(pixels, -1)) < least:
            out.append(SUBTRACT_GREEN)
    return tuple(out)


def predictor_taken_off(pixels: np.ndarray, width: int, bits: int, modes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what is left, the modes as pixels) under a predictor for each block."""
    i = np.arange(len(pixels))
    of = modes[(i // width >> bits) * blocks_of(width, bits) + (i % width >> bits)]
    left, around = np.zeros(len(pixels), dtype=np.uint32), neighbours(pixels, width)
    for mode in np.unique(modes):
        left = np.where(of == mode, residuals(around, width, int(mode)), left)
    return left, (np.uint32(0xFF000000) | modes.astype(np.uint32) << np.uint32(8)).astype(np.uint32)


def steps_of(table: np.ndarray) -> np.ndarray:
    """A palette as it is stored: each colour less the one before it."""
    return np.diff(table.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), dtype=np.uint8)).astype(np.uint8).reshape(-1).view(np.uint32)


def encode(pixels: np.ndarray, width: int, transforms: tuple[int, ...] | None = None, cache_bits: int | None = None, references: bool = True, bits: int = 4, mode: int | None = None) -> bytes:
    """ARGB pixels as a compressed image, with the transforms named, in order (None: those that save
    the most), a cache of so many bits (None: likewise). mode: one predictor for all blocks; None: the
    best for each."""
    height, kept = len(pixels) // width, width
    pixels = np.ascontiguousarray(pixels, dtype=np.uint32)
    w = Writer()
    head(w, width, height, bool((pixels >> 24 != 255).any()))
    for kind in best_transforms(pixels, width, bits) if transforms is None else transforms:
        w.write(1, 1)
        w.write(kind, 2)
        n = blocks_of(kept, bits) * blocks_of(height, bits)
        if kind == PREDICTOR:
            modes = best_modes(pixels, kept, bits) if mode is None else np.full(n, mode)
            pixels, shown = predictor_taken_off(pixels, kept, bits, modes)
            w.write(bits - 2, 3)
            write_pixels(w, shown, blocks_of(kept, bits))
        elif kind == CROSS_COLOUR:
            elements = best_elements(pixels, kept, bits)
            pixels = cross_colour(pixels, kept, bits, elements, undo=False)
            w.write(bits - 2, 3)
            write_pixels(w, elements, blocks_of(kept, bits))
        elif kind == SUBTRACT_GREEN:
            pixels = green_added(pixels, -1)
        else:
            table, index = np.unique(pixels, return_inverse=True)
            if len(table) > 256:
                raise ValueError("too many colours for a palette")
            w.write(len(table) - 1, 8)
            write_pixels(w, steps_of(table), len(table))
            b = palette_bits(len(table))
            wide = np.zeros((height, blocks_of(kept, b) << b), dtype=np.uint32)
            wide[:, :kept] = index.reshape(height, kept)
            groups = wide.reshape(height, -1, 1 << b)
            kept = groups.shape[1]
            pixels = (0xFF000000 | sum(groups[:, :, k] << np.uint32((8 >> b) * k) for k in range(1 << b)) << np.uint32(8)).astype(np.uint32).ravel()
    w.write(0, 1)
    write_pixels(w, pixels, kept, main=True, cache_bits=cache_bits, references=references)
    return riff(w.bytes())


def images(data: bytes) -> Iterator[bytes]:
    """The RIFF files that follow one another in data."""
    at = 0
    while at < len(data):
        n = 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
        yield data[at : at + n]
        at += n


def payload(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % WIDTH or (0 if text else WIDTH))


def stored(text: bytes) -> bytes:
    """The payload as opaque RGB images, three bytes a pixel."""
    samples = np.frombuffer(payload(text), dtype=np.uint8).reshape(-1, 3)
    four = np.full((len(samples), 4), 255, dtype=np.uint8)
    four[:, :3] = samples[:, ::-1]
    pixels, most = four.reshape(-1).view(np.uint32), WIDTH // 3 * MOST_ROWS
    return b"".join(encode(pixels[i : i + most], WIDTH // 3) for i in range(0, len(pixels), most))


def opened(data: bytes) -> tuple[int, int, int, bytes]:
    """(width, height, channels, samples) of the images in data, one below the other: red, green, blue
    if all are opaque, else alpha as well."""
    parts = [decode(x) for x in images(data)]
    pixels = np.concatenate([p for _, _, p in parts]) if parts else np.zeros(0, dtype=np.uint32)
    width, height = (parts[0][0] if parts else 0), sum(h for _, h, _ in parts)
    four = pixels.view(np.uint8).reshape(-1, 4)
    channels = 3 if (four[:, 3] == 255).all() else 4
    return width, height, channels, (four[:, 2::-1] if channels == 3 else four[:, [2, 1, 0, 3]]).tobytes()


def feature(samples: bytes, width: int, channels: int) -> str:
    """Of the first channel's mean, and of its means in eight by eight cells which lie above it."""
    grey = np.frombuffer(samples, dtype=np.uint8)[::channels].reshape(-1, max(1, width)).astype(np.float64)
    if not grey.size:
        return "0.000:" + "0" * 16
    rows, columns, size = cells(*grey.shape)
    sums, mean = np.add.reduceat(np.add.reduceat(grey, rows, axis=0), columns, axis=1), grey.mean()
    bits = (sums / size > mean).ravel()
    return f"{mean:.3f}:{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}"


@lru_cache(maxsize=1024)
def cells(height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first rows and columns of eight by eight cells, and the cells' sizes."""
    rows, columns = (np.minimum(np.arange(8) * n // 8, n - 1) for n in (height, width))
    return rows, columns, np.outer(np.maximum(1, np.diff(np.r_[rows, height])), np.maximum(1, np.diff(np.r_[columns, width])))


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text in UTF-8, padded with 255 to a positive multiple of
    576 bytes, as lossless WebP; very long texts as several images in a row. Null text counts as
    empty. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(map(stored, texts), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """media with width, height, channels, samples (the pixel array, row by row) and feature, read
    from its column media. Null media: null in all of them; bytes that are no image fail."""
    names = media.columns
    shown = [("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("samples", pa.binary()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "media"):
            found = [None if x is None else opened(x) for x in b.column("media").to_pylist()]
            rows = [(None,) * 5 if x is None else (*x, feature(x[3], x[0], x[2])) for x in found]
            new = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(shown)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*names, *(n for n, _ in shown)])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in media.dtypes), "width int, height int, channels int, samples binary, feature string"])
    return media.mapInArrow(run, schema)
