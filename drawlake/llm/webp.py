"""Lossless WebP columns: pixel arrays to files and back, in numpy and plain Python inside tasks.

The decoder reads prefix codes, back-references, the colour cache and grouped codes, and inverts the palette,
subtract-green, cross-colour and predictor transforms. The encoder writes the same format: a palette for few
colours, else the cheaper of raw and predicted samples, with back-references and a colour cache.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.common import free_name

#: Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
GREENS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3
MAX_SIDE = 1 << 14
#: Near distances by code: the places around a pixel by distance, nearer columns first.
PLANE = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

FARTHEST = (1 << 20) - 128
#: Bytes that a payload is a multiple of, and a row of SIDE pixels of three samples.
PAD, SIDE = 192, 64
CACHE_BITS = 6
#: Bits of the longest prefix code that many images are written with: short tables read faster than the 15 the format allows.
LONGEST = 11
#: Texts that are written and read as one batch, and images and bytes that advance together.
BATCH, GROUP, GROUP_BYTES = 2048, 1024, 1 << 21
#: Pixels that a back-reference takes at least.
MATCH = 4


class Bits:
    """A stream read from the least bit of each byte."""

    SPAN = 1 << 14

    def __init__(self, raw: bytes):
        self.raw, self.at, self.size = raw + bytes(64), 0, 8 * len(raw)

    def take(self, n: int) -> int:
        v = (int.from_bytes(self.raw[self.at >> 3 : (self.at + n + 7 >> 3)], "little") >> (self.at & 7)) & ((1 << n) - 1)
        if self.at + n > self.size:
            raise ValueError("the stream ends early")
        self.at += n
        return v

    def windows(self, start: int) -> tuple[int, list[int]]:
        """(first position, 16-bit windows of the positions from there on) around ``start``."""
        first = start >> 3
        part = np.frombuffer(self.raw[first : first + self.SPAN + 16], np.uint8).astype(np.uint32)
        wide = part[:-2] | (part[1:-1] << np.uint32(8)) | (part[2:] << np.uint32(16))
        w = (wide[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(0xFFFF)
        return first * 8, w.reshape(-1).tolist()


class Code:
    """A prefix code as a table over its longest word: symbol * 16 + length; one symbol alone takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.table, self.mask = [int(used[0]) << 4 if len(used) else 0], 0
            return
        order = used[np.lexsort((used, lengths[used]))]
        n = lengths[order]
        most = int(n[-1])
        spans = 1 << (most - n)
        if spans.sum() != 1 << most:
            raise ValueError("an incomplete prefix code")
        table = np.repeat((order.astype(np.int64) << 4) | n, spans)
        self.table, self.mask = table[_index(most)].tolist(), (1 << most) - 1


_REVERSED = np.packbits(np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1), axis=1, bitorder="little").view("<u2")[:, 0].astype(np.int64)
_INDEX: dict[int, np.ndarray] = {}


def _reversed(x: np.ndarray, n) -> np.ndarray:
    """The n low bits of each number in reverse."""
    return _REVERSED[x] >> (16 - n)


def _index(most: int) -> np.ndarray:
    if most not in _INDEX:
        _INDEX[most] = _reversed(np.arange(1 << most), most)
    return _INDEX[most]


@lru_cache(4096)
def _code_of(lengths: bytes) -> Code:
    """The code of these lengths, as 64-bit numbers."""
    return Code(np.frombuffer(lengths, np.int64))


def _read_lengths(bits: Bits, size: int) -> np.ndarray:
    """The lengths of a prefix code's words."""
    lengths = np.zeros(size, np.int64)
    if bits.take(1):
        n, wide = bits.take(1) + 1, bits.take(1)
        lengths[bits.take(8 if wide else 1)] = 1
        if n == 2:
            lengths[bits.take(8)] = 1
        return lengths
    own, n = np.zeros(19, np.int64), bits.take(4) + 4
    own[list(CODE_ORDER[:n])] = np.array([bits.take(3 * n)], object) >> np.arange(0, 3 * n, 3) & 7
    most = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    code = _code_of(own.tobytes())
    table, mask = code.table, code.mask
    found: list[int] = []
    before, p = 8, bits.at
    # no length with its extra bits takes more than 14 bits
    w = int.from_bytes(bits.raw[p >> 3 : (p + 14 * size >> 3) + 2], "little") >> (p & 7)
    while len(found) < size and most:
        most -= 1
        e = table[w & mask]
        s = e >> 4
        n = e & 15
        if s < 16:
            found.append(s)
            before = s or before
        elif s == 17:
            found += [0] * (3 + (w >> n & 7))
            n += 3
        elif s == 18:
            found += [0] * (11 + (w >> n & 127))
            n += 7
        else:
            found += [before] * (3 + (w >> n & 3))
            n += 2
        w >>= n
        p += n
    if len(found) > size:
        raise ValueError("a code's lengths run over")
    bits.at = p
    lengths[: len(found)] = found
    return lengths


def _read_code(bits: Bits, size: int) -> Code:
    return Code(_read_lengths(bits, size))


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as (height * width) ARGB values."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    block, groups_at, n_groups = 0, None, 1
    if main and bits.take(1):
        block = bits.take(3) + 2
        wide = -(-width >> block)
        groups = (_read_image(bits, wide, -(-height >> block), False) >> 8) & 0xFFFF
        groups_at, n_groups = groups.tolist(), int(groups.max()) + 1
    sizes = (GREENS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[x for s in sizes for c in [_read_code(bits, s)] for x in (c.table, c.mask)] for _ in range(n_groups)]
    n, out = width * height, []
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    green, gm, red, rm, blue, bm, alpha, am, far, fm = codes[0]
    lo, win = bits.windows(bits.at)
    p, safe = bits.at - lo, len(win) - 640
    done = 0  # pixels that are in the cache
    push = out.append
    count = 0
    while count < n:
        if p > safe:
            if lo + p > bits.size:
                raise ValueError("the stream ends early")
            at = lo + p
            lo, win = bits.windows(at)
            p = at - lo
        if groups_at is not None:
            green, gm, red, rm, blue, bm, alpha, am, far, fm = codes[groups_at[(count // width >> block) * wide + (count % width >> block)]]
        e = green[win[p] & gm]
        p += e & 15
        s = e >> 4
        if s < GREENS:
            e = red[win[p] & rm]
            p += e & 15
            v = s << 8 | (e >> 4) << 16
            e = blue[win[p] & bm]
            p += e & 15
            v |= e >> 4
            if am:
                e = alpha[win[p] & am]
                p += e & 15
                push(v | (e >> 4) << 24)
            else:
                push(v | alpha[0] << 20)
            count += 1
        elif s < GREENS + LENGTHS:
            length, p = _number(s - GREENS, win, p)
            e = far[win[p] & fm]
            p += e & 15
            back, p = _number(e >> 4, win, p)
            if back > len(PLANE):
                back -= len(PLANE)
            else:
                x, y = PLANE[back - 1]
                back = max(1, x + y * width)
            if back > count or count + length > n:
                raise ValueError("a back-reference leaves the image")
            if back >= length:
                out += out[count - back : count - back + length]
            else:
                out += (out[count - back :] * (length // back + 1))[:length]
            count += length
        else:
            for v in out[done:]:
                cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
            done = count
            push(cache[s - GREENS - LENGTHS])
            count += 1
    bits.at = lo + p
    if bits.at > bits.size:
        raise ValueError("the stream ends early")
    return np.array(out, np.int64)


def _number(code: int, win: list[int], p: int) -> tuple[int, int]:
    """The number that a prefix code and its extra bits stand for, and where the stream goes on."""
    if code < 4:
        return code + 1, p
    extra = code - 2 >> 1
    return ((2 + (code & 1)) << extra) + ((win[p] | win[p + 16] << 16) & ((1 << extra) - 1)) + 1, p + extra


# --- transforms -----------------------------------------------------------------------------------------------


def _split(argb: np.ndarray) -> np.ndarray:
    """(n) values to (n, 4) samples, alpha first."""
    return np.stack([argb >> k & 0xFF for k in (24, 16, 8, 0)], axis=-1)


def _packed(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.int64)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _blocks(values: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """A sub-image's values, one for each pixel of the image."""
    wide = -(-width >> bits)
    return values.reshape(-1, wide)[np.arange(height) >> bits][:, np.arange(width) >> bits]


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.int64) & 0xFF) ^ 0x80) - 0x80


def _crossed(c: np.ndarray, multipliers: np.ndarray, undo: bool) -> np.ndarray:
    """Cross-colour transform of (h, w, 4) samples; ``multipliers``: a pixel's (alpha, red_to_blue, green_to_blue, green_to_red)."""
    m, sign = _signed(multipliers), 1 if undo else -1
    green = _signed(c[..., 2])
    out = c.copy()
    out[..., 1] = (c[..., 1] + sign * (m[..., 3] * green >> 5)) & 0xFF
    red = _signed(out[..., 1] if undo else c[..., 1])
    out[..., 3] = (c[..., 3] + sign * ((m[..., 2] * green >> 5) + (m[..., 1] * red >> 5))) & 0xFF
    return out


def _predict(mode: int, left, top, right, corner):
    """The prediction for a pixel, of four samples each; ``right`` is the pixel right above, ``corner`` left above."""

    def mean(a, b):
        return (a + b) >> 1

    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode == 6:
        return mean(left, corner)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(corner, top)
    if mode == 9:
        return mean(top, right)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = mean(left, top)
        d = a - corner
        return np.clip(a + np.fix(d / 2).astype(np.int64), 0, 255)
    return np.array([255, 0, 0, 0])


def _predicted(c: np.ndarray, modes: np.ndarray, undo: bool) -> np.ndarray:
    """Predictor transform of (h, w, 4) samples. One mode of the simple ones all over is done in whole arrays."""
    h, w, _ = c.shape
    sign = 1 if undo else -1
    only = int(modes.flat[0]) if (modes == modes.flat[0]).all() else -1
    out = c.copy()
    if not undo and only in (1, 2):
        out[0, 0, 0] -= 255
        out[0, 1:] -= c[0, :-1]
        out[1:, 0] -= c[:-1, 0]
        out[1:, 1:] -= c[1:, :-1] if only == 1 else c[:-1, 1:]
        return out & 0xFF
    if undo and only in (1, 2):
        out[0, 0, 0] += 255
        out[0] = np.cumsum(out[0], axis=0)
        if only == 1:
            out[:, 0] = np.cumsum(out[:, 0], axis=0)
            out[1:] = np.cumsum(out[1:], axis=1)
        else:
            out = np.cumsum(out, axis=0)
        return out & 0xFF
    src = out if undo else c
    for y in range(h):
        for x in range(w):
            if y == 0:
                guess = src[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                guess = src[y - 1, 0]
            else:
                # right above the last pixel of a row stands the row's own first
                guess = _predict(int(modes[y, x]), src[y, x - 1], src[y - 1, x], src[y - 1, x + 1] if x + 1 < w else src[y, 0], src[y - 1, x - 1])
            out[y, x] = (c[y, x] + sign * guess) & 0xFF
    return out


# --- files ----------------------------------------------------------------------------------------------------


def _opened(raw: bytes) -> tuple[Bits, int, int, list, int]:
    """(stream at the main image, width, height, transforms, width of the main image) of a lossless WebP file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while raw[at : at + 4] != b"VP8L":
        if at + 8 > len(raw):
            raise ValueError("no lossless image in the file")
        at += 8 + (int.from_bytes(raw[at + 4 : at + 8], "little") + 1 & ~1)
    bits = Bits(raw[at + 8 : at + 8 + int.from_bytes(raw[at + 4 : at + 8], "little")])
    if bits.take(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(4)
    steps, now = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (PREDICTOR, CROSS):
            size = bits.take(3) + 2
            steps.append((kind, now, size, _read_image(bits, -(-now >> size), -(-height >> size), False)))
        elif kind == GREEN:
            steps.append((kind, now, 0, None))
        else:
            n = bits.take(8) + 1
            colours = np.cumsum(_split(_read_image(bits, n, 1, False)), axis=0) & 0xFF
            size = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, now, size, colours))
            now = -(-now >> size)
    return bits, width, height, steps, now


def _finished(head: tuple, argb: np.ndarray) -> np.ndarray:
    """The samples of an image: its transforms undone, the last one first."""
    _, _, height, steps, now = head
    c = _split(argb).reshape(height, now, 4)
    for kind, wide, size, data in reversed(steps):
        if kind == PREDICTOR:
            c = _predicted(c, _blocks(data >> 8 & 0xFF, size, wide, height), True)
        elif kind == CROSS:
            c = _crossed(c, _blocks_of(data, size, wide, height), True)
        elif kind == GREEN:
            c[..., 1] = (c[..., 1] + c[..., 2]) & 0xFF
            c[..., 3] = (c[..., 3] + c[..., 2]) & 0xFF
        else:
            index = c[..., 2]
            if size:
                per = 8 >> size
                index = (index[:, :, None] >> (np.arange(1 << size) * per) & ((1 << per) - 1)).reshape(height, -1)[:, :wide]
            c = np.concatenate([data, np.zeros((256, 4), np.int64)])[index]
    return c[..., [1, 2, 3, 0]].astype(np.uint8)


def decode(raw: bytes) -> np.ndarray:
    """The (height, width, 4) red, green, blue, alpha samples of a lossless WebP file."""
    head = _opened(raw)
    return _finished(head, _read_image(head[0], head[4], head[2], True))


def _blocks_of(data: np.ndarray, size: int, width: int, height: int) -> np.ndarray:
    return np.stack([_blocks(s, size, width, height) for s in _split(data).T], axis=-1)


class Writer:
    """Values and their sizes in bits, in order; single ones are gathered in lists before they become arrays."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.v: list[int] = []
        self.n: list[int] = []

    def put(self, value, size) -> None:
        if isinstance(value, np.ndarray):
            self._flush()
            self.parts.append((value, size))
        elif isinstance(value, list):
            self.v += value
            self.n += size
        else:
            self.v.append(value)
            self.n.append(size)

    def _flush(self) -> None:
        if self.v:
            self.parts.append((np.array(self.v, np.int64), np.array(self.n, np.int64)))
            self.v, self.n = [], []

    def bytes(self) -> bytes:
        self._flush()
        v, n = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        full = n > 0
        v, n = v[full], n[full]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        within = np.arange(total) - np.repeat(ends - n, n)
        return np.packbits((np.repeat(v, n) >> within & 1).astype(np.uint8), bitorder="little").tobytes()


def code_lengths(counts: np.ndarray, most: int = 11) -> np.ndarray:
    """Prefix code lengths of the used symbols, at most ``most`` (the format allows 15; short tables read faster): flatter counts are tried until they fit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].astype(np.int64)
    while True:
        order = np.argsort(weights, kind="stable")
        leaves = weights[order].tolist()
        n = len(leaves)
        parent, made = [0] * (2 * n - 1), []
        i = j = 0
        for k in range(n - 1):
            total = 0
            for _ in range(2):
                if j >= len(made) or (i < n and leaves[i] <= made[j]):
                    total += leaves[i]
                    parent[i] = n + k
                    i += 1
                else:
                    total += made[j]
                    parent[n + j] = n + k
                    j += 1
            made.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            out[used[order]] = depth[:n]
            return out
        weights = np.maximum(weights >> 1, 1) if weights.max() > 2 else np.ones_like(weights)


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical words, first bit lowest."""
    words = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    n = lengths[order]
    full = np.cumsum(np.concatenate(([0], 1 << (15 - n[:-1])))) >> (15 - n)
    words[order] = _reversed(full, n)
    return words


_NOTHING = np.zeros(1 << 13, np.int64)


def _write_code(out: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code for these counts; gives each symbol's word and its bits (none for a lone symbol)."""
    used = np.flatnonzero(counts)
    if len(used) <= 2 and (len(used) == 0 or used[-1] < 256):
        s = used.tolist() or [0]
        out.put([1, len(s) - 1, 1, s[0]], [1, 1, 1, 8])
        if len(s) == 2:
            out.put(s[1], 8)
        if len(s) < 2:
            return _NOTHING[: len(counts)], _NOTHING[: len(counts)]
        words, sizes = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        words[s[1]], sizes[s] = 1, 1
        return words, sizes
    lengths = code_lengths(counts)
    tokens, extra, width = [], [], []
    last, at, end = 8, 0, int(used[-1]) + 1
    for s in used.tolist():
        gap = s - at
        while gap:
            if gap >= 11:
                n = min(gap, 138)
                tokens.append(18), extra.append(n - 11), width.append(7)
            elif gap >= 3:
                n = gap
                tokens.append(17), extra.append(n - 3), width.append(3)
            else:
                n = 1
                tokens.append(0), extra.append(0), width.append(0)
            gap -= n
        tokens.append(int(lengths[s])), extra.append(0), width.append(0)
        at = s + 1
    own = code_lengths(np.bincount(tokens, minlength=19), 7)
    words = code_words(own)
    lone = len(set(tokens)) == 1
    n = max(k for k, s in enumerate(CODE_ORDER) if own[s]) + 1
    n = max(n, 4)
    out.put([0, n - 4], [1, 4])
    out.put(own[list(CODE_ORDER[:n])].tolist(), [3] * n)
    if end < len(counts):
        size = max(2, (len(tokens) - 2).bit_length())
        size += size & 1
        out.put([1, (size - 2) // 2, len(tokens) - 2], [1, 3, size])
    else:
        out.put(0, 1)
    t = np.array(tokens)
    both = np.stack([words[t], np.array(extra)], axis=1).reshape(-1), np.stack([np.zeros(len(t), np.int64) if lone else own[t], np.array(width)], axis=1).reshape(-1)
    out.put(*both)
    if len(used) == 1:
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    return code_words(lengths), lengths


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, extra bits, their number) of numbers from 1."""
    x = v - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    second = x >> np.maximum(high - 1, 0) & 1
    small = x < 4
    extra = np.where(small, 0, high - 1)
    return np.where(small, x, 2 * high + second), np.where(small, 0, x & ((1 << extra) - 1)), extra


def _matches(px: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, length, distance) of runs of at least ``least`` values that occurred before, left to right and apart."""
    n = len(px)
    if n < 2 * least:
        return []
    key = np.zeros(n - least + 1, np.uint64)
    for k in range(least):
        key = key * np.uint64(0x9E3779B97F4A7C15) + px[k : n - least + 1 + k].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    before = np.full(len(key), -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    found, at = [], 0
    narrow = px.max() < 256
    values = px.astype(np.uint8).tobytes() if narrow else px.tolist()
    step = 16
    where = np.flatnonzero(before >= 0)
    for i, j in zip(where.tolist(), before[where].tolist()):
        if i < at or i - j > FARTHEST:
            continue
        k, most = 0, min(4096, n - i)
        while k + step <= most and values[i + k : i + k + step] == values[j + k : j + k + step]:
            k += step
        while k < most and values[i + k] == values[j + k]:
            k += 1
        if k >= least:
            found.append((i, k, i - j))
            at = i + k
    return found


def _write_image(out: Writer, px: np.ndarray, main: bool, cache_bits: int = 0) -> None:
    """An entropy-coded image of ARGB values, with back-references and, if asked for, a colour cache."""
    out.put([1, cache_bits] if cache_bits else 0, [1, 4] if cache_bits else 1)
    if main:
        out.put(0, 1)
    found = _matches(px, MATCH) if main else []
    literal = np.ones(len(px), bool)
    for i, k, _ in found:
        literal[i : i + k] = False
    at = np.flatnonzero(literal)
    hit = np.zeros(len(px), bool)
    if cache_bits:
        slot = (CACHE_FACTOR * px & 0xFFFFFFFF) >> (32 - cache_bits)
        order = np.argsort(slot, kind="stable")
        hit[order[1:]] = (px[order[1:]] == px[order[:-1]])
    c = _split(px)
    green = np.where(hit, GREENS + LENGTHS + (slot if cache_bits else 0), c[:, 2])[at]
    plain = ~hit[at]
    start = np.array([f[0] for f in found], np.int64)
    long, more, n_more = _prefix(np.array([f[1] for f in found], np.int64))
    far, beyond, n_beyond = _prefix(np.array([f[2] for f in found], np.int64) + len(PLANE))
    total = GREENS + LENGTHS + ((1 << cache_bits) if cache_bits else 0)
    kept = c[at][plain]
    counts = [np.bincount(np.concatenate([green, long + GREENS]), minlength=total)] + [np.bincount(kept[:, k], minlength=256) for k in (1, 3, 0)] + [np.bincount(far, minlength=DISTANCES)]
    (gw, gn), (rw, rn), (bw, bn), (aw, an), (dw, dn) = (_write_code(out, k) for k in counts)
    # four parts a token: a literal's samples, or a cache code, or length, its bits, distance, its bits
    v, n = np.zeros((len(px), 4), np.int64), np.zeros((len(px), 4), np.int64)
    v[at, 0], n[at, 0] = gw[green], gn[green]
    lit = at[plain]
    for k, (w, s, chan) in enumerate(((rw, rn, 1), (bw, bn, 3), (aw, an, 0)), 1):
        v[lit, k], n[lit, k] = w[c[lit, chan]], s[c[lit, chan]]
    if found:
        v[start] = np.stack([gw[long + GREENS], more, dw[far], beyond], axis=1)
        n[start] = np.stack([gn[long + GREENS], n_more, dn[far], n_beyond], axis=1)
    out.put(v.reshape(-1), n.reshape(-1))


def _cost(samples: np.ndarray) -> float:
    """Bits that the samples take by their own frequencies."""
    total = 0.0
    for k in range(samples.shape[-1]):
        n = np.bincount(samples[..., k].reshape(-1), minlength=256)
        n = n[n > 0]
        total -= float((n * np.log2(n / n.sum())).sum())
    return total


def encode(rgba: np.ndarray, force: tuple[str, ...] | None = None, modes: np.ndarray | None = None, block: int = 4) -> bytes:
    """A lossless WebP file of (height, width, 4) samples. ``force`` names the transforms to use instead of choosing:
    any of palette, predictor (with ``modes`` by block), cross, green."""
    h, w, _ = rgba.shape
    c = rgba[..., [3, 0, 1, 2]].astype(np.int64)
    px = _packed(c).reshape(-1)
    out = Writer()
    out.put([0x2F, w - 1, h - 1, int((c[..., 0] != 255).any()), 0], [8, 14, 14, 1, 3])
    colours, index = np.unique(px, return_inverse=True) if force is None or "palette" in force else (None, None)
    if (force is None and len(colours) <= 256 and 4 * len(colours) <= len(px)) or (force and "palette" in force):
        if len(colours) > 256:
            raise ValueError("too many colours for a palette")
        k = len(colours)
        size = 3 if k <= 2 else 2 if k <= 4 else 1 if k <= 16 else 0
        table = _split(colours)
        out.put([1, PALETTE, k - 1], [1, 2, 8])
        _write_image(out, _packed(np.diff(table, axis=0, prepend=0) & 0xFF), False)
        index = index.reshape(h, w)
        if size:
            per, group = 8 >> size, 1 << size
            index = np.pad(index, ((0, 0), (0, -w % group))).reshape(h, -1, group)
            index = (index << (np.arange(group) * per)).sum(axis=2)
        px = (255 << 24 | index << 8).reshape(-1)
    else:
        mode = None
        if force is None:
            # most texts gain nothing from a prediction; where few samples repeat, none is tried
            near = max(float((c[:, 1:] == c[:, :-1]).mean()) if w > 1 else 0.0, float((c[1:] == c[:-1]).mean()) if h > 1 else 0.0)
            best = _cost(c[..., 1:]) if near > 0.45 else 0.0
            for k in (1, 2) if best else ():
                guess = _predicted(c, np.full((h, w), k), False)
                if (cost := _cost(guess[..., 1:])) < best:
                    best, mode, made = cost, k, guess
            if mode:
                out.put([1, PREDICTOR, 7], [1, 2, 3])
                _write_image(out, np.full(-(-w >> 9) * -(-h >> 9), 255 << 24 | mode << 8), False)
                px = _packed(made).reshape(-1)
        else:
            if "predictor" in force:
                out.put([1, PREDICTOR, block - 2], [1, 2, 3])
                _write_image(out, 255 << 24 | modes.reshape(-1).astype(np.int64) << 8, False)
                c = _predicted(c, _blocks(modes.reshape(-1), block, w, h), False)
            if "cross" in force:
                wide, high = -(-w >> block), -(-h >> block)
                data = np.random.default_rng(w * h).integers(0, 1 << 24, wide * high) | 255 << 24
                out.put([1, CROSS, block - 2], [1, 2, 3])
                _write_image(out, data, False)
                c = _crossed(c, _blocks_of(data, block, w, h), False)
            if "green" in force:
                out.put([1, GREEN], [1, 2])
                c = c.copy()
                c[..., 1] = (c[..., 1] - c[..., 2]) & 0xFF
                c[..., 3] = (c[..., 3] - c[..., 2]) & 0xFF
            px = _packed(c).reshape(-1)
    out.put(0, 1)
    _write_image(out, px, True, CACHE_BITS if len(px) > 256 else 0)
    body = b"VP8L" + len(stream := out.bytes()).to_bytes(4, "little") + stream + bytes(len(stream) & 1)
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body


# --- many images of one width at once -------------------------------------------------------------------------


def _lengths_many(counts: np.ndarray, most: int) -> np.ndarray:
    """Prefix code lengths for each row of ``counts``, at most ``most``: from the rounded-up information of each symbol, then
    made complete by shortening the most frequent symbols that the room left over allows (or lengthening, where rare ones were cut)."""
    used = counts > 0
    total = counts.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        info = np.ceil(np.log2(total / counts) - 1e-9)
    first = np.clip(np.where(used, info, 0), used, most).astype(np.int64)
    rows = len(counts)
    n = np.zeros((rows, most + 1), np.int64)
    np.add.at(n, (np.nonzero(used)[0], first[used]), 1)
    n[:, 0] = 0
    unit = 1 << (most - np.arange(most + 1))
    room = (1 << most) - (n * unit).sum(axis=1)
    room[used.sum(axis=1) < 2] = 0  # a lone symbol takes no bits
    while (room < 0).any():
        for k in range(most - 1, 0, -1):
            m = np.minimum(n[:, k], np.where(room < 0, -(room // unit[k + 1]), 0))
            n[:, k] -= m
            n[:, k + 1] += m
            room += m * unit[k + 1]
    while (room > 0).any():
        for k in range(2, most + 1):
            m = np.minimum(n[:, k], np.maximum(room, 0) // unit[k])
            n[:, k] -= m
            n[:, k - 1] += m
            room -= m * unit[k]
    order = np.argsort(-counts, axis=1, kind="stable")
    out = np.zeros(counts.shape, np.int64)
    each = used.sum(axis=1)
    ranked = np.repeat(np.tile(np.arange(most + 1), rows), n.reshape(-1))
    at = np.repeat(np.arange(rows), each), np.arange(len(ranked)) - np.repeat(np.cumsum(each) - each, each)
    out[at[0], order[at]] = ranked
    return out


def _words_many(lengths: np.ndarray) -> np.ndarray:
    """Canonical words of each row's lengths, first bit lowest."""
    rows, size = lengths.shape
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    n = np.take_along_axis(lengths, order, axis=1)
    span = np.where(n > 0, 1 << (15 - n), 0)
    full = (np.cumsum(span, axis=1) - span) >> (15 - n)
    out = np.zeros((rows, size), np.int64)
    np.put_along_axis(out, order, np.where(n > 0, _reversed(full, n), 0), axis=1)
    return out


class Section:
    """A part of many streams: values of up to 64 bits with their sizes and the stream each belongs to, in order of streams."""

    def __init__(self, doc: np.ndarray, value: np.ndarray, size: np.ndarray):
        self.doc, self.value, self.size = doc, value.astype(np.uint64), size.astype(np.int64)


def _joined_bits(sections: list[Section], n: int) -> list[bytes]:
    """The streams of ``n`` images: each one's parts, section by section."""
    bits = np.stack([np.bincount(s.doc, s.size, n).astype(np.int64) for s in sections])
    words = -(-bits.sum(axis=0) // 64) + 1
    base = (np.cumsum(words) - words) * 64
    out = np.zeros(int(words.sum()), np.uint64)
    begins = base + np.cumsum(bits, axis=0) - bits
    for s, begin in zip(sections, begins):
        if not len(s.doc):
            continue
        ends = np.cumsum(s.size)
        heads = np.flatnonzero(np.diff(s.doc, prepend=-1))
        within = ends - s.size
        at = within - np.repeat(within[heads], np.diff(heads, append=len(s.doc))) + begin[s.doc]
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        low = s.value << shift
        high = np.where(shift > 0, s.value >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] |= np.bitwise_or.reduceat(low, starts)
        out[word[starts] + 1] |= np.bitwise_or.reduceat(high, starts)
    raw = out.tobytes()
    total = bits.sum(axis=0)
    return [raw[b >> 3 : (b >> 3) + (t + 7 >> 3)] for b, t in zip(base.tolist(), total.tolist())]


def _coded(counts: np.ndarray) -> tuple[Section, np.ndarray, np.ndarray]:
    """(how each row's prefix code is written, its words, its bits) for rows of counts; a lone symbol takes no bits."""
    rows, size = counts.shape
    each = (counts > 0).sum(axis=1)
    lengths = _lengths_many(counts, LONGEST)
    words = _words_many(lengths)
    bits = np.where(each[:, None] > 1, lengths, 0)
    last = size - 1 - (counts[:, ::-1] > 0).argmax(axis=1)
    simple = (each <= 2) & ((last < 256) | (each == 0))
    first = (counts > 0).argmax(axis=1)
    doc, value, width, place = [], [], [], []
    at = np.flatnonzero(simple)
    two = each[at] == 2
    doc.append(at), value.append(1 | two << 1 | 1 << 2 | first[at] << 3 | np.where(two, last[at], 0) << 11), width.append(np.where(two, 19, 11)), place.append(np.zeros(len(at), np.int64))
    at = np.flatnonzero(~simple)
    if len(at):
        # lengths in order, runs of three zeros and more by their two codes
        flat = lengths[at].reshape(-1)
        starts = np.flatnonzero((flat != 0) | (np.concatenate(([1], flat[:-1])) != 0) | (np.arange(len(flat)) % size == 0))
        run = np.where(flat[starts] == 0, np.diff(starts, append=len(flat)), 1)
        zero = flat[starts] == 0
        whole = np.where(zero, run // 138, 0)
        rest = np.where(zero, run % 138, 0)
        # tokens of a run: full 138s, then what is left: one long or short run, or single zeros
        left = np.where(~zero, 1, np.where(rest >= 3, 1, rest))
        m = whole + left
        of = np.repeat(np.arange(len(starts)), m)
        k = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
        big = k < whole[of]
        r = rest[of]
        symbol = np.where(big, 18, np.where(~zero[of], flat[starts][of], np.where(r >= 11, 18, np.where(r >= 3, 17, 0))))
        extra = np.where(big, 127, np.where(zero[of] & (r >= 11), r - 11, np.where(zero[of] & (r >= 3), r - 3, 0)))
        n_extra = np.where(symbol == 18, 7, np.where(symbol == 17, 3, 0))
        row = starts[of] // size
        tokens = np.bincount(row * 19 + symbol, minlength=19 * len(at)).reshape(-1, 19)
        own = _lengths_many(tokens, 7)
        own_words, own_bits = _words_many(own), np.where((tokens > 0).sum(axis=1)[:, None] > 1, own, 0)
        listed = own[:, CODE_ORDER]
        n = np.maximum(19 - (listed[:, ::-1] > 0).argmax(axis=1), 4)
        packed = (listed << (3 * np.arange(19))).sum(axis=1)
        doc += [at, at, at, at[row]]
        value += [(n - 4) << 1, packed, np.zeros(len(at), np.int64), own_words[row, symbol] | extra << own_bits[row, symbol]]
        width += [np.full(len(at), 5), 3 * n, np.ones(len(at), np.int64), own_bits[row, symbol] + n_extra]
        place += [np.zeros(len(at), np.int64), np.ones(len(at), np.int64), np.full(len(at), 2), np.arange(len(row)) + 3]
    doc, value, width, place = (np.concatenate(x) for x in (doc, value, width, place))
    order = np.lexsort((place, doc))
    return Section(doc[order], value[order], width[order]), words, bits


def _bits_of(c: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Bits that each image's three samples take by their own frequencies."""
    total = np.zeros(n)
    for k in range(3):
        counts = np.bincount(doc * 256 + c[:, k], minlength=256 * n).reshape(n, 256).astype(np.float64)
        total += np.where(counts > 0, counts * np.log2(np.where(counts > 0, np.maximum(counts.sum(axis=1, keepdims=True), 1) / np.maximum(counts, 1), 1)), 0).sum(axis=1)
    return total


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """Lossless WebP files of (height, width, 3) samples of one width. Of each image the cheapest of no transform,
    subtract-green, cross-colour, and the predictors from the left and from above is written, with back-references and, where
    it saves bits, a colour cache. Images of few colours take the palette."""
    n, w = len(images), images[0].shape[1]
    high = np.array([len(im) for im in images], np.int64)
    rows = np.concatenate(images)
    pixels_of = high * w
    doc = np.repeat(np.arange(n), pixels_of)
    top = np.repeat(False, len(rows))
    top[np.cumsum(high) - high] = True
    raw = rows.reshape(-1, 3)
    # the transforms that are tried, each with its samples
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    left[1:, 0] -= np.where(top[1:, None], 0, rows[:-1, 0]).astype(np.uint8)
    above = rows.copy()
    above[1:] -= np.where(top[1:, None, None], 0, rows[:-1]).astype(np.uint8)
    above[top] = left[top]
    green = raw.copy()
    green[:, 0] -= raw[:, 1]
    green[:, 2] -= raw[:, 1]
    s = raw.astype(np.int8).astype(np.float64)
    sums = [np.bincount(doc, v, n) for v in (s[:, 1], s[:, 0], s[:, 2], s[:, 1] * s[:, 1], s[:, 1] * s[:, 0], s[:, 1] * s[:, 2])]
    spread = np.maximum(sums[3] - sums[0] ** 2 / pixels_of, 1)
    slope = [np.clip(np.rint(32 * (sums[k] - sums[0] * sums[j] / pixels_of) / spread), -128, 127).astype(np.int64) for k, j in ((4, 1), (5, 2))]
    crossed = raw.copy()
    for k, m in zip((0, 2), slope):
        crossed[:, k] -= (m[doc] * raw[:, 1].astype(np.int8) >> 5).astype(np.uint8)
    tried = [raw, green, crossed, left.reshape(-1, 3), above.reshape(-1, 3)]
    side = np.array([0, 3, 60, 60, 60])
    costs = np.stack([_bits_of(c, doc, n) for c in tried]) + side[:, None]
    best = costs.argmin(axis=0)
    c = tried[0].copy()
    for k in range(1, len(tried)):
        if (best == k).any():
            mask = (best == k)[doc]
            c[mask] = tried[k][mask]
    alpha = np.where(best >= 3, 0, 255)
    px = (c[:, 0].astype(np.uint32) << 16) | (c[:, 1].astype(np.uint32) << 8) | c[:, 2] | (alpha[doc].astype(np.uint32) << 24)
    begin = np.cumsum(pixels_of) - pixels_of
    # runs that occurred before, by equal hashes of MATCH pixels inside an image
    key = np.zeros(max(len(px) - MATCH + 1, 0), np.uint64)
    for k in range(MATCH):
        key = key * np.uint64(0x9E3779B97F4A7C15) + px[k : len(key) + k]
    key += doc[: len(key)].astype(np.uint64) << np.uint64(40)
    key[doc[: len(key)] != doc[MATCH - 1 :]] = np.arange(int((doc[: len(key)] != doc[MATCH - 1 :]).sum()), dtype=np.uint64) << np.uint64(1)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    later, earlier = order[1:][same], order[:-1][same]
    by = np.argsort(later)
    found: list[tuple[int, int, int]] = []
    text, end_of = px.tobytes(), np.cumsum(pixels_of)
    at = 0
    for i, j, stop in zip(later[by].tolist(), earlier[by].tolist(), end_of[doc[later[by]]].tolist()):
        if i < at or i - j > FARTHEST:
            continue
        most, k = min(4096, stop - i), 0
        while k + 16 <= most and text[4 * (i + k) : 4 * (i + k + 16)] == text[4 * (j + k) : 4 * (j + k + 16)]:
            k += 16
        while k < most and text[4 * (i + k) : 4 * (i + k + 1)] == text[4 * (j + k) : 4 * (j + k + 1)]:
            k += 1
        if k >= MATCH:
            found.append((i, k, i - j))
            at = i + k
    runs = np.array(found, np.int64).reshape(-1, 3)
    border = np.zeros(len(px) + 1, np.int64)
    border[runs[:, 0]] += 1
    np.add.at(border, runs[:, 0] + runs[:, 1], -1)
    literal = np.cumsum(border[:-1]) == 0
    slot = (px * np.uint32(CACHE_FACTOR) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
    by = np.argsort((doc << CACHE_BITS | slot).astype(np.uint16) if n << CACHE_BITS <= 1 << 16 else doc << CACHE_BITS | slot, kind="stable")
    hit = np.zeros(len(px), bool)
    hit[by[1:]] = (px[by[1:]] == px[by[:-1]]) & (doc[by[1:]] == doc[by[:-1]])
    hit &= literal
    # the cache where it saves bits: counts of both forms
    total = GREENS + LENGTHS + (1 << CACHE_BITS)
    lit = np.flatnonzero(literal)

    def plain_cost(keep):
        g = np.where(keep[lit], GREENS + LENGTHS + slot[lit], c[lit, 1])
        out = np.zeros(n)
        for values, size, where in ((g, total, lit), (c[lit, 0][~keep[lit]], 256, lit[~keep[lit]]), (c[lit, 2][~keep[lit]], 256, lit[~keep[lit]])):
            m = np.bincount(doc[where] * size + values, minlength=n * size).reshape(n, size).astype(np.float64)
            out += np.where(m > 0, m * np.log2(np.maximum(m.sum(axis=1, keepdims=True), 1) / np.maximum(m, 1)), 0).sum(axis=1) + 4 * (m > 0).sum(axis=1)
        return out

    cached = plain_cost(hit) < plain_cost(np.zeros(len(px), bool))
    hit &= cached[doc]
    # codes: green with lengths and cache slots, red, blue, distances; alpha is one value
    long, more, n_more = _prefix(runs[:, 1])
    far, beyond, n_beyond = _prefix(runs[:, 2] + len(PLANE))
    run_doc = doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    symbol = np.where(hit, GREENS + LENGTHS + slot, c[:, 1])[lit]
    whole = lit[~hit[lit]]
    size = np.where(cached, total, GREENS + LENGTHS)
    greens = np.bincount(np.concatenate([doc[lit] * total + symbol, run_doc * total + long + GREENS]), minlength=n * total).reshape(n, total)
    coded: list = [None, None]
    for k, flag in enumerate((False, True)):
        at = np.flatnonzero(cached == flag)
        coded[k] = (at, *_coded(greens[at][:, : total if flag else GREENS + LENGTHS])) if len(at) else None
    green_words, green_bits = np.zeros((n, total), np.int64), np.zeros((n, total), np.int64)
    parts = []
    for x in coded:
        if x:
            at, s, words, bits = x
            green_words[at, : words.shape[1]], green_bits[at, : words.shape[1]] = words, bits
            parts.append(Section(at[s.doc], s.value, s.size))
    doc_c, value_c, size_c = (np.concatenate([getattr(p, f) for p in parts]) for f in ("doc", "value", "size"))
    by = np.argsort(doc_c, kind="stable")
    green_code = Section(doc_c[by], value_c[by], size_c[by])
    reds, blues = (_coded(np.bincount(doc[whole] * 256 + c[whole, k], minlength=n * 256).reshape(n, 256)) for k in (0, 2))
    fars = _coded(np.bincount(run_doc * DISTANCES + far, minlength=n * DISTANCES).reshape(n, DISTANCES))
    # headers: sizes, transforms, cache, no groups
    head = [(0x2F, 8), (w - 1, 14), (high - 1, 14), (0, 1), (0, 3)]
    one = lambda v: 1 | 1 << 2 | v << 3  # noqa: E731 - a code of one symbol in 11 bits
    lone = (lambda g, r, b, a: [(0, 1), (one(g), 11), (one(r), 11), (one(b), 11), (one(a), 11), (one(0), 11)])
    kinds = {0: [], 1: [(1, 1), (GREEN, 2)], 2: [(1, 1), (CROSS, 2), (7, 3), *lone(slope[1] & 255, 0, slope[0] & 255, 255)], 3: [(1, 1), (PREDICTOR, 2), (7, 3), *lone(1, 0, 0, 255)], 4: [(1, 1), (PREDICTOR, 2), (7, 3), *lone(2, 0, 0, 255)]}
    fields = [(np.broadcast_to(np.asarray(v), n), np.full(n, b)) for v, b in head]
    for k, extra in kinds.items():
        fields += [(np.broadcast_to(np.asarray(v), n), np.where(best == k, b, 0)) for v, b in extra]
    fields += [(np.zeros(n, np.int64), np.ones(n, np.int64)), (np.where(cached, 1 | CACHE_BITS << 1, 0), np.where(cached, 5, 1)), (np.zeros(n, np.int64), np.ones(n, np.int64))]
    value, bits = (np.stack([f[k] for f in fields], axis=1).reshape(-1) for k in (0, 1))
    keep = bits > 0
    header = Section(np.repeat(np.arange(n), len(fields))[keep], value[keep], bits[keep])
    alphas = Section(np.arange(n), one(alpha), np.full(n, 11))
    # tokens by place: a literal's three words in one, a cache slot's word, or a copy's length and distance
    v, b = np.zeros(len(px), np.uint64), np.zeros(len(px), np.int64)
    d = doc[lit]
    v[lit], b[lit] = green_words[d, symbol].astype(np.uint64), green_bits[d, symbol]
    for (_, words, sizes), k in ((reds, 0), (blues, 2)):
        x = c[whole, k]
        v[whole] |= words[doc[whole], x].astype(np.uint64) << b[whole].astype(np.uint64)
        b[whole] += sizes[doc[whole], x]
    if len(runs):
        at = runs[:, 0]
        value, bits = green_words[run_doc, long + GREENS].astype(np.uint64), green_bits[run_doc, long + GREENS]
        for x, k in ((more, n_more), (fars[1][run_doc, far], fars[2][run_doc, far]), (beyond, n_beyond)):
            value = value | x.astype(np.uint64) << bits.astype(np.uint64)
            bits = bits + k
        v[at], b[at] = value, bits
    keep = literal.copy()
    keep[runs[:, 0]] = True
    tokens = Section(doc[keep], v[keep], b[keep])
    out = []
    for stream in _joined_bits([header, green_code, reds[0], blues[0], alphas, fars[0], tokens], n):
        body = b"VP8L" + len(stream).to_bytes(4, "little") + stream + bytes(len(stream) & 1)
        out.append(b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body)
    # few colours: the palette, if it comes out smaller
    change = np.concatenate(([True], (px[1:] != px[:-1]) | (doc[1:] != doc[:-1])))
    colours = np.bincount(doc[change][np.unique(doc[change].astype(np.uint64) << np.uint64(32) | px[change], return_index=True)[1]], minlength=n)
    for k in np.flatnonzero((colours <= 256) & (4 * colours <= pixels_of)).tolist():
        other = encode(np.concatenate([images[k], np.full((*images[k].shape[:2], 1), 255, np.uint8)], axis=2))
        out[k] = min(out[k], other, key=len)
    return out


def _tables(lengths: list[np.ndarray]) -> np.ndarray:
    """Tables (symbol * 16 + bits) of many codes, a row each, over words of the longest code's length."""
    rows = np.repeat(np.arange(len(lengths)), [len(x) for x in lengths])
    flat = np.concatenate(lengths).astype(np.int64)
    symbol = np.arange(len(flat)) - np.repeat(np.cumsum([0] + [len(x) for x in lengths[:-1]]), [len(x) for x in lengths])
    used = flat > 0
    rows, flat, symbol = rows[used], flat[used], symbol[used]
    each = np.bincount(rows, minlength=len(lengths))
    if (each == 0).any():
        missing = np.flatnonzero(each == 0)  # a code without symbols reads as symbol 0
        rows, flat, symbol = np.concatenate([rows, missing]), np.concatenate([flat, np.ones_like(missing)]), np.concatenate([symbol, np.zeros_like(missing)])
        each = np.bincount(rows, minlength=len(lengths))
    lone = each[rows] == 1
    order = np.lexsort((symbol, flat, rows))
    rows, flat, symbol, lone = rows[order], flat[order], symbol[order], lone[order]
    wide = int(flat[~lone].max(initial=1))
    spans = np.where(lone, 1 << wide, 1 << (wide - np.minimum(flat, wide)))
    if (np.bincount(rows, spans, len(lengths)) != 1 << wide).any():
        raise ValueError("an incomplete prefix code")
    table = np.repeat((symbol << 4 | np.where(lone, 0, flat)).astype(np.int16 if symbol.max() < 2048 else np.int32), spans).reshape(len(lengths), 1 << wide)
    return np.ascontiguousarray(table[:, _index(wide)])


def _lengths_of_many(at: np.ndarray, size: np.ndarray, window) -> tuple[np.ndarray, np.ndarray]:
    """``_read_lengths`` for many streams that advance together: (rows of lengths, where each stream goes on)."""
    out = np.zeros((len(at), int(size.max())), np.int64)
    w = window(at)
    simple = (w & 1) == 1
    rows = np.flatnonzero(simple)
    two, wide = w[rows] >> 1 & 1, w[rows] >> 2 & 1
    out[rows, w[rows] >> 3 & np.where(wide == 1, 255, 1)] = 1
    after = 3 + np.where(wide == 1, 8, 1)
    out[rows[two == 1], (w[rows] >> after & 255)[two == 1]] = 1
    at = at.copy()
    at[rows] += after + 8 * two
    rows = np.flatnonzero(~simple)
    if not len(rows):
        return out, at
    q, size = at[rows] + 1, size[rows]
    n = (window(q) & 15) + 4
    w = window(q + 4)
    own = np.zeros((len(rows), 19), np.int64)
    for k, symbol in enumerate(CODE_ORDER):
        own[:, symbol] = np.where(k < n, w >> (3 * k) & 7, 0)
    q += 4 + 3 * n
    w = window(q)
    limited, bits = w & 1 == 1, 2 + 2 * (w >> 1 & 7)
    left = np.where(limited, 2 + (w >> 4 & (1 << bits) - 1), size)
    q += np.where(limited, 4 + bits, 1)
    tables = _tables(list(own))
    mask = tables.shape[1] - 1
    live, done, before = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.full(len(rows), 8)
    while len(live):
        w = window(q[live])
        e = tables[live, w & mask].astype(np.int64)
        bits, symbol = e & 15, e >> 4
        x = w >> bits
        again, few, many = symbol == 16, symbol == 17, symbol == 18
        times = np.where(symbol < 16, 1, np.where(again, 3 + (x & 3), np.where(few, 3 + (x & 7), 11 + (x & 127))))
        value = np.where(symbol < 16, symbol, np.where(again, before[live], 0))
        place = done[live]
        if (place + times > size[live]).any():
            raise ValueError("a code's lengths run over")
        out[rows[live], place] = np.where(many | few, 0, value)
        for k in np.flatnonzero(again).tolist():
            out[rows[live[k]], place[k] : place[k] + times[k]] = value[k]
        before[live] = np.where((symbol < 16) & (symbol > 0), symbol, before[live])
        q[live] += bits + np.where(again, 2, np.where(few, 3, np.where(many, 7, 0)))
        done[live] += times
        left[live] -= 1
        live = live[(done[live] < size[live]) & (left[live] > 0)]
    at[rows] = q
    return out, at


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The samples of many files, whose prefix codes are read together. Files with grouped codes or varying alpha are read pixel by pixel."""
    out: list = [None] * len(files)
    heads = []
    for k, raw in enumerate(files):
        head = _opened(raw)
        bits = head[0]
        mark = bits.at
        cache_bits = bits.take(4) if bits.take(1) else 0
        grouped = bits.take(1)
        heads.append((k, head, cache_bits, grouped, mark))
    raws = [h[1][0].raw for h in heads]
    begin = 8 * (np.cumsum([0] + [len(r) for r in raws])[:-1])
    joined = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint64)
    wide = joined.copy()
    for k in range(1, 8):
        wide[:-k] |= joined[k:] << np.uint64(8 * k)
    last = 8 * len(wide) - 1

    def window(at: np.ndarray) -> np.ndarray:
        at = np.minimum(at, last)
        return (wide[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << 57) - 1)).astype(np.int64)

    plain = [i for i, h in enumerate(heads) if not h[3]]
    codes, at = [], np.array([heads[i][1][0].at for i in plain], np.int64) + begin[plain]
    for size in (np.array([GREENS + LENGTHS + (1 << heads[i][2] if heads[i][2] else 0) for i in plain], np.int64), *(np.full(len(plain), n) for n in (256, 256, 256, DISTANCES))):
        if len(plain):
            lengths, at = _lengths_of_many(at, size, window)
            codes.append(lengths)
    one_alpha = np.count_nonzero(codes[3], axis=1) <= 1 if plain else []
    tables = [_tables(list(c)) for c in (codes[0], codes[1], codes[2], codes[4])] if plain else []
    fast = {i: j for j, i in enumerate(plain) if one_alpha[j]}
    for i, (k, head, cache_bits, _, mark) in enumerate(heads):
        bits = head[0]
        if i in fast:
            j = fast[i]
            bits.at = int(at[j] - begin[i])
            argb = _expanded(*_symbols(head, *(t[j] for t in tables)), int(codes[3][j].argmax()) << 24, cache_bits)
        else:
            bits.at = mark
            argb = _read_image(bits, head[4], head[2], True)
        out[k] = _finished(head, argb)
    return out


def _symbols(head: tuple, green: np.ndarray, red: np.ndarray, blue: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An image's symbols in order, with (red, blue) of literals and (length, distance) of copies.

    What each bit position would read as, and where it would go on, is looked up for all positions at once; then the
    positions that the stream does go through are followed, eight at a step.
    """
    bits, _, height, _, width = head
    goal = width * height
    start = bits.at >> 3
    raw = np.frombuffer(bits.raw, np.uint8)[start : (bits.size >> 3) + 64].astype(np.int64)
    wide = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    win = np.repeat(wide, 8)
    win >>= np.arange(len(win)) & 7
    # what lies further than any pixel reaches is behind the end
    last = len(win) - 64
    g, r, b = (np.take(t, win & (len(t) - 1)) for t in (green, red, blue))
    g = g[:last]
    p1 = np.arange(last) + (g & 15)
    red_at = np.take(r, p1)
    p2 = p1 + (red_at & 15)
    blue_at = np.take(b, p2)
    then = np.where(g < GREENS << 4, p2 + (blue_at & 15), p1)
    copies = np.flatnonzero((g >= GREENS << 4) & (g < GREENS + LENGTHS << 4))
    found: tuple = (copies, 0, 0)
    if len(copies):

        def number(code, at):
            extra = np.where(code < 4, 0, code - 2 >> 1)
            more = wide[at >> 3] >> (at & 7) & ((1 << extra) - 1)
            return np.where(code < 4, code + 1, ((2 + (code & 1)) << extra) + more + 1), np.minimum(at + extra, last)

        length, q = number((g[copies] >> 4).astype(np.int64) - GREENS, p1[copies])
        d = dist[win[q] & len(dist) - 1].astype(np.int64)
        back, q = number(d >> 4, np.minimum(q + (d & 15), last))
        near = back <= len(PLANE)
        x, y = _PLANE[np.minimum(back, len(PLANE)) - 1].T
        found = copies, np.minimum(length, 1 << 24), np.where(near, np.maximum(1, x + y * width), back - len(PLANE))
        then[copies] = q
    last -= 1
    np.minimum(then, last, out=then)
    jumps = [then]
    for _ in range(3):
        jumps.append(np.take(jumps[-1], jumps[-1]))
    far, at, path = memoryview(jumps[3]), bits.at - 8 * start, []
    while at < last and len(path) * 8 < goal:
        path.append(at)
        at = far[at]
    where = np.array(path, np.int64)
    for k in (2, 1, 0):
        where = np.stack([where, jumps[k][where]], axis=1).reshape(-1)
    s = (g[where] >> 4).astype(np.int64)
    first, second = (red_at[where] >> 4).astype(np.int64), (blue_at[where] >> 4).astype(np.int64)
    copy = np.flatnonzero((s >= GREENS) & (s < GREENS + LENGTHS))
    took = np.ones(len(s), np.int64)
    if len(copy):
        of = np.searchsorted(found[0], where[copy])
        first[copy] = took[copy] = found[1][of]
        second[copy] = found[2][of]
    total = np.cumsum(took)
    n = int(np.searchsorted(total, goal)) + 1
    if n > len(s) or total[n - 1] != goal or int(then[where[n - 1]]) > bits.size - 8 * start:
        raise ValueError("the stream ends early or leaves the image")
    return s[:n], first[:n], second[:n]


_PLANE = np.array(PLANE, np.int64)


def _expanded(s: np.ndarray, first: np.ndarray, second: np.ndarray, alpha: int, cache_bits: int) -> np.ndarray:
    """An image's pixels from its symbols: literals are (green, red, blue), copies (code, length, distance), others cache slots.

    Each pixel that isn't literal points to an earlier one that it equals: a copy's to where it was copied from, a cache
    slot's to the last one before it of that slot. Pointers are followed by doubling.
    """
    px = alpha | first << 16 | s << 8 | second
    if (s < GREENS).all():
        return px
    copy = (s >= GREENS) & (s < GREENS + LENGTHS)
    n = np.where(copy, first, 1)
    begin = np.cumsum(n) - n
    token = np.repeat(np.arange(len(s)), n)
    here = np.arange(len(token))
    copied, stored = copy[token], s[token] >= GREENS + LENGTHS
    source = np.where(copied, here - second[token], here)
    if (source < 0).any():
        raise ValueError("a back-reference leaves the image")
    px = px[token]
    if stored.any():
        # a copy's slot is its source's, a slot's is known, a literal's is its hash
        slot = np.where(stored, s[token] - GREENS - LENGTHS, (px * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits))
        slot = slot[_followed(source)]
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        place = np.maximum.accumulate(np.where(np.diff(slot[order], prepend=-1) != 0, np.arange(len(order)), 0))
        before = np.where(np.arange(len(order)) > place, np.roll(order, 1), -1)
        previous = np.empty(len(order), np.int64)
        previous[order] = before
        source = np.where(stored, previous, source)
        if (source < 0).any():
            empty = np.flatnonzero(source < 0)  # a slot that nothing was put in yet holds 0
            px[empty], source[empty] = 0, empty
    return px[_followed(source)]


def _followed(source: np.ndarray) -> np.ndarray:
    while True:
        further = source[source]
        if (further == source).all():
            return source
        source = further


# --- texts as images ------------------------------------------------------------------------------------------


def stored_texts(texts: list[str | None]) -> list[tuple[int, bytes]]:
    """(bytes of the text, its media) of each text: UTF-8, blanks up to a positive multiple of PAD, as rows of SIDE pixels, a
    byte a sample; a text of more rows than an image may have takes several files, one after the other."""
    sizes, parts, owner = [], [], []
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        sizes.append(len(raw))
        rows = np.frombuffer(raw + b" " * (-len(raw) % PAD if raw else PAD), np.uint8).reshape(-1, SIDE, 3)
        for at in range(0, len(rows), MAX_SIDE):
            parts.append(rows[at : at + MAX_SIDE])
            owner.append(k)
    files: list[list[bytes]] = [[] for _ in texts]
    made = [b""] * len(parts)
    for group in _groups_by_size([len(p) * PAD for p in parts]):
        for k, f in zip(group, encode_many([parts[k] for k in group])):
            made[k] = f
    for k, f in zip(owner, made):
        files[k].append(f)
    return [(n, b"".join(f)) for n, f in zip(sizes, files)]


def _groups_by_size(sizes: list[int]) -> list[list[int]]:
    """Places in order of size, in groups of GROUP and GROUP_BYTES at most (one at least), so that a group's streams end at about one step."""
    groups: list[list[int]] = []
    total = 0
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if not groups or len(groups[-1]) >= GROUP or total + sizes[k] > GROUP_BYTES:
            groups.append([])
            total = 0
        groups[-1].append(k)
        total += sizes[k]
    return groups


def payloads(media: list[bytes]) -> list[np.ndarray]:
    """The (rows, SIDE, 3) samples of each of ``media``, one or more files in a row."""
    files, owner = [], []
    for k, m in enumerate(media):
        at = 0
        while at < len(m):
            size = 8 + int.from_bytes(m[at + 4 : at + 8], "little")
            files.append(m[at : at + size])
            owner.append(k)
            at += size
    read: list = [None] * len(files)
    # the picture's size is in the header's bits 8 to 36
    rows = [(int.from_bytes(f[21:25], "little") >> 14 & 0x3FFF) + 1 for f in files]
    for group in _groups_by_size([r * PAD for r in rows]):
        for k, c in zip(group, decode_many([files[k] for k in group])):
            read[k] = c[..., :3]
    out: list[list[np.ndarray]] = [[] for _ in media]
    for k, c in zip(owner, read):
        out[k].append(c)
    return [np.concatenate(c) for c in out]


def feature(samples: np.ndarray) -> str:
    """Rows, the mean sample in thousandths, distinct samples, and how many equal the sample before in their row."""
    samples = samples.reshape(len(samples), -1)
    same = int((samples[:, 1:] == samples[:, :-1]).sum())
    kinds = int(np.count_nonzero(np.bincount(samples.reshape(-1), minlength=256)))
    return f"rows={samples.shape[0]};mean={int(samples.sum(dtype=np.int64)) * 1000 // samples.size};kinds={kinds};same={same}"


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches):
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    known: dict[bytes, tuple] = {}  # equal texts of a task, by digest
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            part = b.slice(at, BATCH)
            texts = [t.as_py() or "" for t in part.column("text")]
            keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            if len(known) > 50_000:
                known.clear()
            new = {k: t for k, t in zip(keys, texts) if k not in known}
            stored = stored_texts(list(new.values()))
            for k, (n, media), samples in zip(new, stored, payloads([m for _, m in stored])):
                back = samples.tobytes()
                known[k] = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
            cols = list(zip(*(known[k] for k in keys)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *names])


def text_media(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and what its text's media and their samples, read back, come to.

    Null and empty texts are one row of blanks. Equal texts give equal values; repeated rows and null ids
    pass; other columns are ignored. Per row, no shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_digests, f"doc_id long, {_DIGEST}")


def pixel_arrays(files: DataFrame, content_col: str = "content") -> DataFrame:
    """``files`` with width, height, pixels (red, green, blue, alpha bytes, row by row) and error in place of the content.

    A null or broken file has null pixels and says why in error. Other columns pass, but for those with the new names,
    which are replaced.
    """
    from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

    new = ("width", "height", "pixels", "error")
    names = [c for c in files.columns if c.lower() not in (content_col.lower(), *new)]
    held = free_name(names, "held_content")

    def run(batches):
        for b in batches:
            rows = []
            for raw in b.column(held).to_pylist():
                try:
                    if raw is None:
                        raise ValueError("no content")
                    p = decode(raw)
                    rows.append((p.shape[1], p.shape[0], p.tobytes(), None))
                except (ValueError, IndexError) as e:
                    rows.append((None, None, None, str(e)))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.string())))], names=[*names, *new])

    fields = [StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("pixels", BinaryType()), StructField("error", StringType())]
    rows = files.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{content_col}`").alias(held))
    return rows.mapInArrow(run, StructType([*(files.schema[c] for c in names), *fields]))
