"""Lossless WebP (VP8L): a decoder that takes many images at once, and an encoder for stored samples.

decode() reads prefix codes (simple and normal, several groups by an entropy image), back-references with the distance map,
colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms. Entropy-coded
pixels of all images of a call are decoded in lockstep: one NumPy step takes a pixel of every image that is not done.
Prefix codes that images share are built once.

encode() stores bytes as RGBA samples, 16 pixels (64 bytes) a row, in tiles of at most TILE rows; a medium is the
tiles' WebP files end to end. A tile in which REPEAT pixels or more stand again goes out with back-references, others without; either
way the prefix codes are fixed, made for text, so that equal bytes give equal files. It makes no use of transforms and the colour cache.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable

import numpy as np

from . import hashing as hs

WIDTH, TILE = 16, 256
#: Pixels of a tile that must stand there before, in one run, for a back-reference to them.
REPEAT = 16
#: Fixed values of the format: the order in which lengths of the code-length code are stored ...
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: ... and the (x, y) offsets that the first 120 distance codes stand for.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
_HASH = 0x1E35A7BD


def _slot(argb: int, bits: int) -> int:
    """A colour's place in the cache."""
    return (argb * _HASH & 0xFFFFFFFF) >> (32 - bits)


class BadImage(ValueError):
    """The bytes are no lossless WebP file."""


# ---------------------------------------------------------------- prefix codes


def code_lengths(weights: Iterable[int], limit: int = 15) -> list[int]:
    """Lengths of a Huffman code; weights are flattened until no length is over the limit."""
    w = list(weights)
    used = [s for s, x in enumerate(w) if x]
    out = [0] * len(w)
    if len(used) == 1:
        out[used[0]] = 1
    while len(used) > 1:
        heap = [(w[s], s, (s,)) for s in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= limit:
            for s, d in depth.items():
                out[s] = d
            break
        w = [x and x // 2 + 1 for x in w]
    return out


def canonical(lengths: Iterable[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code with its first bit lowest, length)."""
    lengths = list(lengths)
    code, out = 0, {}
    for n in range(1, 16):
        for s, x in enumerate(lengths):
            if x == n:
                out[s] = int(f"{code:0{n}b}"[::-1], 2), n
                code += 1
        code <<= 1
    return out


def lookup(lengths: list[int]) -> np.ndarray:
    """symbol << 4 | length for every 15 bits that may come next."""
    table = np.zeros(1 << 15, np.int32)
    used = [s for s, x in enumerate(lengths) if x]
    if len(used) <= 1:  # a lone symbol takes no bits
        table[:] = (used[0] if used else 0) << 4
        return table
    if sum(1 << (15 - lengths[s]) for s in used) != 1 << 15:
        raise BadImage("prefix code is not complete")
    for s, (code, n) in canonical(lengths).items():
        table[code :: 1 << n] = s << 4 | n
    return table


# ---------------------------------------------------------------- bits


class BitWriter:
    def __init__(self) -> None:
        self.value = self.n = 0

    def put(self, x: int, bits: int) -> None:
        self.value |= x << self.n
        self.n += bits

    def data(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


class BitReader:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def get(self, bits: int) -> int:
        p = self.pos
        self.pos += bits
        if self.pos > 8 * len(self.data):
            raise BadImage("file ends early")
        return int.from_bytes(self.data[p >> 3 : (p + bits + 7) >> 3], "little") >> (p & 7) & ((1 << bits) - 1)

    def symbol(self, table: np.ndarray) -> int:
        p = self.pos
        e = int(table[int.from_bytes(self.data[p >> 3 : (p >> 3) + 3], "little") >> (p & 7) & 0x7FFF])
        self.pos += e & 15
        return e >> 4


def put_code(w: BitWriter, lengths: list[int]) -> None:
    """A normal prefix code; zero runs are joined."""
    runs: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    i = 0
    while i < len(lengths):
        j = i
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        n = j - i
        if lengths[i] == 0:
            while n >= 3:
                k = min(n, 138)
                runs.append((18, k - 11, 7) if k >= 11 else (17, k - 3, 3))
                n -= k
        else:
            runs.append((lengths[i], 0, 0))
            n -= 1
            while n >= 3:
                k = min(n, 6)
                runs.append((16, k - 3, 2))
                n -= k
        runs += [(lengths[i], 0, 0)] * n
        i = j
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    own = code_lengths(counts, 7)
    w.put(0, 1)
    w.put(19 - 4, 4)
    for s in LENGTH_ORDER:
        w.put(own[s], 3)
    w.put(0, 1)
    codes = canonical(own) if sum(map(bool, own)) > 1 else {s: (0, 0) for s in range(19)}
    for s, extra, bits in runs:
        w.put(*codes[s])
        w.put(extra, bits)


def put_simple(w: BitWriter, symbols: tuple[int, ...]) -> None:
    w.put(1, 1)
    w.put(len(symbols) - 1, 1)
    w.put(1, 1)
    for s in symbols:
        w.put(s, 8)


def get_code(r: BitReader, size: int) -> list[int]:
    lengths = [0] * size
    if r.get(1):
        n, wide = r.get(1) + 1, r.get(1)
        for s in [r.get(8 if wide else 1), *([r.get(8)] if n == 2 else [])]:
            if s >= size:
                raise BadImage("symbol out of range")
            lengths[s] = 1
        return lengths
    own = [0] * 19
    for s in LENGTH_ORDER[: 4 + r.get(4)]:
        own[s] = r.get(3)
    most = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else size
    table, i, before = lookup(own), 0, 8
    while i < size and most:
        most -= 1
        s = r.symbol(table)
        if s < 16:
            lengths[i] = s
            before = s or before
            i += 1
            continue
        n = 3 + r.get(2) if s == 16 else 3 + r.get(3) if s == 17 else 11 + r.get(7)
        if i + n > size:
            raise BadImage("lengths run over")
        lengths[i : i + n] = [before if s == 16 else 0] * n
        i += n
    return lengths


# ---------------------------------------------------------------- decoding


class _Tables:
    """Lookup tables, each distinct code once."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.tables: list[np.ndarray] = []
        self.stack = np.zeros((0, 1 << 15), np.int32)

    def add(self, lengths: list[int]) -> int:
        key = bytes(lengths)
        if key not in self.number:
            self.tables.append(lookup(lengths))
            self.number[key] = len(self.tables) - 1
        return self.number[key]

    def all(self) -> np.ndarray:
        if len(self.stack) != len(self.tables):
            self.stack = np.stack(self.tables)
        return self.stack


class _Stream:
    """An entropy-coded image that is about to be decoded."""

    def __init__(self, width: int, height: int, pos: int, cache_bits: int, groups: np.ndarray, entropy: np.ndarray | None, entropy_bits: int):
        self.width, self.height, self.pos, self.cache_bits, self.groups = width, height, pos, cache_bits, groups
        self.entropy, self.entropy_bits = entropy, entropy_bits


def _header(r: BitReader, width: int, height: int, main: bool, tables: _Tables) -> _Stream:
    cache_bits = r.get(4) if r.get(1) else 0
    if cache_bits > 11:
        raise BadImage("colour cache too large")
    entropy, bits, n = None, 0, 1
    if main and r.get(1):
        bits = r.get(3) + 2
        entropy = _one(r, (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, tables)
        entropy = (entropy >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64)
        n = int(entropy.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = np.array([[tables.add(get_code(r, s)) for s in sizes] for _ in range(n)], np.int64)
    return _Stream(width, height, r.pos, cache_bits, groups, entropy, bits)


def _one(r: BitReader, width: int, height: int, tables: _Tables) -> np.ndarray:
    """A small image inside another: [height, width] of ARGB."""
    s = _header(r, width, height, False, tables)
    (pixels,), (r.pos,) = _pixels([r.data], [s], tables)
    return pixels.reshape(height, width)


def _extended(r_get, code: int) -> int:
    """The value of a length or distance code and its extra bits."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + r_get(extra) + 1


def _pixels(files: list[bytes], streams: list[_Stream], tables: _Tables) -> tuple[list[np.ndarray], list[int]]:
    """ARGB of all streams (of the file beside each), in lockstep, and where each ends."""
    sizes = np.array([len(f) for f in files], np.int64)
    begin = np.cumsum(sizes) - sizes
    blob = np.frombuffer(b"".join(files) + bytes(16), np.uint8)
    words = np.ndarray((len(blob) - 8,), "<u8", blob, 0, (1,))  # 8 bytes from every byte on
    table = tables.all()
    total = np.array([s.width * s.height for s in streams], np.int64)
    base = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint32)
    pos = 8 * begin + np.array([s.pos for s in streams], np.int64)
    cur = np.zeros(len(streams), np.int64)
    several = any(s.entropy is not None for s in streams)
    codes = np.stack([s.groups[0] for s in streams])
    cached = np.array([s.cache_bits for s in streams], np.int64)
    caches = {i: np.zeros(1 << s.cache_bits, np.uint32) for i, s in enumerate(streams) if s.cache_bits}
    live = np.argsort(-total, kind="stable")
    live = live[total[live] > 0]
    mask = np.uint64(0x7FFF)
    seven = np.uint64(7)

    def peek(p):
        return words[p >> 3] >> (p.astype(np.uint64) & seven)

    while len(live):
        lane = live
        if several:
            for i in lane.tolist():
                s = streams[i]
                if s.entropy is not None:
                    y, x = divmod(int(cur[i]), s.width)
                    codes[i] = s.groups[s.entropy[y >> s.entropy_bits, x >> s.entropy_bits]]
        c = codes[lane]
        p = pos[lane]
        v = peek(p)
        g = table[c[:, 0], (v & mask).astype(np.int64)]
        n = g & 15
        g >>= 4
        plain = g < 256
        if plain.all():
            sel = slice(None)
        else:
            sel = np.flatnonzero(plain)
            c, v = c[sel], v[sel]
        v = v >> n[sel].astype(np.uint64)
        red = table[c[:, 1], (v & mask).astype(np.int64)]
        p2 = p[sel] + n[sel] + (red & 15)
        v = peek(p2)
        blue = table[c[:, 2], (v & mask).astype(np.int64)]
        v = v >> (blue & 15).astype(np.uint64)
        alpha = table[c[:, 3], (v & mask).astype(np.int64)]
        who = lane[sel]
        pos[who] = p2 + (blue & 15) + (alpha & 15)
        argb = (alpha >> 4 << 24 | red >> 4 << 16 | g[sel] << 8 | blue >> 4).astype(np.uint32)
        out[base[who] + cur[who]] = argb
        cur[who] += 1
        if caches:
            for i, x in zip(who.tolist(), argb, strict=True):
                if i in caches:
                    caches[i][_slot(int(x), int(cached[i]))] = x
        if not plain.all():
            for k in np.flatnonzero(~plain).tolist():
                i, s = int(lane[k]), streams[int(lane[k])]
                r = BitReader(files[i], int(pos[i] - 8 * begin[i]) + int(n[k]))
                a = base[i] + cur[i]
                if g[k] >= 280:
                    if g[k] - 280 >= 1 << s.cache_bits:
                        raise BadImage("no such colour")
                    new = caches[i][g[k] - 280 : g[k] - 279]
                    out[a] = new[0]
                    size = 1
                else:
                    size = _extended(r.get, int(g[k]) - 256)
                    code = _extended(r.get, r.symbol(table[codes[i, 4]]))
                    dist = code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * s.width)
                    if dist > cur[i] or cur[i] + size > total[i]:
                        raise BadImage("back-reference out of range")
                    new = np.resize(out[a - dist : a], size) if dist < size else out[a - dist : a - dist + size].copy()
                    out[a : a + size] = new
                    if i in caches:
                        for x in new:
                            caches[i][_slot(int(x), s.cache_bits)] = x
                pos[i] = 8 * begin[i] + r.pos
                cur[i] += size
        done = cur[live] >= total[live]
        if done.any():
            live = live[~done]
    ends = pos - 8 * begin
    if (ends > 8 * sizes).any():
        raise BadImage("file ends early")
    return [out[a : a + n] for a, n in zip(base.tolist(), total.tolist(), strict=True)], ends.tolist()


def _halves(a, b):
    return (a + b) >> 1


def _predicted(mode: int, left, top, tl, tr):
    """Prediction of a mode from [.., 4] neighbours (int32)."""
    if mode in (0, 14, 15):
        return np.broadcast_to(np.array([255, 0, 0, 0]), top.shape)
    if mode < 5:
        return (left, top, tr, tl)[mode - 1]
    if mode == 5:
        return _halves(_halves(left, tr), top)
    if mode < 10:
        return (_halves(left, tl), _halves(left, top), _halves(tl, top), _halves(top, tr))[mode - 6]
    if mode == 10:
        return _halves(_halves(left, tl), _halves(top, tr))
    if mode == 11:
        near = np.abs(top - tl).sum(-1) < np.abs(left - tl).sum(-1)  # L1 of L+T-TL to left, and to top
        return np.where(near[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - tl, 0, 255)
    mean = _halves(left, top)
    return np.clip(mean + _half(mean - tl), 0, 255)


def _half(x):
    """Half, towards zero."""
    return np.where(x < 0, -(-x >> 1), x >> 1)


def _unpredict(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """[h, w, 4] residuals (A, R, G, B) and the mode of each block."""
    h, w, _ = argb.shape
    out = argb.astype(np.int32)
    out[0, 0, 0] = (out[0, 0, 0] + 255) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    above_only = {0: None, 2: 0, 3: 1, 4: -1, 8: None, 9: None, 14: None, 15: None}
    for y in range(1, h):
        top = out[y - 1]
        out[y, 0] = (out[y, 0] + top[0]) & 255
        row_modes = modes[y >> bits]
        # the pixel right of the last one is the first of this row
        tr_row = np.concatenate((top[1:], out[y, :1]))
        for bx in range(len(row_modes)):
            a, b = max(1, bx << bits), min(w, (bx + 1) << bits)
            if a >= b:
                continue
            m = int(row_modes[bx])
            if m in above_only:
                out[y, a:b] = (out[y, a:b] + _predicted(m, top[a:b], top[a:b], top[a - 1 : b - 1], tr_row[a:b])) & 255
            elif m == 1:
                out[y, a:b] = (np.cumsum(out[y, a:b], axis=0) + out[y, a - 1]) & 255
            else:
                for x in range(a, b):
                    out[y, x] = (out[y, x] + _predicted(m, out[y, x - 1], top[x], top[x - 1], tr_row[x])) & 255
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    """[..., 4] of A, R, G, B."""
    return argb[..., None].byteswap().view(np.uint8).reshape(*argb.shape, 4)


def _spread(blocks: np.ndarray, bits: int, h: int, w: int) -> np.ndarray:
    return blocks.repeat(1 << bits, axis=0).repeat(1 << bits, axis=1)[:h, :w]


def _uncross(argb: np.ndarray, blocks: np.ndarray, bits: int) -> np.ndarray:
    h, w, _ = argb.shape
    m = _spread(_channels(blocks).view(np.int8).astype(np.int32), bits, h, w)
    out = argb.astype(np.int32)
    signed = lambda x: (x & 255) - ((x & 128) << 1)
    green = signed(out[..., 2])
    out[..., 1] = (out[..., 1] + (m[..., 3] * green >> 5)) & 255
    out[..., 3] = (out[..., 3] + (m[..., 2] * green >> 5) + (m[..., 1] * signed(out[..., 1]) >> 5)) & 255
    return out


def _unpalette(argb: np.ndarray, colours: np.ndarray, bits: int, width: int) -> np.ndarray:
    """[h, packed] of ARGB numbers to [h, width]: indices stand in the green channel, several a pixel."""
    green = (argb >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    per, each = 1 << bits, 8 >> bits
    index = (green[:, :, None] >> (each * np.arange(per)) & ((1 << each) - 1)).reshape(len(argb), -1)[:, :width]
    full = np.concatenate((colours, np.zeros(256, np.uint32)))
    return full[index]


def payload_of(file: bytes) -> bytes:
    """The VP8L data of a WebP file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise BadImage("no WebP file")
    at = 12
    while at + 8 <= len(file):
        kind, size = file[at : at + 4], struct.unpack("<I", file[at + 4 : at + 8])[0]
        if kind == b"VP8L":
            return file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise BadImage("no lossless image in this file")


class Decoder:
    """Decodes lists of files; keeps the tables of codes between calls."""

    def __init__(self) -> None:
        self.tables = _Tables()
        self.known: list[tuple[bytes, int, int, _Stream]] = []  # headers after the size: whole bytes, last bits and their mask

    def decode(self, files: list[bytes]) -> list[np.ndarray]:
        """[height, width, 4] of A, R, G, B of each file."""
        if len(self.tables.tables) > 200:
            self.tables, self.known = _Tables(), []
        datas, streams, plans = [], [], []
        for f in files:
            d = payload_of(f)
            size = int.from_bytes(d[1:5], "little")
            if len(d) < 5 or d[0] != 0x2F or size >> 29:
                raise BadImage("no VP8L data")
            width, height = (size & 0x3FFF) + 1, (size >> 14 & 0x3FFF) + 1
            stream, plan = self._start(d, width, height)
            datas.append(d)
            streams.append(stream)
            plans.append((width, height, plan))
        pixels, _ = _pixels(datas, streams, self.tables) if files else ([], [])
        return [self._finish(p.reshape(s.height, s.width), *x) for p, s, x in zip(pixels, streams, plans, strict=True)]

    def _start(self, d: bytes, width: int, height: int) -> tuple[_Stream, list]:
        for whole, tail, mask, s in self.known:
            n = 5 + len(whole)
            if d[5:n] == whole and len(d) > n and d[n] & mask == tail:
                return _Stream(width, height, s.pos, s.cache_bits, s.groups, None, 0), []
        r = BitReader(d, 40)
        plan, packed = [], width
        while r.get(1):
            kind = r.get(2)
            if kind in (p[0] for p in plan):
                raise BadImage("a transform comes twice")
            if kind in (PREDICTOR, CROSS):
                bits = r.get(3) + 2
                up = (1 << bits) - 1
                plan.append((kind, _one(r, (packed + up) >> bits, (height + up) >> bits, self.tables), bits, packed))
            elif kind == GREEN:
                plan.append((kind, None, 0, packed))
            else:
                n = r.get(8) + 1
                colours = _one(r, n, 1, self.tables)
                # colours are stored as differences, channel by channel
                colours = np.cumsum(_channels(colours[0]).astype(np.int64), axis=0).astype(np.uint8)
                colours = colours.astype(np.uint32) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint32)
                bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                plan.append((kind, colours, bits, packed))
                packed = (packed + (1 << bits) - 1) >> bits
        s = _header(r, packed, height, True, self.tables)
        if not plan and s.entropy is None and len(self.known) < 16:
            n, left = divmod(r.pos - 40, 8)
            mask = (1 << left) - 1
            self.known.append((d[5 : 5 + n], d[5 + n] & mask, mask, s))
        return s, plan

    @staticmethod
    def _finish(argb: np.ndarray, width: int, height: int, plan: list) -> np.ndarray:
        if not plan:
            return _channels(argb)
        for kind, data, bits, packed in reversed(plan):
            if kind == PALETTE:
                argb = _unpalette(argb, data, bits, packed)
                continue
            c = _channels(argb).astype(np.int32)
            if kind == PREDICTOR:
                c = _unpredict(c, (data >> np.uint32(8) & np.uint32(15)).astype(np.int64), bits)
            elif kind == CROSS:
                c = _uncross(c, data, bits)
            else:
                c[..., 1] += c[..., 2]
                c[..., 3] += c[..., 2]
                c &= 255
            argb = c.astype(np.uint32) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint32)
        return _channels(argb.astype(np.uint32))


# ---------------------------------------------------------------- encoding


def text_weights() -> list[int]:
    """Weights of bytes in text: space and letters by their usual order, capitals, digits and others less; none is 0."""
    w = [1] * 256
    for i, c in enumerate("etaoinsrhldcumfgpwybvkxjqz"):
        w[ord(c)], w[ord(c) - 32] = 1200 // (i + 2), 40 // (i // 4 + 1)
    w[32], w[0] = 900, 20
    for c, x in zip(".,\n0123456789-'\":;()?!/@_", (60, 60, 30, *[8] * 10, *[6] * 11), strict=False):
        w[ord(c)] = x
    for b in (*range(0x80, 0xC0), 0xC3):
        w[b] = 12
    w[0xC3] = 60
    return w


_LENGTHS = code_lengths(text_weights(), 14)
#: Codes of the green channel with lengths of back-references behind the bytes, and of distances (all are coded past the near ones).
_WITH_RUNS = code_lengths([*text_weights(), *[2] * 24], 14)
_DISTANCES = code_lengths([1] * 40)
_RUN_CODE, _DISTANCE_CODE = canonical(_WITH_RUNS), canonical(_DISTANCES)
_BITS = np.array([[canonical(lengths)[b][0] for b in range(256)] for lengths in (_LENGTHS, _WITH_RUNS)], np.uint64)
_SIZE = np.array([_LENGTHS, _WITH_RUNS[:256]], np.uint64)


def _fixed_header(runs: bool) -> tuple[int, int]:
    """The bits between the size and the pixels: no transform, no cache, one group, the text code for every channel."""
    w = BitWriter()
    w.put(0, 3)
    put_code(w, _WITH_RUNS if runs else _LENGTHS + [0] * 24)
    for _ in range(3):
        put_code(w, _LENGTHS)
    if runs:
        put_code(w, _DISTANCES)
    else:
        put_simple(w, (0,))
    return w.value, w.n


#: Without back-references, and with them: the header's whole bytes, the bits left over, and their number.
_HEADS = [((v & ((1 << (n & ~7)) - 1)).to_bytes(n >> 3, "little"), v >> (n & ~7), n & 7) for v, n in map(_fixed_header, (False, True))]


def _prefixed(value: int) -> tuple[int, int, int]:
    """A length or distance code as prefix symbol, extra bits and their number."""
    d = value - 1
    if d < 4:
        return d, 0, 0
    top = d.bit_length() - 1
    extra = top - 1
    return 2 * top + (d >> extra & 1), d & ((1 << extra) - 1), extra


def _reference(size: int, distance: int) -> tuple[int, int]:
    """The bits of a back-reference, and their number."""
    value, n = 0, 0
    for code, (symbol, extra, width) in ((_RUN_CODE, _prefixed(size)), (_DISTANCE_CODE, _prefixed(distance + 120))):
        symbol = symbol + 256 if code is _RUN_CODE else symbol
        bits, length = code[symbol]
        value |= (bits | extra << length) << n
        n += length + width
    return value, n


def repeats(pixels: np.ndarray, tile: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of pixels that stand before in the same tile: place, size, distance. They rise and don't overlap; tile: the tile of each pixel."""
    n = len(pixels) - REPEAT + 1
    if n < 2:
        return []
    key = hs.windows(hs.mixed(pixels.astype(np.uint64)), REPEAT)
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (tile[order[1:] + REPEAT - 1] == tile[order[:-1]])
    back = np.zeros(n, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    cut = np.flatnonzero(np.concatenate(([True], back[1:] != back[:-1])))
    out, free = [], 0
    for a, b, d in zip(cut.tolist(), [*cut[1:].tolist(), n], back[cut].tolist(), strict=True):
        a, end = max(a, free), b + REPEAT - 1
        if d and a < b and np.array_equal(pixels[a:end], pixels[a - d : end - d]):
            out.append((a, end - a, d))
            free = end
    return out


def wrap(vp8l: bytes) -> bytes:
    """A WebP file of VP8L data."""
    pad = len(vp8l) % 2
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(vp8l) + pad, b"WEBP", b"VP8L", len(vp8l)) + vp8l + bytes(pad)


def size_bits(width: int, height: int) -> int:
    return width - 1 | (height - 1) << 14 | 1 << 28


def encode(payloads: list[bytes]) -> list[bytes]:
    """A medium of each payload, whose length is a positive multiple of 64."""
    tile = 4 * WIDTH * TILE
    owner, sizes = [], []
    for i, p in enumerate(payloads):
        for a in range(0, len(p), tile):
            owner.append(i)
            sizes.append(min(tile, len(p) - a) // 4)
    if not sizes:
        return [b""] * len(payloads)
    pixels = np.array(sizes, np.int64)
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    b = raw.reshape(-1, 4)  # R, G, B, A
    tile_of = np.repeat(np.arange(len(pixels)), pixels)
    runs_ = repeats(raw.view("<u4"), tile_of)
    kind = np.zeros(len(pixels), np.int64)
    kind[tile_of[[r[0] for r in runs_]]] = 1
    value = np.zeros(len(b), np.uint64)
    length = np.zeros(len(b), np.uint64)
    for channel in (1, 0, 2, 3):  # codes come as green, red, blue, alpha
        which = kind[tile_of] if channel == 1 else 0
        value |= _BITS[which, b[:, channel]] << length
        length += _SIZE[which, b[:, channel]]
    for a, n, d in runs_:  # the first pixel of a run bears the reference, the others nothing
        value[a : a + n], length[a : a + n] = 0, 0
        value[a], length[a] = _reference(n, d)
    first = np.cumsum(pixels) - pixels
    ends = np.cumsum(length).astype(np.int64)
    start = ends - length.astype(np.int64)
    zero = start[first]
    bits = np.add.reduceat(length.astype(np.int64), first)
    # every tile gets whole 64-bit words of its own, pixels from the bit on at which the header leaves off
    lead = np.array([h[2] for h in _HEADS])[kind]
    room = (bits + lead + 63 >> 6) + 1
    word0 = np.cumsum(room) - room
    at = start - np.repeat(zero, pixels) + np.repeat(64 * word0 + lead, pixels)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    words = np.zeros(int(room.sum()) + 1, np.uint64)
    runs = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[runs]] = np.bitwise_or.reduceat(value << shift, runs)
    high = np.where(shift > 0, value >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    words[word[runs] + 1] |= np.bitwise_or.reduceat(high, runs)
    raw = words.tobytes()
    out: list[list[bytes]] = [[] for _ in payloads]
    for i, n, w, k, h in zip(owner, pixels.tolist(), word0.tolist(), (bits + lead + 7 >> 3).tolist(), kind.tolist(), strict=True):
        data, (head, edge, _) = raw[8 * w : 8 * w + k], _HEADS[h]
        vp8l = b"\x2f" + size_bits(WIDTH, n // WIDTH).to_bytes(4, "little") + head + bytes([data[0] | edge]) + data[1:]
        out[i].append(wrap(vp8l))
    return [b"".join(x) for x in out]


def files_of(medium: bytes) -> list[bytes]:
    """The WebP files of a medium."""
    out, at = [], 0
    while at < len(medium):
        n = 8 + struct.unpack("<I", medium[at + 4 : at + 8])[0]
        out.append(medium[at : at + n])
        at += n
    return out
