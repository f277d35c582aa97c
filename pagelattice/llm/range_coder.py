"""Token ids in a file format of their own: blocks under an adaptive context-mixing range coder.

A block holds BLOCK ids and starts from nothing: it can be read alone, and carries a CRC32 of its ids. Each id is coded as one of
three outcomes (it is what the order-2 context predicts, what the order-1 context predicts, or neither); the probabilities
are the mean of two adaptive tables, one by how sure both contexts are and whether they agree, one by the outcomes before. Otherwise the id is coded by the order-0 model: frequencies of the block's ids so far, taken
anew whenever the block has doubled; an id that it has not seen is escaped and coded flat.

All blocks of a segment are coded in lockstep: one NumPy step takes an id of each. All arithmetic is on integers, so that
every machine decodes alike. Ids must be under 65535.
"""

from __future__ import annotations

import struct
import zlib
import numpy as np

BLOCK = 4096
#: The order-0 model is taken anew after so many ids of a block, and has so many slots.
FRESH = (64, 128, 256, 512, 1024, 2048)
SLOTS = 4096
ESCAPE = 65535
MAGIC = b"PLRC\x01"
_SIDE, _TABLE = 1 << 12, 12  # entries of the context tables of a block
_U = np.uint64
_LOW, _B16, _B32, _B48 = _U((1 << 32) - 1), _U(16), _U(32), _U(48)
_FLOOR = _U(1 << 32)


class BadFile(ValueError):
    """The bytes are no file of this format, or a checksum is wrong."""


class _Order0:
    """Frequencies of the ids that stand in the first columns of `ids`, [blocks, t]: slots of each block, escape last."""

    def __init__(self, ids: np.ndarray):
        lanes, t = ids.shape
        keys = np.sort((np.arange(lanes)[:, None] << 16 | ids.astype(np.int64)).ravel())
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.keys = keys[first]
        count = np.diff(np.append(first, len(keys)))
        lane = self.keys >> 16
        distinct = np.bincount(lane, minlength=lanes)
        escape = 32 + SLOTS // 16
        self.freq = 1 + count * (SLOTS - escape - distinct[lane]) // t
        begin = np.cumsum(distinct) - distinct
        total = np.cumsum(self.freq)
        self.cum = total - self.freq - np.repeat((total - self.freq)[begin], distinct)
        self.used = np.add.reduceat(self.freq, begin)  # the rest of a block's slots is the escape's
        # slot -> entry of the block's list; len(keys) stands for the escape
        sizes = np.empty(len(self.keys) + lanes, np.int64)
        where = np.arange(len(self.keys)) + lane
        last = np.cumsum(distinct) + np.arange(lanes)
        sizes[where], sizes[last] = self.freq, SLOTS - self.used
        names = np.empty(len(sizes), np.int32)
        names[where], names[last] = np.arange(len(self.keys)), len(self.keys)
        self.entry = np.repeat(names, sizes)

    def find(self, lane: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cum, freq, and whether the id is escaped."""
        key = lane << 16 | ids
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out = self.keys[at] != key
        used = self.used[lane]
        return np.where(out, used, self.cum[at]), np.where(out, SLOTS - used, self.freq[at]), out

    def at_slot(self, lane: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """id, cum, freq and whether it is the escape."""
        e = self.entry[lane * SLOTS + slot]
        out = e == len(self.keys)
        e = np.where(out, 0, e)
        used = self.used[lane]
        return self.keys[e] & 0xFFFF, np.where(out, used, self.cum[e]), np.where(out, SLOTS - used, self.freq[e]), out


#: By outcome: what two packed 16-bit probabilities (order 2 above order 1, the latter given that order 2 was wrong) lose and gain.
_LOSE = np.array([0x0FFF0000, 0x0FFF0FFF, 0x0FFF0FFF], np.int64)
_GAIN = np.array([0x0FFF0000, 0x00000FFF, 0], np.int64)
_HALVES = 0x7FFF7FFF


class _Model:
    """Order-1 and order-2 predictions of each block, and the mixed probabilities of the three outcomes."""

    def __init__(self, lanes: int):
        self.row = np.arange(lanes) << _TABLE
        # an entry: the id seen last in this context << 2 | how often it was right in a row (0..3); ESCAPE: none
        self.one = np.full(lanes << _TABLE, ESCAPE << 2, np.int64)
        self.two = np.full(lanes << _TABLE, ESCAPE << 2, np.int64)
        self.a = np.full(lanes * 32, 12000 << 16 | 9000, np.int64)
        self.b = self.a.copy()
        self.base = np.arange(lanes) << 5
        self.before = np.zeros(lanes, np.int64)
        self.first = np.zeros(lanes, np.int64)  # the id before, and the hash term of the one before that
        self.second = np.zeros(lanes, np.int64)
        self.edges = np.zeros((lanes, 4), np.int64)
        self.edges[:, 3] = 65536
        self.flat, self.four = self.edges.reshape(-1), 4 * np.arange(lanes)

    def predict(self) -> None:
        """Sets both predictions (g1, g2) and the edges of the three outcomes within 65536."""
        self.i1 = (self.first * 40503 >> 4 & _SIDE - 1) + self.row
        self.i2 = (self.first * 31153 + self.second >> 3 & _SIDE - 1) + self.row
        e1, e2 = self.one[self.i1], self.two[self.i2]
        self.e1, self.e2, self.c1, self.c2 = e1, e2, e1 & 3, e2 & 3
        self.g1, self.g2 = e1 >> 2, e2 >> 2
        self.ia = self.base + (self.c2 << 2) + self.c1 + ((self.g1 == self.g2).view(np.int8) << 4)
        self.ib = self.base + self.before
        self.qa, self.qb = self.a[self.ia], self.b[self.ib]
        q = (self.qa >> 1 & _HALVES) + (self.qb >> 1 & _HALVES)
        two = ((q >> 16) * 63 >> 6) + 32
        self.edges[:, 1] = two
        self.edges[:, 2] = two + 16 + ((65536 - two) * ((q & 0xFFFF) * 15 >> 4) >> 16)

    def spans(self, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """cum and freq of an outcome (of 65536) in each block."""
        at = self.four + outcome
        low = self.flat[at]
        return low.view(_U), (self.flat[at + 1] - low).view(_U)

    def update(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        """outcome: 0 for order 2, 1 for order 1, 2 for neither."""
        lose, gain = _LOSE[outcome], _GAIN[outcome]
        self.a[self.ia] = self.qa - (self.qa >> 4 & lose) + gain
        self.b[self.ib] = self.qb - (self.qb >> 4 & lose) + gain
        new = ids << 2
        # a right entry grows surer; a wrong one is replaced once it is not sure at all
        self.one[self.i1] = np.where(self.g1 == ids, self.e1 + (self.c1 < 3), np.where(self.c1 > 0, self.e1 - 1, new))
        self.two[self.i2] = np.where(self.g2 == ids, self.e2 + (self.c2 < 3), np.where(self.c2 > 0, self.e2 - 1, new))
        self.before = (self.before << 2 | outcome) & 31
        self.second = self.first * 52711
        self.first = ids


class _Coder:
    """Range coder states of all blocks: 64 bits, 16 of which are settled at a time; without carries."""

    def __init__(self, lanes: int):
        self.low, self.rng = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)

    def narrow(self, who, cum: np.ndarray, freq: np.ndarray, bits, settle) -> None:
        """Takes an interval in each of `who` (None: all blocks); settle(blocks, low) moves 16 bits where the range got thin."""
        if who is None:
            r = self.rng >> bits
            low = self.low + r * cum
            self.low = low
            self.rng = r = r * freq
            thin = np.flatnonzero(r < _FLOOR)
        else:
            r = self.rng[who] >> bits
            self.low[who] += r * cum
            r = r * freq
            self.rng[who] = r
            thin = who[r < _FLOOR]
        while len(thin):
            x, y = self.low[thin], self.rng[thin]
            y = np.where((x ^ (x + y)) >> _B48 != 0, (_U(0) - x) & _LOW, y)  # cut at a border that is about to be crossed
            settle(thin, x)
            y <<= _B16
            self.low[thin], self.rng[thin] = x << _B16, y
            thin = thin[y < _FLOOR]


def encode(ids: np.ndarray) -> list[bytes]:
    """The coded blocks of a list of ids; the last block is filled up with zeros where there are others."""
    if not len(ids):
        return []
    if int(ids.max()) >= ESCAPE or int(ids.min()) < 0:
        raise ValueError("ids must be from 0 to 65534")
    lanes = -(-len(ids) // BLOCK)
    steps = min(BLOCK, len(ids))
    grid = np.zeros((lanes, steps), np.int64)
    grid.ravel()[: len(ids)] = ids
    columns = np.ascontiguousarray(grid.T)
    wide = 3 * steps + 16
    flat = np.zeros(lanes * wide, np.uint16)
    cur = np.arange(lanes) * wide

    def settle(blocks, low):
        at = cur[blocks]
        flat[at] = low >> _B48
        cur[blocks] = at + 1

    coder, model, zero, begin = _Coder(lanes), _Model(lanes), None, 0
    every = np.arange(lanes)
    ones = np.ones(lanes, _U)
    fresh = [t for t in FRESH if t < steps]
    for t in range(steps):
        if t in FRESH:
            zero, begin = _Order0(grid[:, :t]), t
            stop = next((f for f in fresh if f > t), steps)
            # where the ids until the next time stand in this model, all at once
            c, f, out = zero.find(np.repeat(every, stop - t), grid[:, t:stop].ravel())
            zcum, zfreq, zout = (np.ascontiguousarray(x.reshape(lanes, -1).T) for x in (c.astype(_U), f.astype(_U), out))
        x = columns[t]
        model.predict()
        outcome = ((2 - (x == model.g1).view(np.int8)) * (1 - (x == model.g2).view(np.int8))).astype(np.int64)
        cum, freq = model.spans(outcome)
        coder.narrow(None, cum, freq, _B16, settle)
        rest = np.flatnonzero(outcome == 2)
        if zero is not None and len(rest):
            k = t - begin
            coder.narrow(rest, zcum[k][rest], zfreq[k][rest], _U(12), settle)
            rest = rest[zout[k][rest]]
        if len(rest):
            coder.narrow(rest, x[rest].view(_U), ones[: len(rest)], _B16, settle)
        model.update(x, outcome)
    for _ in range(4):
        settle(every, coder.low)
        coder.low <<= _B16
    return [flat[a:b].tobytes() for a, b in zip((every * wide).tolist(), cur.tolist(), strict=True)]


def decode(blocks: list[bytes], total: int) -> np.ndarray:
    """The ids of coded blocks, `total` altogether."""
    lanes = len(blocks)
    if not lanes:
        return np.zeros(0, np.int64)
    steps = min(BLOCK, total) if lanes == 1 else BLOCK
    columns = np.zeros((steps, lanes), np.int64)
    sizes = np.array([len(b) // 2 for b in blocks])
    flat = np.concatenate((np.frombuffer(b"".join(blocks), np.uint16), np.zeros(8, np.uint16))).astype(_U)
    cur = np.cumsum(sizes) - sizes
    ends, last = np.cumsum(sizes), len(flat) - 1
    code = np.zeros(lanes, _U)
    for _ in range(4):
        code = code << _B16 | flat[np.minimum(cur, last)]
        cur += 1

    def settle(who, _):
        at = cur[who]
        code[who] = code[who] << _B16 | flat[np.minimum(at, last)]
        cur[who] = at + 1

    coder, model, zero = _Coder(lanes), _Model(lanes), None
    ones = np.ones(lanes, _U)
    for t in range(steps):
        if t in FRESH:
            zero = _Order0(np.ascontiguousarray(columns[:t].T))
        model.predict()
        v = ((code - coder.low) // (coder.rng >> _B16)).view(np.int64)
        outcome = (v >= model.edges[:, 1]).astype(np.int64) + (v >= model.edges[:, 2])
        cum, freq = model.spans(outcome)
        coder.narrow(None, cum, freq, _B16, settle)
        x = np.where(outcome == 0, model.g2, model.g1)
        rest = np.flatnonzero(outcome == 2)
        if zero is not None and len(rest):
            v = ((code[rest] - coder.low[rest]) // (coder.rng[rest] >> _U(12))).view(np.int64)
            got, c, f, out = zero.at_slot(rest, np.minimum(v, SLOTS - 1))
            coder.narrow(rest, c.view(_U), f.view(_U), _U(12), settle)
            x[rest] = got
            rest = rest[out]
        if len(rest):
            v = np.minimum((code[rest] - coder.low[rest]) // (coder.rng[rest] >> _B16), _U(65535))
            coder.narrow(rest, v, ones[: len(rest)], _B16, settle)
            x[rest] = v.view(np.int64)
        columns[t] = x
        model.update(x, outcome)
    if (cur > ends + 4).any():
        raise BadFile("a block ends early")
    return columns.T.ravel()[:total] if lanes > 1 else columns[:, 0].copy()


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: magic, counts, documents, block sizes and checksums, CRC32 of all that, then the blocks."""
    blocks = encode(ids)
    sums = [zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)]
    head = MAGIC + struct.pack("<III", len(doc_ids), len(ids), len(blocks))
    head += np.array([i is None for i in doc_ids], np.uint8).tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.asarray(sizes, "<u4").tobytes()
    head += np.array([len(b) for b in blocks], "<u4").tobytes() + np.array(sums, "<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids of a segment; every checksum is tested."""
    if data[:5] != MAGIC or len(data) < 21:
        raise BadFile("no segment")
    docs, total, n = struct.unpack_from("<III", data, 5)
    at = [17, 17 + docs, 17 + 9 * docs, 17 + 13 * docs, 17 + 13 * docs + 4 * n, 17 + 13 * docs + 8 * n]
    if len(data) < at[5] + 4 or zlib.crc32(data[: at[5]]) != struct.unpack_from("<I", data, at[5])[0]:
        raise BadFile("the head's checksum is wrong")
    none = np.frombuffer(data, np.uint8, docs, at[0])
    doc_ids = [None if x else i for x, i in zip(none.tolist(), np.frombuffer(data, "<i8", docs, at[1]).tolist(), strict=True)]
    sizes = np.frombuffer(data, "<u4", docs, at[2]).astype(np.int64)
    lengths, sums = np.frombuffer(data, "<u4", n, at[3]).tolist(), np.frombuffer(data, "<u4", n, at[4]).tolist()
    blocks, p = [], at[5] + 4
    for k in lengths:
        blocks.append(data[p : p + k])
        p += k
    if p != len(data):
        raise BadFile("the segment has the wrong length")
    ids = decode(blocks, total)
    for i, want in enumerate(sums):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) != want:
            raise BadFile(f"block {i}: the checksum is wrong")
    return doc_ids, sizes, ids


def read_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block of a segment, without the others."""
    docs, total, n = struct.unpack_from("<III", data, 5)
    at = 17 + 13 * docs
    lengths = np.frombuffer(data, "<u4", n, at)
    begin = at + 8 * n + 4 + int(lengths[:block].sum())
    return decode([data[begin : begin + int(lengths[block])]], min(BLOCK, total - block * BLOCK))
