"""Hashes of words and word windows, and sorted hash lists packed for a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd constants of the polynomial and of the finisher (fixed values: 2**64 over the golden ratio, and splitmix64's).
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_SOLID = np.array([b not in b"\x20\t\n\x0b\x0c\r" for b in range(256)])
_LOWERED = np.frombuffer(LOWER, np.uint8)


def flat(texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty), end to end, and where each begins (one more at the end)."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.string())
    if texts.type not in (pa.string(), pa.binary()):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "" if texts.type == pa.string() else b"")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def tiles(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values that stand end to end in data, from at[i] to at[i + 1]; nothing is copied."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def words(texts: pa.Array | list, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, and all words as binary values: runs of other bytes than the six white-space bytes."""
    data, at = flat(texts)
    solid = _SOLID[data]
    border = np.zeros(len(data) + 1, bool)
    border[at] = True
    after = np.concatenate((solid, [False]))  # is there a word's byte here, and was there one of the same text before?
    before = np.concatenate(([False], solid)) & ~border
    begin = np.flatnonzero(after & ~before)
    ends = np.flatnonzero(np.concatenate(([False], solid)) & (~after | border))
    sizes = np.diff(np.searchsorted(begin, at))
    kept = data[solid]
    return sizes, tiles(_LOWERED[kept] if lower else kept, np.concatenate(([0], np.cumsum(ends - begin))))


def value_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte strings that stand end to end in data, eight bytes of all of them at a time."""
    sizes = np.diff(at)
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    h = mixed(sizes.astype(np.uint64) + np.uint64(_BASES[0]))
    who, begin, left = slice(None), at[:-1], sizes
    while len(begin):
        kept = np.uint64(8) * np.clip(left, 0, 8).astype(np.uint64)
        value = np.where(kept < np.uint64(64), eights[begin] & ((np.uint64(1) << (kept & np.uint64(63))) - np.uint64(1)), eights[begin])
        h[who] = mixed((h[who] ^ value) + np.uint64(_BASES[1]))
        more = np.flatnonzero(left > 8)
        who = more if isinstance(who, slice) else who[more]
        begin, left = begin[more] + 8, left[more] - 8
    return h


def word_hashes(texts: pa.Array | list, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, end to end, and the number of words of each text."""
    sizes, found = words(texts, lower)
    _, at, data = found.buffers()
    return value_hashes(np.frombuffer(data, np.uint8), np.frombuffer(at, np.int32).astype(np.int64)), sizes


def windows(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every n consecutive words, by doubling; `which` picks one of two independent polynomials."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    if which:
        h = mixed(h + np.uint64(_BASES[1]))
    base = _BASES[which]
    acc, have, cur, size = None, 0, h, 1
    while True:
        if n & size:
            acc = cur if acc is None else acc[: len(cur) - have] + np.uint64(pow(base, have, 1 << 64)) * cur[have:]
            have += size
        if have == n:
            return mixed(acc[: len(h) - n + 1])
        cur = cur[:-size] + np.uint64(pow(base, size, 1 << 64)) * cur[size:]
        size *= 2


def starts(sizes: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    """Flat positions at which a window of n words begins, of texts with `least` words or more."""
    begin = np.cumsum(sizes) - sizes
    count = np.where(sizes >= (least or n), np.maximum(sizes - n + 1, 0), 0)
    total = int(count.sum())
    first = np.cumsum(count) - count
    return np.arange(total) - np.repeat(first, count) + np.repeat(begin, count)


def pack_sorted(x: np.ndarray) -> bytes:
    """A rising list of 64-bit numbers: the first, then the differences, in as many bytes each as the largest needs (lowest bytes first)."""
    if not len(x):
        return b""
    gaps = np.diff(x)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 0
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + x[:1].tobytes() + planes.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    n = (len(data) - 9) // width if width else 0
    wide = np.zeros((n, 8), np.uint8)
    if n:
        wide[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(width, n).T
    out = np.empty(n + 1, np.uint64)
    out[0] = np.frombuffer(data[1:9], np.uint64)[0]
    out[1:] = wide.view("<u8").ravel()
    return np.cumsum(out, dtype=np.uint64)


def cut_by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of a rising array."""
    if len(bucket):
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        edges = [0, *cuts.tolist(), len(bucket)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield int(bucket[a]), slice(a, b)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def pack_ints(x: np.ndarray) -> bytes:
    """64-bit numbers in any order: the least, then the differences to it, in as many bytes each as the largest needs (lowest bytes first)."""
    if not len(x):
        return b""
    x = np.asarray(x).astype(np.int64, copy=False)
    low = x.min()
    more = x.view(np.uint64) - low.view(np.uint64)
    width = (int(more.max()).bit_length() + 7) // 8
    planes = more.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + low.tobytes() + np.int64(len(x)).tobytes() + planes.tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    width, low, n = data[0], np.frombuffer(data[1:9], np.uint64)[0], int(np.frombuffer(data[9:17], np.int64)[0])
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, offset=17).reshape(width, n).T
    return (wide.view("<u8").ravel() + low).view(np.int64)
