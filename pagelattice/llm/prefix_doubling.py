"""Substring dedup by distributed prefix doubling.

Positions of all texts are ranked by the 26 bytes that start there; then pairs of ranks, of a position and of the one a run further, are sorted
and ranked anew, so that a rank stands for a run twice as long each round. A position whose rank no other document shares is unique and leaves;
the rounds end when runs are well past the threshold of 50 bytes. Spark deals the pairs by ranges of a mixing of both ranks (so that no rank,
however common, lands in one task), and a range sorts them and numbers what is shared.

Not every byte is a position: of the 25 places at which a 26-byte string may start within 50 bytes, the one with the least hash is
taken (the first of equals). Equal strings of 50 bytes take the same place, so each repeat has its positions on both sides, at some 8 in 100
bytes. Neighbouring positions of one text are at most 25 apart unless their 50 bytes are unique, so runs have no holes.

A run of 50 bytes or more whose smallest doc_id is below a document's settles the strings within: they go. A run whose smallest doc_id is
the document's own, and that stands wherever its positions stand, settles them too: they stay, and nobody asks for them. What is left are strings near the ends of
repeats, less those whose own position isn't shared. Their stretches of text are cut out, and the strings are compared as they are, each distinct one
once a slice, by 88 bits of hash; the least doc_id of each comes back.

Slices send each rank pair (or string) once, with its least doc_id and its first place, and keep the other places to themselves. No pairs of
documents are formed. Texts go through a shuffle twice, by key: those with open strings, and all when spans meet texts.

Defined results: null and empty texts have no bytes; texts below 50 bytes lose nothing; a null doc_id is neither smaller nor larger than
any other, so such rows lose nothing and take nothing from others; rows with one doc_id take nothing from each other; equal rows have equal
results; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import hashing as hs

LENGTH = 50
#: Bytes of a first rank: the least number whose neighbours leave no hole, as positions are at most LENGTH - GRAM + 1 apart.
GRAM = LENGTH // 2 + 1
CHOICES = LENGTH - GRAM + 1
#: Doublings: runs of up to 2 ** ROUNDS positions.
ROUNDS = 3
#: Bytes of text of a slice, of a step of hashing, and of input for each range of keys.
SLICE, STEP, RANGE_BYTES = 8 << 20, 1 << 17, 8 << 20
#: Bits of the hash of a first rank and of a string (which has 32 more), and of the offset within a pair of ranks.
GRAM_BITS, STRING_BITS, OFFSET_BITS = 48, 56, 7

_ROW = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int8()), ("data", pa.list_(pa.binary()))])
_ROW_SQL = "part bigint, chunk bigint, kind tinyint, data array<binary>"
_REPLY = pa.schema([("chunk", pa.int64()), ("kind", pa.int8()), ("data", pa.list_(pa.binary()))])
_REPLY_SQL = "chunk bigint, kind tinyint, data array<binary>"
_STATE = pa.schema([("chunk", pa.int64()), ("data", pa.list_(pa.binary()))])
_STATE_SQL = "chunk bigint, data array<binary>"
_DOC = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("open", pa.binary()), ("shared", pa.binary()), ("gone", pa.binary())])
_DOC_SQL = "k1 bigint, k2 bigint, open binary, shared binary, gone binary"
_STRETCH = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("open", pa.binary()), ("stretch", pa.binary())])
_STRETCH_SQL = "k1 bigint, k2 bigint, open binary, stretch binary"
LIST, STATE = 0, 1
#: A random 64-bit number for each byte, so that sums over bytes spread well.
_BYTES = hs.mixed(np.arange(1, 257, dtype=np.uint64) << np.uint64(32))


# ---- intervals: arrays of starts and ends, ends excluded


def cover(plus: tuple[np.ndarray, np.ndarray], minus: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint rising intervals of what intervals of plus cover and those of minus don't; touching ones join."""
    both = [plus, minus] if minus is not None else [plus]
    points = np.unique(np.concatenate([x for pair in both for x in pair]))
    held = []
    for a, b in both:
        n = np.bincount(np.searchsorted(points, a), minlength=len(points) + 1) - np.bincount(np.searchsorted(points, b), minlength=len(points) + 1)
        held.append(np.cumsum(n[: len(points)]) > 0)
    on = held[0] & ~held[1] if minus is not None else held[0]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return points[edge[::2]], points[edge[1::2]]


def _pack(*pair: np.ndarray) -> bytes:
    return np.concatenate([np.asarray(x, np.uint32) for x in pair]).tobytes()


def _unpack(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data or b"", np.uint32).astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _joined(a: bytes, b: tuple[np.ndarray, np.ndarray]) -> bytes:
    x, y = _unpack(a)
    return _pack(*cover((np.concatenate((x, b[0])), np.concatenate((y, b[1])))))


# ---- positions


def _chosen(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By steps: where a step begins, hashes of its 26-byte strings, and for each 50-byte string of it the place, in the step, of the one taken."""
    low = np.uint64((1 << 20) - 1)
    for start in range(0, max(len(data) - LENGTH + 1, 0), STEP):
        h = hs.windows(_BYTES[data[start : start + STEP + LENGTH - 1]], GRAM)
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the least one, the first of equals
        size = 1
        while 2 * size <= CHOICES:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        if size < CHOICES:
            v = np.minimum(v[: len(v) - (CHOICES - size)], v[CHOICES - size :])
        yield start, h, (v & low).astype(np.int64)


def positions(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the chosen 26-byte strings of texts that stand end to end in data (from at[i] to at[i + 1])."""
    ends = at[1:]
    bad = np.zeros(len(data) + 1, np.int8)  # where no string of LENGTH bytes starts
    np.add.at(bad, np.maximum(at[:-1], ends - LENGTH + 1), 1)
    np.add.at(bad, ends, -1)
    good = np.cumsum(bad, dtype=np.int8) == 0
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start, h, chosen in _chosen(data):
        chosen = chosen[good[start : start + len(chosen)]]
        if len(chosen):
            chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
            hashes.append(h[chosen])
            places.append(chosen + start)
    place, i = np.unique(np.concatenate(places), return_index=True)  # steps overlap
    return place, np.concatenate(hashes)[i]


def owners(data: np.ndarray) -> np.ndarray:
    """The place of the chosen 26-byte string of each 50-byte string of data."""
    return np.concatenate([np.zeros(0, np.int64), *(chosen + start for start, _, chosen in _chosen(data))])


def _slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices in which texts stand by rising doc_id, so that an earlier place is never one of a larger doc_id; numbered by partition and order."""
    task = TaskContext.get().partitionId()
    for n, batch in enumerate(common.slices(batches, column, SLICE, 60_000)):
        yield task << 32 | n, batch.sort_by("k1")


def _table(batch: pa.RecordBatch, at: np.ndarray) -> list[bytes]:
    return [*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("k1", "k2")), at.astype(np.uint32).tobytes()]


def _state_row(chunk: int, data: list[bytes]) -> tuple:
    return (-1 - chunk % 4093, chunk, STATE, data)


# ---- lists: what a slice sends to the ranges of keys


def _lists(chunk: int, part: np.ndarray, key: np.ndarray, more: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Rows of the distinct (part, key, more) of a slice, with number, least doc and first place; and each entry's first place. Places must rise."""
    order = np.lexsort((more, key, part))
    part, key, more, doc, sorted_place = part[order], key[order], more[order], doc[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    lead = np.empty(len(key), np.int64)
    lead[order] = np.repeat(sorted_place[first], count)
    several = doc[first] != doc[first + count - 1] if len(first) else np.zeros(0, bool)
    part, key, more, doc, sorted_place = part[first], key[first], more[first], doc[first], sorted_place[first]
    rows = []
    for p, s in hs.cut_by_bucket(part):
        rows.append((p, chunk, LIST, [hs.pack_sorted(key[s].astype(np.uint64)), hs.pack_ints(more[s]), hs.pack_ints(count[s]), hs.pack_ints(doc[s]), np.packbits(several[s]).tobytes(), hs.pack_ints(sorted_place[s])]))
    return rows, lead


def _range(h: np.ndarray, parts: int) -> np.ndarray:
    """The range of 64-bit hashes that each is in."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _others(place: np.ndarray, lead: np.ndarray) -> bytes:
    """Places that aren't the first of their key in the slice, and that first place of each."""
    other = lead != place
    return _pack(place[other], lead[other])


def _leads(place: np.ndarray, others: bytes) -> np.ndarray:
    other, lead = _unpack(others)
    out = place.copy()
    out[np.searchsorted(place, other)] = lead
    return out


def _judged(parts: int) -> Callable:
    """For a range of keys: sorts the lists of all slices and ranks what two documents share. Replies: first places, ranks, numbers, least docs."""
    return lambda key, table: _judge(key[0].as_py(), parts, table)


def _judge(part: int, parts: int, table: pa.Table) -> pa.Table:
    kinds, chunks, data = (table[c].to_pylist() for c in ("kind", "chunk", "data"))
    rows = [(c, STATE, d) for c, k, d in zip(chunks, kinds, data, strict=True) if k == STATE]
    lists = [(c, d) for c, k, d in zip(chunks, kinds, data, strict=True) if k == LIST]
    if lists:
        keys = [hs.unpack_sorted(d[0]) for _, d in lists]
        sizes = np.array([len(k) for k in keys])
        value = np.concatenate(keys)
        more, count, doc, place = (np.concatenate([hs.unpack_ints(d[i]) for _, d in lists]) for i in (1, 2, 3, 5))
        several = np.concatenate([np.unpackbits(np.frombuffer(d[4], np.uint8), count=n) for (_, d), n in zip(lists, sizes.tolist(), strict=True)])
        order = np.lexsort((more, value))
        v, m, sorted_doc = value[order], more[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (m[1:] != m[:-1]))))
        least = np.minimum.reduceat(sorted_doc, first)
        shared = (np.maximum.reduceat(sorted_doc, first) != least) | (np.maximum.reduceat(several[order], first) > 0)
        rank = (np.cumsum(shared) - 1) * parts + part  # ranks of all ranges are dense together, so that they pack well
        spread = np.empty(len(v), np.int64)
        spread[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))
        total = np.add.reduceat(count[order], first)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        for (chunk, _), a, b in zip(lists, begin.tolist(), begin[1:].tolist(), strict=False):
            hit = np.flatnonzero(shared[spread[a:b]]) + a
            if len(hit):
                g = spread[hit]
                rows.append((chunk, LIST, [hs.pack_ints(x) for x in (place[hit], rank[g], total[g], least[g])]))
    return pa.Table.from_batches([hs.batch_of(rows, _REPLY)])


def _gathered(table: pa.Table) -> tuple[list[bytes], tuple[np.ndarray, ...]]:
    """Of the rows of a slice: its state, and the replies (first places rising, ranks, numbers, least docs)."""
    kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
    state = data[kinds.index(STATE)]
    replies = [d for d, k in zip(data, kinds, strict=True) if k == LIST]
    cols = [np.concatenate([hs.unpack_ints(d[i]) for d in replies] or [np.zeros(0, np.int64)]) for i in range(4)]
    order = np.argsort(cols[0], kind="stable")
    return state, tuple(c[order] for c in cols)


def _found(places: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted place among the rising places, and whether it is there."""
    if not len(places):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
    return i, places[i] == wanted


# ---- the rounds


def _sorted(x: np.ndarray) -> bytes:
    return hs.pack_sorted(x.astype(np.uint64))


def _places(data: bytes) -> np.ndarray:
    return hs.unpack_sorted(data).astype(np.int64)


def _doc(state: list[bytes], place: np.ndarray) -> np.ndarray:
    """The doc_id at each place of a slice."""
    ids, at = np.frombuffer(state[0], np.int64), np.frombuffer(state[2], np.uint32)
    return ids[np.searchsorted(at[1:], place, side="right")]


def _first(parts: int) -> Callable:
    """Round 0, by slice: the positions, by hashes of their 26 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in _slices(batches):
            data, at = hs.flat(batch.column("text"))
            place, h = positions(data, at)
            if len(place):
                table = _table(batch, at)
                h = hs.mixed(h)  # the least of 25 hashes would all meet in the first ranges
                rows, lead = _lists(chunk, _range(h, parts), h >> np.uint64(64 - GRAM_BITS), np.zeros(len(h), np.int64), _doc(table, place), place)
                yield hs.batch_of([*rows, _state_row(chunk, [*table, _others(place, lead)])], _ROW)

    return run


# State of a slice between rounds: table of texts (3), then places, ranks, offsets of the following run (0: none), lengths and largest numbers of
# runs; all places that were shared; starts of strings that go, and of those that stay


def _ranked_first(key: tuple, table: pa.Table) -> pa.Table:
    """State of a slice after round 0."""
    state, (place, rank, n, _) = _gathered(table)
    if not len(place):
        return _STATE.empty_table()
    other, lead = _unpack(state[3])
    i, ok = _found(place, lead)
    place, rank, n = np.concatenate((place, other[ok])), np.concatenate((rank, rank[i[ok]])), np.concatenate((n, n[i[ok]]))
    order = np.argsort(place)
    place, rank, n = place[order], rank[order], n[order]
    text = np.searchsorted(np.frombuffer(state[2], np.uint32)[1:], place, side="right")
    offset = np.zeros(len(place), np.int64)
    near = (np.diff(place) <= GRAM) & (np.diff(text) == 0)
    offset[:-1][near] = np.diff(place)[near]
    data = [*state[:3], _sorted(place), *(hs.pack_ints(x) for x in (rank, offset, np.full(len(place), GRAM), n)), _sorted(place), b"", b""]
    return pa.Table.from_batches([hs.batch_of([(key[0].as_py(), data)], _STATE)])


def _doubled(parts: int) -> Callable:
    """A further round, by slice: pairs of the ranks of a run and of the run that follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, state in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                place = _places(state[3])
                rank, offset, length, top = map(hs.unpack_ints, state[4:8])
                j, ok = _found(place, place + offset)
                i = np.flatnonzero(ok & (offset > 0))
                j, offset_j, offset = j[i], offset[j[i]], offset[i]
                more = rank[j] << OFFSET_BITS | offset
                part = _range(hs.mixed(rank[i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * more.astype(np.uint64)), parts)
                rows, lead = _lists(chunk, part, rank[i], more, _doc(state, place[i]), place[i])
                runs = [_sorted(place[i]), _others(place[i], lead), *(hs.pack_ints(x) for x in (np.where(offset_j > 0, offset + offset_j, 0), offset + length[j], np.maximum(top[i], top[j])))]
                yield hs.batch_of([*rows, _state_row(chunk, [*state[:3], *runs, *state[8:]])], _ROW)

    return run


def _ranked(key: tuple, table: pa.Table) -> pa.Table:
    """State of a slice after a further round: the runs that another document shares, and the strings that they settle."""
    state, (found, rank, n, least) = _gathered(table)
    place = _places(state[3])
    offset, length, top = map(hs.unpack_ints, state[5:8])
    j, ok = _found(found, _leads(place, state[4]))
    place, offset, length, top, j = place[ok], offset[ok], length[ok], top[ok], j[ok]
    rank, n, least, doc = rank[j], n[j], least[j], _doc(state, place)
    end = place + length - LENGTH + 1
    go, stay = (end > place) & (least < doc), (end > place) & (least == doc) & (n == top)
    settled = [_joined(state[9], (place[go], end[go])), _joined(state[10], (place[stay], end[stay]))]
    data = [*state[:3], _sorted(place), *(hs.pack_ints(x) for x in (rank, offset, length, top)), state[8], *settled]
    return pa.Table.from_batches([hs.batch_of([(key[0].as_py(), data)], _STATE)])


def _by_doc(at: np.ndarray, intervals: tuple[np.ndarray, np.ndarray]) -> dict[int, bytes]:
    """Intervals of a slice by text, counted from its start; none crosses a border."""
    doc = np.searchsorted(at[1:], intervals[0], side="right")
    return {d: _pack(intervals[0][s] - int(at[d]), intervals[1][s] - int(at[d])) for d, s in hs.cut_by_bucket(doc)}


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """After the rounds, by text: starts of strings that are still open, with shared places (null: none), and starts of those that go."""
    for batch in batches:
        for data in batch.column("data").to_pylist():
            k1, k2, at = (np.frombuffer(d, t) for d, t in zip(data[:3], (np.int64, np.int64, np.uint32), strict=True))
            at = at.astype(np.int64)
            place = _places(data[8])
            doc = np.searchsorted(at[1:], place, side="right")
            zone = np.maximum(place - CHOICES + 1, at[doc]), np.minimum(place, at[doc + 1] - LENGTH) + 1
            go, stay = _unpack(data[9]), _unpack(data[10])
            settled = np.concatenate((go[0], stay[0])), np.concatenate((go[1], stay[1]))
            is_open, gone = _by_doc(at, cover(zone, settled)), _by_doc(at, go)
            shared = {d: _sorted(place[s] - int(at[d])) for d, s in hs.cut_by_bucket(doc) if d in is_open}
            yield hs.batch_of([(int(k1[d]), int(k2[d]), is_open.get(d), shared.get(d), gone.get(d)) for d in sorted({*is_open, *gone})], _DOC)


def _stretched(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings starting in intervals: indexes of the bytes that each interval's span, end to end; where each string begins among them, and its interval."""
    size = end - start + LENGTH - 1
    begin = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - begin, size), hs.starts(size, LENGTH), np.repeat(np.arange(len(size)), end - start)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open strings whose own position is shared, with the bytes that they span."""
    for batch in common.slices(batches, "text", SLICE, 60_000):
        data, at = hs.flat(batch.column("text"))
        found = [_unpack(x) for x in batch.column("open").to_pylist()]
        start = np.concatenate([a + at[i] for i, (a, _) in enumerate(found)])
        end = np.concatenate([b + at[i] for i, (_, b) in enumerate(found)])
        shared = np.concatenate([_places(x) + at[i] for i, x in enumerate(batch.column("shared").to_pylist())])
        index, own, _ = _stretched(start, end)
        taken = index[owners(data[index])[own]]
        place = index[own][_found(shared, taken)[1]]
        a, b = cover((place, place + 1))
        rows = []
        k1, k2 = (batch.column(c).to_pylist() for c in ("k1", "k2"))
        for d, s in hs.cut_by_bucket(np.searchsorted(at[1:], a, side="right")):
            rows.append((k1[d], k2[d], _pack(a[s] - at[d], b[s] - at[d]), data[_stretched(a[s], b[s])[0]].tobytes()))
        yield hs.batch_of(rows, _STRETCH)


def _strings(parts: int) -> Callable:
    """Last round, by slice: the open strings themselves, by two hashes. Places are counted through the stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in _slices(batches, "stretch"):
            data, at = hs.flat(batch.column("stretch"))
            found = [_unpack(x) for x in batch.column("open").to_pylist()]
            start, end = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            size = end - start + LENGTH - 1
            place = hs.starts(size, LENGTH)
            piece = _BYTES[data]
            key, more = (hs.windows(piece, LENGTH, k)[place] for k in (0, 1))
            table = _table(batch, at)
            rows, lead = _lists(chunk, _range(key, parts), key >> np.uint64(64 - STRING_BITS), (more >> np.uint64(32)).astype(np.int64), _doc(table, place), place)
            yield hs.batch_of([*rows, _state_row(chunk, [*table, _others(place, lead), _pack(np.cumsum(size) - size, start)])], _ROW)

    return run


def _gone(key: tuple, table: pa.Table) -> pa.Table:
    """After the last round, by text: starts of strings that go."""
    state, (place, _, _, least) = _gathered(table)
    other, lead = _unpack(state[3])
    i, ok = _found(place, lead)
    place, least = np.concatenate((place, other[ok])), np.concatenate((least, least[i[ok]]))
    k1, k2, at = (np.frombuffer(d, t) for d, t in zip(state[:3], (np.int64, np.int64, np.uint32), strict=True))
    go = np.sort(place[least < _doc(state, place)])
    begin, start = _unpack(state[4])
    own = np.searchsorted(begin, go, side="right") - 1
    # texts far apart, so that no intervals of two of them touch
    base = np.searchsorted(at[1:], go, side="right").astype(np.int64) << 32
    a, b = cover((x := base + go - begin[own] + start[own], x + 1)) if len(go) else (go, go)
    rows = [(int(k1[d]), int(k2[d]), None, None, _pack(a[s] - (d << 32), b[s] - (d << 32))) for d, s in hs.cut_by_bucket(a >> 32)]
    return pa.Table.from_batches([hs.batch_of(rows, _DOC)])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key: rows with one key are equal rows (or have equal results)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))


def _round(rows: DataFrame, parts: int, judge: Callable, sql: str, name: str) -> DataFrame:
    """rows by range of keys, then by slice, as a written table."""
    out = common.staged(rows.groupBy("part").applyInArrow(_judged(parts), _REPLY_SQL).groupBy("chunk").applyInArrow(judge, sql), name)
    common.release(rows.sparkSession)
    return out


def _once(rows: DataFrame) -> DataFrame:
    """One row a key: equal rows have equal intervals."""
    return rows.groupBy("k1", "k2").agg(*(F.max(c).alias(c) for c in ("open", "shared", "gone")))


def repeats(docs: DataFrame) -> DataFrame:
    """k1, k2, gone, more: for each text that loses bytes, starts of 50-byte strings that go, settled by ranks and by comparison."""
    spark = docs.sparkSession
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), common.input_bytes(docs) // RANGE_BYTES)
    texts = keyed(docs).where("k1 is not null")
    state = _round(texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_first(parts), _ROW_SQL), parts, _ranked_first, _STATE_SQL, "ranks-0")
    for k in range(1, ROUNDS + 1):
        before = state
        state = _round(state.mapInArrow(_doubled(parts), _ROW_SQL), parts, _ranked, _STATE_SQL, f"ranks-{k}")
        common.drop(before)
    left = common.staged(_once(state.mapInArrow(_left, _DOC_SQL)), "open-strings")
    common.drop(state)
    near = texts.join(left.where("open is not null").select("k1", "k2", "open", "shared"), ["k1", "k2"])
    stretches = common.staged(near.select("k1", "k2", "text", "open", "shared").mapInArrow(_stretches, _STRETCH_SQL), "open-stretches")
    common.release(spark)
    strings = _round(stretches.mapInArrow(_strings(parts), _ROW_SQL), parts, _gone, _DOC_SQL, "strings")
    common.drop(stretches)
    settled = left.where("gone is not null").select("k1", "k2", "gone")
    compared = _once(strings).select("k1", "k2", F.col("gone").alias("more"))
    out = common.staged(settled.join(compared, ["k1", "k2"], "full"), "repeats")
    common.drop(left)
    common.drop(strings)
    return out


def spans(gone: bytes | None, more: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint byte spans that strings starting in the given intervals cover."""
    (a, b), (c, d) = _unpack(gone), _unpack(more)
    return cover((np.concatenate((a, c)), np.concatenate((b, d)) + LENGTH - 1))


def _spanned(docs: DataFrame) -> DataFrame:
    return keyed(docs).join(repeats(docs), ["k1", "k2"], "left").select("k1", "text", "gone", "more")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, bytes]]:
    """doc_id, bytes, span starts and ends, and remaining bytes of each row."""
    for batch in common.slices(batches, "text"):
        for i, t, gone, more in zip(*(batch.column(c).to_pylist() for c in ("k1", "text", "gone", "more")), strict=True):
            data = t.encode()
            if gone is None and more is None:
                yield i, data, *_unpack(None), data
                continue
            a, b = spans(gone, more)
            edges = [0, *np.column_stack((a, b)).ravel().tolist(), len(data)]
            yield i, data, a, b, b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The operator's output: doc_id, kept (the remaining bytes; a cut may stand within a character) and spans (start, bytes) removed."""
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("bytes", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for i, _, a, b, kept in _cut(batches):
            rows.append((i, kept, [{"start": x, "bytes": y} for x, y in zip(a.tolist(), (b - a).tolist(), strict=True)]))
            held += len(kept) + 100
            if held > SLICE:
                yield hs.batch_of(rows, schema)
                rows, held = [], 0
        yield hs.batch_of(rows, schema)

    return _spanned(docs).mapInArrow(run, "doc_id bigint, kept binary, spans array<struct<start:int,bytes:int>>")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for i, data, a, _, kept in _cut(batches):
            rows.append((i, len(data), len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest()))
            if len(rows) == 20_000:
                yield hs.batch_of(rows, schema)
                rows = []
        yield hs.batch_of(rows, schema)

    return _spanned(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op11_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))


# windows are cut from pieces of 256 bytes, as hex, so that no string is searched from its start for each
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
piece AS (SELECT rid, doc_id, i * 256 AS base, len(x) // 2 AS n, substr(x, i * 512 + 1, 610) AS y FROM (SELECT *, unnest(range(0, (len(x) // 2 - 50) // 256 + 1)) AS i FROM d WHERE len(x) >= 100)),
win AS (SELECT rid, doc_id, base + k AS p, substr(y, 2 * k + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(256, n - 49 - base))) AS k FROM piece)),
low AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT rid, p, max(p + 50) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT rid, p FROM win JOIN low USING (s) WHERE doc_id > least)),
run AS (SELECT rid, p, sum(CASE WHEN reach IS NULL OR p > reach THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY p) AS r FROM gone),
span AS (SELECT rid, r, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY ALL),
cut AS (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS before FROM span),
kept AS (SELECT rid, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans FROM cut JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
