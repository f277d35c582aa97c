"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct word shingles (of Rule.width words; two sets link at a Jaccard of Rule.num hundredths). Shingles have one global order: by class of frequency (from a count sketch of
fixed size over the whole corpus), then by hash; rare ones first. Equal sets are one class from the start. Each class
puts the prefix that any link must meet into inverted lists.

Index level: a list is cut into blocks of one size and one component, each in order of position. Against an entry, a whole block is skipped
when its size or the entry's own position rules a link out, and of the others all entries behind the last position that allows
one. Answer level: a class that is linked to a class takes over its component, so blocks of its own component are
skipped too. A pair that shares an earlier element is known by the least hash of the elements before: it is left to that element's list,
so that near copies aren't met in each of the many lists that they share. And where two classes have known distances to one leader, the triangle inequality of the symmetric difference
decides most of the rest (|xy| >= ||xl|-|yl|| refutes, |xy| <= |xl|+|yl| confirms). A round of stars, and rounds of random partners
while the entry pairs of different components far outnumber the entries, merge components (both linear in the entries). Pairs are refuted by
parity bitmaps within the lists (of a length that follows from the differences that a link allows) or counted exactly over whole sets.

All remaining pairs are judged without being written: from each range of lists goes a forest that spans the pairs left open there, so
never more rows than it has classes. Its trees, over all ranges, are clusters; the sets of a cluster's classes are brought together
once, and its pairs are counted where they stand, but for those that links found there have put into one component. A cluster too
large for one task is cut into chunks, and each two chunks meet. So no link is lost. Tables between the steps are deleted once they are used up.

Classes are told apart by 64-bit hashes of their sets. Defined results: null, empty and blank texts have the empty set, 0
shingles, and are linked with nothing; texts with fewer words than a shingle are one shingle; rows with one doc_id are joined
through it as far as their sets are equal or linked; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import hashing as hs
from .anchor_repeats import keyed
from .components import components, extended

DEN = 100


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and hundredths of the union that the intersection of a link must have."""

    width: int = 3
    num: int = 90

    def prefix(self, n: int) -> int:
        """Leading elements of a set of n of which any linked set has one."""
        return n - (self.num * n + DEN - 1) // DEN + 1

    def overlap(self, total):
        """Least intersection of two linked sets of together `total` elements."""
        return -(-self.num * total // (DEN + self.num))

    def bits(self, n: int) -> int:
        """Length of the bitmap of a set of n: a power of two, 128 or 3.5 times the most that a linked set of its size differs by. The
        parities of unlike sets differ at about half of the places, which is more than a link allows."""
        return 1 << max(7, int(7 * (n - self.overlap(2 * n))).bit_length())


SKETCH_BITS, SKETCH_PARTS = 20, 64
#: Random partners of an entry in a round, rounds at most, and pairs for each entry at which no further round is worth it: then all
#: remaining pairs are judged.
PARTNERS, ROUNDS, OPEN_PAIRS = 4, 4, 20
RANGE_BYTES = 4 << 20
#: Text that a worker takes apart at a time; entries of one packed row of the lists (Parquet readers hold 4,096 rows at once); and pairs
#: that a worker looks at together.
SLICE, PACKED, TOGETHER = 4 << 20, 128, 1 << 19
#: Pairs between two looks at what has been joined; bytes of sets in a bucket of clusters, about, and in a chunk of a cluster.
LOOK, BUCKET_BYTES, CHUNK_BYTES = 1 << 16, 1 << 20, 16 << 20

_U = np.uint64


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def raw_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The rising shingle hashes of each text."""
    h, sizes = hs.word_hashes(texts, lower=True)
    w = hs.windows(h, width)
    begin = 0
    for n in sizes.tolist():
        if n >= width:
            yield _distinct(w[begin : begin + n - width + 1])
        else:
            yield hs.windows(h[begin : begin + n], n) if n else np.zeros(0, _U)
        begin += n


def ordered(x: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set in the global order: class of frequency in the top four bits, then 60 bits of hash."""
    return _distinct(classes[(x >> _U(64 - SKETCH_BITS)).astype(np.int64)] << _U(60) | x >> _U(4))


def frequency_classes(docs: DataFrame, width: int) -> np.ndarray:
    """The class (0: not frequent, up to 15) of each slot of the sketch: 2**SKETCH_BITS numbers whatever the corpus holds.

    It counts all shingles of all texts. A slot's count goes on as 16 bits from each task, which only coarsens the order; any order that all
    sets share gives the same links."""
    slots = 1 << SKETCH_BITS
    own = slots // SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in common.slices(batches, "text", SLICE):
            h, sizes = hs.word_hashes(batch.column("text"), lower=True)
            found = hs.windows(h, width)[hs.starts(sizes, width)] if len(h) >= width else h[:0]
            total += np.bincount((found >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=slots)
        rows = []
        for p in range(SKETCH_PARTS):
            c = total[p * own : (p + 1) * own]
            at = np.flatnonzero(c)
            if len(at):
                rows.append((p, at.astype(np.uint16).tobytes(), np.minimum(c[at], 65535).astype(np.uint16).tobytes()))
        yield hs.batch_of(rows, pa.schema([("part", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(own, np.int64)
        for at, n in zip(table["at"].to_pylist(), table["n"].to_pylist(), strict=True):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint16)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros(slots, np.int64)
    for r in docs.select("text").mapInArrow(count, "part int, at binary, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():
        total[r.part * own : (r.part + 1) * own] = np.frombuffer(r.n, np.int64)
    bound = 2 * total.mean() + 16
    out = np.zeros(slots, _U)
    often = total > bound
    out[often] = np.clip(np.log2(total[often] / bound).astype(np.int64) + 1, 1, 15)
    return out


def bitmap(x: np.ndarray, bits: int) -> bytes:
    """Parities of the set's elements over `bits` places, a power of two."""
    odd = np.bincount((x & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


_OUT = pa.schema([("kind", pa.int8()), ("part", pa.int64()), ("data", pa.binary()), ("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("d", pa.int64()), ("bits", pa.binary())])
_ENTRY = pa.schema([("part", pa.int64()), ("o", pa.int64()), ("d", pa.int64()), ("m", pa.int64()), ("pos", pa.int64())])
_PAIR = pa.schema([("x", pa.int64()), ("y", pa.int64())])


def _least_before(x: np.ndarray) -> np.ndarray:
    """For each element the least hash (a bijection of elements) of those before it; nothing is before the first."""
    h = hs.mixed(x + _U(0x2545F4914F6CDD1D))
    return np.concatenate(([_U(0)], np.minimum.accumulate(h)[:-1])) if len(x) else h


def _emit(box, parts: int, rule: Rule):
    """For each text its set's class and size; for each slice and range of hashes the prefix entries of its classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = box.value
        for batch in common.slices(batches, "text", SLICE):
            ids, k1s, k2s = (batch.column(c).to_pylist() for c in ("doc_id", "k1", "k2"))
            rows, seen, o, m, meta = [], set(), [], [], []
            for i, k1, k2, raw in zip(ids, k1s, k2s, raw_sets(batch.column("text"), rule.width), strict=True):
                x = ordered(raw, classes)
                n = len(x)
                d = xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63)
                fresh = n and d not in seen
                rows.append((1, None, None, i, k1, k2, n, d if n else None, bitmap(x, rule.bits(n)) if fresh else None))
                if fresh:
                    seen.add(d)
                    p = rule.prefix(n)
                    o.append(x[:p])
                    m.append(_least_before(x[:p]))
                    meta.append((d, p))
            if meta:
                d, p = (np.array(c, np.int64) for c in zip(*meta, strict=True))
                o, m = np.concatenate(o), np.concatenate(m)
                pos = np.arange(len(o)) - np.repeat(np.cumsum(p) - p, p)
                part = ((hs.mixed(o) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                three, pos = np.stack((o.astype(np.int64), np.repeat(d, p), m.astype(np.int64)))[:, order], pos[order].astype(np.uint32)
                for k, s in hs.cut_by_bucket(part[order]):
                    for a in range(s.start, s.stop, PACKED):
                        b = min(a + PACKED, s.stop)
                        rows.append((0, k, three[:, a:b].tobytes() + pos[a:b].tobytes(), None, None, None, None, None, None))
            yield hs.batch_of(rows, _OUT)

    return run


def _lists(key: tuple, table: pa.Table) -> pa.Table:
    """The entries of lists that two classes or more share."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for data in table["data"].to_pylist():
        k = len(data) // 28
        three, pos = np.frombuffer(data, np.int64, 3 * k).reshape(3, k), np.frombuffer(data, np.uint32, k, 24 * k)
        for c, v in zip(cols, (*three, pos), strict=True):
            c.append(v)
    o, d, m, pos = (np.concatenate(c).astype(np.int64) for c in cols)
    order = np.lexsort((d, o))
    o, d, m, pos = o[order], d[order], m[order], pos[order]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (d[1:] != d[:-1])))
    o, d, m, pos = o[new], d[new], m[new], pos[new]
    first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
    many = np.repeat(np.diff(np.append(first, len(o))), np.diff(np.append(first, len(o)))) > 1
    part = np.full(int(many.sum()), key[0].as_py())
    return pa.Table.from_arrays([pa.array(v) for v in (part, o[many], d[many], m[many], pos[many])], schema=_ENTRY)


def _allowed(rule, n1, p1, n2, p2, c1, c2):
    """Entries of one list whose sizes and positions allow a link, of different components."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    return (c1 != c2) & (DEN * small >= rule.num * large) & (1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1) >= rule.overlap(n1 + n2))


class Bitmaps:
    """The bitmaps of a table's entries by length, for distances of many pairs at once."""

    def __init__(self, bits: list[bytes]):
        self.size = np.fromiter(map(len, bits), np.int64, len(bits))
        self.row = np.zeros(len(bits), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for n in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == n)
            self.row[own] = np.arange(len(own))
            self.of[n] = np.frombuffer(b"".join([bits[k] for k in own.tolist()]), np.uint8).reshape(-1, n)

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At most the symmetric difference of each pair of entries."""
        out = np.zeros(len(i), np.int64)
        swap = self.size[i] > self.size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        kind = self.size[i] << 32 | self.size[j]
        for k in np.unique(kind).tolist():
            small, large = k >> 32, k & 0xFFFFFFFF
            at = np.flatnonzero(kind == k)
            for part in np.array_split(at, max(1, len(at) * large // (16 << 20))):
                b = self.of[large][self.row[j[part]]].reshape(len(part), -1, small)
                x = self.of[small][self.row[i[part]]] ^ np.bitwise_xor.reduce(b, axis=1)
                out[part] = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        return out


class Blocks:
    """The entries of lists (o: list, n: set size, c: component, pos: place in the set) in blocks of one list, size and component.

    order: the entries by list, size, component and position; all other arrays go by it."""

    def __init__(self, rule: Rule, o: np.ndarray, n: np.ndarray, c: np.ndarray, pos: np.ndarray):
        self.rule = rule
        self.order = order = np.lexsort((pos, c, n, o))
        o, n, c, self.pos = o[order], n[order], c[order], pos[order]
        new = np.concatenate(([True], (o[1:] != o[:-1]) | (n[1:] != n[:-1]) | (c[1:] != c[:-1]))) if len(o) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.own = np.cumsum(new) - 1  # the block of each entry
        self.n, self.c = n[self.first], c[self.first]
        # of each block the first behind it whose list is another or whose sets are too large for a link
        lists = np.cumsum(np.concatenate(([True], o[self.first][1:] != o[self.first][:-1]))) if len(o) else np.zeros(0, np.int64)
        wide = int(n.max()) + 2 if len(n) else 2
        self.stop = np.searchsorted(lists * wide + self.n, lists * wide + np.minimum(self.n * DEN // rule.num, wide - 1), side="right")
        self.key = self.own * wide + np.minimum(self.pos, wide - 1)
        self.wide = wide
        self.seen = self.skipped = self.cut = 0  # blocks looked at, skipped whole, and entries left out of the others

    def pairs(self, most: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of entries (places in `order`) that sizes, positions and components allow, each pair of a list once; in slices."""
        count = self.stop[self.own] - self.own - 1 if len(self.own) else np.zeros(0, np.int64)
        for a, b in _runs(count, most):
            i = np.repeat(np.arange(a, b), count[a:b])
            k = np.arange(len(i)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b]) + self.own[i] + 1
            self.seen += len(k)
            n1, n2 = self.n[self.own[i]], self.n[k]
            need = self.rule.overlap(n1 + n2)
            good = (self.c[self.own[i]] != self.c[k]) & (self.pos[i] <= n1 - need)
            i, k, last = i[good], k[good], (n2 - need)[good]
            begin = self.first[k]
            end = np.searchsorted(self.key, k * self.wide + np.clip(last, -1, self.wide - 1), side="right")
            size = np.maximum(end - begin, 0)
            self.skipped += len(good) - int((size > 0).sum())
            self.cut += int((np.append(self.first, len(self.own))[k + 1] - begin - size)[size > 0].sum())
            for c, d in _runs(size, most):
                part = size[c:d]
                yield np.repeat(i[c:d], part), np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part) + np.repeat(begin[c:d], part)


def _runs(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices of an array of counts, each of about `most` altogether (one count may be more)."""
    ends = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


class Forest:
    """Nodes from 0 to size - 1, joined step by step."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether i and j weren't joined before."""
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        up = np.array(self.up, np.int64)
        while (up[up] != up).any():
            up = up[up]
        return up


def _pairs(rule: Rule, mode: str, salt: int):
    """Pairs of classes from the lists of one range, that neither sizes, positions nor bitmaps refute: with the list's leader, or with random
    partners."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        o, d, n, pos, c = (table[k].to_numpy() for k in ("o", "d", "n", "pos", "c"))
        order = np.lexsort((d, n, o))
        o, d, n, pos, c = o[order], d[order], n[order], pos[order], c[order]
        maps = Bitmaps(table["bits"].take(pa.array(order)).to_pylist())
        found: list[np.ndarray] = []

        def take(i, j):
            ok = _allowed(rule, n[i], pos[i], n[j], pos[j], c[i], c[j])
            i, j = i[ok], j[ok]
            total = n[i] + n[j]
            near = maps.distance(i, j) <= total - 2 * rule.overlap(total)
            x, y = d[i[near]], d[j[near]]
            found.append(_distinct_pairs(np.minimum(x, y), np.maximum(x, y)))

        if len(o):
            first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
            size = np.diff(np.append(first, len(o)))
            base, length = np.repeat(first, size), np.repeat(size, size)
            here = np.arange(len(o))
            if mode == "star":
                by = np.lexsort((hs.mixed(d.astype(_U)), o))
                take(here, np.repeat(by[first], size))
            else:
                for k in range(PARTNERS):
                    r = hs.mixed(d.astype(_U) ^ hs.mixed(o.astype(_U) + _U(salt * PARTNERS + k + 1)))
                    take(here, base + (r % length.astype(_U)).astype(np.int64))
        both = _distinct_pairs(*np.concatenate(found, axis=1)) if found else np.zeros((2, 0), np.int64)
        return pa.Table.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=_PAIR)

    return run


def _spanning(rule: Rule):
    """Of all pairs of classes from the lists of one range, that neither sizes, positions, components nor bitmaps refute, as many as span
    what they connect."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        o, d, m, n, pos, c = (table[k].to_numpy() for k in ("o", "d", "m", "n", "pos", "c"))
        blocks = Blocks(rule, o, n, c, pos)
        d, m, n, pos = d[blocks.order], m[blocks.order], n[blocks.order], pos[blocks.order]
        maps = Bitmaps(table["bits"].take(pa.array(blocks.order)).to_pylist())
        names, who = np.unique(d, return_inverse=True)
        forest, found = Forest(len(names)), []
        for i, j in blocks.pairs(LOOK):
            root = forest.roots()[who]
            # pairs with one least hash before them meet in the list of the element that both have before
            look = (root[i] != root[j]) & ((m[i] != m[j]) | (pos[i] == 0) | (pos[j] == 0))
            i, j = i[look], j[look]
            total = n[i] + n[j]
            near = maps.distance(i, j) <= total - 2 * rule.overlap(total)
            found += [(x, y) for x, y in zip(who[i[near]].tolist(), who[j[near]].tolist(), strict=True) if forest.join(x, y)]
        both = names[np.array(found, np.int64).reshape(-1, 2)]
        return pa.Table.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=_PAIR)

    return run


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


class Cluster:
    """Classes by rising size of their sets, with components, leaders, and distances to these; across: only pairs of unlike chunks."""

    def __init__(self, rule: Rule, sets: list[np.ndarray], c: np.ndarray, leader: np.ndarray, dist: np.ndarray, chunk: np.ndarray, across: bool):
        self.rule, self.sets, self.c, self.leader, self.dist, self.chunk, self.across = rule, sets, c, leader, dist, chunk, across
        self.counted = 0  # pairs counted exactly

    def links(self) -> list[tuple[int, int]]:
        """Links (places in the cluster) that join what all its links join, none within a component."""
        rule, sets = self.rule, self.sets
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        maps = Bitmaps([bitmap(x, rule.bits(len(x))) for x in sets])
        names, who = np.unique(self.c, return_inverse=True)
        forest, found = Forest(len(names)), []
        count = np.searchsorted(n, n * DEN // rule.num, side="right") - np.arange(len(n)) - 1
        for a, b in _runs(count, LOOK):
            i = np.repeat(np.arange(a, b), count[a:b])
            j = np.arange(len(i)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b]) + i + 1
            root = forest.roots()[who]
            look = root[i] != root[j]
            if self.across:
                look &= self.chunk[i] != self.chunk[j]
            i, j = i[look], j[look]
            most = n[i] + n[j] - 2 * rule.overlap(n[i] + n[j])
            led = self.leader[i] == self.leader[j]
            sure = led & (self.dist[i] + self.dist[j] <= most)
            look = sure | ~(led & (np.abs(self.dist[i] - self.dist[j]) > most)) & (maps.distance(i, j) <= most)
            for x, y, known in zip(i[look].tolist(), j[look].tolist(), sure[look].tolist(), strict=True):
                if forest.find(who[x]) != forest.find(who[y]):
                    self.counted += not known
                    if known or _same(sets[x], sets[y]) >= rule.overlap(len(sets[x]) + len(sets[y])):
                        forest.join(who[x], who[y])
                        found.append((x, y))
        return found


def _closing(rule: Rule):
    """Links of the clusters of one bucket, or of two chunks of a cluster."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cluster, a, b, chunk, d, n, c, leader, dist = (table[k].to_numpy() for k in ("cluster", "a", "b", "chunk", "d", "n", "c", "l", "dist"))
        order = np.lexsort((d, n, b, a, cluster))
        cluster, a, b, chunk, d, c, leader, dist = (v[order] for v in (cluster, a, b, chunk, d, c, leader, dist))
        sets = [np.frombuffer(x.as_buffer(), _U) for x in table["s"]]
        sets = [sets[k] for k in order.tolist()]
        first = np.flatnonzero(np.concatenate(([True], (cluster[1:] != cluster[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        found = []
        for p, q in zip(first.tolist(), [*first[1:].tolist(), len(d)], strict=True):
            s = slice(p, q)
            found += [(p + x, p + y) for x, y in Cluster(rule, sets[s], c[s], leader[s], dist[s], chunk[s], a[p] != b[p]).links()]
        both = d[np.array(found, np.int64).reshape(-1, 2)]
        return pa.Table.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=_PAIR)

    return run


def _distinct_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, bool)
    return np.stack((x[new], y[new]))


def _judge(rule: Rule):
    """0: no link, 1: link, 2: to be counted; of pairs with sizes and distances to a common leader."""
    total = F.col("nx") + F.col("ny")
    most = total - 2 * F.ceil(F.lit(rule.num) * total / (DEN + rule.num))
    led = F.col("lx").isNotNull() & (F.col("lx") == F.col("ly"))
    return F.when(led & (F.col("dx") + F.col("dy") <= most), 1).when(led & (F.abs(F.col("dx") - F.col("dy")) > most), 0).otherwise(2)


def _count(rule: Rule):
    """The symmetric difference of two sets, and whether they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dist, link = [], []
            for a, b in zip(batch.column("sx"), batch.column("sy"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
                same = _same(a, b)
                dist.append(len(a) + len(b) - 2 * same)
                link.append(DEN * same >= rule.num * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(dist, pa.int64()), pa.array(link, pa.bool_())], ["x", "y", "dist", "link"])

    return run


class SetJoin:
    """One run of the join over a table; rows(): the table's rows with set size and component."""

    def __init__(self, docs: DataFrame, rule: Rule = Rule()):
        self.spark, self.rule = docs.sparkSession, rule
        self.docs = keyed(docs)
        self.box = self.spark.sparkContext.broadcast(frequency_classes(docs, rule.width))
        parts = max(4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), common.input_bytes(docs) // RANGE_BYTES)
        sql = "kind tinyint, part bigint, data binary, doc_id bigint, k1 bigint, k2 bigint, n bigint, d bigint, bits binary"
        out = common.staged(self.docs.select("doc_id", "k1", "k2", "text").mapInArrow(_emit(self.box, parts, rule), sql), "sets", "kind")
        self.rows_ = out.where("kind = 1").select("doc_id", "k1", "k2", "n", "d", "bits")
        lists = out.where("kind = 0").select("part", "data").groupBy("part").applyInArrow(_lists, "part bigint, o bigint, d bigint, m bigint, pos bigint")
        self.entries = common.staged(lists, "set-lists")
        live = self.entries.select("d").distinct()
        # one row of each class that is in a list: its size, bitmap, and the key of a text that has it
        self.classes = common.staged(self.rows_.where("bits is not null").join(live, "d", "left_semi").groupBy("d").agg(F.max("n").alias("n"), F.max("bits").alias("bits"), F.min(F.struct("k1", "k2")).alias("key")), "set-classes")
        common.drop(out, "kind=0")
        self.near: DataFrame | None = None  # d, l, dist: a leader of a class and the distance to it
        self.tested: list[DataFrame] = []
        self.fresh: list[DataFrame] = []  # links that the labels don't know yet
        self.labels: DataFrame | None = None
        self.now = self.entries.withColumn("c", F.col("d"))
        common.release(self.spark)

    def _relabel(self, last: bool = False) -> None:
        """Takes the new links into the components, and leaves the entries of lists that still have several of them. last: nobody asks for those."""
        links = self.fresh[0]
        for x in self.fresh[1:]:
            links = links.unionByName(x)
        before, self.labels = self.labels, extended(self.labels, links)
        common.drop(before)
        common.drop(self.fresh[-1])  # the counted pairs; the judged ones are asked again
        self.fresh = []
        if last:
            return
        held = self.now.drop("c")
        named = held.join(self.labels.select(F.col("node").alias("d"), "label"), "d", "left").withColumn("c", F.coalesce("label", "d")).drop("label")
        split = named.groupBy("part", "o").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("part", "o")
        self.now = common.staged(named.join(split, ["part", "o"], "left_semi"), "set-entries")
        common.drop(held)

    def _open(self) -> tuple[int, int]:
        """Entries of lists with several components, and pairs of entries of different components in them."""
        per = self.now.groupBy("part", "o", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("part", "o").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("s"), F.count(F.lit(1)).alias("k"))
        r = per.where("k > 1").agg(F.sum("m").alias("entries"), F.sum((F.col("m") * F.col("m") - F.col("s")) / 2).alias("pairs")).first()
        return int(r.entries or 0), int(r.pairs or 0)

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """d and the set's elements in order, of the classes in `wanted`; written."""
        keys = wanted.join(self.classes, "d").select("d", "key.k1", "key.k2")
        box, width = self.box, self.rule.width

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches, "text", SLICE):
                found = [ordered(x, box.value).tobytes() for x in raw_sets(batch.column("text"), width)]
                yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(found, pa.binary())], ["d", "s"])

        texts = self.docs.select("k1", "k2", "text").join(keys, ["k1", "k2"]).select("d", "text")
        return common.staged(texts.mapInArrow(make, "d bigint, s binary").dropDuplicates(["d"]), "set-elements")

    def _round(self, mode: str, salt: int) -> None:
        open_ = self.now.join(self.classes.select("d", "n", "bits"), "d")
        pairs = open_.groupBy("part").applyInArrow(_pairs(self.rule, mode, salt), "x bigint, y bigint").distinct()
        if self.tested:
            before = self.tested[0].select("x", "y")
            for t in self.tested[1:]:
                before = before.unionByName(t.select("x", "y"))
            pairs = pairs.join(before, ["x", "y"], "left_anti")
        about = self.classes.select("d", "n")
        about = about.join(self.near, "d", "left") if self.near is not None else about.withColumns({"l": F.lit(None).cast("bigint"), "dist": F.lit(None).cast("bigint")})
        side = lambda k: about.select(F.col("d").alias(k), F.col("n").alias(f"n{k}"), F.col("l").alias(f"l{k}"), F.col("dist").alias(f"d{k}"))
        judged = common.staged(pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", _judge(self.rule).alias("verdict")), "set-judged")
        self.tested.append(judged)
        self.fresh.append(judged.where("verdict = 1").select("x", "y"))
        todo = judged.where("verdict = 2").select("x", "y")
        sets = self._sets(todo.select(F.col("x").alias("d")).unionByName(todo.select(F.col("y").alias("d"))).distinct())
        counted = common.staged(
            todo.join(sets.select(F.col("d").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("d").alias("y"), F.col("s").alias("sy")), "y").mapInArrow(_count(self.rule), "x bigint, y bigint, dist bigint, link boolean"),
            "set-counted",
        )
        common.drop(sets)
        self.fresh.append(counted.where("link").select("x", "y"))
        if mode == "star":
            both = counted.select(F.col("x").alias("d"), F.col("y").alias("l"), "dist").unionByName(counted.select(F.col("y").alias("d"), F.col("x").alias("l"), "dist"))
            self.near = common.staged(both.groupBy("d").agg(F.min(F.struct(F.xxhash64("l").alias("h"), "l", "dist")).alias("b")).select("d", "b.l", "b.dist"), "set-leaders")
        common.release(self.spark)

    def _close(self) -> None:
        """Judges all pairs that are left, within clusters."""
        open_ = self.now.join(self.classes.select("d", "n", "bits"), "d")
        near = common.staged(open_.groupBy("part").applyInArrow(_spanning(self.rule), "x bigint, y bigint"), "set-near")
        trees = components(near)
        common.drop(near)
        about = trees.select(F.col("node").alias("d"), F.col("label").alias("cluster")).join(self.classes.select("d", "n"), "d")
        sizes = about.groupBy("cluster").agg((8 * F.sum("n")).alias("bytes"))
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), (sizes.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES)
        about = about.join(sizes.select("cluster", F.ceil(F.col("bytes") / CHUNK_BYTES).alias("k")), "cluster").withColumn("chunk", F.expr("pmod(xxhash64(d, cluster), k)"))
        about = about.join(self.labels.select(F.col("node").alias("d"), F.col("label").alias("c")), "d", "left").withColumn("c", F.coalesce("c", "d"))
        about = about.join(self.near, "d", "left").withColumns({"l": F.coalesce("l", "d"), "dist": F.coalesce("dist", F.lit(0).cast("bigint"))})  # a class is its own leader
        about = about.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("other")).withColumns({"a": F.least("chunk", "other"), "b": F.greatest("chunk", "other")})
        bucket = F.when(F.col("k") == 1, F.pmod(F.xxhash64("cluster"), F.lit(int(buckets)))).otherwise(F.xxhash64("cluster", "a", "b"))
        sets = self._sets(trees.select(F.col("node").alias("d")))
        held = about.join(sets, "d").select(bucket.alias("bucket"), "cluster", "a", "b", "chunk", "d", "n", "c", "l", "dist", "s")
        self.fresh.append(common.staged(held.groupBy("bucket").applyInArrow(_closing(self.rule), "x bigint, y bigint"), "set-linked"))
        common.drop(sets)
        common.drop(trees)
        common.release(self.spark)

    def run(self) -> None:
        self._round("star", 0)
        self._relabel()
        before = None
        for k in range(ROUNDS):
            held, pairs = self._open()
            # what a round hardly lessens are pairs that are no links: those are refuted where they stand
            if pairs <= OPEN_PAIRS * held or (before is not None and pairs > 0.7 * before):
                break
            before = pairs
            self._round("random", k)
            self._relabel()
        self._close()
        self._relabel(last=True)
        for t in (self.now, self.classes, *self.tested, self.near):
            common.drop(t)

    def rows(self) -> DataFrame:
        """doc_id, k1, k2, n_shingles, component_id, group (null: empty set) of every row of the table."""
        self.run()
        of_class = self.rows_.where("d is not null").groupBy("d").agg(F.min("doc_id").alias("low"))
        of_class = of_class.join(self.labels.select(F.col("node").alias("d"), "label"), "d", "left").withColumn("label", F.coalesce("label", "d"))
        low = of_class.groupBy("label").agg(F.min("low").alias("component_id"))
        to = common.staged(of_class.join(low, "label").select("d", "component_id", F.col("label").alias("group")), "set-result")
        found = self.rows_.where("d is not null").select("doc_id", "k1", "k2", "n", "d").join(to.hint("merge"), "d").select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "component_id", "group")
        return found.unionByName(self.rows_.where("d is null").select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("group")))


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return SetJoin(docs, rule).rows().select("doc_id", "n_shingles", "component_id")


def survivors(docs: DataFrame, rule: Rule = Rule(5, 80)) -> DataFrame:
    """The rows of docs, with all columns, of which each component keeps one: the smallest doc_id, null last. Empty sets all stay."""
    found = common.staged(SetJoin(docs, rule).rows(), "set-components")
    alone = found.where("n_shingles = 0").select("k1", "k2").distinct()
    best = found.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "k1", "k2")).alias("b")).select("b.k1", "b.k2")
    text = F.coalesce(F.col("text"), F.lit(""))
    # the caller's columns travel in one struct, so that no name of theirs meets one of ours
    marked = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("k1"), F.xxhash64(text).alias("k2"))
    same = found.where("n_shingles > 0").groupBy("k1", "k2").count().where("count > 1").limit(1).count()
    out = marked.join(best, ["k1", "k2"], "left_semi")
    if same:  # equal rows: one of them
        out = out.dropDuplicates(["k1", "k2"])
    blank = marked.join(alone, ["k1", "k2"], "left_semi")
    return out.unionByName(blank).select("row.*")


def op10_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
common AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
low AS (SELECT x AS rid, min(doc_id) AS m FROM reach JOIN d ON d.rid = y GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN m < doc_id THEN m ELSE doc_id END AS component_id FROM d LEFT JOIN n USING (rid) LEFT JOIN low USING (rid)
"""
