"""Byte-level BPE by a pair occurrence index.

The texts of a slice are one array of bytes. Classes of characters (letter, digit, white space, other) part it into pieces, by array steps
over the whole slice; pieces are numbered by dictionary encoding, so that each distinct one is looked at once. Those that the
worker hasn't met are laid end to end. An index maps each mergeable pair to all its positions; the active ranks are applied in ascending
order, each to all its occurrences at once, and only the lists of the pairs that a merge makes are extended (stale positions are
dropped when their pair's turn comes). Texts' ids, and the bytes that these decode to, are gathered from the pieces' results.
Nothing is shuffled; a task holds one slice of texts and a bounded memo of pieces.

Defined results: null text counts as empty and has no ids; texts of any length are encoded whole; special tokens that stand in
a text get their ids, as the tokenizers library gives them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import common
from . import hashing as hs

#: Pieces that a worker remembers, and bytes of text that it holds at a time.
MEMO, SLICE = 200_000, 3 << 20
OTHER, LETTER, DIGIT, BLANK, UNKNOWN = range(5)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PairIndex:
    """Merges of a vocabulary file, and encode() of many pieces at once."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.left, self.right, self.made = (np.array([vocab[x] for x in col], np.int64) for col in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        born = {int(t): r for r, t in enumerate(self.made.tolist())}
        if any(max(born.get(a, -1), born.get(b, -1)) >= r for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True))):
            raise ValueError("a merge of this vocabulary comes before the merges that make its parts")
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.of_byte = np.array([vocab[c] for c in byte_alphabet()], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, end to end, and where each piece's ids begin (one more at the end)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(sym)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        filled = ends[sizes > 0]
        after[filled - 1] = -1
        before[filled[:-1]] = -1
        if n:
            before[0] = -1
        at = np.flatnonzero(after >= 0)
        rank = self.ranks(sym[at], sym[at + 1])
        index: dict[int, list[np.ndarray]] = {}
        self._file(index, at[rank >= 0], rank[rank >= 0])
        ready = sorted(index)
        while ready:
            r = heapq.heappop(ready)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            at = np.sort(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            nxt = after[at]
            at = at[(sym[at] == a) & (nxt >= 0) & (sym[nxt] == b)]
            if a == b and len(at) > 1:  # of overlapping occurrences, every other one from the left
                first = np.ones(len(at), bool)
                first[1:] = after[at[:-1]] != at[1:]
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            nxt = after[gone]
            sym[at], sym[gone] = self.made[r], -1
            after[at] = nxt
            has = nxt >= 0
            before[nxt[has]] = at[has]
            prev = before[at]
            pos = np.sort(np.concatenate((at[has], prev[prev >= 0])))
            if len(pos):
                pos = pos[np.concatenate(([True], pos[1:] != pos[:-1]))]
                rank = self.ranks(sym[pos], sym[after[pos]])
                for k in self._file(index, pos[rank >= 0], rank[rank >= 0]):
                    heapq.heappush(ready, k)
        alive = np.concatenate(([0], np.cumsum(sym >= 0)))
        return sym[sym >= 0], alive[np.concatenate(([0], ends))]

    @staticmethod
    def _file(index: dict[int, list[np.ndarray]], at: np.ndarray, rank: np.ndarray) -> list[int]:
        """Adds positions to the lists of their ranks; the ranks that had no list."""
        if not len(at):
            return []
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        new = []
        for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                new.append(r)
        return new


@dataclass
class Encoded:
    """Ids of a slice of texts: those of text i are ids[at[i]:at[i + 1]], of its pieces rows[piece_at[i]:piece_at[i + 1]] in the memo."""

    ids: np.ndarray
    at: np.ndarray
    rows: np.ndarray
    piece_at: np.ndarray


def _blobs(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.large_binary())


def _grouped(values: pa.Array, edges: np.ndarray) -> pa.Array:
    """The values of each run from edges[i] to edges[i + 1], joined."""
    _, at, data = values.buffers()
    at = np.frombuffer(at, np.int64, len(values) + 1) if len(values) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(at[edges]), data if data is not None else pa.py_buffer(b"")])


class Codec:
    """Encodes and decodes texts as the tokenizers library does with the same vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.index = PairIndex(vocab, spec["model"]["merges"])
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self._special = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))).finditer if self.special else None
        byte = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        self.bytes_of = {i: b"".join(byte.get(c, c.encode()) for c in t) for t, i in (vocab | {k.decode(): i for k, i in self.special.items()}).items()}
        most = max(self.bytes_of) + 1
        self._bytes = _blobs([self.bytes_of.get(i, b"") for i in range(most)])
        self._decimal = _blobs([b"%d," % i for i in range(most)])
        self._class = np.full(0x110000, UNKNOWN, np.uint8)
        # the file without its vocabulary, which the library would hold once more
        self._rules = json.dumps(spec | {"added_tokens": [], "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}})
        self._library = None
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.decimals, self.decoded = _blobs([]), _blobs([])

    def _classes(self, chars: np.ndarray) -> np.ndarray:
        """The class of each character as the library's own pattern has it; it is asked once for each character."""
        found = self._class[chars]
        if (found == UNKNOWN).any():
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_str(self._rules).pre_tokenizer
            for c in np.unique(chars[found == UNKNOWN]).tolist():
                joins = (k for k, beside in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")) if len(self._library.pre_tokenize_str(beside + chr(c))) == 1)
                self._class[c] = next(joins, BLANK)
            found = self._class[chars]
        return found

    def cut(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pieces of texts begin that stand end to end in data (UTF-8), and the end of the last."""
        if not len(data):
            return np.zeros(1, np.int64)
        place = None
        if data.max() < 128:
            chars = data.astype(np.int32)
        else:
            chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.int32)
            place = np.flatnonzero((data & 0xC0) != 0x80)
        border = np.zeros(len(data) + 1, bool)
        border[at] = True
        inner: list[tuple[int, int]] = []
        if self._special:
            raw = data.tobytes()
            if any(x in raw for x in self.special):
                inner = [(a + m.start(), a + m.end()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for m in self._special(raw[a:b])]
                border[[x for ab in inner for x in ab]] = True
        edge = border[:-1] if place is None else border[place]  # a text or a special token begins or has just ended
        kind = self._classes(chars)
        blank = kind == BLANK
        start = edge.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # one space joins what follows, and of more white space before a word the last stands apart
        joined = np.zeros(len(chars), bool)
        joined[1:] = (chars[:-1] == 32) & ~blank[1:] & ~edge[1:]
        start &= ~joined
        before_word = np.zeros(len(chars), bool)
        before_word[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:]
        start |= before_word
        # 's 'd 'm 't 'll 've 're, where an apostrophe begins a piece
        quote = np.flatnonzero((chars == 39) & start)
        quote = quote[quote + 1 < len(chars)]
        quote = quote[~edge[quote + 1]]
        after = chars[quote + 1]
        two = quote[np.isin(after, [ord(c) for c in "sdmt"])]
        rest = quote[np.isin(after, [ord(c) for c in "lvr"]) & (quote + 2 < len(chars))]
        rest = rest[~edge[rest + 2]]
        pair = chars[rest + 1] << 8 | chars[rest + 2]
        three = rest[np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("ll", "ve", "re")])]
        for found, n in ((two, 2), (three, 3)):
            # the apostrophe may stand in a longer run of other signs; then it is no contraction of its own
            start[found + 1] = False
            end = found + n
            start[end[end < len(chars)]] = True
        begin = np.flatnonzero(start) if place is None else place[start]
        if inner:
            for a, b in inner:
                begin = begin[(begin <= a) | (begin >= b)]
        return np.append(begin, len(data))

    def _learn(self, pieces: list[bytes]) -> None:
        """Puts pieces into the memo: their ids, these in decimals each with a comma after it, and the bytes that they decode to."""
        if not pieces:
            return
        ids, starts = self.index.encode([b"" if p in self.special else p for p in pieces])
        if not self.special.keys().isdisjoint(pieces):
            own = {i: self.special[p] for i, p in enumerate(pieces) if p in self.special}
            ids = np.insert(ids, starts[list(own)], list(own.values()))
            starts = starts + np.cumsum([0, *(i in own for i in range(len(pieces)))])
        for i, p in enumerate(pieces):
            self.rows[p] = len(self.starts) - 1 + i
        self.starts = np.concatenate((self.starts, self.starts[-1] + starts[1:]))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.decimals = pa.concat_arrays([self.decimals, _grouped(self._decimal.take(pa.array(ids)), starts)])
        self.decoded = pa.concat_arrays([self.decoded, _grouped(self._bytes.take(pa.array(ids)), starts)])

    def slice(self, texts: pa.Array | list) -> Encoded:
        """The ids of a slice of texts."""
        data, at = hs.flat(texts)
        edges = self.cut(data, at)
        coded = hs.tiles(data, edges).dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [p for p in known if p not in self.rows]
        if len(self.rows) + len(new) > MEMO:
            self._forget()
            new = known
        self._learn(new)
        of = self.rows
        rows = np.fromiter((of[p] for p in known), np.int64, len(known))[coded.indices.to_numpy(zero_copy_only=False)]
        n = (self.starts[1:] - self.starts[:-1])[rows]
        begin = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.arange(begin[-1]) + np.repeat(self.starts[rows] - begin[:-1], n)]
        piece_at = np.searchsorted(edges[:-1], at)
        return Encoded(ids, begin[piece_at], rows, piece_at)

    def joined(self, values: pa.Array, e: Encoded) -> Iterator[memoryview]:
        """What stands in `values` (decimals or decoded, by row of the memo) for the pieces of each text, end to end."""
        got = values.take(pa.array(e.rows))
        _, at, data = got.buffers()
        ends = (np.frombuffer(at, np.int64, len(got) + 1) if len(got) else np.zeros(1, np.int64))[e.piece_at].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        for a, b in zip(ends, ends[1:], strict=False):
            yield view[a:b]

    def encode(self, texts: pa.Array | list) -> Iterator[tuple[bytes, str]]:
        """For each text its ids, joined by commas, and what these ids decode to."""
        e = self.slice(texts)
        for ids, text in zip(self.joined(self.decimals, e), self.joined(self.decoded, e), strict=True):
            yield bytes(ids[:-1]), str(text, "utf-8", "replace")

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", SLICE):
            e = codec(path).slice(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(e.at, pa.int32()), pa.array(e.ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows that encoded() gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both directions in one pass over each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        of = codec(path)
        for batch in common.slices(batches, "text", SLICE):
            common.trim()
            e = of.slice(batch.column("text"))
            a = [hashlib.sha256(x[:-1]).hexdigest() for x in of.joined(of.decimals, e)]
            # as the library decodes: what is no UTF-8 becomes U+FFFD
            b = [hashlib.sha256(str(x, "utf-8", "replace").encode()).hexdigest() for x in of.joined(of.decoded, e)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(e.at), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_pair_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
