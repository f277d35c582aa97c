"""Token-ID output: documents in order of doc_id, encoded by the tokenizers library, in range-coded files that are read back.

Rows are dealt by ranges of doc_id and sorted within; each task encodes its texts and packs segments (see range_coder). The
segments are a written table (part, seq, data): a segment is one file of the format, and part and seq give their order, so a
file can be fetched, checked and decoded alone. Starts are running sums over parts and segments, two small tables.

Words are encoded once a task and kept in a bounded memo: the vocabulary drops white space before it looks at words, so a text's ids
are its words' ids. Defined results: null and empty texts have only the end id; null doc_ids come first; rows with one doc_id
stand in order of their texts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from . import hashing as hs
from . import range_coder as rc

END = 2
#: Ids in a segment, about; bytes of input in a part; words that a worker remembers.
SEGMENT, PART_BYTES, MEMO = 6_000_000, 8 << 20, 500_000
#: Words that go to the library in one call.
CALL = 20_000


#: What a byte is for the cuts between words: an ASCII letter or digit, an ASCII sign other than the apostrophe, or neither.
_PLAIN, _SIGN, _ELSE = 1, 2, 0
_KIND = np.array([_ELSE if b >= 128 or b == 39 else _PLAIN if chr(b).isalnum() else _SIGN if 32 < b < 127 else _ELSE for b in range(256)], np.int8)


def units(texts: pa.Array | list, special: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The units of all texts, ASCII letters in lower case, and how many of them each text has: words, cut between ASCII letters or
    digits and ASCII signs, where the vocabulary's pattern always cuts and no normal form joins. Where a text of the slice has a special
    token, which stands for itself as it is written, the units are the words as they are."""
    sizes, found = hs.words(texts, lower=True)
    raw = hs.flat(texts)[0].tobytes().lower()
    if any(x.lower() in raw for x in special):
        return hs.words(texts)
    _, at, data = found.buffers()
    data, at = np.frombuffer(data, np.uint8), np.frombuffer(at, np.int32, len(found) + 1)
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    cut[1:-1] |= kind[1:] * kind[:-1] == _PLAIN * _SIGN
    edges = np.flatnonzero(cut) if len(data) else np.zeros(1, np.int64)
    return np.diff(np.searchsorted(edges, at[np.concatenate(([0], np.cumsum(sizes)))])), hs.tiles(data, edges)


class Encoder:
    """The ids of texts by a vocabulary file whose words end at white space."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Puts words into the memo. They are encoded as one text, a word a line; offsets tell whose each id is."""
        for a in range(0, len(words), CALL):
            part = words[a : a + CALL]
            text = b"\n".join(part).decode()
            e = self.library.encode(text, add_special_tokens=False)
            ids = np.array(e.ids, np.int64)
            begin = np.array([x for x, _ in e.offsets], np.int64)
            ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)
            counts = np.bincount(np.searchsorted(ends, begin, side="right"), minlength=len(part))
            for i, w in enumerate(part):
                self.rows[w] = len(self.starts) - 1 + i
            self.ids = np.concatenate((self.ids, ids.astype(np.uint16)))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(counts)))

    def encode(self, texts: pa.Array | list, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, with the end id, and all ids."""
        sizes, found = units(texts, self.special)
        coded = found.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in known if w not in self.rows]
        if len(self.rows) + len(new) > MEMO:
            self._forget()
            new = known
        self._learn(new)
        of = self.rows
        rows = np.fromiter((of[w] for w in known), np.int64, len(known))[coded.indices.to_numpy(zero_copy_only=False)]
        n = (self.starts[1:] - self.starts[:-1])[rows]
        begin = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.arange(begin[-1]) + np.repeat(self.starts[rows] - begin[:-1], n)]
        stops = begin[np.cumsum(sizes)]
        return np.diff(stops, prepend=0) + 1, np.insert(ids, stops, np.uint16(end))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_SEGMENT = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def write(docs: DataFrame, path: str) -> DataFrame:
    """The written segments of docs: part, seq, n_docs, n_ids, data."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), common.input_bytes(docs) // PART_BYTES)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(int(parts), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes, tokens = np.zeros(0, np.int64), np.zeros(0, np.uint16)

        def rows_of(most: int | None) -> Iterator[tuple]:
            nonlocal seq, ids, sizes, tokens
            while ids and (most is None or len(tokens) >= most):
                # as many documents as fit; the last segment takes what is left
                n = max(1, int(np.searchsorted(np.cumsum(sizes), SEGMENT, side="right")))
                k = int(sizes[:n].sum())
                yield (part, seq, n, k, rc.pack(ids[:n], sizes[:n], tokens[:k]))
                seq += 1
                ids, sizes, tokens = ids[n:], sizes[n:], tokens[k:]

        for batch in common.slices(batches, "text", 8 << 20):
            s, t = encoder(path).encode(batch.column("text"))
            ids, sizes, tokens = ids + batch.column("doc_id").to_pylist(), np.concatenate((sizes, s)), np.concatenate((tokens, t))
            for r in rows_of(SEGMENT):
                yield hs.batch_of([r], _SEGMENT)
        for r in rows_of(None):
            yield hs.batch_of([r], _SEGMENT)

    return common.staged(rows.mapInArrow(run, "part bigint, seq bigint, n_docs bigint, n_ids bigint, data binary"), "token-segments")


def with_starts(segments: DataFrame) -> DataFrame:
    """segments with `start`, the ids of all segments before: sums of parts first (a row a part), then within each part."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before = parts.select("part", (F.sum("all").over(W.orderBy("part")) - F.col("all")).alias("before"))
    inner = segments.select("part", "seq", (F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("inner"))
    starts = inner.join(before, "part").select("part", "seq", (F.col("before") + F.col("inner")).alias("start"))
    return segments.select("part", "seq", "data").join(starts, ["part", "seq"])


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start and ids of every document of written segments."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, start in zip(batch.column("data"), batch.column("start").to_pylist(), strict=True):
                doc_ids, sizes, ids = rc.unpack(data.as_py())
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes), lists], schema=schema)

    return with_starts(segments).mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")


def digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of written segments."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, start in zip(batch.column("data"), batch.column("start").to_pylist(), strict=True):
                doc_ids, sizes, ids = rc.unpack(data.as_py())
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], schema=schema)

    return with_starts(segments).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(write(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
