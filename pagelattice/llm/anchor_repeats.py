"""Substring dedup by fixed-block anchors.

Every text is cut into reference blocks of 18 words that do not overlap; every rolling window of 18 words probes them.
Two equal runs of 35 words anywhere hold, on each side, a whole reference block that the other side's rolling windows meet, so no
repeat is missed. Blocks that were met are extended: the 35-word windows that contain them are compared by 80 bits of
hash with all other such windows, and neighbouring equal windows join to maximal repeats.

What is shuffled are sorted hash lists: one row for each slice of texts and hash range, each hash once a slice however often
the slice has it (a very common passage costs an entry a slice). No pairs are formed. Positions travel only with
blocks and with windows around met blocks. Slices are numbered by partition and order, so that a task that is run again names them alike.

Defined results: null and empty texts have no words; texts of fewer than 35 words lose nothing; equal rows are copies of each other
and lose all that a window covers; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import hashing as hs

WINDOW, BLOCK = 35, 18
#: Bytes of text that a slice holds, and of input for each range of hashes.
SLICE, RANGE_BYTES = 16 << 20, 2 << 20
#: Bits of the first hash of phase two; a second one adds 32.
WINDOW_BITS = 48

# rows between the phases: part is a range of hashes (or, for rows that only pass through, -1 - a spread), chunk a slice
_ROW = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_ROW_SQL = "part bigint, chunk bigint, kind tinyint, a binary, b binary, c binary"
_HIT = pa.schema([("chunk", pa.int64()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_HIT_SQL = "chunk bigint, kind tinyint, a binary, b binary, c binary"
_DOC = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.binary())])
_DOC_SQL = "k1 bigint, k2 bigint, at binary"
LIST, TABLE, LOCAL = 0, 1, 2


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key: rows with one key are equal rows (or have equal results)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("k1"), F.xxhash64(text).alias("k2"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    task = TaskContext.get().partitionId()
    for n, batch in enumerate(common.slices(batches, "text", SLICE, 60_000)):
        yield task << 32 | n, batch


def anchor_bits(size: int) -> int:
    """Bits of the hashes of phase one, for `size` bytes of input: 16 more than its blocks need, so that few meet by chance. A false
    meeting only costs a comparison in phase two."""
    return min(64, max(40, (size // 32).bit_length() + 16))


def _part(value: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The range of hashes that each hash is in."""
    return ((value >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _table_row(chunk: int, batch: pa.RecordBatch, sizes: np.ndarray) -> tuple:
    """The slice's keys and word counts, by which places (counted in words through the slice) become texts and words."""
    keys = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("k1", "k2")]
    return (-1 - chunk % 4093, chunk, TABLE, *keys, sizes.astype(np.uint32).tobytes())


def _once(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of h, where its distinct values begin in that order, and how often each is there."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(s)))


def _probe(parts: int, bits: int):
    """Phase one, by slice: the distinct hashes of all rolling windows, and the reference blocks with their places."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in _chunks(batches):
            h, sizes = hs.word_hashes(batch.column("text"))
            at = hs.starts(sizes, BLOCK, WINDOW)
            if not len(at):
                continue
            key = hs.windows(h, BLOCK)[at] >> shift
            order, first, count = _once(key)
            value = key[order][first]
            begin = np.cumsum(sizes) - sizes
            off = at - begin[np.searchsorted(begin + sizes, at, side="right")]
            block = np.flatnonzero(off % BLOCK == 0)
            block = block[np.argsort(key[block], kind="stable")]
            bkey, place = key[block], at[block].astype(np.uint32)
            entry = np.searchsorted(value, bkey)
            rows = [_table_row(chunk, batch, sizes)]
            for p, s in hs.cut_by_bucket(_part(value, bits, parts)):
                lo, hi = np.searchsorted(entry, s.start), np.searchsorted(entry, s.stop)
                mine = (entry[lo:hi] - s.start).astype(np.uint32)
                rows.append((p, chunk, LIST, hs.pack_sorted(value[s]), np.packbits(count[s] > 1).tobytes(), mine.tobytes() + place[lo:hi].tobytes()))
            yield hs.batch_of(rows, _ROW)

    return run


def _met(key: tuple, table: pa.Table) -> pa.Table:
    """For a range of hashes: the places of blocks whose hash some other place has too. Rows of other kinds pass."""
    passing = table.filter(pc.not_equal(table["kind"], LIST))
    out = [passing.select(_HIT.names).cast(_HIT)]
    lists = table.filter(pc.equal(table["kind"], LIST))
    if lists.num_rows:
        values, counts = [], []
        for a, b in zip(lists["a"].to_pylist(), lists["b"].to_pylist(), strict=True):
            values.append(hs.unpack_sorted(a))
            counts.append(1 + np.unpackbits(np.frombuffer(b, np.uint8), count=len(values[-1])))
        value = np.concatenate(values)
        order, first, _ = _once(value)
        total = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], first)
        often = value[order][first][total > 1]
        rows = []
        for chunk, v, c in zip(lists["chunk"].to_pylist(), values, lists["c"].to_pylist(), strict=True):
            both = np.frombuffer(c, np.uint32)
            keys, places = v[both[: len(both) // 2]], both[len(both) // 2 :]
            if len(keys) and len(often):
                hit = often[np.minimum(np.searchsorted(often, keys), len(often) - 1)] == keys
                if hit.any():
                    rows.append((chunk, LIST, places[hit].tobytes(), b"", b""))
        out.append(pa.Table.from_batches([hs.batch_of(rows, _HIT)]))
    return pa.concat_tables(out)


def _by_doc(key: tuple, table: pa.Table) -> pa.Table:
    """For a slice: the places of each of its texts, rising."""
    kinds = table["kind"].to_pylist()
    a, b, c = (table[x].to_pylist() for x in "abc")
    places = np.concatenate([np.frombuffer(x, np.uint32) for x, k in zip(a, kinds, strict=True) if k != TABLE] or [np.zeros(0, np.uint32)])
    if not len(places):
        return _DOC.empty_table()
    tab = kinds.index(TABLE)
    k1, k2 = np.frombuffer(a[tab], np.int64), np.frombuffer(b[tab], np.int64)
    ends = np.cumsum(np.frombuffer(c[tab], np.uint32).astype(np.int64))
    places = np.unique(places).astype(np.int64)
    doc = np.searchsorted(ends, places, side="right")
    begin = np.concatenate(([0], ends))
    rows = [(int(k1[d]), int(k2[d]), (places[s] - begin[d]).astype(np.uint32).tobytes()) for d, s in hs.cut_by_bucket(doc)]
    return pa.Table.from_batches([hs.batch_of(rows, _DOC)])


def _extend(parts: int):
    """Phase two, by slice: hashes and places of the 35-word windows that hold a block that was met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in _chunks(batches):
            h, sizes = hs.word_hashes(batch.column("text"))
            begin = np.cumsum(sizes) - sizes
            wanted = np.zeros(len(h) + 1, np.int32)
            for i, data in enumerate(batch.column("at").to_pylist()):
                met = np.frombuffer(data, np.uint32).astype(np.int64)
                np.add.at(wanted, begin[i] + np.maximum(met - (WINDOW - BLOCK), 0), 1)
                np.add.at(wanted, begin[i] + met + 1, -1)
            at = hs.starts(sizes, WINDOW)
            at = at[np.cumsum(wanted)[at] > 0]
            if not len(at):
                continue
            key = hs.windows(h, WINDOW)[at] >> np.uint64(64 - WINDOW_BITS)
            more = (hs.windows(h, WINDOW, 1)[at] >> np.uint64(32)).astype(np.uint32)
            place = at.astype(np.uint32)
            order = np.lexsort((more, key))
            key, more, place = key[order], more[order], place[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])))
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(key)))
            rows = [_table_row(chunk, batch, sizes)]
            here = place[np.repeat(count > 1, count)]  # known to be repeated without asking
            if len(here):
                rows.append((-1 - chunk % 4093, chunk, LOCAL, here.tobytes(), b"", b""))
            key, more, place = key[first], more[first], place[first]
            for p, s in hs.cut_by_bucket(_part(key, WINDOW_BITS, parts)):
                lone = count[s] == 1
                rows.append((p, chunk, LIST, hs.pack_sorted(key[s]), np.packbits(~lone).tobytes(), more[s].tobytes() + place[s][lone].tobytes()))
            yield hs.batch_of(rows, _ROW)

    return run


def _same(key: tuple, table: pa.Table) -> pa.Table:
    """For a range of hashes: the places of windows that stand elsewhere too. Rows of other kinds pass."""
    passing = table.filter(pc.not_equal(table["kind"], LIST))
    out = [passing.select(_HIT.names).cast(_HIT)]
    lists = table.filter(pc.equal(table["kind"], LIST))
    if lists.num_rows:
        values, mores, manys, lones = [], [], [], []
        for a, b, c in zip(*(lists[x].to_pylist() for x in "abc"), strict=True):
            v = hs.unpack_sorted(a)
            values.append(v)
            manys.append(np.unpackbits(np.frombuffer(b, np.uint8), count=len(v)).astype(bool))
            mores.append(np.frombuffer(c, np.uint32, count=len(v)))
            lones.append(np.frombuffer(c, np.uint32, offset=4 * len(v)))
        value, more, many = np.concatenate(values), np.concatenate(mores), np.concatenate(manys)
        order = np.lexsort((more, value))
        v, m = value[order], more[order]
        first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (m[1:] != m[:-1]))))
        n = np.diff(np.append(first, len(v)))
        often = np.empty(len(v), bool)
        often[order] = np.repeat((n > 1) | (np.add.reduceat(many[order].astype(np.int64), first) > 0), n)
        rows, i = [], 0
        for chunk, vs, ms, places in zip(lists["chunk"].to_pylist(), values, manys, lones, strict=True):
            hit = places[often[i : i + len(vs)][~ms]]
            i += len(vs)
            if len(hit):
                rows.append((chunk, LIST, hit.tobytes(), b"", b""))
        out.append(pa.Table.from_batches([hs.batch_of(rows, _HIT)]))
    return pa.concat_tables(out)


def _round(rows: DataFrame, judge, name: str) -> DataFrame:
    """rows by hash range, then by slice, as a written table with one row for each key."""
    hits = rows.groupBy("part").applyInArrow(judge, _HIT_SQL)
    places = hits.groupBy("chunk").applyInArrow(_by_doc, _DOC_SQL)
    out = common.staged(places.groupBy("k1", "k2").agg(F.max("at").alias("at")), name)  # equal rows have equal places
    common.release(rows.sparkSession)
    return out


def repeats(docs: DataFrame) -> DataFrame:
    """k1, k2, at: for each text with repeats, the starts (uint32) of all its 35-word windows that stand elsewhere too."""
    spark = docs.sparkSession
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), common.input_bytes(docs) // RANGE_BYTES)
    rows = keyed(docs)
    bits = anchor_bits(common.input_bytes(docs))
    met = _round(rows.select("k1", "k2", "text").mapInArrow(_probe(parts, bits), _ROW_SQL), _met, "anchors-met")
    near = rows.select("k1", "k2", "text").join(met, ["k1", "k2"]).sortWithinPartitions("k1", "k2")
    return _round(near.mapInArrow(_extend(parts), _ROW_SQL), _same, "anchor-repeats")


def covered(n_words: int, at: bytes | None) -> np.ndarray:
    """Of n_words words, those that a repeated window covers."""
    edge = np.zeros(n_words + 1, np.int32)
    if at:
        begin = np.frombuffer(at, np.uint32).astype(np.int64)
        edge[begin] += 1
        edge[begin + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def _joined(docs: DataFrame) -> DataFrame:
    return keyed(docs).join(repeats(docs), ["k1", "k2"], "left").select("doc_id", "text", "at")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The operator's output: doc_id, text with repeated words removed, spans (first word, words) of the maximal repeats."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            rows = []
            for i, t, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "at")), strict=True):
                words = t.encode().split()
                gone = covered(len(words), at)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                rows.append((i, b" ".join(compress(words, ~gone)).decode(), [{"start": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]))
            yield hs.batch_of(rows, schema)

    return _joined(docs).mapInArrow(run, "doc_id bigint, text string, spans array<struct<start:int,words:int>>")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            rows = []
            for i, t, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "at")), strict=True):
                words = t.encode().split()
                gone = covered(len(words), at)
                kept = compress(words, (~gone).tolist()) if at else words
                rows.append((i, len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield hs.batch_of(rows, schema)

    return _joined(docs).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def op4_anchor_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, p, array_to_string(w[p:p + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
rep AS (SELECT rid, p FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS i FROM rep),
words AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS k FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)
"""
