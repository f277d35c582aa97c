"""Media columns: payloads stored as lossless WebP, read back and turned into pixel arrays and features.

Both directions are maps over rows; the media themselves are a written table between them. Nothing is shuffled. A task holds one
slice of texts.

Defined results: null text counts as empty, and an empty payload is one row of zeros; equal payloads give equal media, pixels
and features; payloads of any length are stored whole, as several tiles; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from . import hashing as hs
from . import webp_lossless as webp

ROW = 4 * webp.WIDTH


def padded(data: bytes) -> bytes:
    """data with zeros up to a positive multiple of 64."""
    return data + bytes(-len(data) % ROW if data else ROW)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text's UTF-8 bytes, padded, as lossless WebP tiles."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 8 << 20):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            media = webp.encode([padded(x) for x in raw])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


_decoder: list[webp.Decoder] = []


def pixels_of(media: list[bytes]) -> list[np.ndarray]:
    """[rows, WIDTH, 4] of R, G, B, A of each medium; all tiles of a call are decoded together."""
    if not _decoder:
        _decoder.append(webp.Decoder())
    files = [webp.files_of(m) for m in media]
    found = iter(_decoder[0].decode([f for fs in files for f in fs]))
    return [np.concatenate([next(found) for _ in fs])[:, :, [1, 2, 3, 0]] if fs else np.zeros((0, webp.WIDTH, 4), np.uint8) for fs in files]


def feature(pixels: np.ndarray) -> str:
    """Rows, then of each channel mean, deviation and mean step down a column, then a 64-bit difference hash of a 9 x 8 mean grid."""
    x = pixels.astype(np.int64)
    n = x.shape[0] * x.shape[1]
    mean = x.sum((0, 1)) / n
    dev = np.sqrt(np.maximum((x * x).sum((0, 1)) / n - mean * mean, 0))
    step = np.abs(np.diff(x, axis=0)).sum((0, 1)) / max(1, n - x.shape[1])
    flat = x.sum(2).ravel()
    cut = np.linspace(0, len(flat), 73).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(flat)))
    grid = ((total[cut[1:]] - total[cut[:-1]]) / np.maximum(np.diff(cut), 1)).reshape(8, 9)
    bits = np.packbits((grid[:, 1:] > grid[:, :-1]).ravel()).tobytes().hex()
    return f"{x.shape[0]};" + ",".join(f"{v:.4f}" for v in (*mean, *dev, *step)) + f";{bits}"


def arrays(media: DataFrame) -> DataFrame:
    """doc_id, height, width, pixels (R, G, B, A samples by row) of rows that stored() gave."""
    schema = pa.schema([("doc_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "media", 8 << 20):
            found = pixels_of(batch.column("media").to_pylist())
            yield hs.batch_of([(i, len(p), webp.WIDTH, p.tobytes()) for i, p in zip(batch.column("doc_id").to_pylist(), found, strict=True)], schema)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id bigint, height int, width int, pixels binary")


def digests(media: DataFrame) -> DataFrame:
    """The columns of the contract, of rows that stored() gave."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "media", 8 << 20):
            media = batch.column("media").to_pylist()
            rows = []
            for i, n, m, p in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), media, pixels_of(media), strict=True):
                data = p.tobytes()
                rows.append((i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            yield hs.batch_of(rows, schema)

    sql = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.mapInArrow(run, sql)


def op5_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.staged(stored(common.documents(spark, sf_dir)), "media"))
