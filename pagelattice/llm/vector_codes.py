"""Vector codes: product quantisation in whole numbers, its nearest entries found through segment-mean lower bounds.

Components become floor(256 * x); vectors are cut into equal parts, each with a codebook of its own. For a part x and an entry c, cut into
segments of n components with sums S and squared residual norms R around the means, |x - c|^2 is at least the sum of
(Sx - Sc)^2 / n + (sqrt(Rx) - sqrt(Rc))^2. Entries are held to this bound on the whole part first, then on halves, then on quarters, against the exact
distance of the entry whose coarse bound is least; what is left gets its exact distance in 64-bit integers. The bounds are lowered by
more than doubles can round, so no nearest entry is lost, and ties go to the lower index.

An assignment is one pass over the vectors without a shuffle; each task adds up its sums and counts by entry first, so a round moves
a few thousand numbers a task, whatever the data, and a driver-side codebook of `entries` vectors goes out with the next pass.

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped. Codebooks start from the smallest vec_ids
(null last, then by components). Rows whose vector has no components, a length other than that of the first kept row, a length that the number of parts
doesn't divide, or a component beyond +-2**24 after scaling stay, with null code and error; they take no part in codebooks. Equal
rows have equal codes; fewer kept rows than entries make shorter codebooks; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Largest scaled component: squared distances of parts, and their sums over a part's rows, then stay within 64 bits.
LIMIT = 1 << 24
#: Vectors of one step: rows times entries times a few arrays of doubles.
ROWS = 4096
#: Distinct labels up to which their sums are broadcast; beyond, they are joined by a shuffle.
FEW_LABELS = 10_000


@dataclass(frozen=True)
class Options:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


def scaled(vectors: pa.Array, width: int, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be coded (width components in range), and their components as (vectors, parts, components)."""
    at = np.flatnonzero(pc.equal(pc.list_value_length(vectors), width).to_numpy(zero_copy_only=False).astype(bool)) if width else np.zeros(0, np.int64)
    x = np.floor(o.scale * vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width))
    ok = (np.abs(x) <= LIMIT).all(1)
    return at[ok], x[ok].astype(np.int64).reshape(int(ok.sum()), o.parts, width // o.parts if width else 0)


def levels(width: int) -> list[list[slice]]:
    """Segments of a part of `width` components, coarse to fine: the whole, halves, quarters, as long as a segment keeps two components."""
    out = []
    for k in (1, 2, 4):
        edges = np.linspace(0, width, k + 1).astype(int)
        if k == 1 or width // k >= 2:
            out.append([slice(a, b) for a, b in zip(edges, edges[1:], strict=False)])
    return out


def profile(x: np.ndarray, segments: list[slice]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Components, sums and residual norms of each segment of the rows of x."""
    out = []
    for s in segments:
        y = x[:, s].astype(np.float64)
        total, n = y.sum(1), s.stop - s.start
        out.append((n, total, np.sqrt(np.maximum((y * y).sum(1) - total * total / n, 0))))
    return out


def bound(a: list, b: list, i, j) -> np.ndarray:
    """Lower bounds of squared distances between rows i of one profile and rows j of another; less than the true value by more than rounding."""
    low: np.ndarray | float = 0.0
    size: np.ndarray | float = 0.0
    for (n, s, r), (_, t, q) in zip(a, b, strict=True):
        low = low + (s[i] - t[j]) ** 2 / n + (r[i] - q[j]) ** 2
        size = size + s[i] ** 2 / n + r[i] ** 2 + t[j] ** 2 / n + q[j] ** 2
    # a residual norm may be off by the square root of what rounding leaves of its square: some 1e-7 of the segment's norm
    return low - 1e-6 * np.sqrt(low * size) - 1e-6 * size * 1e-6 - 1e-3


def nearest(x: np.ndarray, book: np.ndarray, spent: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of x, the index of book's nearest row (the lower of equals) and the squared distance, both exact.

    spent: a list to which the number of entries left after each level, and that of all, are added."""
    steps = levels(x.shape[1])
    mine, theirs = [profile(x, s) for s in steps], [profile(book, s) for s in steps]
    row = np.arange(len(x))
    exact = lambda i, j: ((x[i] - book[j]) ** 2).sum(-1)
    coarse = bound(mine[0], theirs[0], row[:, None], np.arange(len(book))[None])
    most = exact(row, coarse.argmin(1))
    i, j = np.nonzero(coarse <= most[:, None])
    left = [coarse.size, len(i)]
    for a, b in zip(mine[1:], theirs[1:], strict=True):
        near = bound(a, b, i, j) <= most[i]
        i, j = i[near], j[near]
        left.append(len(i))
    d = exact(i, j)
    begin = np.searchsorted(i, row)
    least = np.minimum.reduceat(d, begin) if len(x) else d
    first = np.flatnonzero(d == least[i])
    first = first[np.searchsorted(i[first], row)]  # pairs stand by row, then by entry
    if spent is not None:
        spent.append(left)
    return j[first], least


def assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances of all vectors (rows) at all part positions (columns)."""
    found = [nearest(x[:, p], book) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def kept(vectors: DataFrame, id_column: str, vector_column: str, *more) -> DataFrame:
    """vec_id, vector, and more columns of the rows that have all components, all finite."""
    vector = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), vector.alias("vector"), *more)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", finite))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def start(rows: DataFrame, o: Options) -> list[np.ndarray]:
    """Codebooks of the first rows by vec_id that can be coded; the first row of all sets the length."""
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    first = head.select(F.size("vector").alias("n")).head()
    width = first.n if first and first.n and first.n % o.parts == 0 else 0
    able = (F.size("vector") == width) & F.forall("vector", lambda x: F.abs(F.floor(x * o.scale)) <= LIMIT)
    found = head.where(able).select("vector").limit(o.entries).collect() if width else []  # at most `entries` vectors
    x = np.floor(o.scale * np.array([r.vector for r in found], np.float64).reshape(len(found), width)).astype(np.int64)
    return [x.reshape(len(found), o.parts, -1)[:, p].copy() for p in range(o.parts)] if len(found) else []


def _width(books: list[np.ndarray]) -> int:
    return sum(b.shape[1] for b in books)


def improve(rows: DataFrame, books: list[np.ndarray], o: Options) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floored mean of the parts that are nearest to it; unused ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in _steps(batches):
            _, x = scaled(batch.column("vector"), _width(books), o)
            if len(x):
                code, _ = assigned(x, books)
                for p, total in enumerate(totals):
                    np.add.at(total, code[:, p], np.concatenate((x[:, p], np.ones((len(x), 1), np.int64)), 1))
        flat = [(p, e, t.tolist()) for p, total in enumerate(totals) for e, t in enumerate(total) if t[-1]]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["part", "entry", "sums"])

    parts = rows.select("vector").mapInArrow(run, "part int, entry int, sums array<bigint>")
    width = books[0].shape[1] + 1
    # sums of at most parts x entries rows; decimals, as the sums of very many large components may leave 64 bits
    sums = parts.groupBy("part", "entry").agg(F.array(*(F.sum(F.col("sums")[k].cast("decimal(38,0)")) for k in range(width))).alias("s")).collect()
    out = [b.copy() for b in books]
    for r in sums:
        n = int(r.s[-1])
        out[r.part][r.entry] = [int(v) // n for v in r.s[:-1]]
    return out


def fit(rows: DataFrame, o: Options = Options()) -> list[np.ndarray]:
    """Codebooks (one array of entries for each part; none if no row can be coded) of rows that kept() gave."""
    books = start(rows, o)
    for _ in range(o.rounds if books else 0):
        books = improve(rows, books, o)
    return books


def encode(rows: DataFrame, books: list[np.ndarray], o: Options = Options()) -> DataFrame:
    """rows with code (lowercase hex, as many digits an index as the largest needs) and error (squared distances, summed over parts)."""
    digits = max(2, (max(o.entries - 1, 1).bit_length() + 3) // 4)
    hexes = np.array([f"{k:0{digits}x}" for k in range(o.entries)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            at, x = scaled(batch.column("vector"), _width(books), o)
            if len(at):
                found, d = assigned(x, books)
                code[at] = ["".join(r) for r in hexes[found].tolist()]
                error[at] = d.sum(1)
            rest = [c for c in batch.schema.names if c != "vector"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(code, pa.string()), pa.array(error, pa.int64())], [*rest, "code", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "vector")
    return rows.mapInArrow(run, f"{kinds}, code string, error bigint")


def decode(codes: DataFrame, books: list[np.ndarray], o: Options = Options()) -> DataFrame:
    """vec_id and vector (scaled whole numbers) that rows (vec_id, code) stand for."""
    digits = max(2, (max(o.entries - 1, 1).bit_length() + 3) // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            found = [None if c is None else np.concatenate([b[int(c[digits * p : digits * (p + 1)], 16)] for p, b in enumerate(books)]).tolist() for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found, pa.list_(pa.int64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id bigint, vector array<bigint>")


def fingerprint(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def with_group_errors(coded: DataFrame, label: str) -> DataFrame:
    """coded with label_error: error summed over the rows of an equal label (nulls together). Sums of few labels are broadcast, others joined."""
    coded = common.staged(coded, "vector-codes")
    sums = common.staged(coded.groupBy(F.col(label).alias("_group")).agg(F.sum("error").alias("label_error")), "vector-code-errors")
    few = sums.count() <= FEW_LABELS
    return coded.join(F.broadcast(sums) if few else sums, coded[label].eqNullSafe(sums["_group"])).drop("_group")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.col("label").alias("label"))
    books = fit(rows)
    return with_group_errors(encode(rows, books), "label").select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    def step(k: int) -> str:
        d = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return f"a{k} AS MATERIALIZED (SELECT vec_id, label, p, x, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (SELECT v.vec_id, v.label, v.p, v.x, b.e, {d} AS d FROM v JOIN b{k} b ON v.p = b.p) GROUP BY ALL)"

    def mean(k: int) -> str:
        return (
            f"m{k} AS (SELECT p, e, i, s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS y FROM (SELECT p, e, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL)),\n"
            f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS x FROM m{k} GROUP BY ALL) n ON n.p = b.p AND n.e = b.e)"
        )

    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS MATERIALIZED (SELECT vec_id, label, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS x FROM k, range(16) r(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 64),
b0 AS MATERIALIZED (SELECT v.p, f.e, v.x FROM v JOIN f USING (vec_id)),
{step(0)},
{mean(0)},
{step(1)},
{mean(1)},
{step(2)},
c AS (SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY ALL),
s AS (SELECT sha256(string_agg(y, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(x)::VARCHAR AS y, unnest(range(len(x))) AS i FROM b2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, s
"""


ORACLE = _oracle()
