"""Exact dedup against a persistent index of digests (DataFrame functions only).

The index is a Parquet table bucketed and sorted by digest. A batch of rows is reduced to one row per digest (map-side
partial aggregation, so a group of any size costs one row a task), and parted by a sort-merge anti-join with the index (bucketed
side: no exchange) into digests that are new and digests that it has. New ones are appended with their best row; of known ones the
number of further rows (and, where batches are parts of one table, their best row). A read sums up what stands for a digest, within its bucket. Texts are
never shuffled.

Defined results: null text counts as empty; empty texts form one group; of equal texts the one with most code
points in the original stays, then the smallest doc_id (null last), then any one row of equal rows; an empty table gives an
empty result; other columns of the input are ignored by dedup() and kept by survivors(), whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COLUMNS = "digest string, chars int, low bigint, low_row bigint, n_rows bigint"
#: Batches in which the query fills its index.
BATCHES = 2


class DigestIndex:
    """A bucketed table of digests at `path` (any place that all executors share); made where there is none."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, name: str | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        """digest, best (chars, low: minus the doc_id, low_row: minus the row) and n of every digest."""
        best = F.max(F.struct("chars", "low", "low_row")).alias("best")
        return self.spark.table(self.name).groupBy("digest").agg(best, F.sum("n_rows").alias("n"))

    def append(self, groups: DataFrame) -> None:
        """Adds digest, best and n of a batch; one file a bucket for each call."""
        groups.select("digest", "best.chars", "best.low", "best.low_row", "n").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.mode("append").insertInto(self.name)

    def forget(self) -> None:
        """Takes the table out of this session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, row (unique), chars, digest of every row, and further columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.length(text).alias("chars"),
        F.sha2(F.translate(text, common.SPACE, "").cast("binary"), 256).alias("digest"),
        *more,
    )


def _ingest(rows: DataFrame, index: DigestIndex, better: bool = False) -> DataFrame:
    """A written row per digest of a batch: digest, best, n, and what the index had (old_best, old_n; null: nothing). The index takes up
    new digests and the counts of known ones; their rows too, if better rows of later batches are to take the place of earlier ones."""
    best = F.max(F.struct("chars", (-F.col("doc_id")).alias("low"), (-F.col("row")).alias("low_row"))).alias("best")
    groups = rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n"))
    before = index.rows().select("digest", F.col("best").alias("old_best"), F.col("n").alias("old_n"))
    fresh = groups.join(before.select("digest").hint("merge"), "digest", "left_anti")
    known = groups.join(before.hint("merge"), "digest")
    judged = common.staged(fresh.unionByName(known, allowMissingColumns=True), "digest-groups")
    index.append(judged if better else judged.withColumn("best", F.when(F.col("old_n").isNull(), F.col("best"))))
    return judged


def dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256; the index takes up what is new.

    A digest that the index already had keeps no row of docs: keep_id is the indexed one's, and group_size counts its rows too."""
    rows = common.staged(digests(docs), "digests")
    judged = _ingest(rows, index).select("digest", F.coalesce("old_best", "best").alias("best"), F.col("old_n").isNull().alias("new"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"))
    return _result(rows, judged, F.col("new"))


def _result(rows: DataFrame, groups: DataFrame, may_stay) -> DataFrame:
    # both sides of this join are plain exchanges, so that adaptive execution splits the partition of a hot digest
    return rows.join(groups.hint("merge"), "digest").select(
        "doc_id",
        (-F.col("best.low")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (may_stay & (F.col("row") == -F.col("best.low_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def dedup_in_batches(docs: DataFrame, index: DigestIndex, batches: int = BATCHES) -> DataFrame:
    """As dedup() with an empty index, but docs comes in batches, each against what those before left in the index; best of all batches stays."""
    rows = common.staged(digests(docs), "digests")
    for k in range(batches):
        common.drop(_ingest(rows.where(F.pmod(F.xxhash64("doc_id", "row"), F.lit(batches)) == k), index, better=True))
    return _result(rows, common.staged(index.rows(), "digest-groups"), F.lit(True))


def survivors(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs that dedup() keeps, with all columns; docs is written once so that its row numbers hold."""
    # the caller's columns travel in one struct, so that no name of theirs meets one of ours
    marked = common.staged(digests(docs, F.struct("*").alias("own")), "dedup-input")
    kept = _ingest(marked.select("doc_id", "row", "chars", "digest"), index).where("old_n is null").select((-F.col("best.low_row")).alias("row"))
    return marked.select("row", "own").join(kept, "row", "left_semi").select("own.*")


def new_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    return DigestIndex(spark, f"{common.shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", buckets)


def op7_digest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = new_index(spark, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = dedup_in_batches(common.documents(spark, sf_dir).select("doc_id", "text"), index)
    index.forget()
    return out


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS place,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
