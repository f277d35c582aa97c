"""Mixing sources to target weights: repetition rates from words per source, floor(rate) copies and one Bernoulli copy.

Sizes are summed by source before anything is joined, so a hot source costs a row a task. The Bernoulli draw of a
document is a slice of the SHA-256 of its id under one of eight seeds; for each source the seed is taken whose total
comes nearest to the target, so reruns agree and totals stay close. A document is never split.

Defined results: null text has size 0; null source is a source of its own, last in order; a source of size 0 has target 0
and takes nothing; repeated doc_ids draw alike, and rows without doc_id by their texts; an empty table gives an empty result; further
columns are ignored by mix() and kept by repeated(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
SEEDS = 8
#: Source tables of up to so many rows are broadcast after they have been counted; larger ones are joined by exchange.
BROADCAST_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("bigint")


def _draw(seed: int) -> Column:
    return F.conv(F.substring(F.col("_hash"), 8 * seed + 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """_key, source_size and target of each source; totals has _key, source, source_size. One row per source: small."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap)
    by_need = W.orderBy(F.col("cap") / F.col("weight"), F.col("_key"))
    before, every = by_need.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    s = s.withColumns({
        "left_share": share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("level", F.col("left_share") / F.col("left_weight"))
    # sources in order of cap / weight: those below the water level are full, the first that is not fixes the level
    full = F.col("cap") < F.col("level") * F.col("weight")
    s = s.withColumn("final", F.min(F.when(~full, F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    return s.select("_key", "source_size", F.when(full, F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, _size, _key, _hash and source of each row, and further columns. The caller's columns keep clear of these names in a struct."""
    return docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("_size"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_key"),
        F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text")), F.lit("")).cast("binary"), 256).alias("_hash"),
        *more,
    )


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """_key, source_size, target, rate and seed of each source."""
    totals = sized.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_size").alias("source_size"))
    rates = common.staged(targets(totals, weights, share, cap).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))), "mix-rates")
    frac = F.col("rate") - F.floor("rate")
    drawn = _with(sized.select("_key", "_size", "_hash"), rates.select("_key", "rate"))
    sums = drawn.groupBy("_key").agg(*(F.sum(F.when(_draw(k) < frac, F.col("_size")).otherwise(F.lit(0))).alias(f"t{k}") for k in range(SEEDS)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col("source_size") * F.floor("rate") + F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS))))["seed"]
    return common.staged(rates.join(sums, "_key").select("_key", "source_size", "target", "rate", best.alias("seed")), "mix-plan")


def _with(rows: DataFrame, sources: DataFrame) -> DataFrame:
    small = sources.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(sources) if small else sources, "_key")


def _taken() -> Column:
    """How often a row with its source's rate and seed is taken."""
    draws = F.element_at(F.array(*(_draw(k) for k in range(SEEDS))), F.col("seed") + 1)
    return (F.floor("rate") + (draws < F.col("rate") - F.floor("rate")).cast("bigint")).cast("bigint")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row."""
    sized = common.staged(_sized(docs), "mix-sizes")
    with_plan = _with(sized, plan(sized, weights, share, cap))
    return with_plan.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * _taken()).alias("taken"))


def repeated(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken (a row is at most ceil(cap) rows)."""
    # only narrow rows are kept: the texts are read once for the sums and once for the result
    narrow = common.staged(_sized(docs), "mix-sizes")
    with_plan = _with(_sized(docs, F.struct("*").alias("_own")), plan(narrow, weights, share, cap))
    out = with_plan.select("_own", _taken().cast("int").alias("_copies")).where("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_own.*")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir))


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL of mix() over a relation named `documents`."""
    draws = "\n".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) / 4294967296.0 AS u{k}," for k in range(SEEDS))
    sums = ", ".join(f"sum(CASE WHEN u{k} < rate - floor(rate) THEN size ELSE 0 END) AS t{k}" for k in range(SEEDS))
    offs = ", ".join(f"abs(source_size * floor(rate) + t{k} - target)" for k in range(SEEDS))
    return rf"""
WITH d0 AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce('s' || source, 'n') AS k, sha256(coalesce(CAST(doc_id AS VARCHAR), 'text ' || text, '')) AS h
  FROM {documents}),
d AS (SELECT {draws} doc_id, source, size, k FROM d0),
t AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, CAST([{', '.join(f'{w}.0' for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, {CAP}::DOUBLE * source_size AS cap FROM t),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap < level * weight AS is_full, (SELECT level FROM l WHERE NOT cap < level * weight ORDER BY cap / weight LIMIT 1) AS final FROM l),
r AS (SELECT k, source_size, CASE WHEN is_full THEN cap ELSE least(cap, final * weight) END AS target FROM f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM r),
s AS (SELECT q.k, source_size, target, rate, {sums} FROM d JOIN q USING (k) GROUP BY q.k, source_size, target, rate),
p AS (SELECT k, source_size, target, rate, list_position([{offs}], list_min([{offs}])) AS seed FROM s)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (floor(rate) + CASE WHEN [{', '.join(f'u{k}' for k in range(SEEDS))}][seed] < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p USING (k)
"""


ORACLE = oracle()
