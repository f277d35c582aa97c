"""Nearest-neighbour joins within a page, as bucketed equi-joins and rank filters.

1-NN has a radius beyond which a link is refused anyway, so a grid of twice that size finds every link without a page-wide join; pivots
go to the one to four cells that they reach, candidates stay single. k-NN has no radius; it joins by rings of a grid whose cells grow for those that
aren't done.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import links_to_nothing
from ..session import shared_dir


def nearest(letters: DataFrame, radius: float, limit: Callable[[str, str], Column], distance=G.manhattan) -> DataFrame:
    """doc_id, page_no, seq, next, dist: each letter's link to its nearest letter, from its end point to the other's start point.

    letters: doc_id, page_no, orientation, seq, value, sx, sy, ex, ey, and what limit(a, b) reads. The nearest letter is chosen first;
    if it may not be linked (blank, punctuation, too far) there is no link: the next nearest is not tried."""
    # cells twice as wide as the radius: a candidate is in one, what a pivot reaches in at most two each way
    cell = lambda c, off=0.0: F.floor((F.col(c) + off) / (2 * radius)).cast("bigint")
    reach = lambda c: F.explode(F.array_distinct(F.array(cell(c, -radius), cell(c, radius))))
    a = letters.where(~links_to_nothing(F.col("value"))).withColumn("gx", reach("ex")).withColumn("gy", reach("ey")).alias("a")
    b = letters.withColumns({"gx": cell("sx"), "gy": cell("sy")}).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("doc_id", "page_no", "orientation", "gx", "gy")]
    pairs = a.join(b, [*on, F.col("a.seq") != F.col("b.seq")])
    dist = distance(F.col("a.ex"), F.col("a.ey"), F.col("b.sx"), F.col("b.sy"))
    w = W.partitionBy("doc_id", "page_no", "seq").orderBy("dist", "next")
    found = pairs.select(F.col("a.doc_id").alias("doc_id"), F.col("a.page_no").alias("page_no"), F.col("a.seq").alias("seq"), F.col("b.seq").alias("next"), dist.alias("dist"), (~links_to_nothing(F.col("b.value")) & (dist < limit("a", "b"))).alias("ok"))
    return found.withColumn("k", F.row_number().over(w)).where("k = 1 and ok").select("doc_id", "page_no", "seq", "next", "dist")


def letter_limit(a: str, b: str) -> Column:
    """Two letters link below a fifth of the larger of both widths and point sizes, twice that for slanted ones."""
    size = F.greatest(*(F.abs(F.col(f"{x}.{k}")) for x in (a, b) for k in ("width", "point_size")))
    slanted = (F.col(f"{a}.orientation") == "Other") | (F.col(f"{b}.orientation") == "Other")
    return 0.2 * size * F.when(slanted, 2.0).otherwise(1.0)


def k_nearest(points: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """keys, idx, other, dist: pairs at the k smallest distinct distances. points: keys, idx, and the pivot (px, py) and
    candidate (cx, cy) points.

    By rings of a grid: a pivot meets the candidates of its cell and the eight around. It is done once its k-th distance is no more than a
    cell's side, as nothing beyond can be nearer; the others go on with cells four times as wide, until a cell holds all. First cells are made
    for a few candidates each, by the middle halves of both coordinates, so far outliers don't widen them. A round is a written table."""
    spark = points.sparkSession
    base = f"{shared_dir(spark)}/nearest-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    number = lambda c: F.col(c).cast("double").alias(c)
    own = points.select(*keys, "idx", *map(number, ("px", "py", "cx", "cy"))).where("px is not null and py is not null and cx is not null and cy is not null")
    middle = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)))
    ends = [F.greatest(F.max(f"p{a}"), F.max(f"c{a}")) - F.least(F.min(f"p{a}"), F.min(f"c{a}")) for a in "xy"]
    sized = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), middle("cx").alias("mx"), middle("cy").alias("my"), F.greatest(*ends).alias("wide"))
    side = F.sqrt(4 * (F.col("mx")[1] - F.col("mx")[0]) * (F.col("my")[1] - F.col("my")[0]) / F.col("n"))
    side = F.when(side > F.col("wide") / 2**20, side).when(F.col("wide") > 0, F.greatest(F.col("wide") / F.col("n"), F.col("wide") / 2**20)).otherwise(1.0)
    cells = written(sized.select(*keys, side.alias("side"), "wide"), "cells")
    rounds = cells.agg(F.max(F.ceil(F.log2(F.greatest(F.col("wide") / F.col("side"), F.lit(1.0))) / 2)).alias("r")).head().r
    placed = written(own.join(cells, keys), "points")
    todo, out = placed, []
    for r in range((rounds or 0) + 2):
        width = F.col("side") * 4.0**r
        at = lambda c, move=0: F.floor(F.col(c) / width).cast("bigint") + move  # noqa: B023, E731
        around = F.explode(F.array(*(F.struct((at("px", i)).alias("gx"), at("py", j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("g")
        a = todo.select(*keys, "idx", "px", "py", "wide", width.alias("width"), around).select("*", "g.gx", "g.gy").drop("g").alias("a")
        b = placed.select(*keys, "idx", "cx", "cy", at("cx").alias("gx"), at("cy").alias("gy")).alias("b")
        on = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in (*keys, "gx", "gy")] + [F.col("a.idx") != F.col("b.idx")]
        dist = G.euclidean(F.col("px"), F.col("py"), F.col("cx"), F.col("cy"))
        pairs = a.join(b, on).select(*(F.col(f"a.{x}").alias(x) for x in keys), F.col("a.idx").alias("idx"), F.col("b.idx").alias("other"), "wide", "width", dist.alias("dist"))
        w = W.partitionBy(*keys, "idx")
        ranked = pairs.withColumn("_k", F.dense_rank().over(w.orderBy("dist"))).where(F.col("_k") <= k)
        last = F.max(F.when(F.col("_k") == k, F.col("dist"))).over(w)
        done = written(ranked.withColumn("_last", last).where((F.col("_last") <= F.col("width")) | (F.col("width") >= F.col("wide"))).select(*keys, "idx", "other", "dist"), f"round-{r}")
        out.append(done)
        todo = written(todo.where(F.col("side") * 4.0**r < F.col("wide")).join(done.select(*keys, "idx").distinct(), [*keys, "idx"], "left_anti"), f"left-{r}")
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def first_passing(pairs: DataFrame, keys: list[str], passing: Column) -> DataFrame:
    """Of each pivot's pairs the first, by distance and index, that passes."""
    w = W.partitionBy(*keys, "idx").orderBy("dist", "other")
    return pairs.where(passing).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
