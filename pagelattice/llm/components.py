"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014), as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """node, label: for each node of an edge the smallest node of its component. Each step is a written table."""
    hi_lo = lambda u, v: [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]
    now = common.staged(edges.where(F.col(a) != F.col(b)).select(*hi_lo(F.col(a), F.col(b))).distinct(), "cc")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        last, now = now, common.staged(small.where("u <> v").distinct(), "cc")
        common.drop(last)
        was, state = state, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if was == state:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    found = common.staged(out, "cc-labels")
    common.drop(now)
    return found


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (x, y): only the links between different components are worked on."""
    if labels is None:
        return components(links)
    to = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
    between = links.join(to("x"), "x", "left").join(to("y"), "y", "left").select(F.coalesce("lx", "x").alias("x"), F.coalesce("ly", "y").alias("y"))
    moved = components(between.where("x <> y").distinct())
    known = labels.select(F.col("node"), F.col("label").alias("node_")).join(moved.select(F.col("node").alias("node_"), F.col("label").alias("to")), "node_", "left").select("node", F.coalesce("to", "node_").alias("label"))
    # nodes that had no component are nodes of the links themselves
    fresh = moved.join(labels.select("node"), "node", "left_anti")
    out = common.staged(known.unionByName(fresh), "labels")
    common.drop(moved)
    return out
