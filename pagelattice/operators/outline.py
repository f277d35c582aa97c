"""Outline trees as adjacency rows: made of headings, and flattened with depth and path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def from_headings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """doc_id, node_id, parent_id, ord, level, title of the headings of web pages: the parent is the nearest heading of a lower
    level before it. Found within the row, without a shuffle."""
    tags = F.regexp_extract_all(html, F.lit(r"(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>"), 0)
    node = lambda t, i: F.struct(i.alias("i"), F.regexp_extract(t, r"<h([1-6])", 1).cast("int").alias("level"), F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)^<h[1-6][^>]*>|</h[1-6]>$", ""), r"<[^>]*>", "")).alias("title"))
    nodes = pages.select(F.col(key).alias("doc_id"), F.transform(tags, node).alias("ns"))
    flat = nodes.select("doc_id", "ns", F.explode("ns").alias("n"))
    parent = F.array_max(F.transform(F.filter("ns", lambda m: (m["i"] < F.col("n.i")) & (m["level"] < F.col("n.level"))), lambda m: m["i"]))
    sibling = F.size(F.filter("ns", lambda m: m["i"] < F.col("n.i")))
    return flat.select("doc_id", F.col("n.i").alias("node_id"), parent.alias("parent_id"), sibling.alias("ord"), F.col("n.level").alias("level"), F.col("n.title").alias("title"))


def walk(nodes: list, parents: list) -> list[tuple[int, list] | None]:
    """Depth and path of ids of each node; None for what hangs on no root. Any depth, in any order."""
    place = {n: i for i, n in enumerate(nodes)}
    out: list[tuple[int, list] | None] = [None] * len(nodes)
    done = [False] * len(nodes)
    for i in range(len(nodes)):
        up, k, seen = [], i, set()
        while k is not None and not done[k] and k not in seen:
            seen.add(k)
            up.append(k)
            k = None if parents[k] is None else place.get(parents[k], -1)
            if k == -1:
                break
        root = k is None
        base = out[k] if k not in (None, -1) and done[k] else None
        for j in reversed(up):
            if root or base:
                base = (base[0] + 1, [*base[1], nodes[j]]) if base else (0, [nodes[j]])
                out[j] = base
            done[j] = True
    return out


def flatten(outline: DataFrame) -> DataFrame:
    """outline (doc_id, node_id, parent_id, title, ...) with depth from 0 and path of node ids.

    One exchange: the nodes of a document are walked together. Nodes that hang on no root (a missing parent, a circle) go."""
    more = T.StructType(outline.schema.fields + [T.StructField("depth", T.IntegerType()), T.StructField("path", T.ArrayType(outline.schema["node_id"].dataType))])

    def walked(t: pa.Table) -> pa.Table:
        docs, node = t["doc_id"].to_pylist(), t.schema.field("node_id").type
        keys = list(zip(docs, t["node_id"].to_pylist(), strict=True))
        found = walk(keys, [None if p is None else (d, p) for d, p in zip(docs, t["parent_id"].to_pylist(), strict=True)])
        kept = [x is not None for x in found]
        t = t.append_column("depth", pa.array([x and x[0] for x in found], pa.int32())).append_column("path", pa.array([x and [n for _, n in x[1]] for x in found], pa.list_(node)))
        return t.filter(pa.array(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last document's rows, which may go on in the next batch
        for batch in batches:
            now = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, now]) if held is not None else now
            docs = t["doc_id"].to_pylist()
            at = len(docs)
            while at and docs[at - 1] == docs[-1]:
                at -= 1
            if at:
                yield from walked(t.slice(0, at)).to_batches()
            held = t.slice(at)
        if held is not None:
            yield from walked(held).to_batches()

    return outline.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, more)
