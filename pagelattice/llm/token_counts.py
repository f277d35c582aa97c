"""Token counts by offset-mapped attribution.

Each document is encoded once, whole. The character spans of its tokens are joined by interval to its sections (or any fields with
character offsets), and each token is allocated by a rule that says what happens at boundaries:

* "first": a token belongs to the section that holds its first character;
* "most": to the section that holds most of its characters; of equals to the earliest, and to no section only if more characters are outside;
* tokens that no section gets count for section -1.

So the sections' counts and the rest always add up to the document's tokens. Spans and sections of a document are in one row, both in
order, so the join is a binary search within a slice of rows and nothing is shuffled. A token that is a part of a character spans
that character.

Sections are a column of spans, or the sentences of a text: one ends after a line feed, and after a space that follows one of . ! ? (this
vocabulary puts the space before a word into the word's token, so most borders of sentences stand inside a token).

Defined results: null and empty texts have no tokens and no section; a text without a sentence's end is one section; repeated rows are
counted alike; an empty table gives an empty result; other columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from . import hashing as hs
from .pair_bpe import Codec, codec

#: Bytes of text that a worker holds at a time.
SLICE = 4 << 20


def spans(of: Codec, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts end to end: first and last character of each token, where the tokens of each text begin, and its characters."""
    data, at = hs.flat(texts)
    e = of.slice(texts)
    sizes = np.zeros(max(of.bytes_of) + 1, np.int64)
    sizes[list(of.bytes_of)] = [len(b) for b in of.bytes_of.values()]
    ends = np.cumsum(sizes[e.ids])
    first, last = ends - sizes[e.ids], ends - 1
    if len(data) and data.max() >= 128:  # from bytes to characters
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        first, last = char[first], char[last]
        at = np.append(char, char[-1] + 1)[at] if len(char) else at
    return first, last, e.at, at


def sentences(texts: pa.Array | list) -> np.ndarray:
    """The characters, of all texts end to end, at which sentences begin; texts begin one too, unless they are empty."""
    data, at = hs.flat(texts)
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    stop = np.isin(data, [ord(c) for c in ".!?"])
    cut[1:] |= data == 10
    if len(data):
        cut[2:] |= stop[:-1] & (data[1:] == 32) & ~cut[1:-1]  # a space that another text begins with ends nothing
    if len(data) and data.max() >= 128:
        cut = cut[:-1][(data & 0xC0) != 0x80]
        return np.flatnonzero(cut)
    return np.flatnonzero(cut[:-1])


def allocate(first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none) and whether it goes over a boundary. Sections don't overlap and rise."""
    if rule not in ("first", "most"):
        raise ValueError(f"no such rule: {rule}")
    if not len(begin):
        return np.full(len(first), -1), np.zeros(len(first), bool)
    # a token meets the sections from lo to hi - 1
    lo, hi = np.searchsorted(end, first, side="right"), np.searchsorted(begin, last, side="right")
    inside = (hi - lo == 1) & (begin[np.minimum(lo, len(begin) - 1)] <= first) & (last < end[np.minimum(lo, len(end) - 1)])
    crossing = ~inside & (hi > lo)
    k = np.minimum(lo, len(begin) - 1)
    who = np.where((lo < len(begin)) & (begin[k] <= first), lo, -1)
    if rule == "most":
        t = np.flatnonzero(crossing)
        n = hi[t] - lo[t]
        token = np.repeat(t, n)
        section = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[t], n)
        held = np.minimum(end[section], last[token] + 1) - np.maximum(begin[section], first[token])
        best = np.lexsort((section, -held, token))  # of each token's sections the one that holds most comes first
        best = best[np.concatenate(([0], np.cumsum(n)[:-1]))] if len(t) else best
        outside = last[t] + 1 - first[t] - np.bincount(token, held, len(first))[t]
        who[t] = np.where(outside > held[best], -1, section[best])
    return who, crossing


def attribute(docs: DataFrame, path: str, rule: str = "first", sections: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, n_outside, section_tokens (tokens of each section) of each row.

    sections: a column of array<struct<start,end>> in characters, rising and without overlap; by default a text's sentences."""
    counts = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()), ("n_outside", pa.int64()), ("section_tokens", counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", SLICE):
            texts = batch.column("text")
            first, last, at, chars = spans(codec(path), texts)
            if sections:  # spans past a text's end hold nothing there
                given, size = batch.column("sections").to_pylist(), np.diff(chars).tolist()
                n = np.array([len(g or []) for g in given], np.int64)
                begin, end = (np.array([min(x[k], m) + a for g, m, a in zip(given, size, chars.tolist(), strict=False) for x in g or []], np.int64) for k in ("start", "end"))
            else:
                begin = sentences(texts)
                end = np.append(begin[1:], chars[-1]) if len(begin) else begin
                n = np.diff(np.searchsorted(begin, chars))
            who, crossing = allocate(first, last, begin, end, rule)
            sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at])
            held = np.bincount(who[who >= 0], minlength=len(begin))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(held, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(n), pa.array(sums(crossing), pa.int64()), pa.array(sums(who < 0), pa.int64()), lists], schema=schema)

    columns = ["cast(doc_id as bigint) doc_id", "text", *([f"{sections} as sections"] if sections else [])]
    return docs.selectExpr(*columns).mapInArrow(run, "doc_id bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, n_outside bigint, section_tokens array<int>")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return attribute(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), "most")
