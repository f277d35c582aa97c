"""Letters, words and pages of plain texts, on a fixed grid: 80 columns, 20 rows a page, cell 6 x 14, letters 10 high.

Texts are cut into pages and rows by arithmetic on positions, and rows into words by a regular expression; all of that happens
within a row of the input, so nothing is shuffled, and a page, not a text, is the unit of what follows.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import SPACE
from ..operators.together import Packed

COLUMNS, ROWS = 80, 20
CELL, PITCH, HEIGHT, POINT = 6, 14, 10, 10.0
#: Pages that are cut into words at a time.
SLICE = 512
#: Pages whose letters are made at a time.
SHEETS = 32


def pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, page_no (from 1), rows (strings of up to 80 characters); empty and null texts have no page."""
    size = COLUMNS * ROWS
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.ceil(F.length(t) / size).cast("int")
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(t, i * size + 1, F.lit(size))))
    paged = docs.select(F.col(key).alias("doc_id"), F.posexplode(cut).alias("p", "page"))
    lines = F.ceil(F.length("page") / COLUMNS).cast("int")
    rows = F.transform(F.sequence(F.lit(0), lines - 1), lambda r: F.substr(F.col("page"), r * COLUMNS + 1, F.lit(COLUMNS)))
    return paged.select("doc_id", (F.col("p") + 1).alias("page_no"), rows.alias("rows"))


def letters(paged: DataFrame) -> DataFrame:
    """A row for each character but line feeds: doc_id, page_no, seq, c, r, value."""
    rows = paged.select("doc_id", "page_no", F.posexplode("rows").alias("r", "row"))
    found = rows.select("doc_id", "page_no", "r", F.posexplode(F.split("row", "")).alias("c", "value"))
    return found.where("value <> '\n' and value <> ''").select("doc_id", "page_no", (F.col("r") * COLUMNS + F.col("c")).alias("seq"), "c", "r", "value")


def cut_letters(rows: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """letters() of pages, given their rows, by array steps: page, r, c and value."""
    lines = rows.flatten()
    per_page = pc.fill_null(pc.list_value_length(rows), 0).to_numpy().astype(np.int64)
    sizes = pc.fill_null(pc.binary_length(lines), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    b = np.frombuffer(b"".join(pc.fill_null(lines, "").cast(pa.binary()).to_pylist()), np.uint8)
    lead, size = _characters(b)
    line = np.searchsorted(ends, lead, "right")
    first = np.searchsorted(lead, ends - sizes)
    page = np.repeat(np.arange(len(rows)), per_page)
    r = np.arange(len(page)) - np.repeat(np.cumsum(per_page) - per_page, per_page)
    shown = b[lead] != 10
    at = np.flatnonzero(shown)
    of = line[at]
    offsets = np.concatenate(([0], np.cumsum(size[at]))).astype(np.int32)
    value = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(b[np.repeat(shown, size)].tobytes()))
    return page[of], r[of], at - first[of], value


def packed(paged: DataFrame, draw: Callable[[np.ndarray, np.ndarray, np.ndarray, pa.StringArray], dict], columns: str) -> Packed:
    """Letters of pages made within the workers, some pages at a time: doc_id, page_no and what draw(doc_id, r, c, value) makes of them, in order of
    r and c; it may name as `of` the letter of each of its rows. columns: names and types of what it makes."""
    own = ", ".join(f"`{k}` {paged.schema[k].dataType.simpleString()}" for k in ("doc_id", "page_no"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SHEETS):
                some = batch.slice(a, SHEETS)
                page, r, c, value = cut_letters(some.column(2))
                made = draw(some.column(0).take(pa.array(page)), r, c, value)
                page = page[made.pop("of")] if "of" in made else page
                heads = {k: some.column(n).take(pa.array(page)) for n, k in enumerate(("doc_id", "page_no"))}
                yield pa.RecordBatch.from_pydict(heads | made)

    return Packed(paged.select("doc_id", "page_no", "rows"), unpack, StructType.fromDDL(f"{own}, {columns}"))


def word_values(paged: DataFrame) -> DataFrame:
    """doc_id, page_no, values: the words of each page alone, which is all that page text needs."""
    edge = f"[{SPACE}\\p{{P}}]"
    parts = F.flatten(F.transform("rows", lambda row: F.split(row, f"(?={edge})|(?<={edge})")))
    return paged.select("doc_id", "page_no", F.filter(parts, lambda w: ~w.rlike(f"^[{SPACE}]*$")).alias("values"))


def words(paged: DataFrame) -> DataFrame:
    """doc_id, page_no, words: array of (r, c, value) in reading order, blanks left out, each punctuation mark a word.

    On this grid these are the words of nearest-neighbour grouping: neighbours in a row touch, others are too far. Pages come in Arrow batches
    and are cut some at a time by array steps, so work and memory grow with the characters alone."""
    keys = [f"`{k}` {paged.schema[k].dataType.simpleString()}" for k in ("doc_id", "page_no")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                some = batch.slice(a, SLICE)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), cut_words(some.column(2))], ["doc_id", "page_no", "words"])

    return paged.select("doc_id", "page_no", "rows").mapInArrow(run, ", ".join(keys) + ", words array<struct<r:int,c:int,value:string>>")


def cut_words(rows: pa.ListArray) -> pa.ListArray:
    """The words of pages, given their rows."""
    lines = rows.flatten()
    per_page = pc.fill_null(pc.list_value_length(rows), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(pc.fill_null(pc.binary_length(lines), 0).to_numpy().astype(np.int64))
    b = np.frombuffer(b"".join(pc.fill_null(lines, "").cast(pa.binary()).to_pylist()), np.uint8)
    lead, size = _characters(b)
    line = np.searchsorted(ends, lead, "right")
    first = np.searchsorted(lead, ends - np.diff(ends, prepend=0))  # the first character of each line, or the next line's
    at, value = _cut(b, lead, size, line)
    page = np.repeat(np.arange(len(rows)), per_page)
    r = np.arange(len(page)) - np.repeat(np.cumsum(per_page) - per_page, per_page)
    of = line[at]
    n = np.concatenate(([0], np.cumsum(np.bincount(page[of], minlength=len(rows))))).astype(np.int32)
    fields = [pa.array(r[of].astype(np.int32)), pa.array((at - first[of]).astype(np.int32)), value]
    return pa.ListArray.from_arrays(pa.array(n), pa.StructArray.from_arrays(fields, ["r", "c", "value"]))


def cut_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """The words of whole texts (null: empty), as words() has them on all pages: the text, the row within the text, and the value of each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    b = np.frombuffer(b"".join(pc.fill_null(texts, "").cast(pa.binary()).to_pylist()), np.uint8)
    lead, size = _characters(b)
    text = np.searchsorted(ends, lead, "right")
    first = np.searchsorted(lead, ends - np.diff(ends, prepend=0))
    row = (np.arange(len(lead)) - first[text]) // COLUMNS
    at, value = _cut(b, lead, size, text * (row.max(initial=0) + 1) + row)
    return text[at], row[at], value


def _characters(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of first bytes of characters in UTF-8, and the characters' sizes."""
    lead = np.flatnonzero((b & 0xC0) != 0x80)
    return lead, np.diff(np.append(lead, len(b)))


def _cut(b: np.ndarray, lead: np.ndarray, size: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """The first character of each word, and the words, given the line of each character."""
    kind = _kinds()[_code_points(b, lead, size)]
    begins = np.concatenate(([True], line[1:] != line[:-1]))[: len(lead)]
    before = np.concatenate(([_BLANK], kind[:-1]))[: len(lead)]
    new = (kind != _BLANK) & (begins | (kind == _MARK) | (before != _PLAIN))
    at = np.flatnonzero(new)
    shown = kind != _BLANK
    place = np.cumsum(new[shown]) - 1
    offsets = np.concatenate(([0], np.cumsum(np.bincount(place, size[shown], len(at))))).astype(np.int32)
    return at, pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(b[np.repeat(shown, size)].tobytes()))


def _code_points(b: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The characters of UTF-8, given the places of their first bytes and their sizes."""
    code = (b[lead] & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], np.uint8)[np.minimum(size, 4)]).astype(np.int64)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        code[longer] = code[longer] << 6 | (b[lead[longer] + k] & 0x3F)
    return np.minimum(code, sys.maxunicode)


_PLAIN, _MARK, _BLANK = 0, 1, 2


@functools.cache
def _kinds() -> np.ndarray:
    """Of each character: plain, a punctuation mark, or blank as SPACE has it."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for k in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(k))[0]
        out[k] = _MARK if kind == "P" else _BLANK if kind == "Z" else _PLAIN
    out[[*map(ord, " \t\n\x0b\f\r\x85")]] = _BLANK
    return out


def word_rows(worded: DataFrame) -> DataFrame:
    """words() a row a word, with its ordinal and box (left, top, right, bottom)."""
    w = worded.select("doc_id", "page_no", F.posexplode("words").alias("word_idx", "w"))
    n = F.length("w.value")
    return w.select(
        "doc_id", "page_no", "word_idx", F.col("w.value").alias("value"), n.alias("n_letters"), F.col("w.r").alias("r"),
        (F.col("w.c") * CELL).cast("double").alias("left"), (F.col("w.r") * PITCH - HEIGHT).cast("double").alias("top"),
        ((F.col("w.c") + n) * CELL).cast("double").alias("right"), (F.col("w.r") * PITCH).cast("double").alias("bottom"),
    )


def boxed(worded: DataFrame) -> DataFrame:
    """words() with the box of each word in its struct: (value, r, left, top, right, bottom)."""

    def box(w):
        n = F.length(w["value"])
        number = lambda c, name: c.cast("double").alias(name)
        return F.struct(w["value"].alias("value"), w["r"].alias("r"), number(w["c"] * CELL, "left"), number(w["r"] * PITCH - HEIGHT, "top"), number((w["c"] + n) * CELL, "right"), number(w["r"] * PITCH, "bottom"))

    return once(worded.withColumn("words", F.transform("words", box)), "words")


def once(df: DataFrame, column: str) -> DataFrame:
    """df with a column that is worked out once a row, however often it is used: a generator stands between, which plans don't merge across."""
    return df.select(*(F.explode(F.array(F.col(c))).alias(c) if c == column else F.col(c) for c in df.columns))


def line_boxes(paged: DataFrame) -> DataFrame:
    """pages() with `lines`: (line_idx, left, top, right, bottom) of each row of the grid that has words, from its first to its last letter."""

    def box(row, r):
        number = lambda c, name: c.cast("double").alias(name)
        first = F.length(row) - F.length(F.regexp_replace(row, f"^[{SPACE}]+", ""))
        end = F.length(F.regexp_replace(row, f"[{SPACE}]+$", ""))
        return F.struct(r.alias("line_idx"), number(first * CELL, "left"), number(r * PITCH - HEIGHT, "top"), number(end * CELL, "right"), number(r * PITCH, "bottom"))

    return once(paged.withColumn("lines", F.filter(F.transform("rows", box), lambda a: a["left"] < a["right"])), "lines")
