"""Fill-in-middle transformation by DuckDB SQL over Arrow batches.

A text is cut into tokens (words of A-Z and a-z, or single other characters); two cuts that a hash of doc_id picks make prefix, middle and
suffix, which are written with markers, suffix first or prefix first. Each batch is registered with an in-memory DuckDB of one
thread inside mapInArrow and comes back as Arrow: no row passes through Python. Nothing is shuffled. Batches are cut so that
the texts of one SQL call hold about SLICE bytes, however long the batches of the scan are; one longer text is a call of its own.

Defined results: null text counts as empty; empty texts, texts that hold a marker and the share of hashes from `plain_from` on stay plain;
a null doc_id hashes as the empty string after the seed; equal rows have equal results; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of text of one SQL call: a list of tokens takes up to 16 bytes a character, and some lists stand at a time.
SLICE = 2 << 20


@dataclass(frozen=True)
class Options:
    """Percentages of the hash from which a text stays plain and below which the suffix comes first, the seed, and the markers."""

    plain_from: int = 90
    suffix_first_below: int = 20
    seed: str = "1:"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def transform_sql(o: Options, source: str = "docs") -> str:
    """doc_id, text, n, form, output, prefix_chars, middle_chars of the rows (doc_id, text) of `source`."""
    p, s, m = map(_quoted, (o.prefix, o.suffix, o.middle))
    number = lambda k: f"('0x' || substr(hash, {8 * k + 1}, 8))::UBIGINT"
    return rf"""
    WITH cut AS (
      SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256({_quoted(o.seed)} || coalesce(doc_id::VARCHAR, '')) AS hash
      FROM (SELECT doc_id, coalesce(text, '') AS text FROM {source})),
    drawn AS (
      SELECT *, len(tokens) AS n, {number(0)} % (len(tokens) + 1) AS c1, {number(1)} % (len(tokens) + 1) AS c2,
             CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {number(2)} % 100 >= {o.plain_from} THEN 'plain'
                  WHEN {number(3)} % 100 < {o.suffix_first_below} THEN 'spm' ELSE 'psm' END AS form
      FROM cut),
    parts AS (
      SELECT doc_id, text, n, form,
             array_to_string(list_slice(tokens, 1, least(c1, c2)::BIGINT), '') AS a,
             array_to_string(list_slice(tokens, least(c1, c2)::BIGINT + 1, greatest(c1, c2)::BIGINT), '') AS b,
             array_to_string(list_slice(tokens, greatest(c1, c2)::BIGINT + 1, n), '') AS c
      FROM drawn)
    SELECT doc_id, text, n::BIGINT AS n, form,
           CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || a || {s} || c || {m} || b ELSE {s} || c || {p} || a || {m} || b END AS output,
           CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars
    FROM parts"""


def restore_sql(o: Options, source: str = "fim", keep: str = "doc_id") -> str:
    """keep, and restored: the text, rebuilt from output and form of the rows of `source` alone. A part holds no marker, so each marker stands once."""
    p, s, m = map(_quoted, (o.prefix, o.suffix, o.middle))
    return f"""
    WITH two AS (
      SELECT {keep}, output, form, string_split(output, {m}) AS ends FROM {source}),
    three AS (
      SELECT *, CASE form WHEN 'psm' THEN string_split(substr(ends[1], {len(o.prefix) + 1}), {s}) WHEN 'spm' THEN string_split(substr(ends[1], {len(o.suffix) + 1}), {p}) END AS sides FROM two)
    SELECT {keep}, CASE form WHEN 'psm' THEN sides[1] || ends[2] || sides[2] WHEN 'spm' THEN sides[2] || ends[2] || sides[1] ELSE output END AS restored
    FROM three"""


def _by_batch(docs: DataFrame, column: str, statements: list[tuple[str, str]], result: str, schema: str) -> DataFrame:
    """docs through SQL by slices: `docs` is the slice, each statement makes a table for those after it, and `result` gives the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        base = duckdb.connect(":memory:", config={"threads": 1})
        for batch in common.slices(batches, column, SLICE, 50_000):
            base.register("docs", pa.Table.from_batches([batch]))
            for name, sql in statements:
                base.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS {sql}")
            yield from base.sql(result).to_arrow_table().combine_chunks().to_batches()
            for name, _ in statements:
                base.execute(f"DROP TABLE {name}")
            base.unregister("docs")

    return docs.mapInArrow(run, schema)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def transform(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """The operator's output: doc_id, n (tokens), form, output (the training text), prefix_chars, middle_chars of every row of docs."""
    sql = f"SELECT doc_id, n, form, output, prefix_chars, middle_chars FROM ({transform_sql(options)})"
    return _by_batch(_rows(docs), "text", [], sql, "doc_id bigint, n bigint, form string, output string, prefix_chars bigint, middle_chars bigint")


def restore(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id and text of rows (doc_id, form, output) that transform() gave with the same options."""
    sql = f"SELECT doc_id, restored AS text FROM ({restore_sql(options, 'docs')})"
    return _by_batch(rows.select("doc_id", "form", "output"), "output", [], sql, "doc_id bigint, text string")


def digests(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it, without sending either."""
    again = restore_sql(options, keep="doc_id, n, prefix_chars, middle_chars, output AS written, form AS kind")
    sql = f"SELECT doc_id, n, kind AS form, prefix_chars, middle_chars, sha256(written) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({again})"
    made = [("fim", f"SELECT doc_id, n, form, output, prefix_chars, middle_chars FROM ({transform_sql(options)})")]
    return _by_batch(_rows(docs), "text", made, sql, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))


# by lengths of parts in place of lists of tokens: what the cuts keep is a prefix, and the rest of the text, by position
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS k FROM d),
x AS (SELECT *, len(k) AS n, ('0x' || h[1:8])::BIGINT % (len(k) + 1) AS u, ('0x' || h[9:16])::BIGINT % (len(k) + 1) AS v,
             ('0x' || h[17:24])::BIGINT % 100 AS w, ('0x' || h[25:32])::BIGINT % 100 AS z FROM t),
y AS (SELECT *, CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR w >= 90 THEN 'plain' WHEN z < 20 THEN 'spm' ELSE 'psm' END AS form,
             coalesce(list_sum(list_transform(k[1:least(u, v)], lambda s: length(s))), 0)::BIGINT AS p,
             coalesce(list_sum(list_transform(k[1:greatest(u, v)], lambda s: length(s))), 0)::BIGINT AS q FROM x)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, p) || '<S>' || substr(text, q + 1) || '<M>' || substr(text, p + 1, q - p)
              ELSE '<S>' || substr(text, q + 1) || '<P>' || substr(text, 1, p) || '<M>' || substr(text, p + 1, q - p) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM y
"""
