import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from pagelattice.operators import lookup, selection
from pagelattice.plans import catalog
from pagelattice.sources import letters as L

TEXTS = ["", None, "a", " \n\t ", "one, two. three", "(é)–ß 𝔘x, 日本。語　b\u0085c", "x" * 81 + ".", "word " * 700, "in. the.", "\x0b\x1c​-"]


def documents(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_cut_by_arrays():
    blank = lambda c: c in " \t\n\x0b\f\r\x85" or unicodedata.category(c)[0] == "Z"
    pages = [[], [""], *([t[a : a + 80] for a in range(0, len(t), 80)] for t in TEXTS if t), ["", "a b", ".", ""]]
    want = []
    for rows in pages:
        found = []
        for r, row in enumerate(rows):
            shape = "".join(" " if blank(c) else "." if unicodedata.category(c)[0] == "P" else "x" for c in row)
            found += [{"r": r, "c": m.start(), "value": row[m.start() : m.end()]} for m in re.finditer(r"x+|\.", shape)]
        want.append(found)
    rows = pa.array(pages, pa.list_(pa.string()))
    assert L.cut_words(rows).to_pylist() == want
    assert L.cut_words(rows.slice(3, 4)).to_pylist() == want[3:7]
    assert L.cut_words(rows.slice(0, 0)).to_pylist() == []


def test_clicks_in_row(spark):
    paged = L.pages(documents(spark))
    words = L.word_rows(L.words(paged)).withColumns({"line_idx": F.col("r"), "block_idx": F.lit(0)})
    at = words.where("word_idx = 7").select("doc_id", "page_no", "word_idx")
    got = selection.by_clicks_in_row(L.words(paged), F.array(*map(F.lit, (2, 3, 4))), F.lit(7))
    assert "Exchange" not in plan(got)
    want = [(r.doc_id, r.page_no, r.word_idx, k, r.value) for k in (2, 3, 4) for r in selection.by_clicks(words, k, at).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_clicks_query_has_no_shuffle_by_page(spark):
    assert "hashpartitioning" not in plan(catalog.QUERIES["clicked_words"](spark, "/root/testdata/sf0.001"))


def test_lines_in_row(spark):
    paged = L.pages(documents(spark))
    got = lookup.lines_in_row(L.boxed(L.words(paged)))
    assert "Exchange" not in plan(got)
    want = lookup.lines(L.word_rows(L.words(paged)).withColumnRenamed("r", "line_idx"))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_selections_in_row(spark):
    whole = (selection.END, selection.END, -1, 1, 0, -1)
    parts = [whole, (1, 1, 1, 1, 0, 0), (1, 2, -1, 2, 3, 1), (2, 0, 9, 1, 1, 0), (1, 0, 1, 1, 0, 1), (5, 0, 0, 6, 0, 0), (1, None, 0, 2, 0, 0)]
    texts = [*TEXTS, "a well-\n" + " " * 72 + "known (thing)" + " x_" * 700, "$5 -·b« c»"]
    rows = [(i * len(parts) + k, t, *p) for i, t in enumerate(texts) for k, p in enumerate(parts)]
    names = [f"{k}_{x}" for k in ("anchor", "focus") for x in ("page", "word", "off")]
    picked = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    words = L.word_rows(L.words(L.pages(picked))).withColumnRenamed("r", "line_idx")
    tokens = selection.selected_words(picked.drop("text"), words)
    for got, want in ((selection.spaced_in_row(picked), selection.spaced(tokens)), (selection.text_in_row(picked), selection.selection_text(tokens))):
        assert "Exchange" not in plan(got)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
