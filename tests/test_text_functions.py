import unicodedata

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import geometry as G
from pagelattice.functions import text as T
from pagelattice.operators import search


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def rule(q):
    out = []
    for i, c in enumerate(q):
        mark = unicodedata.category(c)[0] == "P"
        out.append((" " if mark and i else "") + c + (" " if mark and i < len(q) - 1 else ""))
    return "".join(out)


QUERIES = ["a.b", "a, b", "..", ".", "a-", "-a", " lead", "trail ", "ß", "", "(x)", "plain words"]


def test_clean_query(spark):
    assert column(spark, T.clean_query, QUERIES) == [rule(q) for q in QUERIES]
    assert [search.cleaned(q)[0] for q in QUERIES] == [rule(q) for q in QUERIES]
    assert column(spark, lambda c: T.word_count(T.clean_query(c)), QUERIES) == [search.cleaned(q)[1] for q in QUERIES]
    assert rule("a, b") == "a ,  b"  # two spaces: such a query can't match the index


@pytest.mark.parametrize("query", ["a.b", "The", "x+y", "\\E", "ß", "a, b"])
def test_search_by_brute_force(spark, query):
    texts = ["the cat . The THE", "a . b and a . b", "x + y x + y", "\\ E \\E", "straße ß", "", "a ,  b"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, page_no int, text string")
    q = rule(query).lower()
    want = []
    for i, t in enumerate(texts):
        at = t.lower().find(q)
        while at >= 0:
            want.append((i, at, t[:at].count(" "), t[max(0, at - 10) :][:40]))
            at = t.lower().find(q, at + len(q))
    assert sorted((r.page_no, r.char_pos, r.word_idx, r.sample) for r in search.search(df, query).collect()) == want


def test_empty_query(spark):
    df = spark.createDataFrame([(1, 1, "a")], "doc_id long, page_no int, text string")
    assert search.search(df, "").count() == 0


def test_character_tests(spark):
    words = ["", " ", "\t", " ", "\u0085", "a", ".", "..", "a.", " .", "«»"]
    assert column(spark, T.is_blank, words) == [not w.strip(" \t \u0085") for w in words]
    assert column(spark, T.links_to_nothing, words) == [True, True, True, True, True, False, True, True, False, False, True]


def test_labels_and_names(spark):
    assert column(spark, T.size_label, [0, 1, 999, 1000, 1023, 1024, 1536, 1_022_976, 1_048_576, -2048, 5 * 1024**4], "long") == ["0.0 bytes", "1.0 bytes", "999.0 bytes", "1.0 KB", "1.0 KB", "1.0 KB", "1.5 KB", "999.0 KB", "1.0 MB", "-2.0 KB", "5.0 TB"]
    assert column(spark, T.file_name, ["a/b:c?.pdf", "ok.pdf", "\x01"]) == ["a_b_c_.pdf", "ok.pdf", "_"]
    assert column(spark, T.openable, ["example.org", "https://x", "javascript:x", "mailto:a@b", "httpx", ""]) == ["http://example.org", "https://x", None, "mailto:a@b", None, None]
    assert column(spark, T.is_pdf, ["A.PDF", "a.pd", None]) == [True, False, None]


def test_pdf_dates(spark):
    raw = ["D:20240102030405+01'00'", "D:20240102030405Z", "D:20240102030405", "20240102030405-05'30", "D:2024", "soon", None]
    assert column(spark, T.pdf_date, raw) == ["2024-01-02 03:04:05 +01:00", "2024-01-02 03:04:05 +00:00", "2024-01-02 03:04:05 +00:00", "2024-01-02 03:04:05 -05:30", "D:2024", "soon", None]


def test_urls(spark):
    assert column(spark, T.url_of, ["see http://a.b.com:8080/x?y=1 or www.z.org", "www.x.io", "none", "ftp://a.bc/"]) == ["http://a.b.com:8080/x?y=1", "www.x.io", None, "ftp://a.bc/"]


def test_highest_one_bit(spark):
    n = list(range(-65536, 65537, 997)) + [0, 1, -1, 2**31 - 1, -(2**31)]
    assert column(spark, G.highest_one_bit, n, "int") == [(1 << ((x & 0xFFFFFFFF).bit_length() - 1)) if x else 0 for x in n]


def test_angles(spark):
    a = [0.0, 180.0, -180.0, 190.0, -190.0, 540.0, 725.0]
    assert column(spark, G.bound_180, a, "double") == [((x + 180) % 360) - 180 for x in a]
    assert column(spark, G.bound_360, a, "double") == [x % 360 for x in a]


def test_orientation(spark):
    rows = [(0, 0, 5, 0, 0.0), (0, 0, -5, 0, 0.0), (0, 0, 0, 5, 0.0), (0, 0, 0, -5, 0.0), (0, 0, 3, 3, 0.0), (1, 1, 1, 1, 90.0), (1, 1, 1, 1, 45.0)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double, d double, r double")
    assert [r[0] for r in df.select(G.orientation(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("r"))).collect()] == ["Horizontal", "Rotate180", "Rotate270", "Rotate90", "Other", "Rotate270", "Other"]


def test_path_keys_stay_in_one_line(spark):
    import base64

    paths = ["", "a", "/somewhere/" + "long/" * 40, "ä\\b" * 30]
    assert column(spark, T.path_key, paths) == [base64.b64encode(p.encode()).decode() for p in paths]


def test_equal_lines_of_no_length(spark):
    rows = [(0, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 2.0, 5.0, 2.0), (2, 0.5, 0.5, 0.5, 0.51)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, d double")
    line = tuple(map(F.col, "abcd"))
    for points, want in ((True, [(0.0, 1.0, 0.0, True)] * 3), (False, [(0.0, None, None, False), (0.0, 1.0, 0.0, True), (0.0, None, None, False)])):
        got = df.orderBy("i").select(*(c.alias(k) for k, c in G.line_pair(line, line, points=points).items())).collect()
        assert [tuple(r) for r in got] == want
