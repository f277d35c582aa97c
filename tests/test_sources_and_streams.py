import datetime as dt
import random
import zlib

from pagelattice.operators import outline
from pagelattice.sources import pdf, settings
from pagelattice.streaming import live, ordered


def make_pdf(flate=True):
    content = b"q BT /F1 10 Tf 1 0 0 1 72 700 Tm (Hi \\(x\\)) Tj 0 -14 Td [(A) -500 (B)] TJ T* (e) Tj ET Q 1 0 0 rg 0 0 5 5 re f /X1 Do"
    body = zlib.compress(content) if flate else content
    form = b"BT /F1 10 Tf 72 600 Td (Z) Tj ET"
    objs = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 8 0 R /Names << /EmbeddedFiles << /Names [(n) 11 0 R] >> >> >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        3: b"<< /Type /Page /Parent 2 0 R /CropBox [0 0 600 780] /Rotate 90 /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /X1 13 0 R >> >> /Annots [6 0 R 7 0 R] >>",
        4: b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if flate else b"", body),
        5: b"<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [" + b" ".join(b"600" for _ in range(95)) + b"] >>",
        6: b"<< /Type /Annot /Subtype /Link /Rect [10 10 60 20] /A << /S /URI /URI (http://a.b) >> >>",
        7: b"<< /Type /Annot /Subtype /Text /Rect [0 0 5 5] /Contents (note) /M (D:20240102030405Z) >>",
        8: b"<< /First 9 0 R >>",
        9: b"<< /Title (One) /Dest [3 0 R /XYZ 0 700 0] /First 10 0 R >>",
        10: b"<< /Title <FEFF00E9> >>",
        11: b"<< /F (data.txt) /EF << /F 12 0 R >> >>",
        12: b"<< /Length 5 >>\nstream\nhello\nendstream",
        13: b"<< /Type /XObject /Subtype /Form /Length %d >>\nstream\n%s\nendstream" % (len(form), form),
        14: b"<< /Title (T) /Author (A) >>",
    }
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objs.items())
    return out + b"trailer\n<< /Root 1 0 R /Info 14 0 R >>\n%%EOF"


def test_pdf_tables(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make_pdf())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "B.PDF").write_bytes(make_pdf(flate=False))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    (tmp_path / "locked.pdf").write_bytes(make_pdf().replace(b"/Info 14 0 R", b"/Encrypt 14 0 R"))
    (tmp_path / "x.txt").write_bytes(b"no")
    get = lambda t: pdf.read(spark, str(tmp_path), t)
    found = get("letters").where("path like '%a.pdf'").orderBy("seq").collect()
    assert "".join(r.value for r in found) == "Hi (x)ABeZ"
    h = found[0]
    assert (h.bl_x, h.bl_y, h.br_x, h.point_size) == (144.0, 160.0, 156.0, 20.0) and h.tl_y < h.bl_y
    assert found[7].bl_x - found[6].br_x == 10.0 and found[6].text_sequence == found[7].text_sequence
    assert get("letters").count() == 20
    p = get("pages").first()
    assert (p.width, p.height, p.rotation) == (1200.0, 1560.0, 90)
    a = get("annotations").where("path like '%a.pdf'").orderBy("ord").collect()
    assert (a[0].is_link, a[0].uri, a[0].width, a[1].content) == (True, "http://a.b", 100.0, "note")
    o = get("outline").where("path like '%a.pdf'").orderBy("node_id").collect()
    assert [(r.title, r.parent_id, r.page_no, r.offset_y) for r in o] == [("One", None, 1, 1400.0), ("é", 0, None, None)]
    assert get("attachments").first().data == b"hello"
    assert get("properties").first().others == {"Title": "T", "Author": "A"}
    assert sorted(r.path.rsplit("/", 1)[1] for r in get("errors").collect()) == ["bad.pdf", "locked.pdf"]


def test_settings(spark):
    df = spark.createDataFrame([('{"Width": 5, "PaneSize": -1, "Debug": {"Fps": true}}',), ("broken",), ('{"Height": 0, "IsMaximised": true}',)], "j string")
    rows = settings.parse(df, "j").collect()
    assert [(r.width, r.height, r.is_maximised, r.pane_size, r.reset) for r in rows] == [(5, 500, False, 350, False), (1000, 500, False, 350, True), (1000, 500, True, 350, False)]
    assert rows[0].debug.Fps is True
    names = spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf"), (3, "b"), (4, "a.pdf"), (5, "b")], "ord int, name string")
    assert {r.ord: r.stored for r in settings.distinct_names(names, "name").collect()} == {1: "a.pdf", 2: "a.1.pdf", 3: "b", 4: "a.2.pdf", 5: "b.1"}


def test_outline(spark):
    html = "<h1>A</h1><h2>B <i>x</i></h2><h3>C</h3><h2>D</h2><h1>E</h1>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>")], "page_id long, html string")
    flat = outline.flatten(outline.from_headings(df)).orderBy("node_id").collect()
    assert [(r.title, r.parent_id, r.depth) for r in flat] == [("A", None, 0), ("B x", 0, 1), ("C", 1, 2), ("D", 0, 1), ("E", None, 0)]


def by_rule(notes, seconds):
    last, out = {}, []
    for k, ts, i, m in sorted(notes, key=lambda n: (n[1], n[2])):
        if k in last and last[k][0] == m and (ts - last[k][1]).total_seconds() < seconds:
            continue
        last[k] = m, ts
        out.append((k, i))
    return sorted(out)


def test_suppression(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda s: t + dt.timedelta(seconds=s)
    burst = [("k", at(0), 1, "A"), ("k", at(1), 2, "A"), ("k", at(2), 3, "B"), ("k", at(2.5), 4, "A"), ("k", at(6), 5, "A")]
    rng = random.Random(1)
    notes = burst + [(f"r{rng.randint(0, 3)}", at(rng.randint(0, 400) / 4), i, rng.choice("AB")) for i in range(10, 200)]
    notes += [("hot", at(i / 2), 1000 + i, "A" if i % 50 else "B") for i in range(600)]
    df = spark.createDataFrame(notes, "key string, ts timestamp, id long, message string")
    for span in (86400.0, 7.0, 1.0):  # bursts reach over many spans
        assert sorted((r.key, r.id) for r in ordered.suppressed_batch(df, span=span).collect()) == by_rule(notes, 3)
    assert ordered.suppressed_batch(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, at(0), 1, "A"), (None, at(1), 2, "A"), ("k", at(0), 3, None), ("k", at(1), 4, None)], df.schema)
    assert sorted(r.id for r in ordered.suppressed_batch(odd).collect()) == [1, 3, 4]  # nothing is known to repeat a null


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the cat {i} saw The dog") for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/docs")
    hits = live.live_search(live.documents(spark, f"{tmp_path}/docs", "doc_id long, text string", files=1), "the")
    live.start(hits, f"{tmp_path}/hits", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/hits").count() == 40
    paths = spark.createDataFrame([("a.pdf",), ("a.pdf",), ("b.PDF",), ("c.txt",)], "path string")
    paths.repartition(2).write.parquet(f"{tmp_path}/paths")
    live.start(live.opened(live.documents(spark, f"{tmp_path}/paths", "path string")), f"{tmp_path}/open", f"{tmp_path}/c2").awaitTermination()
    assert sorted(r.path for r in spark.read.parquet(f"{tmp_path}/open").collect()) == ["a.pdf", "b.PDF"]
    spark.createDataFrame([(2, 0, False), (1, 3, False), (1, 0, False), (0, 0, True)], "page_no int, type int, cancelled boolean").coalesce(1).write.parquet(f"{tmp_path}/req")
    seen = []
    live.in_order(live.documents(spark, f"{tmp_path}/req", "page_no int, type int, cancelled boolean"), lambda df, _: seen.extend((r.page_no, r.type) for r in df.collect()), f"{tmp_path}/c3").awaitTermination()
    assert seen == [(1, 0), (1, 3), (2, 0)]


def test_outline_of_any_depth_and_order():
    n = 3000
    nodes, parents = list(range(n)), [None, *range(n - 1)]
    found = outline.walk(nodes[::-1], parents[::-1])
    assert found[0][0] == n - 1 and found[0][1] == nodes and found[-1] == (0, [0])
    assert outline.walk([1, 2, 3, 4, 5], [None, 9, 4, 3, 1]) == [(0, [1]), None, None, None, (1, [1, 5])]


def test_names_that_are_free(spark):
    names = spark.createDataFrame([(1, "a.pdf"), (2, "a.1.pdf"), (3, "a.pdf"), (4, "a.pdf"), (5, "a.3.pdf"), (6, "a.pdf"), (7, None), (8, "b.1"), (9, "b")], "ord int, name string")
    got = {r.ord: r.stored for r in settings.distinct_names(names, "name").collect()}
    assert got == {1: "a.pdf", 2: "a.1.pdf", 3: "a.2.pdf", 4: "a.4.pdf", 5: "a.3.pdf", 6: "a.5.pdf", 7: None, 8: "b.1", 9: "b"}


def test_frames(spark):
    key = b"key"
    frame = lambda body, kind=1, k=key, size=None: bytes([(size or len(body)) % 256, (size or len(body)) // 256]) + k + bytes([kind]) + body
    long = ("/p/é" + "x" * 400).encode()
    data = [(1, frame(b"/a.pdf")), (2, frame(long)), (3, frame(b"/a", k=b"kex")), (4, frame(b"")), (5, frame(b"/a", size=9)), (6, frame(b"\x01", 2)), (7, frame(b"/a", 7)), (8, None), (9, b"\x01")]
    out = {r.i: (r.kind, r.path, r.command) for r in settings.frames(spark.createDataFrame(data, "i int, f binary"), "f", key).collect()}
    assert out == {1: (1, "/a.pdf", None), 2: (1, long.decode(), None), 6: (2, None, 1)}


def test_places_in_the_queue(spark):
    from pagelattice.operators import order

    rows = [(i, i * 37 % 9000, i % 4, i % 10 == 0) for i in range(800)]
    df = spark.createDataFrame(rows, "i int, page_no int, type int, cancelled boolean")
    got = {r.i: r.place for r in order.places(df, ["type", "i"], 16).collect()}
    want = sorted((p, t, i) for i, p, t, c in rows if not c)
    assert got == {i: k for k, (_, _, i) in enumerate(want, 1)}
    odd = spark.createDataFrame([(1, None, 0, None), (2, 5, 1, None), (3, None, 0, True), (4, 1, 0, False), (5, None, 1, False)], df.schema)
    assert {r.i: r.place for r in order.places(odd, ["type", "i"]).collect()} == {4: 1, 2: 2, 1: 3, 5: 4}
    assert [r.i for r in order.priority(odd).collect()] == [4, 2, 1, 5]


def test_progress_and_replaced_search(spark, tmp_path):
    from pagelattice.streaming import live

    p = spark.createDataFrame([(0, 0), (1, 3), (3, 3)], "a int, b int").select(live.progress(live.F.col("a"), live.F.col("b")).alias("p"))
    assert [r.p for r in p.collect()] == [0, 34, 100]
    spark.createDataFrame([(1, "one two"), (2, "two")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    s = live.Search(live.documents(spark, str(tmp_path / "in"), "doc_id long, text string"), str(tmp_path / "out"))
    s.replace("one")
    first = s.running
    sink = s.replace("two")
    s.running.processAllAvailable()
    assert not first.isActive and spark.read.parquet(sink).count() == 2
    s.running.stop()


def test_pdf_writer_round_trip(spark):
    from pagelattice.operators.layout import layout
    from pagelattice.operators.overlap import dedup
    from pagelattice.sources import pdf_write

    text = "Nächste 😀 (Seite)\nzwei " + "xxxx " * 320
    files = [(1, bytearray(pdf_write.write(text))), (2, bytearray(pdf_write.write(""))), (3, None), (4, bytearray(pdf_write.write(text, 0.5)))]
    df = spark.createDataFrame(files, "doc_id long, content binary")
    got = pdf.placed(pdf.parsed(df, "letters", key="doc_id")).orderBy("doc_id", "page_no", "seq").collect()
    one = [r for r in got if r.doc_id == 1]
    assert "".join(r.value for r in one) == text.replace("\n", " ") and {r.page_no for r in one} == {1, 2}
    assert (one[1].left, one[1].top, one[1].right, one[1].bottom, one[1].point_size, one[1].orientation) == (6.0, -10.0, 12.0, 0.0, 10.0, "Horizontal")
    assert not [r for r in got if r.doc_id in (2, 3)] and len([r for r in got if r.doc_id == 4]) == 2 * len(one)
    assert [r.doc_id for r in pdf.parsed(df, "errors", key="doc_id").collect()] == [3]
    words = layout(dedup(pdf.placed(pdf.parsed(df, "letters", key="doc_id")))).where("page_no = 1").orderBy("doc_id", "word_idx").collect()
    by = {d: [r.value for r in words if r.doc_id == d] for d in (1, 4)}
    assert by[1] == by[4] and by[1][:6] == ["Nächste", "😀", "(", "Seite", ")", "zwei"]


def packed_lzw(data):
    """A plain LZW writer with early change."""
    table, width, bits, before = {bytes([i]): i for i in range(256)}, 9, "", b""
    size = 258
    put = lambda c: f"{c:0{width}b}"
    bits = put(256)
    for b in data:
        now = before + bytes([b])
        if now in table:
            before = now
            continue
        bits += put(table[before])
        table[now], size, before = size, size + 1, bytes([b])
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            bits += put(256)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
    if before:
        bits += put(table[before])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    bits += put(257)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8)


def test_pdf_fonts_and_filters():
    import base64

    assert [pdf.glyph(n) for n in ("A", "eacute", "quoteright", "seven", "uni00E9", "u1F600", "alpha", "Omega", "a.sc", "g123")] == ["A", "é", "’", "7", "é", "😀", "α", "Ω", "a", None]
    for text in (b"", b"aaaaaaa", b"-----A---B", bytes(random.Random(1).choices(range(256), k=9000)), b"the cat sat on the mat. " * 900):
        assert pdf.unpacked_lzw(packed_lzw(text)) == text
    content = b"BT /F1 10 Tf 0 700 Td (A\x92\x01\x02) Tj ET"
    for name, body in ((b"LZWDecode", packed_lzw(content)), (b"ASCII85Decode", base64.a85encode(content) + b"~>")):
        objs = {
            1: b"<< /Type /Catalog /Pages 2 0 R >>",
            2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
            3: b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
            4: b"<< /Length %d /Filter /%s >>\nstream\n%s\nendstream" % (len(body), name, body),
            5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /fi] >> >>",
        }
        data = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objs.items()) + b"trailer\n<< /Root 1 0 R >>\n%%EOF"
        found, failed = pdf.rows(data, "letters")
        assert not failed
        assert [r[2] for r in found] == ["A", "’", "é", "ﬁ"] and round(found[0][7] - found[0][5], 6) == 13.34
