import hashlib
import os
import random
import re
import zlib

import pytest

from pagelattice.operators.layout import layout
from pagelattice.operators.overlap import crowded, dedup, kept
from pagelattice.sources import pdf, pdf_crypt, pdf_write
from pagelattice.sources.pdf_source import PdfPages


def assembled(objects, trailer=b""):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items())) + b"trailer\n<< /Root 1 0 R%s >>\n%%%%EOF" % trailer


def objects_of(data):
    return {int(m[1]): m[2] for m in re.finditer(rb"(\d+) 0 obj\n(.*?)\nendobj\n", data, re.S)}


def damaged_pages():
    """Four pages: good, broken deflate, an unknown filter, good by run lengths."""
    text = b"BT /F1 10 Tf 0 700 Td (Page%d) Tj ET"
    runs = b"".join(bytes([len(p) - 1]) + p for p in ((text % 4)[:20], (text % 4)[20:])) + b"\x80"
    bodies = [(b"/FlateDecode", zlib.compress(text % 1)), (b"/FlateDecode", b"damaged data"), (b"/NoSuchDecode", b"abc"), (b"/RunLengthDecode", runs)]
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [10 0 R 20 0 R 30 0 R 40 0 R] /Count 4 /MediaBox [0 0 612 792] >>", 5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"}
    for k, (f, body) in enumerate(bodies, 1):
        objects[10 * k] = b"<< /Type /Page /Contents %d 0 R /Resources << /Font << /F1 5 0 R >> >> >>" % (10 * k + 1)
        objects[10 * k + 1] = b"<< /Length %d /Filter %s >>\nstream\n%s\nendstream" % (len(body), f, body)
    return assembled(objects)


def test_a_broken_page_costs_itself_alone(spark):
    rows = [(1, "a", bytearray(damaged_pages())), (2, "b", bytearray(b"nothing")), (3, "c", None), (4, None, bytearray(pdf_write.write("whole")))]
    df = spark.createDataFrame(rows, "doc_id int, side string, content binary")
    found = pdf.parsed(df, "letters", key=("doc_id", "side")).orderBy("doc_id", "page_no", "seq").collect()
    assert "".join(r.value for r in found) == "Page1Page4whole" and {(r.doc_id, r.page_no) for r in found} == {(1, 1), (1, 4), (4, 1)}
    assert pdf.parsed(df, "pages", key="doc_id").where("doc_id = 1").count() == 4
    both = pdf.parsed(df, "letters", key=("doc_id", "side"), with_errors=True)
    assert both.where("error is null").drop("error").collect() == pdf.parsed(df, "letters", key=("doc_id", "side")).collect()
    failed = both.where("error is not null").orderBy("doc_id", "page_no").collect()
    assert [(r.doc_id, r.page_no, r.seq) for r in failed] == [(1, 2, None), (1, 3, None), (2, None, None), (3, None, None)]
    assert "NoSuchDecode" in failed[1].error and "not a PDF" in failed[2].error
    table = pdf.parsed(df, "errors", key="doc_id").orderBy("doc_id", "page_no").collect()
    assert [(r.doc_id, r.table, r.page_no) for r in table] == [(1, "letters", 2), (1, "letters", 3), (2, None, None), (3, None, None)]
    no_pages = pdf.parsed(df, "outline", key="doc_id", with_errors=True)
    assert sorted((r.doc_id, r.page_no, r.node_id) for r in no_pages.collect()) == [(2, None, None), (3, None, None)]
    words = layout(dedup(pdf.placed(pdf.parsed(df, "letters", key=("doc_id", "side"))), keys=("doc_id", "side", "page_no")), keys=("doc_id", "side", "page_no"))
    assert sorted((r.doc_id, r.side, r.page_no, r.value) for r in words.collect()) == [(1, "a", 1, "Page1"), (1, "a", 4, "Page4"), (4, None, 1, "whole")]


def sealed(data, method, user, owner):
    """A file under the standard handler: RC4 of 40 or 128 bits, AES of 128 bits, AES of 256 bits of revision 5 or 6."""
    version, revision, size = {"RC4-40": (1, 2, 5), "RC4-128": (2, 3, 16), "AES-128": (4, 4, 16), "AES-256": (5, 5, 32), "AES-256-6": (5, 6, 32)}[method]
    rng = random.Random(method)
    some = lambda n: bytes(rng.randrange(256) for _ in range(n))
    hexed = lambda b: b"<" + b.hex().encode() + b">"
    ident, rights = some(16), b"\xfc\xff\xff\xff"
    md5 = lambda b: hashlib.md5(b).digest()
    xored = lambda k, step: bytes(b ^ step for b in k)
    more = b""
    if version == 5:
        key = some(32)
        digest = pdf_crypt.hash_6 if revision == 6 else lambda *x: hashlib.sha256(b"".join(x)).digest()
        salts = [some(8) for _ in range(4)]
        u = digest(user.encode(), salts[0], b"") + salts[0] + salts[1]
        ue = pdf_crypt.aes_encipher(digest(user.encode(), salts[1], b""), key, bytes(16))
        o = digest(owner.encode(), salts[2], u) + salts[2] + salts[3]
        oe = pdf_crypt.aes_encipher(digest(owner.encode(), salts[3], u), key, bytes(16))
        more = b" /UE %s /OE %s" % (hexed(ue), hexed(oe))
    else:
        k = md5((owner.encode() + pdf_crypt.PAD)[:32])
        for _ in range(50 if revision >= 3 else 0):
            k = md5(k)
        o = (user.encode() + pdf_crypt.PAD)[:32]
        for step in range(20 if revision >= 3 else 1):
            o = pdf_crypt.rc4(xored(k[:size], step), o)
        key = md5((user.encode() + pdf_crypt.PAD)[:32] + o + rights + ident)
        for _ in range(50 if revision >= 3 else 0):
            key = md5(key[:size])
        key = key[:size]
        if revision == 2:
            u = pdf_crypt.rc4(key, pdf_crypt.PAD)
        else:
            u = md5(pdf_crypt.PAD + ident)
            for step in range(20):
                u = pdf_crypt.rc4(xored(key, step), u)
            u += bytes(16)

    def shut(n, body):
        if version == 5:
            v, pad = some(16), 16 - len(body) % 16
            return v + pdf_crypt.aes_encipher(key, body + bytes([pad]) * pad, v)
        own = md5(key + n.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if version == 4 else b""))[: min(size + 5, 16)]
        if version == 4:
            v, pad = some(16), 16 - len(body) % 16
            return v + pdf_crypt.aes_encipher(own, body + bytes([pad]) * pad, v)
        return pdf_crypt.rc4(own, body)

    objects = objects_of(data)
    for n, body in objects.items():
        m = re.fullmatch(rb"(<<.*?)/Length \d+(.*?>>)\nstream\n(.*)\nendstream", body, re.S)
        if m:
            inner = shut(n, m[3])
            objects[n] = m[1] + b"/Length %d" % len(inner) + m[2] + b"\nstream\n" + inner + b"\nendstream"
        else:
            objects[n] = re.sub(rb"<FEFF([0-9A-F]*)>", lambda x: hexed(shut(n, b"\xfe\xff" + bytes.fromhex(x[1].decode()))), body)  # noqa: B023
    kind = {4: b"AESV2", 5: b"AESV3"}.get(version)
    filters = b" /CF << /StdCF << /CFM /%s >> >> /StmF /StdCF /StrF /StdCF" % kind if kind else b""
    objects[900] = b"<< /Filter /Standard /V %d /R %d /Length %d /P -4 /O %s /U %s%s%s >>" % (version, revision, 8 * size, hexed(o), hexed(u), more, filters)
    info = re.search(rb"/Info \d+ 0 R", data)
    return assembled(objects, b" /Encrypt 900 0 R /ID [%s %s] " % (hexed(ident), hexed(ident)) + (info[0] if info else b""))


def test_published_examples():
    key, text = bytes(range(32)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert pdf_crypt.aes_encipher(key[:16], text, bytes(16)).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert pdf_crypt.aes_encipher(key, text, bytes(16)).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert pdf_crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    data, start = os.urandom(320), os.urandom(16)
    assert pdf_crypt.aes_decipher(key, pdf_crypt.aes_encipher(key, data, start), start, padded=False) == data


@pytest.mark.parametrize("method", ["RC4-40", "RC4-128", "AES-128", "AES-256", "AES-256-6"])
def test_files_under_a_password(method):
    text = "secret words (and more)"
    plain = pdf_write.write(text, title="The title", author="me")
    data = sealed(plain, method, "open", "master")
    for passwords in (["open"], ["master"], ["wrong", "open"]):
        found, failed = pdf.rows(data, "letters", passwords)
        assert "".join(r[2] for r in found) == text and not failed
    assert pdf.rows(data, "properties", ["open"])[0][0][2] == {"Title": "The title", "Author": "me"}
    assert pdf.rows(data, "attachments", ["open"]) == ([("The title.txt", text.encode())], [])
    for passwords in ([], ["wrong"]):
        found, failed = pdf.rows(data, "letters", passwords)
        assert not found and failed == [(None, None, "ValueError: encrypted: no password given fits")]
    assert pdf.rows(sealed(plain, method, "", "master"), "letters")[0] == pdf.rows(plain, "letters")[0]


def test_encrypted_files_by_path(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(sealed(pdf_write.write("first"), "AES-128", "one", "x"))
    (tmp_path / "b.pdf").write_bytes(sealed(pdf_write.write("second"), "RC4-128", "two", "x"))
    (tmp_path / "c.pdf").write_bytes(sealed(pdf_write.write("third"), "AES-256", "three", "y"))
    found = pdf.read(spark, str(tmp_path), "letters", ["one", "two"], with_errors=True).orderBy("path", "seq").collect()
    assert "".join(r.value or "|" for r in found) == "firstsecond|"


def test_ranges_of_pages(spark, tmp_path):
    text = "".join(f"page {k:03d} of a long file, {'words ' * 260}"[:1600] for k in range(60))
    (tmp_path / "long.pdf").write_bytes(pdf_write.write(text, title="long", damaged=lambda page: page == 17))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "short.PDF").write_bytes(pdf_write.write("short"))
    (tmp_path / "bad.pdf").write_bytes(b"x" * 5000)
    (tmp_path / "other.txt").write_bytes(b"no")
    spark.dataSource.register(PdfPages)
    load = lambda table, **o: spark.read.format("pdf_pages").options(table=table, range_bytes=1000, **o).load(str(tmp_path))
    letters = load("letters", errors="true")
    assert letters.rdd.getNumPartitions() > 10
    key = lambda rows: sorted(rows, key=str)
    for table in ("letters", "pages", "annotations", "outline", "properties", "errors"):
        assert key(by_path(load(table))) == key(by_path(pdf.read(spark, str(tmp_path), table))), table
    assert key(by_path(letters)) == key(by_path(pdf.read(spark, str(tmp_path), "letters", with_errors=True)))
    assert letters.where("error is not null").count() == 2
    parts = letters.where("path like '%long.pdf' and error is null").selectExpr("page_no", "spark_partition_id() as p").distinct().collect()
    assert len({r.p for r in parts}) > 10 and len(parts) == 59


def by_path(df):
    return [(r.path.rsplit("/", 1)[1], *r[1:]) for r in df.collect()]


def slow_kept(values, x, y, width, keep_last):
    slots, out = [], [True] * len(values)
    for i, v in enumerate(values):
        tol = width[i] / max(len(v), 1) / 3
        k = next((k for k, s in enumerate(slots) if s[0] == v and abs(s[1] - x[i]) <= tol and abs(s[2] - y[i]) <= tol), None)
        if k is None:
            slots.append([v, x[i], y[i], i])
        elif keep_last:
            out[slots[k][3]] = False
            slots[k] = [v, x[i], y[i], i]
        else:
            out[i] = False
    return out


def test_duplicates_by_plain_rule():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (0, 1, 30, 400):
        values = [str(rng.choice(list("abc") + ["fi"])) for _ in range(n)]
        x, y, w = np.round(rng.random(n) * 60, 1), np.round(rng.random(n) * 20), rng.choice([0.0, 3.0, 6.0, 9.0], n)
        for last in (True, False):
            assert kept(values, x, y, w, last).tolist() == slow_kept(values, x, y, w, last)
    assert crowded(["a", "a", "b"], np.array([0.0, 50.0, 0.0]), np.zeros(3), 2.0).tolist() == [False, False, False]
