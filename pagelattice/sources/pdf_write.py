"""PDF files from the rows of pages: one fixed-width font, one line of text for each row of the grid."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.geometry import PPI_SCALE
from .letters import CELL, COLUMNS, HEIGHT, PITCH, POINT, ROWS


def _text(s: str) -> bytes:
    """A text string in hexadecimal."""
    return b"<FEFF%s>" % s.encode("utf-16-be", "replace").hex().upper().encode()


def write(text: str, again: float | None = None, title: str | None = None, author: str = "", damaged: Callable[[int], bool] = lambda page: False, plain: bool = False) -> bytes:
    """A file with the pages of a text, as `letters.pages` cuts them. again: each row is drawn a second time, that many units to the right.

    title: the file also has properties, an outline (a node a page, and one below it), annotations (a link, a note and one without size
    on each page), a turn of each page, and the text as an attached file. damaged: pages, from 1, whose content can't be unpacked. plain: streams
    aren't packed, so that the file is ASCII. Codes are numbers of the distinct characters, so any character can be written; line feeds become blanks."""
    whole, text = text, text.replace("\n", " ")
    codes = {c: i for i, c in enumerate(sorted(set(text)), 1)}
    shown_as = {ord(c): f"{i:04x}" for c, i in codes.items()}
    wide, high, size = COLUMNS * CELL / PPI_SCALE, ROWS * PITCH / PPI_SCALE, POINT / PPI_SCALE
    span = COLUMNS * ROWS
    pages = [text[a : a + span] for a in range(0, len(text), span)]
    named = b"".join(b"<%04x> <%s>\n" % (i, c.encode("utf-16-be", "replace").hex().encode()) for c, i in codes.items())
    cmap = b"%d beginbfchar\n%sendbfchar\n" % (len(codes), named)
    first, step = 7, 2 if title is None else 7
    page_at = [first + step * k for k in range(len(pages))]
    end = first + step * len(pages)
    rich = b"" if title is None else b" /Outlines %d 0 R /Names << /EmbeddedFiles << /Names [<00> %d 0 R] >> >>" % (end, end + 1)
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R%s >>" % rich,
        b"<< /Type /Pages /Count %d /MediaBox [0 0 %g %g] /Resources << /Font << /F 3 0 R >> >> /Kids [%s] >>" % (len(pages), wide, high, b" ".join(b"%d 0 R" % n for n in page_at)),
        b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 6 0 R >>",
        b"<< /Type /Font /Subtype /CIDFontType2 /DW %g /FontDescriptor 5 0 R >>" % (1000 * CELL / POINT),
        b"<< /Type /FontDescriptor /Ascent %g >>" % (1000 * HEIGHT / POINT),
        _stream(cmap, plain),
    ]
    for k, page in enumerate(pages):
        body = [b"BT /F %g Tf" % size]
        for r in range(0, len(page), COLUMNS):
            shown = page[r : r + COLUMNS].translate(shown_as).encode()
            for x in (0.0,) if again is None else (0.0, again / PPI_SCALE):
                body.append(b"1 0 0 1 %g %g Tm <%s> Tj" % (x, high - r // COLUMNS * PITCH / PPI_SCALE, shown))
        content = b"\n".join([*body, b"ET"])
        broken = b"<< /Length 12 /Filter /FlateDecode >>\nstream\nnot deflated\nendstream"
        n = page_at[k]
        more = b"" if title is None else b" /Rotate %d /Annots [%d 0 R %d 0 R %d 0 R]" % (90 * (k % 4), n + 2, n + 3, n + 4)
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R%s >>" % (n + 1, more), broken if damaged(k + 1) else _stream(content, plain)]
        if title is not None:
            following = b" /Next %d 0 R" % (page_at[k + 1] + 5) if k + 1 < len(pages) else b""
            objects += [
                b"<< /Type /Annot /Subtype /Link /Rect [%d 10 %d 20] /A << /S /URI /URI (http://pages/%d) >> >>" % (k, k + 30, k + 1),
                b"<< /Type /Annot /Subtype /Text /Rect [5 5 15 25] /Contents %s /M (D:20240102030405Z) >>" % _text(page[:10]),
                b"<< /Type /Annot /Subtype /Link /Rect [7 7 7 9] /Dest [%d 0 R /Fit] >>" % n,
                b"<< /Title %s /Dest [%d 0 R /XYZ 0 %d 0] /First %d 0 R%s >>" % (_text(f"Page {k + 1}"), n, 100 - k % 90, n + 6, following),
                b"<< /Title %s >>" % _text("starts with " + page[:5]),
            ]
    info = b""
    if title is not None:
        objects += [
            b"<< %s >>" % (b"/First %d 0 R" % (first + 5) if pages else b""),
            b"<< /UF %s /EF << /F %d 0 R >> >>" % (_text(title + ".txt"), end + 2),
            _stream(whole.encode(), plain),
            b"<< /Title %s /Author %s >>" % (_text(title), _text(author)),
        ]
        info = b" /Info %d 0 R" % (end + 3)
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in enumerate(objects, 1)) + b"trailer\n<< /Root 1 0 R%s >>\n%%%%EOF" % info


def _stream(body: bytes, plain: bool = False) -> bytes:
    if plain:
        body = body.hex().encode() + b">"
        return b"<< /Length %d /Filter /ASCIIHexDecode >>\nstream\n%s\nendstream" % (len(body), body)
    packed = zlib.compress(body, 1)
    return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed)


def files(docs: DataFrame, **how) -> DataFrame:
    """doc_id and content (a file) of documents (doc_id, text, source, lang); how: arguments of write(). titled=True: the source is the
    title and the language the author."""
    titled = how.pop("titled", False)
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, source, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = {"title": source or "", "author": lang or ""} if titled else {}
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([write(t or "", **more, **how)], pa.binary())], schema=schema)

    return docs.select("doc_id", "text", "source", "lang").mapInArrow(run, "doc_id bigint, content binary")
