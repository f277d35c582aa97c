"""PDF files by ranges of pages, as a data source: a file of many pages is many tasks.

    spark.dataSource.register(PdfPages)
    spark.read.format("pdf_pages").option("table", "letters").load(folder)

Options: `table`; `range_bytes`, the size of file for each range of pages (a file of that size or less is one task); `passwords`, one a
line; `errors` ("true": failures as rows, see `pdf.parsed`); `suffix` (".pdf"). Each task opens its file and parses the pages of its range;
what isn't of a page comes with the first. Files are reached through Arrow's file systems: local ones, HDFS, S3 and so on by their address.
Equal rows to `pdf.read`, which reads a file as one row and suits many small files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import pdf

RANGE_BYTES = 1 << 20


class PageRange(InputPartition):
    """One of `of` ranges of the pages of a file."""

    def __init__(self, path: str, number: int, of: int):
        super().__init__((path, number, of))


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def _table(self) -> tuple[str, bool]:
        table = self.options.get("table", "letters")
        if table not in pdf.TABLES:
            raise ValueError(f"no table {table}: there are {', '.join(pdf.TABLES)}")
        return table, self.options.get("errors", "false").lower() == "true"

    def schema(self) -> str:
        return f"path string, {pdf.ddl(pdf.columns(*self._table()))}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, *self._table())


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], table: str, with_errors: bool):
        self.path = options["path"]
        self.table, self.with_errors = table, with_errors
        self.size = max(1, int(options.get("range_bytes", RANGE_BYTES)))
        self.passwords = [p for p in options.get("passwords", "").split("\n") if p]
        self.suffix = options.get("suffix", ".pdf").lower()

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> Sequence[PageRange]:
        from pyarrow import fs

        system, root = self._system()
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.suffix))
        out = []
        for path, size in files:
            of = max(1, -(-size // self.size)) if self.table in ("letters", "annotations", "pages", "errors") else 1
            out += [PageRange(path, k, of) for k in range(of)]
        return out

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        path, number, of = partition.value
        with self._system()[0].open_input_stream(path) as f:
            data = f.read()
        found, failed = pdf.rows(data, self.table, self.passwords, (number, of))
        yield pdf.batch_of([pa.array([path])], ["path"], found, failed, self.table, self.with_errors)
