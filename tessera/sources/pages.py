"""Data source ``document_pages``: pages of long files as rows, read in parallel by ranges of a file.

``spark.read.format("document_pages").option("path", folder).load()`` after ``register``. Text files (.txt, .md) have their pages between form
feeds, PDF files as PyMuPDF counts them, where that is installed. A file is planned as ranges: of ``rangeBytes`` of a text file, which
begin at the first page that starts in them, or of ``rangePages`` of a PDF. So a long file is read by many tasks, none of which
holds more than a page. A page without usable text is a row with its ``problem``: empty, garbled, undecodable, or unreadable for a file that
does not open (a file without a byte has no page); ``ocr`` may name a function (module:function) of path and place that gives such a page another text.
Garbled is a page with a share of ASCII letters below ``letterShare``, 0.55 if not given; files of markup, figures or accented capitals need a lower one.

As a stream, files that are new or written again since the last batch are read.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window as W

from .files import garbled

SCHEMA = "path string, start long, text string, problem string, by_ocr boolean"
NAMES = ["path", "start", "text", "problem", "by_ocr"]
TYPES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("text", pa.string()), ("problem", pa.string()), ("by_ocr", pa.bool_())])
BREAK, BUFFER = b"\x0c", 1 << 20
#: Fewest characters that a page read by OCR must have (fixed value).
LEAST_OCR = 20


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def _files(uri: str) -> list[fs.FileInfo]:
    store, path = _store(uri)
    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.path.lower().endswith((".txt", ".md", ".pdf"))), key=lambda f: f.path)


def text_pages(stream, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the pages that start in [begin, end): after a form feed, or at the start of the file."""
    at, data, done = begin, b"", False
    if begin:
        # a page starts here only if a break stands right before
        stream.seek(begin - 1)
        at = begin - 1
        while True:
            more = stream.read(BUFFER)
            if not more:
                return
            hit = more.find(BREAK)
            if hit >= 0:
                at, data = at + hit + 1, more[hit + 1 :]
                break
            at += len(more)
    while at < end:
        parts, hit = [data], data.find(BREAK)
        while hit < 0 and not done:
            more = stream.read(BUFFER)
            done = not more
            hit = more.find(BREAK)
            parts.append(more)
        last = parts[-1]
        page = b"".join([*parts[:-1], last[:hit] if hit >= 0 else last])
        yield at, page
        if hit < 0:
            return
        at, data = at + len(page) + 1, last[hit + 1 :]


class Pages:
    """What batch and stream share: planning and reading of ranges."""

    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.bytes = int(options.get("rangeBytes", 32 << 20))
        self.pages = int(options.get("rangePages", 200))
        self.ocr = options.get("ocr")
        self.letters = float(options.get("letterShare", 0.55))
        if not self.path:
            raise ValueError("path is missing")

    def plan(self, files: list[fs.FileInfo]) -> list[Range]:
        out = []
        for f in files:
            size, step = f.size, self.bytes
            if f.path.lower().endswith(".pdf"):
                size, step = self._count(f.path), self.pages
            out += [Range(f.path, i, min(i + step, size)) for i in range(0, max(size, 1), step)]
        return out

    def _open(self, path: str):
        return _store(self.path)[0].open_input_file(path)

    def _count(self, path: str) -> int:
        try:
            import fitz

            with self._open(path) as stream, fitz.open(stream=stream.read(), filetype="pdf") as document:
                return document.page_count
        except Exception:
            return 1  # the task that reads it says why

    def _raw(self, part: Range) -> Iterator[tuple[int, bytes | str]]:
        with self._open(part.path) as stream:
            if part.path.lower().endswith(".pdf"):
                import fitz

                with fitz.open(stream=stream.read(), filetype="pdf") as document:
                    for n in range(part.begin, min(part.end, document.page_count)):
                        yield n, document[n].get_text("text")
            else:
                yield from text_pages(stream, part.begin, part.end)

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        try:
            for place, raw in self._raw(part):
                held.append((part.path, place, *self._judge(part.path, place, raw)))
                size += len(raw)
                if size > BUFFER:
                    yield self._batch(held)
                    held, size = [], 0
        except Exception as e:  # one bad file stops no other
            held.append((part.path, part.begin, None, f"unreadable: {type(e).__name__}", False))
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TYPES, strict=True)], schema=TYPES)

    def _judge(self, path: str, place: int, raw: bytes | str) -> tuple[str | None, str | None, bool]:
        text, problem = raw, None
        if isinstance(raw, bytes):
            text = None
            for name in ("utf-8-sig" if place == 0 else "utf-8", "gb18030"):
                try:
                    text = raw.decode(name)
                    break
                except UnicodeDecodeError:
                    continue
        text = text if text is None else text.strip()
        problem = "undecodable" if text is None else "empty" if not text else "garbled" if garbled(text, self.letters) else None
        if problem and self.ocr:
            module, name = self.ocr.split(":")
            seen = (getattr(importlib.import_module(module), name)(path, place) or "").strip()
            if len(seen) >= LEAST_OCR:
                return seen, None, True
        return text, problem, False


class BatchReader(Pages, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.plan(_files(self.path)) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition.path else iter(())


class StreamReader(Pages, DataSourceStreamReader):
    """An offset is the time of the latest file read, with the files of that time."""

    def initialOffset(self) -> dict:
        return {"time": -1, "names": "[]"}

    def latestOffset(self) -> dict:
        found = [(f.mtime_ns or 0, f.path) for f in _files(self.path)]
        if not found:
            return self.initialOffset()
        last = max(t for t, _ in found)
        return {"time": last, "names": json.dumps([p for t, p in found if t == last])}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, named = json.loads(start["names"]), json.loads(end["names"])
        new = []
        for f in _files(self.path):
            t = f.mtime_ns or 0
            after = t > start["time"] or t == start["time"] and f.path not in before
            upto = t < end["time"] or t == end["time"] and f.path in named
            if after and upto:
                new.append(f)
        return self.plan(new) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        pass


class DocumentPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentPages)


def numbered(pages: DataFrame) -> DataFrame:
    """Pages with their number in the file, from 0; counted over places alone."""
    return pages.withColumn("page", F.row_number().over(W.partitionBy("path").orderBy("start")) - 1)
