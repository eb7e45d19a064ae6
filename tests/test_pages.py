"""Pages of long files by ranges, and as a stream."""

import io

import pytest

from tessera.sources import pages

GOOD = "A page of plain words, long enough."


def scan(name, place):
    return f"read from {name.rsplit('/', 1)[1]} at {place}" if place else ""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "deep").mkdir()
    long = [f"{GOOD} {i} " + "x" * (37 * i % 500) for i in range(200)]
    (d / "deep" / "long.txt").write_bytes("\f".join(long).encode())
    (d / "odd.md").write_bytes("\f".join(["﻿head of it", " ", "#%" * 20, ""]).encode() + b"\f\xff\xff\f" + "标准".encode("gb18030"))
    (d / "empty.txt").write_bytes(b"")
    (d / "no.csv").write_text("not read")
    (d / "bad.pdf").write_bytes(b"not a pdf")
    return d, long


@pytest.mark.parametrize("step", [1, 7, 64, 1000, 10**9])
def test_ranges_tile_a_file(step):
    data = b"one\x0c\x0ctwo\x0c" + b"y" * 50 + b"\x0c"
    got = [p for i in range(0, len(data), step) for p in pages.text_pages(io.BytesIO(data), i, min(i + step, len(data)))]
    starts = [0, 4, 5, 9]
    assert [a for a, _ in got] == starts and [b for _, b in got] == [b"one", b"", b"two", b"y" * 50]


def load(spark, d, **options):
    pages.register(spark)
    return spark.read.format("document_pages").option("path", f"file:{d}").options(**options).load()


def test_long_file_in_many_tasks(spark, folder):
    d, long = folder
    df = load(spark, d, rangeBytes=4096)
    assert df.rdd.getNumPartitions() > 10
    got = pages.numbered(df.where("path LIKE '%long.txt'")).orderBy("page").collect()
    assert [r.text for r in got] == [t.strip() for t in long] and [r.page for r in got] == list(range(200)) and not any(r.problem for r in got)


def test_problems(spark, folder):
    d, _ = folder
    by = {}
    for r in load(spark, d).collect():
        by.setdefault(r.path.rsplit("/", 1)[1], []).append((r.text, r.problem))
    assert by["odd.md"] == [("head of it", None), ("", "empty"), ("#%" * 20, "garbled"), ("", "empty"), (None, "undecodable"), ("标准", None)]
    assert "empty.txt" not in by and "no.csv" not in by
    assert by["bad.pdf"][0][0] is None and by["bad.pdf"][0][1].startswith("unreadable")
    assert load(spark, d / "none").count() == 0


def test_letter_share(spark, tmp_path):
    """Markup with many digits is no garbled page where its limit says so; symbols without a letter are at any."""
    (tmp_path / "a.txt").write_text("\f".join(["<p>2353820953013749 4550997810720808</p>", "#%" * 20]))
    assert [r.problem for r in load(spark, tmp_path).collect()] == ["garbled", "garbled"]
    assert [r.problem for r in load(spark, tmp_path, letterShare=1e-9).orderBy("start").collect()] == [None, "garbled"]


def test_ocr(spark, folder):
    d, _ = folder
    got = {r.start: (r.text, r.problem, r.by_ocr) for r in load(spark, d, ocr="tests.test_pages:scan").where("path LIKE '%odd.md'").collect()}
    assert sum(x[2] for x in got.values()) == 4 and all(x[1] is None for x in got.values())


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pages.register(spark)

    def run():
        q = spark.readStream.format("document_pages").option("path", f"file:{tmp_path}/in").option("rangeBytes", 10).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.text for r in spark.read.schema(pages.SCHEMA).parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "a.txt").write_text("one\ftwo of it")
    assert run() == ["one", "two of it"]
    (tmp_path / "in" / "b.txt").write_text("three")
    assert run() == ["one", "three", "two of it"]
    assert run() == ["one", "three", "two of it"]
