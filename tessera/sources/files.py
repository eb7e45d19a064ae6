"""Scans of files and folders, and writes that never leave a half-made table."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..operators import contracts

TEXT_FILES = "(?i)\\.(pdf|txt|md)$"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _path(spark, path)
    return system.exists(p)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length) of all documents below a folder; none where it is missing. Contents are not read."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, modified timestamp, length long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.col("path").rlike(TEXT_FILES)).select("path", F.col("modificationTime").alias("modified"), "length")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, sha256) of text files: UTF-8 with or without byte order mark, else GB18030; any other fails and is named.

    A file is one row, so it must fit in a task.
    """
    schema = "path string, text string, sha256 string"
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike("(?i)\\.(txt|md)$"))
    # decoders that fail on bad input are not built in for both encodings

    def decode(batches):
        for frame in batches:
            frame["text"] = [_decoded(bytes(b), p) for b, p in zip(frame.pop("content"), frame["path"])]
            yield frame[["path", "text", "sha256"]]

    return files.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInPandas(decode, schema)


def _decoded(raw: bytes, path: str) -> str:
    for name in ("utf-8-sig", "gb18030"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError(f"{path} is neither UTF-8 nor GB18030")


#: A page of a file: its number from 0 and its text, or None where it has none.
Pages = Callable[[bytes], Iterator[tuple[int, str | None]]]


def pdf_pages(raw: bytes) -> Iterator[tuple[int, str | None]]:
    """The pages of a PDF by PyMuPDF, where that is installed."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF, or another function given as pages") from e
    with fitz.open(stream=raw, filetype="pdf") as document:
        for number, page in enumerate(document):
            yield number, page.get_text("text")


def read_pages(spark: SparkSession, folder: str, pages: Pages = pdf_pages, ocr: Callable[[bytes, int], str | None] | None = None, ocr_empty: bool = False, least: int = 20) -> DataFrame:
    """(path, page, text, by_ocr, sha256) of all documents below a folder: a row a non-empty page of PDF files, a row a text file.

    A page whose text layer is garbled is read by ``ocr(file, page)``, if that gives ``least`` characters, else left out. Pages
    without text are left out too unless ``ocr_empty``.
    """
    schema = "path string, page int, text string, by_ocr boolean, sha256 string"
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    texts = read_texts(spark, folder).where(F.col("text").rlike("\\S")).select("path", F.lit(None).cast("int").alias("page"), F.regexp_replace("text", "^\\s+|\\s+$", "").alias("text"), F.lit(False).alias("by_ocr"), "sha256")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike("(?i)\\.pdf$"))

    def cut(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for path, raw, digest in zip(frame["path"], frame["content"], frame["sha256"]):
                for number, text in pages(bytes(raw)):
                    text, seen = (text or "").strip(), False
                    if garbled(text) or not text and ocr_empty:
                        text, seen = (ocr(bytes(raw), number) or "" if ocr else "").strip(), True
                        if len(text) < least:
                            continue
                    if text:
                        rows.append((path, number, text, seen, digest))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "by_ocr", "sha256"])

    return texts.unionByName(files.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInPandas(cut, schema))


def garbled(text: str, letters: float = 0.55) -> bool:
    """What ``functions.text.looks_garbled`` says, for a text in a worker; ``letters`` is the least share of ASCII letters."""
    if len(text) < 20 or re.search("[一-鿿]", text):
        return False
    return len(re.findall("[A-Za-z]", text)) / len(text) < letters


def read_questions(spark: SparkSession, path: str, schema: str, expected: int | None = None) -> DataFrame:
    """A question set of one JSON document; an empty one, or one of another size than ``expected``, fails when it is used."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return contracts.require_size(rows, expected, path)


#: Fields of a slice definition.
SLICE = "question_id string, case_type string, risk_level string, slice_tags array<string>, flaky boolean"


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """Slice definitions of one JSON document; a bad one fails when they are used, in the same pass."""
    rows = spark.read.schema(SLICE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return contracts.valid_slices(contracts.require_size(rows, None, path))


def read_run(spark: SparkSession, path: str, schema: str, case_set: str, arm: str, round_: int) -> DataFrame:
    """The rows of a recorded run with its labels; a row without status has completed if its generation succeeded, else failed."""
    rows = spark.read.schema(f"rows array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("rows"))
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    known = {c: F.col(c) if c in rows.columns else F.lit(None) for c in ("status", "generation_success")}
    status = F.coalesce(known["status"].cast("string"), F.when(known["generation_success"].cast("boolean"), "completed").otherwise("failed"))
    return rows.withColumn("status", status).withColumns({"case_set": F.lit(case_set), "arm": F.lit(arm), "round": F.lit(round_)})


def run_labels(spec: str) -> dict[str, str]:
    """``case_set=...,arm=...,round=...,path=...`` as a dict; a missing field fails."""
    fields = dict(map(str.strip, piece.split("=", 1)) for piece in spec.split(",") if "=" in piece)
    missing = {"case_set", "arm", "round", "path"} - set(fields)
    if missing or any("=" not in piece for piece in spec.split(",")):
        raise ValueError(f"{spec!r} lacks {sorted(missing) or 'a value'}")
    return fields


def read_metadata(spark: SparkSession, path: str, columns: list[str], limit: int = 100_000) -> DataFrame:
    """The metadata columns of a store, at most ``limit`` rows; contents are not read."""
    return spark.read.parquet(path).select(*columns).limit(limit)


def web_results(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Search results as documents with conservative metadata: those without url or body are left out."""
    kept = [(r.get("title") or "", r["url"], r["body"]) for r in rows if r.get("url") and r.get("body")]
    out = spark.createDataFrame(kept, "title string, source string, content string")
    return out.withColumns({"source_type": F.lit("web"), "source_category": F.lit("web"), "evidence_status": F.lit("indirect"), "evidence_level": F.lit("unknown")})


def read_json_documents(spark: SparkSession, paths: str | list[str], schema: StructType | str) -> DataFrame:
    """Whole-file JSON documents with ``path``; a byte order mark is allowed."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths).withColumn("path", F.col("_metadata.file_path"))


def read_cases(spark: SparkSession, path: str, schema: str, key: str = "question_id") -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line fails, and of rows with one key in a file the last stays."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = lines.select(at.alias("at"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return rows.groupBy(F.col(f"r.{key}").alias("__k")).agg(F.max_by("r", "at").alias("r")).select("r.*")


def read_checkpoints(spark: SparkSession, folder: str, profile: str = "profile string", need: str = "profile") -> DataFrame:
    """Rows of saved states, oldest first by ``modified``: corrupt files and rows without profile go, ``state`` is unwrapped."""
    schema = f"state struct<{profile}>, {profile}, _bad string"
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(folder)
    rows = rows.withColumn("modified", F.col("_metadata.file_modification_time")).withColumn("path", F.col("_metadata.file_path")).where("_bad IS NULL")
    names = [f.name for f in rows.schema["state"].dataType.fields]
    return rows.select("path", "modified", *[F.coalesce(f"state.{n}", n).alias(n) for n in names]).where(F.col(need).isNotNull()).orderBy("modified", "path")


def read_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Result files ``*_retrieval_*.json`` below a folder; ``strategy`` is the payload's, else the file name's first part."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_retrieval_*.json").json(folder)
    named = F.nullif(F.regexp_extract(F.col("_metadata.file_name"), "^([A-Za-z]+)_", 1), F.lit(""))
    return rows.withColumn("path", F.col("_metadata.file_path")).withColumn("strategy", F.coalesce("strategy", named))


def read_manifest(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """(path, sha256) of the last ingest; a missing or broken manifest is empty, or the fallback's."""
    for p in filter(None, (path, fallback)):
        try:
            found = spark.read.parquet(p).select("path", "sha256")
            # footers and pages are read now, so that what is broken shows here; a manifest has one row a file
            found.agg(F.count("path"), F.count("sha256")).collect()
            return found
        except (PySparkException, Py4JJavaError):
            continue
    return spark.createDataFrame([], "path string, sha256 string")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Replace a manifest by writing aside and renaming; an empty one is one too."""
    _swap(manifest.select("path", "sha256"), path)


def write_cases(cases: DataFrame, path: str) -> None:
    """A snapshot as JSON lines in a new folder."""
    cases.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_metadata(spark: SparkSession, stats: DataFrame, path: str) -> dict:
    """One row of statistics as a JSON file beside an index."""
    row = {k: v for k, v in stats.collect()[0].asDict().items()}
    _write_text(spark, path, json.dumps(row, ensure_ascii=False, default=str, indent=2))
    return row


def save_state(spark: SparkSession, folder: str, session: str, state: dict) -> str:
    """A session's state as JSON under a name made of its letters, digits, hyphens and underscores; rewritten whole."""
    name = re.sub("[^A-Za-z0-9_-]", "_", session)[:128] or "default"
    path = f"{folder}/{name}.json"
    _write_text(spark, path, json.dumps({"state": state}, ensure_ascii=False, default=str))
    return path


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p, system = _path(spark, path)
    aside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = system.create(aside)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    system.delete(p, False)
    if not system.rename(aside, p):
        raise OSError(f"{path} can't be written")


def write_new(df: DataFrame, path: str) -> None:
    """Write JSON to a path that must not exist."""
    df.write.mode("errorifexists").json(path)


def rebuild(df: DataFrame, path: str, check: Callable[[DataFrame], bool] | None = None) -> int:
    """Replace a table: write aside, count while writing and ask ``check``, then swap; the old one returns if the swap fails.

    ``check`` gets the staged table reopened, to query it as its readers will. An empty table replaces nothing.
    """

    def valid(staged: DataFrame, n: int) -> None:
        if n == 0:
            raise ValueError("an empty table does not replace another")
        if check and not check(staged):
            raise ValueError("the staged table does not answer")

    return _swap(df, path, valid)


def _swap(df: DataFrame, path: str, valid: Callable[[DataFrame, int], None] = lambda staged, n: None) -> int:
    """Write aside, counting rows as they are written, and put the new table in the place of the old one."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    staged, kept = f"{path}.staged-{name}", f"{path}.before-{name}"
    (old, system), (new, _), (back, _) = (_path(spark, p) for p in (path, staged, kept))
    try:
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(staged)
        n = seen.get["n"]
        valid(spark.read.schema(df.schema).parquet(staged), n)
        had = system.exists(old)
        if had and not system.rename(old, back):
            raise OSError(f"{path} can't be set aside")
        if not system.rename(new, old):
            if had:
                system.rename(back, old)
            raise OSError(f"{staged} can't take the place of {path}")
        if had:
            system.delete(back, True)
        return n
    finally:
        system.delete(new, True)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(key).orderBy(F.desc_nulls_last(order))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
