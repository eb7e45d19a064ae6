"""The folder that driver and executors share, and tables written there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session that names none gets a temporary folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        base = spark.sparkContext.getCheckpointDir()
    p = spark._jvm.org.apache.hadoop.fs.Path(base)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read back: what uses them several times computes them once, and a lost executor loses none."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names the state of a table's files: all their paths, sizes and times."""
    import hashlib

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system, seen = p.getFileSystem(spark._jsc.hadoopConfiguration()), hashlib.sha256()
    found = system.listFiles(p, True)
    names = []
    while found.hasNext():
        f = found.next()
        names.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    for n in sorted(names):
        seen.update(n.encode() + b"\n")
    return seen.hexdigest()
