"""Shared folder, table materialisation, joins with small sides, two-level running sums."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``), with its file system.

    Only a local session that names none gets a temporary folder of this machine; elsewhere executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        base = spark.sparkContext.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def arrow_path(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system and path of a file below the shared folder."""
    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


#: Rows of at most a few numbers or names that may be sent to every task.
SMALL = 1_000_000


def join_small(rows: DataFrame, small: DataFrame, on: Column | list[str], how: str = "left", most: int = SMALL) -> DataFrame:
    """Join with a side of one slim row a key: sent to every task after its rows are counted, else dealt by key."""
    return rows.join(F.broadcast(small) if small.count() <= most else small.hint("merge"), on, how)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"


#: Spark removes a query's shuffle files when it has ended, if this is set while the query is planned.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends in files that survive a lost executor.

    The shuffle files of the write go at once; nothing reads them again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p.getParent(), True)


def running_sum(df: DataFrame, part: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over earlier rows of ``part``, by bucket and then ``order``, without gathering a part in one task.

    Each bucket is summed alone and shifted by the total of the part's earlier buckets; only one small row a
    bucket meets in a part's window. Buckets should be fine enough that one fits in a task.
    """
    dealt = df.withColumn("__b", bucket).withColumn("__v", value)
    near = W.partitionBy(*part, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = dealt.withColumn("__in", F.coalesce(F.sum("__v").over(near), F.lit(0)))
    sizes = dealt.groupBy(*part, "__b").agg(F.sum("__v").alias("__n"))
    before = W.partitionBy(*part).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select(*part, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    cond = F.lit(True)
    for c in [*part, "__b"]:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    kept = [F.col(f"l.{c}") for c in df.columns]
    return inner.alias("l").join(shift.alias("r"), cond, "left").select(*kept, (F.col("__in") + F.col("__shift")).alias(out))
