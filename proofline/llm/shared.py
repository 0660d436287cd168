"""Folders, tables and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints/proofline"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a session on one machine may do without; on a cluster a missing
    setting is an error, as executors can't see each other's folders.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{DEFAULT_CHECKPOINT_DIR}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, never used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: the table survives lost executors and several consumers read it
    without computing it again.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` made and that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark).removeprefix("file://")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done: it does so once the driver has collected what refers to them."""
    for _ in range(2):  # what the first round finalises, the second one frees
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand Python at most so many rows and bytes at once, so a batch of long texts fits in a worker.

    Only limits above these are lowered. They stay lowered in the session, as Spark reads them when the caller runs the result.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        have = spark.conf.get(name, None)
        size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(have) if have else 0
        if not 0 < size <= most:
            spark.conf.set(name, str(most))


def drawn(key: Column, share: float) -> Column:
    """Whether a row belongs to a sample of about ``share`` of all, decided by a hash of ``key``; exact for any share above 2**-62."""
    if share >= 1:
        return F.lit(True)
    return F.shiftright(F.xxhash64(key, F.lit("drawn")), 1) + F.lit(1 << 62) < F.lit(int(share * (1 << 63)))


def nested(docs: DataFrame, *columns: Column) -> DataFrame:
    """The rows of ``docs`` as one struct column ``row`` beside ``columns``, so no name of theirs can clash; ``row.*`` is the way back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)
