"""Shared helpers: reading tables, cutting lineage, whitespace rules."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract here: space and U+0009..U+000D.
SEPARATORS = "\\x20\\x09-\\x0D"
#: Of an Arrow batch; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
#: Of a part of a shuffle, about, and how many parts a size may ask for.
PART_BYTES, MOST_PARTS = 256 << 20, 20_000
#: Of a frame of a few numbers a row, what one task reads back.
ROWS_A_TASK = 1 << 18


def small_batches(spark: SparkSession) -> None:
    """Bound what is handed to Python at once by bytes, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is configured and the master is local."""
    small_batches(spark)
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="landfold-")
    if not held.isDefined():
        sc.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: no recomputing, and lost executors cost nothing.

    With spark.cleaner.referenceTracking.cleanCheckpoints the files go when the JVM drops the frame; else with the folder.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def narrow(df: DataFrame) -> DataFrame:
    """cut, for rows of a few numbers: as many tasks read them back as the rows ask for, not as many as wrote them."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-seen.get["n"] // ROWS_A_TASK)))


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner take the shuffle and checkpoint files that only dead frames hold; by itself it waits until the driver's heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(df: DataFrame, times: float = 1.0) -> int:
    """How many parts a shuffle of `times` the planned size of df should have: as the session says, or more, so that a part
    has about PART_BYTES. A size that the planner doesn't know (it then says an absurd one) asks for no more."""
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    planned = planned if planned < 1 << 55 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, int(planned * times) // PART_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/landfold/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def by_name(c: str) -> Column:
    """A column of any name."""
    return F.col("`" + c.replace("`", "``") + "`")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def give_back() -> None:
    """Hand memory that this process no longer uses back to the system: workers are used again by the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)
