"""Landed pages replayed as a stream of files, and keyed state with a time to live."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyed


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared one. Only a local master may do without a configured one."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="landfold-")
    return f"{base}/landfold/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def replay(spark: SparkSession, landed: str, schema: str, project: Callable[[DataFrame], DataFrame], store: keyed.Store, checkpoint: str, fmt: str = "json", files: int = 100) -> None:
    """Read the landed files that are new since the checkpoint, project them and upsert each micro-batch into the store.

    A batch that is repeated after a failure gives the same store, as upserts are idempotent.
    """
    pages = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(landed)
    q = project(pages).writeStream.foreachBatch(lambda batch, _: store.write(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


EVENTS = "user_id long, event_type string, value double, props string, last_modify_ts long, add_ts long, seq long"


def replay_events(spark: SparkSession, sf_dir: str, parts: int = 5) -> DataFrame:
    """The events table landed as files, not in order, and replayed one file a micro-batch into a store keyed by user."""
    landed, offsets = shared(spark, "landed"), shared(spark, "offsets")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "event_type", "value", "props", "event_id as last_modify_ts", "event_id as add_ts", "event_id as seq")
    rows.repartition(parts, F.xxhash64("seq")).write.parquet(landed)
    store = keyed.Store(spark, shared(spark, "store"), ["user_id"], ["seq"])
    replay(spark, landed, EVENTS, lambda df: df, store, offsets, "parquet", files=1)
    for path in (landed, offsets):
        remove(spark, path)
    return store.read().drop("seq")


def dedup_stream(df: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """For sinks that only append: a key once, as long as it may still come late."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


class TtlTable:
    """Keys with values until they expire: a table of (key, value, expire_at in epoch ms)."""

    DDL = "key string, value string, expire_at long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, keyed.Store(spark, path, ["key"], ["seq"])

    def put(self, rows: DataFrame, ttl_s: int, now_ms: int) -> None:
        self.store.write(rows.select("key", "value", F.lit(now_ms + ttl_s * 1000).alias("expire_at"), F.lit(now_ms).alias("seq")))

    def alive(self, now_ms: int) -> DataFrame:
        rows = self.store.read()
        rows = self.spark.createDataFrame([], self.DDL) if rows is None else rows.select("key", "value", "expire_at")
        return rows.where(F.col("expire_at") >= now_ms)

    def clear(self, now_ms: int) -> None:
        """Remove what has expired from the table itself."""
        self.store.clear(F.col("expire_at") < now_ms)

    def get(self, key: str, now_ms: int) -> DataFrame:
        return self.alive(now_ms).where(F.col("key") == key)

    def keys(self, pattern: str, now_ms: int) -> DataFrame:
        """Keys that contain the pattern without its stars."""
        return self.alive(now_ms).where(F.col("key").contains(pattern.replace("*", ""))).select("key")
