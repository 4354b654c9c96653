"""Keys with a time to live as the state of a stream.

`answers` takes a stream of operations (OPERATIONS): `put` holds a value under a key until ttl_ms later, `get` asks for it,
`drop` lets go of it. Time is the operations' own: a get answers what held at its time, whatever came late or in which
micro-batch, as long as rows are no later than `delay`. Operations wait in the state until the watermark has passed them and
are then done in order of (at_ms, seq), so that a stream that was stopped and started again gives the same answers. A value
holds up to and including its last millisecond. When that is passed, a timer lets go of it (an answer with op `expired`).

A key costs one value, one timer and its operations within the delay. What is held can be read from the checkpoint: see `held`.

Defined results: rows without key, a known op or an at_ms of the years 1 to 9999 are left out; a put without a time to live holds for ever, one that
isn't above 0 for no time at all; a put of a null value is held, and a get of it answers null.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

OPERATIONS = "key string, op string, value string, ttl_ms long, at_ms long, seq long"
ANSWERS = "key string, op string, value string, at_ms long, seq long"
#: The store that timers and several state variables need, on the executors' disks and, as change logs, in the checkpoint.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
OPS = ("put", "get", "drop")
#: Times that a date can have, from year 1 to 9999.
TIMES = (-62_135_596_800_000, 253_402_300_799_999)
FOR_EVER = (1 << 63) - 1


class Expiring(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "op string, value string, ttl_ms long, at_ms long, seq long")
        self.held = handle.getValueState("held", "value string, expire_at long")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int | None) -> None:
        """One timer for a key: the next time at which something is to be done."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = self.timer.get()[0] if self.timer.exists() else None
        new = []
        for r in rows:
            new.append((r["op"], r["value"], r["ttl_ms"], r["at_ms"], r["seq"]))
            first = r["at_ms"] if first is None else min(first, r["at_ms"])
        self.waiting.appendList(new)
        self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()  # it has gone off
        value, expires = self.held.get() if self.held.exists() else (None, None)
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((x for x in waiting if x[3] <= now), key=lambda x: (x[3], x[4] is not None, x[4] or 0))

        def gone(at: int) -> list[Row]:
            return [Row(key=key[0], op="expired", value=value, at_ms=expires, seq=None)] if expires is not None and expires < at else []

        for op, new, ttl, at, seq in due:
            if told := gone(at):
                yield from told
                value = expires = None
            if op == "get":
                yield Row(key=key[0], op="get", value=value, at_ms=at, seq=seq)
            elif op == "drop" or (ttl is not None and ttl <= 0):
                value = expires = None
            else:
                value, expires = new, FOR_EVER if ttl is None else at + ttl
        if told := gone(now):
            yield from told
            value = expires = None
        left = [x for x in waiting if x[3] > now]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if expires is None:
            self.held.clear()
        else:
            self.held.update((value, expires))
        times = [x[3] for x in left] + ([expires + 1] if expires is not None and expires < FOR_EVER else [])
        self._wake(min(times, default=None))

    def close(self) -> None:
        pass


def answers(operations: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A stream of ANSWERS to a stream of OPERATIONS (in a session with STORE)."""
    rows = operations.where(F.col("key").isNotNull() & F.col("at_ms").between(*TIMES) & F.col("op").isin(*OPS))
    timed = rows.withColumn("__at", F.timestamp_millis("at_ms")).withWatermark("__at", delay)
    return timed.groupBy("key").transformWithState(Expiring(), ANSWERS, "append", "EventTime")


def session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's that keeps stream state as `answers` needs it."""
    own = spark.newSession()
    for k, v in STORE.items():
        own.conf.set(k, v)
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own


def run(spark: SparkSession, landed: str, out: str, checkpoint: str, delay: str, files: int = 100, fmt: str = "parquet") -> StreamingQuery:
    """Answer the operations that are new in a folder, and add the answers to another, each once."""
    own = session(spark)
    operations = own.readStream.format(fmt).schema(OPERATIONS).option("maxFilesPerTrigger", files).load(landed)
    return answers(operations, delay).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, value, expire_at (epoch ms) of what the state holds after the last micro-batch."""
    state = session(spark).read.format("statestore").option("path", checkpoint).option("stateVarName", "held").load()
    return state.select("key.key", "value.value", "value.expire_at")


def keys(spark: SparkSession, checkpoint: str, pattern: str = "*") -> DataFrame:
    """Keys held that contain the pattern without its stars."""
    return held(spark, checkpoint).where(F.col("key").contains(pattern.replace("*", ""))).select("key")
