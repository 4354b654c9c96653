"""Pages of many streams, read as they land, and admitted as the loops that asked for them would have.

A landed page is a line of JSON (LANDED): the stream it belongs to, its number, the cursor that it was asked with and the
response as text. Files may land in any order, a stream's pages may be spread over files, and a page may land twice. The
file source finds each file once; `admitted` keeps, for each stream, the number of the page that comes next, what counts
against the cap so far and the pages that landed early, so that a page's items go on exactly if the loop (operators/paging)
would have kept them, and in the order in which it would have met them. State and offsets are in the checkpoint: a query
that was killed and started again goes on where it was.

Defined results: rows without a stream or a number, or with a number below the rule's first, are left out, and so is a page
that was met before; a response that is no JSON object is a page that says nothing; a stream that misses a page waits for it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions import payload
from ..operators import keyed
from ..operators.paging import Paging, raised
from .ttl import session

LANDED = "stream string, page int, asked string, body string"
#: What a page says, beside its items (texts of JSON): see operators/paging.
SAID = "stream string, page int, items array<string>, replies int, more boolean, cursor string, total bigint, asked string"
KEPT = "stream string, page int, pos int, item string"


class Said:
    """Where a kind of response says what: paths in its JSON. Without a path, it doesn't say."""

    def __init__(self, items: str, more: str | None = None, cursor: str | None = None, total: str | None = None, replies: str | None = None):
        self.items, self.more, self.cursor, self.total, self.replies = items, more, cursor, total, replies

    def read(self, landed: DataFrame) -> DataFrame:
        """SAID of LANDED."""
        v = F.col("__v")
        at = lambda path, kind: payload.get(v, path, kind) if path else F.lit(None).cast(kind)
        items = F.transform(payload.get(v, self.items, "array<variant>"), lambda x: F.to_json(x))
        got = landed.withColumn("__v", payload.parsed(F.col("body")))
        return got.select("stream", "page", items.alias("items"), at(self.replies, "int").alias("replies"), at(self.more, "boolean").alias("more"), at(self.cursor, "string").alias("cursor"), at(self.total, "bigint").alias("total"), "asked")


class Admission(StatefulProcessor):
    """A stream's pages in order of their numbers, until its loop ends."""

    EARLY = "page int, used boolean, goes_on boolean, replies int, items array<string>"

    def __init__(self, rule: Paging, most: int):
        self.rule, self.most = rule, most

    def init(self, handle) -> None:
        self.place = handle.getValueState("place", "next int, counted long, over boolean")
        self.early = handle.getMapState("early", "page int", self.EARLY)

    def _take(self, page: int, n: int, counted: int) -> int:
        """How many of a page's items are kept; -1 if the loop doesn't ask for it."""
        rule, most, at = self.rule, self.most, page - self.rule.first + 1
        if rule.caps(most):
            return min(n, most - counted) if counted < most else -1
        if rule.cap == "page":
            return min(n, most)
        if rule.cap == "pages" and not (rule.zero_is_all and most == 0):
            return n if (at * rule.size <= raised(most, rule) if rule.fits else (at - 1) * rule.size < most) else -1
        return n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        page, counted, over = self.place.get() if self.place.exists() else (self.rule.first, 0, False)
        new = {}
        for r in rows:
            if not over and r["page"] >= page and not self.early.containsKey((r["page"],)):
                new.setdefault(r["page"], (r["page"], r["used"], r["goes_on"], r["replies"], r["items"]))
        while not over:
            told = new.pop(page, None)
            if told is None:
                if not self.early.containsKey((page,)):
                    break
                told = tuple(self.early.getValue((page,)))
                self.early.removeKey((page,))
            _, used, goes_on, replies, items = told
            items = items or []
            take = self._take(page, len(items), counted)
            over = not used or take < 0 or not goes_on
            if used and take > 0:
                for i, x in enumerate(items[:take]):
                    yield Row(stream=key[0], page=page, pos=i, item=x)
            counted += len(items) + ((replies or 0) if self.rule.cap == "replies" else 0)
            page += 1
        self.place.update((page, counted, over))
        if over:
            self.early.clear()
        else:
            for p, told in new.items():
                self.early.updateValue((p,), told)

    def close(self) -> None:
        pass


def admitted(said: DataFrame, rule: Paging, most: int = 0) -> DataFrame:
    """KEPT of a stream of SAID (in a session with the state store that ttl.STORE names)."""
    rows = said.where(F.col("stream").isNotNull() & (F.col("page") >= rule.first))
    rows = rows.withColumns({"n": F.coalesce(F.size("items"), F.lit(0)), "before": F.coalesce("asked", F.lit(""))})
    judged = rows.withColumns({"used": F.coalesce(F.expr(rule.used), F.lit(False)), "goes_on": F.coalesce(F.expr(rule.goes_on), F.lit(False))})
    return judged.select("stream", "page", "used", "goes_on", "replies", "items").groupBy("stream").transformWithState(Admission(rule, most), KEPT, "append", "None")


def collected(spark: SparkSession, landed: str, reads: Said, rule: Paging, most: int, store: keyed.Store, item: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Admit the pages that are new in a folder and upsert their items, read by the schema `item`, into a store.

    The store's order of arrival is (__page, __pos). A micro-batch that is done again gives the same store.
    """
    own = session(spark)
    pages = own.readStream.schema(LANDED).option("maxFilesPerTrigger", files).json(landed)
    kept = keyed.Store(own, store.path, store.keys, store.seq, store.policy)

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("r", F.from_json("item", item))
        kept.write(rows.select("stream", F.col("page").alias("__page"), F.col("pos").alias("__pos"), "r.*"))

    return admitted(reads.read(pages), rule, most).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
