"""Ranked lexical search over document-sharded postings.

A shard is a run of documents of bounded size. Its index is a CSR matrix: sorted terms, where each term's postings begin,
and the postings, each a document's place in the shard and an integer impact, computed when the index is made. A search
takes a shard at a time: an item's terms are added one after the other to a dense array of the shard's documents, the
shard's best K are picked so that ties can't be lost, and the shards' lists are merged, first in the task, then by salted
windows, then per item. Only counts of the terms that are asked for travel (df), so no shuffle moves texts or postings.

Terms are the maximal runs of ASCII letters and digits and of all characters from U+0080 on, A-Z in lower case. With N the
documents that have a term, L all terms, n a document's terms, df the documents that hold a term and tf its occurrences:
    weight = floor(1000 ln((2 N + 2) / (2 df + 1)))    m = 50 + 50 n N div L
    impact = 10^9 tf div (1000 tf + 20 m)              score = sum of weight x impact over an item's distinct terms

Defined results: null and empty texts have no terms, are never found and don't count in N; an item without terms finds
nothing; scores that tie go by ascending doc_id, null last; a repeated document row is a document of its own, a repeated
item row an item of its own; empty tables give no rows; other columns, whatever their names, are not read. Texts of any
length are indexed whole (a long one is a shard of its own).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small_batches, utf8

#: Results of an item; text of a shard; text of the items that one pass over the index takes (collected and broadcast); salts of the merge.
K, SHARD_BYTES, PASS_BYTES, SALTS = 50, 16 << 20, 32 << 20, 64
#: Fixed values of the score.
SCALE, UNIT, NORM, FLAT, SLOPE = 1_000_000_000, 1000, 20, 50, 50
#: Of each byte of UTF-8, what it is as part of a term: itself, a lower-case letter, or a space where it parts terms.
BYTES = bytes(32 if b < 128 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 128 else b for b in range(256))
_IN_TERM = np.frombuffer(BYTES, np.uint8) != 32


def terms(text: str | None) -> list[bytes]:
    return utf8(text).translate(BYTES).split()


def n_terms(text: str | None) -> int:
    inside = _IN_TERM[np.frombuffer(utf8(text), np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[:1].sum())


def totals(docs: DataFrame) -> tuple[int, int]:
    """N and L: documents that have a term, and all terms."""

    def run(batches):
        for b in batches:
            n = [n_terms(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))], pa.int64()), pa.array([sum(n)], pa.int64())], ["n", "l"])

    got = docs.select("text").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return got[0] or 0, got[1] or 0


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: the high bytes of small numbers cost next to nothing."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


SHARD = "doc_ids binary, nulls binary, terms binary, starts binary, places binary, impacts binary"
_SHARD_NAMES = [c.split()[0] for c in SHARD.split(", ")]


class Shard:
    """Documents gathered until they are packed into a row of SHARD."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        self.numbers: list[np.ndarray] = []  # by document: numbers of its distinct terms, and how often each occurs
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = terms(text)
        self.bytes += len(text or "")
        if not words:
            return
        found, known = Counter(words), self.vocabulary
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.numbers.append(np.fromiter([known.setdefault(t, len(known)) for t in found], np.int32, len(found)))
        self.counts.append(np.fromiter(found.values(), np.int64, len(found)))

    def row(self, n: int, l: int) -> pa.RecordBatch:
        names = sorted(self.vocabulary)
        order = np.empty(len(names), np.int32)
        order[[self.vocabulary[t] for t in names]] = np.arange(len(names), dtype=np.int32)
        term, tf = order[np.concatenate(self.numbers)], np.concatenate(self.counts)
        place = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(x) for x in self.numbers])
        m = np.array([FLAT + SLOPE * size * n // l for size in self.sizes], np.int64)
        impact = (SCALE * tf // (UNIT * tf + NORM * m[place])).astype(np.int32)
        by_term = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))]).astype(np.int64)
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        nulls = np.array([i is None for i in self.ids], np.uint8)
        cells = [_pack(ids), _pack(nulls), zstandard.compress(b" ".join(names), 1), _pack(starts), _pack(place[by_term]), _pack(impact[by_term])]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], _SHARD_NAMES)


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """The shards of all documents (SHARD rows, kept in the shared folder), and N."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, l = totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if shard.ids and shard.bytes + len(text or "") > shard_bytes:
                    yield shard.row(n, l)
                    shard = Shard()
                shard.add(i, text)
        if shard.ids:
            yield shard.row(n, l)

    return cut(docs.mapInArrow(run, SHARD)), n


def document_counts(shards: DataFrame, asked: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each of these terms; they are as many as the caller holds."""
    wanted = shards.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        found: Counter = Counter()
        for b in batches:
            for names, starts in zip(b.column("terms").to_pylist(), b.column("starts").to_pylist(), strict=True):
                sizes = np.diff(_unpack(starts, np.int64))
                found.update({t: int(sizes[i]) for i, t in enumerate(zstandard.decompress(names).split(b" ")) if t in wanted.value})
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["term", "df"])

    got = shards.select("terms", "starts").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in got.collect()}


def best(scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0. All that tie with the k-th are looked at; of them the smallest ids stay."""
    places = np.flatnonzero(scores > 0)
    if len(places) <= k:
        return places
    s = scores[places]
    least = s[np.argpartition(s, len(s) - k)[len(s) - k]]
    above, equal = places[s > least], places[s == least]
    order = np.lexsort((ids[equal], nulls[equal]))
    return np.concatenate([above, equal[order[: k - len(above)]]])


def _shard_search(shared, k: int):
    """For each task, each item's best k documents of the task's shards. shared holds (number, item_id, [(term, weight)])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        wanted = {t for _, _, each in asked for t, _ in each}
        held = [(np.empty(0, np.int64),) * 3 for _ in asked]  # scores, nulls, ids
        for b in batches:
            for cells in zip(*(b.column(c).to_pylist() for c in _SHARD_NAMES), strict=True):
                ids, nulls = _unpack(cells[0], np.int64), _unpack(cells[1], np.uint8).astype(np.int64)
                starts, places, impacts = _unpack(cells[3], np.int64), _unpack(cells[4], np.int32), _unpack(cells[5], np.int32)
                at = {t: i for i, t in enumerate(zstandard.decompress(cells[2]).split(b" ")) if t in wanted}
                total = np.zeros(len(ids), np.int64)
                for j, (_, _, each) in enumerate(asked):
                    total[:] = 0
                    for t, weight in each:
                        if (i := at.get(t)) is not None:
                            x, y = starts[i], starts[i + 1]
                            total[places[x:y]] += weight * impacts[x:y].astype(np.int64)  # a document once at most
                    new = best(total, nulls, ids, k)
                    if len(new):
                        both = [np.concatenate(x) for x in zip(held[j], (total[new], nulls[new], ids[new]), strict=True)]
                        kept = best(*both, k)
                        held[j] = tuple(x[kept] for x in both)
        part = TaskContext.get().partitionId()
        for (number, item_id, _), (scores, nulls, ids) in zip(asked, held, strict=True):
            if len(scores):
                n = len(scores)
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array([item_id] * n, pa.int64()), pa.array([part % SALTS] * n, pa.int32()), pa.array(ids, pa.int64(), mask=nulls.astype(bool)), pa.array(scores, pa.int64())], ["item", "item_id", "salt", "doc_id", "score"])

    return run


def _top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pass(shards: DataFrame, n: int, items: DataFrame, k: int) -> DataFrame:
    """The items of one pass against all shards."""
    held = [(i, sorted(set(terms(text)))) for i, text in zip(*(items.select(F.col("item_id").cast("long"), "text").toArrow().columns), strict=True) for i, text in [(i.as_py(), text.as_py())]]
    df = document_counts(shards, {t for _, each in held for t in each})
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    asked = [(j, i, [(t, weight[t]) for t in each if weight.get(t)]) for j, (i, each) in enumerate(held)]
    shared = shards.sparkSession.sparkContext.broadcast([x for x in asked if x[2]])  # about pass_bytes
    found = shards.mapInArrow(_shard_search(shared, k), "item long, item_id long, salt int, doc_id long, score long")
    return _top(_top(found, ["item", "salt"], k).drop("rank"), ["item"], k)


def search(shards: DataFrame, n: int, items: DataFrame, k: int = K, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents. Items are taken in passes of about pass_bytes of text."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    passes = -(-size // pass_bytes) or 1
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    found = [_pass(shards, n, items if passes == 1 else items.where(number == p), k) for p in range(passes)]
    return reduce(DataFrame.unionByName, found).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: index all documents and search them for all items."""
    shards, n = index(docs)
    return search(shards, n, items, k)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
with doc as (
  select row_number() over () as rid, doc_id, {_TERMS} as ts from documents
), total as (
  select count(*)::bigint as n, sum(len(ts))::bigint as l from doc where len(ts) > 0
), item as (
  select row_number() over () as iid, item_id, list_distinct({_TERMS}) as ts from benchmark
), asked as (
  select iid, unnest(ts) as t from item
), held as (
  select rid, t, count(*)::bigint as tf from (select rid, unnest(ts) as t from doc) where t in (select t from asked) group by rid, t
), weight as (
  select t, floor({UNIT} * ln((2 * n + 2)::double / (2 * count(*) + 1)))::bigint as w from held, total group by t, n
), norm as (
  select rid, doc_id, {FLAT} + ({SLOPE} * len(ts)::bigint * n) // l as m from doc, total where len(ts) > 0
), scored as (
  select iid, rid, sum(w * (({SCALE} * tf) // ({UNIT} * tf + {NORM} * m)))::bigint as score
  from asked join held using (t) join weight using (t) join norm using (rid) group by iid, rid
), ranked as (
  select iid, doc_id, score, row_number() over (partition by iid order by score desc, doc_id nulls last) as rank
  from scored join norm using (rid) where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked join item using (iid) where rank <= {K}
"""
