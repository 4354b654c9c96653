"""Exact nearest neighbours by a block matrix join.

The stated query set (vec_id divisible by `every`) meets all rows tile by tile. What is sent to tiles are int8 codes, with
the length of each one's rounding error, which bounds how far a product of codes is from the true one. A tile passes on the
pairs whose upper bound reaches its k-th best lower bound; heaps then merge each query's tiles, by the same rule. Only for
the pairs that survive are the original vectors fetched, products computed in double precision, and the k best kept. So
recall is 1. Of equal vectors (by a 128-bit hash) only the k + 1 with the smallest ids are candidates: no others can win a tie. Products of codes are exact at any width: they are added up over STRETCH components in float32, which holds
127 * 127 * 1,024 exactly, and over all of them in float64.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite component take no part, nor do
null vec_ids; vectors of different lengths don't meet; a repeated vec_id is a candidate like any other, only the query's
own row is left out; with too few candidates all are returned; ties go to the smaller vec_id; an empty table gives no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_PARTS, cut, partitions, small_batches

#: Rows of a tile's two sides, query rows multiplied at once within it, components added up in float32, and pairs computed at once.
QUERY_BLOCK, ROW_BLOCK, STRIP, STRETCH, PAIRS = 2_048, 8_192, 128, 1_024, 4_096


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, components added from first to last: the same for a pair wherever it is computed."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), steps, lengths of the rounding errors, and of the coded vectors; the lengths are rounded up."""
    step = np.abs(v).max(axis=1) / 127
    code = np.rint(v / step[:, None])
    length = lambda x: np.linalg.norm(x, axis=1) * (1 + 1e-9)
    return code.astype(np.int8), step, length(v - code * step[:, None]) + step * 1e-9, length(code * step[:, None])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two sets of codes, exactly."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], STRETCH):
        out += a[:, at : at + STRETCH].astype(np.float32) @ b[:, at : at + STRETCH].astype(np.float32).T
    return out


Coded = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def tile_search(q: Coded, qid: np.ndarray, c: Coded, cid: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Query and candidate numbers of the pairs that may be among a query's k best of the tile, with lower and upper bounds. Own rows (same uid) are left out."""
    (qc, qs, qe, qn), (cc, cs, ce, cn) = q, c
    for at in range(0, len(qc), STRIP):
        s = slice(at, at + STRIP)
        near = products(qc[s], cc) * qs[s, None] * cs[None, :]
        slack = qe[s, None] * (cn + ce)[None, :] + qn[s, None] * ce[None, :]
        slack += 1e-9 * (1 + np.abs(near))
        low, high = near - slack, near + slack
        own = qid[s, None] == cid[None, :]
        low[own], high[own] = -np.inf, -np.inf
        floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        row, col = np.nonzero((high >= floor[:, None]) & ~own)
        yield at + row, col, low[row, col], high[row, col]


CODED = "uid long, vec_id long, h1 long, h2 long, w long, code binary, step double, error double, length double"


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CODED rows, each vector's width among them."""
    for b in batches:
        v, widths = b.column("v"), np.asarray(pa.compute.list_value_length(b.column("v")))
        for w in np.unique(widths).tolist():
            at = np.flatnonzero(widths == w)
            code, *rest = quantise(v.take(pa.array(at)).flatten().to_numpy().reshape(len(at), w))
            yield pa.RecordBatch.from_arrays([*(pa.array(b.column(n).to_numpy()[at]) for n in ("uid", "vec_id", "h1", "h2")), pa.array(np.full(len(at), w)), pa.array([x.tobytes() for x in code], pa.binary()), *map(pa.array, rest)], [c.split()[0] for c in CODED.split(", ")])


PAIR = "query_uid long, query_id long, uid long, vec_id long, low double, high double"


def _tile(k: int):
    def run(group: pa.Table) -> pa.Table:
        asked, uid, vec = (group.column(n).to_numpy() for n in ("query", "uid", "vec_id"))
        q, c = np.flatnonzero(asked), np.flatnonzero(~asked)
        if not len(q) or not len(c):
            return pa.Table.from_pylist([], pa.schema([(n.split()[0], pa.int64() if n.endswith("long") else pa.float64()) for n in PAIR.split(", ")]))
        codes = np.frombuffer(b"".join(group.column("code").to_pylist()), np.int8).reshape(len(uid), -1)
        rest = [group.column(n).to_numpy() for n in ("step", "error", "length")]
        found = list(tile_search((codes[q], *(x[q] for x in rest)), uid[q], (codes[c], *(x[c] for x in rest)), uid[c], k))
        row, col, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_uid": uid[q[row]], "query_id": vec[q[row]], "uid": uid[c[col]], "vec_id": vec[c[col]], "low": low, "high": high})

    return run


def _survivors(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by query_uid and, falling, by upper bound. A heap holds the k best lower bounds; a pair passes if its upper bound reaches the least of them."""
        asked, heap = None, []
        for b in batches:
            uid, low, high = (b.column(n).to_pylist() for n in ("query_uid", "low", "high"))
            keep = []
            for i, (u, l, h) in enumerate(zip(uid, low, high, strict=True)):
                if u != asked:
                    asked, heap = u, []
                if len(heap) < k or h >= heap[0]:
                    keep.append(i)
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, l)
            yield b.take(pa.array(keep, pa.int64())).select(["query_uid", "query_id", "uid", "vec_id"])

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, PAIRS):
            part = b.slice(at, PAIRS)
            x, y = (part.column(n).flatten().to_numpy().reshape(part.num_rows, -1) for n in ("q", "v"))
            yield pa.RecordBatch.from_arrays([part.column("query_uid"), part.column("query_id"), part.column("vec_id"), pa.array(inner(x, y))], ["query_uid", "query_id", "vec_id", "score"])


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by query_uid; a heap keeps k of them. Nothing else is held."""
        uid, qid, heap = None, None, []

        def done() -> pa.RecordBatch:
            best = sorted(((-s, -v) for s, v in heap))
            return pa.RecordBatch.from_arrays([pa.array([qid] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([v for _, v in best], pa.int64()), pa.array([-s for s, _ in best], pa.float64())], ["query_id", "rank", "vec_id", "score"])

        for b in batches:
            for u, q, v, s in zip(*(b.column(n).to_pylist() for n in ("query_uid", "query_id", "vec_id", "score")), strict=True):
                if u != uid:
                    if uid is not None:
                        yield done()
                    uid, qid, heap = u, q, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                else:
                    heapq.heappushpop(heap, (s, -v))
        if uid is not None:
            yield done()

    return run


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k largest inner products."""
    spark = vectors.sparkSession
    small_batches(spark)
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))) & F.exists(x, lambda e: e != 0)
    kept = cut(vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("v")).withColumn("uid", F.monotonically_increasing_id()))
    total, asked = kept.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    across, down = max(1, -(-total // ROW_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    same = [F.xxhash64("v"), F.xxhash64(F.lit(1), "v")]
    coded = kept.select("uid", "vec_id", *(h.alias(n) for h, n in zip(same, ("h1", "h2"), strict=True)), "v").mapInArrow(_codes, CODED)
    dealt, tile = F.xxhash64("uid", "vec_id"), (F.col("w") * (across * down) + F.col("g") * across + F.col("h")).alias("tile")
    # of equal vectors only those with the k + 1 smallest ids (one may be the query itself) can be among the k nearest
    first = coded.withColumn("copy", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id", "uid"))).where(F.col("copy") <= k + 1).drop("copy")
    rows = first.withColumns({"query": F.lit(False), "g": F.explode(F.sequence(F.lit(0), F.lit(down - 1))), "h": F.pmod(dealt, F.lit(across))})
    asks = coded.where(F.col("vec_id") % every == 0).withColumns({"query": F.lit(True), "g": F.pmod(dealt, F.lit(down)).cast("int"), "h": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long")))})
    both = rows.unionByName(asks).select(tile, "query", "uid", "vec_id", "code", "step", "error", "length")
    n = partitions(vectors)
    found = both.repartition(max(n, min(MOST_PARTS, across * down)), "tile").groupBy("tile").applyInArrow(_tile(k), PAIR)  # a tile's size is bounded
    pairs = found.repartition(n, "query_uid").sortWithinPartitions("query_uid", F.desc("high")).mapInArrow(_survivors(k), "query_uid long, query_id long, uid long, vec_id long")
    vector = kept.select("uid", "v")
    scored = pairs.join(vector, "uid").join(vector.select(F.col("uid").alias("query_uid"), F.col("v").alias("q")), "query_uid").select("query_uid", "query_id", "vec_id", "q", "v")
    scored = scored.mapInArrow(_scored, "query_uid long, query_id long, vec_id long, score double")
    return scored.repartition(n, "query_uid").sortWithinPartitions("query_uid").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


ORACLE = """
with ok as (
  select vec_id, embedding::double[] as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
    and len(list_filter(embedding, lambda e: e <> 0)) > 0
), pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v) as score
  from ok q join ok c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""
