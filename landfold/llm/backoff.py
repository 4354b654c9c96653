"""Stupid-backoff scores of all documents against n-gram counts of all documents.

Three relations, each spread by hash. Documents are read in chunks of bounded size; a chunk explodes its texts into
n-grams of every order, hashes them to 64 bits and hands each bucket of hashes the sorted, distinct ones with their
counts, packed. A bucket joins the chunks' parts into its part of the count table and returns the totals to the chunks that
asked. A chunk joins the totals to its n-grams again and sums the scores of each document. An n-gram that is everywhere
is one entry per chunk, so no key is hot; the totals are exact.

S(w | context) is count(context w) / count(context) for the longest context whose n-gram occurs at least LEAST times, and
ALPHA times the next shorter one's score otherwise; single words score count(w) / (all words).

Defined results: words are parted by U+0020 and U+0009..U+000D, with A-Z in lower case; null and empty texts have no words
and score 0; doc_ids may be null or repeat; an empty table gives no rows; other columns, whatever their names, are not read.
A chunk's texts and what it asks come from one reading, so rows may come in any order; chunks carry a checksum, and the query
fails if one is made again from other rows (after a lost executor, where the rows' order is not fixed).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, small_batches, utf8
from .mixing import WORDS, n_words

ORDER, ALPHA, LEAST = 2, 0.4, 2
#: Text of a chunk, and n-grams of a bucket, about.
CHUNK_BYTES, BUCKET_GRAMS = 8 << 20, 2_000_000
#: Multipliers of a well-known 64-bit mixer.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def grams(texts: list[str | None], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each word, for n from 1 to order, and each word's place in its text. Where the
    text hasn't enough words before, the hash is that of the longest n-gram there is."""
    words = [utf8(t).lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(x) for w in words for x in w), np.uint64, int(sizes.sum()))
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    salt = lambda n: np.uint64(n * int(_ODD[0]) % (1 << 64))
    out = [_mix(h + salt(1))]
    run = h
    for n in range(2, order + 1):
        longer = run.copy()
        longer[1:] = _mix(run[:-1] * _ODD[0] + h[1:] + np.uint64(n))
        run = np.where(place >= n - 1, longer, run)
        out.append(np.where(place >= n - 1, _mix(run + salt(n)), out[-1]))
    return out, place


def keys_of(found: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    return np.concatenate([g[place >= n] for n, g in enumerate(found)])


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: the high bytes of small numbers cost next to nothing."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of a sorted array starts; buckets are equal ranges of hashes."""
    step = (1 << 64) // buckets
    return np.concatenate([[0], np.searchsorted(keys, np.array([i * step for i in range(1, buckets)], np.uint64)), [len(keys)]]).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list, list]]:
    """(name, doc_ids, texts) of bounded runs of rows; a longer text is a chunk of its own."""
    ids, texts, size, n = [], [], 0, 0
    part = TaskContext.get().partitionId()

    def named():
        h = xxhash.xxh64()
        for i, t in zip(ids, texts, strict=True):
            h.update(f"{i}|{-1 if t is None else len(t)}|".encode())
            h.update(utf8(t))
        return f"{part}:{n}:{h.hexdigest()}", ids, texts

    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if ids and size + len(t or "") > CHUNK_BYTES:
                yield named()
                ids, texts, size, n = [], [], 0, n + 1
            ids.append(i)
            texts.append(t)
            size += len(t or "")
    if ids:
        yield named()


def _packed_texts(ids: list, texts: list[str | None]) -> bytes:
    sink = pa.BufferOutputStream()
    t = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string())})
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


PART = "bucket int, chunk string, keys binary, counts binary, data binary"


def _ask(order: int, buckets: int):
    """PART rows: for each chunk its texts (keys null), which travel by way of any bucket, and what it asks of each bucket."""

    def run(batches):
        for name, ids, texts in _chunks(batches):
            keys, counts = np.unique(keys_of(*grams(texts, order)), return_counts=True)
            at = _bounds(keys, buckets)
            full = np.flatnonzero(np.diff(at))
            parts = [(keys[at[i] : at[i + 1]], counts[at[i] : at[i + 1]].astype(np.uint32)) for i in full]
            own = xxhash.xxh32_intdigest(name) % buckets
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([name]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([_packed_texts(ids, texts)], pa.binary())], ["bucket", "chunk", "keys", "counts", "data"])
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([name] * len(full), pa.string()), pa.array([_pack(np.diff(k, prepend=np.uint64(0))) for k, _ in parts], pa.binary()), pa.array([_pack(c) for _, c in parts], pa.binary()), pa.nulls(len(full), pa.binary())], ["bucket", "chunk", "keys", "counts", "data"])

    return run


def _total(group: pa.Table) -> pa.Table:
    """One bucket: all chunks' keys and counts to the totals of those keys, for each chunk in its order; texts go on as bucket -1."""
    texts = group.filter(group.column("data").is_valid())
    group = group.filter(group.column("keys").is_valid())
    through = pa.table({"chunk": texts.column("chunk"), "bucket": pa.array([-1] * len(texts), pa.int32()), "data": texts.column("data")})
    if not len(group):
        return through
    keys = [np.cumsum(_unpack(b, np.uint64), dtype=np.uint64) for b in group.column("keys").to_pylist()]
    counts = [_unpack(b, np.uint32) for b in group.column("counts").to_pylist()]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate(counts)).astype(np.uint64)[at]
    ends = np.cumsum([len(k) for k in keys])
    told = pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "data": pa.array([_pack(s) for s in np.split(sums, ends[:-1])], pa.binary())})
    return pa.concat_tables([through, told])


def word_scores(found: list[np.ndarray], place: np.ndarray, totals: list[np.ndarray], words: int) -> np.ndarray:
    """Log scores of each word, from the totals of the n-grams that end there."""
    score = np.log(totals[0] / words)
    for n in range(1, len(found)):
        context = np.concatenate([[1], totals[n - 1][:-1]])
        seen = (place >= n) & (totals[n] >= LEAST)
        score = np.where(seen, np.log(np.maximum(totals[n], 1) / np.maximum(context, 1)), score + np.where(place >= n, np.log(ALPHA), 0.0))
    return score


def _score(order: int, words: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("bucket").to_pylist(), group.column("data").to_pylist(), strict=True))
        if not rows or rows[0][0] != -1 or (len(rows) > 1 and rows[1][0] == -1):
            raise RuntimeError("a chunk was read again with other rows")
        docs = pa.ipc.open_stream(zstandard.decompress(rows[0][1])).read_all()
        texts = docs.column("text").to_pylist()
        found, place = grams(texts, order)
        keys = np.unique(keys_of(found, place))
        totals = np.concatenate([_unpack(b, np.uint64) for _, b in rows[1:]]) if len(rows) > 1 else np.empty(0, np.uint64)
        if len(totals) != len(keys):
            raise RuntimeError("a chunk was read again with other rows")
        each = [np.where(place >= n, totals[np.minimum(np.searchsorted(keys, g), len(keys) - 1)], 0).astype(float) for n, g in enumerate(found)] if len(keys) else []
        score = word_scores(found, place, each, words) if len(keys) else np.empty(0)
        starts = np.flatnonzero(place == 0)
        sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        holds = np.flatnonzero([bool(utf8(t).split(None, 1)) for t in texts])
        if len(starts):
            sums[holds] = np.add.reduceat(score, starts)
            sizes[holds] = np.diff(np.append(starts, len(score)))
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": sizes, "log_score": sums.round(6), "mean_log_score": (sums / np.maximum(sizes, 1)).round(6)})

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm, summed over words), mean_log_score for every row of docs, scores to six places."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = docs.agg(F.coalesce(F.sum(n_words(F.col("text"))), F.lit(0))).first()[0]
    buckets = max(8, -(-order * words // BUCKET_GRAMS))
    n = partitions(docs, 2.0)  # texts and keys, packed, are about as large as the input's files
    told = docs.mapInArrow(_ask(order, buckets), PART).repartition(n, "bucket").groupBy("bucket").applyInArrow(_total, "chunk string, bucket int, data binary")
    return told.repartition(n, "chunk").groupBy("chunk").applyInArrow(_score(order, words), "doc_id long, n_words long, log_score double, mean_log_score double")


def relational_scores(docs: DataFrame) -> DataFrame:
    """The same for order 2, every step a relation of rows: words exploded, n-grams counted and joined by hash, scores summed.

    The score of a pair is found once for each distinct pair, so a frequent word meets as many rows as it has neighbours; rows
    of documents are joined with distinct pairs only, and summed by task before they travel. Exact counts, by 64-bit hashes.
    """
    words = F.coalesce(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({WORDS})")), F.array().cast("array<string>"))
    held = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.transform(words, lambda w: F.xxhash64(w)).alias("h")))
    each = held.select("rid", F.explode(F.transform("h", lambda w, i: F.struct(F.when(i > 0, F.get("h", i - 1)).alias("before"), w.alias("w")))).alias("x")).select("rid", "x.*")
    pair = F.when(F.col("before").isNotNull(), F.xxhash64("before", "w")).otherwise(F.col("w"))
    counted = cut(each.groupBy("before", "w").agg(F.count("*").alias("n")))
    ones = counted.groupBy("w").agg(F.sum("n").alias("n"))
    total = F.lit(float(held.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0]))
    of = counted.join(ones.select("w", F.col("n").alias("one")), "w").join(ones.select(F.col("w").alias("before"), F.col("n").alias("context")), "before", "left")
    alone = F.log(F.col("one") / total) + F.when(F.col("before").isNull(), 0.0).otherwise(math.log(ALPHA))
    scored = of.select(pair.alias("pair"), F.when(F.col("before").isNotNull() & (F.col("n") >= LEAST), F.log(F.col("n") / F.col("context"))).otherwise(alone).alias("score"))
    summed = each.select("rid", pair.alias("pair")).join(scored, "pair").groupBy("rid").agg(F.sum("score").alias("score"))
    n = F.size("h").cast("long")
    whole = held.join(summed, "rid", "left").select("doc_id", n.alias("n_words"), F.coalesce("score", F.lit(0.0)).alias("s"))
    return whole.select("doc_id", "n_words", F.round("s", 6).alias("log_score"), F.round(F.col("s") / F.greatest("n_words", F.lit(1)), 6).alias("mean_log_score"))


ORACLE = f"""
with split as (
  select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}'), []) as words from documents
), word as (
  select rid, unnest(words) as w, unnest(range(len(words))) as pos from split
), pair as (
  select *, lag(w) over (partition by rid order by pos) as before from word
), ones as (
  select w, count(*)::double as n from word group by w
), twos as (
  select before, w, count(*)::double as n from pair where before is not null group by before, w
), scored as (
  select p.rid, case when t.n >= {LEAST} then ln(t.n / c.n) else ln(o.n / (select count(*) from word)) + case when p.before is null then 0 else ln({ALPHA}) end end as s
  from pair p join ones o on o.w = p.w left join ones c on c.w = p.before left join twos t on t.before = p.before and t.w = p.w
), summed as (
  select rid, sum(s) as s from scored group by rid
)
select doc_id, len(words)::bigint as n_words, round(coalesce(s, 0), 6) as log_score, round(coalesce(s, 0) / greatest(len(words), 1), 6) as mean_log_score
from split left join summed using (rid)
"""
