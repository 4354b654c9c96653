"""Line dedup over levelled sorted runs of line hashes.

A store keeps runs: tables of line keys, sorted and bucketed by hash, each key with the number of documents that have it
and the largest doc_id among those of its batch. Each new batch is merge-anti-joined with every run; keys that no run has
are added as a run of their own at level 0, so runs never share a key. What the batch adds to known keys goes to a second,
small table. FANOUT runs of a level are merged into one of the next. As all runs are bucketed alike, a join with them moves
the batch only. Keys in enough documents then lose their lines in all but the largest doc_id.

The key of a line is the line without spaces at both ends, A-Z in lower case; its hash has 128 bits. Only keys of at least
LEAST_CHARS code points count.

Defined results: null and empty texts are one empty line; a null doc_id is smaller than all others; each row is a document,
also if its doc_id repeats (rows that share the largest doc_id all keep the line; whole rows that repeat are treated alike).
An empty table gives no rows. `drop_repeated` keeps all columns, whatever their names, and `line_report` reads doc_id and
text only; helper columns live in tables of their own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import bloom, probe
from .common import cut, remove, scratch, utf8

LEAST_CHARS, LEAST_DOCS, FANOUT, BATCHES = 20, 3, 2, 8
#: Lines of a bucket of a run, about.
BUCKET_LINES = 2_000_000
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
KEY = ["h1", "h2"]
LIGHT = "id long, t1 long, t2 long, h1 array<long>, h2 array<long>"


def line_key(line: bytes) -> bytes | None:
    key = line.strip().lower()
    if len(key) >= 4 * LEAST_CHARS or (len(key) >= LEAST_CHARS and len(key.decode("utf-8", "surrogatepass")) >= LEAST_CHARS):
        return key
    return None


def _digests(text: str | None) -> list[bytes | None]:
    """A hash for each line that counts."""
    h = xxhash.xxh3_128_digest
    return [None if (k := line_key(line)) is None else h(k) for line in utf8(text).split(b"\n")]


def _split(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


def _row_keys(b: pa.RecordBatch, texts: list[str | None]) -> np.ndarray:
    """Each row's doc_id, which is in the last column, and a 128-bit hash of its text: rows alike in these are treated alike."""
    ids = [NO_ID if i is None else i for i in b.column(b.num_columns - 1).to_pylist()]
    return np.concatenate([np.array(ids, np.int64).reshape(-1, 1), _split([xxhash.xxh3_128_digest(utf8(t)) for t in texts])], 1)


def lines_of(docs: DataFrame) -> DataFrame:
    """LIGHT rows: each document's distinct line hashes, where it has any that count."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            each = [{d for d in _digests(t) if d is not None} for t in texts]
            rows = np.flatnonzero([bool(ds) for ds in each])
            if not len(rows):
                continue
            keys = _row_keys(b, texts)[rows]
            flat, ends = _split([d for i in rows for d in each[i]]), np.cumsum([0, *(len(each[i]) for i in rows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, i]) for i in range(3)), *(pa.ListArray.from_arrays(ends, flat[:, i]) for i in range(2))], ["id", "t1", "t2", "h1", "h2"])

    return docs.select("text", F.col("doc_id").cast("long").alias("id")).mapInArrow(hashed, LIGHT)


def line_counts(light: DataFrame) -> DataFrame:
    """h1, h2, n, last: each key with its number of documents and the largest doc_id; partial sums keep a line that is everywhere to a row per task."""
    return light.select("id", F.inline(F.arrays_zip("h1", "h2"))).groupBy(*KEY).agg(F.count("*").alias("n"), F.max("id").alias("last"))


class LineRuns:
    """The runs of a store; the driver holds their names and levels only."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout, self.root = spark, fanout, scratch(spark, "lines")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []
        self.again: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        """A sorted, bucketed table of rows, a file for each bucket."""
        name = f"landfold_run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        remove(self.spark, f"{self.root}/{name}")

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of batch (h1, h2, ...) whose key no run has: a merge anti-join with each run."""
        for _, name in self.runs:
            batch = batch.join(self.spark.table(name).select(*KEY), KEY, "left_anti")
        return batch

    def add(self, light: DataFrame) -> None:
        """Add a batch of documents (LIGHT rows): its new keys as a run, the known ones to the second table; then merge levels that are full."""
        batch = line_counts(light)
        fresh = self._write(self.unseen(batch))
        if self.runs:
            self.again.append(self._write(batch.join(self.spark.table(fresh).select(*KEY), KEY, "left_anti")))
        self.runs.append((0, fresh))
        level = 0
        while len(full := [name for l, name in self.runs if l == level]) >= self.fanout:
            merged = self._write(self._union(full))
            self.runs = [(l, name) for l, name in self.runs if name not in full] + [(level + 1, merged)]
            for name in full:
                self._drop(name)
            level += 1

    def _union(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def keys(self, least: int = 1) -> DataFrame:
        """h1, h2, n, last of the keys that at least `least` documents have. No run shares a key with another, so only what was seen again is summed."""
        if not self.runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long, last long")
        own = self._union([name for _, name in self.runs])
        if self.again:
            more = self._union(self.again).groupBy(*KEY).agg(F.sum("n").alias("more"), F.max("last").alias("later"))
            own = own.join(more, KEY, "left").select(*KEY, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "later").alias("last"))
        return own.where(F.col("n") >= least)

    def drop(self) -> None:
        for name in [*(name for _, name in self.runs), *self.again]:
            self._drop(name)
        remove(self.spark, self.root)
        self.runs, self.again = [], []


def _report(text: str | None, drop: set[bytes]) -> tuple[int, int, bytes]:
    lines = utf8(text).split(b"\n")
    kept = [line for line, d in zip(lines, _digests(text), strict=True) if d is None or d not in drop] if drop else lines
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def drops(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """id, t1, t2, gone (array of binary): the line hashes that documents lose, where they lose any. Batches are dealt by hash of doc_id."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "light")
    lines_of(docs).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    light = spark.read.schema(f"{LIGHT}, batch int").parquet(path)
    lines = light.agg(F.coalesce(F.sum(F.size("h1")), F.lit(0))).first()[0]
    store = LineRuns(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // BUCKET_LINES)))
    try:
        for i in range(batches):
            store.add(light.where(F.col("batch") == i))
        repeated = cut(store.keys(LEAST_DOCS).select(*KEY, "last"))
    finally:
        store.drop()
    each = light.select("id", "t1", "t2", F.inline(F.arrays_zip("h1", "h2"))).join(repeated, KEY).where("last <> id")
    digest = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in KEY)))
    out = cut(each.select("id", "t1", "t2", digest.alias("d")).groupBy("id", "t1", "t2").agg(F.collect_set("d").alias("gone")))
    remove(spark, path)
    return out


def _judged(docs: DataFrame, batches: int) -> tuple[DataFrame, DataFrame]:
    """docs in two parts: rows that surely lose nothing, and the others with __gone (null if they lose nothing after all). Only the latter are shuffled."""
    spark, gone = docs.sparkSession, drops(docs, batches)
    bits = spark.sparkContext.broadcast(bloom(gone.select("id", "t1")))
    carried = docs.select("*", F.col("doc_id").cast("long").alias(f"id_{uuid.uuid4().hex}"))
    schema = docs.schema

    def sure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            maybe = probe(bits.value, _row_keys(b, b.column("text").to_pylist())[:, :2])
            yield b.filter(pa.array(~maybe)).select(range(b.num_columns - 1))

    def doubtful(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            keys = _row_keys(b, b.column("text").to_pylist())
            at = pa.array(np.flatnonzero(probe(bits.value, keys[:, :2])))
            left = b.take(at)
            rest = pa.StructArray.from_arrays([left.column(i) for i in range(left.num_columns - 1)], fields=[left.schema.field(i) for i in range(left.num_columns - 1)])
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, i]).take(at) for i in range(3)), rest], ["id", "t1", "t2", "row"])

    whole = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "t1", "t2")] + [T.StructField("row", schema)])
    plain = carried.mapInArrow(sure, schema)
    hit = carried.mapInArrow(doubtful, whole).join(gone, ["id", "t1", "t2"], "left").select("row", "gone")
    return plain, hit


def line_report(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs."""

    @F.pandas_udf("n_lines long, n_dropped long, kept_sha256 string")
    def report(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = (_report(t, set() if d is None else set(d)) for t, d in zip(texts, gone, strict=True))
        return pd.DataFrame([(n, k, hashlib.sha256(kept).hexdigest()) for n, k, kept in rows], columns=["n_lines", "n_dropped", "kept_sha256"])

    plain, hit = _judged(docs.select("doc_id", "text"), batches)
    both = plain.withColumn("gone", F.lit(None).cast("array<binary>")), hit.select("row.*", "gone")
    return both[0].unionByName(both[1]).select("doc_id", report("text", "gone").alias("r")).select("doc_id", "r.*")


def drop_repeated(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with the repeated lines taken out of text (and n_chars counted again where there is such a column)."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([t if d is None else _report(t, set(d))[2].decode("utf-8", "surrogatepass") for t, d in zip(texts, gone, strict=True)], dtype=object)

    names = docs.columns  # others than these three go by place, whatever they are called
    plain, hit = _judged(docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"__{i}" for i, c in enumerate(names))), batches)
    text = kept("row.text", "gone")
    columns = {c: F.col(f"row.`{c}`") for c in plain.columns}
    columns["text"] = F.col("__text")
    if "n_chars" in names:
        columns["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("__text")).cast(docs.schema["n_chars"].dataType)
    return plain.unionByName(hit.withColumn("__text", text).select(*(v.alias(c) for c, v in columns.items()))).toDF(*names)


ORACLE = rf"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), lines as (
  select rid, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from docs
), keyed as (
  select rid, doc_id, line, pos,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), repeated as (
  select key, max(doc_id) as last from (select distinct rid, doc_id, key from keyed where length(key) >= {LEAST_CHARS})
  group by key having count(*) >= {LEAST_DOCS}
), judged as (
  select k.*, (r.key is not null and k.doc_id is distinct from r.last) as gone from keyed k left join repeated r on r.key = k.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by rid, doc_id
"""
