"""Keyed upserts and first/last selections: declarative forms of one-row-at-a-time stores.

`seq` is a column (or several) that gives the order of arrival. Rows of a key are reduced by min_by/max_by aggregates,
which combine before the shuffle, so a hot key sends one row per task.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Policy:
    """Columns that an update overwrites (None: all), and those set by the first row only."""

    overwrite: tuple[str, ...] | None = None
    first: tuple[str, ...] = ("add_ts",)
    skip_null: bool = False  # absent keys survive: a null doesn't overwrite
    never: tuple[str, ...] = ()  # columns that are always null
    #: An SQL condition that a row must meet to be inserted as a new key; updates need not.
    insert_if: str | None = None
    #: Columns in which a null with this other column true overwrites, although skip_null holds: {column: column that tells it was given}.
    given: tuple[tuple[str, str], ...] = ()

    def takes_new(self, column: str) -> bool:
        return column not in self.first and (self.overwrite is None or column in self.overwrite)


OVERWRITE_ALL = Policy()
MERGE_PRESENT = Policy(skip_null=True)
#: Which columns an update changes, for tables that keep the rest as first seen.
XHS_NOTE = Policy(("last_modify_ts", "liked_count", "collected_count", "comment_count", "share_count", "last_update_time"))
XHS_COMMENT = Policy(("last_modify_ts", "like_count", "sub_comment_count"))
#: A post needs a title to be inserted; and one that leaves add_ts null.
DOUYIN_CONTENT = Policy(insert_if="coalesce(title, '') <> ''")
TIEBA = Policy(never=("add_ts",))
XHS_CREATOR = Policy(("last_modify_ts", "nickname", "avatar", "desc", "follows", "fans", "interaction", "tag_list"))


def _order(seq: list[str]):
    """What rows are put in order by; a single column stays plain, so that it is aggregated by hash."""
    return F.col(seq[0]) if len(seq) == 1 else F.struct(*seq)


#: Beside a stored row: seq of its first row, and with skip_null of what each column holds. With these, batches may come in any order.
FIRST, EACH = "__at", "__at_"


def _told(policy: Policy, c: str, side: str = "") -> Column:
    """Whether a row says something about a column."""
    flag = dict(policy.given).get(c)
    told = F.col(f"{side}{c}").isNotNull()
    return told | F.coalesce(F.col(f"{side}{flag}"), F.lit(False)) if flag else told


def collapse(batch: DataFrame, keys: list[str], seq: list[str], policy: Policy = OVERWRITE_ALL, marks: bool = False) -> DataFrame:
    """One row per key, as if its rows had been stored one after the other in order of seq. Rows with a null key are skipped.

    With insert_if, rows before the first that meets it are skipped too. marks: with FIRST and EACH columns.
    """
    order, whole = _order(seq), F.struct(*seq)
    rest = [c for c in batch.columns if c not in keys]
    alive = batch.where(" and ".join(f"`{k}` is not null" for k in keys))
    if policy.insert_if:
        opened = alive.where(policy.insert_if).groupBy(*keys).agg(F.min(whole).alias("__open"))
        alive = alive.join(opened, keys).where(whole >= F.col("__open"))

    def last(c: str) -> Column:
        return F.max_by(c, F.when(_told(policy, c), order) if policy.skip_null else order)

    picked = [(F.max(c) if [c] == seq else last(c) if policy.takes_new(c) else F.min_by(c, order)).alias(c) for c in rest]
    if marks:
        picked.append(F.min(whole).alias(FIRST))
        picked += [F.max(F.when(_told(policy, c), whole)).alias(EACH + c) for c in rest if policy.skip_null and policy.takes_new(c)]
    out = alive.groupBy(*keys).agg(*picked)
    kept = [F.lit(None).cast(batch.schema[c].dataType).alias(c) if c in policy.never else F.col(c) for c in batch.columns]
    return out.select(*kept, *(c for c in out.columns if c not in batch.columns))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], seq: list[str], policy: Policy = OVERWRITE_ALL) -> DataFrame:
    """target after batch. What the later row by seq says holds, and first-row columns are the earlier one's. One full outer
    join on the keys; columns that only one side has are kept. A target with marks may meet batches in any order; without
    them a stored row is taken to be as old as its seq says, or older than the batch if it has no seq.
    """
    loose = replace(policy, insert_if=None)
    if policy.insert_if:  # keys that are there take every row; new ones wait for one that may be inserted
        known = target.select(*keys).distinct()
        new = collapse(batch.join(known, keys, "left_semi"), keys, seq, loose, True).unionByName(collapse(batch.join(known, keys, "left_anti"), keys, seq, policy, True))
    else:
        new = collapse(batch, keys, seq, loose, True)
    marked = FIRST in target.columns
    columns = [*target.columns, *(c for c in new.columns if c not in target.columns and not c.startswith(FIRST))]
    a, b = target.withColumn("__old", F.lit(True)).alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    both, only_new = F.col("__old").isNotNull() & F.col("__new").isNotNull(), F.col("__old").isNull()
    at = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in seq))
    late = F.coalesce(at("a") > at("b"), F.lit(False)) if all(c in target.columns for c in seq) else F.lit(False)
    first = F.col(f"b.{FIRST}") < F.col(f"a.{FIRST}") if marked else late

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"a.{c}", f"b.{c}").alias(c)
        if c not in new.columns:
            return F.col(f"a.{c}").alias(c)
        if c not in target.columns:
            return F.col(f"b.{c}").alias(c)
        if c == FIRST:
            return F.least(f"a.{c}", f"b.{c}").alias(c)
        if c.startswith(EACH):
            return F.greatest(f"a.{c}", f"b.{c}").alias(c)
        if not policy.takes_new(c):
            fresh = first
        elif not policy.skip_null or c in seq:
            fresh = ~late
        elif marked:
            fresh = F.coalesce(F.col(f"b.{EACH}{c}") >= F.col(f"a.{EACH}{c}"), F.col(f"b.{EACH}{c}").isNotNull())
        else:
            fresh = _told(policy, c, "b.") & ~(late & _told(policy, c, "a."))
        return F.when(only_new | (both & fresh), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    return a.join(b, on, "full_outer").select(*(pick(c) for c in columns))


#: Parts of a store, by key hash.
BUCKET, BUCKETS = "__bucket", 64


class Store:
    """A keyed table in a folder. A version is a small file that names the folder of each bucket of keys; an upsert makes
    the buckets that it touches anew, beside the old ones, and then writes the next version."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], seq: list[str], policy: Policy = OVERWRITE_ALL):
        self.spark, self.path, self.keys, self.seq, self.policy = spark, path.rstrip("/"), keys, seq, policy
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(path).getFileSystem(conf)

    def _names(self, start: str) -> list[str]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at(self.path)))
        return sorted(n for n in names if n.startswith(start))

    def _version(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def _read(self, version: dict, buckets=None) -> DataFrame:
        schema = T.StructType.fromJson(version["schema"])
        paths = [f"{self.path}/{folder}/{BUCKET}={b}" for b, folder in version["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """All rows; None for a store that has not been written."""
        v = self._names("v")
        if not v:
            return None
        rows = self._read(self._version(v[-1]))
        return rows.drop(*(c for c in rows.columns if c.startswith(FIRST)))

    def write(self, batch: DataFrame) -> None:
        """Upsert a batch; rows may come in any order of seq, and batches too."""
        v = self._names("v")
        if not v:
            self._publish(collapse(batch, self.keys, self.seq, self.policy, True), {}, 0)
            return
        old = self._version(v[-1])
        touched = {r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect()}  # BUCKETS numbers at most
        rest = {b: folder for b, folder in old["buckets"].items() if int(b) not in touched}
        self._publish(upsert(self._read(old, touched), batch, self.keys, self.seq, self.policy), rest, int(v[-1][1:]) + 1)

    def clear(self, gone: Column) -> None:
        """Remove the rows that meet a condition, as a new version."""
        if v := self._names("v"):
            self._publish(self._read(self._version(v[-1])).where(~F.coalesce(gone, F.lit(False))), {}, int(v[-1][1:]) + 1)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k) for k in self.keys)), F.lit(BUCKETS)).cast("int")

    def _publish(self, rows: DataFrame, rest: dict[str, str], number: int) -> None:
        """The next version: buckets of these rows, and the rest as they are. Older versions go but for the last, which may still be read."""
        folder = f"data-{uuid.uuid4().hex}"
        # in order of the keys, so that the bounds of row groups tell which may hold one
        rows.withColumn(BUCKET, self._bucket()).sortWithinPartitions(BUCKET, *self.keys).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        made = (s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/{folder}")))
        buckets = rest | {n.split("=")[1]: folder for n in made if n.startswith(f"{BUCKET}=")}
        out = self._fs.create(self._at(f"{self.path}/.new-{folder}"))
        out.write(json.dumps({"schema": rows.schema.jsonValue(), "buckets": buckets}).encode())
        out.close()
        self._fs.rename(self._at(f"{self.path}/.new-{folder}"), self._at(f"{self.path}/v{number:09d}"))
        *old, _ = self._names("v")
        for v in old[:-1]:
            self._fs.delete(self._at(f"{self.path}/{v}"), False)
        used = {x for v in self._names("v") for x in self._version(v)["buckets"].values()} | {folder}
        for n in self._names("data-"):
            if n not in used:
                self._fs.delete(self._at(f"{self.path}/{n}"), True)

    def find(self, limit: int = 0, **equal) -> DataFrame | None:
        """Rows equal in all the given columns; 0 is no limit. None for a store that has not been written.

        With all keys given only their bucket is read, and in it the row groups whose bounds hold the key.
        """
        v = self._names("v")
        if not v:
            return None
        version = self._version(v[-1])
        rows = self._read(version, self._bucket_of(version, equal))
        rows = rows.drop(*(c for c in rows.columns if c.startswith(FIRST))).where(_conjunction(equal))
        return rows.limit(limit) if limit else rows

    def _bucket_of(self, version: dict, equal: dict) -> set[int] | None:
        """The bucket of the given keys; None where they aren't all given. A null key is in none."""
        if not all(k in equal for k in self.keys):
            return None
        if any(equal[k] is None for k in self.keys):
            return set()
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(version["schema"])}
        one = self.spark.range(1).select(*(F.lit(equal[k]).try_cast(kinds[k]).alias(k) for k in self.keys))
        return {one.select(self._bucket()).first()[0]}


def _conjunction(equal: dict):
    cond = F.lit(True)
    for k, v in equal.items():
        cond = cond & F.col(k).eqNullSafe(F.lit(v))
    return cond


def dedup_first(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The first row of each key in order of arrival; null keys and '' don't count."""
    return _one(df, keys, F.min_by, seq)


def dedup_latest(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    return _one(df, keys, F.max_by, seq)


def _one(df: DataFrame, keys: list[str], by, seq: list[str]) -> DataFrame:
    """A row per key, found by a window of one place, which each task cuts before the shuffle."""
    alive = df.where(" and ".join(f"`{k}` is not null and cast(`{k}` as string) <> ''" for k in keys))
    order = [F.col(c).desc() if by is F.max_by else F.col(c).asc() for c in seq]
    return alive.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def first_n(df: DataFrame, parent: list[str], seq: list[str], n: int) -> DataFrame:
    """The first n rows of each parent (a window group limit: each task passes on n rows per parent at most)."""
    w = W.partitionBy(*parent).orderBy(*seq)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def daily_cap(df: DataFrame, keyword: str, day: str, seq: list[str], per_day: int, total: int) -> DataFrame:
    """At most per_day rows of each keyword and day and, days ascending, at most total rows of the keyword."""
    capped = first_n(df, [keyword, day], seq, per_day)
    return first_n(capped, [keyword], [day, *seq], total)
