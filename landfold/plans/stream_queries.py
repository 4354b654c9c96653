"""Queries that run streams over the test tables: rows are landed as files, out of order, and read a file a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paging
from ..streaming import pages, ttl
from ..streaming.replay import remove, shared
from .queries import query, table

#: How long a value is held, and by how much a row may come late.
LIFE_MS, LATE_MS = 36 * 3_600_000, 6 * 3_600_000
#: Moves the watermark past all others.
LAST = (4_102_444_800_000, "last")


def land_late(spark: SparkSession, rows: DataFrame, at: str, path: str, files: int) -> None:
    """Rows as files in order of arrival, which is up to LATE_MS after the time in `at`, by a hash."""
    came = rows.withColumn("__came", F.col(at) + F.pmod(F.xxhash64("seq"), F.lit(LATE_MS)))
    first, last = came.agg(F.min("__came"), F.max("__came")).first()
    step = max(1, ((last or 0) - (first or 0)) // files + 1)
    for i in range(files):
        part = came.where((F.col("__came") - F.lit(first or 0)) >= i * step).where((F.col("__came") - F.lit(first or 0)) < (i + 1) * step).drop("__came")
        part.coalesce(1).write.mode("append").parquet(path)


@query(f"""
with op as (
  select cast(user_id as varchar) as key, case event_type when 'purchase' then 'put' when 'error' then 'drop' else 'get' end as op, cast(value as varchar) as value, epoch_us(cast(ts as timestamp)) // 1000 as at_ms, event_id as seq from events
), seen as (
  select *, last_value(case op when 'put' then {{'value': value, 'until': at_ms + {LIFE_MS}}} when 'drop' then {{'value': null::varchar, 'until': -1::bigint}} end ignore nulls) over (partition by key order by at_ms, seq rows unbounded preceding) as held from op
)
select key, seq as event_id, at_ms, case when held.until >= at_ms then held.value end as value from seen where op = 'get'""")
def ttl_gets(spark, sf_dir):
    ops = table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as key", "case event_type when 'purchase' then 'put' when 'error' then 'drop' else 'get' end as op", "cast(value as string) as value",
        f"cast({LIFE_MS} as bigint) as ttl_ms", "unix_millis(cast(ts as timestamp)) as at_ms", "event_id as seq",
    )
    landed, out, checkpoint = (shared(spark, f"ttl-{x}") for x in ("landed", "answers", "checkpoint"))
    land_late(spark, ops, "at_ms", landed, 4)
    spark.createDataFrame([(LAST[1], "get", None, None, LAST[0], -1)], ttl.OPERATIONS).coalesce(1).write.mode("append").parquet(landed)
    ttl.run(spark, landed, out, checkpoint, f"{LATE_MS} milliseconds", files=1).awaitTermination()
    for path in (landed, checkpoint):
        remove(spark, path)
    got = spark.read.schema(ttl.ANSWERS).parquet(out)
    return got.where(f"op = 'get' and key <> '{LAST[1]}'").select("key", F.col("seq").alias("event_id"), "at_ms", "value")


#: Of a post's comments: the cap, which replies count against too.
MOST = 9


@query(f"""
with recursive p as (
  select conv_id, turn + 1 as page, case when length(text) % 13 = 0 then null else length(text) % 9 end as n, length(text) % 3 as replies, length(text) % 7 <> 0 as more from conversations
), l as (
  select conv_id, 1::bigint as page, 0::bigint as got from p where page = 1
  union all
  select l.conv_id, l.page + 1, l.got + p.n + p.replies from l join p on p.conv_id = l.conv_id and p.page = l.page where p.n is not null and p.more and l.got < {MOST}
)
select cast(l.conv_id as varchar) as stream, l.page::int as page, unnest(range(least(p.n, {MOST} - l.got)))::int as pos, cast(unnest(range(least(p.n, {MOST} - l.got))) as varchar) as item
from l join p on p.conv_id = l.conv_id and p.page = l.page where p.n > 0 and l.got < {MOST}""")
def streamed_pages(spark, sf_dir):
    """Responses landed in any order, and admitted as the loop over a post's comments would have."""
    n = "length(text) % 9"
    body = f"""concat('{{"data":{{"comments":', if(length(text) % 13 = 0, 'null', if({n} = 0, '[]', to_json(sequence(0, {n} - 1)))), ',"has_more":', length(text) % 7 <> 0, '}},"replies":', length(text) % 3, '}}')"""
    landed, out, checkpoint = (shared(spark, f"pages-{x}") for x in ("landed", "kept", "checkpoint"))
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as string) as stream", "cast(turn + 1 as int) as page", "'' as asked", f"{body} as body")
    rows.repartition(4, F.xxhash64("stream", "page")).write.json(landed)
    own = pages.session(spark)
    stream = own.readStream.schema(pages.LANDED).option("maxFilesPerTrigger", 1).json(landed)
    reads = pages.Said("data.comments", "data.has_more", replies="replies")
    kept = pages.admitted(reads.read(stream), paging.RULES["xhs", "comments"], MOST)
    kept.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    for path in (landed, checkpoint):
        remove(spark, path)
    return spark.read.schema(pages.KEPT).parquet(out)
