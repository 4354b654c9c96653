"""Queries that put the test tables into a database batch by batch, or into workbooks, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyed
from ..sources import database, workbook
from ..streaming.replay import shared
from .queries import query, table


def stored(spark: SparkSession, name: str, batches: list[DataFrame], keys: list[str], seq: list[str], policy: keyed.Policy) -> database.Database:
    """A new database file in the shared folder, after these batches."""
    db = database.Database.sqlite(shared(spark, name) + ".db")
    for b in batches:
        database.upsert(b, db, name, keys, seq, policy)
    return db


def _items(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Events as updates of their users, in three batches."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_type as title", "value as liked_count", "props", "event_id as last_modify_ts", "event_id as add_ts", "event_id as seq")
    return [e.where(f"if(seq >= 900, 2, seq % 3) = {i}") for i in range(3)]


#: Rows in the order in which they were stored: batch after batch, by event in each.
STORED = "(select *, case when event_id >= 900 then 2 else event_id % 3 end as batch from events)"
LAST = FIRST = "row(batch, event_id)"


@query(f"""
select user_id, arg_max(event_type, {LAST}) as title, arg_max(value, {LAST}) as liked_count, arg_max(props, {LAST}) as props, arg_max(event_id, {LAST}) as last_modify_ts, arg_min(event_id, {FIRST}) as add_ts
from {STORED} group by user_id""")
def database_overwrite(spark, sf_dir):
    db = stored(spark, "items", _items(spark, sf_dir), ["user_id"], ["seq"], keyed.OVERWRITE_ALL)
    return database.scan(spark, db, "items", "user_id long, title string, liked_count double, props string, last_modify_ts long, add_ts long", partitionColumn="user_id", partitions=4)


@query(f"""
select user_id, arg_min(event_type, {FIRST}) as title, arg_max(value, {LAST}) as liked_count, arg_min(props, {FIRST}) as props, arg_min(event_id, {FIRST}) as add_ts
from {STORED} group by user_id having arg_max(value, {LAST}) > 20 and user_id >= 10""")
def database_partial(spark, sf_dir):
    """The update of some columns only; the condition runs in the database."""
    db = stored(spark, "notes", _items(spark, sf_dir), ["user_id"], ["seq"], keyed.XHS_NOTE)
    rows = database.scan(spark, db, "notes", "user_id long, title string, liked_count double, props string, add_ts long")
    return rows.where("liked_count > 20 and user_id >= 10")


@query(f"""
with titled as (select *, min(case when event_type <> 'view' then {FIRST} end) over (partition by user_id) as opened from {STORED})
select user_id, arg_max(case when event_type = 'view' then '' else event_type end, {LAST}) as title, arg_max(value, {LAST}) as liked_count, arg_min(event_id, {FIRST}) as add_ts
from titled where {FIRST} >= opened group by user_id""")
def database_titled(spark, sf_dir):
    """New keys need a title; updates don't."""
    batches = [b.selectExpr("user_id", "if(title = 'view', '', title) as title", "liked_count", "add_ts", "seq") for b in _items(spark, sf_dir)]
    db = stored(spark, "posts", batches, ["user_id"], ["seq"], keyed.DOUYIN_CONTENT)
    return database.scan(spark, db, "posts", "user_id long, title string, liked_count double, add_ts long")


@query("select cast(doc_id as varchar) as doc_id, lang, nullif(source, '') as source, cast(n_chars as varchar) as n_chars, case when length(text) > 2000 then 'TRUE' else 'FALSE' end as long from documents")
def workbook_rows(spark, sf_dir):
    """Documents' attributes as workbooks of 300 rows, and the rows that are read from these."""
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", (F.length("text") > 2000).alias("long"))
    rows = workbook.found(workbook.books(df, "doc_id", "documents", 300)).where("cells is not null")
    return rows.select(*(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(df.columns)))
