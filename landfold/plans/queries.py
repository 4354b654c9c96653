"""Queries over the driver's tables and the SQL that says the same. Roles: documents are posts, conversations comments
(conv_id the post, turn the order of arrival), pages raw HTML, events updates of items, labels sparse attributes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import casts, joins, keyed, schemas, segments, text
from ..session import prepare
from ..sources import files
from . import projections as P

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
STOP = ("the", "of", "and", "la", "de", "der", "die")


def _stop(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP], "word string")


@query(f"select word, count(*) as n from (select unnest({TOKENS}) as word from documents) group by word")
def word_freq(spark, sf_dir):
    return text.word_freq(table(spark, sf_dir, "documents"), text.words(F.col("text")))


@query(f"""
with w as (select doc_id, {TOKENS} as w from documents),
one as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from w),
counted as (select word, count(*) as n, min(row(doc_id, pos)) as first from one where word not in {STOP} group by word)
select word, n from counted order by n desc, first limit 20""")
def top20_words(spark, sf_dir):
    return text.top_words(table(spark, sf_dir, "documents"), text.words(F.col("text")), "doc_id", 20, _stop(spark))


@query()
def segmented_words(spark, sf_dir):
    """Words of runs without spaces, under a dictionary of the texts' own words."""
    docs = table(spark, sf_dir, "documents")
    return segments.word_freq(docs, "text", segments.learned(docs, "text", 50_000, 5))


@query("select event_id, ts, user_id, event_type, value, props from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def dedup_latest(spark, sf_dir):
    return keyed.dedup_latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])


@query("select event_id, ts, user_id, event_type, value, props from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) where rn = 1")
def dedup_first(spark, sf_dir):
    return keyed.dedup_first(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])



def _items(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id", "event_type", "value", "props", "event_id as last_modify_ts", "event_id as add_ts", "event_id as seq")


@query("""
select user_id, arg_min(event_type, event_id) as event_type, arg_max(value, event_id) as value, arg_min(props, event_id) as props,
  max(event_id) as last_modify_ts, min(event_id) as add_ts from events group by user_id""")
def upsert_partial(spark, sf_dir):
    policy = keyed.Policy(overwrite=("value", "last_modify_ts", "seq"))
    return keyed.collapse(_items(spark, sf_dir), ["user_id"], ["seq"], policy).drop("seq")


@query("""
select user_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value, arg_max(props, event_id) as props,
  max(event_id) as last_modify_ts, min(event_id) as add_ts from events group by user_id""")
def upsert_overwrite(spark, sf_dir):
    items = _items(spark, sf_dir)
    late = "seq >= 500"
    old = keyed.collapse(items.where(f"not ({late})"), ["user_id"], ["seq"])
    return keyed.upsert(old, items.where(late), ["user_id"], ["seq"]).drop("seq")


@query("""
select user_id, coalesce(arg_max(value, event_id) filter (where event_type = 'purchase'), arg_max(value, event_id) filter (where event_type <> 'purchase' and event_id < 0)) as value,
  max(event_id) as seq from events group by user_id""")
def upsert_present_keys(spark, sf_dir):
    items = _items(spark, sf_dir).select("user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"), "seq")
    old = keyed.collapse(items.where("seq < 500"), ["user_id"], ["seq"], keyed.MERGE_PRESENT)
    return keyed.upsert(old, items.where("seq >= 500"), ["user_id"], ["seq"], keyed.MERGE_PRESENT)


@query("select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn) as rn from conversations) where rn <= 3")
def first_n_per_parent(spark, sf_dir):
    return keyed.first_n(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 3)


@query("""
with a as (select *, cast(ts as date) as day from events),
b as (select *, row_number() over (partition by event_type, day order by event_id) as k from a),
c as (select *, row_number() over (partition by event_type order by day, event_id) as n from b where k <= 5)
select event_id, event_type, day from c where n <= 60""")
def daily_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return keyed.daily_cap(e, "event_type", "day", ["event_id"], 5, 60).select("event_id", "event_type", "day")


@query("select event_id from (select event_id, row_number() over (order by event_id desc) as rn from events) where rn <= 500")
def last_500(spark, sf_dir):
    return text.log_tail(table(spark, sf_dir, "events").select("event_id"), "event_id", 500)


@query("select d.doc_id, d.source, coalesce(l.quality, -1) as quality, coalesce(l.toxic, -1) as toxic from documents d left join labels l on d.doc_id = l.doc_id")
def author_left_join(spark, sf_dir):
    joined = joins.with_author(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")
    return joined.select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def orphan_comments(spark, sf_dir):
    return joins.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("select c.conv_id, c.turn, p.turn as parent_turn, p.role as parent_role from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1")
def reply_tree(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return joins.to_parent(c, ["conv_id"], "turn", F.col("turn") - 1, ["turn", "role"]).drop("role")


@query("""
with recursive t as (
  select conv_id, turn, 0 as depth from conversations where turn = 0
  union all select c.conv_id, c.turn, t.depth + 1 from conversations c join t on c.conv_id = t.conv_id and c.turn = t.turn + 1)
select conv_id, max(depth) as depth, count(*) as n from t group by conv_id""")
def reply_depth(spark, sf_dir):
    view = f"landfold_replies_{uuid.uuid4().hex}"
    table(spark, sf_dir, "conversations").select("conv_id", "turn").createOrReplaceTempView(view)
    out = spark.sql(f"""
        with recursive t as (
          select conv_id, turn, 0 as depth from {view} where turn = 0
          union all select c.conv_id, c.turn, t.depth + 1 from {view} c join t on c.conv_id = t.conv_id and c.turn = t.turn + 1)
        select conv_id, max(depth) as depth, count(*) as n from t group by conv_id""")
    spark.catalog.dropTempView(view)
    return out


@query("select d.doc_id, coalesce(b.text, d.text) as text from documents d left join benchmark b on b.item_id = d.doc_id and d.n_chars > 1000")
def longtext_coalesce(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return joins.with_full_text(d, b, "doc_id", "text", F.col("n_chars") > 1000).select("doc_id", "text")


@query("select d.doc_id, d.lang, l.quality from documents d join labels l on d.doc_id = l.doc_id where l.toxic = 0")
def search_detail_join(spark, sf_dir):
    return joins.with_details(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("toxic = 0"), "doc_id").select("doc_id", "lang", "quality")


@query(r"select page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gs'), '<[^>]+>', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as text from pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.html_text(F.col("html")).alias("text"))


@query("select page_id, cast(page_id as varchar) as id, string_split(string_split(regexp_replace(url, '#.*$', ''), '?')[1], '/')[-1] as segment from pages")
def url_id(spark, sf_dir):
    landed = F.concat(F.lit("https://tieba.baidu.com/p/"), F.col("page_id").cast("string"), F.lit("?pn=2"))
    return table(spark, sf_dir, "pages").select("page_id", S.url_id(landed, "tieba", "note").alias("id"), S.last_segment(F.col("url")).alias("segment"))


@query(r"select page_id, nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '') as page, nullif(regexp_extract(url, '[?&]ref=([^&#]+)', 1), '') as ref from pages")
def url_params(spark, sf_dir):
    return table(spark, sf_dir, "pages").withColumn("p", S.url_params(F.col("url"))).select("page_id", F.try_element_at("p", F.lit("page")).alias("page"), F.try_element_at("p", F.lit("ref")).alias("ref"))


@query("select page_id, coalesce(try_cast(nullif(regexp_extract(url, '[0-9]+'), '') as bigint), 0) as n from pages")
def digit_run(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.digit_run(F.col("url")).alias("n"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select event_id, cast(floor(epoch(ts)) as bigint) as s, strftime(ts, '%Y-%m-%d %H:%M:%S') as shown from events")
def epoch_norm(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", S.epoch_seconds(ms).alias("s"), S.epoch_text(ms).alias("shown"))


@query("select event_id, case when upper(event_type) like '%ERROR%' then 'error' else 'info' end as level from events")
def log_level(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.log_level(F.col("event_type")).alias("level"))


@query("select source as type, lang as platform, count(*) as files, cast(sum(n_chars) as bigint) as bytes from documents group by grouping sets ((source), (lang), ())")
def file_stats(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("type"), F.col("lang").alias("platform"), F.col("n_chars").alias("size"))
    return files.file_stats(listed)


@query("select doc_id, lang, (select count(*) from documents) as total from documents order by doc_id limit 50")
def preview_page(spark, sf_dir):
    return text.preview(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 50)


#: Codes of genders by platform, and what they mean.
GENDERS = {"xhs": {"1": "Female", "0": "Male"}, "dy": {"1": "Male", "2": "Female", None: "Unknown"}, "ks": {"F": "Female", None: "Male"}, "wb": {"f": "Female", None: "Male"}, "zhihu": {"1": "Male", "0": "Female", None: "Unknown"}, "tieba": {"1": "Male", "2": "Female", None: "Unknown"}}
CODES = ("0", "1", "2", "F", "M", "f", "m")
_pick = lambda values, n: f"element_at(array({', '.join(map(repr, values))}), cast({n} + 1 as int))"
_meant = " ".join(f"when platform = '{p}' and code = '{c}' then '{g}'" if c else f"when platform = '{p}' then '{g}'" for p, each in GENDERS.items() for c, g in each.items())


@query(f"select *, case {_meant} end as gender from (select doc_id, ({list(GENDERS)})[doc_id % 6 + 1] as platform, ({list(CODES)})[n_chars % 7 + 1] as code from documents)")
def gender_decode(spark, sf_dir):
    coded = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_pick(GENDERS, 'doc_id % 6')} as platform", f"{_pick(CODES, 'n_chars % 7')} as code")
    return coded.withColumn("gender", S.gender(F.col("platform"), F.col("code")))


@query("select d.doc_id, coalesce(nullif(b.text, ''), nullif(d.text, ''), d.source) as label from documents d left join benchmark b on b.item_id = d.doc_id")
def first_truthy(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("whole"))
    return table(spark, sf_dir, "documents").join(b, "doc_id", "left").select("doc_id", S.first_truthy(F.col("whole"), F.col("text"), F.col("source")).alias("label"))


@query("select user_id, arg_max(event_type, row(value, -event_id)) as url from events group by user_id")
def largest_variant(spark, sf_dir):
    largest = F.max_by("event_type", F.struct("value", -F.col("event_id")))  # of equal ones the first
    return table(spark, sf_dir, "events").groupBy("user_id").agg(largest.alias("url"))


@query("select event_id, event_type as label, 'event' as kind from events where event_type = 'click' union all select doc_id, source, 'document' from documents where lang = 'en'")
def variant_union(spark, sf_dir):
    a = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", F.col("event_type").alias("label"), F.lit("event").alias("kind"))
    b = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("event_id"), F.col("source").alias("label"), F.lit("document").alias("kind"))
    return a.unionByName(b)


#: What the tables were declared as, once.
DECLARED = {
    "documents": "doc_id bigint, text string, lang string, source int, n_chars int, title string", "events": "event_id int, ts timestamp, user_id bigint, event_type string, value float, props string",
    "labels": "doc_id bigint, quality bigint, toxic int",
}
DESCRIBED = " union all ".join(f"select '{t}' as table_name, column_name, column_type from (describe select * from {t})" for t in DECLARED)
_declared = ", ".join(f"('{t}', '{c.split()[0]}', '{c.split()[1]}')" for t, ddl in DECLARED.items() for c in ddl.split(", "))


@query(f"""
with have as (select table_name, column_name, case column_type when 'VARCHAR' then 'string' when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'TS' else column_type end as type from ({DESCRIBED})),
want as (select * from (values {_declared}) w(table_name, column_name, type))
select coalesce(w.table_name, h.table_name) as table_name, coalesce(w.column_name, h.column_name) as column_name,
  case when w.type is null then 'added' when h.type is null then 'removed' when w.type = h.type or h.type = 'TS' then 'same'
    when (w.type, h.type) in (('int', 'bigint'), ('float', 'double')) then 'widened' when (w.type, h.type) = ('bigint', 'int') then 'narrowed' else 'incompatible' end as difference
from want w full outer join have h on w.table_name = h.table_name and w.column_name = h.column_name""")
def schema_drift(spark, sf_dir):
    got = schemas.drift(prepare(spark), DECLARED, sf_dir).withColumnsRenamed({"table": "table_name", "column": "column_name"})
    # a time without a zone may be read as either kind of time
    zone = F.when((F.col("before") == "timestamp") & (F.col("after") == "timestamp_ntz"), "same").otherwise(F.col("difference"))
    return got.select("table_name", "column_name", zone.alias("difference"))


#: The given tables, but for one each, that both sides of a difference have; changes of their columns in the second one.
TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_changed = {"documents": "* exclude (lang)", "events": "*, event_id as seq", "labels": "* replace (cast(toxic as varchar) as toxic)", "embeddings": "* replace (cast(embedding as double[]) as embedding)", "customer": "* exclude (c_name), c_name as name"}
_described = lambda each: " union all ".join(f"select '{name}' as table_name, column_name, column_type from (describe select {columns} from {t})" for name, t, columns in each)
_typed = "case column_type when 'VARCHAR' then 'string' when 'FLOAT[]' then 'array<float>' when 'DOUBLE[]' then 'array<double>' when 'INTEGER' then 'int' else lower(column_type) end as type"


@query(f"""
with a as (select table_name, column_name, {_typed} from ({_described([(t, t, "*") for t in (*TABLES, "region")])})),
b as (select table_name, column_name, {_typed} from ({_described([*((t, t, _changed.get(t, "*")) for t in TABLES), ("area", "region", "*")])}))
select coalesce(a.table_name, b.table_name) as table_name, coalesce(a.column_name, b.column_name) as column_name,
  case when b.type is null then 'missing' when a.type is null then 'extra' else 'type' end as difference, a.type as want, b.type as have
from a full outer join b on a.table_name = b.table_name and a.column_name = b.column_name where a.type is distinct from b.type""")
def schema_diff(spark, sf_dir):
    """The tables' schemas against those of changed copies: columns that went, came and are of another type, and a table of another name."""
    tables = {t: table(spark, sf_dir, t) for t in (*TABLES, "region")}
    changed = {t: df for t, df in tables.items() if t != "region"} | {
        "area": tables["region"], "documents": tables["documents"].drop("lang"), "events": tables["events"].withColumn("seq", F.col("event_id")), "labels": tables["labels"].withColumn("toxic", F.col("toxic").cast("string")),
        "embeddings": tables["embeddings"].withColumn("embedding", F.col("embedding").cast("array<double>")), "customer": tables["customer"].withColumnRenamed("c_name", "name"),
    }
    # a time without a zone may be read as either kind of time
    told = lambda each: spark.createDataFrame([(t, c, k.replace("timestamp_ntz", "timestamp")) for t, df in each.items() for c, k in df.dtypes], "table_name string, column_name string, type string")
    return text.schema_diff(told(tables), told(changed))


READ_AS = {"n": "smallint", "flag": "boolean", "name": "int", "day": "date"}
_texts = ["cast(n_chars * 7 as {s}) as n", "case doc_id % 4 when 0 then 'Yes' when 1 then lang when 2 then 'F' end as flag", "substr(source, 4) as name", "case when doc_id % 3 = 0 then concat('2024-', cast(doc_id % 17 + 10 as {s}), '-01') end as day"]


@query(f"""
with t as (select {', '.join(_texts).format(s='varchar')} from documents)
select 'n' as "column", count(*) as rows, count(*) filter (where n is null) as nulls, count(*) filter (where n is not null and try_cast(n as smallint) is null) as rejects from t
union all select 'flag', count(*), count(*) filter (where flag is null), count(*) filter (where lower(flag) not in {casts.TRUE + casts.FALSE}) from t
union all select 'name', count(*), count(*) filter (where name is null), count(*) filter (where name is not null and try_cast(name as int) is null) from t
union all select 'day', count(*), count(*) filter (where day is null), count(*) filter (where day is not null and try_cast(day as date) is null) from t""")
def cast_rejects(spark, sf_dir):
    return casts.reject_counts(table(spark, sf_dir, "documents").selectExpr(*(x.format(s="string") for x in _texts)), READ_AS)


@query("select doc_id, keyword from documents, (select unnest(['idiot', ' the ', 'licence', 'de ']) as keyword) where contains(text, keyword)")
def keyword_match(spark, sf_dir):
    keywords = files.keywords(prepare(spark), "idiot, the ,licence,de ")  # a keyword list isn't trimmed
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.join(F.broadcast(keywords), F.contains(d["text"], keywords["keyword"])).select("doc_id", "keyword")


@query("""
select distinct user_id as up_id, cast(json_extract_string(props, '$.k') as bigint) as fan_id from events where event_type = 'click'
union all select distinct cast(json_extract_string(props, '$.k') as bigint), user_id from events where event_type = 'view'""")
def contact_edges(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    edges = lambda kind, way: P.contacts(e.where(F.col("event_type") == kind).select(F.to_json(F.struct(F.col("k").alias("mid"))).alias("raw"), F.col("user_id").cast("string").alias("parent_id")), way).select("up_id", "fan_id").distinct()
    return edges("click", "fans").unionByName(edges("view", "followings"))


@query("""
select d.day::date as day, count(e.event_id) as events from (select unnest(generate_series((select min(ts)::date from events)::timestamp, (select max(ts)::date from events)::timestamp, interval 1 day)) as day) d
left join events e on e.ts::date = d.day::date group by d.day""")
def calendar(spark, sf_dir):
    """All days between the first and the last event, those without events too."""
    e = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    first, last = e.agg(F.min("day"), F.max("day")).first()
    days = files.calendar(spark, str(first), str(last))
    return days.join(e, "day", "left").groupBy("day").agg(F.count("event_id").alias("events"))


@query("select doc_id, substr(text, 1, 500) as text, source || text as plain from documents")
def truncated(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring("text", 1, 500).alias("text"), S.strip_tags(F.concat(F.lit("<b class='x'>"), "source", F.lit("</b>"), "text")).alias("plain"))


@query("select least(greatest(a + 2, 10), 50)::integer as doc_id, least(greatest(b + 2, 10), 50)::integer as source from (select greatest(max(length(doc_id::varchar)), 6) as a, greatest(max(length(source)), 6) as b from documents)")
def column_widths(spark, sf_dir):
    return text.widths(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query(ORACLE_SQL["upsert_overwrite"])
def stream_replay_equals_batch(spark, sf_dir):
    """Events replayed as a stream of files into a keyed store; same rows as upsert_overwrite."""
    from ..streaming import replay

    prepare(spark)
    return replay.replay_events(spark, sf_dir)


@query("""
select window_start, event_type, count(*) as n from (
  select time_bucket(interval '1 hour', ts) as window_start, event_type from events) group by window_start, event_type""")
def hourly_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour")["start"].cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.count("*").alias("n"))
