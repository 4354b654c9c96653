"""Queries over payloads in which keys are absent, null or set: lookups with defaults, truthiness, upserts of present keys.

Both engines make the same payload texts of the test tables; the SQL beside each query finds the keys by json_exists.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload
from ..operators import keyed
from . import projections as P
from .queries import query, table


def _member(key: str, value: str, turn: int, of: str = "doc_id") -> str:
    """A key of an object with a comma after it, in SQL that both engines read: absent, null or set, row by row."""
    return f"""(case ({of} + {turn}) % 3 when 0 then '' when 1 then '"{key}":null,' else '"{key}":' || {value} || ',' end)"""


def _object(members: list[str], always: str) -> str:
    return "'{' || " + " || ".join(members) + f" || {always} || '}}'"


def _quoted(c: str) -> str:
    return f"""'"' || {c} || '"'"""


N = "cast(n_chars as varchar(20))"
FLAG, HALF = "(case when n_chars % 2 = 0 then 'true' else 'false' end)", "cast(n_chars as varchar(20)) || '.0'"


def _get(path: str, default: str, kind: str = "varchar") -> str:
    return f"case when json_exists(raw, '$.{path}') then cast(raw->>'$.{path}' as {kind}) else {default} end"


def _said(path: str, default: str) -> str:
    return f"case when not json_exists(raw, '$.{path}') then {default} when json_type(raw, '$.{path}') = 'NULL' then 'None' else raw->>'$.{path}' end"


def looked_up(platform: str, entity: str, raw: str, want: dict[str, str], **context: str) -> None:
    """Register a query: an entity's projection with parity, of which the columns in `want` are compared."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, "documents").selectExpr(f"{raw} as raw", *(f"{e} as {c}" for c, e in context.items()))
        return P.project(platform, entity, df, parity=True).select(*want)

    run.__name__ = f"lookups_{platform}_{entity}"
    query("select " + ", ".join(f"{e} as {c}" for c, e in want.items()) + f" from (select doc_id, {raw} as raw from documents)")(run)


looked_up(
    "xhs", "comment", _object([_member("ip_location", _quoted("source"), 0), _member("sub_comment_count", N, 1), _member("like_count", _quoted(N), 2), _member("target_comment", """'{"id":"' || lang || '"}'""", 3)], """'"id":"' || doc_id || '"'"""),
    {
        "comment_id": "raw->>'$.id'", "ip_location": "raw->>'$.ip_location'", "sub_comment_count": _get("sub_comment_count", "0", "int"),
        "like_count": _get("like_count", "'0'"), "parent_comment_id": _get("target_comment.id", "'0'")
    },
)
looked_up(
    "xhs", "content", _object([_member("desc", _quoted("source"), 0), _member("ip_location", _quoted("lang"), 1), _member("last_update_time", N, 2)], """'"note_id":"' || doc_id || '"'"""),
    {"note_id": "raw->>'$.note_id'", "desc": _get("desc", "''"), "ip_location": _get("ip_location", "''"), "last_update_time": _get("last_update_time", "0", "bigint"), "liked_count": "'None'"},
)
looked_up(
    "bili", "content", "'{\"View\":' || " + _object([_member("title", _quoted("repeat(source, 200)"), 0), _member("pic", _quoted("lang"), 1), """'"stat":{' """, _member("view", N, 2), _member("coin", HALF, 1), """'"x":1},' """], "'\"aid\":' || doc_id") + " || '}'",
    {
        "video_id": "doc_id", "title": f"substr({_get('View.title', chr(39) * 2)}, 1, 500)", "desc": "''", "video_cover_url": _get("View.pic", "''"),
        "video_play_count": _said("View.stat.view", "''"), "video_coin_count": _said("View.stat.coin", "''"), "video_danmaku": "''"
    },
)
looked_up(
    "bili", "comment", _object([_member("parent", N, 0), _member("rcount", N, 1), _member("like", N, 2)], "'\"rpid\":' || doc_id"),
    {"comment_id": "doc_id", "parent_comment_id": _said("parent", "'0'"), "sub_comment_count": _said("rcount", "'0'"), "like_count": _get("like", "'0'")},
)
looked_up(
    "dy", "creator", _object([_member("user", "'{' || " + _member("following_count", N, 0) + " || " + _member("aweme_count", N, 1) + " || '\"nickname\":\"' || source || '\"}'", 2)], "'\"x\":1'"),
    {"user_id": "cast(doc_id as varchar)", "nickname": "raw->>'$.user.nickname'", "follows": _get("user.following_count", "'0'"), "videos_count": _get("user.aweme_count", "'0'"), "fans": "'0'"},
    parent_id="cast(doc_id as string)",
)
looked_up(
    "wb", "comment", _object([_member("total_number", N, 0), _member("like_count", N, 1), _member("source", "'\"来自' || lang || '\"'", 2), _member("rootid", _quoted(N), 0), """'"user":{' """, _member("screen_name", _quoted("source"), 1), """'"id":7},' """], "'\"id\":' || doc_id"),
    {
        "comment_id": "doc_id", "sub_comment_count": _said("total_number", "'0'"), "comment_like_count": _said("like_count", "'0'"),
        "ip_location": f"replace({_get('source', chr(39) * 2)}, '来自', '')", "parent_comment_id": _get("rootid", "''"), "nickname": _get("user.screen_name", "''"), "gender": "''"
    },
    parent_id="'5'",
)
looked_up(
    "tieba", "creator", "'{\"data\":{\"user\":' || " + _object([_member("name", _quoted("source"), 0), _member("ip_address", _quoted("lang"), 1), _member("tb_age", HALF, 2), _member("id", N, 1)], "'\"name_show\":\"x\"'") + " || '}}'",
    {
        "user_id": _said("data.user.id", "''"), "user_name": _said("data.user.name", "''"), "ip_location": _said("data.user.ip_address", "''"),
        "registration_duration": _said("data.user.tb_age", "''")
    },
)

ANY = _object([_member("a", "(case n_chars % 4 when 0 then '0' when 1 then '\"\"' when 2 then '[]' else '\"x\"' end)", 0), _member("b", FLAG, 1), _member("c", HALF, 2), _member("d", "'{}'", 1)], "'\"z\":0.0'")


@query(f"""
select doc_id, json_exists(raw, '$.a') as has_a, coalesce(json_type(raw, '$.b') = 'NULL', false) as null_b,
  case when not json_exists(raw, '$.b') then 'absent' when json_type(raw, '$.b') = 'NULL' then 'None' when raw->>'$.b' = 'true' then 'True' else 'False' end as said_b,
  {_said('c', "'absent'")} as said_c,
  case when coalesce(raw->>'$.a', '') not in ('', '0', '[]') then raw->>'$.a' when raw->>'$.b' = 'true' then 'true' when coalesce(cast(raw->>'$.c' as double), 0) <> 0 then raw->>'$.c' else 'none' end as first
from (select doc_id, {ANY} as raw from documents)""")
def payload_values(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{ANY} as raw").withColumn("v", payload.parsed(F.col("raw")))
    v = F.col("v")
    first = payload.first_truthy(v, ["d", "z", "a", "b", "c"], "string", F.lit("none"))
    said_c = payload.said(v, "c", "absent")
    # a decimal that ends in .0 is one without its places when it is read as text
    return rows.select("doc_id", payload.has(v, "a").alias("has_a"), payload.null_at(v, "b").alias("null_b"), payload.said(v, "b", "absent").alias("said_b"), said_c.alias("said_c"), F.when(~payload.truthy(v, "a") & ~payload.truthy(v, "b") & payload.truthy(v, "c"), said_c).otherwise(first).alias("first"))


ITEM = _object([_member("kind", _quoted("event_type"), 0, "event_id"), _member("value", "cast(event_id % 100 as varchar(20))", 1, "event_id")], "'\"id\":' || user_id")


@query(f"""
with items as (select user_id, event_id, {ITEM} as raw from events)
select user_id, arg_max_null(raw->>'$.kind', event_id) filter (where json_exists(raw, '$.kind')) as kind,
  cast(arg_max_null(raw->>'$.value', event_id) filter (where json_exists(raw, '$.value')) as int) as value, max(event_id) as seq, min(event_id) as add_ts
from items group by user_id""")
def upsert_payload_keys(spark, sf_dir):
    items = table(spark, sf_dir, "events").selectExpr("user_id", "event_id as seq", "event_id as add_ts", f"{ITEM} as raw")
    rows, policy = payload.present(items, "raw", {"kind": ("kind", "string"), "value": ("value", "int")})
    old = keyed.collapse(rows.where("seq < 500"), ["user_id"], ["seq"], policy, marks=True)
    return keyed.upsert(old, rows.where("seq >= 500"), ["user_id"], ["seq"], policy).select("user_id", "kind", "value", "seq", "add_ts")
