"""Queries that land payloads and project them: one for each projection, paging rule, source and payload function.

Payloads are made of the test tables as JSON (or a page, or a file), and go through the same functions as landed ones.
The SQL beside each query says the flat rows straight from the tables' columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters, joins, keyed, paging, text
from ..sources import files, html, sinks
from ..streaming.replay import shared
from . import projections as P
from .queries import query, table


def _landed(spark, sf_dir: str, base: str, payload: str, **context: str):
    """raw (JSON) and context columns, from SQL expressions over a table."""
    return table(spark, sf_dir, base).selectExpr(f"to_json({payload}) as raw", *(f"{e} as {c}" for c, e in context.items()))


def _sql(want: dict[str, str], base: str, where: str = "true") -> str:
    return "select " + ", ".join(f'{e} as "{c}"' for c, e in want.items()) + f" from {base} where {where}"


def projected(
    platform: str, entity: str, base: str, payload: str, want: dict[str, str], where: str = "true", before=None, parity: bool = False,
    name: str | None = None, **context: str
) -> None:
    """Register a query: the projection of payloads made of `base` (after `before`), of which the columns in `want` are compared."""

    def run(spark, sf_dir):
        df = _landed(spark, sf_dir, base, payload, **context)
        return P.project(platform, entity, before(df) if before else df, parity).select(*want)

    run.__name__ = name or f"{platform}_{entity}"
    query(_sql(want, base, where))(run)


def put(name: str, sql: str, run) -> None:
    run.__name__ = name
    query(sql)(run)


ID, TS, INT = "cast(doc_id as varchar)", "cast(n_chars as bigint)", "cast(n_chars as int)"
AT = dict(source_keyword="lang", now_ms="cast(n_chars as bigint)")
SEEN = {"source_keyword": "lang", "last_modify_ts": TS}

projected(
    "xhs", "content", "documents",
    """named_struct('note_id', if(doc_id % 7 = 0, '', cast(doc_id as string)), 'type', if(doc_id % 2 = 0, 'video', 'normal'), 'title', if(doc_id % 3 = 0, '', source),
      'desc', text, 'time', n_chars, 'user', named_struct('user_id', lang, 'nickname', source), 'interact_info', named_struct('liked_count', cast(n_chars as string)),
      'image_list', array(named_struct('url', 'a', 'url_default', lang), named_struct('url', source, 'url_default', '')),
      'tag_list', array(named_struct('name', lang, 'type', 'topic'), named_struct('name', 'x', 'type', 'other'), named_struct('name', source, 'type', 'topic')),
      'video', named_struct('consumer', named_struct('originVideoKey', cast(doc_id as string))), 'xsec_token', lang)""",
    {
        "note_id": ID, "title": "case when doc_id % 3 = 0 then substr(text, 1, 255) else source end", "desc": "text", "nickname": "source", "user_id": "lang",
        "video_url": "case when doc_id % 2 = 0 then 'http://sns-video-bd.xhscdn.com/' || doc_id else '' end",
        "liked_count": "cast(n_chars as varchar)", "collected_count": "cast(null as varchar)",
        "image_list": "lang || ',' || source", "tag_list": "lang || ',' || source", "last_update_time": "cast(0 as bigint)",
        "note_url": "'https://www.xiaohongshu.com/explore/' || doc_id || '?xsec_token=' || lang || '&xsec_source=pc_search'", **SEEN,
    },
    "doc_id % 7 <> 0", **AT,
)
projected(
    "xhs", "content", "documents",
    "named_struct('note_id', cast(doc_id as string), 'type', 'video', 'video', named_struct('media', named_struct('stream', "
        "named_struct('h264', array(named_struct('master_url', lang), named_struct('master_url', source))))))",
    {"note_id": ID, "video_url": "lang || ',' || source", "liked_count": "'None'", "share_count": "'None'"}, parity=True, name="xhs_video_urls",
)
projected(
    "xhs", "comment", "documents",
    """named_struct('id', cast(doc_id as string), 'note_id', lang, 'create_time', n_chars, 'ip_location', source, 'content', text, 'sub_comment_count', if(doc_id % 2 = 0, '12', 'x'),
      'user_info', named_struct('user_id', lang, 'nickname', source, 'image', 'i'), 'pictures', array(named_struct('url_default', lang), named_struct('url_default', cast(null as string))),
      'target_comment', if(doc_id % 3 = 0, named_struct('id', source), null))""",
    {
        "comment_id": ID, "create_time": "n_chars", "ip_location": "source", "note_id": "source", "content": "text", "user_id": "lang",
        "avatar": "'i'", "sub_comment_count": "case when doc_id % 2 = 0 then 12 else 0 end", "pictures": "lang || ','",
        "parent_comment_id": "case when doc_id % 3 = 0 then source else '0' end", "like_count": "'0'", "last_modify_ts": TS
    },
    parent_id="source", now_ms="cast(n_chars as bigint)",
)
projected(
    "xhs", "creator", "documents",
    """named_struct('basicInfo', named_struct('nickname', source, 'images', lang, 'desc', text, 'ipLocation', lang, 'gender', cast(doc_id % 3 as int)),
      'interactions', array(named_struct('type', 'fans', 'count', '1'), named_struct('type', 'fans', 'count', cast(n_chars as string)), named_struct('type', 'follows', 'count', lang)),
      'tags', array(named_struct('tagType', 'a', 'name', source)))""",
    {
        "user_id": ID, "nickname": "source", "avatar": "lang", "desc": "text", "ip_location": "lang",
        "gender": "case doc_id % 3 when 1 then 'Female' when 0 then 'Male' end", "follows": "lang", "fans": "cast(n_chars as varchar)",
        "interaction": "'0'", "tag_list": """'{"a":"' || source || '"}'""", "last_modify_ts": "cast(null as bigint)"
    },
    parent_id="cast(doc_id as string)",
)
projected(
    "bili", "content", "documents",
    """named_struct('View', named_struct('aid', doc_id, 'title', text, 'desc', if(doc_id % 2 = 0, text, null), 'pic', lang, 'pubdate', n_chars, 'owner', named_struct('mid', doc_id + 1, 'name', source),
      'stat', named_struct('like', n_chars, 'view', doc_id, 'coin', 3)))""",
    {
        "video_id": "doc_id", "video_type": "'video'", "title": "substr(text, 1, 500)",
        "desc": "case when doc_id % 2 = 0 then substr(text, 1, 500) else '' end", "create_time": "n_chars", "user_id": "doc_id + 1",
        "nickname": "source", "avatar": "''", "liked_count": INT, "video_play_count": ID, "video_coin_count": "'3'",
        "video_share_count": "cast(null as varchar)", "video_url": "'https://www.bilibili.com/video/av' || doc_id", "video_cover_url": "lang",
        **SEEN
    },
    **AT,
)
projected(
    "bili", "creator", "documents",
    "named_struct('Card', named_struct('like_num', n_chars, 'card', named_struct('mid', doc_id, 'name', source, 'sex', "
        "lang, 'sign', text, 'fans', n_chars, 'level_info', named_struct('current_level', 5), 'official_verify', named_struct('type', "
        "-1))))",
    {"user_id": "doc_id", "nickname": "source", "sex": "lang", "sign": "text", "total_fans": INT, "total_liked": INT, "user_rank": "5", "is_official": "-1"},
)
projected(
    "bili", "comment", "documents",
    "named_struct('rpid', doc_id, 'parent', if(doc_id % 2 = 0, doc_id + 5, null), 'ctime', n_chars, 'like', n_chars, "
        "'content', named_struct('message', text), 'member', named_struct('mid', lang, 'uname', source))",
    {
        "comment_id": "doc_id", "parent_comment_id": "case when doc_id % 2 = 0 then cast(doc_id + 5 as varchar) else '0' end",
        "create_time": "n_chars", "video_id": "doc_id * 2", "content": "text", "user_id": "lang", "nickname": "source", "sub_comment_count": "'0'",
        "like_count": "cast(n_chars as varchar)"
    },
    parent_id="cast(doc_id * 2 as string)",
)
projected(
    "bili", "dynamic", "documents",
    "named_struct('id_str', cast(doc_id as string), 'type', 'DYNAMIC_TYPE_WORD', 'modules', named_struct('module_dynamic', "
        "named_struct('desc', if(doc_id % 2 = 0, named_struct('text', text), null)), 'module_author', named_struct('pub_ts', "
        "n_chars, 'name', source), 'module_stat', named_struct('comment', named_struct('count', n_chars), 'forward', named_struct('count', "
        "2), 'like', named_struct('count', doc_id))))",
    {
        "dynamic_id": "doc_id", "user_id": "lang", "user_name": "source", "text": "case when doc_id % 2 = 0 then text else '' end",
        "type": "'WORD'", "pub_ts": "n_chars", "total_comments": INT, "total_forwards": "2", "total_liked": "cast(doc_id as int)"
    },
    parent_id="lang",
)
DY_USER = "named_struct('uid', lang, 'sec_uid', 'MS4', 'nickname', source, 'avatar_thumb', named_struct('url_list', array(lang, source)))"
projected(
    "dy", "content", "documents",
    f"""named_struct('aweme_id', cast(doc_id as string), 'aweme_type', 4, 'desc', text, 'create_time', n_chars, 'ip_label', lang, 'author', {DY_USER}, 'statistics', named_struct('digg_count', n_chars, 'share_count', 7),
      'images', array(named_struct('url_list', array('a', source)), named_struct('url_list', cast(array() as array<string>))), 'music', named_struct('play_url', named_struct('uri', lang)),
      'video', named_struct('raw_cover', if(doc_id % 2 = 0, named_struct('url_list', array('x', lang)), null), 'origin_cover', named_struct('url_list', array('y', source)),
        'play_addr_h264', named_struct('url_list', cast(array() as array<string>)), 'play_addr_256', if(doc_id % 3 = 0, named_struct('url_list', array('one')), null), 'play_addr', named_struct('url_list', array('p', 'q', source))))""",
    {
        "aweme_id": "doc_id", "aweme_type": "'4'", "title": "text", "create_time": "n_chars", "user_id": "lang", "sec_uid": "'MS4'",
        "nickname": "source", "avatar": "lang", "liked_count": "cast(n_chars as varchar)", "share_count": "'7'",
        "comment_count": "cast(null as varchar)", "ip_location": "lang", "aweme_url": "'https://www.douyin.com/video/' || doc_id",
        "cover_url": "case when doc_id % 2 = 0 then lang else source end", "video_download_url": "case when doc_id % 3 = 0 then '' else source end",
        "music_download_url": "lang", "note_download_url": "source", **SEEN
    },
    **AT,
)
projected(
    "dy", "comment", "documents",
    f"named_struct('cid', cast(doc_id as string), 'aweme_id', if(doc_id % 5 = 0, 'other', '99'), 'text', text, 'create_time', "
        f"n_chars, 'reply_id', if(doc_id % 2 = 0, lang, null), 'reply_comment_total', 4, 'digg_count', n_chars, 'image_list', "
        f"array(named_struct('origin_url', named_struct('url_list', array('a', source)))), 'user', {DY_USER})",
    {
        "comment_id": "doc_id", "create_time": "n_chars", "ip_location": "''", "aweme_id": "cast(99 as bigint)", "content": "text",
        "user_id": "lang", "avatar": "lang", "sub_comment_count": "'4'", "like_count": "cast(n_chars as varchar)",
        "parent_comment_id": "case when doc_id % 2 = 0 then lang else '0' end", "pictures": "source"
    },
    "doc_id % 5 <> 0", parent_id="'99'",
)
projected(
    "dy", "creator", "documents",
    "named_struct('user', named_struct('nickname', source, 'signature', text, 'ip_location', lang, 'gender', cast(doc_id % 4 as int), "
        "'following_count', n_chars, 'avatar_300x300', named_struct('uri', lang)))",
    {
        "user_id": ID, "nickname": "source", "gender": "case doc_id % 4 when 1 then 'Male' when 2 then 'Female' else 'Unknown' end",
        "avatar": "'https://p3-pc.douyinpic.com/img/' || lang || '~c5_300x300.jpeg?from=2956013662'", "desc": "text", "ip_location": "lang",
        "follows": "cast(n_chars as varchar)", "fans": "'0'", "interaction": "'0'", "videos_count": "'0'"
    },
    parent_id="cast(doc_id as string)",
)
projected(
    "ks", "content", "documents",
    "named_struct('type', 1, 'photo', named_struct('id', if(doc_id % 6 = 0, '', cast(doc_id as string)), 'caption', "
        "text, 'coverUrl', lang, 'timestamp', n_chars, 'realLikeCount', n_chars), 'author', named_struct('id', lang, 'name', "
        "source))",
    {
        "video_id": ID, "video_type": "'1'", "title": "substr(text, 1, 500)", "desc": "substr(text, 1, 500)", "create_time": "n_chars",
        "user_id": "lang", "nickname": "source", "avatar": "''", "liked_count": "cast(n_chars as varchar)", "viewd_count": "cast(null as varchar)",
        "video_url": "'https://www.kuaishou.com/short-video/' || doc_id", "video_cover_url": "lang", "video_play_url": "''", **SEEN
    },
    "doc_id % 6 <> 0", **AT,
)
projected(
    "ks", "comment", "documents",
    "if(doc_id % 2 = 0, named_struct('comment_id', doc_id + 1, 'commentId', cast(null as string), 'author_id', lang, "
        "'authorId', cast(null as string), 'author_name', source, 'authorName', cast(null as string), 'commentCount', n_chars, "
        "'subCommentCount', 0, 'content', text, 'timestamp', n_chars), named_struct('comment_id', null, 'commentId', cast(doc_id + 1 as string), "
        "'author_id', null, 'authorId', lang, 'author_name', null, 'authorName', source, 'commentCount', 0, 'subCommentCount', "
        "8, 'content', text, 'timestamp', n_chars))",
    {
        "comment_id": "doc_id + 1", "create_time": "n_chars", "video_id": "source", "content": "text", "user_id": "lang", "nickname": "source",
        "sub_comment_count": "case when doc_id % 2 = 0 and n_chars <> 0 then cast(n_chars as varchar) when doc_id % 2 = 0 then '0' else '8' end"
    },
    parent_id="source",
)
projected(
    "ks", "creator", "documents",
    "named_struct('ownerCount', named_struct('follow', n_chars, 'fan', doc_id, 'photo_public', 3), 'profile', named_struct('user_name', "
        "source, 'gender', case doc_id % 3 when 0 then 'F' when 1 then 'M' else 'U' end, 'headurl', lang, 'user_text', "
        "text))",
    {
        "user_id": ID, "nickname": "source", "gender": "case doc_id % 3 when 0 then 'Female' when 1 then 'Male' end", "avatar": "lang",
        "desc": "text", "follows": "cast(n_chars as varchar)", "fans": ID, "interaction": "'3'"
    },
    parent_id="cast(doc_id as string)",
)
WB_USER = "named_struct('id', doc_id + 3, 'screen_name', source, 'gender', lang)"
WB_TIME = "date_format(timestamp_seconds(1700000000 + doc_id * 3600), 'MMM dd HH:mm:ss')"
CREATED = f"concat('Sat ', {WB_TIME}, ' +0000 2023')"
WB_EPOCH, WB_SHOWN = "cast(1700000000 + (doc_id % 900) * 3600 as bigint)", "strftime(to_timestamp(1700000000 + (doc_id % 900) * 3600 + 8 * 3600) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') || '+08:00'"
CREATED = CREATED.replace("doc_id * 3600", "(doc_id % 900) * 3600")
WB_BLOG = f"named_struct('id', cast(doc_id as string), 'text', concat('<a href=\"x\">', source, '</a>', replace(text, '<', '')), 'created_at', {CREATED}, 'region_name', concat('发布于 ', lang), 'attitudes_count', n_chars, 'user', {WB_USER})"
WB_WANT = {
    "note_id": "doc_id", "content": "source || replace(text, '<', '')", "create_time": WB_EPOCH, "create_date_time": WB_SHOWN,
    "liked_count": "cast(n_chars as varchar)", "comments_count": "'0'", "note_url": "'https://m.weibo.cn/detail/' || doc_id",
    "ip_location": "lang", "user_id": "cast(doc_id + 3 as varchar)", "nickname": "source", "gender": "lang", "avatar": "''"
}
projected("wb", "content", "documents", f"named_struct('mblog', {WB_BLOG})", WB_WANT)
projected(
    "wb", "comment", "documents",
    f"named_struct('id', doc_id, 'text', replace(text, '<', ''), 'created_at', {CREATED}, 'source', concat('来自', lang), "
        f"'rootid', if(doc_id % 2 = 0, source, null), 'total_number', n_chars, 'user', {WB_USER})",
    {
        "comment_id": "doc_id", "create_time": WB_EPOCH, "create_date_time": WB_SHOWN, "note_id": "doc_id + 9", "content": "replace(text, '<', '')",
        "sub_comment_count": "cast(n_chars as varchar)", "comment_like_count": "'0'", "ip_location": "lang",
        "parent_comment_id": "case when doc_id % 2 = 0 then source else '' end", "user_id": "cast(doc_id + 3 as varchar)", "nickname": "source"
    },
    parent_id="cast(doc_id + 9 as string)",
)
projected(
    "wb", "creator", "documents",
    "named_struct('screen_name', source, 'gender', if(doc_id % 2 = 0, 'f', 'm'), 'avatar_hd', lang, 'description', text, 'source', concat('来自', lang), 'follow_count', cast(n_chars as string))",
    {
        "user_id": ID, "nickname": "source", "gender": "case when doc_id % 2 = 0 then 'Female' else 'Male' end", "avatar": "lang", "desc": "text",
        "ip_location": "lang", "follows": "cast(n_chars as varchar)", "fans": "''", "tag_list": "''"
    },
    parent_id="cast(doc_id as string)",
)
ZH_AUTHOR = "if(doc_id % 2 = 0, named_struct('id', lang, 'url_token', source, 'name', 'n', 'avatar_url', 'v', 'member', null), named_struct('id', '', 'url_token', null, 'name', null, 'avatar_url', null, 'member', named_struct('id', lang, 'url_token', source, 'name', 'm', 'avatar_url', 'w')))"
ZH_WANT = {
    "user_id": "lang", "user_link": "'https://www.zhihu.com/people/' || source",
    "user_nickname": "case when doc_id % 2 = 0 then 'n' else 'm' end", "user_avatar": "case when doc_id % 2 = 0 then 'v' else 'w' end"
}
PLAIN = r"regexp_replace(replace(text, '<', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
projected(
    "zhihu", "content", "documents",
    f"""named_struct('id', cast(doc_id as string), 'type', case doc_id % 4 when 0 then 'answer' when 1 then 'article' when 2 then 'zvideo' else 'ad' end, 'content', concat('<p>', replace(text, '<', ''), '</p><script>x</script>'),
      'title', concat('<b>', source, '</b>'), 'excerpt', lang, 'created_time', n_chars, 'updated_time', 0, 'updated', 5, 'published_at', 6, 'updated_at', 7, 'video_url', 'u', 'voteup_count', cast(n_chars as int), 'question', named_struct('id', source), 'author', {ZH_AUTHOR})""",
    {
        "content_id": ID, "content_type": "case doc_id % 4 when 0 then 'answer' when 1 then 'article' else 'zvideo' end",
        "content_text": f"case when doc_id % 4 = 2 then '' else {PLAIN} end",
        "content_url": "case doc_id % 4 when 0 then 'https://www.zhihu.com/question/' || source || '/answer/' || doc_id when 1 then 'https://zhuanlan.zhihu.com/p/' || doc_id else 'u' end",
        "question_id": "case when doc_id % 4 = 0 then source else '' end", "title": "source",
        "desc": "case when doc_id % 4 in (0, 1) then lang else '' end",
        "updated_time": "case doc_id % 4 when 0 then '0' when 1 then '5' else '0' end", "voteup_count": INT, "comment_count": "0", **ZH_WANT
    },
    "doc_id % 4 <> 3",
)
projected(
    "zhihu", "comment", "documents",
    f"named_struct('id', cast(doc_id as string), 'type', if(doc_id % 5 = 0, 'ad', 'comment'), 'reply_comment_id', lang, "
        f"'content', concat('<p>', replace(text, '<', ''), '</p>'), 'created_time', n_chars, 'child_comment_count', 2, 'comment_tag', "
        f"array(named_struct('type', 'x', 'text', 'no'), named_struct('type', 'ip_info', 'text', source)), 'author', {ZH_AUTHOR}, "
        f"'content_type', 'answer')",
    {
        "comment_id": ID, "parent_comment_id": "lang", "content": PLAIN, "publish_time": "cast(n_chars as varchar)", "ip_location": "source",
        "sub_comment_count": "2", "like_count": "0", "content_id": "source", "content_type": "'answer'", **ZH_WANT
    },
    "doc_id % 5 <> 0", parent_id="source",
)
projected(
    "zhihu", "creator", "documents",
    "named_struct('id', if(doc_id % 3 = 0, '', cast(doc_id as string)), 'urlToken', source, 'name', lang, 'gender', cast(doc_id % 3 as int) - 1, 'followerCount', cast(n_chars as int))",
    {
        "user_id": ID, "user_link": "'https://www.zhihu.com/people/' || source", "user_nickname": "lang", "url_token": "source",
        "gender": "case doc_id % 3 when 2 then 'Male' when 1 then 'Female' else 'Unknown' end", "fans": INT, "follows": "0", "video_count": "0"
    },
    "doc_id % 3 <> 0",
)
SQUEEZED = r"trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))"
projected(
    "tieba", "search", "documents",
    """named_struct('data', named_struct('card_list', array(
      named_struct('cardInfo', 'thread', 'cardStyle', 'x', 'data', named_struct('tid', cast(doc_id as string), 'title', source, 'content', text, 'forum_name', if(doc_id % 2 = 0, '猫', '猫吧'), 'create_time', n_chars, 'post_num', 4, 'user', named_struct('show_nickname', '', 'user_name', lang, 'portraith', source))),
      named_struct('cardInfo', 'topic', 'cardStyle', 'topic', 'data', named_struct('tid', '0', 'title', '', 'content', '', 'forum_name', '', 'create_time', 0L, 'post_num', 0, 'user', null)))))""",
    {
        "note_id": ID, "title": "source", "desc": SQUEEZED, "note_url": "'https://tieba.baidu.com/p/' || doc_id",
        "publish_time": "strftime(to_timestamp(n_chars) at time zone 'UTC', '%Y-%m-%d %H:%M:%S')", "user_nickname": "lang", "user_avatar": "source",
        "tieba_name": "'猫吧'", "tieba_link": "'https://tieba.baidu.com/f?kw=%E7%8C%AB'", "total_replay_num": "4", "source_keyword": "lang"
    },
    source_keyword="lang",
)
TIEBA_PAGE = """named_struct('thread', named_struct('id', cast(doc_id as string), 'title', concat(source, '【猫吧】_百度贴吧'), 'reply_num', 7, 'create_time', n_chars), 'forum', named_struct('id', lang, 'name', '猫'), 'page', named_struct('total_page', 3),
  'first_floor', named_struct('id', 'f', 'author_id', 1L, 'time', n_chars, 'title', 't', 'content', array(named_struct('type', 0, 'text', source, 'c', null), named_struct('type', 1, 'text', '', 'c', lang))),
  'post_list', array(named_struct('id', concat('c', doc_id), 'author_id', 2L, 'time', n_chars, 'content', array(named_struct('type', 0, 'text', source, 'c', null)), 'sub_post_number', 5), named_struct('id', '', 'author_id', 9L, 'time', 0L, 'content', null, 'sub_post_number', 0)),
  'user_list', array(named_struct('id', 1L, 'name', 'old', 'name_show', '', 'portrait', 'x', 'ip_address', 'y'), named_struct('id', 1L, 'name', source, 'name_show', '', 'portrait', lang, 'ip_address', lang)))"""
projected(
    "tieba", "detail", "documents", TIEBA_PAGE,
    {
        "note_id": ID, "title": "source", "desc": "source || lang", "note_url": "'https://tieba.baidu.com/p/' || doc_id",
        "user_link": "'https://tieba.baidu.com/home/main?id=' || lang", "user_nickname": "source", "user_avatar": "lang", "tieba_id": "lang",
        "tieba_name": "'猫吧'", "ip_location": "lang", "total_replay_num": "7", "total_replay_page": "3"
    },
)
projected(
    "tieba", "comment", "documents", TIEBA_PAGE,
    {"comment_id": "'c' || doc_id", "content": "source", "user_link": "''", "user_nickname": "''", "tieba_id": "lang", "tieba_name": "'猫吧'", "parent_comment_id": "''"}
)
projected(
    "tieba", "creator", "documents",
    "named_struct('data', named_struct('user', named_struct('id', cast(doc_id as string), 'name', source, 'name_show', "
        "if(doc_id % 2 = 0, lang, ''), 'portrait', 'p', 'tb_age', '1.5', 'ip_address', lang, 'fans_num', cast(n_chars as int), "
        "'sex', cast(doc_id % 3 as int))))",
    {
        "user_id": ID, "user_name": "source", "nickname": "case when doc_id % 2 = 0 then lang else source end", "avatar": "'p'",
        "gender": "case doc_id % 3 when 1 then 'Male' when 2 then 'Female' else 'Unknown' end", "follows": "'0'",
        "fans": "cast(n_chars as varchar)", "registration_duration": "'1.5'", "ip_location": "lang"
    },
)
put(
    "wb_cards", "select doc_id as note_id, cast(n_chars as varchar) as liked_count from documents union all select -1, '0' from documents",
    lambda spark,
    sf_dir: P.project(
        "wb", "content",
        P.weibo_cards(_landed(
            spark, sf_dir, "documents",
            f"named_struct('cards', array(named_struct('card_type', 9, 'mblog', {WB_BLOG}, 'card_group', array(named_struct('card_type', "
                f"9, 'mblog', named_struct('id', '-1')), named_struct('card_type', 4, 'mblog', named_struct('id', '-2'))))))"
        ))
    ).select("note_id", "liked_count"),
)
put(
    "tieba_thread_ids", "select cast(doc_id as varchar) as note_id from documents union all select source from documents union all select lang from documents",
    lambda spark,
    sf_dir: P.tieba_thread_ids(_landed(
        spark, sf_dir, "documents",
        "named_struct('data', named_struct('list', array(named_struct('thread_info', named_struct('tid', '', 'id', cast(doc_id as string))))), "
            "'forum', named_struct('tids', concat(source, ',', lang, ',')))"
    )),
)
put(
    "contact_rows", "select distinct user_id as up_id, event_id as fan_id, event_type as fan_name from events",
    lambda spark,
    sf_dir: P.contacts(_landed(
        spark, sf_dir, "events", "named_struct('mid', event_id, 'uname', event_type)", parent_id="cast(user_id as string)"
    ), "fans").select("up_id", "fan_id", "fan_name"),
)
put(
    "aweme_info",
    "select cast(doc_id as bigint) as aweme_id, case when doc_id % 3 = 0 then source else lang end as nickname from documents where doc_id % 3 <> 2",
    lambda spark,
    sf_dir: P.project(
        "dy", "content",
        P.aweme_info(_landed(
            spark, sf_dir, "documents",
            "named_struct('aweme_info', if(doc_id % 3 = 0, named_struct('aweme_id', cast(doc_id as string), 'author', named_struct('nickname', "
                "source)), null), 'aweme_mix_info', if(doc_id % 3 = 1, named_struct('mix_items', array(named_struct('aweme_id', "
                "cast(doc_id as string), 'author', named_struct('nickname', lang)))), null))"
        ))
    ).select("aweme_id", "nickname"),
)
put(
    "search_items",
    "select doc_id, case doc_id % 4 when 0 then 'rec_query' when 1 then 'note' when 2 then 'hot_query' end as model_type from documents where doc_id % 4 in (1, 3)",
    lambda spark,
    sf_dir: P.xhs_search_items(table(spark, sf_dir, "documents").selectExpr("doc_id", "case doc_id % 4 when 0 then 'rec_query' when 1 then 'note' when 2 then 'hot_query' end as model_type"))
)


PAGES = """select cast(conv_id as varchar) as stream, cast(turn + {first} as int) as page, case when length(text) % 13 = 0 then null else range(length(text) % 9) end as items,
  cast(length(text) % 3 as int) as replies, length(text) % 7 <> 0 as more, case when length(text) % 11 = 0 then 'no_more' when length(text) % 10 = 0 then '0' else cast(length(text) % 5 as varchar) end as cursor,
  cast(length(text) % 60 as bigint) as total from conversations"""


def _pages(spark, sf_dir: str, first: int):
    return table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id as string) as stream", f"cast(turn + {first} as int) as page",
        "case when length(text) % 13 = 0 then null when length(text) % 9 = 0 then cast(array() as array<bigint>) else sequence(0L, cast(length(text) % 9 - 1 as bigint)) end as items",
        "cast(length(text) % 3 as int) as replies", "length(text) % 7 <> 0 as more",
        "case when length(text) % 11 = 0 then 'no_more' when length(text) % 10 = 0 then '0' else cast(length(text) % 5 as string) end as cursor",
        "cast(length(text) % 60 as bigint) as total",
    )


def _paged(name: tuple[str, str], rule: paging.Paging, most: int) -> None:
    """The rule over conversations as pages; in SQL the loop itself, a page a step."""
    used, on = (x.replace(" div ", " // ") for x in (rule.used, rule.goes_on))
    take = {"items": f"least(p.n, {most} - l.got)", "replies": f"least(p.n, {most} - l.got)", "page": f"least(p.n, {most})"}.get(rule.cap, "p.n")
    more = {"items": f"l.got < {most}", "replies": f"l.got < {most}"}.get(rule.cap, "true")
    if rule.cap == "pages":
        more = f"p.page * {rule.size} <= {paging.raised(most, rule)}" if rule.fits else f"(p.page - 1) * {rule.size} < {most}"
    count = "taken + replies" if rule.cap == "replies" else "taken"
    sql = f"""
with recursive p as (
  select *, coalesce({used}, false) as used, coalesce({on}, false) as goes_on
  from (select *, coalesce(len(items), 0) as n, coalesce(lag(cursor) over (partition by stream order by page), '') as before from ({PAGES.format(first=rule.first)}))
), l as (
  select stream, {rule.first - 1} as page, null::bigint[] as items, 0::bigint as got, 0::bigint as taken, true as goes_on from p where page = {rule.first}
  union all
  select stream, page, items, got + {count} as got, taken, goes_on from (
    select p.stream, p.page, p.items, l.got, {take} as taken, p.replies, p.goes_on
    from l join p on p.stream = l.stream and p.page = l.page + 1 where l.goes_on and p.used and {more})
)
select stream, page, cast(unnest(range(taken)) as int) as pos, unnest(items[1:taken]) as item from l where taken > 0"""

    def run(spark, sf_dir):
        return paging.replay(_pages(spark, sf_dir, rule.first), rule, most)

    put("paging_" + "_".join(name).replace(" ", "_"), sql, run)


for _name, _rule in paging.RULES.items():
    _paged(_name, _rule, 40 if _rule.cap == "pages" else 9)


#: One loop of each kind of cap, said anew: whether a page is used, whether the loop goes on after it, what is taken, whether it is asked for.
LOOPS = {
    ("bili", "comments"): (9, "p.cursor is not null", "p.more", "least(p.n, 9 - l.got)", "l.got < 9"),
    ("bili", "comments with replies"): (9, "p.cursor is not null", "p.more", "least(p.n, 9)", "true"),
    ("ks", "comments"): (9, "true", "coalesce(p.cursor, 'no_more') <> 'no_more'", "least(p.n, 9 - l.got)", "l.got < 9"),
    ("wb", "search"): (40, "p.n > 0", "true", "p.n", "p.page * 10 <= 40"),
    ("wb", "creator"): (0, "p.items is not null", "p.total > p.page * 10", "p.n", "true"),
    ("tieba", "creator"): (40, "true", "p.more", "p.n", "(p.page - 1) * 20 < 40"),
    ("zhihu", "comments"): (0, "p.n > 0 and coalesce(p.cursor, '') <> p.before", "p.more", "p.n", "true"),
}


def _looped(name: tuple[str, str], most: int, used: str, on: str, take: str, asked: str) -> None:
    sql = f"""
with recursive p as (select *, coalesce(len(items), 0) as n, coalesce(lag(cursor) over (partition by stream order by page), '') as before from ({PAGES.format(first=1)})), l as (
  select stream, 1 as page, 0::bigint as got from p where page = 1
  union all
  select l.stream, l.page + 1, l.got + p.n + {"p.replies" if name == ("ks", "comments") else "0"} from l join p on p.stream = l.stream and p.page = l.page where {used} and {on} and {asked}
)
select l.stream, l.page, cast(unnest(range({take})) as int) as pos, unnest(p.items[1:{take}]) as item from l join p on p.stream = l.stream and p.page = l.page where {used} and {asked} and {take} > 0"""
    put("loop_" + "_".join(name).replace(" ", "_"), sql, lambda spark, sf_dir: paging.replay(_pages(spark, sf_dir, 1), paging.RULES[name], most))


for _name, _told in LOOPS.items():
    _looped(_name, *_told)


def _scalar(name: str, base: str, key: str, fn, sql: str) -> None:
    """Register a function of a table's rows: fn gives columns by name, sql the same ones."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, base).select(key, *(c.alias(n) for n, c in fn().items()))

    put(name, f"select {key}, {sql} from {base}", run)


c = F.col
_scalar(
    "count_text", "documents", "doc_id",
    lambda: {"a": S.count_text(F.nullif(c("n_chars") % 3, F.lit(0))), "b": S.count_text(F.nullif(c("n_chars") % 3, F.lit(0)), parity=True)},
    "cast(nullif(n_chars % 3, 0) as varchar) as a, coalesce(cast(nullif(n_chars % 3, 0) as varchar), 'None') as b"
)
_scalar("quoted", "documents", "doc_id", lambda: {"q": S.quoted(c("source"))}, """'"' || source || '"' as q""")
_scalar(
    "strip_tags", "documents", "doc_id",
    lambda: {"t": S.strip_tags(F.concat(F.lit("<b>"), c("source"), F.lit("</b>\n<i x='1'>"), c("lang"), F.lit("< br\n>")))},
    "source || chr(10) || lang || '< br' || chr(10) || '>' as t"
)
_scalar("squeezed", "documents", "doc_id", lambda: {"t": S.squeeze(F.concat(F.lit(" \t"), c("text"), F.lit("\n ")))}, f"{SQUEEZED} as t")
_scalar(
    "numbers_in_text", "documents", "doc_id",
    lambda: {
        "n": S.safe_int(F.concat(F.when(c("doc_id") % 2 == 0, "x").otherwise(""), c("doc_id").cast("string"))),
        "k": S.parse_count(F.concat(c("doc_id").cast("string"), F.lit("万"))),
        "b": S.parse_bool(F.when(c("doc_id") % 3 == 0, "Yes").when(c("doc_id") % 3 == 1, "0").otherwise("so"))
    },
    "case when doc_id % 2 = 0 then 0 else doc_id end as n, doc_id * 10000 as k, case doc_id % 3 when 0 then true when 1 then false end as b"
)
_scalar(
    "text_times", "events", "event_id",
    lambda: {"s": S.text_epoch(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "m": S.epoch_seconds(F.unix_millis(c("ts").cast("timestamp")) * F.lit(1))},
    "cast(floor(epoch(ts)) as bigint) as s, cast(floor(epoch(ts)) as bigint) as m"
)
_scalar(
    "zoned_times", "events", "event_id",
    lambda: {"e": S.instant_epoch(F.concat(
        F.lit("Sat "), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" +0800 "), F.date_format("ts", "yyyy")
    )), "w": S.wallclock_epoch(F.concat(F.lit("Sat "), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" +0800 "), F.date_format("ts", "yyyy")))},
    "cast(floor(epoch(ts)) as bigint) - 28800 as e, cast(floor(epoch(ts)) as bigint) as w"
)
_scalar(
    "as_of_texts", "events", "event_id", lambda: {k: S.as_of_text(c("ts").cast("timestamp"), k) for k in ("s", "datetime", "hour", "date")},
    "cast(floor(epoch(ts)) as bigint) as s, strftime(ts, '%Y-%m-%d %H:%M:%S') as \"datetime\", strftime(ts, '%Y-%m-%d-%H') as \"hour\", strftime(ts, '%Y-%m-%d') as \"date\""
)
_scalar(
    "kv_map", "documents", "doc_id",
    lambda: {"l": F.try_element_at(S.kv_map(F.concat(F.lit("a=1; lang="), c("lang"), F.lit("; bad; x=y=z"))), F.lit("lang")), "n": F.size(S.kv_map(F.concat(F.lit("a=1; lang="), c("lang"), F.lit("; bad; x=y=z"))))},
    "lang as l, 2 as n"
)
_scalar(
    "platform_ids", "documents", "doc_id",
    lambda: {
        "v": S.url_id(F.concat(F.lit("https://www.bilibili.com/video/BV"), c("doc_id").cast("string"), F.lit("?p=2")), "bili", "video"),
        "w": S.url_id(c("doc_id").cast("string"), "dy", "video"),
        "k": S.zhihu_kind(F.concat(F.lit("https://www.zhihu.com/question/1/answer/"), c("doc_id").cast("string")))
    },
    "'BV' || doc_id as v, cast(doc_id as varchar) as w, 'answer' as k"
)
_scalar(
    "built_urls", "pages", "page_id",
    lambda: {
        "q": S.url_quote(F.concat(c("page_id").cast("string"), F.lit(" a/b&c"))), "j": S.url_join(c("url"), F.lit("//x.y/z")),
        "o": S.next_offset(F.concat(F.lit("https://h/p?limit=5&offset="), c("page_id").cast("string")))
    },
    "page_id || '%20a/b%26c' as q, regexp_extract(url, '^([a-z]+:)', 1) || '//x.y/z' as j, cast(page_id as varchar) as o"
)
_scalar(
    "forum_names", "documents", "doc_id",
    lambda: {
        "a": S.with_suffix(c("source")), "b": S.without_suffix(S.with_suffix(c("source"))),
        "t": S.clean_title(F.concat(c("source"), F.lit("【"), c("lang"), F.lit("】_百度贴吧")), c("lang"))
    },
    "source || '吧' as a, source as b, source as t"
)
_scalar(
    "content_texts", "documents", "doc_id",
    lambda: {"a": S.content_text(F.to_json(F.array(F.struct(c("source").alias("text"), F.lit("no").alias("c")), F.struct(F.lit("").alias("text"), c("lang").alias("c"))))), "b": S.content_text(F.concat(F.lit('" '), c("lang"), F.lit('  x"')))},
    "source || lang as a, lang || ' x' as b"
)
_scalar("unescaped", "documents", "doc_id", lambda: {"t": S.html_unescape()(F.concat(F.lit("&lt;"), c("source"), F.lit("&amp;&#39;")))}, "'<' || source || '&''' as t")
_scalar("js_strings", "documents", "doc_id", lambda: {"t": S.js_string(F.concat(c("source"), F.lit("\\u4e2d\\n"), c("lang")))}, "source || '中' || chr(10) || lang as t")
_scalar(
    "page_fields", "documents", "doc_id",
    lambda: {n: S.page_field(F.concat(F.lit('<span>吧龄:'), c("lang"), F.lit('</span><i>IP属地:'), c("source"), F.lit('</span>')), n) for n in ("ip_location", "registration_duration", "publish_time")},
    "source as ip_location, lang as registration_duration, '' as publish_time"
)
_scalar(
    "snake_keys", "documents", "doc_id",
    lambda: {"j": S.snake_keys()(F.concat(F.lit('{"noteId":'), c("doc_id").cast("string"), F.lit(',"xA":[{"bC":1}]}')))},
    """'{"note_id":' || doc_id || ',"x_a":[{"b_c":1}]}' as j"""
)
_scalar(
    "base36", "documents", "doc_id",
    lambda: {"d": S.base36_decode(S.base36_encode(c("doc_id") * 7919)), "e": S.base36_text()(S.base36_encode(-c("doc_id")))},
    "doc_id * 7919 as d, cast(-doc_id as varchar) as e"
)
_scalar(
    "image_urls", "documents", "doc_id",
    lambda: {"u": S.image_urls(S.trace_id(F.concat(F.lit("https://h/spectrum/"), c("doc_id").cast("string"))))[0]},
    "'https://sns-img-qc.xhscdn.com/spectrum/' || doc_id || '?imageView2/format/png' as u"
)
_scalar(
    "largest_of_variants", "documents", "doc_id",
    lambda: {"u": S.largest_variant(F.array(
        F.struct(c("n_chars").alias("size"), c("lang").alias("url")), F.struct(F.lit(500).cast("long").alias("size"), c("source").alias("url")),
        F.struct(F.lit(500).cast("long").alias("size"), F.lit("late").alias("url"))
    ))},
    "case when n_chars >= 500 then lang else source end as u"
)
_scalar(
    "id_lists", "documents", "doc_id",
    lambda: {"ids": F.array_join(files.id_list(F.concat(F.lit(" a,,"), c("source"), F.lit(" , "), c("lang"))), "|")},
    "'a|' || source || '|' || lang as ids"
)
_scalar(
    "log_levels", "documents", "doc_id",
    lambda: {"level": S.log_level(F.concat(F.element_at(F.array(*(F.lit(x) for x in ("Task failed ", "warn ", "完成 ", "debug ", "x "))), (c("doc_id") % 5 + 1).cast("int")), c("source")))},
    "case doc_id % 5 when 0 then 'error' when 1 then 'warning' when 2 then 'success' when 3 then 'debug' else 'info' end as level"
)


def _written(name: str, sql: str, write, read, base: str, columns: list[str]) -> None:
    """Register a round trip: a table's columns written by a sink and read by a source."""

    def run(spark, sf_dir):
        path = shared(spark, name)
        df = table(spark, sf_dir, base).select(*columns)
        write(df, path)
        return read(spark, path)

    put(name, sql, run)


DOCS = "doc_id long, text string, lang string"
_written(
    "json_array_files", "select doc_id, text, lang from documents", lambda df, path: sinks.write_json_array(df, path), lambda spark,
    path: files.json_array(spark, path, DOCS), "documents", ["doc_id", "text", "lang"]
)
_written(
    "json_line_files", "select doc_id, text, lang from documents", lambda df, path: sinks.write_jsonl(df, path), lambda spark,
    path: files.json_lines(spark, path, DOCS), "documents", ["doc_id", "text", "lang"]
)
_written(
    "csv_files", "select cast(doc_id as varchar) as doc_id, text, lang from documents", lambda df, path: sinks.write_csv(df, path),
    lambda spark, path: files.csv(spark, path), "documents", ["doc_id", "text", "lang"]
)
_written(
    "csv_row_count", "select count(*) as n from documents", lambda df, path: sinks.write_csv(df, path), lambda spark,
    path: spark.createDataFrame([(files.row_counts(spark, path, "csv"),)], "n long"), "documents", ["doc_id", "text"]
)


def _by_platform(df, path: str, kind: str) -> None:
    """A file for each source, below its platform's folder."""
    for k, folder in enumerate(files.PLATFORMS.values()):
        df.where(f"cast(substr(source, 4) as int) % 7 = {k}").repartition(1).write.mode("append").format(kind).partitionBy("source").save(f"{path}/{folder}/{kind}")


_written(
    "catalogued_files",
    f"""select ({list(files.PLATFORMS)})[k + 1] as platform, type, count(*) as files from (select distinct cast(substr(source, 4) as int) % 7 as k, source, case when lang = 'en' then 'csv' else 'json' end as type from documents) group by all""",
    lambda df, path: [_by_platform(df.where(cond), path, kind) for kind, cond in (("csv", "lang = 'en'"), ("json", "lang <> 'en'"))],
    lambda spark, path: files.catalogue(spark, path).groupBy("platform", "type").agg(F.count("*").alias("files")), "documents", ["doc_id", "lang", "source"],
)
def _script(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("n_chars >= 0")
    page = F.concat(
        F.lit('<html><script id="js-initialData" type="text/json">'),
        F.to_json(F.struct(F.struct(F.create_map(F.lit("k"), F.struct("doc_id", "source")).alias("users")).alias("state"))), F.lit("</script>")
    )
    return d.select(files.first_entity(files.script_json(page), "$.state.users", "struct<doc_id: bigint, source: string>").alias("e")).select("e.doc_id", "e.source")


put("script_entities", "select doc_id, source from documents", _script)


def _state(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    page = F.concat(F.lit('<script>window.__INITIAL_STATE__={"note":{"noteDetailMap":{"x":undefined},"id":'), c("doc_id").cast("string"), F.lit('}}</script>'))
    render = F.concat(F.lit("<script>$render_data = [{\"status\":{\"id\":"), c("doc_id").cast("string"), F.lit("}}][0] || {};</script>"))
    return d.select(F.get_json_object(files.initial_state(page), "$.note.id").cast("long").alias("a"), files.render_data(render, "struct<id: bigint>")["id"].alias("b"))


put("page_states", "select doc_id as a, doc_id as b from documents", _state)


def _page(kind: str, of, columns: list[str]):
    return lambda spark, sf_dir: html.extract(table(spark, sf_dir, "documents").select("doc_id", of().alias("html")), kind).select("doc_id", *columns)


put(
    "html_threads", "select doc_id, cast(doc_id + 1 as varchar) as note_id, source as title, lang as \"desc\" from documents",
    _page(
        "threads",
        lambda: F.concat(
            F.lit("<ul><li class='x j_thread_list' data-field='{\"id\":"), (c("doc_id") + 1).cast("string"), F.lit("}'><a class='j_th_tit'>"),
            c("source"), F.lit("</a><div class='threadlist_abs'> "), c("lang"), F.lit(" </div></li></ul>")
        ),
        ["note_id", "title", "desc"]
    )
)
put(
    "html_comments", "select doc_id, 'c' || doc_id as comment_id, source as content, lang as ip_location from documents",
    _page(
        "comments",
        lambda: F.concat(
            F.lit("<div class='l_post j_l_post' data-field='{\"content\":{\"post_id\":\"c"), c("doc_id").cast("string"), F.lit("\",\"content\":\"<b>"),
            c("source"), F.lit("</b>\"}}'><div class='post-tail-wrap'><span>IP属地:"), c("lang"), F.lit("</span></div></div>")
        ),
        ["comment_id", "content", "ip_location"]
    )
)
put(
    "html_note", "select doc_id, cast(doc_id as varchar) as note_id, source as title, 4 as total_replay_page from documents",
    _page(
        "note",
        lambda: F.concat(
            F.lit("<title>"), c("source"), F.lit("_百度贴吧</title><a id='lzonly_cntn' href='/p/"), c("doc_id").cast("string"),
            F.lit("?see_lz=1'></a><div id='thread_theme_5'><li class='l_reply_num'><span class='red'>9</span><span class='red'>4</span></li></div>")
        ),
        ["note_id", "title", "total_replay_page"]
    )
)
put(
    "html_creator_threads", "select doc_id, cast(doc_id as varchar) as thread_id from documents",
    _page(
        "creator_threads",
        lambda: F.concat(F.lit("<ul class='new_list clearfix'><div class='thread_name'><a href='/p/"), c("doc_id").cast("string"), F.lit("?x=1'>t</a></div></ul>")),
        ["thread_id"]
    )
)


put(
    "html_search", "select doc_id, cast(doc_id + k as varchar) as note_id, source as title, lang as \"desc\", source || '吧' as tieba_name, '2024-01-0' || (k + 1) as publish_time from documents, (select unnest(range(2)) as k)",
    _page(
        "search",
        lambda: F.concat(*(
            F.concat(
                F.lit("<div class='s_post x'><a data-tid='"), (c("doc_id") + k).cast("string"), F.lit("' href='/p/1'>"), c("source"), F.lit("</a><div class='p_content'>\n "), c("lang"),
                F.lit("</div><a class='p_forum' href='/f?kw=x'>"), c("source"), F.lit(f"吧</a><font class='p_green p_date'>2024-01-0{k + 1}</font></div>")
            ) for k in (0, 1, 0)
        )),
        ["note_id", "title", "desc", "tieba_name", "publish_time"]
    )
)
put(
    "html_search_cards", "select doc_id, cast(doc_id as varchar) as note_id, source as title, lang as \"desc\", '昨天' as publish_time from documents",
    _page(
        "search",
        lambda: F.concat(
            F.lit("<div class='threadcardclass y'>发布于 昨天 <a href='/p/"), c("doc_id").cast("string"), F.lit("?fr=s'>"), c("source"), F.lit("</a><span class='abstract-wrap'>"), c("lang"), F.lit("</span></div>")
        ),
        ["note_id", "title", "desc", "publish_time"]
    )
)
put(
    "html_replies", "select doc_id, 's' || doc_id as comment_id, source as content, lang as user_nickname, cast(doc_id + 1 as varchar) as parent_comment_id from documents where doc_id % 5 <> 0",
    _page(
        "replies",
        lambda: F.concat(
            F.lit("<ul><li class='lzl_single_post j_lzl_s_p' data-field='{&quot;spid&quot;:&quot;"), F.when(c("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("s"), c("doc_id").cast("string"))),
            F.lit("&quot;,&quot;showname&quot;:&quot;"), c("lang"), F.lit("&quot;,&quot;pid&quot;:"), (c("doc_id") + 1).cast("string"), F.lit("}'><span class='lzl_content_main'> "), c("source"), F.lit(" </span></li></ul>")
        ),
        ["comment_id", "content", "user_nickname", "parent_comment_id"]
    )
)
put(
    "html_creator", "select doc_id, cast(doc_id as varchar) as user_id, source as nickname, case doc_id % 3 when 0 then 'Male' when 1 then 'Female' else 'Unknown' end as gender, lang as ip_location, cast(n_chars as varchar) as follows, '0' as fans from documents",
    _page(
        "creator",
        lambda: F.concat(
            F.lit("<p class='space'><a href='/home/main?id="), c("doc_id").cast("string"), F.lit("&amp;un=u'>x</a></p><span class='userinfo_username'>"), c("source"), F.lit("</span><div class='userinfo_userdata'><span class='"),
            F.expr("element_at(array('userinfo_sex_male', 'userinfo_sex_female', 'none'), cast(doc_id % 3 + 1 as int))"), F.lit("'></span>IP属地:"), c("lang"), F.lit(" 吧龄:3年</div><span class='concern_num'>("), c("n_chars").cast("string"), F.lit(")</span>")
        ),
        ["user_id", "nickname", "gender", "ip_location", "follows", "fans"]
    )
)


put(
    "published_between", "select doc_id from documents where n_chars between 86400 * 0 and 86400 * 1 - 1", lambda spark,
    sf_dir: table(spark, sf_dir, "documents").where(filters.published_between(c("n_chars"), "1970-01-01", "1970-01-01")).select("doc_id")
)
put(
    "searched",
    "select doc_id, n_chars as publish_time from documents where contains(lower(text), 'idiot') or contains(lower(source), 'idiot')",
    lambda spark,
    sf_dir: filters.search(
        table(spark, sf_dir, "documents").withColumnRenamed("n_chars", "publish_time"), "Idiot", ("text", "source"), order="newest",
        ties=("doc_id",)
    ).select("doc_id", "publish_time")
)
put(
    "titled", "select doc_id from documents where doc_id % 3 <> 0", lambda spark,
    sf_dir: table(spark, sf_dir, "documents").where(filters.has_text(F.expr("case doc_id % 3 when 1 then lang when 2 then source else '' end"))).select("doc_id")
)
put(
    "zipped_lists", "select conv_id, unnest(list(turn order by turn)) as t, unnest(list(role order by turn)) as r from conversations group by conv_id",
    lambda spark,
    sf_dir: joins.zipped(
        table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x")).select("conv_id", F.col("x.turn").alias("t"), F.col("x.role").alias("r")),
        "t", "r"
    ),
)
put(
    "keyed_authors",
    """select d.doc_id, case when d.doc_id % 2 = 0 then (select '{"quality":' || max(l.quality) || '}' from labels l where l.doc_id = d.doc_id) else '{"name":"' || d.source || '"}' end as author from documents d""",
    lambda spark, sf_dir: joins.with_keyed_author(
        table(spark, sf_dir, "documents").select("doc_id", F.expr("""if(doc_id % 2 = 0, concat('"', doc_id, '"'), concat('{"name":"', source, '"}'))""").alias("author")),
        table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.to_json(F.struct(F.max("quality").alias("quality"))).alias("user"))),
)
put(
    "inherited_fields", "select c.conv_id, c.turn, p.source, p.lang from conversations c join documents p on p.doc_id = c.conv_id",
    lambda spark,
    sf_dir: joins.inherit(
        table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "conv_id", "turn"), table(spark, sf_dir, "documents"),
        "doc_id", ["source", "lang"]
    ).select("conv_id", "turn", "source", "lang")
)
put(
    "log_tail", "select event_id, event_type from events order by event_id desc limit 100", lambda spark,
    sf_dir: text.log_tail(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 100)
)
put(
    "page_window", "select event_id from events order by event_id limit 40 offset 20", lambda spark,
    sf_dir: table(spark, sf_dir, "events").select("event_id").orderBy("event_id").offset(paging.page_window(2, 20, 55)[0]).limit(paging.page_window(2, 20, 55)[1])
)
put(
    "point_and_conjunction",
    "select event_id, user_id, event_type from (select *, row_number() over (partition by event_id order by ts) as k from events) where k = 1 and user_id = 3 and event_type = 'click'",
    lambda spark, sf_dir: _stored(spark, sf_dir).find(user_id=3, event_type="click"),
)


def _stored(spark, sf_dir: str) -> keyed.Store:
    store = keyed.Store(spark, shared(spark, "events"), ["event_id"], ["event_id"])
    store.write(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))
    return store


put(
    "xhs_policies",
    "select user_id, arg_min(event_type, event_id) as title, arg_max(value, event_id) as liked_count, arg_max(event_id, event_id) as last_modify_ts from events group by user_id",
    lambda spark,
    sf_dir: keyed.collapse(
        table(spark, sf_dir, "events").selectExpr("user_id", "event_type as title", "value as liked_count", "event_id as last_modify_ts", "event_id as seq"),
        ["user_id"], ["seq"], keyed.XHS_NOTE
    ).drop("seq")
)
put(
    "titled_inserts",
    "with t as (select user_id, min(event_id) as at from events where event_type = 'purchase' group by user_id) select e.user_id, "
        "arg_max(e.event_type, e.event_id) as kind, min(e.event_id) as add_ts from events e join t on t.user_id = e.user_id and e.event_id "
        ">= t.at group by e.user_id",
    lambda spark,
    sf_dir: keyed.collapse(
        table(spark, sf_dir, "events").selectExpr(
            "user_id", "event_type as kind", "event_id as add_ts", "if(event_type = 'purchase', 't', '') as title", "event_id as seq"
        ),
        ["user_id"], ["seq"], keyed.DOUYIN_CONTENT
    ).drop("seq", "title"),
)
