"""From raw payloads to flat rows, for every platform and entity: a schema and a list of SQL expressions each.

`project(platform, entity, df)` takes df with a JSON string column `raw`, and the context as columns: source_keyword,
parent_id (the post of a comment, or the creator's id), now_ms. Missing context columns are null. Rows without an id give
no row. An absent field and a null one both take the default, and counts are null where the payload has none. With
`parity=True` they differ (see LOOKUPS): the default stands for an absent field only, a null one stays null, and as text
it is 'None'.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload
from ..functions import scalars as S

CONTEXT = {"source_keyword": "string", "parent_id": "string", "now_ms": "bigint"}


@dataclass(frozen=True)
class Projection:
    schema: str
    columns: dict[str, str]
    where: str = "true"
    #: columns that hold counts as text
    counts: tuple[str, ...] = ()
    #: columns that need more than an expression: name to function of the source column's expression
    after: dict = field(default_factory=dict)
    #: an expression that gives an array of rows, read as `r` in place of the payload
    rows: str | None = None


def _fields(prefix: str, **names: str) -> dict[str, str]:
    """Column to field of the same part of a payload."""
    return {c: f"{prefix}.{f}" for c, f in names.items()}


def _or(*options: str) -> str:
    """The first that is neither null nor ''."""
    return "coalesce(" + ", ".join(f"nullif({o}, '')" for o in options) + ")"


def _text(c: str) -> str:
    return f"coalesce({c}, '')"


URLS = "struct<url_list: array<string>>"
XHS_USER = "struct<user_id: string, nickname: string, avatar: string, image: string>"
WB_USER = "struct<id: bigint, screen_name: string, gender: string, profile_url: string, profile_image_url: string>"
WB_FIELDS = _fields("r.user", nickname="screen_name", gender="gender", profile_url="profile_url", avatar="profile_image_url")
DY_USER = f"struct<uid: string, sec_uid: string, short_id: string, unique_id: string, signature: string, nickname: string, avatar_medium: {URLS}, avatar_300x300: {URLS}, avatar_168x168: {URLS}, avatar_thumb: {URLS}>"
DY_FIELDS = dict(user_id="uid", sec_uid="sec_uid", short_user_id="short_id", user_unique_id="unique_id", user_signature="signature", nickname="nickname")
ZH_AUTHOR = "struct<id: string, url_token: string, name: string, avatar_url: string, member: struct<id: string, url_token: string, name: string, avatar_url: string>>"
ZH_SITE = "https://www.zhihu.com"
ZH_FIELDS = {"user_id": "a.id", "user_link": f"concat('{ZH_SITE}/people/', a.url_token)", "user_nickname": "a.name", "user_avatar": "a.avatar_url"}


def _author(columns: dict[str, str]) -> dict[str, str]:
    """`a` stands for the author, or its member where the author has no id."""
    pick = lambda f: f"if(nullif(r.author.id, '') is null, r.author.member.{f}, r.author.{f})"
    out = {}
    for c, e in columns.items():
        for f in ("id", "url_token", "name", "avatar_url"):
            e = e.replace(f"a.{f}", pick(f)) if e == f"a.{f}" or f"a.{f})" in e else e
        out[c] = e
    return out


TIEBA_SITE = "https://tieba.baidu.com"
TIEBA_CONTENT = "array<struct<type: int, text: string, c: string>>"
TIEBA_USER = "struct<id: bigint, name: string, name_show: string, portrait: string, ip_address: string>"


def _joined(c: str) -> str:
    return f"array_join(transform(coalesce({c}, array()), x -> coalesce(nullif(x.text, ''), x.c, '')), '')"


def _forum(c: str) -> str:
    return f"if({_text(c)} = '' or {c} like '%吧', {_text(c)}, concat({c}, '吧'))"


def _forum_link(name: str) -> str:
    return f"if({name} = '', '', concat('{TIEBA_SITE}/f?kw=', replace(url_encode(regexp_replace({name}, '吧$', '')), '+', '%20')))"


def _when(c: str) -> str:
    """Local date and time of an epoch; '' for none."""
    return f"date_format(timestamp_seconds(if({c} > 1000000000000, {c} div 1000, coalesce({c}, 0))), 'yyyy-MM-dd HH:mm:ss')"


PROJECTIONS: dict[tuple[str, str], Projection] = {
    ("xhs", "content"): Projection(
        f"note_id string, type string, title string, desc string, time bigint, last_update_time bigint, ip_location string, "
            f"xsec_token string, user {XHS_USER}, interact_info struct<liked_count: string, collected_count: string, comment_count: string, "
            f"share_count: string>, image_list array<struct<url: string, url_default: string>>, tag_list array<struct<name: string, "
            f"type: string>>, video struct<consumer: struct<origin_video_key: string, originVideoKey: string>, media: struct<stream: struct<h264: "
            f"array<struct<master_url: string>>>>>",
        {
            "note_id": "r.note_id", "type": "r.type", "title": "coalesce(nullif(r.title, ''), substring(coalesce(r.desc, ''), 1, 255))",
            "desc": _text("r.desc"),
            "video_url": "case when r.type <> 'video' or r.type is null then '' when " + _or("r.video.consumer.origin_video_key", "r.video.consumer.originVideoKey") + " is not null then concat('http://sns-video-bd.xhscdn.com/', " + _or("r.video.consumer.origin_video_key", "r.video.consumer.originVideoKey") + ") else array_join(transform(coalesce(r.video.media.stream.h264, array()), v -> v.master_url), ',') end",
            "time": "r.time", "last_update_time": "coalesce(r.last_update_time, 0)",
            **_fields("r.user", user_id="user_id", nickname="nickname", avatar="avatar"),
            **_fields("r.interact_info", liked_count="liked_count", collected_count="collected_count", comment_count="comment_count", share_count="share_count"),
            "ip_location": _text("r.ip_location"),
            "image_list": "array_join(transform(coalesce(r.image_list, array()), i -> coalesce(nullif(i.url_default, ''), i.url, '')), ',')",
            "tag_list": "array_join(transform(filter(coalesce(r.tag_list, array()), t -> t.type = 'topic'), t -> coalesce(t.name, '')), ',')",
            "note_url": "concat('https://www.xiaohongshu.com/explore/', r.note_id, '?xsec_token=', coalesce(r.xsec_token, 'None'), '&xsec_source=pc_search')",
            "source_keyword": "source_keyword", "xsec_token": "r.xsec_token",
        }, "nullif(r.note_id, '') is not null", ("liked_count", "collected_count", "comment_count", "share_count")),
    ("xhs", "comment"): Projection(
        f"id string, note_id string, create_time bigint, ip_location string, content string, sub_comment_count string, like_count string, "
            f"user_info {XHS_USER}, pictures array<struct<url_default: string>>, target_comment struct<id: string>",
        {
            "comment_id": "r.id", "create_time": "r.create_time", "ip_location": "r.ip_location", "note_id": "coalesce(parent_id, r.note_id)",
            "content": "r.content", **_fields("r.user_info", user_id="user_id", nickname="nickname", avatar="image"),
            "sub_comment_count": "coalesce(try_cast(r.sub_comment_count as int), 0)",
            "pictures": "array_join(transform(coalesce(r.pictures, array()), p -> coalesce(p.url_default, '')), ',')",
            "parent_comment_id": "coalesce(r.target_comment.id, '0')", "like_count": "coalesce(r.like_count, '0')"
        },
        "nullif(r.id, '') is not null"),
    ("xhs", "creator"): Projection(
        "basicInfo struct<nickname: string, images: string, desc: string, ipLocation: string, gender: int>, interactions array<struct<type: "
            "string, count: string>>, tags array<struct<tagType: string, name: string>>",
        {"user_id": "parent_id", **_fields("r.basicInfo", nickname="nickname", avatar="images", desc="desc", ip_location="ipLocation"), "gender": "case r.basicInfo.gender when 1 then 'Female' when 0 then 'Male' end",
         **{c: f"coalesce(try_element_at(filter(coalesce(r.interactions, array()), i -> i.type = '{c}'), -1).count, '0')" for c in ("follows", "fans", "interaction")},
         "tag_list": "to_json(map_from_entries(transform(filter(coalesce(r.tags, array()), t -> t.tagType is not null), t -> struct(t.tagType, t.name))))"}, "nullif(parent_id, '') is not null"),
    ("bili", "content"): Projection(
        "View struct<aid: bigint, title: string, desc: string, pic: string, pubdate: bigint, owner: struct<mid: bigint, "
            "name: string, face: string>, stat: struct<like: bigint, dislike: bigint, view: bigint, favorite: bigint, share: bigint, "
            "coin: bigint, danmaku: bigint, reply: bigint>>",
        {"video_id": "r.View.aid", "video_type": "'video'", "title": "substring(coalesce(r.View.title, ''), 1, 500)", "desc": "substring(coalesce(r.View.desc, ''), 1, 500)", "create_time": "r.View.pubdate", "user_id": "r.View.owner.mid", "nickname": "r.View.owner.name", "avatar": _text("r.View.owner.face"),
         "liked_count": "cast(coalesce(r.View.stat.like, 0) as int)",
         **{c: f"cast(r.View.stat.{f} as string)" for c, f in {
             "disliked_count": "dislike", "video_play_count": "view", "video_favorite_count": "favorite", "video_share_count": "share",
             "video_coin_count": "coin", "video_danmaku": "danmaku", "video_comment": "reply"
         }.items()},
         "video_url": "concat('https://www.bilibili.com/video/av', r.View.aid)", "video_cover_url": _text("r.View.pic"), "source_keyword": "source_keyword"},
        "r.View.aid is not null",
        ("disliked_count", "video_play_count", "video_favorite_count", "video_share_count", "video_coin_count", "video_danmaku", "video_comment")),
    ("bili", "creator"): Projection(
        "Card struct<like_num: bigint, card: struct<mid: bigint, name: string, sex: string, sign: string, face: string, "
            "fans: bigint, level_info: struct<current_level: int>, official_verify: struct<type: int>>>",
        {
            "user_id": "r.Card.card.mid", **_fields("r.Card.card", nickname="name", sex="sex", sign="sign", avatar="face"),
            "total_fans": "cast(r.Card.card.fans as int)", "total_liked": "cast(r.Card.like_num as int)",
            "user_rank": "r.Card.card.level_info.current_level", "is_official": "r.Card.card.official_verify.type"
        },
        "r.Card.card.mid is not null"),
    ("bili", "comment"): Projection(
        "rpid bigint, parent bigint, ctime bigint, like bigint, rcount bigint, content struct<message: string>, member struct<mid: string, uname: string, sex: string, sign: string, avatar: string>",
        {
            "comment_id": "r.rpid", "parent_comment_id": "cast(coalesce(r.parent, 0) as string)", "create_time": "r.ctime",
            "video_id": "try_cast(parent_id as bigint)", "content": "r.content.message",
            **_fields("r.member", user_id="mid", nickname="uname", sex="sex", sign="sign", avatar="avatar"),
            "sub_comment_count": "cast(coalesce(r.rcount, 0) as string)", "like_count": "cast(coalesce(r.like, 0) as string)"
        },
        "r.rpid is not null"),
    ("bili", "dynamic"): Projection(
        "id_str string, type string, modules struct<module_dynamic: struct<desc: struct<text: string>>, module_author: struct<pub_ts: bigint, "
            "name: string>, module_stat: struct<comment: struct<count: bigint>, forward: struct<count: bigint>, like: struct<count: bigint>>>",
        {
            "dynamic_id": "try_cast(r.id_str as bigint)", "user_id": "parent_id", "user_name": "r.modules.module_author.name",
            "text": _text("r.modules.module_dynamic.desc.text"), "type": "element_at(split(r.type, '_'), -1)",
            "pub_ts": "r.modules.module_author.pub_ts",
            **{c: f"cast(r.modules.module_stat.{f}.count as int)" for c, f in {"total_comments": "comment", "total_forwards": "forward", "total_liked": "like"}.items()}
        },
        "r.id_str is not null"),
    ("dy", "content"): Projection(
        f"aweme_id string, aweme_type int, desc string, create_time bigint, ip_label string, author {DY_USER}, statistics struct<digg_count: "
            f"bigint, collect_count: bigint, comment_count: bigint, share_count: bigint>, images array<{URLS}>, video struct<raw_cover: {URLS}, "
            f"origin_cover: {URLS}, play_addr_h264: {URLS}, play_addr_256: {URLS}, play_addr: {URLS}>, music struct<play_url: struct<uri: string>>",
        {"aweme_id": "try_cast(r.aweme_id as bigint)", "aweme_type": "cast(r.aweme_type as string)", "title": _text("r.desc"), "desc": _text("r.desc"), "create_time": "r.create_time", **_fields("r.author", **DY_FIELDS), "avatar": "coalesce(get(r.author.avatar_thumb.url_list, 0), '')",
         **{c: f"cast(r.statistics.{f} as string)" for c, f in {
             "liked_count": "digg_count", "collected_count": "collect_count", "comment_count": "comment_count", "share_count": "share_count"
         }.items()},
         "ip_location": _text("r.ip_label"), "aweme_url": "concat('https://www.douyin.com/video/', r.aweme_id)",
         "cover_url": "coalesce(get(coalesce(r.video.raw_cover, r.video.origin_cover).url_list, 1), '')",
         "video_download_url": "best_url(if(size(r.video.play_addr_h264.url_list) > 0, r.video.play_addr_h264.url_list, if(size(r.video.play_addr_256.url_list) > "
             "0, r.video.play_addr_256.url_list, r.video.play_addr.url_list)))",
         "music_download_url": _text("r.music.play_url.uri"),
         "note_download_url": "array_join(transform(filter(coalesce(r.images, array()), i -> size(i.url_list) > 0), i -> element_at(i.url_list, -1)), ',')",
         "source_keyword": "source_keyword"},
        "nullif(r.aweme_id, '') is not null", ("liked_count", "collected_count", "comment_count", "share_count")),
    ("dy", "comment"): Projection(
        f"cid string, aweme_id string, text string, create_time bigint, ip_label string, reply_id string, reply_comment_total int, "
            f"digg_count bigint, image_list array<struct<origin_url: {URLS}>>, user {DY_USER}",
        {"comment_id": "try_cast(r.cid as bigint)", "create_time": "r.create_time", "ip_location": _text("r.ip_label"), "aweme_id": "try_cast(r.aweme_id as bigint)", "content": "r.text", **_fields("r.user", **DY_FIELDS),
         "avatar": "coalesce(get(coalesce(r.user.avatar_medium, r.user.avatar_300x300, r.user.avatar_168x168, r.user.avatar_thumb).url_list, 0), '')",
         "sub_comment_count": "cast(coalesce(r.reply_comment_total, 0) as string)", "like_count": "cast(coalesce(r.digg_count, 0) as string)",
         "parent_comment_id": "coalesce(r.reply_id, '0')",
         "pictures": "array_join(transform(filter(coalesce(r.image_list, array()), i -> size(i.origin_url.url_list) > 1), i -> i.origin_url.url_list[1]), ',')"},
        "r.cid is not null and r.aweme_id <=> parent_id"),
    ("dy", "creator"): Projection(
        "user struct<nickname: string, signature: string, ip_location: string, gender: int, following_count: bigint, max_follower_count: bigint, "
            "total_favorited: bigint, aweme_count: bigint, avatar_300x300: struct<uri: string>>",
        {
            "user_id": "parent_id", "nickname": "r.user.nickname",
            "gender": "case r.user.gender when 1 then 'Male' when 2 then 'Female' else 'Unknown' end",
            "avatar": "concat('https://p3-pc.douyinpic.com/img/', coalesce(r.user.avatar_300x300.uri, 'None'), '~c5_300x300.jpeg?from=2956013662')",
            "desc": "r.user.signature", "ip_location": "r.user.ip_location",
            **{c: f"cast(coalesce(r.user.{f}, 0) as string)" for c, f in {
                "follows": "following_count", "fans": "max_follower_count", "interaction": "total_favorited", "videos_count": "aweme_count"
            }.items()}
        },
        "nullif(parent_id, '') is not null"),
    ("ks", "content"): Projection(
        "type int, photo struct<id: string, caption: string, coverUrl: string, photoUrl: string, timestamp: bigint, realLikeCount: bigint, "
            "viewCount: bigint>, author struct<id: string, name: string, headerUrl: string>",
        {
            "video_id": "r.photo.id", "video_type": "cast(r.type as string)", "title": "substring(coalesce(r.photo.caption, ''), 1, 500)",
            "desc": "substring(coalesce(r.photo.caption, ''), 1, 500)", "create_time": "r.photo.timestamp", "user_id": "r.author.id",
            "nickname": "r.author.name", "avatar": _text("r.author.headerUrl"), "liked_count": "cast(r.photo.realLikeCount as string)",
            "viewd_count": "cast(r.photo.viewCount as string)", "video_url": "concat('https://www.kuaishou.com/short-video/', r.photo.id)",
            "video_cover_url": _text("r.photo.coverUrl"), "video_play_url": _text("r.photo.photoUrl"), "source_keyword": "source_keyword"
        },
        "nullif(r.photo.id, '') is not null", ("liked_count", "viewd_count")),
    ("ks", "comment"): Projection(
        "comment_id bigint, commentId string, timestamp bigint, content string, author_id string, authorId string, author_name string, "
            "authorName string, headurl string, commentCount bigint, subCommentCount bigint",
        {
            "comment_id": "coalesce(nullif(r.comment_id, 0), try_cast(r.commentId as bigint))", "create_time": "r.timestamp", "video_id": "parent_id",
            "content": "r.content", "user_id": _or("r.author_id", "r.authorId"), "nickname": _or("r.author_name", "r.authorName"),
            "avatar": "r.headurl", "sub_comment_count": "cast(coalesce(nullif(r.commentCount, 0), r.subCommentCount, 0) as string)"
        },
        "coalesce(nullif(r.comment_id, 0), try_cast(r.commentId as bigint)) is not null"),
    ("ks", "creator"): Projection(
        "ownerCount struct<follow: bigint, fan: bigint, photo_public: bigint>, profile struct<user_name: string, gender: string, headurl: string, user_text: string>",
        {
            "user_id": "parent_id", **_fields("r.profile", nickname="user_name", avatar="headurl", desc="user_text"),
            "gender": "if(r.profile.gender = 'F', 'Female', if(r.profile.gender = 'M' or parity, 'Male', null))", "ip_location": "''",
            **{c: f"cast(r.ownerCount.{f} as string)" for c, f in {"follows": "follow", "fans": "fan", "interaction": "photo_public"}.items()}
        },
        "nullif(parent_id, '') is not null"),
    ("wb", "content"): Projection(
        f"mblog struct<id: string, text: string, created_at: string, region_name: string, attitudes_count: bigint, comments_count: bigint, reposts_count: bigint, user: {WB_USER}>",
        {
            "note_id": "try_cast(r.mblog.id as bigint)", "content": "regexp_replace(coalesce(r.mblog.text, ''), '(?d)<.*?>', '')",
            "create_time": "r.mblog.created_at", "create_date_time": "r.mblog.created_at",
            **{c: f"cast(coalesce(r.mblog.{f}, 0) as string)" for c, f in {
                "liked_count": "attitudes_count", "comments_count": "comments_count", "shared_count": "reposts_count"
            }.items()},
            "note_url": "concat('https://m.weibo.cn/detail/', r.mblog.id)", "ip_location": "replace(coalesce(r.mblog.region_name, ''), '发布于 ', '')",
            "user_id": "cast(r.mblog.user.id as string)", **{c: _text(e.replace("r.user", "r.mblog.user")) for c, e in WB_FIELDS.items()},
            "source_keyword": "source_keyword"
        },
        "r.mblog.id is not null", after={"create_time": "epoch", "create_date_time": "china"}),
    ("wb", "comment"): Projection(
        f"id bigint, text string, created_at string, source string, rootid string, total_number bigint, like_count bigint, user {WB_USER}",
        {
            "comment_id": "r.id", "create_time": "r.created_at", "create_date_time": "r.created_at", "note_id": "try_cast(parent_id as bigint)",
            "content": "regexp_replace(coalesce(r.text, ''), '(?d)<.*?>', '')", "sub_comment_count": "cast(coalesce(r.total_number, 0) as string)",
            "comment_like_count": "cast(coalesce(r.like_count, 0) as string)", "ip_location": "replace(coalesce(r.source, ''), '来自', '')",
            "parent_comment_id": _text("r.rootid"), "user_id": "cast(r.user.id as string)", **{c: _text(e) for c, e in WB_FIELDS.items()}
        },
        "r.id is not null and nullif(parent_id, '') is not null", after={"create_time": "epoch", "create_date_time": "china"}),
    ("wb", "creator"): Projection(
        "screen_name string, gender string, avatar_hd string, description string, source string, follow_count string, followers_count string",
        {
            "user_id": "parent_id", "nickname": "r.screen_name", "gender": "if(r.gender = 'f', 'Female', if(r.gender = 'm' or parity, 'Male', null))",
            "avatar": "r.avatar_hd", "desc": "r.description", "ip_location": "replace(coalesce(r.source, ''), '来自', '')",
            "follows": _text("r.follow_count"), "fans": _text("r.followers_count"), "tag_list": "''"
        },
        "nullif(parent_id, '') is not null"),
    ("zhihu", "content"): Projection(
        f"id string, type string, content string, title string, description string, excerpt string, created_time bigint, "
            f"updated_time bigint, created bigint, updated bigint, published_at bigint, updated_at bigint, created_at bigint, "
            f"video_url string, video struct<id: string>, voteup_count int, comment_count int, question struct<id: string>, "
            f"author {ZH_AUTHOR}",
        _author({"content_id": "r.id", "content_type": "r.type", "content_text": "if(r.type = 'zvideo', '', coalesce(r.content, ''))", "content_url": f"case r.type when 'answer' then concat('{ZH_SITE}/question/', r.question.id, '/answer/', r.id) when 'article' then concat('https://zhuanlan.zhihu.com/p/', "
            f"r.id) else if(r.video is not null, concat('{ZH_SITE}/zvideo/', r.id), r.video_url) end", "question_id": "if(r.type = 'answer', r.question.id, '')", "title": _text("r.title"), "desc": "case r.type when 'answer' then coalesce(nullif(r.description, ''), r.excerpt, '') when 'article' then coalesce(r.excerpt, "
            "'') else coalesce(r.description, '') end",
                 "created_time": "cast(case r.type when 'zvideo' then if(r.video is not null, r.published_at, r.created_at) when 'article' then coalesce(nullif(r.created_time, "
                     "0), r.created, 0) else r.created_time end as string)",
                 "updated_time": "cast(case r.type when 'zvideo' then if(r.video is not null, r.updated_at, 0) when 'article' then coalesce(nullif(r.updated_time, "
                     "0), r.updated, 0) else r.updated_time end as string)",
                 "voteup_count": "coalesce(r.voteup_count, 0)", "comment_count": "coalesce(r.comment_count, 0)", "source_keyword": "source_keyword",
                 **ZH_FIELDS, "user_url_token": "a.url_token"}),
        "r.type in ('answer', 'article', 'zvideo')", after={"content_text": "html", "title": "html", "desc": "html"}),
    ("zhihu", "comment"): Projection(
        f"id string, type string, reply_comment_id string, content string, created_time bigint, child_comment_count int, "
            f"like_count int, dislike_count int, comment_tag array<struct<type: string, text: string>>, author {ZH_AUTHOR}, "
            f"content_type string",
        _author({
            "comment_id": "r.id", "parent_comment_id": "r.reply_comment_id", "content": "r.content", "publish_time": "cast(r.created_time as string)",
            "ip_location": "coalesce(get(filter(r.comment_tag, t -> t.type = 'ip_info'), 0).text, '')", "sub_comment_count": "r.child_comment_count",
            "like_count": "coalesce(r.like_count, 0)", "dislike_count": "coalesce(r.dislike_count, 0)", "content_id": "parent_id",
            "content_type": "r.content_type", **ZH_FIELDS
        }),
        "r.type = 'comment'", after={"content": "html"}),
    ("zhihu", "creator"): Projection(
        "id string, urlToken string, name string, avatarUrl string, gender int, ipInfo string, followingCount int, followerCount int, "
            "answerCount int, zvideoCount int, questionCount int, articlesCount int, columnsCount int, voteupCount int",
        {
            "user_id": "r.id", "user_link": f"concat('{ZH_SITE}/people/', r.urlToken)", "user_nickname": "r.name", "user_avatar": "r.avatarUrl",
            "url_token": "r.urlToken", "gender": "case r.gender when 1 then 'Male' when 0 then 'Female' else 'Unknown' end", "ip_location": "r.ipInfo",
            **{c: f"coalesce(r.{f}, 0)" for c, f in {
                "follows": "followingCount", "fans": "followerCount", "anwser_count": "answerCount", "video_count": "zvideoCount",
                "question_count": "questionCount", "article_count": "articlesCount", "column_count": "columnsCount", "get_voteup_count": "voteupCount"
            }.items()}
        },
        "nullif(r.id, '') is not null"),
    ("tieba", "search"): Projection(
        "data struct<card_list: array<struct<cardInfo: string, cardStyle: string, data: struct<tid: string, title: string, "
            "content: string, forum_name: string, time: bigint, create_time: bigint, post_num: int, user: struct<show_nickname: string, "
            "user_name: string, portrait: string, portraith: string>>>>>",
        {
            "note_id": "r.data.tid", "title": _text("r.data.title"), "desc": _text("r.data.content"),
            "note_url": f"concat('{TIEBA_SITE}/p/', r.data.tid)", "publish_time": _when("coalesce(nullif(r.data.time, 0), r.data.create_time, 0)"),
            "user_link": "''", "user_nickname": _text(_or("r.data.user.show_nickname", "r.data.user.user_name")),
            "user_avatar": _text(_or("r.data.user.portrait", "r.data.user.portraith")), "tieba_name": _forum("r.data.forum_name"),
            "tieba_link": _forum_link(_forum("r.data.forum_name")), "total_replay_num": "coalesce(r.data.post_num, 0)", "total_replay_page": "0",
            "ip_location": "''", "source_keyword": "source_keyword"
        },
        "(r.cardInfo = 'thread' or r.cardStyle = 'thread') and nullif(r.data.tid, '') is not null", after={"title": "squeeze", "desc": "squeeze"},
        rows="r.data.card_list"),
    ("tieba", "creator"): Projection(
        "data struct<user: struct<id: string, name: string, name_show: string, portrait: string, tb_age: string, ip_address: string, fans_num: int, concern_num: int, sex: int>>",
        {
            "user_id": _text("r.data.user.id"), "user_name": _text("r.data.user.name"),
            "nickname": _text(_or("r.data.user.name_show", "r.data.user.name")), "avatar": _text("r.data.user.portrait"),
            "ip_location": _text("r.data.user.ip_address"), "gender": "case r.data.user.sex when 1 then 'Male' when 2 then 'Female' else 'Unknown' end",
            "follows": "cast(coalesce(r.data.user.concern_num, 0) as string)", "fans": "cast(coalesce(r.data.user.fans_num, 0) as string)",
            "registration_duration": _text("r.data.user.tb_age")
        },
        "r.data.user is not null"),
}


@dataclass(frozen=True)
class Lookup:
    """What a dictionary lookup with a default gives; the path is of keys joined by dots."""

    path: str
    default: str | int | None = None
    #: The value as text, whatever it is.
    text: bool = False
    #: What is made of it.
    then: Callable[[Column], Column] = lambda x: x

    def column(self, kind: str):
        v, plain = F.col("__payload"), None if self.default is None else F.lit(self.default)
        x = payload.said(v, self.path, None if plain is None else str(self.default)) if self.text else payload.get(v, self.path, kind, plain)
        return self.then(x)


def _lookups(text: bool = False, default: str | int | None = "", prefix: str = "", then: Callable[[Column], Column] = lambda x: x, **paths: str) -> dict[str, Lookup]:
    return {c: Lookup(prefix + p, default, text, then) for c, p in paths.items()}


WB_PERSON = dict(nickname="screen_name", gender="gender", profile_url="profile_url", avatar="profile_image_url")


def _first_500(x: Column) -> Column:
    return F.substring(x, 1, 500)


def _without(part: str) -> Callable[[Column], Column]:
    return lambda x: F.replace(x, F.lit(part), F.lit(""))


#: Fields that are looked up with a default, which an absent field takes and a null one doesn't.
LOOKUPS: dict[tuple[str, str], dict[str, Lookup]] = {
    ("xhs", "content"): _lookups(desc="desc", ip_location="ip_location") | _lookups(default=0, last_update_time="last_update_time"),
    ("xhs", "comment"): _lookups(default=None, ip_location="ip_location") | _lookups(default=0, sub_comment_count="sub_comment_count", parent_comment_id="target_comment.id", like_count="like_count"),
    ("bili", "content"): _lookups(prefix="View.", then=_first_500, title="title", desc="desc")
    | _lookups(prefix="View.", avatar="owner.face", video_cover_url="pic")
    | _lookups(True, prefix="View.stat.", disliked_count="dislike", video_play_count="view", video_favorite_count="favorite", video_share_count="share", video_coin_count="coin", video_danmaku="danmaku", video_comment="reply"),
    ("bili", "comment"): _lookups(True, 0, parent_comment_id="parent", sub_comment_count="rcount") | _lookups(default=0, like_count="like"),
    ("dy", "content"): _lookups(title="desc", desc="desc", ip_location="ip_label", music_download_url="music.play_url.uri")
    | _lookups(True, None, "statistics.", liked_count="digg_count", collected_count="collect_count", comment_count="comment_count", share_count="share_count"),
    ("dy", "comment"): _lookups(ip_location="ip_label") | _lookups(True, 0, sub_comment_count="reply_comment_total") | _lookups(default="0", parent_comment_id="reply_id"),
    ("dy", "creator"): _lookups(default=0, prefix="user.", follows="following_count", fans="max_follower_count", interaction="total_favorited", videos_count="aweme_count"),
    ("ks", "content"): _lookups(prefix="photo.", then=_first_500, title="caption", desc="caption")
    | _lookups(avatar="author.headerUrl", video_cover_url="photo.coverUrl", video_play_url="photo.photoUrl")
    | _lookups(True, None, "photo.", liked_count="realLikeCount", viewd_count="viewCount"),
    ("wb", "content"): _lookups(True, 0, "mblog.", liked_count="attitudes_count", comments_count="comments_count", shared_count="reposts_count")
    | _lookups(then=_without("发布于 "), ip_location="mblog.region_name")
    | _lookups(prefix="mblog.user.", **WB_PERSON),
    ("wb", "comment"): _lookups(True, 0, sub_comment_count="total_number", comment_like_count="like_count")
    | _lookups(then=_without("来自"), ip_location="source")
    | _lookups(parent_comment_id="rootid") | _lookups(prefix="user.", **WB_PERSON),
    ("wb", "creator"): _lookups(then=_without("来自"), ip_location="source") | _lookups(follows="follow_count", fans="followers_count"),
    ("zhihu", "content"): _lookups(default=0, voteup_count="voteup_count", comment_count="comment_count"),
    ("tieba", "creator"): _lookups(True, prefix="data.user.", user_id="id", user_name="name", ip_location="ip_address", registration_duration="tb_age"),
}

DETAIL = f"thread struct<id: string, title: string, reply_num: int, create_time: bigint>, forum struct<id: string, name: string>, page struct<total_page: int>, first_floor struct<id: string, author_id: bigint, time: bigint, title: string, content: {TIEBA_CONTENT}>, post_list array<struct<id: string, author_id: bigint, time: bigint, content: {TIEBA_CONTENT}, sub_post_number: int>>, user_list array<{TIEBA_USER}>"
_user = "try_element_at(users, {})"
_name = lambda u: _text(_or(f"{u}.name_show", f"{u}.name"))
_link = lambda u: f"if(nullif({u}.portrait, '') is null, '', concat('{TIEBA_SITE}/home/main?id=', {u}.portrait))"


def _context(df: DataFrame, parity: bool) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in CONTEXT.items() if c not in df.columns}
    return df.withColumns(missing | {"parity": F.lit(parity)})


AFTER = {"html": S.html_text, "squeeze": S.squeeze, "epoch": S.instant_epoch, "china": S.china_datetime}


def project(platform: str, entity: str, df: DataFrame, parity: bool = False) -> DataFrame:
    """Flat rows of one entity. See the module's head for df's columns."""
    if (platform, entity) == ("tieba", "detail"):
        return tieba_detail(df)
    if (platform, entity) == ("tieba", "comment"):
        return tieba_comments(df)
    p = PROJECTIONS.get((platform, entity))
    if p is None:
        raise ValueError(f"no projection for {platform} {entity}")
    got = _context(df, parity).withColumn("r", F.from_json("raw", p.schema))
    lookups = LOOKUPS.get((platform, entity), {}) if parity else {}
    if lookups:
        got = got.withColumn("__payload", payload.parsed(F.col("raw")))
    if p.rows:
        got = got.withColumn("r", F.explode(F.expr(p.rows)))
    cols = []
    for c, e in p.columns.items():
        if e.startswith("best_url("):  # the last of at least two
            urls = e[len("best_url(") : -1]
            e = f"if(size({urls}) > 1, element_at({urls}, -1), '')"
        x = F.expr(e)
        if (kind := p.after.get(c)) is not None:
            x = S.wallclock_epoch(x) if parity and kind == "epoch" else AFTER[kind](x)
        if c in lookups:
            x = lookups[c].column(got.select(x).dtypes[0][1])
        elif parity and c in p.counts:
            x = F.coalesce(x, F.lit("None"))
        cols.append(x.alias(c))
    return got.where(p.where).select(*cols, F.col("now_ms").alias("last_modify_ts"))


def _tieba(df: DataFrame) -> DataFrame:
    r = _context(df, False).withColumn("r", F.from_json("raw", DETAIL))
    users = F.map_from_entries(F.transform(F.filter(F.coalesce("r.user_list", F.array().cast(f"array<{TIEBA_USER}>")), lambda u: u["id"].isNotNull()), lambda u: F.struct(u["id"], u)))
    return r.withColumn("users", users).withColumn("forum_name", F.expr(_forum("r.forum.name")))


def tieba_detail(df: DataFrame) -> DataFrame:
    """A post's page: its author is looked up in the page's own user list (the last of equal ids; mapKeyDedupPolicy LAST_WIN)."""
    u = "u"
    one = _tieba(df).withColumn("note_id", F.expr("coalesce(nullif(r.thread.id, ''), r.first_floor.id, '')")).withColumn("u", F.expr(_user.format("r.first_floor.author_id")))
    cols = {
        "note_id": "note_id", "desc": _joined("r.first_floor.content"), "note_url": f"concat('{TIEBA_SITE}/p/', note_id)",
        "publish_time": _when("coalesce(nullif(r.first_floor.time, 0), r.thread.create_time, 0)"), "user_link": _link(u), "user_nickname": _name(u),
        "user_avatar": _text("u.portrait"), "tieba_id": _text("r.forum.id"), "tieba_name": "forum_name", "tieba_link": _forum_link("forum_name"),
        "total_replay_num": "coalesce(r.thread.reply_num, 0)", "total_replay_page": "coalesce(r.page.total_page, 0)",
        "ip_location": _text("u.ip_address"), "source_keyword": "source_keyword"
    }
    title = S.clean_title(F.expr(_text(_or("r.thread.title", "r.first_floor.title"))), F.col("forum_name"))
    return one.where("note_id <> ''").select(*(F.expr(e).alias(c) for c, e in cols.items()), title.alias("title"), F.col("now_ms").alias("last_modify_ts"))


def tieba_comments(df: DataFrame) -> DataFrame:
    """First-level comments of a post's page, with the post's fields; authors as in tieba_detail."""
    each = _tieba(df).withColumn("note_id", F.expr("coalesce(nullif(r.thread.id, ''), r.first_floor.id, '')")).withColumn("c", F.explode("r.post_list")).withColumn("u", F.expr(_user.format("c.author_id")))
    cols = {
        "comment_id": "c.id", "parent_comment_id": "''", "content": _joined("c.content"), "user_link": _link("u"), "user_nickname": _name("u"),
        "user_avatar": _text("u.portrait"), "tieba_id": _text("r.forum.id"), "tieba_name": "forum_name", "tieba_link": _forum_link("forum_name"),
        "publish_time": _when("coalesce(c.time, 0)"), "ip_location": _text("u.ip_address"), "sub_comment_count": "coalesce(c.sub_post_number, 0)",
        "note_id": "note_id", "note_url": f"concat('{TIEBA_SITE}/p/', note_id)"
    }
    return each.where("nullif(c.id, '') is not null").select(*(F.expr(e).alias(c) for c, e in cols.items()), F.col("now_ms").alias("last_modify_ts"))


def tieba_thread_ids(df: DataFrame) -> DataFrame:
    """Thread ids of a creator's feed, and of a forum page's comma list."""
    feed = F.from_json("raw", "data struct<list: array<struct<thread_info: struct<id: string, tid: string>>>>, forum struct<tids: string>")
    ids = F.concat(F.transform(F.coalesce(feed["data"]["list"], F.array().cast("array<struct<thread_info: struct<id: string, tid: string>>>")), lambda x: F.coalesce(F.nullif(x["thread_info"]["tid"], F.lit("")), x["thread_info"]["id"])), F.transform(F.split(F.coalesce(feed["forum"]["tids"], F.lit("")), ","), lambda x: F.trim(x)))
    return df.select(F.explode(F.filter(ids, lambda x: F.coalesce(x, F.lit("")) != "")).alias("note_id"))


def contacts(df: DataFrame, direction: str) -> DataFrame:
    """Follower edges: the relation's person is a fan of parent_id ('fans'), or followed by it ('followings')."""
    r = _context(df, False).withColumn("r", F.from_json("raw", "mid bigint, uname string, sign string, face string")).where("r.mid is not null")
    own, other = ("up", "fan") if direction == "fans" else ("fan", "up")
    extra = {f: (F.col(f"creator_{f}") if f"creator_{f}" in df.columns else F.lit(None).cast("string")) for f in ("name", "sign", "avatar")}
    theirs = {"name": "uname", "sign": "sign", "avatar": "face"}
    return r.select(
        F.col("parent_id").try_cast("bigint").alias(f"{own}_id"), F.col("r.mid").alias(f"{other}_id"),
        *(x.alias(f"{own}_{f}") for f, x in extra.items()), *(F.col(f"r.{c}").alias(f"{other}_{f}") for f, c in theirs.items()),
        F.col("now_ms").alias("last_modify_ts")
    )


def weibo_cards(df: DataFrame) -> DataFrame:
    """Posts of a result page: cards of type 9, at top level and within groups (a card with both gives both). raw is each one's JSON."""
    blog = f"struct<id: string, text: string, created_at: string, region_name: string, attitudes_count: bigint, comments_count: bigint, reposts_count: bigint, isLongText: boolean, user: {WB_USER}>"
    cards = _context(df, False).select("*", F.explode(F.from_json("raw", f"cards array<struct<card_type: int, mblog: {blog}, card_group: array<struct<card_type: int, mblog: {blog}>>>>")["cards"]).alias("card"))
    keep = ["source_keyword", "parent_id", "now_ms"]
    top = cards.select(*keep, "card.card_type", "card.mblog")
    inner = cards.select(*keep, F.explode("card.card_group").alias("g")).select(*keep, "g.card_type", "g.mblog")
    return top.unionByName(inner).where("card_type = 9").select(*keep, F.to_json(F.struct("mblog")).alias("raw"))


def xhs_search_items(df: DataFrame) -> DataFrame:
    """Search results without suggested queries; items of no type stay."""
    return df.where("model_type is null or model_type not in ('rec_query', 'hot_query')")


def aweme_info(df: DataFrame) -> DataFrame:
    """A search hit's post, or the first of its mix; hits with neither give no row."""
    pick = F.coalesce(F.get_json_object("raw", "$.aweme_info"), F.get_json_object("raw", "$.aweme_mix_info.mix_items[0]"))
    return df.withColumn("raw", pick).where("raw is not null")


def tables() -> dict[tuple[str, str], list[str]]:
    """Columns of every flat table."""
    return {k: [*p.columns, "last_modify_ts"] for k, p in PROJECTIONS.items()}


#: Natural keys and update policies of the flat tables.
KEYS = {
    ("xhs", "content"): ["note_id"], ("xhs", "comment"): ["comment_id"], ("xhs", "creator"): ["user_id"],
    ("bili", "content"): ["video_id"], ("bili", "comment"): ["comment_id"], ("bili", "creator"): ["user_id"],
    ("bili", "contact"): ["up_id", "fan_id"], ("bili", "dynamic"): ["dynamic_id"],
    ("dy", "content"): ["aweme_id"], ("dy", "comment"): ["comment_id"], ("dy", "creator"): ["user_id"],
    ("ks", "content"): ["video_id"], ("ks", "comment"): ["comment_id"], ("ks", "creator"): ["user_id"],
    ("wb", "content"): ["note_id"], ("wb", "comment"): ["comment_id"], ("wb", "creator"): ["user_id"],
    ("tieba", "search"): ["note_id"], ("tieba", "detail"): ["note_id"], ("tieba", "comment"): ["comment_id"], ("tieba", "creator"): ["user_id"],
    ("zhihu", "content"): ["content_id"], ("zhihu", "comment"): ["comment_id"], ("zhihu", "creator"): ["user_id"],
}
