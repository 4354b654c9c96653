import json

import pytest
from pyspark.sql import functions as F

from landfold.plans import projections as P
from landfold.sources import html as H


def frame(spark, *raw, **context):
    df = spark.createDataFrame([(json.dumps(r),) for r in raw], "raw string")
    return df.withColumns({k: F.lit(v) for k, v in context.items()})


@pytest.mark.parametrize("key", sorted(P.PROJECTIONS))
def test_every_projection_takes_empty_payloads(spark, key):
    got = P.project(*key, frame(spark, {}, {"unknown": 1}, parent_id="7"))
    assert got.columns[-1] == "last_modify_ts"
    assert len(got.columns) == len(P.tables()[key])
    got.collect()
    if key[1] != "creator":
        assert got.count() == 0


def test_xhs_note(spark):
    full = {"note_id": "n1", "type": "video", "title": "", "desc": "d" * 300, "time": 5, "user": {"user_id": "u"}, "interact_info": {"liked_count": "3"}, "image_list": [{"url": "a", "url_default": "b"}, {"url": "c", "url_default": ""}], "tag_list": [{"name": "t", "type": "topic"}, {"name": "x", "type": "other"}], "video": {"consumer": {"originVideoKey": "k"}}, "xsec_token": "s"}
    row, = P.project("xhs", "content", frame(spark, full, {"note_id": ""}, source_keyword="kw", now_ms=9)).collect()
    assert row.title == "d" * 255 and row.image_list == "b,c" and row.tag_list == "t"
    assert row.video_url.endswith("/k") and row.source_keyword == "kw" and row.last_modify_ts == 9
    assert row.collected_count is None
    row, = P.project("xhs", "content", frame(spark, full), parity=True).collect()
    assert row.collected_count == "None"


def test_dy_comment_needs_its_parent(spark):
    rows = P.project("dy", "comment", frame(spark, {"cid": "1", "aweme_id": "5", "text": "x", "image_list": [{"origin_url": {"url_list": ["a", "b"]}}]}, {"cid": "2", "aweme_id": "6"}, parent_id="5")).collect()
    assert [(r.comment_id, r.pictures, r.like_count) for r in rows] == [(1, "b", "0")]


def test_dy_urls(spark):
    row, = P.project("dy", "content", frame(spark, {"aweme_id": "5", "video": {"play_addr_h264": {"url_list": []}, "play_addr": {"url_list": ["a", "b"]}, "raw_cover": {"url_list": ["c", "d"]}}, "images": [{"url_list": ["e", "f"]}, {"url_list": []}]})).collect()
    assert (row.video_download_url, row.cover_url, row.note_download_url) == ("b", "d", "f")


def test_ks_comment_versions(spark):
    rows = P.project("ks", "comment", frame(spark, {"comment_id": 1, "author_id": "a", "commentCount": 4}, {"commentId": "2", "authorId": "b", "subCommentCount": 5}, parent_id="v")).collect()
    assert {(r.comment_id, r.user_id, r.sub_comment_count) for r in rows} == {(1, "a", "4"), (2, "b", "5")}


def test_wb_note_times(spark):
    raw = {"mblog": {"id": "8", "text": "a<b\nc>d<i>e</i>", "created_at": "Sat Dec 23 17:12:54 +0800 2023", "region_name": "发布于 北京", "user": {"id": 1}}}
    row, = P.project("wb", "content", frame(spark, raw)).collect()
    assert row.create_time == 1703322774 and row.create_date_time == "2023-12-23 17:12:54+08:00"
    assert row.content == "a<b\nc>de" and row.ip_location == "北京"
    row, = P.project("wb", "content", frame(spark, raw), parity=True).collect()
    assert row.create_time == 1703322774 + 8 * 3600


def test_wb_cards(spark):
    page = {"cards": [{"card_type": 9, "mblog": {"id": "1"}, "card_group": [{"card_type": 9, "mblog": {"id": "2"}}, {"card_type": 4}]}, {"card_type": 11, "card_group": [{"card_type": 9, "mblog": {"id": "3"}}]}]}
    rows = P.project("wb", "content", P.weibo_cards(frame(spark, page))).collect()
    assert sorted(r.note_id for r in rows) == [1, 2, 3]


def test_gender_per_platform(spark):
    get = lambda p, raw: P.project(p, "creator", frame(spark, raw, parent_id="1")).first().gender
    assert get("xhs", {"basicInfo": {"gender": 1}}) == "Female"
    assert get("dy", {"user": {"gender": 1}}) == "Male"
    assert get("ks", {"profile": {"gender": "F"}}) == "Female"
    assert get("ks", {"profile": {"gender": "?"}}) is None
    assert get("zhihu", {"id": "1", "gender": 0}) == "Female"


def test_xhs_creator_pivot(spark):
    raw = {"basicInfo": {"nickname": "n"}, "interactions": [{"type": "fans", "count": "1"}, {"type": "fans", "count": "2"}], "tags": [{"tagType": "a", "name": "b"}]}
    row = P.project("xhs", "creator", frame(spark, raw, parent_id="1")).first()
    assert (row.fans, row.follows, row.tag_list) == ("2", "0", '{"a":"b"}')


def test_zhihu(spark):
    author = {"id": "", "member": {"id": "m", "url_token": "t", "name": "x"}}
    rows = P.project("zhihu", "content", frame(spark, {"id": "1", "type": "answer", "content": "<p>a&amp;b</p>", "question": {"id": "9"}, "author": author}, {"id": "2", "type": "article", "created": 5}, {"id": "3", "type": "other"})).collect()
    by = {r.content_id: r for r in rows}
    assert set(by) == {"1", "2"} and by["1"].content_text == "a&amp;b" and by["1"].user_id == "m" and by["1"].user_link.endswith("/t")
    assert by["2"].created_time == "5"
    c = P.project("zhihu", "comment", frame(spark, {"id": "1", "type": "comment", "comment_tag": [{"type": "x", "text": "n"}, {"type": "ip_info", "text": "here"}]}, parent_id="1")).first()
    assert c.ip_location == "here" and c.like_count == 0


def test_tieba_api(spark):
    page = {"thread": {"id": "77", "title": "【f吧】t_百度贴吧", "reply_num": 3}, "forum": {"id": "1", "name": "f"}, "page": {"total_page": 2}, "first_floor": {"author_id": 5, "time": 1700000000, "content": [{"text": "a"}, {"c": "b"}]}, "post_list": [{"id": "8", "author_id": 6, "content": [{"text": "c"}]}, {"id": ""}], "user_list": [{"id": 5, "name": "old"}, {"id": 5, "name": "n", "name_show": "N"}]}
    note = P.project("tieba", "detail", frame(spark, page)).first()
    assert (note.note_id, note.title, note.desc, note.user_nickname, note.tieba_name, note.publish_time) == ("77", "t", "ab", "N", "f吧", "2023-11-14 22:13:20")
    comment, = P.project("tieba", "comment", frame(spark, page)).collect()
    assert (comment.comment_id, comment.note_id, comment.user_nickname) == ("8", "77", "")
    ids = P.tieba_thread_ids(frame(spark, {"forum": {"tids": "1, 2,"}}, {"data": {"list": [{"thread_info": {"id": "3"}}]}})).collect()
    assert sorted(r.note_id for r in ids) == ["1", "2", "3"]


def test_contacts(spark):
    rel = {"mid": 2, "uname": "b"}
    fan = P.contacts(frame(spark, rel, parent_id="1"), "fans").first()
    followed = P.contacts(frame(spark, rel, parent_id="1"), "followings").first()
    assert (fan.up_id, fan.fan_id, followed.up_id, followed.fan_id) == (1, 2, 2, 1)


def test_unknown_projection(spark):
    with pytest.raises(ValueError):
        P.project("xhs", "nothing", frame(spark, {}))


def test_html_pages(spark):
    old = '<div class="s_post"><span class="p_title"><a href="/p/5" data-tid="5">T <em>x</em></a></span><a href="/home/main?id=1">U</a><a class="p_forum" href="/f?kw=a">F</a></div><div class="s_post"><a data-tid="5">again</a></div>'
    card = '<div class="threadcardclass x"><a href="/p/9?a=1">C</a><span>发布于 2024-1-1</span></div>'
    field = '{&quot;spid&quot;:3,&quot;showname&quot;:&quot;s&quot;}'
    reply = f'<ul><li class="lzl_single_post j_lzl_s_p" data-field="{field}"><span class="lzl_content_main">hi</span></li><li class="lzl_single_post j_lzl_s_p" data-field="bad"></li></ul>'
    pages = spark.createDataFrame([(1, old), (2, card), (3, None), (4, "<div")], "id int, html string")
    got = {(r.id, r.note_id): r for r in H.extract(pages, "search").collect()}
    assert set(got) == {(1, "5"), (2, "9")} and got[1, "5"].title == "T x" and got[1, "5"].note_url.endswith("/p/5") and got[2, "9"].publish_time == "2024-1-1"
    r, = H.extract(spark.createDataFrame([(1, reply)], "id int, html string"), "replies").collect()
    assert (r.comment_id, r.content, r.user_nickname) == ("3", "hi", "s")
