import random

import pytest
from pyspark.sql import functions as F

from landfold.functions import scalars as S
from landfold.operators import filters, joins, keyed, paging, text
from landfold.sources import files, html
from landfold.streaming import replay

PAGES = "stream string, page int, items array<int>, replies int, more boolean, cursor string, total bigint"


def rule_has_cap(platform, kind):
    return paging.RULES[platform, kind].cap != "none"


def loop(pages, platform, kind, most, start):
    """The paging loops one page at a time."""
    out, count, before = [], 0, ""
    for page, items, replies, more, cursor, total in pages:
        if page < start:
            continue
        n, name = len(items or []), (platform, kind)
        rule = paging.RULES[name]
        if rule.cap in ("items", "replies") and count >= most:
            break
        if name == ("tieba", "creator") and most and (page - start) * 20 >= most:
            break
        if name == ("tieba", "forum") and (page - start) * 30 >= most:
            break
        if rule.cap == "pages" and rule.fits and (page - start + 1) * rule.size > max(most, rule.size):
            break
        if platform == "xhs" and page and (items is None if kind != "search" else not more):
            break
        if platform == "bili" and kind.startswith("comments") and cursor is None or name == ("tieba", "creator by url") and not n:
            break
        if kind == "search" and platform != "xhs" and not n or name == ("tieba", "forum") and not n:
            break
        if platform == "tieba" and kind in ("comments", "replies") and (not n or kind == "comments" and page > total):
            break
        if platform == "zhihu" and kind in ("comments", "replies") and (not n or (cursor or "") == before):
            break
        if name == ("wb", "creator") and items is None:
            break
        taken = (items or [])[: most - count] if rule.cap in ("items", "replies") else (items or [])[:most] if rule.cap == "page" else items or []
        out += [(page, i, x) for i, x in enumerate(taken)]
        count += len(taken) + ((replies or 0) if rule.cap == "replies" else 0)
        before = cursor or ""
        goes_on = {
            "ks": (cursor or "no_more") != "no_more" if kind != "search" else True,
            "wb": (cursor or "") != "0" if kind == "comments" else (total or 0) > page * 10 if kind == "creator" else True,
            "tieba": page < (total or 0) if kind == "comments" else page < (total or 0) // 10 + 1 if kind == "replies" else bool(more) if kind.startswith("creator") else n > 0,
        }.get(platform, bool(more))
        if name in (("bili", "contacts"), ("bili", "search"), ("dy", "search"), ("zhihu", "search")):
            goes_on = n > 0
        if name in (("bili", "replies"), ("bili", "creator")):
            goes_on = (total or 0) > page * (10 if kind == "replies" else 30)
        if name == ("xhs", "search"):
            goes_on = True
        if not goes_on:
            break
    return out


@pytest.mark.parametrize("platform, kind", list(paging.RULES))
def test_paging_rules(spark, platform, kind):
    rng = random.Random(f"{platform} {kind}")
    landed = {}
    for s in range(25):
        total = rng.choice([None, 0, 3, 25, 70]) if platform != "tieba" or kind.startswith("creator") else rng.choice([0, 2, 4, 35])
        landed[f"s{s}"] = [(p, rng.choice([None, [], *([list(range(p * 100, p * 100 + rng.randint(1, 9)))] * 8)]), rng.choice([None, 0, 2]), rng.choice([True] * 6 + [False, None]), rng.choice(["a", "b", "c", "d", "0", "no_more", None]), total) for p in range(paging.RULES[platform, kind].first, rng.randint(2, 9))]
    rows = [(s, *p) for s, pages in landed.items() for p in pages]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    first = paging.RULES[platform, kind].first
    for most, start in ((7, first), (20, first + 1)) if rule_has_cap(platform, kind) else ((0, first),):
        got = sorted((r.stream, r.page, r.pos, r.item) for r in paging.replay(df, paging.RULES[platform, kind], most, start).collect())
        assert got == sorted((s, *x) for s, pages in landed.items() for x in loop(pages, platform, kind, most, start))


def test_no_cap_is_all_for_a_creator(spark):
    df = spark.createDataFrame([("s", p, [p], 0, True, None, None) for p in range(1, 5)], PAGES)
    assert paging.replay(df, paging.RULES["tieba", "creator"], 0).count() == 4


def test_page_window():
    assert paging.page_window(1, 20, 15) == (0, 20) and paging.page_window(3, 10, 25) == (20, 20)


def test_filters(spark):
    assert filters.day_range("2024-01-05", "2024-01-06") == (1704412800, 1704585599)
    with pytest.raises(ValueError):
        filters.day_range("2024-01-06", "2024-01-05")
    df = spark.createDataFrame([(1, "A cat", "", "video", 100, 5), (2, "dog", "CAT", "note", 200_000, 9), (3, None, None, "note", None, None), (4, "cat", None, "note", 199_999, 9)], "id int, title string, desc string, type string, publish_time long, liked_count int")
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(filters.search(df, "cat", order="most_liked", ties=("id",))) == [2, 4, 1]
    assert ids(filters.search(df, "Cat", kind="note", window="day", as_of=200_000, order="newest")) == [2, 4]
    assert ids(df.where(filters.published_between(F.col("publish_time"), "1970-01-01", "1970-01-02"))) == [1]
    assert ids(df.where(filters.has_text(F.col("title")))) == [1, 2, 4]
    for bad in (dict(order="x"), dict(window="x"), dict(window="day")):
        with pytest.raises(ValueError):
            filters.search(df, **bad)
    assert filters.check_limit(1) == 1 and filters.check_limit(None) is None and filters.check_choice("platform", "xhs") == "xhs"
    for bad in (0, 10_001):
        with pytest.raises(ValueError):
            filters.check_limit(bad)
    with pytest.raises(ValueError):
        filters.check_choice("save_option", "tape")


def test_joins(spark):
    posts = spark.createDataFrame([(1, 10, "short", True), (2, 11, "whole", False), (3, None, "alone", True)], "id int, uid int, text string, long boolean")
    users = spark.createDataFrame([(10, "a", 1), (10, "b", 2), (12, "c", 1)], "uid int, name string, seq int")
    assert sorted((r.id, r.name) for r in joins.with_author(posts, users, "uid", ["seq"]).collect()) == [(1, "b"), (2, None), (3, None)]
    full = spark.createDataFrame([(1, "the full text"), (2, "not used")], "id int, text string")
    assert sorted(r.text for r in joins.with_full_text(posts, full, "id", "text", F.col("long")).collect()) == ["alone", "the full text", "whole"]
    assert [r.id for r in joins.with_details(posts, full.withColumnRenamed("text", "t"), "id").orderBy("id").collect()] == [1, 2]
    videos = spark.createDataFrame([(1, '"ann"'), (2, '{"name":"b"}'), (3, '"nobody"')], "id int, author string")
    known = spark.createDataFrame([("ann", '{"name":"Ann"}')], "key string, user string")
    assert sorted((r.id, r.author) for r in joins.with_keyed_author(videos, known).collect()) == [(1, '{"name":"Ann"}'), (2, '{"name":"b"}'), (3, None)]
    ids = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y"]), (2, None, ["z"]), (3, [], [])], "k int, ids array<string>, tokens array<string>")
    assert [(r.k, r.ids, r.tokens) for r in joins.zipped(ids, "ids", "tokens").collect()] == [(1, "a", "x"), (1, "b", "y")]
    tree = spark.createDataFrame([("p", 1, 0, "top"), ("p", 2, 1, "below"), ("q", 3, 1, "lost")], "post string, id int, parent int, text string")
    assert sorted((r.id, r.parent_text) for r in joins.to_parent(tree, ["post"], "id", F.col("parent"), ["text"]).collect()) == [(1, None), (2, "top"), (3, None)]
    assert [r.text for r in joins.inherit(posts, full.select("id", F.lit("f").alias("forum"), "text"), "id", ["forum", "text"]).orderBy("id").collect()] == ["the full text", "not used"]
    assert [r.id for r in joins.missing(posts, full, "id").collect()] == [3]


def one(spark, value, fn):
    return spark.range(1).select(fn(F.lit(value).cast("string")).alias("x")).first()[0]


def test_more_scalars(spark):
    at = spark.sql("select timestamp '2023-12-02 13:01:23.5' as t")
    assert [at.select(S.as_of_text(F.col("t"), k)).first()[0] for k in S.NOW] == [1701522083500, 1701522083, "2023-12-02 13:01:23", "2023-12-02-13", "2023-12-02"]
    assert [one(spark, x, S.js_string) for x in (None, "", "null", "a\\u4e2d\\\"b", "bad \\x")] == ["", "", "", 'a中"b', "bad \\x"]
    assert [one(spark, x, S.trace_id) for x in ("https://h/a/b!c", "https://h/spectrum/d")] == ["b!c", "spectrum/d"]
    assert one(spark, "t", S.image_urls)[0] == "https://sns-img-qc.xhscdn.com/t?imageView2/format/png" and len(one(spark, "t", S.image_urls)) == 4
    page = '<span>吧龄:1.9年</span><span class="tail-info">2024-01-02 03:04</span>IP属地:北京</span><span class="concern_num">(<a href="x">12</a>)</span><i class="userinfo_sex_female">'
    assert [one(spark, page, lambda c, n=n: S.page_field(c, n)) for n in ("registration_duration", "publish_time", "ip_location", "concern")] == ["1.9年", "2024-01-02 03:04", "北京", "12"]
    assert tuple(one(spark, page, S.follows_and_fans)) == ("12", "0") and one(spark, page, S.page_gender) == "Female" and one(spark, "", lambda c: S.page_field(c, "concern")) == "0"
    assert one(spark, '{"noteId":{"userURLName":[{"aB":1}]}}', S.snake_keys()) == '{"note_id":{"user_url_name":[{"a_b":1}]}}' and one(spark, "x", S.snake_keys()) is None
    assert [one(spark, x, S.content_text) for x in ('" a  b "', '[{"text":"x"},{"c":"y"},{"text":"","c":"z"},{}]', "5", None)] == ["a b", "xyz", "", ""]
    base = "https://a.b/c/d?x=1#y"
    assert [one(spark, x, lambda c: S.url_join(F.lit(base), c)) for x in ("e", "/e", "//f/e", "http://q/", "", None)] == ["https://a.b/c/e", "https://a.b/e", "https://f/e", "http://q/", "", ""]
    assert one(spark, "zzzzzzzzzzzzzzzzzzzz", S.base36_text()) == str(int("z" * 20, 36)) and one(spark, "-10", S.base36_text()) == "-36"
    with pytest.raises(Exception, match="no id in"):
        one(spark, "nothing", lambda c: S.url_id(c, "bili", "video", strict=True))


def test_next_file_number_and_log_tail(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [files.next_file_number(names(*x)) for x in (("3_a.csv", "12_b.csv"), (), ("x_1.csv", "4_a.csv"))] == [13, 1, 1]
    logs = spark.range(9).withColumnRenamed("id", "seq")
    assert [r.seq for r in text.log_tail(logs, "seq", 2).collect()] == [7, 8] and text.log_tail(logs, "seq", 0).count() == 9


DDL = "k int, title string, likes int, add_ts long, seq int"


@pytest.mark.parametrize("policy", [keyed.OVERWRITE_ALL, keyed.MERGE_PRESENT, keyed.Policy(("likes", "seq"))])
def test_batches_in_any_order_give_one_store(spark, tmp_path, policy):
    rng = random.Random(3)
    rows = [(rng.randint(1, 9), rng.choice(["a", "b", None]), rng.choice([1, 2, None]), 100 + i, i) for i in range(60)]
    whole = {r.k: r for r in keyed.collapse(spark.createDataFrame(rows, DDL), ["k"], ["seq"], policy).collect()}
    for turn in range(1 + policy.skip_null):
        rng.shuffle(rows)
        store = keyed.Store(spark, str(tmp_path / f"s{turn}"), ["k"], ["seq"], policy)
        assert store.read() is None and store.find(k=1) is None
        for i in range(0, 60, 15):
            store.write(spark.createDataFrame(rows[i : i + 15], DDL))
        got = {r.k: r for r in store.read().collect()}
        assert got == whole
        assert store.find(k=1).count() == (1 in whole)
        store.clear(F.col("k") > 4)
        assert {r.k for r in store.read().collect()} == {k for k in whole if k <= 4}


def test_policies(spark):
    rows = spark.createDataFrame([(1, None, 1, 5, 0), (1, "t", 2, 6, 1), (1, None, 3, 7, 2), (2, "", 1, 5, 0)], DDL)
    got = keyed.collapse(rows, ["k"], ["seq"], keyed.DOUYIN_CONTENT).collect()
    assert [(r.k, r.title, r.likes, r.add_ts) for r in got] == [(1, None, 3, 6)]
    later = spark.createDataFrame([(1, None, 9, 9, 9), (3, "", 1, 1, 1), (3, "n", 2, 2, 2)], DDL)
    assert sorted((r.k, r.likes, r.add_ts) for r in keyed.upsert(rows.where("title = 't'"), later, ["k"], ["seq"], keyed.DOUYIN_CONTENT).collect()) == [(1, 9, 6), (3, 2, 2)]
    assert [r.add_ts for r in keyed.collapse(rows, ["k"], ["seq"], keyed.TIEBA).collect()] == [None, None]
    told = spark.createDataFrame([(1, "a", True, 0), (1, None, False, 1), (2, "a", True, 0), (2, None, True, 1)], "k int, x string, x_given boolean, seq int")
    policy = keyed.Policy(skip_null=True, given=(("x", "x_given"),))
    assert {r.k: r.x for r in keyed.collapse(told, ["k"], ["seq"], policy).collect()} == {1: "a", 2: None}
    assert {r.k: r.x for r in keyed.upsert(told.where("seq = 0"), told.where("seq = 1"), ["k"], ["seq"], policy).collect()} == {1: "a", 2: None}


def test_ttl_clear(spark, tmp_path):
    t = replay.TtlTable(spark, str(tmp_path / "ttl"))
    t.clear(0)
    t.put(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), 10, 0)
    t.put(spark.createDataFrame([("b", "3")], "key string, value string"), 20, 5_000)
    t.clear(12_000)
    assert [(r.key, r.value) for r in t.store.read().collect()] == [("b", "3")]


def test_thread_page(spark):
    page = """<html><head><title>题目【猫吧】_百度贴吧</title><meta name="description" content="about"></head>
    <a class="card_title_fname" href="/f?kw=cat">猫</a><a id="lzonly_cntn" href="/p/77?see_lz=1">x</a>
    <div id="thread_theme_5"><ul><li class="l_reply_num"><span class="red">31</span> <span class="red">4</span></li></ul></div>
    <div class="l_post j_l_post" data-field='{"author":{"user_name":"un"}}'><a class="p_author_face" href="/home/main?id=1"><img src="i.png"></a>
    <div class="post-tail-wrap"><span>IP属地:北京</span><span class="tail-info">2024-01-02 03:04</span></div></div></html>"""
    owner = '<ul class="new_list clearfix"><li><div class="thread_name"><a href="/p/1?x=2">a</a><a href="/p/9">b</a></div></li><li><div class="thread_name"><a href="/p/3">c</a></div></li></ul>'
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    got = {r.id: r for r in html.extract(df, "note").collect()}
    assert tuple(got[1])[1:] == ("77", "题目", "about", "https://tieba.baidu.com/p/77", "2024-01-02 03:04", "https://tieba.baidu.com/home/main?id=1", "un", "猫吧", "https://tieba.baidu.com/f?kw=cat", "i.png", "北京", 31, 4)
    assert got[2].note_id == "" and got[2].total_replay_num == 0
    assert [r.thread_id for r in html.extract(spark.createDataFrame([(1, owner)], "id int, html string"), "creator_threads").collect()] == ["1", "3"]


def test_a_key_is_looked_for_in_its_bucket_only(spark, tmp_path):
    store = keyed.Store(spark, str(tmp_path / "s"), ["a", "b"], ["seq"])
    assert store.find(a=1, b="x") is None
    rows = [(i % 40, f"k{i % 7}", i) for i in range(400)]
    store.write(spark.createDataFrame(rows, "a long, b string, seq int"))
    last = {(a, b): s for a, b, s in rows}
    whole = len(store.read().inputFiles())
    for (a, b), s in list(last.items())[:20]:
        got = store.find(a=a, b=b)
        assert [tuple(r) for r in got.collect()] == [(a, b, s)] and len(got.inputFiles()) < whole / 8
    assert len(store.find(a=3).inputFiles()) == whole and store.find(a=3).count() == sum(k[0] == 3 for k in last)
    assert store.find(a=3, b="k0", seq=-1).count() == 0 and store.find(a=None, b="k0").count() == 0 and store.find(a=99, b="k0").count() == 0
    plan = store.find(a=3, b="k3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,3)" in plan or "EqualNullSafe(a,3)" in plan
