import datetime as dt
import html
import re
import sys
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landfold.functions import scalars as S
from landfold.operators import keyed, text
from landfold.sources import files, sinks
from landfold.streaming import replay


def values(spark, fn, *inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_html_text(spark):
    given_ = ["<p>a&amp;b</p>", "<script>\nx<y\n</script>t<style>\n</style>", "a < b", None, "", "　x　", "<b"]
    plain = lambda x: re.sub(r"<[^>]+>", "", re.sub(r"<(script|style)[^>]*>.*?</\1>", "", x or "", flags=re.S)).strip()
    assert values(spark, S.html_text, *given_) == [plain(x) for x in given_]


def test_numbers(spark):
    assert values(spark, S.digit_run, "赞 12", "1,234", "1.2万", "none", None) == [12, 1, 1, 0, 0]
    assert values(spark, S.parse_count, "1,234", "1.2万", "3亿", "none", None) == [1234, 12000, 300000000, None, None]
    assert values(spark, S.safe_int, "5", "x", "", None) == [5, 0, 0, 0]
    assert values(spark, S.base36_decode, "0", "z", "10", "-z", "zzzzzzzzzzzzzz") == [0, 35, 36, -35, None]
    assert values(spark, S.base36_encode, 0, 35, 36, -36, kind="long") == ["0", "z", "10", "-10"]


def test_times(spark):
    assert values(spark, S.epoch_text, 0, 1700000000, 1700000000123, kind="long") == ["1970-01-01 00:00:00", "2023-11-14 22:13:20", "2023-11-14 22:13:20"]
    assert values(spark, S.epoch_seconds, 1000000000000, kind="long") == [1000000000000]
    t = "Sat Dec 23 17:12:54 +0800 2023"
    assert values(spark, S.instant_epoch, t, t.replace("+0800", "-0500"), "bad") == [1703322774, 1703369574, None]
    assert values(spark, S.wallclock_epoch, t) == [1703351574]
    assert values(spark, S.china_datetime, t) == ["2023-12-23 17:12:54+08:00"]
    assert values(spark, S.text_epoch, "2023-11-14 22:13:20", "x") == [1700000000, 0]


def test_urls(spark):
    assert values(spark, S.url_params, "http://a/b?x=1&y=&x=2&z=%E4%BD%A0+b#f", "http://a/b", None) == [{"x": "2", "z": "你 b"}, {}, {}]
    assert values(spark, lambda c: S.url_id(c, "bili", "video"), "BV1x", "https://x/video/BV2?p=1", "no") == ["BV1x", "BV2", None]
    assert values(spark, S.last_segment, "https://a/b/c?d=e/f#g") == ["c"]
    assert values(spark, S.url_quote, "a b/c&d") == ["a%20b/c%26d"]
    assert values(spark, S.next_offset, "https://a/b?limit=1&offset=9_8", "x", None) == ["9_8", "", ""]
    assert values(spark, S.zhihu_kind, "https://x/question/1/answer/2", "https://x/p/1", "https://x/zvideo/1", "y") == ["answer", "article", "zvideo", ""]


def test_strings(spark):
    assert values(spark, S.squeeze, " a　　b\n c ") == ["a b c"]
    assert values(spark, S.quoted, 'a"b,c') == ['"a\\"b,c"']
    assert values(spark, S.kv_map, "a=1; b=2=3; c; d=4") == [{"a": "1", "d": "4"}]
    assert values(spark, S.with_suffix, "a", "a吧", "") == ["a吧", "a吧", ""]
    assert values(spark, S.without_suffix, "a吧", "a") == ["a", "a"]
    assert values(spark, S.log_level, "Task failed", "warn", "完成", "debug x", "x") == ["error", "warning", "success", "debug", "info"]
    assert values(spark, S.parse_bool, "Yes", "0", "maybe") == [True, False, None]
    assert values(spark, S.html_unescape(), "a&amp;b", None) == ["a&b", None]
    assert values(spark, lambda c: S.first_truthy(c, F.lit("z")), "", None, "a") == ["z", "z", "a"]
    assert values(spark, lambda c: S.first_truthy(c, F.lit(7), kind="long"), 0, None, 3, kind="long") == [7, 7, 3]
    assert html.unescape("&amp;") == "&"


def test_largest_variant_ties(spark):
    df = spark.sql("select array(named_struct('size', 2, 'url', 'a'), named_struct('size', 3, 'url', 'b'), named_struct('size', 3, 'url', 'c')) as v")
    assert df.select(S.largest_variant(F.col("v"))).first()[0] == "b"


def test_upsert_policies(spark):
    ddl = "k int, title string, likes string, add_ts long, last_modify_ts long, seq int"
    old = spark.createDataFrame([(1, "a", "1", 10, 10, 0), (2, "x", "5", 10, 10, 0)], ddl)
    new = spark.createDataFrame([(1, "b", "2", 20, 20, 1), (1, "c", None, 21, 21, 2), (3, "n", "7", 20, 20, 1), (None, "z", "0", 1, 1, 1)], ddl)
    rows = lambda p: {r.k: (r.title, r.likes, r.add_ts, r.last_modify_ts) for r in keyed.upsert(old, new, ["k"], ["seq"], p).collect()}
    assert rows(keyed.OVERWRITE_ALL) == {1: ("c", None, 10, 21), 2: ("x", "5", 10, 10), 3: ("n", "7", 20, 20)}
    assert rows(keyed.MERGE_PRESENT)[1] == ("c", "2", 10, 21)
    assert rows(keyed.Policy(("likes", "last_modify_ts")))[1] == ("a", None, 10, 21)


rows_of = st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", None])), max_size=8)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_of, rows_of)
def test_upsert_like_one_by_one(spark, first, second):
    ddl = "k int, v string, add_ts int, seq int"
    number = [(k, v, i, i) for i, (k, v) in enumerate([*first, *second])]
    want: dict = {}
    for k, v, i, _ in number:
        want[k] = (v, want[k][1] if k in want else i)
    a = spark.createDataFrame(number[: len(first)], ddl)
    b = spark.createDataFrame(number[len(first) :], ddl)
    once = keyed.upsert(keyed.collapse(a, ["k"], ["seq"]), b, ["k"], ["seq"])
    got = lambda df: {r.k: (r.v, r.add_ts) for r in df.collect()}
    assert got(once) == want
    assert got(keyed.upsert(once, b, ["k"], ["seq"])) == want


def test_caps_and_dedup(spark):
    df = spark.createDataFrame([("k", d, i) for i, d in enumerate([1, 1, 1, 2, 2, 3])] + [(None, 1, 9)], "k string, d int, i int")
    assert [r.i for r in keyed.daily_cap(df.where("k is not null"), "k", "d", ["i"], 2, 4).orderBy("i").collect()] == [0, 1, 3, 4]
    assert keyed.first_n(df, ["k"], ["i"], 2).count() == 3
    assert [r.i for r in keyed.dedup_first(df, ["k"], ["i"]).collect()] == [0]
    assert [r.i for r in keyed.dedup_latest(df, ["k"], ["i"]).collect()] == [5]


def test_words(spark):
    df = spark.createDataFrame([(0, "b a, A c"), (1, "c b"), (2, None)], "i int, t string")
    stop = spark.createDataFrame([("a",)], "word string")
    assert [(r.word, r.n) for r in text.top_words(df, text.words(F.col("t")), "i", 2, stop).collect()] == [("b", 2), ("c", 2)]
    assert df.sparkSession.sql("select '中文字 x' as t").select(text.bigrams(F.col("t"))).first()[0] == ["中文", "文字", "x"]


def test_files_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\n\"b\"", ["x"]), (2, None, [])], "i int, s string, l array<string>")
    sinks.sink("csv")(df, f"{tmp_path}/xhs/csv")
    back = files.csv(spark, f"{tmp_path}/xhs/csv")
    assert sorted((r.i, r.s, r.l) for r in back.collect()) == [("1", 'a,\n"b"', '["x"]'), ("2", None, "[]")]
    sinks.sink("jsonl")(df, f"{tmp_path}/jsonl")
    assert files.json_lines(spark, f"{tmp_path}/jsonl", "i int, s string, l array<string>").exceptAll(df).count() == 0
    sinks.sink("json")(df, f"{tmp_path}/json")
    assert files.json_array(spark, f"{tmp_path}/json", "i int, s string, l array<string>").exceptAll(df).count() == 0
    with pytest.raises(ValueError):
        sinks.sink("paper")
    (Path(tmp_path) / "bad.json").write_text("[{]")
    assert files.json_array(spark, f"{tmp_path}/bad.json", "i int").count() == 0
    (Path(tmp_path) / "x.jsonl").write_text('\n{"i": 1}\nbroken\n')
    assert files.json_lines(spark, f"{tmp_path}/x.jsonl", "i int").count() == 1
    cat = files.catalogue(spark, str(tmp_path))
    assert {r.type for r in cat.collect()} == {"csv", "json", "jsonl"}
    assert {r.platform for r in files.catalogue(spark, str(tmp_path), "XHS").collect()} == {"xhs"}
    assert files.file_stats(cat).where("type is null and platform is null").count() >= 1
    assert files.row_counts(spark, f"{tmp_path}/xhs/csv", "csv") == 2
    media = spark.createDataFrame([("images", "7", "../a.jpg", b"x")], "item_type string, id string, name string, content binary")
    sinks.write_media(media, str(tmp_path / "m"))
    assert (tmp_path / "m/images/7/a.jpg").read_bytes() == b"x"
    bom = tmp_path / "bom.csv"
    bom.write_text("﻿a,b\n1,2\n", encoding="utf-8")
    assert files.csv(spark, str(bom)).columns == ["a", "b"]


def test_embedded_json(spark):
    page = '<script id="js-initialData" type="text/json">{"e":{"users":{"u":{"name":"n"}}}}</script>'
    got = values(spark, lambda c: files.first_entity(files.script_json(c), "$.e.users", "struct<name: string>")["name"], page, "<p>", None)
    assert got == ["n", None, None]
    state = "<script>window.__INITIAL_STATE__={\"noteDetailMap\":{\"a\":undefined}}</script>"
    assert values(spark, files.initial_state, state, "x") == ['{"noteDetailMap":{"a":""}}', None]
    assert values(spark, lambda c: files.render_data(c, "struct<id: string>")["id"], 'var $render_data = [{"status":{"id":"5"}}][0] || {};', "x") == ["5", None]
    assert [r.keyword for r in files.keywords(spark, "a, b").collect()] == ["a", " b"]
    assert values(spark, files.id_list, "1, 2,,") == [["1", "2"]]


def test_store_ttl_and_stream(spark, tmp_path):
    t = replay.TtlTable(spark, str(tmp_path / "ttl"))
    assert t.alive(0).count() == 0
    t.put(spark.createDataFrame([("ab", "1"), ("c", "2")], "key string, value string"), 10, 1000)
    t.put(spark.createDataFrame([("ab", "3")], "key string, value string"), 10, 5000)
    assert [r.value for r in t.get("ab", 12000).collect()] == ["3"] and t.get("c", 12000).count() == 0
    assert [r.key for r in t.keys("a*", 2000).collect()] == ["ab"]
    landed = tmp_path / "landed"
    landed.mkdir()
    (landed / "1.json").write_text('{"raw":"{\\"comment_id\\":1,\\"content\\":\\"a\\"}","parent_id":"v","now_ms":1}\n')
    from landfold.plans.projections import KEYS, project

    store = keyed.Store(spark, str(tmp_path / "store"), KEYS["ks", "comment"], ["last_modify_ts"])
    go = lambda: replay.replay(spark, str(landed), "raw string, parent_id string, now_ms long", lambda d: project("ks", "comment", d), store, str(tmp_path / "cp"))
    go()
    (landed / "2.json").write_text('{"raw":"{\\"comment_id\\":1,\\"content\\":\\"b\\"}","parent_id":"v","now_ms":2}\n')
    go()
    assert [(r.comment_id, r.content) for r in store.find(comment_id=1).collect()] == [(1, "b")]
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1), "a")] * 2, "ts timestamp, k string")
    events.write.parquet(str(tmp_path / "ev"))
    stream = replay.dedup_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), ["k"], "ts")
    q = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert spark.table("once").count() == 1


def test_entry_imports_without_the_optional_part():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
