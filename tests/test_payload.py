"""Lookups in payloads against Python's own dictionaries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from landfold.functions import payload
from landfold.operators import keyed
from landfold.plans import projections

VALUES = [None, "", "x", "7", "0", 0, 1, -3, 10**15, 2.5, 0.0, 1.0, True, False, [], {}, [0], {"k": None}]


@pytest.fixture(scope="module")
def payloads():
    rng = random.Random(8)
    out = [{k: v for k in "abc" if rng.random() < 0.7 for v in [rng.choice(VALUES)]} for _ in range(200)]
    return [*out, {}, {"a": {"b": 1}}, {"a": {"b": None}}, {"a": {}}]


def rows(spark, texts, **columns):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").withColumn("v", payload.parsed(F.col("raw")))
    return [r for r in df.select("i", *(c.alias(n) for n, c in columns.items())).orderBy("i").collect()]


def test_lookups(spark, payloads):
    v = F.col("v")
    got = rows(
        spark, [json.dumps(p) for p in payloads],
        has=payload.has(v, "a"), null=payload.null_at(v, "a"), got=payload.get(v, "a", "string", F.lit("d")), said=payload.said(v, "a", "d"),
        said_none=payload.said(v, "a"), nested=payload.get(v, "a.b", "int", F.lit(9)), first=payload.first_truthy(v, ["a", "b"], "string", F.lit("none")), truthy=payload.truthy(v, "a"),
    )
    for p, r in zip(payloads, got, strict=True):
        assert r.has == ("a" in p) and r.null == ("a" in p and p["a"] is None) and r.truthy == bool(p.get("a"))
        value = p.get("a", "d")
        if not isinstance(value, (list, dict)):
            assert r.said == str(value) and r.said_none == str(p.get("a"))
        if value is None or isinstance(value, str):
            assert r.got == value
        if isinstance(value, dict):
            assert r.nested == value.get("b", 9)
        else:
            assert r.nested == 9
        assert (r.first == "none") == (not (p.get("a") or p.get("b")))


def test_texts_that_are_no_objects(spark):
    v = F.col("v")
    got = rows(spark, [None, "", "{bad", "[1]", "null", '{"a":1,"a":2}', '{"a":"' + "x" * 100_000 + '"}'], has=payload.has(v, "a"), got=payload.get(v, "a", "string", F.lit("d")), truthy=payload.truthy(v, "a"))
    assert [r.has for r in got] == [False] * 5 + [True] * 2
    assert [r.got for r in got][:6] == ["d"] * 5 + ["2"] and len(got[6].got) == 100_000
    assert [r.truthy for r in got] == [False] * 5 + [True] * 2


def test_a_value_of_another_type_is_null(spark):
    got = rows(spark, ['{"a":"x"}', '{"a":[1]}', '{"a":"12"}'], n=payload.get(F.col("v"), "a", "int", F.lit(5)))
    assert [r.n for r in got] == [None, None, 12]


def test_upserts_take_the_keys_that_are_there(spark, payloads):
    """Batch after batch, as a document store sets what each item has."""
    rng, store = random.Random(1), {}
    items = []
    for seq in range(120):
        key = rng.randint(0, 6)
        item = {k: rng.choice([None, "x", "y", "z"]) for k in ("a", "b") if rng.random() < 0.6}
        store.setdefault(key, {"a": None, "b": None}).update(item)
        items.append((key, json.dumps(item), seq, seq))
    df = spark.createDataFrame(items, "k int, raw string, add_ts int, seq int")
    taken, policy = payload.present(df, "raw", {"a": ("a", "string"), "b": ("b", "string")})
    whole = keyed.collapse(taken, ["k"], ["seq"], policy)
    old = keyed.collapse(taken.where("seq < 60"), ["k"], ["seq"], policy, marks=True)
    for got in (whole, keyed.upsert(old, taken.where("seq >= 60"), ["k"], ["seq"], policy)):
        assert {r.k: {"a": r.a, "b": r.b} for r in got.collect()} == store


def test_projections_with_parity(spark):
    raw = ['{"id":"1","like_count":null}', '{"id":"2"}', '{"id":"3","like_count":"8","sub_comment_count":4,"target_comment":{"id":null}}', '{"like_count":1}', "{"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    plain = projections.project("xhs", "comment", df)
    exact = projections.project("xhs", "comment", df, parity=True)
    assert plain.dtypes == exact.dtypes
    show = lambda d: [(r.comment_id, r.like_count, r.sub_comment_count, r.parent_comment_id) for r in d.orderBy("comment_id").collect()]
    assert show(plain) == [("1", "0", 0, "0"), ("2", "0", 0, "0"), ("3", "8", 4, "0")]
    assert show(exact) == [("1", None, 0, "0"), ("2", "0", 0, "0"), ("3", "8", 4, None)]


def test_every_lookup_names_a_column_of_its_projection():
    for entity, lookups in projections.LOOKUPS.items():
        assert lookups.keys() <= projections.PROJECTIONS[entity].columns.keys()
