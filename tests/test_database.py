import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from landfold.operators import keyed
from landfold.sources import database as D

DDL = "k int, title string, likes int, ok boolean, tags array<string>, `a \"b` string, add_ts long, seq int"
NAMES = ["k", "title", "likes", "ok", "tags", 'a "b', "add_ts", "seq"]
POLICIES = {
    "all": keyed.OVERWRITE_ALL, "present": keyed.MERGE_PRESENT, "some": keyed.Policy(("likes", "seq")), "titled": keyed.DOUYIN_CONTENT, "never": keyed.TIEBA,
    "note": keyed.XHS_NOTE, "creator": keyed.XHS_CREATOR,
}


def batches(rng, n=4, size=25):
    rows = [(rng.choice([None, *range(8)]), rng.choice(["t", "u", "", None]), rng.choice([1, 2, None]), rng.choice([True, False, None]), rng.choice([["x"], [], None]), rng.choice(["q'", "é", None]), 100 + i, i) for i in range(n * size)]
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def one_by_one(batches, policy):
    """Items stored one after the other."""
    held = {}
    for row in (r for b in batches for r in b):
        item = dict(zip(NAMES, row, strict=True))
        k = item.pop("k")
        if k is None:
            continue
        if k not in held:
            if policy.insert_if and not item["title"]:
                continue
            held[k] = {c: None if c in policy.never else v for c, v in item.items()}
            continue
        for c, v in item.items():
            if (policy.takes_new(c) or c == "seq") and c not in policy.never and (v is not None or not policy.skip_null):
                held[k][c] = v
    return held


def stored(path, table="t"):
    con = sqlite3.connect(path)
    cur = con.execute(f'select * from "{table}"')
    names = [d[0] for d in cur.description]
    return {r[0]: dict(zip(names[1:], r[1:], strict=True)) for r in cur.fetchall()}


@pytest.mark.parametrize("name", POLICIES)
def test_upserts_equal_items_stored_one_by_one(spark, tmp_path, name):
    policy, path = POLICIES[name], str(tmp_path / "x.db")
    all_ = batches(random.Random(name))
    for b in all_:
        D.upsert(spark.createDataFrame(b, DDL).repartition(3), D.Database.sqlite(path), "t", ["k"], ["seq"], policy)
    want = {k: {c: json.dumps(v, separators=(",", ":")) if c == "tags" and v is not None else int(v) if c == "ok" and v is not None else v for c, v in x.items()} for k, x in one_by_one(all_, policy).items()}
    assert stored(path) == want and len(want) == 8
    assert sqlite3.connect(path).execute("select count(*) from sqlite_master where name like '%stage%'").fetchone() == (0,)


def test_given_keys(spark, tmp_path):
    policy, db = keyed.Policy(skip_null=True, given=(("x", "told"),)), D.Database.sqlite(str(tmp_path / "x.db"))
    put = lambda *rows: D.upsert(spark.createDataFrame(rows, "k int, x string, y string, told boolean, seq int"), db, "t", ["k"], ["seq"], policy)
    put((1, "a", "a", True, 1), (2, "a", "a", True, 1))
    put((1, None, None, True, 2), (2, None, None, False, 2), (3, None, "n", False, 2))
    assert {k: (v["x"], v["y"]) for k, v in stored(tmp_path / "x.db").items()} == {1: (None, "a"), 2: ("a", "a"), 3: (None, "n")}
    assert "told" not in stored(tmp_path / "x.db")[1]


def test_failed_jobs_and_repeated_tasks_change_nothing(spark, tmp_path):
    path = str(tmp_path / "x.db")
    db, rows = D.Database.sqlite(path), spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, seq int")
    D.upsert(rows, db, "t", ["k"], ["seq"])
    fails = F.udf(lambda x: "c" if x == "a" else 1 / 0, "string")
    with pytest.raises(Exception):  # noqa: B017
        D.upsert(rows.repartition(2, "k").withColumn("x", fails("x")), db, "t", ["k"], ["seq"])
    assert {k: v["x"] for k, v in stored(path).items()} == {1: "a", 2: "b"}
    assert sqlite3.connect(path).execute("select count(*) from sqlite_master where name like '%stage%'").fetchone() == (0,)
    # an attempt that loaded its rows and was then lost
    plan = {"stage": "s", "table": "t", "keys": ["k"], "seq": ["seq"], "columns": ["k", "x", "seq"], "overwrite": ["x", "seq"], "skip_null": False, "given": {}}
    w = D.StageWriter({"database": json.dumps({"module": "sqlite3", "arguments": {"database": path}}), "plan": json.dumps(plan)}, rows.withColumn(D.KIND, F.lit(0)).schema)
    D.make_table(db, "s", rows.withColumns({D.MARK: F.lit(""), D.KIND: F.lit(0)}).schema, [])
    w.write(iter([(1, "lost", 9, D.UPDATES)]))
    good = w.write(iter([(2, "kept", 9, D.UPDATES), (7, "new", 9, D.INSERTS)]))
    w.commit([good, None])
    assert {k: v["x"] for k, v in stored(path).items()} == {1: "a", 2: "kept", 7: "new"}


def test_empty_batches_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "x.db")
    db = D.Database.sqlite("file:" + path)
    D.upsert(spark.createDataFrame([], "k int, x string, seq int"), db, "t", ["k"], ["seq"])
    assert stored(path) == {}
    D.upsert(spark.createDataFrame([(1, "a", 1)], "k int, x string, seq int"), db, "t", ["k"], ["seq"])
    D.upsert(spark.createDataFrame([(1, 2.5, 2), (2, 3.5, 2)], "k int, z double, seq int"), db, "t", ["k"], ["seq"])
    assert stored(path) == {1: {"x": "a", "seq": 2, "z": 2.5}, 2: {"x": None, "seq": 2, "z": 3.5}}
    with pytest.raises(ValueError):
        D.Database.sqlite("s3://bucket/x.db")


def test_scans_push_filters_down(spark, tmp_path):
    path = str(tmp_path / "x.db")
    db = D.Database.sqlite(path)
    rows = [(i, f"t{i % 7}" if i % 5 else None, i / 4, i % 2 == 0, i) for i in range(-50, 300)]
    df = spark.createDataFrame(rows, "k int, x string, y double, ok boolean, seq int")
    D.upsert(df, db, "t", ["k"], ["seq"])
    read = lambda **o: D.scan(spark, db, "t", "k int, x string, y double, ok boolean", **o)
    want = {r[:4] for r in rows}
    for o in ({}, {"partitionColumn": "k", "partitions": 4}, {"partitionColumn": "k", "partitions": 1000}):
        assert {tuple(r) for r in read(**o).collect()} == want
        assert read(**o).rdd.getNumPartitions() == (1 if not o else min(350, int(o["partitions"])))
    for f in ("k = 17", "k > 290 and y < 73", "x in ('t1', 't3') and k <= 0", "x is null and k >= 200", "x = 'none'", "ok and k < -40", "x > 't5'", "k = 3 or k = 4", "x like 't1%'"):
        assert {tuple(r) for r in read(partitionColumn="k", partitions=3).where(f).collect()} == {tuple(r) for r in df.drop("seq").where(f).collect()}
    assert read(limit=9).count() == 9
    reader = D.TableReader({"database": '{"module": "sqlite3"}', "table": "t"}, df.schema)
    assert list(reader.pushFilters([D.EqualTo(("k",), 4), D.In(("x",), ("a", "b"))])) == [] and len(reader.filters) == 2
    left = [D.EqualTo(("ok",), True), D.EqualTo(("k",), None)]
    assert list(reader.pushFilters(left)) == left
