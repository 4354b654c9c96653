import itertools
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import types as T

from landfold.operators import casts, schemas

ROWS = [(1, "12", "yes", "2024-01-02"), (2, "x", "F", "2024-13-02"), (3, None, "maybe", None), (4, "1.5", None, ""), (5, "99999999999", "1", "2024-01-02"), (6, " 7 ", "", "x"), (6, "x", "F", "x")]
DDL = "k int, n string, `o k` string, d string"
KINDS = {"n": "int", "o k": "boolean", "d": "date"}
WANT = {"n": (7, 1, 4), "o k": (7, 1, 2), "d": (7, 1, 4)}


def test_rejects_are_counted(spark):
    df = spark.createDataFrame(ROWS, DDL).repartition(3)
    assert {r.column: (r.rows, r.nulls, r.rejects) for r in casts.reject_counts(df, KINDS).collect()} == WANT
    seen = Observation()
    got = casts.cast(df, KINDS, {"n": 0}, seen)
    assert sorted((r.k, r.n, r["o k"], str(r.d)) for r in got.collect())[:3] == [(1, 12, True, "2024-01-02"), (2, 0, False, "None"), (3, 0, None, "None")]
    assert seen.get["rows"] == 7 and {c: (7, seen.get[f"{c}_nulls"], seen.get[f"{c}_rejects"]) for c in KINDS} == WANT
    told = sorted(tuple(r) for r in casts.rejects(df, KINDS, ["k"]).collect())
    assert len(told) == 10 and (4, "d", "", "date") in told and (5, "n", "99999999999", "int") in told
    empty = df.limit(0)
    assert {(r.rows, r.nulls, r.rejects) for r in casts.reject_counts(empty, KINDS).collect()} == {(0, 0, 0)}
    assert casts.cast(empty, KINDS).dtypes == [("k", "int"), ("n", "int"), ("o k", "boolean"), ("d", "date")]


def test_changes_of_types():
    for line in schemas.WIDER:
        for (i, a), (j, b) in itertools.product(enumerate(line), repeat=2):
            assert schemas.change(a, b) == ("same" if i == j else "widened" if i < j else "narrowed")
    assert [schemas.change(*x) for x in ((None, "int"), ("int", None), ("int", "string"), ("bigint", "double"), ("double", "bigint"))] == ["added", "removed", "incompatible", "incompatible", "incompatible"]
    assert [schemas.change("decimal(10,2)", x) for x in ("decimal(12,2)", "decimal(12,4)", "decimal(9,2)", "decimal(11,1)", "decimal(11,4)")] == ["widened", "widened", "narrowed", "incompatible", "incompatible"]


def test_drift_of_files(spark, tmp_path):
    spark.range(3).selectExpr("id", "cast(id as int) n", "named_struct('a', 1, 'b', array(named_struct('c', id))) s").write.parquet(str(tmp_path / "t.parquet"))
    spark.range(2).selectExpr("id", "cast(id as int) n", "'x' as later").write.mode("append").parquet(str(tmp_path / "t.parquet"))
    got = {r.column: tuple(r)[2:] for r in schemas.drift(spark, {"t": "id int, n bigint, s struct<a: int, b: array<struct<c: string>>>, gone map<string, int>"}, str(tmp_path)).collect()}
    assert got == {"id": ("widened", "int", "bigint"), "n": ("narrowed", "bigint", "int"), "s.a": ("same", "int", "int"), "s.b[].c": ("incompatible", "string", "bigint"), "gone{}": ("removed", "int", None), "later": ("added", None, "string")}
    one = T.StructType.fromDDL("a int")
    assert [tuple(r) for r in schemas.differences(spark, {"x": (one, None), "y": (None, one), "z": (one, one)}).collect()] == [("x", "a", "removed", "int", None), ("y", "a", "added", None, "int")]


def test_schema_diff_tells_types_and_covers_all_tables(spark):
    import __spark_entry__ as e

    got = e.queries()["schema_diff"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["table_name", "column_name", "difference", "want", "have"]
    rows = {tuple(r) for r in got.collect()}
    assert {("labels", "toxic", "type", "int", "string"), ("embeddings", "embedding", "type", "array<float>", "array<double>"), ("documents", "lang", "missing", "string", None), ("events", "seq", "extra", None, "bigint")} <= rows
    # a table that is on one side only
    assert {r[:3] for r in rows if r[0] in ("area", "region")} == {("area", "r_regionkey", "extra"), ("area", "r_name", "extra"), ("region", "r_regionkey", "missing"), ("region", "r_name", "missing")}
    db = pytest.importorskip("duckdb").connect()
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    assert set(db.execute(e.oracle_sql()["schema_diff"]).fetchall()) == rows
