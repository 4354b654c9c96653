"""Differences between schemas: of tables as their files have them, of versions of a store, of declared ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Types from narrow to wide, each of which holds all values of those before it.
WIDER = (("tinyint", "smallint", "int", "bigint"), ("float", "double"), ("tinyint", "smallint", "int", "double"), ("date", "timestamp"))
ROW = "table string, column string, difference string, before string, after string"


def change(before: str | None, after: str | None) -> str:
    """same, added, removed, widened, narrowed or incompatible."""
    if before == after:
        return "same"
    if before is None or after is None:
        return "added" if before is None else "removed"
    for line in WIDER:
        if before in line and after in line:
            return "widened" if line.index(before) < line.index(after) else "narrowed"
    if before.startswith("decimal(") and after.startswith("decimal("):
        (p, s), (q, t) = (tuple(map(int, x[8:-1].split(","))) for x in (before, after))
        return "widened" if q - t >= p - s and t >= s else "narrowed" if q - t <= p - s and t <= s else "incompatible"
    return "incompatible"


def fields(schema: T.StructType, prefix: str = "") -> dict[str, str]:
    """Columns with their types, nested ones by dotted names ([] for an array's elements, {} for a map's values)."""
    out = {}

    def add(name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            out.update(fields(kind, name + "."))
        elif isinstance(kind, T.ArrayType):
            add(name + "[]", kind.elementType)
        elif isinstance(kind, T.MapType):
            add(name + "{}", kind.valueType)
        else:
            out[name] = kind.simpleString()

    for f in schema:
        add(prefix + f.name, f.dataType)
    return out


def differences(spark: SparkSession, tables: dict[str, tuple[T.StructType | None, T.StructType | None]], same: bool = False) -> DataFrame:
    """ROW of each table's schema before and after (None: there is no such table)."""
    rows = []
    for name, (before, after) in tables.items():
        a, b = (fields(s) if s else {} for s in (before, after))
        rows += [(name, c, change(a.get(c), b.get(c)), a.get(c), b.get(c)) for c in {**a, **b}]
    return spark.createDataFrame([r for r in rows if same or r[2] != "same"], ROW)


def of_files(spark: SparkSession, path: str) -> T.StructType:
    """The schema that all Parquet files below a path have together, from their footers."""
    return spark.read.option("mergeSchema", "true").parquet(path).schema


def drift(spark: SparkSession, declared: dict[str, str | T.StructType], base: str) -> DataFrame:
    """ROW of declared tables against the files {base}/{table}.parquet: what was added, removed or changed since."""
    want = {n: T.StructType.fromDDL(s) if isinstance(s, str) else s for n, s in declared.items()}
    return differences(spark, {n: (s, of_files(spark, f"{base}/{n}.parquet")) for n, s in want.items()}, same=True)
