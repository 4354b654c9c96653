"""One writer for every entity and format. Files are partitioned by platform, crawler type, item type and day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workbook

LAYOUT = ["platform", "crawler_type", "item_type", "crawl_date"]


def laid_out(df: DataFrame, platform: str, crawler_type: str, item_type: str, day: str) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in zip(LAYOUT, (platform, crawler_type, item_type, day), strict=True)})


def _flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON, for formats that can't hold them."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))


def write_csv(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "append") -> None:
    _flat(df).write.mode(mode).partitionBy(*partition_by).option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*partition_by).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """An export as arrays: a JSON array per part file, put together task by task and never in one place."""

    def arrays(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(["["], pa.string())], ["value"])
        first = True
        for b in batches:
            rows = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r if first and i == 0 else "," + r for i, r in enumerate(rows)], pa.string())], ["value"])
            first = first and not rows
        yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], ["value"])

    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(arrays, "value string").write.mode(mode).text(path)


def write_counts(counted: DataFrame, path: str, most: int = 100_000, mode: str = "overwrite") -> None:
    """Words with their counts (word, n) as one JSON object, the most frequent first. Bounded: more than `most` words are refused."""
    n = counted.count()
    if n > most:
        raise ValueError(f"{n} words; one object takes {most}")
    listed = counted.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "word", "n"))).alias("x"))
    one = listed.select(F.to_json(F.map_from_entries(F.transform("x", lambda e: F.struct(e["word"], e["n"])))).alias("value"))
    one.coalesce(1).write.mode(mode).text(path)


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    _flat(df).write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def write_workbook(sheets: dict[str, DataFrame], path: str, most_rows: int = 100_000) -> None:
    """One workbook with a sheet per frame that has rows, nulls as empty cells, columns as wide as their longest value within
    bounds. Bounded: a frame beyond most_rows is refused, not cut. For more rows see workbook.books."""
    made, spark = {}, None
    for name, df in sheets.items():
        spark = df.sparkSession
        rows = _flat(df).limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows, which a workbook takes")
        if rows:
            made[name] = df.columns, [tuple(r) for r in rows]
    if spark is None or not made:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(workbook.made(made))
    out.close()


def write_media(df: DataFrame, root: str, put: Callable[[str, bytes], None] | None = None) -> None:
    """Rows (item_type, id, name, content) as files {root}/{item_type}/{id}/{name}. Paths follow from the keys, so a
    repeated task overwrites its own files. put writes one (a shared file system by default)."""

    def write(rows) -> None:
        import os

        for r in rows:
            path = f"{root}/{r['item_type']}/{r['id']}/{os.path.basename(r['name'])}"
            if put:
                put(path, bytes(r["content"]))
            else:
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(r["content"])

    df.select("item_type", "id", "name", "content").foreachPartition(write)


SINKS = {"csv": write_csv, "json": write_json_array, "jsonl": write_jsonl, "parquet": write_parquet, "excel": write_workbook, "db": write_jdbc, "sqlite": write_jdbc, "mysql": write_jdbc, "postgres": write_jdbc}


def sink(option: str) -> Callable:
    if option not in SINKS:
        raise ValueError(f"unknown sink {option!r}; known: {', '.join(SINKS)}")
    return SINKS[option]
