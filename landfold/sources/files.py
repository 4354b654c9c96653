"""Landed files as DataFrames: explicit schemas, bad records kept apart, nothing fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import workbook

#: Platform codes and the folder names that writers use.
PLATFORMS = {"xhs": "xhs", "dy": "douyin", "ks": "kuaishou", "bili": "bilibili", "wb": "weibo", "tieba": "tieba", "zhihu": "zhihu"}
EXTENSIONS = ("json", "jsonl", "csv", "xlsx", "xls")


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def json_array(spark: SparkSession, path: str, schema, rejects: bool = False) -> DataFrame:
    """Files that hold one array (or one object) each. rejects: a corrupt file is a row with _corrupt_record; else it gives none."""
    known = _struct(schema)
    raw = spark.read.text(path, wholetext=True).select("value", F.from_json("value", T.ArrayType(known)).alias("r"))
    if not rejects:
        return raw.select(F.explode("r").alias("r")).where("r is not null").select("r.*")
    return raw.select(F.explode_outer("r").alias("r"), F.when(F.col("r").isNull(), F.col("value")).alias("_corrupt_record")).select("r.*", "_corrupt_record")


def json_lines(spark: SparkSession, path: str, schema, rejects: bool = False) -> DataFrame:
    """An object per line; blank lines don't count. rejects: a corrupt line is a row with _corrupt_record; else it gives none."""
    known = T.StructType([*_struct(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.select(F.from_json("value", known, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return rows if rejects else rows.where("_corrupt_record is null").drop("_corrupt_record")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, all strings, quoted newlines, a byte order mark or none."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.removeprefix("﻿") for c in df.columns))


def xlsx(spark: SparkSession, path: str, sheet: int | str = 0, limit: int | None = None) -> DataFrame:
    """A workbook's sheet as text columns; the first rows of it with a limit."""
    return workbook.scan(spark, path, sheet, limit)


def catalogue(spark: SparkSession, root: str, platform: str | None = None, kind: str | None = None) -> DataFrame:
    """Data files below root, newest first: path, name, type, size, modified, platform. Contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    named = f.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("type", F.lower(F.element_at(F.split("path", r"\."), -1))).where(F.col("type").isin(*EXTENSIONS))
    if platform:
        named = named.where(F.lower("path").contains(platform.lower()))
    if kind:
        named = named.where(F.col("type") == kind.lower())
    return named.withColumn("platform", path_platform(F.col("path"))).orderBy(F.desc("modified"))


def path_platform(path: Column) -> Column:
    """The first platform whose folder name is in the path; null if none is."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, folder in PLATFORMS.items():
        out = out.when(F.lower(path).contains(f"/{folder}/") | F.lower(path).contains(f"/{code}/"), code)
    return out


def file_stats(files: DataFrame) -> DataFrame:
    """Of a catalogue: files and bytes by type, by platform, and in all, in one pass."""
    return files.where("path is not null").groupingSets([["type"], ["platform"], []], "type", "platform").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def row_counts(spark: SparkSession, path: str, kind: str) -> int:
    """Rows of a data file: records, not physical lines."""
    if kind == "csv":
        return csv(spark, path).count()
    if kind == "json":
        return json_array(spark, path, "x string").count()
    return spark.read.text(path).where("trim(value) <> ''").count()


def next_file_number(files: DataFrame) -> int:
    """Of a catalogue: one more than the largest number that a name begins with (before its first _). 1 for no files, or if a name begins with none."""
    number = F.split("name", "_")[0].try_cast("int")
    top, odd = files.agg(F.max(number), F.count(F.when(number.isNull(), 1))).first()
    return 1 if top is None or odd else top + 1


def keywords(spark: SparkSession, listed: str) -> DataFrame:
    """Comma-separated keywords, not trimmed."""
    return spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("seq", "keyword"))


def id_list(listed: Column) -> Column:
    """Comma-separated ids: trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x != "")


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def script_json(html: Column, script_id: str = "js-initialData") -> Column:
    """The JSON of <script id=...>; null if there is none."""
    return F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*\bid="{script_id}"[^>]*>(.*?)</script>', 1), F.lit(""))


def first_entity(json: Column, path: str, schema: str) -> Column:
    """The first value of a JSON map at a path, as a struct."""
    return F.get(F.map_values(F.from_json(F.get_json_object(json, path), f"map<string, {schema}>")), F.lit(0))


def initial_state(html: Column, marker: str = "noteDetailMap", undefined: str = '""') -> Column:
    """The JSON assigned to window.__INITIAL_STATE__, undefined replaced; null without the marker."""
    raw = F.regexp_extract(html, r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\})\s*</script>", 1)
    return F.when(html.contains(marker) & (raw != ""), F.regexp_replace(raw, r":\s*undefined", f":{undefined}"))


def render_data(html: Column, schema: str) -> Column:
    """status of the first element of $render_data."""
    raw = F.regexp_extract(html, r"(?s)\$render_data = (\[.*?\])\[0\]", 1)
    return F.get(F.from_json(F.nullif(raw, F.lit("")), f"array<struct<status: {schema}>>"), F.lit(0))["status"]
