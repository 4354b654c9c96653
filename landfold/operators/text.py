"""Word counts and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(text: Column) -> Column:
    """Character pairs of each run of Chinese characters, and words of the rest: where no dictionary is at hand (see segments)."""
    runs = F.regexp_extract_all(text, F.lit(r"([一-鿿]+)"))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))))
    return F.concat(pairs, words(F.regexp_replace(text, r"[一-鿿]+", " ")))


def word_freq(df: DataFrame, tokens: Column, stop: DataFrame | None = None) -> DataFrame:
    """word, n. stop (word) is joined out; Spark broadcasts it if it is small."""
    counted = df.select(F.explode(tokens).alias("word")).where("trim(word) <> ''").groupBy("word").agg(F.count("*").alias("n"))
    return counted if stop is None else counted.join(stop.select("word"), "word", "left_anti")


def top_words(df: DataFrame, tokens: Column, seq: str, k: int = 20, stop: DataFrame | None = None) -> DataFrame:
    """The k most frequent words; of equal ones those that came first."""
    one = df.select(seq, F.posexplode(tokens).alias("pos", "word")).where("trim(word) <> ''")
    whole = dict(df.dtypes)[seq] in ("tinyint", "smallint", "int", "bigint")
    # as one number, first places are aggregated by hash; a struct would be sorted by
    first = F.col(seq).cast("decimal(20,0)") * F.lit(1 << 32) + F.col("pos") if whole else F.struct(seq, "pos")
    counted = one.groupBy("word").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    if stop is not None:
        counted = counted.join(stop.select("word"), "word", "left_anti")
    return counted.orderBy(F.desc("n"), "first").limit(k).select("word", "n")


def stop_words(spark, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def preview(df: DataFrame, seq: list[str], n: int, offset: int = 0) -> DataFrame:
    """n rows in order of seq, each with the number of all rows."""
    return df.orderBy(*seq).offset(offset).limit(n).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def log_tail(df: DataFrame, seq: str, n: int) -> DataFrame:
    """The last n rows in order of seq; all of them for n of 0 or less."""
    return (df.orderBy(F.desc(seq)).limit(n) if n > 0 else df).orderBy(seq)


def widths(df: DataFrame, low: int = 10, high: int = 50) -> DataFrame:
    """Column widths of a sheet: the longest value or name and 2, within bounds."""
    one = [F.least(F.greatest(F.greatest(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)), F.lit(len(c))) + 2, F.lit(low)), F.lit(high)).alias(c) for c in df.columns]
    return df.agg(*one)


def schema_diff(want: DataFrame, have: DataFrame) -> DataFrame:
    """Of two (table_name, column_name, type): what is missing, extra or of another type."""
    a, b = want.alias("a"), have.alias("b")
    both = a.join(b, [F.col("a.table_name") == F.col("b.table_name"), F.col("a.column_name") == F.col("b.column_name")], "full_outer")
    kind = F.when(F.col("b.type").isNull(), "missing").when(F.col("a.type").isNull(), "extra").otherwise("type")
    return both.where(~F.col("a.type").eqNullSafe(F.col("b.type"))).select(F.coalesce("a.table_name", "b.table_name").alias("table_name"), F.coalesce("a.column_name", "b.column_name").alias("column_name"), kind.alias("difference"), F.col("a.type").alias("want"), F.col("b.type").alias("have"))
