"""Joins of the data path: outer where a miss is kept, inner where it isn't. Spark broadcasts a side that is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_author(rows: DataFrame, authors: DataFrame, key: str, seq: list[str] | None = None) -> DataFrame:
    """rows with their author's columns, null for a miss. Where ids repeat, the last by seq counts (without seq, ids must be unique)."""
    if seq:
        rest = [c for c in authors.columns if c != key]
        authors = authors.groupBy(key).agg(*(F.max_by(c, F.struct(*seq)).alias(c) for c in rest))
    return rows.join(authors, key, "left")


def with_keyed_author(videos: DataFrame, users: DataFrame, author: str = "author") -> DataFrame:
    """Videos whose author is a key (a string, not an object in JSON) get the user's JSON in its place; null for a miss.

    videos has a column `author` of JSON text; users are (key, user), user being JSON text.
    """
    is_key = F.col(author).startswith('"')
    named = videos.withColumn("__key", F.when(is_key, F.from_json(F.concat(F.lit('{"k":'), F.col(author), F.lit("}")), "k string")["k"]))
    joined = named.join(users.select(F.col("key").alias("__key"), F.col("user").alias("__user")), "__key", "left")
    return joined.withColumn(author, F.when(is_key, F.col("__user")).otherwise(F.col(author))).drop("__key", "__user")


def with_full_text(short: DataFrame, full: DataFrame, key: str, column: str, is_long: Column) -> DataFrame:
    """short with the full text where a row says that its own was cut and there is one. Only those rows are joined."""
    whole = full.select(F.col(key), F.col(column).alias("__full"))
    flagged = short.withColumn("__long", F.coalesce(is_long, F.lit(False)))
    joined = flagged.where("__long").join(whole, key, "left").withColumn(column, F.coalesce("__full", column))
    return joined.select(*short.columns).unionByName(flagged.where("not __long").select(*short.columns))


def with_details(hits: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Search hits with their detail; hits without one are dropped."""
    return hits.join(details, key, "inner")


def inherit(rows: DataFrame, parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows of a parent, with columns that they take over from it."""
    return rows.drop(*columns).join(parents.select(key, *columns), key, "inner")


def to_parent(rows: DataFrame, within: list[str], own: str, parent: Column, columns: list[str]) -> DataFrame:
    """Each row with columns of the row whose `own` is its `parent`, as parent_<column>; null at the top."""
    above = rows.select(*within, F.col(own).alias("__own"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    return rows.withColumn("__own", parent).join(above, [*within, "__own"], "left").drop("__own")


def missing(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """rows whose key no other has."""
    return rows.join(others.select(key), key, "left_anti")


def zipped(df: DataFrame, left: str, right: str) -> DataFrame:
    """A row for each place of two parallel arrays (as far as the shorter one goes), in columns of their names."""
    other = [c for c in df.columns if c not in (left, right)]
    n = F.least(F.size(left), F.size(right))
    pairs = F.arrays_zip(F.slice(left, F.lit(1), n).alias(left), F.slice(right, F.lit(1), n).alias(right))
    return df.where(n >= 0).select(*other, F.inline(pairs).alias(left, right))
