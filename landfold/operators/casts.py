"""Casts that count what they can't read: rows, nulls and rejects of each column, beside the data or of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Texts that stand for a truth value, in any case.
TRUE, FALSE = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")


def read(c: str, kind: str) -> Column:
    """A text column as a type; null where it can't be read. Truth values are read by TRUE and FALSE."""
    x = F.col(f"`{c}`")
    if kind == "boolean":
        low = F.lower(x.cast("string"))
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    return x.try_cast(kind)


def rejected(c: str, kind: str) -> Column:
    return F.col(f"`{c}`").isNotNull() & read(c, kind).isNull()


def _counts(casts: dict[str, str]) -> list[Column]:
    each = [(F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}_nulls"), F.count_if(rejected(c, k)).alias(f"{c}_rejects")) for c, k in casts.items()]
    return [F.count(F.lit(1)).alias("rows"), *(x for pair in each for x in pair)]


def cast(df: DataFrame, casts: dict[str, str], default: dict[str, object] | None = None, observed: Observation | None = None) -> DataFrame:
    """df with columns of other types (column to type). What can't be read is null, or the column's default, as are nulls.

    observed: gets rows, `<column>_nulls` and `<column>_rejects` when the result is computed, in the same pass.
    """
    seen = df.observe(observed, *_counts(casts)) if observed else df
    fill = default or {}
    return seen.withColumns({c: F.coalesce(read(c, k), F.lit(fill[c]).cast(k)) if c in fill else read(c, k) for c, k in casts.items()})


def reject_counts(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """column, rows, nulls, rejects of each cast, in one pass."""
    one = df.agg(*_counts(casts))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"`{c}_nulls`").alias("nulls"), F.col(f"`{c}_rejects`").alias("rejects")) for c in casts))
    return one.select(F.inline(each))


def rejects(df: DataFrame, casts: dict[str, str], keep: list[str]) -> DataFrame:
    """The values that can't be read: the columns in `keep`, then column, value and the type that it should have been."""
    each = F.array(*(F.when(rejected(c, k), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"), F.lit(k).alias("type"))) for c, k in casts.items()))
    return df.select(*keep, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("r")).select(*keep, "r.*")
