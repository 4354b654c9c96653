"""Payloads as VARIANT, in which an absent key and a null one differ: dictionary lookups with defaults, as columns.

A path is keys joined by dots, with [n] for places in arrays. Along it, a part that is absent, null or no object makes the
whole path absent, so that a lookup in a lookup with {} as default needs nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import Policy


def parsed(raw: Column) -> Column:
    """JSON text as VARIANT; null where it is no JSON. Of equal keys the last one holds (see session.SETTINGS)."""
    return F.try_parse_json(raw)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", "variant")


def has(v: Column, path: str) -> Column:
    """Whether the key is there, null or not."""
    return _at(v, path).isNotNull()


def null_at(v: Column, path: str) -> Column:
    """Whether the key is there and null."""
    return F.coalesce(F.is_variant_null(_at(v, path)), F.lit(False))


def get(v: Column, path: str, kind: str, default: Column | None = None) -> Column:
    """The value, of a type; the default only where the key is absent. A null value, or one that isn't of the type, is null."""
    value = F.try_variant_get(v, f"$.{path}", kind)
    return value if default is None else F.when(has(v, path), value).otherwise(default.cast(kind))


def said(v: Column, path: str, default: str | None = None) -> Column:
    """The value as text, as a program that formats whatever it got writes it: None, True, False, 1.0; objects and arrays
    as JSON. Without a default an absent key gives None too."""
    here = _at(v, path)
    kind, plain = F.schema_of_variant(here), F.try_variant_get(v, f"$.{path}", "string")
    number = F.when(kind.startswith("DECIMAL") & ~plain.contains("."), F.concat(plain, F.lit(".0"))).otherwise(plain)
    value = F.when(null_at(v, path), "None").when(kind == "BOOLEAN", F.initcap(plain)).otherwise(number)
    return F.when(has(v, path), value).otherwise(F.lit("None" if default is None else default))


def truthy(v: Column, path: str) -> Column:
    """Whether the value counts as true: there, and neither null, false, 0, '', [] nor {}."""
    kind, plain = F.schema_of_variant(_at(v, path)), F.try_variant_get(v, f"$.{path}", "string")
    number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    false = null_at(v, path) | plain.isin("", "[]", "{}") & ~number | (kind == "BOOLEAN") & (plain == "false")
    return has(v, path) & ~F.coalesce(false, F.lit(False)) & ~F.coalesce(number & (F.try_variant_get(v, f"$.{path}", "double") == 0), F.lit(False))


def first_truthy(v: Column, paths: list[str], kind: str, default: Column | None = None) -> Column:
    """The first value that counts as true; else the default."""
    out = F.lit(None).cast(kind) if default is None else default.cast(kind)
    for path in reversed(paths):
        out = F.when(truthy(v, path), F.try_variant_get(v, f"$.{path}", kind)).otherwise(out)
    return out


#: Beside a column taken from a payload: whether its key was there.
GIVEN = "__given_"


def present(df: DataFrame, raw: str, columns: dict[str, tuple[str, str]], first: tuple[str, ...] = ("add_ts",)) -> tuple[DataFrame, Policy]:
    """Columns (name to path and type) of the payloads in column `raw`, and the policy under which an upsert of them takes the
    keys that are there, null or not, and leaves the others as they are."""
    rows = df.withColumn("__payload", parsed(F.col(raw)))
    v = F.col("__payload")
    taken = {c: get(v, path, kind) for c, (path, kind) in columns.items()}
    flags = {GIVEN + c: has(v, path) for c, (path, _) in columns.items()}
    return rows.withColumns(taken | flags).drop("__payload", raw), Policy(first=first, skip_null=True, given=tuple((c, GIVEN + c) for c in columns))
