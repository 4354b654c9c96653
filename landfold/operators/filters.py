"""Predicates of the data path, as local conditions: what a remote search was asked for is applied to landed rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 10_000
#: Names that runs are started with.
CHOICES = {
    "platform": ("xhs", "dy", "ks", "bili", "wb", "tieba", "zhihu"),
    "login_type": ("qrcode", "phone", "cookie"),
    "crawler_type": ("search", "detail", "creator"),
    "save_option": ("csv", "db", "json", "jsonl", "sqlite", "mongodb", "excel", "postgres"),
}
#: Orders of a search, by the columns that rows are sorted by, falling.
ORDERS = {"newest": ("publish_time",), "most_liked": ("liked_count",), "most_commented": ("comment_count",), "most_viewed": ("view_count",), "most_collected": ("collected_count",)}
#: Publish windows that a search offers, in days.
WINDOWS = {"day": 1, "week": 7, "half_year": 182}


def has_text(c: Column) -> Column:
    """Neither null nor '': the guard of ids and titles."""
    return F.coalesce(c, F.lit("")) != ""


def day_range(first: str, last: str) -> tuple[int, int]:
    """Epoch seconds of the first day's start and the last day's last second (UTC), both included."""
    a, b = (dt.datetime.strptime(x, "%Y-%m-%d").replace(tzinfo=dt.timezone.utc) for x in (first, last))
    if a > b:
        raise ValueError(f"{first} is after {last}")
    return int(a.timestamp()), int((b + dt.timedelta(days=1)).timestamp()) - 1


def published_between(epoch: Column, first: str, last: str) -> Column:
    """Within the days first to last, whole seconds compared."""
    low, high = day_range(first, last)
    return F.floor(epoch).between(low, high)


def search(df: DataFrame, keyword: str | None = None, fields: tuple[str, ...] = ("title", "desc"), kind: str | None = None, order: str | None = None, window: str | None = None, as_of: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows that hold the keyword in a field, of one type, published within a window before as_of (epoch seconds), in an
    order (falling, nulls last; ties by the given columns). Relevance as a remote server ranks it can't be reproduced."""
    for what, given, known in (("order", order, ORDERS), ("window", window, WINDOWS)):
        if given is not None and given not in known:
            raise ValueError(f"unknown {what} {given!r}; known: {', '.join(known)}")
    if keyword:
        held = F.lit(False)
        for f in fields:
            held = held | F.coalesce(F.contains(F.lower(F.col(f)), F.lit(keyword.lower())), F.lit(False))
        df = df.where(held)
    if kind is not None:
        df = df.where(F.col("type") == kind)
    if window is not None:
        if as_of is None:
            raise ValueError("a window needs as_of")
        df = df.where((F.col("publish_time") > as_of - 86_400 * WINDOWS[window]) & (F.col("publish_time") <= as_of))
    if order is not None:
        df = df.orderBy(*(F.col(c).desc_nulls_last() for c in ORDERS[order]), *ties)
    return df


def check_limit(n: int | None, name: str = "limit") -> int | None:
    """None, or 1 to MOST_ROWS."""
    if n is not None and not 1 <= n <= MOST_ROWS:
        raise ValueError(f"{name} is {n}; it must be from 1 to {MOST_ROWS}")
    return n


def check_choice(name: str, value: str) -> str:
    if value not in CHOICES[name]:
        raise ValueError(f"{name} is {value!r}; it must be one of {', '.join(CHOICES[name])}")
    return value
