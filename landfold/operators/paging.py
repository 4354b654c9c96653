"""Landed pages, read as a paging loop would have read them: which pages count, and how many of their items.

A loop asks for one page after the other until a page says that it is the last, or the cap is reached. Here all pages are
landed, and a rule says declaratively where each stream's loop ends. `replay(pages, rule, ...)` takes
(stream string, page int, items array<...>, replies int, more boolean, cursor string, total bigint): the stream is a
post, creator or keyword, page counts from 1, replies is how many replies were read beside the page's items, and more,
cursor and total are what the page says about others (null where it doesn't).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Paging:
    #: Over the page's columns, with n (its items) and before (the last cursor): whether the loop goes on after this page.
    goes_on: str
    #: Whether the page is used; one that isn't ends the loop.
    used: str = "true"
    #: What the cap counts: items (the last page is cut), replies (the same, and replies count), page (each page is cut on its own), pages (whole pages of `size`), none.
    cap: str = "items"
    size: int = 0
    #: Pages in advance of the first item: with cap "pages", page p is asked for while p * size fits in the cap, or (p - 1) * size stays below it.
    fits: bool = True
    #: Zero as a cap is none.
    zero_is_all: bool = False
    #: The first page's number: 0 where a stream begins with items that came beside their parent, which count as a page.
    first: int = 1

    def caps(self, most: int) -> bool:
        return self.cap in ("items", "replies") and not (self.zero_is_all and most == 0)


HAS_MORE = "coalesce(more, false)"
RULES: dict[tuple[str, str], Paging] = {
    ("xhs", "comments"): Paging(HAS_MORE, "items is not null", "replies"),
    ("xhs", "replies"): Paging(HAS_MORE, "page = 0 or items is not null", "none", first=0),
    ("xhs", "creator"): Paging(HAS_MORE, "items is not null"),
    ("xhs", "search"): Paging("true", HAS_MORE, "pages", 20),
    ("bili", "comments"): Paging(HAS_MORE, "cursor is not null"),
    ("bili", "comments with replies"): Paging(HAS_MORE, "cursor is not null", "page"),
    ("bili", "replies"): Paging("total > page * 10", cap="none"),
    ("bili", "contacts"): Paging("n > 0"),
    ("bili", "dynamics"): Paging(HAS_MORE),
    ("bili", "search"): Paging("n > 0", "n > 0", "pages", 20),
    ("bili", "creator"): Paging("total > page * 30", cap="none"),
    ("dy", "comments"): Paging(HAS_MORE),
    ("dy", "comments with replies"): Paging(HAS_MORE, cap="replies"),
    ("dy", "replies"): Paging(HAS_MORE, cap="none"),
    ("dy", "creator"): Paging(HAS_MORE, cap="none"),
    ("dy", "search"): Paging("n > 0", "n > 0", "pages", 10),
    ("ks", "comments"): Paging("coalesce(cursor, 'no_more') <> 'no_more'", cap="replies"),
    ("ks", "replies"): Paging("coalesce(cursor, 'no_more') <> 'no_more'", cap="none"),
    ("ks", "creator"): Paging("coalesce(cursor, 'no_more') <> 'no_more'", cap="none"),
    ("ks", "search"): Paging("true", "n > 0", "pages", 20),
    ("wb", "comments"): Paging("coalesce(cursor, '') <> '0'", cap="replies"),
    ("wb", "creator"): Paging("coalesce(total, 0) > page * 10", "items is not null", "none"),
    ("wb", "search"): Paging("true", "n > 0", "pages", 10),
    ("tieba", "comments"): Paging("page < total", "n > 0 and page <= total"),
    ("tieba", "replies"): Paging("page < total div 10 + 1", "n > 0", "none"),
    ("tieba", "creator"): Paging(HAS_MORE, cap="pages", size=20, fits=False, zero_is_all=True),
    ("tieba", "creator by url"): Paging(HAS_MORE, "n > 0", zero_is_all=True),
    ("tieba", "search"): Paging("n > 0", "n > 0", "pages", 10),
    ("tieba", "forum"): Paging("n > 0", "n > 0", "pages", 30, fits=False),
    ("zhihu", "comments"): Paging(HAS_MORE, "n > 0 and coalesce(cursor, '') <> before", "none"),
    ("zhihu", "replies"): Paging(HAS_MORE, "n > 0 and coalesce(cursor, '') <> before", "none"),
    ("zhihu", "creator"): Paging(HAS_MORE, cap="none"),
    ("zhihu", "search"): Paging("n > 0", "n > 0", "pages", 20),
}


def raised(most: int, rule: Paging) -> int:
    """The cap that holds: whole pages are never fewer than one."""
    return max(most, rule.size) if rule.cap == "pages" and rule.fits else most


def replay(pages: DataFrame, rule: Paging, most: int = 0, start: int | None = None) -> DataFrame:
    """stream, page, pos (from 0 in its page), item: what a loop with this rule and cap keeps, from page `start` on.

    One window over a stream's pages; items are exploded last. A repeated page counts as one more.
    """
    start = rule.first if start is None else start
    line = W.partitionBy("stream").orderBy("page")
    earlier = line.rowsBetween(W.unboundedPreceding, -1)
    seen = pages.where(F.col("page") >= start).withColumns({"n": F.coalesce(F.size("items"), F.lit(0)), "before": F.coalesce(F.lag("cursor").over(line), F.lit(""))})
    seen = seen.withColumns({"__used": F.coalesce(F.expr(rule.used), F.lit(False)), "__on": F.coalesce(F.expr(rule.goes_on), F.lit(False))})
    reached = F.coalesce(F.min((F.col("__used") & F.col("__on")).cast("int")).over(earlier), F.lit(1)) == 1
    take = F.col("n")
    if rule.caps(most):
        counted = F.col("n") + (F.coalesce("replies", F.lit(0)) if rule.cap == "replies" else 0)
        take = F.least("n", F.lit(most) - F.coalesce(F.sum(counted).over(earlier), F.lit(0)))
    elif rule.cap == "page":
        take = F.least("n", F.lit(most))
    elif rule.cap == "pages" and not (rule.zero_is_all and most == 0):
        at = F.col("page") - start + 1
        fits = at * rule.size <= raised(most, rule) if rule.fits else (at - 1) * rule.size < most
        reached = reached & fits
    kept = seen.withColumns({"__reached": reached, "__take": take}).where("__reached and __used and __take > 0")
    return kept.select("stream", "page", F.posexplode(F.expr("slice(items, 1, cast(__take as int))")).alias("pos", "item"))


def page_window(start: int, size: int, most: int) -> tuple[int, int]:
    """Offset and number of rows that a run from page `start` with a cap covers: whole pages only, one at least."""
    return (start - 1) * size, max(most, size) // size * size
