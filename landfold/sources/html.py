"""Rows out of raw forum pages. A small tree on top of the standard parser, run in pandas UDFs that return arrays of structs."""

from __future__ import annotations

import html
import json
import re
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SITE = "https://tieba.baidu.com"
#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    def __init__(self, tag: str = "", attrs=(), parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.parts = tag, dict(attrs), parent, []

    def has(self, *classes: str) -> bool:
        own = (self.attrs.get("class") or "").split()
        return all(c in own for c in classes)

    def get(self, name: str) -> str:
        return (self.attrs.get(name) or "").strip()

    def walk(self):
        for p in self.parts:
            if isinstance(p, Node):
                yield p
                yield from p.walk()

    def all(self, tag: str = "", *classes: str) -> list[Node]:
        return [n for n in self.walk() if (not tag or n.tag == tag) and n.has(*classes)]

    def one(self, tag: str = "", *classes: str) -> Node:
        return next(iter(self.all(tag, *classes)), Node())

    def link(self, part: str) -> Node:
        return next((n for n in self.all("a") if part in n.get("href")), Node())

    def raw(self) -> str:
        return "".join(p if isinstance(p, str) else p.raw() for p in self.parts)

    def apart(self) -> str:
        """The texts of all elements, a space between each two."""
        return " ".join(p if isinstance(p, str) else p.apart() for p in self.parts)

    def text(self) -> str:
        return re.sub(r"\s+", " ", self.raw()).strip()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.parts.append(Node(tag, attrs, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:  # an end without a start is passed over
            self.at = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(page: str | None) -> Node:
    t = _Tree()
    t.feed(page or "")
    t.close()
    return t.root


def data_field(node: Node) -> dict:
    """The JSON of a data-field attribute; {} if it is none."""
    try:
        got = json.loads(html.unescape(node.get("data-field") or "{}"))
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def _url(href: str) -> str:
    return urljoin(SITE, href) if href else ""


def _found(pattern: str, text: str, default: str = "") -> str:
    m = re.search(pattern, text)
    return m[1] if m else default


def search_rows(page: str | None) -> list[dict]:
    """Search results: the list layout, else the card layout. Ids seen before are passed over."""
    root, out, seen = tree(page), [], set()

    def add(note_id: str, **row: str) -> None:
        if note_id and note_id not in seen:
            seen.add(note_id)
            out.append({"note_id": note_id, **row})

    for post in root.all("div", "s_post"):
        title, user, forum = next((a for a in post.all("a") if a.get("data-tid")), Node()), post.link("/home/main"), post.one("a", "p_forum")
        add(title.get("data-tid"), title=title.text(), desc=post.one("div", "p_content").text(), note_url=_url(title.get("href")), publish_time=post.one("", "p_date").text(), user_link=_url(user.get("href")), user_nickname=user.text(), tieba_name=forum.text(), tieba_link=_url(forum.get("href")))
    if not out:
        for post in root.all("", "threadcardclass"):
            title, user, forum = post.link("/p/"), post.link("/home/main"), post.link("/f?")
            add(_found(r"/p/(\d+)", title.get("href")), title=title.text(), desc=post.one("", "abstract-wrap").text(), note_url=_url(title.get("href")), publish_time=_found(r"发布于\s*(\S+)", post.text()), user_link=_url(user.get("href")), user_nickname=user.text(), tieba_name=forum.text(), tieba_link=_url(forum.get("href")))
    return out


def thread_rows(page: str | None) -> list[dict]:
    """Threads of a forum page."""
    out = []
    for li in tree(page).all("li", "j_thread_list"):
        f, user = data_field(li), li.one("a", "frs-author-name")
        if f.get("id"):
            out.append({"note_id": str(f["id"]), "title": li.one("a", "j_th_tit").text(), "desc": li.one("div", "threadlist_abs").text(), "note_url": f"{SITE}/p/{f['id']}", "publish_time": "", "user_link": _url(user.get("href")), "user_nickname": f.get("author_nickname") or f.get("author_name") or "", "tieba_name": "", "tieba_link": ""})
    return out


def comment_rows(page: str | None) -> list[dict]:
    """First-level comments of a thread page."""
    out = []
    for div in tree(page).all("div", "l_post", "j_l_post"):
        f = data_field(div)
        content, author = f.get("content") or {}, f.get("author") or {}
        user, tail = div.one("a", "p_author_name"), div.one("div", "post-tail-wrap").apart()
        comment_id = str(content.get("post_id") or div.get("data-pid"))
        if comment_id:
            out.append({"comment_id": comment_id, "content": re.sub(r"\s+", " ", re.sub("<[^>]+>", "", content.get("content") or "")).strip() or div.one("div", "d_post_content").text(), "user_link": _url(user.get("href")), "user_nickname": author.get("user_nickname") or author.get("user_name") or user.text(), "user_avatar": div.one("img").get("src") or author.get("portrait") or "", "ip_location": _found(r"IP属地:(\S+)", tail), "publish_time": _found(r"(\d{4}-\d\d-\d\d \d\d:\d\d)", tail), "sub_comment_count": int(content.get("comment_num") or 0), "parent_comment_id": ""})
    return out


def reply_rows(page: str | None) -> list[dict]:
    """Replies to a comment."""
    out = []
    for li in tree(page).all("li", "lzl_single_post", "j_lzl_s_p"):
        f = data_field(li)
        if not f.get("spid"):
            continue
        user = next((a for a in li.all("a") if a.has("j_user_card")), Node())
        out.append({"comment_id": str(f["spid"]), "content": li.one("span", "lzl_content_main").text(), "user_link": _url(user.get("href")), "user_nickname": str(f.get("showname") or ""), "user_avatar": user.one("img").get("src"), "ip_location": "", "publish_time": li.one("span", "lzl_time").text(), "sub_comment_count": 0, "parent_comment_id": str(f.get("pid") or "")})
    return out


def creator_row(page: str | None) -> list[dict]:
    """The owner of a profile page; no row without a link to the profile."""
    root = tree(page)
    link = next((a for p in root.all("p", "space") for a in p.all("a")), Node())
    if not link.get("href"):
        return []
    query = {k: v[0] for k, v in parse_qs(urlparse(link.get("href")).query).items()}
    counts = [int(_found(r"(\d+)", n.text(), "0")) for n in root.all("span", "concern_num")][:2] + [0, 0]
    data = root.one("div", "userinfo_userdata")
    sex = "Male" if data.all("", "userinfo_sex_male") else "Female" if data.all("", "userinfo_sex_female") else "Unknown"
    return [{"user_id": query.get("id", ""), "user_name": query.get("un", ""), "nickname": root.one("span", "userinfo_username").text(), "avatar": root.one("div", "userinfo_left_head").one("img").get("src"), "gender": sex, "ip_location": _found(r"IP属地:(\S+)", data.text()), "follows": str(counts[0]), "fans": str(counts[1]), "registration_duration": _found(r"吧龄:(\S+)", data.text())}]


def note_row(page: str | None) -> list[dict]:
    """The first floor of a thread page and what the page says of the thread."""
    root = tree(page)
    floor = root.one("div", "l_post", "j_l_post")
    f, tail = data_field(floor).get("author") or {}, floor.one("div", "post-tail-wrap").apart()
    only = next((n.get("href") for n in root.walk() if n.get("id") == "lzonly_cntn"), "")
    note_id = only.split("?")[0].split("/")[-1] or _found(r'"thread_id"\s*:\s*"?(\d+)"?', page or "")
    theme = next((n for n in root.all("div") if n.get("id") == "thread_theme_5"), Node())
    counts = [n.text() for li in theme.all("li", "l_reply_num") for n in li.all("span", "red")][:2] + ["0", "0"]
    forum = next((a for a in root.all("a") if a.has("card_title_fname")), root.link("/f?kw="))
    name = forum.text()
    name = name if not name or name.endswith("吧") else name + "吧"
    title = re.sub("_百度贴吧$|-百度贴吧$", "", root.one("title").text())
    face, user = floor.one("a", "p_author_face"), floor.one("a", "p_author_name")
    link = next((a.get("href") for a in floor.all("a") if a.has("p_author_face") or a.has("p_author_name")), "")
    desc = next((n.get("content") for n in root.all("meta") if n.get("name") == "description"), "")
    return [{"note_id": note_id, "title": title.replace(f"【{name}】", "").strip(), "desc": desc, "note_url": f"{SITE}/p/{note_id}", "publish_time": _found(r"(\d{4}-\d\d-\d\d \d\d:\d\d)", tail), "user_link": _url(link), "user_nickname": user.text() or f.get("user_nickname") or f.get("user_name") or "", "user_avatar": face.one("img").get("src"), "tieba_name": name, "tieba_link": _url(forum.get("href")), "ip_location": _found(r"IP属地:(\S+)", tail), "total_replay_num": int(_found(r"(\d+)", counts[0], "0")), "total_replay_page": int(_found(r"(\d+)", counts[1], "0"))}]


def creator_threads(page: str | None) -> list[dict]:
    """Ids of the threads that a profile page lists."""
    lists = [u for u in tree(page).all("ul", "new_list", "clearfix")]
    links = [d.all("a")[0].get("href") for u in lists for d in u.all("div", "thread_name") if d.all("a")]
    return [{"thread_id": x.split("?")[0].split("/")[-1]} for x in links]


NOTE = "note_id string, title string, desc string, note_url string, publish_time string, user_link string, user_nickname string, tieba_name string, tieba_link string"
COMMENT = "comment_id string, content string, user_link string, user_nickname string, user_avatar string, ip_location string, publish_time string, sub_comment_count int, parent_comment_id string"
CREATOR = "user_id string, user_name string, nickname string, avatar string, gender string, ip_location string, follows string, fans string, registration_duration string"
DETAIL = f"{NOTE}, user_avatar string, ip_location string, total_replay_num int, total_replay_page int"
KINDS = {"note": (note_row, DETAIL), "creator_threads": (creator_threads, "thread_id string"), "search": (search_rows, NOTE), "threads": (thread_rows, NOTE), "comments": (comment_rows, COMMENT), "replies": (reply_rows, COMMENT), "creator": (creator_row, CREATOR)}


def extract(df: DataFrame, kind: str, column: str = "html") -> DataFrame:
    """The other columns of df with a row for each that its pages hold."""
    rows, ddl = KINDS[kind]
    ddl = ", ".join(x.replace(" ", ": ", 1) for x in ddl.split(", "))

    @F.pandas_udf(f"array<struct<{ddl}>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(rows)

    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.explode(run(column)).alias("__r")).select(*keep, "__r.*")
