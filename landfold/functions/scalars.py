"""Scalar functions of the data path: columns in, columns out, all in the JVM. `parity=True` keeps a known quirk."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _truthy(c: Column, kind: T.DataType | str) -> Column:
    name = kind if isinstance(kind, str) else kind.typeName()
    if name in ("array", "map"):
        return F.when(F.size(c) > 0, c)
    if name == "string":
        return F.when(c != "", c)
    if name == "boolean":
        return F.when(c, c)
    return F.when(c != 0, c)


def first_truthy(*columns: Column, kind: T.DataType | str = "string") -> Column:
    """The first column that is not null, '', 0, false or empty; null if all are."""
    return F.coalesce(*(_truthy(c, kind) for c in columns))


def count_text(c: Column, parity: bool = False) -> Column:
    """A count as text; parity writes a null as 'None'."""
    return F.coalesce(c.cast("string"), F.lit("None")) if parity else c.cast("string")


def quoted(c: Column) -> Column:
    """A string as a JSON string, quotes included."""
    return F.regexp_replace(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x"))), r'^\{"x":|\}$', "")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def html_text(c: Column) -> Column:
    """Text of an HTML fragment: script and style blocks and tags go, entities stay; null gives ''."""
    no_blocks = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<(script|style)[^>]*>.*?</\1>", "")
    return strip(F.regexp_replace(no_blocks, "<[^>]+>", ""))


def strip_tags(c: Column) -> Column:
    """Tags that end on their own line go."""
    return F.regexp_replace(c, "(?d)<.*?>", "")


def digit_run(c: Column) -> Column:
    """The first run of digits as a number; none gives 0. '1.2万' is 1: see parse_count."""
    return F.coalesce(F.regexp_extract(c, "[0-9]+", 0).try_cast("bigint"), F.lit(0))


def parse_count(c: Column) -> Column:
    """A shown count as a number: thousands separators, 万 (10^4) and 亿 (10^8); null if it is none."""
    number = F.regexp_replace(c, ",", "")
    value = F.regexp_extract(number, r"([0-9]+(?:\.[0-9]+)?)", 1)
    unit = F.regexp_extract(number, "[0-9.]+([万亿])", 1)
    scale = F.when(unit == "万", 10_000).when(unit == "亿", 100_000_000).otherwise(1)
    return F.when(value != "", (value.cast("decimal(20,6)") * scale).cast("bigint"))


def safe_int(c: Column) -> Column:
    """Null, '' and text that is no number give 0."""
    return F.coalesce(c.try_cast("bigint"), F.lit(0))


def parse_bool(c: Column) -> Column:
    """yes/true/t/y/1 and no/false/f/n/0; anything else is null."""
    low = F.lower(c)
    return F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False)


def epoch_seconds(c: Column) -> Column:
    """Seconds of an epoch given in seconds or milliseconds (above 10^12)."""
    return F.when(c > 1_000_000_000_000, F.floor(c / 1000)).otherwise(c).cast("bigint")


def epoch_text(c: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Date and time in the session's time zone."""
    return F.date_format(F.timestamp_seconds(epoch_seconds(c)), fmt)


def text_epoch(c: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds of a date and time; 0 if it can't be read."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(c, F.lit(fmt))), F.lit(0))


def instant_epoch(c: Column) -> Column:
    """Epoch of 'Sat Dec 23 17:12:54 +0800 2023' (the weekday is dropped: Spark 3 and later don't parse it)."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(c, r"^\w+ ", ""), F.lit("MMM d HH:mm:ss xx yyyy")))


def wallclock_epoch(c: Column) -> Column:
    """The same with the offset ignored: the clock time as if it were UTC (parity)."""
    return F.unix_timestamp(F.try_to_timestamp(F.concat(F.regexp_replace(F.regexp_replace(c, r"^\w+ ", ""), r" [+-]\d{4} ", " "), F.lit(" +0000")), F.lit("MMM d HH:mm:ss yyyy xx")))


#: What a run calls now, by name; as_of is passed in, so that a run can be repeated.
NOW = {"ms": None, "s": None, "datetime": "yyyy-MM-dd HH:mm:ss", "hour": "yyyy-MM-dd-HH", "date": "yyyy-MM-dd"}


def as_of_text(as_of: Column, kind: str = "datetime") -> Column:
    """A timestamp as epoch (ms, s: numbers) or text in the session's time zone."""
    if kind in ("ms", "s"):
        return F.unix_millis(as_of) if kind == "ms" else F.unix_seconds(as_of)
    return F.date_format(as_of, NOW[kind])


def china_datetime(c: Column) -> Column:
    """The instant at +08:00, as text with the offset."""
    return F.concat(F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.timestamp_seconds(instant_epoch(c)), F.current_timezone()), "+08:00"), "yyyy-MM-dd HH:mm:ss"), F.lit("+08:00"))


def url_params(c: Column) -> Column:
    """Query of a URL as a map: decoded, without blank values, the last of equal keys (mapKeyDedupPolicy LAST_WIN)."""
    pairs = F.filter(F.split(F.coalesce(F.try_parse_url(c, F.lit("QUERY")), F.lit("")), "&"), lambda p: p.rlike("^[^=]+=."))
    entry = lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)), F.url_decode(F.regexp_replace(p, "^[^=]*=", "")))
    return F.map_from_entries(F.transform(pairs, entry))


def kv_map(c: Column, between: str = ";", sign: str = "=") -> Column:
    """'a=1; b=2' as a map; parts without exactly one sign are skipped."""
    parts = F.filter(F.transform(F.split(c, between), lambda p: F.trim(p)), lambda p: F.size(F.split(p, sign)) == 2)
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.split(p, sign)[0], F.split(p, sign)[1])))


def last_segment(c: Column) -> Column:
    """The last part of a URL's path, without query and fragment."""
    return F.element_at(F.split(F.split(c, "[?#]")[0], "/"), -1)


#: What an id looks like on its own, and where it stands in a URL, by platform and kind.
ID_PATTERNS = {
    ("xhs", "note"): ("^[0-9a-f]{24}$", r"/(?:explore|discovery/item)/([0-9a-zA-Z]+)"),
    ("xhs", "creator"): ("^[0-9a-f]{24}$", r"/user/profile/([0-9a-zA-Z]+)"),
    ("bili", "video"): ("^BV[0-9A-Za-z]+$", r"/video/(BV[0-9A-Za-z]+)"),
    ("bili", "creator"): (r"^\d+$", r"space\.bilibili\.com/(\d+)"),
    ("dy", "video"): (r"^\d+$", r"(?:/video/|modal_id=)(\d+)"),
    ("dy", "creator"): ("^MS4wLjABAAAA", r"/user/([^/?]+)"),
    ("ks", "video"): ("^[0-9a-zA-Z_-]+$", r"/short-video/([0-9a-zA-Z_-]+)"),
    ("ks", "creator"): ("^[0-9a-zA-Z_-]+$", r"/profile/([0-9a-zA-Z_-]+)"),
    ("tieba", "note"): (r"^\d+$", r"/p/(\d+)"),
}


def url_id(c: Column, platform: str, kind: str, strict: bool = False) -> Column:
    """The id in a URL, or the id itself; null where there is none, or an error if strict."""
    raw, within = ID_PATTERNS[platform, kind]
    found = F.when(c.rlike(raw), c).otherwise(F.nullif(F.regexp_extract(c, within, 1), F.lit("")))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no id in "), F.coalesce(c, F.lit("null"))))) if strict else found


def url_join(base: Column, c: Column) -> Column:
    """A link found on a page as an absolute URL: whole ones as they are, then //host/path, /path, and names beside the base; '' stays."""
    site = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(base, "[?#].*$", "")
    beside = F.when(path == site, F.concat(site, F.lit("/"), c)).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), c))
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(c.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), c).when(c.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), c)).when(c.startswith("/"), F.concat(site, c)).otherwise(beside)


#: Hosts that serve images.
IMAGE_HOSTS = ("https://sns-img-qc.xhscdn.com", "https://sns-img-hw.xhscdn.com", "https://sns-img-bd.xhscdn.com", "https://sns-img-qn.xhscdn.com")


def trace_id(c: Column) -> Column:
    """The last part of an image URL, below spectrum/ if the URL has that."""
    last = F.element_at(F.split(c, "/"), -1)
    return F.when(c.contains("spectrum"), F.concat(F.lit("spectrum/"), last)).otherwise(last)


def image_urls(trace: Column, form: str = "png") -> Column:
    """Where an image may be had, one URL per host."""
    return F.array(*(F.concat(F.lit(f"{h}/"), trace, F.lit(f"?imageView2/format/{form}")) for h in IMAGE_HOSTS))


def js_string(c: Column) -> Column:
    """The inside of a JavaScript string literal, decoded; '' for null, '' and 'null'; what can't be decoded stays."""
    decoded = F.from_json(F.concat(F.lit('{"x":"'), c, F.lit('"}')), "x string", {"mode": "PERMISSIVE"})["x"]
    return F.when(F.coalesce(c, F.lit("")).isin("", "null"), "").otherwise(F.coalesce(decoded, c))


#: Fields of a forum page, by name, and what a page without one gives.
PAGE_FIELDS = {
    "ip_location": (r"IP属地:(\S+?)</span>", ""),
    "publish_time": (r'<span class="tail-info">(\d{4}-\d{2}-\d{2} \d{2}:\d{2})</span>', ""),
    "registration_duration": (r"<span>吧龄:(\S+?)</span>", ""),
    "concern": (r'<span class="concern_num">\(<a[^>]*>(\d+)</a>\)</span>', "0"),
}


def page_field(c: Column, name: str) -> Column:
    """A field of a page's HTML, the first there is."""
    pattern, none = PAGE_FIELDS[name]
    return F.coalesce(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), F.lit(none))


def follows_and_fans(c: Column) -> Column:
    """The first two concern numbers of a profile page, '0' where there is none."""
    found = F.regexp_extract_all(c, F.lit(PAGE_FIELDS["concern"][0]))
    return F.struct(*(F.coalesce(F.get(found, F.lit(i)), F.lit("0")).alias(n) for i, n in enumerate(("follows", "fans"))))


def page_gender(c: Column) -> Column:
    return F.when(c.contains("userinfo_sex_male"), "Male").when(c.contains("userinfo_sex_female"), "Female").otherwise("Unknown")


def snake_keys():
    """A pandas UDF: JSON text with all its keys, at any depth, from camelCase to snake_case; null where it is no JSON."""
    import json
    import re

    def snake(x):
        if isinstance(x, dict):
            return {re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", k).lower(): snake(v) for k, v in x.items()}
        return [snake(v) for v in x] if isinstance(x, list) else x

    def one(t):
        try:
            return None if t is None else json.dumps(snake(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run

def zhihu_kind(c: Column) -> Column:
    """Of a URL: answer, article or zvideo; '' for others."""
    return F.when(c.contains("/answer/"), "answer").when(c.contains("/p/"), "article").when(c.contains("/zvideo/"), "zvideo").otherwise("")


def url_quote(c: Column) -> Column:
    """Percent-encoded, with spaces as %20 and slashes kept."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def with_suffix(c: Column, suffix: str = "吧") -> Column:
    return F.when((c == "") | c.endswith(suffix), c).otherwise(F.concat(c, F.lit(suffix)))


def without_suffix(c: Column, suffix: str = "吧") -> Column:
    return F.regexp_replace(c, f"{suffix}$", "")


def clean_title(c: Column, forum: Column) -> Column:
    """Without the site's suffix and 【forum】."""
    return strip(F.replace(F.regexp_replace(c, r"_百度贴吧$|-百度贴吧$", ""), F.concat(F.lit("【"), forum, F.lit("】")), F.lit("")))


def fragments_text(c: Column, *fields: str) -> Column:
    """Of an array of structs, the first field of each that is neither null nor '', joined."""
    pick = lambda x: F.coalesce(*(F.nullif(x[f], F.lit("")) for f in fields or ("text",)), F.lit(""))
    return F.array_join(F.transform(F.coalesce(c, F.array()), pick), "")


def content_text(json: Column) -> Column:
    """Content that is a JSON string, or an array of fragments with text or c; white space squeezed, '' for anything else."""
    parts = F.from_json(json, "array<struct<text: string, c: string>>")
    single = F.from_json(F.concat(F.lit('{"x":'), json, F.lit("}")), "x string")["x"]
    return F.when(F.trim(json).startswith("["), squeeze(fragments_text(parts, "text", "c"))).when(F.trim(json).startswith('"'), squeeze(single)).otherwise("")


def next_offset(c: Column) -> Column:
    """The offset parameter of a next-page URL; '' if there is none."""
    return F.coalesce(F.try_parse_url(c, F.lit("QUERY"), F.lit("offset")), F.lit(""))


def log_level(c: Column) -> Column:
    up = F.upper(c)
    return F.when(up.contains("ERROR") | up.contains("FAILED"), "error").when(up.contains("WARN"), "warning").when(up.contains("SUCCESS") | c.contains("完成") | c.contains("成功"), "success").when(up.contains("DEBUG"), "debug").otherwise("info")


def base36_decode(c: Column) -> Column:
    """Up to 12 digits, with a sign; null beyond (see base36_text)."""
    digits = F.regexp_replace(F.lower(c), "^-", "")
    number = F.conv(digits, 36, 10).try_cast("bigint")
    return F.when(F.length(digits) <= 12, F.when(c.startswith("-"), -number).otherwise(number))


def base36_text():
    """A pandas UDF: base 36 of any length to decimal digits; null where it is no number."""

    def one(t):
        try:
            return None if t is None else str(int(t, 36))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


def base36_encode(c: Column) -> Column:
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lower(F.conv(F.abs(c).cast("string"), 10, 36)))


def largest_variant(variants: Column, size: str = "size", url: str = "url") -> Column:
    """The url of the largest variant, the first of equal ones."""
    return F.array_max(F.transform(variants, lambda x, i: F.struct(x[size].alias("s"), (-i).alias("i"), x[url].alias("u"))))["u"]


#: Gender codes by platform. They disagree, and are kept apart.
GENDERS = {
    "xhs": {"1": "Female", "0": "Male"},
    "dy": {"0": "Unknown", "1": "Male", "2": "Female"},
    "ks": {"F": "Female", "M": "Male"},
    "wb": {"f": "Female", "m": "Male"},
    "zhihu": {"1": "Male", "0": "Female"},
    "tieba": {"1": "Male", "2": "Female"},
}
#: What any other code means where quirks are kept.
OTHER_GENDER = {"xhs": None, "dy": "Unknown", "ks": "Male", "wb": "Male", "zhihu": "Unknown", "tieba": "Unknown"}


def gender(platform: Column, code: Column, parity: bool = True) -> Column:
    def one(p: str) -> Column:
        known = reduce(lambda acc, kv: acc.when(code == kv[0], kv[1]), GENDERS[p].items(), F.when(F.lit(False), F.lit(None).cast("string")))
        return known.otherwise(F.lit(OTHER_GENDER[p] if parity else None).cast("string"))

    return reduce(lambda acc, p: acc.when(platform == p, one(p)), GENDERS, F.when(F.lit(False), F.lit(None).cast("string")))


def pseudonymize(c: Column, salt: str) -> Column:
    """A keyed hash in place of a name or id."""
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)


def html_unescape():
    """A pandas UDF: entities decoded (Spark has no function for it)."""
    import html

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return run
