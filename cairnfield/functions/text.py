"""String and URL expressions with the white-space and case rules of the captured data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trim(c: Column) -> Column:
    """Trims all Unicode white space and byte-order marks, which SQL's trim leaves."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def blank_as_null(c: Column) -> Column:
    return F.nullif(trim(c), F.lit(""))


def media_type(content_type: Column) -> Column:
    """Type and subtype in lower case, without parameters; empty for null."""
    return F.coalesce(F.lower(trim(F.split_part(content_type, F.lit(";"), F.lit(1)))), F.lit(""))


def looks_like_html(body: Column) -> Column:
    head = F.lower(F.regexp_replace(F.substring(body, 1, 2048), f"^{SPACE}+", ""))
    return head.startswith("<!doctype html") | head.startswith("<html") | head.rlike(r"<head[\s>]|<body[\s>]|<meta\s|<script[\s>]")


def part(url: Column, which: str) -> Column:
    """A part of a URL; null if it can't be parsed."""
    return F.try_parse_url(url, F.lit(which))


def hostname(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def origin(url: Column) -> Column:
    """Scheme, host and any port but the default one; the input itself if it isn't an absolute URL."""
    scheme = F.lower(part(url, "PROTOCOL"))
    authority = F.lower(F.regexp_replace(part(url, "AUTHORITY"), r"^[^@]*@", ""))
    default = F.when(scheme == "https", ":443$").when(scheme == "http", ":80$")
    return F.coalesce(F.concat(scheme, F.lit("://"), F.regexp_replace(authority, F.coalesce(default, F.lit("$^")), F.lit(""))), url)


def path(url: Column) -> Column:
    """The path of an absolute URL, at least a slash; null if the URL can't be parsed."""
    found = part(url, "PATH")
    return F.when(found.isNotNull(), F.when(found == "", "/").otherwise(found))


def without_trailing_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/$", "")


def csv_escape(c: Column, triggers: str = r'[",\r\n]') -> Column:
    """RFC 4180 quoting; null is empty."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike(triggers), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
