"""Captured HTTP data: bodies, errors, challenges, authentication headers, event streams, links and tokens."""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

from cairnfield import schemas as S

from . import text as T

MAX_BODY_BYTES = 2 * 1024 * 1024  # fixed value: larger bodies are an error
PART_BYTES = 4 * 1024 * 1024  # of bodies that a task's Python holds at once, beside the batch it reads
_WINDOWS = {"gzip": 16 + zlib.MAX_WBITS, "x-gzip": 16 + zlib.MAX_WBITS, "deflate": zlib.MAX_WBITS}


class TooLarge(ValueError):
    """A body beyond the limit."""


def _inflated(data: bytes, window: int) -> bytes:
    """Undoes one coding, member by member, and stops at the limit: a bomb is never unpacked."""
    out: list[bytes] = []
    size = 0
    while data:
        member = zlib.decompressobj(window)
        part = member.decompress(data, MAX_BODY_BYTES + 1 - size)
        size += len(part)
        if size > MAX_BODY_BYTES:
            raise TooLarge
        if not member.eof:
            raise zlib.error("truncated")
        out.append(part)
        data = member.unused_data if window > zlib.MAX_WBITS else b""
    return b"".join(out)


def decoded(body: bytes | None, encoding: str | None) -> tuple[bytes | None, str | None]:
    """The body with its content codings undone, last first, and an error: the raw bytes where one can't be, none beyond the limit."""
    if body is None:
        return None, None
    data = raw = bytes(body)
    codings = [x.strip().lower() for x in (encoding or "").split(",")]
    try:
        if len(data) > MAX_BODY_BYTES:
            raise TooLarge
        for coding in reversed([x for x in codings if x not in ("", "identity")]):
            if coding not in _WINDOWS:
                return raw, "decode_error"
            try:
                data = _inflated(data, _WINDOWS[coding])
            except zlib.error:
                if coding != "deflate":
                    raise
                data = _inflated(data, -zlib.MAX_WBITS)  # without its header
    except TooLarge:
        return None, "body_too_large"
    except zlib.error:
        return raw, "decode_error"
    return data, None


def in_parts[X](values: Iterable[X], size: Callable[[X], int]) -> Iterator[list[X]]:
    """All values in order, in lists that end with the value that brings them to PART_BYTES."""
    part, held = [], 0
    for x in values:
        part.append(x)
        held += size(x)
        if held >= PART_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


@F.arrow_udf(StructType([StructField("body", BinaryType()), StructField("error", StringType())]))
def decode_body(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Bodies with gzip and deflate undone, and the errors; handed on part by part, however large a batch is unpacked."""
    for body, encoding in batches:
        made = (decoded(b.as_py(), e.as_py()) for b, e in zip(body, encoding, strict=True))
        for part in in_parts(made, lambda x: len(x[0] or b"")):
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in part], pa.binary()), pa.array([x for _, x in part], pa.string())], ["body", "error"])


def body_text(body: Column) -> Column:
    """The text of a body; bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(body.cast("string"))


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


# Error codes and names by class.
CODES = {
    "timeout": ("UND_ERR_CONNECT_TIMEOUT", "UND_ERR_HEADERS_TIMEOUT", "UND_ERR_BODY_TIMEOUT", "ETIMEDOUT"),
    "reset": ("ECONNRESET", "UND_ERR_SOCKET"),
    "dns": ("ENOTFOUND", "EAI_AGAIN"),
    "refused": ("ECONNREFUSED",),
}
ABORTED = "AbortError"
#: What messages say, as parts of them in lower case.
PROXY_SAYS, PROXY_HINTS = ("proxy response (", "http tunneling", "407"), ("proxy", "tunnel")
RESET_SAYS, TLS_SAYS = ("socket hang up", "other side closed"), ("cert", "tls", "ssl", "handshake")


def _says(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def error_class(name: Column, code: Column, message: Column) -> Column:
    """Class of a failed request: what a proxy says comes first, then codes and words by class, at last a hint of a proxy."""
    name, code, said = (F.coalesce(c, F.lit("")) for c in (name, code, F.lower(message)))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kind, codes in CODES.items() for c in codes for x in (c, kind)]), code)
    signals = [
        ("proxy_denied", _says(said, PROXY_SAYS)),
        ("timeout", (name == ABORTED) | (known == "timeout")),
        ("reset", (known == "reset") | _says(said, RESET_SAYS)),
        ("tls", _says(F.concat_ws(" ", F.lower(code), said), TLS_SAYS)),
    ]
    out = [F.when(F.coalesce(holds, F.lit(False)), kind) for kind, holds in signals]
    return F.coalesce(*out, known, F.when(_says(said, PROXY_HINTS), "proxy_denied"), F.lit("other"))


def header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def proxy_interstitial(status: Column, headers: Column, body: Column, signature: str | None = None, denied: tuple[str, ...] = ("proxy-authenticate",)) -> Column:
    """The crawler's own proxy answered: one of the headers `denied` is there, or a signature in the first 4096 characters."""
    own = F.lit(False)
    for name in denied:
        own = own | header(headers, name).isNotNull()
    if signature is not None:
        own = own | F.coalesce(F.substring(body, 1, 4096).rlike(signature), F.lit(False))
    return status.isin(403, 407) & own


# Marks of bot defences as (header, its value or a part of it, statuses, parts of the body); null is any.
DEFENCES = [
    ("cf-mitigated", "=challenge", None, None),
    ("x-vercel-mitigated", "=challenge", None, None),
    ("server", "=cloudflare", (403, 503), ("cf-chl", "challenge-platform", "just a moment")),
    ("x-datadome", None, (403, 429), None),
    ("x-px-block", None, (403, 429), None),
    ("set-cookie", "_px", (403, 429), None),
    ("set-cookie", "datadome", (403, 429), None),
    ("set-cookie", "perimeterx", (403, 429), None),
    (None, None, (403,), ("akamai", "access denied")),
]
REFERENCE_NUMBER = r"(?i)reference #\d+\.\w+\.\d+"


def challenge(status: Column, headers: Column, body: Column) -> Column:
    """A bot-defence page rather than the site's answer: any of the marks, or a block page's reference number."""
    text = F.lower(F.coalesce(body, F.lit("")))
    found = (status == 403) & text.rlike(REFERENCE_NUMBER)
    for name, value, statuses, parts in DEFENCES:
        mark = F.lit(True)
        if name is not None:
            held = header(headers, name)
            mark = held.isNotNull() if value is None else held == value[1:] if value[0] == "=" else F.contains(F.lower(held), F.lit(value))
        if statuses is not None:
            mark = mark & status.isin(*statuses)
        if parts is not None:
            mark = mark & _says(text, parts)
        found = found | F.coalesce(mark, F.lit(False))
    return found


_CHALLENGE = ("raw", "scheme", "realm", "resource_metadata", "error", "error_description", "scope")


def _parts_of_header(raw: str) -> Iterator[tuple[str, str | None, bool]]:
    """(name, value, whether it begins an element of the list); the value of a bare word is null."""
    at, size, begins = 0, len(raw), True
    while at < size:
        if raw[at] in " \t\r\n,":
            begins |= raw[at] == ","
            at += 1
            continue
        end = at
        while end < size and raw[end] not in ' \t\r\n,="':
            end += 1
        name, at = raw[at:end], max(end, at + 1)
        after = raw[end:].lstrip()
        if not after.startswith("="):
            yield name, None, begins
        else:
            at = size - len(after) + 1
            while at < size and raw[at].isspace():
                at += 1
            value: list[str] = []
            if raw[at : at + 1] == '"':
                at += 1
                while at < size and raw[at] != '"':
                    at += raw[at] == "\\" and at + 1 < size
                    value.append(raw[at])
                    at += 1
                at += 1
            else:
                while at < size and not (raw[at].isspace() or raw[at] == ","):
                    value.append(raw[at])
                    at += 1
            yield name, "".join(value).strip(), begins
        begins = False


def parsed_challenge(raw: str | None) -> dict | None:
    """The Bearer challenge of a WWW-Authenticate header with all that follows it, else the first; null for a blank header."""
    if raw is None or not raw.strip():
        return None
    out: dict = dict.fromkeys(_CHALLENGE) | {"raw": raw}
    parts = list(_parts_of_header(raw))
    start = next((k for k, (name, value, begins) in enumerate(parts) if begins and value is None and name.lower() == "bearer"), 0)
    if parts and parts[start][0][:1].isalpha():
        out["scheme"] = parts[start][0]
        # of several values the last counts
        out |= {name.lower(): value for name, value, _ in parts[start:] if value is not None and name.lower() in _CHALLENGE[2:]}
    return out


@F.pandas_udf(StringType())
def _challenge_json(raws: pd.Series) -> pd.Series:
    return pd.Series([None if (x := parsed_challenge(r)) is None else json.dumps(x) for r in raws], dtype="object")


def www_authenticate(raw: Column) -> Column:
    """Struct of the challenge that counts in a WWW-Authenticate header; null for a blank one."""
    return F.from_json(_challenge_json(raw), ", ".join(f"{n} STRING" for n in _CHALLENGE))


def first_sse_data(body: Column) -> Column:
    """The data lines of the first event that has any, joined by line feeds."""
    blocks = F.split(body, r"\r?\n\r?\n")
    data = F.transform(blocks, lambda b: F.array_join(F.transform(F.filter(F.split(b, r"\r?\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(F.substring(x, F.lit(6), F.length(x)), "^ ", "")), "\n"))
    return F.get(F.filter(data, lambda d: T.trim(d) != ""), F.lit(0))


def generator(html: Column) -> Column:
    """The generator meta tag, in either order of its attributes; null if there is none."""
    q = "[\"']"
    a = F.regexp_extract(html, f"(?i)<meta[^>]+name={q}generator{q}[^>]*content={q}([^\"']+){q}", 1)
    b = F.regexp_extract(html, f"(?i)<meta[^>]+content={q}([^\"']+){q}[^>]*name={q}generator{q}", 1)
    return F.coalesce(T.blank_as_null(a), T.blank_as_null(b))


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<title[^>]*>([\s\S]{0,300}?)</title>", 1)
    return F.when(html.rlike(r"(?i)<title[^>]*>[\s\S]{0,300}?</title>"), T.trim(F.regexp_replace(found, T.SPACE + "+", " ")))


def asset_hosts(html: Column) -> Column:
    """Hosts of scripts, links, images and frames on other sites, in page order."""
    pattern = r"(?i)<(?:script|link|img|iframe)\b[^>]*?(?:src|href)=[\"'](?:https?:)?//([a-z0-9.-]+\.[a-z]{2,})[/\"']"
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.lower)


def ua_product(ua: Column) -> Column:
    """A user agent without version and what follows it, cut to 60 characters; `(none)` if empty."""
    short = F.substring(F.regexp_replace(F.coalesce(ua, F.lit("")), r"/[\d.]+.*$", ""), 1, 60)
    return F.when(short == "", "(none)").otherwise(short)


# ---------------------------------------------------------------------------------------------------------------------
# links


def resolved(url: str, base: str) -> str | None:
    """An absolute URL in normal form: lower-case scheme and host, no default port, a path at least of a slash."""
    try:
        parts = urlsplit(urljoin(base, url.strip()))
        if not parts.scheme or (parts.scheme in ("http", "https") and not parts.hostname):
            return None
        host = (parts.hostname or "").lower()
        port = parts.port
    except ValueError:
        return None
    if parts.scheme not in ("http", "https"):
        return urlunsplit(parts)
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        host = f"{host}:{port}"
    return urlunsplit((parts.scheme, host, parts.path or "/", parts.query, parts.fragment))


@F.pandas_udf(ArrayType(StringType()))
def resolve_links(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Links against the URL of their page; those that can't be resolved are dropped."""
    for links, base in batches:
        yield pd.Series([[r for x in urls if x is not None and (r := resolved(x, b or ""))] if urls is not None else None for urls, b in zip(links, base, strict=True)])


def linked(text: str) -> list[str]:
    """Distinct targets of Markdown links, then of bare URLs, in order of appearance."""
    marked, bare, closed = [], [], -1
    at = text.find("]")
    while at >= 0:
        if text.startswith("(", at + 1) and text.rfind("[", closed + 1, at) >= 0:
            rest = text[at + 2 : at + 4098].lstrip()
            target = re.match(r"<?([^\s)>]+)>?", rest)
            if target:
                tail = rest[target.end() :].lstrip()
                if tail.startswith('"') and (end := tail.find('"', 1)) > 0 and target.end() < len(rest) and rest[target.end()].isspace():
                    tail = tail[end + 1 :].lstrip()
                if tail.startswith(")"):
                    marked.append(target[1])
        closed = at
        at = text.find("]", at + 1)
    at = text.find("http")
    while at >= 0:
        end = at + 4
        before = text[at - 1 : at]
        if text.startswith(("http://", "https://"), at) and before not in ("(", "]") and not (before.isalnum() or before == "_"):
            while end < len(text) and not (text[end].isspace() or text[end] in "<>)\"'"):
                end += 1
            if not text[at:end].endswith("://"):
                bare.append(text[at:end].rstrip(".,;:"))
        at = text.find("http", end)
    return list(dict.fromkeys(marked + bare))


@F.pandas_udf(ArrayType(StringType()))
def markdown_links(bodies: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else linked(x) for x in bodies], dtype="object")


# Names of descriptions, extensions of files that are no pages, first words of paths that end a session.
API_NAMES, API_EXTENSIONS = ("openapi", "swagger"), ("json", "yaml", "yml")
ASSET_EXTENSIONS = tuple("png jpg jpeg gif svg webp ico css js mjs json xml pdf zip gz tgz mp3 mp4 webm woff woff2 ttf eot txt csv rss atom".split())
LEAVING_WORDS = ("logout", "signout", "sign-out", "delete", "unsubscribe")
CARD_PATHS = tuple(path for _, path, artifact, *_ in S.PROBE_SPECS if artifact in S.CARDS)


def _last(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def _extension(path: Column) -> Column:
    last = _last(path)
    return F.when(F.contains(last, F.lit(".")), F.substring_index(last, ".", -1))


def is_api_link(path: Column) -> Column:
    """The last part of a path names an API description: a description's name alone, or within a file of its format."""
    last = _last(path)
    return (last.isin(*API_NAMES) & F.contains(path, F.lit("/"))) | (F.coalesce(_extension(path).isin(*API_EXTENSIONS), F.lit(False)) & _says(last, API_NAMES))


def is_card_link(path: Column) -> Column:
    found = F.lit(False)
    for known in CARD_PATHS:
        found = found | F.lower(path).endswith(known)
    return found


def is_asset(path: Column) -> Column:
    """A file that is no page, by its extension."""
    return F.coalesce(_extension(path).isin(*ASSET_EXTENSIONS), F.lit(False))


def is_leaving(path: Column) -> Column:
    """A path that would end a session or delete something."""
    first = F.lower(F.regexp_extract(path, "^/?([A-Za-z0-9_-]*)", 1))
    found = F.lit(False)
    for word in LEAVING_WORDS:
        found = found | ((first == word) | first.startswith(word + "-"))
    return found


def llms_links(body: Column, base: Column) -> Column:
    """Struct of API description links, card links and the number of distinct links of a Markdown file."""
    raw = markdown_links(body)
    full = resolve_links(raw, base)
    kind = lambda u: F.coalesce(T.path(u), u)
    openapi = F.array_distinct(F.filter(full, lambda u: is_api_link(kind(u))))
    card = F.array_distinct(F.filter(full, lambda u: ~is_api_link(kind(u)) & is_card_link(kind(u))))
    return F.struct(openapi.alias("openapi"), card.alias("card"), F.size(raw).alias("total"))


# ---------------------------------------------------------------------------------------------------------------------
# origin-trial tokens: version (1 byte), signature (64), payload length (4, big-endian), payload


HEAD = struct.Struct(">B64xI")
#: Fields of a token: name in the payload, the type it must have there, and ours.
TOKEN = {"version": int, "feature": str, "expiry": str, "origin": str, "is_subdomain": bool, "is_third_party": bool, "decode_error": str}
PAYLOAD = (("feature", str, "feature"), ("origin", str, "origin"), ("isSubdomain", bool, "is_subdomain"), ("isThirdParty", bool, "is_third_party"))


def _payload(token: str) -> tuple[int | None, dict | str]:
    """Version and payload of a token, or what is wrong with it."""
    padded = token.strip()
    try:
        data = base64.b64decode(padded.ljust(-(-len(padded) // 4) * 4, "="))
    except (binascii.Error, ValueError):
        return None, "base64"
    if len(data) < HEAD.size:
        return None, "too_short"
    version, size = HEAD.unpack_from(data)
    body = data[HEAD.size : HEAD.size + size]
    if version not in (2, 3):
        return version, f"unknown_version:{version}"
    if len(body) < size:
        return version, "length_mismatch"
    try:
        return version, json.loads(str(body, "utf-8", "replace"))
    except ValueError:
        return version, "payload_json"


def decode_token(token: str) -> dict:
    """Fields of an origin-trial token; its signature isn't checked."""
    version, held = _payload(token)
    out = dict.fromkeys(TOKEN) | {"version": version}
    if isinstance(held, str):
        return out | {"decode_error": held}
    held = held if isinstance(held, dict) else {}
    out |= {ours: held[name] for name, kind, ours in PAYLOAD if isinstance(held.get(name), kind)}
    until = held.get("expiry")
    if type(until) in (int, float):
        out["expiry"] = pd.Timestamp(until, unit="s").isoformat(timespec="milliseconds") + "Z"
    return out


_TYPES = {int: IntegerType(), str: StringType(), bool: BooleanType()}
_TOKEN_FIELDS = StructType([StructField(n, _TYPES[kind]) for n, kind in TOKEN.items()])


@F.pandas_udf(_TOKEN_FIELDS)
def decode_tokens(tokens: pd.Series) -> pd.DataFrame:
    rows = [decode_token(x) if x is not None else dict.fromkeys(TOKEN) for x in tokens]
    out = pd.DataFrame(rows)
    return out.astype({"version": "Int32", "is_subdomain": "boolean", "is_third_party": "boolean"})
