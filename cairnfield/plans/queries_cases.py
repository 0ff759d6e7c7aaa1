"""Queries that put rows through operators by cases: a key picks the case, and the oracle states what must come out."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield import schemas as S
from cairnfield.functions import documents as D
from cairnfield.functions import http as W
from cairnfield.functions import robots
from cairnfield.functions import text as T
from cairnfield.operators import cards, classify, consistency, corpora, experiment, handshake, lookups, pages, sampling, summary, validate
from cairnfield.plans import queries_rows
from cairnfield.plans import views as V
from cairnfield.sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _sql(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def cases(ddl: str, out: str, rows: list[tuple[tuple, tuple]]):
    """Registers `f(cases) -> DataFrame`: each part gets the input of the case of its key; the oracle maps keys to expected outputs (name type, ...)."""
    fields = [x.split() for x in out.split(", ")]
    values = ", ".join("(" + ", ".join([str(k), *map(_sql, want)]) + ")" for k, (_, want) in enumerate(rows))
    picked = ", ".join(f"c.{n}::{t} AS {n}" for n, t in fields)

    def add(f):
        def run(spark, sf_dir) -> DataFrame:
            given = spark.createDataFrame([(k, *x) for k, (x, _) in enumerate(rows)], f"k BIGINT, {ddl}")
            keyed = V.dealt(V.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").withColumn("k", F.col("p_partkey") % len(rows))
            return f(keyed.join(F.broadcast(given), "k")).select("p_partkey", *[n for n, _ in fields])

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = f"SELECT p_partkey, {picked} FROM part JOIN (VALUES {values}) c(k, {', '.join(n for n, _ in fields)}) ON p_partkey % {len(rows)} = c.k"
        return f

    return add


# ---------------------------------------------------------------------------------------------------------------------
# requests and bodies


@cases("name STRING, code STRING, message STRING", "error VARCHAR", [
    ((None, "ECONNRESET", "x"), ("reset",)), (("AbortError", None, None), ("timeout",)), ((None, "ENOTFOUND", "getaddrinfo"), ("dns",)), ((None, None, "Proxy response (407) !== 200 when HTTP Tunneling"), ("proxy_denied",)),
    ((None, "UND_ERR_SOCKET", "other side closed"), ("reset",)), ((None, "CERT_HAS_EXPIRED", "expired"), ("tls",)), ((None, "ECONNREFUSED", ""), ("refused",)), ((None, None, "tunnel failed"), ("proxy_denied",)),
    ((None, None, "boom"), ("other",)), ((None, "EAI_AGAIN", "x"), ("dns",)), ((None, "ETIMEDOUT", "HTTP Tunneling"), ("proxy_denied",)), ((None, None, "before secure TLS connection"), ("tls",)), ((None, None, None), ("other",)), ((None, "UND_ERR_HEADERS_TIMEOUT", "ssl"), ("timeout",)),
])
def error_classes(rows):
    """P5."""
    return rows.withColumn("error", W.error_class(F.col("name"), F.col("code"), F.col("message")))


@cases("status INT, headers MAP<STRING,STRING>, body STRING", "challenge BOOLEAN, proxy BOOLEAN", [
    ((200, {"cf-mitigated": "challenge"}, ""), (True, False)), ((503, {"server": "cloudflare"}, "Just a moment..."), (True, False)), ((200, {"server": "cloudflare"}, "Just a moment..."), (False, False)), ((429, {"x-datadome": "1"}, None), (True, False)),
    ((200, {"x-datadome": "1"}, ""), (False, False)), ((403, {"set-cookie": "_px3=1"}, ""), (True, False)), ((403, {}, "Access Denied"), (True, False)), ((404, {}, "Access Denied"), (False, False)), ((403, {}, "Reference #18.2f.123"), (True, False)),
    ((407, {"proxy-authenticate": "Basic"}, ""), (False, True)), ((403, {}, "<h1>EGRESS POLICY</h1>"), (False, True)), ((200, {"proxy-authenticate": "Basic"}, ""), (False, False)), ((403, {"x-vercel-mitigated": "challenge"}, ""), (True, False)), ((403, {}, "no"), (False, False)),
])
def challenge_pages(rows):
    """P3, P4."""
    args = F.col("status"), F.col("headers"), F.col("body")
    return rows.withColumns({"challenge": W.challenge(*args), "proxy": F.coalesce(W.proxy_interstitial(*args, signature="(?i)egress policy"), F.lit(False))})


_PLAIN = b'{"a": "na\xc3\xafve"}'
_RAW = zlib.compressobj(wbits=-15)
_BODIES = [(_PLAIN, None, "ok", None), (gzip.compress(_PLAIN, mtime=0), "gzip", "ok", None), (zlib.compress(_PLAIN), "deflate", "ok", None), (_RAW.compress(_PLAIN) + _RAW.flush(), "Deflate", "ok", None), (gzip.compress(zlib.compress(_PLAIN), mtime=0), "deflate, gzip", "ok", None),
    (gzip.compress(b"x" * (W.MAX_BODY_BYTES + 1), mtime=0), "gzip", None, "body_too_large"), (b"junk", "gzip", "junk", "decode_error"), (b"na\xefve", "identity", "na\ufffdve", None), (gzip.compress(_PLAIN[:5], mtime=0) + gzip.compress(_PLAIN[5:], mtime=0), "x-gzip", "ok", None)]
_WANT = [_PLAIN.decode() if t == "ok" else t for _, _, t, _ in _BODIES]


@cases("packed STRING, encoding STRING", "body_text VARCHAR, sha256 VARCHAR, error VARCHAR", [
    ((base64.b64encode(b).decode(), e), (w, None if w is None else hashlib.sha256(b if w != _PLAIN.decode() else _PLAIN).hexdigest(), err)) for (b, e, _, err), w in zip(_BODIES, _WANT, strict=True)
])
def decoded_bodies(rows):
    """F10, F32, S23 (decoding)."""
    made = rows.withColumn("d", W.decode_body(F.unbase64("packed"), F.col("encoding")))
    return made.withColumns({"body_text": W.body_text(F.col("d.body")), "sha256": W.sha256(F.col("d.body")), "error": F.col("d.error")})


@cases("content_type STRING, a STRING, b STRING", "mime VARCHAR, same BOOLEAN", [
    (("Text/HTML; charset=utf-8", "https://a.test/", "https://a.test"), ("text/html", True)), ((None, "https://a.test/x", "https://a.test/x/"), ("", True)), (("application/json", "https://a.test", "https://b.test"), ("application/json", False)), ((" application/mcp+json ;x", "https://a.test//", "https://a.test"), ("application/mcp+json", False)),
])
def media_and_issuers(rows):
    """F9, F14."""
    return rows.withColumns({"mime": T.media_type(F.col("content_type")), "same": T.without_trailing_slash(F.col("a")) == T.without_trailing_slash(F.col("b"))})


_ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/ok\n\nUser-agent: Bot\nUser-agent: other\nDisallow: /x*y$\nDisallow:\n# c\n"


@cases("robots STRING, path STRING, agent STRING", "allowed BOOLEAN", [
    ((_ROBOTS, "/private/a", "someone"), (False,)), ((_ROBOTS, "/private/ok/a", "someone"), (True,)), ((_ROBOTS, "/private/a", "bot/2.0"), (True,)), ((_ROBOTS, "/x/z/y", "Bot"), (False,)), ((_ROBOTS, "/x/z/yes", "Bot"), (True,)),
    ((None, "/", "Bot"), (True,)), (("User-agent: *\nDisallow: /", "/a", "b"), (False,)), (("User-agent: *\nDisallow: /a\nAllow: /a", "/a", "b"), (True,)), (("Disallow: /\n", "/a", "b"), (True,)),
])
def robots_rules(rows):
    """P22."""
    return rows.withColumn("allowed", robots.robots_allows(F.col("robots"), F.col("path"), F.col("agent")))


# ---------------------------------------------------------------------------------------------------------------------
# documents


@cases("text STRING, content_type STRING", "valid BOOLEAN, reasons VARCHAR", [
    (("Contact: mailto:a@b.test\nExpires: 2030-01-01T00:00:00Z", "text/plain"), (True, "")), (("contact : https://b.test/c", "text/plain"), (True, "note:no_expires_field")), (("Expires: 2030", "text/plain"), (False, "no_contact_field")), (("<html>Contact: x", "text/plain"), (False, "body_is_html")),
    (("Contact: x", "text/html; a"), (False, "body_is_html")), (("  \n", "text/plain"), (False, "empty")),
])
def security_files(rows):
    """P9."""
    return rows.withColumn("o", validate.security_txt(F.col("text"), F.col("content_type"))).withColumns({"valid": F.col("o.valid"), "reasons": F.array_join("o.reasons", ",")})


@cases("text STRING, path STRING", "valid BOOLEAN, reasons VARCHAR", [
    (('{"openapi":"3.1.0","paths":{}}', "/openapi.json"), (True, "")), (("openapi: 3.0.1\npaths: {}\n", "/openapi.yaml"), (True, "")), (("openapi: 3.0.1\npaths: {}\n", "/openapi.json"), (True, "json_path_served_yaml")), (('{"swagger":"2.0","paths":{}}', "/openapi.json"), (False, "swagger_2_not_3:2.0")),
    (('{"openapi":"3.0.0"}', "/openapi.json"), (True, "no_paths")), (('{"x":1}', "/openapi.json"), (False, "missing_openapi_3_field")), (("a: [1", "/openapi.yaml"), (False, "unparseable_json_or_yaml")), (("[1]", "/openapi.json"), (False, "not_an_object")), (("<!doctype html><p>", "/openapi.json"), (False, "body_is_html")),
])
def openapi_documents(rows):
    """P10, F19, P6."""
    given = rows.withColumns({"artifact": F.lit("openapi_json"), "kind": F.lit("openapi"), "content_type": F.lit("application/json"), "final_url": F.concat(F.lit("https://a.test"), "path"), "checked": F.lit(True)})
    return validate.with_outcome(given).withColumns({"valid": F.col("outcome.valid"), "reasons": F.array_join("outcome.reasons", ",")})


@cases("resource STRING, url STRING", "matches BOOLEAN", [
    (("https://a.test/mcp", "https://a.test/.well-known/oauth-protected-resource/mcp"), (True,)), (("https://A.test/mcp/", "https://a.test/.well-known/oauth-protected-resource/mcp"), (True,)), (("https://b.test/mcp", "https://a.test/.well-known/oauth-protected-resource/mcp"), (False,)),
    (("https://a.test", "https://a.test/.well-known/oauth-protected-resource"), (True,)), (("https://a.test/x", "https://a.test/.well-known/oauth-protected-resource"), (False,)), (("https://a.test", "https://a.test/other"), (None,)), (("junk", "https://a.test/.well-known/oauth-protected-resource"), (False,)),
])
def resource_identity(rows):
    """P12."""
    return rows.withColumn("matches", validate.resource_matches(F.col("resource"), F.col("url")))


@cases("doc STRING", "operations VARCHAR", [
    (('{"paths":{"/b":{"post":{"operationId":"makeB"},"get":{}},"/a":{"get":{"operationId":" "}}}}',), ("get /b,makeB,get /a",)), (('{"paths":{"/x/{id}":{"delete":{},"parameters":[],"trace":{}}}}',), ("delete /x/{id},trace /x/{id}",)), (('{"paths":[]}',), ("",)), (('{"info":{}}',), ("",)),
])
def api_operations(rows):
    """F18."""
    return rows.withColumn("operations", F.array_join(F.transform(cards.openapi_operations(F.col("doc")), lambda x: x["key"]), ","))


@cases("body STRING, yaml BOOLEAN", "parsed VARCHAR", [
    (('{"b":1,"a":[2]}', False), ('{"b":1,"a":[2]}',)), (("a: 1\nb:\n  - x\n", True), ('{"a":1,"b":["x"]}',)), (("a: 1", False), ('{"a":1}',)), (('\ufeff{"a":1}', False), ('{"a":1}',)), (("a: [", True), (None,)), (('{"a":1,"a":2}', False), ('{"a":2}',)),
])
def json_or_yaml(rows):
    """F19."""
    return rows.withColumn("parsed", F.regexp_replace(D.structured(F.col("body"), F.col("yaml")), r"([:,]) ", "$1"))


@cases("doc STRING", "endpoint VARCHAR, every VARCHAR, servers VARCHAR, pkce BOOLEAN", [
    (('{"remotes":[{"type":"x"},{"url":"https://a.test/1"},{"url":"https://a.test/2"}],"url":"https://a.test/3"}',), ("https://a.test/1", "https://a.test/1,https://a.test/2", "", False)),
    (('{"supportedInterfaces":[{"url":"https://a.test/i"}],"authorization_servers":["https://l.test","https://l.test"],"code_challenge_methods_supported":["plain","S256"]}',), ("https://a.test/i", "https://a.test/i", "https://l.test", True)),
    (('{"endpoint":"https://a.test/e","authentication":{"oauth":{"issuer":"https://i.test","authorization_servers":["https://j.test"]}}}',), ("https://a.test/e", "https://a.test/e", "https://i.test,https://j.test", False)),
    (('{"transport":{"url":"https://a.test/t"},"auth":{"x":{"authorization_server":"https://k.test"}}}',), ("https://a.test/t", "https://a.test/t", "https://k.test", False)), (('{"servers":[{"url":"https://a.test/s"}]}',), ("https://a.test/s", "https://a.test/s", "", False)), (('{"name":"x"}',), (None, "", "", False)),
])
def card_fields(rows):
    """F11, F12, P28."""
    d = D.variant(F.col("doc"))
    return rows.withColumns({"endpoint": cards.endpoint(d), "every": F.array_join(cards.all_endpoints(d), ","), "servers": F.array_join(cards.authorization_servers(d), ","), "pkce": F.coalesce(cards.pkce(d), F.lit(False))})


@cases("url STRING", "metadata VARCHAR, resources VARCHAR", [
    (("https://a.test/t/",), ("https://a.test/.well-known/oauth-authorization-server/t https://a.test/t/.well-known/openid-configuration", "path_suffixed:https://a.test/.well-known/oauth-protected-resource/t root:https://a.test/.well-known/oauth-protected-resource")),
    (("https://a.test",), ("https://a.test/.well-known/oauth-authorization-server https://a.test/.well-known/openid-configuration", "root:https://a.test/.well-known/oauth-protected-resource")), (("not a url",), (None, None)),
])
def metadata_places(rows):
    """F13."""
    u = F.col("url")
    return rows.withColumns({"metadata": F.array_join(handshake.metadata_urls(u), " "), "resources": F.array_join(F.transform(handshake.resource_urls(u), lambda x: F.concat(x["location"], F.lit(":"), x["url"])), " ")})


@cases("body STRING", "api VARCHAR, card VARCHAR, total INT", [
    (('# x\n- [API](/openapi.json "the api")\n- [c](<https://a.test/.well-known/agent.json>)\nsee https://b.test/v1/swagger.yaml, or [again](/openapi.json).',), ("https://a.test/openapi.json,https://b.test/v1/swagger.yaml", "https://a.test/.well-known/agent.json", 3)),
    (("[a](x.md) (https://c.test/in) http://d.test/swagger",), ("http://d.test/swagger", "", 2)), (("no links [a] (b)",), ("", "", 0)), (("[a](/docs/my-openapi-v2.yml) [b](/api/openapi) [c](/openapi/index.html)",), ("https://a.test/docs/my-openapi-v2.yml,https://a.test/api/openapi", "", 3)),
])
def llms_link_kinds(rows):
    """F23."""
    made = rows.withColumn("x", W.llms_links(F.col("body"), F.lit("https://a.test/llms.txt")))
    return made.withColumns({"api": F.array_join("x.openapi", ","), "card": F.array_join("x.card", ","), "total": F.col("x.total")})


def _token(payload: bytes, version: int = 3, size: int | None = None) -> str:
    return base64.b64encode(bytes([version]) + bytes(64) + (len(payload) if size is None else size).to_bytes(4, "big") + payload).decode()


@cases("token STRING", "version INT, feature VARCHAR, expiry VARCHAR, origin VARCHAR, is_subdomain BOOLEAN, decode_error VARCHAR", [
    ((_token(b'{"origin":"https://a.test:443","feature":"WebMCP","expiry":1791036131,"isSubdomain":true}'),), (3, "WebMCP", "2026-10-03T14:02:11.000Z", "https://a.test:443", True, None)), ((_token(b'{"feature":7,"expiry":"x"}', 2),), (2, None, None, None, None, None)), ((_token(b"{}", 9),), (9, None, None, None, None, "unknown_version:9")),
    ((_token(b"{}", 3, 99),), (3, None, None, None, None, "length_mismatch")), ((_token(b"{nope"),), (3, None, None, None, None, "payload_json")), (("AA==",), (None, None, None, None, None, "too_short")), (("\u00e9",), (None, None, None, None, None, "base64")), ((_token(b"[1]").rstrip("="),), (3, None, None, None, None, None)),
])
def trial_tokens(rows):
    """F27."""
    return rows.withColumn("t", W.decode_tokens(F.col("token"))).select("p_partkey", "t.*")


@cases("valid BOOLEAN, url STRING, body STRING", "hint VARCHAR", [
    ((True, "https://a.test/s", "# x\nContact: mailto:s@a.test \nContact: b"), ("mailto:s@a.test",)), ((True, "https://a.test/s", None), ("security.txt: https://a.test/s",)), ((False, "https://a.test/s", "Contact: x"), ("WHOIS/abuse",)), ((None, None, None), ("WHOIS/abuse",)),
])
def contact_hints(rows):
    """P27."""
    return rows.withColumn("hint", handshake.contact_hint(F.col("valid"), F.col("url"), F.col("body")))


_ANSWERS = {
    "responses": {"output": [{"type": "message", "content": [{"type": "output_text", "text": "hi"}, {"type": "x", "text": "no"}]}, {"type": "web_search_call", "action": {"url": "u"}}, {"type": "web_search_call", "action": {"url": "u"}}]},
    "messages": {"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "server_tool_use", "input": {"url": "v"}}]},
    "candidates": {"candidates": [{"content": {"parts": [{"text": "x"}, {"text": "y"}]}, "grounding_metadata": {"grounding_chunks": [{"web": {"uri": "w"}}]}}]},
}


@cases("r STRING, m STRING, c STRING", "answers VARCHAR", [
    (tuple(map(json.dumps, _ANSWERS.values())), ("hi|u;a\nb|v;xy|w",)), (("{}", '{"content":[]}', "[]"), ("|;|;|",)),
])
def service_answers(rows):
    """F33."""
    for shape, body in zip(_ANSWERS, "rmc", strict=True):
        rows = readers.answers(rows, shape, body).withColumn(shape, F.concat("answer", F.lit("|"), F.array_join("urls", ","))).drop("answer", "urls")
    return rows.withColumn("answers", F.concat_ws(";", *_ANSWERS))


@cases("url STRING", "host VARCHAR", [
    (("https://M.example.com/mcp",), ("m.example.com",)), (("http://a.example.org:8080/x",), ("a.example.org",)), (("https://{tenant}.example.com/",), (None,)), (("https://github.com/x/y",), (None,)), (("https://docs.gitlab.com/x",), (None,)), (("https://10.1.2.3/mcp",), (None,)), (("ftp://a.example.com",), (None,)), (("https://localhost/x",), (None,)),
])
def endpoint_hosts(rows):
    """F25."""
    return rows.withColumn("host", corpora.endpoint_host(F.col("url")))


# ---------------------------------------------------------------------------------------------------------------------
# registries, labels, samples

_SERVER_JSON = """'{"servers":[{"server":{"name":"s' || s_suppkey || '","remotes":[{"type":"sse","url":"https://M' || (s_suppkey % 7) || '.example.com/mcp"},{"url":"https://{t}.example.com"}]}},{"name":"t","remotes":[{"url":"https://github.com/x"}]}]}'"""
_GLAMA_JSON = """'{"servers":[{"slug":"g' || s_suppkey || '","homepageUrl":"https://no.example.com","deep":[{"sseUrl":"https://e' || (s_suppkey % 5) || '.example.com/sse"}],"endpoint":"https://u.example.com"}]}'"""
_SMITHERY_JSON = """CASE WHEN s_suppkey % 2 = 0 THEN '{"connections":[{"type":"http","url":"https://c' || (s_suppkey % 3) || '.example.com"}],"deploymentUrl":"https://x.example.com"}' ELSE '{"deploymentUrl":"https://d.example.com"}' END"""


@query("""SELECT 'official' AS registry, count(*) AS endpoints, count(DISTINCT s_suppkey % 7) AS hosts FROM supplier UNION ALL SELECT 'glama', 2 * count(*), count(DISTINCT s_suppkey % 5) + 1 FROM supplier
 UNION ALL SELECT 'smithery', count(*), count(DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 3 ELSE -1 END) FROM supplier""")
def registry_hosts(spark, sf_dir):
    """S18, S19, S20, A29, F25."""
    rows = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("qualified_name"), F.expr(_SERVER_JSON).alias("o"), F.expr(_GLAMA_JSON).alias("g"), F.expr(_SMITHERY_JSON).alias("body"))
    return corpora.hosts_by_registry(corpora.official_endpoints(rows, "o").unionByName(corpora.glama_endpoints(rows, "g")).unionByName(corpora.smithery_endpoints(rows)))


@query("SELECT DISTINCT 'm' || (s_suppkey % 7) || '.example.com' AS host FROM supplier")
def registry_host_list(spark, sf_dir):
    """F34, O6."""
    rows = V.table(spark, sf_dir, "supplier").select(F.expr(_SERVER_JSON).alias("o"))
    return corpora.distinct_hosts(corpora.official_endpoints(rows, "o"))


@query("""SELECT s_suppkey::VARCHAR || '.example.com' AS host, CASE s_suppkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_found' ELSE 'error' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::INT END AS radar_rank, CASE WHEN s_suppkey % 3 = 0 THEN 'Shopping' ELSE '' END AS categories FROM supplier""")
def category_answers(spark, sf_dir):
    """S22 (answers), S8."""
    s = V.table(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    found = F.concat(F.lit('{"success":true,"result":[{"domain":"'), F.upper(F.concat(k, F.lit(".example.com"))), F.lit('.","popularity_rank":'), k, F.lit(',"content_categories":[{"id":1,"name":"Shopping"},{"id":2}]}]}'))
    answers = s.select(k.alias("answer_id"), F.when(k % 3 == 0, found).when(k % 3 == 1, '{"success":true,"result":{}}').otherwise('{"success":false}').alias("body"))
    labels = corpora.labels_of_answers(s.select(k.alias("answer_id"), F.concat(k, F.lit(".example.com")).alias("host"), k.cast("int").alias("rank")), answers)
    return labels.select("host", "status", "radar_rank", F.array_join(F.transform("categories", lambda c: c["name"]), ",").alias("categories"))


@query("""SELECT host, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY source) AS n FROM (SELECT 'h' || c_custkey % 100 AS host, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END || lpad(c_custkey::VARCHAR, 9, '0') AS source, c_custkey::INT AS rank, c_acctbal > 0 AS good FROM customer) WHERE good) WHERE n = 1""")
def qualified_first(spark, sf_dir):
    """Of each host the first row that qualifies, over several files."""
    k = F.col("c_custkey")
    rows = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("h"), k % 100).alias("host"), F.concat(F.when(k % 2 == 0, "a").otherwise("b"), F.lpad(k.cast("string"), 9, "0")).alias("source"), k.cast("int").alias("rank"), (F.col("c_acctbal") > 0).alias("good"))
    return classify.dedupe(rows.filter("good"), ["host"], [F.col("source")]).drop("good")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END NULLS LAST, c_name) AS place FROM customer""")
def sample_order(spark, sf_dir):
    """O2, O1: by rank, those without one last, then by name."""
    rows = V.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("rank"))
    return lookups.numbered(rows, [F.col("rank").asc_nulls_last(), F.col("c_name")], "place").select("c_custkey", "place")


_KNOWN = "SELECT DISTINCT 'u' || user_id || '.example.com' AS domain FROM events WHERE user_id % 3 = 0"


@query(f"SELECT event_id, 'u' || user_id || '.example.com' AS domain FROM events WHERE event_type = 'signup' AND 'u' || user_id || '.example.com' IN ({_KNOWN})")
def manifest_tasks(spark, sf_dir):
    """J14."""
    tasks = V.table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", F.concat(F.lit("u"), "user_id", F.lit(".example.com")).alias("domain"))
    return experiment.known_tasks(tasks, V.sql(spark, sf_dir, _KNOWN)).select("event_id", "domain")


_DRAWS = queries_rows._U
#: One swap of a list of items, and the swaps of a shuffle of n items from the end, by its draws (i, u).
_SWAP = "lambda a, s: list_transform(range(len(a)), lambda k: CASE WHEN k = s[1] THEN a[s[2] + 1] WHEN k = s[2] THEN a[s[1] + 1] ELSE a[k + 1] END)"
_SWAPS = "list(CAST([n - i, floor(u * (n - i + 1))] AS BIGINT[]) ORDER BY i)"


@query(f"""WITH o AS (SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS item, count(*) OVER () AS n FROM (SELECT DISTINCT s_name FROM supplier)),
 d AS (SELECT i, u, (SELECT max(n) FROM o) AS n FROM {_DRAWS.format(seed=7, source="(SELECT unnest(range(1, (SELECT count(DISTINCT s_name) FROM supplier))) AS i)")}), l AS (SELECT list_reduce(list_prepend(range(any_value(n)), {_SWAPS}), {_SWAP}) AS items FROM d)
SELECT pos, lower(s_name) AS domain, CASE pos % 4 WHEN 0 THEN 'linked/canary' WHEN 1 THEN 'unlinked/canary' WHEN 2 THEN 'linked/control' ELSE 'unlinked/control' END AS cell FROM (SELECT unnest(items) AS item, unnest(range(len(items))) AS pos FROM l) JOIN o USING (item)""")
def cell_rotation(spark, sf_dir):
    """Cells in turn over a seeded shuffle of an experiment's own domains."""
    names = V.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("domain"), F.col("s_name").alias("pos"))
    return experiment.assigned(names, 7).select(F.col("place").alias("pos"), "domain", "cell")


_HOST_OF = r"lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"


@query(f"""SELECT {_HOST_OF} AS host, bool_or(page_id % 7 = 0) AS native, bool_or(page_id % 11 = 0) AS declarative, count(*) AS pages FROM pages GROUP BY 1""")
def page_flags(spark, sf_dir):
    """A33."""
    rows = V.table(spark, sf_dir, "pages").select(T.hostname(F.col("url")).alias("host"), F.col("page_id").alias("pos"), (F.col("page_id") % 7 == 0).alias("native"), (F.col("page_id") % 11 == 0).alias("declarative"))
    return pages.flags(rows, ["native", "declarative"])


_FEATURE = "CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'x-WebMCP' WHEN 2 THEN 'ModelContextApi' ELSE 'f' || page_id % 6 END"


@query(f"""SELECT host, feature, expiry, tokens FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN regexp_matches(feature, '(?i)webmcp|modelcontext') THEN 0 WHEN feature IS NOT NULL THEN 1 ELSE 2 END, page_id) AS n, count(*) OVER (PARTITION BY host) AS tokens
 FROM (SELECT {_HOST_OF} AS host, page_id, {_FEATURE} AS feature, 'e' || page_id AS expiry FROM pages)) WHERE n = 1""")
def preferred_tokens(spark, sf_dir):
    """A33, W6."""
    rows = V.sql(spark, sf_dir, f"SELECT url, page_id AS pos, {_FEATURE} AS feature, 'e' || page_id AS expiry FROM pages").withColumn("host", T.hostname(F.col("url")))
    return pages.preferred_token(rows)


# ---------------------------------------------------------------------------------------------------------------------
# hosts


@query("""WITH s AS (SELECT *, 's' || s_suppkey || '.example.com' AS host FROM supplier)
SELECT host, s_suppkey % 3 > 0 AS reachable, concat_ws(',', CASE WHEN s_suppkey % 2 = 0 THEN 'no_hsts_on_card' END, CASE WHEN s_suppkey % 3 = 0 THEN 'endpoint_unreachable' END, CASE WHEN s_suppkey % 5 = 0 THEN 'third_party_hosted:endpoint' END, CASE WHEN s_suppkey % 4 = 1 THEN 'prm_resource_mismatch' END,
  CASE WHEN s_suppkey % 4 IN (1, 3) THEN 'no_prm_for_endpoint' END, CASE WHEN s_suppkey % 4 = 0 THEN 'bearer_query_allowed' END, CASE WHEN s_suppkey % 4 IN (1, 3) THEN 'no_authorization_server_declared' END,
  CASE WHEN s_suppkey % 4 = 2 THEN 'auth_server_metadata_unresolved' END, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 3 = 1 THEN 'issuer_mismatch' END, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 7 = 0 THEN 'no_pkce_advertised' END, CASE WHEN s_suppkey % 4 IN (0, 2) THEN 'third_party_hosted:auth_server' END) AS notes FROM s""")
def hygiene_notes(spark, sf_dir):
    """Cards, their endpoints, resource documents and authorization servers, looked up by URL."""
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("s"), "s_suppkey", F.lit(".example.com")).alias("host"))
    k = F.col("k")
    site = F.concat(F.lit("https://api"), k, F.when(k % 5 == 0, ".example.org").otherwise(".example.com"))
    issuer = F.concat(F.lit("https://login"), k, F.lit(".example.net"))
    card = F.concat(F.lit('{"name":"n","remotes":[{"url":"'), site, F.lit('/mcp"}]}'))
    rows = s.select("host", F.lit("mcp_server_card").alias("source"), F.lit("mcp").alias("kind"), F.lit("sep-2127").alias("card_spec"), D.variant(card).alias("doc"), F.array().cast("array<string>").alias("reasons"), F.when(k % 2 == 1, "max-age=1").alias("hsts"), F.lit(None).cast("string").alias("cache_control"))
    no = F.lit(None).cast("string")
    prm = F.concat(F.lit('{"resource":"'), F.when(k % 4 == 1, "https://wrong.example.com").otherwise(site), F.lit('/mcp","authorization_servers":["'), issuer, F.lit('"],"bearer_methods_supported":["'), F.when(k % 4 == 0, "query").otherwise("header"), F.lit('"]}'))
    meta = F.concat(F.lit('{"issuer":"'), F.when(k % 3 == 1, "https://else.example.net").otherwise(issuer), F.lit('","code_challenge_methods_supported":["'), F.when(k % 7 == 0, "plain").otherwise("S256"), F.lit('"]}'))
    follow = s.select(F.concat(site, F.lit("/mcp")).alias("url"), F.when(k % 3 == 0, 404).otherwise(401).alias("status"), no.alias("error"), no.alias("body"))
    follow = follow.unionByName(s.filter("k % 4 <> 3").select(F.concat(site, F.lit("/.well-known/oauth-protected-resource/mcp")).alias("url"), F.lit(200).alias("status"), no.alias("error"), prm.alias("body")))
    follow = follow.unionByName(s.filter("k % 4 = 0").select(F.concat(issuer, F.lit("/.well-known/oauth-authorization-server")).alias("url"), F.lit(200).alias("status"), no.alias("error"), meta.alias("body")))
    return handshake.hygiene(rows, follow).select("host", F.col("endpoint.reachable").alias("reachable"), F.array_join("notes", ",").alias("notes"))


@query("""WITH t AS (SELECT s_suppkey AS k, 's' || s_suppkey || '.example.com' AS host FROM supplier)
SELECT host, 'mcp_card' AS source, 'https://e' || k % 5 || '.example.com/a' AS endpoint FROM t WHERE k % 4 = 0 UNION ALL SELECT host, 'mcp_card', NULL FROM t WHERE k % 4 = 1
 UNION ALL SELECT host, 'a2a_card', 'https://x.example.com/v1/MCP/' FROM t WHERE k % 4 < 2 UNION ALL SELECT host, 'a2a_card', 'https://e' || (k + 1) % 5 || '.example.com/a' FROM t WHERE k % 4 < 2 AND (k + 1) % 5 IN (SELECT k % 5 FROM t WHERE k % 4 = 0)""")
def handshake_targets(spark, sf_dir):
    """Endpoints of agents count if a tool server's card names them, too, or by the last part of their path."""
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k")
    entry = lambda kind, url: F.struct(F.lit(kind).alias("source"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("card_spec"), F.struct(url.alias("url")).alias("endpoint"))
    own = F.when(k % 4 == 0, entry("mcp", F.concat(F.lit("https://e"), k % 5, F.lit(".example.com/a"))))
    agents = [entry("a2a", F.lit("https://x.example.com/v1/MCP/")), entry("a2a", F.concat(F.lit("https://e"), (k + 1) % 5, F.lit(".example.com/a"))), entry("a2a", F.lit("https://x.example.com/mcp/v1"))]
    results = s.select(F.concat(F.lit("s"), "k", F.lit(".example.com")).alias("host"), k.cast("int").alias("rank"), F.when(k % 4 < 2, "/c").alias("mcp_card_path"), F.array_compact(F.array(own, *agents)).alias("hygiene"))
    return handshake.targets(results).select("host", "source", "endpoint")


_LONG = " ".join(f"word{chr(97 + k)}{chr(97 + j)}" for k in range(8) for j in range(6))


@query(f"""WITH c AS (SELECT c_custkey AS k, 'h' || c_custkey || '.example.com' AS host FROM customer), p AS (SELECT * FROM (VALUES ('/llms.txt'), ('/openapi.json'), ('/.well-known/security.txt'), ('/ai.txt')) v(path))
SELECT host, path, k % 4 = 0 OR (k % 4 = 1 AND path <> '/.well-known/security.txt' AND path <> '/ai.txt') AS soft404, k % 4 = 2 AND path <> '/ai.txt' AS valid,
 CASE k % 4 WHEN 0 THEN 'soft404:hash_near_dup' || CASE WHEN path IN ('/llms.txt', '/openapi.json') THEN ',soft404:html_content_type' ELSE '' END WHEN 1 THEN CASE WHEN path IN ('/llms.txt', '/openapi.json') THEN 'soft404:html_content_type' ELSE 'body_is_html' END
  WHEN 2 THEN CASE path WHEN '/.well-known/security.txt' THEN 'note:no_expires_field' WHEN '/ai.txt' THEN 'empty_body' ELSE '' END ELSE CASE WHEN path = '/ai.txt' THEN 'error:timeout' ELSE 'status:404' END END AS reasons FROM c, p""")
def probe_classes(spark, sf_dir):
    """Pages that answer everything alike, other pages, documents, failures; some bodies aren't UTF-8."""
    c = V.dealt(V.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("k"), F.concat(F.lit("h"), "c_custkey", F.lit(".example.com")).alias("host"))
    k, path = F.col("k"), F.col("path")
    page = F.concat(F.lit("<html><body>"), F.lit(_LONG), F.lit(" page "), path, F.lit("</body></html>"))
    other = F.concat(F.lit("<html><p>"), F.reverse(F.lit(_LONG)), F.lit("</p></html>"))
    good = F.when(path == "/llms.txt", "# Title\n- a").when(path == "/openapi.json", '{"openapi":"3.0.0","paths":{}}').when(path == "/.well-known/security.txt", "Contact: mailto:a@b.test").otherwise("")
    body = F.when(k % 4 == 0, page).when(k % 4 == 1, other).when(k % 4 == 2, good).otherwise("")
    # a byte that is no UTF-8 stands in the pages of some hosts
    raw = F.when((k % 4 < 2) & (k % 3 == 0), F.concat(body.cast("binary"), F.unhex(F.lit("FF")))).otherwise(body.cast("binary"))
    status = F.when(k % 4 < 3, 200).when(path == "/ai.txt", 0).otherwise(404)
    paths = spark.createDataFrame([("/llms.txt", "probe"), ("/openapi.json", "probe"), ("/.well-known/security.txt", "probe"), ("/ai.txt", "probe"), ("/nothing-here", "nx")], "path STRING, kind STRING")
    rows = c.join(F.broadcast(paths)).select(
        "host", F.lit("v").alias("vantage"), "kind", "path", F.concat(F.lit("https://"), "host", "path").alias("final_url"), F.when(path == "/nothing-here", F.when(k % 4 == 0, 200).otherwise(404)).otherwise(status).alias("status"), F.create_map().cast("map<string,string>").alias("headers"),
        F.when(k % 4 < 2, "text/html").otherwise("").alias("content_type"), raw.alias("body"), F.length(raw).cast("bigint").alias("bytes"), F.sha2(raw, 256).alias("sha256"), F.lit(0).alias("redirects"), F.lit(False).alias("cross_origin_hit"), F.lit(False).alias("www_redirect"),
        F.when((k % 4 == 3) & (path == "/ai.txt"), "timeout").alias("error"), F.lit(1).cast("bigint").alias("elapsed_ms"),
    )
    return classify.classify_probes(rows, S.probe_specs(spark)).select("host", "path", "soft404", "valid", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part), s AS (SELECT *, k % 5 <> 4 AS pair, k % 5 < 3 AS scored, CASE k % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 / 3 END AS j, CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS u, CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS t FROM p)
SELECT count(*) FILTER (WHERE pair) AS pairs, count(*) FILTER (WHERE pair) AS fetched, count(*) FILTER (WHERE k % 5 = 3) AS no_tools, 0::BIGINT AS no_ops, count(*) FILTER (WHERE scored) AS scored, median(j) FILTER (WHERE scored) AS median_loose, count(*) FILTER (WHERE j = 0) AS loose_zero, count(*) FILTER (WHERE j = 1) AS loose_one,
 sum(u)::BIGINT AS unmatched, sum(t)::BIGINT AS tools, count(*) FILTER (WHERE k % 2 = 0) AS coverage, count(*) FILTER (WHERE k % 4 = 0) AS link_openapi, count(*) FILTER (WHERE k % 6 = 0) AS link_card, count(*) FILTER (WHERE k % 4 = 0 OR k % 6 = 0) AS link_any FROM s""")
def consistency_rollup(spark, sf_dir):
    """Through the operators that match pairs and sum them up."""
    k = F.col("p_partkey")
    op = lambda name: F.struct(F.lit(name).alias("key"), F.lit(name).alias("operation_id"))
    names = F.when(k % 5 == 0, F.array(F.lit("get_user"))).when(k % 5 == 1, F.array(F.lit("zzz"))).when(k % 5 == 2, F.array(F.lit("fetchUser"), F.lit("other"))).otherwise(F.array().cast("array<string>"))
    ops = F.when(k % 5 == 2, F.array(op("getUser"), op("make things"))).otherwise(F.array(op("getUser")))
    links = F.struct(F.when(k % 4 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("openapi"), F.when(k % 6 == 0, F.array(F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("card"), F.array().cast("array<boolean>").alias("openapi_resolves"), F.array().cast("array<boolean>").alias("card_resolves"))
    rows = V.table(spark, sf_dir, "part").select(names.alias("tools"), ops.alias("ops"), (k % 5 != 4).alias("pair"), (k % 2 == 0).alias("coverage"), F.when(k % 2 == 0, links).alias("llms"))
    made = consistency.summary(consistency.match_pairs(rows))
    return made.select("pairs", "fetched", "no_tools", "no_ops", "scored", "median_loose", "loose_zero", "loose_one", "unmatched", "tools", "coverage", "link_openapi", "link_card", "link_any")


@query("""SELECT host, pair, coverage, CASE WHEN card THEN 'https://' || host || '/c' END AS card_url, CASE WHEN api THEN 'https://' || host || '/o' END AS openapi_url FROM (SELECT *, card AND api AS pair, llms AND (card OR api) AS coverage
 FROM (SELECT 'h' || c_custkey || '.example.com' AS host, c_custkey % 2 = 0 AS card, c_custkey % 3 = 0 AS api, c_custkey % 5 > 1 AS llms FROM customer)) WHERE pair OR coverage""")
def consistency_candidates(spark, sf_dir):
    """P19."""
    k = F.col("c_custkey")
    host = F.concat(F.lit("h"), k, F.lit(".example.com"))
    probe = lambda path, artifact, valid: F.struct(F.lit(path).alias("path"), F.lit(artifact).alias("artifact"), valid.alias("valid"), F.concat(F.lit("https://"), host, F.lit(path)).alias("final_url"), F.lit(None).cast("string").alias("card_spec"))
    rows = V.table(spark, sf_dir, "customer").select(host.alias("host"), k.cast("int").alias("rank"), F.array(probe("/c", "mcp_server_card", k % 2 == 0), probe("/o", "openapi_json", k % 3 == 0), probe("/l", "llms_txt", k % 5 > 1)).alias("probes"))
    return consistency.candidates(rows).select("host", "pair", "coverage", "card_url", "openapi_url")


_POOL = "(SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'hugo' WHEN 2 THEN 'unreachable' ELSE 'n' || c_nationkey END AS label FROM customer)"
_WANTED = f"(SELECT label, pool, CASE WHEN label = 'unknown' THEN 40 WHEN label = 'unreachable' OR pool < 20 THEN 0 ELSE 20 END AS want FROM (SELECT label, count(*) AS pool FROM {_POOL} GROUP BY 1))"


def _strata(spark, sf_dir):
    n = F.col("c_nationkey")
    label = F.when(n % 4 == 0, "unknown").when(n % 4 == 1, "hugo").when(n % 4 == 2, "unreachable").otherwise(F.concat(F.lit("n"), n))
    return sampling.stratified(V.table(spark, sf_dir, "customer").select("c_custkey", label.alias("predicted")), [F.col("c_custkey")])


@query(f"SELECT label, pool, least(pool, want)::BIGINT AS drawn FROM {_WANTED}")
def strata_table(spark, sf_dir):
    """The strata of all customers."""
    return _strata(spark, sf_dir)[1].select("label", "pool", F.col("drawn").cast("bigint").alias("drawn"))


#: Strata of up to 64 hosts, so that a shuffle of lists can say what is drawn.
_SMALL = "(SELECT c_custkey, 'n' || (c_custkey % 40 + 10) AS label FROM customer WHERE c_custkey % 40 < 25 OR c_nationkey < 3)"


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c_custkey) - 1 AS item FROM {_SMALL}), c AS (SELECT label, count(*) AS n FROM p GROUP BY label),
 s AS (SELECT *, coalesce(sum(CASE WHEN n >= 5 THEN n - 1 ELSE 0 END) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c),
 q AS (SELECT label, n, before, unnest(range(1, n)) AS i FROM s WHERE n >= 5), x AS {_DRAWS.format(seed=20261005, source="(SELECT unnest(range(1, (SELECT count(*) FROM customer) + 1)) AS i)")},
 l AS (SELECT label, list_reduce(list_prepend(range(any_value(n)), {_SWAPS}), {_SWAP})[1:5] AS items FROM (SELECT label, n, q.i, x.u FROM q JOIN x ON x.i = before + q.i) GROUP BY label)
SELECT label, c_custkey FROM (SELECT label, unnest(items) AS item FROM l) JOIN p USING (label, item)""")
def strata_sample(spark, sf_dir):
    """The hosts that are drawn, by one stream of draws over all strata."""
    rows = V.view(spark, sf_dir, _SMALL).withColumnRenamed("label", "predicted")
    return sampling.stratified(rows, [F.col("c_custkey")], per_label=5)[0].select(F.col("predicted").alias("label"), "c_custkey")


@query("""SELECT artifact, count(*) FILTER (WHERE valid) AS valid FROM (SELECT artifact, valid FROM {P}) GROUP BY 1""".replace("{P}", V.probes() + " p"))
def probes_in_long_form(spark, sf_dir):
    """A2 on rows of probes, as a release or a warehouse holds them: no nesting, one aggregate."""
    return summary.valid_by_artifact(V.view(spark, sf_dir, V.probes()))
