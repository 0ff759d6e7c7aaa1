"""Queries on host results, snapshots, cards and pages, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnfield import schemas as S
from cairnfield.functions import documents as D
from cairnfield.functions import hosts as H
from cairnfield.functions import http as W
from cairnfield.functions import stats
from cairnfield.functions import text as T
from cairnfield.operators import cards, classify, fingerprint, handshake, lookups, pages, summary, validate
from cairnfield.plans import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


P0, P1, H0, H1 = V.probes(), V.probes(5), V.hosts(), V.hosts(5)
CARDS = ", ".join(f"'{x}'" for x in S.CARDS)
MCP = ", ".join(f"'{x}'" for x in S.MCP_CARDS)


def _wilson(k: str, n: str) -> tuple[str, str]:
    p = f"({k}::DOUBLE / {n})"
    half = f"1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4 * {n}::DOUBLE * {n}))"
    return tuple(f"CASE WHEN {n} > 0 THEN round(({p} + 3.8416 / (2 * {n}) {s} {half}) / (1 + 3.8416 / {n}), 9) ELSE 0 END" for s in "-+")  # type: ignore[return-value]


_LO, _HI = _wilson("valid_reachable", "reachable")


@query(f"""WITH p AS (SELECT p.*, h.host_class FROM {P0} p JOIN {H0} h USING (host)),
 n AS (SELECT count(*) AS hosts, count(*) FILTER (WHERE host_class = 'reachable') AS reachable FROM {H0} h),
 c AS (SELECT path, count(*) FILTER (WHERE valid) AS valid_all, count(*) FILTER (WHERE valid AND host_class = 'reachable') AS valid_reachable, count(*) FILTER (WHERE status = 200) AS status_200,
  count(*) FILTER (WHERE soft404) AS soft404, count(*) FILTER (WHERE status = 200 AND NOT soft404 AND NOT valid) AS invalid, count(*) FILTER (WHERE cross_origin_hit) AS cross_origin, count(*) FILTER (WHERE www_redirect) AS www,
  count(*) FILTER (WHERE soft404 AND pos % 2 = 0) AS near_dup, count(*) FILTER (WHERE soft404 AND pos % 2 = 1) AS html_type FROM p GROUP BY path)
SELECT c.*, hosts, reachable, {_LO} AS wilson_low, {_HI} AS wilson_high FROM c, n""")
def prevalence(spark, sf_dir):
    """A2, A3, A14."""
    rows = summary.prevalence(V.results(spark, sf_dir), S.probe_specs(spark)).drop("pos", "artifact")
    return rows.withColumns({c: F.round(c, 9) for c in ("wilson_low", "wilson_high")})


@query(f"SELECT host_class, count(*) AS hosts FROM {H0} h GROUP BY 1")
def host_class_hist(spark, sf_dir):
    """P1, A1."""
    return summary.class_counts(V.results(spark, sf_dir))


_FLAGS = f"""f AS (SELECT host, bool_or(valid) AS any_valid, bool_or(valid AND artifact IN ({CARDS})) AS any_card, bool_or(valid AND path = '/llms.txt') AS llms,
 bool_or(valid AND artifact LIKE 'openapi%') AS openapi, bool_or(valid AND artifact IN ('oauth_protected_resource', 'oauth_authorization_server', 'openid_configuration')) AS oauth FROM {P0} p GROUP BY host)"""


@query(f"""WITH {_FLAGS} SELECT platform, count(*) AS hosts, count(*) FILTER (WHERE llms) AS llms, count(*) FILTER (WHERE openapi) AS openapi, count(*) FILTER (WHERE any_card) AS cards,
 count(*) FILTER (WHERE oauth) AS oauth, count(*) FILTER (WHERE is_blocked) AS blocked FROM {H0} h JOIN f USING (host) GROUP BY 1""")
def platform_breakdown(spark, sf_dir):
    """A6."""
    return summary.platform_table(V.results(spark, sf_dir))


@query(f"WITH {_FLAGS} SELECT count(*) AS reachable, count(*) FILTER (WHERE any_valid) AS any_valid, count(*) FILTER (WHERE any_card) AS any_card FROM {H0} h JOIN f USING (host) WHERE host_class = 'reachable'")
def any_valid_hosts(spark, sf_dir):
    """A5."""
    return summary.any_valid(V.results(spark, sf_dir))


@query(f"""WITH c AS (SELECT host, min_by(path, pos) AS path FROM {P0} p WHERE valid AND artifact IN ({MCP}) GROUP BY host),
 r AS (SELECT 'cdn' AS kind, coalesce(cdn, 'none') AS label FROM {H0} h UNION ALL SELECT 'platform', platform FROM {H0} h UNION ALL SELECT 'hint', 'framer' FROM {H0} h WHERE c_custkey % 5 = 0
 UNION ALL SELECT 'card_path', path FROM {H0} h JOIN c USING (host) WHERE host_class = 'reachable'
 UNION ALL SELECT 'card_spec', CASE WHEN p.c_custkey % 2 = 0 THEN 'sep-2127' ELSE 'sep-1649' END FROM {P0} p JOIN {H0} h USING (host) WHERE host_class = 'reachable' AND valid AND artifact IN ({MCP}))
SELECT kind, label, count(*) AS n FROM r GROUP BY ALL""")
def label_hist(spark, sf_dir):
    """A4, A7, A13."""
    return summary.label_counts(V.results(spark, sf_dir))


@query(f"SELECT a.host_class AS class_a, b.host_class AS class_b, count(*) AS hosts FROM {H0} a JOIN {H1} b USING (host) GROUP BY ALL")
def vantage_matrix(spark, sf_dir):
    """J1, A8."""
    return summary.class_matrix(V.results(spark, sf_dir), V.results(spark, sf_dir, 5))


@query(f"SELECT host, CASE WHEN a.host_class = 'blocked' THEN 'a' ELSE 'b' END AS blocked_at FROM {H0} a JOIN {H1} b USING (host) WHERE (a.host_class = 'blocked') <> (b.host_class = 'blocked')")
def vantage_blocked_once(spark, sf_dir):
    """U3."""
    return summary.blocked_once(V.results(spark, sf_dir), V.results(spark, sf_dir, 5))


_REACH = f"r AS (SELECT host FROM {H0} a JOIN {H1} b USING (host) WHERE a.host_class = 'reachable' AND b.host_class = 'reachable')"


@query(f"""WITH {_REACH}, x AS (SELECT path, p.valid AS a, q.valid AS b FROM {P0} p JOIN {P1} q USING (host, path) JOIN r USING (host))
SELECT path, count(*) FILTER (WHERE a AND b) AS both_valid, count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE b AND NOT a) AS b_only, count(*) FILTER (WHERE NOT a AND NOT b) AS neither,
 count(*) FILTER (WHERE a = b)::DOUBLE / count(*) AS agreement, count(*) FILTER (WHERE a OR b) AS union_valid FROM x GROUP BY path""")
def vantage_paths(spark, sf_dir):
    """A9."""
    return summary.path_agreement(V.results(spark, sf_dir), V.results(spark, sf_dir, 5), S.probe_specs(spark))


@query(f"""WITH {_REACH}, x AS (SELECT host, bool_or(p.valid AND path <> '{S.SECURITY_PATH}') AS a, bool_or(q.valid AND path <> '{S.SECURITY_PATH}') AS b,
 count(*) FILTER (WHERE split_part(p.final_url, '/', 3) <> split_part(q.final_url, '/', 3)) AS d FROM {P0} p JOIN {P1} q USING (host, path) JOIN r USING (host) GROUP BY host)
SELECT count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE b) AS b, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a OR b) AS "any", coalesce(sum(d), 0)::BIGINT AS cross_origin_disagreements FROM x""")
def vantage_any(spark, sf_dir):
    """A10, J2, F28."""
    return summary.any_artifact(V.results(spark, sf_dir), V.results(spark, sf_dir, 5))


def _outcomes(spark, sf_dir):
    p = V.view(spark, sf_dir, V.probes(), "c_custkey")
    none = F.lit(False)
    return p.select("host", (F.col("pos") + 2).alias("seq"), "status", "error", ((F.col("c_custkey") % 6 == 0) & (F.col("pos") > 4)).alias("challenge")).unionByName(
        p.filter("pos < 2").select("host", F.col("pos").alias("seq"), F.when(F.col("c_custkey") % 6 == 1, 403).otherwise(F.col("status")).alias("status"), "error", none.alias("challenge"))
    )


@query(f"""WITH o AS (SELECT host, pos + 2 AS seq, status, error, c_custkey % 6 = 0 AND pos > 4 AS challenge FROM {P0} p
  UNION ALL SELECT host, pos, CASE WHEN c_custkey % 6 = 1 THEN 403 ELSE status END, error, false FROM {P0} p WHERE pos < 2),
 k AS (SELECT host, seq, CASE WHEN challenge THEN 'challenge' WHEN status = 0 THEN coalesce(error, 'error') ELSE status::VARCHAR END AS key FROM o),
 c AS (SELECT host, key, count(*) AS n, min(seq) AS first FROM k GROUP BY ALL),
 t AS (SELECT host, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE key IN ('403', '429', 'challenge', 'reset')), 0)::BIGINT AS signals, coalesce(sum(n) FILTER (WHERE key = 'timeout'), 0)::BIGINT AS dead FROM c GROUP BY host),
 b AS (SELECT host, key FROM c WHERE key IN ('403', '429', 'challenge', 'reset') QUALIFY row_number() OVER (PARTITION BY host ORDER BY n DESC, CASE key WHEN '403' THEN -2 WHEN '429' THEN -1 ELSE first END) = 1)
SELECT host, signals * 2 > total AS is_blocked, CASE WHEN signals * 2 > total THEN b.key || ' on ' || signals || '/' || total || ' probes' WHEN dead * 2 > total THEN 'unreachable:timeout on ' || dead || '/' || total || ' probes' END AS reason
FROM t LEFT JOIN b USING (host)""")
def blocked_rule(spark, sf_dir):
    """A11, O4."""
    return classify.blocked(_outcomes(spark, sf_dir)).select("host", F.col("blocked.blocked").alias("is_blocked"), F.col("blocked.reason").alias("reason"))


@query(f"SELECT host, bool_and(c_custkey % 9 = 0 OR (c_custkey % 9 = 1 AND pos > 0)) AS redirect_only FROM {P0} p GROUP BY host")
def redirect_only_hosts(spark, sf_dir):
    """Hosts of which all, all but one, or none of the requests leave the site."""
    p = V.view(spark, sf_dir, V.probes(), "c_custkey")
    away = (F.col("c_custkey") % 9 == 0) | ((F.col("c_custkey") % 9 == 1) & (F.col("pos") > 0))
    return classify.redirect_only(p.select("host", F.col("pos").alias("seq"), F.when(away, 302).otherwise(200).alias("status"), F.when(away, "cross_domain_redirect").alias("error"), F.lit(False).alias("challenge")))


@query(f"SELECT host, min_by(path, pos) AS mcp_card_path FROM {P0} p WHERE valid AND artifact IN ({MCP}) GROUP BY host")
def first_valid_card(spark, sf_dir):
    """A13, W6."""
    return classify.first_valid_card(V.view(spark, sf_dir, V.probes()))


# ---------------------------------------------------------------------------------------------------------------------
# pages

_SERVER = "CASE page_id % 7 WHEN 0 THEN 'nginx/1.2' WHEN 1 THEN 'Apache' WHEN 2 THEN 'cloudflare' WHEN 3 THEN 'Vercel' WHEN 4 THEN 'Netlify' WHEN 5 THEN 'AkamaiGHost' ELSE 'x' END"


_HTML_MARK = "CASE page_id % 5 WHEN 0 THEN '<script src=\"/_next/static/a.js\">' WHEN 1 THEN '<link href=\"/wp-content/x.css\">' WHEN 2 THEN '<meta name=\"generator\" content=\"Hugo 0.1\">' ELSE '' END"


@query("""WITH s AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'nextjs' WHEN 1 THEN 'wordpress' WHEN 2 THEN 'hugo' END AS mark, CASE page_id % 7 WHEN 0 THEN 'nginx' WHEN 1 THEN 'apache' WHEN 3 THEN 'vercel' WHEN 4 THEN 'netlify' END AS server,
  CASE page_id % 7 WHEN 2 THEN 'cloudflare' WHEN 5 THEN 'akamai' END AS cdn FROM pages)
SELECT page_id, coalesce(mark, server, 'unknown') AS platform, cdn, ((mark IS NOT NULL)::INT + (server IS NOT NULL OR cdn IS NOT NULL)::INT)::INT AS signals FROM s""")
def page_fingerprint(spark, sf_dir):
    """Marks in pages and generators stand before the server's header."""
    rows = V.table(spark, sf_dir, "pages").select("page_id", F.concat("page_id", F.lit(".example.com")).alias("host"), F.lit(200).alias("status"), F.col("url").alias("final_url"), F.lit(None).cast("string").alias("error"), F.create_map(F.lit("server"), F.expr(_SERVER)).alias("headers"), F.concat(F.expr(_HTML_MARK), "html").alias("text"))
    fp = fingerprint.fingerprints(rows)
    return fp.select(F.regexp_extract("host", "^[0-9]+", 0).cast("bigint").alias("page_id"), F.col("fingerprint.primary").alias("platform"), "fingerprint.cdn", F.size("fingerprint.signals").alias("signals"))


_HOST = r"lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"


@query(f"SELECT page_id, CASE page_id % 5 WHEN 3 THEN NULL ELSE {_HOST} END AS host, CASE page_id % 5 WHEN 0 THEN page_id + 1 END::INT AS rank FROM pages")
def parse_hosts(spark, sf_dir):
    """URLs, `rank,host` lines, comments."""
    host, rank = H.host_line(F.when(F.col("page_id") % 5 == 0, F.concat(F.col("page_id") + 1, F.lit(","), F.regexp_extract("url", "^https?://([^/:?#]+)", 1))).when(F.col("page_id") % 5 == 3, F.concat(F.lit("# "), "url")).otherwise(F.col("url")))
    return V.table(spark, sf_dir, "pages").select("page_id", host.alias("host"), rank.alias("rank"))


@query(f"SELECT host, page_id FROM (SELECT {_HOST} AS host, page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def host_dedupe_first(spark, sf_dir):
    """W1, S2."""
    host, _ = H.host_line(F.col("url"))
    return classify.dedupe(V.table(spark, sf_dir, "pages").select(host.alias("host"), "page_id"), ["host"], [F.col("page_id")])


@query(f"SELECT host, page_id FROM (SELECT {_HOST} AS host, page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id DESC) AS n FROM pages) WHERE n = 1")
def host_dedupe_last(spark, sf_dir):
    """W2, S8."""
    host, _ = H.host_line(F.col("url"))
    return classify.dedupe(V.table(spark, sf_dir, "pages").select(host.alias("host"), "page_id"), ["host"], [F.desc("page_id")])


@query(f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages) SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS registrable_domain FROM h""")
def registrable_domains(spark, sf_dir):
    """F7, F8."""
    host, _ = H.host_line(F.col("url"))
    return H.registrable_join(V.table(spark, sf_dir, "pages").select(host.alias("host")).distinct(), H.suffix_table(spark))


@query(f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), r AS (SELECT h.host, min(page_id)::INT AS rank FROM (SELECT {_HOST} AS host, page_id FROM pages WHERE page_id % 3 = 0) h GROUP BY ALL
 UNION ALL SELECT * FROM (VALUES ('example.com', 7), ('example.net', 9)) v)
SELECT h.host, coalesce(a.rank, b.rank)::INT AS rank FROM h LEFT JOIN r a USING (host) LEFT JOIN r b ON b.host = array_to_string(string_split(h.host, '.')[-2:], '.') AND b.host <> h.host""")
def registrable_rank_lookup(spark, sf_dir):
    """J4."""
    host, _ = H.host_line(F.col("url"))
    pages = V.table(spark, sf_dir, "pages").select(host.alias("host"), "page_id")
    ranks = pages.filter("page_id % 3 = 0").groupBy("host").agg(F.min("page_id").cast("int").alias("rank")).unionByName(spark.createDataFrame([("example.com", 7), ("example.net", 9)], "host STRING, rank INT"))
    return lookups.rank_for(pages.select("host").distinct(), ranks, H.registrable(F.col("host")))


#: Marks that the table's pages lack, by page number: a generator in either order of attributes, and assets of several domains.
_MARKED = """replace(html, '</title>', '</title>' || CASE page_id % 4 WHEN 0 THEN '<meta name="generator" content="Hugo 0.' || page_id || '">' WHEN 1 THEN '<META content=''Ghost 5'' name=''generator''>' ELSE '' END
 || CASE WHEN page_id % 3 = 0 THEN '<script src="https://cdn.shop.example.net/a.js"></script><img src="//Img.example.org/x.png"><link rel=icon href="https://a.example.org/i.ico">' ELSE '' END
 || CASE WHEN page_id % 3 = 1 THEN '<iframe src="http://one.example.edu/"></iframe>' ELSE '' END)"""


@query(f"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]{{0,300}})</title>', 1), '\\s+', ' ', 'g')) AS title, CASE page_id % 4 WHEN 0 THEN 'Hugo 0.' || page_id WHEN 1 THEN 'Ghost 5' END AS generator,
 CASE page_id % 3 WHEN 0 THEN 'cdn.shop.example.net,img.example.org,a.example.org' WHEN 1 THEN 'one.example.edu' ELSE '' END AS assets FROM pages""")
def page_evidence(spark, sf_dir):
    """F30, F15."""
    html = F.col("h")
    return V.sql(spark, sf_dir, f"SELECT page_id, {_MARKED} AS h FROM pages").select("page_id", W.title(html).alias("title"), W.generator(html).alias("generator"), F.array_join(W.asset_hosts(html), ",").alias("assets"))


@query(f"""WITH d AS (SELECT page_id, array_to_string(string_split({_HOST}, '.')[-2:], '.') AS own, 'example.org' AS domain, 2 AS n FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, array_to_string(string_split({_HOST}, '.')[-2:], '.'), 'example.net', 1 FROM pages WHERE page_id % 3 = 0
 UNION ALL SELECT page_id, array_to_string(string_split({_HOST}, '.')[-2:], '.'), 'example.edu', 1 FROM pages WHERE page_id % 3 = 1)
SELECT page_id, domain, n, row_number() OVER (PARTITION BY page_id ORDER BY n DESC)::INT AS nth FROM d WHERE domain <> own""")
def asset_domains(spark, sf_dir):
    """The page's own domain left out, the most frequent first."""
    host, _ = H.host_line(F.col("url"))
    rows = V.sql(spark, sf_dir, f"SELECT page_id, url, {_MARKED} AS html FROM pages").select("page_id", host.alias("host"), "html")
    return pages.asset_domains(rows, key="page_id").select("page_id", "domain", "n", "nth")


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS href FROM pages), d AS (SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL)
SELECT href, count(*) AS pages, sum(n)::BIGINT AS links FROM d WHERE NOT regexp_matches(href, '(?i)\.(png|css|js|json|xml|pdf|txt)(\?|#|$)') GROUP BY href""")
def link_hist(spark, sf_dir):
    """F23, P23."""
    links = V.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), F.lit(1))).alias("href"))
    return links.filter(~W.is_asset(F.col("href"))).groupBy("page_id", "href").agg(F.count("*").alias("n")).groupBy("href").agg(F.count("*").alias("pages"), F.sum("n").alias("links"))


_LINKS = "regexp_extract_all({part}, '<a href=\"([^\"]+)\"', 1)"
_MENU = "regexp_extract(html, '(?s)<nav.*?</nav>', 0)"


@query(f"""WITH l AS (SELECT page_id, {_HOST} AS host, url, unnest({_LINKS.format(part=_MENU)}) AS href, generate_subscripts({_LINKS.format(part=_MENU)}, 1) AS pos, 0 AS rest FROM pages
 UNION ALL SELECT page_id, {_HOST}, url, unnest({_LINKS.format(part=f"replace(html, {_MENU}, '')")}), generate_subscripts({_LINKS.format(part=f"replace(html, {_MENU}, '')")}, 1), 1 FROM pages),
 r AS (SELECT *, CASE WHEN href LIKE 'http%' THEN href ELSE regexp_extract(url, '^(https?://[^/]+)', 1) || href END AS link FROM l WHERE href LIKE '/%' OR href LIKE 'http%'),
 g AS (SELECT page_id, regexp_replace(link, '#.*$', '') AS link, min(rest * 100000 + pos) AS place FROM r WHERE NOT regexp_matches(lower(href), '[.](png|css|js|json|xml|pdf|txt|zip|gz)$') AND regexp_replace(link, '#.*$', '') <> regexp_replace(url, '#.*$', '')
  AND array_to_string(string_split(lower(regexp_extract(link, '^https?://([^/:?#]+)', 1)), '.')[-2:], '.') = array_to_string(string_split(host, '.')[-2:], '.') GROUP BY ALL)
SELECT page_id, link, n::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS n FROM g) WHERE n <= 5""")
def link_pick(spark, sf_dir):
    """Five links of each page, those of the menu first."""
    rows = V.table(spark, sf_dir, "pages").select("page_id", "url", pages.candidates(F.col("html")).alias("links"))
    return pages.pick_links(rows, 5)


# ---------------------------------------------------------------------------------------------------------------------
# documents and handshakes

_CARD = """CASE s_suppkey % 6 WHEN 0 THEN '{"name":"com.example/s' || s_suppkey || '","remotes":[{"type":"sse","url":"https://s' || s_suppkey || '.example.com/mcp"}]}'
 WHEN 1 THEN '{"name":"tool ' || s_suppkey || '","url":"https://s.example.com/","tools":["a","b"]}' WHEN 2 THEN '{"name":"","url":"x"}' WHEN 3 THEN '[1,2]' WHEN 4 THEN '{broken' ELSE '{"title":"none"}' END"""


@query("""SELECT s_suppkey, s_suppkey % 6 IN (0, 1) AS valid, CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'note:legacy_shape_at_current_path' WHEN 2 THEN 'schema:minLength:/name' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'json_parse_error' ELSE 'schema:required:name,schema:anyOf' END AS reasons,
 CASE s_suppkey % 6 WHEN 0 THEN 'sep-2127' WHEN 1 THEN 'sep-1649' WHEN 2 THEN 'sep-1649' WHEN 5 THEN 'unknown' END AS card_spec, CASE s_suppkey % 6 WHEN 0 THEN 'https://s' || s_suppkey || '.example.com/mcp' WHEN 1 THEN 'https://s.example.com/' WHEN 2 THEN 'x' END AS endpoint,
 CASE WHEN s_suppkey % 6 = 1 THEN 2 ELSE 0 END AS tools FROM supplier""")
def card_validation(spark, sf_dir):
    """P8, P11, F11, F17."""
    text = F.expr(_CARD)
    rows = V.table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"), F.lit("mcp_server_card").alias("artifact"), F.lit("json").alias("kind"), F.lit("/.well-known/mcp-server-card").alias("path"), F.lit("application/json").alias("content_type"), F.lit("https://s.example.com/.well-known/mcp-server-card").alias("final_url"), F.lit(True).alias("checked"))
    out = validate.with_outcome(rows).withColumn("doc", D.variant(F.col("text")))
    return out.select("s_suppkey", "outcome.valid", F.array_join("outcome.reasons", ",").alias("reasons"), "outcome.card_spec", cards.endpoint(F.col("doc")).alias("endpoint"), F.size(cards.card_tools(F.col("doc"))).alias("tools"))


_MD = "CASE WHEN doc_id % 4 = 0 THEN '# Title' || chr(10) || coalesce(text, '') WHEN doc_id % 4 = 1 THEN coalesce(text, '') || chr(10) || '## Part one' WHEN doc_id % 4 = 2 THEN '<!DOCTYPE html><p>' || coalesce(text, '') ELSE coalesce(text, '') END"


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '# Title' || chr(10) || coalesce(text, '') WHEN doc_id % 4 = 1 THEN coalesce(text, '') || chr(10) || '## Part one' WHEN doc_id % 4 = 2 THEN '<!DOCTYPE html><p>' || coalesce(text, '') ELSE coalesce(text, '') END AS t FROM documents),
 f AS (SELECT doc_id, doc_id % 4 = 2 AS html, regexp_matches(t, '(^|\n)\s{0,3}#{1,6}\s+\S') OR regexp_matches(t, '(^|\n)\S[^\n]*\n(=+|-{3,})\s*(\n|$)') AS head, doc_id % 4 = 0 AS top FROM t)
SELECT doc_id, head AND NOT html AS valid, concat_ws(',', CASE WHEN html THEN 'body_is_html' END, CASE WHEN NOT head THEN 'no_markdown_heading' END, CASE WHEN NOT top THEN 'note:h1_not_first' END) AS reasons FROM f""")
def markdown_validity(spark, sf_dir):
    """P7."""
    rows = V.table(spark, sf_dir, "documents").select("doc_id", F.expr(_MD).alias("t"))
    return rows.select("doc_id", validate.markdown(F.col("t"), F.lit("text/markdown")).alias("o")).select("doc_id", "o.valid", F.array_join("o.reasons", ",").alias("reasons"))


_STATUS = "CASE o_orderkey % 9 WHEN 0 THEN 401 WHEN 1 THEN 200 WHEN 2 THEN 200 WHEN 3 THEN 200 WHEN 4 THEN 403 WHEN 5 THEN 404 WHEN 6 THEN 500 WHEN 7 THEN 302 ELSE 0 END"


@query("""SELECT CASE o_orderkey % 9 WHEN 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'challenge_401' ELSE 'challenge_401_no_header' END WHEN 1 THEN 'no_challenge_200' WHEN 2 THEN 'jsonrpc_error_200' WHEN 3 THEN 'not_mcp' WHEN 4 THEN 'forbidden_403'
 WHEN 5 THEN CASE WHEN o_custkey % 2 = 0 THEN 'modern_no_initialize' ELSE 'error_4xx' END WHEN 6 THEN 'error_5xx' WHEN 7 THEN 'redirect_3xx' ELSE 'unreachable' END AS classification,
 CASE o_orderkey % 9 WHEN 1 THEN 'sse' WHEN 2 THEN 'json' WHEN 3 THEN 'html' WHEN 5 THEN CASE WHEN o_custkey % 2 = 0 THEN 'json' ELSE 'empty' END ELSE 'empty' END AS body_kind,
 CASE WHEN o_orderkey % 9 = 0 AND o_custkey % 2 = 0 THEN 'https://a.example.com/m' END AS resource_metadata, count(*) AS n FROM orders GROUP BY ALL""")
def handshake_classes(spark, sf_dir):
    """P13, P14, P15, F24."""
    error = '{"jsonrpc":"2.0","error":{"code":-32600,"message":"no"}}'
    k = F.col("o_orderkey") % 9
    text = F.when(k == 1, 'event: m\ndata: {"jsonrpc":"2.0","result":{"protocolVersion":"1","capabilities":{"tools":{}}}}\n\n').when((k == 2) | ((k == 5) & (F.col("o_custkey") % 2 == 0)), error).when(k == 3, "<html>x</html>").otherwise("")
    kind = F.when(k == 1, "text/event-stream").when(k == 3, "text/html").otherwise("application/json")
    www = F.when((k == 0) & (F.col("o_custkey") % 2 == 0), F.create_map(F.lit("www-authenticate"), F.lit('Basic realm=x, Bearer resource_metadata="https://a.example.com/m"'))).otherwise(F.create_map().cast("map<string,string>"))
    rows = V.table(spark, sf_dir, "orders").select(F.expr(_STATUS).alias("status"), www.alias("headers"), kind.alias("content_type"), text.alias("text"))
    return handshake.answers(rows).groupBy("classification", "body_kind", F.col("www_authenticate.resource_metadata").alias("resource_metadata")).agg(F.count("*").alias("n"))


def _hygiene_results(spark, sf_dir):
    """Results whose hygiene follows from the supplier's key; nation 3 is the rolled-up platform."""
    s = V.table(spark, sf_dir, "supplier").withColumn("host", F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(".example.com")))
    k = F.col("s_suppkey")
    notes = F.array_compact(F.array(F.when(k % 3 == 0, "endpoint_unreachable"), F.when(k % 5 == 0, "no_endpoint_url_in_card"), F.when(k % 7 == 0, "prm_resource_mismatch")))
    endpoint = F.struct(F.concat(F.lit("https://"), "host", F.lit("/mcp")).alias("url"), F.lit(True).alias("https"), F.lit(404).alias("status"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("reachable"))
    server = F.struct(F.lit("https://login.example.org").alias("issuer"), F.lit("https://login.example.org/m").alias("metadata_url"), F.lit(200).alias("status"), F.lit(True).alias("resolves"), (k % 4 != 0).alias("issuer_match"), (k % 11 != 0).alias("pkce_advertised"))
    lookup = F.array().cast("array<struct<url:string,status:int>>")
    entry = F.struct(F.lit("mcp_server_card").alias("source"), F.lit("mcp").alias("kind"), endpoint.alias("endpoint"), notes.alias("notes"), F.array(server).alias("authorization_servers"), lookup.alias("prm_lookups"))
    fp = F.struct(F.when(F.col("s_nationkey") == 3, "shopify").otherwise("unknown").alias("primary"), F.array().cast("array<string>").alias("platforms"))
    return s.select("host", F.when(k % 2 == 0, k.cast("int")).alias("rank"), fp.alias("fingerprint"), F.array(entry).alias("hygiene"))


_FOUND = """s AS (SELECT *, 's' || s_suppkey || '.example.com' AS host FROM supplier), f AS (
 SELECT host, s_suppkey, s_nationkey, 'dead_card_endpoint' AS finding FROM s WHERE s_suppkey % 3 = 0 UNION ALL SELECT host, s_suppkey, s_nationkey, 'card_without_endpoint' FROM s WHERE s_suppkey % 5 = 0
 UNION ALL SELECT host, s_suppkey, s_nationkey, 'prm_resource_mismatch' FROM s WHERE s_suppkey % 7 = 0 UNION ALL SELECT host, s_suppkey, s_nationkey, 'prm_issuer_mismatch' FROM s WHERE s_suppkey % 4 = 0
 UNION ALL SELECT host, s_suppkey, s_nationkey, 'no_pkce_advertised' FROM s WHERE s_suppkey % 11 = 0 UNION ALL SELECT host, s_suppkey, s_nationkey, 'no_challenge_200' FROM s WHERE s_suppkey % 6 = 1)"""


def _findings(spark, sf_dir):
    results = _hygiene_results(spark, sf_dir)
    shakes = V.table(spark, sf_dir, "supplier").filter("s_suppkey % 6 = 1").select(
        F.concat(F.lit("s"), "s_suppkey", F.lit(".example.com")).alias("host"), F.lit(None).cast("int").alias("rank"), F.lit("https://x/mcp").alias("endpoint"), F.lit(200).alias("status"), F.lit("json").alias("body_kind"),
        F.struct(F.struct(F.lit("n").alias("name"), F.lit("1").alias("version")).alias("server_info")).alias("result"), F.lit(False).alias("mcp_session_id_present"), F.lit("no_challenge_200").alias("classification"),
    )
    return handshake.findings(results, shakes)


@query(f"""WITH {_FOUND} SELECT host, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END::INT AS rank, finding, CASE finding WHEN 'no_challenge_200' THEN 'medium' WHEN 'card_without_endpoint' THEN 'info' ELSE 'low' END AS severity FROM f WHERE s_nationkey <> 3
 UNION ALL SELECT DISTINCT 'shopify-platform-pattern', NULL::INT, 'shopify-platform-pattern', 'info' FROM f WHERE s_nationkey = 3""")
def findings_union(spark, sf_dir):
    """P16, P17, P18, U5, O1, J8."""
    return _findings(spark, sf_dir).select("host", "rank", "finding", "severity")


@query(f"""WITH {_FOUND}, c AS (SELECT finding, count(*) AS n FROM f WHERE s_nationkey = 3 GROUP BY 1)
SELECT (SELECT count(DISTINCT host) FROM f WHERE s_nationkey = 3) || ' storefront hosts; ' || string_agg(finding || '=' || n, ', ' ORDER BY finding || '=' || n) AS evidence FROM c HAVING count(*) > 0""")
def findings_rollup(spark, sf_dir):
    """A21."""
    return _findings(spark, sf_dir).filter("finding = 'shopify-platform-pattern'").select("evidence")


@query(f"WITH {_FOUND} SELECT finding, count(*) AS n, count(DISTINCT host) AS hosts FROM f WHERE s_nationkey <> 3 GROUP BY 1")
def finding_counts(spark, sf_dir):
    """A20."""
    return handshake.finding_counts(_findings(spark, sf_dir).filter("finding <> 'shopify-platform-pattern'"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN (props->'$.k') IS NULL THEN 'absent' ELSE 'BIGINT' END AS kind FROM events")
def json_projection(spark, sf_dir):
    """P8, F11."""
    doc = D.variant(F.col("props"))
    return V.table(spark, sf_dir, "events").select("event_id", D.number(doc, "$.k").cast("bigint").alias("k"), F.coalesce(D.kind(doc, "$.k"), F.lit("absent")).alias("kind"))


@query("""SELECT measure, value, count(*) AS n FROM (SELECT 'generation' AS measure, CASE WHEN s_suppkey % 3 = 0 THEN 'v1' WHEN s_suppkey % 3 = 1 THEN 'v03' ELSE 'legacy' END AS value FROM supplier
 UNION ALL SELECT 'transport', CASE WHEN s_suppkey % 3 = 0 THEN 'HTTP+JSON' WHEN s_suppkey % 3 = 1 THEN 'GRPC' ELSE 'JSONRPC' END FROM supplier UNION ALL SELECT 'protocol_version', CASE WHEN s_suppkey % 2 = 0 THEN '1.0' ELSE '(absent)' END FROM supplier
 UNION ALL SELECT 'flag', 'streaming' FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'flag', 'no_security_scheme' FROM supplier UNION ALL SELECT 'flag', 'no_skills' FROM supplier) GROUP BY ALL""")
def agent_card_census(spark, sf_dir):
    """P26, A19."""
    k = F.col("s_suppkey")
    shape = F.when(k % 3 == 0, '"supportedInterfaces":[{"url":"https://a/x","protocolBinding":"http+json"}]').when(k % 3 == 1, '"url":"https://a/y","preferredTransport":"grpc"').otherwise('"url":"https://a/z"')
    body = F.concat(F.lit('{"name":"n",'), F.when(k % 2 == 0, '"protocolVersion":"1.0",').otherwise(""), F.lit('"capabilities":{"streaming":'), F.when(k % 4 == 0, "true").otherwise("false"), F.lit("},"), shape, F.lit("}"))
    return cards.census(V.table(spark, sf_dir, "supplier").select(cards.profile(D.variant(body)).alias("profile")))
