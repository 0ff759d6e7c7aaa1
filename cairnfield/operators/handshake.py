"""Handshake answers and hygiene of endpoints: parsing, classes, targets, lookups, notes and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield import schemas as S
from cairnfield.functions import documents as D
from cairnfield.functions import hosts as H
from cairnfield.functions import http as W
from cairnfield.functions import text as T
from cairnfield.operators import cards
from cairnfield.operators.classify import dedupe

# Severities, and the sign-in host of one platform whose two issuers are rolled up.
SEVERITY = {"no_challenge_200": "medium", "dead_card_endpoint": "low", "card_without_endpoint": "info", "prm_issuer_mismatch": "low", "no_pkce_advertised": "low", "prm_resource_mismatch": "low", "shopify-platform-pattern": "info"}
PLATFORM_ISSUER = r"(?i)^https?://([a-z0-9-]+\.)*shopify\.com/authentication\b"
MAX_SERVERS = 5


def body(content_type: Column, text: Column) -> Column:
    """Kind of an answer's body, and its JSON-RPC result or error."""
    mime, plain = T.media_type(content_type), T.trim(F.coalesce(text, F.lit("")))
    kind = (
        F.when(plain == "", "empty")
        .when(mime == "text/event-stream", "sse")
        .when((mime == "application/json") | mime.endswith("+json") | plain.rlike(r"^[\[{]"), "json")
        .when((mime == "text/html") | plain.rlike(r"(?i)^\s*<(!doctype|html)"), "html")
        .when(mime.startswith("text/"), "text")
        .otherwise("other")
    )
    doc = D.variant(F.when(kind == "sse", W.first_sse_data(plain)).when(kind == "json", plain))
    rpc = F.coalesce(D.text(doc, "$.jsonrpc") == "2.0", F.lit(False)) & D.is_object(doc)
    keys = lambda path: F.when(D.is_object(doc, path), F.slice(F.map_keys(F.try_variant_get(doc, path, "map<string,variant>")), 1, 20)).otherwise(F.array().cast("array<string>"))
    info = F.when(D.is_object(doc, "$.result.serverInfo"), F.struct(D.text(doc, "$.result.serverInfo.name").alias("name"), D.text(doc, "$.result.serverInfo.version").alias("version")))
    result = F.when(rpc & D.is_object(doc, "$.result"), F.struct(D.text(doc, "$.result.protocolVersion").alias("protocol_version"), info.alias("server_info"), keys("$.result.capabilities").alias("capabilities_keys"), D.text(doc, "$.result.instructions").isNotNull().alias("instructions_present")))
    error = F.when(rpc & D.is_object(doc, "$.error"), F.struct(D.number(doc, "$.error.code").cast("bigint").alias("code"), F.substring(D.text(doc, "$.error.message"), 1, 200).alias("message"), keys("$.error.data").alias("data_keys")))
    return F.struct(kind.alias("kind"), rpc.alias("jsonrpc"), result.alias("result"), error.alias("error"))


def classify(status: Column, www: Column, has_result: Column, has_error: Column) -> Column:
    """One of eleven classes, by the first rule that holds."""
    good = status.between(200, 299)
    return (
        F.when(status == 0, "unreachable")
        .when((status == 401) & www.isNotNull(), "challenge_401")
        .when(status == 401, "challenge_401_no_header")
        .when(status == 403, "forbidden_403")
        .when(good & has_result, "no_challenge_200")
        .when(good & has_error, "jsonrpc_error_200")
        .when(good, "not_mcp")
        .when(status.between(300, 399), "redirect_3xx")
        .when(status.isin(400, 404) & has_error, "modern_no_initialize")
        .when(status.between(400, 499), "error_4xx")
        .otherwise("error_5xx")
    )


def answers(captured: DataFrame) -> DataFrame:
    """Adds www_authenticate, body_kind, jsonrpc, result, jsonrpc_error and classification to captured answers (status, headers, content_type, text)."""
    rows = captured.withColumn("www_authenticate", W.www_authenticate(W.header(F.col("headers"), "www-authenticate"))).withColumn("_b", body(F.col("content_type"), F.col("text")))
    rows = rows.select("*", F.col("_b.kind").alias("body_kind"), F.col("_b.jsonrpc").alias("jsonrpc"), F.col("_b.result").alias("result"), F.col("_b.error").alias("jsonrpc_error")).drop("_b")
    return rows.withColumn("classification", classify(F.col("status"), F.col("www_authenticate"), F.col("result").isNotNull(), F.col("jsonrpc_error").isNotNull()))


def targets(results: DataFrame, cards_refetched: DataFrame | None = None) -> DataFrame:
    """Endpoints to ask, of hosts with a valid tool-server card: those that hygiene recorded (else those of the card fetched again), and agent endpoints that coincide with any of them or whose path ends in `mcp`."""
    hosts = results.filter(F.col("mcp_card_path").isNotNull()).withColumn("_pos", F.monotonically_increasing_id())
    entries = hosts.select("host", "rank", "mcp_card_path", F.posexplode_outer("hygiene").alias("_i", "h"))
    own = entries.filter("h.kind = 'mcp' and h.endpoint.url is not null").select("host", "rank", F.lit("mcp_card").alias("source"), F.col("mcp_card_path").alias("card_path"), F.col("h.card_spec").alias("card_spec"), F.col("h.endpoint.url").alias("endpoint"), F.lit(False).alias("needs_card_refetch"), "_i")
    without = hosts.join(own.select("host").distinct(), "host", "left_anti")
    none = F.lit(None).cast("string")
    if cards_refetched is None:
        again = without.select("host", "rank", none.alias("endpoint"))
    else:
        again = without.join(cards_refetched.select("host", F.explode_outer(cards.all_endpoints(D.variant(F.col("body")))).alias("endpoint")), "host", "left").select("host", "rank", "endpoint")
    again = again.join(hosts.select("host", "mcp_card_path"), "host").select("host", "rank", F.lit("mcp_card").alias("source"), F.col("mcp_card_path").alias("card_path"), none.alias("card_spec"), "endpoint", F.lit(True).alias("needs_card_refetch"), F.lit(0).alias("_i"))
    mcp = dedupe(own.unionByName(again), ["host", "endpoint"], [F.col("_i")])
    urls = mcp.select(F.col("endpoint").alias("_url")).filter("_url is not null").distinct().withColumn("_same", F.lit(True))
    agents = entries.filter("h.kind = 'a2a' and h.endpoint.url is not null").select("host", "rank", F.lit("a2a_card").alias("source"), none.alias("card_path"), none.alias("card_spec"), F.col("h.endpoint.url").alias("endpoint"), F.lit(False).alias("needs_card_refetch"), "_i")
    last = F.element_at(F.split(T.without_trailing_slash(T.path(F.col("endpoint"))), "/"), -1)
    agents = agents.join(urls, agents["endpoint"] == urls["_url"], "left").filter(F.col("_same") | F.coalesce(F.lower(last) == "mcp", F.lit(False))).drop("_url", "_same")
    agents = dedupe(agents, ["host", "endpoint"], [F.col("_i")]).join(mcp.select("host", "endpoint"), ["host", "endpoint"], "left_anti").select(*mcp.columns)
    return mcp.unionByName(agents).drop("_i")


# ---------------------------------------------------------------------------------------------------------------------
# hygiene of captured follow-ups


def metadata_urls(issuer: Column) -> Column:
    """Where an authorization server's metadata may stand, the first place first."""
    path = T.without_trailing_slash(T.path(issuer))
    base = T.origin(issuer)
    usable = T.path(issuer).isNotNull()
    return F.when(usable, F.array(F.concat(base, F.lit("/.well-known/oauth-authorization-server"), path), F.concat(base, path, F.lit("/.well-known/openid-configuration"))))


def resource_urls(endpoint: Column) -> Column:
    """Where an endpoint's protected-resource document may stand: with its path, then at the root."""
    path, base = T.without_trailing_slash(T.path(endpoint)), F.concat(T.origin(endpoint), F.lit("/.well-known/oauth-protected-resource"))
    suffixed = F.when(path != "", F.struct(F.concat(base, path).alias("url"), F.lit("path_suffixed").alias("location")))
    return F.when(path.isNotNull(), F.array_compact(F.array(suffixed, F.struct(base.alias("url"), F.lit("root").alias("location")))))


def hygiene(valid_cards: DataFrame, follow_ups: DataFrame) -> DataFrame:
    """Hygiene of valid cards and resource documents (host, source, kind, card_spec, doc, reasons, hsts, cache_control) against captured follow-ups (url, status, error, body).

    A chain of lookups by URL: card, endpoint, resource document, authorization servers.
    """
    pages = dedupe(follow_ups.select("url", "status", "error", "body"), ["url"], [F.desc("status")]).withColumn("fdoc", D.variant(F.col("body"))).drop("body")
    rows = valid_cards.withColumn("_id", F.xxhash64("host", "source")).withColumn("_ep", F.when(F.col("kind") == "protected_resource", D.text(F.col("doc"), "$.resource")).otherwise(cards.endpoint(F.col("doc"))))
    own = rows.join(pages.select(F.col("url").alias("_ep"), F.col("status").alias("_ep_status"), F.col("error").alias("_ep_error")), "_ep", "left")
    scheme = F.lower(T.part(F.col("_ep"), "PROTOCOL"))
    http = scheme.isin("http", "https")
    status = F.when(http, F.nullif(F.col("_ep_status"), F.lit(0)))
    endpoint = F.when(F.col("_ep").isNotNull(), F.struct(F.col("_ep").alias("url"), F.coalesce(scheme == "https", F.lit(False)).alias("https"), status.alias("status"), F.when(scheme.isNull(), "invalid_url").when(~http, F.concat(F.lit("non_http_scheme:"), scheme, F.lit(":"))).otherwise(F.col("_ep_error")).alias("error"), (F.coalesce(status, F.lit(404)).isin(404, 410) == F.lit(False)).alias("reachable")))
    own = own.withColumn("endpoint", endpoint).withColumn("third", F.when(scheme.isNotNull(), H.registrable(T.hostname(F.col("_ep"))) != H.registrable(F.col("host"))))
    # resource documents, in order of preference
    asked = own.filter(F.col("kind") != "protected_resource").select("_id", F.posexplode(resource_urls(F.col("_ep"))).alias("_n", "u")).select("_id", "_n", "u.url", "u.location")
    looked = asked.join(pages, "url", "left").withColumn("valid", F.coalesce((F.col("status") == 200) & D.text(F.col("fdoc"), "$.resource").isNotNull(), F.lit(False)))
    from cairnfield.operators.validate import resource_matches

    looked = looked.withColumn("wrong", F.col("valid") & F.coalesce(~resource_matches(D.text(F.col("fdoc"), "$.resource"), F.col("url")), F.lit(False)))
    lookups = looked.groupBy("_id").agg(
        F.array_sort(F.collect_list(F.struct("_n", "url", "location", "status", (F.col("valid") & ~F.col("wrong")).alias("valid"), "error"))).alias("lookups"),
        F.min(F.when(F.col("valid") & ~F.col("wrong"), F.col("_n"))).alias("_hit"), F.bool_or("wrong").alias("resource_wrong"),
    )
    hit = looked.filter(F.col("valid") & ~F.col("wrong")).join(lookups.select("_id", F.col("_hit").alias("_n")), ["_id", "_n"]).select("_id", F.col("fdoc").alias("prm"))
    own = own.join(lookups, "_id", "left").join(hit, "_id", "left")
    prm = F.when(F.col("kind") == "protected_resource", F.col("doc")).otherwise(F.col("prm"))
    servers = F.array_distinct(F.concat(cards.authorization_servers(F.col("doc")), F.when(F.col("prm").isNotNull(), cards.authorization_servers(F.col("prm"))).otherwise(F.array().cast("array<string>"))))
    own = own.withColumn("_prm", prm).withColumn("servers", servers).withColumn("bearer", F.when(F.col("_prm").isNotNull(), F.array_contains(D.strings(D.items(F.col("_prm"), "$.bearer_methods_supported")), "query")))
    # authorization servers
    each = own.select("_id", "host", F.posexplode(F.slice("servers", 1, MAX_SERVERS)).alias("_n", "issuer"))
    places = each.select("_id", "_n", F.posexplode(metadata_urls(F.col("issuer"))).alias("_m", "url")).join(pages, "url", "left")
    best = places.groupBy("_id", "_n").agg(F.min_by(F.struct("url", "status", "error", "fdoc"), F.struct(F.when(F.col("status") == 200, 0).otherwise(1), "_m")).alias("m"))
    each = each.join(best, ["_id", "_n"], "left")
    fdoc = F.col("m.fdoc")
    resolves = F.coalesce(F.col("m.status") == 200, F.lit(False))
    server = F.struct(
        "_n", "issuer", F.col("issuer").startswith("https://").alias("https"), F.coalesce("m.url", F.lit("")).alias("metadata_url"), F.nullif(F.col("m.status"), F.lit(0)).alias("status"),
        F.when(F.col("m").isNull(), "invalid_issuer_url").otherwise(F.col("m.error")).alias("error"), resolves.alias("resolves"),
        F.when(resolves, T.without_trailing_slash(D.text(fdoc, "$.issuer")) == T.without_trailing_slash(F.col("issuer"))).alias("issuer_match"),
        F.when(resolves & D.is_object(fdoc), cards.pkce(fdoc)).alias("pkce_advertised"),
        F.coalesce(H.registrable(T.hostname(F.col("issuer"))) != H.registrable(F.col("host")), F.lit(False)).alias("third_party_hosted"),
    )
    checked = each.groupBy("_id").agg(F.array_sort(F.collect_list(server)).alias("checked"))
    own = own.join(checked, "_id", "left").withColumn("checked", F.coalesce("checked", F.array().cast("array<struct<_n:int,issuer:string,https:boolean,metadata_url:string,status:int,error:string,resolves:boolean,issuer_match:boolean,pkce_advertised:boolean,third_party_hosted:boolean>>")))
    card, resource = F.col("kind") != "protected_resource", F.col("kind") == "protected_resource"
    has = F.col("endpoint").isNotNull()
    some = lambda f: F.exists("checked", f)
    notes = F.array_compact(
        F.array(
            F.when(F.col("hsts").isNull(), "no_hsts_on_card"),
            F.when(card & has & ~F.col("endpoint.https"), "endpoint_not_https"),
            F.when(card & has & ~F.col("endpoint.reachable"), "endpoint_unreachable"),
            F.when(card & F.col("third"), "third_party_hosted:endpoint"),
            F.when(card & F.col("resource_wrong") | resource & F.array_contains("reasons", "prm_resource_mismatch"), "prm_resource_mismatch"),
            F.when(card & has & http & F.col("prm").isNull(), "no_prm_for_endpoint"),
            F.when(card & ~has, "no_endpoint_url_in_card"),
            F.when(resource & has & ~F.col("endpoint.https"), "resource_not_https"),
            F.when(F.col("bearer"), "bearer_query_allowed"),
            F.when(F.size("servers") == 0, F.when(resource, "empty_authorization_servers").otherwise("no_authorization_server_declared")),
            F.when(some(lambda c: ~c["https"]), "auth_server_not_https"),
            F.when(some(lambda c: ~c["resolves"]), "auth_server_metadata_unresolved"),
            F.when(some(lambda c: c["issuer_match"] == F.lit(False)), "issuer_mismatch"),
            F.when(some(lambda c: c["pkce_advertised"] == F.lit(False)), "no_pkce_advertised"),
            F.when(some(lambda c: c["third_party_hosted"]), "third_party_hosted:auth_server"),
        )
    )
    none = F.array().cast("array<struct<url:string,location:string,status:int,valid:boolean,error:string>>")
    return own.select(
        "host", "source", "kind", "card_spec", "endpoint", F.col("third").alias("endpoint_third_party_hosted"),
        F.coalesce(F.transform("lookups", lambda x: x.dropFields("_n")), none).alias("prm_lookups"), F.transform("checked", lambda x: x.dropFields("_n")).alias("authorization_servers"),
        (F.size("servers") > 0).alias("has_authorization_servers"), F.col("bearer").alias("bearer_query_allowed"), "hsts", "cache_control", notes.alias("notes"),
    )


# ---------------------------------------------------------------------------------------------------------------------
# findings


def on_platform() -> Column:
    """A storefront of the platform, by its fingerprint or an issuer that its hygiene names."""
    issuers = F.exists(F.coalesce("hygiene", F.array()), lambda h: F.exists(F.coalesce(h["authorization_servers"], F.array()), lambda a: F.coalesce(a["issuer"].rlike(PLATFORM_ISSUER), F.lit(False))))
    return (F.coalesce(F.col("fingerprint.primary"), F.lit("")) == "shopify") | F.coalesce(F.array_contains("fingerprint.platforms", "shopify"), F.lit(False)) | F.coalesce(issuers, F.lit(False))


def hygiene_findings(results: DataFrame) -> DataFrame:
    """host, rank, platform, finding, evidence, notes from the hygiene entries of each host."""
    sources = F.create_map(*[F.lit(x) for _, path, artifact, *_ in S.PROBE_SPECS for x in (artifact, path)])
    rows = results.select("host", "rank", on_platform().alias("platform"), F.explode("hygiene").alias("h"))
    src = F.concat(F.lit("https://"), "host", F.coalesce(F.try_element_at(sources, F.col("h.source")), F.concat(F.lit("/"), F.col("h.source"))))
    rows = rows.withColumn("src", src)
    has = lambda note: F.array_contains("h.notes", note)
    finding = lambda name, evidence, notes="": F.struct(F.lit(name).alias("finding"), evidence.alias("evidence"), (notes if isinstance(notes, Column) else F.lit(notes)).alias("notes"))
    answered = F.coalesce(F.col("h.endpoint.status").cast("string"), "h.endpoint.error", F.lit("no response"))
    prm = F.when(F.col("h.kind") == "protected_resource", F.col("src")).otherwise(F.coalesce(F.get(F.filter("h.prm_lookups", lambda p: p["status"] == 200), F.lit(0))["url"], "src"))
    declared = F.concat(F.lit("declared by "), "src")
    single = F.array_compact(
        F.array(
            F.when(has("endpoint_unreachable") & F.col("h.endpoint").isNotNull(), finding("dead_card_endpoint", F.concat("h.endpoint.url", F.lit(" -> "), answered), F.concat(F.lit("advertised by "), "src"))),
            F.when(has("no_endpoint_url_in_card"), finding("card_without_endpoint", F.concat("src", F.lit(" -> 200 (valid card, no endpoint URL)")))),
            F.when(has("prm_resource_mismatch"), finding("prm_resource_mismatch", F.concat(prm, F.lit(" -> 200 (resource does not match the URL it was served from)")))),
        )
    )
    shown = lambda a: F.concat(a["metadata_url"], F.lit(" -> "), a["status"].cast("string"))
    of_server = lambda a: F.array_compact(
        F.array(
            F.when(a["resolves"] & (a["issuer_match"] == F.lit(False)), finding("prm_issuer_mismatch", F.concat(shown(a), F.lit(" (issuer in metadata != "), a["issuer"], F.lit(")")), declared)).withField("two", a["issuer"].rlike(PLATFORM_ISSUER)),
            F.when(a["resolves"] & (a["pkce_advertised"] == F.lit(False)), finding("no_pkce_advertised", F.concat(shown(a), F.lit(" (code_challenge_methods_supported lacks S256)")), declared)).withField("two", F.lit(False)),
        )
    )
    every = F.concat(F.transform(single, lambda x: x.withField("two", F.lit(False))), F.flatten(F.transform("h.authorization_servers", of_server)))
    return rows.select("host", "rank", "platform", F.explode(every).alias("x")).select("host", "rank", "platform", "x.*")


def findings(results: DataFrame, handshakes: DataFrame) -> DataFrame:
    """All findings in order of rank (null last), host and finding, each once; those of platform hosts are one row."""
    found = hygiene_findings(results)
    context = dedupe(results.withColumn("_pos", F.monotonically_increasing_id()), ["host"], [F.desc("_pos")]).select("host", F.col("rank").alias("_rank"), on_platform().alias("platform"))
    info = F.when(F.col("result.server_info").isNotNull(), F.concat(F.coalesce("result.server_info.name", F.lit("?")), F.lit("@"), F.coalesce("result.server_info.version", F.lit("?")))).otherwise("serverInfo absent")
    session = F.when(F.col("mcp_session_id_present"), ", session id issued").otherwise("")
    open_ = handshakes.filter("classification = 'no_challenge_200'").join(context, "host", "left").select(
        "host", F.coalesce("rank", "_rank").alias("rank"), F.coalesce("platform", F.lit(False)).alias("platform"), F.lit("no_challenge_200").alias("finding"),
        F.concat(F.lit("POST initialize "), "endpoint", F.lit(" -> "), F.col("status").cast("string"), F.lit(" ("), "body_kind", F.lit(", "), info, session, F.lit(")")).alias("evidence"), F.lit("").alias("notes"), F.lit(False).alias("two"),
    )
    every = found.unionByName(open_)
    plain = every.filter(~F.col("platform") & ~F.col("two")).dropDuplicates(["host", "finding", "evidence"]).select("host", "rank", "finding", "evidence", "notes")
    name = "shopify-platform-pattern"
    rolled = every.filter("platform").withColumn("finding", F.when(F.col("two"), "issuer_mismatch_two_issuer").otherwise(F.col("finding")))
    # two rows of one key: kinds with their counts, and the number of hosts
    counts = rolled.groupBy("finding").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.concat_ws("=", "finding", "n"))).alias("c"))
    one = counts.withColumn("_k", F.lit(1)).join(rolled.agg(F.count_distinct("host").alias("hosts")).withColumn("_k", F.lit(1)), "_k").filter("hosts > 0")
    row = one.select(F.lit(name).alias("host"), F.lit(None).cast("int").alias("rank"), F.lit(name).alias("finding"), F.concat(F.col("hosts").cast("string"), F.lit(" storefront hosts; "), F.array_join("c", ", ")).alias("evidence"), F.lit("").alias("notes"))
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return plain.unionByName(row).withColumn("severity", severity[F.col("finding")]).orderBy(F.col("rank").asc_nulls_last(), "host", "finding", "evidence")


def finding_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("finding").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))


def contact_hint(security_valid: Column, security_url: Column, security_body: Column) -> Column:
    """The contact of a valid security.txt, its place if the body isn't known, else a generic hint."""
    line = T.blank_as_null(F.regexp_extract(security_body, r"(?im)^contact:\s*(.+?)\s*$", 1))
    return F.when(~F.coalesce(security_valid, F.lit(False)), "WHOIS/abuse").otherwise(F.coalesce(line, F.concat(F.lit("security.txt: "), security_url)))
