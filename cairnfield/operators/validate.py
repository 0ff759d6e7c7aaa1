"""Validity of discovery documents: reasons, and whether any of them is fatal. Notes never are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import documents as D
from cairnfield.functions import text as T

NONE = F.array


def _reasons(*cases: Column) -> Column:
    return F.array_compact(F.array(*cases))


def _outcome(reasons: Column, soft: str = r"^note:", spec: Column | None = None) -> Column:
    found = _once(reasons, lambda rs: F.struct((F.size(F.filter(rs, lambda r: ~r.rlike(soft))) == 0).alias("valid"), rs.alias("reasons")))
    return _once(found, lambda o: F.struct(o["valid"].alias("valid"), o["reasons"].alias("reasons"), (spec if spec is not None else F.lit(None).cast("string")).alias("card_spec")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is worked out once, however often it is named there; Spark doesn't share what functions of arrays hold."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blank(text: Column) -> Column:
    return ~text.rlike(f"[^{T.SPACE[1:]}")


def markdown(text: Column, content_type: Column) -> Column:
    """No HTML, at least one heading, not empty; a first line other than a top heading is noted."""
    plain = F.when(text.startswith("\ufeff"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    matter = lambda t: F.when(t.startswith("---"), F.locate("\n---", t, 4)).otherwise(0)
    cut = lambda t, end: F.when(end > 0, F.substring(t, end + 4, F.length(t))).otherwise(t)
    body = _once(plain, lambda t: _once(F.struct(t.alias("t"), matter(t).alias("end")), lambda x: cut(x["t"], x["end"])))
    return _outcome(_once(body, lambda b: _markdown_reasons(text, b, content_type)))


def _markdown_reasons(text: Column, body: Column, content_type: Column) -> Column:
    # plain searches first: most texts hold no such mark at all, and a pattern looks at each place
    marked = F.contains(body, F.lit("#")) & body.rlike(r"(?m)^\s{0,3}#{1,6}\s+\S")
    ruled = (F.contains(body, F.lit("\n=")) | F.contains(body, F.lit("\n---"))) & body.rlike(r"(?m)^\S.*\n(=+|-{3,})\s*$")
    # the first line that isn't blank
    top = body.rlike(rf"\A(?:{T.SPACE}*\n)?[^\S\n]{{0,3}}#[^\S\n]+\S")
    return _reasons(
        F.when(T.looks_like_html(text), "body_is_html"),
        F.when(T.media_type(content_type) == "text/html", "content_type_html"),
        F.when(~(marked | ruled), "no_markdown_heading"),
        F.when(_blank(body), "empty"),
        F.when(~F.coalesce(top, F.lit(False)), "note:h1_not_first"),
    )


def security_txt(text: Column, content_type: Column) -> Column:
    html = T.looks_like_html(text) | (T.media_type(content_type) == "text/html")
    fields = _reasons(F.when(~text.rlike(r"(?im)^\s*contact\s*:\s*\S"), "no_contact_field"), F.when(~text.rlike(r"(?im)^\s*expires\s*:"), "note:no_expires_field"))
    return _outcome(F.when(html, F.array(F.lit("body_is_html"))).when(_blank(text), F.array(F.lit("empty"))).otherwise(fields))


def plain_text(text: Column, content_type: Column) -> Column:
    html = T.looks_like_html(text) | (T.media_type(content_type) == "text/html")
    return _outcome(_reasons(F.when(html, "body_is_html"), F.when(_blank(text), "empty")))


def card_spec(doc: Column) -> Column:
    """Which draft a card follows: remotes are the newer one; a URL, transport or tools the older."""
    older = (D.kind(doc, "$.url") == "STRING") | D.exists(doc, "$.transport") | D.is_array(doc, "$.tools")
    return F.when(F.size(D.items(doc, "$.remotes")) > 0, "sep-2127").when(F.coalesce(older, F.lit(False)), "sep-1649").otherwise("unknown")


def derived_resource(url: Column) -> Column:
    """The resource that a protected-resource document at a URL describes; null at other places."""
    path = T.path(url)
    rest = F.regexp_extract(path, "^/\\.well-known/oauth-protected-resource(/.*)?$", 1)
    return F.when(path.rlike("^/\\.well-known/oauth-protected-resource(/.*)?$"), F.concat(T.origin(url), F.when(rest == "", "/").otherwise(rest)))


def normal_resource(url: Column) -> Column:
    query = T.part(url, "QUERY")
    return F.when(T.part(url, "PROTOCOL").isNotNull(), F.concat(T.origin(url), T.without_trailing_slash(T.path(url)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resource_matches(resource: Column, url: Column) -> Column:
    """Whether a document names the resource it was fetched for; null where that can't be told."""
    wanted = derived_resource(url)
    return F.when(wanted.isNotNull(), F.coalesce(normal_resource(resource) == normal_resource(wanted), F.lit(False)))


def _required(doc: Column, name: str) -> Column:
    return F.when(~D.exists(doc, f"$.{name}"), f"schema:required:{name}")


def _text_field(doc: Column, name: str) -> list[Column]:
    wrong = D.exists(doc, f"$.{name}") & F.coalesce(D.kind(doc, f"$.{name}") != "STRING", F.lit(True))
    return [F.when(wrong, f"schema:type:/{name}"), F.when(D.text(doc, f"$.{name}") == "", f"schema:minLength:/{name}")]


def _array_field(doc: Column, name: str, *, filled: bool = False) -> list[Column]:
    out = [F.when(D.exists(doc, f"$.{name}") & ~D.is_array(doc, f"$.{name}"), f"schema:type:/{name}")]
    return [*out, F.when(D.is_array(doc, f"$.{name}") & (F.size(D.items(doc, f"$.{name}")) == 0), f"schema:minItems:/{name}")] if filled else out


def _any_of(doc: Column, *names: str) -> Column:
    found = F.lit(False)
    for n in names:
        found = found | D.exists(doc, f"$.{n}")
    return F.when(~found, "schema:anyOf")


def _schema(doc: Column, artifact: Column) -> Column:
    """Reasons why an object of an artifact isn't well-formed."""
    name = [_required(doc, "name"), *_text_field(doc, "name")]
    has_remotes = D.exists(doc, "$.remotes") & (F.size(D.items(doc, "$.remotes")) > 0)
    card = _reasons(*name, F.when(~has_remotes & _any_of(doc, "url", "transport", "tools", "endpoint").isNotNull(), "schema:anyOf"))
    agent = _reasons(*name, _any_of(doc, "url", "skills", "supportedInterfaces"))
    servers = D.items(doc, "$.authorization_servers")
    resource = _reasons(_required(doc, "resource"), *_text_field(doc, "resource"), *_array_field(doc, "authorization_servers"), F.when(F.size(D.strings(servers)) < F.size(servers), "schema:type:/authorization_servers"))
    issuer = _reasons(_required(doc, "issuer"), _required(doc, "response_types_supported"), *_text_field(doc, "issuer"), *_array_field(doc, "response_types_supported", filled=True))
    return (
        F.when(artifact.isin("mcp_server_card", "mcp_server_card_legacy"), card)
        .when(artifact.isin("a2a_agent_card", "a2a_agent_json"), agent)
        .when(artifact == "oauth_protected_resource", resource)
        .when(artifact.isin("oauth_authorization_server", "openid_configuration"), issuer)
        .otherwise(F.array().cast("array<string>"))
    )


KNOWN_JSON = ("mcp_server_card", "mcp_server_card_legacy", "ai_catalog", "oauth_protected_resource", "oauth_authorization_server", "openid_configuration", "a2a_agent_card", "a2a_agent_json")


def json_document(artifact: Column, text: Column, doc: Column, content_type: Column, url: Column) -> Column:
    """`doc` is the text as a variant, null if it isn't JSON."""
    mime = T.media_type(content_type)
    odd = (mime != "") & ~mime.isin("application/json", "text/json", "text/plain") & ~mime.endswith("+json")
    is_resource = artifact == "oauth_protected_resource"
    spec = F.when(artifact.isin("mcp_server_card", "mcp_server_card_legacy"), card_spec(doc))
    schema = _schema(doc, artifact)
    reasons = F.concat(
        schema,
        _reasons(
            F.when(odd, F.concat(F.lit("unexpected_content_type:"), mime)),
            F.when(is_resource & ~D.is_array(doc, "$.authorization_servers"), "note:prm_no_authorization_servers"),
            F.when(is_resource & (resource_matches(D.text(doc, "$.resource"), url) == F.lit(False)) & D.text(doc, "$.resource").isNotNull(), "prm_resource_mismatch"),
        ),
    )
    fine = F.size(F.filter(reasons, lambda r: ~r.rlike("^(unexpected_content_type|note:)"))) == 0
    notes = _reasons(
        F.when(fine & (artifact == "mcp_server_card") & (spec != "sep-2127"), "note:legacy_shape_at_current_path"),
        F.when(fine & (spec == "sep-2127") & ~D.text(doc, "$.name").rlike(r"(?i)^[a-z0-9-]+(\.[a-z0-9-]+)+/?"), "note:name_not_reverse_dns"),
    )
    known = _outcome(F.concat(reasons, notes), r"^(unexpected_content_type|note:)", spec)
    flat = lambda r: _outcome(F.array(F.lit(r)))
    return (
        F.when(T.looks_like_html(text), flat("body_is_html"))
        .when(doc.isNull(), flat("json_parse_error"))
        .when(~artifact.isin(*KNOWN_JSON), _outcome(F.array().cast("array<string>")))
        .when(~D.is_object(doc), flat("not_an_object"))
        .otherwise(known)
    )


def openapi(text: Column, doc: Column, was_json: Column, path: Column) -> Column:
    """`doc` is the text read as JSON or YAML."""
    version = D.text(doc, "$.openapi")
    old = D.text(doc, "$.swagger")
    current = F.coalesce(version.startswith("3."), F.lit(False))
    truthy = D.exists(doc, "$.paths") | D.exists(doc, "$.webhooks") | D.exists(doc, "$.components")
    reasons = _reasons(
        F.when(path.endswith(".json") & ~was_json, "json_path_served_yaml"),
        F.when(current & ~truthy, "no_paths").when(~current & old.isNotNull(), F.concat(F.lit("swagger_2_not_3:"), old)).when(~current, "missing_openapi_3_field"),
    )
    flat = lambda r: _outcome(F.array(F.lit(r)))
    return F.when(T.looks_like_html(text), flat("body_is_html")).when(doc.isNull(), flat("unparseable_json_or_yaml")).when(~D.is_object(doc), flat("not_an_object")).otherwise(_outcome(reasons, "^(json_path_served_yaml|no_paths)$"))


def with_outcome(rows: DataFrame) -> DataFrame:
    """Adds `outcome` (valid, reasons, card_spec) to rows with artifact, kind, path, text, content_type, final_url, checked; Python reads only what JVM parsing couldn't."""
    text, kind = F.col("text"), F.col("kind")
    wants = F.col("checked") & kind.isin("json", "openapi")
    rows = rows.withColumn("_doc", F.when(wants, D.variant(text)))
    # repeated keys fail to parse as a variant, and YAML isn't JSON
    rows = rows.withColumn("_again", F.when(wants & F.col("_doc").isNull() & (kind == "json"), text)).withColumn("_yaml", F.when(wants & F.col("_doc").isNull() & (kind == "openapi"), text))
    rows = rows.withColumn("_json", D.lenient_json(F.col("_again"))).withColumn("_any", D.structured(F.col("_yaml"), F.lit(False)))
    rows = rows.withColumn("_was_json", F.col("_doc").isNotNull()).withColumn("_doc", F.coalesce("_doc", F.try_parse_json("_json"), F.try_parse_json("_any")))
    outcome = (
        F.when(kind == "markdown", markdown(text, F.col("content_type")))
        .when(kind == "json", json_document(F.col("artifact"), text, F.col("_doc"), F.col("content_type"), F.col("final_url")))
        .when(kind == "openapi", openapi(text, F.col("_doc"), F.col("_was_json"), F.col("path")))
        .when(F.col("artifact") == "security_txt", security_txt(text, F.col("content_type")))
        .otherwise(plain_text(text, F.col("content_type")))
    )
    return rows.withColumn("outcome", F.when(F.col("checked"), outcome)).drop("_doc", "_again", "_yaml", "_json", "_any", "_was_json")
