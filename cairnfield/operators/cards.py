"""Cards and API descriptions: tools, operations, endpoints, authorization servers, agent-card profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield import schemas as S
from cairnfield.functions import documents as D
from cairnfield.functions import keys as K
from cairnfield.functions import text as T
from cairnfield.operators.classify import dedupe

# Names of published sample cards, the interface extension and its media type.
SAMPLES = (
    (r"(?i)^hello ?world agent$", "a2a-samples helloworld"),
    (r"(?i)^currency ?agent$", "a2a-samples currency"),
    (r"(?i)^weather ?agent$", "a2a-samples weather"),
    (r"(?i)^(google ?maps|maps) agent$", "a2a-samples maps"),
    (r"(?i)^expense ?reimbursement agent$", "a2a-samples reimbursement"),
    (r"(?i)^dice agent$", "a2a-samples dice"),
)
UI_EXTENSION, UI_MIME = "https://a2ui.org/a2a-extension/a2ui/", "application/json+a2ui"


def card_tools(doc: Column) -> Column:
    """Distinct tool names of a card: at the top, under capabilities, then under each remote, server and endpoint."""

    def names(array: Column) -> Column:
        return F.filter(F.transform(array, lambda v: F.coalesce(D.text(v, "$"), D.text(v, "$.name"))), lambda s: s.isNotNull())

    nested = [F.flatten(F.transform(D.items(doc, f"$.{k}"), lambda r: names(D.items(r, "$.tools")))) for k in ("remotes", "servers", "endpoints")]
    every = F.concat(names(D.items(doc, "$.tools")), names(D.items(doc, "$.capabilities.tools")), *nested)
    return F.array_distinct(F.filter(F.transform(every, T.trim), lambda s: s != ""))


def openapi_operations(body: Column) -> Column:
    """Operations of an API description (JSON text) in document order: key, operationId, method, path."""
    paths = F.from_json(F.get_json_object(body, "$.paths"), "map<string,string>")
    methods = F.array(*[F.lit(m) for m in K.METHODS])

    def of_path(entry: Column) -> Column:
        found = F.transform(methods, lambda m: F.struct(m.alias("method"), F.try_element_at(F.from_json(entry["value"], "map<string,string>"), m).alias("op")))
        usable = F.filter(found, lambda x: F.coalesce(F.ltrim(x["op"]).startswith("{"), F.lit(False)))

        def row(x: Column) -> Column:
            doc = F.try_parse_json(x["op"])
            own = F.nullif(T.trim(D.text(doc, "$.operationId")), F.lit(""))
            return F.struct(F.coalesce(own, F.concat_ws(" ", x["method"], entry["key"])).alias("key"), own.alias("operation_id"), x["method"].alias("method"), entry["key"].alias("path"))

        return F.transform(usable, row)

    return F.coalesce(F.flatten(F.transform(F.map_entries(paths), of_path)), F.array().cast("array<struct<key:string,operation_id:string,method:string,path:string>>"))


def endpoint(doc: Column) -> Column:
    """The endpoint a card advertises: of remotes, interfaces, the card itself, its transport, then transports and servers."""
    first = lambda path: F.get(F.filter(F.transform(D.items(doc, path), lambda v: D.text(v, "$.url")), lambda u: u.isNotNull()), F.lit(0))
    return F.coalesce(first("$.remotes"), first("$.supportedInterfaces"), D.text(doc, "$.url"), D.text(doc, "$.endpoint"), D.text(doc, "$.transport.url"), first("$.transports"), first("$.servers"))


def all_endpoints(doc: Column) -> Column:
    remotes = F.filter(F.transform(D.items(doc, "$.remotes"), lambda v: D.text(v, "$.url")), lambda u: u.isNotNull())
    return F.array_distinct(F.concat(remotes, F.array_compact(F.array(endpoint(doc)))))


def authorization_servers(doc: Column) -> Column:
    """Distinct authorization servers a document names itself, then in its authentication block."""
    block = F.when(D.is_object(doc, "$.authentication"), D.values(doc, "$.authentication")).when(D.is_object(doc, "$.auth"), D.values(doc, "$.auth")).otherwise(D.values(doc, "$.securitySchemes"))
    nested = F.transform(block, lambda v: F.concat(F.array_compact(F.array(D.text(v, "$.issuer"), D.text(v, "$.authorization_server"))), D.strings(D.items(v, "$.authorization_servers"))))
    return F.array_distinct(F.concat(D.strings(D.items(doc, "$.authorization_servers")), F.flatten(nested)))


def pkce(doc: Column) -> Column:
    return F.array_contains(D.strings(D.items(doc, "$.code_challenge_methods_supported")), "S256")


def profile(doc: Column) -> Column:
    """What an agent card declares."""
    field = lambda d, path: F.nullif(T.trim(D.text(d, path)), F.lit(""))
    interfaces = F.when(D.exists(doc, "$.supportedInterfaces"), D.items(doc, "$.supportedInterfaces")).otherwise(D.items(doc, "$.additionalInterfaces"))
    url, preferred = field(doc, "$.url"), field(doc, "$.preferredTransport")
    generation = F.when(D.is_array(doc, "$.supportedInterfaces"), "v1").when(preferred.isNotNull(), "v03").when(url.isNotNull(), "legacy").otherwise("unknown")
    named = F.array_compact(F.concat(F.transform(interfaces, lambda i: F.upper(F.coalesce(field(i, "$.protocolBinding"), field(i, "$.transport")))), F.array(F.upper(preferred))))
    transports = F.when((generation != "v1") & (F.size(named) == 0) & url.isNotNull(), F.array(F.lit("JSONRPC"))).otherwise(F.array_sort(F.array_distinct(named)))
    urls = F.array_distinct(F.array_compact(F.concat(F.transform(interfaces, lambda i: field(i, "$.url")), F.array(url))))
    scheme = lambda s: F.when((field(s, "$.type") == "http") & field(s, "$.scheme").isNotNull(), F.concat(F.lit("http:"), F.lower(field(s, "$.scheme")))).otherwise(F.coalesce(field(s, "$.type"), F.lit("unknown")))
    skills = D.items(doc, "$.skills")
    of_skills = lambda path: F.flatten(F.transform(skills, lambda s: D.strings(D.items(s, path))))
    outputs = F.array_distinct(F.concat(D.strings(D.items(doc, "$.defaultOutputModes")), of_skills("$.outputModes")))
    extensions = F.filter(F.transform(D.items(doc, "$.capabilities.extensions"), lambda e: F.struct(field(e, "$.uri").alias("uri"), F.coalesce(D.flag(e, "$.required"), F.lit(False)).alias("required"))), lambda e: e["uri"].isNotNull())
    ui = F.filter(extensions, lambda e: e["uri"].startswith(UI_EXTENSION) | e["uri"].rlike(r"(?i)a2ui\.org"))
    by_mode = F.exists(outputs, lambda m: F.lower(m) == UI_MIME)
    sample = F.when(F.lit(False), "")
    for pattern, name in SAMPLES:
        sample = sample.when(F.coalesce(field(doc, "$.name").rlike(pattern), F.lit(False)), name)
    return F.struct(
        field(doc, "$.protocolVersion").alias("protocol_version"),
        generation.alias("generation"),
        transports.alias("transports"),
        urls.alias("endpoint_urls"),
        D.flag(doc, "$.capabilities.streaming").alias("streaming"),
        D.flag(doc, "$.capabilities.pushNotifications").alias("push_notifications"),
        D.flag(doc, "$.capabilities.stateTransitionHistory").alias("state_transition_history"),
        F.when(D.exists(doc, "$.capabilities.extendedAgentCard"), D.flag(doc, "$.capabilities.extendedAgentCard")).otherwise(D.flag(doc, "$.supportsAuthenticatedExtendedCard")).alias("extended_card"),
        F.array_sort(F.array_distinct(F.transform(D.values(doc, "$.securitySchemes"), scheme))).alias("security_scheme_types"),
        (F.size(D.items(doc, "$.security")) > 0).alias("security_required"),
        F.size(skills).alias("skills"),
        F.slice(F.array_distinct(of_skills("$.tags")), 1, 20).alias("skill_tags"),
        F.array_distinct(F.concat(D.strings(D.items(doc, "$.defaultInputModes")), of_skills("$.inputModes"))).alias("input_modes"),
        outputs.alias("output_modes"),
        extensions.alias("extensions"),
        F.struct(
            ((F.size(ui) > 0) | by_mode).alias("declared"),
            F.array_distinct(F.transform(ui, lambda e: F.regexp_replace(F.replace(e["uri"], F.lit(UI_EXTENSION), F.lit("")), "/.*$", ""))).alias("versions"),
            by_mode.alias("via_output_mode"),
            F.exists(ui, lambda e: e["required"]).alias("required"),
        ).alias("a2ui"),
        (F.size(D.items(doc, "$.signatures")) > 0).alias("signed"),
        field(doc, "$.provider.organization").alias("provider"),
        field(doc, "$.documentationUrl").isNotNull().alias("has_docs_url"),
        field(doc, "$.iconUrl").isNotNull().alias("has_icon"),
        sample.alias("example_copy"),
    )


def candidates(results: DataFrame) -> DataFrame:
    """host, rank, card_url, card_artifact, alt_url: hosts with a valid agent card, the first such path and the next one."""
    valid = F.filter("probes", lambda p: F.coalesce(p["valid"], F.lit(False)) & p["artifact"].isin(*S.A2A_CARDS))
    rows = results.withColumn("_cards", valid).filter(F.size("_cards") > 0)
    first, second = F.get("_cards", F.lit(0)), F.get("_cards", F.lit(1))
    return rows.select("host", "rank", first["final_url"].alias("card_url"), first["artifact"].alias("card_artifact"), second["final_url"].alias("alt_url"))


def recheck(found: DataFrame, captures: DataFrame) -> DataFrame:
    """Candidates with the status, digest and profile of a second capture (url, status, error, body text, pos; the first of a URL counts), and whether the other path served the same body."""
    got = dedupe(captures, ["url"], [F.col("pos")]).select("url", "status", "error", "body", F.sha2("body", 256).alias("sha"))
    ok = F.col("status") == 200
    rows = found.join(got.withColumnRenamed("url", "card_url"), "card_url", "left")
    other = got.select(F.col("url").alias("alt_url"), F.col("status").alias("_alt_status"), F.col("sha").alias("_alt_sha"))
    rows = rows.join(other, "alt_url", "left").withColumn("_doc", F.when(ok, D.variant(F.col("body"))))
    known = D.is_object(F.col("_doc")) | D.is_array(F.col("_doc"), "$")
    return rows.select(
        "host", "rank", "card_url", "card_artifact", "alt_url", F.coalesce("status", F.lit(0)).alias("status"), F.when(ok & F.col("_doc").isNull(), "unparseable").otherwise(F.col("error")).alias("error"), F.when(ok, F.col("sha")).alias("sha256"),
        F.when(ok & (F.col("_alt_status") == 200), F.col("_alt_sha") == F.col("sha")).alias("alt_same_body"), F.when(known, profile(F.col("_doc"))).alias("profile"),
    )


def census(profiles: DataFrame, k: int = 8) -> DataFrame:
    """Counts of what agent cards declare: (measure, value, n), the k most frequent values of each; ties go to the smaller value."""
    from pyspark.sql import Window

    p = profiles.select("profile.*")
    many = lambda name, c: p.select(F.lit(name).alias("measure"), F.explode(c).alias("value"))
    one = lambda name, c: p.select(F.lit(name).alias("measure"), c.cast("string").alias("value"))
    flags = F.array_compact(F.array(*[F.when(c, n) for n, c in {"streaming": F.col("streaming"), "push_notifications": F.col("push_notifications"), "extended_card": F.col("extended_card"), "no_security_scheme": F.size("security_scheme_types") == 0, "security_required": F.col("security_required"), "no_skills": F.col("skills") == 0, "extensions": F.size("extensions") > 0, "a2ui": F.col("a2ui.declared"), "signed": F.col("signed"), "provider": F.col("provider").isNotNull(), "docs_url": F.col("has_docs_url"), "sample_copy": F.col("example_copy").isNotNull()}.items()]))
    rows = one("generation", F.col("generation"))
    for extra in (
        one("protocol_version", F.coalesce("protocol_version", F.lit("(absent)"))),
        many("transport", F.when(F.size("transports") > 0, F.col("transports")).otherwise(F.array(F.lit("(none)")))),
        many("security_scheme", F.col("security_scheme_types")),
        many("skill_tag", F.col("skill_tags")),
        many("output_mode", F.col("output_modes")),
        many("extension", F.col("extensions.uri")),
        many("flag", flags),
    ):
        rows = rows.unionByName(extra)
    counts = rows.groupBy("measure", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("measure").orderBy(F.desc("n"), "value")
    return counts.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") <= k) | (F.col("measure") == "flag")).drop("_r")
