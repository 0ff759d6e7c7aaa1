"""Host corpora: rank bands, registry endpoints, category labels."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions import documents as D
from cairnfield.functions import hosts as H
from cairnfield.functions import text as T
from cairnfield.operators.classify import dedupe

# Names of categories, hosts that are no endpoints, keys that lead to none.
COMMERCE = r"(?i)shopping|auction|e-?commerce|marketplace|retail|classifieds|coupons?"
FINTECH = r"(?i)financ|bank|insurance|invest|trading|brokerage|crypto|payment|fintech|lending|loans?|accounting|tax"
LABEL_SOURCE = "intel"
NO_ENDPOINT = r"(?i)(^|\.)(github\.com|gitlab\.com|bitbucket\.org|npmjs\.com|pypi\.org|glama\.ai|smithery\.ai|modelcontextprotocol\.io|docker\.com|hub\.docker\.com|localhost)$"
NO_ENDPOINT_KEY = r"(?i)repository|homepage|image|avatar|icon|docs?|website"
URL_DEPTH = 4


THOUSANDS = {"k": 1, "m": 2}


def parse_rank(token: str) -> int:
    """`1`, `10k`, `1.5m` as a rank: a whole number of at least 1."""
    digits = token.strip().lower()
    power = THOUSANDS.get(digits[-1:], 0)
    try:
        whole, left = divmod(Decimal(digits[:-1] if power else digits) * 1000**power, 1)
    except InvalidOperation:
        whole, left = Decimal(0), Decimal(0)
    if whole < 1 or left or not digits[:1].isdecimal() or not digits.isalnum() and "." not in digits:
        raise ValueError(f"no rank: {token!r}")
    return int(whole)


def parse_band(label: str) -> tuple[str, int, int]:
    """`1k-10k` as (label, 1001, 10000), so bands that meet don't overlap; one from rank 1 holds it."""
    ends = [parse_rank(x) for x in label.split("-")]
    if len(ends) != 2 or ends[0] >= ends[1]:
        raise ValueError(f"no band of ranks: {label!r}")
    return label, ends[0] + (ends[0] > 1), ends[1]


def rank_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """rank, domain of `rank,domain` lines; headers, comments and junk are dropped."""
    line = T.trim(F.regexp_replace(value, "^\\uFEFF", ""))
    comma = F.locate(",", line)
    rank = F.substring(line, F.lit(1), comma - 1)
    domain = F.regexp_replace(F.lower(T.trim(F.substring(line, comma + 1, F.length(line)))), r"\.$", "")
    rows = lines.select("*", F.when(T.trim(rank).rlike(r"^\d{1,9}$"), T.trim(rank).cast("int")).alias("rank"), domain.alias("domain"), (~line.startswith("#") & (comma > 0)).alias("_ok"))
    return rows.filter("_ok and rank >= 1 and domain <> ''").drop("_ok", value)


def visits(rows: DataFrame, bands: list[tuple[str, int, int]], registrable: Column) -> DataFrame:
    """Rows of (rank, domain, pos) in each band they fall into, with their registrable domain and whether they are its first visit in rank order.

    A row visits overlapping bands in turn, so the second finds its domain taken.
    """
    table = F.array(*[F.struct(F.lit(k).alias("band_no"), F.lit(b[0]).alias("band"), F.lit(b[1]).alias("lo"), F.lit(b[2]).alias("hi")) for k, b in enumerate(bands)])
    inside = F.filter(table, lambda b: (F.col("rank") >= b["lo"]) & (F.col("rank") <= b["hi"]))
    placed = rows.withColumn("registrable", registrable).withColumn("_b", F.explode(inside)).select("*", "_b.band_no", "_b.band").drop("_b")
    # rows without a domain are spread, as they all share the null key
    spread = F.when(F.col("registrable").isNull(), F.xxhash64("rank", "domain", "band_no"))
    seen = F.row_number().over(Window.partitionBy("registrable", spread).orderBy("rank", "pos", "band_no"))
    return placed.withColumn("kept", F.col("registrable").isNotNull() & (seen == 1))


def band_accounts(visited: DataFrame) -> DataFrame:
    return visited.groupBy("band").agg(
        F.count("*").alias("input_rows"), F.count_if("kept").alias("hosts"), F.count_if(F.col("registrable").isNotNull() & ~F.col("kept")).alias("dedupe_losses"), F.count_if(F.col("registrable").isNull()).alias("unparseable")
    )


def band_hosts(visited: DataFrame) -> DataFrame:
    return visited.filter("kept").select("band", "rank", F.col("registrable").alias("domain"))


# ---------------------------------------------------------------------------------------------------------------------
# registries


def endpoint_host(url: Column) -> Column:
    """The host of an http(s) URL that may be an endpoint; null for templates, addresses, code forges and registries."""
    host, _ = H.host_line(T.hostname(url))
    return F.when(url.rlike("(?i)^https?://") & ~host.rlike(NO_ENDPOINT) & ~host.rlike(r"^\d+\.\d+\.\d+\.\d+$"), host)


def _endpoints(rows: DataFrame, registry: str) -> DataFrame:
    return rows.withColumn("host", endpoint_host(F.col("url"))).filter("host is not null").select("host", F.lit(registry).alias("registry"), "server", "url", "transport")


def official_endpoints(pages: DataFrame, body: str = "body") -> DataFrame:
    """Remotes of the servers on pages of the official registry (JSON text)."""
    server = F.explode(D.items(D.variant(F.col(body)), "$.servers"))
    rows = pages.select(server.alias("e")).select(F.coalesce(F.try_variant_get("e", "$.server", "variant"), "e").alias("s"))
    rows = rows.select(F.coalesce(D.text(F.col("s"), "$.name"), F.lit("")).alias("server"), F.explode(D.items(F.col("s"), "$.remotes")).alias("r"))
    return _endpoints(rows.select("server", D.text(F.col("r"), "$.url").alias("url"), D.text(F.col("r"), "$.type").alias("transport")), "official")


def found_urls(doc: Column, depth: int = URL_DEPTH) -> Column:
    """(key, url) of http(s) strings under keys that name URLs, endpoints or links, at most `depth` levels down."""
    level = F.array(F.struct(F.lit("").alias("key"), doc.alias("value")))
    out = F.array().cast("array<struct<key:string,url:string>>")
    for k in range(depth + 1):
        hits = F.filter(F.transform(level, lambda x: F.struct(x["key"].alias("key"), D.text(x["value"], "$").alias("url"))), lambda x: F.coalesce(x["key"].rlike("(?i)url|endpoint|href") & x["url"].rlike("(?i)^https?://"), F.lit(False)))
        out = F.concat(out, hits)
        if k < depth:
            below = lambda x: F.concat(
                F.transform(D.items(x["value"], "$"), lambda v: F.struct(x["key"].alias("key"), v.alias("value"))),
                F.when(D.is_object(x["value"]), F.transform(F.map_entries(F.try_variant_get(x["value"], "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:variant>>")),
            )
            level = F.flatten(F.transform(level, below))
    return out


def glama_endpoints(pages: DataFrame, body: str = "body") -> DataFrame:
    rows = pages.select(F.explode(D.items(D.variant(F.col(body)), "$.servers")).alias("s"))
    name = F.coalesce(D.text(F.col("s"), "$.slug"), D.text(F.col("s"), "$.name"), D.text(F.col("s"), "$.id"), F.lit(""))
    rows = rows.select(name.alias("server"), F.explode(found_urls(F.col("s"))).alias("u")).filter(~F.col("u.key").rlike(NO_ENDPOINT_KEY))
    return _endpoints(rows.select("server", "u.url", F.when(F.col("u.key").rlike("(?i)sse"), "sse").alias("transport")), "glama")


def smithery_endpoints(details: DataFrame, name: str = "qualified_name", body: str = "body") -> DataFrame:
    """Connections of a server's detail record; its own URL only if it has none."""
    doc = D.variant(F.col(body))
    connections = F.transform(D.items(doc, "$.connections"), lambda c: F.struct(F.coalesce(D.text(c, "$.deploymentUrl"), D.text(c, "$.url")).alias("url"), D.text(c, "$.type").alias("transport")))
    own = F.array(F.struct(D.text(doc, "$.deploymentUrl").alias("url"), F.lit(None).cast("string").alias("transport")))
    rows = details.select(F.col(name).alias("server"), F.explode(F.when(F.size(connections) > 0, connections).otherwise(own)).alias("c"))
    return _endpoints(rows.select("server", "c.url", "c.transport"), "smithery")


def next_cursor(body: Column, registry: str) -> Column:
    doc = D.variant(body)
    if registry == "official":
        return F.nullif(D.text(doc, "$.metadata.nextCursor"), F.lit(""))
    return F.when(D.flag(doc, "$.pageInfo.hasNextPage"), D.text(doc, "$.pageInfo.endCursor"))


def hosts_by_registry(endpoints: DataFrame) -> DataFrame:
    """registry, endpoints, hosts: rows and distinct hosts of each registry."""
    return endpoints.groupBy("registry").agg(F.count("*").alias("endpoints"), F.count_distinct("host").alias("hosts"))


def distinct_hosts(endpoints: DataFrame) -> DataFrame:
    return endpoints.select("host").distinct().orderBy("host")


# ---------------------------------------------------------------------------------------------------------------------
# category labels


def labels_of_answers(hosts: DataFrame, answers: DataFrame, body: str = "body") -> DataFrame:
    """A label for each host asked about in an answer (answer_id): ok, not_found, or error for a failed answer."""
    doc = F.col("_doc")
    parsed = answers.withColumn("_doc", D.variant(F.col(body))).withColumn("_ok", F.coalesce(D.flag(doc, "$.success"), F.lit(False)))
    result = F.when(D.is_array(doc, "$.result"), D.items(doc, "$.result")).otherwise(F.array(F.try_variant_get(doc, "$.result", "variant")))
    items = parsed.filter("_ok").select("answer_id", F.explode(result).alias("i"))
    items = items.select("answer_id", F.regexp_replace(F.lower(D.text(F.col("i"), "$.domain")), r"\.$", "").alias("host"), "i").filter("host is not null")
    category = lambda c: F.struct(D.number(c, "$.id").cast("int").alias("id"), D.text(c, "$.name").alias("name"), D.number(c, "$.super_category_id").cast("int").alias("superCategoryId"))
    items = items.select("answer_id", "host", D.number(F.col("i"), "$.popularity_rank").cast("int").alias("radar_rank"), F.filter(F.transform(D.items(F.col("i"), "$.content_categories"), category), lambda c: F.coalesce(c["name"], F.lit("")) != "").alias("categories"), F.lit(True).alias("_found"))
    items = dedupe(items, ["answer_id", "host"], [F.col("radar_rank")])
    asked = hosts.join(parsed.select("answer_id", "_ok"), "answer_id").join(items, ["answer_id", "host"], "left")
    status = F.when(~F.col("_ok"), "error").when(F.col("_found"), "ok").otherwise("not_found")
    none = F.array().cast("array<struct<id:int,name:string,superCategoryId:int>>")
    return asked.select("host", "rank", status.alias("status"), "radar_rank", F.coalesce("categories", none).alias("categories"), F.lit(LABEL_SOURCE).alias("source"))


def latest_labels(cache: DataFrame, pos: str) -> DataFrame:
    """The last label of each host in an append-only cache; labels of other sources don't count."""
    return dedupe(cache.filter((F.col("source") == LABEL_SOURCE) & F.col("host").isNotNull()), ["host"], [F.desc(pos)])


def category_flags(categories: Column, commerce: str = COMMERCE, fintech: str = FINTECH) -> tuple[Column, Column]:
    any_of = lambda pattern: F.exists(categories, lambda c: c["name"].rlike(pattern))
    return any_of(commerce), any_of(fintech)


def select_corpora(hosts: DataFrame, labels: DataFrame, commerce: str = COMMERCE, fintech: str = FINTECH) -> DataFrame:
    """Hosts with their label's status (`unlabelled` without one) and whether they are in either corpus."""
    c, f = category_flags(F.col("categories"), commerce, fintech)
    both = hosts.join(labels.select("host", "status", "fetched_at", "categories"), "host", "left")
    ok = F.col("status") == "ok"
    return both.withColumns({"status": F.coalesce("status", F.lit("unlabelled")), "commerce": F.coalesce(ok & c, F.lit(False)), "fintech": F.coalesce(ok & f, F.lit(False))})


def category_histogram(selected: DataFrame, pos: str, k: int = 40) -> DataFrame:
    """The most frequent categories, each counted once a host; ties go to the one seen first."""
    from cairnfield.operators.lookups import frequency

    names = selected.filter("status = 'ok'").select(pos, F.explode(F.array_distinct(F.transform("categories", lambda c: c["name"]))).alias("name"))
    return frequency(names, "name", pos, k)


def corpus_counts(selected: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return selected.agg(F.count("*").alias("hosts"), status("ok"), status("not_found"), status("error"), status("unlabelled"), F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last"), F.count_if("commerce").alias("commerce"), F.count_if("fintech").alias("fintech"), F.count_if(F.col("commerce") & F.col("fintech")).alias("overlap"))
