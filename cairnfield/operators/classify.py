"""Classes of hosts and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield import schemas as S
from cairnfield.functions import http as H
from cairnfield.functions import simhash as SH
from cairnfield.functions import text as T
from cairnfield.operators import validate as V

STRUCTURED = ("json", "openapi", "markdown")
#: Signals that count towards a block; in a tie the earlier stands first, then the one seen first.
NUMERIC_SIGNALS = ("403", "429")
BLOCK_SIGNALS = (*NUMERIC_SIGNALS, "challenge", "reset")
UNREACHABLE_SIGNALS = ("dns", "timeout", "refused", "tls", "other", "cross_domain_redirect", "too_many_redirects", "decode_error", "body_too_large")


def host_class(blocked: Column, redirect_only: Column) -> Column:
    """proxy_denied, blocked, redirect_only, unreachable or reachable; the last is the denominator of prevalence."""
    reason = F.coalesce(blocked["reason"], F.lit(""))
    return (
        F.when(blocked["blocked"] & reason.startswith("proxy_denied"), "proxy_denied")
        .when(blocked["blocked"], "blocked")
        .when(redirect_only, "redirect_only")
        .when(reason.startswith("unreachable"), "unreachable")
        .otherwise("reachable")
    )


def with_class(results: DataFrame) -> DataFrame:
    return results.withColumn("host_class", host_class(F.col("blocked"), F.col("redirect_only")))


def classify_probes(responses: DataFrame, specs: DataFrame) -> DataFrame:
    """Captured probes (kind `probe`) of canonical paths, classified against their host's captures of nonexistent paths (kind `nx`).

    A 200 is a soft 404 if its body is near one of the live baselines, or if it is
    HTML where structured content is expected; what remains is validated.
    """
    text = F.coalesce(H.body_text(F.col("body")), F.lit(""))
    base = responses.withColumn("text", text).withColumn("simhash", SH.simhash(F.col("text")))
    live = F.when((F.col("kind") == "nx") & (F.col("status") == 200) & (F.col("bytes") > 0), F.struct("sha256", "simhash"))
    # baselines and probes of a host meet in a window, so that each text is hashed once
    base = base.withColumn("live", F.collect_list(live).over(Window.partitionBy("host", "vantage")))
    probes = base.filter(F.col("kind") == "probe").withColumnRenamed("kind", "capture").join(F.broadcast(specs), "path")
    ok = (F.coalesce(F.col("error"), F.lit("")) != "proxy_denied") & (F.col("status") == 200)
    near = F.when(ok & (F.col("bytes") > 0), F.array_max(F.transform("live", lambda b: SH.similarity(F.col("simhash"), b["simhash"]))))
    equal = F.exists(F.col("live"), lambda b: b["sha256"] == F.col("sha256"))
    mime = T.media_type(F.col("content_type"))
    html = (mime == "text/html") | ((mime == "") & T.looks_like_html(F.col("text")))
    probes = probes.withColumn("nx_similarity", near).withColumns(
        {
            "near_dup": F.coalesce(F.col("nx_similarity").isNotNull() & (equal | (F.col("nx_similarity") >= SH.THRESHOLD)), F.lit(False)),
            "html_dup": ok & F.col("kind").isin(*STRUCTURED) & html,
        }
    )
    probes = probes.withColumn("soft404", F.col("near_dup") | F.col("html_dup"))
    check = ok & (F.col("bytes") > 0) & ~F.col("soft404")
    probes = V.with_outcome(probes.withColumn("checked", check))
    no = F.lit(None).cast("string")
    failed = (F.coalesce(F.col("error"), F.lit("")) != "proxy_denied") & (F.col("status") > 0) & (F.col("status") != 200)
    reasons = F.concat(
        F.array_compact(
            F.array(
                F.when(F.col("error").isNotNull(), F.concat(F.lit("error:"), "error")),
                F.when(F.col("near_dup"), "soft404:hash_near_dup"),
                F.when(F.col("html_dup"), "soft404:html_content_type"),
                F.when(ok & (F.col("bytes") == 0), "empty_body"),
            )
        ),
        F.when(F.col("checked"), F.col("outcome.reasons")).otherwise(F.array().cast("array<string>")),
        F.array_compact(
            F.array(
                F.when(failed, F.concat(F.lit("status:"), F.col("status").cast("string"))),
                F.when(failed & (F.col("error") == "cross_domain_redirect"), F.concat(F.lit("redirect_to:"), "final_url")),
                F.when(F.col("cross_origin_hit"), F.concat(F.lit("cross_origin_hit:"), T.origin(F.col("final_url")))),
                F.when(F.col("www_redirect"), F.concat(F.lit("www_redirect:"), T.origin(F.col("final_url")))),
            )
        ),
    )
    challenged = H.challenge(F.col("status"), F.col("headers"), F.col("text"))
    return probes.select(
        "host", "vantage", "pos", "path", "artifact", "status", "final_url", "content_type", "bytes", "sha256", "redirects", "cross_origin_hit", "www_redirect", "elapsed_ms", "error",
        SH.as_hex(F.col("simhash")).alias("simhash"), "nx_similarity", "soft404",
        F.coalesce(F.col("checked") & F.col("outcome.valid"), F.lit(False)).alias("valid"),
        F.when(F.col("checked"), F.col("outcome.card_spec")).otherwise(no).alias("card_spec"),
        H.header(F.col("headers"), "strict-transport-security").alias("hsts"), H.header(F.col("headers"), "cache-control").alias("cache_control"),
        reasons.alias("reasons"), challenged.alias("challenge"), "text",
    )


def outcome_key(status: Column, error: Column, challenge: Column) -> Column:
    """The signal for which a request counts."""
    return F.when(error == "proxy_denied", "proxy_denied").when(challenge, "challenge").when(status == 0, F.coalesce(error, F.lit("error"))).otherwise(status.cast("string"))


def blocked(outcomes: DataFrame) -> DataFrame:
    """host, blocked struct from requests (host, seq, status, error, challenge): baselines first, then canonical order.

    More than half of the requests decide: the crawler's own proxy, then signals of
    a block, then signals of an unreachable host.
    """
    keyed = outcomes.withColumn("key", outcome_key(F.col("status"), F.col("error"), F.col("challenge")))
    counts = keyed.groupBy("host", "key").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    zero = (F.col("key") == "error") | F.col("key").isin(*UNREACHABLE_SIGNALS)
    # integer-like keys stand before others, in ascending order; then the one seen first
    place = F.struct(F.col("n"), (-(F.when(F.col("key").isin(*NUMERIC_SIGNALS), F.col("key").cast("bigint") - 1000).otherwise(F.col("first")))).alias("place"))
    agg = counts.groupBy("host").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("counts"),
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("key") == "proxy_denied", F.col("n")).otherwise(0)).alias("denied"),
        F.sum(F.when(F.col("key").isin(*BLOCK_SIGNALS), F.col("n")).otherwise(0)).alias("signals"),
        F.sum(F.when(zero, F.col("n")).otherwise(0)).alias("dead"),
        F.max_by(F.when(F.col("key").isin(*BLOCK_SIGNALS), F.col("key")), F.when(F.col("key").isin(*BLOCK_SIGNALS), place)).alias("top_block"),
        F.max_by(F.when(zero, F.col("key")), F.when(F.col("key").isin(*UNREACHABLE_SIGNALS), place)).alias("top_dead"),
    )

    def on(n: str) -> Column:
        return F.concat(F.lit(" on "), F.col(n).cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" probes"))

    is_denied, is_blocked, is_dead = (F.col(c) * 2 > F.col("total") for c in ("denied", "signals", "dead"))
    reason = (
        F.when(is_denied, F.concat(F.lit("proxy_denied (crawler egress policy, not target)"), on("denied")))
        .when(is_blocked, F.concat("top_block", on("signals")))
        .when(is_dead, F.concat(F.lit("unreachable:"), F.coalesce("top_dead", F.lit("error")), on("dead")))
    )
    return agg.select("host", F.struct((is_denied | is_blocked).alias("blocked"), reason.alias("reason"), "counts").alias("blocked"))


def redirect_only(outcomes: DataFrame) -> DataFrame:
    """host, redirect_only: every request left the registrable domain."""
    return outcomes.groupBy("host").agg(F.every(F.coalesce(F.col("error") == "cross_domain_redirect", F.lit(False))).alias("redirect_only"))


def first_valid_card(probes: DataFrame) -> DataFrame:
    """host, mcp_card_path: the first valid tool-server card in canonical order."""
    cards = probes.filter(F.col("valid") & F.col("artifact").isin(*S.MCP_CARDS))
    return cards.groupBy("host").agg(F.min_by("path", "pos").alias("mcp_card_path"))


def nest_probes(probes: DataFrame) -> DataFrame:
    """One row for each host with its probes as an array in canonical order."""
    fields = [F.col(c) if c in probes.columns else F.lit(None).alias(c) for c in ("pos", *(f.name for f in S.struct(S.HOST_RESULTS)["probes"].dataType.elementType.fields))]
    return probes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("probes"))


def long_probes(results: DataFrame, *keep: str) -> DataFrame:
    """Probes of nested results, a row each."""
    return results.select("host", *keep, F.posexplode("probes").alias("pos", "p")).select("host", *keep, "pos", "p.*")


def dedupe(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; with descending order the last. Spark keeps one row of a key in each task before the shuffle (a group limit on the window)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
