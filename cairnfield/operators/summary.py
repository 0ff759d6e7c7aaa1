"""Prevalence, platform breakdowns and two-snapshot comparison of host results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield import schemas as S
from cairnfield.functions import stats
from cairnfield.functions import text as T
from cairnfield.operators.classify import long_probes, with_class


def class_counts(results: DataFrame) -> DataFrame:
    return with_class(results).groupBy("host_class").agg(F.count("*").alias("hosts"))


def prevalence(results: DataFrame, specs: DataFrame) -> DataFrame:
    """Counts for each canonical path (zeros included) with Wilson intervals over reachable hosts; other paths don't count."""
    rows = long_probes(with_class(results), "host_class").drop("pos", "artifact")
    valid = F.coalesce("valid", F.lit(False))
    counted = rows.join(F.broadcast(specs), "path").groupBy("path").agg(
        F.count_if(valid).alias("valid_all"),
        F.count_if(valid & (F.col("host_class") == "reachable")).alias("valid_reachable"),
        F.count_if(F.col("status") == 200).alias("status_200"),
        F.count_if("soft404").alias("soft404"),
        F.count_if((F.col("status") == 200) & ~F.coalesce("soft404", F.lit(False)) & ~valid).alias("invalid"),
        F.count_if(valid & F.col("cross_origin_hit")).alias("cross_origin"),
        F.count_if(valid & F.col("www_redirect")).alias("www"),
        F.count_if(F.array_contains("reasons", "soft404:hash_near_dup")).alias("near_dup"),
        F.count_if(F.array_contains("reasons", "soft404:html_content_type")).alias("html_type"),
    )
    hosts = with_class(results).agg(F.count("*").alias("hosts"), F.count_if(F.col("host_class") == "reachable").alias("reachable"))
    measures = [c for c in counted.columns if c != "path"]
    table = specs.select("pos", "path", "artifact").join(counted, "path", "left").fillna(0, measures).withColumn("_k", F.lit(1))
    table = table.join(F.broadcast(hosts.withColumn("_k", F.lit(1))), "_k").drop("_k")
    low, high = stats.wilson(F.col("valid_reachable"), F.col("reachable"))
    return table.withColumns({"wilson_low": low, "wilson_high": high})


def host_flags(results: DataFrame) -> DataFrame:
    """Per host: class, any valid document, any valid card, and the groups that the platform table counts."""
    ok = lambda p: F.coalesce(p["valid"], F.lit(False))
    some = lambda names: F.exists("probes", lambda p: ok(p) & p["artifact"].isin(*names))
    return with_class(results).select(
        "host", "host_class", F.coalesce("fingerprint.primary", F.lit("unknown")).alias("platform"), F.coalesce("fingerprint.cdn", F.lit("none")).alias("cdn"), "fingerprint.platforms", "fingerprint.hints", "mcp_card_path",
        F.exists("probes", ok).alias("any_valid"), some(S.CARDS).alias("any_card"), F.exists("probes", lambda p: ok(p) & (p["path"] == "/llms.txt")).alias("llms"),
        some(S.OPENAPI).alias("openapi"), some(S.OAUTH).alias("oauth"), F.col("blocked.blocked").alias("is_blocked"),
    )


def platform_table(results: DataFrame) -> DataFrame:
    return host_flags(results).groupBy("platform").agg(
        F.count("*").alias("hosts"), F.count_if("llms").alias("llms"), F.count_if("openapi").alias("openapi"), F.count_if("any_card").alias("cards"), F.count_if("oauth").alias("oauth"), F.count_if("is_blocked").alias("blocked")
    )


def valid_by_artifact(probes: DataFrame) -> DataFrame:
    return probes.groupBy("artifact").agg(F.count_if("valid").alias("valid"))


def any_valid(results: DataFrame) -> DataFrame:
    reach = F.col("host_class") == "reachable"
    return host_flags(results).agg(F.count_if(reach).alias("reachable"), F.count_if(reach & F.col("any_valid")).alias("any_valid"), F.count_if(reach & F.col("any_card")).alias("any_card"))


def label_counts(results: DataFrame) -> DataFrame:
    """Edge, platform, hint, card-path and card-draft labels (kind, label, n)."""
    flags = host_flags(results)
    reach = flags.filter("host_class = 'reachable'")
    specs = long_probes(with_class(results), "host_class").filter("host_class = 'reachable' and valid and card_spec is not null")
    rows = flags.select(F.lit("cdn").alias("kind"), F.col("cdn").alias("label"))
    for extra in (
        flags.select(F.lit("platform").alias("kind"), F.explode("platforms").alias("label")),
        flags.select(F.lit("hint").alias("kind"), F.explode("hints").alias("label")),
        reach.filter("mcp_card_path is not null").select(F.lit("card_path").alias("kind"), F.col("mcp_card_path").alias("label")),
        specs.select(F.lit("card_spec").alias("kind"), F.col("card_spec").alias("label")),
    ):
        rows = rows.unionByName(extra)
    return rows.groupBy("kind", "label").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------------------------------------------------
# two snapshots


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    pick = lambda d, n: with_class(d).select("host", F.col("host_class").alias(f"class_{n}"), F.col("probes").alias(f"probes_{n}"))
    return pick(a, "a").join(pick(b, "b"), "host")


def class_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b).groupBy("class_a", "class_b").agg(F.count("*").alias("hosts"))


def blocked_once(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hosts that are blocked in exactly one snapshot."""
    blocked = lambda n: F.col(f"class_{n}") == "blocked"
    return _both(a, b).filter(blocked("a") != blocked("b")).select("host", F.when(blocked("a"), "a").otherwise("b").alias("blocked_at"))


def path_agreement(a: DataFrame, b: DataFrame, specs: DataFrame) -> DataFrame:
    """Validity by path over hosts reachable in both snapshots."""
    both = _both(a, b).filter("class_a = 'reachable' and class_b = 'reachable'")
    paths = F.array(*[F.lit(p) for _, p, *_ in S.PROBE_SPECS])
    valid = lambda n, path: F.exists(f"probes_{n}", lambda p: (p["path"] == path) & F.coalesce(p["valid"], F.lit(False)))
    rows = both.select(F.explode(F.transform(paths, lambda p: F.struct(p.alias("path"), valid("a", p).alias("a"), valid("b", p).alias("b")))).alias("x")).select("x.*")
    a_, b_ = F.col("a"), F.col("b")
    counted = rows.groupBy("path").agg(F.count_if(a_ & b_).alias("both_valid"), F.count_if(a_ & ~b_).alias("a_only"), F.count_if(~a_ & b_).alias("b_only"), F.count_if(~a_ & ~b_).alias("neither"), F.count("*").alias("n"))
    table = specs.select("pos", "path").join(counted, "path", "left").fillna(0)
    both_or_none = F.col("both_valid") + F.col("neither")
    return table.select("path", "both_valid", "a_only", "b_only", "neither", (both_or_none / F.greatest("n", F.lit(1))).alias("agreement"), (F.col("both_valid") + F.col("a_only") + F.col("b_only")).alias("union_valid"))


def any_artifact(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hosts reachable in both with any valid document but security.txt, and probes whose final origins differ."""
    both = _both(a, b).filter("class_a = 'reachable' and class_b = 'reachable'")
    some = lambda n: F.exists(f"probes_{n}", lambda p: F.coalesce(p["valid"], F.lit(False)) & (p["path"] != S.SECURITY_PATH))
    urls = lambda n: F.map_from_entries(F.transform(f"probes_{n}", lambda p: F.struct(p["path"], p["final_url"])))
    differ = F.size(F.filter("probes_a", lambda p: F.coalesce((p["final_url"] != "") & (F.try_element_at(F.col("_urls"), p["path"]) != "") & (T.origin(p["final_url"]) != T.origin(F.try_element_at(F.col("_urls"), p["path"]))), F.lit(False))))
    rows = both.withColumn("_urls", urls("b")).select(some("a").alias("a"), some("b").alias("b"), differ.alias("differ"))
    return rows.agg(F.count_if("a").alias("a"), F.count_if("b").alias("b"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") | F.col("b")).alias("any"), F.coalesce(F.sum("differ"), F.lit(0)).alias("cross_origin_disagreements"))
