"""Do a host's card and its API description name the same tools, and does its text file link to them?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield import schemas as S
from cairnfield.functions import documents as D
from cairnfield.functions import http as H
from cairnfield.functions import keys as K
from cairnfield.functions import stats
from cairnfield.operators import cards as C
from cairnfield.operators.classify import dedupe


def candidates(results: DataFrame) -> DataFrame:
    """Hosts with a valid card and API description (pair), or a valid text file and one of them (coverage)."""
    valid = lambda names: F.filter("probes", lambda p: p["valid"] & p["artifact"].isin(*names))
    rows = results.withColumn("_cards", valid(S.MCP_CARDS)).withColumn("_api", F.get(valid(S.OPENAPI), F.lit(0))).withColumn("_llms", F.get(valid(("llms_txt",)), F.lit(0)))
    card = F.get("_cards", F.lit(0))
    rows = rows.withColumn("pair", card.isNotNull() & F.col("_api").isNotNull()).withColumn("coverage", F.col("_llms").isNotNull() & (card.isNotNull() | F.col("_api").isNotNull()))
    return rows.filter("pair or coverage").select(
        "host", "rank", card["final_url"].alias("card_url"), card["artifact"].alias("card_artifact"), card["card_spec"].alias("card_spec"),
        F.transform(F.filter("_cards", lambda p, i: i > 0), lambda p: p["final_url"]).alias("card_alt_urls"),
        F.col("_api.final_url").alias("openapi_url"), F.col("_api.artifact").alias("openapi_artifact"), F.col("_llms.final_url").alias("llms_url"), "pair", "coverage",
    )


LINKS = 5  # fixed value: so many links of a kind are looked up


def recheck(found: DataFrame, captures: DataFrame) -> DataFrame:
    """Candidates with what a second capture of their documents holds: statuses, errors, tools, ops, llms, and `match` where both sides parsed.

    captures: url, status, error, body (text), pos; the first capture of a URL counts. Candidate URLs are joined with their
    places, and the tools are those of the first place that lists any; without one, those of the first place.
    """
    got = dedupe(captures, ["url"], [F.col("pos")]).select("url", "status", "error", "body")
    ok = F.col("status") == 200
    pair = F.col("pair") & F.col("card_url").isNotNull() & F.col("openapi_url").isNotNull()
    pairs = found.filter(pair)
    cards = pairs.select("host", F.posexplode(F.concat(F.array("card_url"), F.coalesce("card_alt_urls", F.array().cast("array<string>")))).alias("place", "url"))
    some = lambda c: F.coalesce(~F.col(c).isin("null", '""', "0", "false"), F.lit(False))  # noqa: E731  neither unreadable nor empty
    card = cards.join(got, "url", "left").withColumn("json", D.structured(F.when(ok, F.col("body")), F.lit(False)))
    card = card.withColumn("tools", F.when(some("json"), C.card_tools(D.variant(F.col("json")))))
    main = F.col("place") == 0
    card = card.groupBy("host").agg(
        F.max(F.when(main, F.col("status"))).alias("card_status"),
        F.max(F.when(main, F.col("error"))).alias("card_error"),
        F.bool_or(main & F.coalesce(ok, F.lit(False)) & F.col("tools").isNull()).alias("card_unparseable"),
        F.max(F.when(main & F.col("tools").isNotNull(), F.struct("tools"))).alias("own"),
        F.min(F.when(F.size("tools") > 0, F.struct("place", "url", "tools"))).alias("best"),
    )
    card = card.select("host", "card_status", "card_error", "card_unparseable", F.coalesce("best.tools", "own.tools").alias("tools"), F.when(F.col("best.place") > 0, F.col("best.url")).alias("alt_used"))
    api = pairs.select("host", F.col("openapi_url").alias("url"), (F.col("openapi_artifact") == "openapi_yaml").alias("yaml")).join(got, "url", "left")
    api = api.withColumn("json", D.structured(F.when(ok, F.col("body")), F.col("yaml")))
    api = api.select("host", F.col("status").alias("openapi_status"), F.col("error").alias("openapi_error"), (F.coalesce(ok, F.lit(False)) & ~some("json")).alias("openapi_unparseable"), F.when(some("json"), C.openapi_operations(F.col("json"))).alias("ops"))
    text = found.filter(F.col("coverage") & F.col("llms_url").isNotNull()).select("host", F.col("llms_url").alias("url")).join(got, "url", "left")
    text = text.select("host", F.col("status").alias("llms_status"), F.col("error").alias("llms_error"), F.when(ok, H.llms_links(F.col("body"), F.col("url"))).alias("links"))
    asked = text.select("host", F.explode(F.array(F.struct(F.lit("openapi").alias("kind"), F.slice("links.openapi", 1, LINKS).alias("urls")), F.struct(F.lit("card").alias("kind"), F.slice("links.card", 1, LINKS).alias("urls")))).alias("x")).select("host", "x.kind", F.posexplode("x.urls").alias("n", "url"))
    answered = asked.join(got.select("url", F.col("status").alias("s")), "url", "left").groupBy("host").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("n", F.coalesce(F.col("s") == 200, F.lit(False)).alias("ok"))))).alias(k) for k in ("openapi", "card")])
    flags = lambda k: F.coalesce(F.transform(k, lambda x: x["ok"]), F.array().cast("array<boolean>"))
    llms = text.join(answered, "host", "left").select("host", "llms_status", "llms_error", F.when(F.col("links").isNotNull(), F.struct("links.openapi", "links.card", "links.total", flags("openapi").alias("openapi_resolves"), flags("card").alias("card_resolves"))).alias("llms"))
    joined = found.join(card, "host", "left").join(api, "host", "left").join(llms, "host", "left")
    said = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}:"), F.col(c)))
    lost = lambda name, c: F.when(F.col(c), F.lit(f"{name}:unparseable"))
    errors = F.array_compact(F.array(said("card", "card_error"), said("openapi", "openapi_error"), lost("card", "card_unparseable"), lost("openapi", "openapi_unparseable"), said("llms", "llms_error")))
    both = F.col("tools").isNotNull() & F.col("ops").isNotNull()
    legacy = F.col("alt_used").rlike(r"/mcp/server-card\.json$")
    rows = joined.withColumns({"errors": errors, "card_used_alt": F.col("alt_used").isNotNull(), "card_spec": F.when(legacy, "sep-1649").otherwise(F.col("card_spec")), "card_url": F.coalesce("alt_used", "card_url"), "card_lists_no_tools": F.when(both, F.size("tools") == 0), "openapi_has_no_ops": F.when(both, F.size("ops") == 0)})
    matched = match_pairs(rows)
    return matched.withColumn("match", F.when(both, F.col("match"))).drop("card_error", "openapi_error", "llms_error", "card_unparseable", "openapi_unparseable", "alt_used")


def match_pairs(rows: DataFrame) -> DataFrame:
    """Adds `match` to rows with tools (array of names) and ops (array of structs with key, operation_id): strict and loose key sets and their overlap."""
    tools, ops = F.col("tools"), F.transform("ops", lambda o: o["key"])
    strict_t, strict_o = F.array_distinct(F.transform(tools, K.strict_key)), F.array_distinct(F.transform(ops, K.strict_key))
    loose_t, loose_o = F.array_distinct(F.transform(tools, K.loose_key)), F.array_distinct(F.transform(ops, K.loose_key))
    return rows.withColumn(
        "match",
        F.struct(
            F.size(tools).alias("n_tools"),
            F.size(ops).alias("n_ops"),
            F.size(F.array_intersect(strict_t, strict_o)).alias("matched_strict"),
            F.size(F.array_intersect(loose_t, loose_o)).alias("matched_loose"),
            K.jaccard(strict_t, strict_o).alias("jaccard_strict"),
            K.jaccard(loose_t, loose_o).alias("jaccard_loose"),
            F.filter(tools, lambda t: ~F.array_contains(loose_o, K.loose_key(t))).alias("unmatched_tools"),
        ),
    )


def nearest_operations(tools: DataFrame, ops: DataFrame, group: str = "host") -> DataFrame:
    """For every tool (group, tool_pos, tool) the operation (group, op_pos, op) with the largest share of common words; the first of equals, null without overlap.

    Names with the same words are one on either side (the first operation stands for all); words are exploded and joined
    within a group, so only pairs of different sets that share a word are made.
    """
    words = lambda c: F.array_sort(F.array_distinct(K.tokens(F.col(c))))
    every = tools.select(group, "tool_pos", words("tool").alias("_words")).withColumn("_set", F.xxhash64(F.array_join("_words", " ")))
    t = every.groupBy(group, "_set").agg(F.first("_words").alias("_words")).withColumnRenamed("_set", "tool_set")
    o = ops.select(group, "op_pos", words("op").alias("_words")).groupBy(group, "_words").agg(F.min("op_pos").alias("op_pos"))
    shared = (
        t.select(group, "tool_set", F.size("_words").alias("nt"), F.explode("_words").alias("w"))
        .join(o.select(group, "op_pos", F.size("_words").alias("no"), F.explode("_words").alias("w")), [group, "w"])
        .groupBy(group, "tool_set", "op_pos")
        .agg(F.count("*").alias("both"), F.first("nt").alias("nt"), F.first("no").alias("no"))
    )
    score = F.col("both") / F.greatest("nt", "no")
    best = shared.groupBy(group, F.col("tool_set").alias("_set")).agg(F.max(F.struct(score.alias("overlap"), (-F.col("op_pos")).alias("neg"))).alias("b")).select(group, "_set", F.col("b.overlap").alias("overlap"), (-F.col("b.neg")).alias("op_pos"))
    best = every.select(group, "tool_pos", "_set").join(best, [group, "_set"]).drop("_set")
    found = tools.join(best, [group, "tool_pos"], "left").join(ops.select(group, "op_pos", F.col("op").alias("best_op")), [group, "op_pos"], "left")
    return found.withColumn("overlap", F.round(F.coalesce("overlap", F.lit(0.0)), 2)).drop("op_pos")


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts, medians and shares over consistency results (pair, match, coverage, llms)."""
    m = F.col("match")
    fetched = F.col("pair") & m.isNotNull()
    scored = fetched & (m["n_tools"] > 0) & (m["n_ops"] > 0)
    unmatched = F.size(m["unmatched_tools"])
    links = F.col("llms").isNotNull() & F.col("coverage")
    api, card = links & (F.size("llms.openapi") > 0), links & (F.size("llms.card") > 0)
    resolves = F.exists(F.coalesce("llms.openapi_resolves", F.array().cast("array<boolean>")), lambda x: x) | F.exists(F.coalesce("llms.card_resolves", F.array().cast("array<boolean>")), lambda x: x)
    share = {"median_loose": m["jaccard_loose"], "median_strict": m["jaccard_strict"], "median_unmatched_share": stats.ratio(unmatched, m["n_tools"])}
    values = rows.filter(scored).select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in share.items()])).alias("x")).select("x.*")
    middle = stats.medians(values, "name", "value").agg(*[F.max(F.when(F.col("name") == k, F.col("mean_median"))).alias(k) for k in share])
    counts = rows.agg(
        F.count_if("pair").alias("pairs"),
        F.count_if(fetched).alias("fetched"),
        F.count_if(fetched & (m["n_tools"] == 0)).alias("no_tools"),
        F.count_if(fetched & (m["n_ops"] == 0)).alias("no_ops"),
        F.count_if(scored).alias("scored"),
        F.count_if(scored & (m["jaccard_loose"] == 0)).alias("loose_zero"),
        F.count_if(scored & (m["jaccard_loose"] == 1)).alias("loose_one"),
        F.sum(F.when(scored, unmatched)).alias("unmatched"),
        F.sum(F.when(scored, m["n_tools"])).alias("tools"),
        F.count_if("coverage").alias("coverage"),
        F.count_if(links).alias("llms_fetched"),
        F.count_if(api).alias("link_openapi"),
        F.count_if(card).alias("link_card"),
        F.count_if(api | card).alias("link_any"),
        F.count_if((api | card) & resolves).alias("link_resolves"),
    )
    # a row each
    return counts.withColumn("_k", F.lit(1)).join(F.broadcast(middle.withColumn("_k", F.lit(1))), "_k").drop("_k")
