"""Trials of agents against access logs: interval joins, scores by agent and cell, clustered bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield import schemas as S
from cairnfield.functions import http as H
from cairnfield.functions import prng
from cairnfield.functions import text as T
from cairnfield.operators import sweep
from cairnfield.operators.lookups import numbered

SLACK_MS = 60_000
BUCKET_MS = 3_600_000


def _hosts(host: Column) -> Column:
    """The domains that a logged host may stand for: itself, and without a leading www."""
    return F.array_distinct(F.array(host, F.regexp_replace(host, r"^www\.", "")))


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def window_hits(trials: DataFrame, hits: DataFrame, *, slack_ms: int = SLACK_MS, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of trials and hits inside the trial's window, widened by the slack; both ends count.

    Hits with a host meet trials of that domain, dealt over time buckets, so the join is on equal keys; those
    without meet all trials, by a sweep along the time.
    """
    lo, hi = F.col("start_ms") - slack_ms, F.col("end_ms") + slack_ms
    t = trials.filter(hi >= lo).withColumn("_bucket", F.explode(_buckets(lo, hi, bucket_ms)))
    h = hits.withColumn("_bucket", F.floor(F.col("ts") / bucket_ms)).withColumnRenamed("host", "hit_host").withColumnRenamed("status", "hit_status")
    inside = (F.col("ts") >= lo) & (F.col("ts") <= hi)
    known = h.filter(F.col("hit_host").isNotNull()).withColumn("domain", F.explode(_hosts(F.col("hit_host"))))
    by_host = t.join(known, ["domain", "_bucket"]).filter(inside)
    nowhere = h.filter(F.col("hit_host").isNull()).drop("_bucket")
    if nowhere.isEmpty():
        return by_host.drop("_bucket")
    by_time = sweep.in_windows(trials, nowhere, lo, hi, F.col("ts"))
    return by_host.drop("_bucket").unionByName(by_time)


def unplaced_totals(trials: DataFrame, hits: DataFrame, total: Column, *, slack_ms: int = SLACK_MS) -> DataFrame:
    """Trials with hits without a host inside of the widened window: their number `hits`, and the sum `total` of a column of longs over them; no pair is made."""
    lo, hi = F.col("start_ms") - slack_ms, F.col("end_ms") + slack_ms
    return sweep.totals(trials.filter(hi >= lo), hits.filter(F.col("host").isNull()), lo, hi, F.col("ts"), total)


def artifact_of(path: Column) -> Column:
    """The kind of document at a path; null at others."""
    out = F.when(F.lit(False), "")
    for key, paths in S.ARTIFACT_PATHS.items():
        out = out.when(path.isin(*paths), key)
    return out


def in_answer(answer: Column, tokens: Column) -> Column:
    """Kinds whose token the answer contains, in any case and with any separators; none for a domain without tokens."""
    norm = lambda c: T.trim(F.regexp_replace(F.lower(c), r"[\s_\-]+", " "))
    kinds = F.array(*[F.lit(k) for k in S.ARTIFACT_PATHS])
    return F.filter(kinds, lambda k: F.coalesce(F.contains(norm(answer), norm(F.try_element_at(tokens, k))), F.lit(False)))


def score_trials(manifest: DataFrame, trials: DataFrame, hits: DataFrame, *, slack_ms: int = SLACK_MS) -> DataFrame:
    """One row for each trial: its cell, the kinds of documents fetched in its window, reported and quoted."""
    keyed = trials.withColumn("_id", F.xxhash64("agent", "domain", "task_id", "start_ms", "end_ms", F.coalesce("answer", F.lit(""))))
    found = window_hits(keyed.select("_id", "domain", "start_ms", "end_ms").distinct(), hits.withColumn("artifact", artifact_of(F.col("path"))).filter(F.col("artifact").isNotNull()), slack_ms=slack_ms)
    fetched = found.groupBy("_id").agg(*[F.bool_or(F.col("artifact") == k).alias(f"fetched_{k}") for k in S.ARTIFACT_PATHS], F.count("*").alias("n_hits"))
    paths = [p for group in S.ARTIFACT_PATHS.values() for p in group]
    host = lambda u: T.hostname(u)
    reported = F.exists("reported_urls", lambda u: F.coalesce(((host(u) == F.col("domain")) | (host(u) == F.concat(F.lit("www."), "domain"))) & T.path(u).isin(*paths), F.lit(False)))
    no = F.lit(False)
    cells = manifest.select("domain", "cell_label", "tokens")
    out = keyed.join(fetched, "_id", "left").join(cells, "domain", "left")
    return out.select(
        "agent", "domain", "task_id", "start_ms", "end_ms", "error", F.coalesce("cell_label", F.lit("unknown")).alias("cell"),
        *[F.coalesce(f"fetched_{k}", no).alias(f"fetched_{k}") for k in S.ARTIFACT_PATHS],
        F.greatest(*[F.coalesce(f"fetched_{k}", no) for k in S.ARTIFACT_PATHS]).alias("fetched_any"),
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce(reported, no).alias("reported_artifact"),
        in_answer(F.coalesce("answer", F.lit("")), F.col("tokens")).alias("canary_in_answer"),
    )


def overlapping(trials: DataFrame, id_col: str, *, slack_ms: int = SLACK_MS, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of trials on one domain whose widened windows touch (a before b by id), each once.

    The pair is made in the bucket in which the later of the two windows starts.
    """
    lo, hi = F.col("start_ms") - slack_ms, F.col("end_ms") + slack_ms
    t = trials.select(id_col, "domain", lo.alias("lo"), hi.alias("hi")).filter("hi >= lo")
    t = t.withColumn("bucket", F.explode(_buckets(F.col("lo"), F.col("hi"), bucket_ms)))
    a, b = t.alias("a"), t.alias("b")
    touch = (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi")) & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}"))
    once = F.col("a.bucket") == F.floor(F.greatest("a.lo", "b.lo") / bucket_ms)
    joined = a.join(b, (F.col("a.domain") == F.col("b.domain")) & (F.col("a.bucket") == F.col("b.bucket")) & touch & once)
    return joined.select(F.col("a.domain").alias("domain"), F.col(f"a.{id_col}").alias("a_id"), F.col(f"b.{id_col}").alias("b_id"))


def tabulate(scored: DataFrame) -> DataFrame:
    """Counts by agent, by agent and cell, and by agent and task (`level` tells which); errored trials count only as errors."""
    good = F.coalesce("error", F.lit("")) == ""
    quoted = F.size("canary_in_answer") > 0
    measures = [
        F.count_if(good).alias("n"),
        F.count_if(~good).alias("errors"),
        F.count_if(good & F.col("fetched_llms")).alias("fetched_llms"),
        F.count_if(good & F.col("fetched_card")).alias("fetched_card"),
        F.count_if(good & F.col("fetched_any")).alias("fetched_any"),
        F.count_if(good & F.col("reported_artifact")).alias("reported_artifact"),
        F.count_if(good & quoted & F.col("cell").endswith("/canary")).alias("canary"),
        F.count_if(good & quoted & F.col("cell").endswith("/control")).alias("false_positive_controls"),
    ]
    sets = scored.groupingSets([["agent"], ["agent", "cell"], ["agent", "task_id"]], "agent", "cell", "task_id").agg(*measures, F.grouping("cell").alias("gc"), F.grouping("task_id").alias("gt"))
    level = F.when(F.col("gc") == 0, "cell").when(F.col("gt") == 0, "task").otherwise("agent")
    return sets.withColumn("level", level).drop("gc", "gt").filter((F.col("level") == "agent") | (F.col("n") > 0))


def clustered_interval(rows: DataFrame, cluster: str, value: str, pos: str, *, group: list[str] | None = None, reps: int = 2000, seed: int = 1) -> DataFrame:
    """Percentile interval (2.5 %, 97.5 %) of the share of true values, by resampling clusters in order of first appearance.

    Draws depend on their number alone, so all repetitions are made side by side;
    clusters are counted first, and only repetitions times clusters rows are made. Null with fewer than two clusters.
    """
    group = group or []
    per = rows.groupBy(*group, cluster).agg(F.count_if(F.col(value)).alias("k"), F.count("*").alias("n"), F.min(pos).alias("first"))
    # places in order of first appearance come from a range sort, so no task holds all clusters
    placed = numbered(per.withColumn("_g", F.xxhash64(F.struct(*group)) if group else F.lit(0)), [F.col("_g"), F.col("first"), F.col(cluster)])
    ends = placed.groupBy("_g").agg(F.min("_pos").alias("_first"), F.count("*").alias("g"))
    cells = placed.join(ends, "_g").select(*group, (F.col("_pos") - F.col("_first")).cast("int").alias("j"), "g", "k", "n")
    draws = cells.filter("j = 0 and g >= 2").select(*group, "g").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    drawn = draws.withColumn("j", F.floor(prng.draw(seed, F.col("rep").cast("bigint") * F.col("g") + F.col("i") + 1) * F.col("g")).cast("int"))
    keys = [*group, "j"]
    picked = drawn.join(cells.drop("g"), keys)
    estimates = picked.groupBy(*group, "rep").agg(F.coalesce(F.try_divide(F.sum("k").cast("double"), F.sum("n").cast("double")), F.lit(0.0)).alias("est"))
    low, high = int(0.025 * reps), min(reps - 1, int(0.975 * reps))
    ends = F.array_sort(F.collect_list("est"))
    found = estimates.groupBy(*group).agg(F.get(ends, F.lit(low)).alias("ci_low"), F.get(ends, F.lit(high)).alias("ci_high"))
    totals = per.groupBy(*group).agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("clusters"))
    if group:
        return totals.join(found, group, "left")
    return totals.withColumn("_one", F.lit(1)).join(F.broadcast(found.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")


def known_tasks(tasks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tasks on domains of the manifest."""
    return tasks.join(manifest.select("domain").distinct(), "domain", "left_semi")


CELLS = ((True, True), (False, True), (True, False), (False, False))  # fixed values: (linked, canary) in turn


def assigned(domains: DataFrame, seed: int, pos: str = "pos") -> DataFrame:
    """place, domain, linked, canary, cell of an experiment's own domains (domain, and its position): cells in turn over a seeded shuffle of the distinct ones, so their sizes differ by one at most."""
    name = F.lower(F.trim("domain"))
    known = domains.select(name.alias("domain"), F.col(pos).alias("pos")).filter("domain <> ''").groupBy("domain").agg(F.min("pos").alias("pos"))
    placed = numbered(known, [F.col("pos"), F.col("domain")], "_n").withColumn("item", F.col("_n") - 1)
    turn = prng.shuffled(domains.sparkSession, placed.count(), seed)
    cells = F.array(*[F.struct(F.lit(a).alias("linked"), F.lit(b).alias("canary"), F.lit(f"{'linked' if a else 'unlinked'}/{'canary' if b else 'control'}").alias("cell")) for a, b in CELLS])
    return placed.join(turn, "item").withColumn("_c", F.get(cells, (F.col("place") % len(CELLS)).cast("int"))).select("place", "domain", "_c.linked", "_c.canary", "_c.cell")


def hit_context(trials: DataFrame, hits: DataFrame, *, slack_ms: int = SLACK_MS) -> DataFrame:
    """Hits on documents by user-agent product, inside any window and outside of all."""
    keyed = hits.filter(artifact_of(F.col("path")).isNotNull()).withColumn("_hit", F.xxhash64("host", "ts", "path", "ua", "status"))
    inside = window_hits(trials.select("domain", "start_ms", "end_ms"), keyed, slack_ms=slack_ms).select("_hit").distinct()
    marked = keyed.join(inside.withColumn("_in", F.lit(True)), "_hit", "left")
    return marked.groupBy(F.coalesce("_in", F.lit(False)).alias("in_window"), H.ua_product(F.col("ua")).alias("product")).agg(F.count("*").alias("n"))
