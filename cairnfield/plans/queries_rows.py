"""Queries on keys, ranks, samples, scores, trials and logs, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnfield.functions import keys as K
from cairnfield.functions import prng, simhash, stats
from cairnfield.functions import text as T
from cairnfield.operators import consistency, corpora, experiment, lookups, near, sampling, search
from cairnfield.plans import views as V
from cairnfield.sources import readers
from cairnfield.streaming import hits as stream_hits

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


BANDS = ["1-100", "100-500", "500-1k", "1k-100k"]
#: Ranked domains: subdomains of shared names under one- and two-level suffixes, addresses and single labels.
_RANKED = """(SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INT AS rank, c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'n' || c_custkey WHEN c_custkey % 50 = 1 THEN '10.0.0.' || (c_custkey % 250)
 ELSE CASE c_custkey % 3 WHEN 0 THEN 'www.' WHEN 1 THEN '' ELSE 'a.b.' END || 'n' || (c_custkey * 7 % 400) || CASE c_custkey % 4 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.github.io' ELSE '.com' END END AS domain FROM customer)"""


def _ranked(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select("c_acctbal", "c_custkey")
    placed = lookups.numbered(c, [F.desc("c_acctbal"), F.col("c_custkey")], "rank")
    k = F.col("c_custkey")
    front = F.when(k % 3 == 0, "www.").when(k % 3 == 1, "").otherwise("a.b.")
    tail = F.when(k % 4 == 0, ".co.uk").when(k % 4 == 1, ".github.io").otherwise(".com")
    domain = F.when(k % 50 == 0, F.concat(F.lit("n"), k)).when(k % 50 == 1, F.concat(F.lit("10.0.0."), k % 250)).otherwise(F.concat(front, F.lit("n"), k * 7 % 400, tail))
    return placed.select(F.col("rank").cast("int").alias("rank"), "c_custkey", domain.alias("domain"))


_BANDED = f"""b AS (SELECT * FROM (VALUES ('1-100', 1, 100), ('100-500', 101, 500), ('500-1k', 501, 1000), ('1k-100k', 1001, 100000)) v(band, lo, hi)),
 v AS (SELECT band, rank, c_custkey, domain, CASE WHEN c_custkey % 50 < 2 THEN NULL WHEN domain LIKE '%.co.uk' THEN array_to_string(string_split(domain, '.')[-3:], '.') ELSE array_to_string(string_split(domain, '.')[-2:], '.') END AS reg FROM {_RANKED} r JOIN b ON rank BETWEEN lo AND hi),
 k AS (SELECT *, reg IS NOT NULL AND row_number() OVER (PARTITION BY reg ORDER BY rank) = 1 AS kept FROM v)"""


def _visited(spark, sf_dir):
    from cairnfield.functions import hosts as H

    rows = _ranked(spark, sf_dir).withColumn("pos", F.col("c_custkey"))
    return corpora.visits(rows, [corpora.parse_band(b) for b in BANDS], H.registrable(F.col("domain"), private=False))


@query(f"WITH {_BANDED} SELECT band, count(*) AS input_rows, count(*) FILTER (WHERE kept) AS hosts, count(*) FILTER (WHERE reg IS NOT NULL AND NOT kept) AS dedupe_losses, count(*) FILTER (WHERE reg IS NULL) AS unparseable FROM k GROUP BY band")
def rank_bands(spark, sf_dir):
    """W3, A30, O8, F26, F8 (without private suffixes)."""
    return corpora.band_accounts(_visited(spark, sf_dir))


@query(f"WITH {_BANDED} SELECT band, rank, reg AS domain FROM k WHERE kept")
def band_hosts(spark, sf_dir):
    """W3, K5."""
    return corpora.band_hosts(_visited(spark, sf_dir))


@query("""WITH r AS (SELECT c_custkey, min(c_nationkey)::INT AS rank FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1)
SELECT o_orderkey, coalesce(r.rank, CASE WHEN o_orderkey % 3 = 0 THEN 99 END)::INT AS rank, r.rank IS NOT NULL AS ranked FROM orders LEFT JOIN r ON o_custkey = c_custkey""")
def rank_backfill(spark, sf_dir):
    """J3."""
    ranks = V.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("host"), F.col("c_nationkey").alias("rank"), F.col("c_custkey").alias("pos"))
    rows = V.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("host"), F.when(F.col("o_orderkey") % 3 == 0, 99).alias("rank"))
    return lookups.backfill_ranks(rows, ranks).select("o_orderkey", "rank", "ranked")


@query("SELECT o_custkey, o_orderstatus FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) o WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_custkey = o.o_custkey AND d.o_orderstatus = o.o_orderstatus AND d.o_orderkey % 3 = 0)")
def resume_todo(spark, sf_dir):
    """Keys of two columns of which some are done."""
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    keys = ["o_custkey", "o_orderstatus"]
    return lookups.to_do(orders.select(*keys).distinct(), orders.filter("o_orderkey % 3 = 0"), keys)


@query("SELECT p_partkey, shard FROM (SELECT p_partkey, (row_number() OVER (ORDER BY p_name, p_partkey) - 1) % 4 AS shard FROM part)")
def shard_tiles(spark, sf_dir):
    """W4, F29."""
    return lookups.shards(V.table(spark, sf_dir, "part").select("p_partkey", "p_name"), 4, [F.col("p_name"), F.col("p_partkey")]).select("p_partkey", "shard")


_FNV = """list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(s, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, c: ((xor(h, c)) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"""


def _simhash_sql(source: str, key: str) -> str:
    """64 votes over the shingles of `t`, rendered as 16 digits."""
    return f"""w AS (SELECT {key}, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(t, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 0 AND NOT (length(x) >= 6 AND regexp_matches(x, '[0-9]'))) AS w FROM ({source})),
 g AS (SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM w),
 u AS (SELECT s, {_FNV} AS h FROM (SELECT DISTINCT s FROM g)),
 v AS (SELECT {key}, b, sum(CASE WHEN (h::UBIGINT >> b::UBIGINT) & 1 = 1 THEN 1 ELSE -1 END) AS votes FROM g JOIN u USING (s), range(64) r(b) GROUP BY {key}, b),
 h AS (SELECT {key}, string_agg(CASE WHEN votes > 0 THEN '1' ELSE '0' END, '' ORDER BY b DESC) AS bits FROM v GROUP BY {key})"""


@query(f"WITH {_simhash_sql('SELECT item_id, text AS t FROM benchmark', 'item_id')} SELECT item_id, coalesce(array_to_string(list_transform(range(16), lambda i: substr('0123456789abcdef', (substr(bits, (4 * i + 1)::INT, 1)::INT * 8 + substr(bits, (4 * i + 2)::INT, 1)::INT * 4 + substr(bits, (4 * i + 3)::INT, 1)::INT * 2 + substr(bits, (4 * i + 4)::INT, 1)::INT + 1)::INT, 1)), ''), '0') AS simhash FROM benchmark LEFT JOIN h USING (item_id)")
def simhash64(spark, sf_dir):
    """F1, F2, F3, F4."""
    return V.table(spark, sf_dir, "benchmark").select("item_id", simhash.as_hex(simhash.simhash(F.col("text"))).alias("simhash"))


@query(f"""WITH {_simhash_sql("SELECT item_id, text AS t FROM benchmark", "item_id")}, p AS (SELECT a.item_id, b.item_id AS other, 1 - len(list_filter(range(64), lambda i: substr(a.bits, (i + 1)::INT, 1) <> substr(b.bits, (i + 1)::INT, 1))) / 64.0 AS s FROM h a, h b WHERE b.item_id < 2 AND a.item_id >= 2)
SELECT item_id, max(s)::DOUBLE AS nx_similarity, max(s) >= 0.9 AS soft404 FROM p GROUP BY item_id""")
def soft404_flags(spark, sf_dir):
    """Items against two baseline items."""
    rows = V.table(spark, sf_dir, "benchmark").select("item_id", simhash.simhash(F.col("text")).alias("h"))
    base = rows.filter("item_id < 2").agg(F.collect_list("h").alias("live")).withColumn("k", F.lit(1))
    near = F.array_max(F.transform("live", lambda b: simhash.similarity(F.col("h"), b)))
    return rows.filter("item_id >= 2").withColumn("k", F.lit(1)).join(F.broadcast(base), "k").select("item_id", near.alias("nx_similarity"), (near >= simhash.THRESHOLD).alias("soft404"))


@query(f"""WITH {_simhash_sql("SELECT doc_id, text AS t FROM documents", "doc_id")}, x AS (SELECT doc_id, coalesce(bits, repeat('0', 64))::BIT AS h FROM documents LEFT JOIN h USING (doc_id)),
 c AS (SELECT h, min(doc_id) AS rep, count(*) AS n FROM x GROUP BY h)
SELECT doc_id, c.rep, c.n AS copies, coalesce(l.links, 0) AS links, coalesce(l.linked, 0)::BIGINT AS linked FROM x JOIN c USING (h) LEFT JOIN (SELECT p.h, count(*) AS links, sum(q.n) AS linked FROM c p JOIN c q ON p.rep <> q.rep AND bit_count(xor(p.h, q.h)) <= 6 GROUP BY p.h) l USING (h)""")
def near_dup_links(spark, sf_dir):
    """documents whose hashes are 0.9 alike: each with its class of equal hashes, and the number of other classes near it, by an index of equal blocks of bits."""
    rows = V.table(spark, sf_dir, "documents").select("doc_id", simhash.simhash(F.col("text")).alias("h"))
    return near.near_links(rows, "doc_id", "h")


# ---------------------------------------------------------------------------------------------------------------------
# scores

_PAIRS = """p AS (SELECT doc_id, CASE WHEN d.n_chars > 1500 THEN 'long' ELSE 'unknown' END AS predicted, CASE quality WHEN 1 THEN 'long' WHEN 0 THEN 'unknown' END AS truth FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _pairs(spark, sf_dir):
    sample = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("host"), F.when(F.col("n_chars") > 1500, "long").otherwise("unknown").alias("predicted"))
    truth = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("host"), F.when(F.col("quality") == 1, " LONG ").when(F.col("quality") == 0, "none").otherwise("?").alias("truth"))
    return sampling.rated(sample, truth)


@query(f"""WITH {_PAIRS}, l AS (SELECT predicted AS label, 1 AS p, 0 AS t, (predicted = truth)::INT AS tp FROM p WHERE truth IS NOT NULL UNION ALL SELECT truth, 0, 1, 0 FROM p WHERE truth IS NOT NULL),
 s AS (SELECT label, sum(p)::BIGINT AS predicted, sum(t)::BIGINT AS truth, sum(tp)::BIGINT AS tp FROM l GROUP BY label) SELECT *, tp::DOUBLE / nullif(predicted, 0) AS "precision", tp::DOUBLE / nullif(truth, 0) AS recall FROM s""")
def score_labels(spark, sf_dir):
    """J7, A22."""
    return sampling.label_scores(_pairs(spark, sf_dir))


@query(f"""WITH {_PAIRS}, k AS (SELECT * FROM p WHERE truth IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE predicted = truth)::DOUBLE AS a FROM k),
 c AS (SELECT sum(x.n * y.n)::DOUBLE AS c FROM (SELECT predicted AS l, count(*) AS n FROM k GROUP BY 1) x JOIN (SELECT truth AS l, count(*) AS n FROM k GROUP BY 1) y USING (l))
SELECT (SELECT count(*) FROM p) AS n, n.n::BIGINT AS rated, (SELECT count(*) FROM p) - n.n::BIGINT AS undecidable, a / n.n AS accuracy, (a / n.n - c / (n.n * n.n)) / (1 - c / (n.n * n.n)) AS kappa FROM n, c""")
def score_kappa(spark, sf_dir):
    """A23."""
    return sampling.overall(_pairs(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT doc_id AS host, predicted, truth FROM p WHERE truth <> predicted")
def score_confusions(spark, sf_dir):
    """A24."""
    return sampling.confusions(_pairs(spark, sf_dir))


# ---------------------------------------------------------------------------------------------------------------------
# names

_VERBS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in K.VERBS.items()) + "}"
_FILLER = "[" + ", ".join(f"'{x}'" for x in K.FILLER) + "]"


def _tokens_sql(name: str) -> str:
    words = f"list_filter(string_split_regex(lower({name}), '[^a-z0-9]+'), lambda t: t <> '' AND NOT list_contains({_FILLER}, t))"
    folded = f"list_transform({words}, lambda t: coalesce({_VERBS}[t], t))"
    return f"list_transform({folded}, lambda t: CASE WHEN length(t) > 3 AND regexp_matches(t, '[^sui]s$') THEN t[1:length(t)-1] ELSE t END)"


_TOOL = "CASE WHEN p_partkey % 4 = 0 THEN 'fetch ' WHEN p_partkey % 4 = 2 THEN 'create_' ELSE 'get ' END || p_name || CASE WHEN p_size % 2 = 0 THEN 's' ELSE '' END"


@query(f"""WITH k AS (SELECT p_brand, p_partkey % 2 AS side, regexp_replace(lower({_TOOL}), '[^a-z0-9]+', '', 'g') AS strict, array_to_string(list_sort(list_distinct({_tokens_sql(_TOOL)})), ' ') AS loose FROM part),
 s AS (SELECT p_brand, count(*) FILTER (WHERE side = 0) AS n_tools, count(*) FILTER (WHERE side = 1) AS n_ops, list_distinct(list(strict) FILTER (WHERE side = 0)) AS ts, list_distinct(list(strict) FILTER (WHERE side = 1)) AS os,
  list_distinct(list(loose) FILTER (WHERE side = 0)) AS tl, list_distinct(list(loose) FILTER (WHERE side = 1)) AS ol FROM k GROUP BY p_brand)
SELECT p_brand, n_tools, n_ops, len(list_intersect(ts, os))::INT AS matched_strict, len(list_intersect(tl, ol))::INT AS matched_loose,
 len(list_intersect(ts, os))::DOUBLE / nullif(len(list_distinct(list_concat(ts, os))), 0) AS jaccard_strict, len(list_intersect(tl, ol))::DOUBLE / nullif(len(list_distinct(list_concat(tl, ol))), 0) AS jaccard_loose FROM s""")
def tool_op_jaccard(spark, sf_dir):
    """F20, F21, U1, U4, J16."""
    named = V.table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") % 2).alias("side"), F.expr(_TOOL).alias("name"))
    keyed = named.select("p_brand", "side", K.strict_key(F.col("name")).alias("strict"), K.loose_key(F.col("name")).alias("loose"))
    # both sides of a key meet on it, so no key set of a group is gathered
    sides = lambda kind: keyed.groupBy("p_brand", kind).agg(F.bool_or(F.col("side") == 0).alias("t"), F.bool_or(F.col("side") == 1).alias("o")).groupBy("p_brand").agg(F.count_if(F.col("t") & F.col("o")).alias(f"matched_{kind}"), F.count("*").alias("any"))
    share = lambda kind: sides(kind).select("p_brand", F.col(f"matched_{kind}").cast("int").alias(f"matched_{kind}"), stats.ratio(F.col(f"matched_{kind}"), F.col("any")).alias(f"jaccard_{kind}"))
    n = keyed.groupBy("p_brand").agg(F.count_if(F.col("side") == 0).alias("n_tools"), F.count_if(F.col("side") == 1).alias("n_ops"))
    return n.join(share("strict"), "p_brand").join(share("loose"), "p_brand")


@query(f"""WITH k AS (SELECT p_brand, p_partkey, p_size, {_TOOL} AS name FROM part), t AS (SELECT p_brand, p_partkey, name, list_distinct({_tokens_sql('name')}) AS w FROM k),
 x AS (SELECT a.p_partkey, b.name AS best_op, len(list_intersect(a.w, b.w))::DOUBLE / greatest(len(a.w), len(b.w)) AS s, b.p_partkey AS pos FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1),
 m AS (SELECT * FROM x WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, pos) = 1)
SELECT t.p_partkey AS tool_pos, t.name AS tool, best_op, coalesce(round(s, 2), 0)::DOUBLE AS overlap FROM t LEFT JOIN m USING (p_partkey) WHERE p_partkey % 2 = 0""")
def nearest_op(spark, sf_dir):
    """J15, F22."""
    rows = V.table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.expr(_TOOL).alias("name"))
    tools = rows.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("host"), F.col("p_partkey").alias("tool_pos"), F.col("name").alias("tool"))
    ops = rows.filter("p_partkey % 2 = 1").select(F.col("p_brand").alias("host"), F.col("p_partkey").alias("op_pos"), F.col("name").alias("op"))
    return consistency.nearest_operations(tools, ops).select("tool_pos", "tool", "best_op", "overlap")


@query("""SELECT l_returnflag, median(l_extendedprice) AS mean_median, (SELECT x FROM (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) AS n, count(*) OVER () AS c FROM lineitem b WHERE b.l_returnflag = a.l_returnflag) WHERE n = c // 2 + 1) AS upper_median FROM lineitem a GROUP BY l_returnflag""")
def median_variants(spark, sf_dir):
    """A16."""
    return stats.medians(V.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


# ---------------------------------------------------------------------------------------------------------------------
# trials


def _trials(spark, sf_dir):
    return V.view(spark, sf_dir, V.TRIALS.format(ms=V.SPARK_MS)).withColumn("reported_urls", F.when(F.col("event_id") % 6 == 0, F.array(F.concat(F.lit("https://"), "domain", F.lit("/llms.txt")))).otherwise(F.array().cast("array<string>")))


def _hits(spark, sf_dir):
    return V.view(spark, sf_dir, V.HITS.format(ms=V.SPARK_MS))


_T, _H, _M = V.TRIALS.format(ms=V.DUCK_MS), V.HITS.format(ms=V.DUCK_MS), V.MANIFEST
_MEET = "(h.host IS NULL OR h.host = t.domain OR h.host = 'www.' || t.domain) AND h.ts BETWEEN t.start_ms - 60000 AND t.end_ms + 60000"


@query(f"SELECT t.event_id AS trial, h.event_id AS hit FROM {_T} t JOIN {_H} h ON {_MEET}")
def interval_join_trials(spark, sf_dir):
    """J10."""
    trials = _trials(spark, sf_dir).select("domain", "start_ms", "end_ms", F.col("event_id").alias("trial"))
    return experiment.window_hits(trials, _hits(spark, sf_dir).withColumnRenamed("event_id", "hit")).select("trial", "hit")


@query(f"""WITH h AS (SELECT h.*, EXISTS (SELECT 1 FROM {_T} t WHERE {_MEET}) AS in_window FROM {_H} h WHERE path <> '/index.html')
SELECT in_window, CASE WHEN ua = '' THEN '(none)' ELSE regexp_replace(ua, '/[0-9.]+.*$', '') END AS product, count(*) AS n FROM h GROUP BY ALL""")
def interval_background(spark, sf_dir):
    """J11, F31."""
    return experiment.hit_context(_trials(spark, sf_dir), _hits(spark, sf_dir).withColumn("status", F.col("event_id")))


@query(f"""SELECT t.event_id, count(*) AS hits, sum(h.event_id)::BIGINT AS checksum FROM {V.TRIALS.format(ms=V.DUCK_MS)} t JOIN {V.HITS.format(ms=V.DUCK_MS)} h ON h.ts BETWEEN t.start_ms - 60000 AND t.end_ms + 60000 GROUP BY t.event_id""")
def interval_sweep(spark, sf_dir):
    """J10 where no hit has a host: every hit meets all trials whose window holds it; as only their number and sum are asked for, no pairs are made."""
    trials, hits = _trials(spark, sf_dir).select("event_id", "domain", "start_ms", "end_ms"), _hits(spark, sf_dir).withColumnRenamed("event_id", "hit_id").withColumn("host", F.lit(None).cast("string"))
    made = experiment.unplaced_totals(trials, hits, F.col("hit_id"))
    return made.groupBy("event_id").agg(F.sum("hits").alias("hits"), F.sum("total").alias("checksum"))


@query(f"SELECT a.domain, a.event_id AS a_id, b.event_id AS b_id FROM {_T} a JOIN {_T} b ON a.domain = b.domain AND a.event_id < b.event_id AND a.start_ms - 60000 <= b.end_ms + 60000 AND b.start_ms - 60000 <= a.end_ms + 60000")
def overlapping_trials(spark, sf_dir):
    """J12."""
    return experiment.overlapping(_trials(spark, sf_dir), "event_id")


def _manifest(spark, sf_dir):
    m = V.view(spark, sf_dir, V.MANIFEST)
    return m.select("domain", "cell_label", F.when(F.col("canary"), F.create_map(F.lit("llms"), F.col("token"))).alias("tokens"))


_SCORED = f"""x AS (SELECT t.*, coalesce(m.cell_label, 'unknown') AS cell, m.canary AND contains(regexp_replace(lower(answer), '[ _-]+', ' ', 'g'), regexp_replace(m.token, '[ _-]+', ' ', 'g')) AS quoted,
 EXISTS (SELECT 1 FROM {_H} h WHERE {_MEET} AND path = '/llms.txt') AS f_llms, EXISTS (SELECT 1 FROM {_H} h WHERE {_MEET} AND path <> '/index.html') AS f_any FROM {_T} t LEFT JOIN {_M} m USING (domain))"""


@query(f"""WITH {_SCORED}, g AS (SELECT agent, cell, task_id, grouping(cell) AS gc, grouping(task_id) AS gt, count(*) FILTER (WHERE error = '') AS n, count(*) FILTER (WHERE error <> '') AS errors,
  count(*) FILTER (WHERE error = '' AND f_llms) AS fetched_llms, 0 AS fetched_card, count(*) FILTER (WHERE error = '' AND f_any) AS fetched_any, count(*) FILTER (WHERE error = '' AND event_id % 6 = 0) AS reported_artifact,
  count(*) FILTER (WHERE error = '' AND quoted AND cell LIKE '%/canary') AS canary, count(*) FILTER (WHERE error = '' AND quoted AND cell LIKE '%/control') AS false_positive_controls
  FROM x GROUP BY GROUPING SETS ((agent), (agent, cell), (agent, task_id)))
SELECT * EXCLUDE (gc, gt), CASE WHEN gc = 0 THEN 'cell' WHEN gt = 0 THEN 'task' ELSE 'agent' END AS level FROM g WHERE (gc = 1 AND gt = 1) OR n > 0""")
def experiment_table(spark, sf_dir):
    """J13, P24, P25, A25, A26."""
    return experiment.tabulate(experiment.score_trials(_manifest(spark, sf_dir), _trials(spark, sf_dir), _hits(spark, sf_dir)))


_U = """(SELECT i, (xor(t2, t2 >> 14)) / 4294967296.0 AS u FROM (SELECT i, xor(t1, (t1 + ((xor(t1, t1 >> 7) * (t1 | 61)) % 4294967296)::BIGINT) % 4294967296) AS t2
 FROM (SELECT i, ((xor(a, a >> 15))::HUGEINT * (a | 1) % 4294967296)::BIGINT AS t1 FROM (SELECT i, (({seed} + i::HUGEINT * 1831565813) % 4294967296)::BIGINT AS a FROM {source}))))"""
_U = _U.replace("(xor(t1, t1 >> 7) * (t1 | 61))", "((xor(t1, t1 >> 7))::HUGEINT * (t1 | 61))")
REPS = 2000


@query(f"""WITH c AS (SELECT source, count(*) FILTER (WHERE quality = 1) AS k, count(*) AS n, row_number() OVER (ORDER BY min(doc_id)) - 1 AS j FROM documents JOIN labels USING (doc_id) GROUP BY source), g AS (SELECT count(*) AS g FROM c),
 d AS (SELECT (i - 1) // g AS rep, floor(u * g)::BIGINT AS j FROM {_U.format(seed=1, source=f"(SELECT unnest(range(1, {REPS} * (SELECT g FROM g) + 1)) AS i)")} x, g),
 e AS (SELECT rep, sum(k)::DOUBLE / sum(n) AS est FROM d JOIN c USING (j) GROUP BY rep), o AS (SELECT est, row_number() OVER (ORDER BY est) - 1 AS p FROM e)
SELECT (SELECT sum(k)::BIGINT FROM c) AS k, (SELECT sum(n)::BIGINT FROM c) AS n, (SELECT g FROM g) AS clusters, (SELECT est FROM o WHERE p = {int(0.025 * REPS)}) AS ci_low, (SELECT est FROM o WHERE p = {int(0.975 * REPS)}) AS ci_high""")
def cluster_bootstrap_ci(spark, sf_dir):
    """A27, R1."""
    rows = V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", (F.col("quality") == 1).alias("good"))
    return experiment.clustered_interval(rows, "source", "good", "doc_id", reps=REPS)


@query(f"SELECT i, u FROM {_U.format(seed=20261005, source='(SELECT c_custkey AS i FROM customer)')}")
def prng_draws(spark, sf_dir):
    """R1."""
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), prng.draw(20261005, F.col("c_custkey")).alias("u"))


@query(f"""WITH p AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS i FROM customer), u AS (SELECT * FROM {_U.format(seed=7, source='p')})
SELECT c_custkey FROM p JOIN u USING (i) ORDER BY pow(u, 1.0 / CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END) DESC, i LIMIT 100""")
def weighted_sample(spark, sf_dir):
    """R2."""
    c = V.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sampling.weighted_draw(c, F.when(F.col("c_mktsegment") == "BUILDING", 2.0).otherwise(1.0), 100, 7, [F.col("c_custkey")]).select("c_custkey")


@query(f"""WITH a AS (SELECT c_custkey FROM customer WHERE c_custkey % 40 = 0), p AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS i FROM customer WHERE c_custkey % 40 <> 0), u AS (SELECT * FROM {_U.format(seed=7, source='p')}),
 d AS (SELECT c_custkey FROM p JOIN u USING (i) ORDER BY pow(u, 1.0 / CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END) DESC, i LIMIT greatest(0, 120 - (SELECT count(*) FROM a)))
SELECT source, count(*) AS taken, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS taken_with_artifact FROM (SELECT *, 'first' AS source FROM a UNION ALL SELECT *, 'rest' FROM d) JOIN customer USING (c_custkey) GROUP BY source""")
def subsample_counts(spark, sf_dir):
    """R3, A31, S5."""
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("host"), (F.col("c_mktsegment") == "BUILDING").alias("artifact"))
    first = c.filter("host % 40 = 0").withColumn("source", F.lit("first"))
    rest = c.filter("host % 40 <> 0").withColumn("source", F.lit("rest"))
    return sampling.taken_by_source(sampling.subsample(first, rest, 120, 7, [F.col("host")]))


# ---------------------------------------------------------------------------------------------------------------------
# labels, logs, texts


def _selected(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(F.lit(None).cast("int").alias("id"), w.alias("name"), F.lit(None).cast("int").alias("superCategoryId")))
    labels = part.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("host"), F.when(F.col("p_partkey") % 7 == 0, "not_found").otherwise("ok").alias("status"), F.concat(F.lit("2026-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")).alias("fetched_at"), words.alias("categories"))
    return corpora.select_corpora(part.select(F.col("p_partkey").alias("host")), labels, "(?i)^[a-f]", "(?i)e$")


_LABELLED = """s AS (SELECT p_partkey AS host, CASE WHEN p_partkey % 5 = 0 THEN 'unlabelled' WHEN p_partkey % 7 = 0 THEN 'not_found' ELSE 'ok' END AS status, CASE WHEN p_partkey % 5 <> 0 THEN '2026-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') END AS fetched_at, string_split(p_name, ' ') AS w FROM part)"""


@query(f"""WITH {_LABELLED}, n AS (SELECT host, unnest(list_distinct(w)) AS name FROM s WHERE status = 'ok') SELECT name, count(*) AS n, min(host) AS first_pos FROM n GROUP BY name ORDER BY n DESC, first_pos LIMIT 40""")
def label_categories_top(spark, sf_dir):
    """A28, O3, O5."""
    return corpora.category_histogram(_selected(spark, sf_dir), "host")


@query(f"""WITH {_LABELLED}, f AS (SELECT *, status = 'ok' AND len(list_filter(w, lambda x: regexp_matches(x, '(?i)^[a-f]'))) > 0 AS commerce, status = 'ok' AND len(list_filter(w, lambda x: regexp_matches(x, '(?i)e$'))) > 0 AS fintech FROM s)
SELECT count(*) AS hosts, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'not_found') AS not_found, 0 AS error, count(*) FILTER (WHERE status = 'unlabelled') AS unlabelled, min(fetched_at) AS first, max(fetched_at) AS last,
 count(*) FILTER (WHERE commerce) AS commerce, count(*) FILTER (WHERE fintech) AS fintech, count(*) FILTER (WHERE commerce AND fintech) AS overlap FROM f""")
def corpus_selection(spark, sf_dir):
    """J6, P20, U6, A28."""
    return corpora.corpus_counts(_selected(spark, sf_dir))


_LINE = """CASE WHEN event_id % 3 = 0 THEN '1.2.3.4 - - [' || {stamp} || ' +0200] "GET /llms.txt?x=' || event_id || ' HTTP/1.1" 200 12 "-" "Bot/' || event_id || '.0"'
 WHEN event_id % 3 = 1 THEN '{{"ts":' || event_id || '.5,"request":{{"host":"U' || user_id || '.Example.com:443","uri":"/a?b","headers":{{"User-Agent":["x"]}}}},"status":404}}' ELSE 'junk ' || event_id END"""


@query("""SELECT CASE WHEN event_id % 3 = 0 THEN 'f.example.com' ELSE 'u' || user_id || '.example.com' END AS host, CASE WHEN event_id % 3 = 0 THEN epoch_ms(date_trunc('second', ts)) - 7200000 ELSE event_id * 1000 + 500 END AS ts,
 CASE WHEN event_id % 3 = 0 THEN '/llms.txt' ELSE '/a' END AS path, CASE WHEN event_id % 3 = 0 THEN 'Bot/' || event_id || '.0' ELSE 'x' END AS ua, CASE WHEN event_id % 3 = 0 THEN 200 ELSE 404 END AS status FROM events WHERE event_id % 3 < 2""")
def log_parse(spark, sf_dir):
    """S16, S17."""
    rows = V.table(spark, sf_dir, "events").select(F.expr(_LINE.format(stamp="date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')")).alias("value"))
    return readers.log_hits(rows, "value", F.lit("f.example.com"))


@query(f"""SELECT time_bucket(INTERVAL 1 hour, ts) AS hour, CASE event_id % 4 WHEN 0 THEN 'llms' WHEN 1 THEN 'openapi' WHEN 2 THEN 'a2a' ELSE 'other' END AS artifact, count(*) AS n FROM (SELECT event_id, e.ts FROM events e WHERE event_type IN ('view', 'click')) GROUP BY ALL""")
def hourly_hits(spark, sf_dir):
    """Hits by hour and kind of document; the same plan runs on a stream."""
    rows = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("e"), F.col("ts").cast("timestamp").alias("at")).join(_hits(spark, sf_dir).select(F.col("event_id").alias("e"), "path"), "e")
    return stream_hits.hourly(rows.select(F.col("at").alias("ts"), "path")).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "artifact", "n")


_SAID = "trim(regexp_replace(lower({}), '[\\s_-]+', ' ', 'g'))"
_SENTENCES = f"(SELECT DISTINCT item_id, {_SAID.format('s')} AS token FROM (SELECT item_id, unnest(string_split(text, '.')) AS s FROM benchmark) WHERE length({_SAID.format('s')}) >= 8)"


@query(f"""SELECT doc_id, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items, count(DISTINCT token) AS sentences FROM (SELECT doc_id, {_SAID.format('text')} AS said FROM documents) d JOIN {_SENTENCES} b ON contains(d.said, b.token) GROUP BY doc_id""")
def canary_in_answer(spark, sf_dir):
    """Which documents hold sentences of benchmark items, in any case and with any separators; one automaton over all sentences, one pass over each text."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s_-]+", " "))
    sentences = V.table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "[.]")).alias("s")).select("item_id", norm(F.col("s")).alias("token")).filter("length(token) >= 8").distinct()
    token = F.xxhash64("token").alias("t")
    found = search.holding(V.table(spark, sf_dir, "documents"), norm(F.col("text")), sentences.select("item_id", "token", token), ["doc_id"])
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), ",").alias("items"), F.count_distinct("t").alias("sentences"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(v, '[",\\r\\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS cell FROM (SELECT doc_id, coalesce(text, '') AS v FROM documents)""")
def csv_cells(spark, sf_dir):
    """K4."""
    return V.table(spark, sf_dir, "documents").select("doc_id", T.csv_escape(F.col("text")).alias("cell"))
