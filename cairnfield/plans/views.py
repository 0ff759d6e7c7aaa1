"""Record types derived from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield import schemas as S

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SPECS = "(SELECT * FROM (VALUES " + ", ".join(f"({pos}, '{path}', '{artifact}')" for pos, path, artifact, *_ in S.PROBE_SPECS) + ") AS v(pos, path, artifact))"


def probes(shift: int = 0) -> str:
    """Probes of one host for each customer; another shift is another snapshot."""
    return f"""(SELECT host, pos, path, artifact, c_custkey, c_nationkey, c_mktsegment, status, valid, soft404,
  valid AND c_custkey % 11 = 0 AS cross_origin_hit, valid AND c_custkey % 7 = 0 AS www_redirect,
  'https://' || CASE WHEN (c_custkey + pos + {shift}) % 9 = 0 THEN 'cdn.example.net' ELSE host END || path AS final_url,
  CASE WHEN status = 0 THEN 'timeout' END AS error
 FROM (SELECT *, status = 200 AND NOT valid AND (c_custkey + pos) % 3 = 0 AS soft404
  FROM (SELECT *, status = 200 AND (c_custkey + pos * 3 + {shift}) % 4 = 0 AS valid
   FROM (SELECT 'h' || CAST(c_custkey AS VARCHAR(20)) || '.example.com' AS host, c_custkey, c_nationkey, c_mktsegment, pos, path, artifact,
     CASE WHEN x < 9 THEN 200 WHEN x < 13 THEN 404 WHEN x < 17 THEN 403 WHEN x = 17 THEN 429 WHEN x < 20 THEN 0 ELSE 301 END AS status
    FROM (SELECT c.*, s.*, (c_custkey * 31 + pos * 17 + c_nationkey * 7 + {shift}) % 23 AS x FROM customer c CROSS JOIN {SPECS} s) a) b) c) d)"""


def hosts(shift: int = 0) -> str:
    """Host rows of a snapshot; later ones lack some hosts."""
    return f"""(SELECT 'h' || CAST(c_custkey AS VARCHAR(20)) || '.example.com' AS host, CAST(c_custkey AS INT) AS rank, c_custkey, k,
  k IN (0, 1) AS is_blocked, k = 2 AS redirect_only,
  CASE k WHEN 0 THEN '403 on 9/16 probes' WHEN 1 THEN 'proxy_denied (crawler egress policy, not target) on 12/16 probes' WHEN 3 THEN 'unreachable:dns on 16/16 probes' END AS reason,
  lower(c_mktsegment) AS platform, CASE WHEN c_nationkey % 3 = 0 THEN 'fastly' END AS cdn,
  CASE k WHEN 0 THEN 'blocked' WHEN 1 THEN 'proxy_denied' WHEN 2 THEN 'redirect_only' WHEN 3 THEN 'unreachable' ELSE 'reachable' END AS host_class
 FROM (SELECT *, (c_custkey + {shift} * (c_custkey % 2)) % 10 AS k FROM customer WHERE {shift} = 0 OR c_custkey % 13 <> 0) a)"""


TRIALS = """(SELECT 'agent' || CAST(event_id % 3 AS VARCHAR(20)) AS agent, 'u' || CAST(user_id AS VARCHAR(20)) || '.example.com' AS domain,
  'task' || CAST(event_id % 4 AS VARCHAR(20)) AS task_id, event_id, {ms} - 3600000 AS start_ms, {ms} + 21600000 AS end_ms,
  CASE WHEN event_id % 5 = 0 THEN 'the Token-u' || CAST(user_id AS VARCHAR(20)) || ' x' ELSE 'nothing' END AS answer, CASE WHEN event_id % 7 = 0 THEN 'timeout' ELSE '' END AS error
 FROM events WHERE event_type = 'signup')"""
HITS = """(SELECT CASE WHEN user_id = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'www.u' || CAST(user_id AS VARCHAR(20)) || '.example.com' ELSE 'u' || CAST(user_id AS VARCHAR(20)) || '.example.com' END AS host,
  {ms} AS ts, CASE event_id % 4 WHEN 0 THEN '/llms.txt' WHEN 1 THEN '/openapi.json' WHEN 2 THEN '/.well-known/agent.json' ELSE '/index.html' END AS path,
  CASE event_id % 3 WHEN 0 THEN 'curl/8.1 (x)' WHEN 1 THEN '' ELSE 'Bot/2.0 test' END AS ua, 200 AS status, event_id
 FROM events WHERE event_type IN ('view', 'click'))"""
MANIFEST = """(SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR(20)) || '.example.com' AS domain, user_id % 2 = 0 AS canary,
  CASE WHEN user_id % 4 < 2 THEN 'linked' ELSE 'unlinked' END || CASE WHEN user_id % 2 = 0 THEN '/canary' ELSE '/control' END AS cell_label, 'token_u' || CAST(user_id AS VARCHAR(20)) AS token FROM events)"""
SPARK_MS, DUCK_MS = "unix_millis(CAST(ts AS TIMESTAMP))", "epoch_ms(ts)"


#: So many rows of a table are a task's where each of them is made into many, or is much work.
TASK_ROWS = 25_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over tasks by their key, in number as the rows: a file of one row group, however long, is a single task's else."""
    return rows.repartition(-(-rows.count() // TASK_ROWS) or 1, key)


def sql(spark: SparkSession, sf_dir: str, query: str, deal: str | None = None) -> DataFrame:
    """A query over the tables of a folder, bound by name, so that no view of the session is replaced; tables with a column `deal` are dealt by it."""
    import re

    names = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", query)]
    bound = query
    frames = {}
    for t in names:
        bound = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", bound)
        rows = table(spark, sf_dir, t)
        frames[t] = dealt(rows, deal) if deal in rows.columns else rows
    return spark.sql(bound, **frames) if frames else spark.sql(bound)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sub: str, deal: str | None = None) -> DataFrame:
    return sql(spark, sf_dir, f"SELECT * FROM {sub} t", deal)


def results(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Nested host results of a snapshot."""
    p = view(spark, sf_dir, probes(shift))
    near = F.when(F.col("soft404") & (F.col("pos") % 2 == 0), F.array(F.lit("soft404:hash_near_dup"))).when(F.col("soft404"), F.array(F.lit("soft404:html_content_type"))).otherwise(F.array().cast("array<string>"))
    spec = F.when(F.col("valid") & F.col("artifact").isin(*S.MCP_CARDS), F.when(F.col("c_custkey") % 2 == 0, "sep-2127").otherwise("sep-1649"))
    fields = F.struct("pos", "path", "artifact", "status", "final_url", "cross_origin_hit", "www_redirect", "error", "soft404", spec.alias("card_spec"), "valid", near.alias("reasons"))
    nested = p.groupBy("host").agg(F.array_sort(F.collect_list(fields)).alias("probes"))
    card = F.get(F.filter("probes", lambda x: x["valid"] & x["artifact"].isin(*S.MCP_CARDS)), F.lit(0))["path"]
    h = view(spark, sf_dir, hosts(shift)).join(nested, "host")
    return h.select(
        "host", "rank", F.struct(F.col("is_blocked").alias("blocked"), "reason").alias("blocked"), "redirect_only",
        F.struct(F.col("platform").alias("primary"), F.array("platform").alias("platforms"), "cdn", F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("framer"))).otherwise(F.array().cast("array<string>")).alias("hints")).alias("fingerprint"),
        card.alias("mcp_card_path"), "probes",
    )
