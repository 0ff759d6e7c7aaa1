"""Queries that write derived tables as the files that sources read, and read them back, with their DuckDB oracles."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import hosts as H
from cairnfield.operators import cards, consistency, corpora
from cairnfield.plans import queries_rows
from cairnfield.plans import views as V
from cairnfield.sources import archives, files, readers, registry_pages, scratch, sinks
from cairnfield.streaming import ledger
from cairnfield.streaming import trials as stream_trials

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _folder(spark, name: str) -> str:
    return f"{scratch.folder(spark)}/cairnfield/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------------------------------------------------
# registries, archives

_CHAINS, _PER_PAGE, _LAST = 16, 25, 3
#: Pages as servers of chains of captures: even chains are of one registry, odd ones of another; chain 3 ends early.
_SERVERS = f"""(SELECT page_id, url, page_id % {_CHAINS} AS chain, page_id // {_CHAINS} // {_PER_PAGE} AS n FROM pages)"""
_HOST_SQL = r"lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"


@query(f"""SELECT CASE chain % 2 WHEN 0 THEN 'official' ELSE 'glama' END AS registry, 'c' || chain AS chain, n::INT AS page, count(*) AS servers, count(*) AS endpoints, count(DISTINCT {_HOST_SQL}) AS hosts
 FROM {_SERVERS} s WHERE n < 2000 AND (chain <> 3 OR n <= {_LAST}) GROUP BY s.chain, n""")
def registry_chains(spark, sf_dir):
    """Captured pages are followed from cursor to cursor, whatever their order in the files; repeated captures and pages after the last cursor don't count."""
    p = V.table(spark, sf_dir, "pages").select("page_id", "url")
    chain, n = F.col("page_id") % _CHAINS, F.floor(F.floor(F.col("page_id") / _CHAINS) / _PER_PAGE).cast("int")
    placed = p.select("page_id", "url", chain.alias("k"), n.alias("n"))
    last = placed.groupBy("k").agg(F.max("n").alias("last")).withColumn("last", F.when(F.col("k") == 3, F.least("last", F.lit(_LAST))).otherwise(F.col("last")))
    official = F.col("k") % 2 == 0
    server = F.struct(F.col("page_id").cast("string").alias("name"), F.array(F.struct(F.lit("http").alias("type"), "url")).alias("remotes"))
    other = F.struct(F.col("page_id").cast("string").alias("slug"), F.struct(F.col("url").alias("endpointUrl")).alias("about"))
    pages = placed.groupBy("k", "n").agg(F.collect_list(F.when(official, F.to_json(server)).otherwise(F.to_json(other))).alias("servers")).join(F.broadcast(last), "k")
    cursor = lambda at: F.concat(F.lit("cursor/"), F.col("k"), F.lit("?"), at)
    more = F.col("n") != F.col("last")
    follow = F.when(official, F.concat(F.lit('"metadata":{"nextCursor":'), F.when(more, F.concat(F.lit('"'), cursor(F.col("n") + 1), F.lit('"'))).otherwise("null"), F.lit("}")))
    follow = follow.otherwise(F.concat(F.lit('"pageInfo":{"hasNextPage":'), more.cast("string"), F.lit(',"endCursor":"'), cursor(F.col("n") + 1), F.lit('"}')))
    body = F.concat(F.lit('{"servers":['), F.array_join("servers", ","), F.lit("],"), follow, F.lit("}"))
    captured = pages.select(F.when(official, "official").otherwise("glama").alias("registry"), F.concat(F.lit("c"), "k").alias("chain"), F.when(F.col("n") > 0, cursor(F.col("n"))).alias("at"), body.alias("text"), F.explode(F.sequence(F.lit(0), F.col("n") % 2)).alias("again"))
    path = _folder(spark, "registry")
    registry_pages.write_captures(captured, path, F.col("at"), F.col("text"))
    return _registry_totals(registry_pages.read_registry(spark, path))


def _registry_totals(read: DataFrame) -> DataFrame:
    """Servers, endpoints and hosts of each page that was reached."""
    # endpoints carry no chain and page: their server's number does
    made = [f(read.filter(F.col("registry") == name)).select("registry", F.col("server").cast("bigint").alias("s"), "host") for name, f in (("official", corpora.official_endpoints), ("glama", corpora.glama_endpoints))]
    page = F.floor(F.floor(F.col("s") / _CHAINS) / _PER_PAGE).cast("int")
    ends = made[0].unionByName(made[1]).select("registry", F.concat(F.lit("c"), F.col("s") % _CHAINS).alias("chain"), page.alias("page"), "host")
    ends = ends.groupBy("registry", "chain", "page").agg(F.count("*").alias("endpoints"), F.count_distinct("host").alias("hosts"))
    return read.select("registry", "chain", "page", F.col("servers").cast("bigint").alias("servers")).join(ends, ["registry", "chain", "page"])


def _write_archives(rows: DataFrame, path: str, members: int) -> DataFrame:
    """An archive a partition, with the rows (id, value) dealt over members by their ids; the paths written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if held:
            name = f"{path}/a{uuid.uuid4().hex}.zip"
            system, own = files.store(name)
            system.create_dir(own.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(own) as out, zipfile.ZipFile(out, "w") as archive:
                archive.writestr("notes.txt", "not a list\n")
                for k in range(members):
                    text = "".join(f"{v}\r\n" for i, v in held if i % members == k)
                    archive.writestr(f"part{k}.CSV", text, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])

    return rows.mapInArrow(run, "path STRING")


@query("""SELECT 'part' || c_custkey % 3 || '.CSV' AS name, count(*) AS lines, sum(c_custkey)::BIGINT AS ranks, min(c_name) AS first_domain FROM customer GROUP BY 1""")
def archive_members(spark, sf_dir):
    """Ranked lines in members of archives, stored and deflated, each member read by ranges in a task of its own."""
    rows = V.table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name").alias("value")).repartition("c_custkey")
    path = _folder(spark, "archives")
    _write_archives(rows, path, 3).collect()
    lines = archives.read_zip_lines(spark, path)
    parts = F.split("value", ",")
    return lines.groupBy("name").agg(F.count("*").alias("lines"), F.sum(F.get(parts, F.lit(0)).cast("bigint")).alias("ranks"), F.min(F.get(parts, F.lit(1))).alias("first_domain"))


# ---------------------------------------------------------------------------------------------------------------------
# public suffixes

_RULES = [("uk", False), ("co.uk", False), ("*.ck", False), ("!www.ck", False), ("jp", False), ("*.kawasaki.jp", False), ("!city.kawasaki.jp", False), ("dev", False), ("*.ex.dev", True), ("host.dev", True)]
_ENDS = ["ck", "www.ck", "b.ck", "jp", "kawasaki.jp", "city.kawasaki.jp", "d.kawasaki.jp", "co.uk", "ex.dev", "s.ex.dev", "host.dev", "unknown", "10.1.2.3"]
_NAMES = "(SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a.' WHEN 2 THEN 'n' || c_custkey || '.a.' ELSE 'x.n' || c_nationkey || '.www.' END || (CASE c_custkey % 13 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_ENDS)) + " END) AS host FROM customer)"
_RULE_VALUES = ", ".join(f"('{s.removeprefix('*.').removeprefix('!')}', {-1 if s.startswith('*.') else 1 if s.startswith('!') else 0}, {str(own).lower()})" for s, own in _RULES)


def _suffix_sql(private: bool) -> str:
    kept = "" if private else " AND NOT r.private"
    return f"""SELECT h.host, CASE WHEN regexp_matches(h.host, '^[0-9.]+$') OR len(l) < 2 OR place < 1 THEN NULL ELSE array_to_string(l[place:], '.') END AS domain
 FROM (SELECT host, l, coalesce(min(start) FILTER (WHERE step = 1), min(start) FILTER (WHERE step < 1 AND start >= 0), len(l) - 1) AS place FROM
  (SELECT t.host, t.l, r.step, t.i + r.step AS start FROM (SELECT host, string_split(host, '.') AS l, unnest(range(len(string_split(host, '.')))) AS i FROM {_NAMES}) t LEFT JOIN (VALUES {_RULE_VALUES}) r(name, step, private) ON r.name = array_to_string(t.l[t.i + 1:], '.'){kept}) GROUP BY host, l) h"""


@query(f"SELECT a.host, a.domain AS all_rules, b.domain AS public_rules, a.domain AS by_table FROM ({_suffix_sql(True)}) a JOIN ({_suffix_sql(False)}) b USING (host)")
def suffix_rules(spark, sf_dir):
    """Plain, wildcard and exception rules, by a literal table and by a joined one, with and without private rules."""
    path = _folder(spark, "suffixes")
    section = lambda own: "\n".join(s for s, p in _RULES if p == own)
    text = f"// a list\n\n// ===BEGIN ICANN DOMAINS===\n{section(False)}\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\n// owner\n{section(True)} trailing words\n// ===END PRIVATE DOMAINS===\n"
    spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.text(path)
    names = V.view(spark, sf_dir, _NAMES)
    own = names.select("host", H.registrable(F.col("host"), _RULES).alias("all_rules"), H.registrable(F.col("host"), _RULES, private=False).alias("public_rules"))
    return own.join(H.registrable_join(names, H.suffix_rules(spark, path)).withColumnRenamed("registrable_domain", "by_table"), "host")


# ---------------------------------------------------------------------------------------------------------------------
# transactional appends, corpora


@query("SELECT user_id, event_type, min(event_id % 4) AS batch FROM events GROUP BY ALL")
def appended_batches(spark, sf_dir):
    """Batches with keys in common, one of them sent twice, appended by markers; each key stands in the first batch that has it."""
    events = V.table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 4).alias("batch"))
    book = ledger.Ledger(spark, _folder(spark, "ledger"), ["user_id", "event_type"], buckets=4, bucket_rows=1000)
    for k in (0, 1, 1, 2, 3):
        book.append(events.filter(F.col("batch") == k), k)
    return book.rows()


_MS = V.DUCK_MS
#: So many rows of both streams are a group's.
GROUP_ROWS = 2_000


@query(f"""SELECT t.event_id AS trial, h.event_id AS hit FROM {V.TRIALS.format(ms=_MS)} t JOIN {V.HITS.format(ms=_MS)} h ON (h.host = t.domain OR h.host = 'www.' || t.domain) AND h.ts BETWEEN t.start_ms - 60000 AND t.end_ms + 60000""")
def streamed_trials(spark, sf_dir):
    """Trials and hits as streams of files, joined by a state with timers."""
    path = _folder(spark, "streams")
    views = {"trials": V.view(spark, sf_dir, V.TRIALS.format(ms=V.SPARK_MS)).select("event_id", "domain", "start_ms", "end_ms"), "hits": V.view(spark, sf_dir, V.HITS.format(ms=V.SPARK_MS)).select("event_id", "host", "ts")}
    for name, rows in views.items():
        rows.write.parquet(f"{path}/{name}")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream_trials.PROVIDER)
    try:
        t, h = (spark.readStream.schema(rows.schema).parquet(f"{path}/{name}") for name, rows in views.items())
        groups = -(-sum(spark.read.parquet(f"{path}/{name}").count() for name in views) // GROUP_ROWS) or 1
        pairs = stream_trials.window_hits(t, h, late="60 days", span_ms=30 * 86_400_000, groups=groups).select(F.col("trial.event_id").alias("trial"), F.col("hit.event_id").alias("hit"))
        query = pairs.writeStream.format("parquet").option("path", f"{path}/pairs").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.read.schema(pairs.schema).parquet(f"{path}/pairs")


@query(f"WITH {queries_rows._BANDED} SELECT band AS label, rank, reg AS host FROM k WHERE kept")
def corpus_files(spark, sf_dir):
    """K5, K6: bands written by two runs under one tag, and read back by the sidecar that names the files of both."""
    folder = _folder(spark, "corpus")
    seen = queries_rows._visited(spark, sf_dir)
    kept, accounts = corpora.band_hosts(seen), corpora.band_accounts(seen)
    first = F.col("band").isin("1-100", "500-1k")
    for part in (first, ~first):
        sinks.write_bands(kept.filter(part), accounts.filter(part), folder, "list", {"source": "customer"})
    lists = sinks.read_sidecar(spark, f"{folder}/list.meta.json")["lists"]
    read = [readers.read_hosts(spark, x["file"]).select(F.lit(label).alias("label"), "rank", "host") for label, x in sorted(lists.items())]
    return reduce(DataFrame.unionByName, read)


# ---------------------------------------------------------------------------------------------------------------------
# second captures

#: Which documents of host k were valid in the first crawl.
_CARD, _LEGACY, _API, _LLMS = "k % 2 = 0", "k % 5 < 3", "k % 3 < 2", "k % 7 < 4"
_K = "(SELECT c_custkey AS k, 'h' || CAST(c_custkey AS VARCHAR(20)) || '.example.com' AS host FROM customer)"


def _probe(path: str, artifact: str, valid: str):
    return F.struct(F.lit(path).alias("path"), F.lit(artifact).alias("artifact"), F.expr(valid).alias("valid"), F.concat(F.lit("https://"), "host", F.lit(path)).alias("final_url"), F.lit("sep-2127").alias("card_spec"))


def _captures(rows: DataFrame, parts: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Captures of every host: path to SQL of status, error and body; each is captured twice, of which the first counts."""
    made = [F.struct(F.concat(F.lit("https://"), "host", F.lit(path)).alias("url"), F.expr(status).cast("int").alias("status"), F.expr(error).cast("string").alias("error"), F.expr(body).cast("string").alias("body")) for path, (status, error, body) in parts.items()]
    once = rows.select(F.explode(F.array(*made)).alias("x")).select("x.*")
    return once.withColumn("pos", F.lit(1)).unionByName(once.select("url", F.lit(200).alias("status"), F.lit("late").alias("error"), F.lit("{}").alias("body"), F.lit(2).alias("pos")))


_TOOLS = "CASE WHEN k % 7 <> 0 AND k % 8 NOT IN (0, 2) THEN 'getUser,other' WHEN {alt} THEN 'alt_tool' WHEN k % 7 <> 0 AND k % 8 = 0 THEN '' END"
#: The first place is the card's path if it was valid, the older path if that alone was.
_USED = f"({_CARD}) AND ({_LEGACY}) AND (k % 7 = 0 OR k % 8 IN (0, 2))"


@query(f"""WITH c AS (SELECT *, ({_CARD}) AS card, ({_LEGACY}) AS legacy, ({_API}) AS api, ({_LLMS}) AS llms FROM {_K}), p AS (SELECT *, (card OR legacy) AND api AS pair, llms AND (card OR legacy OR api) AS coverage FROM c),
 t AS (SELECT *, CASE WHEN NOT pair THEN NULL WHEN NOT card THEN 'alt_tool' ELSE {_TOOLS.format(alt=f"({_LEGACY})")} END AS tools, pair AND k % 9 <> 0 AS has_ops FROM p WHERE pair OR coverage)
SELECT host, pair, coverage, tools, pair AND {_USED} AS used_alt, CASE WHEN tools IS NOT NULL AND has_ops THEN CASE WHEN tools LIKE 'getUser%' THEN 1 ELSE 0 END END AS matched_loose,
 concat_ws(',', CASE WHEN pair AND card AND k % 7 = 0 THEN 'card:gone' END, CASE WHEN pair AND k % 9 = 0 THEN 'openapi:timeout' END, CASE WHEN pair AND card AND k % 7 <> 0 AND k % 8 = 2 THEN 'card:unparseable' END) AS errors,
 CASE WHEN coverage THEN 1 END AS api_links, CASE WHEN coverage THEN k % 9 <> 0 END AS resolves FROM t""")
def rechecked_pairs(spark, sf_dir):
    """Candidates, their second captures with other paths to fall back on, and the match of what they hold."""
    rows = V.view(spark, sf_dir, _K, "c_custkey")
    probes = F.array(_probe("/c", "mcp_server_card", _CARD), _probe("/mcp/server-card.json", "mcp_server_card_legacy", _LEGACY), _probe("/o", "openapi_json", _API), _probe("/l", "llms_txt", _LLMS))
    found = consistency.candidates(rows.select("host", F.col("k").cast("int").alias("rank"), probes.alias("probes")))
    captured = _captures(rows, {
        "/c": ("CASE WHEN k % 7 = 0 THEN 404 ELSE 200 END", "CASE WHEN k % 7 = 0 THEN 'gone' END", """CASE k % 8 WHEN 0 THEN '{"name":"n"}' WHEN 2 THEN '{"name":[' ELSE '{"name":"n","tools":["getUser",{"name":"other"}]}' END"""),
        "/mcp/server-card.json": ("200", "NULL", """'{"tools":["alt_tool"]}'"""),
        "/o": ("CASE WHEN k % 9 = 0 THEN 0 ELSE 200 END", "CASE WHEN k % 9 = 0 THEN 'timeout' END", """'{"openapi":"3.0.0","paths":{"/u":{"get":{"operationId":"getUser"}}}}'"""),
        "/l": ("200", "NULL", "concat('# T\\n- [api](https://', host, '/o/openapi.json)')"),
        "/o/openapi.json": ("CASE WHEN k % 9 = 0 THEN 404 ELSE 200 END", "NULL", "''"),
    })
    made = consistency.recheck(found, captured)
    return made.select("host", "pair", "coverage", F.array_join("tools", ",").alias("tools"), "card_used_alt", F.col("match.matched_loose").alias("matched_loose"), F.array_join("errors", ",").alias("errors"), F.size(F.col("llms.openapi")).alias("api_links"), F.exists("llms.openapi_resolves", lambda x: x).alias("resolves")).withColumnRenamed("card_used_alt", "used_alt")


@query(f"""SELECT host, 'https://' || host || CASE WHEN {_CARD} THEN '/.well-known/agent-card.json' ELSE '/.well-known/agent.json' END AS card_url, CASE WHEN ({_CARD}) AND k % 11 = 0 THEN 0 ELSE 200 END AS status, CASE WHEN ({_CARD}) AND k % 11 = 0 THEN 'timeout' WHEN ({_CARD}) AND k % 10 = 2 THEN 'unparseable' END AS error,
 CASE WHEN ({_CARD}) AND ({_LEGACY}) AND k % 11 <> 0 THEN k % 10 <> 2 AND k % 4 = 0 END AS alt_same_body, CASE WHEN ({_CARD}) AND (k % 11 = 0 OR k % 10 = 2) THEN NULL WHEN ({_CARD}) AND k % 4 = 0 THEN 'v1' WHEN {_CARD} THEN 'legacy' ELSE 'v1' END AS generation FROM {_K} WHERE ({_CARD}) OR ({_LEGACY})""")
def rechecked_cards(spark, sf_dir):
    """Agent cards captured again, by the first valid path, and whether the other path serves the same body."""
    rows = V.view(spark, sf_dir, _K, "c_custkey")
    probes = F.array(_probe("/.well-known/agent-card.json", "a2a_agent_card", _CARD), _probe("/.well-known/agent.json", "a2a_agent_json", _LEGACY))
    found = cards.candidates(rows.select("host", F.col("k").cast("int").alias("rank"), probes.alias("probes")))
    new = """'{"name":"n","supportedInterfaces":[{"url":"https://x.test/a","transport":"grpc"}]}'"""
    captured = _captures(rows, {
        "/.well-known/agent-card.json": ("CASE WHEN k % 11 = 0 THEN 0 ELSE 200 END", "CASE WHEN k % 11 = 0 THEN 'timeout' END", f"""CASE WHEN k % 10 = 2 THEN 'no card' WHEN k % 4 = 0 THEN {new} ELSE '{{"name":"n","url":"https://x.test/"}}' END"""),
        "/.well-known/agent.json": ("200", "NULL", new),
    })
    return cards.recheck(found, captured).select("host", "card_url", "status", "error", "alt_same_body", F.col("profile.generation").alias("generation"))
