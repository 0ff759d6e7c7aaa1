import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cairnfield import schemas as S
from cairnfield.functions import documents as D
from cairnfield.functions import http as H
from cairnfield.functions import prng
from cairnfield.operators import cards, classify, consistency, corpora, experiment, fingerprint, handshake, lookups, sampling, summary
from cairnfield.plans import queries_rows
from cairnfield.sources import readers, sinks
from cairnfield.streaming import hits as stream_hits

RESPONSE = "host STRING, vantage STRING, kind STRING, path STRING, final_url STRING, status INT, headers MAP<STRING,STRING>, content_type STRING, body BINARY, bytes BIGINT, sha256 STRING, redirects INT, cross_origin_hit BOOLEAN, www_redirect BOOLEAN, error STRING, elapsed_ms BIGINT"


def response(host, kind, path, status=200, body="", ct="application/json", error=None, url=None, cross=False, headers=None):
    raw = body.encode()
    return (host, "v", kind, path, url or f"https://{host}{path}", status, headers or {}, ct, bytearray(raw), len(raw), sinks.digest(body), 0, cross, False, error, 1)


def test_probe_classification(spark):
    page = "<html><body>" + " ".join(f"word{chr(97 + k)}" for k in range(20)) + "</body></html>"
    card = json.dumps({"name": "com.example/x", "remotes": [{"type": "sse", "url": "https://m.example.com/mcp"}]})
    prm = "/.well-known/oauth-protected-resource"
    rows = [
        response("good.test", "nx", "/__nx_1", 404, "gone", "text/plain"),
        response("good.test", "probe", "/llms.txt", body="# Title\n- a", ct="text/markdown"),
        response("good.test", "probe", "/.well-known/mcp-server-card", body=card),
        response("good.test", "probe", "/openapi.yaml", body="openapi: 3.0.1\npaths: {}", ct="text/yaml"),
        response("good.test", "probe", "/openapi.json", body='{"swagger":"2.0"}'),
        response("good.test", "probe", "/.well-known/security.txt", body="Contact: mailto:a@b.test", ct="text/plain"),
        response("good.test", "probe", prm, body='{"resource":"https://other.test/"}'),
        response("good.test", "probe", "/.well-known/agent.json", body='{"name":"a","name":"b","url":"u"}'),
        response("good.test", "probe", "/ai.txt", status=0, error="timeout", ct=None),
        response("good.test", "probe", "/.well-known/ai-catalog.json", body=""),
        response("good.test", "probe", "/.well-known/agent-card.json", status=302, error="cross_domain_redirect", url="https://else.test/x", cross=True),
        response("spa.test", "nx", "/__nx_1", body=page, ct="text/html"),
        response("spa.test", "probe", "/llms.txt", body=page, ct="text/html"),
        response("spa.test", "probe", "/ai.txt", body=page, ct="text/html"),
    ]
    out = {(r["host"], r["path"]): r for r in classify.classify_probes(spark.createDataFrame(rows, RESPONSE), S.probe_specs(spark)).collect()}
    good = {p: (r["valid"], r["reasons"]) for (h, p), r in out.items() if h == "good.test"}
    assert good["/llms.txt"] == (True, []) and good["/.well-known/mcp-server-card"] == (True, ["note:name_not_reverse_dns"][:0])
    assert good["/openapi.yaml"] == (True, []) and good["/openapi.json"] == (False, ["swagger_2_not_3:2.0"])
    assert good["/.well-known/security.txt"] == (True, ["note:no_expires_field"])
    assert good[prm] == (False, ["note:prm_no_authorization_servers", "prm_resource_mismatch"])
    assert good["/.well-known/agent.json"] == (True, [])  # of a repeated key the last counts
    assert good["/ai.txt"] == (False, ["error:timeout"]) and good["/.well-known/ai-catalog.json"] == (False, ["empty_body"])
    assert good["/.well-known/agent-card.json"][1] == ["error:cross_domain_redirect", "status:302", "redirect_to:https://else.test/x", "cross_origin_hit:https://else.test"]
    assert out["spa.test", "/llms.txt"]["reasons"] == ["soft404:hash_near_dup", "soft404:html_content_type"]
    assert out["spa.test", "/ai.txt"]["reasons"] == ["soft404:hash_near_dup"] and out["spa.test", "/ai.txt"]["nx_similarity"] == 1.0


def test_challenges(spark):
    rows = [({"cf-mitigated": "challenge"}, 200, "", True), ({"server": "cloudflare"}, 503, "Just a moment", True), ({"x-datadome": "1"}, 200, "", False), ({"x-datadome": "1"}, 403, "", True), ({}, 403, "Access Denied", True), ({}, 404, "Access Denied", False)]
    out = spark.createDataFrame(rows, "h MAP<STRING,STRING>, s INT, b STRING, want BOOLEAN").select(H.challenge(F.col("s"), F.col("h"), F.col("b")).alias("c"), "want").collect()
    assert all(r["c"] == r["want"] for r in out)


def test_blocked_rule_order_and_ties(spark):
    def host(name, outcomes):
        return [(name, k, s, e, c) for k, (s, e, c) in enumerate(outcomes)]

    rows = host("tie.test", [(429, None, False), (403, None, False)] * 8) + host("tls.test", [(0, "tls", False)] * 16) + host("reset.test", [(0, "reset", False)] * 9 + [(200, None, False)] * 7)
    rows += host("half.test", [(403, None, False)] * 8 + [(200, None, False)] * 8) + host("proxy.test", [(403, "proxy_denied", False)] * 9 + [(403, None, False)] * 7) + host("gone.test", [(302, "cross_domain_redirect", False)] * 16)
    df = spark.createDataFrame(rows, "host STRING, seq INT, status INT, error STRING, challenge BOOLEAN")
    got = {r["host"]: (r["blocked"]["blocked"], r["blocked"]["reason"]) for r in classify.blocked(df).collect()}
    assert got["tie.test"] == (True, "403 on 16/16 probes") and got["tls.test"] == (False, "unreachable:tls on 16/16 probes")
    assert got["reset.test"] == (True, "reset on 9/16 probes") and got["half.test"] == (False, None)
    assert got["proxy.test"][1].startswith("proxy_denied") and got["proxy.test"][0]
    assert {r["host"]: r["redirect_only"] for r in classify.redirect_only(df).collect()}["gone.test"]


def test_fingerprint_layers(spark):
    rows = [
        ("a", 200, {"server": "cloudflare", "cf-ray": "x"}, '<meta name="generator" content="Hugo 0.1">'),
        ("b", 200, {"server": "nginx"}, "<script src=//x.framer.com/a></script>"),
        ("c", 0, {}, ""),
        ("d", 200, {"x-vercel-id": "1"}, "/_next/static/x"),
    ]
    df = spark.createDataFrame([(h, s, f"https://{h}/", None, hd, t) for h, s, hd, t in rows], "host STRING, status INT, final_url STRING, error STRING, headers MAP<STRING,STRING>, text STRING")
    got = {r["host"]: r["fingerprint"] for r in fingerprint.fingerprints(df).collect()}
    assert (got["a"]["primary"], got["a"]["cdn"]) == ("hugo", "cloudflare") and got["b"]["hints"] == ["framer"] and got["b"]["primary"] == "nginx"
    assert got["c"]["primary"] == "unreachable" and got["d"]["platforms"] == ["nextjs", "vercel"] and got["d"]["primary"] == "nextjs"


def test_operations_keep_document_order(spark):
    doc = '{"paths":{"/b":{"post":{"operationId":"makeB"},"get":{}},"/a":{"get":{"operationId":" "}}}}'
    ops = spark.range(1).select(cards.openapi_operations(F.lit(doc)).alias("o")).first()["o"]
    assert [o["key"] for o in ops] == ["get /b", "makeB", "get /a"]


def test_matching_of_tools_and_operations(spark):
    ops = [(x, x) for x in ("getUser", "listOrders", "delete_order", "post /things/{id}")]
    df = spark.createDataFrame([("h", ["get_user", "find-orders", "createThing", "other"], ops), ("e", [], [])], "host STRING, tools ARRAY<STRING>, ops ARRAY<STRUCT<key: STRING, operation_id: STRING>>")
    got = {r["host"]: r["match"] for r in consistency.match_pairs(df).collect()}
    assert (got["h"]["matched_strict"], got["h"]["matched_loose"], got["h"]["unmatched_tools"]) == (1, 3, ["other"]) and got["e"]["jaccard_loose"] is None
    assert got["h"]["jaccard_strict"] == pytest.approx(1 / 7) and got["h"]["jaccard_loose"] == pytest.approx(3 / 5)


def test_nearest_operation_first_of_equals(spark):
    tools = spark.createDataFrame([("h", 0, "get user data"), ("h", 1, "zzz")], "host STRING, tool_pos INT, tool STRING")
    ops = spark.createDataFrame([("h", 0, "list user"), ("h", 1, "get user"), ("h", 2, "get data")], "host STRING, op_pos INT, op STRING")
    got = {r["tool_pos"]: (r["best_op"], r["overlap"]) for r in consistency.nearest_operations(tools, ops).collect()}
    assert got == {0: ("get user", 0.67), 1: (None, 0.0)}


TRIAL = "agent STRING, domain STRING, task_id STRING, start_ms BIGINT, end_ms BIGINT, answer STRING, reported_urls ARRAY<STRING>, error STRING"


def test_windows_slack_and_hosts(spark):
    trials = spark.createDataFrame([("a", "d.test", "t", 1_000_000, 2_000_000, "my Tok-A", ["https://www.d.test/llms.txt"], ""), ("a", "www.e.test", "t", 1_000_000, 2_000_000, "", [], ""), ("b", "d.test", "t", None, None, "", [], "x")], TRIAL)
    hits = [("d.test", 940_000, "/llms.txt"), ("d.test", 939_999, "/openapi.json"), ("www.d.test", 2_060_000, "/.well-known/agent.json"), (None, 1_500_000, "/.well-known/mcp-server-card"), ("www.e.test", 1_500_000, "/llms.txt"), ("d.test", 2_060_001, "/openapi.yaml")]
    df = spark.createDataFrame([(h, t, p, "Bot/1.0 x", 404) for h, t, p in hits], S.HITS)
    manifest = spark.createDataFrame([("d.test", "linked/canary", {"llms": "tok a"})], "domain STRING, cell_label STRING, tokens MAP<STRING,STRING>")
    got = {(r["agent"], r["domain"]): r for r in experiment.score_trials(manifest, trials, df).collect()}
    d = got["a", "d.test"]
    assert (d["fetched_llms"], d["fetched_card"], d["fetched_openapi"], d["fetched_a2a"], d["reported_artifact"], d["canary_in_answer"], d["cell"]) == (True, True, False, True, True, ["llms"], "linked/canary")
    assert got["a", "www.e.test"]["fetched_llms"] and got["a", "www.e.test"]["cell"] == "unknown" and not got["b", "d.test"]["fetched_any"]
    context = {(r["in_window"], r["product"]): r["n"] for r in experiment.hit_context(trials, df).collect()}
    assert context == {(True, "Bot"): 4, (False, "Bot"): 2}


def test_bootstrap_matches_a_sequential_loop(spark):
    rows = [(k, f"c{k % 5}", k % 3 == 0) for k in range(40)]
    clusters: dict = {}
    for _, c, v in rows:
        clusters.setdefault(c, []).append(v)
    groups, rng, est = list(clusters.values()), Sequential(1), []
    for _ in range(200):
        picked = [groups[int(rng() * len(groups))] for _ in groups]
        est.append(sum(map(sum, picked)) / sum(map(len, picked)))
    est.sort()
    got = experiment.clustered_interval(spark.createDataFrame(rows, "pos INT, c STRING, v BOOLEAN"), "c", "v", "pos", reps=200).first()
    assert (got["ci_low"], got["ci_high"]) == (est[5], est[195])
    assert experiment.clustered_interval(spark.createDataFrame(rows[:1], "pos INT, c STRING, v BOOLEAN"), "c", "v", "pos", reps=20).first()["ci_low"] is None


def test_bands_and_their_losses(spark):
    lines = ["﻿rank,domain", "1,a.com", "2,b.a.com", "3,1.2.3.4", "4,c.github.io", "5,b.com.", "6,b.com", "# x", "7", "8,d.co.uk", "10,a.com"]
    rows = corpora.rank_lines(spark.createDataFrame([(x, k) for k, x in enumerate(lines)], "value STRING, pos BIGINT"))
    from cairnfield.functions import hosts

    seen = corpora.visits(rows, [corpora.parse_band("1-5"), corpora.parse_band("5-10")], hosts.registrable(F.col("domain"), private=False))
    got = {r["band"]: tuple(r)[1:] for r in corpora.band_accounts(seen).collect()}
    assert got == {"1-5": (5, 3, 1, 1), "5-10": (3, 1, 2, 0)}
    assert corpora.parse_band("1k-10k") == ("1k-10k", 1001, 10000)
    with pytest.raises(ValueError):
        corpora.parse_band("10-1")


def test_registries(spark):
    official = {"servers": [{"server": {"name": "s", "remotes": [{"type": "sse", "url": "https://M.example.com/mcp"}, {"url": "https://{t}.example.com"}, {"url": "https://github.com/x"}]}}], "metadata": {"nextCursor": "c"}}
    glama = {"servers": [{"slug": "g", "repository": {"url": "https://r.example.com"}, "endpoints": [{"sseUrl": "https://e.example.com/sse"}], "homepageUrl": "https://h.example.com", "url": "https://u.example.com"}], "pageInfo": {"hasNextPage": False, "endCursor": "x"}}
    df = spark.createDataFrame([(json.dumps(official), json.dumps(glama))], "o STRING, g STRING")
    assert [tuple(r) for r in corpora.official_endpoints(df, "o").collect()] == [("m.example.com", "official", "s", "https://M.example.com/mcp", "sse")]
    assert sorted((r["host"], r["transport"]) for r in corpora.glama_endpoints(df, "g").collect()) == [("e.example.com", "sse"), ("r.example.com", None), ("u.example.com", None)]
    assert df.select(corpora.next_cursor(F.col("o"), "official"), corpora.next_cursor(F.col("g"), "glama")).first()[:] == ("c", None)
    detail = spark.createDataFrame([("q", json.dumps({"connections": [], "deploymentUrl": "https://d.example.com"}))], "qualified_name STRING, body STRING")
    assert corpora.smithery_endpoints(detail).first()["host"] == "d.example.com"


def test_labels(spark):
    hosts = spark.createDataFrame([(1, "a.com", 1), (1, "b.com", 2), (2, "c.com", 3)], "answer_id INT, host STRING, rank INT")
    answers = spark.createDataFrame([(1, json.dumps({"success": True, "result": [{"domain": "A.com.", "popularity_rank": 5, "content_categories": [{"id": 1, "name": "Shopping"}]}]})), (2, "{}")], "answer_id INT, body STRING")
    labels = corpora.labels_of_answers(hosts, answers)
    assert {r["host"]: r["status"] for r in labels.collect()} == {"a.com": "ok", "b.com": "not_found", "c.com": "error"}
    selected = corpora.select_corpora(hosts.select("host").unionByName(spark.createDataFrame([("z.com",)], "host STRING")), labels.withColumn("fetched_at", F.lit("t")))
    counts = corpora.corpus_counts(selected).first()
    assert (counts["ok"], counts["not_found"], counts["error"], counts["unlabelled"], counts["commerce"], counts["overlap"]) == (1, 1, 1, 1, 1, 0)


class Sequential:
    """The generator and the shuffle as loops, to compare with."""

    def __init__(self, seed):
        self.state = seed % 2**32

    def __call__(self):
        self.state = a = (self.state + prng.STEP) & prng.MASK
        t = (a ^ a >> 15) * (a | 1) & prng.MASK
        t ^= t + ((t ^ t >> 7) * (t | 61) & prng.MASK) & prng.MASK
        return ((t ^ t >> 14) & prng.MASK) / 4294967296

    def shuffled(self, items):
        out = list(items)
        for i in range(len(out) - 1, 0, -1):
            j = int(self() * (i + 1))
            out[i], out[j] = out[j], out[i]
        return out


def test_draws_and_shuffles_from_any_place(monkeypatch):
    rng = Sequential(99)
    want = [rng() for _ in range(500)]
    assert prng.draws(99, 1, 500).tolist() == want and prng.draws(99, 201, 50).tolist() == want[200:250]
    monkeypatch.setattr(prng, "CHUNK", 7)
    for n in (0, 1, 2, 3, 20, 333):
        for before in (0, 41):
            rng = Sequential(5)
            for _ in range(before):
                rng()
            whole = rng.shuffled(range(n))
            assert prng.permutation(n, 5, before).tolist() == whole
            for k in (1, 4, 40, 1000):
                assert prng.first_places(n, k, 5, before).tolist() == whole[:k]


@pytest.mark.parametrize("seed", [5, 20261005])
def test_samples(spark, seed):
    pool = [(f"h{k:02}", ("hugo", "unknown", "rare", "unreachable")[k % 2 if k < 60 else 2 + k // 63]) for k in range(66)]
    rows = spark.createDataFrame(pool, "host STRING, predicted STRING").repartition(5)
    sample, strata = sampling.stratified(rows, [F.col("host")], seed=seed)
    assert {r["label"]: (r["pool"], r["drawn"]) for r in strata.collect()} == {"hugo": (30, 20), "unknown": (30, 30), "rare": (3, 0), "unreachable": (3, 0)}
    rng, chosen = Sequential(seed), []
    for label, want in (("hugo", 20), ("unknown", 40)):
        chosen += rng.shuffled([h for h, p in pool if p == label])[:want]
    assert [r["host"] for r in sample.orderBy("place").collect()] == rng.shuffled(chosen)
    assert sampling.stratified(rows.filter("false"), [F.col("host")])[0].count() == 0
    for matched in (10, 90, 0):
        cand = spark.createDataFrame([(k, k < matched) for k in range(200)], "id INT, matched BOOLEAN")
        picked = sampling.half_matched(cand, [F.col("id")], seed=seed).orderBy("place").collect()
        rng = Sequential(seed)
        a = rng.shuffled(range(matched))[:50] if matched else []
        b = rng.shuffled(range(matched, 200))[: 100 - min(50, matched)]
        assert [r["id"] for r in picked] == rng.shuffled(a + b) and len(picked) == 100
    few = spark.createDataFrame([(k,) for k in range(5)], "k INT")
    assert sampling.weighted_draw(few, F.lit(1.0), 9, 1, [F.col("k")]).count() == 5


def test_scores(spark):
    sample = spark.createDataFrame([("a", "wordpress"), ("b", "wordpress"), ("c", "hugo"), ("d", "unknown"), ("e", "unknown"), ("f", "x")], "host STRING, predicted STRING")
    truth = spark.createDataFrame([("a", " WordPress"), ("b", "shopify"), ("c", "hugo"), ("d", "none"), ("e", "wordpress"), ("f", "?")], "host STRING, truth STRING")
    pairs = sampling.rated(sample, truth)
    got = sampling.overall(pairs).first()
    assert (got["n"], got["rated"], got["undecidable"], got["accuracy"]) == (6, 5, 1, 0.6) and got["kappa"] == pytest.approx(0.32 / 0.72)
    assert {r["label"]: r["precision"] for r in sampling.label_scores(pairs).collect()}["shopify"] is None


def test_shards_tile(spark):
    rows = spark.createDataFrame([(k,) for k in range(23)], "k INT")
    parts = [sorted(r["k"] for r in lookups.shard(rows, i, 3, [F.col("k")]).collect()) for i in range(3)]
    assert parts == [list(range(i, 23, 3)) for i in range(3)]
    assert lookups.parse_shard("1/3") == (1, 3)
    with pytest.raises(ValueError):
        lookups.parse_shard("3/3")


def test_hygiene_chain(spark):
    card = {"name": "n", "remotes": [{"url": "https://api.example.com/mcp"}], "authorization_servers": ["https://login.test"]}
    prm = {"resource": "https://api.example.com/mcp", "authorization_servers": ["https://auth.test/t/"], "bearer_methods_supported": ["query"]}
    auth = {"issuer": "https://auth.test/other", "code_challenge_methods_supported": ["plain"]}
    follow = [("https://api.example.com/mcp", 401, None, ""), ("https://api.example.com/.well-known/oauth-protected-resource/mcp", 200, None, json.dumps(prm)), ("https://auth.test/t/.well-known/openid-configuration", 200, None, json.dumps(auth))]
    rows = spark.createDataFrame([("www.example.com", "mcp_server_card", "mcp", "sep-2127", json.dumps(card), [], None, None)], "host STRING, source STRING, kind STRING, card_spec STRING, body STRING, reasons ARRAY<STRING>, hsts STRING, cache_control STRING")
    got = handshake.hygiene(rows.withColumn("doc", D.variant(F.col("body"))).drop("body"), spark.createDataFrame(follow, "url STRING, status INT, error STRING, body STRING")).first()
    assert got["endpoint"]["reachable"] and not got["endpoint_third_party_hosted"] and got["bearer_query_allowed"]
    assert [p["valid"] for p in got["prm_lookups"]] == [True, False]
    assert {a["issuer"]: (a["resolves"], a["issuer_match"], a["pkce_advertised"]) for a in got["authorization_servers"]} == {"https://login.test": (False, None, None), "https://auth.test/t/": (True, False, False)}
    assert got["notes"] == ["no_hsts_on_card", "bearer_query_allowed", "auth_server_metadata_unresolved", "issuer_mismatch", "no_pkce_advertised", "third_party_hosted:auth_server"]


def test_targets(spark):
    entry = lambda kind, url: {"kind": kind, "endpoint": {"url": url}, "source": kind, "notes": []}
    rows = [
        {"host": "a", "mcp_card_path": "/c", "hygiene": [entry("mcp", "https://x/1"), entry("a2a", "https://x/1"), entry("a2a", "https://x/MCP/"), entry("a2a", "https://x/no")]},
        {"host": "b", "mcp_card_path": None, "hygiene": [entry("mcp", "https://y/1")]},
        {"host": "c", "mcp_card_path": "/c", "hygiene": [entry("a2a", "https://x/1")]},
    ]
    schema = S.struct(S.HOST_RESULTS)
    df = spark.createDataFrame([{f.name: r.get(f.name) for f in schema} for r in rows], schema)
    got = sorted((r["host"], r["source"], r["endpoint"]) for r in handshake.targets(df).collect() if r["endpoint"])
    assert got == [("a", "a2a_card", "https://x/MCP/"), ("a", "mcp_card", "https://x/1"), ("c", "a2a_card", "https://x/1")]


def test_readers_and_writers(spark, tmp_path):
    lines = [json.dumps({"host": "a", "redirect_only": False, "blocked": {"blocked": True}}), "", '{"host": "b", "blo', json.dumps({"host": "a", "redirect_only": True, "blocked": {"blocked": False}})]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    path = f"file://{tmp_path}/r.jsonl"
    assert readers.read_results(spark, path).count() == 2
    assert [r["redirect_only"] for r in readers.read_results(spark, path, "first").collect()] == [False]
    assert [r["redirect_only"] for r in readers.read_results(spark, path, "last").collect()] == [True]
    assert readers.read_existing(spark, [f"file://{tmp_path}/none.jsonl"], S.HOST_RESULTS).count() == 0
    (tmp_path / "h.txt").write_text("# c\n1,a.com\nhttps://A.com/x\n2,b.com\n")
    assert sorted((r["host"], r["rank"]) for r in readers.read_hosts(spark, f"file://{tmp_path}/h.txt").collect()) == [("a.com", 1), ("b.com", 2)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("t.csv", "1,a.com\r\n2,b.com\r\n")
    assert [r["value"] for r in readers.read_zip_lines(spark, f"file://{tmp_path}/z.zip").orderBy("pos").collect()][:2] == ["1,a.com", "2,b.com"]
    (tmp_path / "s.csv").write_text('agent, domain,task_id,start_utc,end_utc,answer,reported_urls\nx,D.test,1,2026-01-01T00:00:00Z,bad,"a ""q"", b\nc",u v\n,,,,,,\n')
    t = readers.trials(readers.read_sheet(spark, f"file://{tmp_path}/s.csv")).collect()
    assert len(t) == 1 and t[0]["domain"] == "d.test" and t[0]["start_ms"] == 1767225600000 and t[0]["end_ms"] is None and t[0]["reported_urls"] == ["u", "v"] and t[0]["answer"] == 'a "q", b\nc'
    (tmp_path / "x.example.com.log").write_text('1.1.1.1 - - [05/Oct/2026:14:02:11 +0200] "GET /llms.txt?a HTTP/1.1" 200 5 "-" "UA/1"\nPOSTED\n{"ts":1791036131.5,"request":{"host":"H.test:1","uri":"/a?b"},"status":404}\n')
    got = sorted((r["host"], r["ts"], r["path"], r["status"]) for r in readers.read_logs(spark, f"file://{tmp_path}/x.example.com.log").collect())
    assert got == [("h.test", 1791036131500, "/a", 404), ("x.example.com", 1791201731000, "/llms.txt", 200)]
    rows = spark.createDataFrame([("a.com", 2), ("b.com", 1), ("c.com", None)], "host STRING, rank INT")
    sinks.write_hosts(rows, f"file://{tmp_path}/hosts", ["x", "y"])
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/hosts").collect()] == ["# x", "# y", "1,b.com", "2,a.com", "c.com"]
    sinks.append_results(rows, f"file://{tmp_path}/out", None, ["host"])
    sinks.append_results(rows, f"file://{tmp_path}/out", spark.read.parquet(f"file://{tmp_path}/out"), ["host"])
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3
    sinks.write_release(readers.read_results(spark, path), f"file://{tmp_path}/release")
    assert sinks.release_manifest(spark, f"file://{tmp_path}/release/*.gz").filter("length(sha256) = 64").count() >= 1
    assert "host" in sinks.table(rows)


def test_lines_keep_the_order_of_the_given_files(spark, tmp_path):
    """The first line counts by the given list of files, though Spark reads larger files first."""
    (tmp_path / "a.txt").write_text("1,x.com\n")
    (tmp_path / "b.txt").write_text("# much longer\n" * 500 + "2,x.com\n3,y.com\n")
    paths = [f"file://{tmp_path}/a.txt", f"file://{tmp_path}/b.txt"]
    assert {r["host"]: r["rank"] for r in readers.read_hosts(spark, paths).collect()} == {"x.com": 1, "y.com": 3}
    assert {r["host"]: r["rank"] for r in readers.read_hosts(spark, paths[::-1]).collect()} == {"x.com": 2, "y.com": 3}
    assert [r["rank"] for r in readers.read_rank_lines(spark, paths).orderBy("pos").collect()] == [1, 2, 3]


def test_first_rows_are_kept_before_the_shuffle(spark):
    """Deduplication keeps one row of a key in each task."""
    plan = classify.dedupe(spark.range(10).selectExpr("id % 3 AS k", "id"), ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_cells_are_balanced(spark):
    names = [" B.test", "a.test", "b.test", ""] + [f"d{k}.test" for k in range(9)]
    made = experiment.assigned(spark.createDataFrame(list(enumerate(names)), "pos INT, domain STRING"), 3).orderBy("place").collect()
    cells = [r["cell"] for r in made]
    assert [r["domain"] for r in made] == Sequential(3).shuffled(["b.test", "a.test"] + [f"d{k}.test" for k in range(9)])
    assert cells[:4] == ["linked/canary", "unlinked/canary", "linked/control", "unlinked/control"] and cells[4:8] == cells[:4] and all(r["linked"] == r["cell"].startswith("linked") for r in made)


def test_menu_links_come_first(spark):
    from cairnfield.operators import pages

    html = '<a href="/first">x</a><nav><a href="/menu">m</a><a href=\'https://shop.a.test/s#x\'>s</a></nav><a href="/x.PNG">i</a><a href="/logout">l</a><a href="https://b.test/">b</a><a href="#top">t</a><header><a href="/head">h</a></header><a href="/menu#2">again</a><a href="mailto:x@a.test">e</a>'
    rows = spark.createDataFrame([(1, "https://www.a.test/", html), (2, "https://c.test/", "no links")], "page_id INT, url STRING, html STRING").withColumn("links", pages.candidates(F.col("html")))
    got = [(r["n"], r["link"]) for r in pages.pick_links(rows, 4).orderBy("n").collect()]
    assert got == [(1, "https://www.a.test/menu"), (2, "https://shop.a.test/s"), (3, "https://www.a.test/head"), (4, "https://www.a.test/first")]


def test_answers_of_services(spark):
    bodies = {"responses": {"output": [{"type": "message", "content": [{"type": "output_text", "text": "hi"}]}, {"type": "web_search_call", "action": {"url": "u"}}]}, "messages": {"content": [{"type": "text", "text": "a"}, {"type": "web_search_tool_result", "content": [{"url": "u"}, {"url": "u"}]}]}, "candidates": {"candidates": [{"content": {"parts": [{"text": "x"}, {"text": "y"}]}, "grounding_metadata": {"grounding_chunks": [{"web": {"uri": "u"}}]}}]}}
    want = {"responses": ("hi", ["u"]), "messages": ("a", ["u"]), "candidates": ("xy", ["u"])}
    for shape, body in bodies.items():
        got = readers.answers(spark.createDataFrame([(json.dumps(body),)], "body STRING"), shape).first()
        assert (got["answer"], got["urls"]) == want[shape]


def test_summary_properties(spark):
    from cairnfield.plans import views

    sf = "/root/testdata/sf0.001"
    a, b = views.results(spark, sf), views.results(spark, sf, 5)
    matrix = sum(r["hosts"] for r in summary.class_matrix(a, b).collect())
    assert matrix == a.join(b, "host").count()
    rows = summary.path_agreement(a, b, S.probe_specs(spark)).collect()
    assert len(rows) == 14 and len({r["both_valid"] + r["a_only"] + r["b_only"] + r["neither"] for r in rows}) == 1
    for r in summary.prevalence(a, S.probe_specs(spark)).collect():
        p = r["valid_reachable"] / r["reachable"]
        assert r["wilson_low"] <= p + 1e-12 and p <= r["wilson_high"] + 1e-12
    assert "wilson95" in sinks.prevalence_report(summary.prevalence(a, S.probe_specs(spark)))


def test_streams(spark, tmp_path):
    hits = spark.createDataFrame([("2026-01-01 00:10:00", "h", "/llms.txt", "u"), ("2026-01-01 00:20:00", "h", "/x", "u"), ("2026-01-01 05:00:00", "h", "/x", "u")], "ts STRING, host STRING, path STRING, ua STRING").withColumn("ts", F.to_timestamp("ts"))
    hits.write.parquet(f"file://{tmp_path}/hits")
    stream = spark.readStream.schema(hits.schema).parquet(f"file://{tmp_path}/hits")
    q = stream_hits.hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hourly_hits").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["artifact"], r["n"]) for r in spark.table("hourly_hits").collect()} == {("llms", 1), ("other", 1)} | {("other", 1)}
    assert stream_hits.sessions(hits).count() == 2


def test_registered_bootstrap_has_all_replicates(spark):
    """The registered query gives the interval of the operator's own number of replicates."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "source", (F.col("quality") == 1).alias("good"))
    assert queries_rows.cluster_bootstrap_ci(spark, sf).first() == experiment.clustered_interval(rows, "source", "good", "doc_id").first()
