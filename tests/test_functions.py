import base64
import gzip
import hashlib
import tracemalloc
import json
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnfield.functions import documents as D
from cairnfield.functions import hosts, http, keys, prng, robots, simhash, stats
from cairnfield.functions import text as T

L = F.lit


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_trim_takes_all_unicode_space(spark):
    assert one(spark, T.trim(L("﻿  a b　\t\n")))[0] == "a b"


def test_media_type_and_html(spark):
    assert one(spark, T.media_type(L(" Text/HTML ; charset=x")), T.media_type(F.lit(None).cast("string")), T.looks_like_html(L("  <!DOCTYPE html>x")), T.looks_like_html(L("# a"))) == ("text/html", "", True, False)


def test_origin_drops_default_ports(spark):
    assert one(spark, T.origin(L("HTTPS://Ex.com:443/a")), T.origin(L("http://ex.com:8080")), T.origin(L("nope"))) == ("https://ex.com", "http://ex.com:8080", "nope")


VECTORS = {"": "0", "a": "af63dc4c8601ec8c", "alpha beta": "0d92afb6966f1a43", "one two three four five six": "802941806500c0c3", "<p>Page not found <script>x9</script>ref a1b2c3d4</p>": None}


def test_simhash_vectors_and_both_forms(spark):
    for text, want in VECTORS.items():
        a, b = one(spark, simhash.as_hex(simhash.simhash_expr(L(text))), simhash.as_hex(simhash.simhash(L(text))))
        assert a == b and want in (None, a)


def test_similarity_bound(spark):
    a, b = (simhash.simhash_expr(L(x)) for x in ("one two three four five six", "one two three four five seven"))
    assert one(spark, simhash.similarity(a, b))[0] == 0.875


def test_prng_column_and_driver_agree(spark):
    assert list(one(spark, *[prng.draw(20261005, L(i)) for i in (1, 2, 3)])) == prng.draws(20261005, 1, 3).tolist()
    assert one(spark, prng.draw(20261005, L(1)))[0] == 0.5675064628012478


def test_wilson(spark):
    found = one(spark, *stats.wilson(L(1), L(2)), *stats.wilson(L(0), L(0)), *stats.wilson(L(0), L(10)))
    assert found == pytest.approx((0.09452865480086611, 0.905471345199134, 0, 0, 0, 0.2775401687666165), abs=1e-12)


def test_percent_rounds_exact_value():
    assert (stats.percent(1, 3), stats.percent(1, 0), stats.percent(1, 8)) == ("33.3%", "-", "12.5%")


def test_upper_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert df.agg(stats.upper_median("x"), F.median("x")).first()[:] == (3.0, 2.5)


def test_keys_fold_verbs_plurals_and_parameters(spark):
    assert one(spark, keys.loose_key(L("listUsers")), keys.loose_key(L("search_user")), keys.loose_key(L("GET /users/{id}/status")), keys.strict_key(L("list-Users"))) == ("list user", "list user", "get statu user".replace("statu ", "status "), "listusers")


def test_jaccard_null_for_two_empty_sets(spark):
    none = F.array().cast("array<string>")
    assert one(spark, keys.jaccard(none, none), keys.jaccard(F.array(L("a"), L("b")), F.array(L("b"), L("c"), L("d")))) == (None, 0.25)


def test_host_lines(spark):
    cases = {"12, https://Ex.com:8/a ": ("ex.com", 12), "# c.com": (None, None), "a.b": ("a.b", None), "": (None, None), "x": (None, None), "0,a.b": ("a.b", None)}
    for line, want in cases.items():
        assert one(spark, *hosts.host_line(L(line))) == want


def test_registrable_in_both_modes_and_forms(spark):
    names = ["a.b.co.uk", "foo.github.io", "github.io", "x.foo.github.io", "1.2.3.4", "a.b.unknown", "com", "A.Example.COM."]
    want = ["b.co.uk", "foo.github.io", None, "foo.github.io", None, "b.unknown", None, "example.com"]
    assert list(one(spark, *[hosts.registrable(L(x)) for x in names])) == want
    assert one(spark, hosts.registrable(L("foo.github.io"), private=False))[0] == "github.io"
    joined = hosts.registrable_join(spark.createDataFrame([(x,) for x in names], "host string"), hosts.suffix_table(spark)).collect()
    assert {r["host"]: r["registrable_domain"] for r in joined} == dict(zip(names, want, strict=True))


def test_www_authenticate_prefers_bearer(spark):
    got = one(spark, http.www_authenticate(L('Basic realm=x, Bearer resource_metadata="https://a/b", error="e\\"q"')), http.www_authenticate(L("Basic realm=x")), http.www_authenticate(L(" ")))
    assert (got[0]["scheme"], got[0]["resource_metadata"], got[0]["error"], got[1]["realm"], got[2]) == ("Bearer", "https://a/b", 'e"q', "x", None)


def test_sse_takes_the_first_event_with_data(spark):
    assert one(spark, http.first_sse_data(L(": c\n\ndata:\n\ndata: a\ndata: b\n\ndata: z")), http.first_sse_data(L("x"))) == ("a\nb", None)


def test_bodies_are_decoded(spark):
    raw = b"hello " * 50
    rows = [(gzip.compress(raw), "gzip"), (zlib.compress(raw), "deflate"), (zlib.compress(raw)[2:-4], "deflate"), (raw, None), (b"broken", "gzip")]
    out = spark.createDataFrame(rows, "b binary, e string").select(http.decode_body("b", "e").alias("d")).collect()
    assert [bytes(r["d"]["body"]) for r in out] == [raw, raw, raw, raw, b"broken"] and [r["d"]["error"] for r in out] == [None] * 4 + ["decode_error"]


def test_bombs_are_not_unpacked():
    """A body beyond the limit is an error, and no more than the limit is ever made of it."""
    bomb = gzip.compress(gzip.compress(bytes(300_000_000), 1), 1)
    tracemalloc.start()
    assert http.decoded(bomb, "gzip, gzip") == (None, "body_too_large")
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
    assert http.decoded(gzip.compress(b"x")[:-9], "gzip")[1] == "decode_error" and http.decoded(b"x" * (http.MAX_BODY_BYTES + 1), None) == (None, "body_too_large")


def test_a_batch_of_bodies_is_handed_on_in_parts(spark):
    raw = [None if k % 7 == 0 else bytes([65 + k % 20]) * 1_000_000 for k in range(40)]
    packed = [None if x is None else gzip.compress(x, 1) for x in raw]
    batch = (pa.array(packed, pa.binary()), pa.array(["gzip"] * 40, pa.string()))
    parts = list(http.decode_body.func(iter([batch, (batch[0][:0], batch[1][:0])])))
    assert [x["body"] for part in parts for x in part.to_pylist()] == raw
    assert len(parts) > 5 and max(part.nbytes for part in parts) < http.PART_BYTES + http.MAX_BODY_BYTES + 10_000
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(packed)], "k int, b binary").coalesce(1)
    out = rows.select("k", F.sha2(http.decode_body("b", F.lit("gzip"))["body"], 256).alias("s")).collect()
    assert {r["k"]: r["s"] for r in out} == {k: None if x is None else hashlib.sha256(x).hexdigest() for k, x in enumerate(raw)}


def test_bodies_that_are_no_utf8(spark):
    out = spark.createDataFrame([(b"na\xefve \xff",), ("naïve".encode(),)], "b binary").select(http.body_text(F.col("b")).alias("t")).collect()
    assert [r["t"] for r in out] == ["na\ufffdve \ufffd", "naïve"]


def test_simhash_of_long_tokens_needs_little_memory():
    """Many short shingles beside a very long one are hashed over one flat buffer."""
    from cairnfield.functions import simhash

    data = [b"ab c%d" % k for k in range(100_000)] + [b"x" * 10_000]
    tracemalloc.start()
    got = simhash.fnv_of(data)
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()

    def loop(x):
        h = simhash.OFFSET
        for c in x:
            h = (h ^ c) * simhash.PRIME % 2**64
        return h

    assert [int(got[k]) for k in (0, 7, 99_999, 100_000)] == [loop(data[k]) for k in (0, 7, 99_999, 100_000)]
    words = [["a b", "c"], ["d"], ["a b"] * 3]
    for row, value in zip(words, simhash._votes(words), strict=True):
        votes = [sum(1 if loop(x.encode()) >> b & 1 else -1 for x in row) for b in range(64)]
        assert value % 2**64 == sum(1 << b for b in range(64) if votes[b] > 0)


def test_error_classes(spark):
    cases = [("", "", "Proxy response (403) !== 200", "proxy_denied"), ("AbortError", "", "", "timeout"), ("", "ECONNRESET", "", "reset"), ("", "", "certificate expired", "tls"), ("", "ENOTFOUND", "", "dns"), ("", "ECONNREFUSED", "", "refused"), ("", "", "?", "other")]
    for name, code, message, want in cases:
        assert one(spark, http.error_class(L(name), L(code), L(message)))[0] == want


def test_links_are_classified(spark):
    text = 'See [api](/openapi.json "x") and https://h.test/.well-known/agent.json. [d](docs) [api](/openapi.json)'
    got = one(spark, http.llms_links(L(text), L("https://x.test/a/llms.txt")))[0]
    assert (got["openapi"], got["card"], got["total"]) == (["https://x.test/openapi.json"], ["https://h.test/.well-known/agent.json"], 3)


def test_origin_trial_tokens():
    payload = json.dumps({"feature": "F", "expiry": 1, "origin": "https://a"}).encode()
    token = base64.b64encode(bytes([3]) + bytes(64) + len(payload).to_bytes(4, "big") + payload).decode()
    assert http.decode_token(token)["feature"] == "F" and http.decode_token(token)["expiry"].startswith("1970-01-01T00:00:01")
    assert http.decode_token("AA==")["decode_error"] == "too_short"
    assert http.decode_token(base64.b64encode(bytes([9]) + bytes(80)).decode())["decode_error"] == "unknown_version:9"


def test_robots():
    groups = robots.parse("User-agent: a\nUser-agent: bot\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nDisallow: /\n# c\nDisallow:")
    assert [robots.allows(groups, p, a) for p, a in (("/x", "bot"), ("/x/y", "bot"), ("/", "other"), ("/z", "BOTTY"))] == [False, True, False, True]
    assert robots.allows(robots.parse("User-agent: *\nDisallow: /*.pdf$"), "/a.pdfx", "b") and robots.allows([], "/", "b")


def test_variant_reads_are_typed(spark):
    doc = D.variant(L('{"a":1,"b":"x","c":[1,"s"],"d":true,"e":{"k":{"u":"z"}}}'))
    assert one(spark, D.text(doc, "$.a"), D.text(doc, "$.b"), D.strings(D.items(doc, "$.c")), D.flag(doc, "$.d"), F.size(D.values(doc, "$.e")), D.number(doc, "$.a"), D.is_object(doc)) == (None, "x", ["s"], True, 1, 1.0, True)
    assert one(spark, D.lenient_json(L('{"a":1,"a":2}')), D.structured(L("openapi: 3.0.1"), L(True))) == ('{"a": 2}', '{"openapi": "3.0.1"}')
