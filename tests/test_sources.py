"""Registry chains, archives, suffix rules, corpora, and the joins without a plain key."""

import json
import random
import struct
import tracemalloc
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.functions import hosts as H
from cairnfield.functions import simhash
from cairnfield.operators import consistency, near, search, sweep
from cairnfield.sources import archives, files, registry_pages, sinks

# ------------------------------------------------------------------------------------------------------------ registries


def _capture(folder, registry, chain, pages):
    at = folder / f"registry={registry}" / f"chain={chain}"
    at.mkdir(parents=True)
    for k, part in enumerate((pages[::2], pages[1::2])):
        (at / f"part-{k}.txt").write_text("".join(json.dumps({"cursor": c, "body": json.dumps(b)}) + "\n\n" for c, b in part))


def _official(names, after):
    return {"servers": [{"name": n} for n in names], "metadata": {"nextCursor": after} if after else {}}


def test_chains_are_followed_in_order(spark, tmp_path):
    pages = [("c", _official("ef", None)), ("", _official("ab", "b")), ("b", _official("cd", "c")), ("b", _official("zz", "x")), ("lost", _official("q", None))]
    _capture(tmp_path, "official", "one", pages)
    _capture(tmp_path, "official", "loop", [("", _official("a", "b")), ("b", _official("b", ""))])
    _capture(tmp_path, "glama", "two", [("", {"servers": [1, 2], "pageInfo": {"hasNextPage": True, "endCursor": "k"}}), ("k", {"pageInfo": {"hasNextPage": False, "endCursor": "m"}})])
    _capture(tmp_path, "smithery", "three", [("2", {"servers": [1], "pagination": {"totalPages": 2}}), ("", {"servers": [], "pagination": {"totalPages": 2}}), ("3", {"servers": [9]})])
    _capture(tmp_path, "official", "round", [("", _official("a", "b")), ("b", _official("b", "b"))])
    rows = registry_pages.read_registry(spark, f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() == 5
    got = {}
    for r in rows.collect():
        got.setdefault((r["registry"], r["chain"]), []).append((r["page"], r["cursor"], r["servers"]))
    assert got == {
        ("official", "one"): [(0, "", 2), (1, "b", 2), (2, "c", 2)],
        ("official", "loop"): [(0, "", 1), (1, "b", 1)],
        ("official", "round"): [(0, "", 1), (1, "b", 1)],
        ("glama", "two"): [(0, "", 2), (1, "k", 0)],
        ("smithery", "three"): [(0, "", 0), (1, "2", 1)],
    }
    assert rows.collect() == rows.collect()
    assert registry_pages.read_registry(spark, f"file://{tmp_path}", registry="glama").count() == 2
    assert registry_pages.read_registry(spark, f"file://{tmp_path}", registry="official", limit="1").count() == 3


def test_broken_chains(spark, tmp_path):
    _capture(tmp_path, "official", "one", [("", _official("a", "gone"))])
    with pytest.raises(Exception, match="no capture of cursor 'gone'"):
        registry_pages.read_registry(spark, f"file://{tmp_path}").collect()
    assert registry_pages.read_registry(spark, f"file://{tmp_path}", missing="stop").count() == 1


# -------------------------------------------------------------------------------------------------------------- archives


def test_members_are_read_by_ranges(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.comment = b"PK\x05 is no end"
        z.writestr("dir/", "")
        z.writestr("one.CSV", "1,a.com\r\n2,b.com", zipfile.ZIP_DEFLATED)
        z.writestr("note.txt", "x\n")
        z.writestr("two.csv", "naïve\n\nlast\n", zipfile.ZIP_STORED)
        z.writestr("none.csv", "")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("only.txt", "first\n")
    rows = archives.read_zip_lines(spark, f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() == 3
    assert [(r["name"], r["pos"], r["value"]) for r in rows.orderBy("name", "pos").collect()] == [("one.CSV", 0, "1,a.com"), ("one.CSV", 1, "2,b.com"), ("two.csv", 0, "naïve"), ("two.csv", 1, ""), ("two.csv", 2, "last")]
    assert [r["value"] for r in archives.read_zip_lines(spark, f"file://{tmp_path}/b.zip", fallback="true").collect()] == ["first"]


def _one(path, name=None):
    reader = archives.MemberReader({"path": str(path), "suffix": ""})
    parts = reader.partitions()
    return [x for part in parts for b in reader.read(part) for x in b.column(3).to_pylist()], parts


def test_broken_members_are_errors(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("t.csv", "some text that is long enough\n" * 50, zipfile.ZIP_DEFLATED)
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    assert len(_one(tmp_path / "a.zip")[0]) == 50
    at = raw.find(b"PK\x01\x02")
    for change, said in (((at + 16, 1), "checksum"), ((at + 8, 1), "encrypted"), ((at + 10, 14 ^ 8), "unsupported")):
        bad = bytearray(raw)
        bad[change[0]] ^= change[1]
        (tmp_path / "bad.zip").write_bytes(bad)
        with pytest.raises(ValueError, match=said):
            _one(tmp_path / "bad.zip")
    (tmp_path / "no.zip").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="no end record"):
        _one(tmp_path / "no.zip")


def test_large_archives_have_wide_fields(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z, z.open(zipfile.ZipInfo("t.csv"), "w", force_zip64=True) as f:
        f.write(b"a\nb\n")
    assert _one(tmp_path / "a.zip")[0] == ["a", "b"]
    assert archives._wide(struct.pack("<HHQHHQQ", 9, 8, 1, 1, 16, 5 << 32, 6 << 32), 0xFFFFFFFF, 7, 0xFFFFFFFF) == (5 << 32, 7, 6 << 32)


def test_a_member_is_never_held_whole(tmp_path):
    line = b"0123456789" * 10 + b"\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("t.csv", "w") as f:
        for _ in range(300):
            f.write(line * 10_000)
    reader = archives.MemberReader({"path": str(tmp_path / "a.zip")})
    (part,) = reader.partitions()
    tracemalloc.start()
    n = sum(b.num_rows for b in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 3_000_000 and part.member.size > 300_000_000 and peak < 100_000_000


def test_lines_over_chunks():
    text = "a\r\nné日\n\n\r\nend\r"
    raw = text.encode()
    for size in (1, 2, 3, 100):
        assert list(files.lines_of(raw[i : i + size] for i in range(0, len(raw), size))) == ["a", "né日", "", "", "end"]
    assert list(files.lines_of([])) == [] and list(files.lines_of([b"x\xff\n"])) == ["x�"]


# -------------------------------------------------------------------------------------------------------------- suffixes


def _psl(host, rules, private=True):
    """The public algorithm by loops."""
    host = host.lower().removesuffix(".")
    labels = host.split(".")
    if not host or len(labels) < 2 or (len(labels) == 4 and all(map(str.isdigit, labels))):
        return None
    best = 1
    for rule, own in rules:
        if own and not private:
            continue
        name = rule.removeprefix("!").split(".")
        tail = labels[-len(name) :]
        if len(tail) == len(name) and all(r in ("*", x) for r, x in zip(name, tail, strict=True)):
            if rule.startswith("!"):
                best = len(name) - 1
                break
            best = max(best, len(name))
    return ".".join(labels[-best - 1 :]) if len(labels) > best else None


def test_suffix_rules_of_all_kinds(spark, tmp_path):
    r = random.Random(2)
    rules = [("!www.ck", False), ("!city.kawasaki.jp", False), ("ck", False), ("*.ck", False), ("jp", False), ("*.kawasaki.jp", False), ("co.uk", False), ("uk", False), ("*.dev.x", True), ("x", False)]
    hosts = [".".join(r.choice(["www", "ck", "a", "city", "kawasaki", "jp", "co", "uk", "dev", "x", "10"]) for _ in range(r.randint(1, 5))) + r.choice(["", "", "."]) for _ in range(400)]
    hosts = sorted({*hosts, "WWW.Ck", "a.www.ck", "b.c.ck", "ck", "1.2.3.4", "", "city.kawasaki.jp"})
    (tmp_path / "list.dat").write_text("// c\n" + "\n".join(n for n, p in rules if not p) + "\n// ===BEGIN PRIVATE DOMAINS===\r\n" + "\r\n".join(n + " x" for n, p in rules if p) + "\r\n// ===END PRIVATE DOMAINS===\n")
    table = H.suffix_rules(spark, f"file://{tmp_path}/list.dat")
    assert sorted((x["suffix"], x["private"]) for x in table.collect()) == sorted(rules)
    rows = spark.createDataFrame([(h,) for h in hosts], "host STRING")
    for private in (True, False):
        want = {h: _psl(h, rules, private) for h in hosts}
        by_column = {x["host"]: x["d"] for x in rows.select("host", H.registrable(F.col("host"), rules, private=private).alias("d")).collect()}
        by_join = {x["host"]: x["registrable_domain"] for x in H.registrable_join(rows, table, private=private).collect()}
        assert by_column == want and by_join == want


def test_international_names(spark, tmp_path):
    (tmp_path / "list.dat").write_text("!a.公司.cn\n*.公司.cn\ncn\n")
    table = H.suffix_rules(spark, f"file://{tmp_path}/list.dat")
    assert {x["suffix"] for x in table.collect()} == {"!a.xn--55qx5d.cn", "*.xn--55qx5d.cn", "cn"}
    rows = spark.createDataFrame([("x.y.公司.cn",), ("x.y.xn--55qx5d.cn",), ("A.公司.cn",)], "host STRING")
    got = {x["host"]: x["registrable_domain"] for x in H.registrable_join(rows, table, international=True).collect()}
    assert got == {"x.y.公司.cn": "x.y.xn--55qx5d.cn", "x.y.xn--55qx5d.cn": "x.y.xn--55qx5d.cn", "A.公司.cn": "a.xn--55qx5d.cn"}


def test_same_site(spark):
    rows = [("a.example.com", "b.example.com", True), ("a.github.io", "b.github.io", False), ("www.github.io", "github.io", True), ("1.2.3.4", "1.2.3.4", True), ("1.2.3.4", "9.2.3.4", False), ("h.fixture", "h.fixture", True), ("a.b.nowhere", "c.b.nowhere", True), ("com", "com", True), ("[::1]", "::1", True)]
    frame = spark.createDataFrame(rows, "a STRING, b STRING, want BOOLEAN")
    assert frame.filter(H.same_site(F.col("a"), F.col("b")) != F.col("want")).collect() == []


# --------------------------------------------------------------------------------------------------------------- corpora


def test_runs_merge_their_lists(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/c"
    one = spark.createDataFrame([("b.com", 2), ("a.com", 1), ("c.com", None)], "host STRING, rank INT")
    sinks.write_corpus({"1-10": one}, folder, "t1", {"v": 1})
    both = sinks.write_corpus({"10-20": one.filter("rank = 2"), "20-30": one.filter("false")}, folder, "t1", {"v": 2})
    assert both["v"] == 2 and {k: x["hosts"] for k, x in both["lists"].items()} == {"1-10": 3, "10-20": 1, "20-30": 0}
    assert [r["value"] for r in spark.read.text(both["lists"]["1-10"]["file"]).collect()][1:] == ["1,a.com", "2,b.com", "c.com"]
    before = sinks.read_sidecar(spark, f"{folder}/t1.meta.json")

    def killed(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(sinks, "write_hosts", killed)
    with pytest.raises(KeyboardInterrupt):
        sinks.write_corpus({"1-10": one.filter("rank = 1")}, folder, "t1", {"v": 3})
    monkeypatch.undo()
    assert sinks.read_sidecar(spark, f"{folder}/t1.meta.json") == before
    sinks.write_corpus({"1-10": one.filter("rank = 1")}, folder, "t1", {"v": 4})
    after = sinks.read_sidecar(spark, f"{folder}/t1.meta.json")
    assert {k: x["hosts"] for k, x in after["lists"].items()} == {"1-10": 1, "10-20": 1, "20-30": 0}
    assert sinks.read_sidecar(spark, f"{folder}/latest.json")["1-10"]["file"] == after["lists"]["1-10"]["file"]
    (tmp_path / "c" / "t1.meta.json").write_text("{broken")
    (tmp_path / "c" / ".t1.meta.json.crc").unlink(missing_ok=True)
    assert set(sinks.write_corpus({"x": one}, folder, "t1", {})["lists"]) == {"x"}


def test_registry_corpus_and_tables(spark, tmp_path):
    ends = spark.createDataFrame([("official", "s1", "a.com", "https://a.com/m"), ("official", "s2", "a.com", "https://a.com/n"), ("glama", "s3", "b.com", "https://b.com/")], "registry STRING, server STRING, host STRING, url STRING")
    made = sinks.write_registries(ends, spark.createDataFrame([("a.com", 7), ("b.com", None)], "host STRING, rank INT"), f"file://{tmp_path}/r", "2026-01-01", {})
    assert made["sources"] == {"official": {"endpoints": 2, "hosts": 1}, "glama": {"endpoints": 1, "hosts": 1}} and made["ranked"] == 1 and spark.read.json(made["endpoints"]).count() == 3
    rows = spark.createDataFrame([(k, f"h{k % 7}", None if k % 2 else 1.5) for k in range(1500)], "k INT, name STRING, x DOUBLE")
    sinks.write_table(rows, f"file://{tmp_path}/t", ["k"])
    lines = [r["value"] for r in spark.read.text(f"file://{tmp_path}/t").collect()]
    assert lines[:4] == ["k     name  x", "----  ----  ---", "0     h0    1.5", "1     h1    -"] and len(lines) == 1502
    assert len(sinks.table(rows).splitlines()) == 1502


def test_reports(spark):
    pairs = spark.createDataFrame([(["getUser"], [("getUser", "getUser")], True), (["zzz"], [("getUser", "getUser")], True)], "tools ARRAY<STRING>, ops ARRAY<STRUCT<key: STRING, operation_id: STRING>>, pair BOOLEAN")
    rows = consistency.match_pairs(pairs).withColumns({"coverage": F.lit(False), "llms": F.lit(None).cast("struct<openapi:array<string>,card:array<string>,openapi_resolves:array<boolean>,card_resolves:array<boolean>>")})
    report = sinks.consistency_report(consistency.summary(rows))
    assert "median overlap, loose: 0.50; strict: 0.50; hosts with none (loose): 1; with all: 1" in report and "1 of 2 (50.0%)" in report
    assert "n/a" in sinks.consistency_report(consistency.summary(rows.filter("false")))
    matrix = spark.createDataFrame([("blocked", "reachable", 3), ("reachable", "reachable", 9)], "a_class STRING, b_class STRING, n BIGINT")
    assert sinks.vantage_report(matrix, matrix).splitlines()[2] == "blocked    0        3"
    assert sinks.census_report(spark.createDataFrame([("flag", "a", 1), ("flag", "b", 2)], "measure STRING, value STRING, n BIGINT")) == "flag: b 2, a 1"


# ----------------------------------------------------------------------------------------------------------------- joins


@pytest.mark.parametrize(("tile", "crowd"), [(500_000, 0), (40, 0), (40, 300), (3, 60)])
def test_sweep_equals_all_pairs(spark, tile, crowd):
    r = random.Random(tile + crowd)
    windows = [(k, s, s + r.choice([-5, 0, 3, 100, 5000])) for k in range(60) for s in [r.randint(-300, 2000)]] + [(7, 10, 20), (7, 10, 20), (8, None, 5)]
    points = [(k, r.randint(0, 1500)) for k in range(150)] + [(k, 777) for k in range(crowd)] + [(3, 15), (3, 15), (4, None)]
    w, p = spark.createDataFrame(windows, "w INT, lo BIGINT, hi BIGINT"), spark.createDataFrame(points, "p INT, at BIGINT")
    got = sweep.in_windows(w, p, F.col("lo"), F.col("hi"), F.col("at"), tile_pairs=tile)
    want = sorted((a, lo, hi, b, t) for a, lo, hi in windows for b, t in points if lo is not None and t is not None and lo <= t <= hi)
    assert sorted(map(tuple, got.collect())) == want
    assert sweep.in_windows(w, p.filter("false"), F.col("lo"), F.col("hi"), F.col("at")).count() == 0
    assert sweep.in_windows(w.filter("false"), p, F.col("lo"), F.col("hi"), F.col("at")).count() == 0


@pytest.mark.parametrize("crowd", [0, 3000])
def test_totals_of_windows_equal_all_pairs(spark, crowd):
    r = random.Random(crowd)
    big = 2**62
    windows = [(k, s, s + r.choice([-5, 0, 3, 100, 5000])) for k in range(80) for s in [r.randint(-300, 2_000_000)]] + [(k, 100, 500_000) for k in range(crowd)]
    windows += [(7, 10, 20), (7, 10, 20), (8, None, 5), (9, 30, 30), (10, -(2**60), 2**60), (11, 15, 15)]
    points = [(r.randint(-9, 9), r.randint(0, 1_500_000)) for _ in range(300)] + [(1, 777)] * crowd + [(3, 15), (3, 15), (4, None), (None, 30), (big, 1_600_000), (big, 1_700_000), (-big, 1_700_000)]
    w, p = spark.createDataFrame(windows, "w INT, lo BIGINT, hi BIGINT"), spark.createDataFrame(points, "v BIGINT, at BIGINT")
    order = lambda rows: sorted(rows, key=repr)
    got = sweep.totals(w, p, F.col("lo"), F.col("hi"), F.col("at"), F.col("v"))
    want = []
    for k, lo, hi in windows:
        held = [] if lo is None else [v for v, t in points if t is not None and lo <= t <= hi] if k >= crowd or (lo, hi) != (100, 500_000) else None
        if held is None:
            continue
        known = [v for v in held if v is not None]
        want += [(k, lo, hi, len(held), sum(known) if known else None)] * bool(held)
    rows = [tuple(x) for x in got.collect()]
    alike = [x for x in rows if x[1:3] == (100, 500_000)]
    assert order(x for x in rows if x[1:3] != (100, 500_000)) == order(x for x in want if x[1:3] != (100, 500_000))
    assert len(alike) == crowd and len({x[3:] for x in alike}) <= 1 and all(x[3] == sum(t is not None and 100 <= t <= 500_000 for _, t in points) for x in alike)
    assert sweep.totals(w, p.filter("false"), F.col("lo"), F.col("hi"), F.col("at"), F.col("v")).count() == 0
    assert sweep.totals(w.filter("false"), p, F.col("lo"), F.col("hi"), F.col("at"), F.col("v")).count() == 0


def test_the_sweep_query_makes_no_pairs(spark):
    from cairnfield import plans

    plan = plans.queries()["interval_sweep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "NestedLoop" not in plan


def test_crowded_moments_are_tiled():
    points, starts, ends = np.array([10, 10, 100_000, 10]), np.array([500, 0, 500, 0]), np.array([0, 0, 0, 1000])
    slot, cuts_p, cuts_w = sweep._slots(points, starts, ends, 1_000_000)
    hot = slot[2]
    assert list(slot).count(hot) == 1 and cuts_p[hot] * cuts_w[hot] >= 100 and (np.diff(slot) >= 0).all()
    assert 100_000 / cuts_p[hot] * 1000 / cuts_w[hot] <= 1_000_000


@pytest.mark.parametrize(("distance", "blocks", "tile"), [(6, 8, 16_384), (6, 7, 5), (6, 9, 5), (3, 5, 7), (0, 1, 3), (2, 3, 10)])
def test_near_hashes_equal_all_pairs(spark, distance, blocks, tile):
    r = random.Random(distance)
    base = [r.getrandbits(64) for _ in range(12)]
    hashes = [*base, 0, (1 << 64) - 1]
    for h in base * 6:
        for _ in range(r.randint(0, 8)):
            h ^= 1 << r.randrange(64)
        hashes.append(h)
    hashes = sorted({h - (1 << 64) if h >> 63 else h for h in hashes})
    rows = spark.createDataFrame([(h,) for h in hashes], "h BIGINT")
    got = sorted(map(tuple, near.pairs_within(rows, distance, blocks=blocks, tile_rows=tile).collect()))
    want = sorted((a, b, ((a ^ b) & ((1 << 64) - 1)).bit_count()) for k, a in enumerate(hashes) for b in hashes[k + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance)
    assert got == want and (distance == 0 or len(want) > 5)
    weighed = rows.withColumn("n", F.pmod("h", F.lit(5)) + 1)
    partners = {h: [b if a == h else a for a, b, _ in want if h in (a, b)] for h in hashes}
    for small in (1, 4, 1000):  # entries are compared in tiles, in tiles or by the join, by the join
        links = {x["h"]: (x["links"], x["linked"]) for x in near.link_counts(weighed, distance, blocks=blocks, small=small, tile_rows=tile).collect()}
        assert links == {h: (len(p), sum(o % 5 + 1 for o in p)) for h, p in partners.items() if p}


def test_classes_of_equal_hashes(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, None), (5, None), (6, -1)], "k INT, h BIGINT")
    got = sorted(map(tuple, near.near_pairs(rows, "k", "h").collect()))
    assert got == [(1, 3, 2, 1, 1), (1, 4, 2, 2, 2), (3, 4, 1, 2, 1)]
    links = sorted(map(tuple, near.near_links(rows, "k", "h").collect()))
    assert links == [(1, 1, 2, 2, 3), (2, 1, 2, 2, 3), (3, 3, 1, 2, 4), (4, 4, 2, 2, 3), (5, 4, 2, 2, 3), (6, 6, 1, 0, 0)]


def test_one_automaton_finds_what_contains_finds(spark):
    r = random.Random(3)
    letters = "ab é日"
    tokens = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(120)})
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(80)] + [None, "", "a" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k INT, said STRING")
    known = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)] + [(900, tokens[0]), (901, None), (902, "")], "id INT, token STRING")
    want = sorted((k, i) for k, s in enumerate(texts) if s for i, t in [*enumerate(tokens), (900, tokens[0])] if t in s)
    for block in (16 << 20, 300):  # all tokens in one automaton, or in several passes
        got = search.holding(rows, F.col("said"), known, ["k"], block_bytes=block)
        assert sorted((x["k"], x["id"]) for x in got.collect()) == want
    assert search.holding(rows, F.col("said"), known.filter("false"), ["k"]).count() == 0


def test_long_texts_are_hashed_in_linear_time(spark):
    text = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x" for k in range(200_000))
    rows = spark.createDataFrame([(text,), (None,), ("",), ("one",)], "t STRING").select(simhash.simhash(F.col("t")).alias("h")).collect()
    assert rows[0]["h"] is not None and rows[1]["h"] is None and rows[2]["h"] is None and rows[3]["h"] is not None
