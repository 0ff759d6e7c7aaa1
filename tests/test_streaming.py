"""Transactional appends and the stateful stream join."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnfield.operators import experiment
from cairnfield.sources import commit
from cairnfield.streaming import ledger, trials


def frame(spark, rows):
    return spark.createDataFrame(rows, "host STRING, path STRING, n INT")


def test_batches_are_added_once(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/t", ["host", "path"], buckets=2, bucket_rows=4)
    with pytest.raises(FileNotFoundError):
        book.rows()
    assert book.append(frame(spark, [("a", "/", 1), ("a", "/", 2), ("b", None, 1), ("b", None, 2)]), 0) == 2
    assert book.append(frame(spark, [("a", "/", 3), ("c", "/", 1), ("b", None, 3)]), 1) == 1
    assert book.append(frame(spark, [("z", "/", 9)]), 1) == 0  # that batch is done
    assert book.append(frame(spark, [("z", "/", 9)]), 1, writer="other") == 1
    assert book.append(frame(spark, []), 2) == 0
    assert sorted(r["host"] for r in book.rows().collect()) == ["a", "b", "c", "z"]


def test_killed_batches_leave_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    book = ledger.Ledger(spark, path, ["host", "path"], buckets=2, bucket_rows=3)
    book.append(frame(spark, [(f"h{k}", "/", k) for k in range(5)]), 0)
    real = commit.publish

    def killed(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(commit, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        book.append(frame(spark, [(f"h{k}", "/", k) for k in range(12)]), 1)
    monkeypatch.setattr(commit, "publish", real)
    assert book.rows().count() == 5 and book.done_keys(book.state()).count() == 5
    assert book.append(frame(spark, [(f"h{k}", "/", k) for k in range(8)]), 1) == 3
    assert sorted(r["host"] for r in book.rows().collect()) == sorted(f"h{k}" for k in range(8))


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/t", ["host"], buckets=2, bucket_rows=50)
    per_batch = []
    for k in range(6):
        book.append(spark.range(400 * k, 400 * (k + 1)).select(F.concat(F.lit("h"), "id").alias("host")), k)
        state = book.state()
        one = spark.createDataFrame([("h3",)], "host STRING").select(book._bucket(state["buckets"])).first()[0]
        read = book.done_keys(state, [one])
        assert read.filter("host = 'h3'").count() == 1
        per_batch.append(read.count())
        assert state["rows"] == 400 * (k + 1) and state["rows"] <= state["buckets"] * 50
    assert max(per_batch) <= 120  # a bucket stays as small while the table grows sixfold
    assert book.done_keys(book.state()).count() == 2400


def test_markers_aren_t_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/m/x.json"
    commit.publish(spark, path, "1")
    with pytest.raises(Exception, match="exist"):
        commit.publish(spark, path, "2")
    assert commit.read_text(spark, path) == "1"
    commit.publish(spark, path, "3", replace=True)
    assert commit.read_text(spark, path) == "3" and commit.names(spark, f"file://{tmp_path}/m") == ["x.json"]
    assert commit.read_text(spark, path + "no") is None and commit.names(spark, path + "no") == []


def test_streams_append_across_restarts(spark, tmp_path):
    source, path, checkpoint = f"file://{tmp_path}/in", f"file://{tmp_path}/t", f"file://{tmp_path}/c"

    def run(again=checkpoint):
        rows = spark.readStream.schema("host STRING, path STRING, n INT").option("maxFilesPerTrigger", 1).json(source)
        ledger.append_stream(rows, path, again, ["host"], available_now=True).awaitTermination()
        return sorted((r["host"]) for r in ledger.Ledger(spark, path, ["host"]).rows().collect())

    frame(spark, [("a", "/", 1), ("b", "/", 1)]).coalesce(1).write.mode("append").json(source)
    assert run() == ["a", "b"]
    frame(spark, [("b", "/", 2), ("c", "/", 1)]).coalesce(1).write.mode("append").json(source)
    assert run() == ["a", "b", "c"]
    assert run(f"file://{tmp_path}/c2") == ["a", "b", "c"]  # another query over the same files adds nothing


def test_stateful_join_equals_the_join_over_tables(spark, tmp_path):
    day = 86_400_000
    r = random.Random(8)
    made = [("x" if k % 3 else "y", 10 * day + r.randint(0, 6 * day)) for k in range(40)]
    tests = [(k, f"{d}.test", s, s + r.choice([0, 3_600_000, 3 * day])) for k, (d, s) in enumerate(made)]
    hits = [(r.choice(["x.test", "www.x.test", "y.test", "z.test", None]), 9 * day + r.randint(0, 12 * day), f"/{k}") for k in range(300)]
    hits += [("x.test", tests[1][2] - 60_000, "/edge"), ("x.test", tests[1][3] + 60_000, "/edge"), ("x.test", tests[1][3] + 60_001, "/beyond")]
    tests.append((99, "x.test", 12 * day, 11 * day))  # ends before it starts
    t_schema, h_schema = "id INT, domain STRING, start_ms BIGINT, end_ms BIGINT", "host STRING, ts BIGINT, path STRING"
    t, h = spark.createDataFrame(tests, t_schema), spark.createDataFrame(hits, h_schema)
    want = sorted((x["id"], x["ts"], x["path"]) for x in experiment.window_hits(t, h.filter("host is not null")).collect())
    # both streams come in four parts, by time but for some hours of disorder
    jitter = {id(x): r.randint(0, 3_000_000) for x in tests + hits}
    for name, rows, at in (("t", tests, 2), ("h", hits, 1)):
        (tmp_path / name).mkdir()
        ordered = sorted(rows, key=lambda x: x[at] + jitter[id(x)])
        fields = [x.split()[0] for x in (t_schema if name == "t" else h_schema).split(", ")]
        for k in range(4):
            part = ordered[k * len(ordered) // 4 : (k + 1) * len(ordered) // 4]
            (tmp_path / name / f"{k}.json").write_text("".join(json.dumps(dict(zip(fields, x, strict=True))) + "\n" for x in part))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", trials.PROVIDER)
    try:
        read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/{name}")
        joined = trials.window_hits(read("t", t_schema), read("h", h_schema), late="3 days")
        query = joined.writeStream.format("memory").queryName("stateful_pairs").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(300)
        got = sorted((x["id"], x["ts"], x["path"]) for x in spark.table("stateful_pairs").select("trial.id", "hit.ts", "hit.path").collect())
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert got == want and len(want) > 100 and ("/edge" in {x[2] for x in got}) and "/beyond" not in {x[2] for x in got if x[0] == 1}
    assert held[-1] < max(held)  # timers have dropped what can't match any more


class Held:
    """A state's list and timers, as a processor sees those of one key."""

    def __init__(self):
        self.lists, self.timers = {}, []

    def getListState(self, name, schema):  # noqa: N802
        self.lists[name] = held = []

        class State:
            get, appendValue, clear = staticmethod(lambda: iter(list(held))), staticmethod(held.append), staticmethod(held.clear)

        return State

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_a_key_of_many_rows_has_one_timer_and_a_value_a_batch():
    r = random.Random(4)
    held, made = Held(), trials.Windows(1_000_000, 60)
    made.init(held)
    rows = [(r.random() < 0.5, f"d{r.randint(0, 5)}", lo, lo + r.choice([0, 5, 90_000]), f"{k}") for k in range(3000) for lo in [r.randint(0, 500_000)]]
    rows = [(x[0], x[1], x[2], x[3] if x[0] else x[2], x[4]) for x in rows]
    got, columns = [], ["is_trial", "domain", "lo", "hi", "row"]
    for k in range(0, 3000, 1000):
        parts = [pd.DataFrame(rows[k : k + 600], columns=columns), pd.DataFrame(rows[k + 600 : k + 1000], columns=columns)]
        got += [tuple(x) for frame in made.handleInputRows(("g", 0), iter(parts), None) for x in frame.itertuples(index=False)]
    hits = [x for x in rows if not x[0]]
    assert sorted(got) == sorted((t[4], h[4]) for t in rows if t[0] for h in hits if t[1] == h[1] and t[2] <= h[2] <= t[3]) and len(got) > trials.PAIRS
    assert held.timers == [1_000_060] and len(held.lists["trials"]) == len(held.lists["hits"]) == 3
    assert list(made.handleExpiredTimer(("g", 0), None, None)) == [] and not held.lists["trials"] and not held.lists["hits"]
