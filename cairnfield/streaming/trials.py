"""Trials and hits as streams: a keyed state with timers joins each hit with every trial whose window holds it.

The event time of a trial is its start, that of a hit its time. Windows and hits
are dealt over spans of time, so a domain with most of the rows is many keys. A
span is held until the watermark has passed its end and the slack: no hit of it
can come any more, nor a trial that starts early enough to reach into it. One
timer a key then drops its trials and hits. So windows may be of any length, and
the result is that of the join over tables, but for rows that come later than
`late` after rows of their stream.

Many small domains may be dealt over groups, so that calls for a key's state and
timers follow the rows, not the domains. The rows of a batch are one value of the
state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairnfield.operators.experiment import SLACK_MS, _hosts

SPAN_MS, PAIRS = 6 * 3_600_000, 10_000
OUTPUT = "trial STRING, hit STRING"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = ["domain", "lo", "hi", "row"]
_STATE = "domain ARRAY<STRING>, lo ARRAY<BIGINT>, hi ARRAY<BIGINT>, row ARRAY<STRING>"


class Windows(StatefulProcessor):
    """State of a group of domains and a span: open windows (lo, hi) and hits (lo = hi = time), with their rows as JSON."""

    def __init__(self, span_ms: int, slack_ms: int) -> None:
        self.span_ms, self.slack_ms = span_ms, slack_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trials, self.hits = handle.getListState("trials", _STATE), handle.getListState("hits", _STATE)

    @staticmethod
    def _pairs(trials: pd.DataFrame, hits: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(trials) or not len(hits):
            return
        codes = pd.factorize(pd.concat([trials["domain"], hits["domain"]]))[0].astype(np.int64)
        times = np.unique(hits["lo"].to_numpy(np.int64))
        place = lambda code, at, side: code * (len(times) + 1) + np.searchsorted(times, at.to_numpy(np.int64), side)
        line = place(codes[len(trials) :], hits["lo"], "left")
        order = np.argsort(line, kind="stable")
        line, of = line[order], codes[: len(trials)]
        first = np.searchsorted(line, place(of, trials["lo"], "left"), "left")
        count = np.searchsorted(line, place(of, trials["hi"], "right"), "left") - first
        stop = np.cumsum(count)
        left, right = trials["row"].to_numpy(object), hits["row"].to_numpy(object)[order]
        for k in range(0, int(stop[-1]), PAIRS):
            at = np.arange(k, min(k + PAIRS, int(stop[-1])))
            t = np.searchsorted(stop, at, "right")
            yield pd.DataFrame({"trial": left[t], "hit": right[at - stop[t] + count[t] + first[t]]}, dtype=object)

    @staticmethod
    def _held(state) -> pd.DataFrame:
        parts = [pd.DataFrame(dict(zip(_FIELDS, x, strict=True))) for x in state.get()]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=_FIELDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old_trials, old_hits = self._held(self.trials), self._held(self.hits)
        if not len(old_trials) and not len(old_hits):
            self.handle.registerTimer((int(key[1]) + 1) * self.span_ms + self.slack_ms)
        came = pd.concat(list(rows), ignore_index=True)
        is_trial = came["is_trial"].astype(bool)
        trials, hits = came.loc[is_trial, _FIELDS], came.loc[~is_trial, _FIELDS]
        for state, own in ((self.trials, trials), (self.hits, hits)):
            if len(own):
                state.appendValue(tuple(own[c].tolist() for c in _FIELDS))
        yield from self._pairs(trials, pd.concat([old_hits, hits]) if len(old_hits) else hits)
        yield from self._pairs(old_trials, hits)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.trials.clear()
        self.hits.clear()
        yield from ()

    def close(self) -> None:
        pass


def window_hits(trials: DataFrame, hits: DataFrame, *, slack_ms: int = SLACK_MS, late: str = "2 hours", span_ms: int = SPAN_MS, groups: int | None = None) -> DataFrame:
    """Pairs (trial, hit: structs of the rows of both streams) of a domain's trials (domain, start_ms, end_ms) and hits (host, ts in milliseconds) in their windows.

    Needs a state store with timers (`PROVIDER` in spark.sql.streaming.stateStore.providerClass). Hits without a host match nothing here.
    Each domain is a key of the state, or each of so many groups of domains.
    """
    spark = trials.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    lo, hi = F.col("start_ms") - slack_ms, F.col("end_ms") + slack_ms
    spans = F.sequence(F.floor(lo / span_ms), F.floor(hi / span_ms))
    row = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    t = trials.filter(hi >= lo).select("domain", F.timestamp_millis("start_ms").alias("at"), F.lit(True).alias("is_trial"), lo.alias("lo"), hi.alias("hi"), row(trials).alias("row"), F.explode(spans).alias("span"))
    h = hits.filter("host is not null and ts is not null").select(F.explode(_hosts(F.col("host"))).alias("domain"), F.timestamp_millis("ts").alias("at"), F.lit(False).alias("is_trial"), F.col("ts").alias("lo"), F.col("ts").alias("hi"), row(hits).alias("row"))
    h = h.withColumn("span", F.floor(F.col("lo") / span_ms))
    both = t.withWatermark("at", late).unionByName(h.withWatermark("at", late))
    both = both.withColumn("group", F.col("domain") if groups is None else F.pmod(F.xxhash64("domain"), F.lit(groups)).cast("string"))
    made = both.groupBy("group", "span").transformWithStateInPandas(statefulProcessor=Windows(span_ms, slack_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    return made.select(F.from_json("trial", trials.schema).alias("trial"), F.from_json("hit", hits.schema).alias("hit"))
