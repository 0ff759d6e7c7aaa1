"""Writers: results, host files, sheets, reports, releases."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import stats
from cairnfield.functions import text as T
from cairnfield.operators.lookups import to_do
from cairnfield.sources import commit


def append_results(rows: DataFrame, path: str, done: DataFrame | None, keys: list[str]) -> None:
    """Appends rows whose keys aren't done yet, so a repeated run adds nothing."""
    (rows if done is None else to_do(rows, done, keys)).write.mode("append").parquet(path)


def write_hosts(hosts: DataFrame, path: str, comments: list[str]) -> None:
    """A host file: comment lines, then `rank,host` (or the host alone) in the order of the rows' rank."""
    line = F.when(F.col("rank").isNotNull(), F.concat_ws(",", F.col("rank").cast("string"), "host")).otherwise(F.col("host"))
    head = hosts.sparkSession.createDataFrame([(-1, k, f"# {c}") for k, c in enumerate(comments)], "o INT, r BIGINT, value STRING")
    body = hosts.select(F.lit(0).alias("o"), F.coalesce("rank", F.lit(2**31)).cast("bigint").alias("r"), line.alias("value"))
    head.unionByName(body).orderBy("o", "r", "value").select("value").write.text(path)


def write_sheet(rows: DataFrame, path: str, triggers: str = r'[",\r\n]') -> None:
    """RFC 4180 lines, escaped by one rule; every file has the header, so each is a sheet and all of them are one."""
    header = ",".join(rows.columns)
    lines = rows.select(F.concat_ws(",", *[F.coalesce(T.csv_escape(F.col(c), triggers), F.lit("")) for c in rows.columns]).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [header]
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([*top, *batch.column(0).to_pylist()], pa.string())], names=["value"])
                top = []

    head = rows.sparkSession.createDataFrame([(header,)], "value STRING")
    (head if lines.isEmpty() else lines.mapInArrow(headed, "value STRING")).write.text(path)


def write_release(results: DataFrame, path: str) -> None:
    """The results without hygiene as compressed JSON lines."""
    results.drop("hygiene").write.option("compression", "gzip").json(path)


def release_manifest(spark, path: str) -> DataFrame:
    """name, bytes, sha256 of the files of a release."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def merge_meta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Sidecar rows by key, those of the new run in place of old ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """The sidecar of a corpus; empty if there is none or it can't be read."""
    try:
        found = json.loads(commit.read_text(spark, path) or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def write_corpus(lists: dict[str, DataFrame], folder: str, tag: str, about: dict, accounts: dict[str, dict] | None = None, comments: dict[str, list[str]] | None = None) -> dict:
    """Writes host lists (host, and a rank or null) by label, and the sidecar `<tag>.meta.json` that names them; returns the sidecar.

    Every run writes files of its own; then the sidecar is read, entries of the same labels are replaced, others are kept,
    and it is put in place of the old one by a rename, as is `latest.json`, which points to the last run's files. So a run
    that fails changes nothing that readers see. Runs of one tag come one after another.
    """
    spark = next(iter(lists.values())).sparkSession
    run, entries = uuid.uuid4().hex, {}
    for label, hosts in lists.items():
        path = f"{folder}/{tag}-{label}/{run}"
        write_hosts(hosts, path, (comments or {}).get(label, [f"{tag} {label}; rank,host"]))
        entries[label] = {"file": path, "hosts": hosts.count(), **(accounts or {}).get(label, {})}
    old = read_sidecar(spark, f"{folder}/{tag}.meta.json")
    merged = old | about | {"tag": tag, "lists": (old.get("lists") or {}) | entries}
    commit.publish(spark, f"{folder}/{tag}.meta.json", json.dumps(merged, sort_keys=True), replace=True)
    latest = read_sidecar(spark, f"{folder}/latest.json")
    commit.publish(spark, f"{folder}/latest.json", json.dumps(latest | {label: {"tag": tag, **x} for label, x in entries.items()}, sort_keys=True), replace=True)
    return merged


def write_bands(kept: DataFrame, accounts: DataFrame, folder: str, tag: str, about: dict) -> dict:
    """Rank bands (band, rank, domain) and their accounts, a row a band, as a corpus."""
    rows = {r["band"]: {k: v for k, v in r.asDict().items() if k not in ("band", "hosts")} for r in accounts.collect()}
    own = {b: kept.filter(F.col("band") == b).select(F.col("domain").alias("host"), "rank") for b in rows}
    said = {b: [f"{tag} ranks {b}", f"registrable domains from {x.get('input_rows')} rows ({x.get('dedupe_losses')} dedupe losses, {x.get('unparseable')} unparseable); rank,domain"] for b, x in rows.items()}
    return write_corpus(own, folder, tag, about, rows, said)


def write_registries(endpoints: DataFrame, ranked: DataFrame, folder: str, tag: str, about: dict) -> dict:
    """Endpoint hosts of registries with their ranks (host, rank or null) as a corpus, and the endpoints as JSON lines."""
    counts = endpoints.groupBy("registry").agg(F.count("*").alias("endpoints"), F.count_distinct("host").alias("hosts")).collect()
    path = f"{folder}/{tag}-endpoints/{uuid.uuid4().hex}"
    endpoints.write.json(path)
    sources = {r["registry"]: {"endpoints": r["endpoints"], "hosts": r["hosts"]} for r in counts}
    more = about | {"sources": sources, "endpoints": path, "ranked": ranked.filter("rank is not null").count()}
    return write_corpus({"registry": ranked.select("host", "rank")}, folder, tag, more)


def table(rows: DataFrame) -> str:
    """An aggregate of few rows as lines of fixed width, all of its rows."""
    return fixed_width([list(map(str, rows.columns)), *[["-" if v is None else str(v) for v in r] for r in rows.collect()]])


def fixed_width(cells: list[list[str]]) -> str:
    """A header and rows, each column as wide as its widest cell."""
    width = [max(len(r[k]) for r in cells) for k in range(len(cells[0]))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]])


def write_table(rows: DataFrame, path: str, order: list[str]) -> None:
    """A table of any length as lines of fixed width in the order of some columns: widths are an aggregate, lines are made by the tasks."""
    text = rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")).alias(c) for c in rows.columns], F.struct(*order).alias("_by"))
    widest = text.agg(*[F.coalesce(F.max(F.length(f"`{c}`")), F.lit(0)).alias(c) for c in rows.columns]).first()
    width = {c: max(len(c), widest[c]) for c in rows.columns}
    cell = lambda c: F.rpad(f"`{c}`", width[c], " ")
    body = text.select(F.lit(2).alias("_o"), "_by", F.rtrim(F.concat_ws("  ", *[cell(c) for c in rows.columns])).alias("value"))
    head = ["  ".join(c.ljust(width[c]) for c in rows.columns).rstrip(), "  ".join("-" * width[c] for c in rows.columns)]
    top = rows.sparkSession.createDataFrame(list(enumerate(head)), "_o INT, value STRING").select("_o", F.lit(None).cast(body.schema["_by"].dataType).alias("_by"), "value")
    top.unionByName(body).orderBy("_o", "_by").select("value").write.text(path)


def prevalence_report(prevalence: DataFrame) -> str:
    """The prevalence table with percentages and intervals."""
    rows = prevalence.orderBy("pos").collect()
    out = []
    for r in rows:
        interval = f"[{100 * r['wilson_low']:.1f}, {100 * r['wilson_high']:.1f}]"
        out.append((r["path"], f"{r['valid_all']} ({stats.percent(r['valid_all'], r['hosts'])})", f"{r['valid_reachable']} ({stats.percent(r['valid_reachable'], r['reachable'])})", interval, r["status_200"], r["soft404"], r["invalid"], r["cross_origin"], r["www"]))
    return fixed_width([["path", "all hosts", "reachable", "wilson95", "200s", "soft404", "invalid", "x-origin", "www"], *[list(map(str, x)) for x in out]])


def consistency_report(summary: DataFrame) -> str:
    """The one row of `consistency.summary` as lines."""
    r = summary.first()
    two = lambda x: "n/a" if x is None else f"{x:.2f}"
    return "\n".join([
        f"pair hosts: {r['pairs']}; both parsed: {r['fetched']}; card lists no tools: {r['no_tools']}; description has no operations: {r['no_ops']}",
        f"scored (at least a tool and an operation): {r['scored']}",
        f"median overlap, loose: {two(r['median_loose'])}; strict: {two(r['median_strict'])}; hosts with none (loose): {r['loose_zero']}; with all: {r['loose_one']}",
        f"tools without an operation (loose): {r['unmatched'] or 0} of {r['tools'] or 0} ({stats.percent(r['unmatched'] or 0, r['tools'] or 0)}); median share of a host {two(r['median_unmatched_share'])}",
        f"coverage hosts: {r['coverage']}; text file read: {r['llms_fetched']}; link to a description: {r['link_openapi']}; to a card: {r['link_card']}; to either: {r['link_any']} ({stats.percent(r['link_any'], r['llms_fetched'])}); resolving: {r['link_resolves']} ({stats.percent(r['link_resolves'], r['link_any'])})",
    ])


def vantage_report(matrix: DataFrame, paths: DataFrame) -> str:
    """Classes of two snapshots against each other (a_class, b_class, n), and their agreement by path."""
    rows = matrix.collect()
    classes = sorted({x for r in rows for x in (r["a_class"], r["b_class"])})
    n = {(r["a_class"], r["b_class"]): r["n"] for r in rows}
    grid = fixed_width([["a \\ b", *classes], *[[a, *[str(n.get((a, b), 0)) for b in classes]] for a in classes]])
    return f"{grid}\n\n{table(paths)}"


def census_report(census: DataFrame) -> str:
    """Counts of what agent cards declare (measure, value, n), a line a measure, the most frequent value first."""
    rows = sorted(census.collect(), key=lambda r: (r["measure"], -r["n"], r["value"] or ""))
    measures = dict.fromkeys(r["measure"] for r in rows)
    return "\n".join(f"{m}: " + ", ".join(f"{r['value']} {r['n']}" for r in rows if r["measure"] == m) for m in measures)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
