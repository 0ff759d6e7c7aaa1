"""Readers of captured results, host lists, sheets, access logs and archives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield import schemas as S
from cairnfield.functions import hosts as H
from cairnfield.functions import text as T
from cairnfield.operators.classify import dedupe, with_class
from cairnfield.sources.archives import read_zip_lines as read_zip_lines  # archives stand in their own module

_CORRUPT = "_corrupt"


LINE = "STRUCT<file_no: INT, file: STRING, block: BIGINT, line: BIGINT>"


def _lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """value, _source and _line of text files: lines in the order of the given list, of names under one entry, and of places in a file, whatever the order in which Spark reads them."""
    parts = []
    for k, path in enumerate([paths] if isinstance(paths, str) else paths):
        line = F.struct(F.lit(k).alias("file_no"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        parts.append(spark.read.text(path).select("value", F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl(\.gz)?$", "").alias("_source"), line.alias("_line")))
    return reduce(DataFrame.unionByName, parts)


def read_json_lines(spark: SparkSession, paths: list[str] | str, ddl: str) -> DataFrame:
    """Rows of JSON lines with a fixed schema, their source file and place; blank and broken lines are dropped."""
    lines = _lines(spark, paths)
    parsed = F.from_json("value", S.struct(f"{ddl}, {_CORRUPT} STRING"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = lines.filter(T.trim(F.col("value")) != "").select(parsed.alias("_r"), "_source", "_line")
    return rows.filter("_r is not null and _r._corrupt is null").select("_r.*", "_source", "_line").drop(_CORRUPT)


def read_existing(spark: SparkSession, paths: list[str], ddl: str) -> DataFrame:
    """The same over those paths that exist; no rows if none does."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(p: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(p)
        found = at.getFileSystem(conf).globStatus(at)
        return found is not None and len(found) > 0

    known = [p for p in paths if there(p)]
    if known:
        return read_json_lines(spark, known, ddl)
    return spark.createDataFrame([], f"{ddl}, _source STRING, _line {LINE}")


def read_results(spark: SparkSession, paths: list[str] | str, mode: str = "all", qualified: Column | None = None) -> DataFrame:
    """Host results: all rows, or of each host the first row, the last row, or the first reachable row; with `qualified`, a host counts as seen only by rows for which that holds."""
    rows = read_json_lines(spark, paths, S.HOST_RESULTS)
    rows = rows if qualified is None else rows.filter(qualified)
    if mode == "all":
        return rows
    known = rows.filter("host is not null")
    if mode == "reachable":
        known = with_class(known).filter("host_class = 'reachable'").drop("host_class")
    return dedupe(known, ["host"], [F.desc("_line") if mode == "last" else F.col("_line")])


def read_pool(spark: SparkSession, path: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Reachable hosts of a file with a flag for any valid document, and the file's counts; hosts are made distinct before classes are looked at."""
    rows = with_class(read_results(spark, path, "first"))
    artifact = F.exists(F.coalesce("probes", F.array()), lambda p: F.coalesce(p["valid"], F.lit(False)))
    flagged = rows.select("host", "rank", artifact.alias("artifact"), F.lit(label).alias("source"), (F.col("host_class") == "reachable").alias("reachable"))
    counts = flagged.agg(F.count("*").alias("rows"), F.count_if("reachable").alias("reachable"), F.count_if(F.col("reachable") & F.col("artifact")).alias("with_artifact"))
    return flagged.filter("reachable").drop("reachable"), counts


def read_hosts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """host, rank, pos of host files; the first line of each host counts."""
    lines = _lines(spark, paths).select("value", F.col("_line").alias("pos"))
    host, rank = H.host_line(F.col("value"))
    return dedupe(lines.select(host.alias("host"), rank.alias("rank"), "pos").filter("host is not null"), ["host"], [F.col("pos")])


def read_rank_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    from cairnfield.operators.corpora import rank_lines

    return rank_lines(_lines(spark, paths).select("value", F.col("_line").alias("pos")))


def read_sheet(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """A quoted CSV sheet as text columns: trimmed headers, missing cells empty, rows without any cell dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False).csv(paths)
    named = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip().removeprefix("﻿")) for c in rows.columns])
    return named.filter(F.concat(*[F.col(f"`{c}`") for c in named.columns]) != "")


def _millis(c: Column) -> Column:
    return F.unix_millis(F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))))


def trials(sheet: DataFrame) -> DataFrame:
    """Trials of a sheet; agent and domain are required, and unreadable times match nothing."""
    cell = lambda n: F.col(n) if n in sheet.columns else F.lit("")
    rows = sheet.filter((cell("agent") != "") & (cell("domain") != ""))
    urls = F.filter(F.split(cell("reported_urls"), r"\s+"), lambda x: x != "")
    return rows.select(T.trim(cell("agent")).alias("agent"), F.lower(T.trim(cell("domain"))).alias("domain"), T.trim(cell("task_id")).alias("task_id"), _millis(cell("start_utc")).alias("start_ms"), _millis(cell("end_utc")).alias("end_ms"), cell("answer").alias("answer"), cell("model").alias("model"), urls.alias("reported_urls"), cell("error").alias("error"))


COMBINED = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(?:GET|HEAD|POST) ([^ "]+)[^"]*" (\d{3}) \S+(?: "[^"]*" "([^"]*)")?'


def log_hits(lines: DataFrame, value: str = "value", file_host: Column | None = None) -> DataFrame:
    """Hits of access-log lines, in the combined format (its host from the file name) or as JSON; other lines are dropped."""
    v = F.col(value)
    own = file_host if file_host is not None else F.lit(None).cast("string")
    js = F.when(v.startswith("{"), v)
    uri = F.get_json_object(js, "$.request.uri")
    stamp = F.regexp_extract(v, COMBINED, 2)
    when = F.unix_millis(F.try_to_timestamp(F.when(stamp.rlike(r"^\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"), stamp), F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
    path = lambda c: F.split(c, r"\?")[0]
    number = lambda p: F.coalesce(F.get_json_object(js, p).try_cast("double"), F.lit(0.0))
    by_json = F.struct(F.coalesce(F.regexp_replace(F.lower(F.get_json_object(js, "$.request.host")), r":\d+$", ""), own).alias("host"), F.round(number("$.ts") * 1000).cast("bigint").alias("ts"), path(uri).alias("path"), F.coalesce(F.get_json_object(js, "$.request.headers.User-Agent[0]"), F.lit("")).alias("ua"), number("$.status").cast("int").alias("status"))
    combined = F.struct(own.alias("host"), when.alias("ts"), path(F.regexp_extract(v, COMBINED, 3)).alias("path"), F.regexp_extract(v, COMBINED, 5).alias("ua"), F.regexp_extract(v, COMBINED, 4).try_cast("int").alias("status"))
    hit = F.when(js.isNotNull() & uri.isNotNull(), by_json).when(js.isNull() & v.rlike(COMBINED) & when.isNotNull(), combined)
    return lines.withColumn("_hit", hit).filter("_hit is not null").select("_hit.*")


def read_logs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    stem = F.lower(F.regexp_replace(F.col("_metadata.file_name"), r"\.(log|jsonl|txt)(\.\d+)?$", ""))
    lines = spark.read.text(paths).select("value", F.when(stem.contains("."), stem).alias("_file"))
    return log_hits(lines, "value", F.col("_file"))


def answers(bodies: DataFrame, shape: str, body: str = "body") -> DataFrame:
    """Adds answer and distinct urls to captured responses (JSON text) of an answering service."""
    from cairnfield.functions import documents as D

    doc = D.variant(F.col(body))
    text = lambda v, p: D.text(v, p)
    if shape == "responses":
        outputs = D.items(doc, "$.output")
        parts = F.flatten(F.transform(F.filter(outputs, lambda o: text(o, "$.type") == "message"), lambda o: F.transform(F.filter(D.items(o, "$.content"), lambda c: text(c, "$.type") == "output_text"), lambda c: text(c, "$.text"))))
        answer = F.coalesce(text(doc, "$.output_text"), F.array_join(parts, "\n"))
        urls = F.transform(F.filter(outputs, lambda o: text(o, "$.type") == "web_search_call"), lambda o: text(o, "$.action.url"))
    elif shape == "messages":
        blocks = D.items(doc, "$.content")
        answer = F.array_join(F.transform(F.filter(blocks, lambda b: text(b, "$.type") == "text"), lambda b: F.nullif(text(b, "$.text"), F.lit(""))), "\n")
        urls = F.flatten(F.transform(blocks, lambda b: F.when(text(b, "$.type") == "server_tool_use", F.array(text(b, "$.input.url"))).when((text(b, "$.type") == "web_fetch_tool_result") & D.is_object(b, "$.content"), F.array(text(b, "$.content.url"))).when(text(b, "$.type") == "web_search_tool_result", F.transform(D.items(b, "$.content"), lambda r: text(r, "$.url"))).otherwise(F.array().cast("array<string>"))))
    elif shape == "candidates":
        answer = F.array_join(F.transform(D.items(doc, "$.candidates[0].content.parts"), lambda p: F.coalesce(text(p, "$.text"), F.lit(""))), "")
        one = lambda path, field: F.transform(D.items(doc, f"$.candidates[0].{path}"), lambda m: text(m, field))
        urls = F.concat(one("url_context_metadata.url_metadata", "$.retrieved_url"), one("urlContextMetadata.urlMetadata", "$.retrievedUrl"), one("grounding_metadata.grounding_chunks", "$.web.uri"), one("groundingMetadata.groundingChunks", "$.web.uri"))
    else:
        raise ValueError(f"unknown shape {shape!r}")
    return bodies.withColumns({"answer": answer, "urls": F.array_distinct(F.filter(urls, lambda u: F.coalesce(u, F.lit("")) != ""))})
