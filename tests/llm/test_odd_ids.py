"""Ids that are no numbers, and the pipeline on odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnfield.llm import chat, fingerprints, orc_tokens, packing, quality, queries, scratch

SF = "/root/testdata/sf0.001"
ROWS = [("a-1", "some words of a text that is read by all operators"), ("7", "some other words"), (None, None), ("8.5", ""), ("a-1", "some words of a text that is read by all operators")]


@pytest.fixture(scope="module")
def named(spark):
    return spark.createDataFrame(ROWS, "doc_id STRING, text STRING").withColumn("part", F.lit("p"))


def test_ids_that_are_no_numbers_are_null(spark, named):
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in fingerprints.edit_pairs(named).collect()) == sorted((7 if i == "7" else 0, len(t or "")) for i, t in ROWS)
    assert fingerprints.fingerprint(named).filter("doc_id is null").count() == 4
    path = orc_tokens.write(named, scratch.new_path(spark, "orc"))
    assert sorted(r["doc_id"] or 0 for r in orc_tokens.read(spark, path).collect()) == [0, 0, 0, 0, 7]
    assert sorted(r["doc_id"] or 0 for r in packing.pack(named).collect()) == [0, 0, 0, 0, 7]
    turns = named.select(F.col("doc_id").alias("conv_id"), F.lit("x").alias("turn"), F.lit("assistant").alias("role"), "text")
    assert sorted((r["conv_id"] or 0, r["n_turns"]) for r in chat.read_back(chat.format_conversations(turns)).collect()) == [(0, 4), (7, 1)]


def test_quality_with_ids_that_are_no_numbers(spark, named):
    docs = queries.table(spark, SF, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text").unionByName(named.select("doc_id", "text"))
    labels = queries.table(spark, SF, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("string").alias("quality")).unionByName(spark.createDataFrame([("x", "1"), ("7", "?")], "doc_id STRING, quality STRING"))
    assert quality.score(docs, quality.fit(docs, labels, F.lit(True)), keep=["doc_id"]).count() == docs.count()


def test_pipeline_on_odd_rows(spark, named, tmp_path):
    docs = queries.table(spark, SF, "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    odd = named.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    clashing = {c: F.lit(c) for c in ("node", "class_id", "row", "_text", "score", "ids", "part")}
    docs.unionByName(odd).unionByName(docs.limit(20)).withColumns(clashing).write.parquet(f"file://{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        queries.table(spark, SF, name).write.parquet(f"file://{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    plain = corpus_pipeline.run(spark, SF).collect()
    assert len(got) > 0.8 * len(plain) and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    docs.limit(0).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        queries.table(spark, SF, name).write.parquet(f"file://{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
