"""Queries on keys, groups and sizes that the small tables lack."""

import shutil
from pathlib import Path

import duckdb
import test_oracles
from pyspark.sql import functions as F

from cairnfield import plans
from cairnfield.operators import near, validate
from cairnfield.plans import queries_hosts, queries_sources, views

SMALL = Path(test_oracles.SF)


def folder(tmp_path, **tables):
    """The small tables in a folder of their own, with some of them made by SQL over the given ones."""
    con = duckdb.connect()
    for f in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        if f.stem not in tables:
            shutil.copy(f, tmp_path / f.name)
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    return con, str(tmp_path)


def same(spark, con, sf, name):
    ours, theirs = plans.queries()[name](spark, sf).toPandas(), con.execute(plans.oracles()[name]).fetch_df()
    return test_oracles.rows(ours) == test_oracles.rows(theirs) and len(theirs) > 0


def test_customer_errors_with_407_inside_of_a_number(spark, tmp_path):
    con, sf = folder(tmp_path, customer="SELECT c_custkey + 4000 AS c_custkey, 'Customer#' || lpad((c_custkey + 4000)::VARCHAR, 9, '0') AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
    assert same(spark, con, sf, "customer_errors")


def test_near_links_send_no_table_through_the_driver(spark):
    rows = spark.range(200).selectExpr("id AS doc_id", "xxhash64(id % 150) AS h")
    made = near.near_links(rows, "doc_id", "h")
    assert made.count() == 200 and "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_markdown_looks_at_a_text_once(spark):
    texts = ["﻿---\na: 1\n---\n\n  # Top\nx", "\n  \n# Top", "a\n\n## b", "a\n===\n", "#\nfoo", " \t\r\n ", "a # b", "a\r\n---\r\n", " # x", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k INT, t STRING")
    made = rows.select("k", validate.markdown(rows["t"], F.lit("text/markdown")).alias("o")).select("k", "o.valid", F.array_join("o.reasons", ",").alias("r"))
    no, last = "no_markdown_heading", "note:h1_not_first"
    want = [(True, ""), (True, ""), (True, last), (True, last), (True, last), (False, f"{no},empty,{last}"), (False, f"{no},{last}"), (False, f"{no},{last}"), (False, f"{no},{last}"), (False, f"{no},empty,{last}"), (True, last)]
    assert [(x["valid"], x["r"]) for x in sorted(made.collect(), key=lambda x: x["k"])] == want
    assert made._jdf.queryExecution().optimizedPlan().toString().count("#{1,6}") == 1


def test_rows_that_are_much_work_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 20)
    sf = str(SMALL)
    assert queries_hosts._outcomes(spark, sf).rdd.getNumPartitions() >= 8  # 150 customers
    assert plans.queries()["decoded_bodies"](spark, sf).rdd.getNumPartitions() == 10  # 200 parts
    assert views.view(spark, sf, queries_sources._K, "c_custkey").rdd.getNumPartitions() == 8


def test_probe_texts_are_hashed_once(spark):
    plan = plans.queries()["probe_classes"](spark, str(SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [_simhash_of_plain") == 1
