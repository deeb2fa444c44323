"""Every query against its DuckDB oracle at the smallest scale."""

import datetime
import os
import re

import duckdb
import pytest

from lodestone.plans import catalogue


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_oracle(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    cur = db.execute(catalogue.SQL[name])
    assert got == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["rrf_multi_query", "rrf_offset", "rrf_standard"])
def test_fusion_without_broadcast_joins(spark, sf, db, name):
    """As over larger tables, where lists are not broadcast."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        test_oracle(spark, sf, db, name)
    finally:
        spark.conf.set(threshold, before)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"html_to_markdown", "recursive_chunks"} <= set(entry.queries())


def test_plans(spark, sf):
    """Filters and columns reach the scan; dense search does not shuffle chunks before its top k."""
    plan = catalogue.filter_scalar(spark, sf)._jdf.queryExecution().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan)[1]
    assert "IsNotNull(source)" in pushed and "EqualTo(source,src3)" in pushed and "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan
    plan = catalogue.dense_topk(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastNestedLoopJoin" in plan
