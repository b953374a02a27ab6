"""Every named query against its SQL twin, and what no plan may contain."""

import pytest

import compare
from hushlake.plans.catalog import QUERIES, TWINS

STREAMED = {name for name in QUERIES if name.endswith("_stream") or name.startswith(("stored_", "tail_"))}


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_equals_sql(spark, con, sf_dir, name):
    assert compare.difference(spark, con, name, sf_dir) == ""


SQL_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.mark.parametrize("name", sorted(set(TWINS) - STREAMED))
def test_types_equal_sql(spark, con, sf_dir, name):
    ours = {c: SQL_TYPES[t] for c, t in QUERIES[name](spark, sf_dir).dtypes}
    theirs = {row[0]: row[1] for row in con.execute(f"DESCRIBE {TWINS[name]}").fetchall()}
    assert ours == theirs


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMED))
def test_plan(spark, sf_dir, name):
    """No row leaves the JVM, no join compares all pairs."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert operator not in plan


def test_masking_does_not_shuffle(spark):
    from pyspark.sql import functions as F

    from hushlake.operators.mask import mask
    from hushlake.plans.tables import RULES

    texts = spark.range(10).select("id", F.lit("a@b.org").alias("text"))
    plan = mask(texts, RULES, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_filter_beside_masked_text_reaches_the_scan(spark, sf_dir):
    from hushlake.operators.mask import mask
    from hushlake.plans.tables import RULES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mask(docs, RULES, "doc_id").filter("lang = 'en' AND replacement_count > 0").select("doc_id", "text")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in text
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in text
    assert text.count("rlike") + text.count("RLIKE") == 1
