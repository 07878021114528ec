"""Every registered query against its SQL on the smallest tables."""

import pytest

from ruleweave import queries

from .compare import SF, needs_tables, same


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name])


def test_scans_push_filters_down(spark):
    from ruleweave.engine import Engine
    from ruleweave.plans.compiler import scan
    from ruleweave.plans.model import atom

    e = Engine(spark).add_relation("status", spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderstatus"))
    plan = scan(atom("status", "?x", "F"), e.stored.read(atom("status", "?x", "F")))._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan.split("== Physical Plan ==")[1]


@needs_tables
def test_whole_customer_table_reaches_the_rules(spark):
    customers = {r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    typed = {r["s"] for r in queries.QUERIES["rdfs_rules"](spark, SF).where("o = '<urn:Party>'").collect()}
    assert typed == {f"<urn:c{c}>" for c in customers}
    # customers at both ends of the table share a balance
    from pyspark.sql import functions as F

    class Shared(queries._Facts):
        def columns(self, table, *expressions):
            ends = [1, max(customers)]
            t = spark.read.parquet(f"{SF}/{table}.parquet").withColumn("c_custkey", F.col("c_custkey") + 1000)
            return t.withColumn("c_acctbal", F.when(F.col("c_custkey").isin([e + 1000 for e in ends]), 1.0).otherwise(F.col("c_custkey").cast("double"))).selectExpr(*expressions)

    facts, queries._Facts = queries._Facts, Shared
    try:
        got = {tuple(r) for r in queries.QUERIES["same_as_rules"](spark, SF).select("s", "o").collect()}
    finally:
        queries._Facts = facts
    a, b = "c1001", f"c{1000 + max(customers)}"
    assert got == {(a, b), (b, a)}
