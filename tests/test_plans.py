"""What plans must look like: filters and columns reach the scan, facts are not shuffled for a lookup."""

from haulspark.operators.joins import asof
from haulspark.operators.relational import holds
from haulspark.sources import tables as t
from haulspark.sources.tables import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    df = t.requests(spark, SF).where("client_id = 7").select("order_id")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_an_asof_join_moves_only_the_dimension(spark):
    facts = t.runs(spark, SF).withColumn("region", (F.col("vehicle_id") % 5).cast("int"))
    text = plan(asof(facts, t.tariffs(spark), ["region"], "run_date", ["tariff"]).select("tpo_id", "tariff"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "BatchEvalPython" not in text
    fact_side = text.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in fact_side


def test_searches_stay_in_generated_code(spark):
    text = plan(table(spark, SF, "part").where(holds(F.col("p_name"), "ring")))
    assert "Python" not in text and "*(1)" in text
