"""What to ask of a routing service for matrices that are known in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulspark.operators import matrices
from haulspark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix a nation, with new points in some, against legs that were measured and partly lapsed."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    key = F.when((n % 3 == 0) & (s % 9 == 0) | (n % 7 == 3) & (s % 2 == 0), None).otherwise(F.concat(F.lit("n"), (s % 23).cast("string")))
    points = table(spark, sf_dir, "supplier").select(n.alias("matrix_id"), (F.row_number().over(Window.partitionBy(n).orderBy(s)) - 1).alias("idx"), key.alias("node_key"))
    node = lambda c: F.concat(F.lit("n"), (F.col(c) % 23).cast("string"))
    legs = table(spark, sf_dir, "lineitem").where("l_partkey % 23 <> 4").select(node("l_partkey").alias("from_key"), node("l_suppkey").alias("to_key"), F.col("l_shipdate").cast("timestamp").alias("expires_at"))
    return matrices.fetch_plan(points, legs.groupBy("from_key", "to_key").agg(F.max("expires_at").alias("expires_at")), "1995-01-01")


QUERIES["fetch_plan"] = fetch_plan
ORACLE_SQL["fetch_plan"] = """
with p as (select s_nationkey as m, (row_number() over (partition by s_nationkey order by s_suppkey) - 1)::int as i, case when s_nationkey % 3 = 0 and s_suppkey % 9 = 0 or s_nationkey % 7 = 3 and s_suppkey % 2 = 0 then null else 'n' || (s_suppkey % 23) end as k from supplier),
c as (select distinct 'n' || (l_partkey % 23) as f, 'n' || (l_suppkey % 23) as t from lineitem where l_partkey % 23 <> 4 and l_shipdate > timestamp '1995-01-01'),
x as (select a.m, a.i, b.i as j, a.k <> b.k and not exists (select 1 from c where f = a.k and t = b.k) as lacks from p a join p b on a.m = b.m and a.i <> b.i and a.k is not null and b.k is not null),
g as (select m, count(*) as n, list(i order by i) as al, coalesce(list(i order by i) filter (k is null), []) as new, coalesce(list(i order by i) filter (k is not null), []) as known from p group by 1),
h as (select m, count(*) filter (not lacks) as hits, count(*) filter (lacks) as apart, coalesce(list_sort(list(distinct i) filter (lacks)), []) as r, coalesce(list_sort(list(distinct j) filter (lacks)), []) as s from x group by 1),
b as (select g.*, coalesce(hits, 0) as hits, coalesce(apart, 0) as apart, coalesce(r, []) as r, coalesce(s, []) as s from g left join h using (m)),
q as (select *, list_filter([case when len(new) > 0 then {'a': new, 'b': al} end, case when len(new) > 0 and len(known) > 0 then {'a': known, 'b': new} end, case when len(r) > 0 then {'a': r, 'b': s} end], lambda z: z is not null) as parts from b),
d as (select *, case when len(parts) > 1 and list_sum(list_transform(parts, lambda z: len(z.a) * len(z.b))) > 0.6 * n * n then [{'a': al, 'b': al}] when len(parts) = 0 then [null] else parts end as plan, len(parts) as np from q),
e as (select *, unnest(plan) as z, generate_subscripts(plan, 1) as no from d)
select m as matrix_id, hits, len(new) * (n - 1) + len(known) * len(new) + apart as misses, case when np > 0 then no::int end as fetch_no, array_to_string(z.a, ',') as rows, array_to_string(z.b, ',') as cols from e"""
