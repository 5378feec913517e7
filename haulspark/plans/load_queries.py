"""Loads: what is wrong with them, sections of the hold, sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.operators import loads
from haulspark.operators.grouped import in_parts
from haulspark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_SQL = """
b as materialized (
  select l_orderkey as plan_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as item_id, case when l_partkey % 13 <> 0 then (l_linenumber - 1) * 1.5::double + l_partkey % 3 * 0.5 - 0.5 end as x, l_suppkey % 3 * 0.75::double as y,
    case when l_partkey % 4 = 0 then 1.0::double when l_partkey % 11 = 0 then 2.0::double else 0.0 end as z, 2.25::double as l, 1.0::double as w, 1.0::double as h, max(l_quantity) * 10.0::double as weight_kg, case when l_partkey % 7 <> 0 then 1 + l_suppkey % 4 end as stop_seq,
    l_partkey % 5 <> 0 as stackable, case when l_partkey % 3 = 0 then 250.0::double end as most_above_kg
  from lineitem group by all
), v as materialized (select o_orderkey as plan_id, 13.6::double as hold_l, 2.45::double as hold_w, 2.7::double as hold_h, 1000.0::double as payload_kg, 1.0::double as front_x, 8.0::double as rear_x, 500.0::double as front_most_kg, 400.0::double as rear_most_kg from orders where o_orderkey % 9 <> 0),
p as materialized (select * from b where x is not null)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", p, s, n, "l_quantity")
    rows = in_parts(lines, "l_orderkey").groupBy("l_orderkey", p, s, n).agg(F.max("l_quantity").alias("q"))
    return rows.select(
        F.col("l_orderkey").alias("plan_id"), (p * 100000 + s * 10 + n).alias("item_id"), F.when(p % 13 != 0, (n - 1) * 1.5 + p % 3 * 0.5 - 0.5).alias("x"), (s % 3 * 0.75).alias("y"),
        F.when(p % 4 == 0, 1.0).when(p % 11 == 0, 2.0).otherwise(0.0).alias("z"), F.lit(2.25).alias("l"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"), (F.col("q") * 10.0).alias("weight_kg"),
        F.when(p % 7 != 0, 1 + s % 4).alias("stop_seq"), (p % 5 != 0).alias("stackable"), F.when(p % 3 == 0, 250.0).alias("most_above_kg"),
    )


def _holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    sizes = {"hold_l": 13.6, "hold_w": 2.45, "hold_h": 2.7, "payload_kg": 1000.0, "front_x": 1.0, "rear_x": 8.0, "front_most_kg": 500.0, "rear_most_kg": 400.0}
    return table(spark, sf_dir, "orders").where(k % 9 != 0).select(k.alias("plan_id"), *[F.lit(x).alias(c) for c, x in sizes.items()])


@query(f"""
with {_SQL},
f as materialized (select a.plan_id, a.item_id as ai, b.item_id as bi, a.z as az, a.h as ah, b.z as bz, b.h as bh, a.weight_kg as aw, b.stackable as bs, b.most_above_kg as bm, (least(a.x + a.l, b.x + b.l) - greatest(a.x, b.x)) * (least(a.y + a.w, b.y + b.w) - greatest(a.y, b.y)) as area
  from p a join p b on a.plan_id = b.plan_id and a.item_id <> b.item_id where a.x < b.x + b.l and b.x < a.x + a.l and a.y < b.y + b.w and b.y < a.y + a.w),
r as materialized (select * from f where az > 0.001 and abs(bz + bh - az) <= 0.001),
up as (select p.plan_id, p.item_id, coalesce((select sum(area) from r where r.plan_id = p.plan_id and ai = item_id), 0) / (l * w) as share from p where z > 0.001),
above as (select plan_id, bi, sum(aw) as kg from f where az + 0.001 >= bz + bh and bm is not null group by 1, 2),
kg as (select plan_id, sum(weight_kg) as kg, (sum(weight_kg * (x + l / 2)) - sum(weight_kg) * 1.0) / 7.0 as rear from p join v using (plan_id) group by 1),
out as (
  select plan_id, 'out_of_bounds_length' as code, 'error' as severity, item_id, null::bigint as other_id, case when x < -0.001 then -x else x + l - hold_l end * 1000 as over from p join v using (plan_id) where x < -0.001 or x + l > hold_l + 0.001
  union all select plan_id, 'out_of_bounds_width', 'error', item_id, null, (y + w - hold_w) * 1000 from p join v using (plan_id) where y + w > hold_w + 0.001
  union all select plan_id, 'out_of_bounds_height', 'error', item_id, null, (z + h - hold_h) * 1000 from p join v using (plan_id) where z + h > hold_h + 0.001
  union all select plan_id, 'collision', 'error', ai, bi, null from f where ai < bi and az < bz + bh and bz < az + ah
  union all select plan_id, 'unsupported_stack', case when share = 0 then 'error' else 'warning' end, item_id, null, null from up where share < 0.6 - 1e-9
  union all select plan_id, 'not_stackable', 'error', ai, bi, null from r where not bs
  union all select r.plan_id, 'stack_weight_exceeded', 'error', ai, r.bi, kg - bm from r join above using (plan_id, bi) where kg > bm
  union all select a.plan_id, 'unloading_order', 'warning', a.item_id, min(b.item_id), null from p a join p b on a.plan_id = b.plan_id and b.stop_seq > a.stop_seq and b.x > a.x and a.y < b.y + b.w and b.y < a.y + a.w group by 1, 4
  union all select plan_id, 'payload_exceeded', 'error', null, null, kg - 1000 from kg where kg > 1000
  union all select plan_id, 'axle_overloaded_front', 'error', null, null, floor((kg - rear) * 10 + 0.5) / 10 - 500 from kg where floor((kg - rear) * 10 + 0.5) / 10 > 500
  union all select plan_id, 'axle_overloaded_rear', 'error', null, null, floor(rear * 10 + 0.5) / 10 - 400 from kg where floor(rear * 10 + 0.5) / 10 > 400
)
select plan_id, code, severity, item_id, other_id, floor(over + 0.5)::bigint as over_by from out""")
def load_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.load_findings(_placed(spark, sf_dir), _holds(spark, sf_dir))


@query(f"""
with {_SQL}, s as (select v.*, unnest(range(6)) as i, hold_l / 6 as step from v),
c as (select s.plan_id, i, step, least(x + l, (i + 1) * step) - greatest(x, i * step) as share, p.* exclude (plan_id) from s join p on p.plan_id = s.plan_id),
t as (select plan_id, i, sum((share * w * h)::decimal(28, 9))::double as volume, sum((weight_kg * share / l)::decimal(28, 9))::double as kg, count(*) as n, string_agg(distinct stop_seq::varchar, ',' order by stop_seq::varchar) as stops from c where share > 1e-9 group by 1, 2)
select plan_id, (i + 1)::int as section, floor(i * step * 1000 + 0.5) / 1000 as from_m, floor((i + 1) * step * 1000 + 0.5) / 1000 as to_m, floor(coalesce(volume, 0) / (step * hold_w * hold_h) * 1000 + 0.5) / 10 as volume_pct, floor(coalesce(kg, 0) * 10 + 0.5) / 10 as weight_kg,
  coalesce(n, 0) as item_count, coalesce(stops, '') as stops from s left join t using (plan_id, i)""")
def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.section_fill(_placed(spark, sf_dir), _holds(spark, sf_dir))


@query(f"""
with {_SQL}, h as (select plan_id, weight_kg, greatest(0.0::double, least(y + w, 1.225::double) - greatest(y, 0.0::double)) / w as part from p),
s as (select plan_id, sum((weight_kg * part)::decimal(28, 9))::double as d, sum((weight_kg * (1 - part))::decimal(28, 9))::double as o from h group by 1), t as (select v.plan_id, coalesce(d, 0) as d, coalesce(o, 0) as o from v left join s using (plan_id)), r as (select plan_id, floor(d * 10 + 0.5) / 10 as driver_kg, floor(o * 10 + 0.5) / 10 as passenger_kg, floor((d + o) * 10 + 0.5) / 10 as total_kg, abs(d - o) as apart, d + o as total from t)
select plan_id, driver_kg, passenger_kg, total_kg, floor(apart * 10 + 0.5) / 10 as imbalance_kg, case when total > 0 then floor(apart / total * 1000 + 0.5) / 10 else 0 end as imbalance_pct from r""")
def side_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.side_balance(_placed(spark, sf_dir), _holds(spark, sf_dir))
