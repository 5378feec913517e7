"""Streets looked up by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.operators import streets
from haulspark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}
_KINDS = [("Bulevardul", "bulevardul"), ("Strada", "strada"), ("Calea", "calea"), ("Șoseaua", "soseaua"), ("Aleea", "aleea")]


def street_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names typed in eight ways, in 500 towns whose streets share names and differ in kind and zone."""
    k, name = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_type")
    parts = table(spark, sf_dir, "part").withColumn("city", F.concat("p_brand", F.lit("/"), k % 20))
    kind = F.get(F.array(*[F.lit(x) for x, _ in _KINDS]), (k % 5).cast("int"))
    known = parts.select("city", k.alias("street_id"), F.concat_ws(" ", kind, name).alias("name"), F.get(F.array(F.lit(""), F.lit("ZA:f"), F.lit("ZB:p"), F.lit("ZA:f")), (F.col("p_size") % 4).cast("int")).alias("zones"))
    known = known.groupBy("city", "name").agg(F.min(F.struct("street_id", "zones")).alias("s")).select("city", "name", "s.*")
    ways = [F.concat(F.lit("bd. "), name), name, F.concat_ws(" ", "p_type", "p_name"), F.concat(name, F.lit("  nr. 12A")), F.split("p_name", " ")[1], F.lit("Strada nowhere"), F.concat(F.lit("Șos. "), F.upper("p_name"), F.lit(", "), F.col("p_type"), F.lit(" 7")), F.substring("p_type", 1, 3)]
    asked = parts.select(k.alias("id"), "city", F.get(F.array(*ways), (k % 8).cast("int")).alias("text"))
    return streets.lookup_streets(asked, known)


_SQL = f"""
with p as (select *, p_brand || '/' || p_partkey % 20 as city, lower(p_name || ' ' || p_type) as n from part),
k as (select city, ['{"', '".join(c for _, c in _KINDS)}'][p_partkey % 5 + 1] || ' ' || n as key, n as bare, p_partkey as street_id, ['', 'ZA:f', 'ZB:p', 'ZA:f'][p_size % 4 + 1] as zones from p qualify row_number() over (partition by city, key order by p_partkey) = 1),
v as (
  select p_partkey as id, city, 0 as way, case p_partkey % 8 when 0 then 'bulevardul ' || n when 1 then n when 2 then lower(p_type || ' ' || p_name) when 3 then n || ' nr 12a' when 4 then split_part(p_name, ' ', 2) when 5 then 'strada nowhere' when 6 then 'soseaua ' || n || ' 7' else lower(substr(p_type, 1, 3)) end as key,
    case p_partkey % 8 when 0 then n when 5 then 'nowhere' when 6 then n || ' 7' end as b, null as number from p
  union all select p_partkey, city, 1, case p_partkey % 8 when 3 then n else 'soseaua ' || n end, n, case p_partkey % 8 when 3 then '12A' else '7' end from p where p_partkey % 8 in (3, 6)
), e as (select id, way, 'exact' as status, street_id, 1 as candidates from v join k using (city, key)),
r as (select * from v anti join e using (id, way)),
bare as (select id, way, count(*) as c, count(distinct zones) as z, min(k.street_id) as s from r join k on r.city = k.city and coalesce(r.b, r.key) = k.bare group by 1, 2),
l as (select * from r anti join bare using (id, way)),
w as (select l.id, way, k.street_id, zones, row_number() over (partition by l.id, way order by length(k.key) - length(replace(l.key, ' ', '')), k.key) as pos from l join k on l.city = k.city
  where len(list_filter(string_split(l.key, ' '), lambda x: length(x) < 2)) = 0 and len(list_filter(string_split(l.key, ' '), lambda x: not contains(k.key, x))) = 0),
words as (select id, way, count(*) as c, count(distinct zones) as z, arg_min(street_id, pos) as s from w where pos <= 6 group by 1, 2),
found as (
  select id, way, 0 as worded, status, street_id, candidates from e
  union all select id, way, 0, case when z = 1 then 'without-type' else 'ambiguous' end, case when z = 1 then s end, c from bare
  union all select id, way, 1, case when z = 1 then 'without-type' else 'ambiguous' end, case when z = 1 then s end, c from words
), best as (select *, case when way = 0 and worded = 0 then 0 when way = 1 then 1 else 2 end as rank from found qualify row_number() over (partition by id order by rank) = 1)
select v.id, coalesce(status, 'unknown') as status, street_id, coalesce(candidates, 0)::bigint as candidates, case when rank = 1 then (select number from v x where x.id = v.id and x.way = 1) end as house_number
from v left join best using (id) where v.way = 0"""

QUERIES["street_lookup"] = street_lookup
ORACLE_SQL["street_lookup"] = _SQL
