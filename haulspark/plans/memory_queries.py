"""Addresses remembered from documents, and stops filled from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.operators import memory
from haulspark.sources.shared import settled
from haulspark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}
_STREETS, _TOWNS = ["Republicii", "Industriei", "Pantelimon Construct Srl", "Lunga"], ["Arad", "Cluj", "Iași", "Brașov", "Sibiu"]
_pick = lambda values, i: F.get(F.array(*[F.lit(v).cast("string") for v in values]), i.cast("int"))
_postcode = lambda n: F.concat(F.lit("0"), F.lpad(n.cast("string"), 5, "0"))


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    street, house = _pick(_STREETS, c % 4), (1 + c % 3).cast("string")
    return table(spark, sf_dir, "orders").select(
        (o / 2).cast("long").alias("doc_id"), F.when(o % 3 == 0, memory.ORIGIN).otherwise(memory.DELIVERY).alias("role"), F.when(o % 29 != 0, _postcode(c % 40)).alias("postcode"), F.concat(F.lower(street), house).alias("match_key"),
        F.when(o % 7 != 0, _pick(_TOWNS, c % 5)).alias("locality"), street.alias("street_name"), F.concat(F.lit("Str. "), street, F.lit(" nr. "), house, F.lit(", "), _pick(_TOWNS, c % 5)).alias("display"),
        F.when(o % 53 == 0, "corrected").when(o % 59 == 0, "manual").otherwise("parsed").alias("source"), F.col("o_orderdate").cast("timestamp").alias("at"),
    )


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misreadings that the office merged, one of them twice over, and addresses that it switched off."""
    n = F.col("n_nationkey").cast("long")
    rows = table(spark, sf_dir, "nation").select(_postcode(n).alias("postcode"), n.alias("n"), F.explode(F.array(F.lit("lunga1"), F.lit("industriei1"), F.lit("republicii2"))).alias("match_key"))
    n = F.col("n")
    into = F.when(F.col("match_key") == "lunga1", "industriei1").when((F.col("match_key") == "industriei1") & (n % 2 == 0), "republicii1")
    return rows.select(
        F.concat_ws("|", F.lit("delivery"), "postcode", "match_key").alias("id"), F.lit("delivery").alias("role"), "postcode", "match_key", F.lit("Arad").alias("locality"), F.lit("Strada").alias("street_name"), F.lit("Strada nr. 1, Arad").alias("display"), F.lit("parsed").alias("source"),
        F.lit("1990-01-01").cast("timestamp").alias("first_at"), F.lit("1990-01-01").cast("timestamp").alias("last_seen_at"), (n % 6 == 1).alias("verified"), ((F.col("match_key") == "republicii2") & (n % 5 == 0)).alias("disabled"), F.when(into.isNotNull(), F.concat_ws("|", F.lit("delivery"), "postcode", into)).alias("merged_into"),
    )


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    sightings = _sightings(spark, sf_dir)
    early = F.col("at") < F.lit("1995-06-01").cast("timestamp")
    none = spark.createDataFrame([], "id string, doc_id long")
    one, seen = memory.remember(_aliases(spark, sf_dir), none, sightings.where(early))
    two, seen = memory.remember(settled(one), settled(seen), sightings.where(~early))
    return memory.known_addresses(settled(two), settled(seen))


def address_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known after two runs over the halves of the documents."""
    return _known(spark, sf_dir).select("id", "locality", "display", "source", "first_at", "last_seen_at", "verified", "seen_count")


def filled_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops whose street was lost, filled from memory or not, and why."""
    k = F.col("c_custkey")
    hints = _pick(["epublicii", "ndustrei xx", "lung", "", "republicii industriei"], k % 5)
    stops = table(spark, sf_dir, "customer").select(
        k.alias("doc_id"), F.lit(1).alias("stop_no"), F.when(k % 3 == 0, memory.ORIGIN).otherwise(memory.DELIVERY).alias("role"), F.when(k % 11 == 0, "Read").alias("street_name"), F.when(k % 13 != 0, _postcode(k % 45)).alias("postcode"),
        F.when(k % 4 != 0, _pick(_TOWNS, k % 5)).alias("locality"), memory.street_hints(hints, F.lit("Lung")).alias("hints"),
    )
    return memory.fill_stops(stops, _known(spark, sf_dir)).drop("hints", "stop_no", "street_name")


_SQL = """
with s as (
  select (o_orderkey // 2) as doc_id, case when o_orderkey % 3 = 0 then 'origin' else 'delivery' end as role, case when o_orderkey % 29 <> 0 then '0' || lpad((o_custkey % 40)::varchar, 5, '0') end as postcode, ['Republicii', 'Industriei', 'Pantelimon Construct Srl', 'Lunga'][o_custkey % 4 + 1] as street, (1 + o_custkey % 3)::varchar as house,
    ['Arad', 'Cluj', 'Iași', 'Brașov', 'Sibiu'][o_custkey % 5 + 1] as town, o_orderkey % 7 <> 0 as has_town, case when o_orderkey % 53 = 0 then 'corrected' when o_orderkey % 59 = 0 then 'manual' else 'parsed' end as source, o_orderdate as made from orders
), t as (select *, role || '|' || postcode || '|' || lower(street) || house as id from s where postcode is not null),
old as (
  select 'delivery|' || pc || '|' || m as id, n, m, case when m = 'lunga1' then 'delivery|' || pc || '|industriei1' when m = 'industriei1' and n % 2 = 0 then 'delivery|' || pc || '|republicii1' end as target, m = 'republicii2' and n % 5 = 0 as off from (select n_nationkey as n, '0' || lpad(n_nationkey::varchar, 5, '0') as pc, unnest(['lunga1', 'industriei1', 'republicii2']) as m from nation)
), first as (select id, arg_min({'town': case when has_town then town end, 'display': 'Str. ' || street || ' nr. ' || house || ', ' || town, 'street': street}, {'at': made, 'd': doc_id, 'l': case when has_town then town end}) as f, min(made) as first_at, max(made) as last_at, arg_min(source, {'at': made, 'd': doc_id, 's': source}) filter (source <> 'parsed') as person from t group by id),
a as (
  select coalesce(old.id, first.id) as id, case when old.id is not null then 'Arad' else f.town end as locality, case when old.id is not null then 'Strada nr. 1, Arad' else f.display end as display, case when old.id is not null then 'Strada' else f.street end as street_name, coalesce(person, 'parsed') as source, case when old.id is not null then timestamp '1990-01-01' else first_at end as first_at,
    greatest(case when old.id is not null then timestamp '1990-01-01' end, last_at) as last_at, coalesce(n % 6 = 1, false) as verified, coalesce(off, false) as off, target
  from old full join first on old.id = first.id
), chain as (select a.id, a.last_at, coalesce(c.target, b.target, a.target, a.id) as final from a left join a b on b.id = a.target left join a c on c.id = b.target),
counts as (select final, count(distinct doc_id) as n from t join chain using (id) group by 1), last as (select final, max(last_at) as last_at from chain group by 1),
known as materialized (select a.id, split_part(a.id, '|', 1) as role, split_part(a.id, '|', 2) as postcode, split_part(a.id, '|', 3) as match_key, locality, display, street_name, source, first_at, last.last_at as last_seen_at, verified, coalesce(n, 0) as seen_count from a left join counts on final = a.id left join last on last.final = a.id where target is null and not off)"""

QUERIES |= {"address_memory": address_memory, "filled_stops": filled_stops}
ORACLE_SQL["address_memory"] = _SQL + " select id, locality, display, source, first_at, last_seen_at, verified, seen_count from known"
ORACLE_SQL["filled_stops"] = _SQL + """,
stops as (
  select c_custkey as doc_id, case when c_custkey % 3 = 0 then 'origin' else 'delivery' end as role, c_custkey % 11 = 0 as is_read, case when c_custkey % 13 <> 0 then '0' || lpad((c_custkey % 45)::varchar, 5, '0') end as postcode, case when c_custkey % 4 <> 0 then ['Arad', 'Cluj', 'Iași', 'Brașov', 'Sibiu'][c_custkey % 5 + 1] end as locality,
    [['epublicii'], ['ndustrei'], [], [], ['republicii', 'industriei']][c_custkey % 5 + 1] as hints from customer
), usable as (select *, verified or source <> 'parsed' as human, verified or source <> 'parsed' or seen_count >= 2 as trusted, verified or source <> 'parsed' or not contains(display, 'Srl') as fits from known k where role = 'origin' or not exists (select 1 from known d where d.role = 'origin' and d.postcode = k.postcode and d.match_key = k.match_key)),
m as (
  select s.doc_id, k.id, k.display, trusted, trusted and (s.locality is null or k.locality is null or s.locality = k.locality) as in_town, trusted and (s.locality is null or k.locality is null or s.locality = k.locality) and fits as good, human, seen_count,
    coalesce(list_max(list_transform(hints, lambda h: list_max(list_transform(list_filter(string_split(lower(street_name), ' '), lambda w: length(w) >= 3), lambda w: 1 - levenshtein(w, h) / greatest(length(w), length(h)))))), 0) as score
  from stops s join usable k on s.role = k.role and s.postcode = k.postcode
), p as (select *, good and (human or not bool_or(good and human) over (partition by doc_id)) as pooled from m),
r as (select *, row_number() over (partition by doc_id order by pooled desc, score desc, seen_count desc, id) as pos from p),
g as (select doc_id, count(*) as n, count(*) filter (trusted) as n_trusted, count(*) filter (in_town) as n_town, count(*) filter (good) as n_good, count(*) filter (pooled) as n_pool, max(score) filter (pos = 1) as best, max(score) filter (pos = 2) as next, max(id) filter (pos = 1) as id, max(display) filter (pos = 1) as display from r group by 1),
w as (select s.*, g.* exclude (doc_id), case when is_read then 'street_read' when s.postcode is null then 'no_postcode' when n is null then 'unknown_postcode' when n_trusted = 0 then 'no_trusted' when n_town = 0 then 'locality_mismatch' when n_good = 0 then 'junk_filtered' when n_pool > 1 and best < 0.6 then 'below_threshold' when n_pool > 1 and best - next < 0.15 then 'ambiguous' end as reason from stops s left join g using (doc_id))
select doc_id, role, postcode, locality, case when is_read then 'skipped' when reason is null then 'used' else 'refused' end as result, reason, case when reason is null then id end as address_id, case when reason is null then display end as filled,
  (case when is_read or postcode is null or n is null then 0 when reason is null or reason in ('below_threshold', 'ambiguous') then n_pool else n end)::int as candidates,
  case when (reason is null or reason in ('below_threshold', 'ambiguous')) and n_pool > 1 then floor(best * 100 + 0.5) / 100 end as best, case when (reason is null or reason in ('below_threshold', 'ambiguous')) and n_pool > 1 then floor(next * 100 + 0.5) / 100 end as runner_up
from w"""
