"""Notices computed from vehicles, drivers and trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.operators import notices
from haulspark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}
NOW = "1998-01-01 12:00:00"
_SETTINGS = ['{"document_expiry_days": [7, 60]}', '{"document_expiry_days": ["15", -3, "x"]}', '{"other": 1}', None]


def _day(key, factor: int):
    return F.date_add(F.lit("1998-01-01").cast("date"), (key * factor % 200 - 100).cast("int"))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    n, s, c, o = F.col("n_nationkey"), F.col("s_suppkey"), F.col("c_custkey"), F.col("o_orderkey")
    text = lambda head, key: F.concat(F.lit(head), key.cast("string"))
    return {
        "companies": table(spark, sf_dir, "nation").select(n.alias("company_id"), F.get(F.array(*[F.lit(x).cast("string") for x in _SETTINGS]), n % 4).alias("settings")),
        "vehicles": table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("company_id"), s.alias("id"), text("Brand", s % 7).alias("brand"), F.when(s % 3 != 0, "M").alias("model"), text("B-", s).alias("plate"), (s % 5 != 0).alias("is_active"), *[F.when(s % (i + 4) != 0, _day(s, 7 + i)).alias(p) for i, p in enumerate(notices.VEHICLE_PAPERS)]),
        "drivers": table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("company_id"), c.alias("id"), F.col("c_name").alias("name"), (c % 6 != 0).alias("is_active"), *[F.when(c % (i + 4) != 0, _day(c, 11 + i)).alias(p) for i, p in enumerate(notices.DRIVER_PAPERS)]),
        "trips": table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).cast("int").alias("company_id"), o.alias("id"), F.when(F.col("o_orderstatus") == "O", "planificata").otherwise("finalizata").alias("status"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("driver_id"), F.when(o % 4 != 0, text("CMR", o)).alias("cmr_number"), F.col("o_orderdate").cast("timestamp").alias("created_at")),
    }


def _computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.computed_notices(**_tables(spark, sf_dir), now=NOW)


def computed_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _computed(spark, sf_dir)


def notices_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After some papers' notices were read, some of those cleared, and trips' read once more."""
    s = F.col("s_suppkey")
    at = F.lit(NOW).cast("timestamp")
    first = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0 and s_suppkey % 7 < 3").select(
        F.col("s_nationkey").alias("company_id"), F.concat_ws(":", F.lit("computed:document_expiry:ITP"), s.cast("string"), F.date_format(_day(s, 7), "yyyy-MM-dd")).alias("key"), F.when(s % 7 == 0, at).alias("read_at"), F.when(s % 7 == 1, at).alias("dismissed_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    told = _computed(spark, sf_dir)
    gone = notices.cleared(first, F.col("company_id") % 2 == 0, NOW)
    return notices.with_state(told, notices.marked_read(gone, told.where("kind = 'trip_unassigned' and trip_id % 2 = 0"), NOW))


_SQL = """
with h as (select n_nationkey as company_id, [60, 15, 30, 30][n_nationkey % 4 + 1] as days from nation),
v as (select s_nationkey as company_id, s_suppkey as id, 'Brand' || (s_suppkey % 7) || ' ' || case when s_suppkey % 3 <> 0 then 'M' else '' end || ' (B-' || s_suppkey || ')' as name, '/vehicles' as link, unnest(['ITP', 'RCA', 'ROVINIETA', 'CASCO']) as paper,
  unnest([case when s_suppkey % 4 <> 0 then s_suppkey * 7 % 200 end, case when s_suppkey % 5 <> 0 then s_suppkey * 8 % 200 end, case when s_suppkey % 6 <> 0 then s_suppkey * 9 % 200 end, case when s_suppkey % 7 <> 0 then s_suppkey * 10 % 200 end]) as d from supplier where s_suppkey % 5 <> 0),
c as (select c_nationkey, c_custkey, c_name, '/drivers', unnest(['Permis', 'Medical', 'Tahograf']), unnest([case when c_custkey % 4 <> 0 then c_custkey * 11 % 200 end, case when c_custkey % 5 <> 0 then c_custkey * 12 % 200 end, case when c_custkey % 6 <> 0 then c_custkey * 13 % 200 end]) from customer where c_custkey % 6 <> 0),
p as (select *, date '1998-01-01' + (d - 100)::int as ends from (select * from v union all select * from c) where d is not null),
t as (select o_custkey % 25 as company_id, o_orderkey as id, case when o_orderkey % 4 <> 0 then 'CMR' || o_orderkey else 'CMR' end as cmr, row_number() over (partition by o_custkey % 25 order by o_orderdate desc, o_orderkey desc) as k from orders where o_orderstatus = 'O' and o_custkey % 3 = 0),
n as (
  select company_id, 'computed:document_expiry:' || paper || ':' || id || ':' || strftime(ends, '%Y-%m-%d') as key, 'document_expiry' as kind, paper || case when ends <= date '1998-01-01' then ' expirat' else ' expiră curând' end as title, name || ', ' || case when ends <= date '1998-01-01' then 'expirat ' else 'expiră ' end || strftime(ends, '%d.%m.%Y') as message, link, null::bigint as trip_id, paper, id
  from p join h using (company_id) where ends <= date '1998-01-01' + days
  union all select company_id, 'computed:unassigned:' || id, 'trip_unassigned', 'Cursă nealocată, ' || cmr, 'Cursa este în așteptare. Alocă un șofer și vehicul.', '/trips/' || id, id, null, null from t where k <= 10
)"""

QUERIES |= {"computed_notices": computed_notices, "notices_with_state": notices_with_state}
ORACLE_SQL["computed_notices"] = _SQL + " select company_id, key, kind, title, message, link, trip_id from n"
ORACLE_SQL["notices_with_state"] = _SQL + """
select company_id, key, kind, title, message, link, trip_id, coalesce(trip_id % 2 = 0 or paper = 'ITP' and id % 7 in (0, 1), false) as is_read from n where not coalesce(paper = 'ITP' and id % 7 in (0, 1) and company_id % 2 = 0, false)"""
