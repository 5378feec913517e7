"""Imports, addresses, validation and papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.functions import address
from haulspark.operators import imports, lifecycle
from haulspark.operators.sequences import resequence
from haulspark.sources import tables as t
from haulspark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
with r as (
  select o_orderkey as k, case when o_orderkey % 31 = 0 then null else (o_orderkey // 2)::varchar end as number, o_custkey % 500 as place, o_orderkey % 37 = 0 as bad_date, o_orderkey % 41 = 0 as bad_kind, o_orderkey % 43 = 0 as negative, o_orderkey % 47 = 0 and o_orderkey % 43 <> 0 as unreadable, cast(o_orderdate as date) as d from orders
), p as (select *, row_number() over (partition by number order by k) as seen from r),
j as (
  select *, (number is null)::int + bad_date::int + bad_kind::int + (place >= 400)::int + (place < 20)::int + negative::int as n_errors, unreadable::int as n_warnings,
         number is not null and (number::bigint % 10 = 0 or seen > 1) as old from p)
select case when n_errors > 0 then 'error' when old then 'skip' else 'create' end as action, count(*) as rows, sum(n_warnings)::bigint as warnings from j group by 1""")
def import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    place = F.col("o_custkey") % 500
    none = F.lit(None).cast("string")
    rows = o.select(
        k.alias("row_no"), F.when(k % 31 != 0, F.floor(k / 2).cast("string")).alias("order_number"), none.alias("client_name"),
        F.concat(F.lit("Locația "), place.cast("string")).alias("location_name"), F.when(k % 41 == 0, "teleport").otherwise("Livrări").alias("type"),
        F.when(k % 37 == 0, "31.02.2024").otherwise(F.date_format(F.col("o_orderdate"), "dd.MM.yyyy")).alias("requested_date"), F.lit("8").alias("window_start"), F.lit("17:30").alias("window_end"),
        F.when(k % 43 == 0, "-5").when(k % 47 == 0, "heavy").otherwise("1.250,5").alias("weight_kg"), none.alias("volume_mc"), none.alias("pallets"), none.alias("service_time_min"),
    )
    places = spark.range(400).select(F.col("id").alias("location_id"), F.concat(F.lit("LOCATIA - "), F.col("id").cast("string")).alias("name"))
    places = places.unionByName(spark.range(20).select((F.col("id") + 1000).alias("location_id"), F.concat(F.lit("locatia "), F.col("id").cast("string")).alias("name")))
    existing = o.where(F.floor(k / 2) % 10 == 0).select(F.floor(k / 2).cast("string").alias("order_number"))
    clients = spark.createDataFrame([], "client_id long, name string")
    return imports.import_summary(imports.import_plan(rows, places, clients, existing))


_VARIANTS = [  # text with {n} for a number, street, city, county, rural, town known, kind of street, number, key with {n}, score, flags
    ("Cluj-Napoca, str. Fabricii {n}", "str. Fabricii {n}", "cluj napoca", "CJ", False, True, True, "{n}", "cj|cluj napoca|strada fabricii {n}", 1.0, ""),
    ("Timișoara Calea Aradului nr. {n}", "calea aradului nr {n}", "timisoara", "TM", False, True, True, "{n}", "tm|timisoara|calea aradului {n}", 1.0, ""),
    ("sat Cornu, jud. Prahova, nr. {n}", "nr. {n}", "cornu", "PH", True, False, False, "{n}", "ph|cornu|{n}", 0.6, "oras_nerecunoscut,fara_tip_strada,rural"),
    ("mun. Târgu Mureș, Bd. Unirii {n}, bl. A2, ap. 45", "Bd. Unirii {n}, bl. A2, ap. 45", "targu mures", "MS", False, True, True, "{n}", "ms|targu mures|bulevardul unirii {n} bl a2 ap 45", 1.0, ""),
    ("Str. Dr. Felix, Al. Teilor", "Str. Dr. Felix", "al teilor", None, False, False, True, None, "al teilor|strada dr felix", 0.4, "oras_nerecunoscut,fara_numar,fara_judet"),
    ("  ", None, None, None, False, False, False, None, None, 0.0, "fara_adresa"),
    ("Str. 1 Decembrie 1918 nr. {n}, Iasi, IS", "Str. 1 Decembrie 1918 nr. {n}", "iasi", "IS", False, True, True, "{n}", "is|iasi|strada 1 decembrie 1918 {n}", 1.0, ""),
    ("Depozit Vest, Blvd. Basarabiei", "Blvd. Basarabiei", "depozit vest", None, False, False, True, None, "depozit vest|bulevardul basarabiei", 0.4, "oras_nerecunoscut,fara_numar,fara_judet"),
    ("Bolintin, DN 1", "DN 1", "bolintin", None, False, False, True, "1", "bolintin|dn 1", 0.6, "oras_nerecunoscut,fara_judet"),
]


def _variants_sql() -> str:
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({i}, {', '.join(cell(v) for v in row[1:])})" for i, row in enumerate(_VARIANTS))


@query(f"""
with v(i, street, city, county, rural, known, kind, number, key, score, flags) as (values {_variants_sql()}), c as (select c_custkey as id, (c_custkey % 90 + 2)::varchar as n, c_custkey % {len(_VARIANTS)} as i from customer)
select id, replace(street, '{{n}}', n) as street, city, county, rural as is_rural, replace(number, '{{n}}', n) as house_number, replace(key, '{{n}}', n) as address_key, score::double as score,
       case when score >= 0.8 then 'good' when score >= 0.5 then 'review' else 'poor' end as tier, flags from c join v using (i)""")
def address_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses written in nine ways, of which the parts are known."""
    k = F.col("c_custkey")
    texts = F.array(*[F.lit(row[0]) for row in _VARIANTS])
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.replace(F.get(texts, (k % len(_VARIANTS)).cast("int")), F.lit("{n}"), (k % 90 + 2).cast("string")).alias("text"))
    told = rows.withColumn("p", address.parse(F.col("text"))).withColumn("q", address.quality(F.col("p")))
    return told.select("id", "p.street", "p.city", "p.county", "p.is_rural", "p.house_number", address.address_key(F.col("p")).alias("address_key"), "q.score", "q.tier", F.array_join("q.flags", ",").alias("flags"))


@query("""
with c as (
  select c_custkey as id, case c_custkey % 4 when 0 then 0.55::double when 1 then 0.40 when 2 then 0.25 else 0.20 end + case c_nationkey % 4 when 0 then 0.2 when 1 then 0.1 when 2 then -0.15 else 0 end
    + case c_custkey % 3 when 0 then 0.1 when 1 then -0.3 else 0 end + case c_custkey % 5 when 0 then -0.1 when 1 then 0 else 0.15 end + case when c_custkey % 2 = 0 then 0.05 else 0 end as raw, c_custkey % 13 = 0 as abroad from customer),
s as (select id, case when abroad then 0.0 else floor(least(1.0, greatest(0.0, raw)) * 100 + 0.5) / 100 end as score from c)
select case when score >= 0.8 then 'accepted' when score >= 0.45 then 'flagged' else 'rejected' end as decision, count(*) as n from s group by 1""")
def geocode_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    precision = F.element_at(F.array(*[F.lit(x) for x in ("address", "street", "locality", "other")]), (k % 4 + 1).cast("int"))
    city = F.element_at(F.array(F.lit("same"), F.lit("partial"), F.lit("different"), F.lit(None).cast("string")), n % 4 + 1)
    score = address.match_score(precision, city, F.when(k % 3 == 0, True).when(k % 3 == 1, False), F.when(k % 5 == 0, False).when(k % 5 > 1, True), k % 2 == 0, F.when(k % 13 == 0, "HU").otherwise("RO"))
    return table(spark, sf_dir, "customer").groupBy(address.accept(score).alias("decision")).agg(F.count("*").alias("n"))


@query("""
with c as (select (c_custkey % 50 = 0)::int as a, (c_custkey % 7 = 0)::int as b, (c_custkey % 11 = 0)::int as e, (c_custkey % 9 = 0)::int as p from customer)
select sum(a)::bigint as name_missing, sum(b)::bigint as vat_id_invalid, sum(e)::bigint as email_invalid, sum(p)::bigint as phone_invalid, count(*) filter (where a + b + e + p = 0) as clean from c""")
def entity_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    errors = lifecycle.client_errors(
        F.when(k % 50 == 0, "  ").otherwise(F.col("c_name")), F.when(k % 7 == 0, "RO-??").when(k % 2 == 0, "RO12345678"),
        F.when(k % 11 == 0, "a @b.ro").when(k % 3 == 0, "name@firm.ro").otherwise(""), F.when(k % 9 == 0, "12-34").when(k % 4 == 0, "+40 722 123 456"),
    )
    has = lambda e: F.count_if(F.array_contains("errors", e)).alias(e)
    rows = table(spark, sf_dir, "customer").select(errors.alias("errors"))
    return rows.agg(has("name_missing"), has("vat_id_invalid"), has("email_invalid"), has("phone_invalid"), F.count_if(F.size("errors") == 0).alias("clean"))


@query("""
with p as (select case l_returnflag when 'A' then 'livrat' when 'R' then 'refuzat' else case when l_partkey % 10 = 0 then 'lost' else 'partial' end end as outcome, case when l_partkey % 3 <> 0 then 'x' else '' end as rec, case when l_suppkey % 4 <> 0 then 'r' end as reason, case when l_suppkey % 5 <> 0 then 's' end as sig from lineitem),
e as (select outcome, case when outcome = 'lost' then 'outcome_unknown' when outcome = 'livrat' and rec = '' then 'recipient_missing' when outcome = 'refuzat' and reason is null then 'reason_missing' when outcome = 'livrat' and sig is null then 'signature_missing' end as pod_error from p)
select coalesce(pod_error, 'ok') as pod_error, case when pod_error is null then case when outcome = 'refuzat' then 'esuat' else 'finalizat' end end as stop_status, count(*) as n from e group by 1, 2""")
def delivery_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, flag = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(flag == "A", "livrat").when(flag == "R", "refuzat").when(p % 10 == 0, "lost").otherwise("partial").alias("outcome"), F.when(p % 3 != 0, "x").otherwise("").alias("recipient_name"),
        F.when(s % 4 != 0, "r").alias("refusal_reason"), F.when(s % 5 != 0, "s").alias("signature_url"),
    )
    out = lifecycle.proof_of_delivery(rows)
    return out.groupBy(F.coalesce("pod_error", F.lit("ok")).alias("pod_error"), "stop_status").agg(F.count("*").alias("n"))


@query("""
with d as (select o_orderkey as id, case when o_orderkey % 3 <> 0 then 'x' end as sender, case when o_orderkey % 4 <> 0 then 'x' else ' ' end as weight, case when o_orderkey % 5 <> 0 then 'x' end as receiver from orders)
select id, array_to_string(list_filter([case when sender is null then 'sender' end, case when trim(weight) = '' then 'weight' end], lambda x: x is not null), ',') as missing_loading, case when receiver is null then 'receiver' else '' end as missing_delivery,
       (sender is not null)::int + (trim(weight) <> '')::int + (receiver is not null)::int as filled from d""")
def waybill_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 != 0, "x").alias("sender"), F.when(k % 4 != 0, "x").otherwise(" ").alias("weight"), F.when(k % 5 != 0, "x").alias("receiver"))
    out = lifecycle.waybill_gaps(rows, {"loading": ["sender", "weight"], "delivery": ["receiver"]})
    return out.select("id", F.array_join("missing_loading", ",").alias("missing_loading"), F.array_join("missing_delivery", ",").alias("missing_delivery"), "filled")


@query("""
with recursive m as (select c_custkey as id, case when c_custkey % 4 <> 0 then c_custkey - 1 end as into_id from customer),
w(id, now, hop) as (select id, id, 0 from m union all select w.id, m.into_id, hop + 1 from w join m on m.id = w.now where m.into_id is not null and hop < 5)
select id, arg_max(now, hop) as final_id from w group by 1""")
def merge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 4 != 0, k - 1).alias("into_id"))
    return lifecycle.merged_into(rows, "id", "into_id").select("id", "final_id")


@query("""
with recursive p as (select p_size as archive, p_partkey, case when p_partkey % 9 = 0 then 'a/' else '' end as folder, p_brand || case when p_partkey % 5 = 0 then '-1' else '' end as stem, case when p_partkey % 4 = 0 then '' else '.pdf' end as ending, row_number() over (partition by p_size order by p_partkey) as n from part),
w as (
  select distinct p_size as archive, 0::bigint as n, null::bigint as p_partkey, null::varchar as unique_name, []::varchar[] as used from part
  union all
  select archive, n, p_partkey, free, list_append(used, free)
  from (select w.archive, p.n, p.p_partkey, w.used, list_filter(list_transform(range(0, 200), lambda i: p.folder || p.stem || case when i > 0 then '-' || i else '' end || p.ending), lambda x: not list_contains(w.used, x))[1] as free
        from w join p on p.archive = w.archive and p.n = w.n + 1))
select p_partkey, unique_name from w where n > 0""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 9 == 0, "a/").otherwise(""), F.col("p_brand"), F.when(k % 5 == 0, "-1").otherwise(""), F.when(k % 4 == 0, "").otherwise(".pdf"))
    rows = table(spark, sf_dir, "part").select("p_size", "p_partkey", name.alias("name"))
    return lifecycle.unique_names(rows, "p_size", "name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("""
with l as (select o_custkey as invoice_id, row_number() over (partition by o_custkey order by o_orderkey) as seq, o_orderpriority || ' <&>' as label, floor(o_totalprice) / 4 as amount from orders),
s as (select invoice_id, string_agg('<Line><Id>' || seq || '</Id><Name>' || replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</Name><Amount>' || printf('%.2f', amount) || '</Amount></Line>', '' order by seq) as body, sum(amount::decimal(28,2))::double as net from l group by 1),
v as (select *, floor(net * 19 / 100 * 100 + 0.5) / 100 as vat from s)
select invoice_id, '<Invoice><ID>' || invoice_id || '</ID><Customer>client ' || invoice_id || '</Customer>' || body || '<Net>' || printf('%.2f', net) || '</Net><Tax>' || printf('%.2f', vat) || '</Tax><Total>' || printf('%.2f', net + vat) || '</Total></Invoice>' as xml from v""")
def invoice_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoice of every customer with orders."""
    return _invoices(table(spark, sf_dir, "orders"))


def _invoices(o: DataFrame) -> DataFrame:
    lines = resequence(o.select(F.col("o_custkey").alias("invoice_id"), "o_orderkey", F.concat("o_orderpriority", F.lit(" <&>")).alias("label"), (F.floor("o_totalprice") / 4).alias("amount")), "invoice_id", [F.col("o_orderkey")])
    return lifecycle.invoice_xml(lines.withColumns({"vat_pct": F.lit(19.0), "client": F.concat(F.lit("client "), F.col("invoice_id").cast("string"))}))


@query("""
with i as (select l_orderkey as page_id, l_linenumber as line, l_partkey % 40 * 10.0::double as x, l_linenumber * 12.0::double + l_partkey % 3 as y, l_partkey::varchar as text from lineitem),
g as (select *, x - (lag(x) over w + 8) as apart from i window w as (partition by page_id, line order by x, y desc, text))
select page_id, row_number() over (partition by page_id order by line desc)::int as line_no, string_agg(case when apart is null then '' when apart > 6 then chr(9) else ' ' end || text, '' order by x, y desc, text) as text from g group by page_id, line""")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("goods_id")
    items = t.runs(spark, sf_dir).select(F.col("tpo_id").alias("page_id"), (g % 40 * 10.0).alias("x"), (F.col("line") * 12.0 + g % 3).alias("y"), F.lit(8.0).alias("width"), g.cast("string").alias("text"))
    return lifecycle.join_rows_of_pages(items)


@query("""
with recursive p as (
  select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, cast(l_shipdate as date), l_partkey, l_suppkey, l_extendedprice) as page_no,
         list_filter([case when l_partkey % 3 <> 0 then 'PSL-' || (l_partkey % 4) end, case when l_suppkey % 2 = 0 then 'TPO-' || (l_suppkey % 3) end], lambda x: x is not null) as keys from lineitem),
w as (
  select doc_id, page_no, 1 as part, keys as held from p where page_no = 1
  union all
  select doc_id, page_no, case when stays then part else part + 1 end, case when stays then list_concat(held, keys) else keys end
  from (select p.doc_id, p.page_no, p.keys, w.part, w.held, list_filter(p.keys, lambda x: not starts_with(x, 'TPO-')) as own, list_filter(w.held, lambda x: not starts_with(x, 'TPO-')) as theirs,
               len(p.keys) = 0 or case when len(own) > 0 and len(theirs) > 0 then list_has_any(own, theirs) else list_has_any(p.keys, w.held) end as stays
        from w join p on p.doc_id = w.doc_id and p.page_no = w.page_no + 1)),
n as (select doc_id, len(list_distinct(flatten(list(keys)))) as n from p group by 1)
select doc_id, page_no::int as page_no, case when n < 2 then 1 else part end as part from w join n using (doc_id)""")
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = resequence(t.runs(spark, sf_dir), "tpo_id", [F.col(c) for c in ("line", "run_date", "goods_id", "vehicle_id", "value")], "page_no")
    g, v = F.col("goods_id"), F.col("vehicle_id")
    own, order = F.when(g % 3 != 0, F.concat(F.lit("PSL-"), (g % 4).cast("string"))), F.when(v % 2 == 0, F.concat(F.lit("TPO-"), (v % 3).cast("string")))
    return lifecycle.split_pages(pages.select(F.col("tpo_id").alias("doc_id"), "page_no", F.filter(F.array(own, order), lambda x: x.isNotNull()).alias("keys")))
