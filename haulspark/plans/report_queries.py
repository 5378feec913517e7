"""Selections and exports of reports, upserts, retention, trails and rows as they are sent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.functions.timez import preset_days
from haulspark.operators import selection, upkeep
from haulspark.operators.relational import like_open
from haulspark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_DOCS_SQL = """
docs as (
  select o_orderkey as id, case when o_orderkey % 11 <> 0 then cast(o_orderdate as date) end as day, o_orderdate as created_at, case o_orderstatus when 'F' then 'confirmed' when 'P' then 'extracted' else 'uploaded' end as status,
         'B ' || lpad((o_custkey % 100)::varchar, 2, '0') || ' xyz' as plate, 'lot' || (o_custkey % 7) as batch_id, case when o_orderkey % 5 = 0 then 'cmr' else 'aviz' end as kind, case when o_orderkey % 3 <> 0 then o_totalprice / 10 end as gross_kg, 'TPO-' || o_orderkey as tpo,
         'PSL-' || o_custkey as doc_no, o_orderpriority as route, 'scan_' || o_orderkey || '.pdf' as file_name
  from orders)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 11 != 0, F.col("o_orderdate").cast("date")).alias("day"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "P", "extracted").otherwise("uploaded").alias("status"), text("B ", F.lpad((c % 100).cast("string"), 2, "0"), " xyz").alias("plate"),
        text("lot", c % 7).alias("batch_id"), F.when(k % 5 == 0, "cmr").otherwise("aviz").alias("kind"), F.when(k % 3 != 0, F.col("o_totalprice") / 10).alias("gross_kg"), text("TPO-", k).alias("tpo"), text("PSL-", c).alias("doc_no"),
        F.col("o_orderpriority").alias("route"), text("scan_", k, ".pdf").alias("file_name"),
    )


@query(f"""
with {_DOCS_SQL}
select id, day, status, plate from docs where ((day >= date '1997-03-01' and day <= date '1998-02-10') or (day is null and created_at >= timestamp '1997-02-28 22:00:00' and created_at < timestamp '1998-02-10 22:00:00'))
  and status = 'confirmed' and contains(lower(plate), 'b 0') and gross_kg is not null and contains(lower(tpo) || '|' || lower(doc_no) || '|' || lower(route) || '|' || lower(file_name), '7')
order by day nulls last, created_at, id limit 500""")
def report_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = {"from": "1997-03-01T00:00", "to": "1998-02-10", "status": "confirmed", "plate": " B 0 ", "with_weight": True, "q": "7", "kind": "unknown", "limit": 9000}
    return selection.select_documents(_docs(spark, sf_dir), told).select("id", "day", "status", "plate")


@query(f"with {_DOCS_SQL} select id, batch_id, kind from docs where id in (select 5 * k from range(1, 140) t(k)) and kind = 'cmr' and batch_id = 'lot2' order by day nulls last, created_at, id limit 500")
def report_selection_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_documents(_docs(spark, sf_dir), {"ids": [5, None, *[5 * i for i in range(1, 140)]], "kind": "cmr", "batch_id": "lot2"}).select("id", "batch_id", "kind")


_SELECTIONS = [("nothing", {}, True), ("blank", {"plate": "  ", "q": "", "ids": [None]}, True), ("malformed", {"from": "soon", "status": "lost", "with_weight": "yes"}, True), ("limit", {"limit": 5}, True), ("day", {"to": "1997-01-01"}, False), ("ids", {"ids": [3]}, False), ("weight", {"with_weight": True}, False)]


@query(f"""
with {_DOCS_SQL}
select name, true as is_empty, 0::bigint as documents from (values {', '.join(f"('{n}')" for n, _, e in _SELECTIONS if e)}) t(name)
union all select 'day', false, least(500, count(*)) from docs where day <= date '1997-01-01' or (day is null and created_at < timestamp '1997-01-01 22:00:00')
union all select 'ids', false, count(*) from docs where id = 3 union all select 'weight', false, least(500, count(*)) from docs where gross_kg is not null""")
def empty_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stated selections take: those that would take the whole archive take nothing."""
    docs, parts = _docs(spark, sf_dir), []
    for name, told, _ in _SELECTIONS:
        empty = selection.is_empty(told)
        taken = docs.limit(0) if empty else selection.select_documents(docs, told)
        parts.append(taken.agg(F.count("*").alias("documents")).select(F.lit(name).alias("name"), F.lit(empty).alias("is_empty"), "documents"))
    return reduce(DataFrame.unionByName, parts)


@query("""
with i as (select o_custkey as id, list(o_orderkey // 3 order by o_orderkey) as keys from orders group by 1),
d as (select id, list_sort(list_distinct(keys)) as keys from i)
select id, array_to_string(keys[1:5], ',') as kept from d""")
def id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's ids once, in order, five at most."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.floor(F.col("o_orderkey") / 3))).alias("keys"))
    return o.select("id", F.array_join(F.transform(selection.unique_id_array(F.col("keys"), 5), lambda k: k.cast("string")), ",").alias("kept"))


@query(f"""
with {_DOCS_SQL}, s as (select * from docs where status = 'extracted' and batch_id = 'lot3' order by day nulls last, created_at, id limit 500),
r as (select count(*) as row_count, string_agg(id::varchar, ',' order by day nulls last, created_at, id) as ids, '{{"columns":["id","plate","kind"],"rows":[' || string_agg('{{"id":' || id || ',"plate":"' || plate || '","kind":"' || kind || '"}}', ',' order by day nulls last, created_at, id) || ']}}' as snapshot from s)
select 'xlsx' as kind, row_count, ids, sha256(snapshot) as snapshot_sha, 'extracted' as filter_status from r""")
def export_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the export log keeps of one export, its snapshot by its hash."""
    told = {"status": "extracted", "batch_id": "lot3"}
    rows = selection.select_documents(_docs(spark, sf_dir), told)
    out = selection.snapshot(rows, ["id", "plate", "kind"], [F.col("day").isNull(), F.col("day"), F.col("created_at"), F.col("id")], filter_status=F.lit(told["status"]))
    return out.select("kind", "row_count", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.sha2("snapshot", 256).alias("snapshot_sha"), "filter_status")


@query(f"with {_DOCS_SQL} select id from docs where day >= date '1998-01-01' and status = 'uploaded' and contains(lower(concat_ws(' ', tpo, plate, file_name)), '42')")
def list_filter_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(selection.matches_list(F.col("day"), {"from": "1998-01-01", "status": "uploaded", "q": " 42 "}, ["tpo", "plate", "file_name"], {"status": "status"})).select("id")


@query("select p_partkey from part where lower(p_name) like '%r_d w%t%'")
def open_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in which the user's ``%`` and ``_`` are wildcards."""
    return table(spark, sf_dir, "part").where(like_open(F.col("p_name"), "R_d W%t")).select("p_partkey")


_UPSERT_SQL = """
t as (select s_suppkey as key, s_acctbal as balance, 'old' as origin from supplier), i as (select c_custkey % 150 as key, c_acctbal as balance, 'new' as origin, row_number() over (partition by c_custkey % 150 order by c_acctbal desc, c_custkey) as k from customer), n as (select key, balance, origin from i where k = 1)"""


def _upserted(spark: SparkSession, sf_dir: str, update: bool) -> DataFrame:
    target = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.lit("old").alias("origin"))
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 150).alias("key"), F.col("c_acctbal").alias("balance"), F.lit("new").alias("origin"), "c_custkey")
    return upkeep.upsert(target, rows, ["key"], [-F.col("balance"), F.col("c_custkey")], update)


@query(f"with {_UPSERT_SQL} select * from n union all select * from t where key not in (select key from n)")
def upsert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir, True)


@query(f"with {_UPSERT_SQL} select * from t union all select * from n where key not in (select key from t)")
def upsert_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir, False)


def _aging(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    at = lambda df, c, name: df.select(F.col(c).cast("timestamp").alias(name), *([(F.col("event_id") % 4 == 0).alias("is_current")] if c == "ts" else []))
    return {
        "telematics_positions": at(e, "ts", "recorded_at"), "gps_logs": at(e, "ts", "created_at"), "chat_messages": at(o, "o_orderdate", "created_at"), "office_notification_dismissals": at(e, "ts", "dismissed_at"),
        "refresh_tokens": at(o, "o_orderdate", "expires_at"), "geocode_cache": at(o, "o_orderdate", "updated_at"),
    }


@query("""
with c(id, days, old_rows) as (
  select 'telematics_positions', 90, count(*) filter (where ts < timestamp '2024-04-10' - interval 90 days) from events
  union all select 'gps_logs', 70, count(*) filter (where ts < timestamp '2024-04-10' - interval 70 days and event_id % 4 <> 0) from events
  union all select 'chat_messages', 365, count(*) filter (where o_orderdate < timestamp '2024-04-10' - interval 365 days) from orders
  union all select 'office_notification_dismissals', 180, count(*) filter (where ts < timestamp '2024-04-10' - interval 180 days) from events
  union all select 'refresh_tokens', 9000, count(*) filter (where o_orderdate < timestamp '2024-04-10' - interval 9000 days) from orders
  union all select 'geocode_cache', 730, count(*) filter (where o_orderdate < timestamp '2024-04-10' - interval 730 days) from orders)
select id, days, old_rows, least(old_rows, 1000) as deleted, old_rows >= 1000 as more from c""")
def retention_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the six policies would drop, two of them with days of their own."""
    return upkeep.retention_preview(_aging(spark, sf_dir), "2024-04-10", {"gps_logs": 70, "refresh_tokens": 9000, "chat_messages": -1}, batch=1000)


@query("select event_id % 4 = 0 as is_current, count(*) as n from events where ts >= timestamp '2024-02-10' - interval 30 days or event_id % 4 = 0 group by 1")
def retention_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of old logs: the newest of each vehicle stay."""
    logs = _aging(spark, sf_dir)["gps_logs"]
    return upkeep.retained_by(upkeep.POLICIES[1], logs, "2024-02-10").groupBy("is_current").agg(F.count("*").alias("n"))


@query("""
with x as (select c_custkey as id, case when c_custkey % 3 = 0 then 'balance=' || c_acctbal::varchar || '>' || (c_acctbal + 1)::varchar end as a, case when c_custkey % 4 = 0 then 'api_key=«ascuns»>«ascuns»' end as b,
                  case when c_custkey % 5 = 0 then 'note=-><' end as c, case when c_custkey % 5 = 1 then 'note=short>«600 caractere»' end as d from customer)
select id, array_to_string(list_filter([a, b, replace(c, '-><', '->short'), d], lambda v: v is not null), ';') as changes from x where a is not null or b is not null or c is not null or d is not null""")
def row_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed fields of clients as a trail shows them; numbers written in another way are no change."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    before = c.select(k.alias("id"), F.col("c_acctbal").cast("string").alias("balance"), F.lit("s").alias("api_key"), F.when(k % 5 != 0, "short").alias("note"), F.lit("10t").alias("class"), F.lit(1).alias("updated_at"))
    after = c.select(
        k.alias("id"), F.when(k % 3 == 0, (F.col("c_acctbal") + 1).cast("string")).otherwise(F.format_string("%.4f", "c_acctbal")).alias("balance"), F.when(k % 4 == 0, "t").otherwise("s").alias("api_key"),
        F.when(k % 5 == 1, F.lit("x" * 600)).otherwise("short").alias("note"), F.lit("10t").alias("class"), F.lit(2).alias("updated_at"),
    )
    out = upkeep.row_changes(before, after, "id", ["balance", "api_key", "note", "class", "updated_at"])
    pairs = F.transform(F.map_entries("changes"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["from"], F.lit("-")), F.lit(">"), F.coalesce(e["value"]["to"], F.lit("-"))))
    return out.select("id", F.array_join(pairs, ";").alias("changes"))


@query("""select s_suppkey as id, '{"id":"' || s_suppkey || '","name":"' || s_name || '","password_hash":"«ascuns»","note":' || case when s_suppkey % 3 = 0 then 'null' when s_suppkey % 3 = 1 then '"«501 caractere»"' else '"ok"' end || '}' as snapshot from supplier""")
def row_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.lit("x").alias("password_hash"), F.when(k % 3 == 1, "y" * 501).when(k % 3 == 2, "ok").alias("note"), F.lit(7).alias("company_id"))
    return upkeep.row_snapshots(rows, "id")


@query("""
select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as issue_date, strftime(o_orderdate, '%H:%M') as start_time, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') as created_at, case when o_orderkey % 4 = 0 then null else o_orderkey % 9 + 0.5::double end as gross_kg,
       strftime(o_orderdate, '%Y-%m-%d') as data_facturare, '07' as code, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') as created_date from orders""")
def row_serialisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), d.alias("issue_date"), d.alias("start_time"), d.alias("created_at"), F.when(k % 4 == 0, "about 5").otherwise(F.concat((k % 9).cast("string"), F.lit(".5000"))).alias("gross_kg"),
        F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00")).alias("data_facturare"), F.lit("07").alias("code"),
    )
    return upkeep.serialised(rows)


@query("select event_type as value, count(*) as n from events group by 1")
def entity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.histogram(table(spark, sf_dir, "events"), "event_type")


@query("select distinct trim(p_brand) as value from part where trim(p_brand) <> ''")
def distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.distinct_values(table(spark, sf_dir, "part"), "p_brand")


_OPEN_SQL = "x as (select event_id as id, case when event_id % 3 = 0 then ts end as acknowledged_at, case when event_id % 3 = 0 then 'ana' end as acknowledged_by, case when event_id % 5 = 0 then ts end as resolved_at, event_id % 2 = 0 as hit from events)"


def _open(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, k, ts = table(spark, sf_dir, "events"), F.col("event_id"), F.col("ts").cast("timestamp")
    return e.select(k.alias("id"), F.when(k % 3 == 0, ts).alias("acknowledged_at"), F.when(k % 3 == 0, "ana").alias("acknowledged_by"), F.when(k % 5 == 0, ts).alias("resolved_at")), e.where(k % 2 == 0).select(k.alias("id"))


@query(f"""
with {_OPEN_SQL} select id, case when hit and resolved_at is null then coalesce(acknowledged_at, timestamp '2024-03-01') else acknowledged_at end as acknowledged_at, case when hit and resolved_at is null then coalesce(acknowledged_by, 'dan') else acknowledged_by end as acknowledged_by, resolved_at from x""")
def exception_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.acknowledge(*_open(spark, sf_dir), "2024-03-01", "dan")


@query(f"""
with {_OPEN_SQL} select id, case when hit and resolved_at is null then coalesce(acknowledged_at, timestamp '2024-03-01') else acknowledged_at end as acknowledged_at, case when hit and resolved_at is null then coalesce(acknowledged_by, 'dan') else acknowledged_by end as acknowledged_by,
       case when hit and resolved_at is null then timestamp '2024-03-01' else resolved_at end as resolved_at from x""")
def exception_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.acknowledge(*_open(spark, sf_dir), "2024-03-01", "dan", resolve=True)


@query("""
with d as (select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 5 <> 0 then l_quantity + case l_partkey % 3 when 0 then 0 when 1 then 0.4::double else 3 end end as incoming, case when l_partkey % 7 <> 0 then l_quantity end as stored, case l_suppkey % 3 when 0 then 'osrm' when 1 then 'manual' end as src from lineitem),
s as (select case when incoming is null then null when src = 'osrm' and stored is not null and abs(incoming - stored) < 0.5 then 'osrm' else 'manual' end as source, incoming is null as cleared from d)
select coalesce(source, '-') as source, source is null or source = 'osrm' as auto, count(*) as n from s group by 1, 2""")
def distance_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p, q = table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_quantity")
    incoming = F.when(p % 5 != 0, q + F.when(p % 3 == 0, 0.0).when(p % 3 == 1, 0.4).otherwise(3.0))
    told = li.select(upkeep.distance_owner(incoming, F.when(p % 7 != 0, q), F.when(F.col("l_suppkey") % 3 == 0, "osrm").when(F.col("l_suppkey") % 3 == 1, "manual")).alias("d"))
    return told.groupBy(F.coalesce("d.source", F.lit("-")).alias("source"), F.col("d.auto").alias("auto")).agg(F.count("*").alias("n"))


@query("""
with c as (select c_custkey as id, '{"plan":{"name":"basic","seats":' || (c_custkey % 9) || '},"tags":[' || array_to_string(list_transform(range(0, c_custkey % 4), lambda i: '"t' || i || '"'), ',') || ']}' as doc from customer)
select id, '{"plan":{"name":"pro","seats":' || (id % 9) || '},"tags":[' || array_to_string(list_transform(range(0, id % 4), lambda i: '"t' || i || '"'), ',') || ']}' as doc, (id % 4)::int as n_tags from c""")
def json_set_and_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of a stored JSON set anew, and the length of its list."""
    k = F.col("c_custkey")
    tags = F.to_json(F.transform(F.when(k % 4 > 0, F.sequence(F.lit(0), (k % 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("t"), i.cast("string"))))
    doc = F.concat(F.lit('{"plan":{"name":"basic","seats":'), (k % 9).cast("string"), F.lit('},"tags":'), tags, F.lit("}"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.from_json(doc, "plan struct<name:string,seats:int>, tags array<string>").alias("j"), doc.alias("old"))
    return rows.select("id", F.to_json(F.col("j").withField("plan.name", F.lit("pro"))).alias("doc"), F.json_array_length(F.get_json_object("old", "$.tags")).alias("n_tags"))


@query("""
with d as (select event_id, ts, cast(timezone('Europe/Bucharest', timezone('UTC', ts)) as date) as today from events)
select event_id, 'today' as preset, today as first_day, today as last_day from d union all select event_id, 'week', cast(date_trunc('week', today) as date), cast(date_trunc('week', today) as date) + 6 from d union all select event_id, 'month', cast(date_trunc('month', today) as date), last_day(today) from d""")
def date_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of each preset as they are at every event's instant."""
    nows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("now"))
    each = lambda p: nows.select("event_id", F.lit(p).alias("preset"), *[c.alias(n) for c, n in zip(preset_days(p, F.col("now")), ("first_day", "last_day"), strict=True)])
    return each("today").unionByName(each("week")).unionByName(each("month"))
