"""Feedback of operators on what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.operators import feedback
from haulspark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}
_FIELDS = ["tpo", "plate", "observations", "gross_kg", "route"]
_ROUTINGS = ["auto", "hitl_optional", "hitl_required", "odd"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rules = F.filter(F.array(F.lit("tpo_missing"), F.when(k % 3 == 0, "plate_missing"), F.when(k % 7 == 0, "date_missing")), lambda r: r.isNotNull())
    return table(spark, sf_dir, "orders").where(k % 5 != 0).select(k.alias("id"), F.get(F.array(*[F.lit(r) for r in _ROUTINGS]), (k % 4).cast("int")).alias("routing"), F.when(k % 4 != 1, rules).alias("failed_rules"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event an order that has a line of even part: a change a line, in the order of the lines."""
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    field = F.get(F.array(*[F.lit(f) for f in _FIELDS]), (p % 5).cast("int"))
    change = F.struct(n.alias("n"), p.alias("p"), F.col("l_suppkey").alias("s"), field.alias("field"), F.when(p % 3 != 0, F.concat(F.lit("a"), p % 10)).alias("old_value"), F.when(p % 6 != 0, F.concat(F.lit("b"), p % 10)).alias("new_value"))
    lines = table(spark, sf_dir, "lineitem").where(p % 8 < 1).groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_sort(F.collect_set(change)).alias("c"))
    return lines.select("document_id", F.col("document_id").alias("event_id"), F.when(F.col("document_id") % 6 != 0, F.concat(F.lit("user"), F.col("document_id") % 4)).alias("operator"), F.transform("c", lambda c: F.struct(c["field"].alias("field"), c["old_value"].alias("old_value"), c["new_value"].alias("new_value"))).alias("changes"))


_SQL = """
with d as materialized (select o_orderkey as id, case o_orderkey % 4 when 0 then 'auto' when 1 then 'hitl_optional' when 2 then 'hitl_required' else 'unknown' end as routing, case when o_orderkey % 4 <> 1 then list_filter(['tpo_missing', case when o_orderkey % 3 = 0 then 'plate_missing' end, case when o_orderkey % 7 = 0 then 'date_missing' end], lambda r: r is not null) end as rules from orders where o_orderkey % 5 <> 0),
l as (select distinct l_orderkey as doc, l_linenumber as n, l_partkey as p, l_suppkey as s from lineitem where l_partkey % 8 < 1),
c as materialized (select doc, n, p, s, ['tpo', 'plate', 'observations', 'gross_kg', 'route'][p % 5 + 1] as field, case when p % 3 <> 0 then 'a' || (p % 10) end as old, case when p % 6 <> 0 then 'b' || (p % 10) end as new, case when doc % 6 <> 0 then 'user' || (doc % 4) end as who, doc in (select id from d) as inside from l where p % 5 <> 2),
total as (select count(*) as total from d)"""
_RATE = "case when {b} <> 0 then floor({a} / {b} * 1000 + 0.5) / 1000 end"


def feedback_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.overview(_events(spark, sf_dir), _documents(spark, sf_dir))


def feedback_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.by_routing(_events(spark, sf_dir), _documents(spark, sf_dir))


def feedback_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.by_field(_events(spark, sf_dir), _documents(spark, sf_dir))


def feedback_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.by_rule(_documents(spark, sf_dir))


def feedback_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.by_operator(_events(spark, sf_dir), _documents(spark, sf_dir))


def feedback_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.suggestions(_events(spark, sf_dir), _documents(spark, sf_dir))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from 0.4 to 0.9 against how surely each field was read and whether it was corrected."""
    p = F.col("l_partkey")
    read = table(spark, sf_dir, "lineitem").select(F.get(F.array(*[F.lit(f) for f in _FIELDS]), (p % 5).cast("int")).alias("field"), F.when(p % 17 != 0, (p % 97) / 100).alias("confidence"), (F.col("l_suppkey") % 100 > p % 97).alias("corrected"))
    return feedback.threshold_sweep(read, [0.4, 0.5, 0.55, 0.8, 0.9])


_FIELD_SQL = f"""{_SQL}, g as (select field, count(*) as corrections, count(distinct doc) as documents from c where inside group by 1),
x as (select field, coalesce(old, '') || ' > ' || coalesce(new, '') as pair, row_number() over (partition by field order by doc, n, p, s) as k from c where inside and (old is not null or new is not null)),
y as (select field, string_agg(pair, '; ' order by k) as examples from x where k <= 3 group by 1),
fields as (select field, corrections, documents, {_RATE.format(a='documents', b='total')} as doc_rate, {_RATE.format(a='corrections', b='total')} as edit_rate, coalesce(examples, '') as examples from g left join y using (field), total)"""
_ROUTING_SQL = f"""r as (select routing, count(*) as total, count(*) filter (id in (select doc from c)) as touched from d group by 1),
routings as (select k.routing, coalesce(r.total, 0) as total, coalesce(touched, 0) as touched, {_RATE.format(a='touched', b='r.total')} as touch_rate from (values ('auto'), ('hitl_optional'), ('hitl_required'), ('unknown')) k(routing) left join r using (routing))"""
_RULE_SQL = f"u as (select unnest(rules) as rule from d), rules as (select rule, count(*) as documents, {_RATE.format(a='count(*)', b='any_value(total)')} as doc_rate from u, total group by 1)"

for _f in (feedback_overview, feedback_routing, feedback_fields, feedback_rules, feedback_operators, feedback_suggestions, threshold_sweep):
    QUERIES[_f.__name__] = _f
ORACLE_SQL |= {
    "feedback_overview": f"{_SQL}, t as (select count(distinct doc) filter (inside) as touched, count(distinct doc) filter (not inside) as touched_outside, count(*) filter (inside) as corrections, count(*) filter (not inside) as corrections_outside from c) select total, t.*, {_RATE.format(a='touched', b='total')} as touch_rate, {_RATE.format(a='corrections', b='touched')} as corrections_per_touched from t, total",
    "feedback_routing": f"{_SQL}, {_ROUTING_SQL} select * from routings",
    "feedback_fields": f"{_FIELD_SQL} select * from fields",
    "feedback_rules": f"{_SQL}, {_RULE_SQL} select * from rules",
    "feedback_operators": f"{_SQL} select who as operator, count(*) as corrections from c where inside and who is not null group by 1",
    "feedback_suggestions": f"""{_FIELD_SQL}, {_ROUTING_SQL}, {_RULE_SQL}
select 'field_hot' as kind, field as subject, doc_rate as rate from fields, total where doc_rate > 0.3 and total.total >= 10 union all select 'noise', routing, round(1 - touch_rate, 3) from routings where routing = 'hitl_optional' and total >= 5 and 1 - touch_rate > 0.7
union all select 'miss', routing, touch_rate from routings where routing = 'auto' and total >= 5 and touch_rate > 0.15 union all select 'rule_hot', rule, doc_rate from rules where doc_rate > 0.5""",
    "threshold_sweep": """
with r as (select ['tpo', 'plate', 'observations', 'gross_kg', 'route'][l_partkey % 5 + 1] as field, (l_partkey % 97) / 100 as c, l_suppkey % 100 > l_partkey % 97 as bad from lineitem where l_partkey % 17 <> 0)
select field, t::double as threshold, count(*) filter (c >= t) as above, count(*) filter (c >= t and bad) as missed, count(*) filter (c < t) as below, count(*) filter (c < t and not bad) as needless from r, (values (0.4::double), (0.5::double), (0.55::double), (0.8::double), (0.9::double)) v(t) group by 1, 2""",
}
