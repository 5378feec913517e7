"""Exceptions as they open and close, in a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.sources.tables import table
from haulspark.streaming.openings import openings
from haulspark.streaming.runs import openings_to_the_end, resolutions, speeding

QUERIES, ORACLE_SQL = {}, {}

_LOG = """
with found as (select user_id as vehicle_id, ts, case when value > 110 then 'critical' else 'warning' end as severity from events where value > 90),
done as (select user_id as vehicle_id, ts + interval 30 minutes as ts from events where event_id % 5 = 0),
mark as (select {until} as until),
e as (select vehicle_id, ts, 0 as ends, min(severity) as severity from found group by 1, 2 union all select distinct vehicle_id, ts, 1, null from done),
s as (select *, lag(ts) over w as before, lag(ends) over w as ended, lead(ts) over w as next from e window w as (partition by vehicle_id order by ts, ends)),
a as (select *, coalesce(ended = 0 and ts - before <= interval 4 hours, false) as alive from s),
o as (select *, sum(case when ends = 0 and not alive then 1 else 0 end) over (partition by vehicle_id order by ts, ends) as spell from a),
p as (select *, first_value(ts) over q as opened_at, first_value(severity) over q as told from o window q as (partition by vehicle_id, spell order by ts, ends)),
out as (
  select vehicle_id, 'open' as action, ts as happened_at, opened_at, told, null as reason from p where ends = 0 and not alive
  union all select vehicle_id, 'close', ts, opened_at, told, 'resolved' from p where ends = 1 and alive
  union all select vehicle_id, 'close', ts + interval 4 hours, opened_at, told, 'quiet' from p, mark where ends = 0 and (coalesce(next > ts + interval 4 hours, false) or until > ts + interval 4 hours and next is null)
)
select vehicle_id, 'viteza' as type, null::bigint as route_id, null::bigint as stop_id, action, happened_at, opened_at, told as severity, reason from out"""


def exception_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeding opens, is renewed, resolved by the office, or closes after four quiet hours."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("vehicle_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("speed"))
    return openings(speeding(events), resolutions(events).where("type = 'viteza'"), until="2100-01-01")


def stream_exception_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stream, which stops ten minutes behind the stream that has come less far."""
    return openings_to_the_end(spark, sf_dir)


QUERIES |= {"exception_openings": exception_openings, "stream_exception_openings": stream_exception_openings}
ORACLE_SQL |= {
    "exception_openings": _LOG.format(until="timestamp '2100-01-01'"),
    "stream_exception_openings": _LOG.format(until="least((select max(ts) from found), (select max(ts) from done)) - interval 10 minutes"),
}
