"""Exceptions that are open: each is told once when it opens and once when it closes, on a stream and in a batch."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from haulspark.sources.shipping import ship_package

KEY = ["type", "vehicle_id", "route_id", "stop_id"]
LOG = "vehicle_id long, type string, route_id long, stop_id long, action string, happened_at timestamp, opened_at timestamp, severity string, reason string"
#: The state store that keeps lists and timers; the session must name it before such a stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _told(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """Findings and resolutions as one table of events; at one instant findings come first."""
    f = found.select(*KEY, "ts", F.lit(0).alias("ends"), "severity")
    return f.unionByName(resolved.select(*KEY, "ts", F.lit(1).alias("ends"), F.lit(None).cast("string").alias("severity")))


_ENTRY = Row(*[part.split()[0] for part in LOG.split(", ")])


class OpenExceptions(StatefulProcessor):
    """Per vehicle, the open exceptions by (type, route, stop): when each opened and was last seen.

    A finding opens what is not open and else only renews it; a resolution closes what is open; what is not seen again for
    ``quiet`` microseconds closes by a timer.
    """

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "name string", "type string, route_id long, stop_id long, opened long, seen long, severity string")

    def _closed(self, vehicle, name: str, at: int, reason: str) -> Row:
        kind, route, stop, opened, _, severity = self.open.getValue((name,))
        self.open.removeKey((name,))
        return _ENTRY(vehicle, kind, route, stop, "close", _instant(at), _instant(opened), severity, reason)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        vehicle = key[0]
        for r in sorted(rows, key=lambda r: (r["micros"], r["ends"], str(r["type"]), str(r["severity"]))):
            name, at = f"{r['type']}|{r['route_id']}|{r['stop_id']}", r["micros"]
            known = self.open.getValue((name,)) if self.open.containsKey((name,)) else None
            if known is not None and at - known[4] > self.quiet:
                yield self._closed(vehicle, name, known[4] + self.quiet, "quiet")
                known = None
            if r["ends"]:
                if known is not None:
                    yield self._closed(vehicle, name, at, "resolved")
                continue
            if known is None:
                yield _ENTRY(vehicle, r["type"], r["route_id"], r["stop_id"], "open", _instant(at), _instant(at), r["severity"], None)
            opened, severity = (at, r["severity"]) if known is None else (known[3], known[5])
            self.open.updateValue((name,), (r["type"], r["route_id"], r["stop_id"], opened, max(at, known[4]) if known else at, severity))
            self.handle.registerTimer((at + self.quiet) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = [(k[0], v[4] + self.quiet) for k, v in self.open.iterator() if v[4] + self.quiet < now]
        for name, at in sorted(due, key=lambda d: (d[1], d[0])):
            yield self._closed(key[0], name, at, "quiet")

    def close(self) -> None:
        pass


def _instant(micros: int):
    return datetime.datetime.fromtimestamp(micros // 1_000_000, datetime.UTC).replace(microsecond=micros % 1_000_000)


def stream_openings(found: DataFrame, resolved: DataFrame, quiet_minutes: int = 240, late: str = "10 minutes") -> DataFrame:
    """Openings and closings (``LOG``) of a stream of findings (type, vehicle_id, route_id, stop_id, ts, severity) and one of resolutions (the same without severity).

    State is a vehicle's open exceptions, so it grows with what is open and not with what has been. Events of one micro-batch are taken in order of time; what comes
    later than ``late`` behind its stream's newest event is dropped by the watermark before the state sees it. The session needs ``STORE``.
    """
    ship_package(found.sparkSession)
    events = _told(found.withWatermark("ts", late), resolved.withWatermark("ts", late)).withColumn("micros", F.unix_micros("ts"))
    return events.groupBy("vehicle_id").transformWithState(OpenExceptions(quiet_minutes * 60_000_000), StructType.fromDDL(LOG), "Append", "EventTime")


def openings(found: DataFrame, resolved: DataFrame, quiet_minutes: int = 240, until: str | None = None) -> DataFrame:
    """The same log of whole tables: what ``stream_openings`` gives once its watermark has passed ``until`` (without it, nothing closes at the end by itself)."""
    quiet = quiet_minutes * 60_000_000
    w = Window.partitionBy(*KEY).orderBy("micros", "ends")
    events = _told(found, resolved).withColumn("micros", F.unix_micros("ts"))
    first = events.groupBy(*KEY, "micros", "ends").agg(F.min("ts").alias("ts"), F.min("severity").alias("severity"))
    seen = first.withColumns({"_before": F.lag("micros").over(w), "_ended": F.lag("ends").over(w), "_next": F.lead("micros").over(w)})
    alive = (F.col("_ended") == 0) & (F.col("micros") - F.col("_before") <= quiet)
    seen = seen.withColumn("_alive", F.coalesce(alive, F.lit(False)))
    opens = (F.col("ends") == 0) & ~F.col("_alive")
    # the finding that opened what each event belongs to
    seen = seen.withColumns({"_opened": F.last(F.when(opens, F.col("micros")), ignorenulls=True).over(w), "_severity": F.last(F.when(opens, F.struct("severity")), ignorenulls=True).over(w)["severity"]})
    end = F.lit(until).cast("timestamp") if until else F.lit(None).cast("timestamp")
    quiet_end = F.col("micros") + quiet
    lapses = (F.col("ends") == 0) & F.coalesce(F.col("_next") > quiet_end, F.unix_micros(end) > quiet_end, F.lit(False))
    entry = lambda when, action, at, reason: F.when(when, F.struct(F.lit(action).alias("action"), F.timestamp_micros(at).alias("happened_at"), F.lit(reason).alias("reason")))
    log = F.array(entry(opens, "open", F.col("micros"), None), entry((F.col("ends") == 1) & F.col("_alive"), "close", F.col("micros"), "resolved"), entry(lapses, "close", quiet_end, "quiet"))
    told = seen.withColumn("e", F.explode(F.filter(log, lambda e: e.isNotNull())))
    return told.select("vehicle_id", "type", "route_id", "stop_id", "e.action", "e.happened_at", F.timestamp_micros("_opened").alias("opened_at"), F.col("_severity").alias("severity"), F.col("e.reason").cast("string").alias("reason"))
