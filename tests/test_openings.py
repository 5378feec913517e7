"""Openings and closings on a stream, over a restart too, against the batch and against a loop over the events."""

import datetime

import pytest

from haulspark.streaming.openings import STORE, openings, stream_openings

T0 = datetime.datetime(2026, 3, 1, 8, 0)
FOUND = "type string, vehicle_id long, route_id long, stop_id long, ts timestamp, severity string"
DONE = "type string, vehicle_id long, route_id long, stop_id long, ts timestamp"
BIG = 2**53 + 1


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


FINDINGS = [
    ("viteza", 1, None, None, at(0), "warning"), ("viteza", 1, None, None, at(10), "critical"), ("viteza", 1, None, None, at(40), "warning"), ("viteza", 1, None, None, at(200), "info"),
    ("intarziere", 1, 7, BIG, at(5), "warning"), ("intarziere", 1, 7, BIG + 1, at(5), "warning"), ("viteza", 2, None, None, at(3), "warning"), ("viteza", 2, None, None, at(3), "warning"), ("stationare", 2, 9, None, at(100), None), ("viteza", 1, None, None, at(500), "warning"), ("viteza", 9, None, None, at(501), "warning"),
]
RESOLVED = [("viteza", 1, None, None, at(20)), ("viteza", 1, None, None, at(25)), ("intarziere", 1, 7, BIG, at(30)), ("viteza", 3, None, None, at(9)), ("stationare", 2, 9, None, at(100))]


def by_hand(found, resolved, quiet, until):
    events = sorted([(r[4], 0, r) for r in found] + [(r[4], 1, r) for r in resolved], key=lambda e: (e[0], e[1], str(e[2])))
    open_, out, pause = {}, [], datetime.timedelta(minutes=quiet)

    def close(key, when, reason):
        opened, _, severity = open_.pop(key)
        out.append((key[1], key[0], key[2], key[3], "close", when, opened, severity, reason))

    for now, ends, r in events:
        key = r[:4]
        if key in open_ and now - open_[key][1] > pause:
            close(key, open_[key][1] + pause, "quiet")
        if ends:
            if key in open_:
                close(key, now, "resolved")
        elif key in open_:
            open_[key][1] = now
        else:
            open_[key] = [now, now, r[5]]
            out.append((key[1], key[0], key[2], key[3], "open", now, now, r[5], None))
    for key in [k for k, v in open_.items() if v[1] + pause < until]:
        close(key, open_[key][1] + pause, "quiet")
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("quiet", [60, 10_000])
def test_batch_is_the_loop(spark, quiet):
    got = openings(spark.createDataFrame(FINDINGS, FOUND), spark.createDataFrame(RESOLVED, DONE), quiet, str(at(490)))
    assert rows(got) == by_hand(FINDINGS, RESOLVED, quiet, at(490))


def test_stream_is_the_batch_over_a_restart(spark, tmp_path):
    """Three runs from one checkpoint, each finding new files; what opened in one run is renewed and closed in another."""
    spark.conf.set(*STORE)
    place = f"file://{tmp_path}"

    def run():
        found = spark.readStream.schema(FOUND).parquet(f"{place}/found")
        done = spark.readStream.schema(DONE).parquet(f"{place}/done")
        stream_openings(found, done, 60).writeStream.format("parquet").option("path", f"{place}/log").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for lo, hi in ((-1, 8), (8, 60), (60, 1000)):
        some = lambda table, lo=lo, hi=hi: [r for r in table if at(lo) <= r[4] < at(hi)]
        spark.createDataFrame(some(FINDINGS), FOUND).coalesce(1).write.mode("append").parquet(f"{place}/found")
        spark.createDataFrame(some(RESOLVED), DONE).coalesce(1).write.mode("append").parquet(f"{place}/done")
        run()
    got = rows(spark.read.parquet(f"{place}/log").select("vehicle_id", "type", "route_id", "stop_id", "action", "happened_at", "opened_at", "severity", "reason"))
    # both streams' watermarks count: the resolutions end at 100 minutes, so nothing after 90 has closed by itself
    assert got == by_hand(FINDINGS, RESOLVED, 60, at(90))


def test_no_events(spark):
    none = spark.createDataFrame([], FOUND)
    assert openings(none, spark.createDataFrame([], DONE)).count() == 0 and openings(none, spark.createDataFrame(RESOLVED, DONE)).count() == 0
