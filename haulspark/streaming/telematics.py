"""Vehicle exceptions on a stream: the batch rules, with the idle clock kept a vehicle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from haulspark.operators.telematics import AT_STOP, IDLE_SPEED, exceptions_of, nearest_stop
from haulspark.sources.shipping import ship_package

#: What the clock reads and gives back, and no more: times as whole microseconds, for a frame a vehicle makes each column cost, and one of timestamps most.
_READ = ["event_id", "vehicle_id", "micros", "speed", "lat", "lon", "stop_m"]
_OUT = "event_id long, vehicle_id long, micros long, speed double, lat double, lon double, stop_m double, idle_min double"


def _idle_clock(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adds ``idle_min``; the state is the instant, in microseconds, since when the vehicle stands away from stops. A sample without a time does not move the clock."""
    since = state.get[0] if state.exists else None
    parts = list(batches)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    micros, metres = rows["micros"].to_numpy(), rows["stop_m"].to_numpy(np.float64, na_value=np.nan)
    idle = (rows["speed"].to_numpy(np.float64, na_value=np.nan) <= IDLE_SPEED) & ~(metres <= AT_STOP)
    minutes = np.full(len(rows), np.nan)
    for i in np.lexsort((rows["event_id"].to_numpy(), micros)).tolist():
        now = micros[i]
        if now != now:
            continue
        if idle[i]:
            since = int(now) if since is None else since
            minutes[i] = (int(now) - since) / 60_000_000
        else:
            since = None
    if since is None:
        if state.exists:
            state.remove()
    else:
        state.update((since,))
    rows["idle_min"] = minutes
    yield rows


def stream_exceptions(positions: DataFrame, stops: DataFrame, plan: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Exceptions of a stream of positions (event_id, vehicle_id, ts, speed, lat, lon) against static tables of stops and of next stops (``next_open_stops``).

    A watermark of ``late`` on ``ts`` is our addition. The joins are stream to static; state is one instant a vehicle.
    Samples of one micro-batch are taken in order of time, those of one vehicle in one call.
    """
    ship_package(positions.sparkSession)
    placed = nearest_stop(positions.withWatermark("ts", late), stops).withColumn("micros", F.unix_micros("ts"))
    clocked = placed.select(*_READ).groupBy("vehicle_id").applyInPandasWithState(_idle_clock, _OUT, "since long", "append", GroupStateTimeout.NoTimeout)
    # frames have no nulls but NaN
    known = clocked.withColumns({"ts": F.timestamp_micros("micros"), "stop_m": F.nanvl("stop_m", F.lit(None)), "idle_min": F.nanvl("idle_min", F.lit(None))})
    return exceptions_of(known.join(plan, "vehicle_id", "left"))


def counted_by_hour(positions: DataFrame, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """``start, n, fastest`` of the samples of each hour (every ``slide``, if given); a window is given out once the watermark has passed it, and what comes later is dropped."""
    window = F.window("ts", "1 hour", slide) if slide else F.window("ts", "1 hour")
    return positions.withWatermark("ts", late).groupBy(window).agg(F.count("*").alias("n"), F.max("speed").alias("fastest")).select(F.col("window.start").alias("start"), "n", "fastest")


def stream_latest(positions: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """The newest sample of each vehicle, for a sink in update mode."""
    return positions.groupBy(key).agg(F.max(F.struct("ts", "event_id", "speed", "lat", "lon")).alias("p")).select(key, "p.*")
