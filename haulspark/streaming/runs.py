"""Streams run until their files are read, and sinks for live screens."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.operators.relational import top_rows
from haulspark.sources import tables as t
from haulspark.sources.shared import shared_root
from haulspark.streaming.openings import STORE, stream_openings
from haulspark.streaming.telematics import counted_by_hour, stream_exceptions


def run_to_the_end(stream: DataFrame, name: str) -> DataFrame:
    """What a stream in append mode gives for all there is to read, as a Parquet table in the shared folder."""
    folder = f"{shared_root(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def publish(stream: DataFrame, company: str, send: Callable[[str, list[dict]], None], folder: str, most: int = 1000):
    """A live sink: each micro-batch's newest rows (at most ``most`` a company, as a screen shows no more) are sent once a company.

    ``folder`` keeps the stream's place; a batch that is tried again is sent again.
    """

    def each(batch: DataFrame, _: int) -> None:
        rows = top_rows(batch.select(company, "ts", F.to_json(F.struct(*batch.columns)).alias("row")), [company], [F.col("ts").desc(), F.col("row").desc()], most)
        newest = rows.groupBy(company).agg(F.sort_array(F.collect_list(F.struct("ts", "row")), asc=False).alias("rows"))
        for r in newest.toLocalIterator():
            send(r[company], [x["row"] for x in r["rows"]])

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", folder).outputMode("append")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.select(
        "event_id", F.col("user_id").alias("vehicle_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("speed"),
        (44.0 + (F.col("event_id") * 37 % 1000) / 10000.0).alias("lat"), (26.0 + (F.col("event_id") * 91 % 1000) / 10000.0).alias("lon"),
    )


def exceptions_to_the_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions of the events as a stream."""
    return run_to_the_end(stream_exceptions(_samples(spark, sf_dir), t.vehicle_stops(spark, sf_dir), t.vehicle_plan(spark, sf_dir)), "exceptions")


def hours_to_the_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples an hour of the events as a stream; the last hours, which the watermark has not passed, are not given out."""
    return run_to_the_end(counted_by_hour(_samples(spark, sf_dir)), "hours")


def speeding(samples: DataFrame) -> DataFrame:
    """Findings of samples that are too fast."""
    none = F.lit(None).cast("long")
    return samples.where("speed > 90").select(F.lit("viteza").alias("type"), "vehicle_id", none.alias("route_id"), none.alias("stop_id"), "ts", F.when(F.col("speed") > 110, "critical").otherwise("warning").alias("severity"))


def resolutions(samples: DataFrame) -> DataFrame:
    """An office that half an hour after every fifth sample resolves what its vehicle has open of two types."""
    none = F.lit(None).cast("long")
    kinds = F.explode(F.array(F.lit("viteza"), F.lit("stationare")))
    return samples.where("event_id % 5 = 0").select(kinds.alias("type"), "vehicle_id", none.alias("route_id"), none.alias("stop_id"), (F.col("ts") + F.expr("interval 30 minutes")).alias("ts"))


def openings_to_the_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings and closings of speeding on the events as a stream, and of their resolutions as another."""
    spark.conf.set(*STORE)
    samples = _samples(spark, sf_dir)
    return run_to_the_end(stream_openings(speeding(samples), resolutions(samples)), "openings")
