"""Notices that the office's tables give rise to: papers that run out, trips without a driver; kept for five minutes, dismissed by the office."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.operators.relational import top_rows
from haulspark.sources.shared import shared_root

# Papers and what they are called, days ahead that are looked at, trips told of, and seconds that notices are kept.
VEHICLE_PAPERS = {"itp_expiry": "ITP", "rca_expiry": "RCA", "rovinieta_expiry": "ROVINIETA", "casco_expiry": "CASCO"}
DRIVER_PAPERS = {"license_expiry": "Permis", "medical_certificate_expiry": "Medical", "tachograph_card_expiry": "Tahograf"}
HORIZON, MOST_TRIPS, KEPT_SECONDS = 30, 10, 300
_NOTICE = ("company_id", "key", "kind", "title", "message", "link", "trip_id")


def horizons(companies: DataFrame) -> DataFrame:
    """``company_id, days``: how far ahead each company looks, the most of the days that its JSON settings list as ``document_expiry_days``; without a positive one, ``HORIZON``."""
    told = F.from_json("settings", "document_expiry_days array<string>")["document_expiry_days"]
    days = F.filter(F.transform(told, lambda d: d.try_cast("double")), lambda d: d > 0)
    return companies.select("company_id", F.coalesce(F.array_max(days), F.lit(HORIZON)).cast("int").alias("days"))


def _papers(rows: DataFrame, ahead: DataFrame, papers: dict[str, str], name: Column, link: str, now: Column) -> DataFrame:
    """A notice a paper of an active row that has run out or will within its company's horizon; its key names the row and the day, not the row's name."""
    day = now.cast("date")
    each = F.explode(F.array(*[F.struct(F.lit(label).alias("paper"), F.col(c).cast("date").alias("ends")) for c, label in papers.items()]))
    due = rows.where("is_active").join(ahead, "company_id", "left").withColumn("days", F.coalesce("days", F.lit(HORIZON))).select("company_id", "id", name.alias("name"), "days", each.alias("p")).select("company_id", "id", "name", "days", "p.*")
    due = due.where(F.col("ends") <= F.date_add(day, F.col("days")))
    over = F.col("ends").cast("timestamp") < now
    return due.select(
        "company_id", F.concat_ws(":", F.lit("computed:document_expiry"), "paper", F.col("id").cast("string"), F.date_format("ends", "yyyy-MM-dd")).alias("key"), F.lit("document_expiry").alias("kind"),
        F.concat_ws(" ", "paper", F.when(over, "expirat").otherwise("expiră curând")).alias("title"), F.concat(F.col("name"), F.lit(", "), F.when(over, "expirat").otherwise("expiră"), F.lit(" "), F.date_format("ends", "dd.MM.yyyy")).alias("message"),
        F.lit(link).alias("link"), F.lit(None).cast("long").alias("trip_id"),
    )


def computed_notices(vehicles: DataFrame, drivers: DataFrame, trips: DataFrame, companies: DataFrame, now: str) -> DataFrame:
    """``company_id, key, kind, title, message, link, trip_id`` of all companies at ``now``.

    ``vehicles`` (company_id, id, brand, model, plate, is_active and the dates of ``VEHICLE_PAPERS``), ``drivers`` (company_id, id, name, is_active and those of ``DRIVER_PAPERS``), ``trips`` (company_id, id, status,
    driver_id, cmr_number, created_at), of which the newest ten a company that are planned and have no driver are told; ``companies`` (company_id, settings).
    """
    at, ahead = F.lit(now).cast("timestamp"), horizons(companies)
    label = F.concat(F.coalesce("brand", F.lit("")), F.lit(" "), F.coalesce("model", F.lit("")), F.lit(" ("), F.coalesce("plate", F.lit("")), F.lit(")"))
    waiting = top_rows(trips.where("status = 'planificata' and driver_id is null"), ["company_id"], [F.col("created_at").desc(), F.col("id").desc()], MOST_TRIPS)
    unassigned = waiting.select(
        "company_id", F.concat(F.lit("computed:unassigned:"), F.col("id").cast("string")).alias("key"), F.lit("trip_unassigned").alias("kind"), F.concat(F.lit("Cursă nealocată, "), F.coalesce(F.nullif("cmr_number", F.lit("")), F.lit("CMR"))).alias("title"),
        F.lit("Cursa este în așteptare. Alocă un șofer și vehicul.").alias("message"), F.concat(F.lit("/trips/"), F.col("id").cast("string")).alias("link"), F.col("id").cast("long").alias("trip_id"),
    )
    return _papers(vehicles, ahead, VEHICLE_PAPERS, label, "/vehicles", at).unionByName(_papers(drivers, ahead, DRIVER_PAPERS, F.col("name"), "/drivers", at)).unionByName(unassigned)


def kept(spark: SparkSession, name: str, now_seconds: int, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gave within the same ``KEPT_SECONDS``, as a table a slice of time in the shared folder; worked out and written if no table of the slice is whole."""
    path = f"{shared_root(spark)}/{name}/slice={now_seconds // KEPT_SECONDS}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def with_state(notices: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Notices with ``is_read``, without those that the office has deleted (``dismissals``: company_id, key, read_at, dismissed_at, deleted_at)."""
    state = dismissals.select("company_id", "key", (F.col("read_at").isNotNull() | F.col("dismissed_at").isNotNull()).alias("_read"), F.col("deleted_at").isNotNull().alias("_gone"))
    return notices.join(state, ["company_id", "key"], "left").where(~F.coalesce("_gone", F.lit(False))).select(*_NOTICE, F.coalesce("_read", F.lit(False)).alias("is_read"))


def marked_read(dismissals: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    """``dismissals`` after ``keys`` (company_id, key) were read: what was deleted comes back as read, what is new is added."""
    at = F.lit(now).cast("timestamp")
    read = keys.where("key is not null").select("company_id", "key").distinct().select("company_id", "key", at.alias("read_at"), at.alias("dismissed_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return dismissals.join(read.select("company_id", "key"), ["company_id", "key"], "left_anti").select("company_id", "key", "read_at", "dismissed_at", "deleted_at").unionByName(read)


def cleared(dismissals: DataFrame, company: Column, now: str) -> DataFrame:
    """``dismissals`` after a company cleared what it has read: each is deleted at ``now``, unless it was before."""
    done = company & (F.col("read_at").isNotNull() | F.col("dismissed_at").isNotNull()) & F.col("deleted_at").isNull()
    return dismissals.withColumn("deleted_at", F.when(done, F.lit(now).cast("timestamp")).otherwise(F.col("deleted_at")))
