"""Reports: projected templates, totals, warnings, run identities and duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions.numeric import exact_sum, half_up
from haulspark.operators.relational import numbered

#: Sources whose zero means that nothing was entered.
ZERO_IS_UNSET = ("valoare_tpo", "taxe_suplimentare", "km_parcursi", "tarif_km")


def project(rows: DataFrame, template: Sequence[Mapping[str, str | None]], order: Sequence[Column]) -> DataFrame:
    """Columns of ``template`` (key, source, default) from ``rows``, numbered in ``order``; dates as ``dd.MM.yyyy``.

    A blank cell takes the default, as does a zero of certain sources whose default is not zero.
    """
    kinds = dict(rows.dtypes)

    def cell(column: Mapping[str, str | None]) -> Column:
        source, default = column["source"], F.lit(column.get("default"))
        value = F.date_format(source, "dd.MM.yyyy") if kinds[source] == "date" else F.col(source).cast("string")
        blank = F.coalesce(F.trim(value), F.lit("")) == ""
        if source in ZERO_IS_UNSET:
            blank = blank | ((F.col(source) == 0) & default.isNotNull())
        return F.when(blank, default).otherwise(value).alias(column["key"])

    return numbered(rows, order, "_row").select(F.col("_row").alias("row_no"), *[cell(c) for c in template])


def tonnes(gross_kg: Column) -> Column:
    """Kilograms as tonnes with two decimals; null unless positive."""
    return F.when(gross_kg > 0, half_up(gross_kg / 1000, 2))


def report_totals(rows: DataFrame, additive: Sequence[str]) -> DataFrame:
    """``source, total, counted, missing`` of the additive columns; those without any value are left out."""
    parts = rows.agg(*[exact_sum(F.col(c)).alias(f"{c}_s") for c in additive], *[F.count(c).alias(f"{c}_n") for c in additive], F.count("*").alias("_all"))
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("source"), half_up(F.col(f"{c}_s"), 4).alias("total"), F.col(f"{c}_n").alias("counted"), (F.col("_all") - F.col(f"{c}_n")).alias("missing")) for c in additive]))
    return parts.select(one.alias("t")).select("t.*").where("counted > 0")


def report_warnings(rows: DataFrame, rules: Mapping[str, Column], id_col: str, most_ids: int = 50) -> DataFrame:
    """``rule, n, ids`` of the rules that any row breaks, with the smallest ids; one pass over the rows for all rules.

    Only rows that break a rule are moved, and of those each task's smallest ids a rule.
    """
    broken = F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda r: r.isNotNull()))
    found = rows.select(F.col(id_col).alias("id"), broken.alias("rule"))
    counts = found.groupBy("rule").agg(F.count("*").alias("n"))
    ranked = found.distinct().withColumn("k", F.row_number().over(Window.partitionBy("rule").orderBy("id"))).where(F.col("k") <= most_ids)
    ids = ranked.groupBy("rule").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return counts.join(ids, "rule")


#: Sources of a template that hold a weighed figure.
WEIGHTS = ("gross_weight_kg", "greutate_bruta_kg", "greutate_bruta_tone")


def document_warnings(docs: DataFrame, sources: Sequence[str], most_ids: int = 50) -> DataFrame:
    """``rule, n, ids`` of what a person should know before documents leave by a template with columns from ``sources``.

    Documents have id, status, needs_review, numar_tpo, data_efectuare_cursa, data_facturare, gross_weight_kg and ``consignment``, what one is told by.
    Nine rules: not confirmed, unchecked fields, no order, no day, no day of invoice, no weight behind a quantity, no weight in a column of weights, a weight
    that no column shows, one consignment more than once in an order.
    """
    c, has = F.col, set(sources)
    blank = lambda name: F.coalesce(F.trim(c(name).cast("string")), F.lit("")) == ""
    no = F.lit(False)
    twins = docs.where(~blank("numar_tpo")).groupBy(F.lower(F.trim("numar_tpo")).alias("_o"), F.col("consignment").alias("_c")).agg(F.count("*").alias("_n")).where("_n > 1")
    told = docs.withColumn("_k", F.lower(F.trim("numar_tpo"))).join(twins, (c("_k") == c("_o")) & c("consignment").eqNullSafe(c("_c")), "left")
    weights = bool(has & set(WEIGHTS))
    rules = {
        "not_confirmed": ~F.coalesce(c("status"), F.lit("")).isin("", "confirmed"),
        "needs_review": c("needs_review"),
        "missing_tpo": blank("numar_tpo") if "numar_tpo" in has else no,
        "missing_date": blank("data_efectuare_cursa") if "data_efectuare_cursa" in has else no,
        "missing_invoice_date": blank("data_facturare") if "data_facturare" in has else no,
        "missing_quantity_weight": c("gross_weight_kg").isNull() if "cantitate_marfa" in has else no,
        "missing_gross_weight": c("gross_weight_kg").isNull() if weights else no,
        "weight_not_exported": c("gross_weight_kg").isNotNull() if not weights and "cantitate_marfa" not in has else no,
        "duplicate_tpo": c("_n").isNotNull(),
    }
    return report_warnings(told, rules, "id", most_ids)


def run_identity(trip: Column, day: Column, plate: Column, row_id: Column) -> Column:
    """What makes rows one run: the trip, else day and plate, else the row alone."""
    clean = F.regexp_replace(F.upper(F.coalesce(plate, F.lit(""))), "[^A-Z0-9/]", "")
    date = F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("_"))
    return F.when(trip.isNotNull(), F.concat(F.lit("trip:"), trip.cast("string"))).when(clean != "", F.concat(date, F.lit("|"), clean)).otherwise(F.concat(date, F.lit("|id:"), row_id.cast("string")))


def distinct_runs(rows: DataFrame, group: str, identity: str) -> DataFrame:
    """Each row with the number of distinct runs of its group: counted once a group and joined back."""
    counts = rows.groupBy(group).agg(F.count_distinct(identity).alias("n_runs"))
    return rows.join(counts, group, "left")


def flag_duplicates(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``is_duplicate`` where another row of the same group (not blank) has the same key."""
    name = F.nullif(F.lower(F.trim(F.col(group).cast("string"))), F.lit(""))
    counts = rows.select(name.alias("_g"), F.col(key).alias("_k")).where("_g is not null").groupBy("_g", "_k").agg(F.count("*").alias("_n")).where("_n > 1")
    joined = rows.withColumn("_g0", name).join(counts, (F.col("_g0") == F.col("_g")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.withColumn("is_duplicate", F.col("_n").isNotNull()).drop("_g0", "_g", "_k", "_n")
