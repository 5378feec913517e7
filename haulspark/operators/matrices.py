"""Distance matrices of which a cache holds a part: what still has to be asked, and in which rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.operators.office import matrix_misses

#: Share of all cells above which one request for everything is cheaper than several for parts.
WHOLE_FROM = 0.6


def fetch_plan(points: DataFrame, cache: DataFrame, now: str, matrix: str = "matrix_id") -> DataFrame:
    """``matrix, hits, misses, fetch_no, rows, cols`` of the rectangles that cover every missing cell of each matrix; one row without a rectangle where nothing is missing.

    ``points`` (matrix, idx from 0, node_key: null if the point is not yet placed on the graph), ``cache`` (from_key, to_key, expires_at). A point that is not placed misses against all others both ways: two thin
    rectangles. Pairs of placed points that the cache lacks are one small rectangle of their rows and columns. Several rectangles that make up more than
    ``WHOLE_FROM`` of the matrix are asked as one. A matrix's cells are its points squared, as they are where it is measured.
    """
    placed = points.where("node_key is not null").select(matrix, "idx", "node_key")
    other = placed.select(matrix, F.col("idx").alias("to_idx"), F.col("node_key").alias("to_key"))
    cells = placed.select(matrix, "idx", F.col("node_key").alias("from_key")).join(other, matrix).where("idx <> to_idx")
    lacking = matrix_misses(cells.select("from_key", "to_key"), cache, now).withColumn("lacks", F.lit(True))
    told = cells.join(lacking, ["from_key", "to_key"], "left").withColumn("lacks", F.coalesce("lacks", F.lit(False)))
    by_cell = told.groupBy(matrix).agg(
        F.count_if(~F.col("lacks")).alias("hits"), F.count_if("lacks").alias("apart"),
        F.array_sort(F.collect_set(F.when(F.col("lacks"), F.col("idx")))).alias("late_rows"), F.array_sort(F.collect_set(F.when(F.col("lacks"), F.col("to_idx")))).alias("late_cols"),
    )
    sides = points.groupBy(matrix).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("idx")).alias("all"), F.array_sort(F.collect_list(F.when(F.col("node_key").isNull(), F.col("idx")))).alias("new"), F.array_sort(F.collect_list(F.when(F.col("node_key").isNotNull(), F.col("idx")))).alias("known"),
    )
    none = F.array().cast("array<int>")
    both = sides.join(by_cell, matrix, "left").withColumns({"late_rows": F.coalesce("late_rows", none), "late_cols": F.coalesce("late_cols", none)})
    rectangle = lambda rows, cols: F.when((F.size(rows) > 0) & (F.size(cols) > 0), F.struct(F.col(rows).alias("rows"), F.col(cols).alias("cols")))
    parts = F.filter(F.array(rectangle("new", "all"), rectangle("known", "new"), rectangle("late_rows", "late_cols")), lambda r: r.isNotNull())
    both = both.withColumn("parts", parts)
    cost = F.aggregate("parts", F.lit(0).cast("long"), lambda s, r: s + F.size(r["rows"]).cast("long") * F.size(r["cols"]))
    whole = (F.size("parts") > 1) & (cost > WHOLE_FROM * F.col("n") * F.col("n"))
    planned = both.withColumn("plan", F.when(whole, F.array(F.struct(F.col("all").alias("rows"), F.col("all").alias("cols")))).otherwise(F.col("parts")))
    misses = F.size("new") * (F.col("n") - 1) + F.size("known") * F.size("new") + F.coalesce("apart", F.lit(0))
    out = planned.select(matrix, F.coalesce("hits", F.lit(0)).alias("hits"), misses.alias("misses"), F.posexplode_outer("plan").alias("at", "r"))
    return out.select(matrix, "hits", "misses", (F.col("at") + 1).alias("fetch_no"), F.array_join("r.rows", ",").alias("rows"), F.array_join("r.cols", ",").alias("cols"))
