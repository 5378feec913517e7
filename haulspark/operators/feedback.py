"""How often people correct what was read: by routing, field, rule and operator, and where thresholds should lie."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.operators.documents import READ
from haulspark.operators.relational import top_rows

# Documents and documents of a routing from which something is suggested, and shares above which it is.
MIN_DOCS, MIN_ROUTED = 10, 5
FIELD_HOT, NOISE_HOT, MISS_HOT, RULE_HOT = 0.3, 0.7, 0.15, 0.5
ROUTINGS = ("auto", "hitl_optional", "hitl_required")
EXAMPLES = 3


def share(a: Column, b: Column) -> Column:
    """``a / b`` to three places; null if there is nothing to divide by."""
    return F.when(b != 0, F.floor(a / b * 1000 + 0.5) / 1000)


def _changes(events: DataFrame, documents: DataFrame) -> DataFrame:
    """A row a change of a field that is read, with whether its document was read in the window."""
    told = events.select("document_id", "event_id", "operator", F.posexplode("changes").alias("pos", "c")).select("document_id", "event_id", "operator", "pos", "c.*").where(F.col("field").isin(*READ))
    return told.join(documents.select(F.col("id").alias("document_id"), F.lit(True).alias("inside")), "document_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def overview(events: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: documents of the window, those touched in it and of other windows, corrections inside and outside, and their rates.

    ``events`` (document_id, event_id, operator, changes: array of field, old_value, new_value) are those of the window, whatever document they
    correct; ``documents`` (id, routing, failed_rules) are those that were read in it. Changes of fields that are not read do not count.
    """
    c = _changes(events, documents)
    inside = F.col("inside")
    counts = c.agg(
        F.count_distinct(F.when(inside, F.col("document_id"))).alias("touched"), F.count_distinct(F.when(~inside, F.col("document_id"))).alias("touched_outside"), F.count_if(inside).alias("corrections"), F.count_if(~inside).alias("corrections_outside"),
    )
    both = documents.agg(F.count("*").alias("total")).crossJoin(counts)  # one row each
    return both.withColumns({"touch_rate": share(F.col("touched"), F.col("total")), "corrections_per_touched": share(F.col("corrections"), F.col("touched"))})


def by_routing(events: DataFrame, documents: DataFrame) -> DataFrame:
    """``routing, total, touched, touch_rate`` of every routing, those without documents too; what is no routing is unknown."""
    touched = _changes(events, documents).where("inside").select(F.col("document_id").alias("id")).distinct().withColumn("t", F.lit(1))
    kind = F.when(F.col("routing").isin(*ROUTINGS), F.col("routing")).otherwise("unknown")
    counts = documents.join(touched, "id", "left").groupBy(kind.alias("routing")).agg(F.count("*").alias("total"), F.count("t").alias("touched"))
    every = documents.sparkSession.createDataFrame([(r,) for r in (*ROUTINGS, "unknown")], "routing string")
    return every.join(counts, "routing", "left").select("routing", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "touched")]).withColumn("touch_rate", share(F.col("touched"), F.col("total")))


def by_field(events: DataFrame, documents: DataFrame) -> DataFrame:
    """``field, corrections, documents, doc_rate, edit_rate, examples``: corrections of documents of the window; up to three first examples (from > to)."""
    c = _changes(events, documents).where("inside")
    total = documents.agg(F.count("*").alias("total"))
    counts = c.groupBy("field").agg(F.count("*").alias("corrections"), F.count_distinct("document_id").alias("documents"))
    shown = top_rows(c.where("old_value is not null or new_value is not null"), ["field"], [F.col("event_id"), F.col("pos")], EXAMPLES)
    pair = F.concat(F.coalesce("old_value", F.lit("")), F.lit(" > "), F.coalesce("new_value", F.lit("")))
    examples = shown.groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "pos", pair.alias("p")))), lambda e: e["p"]), "; ").alias("examples"))
    told = counts.join(examples, "field", "left").crossJoin(F.broadcast(total))  # of one row
    return told.select("field", "corrections", "documents", share(F.col("documents"), F.col("total")).alias("doc_rate"), share(F.col("corrections"), F.col("total")).alias("edit_rate"), F.coalesce("examples", F.lit("")).alias("examples"))


def by_rule(documents: DataFrame) -> DataFrame:
    """``rule, documents, doc_rate``: how often each rule failed, once for every time that a document names it."""
    total = documents.agg(F.count("*").alias("total"))
    counts = documents.select(F.explode("failed_rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("documents"))
    return counts.crossJoin(F.broadcast(total)).select("rule", "documents", share(F.col("documents"), F.col("total")).alias("doc_rate"))


def by_operator(events: DataFrame, documents: DataFrame) -> DataFrame:
    """``operator, corrections`` of documents of the window; what no one signed counts for no one."""
    return _changes(events, documents).where("inside and operator is not null").groupBy("operator").agg(F.count("*").alias("corrections"))


def suggestions(events: DataFrame, documents: DataFrame) -> DataFrame:
    """``kind, subject, rate`` of what should be looked at: fields corrected often, optional reviews that change nothing, automatic ones that were wrong, rules that fail on most.

    Nothing is suggested of fewer than ``MIN_DOCS`` documents, nor of a routing with fewer than ``MIN_ROUTED``.
    """
    enough = documents.agg(F.count("*").alias("total")).where(F.col("total") >= MIN_DOCS).select(F.lit(1).alias("ok"))
    routed = by_routing(events, documents).where(F.col("total") >= MIN_ROUTED)
    idle = 1 - F.col("touch_rate")
    parts = [
        by_field(events, documents).where(F.col("doc_rate") > FIELD_HOT).select(F.lit("field_hot").alias("kind"), F.col("field").alias("subject"), F.col("doc_rate").alias("rate")),
        routed.where((F.col("routing") == "hitl_optional") & (idle > NOISE_HOT)).select(F.lit("noise"), "routing", F.round(idle, 3)),
        routed.where((F.col("routing") == "auto") & (F.col("touch_rate") > MISS_HOT)).select(F.lit("miss"), "routing", "touch_rate"),
        by_rule(documents).where(F.col("doc_rate") > RULE_HOT).select(F.lit("rule_hot"), "rule", "doc_rate"),
    ]
    return reduce(DataFrame.union, parts).crossJoin(F.broadcast(enough)).drop("ok")  # a row or none


def threshold_sweep(read: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``field, threshold, above, missed, below, needless`` for each of ``thresholds``: what it would let through, how much of that was corrected, what it would hold, and how much of that was right.

    ``read`` (field, confidence, corrected) has a row a value that was read. Values are counted between thresholds once; sums over the few counts give every threshold.
    """
    steps = sorted(thresholds)
    bucket = reduce(Column.__add__, [(F.col("confidence") >= t).cast("int") for t in steps])
    counts = read.where("confidence is not null").groupBy("field", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("corrected").alias("bad"))
    every = counts.select("field").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(len(steps)))))
    full = every.join(counts, ["field", "bucket"], "left").fillna(0, ["n", "bad"])
    w = Window.partitionBy("field")
    upto = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = full.select("field", "bucket", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_low") for c in ("n", "bad")], *[F.sum(c).over(w).alias(f"{c}_all") for c in ("n", "bad")]).where("bucket > 0")
    threshold = F.element_at(F.array(*[F.lit(float(t)) for t in steps]), F.col("bucket"))
    return summed.select("field", threshold.alias("threshold"), (F.col("n_all") - F.col("n_low")).alias("above"), (F.col("bad_all") - F.col("bad_low")).alias("missed"), F.col("n_low").alias("below"), (F.col("n_low") - F.col("bad_low")).alias("needless"))
