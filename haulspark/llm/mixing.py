"""Mixing sources to target weights by entropy balancing (operator 2)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulspark.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Newton steps end when every source's words are this near their target, relative to it.
CLOSE = 1e-11
#: Bisection alone halves an interval below that long before.
MOST_STEPS = 200


def _with_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``weights`` dealt in turn to the sources by code point, null last; no task sees more than its range of them."""
    ordered = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    schema = T.StructType([*sources.schema.fields, T.StructField("weight", T.DoubleType())])
    cycle = [float(w) for w in weights]
    return sources.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], cycle[x[1] % len(cycle)])), schema)


def _level(sources: DataFrame, limit: float) -> float:
    """Words a unit of weight gets once no target is above ``limit`` times its source; sums alone come here."""
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    after = total / sources.agg(F.sum("weight")).first()[0]
    while after != level:
        level = after
        above = F.col("weight") * level > limit * F.col("source_size")
        full, free = sources.agg(F.sum(F.when(above, limit * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if not free:
            break
        after = max(level, (total - (full or 0)) / free)
    return level


def tilt(multiplier: Column, scaled: Column, limit: float) -> Column:
    """A document's rate: its base rate of 1 tilted exponentially by its scaled size, ``limit`` at most."""
    return F.least(F.exp(F.least(multiplier * scaled, F.lit(700.0))), F.lit(float(limit)))


def _moments(sizes: DataFrame, state: DataFrame, limit: float) -> DataFrame:
    """Words that each source's rates take, and their derivative by the multiplier, in one aggregate over the documents.

    The sums are of decimals, so that they do not depend on the order in which partitions arrive.
    """
    x = F.col("size") / F.col("most")
    w = tilt(F.col("m"), x, limit)
    words = F.col("size") * F.col("docs") * w
    slope = F.when(w < limit, words * x).otherwise(0.0)
    exact = lambda v: F.sum(v.cast("decimal(38,12)")).cast("double")
    joined = sizes.alias("z").join(state.alias("s"), F.col("z.source").eqNullSafe(F.col("s.source")))
    return joined.groupBy("s.source").agg(*(F.any_value(c).alias(c) for c in ("target", "most", "m", "low", "high")), exact(words).alias("words"), exact(slope).alias("slope"))


def balance(sizes: DataFrame, sources: DataFrame, limit: float, scratch: Scratch) -> DataFrame:
    """(source, multiplier): the dual solution of least relative entropy to rates of 1 under ``target`` words a source.

    ``sizes`` has ``source, size, docs`` (documents of that size), ``sources`` has ``source, target, least, most,
    source_size`` (least and most: sizes above 0). Rates that minimise sum(w log w - w) under sum(size * w) = target
    and w <= limit are min(limit, exp(m * size / most)); m is the root of an increasing function, found by Newton
    steps on its logarithm from 0. Each step is one aggregate, and a step that would leave the interval known to
    hold the root is replaced by the interval's middle.
    """
    ratio = F.col("target") / F.col("source_size")
    far = F.log(ratio) * F.col("most") / F.col("least")  # there even the smallest document is tilted enough
    full = ratio >= limit  # every document at the limit
    state = sources.where("source_size > 0 and target > 0").select(
        "source", "target", "most",
        F.when(full, F.log(F.lit(float(limit))) * F.col("most") / F.col("least")).otherwise(F.lit(0.0)).alias("m"),
        F.when(full, F.lit(0.0)).otherwise(F.least(far, F.lit(0.0))).alias("low"), F.when(full, F.lit(0.0)).otherwise(F.greatest(far, F.lit(0.0))).alias("high"),
    )
    state = scratch.save(state, "dual-0")
    for k in range(1, MOST_STEPS):
        apart = F.abs(F.col("words") - F.col("target")) / F.col("target")
        under = F.col("words") < F.col("target")
        low, high = F.when(under, F.greatest("low", "m")).otherwise(F.col("low")), F.when(under, F.col("high")).otherwise(F.least("high", "m"))
        newton = F.col("m") - (F.log("words") - F.log("target")) * F.col("words") / F.nullif(F.col("slope"), F.lit(0.0))
        told = _moments(sizes, state, limit).withColumns({"lo": low, "hi": high, "newton": newton, "open": (apart > CLOSE) & (F.col("low") < F.col("high"))})
        inside = F.col("newton").isNotNull() & (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        m = F.when(~F.col("open"), F.col("m")).when(inside, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = scratch.save(told.select("source", "target", "most", m.alias("m"), F.col("lo").alias("low"), F.col("hi").alias("high"), "open"), f"dual-{k}")
        scratch.drop(f"dual-{k - 1}")
        if not state.where("open").limit(1).count():
            break
    return state.select("source", F.col("m").alias("multiplier"))


def _round(group: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Whole copies on either side of the rate, largest texts first, so that the words owed stay fewest.

    A row stands for ``rows`` equal documents, of which ``more`` get one copy above ``copies``. What is owed at the end
    is made up by one copy more or less of the largest texts that it is worth.
    """
    group = group.sort_values(["size", "known", "doc_id", "text_key"], ascending=[False, False, True, True], kind="stable")
    low = np.minimum(np.floor(group["rate"].to_numpy() + 1e-9), limit).astype(np.int64)
    part = np.where(low < limit, np.maximum(group["rate"].to_numpy() - low, 0.0), 0.0)
    sizes, rows = group["size"].tolist(), group["rows"].tolist()
    total = (low * group["rows"].to_numpy()).tolist()
    owed = 0.0

    def give(i: int, least: int, most: int) -> None:
        nonlocal owed
        n = min(most, max(least, int(np.floor(owed / sizes[i] + 0.5))))
        total[i] += n
        owed -= n * sizes[i]

    for i, p in enumerate(part.tolist()):
        if sizes[i] and p > 1e-9:
            owed += p * sizes[i] * rows[i]
            give(i, 0, rows[i])
    for i, n in enumerate(sizes):
        if n and 2 * abs(owed) >= n:
            give(i, -min(rows[i], total[i]), min(rows[i], limit * rows[i] - total[i]))
    copies, more = np.divmod(np.array(total, np.int64), group["rows"].to_numpy())
    return group[["source", "known", "doc_id", "text_key", "size", "rows"]].assign(copies=copies, more=more)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_rows: int = 1000) -> DataFrame:
    """How often each row is taken so that the sources' words stand in the proportions of ``weights``.

    A row's size is its number of ``[^\\x20\\x09-\\x0D]+`` (null text: 0). Sources by code point, null last, get
    ``weights`` in turn; all sources together keep the number of words there is, and no source's target is above
    ``limit`` times its words, the excess going to the others by weight. Returns ``doc_id, source, size,
    source_size, target, rate, copies, taken, text_key``, one row per input row; no other column is read. The same
    rows give the same copies however they are partitioned. No rows give no rows.

    Rates are ``min(limit, exp(multiplier * size / largest size))``, a multiplier a source, found by Newton steps on
    the convex dual (``balance``); each step is one aggregate over the documents, counted by size. A source that is
    to shrink gives up its longest documents first, one that is to grow repeats them. Copies are the whole numbers on
    either side of the rate, chosen within blocks of about ``block_rows`` distinct texts of a source, so that a source
    that holds most rows is spread over many tasks; a block's words miss its share by less than a short text, for which its last texts may be a copy further off. Repeated
    rows are rounded together and given out one by one. Documents without words have a rate of 1.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("text_key"),
    )
    items = scratch.save(sized.groupBy("source", "doc_id", "text_key", "size").agg(F.count("*").alias("rows")), "items")
    sizes = scratch.save(items.groupBy("source", "size").agg(F.sum("rows").alias("docs"), F.count("*").alias("items")), "sizes")
    some = F.when(F.col("size") > 0, F.col("size"))
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("items").alias("n"), F.min(some).alias("least"), F.max(some).alias("most"))
    sources = scratch.save(_with_weights(sums, weights), "sources")
    level = 0.0 if sources.isEmpty() else _level(sources, limit)
    target = F.least(F.col("weight") * F.lit(level), F.lit(float(limit)) * F.col("source_size"))
    sources = scratch.save(sources.withColumn("target", target), "targets")
    dual = balance(sizes.where("size > 0"), sources, limit, scratch)
    rates = scratch.save(
        sources.alias("s").join(dual.alias("d"), F.col("s.source").eqNullSafe(F.col("d.source")), "left")
        .select("s.source", "source_size", "target", "most", "multiplier", F.ceil(F.col("n") / block_rows).cast("long").alias("blocks")),
        "rates",
    )
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("multiplier").isNotNull(), tilt(F.col("multiplier"), F.col("size") / F.col("most"), limit)).otherwise(0.0)
    placed = items.alias("d").join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source"))).select(
        "d.source", "doc_id", "text_key", "size", "rows", rate.alias("rate"), F.pmod(F.xxhash64("doc_id", "text_key"), F.col("blocks")).alias("block")
    )
    # a column of longs with a null in it would reach pandas as doubles, which change large ids
    whole = placed.withColumns({"known": F.col("doc_id").isNotNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    rounded = whole.groupBy("source", "block").applyInPandas(
        lambda group: _round(group, limit), "source string, known boolean, doc_id long, text_key long, size long, rows long, copies long, more long"
    ).withColumn("doc_id", F.when(F.col("known"), F.col("doc_id")))
    # equal rows come out one by one, by thousands, so that no array grows with them
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    thousands = rounded.withColumn("thousand", upto(F.ceil(F.col("rows") / 1000)))
    single = thousands.withColumn("at", upto(F.least(F.lit(1000).cast("long"), F.col("rows") - F.col("thousand") * 1000)))
    copies = F.col("copies") + F.when(F.col("thousand") * 1000 + F.col("at") < F.col("more"), 1).otherwise(0)
    single = single.select("doc_id", "source", "size", "text_key", copies.alias("copies"))
    return single.alias("d").join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source"))).select(
        "doc_id", "d.source", "size", "source_size", "target", rate.alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_key"
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")
