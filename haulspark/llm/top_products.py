"""Exact top-k by inner product, norms first: rotated partial sums and Cauchy-Schwarz bounds (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulspark.llm.common import Scratch, few_rows_a_batch
from haulspark.llm.integers import products, stacked, whole_vectors

#: Candidates a range of norms, candidates a block of one range, queries a block, and query blocks that share one copy of a range.
RANGE_ROWS, BLOCK_ROWS, QUERY_ROWS, SHARED_BLOCKS = 4096, 2048, 1024, 32
#: Each wave of ranges has so many times the ranges of all before it.
WAVE_GROWTH = 8
#: Vectors, those of smallest hash, from which the rotation is learned; any rotation gives the same result.
ROTATION_ROWS = 4096


def _describe(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = whole_vectors(batch.column(1), scale)
            norms = [None if w is None else int((np.frombuffer(w, np.int32).astype(np.int64) ** 2).sum()) for w in whole]
            raw = pa.array(whole, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), raw, pa.array(norms, pa.int64())], names=["vec_id", "asks", "whole", "norm2"]).filter(raw.is_valid())

    return run


_BLOCK = pa.schema([("p", pa.int32()), ("size", pa.int32()), ("largest", pa.float64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("whole", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come by length and falling norm as blocks; no block holds two lengths."""
    held: pa.Table | None = None

    def blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        size = rows.column("size").to_numpy()
        cuts = np.flatnonzero(np.append(True, size[1:] != size[:-1]))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=True):
            part = rows.slice(lo, hi - lo)
            listed = lambda name, part=part: pa.array([part.column(name).to_pylist()], pa.list_(pa.int64()))
            whole = b"".join(part.column("whole").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("p").slice(0, 1).combine_chunks(), part.column("size").slice(0, 1).combine_chunks(), pa.array([float(part.column("norm2")[0].as_py()) ** 0.5]), listed("row"), listed("vec_id"), pa.array([whole], pa.binary())],
                schema=_BLOCK,
            )

    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        while len(held) >= BLOCK_ROWS:
            yield from blocks(held.slice(0, BLOCK_ROWS).combine_chunks())
            held = held.slice(BLOCK_ROWS)
    if held is not None and len(held):
        yield from blocks(held.combine_chunks())


def rotations(samples: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each length, the right singular vectors of its sample: most of an inner product is then in its first terms."""
    return {size: np.linalg.svd(x.T @ x)[0] for size, x in samples.items() if size and len(x)}


def scored(asked: np.ndarray, least: np.ndarray, held: np.ndarray, basis: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, inner product) of the pairs that can reach their query's ``least``; ``held`` comes by falling norm.

    Norms cut each query's candidates to a prefix. Then partial sums over the first rotated components, with the
    product of the residual norms on top, bound the rest; pairs whose bound is too low are never finished. What is left is summed exactly.
    """
    norms, own = np.sqrt((held * held).sum(axis=1)), np.sqrt((asked * asked).sum(axis=1))
    if not np.isfinite(least).any():
        q, c = np.divmod(np.arange(len(asked) * len(held)), len(held))
        return q, c, products(asked, held).reshape(-1)
    loose = least - 1e-9 * (1 + own * norms.max(initial=0)) - 1e-6
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(own > 0, loose / own, np.where(loose <= 0, -np.inf, np.inf))
    reach = np.searchsorted(-norms, -need, "right")  # candidates of at least that norm
    some = np.flatnonzero(reach)
    longest = int(reach.max(initial=0))
    none = np.zeros(0, np.int64)
    if not longest:
        return none, none, none
    asked, loose, held = asked[some], loose[some], held[:longest]
    alive = np.arange(longest) < reach[some][:, None]
    d = asked.shape[1]
    if basis is not None and d >= 8:
        turned, other = asked @ basis, held @ basis
        sums, done = np.zeros(alive.shape), 0
        for upto in (d // 4, d // 2, 3 * d // 4):
            sums += turned[:, done:upto] @ other[:, done:upto].T
            done = upto
            rest = np.sqrt((turned[:, done:] ** 2).sum(axis=1))[:, None] * np.sqrt((other[:, done:] ** 2).sum(axis=1))
            alive &= sums + rest >= loose[:, None]
            if alive.mean() < 0.02:
                break
    q, c = np.nonzero(alive)
    if len(q) > 0.1 * alive.size:
        exact = products(asked, held)[q, c]
    else:
        exact = np.concatenate([np.zeros(0, np.int64), *[(asked[q[lo : lo + 65536]].astype(np.int64) * held[c[lo : lo + 65536]].astype(np.int64)).sum(axis=1) for lo in range(0, len(q), 65536)]])
    return some[q], c, exact


_FOUND = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _meet(k: int, bases: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                size = batch.column("size")[i].as_py()
                asks = batch.column("asks")[i].values
                asked, own = stacked(asks.field("whole").to_pylist(), size), asks.field("row").to_numpy()
                least = asks.field("least").fill_null(-1 << 62).to_numpy().astype(np.float64)
                least[least == -(1 << 62)] = -np.inf
                rows, ids = batch.column("rows")[i].values.to_numpy(), batch.column("ids")[i].values
                held = np.frombuffer(batch.column("whole")[i].as_py(), np.int32).reshape(len(rows), size).astype(np.float64)
                q, c, score = scored(asked, least, held, bases.get(size))
                fits = (score >= least[q]) & (own[q] != rows[c])
                q, c, score = q[fits], c[fits], score[fits].astype(np.int64)
                last = np.where(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), np.iinfo(np.int64).max)
                order = np.lexsort((last[c], -score, q))
                q, c, score = q[order], c[order], score[order]
                top = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pa.RecordBatch.from_arrays([pa.array(own[q[top]]), ids.take(pa.array(c[top])), pa.array(score[top])], schema=_FOUND)

    return run


def top_products(vectors: DataFrame, asks: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of highest inner product with each row for which ``asks`` holds, in integers ``floor(scale * component)``.

    Returns ``query_id, rank`` (from 1), ``vec_id, score``; ties go to the smaller id, rows without an id come after those that have one. A row is
    compared with all rows of its length but itself: rows that repeat its id are candidates, and rows that repeat a query are queries of their own. Vectors
    that are null or hold a null or a component that is not finite take no part; a query without candidates gives no rows, nor do no rows. A null in ``asks`` asks
    nothing. Components from 2^27 / scale on are refused. Other columns are not looked at.

    Candidates lie in ranges of falling norm, in blocks of one row each. Waves of ranges, each some times longer than all before, meet the blocks of queries; a
    query's k-th score so far drops ranges, candidates and partial sums that cannot reach it. A range is copied once for every so many query
    blocks, so no task's share grows with the number of queries. Between waves only the best k of each query are kept, as a table.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "top-products")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.coalesce(asks, F.lit(False)).alias("asks"))
    described = rows.mapInArrow(_describe(scale), "vec_id long, asks boolean, whole binary, norm2 long")
    described = scratch.save(described.withColumns({"row": F.monotonically_increasing_id(), "size": (F.octet_length("whole") / 4).cast("int")}), "described")
    n, n_asks = described.agg(F.count("*"), F.count_if("asks")).first()
    sample = described.orderBy(F.xxhash64("row"), "row").limit(ROTATION_ROWS).select("size", "whole").collect() if n_asks else []
    samples: dict[int, list[bytes]] = {}
    for r in sample:
        samples.setdefault(r["size"], []).append(r["whole"])
    bases = rotations({size: stacked(raw, size) for size, raw in samples.items()})
    ordered = described.repartitionByRange(max(1, -(-n // RANGE_ROWS)), "size", F.col("norm2").desc(), "row").sortWithinPartitions("size", F.col("norm2").desc(), "row")
    packed = ordered.select(F.spark_partition_id().alias("p"), "size", "norm2", "row", "vec_id", "whole").mapInArrow(_pack, "p int, size int, largest double, rows array<long>, ids array<long>, whole binary")
    blocks = scratch.save(packed, "blocks")
    ranges = scratch.save(blocks.groupBy("p", "size").agg(F.max("largest").alias("reach")), "ranges")
    n_ranges = (ranges.agg(F.max("p")).first()[0] or 0) + 1
    n_blocks = max(1, -(-n_asks // QUERY_ROWS))
    n_salts = max(1, -(-n_blocks // SHARED_BLOCKS))
    queries = described.where("asks").withColumn("q", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")).select("row", "vec_id", "q", "size", "whole", "norm2")
    best: DataFrame | None = None
    lo, hi, wave = 0, 1, 0
    while lo < n_ranges and n_asks:
        told = queries.withColumn("least", F.lit(None).cast("long"))
        if best is not None:
            least = best.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("row", "least")
            told = queries.join(least, "row", "left")
        # the norm from which a candidate can reach the least score of some query of the block
        need = F.when(F.coalesce(F.col("least") <= 0, F.lit(True)), F.lit(0.0)).otherwise(F.col("least") / F.sqrt("norm2") * (1 - 1e-9))
        asked = scratch.save(told.groupBy("q", "size").agg(F.min(need).alias("need"), F.collect_list(F.struct("row", "whole", "least")).alias("asks")), f"asked-{wave}")
        wanted = asked.select("q", "size", "need", F.explode(F.sequence(F.lit(lo), F.lit(min(hi, n_ranges) - 1))).alias("p")).join(ranges, ["p", "size"]).where("reach >= need")
        wanted = asked.select("q", "size", "asks").join(wanted.groupBy("q", "size").agg(F.collect_list("p").alias("ps")), ["q", "size"])
        left = wanted.select("size", "asks", F.explode("ps").alias("p"), F.pmod("q", F.lit(n_salts)).alias("salt"))
        right = blocks.where((F.col("p") >= lo) & (F.col("p") < hi)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))
        with few_rows_a_batch(spark, 8):
            pairs = left.join(right, ["p", "size", "salt"]).select("size", "asks", "rows", "ids", "whole")
            found = scratch.save(pairs.mapInArrow(_meet(k, bases), "row long, vec_id long, score long"), f"found-{wave}")
        both = found if best is None else found.unionByName(best)
        order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        best = scratch.save(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), f"best-{wave}")
        scratch.drop(f"asked-{wave}", f"found-{wave}", f"best-{wave - 1}")
        lo, hi, wave = hi, hi * WAVE_GROWTH, wave + 1
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).join(queries.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_products(vectors, F.col("vec_id") % 20 == 0)


OP12_SQL = """
with v as (
  select vec_id, list_transform(embedding::double[], lambda x: floor(64 * x)) as e from embeddings
  where embedding is not null and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0
), s as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint as score from v q join v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
