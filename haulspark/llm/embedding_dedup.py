"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations (operator 4)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.llm.common import Scratch
from haulspark.llm.components import connected_components
from haulspark.llm.tokens import mix

_U = np.uint64
#: Tables, cross-polytope hashes a table, and buckets of a table in which each vector is put.
TABLES, HASHES, PROBES = 10, 3, 6


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two, scaled to keep norms."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def bucket_keys(vectors: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Keys (rows: unit vectors; TABLES * PROBES columns) of each vector's likeliest buckets in every table.

    A hash is the nearest of the 2d signed axes after a random rotation (signs and Hadamard, three times). Probes
    swap axes for second nearest ones, those first whose distance grows least.
    """
    n, d = vectors.shape
    width = 1 << max(0, d - 1).bit_length()
    padded = np.zeros((n, width))
    padded[:, :d] = vectors
    signs = np.random.default_rng(width).choice([-1.0, 1.0], (TABLES, HASHES, 3, width))
    swaps = (np.arange(1 << HASHES)[:, None] >> np.arange(HASHES)) & 1
    out = np.empty((n, TABLES, PROBES), _U)
    rows = np.arange(n)
    for t in range(TABLES):
        codes, gaps = np.empty((n, HASHES, 2), _U), np.empty((n, HASHES))
        for k in range(HASHES):
            y = padded
            for s in signs[t, k]:
                y = hadamard(y * s)
            size = np.abs(y)
            order = np.argpartition(size, width - 2, axis=1)[:, -2:] if width > 1 else np.zeros((n, 2), np.int64)
            one, two = order[:, 1], order[:, 0]
            flip = size[rows, two] > size[rows, one]
            one, two = np.where(flip, two, one), np.where(flip, one, two)
            for i, axis in enumerate((one, two)):
                codes[:, k, i] = axis.astype(_U) * _U(2) + (y[rows, axis] < 0)
            gaps[:, k] = size[rows, one] - size[rows, two]
        best = np.argsort(gaps**2 @ swaps.T, axis=1, kind="stable")[:, :PROBES]
        for p in range(PROBES):
            key = mix(salt + _U(t))
            for k in range(HASHES):
                key = mix(key ^ codes[rows, k, swaps[best[:, p], k]] + _U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            out[:, t, p] = key
    return out.reshape(n, -1)


_ROWS = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("digest", pa.binary()), ("unit", pa.binary())])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, units = [], []
        for label, value in zip(batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
            values = value.values if label is not None and value.is_valid else None
            digest = unit = None
            if values is not None and len(values) and not values.null_count:
                v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                largest = np.abs(v).max()
                if np.isfinite(largest) and largest > 0:
                    digest = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
                    v = v / largest  # so that no square over- or underflows
                    unit = (v / np.sqrt(v @ v)).tobytes()
            digests.append(digest)
            units.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], schema=_ROWS)


_KEYED = pa.schema([("rep", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = batch.column("unit").to_pylist()
        labels = batch.column("label").to_numpy()
        sizes = np.array([len(u) for u in units])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for lo in range(0, len(at), 4000):
                rows = at[lo : lo + 4000]
                vectors = np.frombuffer(b"".join(units[i] for i in rows)).reshape(len(rows), -1)
                salt = np.array([int(size) * 0xD6E8FEB86659FD93 % (1 << 64)], _U)
                keys = bucket_keys(vectors, mix(labels[rows].view(_U) + salt)).view(np.int64)
                bounds = np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.reshape(-1)))], schema=_KEYED)


_PARTIAL = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _first_meeting(keys: np.ndarray, table: int, key: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which of the pairs (one, two) of rows meet in no earlier table, and in ``table`` in no smaller bucket than ``key``."""
    first = np.ones(len(one), bool)
    for t in range(table + 1):
        for lo in range(0, len(one), 1 << 14):
            at = lo + np.flatnonzero(first[lo : lo + (1 << 14)])
            same = keys[one[at], t][:, :, None] == keys[two[at], t][:, None, :]
            if t == table:
                same &= (keys[one[at], t] < key)[:, :, None]
            first[at[same.any(axis=(1, 2))]] = False
    return first


def _compare_group(least: float, key: int, table: int, i: int, j: int, rep, copies, block, label, keys, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    size = np.array([len(u) for u in units])
    unit = np.zeros((len(rep), size.max() // 8))
    if (size == size[0]).all():
        unit[:] = np.frombuffer(b"".join(units)).reshape(len(rep), -1)
    else:
        for r, u in enumerate(units):
            unit[r, : len(u) // 8] = np.frombuffer(u)
    left, right = (np.flatnonzero(block == i), np.flatnonzero(block == j)) if i != j else (slice(None), slice(None))
    linked = unit[left] @ unit[right].T >= least
    linked &= (label[left][:, None] == label[right]) & (size[left][:, None] == size[right])
    if i == j:
        linked = np.triu(linked, 1)
    one, two = np.nonzero(linked)
    if not len(one):
        return None
    if i != j:
        one, two = left[one], right[two]
    counted = _first_meeting(keys, table, key, one, two)
    links = np.zeros(len(rep), np.int64)
    np.add.at(links, one[counted], copies[two[counted]])
    np.add.at(links, two[counted], copies[one[counted]])
    root = rep.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, one, root[two])
        np.minimum.at(root, two, root[one])
        if (root == before).all():
            break
    some = (links > 0) | (root != rep)
    return rep[some], links[some], root[some]


def _compare(least: float):
    """Links within a bucket, or between two blocks of one: their number a vector, and its component's root.

    Rows come sorted by bucket and blocks, at most two blocks a group. A pair that meets in several buckets is counted
    in the smallest one of the first table in which it meets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
            end = _last_group(held)
            if end:
                yield from groups(held.slice(0, end))
                held = held.slice(end)
        if held is not None and len(held):
            yield from groups(held)

    def groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j, table, rep, copies, block, label = (rows.column(c).to_numpy() for c in ("key", "i", "j", "table", "rep", "copies", "block", "label"))
        units = rows.column("unit").to_pylist()
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rows), TABLES, PROBES)
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        out = []
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(rows)], strict=True):
            got = _compare_group(least, key[lo], int(table[lo]), int(i[lo]), int(j[lo]), rep[lo:hi], copies[lo:hi], block[lo:hi], label[lo:hi], keys[lo:hi], units[lo:hi])
            if got is not None:
                out.append(got)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_PARTIAL)

    return run


def _last_group(rows: pa.Table) -> int:
    """Where the last group of the rows begins."""
    key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
    other = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1])) if len(rows) else key
    return int(other[-1]) + 1 if len(other) else 0


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, block_rows: int = 1024) -> DataFrame:
    """Links between vectors of one label whose cosine, in double precision, is ``least`` or more.

    Returns one row per input row: ``vec_id, n_links`` (other vectors linked directly), ``component_id`` (smallest
    id reachable) and ``kept``. Vectors that are null, empty, zero, or hold a null or a component that is not
    finite, and those with a null label, link with nothing, nor do vectors of different lengths. Every row is a vector
    of its own, so rows that repeat an id link as any two rows do. A row without an id is given back with no links and
    kept. Equal vectors of a label are one class and count as links of each other. No rows give no rows.

    Classes are hashed into several tables; only buckets with two classes or more are compared, in blocks of
    about ``block_rows``, each pair of blocks a group of its own, so a bucket of any size is spread out. Blocks give
    counts and roots, never pairs; every pair counted is verified by its cosine. Pairs that share no bucket are
    missed: README gives the measured recall.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "embedding-dedup")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"))
    described = scratch.save(rows.mapInArrow(_describe, "vec_id long, label long, digest binary, unit binary"), "described")
    grouped = described.where("digest is not null and vec_id is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    # a class is named by a number of its own: ids may repeat under other vectors
    classes = scratch.save(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")
    hashed = scratch.save(classes.select("rep", "label", "unit").mapInArrow(_hash, "rep long, keys array<long>"), "hashed")
    entries = hashed.select("rep", F.posexplode("keys").alias("at", "key")).withColumn("table", F.floor(F.col("at") / PROBES).cast("int")).drop("at").distinct()
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    placed = entries.join(shared, "key").withColumn("nb", F.ceil(F.col("n") / block_rows).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    placed = placed.select("key", "table", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep")
    full = placed.join(classes.select("rep", "label", "copies", "unit").join(hashed, "rep"), "rep")
    # no group is larger than two blocks, so that none need be split further
    dealt = full.select("key", "i", "j", "table", "rep", "copies", "block", "label", "keys", "unit").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    partial = scratch.save(dealt.mapInArrow(_compare(least), "rep long, links long, root long"), "partial")
    links = partial.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(partial.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    known = scratch.save(
        classes.join(links, "rep", "left").join(parts, classes.rep == parts.node, "left")
        .select("label", "digest", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("part")),
        "known",
    )
    smallest = scratch.save(known.groupBy("part").agg(F.min("low").alias("component")), "smallest")
    known = scratch.save(known.join(smallest, "part").select("label", "digest", "n_links", "component"), "named")
    return described.join(known, ["label", "digest"], "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
ok as (
  select vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from v
  where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), n as (select a as vec_id, count(*) as n from l group by 1),
reach(vec_id, root) as (select vec_id, vec_id from embeddings union select r.vec_id, l.b from reach r join l on l.a = r.root)
select vec_id, coalesce(any_value(n), 0)::bigint as n_links, min(root) as component_id, vec_id = min(root) as kept from reach left join n using (vec_id) group by vec_id
"""
