"""Codes of vectors from codebooks of their parts, learned by Lloyd rounds that keep heaps of slack (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulspark.llm.common import Scratch, few_rows_a_batch
from haulspark.llm.integers import products, stacked, whole_vectors

#: Numbers in a block of vectors: so many rows share one set of heaps and one set of sums.
BLOCK_NUMBERS = 1 << 20


def _describe(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.array(whole_vectors(batch.column(2), scale), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), whole], names=["vec_id", "label", "whole"]).filter(whole.is_valid())

    return run


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its nearest entry (of equals, the lowest), the exact squared distance, and that of the second nearest (inf without one)."""
    n = len(x)
    best, near, second = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
    squares = (book * book).sum(axis=1)
    for lo in range(0, n, 4096):
        part = x[lo : lo + 4096]
        d = (part * part).sum(axis=1)[:, None] + squares - 2 * products(part, book)
        at, rows = d.argmin(axis=1), np.arange(len(part))
        best[lo : lo + 4096], near[lo : lo + 4096] = at, d[rows, at]
        if len(book) > 1:
            d = d.astype(np.float64)
            d[rows, at] = np.inf
            second[lo : lo + 4096] = d.min(axis=1)
    return best, near, second


def slack(near: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How much farther the second nearest entry is than the nearest, less what rounding could feign."""
    u, l = np.sqrt(near), np.sqrt(second)
    return np.where(np.isinf(l), np.inf, l - u - 1e-9 * (l + u + 1))


class Heaps:
    """A binary heap an entry (of each part), of the rows assigned to it, keyed by slack plus the entry's drift so far.

    Heaps lie end to end in flat arrays: within one, the children of place i are 2i + 1 and 2i + 2. A row's nearest
    entry can have changed only when its key is no more than the drift, so a round walks down from the roots, level by level in all
    heaps at once, and never sees a row below one that still holds.
    """

    def __init__(self, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray):
        self.keys, self.rows, self.sizes = keys, rows, sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    @classmethod
    def of(cls, slots: np.ndarray, keys: np.ndarray, rows: np.ndarray, n_slots: int) -> Heaps:
        order = np.lexsort((keys, slots))  # sorted keys are a heap
        return cls(keys[order], rows[order], np.bincount(slots, minlength=n_slots))

    def violated(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, slots) of the rows whose bounds no longer hold."""
        slots = np.flatnonzero(self.sizes)
        at, out_at, out_slots = np.zeros(len(slots), np.int64), [], []
        while len(slots):
            place = self.starts[slots] + at
            hit = self.keys[place] <= drift[slots]
            slots, at = slots[hit], at[hit]
            out_at.append(place[hit])
            out_slots.append(slots)
            slots, at = np.concatenate([slots, slots]), np.concatenate([2 * at + 1, 2 * at + 2])
            inside = at < self.sizes[slots]
            slots, at = slots[inside], at[inside]
        none = np.zeros(0, np.int64)
        return np.concatenate([*out_at, none]), np.concatenate([*out_slots, none])

    def moved(self, places: np.ndarray, old: np.ndarray, new: np.ndarray, keys: np.ndarray) -> Heaps:
        """Heaps in which the rows at ``places`` (of slots ``old``) stand in slots ``new`` by ``keys``; only heaps concerned are built anew."""
        n_slots, total = len(self.sizes), len(self.keys)
        sizes = self.sizes - np.bincount(old, minlength=n_slots) + np.bincount(new, minlength=n_slots)
        touched = np.zeros(n_slots, bool)
        touched[old] = touched[new] = True
        slot_of = np.repeat(np.arange(n_slots), self.sizes)
        stays, starts = np.ones(total, bool), np.concatenate([[0], np.cumsum(sizes)])
        stays[places] = False
        out_keys, out_rows = np.empty(total), np.empty(total, self.rows.dtype)
        whole = np.flatnonzero(~touched[slot_of])
        to = starts[slot_of[whole]] + whole - self.starts[slot_of[whole]]
        out_keys[to], out_rows[to] = self.keys[whole], self.rows[whole]
        rest = np.flatnonzero(touched[slot_of] & stays)
        slots, keys, rows = np.concatenate([slot_of[rest], new]), np.concatenate([self.keys[rest], keys]), np.concatenate([self.rows[rest], self.rows[places]])
        order = np.lexsort((keys, slots))
        slots = slots[order]
        first = np.searchsorted(slots, slots)  # of its slot
        to = starts[slots] + np.arange(len(slots)) - first
        out_keys[to], out_rows[to] = keys[order], rows[order]
        return Heaps(out_keys, out_rows, sizes)


def _parts(whole: np.ndarray, parts: int) -> list[np.ndarray]:
    """Consecutive parts of equal width; a length that does not divide is filled up with zeros."""
    width = -(-whole.shape[1] // parts)
    padded = np.zeros((len(whole), width * parts))
    padded[:, : whole.shape[1]] = whole
    return [padded[:, p * width : (p + 1) * width] for p in range(parts)]


def _reassigned(x: list[np.ndarray], heaps: Heaps, books: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray, np.ndarray, np.ndarray]:
    """Heaps after the books moved, and of every part that changed its entry: row, old slot, new slot. Only popped parts are looked at."""
    parts, entries, _ = books.shape
    places, old = heaps.violated(drift)
    new, keys = old.copy(), np.empty(len(old))
    rows = heaps.rows[places]
    for p in range(parts):
        mine = np.flatnonzero(old // entries == p)
        best, near, second = nearest(x[p][rows[mine]], books[p])
        new[mine] = best + p * entries
        keys[mine] = slack(near, second) + drift[new[mine]]
    changed = new != old
    return heaps.moved(places, old, new, keys), rows[changed], old[changed], new[changed]


def _sums(x: list[np.ndarray], entries: int, rows: np.ndarray, slots: np.ndarray, sign: int, counts: np.ndarray, totals: np.ndarray) -> None:
    for p, part in enumerate(x):
        mine = np.flatnonzero(slots // entries == p)
        np.add.at(totals, slots[mine], sign * part[rows[mine]].astype(np.int64))
    np.add.at(counts, slots, sign)


_MOVED = pa.list_(pa.struct([("slot", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))


def _moved_array(counts: np.ndarray, totals: np.ndarray) -> pa.Array:
    some = np.flatnonzero((counts != 0) | (totals != 0).any(axis=1))
    width = totals.shape[1]
    sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(totals[some].reshape(-1), pa.int64()))
    rows = pa.StructArray.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some], pa.int64()), sums], fields=list(_MOVED.value_type))
    return pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), rows)


def _state_row(ids: pa.Array, labels: pa.Array, whole: bytes, heaps: Heaps, moved: pa.Array) -> pa.RecordBatch:
    listed = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    flat = [whole, heaps.keys.tobytes(), heaps.rows.astype(np.int32).tobytes(), heaps.sizes.astype(np.int32).tobytes()]
    names = ["ids", "labels", "whole", "keys", "rows", "sizes", "moved"]
    return pa.RecordBatch.from_arrays([listed(ids), listed(labels), *[pa.array([b], pa.binary()) for b in flat], moved], names=names)


def _first_round(books: np.ndarray, length: int):
    """Blocks of rows with every part assigned by a full scan."""
    parts, entries, width = books.shape
    block = max(1024, BLOCK_NUMBERS // max(1, length))

    def state(rows: pa.Table) -> pa.RecordBatch:
        raw = rows.column("whole").to_pylist()
        x = _parts(stacked(raw, length), parts)
        counts, totals = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        slots, keys = [], []
        for p in range(parts):
            best, near, second = nearest(x[p], books[p])
            slots.append(best + p * entries)
            keys.append(slack(near, second))
            _sums(x, entries, np.arange(len(raw)), slots[-1], 1, counts, totals)
        heaps = Heaps.of(np.concatenate(slots), np.concatenate(keys), np.tile(np.arange(len(raw)), parts), parts * entries)
        flat = lambda name: pa.concat_arrays(rows.column(name).chunks)
        return _state_row(flat("vec_id"), flat("label"), b"".join(raw), heaps, _moved_array(counts, totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= block:
                table = pa.Table.from_batches(held)
                yield state(table.slice(0, block))
                held = table.slice(block).to_batches()
                n -= block
        if n:
            yield state(pa.Table.from_batches(held))

    return run


def _loaded(batch: pa.RecordBatch, i: int, length: int, parts: int) -> tuple[list[np.ndarray], Heaps]:
    get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
    ids = len(batch.column("ids")[i])
    whole = get("whole", np.int32).reshape(ids, length).astype(np.float64)
    return _parts(whole, parts), Heaps(get("keys", np.float64), get("rows", np.int32).astype(np.int64), get("sizes", np.int32).astype(np.int64))


def _next_round(books: np.ndarray, drift: np.ndarray, length: int):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x, heaps = _loaded(batch, i, length, parts)
                heaps, rows, old, new = _reassigned(x, heaps, books, drift)
                counts, totals = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
                _sums(x, entries, rows, old, -1, counts, totals)
                _sums(x, entries, rows, new, 1, counts, totals)
                yield _state_row(batch.column("ids")[i].values, batch.column("labels")[i].values, batch.column("whole")[i].as_py(), heaps, _moved_array(counts, totals))

    return run


def _last_round(books: np.ndarray, drift: np.ndarray, length: int):
    parts, entries, _ = books.shape
    hexes = np.array([f"{i:02x}" for i in range(entries)], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x, heaps = _loaded(batch, i, length, parts)
                heaps, *_ = _reassigned(x, heaps, books, drift)
                n = len(x[0])
                codes, error = np.full(n, "", dtype=object), np.zeros(n, np.int64)
                slot_of = np.repeat(np.arange(parts * entries), heaps.sizes)
                for p in range(parts):
                    mine = slot_of // entries == p
                    entry = np.empty(n, np.int64)
                    entry[heaps.rows[mine]] = slot_of[mine] - p * entries
                    codes = codes + hexes[entry]
                    gap = (x[p] - books[p][entry]).astype(np.int64)
                    error += (gap * gap).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(codes.tolist(), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _gathered(state: DataFrame, counts: np.ndarray, totals: np.ndarray) -> None:
    """Adds what moved to the running sums: one row an entry reaches the driver, however many rows there are."""
    width = totals.shape[1]
    moved = state.select(F.explode("moved").alias("m")).select("m.slot", "m.n", "m.s")
    for row in moved.groupBy("slot").agg(F.sum("n"), *[F.sum(F.get("s", F.lit(i))) for i in range(width)]).collect():
        counts[row[0]] += row[1]
        totals[row[0]] += np.array(row[2:], np.int64)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """Code, error and codebooks of every vector, in integers ``floor(scale * component)``.

    Returns ``vec_id, code`` (two hex digits a part), ``error`` (squared distances to the entries, summed), ``label_error`` (error summed over equal
    labels, nulls together) and ``codebooks_sha256``, one row an input row. Rows whose vector is null or holds a null or a component that is not finite are
    dropped. A row without an id is coded and comes last in the order that starts the codebooks; rows that repeat an id stand there in the order of their
    vectors' bytes. Codebooks start with fewer entries if there are fewer rows. A length that does not divide by
    ``parts`` is filled up with zeros. Vectors of another length than the first row's are returned with null code and error. No rows give no rows.
    Components from 2^27 / scale on are refused, as sums of their squares may fit no long. Other columns are not looked at.

    Rows lie in blocks, each one row of a table with its heaps; a round reads the blocks, pops the parts whose bounds the entries' drift has used up, scans
    those against all entries, and writes blocks and the sums that moved. Only the codebooks (entries times length) are in the driver and sent out.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vector-codes")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    label_type = rows.schema["label"].dataType
    described = rows.mapInArrow(_describe(scale), T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label_type), T.StructField("whole", T.BinaryType())]))
    first = described.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("whole").limit(entries).collect()
    out_type = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not first:
        coded, digest = spark.createDataFrame([], out_type), hashlib.sha256(b"").hexdigest()
        return coded.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
    length = len(first[0].whole) // 4
    start = stacked([r.whole for r in first if len(r.whole) == 4 * length], length)
    books = np.stack(_parts(start, parts))
    n_entries, width = books.shape[1:]
    of_length = F.octet_length("whole") == 4 * length
    state_type = T.StructType().add("ids", T.ArrayType(T.LongType())).add("labels", T.ArrayType(label_type)).add("whole", "binary").add("keys", "binary").add("rows", "binary").add("sizes", "binary")
    state_type = state_type.add("moved", T.ArrayType(T.StructType().add("slot", "integer").add("n", "long").add("s", T.ArrayType(T.LongType()))))
    counts, totals, drift = np.zeros(parts * n_entries, np.int64), np.zeros((parts * n_entries, width), np.int64), np.zeros(parts * n_entries)
    state = scratch.save(described.where(of_length).mapInArrow(_first_round(books, length), state_type), "round-0")
    for k in range(1, rounds + 1):
        _gathered(state, counts, totals)
        after, used = books.reshape(-1, width).copy(), counts > 0
        after[used] = totals[used] // counts[used][:, None]
        step = np.sqrt(((after - books.reshape(-1, width)) ** 2).sum(axis=1)).reshape(parts, n_entries) * (1 + 1e-9)
        for p in range(parts):
            most = np.sort(step[p])
            others = np.where(step[p] == most[-1], most[-2] if n_entries > 1 and (step[p] == most[-1]).sum() == 1 else most[-1], most[-1])
            drift[p * n_entries : (p + 1) * n_entries] += step[p] + others
        books = after.reshape(parts, n_entries, width)
        if k < rounds:
            with few_rows_a_batch(spark, 4):
                state = scratch.save(state.mapInArrow(_next_round(books, drift.copy(), length), state_type), f"round-{k}")
            scratch.drop(f"round-{k - 1}")
    with few_rows_a_batch(spark, 4):
        coded = scratch.save(state.mapInArrow(_last_round(books, drift, length), out_type), "coded")
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()
    by_label = scratch.save(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    told = coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label"))).select("vec_id", "code", "error", "label_error")
    other = described.where(~of_length).select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"))
    return told.unionByName(other).withColumn("codebooks_sha256", F.lit(digest))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds_sql() -> str:
    """The rounds as one common table expression each: parts meet the entries of their position, then entries become means."""
    out = []
    for k in range(5):
        out.append(f"""a{k} as materialized (
  select x.vec_id, x.p, arg_min(c.i, (list_dot_product(x.v, x.v) + list_dot_product(c.v, c.v) - 2 * list_dot_product(x.v, c.v)) * 256 + c.i) as i,
    min(list_dot_product(x.v, x.v) + list_dot_product(c.v, c.v) - 2 * list_dot_product(x.v, c.v)) as d
  from part x join c{k} c on x.p = c.p group by x.vec_id, x.p
)""")
        if k < 4:
            out.append(f"""m{k} as materialized (
  select p, i, list(floor(s / n) order by j) as v from (
    select p, i, j, sum(y) as s, count(*) as n from (select a.p, a.i, generate_subscripts(x.v, 1) as j, unnest(x.v) as y from a{k} a join part x on a.vec_id = x.vec_id and a.p = x.p) group by p, i, j
  ) group by p, i
), c{k + 1} as materialized (select c.p, c.i, coalesce(m.v, c.v) as v from c{k} c left join m{k} m on c.p = m.p and c.i = m.i)""")
    return ",\n".join(out)


OP13_SQL = f"""
with kept as (
  select vec_id, label, list_transform(embedding::double[], lambda x: floor(1024 * x)) as e from embeddings
  where embedding is not null and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0
), part as materialized (
  select vec_id, p, e[p * len(e) // 4 + 1 : (p + 1) * len(e) // 4] as v from kept, range(4) t(p)
), c0 as materialized (
  select p, row_number() over (partition by p order by vec_id) - 1 as i, v from part where vec_id in (select vec_id from kept order by vec_id limit 256)
),
{_rounds_sql()},
coded as (select vec_id, string_agg(printf('%02x', i), '' order by p) as code, sum(d)::bigint as error from a4 group by vec_id),
book as (select sha256(string_agg(array_to_string(list_transform(v, lambda y: y::bigint::varchar), ','), ',' order by p, i)) as h from c4)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, (select h from book) as codebooks_sha256 from coded join kept using (vec_id)
"""
