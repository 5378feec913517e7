"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.llm.bloom import filter_of_ids
from haulspark.llm.common import Scratch, lean, text_bytes
from haulspark.llm.components import connected_components
from haulspark.llm.tokens import Words, mix, runs_of_texts, shingle_sets

_U = np.uint64
#: A signature is CHUNKS x SYMBOLS symbols of 16 bits; ERRORS of a chunk's symbols may differ.
CHUNKS, SYMBOLS, ERRORS = 12, 5, 1
#: By pigeonhole, two signatures that differ in at most this many symbols agree in one chunk up to ERRORS.
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
_WIDTH = CHUNKS * SYMBOLS
_rng = np.random.default_rng(71)
_FACTORS = _rng.integers(1, 1 << 63, _WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_SHIFTS = _rng.integers(1, 1 << 63, _WIDTH, dtype=np.uint64)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """b-bit minima (rows: sets, columns: symbols) of the non-empty sets ``hashes[bounds[i]:bounds[i + 1]]``."""
    out = np.empty((len(bounds) - 1, _WIDTH), np.uint16)
    for k in range(_WIDTH):
        low = np.minimum.reduceat((hashes * _FACTORS[k] + _SHIFTS[k]) >> _U(24), bounds[:-1])
        out[:, k] = mix(low) & _U(0xFFFF)
    return out


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys (rows: signatures) of each chunk with each choice of one symbol left out.

    Two chunks that differ in at most one symbol share the key that leaves it out, so equal keys enumerate the
    allowed errors of a chunk without listing what the symbol might have been.
    """
    s = sigs.astype(_U).reshape(-1, CHUNKS, SYMBOLS)
    keys = np.empty((len(sigs), CHUNKS, SYMBOLS), _U)
    for out in range(SYMBOLS):
        packed = np.zeros(s.shape[:2], _U)
        for i in range(SYMBOLS):
            if i != out:
                packed = (packed << _U(16)) | s[:, :, i]
        keys[:, :, out] = mix(mix(packed) + np.arange(CHUNKS, dtype=_U) * _U(SYMBOLS) + _U(out))
    return keys.reshape(len(sigs), -1)


_DOCS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("sig", pa.binary())])


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for lo, hi, data, offsets in runs_of_texts(batch.column("text")):
                sets = shingle_sets(Words(data, offsets, lower=True), width)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                hashes, sigs = [None] * len(sets), [None] * len(sets)
                if len(full):
                    bounds = np.concatenate([[0], np.cumsum(sizes[full])])
                    rows = signatures(np.concatenate([sets[i] for i in full]), bounds)
                    for i, row in zip(full.tolist(), rows, strict=True):
                        hashes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        sigs[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([ids[lo:hi].cast(pa.int64()), keys[lo:hi], pa.array(sizes), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary())], schema=_DOCS)

    return run


_KEYS = pa.schema([("key", pa.int64()), ("rep", pa.int64())])


def _sig_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, _WIDTH)


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 2000):
            part = batch.slice(lo, 2000)
            keys = chunk_keys(_sig_matrix(part.column("sig")))
            reps = np.repeat(part.column("rep").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(reps)], schema=_KEYS)


_STARS = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("leader", pa.int64())])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, rep), those whose key others share, each with the smallest rep of its key.

    One row is held back between batches, so a key of any size takes no memory.
    """
    key = leader = None
    lone = False  # the key's first row is not given out yet
    for batch in batches:
        keys, reps = batch.column("key").to_numpy(), batch.column("rep").to_numpy()
        if not len(keys):
            continue
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        new[0] = key is None or keys[0] != key
        at = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
        leaders = np.where(at >= 0, reps[at], leader if leader is not None else 0)
        shared = ~new
        shared[:-1] |= ~new[1:]
        shared[-1] &= not new[-1]
        out = [keys[shared], reps[shared], leaders[shared]]
        if lone and not new[0]:
            out = [np.concatenate([[v], c]) for v, c in zip((key, leader, leader), out, strict=True)]
        key, leader, lone = keys[-1], leaders[-1], bool(new[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_STARS)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sharing(keys: np.ndarray, probes: np.ndarray, targets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each probe, the targets with which it shares a chunk key."""
    flat = keys[targets].reshape(-1)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(targets, keys.shape[1])[order]
    for i in probes.tolist():
        lo, hi = np.searchsorted(flat, keys[i], "left"), np.searchsorted(flat, keys[i], "right")
        n = hi - lo
        if n.sum() < len(targets):
            yield i, np.unique(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        else:  # most targets share some: looking at each once is shorter
            yield i, targets[(keys[targets] == keys[i]).any(axis=1)]


def _across(percent: int):
    """Links between one block of outsiders and one block of their family, compared on full sets.

    A pair is compared if it shares a chunk key. Rows that links of this block have joined already are not compared
    again.
    """

    def run(table: pa.Table) -> pa.Table:
        rep, component, outside = (table.column(c).to_numpy() for c in ("rep", "component", "outside"))
        probe = table.column("probe").to_numpy()
        keys = chunk_keys(_sig_matrix(table.column("sig")))
        lists = table.column("shingles").combine_chunks()
        values, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        sizes = np.diff(bounds)
        root = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        links = []
        for i, j in _sharing(keys, np.flatnonzero(probe), np.flatnonzero(~probe)):
            j = j[(component[j] != component[i]) & (~outside[j] | (rep[j] > rep[i]))]
            j = j[100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i])]
            mine = np.sort(values[bounds[i] : bounds[i + 1]])
            for lo in range(0, len(j), 256):
                part = np.array([x for x in j[lo : lo + 256].tolist() if find(int(component[x])) != find(int(component[i]))], np.int64)
                if not len(part):
                    continue
                theirs = np.concatenate([values[bounds[x] : bounds[x + 1]] for x in part.tolist()])
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                same = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.cumsum([0, *sizes[part][:-1]]))
                for x in part[100 * same >= percent * (sizes[part] + sizes[i] - same)].tolist():
                    one, two = find(int(component[x])), find(int(component[i]))
                    if one != two:
                        root[one] = two
                        links.append((int(rep[i]), int(rep[x])))
        return pa.Table.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=_LINKS)

    return run


_SETS = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _passed(wanted: Broadcast):
    """Rows whose id is wanted, and a few others that the filter of ids lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.holds_ids(batch.column("id").to_numpy())))

    return run


def _sets(width: int):
    """Full sets of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in runs_of_texts(batch.column("text")):
                sets = shingle_sets(Words(data, offsets, lower=True), width)
                bounds = np.cumsum([0, *(len(s) for s in sets)], dtype=np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id")[lo:hi], pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))], schema=_SETS)

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) for which 100 * intersection >= percent * union of the full sets."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    near = pairs.join(one, "a").join(two, "b")
    # a pair whose sizes alone rule it out is not intersected
    near = near.where(100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb")))
    near = near.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return near.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def _links_across(families: DataFrame, parts: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, probe_size: int = 1 << 16, target_size: int = 1 << 18) -> DataFrame:
    """Links between components of one family (rows tied by keys that hold several components).

    The rows outside a family's largest component are the probes; they are dealt to blocks of about ``probe_size``
    shingles and meet the family in blocks of about ``target_size``, so that a family of any size is spread out.
    """
    placed = families.select(F.col("node").alias("rep"), F.col("component").alias("family")).join(parts, F.col("rep") == parts.node, "left")
    placed = placed.select("family", "rep", F.coalesce("component", "rep").alias("component"))
    members = scratch.save(placed.join(sets.select(F.col("id").alias("rep"), F.size("shingles").alias("n")), "rep"), "members")
    sums = members.groupBy("family", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    plan = sums.groupBy("family").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.sum("n").alias("all"), F.max_by("n", F.struct("rows", "component")).alias("inside"))
    plan = scratch.save(
        plan.select("family", "main", F.ceil((F.col("all") - F.col("inside")) / probe_size).cast("int").alias("nb"), F.ceil(F.col("all") / target_size).cast("int").alias("nc")).where("nb > 0"), "family-plan"
    )
    rows = members.join(plan, "family").withColumn("outside", F.col("component") != F.col("main"))
    b, c = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("nc")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = rows.where("outside").select("family", b.alias("b"), upto("nc").alias("c"), "rep", "component", "outside", F.lit(True).alias("probe"))
    targets = rows.select("family", upto("nb").alias("b"), c.alias("c"), "rep", "component", "outside", F.lit(False).alias("probe"))
    full = probes.union(targets).join(reps.select("rep", "sig"), "rep").join(sets.select(F.col("id").alias("rep"), "shingles"), "rep")
    return full.groupBy("family", "b", "c").applyInArrow(_across(percent), "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """Components of texts whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; of fewer words, the set is the whole sequence; a null or
    empty text has an empty set and is linked with nothing. Returns one row per input row: ``doc_id, n_shingles,
    component_id`` (smallest id reachable by links), ``kept`` (doc_id = component_id) and ``text_key``, a hash of
    the text. Every row is a text of its own, so rows that repeat an id under other texts are linked only if their
    texts are. A row without an id stands alone: its component is null and it is kept. No rows give no rows. No other
    column is read.

    Equal sets are one class with one representative, so copies of a text are never paired. Signatures of
    representatives are split in chunks, and rows that share a chunk key are tied to the smallest of the key;
    those ties are confirmed on the full sets. Where a key's rows still lie in several components, the rows outside
    the largest component of their family are compared, block by block, with all of the family with which they share
    a key, so that no link is lost to the choice of a representative; pairs are never listed, links alone are.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("text_key"), text_bytes(text_col).alias("text"))
    described = scratch.save(rows.mapInArrow(lean(_describe(width)), "doc_id long, text_key long, n_shingles long, set_hash binary, sig binary"), "described")
    grouped = described.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_key")).alias("holder"), F.min("sig").alias("sig"))
    # a class is named by a number of its own: ids may repeat under other texts
    reps = scratch.save(grouped.select(F.monotonically_increasing_id().alias("rep"), "set_hash", "holder.*", "sig"), "reps")
    stars = scratch.save(
        reps.select("rep", "sig").mapInArrow(lean(_enumerate), "key long, rep long")
        .repartition("key").sortWithinPartitions("key", "rep")  # 16 bytes a row, streamed: a key of any size is held nowhere
        .mapInArrow(lean(_stars), "key long, rep long, leader long"),
        "stars",
    )
    ties = scratch.save(stars.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "ties")
    tied = ties.select(F.col("a").alias("rep")).union(ties.select("b")).distinct()
    needed = scratch.save(reps.select("rep", F.col("doc_id").alias("id"), "text_key").join(tied, "rep"), "needed")
    wanted = spark.sparkContext.broadcast(filter_of_ids(needed, needed.count()))
    texts = rows.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text_key", "text").mapInArrow(lean(_passed(wanted)), "id long, text_key long, text binary")
    texts = texts.join(needed, ["id", "text_key"]).groupBy("id", "text_key", "rep").agg(F.first("text").alias("text"))
    sets = scratch.save(texts.select(F.col("rep").alias("id"), "text").mapInArrow(lean(_sets(width)), "id long, shingles array<long>"), "sets")
    links = scratch.save(_confirmed(ties, sets, percent), "links")
    parts = scratch.save(connected_components(links, scratch, "first"), "parts")

    placed = stars.join(parts, stars.rep == parts.node, "left").select("key", "rep", "leader", F.coalesce("component", "rep").alias("component"))
    open_keys = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("n > 2 and lo < hi")
    loose = scratch.save(placed.where("rep <> leader").join(open_keys.select("key"), "key").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "loose")
    if not loose.isEmpty():
        found = scratch.save(_links_across(connected_components(loose, scratch, "family"), parts, reps, sets, percent, scratch), "found")
        if not found.isEmpty():
            # what was found joins components, so their stars are enough to join them again
            star = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
            parts = scratch.save(connected_components(star.union(found), scratch, "second"), "final-parts")
    scratch.drop("stars", "sets")
    placed = reps.select("set_hash", "rep", "doc_id").join(parts, reps.rep == parts.node, "left").select("set_hash", "doc_id", F.coalesce("component", "rep").alias("part"))
    placed = scratch.save(placed, "placed")
    smallest = placed.groupBy("part").agg(F.min("doc_id").alias("component"))
    classes = scratch.save(placed.join(smallest, "part").select("set_hash", "component"), "classes")
    return described.join(classes, "set_hash", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
        "text_key",
    )


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2).drop("text_key")


OP1_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as shingle from w
), n as (select doc_id, count(*) as n from s group by 1),
df as (select shingle, count(*) as df from s group by 1),
-- texts with a similarity of 0.8 share one of the rarest 20 % of either's shingles
rare as (
  select s.doc_id, s.shingle from s join df using (shingle) join n using (doc_id)
  qualify row_number() over (partition by s.doc_id order by df, shingle) <= any_value(n) over (partition by s.doc_id) - ceil(0.8 * any_value(n) over (partition by s.doc_id)) + 1
), c as (select distinct a.doc_id as a, b.doc_id as b from rare a join rare b on a.shingle = b.shingle and a.doc_id < b.doc_id),
i as (select a, b, count(*) as i from c join s x on x.doc_id = a join s y on y.doc_id = b and y.shingle = x.shingle group by 1, 2),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
both_ways as (select a, b from l union select b, a from l),
reach(doc_id, root) as (select doc_id, doc_id from documents union select r.doc_id, e.b from reach r join both_ways e on e.a = r.root)
select doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(root) as component_id, doc_id = min(root) as kept from reach left join n using (doc_id) group by doc_id
"""
