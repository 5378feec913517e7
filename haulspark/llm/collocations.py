"""Phrases whose words keep company: counts by minimal perfect hashing, scores by the worst cut (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.llm.common import Scratch, few_rows_a_batch, lean, text_bytes
from haulspark.llm.perfect_hash import BytesTable, NumberTable
from haulspark.llm.tokens import _LOWER, mix, runs_of_texts
from haulspark.operators.relational import numbered

#: Bytes of text that are cut into words at once, keys a task holds before it gives them away, and counts in a block of the sums.
RUN_BYTES, HELD_KEYS, BLOCK = 1 << 20, 1 << 19, 1024
_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_BLANK[[0x20, 0x09]] = True


def words_of_run(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a run of texts, and of each word in turn its place among them and the number of its piece."""
    data = _LOWER[data]
    breaks = _BREAK[data]
    solid = ~(breaks | _BLANK[data])
    n = len(data)
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[solid])])
    told = words.dictionary_encode()
    piece = np.cumsum(breaks, dtype=np.int32)[starts] + np.searchsorted(offsets, starts, "right")
    return told.dictionary, told.indices.to_numpy().astype(np.int64), piece


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[bytes, pa.Array, np.ndarray, np.ndarray]]:
    """(lang, distinct words, word of each place, piece of each place) of runs of texts of one language."""
    langs = batch.column("lang")
    for lang in pc.unique(langs).to_pylist():
        column = batch.column("text").filter(pc.equal(langs, lang))
        for _, _, data, offsets in runs_of_texts(column, RUN_BYTES):
            yield (lang.encode(), *words_of_run(data, offsets))


_WORDS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _text(values: pa.Array) -> pa.Array:
    return values.cast(pa.large_string()).cast(pa.string())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, words, at, _ in _runs(batch):
            yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(words), pa.string()), _text(words), pa.array(np.bincount(at, minlength=len(words)))], schema=_WORDS)


@dataclass
class Vocabulary:
    """Words of every language that occur often enough, each in a slot, with their counts."""

    table: BytesTable
    langs: pa.Array
    words: pa.Array
    counts: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Vocabulary:
        langs, words = (pa.concat_arrays(rows.column(c).cast(pa.large_binary()).chunks) if len(rows) else pa.array([], pa.large_binary()) for c in ("lang", "phrase"))
        table = BytesTable(cls.keys(langs, words))
        order = pa.array(table.order)
        return cls(table, langs.take(order), words.take(order), rows.column("n").to_numpy()[table.order])

    @staticmethod
    def keys(langs: pa.Array | bytes, words: pa.Array) -> pa.Array:
        """Language and word as one string; no word holds a line feed."""
        lang = pa.scalar(langs, pa.large_binary()) if isinstance(langs, bytes) else langs
        return pc.binary_join_element_wise(lang, words, pa.scalar(b"\n", pa.large_binary()))


def codes_of_run(slots: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Slots of a run's words, with -1 where no phrase goes on: between pieces and for words that are too rare."""
    cut = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    out = np.insert(slots, cut, -1)
    gap = out < 0
    alone = ~gap & np.append(True, gap[:-1]) & np.append(gap[1:], True)  # no phrase holds it
    out = np.where(alone, -1, out)
    gap = out < 0
    return out[~(gap & np.append(True, gap[:-1]))].astype(np.int32)


def _code(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = vocabulary.value
        for batch in batches:
            for lang, words, at, piece in _runs(batch):
                slots = known.table.find(Vocabulary.keys(lang, words))[at] if len(words) else at
                codes = codes_of_run(slots, piece) if len(slots) else slots.astype(np.int32)
                if len(codes):
                    yield pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary())], names=["codes"])

    return run


def longer_keys(codes: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of phrases of ``size`` words whose first and last ``size - 1`` words are both frequent, by ``before``, the slots of those.

    A key holds the slot of the first words and that of the last word, so it is the phrase and not a hash of it.
    """
    end = len(codes) - size + 1
    if end <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((before[:end] >= 0) & (before[1 : end + 1] >= 0))
    return at, (before[at] << 32) | codes[at + size - 1]


def phrase_slots(codes: np.ndarray, tables: list[NumberTable]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, slot of the frequent phrase of that size that begins at each place, or -1), from single words on."""
    codes = codes.astype(np.int64)
    now = codes
    yield 1, now
    for size, table in enumerate(tables, start=2):
        at, keys = longer_keys(codes, now, size)
        now = np.full(len(codes), -1, np.int64)
        now[at] = table.find(keys)
        yield size, now


_KEYS = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _screen(tables):
    """How often each key of the next size occurs, in any task; only keys both of whose parts are frequent are formed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[NumberTable] = tables.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, inverse, np.concatenate([c for _, c in held]))
            return keys, counts

        for batch in batches:
            for raw in batch.column("codes"):
                codes = np.frombuffer(raw.as_py(), np.int32)
                for size, slots in phrase_slots(codes, known):
                    pass
                held.append(np.unique(longer_keys(codes.astype(np.int64), slots, size + 1)[1], return_counts=True))
                if sum(len(k) for k, _ in held) > HELD_KEYS:
                    held = [merged()]
                    if len(held[0][0]) > HELD_KEYS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], schema=_KEYS)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], schema=_KEYS)

    return run


_SUMS = pa.schema([("size", pa.int32()), ("block", pa.int32()), ("lane", pa.int32()), ("counts", pa.binary())])


def _blocks(sums: dict[int, np.ndarray], lane: int) -> Iterator[pa.RecordBatch]:
    rows = [(size, b, lane, counts[b * BLOCK : (b + 1) * BLOCK].tobytes()) for size, counts in sums.items() for b in range(-(-len(counts) // BLOCK)) if counts[b * BLOCK : (b + 1) * BLOCK].any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _SUMS.types, strict=True)], schema=_SUMS)


def _count(tables, lanes: int):
    """Counts by slot of the phrases of every size in a task's texts, as blocks of one array a size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[NumberTable] = tables.value
        sums = {size: np.zeros(len(t), np.int64) for size, t in enumerate(known, start=2)}
        for batch in batches:
            for raw in batch.column("codes"):
                for size, slots in phrase_slots(np.frombuffer(raw.as_py(), np.int32), known):
                    if size > 1:
                        np.add.at(sums[size], slots[slots >= 0], 1)
        yield from _blocks(sums, TaskContext.get().partitionId() % lanes)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of blocks: an inner node of the tree."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for size, block, raw in zip(batch.column("size").to_pylist(), batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts = np.frombuffer(raw, np.int64)
            sums[size, block] = sums[size, block] + counts if (size, block) in sums else counts
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in sums], pa.int32()), pa.array([b for _, b in sums], pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], schema=_SUMS)


_CUT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())])


def cut_scores(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """floor(2000000 * a / (left + right)), in whole numbers of any size."""
    if (a.max(initial=0) < 1 << 42) and (left.max(initial=0) < 1 << 61) and (right.max(initial=0) < 1 << 61):
        return 2_000_000 * a // (left + right)
    return (2_000_000 * a.astype(object) // (left.astype(object) + right.astype(object))).astype(np.int64)


def _cut(size: int, shared):
    """Of each phrase of ``size`` words its count and its lowest-scoring cut, all counts read by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tables, counts = shared.value
        tables_of, counts_of = dict(enumerate(tables, start=2)), {1: known.counts, **counts}

        def slots_of(words: np.ndarray) -> np.ndarray:
            now = words[:, 0]
            for k in range(1, words.shape[1]):
                now = tables_of[k + 1].find((now << 32) | words[:, k])
            return now

        for batch in batches:
            keys = batch.column("key").to_numpy()
            words, slot = np.empty((len(keys), size), np.int64), tables_of[size].find(keys)
            now, at = keys, slot
            for k in range(size - 1, 0, -1):
                words[:, k], at = now & 0xFFFFFFFF, now >> 32
                now = tables_of[k].keys[at] if k > 1 else at
            words[:, 0] = now
            a = counts_of[size][slot]
            best = left = right = None
            for k in range(1, size):
                one, two = counts_of[k][slots_of(words[:, :k])], counts_of[size - k][slots_of(words[:, k:])]
                score = cut_scores(a, one, two)
                if best is None:
                    best, left, right = score, one, two
                else:
                    lower = score < best
                    best, left, right = np.where(lower, score, best), np.where(lower, one, left), np.where(lower, two, right)
            phrase = pc.binary_join_element_wise(*[known.words.take(pa.array(words[:, k])) for k in range(size)], pa.scalar(b" ", pa.large_binary()))
            yield pa.RecordBatch.from_arrays([_text(known.langs.take(pa.array(words[:, 0]))), _text(phrase), pa.array(np.full(len(keys), size, np.int32)), *[pa.array(c) for c in (a, left, right, best)]], schema=_CUT)

    return run


#: The score in SQL, in whole numbers of any size.
_SCORE = "cast(2000000 * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + r) as bigint)"


def _plain_phrases(longest: int):
    """Every phrase of two words and more of a run as text with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, at, piece in _runs(batch):
                before = at
                for size in range(2, longest + 1):
                    end = len(at) - size + 1
                    if end <= 0:
                        break
                    place = np.flatnonzero(piece[:end] == piece[size - 1 :])
                    _, first, inverse, n = np.unique((before[place] << 32) | at[place + size - 1], return_index=True, return_inverse=True, return_counts=True)
                    before = np.zeros(len(at), np.int64)
                    before[place] = inverse
                    for lo in range(0, len(first), 1 << 16):
                        some = place[first[lo : lo + (1 << 16)]]
                        phrase = pc.binary_join_element_wise(*[words.take(pa.array(at[some + k])) for k in range(size)], pa.scalar(b" ", pa.large_binary()))
                        yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(some), pa.string()), _text(phrase), pa.array(n[lo : lo + (1 << 16)])], schema=_WORDS)

    return run


def _plainly(rows: DataFrame, words: DataFrame, longest: int, least: int) -> DataFrame:
    """What ``_by_slots`` gives, from shuffled texts of phrases: the way for more words than may be sent out."""
    scratch = Scratch(rows.sparkSession, "collocations-plain")
    counted = scratch.save(rows.mapInArrow(lean(_plain_phrases(longest)), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
    every = counted.unionByName(words)
    split = F.split("phrase", " ")
    cut = counted.select("lang", "phrase", F.col("n").alias("a"), F.size(split).alias("size"), split.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cut = cut.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cut = cut.join(every.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(every.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    lowest = cut.withColumn("score", F.expr(_SCORE)).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score")


_PHRASES = pa.schema([("key", pa.binary()), ("n", pa.int64())])
#: Bits of a map of frequent phrases, for each of them and at most.
MARK_BITS, MOST_MARKS = 16, 1 << 28


def _as_keys(words: np.ndarray) -> pa.Array:
    """Rows of slots as binary keys, four bytes a word."""
    words = np.ascontiguousarray(words, np.int32)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * words.shape[1]), len(words), [None, pa.py_buffer(words)]).cast(pa.binary())


def _mark_of(columns: list[np.ndarray], n_bits: int) -> np.ndarray:
    """The bit of each phrase, given by the slots of its words, in a map of ``n_bits``."""
    out = columns[0].astype(np.uint64)
    for c in columns[1:]:
        out = mix(out * np.uint64(3) + c.astype(np.uint64))
    return out & np.uint64(n_bits - 1)


def _ids(marks, size: int):
    """Phrases of ``size`` frequent words of each run with their counts, where maps of the shorter sizes do not rule a part out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[np.ndarray] = marks.value
        for batch in batches:
            for raw in batch.column("codes"):
                codes = np.frombuffer(raw.as_py(), np.int32)
                if len(codes) < size:
                    continue
                likely = codes >= 0
                for k, bits in enumerate(known, start=2):
                    likely = likely[:-1] & likely[1:]
                    at = np.flatnonzero(likely)
                    mark = _mark_of([codes[at + i] for i in range(k)], 64 * len(bits))
                    likely[at] = bits[mark >> np.uint64(6)] >> (mark & np.uint64(63)) & np.uint64(1)
                at = np.flatnonzero(likely[:-1] & likely[1:])
                rank = codes[at].astype(np.int64)
                for k in range(1, size):
                    _, first, rank, n = np.unique(rank << 32 | codes[at + k], return_index=True, return_inverse=True, return_counts=True)
                if len(at):
                    yield pa.RecordBatch.from_arrays([_as_keys(np.stack([codes[at[first] + k] for k in range(size)], 1)), pa.array(n)], schema=_PHRASES)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of ``_screen`` for two words as binary keys."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        yield pa.RecordBatch.from_arrays([_as_keys(np.stack([keys >> 32, keys & 0xFFFFFFFF], 1)), batch.column("n")], schema=_PHRASES)


def _marks(phrases: DataFrame, size: int) -> np.ndarray:
    """A map of bits in which those of all ``phrases`` of one size are set; its size is bounded."""
    n_bits = max(64, min(MOST_MARKS, 1 << (MARK_BITS * phrases.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.int32).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array(_mark_of(list(words.T), n_bits).astype(np.int64))], names=["mark"])

    of = F.col("mark")
    told = phrases.select("key").mapInArrow(lean(run), "mark long").groupBy(F.shiftright(of, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(mark & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, np.uint64)
    out[told.column("at").to_numpy()] = told.column("bits").to_numpy().view(np.uint64)
    return out


def _by_ids(coded: DataFrame, pairs: DataFrame, sent, longest: int, least: int, scratch: Scratch) -> DataFrame:
    """What ``_by_slots`` gives where the frequent phrases are more than may be sent out: counts and cuts by shuffles of the words' slots.

    ``pairs`` are the frequent phrases of two words (key, n) that were counted already. Of longer ones only those are formed whose parts may be frequent by maps of
    bits, which are sent out; a bit that is set wrongly adds a phrase that is counted and dropped.
    """
    spark, known = coded.sparkSession, sent.value
    sizes, marks = [scratch.save(pairs.mapInArrow(lean(_pairs), "key binary, n long"), "phrases-2")], []
    for size in range(3, longest + 1):
        marks.append(_marks(sizes[-1], size - 1))
        so_far = spark.sparkContext.broadcast(list(marks))
        with few_rows_a_batch(spark, 4):
            counted = coded.mapInArrow(lean(_ids(so_far, size)), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            sizes.append(scratch.save(counted, f"phrases-{size}"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([_as_keys(slots[:, None]), pa.array(sent.value.counts[slots])], schema=_PHRASES)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            for k in np.unique(size):
                some = batch.filter(pa.array(size == k))
                words = np.frombuffer(b"".join(some.column("key").to_pylist()), np.int32).reshape(-1, k)
                phrase = pc.binary_join_element_wise(*[sent.value.words.take(pa.array(c)) for c in words.T], pa.scalar(b" ", pa.large_binary()))
                yield pa.RecordBatch.from_arrays([_text(sent.value.langs.take(pa.array(words[:, 0]))), _text(phrase), *[some.column(c) for c in ("size", "a", "l", "r", "score")]], schema=_CUT)

    phrases = sizes[0]
    for more in sizes[1:]:
        phrases = phrases.unionByName(more)
    every = phrases.unionByName(spark.range(len(known.counts)).mapInArrow(lean(single), "key binary, n long"))
    size = (F.octet_length("key") / 4).cast("int")
    cut = phrases.select("key", F.col("n").alias("a"), size.alias("size"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("key", "a", "size", "k", F.col("key").substr(F.lit(1), F.col("k") * 4).alias("left"), F.col("key").substr(F.col("k") * 4 + 1, F.col("size") * 4).alias("right"))
    cut = cut.join(every.select(F.col("key").alias("left"), F.col("n").alias("l")), "left").join(every.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    lowest = cut.withColumn("score", F.expr(_SCORE)).groupBy("key", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("key", "size", "a", "c.l", "c.r", "c.score")
    return lowest.mapInArrow(lean(spelt), "lang string, phrase string, size int, a long, l long, r long, score long")


def _by_slots(rows: DataFrame, words: DataFrame, longest: int, least: int, most_keys: int, most_bytes: int, scratch: Scratch) -> DataFrame | None:
    """``lang, phrase, size, a, l, r, score`` of every frequent phrase; None if the frequent words are more than may be sent out."""
    spark = rows.sparkSession
    n_words, n_bytes = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase") + F.octet_length("lang")), F.lit(0))).first()
    if n_words > most_keys or n_bytes > most_bytes:
        return None
    known = Vocabulary.of(words.orderBy("lang", "phrase").toArrow())
    sent = spark.sparkContext.broadcast(known)
    coded = scratch.save(rows.mapInArrow(lean(_code(sent)), "codes binary"), "coded")
    tables: list[NumberTable] = []
    with few_rows_a_batch(spark, 4):
        for size in range(2, longest + 1):
            so_far = spark.sparkContext.broadcast(list(tables))
            screened = coded.mapInArrow(lean(_screen(so_far)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            screened = scratch.save(screened, f"keys-{size}")
            if screened.count() + sum(map(len, tables)) > most_keys:
                break
            tables.append(NumberTable(np.sort(screened.select("key").toArrow().column("key").to_numpy())))
    if len(tables) < longest - 1:
        return _by_ids(coded, spark.read.schema("key long, n long").parquet(f"{scratch.path}/keys-2"), sent, longest, least, scratch)
    with few_rows_a_batch(spark, 4):
        all_tables = spark.sparkContext.broadcast(tables)
        lanes = max(1, round(coded.rdd.getNumPartitions() ** 0.5))
        kind = "size int, block int, lane int, counts binary"
        summed = coded.mapInArrow(lean(_count(all_tables, lanes)), kind).repartition("size", "block", "lane").mapInArrow(_add, kind).repartition("size", "block").mapInArrow(_add, kind)
        counts = {size: np.zeros(len(t), np.int64) for size, t in enumerate(tables, start=2)}
        for size, block, _, raw in summed.collect():
            part = np.frombuffer(raw, np.int64)
            counts[size][block * BLOCK : block * BLOCK + len(part)] += part
    shared = spark.sparkContext.broadcast((known, tables, counts))
    cuts = [spark.read.schema("key long").parquet(f"{scratch.path}/keys-{size}").mapInArrow(lean(_cut(size, shared)), "lang string, phrase string, size int, a long, l long, r long, score long") for size in counts]
    out = cuts[0]
    for more in cuts[1:]:
        out = out.unionByName(more)
    return out


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, covered: int = 80, most: int = 2000, text_col: str = "text", lang_col: str = "lang", most_keys: int = 4 << 20, most_bytes: int = 64 << 20) -> DataFrame:
    """The ``most`` phrases of each language that hold together best even at their weakest cut.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces at blanks and tabs into words. A phrase is 2 to ``longest`` consecutive
    words of a piece that occur ``least`` times or more in a language. Returns ``lang, rank, phrase, a`` (occurrences), ``l, r`` (those of the parts of its lowest-scoring cut), ``n`` (words
    of the language) and ``score = floor(2000000 a / (l + r))``, without phrases that stand in a longer one with ``covered`` percent of their occurrences or more. Null texts are empty, a
    null language is ``und``; repeated rows count each. Ids are not looked at, nor are other columns. No rows give no rows.

    Words are counted by a shuffle. Frequent words get slots of a minimal perfect hash and texts become slots. For each size the phrases whose two parts are frequent are
    gathered, those that occur ``least`` times form a minimal perfect hash with stored keys, and at the end each task counts by slot into arrays that are summed in a
    tree; cuts read the arrays. Frequent words and phrases are sent to all tasks only up to ``most_keys`` of each and ``most_bytes`` of words. With more phrases the same
    rows come from shuffles of phrases as slots, with more words from shuffles of the phrases as text.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "collocations")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text_bytes(text_col), F.lit(b"")).alias("text"))
    words = scratch.save(rows.mapInArrow(lean(_count_words), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
    total = scratch.save(words.groupBy("lang").agg(F.sum("n").alias("n")), "total")
    frequent = words.where(F.col("n") >= least)
    found = _by_slots(rows, frequent, longest, least, most_keys, most_bytes, scratch)
    found = scratch.save(_plainly(rows, frequent, longest, least) if found is None else found, "found")
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: F.array_join(F.slice(w, i, s), " "))))
    longer = found.where("size > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    inside = F.coalesce(F.lit(100).cast("decimal(19,0)") * F.col("longer") >= F.lit(covered).cast("decimal(19,0)") * F.col("a"), F.lit(False))
    kept = found.join(longer, ["lang", "phrase"], "left").where(~inside).select("lang", "phrase", "a", "l", "r", "score")
    placed = scratch.save(numbered(kept, [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "at"), "placed")
    first = scratch.save(placed.groupBy("lang").agg(F.min("at").alias("first")).join(total, "lang"), "first")
    ranked = placed.join(first, "lang").withColumn("rank", F.col("at") - F.col("first") + 1).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
with t as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (select row_number() over () as p, lang, piece from (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from t)),
listed as (select p, lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
words as (select p, lang, unnest(w) as w1, generate_subscripts(w, 1) as i from listed),
runs as (select lang, w1, lead(w1, 1) over x as w2, lead(w1, 2) over x as w3, lead(w1, 3) over x as w4 from words window x as (partition by p order by i)),
grams as (
  select lang, 1 as size, w1 as phrase from runs union all select lang, 2, w1 || ' ' || w2 from runs where w2 is not null
  union all select lang, 3, concat_ws(' ', w1, w2, w3) from runs where w3 is not null union all select lang, 4, concat_ws(' ', w1, w2, w3, w4) from runs where w4 is not null
),
f as materialized (select lang, size, phrase, count(*)::hugeint as f from grams group by all),
totals as (select lang, sum(f) as n from f where size = 1 group by lang),
cand as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from f where size >= 2 and f >= 30),
cut as materialized (select lang, size, phrase, a, k, array_to_string(w[1 : k], ' ') as one, array_to_string(w[k + 1 :], ' ') as two from (select *, unnest(range(1, size)) as k from cand)),
cut_left as materialized (select cut.*, f.f as l from cut join f on f.lang = cut.lang and f.phrase = cut.one),
cuts as materialized (select c.*, f.f as r, 2000000 * a // (l + f.f) as score from cut_left c join f on f.lang = c.lang and f.phrase = c.two),
low as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (select lang, a, array_to_string(w[i : i + s - 1], ' ') as phrase from (select lang, a, w, s, unnest(range(1, len(w) - s + 2)) as i from cand, range(2, 4) r(s) where s < len(w))),
longest as (select lang, phrase, max(a) as m from inner_ group by all),
ranked as (
  select low.lang, low.phrase, low.a, l, r, n, score, row_number() over (partition by low.lang order by score desc, low.a desc, low.phrase) as rank
  from low join totals using (lang) left join longest on longest.lang = low.lang and longest.phrase = low.phrase where m is null or 100 * m < 80 * low.a
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""
