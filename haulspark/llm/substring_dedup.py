"""Removal of repeated passages by an FM-index per shard (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.llm.bloom import filter_of_ids
from haulspark.llm.common import Scratch, text_bytes
from haulspark.llm.fm_index import FmIndex
from haulspark.llm.tokens import _P, _P_INVERSE, Words, _powers, mix, runs_of_texts

_U = np.uint64
#: Words of an anchor, fewer for short windows; the smallest hash of a window's anchors decides its shard.
GRAM = 16
#: How often a shard that is too large is dealt anew by a further anchor.
LEVELS = 4
#: Windows of one segment at most; a longer run of windows with the same anchor is cut.
LONGEST = 256


def _sums(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * _powers(_P, len(hashes)), out=out[1:])
    return out


def _sequence_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix((sums[hi] - sums[lo]) * _powers(_P_INVERSE, len(sums))[lo])


def segments_of(hashes: np.ndarray, first_word: np.ndarray, window: int, level: int = 0) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor, hash of the words) of runs of windows that share their anchor.

    Windows of equal words have equal anchors wherever they stand. ``first window`` counts from the text's start.
    Each ``level`` has an order of hashes, and so anchors, of its own.
    """
    n, gram = len(hashes), max(1, min(GRAM, window // 3))
    sums = _sums(hashes)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, empty.view(_U), empty.view(_U)
    starts = np.arange(n - gram + 1)
    low = _sequence_hash(sums, starts, starts + gram)
    if level:
        low = mix(low + _U(level))
    span, covered = window - gram + 1, 1
    while covered * 2 <= span:
        low = np.minimum(low[:-covered], low[covered:])
        covered *= 2
    if covered < span:
        low = np.minimum(low[: len(low) - (span - covered)], low[span - covered :])
    text = np.searchsorted(first_word, np.arange(len(low)), "right") - 1
    valid = np.arange(len(low)) + window <= first_word[text + 1]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    at = np.flatnonzero(valid)
    if not len(at):
        return empty, empty, empty, empty.view(_U), empty.view(_U)
    head = np.flatnonzero(valid & new)
    n_in_run = np.diff(np.append(np.searchsorted(at, head), len(at)))
    pieces = -(-n_in_run // LONGEST)
    run = np.repeat(np.arange(len(head)), pieces)
    piece = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = head[run] + piece * LONGEST
    count = np.minimum(LONGEST, n_in_run[run] - piece * LONGEST)
    text = text[begin]
    return text, begin - first_word[text], count, low[begin], _sequence_hash(sums, begin, begin + count + window - 1)


_RUNS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("anchor", pa.int64()), ("segment", pa.int64()), ("windows", pa.int32()), ("start", pa.int32()), ("head", pa.bool_()), ("top", pa.int64())])
_RUNS_DDL = "doc_id long, text_key long, n_words long, sha binary, anchor long, segment long, windows int, start int, head boolean, top long"


def _describe(window: int):
    """A row a text (its words and their digest) and a row a segment; of equal segments in a batch the one of the smallest id is head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in runs_of_texts(batch.column("text")):
                ids, keys = batch.column("id")[lo:hi], batch.column("text_key")[lo:hi]
                words = Words(data, offsets, lower=False)
                whole = data.tobytes()
                shas = [hashlib.sha256(b" ".join(whole[a:b].split())).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                m = hi - lo
                none = pa.nulls
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(np.diff(words.first_word).astype(np.int64)), pa.array(shas, pa.binary()), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.int32()), none(m, pa.int32()), none(m, pa.bool_()), none(m, pa.int64())], schema=_RUNS)
                text, start, count, anchor, segment = segments_of(words.hashes(), words.first_word, window)
                known = np.array(ids.is_valid())
                if not known.all():  # a text without an id is before and after none
                    text, start, count, anchor, segment = (x[known[text]] for x in (text, start, count, anchor, segment))
                if not len(text):
                    continue
                doc, key = ids.fill_null(0).to_numpy()[text], keys.fill_null(0).to_numpy()[text]
                order = np.lexsort((start, key, doc, count, segment, anchor))
                new = np.ones(len(order), bool)
                a, s, c = anchor[order], segment[order], count[order]
                new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (c[1:] != c[:-1])
                first = np.flatnonzero(new)
                top = np.repeat(np.maximum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
                m = len(order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[order]), pa.array(key[order]), none(m, pa.int64()), none(m, pa.binary()), pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(start[order].astype(np.int32)), pa.array(new), pa.array(top)], schema=_RUNS
                )

    return run


_SEGMENTS = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("windows", pa.int32()), ("rep", pa.int64()), ("words", pa.binary())])
_SEGMENTS_DDL = "anchor long, segment long, windows int, rep long, words binary"


def _holders(wanted: Broadcast):
    """Rows whose id may be wanted; a filter of ids lets all of those through, and a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.holds_ids(batch.column("id").fill_null(0).to_numpy())))

    return run


def _cut(window: int):
    """Word hashes of the wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, wanted = batch.column("rep").to_pylist(), batch.column("wanted")
            for lo, hi, data, offsets in runs_of_texts(batch.column("text")):
                words = Words(data, offsets, lower=False)
                hashes = words.hashes()
                cols: list[list] = [[] for _ in _SEGMENTS]
                for i in range(lo, hi):
                    base = words.first_word[i - lo]
                    for w in wanted[i].as_py():
                        begin = base + w["start"]
                        for out, v in zip(cols, (w["anchor"], w["segment"], w["windows"], reps[i], hashes[begin : begin + w["windows"] + window - 1].tobytes()), strict=True):
                            out.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SEGMENTS, strict=True)], schema=_SEGMENTS)

    return run


_AGAIN = pa.schema([*_SEGMENTS, ("sub_anchor", pa.int64()), ("sub_segment", pa.int64()), ("sub_windows", pa.int32()), ("at", pa.int32())])


def _cut_again(window: int, level: int):
    """Segments cut by the anchors of ``level``; a part's anchor is that of its segment and its own together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in _AGAIN]
            for anchor, segment, windows, rep, words in zip(*(batch.column(c).to_pylist() for c in _SEGMENTS.names), strict=True):
                hashes = np.frombuffer(words, _U)
                _, start, count, low, name = segments_of(hashes, np.array([0, len(hashes)]), window, level)
                both = mix(low ^ np.array([anchor], np.int64).view(_U)).view(np.int64)
                for i in range(len(start)):
                    part = hashes[start[i] : start[i] + count[i] + window - 1].tobytes()
                    for out, v in zip(cols, (anchor, segment, windows, rep, part, int(both[i]), int(name.view(np.int64)[i]), int(count[i]), int(start[i])), strict=True):
                        out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _AGAIN, strict=True)], schema=_AGAIN)

    return run


_FOUND = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("windows", pa.int32()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])
_KEY = ["anchor", "segment", "windows"]


def _search(window: int, shard_words: int):
    """Index each shard of whole anchors and search its segments; gives the word spans that an earlier text has too."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        words = [np.frombuffer(r[4], _U) for r in rows]
        bounds = np.cumsum([0, *(len(w) for w in words)])
        owners = np.array([r[3] for r in rows], np.int64)
        index = FmIndex(np.concatenate(words), bounds, owners, window)
        cols: list[list] = [[] for _ in _FOUND]
        for row, smallest in zip(rows, index.smallest_owners(), strict=True):
            gone = np.flatnonzero(smallest < row[3])
            if len(gone):
                cuts = np.flatnonzero(np.diff(gone) > 1)
                a, b = gone[np.concatenate([[0], cuts + 1])], gone[np.append(cuts, len(gone) - 1)] + window
                for out, v in zip(cols, (*row[:3], [{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)]), strict=True):
                    out.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, anchor = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _SEGMENTS.names), strict=True):
                if held >= shard_words and row[0] != anchor:
                    yield search(rows)
                    rows, held = [], 0
                anchor = row[0]
                rows.append(row)
                held += row[2] + window - 1
        if rows:
            yield search(rows)

    return run


def _shifted(spans: str, by: str):
    return F.transform(spans, lambda s: F.struct((s["a"] + F.col(by)).cast("int").alias("a"), (s["b"] + F.col(by)).cast("int").alias("b")))


def _whole(windows: str, window: int):
    return F.array(F.struct(F.lit(0).alias("a"), (F.col(windows) + (window - 1)).cast("int").alias("b")))


def _spans_of(segments: DataFrame, window: int, shard_words: int, most_words: int, scratch: Scratch, level: int = 0) -> DataFrame:
    """(anchor, segment, windows, spans) of distinct ``segments`` that share windows with one of a smaller rep.

    A shard holds whole anchors. The segments of an anchor that hold more than ``most_words`` together are cut anew by
    anchors of the next level, and their parts, each distinct one once, are dealt to shards of their own.
    """
    large = scratch.save(segments.groupBy("anchor").agg(F.sum(F.col("windows") + (window - 1)).alias("n")).where(F.col("n") > most_words).select("anchor"), f"large-{level}")
    split = level < LEVELS and not large.isEmpty()
    found = (
        (segments.join(large, "anchor", "left_anti") if split else segments)
        .select(*_SEGMENTS.names).repartition("anchor").sortWithinPartitions(*_KEY)
        .mapInArrow(_search(window, shard_words), "anchor long, segment long, windows int, spans array<struct<a:int,b:int>>")
    )
    found = scratch.save(found, f"found-{level}")
    if not split:
        return found
    cut = segments.join(large, "anchor", "left_semi").select(*_SEGMENTS.names)
    cut = scratch.save(cut.mapInArrow(_cut_again(window, level + 1), f"{_SEGMENTS_DDL}, sub_anchor long, sub_segment long, sub_windows int, at int"), f"parts-{level}")
    sub = ["sub_anchor", "sub_segment", "sub_windows"]
    distinct = cut.groupBy(*sub).agg(F.min("rep").alias("rep"), F.first("words").alias("words"))
    distinct = scratch.save(distinct.select(*(F.col(c).alias(k) for c, k in zip(sub, _KEY, strict=True)), "rep", "words"), f"distinct-{level}")
    inner = _spans_of(distinct, window, shard_words, most_words, scratch, level + 1)
    told = distinct.select(*_KEY, F.col("rep").alias("low")).join(inner, _KEY, "left").select(*(F.col(k).alias(c) for c, k in zip(sub, _KEY, strict=True)), "low", "spans")
    hit = cut.join(told, sub).withColumn("gone", F.when(F.col("rep") == F.col("low"), F.col("spans")).otherwise(_whole("sub_windows", window))).where("gone is not null")
    more = hit.select(*_KEY, _shifted("gone", "at").alias("gone")).groupBy(*_KEY).agg(F.flatten(F.collect_list("gone")).alias("spans"))
    return found.unionByName(scratch.save(more, f"more-{level}"))


_KEPT = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.binary()), ("kept_text", pa.string())])


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in _KEPT]
            for doc, key, text, spans in zip(*(batch.column(c) for c in ("id", "text_key", "text", "spans")), strict=True):
                words = (text.as_py() or b"").split()
                change = np.zeros(len(words) + 1, np.int64)
                for span in spans.as_py():
                    change[span["a"]] += 1
                    change[min(span["b"], len(words))] -= 1
                keep = np.cumsum(change[:-1]) == 0
                kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
                for out, v in zip(cols, (doc.as_py(), key.as_py(), int(len(words) - keep.sum()), hashlib.sha256(kept).digest(), kept.decode("utf-8", "replace") if with_text else None), strict=True):
                    out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _KEPT, strict=True)], schema=_KEPT)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, shard_words: int = 1 << 18, most_words: int = 1 << 20, with_text: bool = False) -> DataFrame:
    """Removes words covered by a window of ``window`` (2 or more) words whose sequence also starts in a text with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none. Windows are judged on the input. Returns one row
    per input row: ``doc_id, n_words, n_removed, kept_sha256`` (of the kept words joined by one space) and, with
    ``with_text``, ``kept_text`` for rows that lost words. Rows that repeat an id, with equal texts or other ones, do not
    take words from each other; a row without an id keeps all its words and takes none. No rows give no rows. No other
    column is read.

    A window goes to the shard of its anchor, the smallest hash among its runs of 16 words, so equal windows meet
    whatever surrounds them, and anchors of a single text meet nothing and stop there. Equal segments (runs of windows
    with one anchor) are one, held by the text with the smallest id. Each shard's segments are indexed and searched
    backwards through the wavelet matrix; spans found are removed from the holder, and whole segments from the others.
    A shard holds whole anchors, about ``shard_words`` words; an anchor whose distinct segments hold more than
    ``most_words`` (a passage that very many texts set in words of their own) is dealt to shards of its own by further
    anchors.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "substring-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("text_key"), text_bytes(text_col).alias("text"))
    runs = scratch.save(rows.mapInArrow(_describe(window), _RUNS_DDL), "runs")
    parts = runs.where("anchor is not null")
    heads = parts.where("head")
    classes = heads.groupBy(*_KEY).agg(F.min(F.struct("doc_id", "text_key", "start")).alias("rep"), F.max("top").alias("top"))
    span = heads.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("top").alias("hi")).where("lo < hi")
    repeated = scratch.save(
        classes.join(span, "anchor").select(*_KEY, F.col("rep.doc_id").alias("rep"), F.col("rep.text_key").alias("rep_key"), F.col("rep.start").alias("start"), (F.col("rep.doc_id") < F.col("top")).alias("shared")), "repeated"
    )
    wanted = scratch.save(repeated.groupBy("rep", "rep_key").agg(F.collect_list(F.struct(*_KEY, "start")).alias("wanted")), "wanted")
    holders = spark.sparkContext.broadcast(filter_of_ids(wanted.select(F.col("rep").alias("id")), wanted.count()))
    held = rows.mapInArrow(_holders(holders), "id long, text_key long, text binary")
    texts = held.select(F.col("id").alias("rep"), F.col("text_key").alias("rep_key"), "text").join(wanted, ["rep", "rep_key"])
    segments = scratch.save(texts.select("rep", "text", "wanted").mapInArrow(_cut(window), _SEGMENTS_DDL).dropDuplicates(_KEY), "segments")
    found = _spans_of(segments, window, shard_words, most_words, scratch)
    told = scratch.save(repeated.join(found, _KEY, "left").where("shared or spans is not null").select(*_KEY, "rep", "spans"), "told")
    hit = parts.select("doc_id", "text_key", *_KEY, "start").join(told, _KEY).withColumn("spans", F.when(F.col("doc_id") == F.col("rep"), F.col("spans")).otherwise(_whole("windows", window))).where("spans is not null")
    spans = scratch.save(hit.select(F.col("doc_id").alias("id"), "text_key", _shifted("spans", "start").alias("spans")).groupBy("id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    losers = spark.sparkContext.broadcast(filter_of_ids(spans.select("id"), spans.count()))
    touched = rows.mapInArrow(_holders(losers), "id long, text_key long, text binary")
    kept = scratch.save(touched.join(spans, ["id", "text_key"]).mapInArrow(_remove(with_text), "id long, text_key long, n_removed long, sha binary, kept_text string").dropDuplicates(["id", "text_key"]), "kept")
    scratch.drop("segments", "repeated", "wanted")
    out = runs.where("anchor is null").alias("d").join(kept.alias("k"), (F.col("d.doc_id") == F.col("k.id")) & (F.col("d.text_key") == F.col("k.text_key")), "left")
    columns = [
        "d.doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.lower(F.hex(F.coalesce("k.sha", "d.sha"))).alias("kept_sha256"),
    ]
    return out.select(*columns, *(["kept_text"] if with_text else []))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as k from w, lateral (select unnest(range(1, len(w) - 48)) as i)),
first as (select k, min(doc_id) as owner from windows group by 1),
gone as (select distinct doc_id, i + j as i from windows join first using (k), range(50) t(j) where owner < doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from w),
kept as (select x.doc_id, string_agg(word, ' ' order by x.i) as text, count(*) as n from words x left join gone g on g.doc_id = x.doc_id and g.i = x.i where g.i is null group by 1)
select w.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)
"""
