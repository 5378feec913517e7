"""SentencePiece encoding and decoding by suffix-array matching (operator 7)."""

from __future__ import annotations

import heapq
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulspark.llm.common import lean
from haulspark.sources.shipping import ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message; fixed-size values come as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Vocabulary:
    """Pieces of a model file, and which of them match text."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    model_type: int = UNIGRAM
    dummy_prefix: bool = True
    squeeze: bool = True
    byte_ids: dict[int, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        pieces, scores, kinds = [], [], []
        out = cls(pieces, np.zeros(0), np.zeros(0))
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                out.model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("only models that leave characters as they are can be read")
                out.dummy_prefix, out.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
                if not rules.get(5, 1):
                    raise ValueError("only models that write spaces as U+2581 can be read")
        if _USER in kinds:
            raise ValueError("user-defined pieces are not supported")
        if out.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        out.scores, out.kinds = np.array(scores, np.float32), np.array(kinds, np.int32)
        out.byte_ids = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if kinds[i] == _BYTE}
        return out

    def __post_init__(self):
        self._ready = False

    def prepare(self) -> Vocabulary:
        """Tables that follow from the pieces, made once a worker."""
        if self._ready:
            return self
        self.unknown = int(np.flatnonzero(self.kinds == _UNKNOWN)[0]) if (self.kinds == _UNKNOWN).any() else 0
        normal = [(p, i) for i, p in enumerate(self.pieces) if self.kinds[i] == _NORMAL and p]
        self.matching = np.array([i for _, i in normal], np.int32)
        self.longest = max((len(p) for p, _ in normal), default=1)
        if self.longest > 63:
            raise ValueError("pieces of more than 63 characters are not supported")
        self.alphabet = sorted({c for p, _ in normal for c in p})
        place = {c: i for i, c in enumerate(self.alphabet)}
        # places in the alphabet of each matching piece's characters, -1 after its end
        self.spelling = np.full((len(normal), self.longest), -1, np.int32)
        for row, (p, _) in zip(self.spelling, normal, strict=True):
            row[: len(p)] = [place[c] for c in p]
        joined = {c for p, _ in normal if len(p) > 1 for c in p}
        # within a word, a character that no longer piece holds stands alone and parts what is around it
        self.joined = joined
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p, _ in normal)
        table = []
        for i, p in enumerate(self.pieces):
            kind = self.kinds[i]
            table.append(bytes([int(p[1:-1], 16)]) if kind == _BYTE else p.replace(SPACE, " ").encode() if kind == _NORMAL else " ⁇ ".encode() if kind == _UNKNOWN else b"")
        self.table = table
        self.table_size = np.array([len(x) for x in table], np.int64)
        self.table_start = np.cumsum(self.table_size) - self.table_size
        self.table_bytes = np.frombuffer(b"".join(table), np.uint8)
        self._ready = True
        return self

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def chunks(self, text: str) -> list[str]:
        """Parts of a normalised text across whose borders no piece reaches: words with the spaces before them."""
        if not text or not self.by_words:
            return [text] if text else []
        out: list[str] = []
        lines = text.split("\n") if "\n" not in self.joined else [text]
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            words = line.split(SPACE)
            if words[0]:
                out.append(words[0])
            if SPACE + SPACE not in line:
                out += [SPACE + w for w in words[1:]]
                continue
            spaces = 0
            for word in words[1:]:
                spaces += 1
                if word:
                    out.append(SPACE * spaces + word)
                    spaces = 0
            if spaces:
                out.append(SPACE * spaces)
        return out


#: Characters whose suffixes are sorted at once; a longer text is taken in strips that overlap by the longest piece.
STRIP = 1 << 19
#: Chunks longer than this are parted where no piece reaches across.
LONG = 4096


def occurrences(v: Vocabulary, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, size, piece) of every occurrence of a piece in ``points``, sorted by place and size, strip after strip."""
    for lo in range(0, max(len(points), 1), STRIP):
        place, size, piece = _occurrences_in(v, points[lo : lo + STRIP + v.longest])
        mine = place < STRIP
        yield place[mine] + lo, size[mine], piece[mine]


def _occurrences_in(v: Vocabulary, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By a suffix array: suffixes are sorted by as many characters as the longest piece has, and each piece is searched for."""
    n, width = len(points), v.longest
    known = np.array([ord(c) for c in v.alphabet], np.uint32)
    used = known[np.isin(known, points)]
    # codes are 1, 2, ... in the order of code points; 0 is what no piece holds, and the end of a chunk
    code = np.where(np.isin(points, used), np.searchsorted(used, points) + 1, 0)
    one = np.uint8 if len(used) < 256 else np.dtype(">u2")
    size = np.dtype(one).itemsize
    n_words = -(-width // (8 // size))
    padded = np.zeros(n + n_words * (8 // size), one)
    padded[:n] = code
    grid = np.lib.stride_tricks.sliding_window_view(padded, n_words * (8 // size))[:n].copy()
    # what follows the first 0 lies in another chunk
    open_ = np.logical_and.accumulate(grid != 0, axis=1)
    grid[~open_] = 0
    keys = grid.view(">u8").reshape(n, n_words)
    order = np.lexsort(keys.astype(np.uint64).T[::-1])
    ordered = np.ascontiguousarray(grid[order]).view(f"S{n_words * 8}").reshape(-1)
    codes = np.zeros(len(known) + 1, one)  # the last is for places after a piece's end
    codes[:-1][np.isin(known, used)] = np.arange(1, len(used) + 1)
    spelled = codes[v.spelling]
    sizes = (v.spelling >= 0).sum(axis=1)
    fits = (spelled > 0).sum(axis=1) == sizes
    spelled, sizes, ids = spelled[fits], sizes[fits], v.matching[fits]
    low = np.zeros((len(ids), n_words * (8 // size)), one)
    low[:, :width] = spelled
    high = np.where(np.arange(n_words * (8 // size)) < sizes[:, None], low, np.iinfo(one).max).astype(one)
    as_text = lambda x: np.ascontiguousarray(x).view(f"S{n_words * 8}").reshape(-1)
    first = np.searchsorted(ordered, as_text(low), "left")
    count = np.searchsorted(ordered, as_text(high), "right") - first
    piece = np.repeat(np.arange(len(ids)), count)
    place = order[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    edge = np.argsort(place * 64 + sizes[piece])
    return place[edge], sizes[piece[edge]].astype(np.int64), ids[piece[edge]]


def part_long(v: Vocabulary, chunk: str) -> list[str]:
    """Parts of a long chunk between which no piece reaches across, so that each can be encoded on its own."""
    points = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)
    across = np.zeros(len(points) + 1, np.int32)  # pieces that cover the border before each place, as a running sum
    for place, size, _ in occurrences(v, points):
        np.add.at(across, place + 1, 1)
        np.add.at(across, place + size, -1)
    cuts = np.flatnonzero(np.cumsum(across)[1 : len(points)] == 0) + 1
    bounds = [0, *cuts.tolist(), len(points)]
    return [chunk[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class Matcher:
    """All occurrences of pieces in a batch of chunks, as edges sorted by position, and the paths along them.

    ``first`` is where each place's edges begin in ``pieces``; bit ``s`` of ``sizes`` tells that one of ``s``
    characters begins there, so an edge is found by counting the bits below its own.
    """

    def __init__(self, vocabulary: Vocabulary, chunks: list[str]):
        v = self.v = vocabulary
        text = "\0".join(chunks) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.array([len(c) for c in chunks], np.int64)
        self.begins = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.points = points
        self.sizes = np.zeros(len(points), np.uint64)
        count = np.zeros(len(points), np.int64)
        pieces = []
        for place, size, piece in occurrences(v, points):
            heads = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else place
            self.sizes[place[heads]] = np.bitwise_or.reduceat(np.uint64(1) << size.astype(np.uint64), heads) if len(heads) else 0
            count[place[heads]] = np.diff(np.append(heads, len(place)))
            pieces.append(piece)
        self.pieces = np.append(np.concatenate(pieces), -1).astype(np.int32)
        self.first = np.cumsum(count) - count

    def piece(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The piece of ``size`` (below 64) characters at each place, -1 where there is none."""
        bit = np.uint64(1) << size.astype(np.uint64)
        mask = self.sizes[place]
        below = np.bitwise_count(mask & (bit - np.uint64(1)))
        return np.where(mask & bit, self.pieces[self.first[place] + below], -1)

    def encode(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks end to end, how many each chunk has)."""
        span = self._merge() if self.v.model_type == BPE else self._shortest()
        begin = np.flatnonzero(span > 0)
        ids = self.piece(begin, np.minimum(span[begin], 63))
        spelled = ids < 0
        chunk = np.searchsorted(self.begins, begin, "right") - 1
        if not spelled.any():
            return ids, np.bincount(chunk, minlength=len(self.lengths))
        parts = []
        for point in self.points[begin[spelled]].tolist():
            data = chr(point).encode("utf-8", "replace")
            parts.append([self.v.byte_ids[b] for b in data] if self.v.byte_ids else [self.v.unknown])
        size = np.ones(len(ids), np.int64)
        size[spelled] = [len(p) for p in parts]
        out = np.repeat(ids, size)
        out[np.repeat(spelled, size)] = [i for p in parts for i in p]
        return out, np.bincount(chunk, weights=size, minlength=len(self.lengths)).astype(np.int64)

    def _merge(self) -> np.ndarray:
        """Length of the symbol that begins at each place, 0 within one: pairs join by the best edge over both.

        All chunks go on together; in each round every chunk joins its best pair, the leftmost of equals.
        """
        n = len(self.points)
        span = np.ones(n, np.int64)
        span[self.begins + self.lengths] = 0
        if n == 0:
            return span
        long = self.lengths > 256
        scores = np.append(self.v.scores, -np.inf).astype(np.float64)
        chunk_of = np.repeat(np.arange(len(self.lengths)), self.lengths + 1)
        at = np.flatnonzero((span > 0) & ~long[chunk_of])
        while len(at):
            chunk = chunk_of[at]
            pair = np.zeros(len(at), bool)
            pair[:-1] = chunk[1:] == chunk[:-1]
            size = np.full(len(at), 0)
            size[:-1] = span[at[:-1]] + span[at[1:]]
            fits = pair & (size <= self.v.longest)
            score = np.full(len(at), -np.inf)
            score[fits] = scores[self.piece(at[fits], size[fits])]
            head = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            best = np.maximum.reduceat(score, head)
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(at))))
            hit = np.flatnonzero((score == best[group]) & np.isfinite(score))
            if not len(hit):
                break
            hit = hit[np.append(True, group[hit][1:] != group[hit][:-1])]
            span[at[hit]] = size[hit]
            span[at[hit + 1]] = 0
            live = np.isfinite(best)[group]
            live[hit + 1] = False
            at = at[live]
        for c in np.flatnonzero(long).tolist():
            self._merge_long(int(self.begins[c]), int(self.lengths[c]), span, scores)
        return span

    def _merge_long(self, begin: int, n: int, span: np.ndarray, scores: np.ndarray) -> None:
        """The same for one long chunk, whose pairs wait in a heap of whole numbers (rank of the piece, place)."""
        size, after, before = array("q", [1]) * n, array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        kinds = np.unique(-scores[:-1], return_inverse=True)[1]  # ranks; equal scores have equal ranks
        masks, first = self.sizes[begin : begin + n], self.first[begin : begin + n]
        heap: list[int] = []

        def rank(i: int) -> int:
            j = after[i]
            total = size[i] + size[j] if j < n else 64
            if total > 63:
                return -1
            mask = int(masks[i])
            if not mask >> total & 1:
                return -1
            return int(kinds[self.pieces[first[i] + (mask & ((1 << total) - 1)).bit_count()]])

        def offer(i: int) -> None:
            r = rank(i) if i >= 0 else -1
            if r >= 0:
                heapq.heappush(heap, r << 40 | i)

        for i in range(n - 1):
            offer(i)
        while heap:
            top = heapq.heappop(heap)
            i = top & ((1 << 40) - 1)
            if not size[i] or rank(i) != top >> 40:
                continue
            j = after[i]
            size[i], size[j], after[i] = size[i] + size[j], 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        span[begin : begin + n] = size

    def _shortest(self) -> np.ndarray:
        """The best path of a unigram model: edges are relaxed place after place in all chunks together.

        An unknown character costs ten below the worst piece. Of equal paths the one found first stays.
        """
        n = len(self.points)
        known = self.v.scores[self.v.kinds == _NORMAL]
        worst = np.float32((known.min() if len(known) else 0) - 10)
        best = np.full(n + 1, -np.inf, np.float32)
        back = np.zeros(n + 1, np.int64)
        best[self.begins] = 0
        for step in range(int(self.lengths.max(initial=0))):
            at = self.begins[self.lengths > step] + step
            left = (self.lengths[self.lengths > step] - step)
            for size in range(1, self.v.longest + 1):
                piece = self.piece(at, np.full(len(at), size))
                ok = (size <= left) & ((piece >= 0) | (size == 1))
                value = best[at] + np.where(piece >= 0, self.v.scores[piece], worst).astype(np.float32)
                to = at[ok] + size
                better = value[ok] > best[to]
                best[to[better]], back[to[better]] = value[ok][better], size
        span = np.zeros(n, np.int64)
        ends = self.begins + self.lengths
        live = self.lengths > 0
        begins, ends = self.begins[live], ends[live]
        while len(ends):
            start = ends - back[ends]
            span[start] = back[ends]
            more = start > begins
            begins, ends = begins[more], start[more]
        return span


class Encoder:
    """Encodes texts in batches; chunks met before are looked up, new ones are matched together."""

    def __init__(self, vocabulary: Vocabulary, most_chunks: int = 600_000):
        self.v, self.most = vocabulary.prepare(), most_chunks
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        ids, counts, held, lo = [self.ids], [self.counts], 0, 0
        for hi, chunk in enumerate(chunks):
            held += len(chunk) + 1
            if held >= 1 << 19 or hi == len(chunks) - 1:
                got, n = Matcher(self.v, chunks[lo : hi + 1]).encode()
                ids.append(got)
                counts.append(n)
                held, lo = 0, hi + 1
        self.ids, self.counts = np.concatenate(ids), np.concatenate(counts)
        self.starts = np.cumsum(self.counts) - self.counts
        for chunk in chunks:
            self.known[chunk] = len(self.known)

    def _parts(self, text: str) -> list[str]:
        chunks = self.v.chunks(self.v.normalise(text))
        if len(text) <= LONG or max(map(len, chunks), default=0) <= LONG:
            return chunks
        return [part for c in chunks for part in (part_long(self.v, c) if len(c) > LONG else [c])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each begins and the last ends)."""
        if len(self.known) > self.most:
            self._clear()
        parts = [self._parts(t) for t in texts]
        new = dict.fromkeys(c for p in parts for c in p if c not in self.known)
        if new:
            self._learn(list(new))
        sizes = np.array([len(p) for p in parts], np.int64)
        which = np.fromiter((self.known[c] for p in parts for c in p), np.int64, int(sizes.sum()))
        counts = self.counts[which]
        total = int(counts.sum())
        ids = self.ids[np.repeat(self.starts[which] - (np.cumsum(counts) - counts), counts) + np.arange(total)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)] if len(sizes) else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], ends]).astype(np.int64)


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of ``ids``: pieces end to end, byte pieces as bytes, the space put before the text taken off."""
    data, bounds = decode_all(vocabulary, np.asarray(ids, np.int64), np.array([0, len(ids)]))
    return data[bounds[0] : bounds[1]].tobytes().decode("utf-8", "replace")


def decode_all(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row bounds) of the texts of ``ids[bounds[i]:bounds[i + 1]]``, by gathering the pieces' bytes."""
    v = vocabulary.prepare()
    size = v.table_size[ids]
    ends = np.cumsum(size)
    data = v.table_bytes[np.repeat(v.table_start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    at = np.concatenate([[0], ends])[bounds]
    if v.dummy_prefix:
        lead = at[:-1][(at[1:] > at[:-1])]
        lead = lead[data[lead] == 32]
        keep = np.ones(len(data), bool)
        keep[lead] = False
        return data[keep], at - np.searchsorted(lead, at, "left")
    return data, at


_ENCODED = pa.schema([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def _read_vocabulary(model: str) -> Vocabulary:
    return Vocabulary.read(model)


def _same(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray, texts: list[str]) -> list[bool]:
    data, at = decode_all(v, ids, bounds)
    whole = data.tobytes()
    return [whole[a:b] == t.encode("utf-8", "replace") for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), texts, strict=True)]


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, most_bytes: int = 1 << 21) -> DataFrame:
    """``docs`` without its text, with ``ids`` (array of int), ``n_tokens`` and ``round_trip`` (decoding gives the text back).

    Ids are those of the SentencePiece library for the same model, without begin and end marks. A null or empty
    text has no ids. Long texts are encoded whole, also those without any space: they are matched in strips and parted
    only where no piece reaches across. Rows that repeat are encoded alike; no rows give no rows. Columns named like the three
    new ones are dropped. Decoding gives every valid text back, but for one that holds U+2581 or, if the model says
    so, extra spaces. Each task works on its own rows: no shuffle, and only the model's pieces are sent to it.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(_read_vocabulary(model))
    keep = [c for c in docs.columns if c not in (text_col, "ids", "n_tokens", "round_trip")]
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    # Spark hands columns to Python by plain names only
    own = [f"kept {i}" for i in range(len(keep))]
    ready = docs.select(*[named(c).alias(o) for c, o in zip(keep, own, strict=True)], named(text_col).cast("binary").alias("text to encode"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            texts = [(x or b"").decode("utf-8", "replace") for x in batch.column("text to encode").to_pylist()]
            lo, held = 0, 0
            for hi, text in enumerate(texts):
                held += len(text)
                if held < most_bytes and hi < len(texts) - 1:
                    continue
                ids, bounds = encoder.encode(texts[lo : hi + 1])
                same = _same(encoder.v, ids, bounds, texts[lo : hi + 1])
                arrays = [batch.column(c)[lo : hi + 1] for c in own]
                arrays += [pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(same)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*own, *_ENCODED.names])
                lo, held = hi + 1, 0

    told = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    return ready.mapInArrow(lean(run), T.StructType([*ready.schema.fields[:-1], *told])).toDF(*keep, *[f.name for f in told])


def decode_ids(tokens: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``tokens`` with ``text_col``, the text of the ids in ``ids_col``; null ids have a null text, no ids an empty one.

    A null among the ids, or one that the model does not have, has no text. Bytes that are no UTF-8 become U+FFFD, as
    the library writes them. Repeated rows are decoded alike, other columns kept; no rows give no rows.
    """
    spark = tokens.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(_read_vocabulary(model))
    ready = tokens.drop(text_col).withColumn("decoded ids", F.col(ids_col).cast("array<int>"))
    keep = [c for c in ready.columns if c != "decoded ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value.prepare()
        for batch in batches:
            lists = batch.column("decoded ids")
            raw = pa.array(lists.flatten()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            good = (raw >= 0) & (raw < len(v.table))
            data, at = decode_all(v, raw[good], np.concatenate([[0], np.cumsum(good)])[bounds])
            whole = data.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, text_col])

    return ready.mapInArrow(run, T.StructType([*(f for f in ready.schema.fields if f.name != "decoded ids"), T.StructField(text_col, T.StringType())]))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
